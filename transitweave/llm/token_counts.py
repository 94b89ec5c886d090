"""Token counts by prefix dynamic programming.

For each prefix of a word there is exactly one last token, the one that fits the
last token of what stands before it; so the count at a prefix is the count where
that token begins plus one. The counts at all prefixes answer how many tokens a
text has, where to cut it for a budget, and what any prefix costs, without
encoding anything again.
"""

from __future__ import annotations

import json
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import Memo, task_start

END = "</w>"


class WordRules:
    """How a tokenizer file of one kind normalises and finds words: NFC, white space, lower case; one pattern; bytes.

    Other files raise ValueError. White space needs no care, as no word holds it.
    """

    def __init__(self, spec: dict):
        normal, split = spec["normalizer"], spec["pre_tokenizer"]
        kinds = [x["type"] for x in normal.get("normalizers", [])], [x["type"] for x in split.get("pretokenizers", [])]
        if spec["model"]["type"] != "BPE" or spec["model"]["end_of_word_suffix"] != END or kinds != (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]):
            raise ValueError("not a tokenizer file of the kind known here")
        self.pattern = regex.compile(split["pretokenizers"][0]["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}"))
        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        newer = [c for c in regex.findall(r"[\p{L}\p{N}]", every) if unicodedata.category(c) == "Cn"]
        self.newer = re.compile(f"[{''.join(newer)}]")  # letters of a later Unicode than the library's
        self.least_newer = min(newer)
        # Marks have an order that depends on the Unicode version, and characters that this one lacks may be marks.
        marks = [re.escape(c) for c in map(chr, range(0x80, 0x1AB0)) if unicodedata.combining(c) or unicodedata.category(c) == "Cn"]
        self.marks = re.compile(f"[{''.join(marks)}]")

    def normalised(self, text: str) -> str:
        """As the library does, but for white space; lower case character by character."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return text.lower()

    def spans(self, normal: str) -> Iterator[tuple[int, int]]:
        return (m.span() for m in self.pattern.finditer(self.newer.sub("\ue000", normal)))

    def words(self, text: str) -> list[str]:
        normal = self.normalised(text)
        core = normal.rstrip(",.;:!?")
        if core.isalpha() and max(core) < "\u0250":  # letters, then marks: nothing to search for
            return [core, normal[len(core) :]] if len(core) < len(normal) else [core]
        if normal.isascii() or max(normal) < self.least_newer or not self.newer.search(normal):
            return self.pattern.findall(normal)
        return [normal[a:b] for a, b in self.spans(normal)]

    def doubtful(self, chunk: str) -> bool:
        """Whether Unicode versions may differ in a run's characters, or the library would change its words a second time."""
        return not chunk.isascii() and (max(chunk) > "\u1aaf" or self.marks.search(chunk) is not None or not unicodedata.is_normalized("NFC", self.normalised(chunk)))

    @staticmethod
    def whole_only(text: str) -> bool:
        """Whether the text may hold special tokens, or separators that only str.split() takes for white space."""
        return "<|" in text or any(c in text for c in "\x1c\x1d\x1e\x1f")


class PrefixCounter:
    """Counts tokens as the tokenizers library does with a merge-type file whose words end in </w>.

    The file must be of the kind that WordRules knows.
    """

    def __init__(self, tokenizer_file: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(tokenizer_file)
        with open(tokenizer_file, encoding="utf-8") as f:
            spec = json.load(f)
        self.rules, model = WordRules(spec), spec["model"]
        self.rank = {tuple(m) if isinstance(m, list) else tuple(m.split(" ")): k for k, m in enumerate(model["merges"])}
        self.vocab = set(model["vocab"])
        self.longest = max(len(t.removesuffix(END)) for t in self.vocab)
        self.special = regex.compile("|".join(regex.escape(t["content"]) for t in spec["added_tokens"]))
        self.of_byte = byte_characters()
        self.pairs: dict[tuple[str, str], bool] = {}
        self.totals = Memo(self.word_total)
        self.chunks = Memo(self.chunk_total)

    def merged(self, symbols: list[str]) -> list[str]:
        """The library's own rule: merge the pair of lowest rank, the leftmost first."""
        while len(symbols) > 1:
            rank, at = min((self.rank.get((symbols[i], symbols[i + 1]), 1 << 30), i) for i in range(len(symbols) - 1))
            if rank == 1 << 30:
                break
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def fits(self, left: str, right: str) -> bool:
        found = self.pairs.get((left, right))
        if found is None:
            if len(self.pairs) > 2_000_000:
                self.pairs.clear()
            found = self.pairs[left, right] = self.merged(_symbols(left) + _symbols(right)) == [left, right]
        return found

    def inner(self, mapped: str) -> tuple[list[int], list[str]]:
        """At each prefix that is not the word's end yet: the count, and the last token."""
        counts, last = [0] * (len(mapped) + 1), [""] * (len(mapped) + 1)
        for end in range(1, len(mapped) + 1):
            for start in range(max(0, end - self.longest), end):
                if (t := mapped[start:end]) in self.vocab and (not start or last[start] and self.fits(last[start], t)):
                    counts[end], last[end] = counts[start] + 1, t
                    break
        return counts, last

    def closed(self, mapped: str, end: int, counts: list[int], last: list[str]) -> int:
        """The count of mapped[:end] as a word of its own."""
        for start in range(max(0, end - self.longest), end):
            if (t := mapped[start:end] + END) in self.vocab and (not start or self.fits(last[start], t)):
                return counts[start] + 1
        raise ValueError(f"no token ends {mapped[:end]!r}")

    def mapped_total(self, mapped: str) -> int:
        return self.closed(mapped, len(mapped), *self.inner(mapped[:-1]))

    def word_total(self, word: str) -> int:
        return self.mapped_total("".join(map(self.of_byte.__getitem__, word.encode())))

    def word_prefixes(self, word: str) -> list[int]:
        """Counts at each prefix of a word, by characters, from none to all."""
        mapped = "".join(map(self.of_byte.__getitem__, word.encode()))
        counts, last = self.inner(mapped[:-1])
        ends, at = [0], 0
        for c in word:
            at += len(c.encode())
            ends.append(self.closed(mapped, at, counts, last))
        return ends

    def chunk_total(self, chunk: str) -> int:
        """Tokens between white space; no word and no composed character reaches across it.

        Doubtful runs are normalised and split into words by the library; the counting is the same.
        """
        if self.rules.doubtful(chunk):
            return sum(self.mapped_total(w) for w, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(chunk)))
        return sum(map(self.totals.__getitem__, self.rules.words(chunk)))

    def total(self, text: str | None) -> int:
        """Tokens of a whole text. Special tokens in it count as one each, as in the library."""
        if not text:
            return 0
        if self.rules.whole_only(text):
            parts = self.special.split(text)
            return len(parts) - 1 + sum(map(self.chunk_total, parts))
        return sum(map(self.chunks.__getitem__, text.split()))

    def prefixes(self, text: str | None) -> list[int]:
        """For each n, the tokens of the first n characters of the normalised text (without special tokens in it)."""
        out, done = [0], 0
        text = self.rules.normalised(text or "")
        for start, end in self.rules.spans(text):
            out += [done] * (start + 1 - len(out))
            out += [done + n for n in self.word_prefixes(text[start:end])[1:]]
            done = out[-1]
        return out + [done] * (len(text) + 1 - len(out))

    def cut(self, text: str | None, budget: int) -> str:
        """The longest prefix of the normalised text such that it and all shorter ones have `budget` tokens at most."""
        most, tops = 0, []
        for n in self.prefixes(text):
            most = max(most, n)
            tops.append(most)
        return self.rules.normalised(text or "")[: bisect_right(tops, budget) - 1]


def _symbols(token: str) -> list[str]:
    return [*token[: -len(END) - 1], token[-len(END) - 1 :]] if token.endswith(END) and len(token) > len(END) else list(token)


def byte_characters() -> list[str]:
    """The printable character for each byte: Latin-1's own where it prints, else the next one from 256."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, spare = [], 256
    for b in range(256):
        out.append(chr(b if b in own else spare))
        spare += b not in own
    return out


def token_counts(docs: DataFrame, tokenizer_file: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_bytes (UTF-8), n_tokens, over_limit.

    A null text counts as empty. Texts are counted whole, however long. Repeated rows give
    repeated results, an empty table none; other columns are not read.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = task_start(PrefixCounter, tokenizer_file)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            n = [c.total(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t.encode()) if t else 0 for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).mapInArrow(counted, f"doc_id {id_type}, n_bytes long, n_tokens long, over_limit boolean")


def truncated(docs: DataFrame, tokenizer_file: str, budget: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, text cut to the budget (normalised), its n_tokens. Null texts give empty ones."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = task_start(PrefixCounter, tokenizer_file)
        for batch in batches:
            texts = [c.cut(t, budget) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(map(c.total, texts), pa.int64())], names=["doc_id", "text", "n_tokens"])

    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).mapInArrow(cut, f"doc_id {id_type}, text string, n_tokens long")
