"""SentencePiece encoding and decoding of merge-type models by backtracking.

A sequence of pieces is the library's answer if and only if each two neighbours
are what merging their joined characters anew gives. So a text is cut into the
longest pieces that an Aho-Corasick automaton finds, each neighbour is checked
by such a re-merge, and on failure the encoder goes back to a shorter piece; a
bit for each position that has failed keeps it from being tried twice.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import Memo, task_start

SPACE = "▁"  # how a model of this kind writes a space


class PieceCodec:
    """Encodes and decodes with the pieces and scores of one model file."""

    def __init__(self, model_file: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = model.vocab_size()
        self.end_id = model.eos_id()
        self.score: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        self.byte_ids = [0] * 256
        self.shown: dict[str, str] = {}  # by decimal id: what decoding shows; bytes over 127 as lone surrogates
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_control(i) or model.is_unknown(i):
                self.shown[str(i)] = ""
            elif model.is_byte(i):
                b = int(piece[3:5], 16)
                self.byte_ids[b] = i
                self.shown[str(i)] = bytes([b]).decode("utf-8", "surrogateescape")
            else:
                self.ids[piece] = i
                self.score[piece] = model.get_score(i)
                self.shown[str(i)] = piece.replace(SPACE, " ")
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("a piece has a space after another character: texts can't be cut before spaces")
        if any(c not in self.ids for p in self.ids for c in p):
            raise ValueError("a piece has a character that is no piece itself")
        self.unknown = re.compile("([^" + re.escape("".join(p for p in self.ids if len(p) == 1)) + "])")
        self.automaton = ahocorasick.Automaton()
        for p in self.ids:
            self.automaton.add_word(p, (len(p) - 1, p))
        self.automaton.make_automaton()
        self.shorter = {p: next((p[:k] for k in range(len(p) - 1, 0, -1) if p[:k] in self.ids), None) for p in self.ids}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.words = Memo(self.spaced, most=150_000)  # by run without its first space
        self.tails = Memo(self.bare, most=150_000)

    def merged(self, text: str) -> list[str]:
        """The model's own rule: merge the neighbours whose joined piece scores highest, the leftmost first."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def fits(self, left: str, right: str) -> bool:
        found = self.pairs.get((left, right))
        if found is None:
            if len(self.pairs) > 2_000_000:
                self.pairs.clear()
            found = self.pairs[left, right] = self.merged(left + right) == [left, right]
        return found

    def known(self, text: str) -> list[str]:
        """Pieces of a text all of whose characters are pieces."""
        longest: list[str | None] = [None] * len(text)
        for end, (back, p) in self.automaton.iter(text):  # of those with one start, the longest comes last
            longest[end - back] = p
        out: list[str] = []
        at, failed, piece = 0, bytearray(len(text) // 8 + 1), longest[0] if text else None
        while at < len(text):
            while piece is not None and ((failed[(e := at + len(piece)) >> 3] >> (e & 7)) & 1 or out and not self.fits(out[-1], piece)):
                piece = self.shorter[piece]
            if piece is None:
                failed[at >> 3] |= 1 << (at & 7)
                piece = out.pop()
                at -= len(piece)
                piece = self.shorter[piece]
            else:
                out.append(piece)
                at += len(piece)
                piece = longest[at] if at < len(text) else None
        return out

    def run(self, text: str) -> list[int]:
        """Ids of a run without a space after its beginning; unknown characters become their bytes."""
        ids: list[int] = []
        for k, part in enumerate(self.unknown.split(text)):
            ids += [self.byte_ids[b] for b in part.encode()] if k % 2 else [self.ids[p] for p in self.known(part)]
        return ids

    def bare(self, run: str) -> str:
        return " ".join(map(str, self.run(run)))

    def spaced(self, run: str) -> str:
        head, line, rest = run.partition("\n")
        if line and head and "\n" not in self.ids:  # most new runs only join two known ones at a line's end
            return f"{self.words[head]} {self.byte_ids[10]}{' ' * bool(rest)}{self.tails[rest]}"
        return self.bare(SPACE + run.replace(" ", SPACE))

    def encode_decimal(self, text: str | None) -> str:
        """The ids of a text, in decimals joined by spaces, with the end id."""
        if not text:
            return str(self.end_id)
        runs = text.replace(SPACE, " ").split(" ")
        if "" in runs:  # spaces that meet, or begin or end the text, belong to one run
            runs = [r[1:] for r in re.findall(" +[^ ]*", " " + text.replace(SPACE, " "))]
        return f"{' '.join(map(self.words.__getitem__, runs))} {self.end_id}"

    def encode(self, text: str | None) -> list[int]:
        return list(map(int, self.encode_decimal(text).split(" ")))

    def decode_decimal(self, ids: str) -> bytes:
        """UTF-8 of the text that the ids stand for; the space that encoding put before it goes."""
        text = "".join(map(self.shown.__getitem__, ids.split(" ")))
        return text.removeprefix(" ").encode("utf-8", "surrogateescape")

    def decode(self, ids: Iterable[int]) -> str:
        return self.decode_decimal(" ".join(map(str, ids)) or str(self.end_id)).decode("utf-8", "replace")


def piece_digests(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_tokens, ids_sha256, decoded_sha256.

    A null text counts as empty: the end id alone, decoded to nothing. Texts are
    encoded whole, whatever their length. Repeated rows give repeated results, an
    empty table none; other columns are not read.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = task_start(PieceCodec, model_file)
        for batch in batches:
            n, ids_sha, text_sha = [], [], []
            for text in batch.column(1).to_pylist():
                ids = c.encode_decimal(text)
                n.append(ids.count(" ") + 1)
                ids_sha.append(hashlib.sha256(ids.encode()).hexdigest())
                text_sha.append(hashlib.sha256(c.decode_decimal(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).mapInArrow(encoded, f"doc_id {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encoded_pieces(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, ids (array<int>, with the end id), decoded (string). As piece_digests for odd rows."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = task_start(PieceCodec, model_file)
        for batch in batches:
            ids = [c.encode(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([c.decode(i) for i in ids], pa.string())], names=["doc_id", "ids", "decoded"])

    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).mapInArrow(encoded, f"doc_id {id_type}, ids array<int>, decoded string")
