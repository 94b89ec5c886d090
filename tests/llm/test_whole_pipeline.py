"""The pipeline against plain versions of its stages, and operators over odd tables."""

import hashlib
import re
from math import log1p

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from transitweave.llm.common import hashed_words, ship, written
from transitweave.llm.decontaminate import best_alignment
from transitweave.llm.piece_codec import piece_digests
from transitweave.llm.quality import features, fit, quality_scores, train
from transitweave.llm.shards import byte_shards
from transitweave.llm.token_counts import token_counts
from transitweave.llm.token_records import read_records, record_folder, write_records
from transitweave.llm.urls import url_verdicts

DIR = "/root/testdata/sf0.001"
WORDS, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")


def plain_features(text):
    words = text.split() if text else []
    if not words:
        return [0.0] * 16
    n, size, lines = len(words), len(text.encode()), [x for x in text.split("\n") if x]
    share = lambda pattern: len(re.findall(pattern, text)) / size
    top = max(words.count(w) for w in set(words))
    return [
        log1p(n), size / n, len(set(words)) / n**0.85, top / n, share("[A-Z]"), share("[0-9]"), share("[.?;:]"), share(","), share("!"), share(r"[\"#$%&'()*+\-/<=>@\[\\\]^_`{|}~\x7f]"), log1p(n / max(1, len(lines))),
        1 - len(set(lines)) / max(1, len(lines)), sum(w[-1] in ".,;:?!" for w in words) / n, sum(not w.rstrip(".,;:?!").isalnum() for w in words) / n, sum(len(w) > 20 for w in words) / n, sum(a == b for a, b in zip(words, words[1:], strict=False)) / n,
    ]


def test_features(spark):
    ship(spark)
    texts = [r.text for r in spark.read.parquet(f"{DIR}/documents.parquet").select("text").collect()]
    for text in [*texts, None, "", " \n", "A", "é é! x,\n\nx,\nWORD " + "b" * 30, "a\tb\x7f~"]:
        assert features(text) == pytest.approx(plain_features(text), abs=1e-12), text[:60]


def one_of_each(docs):
    sets, root = {}, {r.doc_id: r.doc_id for r in docs}
    for r in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r.text or ""))
        sets[r.doc_id] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            if sets[i] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i for i in ids if find(i) == i}


def without_repeats(docs, length=100):
    seen, out = set(), {}
    for r in sorted(docs, key=lambda r: r.doc_id):
        data, gone = (r.text or "").encode(), bytearray(len((r.text or "").encode()))
        for at in range(len(data) - length + 1):
            if data[at : at + length] in seen:
                gone[at : at + length] = b"\1" * length
            seen.add(data[at : at + length])
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        out[r.doc_id] = None if r.text is None else kept.decode("utf-8", "ignore")
    return out


def test_stages_against_plain_versions(spark):
    """Each stage over the table of documents gives what its plain version gives of the same input; together they are run()'s rows."""
    import corpus_pipeline
    import sentencepiece

    ship(spark)
    docs, labels = spark.read.parquet(f"{DIR}/documents.parquet"), spark.read.parquet(f"{DIR}/labels.parquet")
    stage = dict(zip(["quality", "near", "repeats", "leaks", "pieces"], [f for _, f in corpus_pipeline.STAGES], strict=True))

    ranker = train(docs, labels, most=20_000)
    x = {r.doc_id: ranker.scores(np.array([plain_features(r.text)]))[0] for r in docs.collect()}
    good = written(stage["quality"](spark, docs, DIR), "good")
    rows = good.collect()
    assert {r.doc_id for r in rows} == {i for i, s in x.items() if s >= 0.5} and 0 < len(rows) < docs.count()

    near = written(stage["near"](spark, good, DIR), "near")
    assert {r.doc_id for r in near.collect()} == one_of_each(rows) and near.count() < good.count()

    cut = written(stage["repeats"](spark, near, DIR), "cut")
    texts = without_repeats(near.collect())
    assert {r.doc_id: r.text for r in cut.collect()} == texts and any(len(texts[r.doc_id] or "") < len(r.text or "") for r in near.collect())

    clean = written(stage["leaks"](spark, cut, DIR), "clean")
    numbers = lambda text: hashed_words([re.sub(r"[^0-9a-z\u0080-\U0010ffff]+", " ", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))])[0]
    items = [numbers(r.text) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    of = {i: numbers(t) for i, t in texts.items()}
    leaking = {i for i, words in of.items() if len(words) and any(len(t) and best_alignment(t, words)[0] / (2 * len(t)) >= 0.6 for t in items)}
    assert {r.doc_id for r in clean.collect()} == set(texts) - leaking

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    want = set()
    for r in clean.collect():
        ids = sp.encode(r.text or "", add_eos=True)
        want.add((r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()))
    columns = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert {tuple(r) for r in stage["pieces"](spark, clean, DIR).select(*columns).collect()} == want
    assert {tuple(r) for r in corpus_pipeline.run(spark, DIR).select(*columns).collect()} == want


CLASH = "score double, n_tokens long, start long, shard int, slot long, law string, size long, held_out boolean, predicted int, ids_sha256 string, n_bytes long, over_limit boolean, file string, offset long, length long, range int, host string, verdict string, difference double"


def clashing(df):
    for part in CLASH.split(", "):
        name, kind = part.split(" ")
        df = df.withColumn(name, F.lit(None).cast(kind))
    return df


@pytest.mark.parametrize("operator", ["shards", "quality", "pieces", "counts", "records", "urls"])
def test_clashing_names_and_long_texts(spark, operator):
    """Columns named as a result's change nothing; texts of over a million characters are taken whole; no rows give none."""
    ship(spark)
    ranker = fit(np.random.default_rng(0).normal(size=(40, 16)), np.arange(40) % 2 == 0, 200)
    rows = [(1, "Word, " * 200_000 + "end."), (2, "x" * 1_100_000), (3, None), (4, ""), (None, "no id"), (1, "again"), (1, "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    pages = docs.select(F.col("doc_id").alias("page_id"), F.concat(F.lit("https://a.example.org/fr/"), "text").alias("url"))

    def records(df):
        folder = record_folder(spark)
        return read_records(folder, write_records(df, folder, WORDS))

    run = {"shards": byte_shards, "quality": lambda df: quality_scores(df, ranker), "pieces": lambda df: piece_digests(df, PIECES), "counts": lambda df: token_counts(df, WORDS), "records": records, "urls": url_verdicts}[operator]
    table = pages if operator == "urls" else docs
    plain, odd = run(table), run(clashing(table))
    assert plain.columns == odd.columns and sorted(map(str, plain.collect())) == sorted(map(str, odd.collect())) and plain.count() == len(rows)
    assert run(clashing(table).where("false")).count() == 0
    if operator == "shards":
        assert {r.size for r in plain.collect()} == {len((t or "").encode()) + 16 for _, t in rows}
    if operator == "quality":
        scores = ranker.scores(np.array([plain_features(t) for _, t in rows]))
        assert sorted(r.score for r in plain.collect()) == pytest.approx(sorted(scores))
