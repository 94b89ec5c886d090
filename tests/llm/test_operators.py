import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from transitweave.llm import ngram_join, queries, suffix_dedup
from transitweave.llm.common import hashed_words, ship
from transitweave.llm.decontaminate import best_alignment, leaks, without_leaks
from transitweave.llm.piece_codec import encoded_pieces, piece_digests
from transitweave.llm.quality import fit, quality_scores, train
from transitweave.llm.shards import byte_shards
from transitweave.llm.token_counts import PrefixCounter, token_counts, truncated
from transitweave.llm.token_records import FileEncoder, framed, read_at, read_records, record_folder, unframed, write_records
from transitweave.llm.topk import top_k
from transitweave.llm.urls import url_verdicts

DIR = "/root/testdata/sf0.001"
ODD = [(1, "Hello  world\n a", "x"), (2, None, "y"), (3, "", None), (4, "Hello  world\n a", "x"), (None, "null id é日😀", "z"), (5, "a" * 3000, "w"), (5, "a" * 3000, "w"), (6, " \t\n", "v"), (7, "<|endoftext|> <s> ▁x", "u")]
WORDS, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def docs(spark):
    ship(spark)
    return spark.read.parquet(f"{DIR}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    ship(spark)
    return spark.createDataFrame(ODD, "doc_id long, text string, shard string")


@pytest.fixture(scope="module")
def none(spark, odd):
    return odd.where("false")


def test_shards(docs, odd, none):
    for df in (docs, odd):
        rows = byte_shards(df).collect()
        assert len(rows) == df.count()
        slots = {}
        for r in rows:
            slots.setdefault(r.shard, []).append(r.slot)
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    rows = byte_shards(docs).collect()
    total, before = sum(len(t) + 16 for t in texts.values()), 0
    for r in sorted(rows, key=lambda r: r.doc_id):
        assert (r.size, r.text_crc32, r.shard) == (len(texts[r.doc_id]) + 16, zlib.crc32(texts[r.doc_id]), min(39, before * 40 // total))
        before += r.size
    assert byte_shards(none).count() == 0


def test_pieces(docs, odd, none):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for df in (docs, odd):
        want = sorted((str(r.doc_id), hashlib.sha256(" ".join(map(str, ids := sp.encode(r.text or "", add_eos=True))).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest(), len(ids)) for r in df.collect())
        assert sorted((str(r.doc_id), r.ids_sha256, r.decoded_sha256, r.n_tokens) for r in piece_digests(df, PIECES).collect()) == want
    assert encoded_pieces(odd, PIECES).where("doc_id = 2").first().ids == [2]
    assert piece_digests(none, PIECES).count() == 0


def test_counts_and_records(spark, docs, odd, none):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORDS)
    for df in (docs, odd):
        ids = sorted((str(r.doc_id), t.encode(r.text or "", add_special_tokens=False).ids) for r in df.collect())
        assert sorted((str(r.doc_id), r.n_tokens) for r in token_counts(df, WORDS).collect()) == [(i, len(x)) for i, x in ids]
        folder = record_folder(spark)
        index = write_records(df, folder, WORDS)
        crc = lambda x: zlib.crc32(np.array([*x, 1], "<u4").tobytes())
        rows = sorted(read_records(folder, index).collect(), key=lambda r: (r.start, r.n_tokens))
        assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in rows) == sorted((i, len(x) + 1, crc(x)) for i, x in ids)
        assert [r.start for r in rows] == [0, *np.cumsum([r.n_tokens for r in rows])[:-1]]
        assert read_at(folder, index.where("doc_id = 1")).first().ids[-1] == 1
    folder = record_folder(spark)
    assert read_records(folder, write_records(none, folder, WORDS)).count() == 0
    record = framed(np.array([1, 2], "<u2").tobytes(), 2)
    assert list(unframed(record)) == [1, 2]
    with pytest.raises(ValueError):
        unframed(record[:-5] + b"\7" + record[-4:])
    c = PrefixCounter(WORDS)
    text = "hello wonderful world"
    assert c.prefixes(text) == [len(t.encode(text[:k], add_special_tokens=False).ids) for k in range(len(text) + 1)]
    assert all(r.n_tokens <= 3 for r in truncated(odd, WORDS, 3).collect())


def test_counts_of_all_scripts():
    from tokenizers import Tokenizer

    t, c, e = Tokenizer.from_file(WORDS), PrefixCounter(WORDS), FileEncoder(WORDS)
    some = [chr(k) for k in range(1, 0x20000, 7) if not 0xD800 <= k < 0xE000]
    texts = [f"x{a}y Ab{a} {a}1" for a in some] + ["".join(some[k : k + 20]) for k in range(0, len(some), 20)] + ["a" * 50_000 + " é日😀" * 9_000]
    for text, x in zip(texts, t.encode_batch(texts, add_special_tokens=False)):
        assert c.total(text) == len(x.ids) and np.frombuffer(e.encode(text), f"<u{e.width}").tolist() == x.ids, text[:40]


def plain_top_k(rows, k, every):
    whole = lambda v: [int(x) * 256 if abs(x) >= 2**53 else int(np.floor(x * 256)) for x in v]
    sound = [(i, v) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    asked = {i: whole(min(v for j, v in sound if j == i)) for i, _ in sound if i % every == 0}
    score = lambda a, b: max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(a, b))))
    return sorted((q, n + 1, j, -s) for q, a in asked.items() for n, (s, j) in enumerate(sorted((-score(a, whole(v)), j) for j, v in sound if j != q)[:k]))


def test_top_k(spark):
    ship(spark)
    rng = np.random.default_rng(0)
    plain = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(40)] + [(100 + i, [0.5] * 4) for i in range(9)] + [(7, [0.5] * 4)] * 6
    odd = [(200, None), (202, [1.0, None, 0.0, 0.0]), (204, [float("nan")] * 4), (None, [1.0] * 4), (10, [9.0] * 4), (330, [1.0]), (331, [])]
    huge = [(300, [1e307, 2.0, 0.0, 0.0]), (301, [1e200, 1.0, 1.0, 1.0]), (303, [4e5 + 0.3, -7e6, 3.3, 9.0]), (310, [4.1e5, 2e7, 1.0, 1.0]), (320, [-1e307, 1.0, 0.0, 0.0])]
    many = [(i, [float(x) for x in rng.integers(-40, 40, 3)]) for i in range(3000)]  # scores lie close together
    for rows in (plain, plain + odd + huge, many):
        found = top_k(spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, rank int").repartition(3), 5, 10)
        assert sorted(map(tuple, found.collect())) == plain_top_k(rows, 5, 10)
    few = spark.createDataFrame(plain[:3], "vec_id long, embedding array<double>")
    assert top_k(few, 5, 10).count() == 2 and top_k(few.where("false"), 5, 10).count() == 0


def plain_repeats(texts: dict[int, bytes], length: int) -> dict[int, tuple[int, int, str]]:
    """n_removed, n_spans and kept_sha256 by looking each string up."""
    seen: set[bytes] = set()
    out = {}
    for i in sorted(texts):
        data, gone = texts[i], bytearray(len(texts[i]))
        for at in range(len(data) - length + 1):
            s = data[at : at + length]
            if s in seen:
                gone[at : at + length] = b"\1" * length
            seen.add(s)
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        out[i] = sum(gone), sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()
    return out


def test_hashed_words():
    rng = np.random.default_rng(4)
    texts = [None, "", " \t", "A a", "x" * 700_000 + " y", "é日 É", *(" ".join(rng.choice(["a", "B", "cc", "\u00a0", "\x1c"], 300_000)) for _ in range(2)), "y " * 140_000 + "z" * 300_000 + " y"]
    got, seen = hashed_words(texts), {}
    for text, h in zip(texts, got):
        words = (text or "").encode().lower().split()
        assert len(words) == len(h)
        for w, x in zip(words, h.tolist()):
            assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen) > 8


def test_suffix_order():
    rng = np.random.default_rng(1)
    for _ in range(50):
        t = rng.integers(1, 4, rng.integers(5, 120)).astype(np.uint8)
        t[rng.integers(0, len(t), 3)] = 0
        t[-1] = 0
        keys = [bytes(t)[i:].split(b"\0")[0][:12] for i in suffix_dedup.suffix_order(t, 12)]
        assert keys == sorted(keys) and len(keys) == len(t)


@pytest.mark.parametrize("wide", [1, 3, 1000])
def test_repeats(spark, none, wide, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "_WIDE", wide)
    rng = np.random.default_rng(2)
    rows = [(i, "".join(rng.choice(list("ab\n"), int(rng.integers(0, 60))))) for i in range(120)] + [(300, None), (301, ""), (302, "a" * 500), (303, "é" * 100)]
    got = {r.doc_id: (r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.repeat_digests(spark.createDataFrame(rows, "doc_id long, text string"), 9).collect()}
    assert got == plain_repeats({i: (t or "").encode() for i, t in rows}, 9)
    assert suffix_dedup.repeat_digests(none, 9).count() == 0


@pytest.mark.parametrize(("tile", "num", "den"), [(20, 9, 10), (2048, 9, 10), (5, 4, 5), (2048, 1, 3), (10, 1, 4), (20, 1, 1)])
def test_join(spark, odd, none, tile, num, den, monkeypatch):
    monkeypatch.setattr(ngram_join, "_TILE", tile)
    rng = np.random.default_rng(3)
    base = [list(rng.choice(list("abcdefghijklmnop"), rng.integers(5, 60))) for _ in range(6)]
    rows = [(400, None), (401, ""), (402, "A"), (403, "a"), (404, "a b")]
    for i in range(150):
        w = list(base[rng.integers(0, 6)])
        for _ in range(rng.integers(0, 6)):
            w[rng.integers(0, len(w))] = rng.choice(list("abcxyz"))
        rows.append((i, " ".join(w[: rng.integers(1, 60)] if num * 2 < den else w)))
    long = [f"v{k}" for k in range(2500)]  # bitmaps of several lengths
    rows += [(500 + k, " ".join(long[: 2500 - k * 400])) for k in range(6)] + [(506, " ".join(long) + " end")]
    sets = {}
    for i, t in rows:
        w = (t or "").lower().split()
        sets[i] = {tuple(w[k : k + 3]) for k in range(len(w) - 2)} if len(w) > 2 else {tuple(w)} if w else set()
    root = {i: i for i in sets}
    links = [(i, j) for i in sets for j in sets if i < j and sets[i] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j])]
    changed = True
    while changed:
        changed = False
        for i, j in links:
            low = min(root[i], root[j])
            changed |= root[i] != low or root[j] != low
            root[i] = root[j] = low
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, key int, node string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similar_documents(df, 3, num, den).collect()}
    assert got == {i: (len(sets[i]), root[i]) for i in sets}
    if tile == 2048:
        assert ngram_join.similar_documents(odd).count() == len(ODD) and ngram_join.similar_documents(none).count() == 0


def test_join_of_near_copies_meets_one_of_them(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "_TILE", 64)
    met, by_block = [], ngram_join._by_block
    monkeypatch.setattr(ngram_join, "_by_block", lambda rows, *x: met.append(rows.count()) or by_block(rows, *x))
    base = " ".join(f"w{k}" for k in range(60))
    rows = [(i, f"{base} end{i}") for i in range(2000)]
    df = spark.createDataFrame([*rows, (9000, " ".join(f"v{k}" for k in range(60)))], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in ngram_join.similar_documents(df, 3, 9, 10).collect()}
    assert got == {i: 0 for i, _ in rows} | {9000: 9000}
    assert len(met) == 6 and met[2] == met[5] == 0  # no tiles, in neither pass
    assert 2000 < met[4] < 2100 and met[1] < 2100 * 45  # a meeting with the first in each group: pairs of 10 keys at most


def test_classes_have_128_bits():
    grams = np.arange(5, dtype=np.uint64)
    assert len(ngram_join._class_of(grams)) == 16 and ngram_join._class_of(grams) != ngram_join._class_of(grams[1:])


def test_join_rejects(spark, odd):
    for bad in ((0, 1), (3, 2)):
        with pytest.raises(ValueError):
            ngram_join.similar_documents(odd, 3, *bad)
    with pytest.raises(ValueError):
        ngram_join.similar_documents(odd.withColumn("doc_id", F.col("shard")))


def test_quality(spark, docs, odd, none):
    big = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    scored = quality_scores(big, train(big, labels)).join(labels, "doc_id").where("held_out")
    assert scored.where("predicted = quality").count() >= 0.95 * scored.count()
    assert quality_scores(odd, train(odd, labels.where("false"))).where("score = 0.5 and predicted = 1").count() == len(ODD)
    assert quality_scores(none, fit(np.zeros((0, 16)), np.zeros(0, bool), 10)).count() == 0


def test_leaks(spark, odd, none):
    ship(spark)
    item = "the quick brown fox jumps over the lazy dog near old river banks today"
    tests = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "zyx wvu"), (5, "qqq"), (1, item)], "item_id long, text string")
    rows = [(1, f"some text before. {item.upper()}! after it"), (2, item.replace("lazy", "sleepy")), (3, "the quick brown cat sat"), (4, "nothing to see"), (5, "a zyx, wvu b"), (6, None), (7, "qqq"), (7, "qqq"), (None, item)]
    docs = spark.createDataFrame([(*r, "x", 3) for r in rows], "doc_id long, text string, item_id string, items int")
    assert sorted((r.doc_id or 0, r.item_id) for r in leaks(docs, tests).collect()) == [(0, 1), (1, 1), (2, 1), (5, 4), (7, 5), (7, 5)]
    kept = without_leaks(docs, tests)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {3, 4, 6}
    assert leaks(none, tests).count() == 0 and without_leaks(odd, tests).count() == len(ODD) and without_leaks(odd, tests.where("false")).count() == len(ODD)
    named = spark.createDataFrame([("a", item)], "item_id string, text string")
    assert {(r.doc_id, r.item_id) for r in leaks(docs.where("doc_id < 3"), named).collect()} == {(1, "a"), (2, "a")}


def test_leaks_against_alignment_of_all_pairs(spark):
    ship(spark)
    rng = np.random.default_rng(11)
    vocabulary = [f"w{k}" for k in range(400)]
    some = lambda n: [vocabulary[int(k)] for k in np.minimum(399, rng.zipf(1.3, n) - 1)]
    items = [some(n) for n in [1, 2, 3, 4, 5, 5, 6, 7, 8, 8, 12, 16, 20, 25, 30, 40, 40, 55]]
    docs = []
    for k, item in enumerate(items * 8):
        out, share = [], rng.choice([0.0, 0.1, 0.2, 0.3])
        for at, w in enumerate(item):
            kind = rng.integers(0, 3) if rng.random() < share else 3
            out += {0: [], 1: some(1), 2: [w, *some(1)], 3: [w]}[int(kind)]
            if k % 8 == 5 and at % 2:
                out += some(1)  # a word after every second one
        docs.append(some(int(rng.integers(0, 80))) + out + some(int(rng.integers(0, 80))))
    docs.append(some(20_000) + items[-1] + some(20_000))
    numbers = lambda ws: hashed_words([" ".join(ws)])[0]
    want = {(d, i): best_alignment(numbers(item), numbers(doc))[0] / (2 * len(item)) for d, doc in enumerate(docs) for i, item in enumerate(items)}
    want = {k: v for k, v in want.items() if v >= 0.6}
    got = {(r.doc_id, r.item_id): r.score for r in leaks(spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id int, text string"), spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(items)], "item_id int, text string")).collect()}
    assert all(got[k] == pytest.approx(want[k]) for k in got)
    long = {k for k in want if len(items[k[1]]) > 8}
    assert len(long) > 40 and len(long & got.keys()) >= 0.95 * len(long)
    assert {k for k in want if k not in long} == {k for k in got if k not in long}


def test_urls(spark):
    ship(spark)
    urls = ["http://A.example.net/en/x?q", "https://net", "http://example.com/de/1", "http://my.org/fr/?a", "no scheme", None, "http://example.com/en/1#top", "http://notnet/x"]
    got = [(r.host, r.path, r.rule) for r in url_verdicts(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).orderBy("page_id").collect()]
    assert got == [("a.example.net", "/en/x", "example.net/en/"), ("net", "", None), ("example.com", "/de/1", "example.com/de/"), ("my.org", "/fr/", "org/fr/"), ("", "", None), ("", "", None), ("example.com", "/en/1", None), ("notnet", "/x", None)]


def test_urls_of_odd_tables(spark):
    ship(spark)
    urls = ["http://net/a", "http://net/a", None, "", "ftp://x.org/b", "http://a.net/c"]
    pages = spark.createDataFrame([(i, u, "x", 1) for i, u in enumerate(urls)], "page_id int, url string, gram string, key int")
    rows = url_verdicts(pages.unionByName(pages)).collect()  # only one verdict has URLs to learn from
    assert len(rows) == 12 and {(r.rule, r.verdict, r.difference) for r in rows} == {("net/", "block", 0.0), (None, "allow", 0.0)}
    assert url_verdicts(pages.where("false")).count() == 0


def test_pairwise_fit_is_a_minimum():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(500, 16))
    good = x[:, 0] + 0.5 * x[:, 3] + rng.normal(size=500) > 0
    ranker = fit(x, good, 4000)
    z = np.clip((x - x.mean(0)) / x.std(0), -8, 8)
    again = np.random.default_rng(7)
    d = z[again.choice(np.flatnonzero(good), 4000)] - z[again.choice(np.flatnonzero(~good), 4000)]
    loss = lambda w: np.log1p(np.exp(-d @ w)).mean() + 5e-4 * w @ w
    least = loss(ranker.weights)
    assert all(loss(ranker.weights + e) >= least for e in rng.normal(size=(200, 16)) * 0.01)
    errors = lambda t: (good != (z @ ranker.weights >= t)).sum()
    assert errors(ranker.threshold) <= min(errors(t) for t in z @ ranker.weights) + 2
    assert ((ranker.scores(x) >= 0.5) == (z @ ranker.weights >= ranker.threshold)).all()


def test_repeats_in_very_long_texts(spark):
    rng = np.random.default_rng(9)
    text = "".join(rng.choice(list("abcdefgh"), 300_000))
    rows = [(1, text), (2, "x" + text[250_000:280_000] + "y"), (3, None), (4, "short")]
    df = spark.createDataFrame([(*r, 1, 2, b"z") for r in rows], "doc_id long, text string, version int, start int, bytes binary")
    got = {r.doc_id: (r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.repeat_digests(df).collect()}
    assert got == {i: (n, s, hashlib.sha256(k.encode()).hexdigest()) for i, n, s, k in ((1, 0, 0, text), (2, 30_000, 1, "xy"), (3, 0, 0, ""), (4, 0, 0, "short"))}


def test_stages_on_odd_rows(spark):
    import corpus_pipeline

    docs = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in ODD], "doc_id long, text string, lang string, source string, n_chars long").withColumn("version", F.lit("v")).withColumn("id", F.lit(1)).withColumn("row", F.lit(2))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DIR)
        assert stage(spark, docs.where("false"), DIR).count() == 0
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns and out.count() <= len(ODD)
        else:
            assert out.count() == len(ODD)


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DIR)
        assert docs.columns == columns
    assert 0 < corpus_pipeline.run(spark, DIR).count() <= 200


def test_all_registered():
    assert {int(n[2:].split("_")[0]) for n in queries.queries()} == set(range(1, 14))


@pytest.mark.parametrize("wide", [1, 3, 1000])
def test_repeats_of_rows_and_null_ids(spark, wide, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "_WIDE", wide)
    rng = np.random.default_rng(5)
    some = lambda: "".join(rng.choice(list("ab\n"), int(rng.integers(9, 60))))
    more = [(None, some()) for _ in range(20)] + [(int(i), some()) for i in rng.integers(0, 20, 60)]
    long = "".join(rng.choice(list("abcdefgh"), 300))
    mixed = more + more[30:50] + [(900, long), (900, long), (900, long[50:] + "x"), (None, "y" + long), (None, "z" + long[:200])]
    for rows, length in (([r[:2] for r in ODD], 100), (mixed, 9), (mixed[::-1], 100)):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        keyed = df.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("doc_id", F.lit(-(2**63))).alias("doc"), suffix_dedup.version_of(F.col("doc_id"), F.col("text")).alias("version")).collect()
        brute = plain_repeats({(r.doc, r.version): r.text.encode() for r in keyed}, length)
        want = sorted((str(r.doc_id), *brute[r.doc, r.version]) for r in keyed)
        assert sorted((str(r.doc_id), r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.repeat_digests(df, length).collect()) == want
        cut = suffix_dedup.cut_documents(df.withColumn("n_chars", F.length("text").cast("long")), length).collect()
        assert sorted((str(r.doc_id), hashlib.sha256((r.text or "").encode()).hexdigest()) for r in cut) == sorted((i, sha) for i, _, _, sha in want)


def test_null_ids_with_one_text_leave_one(spark):
    text = "".join(np.random.default_rng(6).choice(list("abcdefgh"), 150))
    df = spark.createDataFrame([(None, text), (None, text), (None, text), (None, "b" * 50), (None, "b" * 50)], "doc_id long, text string")
    assert sorted(r.n_removed for r in suffix_dedup.repeat_digests(df, 100).collect()) == [0, 0, 0, 150, 150]
    assert sorted(len(r.text) for r in suffix_dedup.cut_documents(df.withColumn("n_chars", F.length("text").cast("long")), 100).collect()) == [0, 0, 50, 50, 150]


def test_near_copies_go_by_row(spark):
    ship(spark)
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(1, a), (2, a + " end"), (2, b), (3, c), (3, c), (None, a), (None, b + " end"), (None, "d " * 9), (None, None)]
    got = ngram_join.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(str, got)) == sorted(str(type(got[0])(doc_id=i, text=t)) for i, t in rows if (i, t) in {(1, a), (2, b), (3, c), (None, "d " * 9), (None, None)})


def test_url_counts_are_exact(spark):
    ship(spark)
    rng = np.random.default_rng(7)
    name = lambda n: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz0123456789"), n))
    urls = [f"http://{h}/{name(60)}" for h in rng.choice(["net", "example.net/en", "example.com/de", "my.org/fr", "else.com"], 4000)] + [None, "", "é日"]
    rows = url_verdicts(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()
    counts = [{}, {}]
    padded = [b"\2" * 4 + (u or "").encode() + b"\3" for u in urls]
    for u, r, x in ((urls[r.page_id], r, padded[r.page_id]) for r in rows):
        if r.rule and zlib.crc32(u.encode()) % 3 != 1:
            n = counts[r.verdict == "block"]
            for at in range(4, len(x)):
                for k in range(5):
                    for key in ((k, x[at - k : at]), (k, x[at - k : at + 1])):
                        n[key] = n.get(key, 0) + 1
    assert len(rows) == len(urls) and all(counts)
    cut = lambda v: [r.difference for r in rows if not r.rule and r.verdict == v]
    assert cut("allow") and cut("block") and max(cut("block")) < min(cut("allow"))
    held = [(r.difference, r.verdict == "allow") for r in rows if r.rule and zlib.crc32(urls[r.page_id].encode()) % 3 == 1]
    right = lambda t: sum((d >= t) == a for d, a in held if a) / sum(a for _, a in held) + sum((d >= t) == a for d, a in held if not a) / sum(not a for _, a in held)
    assert right(min(cut("allow"))) >= max(right(d) for d, _ in held) - 0.02
    for r in rows[::7] + rows[-3:]:
        x, total = padded[r.page_id], 0.0
        for at in range(4, len(x)):
            p = [1 / 256, 1 / 256]
            for k in range(5):
                for c in (0, 1):
                    p[c] = (counts[c].get((k, x[at - k : at + 1]), 0) + 4 * p[c]) / (counts[c].get((k, x[at - k : at]), 0) + 4)
            total += np.log(p[0]) - np.log(p[1])
        assert r.difference == pytest.approx(total / (len(x) - 4), abs=1e-8)
