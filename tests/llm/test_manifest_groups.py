import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from transitweave.llm import merkle, oracle, simhash, spelling
from transitweave.llm.common import ship
from transitweave.llm.merkle import merkle_manifest
from transitweave.llm.order import numbered
from transitweave.llm.simhash import fingerprint, linked, links, simhash_groups
from transitweave.llm.spelling import near_words, one_edit, pairs_of_cell, spelling_forms, spelling_variants

DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string, idx int, n int, word string, root string, fp long, node int, known int, block int, all int"
CLASH = (None, 7, 7, "w", "r", 7, 7, 7, 7, 7)
ODD = [
    (1, "Hello  World\n again and again", "en", "a", 5),
    (2, None, None, "a", None),
    (3, "", "en", None, 0),
    (1, "Hello  World\n again and again", "en", "a", 5),
    (None, "null id é日😀 à×", "fr", "b", 9),
    (None, None, None, None, None),
    (5, "A" * 70_000 + " b", "en", "b", 70_002),
    (5, "ab cd " * 30_000, "en", "", 180_000),
    (6, " \t\n", "en", "b", 3),
    *((k, "the very same five words here", "en", "hot", 29) for k in range(100, 160)),
]


@pytest.fixture(scope="module")
def odd(spark):
    ship(spark)
    return spark.createDataFrame([(*r, *CLASH) for r in ODD], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    ship(spark)
    return spark.read.parquet(f"{DIR}/documents.parquet")


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(r, lower=False):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), r["text"]) if lower and r["text"] is not None else r["text"]
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r["doc_id"], r["source"], r["lang"], r["n_chars"], text)))


def plain_tree(leaves):
    """Top, and for each leaf its (left, right) siblings from the bottom up."""
    level, ways, of = leaves, [[] for _ in leaves], list(range(len(leaves)))
    while len(level) > 1:
        runs = [level[k : k + 16] for k in range(0, len(level), 16)]
        for k, way in enumerate(ways):
            run, at = runs[of[k] // 16], of[k] % 16
            way.append((run[:at], run[at + 1 :]))
        of, level = [k // 16 for k in of], [sha(*run) for run in runs]
    return level[0], ways


def plain_manifest(rows):
    by = {}
    for r in rows:
        by.setdefault(r["source"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r), r))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: plain_tree([x[2] for x in sorted(by[s], key=lambda x: x[:3])]) for s in names}
    root, above = plain_tree([trees[s][0] for s in names])
    out = []
    for s, up in zip(names, above, strict=True):
        for (_, _, leaf, r), way in zip(sorted(by[s], key=lambda x: x[:3]), trees[s][1], strict=True):
            now = leaf_of(r, r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
            for left, right in way + up:
                now = sha(*left, now, *right)
            out.append((r["doc_id"], leaf, trees[s][0], root, sha(*(x for left, right in way + up for x in left + right)), now, now == root))
    return sorted(out, key=str)


def test_manifest(docs, odd):
    for df in (docs, odd):
        rows = [r.asDict() for r in df.select("doc_id", "source", "lang", "n_chars", "text").collect()]
        got = merkle_manifest(df)
        assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
        assert sorted(map(tuple, got.collect()), key=str) == plain_manifest(rows)
    assert merkle_manifest(odd.where("false")).count() == 0
    one = merkle_manifest(odd.where("doc_id = 3")).first()
    assert one.leaf == one.subroot == one.root and one.proof_sha256 == sha() and one.verified


def test_manifest_of_many_levels(spark):
    """5,000 rows of one source, one of another: four levels beside none."""
    rows = [dict(doc_id=k, source="big" if k else "small", lang="en", n_chars=k, text=f"Text {k % 7}") for k in range(5_001)]
    got = merkle_manifest(spark.createDataFrame([tuple(r.values()) for r in rows], "doc_id long, source string, lang string, n_chars long, text string"))
    assert sorted(map(tuple, got.collect()), key=str) == plain_manifest(rows)


def test_manifest_sees_changes(spark, docs):
    changed = docs.withColumn("lang", F.when(F.col("doc_id") == 0, "xx").otherwise(F.col("lang")))
    assert merkle_manifest(docs).first().root != merkle_manifest(changed).first().root
    assert merkle.leaf_digest([F.lit("1"), F.lit("2")]) is not None


def test_numbered_spreads_a_hot_group(spark):
    rows = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, "cold").otherwise("hot").alias("g"), F.xxhash64("id").alias("k"), "id")
    placed = numbered(rows, ["g"], ["k", "id"], "test")
    got = placed.collect()
    for g in ("hot", "cold"):
        own = sorted((r for r in got if r.g == g), key=lambda r: r.idx)
        assert [r.idx for r in own] == list(range(len(own))) and {r.n for r in own} == {len(own)}
        assert [r.k for r in own] == sorted(r.k for r in own)


def plain_fingerprint(text, n=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    runs = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))] if words else []
    h = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_groups(fps, radius=4):
    root = {k: k for k in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = list(fps)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if (a ^ b).bit_count() <= radius:
                root[find(a)] = find(b)
    return {k: find(k) for k in keys}


def test_fingerprints():
    for text in (None, "", "  ", "One", "a b c", "A B c D", "a b c d e\x0bf\x1cg é 日本 x y", "x y z w " * 70_000):
        assert fingerprint(text) == plain_fingerprint(text)


def test_simhash(spark, docs, odd):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(300)]
    base = [rng.choice(words) for _ in range(200)]
    near = [" ".join(base[:k] + [rng.choice(words)] + base[k + 1 :]) for k in range(0, 200, 4)]
    edited = spark.createDataFrame([(k, t) for k, t in enumerate(near)], "doc_id long, text string")
    for df in (docs, odd, edited):
        rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
        prints = [plain_fingerprint(t) for _, t in rows]
        root = plain_groups(dict.fromkeys(prints))
        least = {}
        for (i, _), p in zip(rows, prints, strict=True):
            if i is not None:
                least[root[p]] = min(i, least.get(root[p], i))
        want = sorted(((i, f"{p:016x}", least.get(root[p])) for (i, _), p in zip(rows, prints, strict=True)), key=str)
        got = simhash_groups(df)
        assert got.columns == ["doc_id", "fingerprint", "component_id"]
        assert sorted(map(tuple, got.collect()), key=str) == want
    assert len(set(root.values())) < len(root)
    assert simhash_groups(odd.where("false")).count() == 0


@pytest.mark.parametrize("tile", [8, 64])
def test_tiles_lose_no_link(spark, tile, monkeypatch):
    """Chains of four differing bits over many small tiles and blocks; a big group leaves few links."""
    ship(spark)
    monkeypatch.setattr(simhash, "_TILE", tile)
    monkeypatch.setattr(simhash, "_TILES", 2)
    rng = np.random.default_rng(3)
    fps = set(rng.integers(0, 1 << 63, 300).tolist())
    for start in list(fps)[:40]:
        for _ in range(6):
            for b in rng.choice(63, 4, replace=False):
                start ^= 1 << int(b)
            fps.add(start)
    fps |= {0, 1, 3, 7, 15, 31}
    found = links(spark.createDataFrame([(f,) for f in fps], "fp long"), 4)
    nodes = {int(simhash.mixed(np.array([f], np.uint64)).view(np.int64)[0]): f for f in fps}
    pairs = [(nodes[r.a], nodes[r.b]) for r in found.collect()]
    assert all(r != s for r, s in pairs)
    want, parent = plain_groups(fps), {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[find(a)] = find(b)
    assert len({(find(f), want[f]) for f in fps}) == len(set(want.values())) == len({find(f) for f in fps})


def test_links_of_a_group_grow_with_its_rows():
    fps = np.array([1 << a | 1 << b for a in range(40) for b in range(a)], np.uint64)
    one, other = linked([fps[:400], fps[400:]], None, 4)
    assert len(one) == len(fps) - 1 and set(other.tolist()) == {int(fps[0])}
    one, other = linked([fps[:1]], [fps[1:]], 4)
    assert len(one) == len(fps) - 1


def plain_words(rows):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    return {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}


def is_near(a, b):
    a, b = sorted((a, b), key=len)
    return a != b and (len(a) == len(b) and sum(x != y for x, y in zip(a, b, strict=True)) == 1 or len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b))))


def plain_forms(n, factor=5):
    out, form, by = [], {}, {}
    for w in n:
        by.setdefault(len(w), []).append(w)
    near = {w: [v for k in (-1, 0, 1) for v in by.get(len(w) + k, ()) if is_near(w, v)] for w in n}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= factor * n[w] else None
    for w in n:
        r = w
        while form[r] is not None:
            r = form[r]
        out.append((w, form[w], r, n[w], len(near[w]), n.get(form[w])))
    return sorted(out, key=str)


def test_spelling(spark, docs, odd):
    for df in (docs, odd):
        got = spelling_variants(df)
        assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
        assert sorted(map(tuple, got.collect()), key=str) == plain_forms(plain_words([(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]))
    assert spelling_variants(odd.where("false")).count() == 0


@pytest.mark.parametrize("cell", [3, 4096])
def test_spelling_of_words_close_together(spark, cell, monkeypatch):
    """Random words over three letters, chains of forms, and one long word with an accent; cells of any size."""
    ship(spark)
    monkeypatch.setattr(spelling, "_CELL", cell)
    rng = random.Random(11)
    n = {"".join(rng.choice("abé") for _ in range(rng.randint(6, 8))): 5 ** rng.randint(1, 6) for _ in range(400)}
    n |= {"chained": 5, "chaineds": 25, "chainedst": 125, "chinedst": 625, "x" * 5000: 5, "x" * 4999 + "y": 25, "xx" * 2500 + "z": 25}
    got = spelling_forms(spark.createDataFrame(list(n.items()), "word string, n long"))
    assert sorted(map(tuple, got.collect()), key=str) == plain_forms(n)


def test_each_pair_once(spark):
    words = ["aabaab", "aaabaab", "aabaaab", "aabab", "aababb", "abaaab"]
    got = [(r.a, r.b) for r in near_words(spark.createDataFrame([(w, 1) for w in words], "word string, n long")).collect()]
    assert len(got) == len({frozenset(p) for p in got}) and {frozenset(p) for p in got} == {frozenset((a, b)) for a in words for b in words if is_near(a, b)}


def test_one_edit():
    assert all(one_edit(*sorted((a, b), key=len)) == is_near(a, b) for a in ("abcdef", "abcdeg", "abcdefg", "xabcdef", "abdef", "bacdef") for b in ("abcdef", "abcdeg", "abcdefg", "xabcdef", "abdef", "bacdef"))
    assert list(pairs_of_cell(["abcdef", "abcdeg"], [0, 0], 6, "first", False)) == [(0, 1)]


@pytest.mark.parametrize("name", ["op11_merkle_manifest", "op13_spelling_variants"])
def test_against_sql(docs, name):
    found = {"op11_merkle_manifest": merkle_manifest, "op13_spelling_variants": spelling_variants}[name](docs)
    duckdb.execute(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{DIR}/documents.parquet'")
    want = duckdb.sql(f"SELECT {', '.join(found.columns)} FROM ({oracle.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str)


def test_scopes_remove_what_they_wrote(spark, tmp_path):
    from transitweave.llm.common import remove_written, scope, written

    outer = written(spark.range(3), "outer")
    with scope(spark, "family", "one"):
        inner = written(spark.range(4), "inner")
    with scope(spark, "family", "one"):
        again = written(spark.range(6), "again")
    assert (inner.count(), again.count()) == (4, 6)
    with scope(spark, "family", "two", inner.where("id > 0")):
        second = written(spark.range(5), "second")
    assert inner.count() == 4
    with scope(spark, "family", "three", second):
        pass
    assert outer.count() == 3 and second.count() == 5
    for gone in (inner, again):
        with pytest.raises(Exception, match="(?i)not.exist|not.found"):
            gone.count()
    remove_written(spark, of="family/")
    assert outer.count() == 3
