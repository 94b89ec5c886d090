"""A Merkle manifest of a dataset: roots that commit to all rows, and a proof for each row.

Bottom up: nodes of a level are grouped into runs of 16 neighbours, a run's
digest is a node of the next level, and each level is written. Top down: a level
is joined with the proofs of its parents; each child puts its siblings in front
of what its parent hands down, so that no row walks the tree by itself. A
level has a sixteenth of the rows of the one below; nothing comes to the driver
but the size of the largest group.
"""

from __future__ import annotations

from dataclasses import dataclass
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written
from .order import numbered

FAN = 16
LEAF_COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
_GROUP = ["known", "source"]  # a source that is null comes before all others
_PROOF = "array<struct<left:binary,right:binary>>"


def _hex(b: Column) -> Column:
    return F.lower(F.hex(b))


def _digest(hex_text: Column) -> Column:
    """SHA-256 of a text, 32 bytes."""
    return F.unhex(F.sha2(hex_text.cast("binary"), 256))


def leaf_digest(columns: list[Column]) -> Column:
    """SHA-256 of values, each as its UTF-8 byte count, a colon and itself, or `-` if null: no two rows give one input."""
    framed = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in columns]
    return _digest(F.concat(*framed))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, ascii_uppercase, ascii_lowercase)


@dataclass
class Tree:
    """Written levels: row = a run of up to 16 nodes (group, n nodes of the level, up = place of the run, kids, whole = their digests in a row, digest)."""

    group: list[str]
    levels: list[DataFrame]

    def tops(self) -> DataFrame:
        """The group and its topmost digest, a row for each group."""
        found = [runs.where(F.col("n") <= FAN).select(*self.group, "digest") for runs in self.levels]
        out = found[0]
        for more in found[1:]:
            out = out.unionByName(more)
        return out


def build(nodes: DataFrame, group: list[str], payload: list[str], name: str) -> Tree:
    """The levels over nodes (group, idx, n, digest and payload); a lone node is its group's top as it is."""

    def runs_of(level: DataFrame, extra: list[str], k: int) -> DataFrame:
        runs = level.groupBy(*group, "n", F.expr(f"idx div {FAN}").alias("up")).agg(F.array_sort(F.collect_list(F.struct("idx", "digest", *extra))).alias("kids"))
        runs = runs.withColumn("whole", F.unhex(F.array_join(F.transform("kids", lambda x: F.hex(x["digest"])), "")))
        return written(runs.withColumn("digest", F.when(F.col("n") == 1, F.col("whole")).otherwise(_digest(_hex(F.col("whole"))))), f"{name}-level-{k}")

    levels = [runs_of(nodes, payload, 0)]
    most = levels[0].agg(F.max("n")).first()[0] or 0
    while most > FAN:
        most = -(-most // FAN)
        below = levels[-1].where(F.col("n") > FAN).select(*group, F.col("up").alias("idx"), F.ceil(F.col("n") / FAN).cast("long").alias("n"), "digest")
        levels.append(runs_of(below, [], len(levels)))
    return Tree(group, levels)


def push(tree: Tree, start: DataFrame, carried: list[str], payload: list[str], name: str) -> DataFrame:
    """Hands `start` (group, proof and carried) down the tree: a row for each node of the lowest level, with its digest and payload.

    proof has an entry for each run on the way up that has more than one level
    to itself: the digests left and right of the node, 32 bytes each.
    """
    above = None
    for k in reversed(range(len(tree.levels))):
        runs = tree.levels[k]
        tops = runs.where(F.col("n") <= FAN)
        own = tops.join(start, tree.group)
        if above is not None:
            own = own.unionByName(runs.where(F.col("n") > FAN).join(above, [*tree.group, "up"]), allowMissingColumns=True)
        kids = own.select(*tree.group, "n", "whole", "proof", *carried, F.posexplode("kids").alias("pos", "kid"))
        beside = F.struct(F.expr("substring(whole, 1, 32 * pos)").alias("left"), F.expr("substring(whole, 32 * pos + 33)").alias("right"))
        proof = F.when(F.col("n") == 1, F.col("proof")).otherwise(F.concat(F.array(beside), F.col("proof"))).alias("proof")
        if k:
            above = written(kids.select(*tree.group, F.col("kid.idx").alias("up"), proof, *carried), f"{name}-proofs-{k}")
    return kids.select(*tree.group, F.col("kid.digest").alias("digest"), *(F.col(f"kid.{c}").alias(c) for c in payload), proof, *carried)


def proof_digest(proof: Column) -> Column:
    """SHA-256 of the siblings' digests as hex text, left to right, from the leaf up."""
    return F.sha2(F.array_join(F.transform(proof, lambda p: _hex(F.concat(p["left"], p["right"]))), "").cast("binary"), 256)


def folded(leaf: Column, proof: Column) -> Column:
    """The root, as hex text, that a leaf's digest and a proof lead to."""
    return F.aggregate(proof, _hex(leaf), lambda acc, p: F.sha2(F.concat(_hex(p["left"]), acc, _hex(p["right"])).cast("binary"), 256))


def merkle_proofs(leaves: DataFrame, order: list[str], payload: list[str]) -> DataFrame:
    """For leaves (source, digest, order, payload): source, digest, payload, proof, subroot of the source and root of all, as bytes.

    Leaves of a source stand by `order`, which should tell rows apart; sources bytewise, null first.
    An empty table has no root and gives no rows.
    """
    keyed = leaves.withColumns({"known": F.col("source").isNotNull(), "source": F.coalesce("source", F.lit(""))})
    below = build(numbered(keyed, _GROUP, order, "merkle"), _GROUP, payload, "merkle")
    subroots = written(below.tops().withColumn("all", F.lit(0)), "merkle-subroots")
    above = build(numbered(subroots, ["all"], _GROUP, "merkle-top"), ["all"], _GROUP, "merkle-top")
    root = above.tops().select("all", F.col("digest").alias("root"), F.array().cast(_PROOF).alias("proof"))
    start = written(push(above, root, ["root"], _GROUP, "merkle-top").drop("all").withColumnRenamed("digest", "subroot"), "merkle-start")
    return push(below, start, ["subroot", "root"], payload, "merkle").withColumn("source", F.when(F.col("known"), F.col("source"))).drop("known")


def merkle_manifest(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    The first six are of docs as they are. folded_root comes from the proof and the leaf of a row that may
    have been tampered with: where 5 divides the CRC-32 of the decimal id, A-Z
    in the text are lower-cased. verified says whether it is the root; it holds for a
    tampered text without A-Z. Rows with null ids come first in their source and are never
    tampered with; equal ids stand by their leaf's digest, and rows that
    are wholly equal share a digest, so their order shows in their proofs only. Null and
    empty texts differ. Other columns are not read. Very long texts are
    hashed whole. An empty table gives no rows.
    """
    plain = docs.select(*(docs[c].alias(c) for c in LEAF_COLUMNS))
    text = F.col("text")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, leaf_digest([lower_ascii(text) if c == "text" else F.col(c) for c in LEAF_COLUMNS]))
    leaves = written(plain.select("doc_id", "source", leaf_digest([F.col(c) for c in LEAF_COLUMNS]).alias("digest"), tampered.alias("tampered"), F.monotonically_increasing_id().alias("row")), "merkle-leaves")
    proven = merkle_proofs(leaves, ["doc_id", "digest", "row"], ["doc_id", "tampered"])
    out = proven.select("doc_id", _hex(F.col("digest")).alias("leaf"), _hex(F.col("subroot")).alias("subroot"), _hex(F.col("root")).alias("root"), proof_digest(F.col("proof")).alias("proof_sha256"), folded(F.coalesce("tampered", "digest"), F.col("proof")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
