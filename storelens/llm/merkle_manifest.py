"""Operator 13, Merkle manifest of a dataset by checkpoint and recompute.

Rows are leaves, ordered by key within their group; ``ARITY`` neighbours make a
node of the next level until one, the group's subroot, is left; the subroots,
in the order of their groups, make the root likewise.  Only every ``STRIDE``-th
level is stored.  A proof is extracted by going down the stored levels: the
stored descendants of each aligned subtree are gathered (``ARITY ** STRIDE`` at
most), the levels between are made again from them, each descendant's siblings
are emitted and the rest is forgotten.

A group may hold any share of the rows: rows are ordered by a range exchange
over (group, key) and get their positions from counts per partition, and what
is gathered is an aligned subtree, never a group.  A proof is an array of
``struct(l, r)``, one per level from the leaf up: the digests of the siblings
to the left and to the right, concatenated.

Defined cases: a null field is the single character ``-``; a null group is a
group of its own, before all others; null keys come first; rows that repeat a
key are ordered by their leaf hash; a group of one row has its leaf as subroot;
an empty table has no rows and no root; other columns are never read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import ship, small, written

ARITY = 3
STRIDE = 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Blocks handed on at once by a worker.
_ROWS = 128
_PATH = "array<struct<l:string,r:string>>"


def field(value: Column) -> Column:
    """A field of a leaf: ``-`` if null, else UTF-8 bytes, ``:``, the value as text."""
    s = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf(fields: list[Column]) -> Column:
    return F.sha2(F.concat(*[field(c) for c in fields]), 256)


def group_name(group: Column) -> Column:
    """Never null, and ordered as the groups are: null first, then bytewise."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit("-"))


def digest(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def height(n: int, arity: int = ARITY) -> int:
    """Levels above n leaves until one node is left."""
    h = 0
    while arity**h < n:
        h += 1
    return h


def climb(nodes: list[str], steps: int, arity: int = ARITY) -> list[list[str]]:
    """The nodes and the levels above them."""
    out = [nodes]
    for _ in range(steps):
        below = out[-1]
        out.append([digest(below[i : i + arity]) for i in range(0, len(below), arity)])
    return out


def siblings(levels: list[list[str]], at: int, arity: int = ARITY) -> list[dict[str, str]]:
    """Left and right siblings of a node of the lowest level, level by level."""
    path = []
    for nodes in levels[:-1]:
        first = at - at % arity
        run = nodes[first : first + arity]
        path.append({"l": "".join(run[: at - first]), "r": "".join(run[at - first + 1 :])})
        at //= arity
    return path


def positions(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with ``idx``, the place within its group in this order, and
    ``n``, the group's rows.  No group is brought into one task: a partition's
    rows are numbered where they lie, and its first numbers follow from the
    partitions' counts (a row for each partition and group met there)."""
    by = [F.col(c).asc_nulls_first() for c in [group, *order]]
    laid = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id())
    laid = written(laid, "ordered-leaves")
    part = F.shiftright("_at", 33)
    counts = laid.groupBy(group, part.alias("_part")).agg(F.count(F.lit(1)).alias("_c"), F.min("_at").alias("_first"))
    whole = W.partitionBy(group)
    counts = counts.select(
        group,
        "_part",
        (F.sum("_c").over(whole.orderBy("_part")) - F.col("_c") - F.col("_first")).alias("_shift"),
        F.sum("_c").over(whole).alias("n"),
    )
    counts = small(written(counts, "partition-counts"))
    placed = laid.withColumn("_part", part).join(counts, [group, "_part"])
    return placed.withColumn("idx", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")


@dataclass(frozen=True)
class Tree:
    """The stored levels of the trees of all groups.

    ``stored[k]`` holds the nodes (grp, n, idx, sha) of level k * stride of the
    groups that have levels above it (``stored[0]``: all leaves, with whatever
    else they carry); ``roots``: grp, n, sha.
    """

    stored: list[DataFrame]
    roots: DataFrame
    arity: int
    stride: int

    def blocks(self, k: int, carried: list[str]) -> DataFrame:
        """grp, block, n, m: the aligned subtrees of a stored level, their
        members in order; alike partitioned for a join by (grp, block)."""
        width, base = self.arity**self.stride, self.arity ** (k * self.stride)
        rows = self.stored[k].where(F.col("n") > base)
        members = F.sort_array(F.collect_list(F.struct("idx", "sha", *carried)))
        return rows.groupBy("grp", F.expr(f"idx div {width}").alias("block")).agg(F.first("n").alias("n"), members.alias("m"))


def build(leaves: DataFrame, arity: int = ARITY, stride: int = STRIDE) -> Tree:
    """The trees over leaves (grp, n, idx, sha): each pass climbs ``stride``
    levels within aligned subtrees and stores the level it ends at."""
    ship(leaves.sparkSession)
    most = leaves.agg(F.max("n")).first()[0] or 0
    roots = [leaves.where("n = 1").select("grp", "n", "sha")]
    tree = Tree([leaves], roots[0], arity, stride)

    def climbed(base: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                tops = [climb([x["sha"] for x in m], min(stride, height(n, arity) - base), arity)[-1][0] for n, m in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(1), pa.array(tops, pa.string())], names=["grp", "n", "idx", "sha"])

        return run

    for k in range(-(-height(most, arity) // stride)):
        nodes = tree.blocks(k, []).mapInArrow(climbed(k * stride), "grp string, n bigint, idx bigint, sha string")
        nodes = written(nodes, "stored-level")
        done = F.col("n") <= arity ** ((k + 1) * stride)
        roots.append(nodes.where(done).select("grp", "n", "sha"))
        tree.stored.append(nodes.where(~done))
    whole = roots[0]
    for r in roots[1:]:
        whole = whole.unionByName(r)
    return Tree(tree.stored, whole, arity, stride)


def extract(tree: Tree, upper: DataFrame, carried: list[str]) -> DataFrame:
    """grp, idx, sha, subroot, path and the carried columns of every leaf.
    ``upper`` continues the paths above the groups' roots: grp, path."""
    arity, stride = tree.arity, tree.stride
    tops = tree.roots.join(upper, "grp").select("grp", "n", F.lit(0).cast("bigint").alias("idx"), F.col("sha").alias("subroot"), "path")
    tops = written(tops, "paths-above-groups")

    def emitted(base: int, kinds: dict[str, pa.DataType]):
        member = pa.list_(pa.struct([*kinds.items(), ("path", pa.list_(pa.struct([("l", pa.string()), ("r", pa.string())])))]))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for lo in range(0, len(whole), _ROWS):
                    b = whole.slice(lo, _ROWS)
                    n, out = b.column(b.schema.get_field_index("n")).to_pylist(), []
                    for size, m in zip(n, b.column(b.schema.get_field_index("m")).to_pylist(), strict=True):
                        levels = climb([x["sha"] for x in m], min(stride, height(size, arity) - base), arity)
                        out.append([{**x, "path": siblings(levels, i, arity)} for i, x in enumerate(m)])
                    keep = [b.column(b.schema.get_field_index(c)) for c in ("grp", "n", "subroot", "path")]
                    yield pa.RecordBatch.from_arrays([*keep, pa.array(out, member)], names=["grp", "n", "subroot", "path", "m"])

        return run

    above = None
    for k in range(len(tree.stored) - 2, -1, -1):
        base, extra = k * stride, carried if k == 0 else []
        begin = tops.where((F.col("n") > arity**base) & (F.col("n") <= arity ** (base + stride))).drop("n")
        above = begin if above is None else above.unionByName(begin)
        blocks = tree.blocks(k, extra).join(above.withColumnRenamed("idx", "block"), ["grp", "block"])
        schema = tree.stored[k].select("idx", "sha", *extra).schema
        kinds = {f.name: to_arrow_type(f.dataType) for f in schema.fields}
        listed = ", ".join(f"{f.name}:{f.dataType.simpleString()}" for f in schema.fields)
        nodes = blocks.select("grp", "n", "subroot", "path", "m").mapInArrow(
            emitted(base, kinds), f"grp string, n bigint, subroot string, path {_PATH}, m array<struct<{listed},path:{_PATH}>>"
        )
        nodes = nodes.select("grp", "subroot", F.col("path").alias("_up"), F.explode("m").alias("m"))
        above = nodes.select("grp", "subroot", *[f"m.{c}" for c in schema.names], F.concat("m.path", "_up").alias("path"))
        if k:
            above = written(above.select("grp", "idx", "subroot", "path"), "paths-above-level")
    lone = tree.stored[0].where("n = 1").join(tops.where("n = 1").select("grp", "subroot", "path"), "grp")
    lone = lone.select("grp", "subroot", "idx", "sha", *carried, "path")
    return lone if above is None else above.unionByName(lone)


@dataclass(frozen=True)
class Manifest:
    """``groups``: the trees of the groups; ``top``: the tree over their subroots; ``root``: its root (none without rows)."""

    groups: Tree
    top: Tree
    root: str | None


def manifest(leaves: DataFrame, order: list[str], arity: int = ARITY, stride: int = STRIDE) -> Manifest:
    """The manifest of leaves: grp (see ``group_name``), sha, the columns of
    ``order`` and others that proofs shall carry."""
    groups = build(positions(leaves, "grp", order), arity, stride)
    roots = groups.roots.select(F.lit("all").alias("grp"), F.col("grp").alias("name"), "sha")
    top = build(positions(roots, "grp", ["name"]), arity, stride)
    root = top.roots.first()
    return Manifest(groups, top, root["sha"] if root else None)


def proofs(m: Manifest, carried: list[str]) -> DataFrame:
    """grp, idx, sha, subroot, path (to the root) and the carried columns of every leaf."""
    start = m.top.roots.select("grp", F.array().cast(_PATH).alias("path"))
    upper = extract(m.top, start, ["name"]).select(F.col("name").alias("grp"), "path")
    return extract(m.groups, upper, carried)


def proof_digest(path: Column) -> Column:
    """Hash of all siblings of a path, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["l"], s["r"])), ""), 256)


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and a path give."""
    return F.aggregate(path, start, lambda h, s: F.sha2(F.concat(s["l"], h, s["r"]), 256))


def tampering_drill(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, leaf, subroot, root, proof_sha256,
    folded_root and verified, after the line feeds of the documents with an
    even crc32 of their id were deleted behind the manifest's back."""
    fields = [F.col(c) for c in FIELDS]
    cut = F.regexp_replace("text", "\n", "")
    hit = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0) & F.col("text").contains("\n")
    changed = F.when(hit, leaf([*fields[:-1], cut]))
    leaves = docs.select(
        "doc_id", group_name(F.col("source")).alias("grp"), leaf(fields).alias("sha"), changed.alias("changed"), F.monotonically_increasing_id().alias("_n")
    )
    m = manifest(written(leaves, "leaves"), ["doc_id", "sha", "_n"])
    p = proofs(m, ["doc_id", "changed"])
    p = p.withColumn("folded_root", folded(F.coalesce("changed", "sha"), F.col("path")))
    return p.select(
        "doc_id",
        F.col("sha").alias("leaf"),
        "subroot",
        F.lit(m.root).alias("root"),
        proof_digest(F.col("path")).alias("proof_sha256"),
        "folded_root",
        (F.col("folded_root") == F.lit(m.root)).alias("verified"),
    )
