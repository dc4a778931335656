"""A Merkle manifest of a dataset: trees of digests, proofs, and versions that share all nodes but the copied path."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import ship
from .common import Tables, quoted

#: Nodes under one parent.
FANOUT = 3
#: Levels of a block, which one task builds: 729 leaves at three to a parent.
BLOCK_LEVELS = 6
_STEPS = "array<struct<before:string,after:string>>"


def digest(parts: Iterable[str]) -> str:
    """The SHA-256 of strings behind each other, as lowercase hex text."""
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def height(n: int, fanout: int = FANOUT) -> int:
    """Levels above ``n`` nodes until one is left."""
    levels = 0
    while n > 1:
        n, levels = -(-n // fanout), levels + 1
    return levels


def leaf_digest(values: Iterable[Column]) -> Column:
    """A row's digest: each value as its size in bytes, a colon and its text, a null as a hyphen."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


class Block:
    """A persistent tree over some neighbouring nodes: nodes are never changed, a version adds copies of one leaf's ancestors."""

    def __init__(self, leaves: list[str], levels: int, fanout: int = FANOUT):
        self.fanout, self.levels = fanout, [leaves]
        for _ in range(levels):
            low = self.levels[-1]
            self.levels.append([digest(low[i : i + fanout]) for i in range(0, len(low), fanout)])

    @property
    def top(self) -> str:
        return self.levels[-1][0]

    def steps(self, leaf: int) -> list[tuple[str, str]]:
        """From a leaf to the top, the siblings before and behind each node, behind each other."""
        out = []
        for low in self.levels[:-1]:
            start = leaf - leaf % self.fanout
            out.append(("".join(low[start:leaf]), "".join(low[leaf + 1 : start + self.fanout])))
            leaf //= self.fanout
        return out


def version(leaf: str, steps: list[tuple[str, str]]) -> list[str]:
    """The nodes that a version with another leaf has of its own: the leaf and its ancestors; all others are shared."""
    path = [leaf]
    for before, after in steps:
        path.append(digest((before, path[-1], after)))
    return path


def _placed(tables: Tables, rows: DataFrame, tree: Column, order: list[Column], name: str) -> DataFrame:
    """Written ``rows`` with ``__tree``, their place in it (``__i``, from 0, by ``order``) and its size (``__n``).

    Rows are dealt out by ranges of the whole order and their file positions, so that neither a large tree nor equal rows meet in
    one task; a range's offset in its tree is a sum over ranges, of which there are as many as partitions.
    """
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    by = [F.col("__tree"), *order, F.col("__file"), F.col("__row")]
    at = rows.withColumns({"__tree": tree, "__file": F.col("_metadata.file_name"), "__row": F.col("_metadata.row_index")})
    ranged = at.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumn("__p", F.monotonically_increasing_id())
    ranged = tables.written(ranged.drop("__file", "__row").withColumn("__part", F.shiftright("__p", 33)), name)
    whole = Window.partitionBy("__tree")
    before = whole.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranged.groupBy("__tree", "__part").agg(F.min("__p").alias("__first"), F.count("*").alias("__count"))
    ranges = ranges.withColumns({"__base": F.coalesce(F.sum("__count").over(before), F.lit(0)), "__n": F.sum("__count").over(whole)})
    found = ranged.join(ranges.drop("__count"), ["__tree", "__part"])
    return found.withColumn("__i", F.col("__base") + F.col("__p") - F.col("__first")).drop("__base", "__first", "__p", "__part")


def _block(rows: pa.Table, up: pa.Table, fanout: int, levels: int) -> tuple[pa.Table, Block, list[tuple[str, str]]]:
    """The nodes of a block in order, their tree, and the steps from its top to the root."""
    rows = rows.sort_by("__i")
    block = Block(rows["__digest"].to_pylist(), min(levels, height(rows["__n"][0].as_py(), fanout)), fanout)
    return rows, block, [(s["before"], s["after"]) for s in up["__above"][0].as_py()]


def _in_blocks(nodes: DataFrame, fanout: int, levels: int):
    return nodes.withColumn("__block", (F.col("__i") / fanout**levels).cast("long")).groupBy("__tree", "__block")


def _carried(nodes: DataFrame, above: DataFrame, fanout: int, levels: int) -> DataFrame:
    """The steps of every node to the root, from those of its block: ``__tree, __name, __block`` (the node's place), ``__above, __subroot, __root``."""

    def carry(key: tuple, rows: pa.Table, up: pa.Table) -> pa.Table:
        rows, block, rest = _block(rows, up, fanout, levels)
        steps = [[{"before": a, "after": b} for a, b in block.steps(i) + rest] for i in range(len(rows))]
        kind = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))
        same = {c: pa.array([up[c][0].as_py()] * len(rows), pa.string()) for c in ("__subroot", "__root")}
        return pa.table({"__tree": rows["__tree"], "__name": rows["__name"], "__block": rows["__i"], "__above": pa.array(steps, kind)} | same)

    schema = f"__tree string, __name string, __block bigint, __above {_STEPS}, __subroot string, __root string"
    return _in_blocks(nodes, fanout, levels).cogroup(above.groupBy("__tree", "__block")).applyInArrow(carry, schema)


def _climb(tables: Tables, nodes: DataFrame, fanout: int, levels: int, finish: Callable[[DataFrame], DataFrame] | None) -> DataFrame:
    """For every block of ``nodes`` (``__tree, __i, __n, __digest``) its top's steps to the root: ``__tree, __block, __above, __subroot, __root``.

    Blocks are aligned runs of ``fanout ** levels`` nodes; their tops are the nodes of the next round, until every tree is one block.
    ``finish`` then carries the trees' roots on (``__tree, __digest`` to ``__tree, __above, __root``); without it, they are the root.
    """
    size = fanout**levels

    def top(key: tuple, rows: pa.Table) -> pa.Table:
        n = rows["__n"][0].as_py()
        block = Block(rows.sort_by("__i")["__digest"].to_pylist(), min(levels, height(n, fanout)), fanout)
        return pa.table({"__tree": [key[0].as_py()], "__i": [key[1].as_py()], "__n": [-(-n // size)], "__digest": [block.top]})

    found = _in_blocks(nodes.select("__tree", "__i", "__n", "__digest"), fanout, levels).applyInArrow(top, "__tree string, __i bigint, __n bigint, __digest string")
    tops = tables.written(found, "merkle-tops")
    if (tops.agg(F.max("__n")).first()[0] or 1) > 1:  # one number
        above = _climb(tables, tops, fanout, levels, finish)
        return tables.written(_carried(tops.withColumn("__name", F.lit(None).cast("string")), above, fanout, levels).drop("__name"), "merkle-above")
    if finish is None:
        end = tops.withColumns({"__above": F.array().cast(_STEPS), "__root": F.col("__digest")})
    else:
        end = tops.join(finish(tops.select("__tree", "__digest")), "__tree")
    return end.select("__tree", F.col("__i").alias("__block"), "__above", F.col("__digest").alias("__subroot"), "__root")


def manifest(docs: DataFrame, fields: list[str], group: str = "source", order: str = "doc_id", changed: dict[str, Column] | None = None, fanout: int = FANOUT, levels: int = BLOCK_LEVELS) -> DataFrame:
    """Every row of ``docs`` as a leaf of its group's tree, whose roots in turn are leaves of one tree over all groups.

    A leaf is the digest of the row's ``fields``. In each group, leaves ascend by ``order`` (a string, by its bytes; nulls first;
    equal ones by their digests); runs of ``fanout`` neighbours become their digest, a shorter last run too, until one is left.
    Groups ascend in the same way, a null group first. ``changed`` gives other values for some fields: each row for which they make
    another leaf is a version of the tree of its own, in which only that leaf is changed.

    Returns ``order`` and ``group`` (other columns do not pass), ``leaf``, ``subroot``, ``root``; ``siblings`` (array of
    digests): the others of each run from the leaf to the root, left to right; ``copied`` (array of digests): the changed leaf and
    its ancestors up to the root, which are all nodes that the row's version does not share, empty where nothing is changed; and
    ``folded_root``: the root computed from the row's leaf, changed if it is, and its siblings. Repeated rows are leaves each. A
    single leaf in a single group is the root and has no siblings. An empty table gives no row.

    Texts are hashed where they are read; only digests are shuffled. A task builds aligned blocks of ``fanout ** levels`` leaves:
    first their tops, from which the upper levels follow in the same way, then, with a block's steps above it, its proofs and
    versions. So a group of any size is spread over tasks, and no level meets in one.
    """
    spark = docs.sparkSession
    ship(spark)
    if {group.lower(), order.lower()} & {"leaf", "subroot", "root", "siblings", "copied", "folded_root"}:
        raise ValueError("group and order need names other than those of the result")
    now = [F.col(quoted(f)) for f in fields]
    then = [(changed or {}).get(f, c) for f, c in zip(fields, now, strict=True)]
    leaf, other = leaf_digest(now), leaf_digest(then)
    keys = {"__order": F.col(quoted(order)), "__group": F.col(quoted(group))}
    tables = Tables(spark)  # the result is lazy and reads them, so they stay
    leaves = tables.written(docs.select(*[c.alias(k) for k, c in keys.items()], leaf.alias("__digest"), F.nullif(other, leaf).alias("__other")), "merkle-leaves")
    tree = F.coalesce(F.concat(F.lit("+"), F.col("__group").cast("string")), F.lit("-"))
    by = [F.col("__order").asc_nulls_first(), F.col("__digest"), F.col("__other")]
    placed = tables.written(_placed(tables, leaves, tree, by, "merkle-ranges"), "merkle-placed")

    def over_groups(roots: DataFrame) -> DataFrame:
        name = F.when(F.col("__tree") != "-", F.expr("substring(__tree, 2)"))
        named = tables.written(roots.select(F.col("__tree").alias("__name"), name.alias("__order"), "__digest"), "merkle-groups")
        spots = tables.written(_placed(tables, named, F.lit(""), [F.col("__order").asc_nulls_first()], "merkle-group-ranges"), "merkle-group-places")
        carried = _carried(spots, _climb(tables, spots, fanout, levels, None), fanout, levels)
        return tables.written(carried.select(F.col("__name").alias("__tree"), "__above", "__root"), "merkle-group-steps")

    above = _climb(tables, placed, fanout, levels, over_groups)
    kinds = dict(leaves.dtypes)

    def proven(key: tuple, rows: pa.Table, up: pa.Table) -> pa.Table:
        rows, block, rest = _block(rows, up, fanout, levels)
        siblings, copied, folded = [], [], []
        for i, (own, new) in enumerate(zip(block.levels[0], rows["__other"].to_pylist(), strict=True)):
            steps = block.steps(i) + rest
            siblings.append([s[k : k + 64] for pair in steps for s in pair for k in range(0, len(s), 64)])
            path = version(new or own, steps)
            copied.append(path if new else [])
            folded.append(path[-1])
        same = {c: pa.array([up[c][0].as_py()] * len(rows), pa.string()) for c in ("__subroot", "__root")}
        many = pa.list_(pa.string())
        columns = [rows["__order"], rows["__group"], rows["__digest"], same["__subroot"], same["__root"], pa.array(siblings, many), pa.array(copied, many), pa.array(folded, pa.string())]
        return pa.table(columns, names=names)

    names = ["__order", "__group", "leaf", "subroot", "root", "siblings", "copied", "folded_root"]
    schema = f"__order {kinds['__order']}, __group {kinds['__group']}, leaf string, subroot string, root string, siblings array<string>, copied array<string>, folded_root string"
    found = _in_blocks(placed, fanout, levels).cogroup(above.groupBy("__tree", "__block")).applyInArrow(proven, schema)
    return found.withColumnsRenamed({"__order": order, "__group": group})
