"""Mixing sources to target weights: budgets flow down a tree of groups; each leaf gives a token-prefix of seeded epochs. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import all_of, let, without, words, written

#: Leaves that are broadcast at most (about 200 bytes each); beyond it the join is by shuffle, which AQE splits where a leaf is hot.
MAX_BROADCAST_LEAVES = 50_000
#: Documents of one leaf whose running sum one task takes, on average.
DOCS_PER_BUCKET = 2_000


def token_count(text: Column) -> Column:
    """Words of a text, as its length in tokens; 0 for a null."""
    return F.size(words(text)).cast("long")


def _order(key: str, epoch: Column, seed: str) -> Column:
    """A seeded place in an epoch: 32 hex digits."""
    return F.md5(F.concat(F.lit(f"{seed}:"), epoch.cast("string"), F.lit(":"), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary"))


def _weight(levels: list[str], weights: Mapping[tuple[str, ...], int]) -> Column:
    """The weight of the node that ``levels`` name; 1 where none is given."""
    out = F.lit(1)
    for path, w in weights.items():
        if len(path) == len(levels):
            same = F.lit(True)
            for c, v in zip(levels, path, strict=True):
                same = same & (F.col(c) == F.lit(v))
            out = F.when(same, F.lit(int(w))).otherwise(out)
    return out.cast("long")


def allocate(leaves: DataFrame, levels: list[str], weights: Mapping[tuple[str, ...], int], budget: Column) -> DataFrame:
    """``leaves`` (``levels``, ``cap``) with ``budget``, the tokens that each may give.

    From the root down, a node's budget is shared among its children by weight. A child whose whole subtree holds less than its
    share takes all it holds, and what it leaves goes to its siblings by their weights; only what a whole family can't hold reaches
    the level above. Children are sorted by capacity for each unit of weight, so the full ones are a prefix that running
    sums find; shares are whole tokens, rounded down. The sums run over groups, never over documents.
    """
    total = leaves.agg(F.sum("cap").alias("cap")).select(F.least(F.col("cap"), budget).cast("decimal(20,0)").alias("b"))
    node = None
    for depth in range(1, len(levels) + 1):
        own, parent = levels[:depth], levels[: depth - 1]
        here = leaves.groupBy(*own).agg(F.sum("cap").cast("decimal(20,0)").alias("c")).withColumn("w", _weight(own, weights).cast("decimal(10,0)"))
        here = here.join(F.broadcast(total)) if node is None else here.join(node, parent)
        family = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
        before = family.orderBy((F.col("c").cast("double") / F.col("w").cast("double")).asc(), *own).rowsBetween(Window.unboundedPreceding, -1)
        zero = F.lit(0).cast("decimal(20,0)")
        here = (
            here.withColumn("left_b", F.col("b") - F.coalesce(F.sum("c").over(before), zero).cast("decimal(20,0)"))
            .withColumn("left_w", (F.sum("w").over(family) - F.coalesce(F.sum("w").over(before), zero)).cast("decimal(18,0)"))
            .withColumn("full", F.expr("c * left_w <= w * left_b"))
            .withColumn("rest_b", (F.col("b") - F.coalesce(F.sum(F.when(F.col("full"), F.col("c"))).over(family), zero)).cast("decimal(20,0)"))
            .withColumn("rest_w", F.coalesce(F.sum(F.when(~F.col("full"), F.col("w"))).over(family), zero).cast("decimal(18,0)"))
            .withColumn("share", F.expr("case when full then c else cast((w * rest_b) div rest_w as decimal(20,0)) end"))
        )
        node = here.select(*own, F.col("share").alias("b"))
    return leaves.join(node, levels).withColumn("budget", F.col("b").cast("long")).drop("b")


def mix(
    docs: DataFrame,
    levels: list[str],
    weights: Mapping[tuple[str, ...], int],
    budget: int | None = None,
    budget_pct: int = 50,
    max_epochs: int = 4,
    seed: str = "mix",
    key: str = "doc_id",
    tokens: Column | None = None,
) -> DataFrame:
    """Documents chosen so that groups reach their target weights: ``docs`` with ``epoch`` (int), a row for each time one is used.

    ``levels`` are columns from the root of the tree down, such as domain, language and source; ``weights`` gives node paths their
    weight, 1 where none is given. The budget is ``budget`` tokens, else ``budget_pct`` percent of all; a leaf offers its
    documents ``max_epochs`` times at most. A leaf's budget covers whole epochs first; of the next epoch it takes
    documents in a seeded order while their running sum stays within what remains.

    A null level counts as the empty string; the column itself passes through unchanged, as do others, and an input column
    ``epoch`` is replaced. Rows of equal ``key`` share a place in the order and are taken together or not at all. Documents
    without a token cost nothing and go along. An empty table gives an empty result.

    One pass counts tokens into a narrow table. Running sums go over buckets of about ``DOCS_PER_BUCKET`` documents, and over single
    documents only in the bucket where a leaf's budget ends, so a leaf with a third of all rows is no one's task. What
    is broadcast is one row a leaf, its count checked. ``docs`` itself is filtered where it lies: no text is shuffled.
    """
    docs = without(docs, ["epoch"])
    tokens = token_count(F.col("text")) if tokens is None else tokens
    names = [f"__l{i}" for i in range(len(levels))]
    marked = docs.withColumns({n: F.coalesce(F.col(c).cast("string"), F.lit("")) for n, c in zip(names, levels, strict=True)})
    slim = written(marked.select(F.col(key).alias("__key"), *names, tokens.alias("__t")), "mix-sizes")
    leaves = slim.groupBy(*names).agg(F.sum("__t").alias("t"), F.count("*").alias("n")).withColumn("cap", F.col("t") * max_epochs)
    leaves = written(leaves, "mix-leaves")
    if budget is None:
        budget = int(leaves.agg(F.sum("t")).first()[0] or 0) * budget_pct // 100
    given = (
        allocate(leaves, names, weights, F.lit(budget))
        .withColumn("epochs", F.expr("case when t = 0 then 0 else budget div t end"))
        .withColumn("rest", F.col("budget") - F.col("epochs") * F.col("t"))
        .withColumn("buckets", F.expr(f"(n + {DOCS_PER_BUCKET - 1}) div {DOCS_PER_BUCKET}"))
        .select(*names, "epochs", "rest", "buckets")
    )
    given = written(given, "mix-budgets")
    few = given.count() <= MAX_BROADCAST_LEAVES
    small = F.broadcast if few else (lambda df: df)

    # the running sum: over buckets first, then inside the bucket where the rest ends
    placed = (
        slim.join(small(given.filter("rest > 0")), names)
        .withColumn("__key_s", F.col("__key").cast("string"))
        .withColumn("u", _order("__key", F.col("epochs"), seed))
        .withColumn("bucket", F.expr("cast(conv(substring(u, 1, 8), 16, 10) as bigint) * buckets div 4294967296"))
    )
    sums = placed.groupBy(*names, "bucket").agg(F.sum("__t").alias("s"), F.first("rest").alias("rest"))
    running = Window.partitionBy(*names).orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = sums.withColumn("before", F.sum("s").over(running) - F.col("s")).filter("before <= rest and before + s > rest").select(*names, "bucket", "before")
    inside = placed.join(small(ends), [*names, "bucket"])
    peers = Window.partitionBy(*names, "bucket").orderBy("u").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    last = (
        inside.withColumn("sum", F.col("before") + F.sum("__t").over(peers))
        .filter("sum <= rest")
        .groupBy(*names)
        .agg(F.max("u").alias("last"))
    )
    # up to which place of the order: the last that fits, else all buckets before the one where the rest ends
    cuts = given.join(ends.withColumnRenamed("bucket", "end"), names, "left").join(last, names, "left").select(*names, "epochs", "buckets", "rest", "end", "last")
    cuts = written(cuts, "mix-cuts")

    u = _order(key, F.col("epochs"), seed)
    chosen = marked.join(small(cuts), names).withColumn(
        "__times",
        let(
            u,
            lambda x: F.when(F.col("rest") <= 0, F.lit(0))
            .when(F.col("end").isNull(), F.lit(1))
            .when((F.conv(F.substring(x, 1, 8), 16, 10).cast("long") * F.col("buckets") / F.lit(4294967296)).cast("long") < F.col("end"), F.lit(1))
            .when(x <= F.col("last"), F.lit(1))
            .otherwise(F.lit(0)),
        )
        + F.col("epochs"),
    )
    return chosen.filter("__times > 0").select(*all_of(docs), F.explode(F.sequence(F.lit(0), (F.col("__times") - 1).cast("int"))).alias("epoch"))
