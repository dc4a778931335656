"""Hard negatives for given anchors: exact scores where bounds along a spanning tree of the anchors leave a doubt."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..runtime import ship
from .common import Tables, fresh_path, quoted

#: Anchors of one pass at most, and bytes of their vectors at most; a pass reads all rows.
ANCHORS, ANCHOR_BYTES = 4096, 32_000_000
#: Rows that a task compares at a time.
CHUNK = 4096
_CODE_BITS = 16


class Tree:
    """A spanning tree over anchors, parents before children; ``edge`` is each anchor's distance from its parent (root: parent -1)."""

    def __init__(self, vectors: np.ndarray, parent: np.ndarray, edge: np.ndarray):
        self.vectors, self.parent, self.edge = vectors, parent, edge
        self.last = np.full(len(parent), -1)
        self.last[parent[1:]] = np.arange(1, len(parent))  # of each parent, its last child

    @classmethod
    def grown(cls, vectors: np.ndarray) -> tuple[Tree, np.ndarray]:
        """The minimum spanning tree, grown from the anchor nearest the mean; also the order in which it holds the given vectors."""
        n, exact = len(vectors), vectors.astype(np.float64)
        squares = (exact**2).sum(1)
        root = at = int(((exact - exact.mean(0)) ** 2).sum(1).argmin())
        far, near, children = np.full(n, np.inf), np.full(n, -1), [[] for _ in range(n)]
        outside = np.ones(n, dtype=bool)
        outside[root] = False
        for _ in range(n - 1):
            d = squares + squares[at] - 2 * (exact @ exact[at])
            closer = (d < far) & outside
            far[closer], near[closer] = d[closer], at
            at = int(np.where(outside, far, np.inf).argmin())
            outside[at] = False
            children[near[at]].append(at)
        order, stack = [], [root]
        while stack:  # a whole branch before the next, so that few bounds are held
            order.append(stack.pop())
            stack += children[order[-1]][::-1]
        order = np.array(order)
        place = np.empty(n, dtype=np.int64)
        place[order] = np.arange(n)
        above = np.where(order == root, -1, place[near[order]])
        edge = np.where(above >= 0, np.sqrt(((exact[order] - exact[order[above]]) ** 2).sum(1)), 0.0)
        return cls(vectors[order], above, edge), order

    def walk(self, rows: np.ndarray, wanted: Callable[[int], tuple[float, float, np.ndarray]]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Each anchor with the rows whose bounds overlap its window, and their exact scores.

        ``wanted`` says of an anchor the lowest and highest score that count, and which rows may. The root scores all rows. A
        score differs from the parent's by the edge times the row's norm at most; rows that are scored anew start from there.
        """
        plain = rows.astype(np.float64)
        norms = np.sqrt((plain**2).sum(1))
        top = float(np.abs(plain).max(initial=0) * np.abs(self.vectors).max(initial=0)) * rows.shape[1]
        low_of: dict[int, np.ndarray] = {}
        high_of: dict[int, np.ndarray] = {}
        for k, p in enumerate(self.parent.tolist()):
            low, high, may = wanted(k)
            if p < 0:
                scores = rows @ self.vectors[k]
                least, most = scores.astype(np.float64), scores.astype(np.float64)
                hit = np.flatnonzero(may & (most >= low) & (least <= high))
                found = scores[hit]
            else:
                reach = norms * (self.edge[k] * (1 + 1e-9)) + (1e-12 * top + 1e-6)  # with room for rounding
                least, most = low_of[p] - reach, high_of[p] + reach
                hit = np.flatnonzero(may & (most >= low) & (least <= high))
                found = (rows @ self.vectors[k])[hit] if 2 * len(hit) > len(rows) else rows[hit] @ self.vectors[k]
                least[hit] = most[hit] = found
                if self.last[p] == k:
                    del low_of[p], high_of[p]
            if self.last[k] >= 0:
                low_of[k], high_of[k] = least, most
            yield k, hit, found


def _matrix(lists: pa.Array, width: int, whole: bool) -> np.ndarray:
    """Vectors as rows, shorter ones filled up with zeros."""
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    sizes = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lists), width), dtype=np.float64)
    if len(flat) == len(lists) * width and (sizes == width).all():
        out[:] = flat.reshape(len(lists), width)
    else:
        out[np.repeat(np.arange(len(lists)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out if whole else out.astype(np.int64)


class _Pool:
    """The best few rows of an anchor in each of its windows of scores, higher scores first, then smaller ids."""

    def __init__(self, windows: list[tuple[float, float]], k: int):
        self.k, self.lows, self.highs = k, [w[0] for w in windows], [w[1] for w in windows]
        self.rows = (np.zeros(0), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))

    @property
    def span(self) -> tuple[float, float]:
        """Scores outside can no longer change the pool."""
        return (min(self.lows), max(self.highs)) if self.lows else (np.inf, -np.inf)

    def add(self, scores: np.ndarray, keys: np.ndarray, rids: np.ndarray) -> None:
        scores, keys, rids = (np.concatenate([old, new]) for old, new in zip(self.rows, (scores, keys, rids), strict=True))
        order = np.lexsort((rids, keys, -scores))
        ranked, picked = -scores[order], []
        for j, (low, high) in enumerate(zip(self.lows, self.highs, strict=True)):
            start, stop = np.searchsorted(ranked, -high, "left"), np.searchsorted(ranked, -low, "right")
            picked.append(order[start : min(stop, start + self.k)])
            if len(picked[-1]) == self.k:
                self.lows[j] = scores[picked[-1][-1]]
        kept = np.unique(np.concatenate(picked))
        self.rows = scores[kept], keys[kept], rids[kept]


def _pass(rows: DataFrame, held: pa.Table, windows: list[list[tuple[float, float]]] | None, width: int, whole: bool, k: int) -> DataFrame:
    """Each task's best rows for the anchors ``held``: ``node, other, other_rid, score``; of the anchor's label, or with ``windows`` of others."""
    last = np.iinfo(np.int64).max  # a null id sorts there
    anchor = {c: held[c].to_pylist() for c in ("rid", "label")}
    vectors = pa.concat_arrays(held["vec"].chunks)
    sent = rows.sparkSession.sparkContext.broadcast((Tree(_matrix(vectors, width, whole), held["parent"].to_numpy(), held["edge"].to_numpy()), anchor, windows))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, anchor, windows = sent.value
        pools = [_Pool([(-np.inf, np.inf)] if windows is None else windows[i], k) for i in range(len(anchor["rid"]))]
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                part = batch.slice(at, CHUNK)
                rids, keys = part.column(0).to_numpy(), part.column(1).fill_null(last).to_numpy()
                labels = part.column(2).dictionary_encode()
                code = {v: i for i, v in enumerate(labels.dictionary.to_pylist())}
                codes = labels.indices.to_numpy()
                same = {v: codes == code.get(v, -1) for v in set(anchor["label"])}

                def wanted(i: int, rids=rids, same=same) -> tuple[float, float, np.ndarray]:
                    own = same[anchor["label"][i]]
                    return *pools[i].span, (own & (rids != anchor["rid"][i]) if windows is None else ~own)

                for i, hit, scores in tree.walk(_matrix(part.column(3), width, whole), wanted):
                    if len(hit):
                        pools[i].add(scores, keys[hit], rids[hit])
        scores, keys, found = (np.concatenate([p.rows[c] for p in pools]) for c in range(3))
        nodes = np.repeat(np.arange(len(pools)), [len(p.rows[0]) for p in pools])
        columns = [pa.array(nodes, pa.int64()), pa.array(keys, pa.int64(), mask=keys == last), pa.array(found, pa.int64()), pa.array(scores.astype(np.int64), pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["node", "other", "other_rid", "score"])

    return rows.select("rid", "id", "label", "vec").mapInArrow(search, "node bigint, other bigint, other_rid bigint, score bigint")


def mine(vectors: DataFrame, anchors: Column, id: str = "vec_id", vector: str = "embedding", label: str = "label", positives: int = 5, negatives: int = 5, low_pct: int = 80, scale: int = 256, anchors_at_once: int = ANCHORS) -> DataFrame:
    """For each row that ``anchors`` selects and each of its positives, the hardest negatives: ``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    A score is the inner product of vectors whose components are ``floor(scale * x)``. Rows with a null label or vector, or with a
    null or non-finite component, take no part. Of rows of an anchor's label, the ``positives`` best are its positives, the row
    itself left out; of rows of other labels, the ``negatives`` best with ``low_pct`` to 100 percent of a positive's score are that
    positive's negatives (a negative score has none). Ties go to the smaller id, a null id last; repeated rows are rows each, and
    a repeated anchor has rows for each. Shorter vectors count as filled up with zeros. Scores beyond 64 bits are an error. Other
    columns are not read. Without anchors or rows, the result is empty.

    Anchors, with all they need, go to the tasks in blocks of bounded size, ordered by the sides of random planes on which they
    lie, so that neighbours share a block; every block's spanning tree grows in a task. A pass for positives and one for negatives
    then compare a block with all rows where these lie, and each task sends on only its best few of each anchor.
    """
    spark = vectors.sparkSession
    ship(spark)
    tables = Tables(spark)  # the result is lazy and reads them, so they stay
    value = F.col(quoted(vector))
    sound = F.col(quoted(label)).isNotNull() & value.isNotNull() & F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(
        F.col(quoted(id)).cast("long").alias("id"), F.col(quoted(label)).cast("string").alias("label"), F.coalesce(anchors, F.lit(False)).alias("anchor"),
        F.transform(value, lambda x: F.floor(x.cast("double") * scale).cast("double")).alias("vec"), sound.alias("sound"),
    )
    rows = tables.written(rows.where("sound").drop("sound").withColumn("rid", F.monotonically_increasing_id()), "vectors")
    size = rows.agg(F.max(F.size("vec")), F.max(F.aggregate("vec", F.lit(0.0), lambda m, x: F.greatest(m, F.abs(x)))), F.count_if("anchor")).first()
    width, largest, n = size[0] or 0, size[1] or 0.0, size[2]
    if largest * largest * width >= 2.0**63:
        raise OverflowError("scores need more than 64 bits; use a smaller scale")
    whole = largest * largest * width < 2.0**53  # then sums of doubles are exact, and fast
    most = max(1, min(anchors_at_once, ANCHOR_BYTES // (8 * max(width, 1))))

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = np.random.default_rng(0).standard_normal((width, _CODE_BITS))
        for batch in batches:
            sides = (_matrix(batch.column(3), width, True) @ planes > 0) @ (1 << np.arange(_CODE_BITS))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sides, pa.int64())], names=[*batch.schema.names, "side"])

    def grown(key: tuple, table: pa.Table) -> pa.Table:
        out = []
        for k, at in enumerate(range(0, len(table), most)):
            some = table.slice(at, most).combine_chunks()
            tree, order = Tree.grown(_matrix(some["vec"].chunk(0), width, whole))
            some = some.take(pa.array(order))
            extra = {"block": np.full(len(order), (key[0].as_py() << 16) + k), "node": np.arange(len(order)), "parent": tree.parent, "edge": tree.edge}
            out.append(pa.table({c: some[c] for c in ("rid", "id", "label", "vec")} | {c: pa.array(v) for c, v in extra.items()}))
        return pa.concat_tables(out)

    picked = rows.where("anchor").select("rid", "id", "label", "vec")
    # equal sides are told apart by a hash, so that blocks are of about equal size whatever the vectors are
    code = F.shiftleft(F.col("side"), 32) + F.pmod(F.xxhash64("rid"), F.lit(1 << 32))
    codes = tables.written(picked.mapInArrow(coded, StructType([*picked.schema.fields]).add("side", "long")).withColumn("code", code).drop("side"), "anchor-codes")
    parts = max(1, -(-n * 5 // (most * 4)))
    cuts = codes.agg(F.percentile_approx("code", [i / parts for i in range(1, parts)], 20 * parts)).first()[0] if parts > 1 else []  # a number for each pass
    place = F.size(F.filter(F.array(*map(F.lit, cuts)).cast("array<bigint>"), lambda c: c < F.col("code"))).alias("place")
    grouped = codes.select("rid", "id", "label", "vec", place).groupBy("place")
    forest = tables.written(grouped.applyInArrow(grown, "rid bigint, id bigint, label string, vec array<double>, block bigint, node bigint, parent bigint, edge double"), "anchor-trees")
    blocks = [r["block"] for r in forest.select("block").distinct().orderBy("block").collect()]  # a number for each pass

    near, far = fresh_path(spark, "positives"), fresh_path(spark, "negatives")
    for block in blocks:
        held = forest.where(F.col("block") == block).orderBy("node").toArrow()  # bounded by ``most``
        first = _pass(rows, held, None, width, whole, positives)
        order = Window.partitionBy("node").orderBy(F.desc("score"), F.col("other").asc_nulls_last(), "other_rid")
        first = first.withColumn("place", F.row_number().over(order)).where(F.col("place") <= positives).withColumn("block", F.lit(block))
        first.write.mode("append").parquet(near)
        windows: list[list[tuple[float, float]]] = [[] for _ in range(len(held))]
        for r in spark.read.parquet(near).where(F.col("block") == block).select("node", "score").collect():  # ``positives`` for each anchor held
            windows[r["node"]].append((-(-low_pct * r["score"] // 100), r["score"]))
        windows = [[w for w in some if w[0] <= w[1]] for some in windows]
        _pass(rows, held, windows, width, whole, negatives).withColumn("block", F.lit(block)).write.mode("append").parquet(far)
    if not blocks:
        return spark.createDataFrame([], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")
    whose = forest.select("block", "node", F.col("id").alias("anchor_id"))
    pairs = spark.read.parquet(near).select("block", "node", "place", F.col("other").alias("positive_id"), F.col("score").alias("positive_score"))
    others = spark.read.parquet(far).select("block", "node", F.col("other").alias("negative_id"), "other_rid", F.col("score").alias("negative_score"))
    wide = lambda c: F.col(c).cast("decimal(20,0)")  # noqa: E731  a percentage of a score may need more than 64 bits
    fits = (F.lit(low_pct) * wide("positive_score") <= F.lit(100) * wide("negative_score")) & (F.col("negative_score") <= F.col("positive_score"))
    best = Window.partitionBy("block", "node", "place").orderBy(F.desc("negative_score"), F.col("negative_id").asc_nulls_last(), "other_rid")
    joined = pairs.join(others, ["block", "node"]).where(fits).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= negatives)
    return joined.join(whose, ["block", "node"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
