"""Benchmark decontamination by greedy string tiling: shared seeds, longest non-overlapping matches, coverage of the test item."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import ship
from .common import all_of, without, written

#: Characters of benchmark text that are broadcast at a time; a larger benchmark goes in several shards, one after the other.
MAX_SHARD_CHARS = 32_000_000
_DROPPED = bytes(i for i in range(33, 127) if not chr(i).isalnum())
_BITS = 22


@dataclass(frozen=True)
class TilingRules:
    """Words of the shortest match that counts, and the share of an item's words in matches from which a document is out."""

    min_match: int = 5
    min_coverage: float = 0.5


def words_of(text: str | None) -> list[bytes]:
    """A text's words in lower case without ASCII punctuation; words of punctuation alone vanish."""
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(None, _DROPPED).split()


def hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


def tokens(text: str | None) -> np.ndarray:
    """64-bit hashes of a text's words."""
    return hashes(words_of(text))


_BASE = 0x9E3779B97F4A7C15


class Rolling:
    """Karp-Rabin hashes of the windows of a sequence, of any length and at any places."""

    def __init__(self, h: np.ndarray):
        with np.errstate(over="ignore"):
            powers = np.cumprod(np.full(len(h), _BASE, dtype=np.uint64), dtype=np.uint64)
            back = np.cumprod(np.full(len(h), pow(_BASE, -1, 2**64), dtype=np.uint64), dtype=np.uint64)
            # words times falling powers, added up; a window's sum times the power of its place no longer depends on the place
            self.sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(h * back, dtype=np.uint64)])
            self.powers = np.concatenate([np.ones(1, dtype=np.uint64), powers])

    def at(self, places: np.ndarray, n: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            out = (self.sums[places + n] - self.sums[places]) * self.powers[places]
            return out ^ (out >> np.uint64(29))

    def all(self, n: int) -> np.ndarray:
        return self.at(np.arange(max(0, len(self.sums) - n)), n)


def _run_lengths(places: np.ndarray) -> np.ndarray:
    """For each of sorted places how many of them follow one another from there on."""
    ends = np.flatnonzero(np.append(np.diff(places) != 1, True))
    return ends[np.searchsorted(ends, np.arange(len(places)))] - np.arange(len(places)) + 1


def _free(places: np.ndarray, begin: int, n: int, k: int) -> np.ndarray:
    """Places whose ``k`` words lie outside the ``n`` words from ``begin`` on."""
    return places[(places + k <= begin) | (places >= begin + n)]


def tile(doc: list[bytes], doc_roll: Rolling, doc_at: np.ndarray, item: list[bytes], item_roll: Rolling, k: int) -> int:
    """Words of the item that greedy string tiling marks. ``doc_at``: sorted places of the document whose ``k`` words the item has.

    The longest match that is free on both sides is marked first (then the first in the document, then in the item), until none of
    ``k`` words is left. Its length is found by halving: if windows of some length meet, so do shorter ones. Places are never
    paired: a round costs the places of both texts, however often their words repeat. A hit of the hashes is compared word by word.
    """
    item_at = np.arange(len(item) - k + 1)
    marked, most = 0, len(item)
    while len(doc_at) and len(item_at):
        ahead, item_ahead = _run_lengths(doc_at), _run_lengths(item_at)
        low, high = 0, min(most - k + 1, int(ahead.max()), int(item_ahead.max()))
        best = None
        step = high  # the longest possible first: whole items and whole passages are found at once
        while low < high:
            d, i = doc_at[ahead >= step], item_at[item_ahead >= step]
            of_doc, of_item = doc_roll.at(d, step + k - 1), item_roll.at(i, step + k - 1)
            hit = np.flatnonzero(np.isin(of_doc, of_item))
            if len(hit):
                low, best = step, (int(d[hit[0]]), int(i[np.flatnonzero(of_item == of_doc[hit[0]])[0]]))
            else:
                high = step - 1
            step = (low + high + 1) // 2
        if best is None:
            break
        (d, i), n = best, low + k - 1
        if doc[d : d + n] != item[i : i + n]:  # no match after all
            doc_at = doc_at[doc_at != d]
            continue
        marked, most = marked + n, n
        doc_at, item_at = _free(doc_at, d, n, k), _free(item_at, i, n, k)
    return marked


class SeedIndex:
    """The ``k``-word seeds of a shard of test items, sorted by hash, behind a bitmap that most document windows fail.

    An item is ``(item_id, text, times)``: so many rows of the benchmark have it.
    """

    def __init__(self, items: list[tuple[int | None, str | None, int]], k: int):
        self.k, self.ids, self.words, self.times = k, [], [], []
        seeds, owners = [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.int64)]
        for item_id, text, times in items:
            w = words_of(text)
            if len(w) < k:
                continue
            own = np.unique(Rolling(hashes(w)).all(k))
            seeds.append(own)
            owners.append(np.full(len(own), len(self.ids), dtype=np.int64))
            self.ids.append(item_id)
            self.words.append(w)
            self.times.append(times)
        self.hash = np.concatenate(seeds)
        order = np.argsort(self.hash, kind="stable")
        self.hash, self.owner = self.hash[order], np.concatenate(owners)[order]
        self.bitmap = np.zeros(1 << _BITS, dtype=bool)
        self.bitmap[(self.hash >> np.uint64(64 - _BITS)).astype(np.int64)] = True

    def matches(self, text: str | None, rules: TilingRules) -> tuple[int, int, int | None, float]:
        """Words of the document, items it covers enough, the best covered item (ties: the smallest id, nulls last) and its coverage."""
        doc = words_of(text)
        roll = Rolling(hashes(doc))
        windows = roll.all(self.k)
        at = np.flatnonzero(self.bitmap[(windows >> np.uint64(64 - _BITS)).astype(np.int64)])
        found, best, coverage = 0, None, 0.0
        if len(at) and len(self.hash):
            # a seed that a text repeats is looked up once
            seeds, number = np.unique(windows[at], return_inverse=True)
            lo, hi = np.searchsorted(self.hash, seeds, "left"), np.searchsorted(self.hash, seeds, "right")
            count = hi - lo
            owner = self.owner[np.repeat(lo, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)]
            seed = np.repeat(np.arange(len(seeds)), count)
            order = np.argsort(owner, kind="stable")
            owner, seed = owner[order], seed[order]
            bounds = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1], [True]])).tolist() if len(owner) else []
            for begin, end in zip(bounds, bounds[1:]):
                o = int(owner[begin])
                mine = np.zeros(len(seeds), dtype=bool)
                mine[seed[begin:end]] = True
                item = self.words[o]
                share = tile(doc, roll, at[mine[number]], item, Rolling(hashes(item)), self.k) / len(item)
                found += self.times[o] * (share >= rules.min_coverage)
                key = (-share, self.ids[o] is None, self.ids[o] or 0)
                if share > 0 and (best is None or key < best):
                    best, coverage = key, share
        return len(doc), found, None if best is None or best[1] else best[2], coverage


def _shards(benchmark: DataFrame) -> list[DataFrame]:
    """Items of ``MAX_SHARD_CHARS`` characters at most in each shard; an item longer than that is alone."""
    items = benchmark.groupBy(F.col("item_id").cast("long").alias("item_id"), "text").agg(F.count("*").alias("times"))
    chars = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"]
    n = -(-int(chars) // MAX_SHARD_CHARS) or 1
    if n == 1:
        return [items]
    while True:
        # cells of items by hash, some for each shard, so few that their sizes fit on the driver
        cell = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
        sizes = items.groupBy(cell.alias("cell")).agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars"), F.count("*").alias("items")).orderBy("cell").collect()
        if all(r["chars"] <= MAX_SHARD_CHARS or r["items"] == 1 for r in sizes):
            break
        n *= 2
    packs: list[list[int]] = []
    room = -1
    for r in sizes:
        room -= r["chars"]
        if room < 0:
            packs.append([])
            room = MAX_SHARD_CHARS - r["chars"]
        packs[-1].append(r["cell"])
    return [items.filter(cell.isin(pack)) for pack in packs]


def find_leaks(docs: DataFrame, benchmark: DataFrame, rules: TilingRules = TilingRules()) -> DataFrame:
    """``docs`` with ``n_items`` (long), ``item_id`` (long), ``coverage`` (double) and ``kept`` (boolean); columns of these names are replaced.

    A document is out (``kept`` false) if greedy string tiling covers at least ``min_coverage`` of some item of ``benchmark`` (``item_id,
    text``) with matches of ``min_match`` words or more, in any order: ``n_items`` counts such items (repeated rows of the
    benchmark count each), and ``item_id`` with ``coverage`` is the one covered best. Words are compared in lower case without ASCII
    punctuation. Items of fewer than ``min_match`` words, null and empty ones among them, match nothing. A null text has no words and is
    kept. Each row is judged on its own, so repeated rows, null ids and hot sources cost nothing more; other columns pass
    through. Nothing is shuffled but the benchmark. Memory grows with a text's length, not with how often its words repeat.

    What is broadcast is bounded: the benchmark goes in shards of ``MAX_SHARD_CHARS`` characters, one alone as a rule. With more, each
    pass is written, adds to the verdicts of the one before, and its index is given back before the next is sent.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = without(docs, ["n_items", "item_id", "coverage", "kept"])
    added = [("n_items", T.LongType()), ("item_id", T.LongType()), ("coverage", T.DoubleType())]
    out, shards = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))]), _shards(benchmark)
    schema = T.StructType([*out.schema.fields, *[T.StructField(n, t) for n, t in added]])
    for part in shards:
        rows = [(r["item_id"], r["text"], r["times"]) for r in part.collect()]
        index = spark.sparkContext.broadcast(SeedIndex(rows, rules.min_match))
        out = out.mapInArrow(_judge(index, rules, docs.columns.index("text"), len(docs.columns)), schema)
        if len(shards) > 1:
            out = written(out, "leaks-of-shard")
            index.destroy()
    out = out.toDF(*docs.columns, *[n for n, _ in added])
    return out.withColumn("kept", F.col("n_items") == 0)


def _judge(index, rules: TilingRules, text_at: int, width: int):
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [index.value.matches(t.as_py(), rules)[1:] for t in batch.column(text_at)]
            n, item, share = [list(c) for c in zip(*found, strict=True)] if found else ([], [], [])
            if batch.num_columns > width:  # the verdicts of an earlier shard
                for i, (n0, item0, share0) in enumerate(zip(*[batch.column(width + j).to_pylist() for j in range(3)], strict=True)):
                    n[i] += n0
                    better = share0 > share[i] or (share0 == share[i] and item0 is not None and (item[i] is None or item0 < item[i]))
                    if better:
                        item[i], share[i] = item0, share0
            columns = [batch.column(j) for j in range(width)] + [pa.array(n, pa.int64()), pa.array(item, pa.int64()), pa.array(share, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:width], "n_items", "item_id", "coverage"])

    return judge


def drop_leaks(docs: DataFrame, benchmark: DataFrame, rules: TilingRules = TilingRules()) -> DataFrame:
    """The documents that hold no test item."""
    return find_leaks(docs, benchmark, rules).filter("kept").select(*all_of(docs))
