"""N-gram Jaccard join by chosen paths: sets split on sampled shared tokens until buckets are small; runs repeat until the target recall."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import ship
from .common import all_of, Tables, written

#: A path's top bits hold its run.
RUN_SHIFT = 58
MAX_RUNS = 1 << (64 - RUN_SHIFT)
#: Bytes of a set's sketch, one for each bin of its hashes.
BINS = 128
#: Tokens hashed, and pairs compared, at a time: bounds of a task's memory, not of its work.
_TOKENS, _PAIRS, _COLUMNS = 32_768, 65_536, 1_024
#: A tile of more sets than this is compared by itself.
_SMALL_TILE = 64
#: Rows of buckets, and tokens of texts, that a group of buckets holds on average.
_GROUP_ROWS, _GROUP_TOKENS = 8_192, 500_000


@dataclass(frozen=True)
class JoinRules:
    """Words of a shingle, the least similarity, the recall at exactly that similarity, and sizes of buckets and tiles.

    A bucket of more than ``split`` sets is split again, ``depth`` levels at most. A bucket that is still larger than ``tile`` sets or
    ``tile_tokens`` tokens is brute-forced in tiles of two blocks of half that size. These sizes only share out work: every pair of a
    bucket is compared. ``sketch_loss`` bounds the probability that sketches rule out a pair at exactly the limit, and is part of what
    ``recall`` allows; 0 compares all pairs by their sets.
    """

    words: int = 5
    similarity: float = 0.8
    recall: float = 0.9995
    sketch_loss: float = 1e-6
    split: int = 512
    depth: int = 3
    tile: int = 2048
    tile_tokens: int = 2_000_000

    @property
    def runs(self) -> int:
        """Runs for the recall. Two sets of the least similarity share one path a level on average, so a level fails as a Poisson count of 0 does."""
        fails = 0.0
        for _ in range(self.depth):
            fails = math.exp(fails - 1)
        left = 1 - self.recall - self.sketch_loss
        if left <= 0:
            raise ValueError("recall and sketch_loss leave nothing for the paths")
        runs = math.ceil(math.log(left) / math.log(fails))
        if runs > MAX_RUNS:
            raise ValueError(f"recall {self.recall} takes {runs} runs; {MAX_RUNS} are the most")
        return runs


def shingles(text: bytes | None, k: int) -> np.ndarray:
    """Sorted 64-bit hashes of a text's ``k``-word shingles; a shorter text is one shingle, a blank one none."""
    words = (text or b"").split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    n = max(1, len(h) - k + 1)
    out = np.zeros(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(min(k, len(h))):
            out = out * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n]
        out = _mix(out + np.uint64(len(h) if len(h) < k else 0))
    return np.unique(out)


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


def set_id(s: np.ndarray) -> bytes:
    """128 bits that name a set."""
    return xxhash.xxh3_128_digest(s.tobytes())


def _chosen(s: np.ndarray, seeds: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """For each seed (a run or a path) the tokens of ``s`` that it chooses: row numbers of seeds, and hashes of seed and token.

    A token is chosen if its product with the seed's odd number is under 1 / (similarity x size) of the range, so 1 / similarity
    tokens on average. (Tokens are hashes already.)
    """
    limit = np.uint64(min(2**64 - 1, int(2**64 / (similarity * len(s)))))
    mixed = _mix(seeds)
    odd = (mixed | np.uint64(1))[:, None]
    step = max(1, _TOKENS * 16 // len(seeds)) if len(seeds) else 1
    rows, cols = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    for at in range(0, len(s), step):
        row, col = np.nonzero(odd * s[None, at : at + step] <= limit)
        rows.append(row)
        cols.append(col + at)
    row, col = np.concatenate(rows), np.concatenate(cols)
    return row, _mix(mixed[row] ^ s[col])


def first_paths(s: np.ndarray, rules: JoinRules) -> np.ndarray:
    """Paths of one token, of all runs."""
    row, h = _chosen(s, np.arange(1, rules.runs + 1, dtype=np.uint64), rules.similarity)
    return ((row.astype(np.uint64) << np.uint64(RUN_SHIFT)) | (h >> np.uint64(64 - RUN_SHIFT))).view(np.int64)


def longer_paths(s: np.ndarray, paths: np.ndarray, rules: JoinRules) -> np.ndarray:
    """The given paths of a set, each with one more token of the set."""
    seeds = paths.view(np.uint64)
    row, h = _chosen(s, seeds, rules.similarity)
    run = seeds[row] >> np.uint64(RUN_SHIFT)
    return ((run << np.uint64(RUN_SHIFT)) | (h >> np.uint64(64 - RUN_SHIFT))).view(np.int64)


def sketch(s: np.ndarray) -> bytes:
    """For each bin of hashes one byte of the least hash in it; 0 for an empty bin."""
    h = np.sort(_mix(s + np.uint64(0x51ED270B)))
    bins = h >> np.uint64(64 - BINS.bit_length() + 1)
    first = np.flatnonzero(np.append(True, bins[1:] != bins[:-1]))
    out = np.zeros(BINS, dtype=np.uint8)
    out[bins[first].astype(np.int64)] = _mix(h[first]) % np.uint64(255) + np.uint64(1)
    return out.tobytes()


@lru_cache(maxsize=8)
def least_alike(similarity: float, loss: float) -> np.ndarray:
    """For each number of bins that either set fills, the least count of equal ones that a pair passes with.

    A bin shows the same hash for both sets with the probability of their similarity, so the count is binomial: fewer come up with
    a probability of ``loss`` at most. (Equal bytes of different hashes only add to it.)
    """
    least = np.zeros(BINS + 1, dtype=np.int64)
    for n in range(1, BINS + 1):
        below = 0.0
        for k in range(n + 1):
            below += math.comb(n, k) * similarity**k * (1 - similarity) ** (n - k)
            if below > loss:
                least[n] = k
                break
    return least


_ROW = ["path", "lo", "hi", "block", "sid", "size", "keys", "sketch"]
_TILE = "grp bigint, path bigint, lo int, hi int, block int, sid binary, size int, keys array<bigint>, sketch binary"


def _in_order(rows: pa.Table) -> pa.Table:
    """Rows of a group of tiles, tile by tile, block by block."""
    return rows.combine_chunks().sort_by([(c, "ascending") for c in ("path", "lo", "hi", "block", "sid")])


def _tile_starts(rows: pa.Table) -> np.ndarray:
    """Where each tile of ordered rows starts, and the end."""
    cols = [rows[c].to_numpy() for c in ("path", "lo", "hi")]
    new = np.ones(rows.num_rows, dtype=bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in cols])
    return np.append(np.flatnonzero(new), rows.num_rows)


def _partners(rows: pa.Table, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The range of rows that each row is compared with: later ones of its tile; in a tile of two blocks, the other block's for those of the first."""
    n = np.diff(starts)
    end = np.repeat(starts[1:], n)
    lo, hi, block = (rows[c].to_numpy() for c in ("lo", "hi", "block"))
    begin = np.arange(rows.num_rows) + 1
    two = lo != hi
    if two.any():
        first = two & (block == lo)
        count = np.add.reduceat(first.astype(np.int64), starts[:-1])
        begin = np.where(two, np.where(first, np.repeat(starts[:-1] + count, n), end), begin)
    return begin, end


class _Keys:
    """Paths of the rows of a group, to tell whether two rows have met before."""

    def __init__(self, rows: pa.Table):
        keys = rows["keys"].combine_chunks()
        flat = keys.flatten().to_numpy()
        self.n = np.diff(keys.offsets.to_numpy())
        self.start = np.cumsum(self.n) - self.n
        all_keys, self.number = np.unique(flat, return_inverse=True)
        self.kinds = max(1, len(all_keys))
        self.codes = np.repeat(np.arange(len(self.n)), self.n) * self.kinds + self.number  # ascending: a row's keys are sorted
        # of a row's keys, those before its path
        here = np.searchsorted(all_keys, rows["path"].to_numpy())
        before = self.number < np.repeat(here, self.n)
        self.earlier = np.add.reduceat(np.append(before, False).astype(np.int64), self.start) if len(self.n) else self.n
        self.earlier[self.n == 0] = 0

    def earlier_in(self, first: int, last: int) -> _Earlier:
        """The earlier paths of the rows of one tile."""
        n = self.earlier[first:last]
        row = np.repeat(np.arange(last - first), n)
        at = self.start[first:last][row] + np.arange(len(row)) - (np.cumsum(n) - n)[row]
        _, number, times = np.unique(self.number[at], return_inverse=True, return_counts=True)
        column = np.cumsum(times > 1) - 1
        shared = times[number] > 1
        return _Earlier(first, last - first, row[shared], column[number[shared]])

    def met(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        n = self.earlier[left]
        pair = np.repeat(np.arange(len(left)), n)
        if not len(pair):
            return np.zeros(len(left), dtype=bool)
        at = self.start[left][pair] + np.arange(len(pair)) - (np.cumsum(n) - n)[pair]
        want = right[pair] * self.kinds + self.number[at]
        found = np.searchsorted(self.codes, want)
        same = self.codes[np.minimum(found, len(self.codes) - 1)] == want
        return np.bincount(pair[same], minlength=len(left)) > 0


_LOW7 = np.uint64(0x7F7F7F7F7F7F7F7F)


def _filled(words: np.ndarray) -> np.ndarray:
    """The top bit of every byte that is not 0."""
    return (((words & _LOW7) + _LOW7) | words) & ~_LOW7


class _Group:
    """Ordered rows of tiles, and the pairs of them that sizes and sketches allow, each in the first bucket where it meets.

    A pair meets in every path it has in common; it is taken at the least of them. Sets whose sizes differ by more than the
    similarity can't have it.
    """

    def __init__(self, rows: pa.Table, rules: JoinRules):
        self.starts = _tile_starts(rows) if rows.num_rows else np.zeros(1, dtype=np.int64)
        self.begin, self.end = _partners(rows, self.starts) if rows.num_rows else (np.zeros(0, dtype=np.int64),) * 2
        self.keys = _Keys(rows)
        self.size = rows["size"].to_numpy().astype(np.int64)
        self.words = np.frombuffer(b"".join(rows["sketch"].to_pylist()), dtype=np.uint64).reshape(-1, BINS // 8)
        self.full = _filled(self.words)
        self.least = least_alike(rules.similarity, rules.sketch_loss) if rules.sketch_loss else None
        self.per = round(rules.similarity * 1_000_000)

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Some pairs at a time: many small tiles together, a large one by itself."""
        large = np.diff(self.starts) > _SMALL_TILE
        cuts = np.unique(np.concatenate([[0, len(large)], np.flatnonzero(large), np.flatnonzero(large) + 1]))
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            yield from self._pairs_of(int(self.starts[lo]), int(self.starts[hi]), bool(large[lo]))

    def _pairs_of(self, first: int, last: int, one_tile: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        count = np.maximum(self.end[first:last] - self.begin[first:last], 0)
        total = np.cumsum(count)
        earlier = None
        at = 0
        while at < last - first:
            upto = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + _PAIRS, "right")))
            n = count[at:upto]
            left = np.repeat(np.arange(first + at, first + upto), n)
            right = self.begin[left] + np.arange(len(left)) - np.repeat(np.cumsum(n) - n, n)
            left, right = self._alike(left, right)
            if one_tile and len(left) > 4 * (last - first):
                # nearly all of them are alike: what they have in common is a product of matrices
                earlier = earlier or self.keys.earlier_in(first, last)
                met = earlier.met(first + at, first + upto)[left - first - at, right - first]
            else:
                met = self.keys.met(left, right)
            at = upto
            if not met.all():
                yield left[~met], right[~met]

    def _alike(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.size[left], self.size[right]
        ok = np.minimum(a, b) * 1_000_000 >= self.per * np.maximum(a, b)
        left, right = left[ok], right[ok]
        if self.least is None or not len(left):
            return left, right
        either = np.bitwise_count(self.full[left] | self.full[right]).sum(axis=1, dtype=np.int64)
        differ = np.bitwise_count(_filled(self.words[left] ^ self.words[right])).sum(axis=1, dtype=np.int64)
        ok = either - differ >= self.least[either]
        return left[ok], right[ok]


class _Earlier:
    """Paths before the tile's own that several rows of a tile have, as columns of 0 and 1."""

    def __init__(self, first: int, m: int, row: np.ndarray, column: np.ndarray):
        self.first, self.m, self.row, self.column = first, m, row, column
        self.kept: np.ndarray | None = None

    def _columns(self, c: int) -> np.ndarray:
        a = np.zeros((self.m, _COLUMNS), dtype=np.float32)
        here = (self.column >= c) & (self.column < c + _COLUMNS)
        a[self.row[here], self.column[here] - c] = 1
        return a

    def met(self, lo: int, hi: int) -> np.ndarray:
        """Which rows from ``lo`` to ``hi`` have met which rows of the tile."""
        met = np.zeros((hi - lo, self.m), dtype=bool)
        n = int(self.column.max()) + 1 if len(self.column) else 0
        for c in range(0, n, _COLUMNS):
            if n <= _COLUMNS:
                self.kept = self._columns(c) if self.kept is None else self.kept
            a = self.kept if n <= _COLUMNS else self._columns(c)
            met |= a[lo - self.first : hi - self.first] @ a.T > 0
        return met


def _worth_reading(rules: JoinRules):
    def worth(rows: pa.Table) -> pa.Table:
        rows = _in_order(rows)
        some = np.zeros(rows.num_rows, dtype=bool)
        for left, right in _Group(rows, rules).pairs():
            some[left] = True
            some[right] = True
        left = rows.filter(pa.array(some)).select(["grp", *_ROW])
        return left.set_column(left.schema.get_field_index("keys"), "keys", left["keys"].cast(pa.list_(pa.int64())))

    return worth


def _overlaps(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Counts of common tokens of pairs of sets."""
    if len(left) <= 8 * len(sets):
        return np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(left, right, strict=True)], dtype=np.int64)
    used, place = np.unique(np.concatenate([left, right]), return_inverse=True)
    row, col = place[: len(left)], place[len(left) :]
    flat = np.concatenate([sets[i] for i in used])
    owner = np.repeat(np.arange(len(used)), [len(sets[i]) for i in used])
    _, number, times = np.unique(flat, return_inverse=True, return_counts=True)
    often = times > 1
    rank = np.cumsum(often) - 1
    shared = often[number]
    owner, number = owner[shared], rank[number[shared]]
    a0, a1, b0, b1 = row.min(), row.max() + 1, col.min(), col.max() + 1
    common = np.zeros((a1 - a0, b1 - b0), dtype=np.float32)
    for c in range(0, int(often.sum()), _COLUMNS):
        here = (number >= c) & (number < c + _COLUMNS)
        a = np.zeros((len(used), _COLUMNS), dtype=np.float32)
        a[owner[here], number[here] - c] = 1
        common += a[a0:a1] @ a[b0:b1].T
    return np.rint(common[row - a0, col - b0]).astype(np.int64)


def _least_linked(m: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For each of ``m`` sets the least one that it hangs together with."""
    label = np.arange(m)
    while True:
        after = label.copy()
        np.minimum.at(after, left, label[right])
        np.minimum.at(after, right, label[left])
        after = after[after]
        if (after == label).all():
            return label
        label = after


def _links(rules: JoinRules):
    per = round(rules.similarity * 1_000_000)

    def links(rows: pa.Table) -> pa.Table:
        expand = zstandard.ZstdDecompressor()
        rows = _in_order(rows)
        starts = _tile_starts(rows) if rows.num_rows else np.zeros(1, dtype=np.int64)
        names: list[bytes] = []
        nearest: list[bytes] = []
        counts: list[int] = []
        for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            tile = rows.slice(lo, hi - lo)
            sid = tile["sid"].to_pylist()
            sets = [shingles(expand.decompress(t), rules.words) for t in tile["z"].to_pylist()]
            size = np.array([len(s) for s in sets])
            found = [(left.astype(np.int32), right.astype(np.int32)) for left, right in _Group(tile, rules).pairs()]
            if not found:
                continue
            left, right = (np.concatenate(x) for x in zip(*found, strict=True))
            both = _overlaps(sets, left, right)
            # both / (a + b - both) >= similarity, in whole numbers
            near = both * (1_000_000 + per) >= per * (size[left] + size[right])
            left, right = left[near], right[near]
            n = np.bincount(left, minlength=len(sid)) + np.bincount(right, minlength=len(sid))
            top = _least_linked(len(sid), left, right)
            keep = np.flatnonzero(n).tolist()
            names += [sid[i] for i in keep]
            nearest += [sid[top[i]] for i in keep]
            counts += n[keep].tolist()
        return pa.table([pa.array(names, pa.binary()), pa.array(nearest, pa.binary()), pa.array(counts, pa.int64())], names=["sid", "near", "n_links"])

    return links


_SIGNED = "doc_id bigint, sid binary, size int, keys array<bigint>, sketch binary, z binary"


def _signatures(rules: JoinRules):
    def signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor()
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                s = shingles(text, rules.words)
                if doc is None or not len(s):
                    rows.append((doc, set_id(s) if len(s) else None, None, None, None, None))
                    continue
                rows.append((doc, set_id(s), len(s), np.unique(first_paths(s, rules)), sketch(s), squeeze.compress(text)))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 6
            types = [pa.int64(), pa.binary(), pa.int32(), pa.list_(pa.int64()), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[f.split()[0] for f in _SIGNED.split(", ")])

    return signatures


def _split(rules: JoinRules):
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor()
        for batch in batches:
            paths = [
                np.unique(longer_paths(shingles(expand.decompress(z), rules.words), np.array(keys, dtype=np.int64), rules))
                for z, keys in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(paths, pa.list_(pa.int64()))], names=["sid", "size", "keys"])

    return split


def _buckets(tables: Tables, sets: DataFrame, level: int) -> DataFrame:
    """``path, sid, size`` with the number ``m`` of sets and ``tokens`` of buckets of two sets or more, from each set's ``keys``.

    The sizes are a table of their own, so that the join has a shuffle on both sides and AQE can split a hot path.
    """
    each = sets.select("sid", "size", F.explode("keys").alias("path"))
    sizes = tables.written(each.groupBy("path").agg(F.count("*").alias("m"), F.sum("size").alias("tokens")).filter("m > 1"), f"bucket-sizes-{level}")
    return tables.written(each.join(sizes, "path"), f"buckets-{level}")


def _components(tables: Tables, links: DataFrame) -> DataFrame:
    """``sid`` and ``label`` (the least of its component) of all nodes of the edges ``sid - near``.

    Labels spread along edges and jump to the label of the label, so rounds grow with the logarithm of a component's length.
    """
    edges = links.filter("sid <> near").select("sid", "near").distinct()
    edges = tables.written(edges.unionByName(edges.select(F.col("near").alias("sid"), F.col("sid").alias("near"))).distinct(), "near-edges")
    labels = tables.written(edges.groupBy("sid").agg(F.min("near").alias("m")).select("sid", F.least("sid", "m").alias("label")), "labels")
    while True:
        near = edges.join(labels.select(F.col("sid").alias("near"), "label"), "near").groupBy("sid").agg(F.min("label").alias("m"))
        spread = labels.join(near, "sid").select("sid", F.least("label", "m").alias("next"), F.col("label").alias("was"))
        jump = labels.select(F.col("sid").alias("next"), F.col("label").alias("far"))
        after = tables.written(spread.join(jump, "next").select("sid", F.least("next", "far").alias("label"), (F.least("next", "far") != F.col("was")).alias("moved")), "labels")
        labels = after.select("sid", "label")
        if not after.filter("moved").limit(1).count():
            return labels


def near_duplicates(docs: DataFrame, rules: JoinRules = JoinRules()) -> DataFrame:
    """``doc_id, copy_of, class_id, n_links`` of each row of ``docs`` (``doc_id, text``).

    Texts with the same set of shingles are copies: ``copy_of`` is the least id among them. Two sets are linked if their Jaccard
    similarity is ``rules.similarity`` or more: ``n_links`` is the number of other sets linked to the row's. ``class_id`` is the
    least id that links lead to, step by step. Words are what lies between ASCII white space; a text shorter than a shingle
    is one shingle. A blank or null text is no copy of anything; rows with a null id are left aside: both have themselves as
    ``copy_of`` and ``class_id``, and no link. Repeated rows are copies. Other columns are not read.

    Every run chooses tokens of each set by a shared hash; sets that chose the same token meet in its bucket, and large buckets
    split by further tokens. Every pair of a final bucket is compared, first by size and sketch, then by the sets themselves; a pair
    that meets in several is taken at the first. The links are exact; a pair at exactly the limit is found with probability
    ``rules.recall``, closer ones more surely. Only copies' first texts take part; texts are dealt out by id once, compressed, and
    only those of sets with a likely partner leave their place. Pairs never become rows: a tile gives each of its texts a count
    and the least text it hangs together with. A hot bucket is shared out over tiles of two blocks, so no task's work grows with it.
    """
    return _classes(docs, rules).drop("sid")


def _classes(docs: DataFrame, rules: JoinRules) -> DataFrame:
    """The rows of ``near_duplicates`` with the id of each row's set, null for a blank text, as a table of its own."""
    spark = docs.sparkSession
    ship(spark)
    with Tables(spark) as tables:
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.encode("text", "UTF-8").alias("text"))
        signed = tables.bucketed(rows.mapInArrow(_signatures(rules), _SIGNED), "near_texts", "doc_id", "sid")
        real = signed.filter("sid is not null and doc_id is not null")
        reps = real.groupBy("sid").agg(F.min("doc_id").alias("copy_of"), *[F.first(c).alias(c) for c in ("size", "keys", "sketch")])
        reps = tables.written(reps, "sets")
        found = _found(tables, real, reps, rules)

        counts = found.groupBy("sid").agg(F.sum("n_links").alias("n_links"))
        labels = _components(tables, found)
        least = labels.join(reps.select("sid", "copy_of"), "sid").groupBy("label").agg(F.min("copy_of").alias("class_id"))
        known = reps.select("sid", "copy_of").join(labels.join(least, "label").select("sid", "class_id"), "sid", "left").join(counts, "sid", "left")
        known = known.select("sid", "copy_of", F.coalesce("class_id", "copy_of").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
        # a table of its own, so that AQE can split a set with very many copies
        known = tables.written(known, "set-classes")
        told = real.select("doc_id", "sid").join(known, "sid").select("doc_id", "copy_of", "class_id", "n_links", "sid")
        alone = signed.filter("sid is null or doc_id is null").select("doc_id", F.col("doc_id").alias("copy_of"), F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), "sid")
        return written(told.unionByName(alone), "near-classes")


def _texts_of(real: DataFrame, wanted: DataFrame) -> DataFrame:
    """Compressed texts ``z`` of the sets of ``wanted`` (``sid, copy_of`` and more), found where they lie."""
    found = real.select("doc_id", "sid", "z").join(wanted.withColumnRenamed("copy_of", "doc_id"), ["doc_id", "sid"])
    return found.dropDuplicates(["doc_id", "sid"])  # repeated rows


def _found(tables: Tables, real: DataFrame, reps: DataFrame, rules: JoinRules) -> DataFrame:
    """``sid, near, n_links`` by tile: sets with links, the least set of the tile that they hang together with, and how many links."""
    live = _buckets(tables, reps, 1)
    leaves = live.filter(F.col("m") <= rules.split)
    for level in range(2, rules.depth + 1):
        large = live.filter(F.col("m") > rules.split)
        if not large.limit(1).count():
            break
        again = large.groupBy("sid").agg(F.collect_list("path").alias("keys")).join(reps.select("sid", "copy_of", "size"), "sid")
        deeper = _texts_of(real, again).select("sid", "size", "z", "keys").mapInArrow(_split(rules), "sid binary, size int, keys array<bigint>")
        live = _buckets(tables, tables.written(deeper, f"paths-{level}"), level)
        leaves = leaves.unionByName(live if level == rules.depth else live.filter(F.col("m") <= rules.split))

    def per_block(n: str, most: int) -> Column:
        return F.when(F.col(n) <= most, F.lit(1)).otherwise(F.ceil(F.col(n) * 2 / F.lit(most)))

    blocks = F.greatest(per_block("m", rules.tile), per_block("tokens", rules.tile_tokens)).cast("int")
    placed = leaves.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int"))
    keyed = leaves.groupBy("sid").agg(F.sort_array(F.collect_set("path")).alias("keys")).join(reps.select("sid", "sketch"), "sid")
    tiled = placed.select("path", "sid", "size", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select(
        "path", "sid", "size", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi")
    )
    n_rows = placed.agg(F.coalesce(F.sum("blocks"), F.lit(0)).alias("n")).first()["n"]
    # many small tiles are one group: a group of Arrow rows costs more than the pairs of a small tile
    groups = max(1, math.ceil(n_rows / _GROUP_ROWS))
    filled = tiled.join(keyed, "sid").select(F.pmod(F.xxhash64("path", "lo", "hi"), F.lit(groups)).alias("grp"), *_ROW)
    worth = tables.written(filled.groupBy("grp").applyInArrow(_worth_reading(rules), _TILE), "tiles")

    tokens = worth.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first()["n"]
    groups = max(1, math.ceil(tokens / _GROUP_TOKENS))
    wanted = worth.select("sid").distinct().join(reps.select("sid", "copy_of"), "sid")
    texts = tables.written(_texts_of(real, wanted).select("sid", "z"), "set-texts")
    again = worth.withColumn("grp", F.pmod(F.xxhash64("path", "lo", "hi"), F.lit(groups))).join(texts, "sid").select("grp", *_ROW, "z")
    return tables.written(again.groupBy("grp").applyInArrow(_links(rules), "sid binary, near binary, n_links bigint"), "links")


def _sets(rules: JoinRules):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = (shingles(text.as_py(), rules.words) for text in batch.column(1))
            sids = [set_id(s) if len(s) else None for s in found]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sids, pa.binary())], names=["doc_id", "__text", "sid"])

    return sets


def keep_first(docs: DataFrame, rules: JoinRules = JoinRules()) -> DataFrame:
    """``docs`` with one document of each class, that of the least id; repeated rows (same id and text) become one.

    An id with several texts is taken text by text: one that is a copy of an earlier document goes, the others stay. Rows with a null id all stay.
    """
    classes = _classes(docs, rules)
    # never broadcast, however few: what goes grows with the corpus
    gone = classes.filter("doc_id <> class_id").select("doc_id", "sid").distinct().hint("merge")
    twice = classes.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id")
    if not twice.limit(1).count():
        return docs.join(gone, "doc_id", "left_anti").select(*all_of(docs))
    twice = written(twice, "repeated-ids")
    once = docs.join(twice, "doc_id", "left_anti").join(gone, "doc_id", "left_anti").select(*all_of(docs))
    # only these rows are told apart by their text
    many = docs.join(twice, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]).withColumn("__text", F.encode("text", "UTF-8"))
    told = many.select(F.col("doc_id").cast("long").alias("doc_id"), "__text").mapInArrow(_sets(rules), "doc_id bigint, __text binary, sid binary")
    copies = told.join(gone, ["doc_id", "sid"], "left_semi").select("doc_id", "__text")
    return once.unionByName(many.join(copies, ["doc_id", "__text"], "left_anti").select(*all_of(docs)))
