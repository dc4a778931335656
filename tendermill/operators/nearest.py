"""The one text most alike another, by the edit distances of whole blocks of texts at a time."""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import _indel
from ..runtime import ship, written
from .alike import _tokens

#: Texts of each side in a cell; a cell is one task's unit of work, and all its pairs are compared.
LEFT, RIGHT = 16384, 16384
#: Signs of a rest that one machine word holds; a longer text is compared pair by pair.
WORD = 64


def _ratio(d, s: int, x, y: int):
    """The token-set ratio of two texts with ``s`` common signs and rests of ``x`` and ``y`` signs that are ``d`` apart."""
    g = 1 if s else 0
    whole = 1 - d / ((s + g + x) + (s + g + y))
    return whole if not g else np.maximum(whole, np.maximum(1 - (g + x) / (s + s + g + x), 1 - (g + y) / (s + s + g + y)))


def _bits(rests: list[str], kind: str) -> dict[str, np.ndarray]:
    """For each sign the places where each rest has it, as bits."""
    width = max(map(len, rests)) or 1
    signs = np.frombuffer("".join(t.ljust(width) for t in rests).encode("utf-32-le", "surrogatepass"), "uint32").reshape(len(rests), width)
    inside = np.arange(width) < np.array([len(t) for t in rests])[:, None]
    at = np.where(inside, np.left_shift(np.ones(1, kind), np.arange(width, dtype=kind), dtype=kind), np.zeros(1, kind))
    return {chr(c): np.where(signs == c, at, np.zeros(1, kind)).sum(axis=1, dtype=kind) for c in np.unique(signs[inside]).tolist()}


#: A place and, above it, a number of signs, packed into one whole number.
PLACES = 1 << 20


def _least(rests: list[str], others: list[tuple[str, int, np.ndarray | None]]) -> tuple[np.ndarray, np.ndarray]:
    """For each rest the unmatched signs and the place of the other text with the longest common subsequence; all others are equally long.

    A sign of another text is one step for all rests (Hyyrö's bit rows, as narrow as the rests allow), and steps of a common beginning
    are taken once. The third of an other are rests that it is not for; a rest that none is for has -1.
    """
    kind = next(k for k, n in (("uint16", 16), ("uint32", 32), ("uint64", 64)) if n >= max(map(len, rests)))
    pack = "int32" if max(at for _, at, _ in others) < PLACES else "int64"
    shift, none = (20 if pack == "int32" else 32), np.iinfo(pack).max
    bits, full = _bits(rests, kind), np.array([(1 << len(t)) - 1 for t in rests], kind)
    best = np.full(len(rests), none, pack)
    rows, before = [np.full(len(rests), np.iinfo(kind).max, kind)], ""
    for text, place, but in sorted(others, key=lambda o: o[:2]):
        same = next((i for i, (p, q) in enumerate(zip(before, text)) if p != q), min(len(before), len(text)))
        del rows[same + 1 :]
        for c in text[same:]:
            row, at = rows[-1], bits.get(c)
            if at is not None:
                hit = row & at
                row = (row + hit) | (row - hit)
            rows.append(row)
        found = np.bitwise_count(rows[-1] & full).astype(pack)
        found <<= shift
        found |= place
        if but is not None:
            found[but] = none
        np.minimum(best, found, out=best)
        before = text
    return np.where(best == none, -1, best >> shift).astype("int64"), (best & ((1 << shift) - 1)).astype("int64")


#: Pairs that a token may bring together one by one; a token that brings more parts the texts of a cell into kinds.
FEW = 4096


def _best(asked: list[list[str]], held: list[list[str]], floor: float) -> tuple[np.ndarray, np.ndarray]:
    """For each of ``asked`` the greatest ratio and the first place in ``held`` that has it, -1 under the floor; texts are sorted tokens."""
    ratio, place = np.zeros(len(asked)), np.full(len(asked), -1)

    def take(rows, value, at) -> None:
        better = (value > ratio[rows]) | ((value == ratio[rows]) & (at < place[rows]))
        better &= value >= floor
        ratio[rows[better]], place[rows[better]] = value[better], at[better]

    def alone(i: int, at: int) -> None:
        """A pair for itself."""
        mine, tokens = asked[i], held[at]
        both = set(mine).intersection(tokens)
        x, y = (" ".join(t for t in side if t not in both) for side in (mine, tokens))
        s = len(" ".join(t for t in tokens if t in both))
        value = 1.0 if s and not (x and y) else float(_ratio(_indel(x, y), s, len(x), len(y)))
        take(np.array([i]), np.array([value]), np.array([at]))

    sizes = [len(" ".join(t)) for t in asked]
    short = [i for i, n in enumerate(sizes) if n <= WORD]
    rows_of = defaultdict(list)
    for i in short:
        for t in asked[i]:
            rows_of[t].append(i)
    # a token that few pairs have in common, as a number, takes these pairs out; else each would part all texts of the cell
    met = Counter(t for tokens in held for t in tokens if t in rows_of)
    few = {t for t, n in met.items() if n * len(rows_of[t]) <= FEW}
    # texts that have the same tokens in common with anything here are compared together
    kinds, apart = defaultdict(list), {}
    for at, tokens in enumerate(held):
        kinds[tuple(t for t in tokens if t in rows_of and t not in few)].append(at)
        own = sorted({i for t in tokens if t in few for i in rows_of[t]})
        if own:
            apart[at] = np.array(own)
            for i in own:
                alone(i, at)
    spot = np.full(len(asked), -1)
    for known, places in kinds.items():
        common = defaultdict(list)
        for t in known:
            for i in rows_of[t]:
                common[i].append(t)
        split = defaultdict(list)
        for i in short:
            split[tuple(common.get(i, ()))].append(i)
        for shared, members in split.items():
            drop, s, rows = set(shared), len(" ".join(shared)), np.array(members)
            rests = [" ".join(t for t in asked[i] if t not in drop) for i in members]
            x = np.array([len(t) for t in rests])
            spot[rows] = np.arange(len(rows))
            by_length = defaultdict(list)
            for at in places:
                y = " ".join(t for t in held[at] if t not in drop)
                but = apart.get(at)
                if but is not None:
                    but = spot[but]
                    but = but[but >= 0]
                by_length[len(y)].append((y, at, but))
            for y, others in by_length.items():
                if y == 0:
                    take(rows, np.ones(len(rows)), np.full(len(rows), min(at for _, at, _ in others)))
                    continue
                left, at = _least(rests, others)
                value = np.where(left < 0, 0.0, _ratio(x + y - 2 * (x - left), s, x, y))
                inside = (x == 0) if s else np.zeros(len(x), bool)
                take(rows, np.where(inside, 1.0, value), np.where(inside, min(at for _, at, _ in others), at))
            spot[rows] = -1
    for i in set(range(len(asked))) - set(short):
        for at in range(len(held)):
            alone(i, at)
    return ratio, place


def nearest(left: DataFrame, right: DataFrame, group: str, a: str, b: str, rank: str, floor: float, out: str = "relevancia") -> DataFrame:
    """``group, a, rank, out``: for each text of ``left`` the row of ``right`` in its group that is most alike by ``token_set_ratio``.

    Of equally good rows the least ``rank`` (a whole number) wins; nothing under ``floor`` is found. A null group meets nothing; null and blank texts are like nothing.
    Distinct texts of a group are dealt out in cells of ``LEFT`` by ``RIGHT``, whose number follows the counted texts. In a cell all pairs are compared, but no pair is
    made as a row: a sign of one text is one step for all texts of the other side.
    """
    if not 0 < floor <= 1:
        raise ValueError("floor must be over 0 and at most 1")
    ship(left.sparkSession)
    some = (F.size("t") > 0) & F.col("g").isNotNull()
    mine = left.select(F.col(group).alias("g"), F.col(a).alias("text")).distinct().withColumn("t", _tokens(F.col("text"))).filter(some)
    # of the rows with the same tokens only the least can be found
    theirs = right.select(F.col(group).alias("g"), _tokens(F.col(b)).alias("t"), F.col(rank).cast("long").alias("r")).filter(some).groupBy("g", "t").agg(F.min("r").alias("r"))
    blocks = lambda df, n, c: df.groupBy("g").agg(F.ceil(F.count("*") / n).cast("int").alias(c))
    theirs = written(theirs, "nearest-held")
    held = blocks(theirs, RIGHT, "nj")
    most_cells = held.agg(F.max("nj")).first()[0] or 0
    cells = blocks(mine, LEFT, "ni").join(held, "g")
    part = lambda n: F.pmod(F.xxhash64(F.array_join("t", " ")), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    mine = mine.join(cells, "g").withColumn("i", part("ni")).withColumn("j", every("nj")).select("g", "i", "j", "t", "text")
    theirs = theirs.join(cells, "g").withColumn("j", part("nj")).withColumn("i", every("ni")).select("g", "i", "j", "t", "r")

    def cell(one: pa.Table, two: pa.Table) -> pa.Table:
        two = two.sort_by("r")
        ratio, place = _best(one["t"].to_pylist(), two["t"].to_pylist(), floor)
        kept = np.flatnonzero(place >= 0)
        return pa.table({"g": one["g"].take(kept), "text": one["text"].take(kept), "r": two["r"].take(place[kept]), "ratio": pa.array(ratio[kept], "float64")})

    kind = left.schema[group].dataType.simpleString()
    pairs = mine.groupBy("g", "i", "j").cogroup(theirs.groupBy("g", "i", "j")).applyInArrow(cell, f"g {kind}, text string, r long, ratio double")
    # a text that met all others of its group in one cell is found once
    if most_cells > 1:
        best = pairs.groupBy("g", "text").agg(F.max_by(F.struct("r", "ratio"), F.struct("ratio", -F.col("r"))).alias("m")).select("g", "text", "m.*")
    else:
        best = pairs
    return best.select(F.col("g").alias(group), F.col("text").alias(a), F.col("r").alias(rank), F.col("ratio").alias(out))
