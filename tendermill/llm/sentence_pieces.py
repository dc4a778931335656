"""SentencePiece encoding that keeps offsets: every piece knows the bytes of the original text it came from."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StringType, StructField

from ..runtime import ship
from .common import map_rows, without
from .token_output import _gather, _some_at_a_time

#: The sign that stands for a space, and its bytes.
MARK = "▁"
_MARK_BYTES = np.frombuffer(MARK.encode(), dtype=np.uint8)
#: Parts of texts whose pieces a worker remembers before it forgets all of them (about 200 bytes each).
CACHE_PARTS = 400_000
#: Bytes of text that a task encodes at a time, or one text.
TEXT_BYTES = 1_000_000
#: Parts of at most so many signs are merged many at a time; longer ones alone, in time that grows with n log n.
SHORT = 48
_NORMAL, _UNKNOWN, _CONTROL, _BYTE = 1, 2, 3, 6
_BPE = 2


class CharMap:
    """A compiled character map: a double-array trie over UTF-8 keys, whose values are places in a block of replacements."""

    def __init__(self, compiled: bytes):
        size = int.from_bytes(compiled[:4], "little")
        self.units = np.frombuffer(compiled, dtype="<u4", count=size // 4, offset=4)
        self._list = self.units.tolist()  # single steps are faster over a list
        self.values = compiled[4 + size :]
        self.trigger = self._trigger()

    def _step(self, at: np.ndarray, byte: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """From nodes by bytes, all at once: the next nodes, which of them exist, and which end a key."""
        child = np.minimum(at ^ byte, len(self.units) - 1)
        unit = self.units[child].astype(np.int64)
        there = (unit & 0x800000FF) == byte
        return child ^ ((unit >> 10) << ((unit & 512) >> 6)), there, there & ((unit >> 8) & 1 == 1)

    def _roots(self, n: int) -> np.ndarray:
        unit = self._list[0]
        return np.full(n, (unit >> 10) << ((unit & 512) >> 6), dtype=np.int64)

    def _trigger(self) -> re.Pattern[str]:
        """Finds where a key may start: signs that are keys themselves, and first signs of longer keys before a sign that can follow one."""
        points = np.array([p for p in range(0x110000) if not 0xD800 <= p < 0xE000], dtype=np.int64)
        coded = [chr(p).encode() for p in points.tolist()]
        wide = np.array([len(c) for c in coded])
        at, alive, key = self._roots(len(points)), np.ones(len(points), bool), np.zeros(len(points), bool)
        for i in range(4):
            has = np.flatnonzero(alive & (wide > i))
            nxt, there, ends = self._step(at[has], np.array([coded[k][i] for k in has], dtype=np.int64))
            at[has], alive[has] = nxt, there
            key[has] = ends & (wide[has] == i + 1)
        first = np.flatnonzero(alive & ~key)
        seconds = [b for b in range(128) if len(first) and self._step(at[first], np.full(len(first), b, dtype=np.int64))[1].any()]
        # what is not ASCII is not told apart here: a false start costs one look into the trie
        follow = "[" + "".join(re.escape(chr(b)) for b in seconds) + r"\u0080-\U0010ffff]"
        kinds = [f"[{_ranges(points[key])}]"] if key.any() else []
        kinds += [f"[{_ranges(points[first])}](?={follow})"] if len(first) else []
        return re.compile("|".join(kinds) or r"(?!)")

    def longest(self, text: bytes, start: int) -> tuple[bytes, int] | None:
        """The replacement of the longest key at a byte of the text, and the key's length; none if no key is there."""
        units, found = self._list, None
        unit = units[0]
        at = (unit >> 10) << ((unit & 512) >> 6)
        for i in range(start, len(text)):
            at ^= text[i]
            if at >= len(units) or units[at] & 0x800000FF != text[i]:
                break
            unit = units[at]
            at ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit >> 8 & 1:
                found = (units[at] & 0x7FFFFFFF, i + 1 - start)
        if not found:
            return None
        value, length = found
        return self.values[value : self.values.index(b"\0", value)], length


def _ranges(points: np.ndarray) -> str:
    cuts = np.flatnonzero(np.diff(points) != 1) + 1
    return "".join(f"\\U{int(r[0]):08x}-\\U{int(r[-1]):08x}" for r in np.split(points, cuts))


class Normalizer:
    """Rewrites a text as the model's normaliser does, and keeps for every byte of the result where it came from."""

    def __init__(self, spec, suffix: bool):
        self.map = CharMap(spec.precompiled_charsmap) if spec.precompiled_charsmap else None
        self.collapse, self.escape = spec.remove_extra_whitespaces, spec.escape_whitespaces
        self.front, self.back = spec.add_dummy_prefix and not suffix, spec.add_dummy_prefix and suffix

    def __call__(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text, and for each of its bytes, and its end, the byte of the original (of a replaced key: its first)."""
        raw = text.encode()
        if not raw:
            return "", np.zeros(1, dtype=np.int64)
        data, origin, unit = self._mapped(text, raw)
        space = data == 32
        if self.collapse:
            keep = ~self._extra(space, unit)
            data, origin, space = data[keep], origin[keep], space[keep]
            if not len(data):
                return "", np.zeros(1, dtype=np.int64)
        end = len(raw)
        wide = 3 if self.escape else 1
        if self.escape:
            times = np.where(space, 3, 1)
            at = np.cumsum(times)[space]
            data, origin = np.repeat(data, times), np.repeat(origin, times)
            for i in range(3):
                data[at - 3 + i] = _MARK_BYTES[i]
        blank = MARK if self.escape else " "
        out = data.tobytes().decode()
        if self.front:
            # spaces that were taken away in front of it lie before the mark, too
            out, origin = blank + out, np.concatenate([np.full(wide, origin[0] if self.collapse else 0), origin])
        if self.collapse:
            short = out.rstrip(blank)
            if len(short) < len(out):
                size = len(origin) - wide * (len(out) - len(short))
                end, out, origin = int(origin[size]), short, origin[:size]
        if self.back:
            out, origin = out + blank, np.concatenate([origin, np.full(wide, end)])
        return out, np.append(origin, end)

    def _mapped(self, text: str, raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes after the character map, where each came from, and where the key or byte that made it starts in the result."""
        runs: list[tuple[bytes, int, int]] = []  # a replacement, the key's first byte and its end
        if self.map:
            upto_char, upto_byte = 0, 0
            for hit in self.map.trigger.finditer(text):
                upto_byte += len(text[upto_char : hit.start()].encode())
                upto_char = hit.start()
                if runs and upto_byte < runs[-1][2]:
                    continue  # inside the key before
                found = self.map.longest(raw, upto_byte)
                if found:
                    runs.append((found[0], upto_byte, upto_byte + found[1]))
        if not runs:
            every = np.arange(len(raw))
            return np.frombuffer(raw, dtype=np.uint8), every, every
        parts, origins, lead, at, size = [], [], [], 0, 0
        for new, lo, hi in [*runs, (b"", len(raw), len(raw))]:
            parts += [raw[at:lo], new]
            origins += [np.arange(at, lo), np.full(len(new), lo)]
            lead += [np.arange(size, size + lo - at), np.full(len(new), size + lo - at)]
            at, size = hi, size + lo - at + len(new)
        return np.frombuffer(b"".join(parts), dtype=np.uint8), np.concatenate(origins), np.concatenate(lead)

    @staticmethod
    def _extra(space: np.ndarray, unit: np.ndarray) -> np.ndarray:
        """Spaces that lead what one key (or byte) made, after something that ended with a space, or at the start."""
        before = np.where(unit > 0, space[unit - 1], True)
        other = np.cumsum(~space)
        leads = other == np.where(unit > 0, other[unit - 1], 0)  # nothing but spaces since the key's result began
        return space & before & leads


class _Pairs:
    """Merges many short parts at once: in each round, every part merges its best pair."""

    def __init__(self, pieces: dict[str, tuple[float, int]], n: int):
        order = {score: r for r, score in enumerate(sorted({s for s, _ in pieces.values()}, reverse=True))}
        self.n, self.none = n, len(order)
        self.of_char = np.full(0x110000, -1, dtype=np.int64)
        self.wide = np.zeros(n, dtype=np.int64)
        found = {}
        for piece, (score, i) in pieces.items():
            self.wide[i] = len(piece.encode())
            if len(piece) == 1:
                self.of_char[ord(piece)] = i
            for k in range(1, len(piece)):
                if piece[:k] in pieces and piece[k:] in pieces:
                    found[pieces[piece[:k]][1] * n + pieces[piece[k:]][1]] = (order[score], i)
        self.keys = np.array(sorted(found), dtype=np.int64)
        self.ranks, self.made = (np.array([found[k][j] for k in self.keys.tolist()], dtype=np.int64) for j in (0, 1))

    def _look(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.keys):
            return np.full(len(left), self.none), left
        key = left * self.n + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], self.none), self.made[at]

    def merged(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all parts behind each other, and how many each has: 0 for a part with a sign that is no piece."""
        if not parts:
            return np.zeros(0, dtype="<u4"), np.zeros(0, dtype=np.int64)
        symbol = self.of_char[np.frombuffer("".join(parts).encode("utf-32-le"), dtype="<u4")]
        owner = np.repeat(np.arange(len(parts)), np.array([len(p) for p in parts]))
        bad = np.zeros(len(parts), dtype=bool)
        bad[owner[symbol < 0]] = True
        symbol, owner = symbol[~bad[owner]], owner[~bad[owner]]
        if not len(symbol):
            return np.zeros(0, dtype="<u4"), np.zeros(len(parts), dtype=np.int64)
        rank, made = self._look(symbol, np.append(symbol[1:], 0))
        rank[np.append(owner[1:] != owner[:-1], True)] = self.none
        ready: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbol):
            heads = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            best = np.repeat(np.minimum.reduceat(rank, heads), np.diff(np.append(heads, len(owner))))
            live = best < self.none
            ready.append((owner[~live], symbol[~live]))
            symbol, owner, rank, made, best = symbol[live], owner[live], rank[live], made[live], best[live]
            hit = np.flatnonzero(rank == best)
            hit = hit[np.append(True, owner[hit[1:]] != owner[hit[:-1]])] if len(hit) else hit  # the leftmost of each part
            symbol[hit] = made[hit]
            stay = np.ones(len(symbol), dtype=bool)
            stay[hit + 1] = False
            rank[hit] = self.none
            symbol, owner, rank, made = symbol[stay], owner[stay], rank[stay], made[stay]
            at = hit - np.arange(len(hit))
            for p in (at, at - 1):
                p = p[(p >= 0) & (p + 1 < len(owner))]
                p = p[owner[p] == owner[p + 1]]
                rank[p], made[p] = self._look(symbol[p], symbol[p + 1])
        owners, symbols = (np.concatenate([r[k] for r in ready]) for k in (0, 1))
        order = np.argsort(owners, kind="stable")
        return symbols[order].astype("<u4"), np.bincount(owners, minlength=len(parts))


class Encoder:
    """Encodes texts by the pieces of one model file; parts of texts are remembered for the worker's life, within bounds."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor
        from sentencepiece import sentencepiece_model_pb2 as pb

        self.library = SentencePieceProcessor(model_file=path)
        model = pb.ModelProto()
        model.ParseFromString(self.library.serialized_model_proto())
        trainer = model.trainer_spec
        kinds = {p.type for p in model.pieces}
        if trainer.model_type != _BPE or not trainer.byte_fallback or kinds - {_NORMAL, _UNKNOWN, _CONTROL, _BYTE}:
            raise ValueError("only merging (BPE) models with byte fallback and without unused or user-defined pieces can be encoded")
        self.normalize = Normalizer(model.normalizer_spec, trainer.treat_whitespace_as_suffix)
        self.pieces = {p.piece: (p.score, i) for i, p in enumerate(model.pieces) if p.type == _NORMAL}
        self.pairs = _Pairs(self.pieces, len(model.pieces))
        self.bytes = [self.library.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.bos, self.eos = self.library.bos_id(), self.library.eos_id()
        self.part = self._cutter()
        self._forget()

    def _cutter(self) -> re.Pattern[str]:
        """Cuts a text where no piece can reach over: around signs that no longer piece has, and before marks that no piece has inside."""
        longer = [p for p in self.pieces if len(p) > 1]
        joined = np.array(sorted({ord(c) for p in longer for c in p} - {ord(MARK)}), dtype=np.int64)
        inner = _ranges(joined)
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in longer):
            return re.compile(f"[{MARK}{inner}]+|[^{MARK}{inner}]")
        return re.compile(f"{MARK}*[{inner}]+|{MARK}+|[^{inner}]")

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.wide = np.zeros(0, dtype="<u4"), np.zeros(0, dtype=np.int64)
        self.starts, self.sizes = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def merged(self, part: str) -> tuple[list[int], list[int]]:
        """Ids of a part, and the bytes that each covers: the best-scored neighbours are merged first, of equals the leftmost."""
        text = list(part)
        last = len(text) - 1
        after, before = list(range(1, last + 2)), list(range(-1, last))
        heap: list[tuple[float, int, int, str]] = []

        def offer(left: int, right: int) -> None:
            both = text[left] + text[right]
            if both in self.pieces:
                heappush(heap, (-self.pieces[both][0], left, right, both))

        for i in range(last):
            offer(i, i + 1)
        while heap:
            _, left, right, both = heappop(heap)
            if not text[left] or not text[right] or len(text[left]) + len(text[right]) != len(both) or after[left] != right:
                continue
            text[left], text[right] = both, ""
            after[left] = after[right]
            if after[left] <= last:
                before[after[left]] = left
                offer(left, after[left])
            if before[left] >= 0:
                offer(before[left], left)
        ids, wide = [], []
        for symbol in text:
            if symbol in self.pieces:
                ids.append(self.pieces[symbol][1])
                wide.append(len(symbol.encode()))
            elif symbol:  # no piece: its bytes, the last of which covers the sign
                raw = symbol.encode()
                ids += [self.bytes[b] for b in raw]
                wide += [0] * (len(raw) - 1) + [len(raw)]
        return ids, wide

    def _numbers(self, parts: list[str]) -> np.ndarray:
        if len(self.known) > CACHE_PARTS:
            self._forget()
        found = list(map(self.known.get, parts))
        unknown = [k for k, i in enumerate(found) if i is None]
        if unknown:
            new = list(dict.fromkeys([parts[k] for k in unknown]))
            short = np.array([len(p) <= SHORT for p in new])
            some, which = [new[k] for k in np.flatnonzero(short)], np.flatnonzero(short)
            flat, sizes = self.pairs.merged(some)
            alone = which[sizes == 0].tolist() + np.flatnonzero(~short).tolist()  # long ones, and those with a sign that is no piece
            rest = [self.merged(new[k]) for k in alone]
            counts = np.zeros(len(new), dtype=np.int64)
            counts[which] = sizes
            order = np.concatenate([which[sizes > 0], np.array(alone, dtype=np.int64)])
            counts[alone] = [len(ids) for ids, _ in rest]
            starts = np.zeros(len(new), dtype=np.int64)
            starts[order] = len(self.flat) + np.cumsum(counts[order]) - counts[order]
            self.known.update(zip(new, range(len(self.sizes), len(self.sizes) + len(new)), strict=True))
            self.starts, self.sizes = np.concatenate([self.starts, starts]), np.concatenate([self.sizes, counts])
            self.flat = np.concatenate([self.flat, flat, np.array([i for ids, _ in rest for i in ids], dtype="<u4")])
            self.wide = np.concatenate([self.wide, self.pairs.wide[flat], np.array([w for _, wide in rest for w in wide], dtype=np.int64)])
            for k in unknown:
                found[k] = self.known[parts[k]]
        return np.array(found, dtype=np.int64)

    def many(self, texts: list[str], ends: bool = True) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Of each whole text its ids, and of each id the first byte of the original that it covers and the byte after its last."""
        normal = [self.normalize(t) for t in texts]
        parts = [self.part.findall(n) for n, _ in normal]
        index = self._numbers([p for ps in parts for p in ps])
        flat, upto = _gather(self.flat, self.starts, self.sizes, index)
        wide, _ = _gather(self.wide, self.starts, self.sizes, index)
        bounds = upto[np.cumsum([0, *map(len, parts)])].tolist()
        out = []
        for lo, hi, (_, origin) in zip(bounds, bounds[1:], normal):
            ids, at = flat[lo:hi], np.concatenate([[0], np.cumsum(wide[lo:hi])])
            first, after = origin[at[:-1]], origin[at[1:]]
            out.append((ids, first, after))
        if not ends:
            return out
        sizes = [len(t.encode()) for t in texts]
        bos, eos = np.array([self.bos], dtype="<u4"), np.array([self.eos], dtype="<u4")
        return [(np.concatenate([bos, i, eos]), np.concatenate([[0], a, [n]]), np.concatenate([[0], b, [n]])) for (i, a, b), n in zip(out, sizes, strict=True)]

    def __call__(self, text: str, ends: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.many([text], ends)[0]


@lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def encode(docs: DataFrame, model: str, text: str = "text", ends: bool = True, decoded: bool = False) -> DataFrame:
    """``docs`` with the piece ids of ``text`` (``ids``: binary, 32 bits each, little-endian) and the original bytes of each piece.

    ``model`` is a sentencepiece file (BPE with byte fallback) that every executor has. ``begins`` and ``ends`` (arrays of int) say
    which bytes of the UTF-8 text a piece covers: ``text[begin:end]``. A sign without a piece becomes its bytes; the last of them
    covers the sign, those before are empty at its start. Begin and end ids (``ends=True``) are empty at 0 and at the text's
    length. A replaced stretch of text belongs as a whole to the pieces that start in its replacement. A null or empty text has no piece
    but the begin and end ids. All other columns pass; ones named ``ids``, ``begins``, ``ends`` (or ``decoded``) are replaced. Repeated rows are
    encoded each. ``decoded=True`` adds what ``decode`` adds, in the same pass. Nothing is shuffled; a task holds 1 MB of text, or one
    text, at a time.
    """
    ship(docs.sparkSession)
    docs = without(docs, ["ids", "begins", "ends", *["decoded"] * decoded])
    at = [c.lower() for c in docs.columns].index(text.lower())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(model)
        for batch in batches:
            for lo, hi in _some_at_a_time(batch.column(at), TEXT_BYTES):
                some = batch.slice(lo, hi - lo)
                coded = encoder.many([t or "" for t in some.column(at).to_pylist()], ends)
                counts = pa.array(np.cumsum([0, *(len(c[0]) for c in coded)]), pa.int32())
                spans = [pa.ListArray.from_arrays(counts, pa.array(np.concatenate([c[k] for c in coded]), pa.int32())) for k in (1, 2)]
                ids = pa.array([c[0].tobytes() for c in coded], pa.binary())
                yield pa.RecordBatch.from_arrays([*some.columns, ids, *spans], names=[*some.schema.names, "ids", "begins", "ends"])

    spans = ArrayType(IntegerType())
    added = [StructField("ids", BinaryType()), StructField("begins", spans), StructField("ends", spans)]
    if not decoded:
        return map_rows(docs, run, added)
    ids = len(docs.columns)
    return map_rows(docs, lambda batches: _decoded(run(batches), ids, model), [*added, StructField("decoded", StringType())])


def _decoded(batches: Iterator[pa.RecordBatch], at: int, model: str) -> Iterator[pa.RecordBatch]:
    """Batches with the library's text of the ids in column ``at``."""
    library = _encoder(model).library
    for batch in batches:
        for lo, hi in _some_at_a_time(batch.column(at), TEXT_BYTES):
            some = batch.slice(lo, hi - lo)
            ids = [None if raw is None else np.frombuffer(raw, dtype="<u4").tolist() for raw in some.column(at).to_pylist()]
            known = [i for i in ids if i is not None]
            texts = iter(library.decode(known, num_threads=1) if known else [])
            out = pa.array([None if i is None else next(texts) for i in ids], pa.string())
            yield pa.RecordBatch.from_arrays([*some.columns, out], names=[*some.schema.names, "decoded"])


def decode(coded: DataFrame, model: str) -> DataFrame:
    """``coded`` (with ``ids`` as ``encode`` writes them) with ``decoded``, the library's own text of the ids; null ids give null."""
    ship(coded.sparkSession)
    coded = without(coded, ["decoded"])
    at = [c.lower() for c in coded.columns].index("ids")

    return map_rows(coded, lambda batches: _decoded(batches, at, model), [StructField("decoded", StringType())])
