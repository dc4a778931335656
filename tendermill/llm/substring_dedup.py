"""Substring dedup: suffix automata of reference shards, through which documents stream for matching statistics.

An automaton of the whole corpus is neither buildable nor broadcastable, and sending every shard to every document costs the
square of the corpus. So a window of words is named by the least hash among its shorter word runs (its anchor): documents that
share a window share its anchor, and only stretches of text whose anchor two documents share go on. Equal stretches become
one. A shard holds all stretches of some anchors: its automaton is built from them, and they alone stream through it.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import ship
from .common import all_of, Tables, without, written

#: Words of the runs whose least hash names a window.
GRAM = 4
#: Words of a reference shard, on average; an automaton has two states a word at most, about 400 bytes each.
SHARD_WORDS = 100_000
#: An anchor in more documents than this is too common to name a shard; its windows are then shared out by their own hash.
COMMON_ANCHOR = 1_000
#: Windows of a stretch at most, so that a long holds a bit for each.
MAX_STRETCH = 48


def split_words(data: bytes | None) -> list[bytes]:
    """Words of UTF-8 text between ASCII white space."""
    return (data or b"").split()


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


def anchors_of(words: list[bytes], window: int) -> np.ndarray:
    """The anchor of every window of a text, as signed 64-bit integers."""
    n = len(words) - window + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    gram = min(GRAM, window)
    h = _hashes(words)
    g = np.zeros(len(h) - gram + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(gram):
            g = g * np.uint64(0x9E3779B97F4A7C15) + h[j : j + len(g)]
        g ^= g >> np.uint64(32)
        g *= np.uint64(0xD6E8FEB86659FD93)
        g ^= g >> np.uint64(32)
    least = g[: n].copy()
    for j in range(1, window - gram + 1):
        np.minimum(least, g[j : j + n], out=least)
    return least.view(np.int64)


def _sequence_hash(words: list[bytes]) -> bytes:
    return xxhash.xxh3_128_digest(b" ".join(words))


class SuffixAutomaton:
    """The substrings of reference texts, each with the least owner of a text that has it."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.owner = [-1], [0], [None]

    def _state(self, length: int, follow: dict[int, int], link: int, owner: int) -> int:
        self.next.append(follow)
        self.length.append(length)
        self.link.append(link)
        self.owner.append(owner)
        return len(self.length) - 1

    def _split(self, last: int, q: int, c: int, owner: int) -> int:
        copy = self._state(self.length[last] + 1, dict(self.next[q]), self.link[q], min(owner, self.owner[q]))
        self.link[q] = copy
        p = last
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def add(self, text: list[int], owner: int) -> None:
        last = 0
        for c in text:
            q = self.next[last].get(c)
            if q is not None:
                last = q if self.length[q] == self.length[last] + 1 else self._split(last, q, c, owner)
                self.owner[last] = min(self.owner[last], owner)
                continue
            new = self._state(self.length[last] + 1, {}, 0, owner)
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = new
                p = self.link[p]
            if p >= 0:
                q = self.next[p][c]
                self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, c, owner)
            last = new

    def finish(self) -> None:
        """Hands owners down to suffixes."""
        for v in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            up = self.link[v]
            if up > 0:
                self.owner[up] = min(self.owner[up], self.owner[v])

    def older(self, text: list[int], owner: int, window: int) -> list[int]:
        """Starts of windows of ``text`` that a text of a smaller owner has, by the longest match that ends at each word."""
        found, v, matched = [], 0, 0
        for i, c in enumerate(text):
            while v and c not in self.next[v]:
                v = self.link[v]
                matched = self.length[v]
            if c in self.next[v]:
                v = self.next[v][c]
                matched += 1
            while self.link[v] > 0 and self.length[self.link[v]] >= window:
                v = self.link[v]
                matched = min(matched, self.length[v])
            if matched >= window and self.owner[v] < owner:
                found.append(i - window + 1)
        return found


def _signatures(window: int):
    def signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, seqs, anchors = [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = split_words(text.as_py())
                if doc is None or len(words) < window:
                    continue
                ids.append(doc)
                seqs.append(_sequence_hash(words))
                anchors.append(np.unique(anchors_of(words, window)))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(seqs, pa.binary()), pa.array(anchors, pa.list_(pa.int64()))], names=["doc_id", "seq", "anchors"])

    return signatures


_STRETCH = "key bigint, stretch binary, doc_id bigint, seq binary, start int, n int, words binary"


def _stretches(window: int):
    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for doc, text, seq, rare, common in zip(*[batch.column(i) for i in range(5)], strict=True):
                words = split_words(text.as_py())
                if _sequence_hash(words) != seq.as_py():
                    continue  # another text with the same id
                doc, seq = doc.as_py(), seq.as_py()
                anchors = anchors_of(words, window)
                for keys, single in ((rare, False), (common, True)):
                    keys = np.array(keys.as_py() or [], dtype=np.int64)
                    at = np.flatnonzero(np.isin(anchors, keys))
                    if not len(at):
                        continue
                    cut = np.ones(len(at), dtype=bool)
                    if not single:
                        cut[1:] = (np.diff(at) != 1) | (anchors[at[1:]] != anchors[at[:-1]])
                    for lo, hi in zip(np.flatnonzero(cut).tolist(), [*np.flatnonzero(cut)[1:].tolist(), len(at)], strict=True):
                        for s in range(int(at[lo]), int(at[lo]) + hi - lo, MAX_STRETCH):
                            n = min(MAX_STRETCH, int(at[lo]) + hi - lo - s)
                            part = b" ".join(words[s : s + n + window - 1])
                            key = int(np.uint64(xxhash.xxh3_64_intdigest(part)).astype(np.int64)) if single else int(anchors[s])
                            rows.append((key, xxhash.xxh3_128_digest(part), doc, seq, s, n, part))
                if len(rows) > 20_000:
                    yield _batch(rows)
                    rows = []
            yield _batch(rows)

    return stretches


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.binary()]
    columns = list(zip(*rows, strict=True)) if rows else [()] * 7
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[f.split()[0] for f in _STRETCH.split(", ")])


def _covered(window: int):
    def covered(shard: pa.Table) -> pa.Table:
        keys, names, owners = shard["key"].to_pylist(), shard["stretch"].to_pylist(), shard["owner"].to_pylist()
        alike = Counter(keys)
        number: dict[bytes, int] = {}
        texts = {
            i: [number.setdefault(w, len(number)) for w in split_words(words)]
            for i, words in enumerate(shard["words"].to_pylist())
            if alike[keys[i]] > 1
        }
        automaton = SuffixAutomaton()
        for i, text in texts.items():
            automaton.add(text, owners[i])
        automaton.finish()
        bits = [0] * len(keys)
        for i, text in texts.items():
            for s in automaton.older(text, owners[i], window):
                bits[i] |= 1 << s
        return pa.table([pa.array(keys, pa.int64()), pa.array(names, pa.binary()), pa.array(owners, pa.int64()), pa.array(bits, pa.int64())], names=["key", "stretch", "owner", "bits"])

    return covered


def repeated_spans(docs: DataFrame, window: int = 13) -> DataFrame:
    """``doc_id, seq, spans`` for documents (``doc_id, text``) with windows that a document of smaller id has.

    ``seq`` is a 128-bit hash of the document's words. ``spans`` is an array of (``seq, start, n, bits``): from word ``start`` on, the
    windows whose bit is set, or all ``n`` if ``bits`` is null; ``start`` -1 stands for the whole document.
    """
    spark = docs.sparkSession
    ship(spark)
    with Tables(spark) as tables:
        return written(_spans(tables, docs, window), "spans")


def _spans(tables: Tables, docs: DataFrame, window: int) -> DataFrame:
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.encode("text", "UTF-8").alias("text"))
    signed = texts.mapInArrow(_signatures(window), "doc_id bigint, seq binary, anchors array<bigint>")
    signed = tables.written(signed, "signatures")
    # texts with the same words all over: the first stands for all
    reps = signed.groupBy("seq").agg(F.min(F.struct("doc_id", "anchors")).alias("r")).select("seq", "r.doc_id", "r.anchors")
    reps = tables.written(reps, "first-texts")
    copies = signed.select("doc_id", "seq").join(reps.select("seq", F.col("doc_id").alias("first_id")), "seq").filter("doc_id > first_id")

    each = reps.select("doc_id", "seq", F.explode("anchors").alias("anchor"))
    shared = each.groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.count("*").alias("n")).filter("a < b").select("anchor", (F.col("n") > COMMON_ANCHOR).alias("common"))
    wanted = (
        each.join(shared, "anchor")
        .groupBy("doc_id", "seq")
        .agg(F.collect_list(F.when(~F.col("common"), F.col("anchor"))).alias("rare"), F.collect_list(F.when(F.col("common"), F.col("anchor"))).alias("common"))
    )
    wanted = tables.written(wanted, "shared-anchors")
    stretches = texts.join(wanted, "doc_id").select("doc_id", "text", "seq", "rare", "common").mapInArrow(_stretches(window), _STRETCH)
    stretches = tables.written(stretches, "stretches")

    alike = stretches.groupBy("key", "stretch").agg(F.min("doc_id").alias("owner"), F.first("n").alias("n"), F.first("words").alias("words"))
    alike = tables.written(alike, "distinct-stretches")
    total = alike.agg(F.coalesce(F.sum(F.col("n") + window - 1), F.lit(0)).alias("w")).first()["w"]
    shards = max(1, -(-int(total) // SHARD_WORDS))
    judged = (
        alike.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)))
        .groupBy("shard")
        .applyInArrow(_covered(window), "key bigint, stretch binary, owner bigint, bits bigint")
    )
    hits = (
        stretches.select("key", "stretch", "doc_id", "seq", "start", "n")
        .join(judged, ["key", "stretch"])
        .filter("doc_id > owner or bits <> 0")
        .select("doc_id", "seq", "start", "n", F.when(F.col("doc_id") > F.col("owner"), F.lit(None)).otherwise(F.col("bits")).alias("bits"))
    )
    whole = copies.select("doc_id", "seq", F.lit(-1).alias("start"), F.lit(0).alias("n"), F.lit(None).cast("bigint").alias("bits"))
    spans = hits.unionByName(whole).groupBy("doc_id").agg(F.collect_list(F.struct("seq", "start", "n", "bits")).alias("spans"))
    return spans


def _clean(window: int, width: int, text_at: int):
    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept_text, n_words, n_removed = [], [], []
            for text, spans in zip(batch.column(text_at), batch.column(width), strict=True):
                text, spans = text.as_py(), spans.as_py()
                words = split_words(text.encode("utf-8") if text else None)
                gone = 0
                if spans and len(words) >= window:
                    seq = _sequence_hash(words)
                    starts = np.zeros(len(words) + 1, dtype=np.int32)
                    for s in spans:
                        if s["seq"] != seq:
                            continue  # of another text with the same id
                        if s["start"] < 0:
                            starts[: len(words) - window + 1] = 1
                        elif s["bits"] is None:
                            starts[s["start"] : s["start"] + s["n"]] = 1
                        else:
                            for j in range(s["n"]):
                                if s["bits"] >> j & 1:
                                    starts[s["start"] + j] = 1
                    ends = np.zeros(len(words) + window + 1, dtype=np.int32)
                    ends[: len(starts)] += starts
                    ends[window : window + len(starts)] -= starts
                    drop = np.cumsum(ends)[: len(words)] > 0
                    gone = int(drop.sum())
                    total = len(words)
                    words = [w for w, d in zip(words, drop.tolist(), strict=True) if not d]
                else:
                    total = len(words)
                kept_text.append(b" ".join(words).decode("utf-8"))
                n_words.append(total)
                n_removed.append(gone)
            columns = [batch.column(j) for j in range(width)] + [pa.array(kept_text, pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:width], "clean_text", "n_words", "n_removed"])

    return clean


def drop_repeats(docs: DataFrame, window: int = 13) -> DataFrame:
    """``docs`` with ``clean_text`` (kept words, joined by one space), ``n_words`` and ``n_removed`` (long); columns of these names are replaced.

    A word goes if a window of ``window`` words covers it that also starts in a document of smaller ``doc_id``; windows are judged on
    the input, not on what is left. Words are what lies between ASCII white space, unchanged; a null text has none. Rows of the
    same id are no repeats of each other; rows with a null id lose nothing and take nothing from others. Other columns pass through.

    Exact: 64-bit hashes only choose what is compared; automata compare the words, and equal stretches and whole texts are told by
    128-bit hashes. No group is unbounded: hot texts, stretches and anchors are counted after adding up in each task, common anchors are
    spread by window, a shard's words are bounded on average by ``SHARD_WORDS``, and joins on a hot key can be split by AQE.
    """
    docs = without(docs, ["clean_text", "n_words", "n_removed"])
    spans = repeated_spans(docs, window)
    both = docs.join(spans.select(F.col("doc_id").alias("__id"), F.col("spans").alias("__spans")), F.col("doc_id") == F.col("__id"), "left").select(*all_of(docs), "__spans")
    added = [T.StructField("clean_text", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())]
    plain = both.toDF(*[f"c{i}" for i in range(len(docs.columns))], "__spans")
    schema = T.StructType([*plain.schema.fields[:-1], *added])
    out = plain.mapInArrow(_clean(window, len(docs.columns), docs.columns.index("text")), schema)
    return out.toDF(*docs.columns, *[a.name for a in added])
