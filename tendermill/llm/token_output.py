"""Token ids as binary chunks: blocks of ids are transposed into byte or bit planes, and each plane is compressed."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import ship
from .common import without

#: Ids in a block, whose planes are compressed together.
BLOCK_IDS = 65_536
#: A chunk is closed when it holds so many ids; one document is never split between chunks.
CHUNK_IDS = 524_288
#: Bytes of text that a task encodes at a time, or one text.
ENCODE_BYTES = 8_000_000
#: Parts of texts whose ids a worker remembers before it forgets all of them (about 150 bytes each).
CACHE_PARTS = 600_000

CHUNK_SCHEMA = "part int, chunk int, start_in_part bigint, n_ids bigint, doc_ids array<bigint>, doc_lens array<bigint>, block_bytes array<int>, payload binary"


def pack_block(ids: np.ndarray, planes: str = "byte") -> bytes:
    """One block: the count of ids and of planes, each plane's size, and the planes.

    Byte planes hold byte 0 of every id, then byte 1, and so on; bit planes hold bit 0 of every id (eight ids a byte), then bit 1.
    Planes above the highest one in use are left out.
    """
    raw = np.ascontiguousarray(ids, dtype="<u4").view(np.uint8).reshape(-1, 4)
    top = int(ids.max()) if len(ids) else 0
    if planes == "byte":
        rows = [raw[:, i].tobytes() for i in range((max(top, 1).bit_length() + 7) // 8)]
    elif planes == "bit":
        bits = np.unpackbits(raw, axis=1, bitorder="little")
        rows = [np.packbits(bits[:, i], bitorder="little").tobytes() for i in range(max(top, 1).bit_length())]
    else:
        raise ValueError("planes: byte or bit")
    squeeze = zstandard.ZstdCompressor(level=3)
    packed = [squeeze.compress(r) for r in rows]
    head = np.array([len(ids), len(rows), planes == "bit", *map(len, packed)], dtype="<u4").tobytes()
    return head + b"".join(packed)


def unpack_block(block: bytes) -> np.ndarray:
    """The ids of a block."""
    n, count, bit = np.frombuffer(block, dtype="<u4", count=3).tolist()
    sizes = np.frombuffer(block, dtype="<u4", count=count, offset=12).tolist()
    at, rows, expand = 12 + 4 * count, [], zstandard.ZstdDecompressor()
    for s in sizes:
        rows.append(np.frombuffer(expand.decompress(block[at : at + s]), dtype=np.uint8))
        at += s
    if not n:
        return np.zeros(0, dtype="<u4")
    if not bit:
        out = np.zeros((n, 4), dtype=np.uint8)
        for i, r in enumerate(rows):
            out[:, i] = r
        return out.reshape(-1).view("<u4")
    out = np.zeros(n, dtype="<u4")
    for i, r in enumerate(rows):
        out |= np.unpackbits(r, count=n, bitorder="little").astype("<u4") << np.uint32(i)
    return out


#: White space that a byte-level tokenizer knows, but for the space and the line feed.
_OTHER_SPACE = r"\t\x0b\x0c\r\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: What keeps a text in one piece: white space other than single spaces and up to two line feeds between visible characters; special tokens.
_WHOLE = rf"^[ \n]|[ \n]$|  | \n|\n |\n\n\n|<\||[{_OTHER_SPACE}]"
_LETTER = "A-Za-zÀ-ÖØ-öø-ɏ"
#: Pieces of these signs alone are cut further, as a byte-level tokenizer does: contractions, letters, digits, other marks.
_PLAIN = rf"^[ !-~{_LETTER}]+$"
_PARTS = rf"'(?:s|t|re|ve|m|ll|d)| ?[{_LETTER}]+| ?[0-9]+| ?[^ 0-9{_LETTER}]+"
#: Stands for a line feed among parts; no text that is cut has a tab.
_FEED = "\t"


def _gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches of ``flat`` that ``index`` names, behind each other, and where each ends (with a leading 0)."""
    n = sizes[index]
    ends = np.concatenate([[0], np.cumsum(n)])
    return flat[np.repeat(starts[index] - ends[:-1], n) + np.arange(ends[-1])], ends


class _Encoder:
    """Encodes texts with the tokenizers library; parts of texts are remembered for the worker's life, within bounds."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        shape = json.loads(self.tok.to_str())
        byte_level = shape["normalizer"] is None and shape["model"]["type"] == "BPE" and (shape["pre_tokenizer"] or {}).get("type") == "ByteLevel"
        self.cuts = byte_level and not shape["pre_tokenizer"]["add_prefix_space"] and shape["post_processor"] is None
        self.feed = int(self.whole(["\n"])[0][0]) if self.cuts else None
        self._forget()

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype="<u4") for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _forget(self) -> None:
        """Empties the memory of parts: the number of each, and of each number where its ids start in ``flat`` and how many they are."""
        self.known: dict[str, int] = {}
        self.flat, self.starts, self.sizes = np.zeros(0, dtype="<u4"), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def _learn(self, parts: list[str]) -> np.ndarray:
        """Numbers of parts. New ones are encoded as lines of a text: no part has a line feed, so its id tells them apart."""
        if len(self.known) > CACHE_PARTS:
            self._forget()
        new = [p for p in parts if p not in self.known]
        if new:
            texts = ["\n".join(new[at : at + 4096]) for at in range(0, len(new), 4096)]
            flat = np.concatenate([x for ids in self.whole(texts) for x in (ids, [self.feed])]).astype("<u4")
            ends = np.flatnonzero(flat == self.feed)
            starts = np.concatenate([[0], ends[:-1] + 1])
            self.known.update(zip(new, range(len(self.sizes), len(self.sizes) + len(new)), strict=True))
            self.starts = np.concatenate([self.starts, starts + len(self.flat)])
            self.sizes = np.concatenate([self.sizes, ends - starts])
            self.flat = np.concatenate([self.flat, flat])
        return np.fromiter(map(self.known.__getitem__, parts), dtype=np.int64, count=len(parts))

    def cut(self, texts: pa.Array) -> list[bytes]:
        """Ids of texts that may be cut, put together from those of their parts."""
        # every text gets a line feed in front; a piece is what follows a space, or a line feed and what follows it
        led = pc.replace_substring(pc.binary_join_element_wise(pa.scalar("\n"), texts, ""), "\n", " \n")
        lists = pc.split_pattern(pc.utf8_slice_codeunits(led, 1), " ")
        pieces = lists.flatten().dictionary_encode()
        kinds = pieces.dictionary
        feed = pc.starts_with(kinds, "\n")
        core = pc.if_else(feed, pc.utf8_slice_codeunits(kinds, 1), pc.binary_join_element_wise(pa.scalar(" "), kinds, ""))
        marked = pc.replace_substring_regex(core, _PARTS, r"\0" + "\n")
        marked = pc.if_else(pc.match_substring_regex(core, _PLAIN), pc.utf8_rtrim(marked, "\n"), core)
        marked = pc.if_else(feed, pc.binary_join_element_wise(pa.scalar(_FEED), marked, "\n"), marked)
        part_lists = pc.split_pattern(pc.utf8_rtrim(marked, "\n"), "\n")
        parts = part_lists.flatten().dictionary_encode()
        names = parts.dictionary.to_pylist()
        number = self._learn(names)
        flat, ends = _gather(self.flat, self.starts, self.sizes, number[parts.indices.to_numpy()])
        if _FEED in names:  # in place of the tab's own id
            tab = np.flatnonzero(parts.indices.to_numpy() == names.index(_FEED))
            flat[ends[tab]] = self.feed
        bounds = ends[part_lists.offsets.to_numpy()]
        flat, ends = _gather(flat, bounds[:-1], np.diff(bounds), pieces.indices.to_numpy())
        bounds = (4 * ends[lists.offsets.to_numpy()]).tolist()
        raw = flat.tobytes()
        return [raw[lo + 4 : hi] for lo, hi in zip(bounds, bounds[1:])]


@lru_cache(maxsize=2)
def _encoder(path: str) -> _Encoder:
    return _Encoder(path)


def encode(texts: pa.Array | list[str], path: str) -> list[bytes]:
    """Ids of whole texts as little-endian unsigned 32-bit integers, by the tokenizers library.

    Byte-level tokenizers split a text before they merge, by a pattern that always starts anew at a single space and at a line feed
    between visible characters, whatever these are. So the ids of a text whose white space is of these kinds alone are those of
    its pieces in a row; pieces of Latin letters, digits and ASCII marks are cut once more by the same pattern. The different
    parts of all texts, with the space before them, go through the library's whole ``encode`` once (tests hold this for all pairs
    of these signs, and for pieces of any sign). All other texts, those with ``<|``, which may be a special token, and all texts of
    other kinds of tokenizers go through it whole.
    """
    enc = _encoder(path)
    texts = pa.array(texts, pa.string()) if isinstance(texts, list) else texts
    if not enc.cuts:
        return [ids.tobytes() for ids in enc.whole(texts.to_pylist())]
    whole = pc.match_substring_regex(texts, _WHOLE)
    cut = iter(enc.cut(texts.filter(pc.invert(whole))))
    rest = iter(enc.whole(texts.filter(whole).to_pylist()))
    return [next(rest).tobytes() if w else next(cut) for w in whole.to_pylist()]


def _some_at_a_time(texts: pa.Array, most: int = ENCODE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of ``most`` bytes of text, or of one row."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + most, "right")))
        yield lo, hi
        lo = hi


def write_ids(docs: DataFrame, out: str, tokenizer: str, end_id: int, partitions: int | None = None, planes: str = "byte") -> None:
    """Writes the ids of ``docs`` (``doc_id``, an integer, and ``text``; other columns are not written) to the folder ``out`` in ascending order of ``doc_id``.

    ``tokenizer`` is a tokenizers-library file that every executor has. A null text is empty; each document, empty ones too, ends
    with ``end_id``. Null ids come first; rows of equal id follow each other, ordered by text. ``out`` is a Parquet folder of
    chunks: whole documents, their ids and lengths, the sizes of the chunk's blocks, and the blocks behind each other. Spark's own
    writer commits the chunks, so lost tasks leave nothing behind. A task holds a chunk, or its longest document, at a time.
    """
    spark = docs.sparkSession
    ship(spark)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    end = np.array([end_id], dtype="<u4").tobytes()

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, chunk, start = TaskContext.get().partitionId(), 0, 0
        held: list[bytes] = []
        ids: list[int | None] = []
        size = 0

        def close() -> pa.RecordBatch:
            nonlocal chunk, start, held, ids, size
            flat = np.frombuffer(b"".join(held), dtype="<u4")
            blocks = [pack_block(flat[i : i + BLOCK_IDS], planes) for i in range(0, len(flat), BLOCK_IDS)]
            row = [part, chunk, start, len(flat), ids, [len(h) // 4 for h in held], [len(b) for b in blocks], b"".join(blocks)]
            chunk, start, held, ids, size = chunk + 1, start + len(flat), [], [], 0
            return pa.RecordBatch.from_arrays([pa.array([v], type=t) for v, t in zip(row, types, strict=True)], names=names)

        names = [f.split()[0] for f in CHUNK_SCHEMA.split(", ")]
        big = pa.int64()
        types = [pa.int32(), pa.int32(), big, big, pa.list_(big), pa.list_(big), pa.list_(pa.int32()), pa.binary()]
        for batch in batches:
            for lo, hi in _some_at_a_time(batch.column(1)):
                some = batch.slice(lo, hi - lo)
                for doc, coded in zip(some.column(0).to_pylist(), encode(some.column(1), tokenizer), strict=True):
                    held.append(coded + end)
                    ids.append(doc)
                    size += len(held[-1]) // 4
                    if size >= CHUNK_IDS:
                        yield close()
        if held:
            yield close()

    ranged.mapInArrow(chunks, CHUNK_SCHEMA).write.option("compression", "uncompressed").parquet(f"{out}/chunks")
    # the index: where every chunk lies in the sequence of all ids
    heads = spark.read.parquet(f"{out}/chunks").select("part", "chunk", "start_in_part", "n_ids", F.size("doc_ids").alias("n_docs"), F.size("block_bytes").alias("n_blocks"))
    totals = heads.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()  # a row for each of the n partitions
    at, base = 0, []
    for r in totals:
        base.append((r["part"], at))
        at += r["n"]
    first = spark.createDataFrame(base, "part int, part_start bigint")
    heads.join(F.broadcast(first), "part").withColumn("start", F.col("part_start") + F.col("start_in_part")).drop("part_start").write.parquet(f"{out}/index")


def read_ids(spark: SparkSession, out: str) -> DataFrame:
    """Documents of a folder that ``write_ids`` wrote: ``doc_id, start, n_tokens`` (long) and ``ids`` (binary, 32 bits each)."""
    ship(spark)
    chunks = spark.read.parquet(f"{out}/chunks")
    # a row for each partition of the writer, a number that the writer was given
    parts = spark.read.parquet(f"{out}/index").groupBy("part").agg(F.min(F.col("start") - F.col("start_in_part")).alias("part_start"))
    both = chunks.join(F.broadcast(parts), "part").withColumn("start", F.col("part_start") + F.col("start_in_part"))
    return both.select("start", "doc_ids", "doc_lens", "block_bytes", "payload").mapInArrow(_documents, "doc_id bigint, start bigint, n_tokens bigint, ids binary")


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            start, docs, lens, sizes, payload = (batch.column(c)[i].as_py() for c in range(5))
            cuts = np.cumsum([0, *sizes])
            flat = b"".join(unpack_block(payload[a:b]).tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True))
            ends = np.cumsum([0, *lens])
            for lo in range(0, len(docs), 512):
                hi = min(lo + 512, len(docs))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(docs[lo:hi], type=pa.int64()), pa.array(start + ends[lo:hi], type=pa.int64()), pa.array(lens[lo:hi], type=pa.int64()),
                        pa.array([flat[4 * ends[k] : 4 * ends[k + 1]] for k in range(lo, hi)], type=pa.binary()),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids"],
                )


def id_digests(read: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens`` and the CRC-32 of the ids (``ids_crc32``, long) of what ``read_ids`` returns."""
    return without(read, ["ids_crc32"]).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
