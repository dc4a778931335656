"""Line dedup: levelled sorted runs of line hashes, compacted from time to time; new batches are merged against the runs."""

from __future__ import annotations

import string
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import all_of, delete, fresh_path, let, SPACE_CHARS, without, written


def split_lines(text: Column) -> Column:
    """The lines of a text; one empty line for a null."""
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_key(line: Column) -> Column:
    """A line without white space at its ends and with A-Z in lower case."""
    bare = F.trim(line, F.lit(SPACE_CHARS))
    # for a line of ASCII alone, lower() is the same and much faster
    return F.when(F.octet_length(bare) == F.length(bare), F.lower(bare)).otherwise(F.translate(bare, string.ascii_uppercase, string.ascii_lowercase))


def _hash(key: Column) -> Column:
    """128 bits of a key, as two longs."""
    return F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("2"), key).alias("h2"))


class LineRuns:
    """Counts of line hashes in levels of sorted runs, and the runs of hashes already known to be frequent.

    A run is a table of ``h1, h2, n`` bucketed and sorted by the hash, so runs meet in merge joins without a shuffle. A new batch is
    anti-joined with the frequent runs, as what they hold needs no more counting, and what is left becomes a run of level
    0. ``fanout`` runs of a level are merged into one of the next; hashes that reach ``min_docs`` then move to a frequent run.
    All runs lie in the shared folder, and ``close`` drops them.
    """

    def __init__(self, spark: SparkSession, min_docs: int, buckets: int, fanout: int = 2):
        self.spark, self.min_docs, self.buckets, self.fanout = spark, min_docs, buckets, fanout
        self.levels: list[list[str]] = [[]]
        self.frequent_runs: list[str] = []
        self._name, self._made = f"line_runs_{uuid.uuid4().hex}", []
        self._paths: dict[str, str] = {}

    def _write(self, df: DataFrame) -> str:
        name = f"{self._name}_{len(self._made)}"
        self._made.append(name)
        self._paths[name] = fresh_path(self.spark, "line-run")
        df.write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", self._paths[name]).format("parquet").saveAsTable(name)
        return name

    def _drop(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            if path := self._paths.pop(name, None):
                delete(self.spark, path)

    def add(self, batch: DataFrame) -> None:
        """Takes ``h1, h2, n`` of a batch, each hash once, ``n`` the number of the batch's documents that have it."""
        fresh = batch.repartition(self.buckets, "h1", "h2")
        for run in self.frequent_runs:
            fresh = fresh.join(self.spark.table(run).hint("merge"), ["h1", "h2"], "left_anti")
        self.levels[0].append(self._write(fresh))
        level = 0
        while len(self.levels[level]) >= self.fanout:
            self.compact(level)
            level += 1

    def compact(self, level: int) -> None:
        """Merges the runs of a level into one of the next."""
        runs, self.levels[level] = self.levels[level], []
        if len(self.levels) == level + 1:
            self.levels.append([])
        merged = self.spark.table(self._write(self._merged(runs)))
        self.frequent_runs.append(self._write(merged.filter(F.col("n") >= self.min_docs)))
        self.levels[level + 1].append(self._write(merged.filter(F.col("n") < self.min_docs)))
        self._drop([*runs, self._made[-3]])

    def _merged(self, runs: list[str]) -> DataFrame:
        def both(a: DataFrame, b: DataFrame) -> DataFrame:
            b = b.withColumnRenamed("n", "m").hint("merge")
            return a.join(b, ["h1", "h2"], "full_outer").select("h1", "h2", (F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))).alias("n"))

        return reduce(both, [self.spark.table(r) for r in runs])

    def frequent(self) -> DataFrame:
        """``h1, h2`` of all hashes in ``min_docs`` documents or more, as a table of its own."""
        left = [r for runs in self.levels for r in runs]
        found = [self.spark.table(r).select("h1", "h2") for r in self.frequent_runs]
        if left:
            found.append(self._merged(left).filter(F.col("n") >= self.min_docs).select("h1", "h2"))
        if not found:
            return self.spark.createDataFrame([], "h1 bigint, h2 bigint")
        return written(reduce(DataFrame.unionByName, found), "frequent-lines")

    def close(self) -> None:
        self._drop(self._made)


def frequent_lines(docs: DataFrame, min_docs: int, batches: int = 4, min_chars: int = 1) -> DataFrame:
    """``h1, h2`` of the line keys with ``min_chars`` code points that ``min_docs`` rows of ``docs`` have, counted batch by batch."""
    spark = docs.sparkSession
    keys = F.filter(F.transform(split_lines(F.col("text")), line_key), lambda k: F.length(k) >= max(1, min_chars))
    lines = docs.select(
        F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int").alias("batch"),
        F.explode(F.array_distinct(F.transform(keys, _hash))).alias("h"),
    )
    # rows of a batch with the same hash are added up before anything is written
    staged = written(lines.groupBy("batch", "h.h1", "h.h2").agg(F.count("*").alias("n")), "line-hashes")
    runs = LineRuns(spark, min_docs, max(8, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    try:
        for b in range(batches):
            runs.add(staged.filter(F.col("batch") == b).select("h1", "h2", "n"))
        return runs.frequent()
    finally:
        runs.close()


def drop_frequent_lines(docs: DataFrame, min_docs: int = 10, batches: int = 4, min_chars: int = 1) -> DataFrame:
    """``docs`` without lines whose key at least ``min_docs`` documents have, in every document that has them.

    Adds ``clean_text`` (string), ``n_lines`` and ``n_dropped`` (long); input columns of these names are replaced, others pass
    through. Lines are split at ``\\n``; a key is the line stripped of ASCII white space with A-Z in lower case, held as 128
    bits. Keys shorter than ``min_chars`` are never dropped; nor are blank lines. Every row counts as a document, so repeated
    rows count each. A null text is one empty line. A null ``doc_id`` is a value like any other.

    A line that very many documents share is one row for each map task before the shuffle. The frequent keys are not broadcast, as
    their number grows with the corpus; they join the lines by shuffle, where AQE splits a hot key.
    """
    docs = without(docs, ["clean_text", "n_lines", "n_dropped"])
    frequent = frequent_lines(docs, min_docs, batches, min_chars)
    keyed = docs.withColumn("__t", F.xxhash64(F.coalesce("text", F.lit(""))))
    lines = keyed.select(
        "doc_id", "__t", F.posexplode(F.transform(split_lines(F.col("text")), lambda x: let(line_key(x), lambda k: F.when(F.length(k) >= max(1, min_chars), _hash(k))))).alias("pos", "h")
    ).filter("h is not null")
    hits = lines.select("doc_id", "__t", "pos", "h.h1", "h.h2").join(frequent, ["h1", "h2"])
    drops = hits.groupBy("doc_id", "__t").agg(F.collect_set("pos").alias("__drop"))
    drops = drops.withColumnsRenamed({"doc_id": "__id", "__t": "__u"})
    both = keyed.join(drops, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__t") == F.col("__u")), "left")
    result = let(
        split_lines(F.col("text")),
        lambda x: let(
            F.array_sort(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col("__drop"))),
            lambda keep: F.struct(
                F.size(x).cast("long").alias("n_lines"),
                (F.size(x) - F.size(keep)).cast("long").alias("n_dropped"),
                F.array_join(F.transform(keep, lambda i: F.get(x, i)), "\n").alias("clean_text"),
            ),
        ),
    )
    plain = F.struct(F.size(split_lines(F.col("text"))).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_dropped"), F.coalesce("text", F.lit("")).alias("clean_text"))
    return both.select(*all_of(docs), F.when(F.col("__drop").isNull(), plain).otherwise(result).alias("__r")).select(
        *all_of(docs), "__r.clean_text", "__r.n_lines", "__r.n_dropped"
    )
