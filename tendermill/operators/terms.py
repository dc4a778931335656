"""Many terms or phrases against many texts: an automaton over all terms, and a posting table of letter groups."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import bucketed, ship, written

#: Terms in one automaton, and their bytes, at most: a shard is broadcast, and its automaton takes some 100 bytes for each sign.
SHARD_TERMS, SHARD_BYTES = 200_000, 4_000_000


_BUILT: dict[str, object] = {}


def _automaton(key: str, terms: list[str]) -> object:
    """The automaton of a shard, built once for each worker; one shard's at a time is kept."""
    import ahocorasick

    if key not in _BUILT:
        _BUILT.clear()
        found = ahocorasick.Automaton()
        for term in terms:
            found.add_word(term, term)
        found.make_automaton()
        _BUILT[key] = found
    return _BUILT[key]


def term_hits(texts: DataFrame, terms: DataFrame, key: str, text: str, term: str = "termo", shard_terms: int = SHARD_TERMS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(``key``, ``term``) of each text and each different term that it holds, wherever in it. Null or empty texts and terms hit nothing.

    All terms of a shard are looked for in one walk of a text, so the work follows the texts and the hits, not the number of terms.
    Terms are counted first, and go to the tasks in shards of bounded size, one pass over the texts for each.
    """
    spark = texts.sparkSession
    ship(spark)
    own = written(terms.select(F.col(term).cast("string").alias("t")).filter("t <> ''").distinct(), "terms")
    n, size = own.agg(F.count("*"), F.sum(F.octet_length("t"))).first()
    shards = max(1, -(-n // shard_terms), -(-(size or 0) // shard_bytes))
    rows = texts.select(F.col(key), F.col(text).cast("string").alias("__t")).filter("__t <> ''")
    schema = rows.drop("__t").withColumn(term, F.lit("")).schema

    def searching(shard: int):
        held = own.filter(F.pmod(F.xxhash64("t"), F.lit(shards)) == shard).select("t").toArrow()["t"].to_pylist()  # bounded by the shard's size
        sent, mark = spark.sparkContext.broadcast(held), uuid.uuid4().hex

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = _automaton(mark, sent.value) if sent.value else None
            for batch in batches:
                hits = [sorted({term for _, term in automaton.iter(t)}) if automaton else [] for t in batch.column(1).to_pylist()]
                at = pa.array([i for i, h in enumerate(hits) for _ in h], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.array([t for h in hits for t in h], pa.string())], names=schema.names)

        return rows.mapInArrow(search, schema)

    found = searching(0)
    for shard in range(1, shards):
        found = found.unionByName(searching(shard))
    return found


def _grams(text: Column, size: int) -> Column:
    """The different groups of ``size`` neighbouring signs of a text."""
    last = F.length(text) - size
    return F.array_distinct(F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.substr(text, i + 1, F.lit(size)))).otherwise(F.array().cast("array<string>")))


class PhraseIndex:
    """Texts filed under the groups of three signs that they hold, for searches of phrases anywhere inside.

    Postings are dealt out by group and written as buckets, so that a search shuffles its few phrases and not the postings. Phrases of
    one or two signs have postings of their own, made when such a phrase is first asked for.
    """

    def __init__(self, corpus: DataFrame, text: str, code: str):
        self.code = code
        self.texts = written(corpus.select(F.col(code), F.col(text).alias("__c")).filter("__c is not null").withColumn("__id", F.md5(F.col("__c").cast("binary"))), "phrase-texts")
        self.distinct = written(self.texts.select("__id", "__c").distinct(), "phrase-distinct")
        self._postings: dict[int, tuple[DataFrame, DataFrame]] = {}

    def postings(self, size: int) -> tuple[DataFrame, DataFrame]:
        """``__gram, __id`` of all texts, and how many texts have each group."""
        if size not in self._postings:
            filed = bucketed(self.distinct.select(F.explode(_grams(F.col("__c"), size)).alias("__gram"), "__id"), f"phrase_grams_{size}", "__gram")
            self._postings[size] = filed, written(filed.groupBy("__gram").agg(F.count("*").alias("__df")), "phrase-counts")
        return self._postings[size]

    def search(self, phrases: DataFrame, phrase: str) -> DataFrame:
        """(``phrase``, code) of each different phrase and each text that holds it; a null or empty phrase is in no text.

        Of a phrase the rarest group names the texts to look at; a phrase with a group that no text has is in none.
        """
        asked = phrases.select(F.col(phrase).alias("__q")).filter("__q <> ''").distinct()
        asked = written(asked.withColumn("__size", F.least(F.lit(3), F.length("__q"))), "phrase-asked")
        sizes = [r["__size"] for r in asked.select("__size").distinct().collect()]  # three at most
        found = None
        for size in sizes:
            filed, counts = self.postings(size)
            grams = asked.filter(F.col("__size") == size).withColumn("__g", _grams(F.col("__q"), size))
            each = grams.select("__q", F.size("__g").alias("__n"), F.explode("__g").alias("__gram")).join(counts, "__gram")
            rarest = each.groupBy("__q", "__n").agg(F.count("*").alias("__m"), F.min(F.struct("__df", "__gram")).alias("__r")).filter("__m = __n")
            near = rarest.select("__q", F.col("__r.__gram").alias("__gram")).join(filed, "__gram").join(self.distinct, "__id")
            hits = near.filter(F.contains("__c", "__q")).select("__q", "__id")
            found = hits if found is None else found.unionByName(hits)
        if found is None:
            return asked.select(F.col("__q").alias(phrase)).join(self.texts.select(self.code), F.lit(False))
        return found.join(self.texts.select("__id", self.code), "__id").select(F.col("__q").alias(phrase), self.code).distinct()
