"""The best products of a text by common words, found through an inverted index and never by scoring all pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize
from ..runtime import written

#: Sets of at most so many words are filed under pairs of words; longer ones under single words.
PAIRED_WORDS = 24
#: Words that more than this share of a tenant's entries have are in no pair of the first round.
COMMON_SHARE = 0.5


def words(text: Column) -> Column:
    """The different words of a normalized text."""
    return F.array_distinct(F.array_remove(F.split(normalize(text), " "), ""))


def overlap(a: Column, b: Column) -> Column:
    """Common words of all words of two word sets; 0 for two empty ones."""
    common = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - common
    return F.when(union > 0, common / union).otherwise(0.0)


def overlap_scorer(pairs: DataFrame) -> DataFrame:
    """``score`` of (``texto_item, texto_produto``): words that both normalized texts have, of all their words. Columns only."""
    w = pairs.withColumns({"__i": words(F.col("texto_item")), "__p": words(F.col("texto_produto"))})
    return w.withColumn("score", overlap(F.col("__i"), F.col("__p"))).drop("__i", "__p")


def _pair_keys(own: Column) -> Column:
    """All pairs of a set's words, the smaller word first."""
    starts = F.when(F.size(own) > 1, F.sequence(F.lit(0), F.size(own) - 2)).otherwise(F.array().cast("array<int>"))

    def with_later(i: Column) -> Column:
        a = F.get(own, i)
        return F.transform(F.slice(own, i + 2, F.size(own)), lambda b: F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")))

    return F.flatten(F.transform(starts, with_later))


class OverlapIndex:
    """An inverted index of a catalog by tenant: word sets of products under pairs of their words, long ones under single words.

    Products of one tenant with the same words are one entry with its least ids, as many as anybody asks for (``keep``). The index is
    written, so that several searches, or several batches of a stream, read it as it is.
    """

    def __init__(self, produtos: DataFrame, text: str = "descricao", keep: int = 3):
        self.keep = keep
        rows = written(produtos.select("usuario_id", F.col("id").alias("produto_id"), F.array_sort(words(F.trim(F.coalesce(text, F.lit(""))))).alias("palavras")), "index-products")
        # of the products with one word set only the first can be among the best; a set's ids are cut before they are gathered
        order = Window.partitionBy("usuario_id", "palavras").orderBy("produto_id")
        first = rows.filter(F.size("palavras") > 0).withColumn("__k", F.row_number().over(order)).filter(F.col("__k") <= keep)
        entries = first.groupBy("usuario_id", "palavras").agg(F.array_sort(F.collect_list("produto_id")).alias("ids"))
        self.entries = written(entries.withColumns({"entrada": F.monotonically_increasing_id(), "n": F.size("palavras")}), "index-entries")
        self.products = rows
        # a tenant's shortest set, and how many entries have a word: what bounds a score
        each = self.entries.select("usuario_id", "n", F.explode("palavras").alias("palavra"))
        self.least = written(self.entries.groupBy("usuario_id").agg(F.min("n").alias("__least"), F.count("*").alias("__all")), "index-tenants")
        counts = each.groupBy("usuario_id", "palavra").agg(F.count("*").alias("__df")).join(self.least, "usuario_id")
        self.counts = written(counts.select("usuario_id", "palavra", "__df", (F.col("__df") > COMMON_SHARE * F.col("__all")).alias("__hot")), "index-words")

    def met(self, sets: DataFrame, entries: DataFrame, keys: Column, entry_keys: Column) -> DataFrame:
        """Sets (``usuario_id, conjunto_id``) and entries that share a key, each pair once."""
        asked = sets.select("usuario_id", "conjunto_id", F.explode(keys).alias("__key"))
        filed = entries.select("usuario_id", "entrada", F.explode(entry_keys).alias("__key"))
        return asked.join(filed, ["usuario_id", "__key"]).select("usuario_id", "conjunto_id", "entrada").distinct()

    def first_round(self, sets: DataFrame) -> DataFrame:
        """Pairs that share two words that are not common; with long sets or entries, one word."""
        short, long = F.size("raras") <= PAIRED_WORDS, F.col("n") > PAIRED_WORDS
        by_pair = self.met(sets.filter(short), self.entries.filter(~long), _pair_keys(F.slice("raras", F.lit(1), F.size("raras") - F.col("__common"))), _pair_keys(F.col("palavras")))
        by_word = self.met(sets.filter(~short), self.entries, F.col("raras"), F.col("palavras"))
        by_long = self.met(sets.filter(short), self.entries.filter(long), F.col("raras"), F.col("palavras"))
        return by_pair.unionByName(by_word).unionByName(by_long)

    def second_round(self, sets: DataFrame, best: DataFrame, k: int) -> DataFrame:
        """Pairs that share one word, for the sets where a product that has not been met can still be among the ``k`` best."""
        bar = best.groupBy("usuario_id", "conjunto_id").agg(F.count("*").alias("__n"), F.min("score").alias("__bar"))
        shared = 1 + F.col("__common")
        bound = shared / (F.size("conjunto") + F.greatest(F.col("__least"), shared) - shared)
        state = sets.filter(F.size("raras") <= PAIRED_WORDS).join(bar, ["usuario_id", "conjunto_id"], "left").join(self.least, "usuario_id")
        doubtful = state.filter((F.coalesce("__n", F.lit(0)) < k) | (F.col("__bar") <= bound))
        return self.met(doubtful, self.entries.filter(F.col("n") <= PAIRED_WORDS), F.col("raras"), F.col("palavras"))

    def sets(self, asked: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The word set of each text (``texto_id, conjunto_id``), and each tenant's sets with their words, the rarest of its catalog first."""
        named = written(texts.select("texto_id", F.array_sort(words(F.trim(F.coalesce("texto", F.lit(""))))).alias("conjunto")), "index-texts")
        distinct = written(named.select("conjunto").distinct().withColumn("conjunto_id", F.monotonically_increasing_id()), "index-sets")
        of_text = written(named.join(distinct, "conjunto").select("texto_id", "conjunto_id"), "index-set-of-text")
        mine = asked.join(of_text, "texto_id").select("usuario_id", "conjunto_id").distinct().join(distinct, "conjunto_id")
        each = mine.select("usuario_id", "conjunto_id", F.explode("conjunto").alias("palavra")).join(self.counts, ["usuario_id", "palavra"])
        rare = each.groupBy("usuario_id", "conjunto_id").agg(
            F.transform(F.array_sort(F.collect_list(F.struct("__df", "palavra"))), lambda x: x["palavra"]).alias("raras"), F.count_if("__hot").cast("int").alias("__common")
        )
        return of_text, written(rare.join(distinct, "conjunto_id"), "index-known")

    def search(self, asked: DataFrame, texts: DataFrame, k: int | None = None, also: DataFrame | None = None) -> DataFrame:
        """``usuario_id, texto_id, produto_id, score``: the ``k`` best products with a positive score of every text that a tenant asks for.

        ``asked`` has ``usuario_id, texto_id``, ``texts`` has ``texto_id, texto``. Ties go to the least id. Pairs of ``also``
        (``usuario_id, texto_id, produto_id``) are scored whatever their rank. A text without words has no product.

        A text's words are put in order, the rarest first. The first round meets only products that share a pair of words that are
        not common in the catalog. A product that is not met shares one such word at most besides common ones: that bounds its score. Only where this bound reaches the ``k``-th best, a second round looks at single words.
        """
        k = k or self.keep
        if k > self.keep:
            raise ValueError("the index keeps fewer ids than asked for")
        asked = asked.select("usuario_id", "texto_id").distinct()
        of_text, sets = self.sets(asked, texts)
        first = written(self._best(self.first_round(sets), sets, k), "index-first")
        both = first.unionByName(self._best(self.second_round(sets, first, k), sets, k)).distinct()
        order = Window.partitionBy("usuario_id", "conjunto_id").orderBy(F.desc("score"), "produto_id")
        top = both.withColumn("__k", F.row_number().over(order)).filter(F.col("__k") <= k).drop("__k")
        found = asked.join(of_text, "texto_id").join(top, ["usuario_id", "conjunto_id"]).select("usuario_id", "texto_id", "produto_id", "score")
        if also is None:
            return found
        named = also.select("usuario_id", "texto_id", "produto_id").distinct().join(of_text, "texto_id").join(sets.select("usuario_id", "conjunto_id", "conjunto"), ["usuario_id", "conjunto_id"], "left")
        scored = named.join(self.products, ["usuario_id", "produto_id"]).select("usuario_id", "texto_id", "produto_id", F.coalesce(overlap(F.col("conjunto"), F.col("palavras")), F.lit(0.0)).alias("score"))
        return found.unionByName(scored).distinct()

    def score_named(self, probes: DataFrame, named: DataFrame, on: list[str], texts: DataFrame) -> DataFrame:
        """``usuario_id, texto_id, produto_id``, ``on`` and ``score`` of the products that texts name: ``probes`` (``texto_id``) and ``named`` (``usuario_id, produto_id``) meet by ``on``.

        Both bring their words, so a score is taken where they meet and no pair is shuffled. A product that is not in the index has none.
        """
        sets = texts.select("texto_id", F.array_sort(words(F.trim(F.coalesce("texto", F.lit(""))))).alias("conjunto"))
        own = written(named.join(self.products, ["usuario_id", "produto_id"]).select("usuario_id", "produto_id", *on, "palavras"), "index-named")
        met = probes.join(sets, "texto_id").join(own, on)
        return met.select("usuario_id", "texto_id", "produto_id", *on, overlap(F.col("conjunto"), F.col("palavras")).alias("score"))

    def _best(self, met: DataFrame, sets: DataFrame, k: int) -> DataFrame:
        """The ``k`` best products of each set; entries are cut to ``k`` before their ids are told apart, as each has one at least."""
        pairs = met.join(self.entries.select("entrada", "palavras", "ids"), "entrada").join(sets.select("usuario_id", "conjunto_id", "conjunto"), ["usuario_id", "conjunto_id"])
        scored = pairs.select("usuario_id", "conjunto_id", "ids", overlap(F.col("conjunto"), F.col("palavras")).alias("score"))
        # of entries with one score, the one with the least id comes first, so that no id among the best is cut
        rank = Window.partitionBy("usuario_id", "conjunto_id").orderBy(F.desc("score"), F.get("ids", F.lit(0)))
        ids = scored.withColumn("__k", F.row_number().over(rank)).filter(F.col("__k") <= k).select("usuario_id", "conjunto_id", "score", F.explode("ids").alias("produto_id"))
        order = Window.partitionBy("usuario_id", "conjunto_id").orderBy(F.desc("score"), "produto_id")
        return ids.withColumn("__k", F.row_number().over(order)).filter(F.col("__k") <= k).drop("__k")
