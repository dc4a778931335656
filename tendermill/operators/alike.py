"""The texts most alike another by their tokens, with bounds in columns before any edit distance."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import token_set_ratio
from ..runtime import written

#: Signs that are counted in each text; an edit changes one count by one, so counts bound the edits. Any signs are right.
COUNTED = string.ascii_lowercase + string.digits
#: Lengths within this factor of each other are one class.
LENGTHS = 1.25
#: Bounds and ratios are sums of a few fractions; this is more than they can be off.
SLACK = 1e-9


def _tokens(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.array_remove(F.split(F.coalesce(text, F.lit("")), r"\s+"), "")))


def _apart(a: Column, b: Column, n_a: Column, n_b: Column) -> Column:
    """At least so many insertions and deletions lie between two texts: by their lengths, and by how often each sign occurs."""
    signs = F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0), lambda s, d: s + d)
    return F.greatest(F.abs(n_a - n_b), signs)


def _class(length: Column) -> Column:
    return F.floor(F.ln(length.cast("double")) / F.ln(F.lit(LENGTHS)))


class AlikeTexts:
    """For each text of ``left`` the texts of ``right`` in its group that are most alike by ``token_set_ratio``, without scoring all pairs.

    Texts with a common token meet on it, as ids; the length of the common tokens alone says what their ratio is at least, and sign
    counts what it is at most. Only those that can be among the best ``k`` of their text, and reach ``floor``, get an edit distance
    (``first``). Texts without a common token meet by classes of lengths, in the range that the ``k``-th best ratio so far leaves open;
    a text whose best ratios are 1 meets none (``second``).

    A null group meets nothing; null and blank texts are like nothing. A token that most texts of a group have brings most of their
    pairs together as ids. ``floor`` must be over 0.
    """

    def __init__(self, left: DataFrame, right: DataFrame, group: str, a: str, b: str, floor: float, k: int = 1):
        if not 0 < floor <= 1 or k < 1:
            raise ValueError("floor must be over 0 and at most 1, and k at least 1")
        self.group, self.a, self.b, self.floor, self.k = group, a, b, floor, k
        self.left, self.right = self._side(left, a, "a"), self._side(right, b, "b")

    def _side(self, rows: DataFrame, text: str, s: str) -> DataFrame:
        """``g, text_, id_, tokens_, m_, n_, h_``: tokens of each distinct text, their number, their length when joined, their signs."""
        one = rows.select(F.col(self.group).alias("g"), F.col(text).alias(f"text_{s}")).filter("g is not null").distinct()
        some = one.withColumn(f"tokens_{s}", _tokens(F.col(f"text_{s}"))).filter(F.size(f"tokens_{s}") > 0)
        joined = some.withColumn("__j", F.array_join(f"tokens_{s}", " "))
        length = F.length("__j")
        counts = F.transform(F.array(*[F.lit(c) for c in COUNTED]), lambda c: length - F.length(F.replace(F.col("__j"), c, F.lit(""))))
        return written(joined.select("g", f"text_{s}", F.monotonically_increasing_id().alias(f"id_{s}"), f"tokens_{s}", F.size(f"tokens_{s}").alias(f"m_{s}"), length.alias(f"n_{s}"), counts.alias(f"h_{s}")), f"alike-{s}")

    def shared(self) -> DataFrame:
        """``id_a, id_b, low, high`` of all pairs with a common token: what their ratio is at least and at most."""
        token = lambda df, s: df.select("g", f"id_{s}", F.explode(f"tokens_{s}").alias("t"))
        met = token(self.left, "a").join(token(self.right, "b"), ["g", "t"]).groupBy("id_a", "id_b").agg((F.sum(F.length("t") + 1) - 1).alias("s"), F.count("*").alias("c"))
        facts = lambda df, s: df.select(f"id_{s}", f"m_{s}", f"n_{s}", f"h_{s}")
        p = met.join(facts(self.left, "a"), "id_a").join(facts(self.right, "b"), "id_b")
        s, n_a, n_b = F.col("s"), F.col("n_a"), F.col("n_b")
        inside = (F.col("c") == F.col("m_a")) | (F.col("c") == F.col("m_b"))
        # of a text with more tokens than the common ones the rest is n - s - 1 long, behind a space
        rest = [2 * s / (s + n) for n in (n_a, n_b)]
        low = F.when(inside, 1.0).otherwise(F.greatest(*rest))
        high = F.when(inside, 1.0).otherwise(F.greatest(low, 1 - _apart(F.col("h_a"), F.col("h_b"), n_a, n_b) / (n_a + n_b)))
        return p.select("id_a", "id_b", low.alias("low"), high.alias("high"))

    def _reach(self, rows: DataFrame, value: str) -> DataFrame:
        """``id_a, reach``: the ``k``-th largest value of each text that has so many, else the floor."""
        ranked = rows.select("id_a", value, F.row_number().over(Window.partitionBy("id_a").orderBy(F.desc(value))).alias("__n")).filter(F.col("__n") <= self.k)
        kth = F.when(F.count("*") >= self.k, F.min(value)).otherwise(F.lit(self.floor))
        return ranked.groupBy("id_a").agg(F.greatest(kth, F.lit(self.floor)).alias("reach"))

    def _scored(self, pairs: DataFrame) -> DataFrame:
        texts = pairs.select("id_a", "id_b").join(self.left.select("id_a", "g", "text_a"), "id_a").join(self.right.select("id_b", "text_b"), "id_b")
        return token_set_ratio(texts, "text_a", "text_b", "ratio").filter(F.col("ratio") >= self.floor)

    def first(self) -> DataFrame:
        """``id_a, id_b`` of the pairs with a common token that need a ratio."""
        pairs = written(self.shared(), "alike-shared")
        return pairs.join(self._reach(pairs, "low"), "id_a").filter(F.col("high") >= F.col("reach") - SLACK).select("id_a", "id_b")

    def second(self, scored: DataFrame) -> DataFrame:
        """``id_a, id_b`` of the pairs without a common token that can still be among the best, after those ``scored``."""
        asked = self.left.join(self._reach(scored, "ratio"), "id_a", "left").withColumn("reach", F.coalesce("reach", F.lit(self.floor)) - SLACK).filter(F.col("reach") < 1 - 2 * SLACK)
        # 1 - |n_a - n_b| / (n_a + n_b) reaches so far only between these lengths
        asked = asked.withColumns({"least": F.greatest(F.lit(1), F.floor(F.col("n_a") * F.col("reach") / (2 - F.col("reach")))), "most": F.ceil(F.col("n_a") * (2 - F.col("reach")) / F.col("reach"))})
        asked = asked.withColumn("class", F.explode(F.sequence(_class(F.col("least")), _class(F.col("most")))))
        held = self.right.withColumn("class", _class(F.col("n_b")))
        can = 1 - _apart(F.col("h_a"), F.col("h_b"), F.col("n_a"), F.col("n_b")) / (F.col("n_a") + F.col("n_b")) >= F.col("reach")
        on = (asked["g"] == held["g"]) & (asked["class"] == held["class"]) & F.col("n_b").between(F.col("least"), F.col("most")) & can & ~F.arrays_overlap("tokens_a", "tokens_b")
        return asked.join(held, on).select("id_a", "id_b")

    def search(self, out: str = "relevancia") -> DataFrame:
        """The group, both texts and ``out`` of pairs of ``floor`` or more, among them the ``k`` best of every text and all that tie with the last."""
        met = written(self._scored(self.first()), "alike-first")
        both = met.unionByName(self._scored(self.second(met)))
        return both.select(F.col("g").alias(self.group), F.col("text_a").alias(self.a), F.col("text_b").alias(self.b), F.col("ratio").alias(out))
