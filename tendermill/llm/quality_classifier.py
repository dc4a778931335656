"""Quality classifier by hierarchical empirical Bayes: a document's own evidence, and the posteriors of its host and path."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import ship
from .common import quoted, written

_UPPER = bytes(range(65, 91))
_MARKS = b"#*$%&|<>!"
_STRIPPED = {i: None for i in range(33, 127) if not chr(i).isalnum()}
TARGETS = ("quality", "toxic")
#: Sites that are broadcast at most (about 150 bytes each); beyond it the join is by shuffle, which AQE splits where a site is hot.
MAX_BROADCAST_SITES = 50_000


@dataclass(frozen=True)
class BayesRules:
    """Bounds of what is fitted, and limits of the verdict.

    ``max_labelled`` labelled documents (about, chosen by a hash of the id) fit the evidence: all features that ``min_docs`` of them
    have and that are ``min_z`` standard deviations off. So the size of the model is bounded by that of the sample.
    """

    max_labelled: int = 20_000
    min_docs: int = 5
    min_z: float = 5.0
    ridge: float = 1e-4
    min_quality: float = 0.5
    max_toxic: float = 0.5


def features(text: str | None) -> set[str]:
    """A text's words in lower case without ASCII punctuation, and bins of its shape (these start with ``=``, which no word keeps)."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n, size = max(1, len(words)), max(1, len(raw))
    lines = [x for x in text.split("\n") if x.strip()]
    shape = {
        "marks": 20 * (len(raw) - len(raw.translate(None, _MARKS))) // size,
        "upper": 10 * (len(raw) - len(raw.translate(None, _UPPER))) // size,
        "again": 10 * sum(a == b for a, b in zip(words, words[1:])) // n,
        "kinds": 10 * len(set(words)) // n,
        "length": int(math.log2(len(words) + 1)),
        "open": 10 * sum(not re.search(r"[.!?…:;\"'”’»)\]]\s*$", x[-4:]) for x in lines) // max(1, len(lines)),
    }
    found = set(text.lower().translate(_STRIPPED).split())
    found.update(f"={k}:{v}" for k, v in shape.items())
    return found


def _labelled_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        tokens = [sorted(features(t)) for t in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(tokens, pa.list_(pa.string())), *batch.columns[1:]], names=["tokens", *TARGETS])


#: Columns that ``classify`` adds to the key.
RESULT = {"host", "path", "quality_score", "toxic_score", "kept"}


def fit_evidence(docs: DataFrame, labels: DataFrame, rules: BayesRules = BayesRules()) -> dict:
    """Log-odds of each target: ``{"prior": {target: x}, "weights": {feature: (x, x)}}``, of bounded size.

    Features that differ between labels are chosen by counts over the sample; a logistic regression over them gives the
    weights. Rows of ``labels`` (``doc_id, quality, toxic``) with a null, or without a document, are left out. Without labels of
    both kinds a target has no evidence and even odds.
    """
    ship(docs.sparkSession)
    labels = labels.select("doc_id", *TARGETS).dropna()
    total = max(1, labels.count())
    some = labels.filter(F.pmod(F.xxhash64("doc_id"), F.lit(total)) < rules.max_labelled) if total > rules.max_labelled else labels
    # about ``max_labelled`` rows at most, so no text is shuffled for them
    joined = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").select("text", *[F.col(c).cast("int").alias(c) for c in TARGETS])
    sample = written(joined.mapInArrow(_labelled_features, "tokens array<string>, quality int, toxic int"), "labelled-features")
    n, *sums = sample.agg(F.count("*"), *[F.coalesce(F.sum(c), F.lit(0)) for c in TARGETS]).first()
    ones = dict(zip(TARGETS, sums, strict=True))
    fitted = [c for c in TARGETS if 0 < ones[c] < n]
    prior = {c: math.log(ones[c] / (n - ones[c])) if c in fitted else 0.0 for c in TARGETS}
    if not fitted:
        return {"prior": prior, "weights": {}}
    counts = sample.select(F.explode("tokens").alias("token"), *TARGETS).groupBy("token").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in TARGETS])
    # how far a feature's count among the labelled is off what its frequency alone would give, in standard deviations
    off = [F.abs(F.col(c) - F.col("n") * (ones[c] / n)) / F.sqrt(F.col("n") * (ones[c] / n * (1 - ones[c] / n))) for c in fitted]
    strong = counts.filter(F.col("n") >= rules.min_docs).withColumn("z", F.greatest(*off, F.lit(0.0))).filter(F.col("z") >= rules.min_z)
    chosen = [r["token"] for r in strong.orderBy("token").collect()]  # of the sample, so bounded
    if not chosen:
        return {"prior": prior, "weights": {}}
    vectors = CountVectorizerModel.from_vocabulary(chosen, inputCol="tokens", outputCol="features").setBinary(True).transform(sample)
    by_target = []
    for c in TARGETS:
        if c not in fitted:
            by_target.append([0.0] * len(chosen))
            continue
        model = LogisticRegression(labelCol=c, regParam=rules.ridge, maxIter=100).fit(vectors.select("features", c))
        prior[c] = model.intercept
        by_target.append(model.coefficients.toArray().tolist())
    return {"prior": prior, "weights": dict(zip(chosen, zip(*by_target, strict=True), strict=True))}


def _evidence(model):
    def evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = model.value["weights"]
        prior = [model.value["prior"][c] for c in TARGETS]
        known = weights.keys()
        for batch in batches:
            scores: list[list[float]] = [[], []]
            for text in batch.column(0):
                sums = list(prior)
                for f in sorted(known & features(text.as_py())):
                    for i, w in enumerate(weights[f]):
                        sums[i] += w
                for i in (0, 1):
                    scores[i].append(sums[i])
            rest = [batch.column(i) for i in range(1, batch.num_columns)]
            yield pa.RecordBatch.from_arrays([*rest, *[pa.array(s, pa.float64()) for s in scores]], names=[*batch.schema.names[1:], *[f"{c}_evidence" for c in TARGETS]])

    return evidence


def _logit(p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.ln(q / (1 - q))


def _shrunk(groups: DataFrame, n: str, mean: str, toward: Column, spread: DataFrame, name: str) -> DataFrame:
    """Posterior means: ``mean`` of ``n`` rows, pulled to ``toward`` with the weight of ``strength`` rows, found by moments."""
    return groups.crossJoin(F.broadcast(spread)).withColumn(name, (F.col(n) * F.col(mean) + F.col("strength") * toward) / (F.col(n) + F.col("strength"))).drop("strength")


def _strength(groups: DataFrame, n: str, mean: str) -> DataFrame:
    """One row: how many rows the level above is worth, from the variance of a Beta prior by moments (between 1 and 10,000)."""
    m = (F.sum(F.col(n) * F.col(mean)) / F.sum(n)).alias("m")
    v = (F.sum(F.col(n) * F.col(mean) * F.col(mean)) / F.sum(n)).alias("v2")
    sums = groups.agg(m, v, (F.sum(n) / F.count("*")).alias("size"))
    within = F.col("m") * (1 - F.col("m"))
    between = F.greatest(F.col("v2") - F.col("m") * F.col("m") - within / F.col("size"), F.lit(1e-9))
    return sums.select(F.coalesce(F.least(F.greatest(within / between - 1, F.lit(1.0)), F.lit(10_000.0)), F.lit(1.0)).alias("strength"))


def classify(docs: DataFrame, labels: DataFrame, host: str = "source", path: tuple[str, ...] = ("source", "lang"), rules: BayesRules = BayesRules(), key: str = "doc_id") -> DataFrame:
    """``doc_id`` (the ``key``), ``host``, ``path``, ``quality_score``, ``toxic_score`` (double, 0 to 1) and ``kept`` for each row of ``docs``.

    Evidence is the log-odds of a regression on features with a proven difference among labelled documents. The mean probability of every
    host over all of its documents is shrunk to the global mean, and that of every path to its host, the more the fewer documents it
    has; the strength comes from the spread between sites (empirical Bayes). A document's odds are its evidence with its path's
    odds in place of the global ones. ``kept``: good enough and not toxic.

    A null host or path column counts as the empty string; a null text has no words; null ids and repeated rows are judged like
    any other; ``labels`` name documents by ``doc_id``, their other columns are not read. A ``key`` named like a column of the result is a ValueError. Other columns of ``docs`` are not returned, whatever their names. Sites are sums by group, added up in each task first, so a host with a third of all rows is no one's
    task; one row a site is broadcast while the sites are few. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    if key.lower() in RESULT:
        raise ValueError(f"the key needs another name than {', '.join(sorted(RESULT))}")
    model = spark.sparkContext.broadcast(fit_evidence(docs.select(F.col(quoted(key)).alias("doc_id"), "text"), labels, rules))
    site = docs.select(
        F.col("text").alias("__text"), F.col(quoted(key)).alias("__key"), F.coalesce(F.col(quoted(host)).cast("string"), F.lit("")).alias("host"),
        F.concat_ws("/", *[F.coalesce(F.col(quoted(c)).cast("string"), F.lit("")) for c in path]).alias("path"),
    )
    schema = T.StructType([T.StructField("__key", docs.schema[key].dataType), *[T.StructField(c, T.StringType()) for c in ("host", "path")], *[T.StructField(f"{c}_evidence", T.DoubleType()) for c in TARGETS]])
    scored = written(site.mapInArrow(_evidence(model), schema), "evidence")

    paths = scored.groupBy("host", "path").agg(F.count("*").alias("n"), *[F.avg(1 / (1 + F.exp(-F.col(f"{c}_evidence")))).alias(c) for c in TARGETS])
    paths = written(paths, "path-means")
    for c in TARGETS:
        hosts = paths.groupBy("host").agg(F.sum(F.col("n") * F.col(c)).alias("s"), F.sum("n").alias("host_n")).withColumn("host_mean", F.col("s") / F.col("host_n"))
        whole = hosts.agg((F.sum("s") / F.sum("host_n")).alias(f"{c}_global"))
        hosts = _shrunk(hosts.crossJoin(F.broadcast(whole)), "host_n", "host_mean", F.col(f"{c}_global"), _strength(hosts, "host_n", "host_mean"), f"{c}_host")
        paths = paths.join(hosts.select("host", f"{c}_host", f"{c}_global"), "host")
        paths = _shrunk(paths, "n", c, F.col(f"{c}_host"), _strength(paths, "n", c), f"{c}_path")
    sites = written(paths.select("host", "path", *[(_logit(F.col(f"{c}_path")) - _logit(F.col(f"{c}_global"))).alias(f"{c}_shift") for c in TARGETS]), "sites")
    small = F.broadcast(sites) if sites.count() <= MAX_BROADCAST_SITES else sites
    out = scored.join(small, ["host", "path"])
    score = {c: (1 / (1 + F.exp(-(F.col(f"{c}_evidence") + F.col(f"{c}_shift"))))).alias(f"{c}_score") for c in TARGETS}
    out = out.select(F.col("__key").alias(key), "host", "path", *score.values())
    return out.withColumn("kept", (F.col("quality_score") >= rules.min_quality) & (F.col("toxic_score") < rules.max_toxic))
