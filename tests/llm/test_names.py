"""Every operator passes columns of any name, or says which it refuses."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tendermill.llm import decontaminate, jaccard_join, line_dedup, mixing, quality_classifier, quality_rules, sentence_pieces, sharding, substring_dedup, token_output, url_filters

ROWS = [(1, "one two three four five six seven eight nine ten.", "src1", "en"), (None, None, None, None), (3, "", "src2", "de"), (3, "", "src2", "de"), (4, "a b c d e f g h i j k l m n o p.", "src1", "en")]
#: Names that operators use themselves, names with dots and spaces.
EXTRA = ["a.b", "a b", "spans", "quality", "toxic", "host", "path", "slot2", "token", "key", "h1", "n", "score", "words", "gram"]


@pytest.fixture(scope="module")
def docs(spark):
    frame = spark.createDataFrame(ROWS, "doc_id long, text string, source string, lang string")
    return frame.select("*", *[F.lit(i).alias(c) for i, c in enumerate(EXTRA)])


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, "zz yy xx ww vv uu tt ss rr qq pp oo nn mm")], "item_id long, text string").withColumn("a.b", F.lit(1))


RUNS = {
    "mixing": lambda d, b: mixing.mix(d, ["lang"], {("en",): 2}, budget_pct=100, max_epochs=1),
    "sharding": lambda d, b: sharding.assign_shards(d, ["x", "y"], 101),
    "clean_lines": lambda d, b: quality_rules.clean_lines(d),
    "keep_clean": lambda d, b: quality_rules.keep_clean(d),
    "keep_first": lambda d, b: jaccard_join.keep_first(d),
    "near_duplicates": lambda d, b: jaccard_join.near_duplicates(d),
    "drop_repeats": lambda d, b: substring_dedup.drop_repeats(d, 5),
    "find_leaks": lambda d, b: decontaminate.find_leaks(d, b),
    "drop_leaks": lambda d, b: decontaminate.drop_leaks(d, b),
    "filter_urls": lambda d, b: url_filters.filter_urls(d.withColumn("url", F.lit("https://a.b/c")), url_filters.default_rules()),
    "drop_frequent_lines": lambda d, b: line_dedup.drop_frequent_lines(d, min_docs=2),
    "pieces": lambda d, b: sentence_pieces.encode(d, str(public_tokenizers.path("piece_bpe_32k.model"))),
}


@pytest.mark.parametrize("name", RUNS)
def test_columns_of_any_name_pass(docs, benchmark, name):
    out = RUNS[name](docs, benchmark)
    rows = out.collect()
    assert rows
    if name != "near_duplicates":
        replaced = {"host", "path"} if name == "filter_urls" else set()
        assert [c for c in docs.columns if c not in replaced] == [c for c in out.columns if c in docs.columns and c not in replaced]
        assert {r["a.b"] for r in rows} == {0} and {r["spans"] for r in rows} == {EXTRA.index("spans")}


def test_token_output_reads_two_columns(docs, tmp_path):
    token_output.write_ids(docs, str(tmp_path / "ids"), str(public_tokenizers.path("byte_bpe_50k.json")), 2)
    assert token_output.read_ids(docs.sparkSession, str(tmp_path / "ids")).count() == len(ROWS)


@pytest.mark.parametrize("key", ["doc_id", "a.b", "text", "host", "Path"])
def test_classifier_names(spark, docs, key):
    labels = spark.createDataFrame([(i, i % 2, i % 2, "x") for i in range(6)], "doc_id long, quality int, toxic int, text string").withColumn("a.b", F.lit(1))
    if key == "text":
        labels = labels.withColumn("doc_id", F.col("doc_id").cast("string"))
    if key.lower() in ("host", "path"):
        with pytest.raises(ValueError, match="another name"):
            quality_classifier.classify(docs, labels, key=key)
        return
    got = quality_classifier.classify(docs, labels, key=key)
    assert got.columns == [key, "host", "path", "quality_score", "toxic_score", "kept"] and got.count() == len(ROWS)
