"""The whole pipeline against plain Python versions of its stages."""

import hashlib
import re
from collections import Counter

import corpus_pipeline
from tendermill.llm import decontaminate, jaccard_join, quality_rules, sharding
from tendermill.llm.entries import MIX_WEIGHTS, SHARDS, SLOTS

from .test_dedup_and_tokens import brute_classes, brute_cover
from .test_mix_and_shards import plain_mix
from .test_rules_and_lines import WORD, brute_statistics

SF = "/root/testdata/sf0.001"
SPACE = " \t\n\x0b\f\r"


def plain_clean(text):
    """The kept lines, or None for a document that goes."""
    n, _chars, _symbols, _dups, repeats = brute_statistics(text)
    if n < 10 or 100 * repeats > 20 * n:
        return None
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]

    def fails(x):
        marks = len(re.findall(r"[#*$%&|<>{}!~^=_]", x))
        parts = sum(x.count(c) for c in quality_rules.SEPARATORS)
        if parts >= 2 and len(x) < 25 * (parts + 1):
            return True
        return x.rstrip(SPACE)[-1] not in quality_rules.TERMINAL or marks > len(x) * 0.05 or any(p in x.lower() for p in quality_rules.BOILERPLATE)

    good = [x for x in lines if not fails(x)]
    total = sum(map(len, lines))
    return "\n".join(good) if total - sum(map(len, good)) <= total * 0.5 else None


def domain(source):
    n = int(re.search(r"\d+$", source)[0])
    return "web" if n < 10 else "forum" if n < 15 else "reference"


def test_pipeline_equals_plain_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    texts = {i: t for i, r in rows.items() if (t := plain_clean(r["text"])) is not None}
    classes = brute_classes(list(texts.items()), jaccard_join.JoinRules())
    texts = {i: t for i, t in texts.items() if any(d == i and c == i for d, _, c, _ in classes)}
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]

    def grams(t):
        w = decontaminate.tokens(t).tolist()
        return {tuple(w[j : j + 5]) for j in range(len(w) - 4)}

    of_item = [(x, grams(x)) for x in items]
    leaks = {i for i, t in texts.items() if any(g & own and brute_cover(t, x, 5) >= 0.5 for own in [grams(t)] for x, g in of_item)}
    assert leaks
    texts = {i: t for i, t in texts.items() if i not in leaks}
    sizes = [(i, (domain(rows[i]["source"]), rows[i]["lang"], rows[i]["source"]), len(WORD.findall(t))) for i, t in texts.items()]
    chosen = plain_mix(sizes, MIX_WEIGHTS, sum(n for *_, n in sizes) * corpus_pipeline.PIPELINE_PCT // 100, 1, "mix")
    owner = sharding.claimed_slots(SHARDS, SLOTS)
    want = Counter()
    for (i, _epoch), n in chosen.items():
        slot = int(hashlib.md5(f":{i}".encode()).hexdigest()[:15], 16) % SLOTS
        want[(i, texts[i], len(texts[i]), rows[i]["lang"], rows[i]["source"], slot, SHARDS[owner[slot]])] += n
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == [*docs.columns, "slot", "shard"]
    assert Counter((r["doc_id"], r["text"], r["n_chars"], r["lang"], r["source"], r["slot"], r["shard"]) for r in got.collect()) == want


def test_stages_keep_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    assert len(corpus_pipeline.STAGES) == 5
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert docs.count() == 0
