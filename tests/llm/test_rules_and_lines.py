import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tendermill.llm import line_dedup, quality_rules, url_filters

WORD = re.compile(r"[^\x20\x09-\x0D]+")
GOOD = "The quick brown fox jumps over the lazy dog and then it sleeps well. "


def docs(spark, texts, extra=""):
    rows = [(i if t is not ... else None, None if t is ... else t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def brute_statistics(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


TEXTS = [
    GOOD, None, "", " \n\t\n", "a", GOOD * 3, "x " * 40, "a b c d e a b c d e", GOOD + "\n" + GOOD + "\n\nHome | About | Contact",
    "Menu\nHome\nLogin\n" * 5 + GOOD, "ÀÉ ñ" * 30 + ".", GOOD + "\nWe use cookies. Privacy policy.", "1 2 3 4 5 1 2 3 4 5 6 7 8 9 " + GOOD, "word. " * 20_000,
]


def test_statistics_equal_brute_force(spark):
    got = {r["doc_id"]: r for r in quality_rules.clean_lines(docs(spark, TEXTS)).collect()}
    assert len(got) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute_statistics(t), t and t[:40]
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])


def test_line_verdicts(spark):
    long = " ".join(f"word{i}" for i in range(30)) + "."
    texts = [long, long + "\nhome | about | help | more", "\n".join(f"item {i}" for i in range(40)), "LOUD!! WORDS!! " * 1 + " ".join(f"W{i}!!" for i in range(30))]
    got = {r["doc_id"]: r for r in quality_rules.clean_lines(docs(spark, texts)).collect()}
    assert got[0]["kept"] and got[0]["clean_text"] == long
    assert got[1]["kept"] and got[1]["clean_text"] == long and got[1]["n_bad_lines"] == 1
    assert not got[2]["kept"] and not got[2]["base_failed"] and not got[3]["kept"]
    kept = quality_rules.keep_clean(docs(spark, texts).withColumn("n_chars", F.lit(0).cast("long")))
    assert {(r["doc_id"], r["n_chars"]) for r in kept.collect()} == {(0, len(long)), (1, len(long))}


def test_odd_tables(spark):
    empty = docs(spark, []).limit(0)
    assert quality_rules.clean_lines(empty).count() == 0
    assert line_dedup.drop_frequent_lines(empty).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string")
    assert url_filters.filter_urls(pages, url_filters.default_rules()).count() == 0
    clash = docs(spark, [GOOD, GOOD]).withColumns({"n_words": F.lit("x"), "KEPT": F.lit(1), "n_lines": F.lit(2), "other": F.lit(3)})
    assert [r["n_words"] for r in quality_rules.clean_lines(clash).collect()] == [14, 14]
    assert {(r["n_lines"], r["other"]) for r in line_dedup.drop_frequent_lines(clash, min_docs=1).collect()} == {(1, 3)}


def brute_lines(texts, min_docs):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda x: x.strip(" \t\n\x0b\f\r").translate(low)
    seen = defaultdict(set)
    for i, t in enumerate(texts):
        for x in (t or "").split("\n"):
            seen[key(x)].add(i)
    out = []
    for i, t in enumerate(texts):
        lines = (t or "").split("\n")
        keep = [x for x in lines if not (key(x) and len(seen[key(x)]) >= min_docs)]
        out.append((i, len(lines), len(lines) - len(keep), "\n".join(keep)))
    return sorted(out)


def test_line_dedup_equals_brute_force(spark):
    texts = ["Same line\nown 1", " same LINE \nown 2", "\n\nSAME line\t\nÀ\nsame line", None, "", "À\nà", "À", "x\nx\nx", "a" * 100_000, "own 1"]
    for min_docs, batches in ((2, 1), (2, 5), (3, 3), (1, 2)):
        got = line_dedup.drop_frequent_lines(docs(spark, texts), min_docs=min_docs, batches=batches)
        assert sorted((r["doc_id"], r["n_lines"], r["n_dropped"], r["clean_text"]) for r in got.collect()) == brute_lines(texts, min_docs)


def test_line_dedup_null_ids_and_repeated_rows(spark):
    rows = [(None, "a\nb"), (None, "a\nc"), (1, "a\nd"), (1, "a\nd"), (1, "e")]
    got = line_dedup.drop_frequent_lines(spark.createDataFrame(rows, "doc_id long, text string"), min_docs=4)
    assert sorted(r["clean_text"] for r in got.collect()) == ["b", "c", "d", "d", "e"]


def test_url_rules(spark):
    rules = [url_filters.host_rule(*r) for r in [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/fr/", "block")]] + url_filters.default_rules()
    urls = [
        ("http://example.com/en/1", "example.com/en/", "block"), ("https://WWW.Example.com/en/1?x#y", "www.example.com/en/", "allow"), ("http://a.example.com/EN/1", "com/", "allow"),
        ("http://badexample.com/en/", "com/", "allow"), ("http://x.net/fr/a", "net/fr/", "block"), ("http://x.net/fr", None, "allow"), ("http://spam.site.org/", None, "block"),
        ("http://x.org/WP-LOGIN.php", None, "block"), ("http://x.org/a/Cart", None, "block"), ("http://x.org/cartoon", None, "allow"), ("http://my-casino.org/", None, "block"),
        ("http://com", None, "allow"), (None, None, "allow"), ("no url", None, "allow"), ("", None, "allow"), ("ftp://é.com/", "com/", "allow"), ("http://example.com/en/1", "example.com/en/", "block"),
    ]
    df = spark.createDataFrame([(i % 12 or None, u, "h") for i, (u, _, _) in enumerate(urls)], "page_id long, url string, host string")
    got = url_filters.filter_urls(df, rules)
    assert sorted((r["url"] or "", r["rule"] or "", r["verdict"]) for r in got.collect()) == sorted((u or "", r or "", v) for u, r, v in urls)
    split = {r["url"]: (r["host"], r["path"]) for r in got.collect()}
    assert split["https://WWW.Example.com/en/1?x#y"] == ("www.example.com", "/en/1") and split[None] == ("", "") and split["http://com"] == ("com", "")


def test_url_rules_must_be_given(spark):
    with pytest.raises(ValueError):
        url_filters.filter_urls(spark.createDataFrame([], "url string"), [])
    with pytest.raises(ValueError):
        url_filters.filter_urls(spark.createDataFrame([], "url string"), [url_filters.method_rule("x", ())])


@pytest.mark.parametrize("block", [7, 10_000])
def test_many_url_rules_in_blocks(spark, monkeypatch, block):
    """Against a plain loop over all rules, in one block and in many; ties go to the rule listed first, and no row is shuffled."""
    monkeypatch.setattr(url_filters, "MAX_BROADCAST_RULES", block)
    draw = random.Random(block)
    word = lambda: draw.choice("abcd") + draw.choice("xyz") + draw.choice(["", "é", "1"])
    rules = [url_filters.host_rule(f"{draw.choice('abcd')}{draw.choice('xyz')}.{draw.choice(['com', 'net'])}", draw.choice(["/", "/ax", "/ax/"]), draw.choice(["allow", "block"])) for _ in range(40)]
    rules += [url_filters.method_rule(rf"/{w}(?:/|$)", (w,), draw.choice(["block", "hold"]), draw.randint(1, 3)) for w in ("ax", "bx", "cy", "dz", "ax", "b1", "zz") for _ in range(3)]
    urls = [f"http://{draw.choice(['', 'WWW.', 'q-'])}{word()}.{draw.choice(['com', 'net', 'NET.org'])}/{word()}/{word()}{draw.choice(['', '?ax', '#bx'])}" for _ in range(400)] + [None, "", "ax"]

    df = spark.createDataFrame([(u,) for u in urls], "url string")
    got = url_filters.filter_urls(df, rules)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    for r in got.collect():
        whole = r["host"] + r["path"]
        fits = [(x.rank, -i, x) for i, x in enumerate(rules) if re.search(x.pattern, whole.lower() if x.fold else whole)]
        best = max(fits, default=None)
        assert (r["rule"], r["verdict"]) == ((best[2].name, best[2].verdict) if best else (None, "allow")), r


def test_menus_are_no_text(spark):
    menu, text = "Home | Shop | About us | Contact.", "A sentence with a dash → and a bullet • in it, but much longer than the links of any menu would be."
    got = quality_rules.clean_lines(docs(spark, [f"{menu}\n{text}"])).first()
    assert got["clean_text"] == text and got["n_bad_lines"] == 1


def test_sha_of_nothing(spark):
    r = line_dedup.drop_frequent_lines(docs(spark, ["a", "a"]), min_docs=2).select(F.sha2(F.col("clean_text").cast("binary"), 256).alias("h")).first()
    assert r["h"] == hashlib.sha256(b"").hexdigest()
