import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tendermill.llm import mixing, sharding


def plain_fill(n, size, offset, skip):
    """The table by the textbook's loop over whole permutations."""
    orders = [[(offset[i] + j * skip[i]) % size for j in range(size)] for i in range(n)]
    owner = {}
    while len(owner) < size:
        for i in range(n):
            free = [s for s in orders[i] if s not in owner]
            if free:
                owner[free[0]] = i
    return [owner[s] for s in range(size)]


@pytest.mark.parametrize(("n", "size"), [(1, 2), (3, 7), (5, 101), (7, 13)])
def test_slots_by_brute_force(n, size):
    names = [f"s{i}" for i in range(n)]
    number = lambda k: int(hashlib.md5(k.encode()).hexdigest()[:15], 16)
    offset = [number(f":offset:{s}") % size for s in names]
    skip = [number(f":skip:{s}") % (size - 1) + 1 for s in names]
    got = sharding.claimed_slots(names, size)
    assert got == plain_fill(n, size, offset, skip)
    counts = Counter(got)
    assert max(counts.values()) - min(counts.values()) <= 1


def test_few_slots_move_when_a_shard_leaves():
    names = [f"s{i}" for i in range(10)]
    a, b = sharding.claimed_slots(names, 1009), sharding.claimed_slots(names[:-1], 1009)
    moved = sum(x != y for x, y in zip(a, b, strict=True) if x != 9)
    assert moved < 1009 * 0.25


def test_bad_tables():
    for shards, size in (([], 7), (["a", "a"], 7), (["a"], 8), (["a", "b", "c"], 2)):
        with pytest.raises(ValueError):
            sharding.claimed_slots(shards, size)


def test_assign_shards(spark):
    df = spark.createDataFrame([(1, "x"), (1, "x"), (None, None), (None, "y"), (2, "")], "doc_id long, shard string")
    got = sharding.assign_shards(df.withColumn("SLOT", F.lit(9)), ["a", "b", "c"], 101).collect()
    assert len(got) == 5 and all(r["shard"] in "abc" and 0 <= r["slot"] < 101 for r in got)
    assert len({r["slot"] for r in got if r["doc_id"] == 1}) == 1 and len({r["slot"] for r in got if r["doc_id"] is None}) == 1
    assert sharding.assign_shards(df.limit(0), ["a"], 2).count() == 0


def plain_budget(leaves, weights, budget, path=()):
    """Water filling of a tree by repeated rounds."""
    depth = len(path)
    kids = sorted({leaf[: depth + 1] for leaf in leaves if leaf[:depth] == path})
    if path in leaves:
        return {path: budget}
    cap = {k: sum(c for leaf, c in leaves.items() if leaf[: depth + 1] == k) for k in kids}
    w = {k: weights.get(k, 1) for k in kids}
    share, rest = {}, min(budget, sum(cap.values()))
    free = set(kids)
    while free:
        full = {k for k in free if cap[k] * sum(w[x] for x in free) <= w[k] * rest}
        if not full:
            total = sum(w[x] for x in free)
            share |= {k: w[k] * rest // total for k in free}
            break
        one = min(full, key=lambda k: (cap[k] / w[k], k))
        share[one] = cap[one]
        rest -= cap[one]
        free.remove(one)
    out = {}
    for k in kids:
        out |= plain_budget(leaves, weights, share[k], k)
    return out


@pytest.mark.parametrize("budget", [0, 50, 333, 900, 5000])
def test_budgets_by_brute_force(spark, budget):
    leaves = {("w", "en", "a"): 100, ("w", "en", "b"): 10, ("w", "de", "c"): 500, ("f", "en", "d"): 40, ("f", "fr", "e"): 7}
    weights = {("w",): 3, ("w", "en"): 5, ("w", "en", "b"): 4, ("f", "fr"): 9}
    df = spark.createDataFrame([(*k, v) for k, v in leaves.items()], "l0 string, l1 string, l2 string, cap long")
    got = {(r["l0"], r["l1"], r["l2"]): r["budget"] for r in mixing.allocate(df, ["l0", "l1", "l2"], weights, F.lit(budget)).collect()}
    assert got == plain_budget(leaves, weights, budget)


def plain_mix(rows, weights, budget, epochs, seed):
    leaves = Counter()
    for _, path, n in rows:
        leaves[path] += n
    given = plain_budget({k: v * epochs for k, v in leaves.items()}, weights, budget)
    out = Counter()
    for path, b in given.items():
        own = [(i, n) for i, p, n in rows if p == path]
        full, rest = divmod(b, leaves[path]) if leaves[path] else (0, 0)
        order = sorted((hashlib.md5(f"{seed}:{full}:{'' if i is None else i}".encode()).hexdigest(), i, n) for i, n in own) if own else []
        for i, _ in own:
            for e in range(full):
                out[(i, e)] += 1
        for u, i, _ in order:
            if rest > 0 and sum(m for v, _, m in order if v <= u) <= rest:
                out[(i, full)] += 1
    return out


@pytest.mark.parametrize(("budget", "epochs"), [(100, 1), (500, 4), (0, 2), (99_999, 3)])
def test_mix_by_brute_force(spark, budget, epochs):
    sources = [("w", "en", "hot")] * 60 + [("w", "de", "b"), ("f", "en", "c"), ("f", "", "d")] * 5
    rows = [(i, p, i % 7) for i, p in enumerate(sources)]
    weights = {("w",): 3, ("w", "en", "hot"): 2}
    df = spark.createDataFrame([(i, p[0], p[1] or None, p[2], n, "x") for i, p, n in rows], "doc_id long, domain string, lang string, source string, n long, epoch string")
    got = mixing.mix(df, ["domain", "lang", "source"], weights, budget=budget, max_epochs=epochs, tokens=F.col("n"))
    assert Counter((r["doc_id"], r["epoch"]) for r in got.collect()) == plain_mix(rows, weights, budget, epochs, "mix")


def test_mix_buckets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "DOCS_PER_BUCKET", 5)
    rows = [(i, ("w", "en", "hot"), 1 + i % 3) for i in range(300)]
    df = spark.createDataFrame([(i, *p, n) for i, p, n in rows], "doc_id long, domain string, lang string, source string, n long")
    for budget in (1, 10, 299, 400):
        got = mixing.mix(df, ["domain", "lang", "source"], {}, budget=budget, max_epochs=2, tokens=F.col("n"))
        assert Counter((r["doc_id"], r["epoch"]) for r in got.collect()) == plain_mix(rows, {}, budget, 2, "mix")


def test_mix_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string, domain string, lang string, source string")
    assert mixing.mix(df, ["domain", "lang", "source"], {}).count() == 0
    nulls = spark.createDataFrame([(None, None, None, None, None)] * 2, df.schema)
    assert mixing.mix(nulls, ["domain", "lang", "source"], {}).count() == 0
