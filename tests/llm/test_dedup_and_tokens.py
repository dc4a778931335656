import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tendermill.llm import decontaminate, jaccard_join, quality_classifier, substring_dedup, token_output

PATH = str(pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json"))


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


# ---------------------------------------------------------------- token output


@pytest.mark.parametrize("planes", ["byte", "bit"])
def test_blocks_round_trip(planes):
    rng = np.random.default_rng(1)
    for ids in (np.zeros(0, "<u4"), np.array([0]), np.array([2**32 - 1, 7]), rng.integers(0, 50_257, 10_001), np.full(9, 255)):
        ids = ids.astype("<u4")
        assert (token_output.unpack_block(token_output.pack_block(ids, planes)) == ids).all()


ODD = [
    "", "a", "  a", "a  b", "a\n\nb", " a", "a ", "x\ty", "don't stop\nit's <|endoftext|> ok", "a \nb", "a\n b", "l'été d'or it's² ½x 漢字", "a_b c're 'd", "x\xa0y z",
    "1234 5a!! ?? x", "Á ​ b", "\x00 \x1f a", "…«x» — y", "word " * 5000,
]


def test_encoding_equals_the_library():
    tok = Tokenizer.from_file(PATH)
    rng = random.Random(3)
    texts = ODD + ["".join(rng.choice("ab .,\n'é1$\t漢") for _ in range(rng.randint(0, 40))) for _ in range(400)]
    want = [np.array(tok.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]
    assert token_output.encode(texts, PATH) == want


def test_every_pair_of_plain_signs_encodes_as_in_the_library():
    """The signs whose pieces are cut by an expression: all pairs of them, at the start, in the middle and behind a space."""
    tok = Tokenizer.from_file(PATH)
    signs = [c for c in map(chr, range(0x21, 0x250)) if re.match(token_output._PLAIN, c)]
    assert len(signs) > 400
    texts = [f"{a}{b} x{a}{b}1 {a}{b}{a}'{b}" for a in signs for b in signs]
    for at in range(0, len(texts), 400):
        text = " ".join(texts[at : at + 400])
        assert token_output.encode([text], PATH)[0] == np.array(tok.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


def test_pieces_of_any_sign_encode_as_in_the_library():
    tok = Tokenizer.from_file(PATH)
    for at in range(0x80, 0x30000, 1024):
        signs = [c for c in map(chr, range(at, at + 1024)) if not 0xD800 <= ord(c) < 0xE000]
        text = " ".join(f"a{c} {c}b {c}1{c}" for c in signs) + "\n\n\nend\nit's"
        assert token_output.encode([text], PATH)[0] == np.array(tok.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


def test_files_round_trip(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_output, "BLOCK_IDS", 64)
    tok = Tokenizer.from_file(PATH)
    rows = [(i * 3 % 17, t) for i, t in enumerate(ODD)] + [(None, "first"), (5, None), (5, None)]
    out = str(tmp_path / "ids")
    token_output.write_ids(frame(spark, rows), out, PATH, 2, partitions=3, planes="bit")
    got = token_output.read_ids(spark, out).orderBy("start").collect()
    assert len(got) == len(rows) and [r["doc_id"] for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))
    at, want = 0, Counter()
    for r in got:
        assert r["start"] == at and len(r["ids"]) == 4 * r["n_tokens"]
        at += r["n_tokens"]
    for i, t in rows:
        want[(i, np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4").tobytes())] += 1
    assert Counter((r["doc_id"], bytes(r["ids"])) for r in got) == want
    digest = {(r["start"], r["ids_crc32"]) for r in token_output.id_digests(token_output.read_ids(spark, out)).collect()}
    assert digest == {(r["start"], zlib.crc32(r["ids"])) for r in got}


def test_no_documents_no_ids(spark, tmp_path):
    out = str(tmp_path / "none")
    token_output.write_ids(frame(spark, []), out, PATH, 2, partitions=2)
    assert token_output.read_ids(spark, out).count() == 0


# ---------------------------------------------------------------- substring dedup


def brute_repeats(rows, k):
    first = {}
    for i, t in rows:
        w = (t or "").encode().split()
        for j in range(len(w) - k + 1):
            if i is not None:
                key = tuple(w[j : j + k])
                first[key] = min(first.get(key, i), i)
    out = Counter()
    for i, t in rows:
        w = (t or "").encode().split()
        gone = {p for j in range(len(w) - k + 1) if i is not None and first[tuple(w[j : j + k])] < i for p in range(j, j + k)}
        out[(i, len(w), len(gone), b" ".join(x for p, x in enumerate(w) if p not in gone).decode())] += 1
    return out


@pytest.mark.parametrize(("common", "shard", "window"), [(1000, 100_000, 13), (2, 50, 13), (1000, 40, 4), (1, 30, 5)])
def test_repeats_equal_brute_force(spark, monkeypatch, common, shard, window):
    monkeypatch.setattr(substring_dedup, "COMMON_ANCHOR", common)
    monkeypatch.setattr(substring_dedup, "SHARD_WORDS", shard)
    rng = random.Random(window)
    words = [f"w{i}" for i in range(6)]
    phrases = [" ".join(rng.choice(words) for _ in range(rng.randint(10, 30))) for _ in range(6)]
    rows = [(i, " \n".join(rng.choice(phrases) if rng.random() < 0.6 else " ".join(rng.choice(words) for _ in range(8)) for _ in range(rng.randint(0, 5)))) for i in range(60)]
    rows += [(70, rows[3][1]), (71, rows[3][1]), (71, rows[4][1]), (None, rows[3][1]), (None, rows[5][1]), (80, None), (81, ""), (82, "w1 " * 300), (83, "w1 " * 400), (84, "é\xa0ü " * 20), (2, rows[2][1])]
    rng.shuffle(rows)
    got = substring_dedup.drop_repeats(frame(spark, rows).withColumn("n_words", F.lit("x")), window)
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["clean_text"]) for r in got.collect()) == brute_repeats(rows, window)


def test_automaton_owners():
    rng = random.Random(5)
    texts = [([rng.randint(0, 2) for _ in range(rng.randint(3, 25))], rng.randint(0, 9)) for _ in range(40)]
    a = substring_dedup.SuffixAutomaton()
    for t, o in texts:
        a.add(t, o)
    a.finish()
    for t, o in texts:
        want = [i for i in range(len(t) - 3) if any(p < o and any(u[j : j + 4] == t[i : i + 4] for j in range(len(u) - 3)) for u, p in texts)]
        assert a.older(t, o, 4) == want


def test_no_documents_no_repeats(spark):
    assert substring_dedup.drop_repeats(frame(spark, [])).count() == 0


# ---------------------------------------------------------------- near duplicates


def brute_classes(rows, rules):
    sets = {}
    for i, t in rows:
        if i is not None and (t or "").split():
            sets.setdefault(frozenset(jaccard_join.shingles(t.encode(), rules.words).tolist()), []).append(i)
    reps = {s: min(v) for s, v in sets.items()}
    keys = list(reps)
    links, top = Counter(), {s: s for s in keys}

    def root(s):
        while top[s] != s:
            s = top[s]
        return s

    for a in range(len(keys)):
        for b in range(a):
            x, y = keys[a], keys[b]
            if len(x & y) >= rules.similarity * len(x | y) - 1e-12:
                links[x] += 1
                links[y] += 1
                top[root(x)] = root(y)
    least = {}
    for s in keys:
        least[root(s)] = min(least.get(root(s), reps[s]), reps[s])
    out = Counter()
    for i, t in rows:
        s = frozenset(jaccard_join.shingles((t or "").encode(), rules.words).tolist())
        out[(i, reps[s], least[root(s)], links[s]) if s in reps and i is not None else (i, i, i, 0)] += 1
    return out


@pytest.mark.parametrize(("split", "tile", "loss"), [(512, 1024, 1e-6), (3, 6, 1e-6), (3, 1000, 0.0)])
def test_classes_equal_brute_force(spark, split, tile, loss):
    rng = random.Random(11)
    rows, n = [], 0
    for _ in range(8):
        base = [f"v{rng.randint(0, 10_000)}" for _ in range(rng.randint(60, 150))]
        for _ in range(rng.randint(1, 25)):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = f"e{rng.randint(0, 10_000)}"
            rows.append((n, " ".join(copy)))
            n += 1
    rows += [(n, rows[0][1]), (n + 1, rows[0][1]), (n + 1, rows[0][1]), (n + 2, None), (n + 3, "  "), (n + 4, "a b"), (n + 5, "a b"), (n + 6, "a b c d e"), (n + 7, "b " * 20_000), (None, rows[0][1])]
    rules = jaccard_join.JoinRules(split=split, tile=tile, sketch_loss=loss)
    got = jaccard_join.near_duplicates(frame(spark, rows).withColumn("class_id", F.lit("x")), rules)
    assert Counter((r["doc_id"], r["copy_of"], r["class_id"], r["n_links"]) for r in got.collect()) == brute_classes(rows, rules)
    kept = [r["doc_id"] for r in jaccard_join.keep_first(frame(spark, rows), rules).collect()]
    classes = brute_classes(rows, rules)
    assert sorted((k for k in kept if k is not None)) == sorted({c for i, _, c, _ in classes if i is not None}) and kept.count(None) == 1


@pytest.mark.parametrize("nulls", [1, 2])
def test_an_id_with_two_texts_loses_only_the_copy(spark, nulls):
    a, b, c = (" ".join(f"{w}{i}" for i in range(60)) for w in "abc")
    rows = [(1, a), (5, a), (5, b), (7, c), (7, c), (8, b), (9, None), (9, None), (9, "")] + [(None, a)] * nulls
    got = jaccard_join.keep_first(spark.createDataFrame(rows, "doc_id long, text string"))
    want = [(1, a), (5, b), (7, c), (9, None), (9, "")] + [(None, a)] * nulls
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_near_duplicates_of_nothing(spark):
    assert jaccard_join.near_duplicates(frame(spark, [])).count() == 0
    assert jaccard_join.keep_first(frame(spark, [(1, None), (2, "")])).count() == 2


@pytest.mark.parametrize("size", [20, 100, 400])
def test_paths_recall(size):
    """Pairs at exactly 0.8, half of them a set and its subset: how many meet at each of the three levels."""
    rules = jaccard_join.JoinRules()
    rng = np.random.default_rng(size)
    met = [0, 0, 0]
    for pair in range(400):
        all_tokens = rng.integers(1, 2**63, size, dtype=np.uint64)
        if pair % 2:
            a, b = np.sort(all_tokens), np.sort(all_tokens[: size * 8 // 10])
        else:
            a, b = np.sort(all_tokens[: size * 9 // 10]), np.sort(all_tokens[size // 10 :])
        x, y = jaccard_join.first_paths(a, rules), jaccard_join.first_paths(b, rules)
        for level in range(3):
            if level:
                x, y = jaccard_join.longer_paths(a, np.unique(x), rules), jaccard_join.longer_paths(b, np.unique(y), rules)
            met[level] += bool(np.intersect1d(x, y).size)
    print(size, met)
    assert min(met) >= 398


def test_sketches_lose_no_more_than_they_may():
    rules = jaccard_join.JoinRules()
    least = jaccard_join.least_alike(rules.similarity, rules.sketch_loss)
    for n in (1, 10, 64, 128):
        below = sum(math.comb(n, k) * 0.8**k * 0.2 ** (n - k) for k in range(least[n]))
        assert below <= rules.sketch_loss and least[n] < 0.8 * n
    assert jaccard_join.JoinRules(sketch_loss=0.0).runs <= rules.runs
    assert jaccard_join.JoinRules(recall=0.9999999, sketch_loss=1e-8).runs > 31
    with pytest.raises(ValueError):
        _ = jaccard_join.JoinRules(recall=1 - 1e-15, sketch_loss=0.0).runs


# ---------------------------------------------------------------- benchmark leaks


def brute_cover(doc, item, k):
    """Greedy string tiling by trying every pair of places."""
    d, i = decontaminate.tokens(doc).tolist(), decontaminate.tokens(item).tolist()
    md, mi = [False] * len(d), [False] * len(i)
    while True:
        best = (0, 0, 0)
        for a in range(len(d)):
            for b in range(len(i)):
                n = 0
                while a + n < len(d) and b + n < len(i) and d[a + n] == i[b + n] and not md[a + n] and not mi[b + n]:
                    n += 1
                if n > best[0]:
                    best = (n, a, b)
        n, a, b = best
        if n < k:
            return sum(mi) / len(i) if len(i) >= k else 0.0
        md[a : a + n], mi[b : b + n] = [True] * n, [True] * n


def test_leaks_equal_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    words = [f"t{i}" for i in range(12)]
    items = [(j, " ".join(rng.choice(words) for _ in range(rng.randint(3, 18)))) for j in range(6)] + [(None, "t1 t2 t3 t4 t5 t6"), (7, None), (8, "")]
    texts = []
    for _ in range(25):
        part = rng.choice(items[:6])[1].split()
        cut = rng.randint(0, len(part))
        texts.append(" ".join([rng.choice(words), *part[cut:], rng.choice(words).upper() + ",", *part[:cut]]))
    rows = [*enumerate([*texts, None, "", "T1, t2; t3 (t4) t5 t6!"]), (None, texts[0]), (0, texts[0])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for shard in (10_000, 60):
        monkeypatch.setattr(decontaminate, "MAX_SHARD_CHARS", shard)
        got = decontaminate.find_leaks(frame(spark, rows).withColumn("coverage", F.lit("x")), bench)
        seen = Counter()
        for r in got.collect():
            seen[(r["doc_id"], r["n_items"], round(r["coverage"], 9), r["kept"])] += 1
        want = Counter()
        for i, t in rows:
            cover = [brute_cover(t or "", x or "", 5) for _, x in items]
            n = sum(c >= 0.5 for c in cover)
            want[(i, n, round(max(cover), 9), n == 0)] += 1
        assert seen == want
    assert decontaminate.find_leaks(frame(spark, []), bench).count() == 0
    assert decontaminate.drop_leaks(frame(spark, rows), bench.limit(0)).count() == len(rows)


def test_equal_words_without_end():
    """2,000,000 equal words against an item of 300: memory stays with the length of the text."""
    import tracemalloc

    index = decontaminate.SeedIndex([(1, "x " * 300, 1), (2, "y z " * 100, 1)], 5)
    tracemalloc.start()
    n, found, item, coverage = index.matches("x " * 2_000_000, decontaminate.TilingRules())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (n, found, item, coverage) == (2_000_000, 1, 1, 1.0) and peak < 1_000_000_000
    # no match is longer than 8 words, and there are very many of them
    assert decontaminate.SeedIndex([(1, " ".join(f"a{i % 8}" for i in range(64)), 1)], 5).matches("a0 a1 a2 a3 a4 a5 a6 a7 b " * 20_000, decontaminate.TilingRules())[3] == 1.0


def test_a_full_bitmap_finds_nothing_by_itself():
    index = decontaminate.SeedIndex([(1, "a b c d e f", 1)], 5)
    index.bitmap[:] = True
    assert index.matches("v w x y z v w", decontaminate.TilingRules()) == (7, 0, None, 0.0)
    assert index.matches("v a b c d e f z", decontaminate.TilingRules()) == (8, 1, 1, 1.0)


def test_one_index_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "MAX_SHARD_CHARS", 100)
    items = [(j, " ".join(f"q{j}x{i}" for i in range(6))) for j in range(5)] + [(9, " ".join(f"long{i}" for i in range(40)))]
    bench = spark.createDataFrame([*items, items[0]], "item_id long, text string")
    shards = decontaminate._shards(bench)
    sizes = [[len(r["text"]) for r in s.collect()] for s in shards]
    assert len(shards) >= 3 and all(sum(s) <= 100 or len(s) == 1 for s in sizes)
    live, most = set(), []
    make = type(spark.sparkContext).broadcast

    def broadcast(self, value):
        b = make(self, value)
        end = b.destroy
        live.add(id(b))
        most.append(len(live))

        def destroy(*args, **kw):
            live.discard(id(b))
            end(*args, **kw)

        b.destroy = destroy
        return b

    monkeypatch.setattr(type(spark.sparkContext), "broadcast", broadcast)
    rows = [(i, t) for i, t in items] + [(20, items[0][1] + " " + items[3][1])]
    got = {r["doc_id"]: (r["n_items"], r["item_id"]) for r in decontaminate.find_leaks(frame(spark, rows), bench).collect()}
    assert got == {0: (2, 0), 1: (1, 1), 2: (1, 2), 3: (1, 3), 4: (1, 4), 9: (1, 9), 20: (3, 0)}
    assert len(most) == len(shards) and max(most) == 1 and not live


# ---------------------------------------------------------------- classifier


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    held = F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(4)) == 0
    got = quality_classifier.classify(docs, labels.filter(~held)).join(labels.filter(held), "doc_id").collect()
    assert len(got) > 60
    assert sum((r["quality_score"] >= 0.5) == (r["quality"] == 1) for r in got) / len(got) > 0.93
    assert sum((r["toxic_score"] >= 0.5) == (r["toxic"] == 1) for r in got) / len(got) > 0.85


def test_classifier_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b", None, "en"), (None, None, "s", None), (1, "a b", None, "en")], "doc_id long, text string, source string, lang string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality_classifier.classify(docs, none).collect()
    assert len(got) == 3 and all(abs(r["quality_score"] - 0.5) < 1e-9 for r in got)
    assert quality_classifier.classify(docs.limit(0), none).count() == 0


def plain_posteriors(rows, evidence):
    """Scores by plain loops: rows of (host, path), and each row's log-odds of one target."""

    def sigmoid(x):
        return 1 / (1 + math.exp(-x))

    def logit(p):
        p = min(max(p, 1e-6), 1 - 1e-6)
        return math.log(p / (1 - p))

    def strength(groups):
        n = sum(k for k, _ in groups)
        m = sum(k * mean for k, mean in groups) / n
        within = m * (1 - m)
        between = max(sum(k * mean * mean for k, mean in groups) / n - m * m - within / (n / len(groups)), 1e-9)
        return min(max(within / between - 1, 1.0), 10_000.0)

    def means(keys):
        of = {}
        for k, e in zip(keys, evidence, strict=True):
            of.setdefault(k, []).append(sigmoid(e))
        return {k: (len(v), sum(v) / len(v)) for k, v in of.items()}

    hosts, paths = means([h for h, _ in rows]), means(rows)
    whole = sum(map(sigmoid, evidence)) / len(evidence)
    s = strength(list(hosts.values()))
    host = {h: (n * m + s * whole) / (n + s) for h, (n, m) in hosts.items()}
    s = strength(list(paths.values()))
    path = {k: (n * m + s * host[k[0]]) / (n + s) for k, (n, m) in paths.items()}
    return [sigmoid(e + logit(path[k]) - logit(whole)) for k, e in zip(rows, evidence, strict=True)]


def test_posteriors_equal_plain_python(spark):
    rng = random.Random(8)
    rows = []
    for i in range(400):
        site = rng.choice(["big"] * 30 + ["mid"] * 8 + ["one", "two", None])
        bad = rng.random() < {"big": 0.2, "mid": 0.7, "one": 1.0, "two": 0.0, None: 0.5}[site]
        words = [rng.choice(["junk", "spam", "casino", "offer"] if bad and rng.random() < 0.7 else ["river", "stone", "house", "green", "walk"]) for _ in range(rng.randint(5, 60))]
        rows.append((i if i % 50 else None, " ".join(words), site, rng.choice(["en", "de", None]), bad))
    rows += [(1000, None, "big", "en", False), (1001, "", "new", "fr", False), (3, rows[3][1], "big", "en", False), (1002, "river " * 30_000, "long", "en", False)]
    docs = spark.createDataFrame([(i, t, s, g, "x") for i, t, s, g, _ in rows], "page long, text string, source string, lang string, quality_score string")
    labels = spark.createDataFrame([(i, int(not bad), int(bad)) for i, _, _, _, bad in rows[:300] if i is not None] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    rules = quality_classifier.BayesRules(min_z=2.0)
    model = quality_classifier.fit_evidence(docs.withColumnRenamed("page", "doc_id").select("doc_id", "text"), labels, rules)
    assert model["weights"]
    got = Counter((r["page"], r["host"], r["path"], round(r["quality_score"], 6), round(r["toxic_score"], 6), r["kept"]) for r in quality_classifier.classify(docs, labels, rules=rules, key="page").collect())
    sites = [(s or "", f"{s or ''}/{g or ''}") for _, _, s, g, _ in rows]
    scores = []
    for c, target in enumerate(quality_classifier.TARGETS):
        evidence = [sum((model["weights"][f][c] for f in sorted(quality_classifier.features(t) & model["weights"].keys())), model["prior"][target]) for _, t, _, _, _ in rows]
        scores.append(plain_posteriors(sites, evidence))
    want = Counter((r[0], h, p, round(q, 6), round(x, 6), q >= 0.5 and x < 0.5) for r, (h, p), q, x in zip(rows, sites, *scores, strict=True))
    assert got == want


def test_sparse_sites_shrink(spark):
    """Two hosts with the same share of bad documents: the one with few documents stays nearer to the others' mean."""
    rng = random.Random(9)
    rows = []
    for host, n, share in [("big", 600, 0.9), ("small", 5, 0.9), ("a", 500, 0.1), ("b", 500, 0.12), ("c", 500, 0.08)]:
        for j in range(n):
            bad = j < n * share
            rows.append((len(rows), " ".join(rng.choice(["junk", "spam"] if bad else ["river", "stone"]) for _ in range(8)), host, "en", bad))
    docs = spark.createDataFrame([r[:4] for r in rows], "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(i, int(not bad), int(bad)) for i, *_, bad in rows if i % 4 == 0], "doc_id long, quality int, toxic int")
    probe = spark.createDataFrame([(10_000, "zzz", "big", "en"), (10_001, "zzz", "small", "en"), (10_002, "zzz", "a", "en")], docs.schema)
    got = {r["doc_id"]: r["toxic_score"] for r in quality_classifier.classify(docs.unionByName(probe), labels).collect()}
    assert got[10_000] > got[10_001] > got[10_002]
