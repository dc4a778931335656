"""Offset-preserving pieces against the library; Merkle manifests and hard negatives against plain Python."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceNormalizer
from sentencepiece import sentencepiece_model_pb2 as pb

from tendermill.llm import entries, hard_negatives, merkle, sentence_pieces

from ..compare import duck, same

MODEL = str(public_tokenizers.path("piece_bpe_32k.model"))
SF = "/root/testdata/sf0.001"
SIGNS = [" ", "  ", "a", "b", "the", "Ａ", "é", "é", "ﬁ", "　", "▁", "①", "㍿", "¨", "̈", "ｶﾞ", "\t", "\n", "​", "梦", "𝒳", "🜁", "Z", "9", "½", "\0", "­", "<s>", "<0x41>"]


def texts(n, most=14, seed=1):
    draw = random.Random(seed)
    return ["".join(draw.choice(SIGNS) for _ in range(draw.randint(0, most))) for _ in range(n)]


def agrees(encoder, text):
    ids, first, after = encoder(text, ends=False)
    want = encoder.library.encode(text, return_type="proto").pieces
    assert ids.tolist() == [p.id for p in want], text
    assert list(zip(first.tolist(), after.tolist())) == [(p.begin, p.end) for p in want], text


@pytest.fixture(scope="module", params=[None, (True, True), (True, False), (False, True), (False, False)])
def encoder(request, tmp_path_factory):
    """The given model, and the same pieces behind a compiled map of compatibility forms, with and without extra spaces and a mark in front."""
    if request.param is None:
        return sentence_pieces.Encoder(MODEL)
    model, mapped = pb.ModelProto(), pb.ModelProto()
    model.ParseFromString(open(MODEL, "rb").read())
    mapped.ParseFromString(SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto())
    spec = model.normalizer_spec
    spec.precompiled_charsmap = mapped.normalizer_spec.precompiled_charsmap
    spec.remove_extra_whitespaces, spec.add_dummy_prefix = request.param
    path = tmp_path_factory.mktemp("model") / "mapped.model"
    path.write_bytes(model.SerializeToString())
    return sentence_pieces.Encoder(str(path))


def test_ids_and_offsets_are_the_librarys(encoder):
    for t in ["", " ", "   ", "Hello  world ", " x", "x" * 300, "ab" * 2000, "▁▁", *texts(1500)]:
        agrees(encoder, t)


def test_every_sign_alone_and_in_a_word(encoder):
    signs = [chr(p) for p in [*range(0, 0x3100), *range(0xAC00, 0xAC40), *range(0xF900, 0xFFFE), *range(0x1D400, 0x1D800, 7), *range(0x1F600, 0x1F650)]]
    for at in range(0, len(signs), 40):
        agrees(encoder, "a".join(signs[at : at + 40]))


def test_parts_are_forgotten_and_learnt_again(monkeypatch):
    monkeypatch.setattr(sentence_pieces, "CACHE_PARTS", 50)
    encoder = sentence_pieces.Encoder(MODEL)
    for t in texts(300, 30, 2):
        agrees(encoder, t)


def test_encoded_tables(spark):
    rows = [(1, "Hello wörld 梦", "x"), (2, None, "y"), (2, None, "y"), (3, "", None), (4, "a b " * 60_000, "z"), (None, "🜁", "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `a.b` string").withColumns({"ids": F.lit(1), "Begins": F.lit(2)})
    got = sentence_pieces.encode(docs, MODEL, decoded=True)
    assert got.columns == ["doc_id", "text", "a.b", "ids", "begins", "ends", "decoded"]
    library = sentence_pieces.Encoder(MODEL).library
    for r in got.collect():
        want = library.encode(r["text"] or "", add_bos=True, add_eos=True)
        assert np.frombuffer(r["ids"], dtype="<u4").tolist() == want and r["decoded"] == library.decode(want)
        raw = (r["text"] or "").encode()
        assert len(r["begins"]) == len(r["ends"]) == len(want)
        assert b"".join(raw[a:b] for a, b in zip(r["begins"], r["ends"])) == raw
    again = sentence_pieces.decode(got.select("ids", "decoded"), MODEL)
    assert [r["decoded"] for r in again.collect()] == [r["decoded"] for r in got.collect()]
    assert sentence_pieces.encode(docs.limit(0), MODEL).count() == 0


def test_op11_over_all_documents(spark):
    library = sentence_pieces.Encoder(MODEL).library
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = entries.op11_sentencepiece(spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = library.encode(docs[r["doc_id"]], add_bos=True, add_eos=True)
        digest = hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), digest, hashlib.sha256(library.decode(ids).encode()).hexdigest())


# ---------------------------------------------------------------- Merkle


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(values):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def climb(nodes, spot):
    """The root, and the siblings of a node on its way there."""
    siblings = []
    while len(nodes) > 1:
        start = spot - spot % 3
        siblings.append((nodes[start:spot], nodes[spot + 1 : start + 3]))
        nodes, spot = [sha(*nodes[i : i + 3]) for i in range(0, len(nodes), 3)], spot // 3
    return nodes[0], siblings


def plain_manifest(rows, changed):
    """Of each row ``(id, source, value)`` what ``manifest`` returns, with another value where ``changed`` gives one."""
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    sorted_rows = {g: sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r))) for g in order}
    leaves = {g: [leaf_of(r) for r in sorted_rows[g]] for g in order}
    roots = [climb(leaves[g], 0)[0] for g in order]
    out = []
    for k, g in enumerate(order):
        root, above = climb(roots, k)
        for i, r in enumerate(sorted_rows[g]):
            steps = climb(leaves[g], i)[1] + above
            other = leaf_of((r[0], r[1], changed(r)))
            path = [other]
            for before, after in steps:
                path.append(sha(*before, path[-1], *after))
            out.append((r[0], r[1], leaves[g][i], roots[k], root, [s for pair in steps for side in pair for s in side], path if other != leaves[g][i] else [], path[-1]))
    return out


@pytest.mark.parametrize("levels", [1, 2, 6])
@pytest.mark.parametrize("n", [0, 1, 2, 3, 28, 250])
def test_manifest_equals_plain_python(spark, n, levels):
    draw = random.Random(n)
    rows = [(draw.choice([None, *range(200)]), draw.choice([None, "", "a", "b", "ß", "hot", "hot", "hot", "hot"]), draw.choice([None, "x\ny", "z", ""])) for _ in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("leaf", F.lit("clash")).withColumn("a.b", F.lit(1))
    got = merkle.manifest(docs, ["doc_id", "source", "text"], changed={"text": F.replace("text", F.lit("\n"), F.lit(""))}, levels=levels)
    assert got.columns == ["doc_id", "source", "leaf", "subroot", "root", "siblings", "copied", "folded_root"]
    want = plain_manifest(rows, lambda r: None if r[2] is None else r[2].replace("\n", ""))
    key = lambda r: str(tuple(r))
    assert sorted(map(key, got.collect())) == sorted(map(key, want))
    for r in got.collect():
        assert (r["folded_root"] == r["root"]) == (r["copied"] == [])


def test_versions_share_all_but_one_path(spark):
    """A version's own nodes are as many as the tree is high, whatever its size; equal leaves have equal versions."""
    docs = spark.range(500).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit("a\nb").alias("text"))
    got = merkle.manifest(docs, ["doc_id", "text"], changed={"text": F.lit("ab")}, levels=3).collect()
    assert {len(r["copied"]) for r in got} == {1 + merkle.height(500)} and len({r["copied"][0] for r in got}) == 500


def test_op12_equals_its_sql(spark):
    con = duck(SF)
    same(entries.op12_merkle_manifest(spark, SF), con, entries.oracle_sql()["op12_merkle_manifest"])
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in entries.op12_merkle_manifest(spark, SF).collect():
        tampered = zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0 and "\n" in (docs[r["doc_id"]]["text"] or "")
        assert r["verified"] == (not tampered)


# ---------------------------------------------------------------- hard negatives


def brute(rows, is_anchor, k=5):
    """Hard negatives by all pairs, over rows ``(id, label, vector)``."""
    kept = []
    for i, (key, label, v) in enumerate(rows):
        if label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            kept.append((i, key, label, [int(np.floor(256 * float(x))) for x in v]))
    out = []
    for i, key, label, v in kept:
        if not is_anchor(key):
            continue
        scored = [(sum(a * b for a, b in zip(v, w)), other, lab, j) for j, other, lab, w in kept if j != i]
        scored.sort(key=lambda s: (-s[0], s[1] is None, s[1] or 0))
        for ps, pid, _, _ in [s for s in scored if s[2] == label][:k]:
            fits = [s for s in scored if s[2] != label and 80 * ps <= 100 * s[0] <= 100 * ps][:k]
            out += [(key, pid, rank, nid, ps, ns) for rank, (ns, nid, _, _) in enumerate(fits, 1)]
    return out


def vectors(n, dims, seed, spread=1.0):
    draw = np.random.default_rng(seed)
    centres = draw.standard_normal((6, dims))
    return [[float(np.float32(x)) for x in centres[draw.integers(6)] + spread * draw.standard_normal(dims)] for _ in range(n)]


@pytest.mark.parametrize(("at_once", "spread"), [(4096, 1.0), (7, 1.0), (4096, 0.1), (3, 0.05)])
def test_negatives_equal_brute_force(spark, at_once, spread):
    draw = random.Random(at_once)
    rows = [(i, draw.randrange(4), v) for i, v in enumerate(vectors(400, 8, at_once, spread))]
    # ties and copies, nulls of all kinds, other lengths, a null id, a repeated anchor
    rows += [(400 + i, draw.randrange(4), rows[10][2]) for i in range(40)]
    rows += [(500, None, rows[1][2]), (501, 1, None), (502, 1, [None] * 8), (503, 1, [float("nan")] * 8), (510, 1, [float("inf")] * 8), (504, 1, rows[3][2][:3]), (505, 2, [])]
    rows += [(None, 1, rows[5][2]), (None, 2, rows[6][2]), (20, 1, rows[20][2]), (20, 1, rows[20][2])]
    frame = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").withColumn("score", F.lit("clash")).withColumn("a.b", F.lit(1)).repartition(5)
    got = hard_negatives.mine(frame, F.col("vec_id") % 10 == 0, anchors_at_once=at_once)
    want = brute(rows, lambda key: key is not None and key % 10 == 0)
    assert len(want) > 150
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_large_components_and_empty_tables(spark):
    schema = "vec_id long, label int, embedding array<double>"
    rows = [(i, i % 2, [1e5 * (i + 1), -3e4 * i, 7.5]) for i in range(30)]
    got = hard_negatives.mine(spark.createDataFrame(rows, schema), F.col("vec_id") % 10 == 0)
    assert sorted(map(tuple, got.collect())) == sorted(brute(rows, lambda key: key % 10 == 0))
    with pytest.raises(OverflowError):
        hard_negatives.mine(spark.createDataFrame([(0, 1, [1e12])], schema), F.lit(True))
    for some in (rows[:0], rows[1:5]):
        assert hard_negatives.mine(spark.createDataFrame(some, schema), F.col("vec_id") % 10 == 0).count() == 0


def test_bounds_spare_scores():
    """Close anchors share what is known of a row: far fewer rows are scored again than there are pairs."""
    draw = np.random.default_rng(5)
    centre = draw.standard_normal(32) * 100
    anchors = np.floor(centre + draw.standard_normal((60, 32)) * 2)
    rows = np.floor(draw.standard_normal((5000, 32)) * 100)
    tree, order = hard_negatives.Tree.grown(anchors)
    assert sorted(order.tolist()) == list(range(60)) and (tree.parent[1:] < np.arange(1, 60)).all()
    scores = rows @ tree.vectors.T
    cut = np.sort(scores, axis=0)[-20]
    scored = 0
    for k, hit, found in tree.walk(rows, lambda k: (cut[k], np.inf, np.ones(5000, dtype=bool))):
        assert set(np.flatnonzero(scores[:, k] >= cut[k])) <= set(hit.tolist())
        assert (found == scores[hit, k]).all()
        scored += len(hit)
    assert scored < 0.1 * scores.size


def test_op13_equals_its_sql(spark):
    same(entries.op13_hard_negatives(spark, SF), duck(SF), entries.oracle_sql()["op13_hard_negatives"])
