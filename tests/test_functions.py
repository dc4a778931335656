import datetime as dt
import re
import unicodedata

from pyspark.sql import functions as F

from tendermill.functions import attributes, numbers, text
from tendermill.operators import matching, validation
from tendermill.sources import notices
from tendermill.streaming.streams import admit


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(column.alias("x")).first()["x"]


def test_normalize_equals_the_definition(spark):
    samples = ["", "Ação  e Órgão!", "½ ﬁm² x\t\n y", "ÀÉÎõü ß ñ", "a_b-c", "  só  ", "漢字 abc", "…"]
    df = spark.createDataFrame([(s,) for s in samples], "t string")
    got = [r["n"] for r in df.select(text.normalize(F.col("t")).alias("n")).collect()]
    for s, g in zip(samples, got, strict=True):
        flat = unicodedata.normalize("NFKD", s).encode("ascii", "ignore").decode().lower()
        assert g == re.sub(r"\s+", " ", re.sub(r"[^a-z0-9\s]", " ", flat)).strip()
    assert one(spark, text.normalize(F.lit(None).cast("string"))) == ""


def test_every_code_point_is_normalized_as_defined(spark):
    signs = [chr(c) for c in [*range(0x80, 0xD800), *range(0xE000, 0x110000)] if unicodedata.decomposition(chr(c))]
    signs += ["😀", "漢", "한", "\U00010330"]
    texts = ["x" + "".join(signs[i : i + 5]) + "y" for i in range(0, len(signs), 5)]
    got = {r["t"]: r["n"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.normalize_light(F.col("t")).alias("n")).collect()}
    assert len(signs) > 5_000 and all(got[t] == unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode().lower() for t in texts)
    assert one(spark, text.normalize(F.lit("10 ㎡ de ㎏, ㎝ ⑩"))) == "10 m2 de kg cm 10"


def _lcs(a, b):
    rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            rows[i + 1][j + 1] = rows[i][j] + 1 if x == y else max(rows[i][j + 1], rows[i + 1][j])
    return rows[-1][-1]


def test_token_set_ratio_against_its_formula(spark):
    pairs = [("", "a"), ("a b", "b a"), ("papel a4", "papel a4 branco"), ("caneta azul", "caneta preta"), ("abc", "xyz"), ("a b c d", "c d e f")]
    got = {(r["a"], r["b"]): r["ratio"] for r in text.token_set_ratio(spark.createDataFrame(pairs, "a string, b string"), "a", "b").collect()}
    for p, q in pairs:
        a, b = set(p.split()), set(q.split())
        s, x, y = (" ".join(sorted(z)) for z in (a & b, a - b, b - a))
        if not a or not b:
            want = 0.0
        elif s and (not x or not y):
            want = 1.0
        else:
            g, d = bool(s), len(x) + len(y) - 2 * _lcs(x, y)
            want = 1 - d / ((len(s) + g + len(x)) + (len(s) + g + len(y)))
            if s:
                want = max(want, *[1 - (g + n) / (2 * len(s) + g + n) for n in (len(x), len(y))])
        assert abs(got[(p, q)] - want) < 1e-9, (p, q)


def test_numbers(spark):
    assert one(spark, numbers.parse_br_number(F.lit("R$ 1.234,56"))) == 1234.56
    assert one(spark, numbers.parse_br_number(F.lit("1.234"))) == 1.234
    assert one(spark, numbers.parse_br_number(F.lit("n/d"))) is None
    assert one(spark, numbers.format_brl(F.lit(1234.5))) == "R$ 1.234,50"
    assert one(spark, numbers.format_brl(F.lit(0.0))) is None
    assert attributes.number_of("2.500") == 2500 and attributes.number_of("1.0") == 1.0 and attributes.number_of("2.500,50") == 2500.5
    assert one(spark, numbers.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) == 0.0
    assert one(spark, numbers.week_start(F.lit(dt.date(1998, 8, 1)))) == dt.date(1998, 7, 26)
    assert one(spark, numbers.parse_date(F.lit("31/12/1998"))) == dt.date(1998, 12, 31)
    assert one(spark, numbers.parse_date(F.lit("x"))) is None


def found(light):
    return {(u, v, o, g) for _, u, v, o, _, g, _ in attributes.numeric_attributes(light)}


def test_numeric_attributes():
    assert found("no minimo 30 ppm e bandeja para 250 folhas") == {("ppm", 30.0, ">=", False), ("folhas", 250.0, "==", False)}
    assert found("comprimento: 145") == {("mm", 145.0, "==", True)}
    assert found("digitos: 12") == {("digitos", 12.0, "==", False)}
    assert found("bloco post-it 3m") == set()
    assert found("2 m/min") == set()
    chain = [r for r in attributes.numeric_attributes("28 x 16 x 7cm") if r[-1] is not None]
    assert [(r[1], r[2]) for r in chain] == [("cm", 28.0), ("cm", 16.0), ("cm", 7.0)] and len({r[-1] for r in chain}) == 1
    assert found("12x50") == {("mm", 12.0, "==", True), ("mm", 50.0, "==", True)}
    assert ("litros", 2.0, "<=", False) in found("ate 2 litros")


def test_attributes_of_whole_sentences():
    """Units, labels, chains and limits together, written down by hand from the rules."""

    def rows(light):
        return [(u, v, o, raw, guess, chain is not None) for _, u, v, o, raw, guess, chain in attributes.numeric_attributes(light)]

    assert rows("comprimento: 145, largura: 15") == [("mm", 145.0, "==", "145", True, False), ("mm", 15.0, "==", "15", True, False)]
    assert rows("30x40cm") == [("cm", 30.0, "==", "30", False, True), ("cm", 40.0, "==", "40cm", False, False), ("cm", 40.0, "==", "40", False, True)]
    assert rows("3x500ml") == [("ml", 500.0, "==", "500ml", False, False)]
    assert rows("peso minimo de 1.234,5 kg, ate 2.500 folhas") == [("kg", 1234.5, ">=", "1.234,5 kg", False, False), ("folhas", 2500.0, "<=", "2.500 folhas", False, False)]
    assert rows("altura: 12,5cm") == [("cm", 12.5, "==", "12,5cm", False, False)]
    assert rows("tensao: 220 e numero de digitos: 12") == [("volts", 220.0, "==", "220 volts", False, False), ("digitos", 12.0, "==", "12 digitos", False, False)]
    assert rows("10 x 20 x 500ml") == [("mm", 10.0, "==", "10", True, True), ("mm", 20.0, "==", "20", True, True), ("ml", 500.0, "==", "500ml", False, False)]
    assert rows("largura: 21 x 30") == [("mm", 21.0, "==", "21", True, False), ("mm", 21.0, "==", "21", True, True), ("mm", 30.0, "==", "30", False, True)]
    assert rows("fita 3m 3 m") == [("m", 3.0, "==", "3 m", False, False)]
    assert rows("pelo menos 5 litros. 7 litros") == [("litros", 5.0, ">=", "5 litros", False, False), ("litros", 7.0, "==", "7 litros", False, False)]
    assert rows("monitor 15,6\" 75.25 w 1.234.567 g") == [("polegadas", 15.6, "==", '15,6"', False, False), ("watts", 75.25, "==", "75.25 w", False, False), ("gramas", 1234567.0, "==", "1.234.567 g", False, False)]


def test_validation_rules(spark):
    rows = [
        (1, "no mínimo 250 folhas", "bandeja de 300 folhas", None, 0, 0),
        (2, "no mínimo 250 folhas", "bandeja de 100 folhas", None, 1, 0),
        (3, "5000 folhas", "500 folhas", 5000.0, 0, 0),
        (4, "30 x 40 cm", "40 x 30 cm", None, 0, 0),
        (5, "30 x 40 cm", "40 x 31 cm", None, 1, 0),
        (6, "largura: 21", "21 cm", None, 0, 1),
        (7, "bivolt", "apenas 220v", None, 1, 0),
        (8, "2 litros", "2000 ml", None, 0, 0),
        (9, "180 g", "180 g e 60 kg", None, 0, 1),
        (10, "caneta", "lápis", None, 0, 0),
        (11, "duplex", "duplex manual", None, 1, 0),
        (12, None, None, None, 0, 0),
    ]
    df = spark.createDataFrame([r[:4] for r in rows], "par long, item_texto string, produto_texto string, itens_por_unidade double")
    got = {r["par"]: (r["criticas"], r["avisos"], r["verificavel"]) for r in validation.validate_pairs(df).collect()}
    for par, *_rest, critical, warned in rows:
        assert got[par][:2] == (critical, warned), (par, got[par])
    assert not got[10][2] and got[1][2]


def test_matching_ties_and_levels(spark):
    scores = spark.createDataFrame([(1, 1, 1, 7, 0.9), (1, 1, 1, 3, 0.9), (1, 1, 2, 5, 0.0)], "usuario_id long, edital_id long, numero int, produto_id long, score double")
    best = {r["numero"]: r["produto_id"] for r in matching.best_by_score(scores).collect()}
    assert best == {1: 3}
    w = matching.second_best(scores, matching.winners_of(scores))
    assert [r["confianca"] for r in matching.confidence(w).collect()] == ["media"]
    for s, b, f, want in [(0.7, 0.95, 0.01, "forte"), (0.7, 0.8, 0.01, "medio"), (0.5, 0.5, 0.5, "medio"), (0.1, 0.1, 0.0, "fraco")]:
        assert one(spark, matching.level(F.lit(s), F.lit(b), F.lit(f))) == want


def test_known_pairs_are_not_scored_again(spark):
    pairs = spark.createDataFrame([("a b", "a b"), ("c", "d")], "texto_item string, texto_produto string")
    first = matching.score_pairs(pairs)
    again = matching.score_pairs(pairs.unionByName(spark.createDataFrame([("e", "e")], pairs.schema)), known=first)
    assert again.count() == 1


def test_limiter():
    rows, alive = admit([0, 10, 20, 70], [False] * 4, [], 2, 60)
    assert [r[1] for r in rows] == [True, True, False, True] and rows[2][2] == 41
    assert [r[1] for r in admit([0, 1, 2, 3], [False, False, True, False], [], 2, 60)[0]] == [True, True, True]


def test_sources(spark):
    reply = spark.createDataFrame([('```json\n{"a": 1}\n```',), ("{bad",), (None,)], "t string").select(notices.get(notices.parse_response(F.col("t")), "a", "int").alias("a"))
    assert [r["a"] for r in reply.collect()] == [1, None, None]
    parts = one(spark, notices.control_number_parts(F.lit("00000000000001-1-000007/1996")))
    assert (parts["cnpj"], parts["ano"], parts["seq"]) == ("00000000000001", 1996, 7)
    assert one(spark, notices.control_number_parts(F.lit("x"))) is None
    raw = spark.createDataFrame([('{"id": 1, "valor": 1234.5, "objeto": "x"}',), ('{"id": 2, "valor": "1.234,50"}',), ("{}",)], "t string").select(notices.variants(F.col("t")).alias("v"))
    assert {r["id_externo"]: r["valor_estimado"] for r in notices.map_transparencia(raw).collect()} == {"transp-1": 1234.5, "transp-2": 1234.5}
    items = spark.createDataFrame([(1, '[{"numeroItem": 1}]'), (2, '{"data": [{"numeroItem": 2}]}'), (3, "{}")], "k int, p string")
    assert sorted((r["k"], r["numero"]) for r in notices.explode_items(items, "k", "p").collect()) == [(1, 1), (2, 2)]
