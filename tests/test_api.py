import json

import pytest
from pyspark.sql import functions as F

from tendermill.sources import notices
from tendermill.sources.api import read_api, stream_api

PUSH = "spark.sql.python.filterPushdown.enabled"


def page(folder, mode, state, n, ids, total):
    data = [{"numeroControlePNCP": f"c{i}", "modalidadeId": int(mode), "unidadeOrgao": {"ufSigla": state}} for i in ids]
    (folder / f"{mode}-{state}-{n}.json").write_text(json.dumps({"data": data} | ({} if total is None else {"totalPaginas": total})))


def options(folder):
    return {"url": f"file://{folder}/{{mode}}-{{state}}-{{page}}.json", "modes": "6,8", "states": "SP,RJ"}


@pytest.fixture
def api(tmp_path):
    for mode, state, n, ids, total in [("6", "SP", 1, [1, 2], 2), ("6", "SP", 2, [3], 2), ("8", "RJ", 1, [4], 9), ("6", "RJ", 1, [], 1)]:
        page(tmp_path, mode, state, n, ids, total)
    return tmp_path


def ids(df):
    return sorted(json.loads(r["json"])["numeroControlePNCP"] for r in df.collect())


def test_pages_of_modes_and_states(spark, api):
    raw = read_api(spark, **options(api))
    rows = notices.map_notices(raw.select(notices.variants(F.col("json")).alias("v"))).select("id_externo", "uf", "modalidade").collect()
    assert {(r["id_externo"], r["uf"]) for r in rows} == {("c1", "SP"), ("c2", "SP"), ("c3", "SP"), ("c4", "RJ")}
    landed = notices.read_notices(spark, str(api), modalidades=[6], ufs=["SP"])
    assert landed.count() == 3


@pytest.mark.parametrize("push", ["false", "true"])
def test_filters_with_and_without_pushdown(spark, api, push):
    spark.conf.set(PUSH, push)
    try:
        raw = read_api(spark, **options(api))
        assert ids(raw) == ["c1", "c2", "c3", "c4"]
        assert ids(raw.filter("mode = '6' and state = 'SP'")) == ["c1", "c2", "c3"]
        assert ids(raw.filter("state in ('RJ', 'XX') and page = 1")) == ["c4"]
        assert ids(raw.filter("mode = '99'")) == []
    finally:
        spark.conf.unset(PUSH)


def test_pushed_filters_ask_for_fewer_pages(spark, api):
    (api / "6-SP-1.json").write_text("broken")  # is not asked for
    spark.conf.set(PUSH, "true")
    try:
        assert ids(read_api(spark, **options(api)).filter("mode = '8'")) == ["c4"]
    finally:
        spark.conf.unset(PUSH)


def run(spark, api, tmp_path):
    out = str(tmp_path / "out")
    q = stream_api(spark, **options(api)).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "check")).start(out)
    q.processAllAvailable()
    q.stop()
    return ids(spark.read.parquet(out))


@pytest.mark.parametrize("total", [True, False])
def test_stream_goes_on_between_pages_and_inside_one(spark, tmp_path_factory, total):
    api, own = tmp_path_factory.mktemp("api"), tmp_path_factory.mktemp("own")
    page(api, "6", "SP", 1, [1, 2], 1 if total else None)
    page(api, "8", "RJ", 1, [10], 1 if total else None)
    assert run(spark, api, own) == ["c1", "c10", "c2"]
    assert run(spark, api, own) == ["c1", "c10", "c2"]
    # a row more on the last page, two new pages, and a state that had none
    page(api, "6", "SP", 1, [1, 2, 3], 3 if total else None)
    page(api, "6", "SP", 2, [4, 5, 6], 3 if total else None)
    page(api, "6", "SP", 3, [7], 3 if total else None)
    page(api, "6", "RJ", 1, [20], 1 if total else None)
    assert run(spark, api, own) == sorted(f"c{i}" for i in [1, 2, 3, 4, 5, 6, 7, 10, 20])
    page(api, "6", "SP", 3, [7, 8], 3 if total else None)
    assert run(spark, api, own) == sorted(f"c{i}" for i in [1, 2, 3, 4, 5, 6, 7, 8, 10, 20])
