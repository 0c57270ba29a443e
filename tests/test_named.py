"""Named queries by name with good and bad arguments, and cards by recipe."""

import pytest
from pyspark.sql import functions as F

from atalaya.bindings import frames as B
from atalaya.operators import corpus, funnel
from atalaya.plans import named

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    vectors = spark.createDataFrame([(i, [float(i == k) for k in range(4)]) for i in range(4)], "vec_id long, embedding array<double>")
    return {"names": B.gazetteer(spark, SF), "panel": B.panel(spark, SF), "forecasts": B.forecasts(spark, SF), "anomalies": B.alerts(spark, SF),
            "rates": B.rates(spark, SF), "titles": funnel.funnel_rate(B.cube(spark, SF), "title"), "corpus": vectors}


def test_good_calls(tables):
    row = tables["panel"].orderBy("cod_municipio", "categoria").first()
    series = {"code": row.cod_municipio, "category": row.categoria}
    assert named.call(tables, "recent_months", {**series, "months": 500}).rows.count() <= 60
    assert named.call(tables, "recent_months", {**series, "months": "3"}).rows.count() <= 3
    ahead = tables["forecasts"].first()
    assert named.call(tables, "forecast", {"code": ahead.cod_municipio, "category": ahead.categoria, "months": 2}).rows.count() in (1, 2)
    assert named.call(tables, "alerts", {"code": "none"}).rows.count() == 0
    assert {"menor_tasa", "mayor_tasa"} <= set(named.call(tables, "funnel").rows.columns)
    assert named.call(tables, "funnel", {"code": row.cod_municipio}).rows.count() <= 1
    hits = named.call(tables, "passages", {"vector": [0, 1, 0, 0]}).rows.collect()
    assert [r.vec_id for r in hits] == [1] and not hits[0].abstiene
    town = tables["names"].where(F.col("s_suppkey") == 2).first()
    found = named.call(tables, "resolve_territory", {"text": f"dime de {town.municipio.lower()}"}).rows.collect()
    assert [r.cod_municipio for r in found] == [town.cod_municipio]


def test_bad_calls(tables):
    for name, arguments in (("nothing", {}), ("alerts", {}), ("alerts", {"code": 7}), ("alerts", {"code": "1", "x": 2}),
                            ("recent_months", {"code": "1", "category": "x", "months": "many"}), ("passages", {"vector": ["x"]})):
        answer = named.call(tables, name, arguments)
        assert answer.rows is None and answer.error
    assert "absent tables" in named.call({}, "alerts", {"code": "1"}).error
    assert named.NAMED["forecast"].schema() == {
        "type": "object", "properties": {"code": {"type": "string"}, "category": {"type": "string"},
                                         "months": {"type": "integer", "minimum": 1, "maximum": 12}}, "required": ["code", "category"]}


def test_cards_by_recipe(spark):
    df = spark.createDataFrame([("int", "a", "u1", "2020-01-01"), ("int", "b", "u2", "2021-05-01"), ("ext", "a", "u1", None)],
                               "tipo string, tipo_auditoria string, unidad string, fecha_inicial string")
    text = corpus.cards_by_recipe(df, "auditorias").first().content
    assert "3 registros entre 2020 y 2021" in text and "Por origen: int (2), ext (1)." in text and "Por unidad auditada: u1 (2), u2 (1)." in text
    assert "3 registros." in corpus.cards_by_recipe(df, "otra").first().content
