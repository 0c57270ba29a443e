"""Features, anomalies, forecasts, monitoring and exact quantiles on synthetic panels."""

from datetime import date

import numpy as np
import pytest
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from atalaya.operators import anomaly, features as W, quantiles, serve
from atalaya.plans import backtest as BT, forecast as FC, metrics as M, monitoring as MON
from atalaya.plans.scenario import Scenario, scenario_projection
from atalaya.sources.catalog import response_categories

RESPONSE = response_categories()


def months(n, start=(2019, 1)):
    return [date(start[0] + (start[1] - 1 + i) // 12, (start[1] - 1 + i) % 12 + 1, 1) for i in range(n)]


def panel_of(spark, series, start=(2019, 1), population=None):
    rows = []
    for (code, cat), values in series.items():
        pop = None if population is None else float(population[code])
        rows += [(code, code, "D", cat, d, int(v), pop) for d, v in zip(months(len(values), start), values)]
    out = spark.createDataFrame(rows, "cod_municipio string, municipio string, departamento string, categoria string, "
                                      "periodo date, cantidad bigint, poblacion double")
    return out if population is not None else out.drop("poblacion")


def linear():
    return LinearRegression(featuresCol="features", labelCol="objetivo", predictionCol="pred", regParam=0.1, solver="normal")


@pytest.fixture(scope="module")
def eight(spark):
    rng = np.random.default_rng(77)
    series, people = {}, {}
    for i in range(8):
        m = np.arange(48)
        level = 20 + 30 * i + 5 * np.sin(2 * np.pi * (m % 12 + 1) / 12) + rng.normal(0, 2, 48)
        series[(f"1{i:04d}", "HURTO")] = np.clip(np.round(level), 0, None)
        people[f"1{i:04d}"] = 50_000 + 100_000 * i
    return panel_of(spark, series, population=people)


@pytest.mark.parametrize("rows_a_task,tasks", [(50_000, 1), (100, 4)])
def test_tasks_of_a_panel_follow_its_rows(spark, eight, monkeypatch, rows_a_task, tasks):
    """Not the number of shuffle partitions, which grows with the events behind the panel."""
    monkeypatch.setattr(FC, "ROWS_A_TASK", rows_a_task, raising=False)
    held = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        prepared = FC.prepare_panel(eight)
        state = FC.series_state(prepared, date(2022, 1, 1))
        assert prepared.rows.count() == 8 * 48 and prepared.rows.rdd.getNumPartitions() == tasks
        assert state.count() == 8 and state.rdd.getNumPartitions() <= tasks
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_features_use_only_the_past(spark):
    p = panel_of(spark, {("1", "A"): range(24)}, (2020, 1))
    rows = {r.periodo: r for r in W.make_features(p).collect()}
    ordered = [rows[d] for d in months(24, (2020, 1))]
    assert ordered[0].lag_1 is None and ordered[5].lag_1 == 4
    assert ordered[4].media_hist == 1.5 and ordered[4].meses_activos == 4.0
    assert ordered[2].roll_mean_3 is None and ordered[3].roll_mean_3 == 1.0
    assert ordered[3].roll_std_3 == pytest.approx(1.0)
    assert ordered[0].trend == 1.0 and ordered[12].trend == 13.0


def test_hist_mean_forgets(spark):
    p = panel_of(spark, {("1", "A"): [100] * 24 + [2] * 61})
    last = W.with_hist_mean(p).orderBy(F.desc("periodo")).first()
    assert last.media_hist == 2.0


def test_seasonal_is_by_calendar(spark):
    p = panel_of(spark, {("1", "A"): range(30)}).where("periodo <> date'2020-03-01'")
    got = {r.periodo: r.estacional for r in W.seasonal_naive(p, F.lit(date(2021, 1, 1))).collect()}
    assert got[date(2021, 1, 1)] == 12 and got[date(2021, 3, 1)] == 0 and got[date(2021, 4, 1)] == 15


def test_detector_on_injected_spikes(spark):
    rng = np.random.default_rng(77)
    series, truth = {}, set()
    for i in range(40):
        level = 20 + 5 * i
        y = np.clip(np.round(rng.normal(level, np.sqrt(level) * 0.6, 60)), 0, None)
        for m in rng.choice(np.arange(15, 60), 1):
            y[m] = 4 * level
            truth.add((f"2{i:04d}", months(60)[m]))
        series[(f"2{i:04d}", "HURTO_PERSONAS")] = y
    found = {(r.cod_municipio, r.periodo) for r in anomaly.detect(panel_of(spark, series), RESPONSE).collect()}
    hits = len(found & truth)
    assert hits / len(found) >= 0.85 and hits / len(truth) >= 0.9


def test_quiet_series_and_blips(spark):
    quiet, blip = np.zeros(36), np.zeros(36)
    quiet[[7, 19]], quiet[30], blip[30] = 1, 15, 2
    stable = 50 + np.tile([0, 1, -1], 12)
    p = panel_of(spark, {("1", "SECUESTRO"): quiet, ("2", "SECUESTRO"): blip, ("3", "SECUESTRO"): stable, ("4", "CAPTURAS"): quiet})
    got = anomaly.z_alerts(p, RESPONSE).collect()
    assert [(r.cod_municipio, r.severidad) for r in got] == [("1", "ALTA")]


def test_isolation_is_repeatable_and_separates(spark):
    rng = np.random.default_rng(1)
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(0, 1, (400, 2)))] + [(999, 12.0, 12.0)]
    df = spark.createDataFrame(rows, "id int, a double, b double")
    from atalaya.operators.isolation import isolation_score
    one, two = (isolation_score(d, ["a", "b"], ["id"]).orderBy(F.desc("aislamiento")).collect() for d in (df, df.repartition(3)))
    assert one[0].id == 999 and one[0].aislado
    assert [r.aislamiento for r in one] == [r.aislamiento for r in two]
    assert 10 <= sum(r.aislado for r in one) <= 13


def test_event_matching(spark):
    an = spark.createDataFrame([("11001", "A", date(2024, 3, 1)), ("05001", "A", date(2024, 6, 1))],
                               "cod_municipio string, categoria string, periodo date")
    ev = spark.createDataFrame([("11001", "2024-04", "B"), ("76001", "2024-04", None)], "cod_municipio string, periodo string, categoria string")
    assert anomaly.event_recall(an, ev).first().recall == 0.5
    assert anomaly.event_recall(an, ev, by_category=True).first().recall == 0.0
    far = spark.createDataFrame([("11001", "2024-06", None)], "cod_municipio string, periodo string, categoria string")
    assert anomaly.event_recall(an, far).first().n_detectados == 0
    twice = ev.unionByName(ev)
    assert anomaly.event_recall(an, twice).first().n_eventos == 4


def test_corroboration(spark):
    an = spark.createDataFrame([("1", "A", date(2024, 1, 1)), ("1", "B", date(2024, 1, 1)), ("2", "A", date(2024, 1, 1))],
                               "cod_municipio string, categoria string, periodo date")
    r = anomaly.corroboration(an).first()
    assert (r.n_anomalias, r.n_corroboradas, r.n_clusters_multidelito) == (3, 2, 1)
    assert anomaly.corroboration(an.limit(0)).first().fraccion_corroborada == 0.0


@pytest.mark.parametrize("values", [
    np.random.default_rng(3).lognormal(0, 3, 5000), np.r_[np.zeros(4000), np.arange(1000)], np.full(3000, 7.0),
    np.random.default_rng(4).integers(0, 5, 4000)])
def test_exact_quantiles_beyond_one_task(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values], "v double").repartition(4)
    probs = [0.0, 0.1, 1 / 3, 0.5, 0.8, 0.97, 1.0]
    got = quantiles.exact_quantiles(df, F.col("v"), probs, ordered_values=50)
    assert got == pytest.approx(np.quantile(values.astype(float), probs).tolist(), rel=1e-12)


def test_quantiles_without_rows(spark):
    assert quantiles.exact_quantiles(spark.range(0).select(F.lit(1.0).alias("v")), F.col("v"), [0.5]) == [None]


def test_global_rank(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"))
    got = serve.global_rank(df.repartition(5), [F.desc("v")]).collect()
    assert all(r.puesto == 1000 - r.v for r in got)


def bt_rows(spark, rows):
    return spark.createDataFrame(rows, "paso int, y double, yhat double, persistencia double, estacional double, escala double, volumen double")


def test_mase(spark):
    assert M.metrics(bt_rows(spark, [(1, 5.0, 5.0, 5.0, 5.0, 2.0, 1.0)])).first().mase == 0.0
    assert M.metrics(bt_rows(spark, [(1, 5.0, 6.0, 5.0, 5.0, 2.0, 1.0)])).first().mase == 0.5
    assert M.metrics(bt_rows(spark, [(1, 5.0, 6.0, 5.0, 5.0, 0.0, 1.0), (1, 5.0, 6.0, 5.0, 5.0, None, 1.0)])).first().mase is None
    assert M.metrics(bt_rows(spark, [(1, 0.0, 0.0, 0.0, 0.0, 1.0, 1.0)])).first().smape == 0.0


def test_baseline_backtest_against_loops(spark):
    rng = np.random.default_rng(5)
    series = {(str(i), "A"): rng.integers(0, 9, 30) for i in range(5)}  # 60 training rows at the first origin
    got = BT.baseline_backtest(panel_of(spark, series), 4, 3).collect()
    calendar = months(30)
    assert {r.origen for r in got} == {calendar[i] for i in (24, 25, 26)} and len(got) == 3 * 4 * 5
    for r in got:
        y, o, t = series[(r.cod_municipio, "A")], calendar.index(r.origen), calendar.index(r.periodo)
        assert (r.paso, r.y, r.persistencia, r.estacional) == (t - o + 1, y[t], y[o - 1], y[t - 12])
        assert r.escala == pytest.approx(np.abs(np.diff(y[:o])).mean()) and r.volumen == pytest.approx(y[:o].mean())


def test_short_panel_has_no_origin(spark):
    p = panel_of(spark, {("1", "A"): range(10)})
    assert BT.find_origins(p, 6, 3).positions == []


def test_state_inputs_match_window_features(spark, eight):
    """The recursion's first step must see what the training features of that month would be."""
    prepared = FC.prepare_panel(eight)
    cut = date(2022, 6, 1)
    state = FC.series_state(prepared, cut)
    inputs = FC._state_features(F.col("hist"), F.col("meses"), F.lit(cut), prepared.first_year)
    names = list(inputs)
    got = {r.cod_municipio: r for r in state.select("cod_municipio", *[c.cast("double").alias(n) for n, c in inputs.items()]).collect()}
    for r in prepared.rows.where(F.col("periodo") == F.lit(cut)).collect():
        for n in names:
            assert getattr(got[r.cod_municipio], n) == pytest.approx(float(r[n]), rel=1e-6, abs=1e-5), n


@pytest.fixture(scope="module")
def fitted(eight):
    return FC.train(eight, 4, 3, make_estimator=linear)


def test_training_and_band(fitted):
    assert fitted.mode == "rate"
    row = M.conformal(fitted.backtest).first()
    assert 70 <= row.cobertura_pct <= 90
    m = M.metrics(fitted.backtest).first()
    assert m.n == 8 * 4 * 3 and m.mae < 12


def test_forecast_table_and_levers(fitted):
    fc = FC.forecast(fitted, 6)
    rows = fc.collect()
    assert len(rows) == 48 and {r.periodo for r in rows} == set(months(6, (2023, 1)))
    assert all(0 <= r.limite_inferior <= r.prediccion <= r.limite_superior for r in rows)
    out = scenario_projection(fc, [Scenario("base"), Scenario("menos", -30.0, 3)]).collect()
    assert all(r.prediccion == r.base and r.evitados_acumulado == 0 for r in out if r.escenario == "base")
    first = [r for r in out if r.escenario == "menos" and r.paso == 1][0]
    assert first.prediccion == pytest.approx(first.base * 0.9, abs=0.011)


def test_last_row_variant_differs(fitted):
    a = FC.forecast(fitted, 1).orderBy("cod_municipio").collect()
    b = FC.forecast(fitted, 1, "last").orderBy("cod_municipio").collect()
    assert [r.periodo for r in a] == [r.periodo for r in b] and a != b


def test_population_shock_moves_one_territory(fitted):
    base = {r.cod_municipio: r.prediccion for r in FC.forecast(fitted, 1).collect()}
    moved = {r.cod_municipio: r.prediccion for r in FC.shocked_forecast(fitted, "10003", 50.0, 1).collect()}
    assert {k for k in base if base[k] != moved[k]} <= {"10003"}


def test_importance_ranks_inputs(fitted):
    rows = FC.permutation_importance(fitted, sample=150, repeats=2).collect()
    assert len(rows) == len(fitted.features)
    assert [r.importancia for r in rows] == sorted((r.importancia for r in rows), reverse=True)


@pytest.mark.parametrize("step,ramp,want", [(1, 0, 1), (1, 3, 1 / 3), (2, 3, 2 / 3), (3, 3, 1), (6, 3, 1)])
def test_ramp(spark, step, ramp, want):
    from atalaya.plans.scenario import ramp_weight
    assert spark.range(1).select(ramp_weight(F.lit(step), F.lit(ramp)).alias("w")).first().w == pytest.approx(want)


def test_freshness(spark):
    p = panel_of(spark, {("1", "A"): [1] * 24, ("1", "B"): [1] * 16})
    now = lambda d: F.lit(d)
    r = MON.freshness(p, now(date(2021, 1, 15))).first()
    assert (r.lag_meses, r.estado, r.fuentes_estancadas) == (1, "amarillo", "B:2020-04:8")
    assert MON.freshness(p.where("categoria = 'A'"), now(date(2021, 1, 15))).first().estado == "verde"
    assert MON.freshness(p, now(date(2021, 12, 15))).first().estado == "rojo"


def test_psi(spark):
    rng = np.random.default_rng(0)
    a, b = rng.poisson(20, 5000), rng.poisson(60, 5000)

    def psi(x, y):
        rows = [(True, int(v)) for v in x] + [(False, int(v)) for v in y]
        df = spark.createDataFrame(rows, "ref boolean, v int")
        return MON.psi(df, F.col("ref"), F.col("v")).first().psi

    assert psi(a, a) == 0.0 and psi(a, b) >= 0.25


def test_drift_volume(spark):
    p = panel_of(spark, {("1", "A"): [10] * 24 + [30] * 6})
    assert MON.data_drift(p, RESPONSE).first().cambio_volumen_pct > 100
    assert MON.data_drift(panel_of(spark, {("1", "A"): [1] * 5}), RESPONSE).first().psi == 0.0


def test_worst_light(spark):
    def s(v):
        return spark.range(1).select(F.lit(v).alias("estado"))

    rows = {r.senal: r.estado for r in MON.health_report({"a": s("verde"), "b": s("amarillo")}).collect()}
    assert rows["global"] == "amarillo"


def test_shuffled_places_are_a_permutation(spark):
    """For every size, each permutation its own, and the same however rows are dealt."""
    for n in (1, 2, 3, 7, 64, 1001):
        rows = spark.range(n, numPartitions=3).select("id", FC.shuffled_place(F.col("id"), n, F.lit(1), F.lit(42)).alias("a"),
                                                      FC.shuffled_place(F.col("id"), n, F.lit(2), F.lit(42)).alias("b"))
        got = rows.orderBy("id").collect()
        assert sorted(r.a for r in got) == sorted(r.b for r in got) == list(range(n))
        assert got == rows.repartition(5).orderBy("id").collect()
    assert sum(r.a == r.b for r in got) < 20 and sum(r.a == r.id for r in got) < 20
    near = sum(abs(x.a - y.a) == 1 for x, y in zip(got, got[1:]))
    assert near < 30  # neighbours part
