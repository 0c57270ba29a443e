"""The ridge regression from monthly sums against numpy and against step-by-step recursion."""

import random
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from atalaya.plans import forecast as FC
from atalaya.plans.linear import LinearModel, Ridge, moments


@pytest.fixture(scope="module")
def prepared(spark):
    rnd = random.Random(1)
    rows = []
    for code in ("11001", "05001", "76001", "08001"):
        for cat in ("A", "B"):
            level = rnd.randint(2, 30)
            for i in range(40):
                rows.append((code, "M", "D", cat, date(2020 + i // 12, i % 12 + 1, 1), max(0, level + rnd.randint(-3, 3) + i % 12), 1000.0 * level))
    schema = "cod_municipio string, municipio string, departamento string, categoria string, periodo date, cantidad bigint, poblacion double"
    return FC.prepare_panel(spark.createDataFrame(rows, schema), 0)


def direct(prepared, ridge, before):
    """The same fit with numpy on all rows, inputs in units of their deviation."""
    names = list(ridge.features or prepared.features)
    rows = [r for r in prepared.trainable().collect() if before is None or r.periodo < before]
    x = np.array([[float(r[n] or 0.0) for n in names] for r in rows])
    y = np.array([r.objetivo for r in rows])
    dev = x.std(axis=0)
    z = (x - x.mean(axis=0)) / np.where(dev > 1e-9, dev, np.inf)
    w = np.linalg.lstsq(z.T @ z / len(y) + ridge.strength * np.diag((dev > 1e-9).astype(float)), z.T @ (y - y.mean()) / len(y), rcond=1e-10)[0]
    return z @ w + y.mean(), rows


@pytest.mark.parametrize("ridge", [Ridge(("lag_1", "lag_12")), Ridge(("lag_1",), 0.3), Ridge(strength=0.1), Ridge()])
@pytest.mark.parametrize("before", [None, date(2022, 6, 1)])
def test_fit_equals_direct(prepared, ridge, before):
    model = FC.fit(prepared, ridge, before)
    want, rows = direct(prepared, ridge, before)
    x = np.array([[float(r[n] or 0.0) for n in model.names] for r in rows])
    assert np.allclose(x @ np.array(model.weights) + model.constant, want, atol=1e-5)


def test_transform_and_unknown_inputs(prepared):
    model = FC.fit(prepared, Ridge(("lag_1", "lag_12")))
    row = model.transform(FC._assembled(prepared.trainable(), prepared.features)).first()
    by = dict(zip(model.names, model.weights, strict=True))
    assert row.pred == pytest.approx(model.constant + by["lag_1"] * row.lag_1 + by["lag_12"] * row.lag_12)
    with pytest.raises(ValueError, match="nothing"):
        FC.fit(prepared, Ridge(("nothing",)))


def test_no_rows_and_constant_inputs(spark):
    rows = spark.createDataFrame([(date(2020, m, 1), 5.0, float(m), 2.0 * m) for m in range(1, 7)], "periodo date, k double, x double, objetivo double")
    fitted = moments(rows, ["k", "x"]).model(Ridge())
    assert fitted.weights[0] == 0.0 and fitted.weights[1] == pytest.approx(2.0) and fitted.constant == pytest.approx(0.0, abs=1e-9)
    assert moments(rows, ["k", "x"]).model(Ridge(), date(2020, 1, 1)) == LinearModel(("k", "x"), (0.0, 0.0), 0.0)
    assert moments(rows.limit(0), ["k", "x"]).model(Ridge()).constant == 0.0


class Stepwise:
    """The same model without its type, so that `recurse` takes it step by step."""

    def __init__(self, model):
        self.transform = model.transform


@pytest.mark.parametrize("feature_row", ["next", "last"])
@pytest.mark.parametrize("dates", [None, [date(2023, 5, 1), date(2023, 6, 1), date(2023, 7, 1)]])
def test_fold_equals_steps(prepared, feature_row, dates):
    model = FC.fit(prepared, Ridge(strength=0.1))
    state = FC.series_state(prepared)
    key = lambda r: (r.cod_municipio, r.categoria, r.paso, r.periodo, r.persistencia)
    got = {key(r): r.yhat_modelo for r in FC.recurse(prepared, model, state, 3, dates, feature_row).collect()}
    want = {key(r): r.yhat_modelo for r in FC.recurse(prepared, Stepwise(model), state, 3, dates, feature_row).collect()}
    assert len(got) == 8 * 3 and got == pytest.approx(want, rel=1e-9)


def test_all_origins_at_once_equal_one_by_one(prepared):
    grid = {"todo": Ridge(strength=0.1), "dos": Ridge(("lag_1", "lag_12"))}
    origins = FC.find_origins(prepared.rows, 3, 2)
    got = {(r.origen, r.candidato, r.cod_municipio, r.categoria, r.paso): r.yhat_modelo for r in FC.ridge_ahead(prepared, grid, origins).collect()}
    want = {}
    for position in origins.positions:
        origin = origins.periods[position]
        for name, ridge in grid.items():
            ahead = FC.recurse(prepared, Stepwise(FC.fit(prepared, ridge, origin)), FC.series_state(prepared, origin), 3, origins.targets(position))
            want |= {(origin, name, r.cod_municipio, r.categoria, r.paso): r.yhat_modelo for r in ahead.collect()}
    assert len(want) == 2 * 2 * 8 * 3 and got == pytest.approx(want, rel=1e-9)
    assert FC.ridge_ahead(prepared, grid, FC.Origins([], 3, [])).count() == 0


def test_sums_are_added_up_once(prepared, monkeypatch):
    fresh = FC.Prepared(prepared.rows, prepared.mode, prepared.features, prepared.first_year)
    calls = []
    monkeypatch.setattr(FC, "moments", lambda *a: calls.append(a) or moments(*a))
    for origin in (None, date(2022, 1, 1), date(2023, 1, 1)):
        FC.fit(fresh, Ridge(strength=0.5), origin)
    assert len(calls) == 1


def test_saved_model_comes_back(prepared, tmp_path):
    spark = prepared.rows.sparkSession
    fitted = FC.Forecaster(FC.fit(prepared, Ridge()), prepared.mode, prepared.features, prepared.first_year, 1.5, 1.1, None, prepared)
    FC.save(fitted, str(tmp_path / "m"))
    again = FC.load(spark, str(tmp_path / "m"))
    assert again.model == fitted.model and (again.mode, again.dispersion) == (fitted.mode, 1.5)


def test_importance_of_a_linear_model(prepared):
    fitted = FC.Forecaster(FC.fit(prepared, Ridge(("lag_1", "lag_12"))), prepared.mode, prepared.features, prepared.first_year, prepared=prepared)
    got = {r.feature: r.importancia for r in FC.permutation_importance(fitted, repeats=1).collect()}
    assert got["lag_12"] > 0 and got["mes"] == 0.0
