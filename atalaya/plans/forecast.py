"""One global regressor for all series, recursive multi-step forecasts and their evaluation."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import date

from pyspark.ml import PipelineModel
from pyspark.ml.base import Estimator, Model
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from atalaya.constants import BAND_LEVEL, BLEND, HIST_WINDOW, LAGS, ROLL_WINDOWS, SERIES_KEY
from atalaya.functions import period_str, to_count, to_rate
from atalaya.operators.features import active_series, calendar_columns, feature_names, make_features
from atalaya.operators.serve import global_rank
from atalaya.plans import metrics as m
from atalaya.plans.backtest import Origins, baseline_backtest, find_origins
from atalaya.plans.linear import LinearModel, Moments, Ridge, moments
from atalaya.session import cut_lineage, path_exists

# What makes a model: an estimator of Spark ML, or a ridge regression solved from sums by month.
Factory = Callable[[], Estimator] | Ridge

# Rows of a prepared panel in a task.
ROWS_A_TASK = 50_000

# Rounds of the shuffle of row numbers.
SHUFFLE_ROUNDS = 16


def default_estimator(iterations: int = 400, depth: int = 8, rate: float = 0.05,
                      seed: int = 42) -> GBTRegressor:
    """Boosted trees over assembled features; squared loss is stable under recursion."""
    return GBTRegressor(featuresCol="features", labelCol="objetivo", predictionCol="pred",
                        maxIter=iterations, maxDepth=depth, stepSize=rate, seed=seed)


def modeling_target(panel: DataFrame) -> tuple[DataFrame, str]:
    """Add `objetivo`: the rate per 100 000 when any population is known, else the count.

    A series without population keeps its counts (as if it had 100 000 inhabitants).
    """
    if "poblacion" not in panel.columns:
        return panel.withColumn("objetivo", F.col("cantidad").cast("double")), "count"
    known = panel.agg(F.max(F.col("poblacion").cast("double"))).first()[0]
    if not known or known <= 0:
        return panel.withColumn("objetivo", F.col("cantidad").cast("double")), "count"
    rate = to_rate(F.col("cantidad"), F.coalesce(F.col("poblacion"), F.lit(1e5)))
    return panel.withColumn("objetivo", rate), "rate"


@dataclass
class Forecaster:
    """A fitted model with what recursion and the band need."""

    model: Model | LinearModel
    mode: str
    features: list[str]
    first_year: int
    dispersion: float = 0.0
    band_scale: float = 1.2816  # normal quantile until a backtest calibrates it
    backtest: DataFrame | None = field(default=None, repr=False)
    prepared: "Prepared | None" = field(default=None, repr=False)


@dataclass
class Prepared:
    """Active series in modelling space with their features, cut from their lineage."""

    rows: DataFrame
    mode: str
    features: list[str]
    first_year: int
    tasks: int | None = None  # the partitions of `rows`, where they were dealt by their number
    _sums: Moments | None = field(default=None, repr=False)

    def trainable(self) -> DataFrame:
        return self.rows.where(F.col(f"lag_{max(LAGS)}").isNotNull())

    def sums(self) -> Moments:
        """The sums by month of all complete rows, added up once."""
        if self._sums is None:
            self._sums = moments(self.trainable(), self.features)
        return self._sums


def prepare_panel(panel: DataFrame, min_nonzero: int = 12) -> Prepared:
    has_population = "poblacion" in panel.columns
    needed = [*SERIES_KEY, "periodo", "cantidad", *(["poblacion"] if has_population else [])]
    # Stored once: the target mode, the trend origin and the features all read it.
    panel = cut_lineage(active_series(panel.select(*needed), min_nonzero))
    # Fits and recursions run hundreds of jobs over these rows, so they take as many tasks as the rows need,
    # not as many as the events were shuffled to.
    tasks = max(1, -(-panel.count() // ROWS_A_TASK))
    panel = panel.repartition(tasks, *SERIES_KEY)
    target, mode = modeling_target(panel)
    names = feature_names(has_population, mode == "rate")
    rows = make_features(target, y="objetivo")
    keep = [*SERIES_KEY, "periodo", "cantidad", "objetivo"]
    if has_population:
        keep.append("poblacion")
    rows = cut_lineage(rows.select(*keep, *[c for c in names if c not in keep]))
    first_year = rows.agg(F.min(F.year("periodo"))).first()[0]
    return Prepared(rows, mode, names, first_year, tasks)


def _assembled(rows: DataFrame, names: list[str]) -> DataFrame:
    clean = rows.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in names})
    return VectorAssembler(inputCols=names, outputCol="features").transform(clean)


def fit(prepared: Prepared, make_estimator: Factory, before: date | None = None) -> Model | LinearModel:
    """Fit on complete feature rows, optionally only those before an origin."""
    if isinstance(make_estimator, Ridge):
        return prepared.sums().model(make_estimator, before)
    rows = prepared.trainable()
    if before is not None:
        rows = rows.where(F.col("periodo") < F.lit(before))
    training = _assembled(rows, prepared.features).select("features", "objetivo")
    return make_estimator().fit(training)


def series_state(prepared: Prepared, before: date | None = None) -> DataFrame:
    """One row per series: its last values in order, how many it has, and its last month."""
    rows = prepared.rows
    if before is not None:
        rows = rows.where(F.col("periodo") < F.lit(before))
    population = F.max_by("poblacion", "periodo") if "poblacion" in rows.columns else F.lit(None).cast("double")
    state = rows.groupBy(*SERIES_KEY).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("periodo", "objetivo"))),
                    lambda p: p.getField("objetivo")).alias("_all"),
        F.count(F.lit(1)).cast("double").alias("meses"), F.max("periodo").alias("ultimo"),
        F.max_by("cantidad", "periodo").cast("double").alias("persistencia"),
        population.cast("double").alias("poblacion"),
    ).withColumn("hist", _tail(F.col("_all"))).drop("_all")
    return state.coalesce(prepared.tasks) if prepared.tasks else state


def _tail(values: Column, keep: int = HIST_WINDOW + 1) -> Column:
    return F.slice(values, F.greatest(F.size(values) - (keep - 1), F.lit(1)), keep)


def _mean(values: Column, n: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / n


def _state_features(past: Column, months: Column, month: Column, first_year: int) -> dict[str, Column]:
    """The same inputs as `make_features`, from the trailing values of a series."""
    size = F.size(past)
    out = {f"lag_{n}": F.when(size >= n, F.try_element_at(past, F.lit(-n))) for n in LAGS}
    for w in ROLL_WINDOWS:
        last = F.slice(past, F.greatest(size - (w - 1), F.lit(1)), w)
        mean = _mean(last, F.lit(float(w)))
        square = F.aggregate(last, F.lit(0.0), lambda a, x: a + x * x)
        variance = F.greatest((square - w * mean * mean) / (w - 1), F.lit(0.0))
        out[f"roll_mean_{w}"] = F.when(size >= w, mean)
        out[f"roll_std_{w}"] = F.when(size >= w, F.sqrt(variance))
    recent = _tail(past, HIST_WINDOW)
    out["media_hist"] = F.when(size > 0, _mean(recent, F.size(recent)))
    out["meses_activos"] = months
    out.update(calendar_columns(month, F.lit(first_year)))
    return out


def _step_inputs(prepared: Prepared, hist: Column, months: Column, last: Column, target: Column,
                 population: Column, feature_row: str) -> dict[str, Column]:
    """Inputs of the next month, or with `feature_row='last'` those of the newest known month."""
    if feature_row == "last":
        past = F.slice(hist, 1, F.greatest(F.size(hist) - 1, F.lit(0)))
        inputs = _state_features(past, months - 1, last, prepared.first_year)
    else:
        inputs = _state_features(hist, months, target, prepared.first_year)
    if "log_poblacion" in prepared.features:
        inputs["log_poblacion"] = F.log1p(population)
    if "tasa_hist" in prepared.features:
        inputs["tasa_hist"] = inputs["media_hist"] / F.when(population > 0, population) * 1e5
    return inputs


def _as_count(prepared: Prepared, value: Column) -> Column:
    if prepared.mode == "rate":
        return to_count(value, F.coalesce(F.col("poblacion"), F.lit(1e5)))
    return value


def recurse(prepared: Prepared, model: Model | LinearModel, state: DataFrame, horizon: int,
            dates: list[date] | None = None, feature_row: str = "next") -> DataFrame:
    """Forecast every series `horizon` steps ahead, feeding each prediction back.

    One row per series carries its trailing values, so a step is a projection and a model call
    with no shuffle. The lineage is cut after each step, which also bounds the plan; a linear model
    needs neither, as `fold_linear` takes all steps at once.
    """
    if isinstance(model, LinearModel):
        months = _months_ahead(horizon, dates)
        return fold_linear(prepared, state.withColumn("fechas", months), [model], feature_row).drop("_modelo")
    state = state.withColumns({
        "preds": F.array().cast("array<double>"), "fechas": F.array().cast("array<date>")})
    for step in range(1, horizon + 1):
        target = F.lit(dates[step - 1]) if dates else F.add_months("ultimo", 1)
        inputs = _step_inputs(prepared, F.col("hist"), F.col("meses"), F.col("ultimo"), target, F.col("poblacion"), feature_row)
        rows = _assembled(state.withColumn("_target", target).withColumns(inputs), prepared.features)
        scored = model.transform(rows).withColumn("_yhat", F.greatest(F.col("pred"), F.lit(0.0)))
        state = cut_lineage(scored.select(
            *SERIES_KEY, "persistencia", "poblacion",
            (F.col("meses") + 1).alias("meses"), F.col("_target").alias("ultimo"),
            _tail(F.concat("hist", F.array("_yhat"))).alias("hist"),
            F.concat("preds", F.array(_as_count(prepared, F.col("_yhat")))).alias("preds"),
            F.concat("fechas", F.array("_target")).alias("fechas")))
    return _by_step(state.select(*SERIES_KEY, "persistencia", F.arrays_zip("preds", "fechas").alias("_p")))


def _by_step(rows: DataFrame) -> DataFrame:
    """One row per step of arrays of predictions and their months."""
    rest = [c for c in rows.columns if c not in (*SERIES_KEY, "_p", "persistencia")]
    return rows.select(*SERIES_KEY, *rest, "persistencia", F.posexplode("_p").alias("_i", "_p")).select(
        *SERIES_KEY, *rest, (F.col("_i") + 1).alias("paso"), F.col("_p.fechas").alias("periodo"),
        F.col("_p.preds").alias("yhat_modelo"), "persistencia")


def _months_ahead(horizon: int, dates: list[date] | None = None) -> Column:
    if dates:
        return F.array(*[F.lit(d) for d in dates])
    return F.transform(F.sequence(F.lit(1), F.lit(horizon)), lambda k: F.add_months("ultimo", k))


def fold_linear(prepared: Prepared, state: DataFrame, models: list[LinearModel], feature_row: str = "next") -> DataFrame:
    """All steps of every series under the model numbered `_modelo` (the first where there is no such column).

    A step depends on the one before only through the trailing values of its own series, so the
    recursion is one fold over the months `fechas` in one projection: no checkpoint and no shuffle.
    Only inputs that some model weighs are computed.
    """
    if "_modelo" not in state.columns:
        state = state.withColumn("_modelo", F.lit(0))
    used = [i for i in range(len(prepared.features)) if any(m.weights[i] for m in models)]
    weights = F.array(*[F.array(*[F.lit(m.weights[i]) for i in used]).cast("array<double>") for m in models])
    constants = F.array(*[F.lit(m.constant) for m in models])
    state = state.withColumns({"_w": F.get(weights, F.col("_modelo")), "_c": F.get(constants, F.col("_modelo"))})

    def step(known: Column, target: Column) -> Column:
        inputs = _step_inputs(prepared, known["hist"], known["meses"], known["ultimo"], target, F.col("poblacion"), feature_row)
        value = F.col("_c")
        for place, i in enumerate(used):
            value = value + F.get("_w", F.lit(place)) * F.coalesce(inputs[prepared.features[i]].cast("double"), F.lit(0.0))
        # One value for both uses, so the inputs are computed once a step.
        return F.element_at(F.transform(F.array(F.greatest(value, F.lit(0.0))), lambda y: F.struct(
            _tail(F.concat(known["hist"], F.array(y))).alias("hist"), (known["meses"] + 1).alias("meses"),
            target.alias("ultimo"), F.concat(known["ahead"], F.array(y)).alias("ahead"))), 1)

    start = F.struct(F.col("hist"), F.col("meses").cast("double").alias("meses"), F.col("ultimo"),
                     F.array().cast("array<double>").alias("ahead"))
    ahead = F.aggregate("fechas", start, step, lambda known: known["ahead"])
    rows = state.withColumn("_ahead", ahead).withColumn("preds", F.transform("_ahead", lambda y: _as_count(prepared, y)))
    return _by_step(rows.select(*SERIES_KEY, "_modelo", "persistencia", F.arrays_zip("preds", "fechas").alias("_p")))


def ridge_ahead(prepared: Prepared, grid: dict[str, Ridge], origins: Origins, feature_row: str = "next") -> DataFrame:
    """Forecasts of every candidate from every origin: sums in one pass, all recursions in a second one.

    Each series is gathered once, in order, and cut at each origin; both are bounded by the calendar.
    """
    rows = prepared.rows
    cuts, models, labels = [], [], []
    for position in origins.positions:
        origin = origins.periods[position]
        for name, ridge in grid.items():
            cuts.append(F.struct(F.lit(len(models)).alias("_modelo"), F.lit(origin).alias("origen"),
                                 _months_ahead(origins.horizon, origins.targets(position)).alias("fechas")))
            models.append(prepared.sums().model(ridge, origin))
            labels.append(name)
    out = ["origen", "candidato", *SERIES_KEY, "paso", "yhat_modelo"]
    if not models:
        empty = rows.limit(0).select(*SERIES_KEY, F.lit(None).cast("date").alias("origen"), F.lit("").alias("candidato"),
                                     F.lit(1).alias("paso"), F.lit(0.0).alias("yhat_modelo"))
        return empty.select(*out)
    population = F.col("poblacion") if "poblacion" in rows.columns else F.lit(None)
    point = F.struct("periodo", "objetivo", F.col("cantidad").cast("double").alias("cantidad"), population.cast("double").alias("poblacion"))
    series = rows.groupBy(*SERIES_KEY).agg(F.array_sort(F.collect_list(point)).alias("_all"))
    cut = series.select(*SERIES_KEY, "_all", F.explode(F.array(*cuts)).alias("_cut")).select(*SERIES_KEY, "_all", "_cut.*")
    known = cut.withColumn("_all", F.filter("_all", lambda p: p["periodo"] < F.col("origen"))).where(F.size("_all") > 0)
    last = F.element_at("_all", -1)
    state = known.select(
        *SERIES_KEY, "_modelo", "fechas", _tail(F.transform("_all", lambda p: p["objetivo"])).alias("hist"),
        F.size("_all").cast("double").alias("meses"), last["periodo"].alias("ultimo"),
        last["cantidad"].alias("persistencia"), last["poblacion"].alias("poblacion"))
    ahead = fold_linear(prepared, state, models, feature_row)
    per_model = {"origen": [F.lit(origins.periods[p]) for p in origins.positions for _ in grid], "candidato": [F.lit(n) for n in labels]}
    return ahead.withColumns({c: F.get(F.array(*v), F.col("_modelo")) for c, v in per_model.items()}).select(*out)


def walk_forward(panel: DataFrame, horizon: int = 6, n_splits: int = 3,
                 make_estimator: Factory = default_estimator, feature_row: str = "next",
                 blend: float = BLEND, prepared: Prepared | None = None) -> DataFrame:
    """Backtest rows with the served forecast `yhat` and the raw model output.

    Features never look ahead, so they are computed once and every origin only filters them.
    """
    prepared = prepared or prepare_panel(panel)
    origins = find_origins(prepared.rows, horizon, n_splits)
    truth = baseline_backtest(prepared.rows, origins=origins)
    parts = ridge_ahead(prepared, {"": make_estimator}, origins, feature_row).drop("candidato") if isinstance(make_estimator, Ridge) else None
    for position in origins.positions if parts is None else ():
        origin = origins.periods[position]
        model = fit(prepared, make_estimator, origin)
        ahead = recurse(prepared, model, series_state(prepared, origin), origins.horizon,
                        origins.targets(position), feature_row)
        ahead = ahead.select(F.lit(origin).alias("origen"), *SERIES_KEY, "paso", "yhat_modelo")
        parts = ahead if parts is None else parts.unionByName(ahead)
    joined = truth.join(parts, ["origen", "paso", *SERIES_KEY])
    return joined.withColumn("yhat", _served(blend))


def _served(blend: float = BLEND) -> Column:
    return blend * F.col("yhat_modelo") + (1 - blend) * F.col("persistencia")


def train(panel: DataFrame, horizon: int = 6, n_splits: int = 3, min_nonzero: int = 12,
          make_estimator: Factory = default_estimator, feature_row: str = "next") -> Forecaster:
    """Backtest, calibrate the band and refit on the whole history."""
    prepared = prepare_panel(panel, min_nonzero)
    bt = cut_lineage(walk_forward(panel, horizon, n_splits, make_estimator, feature_row,
                                  prepared=prepared))
    phi = float(m.dispersion(bt).first()[0])
    unit = m.band_half(F.col("yhat"), F.col("paso"), phi, 1.0)
    standardised = F.abs(F.col("y") - F.col("yhat")) / F.greatest(unit, F.lit(1e-9))
    scale = m.exact_quantiles(bt, standardised, [BAND_LEVEL])[0]
    model = fit(prepared, make_estimator)
    return Forecaster(model, prepared.mode, prepared.features, prepared.first_year, phi, scale, bt,
                      prepared)


def forecast(fitted: Forecaster, horizon: int = 6, feature_row: str = "next",
             prepared: Prepared | None = None) -> DataFrame:
    """Served forecast and band of every series, as a gold table."""
    prepared = prepared or fitted.prepared
    ahead = recurse(prepared, fitted.model, series_state(prepared), horizon, None, feature_row)
    yhat = BLEND * F.col("yhat_modelo") + (1 - BLEND) * F.col("persistencia")
    rows = ahead.withColumn("_y", yhat)
    half = m.band_half(F.col("_y"), F.col("paso"), fitted.dispersion, fitted.band_scale)
    return rows.select(
        *SERIES_KEY, "paso", "periodo", F.round("_y", 2).alias("prediccion"),
        F.round(F.greatest(F.lit(0.0), F.col("_y") - half), 2).alias("limite_inferior"),
        F.round(F.col("_y") + half, 2).alias("limite_superior"))


def population_shock(panel: DataFrame, code: str, pct: float) -> DataFrame:
    """Scale the population of one territory; everything else is untouched."""
    factor = F.when(F.col("cod_municipio") == code, 1.0 + pct / 100.0).otherwise(F.lit(1.0))
    return panel.withColumn("poblacion", F.col("poblacion").cast("double") * factor)


def shocked_forecast(fitted: Forecaster, code: str, pct: float, horizon: int = 6) -> DataFrame:
    """Re-forecast with one territory's population scaled, in rate mode with the same model.

    The past counts of the territory stay; only its rates and the denominator move.
    """
    base = fitted.prepared
    rows = population_shock(base.rows, code, pct)
    if base.mode == "rate":
        rows = rows.withColumn("objetivo", to_rate(F.col("cantidad"),
                                                   F.coalesce(F.col("poblacion"), F.lit(1e5))))
    return forecast(fitted, horizon, prepared=Prepared(rows, base.mode, base.features, base.first_year, base.tasks))


def shuffled_place(place: Column, n: int, *keys: Column, rounds: int = SHUFFLE_ROUNDS) -> Column:
    """Where a row number from 0 to `n` - 1 goes in the permutation named by `keys`: a bijection for every `n`.

    In each round a number x and its mirror image k - x (modulo n) change places or stay, by a hash of the
    greater of the two, so nothing is ordered and rows need not meet.
    """
    size = F.lit(max(1, n)).cast("long")

    def step(x: Column, number: Column) -> Column:
        mirror = F.pmod(F.pmod(F.xxhash64(number, *keys), size) - x, size)
        swaps = F.xxhash64(F.greatest(x, mirror), number, *keys).bitwiseAND(F.lit(1)) == 1
        return F.when(swaps, mirror).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), place.cast("long"), step)


def permutation_importance(fitted: Forecaster, sample: int | None = None, repeats: int = 5,
                           seed: int = 42) -> DataFrame:
    """Rise in absolute error when one input is shuffled, over all complete rows or a sample of them.

    All (input, repeat) pairs are scored in one pass: each row is repeated per pair and takes the
    input of the row that a permutation of all rows, one for each pair, puts in its place.
    """
    prepared = fitted.prepared
    names = prepared.features
    complete = prepared.rows.where(F.col(f"lag_{max(LAGS)}").isNotNull())
    if sample is not None:
        complete = complete.orderBy(F.xxhash64(*SERIES_KEY, "periodo", F.lit(seed)), *SERIES_KEY, "periodo").limit(sample)
    base = complete.select(
        *SERIES_KEY, "periodo", F.col("objetivo").alias("y"),
        F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in names]).alias("x"))
    base = cut_lineage(global_rank(base, [*SERIES_KEY, "periodo"], "place").select((F.col("place") - 1).alias("place"), "y", "x"))
    dealt = base.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(len(names) * repeats - 1)))).withColumns({
        "f": F.floor(F.col("g") / repeats).cast("int"),
        "to": shuffled_place(F.col("place"), base.count(), F.col("g"), F.lit(seed))}).drop("place")
    dealt = dealt.join(base.select(F.col("place").alias("to"), F.col("x").alias("taken")), "to").withColumn("other", F.get("taken", F.col("f")))
    mixed = dealt.select(
        "g", "f", "y", F.transform("x", lambda v, i: F.when(i == F.col("f"), F.col("other")).otherwise(v)).alias("x"))
    plain = base.select(F.lit(-1).alias("g"), F.lit(-1).alias("f"), "y", "x")
    scored = fitted.model.transform(
        mixed.unionByName(plain).withColumn("features", array_to_vector("x")))
    errors = scored.groupBy("g", "f").agg(F.avg(F.abs(F.col("y") - F.col("pred"))).alias("e"))
    errors = cut_lineage(errors)
    reference = errors.where("g = -1").select("e").scalar()
    label = F.array(*[F.lit(n) for n in names])
    return (
        errors.where("g >= 0").withColumn("rise", F.col("e") - reference).groupBy("f")
        .agg(F.round(F.avg("rise"), 4).alias("importancia"), F.round(F.stddev_pop("rise"), 4).alias("std"))
        .select(F.get(label, F.col("f")).alias("feature"), "importancia", "std")
        .orderBy(F.desc("importancia"), "feature"))


def champion_challenger(panel: DataFrame, champion: Factory, challenger: Factory,
                        horizon: int = 6, n_splits: int = 3, min_nonzero: int = 12) -> DataFrame:
    """Two estimators under the same backtest, with a verdict."""
    prepared = prepare_panel(panel, min_nonzero)
    a = cut_lineage(walk_forward(panel, horizon, n_splits, champion, prepared=prepared))
    b = cut_lineage(walk_forward(panel, horizon, n_splits, challenger, prepared=prepared))
    return m.compare_scores(a, b)


def hpo_temporal(panel: DataFrame, grid: dict[str, Factory], horizon: int = 6,
                 n_splits: int = 3, min_nonzero: int = 12) -> DataFrame:
    """Candidates scored by multi-step error under temporal validation, best first."""
    prepared = prepare_panel(panel, min_nonzero)
    ridges = {name: f for name, f in grid.items() if isinstance(f, Ridge)}
    out = None
    if ridges:
        # All of them from the same sums and the same recursion.
        origins = find_origins(prepared.rows, horizon, n_splits)
        bt = baseline_backtest(prepared.rows, origins=origins).join(ridge_ahead(prepared, ridges, origins), ["origen", "paso", *SERIES_KEY])
        out = bt.groupBy("candidato").agg(F.round(F.avg(F.abs(F.col("y") - _served())), 4).alias("mae_multipaso"))
    for name, factory in grid.items():
        if name in ridges:
            continue
        bt = cut_lineage(walk_forward(panel, horizon, n_splits, factory, prepared=prepared))
        row = bt.agg(F.round(F.avg(F.abs(F.col("y") - F.col("yhat"))), 4).alias("mae_multipaso"))
        row = row.select(F.lit(name).alias("candidato"), "mae_multipaso")
        out = row if out is None else out.unionByName(row)
    return out.orderBy("mae_multipaso", "candidato")


def save(fitted: Forecaster, path: str) -> None:
    """Store the model and its scalars: Spark ML persistence, or one row per weight of a linear model."""
    spark = fitted.prepared.rows.sparkSession
    linear = isinstance(fitted.model, LinearModel)
    if linear:
        terms = [*zip(fitted.model.names, fitted.model.weights, strict=True), (None, fitted.model.constant)]
        spark.createDataFrame(terms, "nombre string, peso double").write.mode("overwrite").parquet(f"{path}/linear")
    else:
        fitted.model.write().overwrite().save(f"{path}/model")
    meta = [(fitted.mode, ",".join(fitted.features), fitted.first_year, fitted.dispersion,
             fitted.band_scale, linear)]
    spark.createDataFrame(meta, "mode string, features string, first_year int, dispersion double, "
                                "band_scale double, linear boolean").write.mode("overwrite").parquet(f"{path}/meta")


def load(spark: SparkSession, path: str) -> Forecaster:
    """A forecaster as `save` stored it; its rows are prepared again from a panel when it is used."""
    row = spark.read.parquet(f"{path}/meta").first()
    names = row["features"].split(",")
    if row.asDict().get("linear"):
        terms = {r["nombre"]: r["peso"] for r in spark.read.parquet(f"{path}/linear").collect()}
        model = LinearModel(tuple(names), tuple(terms[n] for n in names), terms[None])
    else:
        model = PipelineModel.load(f"{path}/model") if _is_pipeline(spark, path) else GBTRegressionModel.load(f"{path}/model")
    return Forecaster(model, row["mode"], names, row["first_year"], row["dispersion"], row["band_scale"])


def _is_pipeline(spark: SparkSession, path: str) -> bool:
    return path_exists(spark, f"{path}/model/stages")


def forecast_text_rows(forecasts: DataFrame) -> DataFrame:
    """One row per series with its projection written out in step order."""
    piece = F.format_string("%s: %.2f (rango %.2f–%.2f)", period_str(F.col("periodo")), "prediccion",
                            "limite_inferior", "limite_superior")
    return forecasts.groupBy(*SERIES_KEY).agg(
        F.count(F.lit(1)).alias("meses"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("paso", piece.alias("t")))),
                                 lambda s: s.getField("t")), "; ").alias("proyeccion"))
