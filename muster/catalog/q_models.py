"""Regression models."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from muster.catalog.domain import Domain
from muster.catalog.registry import query, sig
from muster.catalog.views_sql import money as money_sql
from muster.catalog.views_sql import sig as sig_sql
from muster.operators import projection, regression, scenarios, scoring, series
from muster.operators.regression import FOREST, GBT_EXPORT, GBT_MONTHLY, GBT_YEARLY, LINEAR, ModelSpec
from muster.plans import training
from muster.plans.training import Training
from muster.schemas import TARGET, YEARLY_FEATURES
from muster.session import workspace
from muster.sources import models

# One-feature lines, whose fit SQL can repeat.
LINE_YEARLY = ModelSpec("yearly", LINEAR.estimator, ["nbemp"], LINEAR.params)
LINE_MONTHLY = ModelSpec("monthly", LINEAR.estimator, ["nbemp"], LINEAR.params)


def _train(d: Domain, name: str) -> Training:
    d = d.reduced()
    if name == "yearly":
        return training.train_yearly(d.yearly_training(), GBT_YEARLY)
    if name == "monthly":
        return training.train_holdout(d.monthly_training(), GBT_MONTHLY)
    if name == "line_yearly":
        return training.train_yearly(d.merged_yearly(), LINE_YEARLY)
    if name == "line_monthly":
        return training.train_holdout(d.merged_monthly(), LINE_MONTHLY)
    if name == "export":
        return training.train_holdout(d.export_training(), GBT_EXPORT)
    spec = {"forest": FOREST, "linear": LINEAR}[name]
    return training.train_holdout(d.merged_inner(), spec, chronological=False)


def _saved(d: Domain, name: str) -> str:
    """Folder of a model trained and stored for this query alone."""
    path = workspace(d.spark, f"model-{name}")
    training.train_and_save(_train(d, name), path)
    return path


def _loaded(d: Domain, name: str) -> projection.TrainedModel:
    return models.load_model(d.spark, _saved(d, name), "")


_LINE_SQL = f"""
    select 'nbemp' as feature, {sig_sql('regr_slope(mass_salary, nbemp) * stddev_pop(nbemp)')} as coefficient from v_merged
    union all select 'intercept', {sig_sql('avg(mass_salary)')} from v_merged"""


@query("linear_regression", _LINE_SQL)
def linear_regression(d: Domain) -> DataFrame:
    frame = d.merged_monthly().select("entity", "nbemp", "mass_salary")
    fitted = regression.coefficients(d.spark, regression.fit(frame, LINEAR))
    return fitted.select("feature", sig(F.col("coefficient")).alias("coefficient"))


@query("fit_line", f"""
    select 'yearly' as line, {sig_sql('slope', 7)} as nbemp, {sig_sql('intercept', 7)} as intercept from v_yearly_fit
    union all select 'monthly', {sig_sql('regr_slope(mass_salary, nbemp)', 7)}, {sig_sql('regr_intercept(mass_salary, nbemp)', 7)}
    from v_merged""")
def fit_line(d: Domain) -> DataFrame:
    d = d.reduced()
    lines = {"yearly": d.merged_yearly(), "monthly": d.merged_monthly()}
    fits = [regression.fit_line(df, "nbemp").withColumn("line", F.lit(k)) for k, df in lines.items()]
    both = fits[0].unionByName(fits[1])
    return both.select("line", *[sig(F.col(c), 7).alias(c) for c in ("nbemp", "intercept")])


_INNER_FEATURES = ["nb_departures", "Recruitments", "nbemp", "Year", "Month"]


@query("linear_regression_all_features", f"""
    select unnest({[*_INNER_FEATURES, 'intercept']}) as feature, true as orthogonal, true as weighed""")
def linear_all(d: Domain) -> DataFrame:
    """Every column but the target is a feature, and what the fit leaves over has nothing to do with any of them."""
    d = d.reduced()
    frame = series.split_random(d.merged_inner(), ["entity", "Year", "Month"]).filter("split = 'train'")
    model = regression.fit(frame, LINEAR)
    left = model.predict(frame).withColumn("left", F.col(TARGET) - F.col("prediction"))
    pairs = [
        F.abs(F.corr("left", F.col(c).cast("double"))).alias(c) for c in model.features
    ] + [(F.abs(F.avg("left")) / F.stddev_pop("left")).alias("intercept")]
    cells = [x for c in [*model.features, "intercept"] for x in (F.lit(c), F.col(c))]
    related = left.agg(*pairs).select(F.stack(F.lit(len(pairs)), *cells).alias("feature", "related"))
    weights = regression.coefficients(d.spark, model)
    return related.join(weights, "feature").select(
        "feature", (F.col("related") < 1e-6).alias("orthogonal"), (F.abs("coefficient") > 0).alias("weighed"))


def _learned(source: str, target: str, inside: bool, keys: str = '"Year", "Month"') -> str:
    """The rows a model is tested on; what it learned must beat the mean of their pay."""
    return f"""select entity, {keys}, {target} as actual, true as beats_mean{', true as in_range' if inside else ''} from {source}"""


def _test_rows(t: Training, inside: DataFrame | None = None) -> DataFrame:
    """Keys and actual pay of the tested rows, and whether the predictions are worth something."""
    error, spread = F.avg(F.pow(F.col("actual") - F.col("predicted"), 2)), F.var_pop("actual")
    beats = t.scored.agg(error < spread).scalar().alias("beats_mean")
    keys, actual = [c for c in ("entity", "Year", "Month") if c in t.scored.columns], F.round("actual", 2).alias("actual")
    if inside is None:
        return t.scored.select(*keys, actual, beats)
    ends = inside.agg(F.struct(F.min(TARGET).alias("lo"), F.max(TARGET).alias("hi"))).scalar()
    rows = t.scored.withColumn("_e", ends)
    return rows.select(*keys, actual, beats, F.expr("predicted BETWEEN _e.lo AND _e.hi").alias("in_range"))


_RANDOM_TEST = """(select * from v_merged_inner qualify row_number() over (partition by entity
    order by md5(concat_ws('|', '42', entity, "Year", "Month")), entity, "Year", "Month")
    <= ceil(count(*) over (partition by entity) * 0.2::double))"""


@query("random_forest", _learned(_RANDOM_TEST, "mass_salary", True))
def random_forest(d: Domain) -> DataFrame:
    """Means of training pay: no prediction leaves its range."""
    d = d.reduced()
    return _test_rows(_train(d, "forest"), d.merged_inner())


@query("gbt_monthly", _learned("v_split where is_test", "mass_salary", False))
def gbt_monthly(d: Domain) -> DataFrame:
    return _test_rows(_train(d, "monthly"))


@query("gbt_export", _learned("v_split where is_test", "mass_salary", False))
def gbt_export(d: Domain) -> DataFrame:
    return _test_rows(_train(d, "export"))


@query("gbt_yearly", """select entity, "Year", round(mass_salary, 2) as actual, true as beats_mean, true as beats_mean_unseen from v_yearly""")
def gbt_yearly(d: Domain) -> DataFrame:
    """The model is scored on the rows it learned from; one that has not seen a fifth of them must also beat their mean, which
    learning rows by heart does not do."""
    d = d.reduced()
    halves = series.split_random(d.yearly_training(), ["entity", "Year"])
    unseen = halves.filter("split = 'test'")
    scored = training.evaluate(unseen, regression.fit(halves.filter("split = 'train'"), GBT_YEARLY))
    fits = scored.agg(F.avg(F.pow(F.col("actual") - F.col("predicted"), 2)) < F.var_pop("actual")).scalar()
    return _test_rows(_train(d, "yearly")).withColumn("beats_mean_unseen", fits)


def _error_stats(source: str) -> str:
    """One row of metrics of actual / predicted rows."""
    return f"""(select avg((actual - predicted) * (actual - predicted)) as mse, avg(abs(actual - predicted)) as mae,
      1 - avg((actual - predicted) * (actual - predicted)) / var_pop(actual) as r2,
      avg(abs((actual - predicted) / actual)) * 100 as mape from {source})"""


@query("train_report", f"""
    select entity, "Year"::varchar as line, actual, {sig_sql('predicted', 9)} as predicted,
      round(abs(predicted - actual) / actual * 100, 6) as error_percent from v_yearly_fitted
    union all
    select null, 'AVERAGE', null, null, round(avg(abs(predicted - actual) / actual * 100), 6) from v_yearly_fitted""")
def train_report(d: Domain) -> DataFrame:
    report = training.train_report(training.evaluate(d.merged_yearly(), _loaded(d, "line_yearly")))
    return report.select(
        "entity", "line", "actual", sig(F.col("predicted"), 9).alias("predicted"),
        F.round("error_percent", 6).alias("error_percent"),
    )


@query("train_model", f"""
    select round(m.r2, 4) as monthly_r2, {sig_sql('m.mse', 9)} as monthly_mse, {sig_sql('round(sqrt(m.mse), 2)', 9)} as monthly_rmse,
      {sig_sql('round(m.mae, 2)', 9)} as monthly_mae, round(y.r2, 4) as yearly_r2, {sig_sql('y.mse', 9)} as yearly_mse
    from {_error_stats('v_test_fitted')} m, {_error_stats("""(select entity, "Year", sum(actual) as actual,
      sum(predicted) as predicted from v_test_fitted group by 1, 2)""")} y""")
def train_model(d: Domain) -> DataFrame:
    trained = training.train_holdout(d.merged_monthly(), LINE_MONTHLY)
    flat = models.flatten_metrics(training.train_and_save(trained, workspace(d.spark, "trained")))
    return flat.select(*[F.col(c) if c.endswith("r2") else sig(F.col(c), 9).alias(c) for c in flat.columns])


@query("model_save", f"""
    select 'yearly' as kind, 'nbemp' as features, round(r2, 6) as r2, {sig_sql('mse', 9)} as mse,
      {sig_sql('sqrt(mse)', 9)} as rmse, {sig_sql('mae', 9)} as mae, round(mape, 6) as mape
    from {_error_stats('v_yearly_fitted')}""")
def model_save(d: Domain) -> DataFrame:
    stored = d.spark.read.parquet(f"{_saved(d, 'line_yearly')}/description")
    return stored.select(
        "kind", F.concat_ws(",", "features").alias("features"), F.round("metrics.r2", 6).alias("r2"),
        *[sig(F.col(f"metrics.{c}"), 9).alias(c) for c in ("mse", "rmse", "mae")],
        F.round("metrics.mape", 6).alias("mape"),
    )


@query("model_load", f"""
    select entity, "Year", 'yearly' as kind, {sig_sql('greatest(0.0::double, predicted)', 9)} as prediction from v_yearly_fitted""")
def model_load(d: Domain) -> DataFrame:
    model = models.load_model(d.spark, _saved(d, "line_yearly"), _saved(d, "line_monthly"))
    scored = projection.score(d.merged_yearly(), model)
    return scored.select("entity", "Year", F.lit(model.kind).alias("kind"), sig(F.col("prediction"), 9).alias("prediction"))


@query("score", f"""
    select scenario_id, yr as base_year, {sig_sql('greatest(0.0::double, w.n * f.slope + f.intercept)', 9)} as prediction
    from v_yearly_walk w, v_yearly_fit f where yr <= greatest(start_year, least(end_year, 2020))""")
def score(d: Domain) -> DataFrame:
    scored = projection.score(projection.yearly_model_rows(scenarios.spread(d.scenarios())), _loaded(d, "line_yearly"))
    return scored.select("scenario_id", "base_year", sig(F.col("prediction"), 9).alias("prediction"))


_YEARLY_FEATURES_SQL = str(sorted(YEARLY_FEATURES))


@query("rank_importance", f"select unnest({_YEARLY_FEATURES_SQL}) as feature, true as in_order, 1.0::double as total")
def rank_importance(d: Domain) -> DataFrame:
    """All features of the model, the more important first, adding up to one."""
    ranked = regression.rank_importance(d.spark, _loaded(d, "yearly")).withColumn("at", F.monotonically_increasing_id())
    before = Window.orderBy("at")
    return ranked.select(
        "feature", F.coalesce(F.col("importance") <= F.lag("importance").over(before), F.lit(True)).alias("in_order"),
        F.round(F.sum("importance").over(Window.partitionBy()), 9).alias("total"),
    )


@query("project_yearly_trained", f"""
    select scenario_id, "Year", case when start_year > 2020 then {sig_sql('salary', 9)} end as "Total_Salary",
      case when "Year" > greatest(start_year, 2020) then
        {sig_sql('greatest(0.0::double, 1.05::double + case when n - net > 0 then net / (n - net) else 0.0::double end * 0.7::double)', 12)}
      end as growth, "End_Employees" from v_projected""")
def project_yearly_trained(d: Domain) -> DataFrame:
    """A trained model's figures up to 2020 are its own; what follows them, and all that starts later, is arithmetic."""
    out = projection.project_yearly(scenarios.spread(d.scenarios()), _loaded(d, "yearly"))
    before = F.lag("salary").over(Window.partitionBy("scenario_id").orderBy("Year"))
    growth = F.when(F.col("Year") > F.greatest("start_year", F.lit(2020)), F.try_divide(F.col("salary"), before))
    return out.select(
        "scenario_id", "Year", F.when(F.col("start_year") > 2020, sig(F.col("salary"), 9)).alias("Total_Salary"),
        sig(growth, 12).alias("growth"), "End_Employees",
    )


@query("choose_engine", f"""
    select 'monthly' as engine, scenario_id, start_year + t // 12 as "Year",
      round({money_sql('sum(greatest(0.0::double, greatest(1.0::double, level) * slope + intercept))')}, 0) as "Total_Salary",
      cast(round_even(max(case when t % 12 = 11 then lft end), 0) as bigint) as "End_Employees"
    from v_monthly_walk, v_train_fit group by all""")
def choose_engine(d: Domain) -> DataFrame:
    model = models.load_model(d.spark, workspace(d.spark, "none"), _saved(d, "line_monthly"))
    _, yearly = projection.project(scenarios.spread(d.scenarios()), model)
    return yearly.select(
        F.lit(model.kind).alias("engine"), "scenario_id", "Year",
        F.round("Total_Salary", 0).alias("Total_Salary"), "End_Employees",
    )


_RESIDUALS = "(select entity, \"Year\", \"Month\", mass_salary - predicted_salary as residual from v_monthly_predictions)"


def _residuals(d: Domain) -> DataFrame:
    rows = d.reduced().monthly_predictions().withColumnsRenamed({"mass_salary": "actual", "predicted_salary": "predicted"})
    return scoring.residuals(rows)


@query("residuals", f"select entity, \"Year\", \"Month\", round(residual, 2) as residual from {_RESIDUALS}")
def residuals(d: Domain) -> DataFrame:
    return _residuals(d).select("entity", "Year", "Month", F.round("residual", 2).alias("residual"))


@query("residual_pairs", """select entity, "Year", "Month", round(mass_salary, 2) as actual, round(predicted_salary, 2) as predicted,
      round(mass_salary - predicted_salary, 2) as residual from v_monthly_predictions""")
def residual_pairs(d: Domain) -> DataFrame:
    """Points of the plot of actual against predicted pay."""
    shown = [F.round(c, 2).alias(c) for c in ("actual", "predicted", "residual")]
    return _residuals(d).select("entity", "Year", "Month", *shown)


@query("residual_histogram", f"""
    select cast(least(floor((residual - lo) / (hi - lo) * 30), 29) as bigint) as bin, count(*) as "rows"
    from {_RESIDUALS}, (select min(residual) as lo, max(residual) as hi from {_RESIDUALS}) group by 1""")
def residual_histogram(d: Domain) -> DataFrame:
    return scoring.residual_histogram(_residuals(d))
