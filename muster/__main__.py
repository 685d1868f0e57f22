"""Jobs from the command line, e.g. ``spark-submit --py-files muster.zip -m muster backtest ...`` or
``python -m muster predict --requests r.csv --historical h.csv --yearly-model m --out results``.

Inputs are CSV files; results are written as Parquet folders under ``--out``.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from muster.operators import regression
from muster.operators.ranking import newest_first
from muster.plans import training
from muster.plans.backtest import backtest
from muster.plans.dashboard import dashboard, employee_listing, listing_choices
from muster.plans.predict import forecast_from_last_known, keep_history, predict_batch
from muster.plans.records import JOBS, audit, change_snapshot
from muster.sources import files, models, snapshots, tables
from muster.sources.documents import chart_json, parse_result

SPECS = {
    "yearly": regression.GBT_YEARLY,
    "monthly": regression.GBT_MONTHLY,
    "export": regression.GBT_EXPORT,
    "forest": regression.FOREST,
    "linear": regression.LINEAR,
}


def _write(df: DataFrame, out: str, name: str) -> None:
    df.write.mode("overwrite").parquet(f"{out}/{name}")


def _dashboard(spark: SparkSession, a: argparse.Namespace) -> None:
    board = dashboard(files.read_historical(spark, a.historical))
    _write(board.series, a.out, "series")
    _write(chart_json(board.series), a.out, "charts")
    _write(board.summary, a.out, "summary")


def _listing(spark: SparkSession, a: argparse.Namespace) -> None:
    staff = tables.scan_table(spark, "employees", a.employees)
    _write(employee_listing(staff, a.search, a.corps, a.grade, a.status, a.year), a.out, "employees")


def _monthly_sources(spark: SparkSession, a: argparse.Namespace) -> tuple[DataFrame, DataFrame, DataFrame]:
    return (
        files.read_monthly(spark, a.salary, "mass_salary", "nbemp"),
        files.read_monthly(spark, a.departures, "nb_departures"),
        files.read_monthly(spark, a.recruitments, "Recruitments"),
    )


def _train(spark: SparkSession, a: argparse.Namespace) -> None:
    sources = _monthly_sources(spark, a)
    spec = SPECS[a.kind]
    if a.rounds and "rounds" in spec.params:
        spec = spec.with_params(rounds=a.rounds)
    if a.kind == "yearly":
        trained = training.train_yearly(training.yearly_frame(*sources), spec, f"{a.model}/training")
    elif a.kind in ("monthly", "export"):
        frame = training.monthly_frame if a.kind == "monthly" else training.export_frame
        trained = training.train_holdout(frame(*sources), spec, path=f"{a.model}/training")
    else:
        trained = training.train_holdout(training.inner_frame(*sources), spec, chronological=False)
    training.train_and_save(trained, a.model)


def _backtest(spark: SparkSession, a: argparse.Namespace) -> None:
    tested = backtest(files.read_historical(spark, a.historical), _model(spark, a))
    _write(tested.rows, a.out, "rows")
    _write(tested.metrics, a.out, "metrics")
    _write(tested.footer, a.out, "footer")


def _predict(spark: SparkSession, a: argparse.Namespace) -> None:
    requests = files.read_requests(spark, a.requests)
    history = files.read_historical(spark, a.historical)
    metrics = models.load_metrics(spark, a.yearly_model, a.monthly_model)
    done = predict_batch(requests, history, _model(spark, a), metrics)
    for name in ("monthly", "yearly", "refused", "documents"):
        _write(getattr(done, name), a.out, name)
    if a.users:
        keep_history(done, tables.scan_table(spark, "users", a.users), f"{a.out}/history", F.localtimestamp())


def _changed(spark: SparkSession, a: argparse.Namespace) -> None:
    """Forms or requests over stored employees, and what was refused. A versioned snapshot gets its next version in place; of a plain
    table a new one is written."""
    rows = files.read_forms(spark, a.forms)
    if snapshots.newest(spark, a.employees):
        _write(change_snapshot(spark, a.employees, a.job, rows), a.out, "refused")
        return
    done = JOBS[a.job](tables.scan_table(spark, "employees", a.employees), rows)
    tables.load_table(done.employees, "employees", f"{a.out}/employees")
    _write(done.refused, a.out, "refused")


def _record(spark: SparkSession, a: argparse.Namespace) -> None:
    """Recruitments or terminations added to their table; the employees are not changed."""
    tables.append_movements(files.read_records(spark, a.records, a.table), a.table, a.path, F.localtimestamp(), a.batch)


def _seed(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = files.read_records(spark, a.records, a.table)
    if a.buckets:
        snapshots.create(rows, a.table, a.path, "matricule" if a.table == "employees" else "id", a.buckets)
    else:
        tables.load_table(rows, a.table, a.path)


def _audit(spark: SparkSession, a: argparse.Namespace) -> None:
    named = {
        "employees": a.employees, "users": a.users, "recruitment": a.recruitment, "termination": a.termination,
        "prediction_history": a.history,
    }
    found = audit({name: tables.scan_table(spark, name, path) for name, path in named.items() if path})
    for name, df in found.items():
        _write(df, a.out, name)


def _choices(spark: SparkSession, a: argparse.Namespace) -> None:
    for name, df in listing_choices(tables.scan_table(spark, "employees", a.employees)).items():
        _write(df, a.out, name)


def _history(spark: SparkSession, a: argparse.Namespace) -> None:
    """A user's stored predictions, newest first, with their results parsed."""
    kept = tables.scan_table(spark, "prediction_history", a.history).filter(F.col("user_id") == a.user)
    _write(parse_result(newest_first(kept, "created_at", "id")).drop("result_json"), a.out, "history")


def _forecast(spark: SparkSession, a: argparse.Namespace) -> None:
    """Next year from the last known headcount of each organisation."""
    monthly = training.merged_frame(*_monthly_sources(spark, a))
    moves = files.read_moves(spark, a.moves)
    _write(forecast_from_last_known(monthly, moves, a.year, _model(spark, a)), a.out, "forecast")


def _model(spark: SparkSession, a: argparse.Namespace):
    return models.load_model(spark, a.yearly_model, a.monthly_model)


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="muster")
    jobs = parser.add_subparsers(required=True)

    def job(name: str, run, *required: str, optional: tuple[str, ...] = ()) -> argparse.ArgumentParser:
        p = jobs.add_parser(name)
        p.set_defaults(run=run, job=name)
        for option in required:
            p.add_argument(f"--{option}", required=True)
        for option in optional:
            p.add_argument(f"--{option}", default="")
        return p

    model = ("yearly-model", "monthly-model")
    job("dashboard", _dashboard, "historical", "out")
    listing = job("listing", _listing, "employees", "out", optional=("search", "corps", "grade", "status"))
    listing.add_argument("--year", type=int)
    train = job("train", _train, "salary", "departures", "recruitments", "model")
    train.add_argument("--kind", choices=sorted(SPECS), default="yearly")
    train.add_argument("--rounds", type=int)
    job("backtest", _backtest, "historical", "out", optional=model)
    job("predict", _predict, "requests", "historical", "out", optional=(*model, "users"))

    for change in ("add", "edit", "terminate"):
        job(change, _changed, "employees", "forms", "out")
    for store, run in (("record", _record), ("seed", _seed)):
        own = job(store, run, "records", "path")
        own.add_argument("--table", required=True, choices=sorted(tables.SCHEMAS))
        own.add_argument("--batch", help="id of the batch: its rows are added once, however often the job is run")
        own.add_argument("--buckets", type=int, default=0, help="seed a versioned snapshot of so many buckets")
    job("audit", _audit, "employees", "out", optional=("users", "recruitment", "termination", "history"))
    job("choices", _choices, "employees", "out")
    job("history", _history, "history", "out").add_argument("--user", type=int, required=True)
    forecast = job("forecast", _forecast, "salary", "departures", "recruitments", "moves", "out", optional=model)
    forecast.add_argument("--year", type=int, required=True)

    args = parser.parse_args(argv)
    args.run(SparkSession.builder.appName("muster").getOrCreate(), args)


if __name__ == "__main__":
    main()
