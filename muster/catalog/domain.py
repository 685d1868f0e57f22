"""Workforce views over the bundled tables.

Orders stand for monthly pay, returned line items for departures, a customer's first order for a
hire, customers for employees and nations for organisations. Raw rows are always reduced by their
own key before they meet a dimension, so no nation, customer or supplier can become a hot join key.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from muster.operators import joins, regression, rollups, scenarios
from muster.operators.projection import LinearFormula
from muster.plans import training
from muster.plans.backtest import compare_history
from muster.schemas import GRADE_LABELS
from muster.session import stored


def _text(c: Column) -> Column:
    return c.cast("string")


def _written(coefficients: DataFrame) -> DataFrame:
    return coefficients.select(*[F.round(c, 4).alias(c) for c in coefficients.columns])


# Schemas of the bundled tables, so that opening one starts no inference job.
RAW = {
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
        "o_orderdate timestamp_ntz, o_orderpriority string"
    ),
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
        "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
        "l_linestatus string, l_shipdate timestamp_ntz"
    ),
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
}


def _once(view: Callable) -> Callable:
    """Build a view's (lazy) DataFrame once per Domain."""
    @wraps(view)
    def get(self: Domain, *args: str):
        key = (view.__name__, *args)
        if key not in self.built:
            self.built[key] = view(self, *args)
        return self.built[key]

    return get


@dataclass(frozen=True)
class Domain:
    spark: SparkSession
    sf_dir: str
    built: dict = field(default_factory=dict)

    @_once
    def raw(self, name: str) -> DataFrame:
        return self.spark.read.schema(RAW[name]).parquet(f"{self.sf_dir}/{name}.parquet")

    # ---- monthly and yearly series -----------------------------------------------------------

    @_once
    def monthly_orders(self) -> DataFrame:
        """Pay, staff and hires of each month from one pass over the orders. A customer's months are put side by
        side by the customer key, by which they are then joined."""
        cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
        paid = self.raw("orders").groupBy(
            "o_custkey", F.year("o_orderdate").alias("Year"), F.month("o_orderdate").alias("Month")
        ).agg(F.sum(cents).alias("cents"))
        period = F.col("Year") * 100 + F.col("Month")
        paid = paid.withColumn("hired", period == F.min(period).over(Window.partitionBy("o_custkey")))
        people = self.raw("customer").select("c_custkey", F.col("c_nationkey").alias("entity"))
        joined = paid.join(people, F.col("o_custkey") == F.col("c_custkey"))
        return joined.groupBy("entity", "Year", "Month").agg(
            (F.sum("cents").cast("double") / 100).alias("mass_salary"),
            F.count("*").cast("double").alias("nbemp"),
            F.count_if("hired").alias("Recruitments"),
        )

    def monthly_salary(self) -> DataFrame:
        return self.monthly_orders().drop("Recruitments")

    @_once
    def monthly_departures(self) -> DataFrame:
        left = self.raw("lineitem").filter("l_returnflag = 'R'").groupBy(
            "l_suppkey", F.year("l_shipdate").alias("Year"), F.month("l_shipdate").alias("Month")
        ).agg(F.count("*").alias("n"))
        sites = self.raw("supplier").select("s_suppkey", F.col("s_nationkey").alias("entity"))
        joined = left.join(sites, F.col("l_suppkey") == F.col("s_suppkey"))
        return joined.groupBy("entity", "Year", "Month").agg(F.sum("n").alias("nb_departures"))

    def monthly_recruitments(self) -> DataFrame:
        return self.monthly_orders().filter("Recruitments > 0").select("entity", "Year", "Month", "Recruitments")

    def reduced(self) -> Domain:
        """This domain with its series computed once and stored, for queries that use them more than once: each
        fact table is read once. Series have one row per organisation and month."""
        views = {("monthly_orders",): self.monthly_orders(), ("monthly_departures",): self.monthly_departures()}
        return Domain(self.spark, self.sf_dir, {k: stored(df, f"series-{k[0]}") for k, df in views.items()})

    def monthly_sources(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        return self.monthly_salary(), self.monthly_departures(), self.monthly_recruitments()

    def departures_raw(self) -> DataFrame:
        """Departures as a file has them: text keys under the file's own headers, some unreadable."""
        year, month = _text(F.col("Year")), _text(F.col("Month"))
        return self.monthly_departures().select(
            "entity",
            F.when(F.col("nb_departures") % 10 == 0, F.lit("unknown"))
            .otherwise(F.concat(F.lit(" "), year, F.lit("\t"))).alias(" DEP_ANNEE "),
            F.when(F.col("nb_departures") % 7 == 0, F.concat(month, F.lit(".7")))
            .otherwise(month).alias("dep_mois"),
            "nb_departures",
        )

    @_once
    def merged_monthly(self) -> DataFrame:
        salary, departures, recruitments = self.monthly_sources()
        return joins.merge_monthly_left(departures, recruitments, salary)

    def merged_inner(self) -> DataFrame:
        salary, departures, recruitments = self.monthly_sources()
        return joins.merge_monthly_inner(departures, recruitments, salary)

    @_once
    def merged_yearly(self) -> DataFrame:
        salary, departures, recruitments = self.monthly_sources()
        merged = joins.merge_yearly(
            rollups.yearly_salary(salary),
            rollups.yearly_sum(departures, "nb_departures"),
            rollups.yearly_sum(recruitments, "Recruitments"),
        )
        return merged.withColumn("mass_salary", F.round("mass_salary", 2))

    @_once
    def historical(self) -> DataFrame:
        salary, departures, recruitments = self.monthly_sources()
        yearly = salary.groupBy("entity", "Year").agg(
            F.round(F.sum("mass_salary"), 2).alias("mass_salary"),
            F.max("nbemp").cast("bigint").alias("number_employees"),
        )
        merged = joins.merge_yearly(
            yearly,
            rollups.yearly_sum(departures, "nb_departures"),
            rollups.yearly_sum(recruitments, "Recruitments"),
        )
        return merged.select(
            "entity", F.col("Year").alias("year"), "mass_salary", "number_employees",
            F.col("nb_departures").alias("departures"), F.col("Recruitments").alias("recruitment"),
        )

    def historical_copies(self) -> DataFrame:
        """History with repeated years: one row per order, in file order."""
        return self.raw("orders").select(
            (F.col("o_custkey") % 25).cast("int").alias("entity"), F.year("o_orderdate").alias("year"),
            F.col("o_totalprice").alias("mass_salary"), F.col("o_orderkey").alias("ordinal"),
        )

    # ---- people ------------------------------------------------------------------------------

    @_once
    def employees(self) -> DataFrame:
        days = self.raw("orders").groupBy("o_custkey").agg(
            F.min("o_orderdate").cast("date").alias("first_day"),
            F.max("o_orderdate").cast("date").alias("last_day"),
        )
        k = F.col("c_custkey")
        amount = "decimal(10,2)"
        grades = F.array(*[F.lit(g) for g in sorted(GRADE_LABELS)], F.lit(None))
        return self.raw("customer").join(days, F.col("o_custkey") == k, "left").select(
            k.alias("matricule"),
            F.initcap("c_mktsegment").alias("first_name"),
            F.col("c_name").alias("last_name"),
            F.date_add(F.lit("1960-01-01").cast("date"), (k % 12000).cast("int")).alias("birth_date"),
            F.get(grades, (F.col("c_nationkey") % (len(GRADE_LABELS) + 1)).cast("int")).alias("grade"),
            (k % 13).cast("int").alias("echelon"),
            (100 + k % 901).cast("int").alias("indice"),
            F.when(k % 17 == 0, "").otherwise(F.col("c_mktsegment")).alias("corps"),
            F.when(k % 19 == 0, 0).otherwise(F.col("c_acctbal")).cast(amount).alias("salaire_base"),
            F.when(k % 5 != 0, k % 300).cast(amount).alias("indemnite_residence"),
            ((k % 100) * 0.5).cast(amount).alias("indemnite_transport"),
            F.col("c_mktsegment").alias("situation_familiale"),
            (k % 5).cast("int").alias("nombre_enfants"),
            F.col("first_day").alias("date_joined"),
            F.when(k % 9 != 0, F.date_add("first_day", 365)).alias("date_titularisation"),
            F.when(F.col("last_day") < "2001-06-01", F.col("last_day")).alias("date_left"),
        )

    @_once
    def users(self) -> DataFrame:
        seen = self.raw("events").groupBy("user_id").agg(F.min("ts").alias("created_at"))
        u = F.col("user_id")
        name = F.concat(F.lit("u"), _text(u))
        email = (
            F.when(u % 4 == 0, F.concat(name, F.lit("@site.org")))
            .when(u % 4 == 1, F.concat(name, F.lit(".site.org")))
            .when(u % 4 == 2, F.concat(name, F.lit("@site")))
            .otherwise(F.concat(F.lit("a@"), name, F.lit("@b.c")))
        )
        return seen.select(
            u.alias("id"), name.alias("username"), email.alias("email_adress"),
            (u * 13).alias("matricule"), "created_at",
        )

    def recruitment(self) -> DataFrame:
        return self.raw("orders").select(
            F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("matricule"),
            F.col("o_orderdate").cast("date").alias("recruitment_date"),
            F.col("o_orderstatus").alias("grade"), F.col("o_orderpriority").alias("corps"),
            F.lit("Customer").alias("first_name"), _text(F.col("o_custkey")).alias("last_name"),
            F.when(F.col("o_orderkey") % 3 == 0, F.lit("transfer")).alias("notes"),
        )

    def termination(self) -> DataFrame:
        return self.raw("lineitem").filter("l_returnflag = 'R'").select(
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
            F.col("l_partkey").alias("matricule"),
            F.col("l_shipdate").cast("date").alias("termination_date"),
            F.col("l_linestatus").alias("grade"), F.lit("").alias("corps"),
            F.lit("Part").alias("first_name"), _text(F.col("l_partkey")).alias("last_name"),
            F.when(F.col("l_quantity") > 25, "Retraite").otherwise("Mutation").alias("reason"),
        )

    def history(self) -> DataFrame:
        e = F.col("event_id")
        return self.raw("events").select(
            e.alias("id"), "user_id",
            (2000 + e % 30).alias("start_year"), (2000 + e % 30 + e % 10).alias("end_year"),
            (e % 100).alias("recruitments"), (e % 70).alias("departures"),
            (1 + e % 500).alias("initial_employees"),
            F.col("props").alias("result_json"), F.col("ts").alias("created_at"),
        )

    # ---- scenarios ---------------------------------------------------------------------------

    @_once
    def scenario_table(self) -> DataFrame:
        k = F.col("c_custkey")
        return self.raw("customer").select(
            k.alias("scenario_id"), F.col("c_nationkey").alias("entity"),
            (1995 + k % 110).alias("start_year"),
            (1995 + k % 110 - 2 + k % 25).alias("end_year"),
            (k % 130 - 5).alias("recruitments"),
            (k * 7 % 130).alias("departures"),
            (k * 13 % 400).alias("initial_employees"),
        )

    @_once
    def scenarios(self) -> DataFrame:
        """The scenarios that keep the planning rules."""
        return scenarios.split(scenarios.validate(self.scenario_table()))[0]

    def scenario_requests(self) -> DataFrame:
        """The same as text, some fields missing, unreadable or huge, some requests repeated or without a key."""
        k = F.col("scenario_id")
        asked = self.scenario_table().select(
            "scenario_id", "entity", (k % 200).alias("user_id"),
            F.when(k % 23 == 1, "abc").when(k % 23 != 0, _text(F.col("start_year"))).alias("start_year"),
            F.when(k % 41 != 7, _text(F.col("end_year"))).alias("end_year"),
            F.when(k % 29 != 3, _text(F.col("recruitments"))).alias("recruitments"),
            F.concat(F.lit("  "), _text(F.col("departures")), F.lit("\n")).alias("departures"),
            F.when(k % 37 == 5, "10.5").when(k % 103 == 5, str(2**63 - 1))
            .when(k % 23 != 0, _text(F.col("initial_employees"))).alias("initial_employees"),
        )
        nameless = asked.filter(k % 101 == 0).withColumn("scenario_id", F.lit(None).cast("bigint"))
        return asked.union(asked.filter(k % 97 == 0)).union(nameless)

    # ---- changes -----------------------------------------------------------------------------

    def intake_forms(self) -> DataFrame:
        k = F.col("p_partkey")
        born = F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), (k % 9000).cast("int")), "yyyy-MM-dd")
        return self.raw("part").select(
            k.alias("seq"),
            F.when(k % 19 == 0, "").when(k % 19 == 1, F.concat(F.lit("M"), _text(k)))
            .when(k % 19 == 2, "0").otherwise(_text(k - k % 2)).alias("matricule"),
            F.when(k % 11 == 0, "  ")
            .otherwise(F.concat(F.lit(" <b>"), F.split_part("p_name", F.lit(" "), F.lit(1)))).alias("first_name"),
            F.concat(F.split_part("p_name", F.lit(" "), F.lit(2)), F.when(k % 7 == 0, "'s").otherwise(" & co"))
            .alias("last_name"),
            F.when(k % 13 == 0, "").when(k % 13 == 1, "1990-2-30").when(k % 13 == 2, "1985-3-5")
            .when(k % 13 == 3, "1990-01-05 10:00").otherwise(born).alias("birth_date"),
            F.when(k % 3 == 0, "").otherwise("A2").alias("grade"),
            F.when(k % 17 == 0, "x").when(k % 17 == 1, "").when(k % 17 == 2, "99999999999").otherwise(_text(k % 12 + 1)).alias("echelon"),
            _text(100 + k % 900).alias("indice"),
            F.col("p_brand").alias("corps"),
            F.when(k % 23 == 0, "-5").when(k % 23 == 1, "12,5").when(k % 23 == 2, None)
            .when(k % 23 == 3, "123456789.5").when(k % 23 == 4, "nan")
            .otherwise(F.concat(_text(k % 5000), F.lit(".25"))).alias("salaire_base"),
            F.when(k % 43 == 0, "10d").otherwise("").alias("indemnite_residence"),
            F.when(k % 29 == 0, "1e2").when(k % 29 == 1, "-3").otherwise(" ").alias("indemnite_transport"),
            F.col("p_brand").alias("situation_familiale"),
            F.when(k % 31 == 0, "two").when(k % 31 == 1, "3").when(k % 31 == 2, "99999999999").alias("nombre_enfants"),
            F.when(k % 47 == 0, "yesterday").otherwise("2001-1-15").alias("date_joined"),
            F.when(k % 37 == 0, "soon").otherwise("").alias("date_titularisation"),
        )

    def edit_forms(self) -> DataFrame:
        k = F.col("o_orderkey")
        return self.raw("orders").select(
            k.alias("seq"), F.col("o_custkey").alias("matricule"),
            F.when(k % 41 == 0, "").otherwise(F.concat(F.lit("Ed "), "o_orderstatus")).alias("first_name"),
            F.concat(F.lit("E"), _text(k)).alias("last_name"),
            F.when(k % 9 == 0, "").otherwise(F.concat(F.lit("1980-05-0"), _text(k % 9))).alias("birth_date"),
            F.when(k % 4 == 0, "").otherwise("B").alias("grade"),
            _text(k % 13).alias("echelon"),
            F.when(k % 53 == 0, "high").otherwise("").alias("indice"),
            F.col("o_orderpriority").alias("corps"),
            F.when(k % 43 == 0, "-1").otherwise(F.concat(_text(k % 5000), F.lit(".5"))).alias("salaire_base"),
            F.lit("10").alias("indemnite_residence"),
            F.lit("").alias("indemnite_transport"),
            F.col("o_orderstatus").alias("situation_familiale"),
            F.when(k % 2 == 0, "2").alias("nombre_enfants"),
            F.lit("1995-02-03").alias("date_joined"),
            F.lit("").alias("date_titularisation"),
            F.when(k % 47 == 0, "2001-07-01").otherwise("").alias("date_left"),
        )

    def patches(self) -> DataFrame:
        k = F.col("o_orderkey")
        sent = {"grade": 2, "corps": 3, "salaire_base": 5, "birth_date": 7, "date_titularisation": 11, "first_name": 13}
        day = F.date_add(F.lit("1975-01-01").cast("date"), (k % 5000).cast("int"))
        return self.raw("orders").select(
            k.alias("seq"), F.col("o_custkey").alias("matricule"),
            F.array_compact(F.array(*[F.when(k % n == 0, c) for c, n in sent.items()])).alias("present"),
            F.when(k % 4 != 0, F.concat(F.lit("P"), _text(k % 10))).alias("grade"),
            F.col("o_orderpriority").alias("corps"),
            (k % 9000).cast("decimal(10,2)").alias("salaire_base"),
            F.when(k % 14 != 0, day).alias("birth_date"),
            F.when(k % 22 != 0, day).alias("date_titularisation"),
            F.concat(F.lit("N"), _text(k % 100)).alias("first_name"),
        )

    def termination_requests(self) -> DataFrame:
        k = F.col("o_orderkey")
        return self.raw("orders").select(
            k.alias("seq"),
            (F.col("o_custkey") + F.when(k % 50 == 0, 1_000_000_000).otherwise(0)).alias("matricule"),
            F.when(k % 6 == 0, "").when(k % 6 == 1, "n/a").when(k % 6 == 2, "1990-01-01")
            .otherwise(F.date_format(F.date_add("o_orderdate", 30), "yyyy-MM-dd")).alias("date_left"),
        )

    def delete_keys(self) -> DataFrame:
        return self.raw("supplier").select((F.col("s_suppkey") * 3).alias("matricule"))

    # ---- predictors --------------------------------------------------------------------------

    # The models that queries project with are given tables of coefficients: the fitted ones, written down to
    # four places, so that two engines that project with them agree to the cent. ``fit_line`` itself does not round.

    def yearly_formula(self) -> LinearFormula:
        return LinearFormula("yearly", _written(regression.fit_line(self.merged_yearly(), "nbemp")), ["nbemp"])

    def monthly_formula(self) -> LinearFormula:
        return LinearFormula("monthly", _written(regression.fit_line(self.merged_monthly(), "nbemp")), ["nbemp"])

    def formula(self, kind: str) -> LinearFormula:
        return self.yearly_formula() if kind == "yearly" else self.monthly_formula()

    def compared(self, kind: str = "yearly") -> DataFrame:
        return compare_history(self.historical(), self.formula(kind))

    def monthly_predictions(self) -> DataFrame:
        """Months with actual pay and the line's prediction."""
        scored = self.monthly_formula().predict(self.merged_monthly())
        return scored.withColumnRenamed("prediction", "predicted_salary")

    def yearly_training(self) -> DataFrame:
        return training.yearly_frame(*self.monthly_sources())

    def monthly_training(self) -> DataFrame:
        return training.monthly_frame(*self.monthly_sources())

    def export_training(self) -> DataFrame:
        return training.export_frame(*self.monthly_sources())
