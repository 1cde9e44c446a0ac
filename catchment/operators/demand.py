"""Cases, treatment demand, and their apportionment to cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from catchment.functions.text import is_aggregate, site_key


def with_fraction(cases: DataFrame, fractions: DataFrame, actual: DataFrame | None = None) -> DataFrame:
    """``cases`` (scope, site, cases) with fraction (0 where missing) and, where a scope has its
    own figures, those first."""
    rows = cases.withColumn("site_key", site_key(F.col("site"))).join(fractions, "site_key", "left")
    if actual is not None:
        rows = rows.join(actual.withColumnRenamed("fraction", "own"), ["scope", "site_key"], "left")
        rows = rows.withColumn("fraction", F.coalesce("own", "fraction")).drop("own")
    return rows.fillna(0.0, ["fraction"])


def demand_optimal(cases: DataFrame, fractions: DataFrame) -> DataFrame:
    """scope, demand: cases times fraction over all sites that aren't aggregates."""
    rows = with_fraction(cases.where(~is_aggregate(F.col("site"))), fractions)
    return rows.groupBy("scope").agg(F.sum(F.col("cases") * F.col("fraction")).alias("demand"))


def demand_custom(cases: DataFrame, percents: DataFrame) -> DataFrame:
    """scope, demand by the user's (site, percent); sites the user left out count as 0."""
    own = percents.select(F.lower(F.trim("site")).alias("k"), "percent")
    rows = cases.where(~is_aggregate(F.col("site"))).withColumn("k", F.lower(F.trim("site"))).join(own, "k", "left")
    return rows.groupBy("scope").agg(F.sum(F.col("cases") * F.coalesce("percent", F.lit(0.0)) / 100).alias("demand"))


def demand_proportional(cases: DataFrame, fraction: float, total: Column | None = None) -> DataFrame:
    """scope, demand: one fraction of the cases of the rows where ``total`` holds."""
    rows = cases if total is None else cases.where(total)
    return rows.groupBy("scope").agg((F.sum("cases") * fraction).alias("demand"))


def derived_sites(cases: DataFrame) -> DataFrame:
    """``cases`` and the two sites that only aggregates tell: NMSC and Other."""
    key = F.lower(F.trim("site"))
    full = F.sum(F.when(key == "all cancers", F.col("cases")))
    less = F.sum(F.when(key == "all cancers excl. nmsc", F.col("cases")))
    single = F.coalesce(F.sum(F.when(~is_aggregate(F.col("site")), F.col("cases"))), F.lit(0.0))
    sums = cases.groupBy("scope").agg(full.alias("f"), less.alias("e"), single.alias("s"))
    pair = F.explode(F.array(F.struct(F.lit("NMSC").alias("site"), (F.col("f") - F.col("e")).alias("x")), F.struct(F.lit("Other").alias("site"), (F.col("e") - F.col("s")).alias("x"))))
    more = sums.select("scope", pair.alias("p")).where("p.x is not null").select("scope", "p.site", F.greatest("p.x", F.lit(0.0)).alias("cases"))
    return cases.select("scope", "site", "cases").union(more)


def share(cells: DataFrame) -> DataFrame:
    """``cells`` with share, of the population of the scope; 0 where that is 0.

    The scope's total comes from a partial sum and a join, so a scope may be of any size."""
    total = cells.groupBy("scope").agg(F.sum("population").alias("total"))
    value = F.when(F.col("total") > 0, F.col("population") / F.col("total")).otherwise(F.lit(0.0))
    return cells.join(total, "scope").withColumn("share", value).drop("total")


def cell_demand(cells: DataFrame, demand: DataFrame) -> DataFrame:
    """``cells`` with the demand of the scope dealt by population; a scope without has 0."""
    return share(cells).join(demand, "scope", "left").withColumn("demand", F.coalesce("demand", F.lit(0.0)) * F.col("share"))


def apportion(cells: DataFrame, cases: DataFrame, fractions: DataFrame, actual: DataFrame | None = None) -> DataFrame:
    """cell_id, scope, site, incidence, optimal, actual: long rows, a site each."""
    best = with_fraction(cases, fractions).withColumnRenamed("fraction", "best")
    if actual is None:
        rows = best.withColumn("own", F.col("best"))
    else:
        rows = best.join(actual.withColumnRenamed("fraction", "own"), ["scope", "site_key"], "left").withColumn("own", F.coalesce("own", "best"))
    rows = share(cells).select("cell_id", "scope", "share").join(rows, "scope")
    x = F.col("cases") * F.col("share")
    return rows.select("cell_id", "scope", "site", x.alias("incidence"), (x * F.col("best")).alias("optimal"), (x * F.col("own")).alias("actual"))


def site_table(cases: DataFrame, fractions: DataFrame, population: DataFrame) -> DataFrame:
    """scope, site, cases, percent of all sites, rate percent of population, treatments."""
    total = Window.partitionBy("scope")  # a row for each site of a scope
    rows = with_fraction(cases, fractions).join(population, "scope")
    return rows.select(
        "scope", "site", "cases", (100 * F.col("cases") / F.sum("cases").over(total)).alias("percent"),
        F.when(F.col("population") > 0, 100 * F.col("cases") / F.col("population")).alias("rate"), (F.col("cases") * F.col("fraction")).alias("treatments"),
    )


def cases_for(cases: DataFrame, wanted: DataFrame) -> DataFrame:
    """scope, site, cases of each row of ``wanted`` (scope, site): 0 where missing or not finite."""
    x = F.col("cases")
    finite = F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")), x).otherwise(0.0)
    sums = cases.groupBy("scope", "site").agg(F.sum(finite).alias("cases"))
    return wanted.join(sums, ["scope", "site"], "left").fillna(0.0, ["cases"])


def total_cases(cases: DataFrame, sites: list[str]) -> DataFrame:
    """scope, cases: the sum over a choice of sites; negative counts as 0."""
    return cases.where(F.col("site").isin(sites)).groupBy("scope").agg(F.sum(F.greatest("cases", F.lit(0.0))).alias("cases"))


def headline(demand: DataFrame, population: DataFrame, cases: DataFrame) -> DataFrame:
    """scope, demand, of_population, of_cases (percent; null where the denominator is 0)."""
    sums = cases.groupBy("scope").agg(F.sum("cases").alias("cases"))
    rows = population.join(demand, "scope", "left").join(sums, "scope", "left").fillna(0.0, ["demand"])
    part = lambda c: F.when(F.col(c) > 0, 100 * F.col("demand") / F.col(c))
    return rows.select("scope", "demand", part("population").alias("of_population"), part("cases").alias("of_cases"))
