"""Summaries and displays' numbers: medians, histograms, gaps, bands, top cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from catchment.sources.sinks import stored


#: Buckets that a range is cut into; rows of a bucket that are sorted in one task.
BUCKETS, FEW = 1024, 10_000
#: Rounds after which a range of doubles can't be cut any further.
ROUNDS = 20


def magnitude(v: Column) -> Column:
    """A number that rises with v, by equal steps for equal ratios."""
    return F.when(v == 0, 0.0).otherwise(F.signum(v) * (F.log(F.abs(v)) + 746))  # the least double is e^-744.4


def first_reaching(rows: DataFrame, needs: DataFrame, few: int = FEW) -> DataFrame:
    """scope, need, value: the least value of the scope at which the running sum of weights, by
    rising value, reaches ``need`` (the greatest value if rounding keeps the sum below it).

    ``rows`` is a stored table (scope, v, w), v not null, w at least 0; ``needs`` (scope, need) has
    a few rows a scope. Each round cuts the range that an answer lies in into BUCKETS, of equal
    width and of equal ratio by turns, and goes on with the one where the sum passes the need,
    for all scopes in one job; a bucket of ``few`` rows or one value ends it. So no task sorts more
    than a bucket, however large a scope is, and rounds are few however values are spread."""
    ends = rows.groupBy("scope").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n"))
    key = ["scope", "need"]
    open_ = stored(needs.distinct().join(ends, "scope").withColumn("before", F.lit(0.0)), "select-open")
    wide = (F.col("n") > few) & (F.col("lo") < F.col("hi"))
    for turn in range(ROUNDS):
        if open_.where(wide).isEmpty():
            break
        v, lo, hi = (F.col(c) if turn % 2 == 0 else magnitude(F.col(c)) for c in ("v", "lo", "hi"))
        width = (hi - lo) / BUCKETS
        bucket = F.when(width > 0, F.least(F.floor((v - lo) / width), F.lit(BUCKETS - 1))).otherwise(0)
        inside = rows.join(open_.where(wide), "scope").where(F.col("v").between(F.col("lo"), F.col("hi")))
        sums = inside.groupBy(*key, "before", bucket.alias("bucket")).agg(F.sum("w").alias("w"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n"))
        up = Window.partitionBy(*key).orderBy("bucket")  # BUCKETS rows
        run = F.col("before") + F.sum("w").over(up)
        sums = sums.withColumn("run", run).withColumn("last", F.max("bucket").over(Window.partitionBy(*key)))
        hit = sums.where((F.col("run") >= F.col("need")) | (F.col("bucket") == F.col("last")))
        pick = hit.groupBy(*key).agg(F.min(F.struct("bucket", "lo", "hi", "n", (F.col("run") - F.col("w")).alias("before"))).alias("b"))
        pick = pick.select(*key, "b.lo", "b.hi", "b.n", "b.before")
        open_ = stored(open_.where(~wide).select(*pick.columns).union(pick), "select-open")
    inside = rows.join(open_, "scope").where(F.col("v").between(F.col("lo"), F.col("hi")))
    sums = inside.groupBy(*key, "before", "hi", "v").agg(F.sum("w").alias("w"))
    run = F.col("before") + F.sum("w").over(Window.partitionBy(*key).orderBy("v").rowsBetween(Window.unboundedPreceding, 0))  # ``few`` rows
    reached = sums.withColumn("run", run).where((F.col("run") >= F.col("need")) | (F.col("v") == F.col("hi")))
    return reached.groupBy(*key).agg(F.min("v").alias("value"))


def quantiles(rows: DataFrame, value: str, named: dict[str, float], few: int = FEW) -> DataFrame:
    """scope, and a column for each of ``named``: the exact quantile of the values that aren't
    null, between two by linear interpolation. Scopes without any have no row."""
    data = stored(rows.where(F.col(value).isNotNull()).select("scope", F.col(value).cast("double").alias("v"), F.lit(1.0).alias("w")), "select-rows")
    count = stored(data.groupBy("scope").agg(F.count("*").alias("n")), "select-count")
    low = {k: F.floor(q * (F.col("n") - 1)).cast("double") + 1 for k, q in named.items()}
    high = {k: F.ceil(q * (F.col("n") - 1)).cast("double") + 1 for k, q in named.items()}
    needs = count.select("scope", F.explode(F.array(*low.values(), *high.values())).alias("need"))
    found = first_reaching(data, needs, few).join(count, "scope")
    at = lambda need: F.max(F.when(F.col("need") == need, F.col("value")))
    sides = [c for k in named for c in (at(low[k]).alias(f"lo_{k}"), at(high[k]).alias(f"hi_{k}"))]
    wide = found.groupBy("scope", "n").agg(*sides)
    return wide.select("scope", *[(F.col(f"lo_{k}") + (F.col(f"hi_{k}") - F.col(f"lo_{k}")) * (q * (F.col("n") - 1) - F.floor(q * (F.col("n") - 1)))).alias(k) for k, q in named.items()])


def distance_summary(result: DataFrame, few: int = FEW) -> DataFrame:
    """scope, median_km, p95_km, mean_km (weighted by population), and what is out of reach."""
    rows = stored(result.select("scope", "nearest_km", "population"), "summary-rows")
    known = F.col("nearest_km").isNotNull()
    pop = F.when(known, F.col("population"))
    sums = rows.groupBy("scope").agg(
        (F.sum(F.col("nearest_km") * pop) / F.sum(pop)).alias("mean_km"), F.count_if(~known).alias("unreached_cells"),
        F.coalesce(F.sum(F.when(~known, F.col("population"))), F.lit(0.0)).alias("unreached_population"),
    )
    parts = quantiles(rows, "nearest_km", {"median_km": 0.5, "p95_km": 0.95}, few)
    return sums.join(parts, "scope", "left").select("scope", "median_km", "p95_km", "mean_km", "unreached_cells", "unreached_population")


def weighted_median(rows: DataFrame, value: str, weight: str, few: int = FEW) -> DataFrame:
    """scope, median: the first value where the running weight reaches half."""
    data = stored(rows.where(F.col(value).isNotNull()).select("scope", F.col(value).cast("double").alias("v"), F.col(weight).cast("double").alias("w")), "select-rows")
    needs = data.groupBy("scope").agg((0.5 * F.sum("w")).alias("need"))
    return first_reaching(data, needs, few).select("scope", F.col("value").alias("median"))


def histogram(rows: DataFrame, value: str, bins: int, weight: str | None = None) -> DataFrame:
    """bin (0 to bins - 1, of equal width from least to greatest), amount; empty bins have no row."""
    data = stored(rows.where(F.col(value).isNotNull()).select(F.col(value).alias("v"), (F.lit(1) if weight is None else F.col(weight)).alias("w")), "histogram-rows")
    lo, hi = data.agg(F.min("v"), F.max("v")).first()  # two numbers
    width = 0.0 if lo is None else (hi - lo) / bins
    bin_ = F.least(F.floor((F.col("v") - lo) / width), F.lit(bins - 1)) if width > 0 else F.lit(0)
    return data.groupBy(bin_.cast("long").alias("bin")).agg((F.count("*") if weight is None else F.sum("w")).alias("amount"))


def capacity_gap(stats: DataFrame, optimal: DataFrame, proportional: DataFrame, capacity: float, per_million: float = 5.0) -> DataFrame:
    """scope, norm, needed, installed, gap (positive: machines too few) by three norms."""
    rows = stats.select("scope", "population", "machines").join(optimal.withColumnRenamed("demand", "o"), "scope", "left").join(proportional.withColumnRenamed("demand", "p"), "scope", "left").fillna(0.0, ["o", "p"])
    norms = {"optimal": F.col("o") / capacity, "proportional": F.col("p") / capacity, "per_million": F.col("population") / 1e6 * per_million}
    pick = F.explode(F.array(*[F.struct(F.lit(k).alias("norm"), F.ceil(v).alias("needed")) for k, v in norms.items()]))
    rows = rows.select("scope", F.col("machines").cast("long").alias("installed"), pick.alias("n"))
    return rows.select("scope", "n.norm", "n.needed", "installed", (F.col("n.needed") - F.col("installed")).alias("gap"))


def band(value: Column, base: float, bands: int, reverse: bool = False) -> Column:
    """Band of a value: i if below (i + 1) * base, the last beyond; null stays null."""
    b = F.when(value.isNotNull(), F.greatest(F.least(F.floor(value / base), F.lit(bands - 1)), F.lit(0)))
    return (bands - 1 - b) if reverse else b


def scaled(value: Column, lo: Column | float, hi: Column | float, log: bool = False) -> Column:
    """Value between lo and hi as 0 to 1, in logarithmic space if asked; 0.5 if they are equal; null stays null."""
    lo, hi = (x if isinstance(x, Column) else F.lit(float(x)) for x in (lo, hi))
    v, a, b = (F.log1p(x) if log else x for x in (value, lo, hi))
    return F.when(value.isNull(), None).when(b > a, F.greatest(F.least((v - a) / (b - a), F.lit(1.0)), F.lit(0.0))).otherwise(0.5)


def per_area(value: Column, area_km2: Column, unit_km2: float = 10.0) -> Column:
    return F.when(area_km2 > 0, value / (area_km2 / unit_km2))


def top_cells(result: DataFrame, score: Column, n: int) -> DataFrame:
    """scope, rank, cell_id, score: the n highest of each scope, the first cell on ties."""
    order = Window.partitionBy("scope").orderBy(F.desc("score"), "cell_id")
    return result.withColumn("score", score).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).select("scope", "rank", "cell_id", "score")


def extent(cells: DataFrame) -> DataFrame:
    """scope, extent_km: the larger of the spans of latitude and longitude of the centres."""
    mid = (F.max("lat") + F.min("lat")) / 2
    high, wide = (F.max("lat") - F.min("lat")) * 111.32, (F.max("lon") - F.min("lon")) * 111.32 * F.cos(F.radians(mid))
    return cells.groupBy("scope").agg(F.greatest(high, wide).alias("extent_km"))


def display_range(rows: DataFrame, distance: str, count: str, few: int = FEW) -> DataFrame:
    """scope, p95_km, low, high: where the scales of a distance and of a count end."""
    data = stored(rows.select("scope", distance, count), "summary-rows")
    ends = data.groupBy("scope").agg(F.greatest(F.min(count), F.lit(1e-3)).alias("low"), F.max(count).alias("high"))
    return ends.join(quantiles(data, distance, {"p95_km": 0.95}, few), "scope", "left").select("scope", "p95_km", "low", "high")


#: What a map can show: column, whether it is a count (range from 0 to its greatest value, and
#: may be shown by area) or a share (0 to 1).
METRICS = {"deficit": ("untreated", True), "treated": ("treated", True), "demand": ("demand", True), "served": ("served", False), "access": ("access", False)}


def displayed(result: DataFrame, metric: str, area_km2: Column | None = None) -> DataFrame:
    """scope, cell_id, value, low, high of one of METRICS; counts per 10 square km if
    ``area_km2`` is given."""
    column, count = METRICS[metric]
    value = F.col(column) if area_km2 is None or not count else per_area(F.col(column), area_km2)
    rows = result.select("scope", "cell_id", value.alias("value"))
    if not count:
        return rows.withColumns({"low": F.lit(0.0), "high": F.lit(1.0)})
    ends = rows.groupBy("scope").agg(F.max("value").alias("high"))
    return rows.withColumn("low", F.lit(0.0)).join(ends, "scope").select("scope", "cell_id", "value", "low", "high")


def stop_tests(result: DataFrame) -> DataFrame:
    """scope, most_unmet, farthest_km, served: what a plan's stop rules look at."""
    served = F.when(F.sum("demand") > 0, F.sum("treated") / F.sum("demand")).otherwise(0.0)
    return result.groupBy("scope").agg(F.max("untreated").alias("most_unmet"), F.max("nearest_km").alias("farthest_km"), served.alias("served"))


def compared(before: DataFrame, after: DataFrame, values: list[str]) -> DataFrame:
    """scope, and for each of ``values`` of two statistics: before, after and the change."""
    a, b = (x.select("scope", *[F.col(v).alias(f"{v}_{k}") for v in values]) for x, k in ((before, "before"), (after, "after")))
    return a.join(b, "scope").select("scope", *[c for v in values for c in (F.col(f"{v}_before"), F.col(f"{v}_after"), (F.col(f"{v}_after") - F.col(f"{v}_before")).alias(f"{v}_change"))])
