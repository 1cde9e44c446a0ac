"""Input files and tables: typed, cleaned, and with defined nulls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catchment.functions.text import number, site_key

#: Column names that mean the same.
POPULATION = ["population", "pop", "population_count", "value"]
COUNTS = ["He Photon And Electron Beam Rt", "linacs", "count", "machines"]
NAMES = ["name", "institution", "institution name", "facility", "centre", "center"]


def pick(df: DataFrame, names: list[str]) -> str | None:
    """The column of ``df`` that is the first of ``names``, without regard to case and blanks."""
    have = {c.strip().lower(): c for c in reversed(df.columns)}
    return next((have[n.lower()] for n in names if n.lower() in have), None)


def population(df: DataFrame) -> DataFrame:
    """h3, population (null, NaN and negative count as 0) and, if present, other cell columns."""
    source = pick(df, POPULATION)
    if source is None:
        raise ValueError(f"no population column among {df.columns}")
    value = F.coalesce(F.nanvl(F.col(f"`{source}`").cast("double"), F.lit(0.0)), F.lit(0.0))
    keep = [c for c in df.columns if c in ("country", "lat", "lon", "area_km2")]
    return df.select("h3", F.greatest(value, F.lit(0.0)).alias("population"), *keep)


def valid_place(lat: str = "lat", lon: str = "lon"):  # noqa: ANN201
    return F.col(lat).isNotNull() & F.col(lon).isNotNull() & F.col(lat).between(-90, 90) & F.col(lon).between(-180, 180)


def facility_file(df: DataFrame) -> DataFrame:
    """Rows of the facility file (all text) with machines and a place on earth."""
    rows = df.select(
        F.col("Country").alias("country"), F.trim(F.coalesce("Operator Name", F.lit(""))).alias("name"), F.trim(F.coalesce("City", F.lit(""))).alias("city"),
        F.bround(number(F.col("Latitude")), 5).alias("lat"), F.bround(number(F.col("Longitude")), 5).alias("lon"),
        F.coalesce(number(F.col(f"`{COUNTS[0]}`")), F.lit(0.0)).alias("machines"),
    )
    return rows.where(valid_place() & (F.col("machines") > 0))


def facility_sheet(df: DataFrame) -> DataFrame:
    """A sheet of unknown layout: one "lat, lon" column or two; a missing count is one machine,
    a count of 0 drops the row (unlike in the facility file)."""
    both, lat, lon = pick(df, ["coordinates"]), pick(df, ["latitude", "lat"]), pick(df, ["longitude", "lon", "lng"])
    if both:
        parts = F.split(F.col(f"`{both}`"), ",")
        place = [number(F.try_element_at(parts, F.lit(i))) for i in (1, 2)]
    elif lat and lon:
        place = [number(F.col(f"`{c}`").cast("string")) for c in (lat, lon)]
    else:
        raise ValueError(f"no coordinates among {df.columns}")
    count, name = pick(df, COUNTS), pick(df, NAMES)
    n = number(F.col(f"`{count}`").cast("string")) if count else F.lit(None).cast("double")
    label = F.trim(F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))) if name else F.lit("")
    rows = df.select(label.alias("name"), F.bround(place[0], 5).alias("lat"), F.bround(place[1], 5).alias("lon"), n.alias("n"))
    rows = rows.where(valid_place() & (F.col("n").isNull() | (F.col("n") != 0)))
    return rows.select("name", "lat", "lon", F.coalesce("n", F.lit(1.0)).alias("machines"))


def utilisation(lines: DataFrame) -> DataFrame:
    """site, site_key, fraction from text lines: the last comma splits, other lines are skipped."""
    part = lambda k: F.regexp_extract("value", r"^(.*),([^,]*)$", k)
    rows = lines.select(F.trim(part(1)).alias("site"), number(part(2)).alias("fraction")).where(F.col("fraction").isNotNull() & (F.col("site") != ""))
    return rows.select("site", site_key(F.col("site")).alias("site_key"), "fraction")


def actual_fractions(spark: SparkSession, folder: str) -> DataFrame:
    """iso3, site_key, fraction of a folder with a headerless file for each country, named
    by it (ABC.csv) or in a folder of its own (iso3=ABC)."""
    rows = spark.read.text(folder)
    named = F.regexp_extract(F.col("_metadata.file_name"), r"^([A-Za-z]{3})\.", 1)
    iso3 = F.coalesce(F.col("iso3").cast("string"), named) if "iso3" in rows.columns else named
    rows = rows.select("value", iso3.alias("iso3"))
    part = lambda k: F.regexp_extract("value", r"^(.*),([^,]*)$", k)
    rows = rows.select("iso3", site_key(part(1)).alias("site_key"), number(part(2)).alias("fraction"))
    return rows.where(F.col("fraction").isNotNull() & (F.col("iso3") != ""))


TRAVEL = "results array<struct<search_id:string,cells:array<struct<id:string,properties:struct<min:double,mean:double>>>>>"


def travel_times(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """h3, search_id, minutes from files of a response each (``lines``: one a line): the mean, or else the least, in minutes;
    the smallest of repeated ones. A missing row is out of reach."""
    r = spark.read.schema(TRAVEL).json(path, multiLine=not lines).select(F.explode("results").alias("r"))
    c = r.select("r.search_id", F.explode("r.cells").alias("c"))
    rows = c.select(F.col("c.id").alias("h3"), "search_id", (F.coalesce("c.properties.mean", "c.properties.min") / 60).alias("minutes"))
    return rows.where(F.col("minutes").isNotNull()).groupBy("h3", "search_id").agg(F.min("minutes").alias("minutes"))
