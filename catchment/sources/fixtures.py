"""Views of the service-access model over the star-schema tables: population cells,
facilities, case numbers and treatment fractions. All arithmetic is exact or in doubles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Treatment fraction of each site.
FRACTIONS = {"ECONOMY": 0.83, "LARGE": 0.68, "MEDIUM": 0.76, "PROMO": 0.58, "SMALL": 0.04, "STANDARD": 0.50}

#: The country (ISO 3166 alpha-2) that stands for each nation, by its key.
COUNTRY_CODES = "DZ AR BR CA EG ET FR DE IN ID IR IQ JP JO KE MA MZ PE CN RO SA VN RU GB US".split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _place(nation: str, key: str, a: int, b: int, mod: int) -> list:
    half = mod // 2
    lat = (F.lit(-40) + 10 * (F.col(nation) % 9)) + ((F.col(key) * a) % mod - half).cast("double") / 100
    lon = (F.lit(-150) + 12 * F.col(nation)) + ((F.col(key) * b) % mod - half).cast("double") / 100
    return [lat.alias("lat"), lon.alias("lon")]


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cell_id, scope (country), lat, lon, population."""
    pop = F.greatest(F.col("c_acctbal").cast("double"), F.lit(0.0))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("cell_id"), F.col("c_nationkey").alias("scope"), *_place("c_nationkey", "c_custkey", 37, 91, 601), pop.alias("population"))


def border_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells that two countries hold: one id and place, a row and population of each country."""
    single = cells(spark, sf_dir).withColumn("h", F.floor(F.col("cell_id") / 2))
    place = single.groupBy("h").agg(F.min_by("lat", "cell_id").alias("lat"), F.min_by("lon", "cell_id").alias("lon"))
    rows = single.groupBy("h", "scope").agg(F.sum("population").alias("population")).join(place, "h")
    return rows.select(F.col("h").alias("cell_id"), "scope", "lat", "lon", "population")


def facilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fac_seq, scope, lat, lon, machines."""
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("fac_seq"), F.col("s_nationkey").alias("scope"), *_place("s_nationkey", "s_suppkey", 53, 17, 401), (F.col("s_suppkey") % 4).cast("double").alias("machines"))


def incidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scope, site, cases. Line items meet the two tables first: hardly two of them share both keys,
    so summing by those would shuffle them all."""
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", F.col("l_quantity").cast("double").alias("q"))
    supplier, part = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), table(spark, sf_dir, "part").select("p_partkey", "p_type")
    rows = lines.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(part, F.col("l_partkey") == F.col("p_partkey"))
    return rows.groupBy(F.col("s_nationkey").alias("scope"), F.col("p_type").alias("site")).agg((F.sum("q") / 10).alias("cases"))


def fractions(spark: SparkSession) -> DataFrame:
    """site_key, fraction: a fixed dimension of one row a site."""
    return spark.createDataFrame(sorted((k.lower(), v) for k, v in FRACTIONS.items()), "site_key string, fraction double")


def countries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scope, name, region."""
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("scope"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
