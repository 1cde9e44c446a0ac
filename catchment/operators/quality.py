"""Names, coordinates and co-located facilities: resolution, repair, merging, scenarios."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


def resolve_names(rows: DataFrame, source: DataFrame, aliases: DataFrame) -> DataFrame:
    """name, source_name by the first step that finds any: exact, alias, then without regard to
    case and blanks. ``source`` has source_name, ``aliases`` (name, source_name)."""
    exact = rows.join(source, rows["name"] == source["source_name"]).select("name", "source_name", F.lit(1).alias("step"))
    other = rows.join(aliases, "name").join(source, "source_name", "left_semi").select("name", "source_name", F.lit(2).alias("step"))
    loose = rows.join(source, F.lower(F.trim("name")) == F.lower(F.trim("source_name"))).select("name", "source_name", F.lit(3).alias("step"))
    found = exact.union(other).union(loose)
    return found.withColumn("first", F.min("step").over(Window.partitionBy("name"))).where("step = first").select("name", "source_name", "step").distinct()


def repair_places(rows: DataFrame, boxes: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """Rows (row, country, city, name, lat, lon) without a place or outside their country's box
    (country, lat_lo, lat_hi, lon_lo, lon_hi): row, reason, method, new_lat, new_lon.

    Places are looked up by name, city and country, then by city and country."""
    inside = F.col("lat").between(F.col("lat_lo"), F.col("lat_hi")) & F.col("lon").between(F.col("lon_lo"), F.col("lon_hi"))
    reason = F.when(F.col("lat").isNull() | F.col("lon").isNull(), "missing").when(~inside, "outside")
    bad = rows.join(boxes, "country", "left").withColumn("reason", reason).where("reason is not null")
    full = gazetteer.where(F.col("name").isNotNull()).groupBy("name", "city", "country").agg(F.min(F.struct("lat", "lon")).alias("a"))
    town = gazetteer.where(F.col("name").isNull()).groupBy("city", "country").agg(F.min(F.struct("lat", "lon")).alias("b"))
    found = bad.join(full, ["name", "city", "country"], "left").join(town, ["city", "country"], "left")
    method = F.when(F.col("a").isNotNull(), "name+city+country").when(F.col("b").isNotNull(), "city+country").otherwise("FAILED")
    return found.select("row", "reason", method.alias("method"), F.coalesce("a.lat", "b.lat").alias("new_lat"), F.coalesce("a.lon", "b.lon").alias("new_lon"))


def repair_counts(patch: DataFrame) -> DataFrame:
    """reason, method, rows: how many places of a patch were bad for what reason, and how they were found."""
    return patch.groupBy("reason", "method").agg(F.count("*").alias("rows"))


def patched(rows: DataFrame, patch: DataFrame) -> DataFrame:
    """``rows`` with the places of a patch (row, new_lat, new_lon); rows that failed keep theirs."""
    out = rows.join(patch.select("row", "new_lat", "new_lon"), "row", "left")
    return out.select(*[F.coalesce(f"new_{c}", c).alias(c) if c in ("lat", "lon") else F.col(c) for c in rows.columns])


def merged_facilities(facilities: DataFrame, cell: str = "cell_id") -> DataFrame:
    """Facilities of one cell as one: machines summed, in the order of the first."""
    return facilities.groupBy("scope", cell).agg(F.min("fac_seq").alias("fac_seq"), F.sum("machines").alias("machines"))


def stacked(facilities: DataFrame, cell: str = "cell_id") -> DataFrame:
    """Facilities of a cell in order (machines falling) with the machines below each."""
    order = Window.partitionBy("scope", cell).orderBy(F.desc("machines"), "fac_seq")
    below = F.coalesce(F.sum("machines").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return facilities.withColumn("level", F.row_number().over(order)).withColumn("below", below)


def not_near(new: DataFrame, existing: DataFrame, side: float = 1e-4) -> DataFrame:
    """Rows of ``new`` (scope, lat, lon) with no ``existing`` place of the scope within ``side``
    degrees on both axes."""
    near = existing.select(F.col("scope").alias("s"), F.col("lat").alias("a"), F.col("lon").alias("b"), F.floor(F.col("lat") / side).alias("k"))
    near = near.withColumn("k", F.explode(F.array(F.col("k") - 1, F.col("k"), F.col("k") + 1)))
    return new.join(near, (F.floor(new["lat"] / side) == near["k"]) & (new["scope"] == near["s"]) & (F.abs(new["lat"] - near["a"]) < side) & (F.abs(new["lon"] - near["b"]) < side), "left_anti")


def scenario(facilities: DataFrame, overrides: DataFrame, custom: DataFrame, capacity: float) -> DataFrame:
    """Facilities with capacity (overrides by name, else machines times ``capacity``), then the
    custom ones that have a place and none within 1e-4 degrees on both axes.

    ``overrides``: (name, capacity); ``custom``: (scope, name, lat, lon, capacity)."""
    base = facilities.join(overrides.withColumnRenamed("capacity", "own"), "name", "left").withColumn("capacity", F.coalesce("own", F.col("machines") * capacity))
    base = base.withColumn("machines", F.col("capacity") / capacity).select("scope", "fac_seq", "name", "lat", "lon", "machines", "capacity")
    new = custom.where(F.col("lat").isNotNull() & F.col("lon").isNotNull())
    new = not_near(new, base)
    last = base.groupBy("scope").agg(F.max("fac_seq").alias("last"))
    place = F.row_number().over(Window.partitionBy("scope").orderBy("name", "lat", "lon"))  # a user's list
    new = new.withColumn("place", place).join(last, "scope", "left").withColumn("fac_seq", F.coalesce("last", F.lit(0)) + F.col("place"))
    return base.unionByName(new.withColumn("machines", F.col("capacity") / capacity).select(*base.columns))
