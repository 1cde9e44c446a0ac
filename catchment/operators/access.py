"""Geographic access: range join, nearest facility, combined access. A cell is a row of a scope:
a border cell that several scopes hold is one for each, with that scope's facilities only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catchment.functions.geo import LEAST_RADIUS_KM, cube, decay, lambert_km, unit_vector
from catchment.sources.sinks import stored

Distance = Callable[[Column, Column, Column, Column], Column]
#: What names a cell, and a place of a scope.
KEY, PLACE = ["scope", "cell_id"], ["scope", "lat", "lon"]
#: Cells of a cube that meet its facilities in one task; more are dealt over several.
CUBE_CELLS = 20_000
#: Places of a pyramid's leaf, its fan-out along an axis, its depth (the last cubes are some 12 m wide).
LEAF, FAN, DEPTH = 64, 4, 10
#: Scopes of up to so many leaves of places are searched in one step: fewer jobs, and a cell that is far
#: from all meets most cubes anyway.
LEAVES = 8


def with_km(pairs: DataFrame, distance: Distance = lambert_km) -> DataFrame:
    return pairs.withColumn("km", distance(F.col("lat"), F.col("lon"), F.col("f_lat"), F.col("f_lon")))


def named(facilities: DataFrame) -> DataFrame:
    return facilities.withColumnsRenamed({"lat": "f_lat", "lon": "f_lon"})


def with_scope(minutes: DataFrame, facilities: DataFrame) -> DataFrame:
    """Travel times (cell_id, fac_seq, minutes) with the scope of the facility, if they have
    none: then each fac_seq must be of one scope."""
    return minutes if "scope" in minutes.columns else minutes.join(facilities.select("scope", "fac_seq"), "fac_seq")


def with_place(rows: DataFrame, key: str, name: str) -> DataFrame:
    """``rows`` (scope, lat, lon) with ``name``: the first ``key`` of those of their scope at the same
    place, so that what depends on the place alone is computed once for it."""
    first = rows.groupBy(*PLACE).agg(F.min(key).alias(name)).withColumnsRenamed({c: f"_{c}" for c in PLACE})
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in PLACE]
    return rows.join(first, same[0] & same[1] & same[2]).drop(*[f"_{c}" for c in PLACE])


def sites_of(facilities: DataFrame) -> DataFrame:
    """The places of ``facilities`` (scope, fac_seq, site, lat, lon): scope, site, lat, lon, and how
    many facilities each has as ``n``."""
    return facilities.groupBy("site", *PLACE).agg(F.count("*").alias("n"))


def spread(rows: DataFrame, *key: str) -> DataFrame:
    """``rows`` over all tasks: places are few for the pairs that come of them, and Spark puts small
    tables into one partition."""
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), *key)


def pairs_within(cells: DataFrame, facilities: DataFrame, radius_km: float, distance: Distance = lambert_km, cube_cells: int = CUBE_CELLS, hint: str | None = None) -> DataFrame:
    """Cells and facilities of one scope at most ``radius_km`` apart, with km.

    An equi-join on cubes of the sphere: facilities are dealt into the 27 cubes around
    theirs, so no pair is missed, not at the poles or the date line either. A cube with more
    than ``cube_cells`` cells splits: its cells are dealt into parts, each of which gets the
    cube's facilities, so a dense place is many keys. Each pair meets once. ``hint`` is Spark's
    for the join: by itself it may broadcast the 27 copies of the facilities."""
    around, key = F.array(*[F.lit(i) for i in (-1, 0, 1)]), ["scope", "bx", "by", "bz"]
    x, y, z = cube(F.col("lat"), F.col("lon"), radius_km)
    people = cells.withColumns({"bx": x, "by": y, "bz": z})
    dense = people.groupBy(*key).agg(F.ceil(F.count("*") / cube_cells).cast("int").alias("_parts")).where("_parts > 1")
    part = F.coalesce(F.pmod(F.xxhash64("cell_id"), "_parts"), F.lit(0)).cast("int")
    people = people.join(dense, key, "left").withColumn("_part", part).drop("_parts")
    x, y, z = cube(F.col("f_lat"), F.col("f_lon"), radius_km)
    fac = named(facilities).withColumns({"bx": x, "by": y, "bz": z})
    for b in ("bx", "by", "bz"):
        fac = fac.withColumn("_d", F.explode(around)).withColumn(b, F.col(b) + F.col("_d")).drop("_d")
    fac = fac.join(dense, key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    rows = people.join(fac.hint(hint) if hint else fac, [*key, "_part"]).drop("bx", "by", "bz", "_part")
    return with_km(rows, distance).where(F.col("km") <= radius_km)


def places_within(cells: DataFrame, facilities: DataFrame, radius_km: float, distance: Distance = lambert_km) -> DataFrame:
    """scope, lat, lon, f_lat, f_lon, km of the places of ``cells`` and ``facilities`` that are at most
    ``radius_km`` apart: ``pairs_within``, each distance computed once."""
    spots, sites = (stored(spread(rows.select(*PLACE).distinct()), name) for rows, name in ((cells, "spots"), (facilities, "sites")))
    return pairs_within(spots.withColumn("cell_id", F.xxhash64("lat", "lon")), sites, radius_km, distance).drop("cell_id")


def pairs_at(near: DataFrame, cells: DataFrame, facilities: DataFrame) -> DataFrame:
    """Every cell and facility of pairs of places ``near`` (see places_within). Facilities come
    first: with them a pair of places has fewer rows than with cells, of which there are more."""
    return spread(near, *PLACE).join(named(facilities), ["scope", "f_lat", "f_lon"]).join(cells, PLACE)


def pyramid(places: DataFrame, leaf: int = LEAF) -> DataFrame:
    """Cubes of the sphere that hold ``places`` (scope, lat, lon, fac_seq), from a whole to small ones: scope,
    level, bx, by, bz, the parent's px, py, pz, inside (places and the first fac_seq at each, null
    for cubes that split), and one facility as ``one``. A cube of more than ``leaf`` places splits."""
    side = F.lit(2.0) / F.pow(F.lit(float(FAN)), F.col("level"))
    rows = places.withColumns(dict(zip("xyz", unit_vector(F.col("lat"), F.col("lon")), strict=True))).withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(DEPTH))))
    rows = rows.select("scope", "level", *[F.floor((F.col(c) + 1) / side).alias(f"b{c}") for c in "xyz"], F.struct("lat", "lon", "fac_seq").alias("place"))
    key = ["scope", "level", "bx", "by", "bz"]
    size = stored(rows.groupBy(*key).agg(F.count("*").alias("n"), F.min("place").alias("one")), "pyramid-cubes")
    above = size.where(F.col("n") > leaf).select("scope", (F.col("level") + 1).alias("level"), *[F.col(f"b{c}").alias(f"p{c}") for c in "xyz"])
    mine = size.withColumns({f"p{c}": F.floor(F.col(f"b{c}") / FAN) for c in "xyz"})
    nodes = mine.where("level = 0").unionByName(mine.join(above, ["scope", "level", "px", "py", "pz"], "left_semi"))
    last = (F.col("n") <= leaf) | (F.col("level") == DEPTH)
    inside = rows.join(nodes.where(last).select(*key), key, "left_semi").groupBy(*key).agg(F.collect_list("place").alias("inside"))  # ``leaf`` places, or some 12 m
    return nodes.select(*key, "px", "py", "pz", "one").join(inside, key, "left")


def nearest(cells: DataFrame, facilities: DataFrame, distance: Distance = lambert_km, leaf: int = LEAF) -> DataFrame:
    """scope, cell_id, nearest_km, fac_seq: the nearest facility of the scope, however far, the
    first on ties. Cells whose scope has no facility have no row.

    Cells descend a pyramid of cubes. At each level a cell knows a distance that it can have; it
    goes on to those cubes alone that could hold a nearer facility (6,335 km times the chord to
    a cube is less than any distance to a place in it). So a join has some ``leaf`` rows a cell
    and cube that is left, not one for each facility, and scopes of up to ``leaf`` places take
    one step."""
    places = facilities.where("lat is not null and lon is not null").groupBy("scope", "lat", "lon").agg(F.min("fac_seq").alias("fac_seq"))
    places = stored(places, "near-places")
    split = not places.groupBy("scope").agg(F.count("*").alias("n")).where(F.col("n") > LEAVES * leaf).isEmpty()
    people = cells.where("lat is not null and lon is not null").select(*KEY, "lat", "lon")
    side = F.lit(2.0) / F.pow(F.lit(float(FAN)), F.col("level"))
    gap = [F.greatest(F.col(f"b{c}") * side - 1 - v, v - (F.col(f"b{c}") + 1) * side + 1, F.lit(0.0)) for c, v in zip("xyz", unit_vector(F.col("lat"), F.col("lon")), strict=True)]
    beyond = LEAST_RADIUS_KM * (1 - 1e-9) * F.sqrt(sum(g * g for g in gap))

    def reached(rows: DataFrame, place: str) -> DataFrame:
        return rows.select(*KEY, F.struct(distance(F.col("lat"), F.col("lon"), F.col(f"{place}.lat"), F.col(f"{place}.lon")).alias("km"), F.col(f"{place}.fac_seq").alias("fac_seq")).alias("b"))

    def best_of(rows: DataFrame) -> DataFrame:
        found = reached(rows.where("inside is not null").withColumn("place", F.explode("inside")), "place")
        if split:
            found = found.union(reached(rows.where("inside is null"), "one"))
        return found.groupBy(*KEY).agg(F.min("b").alias("b"))

    if not split:
        best = best_of(people.join(places.groupBy("scope").agg(F.collect_list(F.struct("lat", "lon", "fac_seq")).alias("inside")), "scope"))
    else:
        nodes = stored(pyramid(places, leaf), "pyramid")
        met = people.join(nodes.where("level = 0"), "scope")
        best, level = stored(best_of(met), "near-best"), 0
        while True:
            left = met.where("inside is null").withColumn("beyond", beyond).join(best, KEY).where(F.col("beyond") <= F.col("b.km"))
            left = stored(left.select(*KEY, "lat", "lon", "b", *[F.col(f"b{c}").alias(f"p{c}") for c in "xyz"]), "near-left")
            if left.isEmpty():
                break
            level += 1
            met = left.join(nodes.where(F.col("level") == level), ["scope", "px", "py", "pz"]).where(beyond <= F.col("b.km")).drop("b")
            met = stored(met, "near-met")
            best = stored(best.union(best_of(met)).groupBy(*KEY).agg(F.min("b").alias("b")), "near-best")
    return best.select(*KEY, F.col("b.km").alias("nearest_km"), "b.fac_seq")


def chances(pairs: DataFrame, probability: Column) -> DataFrame:
    """scope, cell_id, access: 1 minus the product of misses over facilities (each once, whatever
    its machines). A pair stands for ``n`` facilities of one place, if it has that column."""
    miss = F.greatest(1 - probability, F.lit(0.0))
    miss = F.pow(miss, F.col("n")) if "n" in pairs.columns else miss
    return pairs.groupBy(*KEY).agg((1 - F.product(miss)).alias("access"))


def geographic_access(cells: DataFrame, pairs: DataFrame, probability: Column | None = None, **model: object) -> DataFrame:
    """``cells`` with access (see chances) and people with access. Cells without a pair have 0."""
    p = decay(F.col("km"), **model) if probability is None else probability
    rows = cells.join(chances(pairs, p), KEY, "left").fillna(0.0, ["access"])
    return rows.withColumn("with_access", F.col("access") * F.col("population"))


def access_within(cells: DataFrame, facilities: DataFrame, radius_km: float, distance: Distance = lambert_km, **model: object) -> DataFrame:
    """``geographic_access`` by all facilities within ``radius_km``, computed once for each place
    that cells or facilities share."""
    cells = stored(with_place(cells, "cell_id", "spot"), "access-cells")
    spots = spread(cells.select("scope", F.col("spot").alias("cell_id"), "lat", "lon").distinct())
    pairs = pairs_within(spots, sites_of(with_place(facilities.select("fac_seq", *PLACE), "fac_seq", "site")), radius_km, distance)
    found = chances(pairs, decay(F.col("km"), **model)).withColumnRenamed("cell_id", "spot")
    rows = cells.join(found, ["scope", "spot"], "left").fillna(0.0, ["access"])
    return rows.withColumn("with_access", F.col("access") * F.col("population")).select(*[c for c in cells.columns if c != "spot"], "access", "with_access")
