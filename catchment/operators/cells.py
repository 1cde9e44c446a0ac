"""Cells of a hexagon grid: coarser cells, snapping of places to cells and to facilities."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catchment.functions.geo import h3_parent, lambert_km
from catchment.operators.access import KEY, Distance, named, nearest, pairs_within, with_km, with_scope
from catchment.sources.sinks import stored

#: Adds minutes to pairs (scope, cell_id, fac_seq): null where the facility is out of reach.
Travel = Callable[[DataFrame], DataFrame]
#: So many pairs of spots and facilities are asked for at once; so are all beyond this radius.
ALL_PAIRS, FAR_KM = 20_000_000, 5_000.0


def resample(cells: DataFrame, res: int) -> DataFrame:
    """h3 (number), population: sums over the parents at ``res``; cells coarser than that are left out."""
    rows = cells.select(h3_parent(F.col("h3"), res).alias("h3"), "population").where("h3 is not null")
    return rows.groupBy("h3").agg(F.sum("population").alias("population"))


def resample_levels(cells: DataFrame, finest: int, coarsest: int) -> DataFrame:
    """res, h3, population: sums over the parents of every resolution from ``finest`` to
    ``coarsest``. Cells are summed once, by their finest parents; the ids of coarser ones
    follow from those."""
    fine = resample(cells, finest)
    levels = F.array(*[F.struct(F.lit(r).alias("res"), h3_parent(F.col("h3"), r).alias("h3")) for r in range(coarsest, finest + 1)])
    return fine.select(F.explode(levels).alias("p"), "population").groupBy("p.res", "p.h3").agg(F.sum("population").alias("population"))


def coarser_minutes(minutes: DataFrame, cells: DataFrame, res: int) -> DataFrame:
    """scope, h3, fac_seq, minutes: travel times (scope, cell_id, fac_seq, minutes) to the parents
    at ``res`` of ``cells`` (scope, cell_id, h3, population): means over the cells that reach the
    facility, weighted by population (1 at least)."""
    w = F.greatest("population", F.lit(1.0))
    rows = minutes.join(cells.select("scope", "cell_id", h3_parent(F.col("h3"), res).alias("h3"), w.alias("w")), ["scope", "cell_id"]).where("h3 is not null")
    return rows.groupBy("scope", "h3", "fac_seq").agg((F.sum(F.col("w") * F.col("minutes")) / F.sum("w")).alias("minutes"))


def pooled(cells: DataFrame, member: DataFrame) -> DataFrame:
    """``cells`` (scope, cell_id, lat, lon, population) of the regions of ``member`` (scope,
    region) as scopes; the people of a cell that several countries hold are summed."""
    rows = cells.join(member, "scope").groupBy(F.col("region").alias("scope"), "cell_id")
    return rows.agg(F.min("lat").alias("lat"), F.min("lon").alias("lon"), F.sum("population").alias("population"))


def minutes_or_cap(cells: DataFrame, facilities: DataFrame, minutes: DataFrame, cap: float) -> DataFrame:
    """scope, cell_id, reached, unreached, mean_minutes: of the facilities of its scope, how many
    a cell reaches, how many not, and the mean of all with ``cap`` for those it doesn't reach.

    What isn't reached follows from the number of facilities: pairs out of reach are never made."""
    least = minutes.groupBy("scope", "cell_id", "fac_seq").agg(F.min("minutes").alias("m"))
    sums = least.groupBy("scope", "cell_id").agg(F.count("*").alias("reached"), F.sum(F.least("m", F.lit(cap))).alias("m"))
    rows = cells.select("scope", "cell_id").join(facilities.groupBy("scope").agg(F.count("*").alias("n")), "scope").join(sums, ["scope", "cell_id"], "left").fillna(0, ["reached", "m"])
    left = F.col("n") - F.col("reached")
    return rows.select("scope", "cell_id", "reached", left.alias("unreached"), ((F.col("m") + cap * left) / F.col("n")).alias("mean_minutes"))


def with_parent(rows: DataFrame, targets: DataFrame, res: int) -> DataFrame:
    """``rows`` (h3) with their parent at ``res``, if it is one of ``targets`` (parent)."""
    return rows.withColumn("parent", h3_parent(F.col("h3"), res)).join(targets.select("parent").distinct(), "parent")


def snapped(facilities: DataFrame, cells: DataFrame, distance: Distance = lambert_km) -> DataFrame:
    """scope, fac_seq, cell_id: the cell of the scope whose centre is nearest to each facility."""
    places = facilities.select(F.col("fac_seq").alias("cell_id"), "scope", "lat", "lon")
    centres = cells.select(F.col("cell_id").alias("fac_seq"), "scope", "lat", "lon")
    found = nearest(places, centres, distance=distance)
    return found.select("scope", F.col("cell_id").alias("fac_seq"), F.col("fac_seq").alias("cell_id"))


class Snapped(NamedTuple):
    """``facilities`` (scope, fac_seq, cell_id, lat, lon, machines), one a cell, and ``moved``
    (scope, fac_seq, new_seq), which of them each facility became part of."""

    facilities: DataFrame
    moved: DataFrame


def snapped_facilities(facilities: DataFrame, cells: DataFrame, distance: Distance = lambert_km) -> Snapped:
    """Facilities at the centres of their cells. Those of one cell are one: machines are summed,
    the order is that of the first. Facilities of scopes without cells are left out."""
    at = stored(snapped(facilities, cells, distance), "snapped")
    rows = facilities.select("scope", "fac_seq", "machines").join(at, ["scope", "fac_seq"])
    merged = rows.groupBy("scope", "cell_id").agg(F.min("fac_seq").alias("fac_seq"), F.sum("machines").alias("machines"))
    centres = cells.groupBy("scope", "cell_id").agg(F.first("lat").alias("lat"), F.first("lon").alias("lon"))
    merged = stored(merged.join(centres, ["scope", "cell_id"]), "snapped-facilities")
    moved = at.join(merged.select("scope", "cell_id", F.col("fac_seq").alias("new_seq")), ["scope", "cell_id"]).select("scope", "fac_seq", "new_seq")
    return Snapped(merged.select("scope", "fac_seq", "cell_id", "lat", "lon", "machines"), moved)


def merged_minutes(minutes: DataFrame, moved: DataFrame) -> DataFrame:
    """Travel times (scope, cell_id, fac_seq, minutes) to merged facilities: the least of their parts."""
    rows = minutes.join(moved, ["scope", "fac_seq"])
    return rows.groupBy("scope", "cell_id", F.col("new_seq").alias("fac_seq")).agg(F.min("minutes").alias("minutes"))


def snap_target(spots: DataFrame, facilities: DataFrame, snap_km: float, minutes: DataFrame | Travel | None = None, snap_min: float = 0.0, distance: Distance = lambert_km, all_pairs: int = ALL_PAIRS) -> DataFrame:
    """scope, cell_id, fac_seq, km: the nearest facility of each spot that is within ``snap_km``
    or ``snap_min`` of ``minutes`` (scope, cell_id, fac_seq, minutes); spots without any have no row.

    A spot whose nearest facility is within ``snap_km`` has that one, whatever the minutes. For
    the others ``minutes`` is a table, or a function that is asked for the pairs that matter:
    those of twice the radius each time, for spots that have found none nearer, and all that are
    left, however far, once they are at most ``all_pairs``."""
    near = nearest(spots, facilities, distance).where(F.col("nearest_km") <= snap_km)
    found = stored(near.select(*KEY, F.struct(F.col("nearest_km").alias("km"), "fac_seq").alias("b")), "snapped-near")
    parts, left = [found], spots.select(*KEY, "lat", "lon")
    best = F.min(F.struct("km", "fac_seq")).alias("b")
    if isinstance(minutes, DataFrame):
        reached = with_scope(minutes, facilities).where(F.col("minutes") <= snap_min).select(*KEY, "fac_seq").distinct()
        by_time = with_km(left.join(found, KEY, "left_anti").join(reached, KEY).join(named(facilities), ["scope", "fac_seq"]), distance)
        parts.append(by_time.groupBy(*KEY).agg(best))
    elif minutes is not None:
        places = facilities.select("scope", "fac_seq", "lat", "lon")
        sizes, radius = places.groupBy("scope").agg(F.count("*").alias("n")), max(snap_km, 1.0)
        while radius < math.inf:
            left = stored(left.join(found, KEY, "left_anti"), "snap-left")
            pairs = left.join(sizes, "scope").agg(F.sum("n")).first()[0]
            if not pairs:
                break
            radius = math.inf if pairs <= all_pairs or radius > FAR_KM else 2 * radius
            met = minutes(pairs_within(left, places, radius, distance, hint="merge")).where(F.col("minutes") <= snap_min)
            found = stored(met.groupBy(*KEY).agg(best), "snapped-by-time")
            parts.append(found)
    return reduce(DataFrame.union, parts).select(*KEY, "b.fac_seq", "b.km")
