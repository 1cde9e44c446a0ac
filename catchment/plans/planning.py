"""Placement planning: add capacity step by step where it is missed most."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from catchment.functions.geo import decay, lambert_km, ring
from catchment.operators.access import KEY, Distance, named, with_km, with_scope
from catchment.operators.allocation import ring_parts
from catchment.operators.cells import Travel, merged_minutes, snapped_facilities
from catchment.operators.model import CAPACITY, PAIR, assembled, dealt, prepared, served_demand
from catchment.operators.summary import stop_tests
from catchment.sources.sinks import stored


def best_cells(result: DataFrame, score: Column | None = None) -> DataFrame:
    """The cell of each scope with the highest score (default: unmet demand), the first on ties."""
    row = F.struct((F.col("untreated") if score is None else score).alias("score"), (-F.col("cell_id")).alias("o"), "lat", "lon")
    return result.groupBy("scope").agg(F.max(row).alias("b")).select("scope", "b.score", (-F.col("b.o")).alias("cell_id"), "b.lat", "b.lon")


#: What a step's cell is chosen by: unmet demand, or how far how many people are from a facility.
SCORES = {"unmet": "untreated", "distance": "coalesce(nearest_km, 0.0) * greatest(population, 0.0)"}


def unfinished(result: DataFrame, stop: dict[str, float]) -> DataFrame:
    """scope of those that none of the rules ``stop`` ends: most_unmet or farthest_km below a
    value, served at or above one. A scope without any distance isn't ended by farthest_km."""
    done = F.lit(False)
    for name, value in stop.items():
        done = done | F.coalesce(F.col(name) >= value if name == "served" else F.col(name) < value, F.lit(False))
    return stop_tests(result).where(~done).select("scope")


class Plan(NamedTuple):
    """``steps`` (scope, step, cell_id, fac_seq, score, treated, gain), ``facilities`` after the
    last step, and ``result``, what compute_access would give for them."""

    steps: DataFrame
    facilities: DataFrame
    result: DataFrame


STATE = [*KEY, "spot", "lat", "lon", "population", "demand", "miss", "treated", "untreated", "nearest_km"]


def close_facility(spots: DataFrame, facilities: DataFrame, snap_km: float, minutes: DataFrame | Travel | None, snap_min: float, distance: Distance) -> DataFrame:
    """scope, snap: the nearest facility to the one spot of each scope, if it is near enough. A
    function is asked for the minutes of these pairs alone."""
    rows = with_km(spots.select(*KEY, "lat", "lon").join(named(facilities), "scope"), distance)
    near = F.col("km") <= snap_km
    if minutes is not None:
        some = minutes.join(spots.select(*KEY), KEY, "left_semi") if isinstance(minutes, DataFrame) else minutes(rows)
        times = some.where(F.col("minutes") <= snap_min).select(*KEY, "fac_seq", F.lit(True).alias("quick")).distinct()
        rows, near = rows.join(times, [*KEY, "fac_seq"], "left"), near | F.col("quick").isNotNull()
    return rows.where(near).groupBy("scope").agg(F.min(F.struct("km", "fac_seq")).alias("b")).select("scope", F.col("b.fac_seq").alias("snap"))


def appended(state: DataFrame, new: DataFrame, capacity: float, resolution: int, distance: Distance, **model: object) -> DataFrame:
    """``state`` of the scopes of ``new`` (one facility a scope, after all others: scope, fac_seq,
    lat, lon, machines) with what it changes, and its km, p, ring and fac_seq.

    What earlier facilities serve stays, so one pass over the cells is enough: the new one
    serves its rings of the demand that is left."""
    rows = with_km(state.join(named(new), "scope"), distance)
    rows = rows.withColumns({"p": decay(F.col("km"), **model), "ring": ring(F.col("km"), resolution), "capacity": F.col("machines") * capacity})
    parts = ring_parts(rows.where("p > 0 and capacity > 0").select("scope", "fac_seq", "ring", "p", "capacity", F.col("untreated").alias("demand")))
    rows = rows.join(parts, ["scope", "fac_seq", "ring"], "left").withColumn("got", F.coalesce(F.col("untreated") * F.col("p") * F.col("part"), F.lit(0.0)))
    rows = rows.withColumn("treated", F.least(F.col("treated") + F.col("got"), F.col("demand")))
    changes = {"untreated": F.col("demand") - F.col("treated"), "miss": F.col("miss") * F.greatest(1 - F.col("p"), F.lit(0.0)), "nearest_km": F.least("nearest_km", "km")}
    return rows.withColumns(changes).select(*STATE, "fac_seq", "km", "p", "ring")


def plan(
    cells: DataFrame, facilities: DataFrame, steps: int, machines: float, snap_km: float, score: str = "unmet", least: float | None = None,
    stop: dict[str, float] | None = None, minutes: DataFrame | Travel | None = None, snap_min: float = 0.0, capacity: float = CAPACITY, **options: object,
) -> Plan:
    """Add ``machines`` step by step at the best cell by ``score`` (see SCORES) of each scope: to
    the nearest facility within ``snap_km`` or, by ``minutes`` (scope, cell_id, fac_seq, minutes, or
    a function that adds minutes to pairs; either knows the given facilities alone), within
    ``snap_min``, else as a new one after all others.

    A scope ends after ``steps``, when a rule of ``stop`` holds (see unfinished), or when no
    score reaches ``least`` (unmet: 1, distance: 0). Between steps each cell keeps what is
    treated, the product of misses and the nearest distance. A new facility is a pass over its
    scope's cells; only where one grew, its scope is allocated anew, from the stored pairs. The
    driver holds no rows. ``options`` are those of the model, by distance; with ``snap``
    facilities start at the centres of their cells, and one that would share a cell merges."""
    distance, resolution = options.get("distance", lambert_km), options.get("resolution", 8)
    decay_by = {k: v for k, v in options.items() if k in ("model", "scale", "shape", "cutoff", "reach")}
    decay_by.setdefault("model", "exponential")
    least = least if least is not None else 1.0 if score == "unmet" else 0.0
    minutes = with_scope(minutes, facilities) if isinstance(minutes, DataFrame) else minutes
    if options.pop("snap", False):
        if minutes is not None and not isinstance(minutes, DataFrame):
            raise ValueError("merged facilities have the least minutes of their parts: give a table")
        facilities, moved = snapped_facilities(facilities, cells, distance)
        minutes = minutes if minutes is None else merged_minutes(minutes, moved)
    inputs = prepared(cells, facilities, **options)
    if minutes is not None and not isinstance(minutes, DataFrame):
        travel, given = minutes, inputs.facilities.select("scope", "fac_seq")
        minutes = lambda pairs: travel(pairs.join(given, ["scope", "fac_seq"], "left_semi"))
    now, pairs = inputs.facilities, inputs.pairs
    result = assembled(inputs, served_demand(pairs, now, capacity), distance).withColumn("miss", 1 - F.col("access"))
    state, ended = stored(result.select(*STATE), "plan-state"), []
    base = state.groupBy("scope").agg(F.sum("treated").alias("treated"))
    out = base.select("scope", F.lit(0).alias("step"), F.lit(None).cast("long").alias("cell_id"), F.lit(None).cast("long").alias("fac_seq"), F.lit(None).cast("double").alias("score"), "treated")
    for step in range(1, steps + 1):
        best = best_cells(state, F.expr(SCORES[score])).where(F.col("score") >= least)
        best = stored(best.join(unfinished(state, stop or {}), "scope", "left_semi"), "plan-best")
        ended.append(state.join(best, "scope", "left_anti"))
        state = state.join(best, "scope", "left_semi")
        if best.isEmpty():
            break
        last = now.groupBy("scope").agg(F.max("fac_seq").alias("last"))
        chosen = best.join(close_facility(best, now, snap_km, minutes, snap_min, distance), "scope", "left").join(last, "scope", "left")
        chosen = stored(chosen.select(*KEY, "score", "lat", "lon", "snap", F.coalesce("snap", F.coalesce("last", F.lit(0)) + 1).alias("fac_seq")), "plan-chosen")
        new = chosen.where("snap is null").select("scope", "fac_seq", "lat", "lon", F.lit(machines).alias("machines"))
        more = chosen.where("snap is not null").select("scope", "fac_seq", F.lit(machines).alias("more"))
        grown = now.join(more, ["scope", "fac_seq"], "left").withColumn("machines", F.col("machines") + F.coalesce("more", F.lit(0.0)))
        now = stored(grown.select("scope", "fac_seq", "lat", "lon", "machines", "site").union(new.withColumn("site", F.col("fac_seq"))), "plan-facilities")
        after = stored(appended(state, new, capacity, resolution, distance, **decay_by), "plan-appended")
        met = after.where("p > 0").groupBy("scope", F.col("spot").alias("cell_id"), F.col("fac_seq").alias("site"), "km", "p", "ring").agg(F.sum("demand").alias("demand"))
        pairs = pairs.union(met.withColumn("n", F.lit(1).cast("long")).select(*PAIR))
        state = state.join(more, "scope", "left_semi")
        after = after.select(*STATE)
        if not more.isEmpty():
            treated = served_demand(pairs.join(more, "scope", "left_semi"), now.join(more, "scope", "left_semi"), capacity)
            again = dealt(state.drop("treated", "untreated"), inputs.spots, treated)
            after = after.union(again.select(*STATE))
        state = stored(after, "plan-state")
        sums = state.groupBy("scope").agg(F.sum("treated").alias("treated"))
        out = out.union(sums.join(chosen, "scope").select("scope", F.lit(step).alias("step"), "cell_id", "fac_seq", "score", "treated"))
    for rows in ended:
        state = state.union(rows)
    served = F.when(F.col("demand") > 0, F.col("treated") / F.col("demand")).otherwise(0.0)
    state = state.withColumns({"access": 1 - F.col("miss"), "served": served}).withColumn("with_access", F.col("access") * F.col("population")).drop("miss", "spot")
    return Plan(with_gain(out), now.drop("site"), state)


def with_gain(steps: DataFrame) -> DataFrame:
    """``steps`` (scope, step, treated) with gain, what each adds to the one before."""
    return steps.withColumn("gain", F.col("treated") - F.lag("treated").over(Window.partitionBy("scope").orderBy("step")))


def place(cells: DataFrame, facilities: DataFrame, steps: int, machines: float, snap_km: float, score: str = "unmet", **options: object) -> DataFrame:
    """The steps of a plan: scope, step, cell_id, fac_seq, score, treated, gain."""
    return plan(cells, facilities, steps, machines, snap_km, score, **options).steps
