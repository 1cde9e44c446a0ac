"""Capacity allocation: facilities in order, each serving rings outward.

Only the order inside a scope matters, so scopes are independent. There are two plans with
the same result. Grouped: a scope is a task, its state one number a cell, its pairs streamed
in facility order. Waves, for scopes whose pairs would be too many for a task: a facility's wave
is one more than the last wave of any earlier facility that shares a cell with it, so
facilities of a wave don't compete and serve in one step of joins and sums, whatever their
scope. Waves are numbered first, from the order of facilities in each cell; each wave then reads
its own pairs and the demand that earlier waves left for them, and passes on what it leaves to
the wave of each cell's next facility. Every pair is written and read once more, however many
waves there are."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from catchment.sources.sinks import new_path, stored

SCHEMA = "cell_id long, treated double"
#: Pairs of a scope up to which it is one task.
TASK_PAIRS = 5_000_000


def allocate_scope(pairs: pd.DataFrame, able: pd.DataFrame | None = None) -> pd.DataFrame:
    """Treated demand of each cell of one scope. Columns: cell_id, fac_seq, ring, p, capacity, demand;
    or, with ``able`` (site, fac_seq, capacity): cell_id, site, ring, p, demand, where the pairs of a
    site are those of each of its facilities."""
    if able is None:
        able = pairs[["fac_seq", "capacity"]].drop_duplicates("fac_seq").assign(site=lambda f: f["fac_seq"])
        pairs = pairs.rename(columns={"fac_seq": "site"})
    cells, cell = np.unique(pairs["cell_id"].to_numpy(), return_inverse=True)
    left = np.zeros(len(cells))
    left[cell] = pairs["demand"].to_numpy()
    start = left.copy()
    order = np.lexsort((pairs["ring"].to_numpy(), pairs["site"].to_numpy()))
    site, ring, p = (pairs[c].to_numpy()[order] for c in ("site", "ring", "p"))
    cell = cell[order]
    able = able[able["capacity"] > 0].sort_values("fac_seq")
    firsts, lasts = (np.searchsorted(site, able["site"].to_numpy(), side) for side in ("left", "right"))
    for first, last, cap in zip(firsts, lasts, able["capacity"].to_numpy(), strict=True):
        if first == last:
            continue
        rows = cell[first:last]
        offered = left[rows] * p[first:last]
        edge = np.flatnonzero(np.concatenate([[True], np.diff(ring[first:last]) != 0]))
        total = np.add.reduceat(offered, edge)
        before = np.cumsum(total) - total
        served = np.divide(np.clip(cap - before, 0, total), total, out=np.zeros_like(total), where=total > 0)
        left[rows] -= offered * np.repeat(served, np.diff(np.append(edge, len(rows))))
    return pd.DataFrame({"cell_id": cells, "treated": np.minimum(start - left, start)})


def allocate(pairs: DataFrame, task_pairs: int = TASK_PAIRS) -> DataFrame:
    """scope, cell_id, treated from (scope, cell_id, fac_seq, ring, p, capacity, demand) with p > 0,
    which should be a stored table: it is read more than once.

    Facilities without capacity serve nobody; cells out of all ranges have no row. Scopes of
    more than ``task_pairs`` pairs go by waves."""
    pairs = pairs.select("scope", "cell_id", "fac_seq", "ring", "p", "capacity", "demand")
    kind, large = pairs.schema["scope"].dataType.simpleString(), large_scopes(pairs, task_pairs)
    if large is None:
        return pairs.groupBy("scope").applyInPandas(with_scope, f"scope {kind}, {SCHEMA}")
    grouped = pairs.join(large, "scope", "left_anti").groupBy("scope").applyInPandas(with_scope, f"scope {kind}, {SCHEMA}")
    return grouped.union(allocate_by_waves(pairs.join(large, "scope", "left_semi")))


def allocate_at_sites(pairs: DataFrame, able: DataFrame, task_pairs: int = TASK_PAIRS) -> DataFrame:
    """``allocate`` from pairs of places (scope, cell_id, site, ring, p, demand; stored) and the
    facilities ``able`` (scope, site, fac_seq, capacity) to serve. A pair of places is held once,
    whatever the number of facilities at the site."""
    pairs = pairs.select("scope", "cell_id", "site", "ring", "p", "demand")
    kind, large = pairs.schema["scope"].dataType.simpleString(), large_scopes(pairs, task_pairs)
    some = pairs if large is None else pairs.join(large, "scope", "left_anti")
    grouped = some.groupBy("scope").cogroup(able.groupBy("scope")).applyInPandas(at_sites_with_scope, f"scope {kind}, {SCHEMA}")
    return grouped if large is None else grouped.union(allocate_by_waves(pairs.join(large, "scope", "left_semi").join(able, ["scope", "site"]).drop("site")))


def large_scopes(pairs: DataFrame, task_pairs: int) -> DataFrame | None:
    """scope of those that have more than ``task_pairs`` pairs; None if there are none."""
    large = pairs.groupBy("scope").agg(F.count("*").alias("n")).where(F.col("n") > task_pairs).select("scope")
    return None if large.isEmpty() else stored(large, "large-scopes")


def with_scope(pairs: pd.DataFrame) -> pd.DataFrame:
    return at_sites_with_scope(pairs, None)


def at_sites_with_scope(pairs: pd.DataFrame, able: pd.DataFrame | None) -> pd.DataFrame:
    out = allocate_scope(pairs, able)
    out.insert(0, "scope", pairs["scope"].iloc[0] if len(pairs) else None)
    return out


def wave_numbers(chains: DataFrame) -> DataFrame:
    """scope, fac_seq, wave (from 0) of ``chains`` (scope, fac_seq, next: the facility after it in
    some cell, or null).

    A facility's wave is the length of the longest chain of facilities before it. The facility
    after in a cell is enough: what lies further on in the cell comes after that one. Each round
    numbers the facilities of whose predecessors none is left and strikes them out; it reads
    links between facilities, not pairs."""
    links = stored(chains.where("next is not null").select("scope", "fac_seq", "next").distinct(), "wave-links")
    waits = links.groupBy("scope", F.col("next").alias("fac_seq")).agg(F.count("*").alias("waits"))
    rest = stored(chains.select("scope", "fac_seq").distinct().join(waits, ["scope", "fac_seq"], "left").fillna(0, ["waits"]), "wave-rest")
    out, number = None, 0
    while True:
        ready = stored(rest.where("waits = 0").select("scope", "fac_seq", F.lit(number).alias("wave")), "wave-ready")
        out = ready if out is None else out.union(ready)
        struck = links.join(ready, ["scope", "fac_seq"], "left_semi").groupBy("scope", F.col("next").alias("fac_seq")).agg(F.count("*").alias("struck"))
        rest = rest.where("waits > 0").join(struck, ["scope", "fac_seq"], "left")
        rest = stored(rest.select("scope", "fac_seq", (F.col("waits") - F.coalesce("struck", F.lit(0))).alias("waits")), "wave-rest")
        number += 1
        if rest.isEmpty():
            return stored(out, "wave-numbers")


def allocate_by_waves(pairs: DataFrame) -> DataFrame:
    """``allocate`` in DataFrame operations alone, a step for each wave."""
    key, spark = ["scope", "cell_id"], pairs.sparkSession
    chain = Window.partitionBy(*key).orderBy("fac_seq")
    able = pairs.where("capacity > 0").withColumn("next", F.lead("fac_seq").over(chain))
    able = stored(able.select(*key, "fac_seq", "next", "ring", "p", "capacity", "demand"), "wave-chains")
    if able.isEmpty():
        return pairs.select(*key, F.lit(0.0).alias("treated")).distinct()
    waves = wave_numbers(able)
    then = waves.select("scope", F.col("fac_seq").alias("next"), F.col("wave").alias("next_wave"))
    by_wave, inbox = new_path(spark, "wave-pairs"), new_path(spark, "wave-inbox")
    staged = able.join(waves, ["scope", "fac_seq"]).join(then, ["scope", "next"], "left").drop("next").fillna(-1, ["next_wave"])
    files = int(spark.conf.get("spark.sql.shuffle.partitions"))
    staged.repartition("wave", F.pmod(F.xxhash64(*key), F.lit(files))).write.partitionBy("wave").parquet(by_wave)
    shape = staged.drop("wave").schema
    kind = f"scope {shape['scope'].dataType.simpleString()}, cell_id long, left double"
    for number in range(waves.agg(F.max("wave")).first()[0] + 1):
        now = spark.read.schema(shape).parquet(f"{by_wave}/wave={number}")
        if number:
            come = spark.read.schema(kind).parquet(f"{inbox}/next_wave={number}")
            now = now.join(come, key, "left").withColumn("demand", F.coalesce("left", "demand")).drop("left")
        left = wave(now).select(*key, (F.col("demand") - F.col("served")).alias("left"), "next_wave")
        left.write.mode("append").partitionBy("next_wave").parquet(inbox)
    end = spark.read.schema(kind).parquet(f"{inbox}/next_wave=-1")  # one row a cell
    start = pairs.groupBy(*key).agg(F.max("demand").alias("demand"))
    return start.join(end, key, "left").select(*key, F.least(F.col("demand") - F.coalesce("left", "demand"), F.col("demand")).alias("treated"))


def ring_parts(pairs: DataFrame) -> DataFrame:
    """scope, fac_seq, ring, part: what share of a ring's offered demand a facility serves."""
    sums = pairs.groupBy("scope", "fac_seq", "ring").agg(F.sum(F.col("demand") * F.col("p")).alias("total"), F.max("capacity").alias("cap"))
    order = Window.partitionBy("scope", "fac_seq").orderBy("ring")  # a facility's rings: as many as its range is wide
    before = F.coalesce(F.sum("total").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    part = F.when(F.col("total") > 0, F.least(F.lit(1.0), F.greatest(F.col("cap") - before, F.lit(0.0)) / F.col("total"))).otherwise(0.0)
    return sums.select("scope", "fac_seq", "ring", part.alias("part"))


def wave(pairs: DataFrame) -> DataFrame:
    """``pairs`` (scope, fac_seq, cell_id, ring, p, capacity, demand) with served, of facilities
    that don't compete: each cell has one facility."""
    rows = pairs.join(ring_parts(pairs), ["scope", "fac_seq", "ring"])
    return rows.withColumn("served", F.col("demand") * F.col("p") * F.col("part")).drop("part")
