"""Hand-made rows and invariants of the access model."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from catchment import queries
from catchment.functions import geo, text
from catchment.operators import access, allocation, cells, demand, model, quality, summary
from catchment.plans import planning
from catchment.sources import readers, sinks


def values(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.select(*names).collect())


def test_distances(spark):
    row = spark.range(1).select(
        geo.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)).alias("h"), geo.lambert_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)).alias("l"),
        geo.lambert_km(F.lit(5.0), F.lit(6.0), F.lit(5.0), F.lit(6.0)).alias("z"),
    ).first()
    assert abs(row["h"] - 6371.0088 * math.pi / 180) < 1e-9 and abs(row["l"] - 111.3195) < 0.01 and row["z"] == 0


def test_hexagon_ids(spark):
    row = spark.sql("select '8928308280fffff' h").select(geo.h3_number(F.col("h")).alias("n"))
    row = row.select(geo.h3_resolution(F.col("n")).alias("r"), F.lower(F.hex(geo.h3_parent(F.col("n"), 7))).alias("p"), geo.h3_parent(F.col("n"), 12).alias("none")).first()
    assert tuple(row) == (9, "872830828ffffff", None)


def test_decay_edges(spark):
    d = spark.createDataFrame([(50.0,), (50.1,), (None,)], "d double")
    out = [tuple(r) for r in d.select(geo.decay(F.col("d"), "step", reach=50.0), geo.decay(F.col("d"), "uniform"), geo.decay(F.col("d"), "exponential", 5.0)).collect()]
    assert [r[0] for r in out] == [1, 0, 0] and [r[1] for r in out] == [1, 1, 1]
    assert out[0][2] == pytest.approx(math.exp(-10)) and out[1][2] == 0 and out[2][2] == 0


def test_awkward_utilisation_lines(spark):
    lines = spark.createDataFrame([("Lip, oral cavity, 0.2 ",), ("Pancreas ,0.57 ",), ("Liver, 0 ",), ("broken",), ("x, y",), (None,)], "value string")
    assert values(readers.utilisation(lines), "site", "fraction") == [("Lip, oral cavity", 0.2), ("Liver", 0.0), ("Pancreas", 0.57)]


def test_facility_layouts(spark):
    rows = spark.createDataFrame([("A", "90, 180", "2"), ("B", "91, 0", "1"), ("C", "1,2", None), ("D", "1,2", "0"), ("E", None, "1")], "Institution string, Coordinates string, Count string")
    assert values(readers.facility_sheet(rows), "name", "machines") == [("A", 2.0), ("C", 1.0)]
    with pytest.raises(ValueError):
        readers.facility_sheet(rows.select("Institution"))


def test_population_aliases_and_nulls(spark):
    rows = spark.createDataFrame([("a", None), ("b", float("nan")), ("c", -3.0), ("d", 2.0)], "h3 string, Value double")
    assert values(readers.population(rows), "h3", "population") == [("a", 0.0), ("b", 0.0), ("c", 0.0), ("d", 2.0)]


def test_range_join_equals_all_pairs(spark):
    rng = np.random.default_rng(3)
    place = lambda n: [(int(i), 1, float(a), float(o)) for i, a, o in zip(range(n), np.r_[rng.uniform(-90, 90, n - 4), 89.9, -89.9, 0, 0], np.r_[rng.uniform(-180, 180, n - 4), 0, 170, 179.99, -179.99], strict=True)]
    cells = spark.createDataFrame(place(80), "cell_id long, scope int, lat double, lon double")
    fac = spark.createDataFrame(place(60), "fac_seq long, scope int, lat double, lon double")
    for radius in (40.0, 900.0, 9000.0):
        full = access.with_km(cells.join(access.named(fac), "scope"), geo.haversine_km).where(F.col("km") <= radius)
        assert values(access.pairs_within(cells, fac, radius, geo.haversine_km), "cell_id", "fac_seq") == values(full, "cell_id", "fac_seq")
    half = access.pairs_within(cells, fac, 9000.0, geo.haversine_km, cube_cells=3)  # nearly every cube splits
    assert values(half, "cell_id", "fac_seq") == values(full, "cell_id", "fac_seq")
    full = access.with_km(cells.join(access.named(fac), "scope")).groupBy("cell_id").agg(F.min("km").alias("nearest_km"))
    for leaf in (64, 5):
        assert values(access.nearest(cells, fac, leaf=leaf), "cell_id", "nearest_km") == values(full, "cell_id", "nearest_km")


def serial(pairs):
    left, start = {}, {}
    for r in pairs.itertuples():
        left[r.cell_id] = start[r.cell_id] = r.demand
    for _, f in pairs.groupby("fac_seq", sort=True):
        cap = f.capacity.iloc[0]
        for _, g in f.groupby("ring", sort=True):
            offered = {r.cell_id: left[r.cell_id] * r.p for r in g.itertuples()}
            total = sum(offered.values())
            part = min(1.0, max(cap, 0) / total) if total > 0 else 0
            for c, o in offered.items():
                left[c] -= o * part
            cap -= total * part
    return {c: start[c] - left[c] for c in left}


def test_allocation_equals_the_serial_loop():
    rng = np.random.default_rng(5)
    d = rng.uniform(0, 10, 30)
    rows = [(c, f, int(rng.integers(0, 4)), float(rng.choice([1.0, 0.4])), float(f * 7 % 40), d[c]) for f in range(12) for c in range(30) if rng.random() < 0.5]
    pairs = pd.DataFrame(rows, columns=["cell_id", "fac_seq", "ring", "p", "capacity", "demand"]).sample(frac=1, random_state=1)
    got = dict(allocation.allocate_scope(pairs).itertuples(index=False))
    want = serial(pairs)
    assert got.keys() == want.keys() and all(abs(got[c] - want[c]) < 1e-9 for c in want)
    assert sum(got.values()) <= sum(pairs.groupby("fac_seq").capacity.first()) + 1e-9


def test_facility_without_capacity_counts_for_access_only(spark):
    cells = spark.createDataFrame([(1, 1, 0.0, 0.0, 10.0, 5.0), (2, 2, 0.0, 0.0, 10.0, 5.0)], "cell_id long, scope int, lat double, lon double, population double, demand double")
    fac = spark.createDataFrame([(1, 1, 0.0, 0.1, 0.0)], "fac_seq long, scope int, lat double, lon double, machines double")
    out = model.compute_access(cells, fac, "step", reach=50.0)
    assert values(out, "cell_id", "access", "treated") == [(1, 1.0, 0.0), (2, 0.0, 0.0)]
    assert out.where("cell_id = 2").first()["nearest_km"] is None
    stats = model.statistics(out, fac).where("scope = 2").first()
    assert stats["facilities"] == 0 and stats["served"] == 0


def test_demand_keeps_totals(spark):
    cells = spark.createDataFrame([(1, 1, 3.0), (2, 1, 1.0), (3, 2, 0.0), (4, 3, 5.0)], "cell_id long, scope int, population double")
    national = spark.createDataFrame([(1, 8.0), (2, 4.0)], "scope int, demand double")
    assert values(demand.cell_demand(cells, national), "cell_id", "demand") == [(1, 6.0), (2, 2.0), (3, 0.0), (4, 0.0)]


def test_weighted_median_and_bands(spark):
    rows = spark.createDataFrame([(1, 1.0, 1.0), (1, 2.0, 1.0), (1, 3.0, 5.0), (1, None, 9.0)], "scope int, d double, w double")
    assert values(summary.weighted_median(rows, "d", "w"), "scope", "median") == [(1, 3.0)]
    assert [r[0] for r in rows.select(summary.band(F.col("d"), 1.0, 3)).collect()] == [1, 2, 2, None]


def test_text_functions(spark):
    row = spark.sql("select 'Lip, Oral-Cavity 2' s, date'2024-05-01' d, 1234567.0D x").select(text.site_key(F.col("s")), text.next_wednesday(F.col("d")).cast("string"), text.human(F.col("x"))).first()
    assert tuple(row) == ("liporalcavity2", "2024-05-08 08:00:00", "1.2 M")
    assert [r[0] for r in spark.createDataFrame([(None,), (0.0,), (7.0,), (-3400.0,)], "x double").select(text.human(F.col("x"))).collect()] == ["N/A", "0", "7.0", "-3.4 k"]


def test_border_cells_and_patch(spark):
    rows = spark.createDataFrame([("a", 1, 0.5), ("a", 2, 0.5), ("b", 1, 0.1), ("b", 2, 0.9)], "h3 string, scope int, access double")
    assert values(model.best_of_border(rows, "h3"), "h3", "scope") == [("a", 1), ("b", 2)]
    raw = spark.createDataFrame([(1, None, None), (2, 5.0, 5.0)], "row int, lat double, lon double")
    patch = spark.createDataFrame([(1, 7.0, 8.0)], "row int, new_lat double, new_lon double")
    assert values(quality.patched(raw, patch), "row", "lat") == [(1, 7.0), (2, 5.0)]


def test_cases_for_sites_that_are_missing_or_not_finite(spark):
    cases = spark.createDataFrame([(1, "a", 2.0), (1, "b", float("nan")), (2, "a", float("inf")), (2, "b", None)], "scope int, site string, cases double")
    wanted = spark.createDataFrame([(s, k) for s in (1, 2, 3) for k in ("a", "b")], "scope int, site string")
    assert values(demand.cases_for(cases, wanted), "scope", "site", "cases") == [(1, "a", 2.0), (1, "b", 0.0), (2, "a", 0.0), (2, "b", 0.0), (3, "a", 0.0), (3, "b", 0.0)]


def test_snapping(spark):
    spots = spark.createDataFrame([(1, 1, 0.0, 0.0), (2, 1, 0.0, 5.0), (3, 1, 40.0, 0.0)], "cell_id long, scope int, lat double, lon double")
    fac = spark.createDataFrame([(7, 1, 0.0, 0.2, 1.0), (8, 1, 0.0, 3.0, 1.0)], "fac_seq long, scope int, lat double, lon double, machines double")
    assert values(cells.snapped(fac, spots), "fac_seq", "cell_id") == [(7, 1), (8, 2)]
    minutes = spark.createDataFrame([(1, 8, 5.0), (2, 8, 20.0), (3, 8, 90.0)], "cell_id long, fac_seq long, minutes double")
    assert values(cells.snap_target(spots, fac, 50.0, minutes, 30.0), "cell_id", "fac_seq") == [(1, 7), (2, 8)]
    new = spark.createDataFrame([(1, 0.00005, 0.2), (1, 0.0002, 0.2), (2, 0.0, 0.2)], "scope int, lat double, lon double")
    assert values(quality.not_near(new, fac), "scope", "lat") == [(1, 0.0002), (2, 0.0)]


def plain_km(a, b, c, d):
    a, b, c, d = map(math.radians, (a, b, c, d))
    return 2 * geo.EARTH_KM * math.asin(math.sqrt(min(1.0, math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2)))


def test_snap_target_has_travel_times_at_any_distance(spark, tmp_path):
    """J15: a facility that minutes reach counts however far it is; its table once ended at 400 km."""
    people, fac = [(c, c % 3, 1.0) for c in range(600)], [(s, s % 2) for s in range(9)]
    spark.createDataFrame(people, "c_custkey long, c_nationkey int, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame(fac, "s_suppkey long, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    want = {}
    for c, scope, _ in people:
        for s, of in fac:
            at = [-40 + 10 * scope + ((c * 37) % 601 - 300) / 100, -150 + 12 * scope + ((c * 91) % 601 - 300) / 100]
            km = plain_km(*at, -40 + 10 * scope + ((s * 53) % 401 - 200) / 100, -150 + 12 * scope + ((s * 17) % 401 - 200) / 100)
            if of == scope and (km <= 60 or (c + s) % 3 and 20 + (c * 7 + s * 13) % 100 <= 40):
                want[c] = min(want.get(c, (math.inf, 0)), (km, s))
    got = {r["cell_id"]: (r["km"], r["fac_seq"]) for r in queries.QUERIES["J15_snap_target"](spark, str(tmp_path)).collect()}
    assert max(want.values())[0] > 400 and {c: s for c, (_, s) in got.items()} == {c: s for c, (_, s) in want.items()}
    assert all(abs(got[c][0] - want[c][0]) < 1e-3 for c in want)


@pytest.mark.parametrize("all_pairs", [0, 2_000, 20_000_000])
def test_snapping_by_a_function_equals_all_pairs(spark, all_pairs):
    rng = np.random.default_rng(8)
    place = lambda n, scopes: [(i, int(rng.integers(scopes)), float(rng.uniform(-90, 90)), float(rng.uniform(-180, 180))) for i in range(n)]
    people, places = place(300, 4), place(60, 3)
    places += [(60 + f, *places[f][1:]) for f in range(5)]  # the same places again
    people.append((300, 0, *places[0][2:]))
    spots = spark.createDataFrame(people, "cell_id long, scope int, lat double, lon double")
    fac = spark.createDataFrame(places, "fac_seq long, scope int, lat double, lon double")
    asked = lambda pairs: pairs.withColumn("minutes", F.expr("if((cell_id + fac_seq) % 3 = 0 or cell_id % 10 = 1, null, double((cell_id * 7 + fac_seq * 13) % 50))"))
    want = {}
    for c, scope, a, b in people:
        for s, of, x, y in places:
            if of == scope and ((km := plain_km(a, b, x, y)) <= 300 or (c + s) % 3 and c % 10 != 1 and (c * 7 + s * 13) % 50 <= 5):
                want[c] = min(want.get(c, (math.inf, 0)), (round(km, 6), s))
    got = cells.snap_target(spots, fac, 300.0, asked, 5.0, geo.haversine_km, all_pairs)
    assert values(got, "cell_id", "fac_seq") == sorted((c, s) for c, (_, s) in want.items()) and 0 < len(want) < 250
    table = asked(spots.select("cell_id", "scope").join(fac.select("fac_seq", "scope"), "scope"))
    assert values(cells.snap_target(spots, fac, 300.0, table, 5.0, geo.haversine_km), "cell_id", "fac_seq") == values(got, "cell_id", "fac_seq")


def test_kept_tables_replace_only_their_partition(spark, tmp_path):
    path = f"file://{tmp_path}/kept"
    row = lambda v: spark.createDataFrame([(v,)], "v int")
    for mode, v in (("a", 1), ("b", 2), ("a", 3)):
        sinks.keep(row(v), path, mode=mode, res=4)
    assert values(sinks.kept(spark, path, mode="a", res=4), "v") == [(3,)]
    assert values(sinks.kept(spark, path, mode="b", res=4), "v") == [(2,)]
    assert values(sinks.kept(spark, path, mode="c"), "v") == []


def test_actual_fractions_take_the_country_from_the_file_name(spark, tmp_path):
    (tmp_path / "ABC.csv").write_text("Lip, oral cavity,0.2\nbroken\n")
    (tmp_path / "XYZ.csv").write_text("Liver, 0.5 \n")
    (tmp_path / "readme.txt").write_text("Liver,1\n")
    assert values(readers.actual_fractions(spark, str(tmp_path)), "iso3", "site_key", "fraction") == [("ABC", "liporalcavity", 0.2), ("XYZ", "liver", 0.5)]


def test_travel_cap(spark):
    rows = spark.createDataFrame([(8, 30000), (8, 60), (8, None), (4, 99999)], "r int, s int")
    assert [r[0] for r in rows.select(geo.travel_cap(F.col("r"), F.col("s"))).collect()] == [28800, 60, 28800, 36000]


def test_waves_equal_grouped_allocation(spark):
    """Both plans on chains of facilities that share cells, with full and soft decay."""
    import numpy as np

    rng = np.random.default_rng(2)
    rows = []
    for scope in range(3):
        for cell in range(40):
            for fac in rng.choice(12, 4, replace=False):
                rows.append((scope, 100 * scope + cell, int(fac), int(rng.integers(0, 4)), scope, float(fac % 5), float(cell % 7)))
    from pyspark.sql import functions as F

    from catchment.operators import allocation

    for soft in (False, True):
        p = F.exp(-F.col("ring") / 3.0) if soft else F.lit(1.0)
        pairs = spark.createDataFrame(rows, "scope int, cell_id long, fac_seq long, ring int, s int, capacity double, demand double").withColumn("p", p)
        one, two = (sorted(map(tuple, allocation.allocate(pairs, n).collect())) for n in (10**6, 0))
        by_waves = sorted(map(tuple, allocation.allocate_by_waves(pairs).collect()))
        assert [r[:2] for r in one] == [r[:2] for r in by_waves] == [r[:2] for r in two]
        assert all(abs(a[2] - b[2]) < 1e-9 for a, b in zip(one, by_waves, strict=True)) and sum(r[2] for r in one) > 0


def test_waves_pass_each_pair_on_once(spark):
    """What waves write grows with the pairs, not with pairs times waves."""
    from pathlib import Path

    rows = [(1, c, f, 0, 1.0, 5.0, 2.0) for f in range(12) for c in range(f, f + 8)]  # a chain of 12 waves
    pairs = spark.createDataFrame(rows, "scope int, cell_id long, fac_seq long, ring int, p double, capacity double, demand double")
    folder = Path(sinks.new_path(spark, "x").removeprefix("file://")).parent
    before = set(folder.glob("wave-*"))
    assert allocation.allocate_by_waves(pairs).agg(F.sum("treated")).first()[0] == pytest.approx(sum(allocation.allocate_scope(pairs.toPandas())["treated"]))
    count = lambda kind: sum(spark.read.parquet(f"file://{p}").count() for p in set(folder.glob(f"{kind}-*")) - before)
    assert count("wave-pairs") == count("wave-inbox") == len(rows)
    assert spark.read.parquet(*[f"file://{p}" for p in set(folder.glob("wave-pairs-*")) - before]).select("wave").distinct().count() == 12


def km_between(a, b):
    (p, q), (r, t) = (tuple(math.radians(x[k]) for k in ("lat", "lon")) for x in (a, b))
    return 2 * 6371.0088 * math.asin(math.sqrt(math.sin((r - p) / 2) ** 2 + math.cos(p) * math.cos(r) * math.sin((t - q) / 2) ** 2))


def plain_access(people, places, reach, capacity, resolution):
    """The model of one scope by step decay, cell after cell."""
    left = {c["cell_id"]: c["demand"] for c in people}
    km = {(c["cell_id"], f["fac_seq"]): km_between(c, f) for c in people for f in places}
    for f in sorted(places, key=lambda f: f["fac_seq"]):
        cap, rings = f["machines"] * capacity, {}
        for c in left:
            if km[c, f["fac_seq"]] <= reach:
                rings.setdefault(round(km[c, f["fac_seq"]] / (geo.EDGE_KM[resolution] * 3**0.5)), []).append(c)
        for r in sorted(rings):
            total = sum(left[c] for c in rings[r])
            part = min(1.0, max(cap, 0.0) / total) if total > 0 else 0.0
            for c in rings[r]:
                left[c] -= left[c] * part
            cap -= total * part
    return [c | {"untreated": left[c["cell_id"]], "treated": c["demand"] - left[c["cell_id"]], "nearest_km": min(km[c["cell_id"], f["fac_seq"]] for f in places)} for c in people]


def serial_plan(people, places, steps, machines, snap_km, score, stop, minutes, snap_min, options):
    """The plan of one scope after the other, the whole model anew at each step, in plain Python."""
    out = []
    for scope in sorted({c["scope"] for c in people}):
        own, fac = [c for c in people if c["scope"] == scope], [dict(f) for f in places if f["scope"] == scope]
        run = lambda: plain_access(own, fac, options["reach"], options["capacity"], options["resolution"])  # noqa: B023, E731
        now = run()
        out.append((scope, 0, None, None, round(sum(c["treated"] for c in now), 6)))
        for step in range(1, steps + 1):
            total = sum(c["demand"] for c in now)
            tests = {"most_unmet": max(c["untreated"] for c in now), "farthest_km": max(c["nearest_km"] for c in now), "served": sum(c["treated"] for c in now) / total}
            if any(tests[k] >= v if k == "served" else tests[k] < v for k, v in stop.items()):
                break
            worth = {c["cell_id"]: c["untreated"] if score == "unmet" else c["nearest_km"] * c["population"] for c in now}
            best = min(worth, key=lambda c: (-worth[c], c))
            if worth[best] < (1.0 if score == "unmet" else 0.0):
                break
            at = next(c for c in own if c["cell_id"] == best)
            close = [(km_between(at, f), f["fac_seq"]) for f in fac]
            close = [x for x in close if x[0] <= snap_km or minutes.get((best, x[1]), math.inf) <= snap_min]
            if close:
                seq = min(close)[1]
                next(f for f in fac if f["fac_seq"] == seq)["machines"] += machines
            else:
                seq = max(f["fac_seq"] for f in fac) + 1
                fac.append({"scope": scope, "fac_seq": seq, "lat": at["lat"], "lon": at["lon"], "machines": machines})
            now = run()
            out.append((scope, step, best, seq, round(sum(c["treated"] for c in now), 6)))
    return out


@pytest.mark.parametrize(("score", "stop"), [("unmet", {"served": 0.6, "most_unmet": 40.0}), ("distance", {"farthest_km": 60.0})])
def test_placement_equals_the_serial_loop(spark, score, stop):
    rng = np.random.default_rng(7)
    people = [{"cell_id": i, "scope": 1 + i % 2, "lat": float(a), "lon": float(b), "population": float(1000 + i), "demand": float(d)} for i, (a, b, d) in enumerate(zip(rng.uniform(0, 2, 24), rng.uniform(0, 2, 24), rng.uniform(5, 80, 24), strict=True))]
    places = [{"scope": 1 + i % 2, "fac_seq": i, "lat": 0.5 * i, "lon": 0.4, "machines": 1.0} for i in range(4)]
    minutes = {(c["cell_id"], f["fac_seq"]): 20.0 for c in people for f in places if c["scope"] == f["scope"] and c["cell_id"] % 3 == 0}
    options = {"model": "step", "reach": 50.0, "capacity": 60.0, "resolution": 4, "distance": geo.haversine_km}
    table = spark.createDataFrame([(*k, v) for k, v in minutes.items()], "cell_id long, fac_seq long, minutes double")
    plan = planning.place(spark.createDataFrame(pd.DataFrame(people)), spark.createDataFrame(pd.DataFrame(places)), 3, 2.0, 15.0, score, stop=stop, minutes=table, snap_min=25.0, **options)
    rows = sorted((r["scope"], r["step"], r["cell_id"], r["fac_seq"], round(r["treated"], 6)) for r in plan.collect())
    assert len(rows) > 2
    assert rows == serial_plan(people, places, 3, 2.0, 15.0, score, stop, minutes, 25.0, options)


def test_dense_cube_is_dealt_over_tasks(spark):
    """Half of all cells in one cube: no key of the join has more than cube_cells of them."""
    cells = spark.createDataFrame([(i, 1, 1e-5 * (i % 100), 0.0) if i % 2 else (i, 1, float(i % 80), float(i % 170)) for i in range(2000)], "cell_id long, scope int, lat double, lon double")
    fac = spark.createDataFrame([(i, 1, 0.01 * i, 0.0) for i in range(4)], "fac_seq long, scope int, lat double, lon double")
    rows = access.pairs_within(cells, fac, 100.0, geo.haversine_km, cube_cells=50)
    full = access.with_km(cells.join(access.named(fac), "scope"), geo.haversine_km).where("km <= 100")
    assert rows.count() == full.count() >= 4000 and rows.distinct().count() == rows.count()
    plain = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    for k, v in plain.items():
        spark.conf.set(k, v)
    try:
        sizes = [r["n"] for r in rows.groupBy(F.spark_partition_id().alias("task")).agg(F.count("*").alias("n")).collect()]
    finally:
        for k in plain:
            spark.conf.unset(k)
    assert max(sizes) < 0.7 * sum(sizes)


def test_nearest_of_ties_and_scopes(spark):
    cells = spark.createDataFrame([(1, 1, 0.0, 0.0), (1, 2, 0.0, 0.0), (2, 3, 0.0, 0.0), (3, 1, 0.0, None)], "cell_id long, scope int, lat double, lon double")
    fac = spark.createDataFrame([(9, 1, 0.0, 1.0), (8, 1, 0.0, -1.0), (7, 1, 0.0, 1.0), (5, 2, 0.0, 15.0), (6, 2, None, 1.0)], "fac_seq long, scope int, lat double, lon double")
    for leaf in (64, 2):
        got = access.nearest(cells, fac, geo.haversine_km, leaf)
        assert [(r["scope"], r["cell_id"], r["fac_seq"]) for r in got.orderBy("scope").collect()] == [(1, 1, 7), (2, 1, 5)]
    assert access.nearest(cells, fac.limit(0)).count() == 0


def shared_cell(spark):
    """Cell 1 is held by A, with a facility 11 km off, and by B, whose only one is 1,500 km off."""
    cells = spark.createDataFrame([(1, "A", 0.0, 0.0, 10.0, 5.0), (1, "B", 0.0, 0.0, 20.0, 7.0), (2, "B", 0.0, 13.4, 30.0, 9.0)], "cell_id long, scope string, lat double, lon double, population double, demand double")
    fac = spark.createDataFrame([(1, "A", 0.0, 0.1, 1.0), (1, "B", 0.0, 13.5, 1.0)], "fac_seq long, scope string, lat double, lon double, machines double")
    return cells, fac


def test_a_cell_of_two_scopes_meets_its_own_facilities(spark):
    cells, fac = shared_cell(spark)
    out = model.compute_access(cells, fac, "step", reach=50.0, capacity=4.0, distance=geo.haversine_km)
    got = {(r["scope"], r["cell_id"]): r for r in out.collect()}
    assert [(k, got[k]["access"], got[k]["treated"]) for k in sorted(got)] == [(("A", 1), 1.0, 4.0), (("B", 1), 0.0, 0.0), (("B", 2), 1.0, 4.0)]
    assert [round(got[k]["nearest_km"]) for k in sorted(got)] == [11, 1501, 11]
    minutes = spark.createDataFrame([("A", 1, 1, 10.0), ("B", 2, 1, 20.0)], "scope string, cell_id long, fac_seq long, minutes double")
    out = model.compute_access(cells, fac, "step", reach=30.0, capacity=4.0, distance=geo.haversine_km, minutes=minutes)
    assert values(out.where("access > 0"), "scope", "cell_id", "nearest_min") == [("A", 1, 10.0), ("B", 2, 20.0)]
    stats = {r["scope"]: r for r in model.statistics(out, fac).collect()}
    assert (stats["A"]["with_access"], stats["B"]["with_access"], stats["B"]["cells"]) == (10.0, 30.0, 2)
    regions = spark.createDataFrame([("A", "x"), ("B", "x")], "scope string, region string")
    total = model.region_statistics(out, model.statistics(out, fac), regions).first()
    assert (total["population"], total["demand"], total["with_access"]) == (40.0, 21.0, 40.0)  # demand is summed before border cells are told apart
    plan = planning.plan(cells, fac, 1, 1.0, 0.0, model="step", reach=50.0, capacity=4.0, distance=geo.haversine_km)
    assert values(plan.steps.where("step = 1"), "scope", "cell_id", "fac_seq", "treated") == [("A", 1, 2, 5.0), ("B", 1, 2, 8.0)]


def test_snapped_facilities_are_one_with_their_minutes(spark):
    cells = spark.createDataFrame([(c, 1, 0.0, float(c), 10.0, 6.0) for c in range(4)], "cell_id long, scope int, lat double, lon double, population double, demand double")
    fac = spark.createDataFrame([(1, 1, 0.0, 0.9, 1.0), (2, 1, 0.0, 3.2, 2.0), (3, 1, 0.1, 1.1, 0.5)], "fac_seq long, scope int, lat double, lon double, machines double")
    merged, moved = cells_of(fac, cells)
    assert values(merged, "fac_seq", "cell_id", "lon", "machines") == [(1, 1, 1.0, 1.5), (2, 3, 3.0, 2.0)]
    assert values(moved, "fac_seq", "new_seq") == [(1, 1), (2, 2), (3, 1)]
    out = model.compute_access(cells, fac, "step", reach=60.0, capacity=4.0, distance=geo.haversine_km, snap=True)
    assert values(out, "cell_id", "access", "treated") == [(0, 0.0, 0.0), (1, 1.0, 6.0), (2, 0.0, 0.0), (3, 1.0, 6.0)] and out.where("cell_id = 1").first()["nearest_km"] == 0
    minutes = spark.createDataFrame([(0, 3, 20.0), (0, 1, 50.0), (1, 1, 70.0), (2, 2, 10.0), (2, 2, 5.0)], "cell_id long, fac_seq long, minutes double")
    out = model.compute_access(cells, fac, "step", reach=60.0, capacity=4.0, distance=geo.haversine_km, minutes=minutes, snap=True)
    assert values(out.where("cell_id != 3"), "cell_id", "access", "treated", "nearest_min") == [(0, 1.0, 6.0, 20.0), (1, 0.0, 0.0, 70.0), (2, 1.0, 6.0, 5.0)]


def cells_of(fac, people):
    return cells.snapped_facilities(fac, people, geo.haversine_km)


@pytest.mark.parametrize("few", [10_000, 3])
def test_quantiles_equal_sorted_values(spark, few):
    """Selection by narrowing ranges: ties, spread exponents, one value, none."""
    rng = np.random.default_rng(8)
    by = {1: rng.exponential(50, 700), 2: np.repeat([3.0, 7.0], 40), 3: 10.0 ** rng.uniform(-200, 200, 200), 4: np.array([5.0]), 6: -rng.integers(0, 9, 300).astype(float)}
    rows = [(s, float(v), float(w)) for s, vs in by.items() for v, w in zip(vs, rng.integers(0, 4, len(vs)), strict=True)] + [(5, None, 1.0), (1, None, 9.0)]
    frame = spark.createDataFrame(rows, "scope int, d double, w double").repartition(3)
    got = {r["scope"]: r for r in summary.quantiles(frame, "d", {"a": 0.5, "b": 0.95, "c": 0.0, "e": 1.0}, few).collect()}
    assert got.keys() == by.keys()
    for s, vs in by.items():
        assert [got[s][k] for k in "abce"] == pytest.approx(list(np.quantile(vs, [0.5, 0.95, 0.0, 1.0])), rel=1e-12)
    for r in summary.weighted_median(frame, "d", "w", few).collect():
        some = sorted((v, w) for s, v, w in rows if s == r["scope"] and v is not None)
        run = np.cumsum([w for _, w in some])
        assert r["median"] == some[int(np.argmax(run >= 0.5 * run[-1]))][0]
    shown = summary.distance_summary(frame.withColumnsRenamed({"d": "nearest_km", "w": "population"}), few)
    assert values(shown.where("scope = 5"), "median_km", "unreached_cells", "unreached_population") == [(None, 1, 1.0)]


def test_wave_numbers_are_longest_chains(spark):
    chains = spark.createDataFrame([(1, 1, 2), (1, 2, 5), (1, 5, None), (1, 1, 5), (1, 3, 4), (1, 4, None), (2, 2, 1 + 8), (2, 9, None)], "scope int, fac_seq long, next long")
    assert values(allocation.wave_numbers(chains), "scope", "fac_seq", "wave") == [(1, 1, 0), (1, 2, 1), (1, 3, 0), (1, 4, 1), (1, 5, 2), (2, 2, 0), (2, 9, 1)]


@pytest.mark.parametrize("kind", [{"model": "exponential", "scale": 25.0}])
def test_plan_carries_what_a_new_computation_gives(spark, kind):
    """After steps that append and merge, the carried state is that of the model for the new facilities."""
    rng = np.random.default_rng(9)
    people = [(int(i), int(i % 3), float(a), float(b), float(p), float(p / 9)) for i, (a, b, p) in enumerate(zip(rng.uniform(0, 2, 45), rng.uniform(0, 2, 45), rng.uniform(5, 800, 45), strict=True))]
    people += [(3, 1, people[3][2], people[3][3], 700.0, 90.0)]  # a border cell
    frame = spark.createDataFrame(people, "cell_id long, scope int, lat double, lon double, population double, demand double")
    fac = spark.createDataFrame([(i, i % 2, 0.5 * i, 0.4, float(i % 3)) for i in range(6)], "fac_seq long, scope int, lat double, lon double, machines double")  # scope 2 has none
    options = {**kind, "capacity": 30.0, "resolution": 4, "distance": geo.haversine_km}
    plan = planning.plan(frame, fac, 3, 2.0, 70.0, **options)
    assert plan.steps.count() == 12 and 6 < plan.facilities.count() < 15  # some appended, some merged
    again = model.compute_access(frame, plan.facilities, **options)
    names = ["scope", "cell_id", "access", "treated", "untreated", "nearest_km", "with_access"]
    for x, y in zip(values(plan.result, *names), values(again, *names), strict=True):
        assert x == pytest.approx(y, abs=1e-9)


def test_levels_and_coarser_minutes(spark):
    base = 617700169958293503
    rows = spark.createDataFrame([(1, c, base + c * 2**20, float(c % 5)) for c in range(600)], "scope int, cell_id long, h3 long, population double")
    got = cells.resample_levels(rows, 8, 5)
    assert values(got.groupBy("res").agg(F.sum("population").alias("p")), "res", "p") == [(r, 1200.0) for r in (5, 6, 7, 8)]
    for r in (5, 7):
        assert values(got.where(f"res = {r}"), "h3", "population") == values(cells.resample(rows, r), "h3", "population")
    minutes = spark.createDataFrame([(1, 0, 7, 10.0), (1, 3, 7, 30.0), (1, 4, 8, 5.0)], "scope int, cell_id long, fac_seq long, minutes double")
    assert values(cells.coarser_minutes(minutes, rows, 5), "fac_seq", "minutes") == [(7, (10 * 1 + 30 * 3) / 4), (8, 5.0)]


def test_area_of_a_cell(spark):
    octant = [(0.0, 0.0), (0.0, 90.0), (90.0, 0.0)]
    small = [(10.0, 20.0), (10.0, 20.01), (10.01, 20.01), (10.01, 20.0)]
    rows = spark.createDataFrame([(1, octant), (2, small), (3, small[:2]), (4, None)], "k int, b array<struct<lat:double,lon:double>>")
    got = [r[0] for r in rows.orderBy("k").select(geo.polygon_km2(F.col("b"))).collect()]
    assert got[0] == pytest.approx(math.pi / 2 * 6371.0088**2) and got[1] == pytest.approx((6371.0088 * math.radians(0.01)) ** 2 * math.cos(math.radians(10.005)), rel=1e-6) and got[2] is None and got[3] is None


def test_displayed_metrics(spark):
    rows = spark.createDataFrame([(1, 1, 4.0, 6.0, 0.4, 0.9), (1, 2, 0.0, 1.0, 0.0, 0.1), (2, 3, 1.0, 1.0, 1.0, 1.0)], "scope int, cell_id long, treated double, demand double, served double, access double").withColumn("untreated", F.expr("demand - treated"))
    assert values(summary.displayed(rows, "deficit", F.lit(5.0)), "cell_id", "value", "low", "high") == [(1, 4.0, 0.0, 4.0), (2, 2.0, 0.0, 4.0), (3, 0.0, 0.0, 0.0)]
    assert values(summary.displayed(rows, "served", F.lit(5.0)), "cell_id", "value", "high") == [(1, 0.4, 1.0), (2, 0.0, 1.0), (3, 1.0, 1.0)]


def test_kept_rows_follow_their_inputs(spark, tmp_path):
    """Only keys whose mark changed are computed; rows of keys that went or changed aren't read, and
    a batch without live keys is removed."""
    path, asked = f"file://{tmp_path}/kept", []
    marks = lambda m: spark.createDataFrame(list(m.items()), "scope int, mark string")

    def compute(keys):
        asked.append(sorted(r["scope"] for r in keys.collect()))
        return keys.select("scope", F.explode(F.array(F.lit(len(asked)), F.lit(0))).alias("v"))

    for m, new in (({1: "a", 2: "b", 3: "c"}, [1, 2, 3]), ({1: "a", 2: "b", 3: "c"}, []), ({1: "a", 2: "x", 4: "d"}, [2, 4]), ({1: "y", 2: "x"}, [1])):
        kept = sinks.refreshed(spark, path, marks(m), ["scope"], compute)
        assert sorted(r["scope"] for r in kept.computed.collect()) == new and {r["scope"] for r in kept.rows.collect()} == set(m)
    assert asked == [[1, 2, 3], [2, 4], [1]] and values(kept.rows, "scope", "v") == [(1, 0), (1, 3), (2, 0), (2, 2)]
    assert sorted(f.name for f in (tmp_path / "kept" / "rows").iterdir() if f.is_dir()) == ["batch=3", "batch=4"]


def test_regions(spark):
    from catchment.sources import regions

    rows = {r["code"]: r["members"] for r in regions.regions(spark).collect()}
    assert len(rows) == 12 and set(rows["WLD"]) == {m for k, v in rows.items() if k != "WLD" for m in v} and rows["NAM"] == ["CA", "PR", "US"]
    assert all(len(m) == len(set(m)) for m in rows.values()) and regions.aliases(spark).count() == 28


def folders(spark, name):
    """The tables called ``name`` that this session has stored."""
    from pathlib import Path

    root = Path(sinks.new_path(spark, "x").removeprefix("file://")).parent
    return set(root.glob(f"{name}-*"))


def stored_rows(spark, name, before):
    new = folders(spark, name) - before
    return sum(spark.read.parquet(f"file://{p}").count() for p in new)


@pytest.fixture(scope="module")
def copies(spark, tmp_path_factory):
    """sf0.001 once and four times, with keys shifted so that the copies stand at the same places."""
    out = []
    for n in (1, 4):
        path = f"file://{tmp_path_factory.mktemp('copies')}"
        for name, shift in (("customer", {"c_custkey": 601 * 2}), ("supplier", {"s_suppkey": 401 * 4}), ("part", {}), ("lineitem", {}), ("nation", {})):
            rows = spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")
            if shift:
                rows = rows.crossJoin(spark.range(n).withColumnRenamed("id", "_k"))
                rows = rows.withColumns({k: F.col(k) + F.col("_k") * s for k, s in shift.items()}).drop("_k")
            rows.write.parquet(f"{path}/{name}.parquet")
        out.append(path)
    return out


BY_PLACE = [
    "A11_scope_totals", "A22_region_statistics", "A23_ratios", "A25_stop_tests", "C10_border_report", "C10_country_report", "C13_scenario", "C14_placement_plan",
    "C15_before_after", "C3_allocation", "C3_soft_decay", "C14_plan_by_distance", "C5_access_statistics", "C5_uniform", "C5_border_cells", "C7_region_border_cells",
    "C7_region_uniform", "C8_region_by_country",
]


@pytest.mark.parametrize("name", BY_PLACE)
def test_pairs_are_of_places(spark, copies, name):
    """Copies of cells and facilities at the same places make no more pairs."""
    sizes = []
    for path in copies:
        before = folders(spark, "access-pairs")
        queries.QUERIES[name](spark, path).write.format("noop").mode("overwrite").save()
        sizes.append(stored_rows(spark, "access-pairs", before))
    changed = 2 * 25 * 150 if name in ("C13_scenario", "C15_before_after") else 0  # their new facility stands elsewhere
    if "border" in name or name.startswith("C8"):  # halves of shifted keys pair other cells
        changed = sizes[0]
    assert 0 < sizes[1] <= sizes[0] + changed


def crowded(spark, seed=5):
    """Cells and facilities of two scopes at few places, some without any."""
    rng = np.random.default_rng(seed)
    spot, site = rng.uniform(0, 1.5, (9, 2)), rng.uniform(0, 1.5, (5, 2))
    at = [spot[i] for i in rng.integers(0, 9, 80)]
    people = [(i, i % 2, float(a), float(b), float(v), float(v / 3)) for i, ((a, b), v) in enumerate(zip(at, rng.integers(0, 90, 80), strict=True))]
    people += [(100, 0, None, None, 7.0, 1.0), (101, 1, None, None, 8.0, 2.0)]
    places = [(i, i % 2, float(site[j][0]), float(site[j][1]), float(i % 3)) for i, j in enumerate(rng.integers(0, 5, 24))]
    cells = spark.createDataFrame(people, "cell_id long, scope int, lat double, lon double, population double, demand double")
    return cells, spark.createDataFrame(places, "fac_seq long, scope int, lat double, lon double, machines double")


@pytest.mark.parametrize(("kind", "task_pairs"), [("step", 10**6), ("exponential", 10**6), ("exponential", 0), ("uniform", 10**6)])
def test_cells_of_a_place_share_what_it_is_served(spark, kind, task_pairs):
    """The model by places equals the allocation of every single cell and facility."""
    cells, fac = crowded(spark)
    options = {"model": kind, "scale": 40.0, "reach": 70.0, "resolution": 6, "distance": geo.haversine_km}
    inputs = model.prepared(cells, fac, **options)
    assert inputs.pairs.count() <= 2 * 10 * 5 and inputs.pairs.agg(F.max("n")).first()[0] > 1
    got = model.assembled(inputs, model.served_demand(inputs.pairs, inputs.facilities, 9.0, task_pairs), geo.haversine_km)
    every = access.with_km(cells.join(access.named(fac), "scope"), geo.haversine_km)
    every = every.withColumn("p", geo.decay(F.col("km"), kind, 40.0, reach=70.0)).withColumn("ring", geo.ring(F.col("km"), 6)).where("p > 0")
    pairs = every.withColumn("capacity", F.col("machines") * 9.0).where("capacity > 0").toPandas()
    want = {(s, c): t for s in (0, 1) for c, t in allocation.allocate_scope(pairs[pairs["scope"] == s]).itertuples(index=False)}
    miss = {(r["scope"], r["cell_id"]): r["m"] for r in every.groupBy("scope", "cell_id").agg(F.product(1 - F.col("p")).alias("m")).collect()}
    near = {(r["scope"], r["cell_id"]): r["km"] for r in access.with_km(cells.where("lat is not null").join(access.named(fac), "scope"), geo.haversine_km).groupBy("scope", "cell_id").agg(F.min("km").alias("km")).collect()}
    rows = got.collect()
    assert len(rows) == 82 and 0 < sum(want.values()) < sum(r["demand"] for r in rows)
    for r in rows:
        k = (r["scope"], r["cell_id"])
        assert r["treated"] == pytest.approx(want.get(k, 0.0), abs=1e-9)
        assert r["access"] == pytest.approx(1 - miss.get(k, 1.0), abs=1e-12) and r["nearest_km"] == near.get(k)


def test_access_within_equals_all_pairs(spark):
    cells, fac = crowded(spark, 6)
    options = {"model": "exponential", "scale": 30.0}
    before = folders(spark, "access-cells")
    got = access.access_within(cells, fac, 300.0, geo.haversine_km, **options)
    want = access.geographic_access(cells, access.pairs_within(cells, fac, 300.0, geo.haversine_km), **options)
    for x, y in zip(values(got, "scope", "cell_id", "access", "with_access"), values(want, "scope", "cell_id", "access", "with_access"), strict=True):
        assert x == pytest.approx(y, abs=1e-12)
    assert stored_rows(spark, "access-cells", before) == 82


def test_pairs_at_places_are_all_pairs(spark):
    cells, fac = crowded(spark, 7)
    before = folders(spark, "spots")
    near = access.places_within(cells, fac, 90.0)
    assert stored_rows(spark, "spots", before) <= 2 * 10
    rows = access.pairs_at(near, cells.select("cell_id", *access.PLACE), fac.select("fac_seq", *access.PLACE))
    want = access.pairs_within(cells, fac, 90.0)
    assert rows.count() == want.count() > 300 and values(rows, "scope", "cell_id", "fac_seq", "km") == values(want, "scope", "cell_id", "fac_seq", "km")


def test_plan_asks_for_minutes_of_its_pairs_alone(spark):
    cells, fac = crowded(spark, 8)
    cells = cells.where("lat is not null")
    travel = lambda pairs: pairs.withColumn("minutes", F.when((F.col("cell_id") + F.col("fac_seq")) % 3 != 0, (F.col("cell_id") * 7 + F.col("fac_seq") * 13) % 60))
    table = travel(cells.select("scope", "cell_id").join(fac.select("scope", "fac_seq"), "scope")).where("minutes is not null")
    options = {"model": "step", "reach": 20.0, "capacity": 4.0, "distance": geo.haversine_km, "snap_min": 6.0}
    asked = []

    def counted(pairs):
        asked.append(pairs.count())
        return travel(pairs)

    one, two = (planning.place(cells, fac, 3, 2.0, 1.0, minutes=m, **options) for m in (table, counted))
    names = ["scope", "step", "cell_id", "fac_seq", "treated"]
    assert values(one, *names) == values(two, *names) and asked and max(asked) <= 24
    with pytest.raises(ValueError):
        planning.place(cells, fac, 1, 2.0, 1.0, minutes=travel, snap=True, **options)
