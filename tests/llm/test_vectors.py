"""Exact deduplication, whitening and hard negatives against brute force."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from catchment.llm import exact_dedup, hard_negatives, whiten

DOCS = "doc_id long, text string, digest string, row int, keep_id long, version int"


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


# --- 12 ----------------------------------------------------------------------------
def rows_of(n, seed=0, width=exact_dedup.WIDTH):
    rng = np.random.default_rng(seed)
    out = rng.integers(-(2**62), 2**62, (n, width))
    out[:, 4], out[:, 6], out[:, exact_dedup.COUNT] = 1, 1, 1
    return out


def test_filter_keeps_finds_and_gives_up_digests():
    rows, out = rows_of(5_000), exact_dedup.CuckooFilter(4)
    out.insert(rows)  # overflows many times
    assert (out.find(rows) >= 0).all() and out.live == 5_000 and (out.find(rows_of(3_000, 1)) < 0).all()
    assert sorted(map(tuple, out.stored_keys())) == sorted(map(tuple, rows))
    out.delete(rows[::2])
    out.delete(rows_of(10, 2))
    assert (out.find(rows[1::2]) >= 0).all() and (out.find(rows[::2]) < 0).all() and out.live == 2_500
    again = exact_dedup.CuckooFilter.opened(out.prints.tobytes(), out.stored_keys().tobytes())
    assert (again.find(rows) == out.find(rows)).all()


def test_equal_fingerprints_are_told_apart_by_their_keys():
    rows, out = rows_of(6), exact_dedup.CuckooFilter(4)
    rows[:, 0] = rows[0, 0]  # one fingerprint, one pair of buckets
    out.insert(rows)
    assert len(set(out.find(rows))) == 6 and out.find(rows).min() >= 0
    other = rows.copy()
    other[:, 1] += 1
    assert (out.find(other) < 0).all()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 12), st.one_of(st.none(), st.integers(-3, 3))), max_size=60), st.integers(1, 7))
def test_absorbing_in_any_batches_equals_a_dictionary(items, size):
    keys = rows_of(13)
    rows = np.array([np.r_[keys[k, :4], i is not None, i or 0, 1, place, 1] for place, (k, i) in enumerate(items)], np.int64).reshape(-1, exact_dedup.WIDTH)
    out = exact_dedup.CuckooFilter(2)
    for at in range(0, len(rows), size):
        out.absorb(rows[at : at + size])
    want = {}
    for r in map(tuple, rows):
        have = want.get(r[:4])
        want[r[:4]] = (max(r[4:8], have[0]), have[1] + 1) if have else (r[4:8], 1)
    assert {tuple(r[:4]): (tuple(r[4:8]), r[8]) for r in out.stored_keys()} == want


def plain_groups(rows):
    by = {}
    for i, t in rows:
        by.setdefault(lower(t), []).append(i)
    return {t: (max([i for i in ids if i is not None], default=None), len(ids)) for t, ids in by.items()}


def test_exact_dedup(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "SHARD_KEYS", 16)
    texts = ["One", "one", "ONE ", "", None, "É", "é", "w " * 30_000, *(f"t{i}" for i in range(40)), *["hot copy"] * 60, *(["pair", "PAIR"])]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, "again"), (3, "again"), (None, "ONE"), (None, "no id"), (None, "NO ID"), (-5, "no id")]
    docs = spark.createDataFrame([(*r, "d", 1, 7, 2) for r in rows], DOCS).repartition(5)
    got = exact_dedup.deduplicate(docs)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    got, want = got.collect(), plain_groups(rows)
    assert Counter((r["doc_id"], r["text_sha256"]) for r in got) == Counter((i, hashlib.sha256(lower(t).encode()).hexdigest()) for i, t in rows)
    sha = {hashlib.sha256(t.encode()).hexdigest(): v for t, v in want.items()}
    assert all((r["keep_id"], r["group_size"]) == sha[r["text_sha256"]] for r in got)
    kept = Counter(r["text_sha256"] for r in got if r["kept"])
    assert kept == Counter(list(sha)) and all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])
    assert exact_dedup.deduplicate(docs.limit(0)).count() == 0
    left, index = exact_dedup.drop_duplicates(docs)
    assert left.columns == docs.columns and left.count() == len(want) and index.shards == 8
    assert {r["text"] and lower(r["text"]) or "" for r in left.collect()} == set(want)


def test_index_takes_in_and_drops_texts(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "SHARD_KEYS", 16)
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    index = exact_dedup.insert(None, frame([(i, f"text {i % 20}") for i in range(30)]))
    assert index.shards == 2
    got = {r["doc_id"]: r for r in exact_dedup.deduplicate(frame([(100, "TEXT 1"), (5, "text 9"), (7, "new"), (0, "text 15")]), index).collect()}
    assert [(r["keep_id"], r["group_size"], r["kept"]) for r in (got[i] for i in (100, 5, 7, 0))] == [(100, 3, True), (29, 3, False), (7, 1, True), (15, 2, False)]
    index = exact_dedup.delete(index, frame([(None, "Text 1"), (None, "unknown")]))
    index = exact_dedup.insert(index, frame([(200 + i, f"more {i}") for i in range(50)]))
    live = exact_dedup.live(index).collect()
    assert index.shards == 8 and len(live) == 69 and index.version == 3
    assert hashlib.sha256(b"text 1").digest() not in {bytes(r["digest"]) for r in live}


# --- 11 ----------------------------------------------------------------------------
VECTORS = "vec_id long, embedding array<float>, label int, n int, x int"


def vectors(n, dim, seed=0, rank=None):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n, rank or dim)) * (1.0 / np.arange(1, (rank or dim) + 1))
    return (base @ rng.standard_normal((rank or dim, dim))).astype(np.float32)


def plain_whitening(m, want):
    x = np.floor(64 * m.astype(np.float64)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    mean = fit.mean(axis=0)
    c = fit - mean
    e, u = np.linalg.eigh(c.T @ c / len(fit))
    e, u = e[::-1][:want], u[:, ::-1][:, :want]
    s = fit.sum(axis=0)
    return len(fit), ((len(fit) * x - s) ** 2).sum(axis=1), (x - mean) @ u / np.sqrt(e), e / np.trace(c.T @ c / len(fit))


def test_whitening(spark):
    m = vectors(300, 24)
    m[250:] = m[0]  # repeated vectors count once
    rows = [(i, v.tolist(), 1, 1, 1) for i, v in enumerate(m)]
    bad = [(900, None, 1, 1, 1), (901, [], 1, 1, 1), (902, [1.0, None], 1, 1, 1), (903, [float("nan")] * 24, 1, 1, 1), (904, [float("inf")] + [0.0] * 23, 1, 1, 1), (905, [1.0], 1, 1, 1)]
    out = whiten.whiten(spark.createDataFrame(rows + bad, VECTORS).repartition(4)).collect()
    n, deviation, z, share = plain_whitening(m, 16)
    assert len(out) == 300 * 16 and {r["n"] for r in out} == {n}
    got = np.zeros((300, 16))
    for r in out:
        got[r["vec_id"], r["component"] - 1] = r["whitened"]
        assert r["deviation"] == deviation[r["vec_id"]] and abs(r["explained"] / share[r["component"] - 1] - 1) < 1e-9 and r["identity_error"] < 1e-8
    got *= np.sign((got * z).sum(axis=0))
    assert np.abs(got - z).max() < 1e-6


def test_whitening_of_few_or_flat_vectors(spark):
    frame = lambda rows: spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(rows)], "vec_id long, embedding array<float>")
    assert whiten.whiten(frame([[1, 2]]).limit(0)).count() == 0
    assert whiten.whiten(frame([[1, 2], [1, 2]])).count() == 0
    rows = whiten.whiten(frame([[1, 2], [3, 4], [5, 6]])).collect()  # one direction
    assert sorted((r["vec_id"], r["component"]) for r in rows) == [(0, 1), (1, 1), (2, 1)]
    assert sorted(abs(round(r["whitened"], 9)) for r in rows) == [0.0, pytest.approx(1.5**0.5), pytest.approx(1.5**0.5)]


@pytest.mark.parametrize("spectrum", [np.ones(40), np.r_[[5.0] * 4, np.linspace(4, 1, 156)], 10.0 ** -np.arange(60), np.r_[1e8, np.linspace(3, 2.9, 99)]])
def test_jacobi_davidson(spectrum):
    """Equal, close and widely spread eigenvalues; spaces larger than the subspace."""
    d = len(spectrum)
    u = np.linalg.qr(np.random.default_rng(3).standard_normal((d, d)))[0]
    a = (u * spectrum) @ u.T
    a = (a + a.T) / 2
    values, found, worst = whiten.jacobi_davidson(lambda b: a @ b, d, 16)
    assert worst <= 4 * whiten.EXACT and np.abs(values - np.linalg.eigvalsh(a)[::-1][:16]).max() <= 1e-12 * spectrum.max()
    assert np.abs(found.T @ found - np.eye(16)).max() < 1e-12


# --- 13 ----------------------------------------------------------------------------
@settings(max_examples=40, deadline=None)
@given(st.integers(1, 150), st.integers(0, 40), st.integers(0, 2**32))
def test_residue_products_are_exact(dim, bits, seed):
    rng = np.random.default_rng(seed)
    a, b = (rng.integers(-(2**bits), 2**bits + 1, (7, dim)) // 2 ** int(bits > 27) ** 1 for _ in range(2))
    want = [[sum(int(x) * int(y) for x, y in zip(r, s, strict=True)) for s in b] for r in a]
    wrapped = [[(x + 2**63) % 2**64 - 2**63 for x in r] for r in want]
    got = hard_negatives.scores(hard_negatives.Residues(a), np.arange(7), hard_negatives.Residues(b))
    assert got.tolist() == wrapped


def plain_negatives(rows, every):
    use = [(k, i, l, np.array(v, dtype=object)) for k, (i, v, l) in enumerate(rows) if i is not None and l is not None and v]
    out = []
    for ka, a, la, va in use:
        if a % every:
            continue
        scored = sorted((-int(va @ v), i, l) for k, i, l, v in use if k != ka and len(v) == len(va))
        for p, i, _ in [x for x in scored if x[2] == la][:5]:
            fine = [x for x in scored if x[2] != la and -50 * p <= -100 * x[0] <= -95 * p]
            out += [(a, i, r, j, -p, -n) for r, (n, j, _) in enumerate(fine[:3], 1)]
    return sorted(out)


@pytest.mark.parametrize("part", [16 << 20, 200])
def test_hard_negatives(spark, part):
    rng = np.random.default_rng(4)
    m = rng.integers(-30, 60, (160, 6))
    m[100:130] = m[3]  # ties
    rows = [(int(i), m[i].tolist(), int(rng.integers(0, 3))) for i in range(160)]
    rows += [rows[0], (50, m[7].tolist(), 1), (50, m[8].tolist(), 1), (None, m[0].tolist(), 1), (60, None, 1), (70, m[0].tolist(), None), (80, [1, 2], 1), (81, [3, 4], 1), (82, [2, 2], 2)]
    frame = spark.createDataFrame(rows, "vec_id long, v array<long>, label long").repartition(3)
    got = hard_negatives.hard_negatives(frame, F.col("vec_id") % 10 == 0, block=16, part_bytes=part)
    assert sorted(map(tuple, got.collect())) == plain_negatives(rows, 10)
    assert hard_negatives.hard_negatives(frame.limit(0), F.col("vec_id") % 10 == 0).count() == 0


def test_mining_changes_labels_and_leaves_out_bad_rows(spark):
    rng = np.random.default_rng(5)
    m = rng.normal(0, 0.3, (200, 8)).astype(np.float32)
    rows = [(i, m[i].tolist(), int(i % 4 + 6), 0, 0) for i in range(200)]
    bad = [(400, None, 1, 0, 0), (401, m[0].tolist(), None, 0, 0), (402, [float("nan")] * 8, 1, 0, 0), (403, [], 1, 0, 0)]
    got = hard_negatives.mine(spark.createDataFrame(rows + bad, VECTORS))
    label = lambda r: (r[2] + 1) % 10 if r[0] % 7 == 0 else r[2]
    plain = [(r[0], [int(np.floor(256 * float(x))) for x in r[1]], label(r)) for r in rows]
    assert sorted(map(tuple, got.collect())) == plain_negatives(plain, 50)
