"""Hard negatives of anchors, from exact integer scores in a residue number system.

Component matrices are taken modulo several primes below 1,024, as residues around 0. Their
products over 64 components stay below 2^24, so float32 matrix products are exact. Mixed-radix
Chinese remaindering with digits around 0 gives the signed score; as many primes are used as
the largest possible score of a block needs.

The anchors are a stated query set, scored against all rows in blocks: blocks hold rows of one
label, in the order of their ids, and stay where they are. Anchors go to them in parts of
``PART_BYTES``. A first round keeps each anchor's best rows of its own label, a second those of
other labels whose score lies in the window that each positive opens.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from catchment.llm.common import small_batches, stored
from catchment.llm.topk import integers

#: Components of one float32 product: 64 * 511^2 < 2^24 for primes below 1,024.
CHUNK, TOP = 64, 1024
#: Rows of a block, anchors scored at once, bytes of the anchors that are broadcast at once.
BLOCK, TILE, PART_BYTES = 1024, 1024, 16 << 20
NONE, NO_ID = np.iinfo(np.int64).min, np.iinfo(np.int64).max
BLOCKS = "dim int, label long, width int, rows binary, ids binary, vectors binary"


def primes(below: int = TOP) -> list[int]:
    """Primes under ``below``, the largest first; none of them is 2."""
    sieve = np.ones(below, bool)
    sieve[:3] = False
    sieve[4::2] = False
    for p in range(3, int(below**0.5) + 1, 2):
        if sieve[p]:
            sieve[p * p :: p] = False
    return [int(p) for p in np.flatnonzero(sieve)[::-1]]


PRIMES = primes()


def moduli(bound: int) -> list[int]:
    """As many primes as tell all whole numbers from -bound to bound apart."""
    out, product = [], 1
    for p in PRIMES:
        if product > 2 * bound:
            break
        out.append(p)
        product *= p
    return out


def centred(x: np.ndarray, p: int) -> np.ndarray:
    """Whole numbers in float64 modulo p, from -(p-1)/2 to (p-1)/2."""
    return x - p * np.rint(x / p)


class Residues:
    """A matrix of long integers with its residues, made when asked for."""

    def __init__(self, m: np.ndarray):
        self.m, self.largest, self.made = m, max(abs(int(m.max(initial=0))), abs(int(m.min(initial=0)))), {}

    def at(self, p: int) -> np.ndarray:
        if p not in self.made:
            r = self.m % p
            self.made[p] = np.where(r > p // 2, r - p, r).astype(np.float32)
        return self.made[p]


def product_modulo(a: np.ndarray, b: np.ndarray, p: int) -> np.ndarray:
    """Inner products of rows modulo p, around 0: float32 products of CHUNK components each."""
    out = np.zeros((len(a), len(b)))
    for k in range(0, a.shape[1], CHUNK):
        out += centred((a[:, k : k + CHUNK] @ b[:, k : k + CHUNK].T).astype(np.float64), p)
    return centred(out, p)


def scores(a: Residues, who: np.ndarray, b: Residues) -> np.ndarray:
    """Exact inner products of the rows ``who`` of a with all of b; beyond 64 bits they wrap."""
    used = moduli(a.largest * b.largest * a.m.shape[1])
    digits = []
    for k, p in enumerate(used):
        r = product_modulo(a.at(p)[who], b.at(p), p)
        if k:
            known = digits[-1]  # the value of the digits so far, modulo p
            for j in range(k - 2, -1, -1):
                known = centred(known * (used[j] % p) + digits[j], p)
            inverse = pow(int(np.prod([used[j] % p for j in range(k)], dtype=object)), -1, p)
            r = centred(centred(r - known, p) * inverse, p)
        digits.append(r)
    if not digits:
        return np.zeros((len(who), len(b.m)), np.int64)
    out = digits[-1].astype(np.int64)
    for j in range(len(used) - 2, -1, -1):
        out = out * used[j] + digits[j].astype(np.int64)
    return out


class Kept:
    """The k highest scores of each of n lists; ties go to the smaller id, then row."""

    def __init__(self, n: int, k: int):
        self.score, self.id, self.row = np.full((n, k), NONE), np.full((n, k), NO_ID), np.full((n, k), NO_ID)

    def add(self, at: np.ndarray, score: np.ndarray, ids: np.ndarray, row: np.ndarray) -> None:
        which, k = np.unique(at), self.score.shape[1]
        place = np.concatenate([np.searchsorted(which, at), np.repeat(np.arange(len(which)), k)])
        score, ids, row = (np.concatenate([new, old[which].ravel()]) for new, old in ((score, self.score), (ids, self.id), (row, self.row)))
        order = np.lexsort((row, ids, np.invert(score), place))  # ~x falls as x rises
        pick = order[np.searchsorted(place[order], np.arange(len(which)))[:, None] + np.arange(k)]
        self.score[which], self.id[which], self.row[which] = score[pick], ids[pick], row[pick]


def cut_blocks(rows: DataFrame, size: int) -> DataFrame:
    """BLOCKS of up to ``size`` rows (row, vec_id, label, dim, v) of one dim and label, by vec_id."""

    def block(key: tuple[int, int], held: list) -> list[tuple]:
        row, ids, m = (np.concatenate(x) for x in zip(*held, strict=True))
        kind = next(t for t in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(t).min <= m.min() and m.max() <= np.iinfo(t).max)
        cut = [slice(i, i + size) for i in range(0, len(row), size)]
        return [(*key, np.dtype(kind).itemsize, row[c].tobytes(), ids[c].tobytes(), m[c].astype(kind).tobytes()) for c in cut]

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 3]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=[x.split()[0] for x in BLOCKS.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            row, ids, label, dim = (batch.column(i).to_numpy() for i in range(4))
            cuts = np.flatnonzero(np.diff(label) | np.diff(dim)) + 1
            for part in np.split(np.arange(len(row)), cuts):
                if not len(part):
                    continue
                if held and (key != (dim[part[0]], label[part[0]]) or sum(len(x[0]) for x in held) >= 8 * size):
                    yield batch_of(block(key, held))
                    held = []
                key = int(dim[part[0]]), int(label[part[0]])
                held.append((row[part], ids[part], batch.column(4).slice(part[0], len(part)).flatten().to_numpy().reshape(-1, key[0])))
        if held:
            yield batch_of(block(key, held))

    order = ["dim", "label", "vec_id", "row"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return rows.select("row", "vec_id", "label", "dim", "v").mapInArrow(run, BLOCKS)


def selected(blocks: DataFrame, anchors: list, k: int, same_label: bool) -> DataFrame:
    """anchor, slot, vec_id, row, score: what a task's blocks have of the k best of each list.

    ``anchors`` are rows (row, label, v, lows, highs): list ``slot`` of an anchor takes other
    rows with a score from lows[slot] to highs[slot], of the anchor's label or of all others."""
    packed = {}
    for dim in sorted({len(a["v"]) for a in anchors}):
        some = sorted((a for a in anchors if len(a["v"]) == dim), key=lambda a: a["row"])
        width = max(len(a["lows"]) for a in some)  # an unused list takes nothing
        fill = lambda x, v: list(x) + [v] * (width - len(x))  # noqa: B023, E731
        packed[dim] = (np.array([a["row"] for a in some]), np.array([a["label"] for a in some]), np.array([a["v"] for a in some], np.int64), np.array([fill(a["lows"], 1) for a in some], np.int64), np.array([fill(a["highs"], 0) for a in some], np.int64))
    sent = blocks.sparkSession.sparkContext.broadcast(packed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = {d: (Residues(x[2]), Kept(x[3].size, k)) for d, x in sent.value.items()}
        for batch in batches:
            for dim, label, width, *parts in zip(*batch.columns, strict=True):
                dim, label = dim.as_py(), label.as_py()
                if dim not in state:
                    continue
                (own, labels, _, low, high), (a, best) = sent.value[dim], state[dim]
                row, ids, vectors = (x.as_buffer() for x in parts)
                row, ids = np.frombuffer(row, np.int64), np.frombuffer(ids, np.int64)
                b = Residues(np.frombuffer(vectors, f"<i{width.as_py()}").reshape(-1, dim).astype(np.int64))
                asked = np.flatnonzero((labels == label) == same_label)
                for i in range(0, len(asked), TILE):
                    who = asked[i : i + TILE]
                    score = scores(a, who, b)
                    for slot in range(low.shape[1]):
                        at = who * low.shape[1] + slot
                        good = (score >= np.maximum(low[who, slot], best.score[at, -1])[:, None]) & (score <= high[who, slot, None])
                        if same_label:
                            good &= row[None, :] != own[who, None]
                        if len(row) > k:  # below the k-th best of the block nothing counts
                            busy = np.flatnonzero(good.sum(axis=1) > k)
                            least = np.partition(np.where(good[busy], score[busy], NONE), -k, axis=1)[:, -k]
                            good[busy] &= score[busy] >= least[:, None]
                        r, c = np.nonzero(good)
                        if len(r):
                            best.add(at[r], score[r, c], ids[c], row[c])
        for dim, (_, best) in state.items():
            lists = sent.value[dim][3].shape[1]
            r, c = np.nonzero(best.row != NO_ID)
            if len(r):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (sent.value[dim][0][r // lists], (r % lists).astype(np.int32), best.id[r, c], best.row[r, c], best.score[r, c])], names=["anchor", "slot", "vec_id", "row", "score"])

    return blocks.mapInArrow(run, "anchor long, slot int, vec_id long, row long, score long")


def best_of(blocks: DataFrame, anchors: DataFrame, k: int, same_label: bool, part_bytes: int) -> DataFrame:
    """``selected`` for all anchors, a stored table (row, label, v, lows, highs), and over all
    tasks: anchor, slot, rank (from 1), vec_id, score."""
    held = anchors.agg(F.sum(F.size("v") * 8 + F.size("lows") * 16 + 64)).first()[0] or 0
    parts, found = 1 + held // part_bytes, []
    for p in range(parts):
        some = anchors.where(F.pmod(F.xxhash64("row"), F.lit(parts)) == p).collect()  # part_bytes about
        found.append(stored(selected(blocks, some, k, same_label), "selected"))
    every = found[0]
    for more in found[1:]:
        every = every.union(more)
    rank = F.row_number().over(Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "vec_id", "row"))
    return every.withColumn("rank", rank).where(F.col("rank") <= k).select("anchor", "slot", "rank", "vec_id", "score")


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: tuple[int, int] = (50, 100), high: tuple[int, int] = (95, 100),
    block: int = BLOCK, part_bytes: int = PART_BYTES,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``vectors`` has vec_id, label and v array<long>; rows with a null in any take no part.
    An anchor's positives are its best other rows of the same label. A positive's negatives are
    the anchor's best rows of other labels with positive_score * low <= negative_score <=
    positive_score * high (ratios of whole numbers, compared exactly); no negative, no row.
    Higher scores come first, ties by smaller vec_id. Vectors are compared with those of their
    own length. Rows that repeat a vec_id are rows of their own, as anchors too. An empty table
    gives no rows.
    """
    small_batches(vectors.sparkSession)
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull())
    rows = stored(rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", "v", F.size("v").alias("dim"), F.coalesce(is_anchor, F.lit(False)).alias("is_anchor")), "vectors")
    blocks = stored(cut_blocks(rows, block), "blocks")
    whole = [F.array(F.lit(x).cast("long")) for x in (NONE + 1, NO_ID)]
    anchors = rows.where("is_anchor").select("row", "vec_id", "label", "v")
    first = stored(best_of(blocks, anchors.select("row", "label", "v", whole[0].alias("lows"), whole[1].alias("highs")), positives, True, part_bytes).withColumnRenamed("rank", "place"), "positives")
    # a negative n of a positive p: low[0] * p <= low[1] * n and high[1] * n <= high[0] * p
    def floor(times: int, by: int) -> Column:
        t = F.col("score").cast("decimal(30,0)") * times
        return ((t - F.pmod(t, F.lit(by).cast("decimal(30,0)"))) / by).cast("long")

    ends = [-floor(-low[0], low[1]), floor(*high)]
    windows = first.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("place", ends[0].alias("lo"), ends[1].alias("hi")))).alias("w"))  # ``positives`` at most
    asked = anchors.join(windows, F.col("row") == F.col("anchor")).select("row", "label", "v", F.col("w.lo").alias("lows"), F.col("w.hi").alias("highs"))
    second = best_of(blocks, stored(asked, "anchors"), negatives, False, part_bytes).select("anchor", (F.col("slot") + 1).alias("place"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    pairs = first.select("anchor", "place", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    names = anchors.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    return second.join(pairs, ["anchor", "place"]).join(names, "anchor").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def mine(embeddings: DataFrame, every: int = 50) -> DataFrame:
    """``hard_negatives`` of the rows (vec_id, embedding, label) whose vec_id is divisible by
    ``every``, over components as floor(256 * x). Where vec_id is divisible by 7, the label is
    first replaced by (label + 1) % 10. Rows with a null label, or a vector that is null, empty
    or holds null or non-finite components, take no part; other columns aren't read."""
    label = F.col("label").cast("long")
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"), integers(F.col("embedding")).alias("v"))
    return hard_negatives(rows, F.col("vec_id") % every == 0)
