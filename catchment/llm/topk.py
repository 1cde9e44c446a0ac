"""Exact top-k inner-product search with block-at-a-time pruning.

Vectors are stored in blocks of a document range, in the order of their largest component, so
that neighbours resemble each other. A block has its forward index (the matrix of its
vectors) and, for every term (dimension), the least and greatest weight. For a query a
block's bound is the sum over terms of the larger of weight times maximum and weight times
minimum. A query starts with a threshold, its k-th best score in its own block. Blocks are
taken by falling bound and scored whole, for the queries whose k-th best score so far their
bound reaches; equal bounds are still scored, so ties go to the smaller id.

No vector is shuffled for a search: the stated queries go to the blocks, in parts of
``PART_BYTES`` that are broadcast one after the other, and each task sends on the k best of
its blocks for each query. So the shuffle grows with the queries, and the blocks are read once
a part, once in all for up to about 30,000 queries of 64 terms.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from catchment.llm.common import small_batches, stored

#: Vectors of a block; bytes of the queries that are broadcast at once; bounds held at once.
BLOCK, PART_BYTES, BOUNDS = 256, 16 << 20, 1 << 22
#: No score, no id.
NONE, NO_ID = np.iinfo(np.int64).min + 1, np.iinfo(np.int64).max


def integers(embedding: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component as long; null if the vector, or a component, is
    null or not finite."""
    fine = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.when(fine & (F.size(embedding) > 0), F.transform(embedding, lambda x: F.floor(x.cast("double") * scale)))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products: in floating point where that can't round."""
    largest = int(np.abs(a).max()) * int(np.abs(b).max()) * a.shape[1]
    if largest < 1 << 53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


class Best:
    """The k best vectors of each query so far."""

    def __init__(self, rows: np.ndarray, vectors: np.ndarray, least: np.ndarray, k: int):
        self.rows, self.vectors, self.least = rows, vectors, least
        self.score = np.full((len(rows), k), NONE)
        self.name = np.full((len(rows), k), NO_ID)
        self.row = np.full((len(rows), k), NO_ID)

    def threshold(self) -> np.ndarray:
        """What a vector must reach to be among a query's k best."""
        return np.maximum(self.score[:, -1], self.least)

    def add(self, who: np.ndarray, ids: np.ndarray, vectors: np.ndarray, rows_: np.ndarray) -> None:
        """Score a block for the queries ``who``."""
        score = products(self.vectors[who], vectors)
        good = (score >= self.threshold()[who, None]) & (rows_[None, :] != self.rows[who, None])
        r, c = np.nonzero(good)
        if not len(r):
            return
        rows = np.unique(r)
        k, q = self.score.shape[1], who[rows]
        row = np.concatenate([np.searchsorted(rows, r), np.repeat(np.arange(len(rows)), k)])
        value = np.concatenate([score[r, c], self.score[q].ravel()])
        name = np.concatenate([ids[c], self.name[q].ravel()])
        own = np.concatenate([rows_[c], self.row[q].ravel()])
        order = np.lexsort((own, name, -value, row))
        first = np.searchsorted(row[order], np.arange(len(rows)))
        pick = order[first[:, None] + np.arange(k)]
        self.score[q], self.name[q], self.row[q] = value[pick], name[pick], own[pick]

    def take(self, blocks: list[tuple[np.ndarray, ...]]) -> None:
        """Score blocks (ids, vectors, rows, lo, hi) by falling bound, as far as bounds reach."""
        lo, hi = (np.stack([b[i] for b in blocks]).astype(np.float64) for i in (3, 4))
        bound = np.maximum(self.vectors, 0).astype(np.float64) @ hi.T + np.minimum(self.vectors, 0).astype(np.float64) @ lo.T
        bound += np.abs(bound) * 1e-9 + 1  # more than its rounding
        favourite = bound.argmax(axis=1)
        for b in np.unique(favourite):  # each query's best block comes first
            self.add(np.flatnonzero(favourite == b), *blocks[b][:3])
        bound[np.arange(len(bound)), favourite] = -np.inf
        for b in np.argsort(-bound.max(axis=0), kind="stable"):
            who = np.flatnonzero(bound[:, b] >= self.threshold())
            if len(who):
                self.add(who, *blocks[b][:3])


BLOCKS = "dim int, width int, ids binary, vectors binary, rows binary, lo binary, hi binary, queries binary"


def cut_blocks(rows: DataFrame, size: int) -> DataFrame:
    """Blocks of ``size`` of the sorted rows (dim, vec_id, v, is_query, row) of each partition.

    Vectors are kept in the narrowest integers that hold them (``width`` bytes each)."""

    def block(dim: int, ids: np.ndarray, m: np.ndarray, query: np.ndarray, own: np.ndarray) -> tuple:
        lo, hi = m.min(axis=0), m.max(axis=0)
        kind = next(t for t in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(t).min <= lo.min() and hi.max() <= np.iinfo(t).max)
        return dim, np.dtype(kind).itemsize, ids.tobytes(), m.astype(kind).tobytes(), own.tobytes(), lo.tobytes(), hi.tobytes(), np.flatnonzero(query).astype(np.int32).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dim, held = None, []

        def flush() -> pa.RecordBatch:
            ids, m, query, own = (np.concatenate(x) for x in zip(*held, strict=True))
            out = [block(dim, *(x[i : i + size] for x in (ids, m, query, own))) for i in range(0, len(ids), size)]
            kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 6]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=[x.split()[0] for x in BLOCKS.split(", ")])

        for batch in batches:
            dims = batch.column(0).to_numpy()
            for part in np.split(np.arange(len(dims)), np.flatnonzero(np.diff(dims)) + 1):
                if not len(part):
                    continue
                if dim != dims[part[0]] or sum(len(x[0]) for x in held) >= size * 16:
                    if held:
                        yield flush()
                    dim, held = int(dims[part[0]]), []
                cut = batch.slice(part[0], len(part))
                held.append((cut.column(1).to_numpy(), cut.column(2).flatten().to_numpy().reshape(-1, dim), cut.column(3).to_numpy(zero_copy_only=False), cut.column(4).to_numpy()))
        if held:
            yield flush()

    return rows.select("dim", "vec_id", "v", "is_query", "row").mapInArrow(run, BLOCKS)


def opened(batch: pa.RecordBatch) -> Iterator[tuple[int, tuple[np.ndarray, ...], np.ndarray]]:
    """dim, (ids, vectors, rows, lo, hi), places of queries of each block."""
    for dim, width, *parts in zip(*batch.columns, strict=True):
        ids, vectors, own, lo, hi, queries = (x.as_buffer() for x in parts)
        ids, own, lo, hi = (np.frombuffer(x, np.int64) for x in (ids, own, lo, hi))
        m = np.frombuffer(vectors, f"<i{width.as_py()}").reshape(len(ids), -1).astype(np.int64)
        yield dim.as_py(), (ids, m, own, lo, hi), np.frombuffer(queries, np.int32)


def seeded(blocks: DataFrame, k: int) -> DataFrame:
    """query (its row), query_id, dim, v binary (64-bit), least: the k-th best score in the query's own block, or NONE."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, (ids, m, own, _, _), at in opened(batch):
                if len(at):
                    score = products(m[at], m)
                    score[np.arange(len(at)), at] = NONE
                    least = np.partition(score, -k, axis=1)[:, -k] if len(ids) > k else np.full(len(at), NONE)
                    columns = [pa.array(own[at]), pa.array(ids[at]), pa.array([dim] * len(at), pa.int32()), pa.array([m[i].tobytes() for i in at], pa.binary()), pa.array(least)]
                    yield pa.RecordBatch.from_arrays(columns, names=["query", "query_id", "dim", "v", "least"])

    return blocks.mapInArrow(run, "query long, query_id long, dim int, v binary, least long")


def searched(blocks: DataFrame, queries: list, k: int) -> DataFrame:
    """query, query_id, vec_id, row, score: for each task the k best of its blocks for each of ``queries``
    (rows of ``seeded``)."""
    by_dim = {}
    for r in sorted(queries):
        by_dim.setdefault(r["dim"], []).append(r)
    packed = {d: (np.array([r["query"] for r in rows]), np.array([r["query_id"] for r in rows]), np.frombuffer(b"".join(r["v"] for r in rows), np.int64).reshape(-1, d), np.array([r["least"] for r in rows])) for d, rows in by_dim.items()}
    sent = blocks.sparkSession.sparkContext.broadcast(packed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {d: Best(x[0], x[2], x[3], k) for d, x in sent.value.items()}
        held: dict[int, list] = {d: [] for d in best}
        for batch in batches:
            for dim, block, _ in opened(batch):
                if dim in best:
                    held[dim].append(block)
                    if len(held[dim]) * len(best[dim].rows) >= BOUNDS or len(held[dim]) >= 256:
                        best[dim].take(held[dim])
                        held[dim] = []
        for dim, b in best.items():
            if held[dim]:
                b.take(held[dim])
            r, c = np.nonzero(b.name != NO_ID)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (b.rows[r], sent.value[dim][1][r], b.name[r, c], b.row[r, c], b.score[r, c])], names=["query", "query_id", "vec_id", "row", "score"])

    return blocks.mapInArrow(run, "query long, query_id long, vec_id long, row long, score long")


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, block: int = BLOCK, part_bytes: int = PART_BYTES) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best of all other rows for each query row.

    ``vectors`` has vec_id and v array<long>; rows with a null in either take no part.
    Vectors are compared with those of their own length. Rows that repeat a vec_id are
    rows of their own, as queries and as candidates. Fewer than k other rows: all of them. Ties go to the smaller
    vec_id. Sums beyond 64 bits wrap. An empty table gives no rows.
    """
    small_batches(vectors.sparkSession)
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    top = F.array_max(F.transform("v", lambda x: F.abs(x)))
    place = F.array_position("v", top) - F.array_position("v", -top)  # of the largest component, with its sign
    rows = stored(rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "v", F.size("v").alias("dim"), place.alias("place"), F.coalesce(is_query, F.lit(False)).alias("is_query")), "vectors")
    order = ["dim", "place", "vec_id", "row"]
    blocks = stored(cut_blocks(rows.repartitionByRange(*order).sortWithinPartitions(*order), block), "blocks")
    queries = stored(seeded(blocks, k), "queries")
    parts = 1 + 2 * (queries.agg(F.sum(F.octet_length("v") + 32)).first()[0] or 0) // part_bytes
    found = []
    for p in range(parts):
        some = queries.where(F.pmod(F.xxhash64("query"), F.lit(parts)) == p).collect()  # part_bytes about
        found.append(stored(searched(blocks, some, k), "found"))
    every = found[0]
    for more in found[1:]:
        every = every.union(more)
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "row"))
    return every.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search(embeddings: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: ``top_k`` of the rows (vec_id, embedding) whose vec_id is
    divisible by ``every``, over components as integers. Vectors that are null, empty, or hold
    null or non-finite components take no part; other columns aren't read."""
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), integers(F.col("embedding")).alias("v"))
    return top_k(rows, F.col("vec_id") % every == 0, k)
