"""Exact deduplication over an index of cuckoo filters.

A text's digest is the SHA-256 of it with A-Z in lower case. The index holds the live digests,
dealt into shards by their own bits. A shard is a cuckoo filter: buckets of four 16-bit
fingerprints, each digest in one of two buckets, and beside each fingerprint, in the same
place, the stored key (the whole digest, the document that stays, the number of documents). A
fingerprint that matches is a hit only if the stored digest is the same.

1. Each input partition takes its rows into filters of its own, so that a text that a third of
   the corpus repeats leaves a partition once.
2. What is left goes to its shard, whose filter takes it in: a new digest is inserted; a known
   one adds its count and, if its document comes later in order, takes over what stays. An
   insertion that finds no room after many evictions doubles the buckets, from stored keys.
3. The index is a table of one row a shard. More digests than its shards should hold double
   the shards, again from stored keys.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catchment.llm.common import free_name, mixed, small_batches, stored

#: Places of a bucket, share of them to be filled, rounds of evictions before the buckets double.
SLOTS, LOAD, ROUNDS = 4, 0.9, 200
#: Digests that a shard should hold; digests that a partition holds before it sends them on.
SHARD_KEYS, HELD_KEYS = 8_192, 65_536
#: A stored key: four words of digest, has a doc_id, doc_id, version, row, number of documents.
WIDTH, ORDER, COUNT = 9, slice(4, 8), 8
#: Groups with more than this share of all documents are told to every task: 1,000 at most.
HOT = 0.001
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PAGE = "shard int, drop boolean, prints binary, keys binary"


def later(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows of ``a`` come after those of ``b`` in the order of documents."""
    out, same = np.zeros(len(a), bool), np.ones(len(a), bool)
    for i in range(ORDER.start, ORDER.stop):
        out |= same & (a[:, i] > b[:, i])
        same &= a[:, i] == b[:, i]
    return out


def folded(rows: np.ndarray) -> np.ndarray:
    """One row a digest: the last in order, with the sum of counts."""
    if len(rows) < 2:
        return rows
    rows = rows[np.lexsort([rows[:, i] for i in (*range(ORDER.stop - 1, ORDER.start - 1, -1), 3, 2, 1, 0)])]
    first = np.flatnonzero(np.r_[True, (rows[1:, :4] != rows[:-1, :4]).any(axis=1)])
    out = rows[np.r_[first[1:], len(rows)] - 1]
    out[:, COUNT] = np.add.reduceat(rows[:, COUNT], first)
    return out


class CuckooFilter:
    """Fingerprints of live digests, with the stored key of each in the same place."""

    def __init__(self, buckets: int = 16):
        self.prints = np.zeros((buckets, SLOTS), np.uint16)  # 0: free
        self.keys = np.zeros((buckets, SLOTS, WIDTH), np.int64)
        self.live = 0
        self.rng = np.random.default_rng(1)

    @classmethod
    def opened(cls, prints: bytes, keys: bytes) -> CuckooFilter:
        out = cls(len(prints) // (2 * SLOTS))
        out.prints[:] = np.frombuffer(prints, np.uint16).reshape(-1, SLOTS)
        out.keys[out.prints != 0] = np.frombuffer(keys, np.int64).reshape(-1, WIDTH)
        out.live = int((out.prints != 0).sum())
        return out

    def stored_keys(self) -> np.ndarray:
        return self.keys[self.prints != 0]

    def placed(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Fingerprint and first bucket of each digest."""
        h = rows[:, 0].astype(np.uint64)
        return (h >> np.uint64(48)).astype(np.uint32).__mod__(65535).astype(np.uint16) + np.uint16(1), (h & np.uint64(len(self.prints) - 1)).astype(np.int64)

    def other(self, bucket: np.ndarray, prints: np.ndarray) -> np.ndarray:
        """The second bucket of a fingerprint, from either."""
        return bucket ^ (mixed(prints.astype(np.uint64) + np.uint64(1)) & np.uint64(len(self.prints) - 1)).astype(np.int64)

    def find(self, rows: np.ndarray) -> np.ndarray:
        """Place of each digest (-1: not live). Matching fingerprints are verified on the stored digest."""
        out = np.full(len(rows), -1)
        prints, bucket = self.placed(rows)
        for b in (bucket, self.other(bucket, prints)):
            r, s = np.nonzero(self.prints[b] == prints[:, None])
            same = (self.keys[b[r], s, :4] == rows[r, :4]).all(axis=1)
            out[r[same]] = b[r[same]] * SLOTS + s[same]
        return out

    def insert(self, rows: np.ndarray) -> None:
        """Insert different digests that aren't live; without room the buckets double."""
        while self.live + len(rows) > LOAD * self.prints.size:
            self.double()
        rest = self.put(rows)
        while len(rest):
            self.double()
            rest = self.put(rest)

    def put(self, rows: np.ndarray) -> np.ndarray:
        """Place rows, evicting others if need be; what is left over after ROUNDS is returned."""
        rows = rows.copy()
        prints, at = self.placed(rows)
        for turn in range(ROUNDS):
            if not len(rows):
                break
            order = np.argsort(at, kind="stable")
            rows, prints, at = rows[order], prints[order], at[order]
            start = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
            rank = np.arange(len(at)) - np.repeat(start, np.diff(np.r_[start, len(at)]))
            full = self.prints[at] != 0
            fits = rank < SLOTS - full.sum(axis=1)
            slot = np.argsort(full, axis=1, kind="stable")[np.arange(len(at)), np.minimum(rank, SLOTS - 1)]
            self.prints[at[fits], slot[fits]], self.keys[at[fits], slot[fits]] = prints[fits], rows[fits]
            self.live += int(fits.sum())
            rows, prints, at = rows[~fits], prints[~fits], at[~fits]
            if turn and len(rows):  # both buckets were full: one row of each bucket takes another's place
                lead = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
                b, s = at[lead], self.rng.integers(SLOTS, size=len(lead))
                out = self.prints[b, s], self.keys[b, s]
                self.prints[b, s], self.keys[b, s] = prints[lead], rows[lead]
                prints[lead], rows[lead] = out
            at = self.other(at, prints)
        return rows

    def double(self) -> None:
        """Twice as many buckets, filled from the stored keys."""
        keys, size = self.stored_keys(), len(self.prints)
        while True:
            size *= 2
            self.prints, self.keys, self.live = np.zeros((size, SLOTS), np.uint16), np.zeros((size, SLOTS, WIDTH), np.int64), 0
            if not len(self.put(keys)):
                return

    def delete(self, rows: np.ndarray) -> None:
        """Take digests out; those that aren't live change nothing."""
        at = np.unique(self.find(rows))
        at = at[at >= 0]
        self.prints.reshape(-1)[at], self.keys.reshape(-1, WIDTH)[at] = 0, 0
        self.live -= len(at)

    def absorb(self, rows: np.ndarray) -> None:
        """Take documents in: known digests are counted, the last document stays; others are inserted."""
        rows = folded(rows)
        at = self.find(rows)
        known = at >= 0
        if known.any():
            keys = self.keys.reshape(-1, WIDTH)
            have, new = keys[at[known]], rows[known]
            merged = np.where(later(new, have)[:, None], new, have)
            merged[:, COUNT] = have[:, COUNT] + new[:, COUNT]
            keys[at[known]] = merged
        self.insert(rows[~known])


@dataclass
class Index:
    """A stored index: a row of PAGE a shard, how many shards (a power of two), its version,
    and how many documents it has taken in."""

    pages: DataFrame
    shards: int
    version: int
    documents: int


def digests(docs: DataFrame) -> DataFrame:
    """row, doc_id, digest (binary) of each document, stored, so that a row keeps its number.
    Null texts count as empty; doc_ids are whole numbers."""
    text = F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"))
    return stored(rows, "digests")


def shard_of(rows: np.ndarray, shards: int) -> np.ndarray:
    return (rows[:, 3].astype(np.uint64) & np.uint64(shards - 1)).astype(np.int32)


def pages(parts: list[tuple[int, bool, bytes | None, bytes]]) -> pa.RecordBatch:
    kinds = {"shard": pa.int32(), "drop": pa.bool_(), "prints": pa.binary(), "keys": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array([p[i] for p in parts], t) for i, t in enumerate(kinds.values())], names=list(kinds))


def dealt(rows: np.ndarray, shards: int, drop: bool) -> pa.RecordBatch:
    """Stored keys as a row for each shard that they go to."""
    shard = shard_of(rows, shards)
    order = np.argsort(shard, kind="stable")
    cuts = np.flatnonzero(np.diff(shard[order])) + 1
    return pages([(int(shard[o[0]]), drop, None, rows[o].tobytes()) for o in np.split(order, cuts) if len(o)])


def taken_in(rows: DataFrame, shards: int, version: int, drop: bool) -> DataFrame:
    """PAGE without fingerprints: the digests of ``digests``, each once a partition (or once
    for each HELD_KEYS of them), for their shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = CuckooFilter()
        for batch in batches:
            if not batch.num_rows:
                continue
            new = np.zeros((batch.num_rows, WIDTH), np.int64)
            new[:, :4] = np.frombuffer(b"".join(batch.column(2).to_pylist()), ">i8").reshape(-1, 4)
            new[:, 4] = batch.column(1).is_valid().to_numpy(zero_copy_only=False)
            new[:, 5] = batch.column(1).fill_null(0).to_numpy()
            new[:, 6], new[:, 7], new[:, COUNT] = version, batch.column(0).to_numpy(), 1
            held.absorb(new)
            if held.live >= HELD_KEYS:
                yield dealt(held.stored_keys(), shards, drop)
                held = CuckooFilter()
        if held.live:
            yield dealt(held.stored_keys(), shards, drop)

    return rows.select("row", "doc_id", "digest").mapInArrow(run, PAGE)


def dealt_anew(old: DataFrame, shards: int) -> DataFrame:
    """The stored keys of an index for another number of shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys in batch.column(3):
                rows = np.frombuffer(keys.as_py(), np.int64).reshape(-1, WIDTH)
                if len(rows):
                    yield dealt(rows, shards, False)

    return old.mapInArrow(run, PAGE)


def merged(changes: DataFrame) -> DataFrame:
    """The shards after ``changes``: a shard's own page comes first, then what it takes in, then
    what it drops."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, now = None, None
        for batch in batches:
            for number, drop, prints, keys in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if number != shard:
                    if now is not None:
                        yield pages([(shard, False, now.prints.tobytes(), now.stored_keys().tobytes())])
                    shard, now = number, CuckooFilter()
                if prints is not None:
                    now = CuckooFilter.opened(prints, keys)
                else:
                    rows = np.frombuffer(keys, np.int64).reshape(-1, WIDTH)
                    now.delete(rows) if drop else now.absorb(rows)
        if now is not None:
            yield pages([(shard, False, now.prints.tobytes(), now.stored_keys().tobytes())])

    order = ["shard", "drop", F.col("prints").isNull()]
    return changes.repartition("shard").sortWithinPartitions(*order).mapInArrow(run, PAGE)


def updated(index: Index | None, rows: DataFrame, drop: bool = False) -> Index:
    """The next version of an index after the documents of ``digests`` came in, or went."""
    n = rows.count()
    version, have = (index.version + 1, index.documents) if index else (1, 0)
    shards = index.shards if index else 1
    while not drop and have + n > shards * SHARD_KEYS:
        shards *= 2
    changes = taken_in(rows, shards, version, drop)
    if index:
        changes = (index.pages if shards == index.shards else dealt_anew(index.pages, shards)).union(changes)
    return Index(stored(merged(changes), f"cuckoo-v{version}"), shards, version, have if drop else have + n)


def insert(index: Index | None, docs: DataFrame) -> Index:
    """``index`` (None: an empty one) with the texts of ``docs`` (doc_id, text) live."""
    return updated(index, digests(docs))


def delete(index: Index, docs: DataFrame) -> Index:
    """``index`` without the texts of ``docs``, however many documents had them; texts that
    aren't live change nothing."""
    return updated(index, digests(docs), True)


def live(index: Index) -> DataFrame:
    """digest, keep_id, version and row of the document that stays, group_size of each live digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys in batch.column(3):
                rows = np.frombuffer(keys.as_py(), np.int64).reshape(-1, WIDTH)
                raw = np.ascontiguousarray(rows[:, :4].astype(">i8")).tobytes()
                columns = [pa.array([raw[i : i + 32] for i in range(0, len(raw), 32)], pa.binary()), pa.array(rows[:, 5], mask=rows[:, 4] == 0), pa.array(rows[:, 6]), pa.array(rows[:, 7]), pa.array(rows[:, COUNT])]
                yield pa.RecordBatch.from_arrays(columns, names=["digest", "keep_id", "version", "keep_row", "group_size"])

    return index.pages.mapInArrow(run, "digest binary, keep_id long, version long, keep_row long, group_size long")


def judged(index: Index, rows: DataFrame) -> DataFrame:
    """``rows`` (of ``digests``, the last that ``index`` took in) with keep_id, group_size, kept.

    Digests of one document need no row of the index. Those of more than HOT of all documents
    (1,000 digests at most, whatever the data) are broadcast, so no key of the join is frequent."""
    groups = stored(live(index).where((F.col("group_size") > 1) | (F.col("version") < index.version)), "groups")
    hot = groups.where(F.col("group_size") > HOT * index.documents)
    cold = groups.where(F.col("group_size") <= HOT * index.documents)
    own = (F.col("version") == index.version) & (F.col("keep_row") == F.col("row"))
    out = ["row", "doc_id", "digest", F.when(F.col("version").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), (F.col("version").isNull() | own).alias("kept")]
    some = rows.join(F.broadcast(hot), "digest").select(*out)
    rest = rows.join(F.broadcast(hot.select("digest")), "digest", "left_anti").join(cold.hint("merge"), "digest", "left").select(*out)
    return some.union(rest)


def deduplicate(docs: DataFrame, index: Index | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of each row of ``docs`` (doc_id, text).

    Texts are equal if they are after A-Z became lower case; null counts as empty. Of equal
    texts the row with the largest doc_id stays, of several with that doc_id one (the last
    read); rows without doc_id come before all others, so keep_id is null where no row has one.
    With an ``index``, documents that it has count too, and may be what stays. doc_ids are whole
    numbers. Rows that repeat doc_id and text are documents of their own. An empty table gives
    no rows. Other columns aren't read.
    """
    small_batches(docs.sparkSession)
    rows = digests(docs)
    found = judged(updated(index, rows), rows)
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def drop_duplicates(docs: DataFrame, index: Index | None = None) -> tuple[DataFrame, Index]:
    """The rows of ``docs`` that stay, with all their columns, and the index with them taken in."""
    small_batches(docs.sparkSession)
    name = free_name(docs, "_row")
    numbered = stored(docs.withColumn(name, F.monotonically_increasing_id()), "numbered")
    text = F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER)
    rows = stored(numbered.select(F.col(name).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest")), "digests")
    index = updated(index, rows)
    gone = judged(index, rows).where("not kept").select(F.col("row").alias(name))
    return numbered.join(gone, name, "left_anti").drop(name), index
