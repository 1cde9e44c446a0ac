"""Sharding by fixed virtual slots.

A record's slot is a hash of its doc_id and text, one of ``SLOTS``. Equal records that would
make a slot heavier than its share are dealt over several slots. Spark sums bytes and rows for
each slot; the slot-to-shard map (SLOTS rows, whatever the data) is balanced on the driver,
stored with its version in the shared folder, and joined to the records. When shards are
added or sizes drift, the last stored version is loaded, edited and stored as the next: as few
slots as are needed move, and no record is hashed anew.
"""

from __future__ import annotations

import heapq

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from catchment.llm.common import new_path, stored

SLOTS = 8192


def record_size() -> Column:
    """UTF-8 bytes of the text (null: none) plus 1."""
    return F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1


def records(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, vslot of each row, stored.

    Records are told apart by doc_id and text. Those that repeat so often that their bytes are
    more than a slot's share of all are dealt over as many slots as they make shares; there are
    ``slots`` such records at most, whatever the data."""
    rows = stored(docs.select(
        "doc_id", record_size().alias("size"), F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64("doc_id", "text").alias("key"), F.monotonically_increasing_id().alias("row"),
    ), "records")
    total = rows.agg(F.sum("size")).first()[0] or 0
    pieces = F.ceil(F.sum("size") * slots / F.lit(max(total, 1))).cast("int")
    heavy = rows.groupBy("key").agg(F.count("*").alias("n"), F.least(pieces, F.lit(slots)).alias("pieces")).where("n > 1 and pieces > 1").select("key", "pieces")
    copy = F.coalesce(F.pmod(F.xxhash64("row"), "pieces"), F.lit(0))
    whole = F.when(copy == 0, F.col("key")).otherwise(F.xxhash64("key", copy))
    return rows.join(F.broadcast(heavy), "key", "left").select("doc_id", "size", "text_crc32", "row", F.pmod(whole, F.lit(slots)).cast("int").alias("vslot"))


def slot_sizes(rows: DataFrame) -> dict[int, tuple[int, int]]:
    """slot -> (bytes, rows), for slots with rows: SLOTS entries at most."""
    found = rows.groupBy("vslot").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()
    return {r["vslot"]: (r["b"], r["n"]) for r in found}


def first_map(sizes: dict[int, tuple[int, int]], shards: int, slots: int = SLOTS) -> list[int]:
    """Shard of each slot: the largest slot first, each to the shard with the fewest bytes."""
    heap = [(0, 0, k) for k in range(shards)]
    out = [0] * slots
    for slot in sorted(range(slots), key=lambda s: (-sizes.get(s, (0, 0))[0], s)):
        load, n, k = heapq.heappop(heap)
        out[slot] = k
        heapq.heappush(heap, (load + sizes.get(slot, (0, 0))[0], n + 1, k))
    return out


def edited_map(old: list[int], sizes: dict[int, tuple[int, int]], shards: int, slack: float = 0.01) -> list[int]:
    """The map for ``shards`` shards with few moves: from the fullest shard to the emptiest,
    the largest slot that fits into half their gap, until loads are within ``slack``."""
    new = list(old)
    loads, members = [0] * shards, [[] for _ in range(shards)]
    weight = lambda s: sizes.get(s, (0, 0))[0]
    for s, k in enumerate(new):
        if k >= shards:  # its shard is gone
            k = new[s] = min(range(shards), key=loads.__getitem__)
        loads[k] += weight(s)
        members[k].append(s)
    target = sum(loads) / shards
    for _ in range(len(new)):
        top, low = max(range(shards), key=loads.__getitem__), min(range(shards), key=loads.__getitem__)
        gap = loads[top] - loads[low]
        if gap <= slack * target:
            break
        fits = [s for s in members[top] if 0 < weight(s) <= gap / 2]
        if not fits:
            break
        s = max(fits, key=lambda x: (weight(x), -x))
        members[top].remove(s)
        members[low].append(s)
        new[s] = low
        loads[top] -= weight(s)
        loads[low] += weight(s)
    return new


MAP = "vslot int, shard int, before long, bytes long"


def store_map(spark: SparkSession, path: str, version: int, shards: list[int], sizes: dict[int, tuple[int, int]]) -> DataFrame:
    """Write one version of the map under ``path``, with for each slot the number of rows that
    stand before it in its shard: (vslot, shard, before, bytes)."""
    before, rows = [0] * (max(shards, default=0) + 1), []
    for s, k in enumerate(shards):
        b, n = sizes.get(s, (0, 0))
        rows.append((s, k, before[k], b))
        before[k] += n
    where = f"{path}/version={version}"
    spark.createDataFrame(rows, MAP).coalesce(1).write.parquet(where)
    return spark.read.schema(MAP).parquet(where)


def load_map(spark: SparkSession, path: str) -> tuple[int, list[int]] | None:
    """The last version stored under ``path``, and the shard of each slot in it; None if there is none."""
    try:
        rows = spark.read.parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    version = rows.agg(F.max("version")).first()[0]
    last = rows.where(F.col("version") == version).select("vslot", "shard").collect()  # a row a slot
    return version, [k for _, k in sorted((r["vslot"], r["shard"]) for r in last)]


def next_map(spark: SparkSession, path: str, sizes: dict[int, tuple[int, int]], shards: int, slots: int = SLOTS) -> tuple[int, DataFrame]:
    """The version stored after the last under ``path``: that one edited for ``shards`` shards and
    today's sizes, or the first."""
    last = load_map(spark, path)
    version, placed = (1, first_map(sizes, shards, slots)) if last is None else (last[0] + 1, edited_map(last[1], sizes, shards))
    return version, store_map(spark, path, version, placed, sizes)


def shard(docs: DataFrame, shards: int = 16, slots: int = SLOTS, path: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, vslot of each row.

    Law ``bytes``: shard sizes are as near equal as whole slots allow; a record larger than
    a shard's share makes its shard larger. ``slot`` is the record's place in its shard,
    0 to rows - 1. Equal texts (groups) under different doc_ids are records like any other and
    may go to different shards: the law is about bytes, not groups. Rows that repeat doc_id and
    text are records of their own, however many; null doc_ids are dealt by their texts; a null
    text has size 1 and the crc32 of nothing, 0. An empty table gives no rows. grown_shard is
    null (only law ``key`` has it). ``path`` keeps the map's versions: the last one stored there
    is edited; without it the map is the first of a path of its own.
    """
    spark = docs.sparkSession
    rows = stored(records(docs, slots), "placed")
    _, placed = next_map(spark, path or new_path(spark, "slot-map"), slot_sizes(rows), shards, slots)
    place = F.row_number().over(Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "row")) - 1  # a slot's share of rows
    # the map has ``slots`` rows, whatever the data
    return rows.withColumn("place", place).join(F.broadcast(placed.select("vslot", "shard", "before")), "vslot").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("place")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "vslot"
    )


def rebalanced(docs: DataFrame, shards: int, path: str, slots: int = SLOTS) -> DataFrame:
    """doc_id, vslot, shard, new_shard, version of each row, after the map under ``path`` was
    edited for ``shards`` shards; at most a few slots more than the new shards' share move."""
    spark = docs.sparkSession
    rows = stored(records(docs, slots), "placed")
    sizes, old = slot_sizes(rows), load_map(spark, path)
    if old is None:
        raise ValueError(f"no map is stored at {path}")
    was = spark.read.schema(MAP).parquet(f"{path}/version={old[0]}").select("vslot", "shard")
    version, now = next_map(spark, path, sizes, shards, slots)
    both = was.join(now.select("vslot", F.col("shard").alias("new_shard")), "vslot")
    return rows.join(F.broadcast(both), "vslot").select("doc_id", "size", "vslot", "shard", "new_shard", F.lit(version).alias("version"))
