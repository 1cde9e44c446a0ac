"""Near-duplicate groups by circulant MinHash, banding, and exact Jaccard verification.

Signatures: a shingle's hash is permuted once (sigma) to a place on a circle of 2^32, and
coordinate k of a text's signature is the least value of the second permutation (pi) over
its places shifted by k. Two permutations so serve all coordinates.

Texts with equal shingle sets form a class, of which only the smallest doc_id goes on.
Classes that agree in all rows of a band share a bucket. No bucket's pairs are listed:

1. Every member is compared, on full sets, with the bucket's centre c, the member that
   meets most others in all its buckets.
2. A member u without a link to c may still be linked with another member v. Sizes say how
   many shingles u and v must share, |u & c| how many of these c can have: the rest, t, lie
   outside c. Where t >= 1, u looks up its rarest shingles outside c, all but t - 1, among
   those of the other members, and meets who has one. Where t < 1, u meets v directly.
   Pairs that are in one component by then are left out.

This loses no link of a bucket, and a large group of near copies costs about its size, not
its square.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from catchment.llm.common import broadcast_if_small, free_name, mixed, small_batches, stored

#: Signature: BANDS bands of ROWS coordinates. A pair of similarity 0.8 shares no band with
#: probability (1 - 0.8^ROWS)^BANDS.
BANDS, ROWS = 40, 5
#: Distinct words that a Python worker keeps the hashes of.
MEMORY_WORDS = 200_000
#: Shingles whose signatures are worked on together, so that arrays stay in cache.
CHUNK = 1 << 15


class WordHashes(dict):
    """Word -> 64-bit hash, kept while there is room."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) >= MEMORY_WORDS:
            self.clear()
        self[word] = h
        return h

    def of(self, text: str) -> np.ndarray:
        """Hashes of a text's words: split at ASCII white space, A-Z lower-cased."""
        words = text.encode().lower().split()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted hashes of the distinct k-word shingles; fewer words are one shingle."""
    if not len(words):
        return words
    n = min(k, len(words))
    h = np.full(len(words) - n + 1, n, np.uint64)
    for j in range(n):
        h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + words[j : len(words) - n + 1 + j])
    return np.unique(h)


def signatures(sets: list[np.ndarray], size: int) -> np.ndarray:
    """One row of ``size`` coordinates for each non-empty set."""
    starts = np.cumsum([0, *(len(s) for s in sets[:-1])])
    place = mixed(np.concatenate(sets)).astype(np.uint32)  # sigma
    out = np.empty((len(sets), size), np.uint32)
    a, b = np.empty_like(place), np.empty_like(place)
    for k in range(size):
        np.add(place, np.uint32(k), out=a)  # the circular shift, mod 2^32
        np.right_shift(a, np.uint32(16), out=b)  # pi: a bijection of 32-bit numbers
        np.bitwise_xor(a, b, out=a)
        np.multiply(a, np.uint32(0x21F0AAAD), out=a)
        np.right_shift(a, np.uint32(15), out=b)
        np.bitwise_xor(a, b, out=a)
        np.multiply(a, np.uint32(0x735A2D97), out=a)
        np.right_shift(a, np.uint32(15), out=b)
        np.bitwise_xor(a, b, out=a)
        out[:, k] = np.minimum.reduceat(a, starts)
    return out


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """64-bit key of each band of each signature; the band's number is part of it."""
    parts = signature.reshape(len(signature), bands, rows).astype(np.uint64)
    h = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(signature), bands)).copy()
    for r in range(rows):
        h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, r])
    return h.view(np.int64)


def sketch(docs: DataFrame, k: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, set_id (of the shingle set; null if it is empty), bands array<long>."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            sizes, names, keys = [], [], []
            group: list[np.ndarray] = []
            held = 0

            def flush(group: list[np.ndarray], keys: list) -> None:
                if group:
                    keys.extend(band_keys(signatures(group, bands * rows), bands, rows))

            order = []
            for text in texts:
                s = shingles(hashes.of(text.as_py() or ""), k)
                sizes.append(len(s))
                names.append(xxhash.xxh3_128_hexdigest(s.tobytes()) if len(s) else None)
                if len(s):
                    order.append(len(sizes) - 1)
                    group.append(s)
                    held += len(s)
                if held >= CHUNK:
                    flush(group, keys)
                    group, held = [], 0
            flush(group, keys)
            column: list = [None] * len(sizes)
            for i, key in zip(order, keys, strict=True):
                column[i] = key
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(sizes, pa.int64()), pa.array(names, pa.string()), pa.array(column, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "set_id", "bands"]
            )

    rows_ = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows_.mapInArrow(run, "doc_id long, n_shingles long, set_id string, bands array<long>")


def shingle_sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """doc_id, hashes binary (sorted 64-bit) of the documents in ``wanted`` (doc_id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            out = [shingles(hashes.of(t.as_py() or ""), k).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["doc_id", "hashes"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("text").isNotNull())
    rows = rows.join(wanted.hint("shuffle_hash"), "doc_id", "left_semi").mapInArrow(run, "doc_id long, hashes binary")
    return rows.groupBy("doc_id").agg(F.first("hashes").alias("hashes"))  # repeated rows


def compared(pairs: DataFrame, sets: DataFrame, outside: bool = False) -> DataFrame:
    """``pairs`` (a, b) with ``both``, the size of the intersection of their full sets, and
    with ``outside`` the hashes of b that a lacks."""
    schema = "a long, b long, both long" + ", own array<long>" * outside

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both, own = [], []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                hit = x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y
                both.append(int(np.count_nonzero(hit)))
                if outside:
                    own.append(y[~hit].view(np.int64))
            out = [batch.column(0), batch.column(1), pa.array(both, pa.int64())] + [pa.array(own, pa.list_(pa.int64()))] * outside
            yield pa.RecordBatch.from_arrays(out, names=["a", "b", "both", "own"][: len(out)])

    left, right = sets.withColumnsRenamed({"doc_id": "a", "hashes": "x"}), sets.withColumnsRenamed({"doc_id": "b", "hashes": "y"})
    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, schema)


def components(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(node, label): the smallest node that each node reaches over stored ``edges`` (a, b).

    ``labels`` (node, label) are labels to begin with. Each step takes the least label of
    all neighbours, then the label of the label; steps grow with the logarithm of a
    component's width about. Every step is a stored table."""
    both = stored(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = stored(labels, "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = stored(labels.join(near, "node", "left").select("node", F.least("label", "near").alias("new"), F.col("label").alias("old")), "label-step")
        # jump: the new label of the node that is one's label
        heads = step.where("node != new").select(F.col("node").alias("head"), F.col("new").alias("beyond"))
        jumped = stored(step.join(heads, step["new"] == heads["head"], "left").select("node", F.least("new", "beyond").alias("label"), (F.least("new", "beyond") != F.col("old")).alias("moved")), "label-jump")
        labels = jumped.select("node", "label")
        if jumped.where("moved").isEmpty():
            return labels


def groups(docs: DataFrame, k: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, class_id of each row of ``docs`` (doc_id, text).

    component_id is the smallest doc_id reachable over links; kept marks it. Texts that are
    null or without words have no shingles and stand alone. Texts of fewer than k words are
    one shingle, equal only to equal ones. Rows that repeat a doc_id should repeat its text;
    they give a row each. Null doc_ids take no part: such a row is in the component of texts
    equal to its own, if a row with a doc_id has one, else its component_id and kept are null.
    An empty table gives no rows. Other columns aren't read.
    """
    small_batches(docs.sparkSession)
    sketched = stored(sketch(docs, k, bands, rows), "sketch")
    classes = sketched.where(F.col("set_id").isNotNull()).groupBy("set_id").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("docs"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    classes = stored(classes.where("class_id is not null"), "classes")
    cells = classes.select(F.explode("bands").alias("key"), F.col("class_id").alias("node"), "n")
    shared = stored(cells.groupBy("key").agg(F.count("*").alias("members")).where("members > 1"), "shared-keys")
    cells = stored(cells.join(shared, "key").select("key", "node", "n", "members"), "cells")
    nodes = stored(cells.groupBy("node").agg(F.sum("members").alias("meets")), "nodes")
    sets = stored(shingle_sets(docs, nodes.select(F.col("node").alias("doc_id")), k), "sets")
    linked = F.col("both") * (100 + percent) >= (F.col("na") + F.col("nb")) * percent

    # every member with the centre of its bucket
    most = F.max(F.struct("meets", (-F.col("node")).alias("neg"), "n"))
    centres = stored(cells.join(nodes, "node").groupBy("key").agg(most.alias("c")).select("key", (-F.col("c.neg")).alias("a"), F.col("c.n").alias("na")), "centres")
    stars = stored(cells.join(centres, "key").where("node != a").select("a", "na", F.col("node").alias("b"), F.col("n").alias("nb")).distinct(), "stars")
    star = stored(stars.join(compared(stars, sets), ["a", "b"]).withColumn("linked", linked), "compared")
    labels = components(star.where("linked"), nodes.select("node", F.col("node").alias("label")))

    # members without a link to the centre, in groups that aren't one component
    # (of two such members, the one of the smaller component looks up)
    weight = stored(labels.groupBy("label").agg(F.count("*").alias("size")), "component-sizes")
    weighed = stored(labels.join(broadcast_if_small(weight), "label").select(F.col("node").alias("b"), F.struct("size", "label").alias("component")), "weighed")
    inner = stored(star.join(weighed, "b"), "labelled")
    open_ = inner.groupBy("a").agg(F.min("component").alias("low"), F.max("component").alias("top"), F.min("linked").alias("all"), F.max(F.when(F.col("linked"), F.col("component"))).alias("home"), F.min("nb").alias("floor")).where("low != top and not all").select("a", "top", "home", "floor")
    rest = stored(inner.join(stored(open_, "open"), "a"), "rest")
    looks = ~F.col("linked") & ((F.col("component") < F.col("top")) | F.coalesce(F.col("home") != F.col("component"), F.lit(False)))
    rest = rest.withColumn("looks", looks)

    def needed(x: Column, y: Column) -> Column:
        """Shared shingles that link sets of these sizes."""
        return F.ceil((x + y) * percent / (100 + percent))

    # sizes up to ``direct``: what u shares with c is enough for a link
    rest = rest.withColumn("direct", F.floor(F.col("both") * (100 + percent) / percent) - F.col("nb"))
    own = rest.join(compared(rest, sets, outside=True).select("a", "b", "own"), ["a", "b"])
    own = stored(own.select("a", "b", "nb", "both", "linked", "component", "looks", "direct", "floor", F.explode("own").alias("shingle")), "outside")
    shared_ = stored(own.groupBy("a", "shingle").agg(F.count("*").alias("members")).where("members > 1"), "outside-shared")
    # the smallest v that isn't met directly, how many shingles outside c it must share, and
    # so how many of u's may be left out
    smallest = F.greatest("floor", F.ceil(F.col("nb") * percent / 100), F.col("direct") + 1)
    least = F.greatest(needed(F.col("nb"), smallest) - F.col("both"), F.lit(1))
    rank = F.row_number().over(Window.partitionBy("a", "b").orderBy(F.coalesce("members", F.lit(1)), "shingle"))
    probes = own.where("looks").join(shared_, ["a", "shingle"], "left").withColumn("rank", rank)
    probes = probes.where((F.col("rank") <= F.col("nb") - F.col("both") - least + 1) & F.col("members").isNotNull())
    names = [F.col("b").alias("u"), F.col("nb").alias("nu"), F.col("both").alias("wu"), F.col("component").alias("cu")]
    probes = stored(probes.select("a", "shingle", *names), "probes")
    open_pair = (F.col("component") != F.col("cu")) & (F.col("linked") | (F.col("cu") < F.col("component"))) & (F.least("nb", "nu") * 100 >= F.greatest("nb", "nu") * percent)
    meet = own.select("a", "shingle", "b", "nb", "linked", "component").join(probes, ["a", "shingle"]).where(open_pair).select("u", "nu", "b", "nb")
    close = rest.where("looks and direct >= floor").select("a", *names)
    close = rest.select("a", "b", "nb", "both", "linked", "component").join(close, "a")
    close = close.where(open_pair & (needed(F.col("nb"), F.col("nu")) <= F.least("both", "wu"))).select("u", "nu", "b", "nb")
    meet = meet.union(close)
    u, v = F.struct(F.col("u").alias("node"), F.col("nu").alias("n")), F.struct(F.col("b").alias("node"), F.col("nb").alias("n"))
    pairs = meet.select(F.least(u, v).alias("x"), F.greatest(u, v).alias("y")).distinct()
    pairs = stored(pairs.select(F.col("x.node").alias("a"), F.col("x.n").alias("na"), F.col("y.node").alias("b"), F.col("y.n").alias("nb")), "pairs")
    more = stored(pairs.join(compared(pairs, sets), ["a", "b"]).where(linked), "found")
    if not more.isEmpty():
        labels = components(more.union(star.where("linked").select(more.columns)), labels)

    # only classes of several documents, or with links to others, need a row
    heads = stored(labels.where("node != label").select(F.col("node").alias("class_id"), "label"), "heads")
    placed = classes.select("set_id", "class_id", "docs").join(broadcast_if_small(heads), "class_id", "left").where("docs > 1 or label is not null")
    place = stored(placed.select("set_id", "class_id", F.coalesce("label", "class_id").alias("component")), "placed")
    component = F.coalesce("component", "doc_id")
    rows = sketched.select("doc_id", "n_shingles", "set_id").join(broadcast_if_small(place), "set_id", "left")
    return rows.select("doc_id", "n_shingles", component.alias("component_id"), (component == F.col("doc_id")).alias("kept"), F.coalesce("class_id", "doc_id").alias("class_id"))


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with ``name``: the place of each (doc_id, text) among all of them, in the order of
    doc_id; equal rows share it, rows without doc_id have none."""
    hashed = free_name(docs, "hashed")
    text = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    docs = docs.withColumn(hashed, F.when(F.col("doc_id").isNotNull(), F.concat(F.col("text").isNull().cast("string"), text)))
    keys = stored(docs.where(F.col("doc_id").isNotNull()).select("doc_id", hashed).distinct(), "keys")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, part = 0, TaskContext.get().partitionId()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(batch), part, np.int32)), pa.array(np.arange(n, n + len(batch)))], names=[*batch.schema.names, "part", "place"])
            n += len(batch)

    kind = keys.schema["doc_id"].dataType.simpleString()
    sorted_ = keys.repartitionByRange("doc_id", hashed).sortWithinPartitions("doc_id", hashed)
    places = stored(sorted_.mapInArrow(run, f"doc_id {kind}, {hashed} string, part int, place long"), "places")
    sizes, before, rows = sorted(map(tuple, places.groupBy("part").agg(F.count("*")).collect())), 0, []  # a row a partition
    for part, n in sizes:
        rows.append((part, before))
        before += n
    starts = docs.sparkSession.createDataFrame(rows, "part int, start long")
    places = places.join(F.broadcast(starts), "part").select("doc_id", hashed, (F.col("start") + F.col("place")).alias(name))
    return docs.join(places, ["doc_id", hashed], "left").drop(hashed)


def keep_first(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """Rows of ``docs`` without those of which a near duplicate with a smaller doc_id stays.

    Of rows that repeat doc_id and text one stays, or none; rows of one doc_id with other texts
    are documents of their own; a row without doc_id stands for itself and stays. Texts that
    are null, empty or of a few words are near duplicates of equal ones only (null and empty
    ones of none). Columns of any name pass through."""
    ids = docs.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count("*").alias("n"), F.min(F.xxhash64("text")).alias("a"), F.max(F.xxhash64("text")).alias("b"))
    twice = stored(ids.where("n > 1").select("doc_id", (F.col("a") != F.col("b")).alias("other_texts")), "repeated-ids")
    if not twice.where("other_texts").isEmpty():
        name = free_name(docs, "place")
        rows = stored(numbered(docs, name), "numbered")
        found = stored(groups(rows.select(F.col(name).alias("doc_id"), "text"), k, percent), "grouped")
        gone = found.where("not kept").select(F.col("doc_id").alias(name)).distinct()
        left = rows.join(gone.hint("shuffle_hash"), name, "left_anti")
        one = left.where(F.col(name).isNotNull()).dropDuplicates([name])
        return one.unionByName(left.where(F.col(name).isNull())).select(*[F.col(f"`{c}`") for c in docs.columns])
    found = groups(docs, k, percent)
    gone = stored(found.where("not kept").select(F.col("doc_id").alias("_gone_")).distinct(), "duplicates")
    rows = docs.join(gone.hint("shuffle_hash"), docs["doc_id"] == gone["_gone_"], "left_anti")
    if twice.isEmpty():
        return rows
    same = rows["doc_id"] == twice["doc_id"]
    return rows.join(twice, same, "left_anti").unionByName(rows.join(twice, same, "left_semi").dropDuplicates(["doc_id"]))
