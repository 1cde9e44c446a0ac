"""Repeated passages by sparse suffix arrays.

A text is a sequence of words (ASCII white space splits, A-Z lower-cased), each a 64-bit
hash. Of its suffixes only those at minimisers stay: the K-gram with the least hash of
every SPAN consecutive ones. A passage of LEAST words holds minimisers that all its copies
select too, wherever they stand.

1. Sort the retained suffixes by their first K words, keep those with an equal neighbour
   (rows at the ends of sorted partitions stay as well: the next step decides).
2. A window of LEAST words can only repeat if every minimiser inside it was kept. Sort the
   hashes of all such windows: each with an equal neighbour is matched with the first of its
   run, whatever else stands around it in its text.
3. Matches that go on at the same distance join: each is thereby extended left and right to
   a stretch of one document that should equal a stretch of another.
4. The words of both stretches are compared by SHA-256. Where they differ, two windows had
   the same hash, and all windows of that hash are told apart by SHA-256 of their words.
5. Overlapping stretches of a document merge into passages. Of the copies of a window the
   first, by doc_id and position, stays; ``removed`` cuts the words of the others.

Sorting is by range over (hash, doc_id, position), so a passage that is in a third of all
documents is spread over many tasks, and each row meets two neighbours, however often its
passage occurs.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from catchment.llm.common import free_name, mixed, small_batches, stored
from catchment.llm.minhash import WordHashes

#: Words of a repeat at least; words that decide where suffixes stay; K-grams of a window.
LEAST, K, SPAN = 50, 10, 24
#: Words of a document whose stretches are read together.
BLOCK = 4096


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of the ``k`` words from each position on: two halves of a power of 2, which may overlap."""
    h, width = words, 1
    while h.size and width < k:
        step = min(width, k - width)
        h = mixed(h[:-step] * np.uint64(0x9E3779B97F4A7C15) + h[step:]) if h.size > step else h[:0]
        width += step
    return h


def selected(h: np.ndarray, span: int) -> np.ndarray:
    """The position of the least of ``span`` values from each position on, the first on ties.

    Values are compared by their upper 32 bits: the lower ones hold the position."""
    least, width = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64), 1
    while width < span:
        step = min(width, span - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    return (least & np.uint64(0xFFFFFFFF)).astype(np.int64)


def minimisers(words: np.ndarray, k: int = K, span: int = SPAN) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the minimisers of a text, and the hash of the K-gram at each."""
    h = grams(words, k)
    if not h.size:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    pos = np.unique(selected(h, min(span, len(h))))
    return pos, h[pos]


def suffixes(docs: DataFrame, k: int = K, span: int = SPAN) -> DataFrame:
    """key (hash of a suffix's first K words), doc_id, pos of the retained suffixes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            keys, ids, places = [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                pos, h = minimisers(hashes.of(text.as_py() or ""), k, span)
                keys.append(h.view(np.int64))
                places.append(pos)
                ids.append(np.full(len(pos), doc_id, np.int64))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (keys, ids, places)], names=["key", "doc_id", "pos"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    return rows.mapInArrow(run, "key long, doc_id long, pos long")


def with_equal_neighbour(rows: DataFrame) -> DataFrame:
    """doc_id, pos of the sorted suffixes whose key equals a neighbour's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None  # the last row of the batch before, with whether it is kept
        kept = True
        for batch in batches:
            if not len(batch):
                continue
            keys = batch.column(0).to_numpy()
            same = keys[1:] == keys[:-1]
            keep = np.zeros(len(keys), bool)
            keep[1:] |= same
            keep[:-1] |= same
            if held is None:
                keep[0] = True
            else:
                equal = held.column(0)[0].as_py() == keys[0]
                keep[0] |= equal
                if kept or equal:
                    yield held.select(["doc_id", "pos"])
            yield batch.slice(0, len(batch) - 1).filter(pa.array(keep[:-1])).select(["doc_id", "pos"])
            held, kept = batch.slice(len(batch) - 1), bool(keep[-1])
        if held is not None:
            yield held.select(["doc_id", "pos"])

    ranged = rows.repartitionByRange("key", "doc_id", "pos").sortWithinPartitions("key", "doc_id", "pos")
    return ranged.mapInArrow(run, "doc_id long, pos long")


def windows(docs: DataFrame, places: DataFrame, least: int = LEAST, k: int = K, span: int = SPAN, bits: int = 64) -> DataFrame:
    """key (hash of ``least`` words, of ``bits`` bits), doc_id, pos of the windows whose
    minimisers are all in ``places`` (doc_id, pos)."""
    inner = least - k - span + 2  # sets of span K-grams inside a window

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            keys, ids, starts, held = [], [], [], 0
            for doc_id, text, pos in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                w = hashes.of(text.as_py())
                if len(w) < least:
                    continue
                h = grams(w, k)
                kept = np.zeros(max(len(h), pos.values.to_numpy().max() + 1), np.int64)
                kept[pos.values.to_numpy()] = 1
                count = np.concatenate([[0], np.cumsum(kept[selected(h, span)])])
                at = np.flatnonzero(count[inner:] - count[:-inner] == inner)
                keys.append((grams(w, least)[at] >> np.uint64(64 - bits)).view(np.int64))
                ids.append(np.full(len(at), doc_id, np.int64))
                starts.append(at)
                held += len(at)
                if held > 200_000:
                    yield pack(keys, ids, starts)
                    keys, ids, starts, held = [], [], [], 0
            if held:
                yield pack(keys, ids, starts)

    def pack(*columns: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in columns], names=["key", "doc_id", "pos"])

    owned = places.groupBy("doc_id").agg(F.collect_set("pos").alias("pos"))  # of one text
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("text").isNotNull())
    return rows.join(owned.hint("shuffle_hash"), "doc_id").select("doc_id", "text", "pos").mapInArrow(run, "key long, doc_id long, pos long")


MATCH = ["doc_id", "pos", "other_id", "other_pos", "key"]


def equal_runs(key: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> list[np.ndarray]:
    """MATCH of the sorted rows whose key others share; the other is the first row of the run,
    for that the second. Equal rows count once."""
    if len(key) < 2:
        return [key[:0]] * 5
    fresh = np.concatenate([[True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1]) | (pos[1:] != pos[:-1])])
    key, doc, pos = key[fresh], doc[fresh], pos[fresh]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.append(first, len(key)))
    other = np.repeat(first, size)
    many = first[size > 1]
    other[many] = many + 1
    keep = np.repeat(size > 1, size)
    other = other[keep]
    return [doc[keep], pos[keep], doc[other], pos[other], key[keep]]


def repeated(rows: DataFrame) -> DataFrame:
    """MATCH of the sorted windows (key, doc_id, pos) whose key others share, and, without
    other_id, the first and last row of every partition, whose other neighbour another task has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 3  # the first and the last row of the last key
        start = True
        for batch in batches:
            if not len(batch):
                continue
            new = [c.to_numpy() for c in batch.columns]
            if start:
                yield pack(new[1][:1], new[2][:1], None, None, new[0][:1])
                start = False
            rows = [np.concatenate([a, b]) for a, b in zip(held, new, strict=True)]
            yield pack(*equal_runs(*rows))
            low = int(np.searchsorted(rows[0], rows[0][-1]))
            held = [c[[low, -1]] if len(c) - low > 1 else c[-1:] for c in rows]
        if not start:
            yield pack(held[1][-1:], held[2][-1:], None, None, held[0][-1:])

    def pack(*columns: np.ndarray | None) -> pa.RecordBatch:
        n = len(columns[0])
        return pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()) if c is None else pa.array(c, pa.int64()) for c in columns], names=MATCH)

    ranged = rows.repartitionByRange("key", "doc_id", "pos").sortWithinPartitions("key", "doc_id", "pos")
    return ranged.mapInArrow(run, ", ".join(f"{c} long" for c in MATCH))


def all_matches(found: DataFrame) -> DataFrame:
    """MATCH of ``repeated`` rows, with the matches over the seams of partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [[c.to_numpy() for c in b.columns] for b in batches]
        columns = [np.concatenate(c) for c in zip(*rows, strict=True)] or [np.zeros(0, np.int64)] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in equal_runs(*columns)], names=MATCH)

    # two rows a partition: one task takes them, however large the corpus
    ends = found.where(F.col("other_id").isNull()).select("key", "doc_id", "pos").distinct()
    seams = ends.coalesce(1).sortWithinPartitions("key", "doc_id", "pos").mapInArrow(run, found.schema)
    return found.where(F.col("other_id").isNotNull()).union(seams)


def joined(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, start, end of the unions of rows (keys, start, end) that overlap or touch, with
    the least other_id."""
    order = Window.partitionBy(*keys).orderBy("start")
    reached = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.coalesce((F.col("start") > reached).cast("int"), F.lit(1))
    merged = rows.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return merged.groupBy(*keys, "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("other_id").alias("other_id")).drop("run")


def extended(rows: DataFrame, least: int) -> DataFrame:
    """doc_id, other_id, shift, start, end of the unions of matched windows (doc_id, other_id,
    shift, pos) that overlap or touch."""
    names = ["doc_id", "other_id", "shift", "start", "end"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # the last stretch, which may go on
        for batch in batches:
            if not len(batch):
                continue
            *keys, pos = (c.to_numpy() for c in batch.columns)
            fresh = np.diff(pos, prepend=pos[:1]) > least
            for c in keys:
                fresh[1:] |= c[1:] != c[:-1]
            fresh[0] = True
            first = np.flatnonzero(fresh)
            found = [*(c[first] for c in keys), pos[first], pos[np.append(first[1:], len(pos)) - 1] + least]
            if held:
                if all(h[0] == c[0] for h, c in zip(held[:3], found[:3], strict=True)) and found[3][0] <= held[4][0]:
                    found[3][0] = held[3][0]
                else:
                    found = [np.concatenate([h, c]) for h, c in zip(held, found, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c[:-1]) for c in found], names=names)
            held = [c[-1:] for c in found]
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in held], names=names)

    order = ["doc_id", "other_id", "shift"]
    return rows.repartition(*order).sortWithinPartitions(*order, "pos").mapInArrow(run, ", ".join(f"{c} long" for c in names))


def digests(docs: DataFrame, stretches: DataFrame) -> DataFrame:
    """doc_id, start, end, sha (SHA-256 of the words from start to end) of stretches (doc_id, start, end)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[], [], [], []]
            for doc_id, text, spans in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                words = text.as_py().encode().lower().split()
                for s in spans:
                    for c, x in zip(out, (doc_id, s["start"], s["end"], hashlib.sha256(b" ".join(words[s["start"] : s["end"]])).digest()), strict=True):
                        c.append(x)
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in out[:3]), pa.array(out[3], pa.binary())], names=["doc_id", "start", "end", "sha"])

    lists = stretches.distinct().groupBy("doc_id", F.floor(F.col("start") / BLOCK).alias("block")).agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    return docs.dropDuplicates(["doc_id"]).join(lists, "doc_id").select("doc_id", "text", "spans").mapInArrow(run, "doc_id long, start long, end long, sha binary")


def confirmed(docs: DataFrame, matches: DataFrame, least: int) -> DataFrame:
    """doc_id, start, end, other_id, later of the stretches that stand elsewhere too by their
    words; later: elsewhere is before it, by doc_id and position."""
    shift = F.col("pos") - F.col("other_pos")
    stretches = stored(extended(matches.select("doc_id", "other_id", shift.alias("shift"), "pos"), least), "stretches")
    theirs = stretches.select(F.col("other_id").alias("doc_id"), (F.col("start") - F.col("shift")).alias("start"), (F.col("end") - F.col("shift")).alias("end"))
    sums = stored(digests(docs, stretches.select("doc_id", "start", "end").union(theirs)), "digests")
    other = sums.select(F.col("doc_id").alias("other_id"), F.col("start").alias("other_start"), F.col("end").alias("other_end"), F.col("sha").alias("other_sha"))
    both = stretches.join(sums, ["doc_id", "start", "end"]).withColumns({"other_start": F.col("start") - F.col("shift"), "other_end": F.col("end") - F.col("shift")}).join(other, ["other_id", "other_start", "other_end"])
    later = (F.col("other_id") < F.col("doc_id")) | ((F.col("other_id") == F.col("doc_id")) & (F.col("shift") > 0))
    both = stored(both.select("doc_id", "start", "end", "other_id", "shift", (F.col("sha") == F.col("other_sha")).alias("equal"), later.alias("later")), "compared")
    true, clash = both.where("equal").select("doc_id", "start", "end", "other_id", "later"), both.where("not equal")
    if clash.isEmpty():
        return true
    inside = (F.col("pos") >= F.col("start")) & (F.col("pos") + least <= F.col("end"))
    clash = clash.select("doc_id", "other_id", "shift", "start", "end")
    keys = matches.withColumn("shift", shift).join(clash, ["doc_id", "other_id", "shift"]).where(inside).select("key").distinct()
    places = stored(matches.join(keys, "key").select("doc_id", F.col("pos").alias("start"), (F.col("pos") + least).alias("end")).distinct(), "clashes")
    order = Window.partitionBy("sha").orderBy("doc_id", "start")
    told = digests(docs, places).withColumns({"before": F.lag("doc_id").over(order), "after": F.lead("doc_id").over(order)})
    told = told.select("doc_id", "start", "end", F.coalesce("before", "after").alias("other_id"), F.col("before").isNotNull().alias("later")).where(F.col("other_id").isNotNull())
    return stored(true.union(told), "told-apart")


def found_stretches(docs: DataFrame, least: int, bits: int) -> DataFrame:
    """``confirmed`` of documents (doc_id, text), each with a doc_id of its own."""
    if least < K + SPAN - 1:
        raise ValueError(f"a window of less than {K + SPAN - 1} words may hold no minimiser")
    small_batches(docs.sparkSession)
    # stored, as sorting by range reads its input twice
    flagged = stored(with_equal_neighbour(stored(suffixes(docs), "suffixes")), "flagged").distinct()
    found = stored(repeated(stored(windows(docs, flagged, least, bits=bits), "windows")), "repeated")
    return confirmed(docs, all_matches(found), least)


def identified(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(doc_id, text) with a doc_id for each document, and, where that isn't the table's own, its
    names (key, doc_id).

    The table's own serves if no text is without one and none stands for several texts. Else
    a document's is a 64-bit hash of doc_id and text, or of text and row where there is no doc_id."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null")
    check = rows.groupBy("doc_id").agg(F.min(F.xxhash64("text")).alias("a"), F.max(F.xxhash64("text")).alias("b")).where("doc_id is null or a != b")
    if check.isEmpty():
        return rows, None
    nameless = stored(rows.where("doc_id is null").select("text", F.monotonically_increasing_id().alias("row")), "nameless")
    named = rows.where("doc_id is not null").select(F.xxhash64("doc_id", "text").alias("key"), "doc_id", "text")
    every = named.union(nameless.select(F.xxhash64("text", "row", F.lit("row")).alias("key"), F.lit(None).cast("long").alias("doc_id"), "text"))
    return every.select(F.col("key").alias("doc_id"), "text"), stored(every.select("key", "doc_id").distinct(), "names")


def repeats(docs: DataFrame, least: int = LEAST, bits: int = 64) -> DataFrame:
    """Passages of ``least`` words or more that stand twice or more in the corpus.

    Returns a row for each passage of a document: doc_id, start_word, end_word (exclusive),
    n_words, other_id (a doc_id that a part of it was matched with, the smallest of those met
    in sorted order; doc_id itself if the passage repeats within the document), n_removed
    (words of it that ``removed`` cuts, as they stand before too; where rows have no doc_id of
    their own, "before" is by hashes). Documents without any don't appear. Null texts and
    texts shorter than ``least`` have none. Rows that repeat a doc_id and its text count as one
    document; other texts under one doc_id, and rows without doc_id, are documents of their own,
    whose rows bear what doc_id they have (other_id then is some other of the matched). Copies
    of a document are one passage each.

    A passage is the union of overlapping windows of ``least`` words that each stand elsewhere
    too. All such windows are found, and each by its words: hashes (of ``bits`` bits) only
    bring them together.
    """
    docs, names = identified(docs)
    found = found_stretches(docs, least, bits)
    out = joined(found, ["doc_id"])
    cuts = joined(found.where("later"), ["doc_id"]).select(F.col("doc_id").alias("cut_id"), F.col("start").alias("cut"), (F.col("end") - F.col("start")).alias("n"))
    inside = (F.col("cut_id") == F.col("doc_id")) & (F.col("cut") >= F.col("start")) & (F.col("cut") < F.col("end"))
    out = out.join(cuts, inside, "left").groupBy("doc_id", F.col("start").alias("start_word"), F.col("end").alias("end_word"), (F.col("end") - F.col("start")).alias("n_words"), "other_id").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_removed"))
    if names is None:
        return out
    own, other = names.withColumnsRenamed({"key": "k", "doc_id": "own"}), names.withColumnsRenamed({"key": "k", "doc_id": "other"})
    out = out.join(own, F.col("doc_id") == own["k"]).drop("k").join(other, F.col("other_id") == other["k"], "left")
    return out.select(F.col("own").alias("doc_id"), "start_word", "end_word", "n_words", F.col("other").alias("other_id"), "n_removed")


def without_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the words from start to end of each span, and the white space behind each."""
    raw = text.encode()
    at = [m.start() for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw)] + [len(raw)]
    keep, done = [], 0
    for start, end in sorted(spans):
        keep.append(raw[done : at[start]])
        done = at[end]
    return b"".join([*keep, raw[done:]]).decode()


def removed(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """All rows and columns of ``docs``, with every word cut that stands in a later copy of a
    repeated window of ``least`` words; an n_chars column follows the text.

    The copy that stays is the first by row of the stored table and position, so each
    repeated window is left once, whole or, where its parts are copies of other passages too,
    in these. Rows that repeat each other are copies. Texts of nothing but later copies become
    empty; null texts stay null, and an empty table gives one.
    """
    row = free_name(docs, "row")
    rows = stored(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    found = found_stretches(rows.where("text is not null").select(F.col(row).alias("doc_id"), "text"), least, 64)
    cuts = free_name(rows, "cuts")
    lists = joined(found.where("later"), ["doc_id"]).groupBy(F.col("doc_id").alias(row)).agg(F.collect_list(F.struct("start", "end")).alias(cuts))  # of one text

    @F.pandas_udf("string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([t if s is None else without_spans(t, [(x["start"], x["end"]) for x in s]) for t, s in zip(texts, spans, strict=True)], dtype=object)

    out = rows.join(lists, row, "left")
    kept = {"text": F.when(F.col(cuts).isNull(), F.col("text")).otherwise(cut("text", cuts))}
    if "n_chars" in docs.columns:
        kept["n_chars"] = F.when(F.col(cuts).isNull(), F.col("n_chars")).otherwise(F.length(kept["text"]).cast(docs.schema["n_chars"].dataType))
    return out.select(*[kept[c].alias(c) if c in kept else F.col(f"`{c}`") for c in docs.columns])
