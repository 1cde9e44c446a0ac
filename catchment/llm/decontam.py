"""Benchmark decontamination over a positional inverted index, in DataFrame operations only.

1. Count, over all documents, the words that the benchmark has.
2. For each benchmark window (10 consecutive words of an item, or a shorter item whole)
   take its ``KEYS`` rarest words.
3. Index: a posting (term, key, pos) for every occurrence of such a word in the documents,
   stored in the shared folder. ``key`` stands for a document: 64 bits of doc_id and text, so
   rows that share a doc_id, or have none, are told apart by their texts.
4. Phrases: intersect the postings, each shifted by the word's offset in the item. A place
   where all key words of a window line up is a candidate (key, item, shift), of which the
   whole windows are compared.
5. Proximity: the two rarest words of an item, at most ``WITHIN`` words apart in a document.

The benchmark is the small side. Its terms are broadcast in parts of a measured size, so a
frequent word of the documents is never a shuffle's key; its other tables are broadcast if
their bytes are few, else joined by shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from catchment.llm.common import broadcast_if_small, bytes_held, free_name, stored

#: Words of a window, rarest words of a window that the index is asked for, words between near words.
WINDOW, KEYS, WITHIN = 10, 2, 16
#: MB of a table that is broadcast at once.
PART_MB = 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words of a text: runs of ASCII letters and digits and of all non-ASCII characters,
    A-Z lower-cased. Null has none."""
    # lower() is quick but maps more than A-Z: it is taken where the two can't differ
    low = F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))
    return F.coalesce(F.array_remove(F.split(low, NOT_WORD), ""), F.array().cast("array<string>"))


def doc_key() -> Column:
    """64 bits of doc_id and text; two different rows have equal ones with a chance of 5e-20."""
    return F.xxhash64("doc_id", "text")


def parts_of(df: DataFrame, column: str) -> list[DataFrame]:
    """A stored table in parts by ``column``, each small enough to be broadcast."""
    n = 1 + bytes_held(df) // (PART_MB << 20)
    return [F.broadcast(df.where(F.pmod(F.xxhash64(column), F.lit(n)) == k)) for k in range(n)]


def union(rows: list[DataFrame]) -> DataFrame:
    out = rows[0]
    for more in rows[1:]:
        out = out.unionByName(more)
    return out


def items(benchmark: DataFrame) -> DataFrame:
    """item, item_id (as text; null: empty), iw (words), n (words a window), last (offset of
    the last window); items without words are left out, repeated rows count once."""
    name = F.coalesce(F.col("item_id").cast("string"), F.lit(""))
    rows = benchmark.select(name.alias("item_id"), words(F.col("text")).alias("iw")).where(F.size("iw") > 0).distinct()
    rows = rows.withColumn("n", F.least(F.size("iw"), F.lit(WINDOW)))
    rows = rows.withColumn("last", F.size("iw") - F.col("n"))
    # rows of one item_id may differ in their text: item is the key of a row
    return stored(rows.withColumn("item", F.xxhash64("item_id", "iw")), "benchmark-items")


def term_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """term, count: occurrences in ``docs`` of each of ``terms`` (stored); absent ones have no row."""
    found = docs.select(F.explode(words(F.col("text"))).alias("term"))
    return union([found.join(part, "term", "left_semi").groupBy("term").agg(F.count("*").alias("count")) for part in parts_of(terms, "term")])


def ranked_terms(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """item, n, last, offset, term, count: the places of all items, with how often their words occur."""
    terms = stored(bench.select(F.explode("iw").alias("term")).distinct(), "benchmark-terms")
    counts = stored(term_counts(docs, terms), "term-counts")
    cells = bench.select("item", "n", "last", F.posexplode("iw").alias("offset", "term"))
    return cells.join(broadcast_if_small(counts, PART_MB), "term", "left").fillna(0, ["count"])


def key_words(places: DataFrame) -> DataFrame:
    """item, offset, term, k: the KEYS rarest places (fewest occurrences, then first) of each window k."""
    spread = places.select("item", "offset", "term", "count", F.explode(F.sequence(F.greatest(F.lit(0), F.col("offset") - F.col("n") + 1), F.least("offset", "last"))).alias("k"))
    rank = F.row_number().over(Window.partitionBy("item", "k").orderBy("count", "offset"))
    return spread.withColumn("rank", rank).where(F.col("rank") <= KEYS).select("item", "offset", "term", "k")


def index(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """The positional index of ``terms`` (stored): (term, key, pos), in the shared folder."""
    rows = docs.select(doc_key().alias("key"), F.posexplode(words(F.col("text"))).alias("pos", "term"))
    return stored(union([rows.join(part, "term", "left_semi") for part in parts_of(terms, "term")]), "postings")


def candidates(postings: DataFrame, keys: DataFrame) -> DataFrame:
    """key, item, shift: alignments where all key words of some window line up."""
    places = stored(keys.select("item", "offset", "term").distinct(), "key-places")
    needs = stored(keys.groupBy("item", "k").agg(F.sort_array(F.collect_list("offset")).alias("need")).groupBy("item").agg(F.collect_set("need").alias("needs")), "key-needs")
    lined_up = (
        postings.join(broadcast_if_small(places, PART_MB), "term")
        .groupBy("key", "item", (F.col("pos") - F.col("offset")).alias("shift"))
        .agg(F.collect_set("offset").alias("have"))
    )
    enough = F.exists("needs", lambda need: F.size(F.array_except(need, F.col("have"))) == 0)
    return lined_up.join(broadcast_if_small(needs, PART_MB), "item").where(enough).select("key", "item", "shift")


def occurrences(docs: DataFrame, found: DataFrame, bench: DataFrame) -> DataFrame:
    """key, item_id, start, n of each window of an item that occurs in a document.

    Only the words beside a candidate are compared: what is grouped by document is narrow."""
    shape = stored(bench.select("item", "n", "last"), "item-shapes")
    found = found.join(broadcast_if_small(shape, PART_MB), "item")
    found = stored(found.groupBy("key").agg(F.collect_list(F.struct("item", "shift", "n", "last")).alias("cs")), "candidates")
    # few candidates: broadcast, and the texts stay where they are; else both sides are shuffled
    held = broadcast_if_small(found, PART_MB)
    held = held if held is not found else found.hint("shuffle_hash")
    rows = docs.select(doc_key().alias("key"), "text").join(held, "key").select("key", words(F.col("text")).alias("w"), "cs")
    rows = rows.select("key", "w", F.explode("cs").alias("c")).select("key", "w", "c.*")
    start = F.greatest("shift", F.lit(0))
    piece = F.slice("w", start + 1, F.greatest(F.col("shift") + F.col("last") + F.col("n") - start, F.lit(0)))
    rows = rows.select("key", "item", "shift", "n", "last", start.alias("start"), piece.alias("piece"))
    rows = rows.join(broadcast_if_small(stored(bench.select("item", "item_id", "iw"), "item-words"), PART_MB), "item")
    rows = rows.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("last"))))
    at = F.col("shift") + F.col("k")
    inside = (at >= F.col("start")) & (at + F.col("n") <= F.col("start") + F.size("piece"))
    equal = F.when(inside, F.slice("piece", F.greatest(at - F.col("start"), F.lit(0)) + 1, F.col("n")) == F.slice("iw", F.col("k") + 1, F.col("n")))
    return rows.where(equal).select("key", "item_id", at.alias("at"), "n")


def search(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """key, hits array<struct<item_id,start,n>>: exact phrase matches of the benchmark's
    windows, a row for each document that has any; stored. An empty benchmark matches nothing."""
    bench = items(benchmark)
    keys = stored(key_words(ranked_terms(docs, bench)), "keys")
    postings = index(docs, stored(keys.select("term").distinct(), "key-terms"))
    rows = occurrences(docs, candidates(postings, keys), bench)
    return stored(rows.groupBy("key").agg(F.collect_set(F.struct("item_id", F.col("at").alias("start"), "n")).alias("hits")), "hits")


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit (words inside a matching window), n_items, items_sha256, contaminated.

    A row for each row of ``docs``, repeated ones too. A null text has no words. An item_id
    that is null counts as the empty text. Other columns aren't read."""
    found = search(docs, benchmark)
    places = F.array_distinct(F.flatten(F.transform("hits", lambda h: F.sequence(h["start"], h["start"] + h["n"] - 1))))
    names = F.sort_array(F.array_distinct(F.transform("hits", lambda h: h["item_id"])))
    found = stored(found.select("key", F.size(places).cast("long").alias("n_hit"), names.alias("found")), "found-items")
    rows = docs.select("doc_id", doc_key().alias("key"), F.size(words(F.col("text"))).cast("long").alias("n_words")).join(broadcast_if_small(found, PART_MB), "key", "left")
    n_hit, ids = F.coalesce("n_hit", F.lit(0)).cast("long"), F.coalesce("found", F.array().cast("array<string>"))
    return rows.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows of ``docs`` without any benchmark window; each is judged by its own text, so null
    and repeated doc_ids don't matter, and rows without text stay. Columns of any name pass through."""
    name = free_name(docs, "key")
    bad = stored(search(docs, benchmark).select(F.col("key").alias("bad")), "contaminated")
    small = broadcast_if_small(bad, PART_MB)
    bad = (small if small is not bad else bad.hint("shuffle_hash")).withColumnRenamed("bad", name)
    return docs.withColumn(name, doc_key()).join(bad, name, "left_anti").drop(name)


def proximity(postings: DataFrame, pairs: DataFrame, within: int) -> DataFrame:
    """key, item, pos, other_pos: places of the two terms of each pair (item, a, b) at most
    ``within`` words apart in a document.

    Positions are dealt into blocks of ``within`` words, so only neighbouring blocks meet."""
    block = F.floor(F.col("pos") / within)
    near = F.explode(F.array(block - 1, block, block + 1)).alias("block")
    a = postings.join(broadcast_if_small(pairs, PART_MB), postings["term"] == pairs["a"]).select("key", "item", "pos", near)
    b = postings.join(broadcast_if_small(pairs, PART_MB), postings["term"] == pairs["b"]).select("key", "item", F.col("pos").alias("other_pos"), block.alias("block"))
    return a.join(b, ["key", "item", "block"]).where(F.abs(F.col("pos") - F.col("other_pos")) <= within).select("key", "item", "pos", "other_pos")


def near_matches(docs: DataFrame, benchmark: DataFrame, within: int = WITHIN) -> DataFrame:
    """doc_id, item_id, n_near: for each row of ``docs`` the items whose two rarest different
    words (by occurrences in ``docs``, then in order) stand at most ``within`` words apart,
    and how many pairs of their places do.

    This also finds items that were changed between those words. Items of one word only have
    no match; rows without any have no row; repeated rows have one each."""
    bench = items(benchmark)
    places = ranked_terms(docs, bench).select("item", "term", "count").distinct()
    rank = F.row_number().over(Window.partitionBy("item").orderBy("count", "term"))
    two = places.withColumn("rank", rank).where("rank <= 2").groupBy("item").agg(F.min_by("term", "rank").alias("a"), F.max_by("term", "rank").alias("b")).where("a != b")
    two = stored(two, "rarest-pairs")
    postings = index(docs, stored(two.select(F.explode(F.array("a", "b")).alias("term")).distinct(), "pair-terms")).distinct()
    found = proximity(postings, two, within).join(broadcast_if_small(stored(bench.select("item", "item_id"), "item-names"), PART_MB), "item")
    found = stored(found.groupBy("key", "item_id").agg(F.count("*").alias("n_near")), "near-items")
    return docs.select("doc_id", doc_key().alias("key")).join(broadcast_if_small(found, PART_MB), "key").select("doc_id", "item_id", "n_near")
