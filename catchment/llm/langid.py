"""Language identification: multinomial naive Bayes over hashed character n-grams.

A text is folded to lower-case letters and marks; each run of other characters is one blank,
and a blank stands at either end. Its n-grams, n = 1 to 3, fall into ``BUCKETS`` hash buckets.

Fitting counts buckets over a bounded sample of labelled texts. The log-probability matrix
(buckets x languages, float32: 256 KB a language) goes to the executors as a broadcast
variable. Scoring is one sparse product for a group of texts: the n-grams of all of them in
one array, the matrix rows gathered, and summed from each text's start to the next one's.
Texts beyond ``PIECE`` characters are folded in pieces that carry two characters over the
seam, so any text has the n-grams of the whole in bounded memory.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from catchment.llm.common import small_batches

BUCKETS = 1 << 16
#: Texts a language that fitting reads at most: the bound of the sample.
SAMPLE = 2_000
#: Languages of a model at most: with more, ``fit`` raises, as the matrix would pass 128 MB.
LANGUAGES = 512
#: Smoothing of the counts.
ALPHA = 0.5
#: Characters folded at once, of one text and of a group of texts.
PIECE, GROUP = 1 << 20, 1 << 18
UNKNOWN = "und"


@cache
def fold_table() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: its lower case if it is a letter or mark, else 0; and whether it is a letter."""
    fold, letter = np.zeros(0x110000, np.uint32), np.zeros(0x110000, bool)
    for i in range(0x110000):
        kind = unicodedata.category(chr(i))[0]
        if kind in "LM":
            fold[i], letter[i] = ord(chr(i).lower()[0]), kind == "L"
    return fold, letter


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def buckets(c: np.ndarray, lead: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of the n-gram that ends at each position from ``lead`` on, for n = 1, 2, 3.

    BUCKETS itself where there is none: two blanks side by side are two texts' ends."""
    h = c * np.uint32(2654435761)
    two = (h[:-1] ^ (h[1:] >> 3)) * np.uint32(2246822519)
    three = (two[:-1] ^ (h[2:] >> 5)) * np.uint32(3266489917)
    out = np.full((3, len(c)), BUCKETS, np.uint32)
    seam = (c[:-1] == 0) & (c[1:] == 0)
    out[0] = h >> 16
    out[1, 1:] = np.where(seam, BUCKETS, two >> 16)
    out[2, 2:] = np.where(seam[1:] | seam[:-1], BUCKETS, three >> 16)
    return tuple(out[:, lead:])


def folded(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The folded texts in one array, where each starts, and whether it has a letter."""
    fold, letter = fold_table()
    points = code_points(" " + "  ".join(texts) + " ")
    c = fold[points]
    start = np.cumsum([0, *(len(t) + 2 for t in texts[:-1])])
    keep = c != 0
    has = np.logical_or.reduceat(letter[points], start)
    keep[1:] |= c[:-1] != 0
    keep[start] = True
    return c[keep], np.cumsum(keep)[start] - 1, has


def folded_pieces(text: str) -> Iterator[tuple[np.ndarray, int]]:
    """The folded text in pieces, each with what it repeats of the last one, and how long that is."""
    fold, _ = fold_table()
    held, lead = np.zeros(1, np.uint32), 0
    for k in range(0, len(text), PIECE):
        c = np.concatenate([held, fold[code_points(text[k : k + PIECE])]])
        keep = c != 0
        keep[1:] |= c[:-1] != 0
        keep[: len(held)] = True
        yield c[keep], lead
        held = c[keep][-2:]
        lead = len(held)
    if held[-1]:
        yield np.append(held, np.uint32(0)), lead


def groups(texts: list[str | None], size: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts that have about ``size`` characters together; a long text is one."""
    first, held = 0, 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if i > first and held + n > size:
            yield first, i
            first, held = i, 0
        held += n
    if texts:
        yield first, len(texts)


class Model:
    """Languages, and for each the log probability of each bucket and of the language."""

    def __init__(self, counts: dict[str, np.ndarray], texts: dict[str, int]):
        self.langs = sorted(counts)
        self.logp = np.zeros((BUCKETS + 1, len(self.langs)), np.float32)  # the last row: no n-gram
        for k, lang in enumerate(self.langs):
            c = counts[lang] + ALPHA
            self.logp[:-1, k] = np.log(c / c.sum())
        total = sum(texts.values())
        self.prior = np.log([texts[lang] / total for lang in self.langs]) if total else np.zeros(0)

    def gathered(self, b: np.ndarray) -> np.ndarray:
        return np.take(self.logp, b, axis=0, mode="clip")

    def totals(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Summed log probabilities (texts x languages), numbers of n-grams, whether there is a letter."""
        if len(texts) == 1 and len(texts[0]) > PIECE:
            _, letter = fold_table()
            total, n = np.zeros((1, len(self.langs))), 0
            for c, lead in folded_pieces(texts[0]):
                for b in buckets(c, lead):
                    n += int(np.count_nonzero(b < BUCKETS))
                    for lo in range(0, len(b), GROUP):
                        total[0] += self.gathered(b[lo : lo + GROUP]).sum(axis=0, dtype=np.float64)
            has = any(letter[code_points(texts[0][k : k + PIECE])].any() for k in range(0, len(texts[0]), PIECE))
            return total, np.array([n]), np.array([has])
        c, start, has = folded(texts)
        found = buckets(c)
        n = sum(np.add.reduceat(b < BUCKETS, start, dtype=np.int64) for b in found)
        rows = self.gathered(found[0])
        rows += self.gathered(found[1])
        rows += self.gathered(found[2])
        return np.add.reduceat(rows.astype(np.float64), start, axis=0), n, has

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language of each text and its posterior; the posterior is taken of the mean n-gram
        of a window of 50, so that it doesn't saturate on long texts."""
        names, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if not self.langs:
            return names, score
        for lo, hi in groups(texts, max(1024, GROUP * 4 // len(self.langs))):
            total, n, has = self.totals([t or "" for t in texts[lo:hi]])
            total += self.prior
            best = total.argmax(axis=1)
            mean = total / np.maximum(1.0, n / 50)[:, None]
            p = np.exp(mean - mean.max(axis=1, keepdims=True))
            p = p[np.arange(len(p)), best] / p.sum(axis=1)
            for i in np.flatnonzero(has).tolist():
                names[lo + i], score[lo + i] = self.langs[best[i]], p[i]
        return names, score


def sample_rows(rows: DataFrame, counts: dict[str, int], sample: int) -> DataFrame:
    """text, lang of ``sample`` rows of each language, or all if it has fewer: those with the
    smallest hash of doc_id, then of the text, so a fixed set for given data.

    A hash threshold that about four times as many rows pass keeps what is ranked small; a
    language of which too few pass it, as doc_ids repeat, is ranked whole."""
    spark, rank = rows.sparkSession, F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    below = {lang: min(1 << 30, int((1 << 30) * 4 * sample / n) + 1) for lang, n in counts.items()}

    def passing(below: dict[str, int]) -> DataFrame:
        bound = spark.createDataFrame(list(below.items()), "lang string, below long")  # LANGUAGES rows at most
        return rows.withColumn("rank", rank).join(F.broadcast(bound), "lang").where("rank < below")

    if any(b < 1 << 30 for b in below.values()):
        got = {r["lang"]: r["n"] for r in passing(below).groupBy("lang").agg(F.count("*").alias("n")).collect()}
        below = {lang: b if got.get(lang, 0) >= sample else 1 << 30 for lang, b in below.items()}
    place = F.row_number().over(Window.partitionBy("lang").orderBy("rank", F.xxhash64("text")))
    return passing(below).withColumn("place", place).where(F.col("place") <= sample).select("text", "lang")


def fit(docs: DataFrame, chosen: Column, sample: int = SAMPLE) -> Model:
    """Fit on rows of ``docs`` where ``chosen`` holds and text and lang are not null.

    Of each language ``sample`` texts are read at most. No labelled text: no language, and
    every prediction is ``und``. More than LANGUAGES languages raise a ValueError."""
    rows = docs.where(chosen & F.col("text").isNotNull() & F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(LANGUAGES + 1).collect()}
    if len(counts) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages: the matrix isn't made to be broadcast")
    if not counts:
        return Model({}, {})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(*batch.columns, strict=True):
                own = found.setdefault(lang.as_py(), np.zeros(BUCKETS + 1, np.int64))
                for c, lead in folded_pieces(text.as_py()):
                    for b in buckets(c, lead):
                        own += np.bincount(b, minlength=BUCKETS + 1)
        for lang, c in found.items():
            idx = np.flatnonzero(c[:-1])
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(idx)), pa.array(idx), pa.array(c[idx])], names=["lang", "bucket", "n"])

    total = sample_rows(rows, counts, sample).mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    matrix = {lang: np.zeros(BUCKETS, np.int64) for lang in counts}
    for r in total.groupBy("lang").agg(F.collect_list("bucket").alias("bucket"), F.collect_list("n").alias("n")).toLocalIterator():
        matrix[r["lang"]][r["bucket"]] = r["n"]  # BUCKETS entries a language at most
    return Model(matrix, counts)


def predicted(docs: DataFrame, model: Model) -> Column:
    """struct<lang_pred string, score double> of the column text of ``docs``.

    Only the text goes through Python. A null or letterless text is ``und`` with score 0.
    Ties go to the first language in alphabetical order."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang_pred: string, score: double>")
    def run(text: pa.Array) -> pa.Array:
        names, scores = [], []
        for lo in range(0, len(text), 512):
            name, score = sent.value.predict(text.slice(lo, 512).to_pylist())
            names += name
            scores.append(score)
        scores = np.concatenate(scores) if scores else np.zeros(0)
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores)], names=["lang_pred", "score"])

    return run(F.col("text"))


def remainder(divisor: int) -> Column:
    """crc32 of doc_id as text, mod ``divisor``; a null doc_id counts as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % divisor


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of all rows; learns from those with remainder(5) != 0.

    Each row, a repeated one too, gives one row; other columns aren't read, so their names
    don't matter. An empty table gives no rows; a null doc_id counts as the empty text for
    the fold."""
    model = fit(docs, remainder(5) != 0)
    rows = docs.select("doc_id", (remainder(5) == 0).alias("held_out"), predicted(docs, model).alias("p"))
    return rows.select("doc_id", "held_out", "p.lang_pred", "p.score")


#: Below this a prediction is too uncertain to keep the document.
LEAST_SCORE = 0.5


def keep_known(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose language is one of those learned, with certainty.

    Rows without text, without a letter, or of an uncertain language go; repeated rows and
    null doc_ids are judged by their texts like any other. Columns of any name pass through."""
    p = predicted(docs, fit(docs, F.lit(True)))
    return docs.where((p["lang_pred"] != UNKNOWN) & (p["score"] >= LEAST_SCORE))
