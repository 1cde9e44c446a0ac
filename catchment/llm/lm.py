"""Language-model scores: a log-bilinear neural model trained by noise-contrastive estimation.

Every token has a class: the NAMED most frequent ones their own, any other one of ENDINGS
classes by its last two characters. The model predicts the class of a token from the
context classes of the two before it: r = R2[two back] + R1[one back], score = r . Q + b. Within
a class a token has its smoothed share of the class's counts, which cover the whole corpus
and leave room for a token never seen. So every token has a probability, and all sum to 1.

Training works on the counts of class triples of all training texts, summed by Spark, so the
result doesn't depend on how the texts are partitioned. Triples are dealt by a hash of their
context into a number of parts that only depends on how many they are (and that is bounded,
as classes are); each part trains a copy in a fixed order, with noise drawn by class
frequency, and a round ends with the mean of the copies. For scoring, batched matrix products
give each context's normaliser.

Frequent tokens (COMMON at most) go to the tasks as a broadcast variable; the rest, each of
which is rare by choice, meets its counts in a join.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catchment.llm.common import small_batches, stored
from catchment.llm.langid import remainder

#: Classes of single tokens, classes by endings; as contexts, the first of the one and groups of the other.
NAMED, ENDINGS, CONTEXT_NAMED, CONTEXT_ENDINGS = 1024, 1024, 256, 256
CLASSES, CONTEXTS = NAMED + ENDINGS, CONTEXT_NAMED + CONTEXT_ENDINGS
WIDTH, COMMON = 32, 100_000
#: Of training: noise classes a batch, triples a batch, rounds, rate.
NOISE, BATCH, ROUNDS, RATE = 64, 2048, 2, 0.3
#: Triples of a part, and parts at most.
PART_TRIPLES, PARTS = 500_000, 64
#: Tokens of a run of texts whose triples are counted together; distinct tokens held.
CHUNK, HELD_TOKENS = 1 << 21, 200_000
FIRST = CONTEXTS  # the context before a text


def raw_tokens(text: str | None) -> list[bytes]:
    """Words, split at ASCII white space and with A-Z lower-cased, then the end."""
    words = (text or "").encode().lower().split()
    words.append(b"")
    return words


def token_counts(rows: DataFrame) -> DataFrame:
    """token, c (in rows that aren't held out), n (in all): of the whole corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        train: Counter = Counter()
        held: Counter = Counter()

        def batch_of(train: Counter, held: Counter) -> pa.RecordBatch:
            names = list({**train, **held})
            c = np.fromiter(map(train.__getitem__, names), np.int64, len(names))
            n = c + np.fromiter(map(held.__getitem__, names), np.int64, len(names))
            return pa.RecordBatch.from_arrays([pa.array(names, pa.binary()).cast(pa.string()), pa.array(c), pa.array(n)], names=["token", "c", "n"])

        for batch in batches:
            for out, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                (held if out else train).update(raw_tokens(text.as_py()))
                if len(train) + len(held) > HELD_TOKENS:
                    yield batch_of(train, held)
                    train, held = Counter(), Counter()
        yield batch_of(train, held)

    parts = rows.select("held_out", "text").mapInArrow(run, "token string, c long, n long")
    return parts.groupBy("token").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))


def ending(token: bytes) -> int:
    """Number of the class of a token's last two characters."""
    return zlib.crc32(token.decode()[-2:].encode()) % ENDINGS


def ending_column(token: Column) -> Column:
    """``ending`` of a column; the last two characters as Spark has them."""
    return (F.crc32(F.right(token, F.lit(2)).cast("binary")) % ENDINGS).cast("int")


@dataclass
class Lexicon:
    """The frequent tokens, their counts, and totals. Index 0 stands for all other tokens."""

    index: dict[bytes, int]
    counts: np.ndarray
    total: int
    distinct: int
    below: int
    #: By index: the class; by class: training tokens and distinct ones.
    kind: np.ndarray
    held: np.ndarray
    types: np.ndarray

    def log10_base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.1) / (self.total + 0.1 * (self.distinct + 1)))

    def class_shares(self) -> np.ndarray:
        return (self.held + 0.5) / (self.held + 0.5).sum()

    def shift(self) -> np.ndarray:
        """By class: log10 of a token's share of its class over its share of all; for a class
        of one token what makes that share 1."""
        return np.log10((self.total + 0.1 * (self.distinct + 1)) / (self.held + 0.1 * (self.types + 1)))

    def contexts(self, classes: np.ndarray) -> np.ndarray:
        """The context class of each class."""
        c = np.arange(CLASSES)
        name = {i: w for w, i in self.index.items() if 0 < i <= NAMED}
        for k in range(CONTEXT_NAMED, NAMED):
            c[k] = CONTEXT_NAMED + (ending(name[k + 1]) if k + 1 in name else 0) % CONTEXT_ENDINGS
        c[NAMED:] = CONTEXT_NAMED + np.arange(ENDINGS) % CONTEXT_ENDINGS
        return c[classes]


class Tokens(dict):
    """Token -> its index if it is a frequent one, else -1 - its class."""

    def __init__(self, lex: Lexicon):
        super().__init__()
        self.lex = lex

    def __missing__(self, token: bytes) -> int:
        i = self.lex.index.get(token)
        v = i if i else -1 - NAMED - ending(token)
        if len(self) >= HELD_TOKENS:
            self.clear()
        self[token] = v
        return v

    def of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Index (0: rare) and class of each token."""
        v = np.fromiter(map(self.__getitem__, words), np.int32, len(words))
        ids = np.maximum(v, 0)
        return ids, np.where(v > 0, self.lex.kind[ids], -1 - v)


def lexicon(counts: DataFrame) -> Lexicon:
    """From stored counts. Tokens of a count of ``below`` or more are COMMON at most."""
    level = F.floor(F.log2("n"))
    rows = counts.groupBy(level.alias("level")).agg(F.count("*").alias("types"), F.sum("c").alias("c"), F.count_if(F.col("c") > 0).alias("v")).collect()  # 64 at most
    below, many = 62, 0
    for r in sorted(rows, key=lambda r: -r["level"]):
        if many + r["types"] > COMMON:
            break
        many, below = many + r["types"], r["level"]
    top = counts.where(level >= below).select("token", "c", "n").collect() if many else []  # COMMON at most
    top.sort(key=lambda r: (-r["c"], -r["n"], r["token"]))
    names = [r["token"].encode() for r in top]
    c = np.array([0, *(r["c"] for r in top)], np.int64)
    kind = np.array([0, *(i if i < NAMED else NAMED + ending(w) for i, w in enumerate(names))], np.int64)
    held, types = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in counts.groupBy(ending_column(F.col("token")).alias("e")).agg(F.sum("c").alias("c"), F.count_if(F.col("c") > 0).alias("v")).collect():  # ENDINGS at most
        held[NAMED + r["e"]], types[NAMED + r["e"]] = r["c"], r["v"]
    for i, w in enumerate(names[:NAMED]):
        e = NAMED + ending(w)
        held[e], types[e] = held[e] - c[i + 1], types[e] - (c[i + 1] > 0)
        held[i] = c[i + 1]
        types[i] = 0  # one token, whose share is 1
    return Lexicon({w: i + 1 for i, w in enumerate(names)}, c, sum(r["c"] for r in rows), sum(r["v"] for r in rows), 1 << below, kind, held, types)


def summed(at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct places, and the sum of the rows of each."""
    order = np.argsort(at, kind="stable")
    at = at[order]
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return at[first], np.add.reduceat(rows[order], first, axis=0)


class Bilinear:
    """Parameters with their gradients' squared sums, training, normalised probabilities."""

    def __init__(self, shares: np.ndarray, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.shares, n = shares, len(shares)
        self.r = rng.normal(0, 0.1, (2 * (CONTEXTS + 1), WIDTH)).astype(np.float32)  # two back, then one back
        self.q = rng.normal(0, 0.1, (n, WIDTH)).astype(np.float32)
        self.b = np.log(shares).astype(np.float32)
        self.sums = [np.full(x.shape, 1e-3, np.float32) for x in (self.r, self.q, self.b)]
        self.known = np.full((CONTEXTS + 1) ** 2, np.nan)  # normalisers of contexts

    def hidden(self, w1: np.ndarray, w2: np.ndarray) -> np.ndarray:
        return self.r[w1] + self.r[CONTEXTS + 1 + w2]

    def update(self, k: int, at: np.ndarray, g: np.ndarray) -> None:
        self.sums[k][at] += (g * g).astype(np.float32)
        (self.r, self.q, self.b)[k][at] += (RATE * g / np.sqrt(self.sums[k][at])).astype(np.float32)

    def step(self, w1: np.ndarray, w2: np.ndarray, w: np.ndarray, weight: np.ndarray, rng: np.random.Generator) -> None:
        """One gradient step of the contrastive loss on weighted triples."""
        noise = rng.choice(len(self.shares), NOISE, p=self.shares)
        log_noise = np.log(NOISE * self.shares).astype(np.float32)
        h = self.hidden(w1, w2)
        own = (h * self.q[w]).sum(axis=1) + self.b[w] - log_noise[w]
        other = h @ self.q[noise].T + self.b[noise] - log_noise[noise]
        weight = (weight / weight.sum()).astype(np.float32)
        g_own = weight / (1 + np.exp(np.clip(own, -30, 30)))
        g_other = -weight[:, None] / (1 + np.exp(np.clip(-other, -30, 30)))
        g_h = g_own[:, None] * self.q[w] + g_other @ self.q[noise]
        at = np.concatenate([w, noise])
        where, g_q = summed(at, np.column_stack([np.concatenate([g_own[:, None] * h, g_other.T @ h]), np.concatenate([g_own, g_other.sum(axis=0)])]))
        self.update(0, *summed(np.concatenate([w1, CONTEXTS + 1 + w2]), np.concatenate([g_h, g_h])))
        self.update(1, where, g_q[:, :-1])
        self.update(2, where, g_q[:, -1])

    def train(self, code: np.ndarray, weight: np.ndarray, rng: np.random.Generator) -> None:
        """One pass over weighted triples, coded as by ``coded``."""
        order = rng.permutation(len(code))
        for lo in range(0, len(order), BATCH):
            part = order[lo : lo + BATCH]
            context, w = np.divmod(code[part], CLASSES)
            self.step(*np.divmod(context, CONTEXTS + 1), w, weight[part], rng)

    def rows(self) -> np.ndarray:
        """All parameters, then their sums, as rows of WIDTH + 1 numbers."""
        parts = [np.column_stack([x, np.zeros(len(x))]) if b is None else np.column_stack([x, b]) for x, b in ((self.r, None), (self.q, self.b), (self.sums[0], None), (self.sums[1], self.sums[2]))]
        return np.concatenate(parts).astype(np.float64)

    def load(self, rows: np.ndarray) -> None:
        r, q, sr, sq = np.split(rows.astype(np.float32), np.cumsum([len(self.r), len(self.q), len(self.r)]))
        self.r, self.q, self.b = r[:, :-1].copy(), q[:, :-1].copy(), q[:, -1].copy()
        self.sums = [sr[:, :-1].copy(), sq[:, :-1].copy(), sq[:, -1].copy()]

    def log10(self, w1: np.ndarray, w2: np.ndarray, w: np.ndarray, known: np.ndarray) -> np.ndarray:
        """Normalised log10 probabilities; ``known`` keeps the normalisers of contexts."""
        code = w1 * (CONTEXTS + 1) + w2
        new = np.unique(code[np.isnan(known[code])])
        for lo in range(0, len(new), 1024):
            part = new[lo : lo + 1024]
            s = self.hidden(*np.divmod(part, CONTEXTS + 1)) @ self.q.T + self.b
            top = s.max(axis=1)
            known[part] = top + np.log(np.exp(s - top[:, None]).sum(axis=1))
        s = np.einsum("ij,ij->i", self.hidden(w1, w2), self.q[w]) + self.b[w]
        return (s - known[code]) / np.log(10)


def before(contexts: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The context class two back and the one back of each token, FIRST before a text."""
    one = np.concatenate([[FIRST], contexts[:-1]])
    one[starts] = FIRST
    two = np.concatenate([[FIRST], one[:-1]])
    two[starts] = FIRST
    return two, one


def coded(two: np.ndarray, one: np.ndarray, classes: np.ndarray) -> np.ndarray:
    return (two * (CONTEXTS + 1) + one) * CLASSES + classes


def text_runs(texts: pa.Array, size: int) -> Iterator[list[list[bytes]]]:
    """Runs of texts of about ``size`` tokens: the tokens of each."""
    run, n = [], 0
    for t in texts:
        run.append(raw_tokens(t.as_py()))
        n += len(run[-1])
        if n >= size:
            yield run
            run, n = [], 0
    if run:
        yield run


def classed(run: list[list[bytes]], known: Tokens, context: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the tokens of a run: starts of texts, sizes, indexes, classes, contexts two back and one back."""
    sizes = np.array([len(w) for w in run])
    starts = np.cumsum(sizes) - sizes
    ids, classes = known.of([w for words in run for w in words])
    return starts, sizes, ids, classes, *before(context[classes], starts)


def triple_counts(rows: DataFrame, lex: Lexicon) -> DataFrame:
    """code, n: how often each triple of classes stands in the rows that aren't held out."""
    sent = rows.sparkSession.sparkContext.broadcast(lex)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, context = Tokens(sent.value), sent.value.contexts(np.arange(CLASSES))
        code = [np.zeros(0, np.int64)]
        for batch in batches:
            for part in text_runs(batch.column(0), 1 << 16):
                _, _, _, classes, two, one = classed(part, known, context)
                code.append(coded(two, one, classes))
                if sum(map(len, code)) >= CHUNK:
                    found, n = np.unique(np.concatenate(code), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n)], names=["code", "n"])
                    code = [np.zeros(0, np.int64)]
        found, n = np.unique(np.concatenate(code), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n)], names=["code", "n"])

    return rows.where(~F.col("held_out")).select("text").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def fit(rows: DataFrame, lex: Lexicon) -> Bilinear:
    """ROUNDS times: a copy trained by each part of the triples, then their weighted mean."""
    triples = stored(triple_counts(rows, lex), "triples")
    parts = min(PARTS, 1 + triples.count() // PART_TRIPLES)
    part = F.pmod(F.xxhash64(F.floor(F.col("code") / CLASSES)), F.lit(parts)).cast("int")
    dealt = triples.withColumn("part", part).repartition(parts, "part").sortWithinPartitions("part", "code")
    model = Bilinear(lex.class_shares())
    for turn in range(ROUNDS):
        sent = rows.sparkSession.sparkContext.broadcast((model.shares, model.rows()))

        def run(batches: Iterator[pa.RecordBatch], sent=sent, turn: int = turn) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            def trained(now: int, held: list) -> pa.RecordBatch:
                code, n = (np.concatenate(x) for x in zip(*held, strict=True))
                copy = Bilinear(sent.value[0])
                copy.load(sent.value[1])
                copy.train(code, n, np.random.default_rng([turn, now]))
                p = copy.rows()
                flat = pa.ListArray.from_arrays(np.arange(len(p) + 1, dtype=np.int32) * p.shape[1], pa.array(p.ravel()))
                return pa.RecordBatch.from_arrays([pa.array(np.arange(len(p))), pa.array([float(n.sum())] * len(p)), flat], names=["place", "n", "v"])

            now, held = None, []
            for batch in batches:
                code, n, part = (c.to_numpy() for c in batch.columns)
                for i in np.split(np.arange(len(part)), np.flatnonzero(np.diff(part)) + 1):
                    if len(i):
                        if now is not None and part[i[0]] != now:
                            yield trained(now, held)
                            held = []
                        now = int(part[i[0]])
                        held.append((code[i], n[i]))
            if held:
                yield trained(now, held)

        copies = dealt.mapInArrow(run, "place long, n double, v array<double>")
        mean = copies.groupBy("place").agg(*[(F.sum(F.col("v")[j] * F.col("n")) / F.sum("n")).alias(f"v{j}") for j in range(WIDTH + 1)])
        found = sorted(mean.collect())  # 4 * (CONTEXTS + 1) + 2 * CLASSES rows, whatever the corpus
        if found:
            model.load(np.array([r[1:] for r in found]))
    # the normalisers of all contexts met, once; (CONTEXTS + 1)^2 numbers at most
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def normalised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            code = batch.column(0).to_numpy()
            norms = np.full(len(model.known), np.nan)
            model.log10(*np.divmod(code, CONTEXTS + 1), np.zeros(len(code), np.int64), norms)
            yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(norms[code])], names=["context", "norm"])

    contexts = triples.select(F.floor(F.col("code") / CLASSES).cast("long").alias("context")).distinct()
    for r in contexts.mapInArrow(normalised, "context long, norm double").collect():
        model.known[r["context"]] = r["norm"]
    return model


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, rare array<string>"


def score_common(rows: DataFrame, lex: Lexicon, model: Bilinear) -> DataFrame:
    """Scores without the rare tokens' own shares, and the rare tokens."""
    sent = rows.sparkSession.sparkContext.broadcast((lex, model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, model = sent.value
        base, seen, shift = lex.log10_base(lex.counts), lex.counts > 0, lex.shift()
        share = base + shift[lex.kind]  # of a frequent token in its class
        share[1 : NAMED + 1] = 0.0
        base[0] = share[0] = seen[0] = 0
        norms = model.known.copy()
        known, context = Tokens(lex), lex.contexts(np.arange(CLASSES))
        for batch in batches:
            at = 0
            for part in text_runs(batch.column(2), 100_000):
                starts, sizes, ids, classes, two, one = classed(part, known, context)
                lm = model.log10(two, one, classes, norms) + np.where(ids > 0, share[ids], shift[classes])
                rare = np.flatnonzero(ids == 0)
                words = [w for run in part for w in run]
                out = [sizes, np.add.reduceat(seen[ids].astype(np.int64), starts), np.add.reduceat(base[ids], starts), np.add.reduceat(lm, starts)]
                cut = np.concatenate([np.searchsorted(rare, starts), [len(rare)]]).astype(np.int32)
                names = pa.array([words[i] for i in rare.tolist()], pa.binary()).cast(pa.string())
                columns = [batch.column(0).slice(at, len(part)), batch.column(1).slice(at, len(part)), *map(pa.array, out), pa.ListArray.from_arrays(pa.array(cut), names)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "rare"])
                at += len(part)

    return rows.select("doc_id", "held_out", "text").mapInArrow(run, SCORED)


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row.

    Rows whose remainder(10) isn't 0 are learned from. A null or blank text is one token,
    the end. Repeated rows are counted, and scored, each; null doc_ids stay null and count as
    the empty text for the fold. Without training rows all counts are 0 and the model is
    uniform over its classes. Other columns aren't read; an empty table gives no rows. The
    same rows get the same scores, but for rounding, however they are partitioned.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (remainder(10) == 0).alias("held_out"), "text")
    counts = stored(token_counts(rows), "token-counts")
    lex = lexicon(counts)
    model = fit(rows, lex)
    scored = stored(score_common(rows, lex, model).withColumn("row", F.monotonically_increasing_id()), "scored")
    rare = scored.select("row", F.explode("rare").alias("token")).join(counts.where(F.col("n") < lex.below).select("token", "c"), "token")
    base = F.log10((F.col("c") + 0.1) / F.lit(lex.total + 0.1 * (lex.distinct + 1)))
    sums = rare.groupBy("row").agg(F.sum(base).alias("b"), F.count_if(F.col("c") > 0).alias("k"))
    b, k = F.coalesce("b", F.lit(0.0)), F.coalesce("k", F.lit(0))
    return scored.drop("rare").join(sums, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + k).alias("n_known"), F.lit(lex.total).cast("long").alias("train_tokens"),
        (F.col("base_score") + b).alias("base_score"), (F.col("score") + b).alias("score"),
    )
