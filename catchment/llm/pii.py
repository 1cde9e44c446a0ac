"""Information-theoretic sanitisation of personal data.

Entities are found by pattern: emails, IP addresses, card and phone numbers, and beyond these
base kinds secrets, runs of letters and digits whose own information is too high for a word.
Besides, a term t reveals an entity e in so far as seeing t makes e likely: the disclosure is
PMI(t; e) / IC(e), the share of e's information that t gives away, with probabilities
estimated from co-occurrence in whole documents of the corpus. Entities are single values
(an address), and classes: an email domain, or that a text holds any entity of a kind, as
long as that is rare enough to tell something.

For a single value, terms whose disclosure reaches ``GENERALISE_AT`` are generalised, from
``REMOVE_AT`` on removed; for a class, only terms that reach ``CLASS_AT`` are, and removed.
Both wherever they stand, provided they met the entity more often than chance explains.
Copies of one passage don't count twice for that: meetings with a single value count by
different contexts, those with a class by different texts, whose near copies share a sketch.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catchment.llm.common import broadcast_if_small, bytes_held, free_name, mixed, small_batches, stored

KINDS = ("email", "ip", "card", "phone")
GENERALISE_AT, REMOVE_AT, CLASS_AT = 0.7, 0.9, 0.95
#: A class that a larger share of texts holds is no information to protect.
RARE_CLASS = 0.05
#: Coordinates of the sketch that tells texts apart from near copies; how many different ones
#: count by single bits, beyond which trailing bits estimate them.
SKETCH, FEW = 4, 48
#: What a secret is: length, bits of information in all and a character, changes between
#: letters and digits, at least.
SECRET_CHARS, SECRET_BITS, SECRET_DENSITY, SECRET_CHANGES = 20, 64, 2.5, 4
#: Bytes of disclosing terms that are broadcast at once: more are worked on in rounds.
TERMS_BYTES = 16 << 20
#: The chance that any pair at all passes by chance (Poisson meetings, Bonferroni over pairs).
SIGNIFICANT = 0.01
#: What tells contexts apart: so many terms on each side of an entity, within so many characters.
CONTEXT_TERMS, CONTEXT_CHARS = 8, 160

LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
LONG_DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9]){15}")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TERM = re.compile(r"[^\W\d_]{2,}")
DIGITS = re.compile(r"[^0-9]+")
RUN = re.compile(f"[A-Za-z0-9]{{{SECRET_CHARS},}}+")
CHANGE = re.compile("(?<=[0-9])[A-Za-z]|(?<=[A-Za-z])[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost, non-overlapping: from each @ back over its local part, on over its domain."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and LOCAL.match(text, start - 1):
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            yield start, m.end()
            free = m.end()
        # what stands before this @ is no part of a later address, as @ isn't in the class
        free = max(free, at + 1)
        at = text.find("@", free)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind, then start."""
    out = [("email", s, e) for s, e in emails(text)]
    if "." in text:
        out += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split("."))]
    if LONG_DIGITS.search(text):
        out += [("card", *m.span()) for m in CARD.finditer(text) if m.end() - m.start() >= 16 and 16 <= len(d := DIGITS.sub("", m[0])) <= 19 and luhn(d)]
    if "+" in text:
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(DIGITS.sub("", m[0])) <= 15]
    return out


def apart(found: Iterator[re.Match], taken: list[tuple[int, int]]) -> Iterator[re.Match]:
    """The matches, in order, that overlap none of the spans ``taken``."""
    taken, k, reach = sorted(taken), 0, 0
    for m in found:
        while k < len(taken) and taken[k][0] < m.end():
            reach = max(reach, taken[k][1])
            k += 1
        if m.start() >= reach:
            yield m


def secrets(text: str, taken: list[tuple[int, int]]) -> list[tuple[str, int, int]]:
    """Runs of letters and digits, outside the spans ``taken``, that hold SECRET_BITS or more."""
    out = []
    for m in apart(RUN.finditer(text), taken):
        n = m.end() - m.start()
        bits = sum(c * math.log2(n / c) for c in Counter(m[0]).values())
        if bits >= max(SECRET_BITS, SECRET_DENSITY * n) and len(CHANGE.findall(m[0])) >= SECRET_CHANGES:
            out.append(("secret", *m.span()))
    return out


def all_spans(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """The spans of the base kinds, and those of secrets."""
    base = base_spans(text)
    return base, secrets(text, [(s, e) for _, s, e in base])


def entity(kind: str, value: str) -> str:
    """What is protected: the value without case or separators."""
    if kind in ("card", "phone"):
        return f"{kind}:{DIGITS.sub('', value)}"
    return f"{kind}:{value if kind == 'secret' else value.lower()}"


def classes(kind: str, value: str) -> list[str]:
    """The classes that an entity belongs to."""
    return [f"any:{kind}"] + ([f"domain:{value.lower().rpartition('@')[2]}"] if kind == "email" else [])


def number(name: str) -> int:
    """64 bits that stand for an entity; two have equal ones with a chance of 5e-20."""
    return xxhash.xxh3_64_intdigest(name) - (1 << 63)


def context(text: str, start: int, end: int, taken: list[tuple[int, int]]) -> list[str]:
    """The terms next to text[start:end] that overlap none of the sorted spans ``taken``."""
    lo = max(0, start - CONTEXT_CHARS)
    left = [m for m in TERM.finditer(text, lo, start) if m.start() > lo or lo == 0][-CONTEXT_TERMS:]
    hi = min(len(text), end + CONTEXT_CHARS)
    right = [m for m in TERM.finditer(text, end, hi) if m.end() < hi or hi == len(text)][:CONTEXT_TERMS]
    # spans of a kind don't overlap, so of those that start before lo the last few may reach beyond it
    near = taken[max(0, bisect_left(taken, (lo, 0)) - 2 * len(KINDS)) : bisect_left(taken, (hi, 0))]
    return [m[0].lower() for m in (*left, *right) if not any(m.start() < e and m.end() > s for s, e in near)]


def terms(text: str) -> set[str]:
    return {t.lower() for t in {*TERM.findall(text)}}


def sketch(names: list[str]) -> list[int]:
    """SKETCH minimum hashes of a text's pairs of neighbouring terms, each as one of 64 bits, and
    then each as a bit k with a chance of 2^-(k+1), for counts that 64 bits don't hold.
    Pairs, as single frequent terms would be the minimum of texts that have nothing else in common."""
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, names), np.uint64, len(names))
    h = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:] if len(h) > 1 else h
    few, many = [], []
    for k in range(SKETCH):
        x = mixed(h + np.uint64(k))
        least = int(x.min()) if len(x) else 0
        few.append(1 << least % 64 if least % 64 < 63 else -(1 << 63))
        # the least of many hashes has no even upper bits, so it is mixed once more
        spread = int(mixed(np.array([least + 1], np.uint64))[0]) | 1 << 40
        many.append(spread & -spread)
    return few + many


SCAN = "term string, df long, entities array<struct<entity:long,unit:long>>, classes array<long>, sketch array<long>, terms array<string>"
SCAN_KINDS = [pa.string(), pa.int64(), pa.list_(pa.struct([("entity", pa.int64()), ("unit", pa.int64())])), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.string())]
#: Terms counted before they are sent on.
HELD_TERMS = 200_000


def scan(docs: DataFrame) -> DataFrame:
    """One pass over all texts, with two sorts of rows: (term, df), in how many of a task's
    texts a term stands; and for each text with entities these, each with the least hash of
    its contexts, their classes, the text's sketch, and its terms outside of entities."""
    names = [x.split()[0] for x in SCAN.split(", ")]

    def packed(*columns: object) -> pa.RecordBatch:
        n = len(next(c for c in columns if c is not None))
        return pa.RecordBatch.from_arrays([pa.nulls(n, k) if c is None else pa.array(c, k) for c, k in zip(columns, SCAN_KINDS, strict=True)], names=names)

    def counted(count: Counter) -> pa.RecordBatch:
        names = sorted(count)  # in order, as they compress better
        return packed(names, [count[x] for x in names], None, None, None, None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: Counter = Counter()
        for batch in batches:
            rows = []
            for text in batch.column(0):
                text = text.as_py() or ""
                found = terms(text)
                count.update(found)
                if len(count) > HELD_TERMS:
                    yield counted(count)
                    count = Counter()
                base, more = all_spans(text)
                if not base and not more:
                    continue
                taken = sorted((s, e) for _, s, e in base + more)
                units: dict[int, int] = {}
                kinds = set()
                for kind, s, e in base + more:
                    name, value = number(entity(kind, text[s:e])), text[s:e]
                    unit = number(" ".join(context(text, s, e, taken)))
                    units[name] = min(unit, units.get(name, unit))
                    kinds.update(map(number, classes(kind, value)))
                own = [t for t, _, _ in outside(text, taken)]
                rows.append(([{"entity": n, "unit": u} for n, u in units.items()], sorted(kinds), sketch(own), sorted(set(own))))
                if len(rows) >= 100:
                    yield packed(None, None, *zip(*rows, strict=True))
                    rows = []
            if rows:
                yield packed(None, None, *zip(*rows, strict=True))
        if count:
            yield counted(count)

    return docs.select("text").mapInArrow(run, SCAN)


def outside(text: str, taken: list[tuple[int, int]]) -> Iterator[tuple[str, int, int]]:
    """The terms of a text that overlap none of the spans ``taken``: (term, start, end)."""
    for m in apart(TERM.finditer(text), taken):
        yield m[0].lower(), *m.span()


def value_pairs(held: DataFrame) -> DataFrame:
    """entity, term, met, support, owners of single values that stand in two contexts or more."""
    named = held.select(F.explode("entities").alias("e"), "terms").select("e.entity", "e.unit", "terms")
    units = named.groupBy("entity", "unit").agg(F.count("*").alias("n"))
    # one context is never significant: its tail is 1 / total at least, and the pairs count as ``total`` at least
    owners = stored(units.groupBy("entity").agg(F.sum("n").alias("owners"), F.count("*").alias("units")).where("units > 1"), "owners")
    some = named.join(broadcast_if_small(owners.select("entity", "owners")), "entity")
    pairs = some.select("entity", "owners", "unit", F.explode("terms").alias("term")).groupBy("entity", "owners", "term", "unit").agg(F.count("*").alias("n"))
    return pairs.groupBy("entity", "owners", "term").agg(F.sum("n").alias("met"), F.count("*").alias("support"))


def class_pairs(held: DataFrame, total: int) -> DataFrame:
    """entity, term, met, support, owners of the classes that are rare enough."""
    named = held.select(F.explode("classes").alias("entity"), "terms", "sketch")
    owners = named.groupBy("entity").agg(F.count("*").alias("owners")).where(F.col("owners") <= max(1, int(RARE_CLASS * total)))
    some = named.join(broadcast_if_small(stored(owners, "classes-owned")), "entity")
    rows = some.select("entity", "owners", "sketch", F.explode("terms").alias("term"))
    bits = [F.bit_or(F.col("sketch")[k]).alias(f"b{k}") for k in range(2 * SKETCH)]
    rows = rows.groupBy("entity", "owners", "term").agg(F.count("*").alias("met"), *bits)
    few = F.least(*[F.bit_count(f"b{k}") for k in range(SKETCH)]).cast("long")
    # Flajolet-Martin: as many trailing ones as the logarithm of the number of different values
    ones = sum(F.bit_count(F.col(f"b{k}").bitwiseAND(F.bitwise_not(F.col(f"b{k}") + 1))) for k in range(SKETCH, 2 * SKETCH)) / SKETCH
    many = F.least(F.floor(F.pow(F.lit(2.0), ones) / 0.77351).cast("long"), F.col("met"))
    support = F.when(few < FEW, few).otherwise(F.greatest(few, many))
    return rows.select("entity", "owners", "term", "met", support.alias("support"))


def disclosing(docs: DataFrame) -> DataFrame:
    """term, entity, disclosure, act of the terms that give an entity away.

    Texts are the events; IC(e) = -log p(e). ``support`` counts different contexts of a value,
    or different texts of a class (near copies once; single bits up to FEW, beyond that an
    estimate within a factor of about 1.5), that hold the term. Were
    term and entity independent, it would be at most Poisson with mean df * owners / total;
    its tail, times the number of pairs, must be below SIGNIFICANT."""
    scanned, total = stored(scan(docs), "pii-scan", "zstd"), docs.count()
    held = scanned.where("term is null")
    pairs = value_pairs(held).withColumn("single", F.lit(True)).union(class_pairs(held, total).withColumn("single", F.lit(False)))
    pairs = stored(pairs, "pii-pairs")
    tests, some = max(1, total, pairs.count()), pairs.where("support > 1")
    wanted = stored(some.select("term").distinct(), "pii-terms")
    counts = scanned.where("term is not null").select("term", "df").join(broadcast_if_small(wanted), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    rows = some.join(counts, "term")
    pmi = F.log(F.col("met") * F.lit(float(total)) / (F.col("df") * F.col("owners")))
    least = F.when(F.col("single"), GENERALISE_AT).otherwise(CLASS_AT)
    rows = rows.withColumn("disclosure", pmi / F.log(F.lit(float(total)) / F.col("owners"))).where(F.col("disclosure") >= least)
    mean, n = F.col("df") * F.col("owners") / F.lit(float(total)), F.col("support")
    factorial = n * F.log(n) - n + F.log(2 * math.pi * n) / 2  # Stirling's lower bound
    tail = -mean + n * F.log(mean) - factorial + F.log((n + 1) / (n + 1 - mean))
    act = F.when(F.col("single") & (F.col("disclosure") < REMOVE_AT), "generalise").otherwise("remove")
    return rows.where((n > mean) & (tail + math.log(tests) <= math.log(SIGNIFICANT))).select("term", "entity", "disclosure", act.alias("act"))


def actions(docs: DataFrame) -> tuple[DataFrame, int]:
    """term, act (generalise or remove), part of each disclosing term, and the number of parts.

    A part takes TERMS_BYTES about, so that no worker, nor the driver, holds more at once
    however many terms there are."""
    small_batches(docs.sparkSession)
    acts = stored(disclosing(docs).groupBy("term").agg(F.max("act").alias("act")), "pii-acts")
    parts = 1 + 4 * bytes_held(acts) // TERMS_BYTES
    return acts.withColumn("part", F.pmod(F.xxhash64("term"), F.lit(parts))), parts


def sent(acts: DataFrame, part: int) -> Broadcast:
    """The acts of a part by term, broadcast."""
    return acts.sparkSession.sparkContext.broadcast(dict(map(tuple, acts.where(F.col("part") == part).select("term", "act").collect())))


def marked(text: str, spans: list[tuple[str, int, int]], bad: dict[str, str]) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all disclosing terms of a text outside of ``spans``."""
    if not bad or bad.keys().isdisjoint(terms(text)):
        return []
    return sorted((bad[t], s, e) for t, s, e in outside(text, [(s, e) for _, s, e in spans]) if t in bad)


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def marks_of(part: Broadcast) -> Callable[[Column], Column]:
    """A function of text columns: the spans of a part's terms, joined."""

    def run(text: pa.Array) -> pa.Array:
        out = []
        for t in text:
            t = t.as_py() or ""
            base, more = all_spans(t)
            out.append(joined(marked(t, base + more, part.value)))
        return pa.array(out, pa.string())

    return F.arrow_udf(run, "string")


def later_marks(docs: DataFrame, acts: DataFrame, parts: int, name: str) -> DataFrame:
    """``docs`` with a column ``name``, the spans of the terms of all parts but the first.
    Each part is a job of its own whose rows are stored, and is given up after it."""
    rows = docs.withColumn(name, F.lit(""))
    for k in range(1, parts):
        part = sent(acts, k)
        rows = stored(rows.withColumn(name, F.concat_ws(",", name, marks_of(part)("text"))), "pii-marks")
        part.destroy()
    return rows


def parsed(spans: str | None) -> list[tuple[str, int, int]]:
    cut = (x.split(":") for x in (spans or "").split(",") if x)
    return [(kind, int(s), int(e)) for kind, s, e in cut]


FOUND = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_secret long, n_terms long, n_found long"


def find(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_secret, n_terms, n_found
    of each row of ``docs``.

    ``spans`` joins the base spans (by kind, then start) and, after them, those of the
    method: secret:start:end, then generalise:start:end and remove:start:end; offsets in
    code points of the row's own text. n_found counts all. A null text counts as empty, and
    the empty list's hash is that of nothing. doc_id is passed through, null or repeated;
    other columns aren't read. An empty table gives no rows.
    """
    acts, parts = actions(docs)
    first = sent(acts, 0)
    names = [x.split()[0] for x in FOUND.split(", ")]

    def run(text: pa.Array, later: pa.Array) -> pa.Array:
        rows = []
        for t, extra in zip(text, later, strict=True):
            t = t.as_py() or ""
            base, more = all_spans(t)
            marks = sorted(marked(t, base + more, first.value) + parsed(extra.as_py()))
            count, said = Counter(k for k, _, _ in base), joined(base)
            rows.append((*(count[k] for k in KINDS), hashlib.sha256(said.encode()).hexdigest(), joined(base + more + marks), len(more), len(marks), len(base) + len(more) + len(marks)))
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()] * 3
        columns = list(zip(*rows, strict=True)) or [()] * len(names)
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    rows = later_marks(docs.select("doc_id", "text"), acts, parts, "later")
    found = F.arrow_udf(run, "struct<" + FOUND.replace(" ", ":").replace(",:", ",") + ">")(F.col("text"), F.col("later"))
    return rows.select("doc_id", found.alias("f")).select("doc_id", "f.*")


def apply_spans(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with its entities named by kind, and its terms generalised or removed."""
    out, at = [], 0
    for s, e, kind in sorted((s, e, k) for k, s, e in spans):
        if s >= at:  # kinds may overlap: the first wins, the rest of the other goes too
            out.append(text[at:s])
            out.append("" if kind == "remove" else "[TERM]" if kind == "generalise" else f"[{kind.upper()}]")
        at = max(at, e)
    return "".join(out) + text[at:]


def sanitise(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data taken out of text; other columns, nulls and clean texts stay.

    Each row's own text is searched and redacted in one pass, so null and repeated doc_ids
    don't matter; columns of any name pass through. n_chars, if there is one, follows the
    text. An empty table gives no rows."""
    acts, parts = actions(docs)
    first = sent(acts, 0)

    def run(text: pa.Array, later: pa.Array) -> pa.Array:
        out = []
        for t, extra in zip(text, later, strict=True):
            t = t.as_py()
            base, more = all_spans(t or "")
            spans = base + more + marked(t or "", base + more, first.value) + parsed(extra.as_py())
            out.append(apply_spans(t, spans) if spans else None)
        return pa.array(out, pa.string())

    name, new = free_name(docs, "later"), free_name(docs, "redacted")
    rows = later_marks(docs, acts, parts, name)
    rows = rows.withColumn(new, F.arrow_udf(run, "string")(F.col("text"), F.col(name)))

    def column(c: str) -> Column:
        if c == "text":
            return F.coalesce(new, "text").alias("text")
        if c == "n_chars":
            return F.when(F.col(new).isNotNull(), F.length(new).cast(docs.schema[c].dataType)).otherwise(F.col(c)).alias(c)
        return F.col(f"`{c}`")

    return rows.select(*map(column, docs.columns))
