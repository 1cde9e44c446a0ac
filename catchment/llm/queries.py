"""The registered queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from catchment.llm import bpe, decontam, exact_dedup, hard_negatives, langid, lm, minhash, pii, sharding, suffix_dedup, topk, warc, whiten
from catchment.llm.common import new_path, table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeats(table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def decontamination_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The other half of op3: items whose two rarest words stand near each other."""
    return decontam.near_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op5_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.groups(table(spark, sf_dir, "documents"), k=2, percent=80)


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def sharding_rebalanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored map of 16 shards, loaded, edited for 17 and stored again: where each row was and goes."""
    docs, path = table(spark, sf_dir, "documents"), new_path(spark, "slot-map")
    sharding.shard(docs, 16, path=path)
    return sharding.rebalanced(docs, 17, path)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten.whiten(table(spark, sf_dir, "embeddings"))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_pii, op2_suffix_dedup, op3_decontamination, decontamination_proximity, op4_language, op5_lm, op6_topk, op7_warc, op8_minhash, op9_bpe, op10_sharding, sharding_rebalanced, op11_whitening, op12_exact_dedup, op13_hard_negatives)}
WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL: dict[str, str] = {
    "op3_decontamination": f"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
b AS (SELECT item_id, {WORDS} AS w FROM benchmark),
bn AS (SELECT item_id, w, least(len(w), 10) AS n FROM b WHERE len(w) > 0),
bk AS (SELECT item_id, w, n, unnest(range(0, len(w) - n + 1)) AS k FROM bn),
bw AS (SELECT DISTINCT item_id, n, array_to_string(list_slice(w, k + 1, k + n), ' ') AS g FROM bk),
ns AS (SELECT DISTINCT n FROM bw),
dn AS (SELECT doc_id, w, n FROM d CROSS JOIN ns WHERE len(w) >= n),
dk AS (SELECT doc_id, w, n, unnest(range(0, len(w) - n + 1)) AS k FROM dn),
hits AS (SELECT doc_id, item_id, k, dk.n FROM dk JOIN bw ON dk.n = bw.n AND array_to_string(list_slice(w, k + 1, k + dk.n), ' ') = g),
places AS (SELECT doc_id, unnest(range(k, k + n)) AS p FROM hits),
np AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM places GROUP BY doc_id),
ids AS (SELECT DISTINCT doc_id, coalesce(CAST(item_id AS VARCHAR), '') AS i FROM hits),
ni AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS s FROM ids GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN np ON np.doc_id = d.doc_id LEFT JOIN ni ON ni.doc_id = d.doc_id""",
    "decontamination_proximity": f"""
WITH d AS (SELECT doc_id, unnest(w) AS term, unnest(range(0, len(w))) AS pos FROM (SELECT doc_id, {WORDS} AS w FROM documents) x),
b AS (SELECT DISTINCT coalesce(CAST(item_id AS VARCHAR), '') AS item_id, {WORDS} AS w FROM benchmark),
bt AS (SELECT DISTINCT item_id, w, unnest(w) AS term FROM b),
n AS (SELECT term, count(*) AS c FROM d GROUP BY term),
r AS (SELECT item_id, w, bt.term, row_number() OVER (PARTITION BY item_id, w ORDER BY coalesce(c, 0), bt.term) AS r FROM bt LEFT JOIN n ON n.term = bt.term),
p AS (SELECT x.item_id, x.w, x.term AS a, y.term AS b FROM r x JOIN r y ON x.item_id = y.item_id AND x.w = y.w AND x.r = 1 AND y.r = 2),
da AS (SELECT p.item_id, p.w, doc_id, pos FROM p JOIN d ON d.term = p.a),
db AS (SELECT p.item_id, p.w, doc_id, pos FROM p JOIN d ON d.term = p.b)
SELECT da.doc_id, da.item_id, count(*) AS n_near FROM da JOIN db ON da.item_id = db.item_id AND da.w = db.w AND da.doc_id = db.doc_id AND abs(da.pos - db.pos) <= 16 GROUP BY da.doc_id, da.item_id""",
    "op6_topk": """
WITH c AS (SELECT vec_id, unnest(embedding) AS x, unnest(range(0, len(embedding))) AS i FROM embeddings),
bad AS (SELECT DISTINCT vec_id FROM c WHERE x IS NULL OR NOT isfinite(x)),
v AS (SELECT vec_id, i, CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) AS x FROM c WHERE vec_id IS NOT NULL AND vec_id NOT IN (SELECT vec_id FROM bad WHERE vec_id IS NOT NULL)),
s AS (SELECT q.vec_id AS query_id, o.vec_id, sum(q.x * o.x) AS score FROM v q JOIN v o ON q.i = o.i AND q.vec_id <> o.vec_id WHERE q.vec_id % 50 = 0 GROUP BY q.vec_id, o.vec_id),
r AS (SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, CAST(score AS BIGINT) AS score FROM r WHERE rank <= 5""",
    "op12_exact_dedup": """
WITH t AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS h FROM documents),
g AS (SELECT h, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY h)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, t.h AS text_sha256 FROM t JOIN g ON g.h = t.h""",
    "op13_hard_negatives": """
WITH c AS (SELECT vec_id, label, unnest(embedding) AS x, unnest(range(0, len(embedding))) AS i FROM embeddings),
bad AS (SELECT DISTINCT vec_id FROM c WHERE x IS NULL OR NOT isfinite(x)),
v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, i, CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) AS x FROM c WHERE vec_id IS NOT NULL AND label IS NOT NULL AND vec_id NOT IN (SELECT vec_id FROM bad WHERE vec_id IS NOT NULL)),
s AS (SELECT q.vec_id AS a, o.vec_id AS b, q.label = o.label AS same, sum(q.x * o.x) AS score FROM v q JOIN v o ON q.i = o.i AND q.vec_id <> o.vec_id WHERE q.vec_id % 50 = 0 GROUP BY q.vec_id, o.vec_id, q.label = o.label),
p AS (SELECT a, b, score, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS r FROM s WHERE same),
n AS (SELECT p.a, p.b, p.score AS ps, s.b AS n, s.score AS ns, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b) AS rank FROM p JOIN s ON s.a = p.a WHERE p.r <= 5 AND NOT same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT a AS anchor_id, b AS positive_id, CAST(rank AS INTEGER) AS rank, n AS negative_id, CAST(ps AS BIGINT) AS positive_score, CAST(ns AS BIGINT) AS negative_score FROM n WHERE rank <= 3""",
}
