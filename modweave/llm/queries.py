"""Registered queries of the training-data operators, and SQL for those it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from modweave.llm import kneser_ney, langid, mixing, packing, quality_rules, secrets, simhash, substring_dedup, topk, toxicity
from modweave.llm.folds import held_out

TOKENIZER = "word_bpe_49k.json"
#: Weights of the domains that the labels define.
TARGETS = {"clean": 0.92, "low": 0.05, "toxic": 0.03}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path(TOKENIZER))


def domains(labels: DataFrame) -> DataFrame:
    """(doc_id, domain): toxic, low (quality 0) or clean."""
    return labels.select("doc_id", F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").when(F.col("quality") == 1, "clean").alias("domain"))


def op1_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity of every document under a model of the documents labelled good, and the verdict."""
    trusted = _table(spark, sf_dir, "labels").filter("quality = 1 AND coalesce(toxic, 0) = 0").select("doc_id")
    return kneser_ney.quality(_table(spark, sf_dir, "documents"), trusted)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document; a source is an owner, a document a repository."""
    return secrets.find(_table(spark, sf_dir, "documents")).drop("found")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the passages of lines and sentences that an earlier document (or place) has."""
    out = substring_dedup.dedup(_table(spark, sf_dir, "documents"))
    spans = F.array_join(F.transform("removed", lambda r: F.concat_ws(":", r["start"].cast("string"), r["end"].cast("string"))), ",")
    return out.withColumn("removed", spans)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents, packed into sequences of 4096 tokens."""
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path())


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rate and copies of every document for the target weights."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return mixing.mix(docs, mixing.train(docs, domains(_table(spark, sf_dir, "labels"))), TARGETS)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of every document and the verdict of the trees."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules.rules(docs, quality_rules.train(docs, _table(spark, sf_dir, "labels")))


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten best inner products of each query vector."""
    return topk.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document, learned outside the held-out fold."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.train(docs.filter(~held_out()))
    return langid.identify(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "bits_per_byte")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned outside the held-out fold."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    machine = toxicity.train(docs, _table(spark, sf_dir, "labels").filter(~held_out()))
    return toxicity.toxicity(docs, machine).select("doc_id", held_out().alias("held_out"), "score", "predicted")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_kneser_ney, op2_simhash, op3_secrets, op4_line_dedup, op5_packing, op6_mixing, op7_quality_rules, op8_topk, op9_language_id, op10_toxicity)}



def _kind_sql(kind: str, pattern: str, value: str, good: str) -> str:
    """Spans of a kind: the matches lie between the pieces of the split text."""
    return f"""{kind}_m AS (SELECT rid, unnest(regexp_extract_all(text, '{pattern}')) AS m, unnest(regexp_split_to_array(text, '{pattern}')[:len(regexp_extract_all(text, '{pattern}'))]) AS p, generate_subscripts(regexp_extract_all(text, '{pattern}'), 1) AS i FROM d),
{kind}_s AS (SELECT rid, m, sum(len(p) + len(m)) OVER (PARTITION BY rid ORDER BY i) AS stop FROM {kind}_m),
{kind} AS (SELECT rid, '{kind}' AS kind, {secrets.KINDS.index(kind)} AS k, CAST(stop - len(m) AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop, {value} AS v FROM {kind}_s WHERE {good})"""


def _secrets_sql() -> str:
    assign, access, hexes = (secrets.PATTERNS[k].replace("'", "''") for k in secrets.KINDS[:3])
    value = f"regexp_extract(m, '{assign}', 2)"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, coalesce(source, '') AS owner FROM documents),
{_kind_sql('assign', assign, value, f'len({value}) >= 8')},
{_kind_sql('access', access, 'm', 'true')},
{_kind_sql('hex', hexes, 'm', 'true')},
{_kind_sql('owned', '[A-Za-z0-9+/_-]{20,}', 'm', "regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Za-z]')")},
base AS (SELECT * FROM assign UNION ALL SELECT * FROM access UNION ALL SELECT * FROM hex),
spans AS (SELECT * FROM base UNION ALL SELECT * FROM owned o WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.rid = o.rid AND b.start < o.stop AND o.start < b.stop)),
owners AS (SELECT v, count(DISTINCT owner) >= {secrets.COPIED_OWNERS} OR count(DISTINCT coalesce(CAST(doc_id AS VARCHAR), '')) >= {secrets.COPIED_REPOS} AS copied FROM spans JOIN d USING (rid) GROUP BY 1),
judged AS (SELECT s.*, copied, s.kind || ':' || s.start || ':' || s.stop AS shown FROM spans s JOIN owners USING (v) WHERE s.kind <> 'owned' OR NOT copied),
per AS (SELECT rid, string_agg(shown, ',' ORDER BY start, k) AS spans, string_agg(shown, ',' ORDER BY start, k) FILTER (kind <> 'owned') AS base,
  count(*) FILTER (kind = 'assign') AS a, count(*) FILTER (kind = 'access') AS c, count(*) FILTER (kind = 'hex') AS h, count(*) FILTER (copied) AS n_copied, count(*) FILTER (NOT copied) AS n_live FROM judged GROUP BY 1)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(c, 0) AS n_access, coalesce(h, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_copied, 0) AS n_copied, coalesce(n_live, 0) AS n_live
FROM d LEFT JOIN per USING (rid)
"""


def _dedup_sql() -> str:
    """Units are runs of pieces from each piece on, and one that ends the text; the first of equals stays."""
    words, least = substring_dedup.MIN_WORDS, substring_dedup.MIN_BYTES
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, text FROM documents),
p AS (SELECT rid, doc_id, unnest(ps) AS piece, generate_subscripts(ps, 1) AS k FROM (SELECT rid, doc_id, regexp_extract_all(text, '{substring_dedup.pieces_pattern(substring_dedup.BREAKS)}') AS ps FROM d WHERE text IS NOT NULL)),
o AS (SELECT *, CAST(sum(len(piece)) OVER (PARTITION BY rid ORDER BY k) AS BIGINT) AS stop, regexp_extract_all(translate(piece, '{upper}', '{upper.lower()}'), '[^\x20\x09-\x0D]+') AS words FROM p),
w AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY k) AS i, count(*) OVER (PARTITION BY rid) AS n, sum(len(words)) OVER (PARTITION BY rid ORDER BY k) AS many, sum(strlen(array_to_string(words, ''))) OVER (PARTITION BY rid ORDER BY k) AS size FROM o WHERE len(words) > 0),
own AS (SELECT rid, list(array_to_string(words, ' ') ORDER BY i) AS own FROM w GROUP BY 1),
f AS (SELECT a.rid, a.i, a.n, min(b.i) AS j FROM w a JOIN w b ON a.rid = b.rid AND b.i BETWEEN a.i AND a.i + {words - 1} WHERE b.many - a.many + len(a.words) >= {words} OR b.size - a.size + strlen(array_to_string(a.words, '')) >= {least} GROUP BY ALL),
r AS (SELECT rid, i, j FROM f UNION SELECT rid, max(i), max(n) FROM f GROUP BY 1),
u AS (SELECT r.rid, a.doc_id, a.stop - len(a.piece) AS start, b.stop, array_to_string(own[r.i:r.j], ' ') AS unit FROM r JOIN own ON own.rid = r.rid JOIN w a ON a.rid = r.rid AND a.i = r.i JOIN w b ON b.rid = r.rid AND b.i = r.j),
g AS (SELECT rid, start, stop, first_value(rid) OVER e AS f_rid, first_value(stop) OVER e AS f_stop, row_number() OVER e AS turn FROM u WINDOW e AS (PARTITION BY unit ORDER BY doc_id, start, stop)),
x AS (SELECT rid, CASE WHEN rid = f_rid THEN greatest(start, f_stop) ELSE start END AS start, stop FROM g WHERE turn > 1),
c AS (SELECT o.rid, o.k, o.piece, o.stop, EXISTS (SELECT 1 FROM x WHERE x.rid = o.rid AND x.start <= o.stop - len(o.piece) AND o.stop <= x.stop) AS gone FROM o),
s AS (SELECT rid, min(stop - len(piece)) AS start, max(stop) AS stop FROM (SELECT *, k - row_number() OVER (PARTITION BY rid ORDER BY k) AS island FROM c WHERE gone) GROUP BY rid, island),
t AS (SELECT rid, string_agg(piece, '' ORDER BY k) FILTER (NOT gone) AS text FROM c GROUP BY 1),
z AS (SELECT rid, string_agg(start || ':' || stop, ',' ORDER BY start) AS removed, count(*) AS n_removed, CAST(sum(stop - start) AS BIGINT) AS n_chars_removed FROM s GROUP BY 1)
SELECT doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(t.text, '') END AS text, coalesce(removed, '') AS removed, coalesce(n_removed, 0) AS n_removed, coalesce(n_chars_removed, 0) AS n_chars_removed
FROM d LEFT JOIN t USING (rid) LEFT JOIN z USING (rid)
"""


ORACLES: dict[str, str] = {
    "op3_secrets": _secrets_sql(),
    "op4_line_dedup": _dedup_sql(),
    "op8_topk": """
WITH base AS (
  SELECT vec_id, row_number() OVER () AS rid, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0
), scored AS (
  SELECT q.vec_id AS query_id, q.rid AS qrid, c.vec_id, c.rid,
         CAST(coalesce(list_sum([q.v[i] * c.v[i] FOR i IN range(1, least(len(q.v), len(c.v)) + 1)]), 0) AS BIGINT) AS score
  FROM base q JOIN base c ON q.rid <> c.rid WHERE q.vec_id % 100 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY qrid ORDER BY score DESC, vec_id, rid) AS rank FROM scored
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 10
""",
}
