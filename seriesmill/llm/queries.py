"""The registered queries of the ten operators, and SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ctw, decontaminate, mixing, pii, simhash, substrings, tokens, topk, toxicity, warc
from .common import materialise, table, word_count


def tokenizer_file(name: str) -> str:
    """Where the public vocabulary files are installed."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of passages that repeat across documents, with their class and whether they are removed."""
    return substrings.repeated(table(spark, sf_dir, "documents"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as WARC records, read back."""
    read = warc.round_trip(table(spark, sf_dir, "pages"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best candidates of every fiftieth vector, against all others."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


def quality_weight(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs with _weight: 2 and 1/2 for labelled good and bad quality, 1 elsewhere."""
    marks = labels.groupBy(F.col("doc_id").alias("__sm_l")).agg(F.max("quality").alias("__sm_quality"))
    docs = docs.join(marks, F.col("doc_id") == F.col("__sm_l"), "left").drop("__sm_l")
    return docs.withColumn("__sm_weight", F.when(F.col("__sm_quality") == 1, 2.0).when(F.col("__sm_quality") == 0, 0.5).otherwise(1.0)).drop("__sm_quality")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mix of all documents, weighted by labelled quality."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("words"))
    docs = quality_weight(docs, table(spark, sf_dir, "labels"))
    mixed = mixing.mix(materialise(docs, "mix-rows"), weight="__sm_weight", size="words")
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "epochs")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data, and of terms that reveal them, in all documents."""
    return pii.digest(pii.find(table(spark, sf_dir, "documents")))


def op6_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents, written as sorted-string-table shards and read back."""
    return tokens.token_table(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents by a model of the labelled rows that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return found.select("doc_id", digits.alias("fingerprint"), "component_id")


def op9_ctw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code lengths of all documents under the context-tree model and the unigram baseline."""
    return ctw.score(table(spark, sf_dir, "documents"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, with the item and how similar the best window is."""
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op9_ctw": op9_ctw,
    "op1_substrings": op1_substrings,
    "op7_toxicity": op7_toxicity,
    "op5_pii": op5_pii,
    "op10_decontaminate": op10_decontaminate,
    "op2_warc": op2_warc,
    "op4_topk": op4_topk,
    "op6_tokens": op6_tokens,
    "op8_simhash": op8_simhash,
    "op3_mixing": op3_mixing,
}

ORACLES = {
    "op2_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS payload_digest FROM p),
b AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes >= 1000) END AS best FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN best > page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN best > page_id THEN best END AS refers_to
FROM b""",
    "op4_topk": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op3_mixing": r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         CASE WHEN q = 1 THEN 2.0 WHEN q = 0 THEN 0.5 ELSE 1.0 END::DOUBLE AS w
  FROM documents LEFT JOIN (SELECT doc_id AS l, max(quality) AS q FROM labels GROUP BY 1) ON l = doc_id),
k AS (SELECT *, -ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT + 0.5)::DOUBLE / 4503599627370496.0) / w AS key FROM d),
s AS (
  SELECT source, sum(size)::DOUBLE AS source_size,
         CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS w
  FROM d GROUP BY source),
l AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE
             - coalesce(sum(2 * source_size) OVER (ORDER BY 2 * source_size / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w) OVER (ORDER BY 2 * source_size / w, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s),
t AS (
  SELECT source, source_size,
         CASE WHEN 2 * source_size / w <= level THEN 2 * source_size
              ELSE w * max(CASE WHEN 2 * source_size / w > level THEN level END) OVER () END AS target FROM l),
r AS (
  SELECT k.*, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS epochs,
         coalesce(sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size::BIGINT AS source_size, target,
       (epochs * size + greatest(0, least(size, round(target - epochs * source_size)::BIGINT - before)))::BIGINT AS taken,
       source, epochs
FROM r""",
}
