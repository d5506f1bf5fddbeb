"""The text operators' registered queries: name -> (Spark callable, number of the operator, DuckDB text or None)."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.registry import Entry
from . import language_id, quality
from .alignment import with_agreement
from .bagminhash import with_classes
from .common import remainder_is, table
from .fingerprints import compare_edits
from .katz import score_texts
from .paragraphs import repeated_paragraphs, repeated_passages
from .packing import pack_documents
from .suffixes import without_repeats
from .surrogates import with_surrogates
from .token_counts import n_bytes, with_token_counts
from .whitening import usable, whiten
from .winnowing import with_contamination

LIMIT_TOKENS = 1024


def languages(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    held_out = remainder_is(F.col("doc_id"), 4, 2)
    model = language_id.fit(docs.where(~held_out))
    found = language_id.with_language(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out.alias("held_out"), F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"))


def fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return compare_edits(table(spark, folder, "documents"))


def near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return with_classes(table(spark, folder, "documents"))


def paragraph_repeats(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    lines, passages = repeated_paragraphs(docs), repeated_passages(docs)
    return lines.withColumn("kind", F.lit("paragraph")).unionByName(passages.withColumn("kind", F.lit("passage")))


def surrogates(spark: SparkSession, folder: str) -> DataFrame:
    return with_surrogates(table(spark, folder, "documents").select("doc_id", "text"))


def language_model(spark: SparkSession, folder: str) -> DataFrame:
    held_out = remainder_is(F.col("doc_id"), 7, 2)
    scored = score_texts(table(spark, folder, "documents"), ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def quality_scores(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    held_out = remainder_is(F.col("doc_id"), 4, 2)
    model = quality.fit(docs, table(spark, folder, "labels").where(~held_out))
    return quality.with_quality(docs, model, out="score").select("doc_id", held_out.alias("held_out"), "score", quality.predicted(F.col("score")).alias("predicted"))


def decontamination(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = with_contamination(docs, table(spark, folder, "benchmark"))
    c = F.col("contamination")
    return found.select("doc_id", c.n_words.alias("n_words"), c.n_hit.alias("n_hit"), F.size(c["items"]).cast("long").alias("n_items"),
                        F.sha2(F.array_join(c["items"], ","), 256).alias("items_sha256"), (c.n_hit > 0).alias("contaminated"))


#: Windows of all texts as strings, joined as they are: short items are windows of their own length.
DECONTAMINATION_SQL = """
WITH docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
items AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
item_at AS (
  SELECT item, ws, least(len(ws), 10) AS n, unnest(generate_series(1, len(ws) - least(len(ws), 10) + 1)) AS i FROM items WHERE len(ws) > 0),
item_windows AS (SELECT DISTINCT item, n, array_to_string(ws[i:i + n - 1], ' ') AS w FROM item_at),
sizes AS (SELECT DISTINCT n FROM item_windows),
doc_at AS (SELECT doc_id, ws, n, unnest(generate_series(1, len(ws) - n + 1)) AS i FROM docs, sizes WHERE len(ws) >= n),
doc_windows AS (SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS w FROM doc_at),
hits AS (SELECT d.doc_id, d.n, d.i, t.item FROM doc_windows d JOIN item_windows t USING (n, w)),
spots AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM hits),
n_spots AS (SELECT doc_id, count(*) AS n_hit FROM spots GROUP BY doc_id),
n_items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
            FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN n_spots USING (doc_id) LEFT JOIN n_items USING (doc_id)"""


def packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack_documents(table(spark, folder, "documents"))


def token_counts(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return with_token_counts(docs).select("doc_id", n_bytes(F.col("text")).alias("n_bytes"), "n_tokens",
                                          (F.col("n_tokens") > LIMIT_TOKENS).alias("over_limit"))


def token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    found = with_agreement(table(spark, folder, "documents").select("doc_id", "text"))
    fields = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    return found.select("doc_id", *[F.col("agreement")[c].alias(c) for c in fields])


def repeated_bytes(spark: SparkSession, folder: str) -> DataFrame:
    found = without_repeats(table(spark, folder, "documents").select("doc_id", "text"))
    r = F.col("repeats")
    return found.select("doc_id", n_bytes(F.col("text")).alias("n_bytes"), r.n_removed.alias("n_removed"), F.size(r.spans).cast("long").alias("n_spans"),
                        F.sha2(r.kept, 256).alias("kept_sha256"))


#: Whole numbers from the entries of a vector: so many per unit, from so many on; entries beyond the range stand at its end.
GRID, ORIGIN, RANGE = 64, 1_000_000, 1 << 52


def whitened_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    on_grid = lambda c: F.greatest(F.least(F.floor(GRID * c.cast("double")), F.lit(RANGE)), F.lit(-RANGE)).cast("long") + ORIGIN
    v = table(spark, folder, "embeddings").where(usable(F.col("embedding"))).select("vec_id", F.transform("embedding", on_grid).alias("x"))
    w = F.col("whitened")
    found = whiten(v, "x").select("vec_id", w.n.alias("n"), F.expr("try_cast(whitened.deviation AS bigint)").alias("deviation"), w.identity_error.alias("identity_error"),
                                  F.posexplode(F.arrays_zip(w["values"].alias("whitened"), w.explained.alias("explained"))).alias("i", "c"))
    return found.select("vec_id", (F.col("i") + 1).alias("component"), "n", "deviation", F.col("c.whitened").alias("whitened"), F.col("c.explained").alias("explained"), "identity_error")


def text_catalogue() -> dict[str, Entry]:
    return {
        "op1_language_id": Entry(languages, "1", None),
        "op2_paragraph_repeats": Entry(paragraph_repeats, "2", None),
        "op3_katz": Entry(language_model, "3", None),
        "op4_fingerprints": Entry(fingerprints, "4", None),
        "op5_surrogates": Entry(surrogates, "5", None),
        "op6_near_duplicates": Entry(near_duplicates, "6", None),
        "op7_quality": Entry(quality_scores, "7", None),
        "op8_decontamination": Entry(decontamination, "8", DECONTAMINATION_SQL),
        "op9_packing": Entry(packing, "9", None),
        "op10_token_counts": Entry(token_counts, "10", None),
        "op11_token_alignment": Entry(token_alignment, "11", None),
        "op12_repeated_bytes": Entry(repeated_bytes, "12", None),
        "op13_whitening": Entry(whitened_embeddings, "13", None),
        "pipeline": Entry(corpus_pipeline.run, "1 6 8 5 9", corpus_pipeline.ORACLE_SQL),
    }
