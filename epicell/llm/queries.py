"""The registered queries of the corpus operators, and their SQL where SQL can express them.

Each query reads its whole table, calls its operator with the operator's default parameters, and
derives the columns that are compared.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from epicell.llm import (
    bit_slices,
    byte_cnn,
    importance,
    lexicon_bpe,
    line_templates,
    ngram_join,
    packing,
    periodic_runs,
    quality,
    rotated_codes,
    sentence_pieces,
    toxicity,
    warc,
)
from epicell.llm.bpe import Vocabulary
from epicell.llm.common import remainder, ship_package

WORD_VOCABULARY = "word_bpe_49k.json"
BYTE_VOCABULARY = "byte_bpe_50k.json"
PIECE_MODEL = "piece_bpe_32k.model"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def held_out(parts: int, value: int) -> Column:
    return F.coalesce(remainder("doc_id", parts) == value, F.lit(False))


def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    labels = table(spark, folder, "labels").where(~held_out(3, 1))
    model = toxicity.train(documents, labels)
    tagged = toxicity.tag_toxicity(documents, model, keep=["doc_id"])
    return tagged.select(
        "doc_id",
        held_out(3, 1).alias("held_out"),
        F.col("toxicity").alias("score"),
        (F.col("toxicity") >= 0.7).cast("int").alias("predicted"),
        "toxic_spans",
    )


def op2_quality(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    labels = table(spark, folder, "labels").where(~held_out(5, 0))
    model = quality.train(documents, labels, metadata=["n_chars"])
    scored = quality.score_quality(documents, model, keep=["doc_id"])
    return scored.select(
        "doc_id",
        held_out(5, 0).alias("held_out"),
        F.col("quality_score").alias("score"),
        (F.col("quality_score") >= 0.3).cast("int").alias("predicted"),
    )


def op3_rotated_codes(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    return rotated_codes.nearest(vectors, vectors.where("vec_id % 20 = 0"))


def op4_lexicon_bpe(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    vocabulary = Vocabulary.load(public_tokenizers.path(BYTE_VOCABULARY))
    lexicon = lexicon_bpe.build_lexicon(documents, vocabulary)
    encoded = lexicon_bpe.encode(documents, lexicon, vocabulary, keep=["doc_id"])
    return lexicon_bpe.decode(encoded, vocabulary).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


def op5_language(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    model = byte_cnn.train(documents.where(~held_out(3, 1)))
    found = byte_cnn.identify(documents, model, keep=["doc_id"])
    return found.select("doc_id", held_out(3, 1).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op6_line_templates(spark: SparkSession, folder: str) -> DataFrame:
    cleaned = line_templates.drop_recurring_lines(table(spark, folder, "documents"))
    return cleaned.select("doc_id", "text", "dropped_lines")


def op7_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.link_documents(table(spark, folder, "documents"))


def op8_packing(spark: SparkSession, folder: str) -> DataFrame:
    sequences = packing.pack(table(spark, folder, "documents"), public_tokenizers.path(WORD_VOCABULARY))
    return packing.piece_digests(sequences)


def op9_bit_slices(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    return bit_slices.top_k(vectors, vectors.where("vec_id % 50 = 0"))


def op10_warc(spark: SparkSession, folder: str) -> DataFrame:
    records = warc.round_trip(spark, table(spark, folder, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_importance(spark: SparkSession, folder: str) -> DataFrame:
    drawn = importance.resample(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op12_sentence_pieces(spark: SparkSession, folder: str) -> DataFrame:
    model = public_tokenizers.path(PIECE_MODEL)
    encoded = sentence_pieces.encode(table(spark, folder, "documents"), model, keep=["doc_id"])
    return sentence_pieces.decode(encoded, model).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def repeat_tail(text: Column, key: Column) -> Column:
    """The text with a periodic tail for every tenth key: from word a on, its first p words are repeated.

    With h the crc32 of the key as text, g = floor(h / 10) and n words: a = g mod n and p = 1 + floor((n - a) / (3 + g mod 8)), where
    h mod 10 is 0 and n > 0. Other texts, and those of NULL keys, stay as they are.
    """
    words = F.array_remove(F.split(text, "[\\x20\\x09-\\x0D]+"), "")
    h = F.crc32(key.cast("string").cast("binary"))
    g, n = F.floor(h / 10), F.size(words)
    a = F.pmod(g, F.greatest(n, F.lit(1))).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    copies = F.ceil((n - a) / p).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(F.slice(words, a + 1, p), copies)), F.lit(1), n - a)
    planted = F.array_join(F.concat(F.slice(words, F.lit(1), a), tail), " ")
    return F.when((h % 10 == 0) & (n > 0), planted).otherwise(text)


def op13_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    planted = documents.select("doc_id", repeat_tail(F.col("text"), F.col("doc_id")).alias("text"))
    found = periodic_runs.find_runs(planted, keep=["doc_id"])
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("rest"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    listed = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(F.lit(""))
    length, period = -F.col("best.rest"), F.col("best.period")
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.floor(1000 * length / period).cast("long").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        op1_toxicity,
        op2_quality,
        op3_rotated_codes,
        op4_lexicon_bpe,
        op5_language,
        op6_line_templates,
        op7_ngram_join,
        op8_packing,
        op9_bit_slices,
        op10_warc,
        op11_importance,
        op12_sentence_pieces,
        op13_periodic_runs,
    )
}

OP9_SQL = """
WITH v AS (
  SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS w
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    CAST(list_sum([p[1] * p[2] FOR p IN list_zip(q.w, c.w)]) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(c.w) = len(q.w)
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""

OP10_SQL = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS body FROM pages
), d AS (
  SELECT page_id, octet_length(body) AS payload_bytes, sha1(body) AS digest FROM p
), k AS (
  SELECT *, max(page_id) OVER (PARTITION BY digest) AS first_id FROM d
), b AS (
  SELECT *, [CAST(strpos('0123456789abcdef', digest[i + 1]) - 1 AS INTEGER) FOR i IN range(40)] AS nibbles FROM k
), bits AS (
  SELECT *, [(nibbles[i // 4 + 1] >> CAST(3 - i % 4 AS INTEGER)) & 1 FOR i IN range(160)] AS bits FROM b
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
  list_aggregate([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 +
    bits[5 * i + 1] * 16 + bits[5 * i + 2] * 8 + bits[5 * i + 3] * 4 + bits[5 * i + 4] * 2 + bits[5 * i + 5] AS INTEGER), 1) FOR i IN range(32)],
    'string_agg', '') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM bits
"""

ORACLES: dict[str, str] = {"op6_line_templates": line_templates.oracle_sql(), "op9_bit_slices": OP9_SQL, "op10_warc": OP10_SQL}
