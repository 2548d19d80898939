"""One registered query for each operator, with production parameters, over its whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pathfold.llm.chat_rotation import rotate
from pathfold.llm.fingerprints import compare_with_next
from pathfold.llm.hyper_minhash import near_classes
from pathfold.llm.language_id import identify, train
from pathfold.llm.line_dedup import dedup_lines
from pathfold.llm.ngram_join import link_classes
from pathfold.llm.oracles import REPAIR, vector_codes
from pathfold.llm.piece_codec import encode
from pathfold.llm.quality_rules import judge_quality
from pathfold.llm.secret_scan import BASE_KINDS, scan_secrets
from pathfold.llm.source_mix import plan_mix
from pathfold.llm.structure_repair import damaged, digests, repair
from pathfold.llm.token_counts import count_tokens
from pathfold.llm.vector_codes import codebooks_sha256, encode_vectors, fit_codebooks, label_errors


def documents(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet").select(*columns)


def op1_line_dedup(spark: SparkSession, d: str) -> DataFrame:
    out = dedup_lines(documents(spark, d, "doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op2_token_counts(spark: SparkSession, d: str) -> DataFrame:
    return count_tokens(documents(spark, d, "doc_id", "text"), piece_model(), keep=["doc_id"])


def op3_piece_codec(spark: SparkSession, d: str) -> DataFrame:
    """Encoded texts, and the digest of what the ids decode to."""
    out = encode(documents(spark, d, "doc_id", "text"), piece_model(), keep=["doc_id"], decoded=True)
    return out.select("doc_id", "ids", "n_pieces", "score", "next_best", F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_chat_rotation(spark: SparkSession, d: str) -> DataFrame:
    out = rotate(spark.read.parquet(f"{d}/conversations.parquet"))
    spans = F.transform("masks", lambda m: F.concat_ws("-", m["start"], m["end"]))
    return out.withColumn("masks", F.concat_ws(",", spans))


def op5_quality_rules(spark: SparkSession, d: str) -> DataFrame:
    labels = spark.read.parquet(f"{d}/labels.parquet")
    return judge_quality(documents(spark, d, "doc_id", "text", "lang"), labels, keep=["doc_id"])


def span_text(spans) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))


def op6_secret_scan(spark: SparkSession, d: str) -> DataFrame:
    found = scan_secrets(documents(spark, d, "doc_id", "text"), keep=["doc_id"])
    kinds = F.transform("secrets", lambda s: s["kind"])
    base = F.filter("secrets", lambda s: s["kind"].isin(*BASE_KINDS))
    counts = [(F.size("secrets") - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(span_text(base), 256).alias("base_sha256"), span_text(F.col("secrets")).alias("spans"))


def op7_ngram_join(spark: SparkSession, d: str) -> DataFrame:
    return link_classes(documents(spark, d, "doc_id", "text"), n=3, t=0.9).drop("text_key", "root")


def op8_language_id(spark: SparkSession, d: str) -> DataFrame:
    docs = documents(spark, d, "doc_id", "text", "lang")
    part = F.crc32(F.col("doc_id").cast("string")) % 4
    fitted = train(docs, part.isin(0, 3), part == 1)
    marked = docs.select("doc_id", F.coalesce(part == 2, F.lit(False)).alias("held_out"), "text")
    return identify(marked, fitted, keep=["doc_id", "held_out"])


def op9_document_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    return compare_with_next(documents(spark, d, "doc_id", "text"))


def op10_source_mix(spark: SparkSession, d: str) -> DataFrame:
    plan = plan_mix(documents(spark, d, "doc_id", "text", "source"))
    taken = (F.col("size") * F.col("copies")).alias("taken")
    return plan.select("doc_id", "source", "size", "source_size", "target", taken, "copies")


def op11_structure_repair(spark: SparkSession, d: str) -> DataFrame:
    """Every conversation's repair after the damage; one that lost all its rows has zeros."""
    given = spark.read.parquet(f"{d}/conversations.parquet")
    report, rows = repair(damaged(given))
    told = digests(rows).select(F.col("conv_id").alias("d"), "repaired_sha256")
    found = report.join(told, F.col("conv_id").eqNullSafe(F.col("d")), "left").withColumnRenamed("conv_id", "c")
    out = given.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("c")), "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    digest = F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256")
    return out.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), digest)


def op12_hyper_minhash(spark: SparkSession, d: str) -> DataFrame:
    return near_classes(documents(spark, d, "doc_id", "text"), n=2, percent=80)


def op13_vector_codes(spark: SparkSession, d: str) -> DataFrame:
    vectors = spark.read.parquet(f"{d}/embeddings.parquet")
    books, width = fit_codebooks(vectors)
    coded = label_errors(encode_vectors(vectors, books, width, keep=["vec_id", "label"]))
    return coded.select("vec_id", "code", "error", "label_error", F.lit(codebooks_sha256(books)).alias("codebooks_sha256"))


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_token_counts": op2_token_counts,
    "op3_piece_codec": op3_piece_codec,
    "op4_chat_rotation": op4_chat_rotation,
    "op5_quality_rules": op5_quality_rules,
    "op6_secret_scan": op6_secret_scan,
    "op7_ngram_join": op7_ngram_join,
    "op8_language_id": op8_language_id,
    "op9_document_fingerprints": op9_document_fingerprints,
    "op10_source_mix": op10_source_mix,
    "op11_structure_repair": op11_structure_repair,
    "op12_hyper_minhash": op12_hyper_minhash,
    "op13_vector_codes": op13_vector_codes,
}

ORACLES = {
    "op11_structure_repair": REPAIR,
    "op13_vector_codes": vector_codes(),
    "op1_line_dedup": r"""
WITH lines AS (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
        generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
    FROM documents),
keyed AS (
    SELECT doc_id, pos, line,
        translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM lines),
repeated AS (
    SELECT key, max(doc_id) AS last_doc FROM keyed WHERE length(key) >= 20
    GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (
    SELECT k.doc_id, k.pos, k.line, r.key IS NOT NULL AND k.doc_id <> r.last_doc AS dropped
    FROM keyed k LEFT JOIN repeated r ON k.key = r.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
""",
    "op4_chat_rotation": r"""
WITH speakers AS (
    SELECT DISTINCT conv_id, role AS participant FROM conversations WHERE role IS NOT NULL AND role <> 'system'),
views AS (
    SELECT s.conv_id, s.participant, coalesce(c.turn // 256, 18014398509481984) * 256 AS part,
        c.turn, c.role, coalesce(c.text, '') AS body,
        '<|im_start|>' || CASE WHEN c.role = s.participant THEN 'assistant' WHEN c.role = 'system' THEN 'system'
            WHEN c.role IS NULL THEN 'user' ELSE 'user name=' || c.role END || chr(10) AS head
    FROM speakers s JOIN conversations c ON s.conv_id IS NOT DISTINCT FROM c.conv_id),
numbered AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id, participant, part ORDER BY turn NULLS LAST, role NULLS FIRST, body) AS nth
    FROM views),
placed AS (
    SELECT *, CAST((nth - 1) // 4096 AS INTEGER) AS slice,
        coalesce(sum(length(head) + length(body) + 11) OVER (PARTITION BY conv_id, participant, part, (nth - 1) // 4096
            ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos
    FROM numbered),
rendered AS (
    SELECT conv_id, participant, part, slice, CAST(count(*) AS INTEGER) AS n_turns,
        string_agg(head || body || '<|im_end|>' || chr(10), '' ORDER BY nth) AS text,
        coalesce(string_agg((pos + length(head)) || '-' || (pos + length(head) + length(body) + 10), ',' ORDER BY nth)
            FILTER (role = participant), '') AS masks
    FROM placed GROUP BY ALL)
SELECT *, CAST(coalesce(sum(length(text)) OVER (PARTITION BY conv_id, participant ORDER BY part, slice
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset"
FROM rendered
""",
}
