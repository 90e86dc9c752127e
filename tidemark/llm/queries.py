"""The registered queries of the training-data operators and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, conversation_repair, exact_dedup, filter_audit, language_id, line_dedup, maxscore, mixing, ngram_join, oracle_sql, pii_crf, quality_gam, sharding, token_files
from tidemark.llm.shared import documents, new_folder
from tidemark.session import bounded_batches

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents that share at least nine tenths of their three-word shingles."""
    return ngram_join.similar_components(documents(spark, sf_dir), ngram_join.Join(width=3, percent=90))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts and the row of each that stays."""
    return exact_dedup.exact_groups(documents(spark, sf_dir))


def op3_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded to ids and decoded again, with digests of both."""
    return bpe.round_trip(documents(spark, sf_dir).select("doc_id", "text"), BYTE_BPE).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op4_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best neighbours of every hundredth vector by integer inner product."""
    vectors = maxscore.integer_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), scale=1024)
    return maxscore.top_k(vectors, F.col("vec_id") % 100 == 0, k=10)


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts written as token-id files and read back, with each document's place and checksum."""
    folder = new_folder(spark, "token-files")
    token_files.write(documents(spark, sf_dir), BYTE_BPE, folder)
    return token_files.read_checksums(spark, folder)


def op6_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every text by a model of the labels outside the held-out fold."""
    docs = documents(spark, sf_dir)
    held_out = language_id.fold("doc_id", 4) == 2
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out)
    model = quality_gam.learn(docs, labels)
    scored = quality_gam.score(docs.select("doc_id", "text", held_out.alias("held_out")), model).drop("text")
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in forty shards that match the mixture of sources, row counts at most one apart."""
    text = F.coalesce("text", F.lit(""))
    rows = documents(spark, sf_dir).select("doc_id", "source", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    dealt = sharding.interleaved_shards(rows, 40, identity=("doc_id", "text_crc32", "size"))
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words that a mix of all sources by weights 5, 2, 1 takes of each document."""
    sized = documents(spark, sf_dir).select("doc_id", "source", mixing.word_count("text").alias("size"))
    return mixing.mix_sources(sized, weights=(5, 2, 1), budget=1.5, cap=2)


def op9_pii_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every text: counts and a digest of the patterns' spans, all spans, and how many the field added."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = pii_crf.find(docs, pii_crf.learn(docs)).drop("text")

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = F.filter("spans", lambda s: s["base"])
    kinds = F.transform(base, lambda s: s["kind"])
    counts = [F.size(F.filter(kinds, lambda x: x == F.lit(k))).cast("long").alias(f"n_{k}") for k in pii_crf.KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), (F.size("spans") - F.size(base)).cast("long").alias("n_added"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every text by profiles from the documents outside the held-out fold."""
    docs = documents(spark, sf_dir)
    held_out = language_id.fold("doc_id", 5) == 0
    profiles = language_id.learn(docs.where(~held_out))
    return language_id.predict(docs.select("doc_id", "text", held_out.alias("held_out")), profiles).drop("text")


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text without the lines of ten code points or more that a document of a smaller id has."""
    found = line_dedup.deduplicated(documents(spark, sf_dir), shortest=10, least=2)
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of five filters removes, in every order of them, by language."""
    docs = documents(spark, sf_dir).select("doc_id", F.col("lang").alias("part"), "text")
    return filter_audit.audit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cheapest repair of every conversation after faults were put into its turns."""
    bounded_batches(spark)
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return conversation_repair.summary(conversation_repair.damaged(rows), rows.select("conv_id"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_bpe_round_trip": op3_bpe_round_trip,
    "op4_maxscore": op4_maxscore,
    "op5_token_files": op5_token_files,
    "op6_quality_gam": op6_quality_gam,
    "op7_sharding": op7_sharding,
    "op8_mixing": op8_mixing,
    "op9_pii_crf": op9_pii_crf,
    "op10_language_id": op10_language_id,
    "op11_line_dedup": op11_line_dedup,
    "op12_filter_audit": op12_filter_audit,
    "op13_conversation_repair": op13_conversation_repair,
}

#: Lower-cases A-Z alone.
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES: dict[str, str] = {
    "op11_line_dedup": oracle_sql.LINE_DEDUP,
    "op12_filter_audit": oracle_sql.FILTER_AUDIT,
    "op13_conversation_repair": oracle_sql.CONVERSATION_REPAIR,
    "op1_ngram_jaccard_join": rf"""
        WITH RECURSIVE split AS (
          SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
        sets AS (
          SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
            ELSE list_transform(range(1, len(w) - 1), lambda i: concat_ws(' ', w[i], w[i + 1], w[i + 2])) END) AS s FROM split),
        shingles AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
        common AS (
          SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS shared
          FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        links AS (SELECT a, b FROM common WHERE 100 * shared >= 90 * (na + nb - shared)),
        reach(doc_id, seen) AS (
          SELECT doc_id, doc_id FROM documents UNION SELECT links.b, seen FROM reach JOIN links ON links.a = reach.doc_id)
        SELECT sets.doc_id, len(s) AS n_shingles, min(seen) AS component_id
        FROM sets JOIN reach ON reach.doc_id = sets.doc_id GROUP BY sets.doc_id, len(s)""",
    "op2_exact_dedup": f"""
        WITH texts AS (SELECT doc_id, {_LOWER} AS t FROM documents)
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
          doc_id = max(doc_id) OVER same AS kept, sha256(t) AS text_sha256
        FROM texts WINDOW same AS (PARTITION BY t)""",
    "op4_maxscore": """
        WITH sound AS (
          SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
          WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        scored AS (
          SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
          FROM sound q JOIN sound c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
        FROM scored QUALIFY rank <= 10""",
    "op8_mixing": r"""
        WITH docs AS (
          SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
        sizes AS (
          SELECT source, CAST(sum(size) AS DOUBLE) AS s, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM docs GROUP BY source),
        need AS (SELECT *, list_extract([5.0::DOUBLE, 2.0, 1.0], (k - 1) % 3 + 1) AS w FROM sizes),
        sorted AS (
          SELECT *, s * 2 / w AS need, coalesce(sum(s * 2) OVER before, 0) AS full_size, coalesce(sum(w) OVER before, 0) AS full_weight,
            sum(w) OVER () AS all_weight, sum(s) OVER () * 1.5::DOUBLE AS budget
          FROM need WINDOW before AS (ORDER BY s * 2 / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        levels AS (SELECT *, (budget - full_size) / (all_weight - full_weight) AS level FROM sorted),
        chosen AS (SELECT level FROM levels WHERE level <= need ORDER BY need, level LIMIT 1),
        goals AS (SELECT source, k, CAST(s AS BIGINT) AS source_size, least(s * 2, coalesce(w * (SELECT level FROM chosen), s * 2)) AS target FROM levels),
        laid AS (
          SELECT d.*, g.k, g.source_size, g.target,
            coalesce(sum(size) OVER (PARTITION BY g.k ORDER BY md5(concat_ws(':', 'mix0', doc_id)), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s0,
            coalesce(sum(size) OVER (PARTITION BY g.k ORDER BY md5(concat_ws(':', 'mix1', doc_id)), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s1
          FROM docs d JOIN goals g ON d.source IS NOT DISTINCT FROM g.source)
        SELECT doc_id, laid.source, size, source_size, target,
          CAST(greatest(0, least(size, floor(target) - s0)) + greatest(0, least(size, floor(target) - source_size - s1)) AS BIGINT) AS taken
        FROM laid""",
}
