"""The queries of this subpackage and, where SQL can express them, their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusloom.llm.chat import digests
from corpusloom.llm.decontam import contained_items
from corpusloom.llm.exact_dedup import exact_groups
from corpusloom.llm.packing import packed
from corpusloom.llm.quality import quality_scores
from corpusloom.llm.simhash import near_groups
from corpusloom.llm.token_counts import edited_counts
from corpusloom.llm.token_files import token_file_round_trip
from corpusloom.llm.toxicity import toxicity_scores
from corpusloom.llm.warc import archive_round_trip


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """The place of a public tokenizer file; its package is outside this repository."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(_table(spark, sf_dir, "documents"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(_table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = [F.struct(F.lit(-1).cast("long").alias("conv_id"), F.lit(k).cast("long").alias("turn"), F.lit(role).alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text")) for k, role in enumerate(("user", "assistant"))]
    return digests(turns.union(spark.range(1).select(F.inline(F.array(*probe)))))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_round_trip(_table(spark, sf_dir, "pages"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file_round_trip(_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_counts(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (op1_exact_dedup, op2_simhash, op3_packing, op4_quality, op5_decontamination, op6_toxicity, op7_chat, op8_warc, op9_token_files, op10_token_counts)
    return {f.__name__: f for f in named}


_WORDS = r"regexp_extract_all(lower({0}), '[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+')"


def _escaped(text: str) -> str:
    """The escape of the chat template, in SQL."""
    out = f"replace({text}, chr(92), chr(92) || chr(92))"
    for c in ("<|", "|>", "</s>", "<s>", "[INST]", "[/INST]"):
        out = f"replace({out}, '{c}', '{c[0]}' || chr(92) || '{c[1:]}')"
    return out


ORACLE = {
    "op1_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""",
    "op5_decontamination": f"""
        WITH d AS (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents),
        b AS (SELECT item_id, {_WORDS.format('text')} AS w FROM benchmark),
        bw AS (SELECT item_id, w, least(5, len(w)) AS k FROM b WHERE len(w) > 0),
        bs AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS s
               FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM bw)),
        ks AS (SELECT DISTINCT k FROM bs),
        ds AS (SELECT DISTINCT doc_id, k, array_to_string(w[i:i + k - 1], ' ') AS s
               FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)),
        n AS (SELECT item_id, count(*) AS item_shingles FROM bs GROUP BY item_id),
        m AS (SELECT doc_id, item_id, count(*) AS shared FROM ds JOIN bs USING (k, s) GROUP BY doc_id, item_id)
        SELECT doc_id, item_id, shared, item_shingles, shared / item_shingles AS containment
        FROM m JOIN n USING (item_id) WHERE shared >= 0.8 * item_shingles - 1e-9""",
    "op7_chat": f"""
        WITH t AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
        o AS (SELECT *, lag(role) OVER w AS prev, lead(role) OVER w AS following FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
        c AS (SELECT conv_id, count(*) AS n_turns,
                string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
                string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text) AS loss,
                CAST(sum(length({_escaped('role')}) + length({_escaped('text')}) + 10) AS BIGINT) AS formatted_chars,
                bool_and(CASE WHEN prev IS NULL THEN role IN ('system', 'user') WHEN prev IN ('system', 'assistant') THEN role = 'user'
                              WHEN prev = 'user' THEN role = 'assistant' ELSE false END) AS valid,
                bool_or(following IS NULL AND role = 'assistant') AS done
              FROM o GROUP BY conv_id)
        SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
               formatted_chars, valid, valid AND done AS complete FROM c""",
    "op8_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages),
        g AS (SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY html) ELSE page_id END AS first FROM p)
        SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN first = page_id THEN NULL ELSE first END AS refers_to FROM g""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
