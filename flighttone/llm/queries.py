"""One query for each operator over its whole table, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from flighttone.llm import (
    id_files,
    languages,
    licenses,
    line_rules,
    lines,
    negatives,
    packing,
    phrases,
    piece_model,
    recipes,
    simhash,
    turns,
    urls,
)


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def op1_pack(spark: SparkSession, folder: str) -> DataFrame:
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    return packing.pack(_documents(spark, folder), tokenizer).drop("step_group")


def op2_id_files(spark: SparkSession, folder: str) -> DataFrame:
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    files = id_files.write(_documents(spark, folder), id_files.shared_folder(spark, "ids"), tokenizer, end_id=2)
    return id_files.read(files)


def op3_licenses(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(_documents(spark, folder))


def op4_piece_model(spark: SparkSession, folder: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return piece_model.encode(_documents(spark, folder), ranks, public_tokenizers.PATTERN)


def op5_lines(spark: SparkSession, folder: str) -> DataFrame:
    return lines.drop_common_lines(_documents(spark, folder))


def op6_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_copies(_documents(spark, folder))


def op7_urls(spark: SparkSession, folder: str) -> DataFrame:
    return urls.judge(spark.read.parquet(f"{folder}/pages.parquet"))


def op8_languages(spark: SparkSession, folder: str) -> DataFrame:
    return languages.languages(_documents(spark, folder), public_tokenizers.path("piece_bpe_32k.model"))


def op9_phrases(spark: SparkSession, folder: str) -> DataFrame:
    return phrases.fingerprints(_documents(spark, folder))


def op10_exact_copies(spark: SparkSession, folder: str) -> DataFrame:
    return recipes.exact_copies(_documents(spark, folder)).drop("n_chunks")


def op11_line_rules(spark: SparkSession, folder: str) -> DataFrame:
    return line_rules.judge(_documents(spark, folder))


def op12_turns(spark: SparkSession, folder: str) -> DataFrame:
    return turns.digests(spark.read.parquet(f"{folder}/conversations.parquet"))


def op13_negatives(spark: SparkSession, folder: str) -> DataFrame:
    return negatives.mine(spark.read.parquet(f"{folder}/embeddings.parquet"))


QUERIES = {
    "op1_pack": op1_pack,
    "op2_id_files": op2_id_files,
    "op3_licenses": op3_licenses,
    "op4_piece_model": op4_piece_model,
    "op5_lines": op5_lines,
    "op6_simhash": op6_simhash,
    "op7_urls": op7_urls,
    "op8_languages": op8_languages,
    "op9_phrases": op9_phrases,
    "op10_exact_copies": op10_exact_copies,
    "op11_line_rules": op11_line_rules,
    "op12_turns": op12_turns,
    "op13_negatives": op13_negatives,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL = {
    "op3_licenses": licenses.sql(),
    "op5_lines": """
        WITH split AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
        l AS (SELECT r, doc_id, pos, parts[pos] AS line FROM (SELECT r, doc_id, parts, unnest(range(1, len(parts) + 1)) AS pos FROM split)),
        k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                                  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
        common AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT r) >= 10)
        SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(common.key) AS n_dropped,
               sha256(coalesce(string_agg(CASE WHEN common.key IS NULL THEN line END, chr(10) ORDER BY pos), '')) AS kept_sha256
        FROM k LEFT JOIN common USING (key) GROUP BY r""",
    "op10_exact_copies": f"""
        WITH d AS (SELECT doc_id, {_LOWER} AS t FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
        FROM d WINDOW w AS (PARTITION BY t)""",
    "op11_line_rules": line_rules.sql(),
    "op13_negatives": negatives.sql(),
}
