"""Corpus pipeline: language, exact copies, near copies, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written
as Parquet and read again as the next stage's ``docs``.

In every stage null and empty texts are equal, rows with a null id or with equal ids are documents
of their own, a row that is read twice from one file is one document in the stages that remove copies,
an empty table gives an empty table, columns of ``documents`` that are missing are null, and other columns are not read.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flighttone.llm import id_files, languages, packing, recipes, simhash
from flighttone.plans.pipeline import ship
from flighttone.scale import materialize

#: Columns of ``documents``, which all stages but the last return.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
KINDS = ("long", "string", "string", "string", "long")
#: Documents go when no learned language is more probable than this, of those learned.
SURE = 0.5
#: Words of a shingle and differing bits of near copies.
WORDS, BITS = 3, 2


def _columns(docs: DataFrame) -> list[Column]:
    return [F.col(c) if c in docs.columns else F.lit(None).cast(k).alias(c) for c, k in zip(COLUMNS, KINDS)]


def _numbered(docs: DataFrame) -> DataFrame:
    """Rows with their file and place in it, which tells repeated rows apart.

    It is the same in every job, however many executors there are to split the
    files for.  A table that is not read from files is written first.
    """
    try:
        place = docs.metadataColumn("_metadata")
        return docs.select(*_columns(docs), F.concat_ws(":", F.md5(place["file_path"]), place["row_index"]).alias("_row"))
    except AnalysisException:
        return materialize(docs.select(*_columns(docs), F.monotonically_increasing_id().alias("_row")))


def _only(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """Rows that are kept, one of those with the same place in the same file."""
    same = Window.partitionBy("_row").orderBy("_row")
    found = docs.join(kept.select("_row"), "_row", "left_semi")
    return found.withColumn("_nth", F.row_number().over(same)).filter("_nth = 1").select(*COLUMNS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a letter and those of no learned language; where no row has a language, all go."""
    ship(spark)
    docs = docs.select(*_columns(docs))
    path = public_tokenizers.path("piece_bpe_32k.model")
    model = languages.learn(docs.filter(~languages.held_out()), path)
    found = languages.classify(docs.select(*COLUMNS, F.col("text").alias("_text")), model, ["_text", *(c for c in COLUMNS if c != "text")], learned=True)
    kept = found.filter((F.col("lang_pred") != languages.UNDETERMINED) & (F.col("score") > SURE) & F.col("learned"))
    return kept.withColumnRenamed("_text", "text").select(*COLUMNS)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal text, A-Z lower-cased, keep the one with the largest id, a null id only where there is no other."""
    ship(spark)
    rows = _numbered(docs)
    return _only(rows, recipes.exact_copies(rows, row="_row").filter("kept"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by SimHash keep the one with the smallest id, a null id only where there is no other.

    Documents without a word have one fingerprint and are a group.
    """
    ship(spark)
    rows = _numbered(docs)
    groups = simhash.near_copies(rows, "_row", threshold=BITS, words=WORDS)
    first = groups.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row")).alias("first"))
    return _only(rows, first.select(F.col("first._row").alias("_row")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents that are left, packed into windows; a null or empty text is its end id alone."""
    ship(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language", language), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("pack", pack)]
#: Language, SimHash and packing cannot be stated in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages one after the other over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = id_files.shared_folder(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
SQL: dict[str, str] = {}
