"""The per-recording operators on a directory that is still being filled."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType, TimestampType, StringType

from flighttone.operators.joins import small_side
from flighttone.operators.order import below, root_path
from flighttone.params import DEFAULT, Params
from flighttone.sources.wav import decode_files

FILES = StructType(
    [
        StructField("path", StringType()),
        StructField("modificationTime", TimestampType()),
        StructField("length", LongType()),
        StructField("content", BinaryType()),
    ]
)


def stream_recordings(spark: SparkSession, root: str, group_dim: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """New files below ``root`` as recordings, with the ids of the groups known in ``group_dim``.

    Files directly below ``root`` are left out, as in a finished tree, unless ``group_dim`` holds the root's own name, which is then their group.
    Files of a new group are kept; their ``group_id`` is null until the group is known.

    Decoding and every attribute are maps over files, so they need no state and
    no watermark; load order and gaps are left to the finished table.
    """
    files = (
        spark.readStream.schema(FILES).format("binaryFile")
        .option("recursiveFileLookup", True).option("pathGlobFilter", "*.wav").load(root)
    )
    plain = root_path(spark, root)
    files = files.withColumn("path", F.regexp_replace("path", "^file:/+", "/"))
    inside = below(F.col("path"), plain)
    placed = files.withColumns(
        {"rec_id": F.xxhash64("path"), "group_name": F.regexp_extract(inside, r"^([^/]+)/", 1)}
    )
    own = plain.rsplit("/", 1)[-1]
    if not group_dim.filter(F.col("group_name") == own).isEmpty():
        loose = (F.col("group_name") == "") & (inside != "")
        placed = placed.withColumn("group_name", F.when(loose, F.lit(own)).otherwise(F.col("group_name")))
    grouped = placed.filter("group_name <> ''")
    return decode_files(grouped.join(small_side(group_dim), "group_name", "left"), p)
