"""The given tables read as recordings, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flighttone.functions.spectrum import to_db
from flighttone.operators.joins import small_side
from flighttone.operators.order import group_dim
from flighttone.params import Params
from flighttone.scale import with_position

#: 64 samples at 64 Hz.
SIG = Params(
    sr=64, nperseg=32, overlap=16, nfft=32, f_min=4, f_max=32, f1_min=2, f1_max=16, n_mels=5,
    n_mfcc=4, min_samples=64, f1_step=1, segment_ms=1000,
)
#: Recordings at 100 Hz.
WAV = Params(sr=100, f1_min=4, f1_max=25, f_max=50, min_samples=80)
#: One sample per millisecond, with a noise floor in the middle of the data.
PER_MS = Params(sr=1000, noise_floor=0.025)


def r(column: Column | str, digits: int = 6) -> Column:
    """Rounded for comparison; adding zero turns -0.0 into 0.0."""
    c = F.col(column) if isinstance(column, str) else column
    return F.round(c, digits) + F.lit(0.0)


def big(column: Column | str) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return c.cast("bigint")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def ev(spark: SparkSession, folder: str) -> DataFrame:
    """One recording's facts per event."""
    facts = table(spark, folder, "events").select(
        F.col("event_id").alias("rec_id"),
        F.col("event_type").alias("group_name"),
        F.col("ts").alias("dt"),
        F.get_json_object("props", "$.k").cast("double").alias("temp"),
        (F.col("user_id") % 100).cast("double").alias("rh"),
        (F.col("value") + 100).alias("f1"),
        F.col("value").alias("s2n"),
        (F.col("value") + 100).alias("s2n_freq"),
        F.pow(F.col("value") / 1000, F.lit(2)).alias("fd_power"),
        (F.col("event_id") % 6).alias("ha_count"),
        (50.0 + F.col("event_id") % 200).alias("dur_ms"),
        F.col("user_id"),
    )
    return facts.withColumns(
        {
            "fd_power_db": to_db("fd_power"),
            "fd_power_lf": F.col("fd_power") * (F.col("temp") + 1) / 50,
            "filename": F.when(F.col("rec_id") % 7 == 0, F.format_string("clip%d.wav", "rec_id")).otherwise(
                F.format_string(
                    "%s_T%02d.0C_H%02d.0_%d.wav", F.date_format("dt", "yyyy-MM-dd_HH.mm.ss.SSSSSS"),
                    F.col("temp").cast("int"), F.col("rh").cast("int"), "rec_id",
                )
            ),
        }
    )


def grouped(spark: SparkSession, folder: str) -> DataFrame:
    """``ev`` with the group's index as ``label`` and ``group_id``."""
    df = ev(spark, folder)
    ids = small_side(group_dim(df))
    return df.join(ids, "group_name").withColumn("label", F.col("group_id"))


def ordered(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """``rec_id``, ``load_seq`` and the named columns; only these are sorted."""
    df = grouped(spark, folder) if "label" in columns else ev(spark, folder)
    narrow = df.select(*dict.fromkeys(["rec_id", "group_name", *columns]))
    return with_position(narrow, ["group_name", "rec_id"], "load_seq")


def sig(spark: SparkSession, folder: str) -> DataFrame:
    """Embeddings as waveforms."""
    x = F.col("embedding").cast("array<double>")
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("rec_id"), "label", x.alias("waveform"), x.alias("rawdata"),
        x.alias("features"), F.lit(64.0).alias("fs"),
    )


def wav_samples(spark: SparkSession, folder: str) -> DataFrame:
    """Each user's events in order as samples ``rec_id, n, x`` of one recording."""
    events = table(spark, folder, "events")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return events.select(
        F.col("user_id").alias("rec_id"), (F.row_number().over(order) - 1).cast("long").alias("n"),
        ((F.col("value") - 50) / 500).alias("x"),
    )


def wav(spark: SparkSession, folder: str) -> DataFrame:
    """The same recordings as one waveform per row."""
    samples = wav_samples(spark, folder)
    in_order = F.array_sort(F.collect_list(F.struct("n", "x")))
    return samples.groupBy("rec_id").agg(in_order.getField("x").alias("waveform"))


def prob(spark: SparkSession, folder: str) -> DataFrame:
    """Fixed probabilities of three classes."""
    raw = [F.col("doc_id") * m % 10 + 1 for m in (7, 3, 11)]
    total = raw[0] + raw[1] + raw[2]
    return table(spark, folder, "labels").select(
        F.col("doc_id").alias("rec_id"), F.array(*[c / total for c in raw]).alias("probability")
    )


EV = """ev AS (
  SELECT event_id AS rec_id, event_type AS group_name, ts AS dt,
    CAST(regexp_extract(props, '[0-9]+') AS DOUBLE) AS temp,
    CAST(user_id % 100 AS DOUBLE) AS rh, value + 100 AS f1, value AS s2n, value + 100 AS s2n_freq,
    power(value / 1000, 2) AS fd_power, CASE WHEN value = 0 THEN CAST('-inf' AS DOUBLE) ELSE 10 * log10(power(value / 1000, 2)) END AS fd_power_db,
    power(value / 1000, 2) * (CAST(regexp_extract(props, '[0-9]+') AS DOUBLE) + 1) / 50 AS fd_power_lf,
    event_id % 6 AS ha_count, CAST(50 + event_id % 200 AS DOUBLE) AS dur_ms, user_id,
    CASE WHEN event_id % 7 = 0 THEN 'clip' || event_id || '.wav'
      ELSE strftime(ts, '%Y-%m-%d_%H.%M.%S.%f') || '_T' || lpad(regexp_extract(props, '[0-9]+'), 2, '0')
        || '.0C_H' || lpad(CAST(user_id % 100 AS VARCHAR), 2, '0') || '.0_' || event_id || '.wav' END AS filename,
    dense_rank() OVER (ORDER BY event_type) - 1 AS label,
    row_number() OVER (ORDER BY event_type, event_id) - 1 AS load_seq
  FROM events)"""

SIG_SAMPLES = """samples AS (
  SELECT vec_id AS rec_id, label, generate_subscripts(embedding, 1) - 1 AS n,
    CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)"""

WAV_SAMPLES = """wav AS (
  SELECT user_id AS rec_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n,
    (value - 50) / 500 AS x FROM events)"""
