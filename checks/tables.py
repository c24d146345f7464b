"""Checks on recording facts: names, order, filters, joins, statistics, views."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.fixtures import EV, big, ev, grouped, ordered, r, table
from flighttone.functions import names
from flighttone.operators import clean, joins, order, stats, views
from flighttone.scale import ensure_checkpoint_dir
from flighttone.sources import sinks

QUERIES: dict = {}
SQL: dict[str, str] = {}


def check(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def scratch(spark: SparkSession) -> str:
    """A new folder beside the checkpoints, which all executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/out-{uuid.uuid4().hex}"


# --- names, groups, load order ------------------------------------------------


@check("decode_filename", f"""WITH {EV},
parts AS (SELECT rec_id, filename, string_split(left(filename, length(filename) - 4), '_') AS p FROM ev),
got AS (SELECT rec_id, left(filename, length(filename) - 4) AS name, len(p) = 5 AS five,
  try_strptime(p[1] || ' ' || p[2], '%Y-%m-%d %H.%M.%S.%f') AS dt,
  TRY_CAST(substr(p[3], 2, 4) AS DOUBLE) AS temp, TRY_CAST(substr(p[4], 2, 4) AS DOUBLE) AS rh FROM parts),
ok AS (SELECT *, coalesce(five AND dt IS NOT NULL AND temp IS NOT NULL AND rh IS NOT NULL, false) AS ok FROM got)
SELECT rec_id, CASE WHEN ok THEN CAST(dt AS TIMESTAMP) ELSE TIMESTAMP '2019-01-01 00:00:00' END AS dt,
  CASE WHEN ok THEN temp ELSE 25.0 END AS temp, CASE WHEN ok THEN rh ELSE 0.0 END AS rh,
  ok AS name_decoded, right(name, 50) AS title FROM ok""")
def decode_filename(spark: SparkSession, d: str) -> DataFrame:
    df = names.split_path(ev(spark, d).select("rec_id", F.col("filename").alias("path")))
    return names.decode_filename(df).select("rec_id", "dt", "temp", "rh", "name_decoded", "title")


def _files(spark: SparkSession, d: str) -> DataFrame:
    return ev(spark, d).select(
        "rec_id",
        F.concat(
            F.lit("/data/"), "group_name", F.when(F.col("rec_id") % 3 == 0, "/deep").otherwise(""),
            F.format_string("/u%d/", F.col("user_id") % 10), "filename",
        ).alias("path"),
    )


_FILES = f"""WITH {EV}, dirs AS (SELECT rec_id, group_name, filename, '/data/' || group_name
  || CASE WHEN rec_id % 3 = 0 THEN '/deep' ELSE '' END || '/u' || (user_id % 10) AS dir FROM ev)"""


@check("group_dim", """SELECT dense_rank() OVER (ORDER BY event_type) - 1 AS group_id, event_type AS group_name
FROM (SELECT DISTINCT event_type FROM events)""")
def group_dim(spark: SparkSession, d: str) -> DataFrame:
    found = order.with_group(_files(spark, d), "/data")
    return order.group_dim(found).select(big("group_id").alias("group_id"), "group_name")


@check("load_order", _FILES + """
SELECT rec_id, row_number() OVER (ORDER BY group_name, list_append(string_split(dir, '/'), chr(1114111)), filename) - 1 AS load_seq
FROM dirs""")
def load_order(spark: SparkSession, d: str) -> DataFrame:
    return order.with_load_seq(order.with_group(_files(spark, d), "/data")).select("rec_id", "load_seq")


@check("load_report", """SELECT event_type AS group_name, count(*) AS n,
  CAST(sum(count(*)) OVER () AS BIGINT) AS total FROM events GROUP BY event_type""")
def load_report(spark: SparkSession, d: str) -> DataFrame:
    return stats.load_report(ev(spark, d))


@check("load_report_empty", """SELECT event_type AS group_name, count(*) FILTER (event_id % 5 = 0 AND event_type > 'd') AS n,
  CAST(sum(count(*) FILTER (event_id % 5 = 0 AND event_type > 'd')) OVER () AS BIGINT) AS total FROM events GROUP BY event_type""")
def load_report_empty(spark: SparkSession, d: str) -> DataFrame:
    """Groups without a file that could be read have their row."""
    known = ev(spark, d)
    return stats.load_report(known.filter("rec_id % 5 = 0 and group_name > 'd'"), order.group_dim(known))


# --- filters -------------------------------------------------------------------


@check("clean_low_value", "SELECT event_id AS rec_id FROM events WHERE NOT value < 20")
def clean_low_value(spark: SparkSession, d: str) -> DataFrame:
    return clean.drop_low_s2n(ev(spark, d), 20).select("rec_id")


@check("clean_low_value_removed", "SELECT event_id AS rec_id FROM events WHERE value < 20")
def clean_low_value_removed(spark: SparkSession, d: str) -> DataFrame:
    return clean.split(ev(spark, d), clean.good_s2n(20))[1].select("rec_id")


@check("clean_low_power", f"WITH {EV} SELECT rec_id FROM ev WHERE NOT fd_power < 1.0 / 1000")
def clean_low_power(spark: SparkSession, d: str) -> DataFrame:
    return clean.drop_low_power(ev(spark, d), 1).select("rec_id")


@check("clean_lf", f"WITH {EV} SELECT rec_id FROM ev WHERE NOT fd_power_lf * 1.5 > fd_power")
def clean_lf(spark: SparkSession, d: str) -> DataFrame:
    return clean.drop_lf(ev(spark, d), 1.5).select("rec_id")


@check("clean_harmonics", "SELECT event_id AS rec_id FROM events WHERE NOT event_id % 6 < 3")
def clean_harmonics(spark: SparkSession, d: str) -> DataFrame:
    return clean.drop_few_harmonics(ev(spark, d), 3).select("rec_id")


@check("drop_ids", """SELECT e.event_id AS rec_id FROM events e WHERE NOT EXISTS (
  SELECT 1 FROM orders o WHERE o.o_orderkey = e.event_id AND o.o_orderstatus = 'F')""")
def drop_ids(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("rec_id"))
    return clean.drop_recordings(ev(spark, d), ids).select("rec_id")


# --- joins ------------------------------------------------------------------------


def _assignments(spark: SparkSession, d: str) -> DataFrame:
    return ev(spark, d).select(
        "rec_id", (F.col("user_id") % 7 - 1).cast("int").alias("label"),
        (F.col("rec_id") % 2 == 0).alias("is_core"),
    )


@check("label_join", """SELECT event_id AS rec_id, user_id % 7 - 1 AS label, event_id % 2 = 0 AS is_core,
  round(value + 100, 6) AS f1 FROM events""")
def label_join(spark: SparkSession, d: str) -> DataFrame:
    joined = joins.with_labels(ev(spark, d).select("rec_id", "f1"), _assignments(spark, d))
    return joined.select("rec_id", big("label").alias("label"), "is_core", r("f1").alias("f1"))


@check("label_names", """WITH g AS (SELECT event_type, dense_rank() OVER (ORDER BY event_type) - 1 AS id
  FROM (SELECT DISTINCT event_type FROM events))
SELECT e.event_id AS rec_id, e.user_id % 7 - 1 AS label, coalesce(g.event_type, 'Poor Match') AS label_name
FROM events e LEFT JOIN g ON g.id = e.user_id % 7 - 1""")
def label_names(spark: SparkSession, d: str) -> DataFrame:
    dim = order.group_dim(ev(spark, d))
    named = joins.with_label_names(_assignments(spark, d), dim)
    return named.select("rec_id", big("label").alias("label"), "label_name")


@check("relabel", """SELECT e.event_id AS rec_id,
  coalesce(CASE WHEN o.o_orderstatus = 'F' THEN 9 END, e.user_id % 7 - 1) AS label
FROM events e LEFT JOIN orders o ON o.o_orderkey = e.event_id""")
def relabel(spark: SparkSession, d: str) -> DataFrame:
    corrected = table(spark, d, "orders").filter("o_orderstatus = 'F'").select(
        F.col("o_orderkey").alias("rec_id"), F.lit(9).alias("label")
    )
    return joins.relabel(_assignments(spark, d), corrected).select("rec_id", big("label").alias("label"))


@check("cycle_label", """SELECT event_id AS rec_id,
  CASE WHEN event_id = 11 THEN (user_id % 7 - 1 + 1) % 6 ELSE user_id % 7 - 1 END AS label FROM events""")
def cycle_label(spark: SparkSession, d: str) -> DataFrame:
    return joins.cycle_label(_assignments(spark, d), 11, 6).select("rec_id", big("label").alias("label"))


# --- statistics ---------------------------------------------------------------------

_GROUP = """count(*) AS n, round(avg(f1), 6) + 0.0 AS f1_mean, round(median(f1), 6) + 0.0 AS f1_median,
  round(stddev_pop(f1), 6) + 0.0 AS f1_std, round(regr_slope(f1, temp), 6) + 0.0 AS slope,
  round(regr_r2(f1, temp), 6) + 0.0 AS r2"""


@check("group_summary", f"WITH {EV} SELECT group_name, {_GROUP} FROM ev GROUP BY group_name")
def group_summary(spark: SparkSession, d: str) -> DataFrame:
    found = stats.group_summary(ev(spark, d), "group_name")
    return found.select("group_name", "n", *[r(c).alias(c) for c in ("f1_mean", "f1_median", "f1_std", "slope", "r2")])


@check("collection_summary", f"""WITH {EV} SELECT count(*) AS n, round(avg(f1), 6) AS f1_mean,
  round(median(f1), 6) AS f1_median, round(stddev_pop(f1), 6) AS f1_std, round(avg(dur_ms), 6) AS dur_mean,
  round(stddev_pop(dur_ms), 6) AS dur_std FROM ev""")
def collection_summary(spark: SparkSession, d: str) -> DataFrame:
    found = stats.summary(ev(spark, d))
    return found.select("n", *[r(c).alias(c) for c in ("f1_mean", "f1_median", "f1_std", "dur_mean", "dur_std")])


@check("temp_regression", f"""WITH {EV}, all_groups AS (
  SELECT 'all' AS part, regr_slope(f1, temp) AS s, regr_r2(f1, temp) AS q FROM ev
  UNION ALL SELECT group_name, regr_slope(f1, temp), regr_r2(f1, temp) FROM ev GROUP BY group_name
  UNION ALL SELECT 'constant', 0.0, 0.0)
SELECT part, round(s, 6) + 0.0 AS slope, round(q, 6) + 0.0 AS r2 FROM all_groups""")
def temp_regression(spark: SparkSession, d: str) -> DataFrame:
    df = ev(spark, d)
    flat = stats.temp_coefficient(df.withColumn("temp", F.lit(20.0)))
    parts = (
        stats.temp_coefficient(df).select(F.lit("all").alias("part"), "slope", "r2")
        .unionByName(stats.temp_coefficient(df, ["group_name"]).withColumnRenamed("group_name", "part"))
        .unionByName(flat.select(F.lit("constant").alias("part"), "slope", "r2"))
    )
    return parts.select("part", r("slope").alias("slope"), r("r2").alias("r2"))


@check("group_counts", "SELECT event_type AS label, count(*) AS n FROM events GROUP BY event_type")
def group_counts(spark: SparkSession, d: str) -> DataFrame:
    return stats.group_counts(ev(spark, d).withColumnRenamed("group_name", "label"))


@check("balance", """WITH c AS (SELECT event_type AS label, count(*) AS n FROM events GROUP BY event_type)
SELECT label, n, round((SELECT max(n) / min(n) FROM c), 6) AS ratio FROM c""")
def balance(spark: SparkSession, d: str) -> DataFrame:
    found = stats.balance_report(ev(spark, d).withColumnRenamed("group_name", "label"))
    return found.select("label", "n", r("ratio").alias("ratio"))


def _distribution_sql(column: str, edges) -> str:
    cases = " ".join(
        f"WHEN {column} >= {lo} AND {column} {'<=' if hi == float('inf') else '<'} "
        f"{'CAST(' + repr(str(hi)) + ' AS DOUBLE)' if hi == float('inf') else hi} THEN {i}"
        for i, (lo, hi) in enumerate(zip(edges, edges[1:]))
    )
    return f"""WITH {EV}, placed AS (SELECT group_name, CASE {cases} END AS bin FROM ev),
counts AS (SELECT group_name, bin, count(*) AS n FROM placed WHERE bin IS NOT NULL GROUP BY ALL),
grid AS (SELECT group_name, b AS bin FROM (SELECT DISTINCT group_name FROM ev), range({len(edges) - 1}) t(b)),
filled AS (SELECT g.group_name, g.bin, coalesce(c.n, 0) AS n FROM grid g LEFT JOIN counts c USING (group_name, bin))
SELECT group_name, bin, n, round(n / nullif(sum(n) OVER (PARTITION BY group_name), 0), 6) AS share FROM filled"""


def _shares(df: DataFrame) -> DataFrame:
    return df.select("group_name", big("bin").alias("bin"), big("n").alias("n"), r("share").alias("share"))


@check("s2n_dist", _distribution_sql("s2n", stats.S2N_EDGES))
def s2n_dist(spark: SparkSession, d: str) -> DataFrame:
    return _shares(stats.s2n_distribution(ev(spark, d), "group_name"))


@check("power_dist", _distribution_sql("fd_power_db", stats.POWER_EDGES))
def power_dist(spark: SparkSession, d: str) -> DataFrame:
    return _shares(stats.power_distribution(ev(spark, d), "group_name"))


_HIST = f"""WITH {EV}, placed AS (SELECT group_name, least(floor((f1 - 100) / 10), 89) AS bin FROM ev
  WHERE f1 BETWEEN 100 AND 1000),
counts AS (SELECT group_name, bin, count(*) AS n FROM placed GROUP BY ALL),
grid AS (SELECT group_name, b AS bin FROM (SELECT DISTINCT group_name FROM ev), range(90) t(b)),
hist AS (SELECT g.group_name, g.bin, coalesce(c.n, 0) AS n FROM grid g LEFT JOIN counts c USING (group_name, bin))"""


@check("freq_hist", _HIST + " SELECT group_name, bin, n, 100.0 + bin * 10.0 AS f_low FROM hist")
def freq_hist(spark: SparkSession, d: str) -> DataFrame:
    found = stats.freq_histogram(ev(spark, d), "group_name")
    return found.select("group_name", big("bin").alias("bin"), big("n").alias("n"), "f_low")


@check("freq_kde", _HIST + """,
kde AS (SELECT group_name, 100.0 + g * 2 AS freq,
  CASE WHEN g IN (0, 449) THEN 0 ELSE sum(exp(-0.5 * power((100.0 + g * 2 - f1) / 10, 2)))
    / (count(*) * 10 * sqrt(2 * pi())) END AS v FROM ev, range(450) t(g) GROUP BY group_name, g),
top AS (SELECT group_name, max(n) AS top FROM hist GROUP BY group_name)
SELECT group_name, freq, round(v * top / max(v) OVER (PARTITION BY group_name), 6) AS density
FROM kde JOIN top USING (group_name)""")
def freq_kde(spark: SparkSession, d: str) -> DataFrame:
    found = stats.freq_kde(ev(spark, d), "group_name")
    return found.select("group_name", "freq", r("density").alias("density"))


@check("activity_by_hour", """WITH counts AS (SELECT event_type, hour(ts) AS hour, count(*) AS n FROM events GROUP BY ALL),
grid AS (SELECT event_type, h AS hour FROM (SELECT DISTINCT event_type FROM events), range(24) t(h))
SELECT event_type AS group_name, hour, coalesce(n, 0) AS n FROM grid LEFT JOIN counts USING (event_type, hour)""")
def activity_by_hour(spark: SparkSession, d: str) -> DataFrame:
    found = stats.activity_by_hour(ev(spark, d), "group_name")
    return found.select("group_name", big("hour").alias("hour"), big("n").alias("n"))


# --- evaluation ------------------------------------------------------------------------


def _cm(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "labels").select(F.col("quality").alias("label"), F.col("toxic").alias("prediction"))


@check("confusion", """SELECT quality AS "true", toxic AS pred, count(*) AS n,
  round(count(*) / sum(count(*)) OVER (PARTITION BY quality), 6) AS share FROM labels GROUP BY quality, toxic""")
def confusion(spark: SparkSession, d: str) -> DataFrame:
    found = stats.confusion(_cm(spark, d))
    return found.select(big("true").alias("true"), big("pred").alias("pred"), "n", r("share").alias("share"))


def _metrics_sql(tp: str, tn: str, fp: str, fn: str) -> str:
    return f"""round(({tp} + {tn}) / nullif({tp} + {tn} + {fp} + {fn}, 0), 6) AS accuracy,
  round({tp} / nullif({fn} + {tp}, 0), 6) AS tpr, round({fp} / nullif({tn} + {fp}, 0), 6) AS fpr,
  round({fn} / nullif({fn} + {tp}, 0), 6) AS fnr, round({tp} / nullif({fp} + {tp}, 0), 6) AS precision,
  round({tn} / nullif({tn} + {fn}, 0), 6) AS npv, round(({tp} + {fn}) / nullif({tp} + {tn} + {fp} + {fn}, 0), 6) AS prevalence"""


_METRICS = ("accuracy", "tpr", "fpr", "fnr", "precision", "npv", "prevalence")


@check("confusion_metrics", f"""WITH c AS (SELECT count(*) FILTER (quality = 1 AND toxic = 1) AS tp,
  count(*) FILTER (quality = 0 AND toxic = 0) AS tn, count(*) FILTER (quality = 0 AND toxic = 1) AS fp,
  count(*) FILTER (quality = 1 AND toxic = 0) AS fn FROM labels)
SELECT {_metrics_sql('tp', 'tn', 'fp', 'fn')} FROM c""")
def confusion_metrics(spark: SparkSession, d: str) -> DataFrame:
    return stats.binary_metrics(_cm(spark, d)).select(*[r(c).alias(c) for c in _METRICS])


@check("accuracy", "SELECT round(avg(CASE WHEN quality = toxic THEN 1 ELSE 0 END), 6) AS accuracy FROM labels")
def accuracy(spark: SparkSession, d: str) -> DataFrame:
    return stats.accuracy(_cm(spark, d)).select(r("accuracy").alias("accuracy"))


@check("class_metrics", f"""WITH k AS (SELECT DISTINCT event_type AS class FROM events),
t AS (SELECT event_type AS l, lag(event_type) OVER (ORDER BY event_id) AS p FROM events),
c AS (SELECT class, count(*) FILTER (l = class AND p = class) AS tp,
  count(*) FILTER (l <> class AND p <> class) AS tn, count(*) FILTER (l <> class AND p = class) AS fp,
  count(*) FILTER (l = class AND p <> class) AS fn FROM t, k WHERE p IS NOT NULL GROUP BY class)
SELECT class, {_metrics_sql('tp', 'tn', 'fp', 'fn')} FROM c""")
def class_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Each event's type "predicted" by the type of the event before it."""
    e = table(spark, d, "events").select("event_id", F.col("event_type").alias("label"))
    last = e.select((F.col("event_id") + 1).alias("event_id"), F.col("label").alias("prediction"))
    found = stats.class_metrics(e.join(last, "event_id"))
    return found.select("class", *[r(c).alias(c) for c in _METRICS])


# --- order --------------------------------------------------------------------------------


@check("interarrival", f"""WITH {EV}, t AS (SELECT rec_id, load_seq,
  (epoch_us(dt) - epoch_us(lag(dt) OVER (ORDER BY load_seq))) / 1000000.0 AS td FROM ev)
SELECT rec_id, load_seq, round(td, 6) AS td, coalesce(td < 0.5, false) AS close_to_prev FROM t""")
def interarrival(spark: SparkSession, d: str) -> DataFrame:
    found = order.flag_close(order.interarrival(ordered(spark, d, "dt"), block=1000))
    return found.select("rec_id", "load_seq", r("td").alias("td"), "close_to_prev")


@check("interarrival_by_group", f"""WITH {EV} SELECT rec_id,
  round((epoch_us(dt) - epoch_us(lag(dt) OVER (PARTITION BY group_name ORDER BY load_seq))) / 1000000.0, 6) AS td FROM ev""")
def interarrival_by_group(spark: SparkSession, d: str) -> DataFrame:
    rows = ordered(spark, d, "dt")
    return order.interarrival(rows, by=["group_name"]).select("rec_id", r("td").alias("td"))


@check("elapsed", f"""WITH {EV} SELECT rec_id,
  CAST(floor((epoch_us(dt) - epoch_us((SELECT min_by(dt, load_seq) FROM ev))) / 1000000.0) AS BIGINT) AS elapsed_s FROM ev""")
def elapsed(spark: SparkSession, d: str) -> DataFrame:
    return order.elapsed(ordered(spark, d, "dt")).select("rec_id", big("elapsed_s").alias("elapsed_s"))


_KEYS = {"original": "", "s2n": "s2n, s2n_freq,", "f1": "f1,", "cluster": "label,"}


def _position(key: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        rows = ordered(spark, d, *order.ORDERS[key])
        return order.order_position(rows, key).select("rec_id", "position")

    return run


for _key, _columns in _KEYS.items():
    check(f"order_by_{_key}", f"""WITH {EV} SELECT rec_id,
  row_number() OVER (ORDER BY {_columns} load_seq) AS position FROM ev""")(_position(_key))


@check("order_position", f"WITH {EV} SELECT rec_id, row_number() OVER (ORDER BY temp, load_seq) AS position FROM ev")
def order_position(spark: SparkSession, d: str) -> DataFrame:
    from flighttone.scale import with_position

    rows = ordered(spark, d, "temp")
    return with_position(rows, ["temp", "load_seq"], "position", start=1).select("rec_id", "position")


@check("neighbour", f"""WITH {EV}, p AS (SELECT rec_id, f1, row_number() OVER (ORDER BY f1, load_seq) AS position FROM ev)
SELECT rec_id, position, round(f1, 6) AS f1 FROM p WHERE position = greatest(1, least(
  (SELECT position FROM p WHERE rec_id = 123) + 1, (SELECT max(position) FROM p)))""")
def neighbour(spark: SparkSession, d: str) -> DataFrame:
    rows = ordered(spark, d, "f1")
    found = order.neighbour(order.order_position(rows, "f1"), 123, 1)
    return found.select("rec_id", "position", r("f1").alias("f1"))


@check("cluster_bounds", f"""WITH {EV}, c AS (SELECT label, count(*) AS n FROM ev GROUP BY label)
SELECT label, n, CAST(sum(n) OVER (ORDER BY label) AS BIGINT) AS upto FROM c""")
def cluster_bounds(spark: SparkSession, d: str) -> DataFrame:
    return order.cluster_bounds(grouped(spark, d)).select(big("label").alias("label"), "n", "upto")


# --- views and exports -----------------------------------------------------------------------


def _view_sql(x: str, y: str) -> str:
    return f"""WITH {EV} SELECT rec_id, round({x}, 6) AS x, round({y}, 6) AS y, user_id % 7 - 1 AS label,
  rec_id % 2 = 0 AS is_core FROM ev"""


_VIEW_X = "CAST(hour(dt) * 3600 + minute(dt) * 60 + second(dt) AS DOUBLE)"
_VIEWS = {
    "view_power_f1": ("power_vs_f1", "f1", "fd_power_db"),
    "view_f1_temp": ("f1_vs_temp", "temp", "f1"),
    "view_f1_rh": ("f1_vs_rh", "rh", "f1"),
    "view_f1_time": ("f1_vs_time", _VIEW_X, "f1"),
}


def _scatter(view: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        found = views.scatter(ev(spark, d), _assignments(spark, d), view)
        return found.select(
            "rec_id", r(F.col("x").cast("double")).alias("x"), r("y").alias("y"), big("label").alias("label"), "is_core"
        )

    return run


for _name, (_view, _x, _y) in _VIEWS.items():
    check(_name, _view_sql(_x, _y))(_scatter(_view))


@check("view_temp", f"""WITH {EV} SELECT rec_id, row_number() OVER (ORDER BY f1, load_seq) AS position, temp FROM ev""")
def view_temp(spark: SparkSession, d: str) -> DataFrame:
    return views.temp_along(ordered(spark, d, "f1", "temp"), "f1").select("rec_id", "position", "temp")


@check("recording_detail", f"""WITH {EV} SELECT rec_id, round(f1, 6) AS f1, ha_count, dur_ms, round(s2n, 6) AS s2n,
  round(s2n_freq, 6) AS s2n_freq, round(1000 * fd_power, 9) AS power_x1000,
  round(1000 * fd_power_lf, 11) AS lf_x1000, temp, rh FROM ev""")
def recording_detail(spark: SparkSession, d: str) -> DataFrame:
    found = views.recording_detail(ev(spark, d))
    return found.select(
        "rec_id", "ha_count", "dur_ms", "temp", "rh",
        *[r(c).alias(c) for c in ("f1", "s2n", "s2n_freq")],
        r("power_x1000", 9).alias("power_x1000"), r("lf_x1000", 11).alias("lf_x1000"),
    )


@check("export_rows", f"""WITH {EV} SELECT rec_id, strftime(dt, '%Y-%b-%d %H:%M:%S') AS time,
  CAST(floor((epoch_us(dt) - epoch_us((SELECT min_by(dt, load_seq) FROM ev))) / 1000000.0) AS BIGINT) AS elapsed_s,
  label AS cluster, temp, rh, dur_ms, round(s2n, 6) AS s2n, round(fd_power, 12) AS fd_power FROM ev""")
def export_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = order.elapsed(ordered(spark, d, "dt", "label", "temp", "rh", "f1", "dur_ms", "s2n", "s2n_freq", "ha_count", "fd_power")).withColumns(
        {"ac_f1": F.col("f1"), "ac_coeff": F.lit(1.0), "ha_f1": F.col("f1"), "fs": F.lit(64.0), "waveform": F.array("f1", "s2n")}
    )
    return sinks.export_rows(rows).select(
        "rec_id", "time", big("elapsed_s").alias("elapsed_s"), big("cluster").alias("cluster"), "temp", "rh",
        "dur_ms", r("s2n").alias("s2n"), r("fd_power", 12).alias("fd_power"),
    )


@check("export_file", f"""WITH {EV} SELECT strftime(dt, '%Y-%b-%d %H:%M:%S') AS time,
  CAST(floor((epoch_us(dt) - epoch_us((SELECT min_by(dt, load_seq) FROM ev))) / 1000000.0) AS BIGINT) AS elapsed_s,
  label AS cluster, temp, rh, round(f1, 6) AS ac_f1, round(s2n / 1000, 6) AS ac_coeff, round(f1 + 1, 6) AS ha_f1, ha_count, dur_ms,
  round(s2n, 6) AS s2n, round(s2n_freq, 6) AS s2n_freq, round(fd_power, 12) AS fd_power, 64.0 AS fs,
  round(f1 + 2 * s2n, 6) AS waveform FROM ev""")
def export_file(spark: SparkSession, d: str) -> DataFrame:
    """The written file, read back: all columns of the header, the waveform as a weighted sum of its samples."""
    rows = order.elapsed(ordered(spark, d, "dt", "label", "temp", "rh", "f1", "dur_ms", "s2n", "s2n_freq", "ha_count", "fd_power")).withColumns(
        {"ac_f1": F.col("f1"), "ac_coeff": F.col("s2n") / 1000, "ha_f1": F.col("f1") + 1, "fs": F.lit(64.0), "waveform": F.array("f1", "s2n")}
    )
    folder = scratch(spark)
    sinks.write_results(rows, folder)
    cells = spark.read.text(folder).filter(F.col("value") != ",".join(sinks.CSV_HEADER)).select(F.split("value", ",").alias("c"))
    whole, number = {"elapsed_s": 1, "cluster": 2, "ha_count": 8}, {"temp": 3, "rh": 4, "ac_f1": 5, "ac_coeff": 6, "ha_f1": 7, "dur_ms": 9, "s2n": 10, "s2n_freq": 11, "fs": 13}
    at = lambda i: F.col("c")[i].cast("double")
    return cells.select(
        F.col("c")[0].alias("time"), *[F.col("c")[i].cast("long").alias(n) for n, i in whole.items()], *[r(at(i)).alias(n) for n, i in number.items()],
        r(at(12), 12).alias("fd_power"), r(at(14) + 2 * at(15)).alias("waveform"),
    )


@check("cluster_partition_counts", """SELECT dense_rank() OVER (ORDER BY event_type) - 1 AS cluster, count(*) AS n
FROM events GROUP BY event_type""")
def cluster_partition_counts(spark: SparkSession, d: str) -> DataFrame:
    """Written by cluster, read back by directory."""
    folder = scratch(spark)
    sinks.write_by_cluster(grouped(spark, d).select("rec_id", "label", "f1"), folder)
    return spark.read.parquet(folder).groupBy(big("cluster").alias("cluster")).agg(F.count(F.lit(1)).alias("n"))
