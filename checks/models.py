"""Checks on feature matrices, clusterings, classifiers and their sinks."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.fixtures import EV, SIG, SIG_SAMPLES, big, ev, grouped, prob, r, sig, table
from checks.tables import scratch
from flighttone.functions import names, spectrum
from flighttone.operators import affinity, classify, cluster, features, neighbours, pairwise
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


def _cells(df: DataFrame, digits: int = 6) -> DataFrame:
    rows = df.select("rec_id", F.posexplode("features").alias("pos", "x"))
    return rows.select("rec_id", big("pos").alias("pos"), r("x", digits).alias("x"))


# --- feature matrices ---------------------------------------------------------------


@check("features_raw", f"WITH {SIG_SAMPLES} SELECT rec_id, n AS pos, round(x, 6) + 0.0 AS x FROM samples")
def features_raw(spark: SparkSession, d: str) -> DataFrame:
    made, _ = features.build_features(sig(spark, d), features.FeatureSpec("RAW"), SIG)
    return _cells(made)


@check("feature_params", f"""WITH {EV}, c AS (SELECT rec_id, [f1, (temp - 5) / 50, fd_power] AS f FROM ev)
SELECT rec_id, pos - 1 AS pos, round(f[pos], 12) + 0.0 AS x FROM c, range(1, 4) t(pos)""")
def feature_params(spark: SparkSession, d: str) -> DataFrame:
    rows = ev(spark, d).withColumn("temp_norm", names.normalise_temp("temp"))
    made, _ = features.build_features(rows, features.FeatureSpec("f1", temp=True, power=True))
    return _cells(made, 12)


@check("scale_standard", f"""WITH {SIG_SAMPLES} SELECT rec_id, n AS pos,
  round((x - avg(x) OVER w) / stddev_pop(x) OVER w, 6) + 0.0 AS x FROM samples WINDOW w AS (PARTITION BY n)""")
def scale_standard(spark: SparkSession, d: str) -> DataFrame:
    return _cells(features.scale(sig(spark, d), "StandardScaler"))


@check("scale_normalizer", f"""WITH {SIG_SAMPLES} SELECT rec_id, n AS pos,
  round(x / sqrt(sum(x * x) OVER (PARTITION BY rec_id)), 6) + 0.0 AS x FROM samples""")
def scale_normalizer(spark: SparkSession, d: str) -> DataFrame:
    return _cells(features.scale(sig(spark, d), "Normalizer"))


@check("scale_robust", f"""WITH {SIG_SAMPLES}, q AS (SELECT n, median(x) AS c,
  quantile_cont(x, 0.75) - quantile_cont(x, 0.25) AS s FROM samples GROUP BY n)
SELECT rec_id, n AS pos, round((x - c) / s, 6) + 0.0 AS x FROM samples JOIN q USING (n)""")
def scale_robust(spark: SparkSession, d: str) -> DataFrame:
    return _cells(features.scale(sig(spark, d), "RobustScaler"))


@check("temp_bucket", f"""WITH {EV} SELECT rec_id,
  CAST(greatest(0, least(100, round_even((temp - 5) / 0.5, 0))) AS BIGINT) AS slot FROM ev""")
def temp_bucket(spark: SparkSession, d: str) -> DataFrame:
    hot = features.temp_one_hot(ev(spark, d))
    return hot.select("rec_id", big(F.array_position("temp_one_hot", 1.0) - 1).alias("slot"))


@check("pca")
def pca(spark: SparkSession, d: str) -> DataFrame:
    made, _ = features.build_features(sig(spark, d), features.FeatureSpec("RAW", reduce="pca"), SIG)
    return _cells(made, 5)


@check("pca_total", f"""WITH {SIG_SAMPLES}, c AS (SELECT n, var_pop(x) AS v, avg(x) AS m FROM samples GROUP BY n)
SELECT round(sum(v), 6) AS variance, 0.0 AS mean FROM c""")
def pca_total(spark: SparkSession, d: str) -> DataFrame:
    """All components together keep the variance, around a mean of zero."""
    x = sig(spark, d)
    cells = features.apply_pca(x, features.fit_pca(x, 64)).select(F.posexplode("features").alias("pos", "x"))
    each = cells.groupBy("pos").agg(F.var_pop("x").alias("v"), F.abs(F.avg("x")).alias("m"))
    return each.agg(r(F.sum("v")).alias("variance"), r(F.max("m")).alias("mean"))


@check("pca_covariance", """SELECT a AS i, b AS j, 0.0 AS cov, true AS falling FROM range(64) t(a), range(64) u(b)
WHERE a < b AND EXISTS (SELECT 1 FROM embeddings)""")
def pca_covariance(spark: SparkSession, d: str) -> DataFrame:
    """Components do not vary together, and each varies less than those before."""
    x = sig(spark, d)
    scores = features.apply_pca(x, features.fit_pca(x, 64))
    i, j = F.explode(F.sequence(F.lit(0), F.lit(62))), F.explode(F.sequence(F.col("i") + 1, F.lit(63)))
    pairs = scores.select("features", i.alias("i")).select("features", "i", j.alias("j"))
    a, b = F.get("features", F.col("i")), F.get("features", F.col("j"))
    made = pairs.groupBy("i", "j").agg(
        r(F.covar_pop(a, b), 9).alias("cov"), (F.var_pop(a) >= F.var_pop(b)).alias("falling")
    )
    return made.select(big("i").alias("i"), big("j").alias("j"), "cov", "falling")


@check("mfcc_features_scaled", "SELECT count(*) AS n, 0.0 AS mean, 0.0 AS spread FROM embeddings")
def mfcc_features_scaled(spark: SparkSession, d: str) -> DataFrame:
    """How far any scaled column is from mean 0 and spread 1."""
    each = mfcc_features(spark, d).groupBy("pos").agg(
        F.count(F.lit(1)).alias("n"), F.abs(F.avg("x")).alias("m"), F.abs(F.stddev_pop("x") - 1).alias("s")
    )
    return each.agg(F.max("n").alias("n"), r(F.max("m"), 3).alias("mean"), r(F.max("s"), 3).alias("spread"))


@check("mfcc_features")
def mfcc_features(spark: SparkSession, d: str) -> DataFrame:
    """The default features, reduced, with power, scaled."""
    x = spectrum.psd_db(spectrum.welch_psd(sig(spark, d), SIG))
    x = spectrum.mfcc(spectrum.mel_spectrum(x, SIG), SIG)
    x = spectrum.band_power(x, SIG, lo=SIG.f_min, name="fd_power")
    made, _ = features.build_features(x, features.FeatureSpec("MFCC", "pca", power=True, scaler="StandardScaler"), SIG)
    return _cells(made, 4)


@check("rbm")
def rbm(spark: SparkSession, d: str) -> DataFrame:
    x = features.scale(sig(spark, d), "Normalizer")
    return _cells(features.apply_rbm(x, features.fit_rbm(x, 2 * 64)), 5)


@check("feature_sink", f"WITH {SIG_SAMPLES} SELECT rec_id, n AS pos, label, round(x, 6) + 0.0 AS x FROM samples")
def feature_sink(spark: SparkSession, d: str) -> DataFrame:
    """Written under the descriptor's name and read back."""
    folder = scratch(spark)
    made, _ = features.build_features(sig(spark, d), features.FeatureSpec("RAW"), SIG)
    name = sinks.save_features(made, folder)
    x = spark.read.parquet(f"{folder}/X_{name}")
    y = spark.read.parquet(f"{folder}/y_{name}").select("rec_id", big("label").alias("label"))
    return _cells(x).join(y, "rec_id")


@check("project_2d")
def project_2d(spark: SparkSession, d: str) -> DataFrame:
    return features.project_2d(sig(spark, d))


@check("neighbour_affinity")
def neighbour_affinity(spark: SparkSession, d: str) -> DataFrame:
    return affinity.neighbour_affinity(sig(spark, d), 50)


@check("affinity_perplexity", "SELECT vec_id AS rec_id, 1.0 AS total, 50.0 AS perplexity FROM embeddings")
def affinity_perplexity(spark: SparkSession, d: str) -> DataFrame:
    """Each recording's shares add up to 1 and spread as over 50 equal neighbours."""
    cells = affinity.conditional_affinity(sig(spark, d), 50)
    entropy = -F.sum(F.when(F.col("p") > 0, F.col("p") * F.log("p")).otherwise(0.0))
    return cells.groupBy("rec_id").agg(r(F.sum("p")).alias("total"), r(F.exp(entropy), 3).alias("perplexity"))


# --- distances and clusters -------------------------------------------------------------

_PAIRS = """v AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
pairs AS (SELECT a.id, b.id AS other, a.label, b.label AS other_label,
  list_distance(a.e, b.e) AS dist FROM v a, v b)"""


@check("silhouette", f"""WITH {_PAIRS},
m AS (SELECT id, label, other_label, sum(dist) AS s, count(*) AS n FROM pairs GROUP BY id, label, other_label),
ab AS (SELECT id, max(CASE WHEN label = other_label THEN s / nullif(n - 1, 0) END) AS a,
  max(CASE WHEN label = other_label THEN n END) AS n, min(CASE WHEN label <> other_label THEN s / n END) AS b
  FROM m GROUP BY id)
SELECT round(avg(CASE WHEN n = 1 THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM ab""")
def silhouette(spark: SparkSession, d: str) -> DataFrame:
    return pairwise.silhouette(sig(spark, d)).select(r("silhouette").alias("silhouette"))


@check("silhouette_squared", f"""WITH {_PAIRS},
m AS (SELECT id, label, other_label, sum(dist * dist) AS s, count(*) AS n FROM pairs GROUP BY id, label, other_label),
ab AS (SELECT id, max(CASE WHEN label = other_label THEN s / nullif(n - 1, 0) END) AS a,
  max(CASE WHEN label = other_label THEN n END) AS n, min(CASE WHEN label <> other_label THEN s / n END) AS b
  FROM m GROUP BY id)
SELECT round(avg(CASE WHEN n = 1 THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM ab""")
def silhouette_squared(spark: SparkSession, d: str) -> DataFrame:
    return pairwise.silhouette(sig(spark, d), method="squared").select(r("silhouette").alias("silhouette"))


@check("nearest", f"""WITH {_PAIRS}, ranked AS (SELECT id, other, dist,
  row_number() OVER (PARTITION BY id ORDER BY dist, other) AS place FROM pairs WHERE id <> other)
SELECT id AS rec_id, other, round(dist, 6) AS distance, place FROM ranked WHERE place <= 4""")
def nearest(spark: SparkSession, d: str) -> DataFrame:
    found = neighbours.nearest(sig(spark, d), 4)
    return found.select("rec_id", "other", r("distance").alias("distance"), big("place").alias("place"))


def _dbscan_sql(radii: tuple[float, ...]) -> str:
    values = ", ".join(f"(CAST({e} AS DOUBLE))" for e in radii)
    return f"""WITH RECURSIVE {_PAIRS}, radii(eps) AS (VALUES {values}),
near AS (SELECT eps, id, other FROM pairs, radii WHERE dist <= eps),
core AS (SELECT eps, id FROM near GROUP BY eps, id HAVING count(*) >= 5),
link AS (SELECT n.eps, n.id, n.other FROM near n JOIN core a ON a.eps = n.eps AND a.id = n.id
  JOIN core b ON b.eps = n.eps AND b.id = n.other),
reach AS (SELECT eps, id, id AS root FROM core UNION SELECT l.eps, l.other, r.root FROM reach r
  JOIN link l ON l.eps = r.eps AND l.id = r.id WHERE r.root < l.other),
comp AS (SELECT eps, id, min(root) AS root FROM reach GROUP BY eps, id),
named AS (SELECT eps, root, dense_rank() OVER (PARTITION BY eps ORDER BY root) - 1 AS label
  FROM (SELECT DISTINCT eps, root FROM comp)),
cored AS (SELECT c.eps, c.id, n.label FROM comp c JOIN named n ON n.eps = c.eps AND n.root = c.root),
edge AS (SELECT n.eps, n.id, min(c.label) AS label FROM near n JOIN cored c ON c.eps = n.eps AND c.id = n.other GROUP BY n.eps, n.id)
SELECT radii.eps, v.id AS rec_id, coalesce(c.label, e.label, -1) AS label, c.id IS NOT NULL AS is_core
FROM v CROSS JOIN radii LEFT JOIN cored c ON c.id = v.id AND c.eps = radii.eps
LEFT JOIN edge e ON e.id = v.id AND e.eps = radii.eps"""


@check("dbscan", f"SELECT rec_id, label, is_core FROM ({_dbscan_sql((1.15,))})")
def dbscan(spark: SparkSession, d: str) -> DataFrame:
    return cluster.dbscan(sig(spark, d), 1.15).select("rec_id", big("label").alias("label"), "is_core")


@check("dbscan_sweep", _dbscan_sql((1.12, 1.15, 1.18)))
def dbscan_sweep(spark: SparkSession, d: str) -> DataFrame:
    found = cluster.dbscan_sweep(sig(spark, d), [1.12, 1.15, 1.18])
    return found.select("eps", "rec_id", big("label").alias("label"), "is_core")


@check("file_groups", "SELECT event_id AS rec_id, dense_rank() OVER (ORDER BY event_type) - 1 AS label, true AS is_core FROM events")
def file_groups(spark: SparkSession, d: str) -> DataFrame:
    return cluster.file_groups(grouped(spark, d)).select("rec_id", big("label").alias("label"), "is_core")


_SPLITS = """x AS (SELECT value AS v, count(*) AS w FROM events GROUP BY value),
c AS (SELECT v, row_number() OVER (ORDER BY v) AS i, sum(w) OVER (ORDER BY v) AS w, sum(w * (v - 50)) OVER (ORDER BY v) AS s1,
  sum(w * (v - 50) * (v - 50)) OVER (ORDER BY v) AS s2 FROM x),
e AS (SELECT max(w) AS w, arg_max(s1, i) AS s1, max(s2) AS s2, max(i) AS n FROM c)"""


@check("ckmeans_k2", f"""WITH {_SPLITS}, cost AS (SELECT v, c.s2 - c.s1 * c.s1 / c.w
  + (e.s2 - c.s2) - (e.s1 - c.s1) * (e.s1 - c.s1) / (e.w - c.w) AS cost FROM c, e WHERE i < n),
cut AS (SELECT arg_min(v, cost) AS v FROM cost)
SELECT event_id AS rec_id, CASE WHEN value > cut.v THEN 1 ELSE 0 END AS label FROM events, cut""")
def ckmeans_k2(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select(F.col("event_id").alias("rec_id"), "value")
    return cluster.ckmeans(rows, "value", 2).select("rec_id", big("label").alias("label"))


@check("ckmeans_k3", f"""WITH {_SPLITS}, cost AS (SELECT a.v AS lo, b.v AS hi, a.s2 - a.s1 * a.s1 / a.w
  + (b.s2 - a.s2) - (b.s1 - a.s1) * (b.s1 - a.s1) / (b.w - a.w)
  + (e.s2 - b.s2) - (e.s1 - b.s1) * (e.s1 - b.s1) / (e.w - b.w) AS cost
  FROM c a JOIN c b ON a.i < b.i, e WHERE b.i < e.n),
cut AS (SELECT lo, hi FROM cost ORDER BY cost LIMIT 1)
SELECT event_id AS rec_id, CASE WHEN value > hi THEN 2 WHEN value > lo THEN 1 ELSE 0 END AS label FROM events, cut""")
def ckmeans_k3(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select(F.col("event_id").alias("rec_id"), "value")
    return cluster.ckmeans(rows, "value", 3).select("rec_id", big("label").alias("label"))


@check("kmeans")
def kmeans(spark: SparkSession, d: str) -> DataFrame:
    return cluster.kmeans(sig(spark, d), 4)


@check("gaussian_mixture")
def gaussian_mixture(spark: SparkSession, d: str) -> DataFrame:
    return cluster.gaussian_mixture(sig(spark, d), 3)


@check("spectral")
def spectral(spark: SparkSession, d: str) -> DataFrame:
    return cluster.spectral(sig(spark, d), 3)


_PARTS = "SELECT vec_id AS rec_id, min(vec_id) OVER (PARTITION BY label % 4) AS first FROM embeddings"


def _moved(spark: SparkSession, d: str, groups: int, values: int = 64) -> DataFrame:
    """The first values of each embedding, moved ten apart by label."""
    x = sig(spark, d)
    moved = F.transform(F.slice("features", 1, values), lambda v, i: v + F.when(F.col("label") % groups == i, 10.0).otherwise(0.0))
    return x.select("rec_id", moved.alias("features"))


def _first_of_each(found: DataFrame) -> DataFrame:
    """Clusters by their smallest member, as their numbers are free."""
    first = found.groupBy("label").agg(F.min("rec_id").alias("first"))
    return found.join(first, "label").select("rec_id", "first")


@check("kmeans_apart", _PARTS)
def kmeans_apart(spark: SparkSession, d: str) -> DataFrame:
    return _first_of_each(cluster.kmeans(_moved(spark, d, 4), 4))


@check("gaussian_mixture_apart", _PARTS)
def gaussian_mixture_apart(spark: SparkSession, d: str) -> DataFrame:
    return _first_of_each(cluster.gaussian_mixture(_moved(spark, d, 4, values=4), 4))


@check("spectral_apart", """SELECT k, vec_id AS rec_id, min(vec_id) OVER (PARTITION BY k, label % k) AS first
FROM embeddings, (SELECT unnest([2, 3, 4, 5]) AS k)""")
def spectral_apart(spark: SparkSession, d: str) -> DataFrame:
    found = [_first_of_each(cluster.spectral(_moved(spark, d, k), k)).select(F.lit(k).alias("k"), "rec_id", "first") for k in (2, 3, 4, 5)]
    return functools.reduce(DataFrame.unionByName, found)


@check("clustering_summary")
def clustering_summary(spark: SparkSession, d: str) -> DataFrame:
    x = sig(spark, d)
    return cluster.clustering_summary(x, cluster.kmeans(x, 4), "kmeans", 4)


# --- classifiers ----------------------------------------------------------------------------


@check("split", """WITH h AS (SELECT event_id, row_number() OVER (ORDER BY md5(event_id || '2017'), event_id) AS i,
  count(*) OVER () AS n FROM events)
SELECT event_id AS rec_id, i <= ceil(0.2 * n) AS is_test FROM h""")
def split(spark: SparkSession, d: str) -> DataFrame:
    return classify.holdout_split(ev(spark, d).select("rec_id")).select("rec_id", "is_test")


@check("min_prob", """WITH p AS (SELECT doc_id, [doc_id * 7 % 10 + 1, doc_id * 3 % 10 + 1, doc_id * 11 % 10 + 1] AS w FROM labels),
q AS (SELECT doc_id, w, list_max(w) / list_sum(w) AS top FROM p)
SELECT doc_id AS rec_id, CASE WHEN top >= 0.6 THEN list_position(w, list_max(w)) - 1 ELSE -1 END AS label,
  top >= 0.6 AS is_core FROM q""")
def min_prob(spark: SparkSession, d: str) -> DataFrame:
    found = classify.choose_label(prob(spark, d), 0.6)
    return found.select("rec_id", big("label").alias("label"), "is_core")


def _labelled(spark: SparkSession, d: str, classes: int) -> DataFrame:
    """The table's ten labels in ``classes`` ranges; the label itself is the last feature."""
    told = F.concat("features", F.array(F.col("label").cast("double")))
    return sig(spark, d).select(
        "rec_id", told.alias("features"), F.floor(F.col("label") * classes / 10).cast("int").alias("label")
    )


def _trained(spark: SparkSession, d: str, classes: int):
    """With the default number of rounds and rule to stop."""
    rows = classify.holdout_split(_labelled(spark, d, classes))
    return classify.train_boosted(rows), rows


@check("boosted_predict", "SELECT vec_id AS rec_id, CAST(label * 3 // 10 AS BIGINT) AS label, true AS is_core FROM embeddings")
def boosted_predict(spark: SparkSession, d: str) -> DataFrame:
    """A label that thresholds tell is learned exactly, and surely."""
    model, rows = _trained(spark, d, 3)
    found = classify.predict(model, rows, 0.6)
    return found.select("rec_id", big("label").alias("label"), "is_core")


@check("training_curves")
def training_curves(spark: SparkSession, d: str) -> DataFrame:
    model, rows = _trained(spark, d, 2)
    return classify.training_curves(model, rows)


@check("training_curves_end", """WITH h AS (SELECT vec_id, label, row_number() OVER (ORDER BY md5(vec_id || '2017'), vec_id) AS i,
  count(*) OVER () AS n FROM embeddings)
SELECT i <= ceil(0.2 * n) AS is_test, avg(CASE WHEN (label >= 5) = (label * 2 // 10 = 1) THEN 0.0 ELSE 1.0 END) AS error
FROM h GROUP BY 1""")
def training_curves_end(spark: SparkSession, d: str) -> DataFrame:
    """Error of both parts of the rows after the last round."""
    model, rows = _trained(spark, d, 2)
    curves = classify.training_curves(model, rows)
    return curves.groupBy("is_test").agg(F.max_by("error", "round").alias("error"))


@check("feature_importance", """WITH f AS (SELECT max(len(embedding)) AS n FROM embeddings)
SELECT i AS feature, CASE WHEN i = n THEN 1.0 ELSE 0.0 END AS importance FROM f, range(65) t(i)""")
def feature_importance(spark: SparkSession, d: str) -> DataFrame:
    """Only the feature that tells the label is of use."""
    found = classify.feature_importance(spark, _trained(spark, d, 2)[0])
    return found.select(big("feature").alias("feature"), r("importance").alias("importance"))


@check("mlp_predict", """WITH h AS (SELECT vec_id, label, row_number() OVER (ORDER BY md5(vec_id || '2017'), vec_id) AS i,
  count(*) OVER () AS n FROM embeddings), v AS (SELECT vec_id AS rec_id, CAST(label * 2 // 10 AS BIGINT) AS label FROM h WHERE i <= ceil(0.2 * n))
SELECT rec_id, label, label AS prediction FROM v""")
def mlp_predict(spark: SparkSession, d: str) -> DataFrame:
    _, scored = classify.train(_labelled(spark, d, 2), "mlp")
    return scored.select("rec_id", big("label").alias("label"), big("prediction").alias("prediction"))


@check("model_reload", "SELECT vec_id AS rec_id, CAST(label * 2 // 10 AS BIGINT) AS label, true AS is_core FROM embeddings")
def model_reload(spark: SparkSession, d: str) -> DataFrame:
    """Predictions of a stored model, read back."""
    model, rows = _trained(spark, d, 2)
    path = classify.save_model(spark, model, scratch(spark))
    found = classify.predict(classify.load_model(spark, path), rows)
    return found.select("rec_id", big("label").alias("label"), "is_core")
