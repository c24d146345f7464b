"""A tree of WAV files read, quarantined, analysed and exported."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from flighttone.functions import tone as tones
from flighttone.operators import order, stats
from flighttone.plans.pipeline import attributes
from flighttone.sources import sinks, wav
from tests.conftest import tone


def riff(x, rate=8000, bits=16, channels=1, code=1):
    x = np.asarray(x, float)
    if code == 3:
        data = x.astype(f"<f{bits // 8}").tobytes()
    elif bits == 8:
        data = (np.round(x * 127) + 128).astype(np.uint8).tobytes()
    elif bits == 24:
        ints = np.round(x * (2**23 - 1)).astype("<i4")
        data = ints.view(np.uint8).reshape(-1, 4)[:, :3].tobytes()
    else:
        data = np.round(x * (2 ** (bits - 1) - 1)).astype(f"<i{bits // 8}").tobytes()
    width = bits // 8 * channels
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(data), b"WAVE", b"fmt ", 16, code,
                       channels, rate, rate * width, width, bits, b"data", len(data)) + data


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("wavs")
    good = riff(tone((500, 0.5)))
    files = {
        "aedes/2022-06-12_13.45.59.123_T25.5C_H60.1_a.wav": good,
        "aedes/2022-Jun-12_13.46.59.5_T25.5C_H60.1_b.wav": riff(tone((500, 0.5)), bits=24),
        "aedes/deep/er/field7.wav": riff(tone((500, 0.5)), bits=8),
        "culex/2022-06-12_13.45.59.123_Tabcd_H60.1_a.wav": riff(tone((500, 0.5)), bits=32),
        "culex/2022-06-12_13.45.59.123_T25.5C_H60.1.wav": riff(tone((500, 0.5), sr=44100), rate=44100),
        "culex/2022-06-12_13.45.59.123_T25.5C_H60.1_a_b.wav": riff(
            np.repeat(tone((500, 0.5)), 2), channels=2
        ),
        "culex/float.wav": riff(tone((500, 0.5)), bits=32, code=3),
        "culex/broken.wav": good[:20],
        "culex/empty.wav": b"",
        "culex/OTHER.WAV": good,
        "culex/notes.txt": b"text",
        "loose.wav": good,
    }
    for name, content in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content)
    return str(root)


@pytest.fixture(scope="module")
def read(spark, tree):
    return wav.read_recordings(spark, tree).cache()


def test_scan(read):
    assert read.count() == 8  # a file without a byte never shows up in a scan
    bad = {r["path"].rsplit("/", 1)[-1] for r in wav.bad_records(read).collect()}
    assert bad == {"broken.wav"}
    assert {(r["group_name"], r["group_id"]) for r in read.collect()} == {("aedes", 0), ("culex", 1)}
    assert {r["group_name"]: r["n"] for r in stats.load_report(read).collect()} == {"aedes": 3, "culex": 5}


def test_names(read):
    rows = {r["filename"]: r for r in read.collect()}
    a = rows["2022-Jun-12_13.46.59.5_T25.5C_H60.1_b.wav"]
    assert str(a["dt"]) == "2022-06-12 13:46:59.500000" and (a["temp"], a["rh"]) == (25.5, 60.1)
    for name in ("field7.wav", "2022-06-12_13.45.59.123_Tabcd_H60.1_a.wav",
                 "2022-06-12_13.45.59.123_T25.5C_H60.1.wav", "2022-06-12_13.45.59.123_T25.5C_H60.1_a_b.wav"):
        r = rows[name]
        assert (str(r["dt"]), r["temp"], r["rh"], r["name_decoded"]) == ("2019-01-01 00:00:00", 25, 0, False)


def test_every_encoding_has_the_same_tone(read):
    rows = tones.autocorrelation(wav.good_records(read)).collect()
    assert len(rows) == 7
    for r in rows:
        assert r["ac_f1"] == pytest.approx(500, abs=0.5), r["filename"]
        assert abs(len(r["waveform"]) - 3200) <= 1
        assert max(r["rawdata"]) == pytest.approx(0.5, abs=0.01)


def test_resampling_keeps_a_tone_and_drops_what_is_above():
    x = wav.resampled(tone((500, 0.5), (15000, 0.5), sr=44100), 44100, 8000)
    assert len(x) == 3200
    np.testing.assert_allclose(x[200:-200], tone((500, 0.5))[200:-200], atol=2e-3)
    up = wav.resampled(tone((500, 0.5), sr=4000), 4000, 8000)
    np.testing.assert_allclose(up[200:-200], tone((500, 0.5))[200:-200], atol=2e-3)


@pytest.mark.parametrize("rate, target", [(44100, 8000), (48000, 8000), (11025, 8000), (4000, 8000), (8001, 8000)])
def test_resampling_by_cycles_is_that_by_samples(monkeypatch, rate, target):
    for n in (1, 7, 441, 5000):
        x = np.random.default_rng(n).normal(size=n)
        found = wav.resampled(x, rate, target)
        with monkeypatch.context() as m:
            m.setattr(wav, "CYCLE_CELLS", 0)
            plain = wav.resampled(x, rate, target)
        assert len(found) == len(plain) == -(-n * target // rate)
        np.testing.assert_allclose(found, plain, atol=1e-9)


def test_load_order_and_root_group(spark, tree, read):
    seq = wav.load_order(read).join(read, "rec_id").orderBy("load_seq").collect()
    assert [r["load_seq"] for r in seq] == list(range(8))
    assert seq[0]["filename"] == "field7.wav"
    assert [r["group_name"] for r in seq] == ["aedes"] * 3 + ["culex"] * 5
    flat = wav.read_recordings(spark, tree + "/aedes/deep/er")
    assert flat.first()["group_name"] == "er"


def test_directories_follow_what_is_below_them(spark):
    paths = ["/w/g/a/x/1.wav", "/w/g/a/x/2.wav", "/w/g/a/3.wav", "/w/g/b/y/z/4.wav", "/w/g/b/y/5.wav", "/w/g/b/6.wav",
             "/w/g/b c/7.wav", "/w/g/\u9999/8.wav", "/w/g/9.wav"]
    rows = spark.createDataFrame([(p, "g") for p in reversed(paths)], "path string, group_name string")
    assert [r.path for r in order.with_load_seq(rows).orderBy("load_seq").collect()] == paths


def test_paths_with_one_id_are_refused(spark):
    rows = spark.createDataFrame([(1, "/a"), (1, "/b"), (2, "/c")], "rec_id long, path string")
    wav.check_ids(rows.filter("path <> '/a'"))
    with pytest.raises(ValueError):
        wav.check_ids(rows)


def test_no_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    assert wav.read_recordings(spark, str(tmp_path)).count() == 0


def test_exports(spark, read, tmp_path):
    full = attributes(wav.good_records(read)).join(wav.load_order(read), "rec_id")
    full = order.elapsed(full.withColumn("label", F.col("group_id"))).cache()
    sinks.write_results(full, str(tmp_path / "csv"))
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "csv")).collect()]
    rows = [line.split(",") for line in lines if not line.startswith("DateTime")]
    assert len(rows) == 7 and lines[0] == ",".join(sinks.CSV_HEADER)
    assert {len(r) for r in rows} == {14 + 3200}
    sinks.write_recordings(full.drop("title"), str(tmp_path / "table"))
    back = spark.read.parquet(str(tmp_path / "table"))
    assert back.filter("group_name = 'aedes'").count() == 3
    sinks.write_by_cluster(full.select("rec_id", "label", "f1"), str(tmp_path / "clusters"))
    assert sorted(p.name for p in (tmp_path / "clusters").glob("cluster=*")) == ["cluster=0", "cluster=1"]
    sinks.write_by_cluster(full.select("rec_id", "label", "f1"), str(tmp_path / "clusters"), compact=True)
    assert spark.read.parquet(str(tmp_path / "clusters")).count() == 7
    from flighttone import Params

    small = Params(cwt_step=500)
    sinks.write_scalograms(full.filter("label = 0"), str(tmp_path / "images"), "morl", small)
    image = spark.read.parquet(str(tmp_path / "images")).first()["image"]
    assert len(image) == 9 and len(image[0]) == 3200
    assert min(map(min, image)) >= 0 and max(map(max, image)) <= 255


def test_stats_of_a_collection(read):
    rows = attributes(wav.good_records(read))
    one = stats.summary(rows).first()
    assert one["n"] == 7 and one["f1_median"] == pytest.approx(500, abs=2) and one["psd_min"] < -50


def test_files_that_arrive_later(spark, tree, read, tmp_path):
    from flighttone.streaming import stream_recordings

    dim = order.group_dim(read)
    stream = attributes(stream_recordings(spark, tree, dim)).select("rec_id", "group_id", "f1", "error")
    query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option(
        "checkpointLocation", str(tmp_path / "state")
    ).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == 8 and got.filter("error is null").count() == 7


@pytest.fixture(scope="module")
def two_species(tmp_path_factory):
    root = tmp_path_factory.mktemp("species")
    rng = np.random.default_rng(8)
    for group, low in (("female", 380), ("male", 600)):
        (root / group).mkdir()
        for i in range(30):
            f = low + rng.uniform(-20, 20)
            x = tone((f, 0.4), (2 * f, 0.2), (3 * f, 0.1), ms=200) + rng.normal(0, 0.005, 1600)
            name = f"2022-06-12_{i % 24:02d}.{i:02d}.00.5_T{20 + i % 9}.5C_H60.1_{i}.wav"
            (root / group / name).write_bytes(riff(x))
    (root / "male" / "bad.wav").write_bytes(b"RIFF")
    return str(root)


def test_from_files_to_a_model(spark, two_species, tmp_path):
    from flighttone.operators import classify, cluster
    from flighttone.operators.features import FeatureSpec
    from flighttone.plans import analysis

    out = str(tmp_path)
    recordings = analysis.build_table(spark, two_species, out)
    assert recordings.count() == 60 and spark.read.parquet(out + "/quarantine").count() == 1
    placed = spark.read.parquet(out + "/order").orderBy("load_seq").collect()
    assert [r["load_seq"] for r in placed] == list(range(60))
    assert placed[0]["td"] is None and placed[0]["elapsed_s"] == 0

    groups = cluster.file_groups(recordings)
    tables = analysis.report(recordings, groups)
    means = {r["label"]: r for r in tables["groups"].collect()}
    assert means[0]["f1_median"] == pytest.approx(380, abs=15) and means[1]["f1_median"] == pytest.approx(600, abs=15)
    assert tables["collection"].first()["n"] == 60 and tables["balance"].first()["ratio"] == 1
    assert tables["activity"].agg(F.sum("n")).first()[0] == 60
    assert tables["f1_vs_time"].count() == 60 and tables["density"].count() == 900

    found, summary = analysis.cluster_table(recordings, FeatureSpec("f1"), cluster.kmeans, 2)
    assert summary.first()["silhouette"] > 0.8
    both = found.join(groups.withColumnRenamed("label", "g").drop("is_core"), "rec_id")
    assert both.groupBy("label", "g").count().count() == 2

    spec = FeatureSpec("MFCC", scaler="StandardScaler")
    model, result = analysis.train_table(recordings, groups, spec, rounds=3, depth=2)
    assert result["accuracy"].first()[0] > 0.9
    again = classify.predict_recordings(model, recordings, 0.6)
    assert again.count() == 60 and again.filter("label >= 0").count() > 50
    assert classify.predict_recordings(model, recordings, refit_scaler=True).count() == 60


def test_group_follows_the_root_as_a_prefix(spark):
    from flighttone.operators.order import with_group

    df = spark.createDataFrame([("/home/mywav/wav/g1/x.wav",), ("/home/mywav/wav/g2/wav/y.wav",)], "path string")
    found = {r.path: r.group_name for r in with_group(df, "/home/mywav/wav").collect()}
    assert sorted(found.values()) == ["g1", "g2"]
    uris = spark.createDataFrame([("file:///home/wav/g1/x.wav",)], "path string")
    assert with_group(uris, "file:/home/wav/").first().group_name == "g1"


def test_export_is_in_load_order(spark, tmp_path):
    """Parts follow each other, each in order with its header, also after rows were dropped and for a shuffled table."""
    n = F.col("load_seq")
    rows = spark.range(200).select(F.col("id").alias("load_seq"), F.col("id").alias("rec_id")).filter(n % 7 != 3)
    rows = rows.filter(~n.between(40, 59)).withColumns(
        {c: F.lit(1.0) for c in ("temp", "rh", "ac_f1", "ac_coeff", "ha_f1", "dur_ms", "s2n", "s2n_freq", "fd_power", "fs")}
    ).withColumns({"dt": F.lit("2022-01-01").cast("timestamp"), "elapsed_s": n, "label": F.lit(0), "ha_count": F.lit(1), "waveform": F.array(n * 1.0)})
    sinks.write_results(rows.repartition(5), str(tmp_path / "csv"), rows=20)
    met = []
    for part in sorted((tmp_path / "csv").glob("part-*")):
        lines = part.read_text().splitlines()
        assert lines[0].split(",") == list(sinks.CSV_HEADER) and len(lines) <= 21
        met += [int(line.split(",")[1]) for line in lines[1:]]
    assert met == [i for i in range(200) if i % 7 != 3 and not 40 <= i <= 59]
    sinks.write_results(rows.limit(0), str(tmp_path / "none"))
    assert spark.read.text(str(tmp_path / "none")).count() == 0
