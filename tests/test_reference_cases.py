"""The cases the reference's own tests pin down, on the same literals."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quarry.operators import experiments as X
from quarry.operators import profile as R
from quarry.operators import timeseries as TS
from quarry.streaming import streams as ST


def _ab_frame(spark):
    rows = [("exp_a", "A", v) for v in (1.0, 2.0, 3.0, 4.0)] + [("exp_a", "B", v) for v in (1.5, 2.5, 3.5, 4.5)]
    return spark.createDataFrame(rows, "experiment string, variant string, value double")


def test_t_test_pair(spark):
    r = X.analyze(_ab_frame(spark), "exp_a", "t").first()
    assert r["variant_a_mean"] == 2.5 and r["variant_b_mean"] == 3.0
    assert r["t_statistic"] == pytest.approx(-0.547723, abs=1e-6)
    assert r["cohens_d"] == pytest.approx(0.387298, abs=1e-6)
    assert r["effect_size_interpretation"] == "Small"
    # two-sided, 6 df; value from numerically integrating the t density
    assert r["p_value"] == pytest.approx(0.6036451, abs=1e-6)
    assert r["is_significant"] is False


def test_missing_experiment_is_error(spark):
    with pytest.raises(X.ExperimentNotFound, match="not found"):
        X.analyze(_ab_frame(spark), "missing", "t")


def test_latest_not_latitude(spark):
    df = spark.createDataFrame([(1, 10.0, -70.0), (2, 11.0, -71.0), (3, 12.0, -72.0)],
                               "Latest long, latitude double, lon_x double")
    lat, lon = R.coordinate_columns(df)
    assert "Latest" not in lat and "latitude" in lat and "lon_x" in lon


def test_city_detected_and_digest(spark):
    df = spark.createDataFrame([("Phoenix", 1), ("Chicago", 2)], "City string, Sales long")
    assert "City" in R.location_text_columns(df)
    d = R.data_digest(df).first()
    assert (d["n_rows"], d["n_columns"]) == (2, 2)
    assert d["has_coords"] is False
    assert "City" in d["location_columns"]
    text = " ".join(R.digest_hints(d))
    assert "Geocode" in text or "place" in text


def test_prepare_sorts_and_dedupes_first_by_input_order(spark):
    df = spark.createDataFrame([("2024-01-03", 30, 0), ("2024-01-01", 10, 1), ("2024-01-02", 20, 2),
                                ("2024-01-01", 99, 3)], "d string, v long, row_id long")
    out = TS.prepare(df, "d", "v", ["row_id"]).orderBy("ts").collect()
    assert [r["ts"] for r in out] == [datetime(2024, 1, 1), datetime(2024, 1, 2), datetime(2024, 1, 3)]
    assert out[0]["value"] == 10.0


def test_prepare_first_null_removes_the_date(spark):
    df = spark.createDataFrame([("2024-01-01", None, 0), ("2024-01-01", 5.0, 1), ("2024-01-02", 2.0, 2),
                                (None, 1.0, 3)], "d string, v double, row_id long")
    out = TS.prepare(df, "d", "v", ["row_id"]).collect()
    assert [r["ts"] for r in out] == [datetime(2024, 1, 2)]


def test_stream_buffer_heterogeneous_records(spark, tmp_path):
    src = tmp_path / "in"
    spark.createDataFrame([("s", 1, "a"), ("s", 2, None), ("s", 3, None)], "stream_id string, x long, y string") \
        .write.parquet(str(src))
    stream = ST.file_stream(spark, str(src), "stream_id string, x long, y string")
    snap = ST.run_append(ST.ring_buffer(stream, "stream_id", ["x"], capacity=100), "test_ring")
    buf = ST.latest_snapshot(snap)
    assert buf.count() == 3
    recent = ST.most_recent(buf, 2).orderBy("slot").collect()
    assert [r["x"] for r in recent] == [2, 3]
    assert recent[-1]["y"] is None
    stats = ST.ingest_stats(snap).first()
    assert (stats["records_added"], stats["total_buffered"], stats["buffer_capacity"]) == (3, 3, 100)
    assert stats["usage_percent"] == pytest.approx(3.0)
    _ = F  # noqa
