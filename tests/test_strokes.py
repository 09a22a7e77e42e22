"""The stroke analysis against the analytic truth of its model."""

import pytest
from conftest import SMALL
from oracle import same_rows

from motionspark import catalog, staging
from motionspark.plans import analysis
from motionspark.plans.analysis import REASONS


@pytest.fixture(scope="module")
def impact(spark):
    return {r["clip_id"]: r for r in catalog.QUERIES["stroke_impact"](spark, SMALL).collect()}


def test_plain_strokes_meet_the_truth(spark, impact):
    for k, r in impact.items():
        if k % 8 == 0:
            assert abs(r["impact_time"] - 0.9) < 1 / 240
            assert abs(r["ball_speed"] / (1 + k % 13 / 10) - 1) < 0.03
            assert abs(r["start_line_deg"] - ((k % 41 - 20) / 10 - 0.1)) < 0.3


def test_jitter_and_deceleration(impact):
    for k, r in impact.items():
        if k % 8 in (1, 2):
            assert abs(r["impact_time"] - 0.9) < 0.010
            assert abs(r["launch_speed"] / (1 + k % 13 / 10) - 1) < 0.05


def test_each_refusal(impact):
    reasons = {k: r["reason"] for k, r in impact.items()}
    assert all(v == REASONS[2] for k, v in reasons.items() if k % 8 == 4)
    assert all(v == REASONS[1] for k, v in reasons.items() if k % 8 == 5)
    assert all(v == REASONS[5] for k, v in reasons.items() if k % 8 == 6)
    assert all(v == REASONS[0] for k, v in reasons.items() if k % 16 == 3)
    assert all(v is None for k, v in reasons.items() if k % 8 in (0, 1, 2, 7))


def test_putter_and_tempo(spark):
    putter = {r["clip_id"]: r for r in catalog.QUERIES["stroke_putter"](spark, SMALL).collect()}
    tempo = {r["clip_id"]: r for r in catalog.QUERIES["stroke_tempo"](spark, SMALL).collect()}
    for k in (8, 16, 24, 40):
        assert abs(putter[k]["face_deg"] - (k % 41 - 20) / 10) < 0.3
        assert abs(putter[k]["path_deg"] - (7 * k % 61 - 30) / 10) < 0.4
        assert abs(putter[k]["face_rate_deg_s"] + 50) < 4
        assert abs(tempo[k]["tempo_ratio"] - 1.968) < 0.1
        assert abs(tempo[k]["back_len"] - 200) < 8


def test_implausible_strokes_are_kept_blank(spark):
    rows = catalog.QUERIES["session_records"](spark, SMALL).collect()
    bad = [r for r in rows if r["implausible"]]
    assert bad and all(r["face_deg"] is None and r["ball_speed"] is None for r in bad)


@pytest.mark.parametrize("name, tempo", [("session_latest", 0), ("session_spread", 0), ("session_records", 1), ("stroke_warnings", 0), ("stroke_record", 0)])
def test_frames_are_not_written_nor_read_for_what_is_not_shown(spark, monkeypatch, name, tempo):
    """Frames made of keys are made again and not written, and the swing is analysed only where its figures are shown."""
    names, swings, real = [], [], analysis.tempo

    def noted(df, name):
        names.append(name)
        return staging.written(df, name)

    def swing(obs, ball):
        swings.append(1)
        return real(obs, ball)

    monkeypatch.setattr(analysis, "written", noted)
    monkeypatch.setattr(analysis, "tempo", swing)
    catalog.QUERIES[name](spark, SMALL)
    assert "observations" not in names
    assert len(swings) == tempo


@pytest.mark.parametrize("name", ["stroke_impact", "stroke_putter", "stroke_tempo", "stroke_record", "stroke_warnings", "session_records", "session_spread", "session_latest", "phase_bands", "capture_rate"])
def test_keys_over_a_million(spark, tmp_path, name):
    """The scatter's product of such a key does not fit 64 bits; the oracle reads the keys as wider numbers, in the same SQL."""
    keys = spark.read.parquet(f"{SMALL}/customer.parquet")
    keys.withColumn("c_custkey", keys.c_custkey + 5_400_000).write.parquet(f"{tmp_path}/customer.parquet")
    wide = f"SELECT * REPLACE (c_custkey::HUGEINT AS c_custkey) FROM '{tmp_path}/customer.parquet/*.parquet'"
    same_rows(catalog.QUERIES[name](spark, str(tmp_path)), f"WITH customer AS ({wide}) SELECT * FROM ({catalog.ORACLE_SQL[name]})", str(tmp_path))
