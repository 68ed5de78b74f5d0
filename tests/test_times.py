"""Times mean the same in every session zone."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from colloquy.functions import scalars as S
from colloquy.operators import memory as M
from colloquy.operators import runs as R
from colloquy.sources.collectors import cursor_invocations

ZONES = ("UTC", "America/New_York", "Asia/Kolkata")


@pytest.fixture(params=ZONES)
def zoned(spark, request):
    spark.conf.set("spark.sql.session.timeZone", request.param)
    yield spark
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_texts_of_instants(zoned):
    # The second lies in an hour that New York's clocks skip, the third and fourth in one that they show twice.
    moments = {"1700000000000": "2023-11-14T22:13:20Z", "2024-03-10T02:30:00Z": "2024-03-10T02:30:00Z", "2024-11-03T05:30:00Z": "2024-11-03T05:30:00Z", "2024-11-03T06:30:00Z": "2024-11-03T06:30:00Z"}
    moments |= {"2024-01-01T10:00:00+05:30": "2024-01-01T04:30:00Z", "2024-01-01T10:00:00": "2024-01-01T10:00:00Z", "2024-01-01 10:00:00.5": "2024-01-01T10:00:00Z", "2024-03-10": "2024-03-10T00:00:00Z", "20240310T023000Z": "2024-03-10T02:30:00Z", "-1": "-1", "soon": "soon"}
    rows = zoned.createDataFrame([(k,) for k in moments], "t string").select("t", S.epoch_text(F.col("t")).alias("at")).collect()
    assert {r.t: r["at"] for r in rows} == moments


def test_instants(zoned):
    texts = {"2024-01-01T00:00:00": 1704067200, "2024-01-01T00:00:00Z": 1704067200, "20240101T000000Z": 1704067200, "20240101T000000": 1704067200, "2024-01-01": 1704067200, "2024-01-01T02:00:00+02:00": 1704067200, "": None, "x": None}
    rows = zoned.createDataFrame([(k,) for k in texts], "t string").select("t", F.unix_seconds(S.lenient_instant(F.col("t"))).alias("s"), F.unix_seconds(S.instant(F.col("t"))).alias("z")).collect()
    assert {r.t: r.s for r in rows} == texts
    assert {r.t for r in rows if r.z is not None} - {"20240101T000000Z"} == {"2024-01-01T00:00:00Z", "2024-01-01T02:00:00+02:00"}


def test_watermark_and_age(zoned):
    rows = zoned.createDataFrame([("2024-01-01T00:00:00Z",), ("2024-01-01T01:00:00Z",)], "collected_at string")
    assert M.after(rows, "2024-01-01T00:30:00").count() == M.after(rows, "2024-01-01T00:30:00Z").count() == 1
    runs = zoned.createDataFrame([("20240101T000000Z", None, None), ("20240103T000000Z", None, "2024-01-03T00:00:00")], "run_id string, started_at string, completed_at string")
    found = {r.run_id: r.pruned for r in R.prune_plan(runs, older_than_days=1, now="2024-01-02T00:00:01").collect()}
    assert found == {"20240101T000000Z": True, "20240103T000000Z": False}


def test_log_folders(zoned, tmp_path):
    folder = tmp_path / "logs" / "20240310T023000"
    folder.mkdir(parents=True)
    (folder / "cli.log").write_text(json.dumps({"argv": ["x"]}))
    (row,) = cursor_invocations(zoned, str(tmp_path)).collect()
    assert (row.session, row.invoked) == ("20240310T023000", 1710037800)
