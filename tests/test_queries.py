import datetime as dt
import re

import duckdb
import numpy as np
import pytest

from tapeline.plans import frame_queries, stream_queries  # noqa: F401  add their queries
from tapeline.plans.queries import FOUND, ORACLE, frames_of
from tests.conftest import SF, rows


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_agrees_with_sql(spark, duck, name):
    assert rows(FOUND[name](spark, SF).toPandas()) == rows(duck.execute(ORACLE[name]).df())


@pytest.mark.parametrize("name", sorted(set(FOUND) - set(ORACLE)))
def test_runs(spark, name):
    assert FOUND[name](spark, SF).count() > 0


def test_plans(spark):
    plan = lambda n: FOUND[n](spark, SF)._jdf.queryExecution().toString()
    assert "BroadcastNestedLoopJoin" not in plan("frames_in_games") and "CartesianProduct" not in plan("retime")
    assert "BroadcastHashJoin" in plan("templates")
    assert not any(loop in plan(n) for loop in ("NestedLoop", "Cartesian") for n in ("crop", "crop_by_frame"))


def test_frames_are_drawn_without_lookups(spark, tmp_path):
    """Each pixel is written to its place; a line without a part leaves its frame as it is."""
    lines = [(o, p, s, n) for o in (1, 499, 500, 1700) for n in range(1, 40) for p, s in [(o * n * 7 % 997, n * 13 % 101)]] + [(499, None, 3, 1)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int").write.parquet(str(tmp_path / "lineitem.parquet"))
    want = {}
    for o, p, s, n in lines:
        image = want.setdefault(o // 500, np.zeros((40, 60, 3), np.uint8))
        if p is not None:
            image[s % 40, p % 60] = np.maximum(image[s % 40, p % 60], [(o * 7 + n * 31) % 256, (p * 13 + n * 17) % 256, (s * 29 + n * 11) % 256])
    made = frames_of(spark, str(tmp_path))
    got = {(r["video_id"], r["t"]): bytes(r["rgb"]) for r in made.collect()}
    assert got == {(str(f % 3), float(f // 3 + 1)): i.tobytes() for f, i in want.items()} and len(got) == 3
    assert "map" not in re.sub("MapInArrow", "", made._jdf.queryExecution().analyzed().toString())


def test_attributes_at_one_time_are_those_of_the_first_reading(spark, tmp_path):
    """Readings of one second: SQL takes the first of the table, here "n9" before "n10" and "n11"."""
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    events = [(1, at(5), 7, "error"), (2, at(40), 7, "purchase"), (9, at(30), 7, "click"), (10, at(30), 7, "click"), (11, at(30), 7, "view"), (95, at(30), 7, "click"), (96, at(30), 7, "view"), (8, at(20), 7, "view"), (99, at(20), 7, "view")]
    made = spark.createDataFrame(events, "event_id long, ts timestamp_ntz, user_id long, event_type string").orderBy("event_id").coalesce(1)
    made.write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect(config={"threads": 1})
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    got = FOUND["game_attributes"](spark, str(tmp_path)).toPandas()
    assert rows(got) == rows(con.execute(ORACLE["game_attributes"]).df()) and got[["click", "view"]].values.tolist() == [["N9", "N11"]]
