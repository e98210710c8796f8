from __future__ import annotations

import json
import os

from conftest import rows
from reelmark.operators import history
from reelmark.sources import landing
from reelmark.streaming import live


def event(user, at, seconds=10):
    date, time = at.split(" ")
    return dict(date=date, time=time, user_id=user, item_name="One", item_id="1", item_type="Movie", duration=str(seconds), user_name=user)


def test_live_sessions_equal_batch(spark, tmp_path):
    folder = tmp_path / "log"
    folder.mkdir()
    days = [
        [event("u", "2025-09-01 10:00:00"), event("u", "2025-09-01 10:15:00"), event("v", "2025-09-01 10:00:00")],
        [event("u", "2025-09-01 10:30:01"), event("v", "2025-09-02 09:00:00")],
        [event("end", "2025-09-30 00:00:00")],
        [event("end", "2025-09-30 00:00:01")],
    ]
    for i, events in enumerate(days):
        landed = folder / f"{i}.json"
        landed.write_text("".join(json.dumps({e["user_name"]: [e]}) + "\n" for e in events))
        os.utime(landed, (1_700_000_000 + i, 1_700_000_000 + i))  # the stream takes files in this order
    stream = live.live_sessions(live.playback_stream(spark, str(folder), files_per_trigger=1), late_minutes=60)
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    live.write_sessions(stream, out, state).start().awaitTermination(120)
    got = spark.read.parquet(out).where("user_id <> 'end'")
    columns = ["user_id", "item_id", "session_start_timestamp", "session_end_timestamp", "total_seconds_watched", "session_count"]
    batch = history.normalize_tz(history.project_raw_event(landing.playback_log(spark, str(folder))))
    want = history.gap_sessions(batch).where("user_id <> 'end'")
    assert rows(got, *columns) == rows(want, *columns)
    assert got.count() == 4
