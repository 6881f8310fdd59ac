from datetime import timezone

import pytest
from pyspark.sql import functions as F

from ledgerlake.plans import guard


def test_marker(tmp_path):
    now = [0.0]
    a, b = (guard.Marker(str(tmp_path / "m"), 10, lambda: now[0]) for _ in range(2))
    assert a.acquire() == "acquired" and b.acquire() == "skipped" and a.acquire() == "acquired"
    now[0] = 11
    assert b.acquire() == "taken_over"
    a.release()
    assert b.read() is not None
    b.release()
    assert b.read() is None


def test_one_takes_over(tmp_path):
    import threading

    for turn in range(20):
        path = str(tmp_path / f"m{turn}")
        guard.Marker(path, 10, lambda: 0.0).acquire()
        markers = [guard.Marker(path, 10, lambda: 50.0) for _ in range(8)]
        together, said = threading.Barrier(8), []

        def work(m, together=together, said=said):
            together.wait()
            said.append(m.acquire())

        threads = [threading.Thread(target=work, args=(m,)) for m in markers]
        for t in threads:
            t.start()
        for t in threads:
            t.join()
        assert sorted(said) == ["skipped"] * 7 + ["taken_over"]
    broken = tmp_path / "broken"
    broken.write_text("{")
    assert guard.Marker(str(broken), 3600).acquire() == "skipped" and guard.Marker(str(broken), -1).acquire() == "taken_over"


def test_lock_deadline_walk():
    with guard.single_cycle(), pytest.raises(RuntimeError), guard.single_cycle():
        pass
    assert guard.deadline("2025-01-01T00:00:00").tzinfo == timezone.utc and guard.deadline("") is None and guard.deadline("2025-01-01T00:00:00Z").hour == 0
    state, done = guard.walk([("a", lambda s: {"x": 1}), ("b", lambda s: {"x": s["x"] + 1}), ("c", lambda s: {})], {}, lambda n: n != "c")
    assert state == {"x": 2, "halted_at": "c"} and done == ["a", "b"]


def test_queue(spark):
    q = guard.queued(spark.createDataFrame([("1", "r"), ("2", "s")], "item_id string, reason string"))
    d = spark.createDataFrame([("1", "no", 0), ("1", "yes", 1)], "item_id string, resolution string, ordinal int")
    after = guard.resolved(q, d)
    assert after.where("item_id = '1'").first()["resolution"] == "yes" and [r["item_id"] for r in guard.pending(after).collect()] == ["2"]
    old = spark.createDataFrame([("1", 1), ("2", 1)], "k string, v int")
    new = spark.createDataFrame([("2", 5)], "k string, v int").withColumn("o", F.lit(0))
    assert {r["k"]: r["v"] for r in guard.refreshed(old, new, "k", "o").collect()} == {"1": 1, "2": 5}
