"""Streams over several triggers: state lasts, late hours stay open, repeats are dropped."""

from datetime import datetime, timedelta, timezone

from quire.streaming import sessions, tasks

START = datetime(2026, 1, 1)


def log(spark, folder, batches):
    """Each batch of (id, user, type, minutes) becomes one file, in order."""
    for rows in batches:
        data = [(i, u, t, 1.0, START + timedelta(minutes=m)) for i, u, t, m in rows]
        spark.createDataFrame(data, "event_id bigint, user_id bigint, event_type string, value double, ts timestamp_ntz").coalesce(1).write.mode("append").parquet(f"{folder}/events.parquet")
    return tasks.events(spark, str(folder), files_per_trigger=1)


def test_cooldown_keeps_state_between_triggers(spark, tmp_path):
    stream = log(spark, tmp_path, [[(2, 7, "view", 30), (1, 7, "view", 0), (3, 8, "view", 1)], [(4, 7, "view", 59), (5, 7, "view", 60), (6, 8, "click", 2)]])
    out = {r["seq"]: r["allowed"] for r in tasks.drained(tasks.cooldown(stream, 3600)).collect()}
    assert out == {1: True, 2: False, 3: True, 4: False, 5: True, 6: False}


def test_hours_open_until_the_watermark_passes(spark, tmp_path):
    stream = log(spark, tmp_path, [[(1, 1, "view", 5), (2, 1, "error", 10)], [(3, 1, "view", 50), (4, 2, "view", 125)]])
    out = {(r["hour"], r["status"]): r["tasks"] for r in tasks.drained(tasks.hourly_status(stream)).collect()}
    assert out == {(START, "queued"): 2, (START, "failed"): 1}


def test_repeats_are_delivered_once(spark, tmp_path):
    stream = log(spark, tmp_path, [[(1, 1, "view", 5), (2, 1, "view", 6)], [(3, 1, "view", 50), (4, 2, "view", 125)]])
    out = sorted(tuple(r) for r in tasks.drained(tasks.first_deliveries(stream)).collect())
    assert out == [(1, "view"), (2, "view")]


def test_sessions_expire_by_timer(spark, tmp_path):
    stream = log(spark, tmp_path, [[(1, 7, "view", 0), (2, 7, "view", 5), (3, 7, "view", 12), (4, 8, "view", 20)], [(5, 8, "view", 300)], [(6, 9, "view", 600), (7, 8, "view", 361)]])
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", sessions.ROCKS)
    try:
        out = sorted((r["ip"], (r["second"] - int(START.replace(tzinfo=timezone.utc).timestamp())) // 60, r["kind"]) for r in tasks.drained(sessions.sessions(stream, 3600, 600)).collect())
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    # Client 7 never comes back: its timer ends the session. Client 8 is met after its expiry, and again a minute after the next.
    assert out == [(7, 0, "login"), (7, 12, "refresh"), (7, 60, "expired"), (8, 20, "login"), (8, 80, "expired"), (8, 300, "login"), (8, 360, "expired"), (8, 361, "login"), (8, 421, "expired"), (9, 600, "login")]
