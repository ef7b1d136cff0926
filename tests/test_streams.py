"""Sessions, repeats, stop strings and memory over streams."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from lexloom.operators.generation import cut_at
from lexloom.streaming import keyed
from lexloom.streaming import sessions as S

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


@pytest.fixture(autouse=True)
def one_partition(spark):
    """State of a few rows needs no more, and each partition has a store and a Python worker of its own."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def fed(spark, tmp_path, batches, schema, query, name, mode="append"):
    """Rows of a stream that gets one file a batch, and the query."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}.parquet")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    q = query(stream).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    for _ in range(240):  # state that expires by the clock keeps a query going after its last file
        if q.awaitTermination(0.5) or q.lastProgress and q.lastProgress["batchId"] >= len(batches):
            break
    q.stop()
    return spark.table(name).collect(), q


def brute_sessions(events, gap):
    out, by_user = [], {}
    for _, user, ts, value in events:
        by_user.setdefault(user, []).append((ts, value))
    for user, found in by_user.items():
        now = []
        for ts, value in [*sorted(found), (None, None)]:
            if now and (ts is None or ts - now[-1][0] > gap):
                out.append((user, now[0][0], now[-1][0], len(now), round(sum(v for _, v in now), 6)))
                now = []
            now.append((ts, value))
    return sorted(out)


def rows_of(df):
    return sorted((r["user_id"], r["first"].astimezone(timezone.utc), r["last"].astimezone(timezone.utc), r["events"], round(r["total"], 6)) for r in df)


EVENTS = "event_id long, user_id long, ts timestamp, value double"


def test_sessions_and_late_rows(spark, tmp_path):
    rng = random.Random(1)
    moment, events = START, []
    for i in range(300):
        moment += timedelta(minutes=rng.choice([0, 1, 5, 10, 29, 30, 31]))
        events.append((i, rng.choice([1, 1, 1, 2, 3]), moment, rng.randrange(100) / 4))
    assert rows_of(S.sessions(spark.createDataFrame(events, EVENTS)).collect()) == brute_sessions(events, timedelta(minutes=30))
    odd = spark.createDataFrame([(1, None, START, 1.0), (2, 1, None, 1.0)], EVENTS)
    assert S.sessions(odd).count() == 0

    batches = [events[i : i + 150] for i in range(0, 300, 150)]
    late = [(1000, 1, START, 1.0)]
    end = [(1001, 9, moment + timedelta(days=1), 0.0)]
    got, q = fed(spark, tmp_path, [*batches, late, end, end], EVENTS, lambda s: S.sessions(s, late="5 minutes"), "sessions")
    assert rows_of(got) == brute_sessions(events, timedelta(minutes=30))
    assert S.late_rows(q) == 1


def test_repeats_within_the_watermark(spark, tmp_path):
    events = [(1, 1, START, 1.0), (2, 1, START + timedelta(minutes=1), 1.0)]
    again = [(1, 1, START + timedelta(minutes=2), 1.0), (3, 1, START + timedelta(minutes=3), 1.0)]
    got, _ = fed(spark, tmp_path, [events, again], EVENTS, lambda s: S.without_repeats(s), "repeats")
    assert sorted(r["event_id"] for r in got) == [1, 2, 3]
    assert S.without_repeats(spark.createDataFrame(events + again, EVENTS)).count() == 3


def test_any_split_of_a_text_stops_alike():
    rng = random.Random(2)
    stops = ("<end>", "<e", "END\n", "aa")
    for _ in range(3000):
        text = "".join(rng.choice(["<", "e", "n", "d", ">", "a", "E", "N", "D", "\n", "x"]) for _ in range(rng.randrange(0, 20)))
        want = text[: min((i for s in stops if (i := text.find(s)) >= 0), default=len(text))]
        tail, shown, stopped, at = "", "", False, 0
        while at < len(text) or not at:
            n = rng.randrange(1, 5)
            out, tail, stopped = keyed.scan(tail, text[at : at + n], stops, at + n >= len(text))
            shown, at = shown + out, at + n
            if stopped:
                break
        assert shown == want


@pytest.fixture
def rocks(spark):
    for k, v in keyed.USES_ROCKSDB.items():
        spark.conf.set(k, v)
    yield spark
    for k in keyed.USES_ROCKSDB:
        spark.conf.unset(k)


def test_stop_strings_over_a_stream(rocks, tmp_path):
    spark, texts = rocks, {1: "one <end> two", 2: "no stop <en", 3: "<end>", 4: "a<e<end>", 5: ""}
    pieces = {i: [t[k : k + 3] for k in range(0, len(t), 3)] or [""] for i, t in texts.items()}
    batches = [[(i, k, p[k], k == len(p) - 1) for i, p in pieces.items() for k in range(b * 2, b * 2 + 2) if k < len(p)] for b in range(3)]
    got, _ = fed(spark, tmp_path, batches, "stream_id long, piece int, text string, last boolean", lambda s: keyed.scan_stream(s, ("<end>",)), "scanned", "append")
    shown = {i: "".join(r["text"] for r in sorted(got, key=lambda r: r["piece"]) if r["stream_id"] == i) for i in texts}
    whole = spark.createDataFrame(list(texts.items()), "i long, t string").select("i", cut_at(F.col("t"), ("<end>",)).alias("t"))
    assert shown == {r["i"]: r["t"] for r in whole.collect()}


def test_memory_is_appended_and_replayed(rocks, tmp_path):
    turns = [(1, 0, "system", "s", True), (1, 1, "user", "q1", True), (1, 2, "assistant", "a1", True), (1, 3, "user", "q2", True), (2, 0, "user", "x", True)]
    more = [(1, 4, "assistant", "bad", False), (2, 1, "assistant", "y", True), (1, 5, "user", "q3", True)]
    last = [(1, 6, "assistant", "a3", True), (1, 7, "user", "q4", True), (1, 8, "user", "q5", True), (3, 0, "assistant", "alone", True)]
    got, _ = fed(rocks, tmp_path, [turns, more, last], "conv_id long, turn int, role string, text string, ok boolean", lambda s: keyed.memory_stream(s, n=4), "remembered", "append")
    at = {}
    for r in got:
        at.setdefault((r["conv_id"]), []).append(r["text"])
    assert at[2] == ["x", "x", "y"] and at[3] == ["alone"]
    assert at[1] == ["s", "q1", "a1", "q2", "s", "q1", "a1", "q3", "a1", "q3", "a3", "q5"]
