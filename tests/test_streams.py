"""Stateful streams against tables, over several micro-batches, with restarts."""

import datetime as dt
import random
import threading

import pytest
from pyspark.sql import functions as F

from sparkloom.operators.streams import ROCKS, _chunks, through_stream
from sparkloom.sources import tables
from sparkloom.streaming import buckets, learning, requests, texts

T0 = dt.datetime(2024, 1, 1)
SHAPE = "request string, time timestamp, place long, kind string, body string"


@pytest.fixture(scope="module")
def sent():
    rnd, rows = random.Random(1), [("n", T0, 1, "event", "before its start")]
    for r in range(30):
        t = T0 + dt.timedelta(seconds=rnd.randrange(600))
        rows.append((f"r{r}", t, 0, "start", None))
        rows += [(f"r{r}", t + dt.timedelta(seconds=rnd.randrange(-3, 200)), p, rnd.choice(["event", "chunk", "chunk", "error", "done", "cancel", "odd", "start"]), f"b{p}") for p in range(1, rnd.randrange(2, 9))]
    return sorted(rows, key=lambda x: x[1])


def brute(rows, deadline=120):
    out = []
    for name in {r[0] for r in rows}:
        own = sorted((t, requests.KINDS.index(k), p, k, b) for r, t, p, k, b in rows if r == name and k in requests.KINDS)
        start = next((i for i, x in enumerate(own) if x[3] == "start"), None)
        if start is None:
            continue
        due, sent, ended = own[start][0] + dt.timedelta(seconds=deadline), [], False
        for t, _, _, kind, body in own[start + 1 :]:
            if t >= due or kind == "cancel":
                ended = kind == "cancel" and t < due
                break
            if kind == "done":
                sent.append((t, "completed", None))
                ended = True
                break
            if kind != "start":
                sent.append((t, kind, body))
        if not ended:
            sent += [(due, "timed_out", None), (due, "completed", None)]
        out += [(name, i + 1, *x) for i, x in enumerate(sent)]
    return sorted(out, key=repr)


def test_requests_as_a_table(spark, sent):
    assert sorted(map(tuple, requests.answered(spark.createDataFrame(sent, SHAPE)).collect()), key=repr) == brute(sent)


def test_requests_over_batches_with_a_restart(spark, sent, tmp_path):
    """Each batch is a query of its own that goes on from the checkpoint of the last."""
    part = lambda rows: spark.createDataFrame(rows, SHAPE)
    cut = [part(sent[k * len(sent) // 4 : (k + 1) * len(sent) // 4]) for k in range(4)] + [part([("tick", T0 + dt.timedelta(days=3), 0, "tick", None)])]
    through_stream(cut[:2], requests.answers, str(tmp_path / "s"))
    before = spark.read.parquet(str(tmp_path / "s/out")).count()
    found = through_stream(cut[2:], requests.answers, str(tmp_path / "s"))
    assert 0 < before < found.count() and sorted(map(tuple, found.collect()), key=repr) == brute(sent)


@pytest.mark.parametrize("text", ["a<!-- chart_spec: {} -->b", "<<!-- chart_type: x", "x<!-- note --><!-- chart_spe", "<!-- chart_spec: a -- > b --->c<!-- chart_type:-->", "<!<!--<!-- chart_spec:<!-- chart_type: -->z<!", ""])
def test_every_cut_of_a_text_shows_the_same(spark, text):
    want = spark.createDataFrame([(text,)], "t string").select(texts.shown(F.col("t"))).first()[0]
    n = len(text)
    cuts = [[text]] + [[text[:i], text[i:]] for i in range(n + 1)] + [[text[:i], text[i:j], text[j:]] for i in range(n + 1) for j in range(i, n + 1)] + [list(text)]
    for chunks in cuts:
        held, inside, out = "", False, ""
        for k, c in enumerate(chunks):
            shown, held, inside = texts.feed(held, inside, c, k == len(chunks) - 1)
            out += shown
            assert len(held) < max(map(len, texts.OPENERS))
        assert out == want, chunks


def test_chunks_that_come_out_of_order(spark, tmp_path):
    whole = {"a": "one <!-- chart_spec: {1} --> two", "b": "<!-- chart_type: pie", "c": "plain"}
    rows = [(s, i, t[i : i + 3], i + 3 >= len(t)) for s, t in whole.items() for i in range(0, len(t), 3)]
    rows = [(s, i // 3, c, e) for s, i, c, e in rows]
    random.Random(3).shuffle(rows)
    frame = lambda x: spark.createDataFrame(x, "stream string, place int, chunk string, last boolean")
    found = through_stream([frame(rows[:7]), frame(rows[7:] + rows[:2] + [("c", 9, "after the end", False)])], texts.shown_chunks, str(tmp_path / "t")).collect()
    joined = {s: "".join(r["text"] for r in sorted((r for r in found if r["stream"] == s), key=lambda r: r["place"])) for s in whole}
    assert joined == {"a": "one  two", "b": "", "c": "plain"} and len(found) == len(rows)


def state_rows(frame, run, folder):
    """Rows of state that a stream of one table holds."""
    frame.write.parquet(f"{folder}/in")
    query = run(frame.sparkSession.readStream.schema(frame.schema).parquet(f"{folder}/in")).writeStream.format("noop").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress)


def test_texts_share_the_rows_of_their_state(spark, tmp_path):
    """The work for each row of state is far more than that for a chunk, so many texts must not mean many rows."""
    session = spark.newSession()
    session.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    chunks = session.range(3000).selectExpr("concat('s', id) AS stream", "explode(array(0, 2)) AS place", "'x<' AS chunk", "false AS last")
    assert 0 < state_rows(chunks, texts.shown_chunks, str(tmp_path)) <= 256


def test_a_bucket_does_not_grow_with_its_stream(spark, tmp_path):
    """a task holds a bucket, and all texts of a table shared 256 of them."""
    assert [buckets.number(n) for n in (0, 256 * buckets.ROWS, 10_000 * buckets.ROWS)] == [256, 256, 10_000]
    session = spark.newSession()
    session.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    chunks = session.range(3000).selectExpr("concat('s', id) AS stream", "explode(array(0, 2)) AS place", "'x<' AS chunk", "false AS last")
    assert 600 < state_rows(chunks, lambda x: texts.shown_chunks(x, 800), str(tmp_path / "t")) <= 800
    rows = session.range(3000).selectExpr("concat('r', id) AS request", "timestamp_seconds(1700000000 + id % 9) AS time", "0L AS place", "'start' AS kind", "'' AS body")
    assert 600 < state_rows(rows, lambda x: requests.answers(x, count=800), str(tmp_path / "r")) <= 800


def test_requests_share_the_rows_of_their_state(spark, tmp_path):
    session = spark.newSession()
    session.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    rows = session.range(3000).selectExpr("concat('r', id) AS request", "timestamp_seconds(1700000000 + id % 9) AS time", "0L AS place", "'start' AS kind", "'' AS body")
    assert 0 < state_rows(rows, requests.answers, str(tmp_path)) <= 256


def test_requests_end_once_and_unknown_kinds_move_the_time(spark, tmp_path):
    """Ends and deadlines that pass in batches of their own; rows of an ended request and of none; a null id and body."""
    at = lambda s, *x: (x[0], T0 + dt.timedelta(seconds=s), *x[1:])
    batches = [[at(0, "a", 0, "start", None), at(1, "a", 1, "chunk", None), at(1, "b", 0, "start", "x"), at(2, None, 0, "start", "x")], [at(40, "z", 0, "odd", None)], [at(41, "b", 1, "done", "x"), at(42, "b", 2, "chunk", "x"), at(42, "c", 0, "chunk", "none")],
               [at(300, "z", 0, "odd", None)], [at(300, "a", 3, "chunk", "late"), at(301, "b", 3, "start", "again")], [at(9000, "z", 0, "odd", None)]]
    counts, parts = [], [spark.createDataFrame(b, SHAPE) for b in batches]
    for part in parts:
        found = through_stream([part], requests.answers, str(tmp_path / "s"))
        counts.append(found.count())
    rows = {r: [(x["seq"], (x["time"] - T0).total_seconds(), x["kind"], x["body"]) for x in sorted(found.collect(), key=lambda x: x["seq"]) if x["request"] == r] for r in ("a", "b", "c", None)}
    assert rows == {"a": [(1, 1.0, "chunk", None), (2, 120.0, "timed_out", None), (3, 120.0, "completed", None)], "b": [(1, 41.0, "completed", None)], "c": [], None: [(1, 122.0, "timed_out", None), (2, 122.0, "completed", None)]}
    assert counts == [0, 1, 1, 6, 6, 6]


def test_chunks_wait_over_batches_and_the_first_of_a_place_counts(spark, tmp_path):
    frame = lambda *x: spark.createDataFrame(x, "stream string, place int, chunk string, last boolean")
    parts = [frame(("a", 2, "!", True), ("b", 0, None, None), (None, 1, "null", True)), frame(("a", 2, "other", False), ("a", 1, "<!-- chart_type: x", False)), frame(("a", 0, "q<", None), ("b", 1, "<!-", True), (None, 0, "-", False)), frame(("a", 1, "late", False))]
    found = through_stream(parts, texts.shown_chunks, str(tmp_path / "t")).collect()
    assert sorted(map(tuple, found), key=repr) == sorted([("a", 0, "q"), ("a", 1, "<"), ("a", 2, ""), ("b", 0, ""), ("b", 1, "<!-"), (None, 0, "-"), (None, 1, "null")], key=repr)


def test_texts_are_cut_by_characters(spark, tmp_path):
    """Of any length, and with line ends and characters beyond 16 bits."""
    odd = ["", "\n\r\n\u2028ab\n\n\ncd", "😀" * 7 + "e\u0301😀", "x" * 14]
    spark.createDataFrame([(4 * i + 3, 0, "user", t) for i, t in enumerate(odd)], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    even, other = (p.collect() for p in _chunks(spark, str(tmp_path)))
    assert all(r["place"] % 2 == 0 for r in even) and all(r["place"] % 2 for r in other)
    want = [(f"{4 * i + 3}-0", k // 7, t[k : k + 7], k + 7 >= len(t)) for i, t in enumerate(odd) for k in range(0, max(1, len(t)), 7)]
    assert sorted(map(tuple, even + other)) == sorted(want)


def test_a_stream_has_no_more_state_stores_than_cores(spark, tmp_path):
    session = spark.newSession()
    session.conf.set("spark.sql.shuffle.partitions", "16")
    through_stream([session.createDataFrame([("a", 0, "b", True)], "stream string, place int, chunk string, last boolean")], texts.shown_chunks, str(tmp_path / "s"))
    assert len([p for p in (tmp_path / "s/checkpoint/state/0").iterdir() if p.name.isdigit()]) == spark.sparkContext.defaultParallelism < 16


def test_a_broken_tick_neither_loses_nor_doubles(spark, tmp_path):
    own = learning.LearningQueue(spark, str(tmp_path / "q"), "id long, text string")
    assert own.findings() is None and own.overdue(T0) is None
    put = lambda a, b: own.put(spark.range(a, b).selectExpr("id", "concat('t', id) AS text").coalesce(1))
    put(0, 20)
    judged = lambda df: df.select("id", (F.col("id") % 3 == 0).alias("passed"))
    assert own.tick(judged) == 1
    put(15, 40)
    calls = []

    def breaks(df):
        calls.append(df.count())
        raise RuntimeError("the worker is gone")

    with pytest.raises(Exception, match="the worker is gone"):
        own.tick(breaks, now=lambda: T0)
    assert calls == [20] and own.findings().count() == 20
    late = own.overdue(dt.datetime.now())
    assert sorted(r["id"] for r in late.collect()) == list(range(20, 40)) and own.overdue(T0).count() == 0
    put(40, 45)
    assert own.tick(judged, files=1) == 2
    found = own.findings().collect()
    assert sorted(r["id"] for r in found) == list(range(45)) and own.overdue(dt.datetime.now()).count() == 0
    assert own.tick(judged) == 0


def test_snapshots_of_several_writers(spark, tmp_path):
    report, other, said = {"a": [1, 2], "b": "x"}, {"a": 3}, []

    def write(content):
        try:
            said.append(tables.write_snapshot(spark, content, str(tmp_path), "one"))
        except ValueError as e:
            said.append(str(e))

    threads = [threading.Thread(target=write, args=(report if k % 2 else other,)) for k in range(6)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(said) == ["one"] * 3 + ["one exists with other content"] * 3
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["one"]
    assert len(list((tmp_path / "one").glob("part-*"))) == 1
    assert tables.write_snapshot(spark, report, str(tmp_path)) == tables.write_snapshot(spark, report, str(tmp_path)) == tables.snapshot_id(report)
