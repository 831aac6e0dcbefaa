"""State against batch answers over rows cut into batches in several ways; sketches, spans and drift on small and odd inputs."""

import os
import random
from datetime import datetime, timedelta, timezone

import pytest
from notemill.operators import ensemble, prediction_drift, sessions, sketches
from notemill.streaming import predictions, windows
from notemill.streaming import sessions as store
from pyspark.sql import functions as F

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def _stream(spark, df, folder, parts):
    """df's rows as a stream of files in the given cuts, a file for each batch."""
    rows = df.collect()
    for i, part in enumerate(parts):
        path = f"{folder}/part{i}"
        spark.createDataFrame([rows[j] for j in part], df.schema).coalesce(1).write.parquet(path)
        for name in os.listdir(path):
            if name.endswith(".parquet"):
                os.utime(f"{path}/{name}", (1_700_000_000 + i, 1_700_000_000 + i))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/part*")


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, store.ROCKS)
    yield
    spark.conf.set(name, before)


ACTIONS = "session bigint, at timestamp, seq bigint, action string, chars bigint"


@pytest.mark.parametrize("cuts", [1, 4, 25])
def test_session_store_equals_replay(spark, rocks, tmp_path, cuts):
    rng = random.Random(3)
    now, rows = 0, []
    for seq in range(400):
        now += rng.choice([0, 1, 20, 20, 90, 400])
        rows.append((rng.choice([1, 1, 1, 2, 3, 4]), START + timedelta(seconds=now), seq, "clear" if rng.random() < 0.1 else "turn", rng.choice([None, 5, 70])))
    df = spark.createDataFrame(rows, ACTIONS)
    size = -(-len(rows) // cuts)
    stream = _stream(spark, df, tmp_path, [range(i, min(i + size, len(rows))) for i in range(0, len(rows), size)])
    answers = windows.drained(store.session_store(stream, ttl=300, keep=3, late="1 minute")).select("session", "seq", "started", "turn", "held", "chars", "cleared")
    expected = sessions.replay(df, ttl=300, keep=3)
    assert answers.columns == expected.columns
    by = lambda d: sorted(map(tuple, d.collect()), key=lambda r: r[1])
    assert by(answers) == by(expected)


def test_session_rules(spark):
    at = lambda s: START + timedelta(seconds=s)
    rows = [(1, at(0), 1, "turn", 10), (1, at(100), 2, "turn", 20), (1, at(200), 3, "turn", 30), (1, at(301), 4, "turn", 1), (1, at(302), 5, "clear", 0), (1, at(303), 6, "clear", 0), (1, at(304), 7, "turn", 4), (2, at(304), 8, "clear", 0), (None, at(304), 9, "turn", None)]
    df = spark.createDataFrame(rows, ACTIONS)
    s = int(START.timestamp())
    got = {r["seq"]: tuple(r)[2:] for r in sessions.replay(df, ttl=100, keep=2).collect()}
    assert got == {1: (s, 1, 1, 10, False), 2: (s, 2, 2, 30, False), 3: (s, 3, 2, 50, False), 4: (s + 301, 1, 1, 1, False), 5: (None, 0, 0, 0, True), 6: (None, 0, 0, 0, False), 7: (s + 304, 1, 1, 4, False), 8: (None, 0, 0, 0, False), 9: (s + 304, 1, 1, 0, False)}
    assert {r[0] for r in sessions.still_open(df, s + 404, 100).collect()} == {1, None}
    assert sessions.still_open(df, s + 405, 100).count() == 0 and sessions.still_open(df, s + 303, 100).count() == 0
    assert [r[0] for r in sessions.still_open(df, s + 304, 100, capacity=1).collect()] == [None]
    assert sessions.replay(df.limit(0)).count() == 0


@pytest.mark.parametrize("cuts, shuffled", [(1, False), (6, False), (6, True)])
def test_tracked_predictions_equal_the_batch(spark, tmp_path, cuts, shuffled):
    rng = random.Random(5)
    rows = [("hot" if i % 3 else rng.choice(["a", "b"]), i, None if i % 50 == 7 else rng.random() * (1 + i / 400), rng.choice(["x", "y", None])) for i in range(900)]
    df = spark.createDataFrame(rows, "model string, at bigint, confidence double, label string")
    order = list(range(len(rows)))
    if shuffled:
        rng.shuffle(order)
    size = -(-len(rows) // cuts)
    stream = _stream(spark, df, tmp_path, [order[i : i + size] for i in range(0, len(rows), size)])
    got = predictions.merged(windows.drained(predictions.tracked(stream, 50, 20, parts=3), "update"), 50, 20)
    plain = lambda d: sorted(map(str, d.collect()))
    expected = prediction_drift.ends(df, 50, 20)
    assert plain(got) == plain(expected) and expected.count() == 3 * 70
    assert plain(prediction_drift.report(got)) == plain(prediction_drift.report(expected))


def test_prediction_report(spark):
    same = [("same", i, 0.5, "x") for i in range(30)]
    moved = [("moved", i, 0.1 + i % 5 / 100 if i < 20 else 0.9, "x" if i < 20 else "y") for i in range(30)]
    steady = [("steady", i, i % 5 / 5, None) for i in range(30)]
    single = [("single", 1, None, None)]
    df = spark.createDataFrame(same + moved + steady + single, "model string, at bigint, confidence double, label string")
    got = {r["model"]: r for r in prediction_drift.report(prediction_drift.ends(df, 20, 10)).collect()}
    assert not got["same"]["drifted"] and got["same"]["confidence_psi"] == 0 and got["same"]["label_severity"] == "stable"
    assert got["moved"]["drifted"] and got["moved"]["confidence_severity"] == got["moved"]["label_severity"] == "critical"
    assert got["moved"]["current_mean"] == 0.9 and got["moved"]["n_reference"] == 20 and got["moved"]["n_current"] == 10
    assert not got["steady"]["drifted"] and got["steady"]["label_psi"] == 0
    assert got["single"]["confidence_psi"] == 0 and got["single"]["reference_mean"] is None
    told = prediction_drift.report(prediction_drift.ends(df, 20, 10))
    texts = lambda *p: spark.createDataFrame([(x,) for x in p], "psi double")
    assert [prediction_drift.status(texts(*p), m).first()["overall"] for p, m in (((0.3, 0.1), told), ((0.0,), told), ((0.2,), told.where("not drifted")), ((0.1, 0.0), told.where("not drifted")), ((), told.limit(0)))] == ["drifted", "warning", "warning", "stable", "stable"]


def test_sketches_merge(spark):
    df = spark.range(200_000).select((F.col("id") % 2).alias("g"), F.timestamp_seconds(F.col("id") % 7200).alias("ts"), F.pow(F.pmod(F.col("id") * 7919, F.lit(200_003)) / 1000, F.lit(2)).alias("v"))
    w = sketches.sketched(df, ["g"], "ts", "v", F.col("v") > 100)
    assert w.count() == 48
    told = {r["g"]: r for r in sketches.over(w, ["g"]).collect()}
    for g in (0, 1):
        mine = df.where(F.col("g") == g)
        assert told[g]["n"] == 100_000 and told[g]["failures"] == mine.where("v > 100").count()
        for q in sketches.QUANTILES:
            share = mine.agg(F.avg((F.col("v") <= told[g][f"p{round(q * 100)}"]).cast("int"))).first()[0]
            assert abs(share - q) <= 1.5 * sketches.ERROR
    hours = sketches.over(w, ["g"], 3600).collect()
    assert len(hours) == 4 and sum(r["n"] for r in hours) == 200_000 and all(abs(r["a_minute"] - r["n"] / 60) < 1e-9 for r in hours)
    odd = spark.createDataFrame([("a", START, None, True), ("a", START, None, None), ("b", START, 3.0, False), (None, START + timedelta(minutes=6), 4.0, True)], "g string, ts timestamp, v double, f boolean")
    got = {r["g"]: r for r in sketches.over(sketches.sketched(odd, ["g"], "ts", "v", F.col("f")), ["g"]).collect()}
    assert got["a"]["n"] == 2 and got["a"]["failures"] == 1 and got["a"]["p50"] is None and got["a"]["mean"] is None and got["b"]["p99"] == 3.0 and got[None]["error_share"] == 1
    assert sketches.over(sketches.sketched(odd.limit(0), ["g"], "ts", "v", F.col("f")), ["g"], 60).count() == 0


SPANS = "doc_id bigint, type string, start bigint, end bigint, model string, confidence double"


def test_overlapping_against_brute_force(spark):
    rng = random.Random(9)
    spans = [(rng.choice([1, 2, None]), rng.choice(["A", "B"]), s := rng.randrange(300), s + rng.choice([0, 1, 3, 8]), rng.choice("mno"), rng.choice([None, 0.5, 0.7])) for _ in range(250)]
    groups = []
    for s in [s for s in spans if s[2] < s[3]]:
        near = [g for g in groups if any(t[:2] == s[:2] and t[2] < s[3] and s[2] < t[3] for t in g)]
        groups = [g for g in groups if g not in near] + [sum(near, []) + [s]]
    expected = []
    for g in groups:
        best = min(g, key=lambda s: (-(-1.0 if s[5] is None else s[5]), s[2] - s[3], s[2], s[4]))
        expected.append((*g[0][:2], min(s[2] for s in g), max(s[3] for s in g), len({s[4] for s in g}), len(g), best[2], best[3], best[4], best[5]))
    df = spark.createDataFrame(spans, SPANS)
    for voting, least in (("union", 1), ("majority", 2), ("intersection", 3)):
        got = sorted(map(str, map(tuple, ensemble.overlapping(df, voting).collect())))
        assert got == sorted(str(e) for e in expected if e[4] >= least)
    assert ensemble.overlapping(df.limit(0)).count() == 0


def test_touching_spans_stay_apart(spark):
    df = spark.createDataFrame([(1, "A", 0, 3, "m", 0.5), (1, "A", 3, 6, "n", 0.9), (1, "A", 5, 9, "m", 0.9), (1, None, 0, 9, "m", None), (1, "A", None, 4, "m", 0.1)], SPANS)
    got = {(r["type"], r["start"], r["end"]): (r["n_models"], r["best_start"]) for r in ensemble.overlapping(df).collect()}
    assert got == {("A", 0, 3): (1, 0), ("A", 3, 9): (2, 5), (None, 0, 9): (1, 0)}
