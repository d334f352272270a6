"""Text keys, as-of lookup, skewed aggregation, components: small exact cases."""

from __future__ import annotations

import random
from datetime import datetime, timezone

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions.text import label_key, name_key, time_text
from tidemark.operators.asof import as_known
from tidemark.operators.components import min_label_components
from tidemark.operators.skew import eager_join_rollup, latest_state, salted_join


def rows(df, *cols):
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=repr)


def test_name_key(spark):
    data = [("Mör’s  Ledge ",), ("MÖR'S ledge",), ("Mör's Ledge",), ("Tutor‑Owl",), ("", ), (None,)]
    got = [r[0] for r in spark.createDataFrame(data, "n string").select(name_key(F.col("n"))).collect()]
    assert got == ["mor's ledge", "mor's ledge", "mor's ledge", "tutor-owl", "", None]
    assert spark.createDataFrame([(" Gilt ",)], "n string").select(label_key(F.col("n"))).first()[0] == "gilt"


def test_time_text(spark):
    data = [("2024-01-02",), ("2024-01-02T03:04:05",), ("2024-01-02 03:04:05",), ("2024-01-02T03:04:05Z",), ("2024-01-02T03:04:05+09:00",), ("soon",), ("",), (None,), ("2024-13-45",), ("2024",)]
    got = [r[0] for r in spark.createDataFrame(data, "t string").select(F.unix_seconds(time_text(F.col("t")))).collect()]
    at = lambda *a: int(datetime(*a, tzinfo=timezone.utc).timestamp())
    assert got == [at(2024, 1, 2), *[at(2024, 1, 2, 3, 4, 5)] * 3, at(2024, 1, 1, 18, 4, 5), None, None, None, None, None]


HIST = "era int, entity string, since timestamp, known timestamp, extra string"
EV = "ev int, entity string, at timestamp, extra string"


def known(spark, events, history, **k):
    return as_known(
        spark.createDataFrame(events, EV), spark.createDataFrame(history, HIST), event_id="ev", event_entity=F.col("entity"), event_at=F.col("at"), history_id="era", history_entity=F.col("entity"), valid_from=F.col("since"), known_at=F.col("known"), **k
    )


def brute(events, history):
    out = set()
    for ev, e, at, _ in events:
        if ev is None or not e or at is None:
            continue
        c = [(s is not None, s or at, k, i) for i, n, s, k, _ in history if n == e and k is not None and k <= at and (s is None or s <= at) and i is not None]
        if c:
            best = max((x[0], x[1] if x[0] else datetime.min, x[2], x[3]) for x in c)
            out.add((ev, best[3]))
    return out


def test_as_known_cases(spark):
    d = lambda m, n: datetime(2024, m, n)
    history = [(1, "a", None, d(1, 5), "x"), (2, "a", d(2, 1), d(2, 10), "x"), (2, "a", d(2, 1), d(2, 10), "x"), (3, "a", d(1, 20), d(3, 1), None), (4, "a", d(2, 1), d(2, 10), "x"), (5, None, d(1, 1), d(1, 1), "x"), (6, "b", d(1, 1), None, "x")]
    events = [(1, "a", d(1, 4), "y"), (2, "a", d(1, 5), "y"), (3, "a", d(2, 9), "y"), (4, "a", d(2, 10), "y"), (5, "a", d(12, 1), "y"), (5, "a", d(12, 1), "y"), (6, "b", d(5, 1), "y"), (7, None, d(5, 1), "y"), (8, "a", None, "y"), (9, "c", d(5, 1), None)]
    want = sorted(brute(events, history))
    assert want == [(2, 1), (3, 1), (4, 4), (5, 4)]
    assert rows(known(spark, events, history)) == want
    assert rows(known(spark, events, [])) == [] and rows(known(spark, [], history)) == []


def test_as_known_random_and_salted(spark):
    rnd = random.Random(4)
    day = lambda: datetime(2022 + rnd.randrange(4), rnd.randrange(1, 13), rnd.randrange(1, 28), rnd.randrange(24))
    history = [(i, rnd.choice("aaaab"), rnd.choice([None, day()]), rnd.choice([day(), day(), None]), "z") for i in range(150)]
    events = [(i, rnd.choice("aaaabc"), day(), "z") for i in range(300)]
    for k in ({}, {"bucket_days": 3, "rows_per_task": 5}):
        assert rows(known(spark, events, history, **k)) == sorted(brute(events, history), key=repr)


def test_eager_rollup_equals_join(spark):
    rnd = random.Random(1)
    left = [(rnd.choice([1, 1, 1, 2, None]), rnd.choice(["p", "q", None]), rnd.choice([1, 2, None])) for _ in range(60)]
    right = [(rnd.choice([1, 2, 3, None]), rnd.choice(["u", "v"]), rnd.choice([5, 7, None])) for _ in range(30)]
    l, r = spark.createDataFrame(left, "k int, g string, x int"), spark.createDataFrame(right, "k int, h string, y int")  # noqa: E741
    got = eager_join_rollup(l, r, ["k"], ["g"], {"sx": F.col("x")}, {"sy": F.col("y")}, ["h"])
    want = l.join(r, "k").groupBy("g", "h").agg(F.count("*").alias("n_rows"), F.sum("x").alias("sx"), F.sum("y").alias("sy"))
    assert rows(got, "g", "h", "n_rows", "sx", "sy") == rows(want, "g", "h", "n_rows", "sx", "sy")
    outer = eager_join_rollup(l, r, ["k"], ["g"], {"sx": F.col("x")}, {"sy": F.col("y")}, how="left")
    want = l.join(r, "k", "left").groupBy("g").agg(F.count("*").alias("n_rows"), F.sum("x").alias("sx"), F.sum("y").alias("sy"))
    assert rows(outer, "g", "n_rows", "sx", "sy") == rows(want, "g", "n_rows", "sx", "sy")
    assert {a: b for a, b in rows(outer, "g", "n_left")} == {g: sum(x[1] == g for x in left) for g in {x[1] for x in left}}
    assert rows(eager_join_rollup(l.where("false"), r, ["k"], ["g"], {"sx": F.col("x")})) == []
    with pytest.raises(ValueError):
        eager_join_rollup(l, r, ["k"], ["g"], {"g": F.col("x")})


def test_salted_join_and_latest(spark):
    l = spark.createDataFrame([(i, 1 if i < 90 else i) for i in range(100)], "id int, k int")  # noqa: E741
    r = spark.createDataFrame([(1, "a"), (1, "b"), (95, "c")], "k int, v string")
    assert rows(salted_join(l, r, ["k"], ["id"], rows_per_task=7), "id", "v") == rows(l.join(r, "k"), "id", "v")
    assert salted_join(l, r, ["k"], ["id"], "left", 7).count() == l.join(r, "k", "left").count()
    d = spark.createDataFrame([(1, datetime(2024, 1, 1), "b"), (1, datetime(2024, 1, 2), "z"), (1, datetime(2024, 1, 2), "a"), (2, None, "q"), (2, None, "q")], "k int, t timestamp, v string")
    assert rows(latest_state(d, ["k"], "t", ["v"])) == [(1, "a"), (2, "q")]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), min_size=1, max_size=15))
def test_components(spark, edges):
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = rows(min_label_components(spark.createDataFrame(edges, "a int, b int")))
    assert got == sorted(((x, find(x)) for x in parent), key=repr)


def test_components_path_and_nulls(spark):
    e = [(i, i + 1) for i in range(40)] + [(None, 3), (100, 100)]
    got = dict(rows(min_label_components(spark.createDataFrame(e, "a int, b int"))))
    assert got == {**dict.fromkeys(range(41), 0), 100: 100}
