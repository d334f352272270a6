"""Swaps, hedges and analogues on small exact cases."""

from __future__ import annotations

from tidemark.operators import advice, tuning


def test_swaps(spark):
    parts = spark.createDataFrame([("A", "core", 4, 0.9, True), ("A", "weak", 2, 0.1, False), ("A", "liked", 1, 0.6, False), ("B", "only", 1, 0.0, False)], "archetype string, name string, copies int, inclusion double, locked boolean")
    pool = spark.createDataFrame([("A", n) for n in ("core", "weak", "liked", "good")] + [("B", "only")], "archetype string, name string")
    values = spark.createDataFrame([("core", 0.5), ("good", 0.2), ("liked", 0.16), ("weak", 0.0)], "name string, value double")
    got = [(r["archetype"], r["round"], r["cut"], r["added"], round(r["gain"], 9)) for r in tuning.tune(parts, pool, values).orderBy("round").collect()]
    # a locked card is never added, what many decks have resists, and the list runs out of weak cards
    assert got == [("A", 1, "weak", "good", 0.2), ("A", 2, "weak", "good", 0.2)]
    assert tuning.tune(parts.where("false"), pool.where("false"), values).count() == 0


def test_hedge_and_considering():
    m = advice.Coverage({"x": 0.6, "y": 0.3, "z": 0.1}, {"a": {"x"}, "b": {"y"}, "c": {"z"}, "d": {"y", "z"}}, {"a": 2})
    core = {"a": 2}
    assert list(m.hedge(core, 4)) == ["d", "b"] and m.hedge(core, 2) == {} and advice.Coverage({}, {}).hedge({}, 3) == {}
    assert [c for c, _ in m.considering(core)] == ["d", "b", "c"] and len(m.considering(core, 1)) == 1
    assert abs(m.share_covered({"a": 1, "d": 1}) - 1.0) < 1e-12


def test_analogues_and_forecast(spark):
    s = "name string, bucket string, colors array<string>, roles array<string>, keywords array<string>, cmc double"
    pool = spark.createDataFrame([("same", "creature", ["R"], ["threat"], ["haste"], 1.0), ("far", "creature", ["U"], [], [], 5.0), ("other", "instant", ["R"], ["threat"], ["haste"], 1.0), ("new", "creature", ["R"], ["threat"], ["haste"], 1.0)], s)
    t = pool.where("name = 'new'")
    got = {r["name"]: r["similarity"] for r in tuning.analogues(t, pool).collect()}
    assert set(got) == {"same", "far"} and got["same"] == 1.0 and abs(got["far"] - 0.25 / 5) < 1e-12
    assert tuning.analogues(t, pool, 1).count() == 1
    lifts = spark.createDataFrame([("same", 0.1, 40), ("far", -0.3, 10)], "name string, lift double, n long")
    own = spark.createDataFrame([("new", 0.7), ("odd", 0.4)], "target string, score double")
    f = {r["target"]: (r["borrowed"], r["forecast"], r["analogues"]) for r in tuning.forecast(tuning.analogues(t, pool), lifts, own).collect()}
    assert f["odd"] == (None, 0.4, 0) and f["new"][0] == 0.1 and abs(f["new"][1] - (0.5 + 0.65 * 0.1 + 0.35 * 0.2)) < 1e-12
