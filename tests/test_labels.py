"""Labels by rules, colours, splits; the catalogue; ingest details: small exact cases."""

from __future__ import annotations

import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from tidemark.operators import labels as L
from tidemark.sources import catalog, events

RULES = [
    {"name": "Delver", "color": True, "conditions": [{"type": "InMainboard", "cards": ["Delver of Secrets"]}, {"type": "DoesNotContain", "cards": ["Show and Tell"]}], "variants": [{"name": "Tempo", "color": True, "conditions": [{"type": "OneOrMoreInMainboard", "cards": ["Daze", "Wasteland"]}]}]},
    {"name": "Show and Tell", "color": True, "conditions": [{"type": "InMainboard", "cards": ["Show and Tell"]}]},
    {"name": "Islands", "color": False, "conditions": [{"type": "InSideboard", "cards": ["Island"]}]},
]


def decks(spark, data):
    return spark.createDataFrame(data, "tournament_id string, deck_idx int, main array<string>, side array<string>, colors string")


def test_classifier(spark):
    data = [
        ("t", 0, ["Delver of Secrets", "Daze", "Brainstorm"], [], "UB"), ("t", 1, ["Delver of Secrets", "Brainstorm"], [], "UR"), ("t", 2, ["Delver of Secrets", "Show and Tell"], [], "UR"),
        ("t", 3, ["Delver of Secrets"], ["Island"], ""), ("t", 4, ["Rare"], [], None), ("t", 5, [], [], "W"),
    ]
    got = {r["deck_idx"]: (r["label"], r["kind"]) for r in L.classify(decks(spark, data), RULES, F.col("colors")).collect()}
    assert got == {0: ("Dimir Tempo", "variant"), 1: ("Izzet Delver", "archetype"), 2: ("Izzet Show and Tell", "archetype"), 3: ("Conflict(Delver,Islands)", "conflict"), 4: (None, "unknown"), 5: (None, "unknown")}
    assert {r["kind"] for r in L.classify(decks(spark, data), []).collect()} == {"unknown"}
    with pytest.raises(ValueError):
        L.check_rules([{"name": "x", "conditions": [{"type": "Sometimes", "cards": []}]}])
    assert L.load_rules('[{"name": "x", "conditions": [],},]') == [{"name": "x", "conditions": []}]


def test_all_condition_types(spark):
    d = decks(spark, [("t", 0, ["a", "b"], ["c", "a"], None)])
    want = {
        ("InMainboard", ("a", "z")): True, ("InMainboard", ("z", "a")): False, ("InSideboard", ("c",)): True, ("InMainOrSideboard", ("b",)): True, ("DoesNotContain", ("c",)): False, ("DoesNotContainMainboard", ("c",)): True, ("DoesNotContainSideboard", ("b",)): True,
        ("OneOrMoreInMainboard", ("z", "b")): True, ("OneOrMoreInSideboard", ("b",)): False, ("OneOrMoreInMainOrSideboard", ("z", "c")): True, ("TwoOrMoreInMainboard", ("a", "c")): False, ("TwoOrMoreInSideboard", ("a", "c")): True, ("TwoOrMoreInMainOrSideboard", ("a",)): True, ("TwoOrMoreInMainboard", ()): True,
    }
    for (kind, cards), ok in want.items():
        c = F.array(*[F.lit(x) for x in cards]).cast("array<string>")
        assert d.select(L.condition(F.lit(kind), c, F.col("main"), F.col("side"))).first()[0] is ok, (kind, cards)


CARD = "tournament_id string, deck_idx int, board string, name string, copies int"


def test_piles(spark):
    data = [("t", 0, "main", "Bolt", 4), ("t", 0, "main", "Guide", 4), ("t", 0, "side", "Bolt", 1), ("t", 1, "main", "Rare", 1), ("t", 2, "main", "Bolt", 1), *[("t", 2, "main", f"x{i}", 1) for i in range(9)]]
    c = spark.createDataFrame(data, CARD)
    piles = [("Large", ["Bolt", "Guide", "Swift", "More"]), ("Aggro", ["Bolt", "Guide", "Swift"])]
    got = {r["deck_idx"]: r["pile"] for r in L.fallback(c, c, piles).collect()}
    assert got == {0: "Aggro"}  # equal weight: the smaller pile; deck 2 has exactly a tenth, which is not enough
    out = {r["deck_idx"]: (r["label"], r["kind"]) for r in L.label_decks(c, RULES, piles).collect()}
    assert out == {0: ("Aggro", "fallback"), 1: ("Unknown", "unknown"), 2: ("Unknown", "unknown")}
    assert L.label_decks(c.where("false"), RULES, piles).count() == 0


def test_colours_and_splits(spark):
    names = spark.createDataFrame([("Isle", True, [], ["U", "R"]), ("Bolt", False, ["R"], []), ("Ponder", False, ["U"], []), ("Elf", False, ["G"], [])], "name string, is_land boolean, colors array<string>, produced array<string>")
    c = spark.createDataFrame([("t", 0, "main", "Isle", 4), ("t", 0, "main", "Bolt", 4), ("t", 0, "main", "Ponder", 2), ("t", 0, "side", "Elf", 1), ("t", 1, "main", "Bolt", 4), ("t", 1, "main", "What", 4)], CARD)
    assert {r["deck_idx"]: r["colors"] for r in L.deck_colors(c, names).collect()} == {0: "UR", 1: ""}
    counts = L.color_counts(c, names)
    assert sorted((r["deck_idx"], r["color"], r["copies"]) for r in counts.collect()) == [(0, "R", 4), (0, "U", 2), (1, "R", 4)]
    labels = spark.createDataFrame([("t", 0, "P"), ("t", 1, "P"), ("t", 2, "Q")], "tournament_id string, deck_idx int, label string")
    split = [{"parent": "P", "min_copies": 2, "buckets": [{"name": "P blue", "requires_any": ["U"]}, {"name": "P red", "requires_any": ["R"], "forbids_all": ["U"]}]}]
    assert {r["deck_idx"]: r["label"] for r in L.color_split(labels, counts, split).collect()} == {0: "P blue", 1: "P red", 2: "Q"}
    twice = [{"parent": "P", "min_copies": 2, "buckets": [{"name": "x", "requires_any": ["U"]}, {"name": "y", "requires_any": ["R"]}]}]
    with pytest.raises(Exception, match="several buckets"):
        L.color_split(labels, counts, twice).collect()


def test_variants_and_applied_splits(spark):
    d = decks(spark, [("t", 0, ["a"], [], None), ("t", 1, ["b"], [], None), ("t", 2, ["a"], [], None)]).withColumn("label", F.when(F.col("deck_idx") < 2, "P").otherwise("Q"))
    rules = [{"parent": "P", "name": "with a", "conditions": [{"type": "InMainboard", "cards": ["a"]}]}]
    assert {r["deck_idx"]: r["variant"] for r in L.variants(d, rules, {"P": "plain"}).collect()} == {0: "with a", 1: "plain", 2: None}
    with pytest.raises(Exception, match="several variants"):
        L.variants(d, [*rules, {**rules[0], "name": "again"}]).collect()
    s = "tournament_id string, deck_idx int, archetype string, variant string"
    own = spark.createDataFrame([("t", 0, "P", None), ("t", 1, "Q", "kept"), ("t", 2, "R", None), ("t", 3, "R", None)], s)
    m = spark.createDataFrame([("t", 0, "P", "c1"), ("t", 1, "P", "c2")], "tournament_id string, deck_idx int, parent string, camp string")
    sig = spark.createDataFrame([("R", "r1", "a"), ("R", "r2", None)], "parent string, camp string, name string")
    c = spark.createDataFrame([("t", 2, "main", "a", 1), ("t", 3, "main", "z", 1)], CARD)
    got = {r["deck_idx"]: r["variant"] for r in L.apply_split(own, m, sig, c).collect()}
    assert got == {0: "c1", 1: "kept", 2: "r1", 3: "r2"}
    st = spark.createDataFrame([("P", "candidate"), ("P", "candidate"), ("Q", "promoted"), (None, "candidate")], "parent string, status string")
    assert [r[0] for r in L.staged_parents(st).collect()] == ["P"]


def test_catalogue(spark, tmp_path):
    docs = [
        {"name": "Isle", "type_line": "Basic Land", "layout": "normal", "colors": [], "produced_mana": ["U"]},
        {"name": "Night // Day", "type_line": "Creature // Land", "layout": "transform", "card_faces": [{"name": "Night", "type_line": "Creature", "colors": ["B"], "power": "2"}, {"name": "Day", "type_line": "Land", "colors": []}]},
        {"name": "Fire // Ice", "type_line": "Instant // Instant", "layout": "split", "colors": ["R", "U"], "card_faces": [{"name": "Fire", "colors": None}, {"name": "Ice", "colors": None}]},
        {"name": "Fire", "type_line": "Sorcery", "layout": "normal", "colors": ["R"]},
        {"name": "Goblin", "layout": "token"},
        {"name": "Isle", "type_line": "Basic Land", "layout": "normal", "colors": [], "produced_mana": ["U"]},
    ]
    (tmp_path / "cards.json").write_text(json.dumps(docs))
    c = catalog.load_cards(catalog.read_cards(spark, str(tmp_path / "cards.json")))
    got = {r["name"]: (r["colors"], r["is_land"], r["alias_of"]) for r in c.collect()}
    assert got == {
        "Isle": ([], True, None), "Night // Day": (["B"], False, None), "Night": (["B"], False, "Night // Day"), "Day": ([], True, "Night // Day"),
        "Fire // Ice": (["R", "U"], False, None), "Fire": (["R"], False, None), "Ice": (["R", "U"], False, "Fire // Ice"),
    }
    names = spark.createDataFrame([("Day",), ("Nothing",)], "name string")
    assert {r["name"]: r["alias_of"] for r in catalog.lookup(names, c).collect()} == {"Day": "Night // Day", "Nothing": None}
    d = catalog.load_diff(c.where("name <> 'Isle'"), c)
    assert [r["name"] for r in d.collect()] == ["Isle"]
    catalog.write_diff(d, "2024-01-01", str(tmp_path / "diff"))
    assert spark.read.json(str(tmp_path / "diff")).first()["added"] == ["Isle"]
    sets = spark.createDataFrame([("a", "A", date(2024, 1, 1)), ("b", "B", date(2024, 1, 20)), ("c", "C", date(2024, 6, 1))], "code string, name string, released date")
    assert {r["code"]: r["status"] for r in catalog.releases(sets, date(2024, 1, 10)).collect()} == {"a": "recent", "b": "upcoming"}


def test_announcements(spark):
    text = catalog.add_announcement("[]", "2024-05-01", "Idol", "too strong")
    assert catalog.add_announcement(text, "2024-05-01", " idol ") == text
    e = catalog.load_announcements(spark, catalog.add_announcement(text, "2023-05-01", "Ferry"))
    assert [r["card"] for r in e.orderBy("date").collect()] == ["Ferry", "Idol"]
    assert [r["card"] for r in catalog.announced_until(e, date(2024, 1, 1)).collect()] == ["Ferry"]
    with pytest.raises(ValueError):
        catalog.load_announcements(spark, '[{"date": "soon", "card": "x"}]')


def test_failed_run_leaves_nothing_that_counts(spark, tmp_path):
    folder = tmp_path / "Tournaments" / "paper"
    folder.mkdir(parents=True)
    doc = {"Tournament": {"Name": "E", "Date": "2024-01-01", "Uri": "u1", "Formats": ["Modern", "Legacy"]}, "Decks": [{"Player": "a", "Mainboard": [{"CardName": "Idol"}]}]}
    (folder / "one.json").write_text(json.dumps(doc))
    store = str(tmp_path / "store")
    tables = events.silver(events.read_events(spark, str(tmp_path / "Tournaments")))
    tables["decks"].withColumn("run", F.lit("broken off")).write.mode("append").parquet(f"{store}/decks")  # a run that never reached the ledger
    assert events.ingest(spark, str(tmp_path / "Tournaments"), store) == {"new": 1}
    assert events.read_silver(spark, store, "decks").count() == 1
    assert events.read_silver(spark, store, "tournaments").first()["format"] == "Legacy"
    assert events.same_rows(events.read_silver(spark, store, "decks"), tables["decks"])
    assert not events.same_rows(events.read_silver(spark, store, "decks").where("false"), tables["decks"])


def test_condition_counts_equal_conditions_per_deck(spark):
    data = [
        ("t", 0, "main", "a", 4), ("t", 0, "side", "a", 1), ("t", 0, "side", "b", 1), ("t", 1, "main", "b", 1), ("t", 1, "main", "c", 1), ("t", 2, "other", "a", 1), ("t", 3, "side", "c", 2), ("t", 3, "main", "z", 2), (None, None, "main", "a", 1), ("u", 0, "main", "z", 1),
    ]
    c = spark.createDataFrame(data, CARD)
    lists = [("x", ["a", "b", "c"]), ("y", ["c"]), ("none", []), ("far", ["q"])]
    rows = spark.createDataFrame([(n, k, x) for n, x in lists for k in L.CONDITIONS], "label string, type string, cards array<string>")
    met = L.deck_lists(c).crossJoin(rows).where(L.condition(F.col("type"), F.col("cards"), F.col("main"), F.col("side")))
    want = {(r["label"], r["type"]): r["count"] for r in met.groupBy("label", "type").count().collect()}
    got = {(r["label"], r["type"]): r["decks"] for r in L.condition_counts(c, lists).collect()}
    assert got == want and got["none", "InMainboard"] == 6 and got["far", "DoesNotContain"] == 6 and ("far", "InMainboard") not in got
    assert L.condition_counts(c.where("false"), lists).count() == 0


def test_label_conditions_try_no_rule_on_every_deck(spark):
    from tidemark.plans import ref_labels

    q = ref_labels.label_conditions(spark, "/root/testdata/sf0.001")
    assert "lambda" not in q._jdf.queryExecution().analyzed().toString()
