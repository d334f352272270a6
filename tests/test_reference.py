"""Statistics, sources, streaming, solvers; and the queries against their SQL."""

from __future__ import annotations

import json
import math
import os
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tests.oracle import compare
from tidemark.functions import stats
from tidemark.operators import advice, eras, matches
from tidemark.sources import decklists, events
from tidemark.streaming import windows

SMALL = "/root/testdata/sf0.001"
#: A query of each family; all of them run by python -m tests.oracle.
CHECKED = ["p1_found", "p7_found", "p7_archetype_results", "meta_share_other_folded", "matchup_matrix_rect", "adaptive_matrix", "leave_camp_out_prior", "dersimonian_laird", "card_value_lift", "slot_contrast", "player_records", "consensus_fill", "nearest_camp", "jaccard_pairs", "presence_crossings", "fdr_accept", "gap_score", "deck_cost", "decklist_parse", "deck_vs_field"]


@pytest.mark.parametrize("name", CHECKED)
def test_query_matches_sql(spark, name):
    assert compare(spark, SMALL, name).startswith("ok")


def test_entry(spark):
    assert entry.entry(spark).columns == ["event_id", "era_id"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_statistics():
    assert abs(stats.beta_cdf(0.3, 2, 5) - 0.579825) < 1e-6
    assert abs(stats.beta_cdf(0.5, 7.5, 7.5) - 0.5) < 1e-12
    assert abs(stats.beta_ppf(0.975, 0.5, 10.5) - 0.217191) < 1e-4
    lo, hi = stats.interval(62, 100)
    assert lo < 0.62 < hi and stats.interval(0, 0) == (0.0, 1.0)
    assert abs(stats.fisher(8, 2, 1, 5) - 0.034965) < 1e-6 and stats.fisher(0, 0, 3, 4) == 1.0
    assert abs(stats.chi2_sf(3.841458820694124, 1) - 0.05) < 1e-9
    z = NormalDist().inv_cdf(0.975)
    assert abs(stats.Z95 - z) < 1e-12
    x = np.concatenate([np.zeros(10), np.ones(10)])
    cuts = stats.optimal_partition(lambda i, j: np.array([((x[k:j] - x[k:j].mean()) ** 2).sum() for k in i]), 20, 0.1, 2)
    some = np.array([0.3, 1.0, 1.5, 2.0, 7.25, 40.0, 1234.5, 1e6])
    assert np.allclose(stats.lgamma(some), [math.lgamma(v) for v in some], rtol=1e-12, atol=1e-12)
    assert cuts == [10]
    p = stats.bocpd(np.array([10] * 12 + [60]), np.array([100] * 13))
    assert p[-1] > 0.9 and p[8] < 0.3


def test_scores(spark):
    d = spark.createDataFrame([(x,) for x in ("2-1", "1-2", "1-1-1", "", None, "BYE", "2-", "-1", "2-1-foo", "W-L")], "r string")
    got = [tuple(r) for r in d.select(*matches.score(F.col("r"))).collect()]
    assert got[:3] == [(2, 1), (1, 2), (1, 1)] and got[4] == (None, None) and got[8] == (2, 1) and got[9] == (None, None)


def test_statuses(spark):
    decks = [("t", 0, "X", "alice"), ("t", 1, "Y", "bob"), ("t", 2, "X", "carl"), ("t", 3, "Y", "dup"), ("t", 4, "Y", "dup"), ("t", 5, None, "eve")]
    d = spark.createDataFrame([(*x, None, None, "online") for x in decks], "tournament_id string, deck_idx int, archetype string, norm string, variant string, date date, provenance string")
    r = [("alice", "bob", "2-1"), ("alice", "carl", "0-2"), ("alice", "bob", "1-1"), ("alice", "", ""), ("alice", "dup", "2-0"), ("alice", "eve", "2-0"), ("alice", "ghost", "2-0")]
    rs = spark.createDataFrame([("t", i, *x) for i, x in enumerate(r)], "tournament_id string, match_idx int, p1 string, p2 string, result string")
    m = matches.resolve(rs, d)
    assert {x["match_idx"]: x["status"] for x in m.collect()} == {0: "decisive", 1: "mirror", 2: "no_winner", 3: "bye", 4: "ambiguous", 5: "unmatched", 6: "unmatched"}
    assert sorted(tuple(x) for x in matches.tallies(m).collect()) == [("X", "Y", 1, 1), ("Y", "X", 0, 1)]
    assert sorted(tuple(x) for x in matches.marginals(m).collect()) == [("X", 2, 3), ("Y", 0, 1)]


def test_solvers():
    m = advice.Coverage({"a": 0.5, "b": 0.3, "c": 0.2}, {"x": {"a"}, "y": {"b", "c"}, "z": {"a", "c"}, "w": set()}, {"x": 1})
    best, proven = m.exact(3)
    import itertools

    brute = max(m.value(dict(zip("xyz", n))) for n in itertools.product(range(2), range(4), range(4)) if sum(n) <= 3)
    assert proven and abs(m.value(best) - brute) < 1e-9 and m.value(m.greedy(3)) <= brute + 1e-9
    assert m.greedy(0) == {} and advice.Coverage({}, {}).exact(5) == ({}, True)


def test_fdr(spark):
    p = [0.001, 0.008, 0.039, 0.041, 0.042, 0.06, 0.074, 0.205, None]
    d = spark.createDataFrame([(i, x) for i, x in enumerate(p)], "i int, p double")
    assert sorted(r["i"] for r in eras.accept_fdr(d).where("accepted").collect()) == [0, 1]
    assert eras.accept_fdr(d.where("p is null")).where("accepted").count() == 0


def test_lists_round_trip(spark):
    d = spark.createDataFrame([(1, "# mine\n4 Tutor-Owl\n2x Gloamvault Basin\n\nSideboard\n1 Idol"), (2, None), (3, "")], "id int, text string")
    got = sorted(tuple(r) for r in decklists.parse_lists(d).collect())
    assert got == [(1, "main", 2, "Gloamvault Basin"), (1, "main", 4, "Tutor-Owl"), (1, "side", 1, "Idol")]
    text = decklists.format_lists(decklists.parse_lists(d))
    assert text.first()["text"] == "4 Tutor-Owl\n2 Gloamvault Basin\n\nSideboard\n1 Idol"
    assert sorted(tuple(r) for r in decklists.parse_lists(text).collect()) == got


def test_ingest(spark, tmp_path):
    folder = tmp_path / "Tournaments" / "brightgate" / "2024"
    folder.mkdir(parents=True)
    doc = {"Tournament": {"Name": "E", "Date": "2024-01-01", "Uri": "https://x.example/1"}, "Decks": [{"Player": "a", "Mainboard": [{"Count": 4, "CardName": "Idol"}], "Sideboard": []}], "Rounds": [{"RoundName": "1", "Matches": [{"Player1": "a", "Player2": "b", "Result": "2-1"}]}, {"Player1": "a", "Player2": "", "Result": ""}], "Standings": [{"Rank": 1, "Player": "a"}]}
    (folder / "one.json").write_text(json.dumps(doc))
    (folder / "bad.json").write_text("{not json")
    store = str(tmp_path / "store")
    assert events.ingest(spark, str(tmp_path), store) == {"new": 1, "bad": 1}
    assert events.ingest(spark, str(tmp_path), store) == {"unchanged": 1, "bad": 1}
    doc["Decks"].append({"Player": "b", "Mainboard": [{"CardName": "Ferry"}]})
    (folder / "one.json").write_text(json.dumps(doc))
    assert events.ingest(spark, str(tmp_path), store) == {"changed": 1, "bad": 1}
    assert sorted(r["player"] for r in events.read_silver(spark, store, "decks").collect()) == ["a", "b"]
    assert sorted(tuple(r) for r in events.read_silver(spark, store, "rounds").select("match_idx", "player2").collect()) == [(0, "b"), (1, "")]
    assert events.read_silver(spark, store, "tournaments").first()["provenance"] == "online"


def test_stream_equals_batch(spark, tmp_path):
    e = spark.read.parquet(f"{SMALL}/events.parquet").orderBy("ts").coalesce(1)
    e.write.parquet(str(tmp_path / "in"))
    s = windows.tumbling(windows.file_stream(spark, str(tmp_path / "in"), e.schema), "ts", "event_type", "value")
    q = s.writeStream.outputMode("append").format("memory").queryName("tumbled").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    key = lambda df: {(r["start"], r["event_type"]): (r["n"], round(r["value"], 4)) for r in df.collect()}
    batch, got = key(windows.tumbling(e, "ts", "event_type", "value")), key(spark.table("tumbled"))
    assert got and all(batch[k] == v for k, v in got.items())
    closed = {k for k in batch if k[0] < max(k[0] for k in batch).replace(minute=0) and k not in got}
    assert len(closed) <= 10  # only windows younger than the watermark stay open


def test_running_alarm(spark, tmp_path):
    from datetime import date, timedelta

    rows = [("a", date(2024, 1, 1) + timedelta(7 * i), 10 if i < 12 else 60, 100) for i in range(13)]
    d = spark.createDataFrame(rows, "entity string, start date, decks long, field_decks long").coalesce(1)
    d.write.parquet(str(tmp_path / "in"))
    q = windows.running_alarm(windows.file_stream(spark, str(tmp_path / "in"), d.schema)).writeStream.outputMode("append").format("memory").queryName("alarms").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert [r["alarm"] for r in spark.table("alarms").orderBy("start").collect()][-1] and os.path.exists(tmp_path / "c")


def test_exact_board_is_proven_for_all_cards():
    """Dominated cards are left out only if no best board needs them."""
    import itertools
    import random

    rnd = random.Random(4)
    for _ in range(20):
        weight = {e: rnd.random() for e in "abcd"}
        m = advice.Coverage(weight, {f"c{i}": {e for e in "abcd" if rnd.random() < 0.5} for i in range(6)}, {f"c{i}": rnd.choice([1, 2, 4]) for i in range(6)})
        best, proven = m.exact(3)
        boards = (dict(zip(m.covers, n)) for n in itertools.product(*[range(min(3, m.cap(c)) + 1) for c in m.covers]) if sum(n) <= 3)
        assert proven and abs(m.value(best) - max(map(m.value, boards))) < 1e-9
    many = advice.Coverage({f"e{i}": 1 / 40 for i in range(40)}, {f"c{i}": {f"e{j}" for j in range(i % 40 + 1)} for i in range(400)})
    assert many.undominated(8) == ["c119", "c159"] and many.exact(8)[1]


def test_sideboard_model_is_whole(spark):
    """All cards of 5% adoption and all labels, where no card reaches 15%."""
    from tidemark.plans import ref_advice

    sf = "/root/testdata/sf0.1"
    m = ref_advice.coverage_model(spark, sf)
    assert set(m.weight) == {r["archetype"] for r in ref_advice._field(spark, sf).collect()} and sum(map(len, m.covers.values())) > 400
    board = ref_advice.sideboard_exact(spark, sf).collect()
    assert sum(r["copies"] for r in board) == 8 and all(r["proven"] for r in board)


@pytest.mark.parametrize("name", ["tfidf_l2", "camp_centroid", "pmi_adjacency", "subgroup_split", "biggest_movers", "top_finishers", "topcut_share"])
def test_all_parents_match_sql(spark, name):
    assert compare(spark, SMALL, name).startswith("ok")
    assert entry.queries()[name](spark, SMALL).select("archetype").distinct().count() > 1


def _weekly(spark, weekly):
    """Decks of (archetype, variant, decks by week), Mondays from 2024-01-01; week 3 is not observed."""
    from datetime import date, timedelta

    rows, weeks = [], [w for w in range(25) if w != 3]
    for a, v, count in weekly:
        for i, w in enumerate(weeks):
            rows += [("t", len(rows) + j, a, v, date(2024, 1, 1) + timedelta(7 * w)) for j in range(count(i))]
    return spark.createDataFrame(rows, "tournament_id string, deck_idx int, archetype string, variant string, date date"), weeks


def test_bucket_width_by_density(spark):
    """A break at an odd week of a dense archetype is dated to its week."""
    from datetime import date, timedelta

    d, weeks = _weekly(spark, [("dense", None, lambda i: 12 if i < 5 else 60), ("mid", None, lambda i: 6), ("rare", None, lambda i: 1), ("rest", None, lambda i: 100)])
    b = eras.adaptive_buckets(d)
    assert {r["entity"]: r["count"] for r in b.groupBy("entity").count().collect()} == {"dense": 24, "mid": 12, "rare": 6, "rest": 24}
    assert b.groupBy().sum("decks").first()[0] == d.count()
    cut = [r["start"] for r in eras.share_breaks(b).where("entity = 'dense'").collect()]
    assert cut == [date(2024, 1, 1) + timedelta(7 * weeks[5])]


def test_crossings_of_camps(spark):
    """A card that a camp takes up in one week is found for the camp, a wobble of one bucket is not."""
    d, weeks = _weekly(spark, [("x", "new", lambda i: 12), ("x", None, lambda i: 100)])
    d = d.localCheckpoint()
    start = sorted({r["date"] for r in d.select("date").collect()})
    mine = [(r["tournament_id"], r["deck_idx"], r["date"]) for r in d.where("variant = 'new'").collect()]
    c = [(t, i, "idol") for t, i, at in mine if at >= start[11]] + [(t, i, "wobble") for n, (t, i, at) in enumerate(mine) if at == start[6] and n % 3 == 0]
    got = eras.presence_regimes(d, spark.createDataFrame(c, "tournament_id string, deck_idx int, name string")).collect()
    assert [(r["entity"], r["name"], r["start"], r["before"], r["after"]) for r in got] == [("x / new", "idol", start[11], 0.0, 1.0)] and got[0]["p"] < 1e-6


def test_positioning_has_the_default_draws(spark):
    from tidemark.plans import ref_advice

    key = lambda df: {r["a"]: tuple(r) for r in df.collect()}
    assert key(ref_advice.positioning_mc(spark, SMALL)) == key(advice.positioning_draws(ref_advice._cells(spark, SMALL), ref_advice._field(spark, SMALL)))


def test_running_alarm_equals_batch(spark, tmp_path):
    """Also after 130 points, and over several batches of the stream."""
    from datetime import date, timedelta

    k = np.random.default_rng(5).binomial(100, 0.3, 200)
    for i in range(2):
        rows = [("a", date(2020, 1, 6) + timedelta(7 * j), int(k[j]), 100) for j in range(100 * i, 100 * i + 100)]
        d = spark.createDataFrame(rows, "entity string, start date, decks long, field_decks long").coalesce(1)
        d.write.mode("append").parquet(str(tmp_path / "in"))
        q = windows.running_alarm(windows.file_stream(spark, str(tmp_path / "in"), d.schema)).writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).start()
        q.processAllAvailable()
        q.stop()
    got = [r["p_change"] for r in spark.read.parquet(str(tmp_path / "out")).orderBy("start").collect()]
    assert np.allclose(got, stats.bocpd(k, np.full(200, 100)), rtol=0, atol=1e-12)
