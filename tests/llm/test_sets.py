"""Ranking, set join, co-occurrence, clusters and aliases against brute force, with nulls, ties, copies and empty input."""

from __future__ import annotations

import os
import random
import time
from collections import Counter, defaultdict
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from tests.oracle import compare
from tidemark.llm import aliases, cooccur, density, pairwise, setjoin
from tidemark.llm.sets import coded_sets, record_sets
from tidemark.session import ensure_checkpoint_dir

SMALL = "/root/testdata/sf0.001"


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


@pytest.mark.parametrize("name", ["p2_pair_records", "p4_found", "p4_links", "p5_found", "p5_pair_scores"])
def test_query_matches_sql(spark, name):
    assert compare(spark, SMALL, name).startswith("ok")


# --- ranking ---
CELL = "id int, ctx string, s string, o string, w int, l int, extra string"


def records(spark, data):
    return pairwise.pair_records(spark.createDataFrame(data, CELL), "id", pairwise.plan_id(F.col("s")), pairwise.plan_id(F.col("o")), "w", "l", ["ctx"])


def test_pair_records(spark):
    data = [
        (1, "x", "A", " b_1", 3, 1, None), (1, "x", "A", " b_1", 3, 1, None), (2, "x", "b-1", "a", 1, 3, "z"),  # both sides of one match-up, one row twice
        (3, "x", "a", "b-1", 3, 1, None), (4, "y", "a", "b-1", 3, 1, None), (5, "x", "a", "a", 2, 2, None), (6, "x", "a", "c", None, 1, None), (7, "x", "a", "c", 0, 0, None), (8, "x", None, "c", 1, 0, None), (9, "x", "c", "a", 2, 0, None),
    ]
    assert rows(records(spark, data), "a", "b", "wins", "games") == [("a", "b-1", 9, 12), ("a", "c", 0, 2)]
    assert records(spark, []).count() == 0
    assert pairwise.rank_items(records(spark, [])).count() == 0


def test_ranking_recovers_strength_and_paths_agree(spark):
    rnd = random.Random(3)
    strength = {f"i{k:02d}": 1.35**k for k in range(12)}
    data = []
    for n, (a, b) in enumerate(combinations(strength, 2)):
        games = rnd.choice([0, 40, 300, 2000])  # very uneven
        w = sum(rnd.random() < strength[a] / (strength[a] + strength[b]) for _ in range(games))
        data.append((n, "x", a, b, w, games - w, None))
    p = records(spark, data)
    dense = pairwise.rank_items(p)
    spread = pairwise.rank_items(p, dense_items=0, tolerance=1e-9, max_rounds=400)
    order = [r["id"] for r in dense.orderBy("place").collect()]
    assert order[:3] == ["i11", "i10", "i09"] and [r["id"] for r in spread.orderBy("place").collect()] == order
    x, y = ({r["id"]: r["strength"] for r in df.collect()} for df in (dense, spread))
    assert all(abs(x[k] - y[k]) < 1e-6 for k in x) and abs(sum(x.values()) - 1) < 1e-9


def test_ranking_ties(spark):
    p = records(spark, [(1, "x", "a", "b", 5, 5, None), (2, "x", "b", "c", 5, 5, None), (3, "x", "a", "c", 5, 5, None)])
    assert rows(pairwise.rank_items(p), "id", "place") == [("a", 1), ("b", 2), ("c", 3)]


# --- set join ---
def deck_sets(spark, data):
    return record_sets(spark.createDataFrame(data, "k int, cards array<string>, key string, items int"), "k", "cards")


def test_set_join_against_brute_force(spark):
    rnd = random.Random(9)
    data, n = [], 0
    for _ in range(220):
        base = rnd.sample(range(400), 24)
        for _ in range(rnd.randrange(1, 4)):
            s = set(base)
            for _ in range(rnd.randrange(0, 5)):
                s.discard(rnd.choice(base))
                s.add(rnd.randrange(400))
            data.append((n, [f"Card {i}" for i in s], "x", 1))
            n += 1
    data += [(n, [], "x", 1), (n + 1, None, "x", 1), (n + 2, ["", None], "x", 1), (None, ["a"], "x", 1), data[0], (n + 3, [*data[0][1], " CARD  7 ", "card 7"], None, None)]
    s = deck_sets(spark, data)
    sets = {r["key"]: set(r["items"]) for r in s.collect()}
    want = {(a, b) for a, b in combinations(sorted(sets), 2) if sets[a] and sets[b] and len(sets[a] & sets[b]) * 10 >= 8 * len(sets[a] | sets[b])}
    got = {(r["key_a"], r["key_b"]) for r in setjoin.similar_pairs(s).collect()}
    assert got <= want and len(got) >= 0.99 * len(want) and len(want) > 50
    links = {r["key"]: (r["copies"], r["links"]) for r in setjoin.similarity_links(s).collect()}
    deg = Counter(x for p in got for x in p)
    assert all(links[k][1] == deg[k] for k in sets) and links[n] == (0, 0) and set(links) == set(sets)
    assert setjoin.similar_pairs(deck_sets(spark, [])).count() == 0


def test_set_join_recall_is_calibrated(spark):
    """At the threshold itself: pairs with similarity of exactly 0.8."""
    data = []
    for i in range(400):
        base = [f"{i}-{j}" for j in range(27)]
        data += [(2 * i, base[:24], None, None), (2 * i + 1, base[:21] + base[24:], None, None)]  # 21 of 27 is under 0.8
        data += [(10_000 + 2 * i, [f"q{x}" for x in base[:18]], None, None), (10_001 + 2 * i, [f"q{x}" for x in base[:16] + base[18:20]], None, None)]  # 16 of 20
    got = {(r["key_a"], r["key_b"]) for r in setjoin.similar_pairs(deck_sets(spark, data)).collect()}
    assert all(a >= 10_000 for a, _ in got) and len(got) >= 0.99 * 400


def test_copies_are_one_class(spark):
    data = [(i, ["a", "b", "c"], None, None) for i in range(50)]
    members, pairs = setjoin.similar_classes(deck_sets(spark, data))
    assert pairs.count() == 0 and rows(members.select("rep").distinct(), "rep") == [(0,)]
    assert setjoin.similar_pairs(deck_sets(spark, data)).count() == 50 * 49 // 2


def test_rounds_and_chunks_find_the_same_pairs(spark, monkeypatch):
    rnd = random.Random(4)
    base = [f"b{i}" for i in range(24)]
    data = [(n, base[: rnd.randrange(20, 25)] + [f"o{rnd.randrange(40)}" for _ in range(rnd.randrange(1, 6))], None, None) for n in range(400)]  # few segments hold nearly all
    s = deck_sets(spark, data)
    whole = rows(setjoin.similar_pairs(s), "key_a", "key_b", "similarity")
    monkeypatch.setattr(setjoin, "SEGMENT_ROWS", 30)
    monkeypatch.setattr(setjoin, "ROUND_ROWS", 3_000)
    assert rows(setjoin.similar_pairs(s), "key_a", "key_b", "similarity") == whole and len(whole) > 1000


def disk_files(spark):
    """Files of shuffles in this process; tables in the checkpoint folder."""
    kept = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()
    folder = ensure_checkpoint_dir(spark).removeprefix("file:")
    return kept, set(os.listdir(folder))


def test_set_join_leaves_no_rounds_on_disk(spark):
    """Of a set join only its two results stay on the disk, neither shuffle files nor the tables between."""
    spark._jvm.System.gc()
    s = deck_sets(spark, [(i, [f"c{(i * k) % 97}" for k in range(1, 25)], None, None) for i in range(2000)])
    before = disk_files(spark)
    kept = setjoin.similar_classes(s)
    for _ in range(50):
        after = disk_files(spark)
        if after[0] <= before[0] + 20:
            break
        time.sleep(0.2)
    assert after[0] <= before[0] + 20 and len(after[1] - before[1]) == 2 and len(kept) == 2


def test_coded_sets_equal_named_ones(spark, monkeypatch):
    data = [(1, [" Éa", "b", "EA", None, ""], None, None), (1, ["z"], None, None), (2, None, None, None), (3, [], None, None), (None, ["q"], None, None), (4, ["B", "é a"], None, None), (5, ["", " "], None, None)]
    df = spark.createDataFrame(data, "k int, cards array<string>, key string, items int")
    want = {r["key"]: r["items"] for r in record_sets(df, "k", "cards").collect()}
    coded, names, hashes = coded_sets(df, "k", "cards")
    assert {r["key"]: [names[i] for i in r["items"]] for r in coded.collect()} == want and len(hashes) == len(names)
    monkeypatch.setattr("tidemark.llm.sets.SPELLINGS", 2)
    same, names, _ = coded_sets(df, "k", "cards")
    assert names is None and {r["key"]: r["items"] for r in same.collect()} == want


# --- items together ---
def brute_pairs(baskets, least, share, lift):
    n = len(baskets)
    one, two = Counter(x for b in baskets for x in b), Counter(p for b in baskets for p in combinations(sorted(b), 2))
    return sorted((a, b, k) for (a, b), k in two.items() if k >= least and k * share >= n and k * n >= lift * one[a] * one[b])


def test_cooccurrence(spark):
    rnd = random.Random(2)
    baskets = [set(rnd.sample([f"i{k}" for k in range(60)], rnd.randrange(1, 12))) | ({"x", "y"} if i % 5 == 0 else set()) for i in range(120)]
    baskets += [{f"i{k}" for k in range(60)} | {"x"}]  # a huge one
    data = [("t", i, x, 9) for i, b in enumerate(baskets) for x in b]
    data += data[:40] + [("t", 3, None, 1), ("t", 4, "", 1), (None, 4, "x", 1), ("t", None, "y", 1)]
    df = spark.createDataFrame(data, "t string, d int, name string, item int")
    for chunk in (128, 8):
        got = cooccur.cooccurring(df, ["t", "d"], "name", 3, 500, 1.2, chunk)
        assert rows(got, "item_a", "item_b", "n_ab") == brute_pairs(baskets, 3, 500, 1.2)
    assert cooccur.cooccurring(df.where("false"), ["t", "d"], "name").count() == 0


# --- clusters ---
def test_core_groups(spark):
    rnd = random.Random(6)
    staples, pool = [f"s{k}" for k in range(12)], [f"f{k}" for k in range(600)]
    data, truth, n = [], {}, 0
    for g, size in enumerate([300, 120, 40, 9]):
        core = [f"c{g}-{k}" for k in range(10)]
        for _ in range(size):
            held = [x for x in core if rnd.random() < 0.95]
            data.append((n, held + [x for x in staples if rnd.random() < 0.3] + rnd.sample(pool, 9), None, None))
            truth[n] = g
            n += 1
    for _ in range(80):  # piles
        data.append((n, rnd.sample(staples, 4) + rnd.sample(pool, 18), None, None))
        n += 1
    data += [(n, [], None, None), (n + 1, None, None, None), (n + 2, ["a", "b"], None, None)]
    groups, cores = density.core_groups(deck_sets(spark, data))
    got = {r["key"]: r["cluster_key"] for r in groups.collect()}
    first = {g: min(k for k in truth if truth[k] == g) for g in set(truth.values())}
    right = sum(got.get(k) == first[g] for k, g in truth.items())
    assert right >= 0.99 * len(truth) and all(k in truth for k in got)
    held = defaultdict(Counter)
    for k, items, *_ in data:
        if k in got:
            held[got[k]].update(x for x in items)
    size = Counter(got.values())
    core = {r["cluster_key"]: set(r["items"]) for r in cores.collect()}
    assert core == {c: {x for x, n in held[c].items() if 3 * n >= 2 * size[c]} for c in size}
    assert all({f"c{g}-{k}" for k in range(10)} <= core[c] for g, c in first.items()) and [len(core[first[g]]) for g in range(3)] == [10, 10, 10]
    d = {r["cluster_key"]: r for r in density.describe(groups, cores).collect()}
    assert d[0]["n_records"] == sum(v == 0 for v in got.values()) and len(d[0]["typical"]) == 3
    g2, _ = density.core_groups(deck_sets(spark, []))
    assert g2.count() == 0


def test_small_groups_among_many_records(spark):
    """Groups of 5 to 30 records are found whole among 3,000 others that share staples, and chance makes no group."""
    rnd = random.Random(1)
    staples, pool, data, truth = [f"s{i}" for i in range(12)], [f"p{i}" for i in range(2000)], [], {}
    for g, size in enumerate([5] * 5 + [8] * 5 + [15] * 10 + [30] * 5):
        for _ in range(size):
            truth[len(data)] = g
            data.append((len(data), [f"c{g}-{k}" for k in range(10) if rnd.random() < 0.95] + [x for x in staples if rnd.random() < 0.29] + rnd.sample(pool, 9), None, None))
    for _ in range(3000):
        data.append((len(data), [x for x in staples if rnd.random() < 0.29] + rnd.sample(pool, 19), None, None))
    got = {r["key"]: r["cluster_key"] for r in density.core_groups(deck_sets(spark, data))[0].collect()}
    first = {g: min(k for k in truth if truth[k] == g) for g in set(truth.values())}
    assert sum(got.get(k) == first[g] for k, g in truth.items()) >= 0.98 * len(truth) and all(k in truth for k in got)


def test_rounds_of_grids_find_the_same_groups(spark, monkeypatch):
    """Rounds change nothing, and none of the tables of a round's cells stay on the disk."""
    rnd = random.Random(8)
    data = [(n, [f"c{n % 2}-{k}" for k in range(10)] + [f"p{rnd.randrange(900)}" for _ in range(9)], None, None) for n in range(40)]
    s = deck_sets(spark, data)
    before = disk_files(spark)[1]
    whole = rows(density.core_groups(s)[0], "key", "cluster_key")
    folder = ensure_checkpoint_dir(spark).removeprefix("file:")
    new = [spark.read.parquet(f"file:{folder}/{x}").columns for x in disk_files(spark)[1] - before]
    assert new and not any("cell" in c and "n" in c for c in new)
    monkeypatch.setattr(density, "ROUND_ROWS", 1_280)
    assert rows(density.core_groups(s)[0], "key", "cluster_key") == whole and len(whole) == 40


# --- aliases ---
def test_lcs_ratio_against_table():
    def lcs(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    rnd = random.Random(5)
    for _ in range(200):
        a, b = ("".join(rnd.choices("abcd", k=rnd.randrange(1, 14))) for _ in range(2))
        assert abs(aliases.lcs_ratio(a, b) - 2 * lcs(a, b) / (len(a) + len(b))) < 1e-12
    assert aliases.lcs_ratio("", "a") == 0


def test_aliases(spark):
    same = [
        ["samuel tibrorokrerd", "sam tibrorokrerd", "tibrorokrerd, samuel", "s. tibrorokrerd", "[tor] samuel t1br0r0kr3rd", "saimuel e. tibrorokrerd", "samueltibrorokrerd7", "tíbrörökrérd_s"],
        ["nicholas tibrorokrerd"],  # a namesake
        ["the dedrobukrix guildhouse", "dedrobukrix gh", "dedrobukrixguildhouse", "team dedrobukrx guildhouse"],
        ["margaret vumakoku", "peg vumakoku", "vumakoku margarte"],
        ["zzyx alone"],
        ["", ],
    ]
    data = [(i, h, None, 1) for i, h in enumerate(x for g in same for x in g)]
    data += [data[0], (90, "quite other", "p1", 2), (91, "nothing alike", "p1", 3), (92, None, None, None), (None, "samuel tibrorokrerd", None, None)]
    e = aliases.link_aliases(spark.createDataFrame(data, "id int, h string, p string, entity int"), "id", "h", "p")
    got = {r["id"]: r["entity"] for r in e.collect()}
    want, n = {}, 0
    for g in same:
        want |= {n + k: n for k in range(len(g))}
        n += len(g)
    assert got == want | {90: 90, 91: 90, 92: 92}
    pairs = rows(aliases.alias_pairs(e), "a", "b")
    assert (90, 91) in pairs and len(pairs) == 28 + 6 + 3 + 1
    assert aliases.link_aliases(spark.createDataFrame([], "id int, h string, p string"), "id", "h", "p").count() == 0


def test_common_suffixes_lose_no_pair(spark):
    """Many names with one ending: blocks are refined, and the pair is still found by its other half."""
    rnd = random.Random(8)
    names = ["".join(rnd.choices("bcdfghjklmnpqrstvwxzaeiou", k=7)) + "akrind" for _ in range(400)]
    typed = [n[:6] + n[7:] for n in names]
    data = [(i, f"robert {n}", None) for i, n in enumerate(names)] + [(1000 + i, f"bob {n}", None) for i, n in enumerate(typed)]
    e = {r["id"]: r["entity"] for r in aliases.link_aliases(spark.createDataFrame(data, "id int, h string, p string"), "id", "h", "p").collect()}
    assert sum(e[i] == e[1000 + i] for i in range(400)) >= 396
    members = defaultdict(list)
    for i, x in e.items():
        members[x].append(i)
    assert max(len(m) for m in members.values()) <= 12


def test_large_blocks_are_compared_whole(spark):
    """Names that leave open who they are meet all names of a large block; blocks of any size are compared."""
    rnd = random.Random(12)
    names = ["".join(rnd.choices("bcdfghjklmnpqrstvwxz", k=7)) + "akrindot" for _ in range(300)]
    typed = [n[0] + n[2:] for n in names]  # another beginning, so only the end is shared
    read = [(n, ["robert"]) for n in names] + [(t, ["robert"] if i % 2 else []) for i, t in enumerate(typed)]
    got = {(r["name_a"], r["name_b"]) for r in aliases._blocked_pairs(spark.createDataFrame(read, "name string, who array<string>")).collect()}
    assert all((min(p), max(p)) in got for p in zip(names, typed))
    got = aliases._blocked_pairs(spark.createDataFrame(read, "name string, who array<string>"))
    assert got.count() == got.distinct().count()


def test_open_handles_join_large_blocks(spark):
    """A handle without a given name goes to the person of its family name, though 100 names have the same end."""
    rnd = random.Random(13)
    names = ["".join(rnd.choices("bcdfghjklmnpqrstvwxz", k=7)) + "akri" for _ in range(100)]
    data = [(i, f"robert {n}", None) for i, n in enumerate(names)] + [(1000 + i, n[:1] + n[2:], None) for i, n in enumerate(names)]
    e = {r["id"]: r["entity"] for r in aliases.link_aliases(spark.createDataFrame(data, "id int, h string, p string"), "id", "h", "p").collect()}
    assert sum(e[i] == e[1000 + i] for i in range(100)) >= 98


def _invented(people, seed):
    """Handles of people whose given names and nicknames stand in no list, with typing errors; and who each is."""
    rnd = random.Random(seed)
    word = lambda n: "".join(rnd.choice("bdfgklmnprstvz") + rnd.choice("aeiou") for _ in range(n))
    stock = {}
    while len(stock) < 24:
        f = word(3) + rnd.choice("nrsl")
        stock[f] = [f[:4], word(2) + rnd.choice("kly"), f[2:]][: rnd.randrange(1, 4)]
    family = [word(4) + rnd.choice(["kord", "rind", "lim", "nok"]) for _ in range(people)]
    rows = {}
    for p in range(people):
        s, g = family[p] if rnd.random() > 0.15 else rnd.choice(family), rnd.choice(list(stock))
        for _ in range(rnd.randrange(2, 8)):
            x, y, k, i = g if rnd.random() < 0.6 else rnd.choice(stock[g]), s, rnd.random(), rnd.randrange(1, 10)
            if rnd.random() < 0.15:
                y = rnd.choice([s[:i] + s[i + 1 :], s[:i] + s[i + 1 : i + 2] + s[i] + s[i + 2 :], s[:i] + rnd.choice("aeiou") + s[i:]])
            h = f"{x} {y}" if k < 0.5 else f"{y}, {x}" if k < 0.65 else f"{g[0]}. {y}" if k < 0.75 else f"{x}{y}" if k < 0.82 else f"{x}_{y}" if k < 0.9 else f"{y} {x}"
            rows.setdefault(h, (g, s))
    return list(rows), list(rows.values())


def _pairs(label):
    by = defaultdict(list)
    for i, x in label.items():
        by[x].append(i)
    return {p for v in by.values() for p in combinations(sorted(v), 2)}


def test_names_outside_any_list_are_learned(spark):
    handles, who = _invented(1500, 5)
    df = spark.createDataFrame(list(enumerate(handles)), "id int, h string").selectExpr("id", "h", "cast(null as string) as p")
    e = {r["id"]: r["entity"] for r in aliases.link_aliases(df, "id", "h", "p", known=aliases.Stock({})).collect()}
    want, got = _pairs(dict(enumerate(who))), _pairs(e)
    assert len(want & got) >= 0.95 * len(want) and len(want & got) >= 0.97 * len(got)


def test_result_does_not_depend_on_the_block_size(spark, monkeypatch):
    handles, _ = _invented(120, 6)
    df = spark.createDataFrame(list(enumerate(handles)), "id int, h string").selectExpr("id", "h", "cast(null as string) as p")
    whole = rows(aliases.link_aliases(df, "id", "h", "p"), "id", "entity")
    monkeypatch.setattr(aliases, "BLOCK", 3)
    assert rows(aliases.link_aliases(df, "id", "h", "p"), "id", "entity") == whole


def test_no_record_table_is_broadcast(spark):
    """The sides of the segment join and of the verification are exploded or whole records, whatever Spark estimates."""
    data = [(i, [f"c{(i * k) % 97}" for k in range(1, 25)], None, None) for i in range(3000)]
    df = setjoin.similar_pairs(deck_sets(spark, data))
    assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()
