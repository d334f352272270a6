"""Packing, leakage and toxicity on small exact cases, with nulls, copies, long and empty texts."""

from __future__ import annotations

import os
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidemark.llm import leakage, packing, toxicity

needs_vocabulary = pytest.mark.skipif(not os.path.exists(packing.VOCABULARY), reason="no tokenizer files here")


# --- packing ---
def test_best_fit_keeps_capacity_and_copies_apart():
    rnd = np.random.default_rng(1)
    sizes, sources = rnd.integers(1, 100, 800), rnd.integers(0, 5, 800)
    clusters = np.where(rnd.random(800) < 0.2, 7, np.arange(800) + 100)
    bins = packing.best_fit(sizes, sources, clusters, 100)
    load, copies = Counter(), Counter()
    for b, s, c in zip(bins, sizes, clusters):
        load[b] += s
        copies[b, c] += 1
    assert max(load.values()) <= 100 and max(copies.values()) == 1
    assert sizes.sum() / (100 * len(load)) > 0.95
    assert len(packing.best_fit(np.array([], np.int64), np.array([], np.int64), np.array([], np.int64), 10)) == 0


def test_best_fit_prefers_other_sources():
    bins = packing.best_fit(np.array([60, 60, 40, 40]), np.array([1, 2, 1, 2]), np.arange(4), 100)
    assert bins[0] != bins[1] and bins[2] == bins[1] and bins[3] == bins[0]


@needs_vocabulary
def test_token_counts_are_those_of_the_tokenizer():
    import base64

    import tiktoken

    with open(packing.VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=packing.PATTERN, mergeable_ranks=ranks, special_tokens={})
    count = packing.token_counter(packing.VOCABULARY)
    for t in ["", "Hello, world!  Two  spaces\n\n", "Mör's naïve çase 12345 🙂", "a" * 3000, "it's  they'll\t\t\tx"]:
        assert count(t) == len(enc.encode_ordinary(t))


@needs_vocabulary
def test_pack(spark):
    rnd = random.Random(4)
    words = ["deck", "turn", "hand", "blocker", "sideboard", "wins", "draw"]
    data = [(i, " ".join(rnd.choices(words, k=rnd.randrange(1, 400))), f"s{i % 3}", 1, "w") for i in range(150)]
    data += [(200 + i, "the same text again and again", "s0", 1, "w") for i in range(12)]
    data += [(300, " ".join(rnd.choices(words, k=9000)), None, 1, "w"), (301, "", "s1", 1, "w"), (302, None, "s1", 1, "w"), (None, "x", "s1", 1, "w"), data[0]]
    df = spark.createDataFrame(data, "id int, text string, source string, tokens int, window string")
    got = packing.pack(df, "id", "text", "source", 512).collect()
    count = packing.token_counter(packing.VOCABULARY)
    total, load, inside = defaultdict(int), defaultdict(int), defaultdict(list)
    for r in got:
        total[r["doc"]] += r["tokens"]
        load[r["window"]] += r["tokens"]
        inside[r["window"]].append(r["doc"])
        assert r["start"] == 512 * r["piece"] and 0 < r["tokens"] <= 512
    texts = {i: t for i, t, *_ in data if i is not None and t}
    assert dict(total) == {i: count(t) for i, t in texts.items()} and max(load.values()) <= 512
    assert all(sum(200 <= d < 300 for d in w) <= 1 for w in inside.values())
    assert all(count(texts[r["doc"]]) > 512 for r in got if r["piece"] > 0)
    assert sum(load.values()) / (512 * len(load)) > 0.9
    assert packing.pack(df.where("false"), "id", "text", "source").count() == 0


# --- leakage ---
def test_plain_words():
    assert leakage.plain_words("Mör’s **Tutor‑Owl**<br/>at&nbsp;9 &amp; don&#39;t — stop") == ["mors", "tutorowl", "at", "9", "dont", "stop"]
    assert leakage.plain_words(None) == leakage.plain_words("  \n") == leakage.plain_words("***") == []
    assert leakage.plain_words("Привет, мир") == ["привет", "мир"]


def brute(docs, own, run):
    grams = defaultdict(set)
    for i, w in own.items():
        for j in range(len(w) - run + 1):
            grams[tuple(w[j : j + run])].add(i)
    out = set()
    for d, t in docs:
        w = leakage.plain_words(t)
        for j in range(len(w) - run + 1):
            out |= {(d, i) for i in grams.get(tuple(w[j : j + run]), ())}
    return out


def test_leaks_against_brute_force(spark):
    rnd = random.Random(7)
    vocab = [f"w{k}" for k in range(40)]
    shared = "Read the position below with great care and choose the line that wins from here at once."
    bodies = {i: [rnd.choice(vocab) for _ in range(rnd.randrange(14, 40))] for i in range(12)}
    items = [(i, f"{shared} {' '.join(w).capitalize()}.", "x") for i, w in bodies.items()] + [(50, f"{shared} too short.", "x"), (51, None, "x"), (None, "a " * 20, "x"), (52, "", None)]
    docs = []
    for d in range(200):
        w = [rnd.choice(vocab) for _ in range(rnd.randrange(0, 60))]
        if d % 3 == 0:
            b = bodies[rnd.randrange(12)]
            a = rnd.randrange(0, len(b) - 10)
            n = rnd.choice([9, 11, 12, 13, 30])
            piece = b[a : a + n]
            if d % 2:
                piece = [f"**{x.upper()}**," if rnd.random() < 0.4 else x for x in piece]
            at = rnd.randrange(len(w) + 1)
            w[at:at] = piece
        docs.append((d, rnd.choice([" ", "\n"]).join(w), "s"))
    docs += [(500, shared * 3, "s"), (501, None, "s"), (502, "", "s"), (None, " ".join(bodies[0]), "s"), docs[0], (503, " ".join(bodies[1]) + " x" * 30_000 + " " + " ".join(bodies[2]), "s")]
    D = spark.createDataFrame(docs, "doc int, text string, item string")
    I = spark.createDataFrame(items, "item int, text string, doc string")  # noqa: E741
    got = leakage.leaks(D, "doc", "text", I, "item", "text")
    want = brute([d[:2] for d in docs if d[0] is not None], bodies, 12)
    assert {(r["doc"], r["item"]) for r in got.collect()} == want and (503, 1) in want and (503, 2) in want
    r = {(r["doc"], r["item"]): r for r in got.collect()}[503, 1]
    assert r["longest"] == len(bodies[1]) and r["windows"] == len(bodies[1]) - 11
    many = leakage.leaks(D, "doc", "text", I, "item", "text", block=60)  # several blocks of items
    assert {(r["doc"], r["item"]) for r in many.collect()} == want
    assert leakage.leaks(D.where("false"), "doc", "text", I, "item", "text").count() == 0
    assert leakage.leaks(D, "doc", "text", I.where("false"), "item", "text").count() == 0


# --- toxicity ---
def corpus(n=400, seed=1):
    rnd = random.Random(seed)
    cards, fine = ["idol", "ferry", "tutor", "basin", "relic"], ["the {c} draw was slow today", "i kept a hand with {c} and lost the game", "nobody plays {c} in this field any more", "what a garbage hand i kept with {c}", "my own play with {c} was stupid"]
    bad = [("abuse", "you are a worthless idiot and should quit"), ("abuse", "shut up idiot nobody wants you here"), ("hate", "those people should be thrown out of our hall"), ("sexual", "send me nude pictures and the foil is yours")]
    docs, truth = [], {}
    for i in range(n):
        s = [rnd.choice(fine).format(c=rnd.choice(cards)) for _ in range(rnd.randrange(2, 7))]
        if i % 4 == 0:
            kind, t = rnd.choice(bad)
            s.insert(rnd.randrange(len(s)), t)
            truth[i] = kind
        docs.append((i, ". ".join(s) + "."))
    return docs, truth, rnd


def test_toxicity_learns_from_noisy_verdicts(spark):
    docs, truth, rnd = corpus()
    labels = [(i, truth.get(i, "none") if rnd.random() > 0.08 else rnd.choice(["none", "abuse"])) for i in range(300)]
    odd = {1000: "YOU ARE A WORTHLESS IDIOT AND SHOULD QUIT!", 1001: "уou аre a wоrthless idiоt and should quit", 1002: "yooou are a worthlesss idiot and should quit", 1003: "you are a w*******s i***t and should quit", 1004: "what a stupid garbage hand", 1005: "", 1006: None, 1007: "you are a w0rthless idi0t and should quit", 1008: "the ferry draw was slow. " * 3000}
    data = [(i, t, "s1") for i, t in docs] + [(i, t, None) for i, t in odd.items()]
    D = spark.createDataFrame(data, "id int, text string, source string")
    L = spark.createDataFrame([*[(i, v, "r") for i, v in labels], (5, None, "r"), (None, "abuse", "r"), (99_999, "abuse", "r")], "id int, verdict string, text string")
    model = toxicity.train(D, "id", "text", L, "id", "verdict")
    got = {r["doc"]: r for r in toxicity.scores(D, "id", "text", "source", model).collect()}
    held = [i for i in range(300, 400)]
    assert len(got) == len(data) and all(got[i]["flagged"] == (i in truth) for i in held)
    assert [got[i]["flagged"] for i in odd] == [True, True, True, True, False, False, False, True, False]
    assert got[1005]["score"] is None and got[1006]["score"] is None
    for i in held:
        if i in truth:
            assert max(toxicity.CLASSES, key=lambda c: got[i][c]) == truth[i]
    assert toxicity.scores(D.where("false"), "id", "text", "source", model).count() == 0


def test_toxicity_without_labels(spark):
    D = spark.createDataFrame([(1, "any text at all", "s")], "id int, text string, source string")
    model = toxicity.train(D, "id", "text", spark.createDataFrame([], "id int, verdict string"), "id", "verdict")
    assert [r["flagged"] for r in toxicity.scores(D, "id", "text", "source", model).collect()] == [False]


def test_kneser_ney_sums_to_one():
    texts = [["a", "b", "c"], ["a", "b", "d"], ["b", "c"]]
    shared = toxicity.SharedBackoff(texts)
    m = toxicity.KneserNey(((t, 1.0) for t in texts), shared)
    words = ["a", "b", "c", "d", "</s>"]
    assert abs(sum(m.p("a", "b", w) for w in [*words, "never seen"]) - 1.0) < 1e-9
    assert m.p("a", "b", "c") > m.p("a", "b", "a")


def test_reviewers_choice_refutes_frequent_passages(spark):
    """Passage 1 stands in 40 documents of which reviewers took one, as they do of ordinary ones; 2 in 12 of which they took 7;
    3 in one that nobody looked at."""
    found = [(i, [1]) for i in range(40)] + [(100 + i, [2]) for i in range(12)] + [(200, [3])] + [(1000 + i, []) for i in range(1000)]
    f = spark.createDataFrame([(d, [{"key": k} for k in ks]) for d, ks in found], "doc int, found array<struct<key: bigint>>")
    v = [(0, 1.0)] + [(100 + i, 1.0) for i in range(7)] + [(1000 + 25 * i, 0.0) for i in range(40)]
    share = spark.createDataFrame(v, "doc int, share double")
    assert [r["key"] for r in toxicity.refuted(f, share).collect()] == [1]
    assert toxicity.refuted(f, share.where("false")).count() == 0 and toxicity.refuted(f.where("false"), share).count() == 0


def test_planted_sentences_with_few_labels(spark):
    """A third as many labels as documents, verdicts that err, decoys: precision and recall of at least 0.9."""
    docs, truth, rnd = corpus(900, 7)
    labels = [(i, truth.get(i, "none") if rnd.random() > 0.08 else rnd.choice(["none", "abuse"])) for i, _ in docs if rnd.random() < (0.5 if i in truth else 0.15)]
    D = spark.createDataFrame([(i, t, "s") for i, t in docs], "id int, text string, source string")
    L = spark.createDataFrame(labels, "id int, verdict string")
    model = toxicity.train(D, "id", "text", L, "id", "verdict")
    got = {r["doc"] for r in toxicity.scores(D, "id", "text", "source", model, toxicity.verdict_shares(L, "id", "verdict")).collect() if r["flagged"]}
    assert len(got & set(truth)) >= 0.9 * len(truth) and len(got & set(truth)) >= 0.9 * len(got)
    few = toxicity.train(D, "id", "text", L, "id", "verdict", max_characters=2_000)  # the budget bounds what is collected
    assert isinstance(few, toxicity.Model)
