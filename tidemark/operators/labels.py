"""Labels of decks by rules: conditions over lists of names, variants, conflicts, piles, colours, splits.

A ruleset is small and curated, so it is a literal of the plan: a deck is matched against all rules in one projection,
without a join or a shuffle. Rules are given as Python lists:

    rule  = {"name": str, "color": bool, "conditions": [cond, ...], "variants": [rule, ...]}
    cond  = {"type": one of CONDITIONS, "cards": [str, ...]}
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Types of conditions. The single ones look at the first card of their list only.
CONDITIONS = (
    "InMainboard", "InSideboard", "InMainOrSideboard", "DoesNotContain", "DoesNotContainMainboard", "DoesNotContainSideboard",
    "OneOrMoreInMainboard", "OneOrMoreInSideboard", "OneOrMoreInMainOrSideboard", "TwoOrMoreInMainboard", "TwoOrMoreInSideboard", "TwoOrMoreInMainOrSideboard",
)
#: Share of a deck's distinct rows that the weight of its best pile must exceed.
LEAST_PILE = 0.1
# The five colours in their order, and the names of their combinations.
COLORS = "WUBRG"
COMBINATIONS = {
    "": "Colorless", "W": "White", "U": "Blue", "B": "Black", "R": "Red", "G": "Green",
    "WU": "Azorius", "WB": "Orzhov", "WR": "Boros", "WG": "Selesnya", "UB": "Dimir", "UR": "Izzet", "UG": "Simic", "BR": "Rakdos", "BG": "Golgari", "RG": "Gruul",
    "WUB": "Esper", "UBR": "Grixis", "BRG": "Jund", "WRG": "Naya", "WUG": "Bant", "WBG": "Abzan", "WUR": "Jeskai", "UBG": "Sultai", "WBR": "Mardu", "URG": "Temur",
    "UBRG": "4c (no White)", "WBRG": "4c (no Blue)", "WURG": "4c (no Black)", "WUBG": "4c (no Red)", "WUBR": "4c (no Green)", "WUBRG": "5c",
}

_COND = "array<struct<type:string,cards:array<string>>>"
_RULES = f"array<struct<name:string,color:boolean,conditions:{_COND},variants:array<struct<name:string,color:boolean,conditions:{_COND}>>>>"


def load_rules(text: str) -> list[dict]:
    """Rules from JSON; commas before a closing bracket are tolerated. An unknown condition type raises."""
    import re

    rules = json.loads(re.sub(r",(\s*[\]}])", r"\1", text))
    check_rules(rules)
    return rules


def check_rules(rules: Sequence[Mapping]) -> None:
    for r in rules:
        for c in r.get("conditions", []):
            if c["type"] not in CONDITIONS:
                raise ValueError(f"unknown condition type {c['type']!r} in {r['name']!r}")
        check_rules(r.get("variants", []))


def _literal(rules: Sequence[Mapping]) -> Column:
    plain = lambda r: {"name": r["name"], "color": bool(r.get("color")), "conditions": list(r.get("conditions", []))}
    return F.from_json(F.lit(json.dumps([{**plain(r), "variants": [plain(v) for v in r.get("variants", [])]} for r in rules])), _RULES)


def condition(kind: Column, cards: Column, main: Column, side: Column) -> Column:
    """Whether a deck with these distinct names meets a condition; an empty list of cards is met by all decks."""
    first = F.get(cards, F.lit(0))
    in_main, in_side = F.array_contains(main, first), F.array_contains(side, first)
    n_main = F.size(F.filter(cards, lambda x: F.array_contains(main, x)))
    n_side = F.size(F.filter(cards, lambda x: F.array_contains(side, x)))
    n_any = F.size(F.filter(cards, lambda x: F.array_contains(main, x) | F.array_contains(side, x)))
    cases = dict(
        zip(
            CONDITIONS,
            (in_main, in_side, in_main | in_side, ~in_main & ~in_side, ~in_main, ~in_side, n_main >= 1, n_side >= 1, n_any >= 1, n_main >= 2, n_side >= 2, n_main + n_side >= 2),
        )
    )
    out = F.when(F.size(cards) == 0, F.lit(True))
    for k, v in cases.items():
        out = out.when(kind == k, v)
    return out


def meets(conditions: Column, main: Column, side: Column) -> Column:
    """Whether all conditions are met."""
    return F.forall(conditions, lambda c: condition(c["type"], c["cards"], main, side))


def deck_lists(cards: DataFrame) -> DataFrame:
    """(tournament_id, deck_idx, main, side): distinct names of both boards of (.., board, name, copies)."""
    pick = lambda b: F.array_sort(F.collect_set(F.when(F.col("board") == b, F.col("name"))))
    return cards.groupBy("tournament_id", "deck_idx").agg(pick("main").alias("main"), pick("side").alias("side"))


def condition_counts(cards: DataFrame, lists: Sequence[tuple[str, Sequence[str]]]) -> DataFrame:
    """(label, type, decks): how many decks meet each type of condition over each list of names; none without a deck.

    The same as ``condition`` for every deck, list and type, but a deck is only ever joined with the lists of which it
    holds a name: what is met without one (an empty list, the negative types) follows from the number of all decks.
    """
    spark, key = cards.sparkSession, ["tournament_id", "deck_idx"]
    every = cards.select(*key).distinct().agg(F.count(F.lit(1)).alias("n"))
    of = spark.createDataFrame([(o, label, len(names)) for o, (label, names) in enumerate(lists)], "o int, label string, size int")
    names = spark.createDataFrame([(o, i, x) for o, (_, names) in enumerate(lists) for i, x in enumerate(names)], "o int, i int, name string")
    held = cards.where(F.col("board").isin("main", "side")).join(F.broadcast(names), "name").select(*key, "o", "i", (F.col("board") == "main").alias("main")).distinct()  # lists are curated
    yes = lambda c: F.sum(c.cast("int"))
    first, main = F.col("i") == 0, F.col("main")
    deck = held.groupBy(*key, "o").agg(F.max(first & main).alias("a"), F.max(first & ~main).alias("b"), yes(main).alias("m"), yes(~main).alias("s"))
    a, b, m, s = (F.col(c) for c in "abms")
    met = (a, b, a | b, a | b, a, b, m >= 1, s >= 1, m + s >= 1, m >= 2, s >= 2, m + s >= 2)
    some = deck.groupBy("o").agg(*[yes(x).alias(k) for k, x in zip(CONDITIONS, met)])
    all_ = of.join(some, "o", "left").join(F.broadcast(every))  # one row
    count = lambda k: F.when(F.col("size") == 0, F.col("n")).otherwise(F.col("n") - F.coalesce(k, F.lit(0)) if k.startswith("DoesNot") else F.coalesce(k, F.lit(0)))
    rows = all_.select("label", F.explode(F.array(*[F.struct(F.lit(k).alias("type"), count(k).alias("decks")) for k in CONDITIONS])).alias("r"))
    return rows.groupBy("label", F.col("r.type").alias("type")).agg(F.sum("r.decks").alias("decks")).where("decks > 0")


def guild(colors: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in COMBINATIONS.items() for x in kv])
    return F.coalesce(F.element_at(table, colors), colors)


def _named(m: Column, colors: Column) -> Column:
    return F.when(m["color"] & (F.length(colors) > 0), F.concat_ws(" ", guild(colors), m["name"])).otherwise(m["name"])


def classify(decks: DataFrame, rules: Sequence[Mapping], colors: Column | None = None) -> DataFrame:
    """``decks`` (.., main, side) with label, base and kind.

    A rule is met if all its conditions are; the variants of it that are met stand in its place. One match is the
    label ('archetype' or 'variant'), several are Conflict(a,b) in the order of the rules ('conflict'), none leaves
    label and base null ('unknown'). ``colors`` prefixes the matches that ask for it.
    """
    check_rules(rules)
    colors = F.coalesce(colors, F.lit("")) if colors is not None else F.lit("")
    parents = F.lit(",".join([""])).alias("p") if not rules else F.array(*[F.lit(r["name"]) for r in rules])
    none = F.from_json(F.lit("[]"), "array<struct<name:string,color:boolean>>")
    short = lambda m: F.struct(m["name"].alias("name"), m["color"].alias("color"))

    def matched(r: Column) -> Column:
        variants = F.transform(F.filter(r["variants"], lambda v: meets(v["conditions"], F.col("main"), F.col("side"))), short)
        return F.when(~meets(r["conditions"], F.col("main"), F.col("side")), none).when(F.size(variants) > 0, variants).otherwise(F.array(short(r)))

    d = decks.withColumn("__m", F.flatten(F.transform(_literal(rules), matched)))
    n, one = F.size("__m"), F.get("__m", F.lit(0))
    label = F.when(n == 1, _named(one, colors)).when(n > 1, F.concat(F.lit("Conflict("), F.array_join(F.transform("__m", lambda m: _named(m, colors)), ","), F.lit(")")))
    kind = F.when(n == 0, "unknown").when(n > 1, "conflict").when(F.array_contains(parents, one["name"]) if rules else F.lit(True), "archetype").otherwise("variant")
    return d.withColumns({"label": label, "base": F.when(n == 1, one["name"]), "kind": kind}).drop("__m")


def fallback(decks: DataFrame, cards: DataFrame, piles: Sequence[tuple[str, Sequence[str]]], least: float = LEAST_PILE) -> DataFrame:
    """(tournament_id, deck_idx, pile): the pile with most copies on the deck's boards (ties: the smaller pile, then
    the earlier one), if these exceed ``least`` of the deck's distinct rows. ``decks`` are the decks to decide."""
    spark = decks.sparkSession
    key = ["tournament_id", "deck_idx"]
    p = spark.createDataFrame([(i, n, len(set(c)), x) for i, (n, c) in enumerate(piles) for x in sorted(set(c))], "o int, pile string, size int, name string")
    c = cards.join(decks.select(*key).distinct(), key, "left_semi")
    rows = c.groupBy(*key).agg(F.count(F.lit(1)).alias("rows"))
    w = c.join(F.broadcast(p), "name").groupBy(*key, "o", "pile", "size").agg(F.sum("copies").alias("w"))  # piles are curated
    best = w.groupBy(*key).agg(F.max(F.struct("w", (-F.col("size")).alias("s"), (-F.col("o")).alias("i"), "pile")).alias("b"))
    return best.join(rows, key).where(F.col("b.w") / F.col("rows") > least).select(*key, F.col("b.pile").alias("pile"))


def deck_colors(cards: DataFrame, names: DataFrame) -> DataFrame:
    """(tournament_id, deck_idx, colors): colours that a land of the deck makes and a nonland card of it costs, in
    order. ``names``: (name, is_land, colors, produced), both arrays of letters."""
    c = cards.join(names.select("name", "is_land", F.when(F.col("is_land"), F.col("produced")).otherwise(F.col("colors")).alias("x")), "name")
    g = c.select("tournament_id", "deck_idx", "is_land", F.explode("x").alias("x")).groupBy("tournament_id", "deck_idx", "x").agg(F.max("is_land").alias("land"), F.min("is_land").alias("all_land"))
    g = g.where("land and not all_land").groupBy("tournament_id", "deck_idx").agg(F.collect_set("x").alias("s"))
    found = g.select("tournament_id", "deck_idx", F.concat(*[F.when(F.array_contains("s", x), x).otherwise("") for x in COLORS]).alias("colors"))
    return cards.select("tournament_id", "deck_idx").distinct().join(found, ["tournament_id", "deck_idx"], "left").select("tournament_id", "deck_idx", F.coalesce("colors", F.lit("")).alias("colors"))


def color_counts(cards: DataFrame, names: DataFrame) -> DataFrame:
    """(tournament_id, deck_idx, color, copies): nonland main-board copies of each colour; unknown names are skipped."""
    n = names.where("not is_land").select("name", F.explode("colors").alias("color")).where(F.col("color").isin(*COLORS))
    return cards.where("board = 'main'").join(n, "name").groupBy("tournament_id", "deck_idx", "color").agg(F.sum("copies").alias("copies"))


def color_split(labels: DataFrame, counts: DataFrame, splits: Sequence[Mapping]) -> DataFrame:
    """``labels`` (tournament_id, deck_idx, label) with the child label of a colour split, or as it was.

    split = {"parent", "min_copies", "buckets": [{"name", "requires_any": [..], "forbids_all": [..]}]}. Several buckets
    that fit are an error of the author and raise when the rows are read.
    """
    key = ["tournament_id", "deck_idx"]
    have = counts.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("color", "copies"))).alias("have"))
    d = labels.join(have, key, "left")
    out = F.lit(None).cast("string")
    for s in splits:
        enough = lambda x, s=s: F.coalesce(F.element_at("have", F.lit(x)) >= s["min_copies"], F.lit(False))
        any_of = lambda xs, enough=enough: F.array_max(F.array(*[enough(x) for x in xs])) if xs else F.lit(False)
        fits = [F.when((any_of(b["requires_any"]) if b.get("requires_any") else F.lit(True)) & ~any_of(b.get("forbids_all", [])), b["name"]) for b in s["buckets"]]
        fit = F.array_compact(F.array(*fits))
        child = F.when(F.size(fit) > 1, F.raise_error(F.concat(F.lit(f"several buckets of {s['parent']} fit: "), F.array_join(fit, ", ")))).otherwise(F.get(fit, F.lit(0)))
        out = F.when(F.col("label") == s["parent"], child).otherwise(out)
    return d.withColumn("label", F.coalesce(out, "label")).drop("have")


def variants(decks: DataFrame, rules: Sequence[Mapping], defaults: Mapping[str, str] | None = None) -> DataFrame:
    """``decks`` (.., label, main, side) with variant: of the rules {"parent", "name", "conditions"} of the deck's label the
    one that is met, else the parent's default, else null. Several that are met raise when the rows are read."""
    check_rules(rules)
    lit = F.from_json(F.lit(json.dumps([{"parent": r["parent"], "name": r["name"], "conditions": list(r["conditions"])} for r in rules])), f"array<struct<parent:string,name:string,conditions:{_COND}>>")
    met = F.transform(F.filter(lit, lambda r: (r["parent"] == F.col("label")) & meets(r["conditions"], F.col("main"), F.col("side"))), lambda r: r["name"])
    default = F.lit(None).cast("string")
    for parent, name in (defaults or {}).items():
        default = F.when(F.col("label") == parent, name).otherwise(default)
    d = decks.withColumn("__v", met)
    several = F.raise_error(F.concat(F.lit("several variants are met: "), F.array_join("__v", ", ")))
    known = F.col("label").isin(*{r["parent"] for r in rules}) if rules else F.lit(False)
    return d.withColumn("variant", F.when(F.size("__v") > 1, several).when(F.size("__v") == 1, F.get("__v", F.lit(0))).when(known, default)).drop("__v")


def label_decks(
    cards: DataFrame,
    rules: Sequence[Mapping],
    piles: Sequence[tuple[str, Sequence[str]]] = (),
    colors: DataFrame | None = None,
    counts: DataFrame | None = None,
    splits: Sequence[Mapping] = (),
    variant_rules: Sequence[Mapping] = (),
    defaults: Mapping[str, str] | None = None,
) -> DataFrame:
    """(tournament_id, deck_idx, label, kind, variant) of all decks with cards, in one pass: rules, then piles for what no
    rule met ('fallback'), then 'Unknown'; colour splits and variant rules go by the final label."""
    key = ["tournament_id", "deck_idx"]
    d = deck_lists(cards)
    if colors is not None:
        d = d.join(colors, key, "left")
    d = classify(d, rules, F.col("colors") if colors is not None else None)
    if piles:
        d = d.join(fallback(d.where("kind = 'unknown'"), cards, piles), key, "left")
        d = d.withColumn("kind", F.when(F.col("pile").isNotNull(), "fallback").otherwise(F.col("kind"))).withColumn("label", F.coalesce("label", "pile")).drop("pile")
    d = d.withColumn("label", F.coalesce("label", F.lit("Unknown")))
    if splits and counts is not None:
        d = color_split(d, counts, splits)
    return variants(d, variant_rules, defaults).select(*key, "label", "kind", "variant")


def staged_parents(splits: DataFrame) -> DataFrame:
    """(parent): parents with a candidate split, of (parent, status, ..)."""
    return splits.where("status = 'candidate' and parent is not null").select("parent").distinct()


def apply_split(decks: DataFrame, members: DataFrame, signatures: DataFrame | None = None, cards: DataFrame | None = None) -> DataFrame:
    """``decks`` (tournament_id, deck_idx, archetype, variant) with the camps of a split written as variants.

    ``members``: (tournament_id, deck_idx, parent, camp). A camp is written only to exactly these decks and only while
    their archetype still is the parent. ``signatures`` (parent, camp, name) is for parents without members: a deck
    that holds a camp's signature card on its main board goes to it, if it holds that of one camp only; the only camp
    without a signature is the default of its parent.
    """
    key = ["tournament_id", "deck_idx"]
    m = members.groupBy(*key, "parent").agg(F.min("camp").alias("camp")).withColumnRenamed("parent", "archetype")
    d = decks.join(m, [*key, "archetype"], "left").withColumn("variant", F.coalesce("camp", "variant")).drop("camp")
    if signatures is None or cards is None:
        return d
    s = signatures.join(members.select("parent").distinct(), "parent", "left_anti")
    held = cards.where("board = 'main'").select(*key, "name").distinct().join(F.broadcast(s.where("name is not null")), "name")  # a few cards
    held = held.groupBy(*key, "parent").agg(F.collect_set("camp").alias("camps"))
    rest = s.where("name is null").groupBy("parent").agg(F.collect_set("camp").alias("c")).where(F.size("c") == 1).select(F.col("parent").alias("archetype"), F.get("c", F.lit(0)).alias("other"))
    d = d.join(held.withColumnRenamed("parent", "archetype"), [*key, "archetype"], "left").join(F.broadcast(rest), "archetype", "left")
    camp = F.when(F.size("camps") == 1, F.get("camps", F.lit(0))).when(F.col("camps").isNull(), F.col("other"))
    return d.withColumn("variant", F.coalesce(camp, "variant")).select(*decks.columns)
