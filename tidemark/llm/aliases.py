"""Variant spellings of names typed by people, linked by suffix blocking and longest common subsequences."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.components import min_label_components
from tidemark.operators.skew import salted_join
from tidemark.session import durable, shuffled

# Given names with common short forms, and kinds of teams with abbreviations. They are what is known
# beforehand; names outside are learned from the handles.
GIVEN = {
    "alexander": "alex alec sandy sasha xander lex", "benedikt": "ben benny benni dick bene", "charlotte": "lottie charlie lotte char carla", "dominik": "dom nik nick domi nico",
    "elizabeth": "liz beth eliza betty lisa lizzy lizzie bess libby", "emilia": "emmy milla em emily mila mia", "francesca": "fran chessie franny frankie cesca", "frederick": "fred freddy freddie rick fritz",
    "gabriel": "gabe gabi gab", "harold": "harry hal", "henrietta": "hetty etta hettie henny harriet", "ignatius": "iggy nate ignaz", "isidora": "dora izzy isa issy dorie", "jonathan": "jon jonny nathan john johnny nat",
    "katherine": "kate kathy kat katie kit kitty", "leopold": "leo poldi pold", "margaret": "peg meg maggie peggy rita greta margie", "mortimer": "mort morty", "nicholas": "nick nico nik klaus niko nicky",
    "oliver": "ollie oli olly", "patrick": "pat paddy rick", "quentin": "quinn quin quent", "robert": "rob bob bobby robbie bert", "samuel": "sam sammy", "theodore": "theo ted teddy", "thomasina": "tammy tamsin tommie",
    "ursula": "uschi ulla ursel", "victoria": "vicky tori vic vickie", "william": "will bill billy liam willy", "xavier": "xavi xav", "yevgenia": "zhenya yev genia evgenia ", "zacharias": "zac zak zack zach",
}
TEAMS = {"academy": "acad", "brewhouse": "brewh", "cardhall": "ch", "collective": "coll", "guildhouse": "gh", "ironworks": "iw", "syndicate": "synd", "workshop": "wksp"}
#: Marks that say nothing of who it is: tags in brackets, venue and role notes, generation marks.
_NOISE = re.compile(r"\[[^\]]*\]|\([^)]*\)|\s-\s*(?:judge|coach|admin)\b|[_\s.](?:paper|online|judge|jr|sr)\b\.?")
_FILL = {"the", "team", "tm", "of", "gaming"}
_LEET = str.maketrans("013457", "oieast")
#: Length of an indexed suffix, names of a block that one task may pair with the others, and least similarity.
SUFFIX, BLOCK, SIMILAR = 4, 2_000, 0.8
#: Different partners that make a word a given name or kind of team, and at most one such word for so many handles.
PARTNERS, STOCK = 8, 20_000
#: Two forms of given names belong together if they stand with the same family names this often (share of the rarer
#: one's), in at least so many.
TOGETHER, LEAST_TOGETHER = 0.12, 5
#: Most letters of two similar names that the subsequence leaves out (an exchange or a swap leaves out two).
LEFT_OUT = 4

def lcs_ratio(a: str, b: str) -> float:
    """Twice the longest common subsequence over both lengths, by bit vectors."""
    if not a or not b:
        return 0.0
    at: dict[str, int] = {}
    for i, ch in enumerate(a):
        at[ch] = at.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for ch in b:
        u = v & at.get(ch, 0)
        v = (v + u | v - u) & full
    return 2 * (len(a) - v.bit_count()) / (len(a) + len(b))


def _like(token: str, words: dict, least: float = 0.8) -> str | None:
    """The word of at least four letters that a mistyped token stands for."""
    best = max(((lcs_ratio(token, w), w) for w in words if len(w) >= 5 and abs(len(w) - len(token)) <= 2), default=(0, None))
    return best[1] if best[0] >= least else None


class Stock:
    """Given names with their forms and kinds of teams with theirs, and the reading of handles by them."""

    def __init__(self, given: dict[str, set[str]], teams: dict[str, str] | None = None):
        self.given, self.teams = given, teams or {}
        self.kind = {x: "@" + k for k, v in self.teams.items() for x in (k, v)}
        self.forms: dict[str, set[str]] = {}
        for full, short in given.items():
            for f in {full, *short}:
                self.forms.setdefault(f, set()).add(full)
        self.initials: dict[str, set[str]] = {}
        for f, g in self.forms.items():
            self.initials.setdefault(f[0], set()).update(g)

    def with_learned(self, pairs: dict[str, set[str]]) -> Stock:
        """With forms (form: full names it stands for) that are not known yet."""
        given = {k: set(v) for k, v in self.given.items()}
        for form, fulls in pairs.items():
            if form not in self.forms and form not in self.kind:
                for f in fulls:
                    given.setdefault(f, set()).add(form)
        return Stock(given, self.teams)

    def readings(self, handle: str | None) -> list[tuple[str, list[str]]]:
        """Possible (name, who) of a handle: name is the family or team name, who the given names or the kind of team it
        may stand for. A blank handle has none."""
        h = "".join(c for c in unicodedata.normalize("NFKD", (handle or "").lower()) if not unicodedata.combining(c))
        h = _NOISE.sub(" ", " " + h + " ")
        tokens = [t for t in re.split(r"[^a-z0-9]+", h) if t]
        tokens = [x for t in tokens if (x := re.sub(r"(?<=[a-z])[0-9]{1,4}$", "", t).translate(_LEET) if re.search("[a-z]", t) else "")]
        if not tokens:
            return []
        # teams
        core = [t for t in tokens if t not in _FILL]
        if len(core) > 1 and core[0] == "t":
            team_core = core[1:]
        else:
            team_core = core
        joined = "".join(team_core)
        for form, kind in sorted(self.kind.items(), key=lambda k: -len(k[0])):
            whole = len(form) > 5
            for t, rest in ((form, None),) if whole else ():
                if joined.endswith(t) and len(joined) - len(t) >= 4:
                    return [(joined[: -len(t)], [kind])]
                if joined.startswith(t) and len(joined) - len(t) >= 4:
                    return [(joined[len(t) :], [kind])]
            if not whole and len(team_core) > 1 and form in team_core:
                return [("".join(x for x in team_core if x != form), [kind])]
        marked = len(core) < len(tokens)
        if len(team_core) > 1:
            for i, t in enumerate(team_core):
                if len(t) >= 7 and (k := _like(t, self.teams)):
                    return [("".join(team_core[:i] + team_core[i + 1 :]), ["@" + k])]
        for form, kind in self.kind.items():  # written together, abbreviated or mistyped
            if len(form) <= 5 and (len(form) > 2 or marked) and joined.endswith(form) and len(joined) - len(form) >= 6 and not any(t in self.forms for t in core):
                return [(joined[: -len(form)], [kind])]
        tails = [(lcs_ratio(joined[-n:], k), -n, k) for k in self.teams for n in (len(k) - 1, len(k), len(k) + 1) if len(joined) - n >= 5]
        ratio, n, k = max(tails, default=(0, 0, ""))
        if ratio >= 0.85:
            return [(joined[:n], ["@" + k])]
        if len(joined) >= 8 and joined[-2:] in ("gh", "iw") and joined[-2:] in self.kind and not any(t in self.forms for t in core):
            return [(joined[:-2], [self.kind[joined[-2:]]])]
        if marked and core and not (len(core) > 1 and any(t in self.forms for t in core)):  # a team whose kind is not said
            return [("".join(team_core), [])]
        # persons
        single = [t for t in tokens if len(t) == 1]
        words = [t for t in tokens if len(t) > 1]
        if not words:
            return []
        given = next((t for t in words if t in self.forms), None) if len(words) > 1 else None
        if given is None and len(words) > 1:
            typed = [(lcs_ratio(t, w), t, w) for t in words for w in self.given if abs(len(w) - len(t)) <= 2]
            best = max(typed, default=(0, None, None))
            if best[0] >= 0.75:
                rest = "".join(t for t in words if t != best[1])
                return [(rest, [best[2]])]
        if given is not None:
            rest = list(words)
            rest.remove(given)
            return [("".join(rest), sorted(self.forms[given]))]
        name = "".join(words)
        out = []
        if single:
            who = self.initials.get(single[0] if tokens[0] == single[0] or len(single) == 1 else single[-1], set())
            return [(name, sorted(who))]
        for form, full in self.forms.items():  # written together
            if len(form) >= 3 and len(name) - len(form) >= 5:
                if name.startswith(form):
                    out.append((len(form), name[len(form) :], sorted(full)))
                if name.endswith(form):
                    out.append((len(form), name[: -len(form)], sorted(full)))
        for w in self.given:  # the same with a typing error in the given name
            for n in (len(w) - 1, len(w), len(w) + 1):
                if len(name) - n >= 5:
                    for part, rest in ((name[:n], name[n:]), (name[-n:], name[:-n])):
                        if part != w and lcs_ratio(part, w) >= 0.85:
                            out.append((len(w) - 2, rest, [w]))
        longest = max((k for k, _, _ in out), default=0)
        cands = [(rest, who) for k, rest, who in out if k >= 6 or k == longest] if longest >= 6 else [(rest, who) for _, rest, who in out]
        if longest < 6:
            if len(name) >= 6:
                cands.append((name[1:], sorted(self.initials.get(name[0], set()))))
            cands.append((name, []))
        seen = set()
        return [x for x in cands if not ((x[0], tuple(x[1])) in seen or seen.add((x[0], tuple(x[1]))))]



KNOWN = Stock({k: set(v.split()) for k, v in GIVEN.items()}, TEAMS)


def words(handle: str | None) -> list[str]:
    """Words of at least three letters of a handle, without marks."""
    h = "".join(c for c in unicodedata.normalize("NFKD", (handle or "").lower()) if not unicodedata.combining(c))
    tokens = [re.sub(r"(?<=[a-z])[0-9]{1,4}$", "", t) for t in re.split(r"[^a-z0-9]+", _NOISE.sub(" ", " " + h + " "))]
    return [t for t in tokens if len(t) >= 3 and t.isalpha() and t not in _FILL]


def _pairs_of(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for p in pdfs:
        two = [w for w in map(words, p["handle"]) if len(w) == 2 and w[0] != w[1]]
        yield pd.DataFrame([x for a, b in two for x in ((a, b), (b, a))], columns=["word", "other"])


def learn_forms(handles: DataFrame, handle: str, partners: int = PARTNERS) -> dict[str, set[str]]:
    """Form to full forms, out of the handles themselves.

    In handles of two words a word with many different partners, more than these have themselves, is a given name (or a
    kind of team), the other one a family name. Forms that keep standing with the same family names belong to one given name; the more frequent one
    is the full form, and a form may belong to several. At most one word for STOCK handles is learned, which bounds what
    the driver gets.
    """
    pairs = durable(handles.select(F.col(handle).alias("handle")).mapInPandas(_pairs_of, "word string, other string").distinct())
    n = pairs.count() // 2
    degree = durable(pairs.groupBy("word").agg(F.count(F.lit(1)).alias("k")))
    around = pairs.join(shuffled(degree.select(F.col("word").alias("other"), F.col("k").alias("ok"))), "other").groupBy("word").agg(F.avg("ok").alias("around"))
    degree = durable(degree.where(F.col("k") >= max(partners, n // STOCK)).join(shuffled(around), "word").where("k > around").select("word", "k"))
    with_family = durable(pairs.join(degree.select("word"), "word").join(degree.select(F.col("word").alias("other")), "other", "left_anti"))
    left, right = with_family.select(F.col("word").alias("f"), "other"), with_family.select(F.col("word").alias("g"), "other")
    both = salted_join(left, right, ["other"], ["f"], rows_per_task=BLOCK).where("f < g").groupBy("f", "g").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_TOGETHER)
    size = {r["word"]: r["k"] for r in degree.collect()}
    near: dict[str, set[str]] = {w: set() for w in size}
    for r in both.collect():
        if r["n"] >= TOGETHER * min(size[r["f"]], size[r["g"]]):
            near[r["f"]].add(r["g"])
            near[r["g"]].add(r["f"])
    out: dict[str, set[str]] = {}
    full: set[str] = set()
    for w in sorted(size, key=lambda x: (-size[x], x)):
        above = near[w] & full
        if not above:
            full.add(w)
        out[w] = above or {w}
    return out


def _read(stock: Stock):
    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in pdfs:
            rows = [(i, k, n, w) for i, h in zip(p["id"], p["handle"]) for k, (n, w) in enumerate(stock.readings(h)) if len(n) >= 3]
            yield pd.DataFrame(rows, columns=["id", "reading", "name", "who"])

    return run


def _compare(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for p in pdfs:
        r = [(lcs_ratio(a, b), len(a) + len(b)) for a, b in zip(p["name_a"], p["name_b"])]
        yield p.assign(ratio=[x if (1 - x) * n <= LEFT_OUT + 1e-9 else 0.0 for x, n in r])


def _blocked_pairs(names: DataFrame) -> DataFrame:
    """(name_a, name_b): all distinct names, a < b, that share a suffix of themselves or of their reversal and may be
    of one person or team.

    A suffix of SUFFIX letters is a block. Of a block every two names are paired whose fields who have a value in
    common; a name that leaves open who it is (no who) is paired with all names of the block. Nothing is dropped,
    whatever the size of a block: large blocks are split among tasks. Names whose lengths differ by more than LEFT_OUT
    can't be similar, and a pair with both ends in common is formed once.
    """
    n = names.select("name", F.explode(F.when(F.size("who") > 0, F.col("who")).otherwise(F.array(F.lit("")))).alias("w")).distinct()
    ends = F.array(F.struct(F.lit("s").alias("side"), F.reverse("name").alias("x")), F.struct(F.lit("p").alias("side"), F.col("name").alias("x")))
    rows = durable(n.select("name", "w", F.explode(ends).alias("e")).select("name", "w", "e.side", F.substring("e.x", 1, SUFFIX).alias("block")))
    left, right = rows.withColumnRenamed("name", "l"), rows.withColumnRenamed("name", "r")
    near = (F.abs(F.length("l") - F.length("r")) <= LEFT_OUT) & ((F.col("side") == "p") | (F.substring("l", 1, SUFFIX) != F.substring("r", 1, SUFFIX)))
    same = salted_join(left, right, ["side", "block", "w"], ["l"], rows_per_task=BLOCK).where(near & (F.col("l") < F.col("r")))
    open_ = salted_join(left.where("w <> ''"), right.where("w = ''").drop("w"), ["side", "block"], ["l"], rows_per_task=BLOCK).where(near & (F.col("l") != F.col("r")))
    pair = same.select("l", "r").union(open_.select("l", "r"))
    return pair.select(F.least("l", "r").alias("name_a"), F.greatest("l", "r").alias("name_b")).distinct()


def link_aliases(aliases: DataFrame, alias_id: str, handle: str, player: str, known: Stock = KNOWN) -> DataFrame:
    """(id, entity): the entity of every handle, named by its smallest id; handles linked to no other stand alone.

    Handles are read as a family or team name and who it may be (given names, nicknames, initials, kinds of team), by
    the ``known`` names and those that ``learn_forms`` finds in the handles.
    Names are compared by longest-common-subsequence ratio within suffix blocks. Handles that say exactly who are
    linked if names are similar and who is equal, and handles with one curated player id always. A handle that leaves
    open who it is (an initial, an ambiguous nickname, no given name) goes to the entity with the most similar name
    that it may be, of several the one with more handles; if there is none, to others of its kind.

    Repeated rows count once; null ids give no row; blank handles stand alone; different player ids prove nothing.
    """
    a = aliases.where(F.col(alias_id).isNotNull()).select(F.col(alias_id).alias("id"), F.col(handle).alias("handle"), F.nullif(F.trim(F.col(player)), F.lit("")).alias("player"))
    a = durable(a.groupBy("id").agg(F.min("handle").alias("handle"), F.min("player").alias("player")))
    id_type = dict(a.dtypes)["id"]
    stock = known.with_learned(learn_forms(a.where("handle is not null"), "handle"))
    r = durable(a.where("handle is not null").select("id", "handle").mapInPandas(_read(stock), f"id {id_type}, reading int, name string, who array<string>"))
    close = _blocked_pairs(r).mapInPandas(_compare, "name_a string, name_b string, ratio double").where(F.col("ratio") >= SIMILAR)
    close = durable(close)
    near = close.union(close.select("name_b", "name_a", "ratio")).union(r.select(F.col("name").alias("name_a"), F.col("name").alias("name_b"), F.lit(1.0).alias("ratio")).distinct())
    per = r.groupBy("id").agg(F.count(F.lit(1)).alias("readings"))
    r = durable(r.join(per, "id").withColumn("sure", (F.size("who") == 1) & (F.col("readings") == 1)))
    sure = r.where("sure").select("id", "name", F.col("who")[0].alias("w"))
    # Equal (name, who) first: one node each; then similar names with equal who.
    node = sure.groupBy("name", "w").agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("n"))
    x, y = node.select(F.col("name").alias("name_a"), "w", F.col("node").alias("a")), node.select(F.col("name").alias("name_b"), "w", F.col("node").alias("b"))
    edges = close.join(x, "name_a").join(y, ["name_b", "w"]).select("a", "b")
    same = sure.join(node, ["name", "w"]).select(F.col("id").alias("a"), F.col("node").alias("b"))
    first = a.where("player is not null").groupBy("player").agg(F.min("id").alias("b"))
    curated = a.join(first, "player").select(F.col("id").alias("a"), "b")
    strong = durable(min_label_components(edges.union(same).union(curated)))
    # Open readings go to the best entity.
    size = strong.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    target = sure.join(strong, "id").join(size, "label").groupBy("label", "name", "w").agg(F.max("n").alias("n"))
    fixed = a.where("player is not null").select("id")
    open_ = r.where("not sure").join(fixed, "id", "left_anti")
    may = open_.join(near.withColumnRenamed("name_a", "name"), "name").join(target.select(F.col("name").alias("name_b"), "w", "label", "n"), "name_b")
    may = may.where((F.size("who") == 0) | F.expr("array_contains(who, w)"))
    # one close name decides before a larger entity: whole steps of similarity first
    best = may.groupBy("id").agg(F.max(F.struct(F.round(F.col("ratio") * 20).alias("q"), (-F.col("readings")).alias("r"), "n", (-F.col("label")).alias("o"), "label")).alias("b"))
    weak = best.select(F.col("id").alias("a"), F.col("b.label").alias("b"))
    known = durable(strong.select(F.col("id").alias("a"), F.col("label").alias("b")).union(weak))
    # What is left is linked among itself where names are similar and who may be equal.
    rest = open_.join(known.select(F.col("a").alias("id")), "id", "left_anti").select("id", "name", "who")
    l, q = rest.select(F.col("id").alias("a"), F.col("name").alias("name_a"), F.col("who").alias("wa")), rest.select(F.col("id").alias("b"), F.col("name").alias("name_b"), F.col("who").alias("wb"))  # noqa: E741
    among = near.join(l, "name_a").join(q, "name_b").where((F.col("a") < F.col("b")) & (F.arrays_overlap("wa", "wb") | ((F.size("wa") == 0) & (F.size("wb") == 0)))).select("a", "b")
    alone = a.select(F.col("id").alias("a"), F.col("id").alias("b"))
    entity = min_label_components(known.union(among).union(alone))
    return entity.select("id", F.col("label").alias("entity"))


def alias_pairs(entities: DataFrame) -> DataFrame:
    """(a, b): all pairs of ids of one entity, a < b; an entity has few handles."""
    e = entities.select("entity", F.col("id").alias("a"))
    return e.join(entities.select("entity", F.col("id").alias("b")), "entity").where("a < b").select("a", "b")
