"""Abusive, hateful or sexual passages, by class-conditional Kneser-Ney models."""

from __future__ import annotations

import hashlib
import math
import pickle
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.session import durable

CLASSES = ("abuse", "hate", "sexual")
#: At most so many labelled documents with so many characters together train the models, in order of the hash of
#: their id; this bounds what the driver gets.
MAX_LABELLED, MAX_CHARACTERS = 20_000, 80_000_000
#: Absolute discount, rounds of weak supervision, and parts of the labelled documents for held-out scores in training.
DISCOUNT, ROUNDS, FOLDS = 0.75, 3, 4
#: Documents with a verdict that a word must stand in to say anything, and how often reviewers are taken to find a
#: toxic passage (how often a document gets a verdict without one is at most the share of all labelled documents), and log
#: odds above which a passage is taken out of ordinary text from the start.
SUPPORT, REVIEWED, CLEAR = 2, 0.9, 4.0
#: Frequent words that are always kept apart, and the word that stands for all that say nothing.
FREQUENT, OTHER = 250, "<o>"
#: A passage of at least so many words counts if its log-likelihood ratio reaches a total and a value per word.
LEAST_WORDS, TOTAL, PER_WORD = 3, 10.0, 0.9
#: Fewer words than so many must reach a higher value each.
FEW_WORDS, PER_FEW = 6, 4.0
#: Log odds from which the reviewers' choice of documents refutes a passage.
REFUTED = 5.0
#: The same in training, where held-out ratios are lower.
TRAIN_TOTAL, TRAIN_PER_WORD = 5.0, 1.0

# Cyrillic and Greek letters that look like Latin ones.
_LOOKS = str.maketrans("аАвВсСԁеЕёҽгһНіІїјЈкКӏмМоОпрРԛѕЅтТиуУԝхХуγαονρτυκιε", "aAbBcCdeEeerhHiIijJkKlmMoOnpPqsStTuyYwxXyyaovptukie")
# Digits and signs written for letters inside a word.
_LEET = str.maketrans("013457@$", "oieastas")
_WORD = bytes(10 if chr(c) in ".!?:;\n" else c if chr(c) in "abcdefghijklmnopqrstuvwxyz*@$0123456789" else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
_NUMBER = re.compile(r"(?<![a-z*])[0-9@$]+(?![a-z*0-9@$])")
_SIGN = re.compile(r"[0-8@$]")
_FOREIGN = re.compile("[Ͱ-ԯ]")
_RUN3 = re.compile(r"([a-z])\1\1")
_BOLD = re.compile(r"\*\*(?=\S)([^*\n]{1,200}?)(?<=\S)\*\*|(?<![\w*])\*(?=[^\s*])([^*\n]{1,200}?)(?<=[^\s*])\*(?![\w*])")
_SPACED = re.compile(r"(?<![a-z*])(?:[a-z] ){3,}[a-z](?![a-z*])")
_MIXED = re.compile(r"[a-z*]*(?:[a-z*][0-9@$]|[0-9@$][a-z])[a-z0-9@$*]*")


class Reader:
    """Text to passages of plain words; undoes look-alikes, digits for letters, stretched, spaced and masked words.

    ``vocabulary`` maps known words to their numbers in the training texts. A stretched or masked word becomes the
    most frequent known word that fits what is visible of it, else itself (stretched: each run as one letter) or '*'.
    """

    def __init__(self, vocabulary: dict[str, int]):
        self.known = vocabulary
        self.by_shape: dict[tuple[int, str], list[str]] = defaultdict(list)
        self.by_squeezed: dict[str, list[str]] = defaultdict(list)
        for w in sorted(vocabulary, key=lambda w: (-vocabulary[w], w)):
            self.by_shape[len(w), w[0]].append(w)
            self.by_squeezed[re.sub(r"(.)\1+", r"\1", w)].append(w)
        self.seen: dict[str, str] = {}

    def _repair(self, w: str) -> str:
        if w in self.seen:
            return self.seen[w]
        out = w
        if "*" in w:
            bare = w.strip("*")
            if not bare:
                out = ""
            elif w[0] == "*" and w[-1] != "*" or w.count("*") == 1 and w[-1] == "*":
                out = bare  # list mark or emphasis
            else:
                fit = re.compile(w.replace("*", "."))
                out = next((k for k in self.by_shape.get((len(w), w[0]), ()) if fit.fullmatch(k)), "*")
        elif _RUN3.search(w):
            squeezed = re.sub(r"(.)\1+", r"\1", w)
            out = next(iter(self.by_squeezed.get(squeezed, ())), squeezed)
        self.seen[w] = out
        return out

    def _letters(self, m: re.Match) -> str:
        w = m.group()
        plain = w.translate(_LEET)
        return plain if plain in self.known or "*" in w else w

    def passages(self, text: str | None) -> list[list[str]]:
        if not text:
            return []
        if not text.isascii():
            if _FOREIGN.search(text):
                text = text.translate(_LOOKS)
            text = unicodedata.normalize("NFKD", text.replace("ß", "ss").replace("’", "").replace(" ", " "))
        if "*" in text:
            text = _BOLD.sub(lambda m: m.group(1) or m.group(2), text)
        raw = text.encode("ascii", "ignore").replace(b"'", b"").replace(b"<br/>", b"\n").translate(_WORD)
        t = raw.decode("ascii")
        t = _NUMBER.sub("9", t)
        if _SIGN.search(t):
            t = re.sub(r"[@$0-9]+", "9", _MIXED.sub(self._letters, t))
        if _SPACED.search(t):
            t = _SPACED.sub(lambda m: m.group().replace(" ", ""), t)
        odd = "*" in t or _RUN3.search(t) is not None
        if odd:
            fix = self._repair
            parts = [[x for w in part.split() if (x := fix(w) if "*" in w or _RUN3.search(w) else w)] for part in t.split("\n")]
        else:
            parts = [part.split() for part in t.split("\n")]
        return [p for p in parts if p]


class KneserNey:
    """Interpolated Kneser-Ney trigrams of one class: below the trigrams a word counts by the number of different
    contexts it continues in the class, and below that by the contexts it continues in all classes together."""

    def __init__(self, passages: Iterable[tuple[list[str], float]], shared: SharedBackoff):
        self.shared = shared
        self.tri: dict[tuple, float] = defaultdict(float)
        for words, weight in passages:
            u = v = "<s>"
            for w in [*words, "</s>"]:
                self.tri[u, v, w] += weight
                u, v = v, w
        self.bi: dict[tuple, float] = defaultdict(float)
        for _, v, w in self.tri:
            self.bi[v, w] += 1.0
        self.uni: dict[tuple, float] = defaultdict(float)
        for _, w in self.bi:
            self.uni[w,] += 1.0
        self.c3, self.t3 = self._totals(self.tri)
        self.c2, self.t2 = self._totals(self.bi)
        self.c1, self.t1 = self._totals(self.uni)

    @staticmethod
    def _totals(table: dict) -> tuple[dict, dict]:
        """Sum of the counts of each context, and the mass its discounts leave, in units of the discount."""
        total: dict = defaultdict(float)
        types: dict = defaultdict(float)
        for k, c in table.items():
            total[k[:-1]] += c
            types[k[:-1]] += min(1.0, c / DISCOUNT)
        return total, types

    @staticmethod
    def _level(table: dict, total: dict, types: dict, context: tuple, w: str, lower: float) -> float:
        c = total.get(context, 0.0)
        return (max(table.get((*context, w), 0.0) - DISCOUNT, 0.0) + DISCOUNT * types[context] * lower) / c if c else lower

    def p(self, u: str, v: str, w: str) -> float:
        p1 = self._level(self.uni, self.c1, self.t1, (), w, self.shared.p(w))
        p2 = self._level(self.bi, self.c2, self.t2, (v,), w, p1)
        return self._level(self.tri, self.c3, self.t3, (u, v), w, p2)


class SharedBackoff:
    """Continuation probabilities (in how many different contexts a word stands) over all classes together."""

    def __init__(self, passages: Iterable[list[str]]):
        pairs = {(v, w) for words in passages for v, w in zip(["<s>", *words], [*words, "</s>"])}
        self.n = Counter(w for _, w in pairs)
        self.total, self.kinds = len(pairs), len(self.n) + 1

    def p(self, w: str) -> float:
        """Discounted share of the pairs; what the discounts leave is shared by all known words and one unknown."""
        return (max(self.n.get(w, 0) - DISCOUNT, 0.0) + DISCOUNT * len(self.n) / self.kinds) / self.total if self.total else 1.0


class Ratio:
    """Log-likelihood ratio of a class against ordinary text; remembered by trigram."""

    def __init__(self, toxic: KneserNey, ordinary: KneserNey):
        self.toxic, self.ordinary = toxic, ordinary
        outer = self

        class Known(dict):
            def __missing__(self, k):
                if len(self) > 2_000_000:
                    self.clear()
                r = math.log(outer.toxic.p(*k) / outer.ordinary.p(*k))
                _, v, w = k
                t = outer.toxic
                if r > 0 and ((w,) not in t.uni or w == "</s>" and (v, w) not in t.bi):
                    r = 0.0  # what the class has never shown is no evidence for it
                self[k] = r
                return r

        self.known = Known()

    def __getstate__(self):
        return self.toxic, self.ordinary

    def __setstate__(self, state):
        self.__init__(*state)

    def total(self, words: Iterable[str]) -> float:
        padded = ["<s>", "<s>", *words, "</s>"]
        return sum(map(self.known.__getitem__, zip(padded, padded[1:], padded[2:])))


class Model:
    """Reader and models, trained from documents with reviewers' verdicts."""

    def __init__(self, labelled: list[tuple[str | None, list[str]]]):
        plain = Reader({})
        raw = [plain.passages(t) for t, _ in labelled]
        words = Counter(w for ps in raw for p in ps for w in p if "*" not in w and not _RUN3.search(w))
        self.reader = Reader(dict(words))
        read = [self.reader.passages(t) for t, _ in labelled]
        share = [sum(v in CLASSES for v in vs) / max(1, len(vs)) for _, vs in labelled]
        # Words that say something: the frequent ones, and those rather found in documents with a verdict. All
        # others, above all names, are one word.
        pos = Counter(w for ps, x in zip(read, share) if x >= 0.5 for w in {w for p in ps for w in p})
        neg = Counter(w for ps, x in zip(read, share) if x < 0.5 for w in {w for p in ps for w in p})
        n_pos, n_neg = sum(x >= 0.5 for x in share) + 1, sum(x < 0.5 for x in share) + 1
        frequent = [w for w, _ in sorted((pos + neg).items(), key=lambda k: (-k[1], k[0]))[:FREQUENT]]
        telling = [w for w in pos if pos[w] >= SUPPORT and (pos[w] - 0.5) / n_pos >= 1.3 * (neg[w] + 0.5) / n_neg]
        self.words = {w: w for w in [*frequent, *telling]}
        # Equal passages are counted once, by fold of the document: [weight with verdict, number without, by class].
        table: list[dict[tuple, list]] = [defaultdict(lambda: [0.0, 0, Counter()]) for _ in range(FOLDS)]
        for i, (ps, x) in enumerate(zip(read, share)):
            bad = Counter(v for v in labelled[i][1] if v in CLASSES)
            for p in {self._mapped(p) for p in ps}:
                row = table[(i * 2654435761 >> 16) % FOLDS][p]  # a fold must not follow a pattern in the order
                if x >= 0.5:
                    row[0] += x
                    for c, n in bad.items():
                        row[2][c] += n / sum(bad.values())
                else:
                    row[1] += 1
        self.shared = SharedBackoff({p for t in table for p in t})
        seen: dict[tuple, list] = defaultdict(lambda: [0.0, 0])
        for t in table:
            for p, (with_verdict, without, _) in t.items():
                seen[p][0] += with_verdict
                seen[p][1] += without
        base = min(max((n_pos - 1) / max(1, n_pos + n_neg - 2), 0.02), 0.8)
        speaks_for, against = math.log(REVIEWED / base), math.log((1 - base) / (1 - REVIEWED))
        judged = {p: x[0] * speaks_for - x[1] * against for p, x in seen.items()}  # log odds by its documents' verdicts
        # Weak supervision: a verdict holds for a document, not for a passage. At first all passages of a document
        # with a verdict are toxic; then those that models of the other folds tell from ordinary ones. What looks
        # toxic without a verdict is left out of both sides, as is the rest of a document with one. A passage that
        # reviewers passed more often than not is not toxic, whatever it looks like.
        toxic = [set(t) for t in table]
        ordinary = [{p for p in t if judged[p] <= CLEAR} for t in table]
        for _ in range(ROUNDS):
            found = []
            for f, t in enumerate(table):
                ratio = self._fit(table, toxic, ordinary, [g for g in range(FOLDS) if g != f])
                found.append({p for p in t if len(p) >= LEAST_WORDS and (x := ratio.total(p)) >= TRAIN_TOTAL and x >= TRAIN_PER_WORD * len(p) and judged[p] >= 0})
            toxic, ordinary = found, [{p for p in t if p not in x and judged[p] <= CLEAR} for t, x in zip(table, found)]
        # Only the words of toxic passages can speak for the class; all others become one word.
        support = Counter()
        for f in range(FOLDS):
            for p in toxic[f]:
                for w in set(p):
                    support[w] += table[f][p][0]
        self.words = {w: w for w, n in support.items() if n >= SUPPORT - 0.5 and w != OTHER}
        yes, no, by_class = Counter(), Counter(), {c: Counter() for c in CLASSES}
        for f, t in enumerate(table):
            for p, (with_verdict, without, classes) in t.items():
                k = self._mapped(p)
                if p in toxic[f]:
                    yes[k] += with_verdict
                    for c, n in classes.items():
                        by_class[c][k] += n
                elif p in ordinary[f]:
                    no[k] += without
        self.shared = SharedBackoff({*yes, *no})
        ordinary_model = KneserNey(((p, float(n)) for p, n in sorted(no.items()) if n), self.shared)
        self.ratio = Ratio(KneserNey(((p, n) for p, n in sorted(yes.items()) if n), self.shared), ordinary_model)
        self.by_class = {c: Ratio(KneserNey(sorted(k.items()), self.shared), ordinary_model) for c, k in by_class.items()}

    def _mapped(self, passage: list[str]) -> tuple:
        get = self.words.get
        return tuple([get(w, OTHER) for w in passage])

    def _fit(self, table, toxic, ordinary, folds) -> Ratio:
        yes = KneserNey(((p, table[f][p][0]) for f in folds for p in toxic[f] if table[f][p][0]), self.shared)
        no = KneserNey(((p, float(table[f][p][1])) for f in folds for p in ordinary[f] if table[f][p][1]), self.shared)
        return Ratio(yes, no)

    @staticmethod
    def is_toxic(total: float, words: int) -> bool:
        return words >= LEAST_WORDS and total >= TOTAL and total >= (PER_WORD if words >= FEW_WORDS else PER_FEW) * words

    def score(self, text: str | None, remember: dict) -> tuple[float, list[tuple[int, float, float, float]]]:
        """Highest ratio per word of a passage, and of each different toxic passage its key and its ratio per word by class."""
        best, found = -99.0, {}
        for p in self.reader.passages(text):
            if len(p) < LEAST_WORDS:
                continue
            k = self._mapped(p)
            t = remember.get(k)
            if t is None:
                if len(remember) > 500_000:
                    remember.clear()
                t = remember[k] = self.ratio.total(k)
            best = max(best, t / len(p))
            if k not in found and self.is_toxic(t, len(p)):
                key = int.from_bytes(hashlib.blake2b(" ".join(k).encode(), digest_size=8).digest(), "big", signed=True)
                found[k] = (key, *[self.by_class[c].total(k) / len(p) for c in CLASSES])
        return best, list(found.values())


def train(docs: DataFrame, doc: str, text: str, labels: DataFrame, label_doc: str, verdict: str, max_labelled: int = MAX_LABELLED, max_characters: int = MAX_CHARACTERS) -> Model:
    """Model from at most ``max_labelled`` labelled documents (bounded sample by hash of the id); null verdicts are none.

    Texts are taken whole while their sum is within ``max_characters``.
    """
    v = labels.where(F.col(verdict).isNotNull() & F.col(label_doc).isNotNull()).groupBy(F.col(label_doc).alias("doc")).agg(F.sort_array(F.collect_list(F.lower(F.trim(F.col(verdict))))).alias("v"))
    v = v.orderBy(F.xxhash64("doc"), "doc").limit(max_labelled)  # bounded, so it may be broadcast
    d = docs.select(F.col(doc).alias("doc"), F.col(text).alias("text"))
    d = d.join(F.broadcast(v), "doc").groupBy("doc").agg(F.min("text").alias("text"), F.min("v").alias("v"))
    order = Window.orderBy(F.xxhash64("doc"), "doc")  # over the bounded sample
    d = d.withColumn("sum", F.sum(F.coalesce(F.length("text"), F.lit(0)).cast("long")).over(order)).where(F.col("sum") <= max_characters)
    return Model([(r["text"], list(r["v"])) for r in d.orderBy("doc").select("text", "v").collect()])


def passages(docs: DataFrame, doc: str, text: str, source: str, model: Model) -> DataFrame:
    """(doc, source, score, found): the highest length-normalised ratio of a passage of each row of ``docs`` and its
    different toxic passages as (key, abuse, hate, sexual)."""
    shared = docs.sparkSession.sparkContext.broadcast(cloudpickle.dumps(model))  # by value: workers need no copy of the package
    types = dict(docs.dtypes)

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, remember = pickle.loads(shared.value), {}
        for p in pdfs:
            out = [m.score(t, remember) for t in p["text"]]
            found = [[dict(zip(("key", *CLASSES), x)) for x in f] for _, f in out]
            yield pd.DataFrame({"doc": p["doc"], "source": p["source"], "score": [s if s > -99 else None for s, _ in out], "found": found})

    cols = docs.select(F.col(doc).alias("doc"), F.col(source).alias("source"), F.col(text).alias("text"))
    each = ", ".join(f"{c}: double" for c in CLASSES)
    return cols.mapInPandas(run, f"doc {types[doc]}, source string, score double, found array<struct<key: bigint, {each}>>")


def refuted(found: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(key): toxic-looking passages that the reviewers' choice of documents speaks against.

    ``found``: (doc, found); ``verdicts``: (doc, share), the share of verdicts of a class among a document's. Reviewers look at
    documents with toxic passages at another rate than at others. Both rates are measured, over all documents; a passage
    whose documents were picked and judged as ordinary ones are, with odds of at least e**REFUTED, is none. A passage
    that stands in few documents can't be refuted.
    """
    seen = found.groupBy("doc").agg(F.max(F.size("found")).alias("k"), F.flatten(F.collect_list("found")).alias("found")).join(verdicts, "doc", "left")
    free = seen.where("k = 0").agg(F.count(F.lit(1)).alias("n"), F.count("share").alias("l")).first()
    keys = seen.where("k > 0").select("doc", "share", F.explode(F.array_distinct(F.transform("found", lambda x: x["key"]))).alias("key"))
    per = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("share") >= 0.5).alias("m"), F.count_if(F.col("share") < 0.5).alias("l"))
    sure = per.where("m >= 2 and m > l").agg(F.sum("n").alias("n"), F.sum(F.col("m") + F.col("l")).alias("l")).first()
    toxic, plain = (((x["l"] or 0) + 0.5) / ((x["n"] or 0) + 1) for x in (sure, free))
    toxic, plain = min(toxic if sure["n"] else plain, 0.99), min(plain, 0.99)  # no sure passage: nothing to tell them apart
    odds = F.col("m") * math.log(toxic * 0.9 / (plain * 0.1)) + F.col("l") * math.log(toxic * 0.1 / (plain * 0.9)) + (F.col("n") - F.col("m") - F.col("l")) * math.log((1 - toxic) / (1 - plain))
    return per.where(odds < -REFUTED).select("key")


def scores(docs: DataFrame, doc: str, text: str, source: str, model: Model, verdicts: DataFrame | None = None) -> DataFrame:
    """(doc, source, score, passages, abuse, hate, sexual, flagged): one row per row of ``docs``.

    score is the highest length-normalised log-likelihood ratio (toxic against ordinary, per word) of a passage of
    at least three words; null if there is none, as in empty and null texts. flagged: at least one toxic passage that
    ``verdicts`` (doc, share), if given, do not refute. The model is as large as the labelled sample and goes to the workers
    as a broadcast variable.
    """
    p = passages(docs, doc, text, source, model)
    if verdicts is not None:
        p = durable(p)
        gone = refuted(p, verdicts).agg(F.collect_list("key").alias("gone"))  # frequent passages with few verdicts: one row
        p = p.join(F.broadcast(gone)).withColumn("found", F.filter("found", lambda x: ~F.array_contains("gone", x["key"]))).drop("gone")

    def worst(c: str):
        return F.coalesce(F.greatest(F.array_max(F.transform("found", lambda x: x[c])), F.lit(0.0)), F.lit(0.0)).alias(c)

    return p.select("doc", "source", "score", F.size("found").alias("passages"), *[worst(c) for c in CLASSES], (F.size("found") > 0).alias("flagged"))


def verdict_shares(labels: DataFrame, label_doc: str, verdict: str) -> DataFrame:
    """(doc, share): of a document's readable verdicts, the share that names a class."""
    v = labels.where(F.col(verdict).isNotNull() & F.col(label_doc).isNotNull())
    return v.groupBy(F.col(label_doc).alias("doc")).agg(F.avg(F.lower(F.trim(F.col(verdict))).isin(*CLASSES).cast("int")).alias("share"))
