"""Toxicity from misspelled terms: Levenshtein automata walked through a lexicon trie, hits judged in their context."""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillscope.llm.common import by_batch, held_out
from tillscope.session import stage

#: Rows of each class that are fitted on, and the terms and spellings that are learned at most.
PER_CLASS, TERMS, SPELLINGS = 4000, 400, 5000
#: Letters of the shortest and longest word or stem that may become a term.
SHORTEST, LONGEST, STEM = 4, 24, 10
#: Words on either side of a hit that are its context.
WINDOW = 6
#: What a hit counts in quotation, beside a word of report, and towards a person.
QUOTED, REPORTED, AIMED = 0.3, 0.5, 1.5
#: What a wrong letter leaves of a term's weight where the labels do not tell.
WRONG = 0.7
_STATES, _KNOWN = 100_000, 200_000

_TOKEN = re.compile(r"[^\s|]+")
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_OPENS, _CLOSES = "“«„‹", "”»›"
# Words that report what others said, and words for the person spoken to, in the languages of the texts.
_REPORT = frozenset(
    "said says say saying wrote writes called calls quote quoted quotes term word words slur phrase insult mentions reported according "
    "sagte sagt schrieb nannte genannt zitat wort begriff dit disait écrit appelé terme mot citation dijo dice escribió llamó palabra término cita".split()
)
_PERSON = frozenset("you your you're youre yours u ur yourself du dich dir dein deine ihr euch tu toi te ton ta vous votre tú ti tus usted ustedes eres vosotros".split())


def words_of(text: str) -> list[tuple[str, str]]:
    """The words of a text as written, and in small letters without signs around them."""
    return [(w, _EDGE.sub("", w.lower())) for w in _TOKEN.findall(text)]


def edits(term: str, stem: bool) -> int:
    """Wrong letters that a term admits: none in short ones, two in long words."""
    return 0 if len(term) < 5 else 1 if len(term) < 9 or stem else 2


class Matcher:
    """The terms as a trie, and their Levenshtein automata as one automaton over it.

    A state is a set of (trie node, wrong letters so far), a letter leads to the set after
    matching, replacing, leaving out or adding a letter. States and arrows are made when a word
    first needs them and forgotten when there are too many, so nothing is cut off.
    """

    def __init__(self, terms: list[tuple[str, bool]]):
        self.terms = terms
        self.next: list[dict[str, int]] = [{}]
        self.ends: list[tuple[int, ...]] = [()]
        self.most = [0]
        for number, (term, stem) in enumerate(terms):
            node = 0
            for letter in term:
                self.most[node] = max(self.most[node], edits(term, stem))
                if letter not in self.next[node]:
                    self.next[node][letter] = len(self.next)
                    self.next.append({})
                    self.ends.append(())
                    self.most.append(0)
                node = self.next[node][letter]
            self.ends[node] += (number,)
            self.most[node] = max(self.most[node], edits(term, stem))
        self._forget()

    def _forget(self) -> None:
        self.numbers: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.arrows: list[dict[str, int]] = []
        self.start = self._state(self._closed({(0, 0)}))
        self.words: dict[str, tuple[int, int] | None] = {}

    def _closed(self, items: set) -> frozenset:
        """With the states reached by letters of a term that the word lacks; a stem once met stays met."""
        todo, made = list(items), set(items)
        while todo:
            node, wrong = todo.pop()
            if node >= 0 and wrong < self.most[node]:
                for child in self.next[node].values():
                    if (child, wrong + 1) not in made:
                        made.add((child, wrong + 1))
                        todo.append((child, wrong + 1))
        for node, wrong in list(made):
            if node >= 0:
                for number in self.ends[node]:
                    if self.terms[number][1] and wrong <= edits(*self.terms[number]):
                        made.add((-1 - number, wrong))
        # of one node only the fewest wrong letters matter
        least: dict[int, int] = {}
        for node, wrong in made:
            least[node] = min(wrong, least.get(node, wrong))
        return frozenset(least.items())

    def _state(self, items: frozenset) -> int:
        number = self.numbers.setdefault(items, len(self.sets))
        if number == len(self.sets):
            self.sets.append(items)
            self.arrows.append({})
        return number

    def _step(self, state: int, letter: str) -> int:
        after = set()
        for node, wrong in self.sets[state]:
            if node < 0:
                after.add((node, wrong))
                continue
            same = self.next[node].get(letter)
            if same is not None:
                after.add((same, wrong))
            if wrong < self.most[node]:
                after.add((node, wrong + 1))
                after.update((child, wrong + 1) for child in self.next[node].values())
        made = self._state(self._closed(after))
        self.arrows[state][letter] = made
        return made

    def _walk(self, word: str) -> tuple[int, int] | None:
        state = self.start
        for letter in word:
            after = self.arrows[state].get(letter)
            state = self._step(state, letter) if after is None else after
            if not self.sets[state]:
                return None
        best = None
        for node, wrong in self.sets[state]:
            for number in (-1 - node,) if node < 0 else self.ends[node]:
                term, stem = self.terms[number]
                # a stem needs something after it, a word of its own does not
                if wrong <= edits(term, stem) and (node < 0 or not stem) and (not stem or len(word) > len(term)):
                    rank = (wrong, stem, number)
                    best = rank if best is None else min(best, rank)
        return best and (best[2], best[0])

    def match(self, word: str) -> tuple[int, int] | None:
        """The term a word spells, and how many letters are wrong: the nearest, whole words before stems."""
        try:
            return self.words[word]
        except KeyError:
            pass
        if len(self.sets) > _STATES or len(self.words) > _KNOWN:
            self._forget()
        found = self.words[word] = self._walk(word) if len(word) >= SHORTEST - 1 else None
        return found


def context(words: list[tuple[str, str]], at: int, inside: bool) -> float:
    """What a hit counts where it stands: less in quotation or report, more towards a person."""
    near = {w for _, w in words[max(0, at - WINDOW) : at + WINDOW + 1]}
    made = 1.0
    if inside:
        made *= QUOTED
    if near & _REPORT:
        made *= REPORTED
    if made == 1.0 and near & _PERSON:
        made *= AIMED
    return made


def _quotes(words: list[tuple[str, str]]) -> list[bool]:
    """Whether a word stands in quotation: between marks that open and close within 40 words."""
    inside = [False] * len(words)
    opened = None
    for i, (raw, _) in enumerate(words):
        opens = raw[0] in '"' + _OPENS or (raw[0] == "'" and len(raw) > 1)
        end = raw.rstrip(".,;:!?)")
        closes = len(end) > 1 and (end[-1] in '"' + _CLOSES or (end[-1] == "'"))
        if opens and opened is None:
            opened = i
        if closes and opened is not None:
            if i - opened < 40:
                inside[opened : i + 1] = [True] * (i + 1 - opened)
            opened = None
        elif opened is not None and i - opened >= 40:
            opened = i if opens else None
    return inside


@dataclass
class Model:
    """A lexicon with weights, weights of spellings that labels speak about, and a logistic layer."""

    terms: list[tuple[str, bool]] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    #: what a spelling with so many wrong letters keeps of the weight of its word or stem
    faults: dict[tuple[bool, int], float] = field(default_factory=dict)
    spellings: dict[str, float] = field(default_factory=dict)
    layer: list[float] = field(default_factory=lambda: [-3.0, 0.0, 0.0, 0.0])

    def hits(self, text: str | None, matcher: Matcher) -> list[dict]:
        """Every term met, in order: its word number, the word, the term, wrong letters and its weight in context."""
        words = words_of(text or "")
        met = [(i, found) for i, (_, w) in enumerate(words) if (found := matcher.match(w))]
        if not met:
            return []
        inside = _quotes(words)
        made = []
        for i, (number, wrong) in met:
            weight = self.weights[number] * (self.faults.get((self.terms[number][1], wrong), WRONG**wrong) if wrong else 1.0)
            word = words[i][1]
            if word in self.spellings:
                weight = self.spellings[word]
            if weight > 0:
                made.append({"at": i, "word": word, "term": self.terms[number][0], "wrong": wrong, "weight": weight * context(words, i, inside[i])})
        return made

    def features(self, text: str | None, matcher: Matcher) -> list[float]:
        """Of a whole text: the weight of its hits, the heaviest window, and the weight a hundred words, each as a logarithm."""
        made = self.hits(text, matcher)
        if not made:
            return [0.0, 0.0, 0.0]
        total = sum(h["weight"] for h in made)
        heaviest = held = 0.0
        first = 0
        for h in made:
            held += h["weight"]
            while h["at"] - made[first]["at"] > 2 * WINDOW:
                held -= made[first]["weight"]
                first += 1
            heaviest = max(heaviest, held)
        return [math.log1p(total), math.log1p(heaviest), math.log1p(100 * total / max(20, len(_TOKEN.findall(text or ""))))]

    def score(self, text: str | None, matcher: Matcher) -> float:
        z = self.layer[0] + sum(a * b for a, b in zip(self.layer[1:], self.features(text, matcher)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 40) -> list[float]:
    """Weights of a logistic layer by Newton's method, none of a feature below 0."""
    x = np.column_stack([np.ones(len(x)), x])
    kept = np.ones(x.shape[1], bool)
    w = np.zeros(x.shape[1])
    for _ in range(x.shape[1]):
        w = np.zeros(x.shape[1])
        part = x[:, kept]
        v = np.zeros(kept.sum())
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(part @ v, -30, 30)))
            slope = part.T @ (p - y) + ridge * v
            bend = (part.T * (p * (1 - p))) @ part + ridge * np.eye(len(v))
            v -= np.linalg.solve(bend, slope)
        w[kept] = v
        low = kept & (w < 0)
        low[0] = False
        if not low.any():
            break
        kept &= ~low
    return w.tolist()


def _log_odds(pos: float, neg: float, n_pos: int, n_neg: int) -> float:
    return math.log((pos + 0.5) / (n_pos + 1)) - math.log((neg + 0.5) / (n_neg + 1))


def _gain(pos: int, neg: int, n_pos: int, n_neg: int) -> float:
    """Twice the log-likelihood ratio of a term and the label being bound to each other."""

    def part(seen: float, expected: float) -> float:
        return seen * math.log(seen / expected) if seen else 0.0

    n, met = n_pos + n_neg, pos + neg
    table = [(pos, met * n_pos / n), (neg, met * n_neg / n), (n_pos - pos, (n - met) * n_pos / n), (n_neg - neg, (n - met) * n_neg / n)]
    return 2 * sum(part(a, b) for a, b in table)


def choose(rows: list[tuple[str, bool, int, int]], n_pos: int, n_neg: int, most: int = TERMS) -> list[tuple[str, bool, float]]:
    """The terms, strongest first: (term, stem, weight). A word or stem that holds a chosen one, or is held by one, is left out."""
    ranked = sorted(rows, key=lambda r: (-_gain(r[2], r[3], n_pos, n_neg), r[1], -len(r[0]), r[0]))
    made: list[tuple[str, bool, float]] = []
    prefixes: set[str] = set()
    whole: set[str] = set()
    for term, stem, pos, neg in ranked:
        if len(made) == most:
            break
        if term in prefixes or any(term[:i] in whole for i in range(SHORTEST, len(term) + 1)):
            continue
        made.append((term, stem, _log_odds(pos, neg, n_pos, n_neg)))
        prefixes.update(term[:i] for i in range(1, len(term) + 1))
        whole.add(term)
    return made


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """A model from the labelled rows whose id is outside the held-out third.

    About ``per_class`` rows of each class are used, drawn by a hash of id and text among the
    distinct ones, so copies and repeated rows count once. Words and stems that a label is bound
    to become terms; spellings of them that good documents use get the weight of their own
    counts. Without labels of both classes there are no terms and every score is low.
    """
    usable = labels.select(F.col("doc_id").alias("of"), F.col("toxic").cast("int").alias("y")).where("doc_id is not null and toxic in (0, 1)")
    usable = usable.where(~held_out(F.col("of"))).groupBy("of").agg(F.max("y").alias("y"))
    texts = docs.select("doc_id", "text").where("text is not null").withColumn("h", F.xxhash64("text"))
    distinct = texts.select("doc_id", "h").join(usable, F.col("doc_id") == F.col("of")).groupBy("h").agg(F.max(F.struct("y", "doc_id")).alias("m"))
    distinct = stage(distinct.select("m.*", "h"), "toxic-labelled")
    sizes = {r["y"]: r["count"] for r in distinct.groupBy("y").count().collect()}
    if len(sizes) < 2:
        return Model()
    cut = F.when(F.col("y") == 1, F.lit(int(min(1.0, per_class / sizes[1]) * (1 << 30)))).otherwise(F.lit(int(min(1.0, per_class / sizes[0]) * (1 << 30))))
    drawn = stage(distinct.where(F.pmod(F.xxhash64("h"), F.lit(1 << 30)) < cut), "toxic-drawn")
    sample = stage(texts.join(drawn, ["doc_id", "h"]).dropDuplicates(["h"]).select("y", "text"), "toxic-sample")
    n_neg, n_pos = (sample.where(F.col("y") == v).count() for v in (0, 1))
    if not n_pos or not n_neg:
        return Model()

    def make_terms():
        def work(batch):
            seen = [Counter(), Counter()]
            for text, y in zip(batch.column("text"), batch.column("y").to_pylist()):
                words = {w for _, w in words_of(text.as_py()) if SHORTEST <= len(w) <= LONGEST}
                stems = {w[:i] for w in words for i in range(SHORTEST, min(STEM, len(w) - 1) + 1)}
                seen[y].update([(w, False) for w in words] + [(s, True) for s in stems])
            keys = list(seen[0].keys() | seen[1].keys())
            return {"term": [k[0] for k in keys], "stem": [k[1] for k in keys], "pos": [seen[1][k] for k in keys], "neg": [seen[0][k] for k in keys]}

        return work

    counted = by_batch(sample, make_terms, "term string, stem boolean, pos long, neg long").groupBy("term", "stem").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    least = max(3, math.ceil(n_pos / 100))
    share = (F.col("pos") / n_pos) / ((F.col("neg") + 0.5) / n_neg)
    found = counted.where((F.col("pos") >= least) & (share >= 4.0)).orderBy(F.desc(F.col("pos") - F.col("neg") * (n_pos / n_neg)), "term", "stem").limit(20 * TERMS)
    rows = [(r["term"], r["stem"], r["pos"], r["neg"]) for r in found.collect() if _gain(r["pos"], r["neg"], n_pos, n_neg) >= 20]
    chosen = choose(rows, n_pos, n_neg)
    model = Model([(t, s) for t, s, _ in chosen], [w for _, _, w in chosen])

    def make_spellings():
        matcher = Matcher(model.terms)

        def work(batch):
            seen = [Counter(), Counter()]
            for text, y in zip(batch.column("text"), batch.column("y").to_pylist()):
                met = {w: hit for _, w in words_of(text.as_py()) if (hit := matcher.match(w)) and hit[1]}
                seen[y].update(met.keys())
                # no word has a space, so these stand for all spellings of a kind
                seen[y].update({f"{int(model.terms[number][1])} {wrong}" for number, wrong in met.values()})
            keys = list(seen[0].keys() | seen[1].keys())
            return {"word": keys, "pos": [seen[1][k] for k in keys], "neg": [seen[0][k] for k in keys]}

        return work

    spelled = stage(by_batch(sample, make_spellings, "word string, pos long, neg long").groupBy("word").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")), "spellings")
    kind = F.col("word").contains(" ")
    for r in spelled.where(kind).collect():
        stem, wrong = (int(v) for v in r["word"].split())
        own = [w for (_, s), w in zip(model.terms, model.weights) if s == bool(stem)]
        told = _log_odds(r["pos"], r["neg"], n_pos, n_neg) / (sum(own) / len(own))
        # a kind met in few documents says little, so it stays near the usual loss
        trust = (r["pos"] + r["neg"]) / (r["pos"] + r["neg"] + 5)
        model.faults[bool(stem), wrong] = trust * max(0.0, min(1.0, told)) + (1 - trust) * WRONG**wrong
    spelled = spelled.where(~kind & (F.col("neg") > 0)).orderBy(F.desc("neg"), "word").limit(SPELLINGS)
    model.spellings = {r["word"]: max(0.0, _log_odds(r["pos"], r["neg"], n_pos, n_neg)) for r in spelled.collect()}

    def make_features():
        matcher = Matcher(model.terms)

        def work(batch):
            made = [model.features(t.as_py(), matcher) for t in batch.column("text")]
            return {"y": batch.column("y"), "x": made}

        return work

    points = by_batch(sample, make_features, "y int, x array<double>").collect()
    points.sort(key=lambda r: (r["y"], r["x"]))
    # the sample holds the classes in other shares than the labels do
    weight = math.log((sizes[1] / n_pos) / (sizes[0] / n_neg))
    model.layer = _logistic(np.array([r["x"] for r in points], float), np.array([r["y"] for r in points], float))
    model.layer[0] += weight
    return model


def score(docs: DataFrame, model: Model, least: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted (1 at ``least`` or more) and n_hits of every row, from its whole text alone.

    A null or empty text has no hits. Repeated rows are scored each; an empty table gives an
    empty result.
    """

    def make():
        matcher = Matcher(model.terms)

        def work(batch):
            made = [model.score(t.as_py(), matcher) for t in batch.column("text")]
            return {"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "score": made, "predicted": [int(s >= least) for s in made]}

        return work

    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return by_batch(rows, make, f"doc_id {kind}, held_out boolean, score double, predicted int")


def hits(docs: DataFrame, model: Model) -> DataFrame:
    """Every hit of every document: doc_id, the word's number, the word, the term it spells, wrong letters, weight in context."""

    def make():
        matcher = Matcher(model.terms)

        def work(batch):
            of, made = [], []
            for i, text in enumerate(batch.column("text")):
                found = model.hits(text.as_py(), matcher)
                of += [i] * len(found)
                made += found
            return {"doc_id": batch.column("doc_id").take(pa.array(of, pa.int64()))} | {c: [h[c] for h in made] for c in ("at", "word", "term", "wrong", "weight")}

        return work

    kind = docs.schema["doc_id"].dataType.simpleString()
    return by_batch(docs.select("doc_id", "text"), make, f"doc_id {kind}, at long, word string, term string, wrong int, weight double")
