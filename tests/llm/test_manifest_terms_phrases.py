"""Manifest, toxicity and collocations against brute force, held-out labels and odd rows."""

import re
import zlib
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from compare import compare, connect
from tillscope.llm import automata, collocations, manifest, toxicity
from tillscope.llm.common import read
from tillscope.llm.queries import ORACLE_SQL, QUERIES

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("name", ["op11_merkle_manifest", "op13_automata_collocations"])
def test_rows_are_those_of_the_sql(spark, name):
    assert compare(QUERIES[name](spark, MIDDLE), connect(MIDDLE), ORACLE_SQL[name]) == []


# manifest


def digest(text):
    return sha256(text.encode()).hexdigest()


def slow_manifest(rows):
    def field(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    def leaf(r, n):
        return digest(field(r[0]) + field(r[3]) + field(r[2]) + field(n) + field(r[1]))

    def tree(nodes):
        levels = [nodes]
        while len(nodes) > 1:
            nodes = [digest("".join(nodes[i : i + 2])) for i in range(0, len(nodes), 2)]
            levels.append(nodes)
        return levels

    def way(levels, i):
        for nodes in levels[:-1]:
            yield i & 1, nodes[i ^ 1] if (i ^ 1) < len(nodes) else ""
            i >>= 1

    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r, leaf(r, r[4])))
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    for lang in langs:
        groups[lang].sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
    trees = {lang: tree([h for _, h in groups[lang]]) for lang in langs}
    top = tree([trees[lang][-1][0] for lang in langs])
    made = []
    for k, lang in enumerate(langs):
        for i, (r, h) in enumerate(groups[lang]):
            steps = [*way(trees[lang], i), *way(top, k)]
            hit = r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            node = leaf(r, r[4] + 1) if hit else h
            for right, other in steps:
                node = digest(other + node if right else node + other)
            root = top[-1][0]
            made.append((r[0], h, trees[lang][-1][0], root, digest("".join(s for _, s in steps)), node, node == root))
    return sorted(made, key=repr)


ODD = [
    (1, "a", "en", "s", 1),
    (1, "a", "en", "s", 1),
    (1, "b", "en", None, 1),
    (None, "x", "en", "s", None),
    (None, "x", "en", "s", None),
    (None, None, None, None, None),
    (-5, "ÿ y", "en", "s", 3),
    (2**62, None, "en", "s", 4),
    (-(2**63), "least", "en", "s", 4),
    (63, "last bit", "en", "s", 4),
    (7, "", "", "s", 0),
    (8, "q" * 500_000, None, "s", 500_000),
    (9, "lone", "zz", "s", 4),
]


@pytest.mark.parametrize("levels", [2, 10])
def test_manifest_of_odd_rows(spark, monkeypatch, levels):
    monkeypatch.setattr(manifest, "LEVELS", levels)
    rows = ODD + [(i * 37 % 1000 + 10, f"t{i}", "fr", "s", i) for i in range(30)] + [(70, "z", "de", "s", i % 3) for i in range(40)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("at", F.lit("x")).withColumn("grp", F.lit(1)).withColumn("leaf", F.lit(2))
    assert sorted((tuple(r) for r in manifest.manifest(docs).collect()), key=repr) == slow_manifest(rows)


def test_ranks_of_scattered_ids(spark):
    rng = np.random.default_rng(1)
    ids = sorted({*rng.integers(-(2**63), 2**63 - 1, 300).tolist(), *rng.integers(0, 2000, 300).tolist(), *(2**40 + rng.integers(0, 70, 40)).tolist()})
    rows = spark.createDataFrame([("=g", i, f"{i}") for i in rng.permutation(ids).tolist()], "grp string, doc_id long, leaf string")
    got = {r["doc_id"]: r["at"] for r in manifest.coordinates(rows).collect()}
    assert got == {i: n for n, i in enumerate(ids)}


def test_manifest_of_nothing_and_of_one(spark):
    assert manifest.manifest(spark.createDataFrame([], SCHEMA)).collect() == []
    one = [(3, "text", "en", "s", 4)]
    assert [tuple(r) for r in manifest.manifest(spark.createDataFrame(one, SCHEMA)).collect()] == slow_manifest(one)


def test_tampering_is_found(spark):
    rows = manifest.manifest(read(spark, SMALL, "documents")).collect()
    for r in rows:
        assert r["verified"] == (zlib.crc32(str(r["doc_id"]).encode()) % 7 != 0)


# toxicity


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def slow_match(terms, word):
    best = None
    for number, (term, stem) in enumerate(terms):
        if stem and len(word) <= len(term):
            continue
        wrong = min(distance(term, word[:i]) for i in range(len(word) + 1)) if stem else distance(term, word)
        if wrong <= toxicity.edits(term, stem):
            rank = (wrong, stem, number)
            best = rank if best is None else min(best, rank)
    return best and (best[2], best[0])


TERMS = [("abcab", False), ("abca", False), ("bcabcabca", False), ("cabab", True), ("aabb", True), ("acbacb", True), ("ccccccccc", False)]
MATCHER = toxicity.Matcher(TERMS)


@settings(max_examples=400, deadline=None)
@given(st.text("abc", min_size=3, max_size=12))
def test_automata_find_what_edit_distance_finds(word):
    assert MATCHER.match(word) == slow_match(TERMS, word)


def test_forgetting_states_changes_nothing(monkeypatch):
    monkeypatch.setattr(toxicity, "_STATES", 5)
    monkeypatch.setattr(toxicity, "_KNOWN", 3)
    small = toxicity.Matcher(TERMS)
    rng = np.random.default_rng(5)
    for word in ("".join(rng.choice(list("abc"), rng.integers(3, 11))) for _ in range(300)):
        assert small.match(word) == slow_match(TERMS, word)


def test_quotation_counts_less_than_abuse():
    model = toxicity.Model([("idiot", False), ("worthless", False)], [5.0, 5.0], {}, {}, [-4.0, 1.0, 0.5, 1.0])
    matcher = toxicity.Matcher(model.terms)
    of = lambda text: sum(h["weight"] for h in model.hits(text, matcher))
    assert of("you are an idiot and so on") > of("here an idiot stands and so on") > of("he said idiot to them and left")
    assert of('the sign "what an idiot" hung there') < of("the sign what an idiot hung there")
    assert of("an id1ot and a wortless one") == pytest.approx(2 * 5.0 * toxicity.WRONG)
    assert [h["term"] for h in model.hits("IDIOT! (worthles)", matcher)] == ["idiot", "worthless"]
    assert model.hits("", matcher) == model.hits(None, matcher) == []


def test_toxicity_of_held_out_documents(spark):
    folder = "/root/testdata/sf0.1"
    got = {r["doc_id"]: r for r in QUERIES["op12_levenshtein_toxicity"](spark, folder).collect()}
    labels = {r["doc_id"]: r["toxic"] for r in read(spark, folder, "labels").collect()}
    out = [i for i in labels if got[i]["held_out"]]
    bad = [i for i in out if labels[i] == 1]
    assert np.mean([got[i]["predicted"] for i in bad]) > 0.9
    assert np.mean([got[i]["predicted"] for i in out if labels[i] == 0]) < 0.005
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got.values())


def test_toxicity_of_odd_rows(spark):
    texts = [None, "", " \n ", "you utter blockhead " * 3, "a fine day " * 3, "blockhead " * 200_000, "you utter blockhead " * 3]
    docs = spark.createDataFrame([(i, t, "w") for i, t in enumerate(texts)] + [(None, "no id", "w"), (3, texts[3], "w")], "doc_id long, text string, word string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(7)] + [(None, 1), (2, None), (3, 1)], "doc_id long, toxic int")
    rows = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    assert len(rows) == 9
    by = {r["doc_id"]: r["score"] for r in rows}
    assert by[0] == by[1] == by[2]
    empty = toxicity.fit(docs.limit(0), labels)
    assert empty.terms == [] and toxicity.score(docs.limit(0), empty).collect() == [] and toxicity.hits(docs, empty).collect() == []


def test_hits_name_their_places(spark):
    model = toxicity.Model([("idiot", False)], [5.0])
    docs = spark.createDataFrame([(1, "an idi0t here"), (1, "an idi0t here"), (None, "idiot"), (2, None)], "doc_id long, text string")
    got = sorted(((str(r["doc_id"]), r["at"], r["word"], r["term"], r["wrong"]) for r in toxicity.hits(docs, model).collect()))
    assert got == [("1", 1, "idi0t", "idiot", 1), ("1", 1, "idi0t", "idiot", 1), ("None", 0, "idiot", "idiot", 0)]


# collocations

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def slow_collocations(rows, least, top):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            words = [w for w in re.split("[ \t]+", piece) if w]
            n[lang] += len(words)
            for k in range(1, 6):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    found = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= least}
    inside = {(lang, p[i : i + k]) for (lang, p), a in found.items() for k in range(2, len(p)) for i in range(len(p) - k + 1) if a >= found[lang, p[i : i + k]]}
    made = {}
    for (lang, p), a in found.items():
        if (lang, p) not in inside:
            cuts = [(1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            made.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, x, y, n[lang], -s) for lang, v in made.items() for i, (s, a, p, x, y) in enumerate(sorted(v)[:top]))


@pytest.mark.parametrize("block,size,top", [(20_000, 3000, 2000), (3000, 150, 7)])
def test_phrases_of_many_shards_and_ranges(spark, monkeypatch, block, size, top):
    monkeypatch.setattr(collocations, "_SLICE", 500)
    docs = read(spark, SMALL, "documents")
    got = collocations.collocations(docs, 8, top, block, size).collect()
    assert sorted(tuple(r) for r in got) == slow_collocations([(r["text"], r["lang"]) for r in docs.collect()], 8, top)


def test_phrases_of_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(collocations, "_SLICE", 64)
    rows = [("one Two three. four\tfive one two three", "en")] * 5 + [(None, "en"), ("", None), ("x y\x0bz y", None), ("a a a a a a a", None), ("a" * 10_000 + " b", "und"), ("one two three " * 3000, "en"), ("é É é É\xa0é É", "und"), ("A a.A", "und")]
    docs = spark.createDataFrame([(t, lang, i, "w", 2) for i, (t, lang) in enumerate(rows)], "text string, lang string, doc_id long, word string, block int")
    for block in (50, 10_000):
        got = collocations.collocations(docs, 2, 2000, block, 20).collect()
        assert sorted(tuple(r) for r in got) == slow_collocations(rows, 2, 2000)
    assert collocations.collocations(docs.limit(0)).collect() == []
    assert collocations.collocations(docs, 10**6).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 4), st.integers(0, 4), st.integers(0, 4)), min_size=1, max_size=60))
def test_automata_hold_their_paths(rows):
    paths, weights = automata.summed(np.array(rows, np.int64) * 10**10, np.arange(1, len(rows) + 1))
    made = automata.Automaton.load(automata.Automaton.of(paths, weights).dump())
    held, counts = made.paths()
    assert (held == paths).all() and (counts == weights).all()
    assert (made.look_up(paths) == weights).all()
    missing = np.array([[5 * 10**10, 0, 0], [7, 7, 7]])
    assert not made.look_up(missing).any()
    twice, sums = automata.united([made, made])
    assert (twice == paths).all() and (sums == 2 * weights).all()


def test_equal_states_are_shared():
    rows = np.array([[a, b, 7] for a in range(50) for b in range(20)])
    made = automata.Automaton.of(rows, np.ones(len(rows), np.int64))
    assert [len(counts) for counts, _, _ in made.layers] == [1, 1, 1]


def test_products_may_pass_64_bits(spark):
    # 1000 a n is about 10 to the 23 here
    cut = spark.createDataFrame([(10**10, 10**10, 3, 7)], "a long, n long, l long, r long")
    exact = lambda c: F.col(c).cast("decimal(38,0)")
    made = cut.withColumn("top", F.lit(1000).cast("decimal(38,0)") * exact("a") * exact("n")).withColumn("low", exact("l") * exact("r") * F.lit(10**6))
    assert made.select(F.expr("top div low")).first()[0] == 1000 * 10**20 // (21 * 10**6)
