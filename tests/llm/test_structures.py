"""Packing, mixing, sharding, SimHash, Hamming search, pages and the pipeline against brute force."""

import zlib
from collections import Counter, defaultdict
from math import comb

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tillscope.llm import hamming_topk, html_extract, mixing, packing, sharding, simhash
from tillscope.llm.common import held_out, placed, read
from tillscope.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def docs(spark):
    return read(spark, FOLDER, "documents")


def test_placed_numbers_every_group_without_gaps(spark):
    rows = [(("a", "b", None)[i % 3] if i % 7 else "a", i, i % 5) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, k long, n int")
    by = defaultdict(list)
    for r in placed(df, ["g"], ["k"], "at", salts=8).collect():
        by[r["g"]].append(r["at"])
    assert set(by) == {"a", "b", None} and all(sorted(v) == list(range(len(v))) for v in by.values())
    spans = defaultdict(list)
    for r in placed(df, ["g"], ["k"], "at", salts=8, size="n").collect():
        spans[r["g"]].append((r["at"], r["n"]))
    for v in spans.values():
        end = 0
        for at, n in sorted(v):
            assert at == end
            end += n


# packing


@pytest.mark.parametrize("text", ["", "It's <|endoftext|> don't x''s", "Ünï—code №5 Σίσυφος İstanbul", "a\tb\x0bc d e", "!!!'ll ...&&& 12ab34", "é ́x ＡＢ ①", "año ÿŸ ŉa ×÷ ſS ßẞ à\xa0b ¿qué?", "___a_b <b>|<|x don't'S 'TIS", "e\u0301 İI ǅ ﬁ x\u2028y"])
def test_ids_are_those_of_the_whole_text(text):
    whole = Tokenizer.from_file(VOCABULARY).encode(text, add_special_tokens=False).ids
    assert np.frombuffer(packing.Ids(VOCABULARY).of(text), "<u4").tolist() == whole


def test_ids_after_forgetting(monkeypatch, docs):
    monkeypatch.setattr(packing, "WORDS", 70)
    monkeypatch.setattr(packing, "SLICE", 300)
    ids, tokenizer = packing.Ids(VOCABULARY), Tokenizer.from_file(VOCABULARY)
    for r in docs.limit(60).collect():
        assert np.frombuffer(ids.of(r["text"]), "<u4").tolist() == tokenizer.encode(r["text"], add_special_tokens=False).ids


def test_packing_holds_every_id_once(spark, docs):
    rows = QUERIES["op5_min_bin_slack"](spark, FOLDER).collect()
    tokenizer = Tokenizer.from_file(VOCABULARY)
    ids = {r["doc_id"]: np.array([*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4") for r in docs.collect()}
    seen, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        own = ids[r["doc_id"]]
        part = own[r["start"] : r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(part.tobytes()) and r["doc_tokens"] == len(own)
        seen[r["doc_id"]].append((r["start"], r["length"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, own in ids.items():
        end = 0
        for start, length in sorted(seen[i]):
            assert start == end
            end += length
        assert end == len(own)
    used = 0
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 4096
        used += end
    assert used / (4096 * len(sequences)) > 0.97


def test_fill_uses_each_piece_once_and_beats_first_fit():
    rng = np.random.default_rng(2)
    counts = Counter(rng.integers(1, 101, 3000).tolist())
    used = Counter()
    windows = 0
    for pattern, times in packing.fill(dict(counts), 100):
        assert sum(n * c for n, c in pattern.items()) <= 100 and times > 0
        for n, c in pattern.items():
            used[n] += c * times
        windows += times
    assert used == counts
    assert windows <= 1.01 * sum(n * c for n, c in counts.items()) / 100 + 1


def test_fill_reaches_the_closest_sum():
    assert packing.fill({60: 1, 30: 1, 25: 2, 11: 1}, 100)[0] == ({60: 1, 30: 1}, 1) or packing.fill({60: 1, 30: 1, 25: 2, 11: 1}, 100)[0][0] == {60: 1, 25: 1, 11: 1}
    first, _ = packing.fill({60: 1, 30: 1, 25: 2, 11: 1}, 100)[0]
    assert sum(n * c for n, c in first.items()) == 96


# mixing


def test_targets_reshare_the_excess():
    got = mixing.targets([10, 100, 1000], [5, 2, 1])
    assert got[0] == 20 and got[1] == 200 and abs(sum(got) - 1.5 * 1110) < 1e-9
    assert mixing.targets([0, 0], [5, 2]) == [0.0, 0.0] and mixing.targets([], []) == []


@pytest.mark.parametrize("size", [1, 2, 3, 17, 64, 1000])
def test_permutations(size):
    made = mixing.permuted(np.arange(size), size, 99)
    assert sorted(made.tolist()) == list(range(size))


def test_shard_counts_add_up_to_the_recipe():
    recipe = mixing.plan({"a": 900, "b": 400, None: 50}, (5, 2, 1), 1.5, 4, 32, 7)
    total, before = np.zeros(3, int), np.zeros(3, int)
    for shard in range(recipe.shards):
        counts, ahead = mixing.shard_counts(recipe, shard)
        assert (ahead == before).all() and counts.sum() == min(32, sum(recipe.places) - 32 * shard)
        before += counts
        total += counts
    assert total.tolist() == recipe.places


def test_mix_meets_its_targets(spark, docs):
    rows = QUERIES["op6_multinomial_mix"](spark, FOLDER).collect()
    again = QUERIES["op6_multinomial_mix"](spark, FOLDER).collect()
    assert sorted(rows) == sorted(again)
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    sizes, taken, target, told = Counter(), Counter(), {}, {}
    for r in rows:
        s = source[r["doc_id"]]
        sizes[s] += r["size"]
        taken[s] += r["taken"]
        target[s], told[s] = r["target"], r["source_size"]
        assert 0 <= r["taken"] <= 2 * r["size"]
    assert told == dict(sizes)
    names = sorted(sizes)
    want = mixing.targets([sizes[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))])
    for s, t in zip(names, want):
        assert target[s] == pytest.approx(t) and abs(taken[s] - t) <= 64


def _slow_permutation(size, key):
    """The Feistel permutation of 0 .. size - 1, number by number."""
    mask64 = (1 << 64) - 1
    half = max(1, (max(size - 1, 1).bit_length() + 1) // 2)
    keys = [(key * 0x9E3779B97F4A7C15 + r * 0xC2B2AE3D27D4EB4F) & mask64 for r in range(1, 5)]
    made = []
    for x in range(size):
        while True:
            left, right = x >> half, x & ((1 << half) - 1)
            for k in keys:
                mixed = (((right + k) & mask64) * 0xBF58476D1CE4E5B9) & mask64
                mixed ^= mixed >> 31
                mixed = (mixed * 0x94D049BB133111EB) & mask64
                left, right = right, left ^ (mixed >> 33) & ((1 << half) - 1)
            x = (left << half) | right
            if x < size:
                break
        made.append(x)
    return made


@pytest.mark.parametrize("good, bad, taken", [(5, 7, 6), (30, 2, 16), (1, 0, 1), (40, 60, 20)])
def test_the_draws_follow_the_hypergeometric_law(good, bad, taken):
    rng = np.random.default_rng(5)
    seen = Counter(mixing.hypergeometric(rng, good, bad, taken) for _ in range(20_000))
    for x in range(good + 1):
        ways = comb(good, x) * comb(bad, taken - x) if x <= taken else 0
        assert abs(seen[x] / 20_000 - ways / comb(good + bad, taken)) < 0.02


def test_the_law_holds_at_any_size():
    rng = np.random.default_rng(6)
    good, bad, taken = 3 * 10**11, 10**12, 10**11
    p, n = good / (good + bad), good + bad
    spread = (taken * p * (1 - p) * (n - taken) / (n - 1)) ** 0.5
    z = (np.array([mixing.hypergeometric(rng, good, bad, taken) for _ in range(4000)]) - taken * p) / spread
    assert abs(z.mean()) < 0.07 and abs(z.std() - 1) < 0.05 and abs((z**4).mean() - 3) < 0.5


def test_mix_by_brute_force(spark, docs):
    """The words that the recipe's places name, place by place, against what is taken of every document."""
    ahead, _, recipe = mixing.mix(docs, slots=64)
    counted = Counter()
    for s, (blocks, places) in enumerate(zip(recipe.blocks, recipe.places)):
        order = [_slow_permutation(blocks, recipe.seed + 2 * s + c) for c in range(2)]
        for rank in range(places):
            counted[s, order[rank // blocks][rank % blocks]] += 1
    want = {}
    ends = defaultdict(int)
    for r in sorted(ahead.collect(), key=lambda r: (r["source_no"], r["start"])):
        s = r["source_no"]
        assert r["start"] == ends[s]
        ends[s] += r["size"]
        want[r["doc_id"]] = sum(counted[s, w // recipe.widths[s]] for w in range(r["start"], r["start"] + r["size"]))
    got = {r["doc_id"]: r["taken"] for r in mixing.mixed_documents(docs, slots=64).collect()}
    assert got == want and sum(got.values()) > 0


def test_small_sources_meet_their_targets(spark):
    """Sources of 6 to 5,000 words: within half a percent of the target, or a word."""
    rows = [(i, f"s{i % 45:02}", " ".join(["w"] * (6 + i % 13 if i % 45 < 40 else 700 + i % 11 * 90))) for i in range(225)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    source = {i: s for i, s, _ in rows}
    taken, target = Counter(), {}
    for r in mixing.mixed_documents(docs).collect():
        taken[source[r["doc_id"]]] += r["taken"]
        target[source[r["doc_id"]]] = r["target"]
        assert r["taken"] <= 2 * r["size"]
    assert len(target) == 45 and all(abs(taken[s] - t) <= max(1, 0.006 * t) for s, t in target.items())


def test_shards_one_by_one_and_by_range_agree():
    recipe = mixing.plan({"a": 90_000, "b": 40_000, None: 500, "e": 0}, (5, 2, 1), 1.5, 4, 32, 7)
    for shard, counts, before in mixing.counts_between(recipe, 700, 720):
        alone = mixing.shard_counts(recipe, shard)
        assert (alone[0] == counts).all() and (alone[1] == before).all()
    assert [s for s, _, _ in mixing.counts_between(recipe, 700, 720)] == list(range(700, 720))


def test_mixed_texts_hold_the_words_taken(spark, docs):
    rows = {(r["doc_id"], r["size"]): r["taken"] for r in mixing.mixed_documents(docs).collect()}
    words = Counter()
    for r in mixing.mixed_texts(docs).collect():
        words[r["doc_id"]] += len(r["text"].split())
        assert r["n_chars"] == len(r["text"])
    assert {i: n for i, n in words.items()} == {i: t for (i, _), t in rows.items() if t}


# sharding


def _jump(key, shards):
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / ((key >> 33) + 1)))
    return b


def test_jump_agrees_with_the_scalar_form_and_moves_little():
    keys = np.random.default_rng(0).integers(0, 1 << 63, 4000).astype(np.uint64)
    now, grown = sharding.jump(keys, 16), sharding.jump(keys, 17)
    assert now[:300].tolist() == [_jump(int(k), 16) for k in keys[:300]]
    assert ((now == grown) | (grown == 16)).all() and 0.03 < (grown == 16).mean() < 0.09


def test_shards(spark, docs):
    rows = QUERIES["op9_jump_hash"](spark, FOLDER).collect()
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    slots = defaultdict(list)
    for r in rows:
        assert r["size"] == len(texts[r["doc_id"]]) + 1 and r["text_crc32"] == zlib.crc32(texts[r["doc_id"]])
        assert r["law"] == "key" and r["grown_shard"] in (r["shard"], 16)
        slots[r["shard"]].append(r["slot"])
    assert len(rows) == len(texts) and all(sorted(v) == list(range(len(v))) for v in slots.values())


# SimHash


def _fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in text).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _roots(codes, most=3):
    root = {c: c for c in codes}

    def find(c):
        while root[c] != c:
            c = root[c]
        return c

    listed = sorted(root)
    for i, a in enumerate(listed):
        for b in listed[i + 1 :]:
            if (a ^ b).bit_count() <= most:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {c: find(c) for c in codes}


def test_fingerprints_and_components(spark, docs):
    rows = {r["doc_id"]: r for r in QUERIES["op10_simhash"](spark, FOLDER).collect()}
    want = {r["doc_id"]: _fingerprint(r["text"]) for r in docs.collect()}
    assert {i: r["fingerprint"] for i, r in rows.items()} == {i: f"{c:016x}" for i, c in want.items()}
    roots = _roots(set(want.values()))
    least = {}
    for i, c in want.items():
        least[roots[c]] = min(i, least.get(roots[c], i))
    assert {i: r["component_id"] for i, r in rows.items()} == {i: least[roots[c]] for i, c in want.items()}


@pytest.mark.parametrize("small,block", [(1, 5), (4, 16), (1000, 4096)])
def test_links_connect_what_brute_force_connects(spark, small, block):
    rng = np.random.default_rng(small)
    centres = rng.integers(0, 1 << 63, 12)
    codes = set()
    for c in centres.tolist():
        for _ in range(14):
            flips = rng.choice(64, rng.integers(0, 5), replace=False)
            codes.add(c ^ sum(1 << int(b) for b in flips))
    signed = [(c - (1 << 64) if c >= 1 << 63 else c,) for c in codes]
    edges = simhash.links(spark.createDataFrame(signed, "fp long"), small=small, block=block)
    for r in edges.collect():
        assert ((r["a"] ^ r["b"]) % (1 << 64)).bit_count() <= 3
    got = {r["node"] % (1 << 64): r["root"] % (1 << 64) for r in simhash.components(edges).collect()}
    want = _roots(codes)
    groups = defaultdict(set)
    for c in codes:
        groups[want[c]].add(got.get(c, c))
    assert all(len(v) == 1 for v in groups.values()) and len({next(iter(v)) for v in groups.values()}) == len(groups)


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 103), (103, 101), (5, 5)]
    got = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, 101: 100, 103: 100}


@pytest.mark.parametrize("alike", [None, 0.8])
def test_one_row_of_each_text_stays_where_ids_repeat(spark, alike):
    rng = np.random.default_rng(8)
    first, other = (" ".join("".join(rng.choice(list(letters), 4)) for _ in range(80)) for letters in ("abcdefg", "hijklmn"))
    rows = [(1, first), (5, first), (5, other), (5, other), (7, first + " more"), (None, first), (9, None), (9, "")]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"), alike=alike).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in kept if r["doc_id"] != 9), key=repr) == sorted([(1, first), (5, other), (None, first)], key=repr)
    assert sum(r["doc_id"] == 9 for r in kept) == 1


def test_one_of_each_group_stays(spark, docs):
    kept = {r["doc_id"] for r in simhash.keep_one(docs).collect()}
    rows = simhash.near_duplicates(docs).collect()
    assert kept == {r["component_id"] for r in rows}


def _alike(a, b):
    x, y = ({" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (a.lower().split(), b.lower().split()))
    return len(x & y) / len(x | y) >= 0.8


def test_edited_copies_go_beyond_three_bits(spark):
    rng = np.random.default_rng(11)
    texts = {}
    for family in range(6):
        words = [f"w{n}" for n in rng.integers(0, 5000, 200)]
        for member in range(1 if family == 5 else 12):
            own = list(words)
            for _ in range(rng.integers(0, 12)):
                own[rng.integers(0, 200)] = f"x{rng.integers(0, 5000)}"
            texts[len(texts)] = " ".join(own)
    rows = [*texts.items(), (3, texts[3]), (900, ""), (None, texts[0])]
    kept = [r["doc_id"] for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"), alike=0.8).collect()]
    stay = [i for i in kept if i in texts]
    assert sorted(i for i in kept if i is not None) == sorted({*stay, 900}) and kept.count(None) == 1
    assert not any(_alike(texts[a], texts[b]) for a in stay for b in stay if a < b)
    # what went has a chain of like texts, or of codes within 3 bits, to one that stays
    reached, front = set(stay), list(stay)
    codes = {i: _fingerprint(t) for i, t in texts.items()}
    while front:
        a = front.pop()
        new = [b for b in texts if b not in reached and (_alike(texts[a], texts[b]) or (codes[a] ^ codes[b]).bit_count() <= 3)]
        reached.update(new)
        front += new
    assert reached == set(texts)


def test_a_family_that_shares_a_passage_costs_sketches_not_texts(spark, monkeypatch):
    rng = np.random.default_rng(12)
    passage = [f"p{n}" for n in rng.integers(0, 5000, 100)]
    rows = []
    for i in range(300):
        # about 0.55 of the shingles are common to every two of them
        rows.append((i, " ".join(passage + [f"x{n}" for n in rng.integers(0, 5000, 38)])))
    compared = []
    real = simhash.stage
    monkeypatch.setattr(simhash, "stage", lambda df, name: (compared.append(real(df, name)) or compared[-1]) if name == "candidates" else real(df, name))
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"), alike=0.8)
    assert kept.count() >= 295  # codes of three-word shingles may be 3 bits apart by chance
    assert sum(c.count() for c in compared) < 300 * 299 / 2 / 4


def test_sketches_find_all_alike(spark):
    rng = np.random.default_rng(13)
    missed = 0
    for _ in range(300):
        words = [f"w{n}" for n in rng.integers(0, 100_000, 400)]
        own = list(words)
        # each changed word changes five shingles, so about 0.8 stay common
        for at in rng.choice(400, 9, replace=False):
            own[at] = f"x{rng.integers(0, 100_000)}"
        a, b = (simhash.sketch(" ".join(w)) for w in (words, own))
        if simhash.jaccard(simhash.shingles(" ".join(words)), simhash.shingles(" ".join(own))) >= 0.8:
            apart = sum(((x ^ y) & (2**64 - 1)).bit_count() for x, y in zip(simhash.low_bits(a), simhash.low_bits(b)))
            missed += not (set(simhash.bands(a).tolist()) & set(simhash.bands(b).tolist())) or apart > simhash._APART
    assert missed <= 1


def test_the_pipeline_leaves_no_like_texts(spark, docs):
    texts = [r["text"] for r in corpus_pipeline.near_dedup(spark, docs, FOLDER).collect() if r["text"]]
    assert not any(_alike(a, b) for i, a in enumerate(texts) for b in texts[:i])


# Hamming search


@pytest.mark.parametrize("segments,k", [(8, 5), (4, 3), (16, 40)])
def test_top_k_equals_brute_force(spark, segments, k):
    rng = np.random.default_rng(segments)
    near = rng.integers(-(1 << 63), 1 << 63, 8)
    codes = [int(near[i % 8]) ^ int(1 << int(rng.integers(0, 62))) for i in range(60)] + rng.integers(-(1 << 63), 1 << 63, 60).tolist()
    df = spark.createDataFrame(list(enumerate(codes)), "id long, code long")
    asked = df.where("id % 9 = 0")
    got = defaultdict(list)
    for r in hamming_topk.top_k(df, asked, k, segments, bundle=7).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["distance"], r["id"]))
    for q in range(0, 120, 9):
        want = sorted((((codes[q] ^ c) % (1 << 64)).bit_count(), i) for i, c in enumerate(codes) if i != q)[:k]
        assert got[q] == want


def test_top_k_of_repeated_rows(spark):
    rng = np.random.default_rng(3)
    centre = int(rng.integers(0, 1 << 62))
    codes = [centre ^ int(sum(1 << int(b) for b in rng.choice(62, 3, replace=False))) for _ in range(30)]
    rows = [row for row in enumerate(codes) for _ in range(4)]
    df = spark.createDataFrame(rows, "id long, code long")
    got = defaultdict(list)
    for r in hamming_topk.top_k(df, df.where("id % 10 = 0"), 10).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["distance"], r["id"]))
    for q in range(0, 30, 10):
        assert got[q] == sorted(((codes[q] ^ c).bit_count(), i) for i, c in enumerate(codes) if i != q)[:10]


# pages

PAGE = """<!DOCTYPE html><html><head><title>T &amp; x</title><style>p{}</style></head><body class="page">
<header>Site</header><nav><ul><li><a href="/">Home</a><li>More</ul></nav>
<div class="cookie-notice"><p>We use cookies</div>
<main><div id="sidebar-left">Side</div><article><h1>Title  of
 it</h1><p>First &lt;b&gt; <b>bold<br>line<p>Second&nbsp;one<script>var a="</p>x";</script>
<div class="ad">Buy</div><ul><li>item 1<li>item 2</ul><form>Name <input></form><!-- no <p>this --></article>
<section class="comments"><p>Nice!</section></main><aside>Links</aside><footer>&copy; me"""


def test_an_article_without_its_frame():
    lines = html_extract.blocks(PAGE)
    assert html_extract.main_text(lines, None).split("\n") == ["Title of it", "First <b> bold line", "Second one", "item 1", "item 2"]


@pytest.mark.parametrize(
    "html,text",
    [
        ('<div class="site has-sidebar"><nav>n</nav><article><p>One<p>Two</article></div>', "One\nTwo"),
        ('<div class="content-with-sidebar"><p>All of the text<p>and more</div><p>x', "All of the text\nand more\nx"),
        ('<article class="post social-share"><p>One line<div class="share">Like</div></article>', "One line"),
        ('<div class="row sidebar"><article>One</article></div><div class="row sidebar"><article>Two</article></div>', "One\nTwo"),
        ('<main><p>Main text stays<article class="card">Card</article></main>', "Main text stays\nCard"),
        ('<article><p>The text of the page<div class="comments"><article>Nice</article></div></article>', "The text of the page"),
    ],
)
def test_names_of_wrappers_do_not_drop_the_article(html, text):
    assert html_extract.main_text(html_extract.blocks(html), None) == text


def test_shared_lines_are_those_of_a_longest_common_subsequence():
    rng = np.random.default_rng(5)
    for _ in range(30):
        a, b = (["abcdef"[i] for i in rng.integers(0, 6, rng.integers(0, 25))] for _ in range(2))
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1, j + 1] = table[i, j] + 1 if x == y else max(table[i, j + 1], table[i + 1, j])
        at = sorted(html_extract.shared(a, b))
        assert len(at) == table[-1, -1]
        rest = iter(b)
        assert all(a[i] in rest for i in at)


def _site(n):
    frame = "<div>Our site</div><div>Today</div>{}<div>All rights reserved</div>"
    return [(i, f"http://h{i % 3}.example/a/{i:03d}", frame.format(f"<p>Story {i} tells this.<p>And page {i} ends.")) for i in range(n)]


@pytest.mark.parametrize("per_part", [3, 1000])
def test_differencing_takes_the_frame_of_unmarked_pages(spark, per_part):
    pages = spark.createDataFrame(_site(40), "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_extract.extract(pages, per_part).collect()}
    assert got == {i: f"Story {i} tells this.\nAnd page {i} ends." for i in range(40)}


def test_copies_and_lone_pages_stay_whole(spark):
    rows = [(1, "http://a/1", "<p>same<p>text"), (2, "http://a/2", "<p>same<p>text"), (3, "http://b/1", "<p>alone")]
    got = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "same\ntext", 2: "same\ntext", 3: "alone"}


@pytest.mark.parametrize("per_part", [2, 1000])
def test_near_copies_keep_their_text(spark, per_part):
    frame = "<div>Our site</div>{}<div>All rights reserved</div>"
    story = "<p>Seen {} times<p>A long story that both of the copies tell.<p>It goes on and on, and then it ends."
    near = [(i, f"http://a/1{i}", frame.format(story.format(i))) for i in range(3)]
    rows = [*near, (3, "http://a/2", frame.format("<p>Something else that is told here.")), *[(i + 10, f"http://b/{i}", h) for i, _, h in near]]
    got = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), per_part).collect()}
    text = "Seen {} times\nA long story that both of the copies tell.\nIt goes on and on, and then it ends."
    for i in range(3):
        assert got[i] == text.format(i)
        assert got[i + 10] == f"Our site\n{text.format(i)}\nAll rights reserved"
    assert got[3] == "Something else that is told here."


def test_differencing_decides_on_pages_with_marks_too(spark):
    """An element that all pages repeat is frame; one with a part of the page's own text is text; an article stays whole."""
    card = "<div>Our site</div><article><p>Read this first, as on any page.</article>{}<div>All rights reserved</div>"
    part = "<div>Our site</div><article><p>Part {0}<p>See below.</article><p>Most of story {0} is told beside its element.<div>All rights reserved</div>"
    held = "<div>Our site</div><div>Page {0}</div><article><p>Story {0} is all inside its element.<p>The end, as in any story.</article><div>All rights reserved</div>"
    rows = []
    for i in range(6):
        rows.append((i, f"http://a/{i}", card.format(f"<p>Story {i} is told beside the card.<p>And page {i} ends.")))
        rows.append((10 + i, f"http://b/{i}", part.format(i)))
        rows.append((20 + i, f"http://c/{i}", held.format(i)))
    rows.append((30, "http://d/1", held.format(9)))
    got = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(6):
        assert got[i] == f"Story {i} is told beside the card.\nAnd page {i} ends."
        assert got[10 + i] == f"Part {i}\nSee below.\nMost of story {i} is told beside its element."
        assert got[20 + i] == f"Story {i} is all inside its element.\nThe end, as in any story."
    assert got[30] == "Story 9 is all inside its element.\nThe end, as in any story."


def test_all_pages_are_answered(spark):
    rows = QUERIES["op8_nearest_url_text"](spark, FOLDER).collect()
    pages = {r["page_id"]: r for r in read(spark, FOLDER, "pages").collect()}
    assert len(rows) == len(pages)
    for r in rows:
        body = html_extract.main_text(html_extract.blocks(pages[r["page_id"]]["html"]), None)
        assert r["text"] == body and r["n_chars"] == len(body) and r["url"] == pages[r["page_id"]]["url"]


# pipeline


def test_pipeline(spark, docs):
    tables = [docs]
    for _, stage in corpus_pipeline.STAGES:
        made = stage(spark, tables[-1], FOLDER)
        tables.append(corpus_pipeline.stage(made, "test"))
    good, one, clean, mixed, packed = tables[1:]
    labels = {r["doc_id"]: r["quality"] for r in read(spark, FOLDER, "labels").where(held_out(F.col("doc_id"))).collect()}
    kept = {r["doc_id"] for r in good.collect()}
    assert np.mean([(i in kept) == bool(q) for i, q in labels.items()]) > 0.95
    prints = [_fingerprint(r["text"]) for r in one.collect()]
    assert all((a ^ b).bit_count() > 3 for i, a in enumerate(prints) for b in prints[:i])
    assert clean.count() == one.count() and clean.where("text rlike '[0-9a-f]{16,}'").count() == 0
    assert mixed.columns == docs.columns and mixed.where("n_chars <> length(text)").count() == 0
    total = packed.groupBy().sum("length").first()[0]
    tokenizer = Tokenizer.from_file(VOCABULARY)
    assert total == sum(len(tokenizer.encode(r["text"], add_special_tokens=False).ids) + 1 for r in mixed.collect())
