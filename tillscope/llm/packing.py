"""Minimum bin slack: fixed windows filled with whole remainders by subset-sum over their lengths."""

from __future__ import annotations

import re
import zlib
from array import array
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame

from tillscope.llm.common import by_batch, placed
from tillscope.session import stage

WINDOW = 4096
#: Distinct words that a task remembers before it starts anew, and characters it cuts at once; both bound its memory.
WORDS, SLICE = 250_000, 1 << 18
#: Latin text: its lower case and normal form are those of its characters one by one.
_LATIN = re.compile(r"[\n -~À-įı-ſ]*")
_SMALL = "a-zß-öø-ÿā-ſ"
#: The words of Latin text in small letters as the vocabulary's splitter cuts them.
_WORD = re.compile(rf"'(?:s|t|re|ve|m|ll|d)|[{_SMALL}]+|[0-9]|[^\s{_SMALL}0-9]+")
#: The splitter shows bytes as characters: printable ones as they are, the others from 256 on.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_HIDDEN = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _SHOWN)}


def _plain(text: str) -> bool:
    return "<|" not in text and _LATIN.fullmatch(text) is not None


def _slices(text: str):
    """A text cut at spaces, so that no part but a run without any is much longer than a slice."""
    at = 0
    while len(text) - at > SLICE:
        end = text.find(" ", at + SLICE)
        if end < 0:
            break
        yield text[at:end]
        at = end
    yield text[at:]


class Ids:
    """Token ids of whole texts as little-endian bytes, each distinct word encoded once.

    The vocabulary normalises and cuts within white space, so a text's ids are those of its
    parts between spaces, in order. Latin text is put together from its words; in other text
    the parts that are not Latin are left to the tokenizer whole.
    """

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.words: dict[str, bytes] = {}

    def _of_words(self, words: list[str]) -> bytes:
        known = self.words
        new = set(words).difference(known)
        if len(known) + len(new) > WORDS:
            known.clear()
            new = set(words)
        cut = self.tokenizer.model.tokenize
        for word in new:
            shown = word if word.isascii() else word.encode().decode("latin-1").translate(_HIDDEN)
            known[word] = array("I", [t.id for t in cut(shown)]).tobytes()
        return b"".join(map(known.__getitem__, words))

    def _of_mixed(self, text: str) -> bytes:
        made, latin = [], []

        def put():
            if latin:
                made.append(self._of_words(_WORD.findall(" ".join(latin).lower())))
                latin.clear()

        for part in text.replace("\n", " ").split(" "):
            if _plain(part):
                latin.append(part)
            else:
                put()
                ids = self.tokenizer.encode(part, add_special_tokens=False).ids
                made.append(array("I", ids).tobytes())
        put()
        return b"".join(made)

    def of(self, text: str) -> bytes:
        parts = [self._of_words(_WORD.findall(s.lower())) if _plain(s) else self._of_mixed(s) for s in _slices(text)]
        return parts[0] if len(parts) == 1 else b"".join(parts)


def pieces(docs: DataFrame, vocabulary: str, end: int = 2, window: int = WINDOW) -> DataFrame:
    """Every document's ids, with ``end`` after them, cut into full windows and one remainder.

    Per piece: doc_id, start, length, ids_crc32, doc_tokens. A null text counts as empty: its
    one piece holds ``end`` alone.
    """
    tail = np.array([end], "<u4").tobytes()

    def make():
        ids = Ids(vocabulary)

        def work(batch):
            keys = batch.column("doc_id")
            texts = batch.column("text")
            of, start, length, crc, total = [], [], [], [], []
            for at, text in enumerate(texts):
                data = ids.of(text.as_py() or "") + tail
                n = len(data) // 4
                for first in range(0, n, window):
                    part = data[4 * first : 4 * (first + window)]
                    of.append(at)
                    start.append(first)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    total.append(n)
            return {"doc_id": keys.take(of), "start": start, "length": length, "ids_crc32": crc, "doc_tokens": total}

        return work

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length int, ids_crc32 long, doc_tokens long"
    return by_batch(docs.select("doc_id", "text"), make, schema)


def fill(counts: dict[int, int], window: int = WINDOW) -> list[tuple[dict[int, int], int]]:
    """Patterns (length -> copies in one window) with the number of windows each fills.

    The longest length left opens a window. A bitset holds the sums that the lengths left can
    reach, each length offered by its count in binary portions; the reachable sum closest to
    the space left is traced back through the stages to the counts that make it. The pattern is
    used as often as its counts last. Work depends on the distinct lengths, not on the pieces.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    order = sorted(left, reverse=True)
    made = []
    while order:
        longest = order[0]
        left[longest] -= 1
        space = window - longest
        limit, reach, stages = (1 << (space + 1)) - 1, 1, []
        for n in order:
            if n > space:
                continue
            offered, portion = min(left[n], space // n), 1
            while offered > 0:
                take = min(portion, offered)
                stages.append((n, take, reach))
                reach |= (reach << (n * take)) & limit
                offered -= take
                portion *= 2
            if reach >> space & 1:
                break
        best = reach.bit_length() - 1
        pattern = Counter({longest: 1})
        for n, take, before in reversed(stages):
            if best and not before >> best & 1:
                pattern[n] += take
                best -= n * take
        left[longest] += 1
        times = min(left[n] // c for n, c in pattern.items())
        for n, c in pattern.items():
            left[n] -= c * times
        made.append((dict(pattern), times))
        order = [n for n in order if left[n]]
    return made


def pack(cut: DataFrame, window: int = WINDOW) -> DataFrame:
    """``cut`` (pieces) with ``sequence_id`` and ``offset``, gapless from 0 in each sequence.

    Only how many pieces have each length (at most ``window`` numbers) leaves the cluster; the
    filling is planned on those. The pieces of a length are numbered in salted parts and go
    to the places of that length in this order, so one length may hold any share of the pieces.
    """
    cut = stage(cut, "pieces")
    counts = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}
    used = Counter()
    ranges: dict[int, list[tuple[int, int, int, int]]] = {}
    sequence = 0
    for pattern, times in fill(counts, window):
        offset = 0
        for n in sorted(pattern, reverse=True):
            ranges.setdefault(n, []).append((used[n], pattern[n], sequence, offset))
            used[n] += pattern[n] * times
            offset += n * pattern[n]
        sequence += times
    places = {n: np.array(r, np.int64) for n, r in ranges.items()}

    def make():
        def work(batch):
            length = batch.column("length").to_numpy(zero_copy_only=False).astype(np.int64)
            rank = batch.column("rank").to_numpy(zero_copy_only=False)
            sequence_id, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for n in np.unique(length):
                rows = np.flatnonzero(length == n)
                of = places[int(n)]
                at = of[np.searchsorted(of[:, 0], rank[rows], side="right") - 1]
                within = rank[rows] - at[:, 0]
                sequence_id[rows] = at[:, 2] + within // at[:, 1]
                offset[rows] = at[:, 3] + within % at[:, 1] * n
            made = {c: batch.column(c) for c in batch.schema.names}
            return made | {"sequence_id": sequence_id, "offset": offset}

        return work

    ranked = placed(cut, ["length"], ["doc_id", "start", "doc_tokens", "ids_crc32"], "rank", salts=64)
    kind = cut.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return by_batch(ranked, make, schema)


def pack_documents(docs: DataFrame, vocabulary: str, end: int = 2, window: int = WINDOW) -> DataFrame:
    """All documents in sequences of at most ``window`` ids, one row for each piece.

    Documents longer than a window are cut into windows and a remainder; nothing else is cut.
    Repeated rows are packed each for itself; an empty table gives an empty result.
    """
    packed = pack(pieces(docs, vocabulary, end, window), window)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
