"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillscope.llm.common import by_batch, held_out

BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
UNKNOWN = "und"
_SPACE = np.arange(128, dtype=np.uint32)
_SPACE[[c for c in range(128) if not chr(c).isalpha()]] = 32
_PIECE = 1 << 18


def grams(text: str):
    """The hashed character n-grams of a whole text, in pieces of bounded size.

    Lower case; ASCII characters that are no letters count as a space. Each n-gram is in the
    piece that holds its last character, so it comes once whatever the pieces are.
    """
    text = text.lower()
    for at in range(0, max(len(text), 1), _PIECE):
        lead = min(at, max(ORDERS) - 1)
        piece = text[at - lead : at + _PIECE]
        chars = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), "<u4")
        chars = np.where(chars < 128, _SPACE[np.minimum(chars, 127)], chars)
        hashed = np.zeros(len(chars), np.uint32)
        for order in range(1, max(ORDERS) + 1):
            hashed = hashed[: len(chars) - order + 1] * np.uint32(0x9E3779B1) + chars[order - 1 :] + np.uint32(order)
            own = hashed[max(0, lead - order + 1) :]
            if order in ORDERS and len(own):
                yield ((own * np.uint32(0x85EBCA6B)) >> np.uint32(17)).astype(np.int64)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


@dataclass(frozen=True)
class Model:
    """Weights per n-gram bucket and language, the inverse document frequencies folded in."""

    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float

    def logits(self, text: str) -> np.ndarray:
        total, n = np.zeros(len(self.languages)), 0
        for g in grams(text):
            total += self.table[g].sum(axis=0, dtype=np.float64)
            n += len(g)
        return self.bias + _SCALE * total / max(n, 1)

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language and its calibrated probability; ``und`` and 0 without a letter."""
        if not self.languages or not has_letter(text):
            return UNKNOWN, 0.0
        z = self.logits(text) / self.temperature
        p = np.exp(z - z.max())
        best = int(p.argmax())
        return self.languages[best], float(p[best] / p.sum())


#: Relative frequencies are small; this brings the features near one.
_SCALE = 64.0


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(
    rows: list[tuple[int, np.ndarray, np.ndarray]],
    classes: int,
    epochs: int = 3,
    rate: float = 0.5,
    beta: float = 1.0,
    l1: float = 0.02,
    l2: float = 0.01,
) -> tuple[np.ndarray, np.ndarray]:
    """Follow-the-regularised-leader with elastic net, one row (class, buckets, values) at a time.

    Each coordinate keeps its summed gradients ``z`` and squares ``n``; its weight is zero while
    |z| is under ``l1``, so n-grams that tell nothing stay out of the model.
    """
    z, n = np.zeros((BUCKETS + 1, classes)), np.zeros((BUCKETS + 1, classes))

    def weights(at: np.ndarray) -> np.ndarray:
        shrunk = np.sign(z[at]) * np.maximum(np.abs(z[at]) - l1, 0.0)
        return -shrunk / ((beta + np.sqrt(n[at])) / rate + l2)

    order = np.random.default_rng(5)
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            label, buckets, values = rows[k]
            at, x = np.append(buckets, BUCKETS), np.append(values, 1.0)
            w = weights(at)
            p = _softmax(x @ w)
            p[label] -= 1.0
            g = x[:, None] * p[None, :]
            squares = g * g
            z[at] += g - (np.sqrt(n[at] + squares) - np.sqrt(n[at])) / rate * w
            n[at] += squares
    w = weights(np.arange(BUCKETS + 1))
    return w[:BUCKETS], w[BUCKETS]


def calibrate(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature with the least negative log-likelihood on rows kept out of training."""
    if not len(labels):
        return 1.0

    def loss(t: float) -> float:
        return float(-np.log(np.maximum(_softmax(logits / np.exp(t))[np.arange(len(labels)), labels], 1e-12)).mean())

    grid = np.linspace(-3, 3, 121)
    return float(np.exp(grid[int(np.argmin([loss(t) for t in grid]))]))


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many of all rows each n-gram bucket occurs, and the rows. Tasks add up before the shuffle."""

    def run(batches):
        import pyarrow as pa

        found, rows = np.zeros(BUCKETS + 1, np.int64), 0
        for batch in batches:
            for text in batch.column("text"):
                seen = np.zeros(BUCKETS, bool)
                for g in grams(text.as_py() or ""):
                    seen[g] = True
                found[:BUCKETS] += seen
                rows += 1
        found[BUCKETS] = rows
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(at, pa.int32()), "n": pa.array(found[at], pa.int64())})

    counted = docs.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    made = np.zeros(BUCKETS + 1, np.int64)
    for r in counted.collect():
        made[r["bucket"]] = r["n"]
    return made[:BUCKETS], int(made[BUCKETS])


def features(docs: DataFrame) -> DataFrame:
    """lang, key (a hash of the text) and the whole text's buckets and relative frequencies, as bytes."""

    def make():
        def work(batch):
            at, values = [], []
            for text in batch.column("text"):
                counts = np.zeros(BUCKETS)
                for g in grams(text.as_py() or ""):
                    counts += np.bincount(g, minlength=BUCKETS)
                some = np.flatnonzero(counts)
                at.append(some.astype("<i4").tobytes())
                values.append((counts[some] / max(counts.sum(), 1)).astype("<f4").tobytes())
            return {"lang": batch.column("lang"), "key": batch.column("key"), "at": at, "values": values}

        return work

    keyed = docs.select("lang", F.xxhash64("text").alias("key"), "text")
    return by_batch(keyed, make, "lang string, key long, at binary, values binary")


def fit(docs: DataFrame, per_language: int = 400) -> Model:
    """A model from the rows of ``docs`` with a language and an id outside the held-out third.

    Document frequencies cover all those rows. The weights are fitted on about ``per_language``
    rows of each language, chosen by a hash of id and text, so that copies of a text under other ids
    are thinned as other rows are; every fifth of them, by text, is for the temperature.
    """
    known = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0), 1.0)
    df, n = document_frequencies(known)
    idf = np.log((1 + n) / (1 + df)) + 1.0
    cut = F.lit(0)
    for lang in languages:
        cut = F.when(F.col("lang") == lang, F.lit(int(min(1.0, per_language / sizes[lang]) * (1 << 30)))).otherwise(cut)
    sample = known.where(F.pmod(F.xxhash64("doc_id", "text", F.lit("sample")), F.lit(1 << 30)) < cut)
    rows, spare = [], []
    for r in sorted(features(sample).collect(), key=lambda r: (r["key"], r["lang"])):
        at = np.frombuffer(r["at"], "<i4").astype(np.int64)
        x = np.frombuffer(r["values"], "<f4") * idf[at] * _SCALE
        (spare if r["key"] % 5 == 0 else rows).append((languages.index(r["lang"]), at, x))
    weights, bias = train(rows or spare, len(languages))
    logits = np.array([x @ weights[at] + bias for _, at, x in spare]).reshape(len(spare), len(languages))
    temperature = calibrate(logits, np.array([label for label, _, _ in spare], int))
    return Model(languages, (weights * idf[:, None]).astype(np.float32), bias, temperature)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row, from its whole text alone."""

    def make():
        def work(batch):
            made = [model.predict(t.as_py()) for t in batch.column("text")]
            return {
                "doc_id": batch.column("doc_id"),
                "held_out": batch.column("held_out"),
                "lang_pred": [m[0] for m in made],
                "score": [m[1] for m in made],
            }

        return work

    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return by_batch(rows, make, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def languages(docs: DataFrame, per_language: int = 400) -> DataFrame:
    """Fit on ``docs`` and identify all of them. Null or letterless texts get ``und`` and 0.

    Repeated rows are each learned from and each answered; a table without a known language
    answers ``und`` throughout, an empty table is answered by an empty one.
    """
    return identify(docs, fit(docs, per_language))
