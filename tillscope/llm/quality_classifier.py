"""A byte-level convolutional network in numpy that scores whole documents for quality."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillscope.llm.common import by_batch, held_out
from tillscope.session import stage

CHUNK, STRIDE = 512, 448
WIDTH, FILTERS, HIDDEN = 4, 16, 16
_TOGETHER = 64


def chunks(data: bytes, at: np.ndarray | None = None) -> np.ndarray:
    """Overlapping chunks that cover all of ``data`` (zero bytes fill the last), or those numbered ``at``."""
    n = 1 + max(0, -(-(len(data) - CHUNK) // STRIDE))
    filled = np.zeros((n - 1) * STRIDE + CHUNK, np.uint8)
    filled[: len(data)] = np.frombuffer(data, np.uint8)
    view = np.lib.stride_tricks.as_strided(filled, (n, CHUNK), (STRIDE, 1))
    return view if at is None else view[at]


@dataclass
class Network:
    """Filters over WIDTH bytes (one weight per offset, byte value and filter) and two dense layers."""

    filters: np.ndarray
    shift: np.ndarray
    dense: np.ndarray
    dense_shift: np.ndarray
    last: np.ndarray
    last_shift: np.ndarray

    @classmethod
    def start(cls, seed: int = 3) -> Network:
        rng = np.random.default_rng(seed)
        draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        return cls(
            draw(WIDTH, 256, FILTERS, scale=0.3),
            np.zeros(FILTERS, np.float32),
            draw(FILTERS, HIDDEN, scale=0.3),
            np.zeros(HIDDEN, np.float32),
            draw(HIDDEN, scale=0.3),
            np.zeros(1, np.float32),
        )

    def responses(self, part: np.ndarray) -> np.ndarray:
        """Every filter at every place of every chunk."""
        places = CHUNK - WIDTH + 1
        total = np.take(self.filters[0], part[:, :places], axis=0)
        for j in range(1, WIDTH):
            total += np.take(self.filters[j], part[:, j : j + places], axis=0)
        return total

    def logits(self, part: np.ndarray) -> np.ndarray:
        """One logit for each chunk, from the largest response of every filter in it."""
        made = np.empty(len(part), np.float32)
        for at in range(0, len(part), _TOGETHER):
            pooled = np.maximum(self.responses(part[at : at + _TOGETHER]).max(axis=1) + self.shift, 0)
            hidden = np.maximum(pooled @ self.dense + self.dense_shift, 0)
            made[at : at + _TOGETHER] = hidden @ self.last + self.last_shift
        return made

    def score(self, text: str | None) -> float:
        """The probability of a good document: its chunks' logits, averaged. Empty texts are one empty chunk."""
        z = float(self.logits(chunks((text or "").encode("utf-8", "surrogatepass"))).mean(dtype=np.float64))
        return 1.0 / (1.0 + float(np.exp(-np.clip(z, -30, 30))))


def train(part: np.ndarray, labels: np.ndarray, epochs: int = 12, batch: int = 64, rate: float = 0.004, decay: float = 1e-4) -> Network:
    """Adam on the logistic loss of single chunks, classes weighted alike."""
    net = Network.start()
    names = list(net.__dataclass_fields__)
    first = {k: np.zeros_like(getattr(net, k)) for k in names}
    second = {k: np.zeros_like(getattr(net, k)) for k in names}
    share = np.clip(np.bincount(labels, minlength=2) / max(len(labels), 1), 1e-6, None)
    weight = (0.5 / share[labels]).astype(np.float32)
    rng, step = np.random.default_rng(4), 0
    column = np.arange(FILTERS)
    for _ in range(epochs):
        order = rng.permutation(len(labels))
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            x, y = part[rows], labels[rows]
            raw = net.responses(x)
            top = raw.argmax(axis=1)
            best = np.take_along_axis(raw, top[:, None, :], axis=1)[:, 0, :] + net.shift
            pooled = np.maximum(best, 0)
            sums = pooled @ net.dense + net.dense_shift
            hidden = np.maximum(sums, 0)
            p = 1 / (1 + np.exp(-np.clip(hidden @ net.last + net.last_shift, -30, 30)))
            out = (p - y) * weight[rows] / len(rows)
            back = np.outer(out, net.last) * (sums > 0)
            deep = (back @ net.dense.T) * (best > 0)
            slope = {
                "last": hidden.T @ out,
                "last_shift": np.array([out.sum()]),
                "dense": pooled.T @ back,
                "dense_shift": back.sum(axis=0),
                "shift": deep.sum(axis=0),
                "filters": np.empty_like(net.filters),
            }
            for j in range(WIDTH):
                value = np.take_along_axis(x, top + j, axis=1).astype(np.int64)
                slope["filters"][j] = np.bincount((value * FILTERS + column).ravel(), deep.ravel(), 256 * FILTERS).reshape(256, FILTERS)
            step += 1
            for k in names:
                g = slope[k] + decay * getattr(net, k)
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                move = first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
                setattr(net, k, (getattr(net, k) - rate * move).astype(np.float32))
    return net


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 1500, per_document: int = 4) -> Network:
    """A network from the labelled rows whose id is outside the held-out third.

    About ``per_class`` rows of each class are used, chosen by a hash of the id, and of each
    document up to ``per_document`` chunks spread over its whole text. Without a label of
    either class the untrained network answers.
    """
    usable = labels.select("doc_id", F.col("quality").cast("int").alias("y")).where("doc_id is not null and quality in (0, 1)")
    usable = usable.where(~held_out(F.col("doc_id")))
    sizes = {r["y"]: r["count"] for r in usable.groupBy("y").count().collect()}
    if len(sizes) < 2:
        return Network.start()
    cut = F.when(F.col("y") == 1, F.lit(int(min(1.0, per_class / sizes[1]) * (1 << 30)))).otherwise(F.lit(int(min(1.0, per_class / sizes[0]) * (1 << 30))))
    chosen = stage(usable.where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) < cut), "labelled")

    def make():
        def work(batch):
            y, part = [], []
            for text, label in zip(batch.column("text"), batch.column("y").to_pylist()):
                cut_ = chunks((text.as_py() or "").encode("utf-8", "surrogatepass"))
                for at in np.unique(np.linspace(0, len(cut_) - 1, per_document).astype(int)):
                    part.append(cut_[at].tobytes())
                    y.append(label)
            return {"y": y, "part": part}

        return work

    rows = by_batch(docs.select("doc_id", "text").join(chosen, "doc_id").select("text", "y"), make, "y int, part binary")
    found = sorted((bytes(r["part"]), r["y"]) for r in rows.collect())
    part = np.frombuffer(b"".join(p for p, _ in found), np.uint8).reshape(-1, CHUNK)
    return train(part, np.array([y for _, y in found], np.int64))


def score(docs: DataFrame, network: Network) -> DataFrame:
    """doc_id, held_out, score and predicted (1 at 0.5 or more) of every row, from its whole text alone."""

    def make():
        def work(batch):
            made = [network.score(t.as_py()) for t in batch.column("text")]
            return {
                "doc_id": batch.column("doc_id"),
                "held_out": batch.column("held_out"),
                "score": made,
                "predicted": [int(s >= 0.5) for s in made],
            }

        return work

    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return by_batch(rows, make, f"doc_id {kind}, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, network: Network) -> DataFrame:
    """The rows of ``docs`` that the network does not reject, all columns kept."""
    names = docs.columns

    def make():
        def work(batch):
            good = [i for i, t in enumerate(batch.column("text")) if network.score(t.as_py()) >= 0.5]
            return {c: batch.column(c).take(pa.array(good, pa.int64())) for c in names}

        return work

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return by_batch(docs, make, fields)
