"""Secret scans: stated patterns, and character Markov models of random strings and ordinary words."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
KINDS = ["assign", "access", "hex", "markov"]
#: The characters that the models know, in the order of their numbers.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
_TOKEN = r"[A-Za-z0-9+/_=-]"
_SPAN = "array<struct<start:int,kind:int,end:int>>"
#: Values that a running fold takes in one go, and characters of the pieces that a text is cut into to reach its middle.
_PART = 128
_CHUNK = 1024


def _named(x: Column, body) -> Column:
    """``body`` of ``x``, which is then worked out once however often the body names it."""
    return F.get(F.transform(F.array(x), body), 0)


def _running(values: Column, step) -> Column:
    """For every one of ``values`` (int) the fold by ``step`` of those before it, from 0.

    Arrays cannot be added to in place, so the fold first meets blocks of ``_PART`` as a whole and
    then the values within each block: no array that grows with the text is copied value by value.
    """

    def of(v: Column) -> Column:
        at = F.sequence(F.lit(0), F.floor(F.size(v) / _PART).cast("int"))
        return _named(F.transform(at, lambda i: F.slice(v, i * _PART + 1, F.lit(_PART))), blocks)

    def blocks(b: Column) -> Column:
        heads = F.aggregate(b, F.array(F.lit(0)), lambda s, x: F.array_append(s, F.aggregate(x, F.element_at(s, -1), step)))
        return F.flatten(F.zip_with(b, F.slice(heads, F.lit(1), F.size(b)), within))

    def within(x: Column, head: Column) -> Column:
        made = F.aggregate(x, F.array(head), lambda s, y: F.array_append(s, step(F.element_at(s, -1), y)))
        return F.slice(made, F.lit(1), F.size(x))

    return _named(values, of)


def _later(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def spans(text: Column, pattern: str, kind: int, group: int = 0, least: int = 0, keep: bool = False) -> Column:
    """Start and end (code points) of the leftmost non-overlapping matches whose ``group`` has ``least`` characters.

    The matches and the pieces between them alternate, so places are running sums of their
    lengths. Texts without a match are not cut. With ``keep`` a span has its ``token`` too.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    part = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    cut = F.arrays_zip(
        F.transform(F.split(text, pattern, -1), F.length).alias("gap"),
        F.transform(whole, F.length).alias("size"),
        F.transform(part, F.length).alias("held"),
        *([whole.alias("token")] if keep else []),
    )
    kind_of = _SPAN.replace(">>", ",token:string>>") if keep else _SPAN

    def found(c: Column) -> Column:
        before = _running(F.transform(c, lambda x: x["gap"] + F.coalesce(x["size"], F.lit(0))), lambda a, b: a + b)
        placed = F.filter(F.zip_with(c, before, lambda x, at: F.struct(x.alias("x"), at.alias("at"))), lambda m: m["x"]["held"] >= least)
        return F.transform(placed, span)

    def span(m: Column) -> Column:
        start = m["at"] + m["x"]["gap"]
        token = [m["x"]["token"].alias("token")] if keep else []
        return F.struct(start.alias("start"), F.lit(kind).alias("kind"), (start + m["x"]["size"]).alias("end"), *token)

    return F.when(text.rlike(pattern), _named(cut, found)).otherwise(F.array().cast(kind_of))


def _apart(runs: Column, base: Column) -> Column:
    """The ``runs`` that overlap no span of ``base``.

    A run overlaps one if, of the spans that start before its end, one ends after its start. So
    both are put in one order, by start and by last character, with the greatest end so far.
    """
    event = lambda at, run, end, r: F.struct(at.alias("at"), F.lit(run).alias("run"), end.alias("end"), r.alias("r"))

    def of(rs: Column) -> Column:
        none = F.get(rs, F.size(rs))
        marks = F.concat(
            F.transform(base, lambda b: event(b["start"], False, b["end"], none)),
            F.transform(rs, lambda r: event(r["end"] - 1, True, F.lit(0), r)),
        )
        return _named(F.sort_array(marks), swept)

    def swept(e: Column) -> Column:
        ends = _running(F.transform(e, lambda x: x["end"]), _later)
        met = F.zip_with(e, ends, lambda x, end: F.struct(x["run"].alias("run"), x["r"].alias("r"), end.alias("end")))
        return F.transform(F.filter(met, lambda m: m["run"] & (m["end"] <= m["r"]["start"])), lambda m: m["r"])

    return F.when((F.size(runs) > 0) & (F.size(base) > 0), _named(runs, of)).otherwise(runs)


def base_spans(text: Column) -> dict[str, Column]:
    return {"assign": spans(text, ASSIGN, 0, group=2, least=12), "access": spans(text, ACCESS, 1), "hex": spans(text, HEX, 2)}


@dataclass(frozen=True)
class Models:
    """Log-likelihood ratio, random over ordinary, of every transition; the first row is a string's start."""

    ratios: tuple[tuple[float, ...], ...]

    def score(self, token: Column) -> Column:
        """The sum over a token's transitions; characters outside the alphabet say nothing."""
        n = len(ALPHABET)
        flat = ",".join(f"{x:.3f}" for row in self.ratios for x in row)
        table = F.split(F.lit(flat), ",").cast("array<float>")
        codes = F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c))
        pairs = F.zip_with(F.concat(F.array(F.lit(0)), codes), F.concat(codes, F.array(F.lit(0))), lambda a, b: F.when(b > 0, a * n + b))
        return F.aggregate(pairs, F.lit(0.0), lambda t, p: t + F.coalesce(F.get(table, p - 1), F.lit(0.0)).cast("double"))


def fit(docs: DataFrame, sample: int = 5000, uniform: float = 0.3, floor: float = 0.02) -> Models:
    """Both models from labelled strings of about ``sample`` documents, chosen by a hash of their text.

    Random strings are what the base patterns find; ordinary ones are the other words of 4 or
    more characters of the alphabet. Only transition counts (at most 68 x 67 of each model)
    leave the cluster. The random model is mixed with a ``uniform`` share, for one cannot see all
    random alphabets in a sample; the ordinary one with the share ``floor``.
    """
    total = docs.count()
    share = min(1.0, sample / max(total, 1))
    chosen = docs.select(F.coalesce("text", F.lit("")).alias("text")).where(
        F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < F.lit(math.ceil(share * (1 << 20)))
    )
    value = F.regexp_extract_all("text", F.lit(ASSIGN), F.lit(2))
    secret = F.concat(
        F.filter(value, lambda v: F.length(v) >= 12),
        F.regexp_extract_all("text", F.lit(ACCESS), F.lit(0)),
        F.regexp_extract_all("text", F.lit(HEX), F.lit(0)),
    )
    rest = F.regexp_replace("text", "|".join((ASSIGN, ACCESS, HEX)), " ")
    ordinary = F.regexp_extract_all(rest, F.lit(_TOKEN + "{4,}"), F.lit(0))
    labelled = chosen.select(F.explode(F.array(F.struct(F.lit(1).alias("random"), secret.alias("s")), F.struct(F.lit(0).alias("random"), ordinary.alias("s")))).alias("x"))
    strings = labelled.select("x.random", F.explode("x.s").alias("s"))
    codes = F.transform(F.split("s", ""), lambda c: F.instr(F.lit(ALPHABET), c))
    moves = F.arrays_zip(F.concat(F.array(F.lit(0)), codes).alias("a"), codes.alias("b"))
    counted = strings.select("random", F.explode(moves).alias("m")).where("m.b > 0").groupBy("random", "m.a", "m.b").count()
    n = len(ALPHABET)
    seen = [[[0.0] * n for _ in range(n + 1)] for _ in range(2)]
    for r in counted.collect():
        seen[r["random"]][r["a"]][r["b"] - 1] = float(r["count"])

    def likelihood(which: int, a: int, b: int, even: float) -> float:
        row = seen[which][a]
        return (1 - even) * (row[b] + 1.0 / n) / (sum(row) + 1.0) + even / n

    return Models(
        tuple(tuple(math.log(likelihood(1, a, b, uniform) / likelihood(0, a, b, floor)) for b in range(n)) for a in range(n + 1))
    )


def scan(docs: DataFrame, models: Models | None = None, least: int = 20, margin: float = 15.0) -> DataFrame:
    """``docs`` with ``base`` and ``found``: arrays of (start, kind, end), by start and then kind.

    ``base`` holds what the stated patterns find. ``found`` adds the runs of ``least`` or more
    token characters that overlap no base span and are more likely random than ordinary by
    ``margin`` nats. A null or empty text has none, an empty table no rows, and repeated rows are
    judged each on its own. The work grows with a text as its length and spans do.
    """
    models = models or fit(docs)
    text = F.coalesce("text", F.lit(""))
    kinds = base_spans(F.col("__text"))
    based = docs.withColumn("__text", text).withColumn("base", F.sort_array(F.concat(*kinds.values())))
    runs = spans(F.col("__text"), _TOKEN + f"{{{least},}}", 3, keep=True)
    offered = based.withColumn("__runs", runs).withColumn("__runs", _apart(F.col("__runs"), F.col("base")))
    likely = F.filter("__runs", lambda r: models.score(r["token"]) >= margin)
    added = F.transform(likely, lambda r: F.struct(*[r[c].alias(c) for c in ("start", "kind", "end")]))
    found = F.when(F.size("__runs") > 0, F.sort_array(F.concat("base", added))).otherwise(F.col("base"))
    return offered.withColumn("found", found).drop("__text", "__runs")


def as_text(array: str) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(array, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def secret_spans(docs: DataFrame, models: Models | None = None) -> DataFrame:
    """Per row: doc_id, the number of base spans of each kind, their digest, and all spans."""
    scanned = scan(docs.select("doc_id", "text"), models)
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return scanned.select(
        "doc_id",
        n(0).alias("n_assign"),
        n(1).alias("n_access"),
        n(2).alias("n_hex"),
        F.sha2(as_text("base").cast("binary"), 256).alias("base_sha256"),
        as_text("found").alias("spans"),
    )


def redact(docs: DataFrame, models: Models | None = None, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span found (overlapping ones as one) replaced by ``mark``; n_chars follows."""
    scanned = scan(docs.select(F.struct(*docs.columns).alias("row"), "text"), models)
    chunks = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{_CHUNK}}}"), F.lit(0))

    def kept(found: Column, chunk: Column) -> Column:
        """What lies between the spans, joined by the mark; a span that starts within those before it adds none."""
        ends = F.concat(F.transform(found, lambda s: s["end"]), F.array(F.lit(0)))
        starts = F.concat(F.transform(found, lambda s: s["start"]), F.array(F.length("text")))
        gaps = F.zip_with(_running(ends, _later), starts, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        return F.array_join(F.transform(F.filter(gaps, lambda g: g["a"] <= g["b"]), lambda g: piece(chunk, g["a"], g["b"])), mark)

    def piece(chunk: Column, a: Column, b: Column) -> Column:
        numbers = F.sequence((a / _CHUNK).cast("int"), ((b - 1) / _CHUNK).cast("int"))
        part = lambda i: F.substring(
            F.get(chunk, i), F.greatest(a - i * _CHUNK, F.lit(0)) + 1, F.least(b - i * _CHUNK, F.lit(_CHUNK)) - F.greatest(a - i * _CHUNK, F.lit(0))
        )
        return F.when(a < b, F.array_join(F.transform(numbers, part), "")).otherwise(F.lit(""))

    hit = F.size("found") > 0
    made = {"text": F.when(hit, _named(chunks, lambda c: kept(F.col("found"), c))).otherwise(F.col("text"))}
    redone = scanned.select("row", "found", made["text"].alias("text"))
    if "n_chars" in docs.columns:
        made["n_chars"] = F.when(hit, F.length("text")).otherwise(F.col("row.n_chars")).cast(docs.schema["n_chars"].dataType)
    made["text"] = F.col("text")
    return redone.select(*[made.get(c, F.col("row")[c]).alias(c) for c in docs.columns])
