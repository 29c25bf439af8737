"""Main text of web pages: differenced with the nearest URL, then held against what elements say they are."""

from __future__ import annotations

import re
from bisect import bisect_right
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillscope.session import stage

# Element names of HTML by their role here, and words of class and id names.
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_RAW = set("script style textarea title noscript template iframe svg math xmp".split())
_BLOCK = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody td "
    "tfoot th thead tr ul caption".split()
)
_DROPPED = set("head nav header footer aside menu form select button dialog object canvas audio video datalist".split())
_WORDS = set(
    "ad ads adv advert advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice "
    "alert sidebar aside menu nav navbar navigation breadcrumb breadcrumbs header masthead footer copyright comment comments "
    "disqus reply replies respond share sharing social related recommended subscribe newsletter signup login popup modal "
    "overlay widget toolbar pagination pager skip".split()
)
_ROLES = set("navigation banner contentinfo complementary search form menu menubar alert dialog alertdialog toolbar".split())
#: What an open element of the key is closed by, besides its end tag.
_CLOSED_BY = {
    "p": _BLOCK - {"option"},
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "tr": {"tr", "tbody", "tfoot"},
    "td": {"td", "th", "tr", "tbody", "tfoot"},
    "th": {"td", "th", "tr", "tbody", "tfoot"},
    "option": {"option"},
    "head": {"body"},
}
_SCOPES = {"p": {"article", "aside", "body", "div", "li", "main", "section", "td", "th", "table", "blockquote"}, "li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}}
_TAG = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

PLAIN, ARTICLE, MAIN, MARKED = 0, 1, 2, 3
#: What only words of class or id name as boilerplate; whether it is, the whole page tells.
_NAMED = 4


def _mark(tag: str, attributes: str) -> int:
    """How an element's start tag marks what it holds."""
    if tag in _DROPPED:
        return MARKED
    found = {}
    if attributes.strip():
        found = {m[1].lower(): next((g for g in m.groups()[1:] if g is not None), "") for m in _ATTRIBUTE.finditer(attributes)}
    role = found.get("role", "").lower()
    if tag not in ("html", "body", "main") and found:
        hidden = "hidden" in found or found.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", found.get("style", ""))
        if role in _ROLES or hidden:
            return MARKED
    if tag == "article" or role == "article":
        return ARTICLE
    if tag == "main" or role == "main":
        return MAIN
    words = {w.lower() for key in ("class", "id") for w in _NAME.findall(found.get(key, ""))}
    return _NAMED if tag not in ("html", "body") and words & _WORDS else PLAIN


def _settled(lines: list[tuple[int, str, tuple[int, ...]]]) -> list[tuple[int, str]]:
    """Lines with their marks, given the named elements around each.

    An element named as boilerplate is a wrapper, and its name says nothing, if it holds most
    of the text in article or main elements (without them, most of the text), or if no such
    text would be left.
    """
    core = [r for r in lines if r[0] in (ARTICLE, MAIN)] or [r for r in lines if r[0] != MARKED]
    held: dict[int, int] = {}
    for _, text, named in core:
        for n in named:
            held[n] = held.get(n, 0) + len(text)
    total = sum(len(text) for _, text, _ in core)
    wrappers = {n for n, size in held.items() if 2 * size > total}
    if all(set(named) - wrappers for _, _, named in core):
        wrappers = set(held)
    return [(MARKED if set(named) - wrappers else mark, text) for mark, text, named in lines]


def blocks(html: str | None) -> list[tuple[int, str]]:
    """The visible lines of a page, one for each block, in page order, with their marks.

    Scripts, styles, comments and the head are left out; character references are decoded after
    the markup is gone; white space within a block, line breaks included, becomes one space.
    Missing end tags are supplied as browsers do. Null or empty gives no line.
    """
    if not html:
        return []
    lines: list[tuple[int, str, tuple[int, ...]]] = []
    # marks, and the numbers of the named elements around
    outside: tuple[int, tuple[int, ...]] = (PLAIN, ())
    stack: list[tuple[str, tuple[int, tuple[int, ...]]]] = []
    held: list[str] = []
    now = outside

    def flush() -> None:
        if held:
            line = " ".join(unescape("".join(held)).split())
            held.clear()
            if line:
                lines.append((now[0], line, now[1]))

    def shut(at: int) -> None:
        nonlocal now
        flush()
        del stack[at:]
        now = stack[-1][1] if stack else outside

    at, end = 0, len(html)
    while at < end:
        m = _TAG.search(html, at)
        if m is None:
            held.append(html[at:])
            break
        if m.start() > at:
            held.append(html[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if tag in _BLOCK:
                flush()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    if tag in _BLOCK or stack[i][1] != (stack[i - 1][1] if i else outside):
                        shut(i)
                    else:
                        del stack[i]
                    break
            continue
        if tag in _RAW:
            close = re.compile(rf"</{tag}\s*>", re.I).search(html, at)
            at = close.end() if close else end
            continue
        if tag == "br":
            held.append(" ")
        if tag in _BLOCK:
            flush()
            for i in range(len(stack) - 1, -1, -1):
                name = stack[i][0]
                if tag in _CLOSED_BY.get(name, ()):
                    shut(i)
                    break
                if name in _SCOPES.get(tag, ()) or name in ("table", "article", "body") or tag not in ("li", "dt", "dd", "tr", "td", "th") and name in _BLOCK:
                    break
        if tag in _VOID or m[3].endswith("/") and tag not in _BLOCK:
            continue
        mark = _mark(tag, m[3])
        outer = now
        # a mark holds for what is inside, and boilerplate marks win
        if mark == _NAMED:
            inner = outer if outer[0] == MARKED else (outer[0], (*outer[1], m.start()))
        else:
            inner = outer if outer[0] == MARKED or mark == PLAIN or (outer[0] == ARTICLE and mark == MAIN) else (mark, outer[1])
        if inner != outer:
            flush()
        stack.append((tag, inner))
        now = inner
    flush()
    return _settled(lines)


def _lengths(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequences of ``a`` and every prefix of ``b``."""
    row = np.zeros(len(b) + 1, np.int32)
    for x in a:
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + (b == x)))
    return row


def _align(a: np.ndarray, b: np.ndarray, at: int, out: list[int]) -> None:
    """Add to ``out`` the places of ``a`` (from ``at``) on one longest common subsequence; memory is linear."""
    if not len(a) or not len(b):
        return
    if len(a) == 1:
        if (b == a[0]).any():
            out.append(at)
        return
    half = len(a) // 2
    split = int((_lengths(a[:half], b) + _lengths(a[half:][::-1], b[::-1])[::-1]).argmax())
    _align(a[:half], b[:split], at, out)
    _align(a[half:], b[split:], at + half, out)


def shared(lines: list[str], others: list[str]) -> set[int]:
    """The places of ``lines`` on a longest common subsequence with ``others``."""
    both = {line: i for i, line in enumerate(set(lines) & set(others))}
    at = [i for i, line in enumerate(lines) if line in both]
    a = np.array([both[lines[i]] for i in at], np.int32)
    b = np.array([both[line] for line in others if line in both], np.int32)
    found: list[int] = []
    _align(a, b, 0, found)
    return {at[i] for i in found}


#: The least share of a page's unmarked text that another page must not share to serve as its frame.
FAIR = 0.2


def main_text(lines: list[tuple[int, str]], *others: list[tuple[int, str]] | None) -> str:
    """The text of a page, given the lines of the pages near it, the nearest first.

    Every page is differenced with the nearest page that is no near copy; a near copy leaves
    less than ``FAIR`` of the unmarked text unshared. The lines they do not share are the page's
    own and tell where its text is. If at least half of it is inside article and main elements,
    these hold the text, whole: a line that two articles share is their text and not their frame.
    If not, they are a part of it at most: the own lines beside them are text, and they too, unless
    all that they hold is shared and so frame. If all pages near are near copies, or there is none,
    nothing can be told from a frame, and the elements decide alone. Marked lines are never text.
    """
    inside = [t for mark, t in lines if mark in (ARTICLE, MAIN)]
    whole = sum(len(t) for mark, t in lines if mark != MARKED)
    for other in others:
        if other:
            gone = shared([t for _, t in lines], [t for _, t in other])
            own = [(mark, t) for i, (mark, t) in enumerate(lines) if mark != MARKED and i not in gone]
            within = sum(len(t) for mark, t in own if mark != PLAIN)
            beside = sum(len(t) for mark, t in own if mark == PLAIN)
            if own and within + beside >= FAIR * whole:
                if within >= beside:
                    return "\n".join(inside)
                return "\n".join(t for i, (mark, t) in enumerate(lines) if mark == PLAIN and i not in gone or within and mark in (ARTICLE, MAIN))
    return "\n".join(inside or [t for mark, t in lines if mark == PLAIN])


_URL = re.compile(r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)([^?#]*)")


def place(url: str | None) -> tuple[str, str]:
    """Host (lower case) and path of a URL; what has no host is all path."""
    m = _URL.match(url or "")
    return (m[1].lower(), m[2]) if m else ("", url or "")


def _near(path: str, other: str) -> int:
    n = 0
    for x, y in zip(path, other):
        if x != y:
            break
        n += 1
    return n


def extract(pages: DataFrame, per_part: int = 500, most_parts: int = 20_000, reach: int = 4) -> DataFrame:
    """page_id, url, text and n_chars of every page.

    Pages are ordered by host, path and id and cut into parts of about ``per_part`` pages (more
    where there would be over ``most_parts``; a task streams through its part) at sampled keys,
    so a host may have any share of them. The first and last ``reach`` pages of a part also
    go to the parts beside it; so each page meets its true neighbours in this order, ``reach`` on
    either side, of which those of its host that share more of its path (a tie: the closer, then
    the earlier) are nearer. Only the sampled keys and twice ``reach`` keys of each part come to
    the driver. Repeated rows are pages of
    their own; a page alone on its host is not differenced.
    """
    number = pages.schema["page_id"].dataType.simpleString()
    keyed_by = "host string, path string, id string"

    def keys(batches):
        for batch in batches:
            made = [place(u.as_py()) for u in batch.column("url")]
            yield pa.RecordBatch.from_pydict(
                {
                    "host": pa.array([h for h, _ in made], pa.string()),
                    "path": pa.array([p for _, p in made], pa.string()),
                    "id": batch.column("id"),
                }
            )

    named = pages.select("url", F.coalesce(F.col("page_id").cast("string"), F.lit("")).alias("id"))
    keyed = stage(named.mapInArrow(keys, keyed_by), "page-keys")
    total = keyed.count()
    parts = min(most_parts, max(1, -(-total // per_part)))
    share = F.lit(int(min(1.0, 20 * parts / max(total, 1)) * (1 << 30)))
    drawn = sorted(tuple(r) for r in keyed.where(F.pmod(F.xxhash64("host", "path", "id"), F.lit(1 << 30)) < share).collect())
    bounds = [drawn[len(drawn) * i // parts] for i in range(1, parts)] if drawn else []

    def numbered(batches):
        for batch in batches:
            rows = zip(*[batch.column(c).to_pylist() for c in ("host", "path", "id")])
            part = pa.array([bisect_right(bounds, r) for r in rows], pa.int32())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("host", "path", "id")], part], names=["host", "path", "id", "part"])

    listed = keyed.mapInArrow(numbered, keyed_by + ", part int").distinct()
    first = Window.partitionBy("part").orderBy("host", "path", "id")
    last = Window.partitionBy("part").orderBy(F.desc("host"), F.desc("path"), F.desc("id"))
    ends = listed.withColumn("low", F.row_number().over(first)).withColumn("high", F.row_number().over(last))
    lows: dict[int, list[tuple]] = {}
    highs: dict[int, list[tuple]] = {}
    for *own, part, low, high in ends.where((F.col("low") <= reach) | (F.col("high") <= reach)).collect():
        lows.setdefault(part, []).extend([tuple(own)] if low <= reach else [])
        highs.setdefault(part, []).extend([tuple(own)] if high <= reach else [])
    held = sorted(lows)
    guests: dict[tuple, list[int]] = {}
    for at, part in enumerate(held):
        for beside, found in ((held[at - 1 :: -1] if at else [], highs), (held[at + 1 :], lows)):
            n = 0
            for other in beside:
                near = sorted(found[other], reverse=found is highs)[: reach - n]
                n += len(near)
                for own in near:
                    guests.setdefault(own, []).append(part)
                if n == reach:
                    break

    fields = pa.schema(
        [("part", pa.int32()), ("guest", pa.bool_()), ("host", pa.string()), ("path", pa.string()), ("id", pa.string()), ("row", pa.int32()), ("url", pa.string()), ("marks", pa.binary()), ("lines", pa.list_(pa.string()))]
    )

    def parsed(batches):
        for batch in batches:
            made: list[tuple] = []
            for row, (url, html) in enumerate(zip(batch.column("url").to_pylist(), batch.column("html"))):
                lines = blocks(html.as_py())
                own = (*place(url), batch.column("id")[row].as_py())
                marks, texts = bytes(m for m, _ in lines), [t for _, t in lines]
                made.append((bisect_right(bounds, own), False, *own, row, url, marks, texts))
                made += [(p, True, *own, row, url, marks, texts) for p in guests.get(own, ())]
                if len(made) >= 256:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made), fields)], schema=fields)
                    made = []
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made), fields)], schema=fields)

    schema = f"part int, guest boolean, {keyed_by}, row int, url string, marks binary, lines array<string>"
    read = pages.select("url", "html", F.coalesce(F.col("page_id").cast("string"), F.lit("")).alias("id")).mapInArrow(parsed, schema)
    ordered = read.repartition(parts, "part").sortWithinPartitions("part", "host", "path", "id", "url", "row")

    def texts(batches):
        # the pages around the one that is answered, which is at ``at``
        around: list[tuple] = []
        at = 0
        for batch in batches:
            made: list[tuple] = []
            columns = [batch.column(c) for c in ("part", "guest", "host", "path", "id", "url", "marks", "lines")]
            for i in range(batch.num_rows):
                part, guest, host, path, id_, url, marks, lines = (c[i].as_py() for c in columns)
                around.append((part, guest, host, path, id_, url, list(zip(marks, lines))))
                if len(around) > at + reach:
                    made += answered(around, at)
                    at += 1
                    if at > reach:
                        around, at = around[1:], reach
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*made)], names=["id", "url", "text"])
        if made := [row for i in range(at, len(around)) for row in answered(around, i)]:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*made)], names=["id", "url", "text"])

    def answered(around: list[tuple], at: int) -> list[tuple]:
        now = around[at]
        if now[1]:
            return []
        span = range(max(0, at - reach), min(len(around), at + reach + 1))
        beside = [i for i in span if i != at and around[i][0] == now[0] and around[i][2] == now[2]]
        beside.sort(key=lambda i: (-_near(now[3], around[i][3]), abs(i - at), i))
        return [(now[4], now[5], main_text(now[6], *[around[i][6] for i in beside]))]

    made = ordered.mapInArrow(texts, "id string, url string, text string")
    page_id = F.when(F.col("id") != "", F.col("id")).cast(number)
    return made.select(page_id.alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"))
