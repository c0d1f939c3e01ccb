"""Main text of web pages by the maximum-scoring run of tokens.

A page is a sequence of text pieces and tags. The words of a piece score by the
element around it, a tag scores negative; both scores are log odds of lying inside
the main content, learned from pages that mark it (``article`` or ``main``) in a
bounded sample. A linear scan finds the contiguous run with the highest sum: the
content region. Elements inside it that are never article text (menus, forms,
adverts, comments, ...) are left out of the result. Without a page that marks its
content every word scores 1 and every tag -3.25.

The result joins the region's blocks by one line feed. White space in a block is
one space, character references are decoded, a line break ends a block.

Cases: null and empty pages, and pages without a word, give an empty text. Tags
that are never closed end with the element around them; an unclosed comment or
script runs to the page's end, and a lone < is text. Ties go to the earliest run.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinara.llm.common import shared, small_batches, texts_of, tidy

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>"
    r"|<(script|style|noscript|template|textarea|select|svg|iframe|object|canvas|head)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-z][a-z0-9:-]*)((?>[^<>\"']+|\"[^\"]*\"|'[^']*')*+)>"
    r"|[^<]+|<",
    re.S | re.I,
)
TEXT = re.compile(r"[^<]+|<")
CLASS = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
# fixed values: HTML's elements by kind
INLINE = frozenset("b i u s em strong span font small big mark sub sup abbr cite code q time kbd samp var tt ins del dfn bdi bdo wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NEVER = frozenset("nav footer aside form button menu dialog fieldset label option".split())
NEVER_CLASS = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|cookie\w*|consent|notice\w*|popup|modal|newsletter|subscribe|share|sharing|social|"
    r"sidebar|menu|nav|navigation|navbar|breadcrumbs?|footer|comments?|commentlist|replies|disqus|related|recommended|login|search|contentinfo|complementary)(?:$|[\s_-])",
    re.I,
)
DEFAULT_WORD, DEFAULT_TAG = 1.0, -3.25
MOST_ODDS = 4.0
LEAST_TAG = -1.0
NEVER_WORD, NEVER_TAG = -0.25, -0.05  # in elements that are left out anyway: what lies behind them may belong to the text


def matches(page: str):
    """The tokens' matches, each character looked at a bounded number of times.

    Behind the last > there is no tag: nothing is searched for its end there, so that
    many beginnings of tags without an end do not each look through the rest.
    """
    limit = page.rfind(">") + 1
    last = None
    for m in TOKEN.finditer(page, 0, limit):
        if last is not None:
            yield last
        last = m
    start = limit
    if last is not None and not last.group().startswith("<"):
        start = last.start()  # text that goes on
    elif last is not None:
        yield last
        if not ended(last):
            return
    stop = page.find("<!--", limit)
    yield from TEXT.finditer(page, start, len(page) if stop < 0 else stop)


def ended(m: re.Match) -> bool:
    """Whether a comment or an element of raw text has its end; anything else has."""
    piece = m.group()
    if piece.startswith("<!--"):
        return piece.endswith("-->") and len(piece) > 6
    if not m.group(1):
        return True
    inner = piece[piece.find(">") + 1 :]
    return bool(re.fullmatch(rf"</{m.group(1)}\s*>", inner[inner.rfind("<") :], re.I)) if "<" in inner else False


def tokens(page: str):
    """(kind, name, text) of a page in order: kind 0 is text inside element ``name``, 1 an opening and 2 a closing tag.

    Also whether the token lies in an element that is never article text, and whether in a marked content element.
    An open element knows the nearest one around that is not inline, and each name its
    open elements, so neither text nor a closing tag looks through all that are open.
    """
    outside = ("", "", False, False)
    open_: list[tuple[tuple[str, str, bool, bool], tuple[str, str, bool, bool]]] = []
    places: dict[str, list[int]] = {}
    for m in matches(page):
        name = m.group(3) if m.re is TOKEN else None
        if name is None:
            piece = m.group()
            if m.re is TOKEN and (m.group(1) or piece.startswith(("<!", "<?"))):
                continue
            around = open_[-1][1] if open_ else outside
            yield 0, around[1], piece, around[2], around[3]
            continue
        name = name.lower()
        if m.group(2):
            mark = (name, name, False, False)
            if places.get(name):
                at = places[name][-1]
                mark = open_[at][0]
                while len(open_) > at:
                    places[open_.pop()[0][0]].pop()
            yield 2, "/" + mark[1], name, mark[2], mark[3]
            continue
        kinds = " ".join(x for g in CLASS.findall(m.group(4)) for x in g if x)
        words = kinds.split(None, 1)
        label = f"{name}.{words[0].lower()}" if words else name
        last = open_[-1][0] if open_ else outside
        content = last[3] or name in ("article", "main") or "articlebody" in m.group(4).lower()
        never = last[2] or name in NEVER or (name == "header" and not last[3]) or bool(kinds and name not in ("html", "body", "article", "main") and NEVER_CLASS.search(kinds))
        yield 1, label, name, never, content
        if name not in VOID and not m.group(4).endswith("/"):
            own = (name, label, never, content)
            around = own if name not in INLINE else open_[-1][1] if open_ else outside
            places.setdefault(name, []).append(len(open_))
            open_.append((own, around))


def counts(page: str) -> Counter:
    """How often words around each element and each tag lie inside and outside of marked content."""
    seen, marked = Counter(), False
    for kind, label, text, never, content in tokens(page):
        inside = content and not never
        marked |= inside
        if kind == 0:
            n = len(text.split())
            if n:
                seen["w:" + label, inside] += n
        elif text not in INLINE:
            seen["t:" + label, inside] += 1
    return seen if marked else Counter()


def region(parts: list[tuple[float, bool]]) -> tuple[int, int]:
    """First and last + 1 of the run with the highest sum; (0, 0) if no sum is positive."""
    best, begin, end, total, start = 0.0, 0, 0, 0.0, 0
    for i, score in enumerate(parts):
        if total <= 0:
            total, start = 0.0, i
        total += score
        if total > best:
            best, begin, end = total, start, i + 1
    return begin, end


def extract(page: str, weights: dict[str, float]) -> str:
    parts, scores = [], []
    for part in tokens(page):
        kind, label, text, never, _ = part
        if kind == 0:
            n = len(html.unescape(text).split())
            score = n * (NEVER_WORD if never else weights.get("w:" + label, weights.get("w:" + label.split(".")[0], DEFAULT_WORD)))
        elif text in INLINE:
            score = 0.0
        elif never:
            score = NEVER_TAG
        else:
            score = weights.get("t:" + label, weights.get("t:" + label.split(".")[0], DEFAULT_TAG if not weights else -0.5))
        parts.append(part)
        scores.append(score)
    begin, end = region(scores)
    blocks, current = [], []
    for kind, _, text, never, _ in parts[begin:end]:
        if kind == 0:
            if not never:
                current.append(text)
        elif text not in INLINE and text != "a":
            blocks.append("".join(current))
            current = []
    blocks.append("".join(current))
    clean = (" ".join(html.unescape(b).split()) for b in blocks)
    return "\n".join(b for b in clean if b)


def fit(pages: DataFrame, key: str = "page_id", page: str = "html", most_pages: int = 2000) -> dict[str, float]:
    """Log odds of words by element and of tags, from at most about ``most_pages`` pages drawn by a hash of key and page."""
    rows = pages.select(F.col(page).alias("page"), F.xxhash64(F.col(key), F.col(page)).alias("draw")).where(F.col("page").isNotNull())
    rate = min(1.0, most_pages / max(pages.count(), 1))
    rows = rows.where(F.shiftrightunsigned("draw", 1) <= int(rate * ((1 << 63) - 1024))).limit(2 * most_pages)

    def counted(batches):
        total = Counter()
        for batch in batches:
            for text in texts_of(batch.column("page")):
                total.update(counts(text))
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in total], pa.string()), pa.array([k[1] for k in total], pa.bool_()), pa.array(list(total.values()), pa.int64())], ["token", "inside", "n"])

    found = rows.select("page").mapInArrow(tidy(counted), "token string, inside boolean, n long")
    found = found.groupBy("token").agg(F.sum(F.when(F.col("inside"), F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("inside"), 0).otherwise(F.col("n"))).alias("b"))
    found = found.orderBy(F.desc(F.col("a") + F.col("b")), "token").limit(5000).collect()
    weights = {}
    for kind in "wt":
        own = [r for r in found if r["token"].startswith(kind + ":")]
        inside, outside = (sum(r[c] for r in own) + 1.0 for c in "ab")
        for r in own:
            odds = math.log((r["a"] + 0.5) / inside) - math.log((r["b"] + 0.5) / outside)
            odds = max(-MOST_ODDS, min(MOST_ODDS, odds))
            weights[r["token"]] = odds if kind == "w" else max(LEAST_TAG, min(odds, -0.05))
    return weights


def main_text(pages: DataFrame, weights: dict[str, float], page: str = "html", name: str = "text") -> DataFrame:
    """Add the main text of every page. One pass, no shuffle."""
    small_batches(pages.sparkSession)
    load = shared(pages.sparkSession, weights)
    pages = pages.drop(name)
    schema = pages.withColumn(name, F.lit("")).schema

    def extracted(batches):
        for batch in batches:
            yield batch.append_column(name, pa.array([extract(t, load()) for t in texts_of(batch.column(page))], pa.string()))

    return pages.mapInArrow(tidy(extracted), schema)
