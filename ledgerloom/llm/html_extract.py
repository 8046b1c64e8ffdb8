"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags by one forward scan. First pass, from the
block alone: link density, length and the density of stop words make a block good, bad,
near-good or short. Containers add evidence: a block in a menu, header, footer, sidebar,
notice, advert, form or comment container is bad whatever its text; on a page that has an
article or main container, so is a block outside it, and inside it a block is never bad
for its links or its few stop words, only near-good. Second pass: near-good and short
blocks take the label of the nearest decided blocks before and after; where these disagree
the block is bad, but a heading takes that of the block after it. In an article only
decided blocks of articles count as neighbours, and without any the block is good.
Class names of what holds an article do not make it bad.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Frequent function words of the four languages.
STOP_WORDS = frozenset(
    """the of and to in a is that it for on was be with by are this from or an as at not have has he she they we you his her their its but which who will would can
    der die das und in zu den von mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie über
    le la les de des du un une et à en que qui dans pour pas sur au avec ce il est par plus ne se son sa ses ou mais nous vous ils elle été aux cette
    el los las del y a en un una es que por con no para su al lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre ser""".split()
)
LENGTH_LOW, LENGTH_HIGH = 70, 200
STOPS_LOW, STOPS_HIGH = 0.08, 0.15
LINKS_MOST = 0.4

_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul br".split())
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_SKIP = "script|style|noscript|template|svg|iframe|select|textarea|button|title|object|canvas|math|audio|video|datalist"
_IN_HEAD = frozenset("html head base basefont bgsound link meta noframes".split())
_GOOD = frozenset(("article", "main"))
_BAD = frozenset("nav header footer aside form menu dialog head fieldset".split())
_HINT = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|adv|advert\w*|adsense|banner|sponsor\w*|promo\w*|sidebar|side|menu|nav\w*|breadcrumbs?|header|masthead|footer|comments?|disqus|replies|reply|cookies?|consent|gdpr|notice|popup|modal|overlay|newsletter|subscribe|subscription|share|sharing|social|related|recommended|widget|copyright|legal|login|signup|search|form|pagination|pager|tags)(?:$|[\s_-])",
    re.I,
)
#: Hints at lists whose items may be articles themselves.
_LISTS = re.compile(r"(?:^|[\s_-])(?:comments?|disqus|replies|reply|related|recommended|promo\w*|sponsor\w*|widget)(?:$|[\s_-])", re.I)
_NAME = re.compile(r"[a-zA-Z][a-zA-Z0-9:-]*+")
#: What follows a tag's name, to its end; a quote counts only as a value. Nothing is tried twice.
_REST = re.compile(r"""[^>=]*+(?:=\s*+(?:"[^"]*+"|'[^']*+')?+[^>=]*+)*+>""")
_END_OF = {tag: re.compile(rf"</{tag}\s*+>", re.I) for tag in _SKIP.split("|")}
_ATTR = re.compile(r"""\b(class|id|role|aria-label|hidden|style)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)


def _kind(tag: str, rest: str) -> int:
    """1: an article or main container; 2: one whose own class or id has a hint; -1: one of boilerplate; -2, -3: by a hint of its class or id alone, -3 for lists; 0: neither."""
    if tag in _BAD:
        return -1
    kind, hint = 1 if tag in _GOOD else 0, 0
    if rest and tag not in ("html", "body"):
        for name, value in _ATTR.findall(rest):
            name, value = name.lower(), value.strip("\"'")
            if name == "hidden" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
                return -1
            if name in ("class", "id", "role", "aria-label"):
                if kind == 0 and name == "role" and value.lower() in ("navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert"):
                    return -1
                if kind == 0 and name == "role" and value.lower() in ("main", "article"):
                    kind = 1
                elif name != "role" and _HINT.search(value):
                    hint = min(hint, -3 if _LISTS.search(value) else -2)
    return hint if kind == 0 else 2 if hint else kind


def tags(page: str):
    """Text and tags of a page in one forward scan: (text, "", "", False) or ("", tag, rest, closing).

    Comments, declarations and elements whose content is no text are passed over. A
    comment, tag or such element that never ends takes the rest of the page, as in browsers.
    """
    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            yield page[at:], "", "", False
            return
        # a sign that opens nothing is text
        while lt + 1 < n and not (page[lt + 1] in "/!?" or page[lt + 1].isascii() and page[lt + 1].isalpha()):
            lt = page.find("<", lt + 1)
            if lt < 0:
                yield page[at:], "", "", False
                return
        if lt > at:
            yield page[at:lt], "", "", False
        closing = page.startswith("</", lt)
        name = _NAME.match(page, lt + 1 + closing)
        if name is None:
            ends = "-->" if page.startswith("<!--", lt) else "]]>" if page.startswith("<![CDATA[", lt) else ">"
            end = page.find(ends, lt + 1)
            at = n if end < 0 else end + len(ends)
            continue
        rest = _REST.match(page, name.end())
        if rest is None:
            return
        tag, at = name[0].lower(), rest.end()
        inner = rest[0][:-1]
        if not closing and tag in _END_OF:
            if not inner.endswith("/"):
                end = _END_OF[tag].search(page, at)
                at = n if end is None else end.end()
            continue
        yield "", tag, inner, closing


def blocks(page: str | None) -> list[dict]:
    """Blocks of a page in order: text, tag, link density, in_article, boilerplate."""
    found: list[dict] = []
    stack: list[tuple[str, int, tuple[int, int]]] = []  # tag, kind, hints and list hints that held before it
    open_tags: Counter = Counter()
    parts: list[str] = []
    linked = total = 0
    in_link, tag_now = False, ""
    bad = good = hints = lists = 0
    any_good = False

    def opened(tag: str, kind: int) -> None:
        nonlocal bad, good, hints, lists, any_good
        stack.append((tag, kind, (hints, lists)))
        open_tags[tag] += 1
        bad += kind == -1
        hints += kind == -2
        lists += kind == -3
        if kind > 0:
            if kind == 1:
                # class names around an article tell nothing of it, but a later article in a list of comments or the like is one of its items
                hints = 0
                lists = lists if any_good else 0
            good += 1
            any_good = any_good or not (bad or hints or lists)

    def left() -> str:
        nonlocal bad, good, hints, lists
        tag, kind, (hints, lists) = stack.pop()
        open_tags[tag] -= 1
        bad -= kind == -1
        good -= kind > 0
        return tag

    def close() -> None:
        nonlocal linked, total
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                found.append({"text": text, "tag": tag_now, "links": linked / max(total, 1), "in_article": good > 0, "boilerplate": bad + hints + lists > 0})
            parts.clear()
        linked = total = 0

    for piece, tag, rest, closing in tags(page or ""):
        in_head = stack and stack[-1][0] == "head"
        # the end tag of head can be left out
        if in_head and (piece.strip() if piece else not closing and tag not in _IN_HEAD):
            close()
            left()
        if piece:
            parts.append(piece)
            n = len(piece.strip())
            total += n
            linked += n * in_link
            continue
        if tag == "a":
            in_link = not closing
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag not in _BLOCK:
            kind = 0 if closing or tag in _VOID else _kind(tag, rest)
            if kind == 0 and not (closing and open_tags[tag]):
                continue
        close()
        in_link = False
        if closing:
            if open_tags[tag]:
                while left() != tag:
                    pass
            tag_now = stack[-1][0] if stack else ""
        else:
            if tag in ("p", "li", "td", "th", "tr", "dt", "dd", "option") or _heading(tag):
                while stack and stack[-1][0] == tag or stack and stack[-1][0] == "p":  # an open one of the same kind ends here
                    left()
            if tag not in _VOID:
                opened(tag, _kind(tag, rest))
            tag_now = tag
    close()
    return found


def _heading(tag: str) -> bool:
    return tag[:1] == "h" and tag[1:].isdigit()


def first_pass(b: dict, articles: bool) -> tuple[str, str]:
    """good, bad, near or short, and the rule that says so."""
    if b["boilerplate"]:
        return "bad", "boilerplate"
    if articles and not b["in_article"]:
        return "bad", "outside"
    worst = "near" if b["in_article"] else "bad"
    if b["links"] > LINKS_MOST:
        return worst, "links"
    n, words = len(b["text"]), b["text"].lower().split()
    if n < LENGTH_LOW:
        return "short" if b["links"] == 0 else worst, "length"
    stops = sum(w.strip(".,;:!?") in STOP_WORDS for w in words) / len(words)
    if stops >= STOPS_HIGH:
        return "good" if n > LENGTH_HIGH else "near", "stop words"
    return "near" if stops >= STOPS_LOW else worst, "stop words"


def second_pass(labels: list[str], found: list[dict]) -> list[bool]:
    """Undecided blocks inherit from the nearest decided ones."""
    n = len(labels)
    sides: list[list[tuple[str, str]]] = []  # before and after each block: the nearest label of all, the nearest in articles
    for order in (range(n), reversed(range(n))):
        seen, inside, out = "", "", [("", "")] * n
        for i in order:
            out[i] = (seen, inside)
            if labels[i] in ("good", "bad"):
                seen = labels[i]
                inside = labels[i] if found[i]["in_article"] and not found[i]["boilerplate"] else inside
        sides.append(out)
    keep = []
    for i, x in enumerate(labels):
        within = found[i]["in_article"]
        before, after = (s[i][within] for s in sides)
        if x in ("good", "bad"):
            keep.append(x == "good")
        elif within and not before and not after:
            keep.append(True)
        elif _heading(found[i]["tag"]) and (after or not within):
            keep.append(after == "good")
        else:
            near = {before, after} - {""}
            keep.append(near == {"good"} or x == "near" and ("good" in near or not near) or x == "short" and not near and n == 1)
    return keep


def decisions(page: str | None) -> list[tuple[str, str, str, bool]]:
    """Text, first label, rule and whether it is kept, of each block."""
    found = blocks(page)
    articles = any(b["in_article"] and not b["boilerplate"] for b in found)
    first = [first_pass(b, articles) for b in found]
    keep = second_pass([x for x, _ in first], found)
    return [(b["text"], x, rule, k) for b, (x, rule), k in zip(found, first, keep, strict=True)]


def main_text(page: str | None) -> str:
    return " ".join(text for text, _, _, kept in decisions(page) if kept)


def extract(html_col: Column) -> Column:
    @F.pandas_udf("string")
    def run(pages: pd.Series) -> pd.Series:
        return pd.Series([main_text(p) for p in pages], dtype=object)

    return run(html_col)


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, ``text``, ``n_chars`` of every row.

    Null and empty pages, and pages without main text, give an empty text; repeated rows
    each return; an empty table gives no rows; other columns are ignored.
    """
    out = pages.select("page_id", "url", extract(F.col("html")).alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))
