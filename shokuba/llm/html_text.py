"""Main text of web pages by line-block distribution."""

from __future__ import annotations

import html
import itertools
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shokuba.llm.common import text_or_empty

_RAW = "script|style|noscript|template|iframe|svg|textarea|select|button|title"
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({_RAW})\b(?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-z][a-z0-9:-]*)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?][^>]*>|<[a-z/!][^<>]*\Z",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"([a-z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|\b(hidden)\b", re.I)
_HAS = re.compile(r"\b(?:has|with|without|no)[-_][\w-]+", re.I)  # says what else the page has
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody tfoot thead tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_DROP = frozenset("nav aside footer form menu dialog search".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form note".split())
_COMMENT = frozenset("comment comments commentlist reply replies respond disqus discussion".split())
_NAMES = _COMMENT | frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion nav navbar navigation menu "
    "menubar breadcrumb breadcrumbs sidebar footer masthead notice notices cookie cookies consent gdpr newsletter subscribe signup login "
    "popup modal overlay share sharing social related recommended recommendations widget toolbar pagination pager copyright disclaimer".split()
)
_SAFE = frozenset("html body main article".split())
_PARTS = frozenset("article main section div footer body h1 h2 p".split())

_SENTENCE = re.compile(r"[.!?:;…。！？][\"'”’»)\]]*\Z")
_COPYRIGHT = re.compile(r"©|\(c\)\s*\d{4}|copyright|all rights reserved", re.I)

WINDOW = 3  # lines
SURGE = 40  # characters in a window


def _attributes(raw: str) -> dict[str, str]:
    return {(m[1] or m[5]).lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(raw)}


def _unwanted(tag: str, raw: str, inside: bool) -> str:
    """Why an element is left out: comment, name or tag; empty if it isn't. inside: within an article or main part."""
    if tag in _DROP or tag == "header" and not inside:
        return "tag"
    if not raw.strip():
        return ""
    a = _attributes(raw)
    if "hidden" in a or a.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", a.get("style", "")):
        return "tag"
    if a.get("role", "").lower() in _ROLES and tag not in _SAFE:
        return "tag"
    names = {x.lower() for x in _PART.findall(_HAS.sub(" ", f"{a.get('class', '')} {a.get('id', '')}"))}
    if names & _COMMENT:
        return "comment"
    if tag in _SAFE:
        return ""
    return "name" if names & _NAMES or ("header" in names and not inside) else ""


def _ends(tokens: list) -> list[int]:
    """Of each opening token the index of the one that ends its element: its own end, or what implies it (the next block
    after a paragraph); -1 if none does. One pass with a stack for each tag."""
    ends, opened = [-1] * len(tokens), {}
    for i, (_, slash, name, _) in enumerate(tokens):
        if name in _BLOCK and not (slash and name == "p"):
            for at in opened.pop("p", ()):
                ends[at] = i - 1
        own = opened.setdefault(name, [])
        if not slash:
            own.append(i)
        elif own:
            ends[own.pop()] = i
    return ends


def lines_of(page: str) -> list[tuple[str, int, bool]]:
    """Lines of a page without markup: text, characters outside links, within an article or main part or not.

    What isn't content leaves empty lines: as many as a window outside of the main part, one within it.
    """
    tokens, texts, at = [], [], 0
    for m in _TOKEN.finditer(page):
        texts.append(page[at : m.start()])
        tokens.append((m, m[2] or "", (m[3] or "").lower(), m[4] or ""))
        at = m.end()
    texts.append(page[at:])
    ends, n = _ends(tokens), len(tokens)
    mains = [0, *itertools.accumulate(int(t[2] in ("article", "main") and not t[1]) for t in tokens)]  # opened before each token
    parts = [n] * (n + 1)  # where the next part starts
    for j in range(n - 1, -1, -1):
        parts[j] = j if tokens[j][2] in _PARTS else parts[j + 1]
    lines: list[tuple[str, int, bool]] = []
    words: list[str] = []
    plain = main = link = 0

    def close(gap: int = 0) -> None:
        nonlocal plain, link
        text = " ".join(html.unescape("".join(words)).split())
        if text:
            lines.append((text, min(plain, len(text)), main > 0))
        words.clear()
        plain = link = 0  # a link that is never closed ends with its block
        lines.extend([("", 0, main > 0)] * gap)

    i, skip_to = 0, -1
    for i, text in enumerate(texts):
        if i > skip_to and text:
            words.append(text)
            if not link:
                plain += len(text.strip())
        if i == len(tokens):
            break
        if i <= skip_to:
            continue
        m, slash, tag, raw = tokens[i]
        if not tag:
            continue
        if slash:
            if tag in ("article", "main"):
                close(WINDOW * (main == 1))
                main = max(0, main - 1)
            elif tag == "a":
                link = 0
            elif tag in _BLOCK:
                close()
            elif tag in ("td", "th"):
                words.append(" ")
            continue
        why = _unwanted(tag, raw, main > 0) if tag not in _VOID and not raw.endswith("/") else ""
        if why:
            end = ends[i]
            holds_main = why != "comment" and mains[end if end >= 0 else n] > mains[i + 1]
            whole = tag == "form" and end >= 0 and 2 * (tokens[end][0].start() - m.end()) > len(page)  # a form around the page
            if end < 0:  # never closed: up to the next part
                end = parts[i + 1] - 1 if parts[i + 1] < n else n
                holds_main = why != "comment" and mains[min(end, n)] > mains[i + 1]
            if not holds_main and not whole:
                close(1 if main else WINDOW)
                skip_to = end
                continue
        if tag in ("article", "main"):
            close(WINDOW * (main == 0))
            main += 1
        elif tag == "a":
            link = int(not raw.endswith("/") and bool(_attributes(raw).get("href")))
        elif tag in ("br", "td", "th"):
            words.append(" ")
        elif tag in _BLOCK:
            close()
    close()
    return lines


def trimmed(region: list[tuple[str, int, bool]]) -> list[tuple[str, int, bool]]:
    """A stretch of lines without what its window let in at its ends: outside of the main part, links alone before it, and
    after it short lines that end no sentence and copyright notes."""
    first, last = 0, len(region)
    while first < last and not region[first][1] and not region[first][2]:
        first += 1
    while first < last - 1 and not region[last - 1][2] and (region[last - 1][1] < SURGE and not _SENTENCE.search(region[last - 1][0]) or _COPYRIGHT.search(region[last - 1][0])):
        last -= 1
    return region[first:last]


def main_text(page: str) -> str:
    """Main text of one page: its blocks in page order, parted by an empty line; empty if there is none.

    The text lengths of each WINDOW lines are summed. Text begins where this sum surges over SURGE, or over the page's
    largest sum where that is less, and ends where it dives to nothing, less what the windows let in at its ends (trimmed);
    what lies between is kept, short lines too, and so are short lines between two such stretches. Where an article or main part holds a quarter of the kept text or more,
    only that part counts, with all its lines.
    """
    lines = lines_of(page)
    sums = [sum(x[1] for x in lines[i : i + WINDOW]) for i in range(len(lines))]
    if not any(x[0] for x in lines):
        return ""
    if not any(sums):  # links only
        return ""
    surge = min(SURGE, max(sums))
    regions: list[tuple[int, list[tuple[str, int, bool]]]] = []
    region: list[tuple[str, int, bool]] = []
    peak = 0
    for line, total in zip([*lines, ("", 0, False)], [*sums, 0]):
        if total:
            region.append(line)
            peak = max(peak, total)
            continue
        if region := trimmed(region):
            regions.append((peak, region))
        region, peak = [], 0
    surged = [i for i, (peak, _) in enumerate(regions) if peak >= surge]
    kept = [x for _, region in regions[surged[0] : surged[-1] + 1] for x in region if x[0]]
    if 4 * sum(len(x[0]) for x in kept if x[2]) >= sum(len(x[0]) for x in kept):
        kept = [x for x in lines if x[0] and x[2]] or kept
    return "\n\n".join(x[0] for x in kept)


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points): one row per row of `pages`, from its whole html.

    Null and empty html, and pages without text, give an empty text. Broken markup is read as far as it goes: an
    element that is never closed ends at the next part. A map without shuffle; other columns are ignored.
    """

    @F.arrow_udf("string")
    def extract(pages: pa.Array) -> pa.Array:
        return pa.array((main_text(x.as_py()) for x in pages), pa.string())

    out = pages.select("page_id", "url", extract(text_or_empty("html")).alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))
