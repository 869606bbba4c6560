"""Main text of web pages by tag-path ratios.

A page is read once into text blocks, each with its root-to-leaf tag path. For every path the
length of its text and its punctuation, both per block, are summed up. The two ratios are
smoothed over the blocks in page order, fused, and compared with the page's strongest path. The
paths above the threshold give the content container: the article or main element that holds
all of them, or else the deepest element that holds all of them and doesn't stand among
headings and paragraphs. All its blocks are the main text, but for parts whose tag, class, id
or role names something else (menus, adverts, notices, comments and so on).

Pages are independent rows, so the work is a map over the table with bounded state.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_PART = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|template|textarea|svg|iframe|title|select|canvas)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<[!?/][^>]*>"
    r"|(?P<text>[^<]+|<)", re.S | re.I)
_ATTR = re.compile(r"\b(class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_SPACE = re.compile(r"[ \t\n\r\f\v\x85\xa0  -     　]+")
_PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？¡¿]")

# Fixed values of HTML: elements without content, elements that begin a new block, and the ones
# that an opening paragraph or item closes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer "
                   "form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary "
                   "table tbody td tfoot th thead tr ul".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
          "option": ("option",)}
SCOPES = frozenset("ul ol dl table article section main div body aside nav footer header form blockquote".split())
# Elements, and words of class, id or role, that name what isn't the article.
OTHER_TAGS = frozenset("nav header footer aside form button dialog menu head search label input".split())
OTHER_NAMES = frozenset("ad ads advert adverts advertisement advertising banner banners breadcrumb breadcrumbs byline-share comment "
                        "comments comentarios kommentare commentaires consent cookie cookies copyright disqus footer header login masthead menu "
                        "menus modal nav navbar navigation newsletter notice notices notification popup promo promoted promotion "
                        "recommended related replies reply respond share sharing sidebar sidebars signup skip social sponsor "
                        "sponsored subscribe subscription toolbar widget alert alerts discussion complementary contentinfo search "
                        "teaser teasers tags pagination pager feedback reviews".split())
# Words that say nothing by themselves, beside one of the names above.
NEUTRAL = frozenset("area bar block bottom box btn button buttons center container content fixed global group header icons inner item items left "
                    "link links list main mobile outer page panel post posts primary right row secondary section site sticky thread top "
                    "unit wrap wrapper zone".split())
REPLIES = frozenset("comment comments comentarios kommentare commentaires disqus replies reply respond discussion".split())
_WORDS = re.compile(r"[^\W\d_]+")
THRESHOLD = 0.15   # of the strongest block
CONTAINERS = frozenset("html body main article section div".split())


def _names_other(token: str) -> bool:
    """A whole token, or label, of nothing but names of other things and neutral words."""
    words = set(_WORDS.findall(token.lower()))
    return not words.isdisjoint(OTHER_NAMES) and words <= OTHER_NAMES | NEUTRAL


def _other(tag: str, attrs: str, in_article: bool = False) -> str:
    """"tag", "replies", "name" or empty: by what an element is something else than the article."""
    if tag in OTHER_TAGS:
        return "tag"
    if attrs and tag not in ("html", "body", "main", "article"):
        for kind, a, b, c in _ATTR.findall(attrs):
            kind, value = kind.lower(), a or b or c
            # Ids of headings are made from their text, and of sections within the article too.
            if kind == "id" and (tag in ("h1", "h2", "h3", "h4", "h5", "h6", "p") or tag == "section" and in_article):
                continue
            for token in [value] if kind == "aria-label" else value.split():
                if _names_other(token):
                    return "replies" if not REPLIES.isdisjoint(_WORDS.findall(token.lower())) else "name"
    return ""


def text_blocks(page: str) -> list[tuple[tuple[str, ...], str, str]]:
    """(tag path, text, what makes it something else) of every block in page order. The text has its
    character references decoded and its white space folded; blocks without text are left out.

    The last is empty for none, "tag" or "replies", or "name" with the number of the outermost
    element whose class, id, role or label says so."""
    stack: list[tuple[str, str, str]] = []   # tag, step of the path, within something else
    out: list[tuple[tuple[str, ...], str, str]] = []
    held: list[str] = []
    at: tuple[tuple[str, ...], str] | None = None

    def flush() -> None:
        nonlocal at
        if held:
            text = _SPACE.sub(" ", html.unescape("".join(held))).strip(" ")
            if text and at:
                out.append((at[0], text, at[1]))
            held.clear()
        at = None

    counter = 0
    for m in _PART.finditer(page):
        if (text := m["text"]) is not None:
            if at is None:
                at = tuple(s for t, s, _ in stack if t in BLOCKS), stack[-1][2] if stack else ""
            held.append(text)
            continue
        if (tag := m["tag"]) is None:
            continue
        tag = tag.lower()
        block = tag in BLOCKS
        if tag == "br":
            held.append(" ")
        if block:
            flush()
        if m["close"]:
            names = [t for t, _, _ in stack]
            if tag in names:
                i = len(names) - 1 - names[::-1].index(tag)
                # An inline end tag doesn't reach out of its block.
                if block or not any(t in BLOCKS for t in names[i + 1:]):
                    was = stack[i][2]
                    del stack[i:]
                    if not block and was != (stack[-1][2] if stack else ""):
                        flush()
            continue
        if block:
            # A block ends an open paragraph; an item ends the one before it.
            ends = ("p",) if tag not in CLOSES else CLOSES[tag]
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in ends:
                    del stack[i:]
                    break
                if stack[i][0] in SCOPES and not (tag in CLOSES and stack[i][0] == "p"):
                    break
        if tag in VOID or m["attrs"].endswith("/"):
            continue
        counter += 1
        inside = stack[-1][2] if stack else ""
        other = _other(tag, m["attrs"], any(t in ("article", "main") for t, _, _ in stack)) if inside not in ("tag", "replies") else ""
        if other == "name":
            other = inside or f"name#{counter}"
        now = other or inside
        if now != inside and not block:
            flush()
        name = f"{tag}#{counter}" if tag in SCOPES else tag
        stack.append((tag, name, now))
    flush()
    return out


def main_text(page: str | None) -> str:
    """The article of a page, blocks joined by one space; empty for null, empty or contentless pages."""
    parts = text_blocks(page or "")
    size: dict[str, int] = {}
    for path, text, other in parts:
        if other not in ("tag", "replies"):
            size[other] = size.get(other, 0) + len(text)
    # A name is not believed of what holds most of the text, unless an article lies outside of it.
    most = max(size, key=size.get, default="")
    if most and (2 * size[most] <= sum(size.values()) or any(
            not other and s.split("#")[0] in ("article", "main") for path, _, other in parts for s in path)):
        most = ""
    blocks = [(p, t) for p, t, other in parts if other in ("", most)]
    if not blocks:
        return ""
    # Sums by path; copies of a container are told apart, the tags inside them are not.
    sums: dict[tuple[str, ...], list[float]] = {}
    for path, text in blocks:
        s = sums.setdefault(path, [0, 0, 0])
        s[0] += len(text)
        s[1] += len(_PUNCTUATION.findall(text)) + 1
        s[2] += 1
    ratio = np.array([[sums[p][0] / sums[p][2], sums[p][1] / sums[p][2]] for p, _ in blocks])
    kernel = np.array([0.25, 0.5, 0.25])
    smooth = np.stack([np.convolve(np.pad(c, 1, mode="edge"), kernel, mode="valid") for c in ratio.T], axis=1)
    fused = np.sqrt(smooth[:, 0] * smooth[:, 1])
    chosen = [p for (p, _), f in zip(blocks, fused) if f >= THRESHOLD * fused.max()]
    container: tuple[str, ...] = ()
    while True:
        below = {p[len(container)] if len(p) > len(container) else None for p in chosen}
        step = below.pop() if len(below) == 1 else None
        # A leaf kind like p, a list, a table or a quotation isn't a container.
        if step is None or step.split("#")[0] not in CONTAINERS:
            break
        # Nor is what stands among headings and paragraphs: they belong together.
        n = len(container)
        if n and any(p[:n] == container and (len(p) == n or p[n].split("#")[0] not in CONTAINERS) for p, _ in blocks) and \
                not any(s.split("#")[0] in ("article", "main") for s in chosen[0][n:] if all(s in p for p in chosen)):
            break
        container = (*container, step)
        if step.startswith("article#") or step.startswith("main#") and not any(
                s.startswith("article#") for s in chosen[0] if all(s in p for p in chosen)):
            break
    return " ".join(t for p, t in blocks if p[:len(container)] == container)


def extract_main_text(pages: DataFrame) -> DataFrame:
    """Add ``text, n_chars`` (its code points) to ``pages(html, ...)``.

    A null page counts as empty; a page without content has an empty text. All rows and other columns
    stay; columns of these two names are replaced. Equal pages give equal texts.
    """
    @F.pandas_udf("string")
    def extract(htmls: pd.Series) -> pd.Series:
        return htmls.map(main_text)

    own = [c for c in pages.columns if c not in ("text", "n_chars")]
    return (pages.select(*own).withColumn("text", extract(F.coalesce("html", F.lit(""))))
            .withColumn("n_chars", F.length("text").cast("long")))
