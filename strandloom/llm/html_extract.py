"""Main text of web pages by template deduction over equivalence classes of tokens.

A page is cut into blocks of text below a tree of elements. The tokens of a host's pages are the paths of elements, and
the texts under them. A token's occurrence vector says how often it stands on each page; it is kept as two sums of
hashes of page and number, which merge by aggregation. Tokens of one host with the same vector are an equivalence
class. A class is valid if enough of the host's pages have it, an element is in it, and it nests: the topmost of its
elements stand in one slot, below the same element. The elements of valid classes are a tree by their paths, the host's template; between
its tokens are slots. The main slot is the article or main element of the template that holds most text, or else the
deepest template element that holds most of the host's text that no other rule has cut.
A page's own article or main element serves only where the template names no slot below body, as on hosts of few
pages, or where the page doesn't have the slot. Elements that share the slot's path on one page are all taken.

From the slot are left out: menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles, comments, by
element and by class or id, and texts of the template itself. Headings are not judged by their names. A page of nothing but such texts keeps them.
Character references are decoded within a run of text, white space inside a block becomes one blank, blocks are joined
by a line feed; nothing else is cut. What is cut inside a line leaves the block whole.

Defined results: null, empty and text-free pages give an empty text; markup that is cut short or unclosed ends with the
page, and its cost grows with its length alone; pages that repeat an id each get their row; a null url has a host of its
own; an empty table gives an empty one; extra columns are not used.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import lru_cache
from html import unescape

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import cut

#: A host has a template if so many of its pages, and this share of them, agree.
LEAST_PAGES = 3
LEAST_SHARE = 0.5
#: A slot holds most of a host's text.
MOST_TEXT = 0.6
#: Bytes of templates that are broadcast; beyond it they are joined by host, and hosts of more pages than HOT are dealt out.
MOST_BROADCAST = 32 << 20
HOT = 5_000

TAG = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$)", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
# Elements of HTML by what they hold.
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "noscript", "ol", "option", "p", "pre", "section", "select", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul", "button", "template"}
CUT = {"nav", "footer", "aside", "form", "menu", "noscript", "template", "button", "select", "dialog", "svg", "object", "audio", "video", "canvas", "map"}
#: Of these, the ones that may stand inside a line.
INLINE_CUT = {"button", "select", "svg", "object", "audio", "video", "canvas", "map"}
#: Words of a class or id that name what is not the article.
CUT_NAMES = re.compile(
    r"^(ads?|advert.*|sponsor.*|promo.*|banner.*|cookies?|consent|gdpr|notices?|alerts?|sidebars?|aside|rail|menus?|nav|navbar|navigation|breadcrumbs?|masthead|topbar|footer|comments?|commentlist|respond|replies|disqus|related|recommended|share|sharing|social|subscribe|newsletter|popup|modal|overlay|widgets?|login|signup|search|pagination|pager|toolbar|skip|dfp)$"
)
HEADER_NAMES = re.compile(r"^(header|head|siteheader|pageheader)$")
#: Parts that may stand beside such a word in a class or id; any other part names something else (share-price, content-sidebar-wrap).
QUALIFIERS = re.compile(
    r"^(site|page|main|top|bottom|left|right|primary|secondary|global|mobile|desktop|sticky|box|block|bar|list|area|section|links?|buttons?|icons?|form|unit|slot|[0-9x]*)$"
)
MAIN_ROLES = {"navigation": "cut", "banner": "cut", "contentinfo": "cut", "complementary": "cut", "search": "cut", "form": "cut", "alert": "cut", "dialog": "cut", "main": "main"}
ARTICLE = {"article", "main"}
#: Elements that a following block or sibling closes by itself.
CLOSED_BY_BLOCK = {"p"}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: How surely a block is cut. An article or main element lifts a cut that it inherits from a name alone.
LIFTED, BY_NAME, BY_ELEMENT = 1, 2, 3
def _named(names: list[str], pattern: re.Pattern) -> bool:
    """Whether a whole class or id says what pattern names: one of its parts does and the others are such words or qualifiers."""
    for name in names:
        parts = re.split(r"[-_]+", name)
        if any(map(pattern.match, parts)) and all(pattern.match(p) or CUT_NAMES.match(p) or QUALIFIERS.match(p) for p in parts):
            return True
    return False


def _kind(tag: str, attributes: str, in_article: bool) -> tuple[int, bool, str]:
    """(cut, main, name) of an element; cut is BY_ELEMENT, BY_NAME or 0."""
    names, role = [], ""
    if "=" in attributes:
        for key, a, b, c in ATTRIBUTE.findall(attributes):
            if key.lower() == "role":
                role = (a or b or c).strip().lower()
            else:
                names += (a or b or c).lower().split()
    cut_it = 0
    if tag in ("html", "body", "article", "main", "h1", "h2", "h3", "h4", "h5", "h6"):
        pass
    elif tag in CUT or MAIN_ROLES.get(role) == "cut" or not in_article and tag == "header":
        cut_it = BY_ELEMENT
    elif names and (_named(names, CUT_NAMES) or not in_article and _named(names, HEADER_NAMES)):
        cut_it = BY_NAME
    return cut_it, tag in ARTICLE or MAIN_ROLES.get(role) == "main", ".".join([tag, *sorted(set(names))])


#: An article or main element; the page, html or body, which say nothing of where the text stands; any other element.
MAIN, WHOLE, OTHER = 2, 1, 0


@dataclass
class Page:
    """A page's elements by number, their parents first (0 is the page itself), and its blocks of text in page order."""

    parent: list[int] = field(default_factory=lambda: [0])
    path: list[int] = field(default_factory=lambda: [0])  # the hash of the path
    kind: list[int] = field(default_factory=lambda: [WHOLE])  # MAIN, WHOLE or OTHER
    depth: list[int] = field(default_factory=lambda: [0])
    blocks: list[tuple[int, str, int, bool]] = field(default_factory=list)  # element, text, level of its cut, in an article


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _hash(above: int, name: str) -> int:
    return _signed(xxhash.xxh64_intdigest(f"{above}\n{name}".encode("utf-8", "surrogatepass")))


def text_hash(path: int, text: str) -> int:
    """The hash of a text under a path, as a signed 64-bit integer."""
    return _hash(path, f"\n{text}")


def _levels(html: str) -> Page:
    page = Page()
    # Tag, cut, article, element, and the text that goes on after an element that is cut inside a line; of block
    # elements and of those that are cut.
    stack: list[tuple[str, int, bool, int, list[str] | None]] = []
    opened: dict[str, int] = {}  # how many of each tag are in the stack
    parts: list[str] = []

    def flush() -> None:
        if parts:
            text = " ".join("".join(parts).split())
            parts.clear()
            if text:
                _, is_cut, article, element, _ = stack[-1] if stack else ("", 0, False, 0, None)
                page.blocks.append((element, text, is_cut, article))

    def pop(n: int) -> None:
        nonlocal parts
        while len(stack) > n:
            flush()
            tag, *_, after = stack.pop()
            opened[tag] -= 1
            if after is not None:
                parts = after

    at = 0
    while True:
        m = TAG.search(html, at)
        if not m:
            parts.append(unescape(html[at:]))
            break
        if m.start() > at:
            parts.append(unescape(html[at : m.start()]))
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if opened.get(tag):
                n = len(stack) - 1
                while stack[n][0] != tag:
                    n -= 1
                pop(n)
            elif tag in BLOCK:
                flush()
            continue
        if tag == "br" or tag == "hr" or tag == "wbr":
            flush() if tag == "hr" else parts.append(" " if tag == "br" else "")
            continue
        if tag in RAW:
            end = _end_of(tag).search(html, at)
            at = end.end() if end else len(html)
            continue
        if tag in VOID:
            continue
        if tag == "head":
            # Its texts are all RAW; what else it seems to hold stands in the body, as </head> may be left out.
            flush()
            continue
        is_cut, main, name = _kind(tag, m[3], stack[-1][2] if stack else False)
        inline = tag in INLINE_CUT or tag not in BLOCK
        if not inline:
            flush()
            if stack and stack[-1][0] in CLOSED_BY_BLOCK:
                pop(len(stack) - 1)
            if stack and stack[-1][0] in SIBLINGS.get(tag, ()):
                pop(len(stack) - 1)
        elif not is_cut:
            continue
        if m[3].endswith("/"):
            continue
        _, above_cut, above_article, above, _ = stack[-1] if stack else ("", 0, False, 0, None)
        if main and above_cut == BY_NAME and not above_article:
            above_cut = LIFTED
        page.parent.append(above)
        page.path.append(_hash(page.path[above], name))
        page.kind.append(MAIN if tag in ARTICLE else WHOLE if tag in ("html", "body") else OTHER)
        page.depth.append(page.depth[above] + 1)
        stack.append((tag, max(above_cut, is_cut), above_article or main, len(page.path) - 1, parts if inline else None))
        opened[tag] = opened.get(tag, 0) + 1
        if inline:
            parts = []
    pop(0)
    flush()
    return page


@lru_cache(None)
def _end_of(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}\s*>", re.I)


def parsed(html: str) -> tuple[Page, list[tuple[int, str, bool, bool]]]:
    """The page, and (element, text, cut, in an article) of each block that has text, in page order.

    Articles below a name that is cut serve where no other article stands; what is cut by a name serves where else all
    would be cut."""
    page = _levels(html)
    most = 0
    if not any(level == 0 and article for _, _, level, article in page.blocks):
        levels = {level for _, _, level, _ in page.blocks}
        most = LIFTED if LIFTED in levels else 0 if 0 in levels else BY_NAME
    return page, [(element, text, level > most, article) for element, text, level, article in page.blocks]


def tokens(pages: DataFrame) -> DataFrame:
    """(host, page, hash, above, depth, kind, n, chars): a page's tokens, how often each stands there, and the characters of
    uncut text under a path. above is the path that a token stands in, depth is 0 for texts."""

    def batches(parts):
        for part in parts:
            rows = []
            for host, number, html in zip(part["host"], part["page"], part["html"], strict=True):
                page, blocks = parsed(html or "")
                n: dict[int, int] = {}
                of_text: dict[int, int] = {}
                chars = [0] * len(page.path)
                for element, text, is_cut, _ in blocks:
                    if not is_cut:
                        chars[element] += len(text)
                        h = text_hash(page.path[element], text)
                        n[h] = n.get(h, 0) + 1
                        of_text[h] = page.path[element]
                by_path: dict[int, list] = {}
                for k in range(len(page.path) - 1, 0, -1):
                    chars[page.parent[k]] += chars[k]
                    found = by_path.setdefault(page.path[k], [page.path[page.parent[k]], page.depth[k], page.kind[k], 0, 0])
                    found[3] += 1
                    found[4] += chars[k]
                rows += [(host, number, h, of_text[h], 0, OTHER, k, 0) for h, k in n.items()]
                rows += [(host, number, h, *x) for h, x in by_path.items()]
            yield pd.DataFrame(rows, columns=["host", "page", "hash", "above", "depth", "kind", "n", "chars"])

    return pages.mapInPandas(batches, "host string, page long, hash long, above long, depth int, kind int, n int, chars long")


def template(often: pd.DataFrame) -> tuple[int | None, list[int]]:
    """(path of the main slot or None, hashes of the template's texts) from one host's frequent tokens
    (hash, above, depth, kind, chars, v1, v2)."""
    elements = often[often["depth"] > 0].sort_values(["depth", "hash"])
    vector = dict(zip(often["hash"], zip(often["v1"], often["v2"], strict=True), strict=True))
    above = dict(zip(elements["hash"], elements["above"], strict=True))
    # The nearest element of a path's own class above it, and with it the topmost elements of each class.
    slots: dict[tuple, set[int]] = {}
    lines: dict[int, frozenset] = {0: frozenset()}
    for h, up in above.items():
        line = lines.get(up, frozenset())
        if vector[h] not in line:
            slots.setdefault(vector[h], set()).add(up)
        lines[h] = line if vector[h] in line else line | {vector[h]}
    valid = {v for v, places in slots.items() if len(places) == 1}
    kept = elements[[vector[h] in valid for h in elements["hash"]]]
    texts = [int(h) for h in often.loc[often["depth"] == 0, "hash"] if vector[h] in valid]
    inner = kept[(kept["chars"] > 0) & (kept["kind"] != WHOLE)]
    named = inner[inner["kind"] == MAIN]
    if len(named):
        best = named.sort_values(["chars", "depth", "hash"], ascending=[False, True, True])
    else:
        most = elements["chars"].max() if len(elements) else 0
        best = inner[inner["chars"] >= most * MOST_TEXT].sort_values(["depth", "chars", "hash"], ascending=False)
    return (int(best["hash"].iloc[0]) if len(best) else None), texts


def templates(pages: DataFrame) -> DataFrame:
    """(host, main, texts): the path of each host's main slot, or null, and hashes of the template's texts."""
    sizes = pages.groupBy("host").agg(F.count("*").alias("pages"))
    # Texts leave the tasks as hashes only.
    h = F.xxhash64("page", "n")
    vector = [F.sum(h.bitwiseAND(0xFFFFFFFF)).alias("v1"), F.sum(F.shiftrightunsigned(h, 32)).alias("v2")]
    facts = [F.min(c).alias(c) for c in ("above", "depth", "kind")]
    per_token = tokens(pages).groupBy("host", "hash").agg(F.count("*").alias("support"), *vector, *facts, F.sum("chars").alias("chars")).where(F.col("support") >= LEAST_PAGES)
    often = cut(per_token.join(sizes.hint("merge"), "host").where(F.col("support") >= F.col("pages") * LEAST_SHARE), "html-tokens")

    def deduced(host: tuple, part: pd.DataFrame) -> pd.DataFrame:
        # So many tokens stand on LEAST_SHARE of the host's pages: no more than 1 / LEAST_SHARE times those of a page.
        main, texts = template(part)
        return pd.DataFrame({"host": [host[0]], "main": pd.array([main], "Int64"), "texts": [texts]})

    return often.drop("support", "pages").groupBy("host").applyInPandas(deduced, "host string, main long, texts array<long>")


def main_text(html: str | None, main: int | None, texts) -> str:
    page, blocks = parsed(html or "")
    kept = [b for b in blocks if not b[2]]
    slot = []
    if main is not None:
        inside = [False] * len(page.path)
        for k in range(1, len(inside)):
            inside[k] = inside[page.parent[k]] or page.path[k] == main
        slot = [b for b in kept if inside[b[0]]]
    slot = slot or [b for b in kept if b[3]] or kept
    if texts is not None and len(texts):
        known = {int(x) for x in texts}
        slot = [b for b in slot if text_hash(page.path[b[0]], b[1]) not in known] or slot
    return "\n".join(text for _, text, _, _ in slot)


def extract(pages: DataFrame, *, page_id="page_id", url="url", html="html") -> DataFrame:
    """Per row: page_id, url, text."""
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    rows = rows.withColumn("host", F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit("")))
    found = cut(templates(rows.select("host", F.col("page_id").cast("long").alias("page"), "html")), "html-templates")

    @F.pandas_udf("string")
    def text(htmls: pd.Series, mains: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([main_text(h, None if pd.isna(m) else int(m), t) for h, m, t in zip(htmls, mains, texts, strict=True)], dtype=object)

    size = found.agg(F.sum(F.length("host") + 8 * F.size("texts") + 64)).first()[0] or 0
    if size <= MOST_BROADCAST:
        joined = rows.join(F.broadcast(found), "host", "left")
    else:
        hot = cut(rows.groupBy("host").agg(F.ceil(F.count("*") / HOT).cast("int").alias("salts")).where("salts > 1"), "html-hosts")
        salted = rows.join(F.broadcast(hot), "host", "left").withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
        copies = found.join(F.broadcast(hot), "host", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
        joined = salted.join(copies.hint("merge"), ["host", "salt"], "left")
    return joined.select("page_id", "url", text(F.col("html"), F.col("main").cast("string"), F.col("texts")).alias("text"))
