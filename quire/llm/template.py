"""Main text of web pages by template deduction from equivalence classes.

Pages of one host are made from one template. A page is read as tokens: its tags,
each in its role, the path of elements around it. Over the pages of a host, tokens
that occur equally often in every page have one occurrence vector and form an
equivalence class; a class of several tokens that is met on enough pages is part
of the template. Vectors are never gathered: a token's is the sum over pages of
its count times the page's two numbers, so classes come from one aggregation by
host and role, combined inside each task first, and a host with a third of all
pages costs no task more than others.

Classes nest by the paths of their tokens. The template's elements leave slots,
which hold what changes from page to page; the main slot is the element meant for
it (article, main) or else the deepest that holds most of the pages' running
text. From each page the text of the main slot is taken, without what the slots
nested in it are for by their names: menus, page headers, footers, sidebars,
notices, adverts, forms, reader comments. Text is never dropped for being
repeated, since copied articles repeat too. A page without its host's main slot,
such as one of another make, is read by its own tokens alone.

Defined results: null or empty html, and pages without text there, give an empty
string; a page of a host of its own, or with a null or odd url, is its own
template; repeated rows count as pages each and give equal texts; very long pages
are read whole; an empty table gives no rows; other columns are neither read nor
returned.
"""

from __future__ import annotations

import html as entities
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import small_batches
from quire.session import cut_lineage

TOKEN = re.compile(
    r"<!--.*?(?:-->|$)"
    r"|<(script|style|noscript|template|textarea|title|iframe|svg)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|$)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<[!?][^>]*>",
    re.S | re.I,
)
NAMED = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike "
    "strong sub sup time tt u var wbr img".split()
)
ASIDE = frozenset("nav footer aside form button select option menu dialog label fieldset head object audio video canvas".split())
ASIDE_NAME = re.compile(
    r"(?:^|[\s_-])(?:nav\w*|menu\w*|footer|sidebar|side|aside|widget\w*|cookie\w*|consent|notice\w*|banner\w*|alert\w*|popup|modal"
    r"|ads?|advert\w*|sponsor\w*|promo\w*|comments?|comment\w*|respond|reply|replies|disqus\w*|related\w*|share|sharing|social"
    r"|subscribe|newsletter|breadcrumbs?|pagination|form|search|login|signup|masthead|toolbar)(?:$|[\s_-])",
    re.I,
)
MAIN_NAME = re.compile(r"(?:^|[\s_-])(?:main|article|post|entry|story|content)(?:$|[\s_-])", re.I)


class Element:
    """An open element: its tag, its role (the path of elements), and whether it is set aside."""

    __slots__ = ("tag", "path", "aside")

    def __init__(self, tag: str, path: str, aside: bool):
        self.tag, self.path, self.aside = tag, path, aside


def walk(html: str):
    """Events of a page: ("open" | "close" | "void", element, None) and ("text", element, raw text).

    A tag left open ends with its parent; a new block ends an open paragraph; an
    end tag of nothing that is open is passed over.
    """
    root = Element("", "", False)
    stack, at = [root], 0
    for m in TOKEN.finditer(html):
        if m.start() > at:
            yield "text", stack[-1], html[at : m.start()]
        at = m.end()
        if m[3] is None:
            continue
        tag = m[3].lower()
        if m[2]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    while len(stack) > k:
                        yield "close", stack.pop(), None
                    break
            continue
        if tag not in INLINE and tag not in VOID:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p" or (stack[k].tag == tag and tag in ("li", "td", "th", "tr", "dd", "dt", "option")):
                    while len(stack) > k:
                        yield "close", stack.pop(), None
                    break
                if stack[k].tag not in INLINE:
                    break
        names = " ".join(v or w or x for _, v, w, x in NAMED.findall(m[4])) if "=" in m[4] else ""
        up = stack[-1]
        inside = "/article" in up.path or "/main" in up.path
        aside = up.aside or tag in ASIDE or (tag == "header" and not inside)
        if not aside and names and tag not in ("html", "body", "article", "main"):
            aside = bool(ASIDE_NAME.search(names))
        part = f"{tag}.{names}" if names else tag
        element = Element(tag, f"{up.path}/{part}" if tag not in INLINE else up.path, aside)
        if tag in VOID or m[4].endswith("/"):
            yield "void", element, None
        else:
            stack.append(element)
            yield "open", element, None
    if at < len(html):
        yield "text", stack[-1], html[at:]


def tokens(html: str) -> dict[str, list[int]]:
    """Of each role: how often it is met, and how much running text its elements hold (asides apart)."""
    out: dict[str, list[int]] = {}
    for kind, element, text in walk(html):
        if kind == "open" and element.tag not in INLINE:
            out.setdefault(element.path, [0, 0])[0] += 1
        elif kind == "text" and not element.aside:
            size = len(text) - text.count(" ") if text.strip() else 0
            path = element.path
            while path and size:
                out.setdefault(path, [0, 0])[1] += size
                path = path.rpartition("/")[0]
    return out


def main_role(roles: list[tuple[str, int]]) -> str | None:
    """The main slot among (role, running text) of template elements."""
    free = [(p, n) for p, n in roles if n > 0]
    if not free:
        return None
    meant = [(n, -len(p), p) for p, n in free if _tag(p) in ("article", "main")]
    if meant:
        best = max(meant)
        inner = [x for x in meant if x[2].startswith(best[2] + "/") and _tag(x[2]) == "article" and 10 * x[0] >= 8 * best[0]]
        return max(inner)[2] if inner else best[2]
    most = max(n for _, n in free)
    named = [(n, -len(p), p) for p, n in free if MAIN_NAME.search(p.rpartition("/")[2].partition(".")[2]) and 2 * n >= most]
    if named:
        return max(named)[2]
    # the deepest that holds most of the text, paragraphs and the like apart
    wide = [(p.count("/"), n, p) for p, n in free if 10 * n >= 8 * most and _tag(p) not in ("p", "li", "td")]
    return max(wide)[2] if wide else max((n, p) for p, n in free)[1]


def _tag(path: str) -> str:
    return path.rpartition("/")[2].partition(".")[0]


def main_text(html: str, role: str | None) -> str:
    """The blocks of the main slot ``role``; of the page's own main slot where it has no such element."""
    blocks: list[str] = []
    parts: list[str] = []
    found = False

    def end():
        block = " ".join(entities.unescape("".join(parts)).split())
        if block:
            blocks.append(block)
        parts.clear()

    deep = f"{role}/" if role is not None else ""
    for kind, element, text in walk(html):
        inside = role is not None and (element.path == role or element.path.startswith(deep))
        found = found or inside
        if kind == "text":
            if inside and not element.aside:
                parts.append(text)
        elif element.tag not in INLINE and element.tag != "br":
            end()
        elif element.tag == "br":
            parts.append(" ")
    end()
    if found:
        return "\n\n".join(blocks)
    own = main_role([(p, n) for p, (_, n) in tokens(html).items()]) or ""  # text in no element stands in the root
    return main_text(html, own) if own != role else ""


def _numbers(page: str) -> tuple[int, int]:
    data = page.encode("utf-8", "replace")
    return zlib.crc32(data) >> 4, zlib.crc32(b"\x01" + data, 99) >> 4


def _occurrences(batches):
    """(host, role, pages, n, sum_a, sum_b, mass), combined over the pages of a batch."""
    for batch in batches:
        found: dict[tuple, list[int]] = {}
        for host, page, html in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            a, b = _numbers(page)
            for role, (n, mass) in tokens(html or "").items():
                row = found.setdefault((host, role), [0, 0, 0, 0, 0])
                for k, v in enumerate((1, n, n * a, n * b, mass)):
                    row[k] += v
        columns = list(zip(*[(*k, *v) for k, v in found.items()], strict=True)) or [[]] * 7
        types = [pa.string(), pa.string()] + [pa.int64()] * 5
        names = ["host", "role", "pages", "n", "sum_a", "sum_b", "mass"]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def templates(pages: DataFrame) -> DataFrame:
    """(host, main): the role of the main slot of each host's template; ``pages`` (host, page, html)."""
    schema = "host string, role string, pages long, n long, sum_a long, sum_b long, mass long"
    sums = [F.sum(c).alias(c) for c in ("pages", "n", "sum_a", "sum_b", "mass")]
    roles = pages.select("host", "page", "html").mapInArrow(_occurrences, schema)
    roles = cut_lineage(roles.groupBy("host", "role").agg(*sums))
    vector = ["host", "pages", "n", "sum_a", "sum_b"]
    classes = roles.groupBy(*vector).agg(F.count("*").alias("size"))
    whole = pages.groupBy("host").agg(F.count("*").alias("all"))
    valid = roles.join(classes.where("size > 1 and n > 0"), vector).join(whole, "host").where("2 * pages >= all")
    listed = valid.groupBy("host").agg(F.collect_list(F.struct("role", "mass")).alias("roles"))

    def choose(batches):
        for batch in batches:
            main = [main_role([(r["role"], r["mass"]) for r in roles]) for roles in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict({"host": batch.column(0), "main": pa.array(main, pa.string())})

    return listed.mapInArrow(choose, "host string, main string")


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    small_batches(pages)
    rows = pages.select(F.col(key).alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"))
    found = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1))
    page = F.concat_ws("|", F.col("page_id").cast("string"), "url")
    rows = rows.select("page_id", "url", "html", F.when(found != "", found).otherwise(page).alias("host"), page.alias("page"))
    main = cut_lineage(templates(rows))

    def run(batches):
        for batch in batches:
            texts = [main_text(h or "", m) for h, m in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_pydict(
                {
                    "page_id": batch.column(0),
                    "url": batch.column(1),
                    "text": pa.array(texts, pa.string()),
                    "n_chars": pa.array([len(t) for t in texts], pa.int64()),
                }
            )

    kind = pages.select(F.col(key)).schema[0].dataType.simpleString()
    joined = rows.join(main, "host", "left").select("page_id", "url", "html", "main")
    return joined.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
