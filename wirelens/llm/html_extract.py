"""Main-text extraction with templates deduced from equivalence classes.

A page is a sequence of tokens: opening tags with their path, and text blocks with theirs. Tokens of one host's
pages that have the same occurrence vector (how often in each page) are a class. The class of what occurs once in
every page is the template's spine; another class is valid if its tokens keep one order in every page, and nested
if it always lies in one slot of the spine. What is in no valid class fills the slots.

The template decides what is kept: of its tags, the innermost one around most of the text that the host's pages
put in slots is the main container, and the blocks in it are the main text, but for template text, which is a text that
most pages have in an element that each has once. Names of elements weigh in (what is in a menu or an advert counts
an eighth as text), cut menus, forms or comments out of the container, and widen it to the article element around it.
A page that no template of its host covers has one of its own, of the tags that it has once.

Scale: classes come from sums over (host, token) of hashes of (page, count), which combine on the map side, so a
host with a third of all pages meets nowhere. Pages of a host with the same longest texts count once, so copies of an
article make no template. Only token hashes are shuffled, a few hundred bytes a page; the pages stay where they are
and meet the templates in a broadcast of checked size, else in a join.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import load, map_batches, sliced, stash

#: Pages with different texts that a host needs for a template; and that a class must occur in.
LEAST_PAGES = 5
#: Hashes in templates that are broadcast at most: 16 MB.
BROADCAST_TOKENS = 2_000_000
#: A page's texts of most weight, by which copies of an article are known.
LONGEST = 2
#: A character of text weighs so much, and in an element whose name says that it isn't main text the other.
PLAIN, NAMED = 8, 1

# Elements and words that mark what isn't main text.
HIDDEN = frozenset("script style noscript template svg math iframe object embed canvas video audio head title select option datalist button textarea".split())
BOILERPLATE = frozenset("nav footer aside form menu dialog fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar".split())
WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar sidenav rail nav navbar navigation menu breadcrumb breadcrumbs "
    "footer masthead topbar toolbar cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing "
    "social related recommended recommendations comment comments commentlist disqus respond reply replies widget pagination pager copyright legal disclaimer skip search".split()
)
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr input".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements of one block, which aren't containers.
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre blockquote td th tr caption figcaption summary".split())
CLOSED_BY = {
    "p": frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()),
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]),
}
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
#: The end of a tag, or the begin of a quoted value: a quote is one only right after an equals sign.
_VALUE = re.compile(r">|=[\x20\t\r\n\f]*[\"']")
_UNSEEN = re.compile(r"(?:^|[\s\"'])hidden(?=[\s/=]|$)|\baria-hidden\s*=\s*[\"']?true|\bstyle\s*=\s*[\"'][^\"']*display\s*:\s*none", re.I)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_DIGITS, _LONG = re.compile(r"\d+"), re.compile(r"\d{3,}")


def markup(html: str) -> Iterator[tuple[int, int, str, str, bool]]:
    """(start, end, tag in lower case, attributes, whether it closes) of tags; comments and the like have no tag.

    One pass: no character is looked at more than a few times, whatever is left open. An open comment takes all that
    follows; a quote that is never closed, or that no equals sign precedes, is none.
    """
    at, last = 0, {q: html.rfind(q) for q in "\"'"}
    while (at := html.find("<", at)) >= 0:
        if html.startswith("<!--", at):
            end = html.find("-->", at + 4)
            end = len(html) if end < 0 else end + 3
            yield at, end, "", "", False
        elif html[at + 1 : at + 2] in ("!", "?"):
            end = html.find(">", at)
            end = len(html) if end < 0 else end + 1
            yield at, end, "", "", False
        elif m := _TAG.match(html, at):
            stop = m.end()
            while True:
                q = _VALUE.search(html, stop)
                if not q or q[0] == ">":
                    end = q.end() if q else len(html)
                    break
                quote = q[0][-1]
                stop = q.end() if q.end() - 1 == last[quote] else html.find(quote, q.end()) + 1
            yield at, end, m[2].lower(), html[m.end() : end].rstrip(">"), bool(m[1])
        else:
            at += 1
            continue
        at = end


@dataclass(slots=True)
class Element:
    tag: str
    key: int  # hash of its path
    above: int  # place of the element around it, -1 for none
    depth: int
    off: bool  # its name says that it isn't main text
    place: int  # among all tokens
    cut: bool = False  # it goes from inside the container too


@dataclass(slots=True)
class Block:
    text: str
    element: int
    linked: bool
    place: int


def parse(html: str) -> tuple[list[Element], list[Block]]:
    """Elements and text blocks of a page in order. Unclosed and stray tags are put up with."""
    elements, blocks = [Element("", 0, -1, 0, False, 0)], []
    stack, opened = [0], Counter()
    run: list[str] = []
    links = linked = at = 0
    place = 1
    unclosed: set[str] = set()

    def add(piece: str) -> None:
        nonlocal linked
        if piece:
            run.append(piece)
            linked += len(piece) * bool(links)

    def end_block() -> None:
        nonlocal linked, place
        text = " ".join(entities.unescape("".join(run)).split()) if run else ""
        if text:
            blocks.append(Block(text, stack[-1], linked * 2 > len(text), place))
            place += 1
        run.clear()
        linked = 0

    def pop() -> None:
        opened[elements[stack.pop()].tag] -= 1

    for start, end, tag, rest, closing in markup(html):
        if start < at:  # in a hidden element
            continue
        add(html[at:start])
        at = end
        if not tag:
            continue
        if tag in HIDDEN and not closing and tag not in VOID and not rest.endswith("/"):
            end_block()
            close = None if tag in unclosed else re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(html, at)
            if close:
                at = close.end()
            else:
                unclosed.add(tag)
                at = len(html) if tag in ("script", "style") else at
        elif tag in INLINE:
            if tag == "a":
                links = 0 if closing else 1
        elif tag in VOID:
            end_block()
        elif closing:
            end_block()
            if opened[tag]:
                while elements[stack[-1]].tag != tag:
                    pop()
                pop()
        else:
            end_block()
            while tag in CLOSED_BY.get(elements[stack[-1]].tag, ()):
                pop()
            label, off, cut = _label(tag, rest)
            above = stack[-1]
            if tag == "header" and not any(opened[t] for t in ("article", "section")):
                off = cut = True  # the site's, not an article's own
            elements.append(Element(tag, _key(f"{elements[above].key}/{tag}{label}"), above, len(stack), off, place, cut))
            place += 1
            stack.append(len(elements) - 1)
            opened[tag] += 1
    add(html[at:])
    end_block()
    return elements, blocks


def _key(s: str) -> int:
    return xxhash.xxh64_intdigest(s.encode("utf-8", "surrogatepass")) - (1 << 63)


def _label(tag: str, rest: str) -> tuple[str, bool, bool]:
    """Class and id, numbers that may be a page's own left out; whether a name in them says that the element isn't main text;
    and whether it is so sure that the element goes from inside an article too: by its tag or role, as it is hidden, or by a
    class that is exactly such a name."""
    names = {a.lower(): x or y or z for a, x, y, z in _ATTRIBUTE.findall(rest)} if rest else {}
    label = f"{_LONG.sub('0', names.get('class', ''))} {_DIGITS.sub('0', names.get('id', ''))}".strip()
    words = {w.lower() for w in _NAME.findall(label)} if label else set()
    cut = tag in BOILERPLATE or names.get("role", "").lower() in ROLES or bool(rest and _UNSEEN.search(rest))
    named = tag not in ("html", "body", "main")
    cut = cut or named and not WORDS.isdisjoint(names.get("class", "").lower().split())
    return ("." + label if label else ""), cut or bool(words & WORDS and named), cut


def weigh(elements: list[Element], blocks: list[Block]) -> list[int]:
    """The weight of each block: its characters, none if most are links."""
    off = [False] * len(elements)
    for k, e in enumerate(elements):
        off[k] = e.off or (k > 0 and off[e.above])
    return [0 if b.linked else len(b.text) * (NAMED if off[b.element] else PLAIN) for b in blocks]


def weights(elements: list[Element], blocks: list[Block]) -> list[int]:
    """The weight of the blocks in each element; in the first one, of all."""
    out = [0] * len(elements)
    for b, w in zip(blocks, weigh(elements, blocks)):
        out[b.element] += w
    for k in range(len(elements) - 1, 0, -1):
        out[elements[k].above] += out[k]
    return out


def host_of(url: Column) -> Column:
    """Host of the URL in lower case, empty if there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


_TOKEN = [("t", pa.int64()), ("n", pa.int32()), ("place", pa.int32()), ("kind", pa.int32()), ("own", pa.int64()), ("weight", pa.int64()), ("depth", pa.int32())]
TAG, CONTAINER, TEXT = 0, 1, 2


def _page(html: str) -> tuple[int, int, list[dict]]:
    """Hash of the longest texts, weight of all text, and the distinct tokens."""
    elements, blocks = parse(html)
    weight = weights(elements, blocks)
    seen: dict[int, dict] = {}

    def add(key: int, **token) -> None:
        if key in seen:
            seen[key]["n"] += 1
        else:
            seen[key] = {"t": key, "n": 1, **token}

    for e, w in list(zip(elements, weight))[1:]:
        add(e.key, place=e.place, kind=TAG if e.tag in PARAGRAPHS else CONTAINER, own=0, weight=w, depth=e.depth)
    for b in blocks:
        own = elements[b.element].key
        add(_key(f"{own}\0{b.text}"), place=b.place, kind=TEXT, own=own, weight=0, depth=0)
    longest = sorted((-w, b.text) for b, w in zip(blocks, weigh(elements, blocks)) if w)[:LONGEST]
    return _key("\0".join(text for _, text in longest) if longest else html), weight[0], list(seen.values())


def page_tokens(pages: DataFrame) -> DataFrame:
    """host, page, total, toks: of the pages of a host with the same longest texts one, by its hash `page`; the weight of
    its text; its distinct tokens: hash t, count n, first place, kind, own element of a text, weight inside and depth of a tag."""
    toks = "array<struct<t:long,n:int,place:int,kind:int,own:long,weight:long,depth:int>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 64):
            found = [_page(html) for html in batch.column("html").to_pylist()]
            cols = [pa.array([f[k] for f in found], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.list_(pa.struct(_TOKEN))))]
            yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("page"), *cols], ["host", "page", "body", "total", "toks"])

    html = F.coalesce("html", F.lit(""))
    rows = pages.select(host_of(F.col("url")).alias("host"), F.xxhash64(html).alias("page"), html.alias("html"))
    rows = map_batches(rows, run, f"host string, page long, body long, total long, toks {toks}")
    first = rows.groupBy("host", "body").agg(F.min_by(F.struct("page", "total", "toks"), "page").alias("first"))
    return first.select("host", "first.*")


def templates(pages: DataFrame, least_pages: int = LEAST_PAGES) -> DataFrame:
    """host, containers, texts: hashes of the tags around most of the host's text, innermost first, and of its template texts."""
    distinct = stash(page_tokens(pages), "pagetokens")
    seen = distinct.selectExpr("host", "page", "total", "inline(toks)")
    pages_of = distinct.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    vector = seen.groupBy("host", "t").agg(
        F.count(F.lit(1)).alias("support"),
        F.sum("n").alias("count"),
        F.sum(F.xxhash64("page", "n") % F.lit(1 << 40)).alias("vector"),
        F.max("kind").alias("kind"), F.max("own").alias("own"), F.max("depth").alias("depth"), F.sum("weight").alias("weight"), F.sum("total").alias("total"),
    )
    known = vector.join(pages_of, "host").where(f"support >= {least_pages} AND pages >= {least_pages}")
    # classes: equal occurrence vectors; the spine has each token once in every page
    once = (F.col("count") == F.col("support")).alias("once")
    marked = stash(
        known.select("host", "t", "kind", "own", "depth", "weight", "total", "support", once, F.struct("support", "count", "vector").alias("cls"), (once & (F.col("support") == F.col("pages"))).alias("spine")),
        "classes",
    )
    placed = seen.join(marked.select("host", "t", "cls", "spine"), ["host", "t"]).select("host", "page", "t", "place", "cls", "spine")
    slot = F.sum(F.col("spine").cast("int")).over(Window.partitionBy("host", "page").orderBy("place"))
    in_page = placed.withColumn("slot", slot).groupBy("host", "cls", "spine", "page").agg(
        F.xxhash64(F.transform(F.array_sort(F.collect_list(F.struct("place", "t"))), lambda x: x["t"])).alias("order"),
        F.min("slot").alias("low"), F.max("slot").alias("high"),
    )
    valid = in_page.groupBy("host", "cls", "spine").agg(F.min("order").alias("o1"), F.max("order").alias("o2"), F.min("low").alias("low"), F.max("high").alias("high"))
    valid = valid.where("spine OR (o1 = o2 AND low = high)").select("host", "cls")
    fixed = stash(marked.where("once").join(valid, ["host", "cls"]), "fixed")

    around = fixed.where(f"kind = {CONTAINER} AND 2 * weight > total").groupBy("host").agg(F.array_sort(F.collect_list(F.struct((-F.col("depth")).alias("d"), "t"))).alias("c"))
    own = fixed.where(f"kind < {TEXT}").select("host", F.col("t").alias("own"), F.col("support").alias("own_support"))
    texts = fixed.where(f"kind = {TEXT}").join(own, ["host", "own"]).where("2 * support > own_support").groupBy("host").agg(F.collect_set("t").alias("texts"))
    none = F.array().cast("array<long>")  # both lists hold at most what a page of the host has once
    return stash(around.join(texts, "host", "full").select("host", F.coalesce("c.t", none).alias("containers"), F.coalesce("texts", none).alias("texts")), "templates")


def main_text(html: str, containers: tuple[int, ...] = (), texts: frozenset[int] = frozenset()) -> str:
    """The blocks in the innermost of the containers that the page has, without template texts, joined by newlines."""
    elements, blocks = parse(html)
    at = {e.key: k for k, e in enumerate(elements)}
    main = next((at[c] for c in containers if c in at), None)
    if main is None:  # a template of the page's own
        weight, often = weights(elements, blocks), Counter(e.key for e in elements)
        around = [k for k, e in enumerate(elements) if e.tag not in PARAGRAPHS and often[e.key] == 1 and 2 * weight[k] > weight[0]]
        main = max(around, key=lambda k: (elements[k].depth, -k), default=0)
    k, article, outer = main, -1, -1
    while k > 0:  # the outermost article around it; a main element only where no article is
        article = k if elements[k].tag == "article" else article
        outer = k if elements[k].tag == "main" else outer
        k = elements[k].above
    if article > 0:
        main = article
    elif outer > 0:
        inner = [k for k, e in enumerate(elements) if e.tag == "article" and _within(elements, k, outer)]
        tops = [k for k in inner if not any(_within(elements, k, other) for other in inner if other != k)]
        main = tops[0] if len(tops) == 1 and 2 * weights(elements, blocks)[tops[0]] > weights(elements, blocks)[outer] else outer
    # in the container, and in nothing there that isn't main text
    inside, kept = [False] * len(elements), [False] * len(elements)
    for k, e in enumerate(elements):
        inside[k] = k == main or (k > 0 and inside[e.above])
        kept[k] = inside[k] and (k == main or (kept[e.above] and not e.cut))
    return "\n".join(b.text for b in blocks if kept[b.element] and _key(f"{elements[b.element].key}\0{b.text}") not in texts)


def _within(elements: list[Element], k: int, around: int) -> bool:
    while k > around:
        k = elements[k].above
    return k == around


def extract(pages: DataFrame, least_pages: int = LEAST_PAGES) -> DataFrame:
    """One row per row of pages(page_id, url, html): page_id, url, text, n_chars.

    Null html counts as empty and gives an empty text; pages with a null or odd url share the empty host. Repeated
    rows each get their text, and an empty table gives none. A host of fewer than least_pages different texts has no
    template: each of its pages has its own. Of containers as deep as each other the one with the smaller hash counts. Pages
    of any length are read whole, in linear time. Other columns are ignored.
    """
    known = templates(pages, least_pages)
    size = known.agg(F.coalesce(F.sum(F.size("texts") + F.size("containers") + 8), F.lit(0))).first()[0]
    known = known.withColumnRenamed("host", "h")
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), host_of(F.col("url")).alias("host"))
    joined = rows.join(F.broadcast(known) if size <= BROADCAST_TOKENS else known, F.col("host") == F.col("h"), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 64):
            cols = (batch.column(c).to_pylist() for c in ("html", "containers", "texts"))
            found = [main_text(html, tuple(containers or ()), frozenset(texts or ())) for html, containers, texts in zip(*cols)]
            arrays = [batch.column("page_id").cast(pa.int64()), batch.column("url"), pa.array(found, pa.string()), pa.array(map(len, found), pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["page_id", "url", "text", "n_chars"])

    return map_batches(joined.select("page_id", "url", "html", "containers", "texts"), run, "page_id long, url string, text string, n_chars long")


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(load(spark, sf_dir, "pages"))
