"""Main-text extraction: templates against a slow model of classes and slots, and pages that lost or kept the wrong text."""

from collections import Counter, defaultdict
from itertools import groupby

import pytest

from wirelens.llm import html_extract as hx

DATA = "/root/testdata/sf0.001"


def slow_templates(pages, least_pages=hx.LEAST_PAGES):
    """host -> (containers, texts), from whole pages: pages is host -> htmls."""
    out = {}
    for host, htmls in pages.items():
        bodies = {}
        for html in htmls:
            body, total, tokens = hx._page(html)
            key = hash_of(html)
            if body not in bodies or key < bodies[body][0]:
                bodies[body] = (key, total, tokens)
        docs = sorted(bodies.values(), key=lambda d: d[0])
        if len(docs) < least_pages:
            continue
        vector, token = defaultdict(dict), {}
        for p, (_, _, tokens) in enumerate(docs):
            for t in tokens:
                vector[t["t"]][p] = t["n"]
                token.setdefault(t["t"], t)
        known = {t: v for t, v in vector.items() if len(v) >= least_pages}
        classes = defaultdict(list)
        for t, v in known.items():
            classes[tuple(sorted(v.items()))].append(t)
        spine_vector = tuple((p, 1) for p in range(len(docs)))
        spine = set(classes.get(spine_vector, ()))
        fixed = set()
        for v, members in classes.items():
            if v == spine_vector:
                fixed |= spine
                continue
            orders, slots = set(), set()
            for p, _ in v:
                places = {t["t"]: t["place"] for t in docs[p][2]}
                orders.add(tuple(sorted(members, key=lambda t: (places[t], t))))
                slots |= {sum(places[s] <= places[t] for s in spine) for t in members}
            if len(orders) == 1 and len(slots) == 1:
                fixed |= set(members)
        once = {t for t in fixed if all(n == 1 for n in known[t].values())}
        weight = {t: sum(x["weight"] for _, _, tokens in docs for x in tokens if x["t"] == t) for t in once if token[t]["kind"] == hx.CONTAINER}
        total = {t: sum(docs[p][1] for p in known[t]) for t in weight}
        containers = sorted((t for t in weight if 2 * weight[t] > total[t]), key=lambda t: (-max(x["depth"] for _, _, tokens in docs for x in tokens if x["t"] == t), t))
        support = {t: len(known[t]) for t in once}
        texts = {t for t in once if token[t]["kind"] == hx.TEXT and token[t]["own"] in once and 2 * support[t] > support[token[t]["own"]]}
        if containers or texts:
            out[host] = (containers, texts)
    return out


_hash = {}


def hash_of(html):
    return _hash[html]


def by_host(spark, pages):
    """host -> htmls, with Spark's hashes of pages remembered."""
    rows = pages.selectExpr("coalesce(html, '') AS html", "xxhash64(coalesce(html, '')) AS h", "url").withColumn("host", hx.host_of(pages["url"])).collect()
    _hash.update({r.html: r.h for r in rows})
    return {host: [r.html for r in own] for host, own in groupby(sorted(rows, key=lambda r: r.host), key=lambda r: r.host)}


def shop(k):
    """A page with host-wide text inside of the article, an optional box, and a table that repeats."""
    box = "<div class=b><h2>Read this first</h2><p>Offer of the week</p></div>" if k % 3 else ""
    rows = "".join(f"<tr><td>row {k} {j}</td></tr>" for j in range(k % 4))
    return f"<html><body><div class=top>Shop</div><div class=m><div class=by>By the editors of the shop</div><h1>Title {k}</h1>{box}<p>{'words of page %d ' % k * 30}</p><table>{rows}</table><div class=end2>All rights kept</div></div><div class=end>The end</div></body></html>"


def test_templates_against_a_slow_model(spark):
    made = [(1000 + k, f"http://{'a' if k < 14 else 'b'}.test/{k}", shop(k)) for k in range(24)] + [(2000, "http://a.test/x", None), (2001, None, shop(3)), (2002, "http://a.test/y", shop(4))]
    given = [tuple(r) for r in spark.read.parquet(f"{DATA}/pages.parquet").select("page_id", "url", "html").collect()]
    pages = spark.createDataFrame(given + made, "page_id long, url string, html string")
    got = {r.host: (list(r.containers), set(r.texts)) for r in hx.templates(pages).collect()}
    want = slow_templates(by_host(spark, pages))
    assert got == want and len(got["a.test"][1]) >= 4
    text = {r.page_id: r.text for r in hx.extract(pages).collect()}
    for host, htmls in by_host(spark, pages).items():
        containers, texts = want.get(host, ((), ()))
        assert Counter(hx.main_text(h, tuple(containers), frozenset(texts)) for h in htmls) == Counter(text[i] for i, url, _ in given + made if (hx_host(url) == host))
    # the template decides: host-wide lines inside the container go, and without it they stay
    for k in range(14):
        assert text[1000 + k].split("\n")[0] == f"Title {k}" and "All rights kept" not in text[1000 + k] and "Offer of the week" not in text[1000 + k]
        assert "All rights kept" in hx.main_text(shop(k))


def hx_host(url):
    import re

    m = re.match(r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


@pytest.mark.parametrize(
    "html, text",
    [
        ("<p data=x'>Hello one two three</p><p>it's here and goes on</p>", "Hello one two three\nit's here and goes on"),
        ("<p title='a > b' x=\"c>d\">one two</p><p>it's \"fine\" > ok</p>", "one two\nit's \"fine\" > ok"),
        ("<p title = 'never closed>one</p><p>two</p>", "one\ntwo"),
        ("<body><header>Site name and slogan</header><p>Text of the page, long enough.</p><p>More text.</p></body>", "Text of the page, long enough.\nMore text."),
        ("<article><header><h1>Title</h1></header><p>Body text is here</p></article>", "Title\nBody text is here"),
        ("<main><article><p>A long article with many words in it.</p></article><div class='x12'>Other stories</div></main>", "A long article with many words in it."),
        ("<main><article><p>One.</p></article><article><p>Two two.</p></article></main>", "One.\nTwo two."),
        ("<main><p>No article here at all.</p><div>But a box</div></main>", "No article here at all.\nBut a box"),
        ("<article><p>The text is long.</p><div hidden>not seen</div><div style='x:y; display: none'>nor this</div><div aria-hidden=true>nor that</div></article>", "The text is long."),
        ("<article><p>The text is long.</p><div class='notice-period law'><p>Law.</p></div><section id='copyright'><p>About it.</p></section></article>", "The text is long.\nLaw.\nAbout it."),
        ("<article><p>The text is long.</p><div class='box comments'>nice</div><aside>more</aside><div role=navigation>go</div></article>", "The text is long."),
        ("<article><p>The text<br>of two lines</p></article>", "The text\nof two lines"),
    ],
)
def test_pages(html, text):
    assert hx.main_text(html) == text
