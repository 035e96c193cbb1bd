import random

from palimpsest.llm import html_template as H

ODD = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style></head><body>
<header class="site-header"><p>Header</p></header><nav><ul><li><a href=x>Menu</a></ul></nav>
<div id="cookie-notice">We use cookies</div><main><article><header><h1>Big &amp; small</h1></header>
<p>First <b>bold</b>,  and
 <i>more</i>&nbsp;text<p>Second &lt;p&gt; with a &#x41;<br>break<script>var x = "<p>no</p>"; if (1 < 2) {}</script>
<div class="ad-slot">Buy</div><form><input><label>Name</label></form><ul><li>One<li>Two</ul>
<section class="comments"><p>Reader says</p></section></article><aside>Side</aside></main>
<footer>Foot</footer><p>after the article <em"""


def test_parts_of_a_page():
    assert H.extract(ODD) == "Big & small\n\nFirst bold, and more text\n\nSecond <p> with a A break\n\nOne\n\nTwo"
    assert H.extract("") == "" and H.extract("<<<") == "<<<" and H.extract("just text &amp; more") == "just text & more"
    assert H.extract("<p>a<p>b</div></p><h2>c") == "a\n\nb\n\nc"
    assert H.extract("<article>cut of<p>f &am") == "cut of\n\nf &am" and H.extract("<p>x<!-- never closed <p>y") == "x"
    assert H.extract("<p>" * 3000 + "deep") == "deep" and H.extract("<div>" * 2000 + "deep") == "deep"


def page(rng, host, n):
    body = "".join(f"<p>{' '.join(str(rng.random()) for _ in range(12))}</p>" for _ in range(n))
    return f"<html><body><div class=top><p>Welcome to {host}</p></div><div class=left><p>{rng.random()}</p></div><div class=story>{body}<p>All rights reserved by {host}</p></div></body></html>", body


def test_template_of_hosts_without_articles(spark):
    rng = random.Random(1)
    rows, want = [], {}
    for i in range(40):
        host = "one.example" if i % 4 else "two.example"
        h, body = page(rng, host, rng.randint(1, 6))
        rows.append((i, f"https://{host.upper()}/{i}?q", h, "x"))
        want[i] = "\n\n".join(body.replace("</p>", "").split("<p>")[1:])
    rows += [(100 + k, "https://one.example/copy", rows[1][2], "x") for k in range(200)]
    rows += [(500, None, "<p>alone</p>", "x"), (501, "https://one.example", None, "x"), (502, "", "", "x"), (None, "no url", ODD, "x"), (503, "https://big.example/", "<p>w </p>" * 30_000, "x")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, host string")
    out = {r.page_id: r for r in H.main_text(pages).collect()}
    assert len(out) == len(rows)
    assert {i: out[i].text for i in want} == want and all(out[100 + k].text == want[1] for k in range(200))
    assert [out[k].text for k in (500, 501, 502)] == ["alone", "", ""] and out[503].text.count("w") == 30_000
    assert out[None].text.startswith("Big & small") and out[500].url is None
    assert H.main_text(pages.where("false")).count() == 0


def test_class_names_are_matched_whole():
    for page in (
        '<html><body class="home has-sidebar"><article><p>Text</p></article></body></html>',
        '<html class="no-js cookie-ok"><body><article><p>Text</p></article></body></html>',
        '<div class="header-wrap"><main><p>Text</p></main></div>',
        '<article class="post no-comments"><p>Text</p></article>',
    ):
        assert H.extract(page) == "Text"
    assert H.extract('<div><p>Text</p></div><div class="x Cookie-Banner"><p>Ok?</p></div><div id=comments-list><p>Hm</p></div>') == "Text"


def test_articles():
    page = "<main><article><h1>Head</h1><p>" + "word " * 50 + "</p><article class=comment>Reader</article><p>x <math><mi>a</mi><mo>=</mo></math> <button>Push</button><noscript>Off</noscript></p></article>"
    assert H.extract(page + "<article class=card><h2>Teaser</h2></article></main>") == "Head\n\n" + " ".join(["word"] * 50) + "\n\nx a= Push\n\nOff"
    two = "<article>" + "a " * 30 + "</article><article>" + "b " * 30 + "</article>"
    assert H.extract(two) == " ".join("a" * 30) + "\n\n" + " ".join("b" * 30)


def layouts(rng):
    """Two layouts on one host; no element or class name tells the constant parts."""
    pages, want = [], []
    for i in range(30):
        text = [" ".join(str(rng.random()) for _ in range(6)) for _ in range(rng.randint(2, 4))]
        if i % 3 == 0:
            text.insert(1, "A quoted paragraph.")  # on ten pages of both layouts, but of no element's vector
        paragraphs = "".join(f"<p>{t}</p>" for t in text)
        if i % 2:
            page = f"<body><div class=a1><p>Alpha shop</p></div><article>{paragraphs}<div class=a2><p>Read more at Alpha</p></div></article></body>"
        else:
            page = f"<body><article><section class=b1><p>Beta wire</p></section>{paragraphs}</article></body>"
        pages.append(page)
        want.append("\n\n".join(text))
    return pages, want


def brute_classes(pages):
    """(pages, elements, texts) of all classes with an element and a text, by comparing whole vectors."""
    read = [H.read(p)[1] for p in pages]
    kind = {t: b is None for page in read for t, b in page}
    vector = {t: tuple(sum(x == t for x, _ in page) for page in read) for t in kind}
    groups = {}
    for t, v in vector.items():
        groups.setdefault(v, []).append(kind[t])
    return sorted((sum(map(bool, v)), sum(g), len(g) - sum(g)) for v, g in groups.items() if sum(map(bool, v)) >= H.SUPPORT and 0 < sum(g) < len(g))


def test_layouts_are_told_apart_by_their_vectors(spark):
    pages, want = layouts(random.Random(2))
    df = spark.createDataFrame([(i, "http://h.example/", p) for i, p in enumerate(pages)], "page_id bigint, url string, html string")
    out = {r.page_id: r.text for r in H.main_text(df).collect()}
    assert [out[i] for i in range(len(pages))] == want
    classes, _ = H.deduce(df)
    assert sorted(tuple(r) for r in classes.select("support", "elements", "texts").collect()) == brute_classes(pages)
    # without the classes nothing is constant
    assert all(len(H.extract(p)) > len(out[i]) for i, p in enumerate(pages))


def test_interleaved_classes_are_dropped():
    template = {1: (0, True), 2: (0, True), 3: (1, True), 4: (1, True), 5: (2, True), 6: (2, True)}
    assert H.nested([1, 3, 4, 2, 9, 5], template) == ({0, 1, 2}, [0, 1, 2, 3, 5])
    assert H.nested([1, 3, 2, 4, 5, 6], template) == ({0, 2}, [0, 2, 4, 5])
    assert H.nested([3, 1, 2, 4], template)[0] == {0, 1}
    assert H.nested([], template) == (set(), [])
