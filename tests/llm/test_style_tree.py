import random

from tallyforge.llm.style_tree import extract, extract_page, host_of

SCHEMA = "page_id long, url string, html string, text string, n_chars long, node long"
high = {}.get

PAGE = """<!DOCTYPE html><html><head><meta charset="utf-8"><title>T</title><style>p{margin:0}</style><script>var t="</p>";track(0);</script></head>
<body><nav><ul><li><a href="/x">x</a></li></ul></nav><!-- ad 0 --><div class="ad">Buy &amp; go</div><header class="site-header">Site</header>
<article><h1>Head &amp;  line</h1><p><b>One &lt;two&gt; &#233;&nbsp;x<br><p>Three
 four</p><aside>note</aside><div class="comments"><p>me too</p></div><form><input name="q"><button>go</button></form></article>
<div id="cookie-notice">We use</div><footer>&copy; us</footer>"""


def test_article():
    assert extract_page(PAGE, "http://a/b", high) == "Head & line\nOne <two> é x\nThree four"
    assert extract_page(None, None, high) == extract_page("", "x", high) == ""
    assert extract_page("plain  text", None, high) == "plain text"
    assert extract_page("<p>a <em>b</em>c<p>d<ul><li>e<li>f</ul>g", None, high) == "a bc\nd\ne\nf\ng"
    assert extract_page("a <b 1 < 2 & 3 &bogus; <!-- open", None, high).startswith("a")
    assert extract_page("<table><tr><td>1<td>2<tr><td>3</table>", None, high) == "1\n2\n3"
    assert extract_page("<article>x</article><article>y</article>z", None, high) == "x\ny"
    assert extract_page("<div>" * 3000 + "deep", None, high) == "deep"


def test_parts_by_name():
    page = "<body><div class='header'>Site</div><header>Top</header><div id=content><header><h1>Head</h1></header><p>Body</p><section id=comments><p>No</p></section></div><div class='side-bar sidebar'>x</div></body>"
    assert extract_page(page, None, high) == "Head\nBody"
    assert extract_page("<div class=main-menu>m</div><div>Text</div><div role=alert>a</div><p hidden>h</p>", None, high) == "Text"


def test_hosts():
    assert host_of("https://u:p@A.b.c:80/d?e") == "a.b.c:80" and host_of("//x/y") == "x" and host_of(None) == ""


def site(rng, k):
    """A page without telling tags: only repetition shows what is noise."""
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    body = [" ".join(word() for _ in range(rng.randrange(5, 30))) for _ in range(rng.randrange(1, 6))]
    paragraphs = "".join(f"<p>{b}</p>" for b in body)
    page = f"<body><div class=top><span>Home</span><span>News</span></div><div class=x>{paragraphs}</div><div class=bottom>All rights {2000 + k % 2}</div></body>"
    return page, "\n".join(body)


def rows():
    rng = random.Random(7)
    out, truth = [], {}
    for k in range(200):
        page, text = site(rng, k)
        out.append((k, f"http://site{k % 3 * (k < 150)}.org/{k}", page, "own", 1, 2))
        truth[k] = text
    out += [(500, None, None, "own", 1, 2), (501, "odd", "", None, None, None), (3, out[3][1], out[3][2], "own", 1, 2), (502, "http://alone.net/", "<div>Only</div><div>page</div>", "", 0, 0)]
    truth |= {500: "", 501: "", 502: "Only\npage"}
    return out, truth


def test_style_tree(spark):
    data, truth = rows()
    df = spark.createDataFrame(data, SCHEMA).repartition(3)
    for told in (10**6, 0):
        got = extract(df, told=told).collect()
        assert len(got) == len(data)
        assert {r.page_id: r.text for r in got} == truth
    assert extract(df.limit(0)).collect() == []


def test_copies_of_an_article_stay(spark):
    page = "<nav>menu</nav><article><p>The same story</p></article>"
    df = spark.createDataFrame([(k, "http://a.b/", page, "", 1, 1) for k in range(30)], SCHEMA)
    assert {r.text for r in extract(df).collect()} == {"The same story"}


def test_tree_decides_inside_and_beside_articles(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    data, truth = [], {}
    for k in range(24):
        body = [" ".join(word() for _ in range(20)) for _ in range(1 + k % 4)]
        note = f"By {word()}"
        inside = "".join(f"<p>{b}</p>" for b in body)
        page = f"<body><div class=k><p>Join our list</p></div><article><h1>{body[0][:9]}</h1>{inside}<div class=z>Read more on this site</div></article><div class=n>{note}</div></body>"
        data.append((k, "http://a.b/", page, "", 1, 1))
        truth[k] = "\n".join([body[0][:9], *body, note])
    df = spark.createDataFrame(data, SCHEMA).repartition(3)
    for told in (10**6, 0):
        assert {r.page_id: r.text for r in extract(df, told=told).collect()} == truth


def test_repeated_inline_parts_stay_in_their_paragraph(spark):
    data = [(k, "http://a.b/", f"<article><p><b>Note</b> of {k} things</p></article><div><i>Also</i> number {k}</div>", "", 1, 1) for k in range(9)]
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(data, SCHEMA)).collect()}
    assert got == {k: f"Note of {k} things\nAlso number {k}" for k in range(9)}


def brute_importances(pages):
    """The tree as nested dictionaries: how often each node has each style or content, and the entropy of that."""
    import math
    from collections import Counter, defaultdict

    from tallyforge.llm.style_tree import parse, style_rows

    counts = defaultdict(Counter)
    for url, html in pages:
        for node, style in style_rows(parse(html or ""), host_of(url)):
            counts[node][style] += 1
    out = {}
    for node, c in counts.items():
        m = sum(c.values()) + 1
        shares = [n / m for n in c.values()] + [1 / m]
        out[node] = (-sum(p * math.log(p) for p in shares) / math.log(m), len(c))
    return out


def test_importances_against_brute_force(spark):
    from tallyforge.llm.style_tree import BESIDE, importances

    data, _ = rows()
    truth = {k: v for k, v in brute_importances([(r[1], r[2]) for r in data]).items() if v[0] < BESIDE - 1e-9}
    got = {r.node: (r.imp, r.styles) for r in importances(spark.createDataFrame(data, SCHEMA).repartition(4)).collect() if r.imp < BESIDE - 1e-9}
    assert set(got) == set(truth) and len(got) > 10
    assert all(abs(got[k][0] - truth[k][0]) < 1e-9 and got[k][1] == truth[k][1] for k in got)


def test_ablation_tree_and_names():
    """Marked pages whose noise comes in a few variants: the tree alone removes it without the names, which leave none."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    variants = [(" ".join(f"<a>{word()}</a>" for _ in range(5)), " ".join(word() for _ in range(6))) for _ in range(6)]
    pages, truth = [], []
    for _ in range(60):
        menu, ad = rng.choice(variants)
        body = [" ".join(word() for _ in range(25)) for _ in range(3)]
        pages.append(("http://a.b/", f"<body><nav>{menu}</nav><div class=ad>{ad}</div><article>{''.join(f'<p>{x}</p>' for x in body)}</article><footer>{ad} us</footer></body>"))
        truth.append("\n".join(body))
    low = {k: v for k, v in brute_importances(pages).items() if v[0] < 0.95}
    run = lambda low, names: [extract_page(h, u, low.get, names) for u, h in pages]
    assert run(low, True) == run({}, True) == run(low, False) == truth
    assert all(a != b for a, b in zip(run({}, False), truth, strict=True))


def test_few_pages_say_little(spark):
    page = "<body><div class=q>Home News</div><div class=w><p>{}</p></div></body>"
    for n, menu in ((2, True), (3, True), (4, False), (9, False)):
        data = [(k, "http://a.b/", page.format(f"Text number {k}"), "", 1, 1) for k in range(n)]
        got = {r.text for r in extract(spark.createDataFrame(data, SCHEMA)).collect()}
        assert got == {("Home News\n" if menu else "") + f"Text number {k}" for k in range(n)}


def test_very_long_page():
    page = "<article>" + "<p>some words here</p>" * 40_000 + "</article>" + " " * 300_000
    assert extract_page(page, "http://a/", high).count("\n") == 39_999


def test_forms():
    body = "<h1>Head</h1><p>" + "Some words of the story. " * 8 + "</p>"
    text = "Head\n" + ("Some words of the story. " * 8).strip()
    # A layout in one form, as some servers make it; with and without an article element.
    for inner in (body, f"<article>{body}</article>"):
        page = f"<body><form id=aspnet action=x><nav>menu</nav><div>{inner}</div><input name=q><footer>us</footer></form></body>"
        assert extract_page(page, "http://a/", high) == text
    # A form to be filled in goes, also inside an article; so does one that is hidden.
    page = f"<body><article>{body}<form><p>Your mail</p><input><button>send</button></form></article><form hidden>{body}</form></body>"
    assert extract_page(page, "http://a/", high) == text


def test_odd_pages_take_time_in_proportion():
    import time

    makes = [
        lambda n: '<a ">"' * n + '"', lambda n: "<b>" * n + "</i>" * n, lambda n: "<a x=\">\" y='" * n, lambda n: "<i><div>" + "<b>" * n + "</i>" * n,
        lambda n: "<" * n * 4, lambda n: "<a " * n, lambda n: "<!--" * n, lambda n: "<p>x" + "<span>y</span>" * n, lambda n: '<a class="' * n, lambda n: "<p>" + "<table>" * n + "</p>" * n,
        lambda n: "<ul>" + "<li>x" * n, lambda n: "&" * n * 4, lambda n: "<script>" * n, lambda n: "<div =" + " " * n * 4 + "=" * n, lambda n: "<tr><td>" * n + "</table>" * n,
    ]
    for make in makes:
        took = []
        for n in (6000, 24000):
            began = time.perf_counter()
            extract_page(make(n), "http://a/", high)
            took.append(time.perf_counter() - began)
        assert took[1] < 8 * took[0] + 0.5, make(3)


def test_quotes():
    assert extract_page('<p title="a > b" class=x>One</p><p lang=\'>\'>Two</p>', None, high) == "One\nTwo"
    assert extract_page('<a ">"One</a>', None, high) == '"One'
    # A value that never ends: the tag ends at the next >.
    assert extract_page('<p>One</p><p class="x>Two</p><p>Three</p>', None, high) == "One\nTwo\nThree"
    assert extract_page("<p>a<!-->b<!--->c<!-- > -->d<!-- e --!>f<?php x ?>g<!doctype h>i</p>", None, high) == "abcdfgi"


def test_the_tree_overrules_names(spark):
    """A frame that is named after its sidebar holds what changes from page to page: it stays, and its menu goes."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    data, truth = [], {}
    for k in range(20):
        body = [" ".join(word() for _ in range(20)) for _ in range(2)]
        note = " ".join(word() for _ in range(5))
        page = f"<body><div class='sidebar banner'><ul><li>Home</li><li>News</li></ul><p>{body[0]}</p><p>{body[1]}</p></div><div class=comments><p>{note}</p></div></body>"
        data.append((k, "http://a.b/", page, "", 1, 1))
        truth[k] = "\n".join(body)
    df = spark.createDataFrame(data, SCHEMA).repartition(3)
    assert {r.page_id: r.text for r in extract(df).collect()} == truth
    low = {k: v for k, v in brute_importances([(r[1], r[2]) for r in data]).items() if v[0] < 0.95}
    # Without the tree the menu stays, without names the readers' comment does; with an article beside, names are believed.
    assert all(extract_page(r[2], r[1], {}.get) == "Home\nNews\n" + truth[r[0]] for r in data)
    assert all(extract_page(r[2], r[1], low.get, False) != truth[r[0]] for r in data)
    assert extract_page(data[0][2].replace("</body>", "<article>Here</article></body>"), "http://c.d/", high) == "Here"


def naive_noise(root, key, low, names):
    """The elements that are marked, by recursion from each element down and up again."""
    from tallyforge.llm import style_tree as st

    marked, repeats, facts = set(), {}, {}

    def look(node, key, article):
        if article is None and st._is_article(node) and node is not root:
            article = node
        facts[id(node)] = (node, key, article)
        if article is None or article is node:
            node.named = node.named or node.tag == "header" or "header" in node.names.replace("-", " ").replace("_", " ").split()
        if node is root or not node.noise:
            shape, places = st._style(st._inner(node), article is not None)
            for c, k in zip(st._inner(node), places, strict=True):
                look(c, st._hash(key, shape, k, c.tag, c.names), article)

    look(root, key, None)
    beside = st.BESIDE if any(a is not None for _, _, a in facts.values()) else st.THRESHOLD
    limit_of = lambda article: beside if article is None else st.THRESHOLD

    def mass(node):
        """Characters that change from page to page, and articles, below an element."""
        _, key, article = facts[id(node)]
        own = sum(map(len, st._own_words(node))) if (node is root or not node.noise) and (low(key) or (1.0, 1))[0] >= limit_of(article) else 0
        below = [mass(c) for c in st._inner(node) if id(c) in facts and not c.noise]
        return own + sum(m for m, _ in below), (article is node) + sum(a for _, a in below)

    if names:
        whole = mass(root)
        for node, _, article in list(facts.values()):
            own = mass(node)
            if node.named and article is None and own[1] == whole[1] and 2 * own[0] > whole[0]:
                node.named = False

    def composite(node):
        _, key, article = facts[id(node)]
        own, styles = low(key) or (1.0, 1)
        if node is not root and node.noise:
            return 0.0
        if article is node:
            return 1.0
        parts = [0.0 if names and c.named else composite(c) for c in st._inner(node) if id(c) in facts]
        if parts:
            top = max(parts + [own] * bool(st._own_words(node)))
            if top >= limit_of(article):
                return top
            return (1 - st.GAMMA ** max(1, styles)) * own + st.GAMMA ** max(1, styles) * sum(parts) / len(parts)
        return own

    def mark(node, parent):
        _, _, article = facts[id(node)]
        low_one = parent is not None and composite(node) < limit_of(article)
        if node.noise or (parent is not None and names and node.named) or (low_one and article is None and (node.tag in st.BLOCKS or not st._own_words(parent))):
            marked.add(id(node))
        elif low_one and article is not None and node.tag in st.BLOCKS:
            repeats.setdefault(id(article), (article, []))[1].append(node)
        for c in st._inner(node):
            if id(c) in facts:
                mark(c, node)

    mark(root, None)
    return marked, repeats


def test_marking_against_recursion():
    from tallyforge.llm import style_tree as st

    rng = random.Random(31)
    tags = ["div", "p", "span", "ul", "li", "b", "article", "nav", "header", "section", "form", "h1"]
    classes = ["", "", "", " class=ad", " class=comments", " class=x", " id=sidebar", " class='page-header y'", " hidden"]

    def some(depth):
        out = ""
        for _ in range(rng.randrange(1, 4)):
            tag = rng.choice(tags)
            inner = rng.choice(["Same text", f"word{rng.randrange(10**6)} more", ""]) + (some(depth - 1) if depth and rng.random() < 0.7 else "")
            out += f"<{tag}{rng.choice(classes)}>{inner}</{tag}>"
        return out

    templates = [some(3) for _ in range(25)]
    import re

    pages = [("http://a.b/", re.sub(r"word\d+", lambda m: f"word{rng.randrange(10**6)}", t)) for t in templates for _ in range(rng.randrange(1, 9))]
    low = {k: v for k, v in brute_importances(pages).items() if v[0] < st.BESIDE}.get
    kinds = set()
    for url, page in pages:
        for names in (True, False):
            key = st._hash("host", host_of(url))
            a, b = st.parse(page), st.parse(page)
            marked, repeats = naive_noise(a, key, low, names)
            st.mark_noise(b, key, low, names)
            pairs, todo = [], [(a, b)]
            while todo:
                x, y = todo.pop()
                pairs.append((x, y))
                todo += [(c, d) for c, d in zip(x.children, y.children, strict=True) if isinstance(c, st.Node)]
            for x, _ in pairs:
                x.noise = x.noise or id(x) in marked
            for article, nodes in repeats.values():
                whole = sum(map(len, st.blocks(article)))
                for node in nodes:
                    node.noise = True
                if 2 * sum(map(len, st.blocks(article))) < whole:
                    for node in nodes:
                        node.noise = False
            assert [x.noise for x, _ in pairs] == [y.noise for _, y in pairs], page
            kinds |= {(x.noise, x.named, id(x) in marked) for x, _ in pairs}
    assert len(kinds) >= 5
