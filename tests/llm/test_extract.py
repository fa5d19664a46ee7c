"""HTML extraction on hand-made pages, and tree matching against all alignments."""

import random
from collections import Counter

import pytest

from turnloom.llm import extract as ex


@pytest.mark.parametrize(
    "html,text",
    [
        (None, ""),
        ("", ""),
        ("plain &amp; simple", "plain & simple"),
        ("<p>a<br>b  <b>c</b>d\n e<p>f", "a b cd e\n\nf"),
        ("<nav>x</nav><div id=header>h</div><article><header><h1>T</h1></header><p>One &eacute;&#233;&#x41; &am</p><div class='comments'><p>c</p></div></article><footer>f</footer>", "T\n\nOne ééA &am"),
        ("<div class='sidebar-left'>s</div><p>t</p><form><p>q</p></form><script>var a='<p>x</p>'</script><style>p{}</style><p>u</p>", "t\n\nu"),
        ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "a\n\nb\n\nc\n\nd"),
        ("<p><b>T<br><p>n</p></p></div>tail", "T\n\nn\n\ntail"),
        ("<main><p>m</p><aside>x</aside></main><p>outside</p>", "m"),
        ("<p>a <span class=ad>buy</span>b</p><p hidden>h</p><p style='display: none'>n</p>", "a\n\nb"),
        ("<table><tr><td>1<td>2<tr><td>3</table>", "1\n\n2\n\n3"),
        ("<!-- <p>no</p> --><p>yes</p><!-- open", "yes"),
    ],
)
def test_pages(html, text):
    assert ex.text_of(html, set()) == text


def size(a, b):
    """The largest match by trying every alignment."""
    if (a.tag, a.name) != (b.tag, b.name):
        return 0
    if a.tag == "#":
        return 3 if a.text == b.text else 1

    def best(i, k):
        if i == len(a.children) or k == len(b.children):
            return 0
        return max(best(i + 1, k), best(i, k + 1), size(a.children[i], b.children[k]) + best(i + 1, k + 1))

    return 1 + best(0, 0)


def test_tree_matching_is_optimal():
    rng = random.Random(7)

    def make(depth):
        return "".join(rng.choice(["<p>%s</p>" % rng.choice("xyz"), "<div>%s</div>" % (make(depth - 1) if depth else "w"), "<h2>%s</h2>" % rng.choice("xy")]) for _ in range(rng.randrange(4)))

    for _ in range(60):
        a, b = ex.tree(make(2)), ex.tree(make(2))
        got, pairs = ex.match(a, b, [10**6])
        assert got == size(a, b)
        assert all(x.tag == y.tag for x, y in pairs)


def page(k, body):
    return f"<div><span>Our site</span></div><div><p>{body}</p></div><div>All rights kept {k % 2}</div><div>Imprint</div>"


def test_wrapper_takes_what_is_constant_on_a_host(spark):
    rows = [(i, f"http://Host.example/{i}", page(i, f"body {i} text"), "z") for i in range(40)]
    rows += [(100 + i, f"http://two.example/{i}", page(i, "same body"), None) for i in range(2)]  # too few pages
    rows += [(200, None, page(0, "x"), None), (201, "http://host.example/none", None, None), (0, "http://host.example/0", page(0, "body 0 text"), "z"), (None, "http://host.example/q", page(1, "late"), "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    got = Counter((r["page_id"], r["text"], r["n_chars"] == len(r["text"])) for r in ex.extract(pages).collect())
    assert sum(got.values()) == len(rows)
    for i in range(1, 40):
        assert got[i, f"body {i} text\n\nAll rights kept {i % 2}", True] == 1
    assert got[0, "body 0 text\n\nAll rights kept 0", True] == 2
    assert got[100, "Our site\n\nsame body\n\nAll rights kept 0\n\nImprint", True] == 1
    assert got[201, "", True] == 1 and got[None, "late\n\nAll rights kept 1", True] == 1
    assert ex.extract(pages.limit(0)).count() == 0


def test_template_within_an_article_stays():
    pages = [f"<div>menu</div><article><p>shared words</p><p>{i}</p></article>" for i in range(4)]
    assert ex.induce(pages) == [("/div.", "menu")]
    assert ex.induce(pages[:2]) == [] and ex.induce([pages[0]] * 9) == []


def test_wrapper_counts_all_pages_of_mixed_hosts(spark):
    """Languages, layouts that share paths, odd pages and pages of any length on one host."""
    rows, want = [], {}

    def add(html, text):
        rows.append((len(rows), f"http://mixed.example/{len(rows)}", html))
        want[len(rows) - 1] = text

    for i in range(20):
        for lang, menu in (("en", "Read our terms"), ("de-AT", "Impressum lesen")):
            add(f"<html lang={lang}><body><div>{menu}</div><p>{lang} body {i}</p></body></html>", f"{lang} body {i}")
        add(f"<body><div>Shop</div><table><tr><td>price {i}</td></tr></table></body>", f"price {i}")
        add(f"<body><div>Forum</div><blockquote>post {i}</blockquote></body>", f"post {i}")
    add("<html lang=en><body><div>odd page</div><p>odd</p></body></html>", "odd page\n\nodd")
    for i in range(4):  # long pages, with many children
        add("<body class=long><h2>Long site</h2>" + f"<p>long {i} " + "x" * 210_000 + "</p>" + "".join(f"<p>{i}.{k}</p>" for k in range(700)) + "<h3>The end</h3></body>", None)
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    for r in ex.extract(pages).collect():
        if want[r["page_id"]] is None:
            assert r["text"].startswith("long ") and r["text"].endswith(".699") and "Long site" not in r["text"]
        else:
            assert r["text"] == want[r["page_id"]]


def test_counts_find_what_tree_matching_finds(spark):
    htmls = [page(k, f"body {k}") for k in range(5)]
    shared = ex.induce(htmls)
    assert shared == [("/div.", "Imprint"), ("/div.", "Our site")]
    pages = spark.createDataFrame([(k, "http://a.example/", h) for k, h in enumerate(htmls)], "page_id long, url string, html string")
    for r in ex.extract(pages).collect():
        assert not {t for _, t in shared} & set(r["text"].split("\n\n"))


def brute_wrapper(pages):
    """The text of each (host, html), with templates counted block by block over different pages."""
    def place(n):
        return ex.path_of(n)

    kinds = {}
    for host, html in dict.fromkeys(p for p in pages if p[1] is not None):
        root = ex.tree(html)
        outside = [n for n in ex.leaves(root) if not n.inside]
        layout = ("layout", frozenset(map(place, outside)))
        for group in {("slot", place(n)) for n in outside} | ({layout} if outside else set()):
            found = kinds.setdefault((host, root.lang, group), [0, Counter()])
            found[0] += 1
            found[1].update({(place(n), n.text) for n in outside if group == layout or group[1] == place(n)})
    out = []
    for host, html in pages:
        root = ex.tree(html)
        every = list(ex.leaves(root))
        layout = ("layout", frozenset(place(n) for n in every if not n.inside))
        left = []
        for n in every:
            told = [kinds.get((host, root.lang, g)) for g in (("slot", place(n)), layout)] if not n.inside else []
            if not any(k and k[1][place(n), n.text] >= max(ex.MIN_PAGES, ex.SHARE * k[0]) for k in told):
                left.append(n)
        left = [n for n in left if not n.drop]
        out.append("\n\n".join(n.text for n in ([n for n in left if n.inside] or left)))
    return out


def test_wrappers_equal_counting_by_hand(spark):
    rng = random.Random(11)
    words = ["home", "about", "terms", "cats", "dogs", "news"]

    def make(host):
        parts = [f"<div>{rng.choice(words[: 1 + host % 3])}</div>", f"<nav><ul><li>{rng.choice(words[:2])}</ul></nav>", f"<div><p>{rng.choice(words)} {rng.randrange(50)}</p></div>", "<p>all rights</p>", f"<div class=ad>{rng.choice(words)}</div>"]
        body = "".join(p for p in parts if rng.random() < 0.85)
        if rng.random() < 0.3:
            body += f"<article><p>{rng.choice(words)}</p><p>all rights</p></article>"
        return f"<html lang={rng.choice(['en', 'de'])}><body>{body}</body></html>"

    rows = [(k % 4, make(k % 4)) for k in range(160)]
    rows += rows[:7] + [(1, None), (2, "")]
    pages = spark.createDataFrame([(i, f"http://h{h}.example/{i}", html) for i, (h, html) in enumerate(rows)], "page_id long, url string, html string").repartition(5)
    want = brute_wrapper([(f"h{h}.example", html) for h, html in rows])
    got = {r["page_id"]: r["text"] for r in ex.extract(pages).collect()}
    assert [got[i] for i in range(len(rows))] == want
    plain = [ex.text_of(html, set()) for _, html in rows]
    assert sum(a != b for a, b in zip(want, plain)) > 40  # the wrapper changes pages


def test_menus_are_template_before_any_rule_of_elements():
    pages = [f"<nav><a>Home</a></nav><div class=footer>Imprint</div><p>{i}</p>" for i in range(4)]
    assert ex.induce(pages) == [("/div.footer", "Imprint"), ("/nav.", "Home")]


def test_deep_pages(spark):
    deep = ["<div>" * 3000 + f"<p>bottom {i}</p>" + "<b>" * 3000 + f"x{i}" + "</div>" * 3000 + "<p>shared</p>" for i in range(3)]
    assert ex.induce(deep) == [("/p.", "shared")]
    pages = spark.createDataFrame([(i, "http://deep.example/", h) for i, h in enumerate(deep)], "page_id long, url string, html string")
    assert {r["page_id"]: r["text"][:8] for r in ex.extract(pages).collect()} == {i: f"bottom {i}" for i in range(3)}
