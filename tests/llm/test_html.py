"""Main text of hand-made pages, and of all pages of the table."""

import random
import time

import pytest

from tabtrust.llm import htmltext

PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body>
<header><a href=/>Home</a></header><nav><ul><li><a href=a>One</a><li><a href=b>Two</a></ul></nav>
<div class="cookie-notice">We use cookies.</div>
<div id=content><article><h1>Title &amp; more</h1><p>First   paragraph
of text, <b>bold</b> and <a href=x>linked</a>.<p>Second &eacute;&#x20AC; one.<ul><li>item a<li>item b</ul>
<div class="advert">Buy now</div><blockquote>Quoted words here.</blockquote></article>
<div class="comments"><p>Great article, thanks a lot for it!</p></div></div>
<aside>Related</aside><form><input name=q><button>Go</button></form><footer>Footer</footer></body></html>"""


def test_page():
    assert htmltext.main_text(PAGE).split("\n\n") == ["Title & more", "First paragraph of text, bold and linked.", "Second é€ one.", "item a", "item b", "Quoted words here."]


def test_broken_pages():
    assert htmltext.main_text("") == ""
    assert htmltext.main_text("<p>only") == "only"
    assert htmltext.main_text("plain &lt;text&gt;") == "plain <text>"
    assert htmltext.main_text("<div" * 50) is not None
    assert htmltext.main_text("<script>never closed <p>x") == ""
    deep = "<div>" * 5000 + "deep words" + "</div>" * 5000
    assert htmltext.main_text(deep) == "deep words"


def test_odd_rows(spark):
    rows = [(None, None, None), (1, "u", ""), (2, "u", "<p>a</p>"), (2, "u", "<p>a</p>"), (3, None, "<p>" + "long words " * 50000)]
    pages = spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id long, url string, html string, n_chars long, Text string")
    out = htmltext.extract(pages)
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted(r["n_chars"] for r in out.collect()) == [0, 0, 1, 1, 549999]
    assert htmltext.extract(pages.where("false")).collect() == []


def test_pages(tables):
    rows = htmltext.extract(tables("pages")).collect()
    assert len(rows) == tables("pages").count() and all(r["n_chars"] == len(r["text"]) for r in rows)
    assert sum(r["n_chars"] > 0 for r in rows) >= 0.8 * len(rows)


ARTICLE = "<article><h1>Title</h1><p>First words of a paragraph.</p><p>Second words of it.</p></article>"
TEXT = "Title\n\nFirst words of a paragraph.\n\nSecond words of it."


def test_unclosed_elements_hide_nothing():
    for start in ("<svg viewBox='0 0 1 1'/>", "<math/>", "<div><select><option>a</div>", "<select><option>a<option>b", "<object data=x>", "<div><noscript></div>", "<noscript>", "<template>", "<svg><path/>"):
        assert htmltext.main_text(f"<body>{start}{ARTICLE}<p><select><option>o</select><noscript>n</noscript><svg><text>s</text></svg></p>") == TEXT, start
    inside = "<article><p>Let <math><mi>x</mi><annotation>x_0</annotation></math> be <object data=x>the fallback</object> here<svg><title>i</title><text>s</text></svg><noscript><p>n</noscript>.</p></article>"
    assert htmltext.main_text(inside) == "Let x be the fallback here."


def test_names_around_the_article():
    for around in ('<div class="layout has-sidebar">', '<div class="with-comments">', '<div id="search-layout"><div class="related-wrap">'):
        assert htmltext.main_text(f"<body>{around}{ARTICLE}<div class=comments><article class=comment>Great, thanks.</article></div></div>") == TEXT
        assert htmltext.main_text(f"<body>{around}{ARTICLE.replace('article>', 'main>')}</div>") == TEXT
    body = "<p>" + "Many words of a long text. " * 20 + "</p>"
    assert htmltext.main_text(f'<body><div class="layout has-sidebar">{body * 3}<div class="sidebar">Menu of links</div></div>').count("Many") == 60
    assert "Great" not in htmltext.main_text(f"<body>{body}<div class=comments>{'<p>Great, thanks a lot.</p>' * 90}</div>")


def test_quotes_that_do_not_pair():
    assert htmltext.main_text('<body><p title="x>First words.</p><p class="b">Second words.</p>') == "First words.\n\nSecond words."
    assert htmltext.main_text("<body><p title='a > b' data-x=\"<b>\">First words.</p><p title=it's>Second words.</p>") == "First words.\n\nSecond words."


@pytest.mark.parametrize("page", ["<b>" * 40_000 + "</i>" * 40_000, "<p x=\"'>" * 40_000, "<i><div>" + "<b>" * 40_000 + "</i>" * 40_000, "<b>" * 40_000 + "<hr>" * 40_000, "<b>" * 40_000 + "<p>x" * 40_000, "<ul>" + "<b>" * 40_000 + "<li>" * 40_000, "<span>" * 40_000 + "<td>" * 40_000, "<p title=\"" * 40_000, "<x a=\">\" " * 40_000, "a < b " * 40_000])
def test_linear(page):
    began = time.process_time()
    htmltext.main_text(page)
    assert time.process_time() - began < 8


def plain_select(nodes):
    """The same choice by definition, every sum taken over the subtree itself."""
    live = [n for n in nodes if not n.dropped]

    def below(n):
        return [n, *(x for k in n.kids if not k.dropped for x in below(k))]

    def density(n):
        tree = below(n)
        chars, tags = sum(x.own for x in tree), max(1, len(tree) - 1)
        links = [x for x in tree if any(y.tag == "a" for y in chain(x, n))]
        link_chars, link_tags = sum(x.own for x in links), sum(x.tag == "a" for x in tree)
        if not chars:
            return 0.0
        body = below(nodes[0])
        share = sum(x.own for x in body if any(y.tag == "a" for y in chain(x, nodes[0]))) / max(1, sum(x.own for x in body))
        base = htmltext.math.log(chars / max(1, chars - link_chars) * link_chars + share * chars + htmltext.math.e)
        return chars / tags * htmltext.math.log(max(1.0, chars / max(1, link_chars) * tags / max(1, link_tags)) + 1) / base

    def chain(x, top):
        out = [x]
        while x is not top:
            x = x.parent
            out.append(x)
        return out

    found = {id(n): density(n) for n in live}
    sums = {id(n): sum(found[id(k)] for k in n.kids if not k.dropped) for n in live}
    return found, max(live, key=lambda n: sums[id(n)]), sums


def test_density_by_definition():
    """Pages without article or main: densities, sums and the core are those of the definition, and the text is found."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(2, 9)))
    for _ in range(40):
        links = lambda n: "".join(f"<li><a href=x>{word()}</a>" for _ in range(n))
        paragraphs = [" ".join(word() for _ in range(rng.randint(25, 90))) + "." for _ in range(rng.randint(3, 9))]
        body = "".join(f"<p>{p}</p>" for p in paragraphs)
        page = f"<body><div class=a><ul>{links(rng.randint(3, 12))}</ul></div><div class=b><div class=c>{body}</div><div class=d><ul>{links(rng.randint(5, 20))}</ul></div></div></body>"
        nodes, items = htmltext.parse(page)
        own = dict.fromkeys(map(id, nodes), 0)
        for node, text in items:
            if text is not None:
                own[id(node)] += len(" ".join(text.split()))
        htmltext.densities(nodes, items)
        plain = [Plain(n) for n in nodes]
        twin = dict(zip(map(id, nodes), plain, strict=True))
        for p, n in zip(plain, nodes, strict=True):
            p.own, p.parent, p.kids = own[id(n)], twin.get(id(n.parent)), [twin[id(k)] for k in n.kids]
        found, core, sums = plain_select(plain)
        for p, n in zip(plain, nodes, strict=True):
            assert n.density == pytest.approx(found[id(p)]) and n.sum == pytest.approx(sums[id(p)])
        assert twin[id(max(nodes, key=lambda n: n.sum))] is core
        assert htmltext.main_text(page).split("\n\n") == paragraphs


class Plain:
    def __init__(self, node):
        self.tag, self.dropped = node.tag, node.dropped


def test_names_within_other_attributes_say_nothing():
    """Only whole attributes count: not words of a title, of data attributes or of links."""
    text = "a long paragraph of the article with many words, one after the other. " * 3
    for own in ('title="hidden gems"', 'data-state="hidden"', 'data-role="search"', 'data-class="sidebar"', "data-id='comments'", 'href="/x?id=comments"', "onclick='this.hidden = false'", 'data-style="display:none"', 'alt = "role=search"'):
        page = f"<body><article><h1>Title</h1><p>{text}</p><div {own}>kept {text}</div></article></body>"
        assert "kept" in htmltext.main_text(page), own
    for own in ("hidden", "HIDDEN=''", 'data-x="1" hidden', "role = search", "ROLE='search'", 'style="color:red; display: none"', 'aria-hidden="true"'):
        page = f"<body><article><h1>Title</h1><p>{text}</p><div {own}>gone {text}</div></article></body>"
        assert "gone" not in htmltext.main_text(page), own


def test_headings_may_be_called_headers():
    text = "a long paragraph of the content with many words, one after the other. " * 3
    page = f"<body><div class='page-header'>Site name</div><div class='content'><h2 class='section-header'>First</h2><p>{text}</p><h3 class='sub-header'>Second</h3><p>{text}</p></div></body>"
    got = htmltext.main_text(page).split("\n\n")
    assert got[0] == "First" and got[2] == "Second" and len(got) == 4
