from __future__ import annotations

import html
import math
import re
from html.parser import HTMLParser

from loomspark.llm import html_text as H

PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var s = "</p><p>no</p>";</script></head><body>
<nav><ul><li><a href="/">Home</a></li><li><a href="/x">News</a></li></ul></nav>
<div class="cookie-notice"><p>We use cookies on this site to make it work better for you.</p></div>
<main><article><h1>The  title &amp; more</h1>
<p>First paragraph of the article, with <a href="#">a link</a> and <b>bold</b> words that go on for a while.</p>
<ul><li>one item of the list</li><li>another item &lt;tagged&gt;</li></ul>
<table><tr><td>cell a</td><td>cell b</td></tr></table>
<div class="advert">Buy now!</div>
<blockquote><p>A quoted line&nbsp;of text.</p></blockquote>
<p>Second paragraph of the article,
 on two lines&#8212;and it ends here.</p></article></main>
<aside><p>Sidebar text that is long enough to look like an article, really it is.</p></aside>
<section id="comments"><p>I am a reader and this is my comment, which is long.</p></section>
<form><label>Name</label><input><button>Send</button></form>
<footer><p>Copyright of the site</p></footer></body></html>"""
TEXT = "The title & more\n\nFirst paragraph of the article, with a link and bold words that go on for a while.\n\none item of the list\n\nanother item <tagged>\n\ncell a cell b\n\nA quoted line of text.\n\nSecond paragraph of the article, on two lines—and it ends here."


def test_article_only():
    assert H.main_text(PAGE) == TEXT
    assert H.main_text(PAGE.replace("<main><article>", '<div class="content">').replace("</article></main>", "</div>")) == TEXT


def test_references_are_decoded_once():
    assert H.main_text("<table><tr><td>a &amp;lt; b</td><td><p>c</p><p>d</p></td></tr></table><p>e &amp;gt; f</p>") == "a &lt; b c d\n\ne &gt; f"


def test_density_of_nodes():
    root = H.parse("<body><div><p>" + "word " * 50 + "</p></div><div><a>x</a><a>y</a></div></body>")
    order = H.measure(root)
    first, second = (n for n in order if n.tag == "div")
    assert first.density > second.density and H.select(root)[0] is first or H.select(root)[0].tag == "body"


def test_defined_cases(spark):
    deep = "<div>" * 40_000 + "deep text" + "</div>" * 40_000
    rows = [(1, "u", None), (2, "u", ""), (3, "u", "<p>x"), (4, "u", "plain text"), (5, "u", "<!-- never ends"), (6, "u", deep), (7, "u", PAGE), (7, "u", PAGE), (None, None, "<body><p>null id</p></body>"), (8, "u", "<script>x"), (9, "u", "a < b and c > d"), (10, "u", "<p>" + "long " * 200_000)]
    pages = spark.createDataFrame([(*r, 1, "k") for r in rows], "page_id long, url string, html string, n_chars int, text string")
    got = H.extract(pages).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    assert [by[i].text for i in (1, 2, 3, 4, 5, 6, 8)] == ["", "", "x", "plain text", "", "deep text", ""]
    assert by[7].text == TEXT and by[7].n_chars == len(TEXT) and by[None].text == "null id" and by[10].n_chars == 999_999
    assert H.extract(pages.limit(0)).count() == 0


LONG = ["The first paragraph of the story is long enough to be read as the text of an article by anyone.", "The second one goes on about the same things, and says a little more about each of them.", "The third one ends the story with a few words that nobody would want to lose from it."]


def test_names_of_the_page_are_not_those_of_the_text():
    text = "".join(f"<p>{x}</p>" for x in LONG)
    junk = "<div class='site-footer'><p>Copyright of the site and its owners</p></div><div class='sidebar'><p>Words at the side of it</p></div><div class='post-comments'><p>I liked this</p></div>"
    for start in ("<div class='layout has-sidebar'>", "<div id='page' class='no-sidebar'>", "<div class='layout sidebar-right'>", "<div class='widget'>", "<div id='main-content' class='with-comments'>"):
        assert H.main_text(f"<body>{start}{text}</div>{junk}</body>") == "\n\n".join(LONG), start
    for tag in ("article", "div"):
        assert H.main_text(f"<body><{tag}><div class='entry-header'><h1>The title</h1></div>{text}</{tag}>{junk}</body>") == "\n\n".join(["The title", *LONG])
    long = "".join(f"<p>A reader says {x}</p>" for x in LONG * 5)
    assert H.main_text(f"<body><div class='story'>{text}</div><div class='comments'>{long}</div></body>") == "\n\n".join(LONG)


def test_names_are_whole_tokens():
    text = "".join(f"<p>{x}</p>" for x in LONG)
    for start in ("<section id='social-history'>", "<div class='related-work'>", "<div class='comment-on-the-text'>"):
        end = "</" + start[1:].split()[0] + ">"
        assert H.main_text(f"<body>{start}{text}{end}</body>") == "\n\n".join(LONG), start
        assert H.main_text(f"<body><article><p>{LONG[0]}</p>{start}{text}{end}</article></body>") == "\n\n".join([LONG[0], *LONG]), start
    parts = "<p class='share-holder'>of shares</p><h2 id='notice-of-intent'>To all</h2><p id='reply-paris'>Paris replied</p><div class='entry-header'><h1>The title</h1></div>"
    assert H.main_text(f"<body><article>{text}{parts}</article></body>") == "\n\n".join([*LONG, "of shares", "To all", "Paris replied", "The title"])


def test_inline_elements_are_nodes():
    page = f"<body><article><p>{LONG[0]}</p><p>a <span class='advert'>AD inline</span>b<b hidden>secret</b>c <i style='display: none'>no</i>d</p><p><b>{LONG[1]}<br><p>{LONG[2]}</p></article></body>"
    assert H.main_text(page) == "\n\n".join([LONG[0], "a bc d", LONG[1], LONG[2]])


def test_density_decides_without_names():
    text = "".join(f"<p>{x}</p>" for x in LONG * 2)
    links = "<div>" + "".join(f"<a href='/{i}'>a link {i}</a> " for i in range(30)) + "</div>"
    assert H.main_text(f"<body>{links}<h1>The title</h1>{links}<div>{text}</div>{links}</body>") == "\n\n".join(["The title", *LONG * 2])
    assert H.main_text(f"<body><form id='aspnet'>{links}<div>{text}</div></form></body>") == "\n\n".join(LONG * 2)
    assert H.main_text(f"<body><form><p>Your name and a few words</p><input></form><div>{text}</div></body>") == "\n\n".join(LONG * 2)
    assert H.main_text(f"<body><ul><li><a href='/a'>one link</a></li></ul><div>{LONG[0]}<br><br>{LONG[1]}</div></body>") == f"{LONG[0]} {LONG[1]}"
    assert H.main_text(f"<body><div>{text}<p>yes</p></div><p>(short)</p><section>{text}</section></body>") == "\n\n".join([*LONG * 2, "yes", "(short)", *LONG * 2])


def test_attributes_as_browsers_read_them():
    for start in ("<p title=it's>", "<p title='a>b'>", '<p title="a>b" hidden-x>', "<p a'b=c\"d>", "<p 'x>", '<p x="a" "y>', "<p data-a=x'y'z class=lead>", "<p a = 'b>c' / d=e/>", "<p =x>"):
        assert H.main_text(f"<body>{start}Hello</p><p>There</p></body>") == "Hello\n\nThere", start
    assert H.main_text("<body><div><p>One <a href=it's>two</a> three</p><p>four <a href=/x/>five</a> six</p></div></body>") == "One two three\n\nfour five six"
    assert H.main_text("<body><div class=sidebar title=o'clock><p>Side</p></div><p>" + LONG[0] + "</p></body>") == LONG[0]
    assert H.main_text("<body><p>" + LONG[0] + "</p><p title='never ends>" + LONG[1]) .startswith(LONG[0])
    broken = "<p title='" + "a='\"' " * 20_000
    assert H.main_text(f"<body><p>{LONG[0]}</p>{broken}").startswith(LONG[0])  # in linear time


def test_ambiguous_names_within_the_article():
    text = "".join(f"<p>{x}</p>" for x in LONG * 2)
    parts = [("<div class='section header'><h2>Part two</h2><p>How it goes on from here.</p></div>", "Part two\n\nHow it goes on from here."), ("<p class='form'>The form of it.</p>", "The form of it."), ("<p id='search'>The search went on.</p>", "The search went on."), ("<section id='login'><h3>Logging in</h3><p>How to log in to the thing, step by step.</p></section>", "Logging in\n\nHow to log in to the thing, step by step.")]
    for part, want in parts:
        for tag in ("article", "main", "div"):
            assert H.main_text(f"<body><{tag}>{text}{part}{text}</{tag}></body>") == "\n\n".join([*LONG * 2, want, *LONG * 2]), (tag, part)
    for junk in ("<div class='search'><a href='/a'>find it</a> <a href='/b'>or that</a></div>", "<form class='login'><p>Your name, and the word that you chose for it</p><input></form>", "<div class='login'>Log in</div>", "<p class='advert'>Buy this thing today, it is very good and not dear at all</p>"):
        assert H.main_text(f"<body><article>{text}{junk}{text}</article></body>") == "\n\n".join(LONG * 4), junk
    assert H.main_text(f"<body><div class='header'><p>The name of the site and a few words of what it is about, for all to read.</p></div><article>{text}</article></body>") == "\n\n".join(LONG * 2)


def test_links_among_items_stay():
    text = "".join(f"<p>{x}</p>" for x in LONG * 2)
    items = "<ul><li>one of them is plain</li><li><a href=x>two</a></li><li>three is plain too</li></ul><p><a href=y>The whole report</a></p>"
    for tag in ("article", "div"):
        assert H.main_text(f"<body><{tag}>{text}{items}{text}</{tag}></body>") == "\n\n".join([*LONG * 2, "one of them is plain", "two", "three is plain too", "The whole report", *LONG * 2])
    menu = "<ul>" + "".join(f"<li><a href=/{i}>place {i}</a></li>" for i in range(9)) + "</ul>"
    assert H.main_text(f"<body><div>{text}{menu}{text}</div></body>") == "\n\n".join(LONG * 4)


def test_density_alone_on_the_drivers_pages():
    """Without <article>, the pages give what they give with it."""
    import pyarrow.parquet as pq

    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet")["html"].to_pylist()
    changed = [re.sub(r"<(/?)article\b", r"<\1div", p) for p in pages]
    assert sum(a != b for a, b in zip(pages, changed)) > 200
    assert [H.main_text(p) for p in changed] == [H.main_text(p) for p in pages]


class Strict(HTMLParser):
    """A tree of well-formed markup with what the paper counts: characters, tags, link characters, link tags."""

    def __init__(self, page):
        super().__init__()
        self.root = self.now = {"tag": "body", "up": None, "text": 0, "below": []}
        self.feed(page)

    def handle_starttag(self, tag, attrs):
        new = {"tag": tag, "up": self.now, "text": 0, "below": []}
        self.now["below"].append(new)
        self.now = new

    def handle_endtag(self, tag):
        self.now = self.now["up"]

    def handle_data(self, text):
        self.now["text"] += len(text.strip())


def counted(n, link=False):
    link = link or n["tag"] == "a"
    c, t, lc, lt = n["text"], 0, n["text"] if link else 0, 0
    for x in n["below"]:
        a, b, d, e = counted(x, link)
        c, t, lc, lt = c + a, t + b + 1, lc + d, lt + e + (x["tag"] == "a")
    n["counts"] = c, t, lc, lt
    return n["counts"]


def test_same_densities_as_counting_each_node():
    page = "<div><p>some <b>bold</b> words here</p><p>and <a href='/x'>a link</a> too</p></div><ul><li><a href='/y'>menu one</a></li><li><a href='/z'>menu two</a></li></ul><section>text <i>of <u>three</u> levels</i> <em>more</em></section>"
    strict = Strict(page).root
    c0, _, l0, _ = counted(strict)
    flat = []

    def walk(n):
        c, t, lc, lt = n["counts"]
        log = math.log(math.log(c / max(c - lc, 1) * lc + l0 / c0 * c + math.e) + 1)
        flat.append((n["tag"], c / max(t, 1) * math.log(max(c / max(lc, 1) * max(t, 1) / max(lt, 1), 1) + 1) / log))
        for x in n["below"]:
            walk(x)

    walk(strict)
    got = [(n.tag, n.density) for n in H.measure(H.parse(page))]
    assert [t for t, _ in got] == [t for t, _ in flat]
    assert all(abs(a - b) < 1e-9 for (_, a), (_, b) in zip(got, flat, strict=True))
    for n in H.measure(H.parse(page)):
        below = [x.density for x in n.parts if isinstance(x, H.Node)]
        assert n.total >= sum(below) - 1e-9 and (n.own or abs(n.total - sum(below)) < 1e-9)


def test_driver_pages(spark):
    """Each page holds one <article>; its text by plain patterns, without a tree."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r.text for r in H.extract(pages).collect()}
    rows = pages.collect()
    assert len(rows) == len(got) > 100
    for r in rows:
        body = re.search(r"(?s)<article>(.*)</article>", r.html)[1]
        cut = re.split(r"(?i)</?(?:p|h1|div|ul|ol|li|h2|h3|blockquote|table|tr|pre)\b[^>]*>", body.replace("<br>", " "))
        want = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in cut]
        assert got[r.page_id] == "\n\n".join(x for x in want if x)


def test_articles_split_over_containers():
    for a, b in (("<div id='lead'>", "<div id='story'>"), ("<div class='post' id='p1'>", "<div class='post' id='p2'>"), ("<section>", "<div class='more'>")):
        text = "".join(f"<p>{x}</p>" for x in LONG * 2)
        page = f"<body><div class='nav'><a href='/'>Home</a></div>{a}{text}</{a[1:].split()[0].strip('>')}>{b}{text}{text}</div><ul><li><a href='/a'>one link</a></li><li><a href='/b'>another</a></li></ul></body>"
        assert H.main_text(page) == "\n\n".join(LONG * 6), a
