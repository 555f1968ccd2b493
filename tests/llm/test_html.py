import random
import time

from skyframe.llm import html

PAGE = """<!DOCTYPE html><html><head><title>{t}</title><style>p{{margin:0}}</style><script>var t="</p><p>no";</script></head><body>
<header><p>Site {h}</p></header><nav><ul><li><a href="/x">Menu</a></li></ul></nav><!-- ad <p>1</p> --><div class="ad">Buy</div>
<article class="post"><header><h1>{t}</h1></header><p><b>First &amp; <i>best</i>&nbsp;&#233;t&eacute;
 line<br>two<p>Second</p>{x}<div class="share">Share me</div><form>Mail <input> <p>me</p></form><section id="comments"><p>Nice!</p></section></article>
<aside>Side</aside><div>Plain repeated {h}</div><footer>&copy; {h}</footer></body>"""


def test_read_one():
    title, blocks, keep, _ = html.read(PAGE.format(t="T", h="H", x="<ul><li>a<li>b</ul><table><tr><td>1<td>2<tr><td>3</table>"))
    assert title == "T" and [b for b, k in zip(blocks, keep, strict=True) if k] == ["T", "First & best été line two", "Second", "a", "b", "1 2", "3"]


def test_templates_and_cases(spark):
    rows = [(i, f"http://www.h.org/{i}", PAGE.format(t=f"T{i}", h="H", x="<div>Follow us</div>" + "<p>Notice in every article</p>" + "<p>Quoted in three articles</p>" * (i < 3)), 1) for i in range(8)]
    rows += [(100 + i, "http://o.org/", PAGE.format(t="copy", h="O", x="<div>One article</div>"), 1) for i in range(8)]
    rows += [(200 + i, "http://plain.org", f"<body><div>Top bar</div><div>Text of its own {i}<p>para {i}</div>tail {i} <b>x", 1) for i in range(6)]
    rows += [(300, None, None, 1), (301, "", "", 1), (302, "nonsense", "<", 1), (303, "u", "a < b <!-- open", 1), (304, "u", "<p " * 50, 1), (305, "u", "<div>" * 2000 + "deep" + "</div>" * 2000, 1), (None, "u", "x</p></div>y", 1), (300, None, "again", 1)]
    out = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text int"))
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    got = out.collect()
    assert len(got) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in got)
    by = {r["page_id"]: r["text"] for r in got}
    assert by[2] == "T2\nQuoted in three articles" and by[3] == "T3"  # what recurs goes, in paragraphs too where it does on most pages
    assert by[104] == "copy\nFirst & best été line two\nSecond\nOne article"  # copies of one page make no template
    assert by[202] == "Text of its own 2\npara 2\ntail 2 x"
    assert sorted(r["text"] for r in got if r["page_id"] == 300) == ["", "again"]
    assert (by[301], by[302], by[303], by[305], by[None]) == ("", "<", "a < b", "deep", "x\ny")


def test_empty(spark):
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_one_title_on_all_pages(spark):
    page = "<html><head><title>My site</title></head><body><div><a href='/'>Start</a> <a href='/a'>About us</a></div><div>Words of page {i}</div><div>Seen on four {j}</div></body>"
    rows = [(i, "http://shell.org/", page.format(i=i, j=i // 4)) for i in range(8)]
    rows += [(100 + i, "http://copies.org/", page.format(i=0, j=0)) for i in range(8)]
    got = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"Words of page {i}\nSeen on four {i // 4}" for i in range(8))
    assert all(got[100 + i] == "Start About us\nWords of page 0\nSeen on four 0" for i in range(8))


def text_of(html_):
    _, blocks, keep, _ = html.read(html_)
    return "\n".join(b for b, k in zip(blocks, keep, strict=True) if k)


def test_names_dont_cost_the_article():
    words = "The words of the article itself, which are many more than the others."
    for open_, shut in [
        ('<div title="the hidden gem">', "</div>"), ('<div data-id="comments-1">', "</div>"), ('<div class="content no-sidebar">', "</div>"), ('<article class="post comments-closed">', "</article>"),
        ('<div id="social-history">', "</div>"), ("<div data-role='navigation'>", "</div>"), ('<div class="content with-menu"><main>', "</main></div>"), ('<div class="page widget"><article>', "</article></div>"),
    ]:
        assert text_of(f"<body><div class='menu'>Start</div>{open_}<p>{words}</p>{shut}<div id='comments'><article class='comment'>{'So true! ' * 30}</article></div></body>") == words, open_
    assert text_of(f"<body><article>Teaser</article><div>{words}</div></body>") == f"Teaser\n{words}"
    assert text_of(f"<body><div class='sidebar'>Side</div><article>{words}</article><div>after</div></body>") == words
    deep = "<div>" * 3000 + f"<nav>Menu</nav><p>{words}</p>" + "</div>" * 3000
    assert text_of(deep) == words


def test_dropped_inline_elements_leave_no_text_and_no_gap():
    for tag in sorted(html.DROPPED - html.BLOCK - html.RAW - html.VOID):
        for inside in ("Click me", "<div>Click <b>me</b></div>", "<option>Click me"):
            assert text_of(f"<body><p>Some words <{tag}>{inside}</{tag}>and more.</p><p>Next</p></body>") == "Some words and more.\nNext", tag
    for open_ in ('<a role="navigation" href="/">', "<span hidden>", '<span class="share">', '<span aria-hidden="true">', '<b style="display: none">', '<i id="ad-1">'):
        tag = open_[1:].split()[0]
        assert text_of(f"<body><article><p>Some words of a text {open_}Share <em>me</em></{tag}>and more.</p>after</article></body>") == "Some words of a text and more.\nafter", open_
    assert text_of("<body><p>Words in <select><option>one<option>two</select>a line <svg><text>Drawn</text></svg>end.</p>") == "Words in a line end."


def test_names_and_teasers_dont_cost_the_text():
    words = "The words of the article itself, which are many more than the others. " * 4
    words = words.strip()
    for open_, shut in [('<main><div class="legal">', "</div></main>"), ('<article><div class="social-history">', "</div></article>"), ('<article><p class="legal">', "</p></article>"), ('<div class="widget">', "</div>"), ('<main><p><span class="widget">', "</span></p></main>")]:
        assert text_of(f"<body><nav>Menu</nav>{open_}{words}{shut}<div class='ad'>Buy</div></body>") == words, open_
    teaser = "A short teaser of something else."
    assert text_of(f"<body><article>{teaser}</article><div>{words}</div></body>") == f"{teaser}\n{words}"
    assert text_of(f"<body><article><p>Short.</p></article><div class='ad'>{words}</div><div id='x'>y</div></body>").startswith("Short.")
    halves = "".join(f'<div class="{c}"><p>Half of it.</p></div>' for c in ("promo", "notice", "widget"))
    assert text_of(f"<body><main>{halves}</main></body>") == "\n".join(["Half of it."] * 3)  # names don't empty a main part
    assert text_of(f"<body><article><p>{words}</p><p class='notice'>Notice</p></article></body>") == words


def test_damaged_markup_takes_linear_time():
    size = 1_000_000
    took = {}
    for unit in ("<a ", "<a b=\"'", "<div>", "<div class=ad>x", "<p><b>", "<b>x<div>y", "</b>", "<i><div><b>", "<!--", "<", "</", "<a b='", '<a b=">', "<td>x", "<li>x", "<title", "&#", "<span class=ad>x<div>", "<article>x"):
        text = unit * (size // len(unit))
        for html_ in (text, text[: size // 2] + "</section></i></div>" * (size // 40)):
            began = time.process_time()
            html.read(html_)
            took[unit] = max(took.get(unit, 0), time.process_time() - began)
    assert max(took.values()) < 20, took  # some seconds at most on a slow machine; quadratic reading took hours


def test_scanner():
    got = list(html.Scanner("a < b <p a='>'>x</p ><br/><!-- > --><!DOCTYPE x></ 1>&amp;<q b=\"1>z"))
    assert got[:6] == [("a <",), (" b ",), (False, "p", " a='>'"), ("x",), (True, "p", " "), (False, "br", "/")]
    assert got[6:] == [("&amp;",), (False, "q", ' b="1'), ("z",)]


def test_subtree_counts_by_brute_force(spark):
    """The texts that are left are those outside of subtrees on five or more different pages of a host."""
    rng = random.Random(5)
    parts = ["<div>Top <b>bar</b></div>", "<ul><li>One</li><li>Two</li></ul>", "<section><div>Near</div><div>far</div></section>", "<div>Rare one</div>", "<p>A quoted paragraph</p>"]
    plain = ["Top bar", "One\nTwo", "Near\nfar", "Rare one", "A quoted paragraph"]
    rows, own, held = [], {}, {}
    for i in range(60):
        host = rng.choice("ab")
        chosen = [j for j in range(5) if rng.random() < (0.04 if j == 3 else 0.5)]
        own[i] = (host, chosen)
        for j in chosen:
            held.setdefault((host, j), set()).add(i)
        rows.append((i, f"http://{host}/", "<body>" + "".join(parts[j] for j in chosen) + f"<div>Text of page {i}</div></body>"))
    got = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i, (host, chosen) in own.items():
        assert got[i] == "\n".join([plain[j] for j in chosen if len(held[host, j]) < 5] + [f"Text of page {i}"])


def test_large_ids_beside_nulls(spark):
    big = 2**60 + 1
    df = spark.createDataFrame([(big, "u", "a"), (None, "u", "b"), (big + 2, "u", None)], "page_id long, url string, html string").coalesce(1)
    assert {r["page_id"]: r["text"] for r in html.extract(df).collect()} == {big: "a", None: "b", big + 2: ""}
