"""Main text of pages: articles of known texts in several layouts, odd markup, wrappers in any grouping, edge rows."""

import html
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from prismara.llm import page_text
from prismara.llm.page_text import aligned, dumped, extract_text, host_of, infer_wrappers, loaded, main_text, measured
from prismara.llm.page_tree import read_page

WORDS = "river stone light winter garden paper music bridge corner window letter silver market morning shadow engine".split()
SCHEMA = "page_id long, url string, html string"


def sentences(draw, n):
    return " ".join(" ".join(draw.choices(WORDS, k=draw.randint(6, 14))).capitalize() + "." for _ in range(n))


def article(draw):
    return sentences(draw, 1), [sentences(draw, draw.randint(2, 5)) for _ in range(draw.randint(2, 7))]


def links(draw, n):
    return "".join(f'<li><a href="/{k}">{draw.choice(WORDS)}</a></li>' for k in range(n))


def semantic(draw, title, body):
    ps = "".join(f"<p>{html.escape(b)}" + ("</p>" if draw.random() < 0.7 else "") for b in body)
    ad = '<div class="ad-slot">Buy now, cheap!</div>' if draw.random() < 0.5 else ""
    return f"""<!DOCTYPE html><html><head><title>{title} | Site</title><style>p{{}}</style></head><body class="has-sidebar"><header><h1>The Site</h1></header><nav><ul>{links(draw, 5)}</ul></nav>
    <main><article><header><h1>{title}</h1><p class="byline">By A. Person</p></header>{ad}{ps}<footer>Tags: x</footer></article><section id="comments"><article class="comment"><p>{sentences(draw, 2)}</p></article></section></main>
    <aside><p>{sentences(draw, 2)}</p></aside><footer>&copy; Site</footer><script>var a = "<p>no</p>";</script></body></html>"""


def classes(draw, title, body):
    ps = "\n".join(f"<p>{html.escape(b)}</p>" for b in body)
    return f"""<html><body><div class="cookie-notice">We use cookies. <button>OK</button></div><div id="topMenu"><ul>{links(draw, 6)}</ul></div><form id="aspForm"><div class="wrapper"><div class="entry-content"><h1>{title}</h1>{ps}
    <div class="shareButtons">Share this</div></div><div class="sidebar"><h3>Popular</h3><p>{sentences(draw, 4)}</p></div></div></form><div class="comments"><div><p>{sentences(draw, 3)}</p></div></div><div class="page-footer">Contact</div></body></html>"""


def soup(draw, title, body):
    """No telling name at all: only the host's other pages show what is the template's."""
    ps = "".join(f"<div>{html.escape(b)}</div>" for b in body)
    extra = f"<div><a href=1>{draw.choice(WORDS)}</a> <a href=2>{draw.choice(WORDS)}</a></div>" if draw.random() < 0.5 else ""
    return f"""<table><tr><td>Welcome to our place. Here is all there is to know about it, and more than that.</td></tr></table><div><a href=a>Home</a> <a href=b>News</a> <a href=c>Contact</a></div>{extra}
    <div><h2>{title}</h2>{ps}</div><div><div>All rights reserved by the owners of this place, whoever they are.</div></div>"""


LAYOUTS = {"semantic": semantic, "classes": classes, "soup": soup}


def pages_of(layout, n, seed=1):
    draw, rows, want = random.Random(seed), [], {}
    for k in range(n):
        title, body = article(draw)
        rows.append((k, f"http://{layout}.example.com/{k}", LAYOUTS[layout](draw, title, body)))
        want[k] = "\n".join([title, *body])
    return rows, want


@pytest.mark.parametrize("layout", ["semantic", "classes"])
def test_named_parts_alone(layout):
    rows, want = pages_of(layout, 30)
    assert {k: main_text(h) for k, _, h in rows} == want


@pytest.mark.parametrize("layout", LAYOUTS)
@pytest.mark.parametrize("limit", [1 << 24, 0])
def test_layouts_by_wrapper(spark, layout, limit):
    """The wrappers sent to the pages, and the pages to the wrappers."""
    rows, want = pages_of(layout, 40)
    got = extract_text(spark.createDataFrame(rows, SCHEMA).repartition(5), broadcast_bytes=limit)
    assert got.columns == ["page_id", "url", "html", "text"]
    assert {r["page_id"]: r["text"] for r in got.collect()} == want


def test_layouts_of_one_host_together(spark):
    rows, want = [], {}
    for n, layout in enumerate(LAYOUTS):
        some, texts = pages_of(layout, 25, seed=n + 5)
        rows += [(k + 100 * n, "https://One.Example.com/x", h) for k, _, h in some]
        want |= {k + 100 * n: t for k, t in texts.items()}
    assert {r["page_id"]: r["text"] for r in extract_text(spark.createDataFrame(rows, SCHEMA)).collect()} == want


def test_table_pages_hold_their_articles(spark, tiny):
    """On pages with one plain article element the text is what stands between its tags."""
    rows = extract_text(spark.read.parquet(f"{tiny}/pages.parquet")).collect()
    for r in rows:
        inside = re.search("<article>(.*?)</article>", r["html"], re.DOTALL)[1]
        blocks = (" ".join(html.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split("</?(?:p|h1)>", inside))
        assert r["text"] == "\n".join(b for b in blocks if b)


def test_wrappers_in_any_grouping(spark, monkeypatch):
    """A hot host: few pages a group and many rounds give the same texts as one fold over all."""
    rows, want = pages_of("soup", 90, seed=3)
    monkeypatch.setattr(page_text, "FAN", 2)
    df = spark.createDataFrame(rows, SCHEMA)
    wrappers = infer_wrappers(df.repartition(30).select(F.lit("h").alias("host"), "html")).collect()
    assert len(wrappers) == 1 and wrappers[0]["pages"] == 90
    one = loaded(wrappers[0]["shape"], wrappers[0]["stats"])
    assert {k: main_text(h, one, {}) for k, _, h in rows} == want


def test_alignment_finds_optional_and_repeated_parts():
    def shape(*sources):
        rows = [measured(read_page(s)).kids for s in sources]
        one = rows[0]
        for other in rows[1:]:
            one = aligned(one, other)
        return [(n.key, n.optional, n.repeated) for n in one]

    assert shape("<h1>a</h1><p>b</p><p>c</p>") == [("h1", False, False), ("p", False, True)]
    assert shape("<h1>a</h1><p>b</p>", "<p>b</p>") == [("h1", True, False), ("p", False, False)]
    assert shape("<div><b>a</b></div><h2>x</h2>", "<div>b</div><div>c</div><h2>y</h2>") == [("div", False, True), ("h2", False, False)]
    assert shape("<h1>a</h1><table><td>1</table>", "<h1>a</h1><div>x</div><table><td>1</table>") == [("h1", False, False), ("div", True, False), ("table", False, False)]
    long = "".join(f"<div class={'abcdefg'[k % 7]}><h2>x</h2></div><h3>y</h3>" for k in range(200))
    assert len(shape(long, long + "<ul><li>z</ul>")) <= page_text.LONGEST


def test_shapes_survive_writing():
    root = measured(read_page(semantic(random.Random(4), "A b c.", ["D e f.", "G h."])))
    stats = [s.stats for s in page_text.slots(root)]
    again = loaded(dumped(root), str(stats).replace("'", '"'))
    assert dumped(again) == dumped(root) and [s.stats for s in page_text.slots(again)] == stats


def test_odd_markup():
    for source, want in {
        "": "", "   ": "", "no tags &amp; none": "no tags & none", "a < b and c > d": "a < b and c > d", "<p>one<p>two": "one\ntwo", "<p>one</p></p></div>two": "one\ntwo",
        "<article><p>a<br>b &nbsp; c<b>d</b></p></article>": "a b cd", "<article>a<!-- <p>no</p> -->b<!-- unclosed": "ab", "<article>text<a href='x": "text", "<p>a<i": "a",
        "<article><p>x &lt;p&gt; &#65;&#x42;&eacute;&amp</p>": "x <p> ABé&", "<article><script>if (a<b) '</p>'</script>t</article>": "t", "<script>never closed": "", "<title>only": "only",
        "<article><ul><li>1<li>2<ul><li>3</ul><li>4</ul></article>": "1\n2\n3\n4", "<article><table><tr><td>a<td>b<tr><td>c</table></article>": "a\nb\nc", "<nav><p>menu</nav>": "",
        "<article><p>a<span class='ad'>buy <span>it</span></span> b</p><p hidden>c</p><div style='display: none'>d</div></article>": "a b", '<article data-x="a>b"><p>c</p></article>': "c",
        "<article><h1>T</h1><p>x <button>go</button> y</p><select><option>1</select></article>": "T\nx y", "<main><h1>T</h1><p>x</p></main><p>other words that are long, and many of them</p>": "T\nx",
        "<ARTICLE><P>Up</P></ARTICLE>": "Up", "<article>\x00a\u2028b</article>": "\x00a b", "<article><pre>a\n  b</pre></article>": "a b", "<!DOCTYPE html><?x?><article>z</article></ y>": "z",
    }.items():
        assert main_text(source) == want, source


def test_long_and_deep_pages_take_linear_time():
    deep = "<div>" * 20_000 + "inside" + "</span></div>" * 20_000
    assert main_text(deep) == "inside"
    assert main_text("<b " * 100_000 + ">x") == "x"
    assert main_text('<p title="' * 50_000) == ""
    assert main_text("<title>" * 20_000 + "x").endswith("x")
    many = "<article>" + "<p>one</p><h2>two</h2><ul><li>three</ul>" * 5_000 + "</article>"
    assert main_text(many) == "\n".join(["one", "two", "three"] * 5_000)
    cards = "<main>" + "".join(f"<div class=c{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}><h3>k</h3><div>{k}</div></div>" for k in range(3_000)) + "</main>"
    assert main_text(cards) == "\n".join(f"k\n{k}" for k in range(3_000))


def test_edge_rows(spark):
    page = "<div>Top of all pages</div><article><p>Same page</p></article>"
    rows = [(1, None, None), (2, None, page), (3, "no scheme", page), (4, "http://a.example/x", ""), (5, "http://a.example/x", page), (5, "http://a.example/x", page), (None, "http://a.example/y", page), (8, "http://A.example", "<article>" + "<p>long text</p>" * 60_000 + "</article>")]
    df = spark.createDataFrame([(*r, "t", 1, 2) for r in rows], SCHEMA + ", text string, host int, __host int")
    got = extract_text(df)
    assert got.columns == ["page_id", "url", "html", "host", "__host", "text"]
    texts = {r["page_id"]: r["text"] for r in got.collect()}
    assert got.count() == len(rows)
    assert texts == {1: "", 2: "Same page", 3: "Same page", 4: "", 5: "Same page", None: "Same page", 8: "\n".join(["long text"] * 60_000)}
    assert extract_text(spark.createDataFrame([], SCHEMA)).collect() == []
    assert extract_text(df, keep=["page_id", "text"]).columns == ["page_id", "text"]
    assert [r["html"] for r in got.where("page_id = 1").collect()] == [None]


def test_copies_of_a_page_are_no_template(spark):
    """Texts that are the same on all pages because the pages are the same stay."""
    source = "<div><h2>Title here</h2><div>Some words of the only text.</div></div>"
    rows = [(k, "http://b.example/", source) for k in range(500)]
    assert {r["text"] for r in extract_text(spark.createDataFrame(rows, SCHEMA)).collect()} == {"Title here\nSome words of the only text."}


def test_hosts(spark):
    urls = ["http://A.b:80/x", "https://x.y?q", "http://x.y#f://z", None, "nothing", "a://", "//x/y", "http://É.com/x\n"]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    assert [r[0] for r in df.select(host_of(F.col("url"))).collect()] == ["a.b:80", "x.y", "x.y", "", "", "", "", "É.com"]


def test_stats_of_two_pages_join():
    one, two = (measured(read_page(f"<h1>{t}</h1><p>same</p>")) for t in ("a", "b"))
    both = page_text.merged(one, two)
    assert [s.stats[:2][0] for s in page_text.slots(both)] == [2, 2]
    assert [s.stats[1] == page_text.VARIED for s in page_text.slots(both)] == [True, False]
    assert pa.array([s.stats[2] for s in page_text.slots(both)]).to_pylist() == [2, 8]
