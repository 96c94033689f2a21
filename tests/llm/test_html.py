import random

from pyspark.sql import functions as F

from tessera.llm import html


def text(page, path=None):
    found = html.blocks(page)
    return html.main_text(found, path if path is not None else html.best(found)[0])


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>no";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href=/x>Menu</a></ul></nav><!-- <p>hidden</p> --><div class="cookie-notice">We use cookies</div>
<div id="main"><div class="post-%d body"><h1>A &amp; B&nbsp;&lt;c&gt;</h1><p>One <b>bo</b>ld,\n  1 < 2<p>Two<br>three <i>four</i>five<div class=ad>Buy</div>
<form><input><button>Go</button></form><ul><li>i1<li>i2</ul><table><tr><td>c1<td>c2</table><section class="comments"><p>nice post</p></section></div>
<aside>Side <a href=y>links</a></aside></div><footer>&copy; me</footer></body></html>"""
WANT = "A & B <c> One bold, 1 < 2 Two three fourfive i1 i2 c1 c2"


def test_article_without_the_rest():
    assert text(PAGE % 7) == WANT


def test_broken_pages():
    assert text("") == "" and text("just text &eacute;") == "just text é"
    assert text("<p>a<p>b<div>c") == "a b c"
    assert text("<article><p>x <a href='unclosed>y</p>") .startswith("x")
    assert text("<article>ok<script>never ends <p>no") == "ok"
    assert text("<article>" + "<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"


def test_hosts_agree_on_a_path(spark):
    rows = [(i, f"https://Blog.example.com/{i}", PAGE % i) for i in range(6)]
    # a page of the host whose sidebar is larger than its article
    rows.append((6, "http://blog.example.com/odd?x", "<html><body><div id=main><div class='post-9 body'><p>short</p></div><div class=other><p>" + "filler " * 60 + "</p></div></div></body></html>"))
    rows += [(7, None, "<p>alone</p>"), (8, "https://other.org/", None), (9, "not a url", ""), (0, rows[0][1], rows[0][2])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS text", "2 AS path", "3 AS host").repartition(3)
    for most in (html.BROADCAST, 0):
        got = [(r.page_id, r.text) for r in html.extracted(df.withColumn("a.b", F.lit(1)), ["page_id", "a.b"], most).collect()]
        assert sorted(got) == sorted([*((i, WANT) for i in range(6)), (6, "short"), (7, "alone"), (8, ""), (9, ""), (0, WANT)])
    assert html.extracted(df.where("page_id < 0")).count() == 0
    # alone, the odd page can't tell its article from the box beside it: the host's vote decides
    alone = text(rows[6][2])
    assert alone.startswith("short filler") and dict(got)[6] == "short"


def test_heading_and_lead_beside_the_body_stay():
    assert text("<body><div id=main><h1>Title</h1><p>Lead</p><div class=body><p>" + "long " * 50 + "</p></div></div></body>").startswith("Title Lead long")
    assert text("<body><div><div><p>" + "one " * 70 + "</p></div><div><p>" + "two " * 30 + "</p></div></div></body>").split()[-1] == "two"
    assert text("<body><div>box<main><p>" + "one " * 70 + "</p></main></div></body>").split() == ["one"] * 70


def made(rng, host):
    """A page of a host's template, without article elements, and its text."""
    words = lambda n: " ".join(f"w{rng.randrange(999)}" for _ in range(n))
    title, paras = words(4), [words(rng.randint(8, 40)) for _ in range(rng.randint(1, 6))]
    body = "".join(f"<p>{x}</p>" for x in paras)
    box = f"<div class='c{host}'><p>{words(rng.choice([0, 0, 0, 30]))}</p></div>"  # says nothing of what it is
    page = f"<html><head><title>x</title></head><body><div class=menu><a href=/>{words(3)}</a></div><div class=page{rng.randrange(99)}><div class='t{host}'><h1>{title}</h1><div>{body}</div></div>{box}</div><div class=footer>{words(5)}</div></body></html>"
    return page, " ".join([title, *paras])


def test_recall_by_host_on_pages_without_articles(spark):
    rng = random.Random(5)
    rows, want = [], {}
    for i in range(120):
        page, want[i] = made(rng, i % 4)
        rows.append((i, f"https://h{i % 4}.org/{i}", page))
    got = {r.page_id: r.text for r in html.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    own = sum(text(page) == want[i] for i, _, page in rows)
    for host in range(4):
        assert all(got[i] == want[i] for i in got if i % 4 == host)  # all of them, where pages alone miss some
    assert own < 110
