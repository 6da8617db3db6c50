import random
import time
from html.parser import HTMLParser
from math import e, log

import pytest

from siftloom.llm.html_text import BLOCK, densities, extract, main_text, tokens

P = ["Alpha beta gamma delta epsilon zeta eta theta, iota kappa lambda mu nu xi omicron.", "Short.", "Another paragraph of some words that go on for quite a while, and then end here at last."]
BODY = "".join(f"<p>{p}</p>" for p in P)
WANT = "\n".join(P)
NAV = "<nav><ul><li><a href='/a'>One</a></li><li><a href='/b'>Two</a></li></ul></nav>"


@pytest.mark.parametrize(
    "page, want",
    [
        (f"<html><body>{NAV}<article><h1>Title</h1>{BODY}</article><footer>Foot &copy;</footer></body></html>", f"Title\n{WANT}"),
        (f"<body><header><h1>Site</h1></header><main><h1>Title</h1>{BODY}</main><aside><p>{P[0] * 9}</p></aside>", f"Title\n{WANT}"),
        (f"<body><div class=\"side-bar sidebar\"><p>{P[0] * 9}</p></div><div id=content><h1>T</h1><div>{BODY}</div></div><div id='cookieNotice'>{P[0] * 5}</div>", f"T\n{WANT}"),
        (f"<body><article><h1>T</h1>{BODY}<section id=comments><h2>Comments</h2><article class=comment><p>{P[0] * 20}</p></article></section></article>", f"T\n{WANT}"),
        (f"<body><article><header><h1>T</h1></header>{BODY}<footer>by me</footer></article><div role=complementary>{P[0]}</div><p hidden>{P[0] * 9}</p>", f"T\n{WANT}"),
        (f"<body class='has-sidebar ad-free'><article>{BODY}<div class='ad'>{P[0] * 9}</div><form>{P[0] * 9}<input></form><script>if (a < b) '<p>x</p>'</script></article>", WANT),
        (f"<title>x</title><style>p{{}}</style>{BODY}", WANT),
        (f"<html><head><title>x</title><body><section id='comments'><p>{P[0]}</p></section><article class=post-has-comments>{BODY}</article>", WANT),
        (f"<head><meta charset=utf-8>{BODY}", WANT),
        # short article beside a long advert and long menus
        (f"<body>{NAV * 30}<div class='ad'>{P[0] * 30}</div><article><h1>A</h1><p>B</article>", "A\nB"),
        # broken markup: open b and p, an unclosed comment, quotes that never close, a tag that never ends
        ("<article><p><b>One<br>two<p>three</i></p>four</article><!-- x", "One two\nthree\nfour"),
        ("<article><p title=\"a>b\">x <a href='>'>y</a><p class=it's>z<p a=\"q>w</article>", "x y\nz\nw"),
        ("<article><ul><li>a<li>b<ul><li>c</ul><li>d</ul><table><tr><td>e<td>f<tr><td>g</table><pre>h\n  i</pre></article>", "a\nb\nc\nd\ne\nf\ng\nh i"),
        ("<article>&lt;b&gt; &amp;amp; &#233;&eacute;&nbsp;x &am &notin; 1 < 2 <3 a<b c</article>", "<b> &amp; éé x &am ∉ 1 < 2 <3 a"),
        ("", ""),
        ("<", "<"),
        ("plain words", "plain words"),
        ("<body></body>", ""),
        ("<nav>only a menu</nav>", ""),
    ],
)
def test_pages_of_many_kinds(page, want):
    assert main_text(page) == want


def test_main_text_without_landmarks_by_density():
    links = "".join(f"<li><a href=/{i}>Link number {i} to a page</a></li>" for i in range(40))
    page = f"<body><div class=x1><ul>{links}</ul></div><div class=x2>{BODY * 3}</div><div class=x3><ul>{links}</ul></div></body>"
    assert main_text(page) == "\n".join(P * 3)


def test_densities_equal_their_definition():
    rng = random.Random(4)
    n = 60
    parent = [-1] + [rng.randrange(i) for i in range(1, n)]
    parent = [-1, 0, *parent[2:]]
    chars = [rng.choice([0, 0, 3, 40, 200]) for _ in range(n)]
    linked = [c if rng.random() < 0.3 else 0 for c in chars]
    link = [x > 0 for x in linked]
    d, total = densities(parent, chars, linked, link, 0)

    def under(i):
        out = [i]
        for j in range(i + 1, n):
            if parent[j] in out:
                out.append(j)
        return out

    share = sum(linked) / sum(chars)

    def ctd(c, lc, t, lt):
        t, lt, one = max(t, 1), max(lt, 1), max(lc, 1)
        return 0 if c == 0 else c / t * log(max(c / one * t / lt, 1)) / log(log(c / max(c - lc, 1) * one + share * c + e))

    for i in range(n):
        sub = under(i)
        want = ctd(sum(chars[j] for j in sub), sum(linked[j] for j in sub), len(sub) - 1, sum(link[j] for j in sub[1:]))
        assert d[i] == pytest.approx(want)
        children = [j for j in range(n) if parent[j] == i]
        assert total[i] == pytest.approx(sum(d[j] for j in children) + (ctd(chars[i], 0, 1, 0) if children else d[i]))


def test_tokens_equal_the_standard_parser():
    class Seen(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=False)
            self.out = []

        def handle_starttag(self, tag, attrs):
            self.out.append(("open", tag))

        def handle_endtag(self, tag):
            self.out.append(("close", tag))

    rng = random.Random(1)
    for _ in range(300):
        s = "".join(rng.choice(["<p>", "</p>", "<b class='x>y'>", "</b>", "<br>", "text ", "&amp;", '<a href="/q?a=1&b=2">', "</a>", "<!-- <p> -->", "<DIV ID=a>", "</DIV >", "<script>var a='<p>';</script>"]) for _ in range(30))
        seen = Seen()
        seen.feed(s)
        seen.close()
        assert [(k, x) for k, x, _ in tokens(s) if k != "text"] == seen.out


@pytest.mark.parametrize("part", ["<div>", "<b>", "<p><td>", "</div>", "<a href=\"", "<", "<!--", "<b><div></b>", "<li><ul>", "x &", "<article>", "<h1>a", "<a x='"])
def test_time_is_linear_in_the_length(part):
    start = time.process_time()
    main_text(f"<body>{part * 40000}")
    assert time.process_time() - start < 5


def test_rows(spark):
    rows = [(1, "u", f"<article>{BODY}</article>", "k"), (1, None, f"<article>{BODY}</article>", None), (2, "v", None, None), (None, "w", "<article>é😀</article>", "k"), (3, "v", "", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted((tuple(r) for r in extract(df).collect()), key=str)
    assert got == sorted([(1, "u", WANT, len(WANT)), (1, None, WANT, len(WANT)), (2, "v", "", 0), (None, "w", "é😀", 2), (3, "v", "", 0)], key=str)
    assert extract(df.limit(0)).count() == 0


def test_no_exchange(spark):
    assert "Exchange" not in extract(spark.read.parquet("/root/testdata/sf0.001/pages.parquet"))._jdf.queryExecution().executedPlan().toString()


def test_every_inline_element_stays_within_its_block():
    for t in ("b", "i", "em", "span", "a", "code", "q", "u", "font"):
        assert t not in BLOCK and main_text(f"<article><p>x<{t}>y</{t}>z</p></article>") == "xyz"
