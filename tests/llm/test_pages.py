"""Main text of pages: templates that the weights were not fitted on, and awkward input."""

import pytest

from siftlake.llm import html

WORDS = "the story goes on with many words that make a fair paragraph of text for the reader to enjoy today"
BODY = f"<h1>A title</h1><p>{WORDS}</p><p>Second &amp; last: caf&eacute; {WORDS}.</p>"
WANT = f"A title\n\n{WORDS}\n\nSecond & last: café {WORDS}."
FURNITURE = "<nav><a href=/>Home</a> <a href=/x>News and more</a></nav>"

PAGES = {
    "article": f"<html><head><title>t</title></head><body>{FURNITURE}<article>{BODY}</article><footer>&copy; us all rights</footer></body></html>",
    "divs": f"<body><div class='site-header'>Our great site about things</div><div id=content>{BODY}</div><div class='sidebar'><p>{WORDS}</p></div></body>",
    "notice": f"<body><div class='cookie-notice'>{WORDS}</div><main>{BODY}</main><section id='comments'><p>{WORDS} I agree</p></section></body>",
    "inside": f"<body><article><h1>A title</h1><div class='ad'>buy {WORDS}</div><p>{WORDS}</p><form><label>mail</label><button>go</button></form><script>var x='<p>no</p>';</script><p>Second &amp; last: caf&eacute; {WORDS}.</p><aside>{WORDS}</aside></article></body>",
    "wrappers": f"<body class='no-sidebar'><div class='content-sidebar-wrap has-sidebar overflow-hidden'><div class='post-header'><h1>A title</h1></div><div class='entry-content'><p>{WORDS}</p><p>Second &amp; last: caf&eacute; {WORDS}.</p></div><div class='comment-body'><p>{WORDS}</p></div><div id='adBox'>{WORDS}</div></div></body>",
    "comments": f"<body><article><header><h1>A title</h1></header><p>{WORDS}</p><p>Second &amp; last: caf&eacute; {WORDS}.</p><section class='reader-comments'><h2>Comments</h2><article class='comment'><p>{WORDS}</p></article></section><p class='newsletter-signup'>Get {WORDS}</p></article></body>",
    "unclosed": f"<body>{FURNITURE}<article><h1>A title</h1><p><b>{WORDS}<br><p>Second &amp; last: caf&eacute; {WORDS}.</article><footer>x</footer>",
    "spaces": f"<body>{FURNITURE}<article><h1>\n A\ttitle </h1><p>{WORDS.replace(' ', chr(10))}</p><p>Second &amp; last: caf&#233; {WORDS}.</p></article></body>",
}


@pytest.fixture(scope="module")
def weights():
    return html.fit_weights(PAGES.values())


@pytest.mark.parametrize("name", PAGES)
def test_templates(name, weights):
    assert html.extract(PAGES[name], weights) == WANT
    assert html.extract(PAGES[name], html.DEFAULT) == WANT


def test_breaks_are_white_space(weights):
    assert html.extract("<article><p>one<br>two</p></article>", weights) == "one two"


def test_best_run_is_the_maximum():
    page = html.Page(PAGES["divs"])
    w = {"word": 1.0, "word:link": -1.0, "word:short": 0.1, "word:heading": 1.5, "marked": -3.0, "content": 0.5, "tag": -0.7}
    scores = [page.score(i, w) for i in range(len(page.steps))]
    best = max(sum(scores[i:j]) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1))
    lo, hi = page.region(w)
    assert abs(sum(scores[lo : hi + 1]) - best) < 1e-9


def test_awkward_input(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "<script>only</script>"), (4, "u", "plain words"), (5, "u", "<p>cut off <b"), (6, "u", "<!-- no end <p>x"), (7, "u", PAGES["article"]), (7, "u", PAGES["article"]), (None, "u", "<div>" * 3000 + "deep" + "</div>" * 3000), (9, "u", "<p>" + "long " * 200_000 + "</p>")]
    df = spark.createDataFrame([(*r, "x", 5) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    got = sorted(((r["page_id"], r["text"], r["n_chars"]) for r in html.extract_pages(df).collect()), key=str)
    texts = {k: t for k, t, _ in got}
    assert len(got) == len(rows) and all(len(t) == n for _, t, n in got)
    assert texts[1] == texts[2] == texts[3] == texts[6] == "" and texts[4] == "plain words" and texts[7] == WANT and texts[None] == "deep"
    assert texts[5].startswith("cut off") and texts[9] == ("long " * 200_000).strip()
    assert html.extract_pages(df.where("false")).count() == 0


LOSSES = [
    ("<article><h1>T</h1><p>one <svg-icon name=x></svg-icon> two</p><title-bar>x</title-bar><p>three</p><object-view></object-view><p>end</p></article>", "T\n\none two\n\nx\n\nthree\n\nend"),
    ("<article><p title=don't>one</p><p>two</p><p title='it>s'>three</p></article>", "one\n\ntwo\n\nthree"),
    (f"<body><div id=wrap><h1>HEAD</h1><div><p>{WORDS}</p><p>{WORDS}</p></div></div></body>", f"HEAD\n\n{WORDS}\n\n{WORDS}"),
    ("<article><p class=poll-results>one</p><div class='share-price'>two</div><p class='follow-up'>three</p><div class='ad-slot-2'>no</div><ul class='share-buttons'><li>no</li></ul></article>", "one\n\ntwo\n\nthree"),
    ("<article><p>one <![CDATA[secret]]>two</p><!--> <p>three</p><!---><p>four</p></article>", "one two\n\nthree\n\nfour"),
    (f"<body><p><a href=/>x</a> {WORDS}</p><p>{WORDS} <a name='n'/>{WORDS}</p></body>", f"x {WORDS}\n\n{WORDS} {WORDS}"),
    ("<article><p>one</p><svg width=3/><p>two</p><select><p>three</p><iframe src=x><p>four</p></article>", "one\n\ntwo\n\nthree\n\nfour"),
    ("<article><p>one</p><p>two</p></article> three <!-- not seen", "one\n\ntwo"),
    ("<article><p>1 < 2 and 3 > 2</p><p>a</3>b &#x41;&eacute;&nbsp;c</p></article>", "1 < 2 and 3 > 2\n\nab Aé c"),
    (f"<body><div class=q><h1>T</h1><p>{WORDS}</p><p>{WORDS}</p></div><div class=z1><p>Call us on monday</p></div></body>", f"T\n\n{WORDS}\n\n{WORDS}"),
]


@pytest.mark.parametrize("source, want", LOSSES)
def test_nothing_is_lost_to_odd_markup(source, want, weights):
    assert html.extract(source, html.DEFAULT) == want
    assert html.extract(source, weights) == want


def test_fitted_weights_matter():
    cells = "<table>" + "".join(f"<tr><td>word{i}</td><td>value{i}</td></tr>" for i in range(40)) + "</table>"
    page = f"<body><div>{cells}</div><div><p>{WORDS}</p></div></body>"
    w = html.fit_weights(f"<body><nav><a href=/>{WORDS}</a></nav><p>{WORDS} {i}</p><article><h1>t</h1>{cells}</article></body>" for i in range(5))
    assert html.extract(page, w).startswith("word0\n\nvalue0") and "word39" in html.extract(page, w)
    assert html.extract(page, html.DEFAULT) == WORDS


def brute_region(page, w):
    scores = [page.score(i, w) for i in range(len(page.steps))]
    runs = [(sum(scores[i : j + 1]), i, j) for i in range(len(scores)) for j in range(i, len(scores))]
    best = max(x for x, _, _ in runs)
    return None if best <= 0 else {(i, j) for x, i, j in runs if abs(x - best) < 1e-9}


def test_regions_of_the_given_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()
    w = html.fit_weights(r["html"] for r in pages)
    assert w["word"] <= 3 and w["word:short"] <= w["word"]
    for r in pages[:15]:
        page = html.Page(r["html"])
        if len(page.steps) < 200:
            assert (page.region(w) is None) == (brute_region(page, w) is None) and (page.region(w) is None or page.region(w) in brute_region(page, w))
    got = {r["page_id"]: r["text"] for r in html.extract_pages(spark.read.parquet("/root/testdata/sf0.001/pages.parquet")).collect()}
    assert got == {r["page_id"]: html.extract(r["html"], w) for r in pages}


def test_unclosed_elements_are_looked_for_once():
    import time

    start = time.time()
    html.Page("<svg><iframe><select>" * 100_000)
    html.Page("<a b='" * 100_000)
    assert time.time() - start < 60
