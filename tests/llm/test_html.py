"""Main text where neither article elements nor names of boxes help."""

import re

import duckdb
import pytest

from siltstone.llm.html_text import SQL, extract_text, main_text, op7_html_text
from tests.conftest import DATA

PROSE = "The river rose in the night, and by morning the lower fields were under water. "
BODY = "".join(f"<p>{PROSE * (2 + k % 3)}</p>" for k in range(5))
SAID = " ".join(" ".join([PROSE.strip()] * (2 + k % 3)) for k in range(5))


@pytest.mark.parametrize("open_, close", [("<article>", "</article>"), ("<div>", "</div>"), ('<div class="post" id="x1">', "</div>"), ("", "")])
def test_boxes_go_whatever_holds_the_article(open_, close):
    page = (
        "<html><head><title>t</title><style>p{}</style></head><body><nav><a href=/>Home</a></nav><header><h1>The Site</h1></header><div>Buy now.</div>"
        f"{open_}<h1>Flood</h1>{BODY}{close}<aside><p>{PROSE}</p></aside><form><p>Write to us.</p></form><footer>&copy; us</footer><script>var p='<p>x</p>';</script>"
    )
    assert main_text(page) == f"Flood {SAID}"


def test_comments_and_sidebars():
    page = f"<body><div><h2>Flood</h2>{BODY}</div><div class='comments'><p>{PROSE * 2}</p><p>{PROSE}</p></div><div id=sidebar><ul><li><a href=1>One</a><li><a href=2>Two, three.</a></ul></div>"
    assert main_text(page) == f"Flood {SAID}"
    assert main_text(page.replace(" class='comments'", "").replace(" id=sidebar", "")) == f"Flood {SAID}"


def test_names_do_not_drop_article_text():
    inner = f'<p class="alert">{PROSE}</p><div class="share-price">Shares fell, too.</div><p id="notice">Short.</p><ul><li>One</li><li>Two</li></ul><p>{PROSE}</p>'
    for tag in ("article", "div"):
        got = main_text(f"<body><{tag}><h1>Flood</h1>{BODY}{inner}</{tag}></body>")
        assert got == f"Flood {SAID} {PROSE.strip()} Shares fell, too. Short. One Two {PROSE.strip()}"


@pytest.mark.parametrize("odd", ["<title-bar>", "<video-player></video-player>", "<svg class='i' />", "<video src=x>", "<object data=x>", "<canvas id=c>", "<script-loader src=x></script-loader>"])
def test_elements_that_are_no_raw_text(odd):
    for tag in ("article", "div"):
        assert main_text(f"<body>{odd}<{tag}><h1>Flood</h1>{BODY}</{tag}></body>") == f"Flood {SAID}"


def test_icons_and_formulas_in_a_sentence():
    said = "The <svg viewBox='0 0 1 1'><title>icon</title><path d='M0 0'/></svg>area is <math><mi>a</mi><mo>=</mo><mn>2</mn></math>, as said."
    assert main_text(f"<body><article>{BODY}<p>{said}</p></article></body>") == f"{SAID} The area is a=2, as said."


@pytest.mark.parametrize("tag", ["article", "div"])
def test_what_ends_an_article(tag):
    ends = {"<ul><li>One.</li><li>Two</li></ul>": "One. Two", "<h2>Terms</h2><dl><dt>Weir</dt><dd>A low dam.</dd></dl>": "Terms Weir A low dam.", "<blockquote>So it was.</blockquote>": "So it was.", "<blockquote><p>So it was.</p></blockquote>": "So it was."}
    for end, said in ends.items():
        assert main_text(f"<body><{tag}><h1>Flood</h1>{BODY}{end}</{tag}></body>") == f"Flood {SAID} {said}"
    if tag == "div":  # links behind an article that nothing declares
        assert main_text(f"<body><div><h1>Flood</h1>{BODY}<h2>More</h2><ul><li><a href=1>One</a></li><li><a href=2>Two</a></li></ul></div></body>") == f"Flood {SAID}"


def test_what_begins_an_article():
    for begin, said in {"<div>By A. Writer</div>": "By A. Writer", "<h1>Flood</h1><div class='byline'>By A. Writer</div>": "Flood By A. Writer", "<div><b>In short: water.</b></div><h1>Flood</h1>": "In short: water. Flood"}.items():
        assert main_text(f"<body><article>{begin}{BODY}</article></body>") == f"{said} {SAID}"


def test_names_that_begin_like_a_box():
    long = PROSE * 3
    for name in ("id='related-work'", "class='notice-board'"):
        assert main_text(f"<body><article>{BODY}<section {name}><p>{long}</p></section>{BODY}</article></body>") == f"{SAID} {long.strip()} {SAID}"
    for name in ("class='related-links'", "class='notice-bar'", "class='ad-slot'", "class='comments'"):
        assert main_text(f"<body><article>{BODY}<div {name}><p><a href=1>Read on</a></p></div>{BODY}</article></body>") == f"{SAID} {SAID}"
    assert main_text(f"<body><article>{BODY}<div class='comments'><p>{PROSE}</p></div></article></body>") == SAID


def test_share_of_pages_right_without_article_and_names():
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{DATA}/pages.parquet'")
    want = {r[0]: r[2] for r in con.execute(SQL["op7_html_text"]).fetchall()}
    pages = con.execute("select page_id, html from pages").fetchall()
    bare = {i: re.sub(r'\s(class|id|role)="[^"]*"', "", re.sub(r"</?article\b[^>]*>", "", h)) for i, h in pages}
    assert all(main_text(h) == want[i] for i, h in pages)
    assert sum(main_text(h) == want[i] for i, h in bare.items()) >= 0.9 * len(bare)


def test_odd_pages(spark):
    rows = [(1, None), (2, ""), (3, "<p>"), (4, "no markup, at all"), (5, "<div><div><p>open"), (6, "<a href=x>only a link</a>"), (7, "<" * 50), (1, "<p>again.</p>")]
    pages = spark.createDataFrame(rows, "page_id long, html string").selectExpr("page_id", "html", "'kept' as text")
    found = sorted((r.page_id, r.text, r.text_) for r in extract_text(pages).collect())
    assert [x[2] for x in found if x[0] != 7] == ["", "again.", "", "", "no markup, at all", "open", "only a link"]
    assert extract_text(pages.limit(0)).count() == 0


def test_contract(spark, sf):
    out = op7_html_text(spark, sf)
    assert out.dtypes == [("page_id", "bigint"), ("url", "string"), ("text", "string"), ("n_chars", "bigint")]
    assert all(r.n_chars == len(r.text) for r in out.collect())
