import random
import re

import pyarrow.parquet as pq

from corpusloom.llm import extract

SCHEMA = "page_id long, url string, html string, text string, n_chars string"
LONG = "This sentence belongs to the article and is long enough to count as running text, as it goes on for a while."

PAGE = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body class="no-sidebar">
<div id="cookie-notice">We use cookies <a href=x>ok</a></div><header><h2>Site</h2></header>
<nav><ul><li><a href="/a">Home</a><li><a href="/b">News</a></ul></nav><!-- ad 1 --><div class="ad">Buy now, the best offer of the whole year, really cheap.</div>
<article><header><h1>Head &amp; line</h1></header><p>{LONG}<p>Short.</p><p><b>Bold</b>face&nbsp;x<br>new  line</p>
<aside>Related</aside><form><input name=q><label>Search</label></form><p>{LONG}</p><p>End.</p><section class="comments"><p>{LONG} said a reader</p></section></article>
<div class="sidebar"><p>{LONG}</p></div><footer>&copy; all</footer></body></html>"""


def test_article_without_boilerplate():
    assert extract.main_text(PAGE) == f"Head & line {LONG} Short. Boldface x new line {LONG} End."


def test_page_without_semantic_elements():
    page = f"<body><div><a href=1>One</a> | <a href=2>Two</a></div><div><a href=3>Three</a></div><h1>Head</h1><div>{LONG}</div><div>Short line</div><div>{LONG}</div><div></div><div><a href=1>x</a></div><div><a href=2>y</a></div></body>"
    assert extract.main_text(page) == f"Head {LONG} Short line {LONG}"


def test_broken_and_truncated_pages():
    assert extract.main_text(f"<article><h1>H</h1><p><b>{LONG}<br><p>Tail</article><footer>f") == f"H {LONG} Tail"
    assert extract.main_text(f"<article><p>{LONG} <a href='x") == LONG
    assert extract.main_text("<script>x") == "" and extract.main_text("<nav><a>x</a></nav>") == ""
    assert extract.main_text(None) == "" and extract.main_text("") == ""


def test_query_rows(spark):
    rows = [(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (3, "v", ""), (None, "w", f"<main>{LONG * 2000}</main>")]
    got = extract.extract(spark.createDataFrame([(*r, "t", "n") for r in rows], SCHEMA)).collect()
    assert len(got) == 5 and all(r.n_chars == len(r.text) for r in got)
    assert [r.text for r in got if r.page_id in (2, 3)] == ["", ""]
    assert next(r.n_chars for r in got if r.page_id is None) == len(LONG) * 2000
    assert extract.extract(spark.createDataFrame([], SCHEMA)).count() == 0


def test_everything_from_surge_to_dive_stays():
    body = lambda lines: "<body>" + "".join(f"<div>{x}</div>" for x in lines) + "</body>"
    for sizes in ([110, 110, 4], [9, 600, 500, 5, 4, 6, 5, 4, 120, 70]):
        lines = [chr(97 + i) * n for i, n in enumerate(sizes)]
        assert extract.main_text(body(lines)) == " ".join(lines)
    linked = f"See <a href=1>{'link ' * 30}</a>here"
    assert extract.main_text(body([LONG, linked, LONG, "<a href=2>Next</a>"])) == f"{LONG} See {'link ' * 30}here {LONG}"


def test_ids_of_titles_inside_an_article_are_no_noise():
    page = f"<article><section id='discussion'><h2 id='search'>Search</h2><p id='side-effects'>{LONG}</p></section><section class='comments'>{LONG}</section></article>"
    assert extract.main_text(page) == f"Search {LONG}"


def test_menu_lines_before_the_text_go():
    words = "word " * 60
    assert extract.main_text(f"<div>Home</div><div>Log on</div><p>{words}</p>") == words.strip()
    closing = [f"<p>{'word ' * 400}</p>", *["<p>Short.</p>"] * 4, f"<p>{'last ' * 40}</p>"]
    assert extract.main_text("".join(closing)).endswith("last") and "Short. Short. Short. Short." in extract.main_text("".join(closing))


def test_the_windows_decide_with_and_without_an_article_element():
    outer = f"<div>{LONG}</div>"
    article = f"<article><h1>Head</h1><p>{LONG}</p><p>End.</p></article>"
    assert extract.main_text(outer + article) == f"Head {LONG} End."
    # A teaser's element doesn't hide a text that is far longer.
    body = [f"<div>{LONG * 6}</div>" for _ in range(3)]
    assert LONG * 6 in extract.main_text(f"<article><p>{LONG}</p></article>" + "".join(body))
    assert extract.main_text(re.sub(r"(</?)article", r"\1div", article)) == f"Head {LONG} End."


def test_pages_of_the_table_keep_their_text_without_the_element():
    pages = [r["html"] or "" for r in pq.read_table("/root/testdata/sf0.01/pages.parquet", columns=["html"]).to_pylist()]
    texts = [extract.main_text(p) for p in pages]
    plain = [extract.main_text(re.sub(r"<(/?)article\b", r"<\1div", p)) for p in pages]
    assert sum(a == b for a, b in zip(texts, plain)) >= 0.99 * len(pages)
    assert not any(re.search(r"</?[a-z]+[^>]*>", t) for t in texts)


def test_quotes_outside_of_values_are_characters():
    assert extract.main_text(f"<p data-x=it's>{LONG}</p>") == LONG
    assert extract.main_text(f"<p title=\"a > b\" data-class='ad' data-x=\"class=ad\">{LONG}</p>") == LONG
    assert extract.main_text("<p " + "a='b' = \"" * 20_000 + f"<p>{LONG}</p>") in ("", LONG)


def test_range_matches_sums_counted_anew():
    rng = random.Random(3)
    for _ in range(300):
        sizes = [rng.choice([2, 5, 12, 30, 60, 200]) for _ in range(rng.randrange(1, 14))]
        lines = [chr(97 + i) * n for i, n in enumerate(sizes)]
        n = len(sizes)
        starts = [i for i in range(n) if sizes[i] >= 20 and sum(sizes[i : i + 3]) >= 80]
        ends = [i for i in range(n) if sizes[i] >= 20 and sum(sizes[max(0, i - 2) : i + 1]) >= 80]
        a, b = (starts[0], ends[-1]) if starts and ends and starts[0] <= ends[-1] else (0, n - 1)
        if (a, b) != (0, n - 1):
            a, b = 0 if a == 1 else a, n - 1 if b == n - 2 else b
        assert extract.main_text("".join(f"<div>{x}</div>" for x in lines)) == " ".join(lines[a : b + 1])
