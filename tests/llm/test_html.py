import random

import pytest

from emberlog.llm import html

SCHEMA = "page_id long, url string, html string, _text string, _drop string, key int"


def lcs(a, b):
    d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            d[i + 1][j + 1] = d[i][j] + 1 if x == y else max(d[i][j + 1], d[i + 1][j])
    return d[-1][-1]


def test_shared_lines_are_a_longest_common_subsequence():
    r = random.Random(2)
    for n in range(1500):
        kinds, most = (r.choice([2, 3, 8, 30]), 14) if n else (40, 1300)
        a, b = ([r.randrange(kinds) for _ in range(r.randrange(most) if n else most)] for _ in range(2))
        places = html.shared_lines(a, b)
        rest = iter(b)
        assert places == sorted(set(places)) and all(a[p] in rest for p in places) and len(places) == lcs(a, b)


@pytest.mark.parametrize("page,want", [
    ("<html><head><title>x</title><body><nav>menu<ul><li>a</ul></nav><article><h1>T &amp; x</h1><p><b>One<br>two<p>three &nbsp; four</article><footer>f</footer>",
     [("T & x", True), ("One two", True), ("three four", True)]),
    ("<article><header><h1>T</h1><span>by me</span></header><p>a</p><aside>no</aside><form>f</form><section class='comments'>c</section><p class=ad>ad</p>"
     " tail <script>if(a<b){'</p>'}</script>end</article>out", [("T", True), ("a", True), ("tail end", True), ("out", False)]),
    ("<p>a<p class='notice'>no<p>b<div class=sidebar>x</div>c <a href='<'>d</a> 3 < 4 &lt;", [("a", False), ("b", False), ("c d 3 < 4 <", False)]),
    ("<div role=main><div id='cookie-banner'>c</div><ul><li>i1<li>i2</ul></div><div hidden>h</div><div style='display: none'>s</div>", [("i1", True), ("i2", True)]),
    ("<!-- <p>no</p> --><table><tr><td>a<td>b<tr><td>c</table><style>p{}</style><p>&#233;&eacute;&unknown; \n x</p></div></b>", [("a b", False), ("c", False), ("éé&unknown; x", False)]),
    ("", []), (None, []), ("plain", [("plain", False)]), ("<", [("<", False)]), ("<p", [("<p", False)]), ("<p title=\"x>y</p>z", [("y", False), ("z", False)]),
    ("<div class='page header'>h</div><article class='ad'><p>kept</p></article>", [("kept", True)]),
])
def test_blocks(page, want):
    assert html.blocks_of(page) == want


def story(i):
    return f"<body><div>Site name</div><div>Top stories</div><p>story {i} text</p><p>more {i}</p><div>Copyright all</div></body>"


def test_differencing_over_any_partitioning(spark):
    rows = [(i, f"http://h{0 if i < 150 else i % 5}.org/a/{i:04d}", story(i), "t", "d", 0) for i in range(240)]
    pages = spark.createDataFrame(rows, SCHEMA)
    for parts in ("3", "8", "64"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            got = {r.page_id: r.text for r in html.extract(pages).collect()}
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "8")
        assert got == {i: f"story {i} text\n\nmore {i}" for i in range(240)}


def test_nearest_is_by_path(spark):
    page = lambda *lines: "<body>" + "".join(f"<div>{x}</div>" for x in lines) + "</body>"
    rows = [(1, "http://h/a/1", page("menu a", "one"), None, None, None), (2, "http://h/a/2", page("menu a", "two"), None, None, None),
            (3, "http://h/b/3", page("menu b", "two"), None, None, None), (4, "http://h/b/4", page("menu b", "four"), None, None, None)]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: "one", 2: "two", 3: "two", 4: "four"}


def test_awkward_rows(spark):
    long = "<article>" + "".join(f"<p>block {i}</p>" for i in range(20_000)) + "</article>"
    rows = [(1, None, story(1), "x", "y", 1), (2, "not a url", story(2), None, None, None), (3, "http://one.org/x", story(3), None, None, None),
            (None, "http://two.org/x", None, None, None, None), (4, "http://two.org/x", "", None, None, None), (5, "http://two.org/y", long, None, None, None),
            (6, "http://r.org/", story(6), None, None, None), (6, "http://r.org/", story(6), None, None, None), (None, None, None, None, None, None)]
    pages = spark.createDataFrame(rows, SCHEMA)
    got = html.extract(pages, text="_TEXT")
    assert got.columns == ["page_id", "url", "_drop", "key", "_TEXT"] and got.count() == len(rows)
    by = {(r.page_id, r.url): r._TEXT for r in got.collect()}
    assert by[1, None].startswith("Site name\n\n") and by[3, "http://one.org/x"].endswith("Copyright all")
    assert by[None, "http://two.org/x"] == by[4, "http://two.org/x"] == by[None, None] == ""
    assert by[5, "http://two.org/y"].count("\n\n") == 19_999
    assert html.extract(pages.limit(0)).count() == 0


def test_copies_of_unmarked_pages_keep_their_text(spark):
    """Repeated rows, re-crawls and mirrors of a page are one page: it is compared with one that differs, if there is one."""
    bare = lambda i: f"<body><p>story {i} text</p><p>more {i}</p></body>"
    rows = [(1, "http://h.org/a/1", story(1)), (1, "http://h.org/a/1", story(1)), (2, "http://h.org/a/1", story(1)), (3, "http://h.org/z/1?x", story(1)),
            (None, "http://h.org/a/0", story(1)), (4, "http://h.org/a/2", story(2)), (5, "http://h.org/b/2", story(2) + " <!-- other -->"),
            (6, "http://alone.org/a", bare(6)), (6, "http://alone.org/a", bare(6)), (7, "http://alone.org/b", bare(6)),
            (8, "http://m.org/a", bare(8)), (9, "http://m.org/b", f"<article>{bare(8)}</article>"), (10, "http://m.org/c", bare(8))]
    rows += [(100 + i, f"http://many.org/{i % 7}/{i}", story(100 if i % 3 else 101)) for i in range(90)]
    pages = spark.createDataFrame([(*r, None, None, None) for r in rows], SCHEMA)
    want = {1: 1, 2: 1, 3: 1, None: 1, 4: 2, 5: 2, 6: 6, 7: 6, 8: 8, 9: 8, 10: 8} | {100 + i: 100 if i % 3 else 101 for i in range(90)}
    got = html.extract(pages).collect()
    assert len(got) == len(rows) and {(r.page_id, r.text) for r in got} == {(k, f"story {i} text\n\nmore {i}") for k, i in want.items()}


@pytest.mark.parametrize("tag, kept", [
    ('p title="the hidden cost"', True), ("a title='a hidden place' href=x", True), ('p data-x="a hidden b" lang=en', True), ("p hidden", False),
    ("p hidden=until-found", False), ('p HIDDEN=""', False), ('p class="x" hidden/', False), ('section class="social-history"', True),
    ('section class="notice-period"', True), ('div id="ad-hoc"', True), ('div class="intro related-work"', True), ('div class="ad"', False),
    ('div class="box share-buttons"', False), ('div id="adSlot3"', False), ('section class="related-posts"', False), ('ol class="comment-list"', False),
    ('div class="newsletterSignupBox"', False), ('div class="cookie notice"', False)])
def test_names_and_attributes_in_an_article(tag, kept):
    """Values in quotes are no attributes, and a name is beside the text only if all of its words are."""
    name = tag.split()[0]
    found = [t for t, _ in html.blocks_of(f"<main><p>One.</p><{tag}>Three four.</{name}><p>Six.</p></main>")]
    assert ("Three four." in " ".join(found)) == kept and found[0] == "One." and "Six." in found[-1]


def test_names_outside_of_an_article():
    found = [t for t, _ in html.blocks_of('<body><div class="social-history">x</div><div class="site-header">y</div><div class="plain">z</div></body>')]
    assert found == ["z"]
