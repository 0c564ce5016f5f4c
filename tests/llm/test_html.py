"""Operator 13: page parsing, tree matching, induced wrappers and whole tables."""

import html
import re

from binscope.llm import op13_html as H
from binscope.llm import queries as Q
from tests.llm.test_contracts import edge_dir  # noqa: F401


def text_of(source, template=frozenset()):
    return H.Page(source).content(set(template))


def article(source):
    """The article of a test page by splitting at its tags."""
    parts = re.split(r"</?(?:p|h1)>", re.search(r"<article>(.*?)</article>", source, re.S)[1])
    parts = [" ".join(html.unescape(re.sub("<br>", " ", re.sub("</?b>", "", p))).split()) for p in parts]
    return "\n".join(p for p in parts if p)


def test_tables(spark, sf001):
    for d in (sf001, "/root/testdata/sf0.01"):
        pages = {r.page_id: r for r in spark.read.parquet(f"{d}/pages.parquet").collect()}
        got = Q.op13(spark, d).collect()
        assert len(got) == len(pages)
        for r in got:
            assert r.text == article(pages[r.page_id].html) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


def test_markup():
    assert text_of("<p>a &lt;b&gt; &eacute;&#x41;&#66; &amp&copy</p>") == "a <b> éAB &©"
    assert text_of("<p>one<p> two \n\t three<b>bold</b>x<br>y<div>z</div>w") == "one\ntwo threeboldx y\nz\nw"
    assert text_of("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>") == "a\nb\nc\nd"
    assert text_of("<table><tr><td>1<td>2<tr><th>3</table>") == "1\n2\n3"
    assert text_of("<script>var x='</p><p>no'</script><style>p{}</style><!-- <p>no --><p>yes") == "yes"
    assert text_of("<p>1 < 2 <3 a<b c</p>") == "1 < 2 <3 a"
    assert text_of("") == text_of("<p>  </p>") == text_of("<nav>x</nav>") == ""
    assert text_of("<a href='x>y'>l</a><p title=\"</p>\">t") == "l\nt"


def test_declared_parts():
    page = """<body class="with-sidebar"><header><h1>Site</h1></header><nav>menu</nav><div class="cookie-notice">ok?</div>
      <div id="page" class="page-sidebar"><aside>side</aside><article><header><h1>Title</h1></header><p>First.</p>
      <form><p>mail</p></form><div class="ad">buy</div><p>Second <span class="share-links">fb</span>end.</p>
      <footer>by</footer><section class="comments"><article class="comment"><p>nice</p></article></section></article></div>
      <footer>&copy;</footer>"""
    assert text_of(page) == "Title\nFirst.\nSecond end."


def test_container_without_article():
    page = "<body><div>top</div><div><div>menu here</div><div><h1>T</h1><div>" + "long text " * 30 + "</div><div>end</div></div></div>"
    assert text_of(page).split("\n") == ["T", ("long text " * 30).strip(), "end"]


def tree(source):
    return H.Tree(*H.Page(source).skeleton())


def best_match(a, b, x=0, y=0):
    """The size of the greatest match, by trying every choice."""
    if a.path[x] != b.path[y]:
        return 0

    def rest(us, vs):
        if not us or not vs:
            return 0
        return max(rest(us[1:], vs), rest(us, vs[1:]), best_match(a, b, us[0], vs[0]) + rest(us[1:], vs[1:]))
    return 1 + rest(a.kids[x], b.kids[y])


def test_tree_matching():
    import random
    rng = random.Random(3)

    def grow(deep):
        return "".join(f"<{t}>{rng.choice('xy')}{grow(deep - 1) if deep else ''}</{t}>"
                       for t in rng.choices(["div", "section", "ul"], k=rng.randint(0, 3)))
    for _ in range(150):
        a, b = tree(grow(3)), tree(grow(3))
        pairs = H.matched(a, b)
        assert len(pairs) == best_match(a, b)
        assert len({x for x, _ in pairs}) == len({y for _, y in pairs}) == len(pairs)
        assert all(a.path[x] == b.path[y] for x, y in pairs)


def site(n, host="s.example", shell="<div>Daily Planet</div><div><span>home news</span></div>{}<div>All rights kept</div>"):
    """Pages without telling names: the wrapper has to be learnt."""
    return [(i, f"http://{host}/{i}", "<body>" + shell.format(
        f"<div><h2>Title {i}</h2><div>Words of page {i} and no other {i * 7}.</div><div>Follow us here</div></div>")) for i in range(n)]


def test_wrapper_is_learnt(spark):
    pages = spark.createDataFrame(site(30), "page_id long, url string, html string")
    rows = {r.page_id: r.text for r in H.main_texts(pages).collect()}
    assert rows == {i: f"Title {i}\nWords of page {i} and no other {i * 7}." for i in range(30)}
    # the same for any number of partitions, and a host's wrapper is its own
    other = pages.unionByName(spark.createDataFrame(site(3, "t.example"), pages.schema)).repartition(7)
    got = {(r.url, r.text) for r in H.main_texts(other).collect()}
    assert {t for u, t in got if "s.example" in u} == set(rows.values())


def test_copies_are_no_template(spark):
    """Copies of an article that are most of a host's pages keep their text."""
    page = "<body><article><h1>Same title</h1><p>{} same long text of the article that was copied</p><p>p{}</p></article>"
    rows = [(i, f"http://c.example/{i}", page.format("The", "")) for i in range(20)]
    rows += [(20 + i, f"http://c.example/{20 + i}", page.format("The", i)) for i in range(20)]
    got = H.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert all("The same long text of the article that was copied" in r.text for r in got)


def test_edge_pages(spark, edge_dir):  # noqa: F811
    got = sorted((str(r.page_id), str(r.url), r.text, r.n_chars) for r in Q.op13(spark, edge_dir).collect())
    assert got == sorted([("1", "http://a.example/1", "one & two", 9)] * 2 + [
        ("2", "None", "x", 1), ("None", "no url", "", 0), ("3", "", "", 0), ("4", "http://a.example/2", "deep", 4),
        ("5", "http://a.example/3", "< <3", 4)])


def test_hosts(spark):
    urls = ["http://A.Example:80/x", "https://u:p@b.example?q", "ftp://c.example#f", "no", "", None]
    got = spark.createDataFrame([(u,) for u in urls], "url string").select(H.host_of("url")).collect()
    assert [r[0] for r in got] == ["a.example", "b.example", "c.example", "", "", ""]
