import pytest

from lathe.operators import dom, markdown, pagetree


def md(html):
    return markdown.convert(dom.parse(html))


def test_tree_of_untidy_markup():
    tree = dom.parse('<ul><li>a<li>b <b>bold<p>one<p>two</ul><script>if (a < b) { "</p>" }</script><!-- <p>no --><p>x &amp; y')
    assert [n.text().strip() for n in dom.find(tree, "li")] == ["a", "b boldonetwo"]
    assert [n.text() for n in dom.find(tree, "script")] == ['if (a < b) { "</p>" }']
    assert dom.find(tree, "p")[-1].text() == "x & y" and "no" not in tree.text()


@pytest.mark.parametrize(
    "selector,ids",
    [
        ("p", "1 2 4"), (".c", "1 3"), ("p.c", "1"), ("#x3", "3"), ("div p", "2 4"), ("div > p", "2"), ("[data-k]", "2"), ("[data-k='v']", "2"), ("[class*='d']", "1"), ("[class^=c]", "1 3"), ("p, span", "1 2 3 4"), ("section [id$='4']", "4"), ("div section p", "4"), ("*[data-k]", "2"), (".zz", ""),
    ],
)
def test_selectors(selector, ids):
    tree = dom.parse('<p class="c d" id="x1"></p><div><p id="x2" data-k="v"></p><span class="c" id="x3"></span><section><p id="x4"></p></section></div>')
    assert " ".join(n.attrs["id"][1:] for n in dom.find(tree, selector)) == ids


def test_priority_goes_by_alternative():
    tree = dom.parse("<main>m</main><article>a</article>")
    assert dom.find_by_priority(tree, "article, main").tag == "article" and dom.find_by_priority(tree, "x") is None


def test_unsupported_selector():
    with pytest.raises(ValueError):
        dom.find(dom.parse("<p>"), "p:first-child")


@pytest.mark.parametrize(
    "html,want",
    [
        ("<h2>T <code>x</code></h2>", "## T `x`"), ("<p>a<br>b</p>", "a  \nb"), ("<p>a <strong> b </strong>c", "a **b** c"), ("<em>i</em> <del>d</del>", "*i* ~~d~~"), ('<a href="/x y">l</a>', "[l](</x y>)"), ('<img src=a.png alt="A">', "![A](a.png)"), ("<hr>", "---"),
        ("<blockquote><p>q<p>r</blockquote>", "> q\n>\n> r"), ("<ol start=3><li>a<li>b</ol>", "3. a\n4. b"), ("<ul><li>a<ol><li>b</ol></ul>", "- a\n  1. b"), ('<pre><code class="language-go">x\n  y</code></pre>', "```go\nx\n  y\n```"), ("<pre>a ``` b</pre>", "````\na ``` b\n````"),
        ("<ul><li><input type=checkbox checked> done<li><input type=checkbox> open</ul>", "- [x] done\n- [ ] open"), ("<table><tr><th align=right>a</th></tr><tr><td>1</td></tr></table>", "| a |\n| --: |\n| 1 |"), ("a*b_c", "a\\*b\\_c"), ("<style>x</style><p></p>", ""), ("# not", "\\# not"), ("<code>a`b</code>", "``a`b``"),
    ],
)
def test_markdown(html, want):
    assert md(html) == want


@pytest.mark.parametrize(
    "html,name",
    [
        ('<div data-docusaurus="1">', "docusaurus"), ("<script>window.__DOCUSAURUS = 1</script>", "docusaurus"), ('<div class="md-content">', "mkdocs"), ('<div class="x rst-content">', "readthedocs"), ('<script src="/searchindex.js"></script>', "sphinx"), ('<p class="gitbook-root">', "gitbook"), ("<p>made with GitBook", "gitbook"),
        ("<p>plain", None), ('<div class="md-content"><div class="rst-content">', "mkdocs"), ("<p>Created using Sphinx", "sphinx"),
    ],
)
def test_frameworks(html, name):
    assert pagetree.framework_of(dom.parse(html)) == name


def test_content_region():
    page = "<nav>menu menu menu, menu and again more menu items</nav><div id=a>" + "<p>Long sentences, with commas, that tell something about the matter at hand.</p>" * 4 + "</div><footer>foot</footer>"
    tree = dom.parse(page)
    assert pagetree.content_of(tree, "#a", None)[0].attrs["id"] == "a"
    assert pagetree.content_of(tree, "auto", None)[0].attrs["id"] == "a"
    assert pagetree.content_of(tree, ".none", None) == (None, "Content_SelectorNotFound")
    assert pagetree.content_of(dom.parse("<div class=rst-content>r</div>"), "auto", "readthedocs")[0].text() == "r"
    assert pagetree.content_of(dom.parse(""), "auto", None)[1] == "Content_SelectorNotFound"


def test_noise_links_and_pictures():
    tree = dom.parse('<h1>T<a class="headerlink" href="#t">¶</a></h1><a href="b.html#s">in</a><a href="http://other/x">out</a><a href="#l">x</a><figure><img src="i.png" alt="alt"><figcaption> cap </figcaption></figure><img alt=" a ">')
    pagetree.clean(tree)
    assert pagetree.rewrite_links(tree, "http://h/a/", "h", "/", "out") == 1
    assert [a.attrs["href"] for a in dom.find(tree, "a")] == ["b.md#s", "http://other/x", "#l"]
    assert pagetree.pictures_of(tree) == [("i.png", "cap"), (None, "a")]
    tally = pagetree.place_pictures(tree, "http://h/a/", {"http://h/a/i.png": ("images/i_1.png", "cap")}, "out/a/index.md", "out", {"i.png": "success", "": "skipped-empty-src"})
    assert tally == {"rewrite": 1, "remove": 0, "leave": 1} and dom.find(tree, "img")[0].attrs == {"src": "../images/i_1.png", "alt": "cap"}


def test_titles_and_anchors():
    tree = dom.parse("<title> A &amp; B </title><nav><a href=1>x</a></nav><main><a href=2 rel=nofollow>y</a><a>z</a></main>")
    assert pagetree.title_of(tree) == "A & B" and pagetree.title_of(dom.parse("<p>")) == "Untitled Page"
    assert pagetree.anchors_of(tree, []) == [("1", ""), ("2", "nofollow")] and pagetree.anchors_of(tree, ["main", "main a", "body"]) == [("2", "nofollow"), ("1", "")]


def test_corpus_pages(spark):
    facts = pagetree.facts_udf("article")
    rows = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select(facts("html", "url").alias("f")).select("f.*").collect()
    assert all(r["error_type"] is None and "<nav>" not in r["content_html"] and r["content_html"].startswith("<article>") for r in rows)
