import pytest

from stationcast.llm.main_text import Measures, extract_main_text, main_text
from stationcast.llm.wrapper import Slot, inner_text, matching, merge, parse, slots

ARTICLE = "<article class='post'><header><h1>Title &amp; more</h1></header><p>One<p>Two <b>bold</b> text<br>line<ul><li>x<li>y</ul>{extra}<p>Three&nbsp;3</article>"
PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var x="</p><p>";</script></head>
<body class="with-sidebar"><header><h1>Site</h1></header><nav><ul><li><a href=/a>a</a><li><a href=/b>b</a></ul></nav>
<div class="layout sidebar-left"><main>{article}</main><aside><p>aside text</p></aside><div class="related"><a>1</a><a>2</a></div></div>
<section class="comments"><article class="comment"><p>reader says</p></article></section><footer>foot</footer></body></html>"""
EXTRA = "<div class='ad'>buy</div><div class=notice>cookies</div><form><input><button>go</button></form><!-- no --><aside>s</aside><script>y</script>"
TEXT = "Title & more\n\nOne\n\nTwo bold text line\n\nx\n\ny\n\nThree 3"


def test_article_without_the_rest():
    assert main_text(PAGE.format(article=ARTICLE.format(extra=EXTRA)), None) == TEXT
    assert main_text(PAGE.format(article=ARTICLE.format(extra="")), None) == TEXT


@pytest.mark.parametrize("html, text", [
    (None, ""), ("", ""), ("plain", "plain"), ("<p>a<p>b", "a\n\nb"), ("<div>" * 3000 + "deep", "deep"), ("<script>x", ""),
    ("<", "<"), ("a &lt;b&gt; &#233; &nosuch;", "a <b> é &nosuch;"), ("<p>one  \n two\t</p>", "one two"), ("<nav>x</nav>", ""),
    ("<div class=menu><a>1</a></div><div id=main-content><p>t1</p><p>t2</p></div><div class=footer>f</div>", "t1\n\nt2"),
    ("<ul><li><a>1</a><li><a>2</a><li><a>3</a></ul><div><p>the text</p><p>goes on</p></div>", "the text\n\ngoes on"),
])
def test_other_pages(html, text):
    assert main_text(html, None) == text


def test_constant_parts_of_a_host_go(spark):
    box = "<div><p>Read our letter every week</p></div>"
    pages = [(i, f"http://h.com/{i}", f"<body><div class=x>{box}<p>own text {i}</p><p>more {i}</p></div></body>", "e") for i in range(6)]
    pages += [(10 + i, f"http://two.com/{i}", f"<body>{box}<p>own text of page {i}, as long as the letter</p></body>", "e") for i in range(2)]
    pages += [(20 + i, "http://copy.com/", "<article><p>the same page</p></article>", "e") for i in range(5)]
    pages += [(30, None, None, None), (31, "no host", "<p>t", None), (31, "no host", "<p>t", None)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, template string")
    got = [tuple(r) for r in extract_main_text(df).select("page_id", "text", "n_chars").orderBy("page_id").collect()]
    text = dict(zip((g[0] for g in got), (g[1] for g in got)))
    assert len(got) == len(pages) and all(n == len(t) for _, t, n in got)
    assert all(text[i] == f"own text {i}\n\nmore {i}" for i in range(6))
    assert text[10] == "Read our letter every week\n\nown text of page 0, as long as the letter"  # two pages prove nothing
    assert text[20] == "the same page" and text[30] == "" and text[31] == "t"
    assert extract_main_text(df.where("false")).count() == 0


def test_tree_matching():
    tree = lambda t: slots(parse(t))
    a, b = tree("<div><p>1</p><ul></ul><h1>x</h1></div>"), tree("<div><p>2</p><h1>x</h1><b>y</b></div>")
    assert matching(a.children, b.children)[0] == 3  # div, p, h1
    both = merge(a, b)
    assert both.pages == 2 and [(c.kind, c.pages, c.text == "*") for c in both.children[0].children] == [
        ("p", 2, True), ("ul", 1, False), ("h1", 2, False), ("b", 1, False)]
    assert Slot.load(both.dump()).dump() == both.dump()


def test_constancy_bears_odd_pages_and_counts_distinct_ones(spark):
    box = "<div><p>Read our letter every week</p></div>"
    page = "<body><div class=x>{}<p>own text {}</p></div></body>"
    pages = [(i, f"http://h.com/{i}", page.format(box, i)) for i in range(8)]
    pages += [(8, "http://h.com/8", page.format("<div><p>Read our letter of 1999</p></div>", 8))]
    table = "<article><p>the article</p><table><tr><td>its table</td></tr></table></article>"
    pages += [(20 + i, "http://copy.com/", table) for i in range(6)]
    pages += [(30 + i, f"http://copy.com/{i}", f"<article><p>other {i}</p></article>") for i in range(3)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    text = {r["page_id"]: r["text"] for r in extract_main_text(df).collect()}
    assert all(text[i] == f"own text {i}" for i in range(8)) and text[8].endswith("own text 8")
    assert all(text[20 + i] == "the article\n\nits table" for i in range(6))


@pytest.mark.parametrize("html, text", [
    ("<body><h1>T</h1><div class='post has-comments'><p>the long text of the post</p><div class=comments><p>a reader</p></div></div>",
     "the long text of the post"),
    ("<div class='page cookie-consent'><article><p>the text</p></article></div>", "the text"),
    ("<body><div class=bar>x</div><article class='category-legal'><p>the text of the law</p></article>", "the text of the law"),
    ("<body><p>short</p><div id='discussion-of-results'><p>what the results say</p></div>", "what the results say"),
    ("<article><p>short</p></article><div class=comments><article><p>a longer comment</p></article><p>ab</p></div><p>some more text of the page</p>",
     "short"),
    ("<div class=comments><p>one</p></div><div class=related><p>two</p></div>", "one\n\ntwo"),
    ("<div class='overflow-hidden'><p>seen</p></div><div class=x hidden><p>not to be seen</p></div>", "seen"),
])
def test_names_are_only_evidence(html, text):
    assert main_text(html, None) == text


def test_constant_siblings_deep_and_wide_parts_go(spark):
    letter, deep = "<p>Read our letter</p>", "<div>" * 40 + "<p>{}</p><b>deep notice</b>" + "</div>" * 40
    pages = [(i, f"http://s.com/{i}", f"<article><p>body {i}</p>{letter}<p>more {i}</p></article>") for i in range(6)]
    pages += [(10 + i, f"http://d.com/{i}", f"<body>{deep.format(f'text {i}')}</body>") for i in range(6)]
    wide = lambda i: "".join(f"<x{j}>part {j} of {i} </x{j}>" for j in range(80))
    pages += [(20 + i, f"http://w.com/{i}", f"<body>{wide(i)}<p>the same</p><p>own {i}</p></body>") for i in range(6)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    text = {r["page_id"]: r["text"] for r in extract_main_text(df).collect()}
    assert all(text[i] == f"body {i}\n\nmore {i}" for i in range(6))
    assert all(text[10 + i] == f"text {i}" for i in range(6))
    assert all("the same" not in text[20 + i] and text[20 + i].endswith(f"own {i}") for i in range(6))


def test_clashing_columns_pass(spark):
    names = ("host", "template", "paths", "texts", "host_key", "row", "path", "n", "h")
    pages = [(i, f"http://h.com/{i}", f"<article><p>text {i}</p></article>", *[f"{c}{i}" for c in names]) for i in range(5)]
    df = spark.createDataFrame(pages, ["page_id", "url", "html", *names])
    out = extract_main_text(df)
    assert out.columns == ["page_id", "url", *names, "text", "n_chars"]
    assert all(r["text"] == f"text {r['page_id']}" and all(r[c] == f"{c}{r['page_id']}" for c in names) for r in out.collect())


def test_nested_parts_are_measured_once():
    links = "<div>" * 3000 + "<p>" + "the text of the page " * 2000 + "</p>" + "<div><a>1</a><a>2</a><a>3</a></div></div>" * 3000
    assert main_text(links, None).startswith("the text of the page the text")


def test_measures_same_as_walking():
    page = parse("<div> <a> x <b>y</b></a>\n<p> <a>1<a> 2 </a></a></p><ul><li><a> </a></ul> t <i> </i> </div><p></p>")
    measures = Measures(page)
    for node in measures.order:
        links = [x for x in Measures(node).order if x.tag == "a"]
        assert measures.links.get(id(node), 0) == len(links)
        assert measures.sizes(node) == (sum(len(inner_text(x)) for x in links), len(inner_text(node).strip()))
