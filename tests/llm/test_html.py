import math
import random
import time
import tracemalloc
from collections import defaultdict
from html.parser import HTMLParser

from quirework.llm.html import LEVEL, MARKS, SIGMA, content_paths, extract, extract_pages, text_nodes

PAGES = "page_id long, url string, html string"
PAGE = (
    "<!DOCTYPE html><html><head><title>A title, long enough.</title><style>p{}</style><script>var t='</p>';x(1)</script></head><body>"
    "<nav><ul><li><a href='/a>b'>Home</a><li><a>About</a></ul></nav><!-- a <p>comment</p> --><div class=ad>Buy now</div><article><h1>Heading</h1>"
    + "".join(f"<p>Paragraph {i} has a fair number of words, some commas, and a full stop. It goes on &amp; on, as prose does.<br>And more.</p>" for i in range(6))
    + "</article><footer>&copy; site</footer></body></html>"
)


class Paths(HTMLParser):
    """Paths of text by the parser of the standard library, for markup in which every tag is closed."""

    def __init__(self):
        super().__init__()
        self.stack, self.out = [], []

    def handle_starttag(self, tag, attrs):
        if tag not in ("br", "img"):
            self.stack.append(tag)

    def handle_endtag(self, tag):
        self.stack.pop()

    def handle_data(self, data):
        if data.strip():
            self.out.append((">".join(self.stack), " ".join(data.split())))


def random_page(r, depth=0):
    out = []
    for _ in range(r.randint(0, 4)):
        if depth < 4 and r.random() < 0.6:
            tag = r.choice(["div", "section", "b", "i", "span", "table"])
            out.append(f"<{tag} a=\"x>y\" b='z'>{random_page(r, depth + 1)}</{tag}>")
        else:
            out.append(r.choice(["words, words. ", "<br>", "a &lt; b ", "<!-- no -->", "  ", "<img src=x>", "long text. " * 9]))
    return "".join(out)


def test_nodes_as_by_another_parser():
    r = random.Random(1)
    for _ in range(300):
        page = random_page(r)
        p = Paths()
        p.feed(page)
        p.close()
        assert [(a, b) for a, b, _ in text_nodes(page)] == p.out


def by_hand(nodes):
    by = defaultdict(list)
    for p, t, _ in nodes:
        by[p].append(t)
    length = {p: sum(map(len, v)) / len(v) for p, v in by.items()}
    marks = {p: 1 + sum(len(MARKS.findall(t)) for t in v) / len(v) for p, v in by.items()}
    n = [p for p, _, _ in nodes]
    side = math.exp(-1 / (2 * SIGMA * SIGMA))

    def smooth(v, i):
        at = [(j, 1.0 if j == i else side) for j in (i - 1, i, i + 1) if 0 <= j < len(n)]
        return sum(v[n[j]] * w for j, w in at) / sum(w for _, w in at)

    fused = [smooth(length, i) * smooth(marks, i) for i in range(len(n))]
    mean = sum(fused) / len(fused)
    least = LEVEL * math.sqrt(sum((f - mean) ** 2 for f in fused) / len(fused))
    score = {p: sum(f for q, f in zip(n, fused, strict=True) if q == p) / n.count(p) for p in by}
    return {p for p, s in score.items() if s >= least - 1e-9 and not p.startswith("html>head")}


def test_ratios_by_hand():
    r = random.Random(2)
    for _ in range(200):
        nodes = text_nodes(random_page(r))
        assert set(content_paths(nodes)) == (by_hand(nodes) if nodes else set())


def test_article_is_found():
    text, nodes, n, paths = extract(PAGE)
    assert paths == ["html>body>article>p"] and n == 12
    assert text.split("\n")[0] == "Paragraph 0 has a fair number of words, some commas, and a full stop. It goes on & on, as prose does."
    assert "Home" not in text and "site" not in text and "Buy" not in text


def test_open_elements_are_closed():
    assert [p for p, _, _ in text_nodes("<p><b>one<br><p>two<ul><li>three<li>four</ul>five")] == ["p>b", "p", "ul>li", "ul>li", ""]
    assert [p for p, _, _ in text_nodes("<table><tr><td>a<td>b<tr><td>c</table>")] == ["table>tr>td"] * 3
    assert [p for p, _, _ in text_nodes("</div>x<b>y</i>z</b>")] == ["", "b", "b"]


def test_hard_pages(spark):
    pages = [None, "", " \n ", "<p></p>", "just text", "<p>a < b and <c", "<script>never closed", "<!-- never closed", "<p>" * 3000 + "deep", "x" * 300_000, PAGE, PAGE, "<a b='unclosed>text", "<![CDATA[kept]]>"]
    rows = [(None if i == 5 else i, f"u{i}", p) for i, p in enumerate(pages)]
    out = extract_pages(spark.createDataFrame(rows, PAGES).selectExpr("*", "1 text", "2 n_nodes"))
    assert out.columns == ["page_id", "text", "n_nodes", "content_nodes", "content_paths"]
    got = {r["page_id"]: r for r in out.collect()}
    assert len(got) == len(pages)
    assert all((got[i]["text"], got[i]["n_nodes"]) == ("", 0) for i in (0, 1, 2, 3, 6, 7))
    assert got[4]["text"] == "just text" and got[4]["content_paths"] == [""] and got[8]["text"] == "deep" and len(got[9]["text"]) == 300_000
    assert got[10]["text"] == got[11]["text"] == extract(PAGE)[0] and got[None]["text"] == "a < b and <c" and got[13]["text"] == "kept"
    assert extract_pages(spark.createDataFrame([], PAGES)).collect() == []


def test_time_and_memory_on_hostile_pages():
    n = 1_000_000
    for part in ("<a ", "<a", "<div>a", "<b>a<p>c", "<a '", "<a \"x' ", "</b", "<p>a</i>", "<script>x</script ", "<!-", "<table><td>a", "<p><button><b>a<h1>", "&amp", "<ul><li>a"):
        page = part * (n // len(part))
        began = time.time()
        extract(page)
        assert time.time() - began < 20, part
    tracemalloc.start()
    extract("<div>a" * 33_000)
    assert tracemalloc.get_traced_memory()[1] < 100 << 20
    tracemalloc.stop()
    deep = "<b>" * 20_000 + "<h1>a</h1>" * 20_000
    began = time.time()
    assert extract(deep)[1] == 20_000 and time.time() - began < 10


def test_tags_that_do_not_end_among_others():
    assert [(p, t) for p, t, _ in text_nodes("<b>x</b> <i 'y <u>z</u> w")] == [("b", "x"), ("", "<i 'y"), ("u", "z"), ("", "w")]
    assert [(p, t) for p, t, _ in text_nodes("a <b c=\"d <i>e</i> \"> f")] == [("", "a"), ("b", "f")]
    assert text_nodes("<div>" * 70 + "x")[0][0] == "(6)>" + ">".join(["div"] * 64)
