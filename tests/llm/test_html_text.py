import os
import random
import re

import pytest
from html.parser import HTMLParser

from phasegrid.llm.html_text import common, lines_of, main_text

PAGES = "page_id long, url string, html string, key string, at long, text int"
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def within(part, whole):
    rest = iter(whole)
    return all(x in rest for x in part)


def test_alignment_is_longest_by_rows_and_by_halves():
    r = random.Random(1)
    for _ in range(800):
        a, b = ([r.choice("abcd") for _ in range(r.randint(0, 14))] for _ in range(2))
        for most in (1 << 26, 6):
            got = common(a, b, most)
            assert got == sorted(set(got)) and len(got) == lcs(a, b) and within([a[i] for i in got], b)


@pytest.mark.parametrize(
    "page, want",
    [
        ("", []),
        ("x < y &amp; z", [("x < y & z", 1)]),
        ("<title>t</title><body><nav>m</nav><article><h1>A&nbsp;b</h1>c\n d<br>e</article>f", [("m", 2), ("A b", 0), ("c d e", 0), ("f", 1)]),
        ("<head><title>t</title><p>one<p>two", [("one", 1), ("two", 1)]),
        ("<p>buy <span class='ad'>now</span>it</p>", [("now", 2), ("buy it", 1)]),
        ("<div class='cookie-notice'><p>ok</div><p>x", [("ok", 2), ("x", 1)]),
        ("<main><p>a<div id=comments><p>no</div><aside>s</aside><header>h</header></main><header>top</header>", [("a", 0), ("no", 2), ("s", 2), ("h", 0), ("top", 2)]),
        ("<script>if (a</b) '</p>'</script>t<!-- never closed <p>u", [("t", 1)]),
        ("<p title='a > b'>t</p><a href=\"x", [("t", 1)]),
        ("<form>f<input></form><div hidden>h</div><div role=search>s</div>t", [("f", 2), ("h", 2), ("s", 2), ("t", 1)]),
        ("<table><tr><td>1<td>2</tr><tr><td>3</table>", [("1 2", 1), ("3", 1)]),
    ],
)
def test_lines_and_zones(page, want):
    assert lines_of(page) == want


def page(*lines):
    return "<body>" + "".join(f"<p>{x}</p>" for x in lines)


def test_lines_shared_with_the_neighbour_go(spark):
    rows = [
        (1, "http://h/en/1", page("menu", "hello world", "legal")),
        (2, "http://h/en/2", page("menu", "another text", "legal")),
        (3, "http://h/xx/9", page("own menu", "third text", "other legal")),
        (4, "http://alone/en/1", page("menu", "hello world", "legal")),
        (5, "http://copy/a/1", page("same long story", "x")),
        (6, "http://copy/a/2", page("same long story", "y")),
        (7, "http://quote/a/1", "<article><p>quoted</p></article>" + page("foot")),
        (8, "http://quote/a/2", "<article><p>quoted</p></article>" + page("foot")),
        (9, None, None),
        (9, None, None),
        (None, "http://[bad", "<p>t"),
        (10, "http://big/1", "<p>" + "word " * 600_000),
        (11, "http://many/1", page(*(f"l{i % 7}" for i in range(30_000)))),
        (12, "http://many/2", page(*(f"m{i % 7}" for i in range(30_000)), "l1", "l2")),
    ]
    got = {(x.page_id, x.url): x.text for x in main_text(spark.createDataFrame([(*r, "k", 1, 2) for r in rows], PAGES)).collect()}
    text = {i: t for (i, _), t in got.items()}
    assert text[1] == "hello world" and text[2] == "another text"
    assert text[3] == "own menu\nthird text\nother legal" and text[4] == "menu\nhello world\nlegal"
    assert text[5] == "same long story\nx" and text[6] == "same long story\ny"
    assert text[7] == text[8] == "quoted" and text[9] == "" and text[None] == "t"
    assert len(text[10]) == 5 * 600_000 - 1 and text[11].count("\n") == 30_000 - 3 and text[12].count("\n") == 30_000 - 1
    again = main_text(spark.createDataFrame([(*r, "k", 1, 2) for r in rows], PAGES).where("page_id = 9"))
    assert again.count() == 2 and main_text(spark.createDataFrame([], PAGES)).collect() == []


class Article(HTMLParser):
    """Plain way for the given pages: text between article tags, cut at p and h1."""

    def __init__(self):
        super().__init__()
        self.inside, self.lines = False, [""]

    def handle_starttag(self, tag, attrs):
        self.inside |= tag == "article"
        if tag in ("p", "h1"):
            self.lines.append("")
        if tag == "br":
            self.lines[-1] += " "

    def handle_endtag(self, tag):
        self.inside &= tag != "article"
        if tag in ("p", "h1"):
            self.lines.append("")

    def handle_data(self, data):
        if self.inside:
            self.lines[-1] += data


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_given_pages_as_plain_python(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {x.page_id: (x.url, x.text, x.n_chars) for x in main_text(pages).collect()}
    for x in pages.collect():
        reader = Article()
        reader.feed(x.html)
        reader.close()
        lines = [re.sub(r"\s+", " ", line).strip() for line in reader.lines]
        text = "\n".join(line for line in lines if line)
        assert got.pop(x.page_id) == (x.url, text, len(text))
    assert not got
