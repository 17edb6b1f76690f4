import html
import re

from pyspark.sql import functions as F

from glyphmill.llm import extraction
from glyphmill.llm.queries import op9_extraction


def text_of(page):
    p = extraction.Page(page)
    return p.main_text([1.0] * len(p.nodes))[0]


def test_markup():
    assert text_of("<article><h1>A &amp; B</h1><p>one<br>two <b>three<p>four&nbsp;five<!-- x --></article><p>after") == "A & B\none two three\nfour five"
    assert text_of('<body><div class="ad">x</div><div id="comments"><p>c</p></div><main><header><h1>T</h1></header><p>t</p><form>f</form></main><footer>g') == "T\nt"
    assert text_of("<article>a<script>var t='</p><p>';</script>b<style>p{}</style>c &am</article>") == "a\nb\nc &am"
    assert text_of("<p>1 < 2 and 3 > 2</p><ul><li>x<li>y</ul><nav>n</nav><p title='a > b'>z</p><p cla") == "1 < 2 and 3 > 2\nx\ny\nz"
    assert text_of('<div class="with-sidebar"><article>in<article class="comment">no</article></article></div>') == "in"
    assert text_of("") == "" and text_of("<article></article>") == "" and text_of("plain\n text") == "plain text"


STORY = "The long story of the day has many words and goes on for a while, as stories do."


def test_roles_shift_but_do_not_decide():
    assert text_of(f'<div class="story">{STORY}</div><div><article>teaser one</article><article>teaser two</article></div>') == STORY
    assert text_of("<form><article><p>real text</p></article><input></form>") == "real text"
    sections = '<section class="share-price"><p>12 dollars</p></section><section class="comment-on-law"><p>law</p></section>'
    assert text_of(f'<article><p>a</p>{sections}<div class="share-buttons">x</div><div class="comment">no</div></article>') == "a\n12 dollars\nlaw"
    # A main part around the article, and text beside both.
    assert text_of(f"<main><p>lead</p><article>{STORY}</article></main><p>after") == STORY
    assert text_of(f"<main>{STORY}</main><div>after</div>") == STORY


def test_importance_decides_without_and_against_roles():
    page = extraction.Page(f"<div class=a>{STORY}</div><div class=b>{STORY}</div><div class=share-price>{STORY}</div>")
    steps = [n.step for n in page.nodes]
    mean = lambda **own: [own.get(s.split(".")[-1].replace("-", "_"), 1.0) for s in steps]
    assert page.main_text(mean(a=0.1))[0] == f"{STORY}\n{STORY}"
    assert page.main_text(mean(share_price=0.6))[0] == f"{STORY}\n{STORY}"
    assert page.main_text(mean(a=0.1, b=0.1, share_price=0.6))[0] == ""
    # Half of the text in a declared article: the tree alone decides.
    page = extraction.Page(f"<article>{STORY}</article><div class=b>{STORY}</div>")
    steps = [n.step for n in page.nodes]
    assert page.main_text(mean(article=0.1))[0] == STORY and page.main_text(mean(b=0.1))[0] == STORY
    assert page.main_text(mean())[0] == f"{STORY}\n{STORY}"


def plain_importance(pages):
    """Each page's importance by node, from a style tree kept as plain dictionaries of paths."""
    import math
    from collections import Counter, defaultdict

    def path(page, k):
        return () if k < 0 else (*path(page, page.nodes[k].parent), page.nodes[k].step)

    styles, contents = defaultdict(Counter), defaultdict(Counter)
    for page in pages:
        style, content = defaultdict(list), defaultdict(list)
        for k, node in enumerate(page.nodes):
            style[path(page, k)] += [s for i, s in enumerate(node.children) if not i or s != node.children[i - 1]]
            content[path(page, k)] += node.texts
        for table, own in ((styles, style), (contents, content)):
            for key, values in own.items():
                if values:
                    table[key][tuple(values)] += 1

    def entropy(counts):
        m = sum(counts.values())
        return 1.0 if m == 1 else -sum(n / m * math.log(n / m, m) for n in counts.values())

    def value(page, k):
        key, node = path(page, k), page.nodes[k]
        below = [value(page, c) for c, n in enumerate(page.nodes) if n.parent == k]
        own = below + ([entropy(contents[key])] if node.texts else [])
        style = entropy(styles[key]) if styles[key] else 1.0
        if not own:
            return style
        weight = 1 - extraction.GAMMA ** len(styles[key]) if below else 0.0
        return (1 - weight) * sum(own) / len(own) + weight * style

    return [[value(page, k) for k in range(len(page.nodes))] for page in pages]


def test_generated_site_against_a_plain_tree(spark):
    """Teasers, a form around everything, story text beside the article, and template boxes without a role."""
    import random

    rng = random.Random(6)
    words = "river stone light market quiet garden winter bridge paper morning".split()

    def some(n):
        return " ".join(rng.choice(words) for _ in range(n))

    pages, stories = [], []
    for k in range(40):
        story = [some(rng.randrange(20, 40)) + f" {k}" for _ in range(rng.randrange(1, 5))]
        inside = "".join(f"<p>{p}</p>" for p in story)
        body = f"<article>{inside}</article>" if k % 2 else f'<div class="text">{inside}</div><div class="cards"><article>{some(2)}</article><article>{some(2)}</article></div>'
        pages.append(f'<body><form><div class="top"><p>Welcome to our pages</p></div><nav>{some(3)}</nav>{body}<div class="low"><p>All rights reserved</p></div></form></body>')
        stories.append("\n".join(story))
    rows = [(k, "http://site.org/x", p) for k, p in enumerate(pages)]
    got = {r.page_id: r for r in extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[k].text for k in range(40)] == stories
    parsed = [extraction.Page(p) for p in pages]
    for k, (page, importance) in enumerate(zip(parsed, plain_importance(parsed))):
        text, mean = page.main_text(importance)
        assert text == got[k].text and abs(mean - got[k].importance) < 1e-9


def test_template_branches_go_and_copies_in_articles_stay(spark):
    def page(k, body):
        return f'<html><body><div class="top"><p>Welcome to our site</p></div>{body}<div class="low"><p>All rights reserved</p></div></body></html>'

    rows = [(k, "http://a.org/x", page(k, f"<div class='body'><p>Story {k} of many</p><p>with text {k * k}</p></div>")) for k in range(1, 30)]
    rows += [(100 + k, "http://b.org/x", "<article><p>copy</p></article>") for k in range(5)]
    got = {r.page_id: r.text for r in extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k in range(1, 30):
        assert got[k] == f"Story {k} of many\nwith text {k * k}"
    assert [got[100 + k] for k in range(5)] == ["copy"] * 5


def test_query_equals_plain_cutting(spark, sf_small):
    """The test pages declare an article; cut it out with patterns alone."""
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf_small}/pages.parquet").collect()}
    for r in op9_extraction(spark, sf_small).collect():
        article = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S)[1]
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", " " if "br" in b else "", b)).split()) for b in re.split(r"</?(?:p|h1)>", article))
        assert r.text == "\n".join(b for b in blocks if b)
        assert r.n_chars == len(r.text)


def test_nulls_ties_and_clashes(spark):
    rows = [(1, None, None), (1, None, ""), (None, "::bad[", "<p>x"), (2, "http://h/", "<p>" + "a " * 100_000), (2, "http://h/", "<p>" + "a " * 100_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("c")).withColumn("row", F.lit(1)).withColumn("node", F.lit(1))
    got = extraction.extract(pages).collect()
    assert sorted(str(r.page_id) for r in got) == ["1", "1", "2", "2", "None"]
    assert {r.text for r in got if r.page_id == 1} == {""} and [r.text for r in got if r.page_id is None] == ["x"]
    assert extraction.extract(pages.limit(0)).collect() == []
