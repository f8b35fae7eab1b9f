import html
import random
import re

import numpy as np
import pytest

from tempera.llm import html_extract as he
from tempera.llm.dom import FEATURES, Page

SF = "/root/testdata/sf0.001"
PAGES = "page_id long, url string, html string, text string, n_chars string"


@pytest.fixture(scope="module")
def model(spark):
    return he.fit(spark.read.parquet(f"{SF}/pages.parquet"))


def everything(source):
    page = Page(source)
    return page.main_text(np.ones(len(page.tag)))


@pytest.mark.parametrize(
    "source,text",
    [
        ("", ""),
        ("   ", ""),
        ("plain < text &amp; more&nbsp; here", "plain < text & more here"),
        ("<p>a<p>b<li>c<li>d", "a\nb\nc\nd"),
        ("<p> a <b>b</b>\n c<br>d </p>", "a b c d"),
        ("<div>x<p>y</p>z</div>", "x\ny\nz"),
        ("<head><title>t</title></head><p>a", "a"),
        ("<head><title>t</title><p>a", "a"),
        ("<script>if (a<b) '<p>no</p>'</script><p>yes</p><style>p{}</style>", "yes"),
        ("<p title='a>b' data-x=\"<p>\">ok</p>", "ok"),
        ("<p a=\"never closed>tail</p> x", "tail\nx"),
        ("<!-- <p>no</p> --><p>yes<!-- open", "yes"),
        ("<script>never closed <p>x", ""),
        ("<p hidden>no</p><p style='display:none'>no</p><p>yes</p>", "yes"),
        ("&#233;&eacute;&#x1F642;&bogus;", "éé🙂&bogus;"),
        ("</p></div></b>a</article>", "a"),
        ("<table><tr><td>a<td>b<tr><td>c</table>d", "a\nb\nc\nd"),
        ("<button>b</button><p>a <span class=x>s</span>pan</p>", "a span"),
    ],
)
def test_blocks(source, text):
    assert everything(source) == text


def test_deep_and_long_pages():
    deep = "<div>" * 3000 + "inside" + "</div>" * 3000
    assert everything(deep) == "inside"
    assert len(everything("<p>" + "word " * 200_000 + "</p>")) == 5 * 200_000 - 1
    assert everything("<p>x</p>" * 20_000).count("x") == 20_000


def test_decoding_is_consistent_and_best():
    rng = random.Random(3)
    for _ in range(300):
        source = "".join(rng.choice(("<div>", "</div>", "<p>t</p>", "<ul><li>i", "</ul>", "loose")) for _ in range(rng.randrange(1, 9)))
        page = Page(source)
        n = len(page.tag)
        if n > 11:
            continue
        chance = np.asarray([rng.random() for _ in range(n)])
        kept = page.decide(chance)
        own = [0] * n
        for block in page.blocks:
            for node, piece in block:
                own[node] += len(piece.strip())
        gain = np.log(chance / (1 - chance)) * (1 + np.log1p(own))

        def sound(choice):
            text = [o > 0 for o in own]
            for i in range(n - 1, 0, -1):
                if choice[i] and not (choice[page.parent[i]] and text[i]):
                    return False
                if choice[i]:
                    text[page.parent[i]] = True
            return choice[0]

        best = max(
            sum(gain[i] for i in range(1, n) if c[i])
            for bits in range(1 << (n - 1))
            if sound(c := [True, *(bool(bits >> i & 1) for i in range(n - 1))])
        )
        assert sound(kept) and abs(sum(gain[i] for i in range(1, n) if kept[i]) - best) < 1e-9


def test_features_are_finite():
    x = Page("<nav class='menu'><a href=x>a</a></nav><article><p>b. c, d</p></article>").features()
    assert x.shape[1] == len(FEATURES) and np.isfinite(x).all()


def test_table_pages(spark, model):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r for r in he.main_texts(pages, model).collect()}
    wrong = 0
    for p in pages.collect():
        inside = re.search(r"<article>(.*?)</article>", p.html, re.S)[1].replace("<br>", " ")
        blocks = (" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h\d|div)[^>]*>", inside))
        wrong += got[p.page_id].text != "\n".join(b for b in blocks if b)
        assert got[p.page_id].n_chars == len(got[p.page_id].text) and got[p.page_id].url == p.url
    assert len(got) == pages.count() and wrong == 0


def test_made_pages(model):
    layouts, right, both, extra, missed = he._Layouts("the of some words, and. more text here to read".split(), 77), 0, 0, 0, 0
    for _ in range(200):
        page = Page(layouts.page())
        kept, label = page.decide(he.chances(page.features(), model)), page.labels()
        for block in page.blocks:
            for node, piece in block:
                n = len(piece.strip())
                both += n * (kept[node] and label[node] == 1)
                extra += n * (kept[node] and label[node] == 0)
                missed += n * (not kept[node] and label[node] == 1)
    assert both / (both + extra) > 0.95 and both / (both + missed) > 0.95


def test_parts_of_a_page(spark, model):
    body = "The river rose again last night, and the town moved its market uphill. People carried stalls, boxes and bread for hours."
    source = f"""<body><header class="site-header"><h2>The Paper</h2></header><nav><ul><li><a href=/a>Home</a></li><li><a href=/b>World</a></li></ul></nav>
      <div class="cookie-notice"><p>We use cookies to improve this site.</p><button>OK</button></div>
      <div class="post-content"><h1>Market on the hill</h1><p>{body}</p><p>{body}</p></div>
      <aside class="sidebar"><h3>More</h3><ul><li><a href=/c>Other news</a></li></ul></aside>
      <section id="comments"><div class="comment"><p>What a story, I was there and saw it all.</p></div></section>
      <form><label>Sign up</label><input></form><footer>&copy; The Paper</footer></body>"""
    rows = [(1, None, None, "c", "c"), (2, "u", "", "c", "c"), (3, "u", source, "c", "c"), (3, "u", source, "c", "c"), (None, "u", "<p>", "c", "c")]
    got = he.main_texts(spark.createDataFrame(rows, PAGES), model)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    texts = sorted(((r.page_id, r.text) for r in got.collect()), key=repr)
    whole = f"Market on the hill\n{body}\n{body}"
    assert texts == sorted([(1, ""), (2, ""), (3, whole), (3, whole), (None, "")], key=repr)
    assert he.main_texts(spark.createDataFrame([], PAGES), model).count() == 0


@pytest.mark.parametrize(
    "source, text",
    [
        ("<article><p>Before.</p><svg width=1 /><p>After the picture.</p></article>", "Before.\nAfter the picture."),
        ("<p>Eq <math/> one.</p><p>Rest of it.</p>", "Eq one.\nRest of it."),
        ("<p>Eq <math><mi>x</mi></math> holds.</p>", "Eq x holds."),
        ("<p>one<canvas id=c></p><p>two</p>", "one\ntwo"),
        ("<p>İ <script>var a=1</script>tail text</p>", "İ tail text"),
        ("<p>a<SCRIPT>if (x) '</scripts>'</SCRIPT >b</p>", "ab"),
        ("<p>a <svg><path d='M0'/><text>drawn</text></svg>b</p>", "a b"),
        ("<div><template><p>hidden</p></template><p>shown</p></div>", "shown"),
        ("<p>x</p><object data=y><p>instead</p></object><p>z</p>", "x\nz"),
        ("<p>x<textarea>typed <b></textarea>y</p>", "xy"),
    ],
)
def test_no_text_is_lost_and_no_markup_gets_through(source, text):
    assert everything(source) == text


#: Layouts from nobody's generator here.
FOREIGN = [
    (
        "<html><body><div id=hd><ul><li><a href=/>Start</a><li><a href=/n>News</a></ul></div><table><tr><td><p>" + "The council met on Monday, and the vote was close. " * 8
        + "</p><p>" + "Nobody had expected it, least of all the mayor, who left early. " * 6 + "</p></td></tr></table><div class=footer><a href=/i>Imprint</a></div></body></html>",
        ["The council met", "Nobody had expected"], ["Start", "Imprint"],
    ),
    (
        "<body><header><h2>Site</h2><nav><a href=a>A</a> | <a href=b>B</a></nav></header><main><h1>On rivers</h1><p>" + "Rivers bend where the ground is soft, as anyone can see. " * 9
        + "</p><svg viewBox='0 0 1 1'/><p>" + "They straighten in rock, and there they run fast. " * 9 + "</p></main><aside class=related><a href=c>More like this</a></aside></body>",
        ["On rivers", "Rivers bend", "They straighten"], ["| B", "More like this"],
    ),
]


@pytest.mark.parametrize("source, kept, gone", FOREIGN)
def test_foreign_layouts(spark, model, source, kept, gone):
    df = spark.createDataFrame([(1, "u", source, "", "")], PAGES)
    text = he.main_texts(df, model).first()["text"]
    assert all(k in text for k in kept) and not any(g in text for g in gone)
