"""Main text of web pages: boosted trees over DOM nodes, decoded along the tree.

No page is labelled, so the trees learn from pages made for it: paragraphs of a bounded sample of the
table's own pages are set into many layouts with navigation, adverts, notices, side bars, forms
and reader comments around and inside the article, where it is known which element
belongs to it. Every node of a page gets a chance, and the tree decides jointly: a node can only be kept under kept ones.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempera.catalog.registry import table
from tempera.llm.catalog import llm_query
from tempera.llm.dom import FEATURES, MARK, Page
from tempera.llm.support import about
from tempera.plans.staging import materialize

#: Pages whose words are borrowed for training, words that each gives, and layouts made from them.
SAMPLE_PAGES = 64
PAGE_WORDS = 400
LAYOUTS = 1200
TREES = 24
DEPTH = 5

# Names that sites commonly give to the parts of a page.
_PARTS = {
    "main": "content main-content post entry-content article-body story post-body articleBody hentry blog-post text prose",
    "nav": "nav navbar main-menu menu breadcrumbs site-nav pagination toc",
    "header": "header site-header masthead top-bar page-header branding",
    "footer": "footer site-footer bottom copyright legal-links colophon",
    "side": "sidebar side-bar widget related-posts recommended popular-posts tag-list right-rail",
    "ad": "ad ads advert advertisement sponsored promo banner-ad ad-slot adsbox",
    "notice": "cookie-notice cookie-banner consent alert notice newsletter popup subscribe-box gdpr",
    "comment": "comments comment-list comment-thread responses reader-comments discussion replies",
    "form": "search-form login contact-form share-buttons social newsletter-form rating",
}
_NAMES = {k: v.split() for k, v in _PARTS.items()}


class _Layouts:
    """Pages with known main text."""

    def __init__(self, words: list[str], seed: int):
        self.words, self.rng = words or ["word"], random.Random(seed)

    def sentence(self, low: int = 3, high: int = 22) -> str:
        r = self.rng
        return " ".join(r.choices(self.words, k=r.randint(low, high))).strip(" .,").capitalize() + "."

    def prose(self, low: int = 1, high: int = 7) -> str:
        return " ".join(self.sentence() for _ in range(self.rng.randint(low, high)))

    def link(self) -> str:
        return f'<a href="/x">{" ".join(self.rng.choices(self.words, k=self.rng.randint(1, 4)))}</a>'

    def links(self, low: int = 3, high: int = 9) -> str:
        n = self.rng.randint(low, high)
        if self.rng.random() < 0.7:
            return "<ul>" + "".join(f"<li>{self.link()}</li>" for _ in range(n)) + "</ul>"
        return " | ".join(self.link() for _ in range(n))

    def wrap(self, kind: str, inner: str, tags: str, named: float = 0.85) -> str:
        r = self.rng
        tag = r.choice(tags.split())
        name = ""
        if tag in ("div", "section", "p", "ul") or r.random() < 0.4:
            if r.random() < named or tag in ("div", "section", "p", "ul"):
                name = f' {r.choice(("class", "class", "id"))}="{r.choice(_NAMES[kind])}"'
        return f"<{tag}{name}>{inner}</{tag}>"

    def advert(self) -> str:
        r = self.rng
        inner = r.choice((self.sentence(2, 12), self.prose(1, 3), self.link() + self.sentence(2, 8), f"<p>{self.prose(1, 2)}</p>"))
        return r.choice(("", "<!-- ad -->")) + self.wrap("ad", inner, "div div div aside section p")

    def comments(self) -> str:
        r = self.rng
        one = lambda: r.choice(("<li{}>{}</li>", "<div{}>{}</div>", "<article{}>{}</article>")).format(
            r.choice((' class="comment"', ' class="comment-body"', ' class="reply"')), f"<b>{self.words[0]}</b><p>{self.prose(1, 5)}</p>"
        )
        inner = f"<h{r.randint(2, 4)}>{self.sentence(1, 3)}</h{r.randint(2, 4)}>" + "".join(one() for _ in range(r.randint(1, 6)))
        return self.wrap("comment", inner, "div section ul")

    def side(self) -> str:
        r = self.rng
        inner = f"<h3>{self.sentence(1, 3)}</h3>" + r.choice((self.links(), f"<p>{self.prose(1, 3)}</p>", self.links() + f"<p>{self.prose(1, 2)}</p>"))
        return self.wrap("side", inner, "aside aside div div section")

    def notice(self) -> str:
        return self.wrap("notice", f"<p>{self.prose(1, 3)}</p>" + self.rng.choice(("", "<button>OK</button>", self.link())), "div div section aside")

    def form(self) -> str:
        inner = f"<label>{self.sentence(1, 4)}</label><input name=q>" + self.rng.choice(("", f"<p>{self.prose(1, 2)}</p>", "<button>Go</button>"))
        return self.rng.choice((f"<form>{inner}</form>", self.wrap("form", inner, "div form")))

    def part(self) -> str:
        """One element of the article."""
        r, m = self.rng, f" {MARK}"
        kind = r.random()
        if kind < 0.62:
            return f"<p{m}>{self.prose()}</p>"
        if kind < 0.7:
            return f"<p{m}><b>{self.sentence(1, 8)}<br>"
        if kind < 0.8:
            return f"<h2{m}>{self.sentence(1, 8)}</h2>"
        if kind < 0.86:
            return f"<ul{m}>" + "".join(f"<li>{self.sentence()}</li>" for _ in range(r.randint(2, 6))) + "</ul>"
        if kind < 0.9:
            return f"<blockquote{m}>{self.prose(1, 3)}</blockquote>"
        if kind < 0.93:
            return f"<table{m}><tr><td>{self.sentence(1, 3)}</td><td>{self.sentence(1, 3)}</td></tr></table>"
        if kind < 0.96:
            return f"<p{m}>{self.sentence()} {self.link()} {self.sentence()}</p>"
        return r.choice((self.advert, self.form, self.side))()

    def article(self) -> str:
        r = self.rng
        head = f"<h1 {MARK}>{self.sentence(2, 14)}</h1>" if r.random() < 0.9 else ""
        many = r.choice((1, 1, 2, 3, 5, 8, 14))
        inner = head + "".join(self.part() if i else f"<p {MARK}>{self.prose(1, r.choice((1, 7)))}</p>" for i in range(many))
        if r.random() < 0.15:
            inner += self.wrap("form", self.links(2, 4), "div ul")
        if r.random() < 0.1:
            inner += self.comments()
        style = r.random()
        if style < 0.4:
            return f"<article>{inner}</article>"
        if style < 0.5:
            return f"<main>{inner}</main>"
        if style < 0.9:
            inner = self.wrap("main", inner, "div div div section article")
            return f"<div>{inner}</div>" if r.random() < 0.3 else inner
        return inner if r.random() < 0.5 else f"<div>{inner}</div>"

    def page(self) -> str:
        r = self.rng
        before, after = [], []
        if r.random() < 0.8:
            before.append(self.wrap("nav", self.links(), "nav nav nav div ul"))
        if r.random() < 0.4:
            before.insert(0, self.wrap("header", f"<h2>{self.sentence(1, 3)}</h2>{self.sentence(1, 6)}", "header div"))
        for make, chance in ((self.advert, 0.6), (self.notice, 0.25), (self.form, 0.2), (self.side, 0.2)):
            if r.random() < chance:
                before.append(make())
        for make, chance in ((self.comments, 0.35), (self.side, 0.35), (self.advert, 0.25), (self.form, 0.15), (self.notice, 0.15)):
            if r.random() < chance:
                after.append(make())
        if r.random() < 0.8:
            after.append(self.wrap("footer", "&copy; " + r.choice((self.sentence(2, 14), self.links(), self.prose(1, 2))), "footer footer div"))
        body = "".join(before) + self.article() + "".join(after)
        if r.random() < 0.25:
            body = f'<div class="{r.choice(("wrapper", "page", "container", "site"))}">{body}</div>'
        return f"<html><head><title>{self.sentence()}</title></head><body>{body}</body></html>"


def training_nodes(pages: DataFrame, sample_pages: int = SAMPLE_PAGES, layouts: int = LAYOUTS, seed: int = 5) -> DataFrame:
    """(label, features) of the nodes of ``layouts`` made pages; their words are at most ``PAGE_WORDS`` of each of at most
    ``sample_pages`` pages, drawn by hash from the whole page."""
    spark = pages.sparkSession
    words = F.split(F.regexp_replace("html", "<[^>]*>", " "), r"\s+")
    mixed = F.sort_array(F.transform(words, lambda w, i: F.struct(F.xxhash64(w, i).alias("h"), w.alias("w"))))
    some = about(pages.filter("html is not null"), sample_pages, pages.count(), "page_id", "url")
    some = some.select(F.xxhash64("page_id", "url").alias("h"), "page_id", F.transform(F.slice(mixed, 1, PAGE_WORDS), lambda x: x["w"]).alias("w"))
    chosen = some.orderBy("h", "page_id").limit(sample_pages)
    pool = [w for r in chosen.collect() for w in r["w"] if w]  # bounded by the parameter

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, rows = [], []
            for number in batch.column(0).to_pylist():
                page = Page(_Layouts(pool, seed * 1_000_003 + number).page())
                use = [i for i in range(1, len(page.tag)) if not page.dropped[i]]
                labels.append(page.labels()[use])
                rows.append(page.features()[use].astype(np.float64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(labels)), pa.array(list(np.concatenate(rows)))], names=["label", "x"]
            )

    return spark.range(0, layouts, 1, 4).mapInArrow(make, "label double, x array<double>")


def boosted_trees(nodes: DataFrame, trees: int = TREES, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fit, and lay the trees out as complete ones: (feature, threshold) per inner place, value per leaf."""
    data = materialize(nodes.select("label", array_to_vector("x").alias("features")), "html-nodes")
    model = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.4, subsamplingRate=0.8, seed=3, maxBins=32).fit(data)
    weights = model.treeWeights
    feature = np.zeros((len(weights), 2**depth - 1), np.int32)
    threshold = np.full((len(weights), 2**depth - 1), np.inf, np.float32)
    value = np.zeros((len(weights), 2**depth))

    def fill(tree: int, node, place: int, level: int) -> None:
        if level == depth:
            value[tree, place - (2**depth - 1)] = node.prediction() * weights[tree]
        elif node.getClass().getSimpleName() == "InternalNode":
            feature[tree, place], threshold[tree, place] = node.split().featureIndex(), node.split().threshold()
            fill(tree, node.leftChild(), 2 * place + 1, level + 1)
            fill(tree, node.rightChild(), 2 * place + 2, level + 1)
        else:
            fill(tree, node, 2 * place + 1, level + 1)
            fill(tree, node, 2 * place + 2, level + 1)

    for t, one in enumerate(model.trees):
        fill(t, one._java_obj.rootNode(), 0, 0)
    return feature, threshold, value


def chances(x: np.ndarray, model: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    feature, threshold, value = model
    margin, rows, inner = np.zeros(len(x)), np.arange(len(x)), feature.shape[1]
    for f, t, v in zip(feature, threshold, value):
        place = np.zeros(len(x), np.int64)
        while place.size and place[0] < inner:
            place = 2 * place + 1 + (x[rows, f[place]] > t[place])
        margin += v[place - inner]
    return 1.0 / (1.0 + np.exp(-2.0 * margin))


def fit(pages: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return boosted_trees(training_nodes(pages))


def main_texts(pages: DataFrame, model: tuple[np.ndarray, np.ndarray, np.ndarray]) -> DataFrame:
    """page_id, url, text, n_chars of every page.

    Null and empty pages, and pages without text, give an empty text; rows that repeat are extracted
    as often as they occur; an empty table gives no rows; other columns are ignored. A line break element
    counts as white space of its block.
    """

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                some = batch.slice(i, 64)
                parsed = [Page(x.as_py() or "") for x in some.column(2)]
                x = [p.features() for p in parsed]
                cuts = np.cumsum([len(f) for f in x])[:-1]
                chance = np.split(chances(np.concatenate(x), model), cuts)
                texts = [p.main_text(c) for p, c in zip(parsed, chance)]
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), some.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    names=["page_id", "url", "text", "n_chars"],
                )

    narrow = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return narrow.mapInArrow(extract, "page_id long, url string, text string, n_chars long")


@llm_query("op1_html_extract")
def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return main_texts(pages, fit(pages))
