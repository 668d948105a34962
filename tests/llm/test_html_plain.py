"""Page text where containers tell nothing, and block cutting against the standard library's parser."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pandas as pd
import pytest
from clauseforge.llm import html_text as H

PAGES = "/root/testdata/sf0.01/pages.parquet"
NAMES = re.compile(r"\s(?:class|id|role)\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)


def stripped(html: str) -> str:
    return NAMES.sub("", html)


def plain(html: str) -> str:
    return re.sub(r"<(/?)(?:article|main|section|nav|header|footer|aside)\b", r"<\1div", stripped(html), flags=re.I)


class Cutter(HTMLParser):
    """Texts of leaf blocks: what stands between tags that break a block."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.skipped, self.text, self.out = [], "", []

    def flush(self):
        if body := " ".join(self.text.split()):
            self.out.append(body)
        self.text = ""

    def handle_starttag(self, tag, attrs):
        if tag in H.RAW:
            self.skipped.append(tag)
        elif tag in H.BREAKING and not self.skipped:
            self.flush()

    def handle_startendtag(self, tag, attrs):
        if tag in H.BREAKING and not self.skipped:
            self.flush()

    def handle_endtag(self, tag):
        if self.skipped and tag == self.skipped[-1]:
            self.skipped.pop()
        elif tag in H.BREAKING and not self.skipped:
            self.flush()

    def handle_data(self, data):
        if not self.skipped:
            self.text += data


def test_blocks_against_parser():
    pages = [*pd.read_parquet(PAGES).html, "<div>a<br>b &amp; c<!-- x --><p>d<p>e</div><ul><li>f<li>g</ul>h<script>var a = '<p>'</script>i", "no markup  at\nall", "<style>p{}</style>", ""]
    for html in pages:
        cutter = Cutter()
        cutter.feed(html)
        cutter.close()
        cutter.flush()
        assert [b[2] for b in H.blocks(html)] == cutter.out, html[:300]


@pytest.fixture(scope="module")
def halves(spark):
    """A labeller fitted on the even pages of the table, and the blocks and named labels of the odd ones."""
    pages = spark.read.parquet(PAGES)
    model = H.fit(pages.where("page_id % 2 = 0"))
    table = pd.read_parquet(PAGES)
    return model, list(table[table.page_id % 2 == 1].html)


@pytest.mark.parametrize("form", [lambda h: h, stripped, plain], ids=["as it is", "no names", "all div"])
def test_containers_that_tell_nothing(halves, form):
    model, pages = halves
    hit = wrong = missed = 0
    for html in pages:
        want = np.array([H.named_article(b) for b in H.blocks(html)], bool)
        got = model.label([H.blocks(form(html))])[0]
        assert len(got) == len(want)
        hit, wrong, missed = hit + (got & want).sum(), wrong + (got & ~want).sum(), missed + (~got & want).sum()
    assert hit / (hit + wrong) > 0.95 and hit / (hit + missed) > 0.95


def test_generated_alone_reads_div_pages():
    """Without a page of the table: generated layouts, drawn anew, read with all containers as div."""
    model = H.Labeller()
    model.train([(H.vectors(p, f), np.array(y, np.float32)) for p, y in H.generated(H.GENERATED) for f in (False, True)])
    right = total = 0
    for page, want in H.generated(120, seed=91):
        x, mask, _ = H.batch([(H.vectors(page, True), np.array(want, np.float32))])
        got = model.scores(x, mask)[0] > 0
        right, total = right + (got == np.array(want)).sum(), total + len(want)
    assert right / total > 0.85


def test_ties_and_repeats(spark):
    """Repeated rows and blocks of equal text are each read by themselves."""
    html = "<article><h1>T</h1><p>Same words here, again and again.</p><p>Same words here, again and again.</p></article><footer>Same words here.</footer>"
    rows = spark.createDataFrame([(1, "u", html), (1, "u", html), (2, "v", html)], "page_id long, url string, html string")
    got = H.extract(rows).collect()
    assert len(got) == 3 and len({r.text for r in got}) == 1 and got[0].text.count("again and again") == 2
