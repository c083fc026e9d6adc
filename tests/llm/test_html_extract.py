import html
import re

import numpy as np
import pyarrow.dataset as ds
import pytest
from pyspark.sql import functions as F

from tidegrid.llm import html_extract
from tidegrid.llm.html_training import training_pages
from tidegrid.llm.queries import op10_html


@pytest.fixture(scope="module")
def model():
    return html_extract.labeller()


def plain(page):
    """The test tables' pages hold their main text in one article of h1 and p."""
    inner = page[page.index("<article>") + 9 : page.index("</article>")]
    parts = re.split(r"</?(?:p|h1)>", inner)
    clean = (" ".join(html.unescape(re.sub("</?b>", "", x).replace("<br>", " ")).split()) for x in parts)
    return "\n".join(x for x in clean if x)


def test_whole_table(spark, model):
    t = ds.dataset("/root/testdata/sf0.01/pages.parquet").to_table().to_pylist()
    got = {r.page_id: r for r in op10_html(spark, "/root/testdata/sf0.01").collect()}
    assert len(got) == len(t) and all(got[r["page_id"]].n_chars == len(got[r["page_id"]].text) for r in t)
    assert np.mean([got[r["page_id"]].text == plain(r["html"]) for r in t]) >= 0.99


def test_pages_never_trained_on(model):
    right = total = 0
    for source, main in training_pages(150, seed=1234):
        blocks = html_extract.blocks_of(source)
        for b, keep in zip(blocks, model.label([blocks])[0]):
            right += keep == (b.text in main)
            total += 1
    assert right / total >= 0.98


def test_gradients(monkeypatch):
    r = np.random.default_rng(1)
    monkeypatch.setattr(html_extract, "WIDTH", 6)
    m = html_extract.Labeller(hidden=3, seed=1)
    for own in (m.ahead, m.back):
        own.wx, own.wh, own.b = own.wx.astype(float), own.wh.astype(float), own.b.astype(float)
    x, mask = r.normal(size=(5, 2, 6)), np.array([[1, 1], [1, 1], [1, 1], [1, 0], [1, 0]], bool)
    y = (r.random((5, 2)) > 0.5).astype(float)

    def loss():
        z, _ = m.logits(x, mask)
        return (np.log1p(np.exp(-np.where(y > 0, z, -z))) * mask).sum() / mask.sum()

    grads = [g.copy() for g in m.step(x, mask, y)]
    for w, g in zip(m.weights, grads):
        at = tuple(r.integers(s) for s in w.shape)
        old, step = w[at], 1e-2
        w[at] = old + step
        up = loss()
        w[at] = old - step
        down = loss()
        w[at] = old
        assert abs((up - down) / (2 * step) - g[at]) < 2e-3


def test_blocks():
    page = "<p>a &amp; b\n\t c<p>d<b>e</b>f<br>g<script>x</p>if(a<b)</script>h<!-- no <p> -->i<ul><li>1<li>2</ul>3 < 4<style>q{}</style><title>t</title><p title='>'>z</p>"
    assert [b.text for b in html_extract.blocks_of(page)] == ["a & b c", "def ghi", "1", "2", "3 < 4", "z"]
    assert [b.text for b in html_extract.blocks_of("x<script>never closed <p>y")] == ["x"]
    assert [b.text for b in html_extract.blocks_of("x</div></p><!-- open <p>y")] == ["x"]
    assert [b.text for b in html_extract.blocks_of("a<p")] == ["a"]
    assert html_extract.blocks_of("") == []


def test_odd_rows(spark, model):
    text = "The quick brown fox jumps over the lazy dog, and then it rests for a while in the sun."
    page = f"<html><body><nav><ul><li><a href=/>Home</a></li></ul></nav><article><h1>Fox</h1><p>{text}</p></article><footer>&copy; x</footer>"
    long = page.replace(f"<p>{text}</p>", f"<p>{text}</p>" * 3000)
    rows = [(1, None), (2, ""), (3, page), (3, page), (None, page), (4, "plain & simple"), (5, long), (6, "<" * 1000), (7, "<p>" * 2000 + "x")]
    df = spark.createDataFrame([(*r, "old") for r in rows], "page_id long, html string, text string")
    got = html_extract.extract(df, model)
    assert got.columns == ["page_id", "html", "text"]
    out = [(r.page_id, r.text) for r in got.collect()]
    assert len(out) == len(rows) and out.count((3, f"Fox\n{text}")) == 2 and (None, f"Fox\n{text}") in out
    assert (1, "") in out and (2, "") in out
    assert html_extract.extract(df.where(F.lit(False)), model).count() == 0
