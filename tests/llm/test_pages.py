"""HTML extraction and the pipeline."""

import html as escapes
import re

import numpy as np
import pytest

import corpus_pipeline
from earmark.llm import html
from tests.llm import brute
from tests.llm.conftest import SF


@pytest.fixture(scope="module")
def pages(spark):
    return spark.read.parquet(f"{SF}/pages.parquet")


@pytest.fixture(scope="module")
def labeller(pages):
    return html.train_labeller(pages)


def article(page):
    """Text of the article element of the test pages, by patterns."""
    inside = page[page.index("<article>") : page.index("</article>")]
    lines = re.sub(r"<[^>]*>", "", re.sub(r"</?(?:p|h1|br)\b[^>]*>", "\n", inside)).split("\n")
    return " ".join(filter(None, (" ".join(escapes.unescape(line).split()) for line in lines)))


def test_pages(pages, labeller):
    got = {r.page_id: r.text for r in html.extract_text(pages, labeller=labeller).collect()}
    assert got == {r.page_id: article(r.html) for r in pages.collect()}


def test_odd_pages(spark, labeller):
    rows = [(None, None, None), (1, "u", ""), (1, "u", ""), (2, "u", "no tags"), (3, "u", "<p>open <b>bold<p>next<script>x</p>"), (4, "u", "<!-- never closed <p>x"), (5, "u", "<div>" * 3000 + "deep")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id long, url string, html string, n_chars int, text string")
    got = html.extract_text(df, labeller=labeller).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    assert html.extract_text(df.limit(0)).count() == 0


def test_blocks():
    cut = [b.text for b in html.blocks("<p>a&nbsp; b<b>c</b>d &amp e&am<br>f<script>x</p></script><!-- q --><li>x<li>y</p>z<!-- open")]
    assert cut == ["a bcd & e&am", "f", "x", "y", "z"]
    assert html.blocks("<head><title>t</title></head><body>x")[0].path == ("html", "body")[1:]


def test_held_out_layouts(pages, labeller):
    texts = [b.text for r in pages.collect() for b in html.blocks(r.html)]
    rng = np.random.default_rng(99)
    right = total = 0
    for _ in range(150):
        made = html._Marked()
        made.feed(html.rebuilt(rng, [t for t in texts if len(t) > 60], [t for t in texts if len(t) <= 60]))
        made.close()
        made.flush()
        got = labeller.label([made.blocks])[0]
        right, total = right + int((got == np.array(made.labels)).sum()), total + len(got)
    assert right >= 0.97 * total


def test_gradient():
    page = [[html.Block("a b c.", ("html", ".nav"), 2), html.Block("dd ee", ("html", "article"), 0)], [html.Block("q r s", ("html",), 0)]]
    model, encoded, labels = html.Labeller(), html.Encoded(page), np.array([0, 1, 1], np.float32)
    model.w = {k: w.astype(np.float64) for k, w in model.w.items()}
    _, grad = model.gradient(encoded, labels)
    for name, g in grad.items():
        for i in map(tuple, np.argwhere(np.abs(g) > 1e-4)[:5]):
            kept = model.w[name][i]
            model.w[name][i] = kept + 1e-3
            up, _ = model.gradient(encoded, labels)
            model.w[name][i] = kept - 1e-3
            down, _ = model.gradient(encoded, labels)
            model.w[name][i] = kept
            assert (up - down) / 2e-3 == pytest.approx(g[i], rel=0.05, abs=3e-4)


def test_pipeline_stages_take_effect(spark):
    """Each stage against a plain rewrite on what the one before kept."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    before, columns = docs, docs.columns
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        after = stage(spark, before, SF).cache()
        old, new = before.collect(), after.collect()
        assert new
        if i < 4:
            assert after.columns == columns
        ids = {r.doc_id for r in new}
        assert ids <= {r.doc_id for r in old}
        if i == 0:
            assert not any(brute.quality_counts(r.text)[5] for r in new)
        if i == 1:
            assert ids == {c for _, _, c in brute.near_components([(r.doc_id, r.text) for r in old])}
        if i == 2:
            assert not any(t in r.text for r in new for t in bench)
            assert {r.doc_id for r in old} - ids
        if i == 4:
            assert sorted(r.doc_id for r in new) == sorted(r.doc_id for r in old)
            assert sum(r.n_tokens for r in new) == max(r.start + r.n_tokens for r in new)
        before = after
