"""Rows made to end or stall a job, and groups that hold a third of all rows."""

import collections
import hashlib
import math
import random
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from earmark.llm import decontaminate, html, pii, quality, sharding, tokens
from tests.llm import brute
from tests.llm.conftest import SF
from tests.llm.test_rows import VOCABULARY


def seconds(run):
    started = time.perf_counter()
    run()
    return time.perf_counter() - started


# ---------------------------------------------------------------- personal data


def test_numbers_of_any_length():
    zeros = "0" * 10_000
    for text, n in [(f"{zeros}.1.1.1", 1), (f"1.{zeros}255.0.{zeros}", 1), (f"1.1.1.{zeros}256", 0), (f"{'9' * 10_000}.1.1.1", 0)]:
        assert sum(k == "ip" for k, _, _ in pii.base_spans(f"at {text} x")[0]) == n


# ---------------------------------------------------------------- pages

HOSTILE = {
    "open tags": "<div " * 200_000, "open tags in one": "<div " * 200_000 + ">x", "quotes": '<div class="' * 80_000, "other quotes": "<p id='a" * 100_000,
    "signs": "<" * 1_000_000, "ends": "</div" * 200_000, "comments": "<!--" * 250_000, "declarations": "<![" * 300_000, "titles": "<title>" * 140_000,
    "references": "&" * 1_000_000, "deep": "".join(f"<div class=c{i}>" for i in range(60_000)) + "x", "blanks": "<a" + " " * 1_000_000,
}


@pytest.mark.parametrize("name", sorted(HOSTILE))
def test_pages_take_linear_time(name):
    half = HOSTILE[name][: len(HOSTILE[name]) // 2]
    whole = HOSTILE[name]
    assert seconds(lambda: html.blocks(whole)) < max(6 * seconds(lambda: html.blocks(half)), 3)


def test_blocks_below_many_containers():
    """Paths share their links, so neither time nor memory grows with depth times blocks."""
    page = "".join(f"<div class=c{i}>" for i in range(2000)) + "".join(f"<p id=q{i}>a" for i in range(10_000))
    cut = html.blocks(page)
    assert len(cut) == 10_000 and len(html.Labeller().label([cut])[0]) == 10_000


def test_any_text_is_a_page():
    rng = random.Random(8)
    parts = ["<", "div", ">", "/", "!", "--", "[", "]", "&#", "x", "9" * 20, '"', "'", "=", " ", "a", "<p>", "</p>", "<script>", "</script>", "<title>", "\x00", "é", "&amp;", "<!", "?", "퟿"]
    for _ in range(10_000):
        html.blocks("".join(rng.choice(parts) for _ in range(rng.randint(0, 30))))
    for _ in range(300):
        html.blocks(bytes(rng.randrange(256) for _ in range(rng.randint(0, 400))).decode("utf-8", "replace"))


def test_marks_and_references():
    for page, want in [
        ("a<![foo[b]]>c<!doctype x>d<!ELEMENT y>e<![CDATA[f]]>g<?php h ?>i</ j>k</>l<!>m<!-->n<!--->o", "ac" + "degiklmno"),
        ("&#" + "9" * 5000 + ";x", "�x"), ("&#x" + "f" * 5000 + ";x", "�x"), ("&#" + "0" * 5000 + "65;&#x" + "0" * 5000 + "41;", "AA"),
        ("&#0000000abc &#65 &#x41; &amp;amp; &nbsp;b", "�abc A A &amp; b"), ("1 < 2 <3 a<b", "1 < 2 <3 a"), ('<p title="a > b">c</p>', "c"),
    ]:
        assert " ".join(b.text for b in html.blocks(page)) == want, page[:40]


def test_telling_names_behind_many_others():
    names = " ".join(f"px-{i} mt-{i}" for i in range(60))
    page = html.blocks(f'<article><p>text</p><div class="{names} comments"><p>reader</p></div></article>' + "".join(f"<div id=n{i}>" for i in range(100)) + "<nav>menu")
    assert [b.text for b in page] == ["text", "reader", "menu"]
    assert ".comments" in page[1].path and "nav" in page[2].path
    assert html.weak_labels(page).tolist() == [True, False, False]


def test_hostile_pages_in_a_table(spark):
    rows = [(i, "u", t[:20_000]) for i, t in enumerate(HOSTILE.values())] + [(99, "u", "<article><p>" + "word " * 30 + "</p></article>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html.extract_text(df, labeller=html.train_labeller(spark.read.parquet(f"{SF}/pages.parquet"))).collect()}
    assert len(got) == len(rows) and got[99].startswith("word word")


# ---------------------------------------------------------------- leaks


def plain_overlaps(docs, items):
    """All diagonals of all documents and items."""
    out = set()
    for d, text in enumerate(docs):
        words = np.array(text.split())
        for i, item in enumerate(items):
            own = np.array(item.split())
            for shift in range(1 - len(own), len(words)):
                lo, hi = max(0, -shift), min(len(own), len(words) - shift)
                equal = own[lo:hi] == words[lo + shift : hi + shift]
                a, b = decontaminate.extended_overlap(equal, min(decontaminate.OVERLAP, len(own))) if hi > lo else (0, 0)
                if b > a:
                    out.add((d, i, lo + a + shift, lo + a, b - a, int(equal[a:b].sum())))
    return out


def found_overlaps(docs, items):
    block = decontaminate.TestBlock(list(range(len(items))), items)
    words, values = decontaminate.words_of(pa.array(docs))
    return decontaminate.overlaps(block, values, words.first, words.doc)


def test_repeated_words_equal_a_search_of_all_diagonals():
    rng = np.random.default_rng(7)
    for turn in range(80):
        letters = list("abc")[: 1 + turn % 3]
        docs = [" ".join(rng.choice(letters, rng.integers(0, 70))) for _ in range(3)]
        items = [" ".join(rng.choice(letters, rng.integers(9, 40))) for _ in range(3)]
        assert set(found_overlaps(docs, items)) == plain_overlaps(docs, items)


def test_repeated_words_make_no_pairs():
    import tracemalloc

    docs, items = ["w " * 20_000], ["w " * 2000]
    assert seconds(lambda: found_overlaps(docs, items)) < 4
    tracemalloc.start()
    found = found_overlaps(docs, items)
    assert tracemalloc.get_traced_memory()[1] < 200 << 20
    tracemalloc.stop()
    # Every diagonal with 80 % of 13 words or more is one overlap of equal words.
    assert len(found) == 20_000 + 2000 - 1 - 2 * 12


# ---------------------------------------------------------------- quality


def test_limits_are_those_of_the_groups(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = quality.limits(quality.count(docs)).collect()
    for rule in quality.RULES:
        assert len({round(r[rule], 6) for r in found}) >= len(found) / 2, rule


def plain_level(values, rate):
    """Place and spread of a metric from exact quantiles."""
    v = np.sort(values)
    at = lambda q: v[math.ceil(len(v) * q) - 1]
    some = v[v > quality.SMALLEST]
    usual = len(some) / len(v) * some[math.ceil(len(some) * 0.5) - 1] if len(some) else 0.0
    return usual if rate else at(0.75), at(0.75) - at(0.25)


def test_limits_equal_those_of_exact_quantiles(spark):
    rng = np.random.default_rng(12)
    rows = [(f"s{rng.integers(3)}", int(rng.integers(20, 400)), 1 + int(rng.integers(20))) for _ in range(900)]
    table = [("en", s, n, int(n * rng.uniform(4, 6)), int(rng.integers(0, 30)) if rng.random() < 0.3 else 0, k, int(rng.integers(0, k)) if rng.random() < 0.2 else 0, 0) for s, n, k in rows]
    counts = spark.createDataFrame(table, "lang string, source string, n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long")
    got = {r.source: r for r in quality.limits(counts).collect()}
    metric = {"symbol_rate": lambda r: r[4] / r[2], "dup_line_share": lambda r: r[6] / r[5], "word_length": lambda r: r[3] / r[2]}
    m = quality.SMOOTHING
    for s in got:
        own = [r for r in table if r[1] == s]
        for name, f in metric.items():
            rate = quality.METRICS[name] is not None
            # One language only, so the language and the whole table are the same.
            inner, outer = (np.array(plain_level(np.array([f(r) for r in part]), rate)) for part in (own, table))
            place, spread = (len(own) * inner + m * outer) / (len(own) + m)
            want = place if rate else place + quality.SPREADS * spread
            assert got[s][f"{name}_usual" if rate else f"{name}_limit"] == pytest.approx(want, rel=0.06)


# ---------------------------------------------------------------- shards and token files


def plain_shard(key, leaves):
    """Down the tree by weighted draws."""
    node, inside = "", leaves
    for level, of in (("region", lambda x: x.region), ("rack", lambda x: x.rack), ("shard", lambda x: x.shard)):
        weight = collections.Counter()
        for leaf in inside:
            weight[of(leaf)] += leaf.weight
        draw = lambda c, level=level: (int(hashlib.md5(f"{key}|{level}{c}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        node = min(weight, key=lambda c: (-math.log(draw(c)) / weight[c], c)) if len(weight) > 1 else next(iter(weight))
        inside = [leaf for leaf in inside if of(leaf) == node]
    return node


def test_shards_are_those_of_a_plain_descent(spark):
    ids = [None, *range(400)]
    df = spark.createDataFrame([(i, "t") for i in ids], "doc_id long, text string")
    got = {r.doc_id: (r.shard, r.grown_shard) for r in sharding.assign(df).collect()}
    old, new = sharding.tree(16), sharding.tree(16, 1)
    assert got == {i: (plain_shard("null" if i is None else i, old), plain_shard("null" if i is None else i, new)) for i in ids}


def hot_table(spark, n=9000):
    """A third of the rows without an id, a third of one id, half of these with one text."""
    i = F.col("id")
    doc_id = F.when(i % 3 == 0, F.lit(None)).when(i % 3 == 1, F.lit(77)).otherwise(i).cast("long")
    text = F.when(i % 2 == 0, F.lit("one text for many")).otherwise(F.concat(F.lit("text "), i))
    return spark.range(n).select(doc_id.alias("doc_id"), text.alias("text"))


def test_slots_of_hot_ids(spark, monkeypatch):
    monkeypatch.setattr(sharding, "PIECE", 50)
    df = hot_table(spark)
    assigned = sharding.assign(df)
    got = assigned.collect()
    slots = collections.defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert len(got) == 9000 and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert collections.Counter(r.doc_id for r in got) == collections.Counter(r.doc_id for r in df.collect())


def test_equal_rows_are_made_by_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(sharding, "PIECE", 50)
    was = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        rows = sharding.assign(hot_table(spark)).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", was)
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sum(r["count"] >= 100 for r in rows) >= 16 and max(r["count"] for r in rows) < 9000 / 4


def test_token_files_of_hot_ids(spark, tmp_path):
    from tokenizers import Tokenizer

    df = hot_table(spark, 6000)
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        tokens.write_files(df, VOCABULARY, str(tmp_path / "files"))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    parts = spark.read.format("binaryFile").load(str(tmp_path / "files")).where("length > 0").select("content").collect()
    documents = collections.Counter()
    for r in parts:
        file = tokens.TokenFile(r.content)
        documents[file.part] += len(file.doc_ids())
    assert len(documents) >= 16 and max(documents.values()) < 6000 / 6
    got = tokens.read_files(spark, str(tmp_path / "files")).orderBy("start").collect()
    tokenizer = Tokenizer.from_file(VOCABULARY)
    count = lambda rows: collections.Counter((r[0], r[2], r[3]) for r in rows)
    assert count(got) == count(brute.token_rows(tokenizer, [(r.doc_id, r.text) for r in df.collect()]))
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda d: (d is not None, d or 0))
    assert all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:]))
