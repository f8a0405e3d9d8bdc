"""Resampling, language identification and collocations, against plain rewrites and held-out rows."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from earmark.llm import language, phrases, resampling
from tests.llm.conftest import ROWS, SF


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# ---------------------------------------------------------------- resampling

FEATURE_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_buckets(text):
    words = FEATURE_WORD.findall(lower(text))
    features = words + [f"{a} {b}" for a, b in zip(words, words[1:])]
    return [zlib.crc32(f.encode()) % 10_000 for f in features], len(words)


def plain_resample(rows, target):
    """rows: (doc_id, text). Every row with features, weight, score and rank."""
    made = [(d, *plain_buckets(t)) for d, t in rows]
    s = collections.Counter(b for _, bs, _ in made for b in bs)
    t = collections.Counter(b for x in target for b in plain_buckets(x)[0])
    big_s, big_t = s.total(), t.total()
    gain = [math.floor(1000 * math.log((t[i] + 1) * (big_s + 10_000) / ((s[i] + 1) * (big_t + 10_000)))) for i in range(10_000)]
    out, drawable = [], []
    for d, bs, n_words in made:
        weight = sum(gain[b] for b in bs) // len(bs) if bs else 0
        h = int(hashlib.sha256(f"7:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, len(bs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
        if n_words >= 20:
            drawable.append(out[-1])
    drawable.sort(key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[1], r[2]))
    for i, r in enumerate(drawable[: 25 * len(drawable) // 100]):
        r[4] = i + 1
    return sorted(map(tuple, out), key=str)


def test_buckets_are_checksums_of_words_and_pairs():
    rng = random.Random(5)
    texts = [None, "", "A", " a-b ", "é" * 90 + " Z9 " + "q" * 200 + " z", "x" * 64 + " " + "y" * 65 + " " + "w" * 64]
    texts += ["".join(rng.choice(["a", "Bc", " ", "é", "日本", "7", "-", "\n", "@", "`", "~", "\x7f"]) for _ in range(rng.randint(0, 80))) for _ in range(400)]
    column = pa.array(texts, pa.string())
    from earmark.llm.words import utf8

    bucket, doc, n_words = resampling.buckets(*utf8(column))
    for i, t in enumerate(texts):
        want, n = plain_buckets(t)
        assert sorted(bucket[doc == i].tolist()) == sorted(want) and n_words[i] == n, t


def test_resampling_is_the_plain_rule(spark, documents):
    target = spark.read.parquet(f"{SF}/benchmark.parquet")
    got = resampling.resample(documents, target).collect()
    assert sorted(map(tuple, got), key=str) == plain_resample([(r.doc_id, r.text) for r in documents.collect()], [r.text for r in target.collect()])


def test_resampling_of_odd_rows(spark, odd, empty):
    target = spark.createDataFrame([("q w1 w2",), (None,), ("",)], "text string")
    got = sorted(map(tuple, resampling.resample(odd, target).collect()), key=str)
    assert got == plain_resample([(d, t) for d, t, *_ in ROWS], ["q w1 w2"])
    assert resampling.resample(empty, target).count() == 0
    assert resampling.resample(odd, target.limit(0)).count() == len(ROWS)


def test_ranks_are_exact_in_many_uneven_segments(spark):
    """A third of the rows are equal, many scores tie, ids are null: ranks are those of one sort."""
    rng = random.Random(1)
    rows = [(7, 3, 1, 50, True)] * 700 + [(rng.choice([None, i, i // 3]), rng.randint(1, 3), 1, rng.randint(0, 90), rng.random() < 0.9) for i in range(1400)]
    rng.shuffle(rows)
    scored = spark.createDataFrame(rows, "doc_id long, n_features long, weight long, score long, drawable boolean").repartition(7)
    drawn = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[1], r[2]))
    for per_cent in (0, 25, 100):
        n = per_cent * len(drawn) // 100
        want = [(*r[:4], i + 1 if i < n else None) for i, r in enumerate(drawn)] + [(*r[:4], None) for r in rows if not r[4]]
        got = resampling.ranked(scored, per_cent, samples=300, step=2, segment_rows=40)
        assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_equal_rows_are_split_between_segments():
    """Rows equal in all but run and place fall on both sides of a splitter among them."""
    n = 1000
    one = np.ones(n, np.int64)
    columns = [one, one, one, one, np.arange(n) % 4, np.arange(n)]
    splitters = [c[[0, 0]] for c in columns[:4]] + [np.array([1, 2]), np.array([400, 500])]
    assert np.bincount(resampling._segments(columns, splitters)).min() > 200


# ---------------------------------------------------------------- languages


def test_languages_of_rows_not_learned_from(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    held = [r for r in got if r.held_out]
    assert len(held) > 200 and np.mean([r.lang == r.lang_pred for r in held]) >= 0.98
    assert all(0 <= r.score <= 1 for r in got)


def test_predictions_read_no_label_of_their_row(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    lied = docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, "xx").otherwise(F.col("lang"))).withColumn("source", F.lit("other"))
    assert sorted(map(tuple, language.identify(docs).collect())) == sorted(map(tuple, language.identify(lied).collect()))


def plain_grams(text):
    words = "".join(c.lower() if c.isalpha() and len(c.lower()) == 1 else c if c.isalpha() else " " for c in text or "").split()
    return [(" " + w + " ")[i : i + n] for n in (3, 4) for w in words for i in range(len(w) + 3 - n)]


def test_grams_are_those_of_words():
    from earmark.llm.words import utf8

    texts = [None, "", "a", "Hé! x2y ß", "日本 語", "12", "İi", "ab"]
    h, doc, letter = language.grams(*utf8(pa.array(texts, pa.string())))
    table = {}
    for i, t in enumerate(texts):
        want = plain_grams(t)
        mine = h[doc == i].tolist()
        assert len(mine) == len(want) and (letter[i] > 0) == any(c.isalpha() for c in t or "")
        for g, x in zip(sorted(want), sorted(mine)):
            table.setdefault(len(want), []).append((g, x))
    broken = np.frombuffer(b"ab\xff c\xc3", np.uint8)
    assert len(language.grams(broken, np.array([0, 6]))[0]) > 0


def test_filter_reports_every_language_and_few_others(spark):
    """Against plain sets of n-grams: what a language has is always reported, anything else seldom."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    made = language.learn(docs)
    counts = collections.defaultdict(collections.Counter)
    for r in docs.collect():
        if r.lang is not None and zlib.crc32(str(r.doc_id).encode()) % 4 != 2:
            counts[r.lang].update(plain_grams(r.text))
    assert made.langs == sorted(counts)
    rate = {x: {g: n / c.total() for g, n in c.items()} for x, c in counts.items()}
    every = sorted(set().union(*rate.values()))
    from earmark.llm.words import utf8

    wrong = total = 0
    for g in random.Random(2).sample(every, 3000):
        if " " not in (g[0], g[-1]) or " " in g.strip():
            continue
        own = {x for x in rate if rate[x].get(g, 0) >= language.LEAST_RATE and rate[x].get(g, 0) >= language.LEAST_PART * max(r.get(g, 0) for r in rate.values())}
        h, doc, _ = language.grams(*utf8(pa.array([g.strip()])))
        alone = plain_grams(g.strip())
        seen = made.hits(h, doc, 1)[0]
        if len(alone) == len(h) == 1:
            reported = {x for x, n in zip(made.langs, seen) if n}
            assert own <= reported
            wrong, total = wrong + len(reported - own), total + len(made.langs) - len(own)
    assert wrong <= 0.05 * max(total, 1)


def test_languages_of_odd_rows(spark, odd, empty):
    got = language.identify(odd).collect()
    assert len(got) == len(ROWS)
    for r in got:
        if r.doc_id in (1, 2):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        if r.doc_id is None:
            assert r.held_out is False
    assert language.identify(empty).count() == 0
    nothing = odd.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language.identify(nothing).collect()} == {"und"}
    many = spark.range(300).select(F.col("id").alias("doc_id"), F.concat(F.lit("lang"), F.col("id") % 20).alias("lang"), F.translate(F.concat(F.repeat(F.concat(F.lit(" abc"), F.col("id") % 20), 9)), "0123456789", "qrstuvwxyz").alias("text"))
    assert all(r.lang == r.lang_pred for r in language.identify(many).join(many, "doc_id").collect())


# ---------------------------------------------------------------- collocations


def plain_collocations(rows, least, longest=5, top=2000):
    """rows: (lang, text)."""
    f, n = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            words = tuple(re.findall(r"[^\x20\x09]+", piece))
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f.update((lang, words[i : i + k]) for i in range(len(words) - k + 1))
    out = collections.defaultdict(list)
    candidates = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    held = {(lang, w[i : i + k], a) for (lang, w), a in candidates.items() for k in range(2, len(w)) for i in range(len(w) - k + 1)}
    for (lang, w), a in candidates.items():
        if (lang, w, a) not in held:
            cuts = [(1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            out[lang].append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return sorted(
        (lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for lang, found in out.items() for i, (s, a, p, l, r) in enumerate(sorted(found)[:top])
    )


def collected(df):
    return sorted(tuple(r) for r in df.collect())


def some_texts(seed, n=300):
    rng = random.Random(seed)
    return [(rng.choice(["en", "fr", None, "und"]), "".join(rng.choice(["a ", "b ", "c", " ", "the ", "The ", "é ", ". ", "\t", "\n", "x-y ", ", a b c "]) for _ in range(rng.randint(0, 60)))) for _ in range(n)]


@pytest.mark.parametrize("blocks", [{}, {"block_words": 4, "shard_phrases": 25}])
def test_collocations_are_the_plain_rule(spark, blocks):
    """With one trie and one block of words, and with many of either."""
    rows = some_texts(4)
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, lang string, text string")
    for least, top in ((3, 2000), (20, 5)):
        assert collected(phrases.collocations(docs, least=least, top=top, **blocks)) == plain_collocations(rows, least, top=top)


def test_collocations_of_odd_rows(odd, empty):
    rows = [(lang, t) for _, t, lang, _ in ROWS]
    assert collected(phrases.collocations(odd, least=2)) == plain_collocations(rows, 2)
    assert collected(phrases.collocations(odd)) == plain_collocations(rows, 100)
    assert collected(phrases.collocations(odd, least=10**6)) == []
    assert phrases.collocations(empty).count() == 0


def test_trie_reaches_its_phrases_only():
    rng = np.random.default_rng(3)
    words = np.unique(rng.integers(1, 40, (4000, 4)).astype(np.int32) * (np.arange(4) < rng.integers(1, 5, 4000)[:, None]), axis=0).astype(np.int32)
    made = phrases.build_trie(words)
    assert len(np.unique(made["node"])) == len(made["node"])
    trie = phrases.Trie(made["node"], made["parent"], made["base"])
    held = {tuple(w[w > 0][:k].tolist()) for w in words for k in range(1, 5)}
    text = rng.integers(0, 41, 20_000).astype(np.int32)
    for d, (at, _) in enumerate(trie.levels(text, 4), 1):
        assert at.tolist() == [i for i in range(len(text) - d + 1) if tuple(text[i : i + d].tolist()) in held and len(set(text[i : i + d].tolist()) & {0}) == 0]


def test_scores_beyond_64_bits(spark):
    """The score's division is exact where products have 30 digits."""
    rng = random.Random(6)
    rows = [(rng.randint(10**14, 10**17), rng.randint(10**14, 10**17), rng.randint(10**15, 10**17), rng.randint(10**15, 10**17)) for _ in range(200)]
    df = spark.createDataFrame(rows, "a long, n long, l long, r long")
    c = lambda x: F.col(x).cast("decimal(18,0)")
    df = df.withColumns({"up": F.lit(1000) * c("a") * c("n"), "down": c("l") * c("r")}).withColumn("score", F.expr("up div down"))
    assert [r.score for r in df.collect()] == [1000 * a * n // (l * r) for a, n, l, r in rows]
