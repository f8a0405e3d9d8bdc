"""Operators that judge documents: personal data, licenses, quality, leaks, mixing, shards, tokens."""

import collections
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from earmark.llm import decontaminate, licenses, mixing, pii, quality, sharding, tokens
from tests.llm import brute
from tests.llm.conftest import ROWS, SF

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def by_text(rows):
    return sorted(rows, key=str)


# ---------------------------------------------------------------- personal data


def test_base_spans_equal_the_plain_patterns():
    rng = random.Random(3)
    parts = ["1", "29", "0", ".", "@", "a", "-", " ", "+", "(", ")", ".1.2", "é", "4111111111111111", "x@y.z", "+1 (269) 555-3296", "999.1.1.1"]
    for _ in range(20_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert pii.base_spans(text)[0] == brute.pii(text), text


def test_field_parts_neighbours_that_the_patterns_miss(documents):
    field = pii.train_field(documents.select("doc_id", "text"))
    for text, want in [
        ("call +1 (269) 555-3296 4524132264652876 now", {"+1 (269) 555-3296", "4524132264652876"}),
        ("on 2024-01-02 10:22:11, 12345 items", set()),
    ]:
        base, _ = pii.base_spans(text)
        assert {text[a:b] for _, a, b in base + pii.added_spans(text, field, base)} == want


def test_decoding_is_the_best_of_all_segmentations():
    """Against all sets of segments that don't overlap."""
    field = pii.Field()
    for text in ["+1 (269) 555-3296 4524132264652876", "10.1.2.3 45 4524132264652876", "a@b.co+1 999 888 7777"]:
        edges, ends = pii.candidates(text, 0, len(text))
        segments = [(c, field.score(c[3])) for e in ends for c in e]

        def best(at, segments=segments):
            return max([0.0] + [s + best(c[1]) for c, s in segments if c[0] >= at])

        got = sum(field.score(next(c[3] for c, _ in segments if (c[2], edges[c[0]], edges[c[1]]) == span)) for span in field.decode(text, 0, len(text)))
        assert got == pytest.approx(best(0))


def test_gradient_is_that_of_the_likelihood():
    text = " +1 (269) 555-3296 4524132264652876 "
    gold = {("phone", 1, 18), ("card", 19, 35)}
    lattice = pii.candidates(text, 1, len(text) - 1)
    field = pii.Field()

    def likelihood(weights):
        model = pii.Field(weights)
        segments = [(c, model.score(c[3])) for e in lattice[1] for c in e]

        def total(at):
            return 1.0 + sum(np.exp(s) * total(c[1]) for c, s in segments if c[0] >= at)

        edges = lattice[0]
        return sum(s for c, s in segments if (c[2], edges[c[0]], edges[c[1]]) in gold) - np.log(total(0))

    for name, g in field.gradient(lattice, gold).items():
        up, down = dict(field.weights), dict(field.weights)
        up[name], down[name] = up.get(name, 0.0) + 1e-4, down.get(name, 0.0) - 1e-4
        assert g == pytest.approx((likelihood(up) - likelihood(down)) / 2e-4, abs=1e-4)


def test_pii_of_odd_rows(odd, empty):
    import hashlib

    got = {r.doc_id: r for r in pii.find_pii(odd).collect()}
    for d, t, *_ in ROWS:
        spans = brute.pii(t)
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert got[d].base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert [got[d][f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == k for s in spans) for k in pii.KINDS]
        assert set(filter(None, listed.split(","))) <= set(got[d].spans.split(","))
    assert got[12].n_added == 2
    assert pii.find_pii(empty).count() == 0


def test_long_hostile_texts_take_linear_time():
    for text in ("1" * 100_000, "a" * 100_000 + "@", "@" * 100_000, "1." * 50_000):
        pii.added_spans(text, pii.Field(), pii.base_spans(text)[0])


# ---------------------------------------------------------------- licenses


def test_every_template_is_found_in_prose():
    scanner = licenses.Scanner(licenses.TEMPLATES)
    for name, text in licenses.TEMPLATES.items():
        for before, after in (("", ""), ("Foo bar. ", " Baz qux the end."), ("alpha beta\n", "\ngamma")):
            found = scanner.scan(before + text + after)
            assert [f[0] for f in found] == [name]
            assert found[0][1] == len(before) and found[0][3:5] == (0, 0)


def test_wording_decides():
    scanner = licenses.Scanner(licenses.TEMPLATES)
    changed = licenses.TEMPLATES["MIT"].replace("free of charge", "for free").replace("sublicense, ", "")
    assert [(f[0], f[3] > 0) for f in scanner.scan(changed)] == [("MIT", True)]
    assert scanner.scan("This work is licensed under the GNU General Public License, version 7. We have a license to sell.") == []


def test_all_notices_of_a_sentence_and_of_neighbouring_lines():
    scanner = licenses.Scanner(licenses.TEMPLATES)
    mit = licenses.TEMPLATES["MIT"]
    changed = mit.replace("free of charge", "for free").replace("sublicense, ", "")
    filler = " ".join(f"word{i}" for i in range(60))
    for text, want in [
        ("The code is released under the MIT License, docs licensed under CC BY 4.0 and figures licensed under CC BY-SA 4.0.", ["MIT line", "CC-BY-4.0", "CC-BY-SA-4.0"]),
        ("Text licensed under CC BY 4.0, figures licensed under CC BY 4.0 and data licensed under CC BY 4.0.", ["CC-BY-4.0"] * 3),
        ("Fig. 1. Licensed under CC BY 4.0.\nFig. 2. Licensed under CC BY 4.0.\nLicensed under CC BY 4.0.\n", ["CC-BY-4.0"] * 3),
        ("Licensed under CC BY 4.0.\nReleased under the MIT License.\nLicensed under CC BY-NC 4.0.", ["CC-BY-4.0", "MIT line", "CC-BY-NC-4.0"]),
        (f"{filler} licensed under CC BY 4.0 {filler} released under the MIT License {filler} licensed under CC BY 4.0 {filler}", ["CC-BY-4.0", "MIT line", "CC-BY-4.0"]),
        ("All figures and tables, the photographs and the other material of this volume that the authors made are licensed under CC BY 4.0.", ["CC-BY-4.0"]),
        (f"{mit}\n{mit}\n\n{mit}", ["MIT"] * 3),
        (f"{changed} {changed}\n{mit}", ["MIT"] * 3),
        ("Licensed under CC BY 4.0. " * 300, ["CC-BY-4.0"] * 300),
    ]:
        found = scanner.scan(text)
        assert [f[0] for f in found] == want, (text[:80], [f[:3] for f in found])
        assert all(a[2] <= b[1] for a, b in zip(found, found[1:]))


def test_licenses_of_documents(spark, documents, empty):
    got = licenses.find_licenses(documents).collect()
    lines = {
        "Licensed under the Apache License, Version 2.0.": "Apache-2.0 line", "Released under the MIT License.": "MIT line",
        "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0 line",
    }
    want = [(r.doc_id, name) for r in documents.collect() for line, name in lines.items() for _ in range((r.text or "").count(line))]
    assert set(want) <= {(r.doc_id, r.license) for r in got} and len(got) >= len(want)
    assert licenses.find_licenses(empty).count() == 0
    assert licenses.find_licenses(spark.createDataFrame([(None, list(lines)[0]), (1, None)], "doc_id long, text string")).count() == 1


# ---------------------------------------------------------------- quality


def test_quality_counts(odd, empty, documents):
    for df in (odd, documents):
        text = {r.doc_id: r.text for r in df.collect()}
        for r in quality.judge(df).collect():
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute.quality_counts(text[r.doc_id])
            assert not (r.base_failed and r.kept)
    assert quality.judge(empty).count() == 0
    assert quality.passing(odd).columns == odd.columns


def test_sketches_hold_quantiles_to_one_per_cent(spark):
    rng = np.random.default_rng(4)
    values = np.sort(np.exp(rng.normal(size=5000)))
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    got = df.select("v", quality.bucket_value(quality.sketch_bucket(F.col("v"))).alias("q")).collect()
    assert all(abs(r.q / r.v - 1) <= 0.0101 for r in got)


def test_limits_follow_the_source(spark):
    rng = np.random.default_rng(5)

    def text(rate):
        return " ".join(f"w{rng.integers(10**9)}" + "#" * int(rng.random() < rate) for _ in range(60))

    rows = [(i, text(0.4 if i % 2 else 0.0), "en", "code" if i % 2 else "prose") for i in range(600)]
    rows += [(1000, text(0.4), "en", "prose"), (1001, text(0.4), "en", "code")]
    kept = {r.doc_id: r.kept for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not kept[1000] and kept[1001] and sum(kept.values()) >= 600


def test_verdicts_agree_with_labels(spark, documents):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    joined = quality.judge(documents).where("NOT base_failed").join(labels, "doc_id").collect()
    assert sum(r.kept == (r.quality == 1) for r in joined) >= 0.95 * len(joined)


# ---------------------------------------------------------------- leaks


def longest_plain(equal):
    best = (0, 0)
    for i in range(len(equal)):
        for j in range(i + 1, len(equal) + 1):
            if equal[i] and equal[j - 1] and 5 * sum(equal[i:j]) >= 4 * (j - i) and j - i > best[1] - best[0]:
                best = (i, j)
    return best


def test_longest_overlap_equals_brute_force():
    rng = np.random.default_rng(6)
    for _ in range(300):
        equal = rng.random(rng.integers(1, 40)) < rng.choice([0.3, 0.7, 0.9])
        assert decontaminate.longest_overlap(equal) == longest_plain(equal.tolist())


def test_substitutions_at_any_place_leave_an_overlap():
    """Items of 4 to 20 words with one and two words replaced, in a document and at its ends, against all windows."""
    from itertools import combinations

    for n in range(4, 21):
        item = np.arange(n)
        for bad in [c for k in (1, 2) for c in combinations(range(n), k)]:
            for before, after in ((0, 0), (3, 4), (0, 9)):
                equal = np.ones(n, bool)
                equal[list(bad)] = False
                least = min(decontaminate.OVERLAP, n)
                runs = [(i, j) for i in range(n) for j in range(i + least, n + 1) if 5 * equal[i:j].sum() >= 4 * (j - i)]
                a, b = decontaminate.extended_overlap(equal, least)
                assert (b > a) == bool(runs), (n, bad)
                # The found run is the longest that some window leaves between its equal words.
                trimmed = [np.flatnonzero(equal[i:j])[[0, -1]] + i for i, j in runs]
                assert b - a == max([int(y - x) + 1 for x, y in trimmed], default=0), (n, bad)
                block = decontaminate.TestBlock([1], [" ".join(f"b{x}" for x in item)])
                text = ["p"] * before + [f"b{x}" if e else "other" for x, e in zip(item, equal)] + ["p"] * after
                words, values = decontaminate.words_of(decontaminate.pa.array([" ".join(text)]))
                found = decontaminate.overlaps(block, values, words.first, words.doc)
                assert {r[2:5] for r in found} <= {(before + a, a, b - a)} and (not runs or found or n < 7), (n, bad)


def test_masks_catch_two_substitutions_in_thirteen_words():
    from itertools import combinations

    for masks, n in ((decontaminate.LONG, 13), (decontaminate.SHORT, 10)):
        for bad in combinations(range(n), 2):
            assert any(all(m[i] == "0" or o + i not in bad for i in range(len(m))) for m in masks for o in range(n - len(m) + 1))


def test_masks_catch_every_run_that_the_share_accepts():
    from itertools import combinations

    def missed(masks, n, k):
        used = [sum(1 << o + i for i, c in enumerate(m) if c == "1") for m in masks for o in range(n - len(m) + 1)]
        return [bad for bad in combinations(range(n), k) if all(u & sum(1 << i for i in bad) for u in used)]

    for n in (*range(13, 21), 25):
        assert missed(decontaminate.LONG, n, n // 5) == [], n
    for n in range(4, 13):
        assert missed(decontaminate.SHORT, n, n // 5) == [], n


def diagonal_overlaps(docs, items):
    """(doc, item, word in document, word in item) of every diagonal with a window that the rule accepts."""
    found = set()
    for d, text in enumerate(docs):
        for i, item in enumerate(items):
            least = min(13, len(item))
            for shift in range(-len(item), len(text)):
                lo, hi = max(0, -shift), min(len(item), len(text) - shift)
                equal = [item[q] == text[q + shift] for q in range(lo, hi)]
                if any(5 * sum(equal[a:b]) >= 4 * (b - a) for a in range(len(equal)) for b in range(a + least, len(equal) + 1)):
                    found.add((d, i, shift))
    return found


def test_overlaps_equal_a_search_of_all_diagonals(spark):
    rng = random.Random(9)
    vocabulary = [f"v{i}" for i in range(300)]
    items = [rng.choices(vocabulary, k=n) for n in (*range(1, 26), 40)]
    docs = []
    for item in items * 4:
        # A passage of the item with substitutions near the limit, amid other words or at an end.
        a = rng.randrange(max(1, len(item) - 14)) if rng.random() < 0.5 else 0
        part = list(item[a : a + rng.randint(13, 25)] if rng.random() < 0.5 else item)
        for k in rng.sample(range(len(part)), min(len(part), max(0, len(part) // 5 + rng.choice([-1, 0, 0, 0, 1])))):
            part[k] = "other"
        docs.append(rng.choices(vocabulary, k=rng.choice([0, 0, 1, 20])) + part + rng.choices(vocabulary, k=rng.choice([0, 0, 1, 20])))
    want = diagonal_overlaps(docs, items)
    # Runs of 15, 20 and 25 words whose substitutions hit every window of 13.
    for n, bad in ((15, (2, 5, 7)), (17, (5, 7, 9)), (5, (1,)), (6, (2,))):
        items.append([f"u{n}x{i}" for i in range(n)])
        docs.append([("other" if i in bad else w) for i, w in enumerate(items[-1])])
        want.add((len(docs) - 1, len(items) - 1, 0))
    frame = lambda rows, key: spark.createDataFrame([(i, " ".join(r)) for i, r in enumerate(rows)], f"{key} long, text string")
    got = decontaminate.find_overlaps(frame(docs, "doc_id"), frame(items, "item_id")).collect()
    assert {(r.doc_id, r.item_id, r.doc_word - r.item_word) for r in got} == want and len(got) == len(want)
    assert 70 < len(want)


def test_overlaps_with_substitutions(spark):
    item = [f"b{i}" for i in range(30)]
    near = list(item)
    near[4] = near[11] = near[20] = "other"
    far = [w if i % 3 else "other" for i, w in enumerate(item)]
    rows = [(1, "x y " + " ".join(item).upper() + " z"), (2, " ".join(["p"] * 40 + near)), (3, " ".join(far)), (4, None), (5, ""), (6, " ".join(item[:12])), (7, "so short an item"), (7, "so short an item"), (None, " ".join(item))]
    tests = [(0, " ".join(item)), (1, "so short an item"), (2, None), (3, ""), (4, " ".join(item)), (0, " ".join(item))]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(tests, "item_id long, text string")
    got = decontaminate.find_overlaps(docs, bench).collect()
    assert sorted(((r.doc_id, r.item_id, r.doc_word, r.n_words, r.n_equal) for r in got), key=str) == sorted(
        [(1, 0, 2, 30, 30), (1, 4, 2, 30, 30), (2, 0, 40, 30, 27), (2, 4, 40, 30, 27), (7, 1, 0, 4, 4), (7, 1, 0, 4, 4), (None, 0, 0, 30, 30), (None, 4, 0, 30, 30)], key=str
    )
    small = decontaminate.find_overlaps(docs, bench, block_words=20).collect()
    assert by_text(map(tuple, small)) == by_text(map(tuple, got))
    assert {r.doc_id for r in decontaminate.rows_without_overlaps(docs, bench).collect()} == {3, 4, 5, 6}
    assert decontaminate.find_overlaps(docs, bench.limit(0)).count() == decontaminate.find_overlaps(docs.limit(0), bench).count() == 0


def test_blocks_of_a_benchmark_are_let_go_one_after_another(spark, monkeypatch):
    """At most one block is shared with the tasks at a time, however many there are."""
    held, most, make = set(), [], spark.sparkContext.broadcast

    def counted(block):
        shared = make(block)
        let_go = shared.destroy
        shared.destroy = lambda *a, **b: (held.discard(id(shared)), let_go(*a, **b))
        held.add(id(shared))
        most.append(len(held))
        return shared

    monkeypatch.setattr(spark.sparkContext, "broadcast", counted)
    rows = [(i, " ".join(f"b{i}x{j}" for j in range(20))) for i in range(6)]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(rows, "item_id long, text string")
    got = decontaminate.find_overlaps(docs, bench, block_words=20)
    assert sorted((r.doc_id, r.item_id, r.n_equal) for r in got.collect()) == [(i, i, 20) for i in range(6)]
    assert decontaminate.rows_without_overlaps(docs, bench.where("item_id < 5"), block_words=20).count() == 1
    assert len(most) == 11 and max(most) == 1 and not held


def test_whole_items_in_documents_are_found(spark, documents):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    items = {r.item_id: r.text for r in bench.collect()}
    want = {(r.doc_id, i) for r in documents.collect() for i, t in items.items() if t in r.text}
    assert want <= {(r.doc_id, r.item_id) for r in decontaminate.find_overlaps(documents, bench).collect()}


def test_stages_of_the_pipeline_decide_on_rows(spark):
    import corpus_pipeline

    rng = random.Random(10)
    good = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(40))
    item, junk = good(), "# $ " * 40
    rows = [(i, good(), "en", "a") for i in range(30)] + [(None, good(), "en", "a") for _ in range(3)]
    clean = list(rows)
    rows += [(None, junk, "en", "a"), (0, junk, "en", "a"), (100, junk, None, None)]
    leaks = [(None, item, "en", "a"), (1, "x " + item, "en", "a"), (101, item + " y", None, "a")]
    copies = [(None, rows[2][1], "en", "a"), rows[2], rows[2], (rows[3][0], rows[2][1], "en", "b"), (None, rows[30][1], "en", "a"), (200, rows[31][1], "en", "a")]
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    listed = lambda df: by_text(map(tuple, df.collect()))
    assert listed(corpus_pipeline.quality_rules(spark, frame(rows), "")) == by_text(clean)
    bench = spark.createDataFrame([(1, item), (2, good())], "item_id long, text string")
    for words in (10, 1000):
        assert listed(decontaminate.rows_without_overlaps(frame(clean + leaks), bench, block_words=words)) == by_text(clean)
    assert listed(decontaminate.rows_without_overlaps(frame(clean), bench.limit(0))) == by_text(clean)
    once = [r for r in clean if r[1] != rows[31][1]] + [copies[-1]]
    assert listed(corpus_pipeline.near_copies(spark, frame(clean + copies), "")) == by_text(once)


# ---------------------------------------------------------------- mixing


@pytest.mark.parametrize("name", ["odd", "documents", "empty"])
def test_mix(name, request):
    df = request.getfixturevalue(name)
    got = mixing.mix(df).collect()
    rows = [(r.source, len(brute.WORD.findall(r.text or ""))) for r in df.collect()]
    size, target = brute.targets(rows)
    taken, expected = collections.Counter(), collections.Counter()
    assert len(got) == len(rows)
    for r in got:
        assert r.source_size == size[r.source] and r.target == pytest.approx(target[r.source], rel=1e-9)
        assert 0 <= r.copies <= 3 and abs(r.copies - r.rate) < 1 and r.taken == r.copies * r["size"]
        taken[r.source] += r.taken
        expected[r.source] += r.rate * r["size"]
    for s, t in target.items():
        assert expected[s] == pytest.approx(t, rel=1e-4, abs=0.1)
        assert abs(taken[s] - t) <= max([r["size"] for r in got if r.source == s])
    again = mixing.mix(df.repartition(5)).collect()
    assert by_text(map(tuple, again)) == by_text(map(tuple, got))


def test_repeated_rows_of_the_mix(odd, empty):
    copies = collections.Counter()
    for r in mixing.mix(odd).collect():
        copies[r.doc_id] += r.copies
    taken = mixing.repeat_rows(odd)
    assert taken.columns == odd.columns
    assert collections.Counter(r.doc_id for r in taken.collect()) == +copies
    assert mixing.repeat_rows(empty).count() == 0


# ---------------------------------------------------------------- shards


def test_shards(odd, documents, empty):
    for df in (odd, documents):
        got = sharding.assign(df).collect()
        counts = collections.Counter(r.shard for r in got)
        for s, n in counts.items():
            assert sorted(r.slot for r in got if r.shard == s) == list(range(n))
        assert all(r.grown_shard in (r.shard, 16) for r in got)
        text = {r.doc_id: (r.text or "").encode() for r in df.collect()}
        assert all(r["size"] == len(text[r.doc_id]) + 1 and r.text_crc32 == zlib.crc32(text[r.doc_id]) for r in got)
    assert sharding.assign(empty).count() == 0


def test_weights_and_confined_moves(spark):
    ids = spark.range(8000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    old = sharding.tree(16)
    heavy = [leaf._replace(weight=3.0) if leaf.shard == 5 else leaf for leaf in old]
    a = {r.doc_id: r.shard for r in sharding.assign(ids, leaves=old).collect()}
    b = {r.doc_id: r.shard for r in sharding.assign(ids, leaves=heavy).collect()}
    counts = collections.Counter(b.values())
    assert counts[5] == pytest.approx(8000 * 3 / 18, rel=0.1) and counts[9] == pytest.approx(8000 / 18, rel=0.15)
    place = {leaf.shard: leaf for leaf in old}
    for i, s in a.items():
        before, after = place[s], place[b[i]]
        # A row only leaves a subtree for one whose weight grew.
        assert before.region == after.region or after.region == place[5].region
        if before.region == after.region:
            assert before.rack == after.rack or after.rack == place[5].rack
            if before.rack == after.rack:
                assert s == b[i] or b[i] == 5


# ---------------------------------------------------------------- tokens


def test_elias_fano():
    rng = np.random.default_rng(7)
    for values in ([], [0], [5], [0, 0, 0], [7, 7, 9], np.sort(rng.integers(0, 10**7, 3000)), np.arange(1000), np.sort(rng.integers(0, 50, 2000)), [0, 2**40]):
        made = tokens.EliasFano.encode(np.array(values, np.uint64))
        read = tokens.EliasFano.frombytes(memoryview(made.tobytes()))
        assert read.values().tolist() == list(values) and [read[i] for i in range(len(values))] == list(values)
    dense = np.cumsum(rng.integers(1, 900, 60_000))
    assert len(tokens.EliasFano.encode(dense).tobytes()) < 0.25 * 8 * len(dense)


def test_token_files_give_back_what_the_tokenizer_makes(spark, odd, documents, empty):
    tokenizer = Tokenizer.from_file(VOCABULARY)
    hard = "l'été it's DON'T, 12,345 ﬁ Σας, é\xa0x a.b.c U.S.A. x's. q#, 3.5! é. ́, .́x <|endoftext|>, a<|endoftext|>."
    extra = spark.createDataFrame([(20, hard), (-4, "neg"), (20, "tie")], "doc_id long, text string")
    for df in (odd.select("doc_id", "text").union(extra), documents):
        rows = [(r.doc_id, r.text) for r in df.collect()]
        got = sorted(map(tuple, tokens.token_table(df, VOCABULARY).collect()), key=lambda r: r[1])
        assert got == brute.token_rows(tokenizer, rows)
    assert tokens.token_table(empty, VOCABULARY).count() == 0


def test_files_on_disk(spark, documents, tmp_path):
    tokenizer = Tokenizer.from_file(VOCABULARY)
    tokens.write_files(documents, VOCABULARY, str(tmp_path / "out"), file_tokens=5000)
    files = [tokens.TokenFile(p.read_bytes()) for p in (tmp_path / "out").glob("part-*") if p.stat().st_size]
    files.sort(key=lambda f: (f.part, f.number))
    ids = [d for f in files for d in f.doc_ids()]
    assert len(files) > 3 and ids == sorted(r.doc_id for r in documents.collect())
    text = {r.doc_id: r.text for r in documents.collect()}
    for f in files[:3]:
        for i, d in enumerate(f.doc_ids()):
            assert f.document(i).tolist() == tokenizer.encode(text[d], add_special_tokens=False).ids + [1]


def test_cache_starts_anew_when_full(monkeypatch):
    tokenizer = Tokenizer.from_file(VOCABULARY)
    monkeypatch.setattr(tokens, "CACHE_WORDS", 40)
    cache = tokens.WordCache(tokenizer)
    rng = random.Random(8)
    for _ in range(30):
        texts = [" ".join(f"w{rng.randint(0, 60)}" for _ in range(30)) for _ in range(3)]
        data = np.frombuffer("".join(texts).encode(), np.uint8)
        ends = np.cumsum([len(t.encode()) for t in texts])
        ids, at = cache.encode(data, np.append(0, ends), 1)
        want = [tokenizer.encode(t, add_special_tokens=False).ids + [1] for t in texts]
        assert ids.tolist() == sum(want, []) and at.tolist() == np.cumsum([len(w) for w in want]).tolist()


class Counted:
    """A tokenizer that notes how many texts it is given at each call."""

    def __init__(self, tokenizer):
        self.tokenizer, self.given = tokenizer, []

    def __getattr__(self, name):
        return getattr(self.tokenizer, name)

    def encode_batch_fast(self, texts, **how):
        self.given.append(len(texts))
        return self.tokenizer.encode_batch_fast(texts, **how)


def flat(texts):
    data = [t.encode() for t in texts]
    return np.frombuffer(b"".join(data), np.uint8), np.append(0, np.cumsum([len(t) for t in data])).astype(np.int64)


def test_new_words_are_tokenized_as_few_texts():
    tokenizer = Tokenizer.from_file(VOCABULARY)
    counted = Counted(tokenizer)
    texts = [" ".join(f"{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}{'uvwxyzéñüß'[i // 100 % 10]}{'ab'[i // 1000]} n-{i} q{i}$" for i in range(a, a + 50)) for a in range(0, 2000, 50)]
    ids, ends = tokens.WordCache(counted).encode(*flat(texts), 1)
    want = [tokenizer.encode(t, add_special_tokens=False).ids + [1] for t in texts]
    assert ids.tolist() == sum(want, []) and ends.tolist() == np.cumsum([len(w) for w in want]).tolist()
    assert sum(counted.given) < 6000 / 200


def test_words_that_cannot_be_told_apart_are_tokenized_alone(monkeypatch):
    tokenizer = Tokenizer.from_file(VOCABULARY)
    odd = ["İstanbul", "İ", "क़लम", "क़", "\x1f", "a\x1fb", "\x1f\x1f", "\xa0", "x\xa0y", "\u3000", "\x85", "각", "ꟊ", "K", "Å", "ﬁ", "Σας", "ΑΣ", "́", "é", "don't", "'s", "x's.", "</w>", "a</w>", "<|endoftext|>"]
    odd += ["<|ENDOFTEXT|>", "<|startoftext|>x", "12,345", "٣٤", "²", "ǅ", "ŉ", "ẞ", "你好", "👍🏽", "\u200b", "\ufeff", "\x00", ";", "≠", "≠", "plain", "Words", "été", "$$$", "1"]
    rng = random.Random(11)
    for joined in (1, 3, 1024):
        monkeypatch.setattr(tokens, "JOINED", joined)
        for words in (odd, odd[-5:]):
            cache = tokens.WordCache(tokenizer)
            for _ in range(12):
                texts = ["".join(rng.choice(words) + rng.choice([" ", " ", "\n", "\t ", "\r\n"]) for _ in range(rng.randint(0, 25))) for _ in range(4)] + [rng.choice(words)]
                ids, ends = cache.encode(*flat(texts), 1)
                want = [tokenizer.encode(t, add_special_tokens=False).ids + [1] for t in texts]
                assert ids.tolist() == sum(want, []) and ends.tolist() == np.cumsum([len(w) for w in want]).tolist()


def test_distinct_values_with_first_place_and_rank():
    rng = np.random.default_rng(5)
    for values in (rng.integers(0, 1 << 63, 4000, dtype=np.uint64) * np.uint64(2), rng.integers(0, 40, 3000).astype(np.uint64), np.zeros(0, np.uint64), np.array([(1 << 64) - 1, 0, 1 << 63], np.uint64)):
        for got, want in zip(tokens.distinct(values), np.unique(values, return_index=True, return_inverse=True)):
            assert got.tolist() == want.tolist()


def test_headers_go_to_python_once(spark, documents, tmp_path):
    tokens.write_files(documents, VOCABULARY, str(tmp_path / "out"), file_tokens=5000)
    read = tokens.read_files(spark, str(tmp_path / "out"))
    assert read._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    rows = sorted(read.collect(), key=lambda r: r.start)
    assert rows[0].start == 0 and all(a.start + a.n_tokens == b.start for a, b in zip(rows, rows[1:])) and len(rows) == documents.count()
