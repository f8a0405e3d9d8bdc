"""Near-duplicates and repeated passages against plain rewrites."""

import numpy as np
import pytest

from earmark.llm import components, simhash, substrings
from tests.llm import brute
from tests.llm.conftest import ROWS


def by_text(rows):
    return sorted(rows, key=str)


def test_close_pairs_equal_brute_force_in_groups_of_all_sizes():
    rng = np.random.default_rng(1)
    fp = rng.integers(0, 1 << 63, 2400, dtype=np.uint64)
    for i in range(900):
        flipped = int(fp[i])
        for b in rng.choice(64, rng.integers(1, 8), replace=False):
            flipped ^= 1 << int(b)
        fp[1200 + i] = flipped
    for group in (np.zeros(2400, int), np.arange(2400) % 1200, np.repeat(np.arange(40), 60), np.arange(2400)):
        order = np.argsort(group, kind="stable")
        f, g = fp[order], group[order]
        got = {(a, b) for x, y in simhash.close_pairs(f, g) for a, b in zip(x.tolist(), y.tolist())}
        want = set()
        for i in range(len(f)):
            j = i + 1 + np.flatnonzero((np.bitwise_count(f[i + 1 :] ^ f[i]) <= 4) & (g[i + 1 :] == g[i]))
            want |= {(i, int(k)) for k in j}
        assert got == want


@pytest.mark.parametrize("rows", [1000, 10**9, 10**12])
def test_masks_catch_every_pair_within_the_radius(rows):
    rng = np.random.default_rng(2)
    masks = simhash.key_masks(rows)
    for _ in range(500):
        differ = sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
        assert any(differ & m == 0 for m in masks)


def test_near_duplicates(odd, empty):
    got = [(r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in simhash.near_duplicates(odd).collect()]
    assert by_text(got) == by_text(brute.near_components([r[:2] for r in ROWS]))
    assert simhash.near_duplicates(empty).count() == 0


def test_near_duplicates_of_documents(documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    got = [(r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in simhash.near_duplicates(documents).collect()]
    assert by_text(got) == by_text(brute.near_components(rows))


def test_hot_buckets_are_cut_without_losing_links(spark, monkeypatch):
    monkeypatch.setattr(simhash, "PIECE", 8)
    base = 0x0123456789ABCDEF
    prints = [base ^ (1 << b) for b in range(60)] + [base ^ (0xFF << 4 * i) for i in range(12)]
    table = spark.createDataFrame([(p if p < 1 << 63 else p - (1 << 64),) for p in prints], "fp long")
    roots = {r.node: r.root for r in components.components(simhash.near_links(table)).collect()}
    star = {p for p in prints[:60]}
    assert len({roots.get(p, p) for p in star}) == 1


def test_one_row_of_each_keeps_one_row_of_each_component(odd, empty, documents):
    for df, rows in ((odd, [r[:2] for r in ROWS]), (documents, [(r.doc_id, r.text) for r in documents.collect()])):
        numbered = brute.near_components([(i, t) for i, (_, t) in enumerate(rows)])
        members = {}
        for i, _, label in numbered:
            members.setdefault(label, []).append(rows[i])
        kept = simhash.one_row_of_each(df)
        assert kept.columns == df.columns
        # The smallest id of each, or a null one if there is no other.
        want = [min((d for d, _ in m if d is not None), default=None) for m in members.values()]
        assert by_text(r.doc_id for r in kept.collect()) == by_text(want)
    assert simhash.one_row_of_each(empty).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 130)] + [(5, 5)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, **{i: 100 for i in range(101, 130)}}


def test_repeated_passages(odd, empty):
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substrings.remove_repeats(odd).collect()]
    assert by_text(got) == by_text(brute.removed([r[:2] for r in ROWS]))
    assert any(n for _, _, n, _ in got)
    assert substrings.remove_repeats(empty).count() == 0


def test_kept_text_is_the_digested_text(odd):
    import hashlib

    for r in substrings.remove_repeats(odd).collect():
        assert hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256


def test_repeated_passages_in_many_packs(documents, monkeypatch):
    """Small packs give the same result; they are cut in the driver's plan, so tasks see the sizes."""
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substrings.remove_repeats(documents.repartition(13), keep_text=False).collect()]
    assert by_text(got) == by_text(brute.removed(rows))
