"""The license scan against a plain search for whole wordings, and its ranking against plain compression."""

import numpy as np
import pytest
import zstandard

from earmark.llm import licenses

FILLER = "the model of a river was drawn by hand, and then it rained; nobody saw how many boats left. We went on\nto the next town".split(" ")


def plain(text):
    """Places that hold all words of a template one after another, unless they are part of a longer such place."""
    words = licenses._words(text)
    found = []
    for name, wording in licenses.TEMPLATES.items():
        want = [w for w, _, _ in licenses._words(wording)]
        for i in range(len(words) - len(want) + 1):
            if [w for w, _, _ in words[i : i + len(want)]] == want:
                found.append((name, words[i][1], words[i + len(want) - 1][2]))
    return {f for f in found if not any(g != f and g[1] <= f[1] and f[2] <= g[2] for g in found)}


def made_text(rng):
    parts = []
    for _ in range(rng.integers(0, 5)):
        parts.append(" ".join(rng.choice(FILLER, rng.integers(1, 60))) + rng.choice([".", "\n", " :", ""]))
        if rng.random() < 0.7:
            parts.append(rng.choice(list(licenses.TEMPLATES.values())))
    return " ".join(parts)


def test_whole_wordings_are_all_found():
    rng = np.random.default_rng(12)
    scanner = licenses.Scanner(licenses.TEMPLATES)
    total = 0
    for _ in range(300):
        text = made_text(rng)
        got = scanner.scan(text)
        assert {(name, s, e) for name, s, e, missing, added, *_ in got if not missing and not added} == plain(text), text
        # Filler holds no notice, so nothing else is reported.
        assert len(got) == len(plain(text)), text
        total += len(got)
    assert total > 200


def test_documents_against_plain_search(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    got = {(r.doc_id, r.license, r.start, r.end) for r in licenses.find_licenses(docs).collect() if not r.n_missing and not r.n_added}
    expected = {(r.doc_id, *place) for r in docs.collect() for place in plain(r.text or "")}
    assert got == expected


@pytest.mark.parametrize("name", list(licenses.TEMPLATES))
def test_ranking_is_that_of_plain_compression(name):
    block = "Some words before. " + licenses.TEMPLATES[name].replace("work", "book", 1)
    data = block.encode()
    alone = len(zstandard.ZstdCompressor(level=3, write_checksum=False).compress(data))
    savings = []
    for order, wording in enumerate(licenses.TEMPLATES.values()):
        given = zstandard.ZstdCompressionDict(wording.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        savings.append((-(alone - len(zstandard.ZstdCompressor(level=3, write_checksum=False, dict_data=given).compress(data))), order))
    expected = [(-s, list(licenses.TEMPLATES)[o]) for s, o in sorted(savings) if -s >= max(1, licenses.SAVING * alone)]
    assert [(saving, t.name) for saving, _, _, t in licenses.Scanner(licenses.TEMPLATES).rank(block)] == expected


def test_what_is_known_is_bounded_and_kept_by_digest():
    scanner = licenses.Scanner(licenses.TEMPLATES)
    text = "Released under the MIT License. " + "x" * 1000
    for i in range(5000):
        scanner.cached(f"{text}{i}", 0, 31)
    assert len(scanner.known) <= 4096 and all(len(k) == 16 for k in scanner.known)
    assert scanner.cached(text, 0, 31) == scanner._found(text, 0, 31) != ()
