"""License notices by conditional compression.

Regions of a text around licensing words are compressed alone and with each template as the raw
dictionary of the compressor. The template that saves most bytes is the best guess; it is confirmed by
the exact differences in wording between the region and the template.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from difflib import SequenceMatcher

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earmark.llm.jobs import bound_batches, take_columns

# Wording of public license notices.
TEMPLATES = {
    "Apache-2.0 line": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "MIT line": "Released under the MIT License.",
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "GPL-3.0 line": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0 line": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "LGPL-2.1 line": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "AGPL-3.0 line": "This work is licensed under the GNU Affero General Public License, version 3.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-ND-4.0": "Licensed under CC BY-ND 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}
# A template is only found in a region with one of these; each template holds one.
TRIGGER = re.compile(r"licen[sc]|copyright|permission|redistribut|public domain", re.IGNORECASE)
WORD = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")
# Words of a template that may be missing or replaced, and that may be added, by share.
TOLERANCE = 0.15
# A template must save this share of the region's compressed size at least to be compared.
SAVING = 0.1
NARROW = 80


@dataclass(frozen=True)
class Template:
    name: str
    text: str
    words: tuple[str, ...]
    telling: frozenset[str]


def _words(text: str) -> list[tuple[str, int, int]]:
    return [(m[0].lower(), m.start(), m.end()) for m in WORD.finditer(text)]


def make_templates(texts: dict[str, str]) -> list[Template]:
    """Templates with their words; numbers and words that no other template has are telling."""
    split = {name: tuple(w for w, _, _ in _words(text)) for name, text in texts.items()}
    out = []
    for name, text in texts.items():
        if not TRIGGER.search(text):
            raise ValueError(f"template {name} has no licensing word")
        others = {w for other, words in split.items() if other != name for w in words}
        telling = {w for w in split[name] if w not in others or any(c.isdigit() for c in w)}
        out.append(Template(name, text, split[name], frozenset(telling) if len(split[name]) < 20 else frozenset(w for w in telling if any(c.isdigit() for c in w))))
    return out


class Scanner:
    def __init__(self, texts: dict[str, str]):
        self.templates = make_templates(texts)
        self.plain = zstandard.ZstdCompressor(level=3, write_checksum=False)
        self.given = [
            zstandard.ZstdCompressor(level=3, write_checksum=False, dict_data=zstandard.ZstdCompressionDict(t.text.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT))
            for t in self.templates
        ]
        self.reach = 2 * max(len(t.text) for t in self.templates)
        # By digest, as stretches may be long.
        self.known: dict[bytes, tuple] = {}

    def regions(self, text: str) -> list[tuple[int, int]]:
        """Stretches around licensing words, as far as the longest template could reach."""
        out: list[list[int]] = []
        for m in TRIGGER.finditer(text):
            a, b = max(0, m.start() - self.reach), min(len(text), m.end() + self.reach)
            if out and a <= out[-1][1]:
                out[-1][1] = b
            else:
                out.append([a, b])
        return [(a, b) for a, b in out]

    def blocks(self, text: str) -> list[tuple[int, int]]:
        """Candidate blocks: the sentences of regions with a licensing word, and the same with what follows.

        Notices of one sentence are found in the sentence; for longer ones the block goes on for twice
        the template's length.
        """
        out = []
        for a, b in self.regions(text):
            at = a
            for m in re.finditer(r"(?<=[.!?:;])\s+|\n", text[a:b]):
                out.append((at, a + m.start()))
                at = a + m.end()
            out.append((at, b))
        return [(x, y) for x, y in out if TRIGGER.search(text, x, y)]

    def rank(self, block: str) -> list[tuple[int, int, int, Template]]:
        """(saving, bytes alone, bytes given the template, template), best first; ties by order."""
        data = block.encode()
        alone = len(self.plain.compress(data))
        given = [len(c.compress(data)) for c in self.given]
        ranked = sorted(((alone - g, alone, g, t) for g, t in zip(given, self.templates)), key=lambda x: -x[0])
        return [x for x in ranked if x[0] >= max(1, SAVING * alone)]

    def confirm(self, template: Template, text: str, start: int, end: int) -> tuple[int, int, int, int] | None:
        """Where the template's wording stands around a block, with missing and added words."""
        size = len(template.text)
        # A long block is read from its start on; its other parts are blocks of their own.
        lo, hi = max(0, start - 2 * size), start + 3 * size
        if end - start <= 4 * NARROW:
            hi = max(hi, end + size)
        words = _words(text[lo:hi])
        got = self._match(template, [w for w, _, _ in words], 0)
        if got is None:
            return None
        first, last, missing, added = got
        return lo + words[first][1], lo + words[last - 1][2], missing, added

    def _match(self, template: Template, words: list[str], at: int) -> tuple[int, int, int, int] | None:
        """First and last word of a place with the template's wording; the place with the longest run is tried first."""
        want = len(template.words)
        slack = max(2, int(TOLERANCE * want))
        least = want - int(TOLERANCE * want)
        if not template.telling <= set(words) or (Counter(template.words) & Counter(words)).total() < least:
            return None
        match = SequenceMatcher(None, template.words, words, autojunk=False)
        main = match.find_longest_match()
        # Missing and added words part a notice into so many runs at most.
        if main.size * (want - least + slack + 1) < least:
            return None
        # Runs far from the longest one belong to another place.
        a, b = max(0, main.b - main.a - slack), main.b - main.a + want + slack
        match.set_seq2(words[a:b])
        runs = [r for r in match.get_matching_blocks() if r.size and abs((r.b + a - main.b) - (r.a - main.a)) <= slack]
        have = {template.words[r.a + i] for r in runs for i in range(r.size)}
        missing = want - sum(r.size for r in runs)
        first, last = runs[0].b + a, runs[-1].b + runs[-1].size + a
        added = (last - first) - sum(r.size for r in runs)
        if missing > TOLERANCE * want or added > slack or not template.telling <= have:
            # Another place has no run as long; it lies before or behind this one.
            return self._match(template, words[: main.b], at) or self._match(template, words[main.b + main.size :], at + main.b + main.size)
        return at + first, at + last, missing, added

    def _found(self, around: str, start: int, end: int) -> tuple:
        for saving, alone, given, template in self.rank(around[start:end]):
            if (at := self.confirm(template, around, start, end)) is not None:
                return template.name, *at, saving, alone, given
        return ()

    def cached(self, around: str, start: int, end: int) -> tuple:
        key = hashlib.blake2b(f"{start}:{end}:{around}".encode("utf-8", "surrogatepass"), digest_size=16).digest()
        if key not in self.known:
            if len(self.known) >= 4096:
                self.known.clear()
            self.known[key] = self._found(around, start, end)
        return self.known[key]

    def scan(self, text: str) -> list[tuple]:
        """(license, start, end, missing, added, saving, bytes alone, bytes given) of confirmed notices."""
        found: list[tuple] = []
        for block in self.blocks(text):
            parts = self.free(found, *block)
            while parts:
                a, b = parts.pop()
                got = self.first(text, a, b, found)
                if got:
                    # What the notice leaves of the part may hold others.
                    insort(found, got, key=lambda f: f[1])
                    parts += self.free(found, a, b)
        return found

    @staticmethod
    def free(found: list[tuple], a: int, b: int) -> list[tuple[int, int]]:
        """The parts of a stretch that no found notice covers."""
        out = []
        for _, s, e, *_ in found[max(0, bisect_left(found, a, key=lambda f: f[1]) - 1) :]:
            if s >= b:
                break
            if a < s:
                out.append((a, s))
            a = max(a, e)
        return [*out, (a, b)] if a < b else out

    def first(self, text: str, a: int, b: int, found: list[tuple]) -> tuple:
        """A notice in or around a part of a block, between the notices found before and behind it; () if none."""
        if not TRIGGER.search(text, a, b):
            return ()
        i = bisect_left(found, a, key=lambda f: f[1])
        low, high = found[i - 1][2] if i else 0, found[i][1] if i < len(found) else len(text)
        whole = min(high, self.longer(text, a, b))
        tries = [(a, whole), (a, b)] if whole > b else [(a, b)]
        if b - a > 2 * NARROW:  # no sentence ends nearby: narrow windows around the licensing words
            tries += [(max(a, m.start() - NARROW), min(b, m.end() + NARROW)) for m in TRIGGER.finditer(text, a, b)]
        for x, y in tries:
            lo = max(low, x - self.reach)
            got = self.cached(text[lo : min(high, y + self.reach)], x - lo, y - lo)
            if got:
                name, s, e, *rest = got
                return name, s + lo, e + lo, *rest
        return ()

    def longer(self, text: str, a: int, b: int) -> int:
        """End of the block when it may be the beginning of a long notice: the words of one start here."""
        head = [w for w, _, _ in _words(text[a : min(b, a + 200)])][:8]
        for t in self.templates:
            if len(t.words) > len(head) and len(set(head) & set(t.words[:12])) >= 5:
                b = max(b, min(len(text), a + int(1.3 * len(t.text))))
        return b


RESULT = "doc_id long, license string, start long, end long, n_missing long, n_added long, saved_bytes long, alone_bytes long, given_bytes long"


def find_licenses(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", templates: dict[str, str] | None = None) -> DataFrame:
    """One row for each confirmed notice in whole texts, in code points, end exclusive.

    A sentence or line may hold several notices, equal or different ones; notices don't overlap.
    Columns: `doc_id, license, start, end`; words of the template that are missing or replaced, and words
    added; compressed bytes of the block alone, given the template, and their difference. Equal savings
    go to the template that stands first. A notice whose telling words (names, versions) differ isn't
    confirmed. Null and empty texts hold none; repeated rows are reported each; a null id stays null.
    """
    bound_batches(documents.sparkSession)
    texts = dict(templates or TEMPLATES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(texts)
        for batch in batches:
            rows = [(d, *f) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if t and TRIGGER.search(t) for f in scanner.scan(t)]
            if rows:
                columns = list(zip(*rows))
                yield pa.record_batch(
                    [pa.array(c, pa.string() if i == 1 else pa.int64()) for i, c in enumerate(columns)],
                    names=["doc_id", "license", "start", "end", "n_missing", "n_added", "saved_bytes", "alone_bytes", "given_bytes"],
                )

    docs = take_columns(documents, doc_id=doc_id, text=text).withColumn("doc_id", F.col("doc_id").cast("long"))
    return docs.mapInArrow(run, RESULT)
