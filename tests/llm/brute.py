"""Plain rewrites of the contracts, to compare with."""

from __future__ import annotations

import collections
import hashlib
import re
import zlib

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fingerprint(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def near_components(rows):
    """rows: (doc_id, text). The smallest id that links reach, for each row."""
    prints = [fingerprint(t) for _, t in rows]
    label = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(len(rows)):
                if (prints[i] ^ prints[j]).bit_count() <= 4 and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    lowest = {}
    for (d, _), k in zip(rows, label):
        if d is not None:
            lowest[k] = min(d, lowest.get(k, d))
    return [(d, p, lowest.get(k)) for (d, _), p, k in zip(rows, prints, label)]


def removed(rows, window=50):
    first, words = {}, []
    for d, t in rows:
        w = WORD.findall(t or "")
        words.append(w)
        for j in range(len(w) - window + 1) if d is not None else ():
            k = tuple(w[j : j + window])
            first[k] = min(first.get(k, d), d)
    out = []
    for (d, _), w in zip(rows, words):
        gone = [False] * len(w)
        for j in range(len(w) - window + 1) if d is not None else ():
            if first[tuple(w[j : j + window])] < d:
                gone[j : j + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def quality_counts(text):
    text = text or ""
    words = WORD.findall(text)
    at = collections.defaultdict(list)
    for i in range(len(words) - 4):
        at[tuple(words[i : i + 5])].append(i)
    repeated = len({j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 5)})
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, repeated, n < 10 or 100 * repeated > 20 * n


PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = sum(int(c) for c in digits[::-2])
    return (total + sum(sum(divmod(2 * int(c), 10)) for c in digits[-2::-2])) % 10 == 0


def pii(text):
    out = []
    for kind, pattern in PII.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {
                "email": lambda: True, "ip": lambda m=m: all(int(p) <= 255 for p in m[0].split(".")),
                "card": lambda d=digits: 13 <= len(d) <= 19 and luhn(d), "phone": lambda d=digits: 9 <= len(d) <= 15,
            }[kind]()
            if ok:
                out.append((kind, *m.span()))
    return out


def targets(rows):
    """rows: (source, size). Words and target of each source."""
    size = collections.Counter()
    for s, n in rows:
        size[s] += n
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, free, left = {}, set(order), float(sum(size.values()))
    while free:
        total = sum(weight[s] for s in free)
        stop = [s for s in free if left * weight[s] / total > 3 * size[s]]
        if not stop:
            target |= {s: left * weight[s] / total for s in free}
            break
        for s in stop:
            target[s] = 3.0 * size[s]
            free.discard(s)
        left -= sum(target[s] for s in stop)
    return size, target


def token_rows(tokenizer, rows):
    out, start = [], 0
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out
