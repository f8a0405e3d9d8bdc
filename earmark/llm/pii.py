"""Personal data: base patterns, and a semi-Markov conditional random field for what they miss.

Base patterns run over the whole text. The field then labels what is left around digits and @ signs:
it scores whole candidate segments by their shape, checks and surroundings, and one dynamic program
chooses boundaries and kinds jointly. Segments are bounded in length. Outside such places no segment
can score, so cutting a text there doesn't change the best labelling.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earmark.llm.jobs import bound_batches, take_columns

KINDS = ("email", "ip", "card", "phone")
# Starts are held to the beginning of a digit run and quantifiers are possessive where that can't
# change a match, so that no text takes more than linear time.
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Segments have at most so many atoms (runs of digits, runs of letters, single other characters).
MAX_ATOMS = 24
ATOM = re.compile(r"[0-9]+|[A-Za-z]+|.", re.DOTALL)
NUMERIC = re.compile(r"[+(]{0,2}[0-9][0-9 ().+-]*")
# Weak labels come from at most so many documents, those with the smallest hashes of their ids.
SAMPLE = 1500
ROUNDS, RATE, PRIOR = 6, 0.1, 0.05

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def _ip_ok(text: str) -> bool:
    # Zeros go first: a part may have any number of them, and `int` takes some thousand digits only.
    return all(len(p) <= 3 and int(p or "0") <= 255 for p in (part.lstrip("0") for part in text.split(".")))


def base_spans(text: str) -> tuple[list[Span], list[Span]]:
    """Spans of the base patterns by kind and start, and the matches that failed their check."""
    out: list[Span] = []
    failed: list[Span] = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append(("email", start, done := m.end()))
        # The next local part can't reach back over this sign.
        at = text.find("@", max(at + 1, done))
    for m in IP.finditer(text):
        (out if _ip_ok(m[0]) else failed).append(("ip", *m.span()))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        (out if 13 <= len(digits) <= 19 and luhn(digits) else failed).append(("card", *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            (out if 9 <= sum(c.isdigit() for c in m[0]) <= 15 else failed).append(("phone", *m.span()))
    return out, failed


def islands(text: str) -> list[tuple[int, int]]:
    """Stretches that could hold a segment: numbers with their separators, and words with an @ sign."""
    marks = [m.span() for m in NUMERIC.finditer(text)]
    at, done = text.find("@"), 0
    while at >= 0:
        a, b = at, at + 1
        while a > done and text[a - 1] in LOCAL:
            a -= 1
        while b < len(text) and (text[b] in LOCAL or text[b] == "@"):
            b += 1
        marks.append((a, b))
        done = b
        at = text.find("@", b)
    out: list[list[int]] = []
    for a, b in sorted(marks):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    # The shortest kind has four digits, or an @ sign.
    return [(a, b) for a, b in out if b - a >= 7 or "@" in text[a:b] if "@" in text[a:b] or sum(c.isdigit() for c in text[a:b]) >= 4]


EMAIL_SHAPE = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+\Z")
IP_SHAPE = re.compile(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}\Z")
CARD_SHAPE = re.compile(r"[0-9]+(?:[ -][0-9]+)*\Z")
PHONE_SHAPE = re.compile(r"\+?(?:[0-9]+|\([0-9]+\))(?:[ .-]{1,2}(?:[0-9]+|\([0-9]+\)))*\Z")
CUES = {
    "email": ("mail", "contact", "write"), "ip": ("ip", "host", "server", "addr"),
    "card": ("card", "visa", "credit", "karte", "carte", "tarjeta"), "phone": ("call", "phone", "tel", "fax", "mobil"),
}


def features(kind: str, text: str, a: int, b: int) -> list[str] | None:
    """Features of a whole segment, or None where the kind is out of the question."""
    s = text[a:b]
    digits = [g for g in re.split(r"[^0-9]+", s) if g]
    n = sum(map(len, digits))
    left, right = text[a - 1 : a], text[b : b + 1]
    if kind == "email":
        if s.count("@") != 1 or not EMAIL_SHAPE.match(s):
            return None
        out = ["tld" if re.search(r"\.[A-Za-z]{2,}\Z", s) else "no_tld", "cut_left" if left and left in LOCAL else "edge_left"]
        out.append("cut_right" if right and (right.isalnum() or right == "-") or text[b : b + 2][:1] == "." and text[b + 1 : b + 2].isalnum() else "edge_right")
    elif kind == "ip":
        if not IP_SHAPE.match(s) or not _ip_ok(s):
            return None
        out = ["shape", "cut_left" if left and (left.isalnum() or left == ".") else "edge_left"]
        out.append("cut_right" if right.isalnum() or right == "." and text[b + 1 : b + 2].isdigit() else "edge_right")
        out.append("padded" if any(len(g) > 1 and g[0] == "0" for g in digits) else "plain")
    elif kind == "card":
        if not 13 <= n <= 19 or not CARD_SHAPE.match(s):
            return None
        groups = tuple(map(len, digits))
        usual = len(groups) == 1 or groups in ((4, 4, 4, 4), (4, 6, 5), (4, 4, 4, 4, 3), (4, 4, 5))
        out = ["luhn" if luhn("".join(digits)) else "no_luhn", "usual" if usual else "odd_groups", "sixteen" if n == 16 else "other_length"]
        out.append("cut_left" if left.isalnum() or left in ("-", "+") else "edge_left")
        out.append("cut_right" if right.isalnum() else "edge_right")
    else:
        if not 9 <= n <= 15 or not PHONE_SHAPE.match(s):
            return None
        groups = tuple(map(len, digits))
        tail = groups[-3:] == (3, 3, 4)
        out = ["plus" if s[0] == "+" else "no_plus", "parens" if "(" in s else "no_parens", "national" if tail else "other_groups"]
        out.append("one_group" if len(groups) == 1 else "grouped")
        out.append("long_group" if max(groups) > 7 else "short_groups")
        out.append("short" if n < 10 else "long" if n > 12 else "usual_length")
        out.append("cut_left" if left.isalnum() or left in ("+", "(", ".", "-") else "edge_left")
        out.append("cut_right" if right.isalnum() or right == ")" else "edge_right")
    before = text[max(0, a - 20) : a].lower()
    if any(c in before for c in CUES[kind]):
        out.append("cue")
    return [f"{kind}:{f}" for f in (*out, "bias")]


# Prior weights: the centre of the field's Gaussian prior, and its weights where nothing can be learned.
PRIOR_WEIGHTS = {
    "email:bias": 4.0, "email:no_tld": -2.0, "email:cut_left": -4.0, "email:cut_right": -4.0,
    "ip:bias": 4.0, "ip:cut_left": -4.0, "ip:cut_right": -4.0, "ip:padded": -1.0,
    "card:bias": -1.0, "card:luhn": 4.0, "card:no_luhn": -6.0, "card:odd_groups": -4.0, "card:sixteen": 1.0,
    "card:cut_left": -4.0, "card:cut_right": -4.0,
    "phone:bias": -2.0, "phone:plus": 3.0, "phone:parens": 1.5, "phone:national": 1.5, "phone:one_group": -2.0,
    "phone:long_group": -4.0, "phone:cut_left": -4.0, "phone:cut_right": -4.0,
    "email:cue": 0.5, "ip:cue": 0.5, "card:cue": 1.0, "phone:cue": 1.5,
}

Candidate = tuple[int, int, str, list[str]]


def candidates(text: str, a: int, b: int) -> tuple[list[int], list[list[Candidate]]]:
    """Ends of the atoms of a stretch, and for each atom the segments that end there.

    Segments are `(first atom, last atom + 1, kind, features)`; they begin and end like a kind can.
    """
    edges = [m.start() for m in ATOM.finditer(text, a, b)] + [b]
    out: list[list[Candidate]] = [[] for _ in edges]
    # Digits and @ signs before each atom rule out most segments before their features are made.
    digits, signs = [0], [0]
    for x, y in zip(edges, edges[1:]):
        digits.append(digits[-1] + (y - x if text[x].isdigit() else 0))
        signs.append(signs[-1] + (text[x] == "@"))
    for j in range(1, len(edges)):
        end = edges[j]
        if not text[end - 1].isalnum() and text[end - 1] not in ")-":
            continue
        for i in range(max(0, j - MAX_ATOMS), j):
            c = text[edges[i]]
            if not (c.isalnum() or c in "+(._%-"):
                continue
            n = digits[j] - digits[i]
            for kind in ("email",) if signs[j] > signs[i] else KINDS[1:]:
                if kind != "email" and not 4 <= n <= 19 or kind == "card" and n < 13 or kind == "phone" and not 9 <= n <= 15:
                    continue
                f = features(kind, text, edges[i], end)
                if f is not None:
                    out[j].append((i, j, kind, f))
    return edges, out


class Field:
    """Weights of the semi-Markov field, with decoding and training by dynamic programming."""

    def __init__(self, weights: dict[str, float] | None = None):
        self.weights = dict(PRIOR_WEIGHTS if weights is None else weights)

    def score(self, names: list[str]) -> float:
        return sum(self.weights.get(f, 0.0) for f in names)

    def decode(self, text: str, a: int, b: int) -> list[Span]:
        """The best segmentation of a stretch: `best[j]` over all last segments that end at atom j."""
        edges, ends = candidates(text, a, b)
        if not any(ends):
            return []
        best, back = [0.0] * len(edges), [None] * len(edges)
        for j in range(1, len(edges)):
            best[j] = best[j - 1]
            for c in ends[j]:
                s = best[c[0]] + self.score(c[3])
                if s > best[j]:
                    best[j], back[j] = s, c
        out, j = [], len(edges) - 1
        while j > 0:
            c = back[j]
            if c is None:
                j -= 1
            else:
                out.append((c[2], edges[c[0]], edges[c[1]]))
                j = c[0]
        return out[::-1]

    def gradient(self, lattice: tuple[list[int], list[list[Candidate]]], gold: set[Span]) -> dict[str, float]:
        """Observed less expected features of one stretch, by forward and backward sums over segmentations."""
        edges, ends = lattice
        n = len(edges)
        fore = [0.0] * n
        scored = [[(c, self.score(c[3])) for c in e] for e in ends]
        add = lambda x, y: max(x, y) + math.log1p(math.exp(-abs(x - y)))
        for j in range(1, n):
            fore[j] = fore[j - 1]
            for c, s in scored[j]:
                fore[j] = add(fore[j], fore[c[0]] + s)
        rear = [-math.inf] * (n - 1) + [0.0]
        for j in range(n - 1, 0, -1):
            rear[j - 1] = add(rear[j - 1], rear[j]) if rear[j - 1] > -math.inf else rear[j]
            for c, s in scored[j]:
                rear[c[0]] = add(rear[c[0]], rear[j] + s) if rear[c[0]] > -math.inf else rear[j] + s
        out: dict[str, float] = {}
        for e in scored:
            for c, s in e:
                p = math.exp(min(0.0, fore[c[0]] + s + rear[c[1]] - fore[-1]))
                delta = ((c[2], edges[c[0]], edges[c[1]]) in gold) - p
                if abs(delta) > 1e-6:
                    for f in c[3]:
                        out[f] = out.get(f, 0.0) + delta
        return out

    def train(self, examples: list[tuple[str, int, int, set[Span]]]) -> "Field":
        """Stochastic ascent on the likelihood of labelled stretches, with a Gaussian prior around the start."""
        start = dict(self.weights)
        lattices = [(candidates(t, a, b), gold) for t, a, b, gold in examples]
        lattices = [x for x in lattices if any(x[0][1])]
        for turn in range(ROUNDS):
            step = RATE / (1 + turn)
            for lattice, gold in lattices:
                for f, g in self.gradient(lattice, gold).items():
                    w = self.weights.get(f, 0.0)
                    self.weights[f] = w + step * (g - PRIOR * (w - start.get(f, 0.0)))
        return self


def weak_examples(texts: list[str]) -> list[tuple[str, int, int, set[Span]]]:
    """Labelled stretches from the base patterns.

    Stretches where no base match failed are labelled by the matches. Two of them side by side, with
    one blank between, teach where one ends and the next begins; the base patterns run over there.
    """
    plain: list[tuple[str, set[Span]]] = []
    for text in texts:
        good, failed = base_spans(text)
        for a, b in islands(text):
            if any(x < b and a < y and y - x > 8 for _, x, y in failed):
                continue
            inside = {(k, x - a, y - a) for k, x, y in good if a <= x and y <= b}
            starts = sorted((x, y) for _, x, y in inside)
            if any(p[1] > q[0] for p, q in zip(starts, starts[1:])):
                continue
            plain.append((text[a:b].rstrip(), inside))
    out = [(f" {s} ", 1, 1 + len(s), {(k, x + 1, y + 1) for k, x, y in g}) for s, g in plain]
    labelled = sorted(((s, g) for s, g in plain if g), key=lambda x: hashlib.md5(x[0].encode()).digest())
    for (s, g), (t, h) in zip(labelled, labelled[1:]):
        shift = len(s) + 2
        gold = {(k, x + 1, y + 1) for k, x, y in g} | {(k, x + shift, y + shift) for k, x, y in h}
        out.append((f" {s} {t} ", 1, shift + len(t), gold))
    return out


def train_field(documents: DataFrame, sample: int = SAMPLE) -> Field:
    """Fit the field on at most `sample` documents with digits or an @ sign, chosen by hash of their id.

    Of these documents the first 20,000 characters are used. All documents are searched afterwards.
    """
    rows = documents.where(F.col("text").rlike("[0-9]{3}|@")).withColumn("h", F.xxhash64("doc_id"))
    # Hashes first, texts then: no more than the sample's texts ever leave the tasks.
    last = rows.select("h").distinct().orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    chosen = rows.where(F.col("h") <= F.lit(last)).select("h", "doc_id", F.expr("substring(text, 1, 20000)").alias("text")) if last is not None else rows.limit(0)
    texts = [r.text for r in sorted(chosen.limit(2 * sample).collect(), key=lambda r: (r.h, r.text))][:sample]
    return Field().train(weak_examples(texts))


def added_spans(text: str, field: Field, base: list[Span]) -> list[Span]:
    """Segments of the field outside the base spans."""
    taken = sorted((x, y) for _, x, y in base)
    out = []
    for a, b in islands(text):
        at = a
        for x, y in [t for t in taken if t[0] < b and a < t[1]] + [(b, b)]:
            if at < x:
                out += field.decode(text, at, x)
            at = max(at, y)
    return out


def _listed(spans: list[Span]) -> str:
    order = {k: i for i, k in enumerate(KINDS)}
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (order[s[0]], s[1], s[2])))


RESULT = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def find_pii(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", field: Field | None = None) -> DataFrame:
    """One row for each row of documents, over whole texts; offsets are code points, ends exclusive.

    `n_*` count the base spans, `base_sha256` digests their list, `spans` lists these and what the
    field adds (`n_added`); added spans never overlap base ones. A null text is empty and has none.
    Repeated rows are read each, a null id stays null, extra columns are ignored, an empty table gives
    an empty one. Without `field` one is trained on a bounded sample of the documents.
    """
    bound_batches(documents.sparkSession)
    docs = take_columns(documents, doc_id=doc_id, text=text).withColumn("doc_id", F.col("doc_id").cast("long"))
    trained = field or train_field(docs)
    weights = trained.weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Field(weights)
        for batch in batches:
            rows = []
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                t = t or ""
                base, _ = base_spans(t)
                more = added_spans(t, model, base)
                counts = [sum(k == kind for k, _, _ in base) for kind in KINDS]
                rows.append((d, *counts, hashlib.sha256(_listed(base).encode()).hexdigest(), _listed(base + more), len(more)))
            if rows:
                types = [pa.int64()] * 5 + [pa.string(), pa.string(), pa.int64()]
                names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return docs.mapInArrow(run, RESULT)
