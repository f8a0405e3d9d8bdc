"""Main text of web pages by a recurrent labeller of blocks.

A page is cut into leaf blocks, the text between block-level tags. A bidirectional LSTM in numpy reads
the blocks of the whole page in order, each as a vector of its tag path, its hashed words and a few
numbers, and says which blocks belong to the article. It is trained on the driver with a bounded sample
of the pages and pages rebuilt from their texts, where the labels are known.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earmark.llm.jobs import bound_batches, take_columns

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
# Never part of the text, whatever stands in it.
UNSEEN = frozenset("script style noscript template head title svg iframe object canvas select option datalist textarea button".split())
# Opening one of these ends an open paragraph.
ENDS_P = frozenset("p div ul ol dl li h1 h2 h3 h4 h5 h6 table section article aside nav header footer main form blockquote pre hr figure address".split())
BUCKETS, SIZE, HIDDEN, NUMBERS = 2048, 12, 16, 6

# Names in tags, classes and ids that tell what an element holds.
BOILERPLATE = frozenset(
    "nav navbar navigation menu footer foot aside sidebar side form ad ads advert advertisement banner sponsor sponsored promo "
    "cookie cookies consent notice alert popup modal comment comments reply replies respond discussion disqus share sharing social "
    "related recommended more newsletter subscribe signup login search breadcrumb breadcrumbs pagination pager widget toolbar "
    "copyright legal masthead topbar tags skip".split()
)
ARTICLE = frozenset("article main content post entry story text body-text".split())


def feature(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "surrogatepass")) % BUCKETS


# Elements whose content is text up to their end tag; a script or style that never ends goes to the end of the page.
RAW = frozenset("script style title textarea iframe noembed noframes".split())
BLANK = r" \t\n\r\f"
GAP = re.compile(f"[{BLANK}/]*+")
TAG = re.compile(f"[^{BLANK}/>]++")
ATTRIBUTE = re.compile(f"=?[^{BLANK}/>=]*+")
EQUALS = re.compile(f"[{BLANK}]*+=[{BLANK}]*+")
UNQUOTED = re.compile(f"[^{BLANK}>]*+")
COMMENT_END = re.compile("--!?>")
# Numbers of references beyond all code points, and zeros before them, of which there may be any count.
ZEROS = re.compile("&#(?:(x)0{6,}(?=[0-9a-f])|0{6,}(?=[0-9]))", re.I)
TOO_LARGE = re.compile("&#(?:[0-9]{8,}|x[0-9a-f]{7,});?", re.I)


def decoded(text: str) -> str:
    """Text with its character references decoded."""
    if "&" not in text:
        return text
    if "&#" in text:
        text = TOO_LARGE.sub("\ufffd", ZEROS.sub(lambda m: "&#x" if m[1] else "&#", text))
    return unescape(text)


def _split(value: str) -> list[str]:
    return [f".{w}" for w in re.split(r"[^a-z0-9]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", value).lower()) if w]


_split_short = lru_cache(maxsize=4096)(_split)


def _names(tag: str, attrs: list[tuple[str, str | None]]) -> list[str]:
    out = [tag]
    for key, value in attrs:
        if key in ("class", "id", "role") and value:
            out += _split_short(value) if len(value) < 200 else _split(value)
    return out


class Path:
    """Names of the containers around a block, as a chain: each link adds the names that no link above has.

    So a page's paths take memory for its tags, however deep they are.
    """

    __slots__ = ("above", "names", "own", "count", "article", "boilerplate")

    def __init__(self, above: "Path | None", names: list[str], own: list[int]):
        self.above, self.names, self.own = above, names, own
        bare = {n.lstrip(".") for n in names}
        self.count = len(own) + (above.count if above else 0)
        self.article = bool(bare & ARTICLE) or above is not None and above.article
        self.boilerplate = bool(bare & BOILERPLATE) or above is not None and above.boilerplate


def path_of(names: tuple[str, ...]) -> Path | None:
    """A path of one link."""
    return Path(None, list(names), [feature(n) for n in names]) if names else None


class Block:
    __slots__ = ("text", "within", "linked")

    def __init__(self, text: str, path: Path | tuple[str, ...] | None, linked: int):
        self.text, self.within, self.linked = text, path_of(path) if isinstance(path, tuple) else path, linked

    @property
    def path(self) -> tuple[str, ...]:
        out, link = [], self.within
        while link:
            out[:0] = link.names
            link = link.above
        return tuple(out)


class BlockParser:
    """Cuts a page into blocks; unclosed and stray tags are taken as browsers take them, roughly.

    Reads any text in one pass: a tag, a comment or a declaration that never ends goes to the end of the page,
    and an attribute's quote that never ends is no quote.
    """

    def __init__(self) -> None:
        self.blocks: list[Block] = []
        self.stack: list[tuple[str, Path | None]] = []
        self.open: dict[str, int] = {}
        self.held: set[int] = set()
        self.unseen = self.links = self.linked = 0
        self.parts: list[str] = []
        self.path: Path | None = None
        self.absent: set[str] = set()

    def feed(self, page: str) -> None:
        """Read a whole page."""
        at, size = 0, len(page)
        while at < size:
            sign = page.find("<", at)
            if sign < 0:
                sign = size
            if sign > at:
                self.handle_data(page[at:sign])
            after = page[sign + 1 : sign + 2]
            if sign == size:
                return
            if after.isascii() and after.isalpha():
                at = self._start(page, sign + 1)
            elif after and after in "/!?":
                at = self._mark(page, sign, after)
            else:
                self.handle_data("<")
                at = sign + 1

    def _mark(self, page: str, sign: int, kind: str) -> int:
        """An end tag, comment or declaration; returns where it ends."""
        if page.startswith("<!--", sign):
            if page.startswith((">", "->"), sign + 4):
                return page.index(">", sign) + 1
            m = COMMENT_END.search(page, sign + 4)
            return m.end() if m else len(page)
        end = page.find(">", sign)
        name = page[sign + 2 : sign + 3]
        if end >= 0 and kind == "/" and name.isascii() and name.isalpha():
            self.handle_endtag(TAG.match(page, sign + 2)[0].lower())
        return end + 1 if end >= 0 else len(page)

    def _start(self, page: str, at: int) -> int:
        """A start tag with its attributes; returns where it, or its raw content, ends."""
        m = TAG.match(page, at)
        tag, at, attrs, closed = m[0].lower(), m.end(), [], False
        while True:
            gap = GAP.match(page, at).end()
            closed = gap > at and page[gap - 1] == "/"
            at = gap
            if at >= len(page):
                return at
            if page[at] == ">":
                break
            m = ATTRIBUTE.match(page, at)
            key, at, value = m[0].lower(), m.end(), None
            m = EQUALS.match(page, at)
            if m:
                at = m.end()
                quote = page[at : at + 1]
                end = page.find(quote, at + 1) if quote and quote in "\"'" and quote not in self.absent else -1
                if end >= 0:
                    value, at = page[at + 1 : end], end + 1
                else:
                    if quote and quote in "\"'":
                        self.absent.add(quote)
                    m = UNQUOTED.match(page, at)
                    value, at = m[0], m.end()
            attrs.append((key, decoded(value) if value else value))
        at += 1
        if closed:
            self.handle_startendtag(tag, attrs)
            return at
        self.handle_starttag(tag, attrs)
        if tag in RAW and tag not in self.absent:
            end = re.compile(f"</{tag}(?=[{BLANK}/>])", re.I | re.A).search(page, at)
            if end:
                self.handle_data(page[at : end.start()])
                return end.start()
            self.absent.add(tag)
            if tag in ("script", "style"):
                return len(page)
        return at

    def close(self) -> None:
        self.flush()

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                self.blocks.append(Block(text, self.path, min(self.linked, len(text))))
            self.parts, self.linked = [], 0

    def _pop(self) -> None:
        tag, path = self.stack.pop()
        self.open[tag] -= 1
        self.unseen -= tag in UNSEEN
        self.links -= tag == "a"
        self.path = self.stack[-1][1] if self.stack else None
        if path is not self.path:
            self.held.difference_update(path.own)

    def _close(self, tag: str) -> None:
        while self.stack and self.open.get(tag, 0):
            last = self.stack[-1][0]
            self._pop()
            if last == tag:
                return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "body" and self.open.get("head", 0):
            self._close("head")
        if tag not in INLINE:
            self.flush()
            if tag in ENDS_P and self.open.get("p", 0):
                self._close("p")
            elif tag in ("li", "dt", "dd", "tr", "td", "th", "option") and self.stack and self.stack[-1][0] == tag:
                self._pop()
        if tag in VOID:
            return
        path = self.path
        if tag not in INLINE:
            names = {k: n for n in _names(tag, attrs) if (k := feature(n)) not in self.held}
            if names:
                path = Path(path, list(names.values()), list(names))
                self.held.update(names)
        self.stack.append((tag, path))
        self.open[tag] = self.open.get(tag, 0) + 1
        self.unseen += tag in UNSEEN
        self.links += tag == "a"
        self.path = path

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in ("script", "style"):
            self._close(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag not in INLINE:
            self.flush()
        self._close(tag)

    def handle_data(self, data: str) -> None:
        if not self.unseen:
            data = decoded(data)
            self.parts.append(data)
            if self.links:
                self.linked += len(data)


def blocks(html: str | None) -> list[Block]:
    """The leaf blocks of a page, in order."""
    parser = BlockParser()
    parser.feed(html or "")
    parser.close()
    return parser.blocks


class Encoded:
    """Blocks as arrays: links of their paths with the features each adds, runs of word features, and numbers.

    Links of one level follow the links above them, so sums over paths go down, and gradients up, level
    by level: the work grows with links, not with the length of paths.
    """

    def __init__(self, pages: list[list[Block]]):
        place: dict[Path | None, int] = {}
        own, n_own, above, depth, count = [], [], [], [], []
        words, n_words, numbers, at = [], [], [], []
        known: dict[str, int] = {}
        for page in pages:
            for i, b in enumerate(page):
                chain, link = [], b.within
                while link not in place:
                    chain.append(link)
                    link = link.above if link else None
                    if link is None:
                        break
                for link in reversed(chain):
                    place[link] = len(own)
                    over = place[link.above] if link and link.above else -1
                    own.append(link.own if link else [0])
                    n_own.append(len(own[-1]))
                    above.append(over)
                    depth.append(depth[over] + 1 if over >= 0 else 0)
                    count.append(link.count if link else 1)
                at.append(place[b.within])
                split = b.text.lower().split()
                got = [known[w] if w in known else known.setdefault(w, feature(f"w:{w.strip('.,;:!?()')}")) for w in split]
                words += got
                n_words.append(len(got))
                stops = sum(b.text.count(c) for c in ".,;!?")
                numbers.append((np.log1p(len(b.text)) / 5, np.log1p(len(split)) / 4, b.linked / len(b.text), min(1.0, 10 * stops / len(b.text)), i / len(page), 1.0))
        self.own, self.n_own = np.array([x for run in own for x in run], np.int64), np.array(n_own, np.int64)
        self.above, self.count, self.at = np.array(above, np.int64), np.array(count, np.float32), np.array(at, np.int64)
        order = np.argsort(depth, kind="stable")
        self.levels = np.split(order, np.flatnonzero(np.diff(np.array(depth)[order])) + 1)[1:] if depth else []
        self.words, self.n_words = np.array(words, np.int64), np.array(n_words, np.int64)
        self.numbers = np.array(numbers, np.float32).reshape(-1, NUMBERS)
        self.lengths = np.array([len(p) for p in pages])

    def path_means(self, table: np.ndarray) -> np.ndarray:
        """Mean of the rows of `table` for the features of each block's path."""
        total = np.add.reduceat(table[self.own], np.cumsum(self.n_own) - self.n_own, axis=0)
        for level in self.levels:
            total[level] += total[self.above[level]]
        return total[self.at] / self.count[self.at, None]

    def path_gradient(self, d: np.ndarray) -> np.ndarray:
        """Gradient of the table from that of the means."""
        d = d / self.count[self.at, None]
        out = np.zeros((BUCKETS, d.shape[1]))
        for k in range(d.shape[1]):
            total = np.bincount(self.at, d[:, k], len(self.above))
            for level in reversed(self.levels):
                np.add.at(total, self.above[level], total[level])
            out[:, k] = np.bincount(self.own, np.repeat(total, self.n_own), BUCKETS)
        return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """Embeddings of path and word features, an LSTM in each direction, and one logit a block."""

    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        d = 2 * SIZE + NUMBERS
        draw = lambda *shape, s: (rng.normal(size=shape) * s).astype(np.float32)
        self.w = {"path": draw(BUCKETS, SIZE, s=0.5), "word": draw(BUCKETS, SIZE, s=0.1), "out": draw(2 * HIDDEN + d, s=0.1), "bias": np.zeros(1, np.float32)}
        for side in "fb":
            self.w[f"in_{side}"] = draw(d, 4 * HIDDEN, s=0.2)
            self.w[f"re_{side}"] = draw(HIDDEN, 4 * HIDDEN, s=0.2)
            self.w[f"b_{side}"] = np.repeat(np.array([0, 1, 0, 0], np.float32), HIDDEN)

    def vectors(self, e: Encoded) -> np.ndarray:
        mean = lambda table, ids, n: np.add.reduceat(table[ids], np.cumsum(n) - n, axis=0) / n[:, None].astype(np.float32)
        return np.hstack([e.path_means(self.w["path"]), mean(self.w["word"], e.words, e.n_words), e.numbers]).astype(np.float32)

    def run(self, x: np.ndarray, mask: np.ndarray, side: str, keep: bool = False) -> tuple[np.ndarray, list]:
        """Hidden states of one direction over (step, page) with what training needs; masked steps keep the state."""
        steps, pages, _ = x.shape
        pre = x @ self.w[f"in_{side}"] + self.w[f"b_{side}"]
        h, c = np.zeros((pages, HIDDEN), np.float32), np.zeros((pages, HIDDEN), np.float32)
        out, kept = np.zeros((steps, pages, HIDDEN), np.float32), []
        for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
            z = pre[t] + h @ self.w[f"re_{side}"]
            gates = _sigmoid(z[:, : 3 * HIDDEN])
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            g = np.tanh(z[:, 3 * HIDDEN :])
            m = mask[t][:, None]
            c2 = m * (f * c + i * g) + (1 - m) * c
            th = np.tanh(c2)
            h2 = m * (o * th) + (1 - m) * h
            if keep:
                kept.append((t, h, c, i, f, o, g, th, m))
            h, c = h2, c2
            out[t] = h
        return out, kept

    def logits(self, x: np.ndarray, mask: np.ndarray, keep: list | None = None) -> np.ndarray:
        hf, kf = self.run(x, mask, "f", keep is not None)
        hb, kb = self.run(x, mask, "b", keep is not None)
        full = np.concatenate([hf, hb, x], axis=2)
        if keep is not None:
            keep += [full, kf, kb]
        return full @ self.w["out"] + self.w["bias"]

    def _back(self, x: np.ndarray, dh: np.ndarray, kept: list, side: str, grad: dict) -> np.ndarray:
        dx_pre = np.zeros((x.shape[0], x.shape[1], 4 * HIDDEN), np.float32)
        d_h, d_c = np.zeros_like(dh[0]), np.zeros_like(dh[0])
        for t, h, c, i, f, o, g, th, m in reversed(kept):
            d_h = d_h + dh[t]
            do = d_h * m * th
            dc = d_c + d_h * m * o * (1 - th * th)
            dz = np.concatenate([m * dc * g * i * (1 - i), m * dc * c * f * (1 - f), do * o * (1 - o), m * dc * i * (1 - g * g)], axis=1)
            dx_pre[t] = dz
            grad[f"re_{side}"] += h.T @ dz
            d_h = dz @ self.w[f"re_{side}"].T + d_h * (1 - m)
            d_c = m * dc * f + (1 - m) * dc
        flat = dx_pre.reshape(-1, 4 * HIDDEN)
        grad[f"in_{side}"] += x.reshape(-1, x.shape[2]).T @ flat
        grad[f"b_{side}"] += flat.sum(axis=0)
        return dx_pre @ self.w[f"in_{side}"].T

    def gradient(self, e: Encoded, labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy of some pages and its gradient."""
        v = self.vectors(e)
        x, mask, place = _padded(v, e.lengths)
        keep: list = []
        p = _sigmoid(self.logits(x, mask, keep))
        full, kf, kb = keep
        y = np.zeros_like(mask)
        y[place] = labels
        n = max(1, len(labels))
        d = (p - y) * mask / n
        grad = {k: np.zeros_like(w) for k, w in self.w.items()}
        grad["out"] += np.tensordot(d, full, axes=([0, 1], [0, 1]))
        grad["bias"] += d.sum()
        dfull = d[:, :, None] * self.w["out"]
        dx = dfull[:, :, 2 * HIDDEN :] + self._back(x, dfull[:, :, :HIDDEN], kf, "f", grad) + self._back(x, dfull[:, :, HIDDEN : 2 * HIDDEN], kb, "b", grad)
        dv = dx[place]
        grad["path"] += e.path_gradient(dv[:, :SIZE])
        each = np.repeat(dv[:, SIZE : 2 * SIZE] / e.n_words[:, None], e.n_words, axis=0)
        for k in range(SIZE):
            grad["word"][:, k] += np.bincount(e.words, each[:, k], BUCKETS)
        q = p[place]
        loss = -np.mean(np.log(np.where(labels > 0, q, 1 - q) + 1e-9))
        return float(loss), grad

    def fit(self, pages: list[list[Block]], labels: list[np.ndarray], rounds: int = 8, batch: int = 32, rate: float = 0.02, seed: int = 5) -> "Labeller":
        """Adam over shuffled batches of pages."""
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(w) for k, w in self.w.items()}
        second = {k: np.zeros_like(w) for k, w in self.w.items()}
        step = 0
        for turn in range(rounds):
            order = rng.permutation(len(pages))
            for lo in range(0, len(order), batch):
                some = order[lo : lo + batch]
                _, grad = self.gradient(Encoded([pages[i] for i in some]), np.concatenate([labels[i] for i in some]).astype(np.float32))
                step += 1
                for k, g in grad.items():
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.99 * second[k] + 0.01 * g * g
                    self.w[k] -= (rate / (1 + turn / 2)) * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)
        return self

    def label(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """True for the blocks of each page that belong to the article; pages of like length run together."""
        out = [np.zeros(0, bool)] * len(pages)
        order = sorted((i for i in range(len(pages)) if pages[i]), key=lambda i: len(pages[i]))
        while order:
            take = 1
            while take < min(len(order), 128) and take * len(pages[order[take]]) < 50_000:
                take += 1
            some, order = order[:take], order[take:]
            e = Encoded([pages[i] for i in some])
            x, mask, place = _padded(self.vectors(e), e.lengths)
            flat = self.logits(x, mask)[place] > 0
            for i, part in zip(some, np.split(flat, np.cumsum(e.lengths)[:-1])):
                out[i] = part
        return out


def _padded(v: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """Vectors by (step, page), the mask of real steps, and where each block went."""
    page = np.repeat(np.arange(len(lengths)), lengths)
    step = np.arange(len(v)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    x = np.zeros((int(lengths.max()), len(lengths), v.shape[1]), np.float32)
    mask = np.zeros(x.shape[:2], np.float32)
    x[step, page], mask[step, page] = v, 1
    return x, mask, (step, page)


def weak_labels(page: list[Block]) -> np.ndarray | None:
    """Labels from telling names in the paths, or None for a page without an article element."""
    inside = np.array([b.within is not None and b.within.article for b in page])
    if not inside.any():
        return None
    return inside & ~np.array([b.within is not None and b.within.boilerplate for b in page])


def rebuilt(rng: np.random.Generator, prose: list[str], short: list[str]) -> str:
    """A page made of given texts in one of many layouts; elements of the article carry data-main.

    Containers have telling tags or names, sometimes neither; comments and sidebars hold prose too, so
    the labeller has to use names, neighbours and order together.
    """
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    chance = lambda p: rng.random() < p
    noise = lambda: "".join(pick("abcdefghijklmnop") for _ in range(5))

    def box(names: list[str], inner: str, tags: tuple[str, ...] = ("div", "section", "div")) -> str:
        tag, name = pick(tags), pick(names)
        key = pick(("class", "id", "class"))
        extra = f" {noise()}" if chance(0.3) and key == "class" else ""
        return f'<{tag} {key}="{name}{extra}">{inner}</{tag}>'

    para = lambda main: f"<p{' data-main' if main else ''}>{pick(prose)}</p>"
    links = lambda n: "<ul>" + "".join(f'<li><a href="/x">{pick(short)}</a></li>' for _ in range(n)) + "</ul>"
    out = []
    if chance(0.4):
        out.append(box(["cookie-notice", "cookies", "consent", "notice", "alert"], f"<p>{pick(['We use cookies', pick(prose), 'Accept all cookies'])}</p>"))
    if chance(0.5):
        out.append(f"<header><div>{pick(short)}</div>{links(3) if chance(0.5) else ''}</header>")
    if chance(0.85):
        out.append(f"<nav>{links(int(rng.integers(2, 8)))}</nav>" if chance(0.6) else box(["menu", "nav", "navbar", "topbar", "navigation"], links(int(rng.integers(2, 8)))))
    if chance(0.3):
        out.append(box(["breadcrumb", "breadcrumbs"], f'<a href="/">{pick(short)}</a> &gt; {pick(short)}'))
    advert = lambda: box(["ad", "ads", "advert", "advertisement", "sponsored", "banner", "promo"], pick([pick(prose), f"<p>{pick(prose)}</p>", pick(short)]), ("div", "div", "aside"))
    side = lambda: f"<aside>{links(3) if chance(0.5) else ''}<p>{pick(prose)}</p></aside>" if chance(0.5) else box(["sidebar", "side", "widget", "related"], f"<h3>{pick(short)}</h3>{links(3)}<p>{pick(prose)}</p>")
    signup = lambda: f"<form><p>{pick(prose)}</p><label>{pick(short)}</label></form>" if chance(0.6) else box(["newsletter", "subscribe", "signup", "login", "search"], f"<p>{pick(prose)}</p>")
    if chance(0.4):
        out.append(advert())
    if chance(0.2):
        out.append(side())
    body = f"<h1 data-main>{pick(short)}</h1>" if chance(0.85) else ""
    for _ in range(int(rng.integers(1, 9))):
        body += para(True)
        if chance(0.08):
            body += pick((advert, side, signup))()
        if chance(0.1):
            body += f"<h2 data-main>{pick(short)}</h2>"
        if chance(0.07):
            body += "<ul>" + "".join(f"<li data-main>{pick(short)} {pick(short)}</li>" for _ in range(3)) + "</ul>"
        if chance(0.07):
            body += f"<blockquote data-main>{pick(prose)}</blockquote>"
    if chance(0.15):
        body += box(["share", "social", "tags"], links(3))
    comments = box(["comments", "comment", "discussion", "replies", "respond"], f"<h3>{pick(short)}</h3>" + "".join(box(["comment", "reply"], f"<p>{pick(prose)}</p>", ("div", "li")) for _ in range(int(rng.integers(1, 5)))))
    if chance(0.1):
        body += comments
    kind = rng.random()
    out.append(f"<article>{body}</article>" if kind < 0.5 else f"<main>{body}</main>" if kind < 0.65 else box(["content", "post", "entry-content", "story", "article-body", "post-content"], body) if kind < 0.9 else f'<div class="{noise()}">{body}</div>')
    for p, part in ((0.4, comments), (0.3, side()), (0.25, advert()), (0.3, signup()), (0.2, box(["related", "recommended", "more"], links(4)))):
        if chance(p):
            out.append(part)
    out.append(f"<footer>&copy; {pick(short)} &middot; {pick(prose)}</footer>" if chance(0.7) else box(["footer", "foot", "copyright", "legal"], f"<p>{pick(prose)}</p>{links(2)}"))
    return "<html><body>" + "".join(out) + "</body></html>"


class _Marked(BlockParser):
    """Blocks of a rebuilt page with their labels."""

    def __init__(self) -> None:
        super().__init__()
        self.main, self.labels = False, []

    def flush(self) -> None:
        before = len(self.blocks)
        super().flush()
        self.labels += [self.main] * (len(self.blocks) - before)

    def handle_starttag(self, tag, attrs):
        super().handle_starttag(tag, [a for a in attrs if a[0] != "data-main"])
        if tag not in INLINE:
            self.main = any(a[0] == "data-main" for a in attrs)

    def handle_endtag(self, tag):
        super().handle_endtag(tag)
        if tag not in INLINE:
            self.main = False


# Pages of the sample, characters of each at most (longer ones are labelled, not learned from), rebuilt pages.
SAMPLE_PAGES, SAMPLE_CHARS, REBUILT_PAGES = 160, 200_000, 480


def train_labeller(pages: DataFrame, sample: int = SAMPLE_PAGES, made: int = REBUILT_PAGES, seed: int = 3, longest: int = SAMPLE_CHARS) -> Labeller:
    """Fit on at most `sample` pages below `longest` characters, those with the smallest hashes of their ids, and `made` rebuilt ones.

    So at most `sample * longest` characters come to the driver. All pages are labelled afterwards.
    """
    rows = pages.where(F.length("html") < longest).withColumn("h", F.xxhash64("page_id"))
    # Hashes first, pages then: no more than the sample's pages ever leave the tasks.
    last = rows.select("h").distinct().orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    chosen = rows.where(F.col("h") <= F.lit(last)).limit(2 * sample).collect() if last is not None else []
    cut = [blocks(r.html) for r in sorted(chosen, key=lambda r: (r.h, r.html))[:sample]]
    train, labels = [], []
    for page in cut:
        y = weak_labels(page) if page else None
        if y is not None:
            train.append(page)
            labels.append(y)
    texts = [b.text for page in cut for b in page]
    prose = [t for t in texts if len(t) > 60] or ["A longer text, with some words in it. And one more sentence."]
    short = [t for t in texts if len(t) <= 60] or ["Home", "About us"]
    rng = np.random.default_rng(seed)
    for _ in range(made):
        parser = _Marked()
        parser.feed(rebuilt(rng, prose, short))
        parser.close()
        train.append(parser.blocks)
        labels.append(np.array(parser.labels))
    return Labeller().fit(train, labels)


RESULT = "page_id long, url string, text string, n_chars long, n_blocks long, n_kept long"


def extract_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", labeller: Labeller | None = None) -> DataFrame:
    """`(page_id, url, text, n_chars, n_blocks, n_kept)`: one row for each row of pages.

    Character references are decoded, white space inside a block becomes one blank, and the blocks of
    the article are joined in page order by one blank; nothing else is dropped or cut. Null and empty
    pages, and pages without an article, have an empty text. Repeated rows are read each; null ids and
    urls stay null. An empty table gives an empty one.
    """
    bound_batches(pages.sparkSession)
    taken = take_columns(pages, page_id=page_id, url=url, html=html).withColumn("page_id", F.col("page_id").cast("long"))
    model = labeller or train_labeller(taken)
    shared = pages.sparkSession.sparkContext.broadcast(model.w)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Labeller()
        net.w = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                cut = [blocks(h) for h in part.column(2).to_pylist()]
                kept = net.label(cut)
                texts = [" ".join(b.text for b, k in zip(page, keep) if k) for page, keep in zip(cut, kept)]
                yield pa.record_batch(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), *(pa.array(x, pa.int64()) for x in ([len(t) for t in texts], [len(p) for p in cut], [int(k.sum()) for k in kept]))],
                    names=["page_id", "url", "text", "n_chars", "n_blocks", "n_kept"],
                )

    return taken.mapInArrow(run, RESULT)
