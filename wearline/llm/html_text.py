"""Main text of web pages by a recurrent block labeller.

A page becomes a sequence of leaf blocks, runs of text between block-level tags.
A bidirectional LSTM in numpy reads, for each block, a hashed vector of its tag
path (elements, classes and ids from the root down), hashed words and a few
measures, and so labels every block knowing the whole document before and after
it.  Blocks that it takes for main text are joined in page order.

The labeller is trained here, on pages that a seeded generator lays out with
known labels: articles in many kinds of containers among menus, headers, footers,
sidebars, notices, adverts, forms and reader comments.
"""

from __future__ import annotations

import collections
import functools
import html
import re
import zlib
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements that end a block of text where they begin and end.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button canvas caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html iframe legend li main menu nav ol optgroup option p pre "
    "section select summary table tbody td textarea tfoot th thead tr ul".split()
)
#: Elements without an end tag.
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not text of the page.
SILENT_TAGS = frozenset("script style title noscript template svg iframe object textarea head".split())
#: An open element of the second kind ends where one of the first kind begins.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

TAG_DIM, LAST_DIM, NAME_DIM, WORD_DIM, MEASURES = 88, 16, 128, 32, 6
PATH_DIM = TAG_DIM + LAST_DIM + NAME_DIM
INPUT_DIM = PATH_DIM + WORD_DIM + MEASURES
HIDDEN = 16
#: Pages of the generated training set (bounded, and no page of the corpus).
TRAIN_PAGES, EPOCHS, SEED = 480, 10, 7

_TOKEN = re.compile(r"""<!--.*?(?:-->|$)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<[!?][^>]*+>|[^<]++|<""", re.S)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PART = re.compile(r"[a-z]+")


#: Known elements have a place each; others share the last eight.
_TAG_PLACE = {name: i for i, name in enumerate(sorted(BLOCK_TAGS | {"html", "a", "b", "i", "em", "strong", "span", "small"}))}
assert len(_TAG_PLACE) <= TAG_DIM - 8


class Path(NamedTuple):
    """A tag path as the set of its features, so that a step costs the same at any depth."""

    seen: int = 0  # bits of elements and names
    last: int = 0  # bit of the last step
    before: int = 0  # and of the one before it
    linked: bool = False  # below an element ``a`` without names


@functools.lru_cache(maxsize=8192)
def _bits(name: str, names: str) -> tuple[int, int]:
    place = _TAG_PLACE.get(name, TAG_DIM - 1 - zlib.crc32(name.encode()) % 8)
    seen = 1 << place
    for part in _PART.findall(names):
        seen |= 1 << TAG_DIM + LAST_DIM + zlib.crc32(part.encode()) % NAME_DIM
    return seen, 1 << TAG_DIM + zlib.crc32(b"last " + name.encode()) % LAST_DIM


def step(path: Path, name: str, names: str = "") -> Path:
    """``path`` and one element more."""
    seen, last = _bits(name, names)
    return Path(path.seen | seen, last, path.last, path.linked or name == "a" and not names)


class Block(NamedTuple):
    path: Path
    text: str
    linked: int


def blocks_of(page: str) -> list[Block]:
    """The leaf blocks of a page: tag path, text with references decoded and white space made single, linked characters.

    Time grows with the page's length, however deep its elements nest.
    """
    out: list[Block] = []
    stack: list[tuple[str, Path]] = []
    opened: collections.Counter[str] = collections.Counter()
    path = Path()
    parts: list[str] = []
    linked, links, at, size = 0, 0, 0, len(page)

    def pop() -> str:
        nonlocal links
        top, _ = stack.pop()
        opened[top] -= 1
        links -= top == "a"
        return top

    def close() -> None:
        nonlocal parts, linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(path, text, min(linked, len(text))))
            parts, linked = [], 0

    while at < size:
        m = _TOKEN.match(page, at)
        at = m.end()
        name = m[2]
        if name is None:
            raw = m[0]
            if raw[0] != "<" or raw == "<":
                text = html.unescape(raw) if "&" in raw else raw
                parts.append(text)
                if links:
                    linked += len(text)
            continue
        name = name.lower()
        if m[1]:
            if opened[name]:
                if name in BLOCK_TAGS:
                    close()
                while True:
                    top = pop()
                    if top in BLOCK_TAGS and top != name:
                        close()
                    if top == name:
                        break
                path = stack[-1][1] if stack else Path()
            elif name in BLOCK_TAGS:
                close()
            continue
        if name in SILENT_TAGS:
            if name in BLOCK_TAGS:
                close()
            if not m[3].endswith("/"):
                end = re.compile(f"</{re.escape(name)}\\b[^>]*>" if name != "head" else r"</head\b[^>]*>|(?=<body\b)", re.I).search(page, at)
                at = end.end() if end else size
            continue
        if name in VOID_TAGS:
            if name in BLOCK_TAGS:
                close()
            else:
                parts.append(" " if name == "br" else "")
            continue
        if name in BLOCK_TAGS:
            close()
            ends = _ENDS.get(name, ())
            while stack and (stack[-1][0] == "p" or stack[-1][0] not in BLOCK_TAGS and opened["p"] or stack[-1][0] in ends):
                pop()
        if not m[3].endswith("/"):
            names = " ".join(a or b or c for a, b, c in _NAMES.findall(m[3])) if "=" in m[3] else ""
            path = step(stack[-1][1] if stack else Path(), name, names.lower())
            stack.append((name, path))
            opened[name] += 1
            links += name == "a"
    close()
    return out


@functools.lru_cache(maxsize=8192)
def _path_vector(bits: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(bits.to_bytes(-(-PATH_DIM // 8), "little"), np.uint8), bitorder="little")[:PATH_DIM].astype(np.float32)


def features(blocks: list[Block]) -> np.ndarray:
    """(blocks, INPUT_DIM) of a page."""
    out = np.zeros((len(blocks), INPUT_DIM), np.float32)
    for i, (path, text, linked) in enumerate(blocks):
        words = text.lower().encode("utf-8", "surrogatepass").translate(None, b".,;:!?").split()
        n = max(1, len(words))
        out[i, :PATH_DIM] = _path_vector(path.seen | path.last | path.before)
        out[i, PATH_DIM : PATH_DIM + WORD_DIM] = np.sqrt(np.bincount(np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % WORD_DIM, minlength=WORD_DIM) / n)
        out[i, PATH_DIM + WORD_DIM :] = (np.log1p(n) / 4, linked / len(text), text[-1] in ".!?\"'", np.log1p(len(text)) / 6, n < 4, path.linked)
    return out


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


class BiLSTM:
    """Forward and backward LSTM over padded sequences and a logistic output for each step."""

    def __init__(self, seed: int = SEED, inputs: int = INPUT_DIM, hidden: int = HIDDEN):
        rng = np.random.default_rng(seed)
        self.hidden = hidden
        self.p: dict[str, np.ndarray] = {}
        for d in "fb":
            self.p["W" + d] = (rng.standard_normal((inputs, 4 * hidden)) / np.sqrt(inputs) * 2).astype(np.float32)
            self.p["U" + d] = (rng.standard_normal((hidden, 4 * hidden)) / np.sqrt(hidden)).astype(np.float32)
            bias = np.zeros(4 * hidden, np.float32)
            bias[hidden : 2 * hidden] = 1  # remember at first
            self.p["c" + d] = bias
        self.p["V"] = (rng.standard_normal((2 * hidden, 1)) / np.sqrt(2 * hidden)).astype(np.float32)
        self.p["v"] = np.zeros(1, np.float32)

    def project(self, x, d):
        """What the inputs add to the gates of one direction."""
        return x @ self.p["W" + d] + self.p["c" + d]

    def _run(self, z, mask, d, keep):
        """States (time, batch, hidden) of one direction; masked steps leave the state as it is."""
        steps, batch, _ = z.shape
        k, u = self.hidden, self.p["U" + d]
        h, c = np.zeros((batch, k), np.float32), np.zeros((batch, k), np.float32)
        out, tape = np.zeros((steps, batch, k), np.float32), {}
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            a = z[t] + h @ u
            gates = _sigmoid(a[:, : 3 * k])
            i, f, o, g = gates[:, :k], gates[:, k : 2 * k], gates[:, 2 * k :], np.tanh(a[:, 3 * k :])
            m = mask[t][:, None]
            if keep:
                tape[t] = (h, c, i, f, o, g)
            new = f * c + i * g
            c = np.where(m, new, c)
            h = np.where(m, o * np.tanh(c), h)
            out[t] = h
        return out, tape

    def predict(self, z, mask):
        """Probability of main text for every step, from the projected inputs (time, batch, gates) of both directions."""
        both = np.concatenate([self._run(z[d], mask, d, False)[0] for d in "fb"], axis=2)
        return _sigmoid((both @ self.p["V"])[:, :, 0] + self.p["v"])

    def gradient(self, x, mask, y):
        """Mean cross-entropy of the unmasked steps and its gradient."""
        k, tapes, states = self.hidden, {}, {}
        for d in "fb":
            states[d], tapes[d] = self._run(self.project(x, d), mask, d, True)
        both = np.concatenate([states["f"], states["b"]], axis=2)
        p = _sigmoid((both @ self.p["V"])[:, :, 0] + self.p["v"])
        n = mask.sum()
        loss = -(mask * (y * np.log(p + 1e-7) + (1 - y) * np.log(1 - p + 1e-7))).sum() / n
        error = (mask * (p - y) / n).astype(np.float32)
        grads = {"V": np.einsum("tbh,tb->h", both, error)[:, None], "v": np.array([error.sum()], np.float32)}
        into = error[:, :, None] * self.p["V"][:, 0]
        for d, part in (("f", into[:, :, :k]), ("b", into[:, :, k:])):
            steps = range(len(x))
            dz = np.zeros((len(x), x.shape[1], 4 * k), np.float32)
            du = np.zeros_like(self.p["U" + d])
            dh, dc = np.zeros_like(part[0]), np.zeros_like(part[0])
            for t in reversed(steps) if d == "f" else steps:
                before, c0, i, f, o, g = tapes[d][t]
                m = mask[t][:, None]
                dh = dh + part[t]
                c = f * c0 + i * g
                th = np.tanh(c)
                dn = np.where(m, dc + dh * o * (1 - th * th), 0)
                da = np.concatenate([dn * g * i * (1 - i), dn * c0 * f * (1 - f), np.where(m, dh * th * o * (1 - o), 0), dn * i * (1 - g * g)], axis=1)
                dz[t] = da
                du += before.T @ da
                dh = np.where(m, da @ self.p["U" + d].T, dh)
                dc = np.where(m, dn * f, dc)
            grads["W" + d] = np.einsum("tbi,tbk->ik", x, dz, optimize=True)
            grads["U" + d], grads["c" + d] = du, dz.sum(axis=(0, 1))
        return float(loss), grads


def padded(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    longest = max(len(s) for s in sequences)
    x, mask = np.zeros((longest, len(sequences), sequences[0].shape[1]), np.float32), np.zeros((longest, len(sequences)), bool)
    for b, s in enumerate(sequences):
        x[: len(s), b], mask[: len(s), b] = s, True
    return x, mask


# ---- generated training pages

_MAIN_BOXES = (
    "<article>|</article>", "<article class='post hentry'>|</article>", "<main>|</main>", "<main><article>|</article></main>", "<div class='content'>|</div>", "<div id='content'><div class='post'>|</div></div>",
    "<div class='article-body'>|</div>", "<div class='entry-content'>|</div>", "<section class='story'>|</section>", "<div id='main'><div class='text'>|</div></div>", "<div>|</div>", "<section>|</section>", "<div class='page'><div class='col'>|</div></div>", "|",
)
_ASIDE_BOXES = (
    "<aside>|</aside>", "<div class='ad'>|</div>", "<div class='ads banner'>|</div>", "<div class='advert'>|</div>", "<div class='advertisement'>|</div>", "<div class='sponsored promo'>|</div>", "<div class='sidebar'>|</div>", "<div id='sidebar'>|</div>", "<aside class='sidebar widget'>|</aside>",
    "<div class='notice'>|</div>", "<div class='cookie-notice'>|</div>", "<div id='cookie-banner' role='dialog'>|</div>", "<div class='consent'>|</div>", "<div class='alert'>|</div>", "<div class='newsletter subscribe'>|</div>", "<div class='popup modal'>|</div>", "<div class='share social'>|</div>",
    "<div class='related'>|</div>", "<section class='recommended'>|</section>", "<div class='breadcrumb'>|</div>", "<div class='login'>|</div>", "<div class='legal copyright'>|</div>", "<div class='widget'>|</div>", "<div class='promo'>|</div>", "<dialog>|</dialog>",
)
_COMMENT_BOXES = ("<div class='comments'>|</div>", "<section id='comments'>|</section>", "<div id='discussion'>|</div>", "<ol class='comment-list'>|</ol>", "<section class='comments' id='respond'>|</section>", "<div class='comment'>|</div>", "<div class='reader-comments'>|</div>", "<div class='replies'>|</div>")
_MENU_BOXES = ("<nav>|</nav>", "<header>|</header>", "<div class='menu'>|</div>", "<div id='navbar'>|</div>", "<header class='site-header'><nav>|</nav></header>", "<div class='header'>|</div>", "<nav class='main-menu' role='navigation'>|</nav>", "<div class='top-bar'>|</div>")
_FOOT_BOXES = ("<footer>|</footer>", "<div class='footer'>|</div>", "<footer class='site-footer'>|</footer>", "<div id='footer'>|</div>")
_STOCK = "Home|About us|Contact|Privacy policy|Terms of use|Log in|Sign up|Subscribe to our newsletter|Share this|Read more|Advertisement|We use cookies to improve your visit.|Accept all|All rights reserved.|Leave a comment|Reply|Related stories|Follow us|Search|Skip to content|© 2020".split("|")


class _Writer:
    """Pages with labels: main text bears the mark U+E000 before each block."""

    def __init__(self, seed: int):
        self.rng = np.random.default_rng(seed)

    def pick(self, choices):
        return choices[int(self.rng.integers(len(choices)))]

    def chance(self, p: float) -> bool:
        return bool(self.rng.random() < p)

    def words(self, low: int, high: int) -> str:
        n = int(np.exp(self.rng.uniform(np.log(low), np.log(high + 1))))
        letters = np.frombuffer(b"etaoinshrdlucmfwypvbgkjqxz", np.uint8)
        text = " ".join(bytes(letters[np.minimum(25, self.rng.geometric(0.12, int(self.rng.integers(1, 11))) - 1)]).decode() for _ in range(max(1, n)))
        return text.capitalize() + (self.pick([".", ".", ".", "!", "?", ""]) if n > 2 or self.chance(0.6) else "")

    def links(self, n: int) -> str:
        kind = self.pick(["<li><a href='/x'>%s</a></li>", "<li><a href='/x'>%s</a></li>", "<a href='/x'>%s</a> ", "<p><a href='/x'>%s</a></p>"])
        body = "".join(kind % (self.pick(_STOCK) if self.chance(0.4) else self.words(1, 5).rstrip(".")) for _ in range(n))
        return f"<ul>{body}</ul>" if kind.startswith("<li") else body

    def main(self) -> str:
        out = []
        if self.chance(0.85):
            out.append(f"<h1>{self.words(1, 14)}</h1>")
        for _ in range(int(np.exp(self.rng.uniform(0, 3.2)))):
            roll = self.rng.random()
            if roll < 0.68:
                text = "" + self.words(1, 120)
                if self.chance(0.2):
                    text += f" <a href='/y'>{self.words(1, 4)}</a> {self.words(1, 30)}"
                if self.chance(0.1):
                    text = f"<b>{text}<br>"
                out.append(f"<p>{text}" + ("</p>" if self.chance(0.85) else ""))
            elif roll < 0.74:
                out.append(f"<h2>{self.words(1, 8)}</h2>")
            elif roll < 0.8:
                out.append("<ul>" + "".join(f"<li>{self.words(1, 20)}</li>" for _ in range(int(self.rng.integers(1, 6)))) + "</ul>")
            elif roll < 0.84:
                out.append(f"<blockquote>{self.words(4, 40)}</blockquote>")
            elif roll < 0.86:
                out.append(f"<pre>{self.words(2, 30)}</pre>")
            elif roll < 0.88:
                out.append(f"<table><tr><td>{self.words(1, 5)}</td><td>{self.words(1, 5)}</td></tr></table>")
            elif roll < 0.92:
                out.append(f"<div>{self.words(2, 60)}</div>")
            else:
                out.append(self.aside())
        return "".join(out)

    def aside(self) -> str:
        a, b = self.pick(_ASIDE_BOXES).split("|")
        roll = self.rng.random()
        if roll < 0.3:
            body = self.links(int(self.rng.integers(1, 8)))
        elif roll < 0.55:
            body = self.words(1, 40)
        elif roll < 0.85:
            body = (f"<h3>{self.words(1, 5)}</h3>" if self.chance(0.4) else "") + "".join(f"<p>{self.pick(_STOCK) if self.chance(0.3) else self.words(2, 50)}</p>" for _ in range(int(self.rng.integers(1, 4))))
        else:
            body = self.form()
        return a + body + b

    def form(self) -> str:
        return f"<form action='/s'><label>{self.words(1, 4)}</label><input name=q><select><option>{self.words(1, 2)}<option>{self.words(1, 2)}</select><p>{self.words(1, 15)}</p><button>{self.pick(_STOCK)}</button></form>"

    def comments(self) -> str:
        a, b = self.pick(_COMMENT_BOXES).split("|")
        item = self.pick(["<div class='comment'><p>%s</p></div>", "<li><p>%s</p></li>", "<p>%s</p>", "<article class='comment'><p>%s</p></article>"])
        return a + (f"<h3>{self.pick(['Comments', 'Reader comments', self.words(1, 3)])}</h3>" if self.chance(0.6) else "") + "".join(item % self.words(1, 60) for _ in range(int(self.rng.integers(1, 7)))) + (self.form() if self.chance(0.3) else "") + b

    def page(self) -> str:
        out = []
        for _ in range(int(self.rng.integers(0, 3))):
            a, b = self.pick(_MENU_BOXES).split("|")
            out.append(a + (f"<p>{self.words(1, 6)}</p>" if self.chance(0.2) else "") + self.links(int(self.rng.integers(1, 9))) + b)
        out += [self.aside() for _ in range(int(self.rng.integers(0, 3)))]
        if self.chance(0.96):
            a, b = self.pick(_MAIN_BOXES).split("|")
            inside = self.comments() if self.chance(0.12) else ""
            out.append(a + self.main() + inside + b)
        out += [self.aside() for _ in range(int(self.rng.integers(0, 3)))]
        if self.chance(0.35):
            out.append(self.comments())
        if self.chance(0.15):
            out.append(self.form())
        if self.chance(0.8):
            a, b = self.pick(_FOOT_BOXES).split("|")
            out.append(a + self.pick([f"&copy; {self.words(1, 3)} &middot; {self.words(2, 12)}", f"<p>{self.words(2, 25)}</p>", self.links(4)]) + b)
        body = "".join(out)
        if self.chance(0.3):
            body = f"<div class='{self.pick(['wrapper', 'container', 'page', 'site', 'layout'])}'>{body}</div>"
        return f"<!DOCTYPE html><html><head><title>{self.words(1, 8)}</title></head><body>{body}</body></html>"


def training_pages(count: int, seed: int) -> list[tuple[list[Block], np.ndarray]]:
    """Blocks and labels (1: main text) of generated pages."""
    writer, out = _Writer(seed), []
    while len(out) < count:
        marked = blocks_of(writer.page())
        if marked:
            out.append(([b._replace(text=b.text.replace("", "")) for b in marked], np.array(["" in b.text for b in marked], np.float32)))
    return out


@functools.lru_cache(maxsize=2)
def trained(pages: int = TRAIN_PAGES, epochs: int = EPOCHS, seed: int = SEED) -> BiLSTM:
    """The labeller, fitted with Adam to generated pages; the same for the same arguments."""
    made = training_pages(pages, seed)
    x, y = [features(b) for b, _ in made], [labels for _, labels in made]
    net, rng, size, step = BiLSTM(seed), np.random.default_rng(seed), 16, 0
    first, second = ({k: np.zeros_like(v) for k, v in net.p.items()} for _ in range(2))
    order = sorted(range(len(x)), key=lambda i: len(x[i]))
    batches = [padded([x[i] for i in order[a : a + size]]) + (padded([y[i][:, None] for i in order[a : a + size]])[0][:, :, 0],) for a in range(0, len(x), size)]
    for epoch in range(epochs):
        rate = 0.02 * (1 - epoch / epochs) + 0.001
        for k in rng.permutation(len(batches)):
            _, grads = net.gradient(*batches[k])
            step += 1
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            for name, g in grads.items():
                g = g * min(1.0, 1.0 / (norm + 1e-9))
                first[name] = 0.9 * first[name] + 0.1 * g
                second[name] = 0.99 * second[name] + 0.01 * g * g
                net.p[name] -= (rate * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def label(net: BiLSTM, pages: list[list[Block]], cells: int = 40_000, at_once: int = 4096) -> list[np.ndarray]:
    """Whether each block of each page is main text; pages of like length run together.

    Features are made ``at_once`` blocks at a time and kept only as what they add to
    the gates, so a page of very many blocks needs about a kilobyte for each of them.
    """
    out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
    order = sorted((i for i, b in enumerate(pages) if b), key=lambda i: len(pages[i]))
    a = 0
    while a < len(order):
        b = a + 1
        while b < len(order) and (b - a + 1) * len(pages[order[b]]) <= cells:
            b += 1
        group, longest = order[a:b], len(pages[order[b - 1]])
        z, mask = {d: np.zeros((longest, len(group), 4 * net.hidden), np.float32) for d in "fb"}, np.zeros((longest, len(group)), bool)
        flat = [(k, j) for k, i in enumerate(group) for j in range(len(pages[i]))]
        for s in range(0, len(flat), at_once):
            some = flat[s : s + at_once]
            page, place = (np.array(x) for x in zip(*some))
            x = features([pages[group[k]][j] for k, j in some])
            mask[place, page] = True
            for d in "fb":
                z[d][place, page] = net.project(x, d)
        p = net.predict(z, mask)
        for k, i in enumerate(group):
            out[i] = p[: len(pages[i]), k] >= 0.5
        a = b
    return out


def extract_main_text(pages: DataFrame, net: BiLSTM | None = None) -> DataFrame:
    """page_id, url, text, n_chars, n_blocks, n_main for every page (page_id, url, html).

    Null and empty html, and html without text, give empty text.  Pages of any length and
    depth are read whole, in time and memory that grow with their length.  Repeated rows are
    extracted each; an empty table gives no rows; other columns are not read.
    """
    weights = (net or trained()).p

    def run(batches):
        import pyarrow as pa

        local = BiLSTM()
        local.p = weights
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                part = batch.slice(a, 1000)
                found = [blocks_of(h or "") for h in part.column("html").to_pylist()]
                kept = label(local, found)
                texts = ["\n".join(b.text for b, k in zip(blocks, keep) if k) for blocks, keep in zip(found, kept)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array([len(b) for b in found], pa.int64()), pa.array([int(k.sum()) for k in kept], pa.int64())],
                    ["page_id", "url", "text", "n_chars", "n_blocks", "n_main"],
                )

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long, n_blocks long, n_main long")


def op7_html_text(spark, sf_dir: str) -> DataFrame:
    return extract_main_text(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "url", "text", "n_chars")
