"""Main text of web pages by a recurrent block labeller.

A page becomes its sequence of leaves: runs of text between block tags, each with the path of tags above it.  A
bidirectional LSTM in numpy reads, leaf by leaf, hashed vectors of the path and of all words, and labels every leaf
as main text or not from the whole page.  Class names that training did not see often are all one to it.  It is trained here on a bounded sample of the pages: their own leaves,
labelled where the page's elements say what they are, and the same texts laid out anew in many other ways, where the
layout is known because it was made.
"""

from __future__ import annotations

import html
import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewarden.llm.common import column, nonempty

#: Bound of the training sample, in pages; leaves of a piece of a page that not all elements tell about; hashed path and word features; hidden units.
PAGES, TRAIN_LEAVES, PATH, WORDS, HIDDEN = 240, 80, 256, 32, 20
PAGES_AT_ONCE, BYTES_AT_ONCE = 256, 4_000_000
#: Leaves of a training page that are learned in one piece; a longer page is several pieces.
WHOLE_LEAVES = 512
#: Training pages in which a class name must occur to be told from others, and what stands for all others.
KNOWN_IN, UNNAMED = 5, "unnamed"
#: Made layouts for each page of the sample's bound, and how often all pages are gone through.
LAYOUTS, EPOCHS = 6, 6

_TOKEN = re.compile(r"<(?:!--.*?(?:--!?>|\Z)|[!?][^>]*+>|(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>)", re.S)
_NAMES = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[a-z]+")
RAW = frozenset("script style noscript template iframe svg textarea".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header hr html label legend li main menu nav ol option p pre section select summary table "
    "tbody td tfoot th thead title tr ul".split())
CLOSES = {"p": {"p"}, "li": {"li", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "tr": {"tr", "td", "th", "p"},
          "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "option": {"option"}}
#: A new block tag ends an open paragraph.
STOPS = frozenset("article aside body div footer form header html main nav section table ul ol dl".split())


@dataclass
class Leaf:
    path: tuple[str, ...]
    text: str


def leaves(page: str | None) -> list[Leaf]:
    """The leaves of a whole page with visible text, in order: references decoded, white space one space."""
    if not page:
        return []
    out: list[Leaf] = []
    stack: list[tuple[str, str]] = []              # (tag, tag with its names), block tags and links
    waiting: list[str] = []

    def flush() -> None:
        if waiting:
            text = " ".join(html.unescape("".join(waiting)).split())
            if text:
                out.append(Leaf(tuple(name for _, name in stack), text))
            waiting.clear()

    def close(tags: set[str] | frozenset[str], stop: frozenset[str] = frozenset()) -> None:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in tags:
                del stack[i:]
                return
            if stack[i][0] in stop:
                return

    at, end = 0, len(page)
    find = _TOKEN.search
    while at < end:
        token = find(page, at)
        if token is None:
            waiting.append(page[at:])
            break
        if token.start() > at:
            waiting.append(page[at:token.start()])
        at = token.end()
        tag = token[2]
        if tag is None:
            continue
        tag = tag.lower()
        if token[1]:
            if tag in BLOCK:
                flush()
                close({tag})
            continue
        if tag in RAW:
            shut = re.compile(f"</{tag}[^>]*>", re.I).search(page, at)
            at = shut.end() if shut else end
        elif tag == "br":
            waiting.append(" ")
        elif tag in BLOCK:
            flush()
            if tag in CLOSES:
                close(CLOSES[tag], STOPS)
            else:
                close({"p"}, STOPS)
            if tag not in VOID:
                names = " ".join(x for m in _NAMES.finditer(token[3]) for x in m.groups() if x).lower() if "=" in token[3] else ""
                stack.append((tag, f"{tag} {names}".strip()))
    flush()
    return out


class _Slots(dict):
    """Slot and sign of a feature, hashed once."""

    def __init__(self, n: int, most: int = 300_000):
        super().__init__()
        self.n, self.most = n, most

    def __missing__(self, key: str) -> int:
        h = zlib.crc32(key.encode())
        value = h % self.n * 2 + (h >> 20 & 1)
        if len(self) < self.most:
            self[key] = value
        return value


_PATHS, _WORDS = _Slots(PATH), _Slots(WORDS)
_PATH_VECTORS: dict[tuple[str, ...], np.ndarray] = {}
MEASURES = 7
INPUTS = PATH + WORDS + MEASURES


def _path_vector(path: tuple[str, ...]) -> np.ndarray:
    vector = _PATH_VECTORS.get(path)
    if vector is None:
        vector = np.zeros(PATH, np.float32)
        keys = []
        for depth, name in enumerate(path):
            tag = name.split(" ")[0]
            parts = {w for w in _WORD.findall(name[len(tag):])}
            keys += [f"t:{tag}", *(f"n:{w}" for w in parts)]
            if depth == len(path) - 1:
                keys.append(f"last:{tag}")
        for key in keys:
            for slot in (_PATHS[key], _PATHS[f"2{key}"]):              # two places, so that one shared by chance says little
                vector[slot >> 1] += 1 if slot & 1 else -1
        if len(_PATH_VECTORS) < 20_000:
            _PATH_VECTORS[path] = vector
    return vector


def _common(a: tuple[str, ...], b: tuple[str, ...]) -> int:
    """How many elements two paths begin with alike."""
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def vectors(page: list[Leaf]) -> np.ndarray:
    """One row per leaf: hashed path, hashed words, measures of its length and punctuation, and what it shares with its neighbours' paths."""
    together = [0, *(_common(a.path, b.path) for a, b in zip(page, page[1:])), 0]
    out = np.zeros((len(page), INPUTS), np.float32)
    for i, leaf in enumerate(page):
        words = leaf.text.split(" ")
        slots = np.bincount(np.fromiter(map(_WORDS.__getitem__, words), np.int64, len(words)), minlength=2 * WORDS)
        out[i, :PATH] = _path_vector(leaf.path)
        out[i, PATH:PATH + WORDS] = (slots[1::2] - slots[::2]) / np.sqrt(len(words))
        n = len(leaf.text)
        out[i, PATH + WORDS:] = (np.log1p(n) / 5, np.log1p(len(words)) / 4, (leaf.text.count(".") + leaf.text.count(",")) / n * 10,
                                 leaf.text[-1] in ".!?:;", len(leaf.path) / 4, (len(leaf.path) - together[i]) / 2,
                                 (len(leaf.path) - together[i + 1]) / 2)
    return out


def names_in(page: list[Leaf]) -> set[str]:
    """The words of all class names, ids and roles above the leaves of a page."""
    return {w for name in {name for leaf in page for name in leaf.path} for w in _WORD.findall(name.partition(" ")[2])}


def renamed(page: list[Leaf], known: frozenset[str]) -> list[Leaf]:
    """The leaves with one word in place of every name that is not known, so that no two unknown names differ."""
    def plain(name: str) -> str:
        tag, _, rest = name.partition(" ")
        return " ".join([tag, *sorted({w if w in known else UNNAMED for w in _WORD.findall(rest)})])

    paths = {path: tuple(map(plain, path)) for path in {leaf.path for leaf in page}}
    return [Leaf(paths[leaf.path], leaf.text) for leaf in page]


# ---- the network

def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def new_weights(seed: int = 5) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    made = {}
    for side in "fb":
        made[f"W{side}"] = rng.standard_normal((INPUTS, 4 * HIDDEN)) / np.sqrt(INPUTS)
        made[f"U{side}"] = rng.standard_normal((HIDDEN, 4 * HIDDEN)) / np.sqrt(HIDDEN)
        made[f"b{side}"] = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)])
    made["V"], made["c"] = rng.standard_normal(2 * HIDDEN) / np.sqrt(2 * HIDDEN), np.zeros(1)
    return made


def _run(x: np.ndarray, mask: np.ndarray, w: dict[str, np.ndarray], side: str, keep: list | None = None) -> np.ndarray:
    """Hidden states of one direction; ``x`` is (pages, leaves, inputs), padding leaves the state as it is."""
    n, steps, _ = x.shape
    pre = x @ w[f"W{side}"] + w[f"b{side}"]
    h, c = np.zeros((n, HIDDEN), pre.dtype), np.zeros((n, HIDDEN), pre.dtype)
    out = np.zeros((n, steps, HIDDEN), pre.dtype)
    for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
        z = pre[:, t] + h @ w[f"U{side}"]
        gates = _sigmoid(z[:, :3 * HIDDEN])
        i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN:2 * HIDDEN], gates[:, 2 * HIDDEN:]
        g = np.tanh(z[:, 3 * HIDDEN:])
        on = mask[:, t, None]
        c_new = np.where(on, f * c + i * g, c)
        tc = np.tanh(c_new)
        h_new = np.where(on, o * tc, h)
        if keep is not None:
            keep.append((t, h, c, i, f, o, g, tc, on))
        h, c = h_new, c_new
        out[:, t] = h
    return out


def chances(pages: list[np.ndarray], w: dict[str, np.ndarray]) -> list[np.ndarray]:
    """For each page the chance of each leaf to be main text; pages of like length go together."""
    out: list[np.ndarray] = [np.zeros(0)] * len(pages)
    order = sorted((i for i in range(len(pages)) if len(pages[i])), key=lambda i: len(pages[i]))
    at = 0
    while at < len(order):
        most = max(1, 40_000 // len(pages[order[min(at + PAGES_AT_ONCE, len(order)) - 1]]))
        group = order[at:at + min(PAGES_AT_ONCE, most)]
        at += len(group)
        steps = len(pages[group[-1]])
        x, mask = np.zeros((len(group), steps, INPUTS), np.float32), np.zeros((len(group), steps), bool)
        for r, i in enumerate(group):
            x[r, :len(pages[i])], mask[r, :len(pages[i])] = pages[i], True
        small = {k: v.astype(np.float32) for k, v in w.items() if k != "names"}
        both = np.concatenate([_run(x, mask, small, "f"), _run(x, mask, small, "b")], axis=2)
        p = _sigmoid(both @ small["V"] + small["c"])
        for r, i in enumerate(group):
            out[i] = p[r, :len(pages[i])]
    return out


def _gradients(x: np.ndarray, y: np.ndarray, mask: np.ndarray, w: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    kept: dict[str, list] = {"f": [], "b": []}
    hidden = {s: _run(x, mask, w, s, kept[s]) for s in "fb"}
    both = np.concatenate([hidden["f"], hidden["b"]], axis=2)
    error = np.where(mask, _sigmoid(both @ w["V"] + w["c"]) - y, 0) / max(1, mask.sum())
    grad = {"V": np.einsum("nt,nth->h", error, both), "c": np.array([error.sum()])}
    for k, side in enumerate("fb"):
        above = error[:, :, None] * w["V"][k * HIDDEN:(k + 1) * HIDDEN]
        dh, dc = np.zeros((len(x), HIDDEN)), np.zeros((len(x), HIDDEN))
        dz_all = np.zeros((*x.shape[:2], 4 * HIDDEN))
        du = np.zeros_like(w[f"U{side}"])
        for t, h, c, i, f, o, g, tc, on in reversed(kept[side]):
            dh = dh + above[:, t]
            now = np.where(on, dh, 0)
            dcn = np.where(on, dc + now * o * (1 - tc ** 2), 0)
            dz = np.concatenate([dcn * g * i * (1 - i), dcn * c * f * (1 - f), now * tc * o * (1 - o), dcn * i * (1 - g ** 2)], axis=1)
            dz_all[:, t] = dz
            du += h.T @ dz
            dh, dc = np.where(on, 0, dh) + dz @ w[f"U{side}"].T, np.where(on, dcn * f, dc)
        grad[f"W{side}"] = x.reshape(-1, INPUTS).T @ dz_all.reshape(-1, 4 * HIDDEN)
        grad[f"U{side}"], grad[f"b{side}"] = du, dz_all.sum(axis=(0, 1))
    return grad


def fit(pages: list[np.ndarray], labels: list[np.ndarray], epochs: int = 8, batch: int = 24, rate: float = 0.01, of=lambda page: page) -> dict[str, np.ndarray]:
    """Weights from pages and their labels; ``of`` makes the matrix of a page, when its batch is due."""
    w = new_weights()
    first, second = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    step = 0
    rng = np.random.default_rng(3)
    for _ in range(epochs):
        order = rng.permutation(len(pages))
        order = order[np.argsort(np.array([len(pages[i]) for i in order]) // 8, kind="stable")]
        groups = [order[i:i + batch] for i in range(0, len(order), batch)]
        for at in rng.permutation(len(groups)):
            group = groups[at]
            steps = max(len(pages[i]) for i in group)
            x, y, mask = np.zeros((len(group), steps, INPUTS)), np.zeros((len(group), steps)), np.zeros((len(group), steps), bool)
            for r, i in enumerate(group):
                n = len(pages[i])
                x[r, :n], y[r, :n], mask[r, :n] = of(pages[i]), labels[i], True
            step += 1
            now = rate * max(0.05, 1 - step / (epochs * len(groups)))              # smaller and smaller steps
            for k, g in _gradients(x, y, mask, w).items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                w[k] -= now * (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.99 ** step)) + 1e-6)
    return w


# ---- what it learns from

_CHROME = frozenset("nav footer aside form header head title menu button select option label dialog fieldset".split())
#: Kinds of blocks that are no main text: elements of their own, names that tell them, fewest and most leaves.
_EXTRAS = {"menu": ("nav menu", "breadcrumb menu nav navbar", 1, 8), "header": ("header", "banner header", 1, 2),
           "ad": ("aside", "ad ads advert advertisement banner promo sponsored", 1, 2),
           "notice": ("dialog", "consent cookie cookies notice popup", 1, 2),
           "side": ("aside", "related share sidebar social widget", 1, 5), "form": ("form fieldset", "newsletter subscribe", 1, 4),
           "comments": ("", "comment comments", 1, 7), "footer": ("footer", "footer", 1, 4)}
_CHROME_NAMES = frozenset(name for _, names, _, _ in _EXTRAS.values() for name in names.split())
#: What lies between a block of a kind and its text.
_INNER = {"header": (["h1"], ["h1"], ["p"], [], ["div"]), "menu": (["ul", "li"], ["ul", "li"], ["li"], []), "form": ([], ["label"], ["p"], ["button"], ["div", "label"]),
          "comments": (["p"], ["div comment", "p"], ["article comment", "p"], ["li", "p"], ["ul", "li"])}
#: Elements around main text whose names tell it.
_BOXES = (["article"], ["main"], ["main", "article"], ["div content"], ["div post"], ["section entry content"], ["div id article body"],
          ["article post"], ["div main"], ["section"], [])


def said_by_elements(leaf: Leaf) -> bool | None:
    """Whether the elements above a leaf say that it is main text; None if they say nothing."""
    inside = False
    for name in leaf.path:
        tag, *names = name.split(" ")
        words = set(_WORD.findall(" ".join(names)))
        if tag in _CHROME or words & _CHROME_NAMES:
            if not (tag == "header" and inside):
                return False
        inside = inside or tag in ("article", "main")
    return True if inside else None


def _nameless(rng: random.Random) -> str:
    """A class name that says nothing."""
    return "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(1, 7)))


def _short(text: str, rng: random.Random) -> str:
    """A few words from anywhere in a text, or a number."""
    if rng.random() < 0.2:
        return str(rng.randint(0, 10 ** rng.randint(1, 5)))
    words = text.split(" ")
    at = rng.randrange(len(words))
    return " ".join(words[at:at + rng.choice([1, 1, 2, 3, 5, 8, 12])])


def _main_block(text: str, rng: random.Random) -> list[tuple[list[str], str]]:
    """A block of main text: paths inside the main element, and the text of each leaf."""
    few = lambda low, high: range(rng.randint(low, high))      # noqa: E731
    kind = rng.choices(["p", "bare", "quote", "head", "list", "table", "pre", "terms", "figure"], [56, 5, 4, 8, 14, 6, 4, 3, 2])[0]
    if kind == "list":
        path = [rng.choice(["ul", "ol"]), "li"] + rng.choice([[], [], ["p"]])
        return [(path, _short(text, rng) if rng.random() < 0.7 else text) for _ in few(1, 7)]
    if kind == "table":
        rows = ["table"] + rng.choice([[], ["tbody"]]) + ["tr"]
        heads = [(["table", "tr", "th"], _short(text, rng)) for _ in few(0, 4)]
        return heads + [(rows + ["td"], _short(text, rng)) for _ in few(1, 10)]
    if kind == "terms":
        return [(["dl", rng.choice(["dt", "dd"])], _short(text, rng)) for _ in few(2, 6)]
    if kind in ("head", "figure"):
        return [([rng.choice(["h2", "h3", "h4"])] if kind == "head" else ["figure", "figcaption"], _short(text, rng))]
    if kind == "pre":
        return [(["pre"], rng.choice([f"{_short(text, rng)} = {_short(text, rng)}()", _short(text, rng), text]))]
    path = {"p": ["p"], "bare": [], "quote": ["blockquote"] + rng.choice([[], ["p"]])}[kind]
    return [(path, text if rng.random() < 0.85 else _short(text, rng))]


def laid_out(texts: list[str], chrome: list[str], rng: random.Random) -> tuple[list[Leaf], list[bool]]:
    """A page of known layout: ``texts`` as main text, or none, between pieces of chrome."""
    page: list[Leaf] = []
    labels: list[bool] = []
    shell = rng.choice([["html", "body"], ["html", "body"], [], ["html", "body", "div page"], ["html", "body", "div id wrapper"]])
    shell = shell + [f"div {_nameless(rng)}" for _ in range(rng.choice([0, 0, 0, 1, 2]))]

    def put(path: list[str], text: str, main: bool) -> None:
        page.append(Leaf(tuple(shell + path), text))
        labels.append(main)

    def extra(kind: str, base: list[str]) -> None:
        own, names, low, high = _EXTRAS[kind]
        told = rng.choice(names.split()) + (f" {_nameless(rng)}" if rng.random() < 0.3 else "")
        if own and rng.random() < 0.5:
            box = [rng.choice(own.split()) + rng.choice(["", "", f" {told}", f" {_nameless(rng)}"])]
        else:
            box = [f"{rng.choice(['div', 'div', 'section', 'aside', 'ul' if kind == 'menu' else 'p'])} {told}"]
        if rng.random() < 0.2:
            box = [f"div {_nameless(rng)}"] + box
        choices = _INNER.get(kind, ([], ["p"], ["p"], ["ul", "li"], ["h3"], [f"div {_nameless(rng)}"]))
        inner = rng.choice(choices)
        for _ in range(rng.randint(low, high)):
            long = rng.choice(texts) if texts and rng.random() < 0.5 else rng.choice(chrome)
            text = long if kind != "menu" and rng.random() < 0.7 else _short(long, rng)
            put(base + box + (inner if rng.random() < 0.9 else rng.choice(choices)), text, False)

    put(["head", "title"], (texts or chrome)[0][:60], False) if rng.random() < 0.8 else None
    if page:
        page[0] = Leaf(("html", "head", "title"), page[0].text)
    for kind in ("header", "menu", "notice", "ad", "side"):
        if rng.random() < 0.5:
            extra(kind, [])
    box = rng.choice(_BOXES) if rng.random() < 0.6 else [
        f"{rng.choice(['div', 'div', 'section'])} {_nameless(rng)}" for _ in range(rng.randint(1, 3))]
    if texts and rng.random() < 0.7:
        told = any(part.split(" ")[0] in ("article", "main") for part in box)
        put(box + rng.choice([["h1"], ["h1"], ["h2"], ["h3"], ["header", "h1"] if told else ["h2"]]), texts[0][:60] if rng.random() < 0.5 else _short(texts[0], rng), True)
    for t in texts:
        part = [f"div {_nameless(rng)}"] if rng.random() < 0.1 else []
        for path, text in _main_block(t, rng):
            put(box + part + path, text, True)
        if rng.random() < 0.1:
            extra(rng.choice(["ad", "ad", "form", "side"]), box)
    for kind in ("comments", "side", "ad", "form", "notice", "menu", "footer"):
        if rng.random() < (0.8 if kind == "footer" else 0.4):
            extra(kind, box if kind in ("comments", "form") and rng.random() < 0.2 else [])
    return page, labels


def pieces(page: list[Leaf], told: list[bool | None], whole: int, part: int) -> Iterator[tuple[list[Leaf], np.ndarray]]:
    """Leaves and labels of all pieces of a page that can be learned from: of ``whole`` leaves where all are told, else of ``part``."""
    each = whole if all(t is not None for t in told) else part
    for at in range(0, len(page), each):
        labels = told[at:at + each]
        if all(t is not None for t in labels):
            yield page[at:at + each], np.array(labels, float)


def train(pages: DataFrame, sample: int = PAGES, whole: int = WHOLE_LEAVES, part: int = TRAIN_LEAVES) -> dict[str, np.ndarray]:
    """Weights from at most ``sample`` of the pages: from each hash slot the page with the smallest hash.

    All leaves of a page are looked at.  Pages up to ``whole`` leaves are learned in one piece, longer ones in several;
    of a page with leaves that its elements do not tell about, the pieces of ``part`` leaves without such a leaf.

    Without a usable page the weights come from layouts of a few fixed words.
    """
    rows = pages.where(F.col("html").isNotNull()).select("html", F.xxhash64("html").alias("mark"))
    chosen = rows.groupBy(F.pmod("mark", F.lit(sample)).alias("slot")).agg(F.min("mark").alias("mark"))
    got = rows.join(F.broadcast(chosen.select("mark")), "mark").dropDuplicates(["mark"]).orderBy("mark").collect()
    return learn([r["html"] for r in got], sample, whole, part)


def learn(pages: list[str], sample: int = PAGES, whole: int = WHOLE_LEAVES, part: int = TRAIN_LEAVES) -> dict[str, np.ndarray]:
    """Weights from all of ``pages`` and ``LAYOUTS`` * ``sample`` made layouts of their texts."""
    parsed = [leaves(p) for p in pages]
    told = [[said_by_elements(leaf) for leaf in page] for page in parsed]
    main = [[leaf.text for leaf, s in zip(page, t) if s] for page, t in zip(parsed, told)]
    chrome = [leaf.text for page, t in zip(parsed, told) for leaf, s in zip(page, t) if s is False] or ["menu", "home page", "all rights reserved"]
    main = [m for m in main if m] or [[leaf.text for leaf in page if len(leaf.text) > 80] for page in parsed]
    main = [m for m in main if m] or [["a line of text", "and one more line of text, which ends here."]]
    rng = random.Random(17)
    x, y = [], []
    for page, t in zip(parsed, told):
        for leaf_piece, labels in pieces(page, t, whole, part):
            x.append(leaf_piece)
            y.append(labels)
    for _ in range(LAYOUTS * sample):
        texts = rng.choice(main)
        start = rng.randrange(len(texts))
        page, labels = laid_out(texts[start:start + rng.randint(1, 25)] if rng.random() < 0.9 else [], chrome, rng)
        x.append(page)
        y.append(np.array(labels, float))
    known = names_known(x)
    return {**fit([renamed(page, known) for page in x], y, epochs=EPOCHS, of=vectors), "names": np.array(sorted(known), str)}


def names_known(pages: list[list[Leaf]]) -> frozenset[str]:
    """Names that occur in at least ``KNOWN_IN`` of the pages."""
    seen = Counter(name for page in pages for name in names_in(page))
    return frozenset(name for name, n in seen.items() if n >= KNOWN_IN)


def extract(pages: DataFrame, weights: dict[str, np.ndarray]) -> DataFrame:
    """page_id, url, text and n_chars (code points) of the main text of every whole page.

    The leaves labelled main text, in order, joined by one space.  A null, empty or textless page gives an empty text.
    Extra columns are not read; repeated rows each give a row.
    """
    known = frozenset(weights["names"].tolist())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in nonempty(batches):
            sizes = np.cumsum(pc.fill_null(pc.binary_length(column(batch, "html")), 0).to_numpy(zero_copy_only=False))
            at = 0
            while at < batch.num_rows:
                stop = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + BYTES_AT_ONCE, side="right")))
                part = batch.slice(at, stop - at)
                at = stop
                parsed = [renamed(leaves(p), known) for p in column(part, "html").to_pylist()]
                found = chances([vectors(p) for p in parsed], weights)
                texts = [" ".join(leaf.text for leaf, p in zip(page, ps) if p >= 0.5) for page, ps in zip(parsed, found)]
                yield pa.RecordBatch.from_arrays([column(part, "page_id"), column(part, "url"), pa.array(texts, pa.string()),
                                                  pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    plain = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return plain.mapInArrow(run, "page_id long, url string, text string, n_chars long")
