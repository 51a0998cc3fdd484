"""Main text of web pages by a recurrent block labeller.

A page is its sequence of leaf blocks.  A block's vector has three parts: its tag
path (tags and class, id and role words of all open elements, hashed), its words
(hashed), and facts of its form (length, share of linked text, marks, digits, place).  A bidirectional
LSTM reads the whole sequence, so every block is judged with the context of the
document, and labels each block main text or not.

Training needs no hand labels: blocks are marked by what the markup
says of itself (``article`` and ``main`` against ``nav``, ``footer``, ``aside``, forms, and hint words like ``ad`` or
``comments``; hints on an element that holds the article, or on ``html`` and ``body``, say nothing).  In most examples the
giveaway is then taken away: ``article`` and ``main`` become a plain container, and side tags and hints too, each or only
some, so that words, form, place and neighbours must decide.  Path or words are blanked at random, pages
get blocks of other pages inserted in side containers, so that
such containers are known even where the sample has none.

The sample is at most ``SAMPLE_PAGES`` pages, in hash order, of all pages of the
table that can be trained on: those with a block marked main.  A page of more than ``WINDOW_BLOCKS`` blocks
gives a window from anywhere in it, with its true place in the page.  If there
is none, nothing is learned: all blocks outside side markup (the same tags and hint words) are main text.  A hint on
an element that holds nearly all of the page's text is a wrapper's and counts nowhere.

Only training windows reach the driver (paths and vectors, no texts).  Labelling is one pass that shuffles nothing; pages of a
batch run through the network together, grouped by length.

Defined results: null html gives an empty text; character references are decoded, white
space ``[\\x20\\x09-\\x0D]`` inside a block becomes one space; repeated rows get
equal results; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import text_slices
from .html_blocks import Block, blocks
from .words import find_words, word_hashes

PATH_SIZE, WORD_SIZE, FORM_SIZE = 96, 16, 8
SIZE = PATH_SIZE + WORD_SIZE + FORM_SIZE
PLACE = 4                     # the form fact that is the block's place in the page
HIDDEN = 16
SAMPLE_PAGES = 400
WINDOW_BLOCKS = 150           # blocks of a training page's window
EPOCHS, BATCH, RATE = 24, 16, 0.01
WRAPPER_SHARE = 0.9           # an element with that share of a page's text wraps the page
PLAIN_MAIN = 0.6              # share of training pages without article and main
PLAIN_SIDE = 0.4              # share with some side tags and hints taken away
BLANKED = 0.08                # share of training pages without paths, and without words
INSERTED = 0.9                # share of training pages with inserted side blocks,
INSERTS = 4, 12               # in so many places (the second excluded)
SEED = 5

# Markup that says what it holds.
MAIN_TAGS = frozenset(("article", "main"))
SIDE_TAGS = frozenset("nav footer aside form header menu dialog button fieldset".split())
SIDE_HINTS = frozenset("ad ads advert advertisement banner breadcrumb breadcrumbs comment comments cookie cookies consent "
                       "disqus footer header legal login masthead menu nav navbar navigation newsletter notice overlay pagination "
                       "popup promo related reply share sharing sidebar social sponsor sponsored subscribe tags toolbar widget".split())


# containers and names that text stands in on pages without article and main
PLAIN_TAGS = ("div", "div", "section", "td")
PLAIN_HINTS = "article body content copy entry main page post story text".split()
WRAPPERS = frozenset(("html", "body", "main", "article"))       # hints on them are about the page


def marked_main(path: tuple[str, ...]) -> bool:
    """What the markup says of a block: inside main text and in nothing beside it.

    A page header is furniture; a header inside an article belongs to it.  Hints on the article
    or on what holds it are about the page."""
    at = next((i for i, part in enumerate(path) if part in MAIN_TAGS), None)
    if at is None or any(part in SIDE_TAGS for part in path[:at]):
        return False
    owner = ""
    for part in path[at:]:
        if part[0] != ".":
            owner = part
        if part in SIDE_TAGS and part != "header" or part[0] == "." and part[1:] in SIDE_HINTS and owner not in WRAPPERS:
            return False
    return True


def side_marks(path: tuple[str, ...]) -> list[int]:
    """Lengths of the path's beginnings that end in a side tag or hint."""
    out, owner = [], ""
    for i, part in enumerate(path):
        if part[0] != ".":
            owner = part
            if part in SIDE_TAGS:
                out.append(i + 1)
        elif part[1:] in SIDE_HINTS and owner not in WRAPPERS:
            out.append(i + 1)
    return out


def telling_paths(page: list[Block]) -> list[tuple[str, ...]]:
    """The blocks' paths without hints that say nothing: those on ``WRAPPERS``, and side hints on
    elements that hold nearly all of the page's text."""
    held: dict[tuple, int] = {}
    marks = [side_marks(b.path) for b in page]
    for b, ends in zip(page, marks):
        for n in ends:
            if b.path[n - 1][0] == ".":
                held[b.path[:n]] = held.get(b.path[:n], 0) + len(b.text)
    most = WRAPPER_SHARE * sum(len(b.text) for b in page)
    wrapping = {path for path, n in held.items() if n >= most}
    out = []
    for b, ends in zip(page, marks):
        drop = {n - 1 for n in ends if b.path[:n] in wrapping}
        kept, owner = [], ""
        for i, part in enumerate(b.path):
            if part[0] != ".":
                owner = part
            if i not in drop and (part[0] != "." or owner not in WRAPPERS):
                kept.append(part)
        out.append(tuple(kept))
    return out


class MarkupLabeller:
    """All blocks outside side markup; for tables without a page to train on."""

    def label(self, pages: list[list[Block]]) -> list[np.ndarray]:
        return [np.array([not side_marks(path) for path in telling_paths(p)], dtype=bool) for p in pages]


# -------------------------------------------------------------------- vectors
_path_slots: dict[tuple[str, ...], np.ndarray] = {}


def path_vector(path: tuple[str, ...]) -> np.ndarray:
    """Hashed bag of the path's parts and of its two innermost tags, with signs."""
    got = _path_slots.get(path)
    if got is None:
        got = np.zeros(PATH_SIZE)
        tags = [p for p in path if p[0] != "."]
        for part in {*path, *(f"in:{t}" for t in tags[-1:]), *(f"under:{t}" for t in tags[-2:-1])}:
            h = zlib.crc32(part.encode())
            got[h % PATH_SIZE] += 1.0 if h >> 16 & 1 else -1.0
        if len(_path_slots) > 20_000:
            _path_slots.clear()
        _path_slots[path] = got
    return got


def block_vectors(pages: list[list[Block]]) -> np.ndarray:
    """(all blocks of all pages, SIZE): path, words, form."""
    flat = [b for p in pages for b in p]
    out = np.zeros((len(flat), SIZE))
    if not flat:
        return out
    raw = [b.text.encode("utf-8", "replace") for b in flat]
    data = np.frombuffer(b"".join(raw), np.uint8)
    words = find_words(data, np.cumsum([0] + [len(r) for r in raw]))
    slot = (word_hashes(words) >> np.uint64(60)).astype(np.int64) if len(words.starts) else np.zeros(0, np.int64)
    counts = np.bincount(words.text_of() * WORD_SIZE + slot, minlength=len(flat) * WORD_SIZE).reshape(-1, WORD_SIZE)
    out[:, :PATH_SIZE] = [path_vector(path) for p in pages for path in telling_paths(p)]
    out[:, PATH_SIZE:PATH_SIZE + WORD_SIZE] = counts / np.maximum(words.counts, 1)[:, None]
    chars = np.array([len(b.text) for b in flat], dtype=float)
    place = np.concatenate([np.linspace(0, 1, len(p)) for p in pages if p])
    form = out[:, PATH_SIZE + WORD_SIZE:]
    form[:, 0] = np.log1p(chars) / 8
    form[:, 1] = np.array([b.linked for b in flat]) / chars
    form[:, 2] = [sum(b.text.count(c) for c in ".,;:!?") for b in flat] / chars * 10
    form[:, 3] = [b.text[-1] in ".!?:;\"”" for b in flat]
    form[:, PLACE] = place
    form[:, 5] = np.log1p(words.counts) / 6
    form[:, 6] = [b.text[:1].isupper() for b in flat]
    form[:, 7] = 1.0
    return out


# --------------------------------------------------------------------- network
def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


class BlockLabeller:
    """Bidirectional LSTM with a logistic output per block, in numpy."""

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        init = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
        self.p = {}
        for d in "fb":
            self.p |= {f"{d}x": init(SIZE, 4 * HIDDEN), f"{d}h": init(HIDDEN, 4 * HIDDEN), f"{d}c": np.zeros(4 * HIDDEN)}
            self.p[f"{d}c"][HIDDEN:2 * HIDDEN] = 1.0                 # remember at first
        self.p |= {"ox": init(SIZE, 1)[:, 0] * 0.1, "oh": init(2 * HIDDEN, 1)[:, 0], "oc": np.zeros(1)}

    def _run(self, d, x, mask):
        """States of one direction; x: (pages, steps, SIZE), mask: (pages, steps)."""
        n, steps, _ = x.shape
        wide = x @ self.p[f"{d}x"] + self.p[f"{d}c"]
        h, c = np.zeros((n, HIDDEN)), np.zeros((n, HIDDEN))
        states, memo = np.zeros((n, steps, HIDDEN)), []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            a = wide[:, t] + h @ self.p[f"{d}h"]
            gates, new = _sigmoid(a[:, :3 * HIDDEN]), np.tanh(a[:, 3 * HIDDEN:])
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN:2 * HIDDEN], gates[:, 2 * HIDDEN:]
            m = mask[:, t, None]
            memo.append((t, h, c, i, f, o, new))
            c = m * (f * c + i * new) + (1 - m) * c
            h = m * (o * np.tanh(c)) + (1 - m) * h
            states[:, t] = h
        return states, memo

    def logits(self, x, mask):
        forward, fm = self._run("f", x, mask)
        backward, bm = self._run("b", x, mask)
        states = np.concatenate([forward, backward], axis=2)
        return states @ self.p["oh"] + x @ self.p["ox"] + self.p["oc"], states, fm, bm

    def gradients(self, x, mask, y):
        """Gradients of the mean log loss over the blocks."""
        z, states, fm, bm = self.logits(x, mask)
        dz = (_sigmoid(z) - y) * mask / mask.sum()
        g = {"ox": np.einsum("nt,nts->s", dz, x), "oh": np.einsum("nt,nts->s", dz, states), "oc": np.array([dz.sum()])}
        ds = dz[:, :, None] * self.p["oh"]
        for d, memo, own in (("f", fm, ds[:, :, :HIDDEN]), ("b", bm, ds[:, :, HIDDEN:])):
            da_all = np.zeros((x.shape[0], x.shape[1], 4 * HIDDEN))
            gh = np.zeros_like(self.p[f"{d}h"])
            dh, dc = np.zeros((x.shape[0], HIDDEN)), np.zeros((x.shape[0], HIDDEN))
            for t, h, c, i, f, o, new in reversed(memo):
                m = mask[:, t, None]
                dh = dh + own[:, t]
                after = np.tanh(f * c + i * new)
                do, dcell = dh * m * after, dc * m + dh * m * o * (1 - after**2)
                da = np.concatenate([dcell * new * i * (1 - i), dcell * c * f * (1 - f), do * o * (1 - o),
                                     dcell * i * (1 - new**2)], axis=1)
                da_all[:, t] = da
                gh += h.T @ da
                dh = da @ self.p[f"{d}h"].T + dh * (1 - m)
                dc = dcell * f + dc * (1 - m)
            g[f"{d}x"] = np.einsum("nts,nta->sa", x, da_all)
            g[f"{d}h"], g[f"{d}c"] = gh, da_all.sum(axis=(0, 1))
        return g

    def fit(self, examples, seed: int = SEED) -> "BlockLabeller":
        """examples: (vectors, labels) per page.  Adam on padded batches."""
        rng, step = np.random.default_rng(seed), 0
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        for _ in range(EPOCHS):
            order = rng.permutation(len(examples))
            for s in range(0, len(order), BATCH):
                x, mask, y = _padded([examples[k] for k in order[s: s + BATCH]])
                hide = rng.random(len(x))
                x[hide < BLANKED, :, :PATH_SIZE] = 0
                x[hide > 1 - BLANKED, :, PATH_SIZE:PATH_SIZE + WORD_SIZE] = 0
                step += 1
                for k, g in self.gradients(x, mask, y).items():
                    g = np.clip(g, -1, 1)
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.99 * second[k] + 0.01 * g * g
                    self.p[k] = self.p[k] - RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
        return self

    def label(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """Which blocks of each page are main text; pages run grouped by length."""
        vectors = block_vectors(pages)
        at = np.cumsum([0] + [len(p) for p in pages])
        out = [np.zeros(len(p), bool) for p in pages]
        order = sorted((k for k in range(len(pages)) if pages[k]), key=lambda k: len(pages[k]))
        s = 0
        while s < len(order):
            e = s + 1
            while e < len(order) and e - s < 128 and len(pages[order[e]]) * (e - s + 1) <= 20_000:
                e += 1
            x, mask, _ = _padded([(vectors[at[k]: at[k + 1]], None) for k in order[s:e]])
            z = self.logits(x, mask)[0]
            for row, k in enumerate(order[s:e]):
                out[k] = z[row, : len(pages[k])] > 0
            s = e
        return out


def _padded(examples):
    steps = max(len(v) for v, _ in examples)
    x, mask, y = np.zeros((len(examples), steps, SIZE)), np.zeros((len(examples), steps)), np.zeros((len(examples), steps))
    for k, (v, label) in enumerate(examples):
        x[k, : len(v)], mask[k, : len(v)] = v, 1.0
        if label is not None:
            y[k, : len(v)] = label
    return x, mask, y


# -------------------------------------------------------------------- training
class Window(NamedTuple):
    """Blocks of a training page: their paths, words and form (``FORM_SIZE`` facts), labels."""
    paths: list[tuple[str, ...]]
    rest: np.ndarray
    main: np.ndarray


def training_window(page: list[Block], key: int = 0) -> Window | None:
    """The page's window, from a place that the key decides; None without a block marked main in the
    page.  A window of a long page holds a main block or not, as its place has it."""
    main = np.array([marked_main(b.path) for b in page], dtype=bool)
    if not main.any():
        return None
    low = key % max(1, len(page) - WINDOW_BLOCKS + 1)
    pick = slice(low, low + WINDOW_BLOCKS)
    return Window(telling_paths(page)[pick], block_vectors([page])[pick, PATH_SIZE:], main[pick])


def _side_path(rng, path: tuple[str, ...]) -> tuple[str, ...]:
    """A path through a side container, below or beside the given one."""
    keep = path[: rng.integers(1, len(path) + 1)] if path else ()
    if rng.random() < 0.5:
        tag = sorted(SIDE_TAGS - {"header"})[rng.integers(len(SIDE_TAGS) - 1)]
        return (*keep, tag, *(("p",) if rng.random() < 0.5 else ()))
    hint = "." + sorted(SIDE_HINTS)[rng.integers(len(SIDE_HINTS))]
    return (*keep, "div" if rng.random() < 0.7 else "section", hint, *(("p",) if rng.random() < 0.5 else ()))


def _without(path: tuple[str, ...], tags: frozenset, hints: bool, plain: tuple[str, ...]) -> tuple[str, ...]:
    """The path with ``tags`` turned into div (``article`` and ``main`` into ``plain``), and without
    their (or all side) hints."""
    out, owner = [], ""
    for part in path:
        if part[0] != ".":
            owner = part
            out += plain if part in tags and part in MAIN_TAGS else ("div",) if part in tags else (part,)
        elif owner not in tags and not (hints and part[1:] in SIDE_HINTS):
            out.append(part)
    return tuple(out)


def training_examples(windows: list[Window], seed: int = SEED):
    """(vectors, labels) of the windows; most without the markup that gave the labels, some with side
    blocks inserted."""
    rng, out = np.random.default_rng(seed), []
    place = PATH_SIZE + WORD_SIZE + PLACE
    side_tags = sorted(SIDE_TAGS)
    for window in windows:
        paths, rest, main = list(window.paths), list(window.rest), list(window.main)
        bounds = rest[0][WORD_SIZE + PLACE], rest[-1][WORD_SIZE + PLACE]
        gone = MAIN_TAGS if rng.random() < PLAIN_MAIN else frozenset()
        hints = False
        if rng.random() < PLAIN_SIDE:
            gone |= {t for t in side_tags if rng.random() < 0.5}
            hints = rng.random() < 0.3
        # what pages have in its place: a plain container, named or not
        plain = (PLAIN_TAGS[rng.integers(len(PLAIN_TAGS))],
                 *(("." + PLAIN_HINTS[rng.integers(len(PLAIN_HINTS))],) if rng.random() < 0.5 else ()))
        paths = [_without(p, gone, hints, plain) for p in paths]
        if rng.random() < INSERTED:
            for _ in range(rng.integers(*INSERTS)):
                other = windows[rng.integers(len(windows))]
                k, where = rng.integers(len(other.paths)), rng.integers(len(paths) + 1)
                path = _side_path(rng, paths[min(where, len(paths) - 1)])
                run = list(other.rest[k: k + rng.integers(1, 4)])
                paths[where:where], rest[where:where], main[where:where] = [path] * len(run), run, [False] * len(run)
        vectors = np.concatenate([np.array([path_vector(p) for p in paths]), np.array(rest)], axis=1)
        vectors[:, place] = np.linspace(*bounds, len(paths))
        out.append((vectors, np.array(main, dtype=float)))
    return out


# ------------------------------------------------------------------- operator
def _trainable(batches):
    """The prints of pages with a block marked main."""
    for batch in text_slices(batches, column="html"):
        keep = [any(marked_main(b.path) for b in blocks(v)) for v in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep, pa.bool_()))], ["print"])


def _windows(batches):
    """The training windows of chosen pages, packed."""
    for batch in text_slices(batches, column="html"):
        found = [training_window(blocks(v), k) for k, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([[list(p) for p in w.paths] for w in found], pa.list_(pa.list_(pa.string()))),
             pa.array([w.rest.tobytes() for w in found], pa.binary()), pa.array([w.main.tobytes() for w in found], pa.binary())],
            ["print", "paths", "rest", "main"])


def _lowest_prints(rows: DataFrame) -> DataFrame:
    """The SAMPLE_PAGES lowest prints of trainable pages.

    Pages below a bound on the print are parsed; the bound is raised until they are enough or it
    takes in the whole table, so the result is that of parsing every page."""
    share = min(1.0, 4 * SAMPLE_PAGES / max(1, rows.count()))
    while True:
        some = rows if share >= 1 else rows.where(F.col("print") < F.lit(int(-2**63 + share * 2**64)))
        prints = cut_lineage(some.mapInArrow(_trainable, "print long").distinct().orderBy("print").limit(SAMPLE_PAGES), "page_prints")
        if share >= 1 or prints.count() == SAMPLE_PAGES:
            return prints
        share = min(1.0, share * 8)


def fit_labeller(pages: DataFrame, column: str = "html") -> BlockLabeller | MarkupLabeller:
    """Train on at most SAMPLE_PAGES of all pages that can be trained on, in hash order."""
    tags = "|".join(sorted(MAIN_TAGS))
    rows = (pages.select(F.xxhash64("page_id", column).alias("print"), F.col(column).alias("html"))
            .where(F.col("html").rlike(f"(?i)<({tags})")))
    chosen = rows.join(F.broadcast(_lowest_prints(rows)), "print").dropDuplicates(["print"])
    found = (chosen.mapInArrow(_windows, "print long, paths array<array<string>>, rest binary, main binary")
             .orderBy("print").collect())
    windows = [Window([tuple(p) for p in r.paths], np.frombuffer(r.rest).reshape(len(r.paths), -1), np.frombuffer(r.main, bool))
               for r in found]
    return BlockLabeller().fit(training_examples(windows)) if windows else MarkupLabeller()


def extract(pages: DataFrame, labeller: BlockLabeller | MarkupLabeller, column: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every row."""
    def run(batches):
        for batch in text_slices(batches, column="html"):
            split = [blocks(v) for v in batch.column(2).to_pylist()]
            texts = ["\n".join([b.text for b, main in zip(p, labels) if main])
                     for p, labels in zip(split, labeller.label(split))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.col(column).alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op9_query(pages: DataFrame) -> DataFrame:
    return extract(pages, fit_labeller(pages))
