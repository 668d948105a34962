"""Main text of web pages by a recurrent block labeller.

A page is cut into leaf blocks, each with the path of its tags, the words of their class, id and
role attributes, and its text. A bidirectional LSTM in numpy reads one vector a block (hashed path,
hashed words, sizes) over the whole page and labels every block as article or not. It is trained
here, on pages drawn from a generator of layouts, whose labels are known by construction and a
part of whose containers have no telling names, and on a bounded sample of windows of the table's
own pages, labelled by what their containers are called.

Paths are kept as nodes that know the features of all that is above them, so a block costs the
same however deep it lies; no tag is read twice. Long pages pass the network in chunks of CHUNK
blocks whose states are carried on, in both directions, so vectors never exist for a whole page.

Edge cases: null, empty and markup-free html give what their text is labelled as, an empty string
if there is none; broken markup, unclosed tags, quotes and comments and stray ends are read as
browsers do, roughly; pages of any length are read whole; repeated rows are read one by one; an
empty table trains on generated pages alone; other columns of the table are not looked at.
"""

from __future__ import annotations

import random
import re
from functools import lru_cache
from html import unescape
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauseforge.llm.common import bounded_batches, quoted

PATH_DIM, LEAF_DIM, WORD_DIM, SIZE_DIM = 128, 32, 16, 4
DIM = PATH_DIM + LEAF_DIM + WORD_DIM + SIZE_DIM
HIDDEN = 12
#: Training reads every page twice, the second time with all containers as nameless div elements.
#: Labelled rows: windows of WINDOW blocks, at most so many, from at most so many pages of the table.
FIT_PAGES, FIT_WINDOWS, WINDOW = 160, 320, 96
#: Generated pages that are trained on.
GENERATED = 320
EPOCHS = 10
#: Blocks whose vectors exist at once.
CHUNK = 16_384

#: A tag that the end of the page cuts off is read up to there, so no search starts twice.
VALUE = r"=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>]*+)"
TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>=]++|{VALUE})*+)(?:>|\Z)|<(?:[!?]|/(?![a-zA-Z]))[^>]*+(?:>|\Z)", re.S)
NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
#: Elements that break a block, that have no end tag, and whose content is no text.
BREAKING = set("address article aside blockquote body br button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style title textarea noscript template svg iframe object".split())
#: What a tag of each kind ends when it opens.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = set("article aside blockquote body details div fieldset figure footer form header html main nav ol section table td th ul".split())
#: Containers that a page may as well write as div.
CONTAINERS = set("article aside footer header main nav section".split())
#: Container names of the parts of a page that are not its article.
OTHER_TAGS = set("nav header footer aside form button select dialog menu".split())
OTHER_NAMES = set("ad ads advert advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies discussion disqus footer form header login masthead menu nav navbar navigation newsletter notice pagination popup promo promoted promotion related replies respond search share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget".split())


@lru_cache(maxsize=4096)
def path_bit(word: str) -> int:
    return 1 << crc32(word.encode()) % PATH_DIM


def unnamed(tag: str) -> str:
    return "div" if tag in CONTAINERS else tag


class Node:
    """An open element: its tag, and what it and those above it add to a block's vector."""

    __slots__ = ("tag", "mask", "plain", "depth", "linked", "other")

    def __init__(self, above: "Node | None" = None, tag: str = "", names=()):
        self.tag = tag
        self.mask = above.mask | path_bit(tag) if above else 0
        for name in names:
            self.mask |= path_bit("." + name)
        #: The path if containers told nothing.
        self.plain = above.plain | path_bit(unnamed(tag)) if above else 0
        self.depth = above.depth + 1 if above else 0
        self.linked = bool(above) and (above.linked or tag == "a")
        self.other = bool(above) and (above.other or tag in OTHER_TAGS or not OTHER_NAMES.isdisjoint(names))


class Path:
    """The open elements; where each tag is open is known without a search."""

    def __init__(self):
        self.nodes = [Node()]
        self.open: dict[str, list[int]] = {}

    def push(self, tag: str, names) -> None:
        self.open.setdefault(tag, []).append(len(self.nodes))
        self.nodes.append(Node(self.nodes[-1], tag, names))

    def cut(self, at: int) -> None:
        while len(self.nodes) > at:
            self.open[self.nodes.pop().tag].pop()

    def last(self, tags) -> int:
        """The place of the innermost open element of the tags; 0 if there is none."""
        return max((where[-1] for t in tags if (where := self.open.get(t))), default=0)

    def begin(self, tag: str) -> None:
        """Ends what an opening tag ends: the innermost of its kind, unless something between holds it."""
        if ends := CLOSES.get(tag):
            at = self.last(ends)
            if at and at >= self.last(SCOPE - {"td", "th"} if tag in ("tr", "td", "th") else SCOPE):
                self.cut(at)

    def end(self, tag: str) -> None:
        at = self.last((tag,))
        if at and (tag in BREAKING or at >= self.last(SCOPE)):
            self.cut(at)


@lru_cache(maxsize=64)
def raw_end(tag: str):
    return re.compile(rf"</{tag}(?=[\s/>])[^>]*+(?:>|\Z)", re.I)


def blocks(html: str | None) -> list[tuple[Node, str, str]]:
    """Leaf blocks (innermost element, its tag, text) in page order."""
    out: list[tuple] = []
    path, text, where = Path(), [], None

    def close() -> None:
        if text:
            body = " ".join(unescape("".join(text)).split())
            if body:
                out.append((where, where.tag, body))
            text.clear()

    at, html = 0, html or ""
    while True:
        m = TOKEN.search(html, at)
        piece = html[at : m.start()] if m else html[at:]
        if text or piece.strip():
            if not text:
                where = path.nodes[-1]
            text.append(piece)
        if m is None:
            break
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if tag in BREAKING:
            close()
        if m[1]:
            path.end(tag)
        elif tag in RAW:
            if not m[3].endswith("/"):
                end = raw_end(tag).search(html, at)
                at = end.end() if end else len(html)
        else:
            path.begin(tag)
            if tag not in VOID:
                path.push(tag, [w for g in NAMES.findall(m[3]) for w in re.split(r"[^a-z0-9]+", "".join(g).lower()) if w] if m[3] else ())
    close()
    return out


def named_article(block) -> bool:
    """The label that the containers' names suggest; for training only."""
    return not block[0].other


def vectors(page: list[tuple], plain: bool = False) -> np.ndarray:
    """One row a block; the last four numbers are sizes and whether the block is linked.

    ``plain``: as if all containers were nameless div elements.
    """
    x = np.zeros((len(page), DIM), np.float32)
    if page:
        masks = np.frombuffer(b"".join((node.plain if plain else node.mask).to_bytes(PATH_DIM // 8, "little") for node, _, _ in page), np.uint8)
        x[:, :PATH_DIM] = np.unpackbits(masks.reshape(len(page), -1), axis=1, bitorder="little")
    for i, (node, tag, text) in enumerate(page):
        x[i, PATH_DIM + crc32((unnamed(tag) if plain else tag).encode()) % LEAF_DIM] = 1
        words = text.split(" ")
        hashed = np.fromiter((crc32(w.encode()) % WORD_DIM for w in words), np.int64, len(words))
        x[i, PATH_DIM + LEAF_DIM : -SIZE_DIM] = 0.25 * np.bincount(hashed, minlength=WORD_DIM) / len(words)
        x[i, -SIZE_DIM:] = np.log1p(len(words)) / 8, min(node.depth, 64) / 16, node.linked, text[-1] in ".!?"
    return x


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """Weights of both directions (input, recurrent, bias) and of the output."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        draw = lambda *s: rng.normal(0, 0.1, s).astype(np.float32)
        self.w = [draw(DIM, 4 * HIDDEN), draw(HIDDEN, 4 * HIDDEN), np.zeros(4 * HIDDEN, np.float32), draw(DIM, 4 * HIDDEN), draw(HIDDEN, 4 * HIDDEN), np.zeros(4 * HIDDEN, np.float32), draw(2 * HIDDEN), np.zeros(1, np.float32)]
        for b in (self.w[2], self.w[5]):
            b[HIDDEN : 2 * HIDDEN] = 1

    def direction(self, x: np.ndarray, mask: np.ndarray, w: list[np.ndarray], keep: list | None = None, state: list | None = None) -> np.ndarray:
        """Hidden states of a batch (pages, blocks, DIM) read from left to right; padding leaves the state as it is.

        ``state`` holds where an earlier part of the pages ended, and then where this one does.
        """
        pages, n, _ = x.shape
        h, c = state or (np.zeros((pages, HIDDEN), np.float32), np.zeros((pages, HIDDEN), np.float32))
        fed, out = x @ w[0] + w[2], np.zeros((pages, n, HIDDEN), np.float32)
        for t in range(n):
            gates = fed[:, t] + h @ w[1]
            s = sigmoid(gates[:, : 3 * HIDDEN])
            i, f, o = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :]
            g, m = np.tanh(gates[:, 3 * HIDDEN :]), mask[:, t : t + 1]
            before, was = c, h
            c = np.where(m, f * before + i * g, before)
            h = np.where(m, o * np.tanh(c), was)
            out[:, t] = h
            if keep is not None:
                keep.append((i, f, o, g, before, was, c, m))
        if state is not None:
            state[:] = h, c
        return out

    def scores(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        ahead = self.direction(x, mask, self.w[:3])
        back = self.direction(x[:, ::-1], mask[:, ::-1], self.w[3:6])[:, ::-1]
        return np.concatenate([ahead, back], 2) @ self.w[6] + self.w[7]

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        kept: list[list] = [[], []]
        ahead = self.direction(x, mask, self.w[:3], kept[0])
        back = self.direction(x[:, ::-1], mask[:, ::-1], self.w[3:6], kept[1])[:, ::-1]
        both = np.concatenate([ahead, back], 2)
        error = (sigmoid(both @ self.w[6] + self.w[7]) - y) * mask / max(mask.sum(), 1)
        out = [None] * 6 + [np.einsum("pt,pth->h", error, both), error.sum(keepdims=True)[0]]
        for side in (0, 1):
            w, steps = self.w[3 * side : 3 * side + 3], kept[side]
            seen = x if side == 0 else x[:, ::-1]
            push = error[:, :, None] * self.w[6][side * HIDDEN : (side + 1) * HIDDEN]
            push = push if side == 0 else push[:, ::-1]
            dh, dc = np.zeros_like(push[:, 0]), np.zeros_like(push[:, 0])
            dgates, drec = np.zeros((*seen.shape[:2], 4 * HIDDEN), np.float32), np.zeros_like(w[1])
            for t in range(len(steps) - 1, -1, -1):
                i, f, o, g, before, was, c, m = steps[t]
                dh = dh + push[:, t]
                tc = np.tanh(c)
                dcell = dc + dh * o * (1 - tc * tc)
                d = np.concatenate([dcell * g * i * (1 - i), dcell * before * f * (1 - f), dh * tc * o * (1 - o), dcell * i * (1 - g * g)], 1) * m
                dgates[:, t] = d
                drec += was.T @ d
                dh = np.where(m, d @ w[1].T, dh)
                dc = np.where(m, dcell * f, dc)
            flat = dgates.reshape(-1, 4 * HIDDEN)
            out[3 * side : 3 * side + 3] = [seen.reshape(-1, DIM).T @ flat, drec, flat.sum(axis=0)]
        return out

    def train(self, pages: list[tuple[np.ndarray, np.ndarray]], epochs: int = EPOCHS, rate: float = 0.02, seed: int = 7) -> None:
        """Adam on the logistic loss, in batches of pages of like length."""
        order = sorted(range(len(pages)), key=lambda k: len(pages[k][0]))
        batches = [batch([pages[k] for k in order[a : a + 32]]) for a in range(0, len(order), 32)]
        first, second, step, rng = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w], 0, random.Random(seed)
        for _ in range(epochs):
            rng.shuffle(batches)
            for x, mask, y in batches:
                step += 1
                for w, g, a, b in zip(self.w, self.gradients(x, mask, y), first, second):
                    g = np.clip(g, -1, 1) + 1e-4 * w
                    a += 0.1 * (g - a)
                    b += 0.01 * (g * g - b)
                    w -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)

    def scored(self, pages: list[list[tuple]], chunk: int = CHUNK) -> np.ndarray:
        """Scores (pages, blocks) of pages read together, in parts of ``chunk`` blocks, forth and back."""
        n = max(map(len, pages))
        total = np.full((len(pages), n), self.w[7][0], np.float32)
        starts, part = range(0, n, chunk), None
        for back in (False, True):
            state: list = []
            for a in reversed(starts) if back else starts:
                if part is None or len(starts) > 1:
                    rows = [p[a : a + chunk] for p in pages]
                    part = batch([(vectors(p), np.zeros(len(p), np.float32)) for p in rows])[:2]
                x, mask = (y[:, ::-1] for y in part) if back else part
                h = self.direction(x, mask, self.w[3:6] if back else self.w[:3], state=state)
                total[:, a : a + chunk] += (h[:, ::-1] if back else h) @ self.w[6][HIDDEN * back : HIDDEN * (back + 1)]
        return total

    def label(self, pages: list[list[tuple]]) -> list[np.ndarray]:
        """For each page which blocks are article; pages of like length are read together."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = sorted((k for k in range(len(pages)) if pages[k]), key=lambda k: len(pages[k]))
        a = 0
        while a < len(order):
            b = a + 1
            while b < len(order) and b - a < 256 and (b - a + 1) * len(pages[order[b]]) <= CHUNK:
                b += 1
            good = self.scored([pages[k] for k in order[a:b]]) > 0
            for n, k in enumerate(order[a:b]):
                out[k] = good[n, : len(pages[k])]
            a = b
        return out


def batch(pages: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = max(len(x) for x, _ in pages)
    x, mask, y = np.zeros((len(pages), n, DIM), np.float32), np.zeros((len(pages), n), bool), np.zeros((len(pages), n), np.float32)
    for k, (a, b) in enumerate(pages):
        x[k, : len(a)], mask[k, : len(a)], y[k, : len(b)] = a, True, b
    return x, mask, y


def generated(n: int, seed: int = 11, plain: float = 0.25, other_names: list[str] | None = None) -> list[tuple[list[tuple], list[bool]]]:
    """Pages of random layout with the true label of every block.

    A share ``plain`` of the containers has a made-up name or none, so that what is learnt is not a
    list of names alone; ``other_names``: names to use instead, for layouts that were not trained on.
    """
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["ba", "ke", "lo", "mi", "nu", "ra", "se", "ti", "vo", "st", "an", "er"]) for _ in range(rng.randint(1, 4)))
    prose = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b))) + rng.choice([".", ".", ".", "!", "?", ""])
    out = []
    for _ in range(n):
        page: list[tuple] = []
        labels: list[bool] = []

        def put(good: bool, tags: list[str], names: list[str], text: str) -> None:
            node = Node(Node(Node(), "html"), "body")
            for k, tag in enumerate(tags):
                node = Node(node, tag, names if k == 0 else ())
            page.append((node, node.tag, text))
            labels.append(good)

        def other(kinds: list[tuple[str, str]]) -> None:
            tag, name = rng.choice(kinds)
            wrap = rng.choice([[], ["div"], ["article"]]) if name in ("comment", "comments", "share", "related", "ad", "newsletter") else rng.choice([[], ["div"]])
            if name and other_names:
                name = rng.choice(other_names)
            elif rng.random() < plain:
                name, tag = rng.choice(["", word(), word()]), rng.choice(["div", "section", tag])
            leaves = [["ul", "li", "a"], ["a"], ["ul", "li", "a"]] if not name and tag in ("div", "section") else [["p"], ["ul", "li", "a"], ["div"], ["a"], [], ["h2"]]
            for _ in range(rng.randint(1, 6)):
                leaf = rng.choice(leaves)
                put(False, [*wrap, tag, *leaf], [name] * bool(name), prose(1, 5) if "a" in leaf else prose(1, 25))

        for _ in range(rng.randint(1, 4)):
            other([("nav", ""), ("header", ""), ("div", "header"), ("div", "menu"), ("div", "ad"), ("div", "ad"), ("div", "cookie"), ("div", "notice"), ("aside", ""), ("form", "")])
        body = rng.choice([["article"], ["article"], ["main"], ["main", "article"], ["div", "article"], ["div"], ["div"], ["div", "div"], ["section"], ["td"]])
        named = rng.choice([[], [], ["content"], ["post", "body"], ["entry"], [word()]])
        for k in range(rng.randint(1, 30)):
            leaf = ["h1"] if k == 0 else rng.choice([["p"]] * 8 + [["p", "b"], ["h2"], ["ul", "li"], ["blockquote"], ["p", "a"], []])
            put(True, [*body, *leaf], named, prose(1, 8) if leaf in (["h1"], ["h2"]) else prose(1, 80))
            if rng.random() < 0.05:
                other([("div", "ad"), ("aside", ""), ("div", "related"), ("div", "share"), ("div", "newsletter")])
        for _ in range(rng.randint(1, 4)):
            other([("footer", ""), ("div", "footer"), ("section", "comments"), ("div", "comment"), ("aside", ""), ("div", "sidebar"), ("form", ""), ("div", "promo"), ("div", "related")])
        out.append((page, labels))
    return out


def _windows(batches):
    """(h, html) -> windows (h, x, y): vectors and named labels of WINDOW blocks, in an order drawn by hash."""
    for part in batches:
        for h, html in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
            page = blocks(html)
            for a in range(0, len(page), WINDOW):
                mine = page[a : a + WINDOW]
                x, plain, y = vectors(mine), vectors(mine, True), np.array([named_article(b) for b in mine], np.float32)
                yield pa.RecordBatch.from_arrays([pa.array([crc32(f"{h} {a}".encode())], pa.int64()), *(pa.array([v.tobytes()], pa.binary()) for v in (x, plain, y))], names=["h", "x", "plain", "y"])


def fit(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", fit_pages: int = FIT_PAGES) -> Labeller:
    """A labeller trained on generated pages and on windows of up to ``fit_pages`` rows of the table.

    Ids are hashed into ``fit_pages`` buckets and each gives the page of its least hash, so that
    there is a sample however many rows there are; of its windows FIT_WINDOWS are drawn.
    """
    rows = pages.select(F.xxhash64(quoted(id_col).cast("string")).alias("h"), quoted(html_col).alias("html"))
    # One row a bucket, which is what is broadcast.
    least = rows.groupBy(F.pmod("h", F.lit(fit_pages)).alias("bucket")).agg(F.min("h").alias("h")).select("h")
    drawn = rows.join(F.broadcast(least), "h", "left_semi").groupBy("h").agg(F.min("html").alias("html"))
    windows = drawn.mapInArrow(_windows, "h long, x binary, plain binary, y binary").sort("h", "x").limit(FIT_WINDOWS).collect()
    known = [(np.frombuffer(v, np.float32).reshape(-1, DIM), np.frombuffer(r.y, np.float32)) for r in windows for v in (r.x, r.plain)]
    drawn = [(vectors(p, plain), np.array(y, np.float32)) for p, y in generated(GENERATED) for plain in (False, True)]
    model = Labeller()
    model.train([*drawn, *known])
    return model


def _extract(model):
    def run(batches):
        for part in batches:
            pages = [blocks(h) for h in part.column(2).to_pylist()]
            texts = ["\n".join(b[2] for b, good in zip(p, keep) if good) for p, keep in zip(pages, model.value.label(pages))]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["id", "url", "text", "n_chars"])

    return run


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", model: Labeller | None = None) -> DataFrame:
    """(id, url, text, n_chars) per row of ``pages``."""
    spark = pages.sparkSession
    bounded_batches(spark)
    model = model or fit(pages, id_col, html_col)
    kept = pages.select(quoted(id_col).cast("long").alias("id"), quoted(url_col).alias("url"), quoted(html_col).alias("html"))
    rows = kept.mapInArrow(_extract(spark.sparkContext.broadcast(model)), "id long, url string, text string, n_chars long")
    return rows.withColumnRenamed("id", id_col).withColumnRenamed("url", url_col)
