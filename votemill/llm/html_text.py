"""Main text of web pages with a recurrent block labeller.

A page is cut into blocks, the runs of text between block-level tags. Each block becomes a vector of its hashed
tag path (tags, classes, ids and roles of the open elements), its hashed words and a few shape figures; a
bidirectional LSTM in numpy reads the page's blocks in order and labels each with the whole page as context.
Blocks labelled main are joined by a line break.

The network is fitted to TRAIN_PAGES pages at most (the smallest hashes of their ids, a documented parameter):
as they are, with weak labels from their own structure (inside article or main, outside boilerplate elements),
and again with their blocks poured into random layouts, whose labels are known by construction: articles in plain,
named or oddly named containers, in table cells, in a form over the whole page or in none at all, among menus, headers, footers, sidebars,
notices, adverts, forms and reader comments.

Edge cases: a null or empty page has no block, a page without tags is one, which is its text; without any main block the text is empty;
unclosed and stray tags are tolerated (body, or an element that cannot stand in head, ends an open head; a quote opens a
value only after an equals sign); character references are decoded once, after tags were found; pages of any length are read whole; repeated rows get
equal texts; a null page_id or url is carried through; with no page to learn from, layouts are poured from
placeholder words; an empty table gives no row; extra columns are ignored.
"""

from __future__ import annotations

import html
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from votemill.llm.common import first_by_hash, in_batches

TRAIN_PAGES, POURED, EPOCHS, HIDDEN, RATE, SEED = 400, 1200, 10, 20, 0.01, 5
PATH_DIM, WORD_DIM, SHAPE_DIM = 192, 32, 6
DIM = PATH_DIM + WORD_DIM + SHAPE_DIM

#: Elements by their role in HTML.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark meter nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
INLINE |= frozenset("math maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics annotation".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN_TEXT = frozenset("script style template textarea select option button title head svg iframe".split())
HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
#: Elements within running text whose own text is not shown as text: they do not end a block.
QUIET = frozenset("button script style template svg".split())
BOILERPLATE = frozenset("nav header footer aside form dialog menu".split())
OWN_CLOSE = {"p": frozenset(["p"]), "li": frozenset(["li"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "tr": frozenset(["tr", "td", "th"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"])}
BLOCKS_CLOSE_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style)\b[^>]*>.*?(?:</\1\s*>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>=]+|=\s*(?:\"[^\"]*\"|'[^']*'|))*+)>", re.S | re.I)
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)


class Node:
    """A block of text, its path (names of open elements, outermost first) and the characters inside links."""

    __slots__ = ("text", "path", "linked")

    def __init__(self, text: str, path: tuple[str, ...], linked: int):
        self.text, self.path, self.linked = text, path, linked


@lru_cache(4096)
def names(tag: str, attributes: str) -> tuple[str, ...]:
    found = [a or b or c for a, b, c in _NAMED.findall(attributes)] if attributes else []
    return (tag, *(f".{x}" for f in found for x in re.split(r"[\s_-]+", f.lower()) if x))


def blocks(page: str) -> list[Node]:
    out: list[Node] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    state = {"links": 0, "linked": 0, "hidden": 0}

    def flush() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append(Node(text, tuple(n for _, own in stack for n in own), min(state["linked"], len(text))))
            parts.clear()
        state["linked"] = 0

    def close(n: int) -> None:
        for tag, _ in stack[n:]:
            state["links"] -= tag == "a"
            state["hidden"] -= tag in HIDDEN_TEXT
        del stack[n:]

    def open_head(tag: str) -> None:
        """An element that cannot stand in head ends it, and a title left open there; in the head's other hidden elements it does not."""
        head = next((i for i, (t, _) in enumerate(stack) if t == "head"), None)
        inside = [t for t, _ in stack[head + 1 :]] if head is not None else []
        if head is not None and (tag == "body" or not inside or (set(inside) == {"title"} and at > last_title)):
            close(head)

    def text(piece: str) -> None:
        if stack and stack[-1][0] == "head" and piece.strip():
            close(len(stack) - 1)
        if piece and not state["hidden"]:
            parts.append(piece)
            if state["links"] > 0:
                state["linked"] += len(piece.strip())

    at, last_title = 0, page.lower().rfind("</title")
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            text(page[at : m.start()])
        at = m.end()
        tag = m[3]
        if not tag:
            continue
        tag = tag.lower()
        if m[2]:
            where = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
            if tag not in INLINE and tag not in QUIET:
                flush()
            if where is not None and (tag not in INLINE or all(t in INLINE for t, _ in stack[where:])):
                close(where)
            continue
        if tag not in HEAD and stack and state["hidden"]:
            open_head(tag)
        if tag == "br":
            text(" ")
            continue
        if tag not in INLINE and tag not in QUIET:
            flush()
            ends = OWN_CLOSE.get(tag)
            if tag in BLOCKS_CLOSE_P:
                ends = (ends or frozenset()) | {"p"}
            if ends:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] in ends:
                        close(i)
                        break
                    if stack[i][0] not in INLINE:
                        break
        if tag not in VOID and not m[4].rstrip().endswith("/"):
            stack.append((tag, names(tag, m[4])))
            state["links"] += tag == "a"
            state["hidden"] += tag in HIDDEN_TEXT
    if at < len(page):
        text(re.sub(r"<[a-zA-Z/!?][^<>]*\Z", "", page[at:]))
    flush()
    return out


@lru_cache(8192)
def path_vector(path: tuple[str, ...]) -> tuple[tuple[int, float], ...]:
    """Sparse signed hashes of the path's names; inline elements tell little and stay out."""
    got: dict[int, float] = {}
    for name in dict.fromkeys(n for n in path if n not in INLINE):
        for salt in (b"0", b"1"):
            h = zlib.crc32(name.encode() + salt)
            got[h % PATH_DIM] = got.get(h % PATH_DIM, 0.0) + (0.7 if h >> 20 & 1 else -0.7)
    return tuple(got.items())


def vectors(page: list[Node], begin: int = 0, end: int | None = None) -> np.ndarray:
    """A row a block of page[begin:end]."""
    part = page[begin:end]
    x = np.zeros((len(part), DIM), np.float32)
    for i, b in enumerate(part):
        for k, v in path_vector(b.path):
            x[i, k] += v
        words = b.text.lower().split()
        where = np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) % WORD_DIM for w in words), np.int64, len(words))
        x[i, PATH_DIM : PATH_DIM + WORD_DIM] = np.bincount(where, minlength=WORD_DIM) / len(words)
        stops = sum(w[-1] in ".!?" for w in words)
        x[i, PATH_DIM + WORD_DIM :] = (np.log1p(len(words)) / 4, b.linked / len(b.text), stops / len(words), min(stops, 5) / 5, (begin + i) / len(page), 1.0)
    return x


class Lstm:
    """One direction: gates in the order input, forget, output, candidate."""

    def __init__(self, rng: np.random.Generator):
        self.p = {
            "w": rng.normal(0, DIM**-0.5, (DIM, 4 * HIDDEN)).astype(np.float32),
            "u": rng.normal(0, HIDDEN**-0.5, (HIDDEN, 4 * HIDDEN)).astype(np.float32),
            "b": np.repeat(np.array([0, 1, 0, 0], np.float32), HIDDEN),
        }

    def forward(self, x: np.ndarray, mask: np.ndarray, start: tuple | None = None, keep: bool = True):
        """Hidden states of x (batch, time, DIM) from the state start (zero if none); where mask is 0 the state stays.
        Then what the way back needs, if it is to be kept, else the last state."""
        n, steps, _ = x.shape
        z = x.reshape(-1, DIM) @ self.p["w"] + self.p["b"]
        z = z.reshape(n, steps, -1)
        h, c = start or (np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32))
        out, kept = np.zeros((n, steps, HIDDEN), np.float32), []
        for t in range(steps):
            a = z[:, t] + h @ self.p["u"]
            s = 1 / (1 + np.exp(-a[:, : 3 * HIDDEN]))
            g = np.tanh(a[:, 3 * HIDDEN :])
            i, f, o = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :]
            m = mask[:, t : t + 1]
            c_new = f * c + i * g
            tanh = np.tanh(c_new)
            if keep:
                kept.append((h, c, i, f, o, g, tanh))
            c = m * c_new + (1 - m) * c
            h = m * o * tanh + (1 - m) * h
            out[:, t] = h
        return out, kept if keep else (h, c)

    def backward(self, x: np.ndarray, mask: np.ndarray, kept, d_out: np.ndarray) -> dict[str, np.ndarray]:
        n, steps, _ = x.shape
        d_h, d_c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
        d_z, d_u = np.zeros((n, steps, 4 * HIDDEN), np.float32), np.zeros_like(self.p["u"])
        for t in range(steps - 1, -1, -1):
            h, c, i, f, o, g, tanh = kept[t]
            m = mask[:, t : t + 1]
            d_h = d_h + d_out[:, t]
            own = d_h * m
            d_new = d_c * m + own * o * (1 - tanh * tanh)
            d_a = np.concatenate([d_new * g * i * (1 - i), d_new * c * f * (1 - f), own * tanh * o * (1 - o), d_new * i * (1 - g * g)], 1)
            d_z[:, t] = d_a
            d_u += h.T @ d_a
            d_h = d_h * (1 - m) + d_a @ self.p["u"].T
            d_c = d_c * (1 - m) + d_new * f
        flat = d_z.reshape(-1, 4 * HIDDEN)
        return {"w": x.reshape(-1, DIM).T @ flat, "u": d_u, "b": flat.sum(0)}


class Labeller:
    def __init__(self):
        rng = np.random.default_rng(SEED)
        self.ahead, self.back = Lstm(rng), Lstm(rng)
        self.top = {"v": rng.normal(0, 0.1, 2 * HIDDEN).astype(np.float32), "d": np.zeros(1, np.float32)}

    @staticmethod
    def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        steps = max(map(len, pages))
        x = np.zeros((len(pages), steps, DIM), np.float32)
        mask = np.zeros((len(pages), steps), np.float32)
        turn = np.tile(np.arange(steps), (len(pages), 1))
        for i, p in enumerate(pages):
            x[i, : len(p)], mask[i, : len(p)] = p, 1
            turn[i, : len(p)] = np.arange(len(p) - 1, -1, -1)
        return x, mask, turn

    def run(self, pages: list[np.ndarray], keep: bool = True):
        x, mask, turn = self.padded(pages)
        rows = np.arange(len(pages))[:, None]
        one, kept_one = self.ahead.forward(x, mask, keep=keep)
        mirrored = x[rows, turn]
        two, kept_two = self.back.forward(mirrored, mask, keep=keep)
        hidden = np.concatenate([one, two[rows, turn]], 2)
        return self.chance(hidden), (x, mask, turn, rows, mirrored, kept_one, kept_two, hidden)

    def chance(self, hidden: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(hidden @ self.top["v"] + self.top["d"])))

    def long(self, page: list[Node], step: int) -> np.ndarray:
        """As label, of one page; the vectors of step blocks at a time, states carried over."""
        parts = [(a, min(a + step, len(page))) for a in range(0, len(page), step)]
        hidden = np.zeros((len(page), 2 * HIDDEN), np.float32)
        for net, where, order in ((self.ahead, slice(0, HIDDEN), 1), (self.back, slice(HIDDEN, None), -1)):
            state = None
            for a, b in parts[::order]:
                x = vectors(page, a, b)[::order][None]
                out, state = net.forward(x, np.ones(x.shape[:2], np.float32), state, False)
                hidden[a:b, where] = out[0][::order]
        return self.chance(hidden)

    def label(self, pages: list[list[Node]], room: int = 8192) -> list[np.ndarray]:
        """Probability of every block, pages of like length together so that little is padded."""
        out: list[np.ndarray] = [np.zeros(0, np.float32)] * len(pages)
        order = sorted((i for i in range(len(pages)) if len(pages[i])), key=lambda i: len(pages[i]))
        at = 0
        while at < len(order):
            if len(pages[order[at]]) > room:
                out[order[at]] = self.long(pages[order[at]], room)
                at += 1
                continue
            end = at + 1
            while end < len(order) and (end - at + 1) * len(pages[order[end]]) <= room:
                end += 1
            p, _ = self.run([vectors(pages[i]) for i in order[at:end]], False)
            for row, i in enumerate(order[at:end]):
                out[i] = p[row, : len(pages[i])]
            at = end
        return out

    def fit(self, pages: list[np.ndarray], labels: list[np.ndarray]) -> None:
        rng = np.random.default_rng(SEED)
        groups = [self.ahead.p, self.back.p, self.top]
        mean = [{k: np.zeros_like(v) for k, v in g.items()} for g in groups]
        square = [{k: np.zeros_like(v) for k, v in g.items()} for g in groups]
        step = 0
        by_size = sorted(range(len(pages)), key=lambda i: len(pages[i]))
        batches = [by_size[i : i + 16] for i in range(0, len(by_size), 16)]
        for _ in range(EPOCHS):
            for b in rng.permutation(len(batches)):
                own = batches[b]
                p, (x, mask, turn, rows, mirrored, kept_one, kept_two, hidden) = self.run([pages[i] for i in own])
                y = np.zeros_like(p)
                for row, i in enumerate(own):
                    y[row, : len(labels[i])] = labels[i]
                error = (p - y) * mask / mask.sum()
                d_hidden = error[:, :, None] * self.top["v"]
                grads = [
                    self.ahead.backward(x, mask, kept_one, d_hidden[:, :, :HIDDEN]),
                    self.back.backward(mirrored, mask, kept_two, d_hidden[:, :, HIDDEN:][rows, turn]),
                    {"v": (hidden * error[:, :, None]).sum((0, 1)), "d": np.array([error.sum()], np.float32)},
                ]
                step += 1
                for g, d, m, s in zip(groups, grads, mean, square):
                    for k in g:
                        m[k] += 0.1 * (d[k] - m[k])
                        s[k] += 0.01 * (d[k] ** 2 - s[k])
                        g[k] -= RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-6)


def weak_labels(page: list[Node]) -> np.ndarray:
    """1 for blocks in an article or main element and in no boilerplate element within it (its own header apart): what stands
    around the article, such as a form over the whole page, tells nothing."""

    def own(path: tuple[str, ...]) -> bool:
        at = max((i for i, n in enumerate(path) if n in ("article", "main")), default=-1)
        return at >= 0 and not (BOILERPLATE - {"header"}) & set(path[at:])

    return np.array([own(b.path) for b in page], np.float32)


#: How pages name their parts.
MAIN_OPEN = ["<article>", "<main>", '<div class="content">', '<div id="content">', '<div class="post">', '<div class="entry-content">', '<div class="article-body">', '<section class="story">', '<main><article class="post">', '<div id="main-content">', '<div class="text">', "<section>", "<div>"]
OTHER_OPEN = ["<nav>", "<header>", "<footer>", "<aside>", '<div class="ad">', '<div class="advert">', '<div class="sidebar">', '<div id="sidebar">', '<div class="menu">', '<ul class="nav">', '<div class="cookie-notice">', '<div class="notice">', '<div class="banner">', '<div class="promo">', '<div class="newsletter">', "<form>", '<div class="related">', '<div class="share">', '<div class="breadcrumb">', '<div id="footer">', '<div id="header">', '<div class="comments">', '<section id="comments">', '<div class="comment">', '<div class="popup">', '<div role="navigation">', '<div class="widget">', '<aside class="sidebar">', '<div class="sponsored">']
OTHER_OPEN += ['<div id="disqus_thread">', '<div class="reply">', '<div class="replies">', '<ol class="commentlist">', '<div id="respond">', '<div class="legal">', '<div id="legal">', '<div class="copyright">', '<div class="disclaimer">', '<div class="login">', '<form class="login">', '<div class="toolbar">', '<div class="pagination">', '<div class="tags">']
PAGE_FORM = ['<form action="/page" method="post" id="aspnetForm">', "<form>", '<form method="post" class="page-form"><input type="hidden" name="state">']
INNER = ["<p>{}</p>", "<p>{}</p>", "<p>{}</p>", "<p>{}", "<h1>{}</h1>", "<h2>{}</h2>", "<ul><li>{}</li></ul>", "<blockquote>{}</blockquote>", "<div>{}</div>", "<pre>{}</pre>", "<p><b>{}<br><p>", "<table><tr><td>{}</td></tr></table>"]
OTHER_INNER = ["<p>{}</p>", "<div>{}</div>", "<ul><li><a href='/'>{}</a></li></ul>", "<a href='/'>{}</a>", "<span>{}</span>", "{}", "<h3>{}</h3>", "<label>{}</label>"]


def closing(opened: str) -> str:
    return "".join(f"</{t}>" for t in reversed(re.findall(r"<([a-z0-9]+)", opened)))


def poured(texts: list[str], rng: np.random.Generator) -> tuple[str, set[str]]:
    """A page of a random layout, and the marks that its main blocks carry."""
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    main, count = set(), 0

    def block(template: str, words: str, is_main: bool) -> str:
        nonlocal count
        count += 1
        mark = f"zz{count}zz"
        if is_main:
            main.add(mark)
        return template.format(f"{mark} {html.escape(words, quote=False)}")

    def named() -> str:
        """A container whose name tells nothing."""
        name = "".join(pick("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(int(rng.integers(2, 9))))
        return pick(['<div class="x{}">', '<div id="x{}">', '<section class="x{}">', "<div>"]).format(name)

    def other() -> str:
        kind = rng.random()
        # A container without a telling name, or a table, has links and labels; others may have sentences, too.
        opened = named() if kind < 0.25 else "<table><tr>" if kind < 0.32 else pick(OTHER_OPEN)
        cells, short = opened == "<table><tr>", kind < 0.32
        inside = []
        for _ in range(int(rng.integers(1, 6))):
            words = pick(texts).split()
            keep = int(rng.integers(1, 4)) if short else int(rng.integers(1, 9)) if rng.random() < 0.6 else int(rng.integers(5, 60))
            template = pick(["<td>{}</td>", "<td><a href='/'>{}</a></td>"]) if cells else pick(OTHER_INNER)
            inside.append(block(template, " ".join(words[:keep]).rstrip(".,") if short else " ".join(words[:keep]), False))
        return opened + "".join(inside) + closing(opened)

    layout = rng.random()
    opened = "" if layout < 0.08 else "<table><tr><td>" if layout < 0.16 else named() if layout < 0.38 else pick(MAIN_OPEN)
    heading = "<header><h1>{}</h1></header>" if rng.random() < 0.2 else "<h1>{}</h1>"
    body = [block(heading, " ".join(pick(texts).split()[:8]), True)] if rng.random() < 0.8 else []
    for _ in range(int(rng.integers(1, 12))):
        body.append(block(pick(INNER), pick(texts), True))
        if opened and rng.random() < 0.08:
            body.append(other())
    around = lambda: [other() for _ in range(int(rng.integers(0, 4)))]
    page = [*around(), opened, *body, closing(opened), *around()] if opened or rng.random() < 0.5 else body
    if opened == "<table><tr><td>":
        side = around() if rng.random() < 0.4 else [block(pick(["<p>{}</p>", "<a href='/'>{}</a><br>", "<div>{}</div>"]), " ".join(pick(texts).split()[: int(rng.integers(1, 4))]).rstrip(".,"), False) for _ in range(int(rng.integers(1, 7)))]
        page = ["<table><tr><td>", *side, "</td><td>", *body, "</td></tr></table>"]
    if rng.random() < 0.3:
        page = ['<div class="wrapper">', *page, "</div>"]
    if rng.random() < 0.15:
        page = [pick(PAGE_FORM), *page, "</form>"]
    return "<html><body>" + "".join(page) + "</body></html>", main


def train(pages: list[str]) -> Labeller:
    rng = np.random.default_rng(SEED)
    parsed = [b for b in map(blocks, pages) if b]
    texts = [n.text for b in parsed for n in b] or ["some words of text, to fill a page. And more of them."]
    samples, labels = [vectors(b) for b in parsed], [weak_labels(b) for b in parsed]
    useful = [i for i, y in enumerate(labels) if y.any()]  # no article or main element: nothing to learn from structure
    samples, labels = [samples[i] for i in useful], [labels[i] for i in useful]
    for _ in range(POURED):
        page, main = poured(texts, rng)
        own = blocks(page)
        y = np.array([n.text.split()[0] in main for n in own], np.float32)
        for n in own:
            n.text = n.text.split(" ", 1)[1] if " " in n.text else n.text
        samples.append(vectors(own))
        labels.append(y)
    model = Labeller()
    model.fit(samples, labels)
    return model


def extract(model: Labeller, pages: list[str | None]) -> list[str]:
    parsed = [blocks(p or "") for p in pages]
    found = model.label(parsed)
    plain = [all(not n.path for n in b) for b in parsed]
    return ["\n".join(n.text for n, q in zip(b, p) if whole or q >= 0.5) for b, p, whole in zip(parsed, found, plain)]


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    chosen = first_by_hash(pages.filter(F.length("html") > 0).select("page_id"), "page_id", TRAIN_PAGES).distinct()
    # Of rows that share an id, the one with the smallest hash: TRAIN_PAGES rows at most, the same in any order of rows.
    sample = pages.filter(F.length("html") > 0).join(F.broadcast(chosen), "page_id").groupBy("page_id").agg(F.min_by("html", F.xxhash64("html")).alias("html"))
    model = pages.sparkSession.sparkContext.broadcast(train([r[1] for r in sorted(sample.collect())]))

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                texts = extract(model.value, part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return in_batches(pages, run, "page_id long, url string, text string, n_chars long")
