"""Main text of web pages: a recurrent labeller over the leaf blocks of the whole page."""

from __future__ import annotations

import random
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliary.llm.blocks_of_html import Leaf, leaves
from foliary.llm.words import Words

# Pages that teach and their bytes in all, the bounds of what reaches the driver; blocks of a training sequence and
# sequences of a page, whatever its size; copies of a page.
SAMPLE_PAGES, SAMPLE_BYTES, SAMPLE_BLOCKS, SEQUENCES, COPIES = 100, 8 << 20, 64, 6, 5
PATH_CELLS, WORD_CELLS, SHAPE = 192, 48, 6
WIDTH = PATH_CELLS + WORD_CELLS + SHAPE
HIDDEN = 16
ROUNDS, LEARNING_RATE = 9, 0.01
PAGES_AT_ONCE = 64

# Names that mark what is not the article.
ASIDE_TAGS = frozenset("nav footer aside form button select option menu dialog fieldset legend".split())
ASIDE_NAMES = frozenset(
    "ad ads advert advertisement banner sponsor sponsored promo sidebar side menu nav navigation breadcrumb breadcrumbs footer"
    " header masthead cookie cookies notice consent gdpr popup modal overlay newsletter subscribe share sharing social related"
    " recommended comment comments reply replies disqus widget login search pagination pager copyright legal toolbar tags hidden"
    .split()
)
MAIN_NAMES = frozenset("article main content post entry story body".split())
PLAIN_ASIDES = ("aside", "header", "form", "nav", "footer", "aside")
NAMES_OF_ASIDES = sorted(ASIDE_NAMES)


@lru_cache(maxsize=100_000)
def path_cells(mark: str) -> tuple[int, ...]:
    """Cells of a path step: its tag, and each of its names."""
    return tuple(zlib.crc32(part.encode()) % PATH_CELLS for part in mark.split("."))


def features(blocks: list[Leaf]) -> np.ndarray:
    """One row per block: hashed steps of the tag path, hashed words, and the shape of the text."""
    found = np.zeros((len(blocks), WIDTH), np.float32)
    if not blocks:
        return found
    raw = [b.text.encode("utf-8", "replace") for b in blocks]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    words = Words(np.frombuffer(b"".join(raw), np.uint8), offsets)
    cell = words.text_of_word() * WORD_CELLS + (words.hashes(lower=True) % np.uint64(WORD_CELLS)).astype(np.int64)
    counts = np.bincount(cell, minlength=len(blocks) * WORD_CELLS).reshape(len(blocks), WORD_CELLS)
    found[:, PATH_CELLS: PATH_CELLS + WORD_CELLS] = counts / np.maximum(1, np.linalg.norm(counts, axis=1, keepdims=True))
    for i, block in enumerate(blocks):
        for mark in block.path:
            for at in path_cells(mark):
                found[i, at] = 1
        size = len(block.text)
        found[i, -SHAPE:] = (
            np.log1p(size) / 8, np.log1p(words.count[i]) / 6, block.linked / max(1, size), i / len(blocks),
            block.text[-1] in ".!?", len(block.path) / 12,
        )
    return found


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """Bidirectional LSTM with one probability per block. Sequences are padded; a pad follows the real blocks."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.p: dict[str, np.ndarray] = {}
        for way in ("f", "b"):
            self.p[f"w{way}"] = rng.normal(0, 0.1, (WIDTH, 4 * HIDDEN)).astype(np.float32)
            self.p[f"u{way}"] = rng.normal(0, 0.1, (HIDDEN, 4 * HIDDEN)).astype(np.float32)
            self.p[f"c{way}"] = np.zeros(4 * HIDDEN, np.float32)
            self.p[f"c{way}"][HIDDEN: 2 * HIDDEN] = 1
        self.p["o"] = rng.normal(0, 0.1, (2 * HIDDEN, 1)).astype(np.float32)
        self.p["d"] = np.zeros(1, np.float32)

    def one_way(self, x: np.ndarray, way: str):
        steps, pages, _ = x.shape
        gates = (x.reshape(-1, WIDTH) @ self.p[f"w{way}"]).reshape(steps, pages, -1) + self.p[f"c{way}"]
        state, memory = np.zeros((pages, HIDDEN), np.float32), np.zeros((pages, HIDDEN), np.float32)
        states = np.zeros((steps + 1, pages, HIDDEN), np.float32)
        memories = np.zeros_like(states)
        for t in range(steps):
            g = gates[t] + state @ self.p[f"u{way}"]
            g[:, : 3 * HIDDEN] = sigmoid(g[:, : 3 * HIDDEN])
            g[:, 3 * HIDDEN:] = np.tanh(g[:, 3 * HIDDEN:])
            memory = g[:, HIDDEN: 2 * HIDDEN] * memory + g[:, :HIDDEN] * g[:, 3 * HIDDEN:]
            state = g[:, 2 * HIDDEN: 3 * HIDDEN] * np.tanh(memory)
            gates[t], states[t + 1], memories[t + 1] = g, state, memory
        return states, memories, gates

    def back(self, x, way, states, memories, gates, slope, grads) -> None:
        steps = len(x)
        d_state, d_memory = np.zeros_like(slope[0]), np.zeros_like(slope[0])
        d_gates = np.zeros_like(gates)
        for t in range(steps - 1, -1, -1):
            i, f, o, c = (gates[t][:, k * HIDDEN: (k + 1) * HIDDEN] for k in range(4))
            d_state = d_state + slope[t]
            bent = np.tanh(memories[t + 1])
            d_memory = d_memory + d_state * o * (1 - bent**2)
            d_gates[t] = np.concatenate([
                d_memory * c * i * (1 - i), d_memory * memories[t] * f * (1 - f), d_state * bent * o * (1 - o),
                d_memory * i * (1 - c**2),
            ], axis=1)
            d_memory = d_memory * f
            d_state = d_gates[t] @ self.p[f"u{way}"].T
        flat = d_gates.reshape(-1, 4 * HIDDEN)
        grads[f"w{way}"] = x.reshape(-1, WIDTH).T @ flat
        grads[f"u{way}"] = states[:-1].reshape(-1, HIDDEN).T @ flat
        grads[f"c{way}"] = flat.sum(axis=0)

    def run(self, x: np.ndarray, sizes: np.ndarray):
        steps, pages, _ = x.shape
        turned = np.arange(steps)[:, None].repeat(pages, axis=1)
        turned = np.where(turned < sizes, sizes - 1 - turned, turned)
        column = np.arange(pages)
        x_back = x[turned, column]
        forth, back = self.one_way(x, "f"), self.one_way(x_back, "b")
        both = np.concatenate([forth[0][1:], back[0][1:][turned, column]], axis=2)
        chance = sigmoid((both @ self.p["o"])[:, :, 0] + self.p["d"])
        return chance, both, forth, back, x_back, turned

    def learn(self, pages: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """Adam steps on the cross entropy of all blocks."""
        rng = np.random.default_rng(7)
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        for _ in range(ROUNDS):
            order = rng.permutation(len(pages))
            for begin in range(0, len(order), 32):
                some = [pages[i] for i in order[begin: begin + 32]]
                x, sizes = padded([f for f, _ in some])
                truth = np.zeros(x.shape[:2], np.float32)
                real = np.arange(len(x))[:, None] < sizes
                for i, (_, label) in enumerate(some):
                    truth[: len(label), i] = label
                chance, both, forth, back, x_back, turned = self.run(x, sizes)
                wrong = np.where(real, chance - truth, 0)[:, :, None] / real.sum()
                grads = {"o": both.reshape(-1, 2 * HIDDEN).T @ wrong.reshape(-1, 1), "d": wrong.sum(axis=(0, 1))}
                slope = wrong @ self.p["o"].T
                self.back(x, "f", *forth, slope[:, :, :HIDDEN], grads)
                self.back(x_back, "b", *back, slope[:, :, HIDDEN:][turned, np.arange(x.shape[1])], grads)
                step += 1
                for k, g in grads.items():
                    g = np.clip(g, -1, 1)
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    self.p[k] -= (
                        LEARNING_RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
                    ).astype(np.float32)


def padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(r) for r in rows])
    x = np.zeros((int(sizes.max()), len(rows), WIDTH), np.float32)
    for i, r in enumerate(rows):
        x[: len(r), i] = r
    return x, sizes


def taught_label(block: Leaf) -> bool:
    """What the markup itself says of a block: the article, unless a step of its path names something else.

    A header inside an article is its head line and belongs to it.
    """
    main = False
    for mark in block.path:
        tag, *names = mark.split(".")
        if tag == "header" and main:
            names = [n for n in names if n != "header"]
        if tag in ASIDE_TAGS or ASIDE_NAMES.intersection(names) or (tag == "header" and not main):
            return False
        main = main or tag in ("article", "main") or bool(MAIN_NAMES.intersection(names))
    return main


# Parts put into copies of the teaching pages: what is not the article, and forms that an article's text takes.
EXTRA = (
    "<{t}><p>{0}</p><p>{1}</p></{t}>", "<{t}><p>{0}</p></{t}>", "<{t}>{0}</{t}>", "<{t}><ul><li><a>{2}</a></li><li><a>{1}</a></li></ul></{t}>",
    "<{t}><h3>{2}</h3><div><p>{0}</p><p>{1}</p></div></{t}>", "<{t}><span>{2}</span><a>{2}</a></{t}>",
    "<{t}><label>{2}</label><p>{0}</p><button>{2}</button></{t}>",
)
INSIDE = (
    "<p>{0}</p>", "<ul><li>{0}</li><li>{1}</li></ul>", "<h2>{2}</h2>", "<blockquote><p>{0}</p></blockquote>",
    "<table><tr><td>{2}</td><td>{0}</td></tr></table>", "<ol><li>{0}</li><li>{2}</li></ol>", "<div>{0}</div>",
    "<p>{0} <a>{2}</a> <em>{1}</em></p>",
)
HEADS = (
    "<header><h1>{2}</h1></header>", "<header><h1>{2}</h1><p>{0}</p></header>", "<h2>{2}</h2>",
    "<figure><img><figcaption>{0}</figcaption></figure>", "<noscript><p>{0}</p></noscript>",
)
# What an article and a menu stand in on pages that name nothing.
BARE = (("<div>", "</div>"), ('<div id="page">', "</div>"), ("<section>", "</section>"), ("<table><tr><td>", "</td></tr></table>"))
SHELLS = (
    ("article", ""), ("main", ""), ("div", ' class="content"'), ("div", ' class="post entry"'), ("div", ' id="main-content"'),
    ("section", ' class="article-body"'),
)


def shell(page: str, tag: str, opening: str, closing: str) -> str:
    return re.sub(rf"<{tag}(?=[\s>])[^>]*>", lambda _: opening, page).replace(f"</{tag}>", closing)


def variants(html: str, rng: random.Random, sentences: list[str]) -> Iterator[tuple[str, str]]:
    """(page as it is shown, page whose markup says what is what): the page itself, and copies.

    Copies have other containers, some of them without any name, and further parts around and inside the article. What
    the parts say is taken from other articles, so that the words alone do not tell them from the article.
    """
    yield html, html
    for _ in range(COPIES):
        page = html
        for _ in range(rng.randint(2, 6)):
            words = rng.choice(sentences), rng.choice(sentences), rng.choice(sentences)[:12]
            chance = rng.random()
            if chance < 0.25:
                said = rng.choice(INSIDE).format(*words)
                spots = [m.start() for m in re.finditer("</article>", page)][-1:]
            elif chance < 0.4:
                said = rng.choice(HEADS).format(*words)
                spots = [m.end() for m in re.finditer(r"<article(?=[\s>])[^>]*>", page)][:1]
            else:
                said = rng.choice(EXTRA).format(*words, t="aside").replace("</aside>", "</@>")
                kind = rng.choice(PLAIN_ASIDES) if rng.random() < 0.4 else "div"
                label = "" if kind != "div" else f' {rng.choice(("class", "id"))}="{rng.choice(NAMES_OF_ASIDES)}{rng.choice(("", " box", "-inner"))}"'
                said = said.replace("<aside>", f"<{kind}{label}>").replace("</@>", f"</{kind}>")
                places = r"<article\b|</article>|</body>|<footer|<nav" if kind == "header" else r"<article\b|</article>|<p>|</body>|<footer|<nav"
                spots = [m.start() for m in re.finditer(places, page)]
                if kind == "header":
                    spots = [at for at in spots if page[:at].count("<article") == page[:at].count("</article>")]
            if spots:
                at = rng.choice(spots)
                page = page[:at] + said + page[at:]
        if rng.random() < 0.5:
            head = " ".join(rng.choice(sentences).split()[: rng.randint(1, 6)])
            page = re.sub(r"(<h1[^>]*>).*?(</h1>)", lambda m: m[1] + head + m[2], page, count=1, flags=re.S)
        tag, names = rng.choice(SHELLS)
        opening, closing = rng.choice(BARE) if rng.random() < 0.4 else (f"<{tag}{names}>", f"</{tag}>")
        shown = shell(page, "article", opening, closing)
        if rng.random() < 0.5:
            menu, end = rng.choice(BARE) if rng.random() < 0.5 else ('<div class="menu">', "</div>")
            shown = shell(shell(shown, "nav", menu, end), "footer", '<div class="footer">', "</div>")
        yield shown, page


def fit(pages: DataFrame, *, sample_pages: int = SAMPLE_PAGES, sample_bytes: int = SAMPLE_BYTES) -> Labeller:
    """Learn from about ``sample_pages`` pages of any size and ``sample_bytes`` at most, chosen by a hash of their id and text.

    Pages have no labels; the markup of well-formed ones gives them (``taught_label``), and copies with other markup and added
    parts teach what the page as a whole looks like. Without a page that has an article the labeller stays untaught.
    """
    usable = pages.where(F.col("html").isNotNull()).select("page_id", "html")
    whole = usable.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("html")).alias("bytes")).first()
    share = min(1 << 30, (sample_pages << 30) // max(1, whole["n"]), (sample_bytes << 30) // max(1, whole["bytes"] or 0))
    chosen = usable.where(F.pmod(F.xxhash64(F.lit("sample"), "page_id", "html"), F.lit(1 << 30)) < share)
    texts = [r["html"] for r in sorted(chosen.limit(4 * sample_pages).collect(), key=lambda r: (str(r["page_id"]), r["html"]))]
    rng = random.Random(3)
    sentences = [b.text for h in texts for b in leaves(h) if taught_label(b)][: 50 * sample_pages] or ["text"]
    taught = []
    for html in texts:
        for shown, told in variants(html, rng, sentences):
            blocks = leaves(shown)
            labels = np.array([taught_label(b) for b in leaves(told)], np.float32)
            if labels.any() and len(labels) == len(blocks):
                rows = features(blocks)
                begins = list(range(0, len(blocks), SAMPLE_BLOCKS))
                for begin in begins if len(begins) <= SEQUENCES else rng.sample(begins, SEQUENCES):
                    taught.append((rows[begin: begin + SAMPLE_BLOCKS], labels[begin: begin + SAMPLE_BLOCKS]))
    model = Labeller()
    if taught:
        model.learn(taught)
    return model


def texts_of(pages: list[str | None], model: Labeller) -> list[str]:
    """Main text per page. Pages of like length go through the network together; none is cut."""
    every = [leaves(html) for html in pages]
    texts = [""] * len(pages)
    order = sorted((i for i, b in enumerate(every) if b), key=lambda i: len(every[i]))
    begin = 0
    while begin < len(order):
        most = len(every[order[begin]]) * 2 + 8
        end = begin
        while end < len(order) and end - begin < PAGES_AT_ONCE and len(every[order[end]]) <= most:
            end += 1
        some = order[begin:end]
        x, sizes = padded([features(every[i]) for i in some])
        chance = model.run(x, sizes)[0]
        for column, i in enumerate(some):
            texts[i] = "\n".join(b.text for b, c in zip(every[i], chance[: len(every[i]), column], strict=True) if c > 0.5)
        begin = end
    return texts


def main_text(pages: DataFrame, model: Labeller) -> DataFrame:
    """page_id, url, text for every row of (page_id, url, html).

    Null or empty html gives an empty text, and so does a page without a block that the labeller takes. Repeated
    rows give repeated rows, an empty table none; further columns are not looked at.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 512):
                part = batch.slice(begin, 512)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts_of(part.column(2).to_pylist(), shared.value), pa.string())],
                    names=["page_id", "url", "text"],
                )

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(extracted, f"page_id {kind}, url string, text string")
