"""Log-probability of texts under a backoff automaton of word pairs, words and a root, learned from the corpus."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliary.llm import blocks as B
from foliary.llm.words import Words, mix, slices
from foliary.session import staged

END, BEGIN = np.uint64(0x5EED0FE0D0F7E877), np.uint64(0xBE61A0C0DE5EED01)
STEP, LOW = np.uint64(0x9E3779B97F4A7C15), np.uint64(16)
BLOCK_BYTES = 8 << 20
CLASSES = 48
KINDS = ("words", "pairs", "triples")


def learned(id_column: str = "doc_id"):
    """Whether a document is learned from: crc32 of its id as text is not 1 modulo 5 (a null id counts as empty)."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")), F.lit(5)) != 1


class Block:
    """Tokens of a block: each token's word, pair and triple as places in sorted lists of distinct hashes.

    A pair is a token after the one before it (BEGIN for the first), a triple a token after a pair; the first token of a
    text has none. The lowest bit of a pair tells that it ends a text, so is no state.
    """

    def __init__(self, table: pa.Table):
        pieces, counts = [], []
        for _, _, data, offsets in slices(B.text_column(table)):
            words = Words(data, offsets)
            hashes = words.hashes(lower=True)
            ends = words.first[1:] + np.arange(len(words.count))
            tokens = np.empty(len(hashes) + len(words.count), np.uint64)
            here = np.ones(len(tokens), bool)
            here[ends] = False
            tokens[here], tokens[ends] = hashes, END
            pieces.append(tokens)
            counts.append(words.count + 1)
        self.count = np.concatenate(counts)
        tokens = np.concatenate(pieces)
        first = np.concatenate([[0], np.cumsum(self.count)[:-1]])
        self.inner = np.ones(len(tokens), bool)
        self.inner[first] = False
        self.doc = np.repeat(np.arange(len(self.count)), self.count)
        before = np.roll(tokens, 1)
        before[first] = BEGIN
        # BEGIN is a state but never a token; it takes part in the list so that its count comes back too.
        self.words, place = np.unique(np.append(tokens, BEGIN), return_inverse=True)
        self.word, self.begin = place[:-1], place[-1]
        self.state = np.roll(self.word, 1)
        self.state[first] = self.begin
        pairs = (mix(before * STEP + tokens) >> LOW) & ~np.uint64(1) | (tokens == END)
        self.pairs, self.pair = np.unique(pairs, return_inverse=True)
        after = np.flatnonzero(self.inner)
        self.pair_state = self.pair[after - 1]
        self.triples, self.triple = np.unique(mix(pairs[after - 1] * STEP + tokens[after]) >> LOW, return_inverse=True)


def concentration(states: np.ndarray, tokens: np.ndarray, arcs: int) -> float:
    """The prior tokens per state under which so many states with so many tokens expect ``arcs`` different arcs.

    With m prior tokens a state with n tokens expects about m ln(1 + n / m) arcs. ``states`` and ``tokens`` are sums per class.
    """
    there = states > 0
    mean = tokens[there] / states[there]
    low, high = -3.0, 6.0
    for _ in range(60):
        m = 10 ** ((low + high) / 2)
        if float((states[there] * m * np.log1p(mean / m)).sum()) < arcs:
            low = math.log10(m)
        else:
            high = math.log10(m)
    return 10 ** low


def classes(counts: np.ndarray) -> tuple[list[int], list[int]]:
    """How many counts there are in each power-of-two class, and their sums; zeros are left out."""
    counts = counts[counts > 0]
    level = np.minimum(np.log2(counts).astype(np.int64), CLASSES - 1)
    states, tokens = np.bincount(level, minlength=CLASSES), np.bincount(level, counts, CLASSES)
    return states.tolist(), tokens.astype(np.int64).tolist()


def counted(every: DataFrame, bits: int) -> DataFrame:
    """Per block and shard the corpus counts of the block's words, pairs and triples; one row per shard sums up the shard."""

    def asked(table: pa.Table) -> pa.Table:
        block = Block(table)
        teaches = np.asarray(table.column("teaches").combine_chunks().to_numpy(zero_copy_only=False))
        weight = teaches[block.doc].astype(np.float64)
        words = np.bincount(block.word, weight, len(block.words)).astype(np.uint32)
        words[block.begin] = teaches.sum()
        counts = {
            "words": words, "pairs": np.bincount(block.pair, weight, len(block.pairs)).astype(np.uint32),
            "triples": np.bincount(block.triple, weight[block.inner], len(block.triples)).astype(np.uint32),
        }
        keys = {"words": block.words, "pairs": block.pairs, "triples": block.triples}
        cuts = {k: B.cut_points(v if k == "words" else v << LOW, bits) for k, v in keys.items()}
        number, rows = table.column("block")[0].as_py(), []
        for s in range(1 << bits):
            at = {k: slice(c[s], c[s + 1]) for k, c in cuts.items()}
            if any(a.start < a.stop for a in at.values()):
                row = {"shard": s, "block": number}
                for k in KINDS:
                    row[k] = (B.packed if k == "words" else B.pack_sorted)(keys[k][at[k]])
                    row[f"{k}_n"] = B.pack_small(counts[k][at[k]])
                rows.append(row)
        return pa.Table.from_pylist(rows, pa.schema([
            ("shard", pa.int32()), ("block", pa.int32()), *[(c, pa.binary()) for k in KINDS for c in (k, f"{k}_n")],
        ]))

    def answered(table: pa.Table) -> pa.Table:
        rows = B.rows_of(table)
        out = [{"block": r["block"], "shard": r["shard"]} for r in rows]
        for k in KINDS:
            lists = [np.frombuffer(r[k], np.uint64) if k == "words" else B.unpack_sorted(r[k]) for r in rows]
            distinct, place = np.unique(np.concatenate(lists), return_inverse=True)
            counts = np.concatenate([B.unpack_small(r[f"{k}_n"]) for r in rows])
            total = np.bincount(place, counts, len(distinct)).astype(np.int64)
            for r, n in zip(out, np.split(total[place], np.cumsum([len(x) for x in lists])[:-1]), strict=True):
                r[k] = B.pack_small(n)
            # What the shard knows goes along with one of its rows.
            out[0][f"{k}_known"] = int(((total > 0) & (distinct != BEGIN)).sum()) if k == "words" else int((total > 0).sum())
            if k == "words":
                out[0]["tokens"] = int(total[distinct != BEGIN].sum())
                out[0]["word_states"], out[0]["word_tokens"] = classes(total[distinct != END])
            elif k == "pairs":
                out[0]["pair_states"], out[0]["pair_tokens"] = classes(total[distinct & np.uint64(1) == 0])
        return pa.Table.from_pylist(out, pa.schema([
            ("block", pa.int32()), ("shard", pa.int32()), *[(k, pa.binary()) for k in KINDS],
            *[(f"{k}_known", pa.int64()) for k in KINDS], ("tokens", pa.int64()),
            *[(c, pa.list_(pa.int64())) for c in ("word_states", "word_tokens", "pair_states", "pair_tokens")],
        ]))

    asks = ", ".join(f"{k} binary, {k}_n binary" for k in KINDS)
    tells = ", ".join(f"{k} binary, {k}_known long" for k in KINDS)
    questions = B.per_group(every, "block", asked, f"shard int, block int, {asks}")
    return B.per_group(
        questions, "shard", answered,
        f"block int, shard int, {tells}, tokens long, word_states array<long>, word_tokens array<long>,"
        " pair_states array<long>, pair_tokens array<long>",
    )


class Automaton:
    """The part of the automaton that the texts of a block can reach, and the walk of those texts through it.

    A word state v has an arc for each word w seen after it, of weight (c(v, w) + m P(w)) / (c(v) + m), and a failure arc to the
    root of weight m / (c(v) + m). A pair state does the same one order higher and fails to the state of its second word.
    What backs off is part of an arc's weight too, so the probabilities of every state sum to one.
    """

    def __init__(self, block: Block, words: np.ndarray, pairs: np.ndarray, triples: np.ndarray, model: dict):
        self.block = block
        self.of_word, self.of_pair, self.of_triple = words[block.word], pairs[block.pair], triples[block.triple]
        self.word_state, self.pair_state = words[block.state], pairs[block.pair_state]
        self.model = model

    def walk(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per token the logarithms under the root and under the automaton, and how many failure arcs the step took.

        The state before a token is the pair of the two tokens before it if teaching knows that, else the word before it, else the
        root. It hangs on these two alone, so every step of every text is worked out at once.
        """
        m, root = self.model, np.log10(self.of_word + 0.5) - self.model["share"]
        at_word = (self.of_pair + m["words"] * 10 ** root) / (self.word_state + m["words"])
        carried = (self.word_state > 0).astype(np.int64)
        arrived = np.where(self.of_pair > 0, 1, 0)
        inner = self.block.inner
        weight = at_word.copy()
        weight[inner] = (self.of_triple + m["pairs"] * at_word[inner]) / (self.pair_state + m["pairs"])
        carried[inner] += self.pair_state > 0
        arrived[inner] += self.of_triple > 0
        return root, np.log10(weight), carried - arrived


def score(docs: DataFrame, *, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, teaches, n_tokens, n_known, train_tokens, base_score, score, n_failures for every row of ``docs``.

    Tokens are the words with A-Z lower-cased, then one end; a null text has the end alone. The base is the word count
    with 0.5 added; it is the root. Every word seen in teaching (and the beginning) is a state, and every pair of words
    (or of the beginning and a word); a pair fails to its second word and a word to the root. ``Automaton`` has the weights;
    the prior tokens m of an order are one number for all its states, such that as many arcs are expected as were counted.
    ``n_failures`` is the number of failure arcs on a text's way. Counts cover all teaching documents; nothing is
    pruned. Repeated rows are scored each and teach each; an empty table gives no rows; further columns are not looked at.

    Nothing of the model is broadcast: blocks of documents ask shards of words, pairs and triples, and get back only their
    own part of the automaton. The answers are written once, since their sums are needed before the walk.
    """
    count, bits = B.sizes(docs, block_bytes=block_bytes)
    kind = docs.schema["doc_id"].dataType.simpleString()
    id_type = docs.sparkSession.createDataFrame([], f"doc_id {kind}").toArrow().schema.field("doc_id").type
    every = B.in_blocks(docs, count, ("doc_id", "text")).withColumn("teaches", learned())
    replies = staged(counted(every, bits), "lm-counts")
    found = replies.select(
        *[F.sum(c).alias(c) for c in ("words_known", "pairs_known", "triples_known", "tokens")],
        *[F.sum(F.coalesce(F.get(c, F.lit(i)), F.lit(0))).alias(f"{c}{i}")
          for c in ("word_states", "word_tokens", "pair_states", "pair_tokens") for i in range(CLASSES)],
    ).first().asDict()
    sums = {k: v or 0 for k, v in found.items()}

    def prior(name: str, arcs: str) -> float:
        states, tokens = (np.array([sums[f"{name}_{c}{i}"] for i in range(CLASSES)], np.float64) for c in ("states", "tokens"))
        return concentration(states, tokens, sums[arcs])

    tokens = sums["tokens"]
    model = {
        "share": math.log10(tokens + 0.5 * (sums["words_known"] + 1)),
        "words": prior("word", "pairs_known"), "pairs": prior("pair", "triples_known"),
    }
    out_schema = pa.schema([
        ("doc_id", id_type), ("teaches", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()),
        ("base_score", pa.float64()), ("score", pa.float64()), ("n_failures", pa.int64()),
    ])

    def walked(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return out_schema.empty_table()
        rows = sorted(B.rows_of(answers), key=lambda r: r["shard"])
        block = Block(table)
        counts = [np.concatenate([B.unpack_small(r[k]) for r in rows]) for k in KINDS]
        automaton = Automaton(block, *counts, model)
        root, logs, failures = automaton.walk()
        n = len(block.count)
        return pa.Table.from_arrays([
            table.column("doc_id").combine_chunks(), table.column("teaches").combine_chunks(), pa.array(block.count.astype(np.int64)),
            pa.array(np.bincount(block.doc[automaton.of_word > 0], minlength=n).astype(np.int64)),
            pa.array(np.full(n, tokens, np.int64)), pa.array(np.bincount(block.doc, root, n)), pa.array(np.bincount(block.doc, logs, n)),
            pa.array(np.bincount(block.doc, failures, n).astype(np.int64)),
        ], schema=out_schema)

    return every.groupBy("block").cogroup(replies.select("block", "shard", *KINDS).groupBy("block")).applyInArrow(
        walked,
        f"doc_id {kind}, teaches boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double,"
        " n_failures long",
    )
