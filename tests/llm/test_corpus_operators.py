"""Corpus operators against plain Python on a small table with every awkward case, and on the smallest given tables."""

from __future__ import annotations

import math
import random
import zlib
from collections import defaultdict
from pathlib import Path

import brute
import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import corpus_pipeline
from foliary.llm import chat, decontaminate, exact, html, jaccard, language, packing, score, shards, substrings
from foliary.llm.queries import ORACLE, QUERIES

FOLDER = "/root/testdata/sf0.001"
# Extra columns bear names that the operators use inside.
DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    *[T.StructField(c, T.StringType()) for c in ("block", "digest", "kind", "__bits", "slot", "kept", "number", "key", "label")],
])


def awkward_rows() -> list[tuple]:
    rng = random.Random(1)
    stock = ["the", "of", "Über", "señor", "x1", "ok.", "ÉTÉ", "and", "łódź", "日本"]

    def prose(n):
        return " ".join(rng.choice(stock) + rng.choice(("", "", str(rng.randrange(50)))) for _ in range(n))

    passage, long = prose(60), prose(12_000)
    near = prose(150).split()
    texts = [None, "", "   \t\n", "a", "A", "one two", "One TWO", passage, passage.upper(), prose(30) + " " + passage, passage + " " + prose(30),
             long, long, long + " tail", "again " * 90, "again " * 40, "12345 %%% ---", "  　 x", "a  \t b  c\n\n d ", prose(19), prose(20)]
    texts += [" ".join([*near[:k], "new", *near[k + 1:]]) for k in (0, 40, 80, 149)] + [" ".join(near)]
    rows = [(i * 3, t) for i, t in enumerate(texts)] + [(6, texts[2]), (21, passage), (21, passage), (None, passage), (None, "lonely words here")]
    rng.shuffle(rows)
    return [(i, t, rng.choice(("en", "de", None)), *["noise"] * 9) for i, t in rows]


@pytest.fixture(scope="module")
def awkward(spark):
    rows = awkward_rows()
    return [(r[0], r[1]) for r in rows], spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def small(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    return [(r.doc_id, r.text) for r in docs.collect()], docs


def thue_morse(letters):
    """A word and its complement, which polynomial hashes modulo a power of two cannot tell apart."""
    bits = [bin(i).count("1") % 2 for i in range(letters)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def same(frame, columns, wanted):
    got = [tuple(r) for r in frame.select(*columns).collect()]
    assert sorted(got, key=repr) == sorted(wanted, key=repr)


@pytest.mark.parametrize("table", ["awkward", "small"])
def test_exact_groups(request, table):
    rows, docs = request.getfixturevalue(table)
    columns = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    same(exact.exact_groups(docs, digest_all=True), columns, brute.exact(rows))
    slim = exact.exact_groups(docs)
    same(slim, columns[:4], [r[:4] for r in brute.exact(rows)])
    assert slim.where("group_size = 1 and text_sha256 is not null").count() <= 2  # hashed in vain at most by accident


def test_exact_copies_go(awkward):
    rows, docs = awkward
    kept = exact.without_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted(
        ((d, t) for (d, t), e in zip(rows, brute.exact(rows), strict=True) if e[3]), key=repr
    )


@pytest.mark.parametrize("table", ["awkward", "small"])
@pytest.mark.parametrize("crowd,block_bytes", [(512, 4 << 20), (1, 20_000)])
def test_repeated_passages(request, table, crowd, block_bytes):
    rows, docs = request.getfixturevalue(table)
    found = substrings.without_repeats(docs, crowd=crowd, block_bytes=block_bytes)
    same(found, ["doc_id", "n_words", "n_removed", "kept"], brute.repeats(rows))


def test_suffix_automaton_finds_first_places():
    rng = random.Random(4)
    automaton, seen = substrings.Automaton(), {}
    for number in range(40):
        symbols = [rng.randrange(3) for _ in range(rng.randrange(3, 30))]
        last = 0
        for i, s in enumerate(symbols):
            last = automaton.add(last, s, (number, i))
            for n in range(1, i + 2):
                seen.setdefault(tuple(symbols[i + 1 - n: i + 1]), (number, i))
    query = [rng.randrange(3) for _ in range(300)]
    found = dict(automaton.walk(query, 4))
    wanted = {i: seen[tuple(query[i - 3: i + 1])] for i in range(3, 300) if tuple(query[i - 3: i + 1]) in seen}
    assert found == wanted


@pytest.mark.parametrize("table", ["awkward", "small"])
def test_similar_groups(request, table):
    rows, docs = request.getfixturevalue(table)
    same(jaccard.similar_groups(docs), ["doc_id", "n_shingles", "component_id"], brute.jaccard_groups(rows))


def test_linked_sets_share_a_signature_and_the_trie_finds_links():
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 1 << 62, 4000, dtype=np.uint64)
    sets = []
    for n in (1, 2, 5, 9, 19, 20, 40, 200, 600):
        for _ in range(6):
            whole = rng.choice(pool, n, replace=False)
            sets.append(np.unique(whole))
            for change in (1, n // 19, n // 10):
                sets.append(np.unique(np.concatenate([whole[change:], rng.choice(pool, change)])))
    codes, owners = jaccard.signatures(sets)
    having = defaultdict(set)
    for c, o in zip(codes.tolist(), owners.tolist(), strict=True):
        having[o].add(c)
    linked = [
        (i, j) for i in range(len(sets)) for j in range(i)
        if 100 * (c := len(np.intersect1d(sets[i], sets[j]))) >= 90 * (len(sets[i]) + len(sets[j]) - c)
    ]
    assert linked and all(having[i] & having[j] for i, j in linked)

    def groups(pairs):
        owner = list(range(len(sets)))
        for i, j in pairs:
            a, b = owner[i], owner[j]
            owner = [a if o == b else o for o in owner]
        return [owner.index(o) for o in owner]

    assert groups(jaccard.forest(sets, None)) == groups(linked)
    half = len(sets) // 2
    across = [(i, j) for i, j in linked if (i < half) != (j < half)]
    assert groups(jaccard.forest(sets[:half], sets[half:])) == groups(across)


def test_near_copies_of_the_pipeline(spark, small):
    rng = random.Random(5)
    near = [f"w{i}" for i in range(100)]
    rows = [(1, " ".join(near)), (2, " ".join([*near[:30], "x", *near[31:60], "y", *near[61:]])), (3, " ".join([*near[:20], *["z"] * 15, *near[35:]]))]
    for i in range(60):
        text = [f"v{rng.randrange(400)}" for _ in range(rng.choice((3, 4, 5, 30, 80, 400)))]
        rows += [(10 * i + 10, " ".join(text))]
        for j in range(1, 4):
            for _ in range(max(1, len(text) // 50)):
                text[rng.randrange(len(text))] = "new"
            rows.append((10 * i + 10 + j, " ".join(text)))
    for pairs, docs in ((rows, spark.createDataFrame(rows, "doc_id long, text string")), small):
        wanted = brute.jaccard_groups(pairs, size=5, percent=80)
        same(jaccard.similar_groups(docs, shingle=5, percent=80), ["doc_id", "n_shingles", "component_id"], wanted)
        kept = [r.doc_id for r in corpus_pipeline.near_copies(spark, docs, FOLDER).collect()]
        assert sorted(kept) == sorted(d for d, _, c in wanted if c == d)
        assert pairs is not rows or (2 not in kept and 3 in kept)


@pytest.mark.parametrize("percent", [70, 80, 90])
def test_linked_sets_share_a_signature_at_any_similarity(percent):
    rng = np.random.default_rng(4)
    for n in (1, 2, 5, 6, 9, 13, 28, 60, 200, 900):
        for _ in range(60):
            whole = rng.integers(0, 1 << 62, n, dtype=np.uint64)
            gone = int(rng.integers(0, n * (100 - percent) // 100 + 1))
            more = rng.integers(0, 1 << 62, int(rng.integers(0, (n - gone) * 100 // percent - n + 1)), dtype=np.uint64)
            other = np.unique(np.concatenate([whole[gone:], more]))
            assert 100 * (n - gone) >= percent * (n + len(more))
            codes, owners = jaccard.signatures([np.unique(whole), other], percent)
            assert np.intersect1d(codes[owners == 0], codes[owners == 1]).size


@pytest.mark.parametrize("percent", [70, 80, 90])
def test_sketches_keep_linked_sets_together(percent):
    rng = np.random.default_rng(6)
    sets, linked = [], []
    for n in (1, 2, 7, 30, 60, 128, 129, 400, 1500):
        for _ in range(8):
            whole = rng.integers(0, 1 << 62, n, dtype=np.uint64)
            gone = int(rng.integers(0, n * (100 - percent) // 100 + 1))
            more = rng.integers(0, 1 << 62, int(rng.integers(0, (n - gone) * 100 // percent - n + 1)), dtype=np.uint64)
            linked.append((len(sets), len(sets) + 1))
            sets += [np.unique(whole), np.unique(np.concatenate([whole[gone:], more]))]
    for i, j in linked:
        assert 100 * len(np.intersect1d(sets[i], sets[j])) >= percent * len(np.union1d(sets[i], sets[j]))
    pairs = [jaccard.sketch(s) for s in sets]
    least = min(len(p) for p in pairs)
    for size in (least, 1):
        words = [jaccard.folded(p, size) for p in pairs]
        order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
        for left, right in ((order, []), (order[::2], order[1::2]), (order[:9], order[9:])):
            rows = left + right
            found = jaccard.alike(np.array([len(sets[i]) for i in rows]), np.stack([words[i] for i in rows], axis=1), len(left), percent)
            owner = list(range(len(sets)))
            for i, j in found:
                a, b = owner[rows[i]], owner[rows[j]]
                assert a != b
                owner = [a if o == b else o for o in owner]
            assert all(owner[i] == owner[j] for i, j in linked if not right or (i in left) != (j in left))
    # Sets of up to 128 elements that have nothing in common are told apart by whole sketches.
    some = sorted((s for s in sets[::2] if 30 <= len(s) <= 128), key=len)
    assert not jaccard.alike(np.array([len(s) for s in some]), np.stack([jaccard.sketch(s) for s in some], axis=1), len(some), percent)


def test_a_family_tied_by_a_common_line_is_divided(spark, monkeypatch):
    rng = random.Random(8)
    line = [f"license{i}" for i in range(14)]
    rows = [(i, " ".join(line + [f"v{rng.randrange(100000)}" for _ in range(rng.randrange(12, 18))])) for i in range(400)]
    for i in range(0, 400, 40):
        # Some near copies, one of them in a chain of three.
        rows += [(1000 + i, rows[i][1] + " more"), (2000 + i, rows[i][1] + " more yet"), (3000 + i, rows[i][1])]
    monkeypatch.setattr(jaccard, "FAMILY_CHUNK", 16)
    monkeypatch.setattr(jaccard, "SKETCH_CHUNK", 2048, raising=False)
    monkeypatch.setattr(jaccard, "SKETCHES", 40, raising=False)
    verified, copies = jaccard.verified, []

    def counted(texts, *rest):
        copies.extend(texts.agg(F.count(F.lit(1)), F.sum("chunks")).first())
        return verified(texts, *rest)

    monkeypatch.setattr(jaccard, "verified", counted)
    wanted = brute.jaccard_groups(rows, size=5, percent=80)
    assert len({c for _, _, c in wanted}) == 400
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    same(jaccard.similar_groups(docs, shingle=5, percent=80), ["doc_id", "n_shingles", "component_id"], wanted)
    assert 20 <= copies[0] and copies[1] <= 100


def test_texts_that_stay_enter_no_exchange(spark):
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(20)), "kept") for i in range(500)] + [(None, "a b c d e f g", "kept")]
    rows += [(600, rows[7][1] + " more", "gone"), (601, rows[8][1] + " more", "gone"), (9, "another text of this id", "kept")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __bits string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left = jaccard.one_of_each_group(docs, shingle=5, percent=80)
        assert left.columns == docs.columns
        found = sorted(map(tuple, left.collect()), key=repr)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert found == sorted((r for r in rows if r[2] == "kept"), key=repr)
    todo, moved = [left._jdf.queryExecution().executedPlan()], 0
    while todo:
        node = todo.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
        elif "QueryStage" in node.nodeName():
            todo.append(node.plan())
        else:
            if node.nodeName() == "Exchange" and any(c in node.output().toString() for c in ("text#", "__row#")):
                moved += node.metrics().apply("shuffleRecordsWritten").value()
            todo += [node.children().apply(i) for i in range(node.children().size())]
    assert 2 <= moved <= 10


@pytest.mark.parametrize("table", ["awkward", "small"])
def test_scores(request, table):
    rows, docs = request.getfixturevalue(table)
    found = score.score(docs, block_bytes=50_000).collect()
    columns = ["doc_id", "n_tokens", "n_known", "train_tokens"]
    assert sorted((tuple(r[c] for c in columns) for r in found), key=repr) == sorted((r[:4] for r in brute.base_scores(rows)), key=repr)
    wanted = sorted(brute.base_scores(rows), key=repr)
    got = sorted(((*[r[c] for c in columns], r.base_score) for r in found), key=repr)
    assert np.allclose([r[4] for r in got], [r[4] for r in wanted], rtol=1e-9)
    walked = sorted(brute.automaton_scores(rows), key=repr)
    got = sorted(((r.doc_id, r.n_failures, r.score) for r in found), key=repr)
    assert [r[:2] for r in got] == [r[:2] for r in walked]
    assert np.allclose([r[2] for r in got], [r[2] for r in walked], rtol=1e-9)
    assert sum(r.score for r in found) > sum(r.base_score for r in found)


def test_probabilities_of_every_state_sum_to_one(small):
    rows, _ = small
    automaton = brute.Automaton(rows)
    rng = np.random.default_rng(5)
    states = [(), ("<unseen>",), ("<unseen>", "<unseen>"), *automaton.failure]
    for i in [0, 1, 2, *rng.integers(3, len(states), 40)]:
        total = math.fsum(10 ** automaton.step(states[i], w)[0] for w in [*automaton.vocabulary, "<unseen>"])
        assert abs(total - 1) < 1e-9, states[i]


def test_matching_within_an_edit_distance():
    rng = random.Random(2)
    letters = "abcde "
    for _ in range(150):
        item = decontaminate.normal("".join(rng.choice(letters) for _ in range(rng.randrange(5, 60)))) or "x"
        changed = list(item)
        for _ in range(rng.randrange(0, 8)):
            at = rng.randrange(len(changed) + 1)
            changed[at: at + rng.randrange(2)] = rng.choice(letters) * rng.randrange(2)
        text = decontaminate.normal("".join(rng.choice(letters) for _ in range(80)) + "".join(changed) + "zz")
        found = decontaminate.Matcher([(7, item)], 0.15).found(text)
        assert (7 in found) == (brute.infix_distance(item, text) <= int(len(item) * 0.15))


def test_leaks(spark, awkward, empty):
    rows, docs = awkward
    passage = next(t for d, t in rows if d == 21)
    items = [(1, passage.replace("of", "off", 1)), (2, None), (3, ""), (4, "nowhere to be found at all in here"), (1, passage)]
    tests = spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, tuple(r.item_ids)) for r in decontaminate.contamination(docs, tests).collect()}
    texts = defaultdict(set)
    for d, t in rows:
        texts[d].add(decontaminate.normal(t))
    hits = {d for d, ts in texts.items() if any(decontaminate.normal(passage) in t for t in ts)}
    assert found == {(d, (1,) if d in hits else ()) for d in texts}
    blocks = decontaminate.leaks(docs, tests, block_bytes=50).select("doc_id").distinct().collect()
    assert {r.doc_id for r in blocks} == hits
    clean = decontaminate.without_leaks(docs, tests)
    assert clean.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in clean.collect()), key=repr) == sorted(
        ((d, t) for d, t in rows if decontaminate.normal(passage) not in decontaminate.normal(t)), key=repr
    )
    assert decontaminate.contamination(empty, tests).count() == 0
    assert decontaminate.without_leaks(docs, tests.limit(0)).count() == len(rows)


@pytest.mark.parametrize("table", ["awkward", "small"])
def test_shards(request, table):
    rows, docs = request.getfixturevalue(table)
    found = shards.shuffled_shards(docs, 7).collect()
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in found), key=repr) == sorted(
        ((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in rows), key=repr
    )
    assert sorted(r.place for r in found) == list(range(len(rows)))
    slots = defaultdict(list)
    for r in found:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    again = shards.shuffled_shards(docs.repartition(5), 7).collect()
    assert {(r.place, r.doc_id, r.size) for r in again} == {(r.place, r.doc_id, r.size) for r in found}
    assert [r.doc_id for r in sorted(found, key=lambda r: r.place)] != sorted((r.doc_id for r in found), key=lambda i: (i is not None, i))


def test_grid_leaves_little_outside():
    for total in [*range(0, 300), 256_410, 10**9 + 7, 10**12 + 39]:
        rows, columns = shards.grid(total)
        assert 0 <= rows * columns - total <= 32


@pytest.mark.parametrize("table,shard_tokens", [("awkward", 5_000), ("small", 2_000_000)])
def test_packing(request, table, shard_tokens):
    from tokenizers import Tokenizer

    rows, docs = request.getfixturevalue(table)
    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    wanted = defaultdict(list)
    for d, t in rows:
        wanted[d].append(np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, packing.END_ID], np.uint32))
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in packing.pack(docs, shard_tokens=shard_tokens).collect():
        pieces[r.doc_id].append((r.start, r.length, r.ids_crc32, r.doc_tokens))
        windows[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(wanted)
    for d, found in pieces.items():
        if len(wanted[d]) == 1:
            ids, at = wanted[d][0], 0
            for start, length, check, total in sorted(found):
                assert (start, total) == (at, len(ids)) and check == zlib.crc32(ids[start: start + length].tobytes())
                at += length
            assert at == len(ids)
        else:
            assert sum(p[1] for p in found) == sum(map(len, wanted[d]))
    for parts in windows.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.WINDOW


def windows_of(tails):
    index = packing.Index([np.array(t, np.uint16) for t in tails], np.ones(packing.VOCABULARY), 100.0)
    found = defaultdict(list)
    for tail, _, length, sequence, _ in packing.packed(tails, index):
        found[sequence].append((tail, length))
    return found


def test_windows_are_filled_by_neighbours_to_the_end_of_the_ranking():
    # Two topics without a common term; lengths alternate, so filling by length would mix them.
    tails = [[*([100 + i % 2, 200 + i % 2] * 60)[: 119 - i], packing.END_ID] for i in range(80)]
    first = windows_of(tails)[0]
    assert len(first) > packing.NEIGHBOURS + 1 and sum(n for _, n in first) == packing.WINDOW and {t % 2 for t, _ in first} == {0}


def test_every_term_of_a_seed_counts():
    # The seed has 60 terms of its own that weigh more than the one it shares with the shortest document.
    seed = [*range(1000, 1060)] * 4
    tails = [[*seed, 7, packing.END_ID], *[[50 + i] * 200 + [packing.END_ID] for i in range(5)], [7, 8, packing.END_ID]]
    assert [t for t, _ in windows_of(tails)[0]][:2] == [0, 6]


def test_encoder_agrees_with_the_tokenizer():
    from tokenizers import Tokenizer

    texts = ["", " ", "a  b", "a \n b\t\tc ", "x  y 　z", "it's  we'll \r\n\r\n  12 3.5%", "é ü ñ 日本 🙂 end ", "  lead", "x" * 3000,
             "trail  ", "\n\n\n", "<|endoftext|> a <|endoftext|>", "a \u0085 b", "z ﻿ q", *thue_morse(1024)]
    rng = random.Random(3)
    stock = ["a", "Ünï", " ", "\n", "\t", " ", "　", "\x1c", "日本語", "'s", "<|endoftext|>", "1234", "...", "​", "\r\n", "👍🏽", "\x00"]
    texts += ["".join(rng.choice(stock) + rng.choice(("", " ", "  ")) for _ in range(rng.randrange(12))) for _ in range(500)]
    encode = packing.Encoder(packing.default_tokenizer())
    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    assert encode.quick is not None
    for text in texts:
        assert encode.ids(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_chats(spark):
    a, b, c = (0, "user", "hi"), (1, "assistant", "hello"), (2, "user", None)
    rows = [(1, *a), (1, *b), (2, *a), (2, *b), (2, *c), (3, *a), (3, *b), (3, *c), (4, *b), (5, *a), (5, *a), (6, None, None, "x"),
            (None, *a), (None, 1, "assistant", "other"), (7, 1, "user", "same turn"), (7, 1, "user", "twice"), (8, *a), (8, 9, "assistant", "hello")]
    rows += [(9, i, "user", f"turn {i}") for i in range(2500)] + [(10, i, "user", f"turn {i}") for i in range(1500)]
    rows += [(11, i, "user", f"turn {i}" if i < 1400 else "else") for i in range(1500)]
    turns = spark.createDataFrame([(*r, "noise", 1) for r in rows], "conv_id long, turn long, role string, text string, digest string, block int")
    same(chat.format_chats(turns), ["conv_id", "part", "n_turns", "copies", "text"], brute.chats(rows))
    assert chat.format_chats(turns.limit(0)).count() == 0


def test_language(spark, awkward, empty):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    model = language.fit(docs.where(~language.held_out()))
    found = {r.doc_id: r for r in language.identify(docs, model).collect()}
    told = [r for r in docs.where(language.held_out()).collect() if len(r.text) > 30]
    assert sum(found[r.doc_id].lang_pred == r.lang for r in told) >= 0.9 * len(told)
    rows, strange = awkward
    odd = language.identify(strange, model).collect()
    assert len(odd) == len(rows) and all(0 <= r.score <= 1 for r in odd)
    assert {r.doc_id for r in odd if r.lang_pred == "und"} == {d for d, t in rows if not any(c.isalpha() for c in t or "")}
    assert language.identify(empty, model).count() == 0
    assert {r.lang_pred for r in language.identify(docs, language.fit(empty)).collect()} == {"und"}
    kept = language.known_language(docs.withColumn("slot", docs.doc_id))
    assert kept.columns[-1] == "slot" and kept.count() >= 0.98 * docs.count()


def test_foreign_and_random_texts_are_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    rng = random.Random(6)
    letters = {"latin": "abcdefghijklmnopqrstuvwxyz    ", "base64": "".join(map(chr, [*range(48, 58), *range(65, 91), *range(97, 123)])) + "+/",
               "hex": "0123456789abcdef", "greek": "αβγδεζηθικλμνξοπρστυφχψω   ", "cyrillic": "абвгдежзийклмнопрстуфхцчшщъыьэюя   ",
               "cjk": "".join(map(chr, range(0x4E00, 0x9FA0))), "digits": "0123456789 "}
    odd = [(-n, "".join(rng.choice(stock) for _ in range(n)) + " a", name) for name, stock in letters.items() for n in (100, 300, 1000, 3000, 10_000, 30_000)]
    model = language.fit(docs.where(~language.held_out()))
    strange = spark.createDataFrame(odd, "doc_id long, text string, lang string")
    assert [r for r in language.identify(strange, model).collect() if not r.rejected] == []
    clean = docs.where("NOT text RLIKE '[%$*#&!]{2}'")
    told = clean.where(language.held_out())
    assert language.identify(told, model).where("not rejected").count() >= 0.98 * told.count()
    kept = language.known_language(docs.union(strange.selectExpr("doc_id", "text", "CAST(NULL AS string)")))
    assert kept.where("doc_id < 0").count() == 0 and kept.count() >= 0.98 * docs.count()


PAGE = """<!DOCTYPE html><html><head><title>No</title><script>var t="</p><p>no";</script></head><body><nav><ul><li><a href="/a">Nav</a></li></ul></nav>
<article><h1>Head &amp; shoulders</h1><p>One <b>bold</b>\n word&nbsp;here.<p>Two<br>lines &lt;ok&gt; <!-- no --></p></article><footer>&copy; end</footer>"""


def test_leaves():
    found = html.leaves(PAGE)
    assert [b.text for b in found] == ["Nav", "Head & shoulders", "One bold word here.", "Two lines <ok>", "© end"]
    assert found[2].path[-2:] == ("article", "p") and found[0].linked == 3
    assert html.leaves(None) == [] and html.leaves("plain &amp; simple")[0].text == "plain & simple"
    assert [b.text for b in html.leaves("<p>a<p>b</div></p><div class=x>c")] == ["a", "b", "c"]


def test_gradients_of_the_labeller():
    rng = np.random.default_rng(0)
    model = html.Labeller()
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    rows = [rng.normal(size=(n, html.WIDTH)) for n in (5, 3)]
    x, sizes = html.padded(rows)
    truth, real = rng.integers(0, 2, x.shape[:2]), np.arange(len(x))[:, None] < sizes

    def loss():
        chance = model.run(x, sizes)[0]
        return -np.where(real, truth * np.log(chance) + (1 - truth) * np.log(1 - chance), 0).sum()

    chance, both, forth, back, x_back, turned = model.run(x, sizes)
    wrong = np.where(real, chance - truth, 0)[:, :, None]
    slope, grads = wrong @ model.p["o"].T, {}
    model.back(x, "f", *forth, slope[:, :, : html.HIDDEN], grads)
    model.back(x_back, "b", *back, slope[:, :, html.HIDDEN:][turned, np.arange(2)], grads)
    for name in ("uf", "wb", "cf"):
        at = np.unravel_index(np.abs(grads[name]).argmax(), grads[name].shape)
        model.p[name][at] += 1e-3
        above = loss()
        model.p[name][at] -= 2e-3
        below = loss()
        model.p[name][at] += 1e-3
        assert abs((above - below) / 2e-3 - grads[name][at]) < 0.02 * abs(grads[name][at]) + 1e-3


def test_main_text(spark):
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet")
    model = html.fit(pages)
    found = {r.page_id: r.text for r in html.main_text(pages, model).collect()}
    right = 0
    for r in pages.collect():
        inside = [b.text for b in html.leaves(r.html) if "article" in b.path]
        right += found[r.page_id] == "\n".join(inside)
    assert right >= 0.95 * len(found)
    odd = spark.createDataFrame([(1, None, None, "x"), (2, "u", "", "x"), (2, "u", "", "x"), (None, None, PAGE, "x")], "page_id long, url string, html string, text string")
    texts = [(r.page_id, r.text) for r in html.main_text(odd, model).collect()]
    assert texts[:3] == [(1, ""), (2, ""), (2, "")] and "bold word here." in texts[3][1] and "Nav" not in texts[3][1]
    assert html.main_text(odd.limit(0), model).count() == 0
    assert html.main_text(odd, html.fit(odd.limit(0))).count() == 4


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_sql(spark, name):
    connection = duckdb.connect()
    for file in Path(FOLDER).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    cursor = connection.execute(ORACLE[name])
    columns = [d[0] for d in cursor.description]
    frame = QUERIES[name](spark, FOLDER)
    assert sorted(columns) == sorted(frame.columns)
    same(frame, columns, cursor.fetchall())


def test_empty_tables(empty):
    assert exact.exact_groups(empty).count() == exact.without_copies(empty).count() == 0
    assert substrings.without_repeats(empty).count() == jaccard.similar_groups(empty).count() == 0
    assert score.score(empty).count() == shards.shuffled_shards(empty).count() == packing.pack(empty).count() == 0


def test_pipeline(spark, small, empty):
    rows, docs = small
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "exact copies", "near copies", "benchmark leaks", "packing"]
    left = dict(rows)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, FOLDER).toPandas(), docs.schema)
        kept = {r.doc_id for r in docs.collect()}
        pairs = sorted(left.items())
        if name == "language":
            assert len(kept) >= 0.98 * len(left)
        elif name == "exact copies":
            assert kept == {r[0] for r in brute.exact(pairs) if r[3]}
        elif name == "near copies":
            near = brute.jaccard_groups(pairs, size=corpus_pipeline.NEAR_WORDS, percent=corpus_pipeline.NEAR_PERCENT)
            assert kept == {d for d, _, c in near if c == d}
        else:
            items = [decontaminate.normal(r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
            assert set(left) - kept >= {d for d, t in pairs if any(i in decontaminate.normal(t) for i in items)}
        left = {d: left[d] for d in kept}
    assert {r.doc_id for r in corpus_pipeline.run(spark, FOLDER).collect()} == set(left)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty.withColumn("source", empty.block), FOLDER).count() == 0, name


def test_patterned_words_are_told_apart(spark):
    one, other = thue_morse(1024)
    rows = [(1, f"{one} {one} {one}"), (2, f"{other} {other} {other}"), (3, " ".join([one] * 25)), (4, " ".join([other] * 25))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in jaccard.similar_groups(docs).collect()} == {1: 1, 2: 2, 3: 1, 4: 2}
    same(substrings.without_repeats(docs), ["doc_id", "n_words", "n_removed", "kept"], brute.repeats(rows, 20))
    known = {r.doc_id: r.n_known for r in score.score(docs).collect()}
    taught = {t.split()[0] for d, t in rows if zlib.crc32(str(d).encode()) % 5 != 1}
    assert known == {d: sum(w in taught for w in t.split()) + 1 for d, t in rows}


def test_number_signs_are_no_letters(spark):
    docs = spark.createDataFrame([(0, "½ ² ①"), (1, "Ⅷ ½"), (2, "")], "doc_id long, text string")
    model = language.fit(spark.read.parquet(f"{FOLDER}/documents.parquet"))
    assert {r.lang_pred for r in language.identify(docs, model).collect()} == {"und"}


def test_items_without_an_id_count(spark):
    docs = spark.createDataFrame([(1, "x the secret passage of the test y"), (2, "nothing here to be found at all")], "doc_id long, text string")
    items = spark.createDataFrame([(None, "the secret passage of the test")], "item_id long, text string")
    found = {r.doc_id: (r.contaminated, r.n_items, r.item_ids) for r in decontaminate.contamination(docs, items).collect()}
    assert found == {1: (True, 1, []), 2: (False, 0, [])}
    assert [r.doc_id for r in decontaminate.without_leaks(docs, items).collect()] == [2]


def test_passages_need_whole_numbers_as_ids(spark):
    with pytest.raises(TypeError, match="whole number"):
        substrings.without_repeats(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


HEAD, FIRST = "Bridge closes", "The old bridge over the river closed on Monday, the council said, after cracks were found."
SECOND = "Engineers will inspect it for two weeks before traffic may return to the crossing."


def page_in(opening, closing, inside=""):
    return (
        '<html><body><nav><ul><li><a href="a">Home</a></li><li><a href="b">News</a></li></ul></nav>'
        f"{opening}<h1>{HEAD}</h1><p>{FIRST}{inside}</p><p>{SECOND}</p>{closing}<footer><p>Copyright Some Press</p></footer></body></html>"
    )


def test_layouts_without_names_and_rare_elements(spark):
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet")
    model = html.fit(pages)
    whole = [HEAD, FIRST, SECOND]
    for opening, closing in (("<article>", "</article>"), ("<div id=page>", "</div>"), ("<div>", "</div>"),
                             ("<table><tr><td>", "</td></tr></table>"), ("<article><svg><path d=1>", "</article>")):
        assert html.texts_of([page_in(opening, closing)], model) == ["\n".join(whole)], opening
    head = f"<article><header><h1>{HEAD}</h1></header>"
    assert html.texts_of([page_in("", "").replace(f"<h1>{HEAD}</h1>", head).replace("<footer>", "</article><footer>")], model) == ["\n".join(whole)]
    formula = page_in("<article>", "</article>", " Then <math><mi>x</mi><mo>=</mo></math> 1.")
    assert html.texts_of([formula], model) == ["\n".join([HEAD, f"{FIRST} Then x= 1.", SECOND])]
    assert "Seen from above." in html.texts_of([page_in("<article>", "</article>", "<noscript>Seen from above.</noscript>")], model)[0]
    menu = f'<table><tr><td><a href="a">Home</a> <a href="b">News</a></td></tr><tr><td><h1>{HEAD}</h1><p>{FIRST}</p><p>{SECOND}</p></td></tr></table>'
    assert html.texts_of([menu], model) == ["\n".join(whole)]


def test_large_pages_teach(spark):
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet")
    large = pages.withColumn("html", F.concat("html", F.lit("<!-- " + "x" * 40_000 + " -->")))
    rows = pages.collect()
    wanted = ["\n".join(b.text for b in html.leaves(r.html) if "article" in b.path) for r in rows]
    assert html.texts_of([r.html for r in rows], html.fit(large)) == wanted
