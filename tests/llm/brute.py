"""Plain Python versions of the corpus operators, for small tables."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def crc(value):
    return zlib.crc32(("" if value is None else str(value)).encode())


def exact(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[sha(lower(text))].append(doc_id)
    found = []
    for doc_id, text in rows:
        group = groups[sha(lower(text))]
        keep = max((i for i in group if i is not None), default=None)
        found.append((doc_id, keep, len(group), doc_id == keep, sha(lower(text))))
    return found


def repeats(rows, window=20):
    def place(row):
        return (row[0] is not None, row[0] or 0, row[1] or "")

    seen, found = set(), []
    for doc_id, text in sorted(rows, key=place):
        w = words(text)
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            key = tuple(w[s: s + window])
            if key in seen:
                gone[s: s + window] = [True] * window
            seen.add(key)
        found.append((doc_id, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return found


def shingles(text, size=3):
    w = words(lower(text))
    if len(w) < size:
        return {tuple(w)} if w else set()
    return {tuple(w[i: i + size]) for i in range(len(w) - size + 1)}


def jaccard_groups(rows, size=3, percent=90):
    sets = [shingles(t, size) for _, t in rows]
    owner = list(range(len(rows)))

    def root(i):
        while owner[i] != i:
            i = owner[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                owner[root(i)] = root(j)
    least = defaultdict(lambda: None)
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[root(i)] = doc_id if least[root(i)] is None else min(doc_id, least[root(i)])
    return [(d, len(sets[i]), least[root(i)]) for i, (d, _) in enumerate(rows)]


def chats(rows, part_turns=1024):
    turns = defaultdict(set)
    for conv, turn, role, text in rows:
        turns[conv].add((turn, role, text))

    def place(t):
        digest = hashlib.md5(("\0null" if t[2] is None else t[2]).encode()).hexdigest()
        return (t[0] is not None, t[0] or 0, t[1] is not None, t[1] or "", digest)

    logs = {c: tuple(t[1:] for t in sorted(s, key=place)) for c, s in turns.items()}
    groups = defaultdict(list)
    for c, log in logs.items():
        groups[log].append(c)
    found = []
    for log, owners in groups.items():
        if any(len(o) > len(log) and o[: len(log)] == log for o in groups):
            continue
        keep = min((o for o in owners if o is not None), default=None)
        for part in range(0, len(log), part_turns):
            text = "".join(f"<|{r or 'unknown'}|>\n{t or ''}\n" for r, t in log[part: part + part_turns])
            found.append((keep, part // part_turns, len(log), len(owners), text))
    return found


def base_scores(rows):
    def tokens(text):
        return [*words(lower(text)), None]

    count = Counter()
    for doc_id, text in rows:
        if crc(doc_id) % 5 != 1:
            count.update(tokens(text))
    total = sum(count.values())
    return [
        (d, len(tokens(t)), sum(count[w] > 0 for w in tokens(t)), total,
         sum(math.log10((count[w] + 0.5) / (total + 0.5 * (len(count) + 1))) for w in tokens(t)))
        for d, t in rows
    ]


class Automaton:
    """Explicit states, arcs and failure arcs; states are tuples of up to two tokens, None ends a text, False begins one."""

    def __init__(self, rows):
        count = [Counter(), Counter(), Counter()]
        begun = 0
        for doc_id, text in rows:
            if crc(doc_id) % 5 != 1:
                line = [False, *words(lower(text)), None]
                begun += 1
                for n in range(3):
                    count[n].update(tuple(line[i: i + n + 1]) for i in range(len(line) - n))
        tokens = Counter({w: n for (w,), n in count[0].items() if w is not False})
        self.vocabulary = list(tokens)
        total = sum(tokens.values()) + 0.5 * (len(tokens) + 1)
        self.root = lambda w: math.log10((tokens[w] + 0.5) / total)
        self.arcs, self.failure = {}, {}
        for order in (1, 2):
            states = {s: n for s, n in count[order - 1].items() if s[-1] is not None}
            m = self.prior(list(states.values()), len(count[order]))
            for s, n in states.items():
                self.failure[s] = (s[1:], math.log10(m / (n + m)))
            for gram, n in count[order].items():
                lower_order = self.step(gram[1:-1], gram[-1])[0]
                self.arcs[gram[:-1], gram[-1]] = math.log10((n + m * 10 ** lower_order) / (states[gram[:-1]] + m))

    @staticmethod
    def prior(counts, arcs):
        classes = {}
        for n in counts:
            classes.setdefault(n.bit_length(), []).append(n)
        low, high = -3.0, 6.0
        for _ in range(60):
            m = 10 ** ((low + high) / 2)
            expected = sum(len(c) * m * math.log1p(sum(c) / len(c) / m) for c in classes.values())
            low, high = (math.log10(m), high) if expected < arcs else (low, math.log10(m))
        return 10 ** low

    def step(self, state, word):
        """Logarithm, failure arcs taken, and the state it arrives in."""
        log, failures = 0.0, 0
        while state and (state, word) not in self.arcs:
            if state in self.failure:
                log += self.failure[state][1]
                failures += 1
            state = state[1:]
        log += self.arcs[state, word] if state else self.root(word)
        return log, failures, (*state, word)[-2:]


def automaton_scores(rows):
    automaton, found = Automaton(rows), []
    for doc_id, text in rows:
        state, log, failures = (False,), 0.0, 0
        for word in [*words(lower(text)), None]:
            step, failed, state = automaton.step(state, word)
            log, failures = log + step, failures + failed
        found.append((doc_id, failures, log))
    return found


def infix_distance(pattern, text):
    row = list(range(len(pattern) + 1))
    best = row[-1]
    for letter in text:
        last, row[0] = row[0], 0
        for i, p in enumerate(pattern, 1):
            last, row[i] = row[i], min(row[i] + 1, row[i - 1] + 1, last + (p != letter))
        best = min(best, row[-1])
    return best
