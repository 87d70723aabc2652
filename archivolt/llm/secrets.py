"""Secret scans: fixed patterns, and probabilistic automata inferred from labelled credentials.

For every format of the labelled credentials a prefix tree of their characters is
built and states are merged where their counts are statistically compatible (the
Hoeffding test of state-merging grammar inference), which gives a probabilistic
automaton: its first states spell the marks of a format with their variants,
later ones loop over its random parts and the signs between them.  A character
that a state hasn't seen has a small chance and leaves the state as it is.

The candidates are all parts of all runs of credential characters.  An automaton
reads a run once, from every start at a time: of the readings that are in the
same state only the best goes on, and one that ordinary strings explain better is
given up.  The gain of a part is its log-likelihood by the format over that by a
model of ordinary strings, learned too; parts whose best format exceeds the
threshold are secrets.  Base spans get the best gain of a part of theirs as score.

Learning happens once on the driver from a bounded list of labelled strings; the
automata, of a bounded number of states, are broadcast, and the scan is one pass
over the texts without a shuffle.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from math import log, sqrt

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archivolt.llm.common import small_batches

SPANS = "array<struct<kind:string,start:int,end:int,score:double>>"
#: The base patterns, in the order of reports: a cheap test of the lower-case text, the pattern, and what a match has to fulfil.
#: Runs of the last two are maximal, so shorter ones needn't be matched and dropped.
BASE = (
    (
        "assign",
        lambda low: any(k in low for k in ("passw", "secret", "token", "api")),
        re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
        lambda m: len(m.group(2)) >= 12,
    ),
    ("access", lambda low: "akia" in low, re.compile(r"AKIA[A-Z0-9]{14,}"), lambda m: True),
    ("hex", lambda low: True, re.compile(r"[0-9a-f]{16,}"), lambda m: True),
)
#: Characters of a candidate, at least, and the runs that candidates are parts of.
LEAST = 16
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.:=~-]{16,}")

#: How sure a difference has to be to keep two states apart, and the visits below which a state is compatible with any.
ALPHA, LEAST_VISITS = 0.05, 8
#: Labelled credentials of a format that are learned from.
EXAMPLES = 200
#: A state of the prefix tree reads characters as themselves while so few of them make up all of its visits.
LITERALS = 6
#: The chance of a character that a state hasn't seen, over that in ordinary strings.
UNSEEN = 1e-3
#: A secret reaches to its last end that has gained so much less than the best one at most: less than one unseen character costs.
SLACK = 4.0
#: Gain in log-likelihood over ordinary strings (natural logarithm) that makes a secret.
THRESHOLD = 10.0

# Published shapes of credentials, as parts (choices of words, or an alphabet with the least and the most characters).
_UPPER, _LOWER, _DIGIT = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
_ALNUM, _HEX = _UPPER + _LOWER + _DIGIT, _DIGIT + "abcdef"
_URL = _ALNUM + "_-"
SHAPES: tuple[tuple[str, tuple], ...] = (
    ("cloud_key_id", (("AKIA", "ASIA", "AROA", "AIDA"), (_UPPER + "234567", 16, 16))),
    ("forge_token", (("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), (_ALNUM, 36, 36))),
    ("forge_scoped_token", (("github_pat_",), (_ALNUM, 22, 22), ("_",), (_ALNUM, 59, 59))),
    ("group_token", (("glpat-", "gldt-", "glrt-"), (_URL, 20, 20))),
    ("chat_token", (("xoxb-", "xoxp-", "xoxa-", "xoxr-"), (_DIGIT, 10, 13), ("-",), (_DIGIT, 10, 13), ("-",), (_ALNUM, 24, 32))),
    ("payment_key", (("sk_", "rk_", "pk_"), ("live_", "test_"), (_ALNUM, 24, 34))),
    ("map_key", (("AIza",), (_URL, 35, 35))),
    ("mail_key", (("SG.",), (_URL, 22, 22), (".",), (_URL, 43, 43))),
    ("package_token", (("npm_",), (_ALNUM, 36, 36))),
    ("index_token", (("pypi-AgEIcHlwaS5vcmc",), (_URL, 50, 90))),
    ("shop_token", (("shpat_", "shpca_", "shppa_", "shpss_"), (_HEX, 32, 32))),
    ("web_token", (("eyJhbGciOi", "eyJ0eXAiOi"), (_URL, 20, 40), (".eyJ",), (_URL, 40, 120), (".",), (_URL, 43, 43))),
    ("bot_token", ((_DIGIT, 8, 10), (":AA",), (_URL, 33, 33))),
)


def _drawn(draw: random.Random, parts: tuple) -> str:
    out = []
    for part in parts:
        if isinstance(part[-1], int):
            alphabet, low, high = part
            out.append("".join(draw.choices(alphabet, k=draw.randint(low, high))))
        else:
            out.append(draw.choice(part))
    return "".join(out)


def labelled(examples: int = EXAMPLES, seed: int = 7) -> list[tuple[str, str]]:
    """(format, credential): invented strings of the published shapes; the same on every call."""
    draw = random.Random(seed)
    return [(name, _drawn(draw, parts)) for name, parts in SHAPES for _ in range(examples)]


def ordinary(examples: int = 2000, seed: int = 8) -> list[str]:
    """Invented strings that are no secrets: words, names in several styles, paths, versions, digests, dates."""
    draw = random.Random(seed)
    word = lambda: "".join(draw.choice("bcdfghklmnprstvw") + draw.choice("aeiou") + draw.choice(["", "n", "r", "s", "t"]) for _ in range(draw.randint(1, 3)))
    kinds = (
        lambda: draw.choice("_-./").join(word() for _ in range(draw.randint(2, 6))),
        lambda: "".join(word().title() for _ in range(draw.randint(2, 5))),
        lambda: "_".join(word().upper() for _ in range(draw.randint(2, 4))),
        lambda: f"{word()}-{draw.randint(0, 9)}.{draw.randint(0, 30)}.{draw.randint(0, 999)}",
        lambda: "".join(draw.choices(_HEX, k=draw.choice([32, 40, 64]))),
        lambda: f"{draw.randint(1990, 2030)}-{draw.randint(1, 12):02}-{draw.randint(1, 28):02}/{word()}{draw.randint(0, 9999)}",
    )
    return [draw.choice(kinds)() for _ in range(examples)]


# --- grammar inference -----------------------------------------------------------

#: Classes of characters, for states that see too many to tell them one by one.
_CLASS = {**dict.fromkeys(_UPPER, "A"), **dict.fromkeys(_LOWER, "a"), **dict.fromkeys(_DIGIT, "0")}
_CLASSES = frozenset("Aa0")


@dataclass
class Automaton:
    """``step[state][character]`` is (next state, log probability); ``end[state]`` the log probability of ending, None where a credential's marks aren't spelled yet."""

    name: str
    step: list[dict[str, tuple[int, float]]]
    end: list[float | None]
    least: int  # characters of the shortest labelled credential
    lasts: frozenset[str]  # characters that labelled credentials end with, and others of their classes


@dataclass
class _State:
    """Counts of a state; ``out[symbol]`` is [next state, times taken].  A class is a symbol with a sign before it."""

    visits: int
    ends: int
    out: dict[str, list[int]]
    classes: bool = False


def _same_share(f1: int, n1: int, f2: int, n2: int) -> bool:
    """Whether two shares may be the same (Hoeffding)."""
    if n1 < LEAST_VISITS or n2 < LEAST_VISITS:
        return True
    return abs(f1 / n1 - f2 / n2) < sqrt(0.5 * log(2 / ALPHA)) * (1 / sqrt(n1) + 1 / sqrt(n2))


def _prefix_tree(rows: list[str]) -> list[_State]:
    """Counts of all prefixes; where a state has more than ``LITERALS`` different characters, they and all behind them are read as classes."""
    tree = [_State(0, 0, {})]
    waiting = [(0, sorted(rows), 0, False)]
    while waiting:
        at, held, depth, classes = waiting.pop()
        by: dict[str, list[str]] = {}
        for c in held:
            if len(c) > depth:
                by.setdefault(c[depth], []).append(c)
        tree[at].visits, tree[at].ends = len(held), sum(len(c) == depth for c in held)
        classes = tree[at].classes = classes or len(by) > LITERALS
        if classes:
            merged: dict[str, list[str]] = {}
            for x, found in by.items():
                merged.setdefault("\0" + _CLASS[x] if x in _CLASS else x, []).extend(found)
            by = merged
        for x, found in sorted(by.items()):
            tree[at].out[x] = [len(tree), len(found)]
            waiting.append((len(tree), found, depth + 1, classes))
            tree.append(_State(0, 0, {}))
    return tree


def _compatible(tree: list[_State], a: int, b: int) -> bool:
    """Whether the subtree of b may be drawn from what a stands for; of a state with few visits, whether a knows its characters."""
    if tree[a].classes != tree[b].classes:
        return False
    if tree[b].visits < LEAST_VISITS:
        return tree[b].out.keys() <= tree[a].out.keys()
    stack = [(a, b)]
    while stack:
        p, q = (tree[i] for i in stack.pop())
        if not _same_share(p.ends, p.visits, q.ends, q.visits):
            return False
        for x in p.out.keys() | q.out.keys():
            u, v = p.out.get(x, (None, 0)), q.out.get(x, (None, 0))
            if not _same_share(u[1], p.visits, v[1], q.visits):
                return False
            if u[0] is not None and v[0] is not None and tree[v[0]].visits >= LEAST_VISITS:
                stack.append((u[0], v[0]))
    return True


def _fold(tree: list[_State], a: int, b: int) -> None:
    """Add the counts of the subtree of b to a."""
    stack = [(a, b)]
    while stack:
        p, q = (tree[i] for i in stack.pop())
        p.visits += q.visits
        p.ends += q.ends
        for x, (target, times) in q.out.items():
            if x in p.out:
                p.out[x][1] += times
                stack.append((p.out[x][0], target))
            else:
                p.out[x] = [target, times]


def infer(name: str, credentials: list[str]) -> Automaton:
    """Merge compatible states of the prefix tree, those nearest the root first, into a probabilistic automaton."""
    tree = _prefix_tree(credentials)
    kept = [0]
    waiting = [(0, x) for x in sorted(tree[0].out)]
    while waiting:
        source, x = waiting.pop(0)
        state = tree[source].out[x][0]
        if state in kept:
            continue
        fitting = [k for k in kept if _compatible(tree, k, state)]
        into = max(fitting, key=lambda k: tree[k].visits, default=None)  # the best known of them
        if into is None:
            kept.append(state)
        else:
            tree[source].out[x][0] = into
            _fold(tree, into, state)
        waiting = [(k, x) for k in kept for x in sorted(tree[k].out) if tree[k].out[x][0] not in kept]
    # a class stands for those of its characters that the format has: a hexadecimal part isn't one of all letters
    seen = {x: sorted({c for row in credentials for c in row if _CLASS.get(c) == x}) for x in _CLASSES}
    place = {k: i for i, k in enumerate(kept)}
    step, end = [], []
    for k in kept:
        total = tree[k].ends + sum(times for _, times in tree[k].out.values())
        edges: dict[str, tuple[int, float]] = {}
        for x, (target, times) in tree[k].out.items():
            chars = seen[x[1:]] if x[0] == "\0" else [x]
            for c in chars:
                edges[c] = (place[target], log(times / total / len(chars)))
        step.append(edges)
        end.append(log(max(tree[k].ends, 0.5) / (total + 0.5)) if tree[k].classes or tree[k].ends else None)
    lasts = {c[-1] for c in credentials}
    lasts = lasts.union(*(seen[_CLASS[c]] for c in lasts if c in _CLASS))
    return Automaton(name, step, end, min(map(len, credentials)), frozenset(lasts))


def learn(rows: list[tuple[str, str]]) -> list[Automaton]:
    """An automaton for each format of (format, credential), from ``EXAMPLES`` of a format at most."""
    of: dict[str, list[str]] = {}
    for name, credential in rows:
        if name is not None and credential:
            of.setdefault(name, [])
            if len(of[name]) < EXAMPLES:
                of[name].append(credential)
    return [infer(name, found) for name, found in sorted(of.items())]


def ordinary_model(rows: list[str]) -> dict[str, float]:
    """Log probabilities of the characters of ordinary strings: those of the classes, evenly within each, signs one by one."""
    counts: dict[str, int] = {}
    for row in rows:
        for c in row:
            x = _CLASS.get(c, c)
            counts[x] = counts.get(x, 0) + 1
    total = sum(counts.values()) + 80
    size = {"A": 26, "a": 26, "0": 10}
    return {c: log((counts.get(x := _CLASS.get(c, c), 0) + size.get(x, 1)) / total / size.get(x, 1)) for c in _ALNUM + "+/_.=~-:"}


class Scanner:
    """Reads runs with all automata at a time."""

    def __init__(self, automata: list[Automaton], base: dict[str, float] | None = None):
        self.automata = automata
        self.base = ordinary_model(ordinary()) if base is None else base
        self.starts: dict[str, list[tuple[int, int, float]]] = {}  # character -> (automaton, state, gain)
        for i, a in enumerate(automata):
            for c, (state, p) in a.step[0].items():
                self.starts.setdefault(c, []).append((i, state, p - self.base.get(c, 0.0)))
        self.rare = log(UNSEEN)

    def parts(self, run: str, threshold: float) -> list[tuple[float, int, int, str]]:
        """(gain, start, end, format) of the parts that reach the threshold; of overlapping ones the best."""
        alive: dict[tuple[int, int], tuple[float, int]] = {}  # (automaton, state) -> (gain, start)
        found: dict[tuple[int, int], tuple[float, int]] = {}  # (automaton, start) -> (gain, end)
        for at, c in enumerate(run):
            base, after = self.base.get(c, 0.0), {}
            for (i, state), (gain, start) in alive.items():
                got = self.automata[i].step[state].get(c)
                state, gain = (got[0], gain + got[1] - base) if got else (state, gain + self.rare)
                if gain > 0 and ((i, state) not in after or after[i, state][0] < gain):
                    after[i, state] = (gain, start)
            for i, state, gain in self.starts.get(c, ()):
                if gain > 0 and ((i, state) not in after or after[i, state][0] < gain):
                    after[i, state] = (gain, at)
            alive = after
            for (i, state), (gain, start) in alive.items():
                a = self.automata[i]
                ending, n = a.end[state], at + 1 - start
                best = found.get((i, start), (0.0, 0))[0]
                if ending is not None and c in a.lasts and n >= max(a.least, LEAST) and gain + ending >= threshold and gain >= best - SLACK:
                    found[i, start] = (max(best, gain), at + 1)
        kept: list[tuple[float, int, int, str]] = []
        taken: list[tuple[int, int]] = []  # of kept, sorted
        for gain, start, end, name in sorted(((g, s, e, self.automata[i].name) for (i, s), (g, e) in found.items()), key=lambda x: (-x[0], x[1], x[3])):
            place = bisect_left(taken, (start, end))
            if (place == len(taken) or taken[place][0] >= end) and (not place or taken[place - 1][1] <= start):
                taken.insert(place, (start, end))
                kept.append((gain, start, end, name))
        return kept


def _confidence(gain: float) -> float:
    return round(1 - 1 / (1 + max(gain, 0.0)), 6)


def scan(text: str | None, scanner: Scanner, threshold: float = THRESHOLD) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) of the base spans and of those that the automata add, by start."""
    if not text:
        return []
    low = text.lower()
    base = [(rank, kind, m.start(), m.end()) for rank, (kind, may, rx, valid) in enumerate(BASE) if may(low) for m in rx.finditer(text) if valid(m)]
    added = []
    for m in CANDIDATE.finditer(text):
        added += [(m.start() + start, m.start() + end, gain, name) for gain, start, end, name in scanner.parts(m.group(), threshold)]
    added.sort()
    starts = [x[0] for x in added]
    found = []
    for rank, kind, start, end in base:  # the gain of the best part within
        within = added[bisect_left(starts, start) : bisect_left(starts, end)]
        found.append((rank, kind, start, end, _confidence(max((gain for _, stop, gain, _ in within if stop <= end), default=0.0))))
    found += [(len(BASE), name, start, end, _confidence(gain)) for start, end, gain, name in added]
    found.sort(key=lambda s: (s[2], s[0], s[1]))
    return [s[1:] for s in found]


def find_secrets(docs: DataFrame, automata: list[Automaton] | None = None, *, text: str = "text", into: str = "secrets", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``into``: spans (kind, start, end, score) by start, then kind.

    Positions are code points, ends exclusive.  Null and empty texts have no
    spans; kinds are searched apart and may overlap; equal rows are judged alike.
    A base span that holds no part of a learned format has score 0.  Without
    ``automata`` those of the published shapes are learned.
    An empty table stays empty; a column that is already named like ``into`` is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Scanner(learn(labelled()) if automata is None else automata))

    def scanned(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        learned = shared.value
        for texts in batches:
            rows = [[dict(zip(("kind", "start", "end", "score"), s, strict=True)) for s in scan(t, learned, threshold)] for t in texts]
            yield pd.Series(rows, index=texts.index, dtype=object)

    return small_batches(docs).withColumn(into, F.pandas_udf(scanned, SPANS).asNondeterministic()(F.col(f"`{text}`")))


def digest(found: DataFrame, doc_id: str = "doc_id", spans: str = "secrets") -> DataFrame:
    """The contract's columns."""
    base = [b[0] for b in BASE]
    written = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    of = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        F.col(doc_id).alias("doc_id"),
        *[of(k) for k in base],
        F.sha2(F.array_join(F.transform(F.filter(spans, lambda s: s["kind"].isin(base)), written), ","), 256).alias("base_sha256"),
        F.array_join(F.transform(spans, written), ",").alias("spans"),
    )
