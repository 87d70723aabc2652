"""Quality rules with cutoffs whose false rejections are bounded on labelled rows.

Every text is measured by DataFrame functions alone.  The base rules are fixed.
Further rules compare a ratio with a cutoff of a grid, and the cutoffs are
learned per stratum.  One fold of the labelled rows orders the sets of cutoffs: a
sequence of rule sets, each rejecting more than the one before it, by how many bad
documents a step catches and how few good ones it costs.  The other fold, which
has no say in the order, tests that sequence: a set may be used only where the
exact (Clopper-Pearson) upper bound of its false rejections, all rules together,
stays below the allowed risk.  Sets are tested in their order up to the first that
fails, so they need no correction among themselves; the confidence is shared evenly
among the strata (Bonferroni), and a stratum whose sequence holds to its end passes
its part on to the others.  So the guarantee holds for all strata at once.  Strata with too few labelled good documents for any guarantee are
pooled into one.

Only a contingency table of cutoffs exceeded reaches the driver.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil, exp, lgamma, log, log1p

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archivolt.llm.common import SPACE_CLASS, let, materialize

#: Documents with fewer words fail.
LEAST_WORDS = 10
#: Documents with a larger share of repeated words (per cent) fail.
MOST_REPEATED = 20
WINDOW = 5
#: The share of good documents of a stratum that all learned rules together may reject, and the chance of being wrong.
RISK, ERROR = 0.02, 0.05
#: Of the documents that a step of the sequence adds to those rejected, so many must be bad.
LEAST_PRECISION = 0.9
#: Steps of a stratum's sequence, at most (the grids have no more).
MOST_STEPS = 40
#: Strata with labels enough for rules of their own; more are an error, none is left out.
MOST_STRATA = 2000
OTHER = "*"
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@dataclass(frozen=True)
class Rule:
    """Reject where ``ratio`` exceeds a cutoff of the grid."""

    name: str
    ratio: Column
    grid: tuple[float, ...]


def _share(n: str, of: str) -> Column:
    return F.coalesce(F.col(n) / F.when(F.col(of) > 0, F.col(of)), F.lit(0.0))


def rules() -> list[Rule]:
    """The learned rules over the measures; grids of few cutoffs keep the contingency table small."""
    return [
        Rule("symbols", _share("n_symbols", "word_chars"), (0.01, 0.02, 0.05, 0.1, 0.2, 0.4)),
        Rule("capitals", _share("n_capitals", "word_chars"), (0.1, 0.2, 0.3, 0.5, 0.7)),
        Rule("dup_lines", _share("n_dup_lines", "n_lines"), (0.05, 0.1, 0.2, 0.4, 0.6)),
        Rule("repeats", _share("n_repeat_words", "n_words"), (0.02, 0.05, 0.1, 0.15)),
        Rule("word_length", _share("word_chars", "n_words"), (7.0, 8.0, 10.0, 16.0, 50.0)),
    ]


# --- measures -------------------------------------------------------------------


def _repeated(words: Column) -> Column:
    """Words inside windows that occur twice or more.

    Windows are compared by 64-bit hashes.  Most texts repeat none, which their
    distinct hashes tell; only the others are sorted by (hash, place).
    """
    n = F.size(words) - (WINDOW - 1)
    at = lambda i, k: F.get(words, i + k)
    hashes = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.xxhash64(*[at(i, k) for k in range(WINDOW)]))

    def count(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            same = lambda a, b: F.coalesce(F.get(s, a)["h"] == b["h"], F.lit(False))
            marked = F.transform(s, lambda x, j: F.when(same(j - 1, x) | same(j + 1, x), x["i"]))
            return F.sort_array(F.filter(marked, lambda p: p.isNotNull()))

        covered = lambda p: F.aggregate(
            p,
            F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
            lambda acc, x: F.struct((acc["n"] + F.least(F.lit(WINDOW), x - acc["last"])).alias("n"), x.alias("last")),
            lambda acc: acc["n"],
        )
        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(let(let(pairs, places), covered))

    return F.when(n < 2, F.lit(0)).otherwise(let(hashes, count)).cast("long")


def measure(docs: DataFrame, *, text: str = "text", into: str = "quality") -> DataFrame:
    """``docs`` with ``into``: n_words, word_chars, n_symbols, n_capitals, n_lines, n_dup_lines, n_repeat_words.

    Words are runs of anything but ASCII white space; lines are what \\n parts
    and have a word.  Null and empty texts measure zero throughout.
    An empty table stays empty; a column that is already named like ``into`` is replaced.
    """
    held = F.coalesce(F.col(f"`{text}`"), F.lit(""))

    def of(t: Column) -> Column:
        words = F.filter(F.split(t, f"[{SPACE_CLASS}]+"), lambda w: w != "")
        lines = F.filter(F.split(t, "\n"), lambda x: F.rlike(x, F.lit(f"[^{SPACE_CLASS}]")))

        def counted(w: Column) -> Column:
            return F.struct(
                F.size(w).cast("long").alias("n_words"),
                F.length(F.translate(t, " \t\n\x0b\f\r", "")).cast("long").alias("word_chars"),
                (F.length(t) - F.length(F.translate(t, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
                (F.length(t) - F.length(F.translate(t, _CAPITALS, ""))).cast("long").alias("n_capitals"),
                F.size(lines).cast("long").alias("n_lines"),
                (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
                _repeated(w).alias("n_repeat_words"),
            )

        return let(words, counted)

    return docs.withColumn(into, let(held, of))


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


# --- cutoffs --------------------------------------------------------------------


def _at_most(k: int, n: int, p: float) -> float:
    """The chance of k or fewer of n, each of chance p: the regularised incomplete beta function by its continued fraction."""
    if p <= 0 or k >= n:
        return 1.0
    if p >= 1:
        return 0.0
    a, b, x = n - k, k + 1, 1 - p  # I_x(a, b)
    swap = x > (a + 1) / (a + b + 2)
    if swap:
        a, b, x = b, a, 1 - x
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log1p(-x)) / a
    c, d, value, tiny = 1.0, 0.0, 1.0, 1e-300
    for i in range(10_000):
        m = i // 2
        term = 1.0 if not i else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / ((1 + term * d) or tiny)
        c = (1 + term / c) or tiny
        value *= c * d
        if abs(c * d - 1) < 1e-14 and i:
            break
    share = front * (value - 1)
    return 1 - share if swap else share


def upper_bound(k: int, n: int, error: float) -> float:
    """The exact upper confidence bound of a share, k of n seen: the p at which k or fewer have the chance ``error``."""
    if k >= n:
        return 1.0
    low, high = k / n, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        if _at_most(k, n, mid) > error:
            low = mid
        else:
            high = mid
    return high


def _stratum(strata: list[str]) -> Column:
    lang = F.coalesce(F.col("stratum"), F.lit(""))
    return F.when(lang.isin(strata), lang).otherwise(F.lit(OTHER)) if strata else F.lit(OTHER)


def sequence(cells: list[tuple[tuple[int, ...], bool, int]], found: list[Rule]) -> list[tuple[int, ...]]:
    """Rule sets, each rejecting more than the one before: for every rule the cutoffs of its grid that are exceeded before it rejects (past the grid: never).

    ``cells``: (cutoffs exceeded by rule, good, rows) of the ordering fold.  A
    step makes one rule stricter, the one that catches most further bad rows at
    ``LEAST_PRECISION``; steps that catch none end the sequence.
    """
    now = tuple(len(r.grid) + 1 for r in found)
    out: list[tuple[int, ...]] = []
    left = cells
    while len(out) < MOST_STEPS:
        best = (0, 0, 0)
        for i in range(len(found)):
            for level in range(now[i] - 1, 0, -1):
                bad = sum(n for over, good, n in left if not good and over[i] >= level)
                wrong = sum(n for over, good, n in left if good and over[i] >= level)
                if bad >= LEAST_PRECISION * (bad + wrong) and bad > best[0]:
                    best = (bad, i, level)
        if not best[0]:
            break
        now = tuple(best[2] if i == best[1] else level for i, level in enumerate(now))
        out.append(now)
        left = [x for x in left if x[0][best[1]] < best[2]]
    return out


def _guaranteed(rejected: list[int], good: int, risk: float, error: float) -> int:
    """How many sets of the sequence keep the bound, tested in order up to the first that fails."""
    kept = 0
    for seen in rejected:
        if upper_bound(seen, good, error) > risk:
            break
        kept += 1
    return kept


def choose(table: dict[tuple[str, bool], list[tuple[tuple[int, ...], bool, int]]], found: list[Rule], risk: float, error: float) -> dict[tuple[str, str], float]:
    """(stratum, rule) -> cutoff, from the cells of each (stratum, whether its fold orders the sets)."""
    tested: dict[str, tuple[list[tuple[int, ...]], list[int], int]] = {}
    for stratum in sorted({name for name, _ in table}):
        sets = sequence(table.get((stratum, True), []), found)
        good = [(over, n) for over, fine, n in table.get((stratum, False), []) if fine]
        if sets and good:
            rejected = [sum(n for over, n in good if any(o >= level for o, level in zip(over, s, strict=True))) for s in sets]
            tested[stratum] = (sets, rejected, sum(n for _, n in good))
    # every stratum starts with an even part of the error; a sequence that holds to its end passes its part on
    part = dict.fromkeys(sorted(tested), error / max(1, len(tested)))
    open_ones, kept = sorted(tested), dict.fromkeys(tested, 0)
    while done := [s for s in open_ones if _guaranteed(*tested[s][1:], risk, part[s]) == len(tested[s][0])]:
        kept[done[0]] = len(tested[done[0]][0])
        open_ones.remove(done[0])
        for s in open_ones:
            part[s] += part[done[0]] / len(open_ones)
    kept |= {s: _guaranteed(*tested[s][1:], risk, part[s]) for s in open_ones}
    chosen: dict[tuple[str, str], float] = {}
    for stratum, (sets, _, _) in tested.items():
        for rule, level in zip(found, sets[kept[stratum] - 1] if kept[stratum] else (), strict=False):
            if level <= len(rule.grid):
                chosen[stratum, rule.name] = sorted(rule.grid)[level - 1]
    return chosen


def cutoffs(measured: DataFrame, labels: DataFrame, *, risk: float = RISK, error: float = ERROR) -> tuple[list[str], dict[tuple[str, str], float]]:
    """The strata with rules of their own, and (stratum, rule) -> cutoff where one is guaranteed and useful.

    ``measured`` has doc_id, stratum and the measures; ``labels`` doc_id and
    quality.  Labels that contradict each other for a document, null labels and
    labels of no document are left out.  Of the labelled rows a third, by a hash
    of the id, orders the rule sets; the others bound the false rejections.
    """
    clear = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("most"))
    clear = clear.where("quality = most").select("doc_id", "quality")
    rows = measured.where("doc_id is not null").where(~base_failed()).join(clear, "doc_id")
    found = rules()
    orders = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(3)) == 0
    exceeded = [sum((F.when(r.ratio > F.lit(c), 1).otherwise(0) for c in r.grid), F.lit(0)).alias(f"r{i}") for i, r in enumerate(found)]
    levels = [f"r{i}" for i in range(len(found))]
    cells = rows.select(F.coalesce("stratum", F.lit("")).alias("stratum"), (F.col("quality") > 0).alias("good"), orders.alias("orders"), *exceeded)
    counts = cells.groupBy("stratum", "good", "orders", *levels).agg(F.count("*").alias("n"))
    # so many good rows without a false rejection bound the risk of one stratum among so many that may have rules
    enough = lambda strata: ceil(log(error / strata) / log1p(-risk))
    sizes = counts.where("good and not orders").groupBy("stratum").agg(F.sum("n").alias("n")).where(F.col("n") >= enough(1)).limit(MOST_STRATA + 1).collect()
    if len(sizes) > MOST_STRATA:
        raise ValueError(f"more than {MOST_STRATA} strata have labels enough for rules of their own")
    strata = sorted(r["stratum"] for r in sizes if r["n"] >= enough(len(sizes) + 1))  # and all others, as one
    merged = counts.groupBy(_stratum(strata).alias("stratum"), "good", "orders", *levels).agg(F.sum("n").alias("n")).collect()  # cells of the grids for each stratum, at most
    table: dict[tuple[str, bool], list[tuple[tuple[int, ...], bool, int]]] = {}
    for r in merged:
        table.setdefault((r["stratum"], r["orders"]), []).append((tuple(r[x] for x in levels), r["good"], r["n"]))
    return strata, choose(table, found, risk, error)


def judge(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", stratum: str = "lang", risk: float = RISK, error: float = ERROR) -> DataFrame:
    """(doc_id, measures, base_failed, rejected_by, kept), a row per row of ``docs``.

    ``rejected_by`` names the learned rules whose cutoff a document exceeds.  A
    stratum without enough labelled good documents has no cutoff, so nothing of
    it is rejected beyond the base rules; so it is for all without labels.
    """
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{stratum}`").cast("string").alias("stratum"), F.col(f"`{text}`").alias("text"))
    measured = materialize(measure(rows).select("doc_id", "stratum", "quality.*"), "quality")
    strata, chosen = cutoffs(measured, labels, risk=risk, error=error)
    own = _stratum(strata)
    hits = []
    for rule in rules():
        mine = {s: c for (s, name), c in chosen.items() if name == rule.name}
        if mine:
            cut = F.create_map(*[F.lit(x) for pair in sorted(mine.items()) for x in pair])[own]
            hits.append(F.when(rule.ratio > cut, F.lit(rule.name)))
    rejected = F.array_compact(F.array(*hits)) if hits else F.array().cast("array<string>")
    judged = measured.withColumn("base_failed", base_failed()).withColumn("rejected_by", rejected)
    return judged.withColumn("kept", ~F.col("base_failed") & (F.size("rejected_by") == 0)).drop("stratum")


def digest(judged: DataFrame) -> DataFrame:
    """The contract's columns, and the rules that rejected a document."""
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.array_join("rejected_by", ",").alias("rejected_by"))
