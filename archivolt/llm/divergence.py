"""How far the sources of a language differ in their words, by an inverted index of corrections.

Every (lang, source) group gives each kept term a smoothed share p in billionths.
Two groups differ by the sum of |p - q| over all kept terms.  Nearly all counts of
a pair are zero on both sides, so a pair starts at V times the difference of the two
shares of a zero count, and the index's postings add what differs from that:

* a term of one group alone differs from the other's zero share z by |p - z|;
  summed over the group this needs only the number and the sum of its shares, and
  the few shares below z (``low``);
* a term of both groups replaces the two parts by |p - q|: the join of the
  postings with themselves emits these, and only where they aren't zero.

All numbers are integers, so the sums are exact in any order.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from archivolt.llm.common import materialize, small_batches

#: Documents of its language that a kept term is in, added to every count, the shares' unit, ranks of terms.
LEAST_DOCS, SMOOTH, UNIT, RANKS = 30, 5, 1_000_000_000, 50
#: Counts that a task holds before it passes them on, and rows of a batch that it passes on.
HELD, BATCH = 400_000, 50_000
#: Parts into which a language's groups are dealt when pairs are made.
PARTS = 16

_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def _letters() -> bytes:
    """By byte: A-Z lower-cased, a-z and the bytes of other characters as they are, a space for all that ends a term."""
    upper, lower = range(ord("A"), ord("Z") + 1), range(ord("a"), ord("z") + 1)
    return bytes(b + 32 if b in upper else b if b in lower or b >= 0x80 else 0x20 for b in range(256))


_LETTERS = _letters()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, occurrences, documents): partial counts of whole texts, passed on when ``HELD`` are held."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def passed() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            terms = list(n)
            for i in range(0, len(terms), BATCH):
                some = terms[i : i + BATCH]
                yield pa.RecordBatch.from_arrays([pa.repeat(lang, len(some)), pa.repeat(source, len(some)), pa.array(some, pa.string()), pa.array([n[t] for t in some], pa.int64()), pa.array([docs[t] for t in some], pa.int64())], schema=_COUNTS)
        held.clear()

    for batch in batches:
        for lang, source, text in zip(*(c.to_pylist() for c in batch.columns)):
            terms = text.encode().translate(_LETTERS).split()
            n, docs = held.setdefault((lang, source), (Counter(), Counter()))
            n.update(terms)
            docs.update(set(terms))
        if sum(len(n) for n, _ in held.values()) > HELD:
            yield from passed()
    yield from passed()


def term_counts(docs: DataFrame, *, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(lang, source, term, n, of_lang, first): occurrences of every kept term in the groups that have it.

    ``of_lang`` are those in the whole language; ``first`` marks one row of each
    term.  The counts are dealt by (lang, term) once: sums by group, the documents
    of the language and the postings all stand in the same place.
    """
    plain = small_batches(docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")]))
    parts = plain.mapInArrow(_counted, "lang string, source string, term string, n long, docs long").repartition("lang", "term")
    groups = parts.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = W.Window.partitionBy("lang", "term")
    rows = groups.withColumns({"in_docs": F.sum("docs").over(term), "of_lang": F.sum("n").over(term), "least": F.min("source").over(term)})
    return rows.where(F.col("in_docs") >= least_docs).select("lang", "source", "term", "n", "of_lang", (F.col("source") == F.col("least")).alias("first"))


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(UNIT (count + SMOOTH) / (total + SMOOTH kept)), exact whatever the counts; null where nothing is kept."""
    above = (F.lit(UNIT).cast("decimal(10,0)") * (count + SMOOTH).cast("decimal(19,0)")).cast("decimal(30,0)")
    below = (total + SMOOTH * kept).cast("decimal(20,0)")
    return F.when(kept > 0, 1 + F.call_function("div", above, below)).cast("long")


def audit(docs: DataFrame, *, least_docs: int = LEAST_DOCS, ranks: int = RANKS) -> DataFrame:
    """(lang, source, part, item, value, rank): how each group differs from the others, and by which terms.

    ``docs``: lang, source, text and others, which are left aside; nulls are empty
    strings, every row is a document of its own.  Part ``pair`` has every other
    source of the language with the sum of differences over all kept terms, all
    ranks; part ``term`` the terms that the group has more of than its language,
    ``ranks`` of them.  Ties rank by item.  A group without terms has its pairs;
    a language without kept terms has pairs of value 0; an empty table gives no rows.
    """
    counts = materialize(term_counts(docs, least_docs=least_docs), "counts")
    langs = counts.groupBy("lang").agg(F.count_if("first").alias("kept"), F.sum("n").alias("of_all"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    every = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    groups = every.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["total", "kept", "of_all"])
    groups = materialize(groups.withColumn("zero", F.coalesce(share(F.lit(0), F.col("total"), F.col("kept")), F.lit(0))), "groups")

    known = counts.join(groups, ["lang", "source"])
    index = materialize(
        known.select("lang", "source", "term", "zero", share(F.col("n"), F.col("total"), F.col("kept")).alias("p"), share(F.col("of_lang"), F.col("of_all"), F.col("kept")).alias("q")),
        "index",
    )
    return _pairs(groups, index).unionByName(_terms(index, ranks))


def _pairs(groups: DataFrame, index: DataFrame) -> DataFrame:
    top = groups.groupBy("lang").agg(F.max("zero").alias("top"))
    low = F.col("p") < F.col("top")
    shares = index.join(top, "lang").groupBy("lang", "source", F.when(low, F.col("p")).alias("below")).agg(F.count("*").alias("m"), F.sum("p").alias("s"))
    sums = shares.groupBy("lang", "source").agg(F.sum("m").alias("terms"), F.sum("s").alias("shares"), F.collect_list(F.when(F.col("below").isNotNull(), F.struct("below", "m"))).alias("low"))
    group = groups.join(sums, ["lang", "source"], "left").na.fill(0, ["terms", "shares"]).withColumn("low", F.coalesce("low", F.array().cast("array<struct<below:long,m:long>>")))

    one = group.select("lang", "source", "kept", *[F.col(c).alias(f"g_{c}") for c in ("zero", "terms", "shares", "low")], F.pmod(F.xxhash64("source"), F.lit(PARTS)).alias("part"))
    other = group.select("lang", F.col("source").alias("item"), *[F.col(c).alias(f"h_{c}") for c in ("zero", "terms", "shares", "low")], F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long"))).alias("part"))
    pairs = one.join(other, ["lang", "part"]).where("source != item")

    apart = F.abs(F.col("g_zero") - F.col("h_zero"))

    def alone(of: str, zero: Column) -> Column:
        """What a group's own terms add where the other has none of them."""
        under = F.aggregate(F.filter(f"{of}_low", lambda x: x["below"] < zero), F.lit(0).cast("long"), lambda a, x: a + (zero - x["below"]) * x["m"])
        return F.col(f"{of}_shares") - F.col(f"{of}_terms") * (zero + apart) + 2 * under

    start = F.col("kept") * apart + alone("g", F.col("h_zero")) + alone("h", F.col("g_zero"))
    pairs = pairs.select("lang", "source", "item", start.alias("start"), F.least("source", "item").alias("a"), F.greatest("source", "item").alias("b"))

    side = lambda name: index.select("lang", "term", F.col("source").alias(name), F.col("p").alias(f"{name}_p"), F.col("zero").alias(f"{name}_zero"))
    both = F.expr("abs(a_p - b_p) - abs(a_p - b_zero) - abs(b_p - a_zero) + abs(a_zero - b_zero)")
    shared = side("a").join(side("b"), ["lang", "term"]).where("a < b").select("lang", "a", "b", both.alias("more")).where("more != 0")
    found = shared.groupBy("lang", "a", "b").agg(F.sum("more").alias("more"))
    value = F.col("start") + F.coalesce("more", F.lit(0))
    valued = pairs.join(found, ["lang", "a", "b"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", value.cast("long").alias("value"))
    return valued.withColumn("rank", F.row_number().over(_order()))


def _terms(index: DataFrame, ranks: int) -> DataFrame:
    more = index.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    return more.withColumn("rank", F.row_number().over(_order())).where(F.col("rank") <= ranks)  # tasks keep their own first ranks before the shuffle


def _order() -> W.WindowSpec:
    return W.Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")


def oracle_sql() -> str:
    """The same from its definition, in DuckDB's SQL: every kept term of every pair."""
    return f"""
with d as (select row_number() over () as doc, coalesce(lang, '') as lang, coalesce(source, '') as source, coalesce(text, '') as text from documents),
tok as (
  select doc, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as term from d
),
kept as (select lang, term, count(*) as of_lang from tok group by lang, term having count(distinct doc) >= {LEAST_DOCS}),
v as (select lang, count(*) as v, sum(of_lang) as n from kept group by lang),
n as (select lang, source, term, count(*) as n from tok semi join kept using (lang, term) group by lang, source, term),
g as (
  select g.lang, g.source, coalesce(v.v, 0) as v, coalesce((select sum(n.n) from n where n.lang = g.lang and n.source = g.source), 0) as total
  from (select distinct lang, source from d) g left join v on v.lang = g.lang
),
p as (
  select g.lang, g.source, k.term, coalesce(n.n, 0) as n,
    1 + ({UNIT}::hugeint * (coalesce(n.n, 0) + {SMOOTH})) // (g.total + {SMOOTH} * g.v)::hugeint as p,
    1 + ({UNIT}::hugeint * (k.of_lang + {SMOOTH})) // (v.n + {SMOOTH} * v.v)::hugeint as q
  from g join kept k on k.lang = g.lang join v on v.lang = g.lang left join n on n.lang = g.lang and n.source = g.source and n.term = k.term
),
dist as (select a.lang, a.source, b.source as item, sum(abs(a.p - b.p)) as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by 1, 2, 3),
pair as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce(dist.value, 0)::bigint as value
  from g a join g b on a.lang = b.lang and a.source <> b.source left join dist on dist.lang = a.lang and dist.source = a.source and dist.item = b.source
),
term as (select lang, source, 'term' as part, term as item, (p - q)::bigint as value from p where n > 0 and p > q),
ranked as (select *, (row_number() over (partition by lang, source, part order by value desc, item))::int as rank from (select * from pair union all select * from term))
select lang, source, part, item, value, rank from ranked where part = 'pair' or rank <= {RANKS}
"""
