"""Five lists of what may go unnoticed (C34) over the archive, some of whose columns are stated anew."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archivolt import archive
from archivolt.operators import discover as D
from archivolt.operators import values
from archivolt.queries.conditions import RANKED
from archivolt.registry import Registry

registry = Registry()
NOW = "2001-07-15 00:00:00"
OWN = ["dom5.example.com"]
_OVER = {
    "subject": "case when id % 29 = 0 then 'Your LICENCE: time to Renew' else subject end",
    "from_address": "case when id % 29 = 0 then concat('sales@firm', cast(id % 400 as varchar(10)), '.example.com') when id % 3 = 0 then concat('robot', cast(id % 11 as varchar(10)), '@bots.example.com') when received_at >= timestamp '2001-06-10' then concat('new', cast(id % 90 as varchar(10)), '@people.example.com') else from_address end",
    "is_automated": "id % 3 = 0",
}
_PEOPLE = "concat('new', cast(id % 90 as varchar(10)), '@people.example.com')"
_SQL = (
    f"{archive.ctes('message', 'assignment', 'participant').replace('message as (', 'stated as (', 1)},"
    f" message as (select * replace ({', '.join(f'{e} as {c}' for c, e in _OVER.items())}) from stated),"
    f" part as (select message_id, role, address from participant union all select id, 'to', {_PEOPLE} from message where direction = 'out' and id % 2 = 0)"
)
_QUIET_NOW = "2001-10-15"


def _rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = archive.messages(spark, sf_dir)
    made = rows.select(*[F.expr(_OVER[c]).alias(c) if c in _OVER else F.col(c) for c in rows.columns])
    more = made.where("direction = 'out' and id % 2 = 0").select(F.col("id").alias("message_id"), F.lit("to").alias("role"), F.expr(_PEOPLE).alias("address"))
    return made, archive.participants(spark, sf_dir).select("message_id", "role", "address").unionByName(more)


@registry.add(
    f"{_SQL}, q as (select thread_id, max([epoch_ms(received_at)::bigint, id]) as q from message where id % 4 = 1 and direction = 'in' and thread_id is not null and received_at > timestamp '2001-07-15' - interval 60 day group by 1),"
    " a as (select thread_id, max(epoch_ms(received_at))::bigint as answered from message where direction = 'out' and thread_id is not null group by 1)"
    " select q.thread_id, q.q[2] as id, ((epoch_ms(timestamp '2001-07-15') - q.q[1]) // 1000)::bigint as seconds from q left join a on a.thread_id = q.thread_id where answered is null or answered <= q.q[1]"
)
def c34_waiting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = _rows(spark, sf_dir)
    return D.waiting(rows, rows.where("id % 4 = 1").select("id"), now=NOW)


@registry.add(
    f"{_SQL}, r as (select split_part(from_address, '@', 2) as domain, month(received_at) as month, year(received_at) as year, subject, id from message where direction = 'in' and regexp_matches(subject, 'Renew') and received_at > timestamp '2001-07-15' - interval 6 year),"
    " b as (select domain, month, count(distinct year) as years, count(*) as n, max(year) as last_year, max_by(subject, [year, id]) as example from r where domain is not null and domain <> 'dom5.example.com' group by 1, 2),"
    " s as (select domain from b group by 1 having count(*) <= 6)"
    " select domain, month::int as month, years::bigint as years, n::bigint as n, last_year::int as last_year, example, ((month - 7 + 12) % 12)::int as until from b semi join s using (domain) where years >= 2 and (month - 7 + 12) % 12 <= 3"
)
def c34_renewals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.renewals(_rows(spark, sf_dir)[0], OWN, now=NOW)


@registry.add(
    f"{_SQL}, f as (select split_part(p.address, '@', 2) as domain, count(distinct thread_id)::bigint as threads, count(distinct p.address)::bigint as people, max(received_at) as last from message m join part p on p.message_id = m.id and p.role in ('to', 'cc') where m.direction = 'out' and received_at > timestamp '2001-07-15' - interval 365 day"
    " and split_part(p.address, '@', 2) <> 'dom5.example.com' and p.address like '%@%.%' group by 1 having count(distinct thread_id) >= 3)"
    " select * from f where domain not in (select concat('dom', s_suppkey, '.example.com') from supplier where s_suppkey % 3 = 0)"
)
def c34_without_binder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domains without a binder; every third supplier has one, whose text names its domain."""
    suppliers = spark.read.parquet(f"{sf_dir}/supplier.parquet").where("s_suppkey % 3 = 0")
    binders = suppliers.select(F.concat(F.lit("Contract with (Dom"), "s_suppkey", F.lit(".example.com), signed")).alias("text"))
    return D.without_binder(*_rows(spark, sf_dir), binders, OWN, now=NOW)


@registry.add(
    f"{_SQL}{RANKED}, r as (select from_address, max(received_at) as last, count(*) as n, min(account) as account from message where is_automated and direction = 'in' and from_address is not null and received_at > timestamp '{_QUIET_NOW}' - interval 545 day group by 1"
    f" having max(received_at) between timestamp '{_QUIET_NOW}' - interval 180 day and timestamp '{_QUIET_NOW}' - interval 10 day and count(*) >= 12),"
    " y as (select r.from_address, r.account, r.last, count(*) as a_year from r join message m on m.from_address = r.from_address and m.received_at between r.last - interval 365 day and r.last group by 1, 2, 3 having count(*) >= 12),"
    f" s as (select * from y where last < timestamp '{_QUIET_NOW}' - to_days(greatest(10, floor(4 * 365.0 / a_year + 0.5)::int))),"
    " nw as (select m.id, m.from_address from message m join s using (from_address) qualify row_number() over (partition by m.from_address order by m.received_at desc nulls last, m.id desc) <= 40),"
    " k as (select nw.from_address, count(*) filter (where e.value = 'Travel' or e.value = '1-URGENT') as mk, count(*) as n from nw join eff e on e.message_id = nw.id and e.dimension = 'topic' group by 1)"
    " select from_address as address, account, a_year::bigint as a_year, last from s where from_address not in (select from_address from k where mk >= 0.4 * n)"
)
def c34_quiet_senders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Robots that fell silent; two topics stand for offers and spam."""
    rows, _ = _rows(spark, sf_dir)
    topics = archive.assignments(spark, sf_dir).where("dimension = 'topic'")
    kinds = values.effective_message_values(rows.select("id", "thread_id"), topics).select("message_id", F.when(F.col("value") == "Travel", "offer").when(F.col("value") == "1-URGENT", "spam").otherwise(F.col("value")).alias("value"))
    return D.quiet_senders(rows, kinds, now=f"{_QUIET_NOW} 00:00:00")


@registry.add(
    f"{_SQL}, f as (select from_address as address, min(received_at) as first, count(*) as n, (list(from_name order by received_at desc nulls last, id desc))[1] as name from message where direction = 'in' and not is_automated and from_address is not null group by 1"
    " having min(received_at) > timestamp '2001-07-15' - interval 45 day and count(*) >= 2)"
    " select address, name, first, n::bigint as n from f where exists (select 1 from message m join part p on p.message_id = m.id where m.direction = 'out' and p.address = f.address)"
)
def c34_new_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.new_people(*_rows(spark, sf_dir), now=NOW)
