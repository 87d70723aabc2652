"""An archive of messages stated over the star-schema tables.

The driver's tables hold no mail, so messages, threads, participants, locations,
assignments and calendar entries are stated as expressions over orders, customers
and line items.  The expressions are portable SQL: Spark evaluates them here, and
the oracle statements use the same text as common table expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Thread ids and message ids share one id space and never meet.
THREADS = 10_000_000_000

#: name -> (source table, {column: expression})
VIEWS: dict[str, tuple[str, dict[str, str]]] = {
    "message": (
        "orders",
        {
            "id": "o_orderkey",
            "thread_id": f"case when o_orderkey % 11 <> 0 then {THREADS} + o_custkey end",
            "account": "concat('acc', cast(o_orderkey % 3 as varchar(10)))",
            "medium": "case when o_orderkey % 5 = 0 then 'teams_chat' else 'email' end",
            "direction": "case when o_orderstatus = 'F' then 'in' when o_orderstatus = 'O' then 'out' when o_orderkey % 7 = 0 then 'self' else 'in' end",
            "from_address": "case when o_orderkey % 97 = 0 then null when o_orderkey % 13 = 0 then concat('noreply@dom', cast(o_custkey % 23 as varchar(10)), '.example.com') "
            "else concat('user', cast(o_custkey % 211 as varchar(10)), '@dom', cast(o_custkey % 23 as varchar(10)), '.example.com') end",
            "from_name": "case when o_orderkey % 6 = 0 then null else concat('User ', cast(o_custkey % 211 as varchar(10))) end",
            "subject": "case o_orderkey % 8 when 0 then 'Re: SV: Invoice 2024-09 from Acme' when 1 then '[Success] Backup job 42' when 2 then 'dc4 Down!' "
            "when 3 then 'Weekly status report for team' when 4 then null when 5 then concat('Order ', cast(o_orderkey as varchar(20)), ' is late, can you reply?') "
            "when 6 then 'Fw: [Ticket 123456]Active errors: 0' else '' end",
            "received_at": "case when o_orderkey % 101 <> 0 then o_orderdate end",
            "size": "cast(floor(o_totalprice) as bigint)",
            "is_automated": "o_orderkey % 3 = 0",
            "has_attachments": "o_orderkey % 10 = 0",
            "list_id": "case when o_orderkey % 17 = 0 then concat('list', cast(o_orderkey % 5 as varchar(10))) end",
            "precedence": "case when o_orderkey % 19 = 0 then 'Bulk' end",
            "auto_submitted": "case when o_orderkey % 23 = 0 then 'auto-replied' when o_orderkey % 29 = 0 then 'No' end",
            "return_path": "case when o_orderkey % 31 = 0 then ' <> ' end",
            "list_unsubscribe": "case when o_orderkey % 37 = 0 then 'mailto:x' end",
        },
    ),
    "topic_own": (
        "orders",
        {
            "id": "o_orderkey * 10",
            "entity_id": "o_orderkey",
            "dimension": "'topic'",
            "value": "o_orderpriority",
            "source_kind": "case o_orderkey % 4 when 0 then 'import' when 1 then 'model' when 2 then 'rule' else 'human' end",
            "status": "case when o_orderkey % 9 = 0 then 'proposed' else 'active' end",
            "confidence": "(o_orderkey % 101) / 100.0E0",
            "created_at": "o_orderdate",
        },
    ),
    "topic_second": (
        "(select * from orders where o_orderkey % 5 = 0)",
        {
            "id": "o_orderkey * 10 + 1",
            "entity_id": "o_orderkey",
            "dimension": "'topic'",
            "value": "'Travel'",
            "source_kind": "case o_orderkey % 3 when 0 then 'human' when 1 then 'rule' else 'model' end",
            "status": "'active'",
            "confidence": "cast(0.9 as double)",
            "created_at": "o_orderdate",
        },
    ),
    "topic_thread": (
        "customer",
        {
            "id": f"{THREADS} + c_custkey",
            "entity_id": f"{THREADS} + c_custkey",
            "dimension": "'topic'",
            "value": "c_mktsegment",
            "source_kind": "case c_nationkey % 4 when 0 then 'human' when 1 then 'rule' when 2 then 'model' else 'import' end",
            "status": "'active'",
            "confidence": "cast(0.8 as double)",
            "created_at": "cast('1997-06-01 00:00:00' as timestamp)",
        },
    ),
    "kind_own": (
        "orders",
        {
            "id": f"{2 * THREADS} + o_orderkey",
            "entity_id": "o_orderkey",
            "dimension": "case when o_orderkey % 2 = 0 then 'sender_kind' else 'origin' end",
            "value": "case when o_orderkey % 2 = 0 then case when o_custkey % 3 = 0 then 'machine' else 'people' end when o_custkey % 4 = 0 then 'notification' else 'person' end",
            "source_kind": "case o_orderkey % 5 when 0 then 'human' when 1 then 'rule' else 'model' end",
            "status": "case when o_orderkey % 6 = 0 then 'rejected' else 'active' end",
            "confidence": "cast(0.7 as double)",
            "created_at": "o_orderdate",
        },
    ),
    "tag": (
        "lineitem",
        {
            "id": f"{3 * THREADS} + l_orderkey * 10 + l_linenumber",
            "entity_id": "l_orderkey",
            "dimension": "'tag'",
            "value": "l_returnflag",
            "source_kind": "case when l_linenumber = 1 then 'human' else 'rule' end",
            "status": "'active'",
            "confidence": "cast(1.0 as double)",
            "created_at": "l_shipdate",
        },
    ),
    "participant": (
        "lineitem",
        {
            "message_id": "l_orderkey",
            "role": "case l_linenumber % 3 when 0 then 'cc' when 1 then 'to' else 'bcc' end",
            "address": "case when l_suppkey % 20 = 0 then 'me@home.example.org' else concat('p', cast(l_suppkey as varchar(10)), '@dom', cast(l_suppkey % 23 as varchar(10)), '.example.com') end",
            "ordinal": "l_linenumber",
        },
    ),
    "location": (
        "lineitem",
        {
            "message_id": "l_orderkey",
            "folder": "case l_linestatus when 'O' then 'INBOX' else 'Archive' end",
            "folder_path": "case when l_linenumber % 2 = 0 then concat('Root/', l_returnflag) end",
            "label": "case when l_linenumber % 3 = 0 then concat('L', cast(l_suppkey % 7 as varchar(10))) end",
            "present": "l_quantity < 40",
        },
    ),
}
_ASSIGNMENTS = ("topic_own", "topic_second", "topic_thread", "kind_own", "tag")
#: The moment at which time-relative operators look at the archive.
NOW = "2001-08-02 00:00:00"
OWNER = "me@home.example.org"


def _view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source, columns = VIEWS[name]
    table = source if source.isidentifier() else "orders"
    rows = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    if not source.isidentifier():
        rows = rows.where(source.split(" where ")[1].rstrip(")"))
    return rows.selectExpr(*[f"{expr} as {column}" for column, expr in columns.items()])


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, "message")


def participants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, "participant")


def locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, "location")


def assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _view(spark, sf_dir, _ASSIGNMENTS[0])
    for name in _ASSIGNMENTS[1:]:
        found = found.unionByName(_view(spark, sf_dir, name))
    return found


def _select(name: str) -> str:
    source, columns = VIEWS[name]
    return f"select {', '.join(f'{expr} as {column}' for column, expr in columns.items())} from {source}"


def ctes(*names: str) -> str:
    """``with`` of the views an oracle statement reads, ending in a comma-free list."""
    made = {"assignment": " union all ".join(_select(n) for n in _ASSIGNMENTS)}
    return "with " + ", ".join(f"{n} as ({made.get(n) or _select(n)})" for n in names)
