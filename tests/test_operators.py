"""Operators on small invented rows."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from archivolt.functions import text as X
from archivolt.operators import corpus, graph, grouping, merge, model, placement, sampling, search, values
from archivolt.plans import conditions as C
from archivolt.sources import chat, mail
from archivolt.streaming import jobs

ASSIGN = "id long, entity_id long, dimension string, value string, source_kind string, status string, confidence double, created_at timestamp"


def test_effective_values_break_every_tie(spark):
    t = datetime(2024, 1, 1)
    messages = spark.createDataFrame([(1, 100), (2, 100), (3, None)], "id long, thread_id long")
    rows = [
        (10, 1, "topic", "import", "import", "active", None, t + timedelta(9)),
        (11, 1, "topic", "model", "model", "active", None, t + timedelta(8)),
        (12, 100, "topic", "rule-thread", "rule", "active", None, t + timedelta(7)),
        (13, 1, "topic", "rule-own", "rule", "active", None, t),
        (14, 1, "topic", "human", "human", "proposed", None, t),
        (15, 2, "topic", "old", "rule", "active", None, t),
        (16, 2, "topic", "new", "rule", "active", None, t + timedelta(1)),
        (17, 2, "topic", "newest id", "rule", "active", None, t + timedelta(1)),
        (18, 100, "tag", "a", "rule", "active", None, t),
        (19, 1, "tag", "a", "model", "active", None, t),
        (20, 1, "tag", "b", "model", "active", None, t),
        (21, 3, "topic", "x", "import", "rejected", None, t),
    ]
    got = values.effective_message_values(messages, spark.createDataFrame(rows, ASSIGN)).collect()
    assert {(r["message_id"], r["dimension"], r["value"], r["via"]) for r in got} == {
        (1, "topic", "rule-own", "message"),
        (2, "topic", "newest id", "message"),
        (1, "tag", "a", "thread"),
        (1, "tag", "b", "message"),
        (2, "tag", "a", "thread"),
    }


@pytest.mark.parametrize(
    ("subject", "want"),
    [
        ("SV: VB: Faktura 2026-09 från Telia", "faktura # från"),
        ("Re[2]: (Fwd) hello, world!", "fwd hello world"),
        ("RE: FW: 12 34 a5 done", "# done"),
        (None, ""),
        ("", ""),
        ("One two three four", "one two three"),
    ],
)
def test_skeletons(spark, subject, want):
    assert spark.createDataFrame([(subject,)], "s string").select(X.skeleton(F.col("s"))).first()[0] == want


@pytest.mark.parametrize(
    ("subject", "want"),
    [("[backup7]Active x", "[backup7]Active"), ("Re: [#123456] Ticket", "[##] Ticket".split()[0]), ("dc4 Down!", "… Down!"), ("SRV12 report", "SRV## report".split()[0]), ("down", "down"), (None, "(no subject)")],
)
def test_system_keys(spark, subject, want):
    assert spark.createDataFrame([(subject,)], "s string").select(X.system_key(F.col("s"))).first()[0] == want


@pytest.mark.parametrize(
    ("subject", "body", "want"),
    [
        ("[Success] Job", "failed", "ok"),
        ("[Warning] Job", "", "warning"),
        ("State changed to Reset/resolved (was: Error)", "", "ok"),
        ("Report", "Failed: 0, warnings: 0, completed", "ok"),
        ("Report", "2 errors", "failed"),
        ("Backup aborted", "ok", "failed"),
        (None, None, "info"),
    ],
)
def test_event_status(spark, subject, body, want):
    assert spark.createDataFrame([(subject, body)], "s string, b string").select(X.event_status(F.col("s"), F.col("b"))).first()[0] == want


def test_conditions_refuse_what_they_cannot_read():
    for bad in ([{"field": "nothing", "op": "is", "value": 1}], [{"field": "subject", "op": "almost"}], [{"any": []}], [{"field": "subject", "op": "matches", "value": "("}]):
        with pytest.raises(C.ConditionError):
            C.rule_column(bad)
    with pytest.raises(C.ConditionError):
        C.placement_column({"use": "a"}, C.Vocabulary(named={"a": {"use": "a"}}))
    assert C.in_words({"all": [{"field": "x", "in": ["a", "b"]}, {"use": "m"}]}) == "(x in a, b and as in m)"


def test_empty_rule_list_matches_nothing(spark):
    assert spark.range(3).where(C.rule_column([], {})).count() == 0


def test_rules_never_beat_people(spark):
    current = spark.createDataFrame([(1, "topic", "mine", "human", None), (2, "topic", "old", "rule", "rule:9@1")], "message_id long, dimension string, value string, source_kind string, source_ref string")
    made = spark.createDataFrame([(1, "topic", "r", "rule:1@1"), (2, "topic", "r", "rule:1@1")], "message_id long, dimension string, value string, source_ref string")
    got = values.merge_rule_values(current, made).collect()
    assert {(r["message_id"], r["value"]) for r in got} == {(1, "mine"), (2, "r")}


def test_session_gap_is_more_than_the_limit(spark):
    t = datetime(2024, 1, 1)
    rows = [(1, i, t + timedelta(hours=h)) for i, h in enumerate((0, 2, 4.5))] + [(2, i, t + timedelta(minutes=i)) for i in range(31)]
    got = grouping.sessions(spark.createDataFrame(rows, "k long, id long, at timestamp"), ["k"], "at", ["id"]).collect()
    assert [r["session"] for r in sorted(got, key=lambda r: (r["k"], r["id"])) if r["k"] == 1] == [1, 1, 2]
    assert [r["part"] for r in sorted(got, key=lambda r: (r["k"], r["id"])) if r["k"] == 2] == [0] * 30 + [1]


def test_routing(spark):
    rows = [({"a": 0.7, "b": 0.55},), ({"a": 0.7, "b": 0.2},), ({"a": 0.5, "b": 0.5},), ({},)]
    frame = spark.createDataFrame(rows, "s map<string,double>")
    got = [r[0] for r in frame.select(model.route_one(F.col("s"))).collect()]
    assert [(g["top"], g["decided"]) for g in got] == [("a", True), ("a", True), ("a", False), (None, False)]
    assert frame.limit(1).select(model.route_many(F.col("s"))).first()[0]["selected"] == ["a", "b"]


def test_upsert_and_three_way(spark):
    old = spark.createDataFrame([(1, "a", None), (2, "b", 1), (3, "c", 2)], "id long, x string, y long")
    new = spark.createDataFrame([(1, "a", None), (2, "b", 5), (4, "d", 1)], "id long, x string, y long")
    assert {(r["id"], r["change"]) for r in merge.upsert(old, new, ["id"]).collect()} == {(1, "unchanged"), (2, "changed"), (3, "kept"), (4, "added")}
    print_ = F.sha2(F.to_json(F.struct("title")), 256)
    held = spark.createDataFrame([("u1", "t", "h1"), ("u2", "t", "h2"), ("u3", "t", "h3")], "uid string, title string, file_hash string").withColumn("fingerprint", print_)
    held = held.withColumn("title", F.when(F.col("uid") == "u2", "edited").otherwise(F.col("title")))
    files = spark.createDataFrame([("u1", "h1"), ("u2", "new"), ("u3", "new"), ("u4", "h4")], "uid string, file_hash string")
    assert {tuple(r) for r in merge.three_way(held, files, "uid", ["title"]).collect()} == {("u1", "unchanged"), ("u2", "kept_edit"), ("u3", "updated"), ("u4", "created")}
    drafts = spark.createDataFrame([("k1", "t1", "yes"), ("k2", "t2", None)], "k string, t string, decision string")
    fresh = spark.createDataFrame([("k1", "t1b", "no"), ("k3", "t3", "yes")], "k string, t string, decision string")
    assert {tuple(r) for r in merge.keep_decisions(drafts, fresh, ["k"]).collect()} == {("k1", "t1b", "yes", False), ("k2", "t2", None, True), ("k3", "t3", "yes", False)}


def test_graph_with_a_cycle(spark):
    edges = spark.createDataFrame([(2, 1), (3, 2), (1, 3), (4, 3)], "child long, parent long")
    root = spark.createDataFrame([(1,)], "id long")
    assert {r["id"] for r in graph.descendants(edges, root).collect()} == {1, 2, 3, 4}
    assert {tuple(r["path"]) for r in graph.tree(edges, root, excluded=[4]).collect()} == {(1,), (1, 2), (1, 2, 3)}
    assert graph.would_cycle(edges, 1, 4) and not graph.would_cycle(edges, 4, 1)
    links = spark.createDataFrame([(5, 6), (7, 6), (8, 9), (None, 1)], "a long, b long")
    assert {tuple(r) for r in graph.connected(links).collect()} == {(5, 5), (6, 5), (7, 5), (8, 8), (9, 8)}


def test_shares_and_filters(spark):
    assert sampling.split_by_share({"a": 1, "b": 1, "c": 1}, 10) == {"a": 4, "b": 3, "c": 3}
    assert search.filters_from("dim=topic:Travel&dim=bad&accounts=a,b&has_attachments=1&limit=5") == {"values": [("topic", "Travel")], "accounts": ["a", "b"], "has_attachments": True, "limit": 5}
    assert X.prefixes("planning mail") == ["planni", "mail"] and X.prefixes('"exact" phrase') == []


def test_placement_tells_why(spark):
    rows = spark.createDataFrame([(1, "x", True), (2, None, False)], "id long, a string, b boolean")
    targets = [("set", {"field": "a", "set": True}), ("false", {"field": "b", "is": False})]
    assert [r["reasons"] for r in placement.why(rows, targets).orderBy("id").collect()] == [["set"], ["false"]]


def test_near_copies(spark):
    words = " ".join(f"w{i}" for i in range(200))
    rows = [(1, words), (2, words + " tail"), (3, words.upper()), (4, " ".join(f"x{i}" for i in range(200))), (5, None), (6, "")]
    got = {r["id"]: r["dup_of"] for r in corpus.near_copies(spark.createDataFrame(rows, "id long, text string")).collect()}
    assert got == {2: 1, 3: 1, 6: 5}


def test_near_copies_against_brute_force(spark):
    """Passages that many texts share, and near copies of which each has an earlier text of its own passage."""
    draw = random.Random(4)
    word = lambda: f"w{draw.randrange(5000)}"
    passages = [" ".join(word() for _ in range(60)) for _ in range(6)]
    texts = []
    for i in range(90):
        body = " ".join(word() for _ in range(draw.choice((20, 60, 200))))
        texts.append(f"{passages[i % 6]} {body}" if i % 3 else body)
    for i in range(90):
        words = draw.choice(texts).split(" ")
        for _ in range(draw.randrange(5)):
            words[draw.randrange(len(words))] = word()
        texts.append(" ".join([*words, *passages[i % 6].split(" ")[: draw.choice((0, 0, 20))]]))
    texts += [f"{p} {passages[k]}" for k, p in enumerate(passages[1:])]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (t.split(" ") for t in texts)]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    got = {r["id"]: r["dup_of"] for r in corpus.near_copies(spark.createDataFrame(list(enumerate(texts)), "id long, text string")).collect()}
    assert got == {i: r for i, r in enumerate(root) if r != i} and len(got) > 30


MAIL = b"From: Anna <a@x.example>\r\nTo: Me <me@home.example>, b@y.example\r\nSubject: =?utf-8?q?H=C3=A4lsning?=\r\nDate: Mon, 01 Jan 2024 10:00:00 +0200\r\nMessage-ID: <1@x>\r\nReferences: <0@x>\r\n\r\nHello\r\n"


def test_mail_files(spark, tmp_path):
    (tmp_path / "a.eml").write_bytes(MAIL)
    (tmp_path / "copy.eml").write_bytes(MAIL)
    (tmp_path / "b.emlx").write_bytes(f"{len(MAIL)}\n".encode() + MAIL.replace(b"Hello", b"Hallo") + b"<plist/>")
    (tmp_path / "c.eml").write_bytes(b"\xff\xfe no headers")
    rows = mail.parsed(mail.scan(spark, str(tmp_path)))
    good, bad = mail.split_quarantine(mail.direction(rows, ["a@x.example"]))
    got = {r["body"].strip(): r for r in good.where("from_address is not null").collect()}
    assert got.keys() == {"Hello", "Hallo"} and bad.count() == 0
    one = got["Hello"]
    assert (one["subject"], one["direction"], one["refs"], len(one["recipients"])) == ("Hälsning", "out", ["<0@x>"], 2)
    assert one["sent_at"].isoformat()[:16] == "2024-01-01T08:00"


def test_chat_edits_and_deletions(spark, tmp_path):
    (tmp_path / "m.json").write_text(
        '{"id":"1","messageType":"message","createdDateTime":"2024-01-01T00:00:00Z","from":{"user":{"id":"u","displayName":"U"}},"body":{"contentType":"html","content":"<p>first</p>"}}\n'
        '{"id":"1","messageType":"message","createdDateTime":"2024-01-01T00:00:00Z","deletedDateTime":"2024-01-02T00:00:00Z","from":{"user":{"id":"u","displayName":"U"}},"body":{"contentType":"html","content":""}}\n'
        '{"id":"2","messageType":"systemEventMessage","createdDateTime":"2024-01-01T00:00:00Z"}\n'
    )
    got = chat.latest(chat.messages(chat.read(spark, str(tmp_path)))).collect()
    assert [(r["key"], r["text"], r["deleted"]) for r in got] == [("1", "first", True)]


def test_streams_equal_batches(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ok", F.col("value") >= 10).withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = jobs.event_stream(spark, str(tmp_path / "in"), events.schema)
    query = jobs.daily_rollup(stream).writeStream.format("memory").queryName("rollup").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    batch = events.groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count_if("ok").alias("ok"), F.count_if(~F.col("ok")).alias("failed"))
    assert {tuple(r) for r in spark.table("rollup").collect()} == {tuple(r) for r in batch.collect()}


MASKED = [
    ("see https://portal.example.se/a/b?t=1 and www.example.com/x", "see https://portal.example.se/… and www.example.com/…"),
    ("https://portal.example.se/ and http://a.example?q=1", "https://portal.example.se/ and http://a.example/…"),
    ("pay SE45 5000 0000 0583 9825 7466 now", "pay [iban] now"),
    ("pay SE46 5000 0000 0583 9825 7466 now", "pay SE46 5000 0000 0583 9825 7466 now"),
    ("card 4111 1111-1111 1111.", "card [card]."),
    ("card 4111 1111-1111 1112.", "card 4111 1111-1111 1112."),
    ("born 19811218-9876 or 811278+9876, not 811318-9876", "born [personnummer] or [personnummer], not 811318-9876"),
    ("id 8112189876, order 8112189875", "id [personnummer], order 8112189875"),
    ("call +46 70 123 45 67, 0046701234567, 070-123 45 67 or 08-123 456 78", "call [phone], [phone], [phone] or [phone]"),
    ("on 2024-09-30 12.30, part 12-070-123 45", "on 2024-09-30 12.30, part 12-070-123 45"),
    ("", ""),
    (None, ""),
]


def test_masking(spark):
    frame = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(MASKED)], "id int, t string")
    got = {r["id"]: r["m"] for r in frame.select("id", X.masked(F.col("t")).alias("m")).collect()}
    assert [got[i] for i in range(len(MASKED))] == [m for _, m in MASKED]


def test_masking_of_long_texts(spark):
    long = ["1 " * 200_000, "AB12" * 100_000, "+46 70 123 45 67, " * 20_000, "www.a.se/x " * 20_000]
    got = [r["m"] for r in spark.createDataFrame(list(enumerate(long)), "id int, t string").select("id", X.masked(F.col("t")).alias("m")).orderBy("id").collect()]
    assert got[1] == long[1] and got[2] == "[phone], " * 20_000 and got[3] == "www.a.se/… " * 20_000


def test_normalised_texts_fold_look_alikes_and_compatibility_forms(spark):
    rows = ["Ｐａｙ​pal  ﬁne", "Раураl", "ΝΟΤΕ", "é", None]
    got = [r["n"] for r in spark.createDataFrame(list(enumerate(rows)), "id int, t string").select("id", X.normalized(F.col("t")).alias("n")).orderBy("id").collect()]
    assert got == ["paypal fine", "paypal", "note", "é", ""]


def test_too_deep_a_graph_is_an_error(spark):
    from archivolt.operators import graph

    edges = spark.createDataFrame([(i, i + 1) for i in range(5)], "parent long, child long")
    root = spark.createDataFrame([(0, 0)], "id long, root long")
    assert graph.descendants(edges, root, most_depth=5).count() == 6
    for run in (graph.descendants, graph.reachable, graph.tree):
        with pytest.raises(RecursionError):
            run(edges, root, most_depth=4)


def test_rule_candidates_against_a_plain_greedy_cover(spark):
    import hashlib

    rnd = random.Random(12)
    phrases = ["drop all the tables", "ignore every former rule", "send me your keys now"]
    rows = []
    for i in range(240):
        words = [rnd.choice("one two three four five six".split()) for _ in range(8)]
        target = i % 3 == 0
        if target:
            words[3:3] = rnd.choice(phrases + phrases[:1]).split()
        rows.append((i, f"s{i % 4}", target, " ".join(words)))
    held = {i for i, *_ in rows if int(hashlib.sha256(str(i).encode()).hexdigest()[:8], 16) < int(0.3 * 2**32)}
    grams = {i: {" ".join(t.split()[k : k + 3]) for k in range(len(t.split()) - 2)} for i, _, _, t in rows}
    plain = {g for i, _, target, _ in rows if not target and i not in held for g in grams[i]}
    train = [(i, s) for i, s, target, _ in rows if target and i not in held]
    covers = {}
    for i, s in train:
        for g in grams[i] - plain:
            covers.setdefault(g, set()).add((i, s))

    def spread(c):
        by = [sum(s == source for _, s in c) for source in {s for _, s in c}]
        return len(by) >= 2 and max(by) <= 0.8 * len(c)

    pool, want, done = {g for g, c in covers.items() if len(c) >= 3 and spread(c)}, [], set()
    while pool and len(want) < 5:
        best = min(pool, key=lambda g: (-len(covers[g] - done), len(g), g))
        gain = len(covers[best] - done)
        if gain < 3:
            break
        hits = [target for i, _, target, _ in rows if i in held and best in grams[i]]
        want.append((len(want) + 1, best, len(covers[best]), gain, sum(hits), len(hits) - sum(hits)))
        done |= covers[best]
        pool.discard(best)
    got = corpus.rule_candidates(spark.createDataFrame(rows, "id long, source string, target boolean, text string"), least=3, most=5)
    assert [tuple(r) for r in got.orderBy("place").collect()] == want and len(want) >= 3


def test_subjects_that_repeat_a_prefix_without_end(spark):
    long = ["Re: " * 50_000 + "Invoice 7", "SV:" * 50_000, "- " * 50_000 + "x", "!" * 200_000]
    rows = spark.createDataFrame(list(enumerate(long)), "id int, s string")
    got = rows.select("id", X.skeleton(F.col("s")).alias("k"), X.system_key(F.col("s")).alias("y"), *[F.rlike("s", F.lit(X.skeleton_regex(k))).alias(f"m{i}") for i, k in enumerate(("invoice #", "", "x"))]).orderBy("id").collect()
    assert [r["k"] for r in got] == ["invoice #", "", "x", ""]
    assert [(r["m0"], r["m1"], r["m2"]) for r in got] == [(True, False, False), (False, True, False), (False, False, True), (False, True, False)]
