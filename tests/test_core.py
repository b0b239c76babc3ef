"""Core operators on small frames: nulls, empty tables, ties, repeated rows, clashing extra columns."""

from __future__ import annotations

from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from kelpmill.functions import redact
from kelpmill.functions import text as X
from kelpmill.functions.phone import canonical_number
from kelpmill.operators import actions as P
from kelpmill.operators import analytics as A
from kelpmill.operators import chunking as C
from kelpmill.operators import evaluate as E
from kelpmill.operators import graph as G
from kelpmill.operators import repeats as R
from kelpmill.operators import retrieval as V
from kelpmill.operators import state as S


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x"))).first()[0]


@pytest.mark.parametrize(
    ("a", "b"),
    [
        ("010-0001-0003", "+82 10-0001-0003"), ("01000010003", "0082 10 0001 0003"), ("+82 (0)10-0001-0609", "010.0001.0609"), ("０１０-０００１-０６０９", "010–0001–0609"),
        ("07700 900123", "+447700900123"), ("0044 7700 900160", "+44 7700 900160"), ("(201) 555-0105", "+1 201-555-0105"), ("+12015550105", "201.555.0105"), ("1-201-555-0105", "2015550105"),
    ],
)
def test_notations_of_a_number(spark, a, b):
    assert one(spark, canonical_number, a) == one(spark, canonical_number, b)


def test_other_senders_stay(spark):
    for s in ("RUDRAVELINFO", "rudravelinfo", "Bank 24", "", "+"):
        assert one(spark, canonical_number, s) == s
    assert one(spark, canonical_number, None) is None
    assert one(spark, canonical_number, "+49 30 23125-1") == "+4930231251"


ROWS = [(1, 10, 1, "010-1", 5), (2, 10, 1, "010-1", 6), (3, 10, 1, "0101", 7), (4, 10, 2, "010-1", 8), (5, None, 1, "010-1", 9), (6, None, 1, "010-1", 9), (7, 86_400_010, 1, "x", 0), (7, 86_400_010, 1, "x", 0), (8, 86_400_010, 1, "x", 0)]


def repeats_of(spark, rows):
    df = spark.createDataFrame(rows, "record_id long, date_ms long, msg_type int, address string, h long")
    return sorted(r[0] for r in R.repeats(R.sms_identity(df), ["date_ms", "msg_type", "number"], "bucket", "record_id").select("record_id").collect())


def test_repeats(spark):
    assert repeats_of(spark, ROWS) == [2, 3, 8]  # nulls are never repeats; equal order numbers are not repeats of each other
    assert repeats_of(spark, []) == []


def test_repeats_with_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a", "x", datetime(2025, 1, 1), 1), (2, "a", "x", datetime(2025, 6, 1), 2), (3, None, "x", None, 3), (4, "a", "y", None, 3), (5, "a", "y", datetime(2025, 6, 1), 3)], "record_id long, source_type string, source_id string, collected_at timestamp, h long").withColumn("cell", F.lit(1)).withColumn("shard", F.lit(1))
    got = R.repeats(R.document_identity(df), ["source_type", "source_id"], "bucket", "record_id", joined=True)  # copies in different buckets
    assert sorted(r.record_id for r in got.collect()) == [2, 5]


def test_hot_message_and_many_cells(spark):
    hot = spark.range(60_000).select(F.col("id").alias("record_id"), F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("date_ms"), F.lit(1).alias("msg_type"), F.lit("010-0001-0003").alias("address"))
    assert R.repeats(R.sms_identity(hot), ["date_ms", "msg_type", "number"], "bucket", "record_id").count() == 20_000  # 7 itself has id 7
    kept = R.keep_one(R.sms_identity(hot), ["date_ms", "msg_type", "number"], "bucket", "record_id")
    assert kept.count() == 40_000


def test_many_days_and_a_crowded_one(spark, monkeypatch):
    monkeypatch.setattr(R, "ROWS_PER_CELL", 500)
    rows = spark.range(4000).select(F.col("id").alias("record_id"), F.when(F.col("id") < 2000, F.col("id") % 1500).otherwise((F.col("id") % 1900) * 86_400_000 + 5).alias("date_ms"), F.lit(1).alias("msg_type"), F.lit("x").alias("address"))
    want = rows.count() - rows.select("date_ms").distinct().count()
    assert R.repeats(R.sms_identity(rows), ["date_ms", "msg_type", "number"], "bucket", "record_id").count() == want


def test_saturating_filter_has_no_misses():
    import numpy as np

    h = np.arange(1, 5001, dtype=np.int64) * 7919
    seen, again = np.zeros(R.SLOTS, bool), np.zeros(R.SLOTS, bool)
    for part in (h, h[:50]):
        once, more = R._marked(part)
        again[once[seen[once]]] = True
        again[more] = True
        seen[once] = seen[more] = True
    assert again[R._slots(h[:50])].all()
    assert again[R._slots(h[50:])].all(axis=1).mean() < 0.01


def test_query_rules():
    q = V.SearchQuery("Fish & chips, fish", source_type="a", source_types=("b", "a"), exclude=("c",))
    assert q.includes() == ["a", "b"]
    assert q.excludes() == ["c", "insight"]
    assert q.words() == ["fish", "chips"]
    assert V.SearchQuery("x", source_type="insight").excludes() == []
    assert V.clamp(None, 20, 50) == 20 and V.clamp(70, 20, 50) == 50
    w = V.SearchWeights(k=float("nan"), fts=0, vec=-1).resolved(0.9, True)
    assert (w.k, w.fts, w.vec, w.summvec, w.entity) == (60.0, 1.0, 0.0, 0.8, 0.5)
    now = datetime(2025, 7, 1)
    assert V.recency_ascending(now, now) and not V.recency_ascending(None, now)


def test_merge_never_displaces(spark):
    p = spark.createDataFrame([(f"p{i}", i) for i in range(1, 4)], "id string, rank int")
    s = spark.createDataFrame([("p1", 1), ("s1", 2), ("s2", 3)], "id string, rank int")
    assert {r.id for r in V.merged(p, s, 3).collect()} == {"p1", "p2", "p3"}
    assert {r.id for r in V.merged(p, s, 4).collect()} == {"p1", "p2", "p3", "s1"}


def test_lanes_of_nothing(spark):
    empty = spark.createDataFrame([], "id string, title string, content string, status string, source_type string, embedding array<float>, occurred_at timestamp, collected_at timestamp, score double")
    q = V.SearchQuery("a b", [1.0, 0.0])
    assert V.hybrid_search(empty, q, datetime(2025, 7, 1)).count() == 0


def test_split_vectors_and_hashes(spark):
    assert one(spark, X.query_hash, "  Hello ") == one(spark, X.query_hash, "hello")
    assert one(spark, X.split_of, "abc") in ("train", "holdout")
    assert one(spark, X.stripped_tags, "a<b>c</b> > d <i") == "ac  d "
    assert one(spark, lambda c: F.decode(X.base64url(c), "utf-8"), "aGk_") == "hi?"
    assert one(spark, lambda c: X.json_has(c, "k"), '{"k": null}') is True
    assert one(spark, lambda c: X.json_has(c, "k"), None) is False
    assert one(spark, X.codes_hidden, "인증번호 1234번") == "인증번호 [REDACTED]번"


def test_splits_that_must_stay(spark):
    want = {"a": "holdout", "b": "train", "c": "train", "hello world": "holdout", "zzz": "train"}
    assert {k: one(spark, X.split_of, k) for k in want} == want


def test_redaction():
    assert redact.redact("rrn 900101-1234567 x") == f"rrn {redact.MARK} x"
    for t in ("202607-1234567", "900101-9234567", "902001-1234567"):
        assert redact.redact(t) == t, t
    for t in ("010-1234-5678", "01012345678", "+82 (0)10-1234-5678", "+82-10-1234-5678", "0082 10 1234 5678", "82-10-1234-5678", "02 123 4567", "031-123-4567", "110-123-456789"):
        assert redact.redact(t) == redact.MARK, t
    for t in ("meeting 2025-06-05 at 10", "order 123456 shipped", "82점", "2026-01-02 03:04:05", "", "비밀번호 1234"):
        assert redact.redact(t) == t, t
    assert redact.redact("code 123456 for your otp") == f"code {redact.MARK} for your otp"
    assert redact.redact("본인 확인 코드 123456") == f"본인 확인 코드 {redact.MARK}"
    assert redact.redact("otp" + " " * 38 + "123456") == "otp" + " " * 38 + "123456"  # the keyword must lie within reach as a whole
    assert redact.redact("otp" + " " * 37 + "123456") == "otp" + " " * 37 + redact.MARK
    assert redact.redact("인증번호 1234, 7777") == f"인증번호 {redact.MARK}, {redact.MARK}"
    assert redact.redact(None) is None


def test_text_rules(spark):
    assert one(spark, lambda c: X.action_summary(c, F.lit("my_commitment")), "  Call,   BOB! (now) a-b ") == "call bob now a-b"
    assert one(spark, lambda c: X.action_summary(c, F.lit("my_commitment")), "가" * 40) == "가" * 26  # 80 bytes, no broken character
    assert one(spark, lambda c: X.action_summary(c, F.lit("awaiting_my_reply")), "x") == ""
    for body, auth in (("타인에게 알리지", True), ("본인  확인", True), ("call 1234", True), ("call 123", False), ("ab1234", False), (None, False), ("Verification", True)):
        assert one(spark, X.auth_like, body) is auth, body
    assert one(spark, X.normalized_url, " HTTPS://Www.X.com/a// ") == "www.x.com/a/"
    assert one(spark, lambda c: X.clamped(c, 5), "ab  cdef") == "ab…" and one(spark, lambda c: X.shortened(c, 3), "abcd") == "abc…"
    assert [one(spark, X.human_size, n, "long") for n in (1023, 1024, 1536, 5 << 20, 3 << 30)] == ["1023 B", "1 KB", "2 KB", "5.0 MB", "3.0 GB"]
    assert one(spark, X.safe_file_name, "__a b/ü..c-") == "a_b_c-" and one(spark, X.safe_number, " (") == "unknown"
    assert [one(spark, X.dead_letter, n, "int") for n in (9, 10)] == [False, True]
    assert one(spark, lambda c: X.fetch_allowed(c, F.lit("Slack")), "https://FILES.slack.com/x") is True and one(spark, lambda c: X.fetch_allowed(c, F.lit("slack")), "https://files.slack.com.evil/x") is False
    assert one(spark, X.snowflake, None, "timestamp") == "" and one(spark, lambda c: X.snowflake(F.timestamp_millis(c)), 1420070400001, "long") == str(1 << 22)
    assert one(spark, X.korean_time, datetime(2025, 6, 1, 15, 30), "timestamp") == "2025-06-02(월) 00:30"
    assert one(spark, lambda c: S.merged_json(c, F.lit('{"a":2,"c":null}')), '{"a":[1],"b":{"x":1.5}}') == '{"a":2,"b":{"x":1.5},"c":null}'


def test_threads_and_counterparts(spark):
    rows = [
        (1, "sms", '{"contact_name":"Bo","direction":"received"}', 1), (2, "sms", '{"contact_name":"Bo","direction":"received"}', 5), (3, "sms", '{"contact_name":"Bo"}', None),
        (4, "call-log", '{"number":"010","direction":"missed"}', 2), (5, "call-transcript", '{"number":"010","direction":"incoming"}', 3), (6, "gmail", '{"thread_id":"t","from":"Me <me@x.test>"}', 3),
        (7, "gmail", '{"from":"a@x.test"}', 3), (8, "sms", '{"contact_name":"Al","is_auth_like":true}', 3), (9, "gmail", None, 4), (10, "note", "{}", 4),
    ]
    docs = spark.createDataFrame([(i, s, m, "active", None if t is None else datetime(2025, 6, t), "a title") for i, s, m, t in rows], "record_id long, source_type string, metadata string, status string, occurred_at timestamp, title string").withColumn("collected_at", F.lit(datetime(2025, 7, 1)))
    newest = P.latest_per_thread(docs, F.lit(datetime(2025, 1, 1)))
    assert {r.record_id for r in newest.collect()} == {2, 5, 6, 9}  # mail without a thread is one group, its newest stays
    got = {r.record_id: r.outcome for r in P.outcomes(newest, ["ME <me@x.test>"]).collect()}
    assert got == {2: "written", 5: "written", 6: "skipped_no_counterpart", 9: "skipped_no_counterpart"}
    keys = {r.record_id: r.k for r in docs.select("record_id", P.thread_key().alias("k")).collect()}
    assert keys[4] == keys[5] and keys[4].startswith("call:") and "010" not in keys[4] and keys[7] is None and keys[10] is None
    names = spark.createDataFrame([('"Doe, Jane" <j@x.test>',), ("j@x.test",), ("<j@x.test>",), ("=?utf-8?b?7KCV?= <a@x.test>",), ("",)], "h string").select(P.sender_name(F.col("h")))
    assert [r[0] for r in names.collect()] == ["Doe, Jane", "j@x.test", "j@x.test", "정", ""]
    card = docs.filter("record_id = 9").select(P.awaiting_summary(F.lit(" Jane\n Doe "), F.lit("s" * 200), F.col("occurred_at"), F.lit(datetime(2025, 6, 4, 18)))).first()[0]
    assert len(card) == 80 and card.startswith('Jane Doe · 메일 "sss') and card.endswith('…" · 어제부터 미응답')
    assert P.action_counts(spark.createDataFrame([], "kind string, document_id string, identity string")).count() == 0
    assert P.action_counts(spark.createDataFrame([("scheduled", "d", "b"), ("x", "d", "a"), (None, "", None)], "kind string, document_id string, identity string")).first().text == "예정 1건, 기타 2건."


def test_chunker():
    text = "intro\n\n# One\n\n" + "Sentence here. " * 400 + "\n\nTwo\n---\nshort"
    chunks = C.split(text, C.Options(500, 800, 50, True))
    assert all(len(c) <= 800 + 50 + 10 for c in chunks)
    assert chunks[0] == "intro" and chunks[1].startswith("# One\n\nSentence") and chunks[-1] == "## Two\n\nshort"
    assert C.split("", C.Options()) == [] and C.split(None, C.Options()) == [] and C.split(" \n\t", C.Options()) == []
    assert C.split("a\n\n\n\nb ", C.Options()) == ["a\n\n\n\nb"]  # a short text stays as it is
    assert "".join(C.split("x" * 9000, C.Options(2000, 4000, 0))) == "x" * 9000
    assert C.split("# Only a heading", C.Options(headings=True)) == []
    assert C.split("1.1 Foo\nbar\nA. Baz\nqux\n<H3>T</h3>\nz\n####### no\n\\# no", C.Options(headings=True)) == ["## Foo\n\nbar", "# Baz\n\nqux", "### T\n\nz\n####### no\n\\# no"]
    assert C.Options(100, 0, 100).clamped() == C.Options(100, 4000, 50) and C.Options(-1, 10, -3).clamped() == C.Options(2000, 10, 0)
    assert C.flat("aaaa bbbb\n\ncccc", C.Options(9, 50, 4)) == ["aaaa bbbb", "bbbb cccc"]
    assert C.for_source("github", "no structure").headings is False and C.for_source("mail", "x").headings is True
    assert C.split_message("a" * 10 + " " + "b" * 5, 12) == ["a" * 10, "b" * 5] and C.split_message("", 5) == [""]
    assert C.split_message("가" * 5 + "\n\n" + "나 다", 8) == ["가" * 5, "나 다"]


def test_sentence_cuts_against_a_plain_version():
    import random

    def plain(text, most):
        out, held = [], ""
        for k, c in enumerate(text):
            held += c
            if len(held) >= most or c in ".!?" and text[k + 1 : k + 2] in (" ", "\n") and text[k + 1 :] and len(held) >= most // 4:
                out.append(held.strip())
                held = ""
        return [x for x in [*out, held.strip()] if x]

    pick = random.Random(1)
    for _ in range(500):
        text, most = "".join(pick.choice("ab. !\n") for _ in range(pick.randint(1, 80))), pick.randint(1, 30)
        assert C.sentences(text, most) == plain(text, most)


def test_votes_and_merges(spark):
    v = spark.createDataFrame([("q", "d", 1, 1), ("q", "d", 2, 1), ("q", "d", 3, -1), ("q", "e", 1, 1)], "query string, document_id string, event_id int, thumbs int")
    got = {(r.document_id, r.thumbs) for r in S.toggled_votes(v, ["query", "document_id"], "event_id").collect()}
    assert got == {("d", -1), ("e", 1)}
    old = spark.createDataFrame([("a", "x", None), ("b", "y", "t")], "k string, title string, at string")
    new = spark.createDataFrame([("b", None, None), ("c", "z", "u")], "k string, title string, at string")
    got = {tuple(r) for r in S.upsert(old, new, ["k"], keep=("at",)).collect()}
    assert got == {("a", "x", None), ("b", None, "t"), ("c", "z", "u")}


def test_votes_against_a_plain_fold(spark):
    import random

    pick = random.Random(3)
    rows = [(f"q{pick.randint(0, 9)}", k, pick.choice((-1, 0, 1))) for k in range(300)]
    want: dict = {}
    for q, _, v in rows:
        want[q] = 0 if want.get(q, 0) == v else v
    got = S.toggled_votes(spark.createDataFrame(rows, "query string, event_id int, thumbs int"), ["query"], "event_id")
    assert {r.query: r.thumbs for r in got.collect()} == want


def test_rekeyed_messages(spark):
    rows = [("a", "sms:1:h:0123abcd", 1), ("b", "sms:1:h:0123abce", 2), ("c", "sms:1:h:sent", 3), ("d", "sms:2:h:0123abcd", 1)]
    docs = spark.createDataFrame([(i, "sms", s, "active", '{"direction":"sent"}', u) for i, s, u in rows], "id string, source_type string, source_id string, status string, metadata string, updated_at int")
    assert {(r.id, r.source_id, r.status) for r in S.rekeyed(docs).collect()} == {("a", "sms:1:h:0123abcd", "deleted"), ("b", "sms:1:h:sent", "active"), ("c", "sms:1:h:sent", "active"), ("d", "sms:2:h:sent", "active")}
    with pytest.raises(ValueError):
        S.rekeyed(docs, most_conflicts=0)


def test_mark_deleted_guards(spark):
    docs = spark.createDataFrame([("s", str(i), "active", None) for i in range(4)], "source_type string, source_id string, status string, deleted_at timestamp")
    live = lambda n: spark.createDataFrame([(str(i),) for i in range(n)], "source_id string")
    gone = lambda n: S.mark_deleted(docs, live(n), "s", F.lit(datetime(2025, 1, 1))).filter("status = 'deleted'").count()
    assert (gone(0), gone(1), gone(2), gone(3)) == (0, 0, 2, 1)


def test_graph_counts_a_loop_once(spark):
    e = spark.createDataFrame([(1, 1, "a", 1.0), (1, 2, "a", 1.0)], "from_id int, to_id int, type string, confidence double").withColumn("observed_at", F.current_timestamp())
    assert {(r.entity, r.degree) for r in G.entry_points(e).collect()} == {(1, 2), (2, 1)}
    for t in ("friends_with", "", "Communicated_With", None):
        assert one(spark, G.relation_type, t) == "related_to"
    assert one(spark, G.relation_type, "communicated_with") == "communicated_with"
    assert one(spark, G.entity_type, " concept ") == "CONCEPT" and one(spark, G.entity_type, "PLACE") == "OTHER"


def test_metrics(spark):
    r = spark.createDataFrame([(["a", "b", "c"], ["b", "z"], ["c"]), ([], ["x"], [])], "results array<string>, relevant array<string>, irrelevant array<string>").withColumn("query", F.lit("q"))
    m = E.metrics(r).first()
    assert m.mrr10 == 0.25 and m.fp10 == 0.1 and m.queries == 2
    best, top = E.coordinate_search(lambda w: -abs(w["a"] - 2) - abs(w["b"] - 1), {"a": [0, 1, 2], "b": [0, 1]}, {"a": 0, "b": 0})
    assert best == {"a": 2, "b": 1} and top == 0
    t = spark.createDataFrame([(None, 1, 1.0), (datetime(2025, 1, 1), 1000, 0.9), (datetime(2025, 1, 7), 999, 0.96)], "last timestamp, docs int, after double")
    reasons = E.reindex_reasons(F.col("last"), F.lit(datetime(2025, 1, 8)), F.lit(0), F.col("docs"), [F.lit(1.0)], [F.col("after")])
    assert [r[0] for r in t.select(reasons).collect()] == [["never indexed"], ["stale", "grown", "worse"], []]


def test_interval_join_across_bins(spark):
    l = spark.createDataFrame([("k", 1, 0.0, 100.0), ("k", 2, 5.0, 4.0)], "key string, lid int, l0 double, l1 double")
    r = spark.createDataFrame([("k", "a", 10.0, 95.0), ("k", "b", 100.0, 101.0)], "key string, rid string, r0 double, r1 double")
    assert [(x.lid, x.rid, x.overlap) for x in A.interval_join(l, r).collect()] == [(1, "a", 85.0)]


def test_intent():
    from kelpmill.plans import intent

    now = datetime(2025, 6, 18, 3, tzinfo=timezone.utc)  # Wednesday noon in Seoul
    b, e = intent.window("지난주 메일", now)
    assert (b.isoformat(), e.isoformat()) == ("2025-06-08T15:00:00+00:00", "2025-06-15T15:00:00+00:00")
    assert intent.plan("지난주 메일", now).sources == ("gmail",)
    assert intent.checked('```{"from": "2025-06-02", "to": "2025-06-01"}```', "x", now) == intent.plan("x", now)
    assert intent.widened(("insight",)) == ((), True)
    assert intent.standalone("q", []) == "q"
