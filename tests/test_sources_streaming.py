"""Sources, extractors, streaming and enrichment."""

from __future__ import annotations

import io
import json
import zipfile
from datetime import datetime

from pyspark.sql import functions as F

from kelpmill.operators import enrich as N
from kelpmill.sources import extract as X
from kelpmill.sources import files as S
from kelpmill.sources import messages as M
from kelpmill.streaming import ingest as G


def zipped(**parts: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name.replace("__", "/").replace("_xml", ".xml"), text)
    return out.getvalue()


def test_extractors():
    assert X.html_text(b"<p>a <b>b</b></p><style>x</style><script>var t='</p>'</script>c &amp; d<p>e") == "a\nb\nc & d\ne"
    doc = zipped(word__document_xml="<w:d xmlns:w='u'><w:p><w:t>one</w:t><w:t> two</w:t></w:p><w:p><w:t>three</w:t></w:p></w:d>")
    assert X.extract(doc, "a.docx") == "one two\nthree"
    ppt = zipped(ppt__slides__slide1_xml="<s xmlns:a='u'><a:p><a:t>x</a:t></a:p></s>", ppt__slides__slide2_xml="<s xmlns:a='u'><a:p><a:t>y</a:t></a:p></s>")
    assert X.extract(ppt, "a.pptx") == "--- Slide 1 ---\nx\n\n--- Slide 2 ---\ny"
    hwpx = zipped(Contents__section10_xml="<s><p><t>b</t></p></s>", Contents__section2_xml="<s><p><t>a</t></p></s>")
    assert X.extract(hwpx, "a.hwpx") == "a\nb"
    sheet = zipped(xl__workbook_xml="<w><sheet name='S1'/><sheet name='S2'/></w>", xl__sharedStrings_xml="<s><si><t>k\tv</t></si></s>", xl__worksheets__sheet1_xml="<d><row><c t='s'><v>0</v></c><c><v>2</v></c></row><row><c/></row></d>", xl__worksheets__sheet2_xml="<d/>")
    assert X.extract(sheet, "a.xlsx") == "##SHEET S1\nk v\t2"
    assert X.extract(b"broken", "a.docx") is None and X.extract(None, "a") is None and X.extract(b"t\xff", "a.md") == "t�"
    assert X.cut("가나다", 4) == "가" + X.TRUNCATED


def test_file_scan(spark, tmp_path):
    for rel, text in (("a.md", "hello"), ("sub/b.txt", "x"), (".git/c.txt", "no"), ("d.png", "no"), ("e.lock", "no"), ("f.gdoc", '{"u": "https://x.test/d/1"}'), ("h.tar", "x" * 2048)):
        p = tmp_path / rel
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    files = S.scan(spark, str(tmp_path))
    assert {(r.source_id, r.content) for r in S.documents(files).collect()} == {
        ("a.md", "hello"), ("sub/b.txt", "x"), ("d.png", "Image: d.png\nPath: d.png\nSize: 2 B"), ("f.gdoc", "Google Doc: f.gdoc\nPath: f.gdoc\nURL: https://x.test/d/1"),
        ("h.tar", "Archive: h.tar\nPath: h.tar\nSize: 2 KB"),
    }
    faults = spark.createDataFrame([("a.M4A", b"0000ftypx"), ("a.m4a", b"00000000"), ("a.mp3", b"00000000"), ("a.mp3", b"0"), ("a.mp3", None)], "n string, d binary").select(S.audio_fault(F.col("n"), F.col("d")))
    assert [r[0] for r in faults.collect()] == [None, "no m4a file", None, "too short", "too short"]
    known = spark.createDataFrame([("a.md",)], "source_id string")
    assert "a.md" not in {r.source_id for r in S.incremental(files, F.lit(datetime(2999, 1, 1)), known).collect()}
    assert S.untranscribed(files, None, known).count() == files.count() - 1 and S.untranscribed(files, F.lit(datetime(2999, 1, 1)), None).count() == 0
    assert S.latest_by_prefix(files, "a").first()[0] == "a.md"
    kinds = spark.createDataFrame([(bytearray(b"RIFF0000WAVEfmt "),), (bytearray(b"ID3abc"),), (bytearray(b"text"),)], "d binary").select(S.audio_kind(F.col("d")))
    assert [r[0] for r in kinds.collect()] == ["wav", "mp3", None]
    at = spark.createDataFrame([("a_20250601120000-2.m4a",), ("Voice_250601_120000.m4a",), ("call_20250601_120000.m4a",), ("a_20251399999999.m4a",), ("x.m4a",)], "n string").select(S.recorded_at(F.col("n"), F.lit(datetime(2020, 1, 1))))
    assert [r[0] for r in at.collect()] == [datetime(2025, 6, 1, 12)] * 2 + [datetime(2020, 1, 1)] * 3


def test_sms_xml(spark, tmp_path):
    p = tmp_path / "sms.xml"
    p.write_text("<smses><sms address='010' body='hi' date='5' type='1' contact_name='A'/><sms address='x' date='bad'/></smses>")
    assert [tuple(r) for r in M.sms_xml(spark, str(p)).select("address", "body", "date_ms", "msg_type").collect()] == [("010", "hi", 5, 1)]


def test_mappers(spark):
    slack = spark.createDataFrame([("c", "1.5", "u", "t", None)] * 2 + [("c", "2.5", "u", "", None)], "channel string, ts string, user string, text string, thread_ts string")
    assert M.map_slack(slack).count() == 1
    cal = spark.createDataFrame([("1", "s", None, "room", ["a", "b"], "2025-06-01", True)], "id string, summary string, description string, location string, attendees array<string>, start string, all_day boolean")
    assert M.map_calendar(cal).first().content == "Location: room\nAttendees: a, b"
    gh = spark.createDataFrame([("r", 1, "t", None, "open", "2025-06-01T00:00:00Z", "x"), ("r", 2, "t", "b", "open", "2025-06-01T00:00:00Z", None)], "repo string, number int, title string, body string, state string, updated_at string, pull_request string")
    assert [json.loads(r.metadata)["kind"] for r in M.map_github(gh).collect()] == ["pr", "issue"]
    tg = spark.createDataFrame([(1, 1, 100, None, "cap", "n"), (2, 1, 100, "t", None, "n"), (1, 2, 1, "old", None, "n")], "chat_id long, message_id long, date long, text string, caption string, from_name string")
    assert [r.content for r in M.map_telegram(tg, [1], F.lit(datetime(1970, 1, 1, 0, 1))).collect()] == ["cap"]
    notion = spark.createDataFrame([("1", "t", [("heading_1", "H"), ("to_do", "x"), ("paragraph", "")], "2025-06-01")], "id string, title string, blocks array<struct<type:string,text:string>>, edited string")
    assert M.map_notion(notion).first().content == "# H\n[ ] x"
    re = spark.createDataFrame([("m", "bot", "u", "👍"), ("m", "bot", "bot", "👍"), ("m", "u", "v", "👎"), ("m", "bot", "w", "🙂")], "message_id string, author string, user string, emoji string")
    assert [(r.user, r.thumbs) for r in M.reaction_feedback(re, "bot").collect()] == [("u", 1)]
    links = spark.createDataFrame([("https://x/d/abcdefghijk/edit",), ("https://x?id=abcdefghijk",), ("none",)], "u string")
    assert [r[0] for r in links.select(M.drive_file_id(F.col("u"))).collect()] == ["abcdefghijk", "abcdefghijk", None]


def test_snapshot_is_applied_once(spark, tmp_path):
    snap = G.Snapshot(spark, str(tmp_path / "s"), "k string, v int, o int")
    run = G.upserting(snap, ["k"], "o", "src")
    run(spark.createDataFrame([("a", 1, 1), ("a", 2, 2), ("b", 1, 1)], snap.schema), 0)
    run(spark.createDataFrame([("a", 9, 9)], snap.schema), 0)  # the same batch again
    run(spark.createDataFrame([("c", 3, 1)], snap.schema), 1)
    assert {tuple(r) for r in snap.read().collect()} == {("a", 2, 2), ("b", 1, 1), ("c", 3, 1)}


def test_snapshot_rewrites_only_touched_buckets(spark, tmp_path):
    snap = G.Snapshot(spark, str(tmp_path / "s"), "k long, v long", buckets=4)
    rows = lambda lo, hi, v: spark.range(lo, hi).selectExpr("id AS k", f"CAST({v} AS LONG) AS v")
    assert snap.merge(rows(0, 100, 1), ["k"], "s", 0) and not snap.merge(rows(0, 100, 9), ["k"], "s", 0)
    first = snap._pointer()["of"]
    snap.merge(rows(7, 8, 2), ["k"], "s", 1)
    second = snap._pointer()["of"]
    assert sum(first[b] != second[b] for b in first) == 1
    for n in range(2, 5):
        snap.merge(rows(7, 8, n), ["k"], "s", n)
    assert {(r.k, r.v) for r in snap.read().collect()} == {(k, 4 if k == 7 else 1) for k in range(100)}
    assert len([p for p in (tmp_path / "s").iterdir() if p.is_dir()]) <= 3  # old versions are removed
    assert snap.write(rows(0, 3, 5), "s", 5) and snap.read().count() == 3


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    spark.range(100).selectExpr("id % 40 AS k", "timestamp_seconds(id) AS ts", "id").coalesce(1).write.parquet(str(src))
    stream = spark.readStream.schema("k long, ts timestamp, id long").parquet(str(src))
    q = G.unique_events(stream, ["k"], "ts", "1 hour").writeStream.format("memory").queryName("uniq").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("uniq").count() == 40
    snap = G.Snapshot(spark, str(tmp_path / "s"), "k long, ts timestamp, id long")
    G.collect(stream, snap, ["k"], "id", "src", str(tmp_path / "cp")).awaitTermination()
    assert snap.read().agg(F.sum("id")).first()[0] == sum(range(60, 100))


def test_retry_state(spark, tmp_path):
    src = tmp_path / "in"
    spark.createDataFrame([("a", False, 10), ("a", False, 20), ("b", True, 5)], "key string, ok boolean, at long").coalesce(1).write.parquet(str(src))
    q = G.retry_queue(spark.readStream.schema("key string, ok boolean, at long").parquet(str(src))).writeStream.format("memory").queryName("retry").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.key, r.attempts) for r in spark.table("retry").collect()} == {("a", 2), ("b", 0)}


def test_enrichment(spark):
    a = spark.createDataFrame([("d", '```json\n{"entities": [{"name": " Bo ", "type": "person"}, {"name": "", "type": "x"}], "relations": [{"source": "a", "target": "b", "type": "zz", "confidence": 7}], "insights": ["1", "2", "3", "4"]}\n```'), ("e", "no json")], "id string, answer string")
    assert [tuple(r) for r in N.entities(a).collect()] == [("d", "Bo", "PERSON")]
    assert [(r.type, float(r.confidence)) for r in N.relations(a).collect()] == [("related_to", 1.0)]
    assert [r.source_id for r in N.insights(a).orderBy("source_id").collect()] == ["insight:d:0", "insight:d:1", "insight:d:2"]
    s = spark.createDataFrame([("b", 0, "ok", ["k"]), ("b", 1, "bad", ["zz"]), ("b", 2, "", ["k"])], "id string, at int, text string, cites array<string>")
    assert [r.at for r in N.grounded(s, spark.createDataFrame([("k",)], "key string")).collect()] == [0]
    assert N.packed_batches(["aa", "bb", "c" * 9], 4) == [["aa", "bb"], ["c" * 9]]
    assert N.served(a.withColumn("text", F.lit("x")), lambda t: [x.upper() for x in t], "text").first().answer == "X"
    assert G.admitted(spark.createDataFrame([("a", 5), ("b", 15), ("c", 1)], "id string, date_ms long"), 10, 3, spark.createDataFrame([("z",)], "id string")).count() == 2


def test_html_of_all_documents(spark, tmp_path):
    import hashlib

    from kelpmill.plans import sources

    texts = {1: ("a & b <c>\r\nd", "a & b <c>|d"), 2: ("x &amp; y\rz", "x &amp; y|z"), 3: ("<script>k</script>\n\n 1 > 0", "<script>k</script>|1 > 0"), 4: (None, None), 5: ("", "")}
    rows = [(i, "gmail" if i % 2 else "note", t) for i, (t, _) in texts.items()]
    spark.createDataFrame(rows, "record_id long, source_type string, content string").write.parquet(str(tmp_path / "brain_documents.parquet"))
    got = {r.record_id: r.h for r in sources.QUERIES["s06_html_pages"](spark, str(tmp_path)).collect()}
    assert got == {i: None if w is None else hashlib.md5(w.encode()).hexdigest() for i, (_, w) in texts.items()}
