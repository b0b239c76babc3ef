"""The text that the sender of a mail newly wrote: blocks classified by gradient-boosted trees.

Lines are gathered into paragraphs of one quote depth. Every line gets features of itself, its paragraph and its
place: quote depth and indent, the region opened by attribution lines and header blocks, contact density, distance to
the closing formula, how many senders use the line and whether this sender repeats it (sender frequency), and the
share of its sentences that stand in an earlier mail of the thread (ancestor overlap). The trees decide which lines
are new. They are trained (train_mail.py) on a bounded sample of lines labelled by rules over the same features, as
there are no hand labels.

Ancestor overlap is a join on (thread, sentence hash) with the earliest mail that holds the sentence, so threads of
any size spread over tasks; sentences are rebuilt from rewrapped lines first.

Cases: null or empty content has no lines; blank lines are never new; a null thread has no ancestors; mails without
a row of headers get no sender and no thread; repeated rows are each judged by themselves and are no ancestors of each
other (their dates are equal); very long mails are taken whole; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import math
import os
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelpmill.llm import trees
from kelpmill.llm.text import WORD
from kelpmill.session import written

COMMON = 0.002  # a sentence that stands in a greater share of all threads is a phrase and no sign of a quotation
MODEL = os.path.join(os.path.dirname(__file__), "models", "mail_trees.json")

#: Phrases of the five languages.
CLOSINGS = (
    "all the best", "best regards", "kind regards", "many thanks", "yours sincerely", "sincerely", "cheers", "thanks", "thank you", "regards", "best", "warm regards",
    "beste grüße", "viele grüße", "mit freundlichen grüßen", "danke und gruß", "liebe grüße", "danke", "gruß", "schöne grüße",
    "cordialement", "bien à vous", "merci d'avance", "merci", "bien cordialement", "amicalement",
    "saludos", "un cordial saludo", "gracias", "un saludo", "atentamente", "muchas gracias",
    "감사합니다", "고맙습니다", "안부 전하며", "드림", "올림", "수고하세요",
)
DEVICE = re.compile(r"^(sent from (my|a)\b|get the .{0,30}app|von meinem .{0,20}gesendet|gesendet von|envoyé (de|depuis) mon|enviado desde mi|(내|나의) .{0,12}에서 보냄)", re.IGNORECASE)
LEGAL = re.compile(
    r"this message and any|attachment are confidential|meant only for|addressee|received this e-?mail|not necessarily those|confidentiality notice|unauthorised use|copying of|mail is prohibited|delete it and|tell the sender|views given here"
    r"|vertrauliche informationen|irrtümlich erhalten|empfänger bestimmt|löschen sie sie|diese e-mail enthält|confidentiel et réservé|reçu par erreur|merci de le détruire|réservé à son"
    r"|confidencial y va|solo a su destinatario|bórrelo|recibido por error|지정된 수신인|기밀 정보를|잘못 수신|삭제해 주시기",
    re.IGNORECASE,
)
WROTE = re.compile(
    r"^(on\b.{4,120}\bwrote:|.{2,60}\bwrote on\b.{4,30}:|am\b.{4,60}\bschrieb\b.{1,80}:|le\b.{4,60}\ba écrit\s*:|el\b.{4,60}\bescribió:|.{4,120}님이 작성:|\d{1,2}[/.]\d{1,2}[/.]\d{2,4} \d{1,2}:\d{2}, .{2,60}:|wrote:|schrieb:|escribió:|a écrit\s*:)\s*$",
    re.IGNORECASE,
)
WROTE_1 = re.compile(r"^(on \d.{4,60}<[^<>\s]+@[^<>\s]+>|on .{4,60}\d{1,2}:\d{2}.*|am \d.{4,100}|le \d.{4,100}|el \d.{4,100}|\d{4}년 .{4,80})$", re.IGNORECASE)
BREAK = re.compile(r"^(-{3,}\s?\S.{0,40}\S\s?-{3,}|_{10,}|begin forwarded message:|anfang der weitergeleiteten nachricht:|début du message transféré\s*:|inicio del mensaje reenviado:|전달된 메시지 시작:)\s*$", re.IGNORECASE)
HEADER = re.compile(r"^(from|sent|date|to|cc|subject|von|gesendet|datum|an|betreff|de|envoyé|date|à|objet|enviado|fecha|para|asunto|보낸 사람|보낸 날짜|날짜|받는 사람|제목|참조)\s?:\s", re.IGNORECASE)
DELIMITER = re.compile(r"^(--|__|===|—|–|\*\*\*|~~)\s*$")
DASH_NAME = re.compile(r"^[—–]\s?\S+(\s\S+){0,2}$")
EMAIL = re.compile(r"[\w.+-]+@[\w.-]+\.\w+")
PHONE = re.compile(r"[+(]?\d[\d\s().–-]{6,}\d")
ROLE = re.compile(r"^(e-?mail:|tel\.?|t:|mobile|mobil|☎|✉|fax|phone)", re.IGNORECASE)
POSTAL = re.compile(r"^(flat \d+, )?\d+ [A-Z]\S+( [A-Z]\S+)+, [A-Z]|^[^.!?]{3,60}\b\d{1,4},? \d{5} [A-Z]|^[^.!?]*시 \S+(로|길|대로) ?[\d길 ]*\d+", re.UNICODE)
POSTSCRIPT = re.compile(r"^p\.?\s?s\.?\b|^추신", re.IGNORECASE)
MARKS = re.compile(r"^\s*((?:[>|]\s?)+)")
BULLET = re.compile(r"^[-*•]\s")
SENTENCE_END = re.compile(r"(?<=[.!?。:;])\s+")
FEATURES = ("depth", "indent", "region", "opener", "header", "contact", "closing", "since_close", "legal", "paragraph_legal", "device", "senders", "repeated", "overlap", "paragraph_overlap", "mail_overlap", "name", "words", "sentence", "paragraph_words", "after", "postscript", "delimiter", "postal", "cont")


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


class Line:
    __slots__ = ("no", "raw", "body", "depth", "indent", "paragraph", "sentences")

    def __init__(self, no: int, raw: str) -> None:
        m = MARKS.match(raw)
        self.no, self.raw = no, raw
        self.depth = sum(c in ">|" for c in m[1]) if m else 0
        rest = raw[m.end() :] if m else raw
        self.indent = int(len(rest) - len(rest.lstrip(" \t")) >= 4) if rest.strip() else 0
        self.body = rest.strip()
        self.paragraph, self.sentences = -1, []


def parse(content: str | None) -> tuple[list[Line], list[tuple[int, int]]]:
    """(lines that are not blank, (sentence hash, its words)); a line knows its paragraph and sentences."""
    lines, sentences, group, number = [], [], [], 0

    def close() -> None:
        nonlocal group, number
        if not group:
            return
        text, spans = "", []
        for line in group:
            line.paragraph = number
            spans.append((len(text), len(text) + len(line.body)))
            text += line.body + " "
        number += 1
        stops = {m.end() for m in SENTENCE_END.finditer(text)} | {0, len(text)}
        for line, (a, b) in zip(group, spans):  # a bullet begins a unit of its own, a greeting ends one
            if BULLET.match(line.body):
                stops.add(a)
            if line.body.endswith((",", ":")) and len(WORD.findall(line.body)) <= 5:
                stops |= {a, b + 1}
        ordered = sorted(stops)
        for start, end in zip(ordered[:-1], ordered[1:]):
            tokens = WORD.findall(text[start:end].lower())
            if len(tokens) >= 3:
                for line, (a, b) in zip(group, spans):
                    if a < end and b > start:
                        line.sentences.append(len(sentences))
                sentences.append((_hash(" ".join(tokens)), len(tokens)))
        group = []

    for no, raw in enumerate((content or "").split("\n"), 1):
        line = Line(no, raw.rstrip("\r"))
        if not line.body:
            close()
            continue
        if group and (line.depth, line.indent) != (group[-1].depth, group[-1].indent):
            close()
        group.append(line)
        lines.append(line)
    close()
    return lines, sentences


def is_closing(body: str) -> bool:
    return body.lower().rstrip(" ,.!~").replace("’", "'") in CLOSINGS


def name_parts(header: str | None) -> set[str]:
    display = (header or "").split("<")[0]
    return {w for w in WORD.findall(display.lower()) if len(w) > 1}


def describe(content: str | None, sender: str | None, line_info: dict[int, tuple[float, int]], old: set[int]) -> tuple[list[Line], np.ndarray]:
    """Features of every line that is not blank. line_info: by line hash (share of senders who use it, repeated by this sender); old:
    hashes of sentences that stand in an earlier mail of the thread."""
    lines, sentences = parse(content)
    x = np.zeros((len(lines), len(FEATURES)), np.float32)
    if not lines:
        return lines, x
    names = name_parts(sender)
    known = [h in old for h, _ in sentences]
    total = sum(n for _, n in sentences)
    mail_overlap = sum(n for (_, n), k in zip(sentences, known) if k) / total if total else 0.0
    words_of: dict[int, int] = {}
    old_of: dict[int, list[float]] = {}
    legal_of: dict[int, int] = {}
    for line in lines:
        p = line.paragraph
        words_of[p] = words_of.get(p, 0) + len(WORD.findall(line.body))
        old_of.setdefault(p, []).extend(float(known[s]) for s in line.sentences)
        legal_of[p] = legal_of.get(p, 0) + len(LEGAL.findall(line.body))
    opener = [0] * len(lines)
    for i, line in enumerate(lines):
        nxt = lines[i + 1].body if i + 1 < len(lines) else ""
        if WROTE.match(line.body) and not (line.body.endswith(":") and len(line.body) > 160):
            opener[i] = 1
            if WROTE.match(line.body)[1].lower().rstrip(" :") in ("wrote", "schrieb", "escribió", "a écrit") and i:
                opener[i - 1] = 1
        elif WROTE_1.match(line.body) and re.match(r"^(wrote|schrieb|escribió|a écrit)\b.*:$", nxt, re.IGNORECASE):
            opener[i] = 1
        elif BREAK.match(line.body) and i + 1 < len(lines) and (HEADER.match(nxt) or BREAK.match(nxt)):
            opener[i] = 2
        elif HEADER.match(line.body):
            near = sum(bool(HEADER.match(l.body)) for l in lines[max(0, i - 4) : i + 5])
            if near >= 2:
                opener[i] = 2
    marked_after = [False] * len(lines)
    seen = False
    for i in range(len(lines) - 1, -1, -1):
        marked_after[i] = seen
        seen = seen or lines[i].depth > 0 or bool(lines[i].indent)
    region, since, last_paragraph = 0, 0, max(l.paragraph for l in lines)
    previous_open = False
    for i, line in enumerate(lines):
        body, own = line.body, line.depth == 0 and not line.indent
        n_words = len(WORD.findall(body))
        contact = sum(len(m[0]) for m in EMAIL.finditer(body)) + sum(len(m[0]) for m in PHONE.finditer(body))
        closing, delimiter = is_closing(body), bool(DELIMITER.match(body) or DASH_NAME.match(body) and len(WORD.findall(body)) <= 3)
        tokens = {w for w in WORD.findall(body.lower())}
        is_name = bool(tokens) and (tokens <= names or n_words <= 3 and bool(tokens & names) and not body.endswith((",", ":", "님께,")))
        sentence = body.endswith((".", "!", "?", "…", "。")) or n_words >= 9
        senders, repeated = line_info.get(_hash(body), (0.0, 0))
        if opener[i] == 1 and own:  # behind a header block nothing is marked any more, whatever is quoted in there
            region = 1 if marked_after[i] and region != 2 else 2
        elif opener[i] == 2 and own:
            region = 2
        if own:
            if closing or delimiter:
                since = 1
            elif since:
                since += 1
                if POSTSCRIPT.match(body) or sentence and n_words >= 5 and not legal_of[line.paragraph] and not DEVICE.match(body) and not ROLE.match(body):
                    since = 0
        overlap = [float(known[s]) for s in line.sentences]
        po = old_of[line.paragraph]
        x[i] = (
            line.depth, line.indent, region if own else -1, opener[i], bool(HEADER.match(body)), contact / max(1, len(body)), closing, min(since, 12) if own else 0,
            len(LEGAL.findall(body)), legal_of[line.paragraph], bool(DEVICE.match(body)), math.log2(1 + 1000 * senders), repeated,
            sum(overlap) / len(overlap) if overlap else (sum(po) / len(po) if po else 0.0), sum(po) / len(po) if po else 0.0, mail_overlap, is_name, min(n_words, 30), sentence,
            min(words_of[line.paragraph], 80), last_paragraph - line.paragraph, bool(POSTSCRIPT.match(body)), delimiter, bool(POSTAL.match(body)) or bool(ROLE.match(body)), previous_open,
        )
        previous_open = own and not body.endswith((".", "!", "?", ",", ":")) and n_words >= 5
    return lines, x


def rule_label(f: dict[str, float]) -> int:
    """1 if the line is new, by rules over its features: the labels of the training sample."""
    if f["depth"] > 0 or f["indent"] or f["opener"] or f["device"] or f["delimiter"]:
        return 0
    if f["header"] and f["region"] == 2:
        return 0
    if f["legal"] or f["paragraph_legal"] >= 2:
        return 0
    if f["region"] == 2:
        whole = f["words"] >= 4 and f["sentence"] or f["paragraph_words"] >= 8
        return int(f["mail_overlap"] > 0.1 and f["overlap"] < 0.5 and f["paragraph_overlap"] < 0.5 and whole and not f["since_close"] and not f["contact"] > 0.5)
    if f["overlap"] >= 0.5 and f["words"] >= 6 and f["paragraph_overlap"] >= 0.5:
        return 0
    if f["paragraph_overlap"] >= 0.6 and f["paragraph_words"] >= 8 and (f["overlap"] >= 0.5 or f["paragraph_overlap"] >= 0.7 and f["paragraph_words"] >= 12):
        return 0
    if f["postscript"]:
        return 1
    if f["closing"]:
        return 0
    if f["since_close"]:
        return 0
    if f["contact"] > 0.5 and f["words"] <= 6 and not f["sentence"]:
        return 0
    if f["name"] and f["words"] <= 3 and not f["sentence"] and f["after"] == 0:
        return 0
    return 1


def _units(batches):
    """Batches (record_id, mail, sender, thread, sent, content) -> units of the lines and sentences of each mail."""
    for b in batches:
        out: list[list] = [[] for _ in range(6)]
        for record, mail, sender, thread, sent, content in zip(*(b.column(k).to_pylist() for k in range(6))):
            lines, sentences = parse(content)
            units = {(0, _hash(line.body)) for line in lines if not line.depth and not line.indent}
            if thread is not None and sent is not None:
                units |= {(1, h) for h, _ in sentences}
            s = _hash(sender or "")
            for kind, h in units:
                for c, v in zip(out, (record, mail, kind, h, s if kind == 0 else _hash(thread), sent or 0)):
                    c.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int8(), pa.int64(), pa.int64(), pa.int64()))], names=["record_id", "mail", "kind", "unit", "party", "sent"])


def mails(docs: DataFrame, headers: DataFrame) -> DataFrame:
    """(record_id, mail, sender, thread, sent, content) of every mail row."""
    rows = docs.filter((F.col("source_type") == "gmail") & F.col("content").isNotNull()).select("record_id", "source_id", "content")
    heads = headers.groupBy(F.concat(F.lit("gmail:"), F.col("message_id")).alias("source_id")).agg(F.any_value("from_header").alias("sender"), F.any_value("thread_id").alias("thread"), F.any_value(F.expr("try_cast(internal_date AS bigint)")).alias("sent"))
    return rows.join(heads, "source_id", "left").select("record_id", F.xxhash64("source_id").alias("mail"), "sender", "thread", "sent", "content")


def described(docs: DataFrame, headers: DataFrame) -> DataFrame:
    """(record_id, sender, content, lines: array of (unit, share of senders, repeated), old: array of sentence hashes)."""
    m = mails(docs, headers)
    units, _ = written(m.mapInArrow(_units, "record_id long, mail long, kind byte, unit long, party long, sent long"), "units")  # three aggregations read it
    line = units.filter("kind = 0")
    by_sender = line.groupBy("unit", "party").agg(F.min("mail").alias("_a"), F.max("mail").alias("_b"))
    everybody = max(1, line.agg(F.approx_count_distinct("party")).first()[0])  # one number; shares are alike at every size
    common = by_sender.groupBy("unit").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("unit", (F.col("_n") / everybody).alias("senders"))
    own = by_sender.filter("_a <> _b").select("unit", "party", F.lit(1).alias("repeated"))
    line_rows = line.select("record_id", "unit", "party").join(common, "unit", "left").join(own, ["unit", "party"], "left").filter("senders IS NOT NULL OR repeated IS NOT NULL")
    line_info = line_rows.groupBy("record_id").agg(F.collect_list(F.struct("unit", F.coalesce("senders", F.lit(0.0)).alias("senders"), F.coalesce("repeated", F.lit(0)).alias("repeated"))).alias("lines"))
    sentence = units.filter("kind = 1").select("record_id", "unit", "party", "sent")
    per_thread = sentence.groupBy("unit", "party").agg(F.min("sent").alias("_first"), F.max("sent").alias("_last"))
    threads = sentence.agg(F.approx_count_distinct("party")).first()[0]  # one number
    phrases = per_thread.groupBy("unit").count().filter(F.col("count") > max(2, COMMON * threads)).select("unit")
    first = per_thread.filter("_last > _first").drop("_last").join(phrases, "unit", "left_anti")
    old = sentence.join(first, ["unit", "party"]).filter("sent > _first").groupBy("record_id").agg(F.collect_set("unit").alias("old"))
    return m.select("record_id", "sender", "content").join(line_info, "record_id", "left").join(old, "record_id", "left")


def rows_of(b: pa.RecordBatch):
    """(record_id, lines, features) of each mail of a batch of described()."""
    for record, sender, content, lines, old in zip(*(b.column(k).to_pylist() for k in range(5))):
        info = {u["unit"]: (u["senders"], u["repeated"]) for u in lines or ()}
        yield record, *describe(content, sender, info, set(old or ()))


def _judged(model: dict, threshold: float):
    def run(batches):
        for b in batches:
            records, numbers, parts = [], [], []
            for record, lines, x in rows_of(b):
                records += [record] * len(lines)
                numbers += [l.no for l in lines]
                parts.append(x)
            if not records:
                continue
            keep = pa.array(trees.score(model, np.concatenate(parts)) >= threshold)
            yield pa.RecordBatch.from_arrays([pa.array(records, pa.int64()).filter(keep), pa.array(numbers, pa.int32()).filter(keep)], names=["record_id", "line_no"])

    return run


def new_lines(docs: DataFrame, headers: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(record_id, line_no) of every line that its sender newly wrote."""
    with open(MODEL) as f:
        model = json.load(f)
    return described(docs, headers).mapInArrow(_judged(model, threshold), "record_id long, line_no int")


def new_text(docs: DataFrame, headers: DataFrame) -> DataFrame:
    """(record_id, new_text): the new lines of each mail, in order, joined by line ends."""
    kept = new_lines(docs, headers).groupBy("record_id").agg(F.array_sort(F.collect_list("line_no")).alias("kept"))
    text = docs.filter(F.col("source_type") == "gmail").select("record_id", F.split(F.regexp_replace("content", "\r\n", "\n"), "\n").alias("_lines"))
    return text.join(kept, "record_id").select("record_id", F.array_join(F.transform("kept", lambda i: F.element_at("_lines", i)), "\n").alias("new_text"))
