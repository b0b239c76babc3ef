"""Speech transcripts into clean, ordered speaker turns.

A segment is cleaned of time marks, sound notes, speaker labels and hesitation sounds; segments without a word left
fall away. Speakers come from the diarization: for each segment the speaker whose rows overlap it longest, else the
one nearest in time. Recordings without diarization use the label a segment carries itself; where that is missing a
hidden Markov model fills it in: the states are the speakers of the recording, the observations the words of a
segment under a language profile of each speaker (add-one smoothed word counts of that speaker's labelled segments),
the transitions those counted from speaker to speaker between labelled neighbours of the recording, smoothed by its rate
of staying; labelled segments are fixed.

Bounds: segments and diarization meet in time bins, and everything that goes by the order of a recording is reckoned in
stretches of STRETCH_SECONDS, with what a stretch takes over from those before it found on one row per stretch; so a
recording of any length spreads over tasks. The model decodes stretches of STRETCH segments that overlap by MARGIN on
each side.

Cases: null text or only blanks hold no word; exact repeated rows count once; of a recording without any speaker all
segments have one unnamed speaker; null times put a segment first and give it no overlap; equal starts go by seg_index;
unreadable diarization labels (null, blank) are ignored; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from kelpmill.session import written

BIN = 30.0  # seconds
STRETCH, MARGIN = 2000, 50
STRETCH_SECONDS = 600.0
PRIOR = 4.0  # moves that the rate of staying counts for beside those seen from a speaker

#: Sounds of hesitation in the five languages.
HESITATIONS = (
    "um", "uhm", "uh", "er", "erm", "hmm", "hm", "mm", "mmm", "mhm", "ah", "eh", "ehm", "em", "este",
    "äh", "ähm", "öh", "öhm", "tja", "euh", "heu", "hum", "bah", "음", "으음", "어", "흠", "에", "저기", "그",
)
#: Of these, sounds that are also ordinary words and count as hesitation only in front of a comma or dots.
DOUBTFUL = ("este", "tja", "bah", "에", "저기", "그", "ah", "em", "um")

TIME = r"(?:\d{1,2}:)?\d{1,2}:\d{2}(?:[.,]\d{1,3})?"
STAMP = re.compile(rf"^\s*(?:\[\s*{TIME}\s*\]|\(\s*{TIME}\s*\)|<\s*{TIME}\s*>|\[\s*(?:\d+h)?\d+m\s*\d+s\s*\]|{TIME}\s*-->\s*(?:{TIME})?|{TIME}\s*[-–—:|]?(?=\s))\s*")
LABEL = re.compile(
    r"^\s*(?:[\[(<]\s*(?:(?:speaker|spk|sprecher|locuteur|hablante|화자|s)?[ _#.\-]*(\d{1,3}|[a-z]))\s*[\])>]\s*[:>\-]?"
    r"|(?:speaker|spk|sprecher|locuteur|hablante|화자)[ _#.\-]*(\d{1,3}|[a-z])\s*(?:[:>]|[-–—](?=\s)|(?=$))"
    r"|s(\d{1,3})\s*[:>]"
    r"|([a-z])\s*:(?=\s|$))\s*",
    re.IGNORECASE,
)
NOTE = re.compile(r"\(\([^()]*\)\)|\[[^\[\]\d@]*\]|<[^<>\d@]*>|\{[^{}]*\}|\*[^*\d]{1,40}\*|♪[^♪]*♪|♪|\([^()\d@,]{1,30}\)")
SPELLED = re.compile(r"[\[(](?:at|dot|punkt|arroba|punto|arobase|point)[\])]", re.IGNORECASE)
_sure = "|".join(sorted((re.escape(w) for w in HESITATIONS if w not in DOUBTFUL), key=len, reverse=True))
_all = "|".join(sorted(map(re.escape, HESITATIONS), key=len, reverse=True))
HESITATION = re.compile(rf"(?<![\w'’])(?:(?:{_sure})(?![\w'’])[,.…]*|(?:{_all})(?:,|\.{{2,}}|…))\s*", re.IGNORECASE)
ONLY = re.compile(rf"^(?:[\W_]*(?:{_all})(?![\w]))*[\W_]*$", re.IGNORECASE)
SPEAKER = re.compile(r"(\d+|[A-Za-z])\s*$")


def speaker_key(label: str | None) -> str | None:
    """The number or letter that names a speaker: 'SPEAKER_01', 'spk 1' and '1' are one."""
    m = SPEAKER.search(label.strip()) if label else None
    return (str(int(m[1])) if m[1].isdigit() else m[1].lower()) if m else None


def clean(text: str | None) -> tuple[str, str | None]:
    """(spoken words, speaker named by the segment's own label)."""
    text, label = text or "", None
    for _ in range(8):  # marks may stand in any order in front
        if m := STAMP.match(text):
            text = text[m.end() :]
        elif m := LABEL.match(text):
            label = label or speaker_key(next(g for g in m.groups() if g))
            text = text[m.end() :]
        elif (m := NOTE.match(text.lstrip())) and not SPELLED.match(text.lstrip()):
            text = text.lstrip()[m.end() :]
        else:
            break
    text = NOTE.sub(lambda m: m[0] if SPELLED.fullmatch(m[0]) else " ", text)
    if ONLY.match(text):
        return "", label
    before = None
    while before != text:
        before, text = text, HESITATION.sub("", text)
    text = re.sub(r"\s+", " ", text).strip()
    return (text if re.search(r"[^\W_]", text) else ""), label


def _cleaned(texts: pd.Series) -> pd.DataFrame:
    both = [clean(t) for t in texts]
    return pd.DataFrame({"text": [b[0] for b in both], "label": [b[1] for b in both]})


def key_column(label: Column) -> Column:
    raw = F.regexp_extract(F.trim(label), r"([0-9]+|[A-Za-z])\s*$", 1)
    return F.when(raw.rlike("^[0-9]+$"), F.regexp_replace(raw, "^0+(?=[0-9])", "")).when(raw != "", F.lower(raw))


def spoken(segments: DataFrame) -> DataFrame:
    """Distinct segments that still hold a word: recording_id, seg_index, start_sec, end_sec, text, label, uid."""
    rows = segments.select("recording_id", "seg_index", "start_sec", "end_sec", "seg_text").filter("recording_id IS NOT NULL").distinct()
    said = rows.withColumn("c", F.pandas_udf(_cleaned, "text string, label string")("seg_text")).filter(F.col("c.text") != "").select("recording_id", "seg_index", "start_sec", "end_sec", "seg_text", F.col("c.text").alias("text"), F.col("c.label").alias("label"))
    return said.withColumn("uid", F.xxhash64("recording_id", "seg_index", "start_sec", "end_sec", "seg_text")).drop("seg_text")


def by_overlap(said: DataFrame, diar: DataFrame) -> DataFrame:
    """(uid, speaker) of the longest overlap; ties go to the speaker who starts first, then to the lesser key."""
    bins = lambda s, e: F.explode(F.sequence(F.floor(s / BIN), F.floor(e / BIN)))
    s = said.filter("start_sec IS NOT NULL AND end_sec >= start_sec").select("uid", "recording_id", F.col("start_sec").alias("s0"), F.col("end_sec").alias("s1"), bins(F.col("start_sec"), F.col("end_sec")).alias("bin"))
    d = diar.filter("end_sec >= start_sec").select("recording_id", "speaker", F.col("start_sec").alias("d0"), F.col("end_sec").alias("d1"), bins(F.col("start_sec"), F.col("end_sec")).alias("bin"))
    first_common = F.greatest(F.floor(F.col("s0") / BIN), F.floor(F.col("d0") / BIN))
    both = s.join(d, ["recording_id", "bin"]).filter((F.col("bin") == first_common) & (F.col("d0") < F.col("s1")) & (F.col("d1") > F.col("s0")))
    lengths = both.groupBy("uid", "speaker").agg(F.sum(F.least("s1", "d1") - F.greatest("s0", "d0")).alias("length"), F.min("d0").alias("d0"))
    return lengths.groupBy("uid").agg(F.min_by("speaker", F.struct(-F.round("length", 6), F.col("d0"), F.col("speaker"))).alias("speaker"))


def _stretch(at: Column) -> Column:
    """Number of the stretch of a time; null times come first."""
    return F.coalesce(F.floor(at / STRETCH_SECONDS).cast("long"), F.lit(-(1 << 62)))


ORDER = ("start_sec", "seg_index", "end_sec", "uid")


def _across():
    """Over one row per stretch."""
    return Window.partitionBy("recording_id").orderBy("_b")


def _earlier():
    return _across().rowsBetween(Window.unboundedPreceding, -1)


def in_order(rows: DataFrame, value: str) -> DataFrame:
    """Adds `before`, the value of the row before in its recording, and `_row`, the row's place from 0."""
    rows = rows.withColumn("_b", _stretch(F.col("start_sec")))
    per = rows.groupBy("recording_id", "_b").agg(F.max_by(F.struct(F.col(value).alias("v")), F.struct(*ORDER)).alias("_last"), F.count(F.lit(1)).alias("_n"))
    carried = per.select("recording_id", "_b", F.lag("_last").over(_across()).alias("_carry"), F.coalesce(F.sum("_n").over(_earlier()), F.lit(0)).alias("_done"))
    inside = Window.partitionBy("recording_id", "_b").orderBy(*ORDER)
    placed = rows.join(carried, ["recording_id", "_b"]).withColumn("_in", F.row_number().over(inside)).withColumn("_lag", F.lag(value).over(inside))
    return placed.withColumn("before", F.when(F.col("_in") == 1, F.col("_carry.v")).otherwise(F.col("_lag"))).withColumn("_row", F.col("_in") - 1 + F.col("_done")).drop("_carry", "_done", "_in", "_lag")


def running_sum(rows: DataFrame, value: str, name: str) -> DataFrame:
    """Adds the sum of a value over a recording up to each row; rows come from in_order()."""
    per = rows.groupBy("recording_id", "_b").agg(F.sum(value).alias("_s"))
    carried = per.select("recording_id", "_b", F.coalesce(F.sum("_s").over(_earlier()), F.lit(0)).alias("_done"))
    inside = Window.partitionBy("recording_id", "_b").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("_sum", F.sum(value).over(inside)).join(carried, ["recording_id", "_b"]).withColumn(name, (F.col("_sum") + F.col("_done")).cast("int")).drop("_sum", "_done")


def by_distance(said: DataFrame, diar: DataFrame) -> DataFrame:
    """(uid, speaker) of the diarization row nearest in time: the last to end before and the first to start after."""
    none = F.lit(None)
    mark = lambda at, kind: diar.select("recording_id", F.col(at).alias("at"), F.lit(kind).alias("kind"), none.cast("long").alias("uid"), none.cast("double").alias("s0"), none.cast("double").alias("s1"), "speaker")
    points = said.select("recording_id", F.col("start_sec").alias("at"), F.lit(1).alias("kind"), "uid", F.col("start_sec").alias("s0"), F.col("end_sec").alias("s1"), none.cast("string").alias("speaker"))
    points = points.unionByName(mark("end_sec", 0)).unionByName(mark("start_sec", 2)).withColumn("_b", _stretch(F.col("at")))
    ended = F.when(F.col("kind") == 0, F.struct("at", "speaker"))
    starts = F.when(F.col("kind") == 2, F.struct("at", "speaker"))
    per = points.groupBy("recording_id", "_b").agg(F.max(ended).alias("_e"), F.min(starts).alias("_s"))
    later = Window.partitionBy("recording_id").orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    carried = per.select("recording_id", "_b", F.last("_e", ignorenulls=True).over(_earlier()).alias("_e"), F.last("_s", ignorenulls=True).over(later).alias("_s"))
    w = Window.partitionBy("recording_id", "_b")
    before = F.last(ended, ignorenulls=True).over(w.orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0))
    after = F.last(starts, ignorenulls=True).over(w.orderBy(F.desc("at"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, 0))
    near = points.withColumn("before", before).withColumn("after", after).filter("uid IS NOT NULL").join(carried, ["recording_id", "_b"])
    near = near.withColumn("before", F.coalesce("before", "_e")).withColumn("after", F.coalesce("after", "_s"))
    gap0, gap1 = F.col("s0") - F.col("before.at"), F.col("after.at") - F.col("s1")
    return near.select("uid", F.when(F.col("after").isNull() | (gap0 <= gap1), F.col("before.speaker")).otherwise(F.col("after.speaker")).alias("speaker"))


def _decoded(pdf: pd.DataFrame) -> pd.DataFrame:
    """Viterbi over one stretch: uid, label, scores (log likelihood per speaker), stay (rate), moves (counts of 'a>b')."""
    pdf = pdf.sort_values(["start_sec", "seg_index", "uid"], na_position="first", kind="stable")
    speakers = sorted({s for row in pdf["scores"] for s in row})
    if not speakers:
        return pd.DataFrame({"uid": pdf["uid"], "speaker": None, "inner": pdf["inner"]})
    k, stay = len(speakers), float(pdf["stay"].iloc[0])
    prior = np.full((k, k), (1 - stay) / max(1, k - 1) + 1e-9)
    np.fill_diagonal(prior, stay)
    seen = pdf["moves"].iloc[0] or {}
    counts = np.array([[seen.get(f"{a}>{b}", 0) for b in speakers] for a in speakers], float)
    move = np.log((counts + PRIOR * prior) / (counts.sum(axis=1, keepdims=True) + PRIOR * prior.sum(axis=1, keepdims=True)))
    emit = np.array([[row.get(s, -1e6) for s in speakers] for row in pdf["scores"]])
    for i, label in enumerate(pdf["label"]):
        if isinstance(label, str) and label in speakers:
            emit[i] = -1e6
            emit[i, speakers.index(label)] = 0.0
    score, back = emit[0], []
    for e in emit[1:]:
        step = score[:, None] + move
        back.append(step.argmax(axis=0))
        score = step.max(axis=0) + e
    path = [int(score.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return pd.DataFrame({"uid": pdf["uid"].to_numpy(), "speaker": [speakers[i] for i in reversed(path)], "inner": pdf["inner"].to_numpy()})


def by_markov_model(said: DataFrame) -> DataFrame:
    """(uid, speaker) for segments of recordings without diarization; labelled segments keep their label."""
    need = said.groupBy("recording_id").agg(F.count_if(F.col("label").isNull()).alias("_open"), F.count("label").alias("_named")).filter("_open > 0 AND _named > 0").select("recording_id")
    rows = said.join(need, "recording_id")
    tokens = rows.select("recording_id", "uid", "label", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}]+)"), 1)).alias("word"))
    profile = tokens.filter("label IS NOT NULL").groupBy("recording_id", "label", "word").count()
    totals = profile.groupBy("recording_id", F.col("label").alias("speaker")).agg(F.sum("count").alias("total"))
    vocabulary = profile.groupBy("recording_id").agg((F.countDistinct("word") + 1).alias("v"))
    known = profile.select("recording_id", F.col("label").alias("speaker"), "word", "count")
    open_words = tokens.filter("label IS NULL").select("recording_id", "uid", "word")
    hits = open_words.join(totals, "recording_id").join(known, ["recording_id", "speaker", "word"], "left").join(vocabulary, "recording_id")
    scored = hits.groupBy("uid", "speaker").agg(F.sum(F.log((F.coalesce("count", F.lit(0)) + 1) / (F.col("total") + F.col("v")))).alias("score"))
    open_scores = scored.groupBy("uid").agg(F.map_from_entries(F.collect_list(F.struct("speaker", "score"))).alias("scores"))
    fixed = F.when(F.col("label").isNotNull(), F.create_map("label", F.lit(0.0)))
    seq = in_order(rows, "label").withColumn("_same", F.when(F.col("before").isNotNull() & F.col("label").isNotNull(), (F.col("before") == F.col("label")).cast("int")))
    stays = seq.groupBy("recording_id").agg(((F.coalesce(F.sum("_same"), F.lit(0)) + 1) / (F.count("_same") + 2)).alias("stay"))
    moved = seq.filter("_same IS NOT NULL").groupBy("recording_id", F.concat_ws(">", "before", "label").alias("move")).count()
    stays = stays.join(moved.groupBy("recording_id").agg(F.map_from_entries(F.collect_list(F.struct("move", "count"))).alias("moves")), "recording_id", "left")
    stretch = F.floor(F.col("_row") / STRETCH)
    at = F.col("_row") % STRETCH
    placed = seq.join(open_scores, "uid", "left").withColumn("scores", F.coalesce(fixed, "scores")).join(stays, "recording_id")
    spread = F.array_compact(F.array(F.struct(stretch.alias("stretch"), F.lit(True).alias("inner")), F.when((at < MARGIN) & (stretch > 0), F.struct((stretch - 1).alias("stretch"), F.lit(False).alias("inner"))), F.when(at >= STRETCH - MARGIN, F.struct((stretch + 1).alias("stretch"), F.lit(False).alias("inner")))))
    cut = placed.select("recording_id", "uid", "start_sec", "seg_index", "label", "scores", "stay", "moves", F.inline(spread)).withColumn("scores", F.coalesce("scores", F.create_map().cast("map<string,double>")))
    decoded = cut.groupBy("recording_id", "stretch").applyInPandas(_decoded, "uid long, speaker string, inner boolean")
    return decoded.filter("inner").select("uid", "speaker")


def turns_of_segments(segments: DataFrame, diarization: DataFrame) -> DataFrame:
    """(recording_id, seg_index, start_sec, end_sec, text, turn_no, speaker_no) of every segment with a word."""
    said, _ = written(spoken(segments), "spoken")  # read by several branches: cleaned once
    diar = diarization.select("recording_id", key_column(F.col("speaker")).alias("speaker"), F.col("start_sec").cast("double").alias("start_sec"), F.col("end_sec").cast("double").alias("end_sec")).filter("speaker IS NOT NULL AND start_sec IS NOT NULL").distinct()
    diar, _ = written(diar, "diarization")
    covered = diar.select("recording_id").distinct()
    heard = said.join(covered, "recording_id", "left_semi")
    alone = said.join(covered, "recording_id", "left_anti")
    longest = by_overlap(heard, diar)
    rest = heard.join(longest, "uid", "left_anti")
    nearest = by_distance(rest, diar.join(rest.select("recording_id").distinct(), "recording_id", "left_semi"))
    own = alone.filter("label IS NOT NULL").select("uid", F.col("label").alias("speaker"))
    guessed = by_markov_model(alone).join(own.select("uid"), "uid", "left_anti")
    guessed, _ = written(guessed, "guessed")
    speakers = longest.unionByName(nearest).unionByName(own).unionByName(guessed)
    rows = said.drop("label").join(speakers, "uid", "left").withColumn("speaker", F.coalesce("speaker", F.lit("?")))
    rows, _ = written(in_order(rows, "speaker").withColumn("_c", (~F.col("before").eqNullSafe(F.col("speaker"))).cast("int")), "ordered")
    turned = running_sum(rows, "_c", "turn_no")
    first = turned.groupBy("recording_id", "speaker").agg(F.min("turn_no").alias("_first"))
    numbered = first.withColumn("speaker_no", F.row_number().over(Window.partitionBy("recording_id").orderBy("_first"))).drop("_first")
    return turned.join(numbered, ["recording_id", "speaker"]).select("recording_id", "seg_index", "start_sec", "end_sec", "text", "turn_no", "speaker_no")


def turns(segments: DataFrame, diarization: DataFrame) -> DataFrame:
    """(recording_id, turn_no, speaker_no, start_sec, end_sec, text): one row per turn, in order."""
    rows = turns_of_segments(segments, diarization)
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start_sec", "seg_index", "text"))), lambda x: x["text"]), " ")
    return rows.groupBy("recording_id", "turn_no").agg(F.min("speaker_no").alias("speaker_no"), F.min("start_sec").alias("start_sec"), F.max("end_sec").alias("end_sec"), said.alias("text"))
