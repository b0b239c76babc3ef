"""Personal data in free text: a character-level BiLSTM-CRF finds it, typed placeholders replace it.

Every character of every text goes through the network, whatever words stand there: texts longer than WINDOW are cut
into overlapping windows, whose emissions are stitched together, each character's from the window in which it lies
farther inside. A text is decoded as a whole; the Viterbi pass leaves out only runs of characters of which the emissions
alone prove that the best path is O there. Windows are scored in batches by the network; equal texts and windows (all
digits being one symbol) are scored once.
An exact check follows: tagged e-mail addresses, numbers and ids are aligned to their full extent by a pattern of their
kind and dropped if none fits (dates, versions, order numbers); addresses and names are aligned to whole words, titles
cut off. Words that the training sample holds again and again, never inside personal data, are cut off the ends of a
name; a name made of such words alone is dropped.

The network is trained by train_personal.py on a bounded sample of spans labelled by rules and by the names in mail
headers and contact names. As no hand labels exist, its accuracy is measured against held-out labels of that kind.

Cases: null and empty texts hold nothing; equal texts of a batch are tagged once but each row is reported; very long
texts are taken whole; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import io
import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelpmill.llm import tagger

MODEL = os.path.join(os.path.dirname(__file__), "models", "personal.npz")
KINDS = ("email", "phone", "national_id", "street_address", "person_name")
TAGS = 1 + 2 * len(KINDS)  # O, then B and I of each kind
WINDOW, OVERLAP = 384, 48
ROWS = 1024  # windows that go through the network side by side
AT_ONCE = 1 << 20  # characters of texts that are scored together, a longer text by itself

GAP = r"(?:[  ]|\r?\n(?:[ \t]*[>|])*[ \t]*)"  # a blank, or a line end of quoted text
WORD = re.compile(r"[^\W\d_]+")
_d, _end = "0-9０-９", r"(?![0-9０-９A-Za-z_])"  # Korean endings follow numbers without a blank
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+\s?(?:@|\[at\]|\(at\))\s?[A-Za-z0-9-]+(?:\s?(?:\.|\[dot\]|\(dot\))\s?[A-Za-z0-9-]+)+|[A-Za-z0-9_+%-]+(?: \[dot\] [A-Za-z0-9_+%-]+)* \[at\] [A-Za-z0-9-]+(?: \[dot\] [A-Za-z0-9-]+)+", re.IGNORECASE)
_n = r"[.\-–—/]|" + GAP
PHONE = re.compile(rf"(?<![{_d}A-Za-z_.\-–])(?:(?:\+|00|＋)[{_d}]{{1,3}}(?:{_n})?(?:[(（][0０][)）](?:{_n})?)?[{_d}]{{1,5}}|[(（][{_d}]{{2,4}}[)）]|[{_d}]{{2,5}})(?:(?:{_n})?[{_d}]{{2,8}}){{1,5}}{_end}(?![.\-–][{_d}])|(?<![{_d}A-Za-z_.\-–])(?:\+[{_d}]{{9,15}}|[0０][{_d}]{{8,12}}){_end}")
NATIONAL_ID = re.compile(rf"(?<![{_d}A-Za-z_])(?:[{_d}]{{2}}(?:[0０][1-9１-９]|[1１][0-2０-２])(?:[0０][1-9１-９]|[12１２][{_d}]|[3３][01０１])[ \-–]?[1-8１-８][{_d}]{{6}}|[A-Za-z]{{2}}(?:\s?[{_d}]{{2}}){{3}}\s?[A-Da-d]|[{_d}]{{3}}-[{_d}]{{2}}-[{_d}]{{4}}){_end}")
_cap = r"[A-ZÀ-ÖØ-Þ][\w’'-]*"
ADDRESS = re.compile(
    rf"(?:Flat{GAP}\d+,{GAP})?\d{{1,4}}{GAP}{_cap}(?:{GAP}{_cap})?{GAP}(?:Street|Road|Lane|Drive|Avenue|Close|Way|Court|Place|Square|Crescent|Gardens|Terrace|Hill|Row|Walk|Mews|Grove)(?:,{GAP}{_cap})?"
    rf"|(?:{_cap}{GAP})?[A-ZÄÖÜ][\wäöüß-]*(?:weg|straße|strasse|gasse|allee|platz|ring|damm|ufer|pfad|steig|stieg|hof|graben){GAP}\d{{1,4}}[a-z]?(?:,{GAP}\d{{5}}{GAP}{_cap})?"
    rf"|\d{{1,4}}(?:{GAP}?(?:bis|ter))?,?{GAP}(?:rue|avenue|impasse|place|boulevard|chemin|allée|quai|cours|passage|route|square|ruelle|sentier){GAP}[^\d\n,]{{3,40}},{GAP}\d{{5}}{GAP}{_cap}"
    rf"|(?:Calle|Avenida|Plaza|Paseo|Camino|Carrera|Ronda|Travesía|Glorieta|Callejón|C/){GAP}{_cap}(?:{GAP}{_cap})?{GAP}\d{{1,4}}(?:,{GAP}\d{{5}}{GAP}{_cap})?"
    rf"|[가-힣]{{2,5}}시{GAP}[가-힣]{{2,10}}(?:대로|로|길)(?:{GAP}\d+길)?{GAP}\d+(?:-\d+)?(?:,{GAP}\d+호)?"
)
TITLE = re.compile(r"^(?:(?:Dr|Prof|Mr|Mrs|Ms|Herr|Frau|Hr|Fr|Mme|Mlle|Sr|Sra|Don|Doña|Sir|Madame|Monsieur|Señora?|Doctor)\.?\s+)+(?=\S{3,}|\S\.)", re.IGNORECASE)
DOUBT = 4.0  # a character is in doubt if the emission of a tag comes this near to that of O
ROUNDING = 0.05  # a path must be better by this much to be certain
PLACEHOLDERS = {k: f"[{k.upper()}]" for k in KINDS}


class Screen:
    """The words of the vocabulary: they keep nothing from the network, but are no names by themselves (see align)."""

    def __init__(self, common: frozenset) -> None:
        self.common = common


def screened(text: str, screen: Screen) -> list[tuple[int, int]]:
    """Regions (start, end) of the text that are decoded: all of it."""
    return [(0, len(text))] if text else []


def windows(s: int, e: int) -> list[tuple[int, int, int, int]]:
    """(start, end, first, last) of a region: windows of at most WINDOW characters and the part whose emissions count."""
    if e - s <= WINDOW:
        return [(s, e, s, e)]
    out = []
    for at in range(s, e - OVERLAP, WINDOW - OVERLAP):
        stop = min(at + WINDOW, e)
        out.append((at, stop, at if at == s else at + OVERLAP // 2, stop if stop == e else stop - OVERLAP // 2))
        if stop == e:
            break
    return out


def _overlapping(pattern: re.Pattern, text: str, s: int, e: int, margin: int) -> re.Match | None:
    """The match nearest to (s, e) that overlaps it, whole words around it being read."""
    lo, hi = max(0, s - margin), min(len(text), e + margin)
    while lo > 0 and not text[lo - 1].isspace() and s - lo < margin + 40:
        lo -= 1
    best, most = None, 0
    for m in pattern.finditer(text, lo, hi):
        if m.start() >= e:
            break
        if (both := min(m.end(), e) - max(m.start(), s)) > most:
            best, most = m, both
    return best


def _hangul(c: str) -> bool:
    return "가" <= c <= "힣"


def align(text: str, s: int, e: int, kind: str, common: frozenset = frozenset()) -> tuple[int, int] | None:
    """The exact extent of a tagged span, or None if nothing of its kind stands there."""
    if kind == "email":
        m = _overlapping(EMAIL, text, s, e, 60)
        return m.span() if m else None
    if kind == "national_id":
        m = _overlapping(NATIONAL_ID, text, s, e, 16)
        return m.span() if m else None
    if kind == "phone":
        m = _overlapping(PHONE, text, s, e, 24)
        if not m or not 8 <= sum(c.isdigit() for c in m[0]) <= 15 or NATIONAL_ID.fullmatch(m[0]) or re.fullmatch(r"\d{4}[-./]\d\d[-./]\d\d.*|\d{1,2}[./]\d{1,2}[./]\d{4}.*|\d{5,6}-\d+", m[0]):
            return None
        s, e = m.span()
        for brk in re.finditer(r"\r?\n", m[0]):  # a whole number before a line end doesn't go on behind it
            if sum(c.isdigit() for c in m[0][: brk.start()]) >= 9:
                return s, s + brk.start()
        return s, e
    if kind == "street_address":
        m = _overlapping(ADDRESS, text, s, e, 40)
        return m.span() if m else None
    while s < e and not text[s].isalpha():
        s += 1
    while 0 < s < len(text) and text[s - 1].isalpha() and text[s].isalpha() and not _hangul(text[s - 1]) and not _hangul(text[s]):
        s -= 1
    while e > s and not (text[e - 1].isalpha() or text[e - 1] == "."):
        e -= 1
    while s < e < len(text) and text[e].isalpha() and text[e - 1].isalpha() and not _hangul(text[e]) and not _hangul(text[e - 1]):
        e += 1
    if m := TITLE.match(text[s:e]):
        s += m.end()
    tokens = [(s + m.start(), s + m.end(), m[0].lower() in common) for m in WORD.finditer(text[s:e])]
    while tokens and tokens[0][2] and len(tokens) > 1:  # words around a name that are never part of one
        tokens = tokens[1:]
        s = tokens[0][0]
    while tokens and tokens[-1][2] and len(tokens) > 1:
        tokens = tokens[:-1]
        e = tokens[-1][1]
    if not tokens or tokens[0][2]:
        return None
    name = text[s:e]
    if sum(c.isalpha() for c in name) < 2:
        return None
    return s, e


def spans_of(tags: np.ndarray, ends: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """(start, end, kind number) of runs of tags; none goes over one of the ends."""
    kind = np.where(tags > 0, (tags - 1) // 2, -1)
    fresh = np.r_[True, kind[1:] != kind[:-1]][: len(kind)]
    if ends is not None:
        fresh[ends[:-1]] = True
    fresh |= tags % 2 == 1
    change = np.r_[np.flatnonzero(fresh), len(kind)]
    k = np.flatnonzero(kind[change[:-1]] >= 0)
    return list(zip(change[k].tolist(), change[k + 1].tolist(), kind[change[k]].tolist()))


def _scored(p: dict, data: list[bytes]) -> list[np.ndarray]:
    """Emissions (characters, tags) of each window of symbols."""
    sizes = [len(d) // 2 for d in data]
    out: list = [None] * len(data)
    order = sorted(range(len(data)), key=sizes.__getitem__, reverse=True)
    room = np.zeros(max(sizes, default=0) * min(len(order), ROWS) * (2 * p["Uf"].shape[0] + 1), np.float32)
    for lo in range(0, len(order), ROWS):
        part = order[lo : lo + ROWS]
        lengths = np.array([sizes[k] for k in part])
        x = np.zeros((len(part), int(lengths.max())), np.int16)
        for r, k in enumerate(part):
            x[r, : sizes[k]] = np.frombuffer(data[k], np.int16)
        e = tagger.emissions(p, x, lengths, room)
        for r, k in enumerate(part):
            out[k] = e[: sizes[k], r]
    return out


def reach(a: np.ndarray) -> int | None:
    """How far from characters in doubt the best path may leave O under transitions a, or None if there is no bound.

    A character out of doubt loses DOUBT and more under another tag, and the transitions of that tag give back less than
    DOUBT - gain. So a run of them in which the path enters, leaves or stays out of O is better replaced by O once it is
    longer than these limits, whether the text goes on behind it or is cut there."""
    stay, most, to, back = a[0, 0], a[1:, 1:].max(), a[0, 1:], a[1:, 0]
    gain = DOUBT + stay - most
    if gain <= 0 or gain + most <= max(to.max(), back.max()) or gain + stay + most <= to.max() + back.max():
        return None
    through = (most + stay - back.min() - to.min()) / gain
    return 1 + int(max((back.max() - back.min()) / gain, (to.max() - to.min()) / gain, (stay - back.min()) / gain, (stay - to.min()) / gain, through / 2))


def _before(gain: np.ndarray, fresh: np.ndarray, cut: float, enter: float) -> np.ndarray:
    """What putting O in place of other tags gains at least before each character, wherever the path left O: enter if
    only just now, otherwise either what it gained one character before and the gain there, or cut if the tags further
    off are kept; 0 at the start of a region (fresh). Taken in pieces side by side, each begun with the least value."""
    n = len(gain)
    pieces = max(1, n // 512)
    long = -(-n // pieces)
    step, most = np.zeros(pieces * long, np.float32), np.full(pieces * long, enter, np.float32)
    step[1:n] = gain[:-1]
    step[:n][fresh], most[:n][fresh] = 1e9, 0
    step, most = (np.ascontiguousarray(x.reshape(pieces, long).T) for x in (step, most))
    last = np.full(pieces, min(cut, enter, 0), np.float32)
    for now, top in zip(step, most):
        now += last
        np.maximum(now, cut, out=now)
        np.minimum(now, top, out=now)
        last = now
    return step.T.reshape(-1)[:n]


def certain(e: np.ndarray, a: np.ndarray, fresh: np.ndarray) -> np.ndarray:
    """Characters of emissions e (N, K) at which every best path under transitions a is O; fresh: a region starts there.

    If the path had another tag there, it would gain by O in its place and in that of neighbours: each of them gains its
    margin over the best other tag, each step between them loses at most most - stay, and at either end the path goes
    over from O, or from another tag, or the region ends. The sum of the least gains on both sides is above 0."""
    gain = np.empty(len(e), np.float32)  # so far the margin
    for k in range(0, len(e), 4096):
        tags = np.ascontiguousarray(e[k : k + 4096].T)
        np.subtract(tags[0], tags[1:].max(axis=0), out=gain[k : k + 4096])
    stay, lost, inner = a[0, 0], a[1:, 1:].max() - a[0, 0], a[1:, 1:]
    gain -= lost
    left = _before(gain, fresh, (a[1:, 0] - inner.max(axis=1)).min(), stay - a[0, 1:].max())
    right = _before(gain[::-1], np.r_[fresh[1:], True][::-1], (a[0, 1:] - inner.max(axis=0)).min(), stay - a[1:, 0].max())[::-1]
    return left + right + gain + lost > ROUNDING


def _decoded(p: dict, e: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Tags of regions that stand one behind the other in e, ends being their ends. Only stretches of characters that are
    not certain go through the Viterbi pass, between the O on either side; everywhere else the path of the whole region
    is O (see certain)."""
    a, fresh = p["A"], np.zeros(len(e), bool)
    fresh[0], fresh[ends[:-1]] = True, True
    wide = np.ones(len(e), bool) if reach(a) is None else ~certain(e, a, fresh)  # without a reach hardly any are
    over = np.r_[fresh[1:], True]
    start = np.flatnonzero(wide & (np.r_[True, ~wide[:-1]] | fresh))
    last = np.flatnonzero(wide & (np.r_[~wide[1:], True] | over))
    sizes, part, tags = last + 1 - start, e[wide], np.zeros(len(e), np.int8)
    stop = np.cumsum(sizes)
    part[(stop - sizes)[~fresh[start]]] += a[0]
    part[(stop - 1)[~over[last]]] += a[:, 0]
    tags[wide] = tagger.paths(part, a, stop - sizes, sizes)
    return tags


def _tagged(p: dict, texts: list[str]) -> list[list[tuple[int, int, int]]]:
    """Runs of tags (start, end, kind number) in each text, of which none is empty. Every character is scored."""
    code, at, index = tagger.encode("".join(texts)).tobytes(), 0, {}
    places = []
    for text in texts:
        places.append(index.setdefault(code[2 * at : 2 * (at + len(text))], len(index)))
        at += len(text)
    cut, pieces = {}, []
    for code in index:
        for a, b, first, last in windows(0, len(code) // 2):
            pieces.append((cut.setdefault(code[2 * a : 2 * b], len(cut)), first - a, last - a))
    scores = _scored(p, list(cut))
    ends = np.cumsum([len(c) // 2 for c in index])
    tags = _decoded(p, np.concatenate([scores[k][a:b] for k, a, b in pieces]), ends)
    found, runs = [[] for _ in index], spans_of(tags, ends)
    starts = [0, *ends.tolist()]
    for k, (s, e, kind) in zip(np.searchsorted(ends, [s for s, *_ in runs], "right").tolist(), runs):
        found[k].append((s - starts[k], e - starts[k], kind))
    return [found[k] for k in places]


def tag_batch(p: dict, texts: list[str], screen: Screen) -> list[list[tuple[int, int, str]]]:
    """(start, end, kind) of the personal data in each text."""
    raw: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    group, size = [], 0
    for i, text in enumerate(texts):
        if text:
            group.append(i)
            size += len(text)
        if group and (size >= AT_ONCE or i + 1 == len(texts) or size + len(texts[i + 1]) > AT_ONCE):
            for k, found in zip(group, _tagged(p, [texts[k] for k in group])):
                raw[k] = found
            group, size = [], 0
    out = []
    for text, found in zip(texts, raw):
        exact = {}
        for s, e, kind in found:
            if fixed := align(text, s, e, KINDS[kind], screen.common):
                exact[(fixed[0], KINDS[kind])] = fixed[1]
        rows = sorted((s, e, k) for (s, k), e in exact.items())
        hard = [(s, e) for s, e, k in rows if k != "person_name"]
        out.append([r for r in rows if r[2] != "person_name" or not any(s <= r[0] < e for s, e in hard)])
    return out


def load(path: str = MODEL) -> tuple[dict, Screen]:
    with open(path, "rb") as f:
        data = np.load(io.BytesIO(f.read()), allow_pickle=False)
    p = {k: data[k].astype(np.float32) for k in data.files if k != "common"}
    return p, Screen(frozenset(data["common"].tobytes().decode("utf-8").split("\n")))


def _finder(p: dict, screen: Screen):
    def run(batches):
        for b in batches:
            ids, fields, texts = (b.column(k).to_pylist() for k in range(3))
            different = list(dict.fromkeys(t for t in texts if t))
            found = dict(zip(different, tag_batch(p, different, screen)))
            out: list[list] = [[], [], [], [], []]
            for i, f, t in zip(ids, fields, texts):
                for s, e, k in found.get(t, ()):
                    for c, v in zip(out, (f, i, s, e, k)):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.string()))], names=["field_name", "record_id", "start_char", "end_char", "kind"])

    return run


def find(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(field_name, record_id, start_char, end_char, kind) of all personal data in a column."""
    p, screen = load()
    rows = df.filter(F.col(text_col).isNotNull() & (F.col(text_col) != "")).select(F.col(id_col).cast("long").alias("id"), F.lit(text_col).alias("field"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_finder(p, screen), "field_name string, record_id long, start_char int, end_char int, kind string")


def _replacer(p: dict, screen: Screen):
    def run(batches):
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            different = list(dict.fromkeys(t for t in texts if t))
            clean = {}
            for text, found in zip(different, tag_batch(p, different, screen)):
                parts, at = [], 0
                for s, e, k in found:
                    if s >= at:
                        parts += [text[at:s], PLACEHOLDERS[k]]
                        at = e
                clean[text] = "".join(parts) + text[at:]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([clean.get(t, t) for t in texts], pa.string())], names=["record_id", "text"])

    return run


def redacted(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(record_id, text): the texts with placeholders; null stays null."""
    p, screen = load()
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(_replacer(p, screen), "record_id long, text string")
