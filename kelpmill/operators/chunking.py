"""Chunking of long texts for retrieval: sections, paragraphs, sentences, greedy packing, overlap.

All sizes are characters. A text becomes sections (by headings, if wanted). A section within the target size is one
chunk as it stands; of a longer one, paragraphs that pass the maximum are cut at the end of a sentence once a quarter of
the maximum is held, and at the maximum otherwise; the segments are then packed up to the target size, and each chunk
but the first of its section repeats the end of the one before. The heading stands in front of every chunk of its section.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Target, maximum and overlap by kind of source.
LONG, CHAT, MEMORY = (2000, 4000, 100), (900, 1500, 80), (1200, 2500, 100)
BY_SOURCE = {"slack": CHAT, "discord": CHAT, "telegram": CHAT, "secretary": MEMORY, "llm-memory": MEMORY}
STRUCTURED = ("filesystem", "notion", "github", "gdrive")  # by headings only if the text shows a structure
SPACE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace() and not 0x1C <= c <= 0x1F)

ATX = re.compile(r"(#{1,6})(?!#) ?(.*)", re.DOTALL)
UNDERLINE = re.compile(r"={2,}|-{2,}")
TAGGED = [re.compile(rf"<h{n}>(.*?)</h{n}>", re.IGNORECASE) for n in range(1, 7)]
LETTERED = re.compile(r"[A-Z]\. (.*)", re.DOTALL)
NUMBERED = re.compile(r"(\d+(?:\.\d+)*)\.? (.*)", re.DOTALL | re.ASCII)
STOP = re.compile(r"[.!?。！？](?=[ \n\t])")


@dataclass(frozen=True)
class Options:
    """Sizes below 1 fall back to the defaults, a negative overlap to 0, one of the target or more to half of it."""

    target: int = 2000
    most: int = 4000
    overlap: int = 100
    headings: bool = False

    def clamped(self) -> Options:
        target = self.target if self.target > 0 else 2000
        overlap = target // 2 if self.overlap >= target else max(0, self.overlap)
        return Options(target, self.most if self.most > 0 else 4000, overlap, self.headings)


def shows_structure(text: str) -> bool:
    """A blank line anywhere, or a marked heading among the first fifty lines."""
    return "\n\n" in text or any(line.strip(SPACE).startswith("#") for line in text.split("\n", 49))


def for_source(source: str | None, text: str = "") -> Options:
    """Sizes by source; chats and memories never go by headings, structured sources if they show any."""
    sizes = BY_SOURCE.get(source or "")
    return Options(*sizes, False) if sizes else Options(*LONG, shows_structure(text) if source in STRUCTURED else True)


def heading(line: str, following: str | None) -> tuple[int, str, bool] | None:
    """(level, text, underlined) of a trimmed line that is a heading: marked, underlined, tagged or numbered."""
    if m := ATX.fullmatch(line):
        return len(m[1]), m[2].rstrip("# ").strip(SPACE), False
    if line and following is not None and UNDERLINE.fullmatch(following):
        return 1 if following[0] == "=" else 2, line, True
    for level, tag in enumerate(TAGGED, 1):
        if m := tag.search(line):
            return level, m[1].strip(SPACE), False
    if m := LETTERED.fullmatch(line):
        return 1, m[1].strip(SPACE), False
    if m := NUMBERED.fullmatch(line):
        return m[1].count(".") + 1, m[2].strip(SPACE), False
    return None


def sections(text: str) -> list[tuple[int, str, str]]:
    """(level, heading, body) in order; what stands before the first heading has level 0."""
    lines = text.split("\n")
    bare = [line.strip(SPACE) for line in lines]
    out: list[tuple[int, str, list[str]]] = [(0, "", [])]
    at = 0
    while at < len(lines):
        found = heading(bare[at], bare[at + 1] if at + 1 < len(lines) else None)
        if found is None:
            out[-1][2].append(lines[at])
        else:
            out.append((found[0], found[1], []))
            # a rule below a heading belongs to it, underlined or not
            at += at + 1 < len(lines) and bool(UNDERLINE.fullmatch(bare[at + 1])) and (found[2] or heading(bare[at + 1], bare[at + 2] if at + 2 < len(lines) else None) is None)
        at += 1
    return [(level, title, "\n".join(body)) for level, title, body in out if level or "\n".join(body).strip(SPACE)]


def sentences(paragraph: str, most: int) -> list[str]:
    """Cuts behind the first sentence end from a quarter of the maximum on, else at the maximum."""
    out, begin = [], 0
    while begin < len(paragraph):
        far = min(begin + most, len(paragraph))
        stop = STOP.search(paragraph, max(begin, begin + most // 4 - 1), min(far + 1, len(paragraph)))  # a blank behind the last place counts
        end = stop.end() if stop and stop.end() <= far else far
        out.append(paragraph[begin:end].strip(SPACE))
        begin = end
    return [s for s in out if s]


def segments(body: str, most: int) -> list[str]:
    """Paragraphs between blank lines, those beyond the maximum by sentences."""
    paragraphs = [p for p in (p.strip(SPACE) for p in body.split("\n\n")) if p]
    return [s for p in paragraphs for s in (sentences(p, most) if len(p) > most else [p])]


def packed(parts: list[str], target: int) -> list[str]:
    """Neighbours joined while they fit, a blank line counting two characters."""
    out: list[str] = []
    for p in parts:
        if out and len(out[-1]) + 2 + len(p) <= target:
            out[-1] += "\n\n" + p
        else:
            out.append(p)
    return out


def flat(body: str, o: Options) -> list[str]:
    """The chunks of one section."""
    if len(body) <= o.target:
        return [body]
    chunks = packed(segments(body, o.most), o.target)
    if not o.overlap:
        return chunks
    tails = ["", *(c[-o.overlap :].strip(SPACE) for c in chunks[:-1])]
    return [f"{t} {c}" if t else c for t, c in zip(tails, chunks)]


def split(text: str | None, options: Options) -> list[str]:
    """The chunks of a text; blank texts have none, nor have headings without a body."""
    o, text = options.clamped(), (text or "").strip(SPACE)
    if not text:
        return []
    out = []
    for level, title, body in sections(text) if o.headings else [(0, "", text)]:
        body = body.strip(SPACE)
        front = f"{'#' * level} {title}\n\n" if title else ""
        out += [front + c for c in flat(body, o)] if body else []
    return out


def _chunks(texts: pd.Series, sources: pd.Series) -> pd.Series:
    return pd.Series([split(t, for_source(s, t or "")) for t, s in zip(texts, sources)])


def chunked(docs: DataFrame) -> DataFrame:
    """(id, chunk_index, chunk, byte_size) of docs: id, source_type, content."""
    of = F.pandas_udf(_chunks, "array<string>")
    rows = docs.filter("content IS NOT NULL").select("id", F.posexplode(of("content", "source_type")).alias("chunk_index", "chunk"))
    return rows.withColumn("byte_size", F.octet_length("chunk"))


def split_message(text: str, limit: int = 2000) -> list[str]:
    """pieces of at most limit characters, cut at the last blank line, else the last blank, else hard; a text within
    the limit stays as it is."""
    out = []
    while len(text) > limit:
        at = max(text.rfind("\n\n", 0, limit), 0) or max(text.rfind(" ", 0, limit), 0)
        out.append(text[:at].strip(SPACE) if at else text[:limit])
        text = text[at or limit :].strip(SPACE)
    return out + [text] * bool(text or not out)
