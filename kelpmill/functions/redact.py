"""rule-based redaction of messages: resident numbers, telephone numbers, bank accounts, one-time codes."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

MARK = "[REDACTED]"
#: Number shapes of the country, accounts (never dates) and words beside one-time codes.
AREA = r"(?:1[016789]|2|[3-6][1-5])"
REST = r"[-. ]?\d{3,4}[-. ]?\d{4}\b"
RESIDENT = re.compile(r"\b\d{2}(\d{2})(\d{2})-(\d)\d{6}\b", re.ASCII)
NUMBERS = tuple(
    re.compile(front + REST, re.ASCII)
    for front in (r"\b(?:01[016789]|02|0[3-6][1-5])", r"\+82[-. ]?\(?0?\)?[-. ]?" + AREA, r"\b0082[-. ]?\(?0?\)?[-. ]?" + AREA, r"\b82[-. ]?" + AREA)
)
ACCOUNT = re.compile(r"\b\d{2,3}-\d{2,6}-\d{4,8}\b", re.ASCII)
KEYWORD = re.compile("인증번호|본인.{0,2}확인|verification|타인에게|otp", re.IGNORECASE)
CODE = re.compile(r"\b\d{4,8}\b", re.ASCII)
REACH = 40  # bytes on either side of a code that are searched for a keyword


def _resident(m: re.Match) -> str:
    """A resident number begins with a date and tells century and sex by 1 to 8."""
    return MARK if 1 <= int(m[1]) <= 12 and 1 <= int(m[2]) <= 31 and m[3] in "12345678" else m[0]


def redact(text: str | None) -> str | None:
    """Resident numbers, telephone numbers (national, then with country code), accounts, then codes near a keyword."""
    if not text:
        return text
    text = RESIDENT.sub(_resident, text)
    for shape in (*NUMBERS, ACCOUNT):
        text = shape.sub(MARK, text)
    if not KEYWORD.search(text):
        return text
    data, out, at, place, passed = text.encode("utf-8", "surrogatepass"), [], 0, 0, 0
    for m in CODE.finditer(text):
        place += len(text[passed : m.start()].encode("utf-8", "surrogatepass"))
        passed = m.start()
        around = data[max(0, place - REACH) : place + len(m[0]) + REACH].decode("utf-8", "replace")
        if KEYWORD.search(around):
            out += [text[at : m.start()], MARK]
            at = m.end()
    return "".join(out) + text[at:]


def _redacted(texts: pd.Series) -> pd.Series:
    return texts.map(redact)


def redacted(text: Column) -> Column:
    return F.pandas_udf(_redacted, "string")(text)
