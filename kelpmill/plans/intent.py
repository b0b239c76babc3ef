"""Questions into search plans: time windows in local time, source types, kind of intent; validation of proposed plans."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

KST = timezone(timedelta(hours=9))
#: Words of time, source and kind.
SOURCES = {"메일": "gmail", "이메일": "gmail", "email": "gmail", "슬랙": "slack", "slack": "slack", "문자": "sms", "통화": "call-log", "노션": "notion", "일정": "calendar", "캘린더": "calendar", "깃허브": "github", "github": "github"}
KNOWN = ("slack", "gmail", "notion", "call-transcript", "filesystem", "github", "gdrive", "note", "sms", "telegram", "discord", "llm-memory", "calendar", "insight", "upload", "secretary", "call-log")


@dataclass(frozen=True)
class Plan:
    kind: str = "search"
    begin: datetime | None = None
    end: datetime | None = None
    sources: tuple[str, ...] = ()
    widened: bool = False


def _day(t: datetime) -> datetime:
    return t.replace(hour=0, minute=0, second=0, microsecond=0)


def _month(y: int, m: int) -> datetime:
    return datetime(y + (m - 1) // 12, (m - 1) % 12 + 1, 1, tzinfo=KST)


def window(question: str, now: datetime) -> tuple[datetime, datetime] | None:
    """half-open window of the first time word that fits, in UTC."""
    local = now.astimezone(KST)
    today, one = _day(local), timedelta(days=1)
    monday = today - one * today.weekday()
    pick = None
    if m := re.search(r"(\d{4})년\s*(\d{1,2})월", question):
        y, mo = int(m[1]), int(m[2])
        pick = (_month(y, mo), _month(y, mo + 1)) if 1 <= mo <= 12 else None
    elif re.search("지난 ?달|last month", question):
        pick = (_month(local.year, local.month - 1) if local.month > 1 else _month(local.year - 1, 12), _month(local.year, local.month))
    elif re.search("주말|weekend", question):
        pick = (monday + 5 * one, monday + 7 * one)
    elif re.search("다음 ?주|next week", question):
        pick = (monday + 7 * one, monday + 14 * one)
    elif re.search("이번 ?주|this week", question):
        pick = (monday, monday + 7 * one)
    elif re.search("모레|day after tomorrow", question):
        pick = (today + 2 * one, today + 3 * one)
    elif re.search("내일|tomorrow", question):
        pick = (today + one, today + 2 * one)
    elif re.search("오늘|today", question):
        pick = (today, today + one)
    elif re.search("어제|yesterday", question):
        pick = (today - one, today)
    elif re.search("지난 ?주|last week", question):
        pick = (monday - 7 * one, monday)
    elif re.search("이번 ?달|this month", question):
        pick = (_month(local.year, local.month), _month(local.year, local.month + 1))
    return tuple(t.astimezone(timezone.utc) for t in pick) if pick else None


def sources_of(question: str) -> tuple[str, ...]:
    low = question.lower()
    return tuple(dict.fromkeys(v for k, v in SOURCES.items() if k in low))


def widened(sources: tuple[str, ...]) -> tuple[tuple[str, ...], bool]:
    """P25: unknown sources and insights fall away; if only insights were asked for, all sources are."""
    known = [s for s in sources if s in KNOWN]
    kept = tuple(dict.fromkeys(s for s in known if s != "insight"))
    return kept, bool(known) and not kept


def plan(question: str, now: datetime) -> Plan:
    w = window(question, now)
    kept, wide = widened(sources_of(question))
    kind = "temporal" if w else "entity" if re.search(r"누구|who\b", question, re.IGNORECASE) else "search"
    return Plan(kind, *(w or (None, None)), kept, wide)


def checked(raw: str, question: str, now: datetime) -> Plan:
    """A proposed plan as JSON; anything wrong with it falls back to plan()."""
    fallback = plan(question, now)
    try:
        m = re.search(r"\{.*\}", raw, re.DOTALL)
        data = json.loads(m[0]) if m else None
        begin, end = (datetime.fromisoformat(data[k]) if data.get(k) else None for k in ("from", "to"))
        sources = tuple(data.get("sources") or ())
        if (begin is None) != (end is None) or begin and not end > begin or not set(sources) <= set(KNOWN):
            return fallback
        kept, wide = widened(sources)
        return Plan(str(data.get("kind") or fallback.kind), begin, end, kept, wide)
    except (ValueError, TypeError, AttributeError):
        return fallback


def standalone(question: str, history: list[tuple[str, str]], rewrite=None) -> str:
    """Unchanged without history or a rewriter, or if the rewriter gives nothing."""
    if not history or rewrite is None:
        return question
    return (rewrite(question, history) or "").strip() or question


QUERIES: dict = {}
SQL: dict[str, str] = {}
