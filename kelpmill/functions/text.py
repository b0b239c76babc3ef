"""Text functions as column expressions; they stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORDS = r"([\p{L}\p{N}]+)"
SPLIT_SEED = "sbfeedback:v1:"  # fixed value: splits made before must stay the same


def tokens(text: Column) -> Column:
    """lower-case words of a text."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORDS), 1)


def occurrences(words: Column, token: str) -> Column:
    return F.size(F.filter(words, lambda x: x == token))


def lexical_score(title: Column, content: Column, query: list[str], title_weight: float = 1.0, content_weight: float = 0.4) -> Column:
    """damped term frequency, the title counting more than the content."""
    parts = [F.lit(title_weight) * F.log1p(occurrences(title, t)) + F.lit(content_weight) * F.log1p(occurrences(content, t)) for t in query]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return F.round(total, 6)


def matches_all(title: Column, content: Column, query: list[str]) -> Column:
    """every word of the query stands in the title or the content."""
    out = F.lit(True)
    for t in query:
        out = out & (F.array_contains(title, t) | F.array_contains(content, t))
    return out


def bigrams(text: Column) -> Column:
    """Distinct pairs of neighbouring characters of the text between blanks."""
    chars = F.split(F.concat(F.lit(" "), F.coalesce(text, F.lit("")), F.lit(" ")), "")  # read by place: linear in the text
    return F.transform(F.array(chars), lambda c: F.array_distinct(F.zip_with(F.slice(c, F.lit(1), F.size(c) - 1), F.slice(c, F.lit(2), F.size(c) - 1), lambda x, y: F.concat(x, y))))[0]


def bigram_similarity(text: Column, query: str) -> Column:
    """shared distinct bigrams over those of the larger side."""
    padded = f" {query} "
    mine = sorted({padded[i : i + 2] for i in range(len(padded) - 1)})
    whole = F.concat(F.lit(" "), F.coalesce(text, F.lit("")), F.lit(" "))
    shared = sum((whole.contains(g).cast("int") for g in mine), F.lit(0))
    return F.round(shared / F.greatest(F.size(bigrams(text)), F.lit(len(mine))), 6)


def normalized_name(name: Column) -> Column:
    """trimmed of all white space, lower case."""
    return F.lower(F.regexp_replace(name, r"(?U)^\s+|\s+$", ""))


def normalized_query(query: Column) -> Column:
    """trimmed of blanks only, lower case."""
    return F.lower(F.trim(query))


def split_of(query: Column, seed: str = SPLIT_SEED) -> Column:
    """train or holdout, by the first 32 bits of md5."""
    bucket = F.conv(F.substring(F.md5(F.concat(F.lit(seed), normalized_query(query))), 1, 8), 16, 10).cast("long") % 100
    return F.when(bucket < 70, "train").otherwise("holdout")


def query_hash(query: Column) -> Column:
    """F09."""
    return F.substring(F.md5(normalized_query(query)), 1, 8)


def short_hash(text: Column, digits: int = 16) -> Column:
    """F10."""
    return F.substring(F.sha2(text, 256), 1, digits)


def sanitized(text: Column) -> Column:
    """NUL to blank, three or more line ends to two."""
    return F.regexp_replace(F.translate(text, "\x00", " "), "\n{3,}", "\n\n")


def stripped_tags(html: Column, by: str = "") -> Column:
    """markup removed, an unclosed tag to the end of the text and stray closing signs too."""
    return F.regexp_replace(html, r"<[^>]*(>|\z)|>", by)


def base64url(text: Column) -> Column:
    """with or without padding."""
    plain = F.translate(text, "-_", "+/")
    plain = F.regexp_replace(plain, "=+$", "")
    return F.unbase64(F.concat(plain, F.repeat(F.lit("="), F.pmod(-F.length(plain), F.lit(4)).cast("int"))))


def collapsed(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\s+", " "), "^ | $", "")


def clamped(text: Column, limit: int | Column) -> Column:
    """at most limit characters; an ellipsis stands for the rest, blanks before it fall away."""
    n = F.lit(limit) if isinstance(limit, int) else limit
    cut = F.concat(F.rtrim(F.substring(text, F.lit(1), F.greatest(n - 1, F.lit(0)))), F.lit("…"))
    return F.when(n <= 0, "").when(F.length(text) <= n, text).otherwise(cut)


def shortened(text: Column, limit: int) -> Column:
    """the first limit characters, an ellipsis behind them if there are more."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("…"))).otherwise(text)


def normalized_url(url: Column) -> Column:
    """lower case, without the scheme and one final slash."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(url)), "/$", ""), "^(https://)?(http://)?", "")


def byte_prefix(text: Column, most: int | Column) -> Column:
    """The first bytes of a text, a broken last character left out; no character is changed."""
    n = F.lit(most) if isinstance(most, int) else most
    data = F.encode(text, "utf-8")
    keep = lambda k: F.substring(data, F.lit(1), k)
    whole = F.lit(None).cast("string")
    for back in (3, 2, 1, 0):  # a character has at most four bytes
        whole = F.when(F.is_valid_utf8(keep(n - back)), keep(n - back).cast("string")).otherwise(whole)
    return F.when(F.octet_length(text) <= n, text).otherwise(whole)


def truncated(text: Column, most: int) -> Column:
    """the first bytes of a text and a note that it was cut."""
    return F.when(F.octet_length(text) > most, F.concat(byte_prefix(text, most), F.lit("\n[content truncated]"))).otherwise(text)


#: Kinds of actions and their names in counts.
ACTION_KINDS = {"awaiting_my_reply": "응답 대기", "my_commitment": "내 약속", "their_commitment": "상대 약속", "scheduled": "예정"}


def action_summary(text: Column, kind: Column) -> Column:
    """normalised summary of an action, at most 80 bytes; blank for awaiting_my_reply."""
    plain = F.trim(F.regexp_replace(F.lower(collapsed(text)), r"""[.,!?;:'"()\[\]{}]""", ""))
    return F.when(kind == "awaiting_my_reply", "").otherwise(byte_prefix(plain, 80))


def identity_key(thread: Column, kind: Column, counterpart: Column, summary: Column) -> Column:
    """the same for every extraction of one action."""
    text = lambda c: F.coalesce(c, F.lit(""))
    return F.concat(F.lit("action:"), short_hash(F.concat_ws("|", text(thread), text(kind), text(counterpart), action_summary(text(summary), kind))))


#: What makes a message one of authentication, and a run of digits a code.
CODE = "(?<![0-9A-Za-z_])[0-9]{4,8}(?![0-9A-Za-z_])"
AUTH = "(?i)인증번호|본인.{0,2}확인|verification|타인에게|otp|" + CODE
REDACTED = "[REDACTED]"


def auth_like(body: Column) -> Column:
    """messages that look like authentication, every run of four to eight digits among them."""
    return F.coalesce(body.rlike(AUTH), F.lit(False))


def codes_hidden(body: Column) -> Column:
    """runs of four to eight digits replaced."""
    return F.when(auth_like(body), F.regexp_replace(body, CODE, REDACTED)).otherwise(body)


def outbound(source: Column, way: Column) -> Column:
    """F16: sent or drafted messages and outgoing calls; mail has no direction."""
    return F.coalesce(F.when(source == "sms", way.isin("sent", "draft")).when(source.isin("call-log", "call-transcript"), way == "outgoing"), F.lit(False))


def direction(msg_type: Column) -> Column:
    """F25."""
    names = {1: "received", 2: "sent", 3: "draft", 4: "outbox", 5: "failed", 6: "queued"}
    return F.coalesce(F.element_at(F.create_map(*[x for k, v in names.items() for x in (F.lit(k), F.lit(v))]), msg_type), F.lit("unknown"))


def call_kind(call_type: Column) -> Column:
    """F25."""
    names = {1: "incoming", 2: "outgoing", 3: "missed", 4: "voicemail", 5: "rejected", 6: "blocked"}
    return F.coalesce(F.element_at(F.create_map(*[x for k, v in names.items() for x in (F.lit(k), F.lit(v))]), call_type), F.lit("unknown"))


def parsed_time(text: Column) -> Column:
    """the first of several layouts that fits, else null."""
    layouts = ("yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd")
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(x)) for x in layouts])


def local_day(ts: Column, zone: str = "Asia/Seoul") -> Column:
    return F.to_date(F.from_utc_timestamp(ts, zone))


def local_range(now: Column, unit: str, zone: str = "Asia/Seoul") -> tuple[Column, Column]:
    """[from, to) of the local day, Monday-based week or month around now, in UTC."""
    start = F.date_trunc(unit, F.from_utc_timestamp(now, zone))
    step = {"day": F.expr("INTERVAL 1 DAY"), "week": F.expr("INTERVAL 7 DAY"), "month": F.expr("INTERVAL 1 MONTH")}[unit]
    return F.to_utc_timestamp(start, zone), F.to_utc_timestamp(start + step, zone)


def backoff_minutes(attempts: Column) -> Column:
    """five minutes, then doubling from two up to an hour."""
    return F.when(attempts <= 1, F.lit(5.0)).otherwise(F.least(F.lit(60.0), F.pow(F.lit(2.0), attempts - 1)))


def dead_letter(attempts: Column) -> Column:
    """the tenth failure is the last; attempts counts the failure at hand."""
    return attempts >= 10


def human_size(size: Column) -> Column:
    """in units of 1024 bytes."""
    of = lambda fmt, unit: F.format_string(fmt, size.cast("double") / F.lit(float(unit)))
    return F.when(size >= 1 << 30, of("%.1f GB", 1 << 30)).when(size >= 1 << 20, of("%.1f MB", 1 << 20)).when(size >= 1 << 10, of("%.0f KB", 1 << 10)).otherwise(F.format_string("%d B", size.cast("long")))


def safe_file_name(name: Column) -> Column:
    """runs of anything but ASCII letters, digits and hyphens become one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(name, "[^A-Za-z0-9-]+", "_"), "^_+|_+$", "")


def safe_number(number: Column) -> Column:
    """digits, plus and hyphens only; without any, 'unknown'."""
    return F.coalesce(F.nullif(F.regexp_replace(number, "[^0-9+-]", ""), F.lit("")), F.lit("unknown"))


SNOWFLAKE_EPOCH_MS = 1_420_070_400_000  # fixed value


def snowflake(ts: Column) -> Column:
    """the least message id of a time; blank for no time and times up to the epoch."""
    ms = F.unix_millis(ts) - F.lit(SNOWFLAKE_EPOCH_MS)
    return F.when(ms > 0, F.shiftleft(ms, 22).cast("string")).otherwise("")


def without_mention(text: Column, user: str) -> Column:
    """both forms of a mention of the user removed."""
    return F.replace(F.replace(text, F.lit(f"<@{user}>"), F.lit("")), F.lit(f"<@!{user}>"), F.lit(""))


#: Hosts from which attachments of a source may be fetched again.
FETCH_HOSTS = {"discord": ("cdn.discordapp.com", "media.discordapp.net", "attachments.discordapp.net"), "slack": ("files.slack.com", "slack-files.com")}


def fetch_allowed(url: Column, source: Column) -> Column:
    """exact host of the source; unknown sources and unreadable addresses are refused."""
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    out = F.lit(False)
    for s, hosts in FETCH_HOSTS.items():
        out = out | ((F.lower(source) == s) & host.isin(*hosts))
    return F.coalesce(out, F.lit(False))


WEEKDAYS = ("일", "월", "화", "수", "목", "금", "토")  # fixed values, Sunday first


def korean_time(ts: Column, zone: str = "Asia/Seoul") -> Column:
    """local time with its weekday, or a fixed label for none."""
    local = F.from_utc_timestamp(ts, zone)
    day = F.element_at(F.array(*map(F.lit, WEEKDAYS)), F.dayofweek(local))
    return F.when(ts.isNull(), "시각 정보 없음").otherwise(F.concat(F.date_format(local, "yyyy-MM-dd("), day, F.date_format(local, ") HH:mm")))


def json_text(column: Column, path: str) -> Column:
    """P10: nested text value."""
    return F.get_json_object(column, "$." + path)


def json_has(column: Column, key: str) -> Column:
    """The key is there, even if its value is null."""
    return F.coalesce(F.array_contains(F.json_object_keys(column), key), F.lit(False))


def cosine(x: Column, y: Column) -> Column:
    """cosine similarity in double precision."""
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda s, t: s.cast("double") * t.cast("double")), F.lit(0.0), lambda s, t: s + t)
    return dot(x, y) / (F.sqrt(dot(x, x)) * F.sqrt(dot(y, y)))


def usable_vector(v: Column, dim: int) -> Column:
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(3.0e38)))
    return F.coalesce(v.isNotNull() & (F.size(v) == dim) & finite & F.exists(v, lambda x: x != 0), F.lit(False))
