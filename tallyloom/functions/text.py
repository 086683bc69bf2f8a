"""Text, number and time expressions: Column in, Column out; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(x: Column, use) -> Column:
    """use(x) with x evaluated, and written into the plan, once."""
    return F.get(F.transform(F.array(x), use), F.lit(0))


def trimmed(x: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def key_of(x: Column) -> Column:
    """Normal form of states and labels: trimmed and in lower case."""
    return F.lower(trimmed(x))


def non_blank(x: Column) -> Column:
    return F.coalesce(trimmed(x) != "", F.lit(False))


def blank_to_null(x: Column) -> Column:
    return F.nullif(trimmed(x), F.lit(""))


def clean_labels(x: Column) -> Column:
    """Trimmed, lower-case, non-blank, distinct labels in the order first seen."""
    labels = F.filter(F.transform(x, key_of), lambda v: v.isNotNull() & (v != ""))
    return F.coalesce(F.array_distinct(labels), F.array().cast("array<string>"))


def parse_time(x: Column) -> Column:
    """ISO-8601 instant, null if it is none; offsets as +0000 are read as +00:00."""
    fixed = F.regexp_replace(trimmed(x), r"([+-]\d{2})(\d{2})$", "$1:$2")
    dated = F.when(fixed.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}([.,]\d+)?(Z|[+-]\d{2}:\d{2})$"), fixed)
    return F.try_to_timestamp(dated)


def iso_seconds(ts: Column) -> Column:
    """Instant as ISO text, cut to seconds."""
    return F.date_format(F.date_trunc("second", ts), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def due_at(now: Column, in_ms: Column) -> Column:
    return F.timestamp_add("SECOND", F.floor(in_ms / 1000).cast("int"), now)


def elapsed_seconds(start: Column, now: Column) -> Column:
    return F.coalesce(F.greatest(F.lit(0), F.timestamp_diff("SECOND", start, now)), F.lit(0)).cast("long")


def backoff_ms(attempt: Column, cap_ms: int = 300_000, base_ms: int = 10_000) -> Column:
    """Exponential delay of a failed attempt, its power and its value capped."""
    power = F.least(F.greatest(attempt - 1, F.lit(0)), F.lit(10)).cast("int")
    return F.least(F.lit(base_ms) * F.pow(F.lit(2.0), power).cast("long"), F.lit(cap_ms)).cast("long")


def retry_delay_ms(attempt: Column, continuation: Column, cap_ms: int = 300_000) -> Column:
    return F.when(continuation & (attempt == 1), F.lit(1000).cast("long")).otherwise(backoff_ms(attempt, cap_ms))


def lenient_integer(x: Column) -> Column:
    """Leading non-negative integer of a text: `12abc` is 12."""
    return F.regexp_extract(x, r"(?U)^\s*(\+?[0-9]+|-0+(?![0-9]))", 1).try_cast("long")


def strict_integer(x: Column) -> Column:
    t = trimmed(x)
    return F.when(t.rlike(r"^[+-]?[0-9]+$"), t.try_cast("long"))


def grouped(x: Column) -> Column:
    """Integer with thousands separators."""
    return F.format_number(x, 0)


def duration_words(seconds: Column) -> Column:
    s = F.greatest(seconds, F.lit(0)).cast("long")
    return F.format_string("%dm %ds", F.floor(s / 60), s % 60)


def duration_with_turns(seconds: Column, turns: Column) -> Column:
    return F.when(turns > 0, F.concat(duration_words(seconds), F.lit(" / "), turns.cast("string"))).otherwise(duration_words(seconds))


def countdown(ms: Column) -> Column:
    m = ms.cast("long")
    return F.format_string("%d.%03ds", F.floor(m / 1000), m % 1000)


def countdown_seconds(ms: Column) -> Column:
    return F.format_string("%ds", F.ceil(ms / 1000))


def first_characters(x: Column, most: int) -> Column:
    """The first characters as a reader counts them: a letter with its marks, or a joined emoji, is one."""
    return F.regexp_extract(x, rf"^\X{{0,{most}}}", 0)


def truncated(x: Column, most: int) -> Column:
    """Cut to `most` characters with an ellipsis if the text takes more bytes than that."""
    return bound(x, lambda v: F.when(F.octet_length(v) > most, F.concat(first_characters(v, most), F.lit("..."))).otherwise(v))


def cell(x: Column, width: int, right: bool = False) -> Column:
    """Fixed-width table cell on one line: white space is one blank, and what takes more bytes than the width ends in an ellipsis."""
    one = F.coalesce(trimmed(F.regexp_replace(x, r"\s+", " ")), F.lit(""))
    cut = bound(one, lambda v: F.when(F.octet_length(v) > width, F.concat(first_characters(v, width - 3), F.lit("..."))).otherwise(v))

    def padded(v):
        blanks = F.repeat(F.lit(" "), F.greatest(F.lit(width) - F.regexp_count(v, F.lit(r"\X")), F.lit(0)))
        return F.concat(blanks, v) if right else F.concat(v, blanks)

    return bound(cut, padded)


def inline(x: Column, most: int = 80) -> Column:
    return truncated(F.trim(F.regexp_replace(x, r"\s+", " ")), most)


# Patterns of ANSI sequences and control bytes.
def without_control(x: Column) -> Column:
    """Without ANSI sequences and control bytes."""
    x = F.regexp_replace(x, "\\x1B\\[[0-9;]*[A-Za-z]", "")
    return F.regexp_replace(F.regexp_replace(x, "\\x1B.", ""), "[\\x00-\\x1F\\x7F]", "")


def error_line(x: Column) -> Column:
    """Error text on one line: real and escaped line breaks become blanks."""
    x = F.regexp_replace(x, r"\\r\\n|\\r|\\n|\r\n|\r|\n", " ")
    return truncated(F.trim(F.regexp_replace(x, r"\s+", " ")), 96)


def compact_id(x: Column) -> Column:
    return F.when(F.char_length(x) > 10, F.concat(F.substring(x, 1, 4), F.lit("..."), F.right(x, F.lit(6)))).otherwise(x)


def short_id(x: Column, most: int = 12) -> Column:
    return F.substring(x, 1, most)


def spaced_words(x: Column) -> Column:
    """camelCase, snake_case and paths as lower-case words."""
    x = F.regexp_replace(x, "([a-z0-9])([A-Z])", "$1 $2")
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(x, "[_/]", " "), r"\s+", " ")))


# The characters of a safe key, and the form of its hash.
def safe_key(x: Column) -> Column:
    """File-safe key: where unsafe characters were replaced, a hash of the original keeps keys apart."""
    safe = F.regexp_replace(x, r"[^A-Za-z0-9._-]", "_")
    return F.when(safe == x, safe).otherwise(F.concat(safe, F.lit("--"), F.substring(F.sha2(x, 256), 1, 16)))


def path_segment(x: Column) -> Column:
    """Percent-encoded path segment; a blank is %20, and ~ stays."""
    e = F.replace(F.url_encode(x), F.lit("+"), F.lit("%20"))
    return F.replace(F.replace(e, F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def jql_quoted(x: Column) -> Column:
    e = F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.concat(F.lit('"'), e, F.lit('"'))


# Eight levels of a sparkline.
BLOCKS = "▁▂▃▄▅▆▇█"


def spark_block(level: Column) -> Column:
    return F.element_at(F.array(*(F.lit(b) for b in BLOCKS)), level.cast("int") + 1)


# Words of a state's name that choose its badge.
def state_badge(state: Column) -> Column:
    s = F.lower(state)
    has = lambda *words: F.coalesce(s.rlike("|".join(words)), F.lit(False))
    return (
        F.when(has("progress", "running", "active"), "active")
        .when(has("blocked", "error", "failed"), "danger")
        .when(has("todo", "queued", "pending", "retry"), "warning")
        .otherwise("neutral")
    )


def safe_link(url: Column) -> Column:
    """The URL if it is http or https with a host, else null."""
    u = trimmed(url)
    return F.when(u.rlike(r"(?i)^https?://[^/?#\s]+([/?#]\S*)?$"), u)


def rate_text(x: Column) -> Column:
    return F.format_number(F.floor(x), 0)


# Words that make a log line a warning.
def log_severity(line: Column) -> Column:
    """warning for lines that speak of trouble, else debug."""
    return F.when(line.rlike(r"(?i)\b(error|warn|warning|failed|fatal|panic|exception)\b"), "warning").otherwise("debug")
