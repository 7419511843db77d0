"""Native column builders: vectors, text, URLs, retries and failure classes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Statuses, steps, and the codes that decide about retries.
SOURCE_STATUSES = ["pending", "ingesting", "completed", "failed", "stale"]
JOB_STATUSES = ["pending", "processing", "completed", "failed", "dead"]
STEPS = ["fetch", "clean", "chunk", "store", "embed"]
RETRYABLE_FETCH = [408, 425, 429, 500, 502, 503, 504]
RETRYABLE_EMBED = [408, 429, 500, 502, 503, 504]
PERMANENT_CLIENT = [400, 401, 403, 404, 405, 410, 422, 451]
RETRYABLE_CLIENT = [408, 409, 425, 429]
EMAIL = r"^[a-zA-Z0-9.!#$%&'*+/=?^_`{|}~-]+@[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?(?:\.[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?)*$"
YOUTUBE = r"^(https?://)?(www\.)?(youtube\.com/(watch\?v=|embed/)|youtu\.be/)[\w-]+"
MAX_RETRIES = 5


def dot(a: Column, b: Column) -> Column:
    """Sum of products in double precision, in the order of the elements."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; NaN if either vector is zero."""
    norms = F.sqrt(dot(a, a) * dot(b, b))
    return F.coalesce(1 - F.try_divide(dot(a, b), F.nullif(norms, F.lit(0.0))), F.lit(float("nan")))


def quantise(vector: Column) -> Column:
    """Components as they are after a round trip through text with six decimals."""
    return F.transform(vector, lambda x: F.format_string("%.6f", x.cast("double")).cast("float"))


def simple_tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def matches_keywords(text: Column, query: Column) -> Column:
    """All query tokens occur in the text; a query without tokens matches nothing."""
    wanted, have = simple_tokens(query), simple_tokens(text)
    return (F.size(wanted) > 0) & F.forall(wanted, lambda t: F.array_contains(have, t))


def strip(text: Column) -> Column:
    """Without Unicode white space at its ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def collapse_whitespace(text: Column) -> Column:
    """Unicode white space runs become one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def blank(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+$", "") == ""


# The line patterns of Markdown in the next three functions.


def plain_markdown(text: Column) -> Column:
    """Images out, links to their text, white space collapsed."""
    no_images = F.regexp_replace(text, r"!\[[^\]]*\]\([^)]+\)", "")
    return collapse_whitespace(F.regexp_replace(no_images, r"\[([^\]]+)\]\([^)]+\)", "$1"))


def list_item(line: Column) -> Column:
    """Text of a bulleted line, or what follows the first point and space of a numbered one; null for other lines."""
    at = F.instr(line, ". ")
    numbered = line.rlike(r"^\d+\.\s+") & (at > 0) & (at + 1 < F.length(line))
    rest = F.when(line.rlike(r"^[-*+] "), F.substring(line, 3, 1 << 30)).when(numbered, F.substring(line, at + 2, F.length(line)))
    return plain_markdown(rest)


def is_table_line(line: Column) -> Column:
    """A separator row of two columns or more, or a row between pipes with two cells or more."""
    separator = line.rlike(r"^\|?\s*:?-{3,}:?\s*(?:\|\s*:?-{3,}:?\s*)+\|?$")
    cells = F.size(F.split(F.regexp_replace(line, r"^\|+|\|+$", ""), r"\|"))
    return separator | (line.rlike(r"^\|.*\|$") & (cells >= 2))


def strip_list_marks(text: Column) -> Column:
    """Leading ``- ``, ``* ``, ``+ `` in this order, then a number with its point, each once."""
    out = strip(text)
    for mark in ("- ", "* ", "+ "):
        out = F.when(out.startswith(mark), strip(F.substring(out, 3, 1 << 30))).otherwise(out)
    return strip(F.regexp_replace(out, r"^\d+\. ", ""))


def list_items(text: Column) -> Column:
    """Items of a list text, cut at semicolons and line ends; the whole text if there is none."""
    parts = F.filter(F.transform(F.split(text, "[;\n]"), strip_list_marks), lambda x: x != "")
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(strip(text)))


def section_label(title: Column, path: Column) -> tuple[Column, Column]:
    """(title, path), each standing in for the other where blank."""
    t, p = F.nullif(F.trim(F.coalesce(title, F.lit(""))), F.lit("")), F.nullif(F.trim(F.coalesce(path, F.lit(""))), F.lit(""))
    return F.coalesce(t, p, F.lit("")), F.coalesce(p, t, F.lit(""))


def context_prefix(document: Column, section: Column) -> Column:
    """The lines that precede a chunk's text when it is embedded; empty if both are blank."""
    d, s = F.trim(F.coalesce(document, F.lit(""))), F.trim(F.coalesce(section, F.lit("")))
    lines = F.concat(F.when(d != "", F.concat(F.lit("Document: "), d, F.lit("\n"))).otherwise(""), F.when(s != "", F.concat(F.lit("Section: "), s, F.lit("\n"))).otherwise(""))
    return F.when((d == "") & (s == ""), F.lit("")).otherwise(F.concat(lines, F.lit("\n")))


def valid_url(url: Column) -> Column:
    """An absolute http or https URL with no white space or control character."""
    return F.coalesce(url.rlike(r"^(?i:https?)://[^\x00-\x20\x7f]*$") & F.expr("true"), F.lit(False))


def source_type(url: Column) -> Column:
    """'' for blank, youtube, pdf by the end of the decoded path, else web.

    A path needs no scheme before it; after a scheme it begins with a slash. Control characters, percent signs that
    escape nothing and a colon in the first part of a path without scheme make no URL.
    """
    bare = F.regexp_replace(url, r"(?s)[?#].*$", "")
    schemed = bare.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:")
    rest = F.regexp_replace(bare, r"^[a-zA-Z][a-zA-Z0-9+.-]*:", "")
    path = F.regexp_replace(rest, r"^//[^/]*", "")
    good = F.when(schemed, rest.startswith("/")).otherwise(~bare.rlike(r"^[^/]*:")) & ~url.rlike(r"[\x00-\x1f\x7f]") & ~path.rlike(r"%(?![0-9A-Fa-f]{2})")
    pdf = path.rlike(r"(?i)(\.|%2e)(p|%50|%70)(d|%44|%64)(f|%46|%66)$")
    return F.when(blank(url), "").when(url.rlike(YOUTUBE), "youtube").when(good & pdf, "pdf").otherwise("web")


def minutes(count: Column) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(0), count.cast("int"), F.lit(0))


def retry_at(as_of: Column, failures_before: Column) -> Column:
    """One minute doubled for each failure before this one."""
    return as_of + minutes(F.pow(F.lit(2), failures_before).cast("int"))


def capped_doubling(base: int, attempt: Column, most: int) -> Column:
    """``base * 2 ** (attempt - 1)``, at most ``most``; milliseconds without jitter."""
    return F.least(F.lit(float(base)) * F.pow(F.lit(2.0), F.least(attempt - 1, F.lit(16))), F.lit(float(most)))


def next_poll_wait(current: Column, base: Column, most: Column, found: Column) -> Column:
    """Waits of a queue's worker: base after work, else twice the last wait up to a maximum."""
    return F.when(found, base).when(current <= 0, most).otherwise(F.least(current * 2, most))


def retry_after_seconds(header: Column, now: Column) -> Column:
    """Seconds of a Retry-After header: a positive whole number, or an HTTP date that lies ahead, else 0."""
    text = F.trim(F.coalesce(header, F.lit("")))
    whole = F.when(text.rlike(r"^\+?\d{1,9}$"), F.expr("0") + text.cast("long"))
    stamp = F.regexp_extract(text, r"^[A-Za-z]{3}, (\d{2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2}) GMT$", 1)
    date = F.try_to_timestamp(stamp, F.lit("dd MMM yyyy HH:mm:ss"))
    ahead = F.unix_timestamp(date) - F.unix_timestamp(now)
    return F.when(whole > 0, whole).when(whole.isNull() & (ahead > 0), ahead).otherwise(F.lit(0)).cast("long")


def fetch_error(status: Column, content_type: Column, body_bytes: Column, article: Column) -> Column:
    """HTTP-like code of what is wrong with a fetched page, 0 if nothing is."""
    kind = F.lower(F.coalesce(content_type, F.lit("")))
    html = kind.contains("text/html") | kind.contains("application/xhtml+xml")
    return (
        F.when(status != 200, status)
        .when((kind != "") & ~html, 415)
        .when(body_bytes > 10 * 1024 * 1024, 413)
        .when(body_bytes == 0, 204)
        .when(article.isNull(), 502)
        .when(blank(article), 422)
        .otherwise(0)
        .cast("int")
    )


# Failures that no retry mends.
PERMANENT_KINDS = ["bad_url", "empty_content", "wrong_content_type", "no_content", "no_chunks"]


def failure_is_permanent(kind: Column, status: Column) -> Column:
    """Whether a failed source is given up: by kind of failure, then by HTTP status; unknown failures are retried."""
    client = (status >= 400) & (status < 500)
    return (
        F.when(kind.isin(PERMANENT_KINDS), True)
        .when(kind == "cancelled", False)
        .when(status.isin(PERMANENT_CLIENT), True)
        .when(status.isin(RETRYABLE_CLIENT), False)
        .when(client, True)
        .otherwise(False)
    )


def any_of(*tests: Column) -> Column:
    return reduce(lambda a, b: a | b, tests)
