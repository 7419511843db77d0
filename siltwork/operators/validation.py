"""Validators: each returns a map from field to message, empty for a valid row; a later check of a field wins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siltwork.functions.expr import EMAIL, JOB_STATUSES, STEPS, blank, valid_url

Check = tuple[str, Column, str]


def errors(checks: list[Check]) -> Column:
    """Map of the failed checks (field, holds, message)."""
    fields = list(dict.fromkeys(f for f, _, _ in checks))
    entries = []
    for field in fields:
        message = F.lit(None).cast("string")
        for f, holds, text in checks:
            if f == field:
                message = F.when(~F.coalesce(holds, F.lit(False)), F.lit(text)).otherwise(message)
        entries += [F.lit(field), message]
    return F.map_filter(F.create_map(*entries), lambda _, v: v.isNotNull())


def error_text(found: Column) -> Column:
    """The map as ``field: message`` lines in order of field."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(found)), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "; ")


def _bytes(c: Column) -> Column:
    return F.octet_length(F.coalesce(c, F.lit("")))


def collection(title: Column, description: Column, max_sources: Column) -> Column:
    return errors([
        ("title", ~blank(title), "must be provided"),
        ("title", _bytes(title) <= 200, "must not be more than 200 bytes long"),
        ("max_sources", max_sources >= 1, "must be at least 1"),
        ("max_sources", max_sources <= 100, "must not be more than 100"),
        ("description", _bytes(description) <= 5000, "must not be more than 5000 bytes long"),
    ])


def source(collection_id: Column, url: Column, kind: Column, title: Column, n_metadata: Column) -> Column:
    return errors([
        ("collection_id", collection_id > 0, "must be a positive integer"),
        ("url", ~blank(url), "must be provided"),
        ("url", (kind == "pdf") | valid_url(url), "must be a valid URL"),
        ("url", _bytes(url) <= 2000, "must not be more than 2000 bytes long"),
        ("source_type", kind.isin("web", "youtube", "pdf"), "must be web, youtube or pdf"),
        ("title", ~blank(title), "must be provided"),
        ("title", _bytes(title) <= 500, "must not be more than 500 bytes long"),
        ("metadata", n_metadata <= 20, "must not contain more than 20 keys"),
    ])


def source_status(status: Column, step: Column, permitted: list[str]) -> Column:
    return errors([
        ("status", status.isin(permitted), "invalid status"),
        ("current_step", (status != "ingesting") | F.coalesce(step.isin(STEPS), F.lit(False)), "must be a permitted step while ingesting"),
    ])


def chunk(source_id: Column, index: Column, content: Column, tokens: Column) -> Column:
    return errors([
        ("source_id", source_id > 0, "must be a positive integer"),
        ("chunk_index", index >= 0, "must not be negative"),
        ("content", ~blank(content), "must be provided"),
        ("content", _bytes(content) <= 50000, "must not be more than 50000 bytes long"),
        ("token_count", tokens >= 1, "must be at least 1"),
        ("token_count", tokens <= 2000, "must not be more than 2000"),
    ])


def job(source_id: Column, status: Column, attempts: Column, max_attempts: Column) -> Column:
    return errors([
        ("source_id", source_id > 0, "must be a positive integer"),
        ("status", status.isin(JOB_STATUSES), "invalid status"),
        ("attempts", attempts >= 0, "must not be negative"),
        ("max_attempts", max_attempts > 0, "must be greater than zero"),
    ])


def question(text: Column, top_k: Column, most: int, field: str = "query") -> Column:
    """Search (``most`` 20) or ask (10); a top_k of 0 stands for 5."""
    k = F.when(top_k == 0, 5).otherwise(top_k)
    return errors([
        (field, ~blank(text), "must be provided"),
        (field, _bytes(text) <= 2000, "must not be more than 2000 bytes long"),
        ("top_k", k >= 1, "must be at least 1"),
        ("top_k", k <= most, f"must not be more than {most}"),
    ])


def filters(page: Column, page_size: Column, sort: Column, allowed: list[str]) -> Column:
    return errors([
        ("page", page > 0, "must be greater than zero"),
        ("page", page <= 10_000_000, "must be a maximum of 10 million"),
        ("page_size", page_size > 0, "must be greater than zero"),
        ("page_size", page_size <= 100, "must be a maximum of 100"),
        ("sort", sort.isin(allowed), "invalid sort value"),
    ])


def user(name: Column, email: Column, password: Column) -> Column:
    return errors([
        ("fullname", ~blank(name), "must be provided"),
        ("fullname", _bytes(name) <= 200, "must not be more than 200 bytes long"),
        ("email", email != "", "must be provided"),
        ("email", email.rlike(EMAIL), "must be a valid email address"),
        ("password", password != "", "must be provided"),
        ("password", _bytes(password) >= 8, "must be at least 8 bytes long"),
        ("password", _bytes(password) <= 72, "must not be more than 72 bytes long"),
    ])


def token(text: Column) -> Column:
    return errors([("token", text != "", "must be provided"), ("token", _bytes(text) == 26, "must be 26 bytes long")])
