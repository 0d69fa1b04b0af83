"""Classification of failures, response codes and content types."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Kinds of failure that go straight to a category.
DIRECT = {
    "server_http": "HTTP_5xx", "other_http": "HTTP_OtherStatus", "robots": "Policy_Robots", "scope": "Policy_Scope", "max_depth": "Policy_MaxDepth", "selector": "Content_SelectorNotFound",
    "markdown": "Content_Markdown", "database": "Database_Other", "semaphore_timeout": "Resource_SemaphoreTimeout", "request_creation": "Internal_RequestCreation", "body_read": "Network_BodyRead",
    "config": "Config_Validation", "non_html": "Content_NonHTML", "canceled": "System_ContextCanceled",
}
#: Text in a message (lower case), in order, for failures without a kind of their own.
BY_MESSAGE = [
    ("timeout", "Network_TimeoutGeneric"), ("connection refused", "Network_ConnectionRefused"), ("no such host", "Network_DNSLookup"), ("tls", "Network_TLS"), ("certificate", "Network_TLS"),
    ("reset by peer", "Network_ConnectionReset"), ("broken pipe", "Network_BrokenPipe"),
]


def _has(text: Column, *parts: str) -> Column:
    found = F.lit(False)
    for p in parts:
        found = found | F.contains(text, F.lit(p))
    return found


def category(kind: Column, message: Column, cause: Column | None = None) -> Column:
    """Category of a failure from its kind, message and (after retries) the kind of its cause.

    A null kind with a null message is no failure.  ``cause`` is null where
    the cause of exhausted retries is not known, as for pages; pictures know it.
    """
    cause = F.lit(None).cast("string") if cause is None else cause
    m = F.coalesce(message, F.lit(""))
    low = F.lower(m)
    retried = (
        F.when(cause.isNull(), "RetryFailed_Unknown")
        .when(cause == "server_http", "RetryFailed_HTTPServer")
        .when(cause == "client_http", "RetryFailed_HTTPClient")
        .when(_has(m, "timeout", "Timeout", "deadline exceeded") | (cause == "net_timeout"), "RetryFailed_NetworkTimeout")
        .when(_has(m, "connection refused"), "RetryFailed_ConnectionRefused")
        .when(_has(m, "no such host"), "RetryFailed_DNSLookup")
        .otherwise("RetryFailed_NetworkOther")
    )
    client = F.lit("HTTP_4xx")
    for code in (429, 401, 403, 404):
        client = F.when(_has(m, f" {code} "), f"HTTP_{code}").otherwise(client)
    parsing = F.lit("Content_ParsingOther")
    for what in ("XML", "JSON", "HTML", "URL"):
        parsing = F.when(_has(m, what), f"Content_Parsing{what}").otherwise(parsing)
    file = F.when(cause == "permission", "Filesystem_Permission").when(cause == "not_exist", "Filesystem_NotExist").when(cause == "exist", "Filesystem_Exist").otherwise("Filesystem_Other")
    out = F.when(kind.isNull() & message.isNull(), "None").when(kind == "retry_failed", retried).when(kind == "client_http", client).when(kind == "parsing", parsing).when(kind == "filesystem", file)
    for name, label in DIRECT.items():
        out = out.when(kind == name, label)
    out = out.when(kind == "deadline", F.when(_has(m, "semaphore"), "Resource_SemaphoreTimeout").otherwise("System_ContextDeadlineExceeded"))
    out = out.when(kind == "net_timeout", "Network_Timeout")
    for text, label in BY_MESSAGE:
        out = out.when(_has(low, text), label)
    return out.otherwise("Unknown")


def response_verdict(status: Column) -> Column:
    """What to do with a response code: ok, retry or fail."""
    return F.when(status.between(200, 299), "ok").when((status >= 500) | (status == 429), "retry").otherwise("fail")


def content_verdict(content_type: Column) -> Column:
    """html, reject, or warn for types that are let through unseen."""
    t = F.lower(F.coalesce(content_type, F.lit("")))
    html = _has(t, "text/html", "application/xhtml+xml")
    rejected = F.lit(False)
    for p in ("image/", "audio/", "video/", "font/", "application/zip", "application/gzip", "application/pdf", "application/octet-stream"):
        rejected = rejected | t.startswith(p)
    return F.when(html, "html").when(rejected, "reject").otherwise("warn")


def size_verdict(declared: Column, received: Column, most: Column) -> Column:
    """Whether a picture is within its limit (0: none).

    A declared length above the limit fails at once.  A body that fills the
    limit exactly counts as too long unless its declared length says otherwise.
    """
    limited = most > 0
    over = received > most
    edge = (received == most) & ~F.coalesce((declared >= 0) & (declared <= most), F.lit(False))
    return F.when(limited & F.coalesce(declared > most, F.lit(False)), "too_large_declared").when(limited & (over | edge), "too_large").otherwise("ok")
