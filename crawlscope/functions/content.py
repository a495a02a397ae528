"""Response classification expressions (FE-1..FE-5, FE-7)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed outcome messages.
MSG_REDIRECT_LIMIT = "Redirect limit exceeded"
MSG_NOT_HTML = "Response is not HTML"
MSG_TOO_LARGE = "Response exceeds size limit"
MSG_NO_CAPTURE = "No captured response"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def normalize_content_type(ct) -> Column:
    """FE-1: part before ';', trimmed, lower-cased; NULL becomes ''."""
    return F.lower(F.trim(F.substring_index(F.coalesce(_c(ct), F.lit("")), ";", 1)))


def http_status_class(status) -> Column:
    """FE-2: 300-399 redirect, >= 400 error, otherwise ok."""
    s = _c(status)
    return F.when((s >= 300) & (s < 400), "redirect").when(s >= 400, "error").otherwise("ok")


def declared_too_large(content_length, max_bytes) -> Column:
    """FE-3: finite declared length strictly above the limit (missing/NaN -> false)."""
    n = F.trim(_c(content_length)).try_cast("double")
    return F.coalesce((n > _c(max_bytes)) & ~F.isnan(n) & (F.abs(n) != float("inf")), F.lit(False))


def actual_too_large(body, max_bytes, body_bytes=None) -> Column:
    """FE-4: UTF-8 byte length strictly above the limit (equal is allowed)."""
    n = body_bytes if body_bytes is not None else F.octet_length(_c(body))
    return F.coalesce(n > _c(max_bytes), F.lit(False))


def fetch_outcome(status, content_type, content_length, body, max_bytes, error=None, body_bytes=None) -> Column:
    """FE-5 / FE-7 for a final (non-redirect) response: struct(fetch_status, message).

    Precedence: captured transport error -> http_error -> not_html ->
    too_large (declared) -> too_large (actual) -> ok.
    """
    s = _c(status)
    ct = normalize_content_type(content_type)
    err = _c(error) if error is not None else F.lit(None).cast("string")
    fs = (F.when(err.isNotNull(), "fetch_error")
          .when(s.isNull(), "fetch_error")
          .when(http_status_class(s) == "redirect", "fetch_error")
          .when(http_status_class(s) == "error", "http_error")
          .when(~ct.contains("html"), "not_html")
          .when(declared_too_large(content_length, max_bytes), "too_large")
          .when(actual_too_large(body, max_bytes, body_bytes), "too_large")
          .otherwise("ok"))
    msg = (F.when(err.isNotNull(), err)
           .when(s.isNull(), F.lit(MSG_NO_CAPTURE))
           .when(http_status_class(s) == "redirect", F.lit(MSG_REDIRECT_LIMIT))
           .when(http_status_class(s) == "error", F.concat(F.lit("HTTP "), s.cast("string")))
           .when(~ct.contains("html"), F.lit(MSG_NOT_HTML))
           .when(declared_too_large(content_length, max_bytes) | actual_too_large(body, max_bytes, body_bytes),
                 F.lit(MSG_TOO_LARGE)))
    return F.struct(fs.alias("fetch_status"), msg.alias("message"))
