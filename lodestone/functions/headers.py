"""Mail headers and bodies: the few functions that need Python's mail parser, Arrow-batched."""

from __future__ import annotations

import email
import email.header
import email.utils
import html
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as V


def _year(value: str | None) -> int | None:
    if not value:
        return None
    try:
        return email.utils.parsedate_to_datetime(value).year
    except (TypeError, ValueError, IndexError, OverflowError):  # unreadable dates have no year
        return None


def _as_text(data: bytes, charset: str | None) -> str:
    """Bytes in a charset, UTF-8 where it is missing or unknown; bytes that do not fit are dropped."""
    try:
        return data.decode(charset or "utf-8", "ignore")
    except LookupError:
        return data.decode("utf-8", "ignore")


def _decoded(value: str | None) -> str:
    words = email.header.decode_header(value or "")
    return "".join(w if isinstance(w, str) else _as_text(w, charset) for w, charset in words).strip()


def _part_text(part, limit: int) -> str | None:
    payload = part.get_payload(decode=True)
    return _as_text(payload, part.get_content_charset())[:limit] if payload else None


def body_of(raw: str | None, limit: int = V.MAX_BODY_CHARS) -> tuple[str, str]:
    """(plain text, html) of a message: the first part of each kind that is not empty."""
    plain = markup = ""
    try:
        for part in email.message_from_string(raw or "").walk():
            kind = part.get_content_type()
            if kind == "text/plain" and not plain:
                plain = _part_text(part, limit) or ""
            elif kind == "text/html" and not markup:
                markup = _part_text(part, limit * 3) or ""
    except Exception:
        return "", ""
    return plain, markup


def _udf(function, kind: str, column) -> Column:
    """A pandas UDF made when it is used: workers import this module without a session."""
    return F.pandas_udf(function, kind)(F.col(column) if isinstance(column, str) else column)


def _years(values: pd.Series) -> pd.Series:
    return values.map(_year).astype("Int32")


def _decode_all(values: pd.Series) -> pd.Series:
    return values.map(_decoded)


def _unescape_all(values: pd.Series) -> pd.Series:
    return values.map(lambda v: html.unescape(v) if isinstance(v, str) else None)


def _bodies(values: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([body_of(v) for v in values], columns=["plain", "markup"])


def _texts(values: pd.Series) -> pd.Series:
    return values.map(lambda b: b.decode("utf-8", "ignore").replace("\r\n", "\n").replace("\r", "\n") if b is not None else None)


def year_of(column) -> Column:
    """Year of an RFC 2822 date; NULL where it cannot be read."""
    return _udf(_years, "int", column)


def decoded(column) -> Column:
    """Header with its encoded words decoded."""
    return _udf(_decode_all, "string", column)


def unescape(column) -> Column:
    """Text with its HTML entities resolved."""
    return _udf(_unescape_all, "string", column)


def bodies(column) -> Column:
    """Struct of the plain and the HTML body of a raw message."""
    return _udf(_bodies, "plain string, markup string", column)


def utf8_text(column) -> Column:
    """Bytes as text: undecodable bytes are dropped and line ends become line feeds."""
    return _udf(_texts, "string", column)


def retry_after_seconds(value: str | None, now: datetime | None = None) -> float:
    """Seconds a Retry-After header asks for: a number or a date; anything else is 0."""
    if not value:
        return 0.0
    try:
        return max(0.0, float(value))
    except ValueError:
        pass
    try:
        when = email.utils.parsedate_to_datetime(value)
        when = when if when.tzinfo else when.replace(tzinfo=timezone.utc)
        return max(0.0, (when - (now or datetime.now(timezone.utc))).total_seconds())
    except Exception:
        return 0.0
