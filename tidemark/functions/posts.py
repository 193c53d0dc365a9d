"""Post addresses, content and counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Shape of a post address and of its web page, text columns by preference.
POST_URI = r"^at://([^/]+)/app\.bsky\.feed\.post/([^/?#]+)/?(?:[?#].*)?$"
WEB_PREFIX = "https://bsky.app/profile/"
TEXT_COLUMNS = ("record_text", "content")


def _col(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def post_id(uri: Column | str) -> Column:
    """Last part of a post address, null when it is not one."""
    return F.when(_col(uri).rlike(POST_URI), F.regexp_extract(_col(uri), POST_URI, 2))


def web_url(uri: Column | str) -> Column:
    """Web page of a post, null when the address is not valid."""
    uri = _col(uri)
    return F.when(
        uri.rlike(POST_URI),
        F.concat(
            F.lit(WEB_PREFIX), F.regexp_extract(uri, POST_URI, 1), F.lit("/post/"), F.regexp_extract(uri, POST_URI, 2)
        ),
    )


def coerced_count(value: Column | str) -> Column:
    """A count, or null when the value is not one."""
    return _col(value).try_cast("long")


def content_column(df: DataFrame, candidates: Sequence[str] = TEXT_COLUMNS) -> Column:
    """The first text column the table has, else null."""
    for name in candidates:
        if name in df.columns:
            return F.col(name).cast("string")
    return F.lit(None).cast("string")
