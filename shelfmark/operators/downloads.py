"""Media bytes in landed responses of a browser service, which carry them as base64 in several places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.payloads import base64_bytes, content_type, looks_like_html
from ..functions.text import bound

#: Bytes below which a download is none.
LEAST_BYTES = 64
#: The type of bytes that no signature tells.
OTHER = "application/octet-stream"


def encoded_payload(body: Column) -> Column:
    """The base64 text that a response holds: of its (first) download, or else the response itself if it says so; null if there is none."""

    def held(whole: Column) -> Column:
        text = lambda path: F.try_variant_get(whole, path, "string")
        data = F.coalesce(*[text(f"$.solution.download{at}.{name}") for at in ("[0]", "") for name in ("data", "encoded_data")])
        response = F.when(text("$.solution.responseEncoding") == "base64", text("$.solution.response"))
        return F.coalesce(F.nullif(data, F.lit("")), F.nullif(response, F.lit("")))

    return bound(F.try_parse_json(body), held)


def downloads(responses: DataFrame, body_col: str = "body", least_bytes: int = LEAST_BYTES) -> DataFrame:
    """``responses`` without their body, with content, content_type and outcome.

    The outcome is ``ok``; ``html`` for a page in a file's place; ``short`` for fewer bytes than asked; ``missing`` where there is no payload.
    Content and type are null unless it is ok. Columns of these names are replaced.
    """
    rest = [c for c in responses.columns if c not in (body_col, "content", "content_type", "outcome")]
    found = responses.select(*[F.col(f"`{c}`") for c in rest], base64_bytes(encoded_payload(F.col(body_col))).alias("content"))
    raw = F.col("content")
    outcome = F.when(raw.isNull(), "missing").when(looks_like_html(raw), "html").when(F.octet_length(raw) < least_bytes, "short").otherwise("ok")
    told = found.withColumn("outcome", outcome)
    ok = F.col("outcome") == "ok"
    return told.select(*[F.col(f"`{c}`") for c in rest], F.when(ok, raw).alias("content"), F.when(ok, F.coalesce(content_type(raw), F.lit(OTHER))).alias("content_type"), "outcome")
