"""Bytes that came as text, and what they are by their beginning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bound


def base64_bytes(text: Column) -> Column:
    """The bytes of a base64 text, leniently: a data URL's head is left out, both alphabets count, other characters and what follows a padding don't.

    A last character that is no whole byte is dropped. Never an error; null for a null text.
    """
    body = F.regexp_replace(text, r"\A[^,]*,", "")
    clean = F.regexp_replace(F.translate(F.substring_index(body, "=", 1), "-_", "+/"), "[^A-Za-z0-9+/]+", "")
    whole = lambda c: F.length(c) - F.when(F.length(c) % 4 == 1, 1).otherwise(0)
    return bound(clean, lambda c: F.unbase64(F.substring(c, F.lit(1), whole(c))))


def looks_like_html(content: Column) -> Column:
    """Whether the first 64 bytes are those of a page or of a challenge."""
    return F.substring(content, 1, 64).cast("string").rlike(r"(?iU)\A[\s\x{FEFF}]*<(?:!doctype|html)|_cf_chl")


def content_type(content: Column) -> Column:
    """The type of an image by its signature: JPEG, PNG or WebP; null for anything else."""
    head = F.hex(F.substring(content, 1, 12))
    return (
        F.when(head.startswith("FFD8FF"), "image/jpeg")
        .when(head.startswith("89504E47") & (F.length(head) >= 16), "image/png")
        .when(head.startswith("52494646") & head.endswith("57454250") & (F.length(head) == 24), "image/webp")
    )
