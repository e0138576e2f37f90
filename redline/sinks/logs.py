"""What may be written to a log: requests without their images."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_IMAGE = r"data:([a-z]+/[a-z0-9.+-]+);base64,([A-Za-z0-9+/=]+)"


def scrubbed(request: Column) -> Column:
    """``request`` with each base64 image replaced by its kind, length and SHA-256 of the encoded text."""
    found = F.regexp_extract_all(request, F.lit(_IMAGE), F.lit(0))
    kind = lambda x: F.regexp_extract(x, _IMAGE, 1)
    data = lambda x: F.regexp_extract(x, _IMAGE, 2)
    shown = lambda x: F.concat(F.lit("data:"), kind(x), F.lit(";length="), F.length(data(x)), F.lit(";sha256="), F.sha2(data(x).cast("binary"), 256))
    return F.aggregate(F.coalesce(found, F.array().cast("array<string>")), request, lambda acc, x: F.replace(acc, x, shown(x)))
