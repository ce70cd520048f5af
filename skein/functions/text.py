"""Text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalised(text: Column) -> Column:
    """Lower case, runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(text), r"[ \t\r\n]+", " "))


def canonical_url(url: Column) -> Column:
    """Host in lower case without www. or m., and the path without a slash at its
    end: one name for the pages that differ in scheme, query or fragment only."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, r"^[A-Za-z]+://([^/?#]*)", 1)), r"^(www|m)\.", "")
    path = F.regexp_replace(F.regexp_extract(url, r"^[A-Za-z]+://[^/?#]*([^?#]*)", 1), "/+$", "")
    return F.concat(host, path)
