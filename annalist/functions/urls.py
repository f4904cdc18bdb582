"""Addresses as identities of pages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def page_key(url: Column) -> Column:
    """Address without scheme, fragment, leading www. and trailing slashes; host and path in lower case; utm_* parameters dropped, others by name."""
    bare = F.regexp_replace(F.regexp_replace(url, r"(?s)#.*$", ""), r"^[A-Za-z][A-Za-z0-9+.\-]*://", "")
    base = F.lower(F.substring_index(bare, "?", 1))
    base = F.regexp_replace(F.regexp_replace(base, r"^www\.", ""), r"/+$", "")
    query = F.when(F.contains(bare, F.lit("?")), F.regexp_replace(bare, r"(?s)^[^?]*\?", "")).otherwise("")
    named = F.transform(F.split(query, "&"), lambda p: F.struct(F.substring_index(p, "=", 1).alias("name"), p.alias("whole")))
    kept = F.array_sort(F.filter(named, lambda p: (p["whole"] != "") & ~F.startswith(p["name"], F.lit("utm_"))))
    params = F.array_join(F.transform(kept, lambda p: p["whole"]), "&")
    return F.when(params == "", base).otherwise(F.concat(base, F.lit("?"), params))
