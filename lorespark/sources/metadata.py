"""Metadata of contents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def merge_metadata(extracted: Column, user: Column) -> Column:
    """Union of two string maps; the user's value wins where both have a key."""
    own = F.coalesce(user, F.create_map().cast("map<string,string>"))
    return F.map_concat(F.map_filter(extracted, lambda k, _: ~F.map_contains_key(own, k)), own)
