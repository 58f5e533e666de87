"""Column expressions over the log of requests: what to ask for, and what an answer means."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def conditions(etag: Column, last_modified: Column, part_bytes: Column) -> Column:
    """if_none_match, if_modified_since and range of the next request, as a struct. What is there of a
    file is continued; then there are no conditions, since an unchanged file would not be sent."""
    part = F.coalesce(part_bytes, F.lit(0))
    given = lambda c: F.when((part == 0) & (F.coalesce(c, F.lit("")) != ""), c)
    return F.struct(given(etag).alias("if_none_match"), given(last_modified).alias("if_modified_since"), F.when(part > 0, F.concat(F.lit("bytes="), part.cast("string"), F.lit("-"))).alias("range"))


def outcome(status: Column, part_bytes: Column) -> Column:
    """unchanged (304), failed (400 and above), continued (what was there goes on) or whole (a whole
    file, in whose place what was there is dropped)."""
    continued = (F.coalesce(part_bytes, F.lit(0)) > 0) & (status != 200)
    return F.when(status == 304, "unchanged").when(status >= 400, "failed").when(continued, "continued").when(status.isNotNull(), "whole")


def whole_size(content_length: Column, status: Column, part_bytes: Column) -> Column:
    """Bytes of the file: what is announced and what was there before, if it goes on; null where the
    announcement is no number."""
    number = F.when(content_length.rlike("^[0-9]+$"), content_length.try_cast("long"))
    return number + F.when(status == 200, 0).otherwise(F.coalesce(part_bytes, F.lit(0)))
