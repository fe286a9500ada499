"""Words of a text, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ASCII white space, and anything else.
SPACE = r"[\x20\x09-\x0D]+"
SOLID = r"[^\x20\x09-\x0D]"


def word_count(text: Column) -> Column:
    """Runs of anything but ASCII white space; 0 for null."""
    ends = F.when(text.rlike("^" + SPACE), 1).otherwise(0) + F.when(F.substring(text, -1, 1).rlike(SPACE), 1).otherwise(0)
    return F.when(F.coalesce(text.rlike(SOLID), F.lit(False)), F.size(F.split(text, SPACE)) - ends).otherwise(0).cast("long")


def sampled(share: Column, seed: int, *columns: Column) -> Column:
    """Whether a row is in a seeded share (0 to 1) of all rows, by a hash of columns in steps of 2^-40.

    With an id among the columns, copies of one text are picked one by one, so that
    a text that a third of all rows share neither fills nor escapes a sample.
    """
    return F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(1 << 40)) < share * float(1 << 40)
