"""Times without a zone, independent of the session's zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ntz_ms(at: Column) -> Column:
    """Milliseconds since 1970 of a timestamp without zone, rounded down."""
    day = F.unix_date(F.to_date(at)).cast("bigint") * 86_400_000
    return day + F.hour(at) * 3_600_000 + F.minute(at) * 60_000 + F.floor(F.extract(F.lit("SECOND"), at) * 1000).cast("bigint")
