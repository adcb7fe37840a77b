"""Log timestamps as columns; zone offsets are ignored, local wall time is kept."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siltlog.functions.net import let

#: Month names as they stand in log lines, case-sensitive.
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
CLF_TIME = r"^\d{1,2}/[^/]+/\d{4}:\d{2}:\d{2}:\d{2}"


def clf_timestamp(block: Column) -> Column:
    """timestamp_ntz of a "day/Mon/year:h:m:s" block, null if there is no such time."""

    def build(p: Column) -> Column:
        month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.get(p, F.lit(1)))
        day = F.concat_ws("-", F.get(p, F.lit(2)), F.lpad(month.cast("string"), 2, "0"), F.lpad(F.get(p, F.lit(0)), 2, "0"))
        second = F.left(F.get(p, F.lit(5)), F.lit(2))
        return F.when(month > 0, F.concat(day, F.lit(" "), F.get(p, F.lit(3)), F.lit(":"), F.get(p, F.lit(4)), F.lit(":"), second).try_cast("timestamp_ntz"))

    return F.when(block.rlike(CLF_TIME), let(F.split(block, "[/:]", -1), build))


def months_before(as_of: Column, dt: Column) -> Column:
    """Calendar months from dt to as_of."""
    return 12 * (F.year(as_of) - F.year(dt)) + F.month(as_of) - F.month(dt)


def display(dt: Column) -> Column:
    return F.date_format(dt, "yyyy-MM-dd'+'HH:mm")
