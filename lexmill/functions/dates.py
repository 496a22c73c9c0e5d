"""Column functions over dates kept as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strict_date(c: Column) -> Column:
    """YYYY-MM-DD and a real day, else null."""
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(c, "yyyy-MM-dd"))


def overdue(due: Column, state: Column, today: Column) -> Column:
    """Open, with a readable date before today."""
    return (state == "open") & F.coalesce(due < today, F.lit(False))


def day_words(days: Column) -> Column:
    """'due today', 'due in 1 day', 'due in n days', 'n days overdue'."""
    n = F.abs(days)
    unit = F.when(n == 1, " day").otherwise(" days")
    return F.when(days == 0, "due today").when(days > 0, F.concat(F.lit("due in "), n.cast("string"), unit)).otherwise(F.concat(n.cast("string"), unit, F.lit(" overdue")))
