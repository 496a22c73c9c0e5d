"""Court days: holidays, closed days, next open day, counted deadlines. Native dates and windows throughout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Holidays on a date (month, day, name, first year).
FIXED_DAYS = [
    (1, 1, "New Year's Day", 0), (6, 19, "Juneteenth National Independence Day", 2021), (7, 4, "Independence Day", 0),
    (11, 11, "Veterans Day", 0), (12, 25, "Christmas Day", 0),
]
#: Holidays on a weekday (month, weekday, which one or -1 for the last, name).
WEEKDAY_DAYS = [
    (1, "Mon", 3, "Birthday of Martin Luther King, Jr."), (2, "Mon", 3, "Washington's Birthday"), (5, "Mon", -1, "Memorial Day"),
    (9, "Mon", 1, "Labor Day"), (10, "Mon", 2, "Columbus Day"), (11, "Thu", 4, "Thanksgiving Day"),
]
#: Days that each kind of service adds.
SERVICE_DAYS = {"mail": 3, "clerk": 3, "consented-other": 3, "email": 0, "ecf": 0, "hand": 0, "none": 0}


def federal_holidays(spark: SparkSession, first: int, last: int) -> DataFrame:
    """(day, name, observed): legal holidays of the years, and the weekday kept for one on a weekend; a New Year's Day
    on a Saturday is kept on the last day of the year before."""
    years = spark.range(first, last + 2).select(F.col("id").cast("int").alias("y"))
    fixed = F.array(*[F.struct(F.lit(m).alias("m"), F.lit(d).alias("d"), F.lit(n).alias("name"), F.lit(y).alias("since")) for m, d, n, y in FIXED_DAYS])
    on_date = years.select("y", F.inline(fixed)).where("y >= since").select(F.make_date("y", "m", "d").alias("day"), "name")
    kept = on_date.select(
        F.when(F.weekday("day") == 5, F.date_sub("day", 1)).when(F.weekday("day") == 6, F.date_add("day", 1)).alias("day"), F.concat("name", F.lit(" (observed)")).alias("name"), F.lit(True).alias("observed")
    ).where("day is not null")
    floating = None
    for m, dow, nth, name in WEEKDAY_DAYS:
        start = F.make_date("y", F.lit(m), F.lit(1))
        day = F.next_day(F.date_sub(start, 1), dow) if nth > 0 else F.next_day(F.date_sub(F.last_day(start), 7), dow)
        one = years.select((F.date_add(day, 7 * (nth - 1)) if nth > 0 else day).alias("day"), F.lit(name).alias("name"))
        floating = one if floating is None else floating.unionByName(one)
    out = on_date.unionByName(floating).withColumn("observed", F.lit(False)).unionByName(kept)
    return out.where(F.year("day").between(first, last))


def calendar(spark: SparkSession, first: int, last: int, recorded: DataFrame | None = None) -> DataFrame:
    """A row for each day: reason (null if open), statutory_reason (without kept weekdays), next_open, next_statutory.
    recorded: (day, name, kind) of state, declared and closure days."""
    days = spark.range(1).select(F.explode(F.sequence(F.make_date(F.lit(first), F.lit(1), F.lit(1)), F.make_date(F.lit(last), F.lit(12), F.lit(31)))).alias("day"))
    named = federal_holidays(spark, first, last).groupBy("day").agg(F.min(F.when(~F.col("observed"), F.col("name"))).alias("legal"), F.min(F.when(F.col("observed"), F.col("name"))).alias("kept"))
    out = days.join(named, "day", "left")
    if recorded is not None:
        out = out.join(recorded.groupBy("day").agg(F.min(F.concat_ws(": ", "kind", "name")).alias("own")), "day", "left")
    else:
        out = out.withColumn("own", F.lit(None).cast("string"))
    weekend = F.when(F.weekday("day") >= 5, "weekend")
    out = out.select("day", F.year("day").alias("year"), F.coalesce(weekend, "legal", "kept", "own").alias("reason"), F.coalesce(weekend, "legal", "own").alias("statutory_reason"))
    # A closed run crosses a year's end at most, so windows by year look into the next year's first days too.
    both = out.withColumn("w", F.explode(F.array(F.col("year"), F.col("year") - 1))).where((F.col("w") == F.col("year")) | (F.dayofyear("day") <= 31))
    ahead = Window.partitionBy("w").orderBy("day").rowsBetween(0, Window.unboundedFollowing)
    nxt = lambda c: F.min(F.when(F.col(c).isNull(), F.col("day"))).over(ahead)
    return both.select("*", nxt("reason").alias("next_open"), nxt("statutory_reason").alias("next_statutory")).where("w = year").drop("w")


def count_deadlines(triggers: DataFrame, cal: DataFrame, years: DataFrame) -> DataFrame:
    """triggers (start date, days int, service) with due, statutory_due and refused. The trigger day isn't counted; a
    period that ends on a closed day runs to the next open one; service by mail and the like adds three days after
    that, and the rule applies again. A period of no days, an unknown service, or a day reached in a year without
    recorded state holidays (years: column year) is refused with a reason; nothing else is computed then."""
    extra = F.create_map(*[F.lit(x) for kv in SERVICE_DAYS.items() for x in kv])
    t = triggers.withColumn("_extra", extra[F.col("service")]).withColumn("_end", F.when(F.col("days") > 0, F.expr("date_add(start, days)")))
    c = F.broadcast(cal.select("day", "next_open", "next_statutory"))  # a day a row, a few thousand for decades
    for name, col in (("due", "next_open"), ("statutory_due", "next_statutory")):
        one = c.select(F.col("day").alias("_d1"), F.col(col).alias("_n1"))
        two = c.select(F.col("day").alias("_d2"), F.col(col).alias("_n2"))
        t = t.join(one, t._end == one._d1, "left").withColumn("_e", F.expr("date_add(_n1, _extra)"))
        t = t.join(two, t._e == two._d2, "left").withColumn(name, F.when(F.col("_extra") > 0, F.col("_n2")).otherwise(F.col("_n1"))).drop("_d1", "_d2", "_n1", "_n2", "_e")
    ok = F.broadcast(years.select(F.col("year").alias("_y")).distinct())
    t = t.join(ok, F.year("_end") == ok._y, "left").withColumnRenamed("_y", "_y1").join(ok, F.year("due") == ok._y, "left")
    refused = (
        F.when(F.col("days").isNull() | (F.col("days") <= 0), "days must be a whole number above 0")
        .when(F.col("_extra").isNull(), "unknown service")
        .when(F.col("_y1").isNull() | F.col("_y").isNull(), "no complete list of state holidays for a year reached")
    )
    return t.withColumn("refused", refused).withColumns({n: F.when(F.col("refused").isNull(), F.col(n)) for n in ("due", "statutory_due")}).drop("_extra", "_end", "_y", "_y1")


def reminders(deadlines: DataFrame, today: Column, days: tuple[int, ...] = (0, 1, 3, 7)) -> DataFrame:
    """Open deadlines with news: overdue, due in one of the given numbers of days, or with an unreadable date."""
    left = F.date_diff("due", today)
    news = F.when(F.col("due").isNull(), "unreadable").when(left < 0, "overdue").when(left.isin(*days), "due")
    return deadlines.where("state = 'open'").withColumn("days_left", left).withColumn("news", news).where("news is not null")


def alarms(deadlines: DataFrame, before: tuple[int, ...] = (7, 3, 1)) -> DataFrame:
    """A row for each alarm of an all-day event."""
    return deadlines.withColumn("days_before", F.explode(F.array(*[F.lit(x) for x in before]))).withColumn("alarm_on", F.expr("date_sub(due, days_before)"))
