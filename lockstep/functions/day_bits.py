"""Sets of days as one bitmap a key.

The calendar's horizon is fixed, so all days of a security are a bitmap of a few
kilobytes, built by an aggregate that combines before its shuffle.  Questions about a
range of days become bit tests inside the row of the range: nothing is expanded by
day, and nothing but one row a key is joined.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lockstep.constants import CALENDAR_END, CALENDAR_START
from lockstep.sources.calendar import calendar_days

SPAN = (CALENDAR_END - CALENDAR_START).days + 1
#: Bits of a word, and words that hold the horizon (a bitmap aggregate has room for 32 768 bits).
WORD = 32
WORDS = -(-SPAN // WORD)

_sessions: dict[str, str] = {}


def day_number(day: Column) -> Column:
    """Days since the horizon's first one."""
    return F.datediff(day, F.lit(CALENDAR_START))


def day_at(number: Column) -> Column:
    return F.date_add(F.lit(CALENDAR_START), number)


def bitmap(number: Column) -> Column:
    """Aggregate: the bitmap of day numbers; missing ones and those outside the horizon are left out."""
    return F.bitmap_construct_agg(F.when(number.between(0, SPAN - 1), F.bitmap_bit_position(number.cast("long") + 1)))


def words(bits: Column) -> Column:
    """A bitmap as an array of whole numbers that bit tests can index."""
    return F.transform(F.sequence(F.lit(0), F.lit(WORDS - 1)), lambda k: F.conv(
        F.hex(F.substring(bits, k * 4 + 1, F.lit(4))), 16, 10).cast("long"))


def has(words_: Column, number: Column) -> Column:
    """Whether a day is in the set; false where there is no set or the day lies outside the horizon."""
    # Bytes of a word stand in reading order, bits of a byte from the lowest.
    place = F.lit(24) - (F.shiftright(number, 3) % 4) * 8 + number % 8
    return F.coalesce(F.getbit(F.get(words_, F.shiftright(number, 5)), place) == 1, F.lit(False))


def day_words(df: DataFrame, keys: list[str], days: dict[str, Column]) -> DataFrame:
    """One row per key: for each name the words of its days."""
    sets = df.groupBy(*keys).agg(*[bitmap(day_number(day)).alias(name) for name, day in days.items()])
    return sets.select(*keys, *[words(F.col(name)).alias(name) for name in days])


def session_words(spark: SparkSession) -> Column:
    """The sessions of the calendar: a constant of WORDS numbers."""
    app = spark.sparkContext.applicationId
    if app not in _sessions:
        opened = calendar_days(spark).where("is_session").agg(bitmap(day_number(F.col("day"))).alias("bits"))
        _sessions[app] = opened.select(F.array_join(words(F.col("bits")).cast("array<string>"), ",")).first()[0]
    # One literal that folds into an array, instead of an array of as many literals.
    return F.split(F.lit(_sessions[app]), ",").cast("array<bigint>")


def runs(order: Column, member) -> Column:
    """Runs (array of first, last and size) of members that follow each other in ``order``, an ascending array of days."""
    def located(places):
        starts = F.filter(places, lambda p, i: (i == 0) | (F.get(places, i - 1) < p - 1))
        ends = F.filter(places, lambda p, i: (i == F.size(places) - 1) | (F.get(places, i + 1) > p + 1))
        return F.zip_with(starts, ends, lambda s, e: F.struct(
            F.get(order, s).alias("first"), F.get(order, e).alias("last"), (e - s + 1).cast("long").alias("size")))

    inside = F.filter(F.sequence(F.lit(0), F.size(order) - 1), lambda p: member(F.get(order, p)))
    found = F.get(F.transform(F.array(inside), located), F.lit(0))
    return F.when(F.size(order) > 0, found).otherwise(F.array().cast("array<struct<first:int,last:int,size:bigint>>"))
