"""Calendar expressions: minguo dates, service and filing periods, age."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docketry import values as V
from docketry.functions.text import ascii_digits, bind


def _day(year: Column, rest: Column) -> Column:
    """The day of a year and of what follows it, '-month-day'; null where the calendar has none."""
    return F.concat(F.lpad(year.cast("string"), 4, "0"), rest).try_cast("date")


def parse_date(text: Column) -> Column:
    """Four leading digits are a common-era year, two or three a minguo year; else null."""
    def parse(plain: Column) -> Column:
        written = F.regexp_extract(plain, V.AD_DATE_PATTERN, 0)
        # there is no year 0 of the common era
        common = F.when(~F.startswith(written, F.lit("0000")), F.regexp_replace(written, V.AD_DATE_PATTERN, "$1-$2-$3").try_cast("date"))
        year = F.regexp_extract(plain, V.ROC_DATE_PATTERN, 1).try_cast("int") + V.ROC_OFFSET
        minguo = _day(year, F.regexp_replace(F.regexp_extract(plain, V.ROC_DATE_PATTERN, 0), V.ROC_DATE_PATTERN, "-$2-$3"))
        return F.when(written != "", common).otherwise(minguo)

    # bound: several dates of a row written out in one generated method would make it too long to be compiled
    return bind(ascii_digits(text), parse)


def format_roc(day: Column) -> Column:
    return F.concat(F.lit("民國"), F.year(day) - V.ROC_OFFSET, F.lit("年"), F.month(day), F.lit("月"), F.dayofmonth(day), F.lit("日"))


def roc_year(published: Column) -> Column:
    """Minguo year of a text that starts with a four-digit year, else 0."""
    year = F.regexp_extract(F.coalesce(published, F.lit("")), r"^(\d{4})", 1)
    return F.coalesce(year.try_cast("int") - V.ROC_OFFSET, F.lit(0))


def roll_weekend(day: Column) -> Column:
    shift = F.when(F.weekday(day) == 5, 2).when(F.weekday(day) == 6, 1).otherwise(0)
    return F.date_add(day, shift)


def service_effective(service: Column, method: Column) -> Column:
    deposited = F.coalesce(F.contains(method, F.lit(V.DEPOSIT_WORD)), F.lit(False))
    return F.date_add(service, F.when(deposited, V.DEPOSIT_SERVICE_DAYS).otherwise(0))


def appeal_deadline(effective: Column) -> Column:
    return roll_weekend(F.date_add(effective, V.APPEAL_PERIOD_DAYS))


def limitation_end(act: Column) -> Column:
    """Same calendar day three years on; null for 29 February, which has no such day."""
    return F.when(act.isNotNull(), _day(F.year(act) + V.LIMITATION_YEARS, F.concat(F.lit("-"), F.month(act), F.lit("-"), F.dayofmonth(act))))


def full_years(birth: Column, at: Column) -> Column:
    before_birthday = F.struct(F.month(at), F.dayofmonth(at)) < F.struct(F.month(birth), F.dayofmonth(birth))
    return F.year(at) - F.year(birth) - before_birthday.cast("int")


def is_true(flag: Column) -> Column:
    return F.coalesce(F.lower(F.trim(flag)).isin(V.TRUE_WORDS), F.lit(False))


def date_texts(text: Column) -> Column:
    """All that is written like a date in a text, in order of appearance."""
    return F.regexp_extract_all(ascii_digits(text), F.lit(V.DATE_TOKEN_PATTERN), F.lit(0))


def written_day(raw: Column) -> Column:
    """The day of one of ``date_texts``; years up to 200 are minguo years. Null where the calendar has none."""
    year = F.regexp_extract(raw, r"^\d+", 0).try_cast("int")
    return _day(F.when(year <= 200, year + V.ROC_OFFSET).otherwise(year), F.regexp_replace(raw, r"^\d+\D+(\d+)\D+(\d+)\D*\z", "-$1-$2"))
