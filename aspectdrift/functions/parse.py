"""Dates, scores and nights out of free text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from aspectdrift.functions.text import SPACE, ascii_digits

# The accepted notations, in order of precedence. Digits of any script are read as 0 to 9 before.
SPOKEN = rf"ngày{SPACE}+(\d{{1,2}}){SPACE}+tháng{SPACE}+(\d{{1,2}}){SPACE}+năm{SPACE}+(\d{{4}})"
ISO = r"(\d{4})-(\d{2})-(\d{2})"
SLASHED = r"(\d{1,2})/(\d{1,2})/(\d{4})"
SCORE = r"(\d{1,2})(?:[.,](\d))?"
SCORE_LABEL = "Đạt điểm"
NIGHTS = rf"(\d+){SPACE}*đêm"


def _group(text: Column, pattern: str, k: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, k), F.lit(""))


def review_date(raw: Column) -> Column:
    """struct(iso_date, period), null where nothing parses; months are 1 to 12 and days 1 to 31, whatever the month."""
    raw = ascii_digits(raw)
    parts = []
    for pattern, (y, m, d) in ((SPOKEN, (3, 2, 1)), (ISO, (1, 2, 3)), (SLASHED, (3, 2, 1))):
        found = F.struct(_group(raw, pattern, y).alias("y"), _group(raw, pattern, m).cast("int").alias("m"), _group(raw, pattern, d).cast("int").alias("d"))
        parts.append(F.when(raw.rlike(pattern), found))
    p = F.coalesce(*parts)
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    period = F.concat_ws("-", p["y"], two(p["m"]))
    return F.when(p["m"].between(1, 12) & p["d"].between(1, 31), F.struct(F.concat_ws("-", period, two(p["d"])).alias("iso_date"), period.alias("period")))


def score(raw: Column) -> Column:
    """Out of text: the first one or two digits with an optional decimal, if 0 to 10."""
    text = ascii_digits(F.replace(raw, F.lit(SCORE_LABEL), F.lit("")))
    value = F.concat(_group(text, SCORE, 1), F.lit("."), F.coalesce(_group(text, SCORE, 2), F.lit("0"))).try_cast("double")
    return F.when(value.between(0, 10), value)


def nights(raw: Column) -> Column:
    return _group(ascii_digits(raw), NIGHTS, 1).try_cast("int")


def review_uid(hotel: Column, iso_date: Column, line: Column) -> Column:
    return F.format_string("%s_%s_%08d", hotel.cast("string"), F.replace(iso_date, F.lit("-"), F.lit("")), line)
