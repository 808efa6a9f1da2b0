"""Strata, bins and taxonomy levels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from aspectdrift import config
from aspectdrift.functions.text import nfc


def country_bloc(country: Column, forms: bool = True) -> Column:
    c = F.lower(nfc(country, forms))
    return F.when(c == config.HOME, "VN").when(c.isin(*config.WEST), "WEST").when(c.isin(*config.ASIA), "ASIA").otherwise("OTH")


def traveller_type(state: Column, forms: bool = True) -> Column:
    s = nfc(state, forms)
    return F.when(s.isin(*config.TRAVELLERS), s).otherwise("NA")


def length_bin(n_words: Column) -> Column:
    short, middle = config.LENGTH_BINS
    return F.when(n_words < short, "L0").when(n_words < middle, "L1").otherwise("L2")


def stratum(country: Column, state: Column, n_words: Column | None = None, forms: bool = True) -> Column:
    parts = [country_bloc(country, forms).alias("bloc"), traveller_type(state, forms).alias("traveller")]
    return F.struct(*parts, *([length_bin(n_words).alias("length_bin")] if n_words is not None else []))


def conf_band(conf: Column) -> Column:
    return F.when(conf < 0.6, "lo").when(conf < 0.85, "mid").otherwise("hi")


def month_number(period: Column) -> Column:
    return F.substring(period, 1, 4).cast("int") * 12 + F.substring(period, 6, 2).cast("int")


def months_apart(a: Column, b: Column) -> Column:
    return F.abs(month_number(a) - month_number(b))
