"""Quads as text and back: <quad> aspect | code | opinion | sentiment </quad>, one after another."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aspectdrift import config
from aspectdrift.functions import text

# The notation. An ampersand is escaped first and restored last, so escaping loses nothing.
OPEN, CLOSE, NULL = "<quad>", "</quad>", "NULL"
ESCAPES = (("&", "&amp;"), ("|", "&#124;"), ("<quad>", "&lt;quad&gt;"), ("</quad>", "&lt;/quad&gt;"))
PROMPT = "extract quads: "
PARSED = "array<struct<aspect_term:string,taxonomy_code:string,aspect_category:string,opinion_term:string,sentiment:string,aspect_implicit:boolean,opinion_implicit:boolean>>"


def escape(term: Column) -> Column:
    for plain, code in ESCAPES:
        term = F.replace(term, F.lit(plain), F.lit(code))
    return term


def linearize(quads: Column) -> Column:
    """quads: array of struct(aspect_term, taxonomy_code, opinion_term, sentiment). Null and empty terms are NULL."""
    term = lambda t: F.coalesce(escape(F.nullif(t, F.lit(""))), F.lit(NULL))
    one = lambda q: F.concat(F.lit(f"{OPEN} "), term(q["aspect_term"]), F.lit(" | "), q["taxonomy_code"], F.lit(" | "), term(q["opinion_term"]), F.lit(" | "), q["sentiment"], F.lit(f" {CLOSE}"))
    return F.array_join(F.transform(quads, one), " ")


def parsed(target: pa.Array, table: dict[str, str]) -> pa.Array:
    """Targets of one batch as lists of quads; see parse_linearized. Each step runs over the whole batch."""
    codes = pa.array(list(table), pa.string())
    places = lambda lists: pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
    split = pc.split_pattern(target, OPEN)
    owner = places(split)
    inside = np.append(False, owner[1:] == owner[:-1])[: len(owner)]  # what is before the first tag is no quad
    chunks, owner = split.flatten().filter(pa.array(inside)), owner[inside]
    fields = pc.split_pattern(pc.list_element(pc.split_pattern(chunks, CLOSE, max_splits=1), 0), "|")
    n = fields.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    last = np.cumsum(n) - 1
    first = last - n + 1
    values, of = pc.utf8_trim(fields.flatten(), text.SPACES), places(fields)
    known = pc.is_in(values, codes).to_numpy(zero_copy_only=False)
    own = np.flatnonzero(known & (np.arange(len(values)) != last[of]))  # codes before the last field
    at = np.zeros(len(n), np.int64)
    at[of[own]] = own
    at = np.where(n == 4, first + 1, at)
    ok = (n == 4) | (n > 4) & (np.bincount(of[own], minlength=len(n)) == 1)
    ok[ok] = known[at[ok]] & pc.is_in(values.take(pa.array(last[ok])), pa.array(config.SENTIMENTS)).to_numpy(zero_copy_only=False)
    values, owner = values.filter(pa.array(ok[of])), owner[ok]
    end = np.cumsum(n[ok])
    cuts = np.stack([end - n[ok], end - 1 - (last - at)[ok], end - (last - at)[ok], end - 1], axis=1).ravel()  # the quad's terms lie around its code and end before its sentiment
    parts = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(cuts, len(values)), pa.int32()), values), " | ")
    a, c, o, s = (parts.take(pa.array(np.arange(i, len(parts), 4))) for i in range(4))
    a, o = (pc.utf8_trim(t, " ") for t in (a, o))
    for plain, code in reversed(ESCAPES):
        a, o = (pc.replace_substring(t, code, plain) for t in (a, o))
    whole = pc.and_(pc.not_equal(a, ""), pc.not_equal(o, ""))
    a, c, o, s = (t.filter(whole) for t in (a, c, o, s))
    counts = np.bincount(owner[whole.to_numpy(zero_copy_only=False)], minlength=len(target))
    category = pa.array(list(table.values()), pa.string()).take(pc.index_in(c, codes))
    empty = [pc.equal(t, NULL) for t in (a, o)]
    term = lambda t, e: pc.if_else(e, pa.scalar(None, pa.string()), t)
    quads = pa.StructArray.from_arrays([term(a, empty[0]), c, category, term(o, empty[1]), s, *empty], ["aspect_term", "taxonomy_code", "aspect_category", "opinion_term", "sentiment", "aspect_implicit", "opinion_implicit"])
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), quads)


def parse_linearized(target: Column, taxonomy: dict[str, str] | None = None) -> Column:
    """Array of parsed quads, in order; malformed ones are left out.

    Four fields are read by position. With more, a raw bar is inside a term: the sentiment is the last
    field, the code the only field of the taxonomy before it, and the terms are what lies around it.
    Read in Arrow batches: as column functions every field is a string of its own, trimmed and searched one by one.
    """
    table = taxonomy or config.code_to_category()

    @F.arrow_udf(PARSED)
    def read(batch: pa.Array) -> pa.Array:
        return parsed(batch.cast(pa.string()), table)

    return read(F.make_valid_utf8(target.cast("string")))


def training_rows(segments: DataFrame) -> DataFrame:
    """segments(instance_id, source_review_id, text, quads[, review_date]) -> input, target and count."""
    date = F.coalesce("review_date", F.lit("")) if "review_date" in segments.columns else F.lit("")
    return segments.select("instance_id", "source_review_id", date.alias("review_date"), F.concat(F.lit(PROMPT), "text").alias("input"), linearize(F.col("quads")).alias("target"), F.size("quads").alias("n_quads"))


def dated(segments: DataFrame, meta: DataFrame) -> DataFrame:
    """segments with the review_date of their review, empty where meta(source_review_id, review_date) has none."""
    dates = meta.groupBy("source_review_id").agg(F.max("review_date").alias("review_date"))
    return segments.join(dates, "source_review_id", "left").withColumn("review_date", F.coalesce("review_date", F.lit("")))


def data_report(rows: DataFrame, by: str = "split") -> DataFrame:
    """(split, segments, quads, mismatches): rows(split, n_quads, n_parsed) counted; a mismatch is a target that doesn't read back."""
    return rows.groupBy(by).agg(F.count("*").alias("segments"), F.sum("n_quads").cast("long").alias("quads"), F.count_if(F.col("n_quads") != F.col("n_parsed")).alias("mismatches"))


def chronological(parts: list[DataFrame], last_train: str, first_test: str) -> DataFrame:
    """The training parts put together, each row in train, test, undated or between by its date; the test part isn't touched."""
    return time_split(reduce(DataFrame.unionByName, parts), last_train, first_test)


def time_split(rows: DataFrame, last_train: str, first_test: str) -> DataFrame:
    """Adds part: train up to a month, test from a month on, undated, or between."""
    month = F.substring("review_date", 1, 7)
    part = F.when(F.coalesce(F.col("review_date"), F.lit("")) == "", "undated").when(month <= last_train, "train").when(month >= first_test, "test").otherwise("between")
    return rows.withColumn("part", part)


def round_trip(segments: DataFrame, taxonomy: dict[str, str] | None = None) -> DataFrame:
    """(n_quads, n_parsed): counted over all segments; equal if the codec loses nothing."""
    rows = segments.select(F.size("quads").alias("n"), F.size(parse_linearized(linearize(F.col("quads")), taxonomy)).alias("p"))
    return rows.agg(F.sum("n").alias("n_quads"), F.sum("p").alias("n_parsed"))
