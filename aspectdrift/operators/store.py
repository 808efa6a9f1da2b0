"""Raw reviews to the review store: parsing, window, first-wins deduplication, leak flags, cohorts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from aspectdrift import config
from aspectdrift.functions import parse, strata, text

#: So many leading characters of a normalised text make its leak key.
LEAK_CHARS = 120


def first_wins(rows: DataFrame, key: Column, *order: str) -> DataFrame:
    """Adds is_first: the row of each key that comes first in order. Only a hash of the key is compared."""
    return rows.withColumn("is_first", F.row_number().over(Window.partitionBy(key).orderBy(*order)) == 1)


def leak_key(t: Column, forms: bool = True) -> Column:
    return text.norm_start(t, LEAK_CHARS, forms)


def flagged(pool: DataFrame, gold: DataFrame, gate: str, keys: list[Column], date: str | None = None, forms: bool = True) -> DataFrame:
    """pool with in_gold: same gate and date as a gold row, or same gate and one of the keys (null or empty ones match nothing).

    gold(gate, text[, date]). Every alternative is an equi-join on a full key that the row carries along, with a
    distinct side, so rows neither multiply nor are read twice, and no pair that shares only the gate is formed. Keys are
    made before anything moves, so whole texts travel only if pool has them; rows without a key are spread over all tasks.
    """
    known = gold.select(F.col(gate).alias("__g"), leak_key(F.col("text"), forms).alias("__k")).where("__k <> ''").distinct()
    sides = [(known, k) for k in keys]
    if date:
        sides.append((gold.where(F.col(date).isNotNull()).select(F.col(gate).alias("__g"), F.col(date).alias("__k")).distinct(), F.col(date)))
    apart = F.xxhash64(*[f.name for f in pool.schema if not isinstance(f.dataType, MapType)])
    none = [F.coalesce(key == "", F.lit(True)) for _, key in sides]
    out = pool.withColumns({f"__own{i}": F.when(~none[i], key) for i, (_, key) in enumerate(sides)})
    # A row without a key goes where its hash says; the hash is no part of a key, so it meets nothing there.
    out, marks = out.withColumn("__apart", apart), []
    for i, (side, _) in enumerate(sides):
        side = side.withColumnsRenamed({"__g": f"__g{i}", "__k": f"__k{i}"}).withColumn(f"__s{i}", F.lit(0).cast("long"))
        salt = F.when(F.col(f"__own{i}").isNull(), F.col("__apart")).otherwise(F.lit(0))
        own = F.coalesce(F.col(f"__own{i}"), F.lit(""))
        out = out.join(side, (F.col(gate) == F.col(f"__g{i}")) & (own == F.col(f"__k{i}")) & (salt == F.col(f"__s{i}")), "left")
        marks.append(F.col(f"__k{i}").isNotNull())
    return out.withColumn("in_gold", reduce(Column.__or__, marks)).select(*pool.columns, "in_gold")


def leak_flags(pool: DataFrame, gold: DataFrame, gate: str, pos: str, neg: str, date: str | None = None, forms: bool = True) -> DataFrame:
    """pool with in_gold by the leading characters of the normalised pos, neg or both, or by date."""
    rows = pool.withColumn("__pos", leak_key(F.col(pos), forms)).withColumn("__neg", leak_key(F.col(neg), forms))
    return flagged(rows, gold, gate, _leak_keys(F.col("__pos"), F.col("__neg")), date, forms).drop("__pos", "__neg")


def _leak_keys(pos: Column, neg: Column) -> list[Column]:
    """Of the starts of both texts; what is joined of them starts like the joined whole texts."""
    return [F.substring(k, 1, LEAK_CHARS) for k in (pos, neg, text.joined(pos, neg))]


def gold_sides(meta: DataFrame, splits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """meta(hotel_id, source_review_id, text[, review_date]) and splits(source_review_id, split) -> gold rows with their
    split, and (hotel_id, split) of hotels; splits are disjoint by hotel, so any of a hotel's reviews names its split."""
    one = splits.groupBy("source_review_id").agg(F.max("split").alias("split"))
    gold = meta.join(one, "source_review_id", "left")
    return gold, gold.where("split IS NOT NULL").groupBy("hotel_id").agg(F.max("split").alias("split"))


def status(reviews: DataFrame, window: tuple[str, str] = config.WINDOW, forms: bool = True) -> DataFrame:
    """reviews (with line, the order they came in) with parsed columns and status: no_date, window, dup or kept.

    The normalised texts are made once; the deduplication key is put together from them, and leak_pos and leak_neg, the
    starts that leak keys need, go along in their place.
    """
    rows = reviews.withColumn("d", parse.review_date(F.col("review_date")))
    rows = rows.withColumn("iso_date", F.col("d.iso_date")).withColumn("period", F.col("d.period")).drop("d")
    for column, raw in (("pos", "review_positive"), ("neg", "review_negative")):
        whole = F.coalesce(F.col(raw), F.lit(""))
        rows = rows.withColumn("__f", text.unicode_forms(whole) if forms else F.struct(whole.alias("nfc"), whole.alias("nfkc")))
        rows = rows.withColumn(f"text_{column}", text.trim(F.col("__f.nfc"))).withColumn(f"norm_{column}", text.words_only(F.col("__f.nfkc"))).drop("__f")
    early = F.when(F.col("iso_date").isNull(), "no_date").when(~F.col("period").between(*window), "window")
    named = text.norm_text(F.coalesce(F.col("name"), F.lit("None")), forms)
    key = F.md5(text.joined(text.norm_text(F.col("hotel_id").cast("string"), forms), named, text.words_only(F.col("iso_date")), F.col("norm_pos"), F.col("norm_neg")))
    rows = rows.withColumn("__key", key).withColumns({f"leak_{c}": F.substring(f"norm_{c}", 1, LEAK_CHARS) for c in ("pos", "neg")}).drop("norm_pos", "norm_neg")
    # Rows that left before take no part; their null keys are spread by line instead of meeting in one group.
    rows = first_wins(rows, F.when(early.isNull(), F.col("__key")).otherwise(F.concat(F.lit("line "), F.col("line").cast("string"))), "line")
    return rows.withColumn("status", F.coalesce(early, F.when(F.col("is_first"), "kept").otherwise("dup"))).drop("is_first", "__key")


def store(reviews: DataFrame, gold: DataFrame, hotel_split: DataFrame, window: tuple[str, str] = config.WINDOW, forms: bool = True) -> DataFrame:
    """The review store: one row a kept review, with strata, word count, flags and the hotel's split."""
    return stored(status(reviews, window, forms), gold, hotel_split, forms)


def stored(statuses: DataFrame, gold: DataFrame, hotel_split: DataFrame, forms: bool = True) -> DataFrame:
    """The store from rows with their status."""
    kept = statuses.where("status = 'kept'")
    kept = flagged(kept, gold, "hotel_id", _leak_keys(F.col("leak_pos"), F.col("leak_neg")), "iso_date" if "iso_date" in gold.columns else None, forms)
    kept = kept.join(hotel_split.select(F.col("hotel_id").alias("__h"), F.col("split").alias("gold_split")), F.col("hotel_id") == F.col("__h"), "left").drop("__h")
    n = text.word_count(F.concat_ws(" ", "text_pos", "text_neg"))
    photos = F.col("review_photo") if "review_photo" in kept.columns else F.lit(None).cast("map<string,string>")
    urls = F.coalesce(F.map_keys(photos), F.array().cast("array<string>"))
    stars = F.col("stars_rating").cast("double") if "stars_rating" in kept.columns else F.lit(None).cast("double")
    return kept.select(
        parse.review_uid(F.col("hotel_id"), F.col("iso_date"), F.col("line")).alias("review_uid"), "hotel_id", "iso_date", "period",
        text.empty_to_null(F.col("text_pos")).alias("text_pos"), text.empty_to_null(F.col("text_neg")).alias("text_neg"), parse.score(F.col("review_score")).alias("score"), stars.alias("stars_rating"),
        strata.country_bloc(F.col("country"), forms).alias("country_bloc"), strata.traveller_type(F.col("state"), forms).alias("traveller"), n.alias("n_words"),
        parse.nights(F.col("date")).alias("nights"), text.empty_to_null(text.nfc(F.col("room"), forms)).alias("room"), ((F.col("text_pos") != "") | (F.col("text_neg") != "")).alias("has_text"),
        (F.size(urls) > 0).alias("has_photo"), urls.alias("photo_urls"), F.get(urls, F.lit(0)).alias("first_photo"), "in_gold", "gold_split")


def counters(statuses: DataFrame) -> DataFrame:
    return statuses.groupBy("status").agg(F.count("*").alias("n"))


def report(statuses: DataFrame, rows: DataFrame) -> DataFrame:
    """One row of counters: what was read, dropped for each reason, kept, flagged and with text; from the statuses and the store."""
    n = lambda s: F.count_if(F.col("status") == s)
    lost = statuses.agg(F.count("*").alias("read"), n("no_date").alias("drop_no_date"), n("window").alias("drop_window"), n("dup").alias("drop_dup"))
    kept = rows.agg(F.count("*").alias("written"), F.count_if("in_gold").alias("flag_gold_leak"), F.count_if("has_text").alias("has_text"), F.count_if(~F.col("has_text")).alias("no_text"), F.count_distinct("hotel_id").alias("hotels"))
    return lost.crossJoin(kept)  # one row each


def hotel_counts(rows: DataFrame) -> DataFrame:
    """(hotel_id, n): kept reviews of each hotel, those flagged as gold too."""
    return rows.groupBy("hotel_id").agg(F.count("*").alias("n"))


def cohorts(counts: DataFrame, hotel_split: DataFrame, specs: dict[str, dict] = config.COHORTS) -> DataFrame:
    """(cohort, hotel_id) from counts(hotel_id, n) and hotel_split(hotel_id, split); "all hotels" is no cohort but its absence."""
    rows = hotel_split.join(counts, "hotel_id", "left").select("hotel_id", "split", F.coalesce("n", F.lit(0)).alias("n"))
    rules = [F.when((F.col("n") >= s["min_pool"]) & (F.lit(True) if s["split"] is None else F.coalesce(F.col("split") == s["split"], F.lit(False))), F.lit(name)) for name, s in specs.items()]
    return rows.select(F.explode(F.array_compact(F.array(*rules))).alias("cohort"), "hotel_id")


def units(reviews: DataFrame) -> DataFrame:
    """(review_uid, phi, text): the positive and the negative text of each review that isn't in gold; nulls are left out."""
    rows = reviews.where(~F.col("in_gold")).select("review_uid", F.expr("stack(2, 'POS', text_pos, 'NEG', text_neg) as (phi, text)"))
    return rows.where("text IS NOT NULL AND text <> ''")
