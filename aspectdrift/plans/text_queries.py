"""Queries over documents and the star schema for the store, codec, evaluation, sampling and weighting operators."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aspectdrift import config
from aspectdrift.functions import parse, strata, text
from aspectdrift.operators import aggregate, codec, evaluate, inject, lexicon, posterior, reliability, sampling, selftrain, store
from aspectdrift.plans import harness, sql_parts
from aspectdrift.plans.quad_view import SQL as QUADS
from aspectdrift.plans.quad_view import quads
from aspectdrift.sources.scratch import folder, staged

QUERIES, ORACLE = {}, {}
SEED = 7
TYPES = ("STANDARD", "SMALL", "MEDIUM", "LARGE", "ECONOMY", "PROMO")
TAXONOMY = {f"{t}_{k}": t for t in TYPES for k in range(5)}
KEY = ("review_uid", "line", "part", "hotel_id")
LEXICON = {"ARTICLE": ["the", "der", "la", "le"], "LINK": ["and", "und", "et", "y"], "THIS": ["this", "dans", "con", "mit der"]}


def query(name, sql=None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return put


def _t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def _u(*key):
    return f"CAST('0x' || substr(md5('{SEED}|' || {' || '.join(f'{k}' if i == 0 else f'''chr(124) || {k}''' for i, k in enumerate(key))}), 1, 8) AS BIGINT) / 4294967296.0e0"


NORM = r"trim(regexp_replace(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"

# ---------------------------------------------------------------- store


@query("parse_dates_scores", """WITH o AS (SELECT *, o_orderkey AS k, CASE WHEN o_orderkey % 6 < 3 THEN strftime(o_orderdate, '%Y-%m-%d') END AS iso FROM orders)
SELECT k, iso AS iso_date, substr(iso, 1, 7) AS period, CASE WHEN (k % 13) + (k % 10) / 10.0e0 <= 10 THEN round((k % 13) + (k % 10) / 10.0e0, 6) END AS score, CAST(k % 30 AS BIGINT) AS nights,
  o_custkey || '_' || replace(iso, '-', '') || '_' || lpad(CAST(k AS VARCHAR), 8, '0') AS uid FROM o""")
def parse_dates_scores(spark, d):
    k, t = F.col("o_orderkey"), F.col("o_orderdate")
    gap = F.when(k % 12 == 0, "\u00a0").otherwise(" ")  # blanks of any kind count
    raw = F.when(k % 6 == 0, F.concat(F.lit("Ngày đánh giá: ngày"), gap, F.dayofmonth(t), gap, F.lit("tháng"), gap, F.month(t), gap, F.lit("năm"), gap, F.year(t))).when(k % 6 == 1, F.date_format(t, "yyyy-MM-dd"))
    raw = raw.when(k % 6 == 2, F.date_format(t, "d/M/yyyy")).when(k % 6 == 4, "ngày 40 tháng 1 năm 2020").when(k % 6 == 5, "không rõ")
    rows = _t(spark, d, "orders").select(k.alias("k"), "o_custkey", parse.review_date(raw).alias("d"), parse.score(F.concat(F.lit("Đạt điểm "), k % 13, F.lit(","), k % 10)).alias("score"),
                                         parse.nights(F.concat(k % 30, gap, F.lit("đêm · Tháng 2/2025"))).cast("long").alias("nights"))
    uid = F.when(F.col("d").isNotNull(), parse.review_uid(F.col("o_custkey"), F.col("d.iso_date"), F.col("k")))
    return rows.select("k", F.col("d.iso_date").alias("iso_date"), F.col("d.period").alias("period"), F.round("score", 6).alias("score"), "nights", uid.alias("uid"))


@query("text_norm_dedup", f"""WITH h AS (SELECT doc_id, md5({NORM.format('text')}) AS text_hash, len(regexp_extract_all(text, '\\S+')) AS n FROM documents)
SELECT doc_id, text_hash, CAST(n AS BIGINT) AS n_words, row_number() OVER (PARTITION BY text_hash ORDER BY doc_id) = 1 AS is_first FROM h""")
def text_norm_dedup(spark, d):
    rows = _t(spark, d, "documents").select("doc_id", text.text_hash(F.col("text")).alias("text_hash"), text.word_count(F.col("text")).cast("long").alias("n_words"))
    return store.first_wins(rows, F.col("text_hash"), "doc_id")


@query("gold_leak_flags", f"""WITH g AS (SELECT DISTINCT lang, substr({NORM.format('text')}, 1, 120) AS k FROM documents JOIN labels USING (doc_id)),
p AS (SELECT doc_id, lang, substr({NORM.format('text')}, 1, 120) AS k FROM documents ANTI JOIN labels USING (doc_id))
SELECT p.doc_id, g.k IS NOT NULL AS in_gold FROM p LEFT JOIN g ON g.lang = p.lang AND g.k = p.k""")
def gold_leak_flags(spark, d):
    docs, labels = _t(spark, d, "documents").select("doc_id", "lang", "text"), _t(spark, d, "labels")
    pool = docs.join(labels, "doc_id", "left_anti").withColumn("neg", F.lit(""))
    return store.leak_flags(pool, docs.join(labels, "doc_id", "left_semi"), "lang", "text", "neg").select("doc_id", "in_gold")


def _reviews(spark, d):
    """Documents as raw reviews: dates, countries, travellers, names and photos follow from other columns; a third of the texts are negative."""
    n, k = F.col("n_chars"), F.col("doc_id")
    date = F.when(n % 11 != 0, F.concat(F.lit("ngày "), n % 28 + 1, F.lit(" tháng "), n % 12 + 1, F.lit(" năm "), F.lit(2021) + n % 5))
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), (n % len(values) + 1).cast("int"))
    photo = F.when(k % 4 == 0, F.create_map(F.concat(F.lit("https://a/"), k), F.lit("x"), F.concat(F.lit("https://b/"), k), F.lit("y")))
    return _t(spark, d, "documents").select(
        k.alias("line"), F.col("lang").alias("hotel_id"), F.when(n % 3 == 0, "Ann").alias("name"), date.alias("review_date"), F.when(n % 3 != 1, F.col("text")).alias("review_positive"),
        F.when(n % 3 == 1, F.col("text")).when(n % 3 == 2, F.col("source")).alias("review_negative"), F.lit("Đạt điểm 9,0").alias("review_score"), pick(["Pháp", "Việt Nam", " Nhật Bản", None]).alias("country"),
        pick(["Nhóm", "Cặp đôi", "x", None, "Khách lẻ"]).alias("state"), F.lit("2 đêm").alias("date"), F.when(k % 5 == 0, "  ").otherwise(" Phòng\u00a0").alias("room"), photo.alias("review_photo"), (n % 6).alias("stars_rating"))


def _gold(spark, d):
    """(gold with text and, of a tenth, a date; hotels' splits): labelled documents as the gold reviews."""
    n = F.col("n_chars")
    date = F.when((F.col("doc_id") % 10 == 0) & (n % 11 != 0), F.concat_ws("-", F.lit(2021) + n % 5, F.lpad((n % 12 + 1).cast("string"), 2, "0"), F.lpad((n % 28 + 1).cast("string"), 2, "0")))
    meta = _t(spark, d, "documents").join(_t(spark, d, "labels").select("doc_id").distinct(), "doc_id", "left_semi").select(F.col("lang").alias("hotel_id"), F.col("doc_id").alias("source_review_id"), "text", date.alias("iso_date"))
    splits = _t(spark, d, "labels").select(F.col("doc_id").alias("source_review_id")).distinct().join(_t(spark, d, "documents").select(F.col("doc_id").alias("source_review_id"), "lang"), "source_review_id")
    return store.gold_sides(meta, splits.where("lang IN ('en', 'fr')").select("source_review_id", F.when(F.col("lang") == "en", "train").otherwise("test").alias("split")))


REVIEWS = f"""iso AS (SELECT *, CASE WHEN n_chars % 11 <> 0 THEN (2021 + n_chars % 5) || '-' || lpad(CAST(n_chars % 12 + 1 AS VARCHAR), 2, '0') || '-' || lpad(CAST(n_chars % 28 + 1 AS VARCHAR), 2, '0') END AS iso FROM documents),
r AS (SELECT *, CASE WHEN n_chars % 3 <> 1 THEN trim(text, E' \t\n\r') ELSE '' END AS pos, CASE n_chars % 3 WHEN 1 THEN trim(text, E' \t\n\r') WHEN 2 THEN source ELSE '' END AS neg FROM iso),
k AS (SELECT *, CASE WHEN iso IS NULL THEN 'no_date' WHEN substr(iso, 1, 7) NOT BETWEEN '2022-03' AND '2025-02' THEN 'window' END AS early FROM r),
s AS (SELECT *, coalesce(early, CASE WHEN row_number() OVER (PARTITION BY early, {NORM.format("lang || '|' || CASE WHEN n_chars % 3 = 0 THEN 'Ann' ELSE 'None' END || '|' || iso || '|' || pos || '|' || neg")} ORDER BY doc_id) = 1 THEN 'kept' ELSE 'dup' END) AS status FROM k),
gold AS (SELECT lang, substr({NORM.format('text')}, 1, 120) AS key, CASE WHEN doc_id % 10 = 0 THEN iso END AS iso FROM iso SEMI JOIN labels USING (doc_id)),
keyed AS MATERIALIZED (SELECT *, substr({NORM.format('pos')}, 1, 120) AS kp, substr({NORM.format('neg')}, 1, 120) AS kn, substr({NORM.format("pos || ' ' || neg")}, 1, 120) AS kb FROM s WHERE status = 'kept'),
st AS MATERIALIZED (SELECT *, {" OR ".join(f"EXISTS (SELECT 1 FROM gold g WHERE g.lang = keyed.lang AND g.key <> '' AND g.key = {k})" for k in ("kp", "kn", "kb"))}
  OR EXISTS (SELECT 1 FROM gold g WHERE g.lang = keyed.lang AND g.iso = keyed.iso) AS in_gold FROM keyed)"""


@query("store_counters", f"WITH {REVIEWS} SELECT status, CAST(count(*) AS BIGINT) AS n FROM s GROUP BY status")
def store_counters(spark, d):
    return store.counters(store.status(_reviews(spark, d)))


def _store(spark, d):
    return store.store(_reviews(spark, d), *_gold(spark, d))


@query("store_rows", f"""WITH {REVIEWS} SELECT lang || '_' || replace(iso, '-', '') || '_' || lpad(CAST(doc_id AS VARCHAR), 8, '0') AS review_uid, substr(iso, 1, 7) AS period, 9.0e0 AS score, CASE n_chars % 4 WHEN 0 THEN 'WEST' WHEN 1 THEN 'VN' WHEN 2 THEN 'ASIA' ELSE 'OTH' END AS bloc,
  CASE n_chars % 5 WHEN 0 THEN 'Nhóm' WHEN 1 THEN 'Cặp đôi' WHEN 4 THEN 'Khách lẻ' ELSE 'NA' END AS traveller, CAST(2 AS BIGINT) AS nights, CAST(len(regexp_extract_all(pos || ' ' || neg, '\\S+')) AS BIGINT) AS n_words, in_gold,
  CASE lang WHEN 'en' THEN 'train' WHEN 'fr' THEN 'test' END AS gold_split, pos <> '' OR neg <> '' AS has_text, md5(nullif(pos, '')) AS pos_md5, md5(nullif(neg, '')) AS neg_md5, CASE WHEN doc_id % 5 <> 0 THEN 'Phòng' END AS room,
  doc_id % 4 = 0 AS has_photo, CASE WHEN doc_id % 4 = 0 THEN 'https://a/' || doc_id || ',https://b/' || doc_id ELSE '' END AS photos, CASE WHEN doc_id % 4 = 0 THEN 'https://a/' || doc_id END AS first_photo, CAST(n_chars % 6 AS DOUBLE) AS stars FROM st""")
def store_rows(spark, d):
    return _store(spark, d).select(
        "review_uid", "period", "score", F.col("country_bloc").alias("bloc"), "traveller", F.col("nights").cast("long").alias("nights"), F.col("n_words").cast("long").alias("n_words"), "in_gold", "gold_split", "has_text",
        F.md5("text_pos").alias("pos_md5"), F.md5("text_neg").alias("neg_md5"), "room", "has_photo", F.array_join("photo_urls", ",").alias("photos"), "first_photo", F.col("stars_rating").alias("stars"))


@query("store_report", f"""WITH {REVIEWS}, a AS (SELECT count(*) AS "read", count(*) FILTER (status = 'no_date') AS drop_no_date, count(*) FILTER (status = 'window') AS drop_window, count(*) FILTER (status = 'dup') AS drop_dup FROM s)
SELECT CAST("read" AS BIGINT) AS "read", CAST(drop_no_date AS BIGINT) AS drop_no_date, CAST(drop_window AS BIGINT) AS drop_window, CAST(drop_dup AS BIGINT) AS drop_dup, CAST(count(*) AS BIGINT) AS written, CAST(count(*) FILTER (in_gold) AS BIGINT) AS flag_gold_leak,
  CAST(count(*) FILTER (pos <> '' OR neg <> '') AS BIGINT) AS has_text, CAST(count(*) FILTER (pos = '' AND neg = '') AS BIGINT) AS no_text, CAST(count(DISTINCT lang) AS BIGINT) AS hotels FROM st, a GROUP BY ALL""")
def store_report(spark, d):
    statuses = staged(store.status(_reviews(spark, d)).drop("review_positive", "review_negative"))  # text_pos and text_neg hold them
    return store.report(statuses, store.stored(statuses, *_gold(spark, d)))


@query("store_cohorts", f"""WITH {REVIEWS}, h AS (SELECT * FROM (VALUES ('en', 'train'), ('fr', 'test')) t(lang, split)), c AS (SELECT h.lang, split, count(st.lang) AS n FROM h LEFT JOIN st USING (lang) GROUP BY ALL)
SELECT 'dense' AS cohort, lang AS hotel_id FROM c WHERE n >= 100 UNION ALL SELECT 'unbiased', lang FROM c WHERE split = 'test'""")
def store_cohorts(spark, d):
    counts = store.hotel_counts(_store(spark, d))
    return store.cohorts(counts, _gold(spark, d)[1], {"dense": {"min_pool": 100, "split": None}, "unbiased": {"min_pool": 0, "split": "test"}})


@query("cohorts", """WITH c AS (SELECT CAST(s_suppkey AS VARCHAR) AS hotel_id, CASE WHEN s_suppkey % 10 < 7 THEN 'train' WHEN s_suppkey % 10 < 9 THEN 'dev' ELSE 'test' END AS split, count(l_orderkey) AS n
  FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY ALL)
SELECT 'dense' AS cohort, hotel_id FROM c WHERE n >= 620 UNION ALL SELECT 'anchor', hotel_id FROM c WHERE n >= 580 UNION ALL SELECT 'unbiased', hotel_id FROM c WHERE split = 'test'""")
def cohorts(spark, d):
    b = F.pmod(F.col("s_suppkey"), F.lit(10))
    split = _t(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("hotel_id"), F.when(b < 7, "train").when(b < 9, "dev").otherwise("test").alias("split"))
    counts = _t(spark, d, "lineitem").groupBy(F.col("l_suppkey").cast("string").alias("hotel_id")).agg(F.count("*").alias("n"))
    return store.cohorts(counts, split, {"dense": {"min_pool": 620, "split": None}, "anchor": {"min_pool": 580, "split": None}, "unbiased": {"min_pool": 0, "split": "test"}})


@query("cohort_quads", f"""WITH {QUADS} SELECT hotel_id, CAST(count(*) AS BIGINT) AS n FROM quads WHERE CAST(hotel_id AS BIGINT) % 10 = 9 GROUP BY hotel_id""")
def cohort_quads(spark, d):
    chosen = cohorts(spark, d).where("cohort = 'unbiased'")
    return quads(spark, d).join(chosen, "hotel_id", "left_semi").groupBy("hotel_id").agg(F.count("*").alias("n"))


@query("strata_bins", """SELECT c_custkey AS id, CASE c_custkey % 7 WHEN 0 THEN 'VN' WHEN 1 THEN 'WEST' WHEN 2 THEN 'ASIA' WHEN 5 THEN 'WEST' WHEN 6 THEN 'ASIA' ELSE 'OTH' END AS bloc,
  CASE c_custkey % 4 WHEN 0 THEN 'Cặp đôi' WHEN 1 THEN 'Nhóm' ELSE 'NA' END AS traveller, CASE WHEN c_custkey % 80 < 15 THEN 'L0' WHEN c_custkey % 80 < 45 THEN 'L1' ELSE 'L2' END AS length_bin FROM customer""")
def strata_bins(spark, d):
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("c_custkey") % len(values) + 1).cast("int"))
    st = strata.stratum(pick(["Việt Nam", "Pháp", "Hàn Quốc", "Brazil", None, "  Úc ", "singapore"]), pick(["Cặp đôi", "Nhóm", "cặp đôi", None]), F.col("c_custkey") % 80)
    return _t(spark, d, "customer").select(F.col("c_custkey").alias("id"), st.alias("s")).select("id", "s.*")


@query("unpivot_units", """SELECT doc_id AS review_uid, 'POS' AS phi, md5(text) AS text_md5 FROM documents ANTI JOIN labels USING (doc_id) WHERE text <> ''
UNION ALL SELECT doc_id, 'NEG', md5(source) FROM documents ANTI JOIN labels USING (doc_id) WHERE source <> ''""")
def unpivot_units(spark, d):
    """The whole text and the source of every document without a label."""
    docs = _t(spark, d, "documents").join(_t(spark, d, "labels").select("doc_id", F.lit(True).alias("g")).distinct(), "doc_id", "left")
    rows = store.units(docs.select(F.col("doc_id").alias("review_uid"), F.col("text").alias("text_pos"), F.col("source").alias("text_neg"), F.coalesce("g", F.lit(False)).alias("in_gold")))
    return rows.select("review_uid", "phi", F.md5("text").alias("text_md5"))


# ---------------------------------------------------------------- posterior

POST = "SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN 'POS' ELSE 'NEG' END AS phi, (p_size % 7 + 1) / 20.0e0 AS a, (p_size % 5 + 1) / 20.0e0 AS b, (p_size % 3 + 1) / 20.0e0 AS c FROM part"


@query("provenance_posterior", f"""WITH p AS ({POST}), l AS (SELECT id, 0.7e0 * ln(a) + 0.3e0 * ln(CASE phi WHEN 'POS' THEN 0.931e0 ELSE 0.217e0 END) AS x, 0.7e0 * ln(b) + 0.3e0 * ln(CASE phi WHEN 'POS' THEN 0.036e0 ELSE 0.142e0 END) AS y,
  0.7e0 * ln(c) + 0.3e0 * ln(CASE phi WHEN 'POS' THEN 0.033e0 ELSE 0.641e0 END) AS z FROM p)
SELECT id, CASE WHEN x >= y AND x >= z THEN 'positive' WHEN y >= z THEN 'neutral' ELSE 'negative' END AS sentiment, round(exp(greatest(x, y, z)) / (exp(x) + exp(y) + exp(z)), 6) AS posterior FROM l""")
def provenance_posterior(spark, d):
    k = F.col("p_size")
    p = {"positive": (k % 7 + 1) / 20.0, "neutral": (k % 5 + 1) / 20.0, "negative": (k % 3 + 1) / 20.0}
    out = posterior.provenance(p, F.when(F.col("p_partkey") % 2 == 0, "POS").otherwise("NEG"))
    return _t(spark, d, "part").select(F.col("p_partkey").alias("id"), out.alias("o")).select("id", "o.sentiment", F.round("o.posterior", 6).alias("posterior"))


@query("degenerate_scores", """WITH p AS (SELECT p_partkey AS id, p_size AS k, -p_size / 10.0e0 AS a, CASE WHEN p_size % 9 = 0 THEN -p_size / 10.0e0 ELSE -(p_size % 5) / 10.0e0 END AS b, CASE WHEN p_size % 9 = 0 THEN -p_size / 10.0e0 ELSE -(p_size % 7) / 10.0e0 END AS c FROM part)
SELECT id, k % 9 = 0 OR (a = b AND b = c) AS flat, round(CASE WHEN k % 9 = 0 OR (a = b AND b = c) THEN CASE WHEN k % 2 = 0 THEN 0.9e0 ELSE 0.05e0 END ELSE exp(a) / (exp(a) + exp(b) + exp(c)) END, 6) AS p_positive FROM p""")
def degenerate_scores(spark, d):
    k = F.col("p_size")
    other = lambda m: F.when(k % 9 == 0, -k / 10.0).otherwise(-(k % m) / 10.0)
    logp = {"positive": -k / 10.0, "neutral": other(5), "negative": other(7)}
    v = posterior.variants(logp, F.when(k % 2 == 0, "positive").otherwise("negative"))
    return _t(spark, d, "part").select(F.col("p_partkey").alias("id"), posterior.degenerate(logp).alias("flat"), F.round(v["positive"], 6).alias("p_positive"))


# ---------------------------------------------------------------- codec

TERM = "CASE WHEN line % 4 = 0 THEN NULL WHEN line % 4 = 1 THEN aspect_term || ' | & <quad>' ELSE aspect_term END"
ESC = "replace(replace(replace(replace({0}, '&', '&amp;'), '|', '&#124;'), '<quad>', '&lt;quad&gt;'), '</quad>', '&lt;/quad&gt;')"


def _segments(spark, d):
    one = F.struct("line", "taxonomy_code", "aspect_term", "opinion_term", "sentiment", "phi")
    rows = quads(spark, d).groupBy("review_uid").agg(F.sort_array(F.collect_list(one)).alias("q"))
    term = lambda q: F.when(q["line"] % 4 == 0, None).when(q["line"] % 4 == 1, F.concat(q["aspect_term"], F.lit(" | & <quad>"))).otherwise(q["aspect_term"])
    made = F.transform("q", lambda q: F.struct(term(q).alias("aspect_term"), q["taxonomy_code"].alias("taxonomy_code"), q["opinion_term"].alias("opinion_term"), q["sentiment"].alias("sentiment")))
    return rows.select(F.col("review_uid").alias("instance_id"), F.col("review_uid").alias("source_review_id"), F.concat_ws(" ", F.transform("q", lambda q: q["aspect_term"])).alias("text"), made.alias("quads"))


@query("codec_linearize", f"""WITH {QUADS} SELECT review_uid AS instance_id, string_agg('<quad> ' || coalesce({ESC.format(TERM)}, 'NULL') || ' | ' || taxonomy_code || ' | ' || {ESC.format('opinion_term')} || ' | ' || sentiment || ' </quad>', ' '
  ORDER BY line, taxonomy_code, aspect_term, opinion_term, sentiment, phi) AS target, CAST(count(*) AS BIGINT) AS n_quads FROM quads GROUP BY review_uid""")
def codec_linearize(spark, d):
    return codec.training_rows(_segments(spark, d)).select("instance_id", "target", F.col("n_quads").cast("long").alias("n_quads"))


def _spoiled(spark, d):
    """Targets as a model may write them: blanks of all kinds around fields, raw bars inside terms, unknown codes, lost fields."""
    rows, k = quads(spark, d), F.col("line")
    fields = F.concat(F.lit("<quad>\t"), F.col("aspect_term"), F.when(k % 4 == 1, " | more").otherwise(""), F.lit(" |\u00a0"), F.when(k % 7 == 3, "NO_CODE").otherwise(F.col("taxonomy_code")), F.lit("\t| "),
                      F.col("opinion_term"), F.when(k % 4 == 2, " |x").otherwise(""), F.when(k % 7 == 5, "").otherwise(F.concat(F.lit(" |\n"), F.col("sentiment"))), F.lit("\u3000</quad>"))
    return rows.withColumn("target", fields)


@query("codec_parse", f"""WITH {QUADS} SELECT taxonomy_code, category, sentiment, CAST(count(*) AS BIGINT) AS n,
  md5(string_agg(aspect_term || CASE WHEN line % 4 = 1 THEN ' | more' ELSE '' END || '/' || opinion_term || CASE WHEN line % 4 = 2 THEN ' | x' ELSE '' END, ';' ORDER BY review_uid, line, part, aspect_term, opinion_term)) AS terms
FROM quads WHERE line % 7 <> 3 AND line % 7 <> 5 GROUP BY ALL""")
def codec_parse(spark, d):
    rows = _spoiled(spark, d).select("review_uid", "line", "part", F.explode(codec.parse_linearized(F.col("target"), TAXONOMY)).alias("q")).select("review_uid", "line", "part", "q.*")
    place = lambda values, c: F.array_position(F.array(*map(F.lit, values)), F.col(c)) - 1
    kinds = F.array(*[F.struct(*map(F.lit, (code, category, s))) for code, category in TAXONOMY.items() for s in config.SENTIMENTS])
    numbered = rows.withColumn("number", place(TAXONOMY, "taxonomy_code") * len(config.SENTIMENTS) + place(config.SENTIMENTS, "sentiment"))
    by = aggregate.joined_md5(numbered, len(TAXONOMY) * len(config.SENTIMENTS), ["review_uid", "line", "part", "aspect_term", "opinion_term"], F.concat_ws("/", "aspect_term", "opinion_term"))
    return by.select(F.get(kinds, F.col("number")).alias("k"), "n", F.col("md5").alias("terms")).select(*[F.col(f"k.col{i}").alias(c) for i, c in ((1, "taxonomy_code"), (2, "category"), (3, "sentiment"))], "n", "terms")


@query("codec_roundtrip", f"WITH {QUADS} SELECT CAST(count(*) AS BIGINT) AS n_quads, CAST(count(*) AS BIGINT) AS n_parsed FROM quads")
def codec_roundtrip(spark, d):
    return codec.round_trip(_segments(spark, d), TAXONOMY)


# ---------------------------------------------------------------- evaluation

BAGS = f"""WITH {QUADS}, g AS (SELECT review_uid AS i, taxonomy_code AS k, sentiment AS s, category AS c, count(*) AS gold FROM quads GROUP BY ALL),
p AS (SELECT review_uid AS i, taxonomy_code AS k, CASE WHEN part % 7 = 0 THEN 'neutral' ELSE sentiment END AS s, category AS c, count(*) AS pred FROM quads WHERE part % 5 <> 0 GROUP BY ALL),
bags AS (SELECT i, k, s, c, coalesce(gold, 0) AS gold, coalesce(pred, 0) AS pred, least(coalesce(gold, 0), coalesce(pred, 0)) AS hits FROM g FULL JOIN p USING (i, k, s, c)),
inst AS (SELECT review_uid AS i, CASE min(bloc) WHEN 'ASIA' THEN 'en' WHEN 'EUROPE' THEN 'vi' ELSE 'other' END AS lang, CASE WHEN count(*) < 3 THEN 'L0' WHEN count(*) < 5 THEN 'L1' ELSE 'L2' END AS len FROM quads GROUP BY review_uid)"""
PRF = """CAST(sum(gold) AS BIGINT) AS gold, CAST(sum(pred) AS BIGINT) AS pred, CAST(sum(hits) AS BIGINT) AS hits, round(coalesce(sum(hits) / nullif(sum(pred), 0), 0), 4) AS "precision", round(coalesce(sum(hits) / nullif(sum(gold), 0), 0), 4) AS recall,
  round(coalesce(2 * sum(hits) / nullif(sum(pred) + sum(gold), 0), 0), 4) AS f1"""


def _bags(spark, d):
    rows = staged(quads(spark, d).select(F.col("review_uid").alias("instance_id"), F.col("taxonomy_code").alias("key"), "sentiment", "category", "part", "bloc"))
    predicted = rows.where("part % 5 <> 0").withColumn("sentiment", F.when(F.col("part") % 7 == 0, "neutral").otherwise(F.col("sentiment")))
    n = F.count("*")
    language = evaluate.language_bucket(F.when(F.min("bloc") == "ASIA", "en").when(F.min("bloc") == "EUROPE", "vi").otherwise("ko"))
    inst = rows.groupBy("instance_id").agg(language.alias("language"), F.when(n < 3, "L0").when(n < 5, "L1").otherwise("L2").alias("length"))
    return rows, predicted, inst


@query("prf_overall", f"{BAGS} SELECT {PRF} FROM bags")
def prf_overall(spark, d):
    gold, predicted, _ = _bags(spark, d)
    return evaluate.prf(evaluate.bag_counts(gold, predicted, "instance_id", "key", "sentiment", "category"))


@query("prf_slices", f"""{BAGS}, b AS (SELECT * FROM bags JOIN inst USING (i))
SELECT 'overall' AS slice, 'all' AS value, {PRF} FROM b UNION ALL SELECT 'language', lang, {PRF} FROM b GROUP BY lang UNION ALL SELECT 'length', len, {PRF} FROM b GROUP BY len
UNION ALL SELECT 'category', c, {PRF} FROM b GROUP BY c UNION ALL SELECT 'polarity_quad', s, {PRF} FROM b GROUP BY s
UNION ALL SELECT 'polarity', x.s, {PRF} FROM b JOIN (SELECT DISTINCT i, s FROM g) x ON x.i = b.i GROUP BY x.s""")
def prf_slices(spark, d):
    return evaluate.sliced(*_bags(spark, d))


@query("slice_covers", "SELECT s AS slice, true AS covers FROM (VALUES ('language'), ('length'), ('category'), ('polarity_quad')) t(s)")
def slice_covers(spark, d):
    report = staged(evaluate.sliced(*_bags(spark, d)))
    return reduce(DataFrame.unionByName, [evaluate.covers(report, s).select(F.lit(s).alias("slice"), "covers") for s in ("language", "length", "category", "polarity_quad")])


@query("bag_intersection", f"{BAGS} SELECT s AS sentiment, CAST(sum(hits) AS BIGINT) AS hits FROM bags GROUP BY s HAVING sum(hits) > 0")
def bag_intersection(spark, d):
    gold, predicted, _ = _bags(spark, d)
    counts = evaluate.bag_counts(gold, predicted, "instance_id", "key", "sentiment")
    return counts.where("hits > 0").groupBy("sentiment").agg(F.sum("hits").alias("hits"))


# ---------------------------------------------------------------- self-training


@query("pseudo_label_selection", f"WITH {QUADS} SELECT review_uid, phi, CAST(count(*) AS BIGINT) AS n_quads FROM quads WHERE conf_seq >= 0.95 AND w >= 0.93 GROUP BY ALL")
def pseudo_label_selection(spark, d):
    return selftrain.pseudo_rows(_unit_quads(spark, d), 0.95, 0.93).select("review_uid", "phi", F.col("n_quads").cast("long").alias("n_quads"))


def _unit_quads(spark, d):
    return quads(spark, d).withColumn("p_posterior", F.col("w")).withColumn("text", F.col("aspect_term")).withColumn("ord", F.col("line"))


@query("skew_guard", f"WITH {QUADS} SELECT CAST(count(*) AS BIGINT) AS n, round(avg(CASE WHEN sentiment = 'negative' THEN 1.0e0 ELSE 0 END), 6) AS rate FROM quads WHERE conf_seq >= 0.95 AND w >= 0.93")
def skew_guard(spark, d):
    return selftrain.negative_rate(selftrain.pseudo_rows(_unit_quads(spark, d), 0.95, 0.93)).select("n", F.round("rate", 6).alias("rate"))


@query("time_split", """SELECT CASE WHEN o_orderkey % 50 = 0 THEN 'undated' WHEN o_orderdate < TIMESTAMP '1998-07-01' THEN 'train' WHEN o_orderdate >= TIMESTAMP '1999-01-01' THEN 'test' ELSE 'between' END AS part, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY ALL""")
def time_split(spark, d):
    rows = _t(spark, d, "orders").select(F.when(F.col("o_orderkey") % 50 != 0, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("review_date"))
    return codec.time_split(rows, "1998-06", "1999-01").groupBy("part").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- sampling


@query("reservoir", f"SELECT c_custkey AS id FROM customer ORDER BY md5('{SEED}|' || c_custkey), c_custkey LIMIT 100")
def reservoir(spark, d):
    return sampling.reservoir(_t(spark, d, "customer"), 100, SEED, "c_custkey").select(F.col("c_custkey").alias("id"))


@query("stratified_audit", f"""WITH c AS (SELECT *, c_nationkey % 3 AS b, row_number() OVER (PARTITION BY c_mktsegment, c_nationkey % 3 ORDER BY md5('{SEED}|' || c_custkey), c_custkey) AS r FROM customer)
SELECT c_custkey AS id, c_mktsegment AS seg, CAST(b AS BIGINT) AS b FROM c WHERE r <= greatest(1, 70 // (SELECT count(*) FROM (SELECT DISTINCT c_mktsegment, b FROM c))) ORDER BY md5('{SEED + 1}|' || c_custkey), c_custkey LIMIT 70""")
def stratified_audit(spark, d):
    rows = _t(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("seg"), (F.col("c_nationkey") % 3).cast("long").alias("b"))
    return sampling.stratified(rows, ["seg", "b"], 70, SEED, "id")


@query("conf_bands", f"WITH {QUADS} SELECT CASE WHEN conf_seq * conf_seq * conf_seq * conf_seq < 0.6 THEN 'lo' WHEN conf_seq * conf_seq * conf_seq * conf_seq < 0.85 THEN 'mid' ELSE 'hi' END AS band, phi, CAST(count(*) AS BIGINT) AS n FROM quads GROUP BY ALL")
def conf_bands(spark, d):
    c = F.col("conf_seq")
    return quads(spark, d).groupBy(strata.conf_band(c * c * c * c).alias("band"), "phi").agg(F.count("*").alias("n"))


@query("negative_sampling", f"""WITH {QUADS}, pos AS (SELECT DISTINCT review_uid AS item, category FROM quads), n AS (SELECT item, count(*) AS n_pos FROM pos GROUP BY item),
pool AS (SELECT item, n_pos, c.category FROM n CROSS JOIN (SELECT DISTINCT category FROM quads) c ANTI JOIN pos ON pos.item = n.item AND pos.category = c.category)
SELECT item, category FROM pool QUALIFY row_number() OVER (PARTITION BY item ORDER BY md5('{SEED}|' || item || '|' || category), item, category) <= n_pos""")
def negative_sampling(spark, d):
    pos = quads(spark, d).select(F.col("review_uid").alias("item"), "category").distinct()
    return sampling.negatives(pos, pos, pos, "item", SEED)


# ---------------------------------------------------------------- injections


@query("inject_composition", f"""WITH {QUADS}, p AS (SELECT period, dense_rank() OVER (ORDER BY period) - 1 AS i FROM (SELECT DISTINCT period FROM quads)), m AS (SELECT max(i) AS m FROM p)
SELECT period, bloc, CAST(count(*) AS BIGINT) AS n FROM quads JOIN p USING (period), m WHERE {_u(*KEY)} < CASE WHEN bloc = 'ASIA' THEN 1.0e0 - 0.8e0 * (i / m) ELSE 0.2e0 + 0.8e0 * (i / m) END GROUP BY ALL""")
def inject_composition(spark, d):
    return inject.composition(quads(spark, d), F.col("bloc") == "ASIA", SEED, *KEY).groupBy("period", "bloc").agg(F.count("*").alias("n"))


@query("inject_valence", f"""WITH {QUADS} SELECT period, CASE WHEN taxonomy_code = 'SMALL_1' AND period >= '1998-06' AND sentiment = 'positive' AND {_u(*KEY)} < 0.2 THEN 'negative' ELSE sentiment END AS sentiment, CAST(count(*) AS BIGINT) AS n
FROM quads WHERE taxonomy_code = 'SMALL_1' GROUP BY ALL""")
def inject_valence(spark, d):
    rows = inject.valence(quads(spark, d), "SMALL_1", 0.2, "1998-06", SEED, *KEY)
    return rows.where("taxonomy_code = 'SMALL_1'").groupBy("period", "sentiment").agg(F.count("*").alias("n"))


@query("inject_shuffle", f"""WITH {QUADS}, r AS (SELECT review_uid, min(period) AS period FROM quads GROUP BY review_uid), a AS (SELECT review_uid, row_number() OVER (ORDER BY md5(review_uid), review_uid) AS k FROM r),
b AS (SELECT period, row_number() OVER (ORDER BY md5('{SEED}|' || review_uid), review_uid) AS k FROM r)
SELECT q.review_uid, b.period, CAST(count(*) AS BIGINT) AS n FROM quads q JOIN a ON a.review_uid = q.review_uid JOIN b ON b.k = a.k GROUP BY ALL""")
def inject_shuffle(spark, d):
    return inject.shuffle(quads(spark, d), SEED).groupBy("review_uid", "period").agg(F.count("*").alias("n"))


CONFIG_SEED = str(config.SEED)


def _shuffled(seed, run):
    """SQL of shuffled quads, as inject.shuffle makes them; quads and their reviews in hash order are at hand as q and a."""
    return f"""SELECT {run} AS run, q.* REPLACE (b.period AS period) FROM quads q JOIN a ON a.review_uid = q.review_uid
  JOIN (SELECT period, row_number() OVER (ORDER BY md5('{seed}|' || review_uid), review_uid) AS k FROM r) b ON b.k = a.k"""


SHUFFLE = f"WITH {QUADS}, r AS (SELECT review_uid, min(period) AS period FROM quads GROUP BY review_uid), a AS (SELECT review_uid, row_number() OVER (ORDER BY md5(review_uid), review_uid) AS k FROM r)"


@query("composition_test", f"""{SHUFFLE}, sq AS ({_shuffled(config.SEED, 0)}), p AS (SELECT period, dense_rank() OVER (ORDER BY period) - 1 AS i FROM (SELECT DISTINCT period FROM sq)), m AS (SELECT max(i) AS m FROM p),
rq AS (SELECT sq.* FROM sq JOIN p USING (period), m WHERE {sql_parts.uniform(f"'{config.SEED + 1}'", *KEY)} < CASE WHEN bloc = 'ASIA' THEN 1.0e0 - 0.8e0 * (i / m) ELSE 0.2e0 + 0.8e0 * (i / m) END),
{sql_parts.drift()}, c AS (SELECT CAST(count(*) FILTER (significant AND channel IN ('adj', 'val_adj')) AS BIGINT) AS n_adj, CAST(count(*) FILTER (significant AND channel IN ('raw', 'val_raw')) AS BIGINT) AS n_raw FROM rep)
SELECT n_adj, n_raw, CASE WHEN n_adj > 0 THEN 'FAIL' WHEN n_raw > 0 THEN 'PASS' ELSE 'INCONCLUSIVE' END AS outcome FROM c""")
def composition_test(spark, d):
    return harness.composition_test(quads(spark, d), F.col("bloc") == "ASIA", KEY, level="category")


DELTAS = (0.02, 0.05, 0.10, 0.20)
SWEPT = " UNION ALL ".join(f"SELECT {i} AS run, * REPLACE (CASE WHEN taxonomy_code = 'SMALL_1' AND period >= '1998-06' AND sentiment = 'positive' AND {sql_parts.uniform(f"'{config.SEED + i}'", *KEY)} < {x} THEN 'negative' ELSE sentiment END AS sentiment) FROM quads" for i, x in enumerate(DELTAS))
NEAR = "abs((substr(changepoint, 1, 4)::INT - 1998) * 12 + substr(changepoint, 6, 2)::INT - 6) <= 3"


@query("valence_sweep", f"""WITH {QUADS}, rq AS ({SWEPT}), {sql_parts.drift("taxonomy_code", channels=("adj", "val_adj"))}
SELECT CAST({list(DELTAS)}[run + 1] AS DOUBLE) AS delta, max((channel = 'val_adj' AND significant)::INT) = 1 AS significant, max((channel = 'val_adj' AND significant AND {NEAR})::INT) = 1 AS detected, max(CASE WHEN channel = 'val_adj' THEN changepoint END) AS changepoint,
  max((channel = 'adj' AND significant AND {NEAR})::INT) = 1 AS prevalence_detected FROM rep WHERE aspect = 'SMALL_1' GROUP BY run""")
def valence_sweep(spark, d):
    return harness.valence_sweep(quads(spark, d), "SMALL_1", "1998-06", KEY, DELTAS)


@query("shuffle_control", f"""{SHUFFLE}, rq AS ({" UNION ALL ".join(_shuffled(config.SEED + i, i) for i in range(5))}), {sql_parts.drift(seed=f"{config.SEED} + run", channels=("adj", "val_adj"))},
m AS (SELECT avg(f) AS mean_rate FROM (SELECT run, avg(significant::INT) AS f FROM rep GROUP BY run)) SELECT 5 AS repeats, round(mean_rate, 9) AS mean_rate, CASE WHEN mean_rate <= 0.1 THEN 'PASS' ELSE 'FAIL' END AS outcome FROM m""")
def shuffle_control(spark, d):
    return harness.shuffle_control(quads(spark, d), level="category").withColumn("mean_rate", F.round("mean_rate", 9))


# ---------------------------------------------------------------- weights

FLIP = "(phi = 'POS' AND sentiment = 'negative')"
MODEL = ([1.5, -0.4, 0.3, 0.2, -0.7], -0.5)


def _scored(spark, d):
    return quads(spark, d).withColumn("p_posterior", F.col("w")).withColumn("provenance_flip", (F.col("phi") == "POS") & (F.col("sentiment") == "negative")).withColumn("score", F.when(F.col("part") % 3 != 0, F.col("part") % 10))


@query("apply_weights", f"""WITH {QUADS} SELECT category, 'bridge' AS w_source, CAST(count(*) AS BIGINT) AS n, round(sum(CASE WHEN reportable THEN round(1 / (1 + exp(-(1.5e0 * conf_seq - 0.4e0 * w + 0.3e0 * CASE WHEN phi = 'POS' THEN 1 ELSE 0 END
  + 0.2e0 * ln(1 + n_words) - 0.7e0 * CASE WHEN {FLIP} THEN 1 ELSE 0 END - 0.5e0))), 4) ELSE 0 END), 2) AS w FROM quads GROUP BY ALL""")
def apply_weights(spark, d):
    rows = reliability.apply_weights(_scored(spark, d), F.col("reportable"), MODEL)
    return rows.groupBy("category", "w_source").agg(F.count("*").alias("n"), F.round(F.sum("w"), 2).alias("w"))


@query("attach_images", f"""WITH {QUADS} SELECT CASE WHEN CAST(review_uid AS BIGINT) % 3 <> 0 THEN 'no_image' WHEN CAST(review_uid AS BIGINT) % 9 = 0 THEN 'no_score' ELSE 'scored' END AS reason, CAST(count(*) AS BIGINT) AS n FROM quads GROUP BY ALL""")
def attach_images(spark, d):
    k = F.col("o_orderkey")
    images = _t(spark, d, "orders").where(k % 3 == 0).select(k.cast("string").alias("review_uid"), F.when(k % 9 != 0, 0.5).alias("v_image"))
    return reliability.attach_images(quads(spark, d), images).groupBy("reason").agg(F.count("*").alias("n"))


@query("ipw_weights", f"""WITH {QUADS}, data AS MATERIALIZED (SELECT category, ln(1 + n_words) AS f0, CASE WHEN part % 3 <> 0 THEN part % 10 ELSE 8.7e0 END AS f1, CAST(part % 3 = 0 OR n_words > 30 AS DOUBLE) AS y, 1.0e0 AS w FROM quads),
{sql_parts.newton(2)} SELECT category, round(avg(1 / least(greatest(1 / (1 + exp(-(b0 * f0 + b1 * f1 + b2))), 0.02e0), 1)), 6) AS mean_ipw, CAST(count(*) AS BIGINT) AS n FROM data, nr14 GROUP BY category""")
def ipw_weights(spark, d):
    rows = _scored(spark, d).withColumn("has_photo", (F.col("part") % 3 == 0) | (F.col("n_words") > 30))
    return reliability.ipw(rows).groupBy("category").agg(F.round(F.avg("ipw"), 6).alias("mean_ipw"), F.count("*").alias("n"))


SOFT = "conf_seq AS f0, w AS f1, CAST(phi = 'POS' AS DOUBLE) AS f2, ln(1 + n_words) AS f3, CAST(phi = 'POS' AND sentiment = 'negative' AS DOUBLE) AS f4"


@query("soft_label_bridge", f"""WITH {QUADS}, data AS MATERIALIZED (SELECT {SOFT}, 1.0e0 AS y, conf_seq AS w FROM quads UNION ALL SELECT {SOFT}, 0.0e0, 1 - conf_seq FROM quads),
{sql_parts.newton(5)}, named AS (SELECT unnest({[*reliability.FEATURES, "intercept"]}) AS feature, unnest([b0, b1, b2, b3, b4, b5]) AS c FROM nr14) SELECT feature, round(c, 5) AS coefficient FROM named""")
def soft_label_bridge(spark, d):
    w, b = reliability.fit_bridge(_scored(spark, d).withColumn("v_image", F.col("conf_seq")), weight=None)
    rows = spark.createDataFrame([(n, float(x)) for n, x in zip([*reliability.FEATURES, "intercept"], [*w, b], strict=True)], "feature string, coefficient double")
    return rows.withColumn("coefficient", F.round("coefficient", 5))


@query("spearman_gate", """WITH r AS (SELECT rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2.0e0 AS a, rank() OVER (ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_retailprice) - 1) / 2.0e0 AS b FROM part)
SELECT CAST(count(*) AS BIGINT) AS n, round(corr(a, b), 6) AS rho FROM r""")
def spearman_gate(spark, d):
    return evaluate.spearman(_t(spark, d, "part"), "p_size", "p_retailprice").select("n", F.round("rho", 6).alias("rho"))


@query("auc_by_slice", """WITH r AS (SELECT p_type AS slice, p_size > 25 AS y, rank() OVER w + (count(*) OVER (PARTITION BY p_type, p_retailprice) - 1) / 2.0e0 AS k FROM part WINDOW w AS (PARTITION BY p_type ORDER BY p_retailprice))
SELECT slice, CAST(count(*) AS BIGINT) AS n, round((sum(k) FILTER (y) - count(*) FILTER (y) * (count(*) FILTER (y) + 1) / 2.0e0) / nullif(count(*) FILTER (y) * count(*) FILTER (NOT y), 0), 6) AS auc FROM r GROUP BY slice""")
def auc_by_slice(spark, d):
    rows = _t(spark, d, "part").select(F.col("p_type").alias("slice"), "p_retailprice", (F.col("p_size") > 25).cast("int").alias("y"))
    return evaluate.auc(rows, "p_retailprice", "y", "slice").select("slice", "n", F.round("auc", 6).alias("auc"))


# ---------------------------------------------------------------- lexicon, embeddings


@query("lexicon_mining", f"""WITH {QUADS}, c AS (SELECT lower(opinion_term) AS term, taxonomy_code AS code, count(*) AS n FROM quads GROUP BY ALL), b AS (SELECT term, max((n, code)) AS m, sum(n) AS t FROM c GROUP BY term)
SELECT term, m[2] AS code, CAST(m[1] AS BIGINT) AS n, round(m[1] / t, 6) AS share FROM b WHERE m[1] >= 3 AND m[1] / t >= 0.04 AND length(term) >= 3""")
def lexicon_mining(spark, d):
    rows = lexicon.mine(quads(spark, d).withColumn("aspect_term", F.col("opinion_term")), share=0.04)
    return rows.withColumn("share", F.round("share", 6))


FOUND = " UNION ALL ".join(rf"SELECT doc_id, lpad(CAST(n_chars % 12 + 1 AS VARCHAR), 2, '0') AS period, lang AS stratum, '{c}' AS code FROM documents WHERE regexp_matches(lower(text), '(^|[^\p{{L}}\p{{N}}_])({'|'.join(t)})([^\p{{L}}\p{{N}}_]|$)')" for c, t in LEXICON.items())


def _found(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", "text", F.lpad((F.col("n_chars") % 12 + 1).cast("string"), 2, "0").alias("period"), F.col("lang").alias("stratum"))
    return docs, lexicon.hits(docs, F.col("text"), LEXICON)


@query("lexicon_probe", f"WITH f AS ({FOUND}) SELECT period, stratum, code, CAST(count(*) AS BIGINT) AS n FROM f GROUP BY ALL")
def lexicon_probe(spark, d):
    return _found(spark, d)[1].groupBy("period", "stratum", "code").agg(F.count("*").alias("n"))


@query("probe_drift", f"""WITH f AS ({FOUND}), n AS (SELECT lpad(CAST(n_chars % 12 + 1 AS VARCHAR), 2, '0') AS period, lang AS stratum, count(*) AS reviews FROM documents GROUP BY ALL),
ref AS (SELECT stratum, sum(reviews) / (SELECT sum(reviews) FROM n) AS wref FROM n GROUP BY stratum), k AS (SELECT unnest({list(LEXICON)}) AS code), h AS (SELECT period, stratum, code, count(*) AS c FROM f GROUP BY ALL),
g AS (SELECT n.period, n.stratum, reviews, wref, k.code, coalesce(c, 0) AS c FROM n JOIN ref USING (stratum) CROSS JOIN k LEFT JOIN h ON h.period = n.period AND h.stratum = n.stratum AND h.code = k.code),
s AS (SELECT *, sum(c) OVER (PARTITION BY period, stratum) AS st FROM g), a AS (SELECT period, code, sum(c) AS raw, sum(CASE WHEN reviews >= 12 AND st > 0 THEN wref * c / st ELSE 0 END) AS adj FROM s GROUP BY ALL)
SELECT period, code, round(coalesce(raw / nullif(sum(raw) OVER (PARTITION BY period), 0), 0), 6) AS raw, round(coalesce(adj / nullif(sum(adj) OVER (PARTITION BY period), 0), 0), 6) AS adj FROM a""")
def probe_drift(spark, d):
    docs, found = _found(spark, d)
    codes = spark.createDataFrame([(c,) for c in LEXICON], "code string")
    return lexicon.probe_shares(found, docs, codes, 12).select("period", "code", F.round("raw", 6).alias("raw"), F.round("adj", 6).alias("adj"))


@query("cosine_to_centroid", """WITH e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), c AS (SELECT label, i, avg(x) AS m FROM e GROUP BY label, i)
SELECT vec_id, round(sum(x * m) / (sqrt(sum(x * x)) * sqrt(sum(m * m))), 6) AS cosine FROM e JOIN c USING (label, i) GROUP BY vec_id""")
def cosine_to_centroid(spark, d):
    rows = _t(spark, d, "embeddings").select("vec_id", "label", "embedding")
    parts = rows.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    centre = parts.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda p: p["m"]).alias("centre"))  # one value a dimension
    return rows.join(centre, "label").select("vec_id", F.round(posterior.cosine(F.col("embedding"), F.col("centre")), 6).alias("cosine"))


# ---------------------------------------------------------------- sources, streams


@query("jsonl_roundtrip", "SELECT doc_id, lang, n_chars, md5(text) AS text_md5 FROM documents")
def jsonl_roundtrip(spark, d):
    from aspectdrift.sources import jsonl

    docs, path = _t(spark, d, "documents"), folder(spark) + "/table"
    jsonl.write_jsonl(docs, path)
    return jsonl.read_jsonl(spark, path, docs.schema).select("doc_id", "lang", "n_chars", F.md5("text").alias("text_md5"))


@query("stream_cells", "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, CAST(count(*) AS BIGINT) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_cells(spark, d):
    from aspectdrift.streaming import cells

    batch, name = _t(spark, d, "events"), f"cells_{uuid.uuid4().hex}"
    # A stream reads a folder; here the one that holds the table, by the table's name.
    stream = spark.readStream.schema(batch.schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/events.parquet*")
    stream = stream.withColumn("ts", F.col("ts").cast("timestamp"))
    cells.run_available(cells.windowed(stream, "ts", ["event_type"], "value"), name, folder(spark) + "/table")
    return spark.table(name).select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))
