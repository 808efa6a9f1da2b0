"""Operators on small inputs with known results."""

import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from aspectdrift import config
from aspectdrift.functions import calendar, parse, strata, text
from aspectdrift.operators import aggregate, codec, evaluate, inference, inject, lexicon, posterior, reliability, sampling, selftrain, series, store
from aspectdrift.plans import drift, harness
from aspectdrift.sources import jsonl


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


# ---------------------------------------------------------------- functions


@pytest.mark.parametrize(("raw", "want"), [
    ("Ngày đánh giá: ngày 5 tháng 9 năm 2022", ("2022-09-05", "2022-09")), ("2023-01-15", ("2023-01-15", "2023-01")), ("15/01/2023", ("2023-01-15", "2023-01")),
    ("ngày 31 tháng 2 năm 2022", ("2022-02-31", "2022-02")), ("ngày 1 tháng 2 năm 2022 2023-05-06", ("2022-02-01", "2022-02")), ("", None), ("2023-13-01", None), ("40/01/2023", None), (None, None),
])
def test_dates(spark, raw, want):
    got = one(spark, parse.review_date(F.lit(raw).cast("string")))
    assert (tuple(got) if got else None) == want


def test_scores_and_nights(spark):
    score = lambda s: one(spark, parse.score(F.lit(s).cast("string")))
    assert [score(s) for s in ("Đạt điểm 9,0", "Đạt điểm 10", "8.5", "0", "", None, "12", "x")] == [9.0, 10.0, 8.5, 0.0, None, None, None, None]
    assert one(spark, parse.nights(F.lit("1 đêm · Tháng 2/2025"))) == 1 and one(spark, parse.nights(F.lit("x"))) is None


def test_text(spark):
    norm = lambda s: one(spark, text.norm_text(F.lit(s).cast("string")))
    assert norm("  Phòng,\tRẤT sạch!!  ﬁne_1 ") == "phòng rất sạch fine_1" and norm(None) == ""
    assert norm("Phòng") == "phòng"
    count = lambda s: one(spark, text.word_count(F.lit(s).cast("string")))
    assert [count(s) for s in ("", None, " a  b c ", "x")] == [0, 0, 3, 1]
    assert one(spark, text.nfc(F.lit(" a　"))) == "a"
    uid = one(spark, text.quad_uid(F.lit("r"), F.lit("POS"), F.lit("AM_POOL"), F.lit(None).cast("string")))
    assert uid.startswith("r_POS_AM_POOL_") and len(uid.rsplit("_", 1)[1]) == 6


def test_stable_characters_are_their_own_forms():
    import re
    import unicodedata

    kept = [c for c in map(chr, range(0x20000)) if re.fullmatch(f"[{text.STABLE}]", c)]
    assert len(kept) > 400
    for c in kept:
        assert unicodedata.normalize("NFC", c) == unicodedata.normalize("NFKC", c) == c and not unicodedata.combining(c)


def test_strata(spark):
    bloc = lambda c: one(spark, strata.country_bloc(F.lit(c).cast("string")))
    assert [bloc(c) for c in ("Việt Nam", "Pháp", "Hàn Quốc", "Brazil", None)] == ["VN", "WEST", "ASIA", "OTH", "OTH"]
    assert [one(spark, strata.length_bin(F.lit(n))) for n in (0, 15, 45, 10_000)] == ["L0", "L1", "L2", "L2"]
    assert calendar.periods(spark, *config.WINDOW).count() == 36


def test_first_of_equal_sentiments_wins(spark):
    logp = {s: F.lit(0.0) for s in config.SENTIMENTS}
    assert one(spark, posterior.degenerate(logp))
    even = {"positive": F.lit(0.5), "neutral": F.lit(0.5), "negative": F.lit(0.5)}
    got = one(spark, posterior.provenance(even, F.lit("POS"), 1.0))
    assert got.sentiment == "positive" and got.posterior == pytest.approx(1 / 3)


# ---------------------------------------------------------------- shares


def share_table(spark, cells, ref, prior):
    rows = spark.createDataFrame(cells, "period string, stratum string, aspect string, w double")
    out = aggregate.shares(rows, spark.createDataFrame(ref, "stratum string, wref double"), rows.select("aspect").distinct(), prior)
    return {(r.period, r.aspect): (r.raw, r.adj) for r in out.collect()}


def test_one_stratum_leaves_shares_as_they_are(spark):
    got = share_table(spark, [("2022-01", "VN", "x", 30.0), ("2022-01", "VN", "y", 10.0), ("2022-02", "VN", "x", 20.0), ("2022-02", "VN", "y", 20.0)], [("VN", 1.0)], 0)
    assert all(raw == pytest.approx(adj) for raw, adj in got.values())


def test_shifting_strata_don_t_move_adjusted_shares(spark):
    cells = [("01", "VN", "x", 240.0), ("01", "VN", "y", 60.0), ("01", "WEST", "x", 20.0), ("01", "WEST", "y", 80.0), ("02", "VN", "x", 80.0), ("02", "VN", "y", 20.0), ("02", "WEST", "x", 60.0), ("02", "WEST", "y", 240.0)]
    got = share_table(spark, cells, [("VN", 0.5), ("WEST", 0.5)], 0)
    assert abs(got["01", "x"][0] - got["02", "x"][0]) > 0.2 and got["01", "x"][1] == pytest.approx(got["02", "x"][1])


def test_absent_stratum_and_huge_prior(spark):
    assert share_table(spark, [("01", "VN", "x", 30.0), ("01", "VN", "y", 10.0)], [("VN", 0.5), ("WEST", 0.5)], 10)["01", "x"][1] == pytest.approx(0.75)
    cells = [("01", "VN", "x", 9.0), ("01", "VN", "y", 1.0), ("01", "WEST", "x", 1.0), ("01", "WEST", "y", 9.0)]
    assert share_table(spark, cells, [("VN", 0.9), ("WEST", 0.1)], 10**6)["01", "x"][1] == pytest.approx(0.5, abs=1e-4)


def test_valence(spark):
    cells = spark.createDataFrame([("01", "VN", "x", 8.0, 10.0), ("01", "WEST", "x", 2.0, 10.0), ("02", "VN", "y", 1.0, 1.0)], "period string, stratum string, aspect string, neg double, total double")
    ref = spark.createDataFrame([("VN", 0.1), ("WEST", 0.9)], "stratum string, wref double")
    got = {(r.period, r.aspect): r for r in aggregate.valences(cells, ref, 0).collect()}
    assert got["01", "x"].raw == pytest.approx(0.5) and got["01", "x"].adj == pytest.approx(0.26) and got["01", "y"].raw is None


def test_weights_and_taxonomy(spark):
    rows = [("2022-03", "s", "AM_WIFI", "positive", "NEG", 1.0), ("2022-03", "s", "AM_POOL", "negative", "POS", None), ("2022-03", "s", "AM_POOL", "neutral", "POS", 0.0), ("2022-03", "s", "NOPE", "neutral", "POS", 2.0)]
    quads = aggregate.with_taxonomy(spark.createDataFrame(rows, "period string, stratum string, taxonomy_code string, sentiment string, phi string, w double"))
    got = {r.aspect: (r.total, r.neg, r.complaint) for r in aggregate.cells(quads).collect()}
    assert got == {"AMENITY": (1.0, 0.0, 1.0), "AM_POOL": (1.0, 1.0, 1.0)}


# ---------------------------------------------------------------- series


def stats(spark, values, **kw):
    rows = [("s", f"{2020 + i // 12}-{i % 12 + 1:02d}", float(v) if v is not None else None) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "series_id string, period string, value double"), kw


def test_seasons_trend_and_steps(spark):
    season, _ = stats(spark, [i % 12 for i in range(24)])
    y = [r.y for r in series.deseason(series.points(season)).collect()]
    assert max(y) - min(y) < 1e-9
    line, _ = stats(spark, [0.01 * i + (1e-6 if i % 2 else 0) for i in range(24)])
    r = series.trend(series.points(line).withColumn("y", F.col("value"))).first()
    assert r.slope_per_year == pytest.approx(0.12, abs=1e-4) and abs(r.t_stat) > 100
    rng = random.Random(1)
    step, _ = stats(spark, [rng.gauss(0, 0.1) for _ in range(10)] + [rng.gauss(3, 0.1) for _ in range(10)])
    r = series.best_split(series.points(step).withColumn("y", F.col("value"))).first()
    assert r.split == 10 and r.split_t > 10
    short, _ = stats(spark, range(8))
    assert series.statistics(short).count() == 0


def test_gaps_in_the_calendar(spark):
    rows = [("s", f"2020-{m:02d}", float(m)) for m in range(1, 13) if m != 6] + [("s", f"2021-{m:02d}", float(m + 12)) for m in range(1, 6)]
    table = spark.createDataFrame(rows, "series_id string, period string, value double")
    assert {r.x for r in series.points(table, 2, calendar_index=True).collect()} == set(range(17)) - {5}
    assert {r.x for r in series.points(table, 2).collect()} == set(range(16))


def welch(a, b):
    if len(a) < 2 or len(b) < 2:
        return 0.0
    den = (statistics.variance(a) / len(a) + statistics.variance(b) / len(b)) ** 0.5
    return abs(statistics.mean(a) - statistics.mean(b)) / den if den else 0.0


def test_kernel_matches_plain_loops():
    rng = np.random.default_rng(2)
    y, months = rng.standard_normal((5, 30)), np.array([i % 12 for i in range(30)])
    trend, split = inference._statistics(y, months)
    for k in range(5):
        means = {m: y[k][months == m].mean() for m in range(12)}
        d = [v - means[m] + y[k].mean() for v, m in zip(y[k], months, strict=True)]
        assert split[k] == pytest.approx(max(welch(d[:i], d[i:]) for i in range(4, 26)))
        b, a = np.polyfit(range(30), d, 1)
        ssr = sum((v - a - b * x) ** 2 for x, v in enumerate(d))
        assert trend[k] == pytest.approx(abs(b) / (ssr / 28 / sum((x - 14.5) ** 2 for x in range(30))) ** 0.5)


def test_flat_series_are_rarely_significant(spark):
    rng = random.Random(3)
    rows = [(f"s{k}", f"{2020 + i // 12}-{i % 12 + 1:02d}", rng.gauss(0, 1)) for k in range(80) for i in range(36)]
    got = inference.permutation_p(spark.createDataFrame(rows, "series_id string, period string, value double"), 99).collect()
    for p in ([r.p_trend for r in got], [r.p_split for r in got]):
        assert len(p) == 80 and sum(x <= 0.05 for x in p) <= 9 and 0.4 < sum(p) / 80 < 0.62


def test_false_discovery_values(spark):
    rows = spark.createDataFrame([("g", i, p) for i, p in enumerate([0.01, 0.02, 0.03, 0.04, 0.9])] + [("h", 9, 0.5)], "grid string, i int, p double")
    got = {r.i: r.q for r in inference.fdr(rows).collect()}
    assert [got[i] for i in range(5)] == pytest.approx([0.05, 0.05, 0.05, 0.05, 0.9]) and got[9] == 0.5
    assert inference.diagnostics(40, 799)["single_effect_reachable"] and not inference.diagnostics(40, 700)["single_effect_reachable"]


def test_bootstrap_interval_holds_the_slope(spark):
    rows = [(f"{2020 + i // 12}-{i % 12 + 1:02d}", "s", f"r{i}_{k}", "x" if k < 20 + i else "y", 1.0) for i in range(24) for k in range(60)]
    vectors = spark.createDataFrame(rows, "period string, stratum string, review_uid string, aspect string, w double")
    cell = vectors.groupBy("period", "stratum", "aspect").agg(F.sum("w").alias("w"))
    ref = spark.createDataFrame([("s", 1.0)], "stratum string, wref double")
    got = {r.aspect: r for r in inference.interval(inference.bootstrap_slopes(vectors, ref, cell.select("aspect").distinct(), 12)).collect()}
    assert 0 < got["x"].lo < got["x"].hi and got["y"].lo < got["y"].hi < 0


# ---------------------------------------------------------------- codec


def quad_array(*quads):
    return F.array(*[F.struct(F.lit(a).cast("string").alias("aspect_term"), F.lit(c).alias("taxonomy_code"), F.lit(o).cast("string").alias("opinion_term"), F.lit(s).alias("sentiment")) for a, c, o, s in quads])


def test_codec_round_trips(spark):
    quads = [("hồ bơi", "AM_POOL", "đẹp", "positive"), (None, "FAC_ROOM", "", "negative"), ("a | b", "AM_FOOD", "<quad> & </quad>", "neutral"), ("AM_POOL", "AM_POOL", "a&#124;b", "positive"), ("&amp;", "EXP_VALUE", "x", "positive")]
    target = codec.linearize(quad_array(*quads))
    got = one(spark, codec.parse_linearized(target))
    assert [(q.aspect_term, q.taxonomy_code, q.opinion_term, q.sentiment) for q in got] == [(a, c, o or None, s) for a, c, o, s in quads]
    assert got[1].aspect_implicit and got[1].opinion_implicit and got[0].aspect_category == "AMENITY"


@pytest.mark.parametrize(("raw", "want"), [
    ("<quad> giá | chất lượng | EXP_VALUE | tốt | positive </quad>", [("giá | chất lượng", "EXP_VALUE", "tốt")]), ("<quad> a | AM_POOL | b | x | y | negative </quad>", [("a", "AM_POOL", "b | x | y")]),
    ("<quad> AM_POOL | AM_FOOD | b | x | negative </quad>", []), ("<quad> a | NOPE | b | positive </quad>", []), ("<quad> a | AM_POOL | b | great </quad>", []), ("<quad> | AM_POOL | b | positive </quad>", []),
    ("nothing", []), ("", []), ("<quad> a | AM_POOL </quad> <quad> c | AM_POOL | d | neutral", [("c", "AM_POOL", "d")]), (None, []),
])
def test_rescue_and_malformed(spark, raw, want):
    got = one(spark, codec.parse_linearized(F.lit(raw).cast("string")))
    assert [(q.aspect_term, q.taxonomy_code, q.opinion_term) for q in got] == want


# ---------------------------------------------------------------- store, evaluation, weights, sampling


def test_leak_flags_match_nested_loops(spark):
    rng = random.Random(4)
    words = ["phòng sạch", "bể bơi", "x" * 150, "ok", ""]
    pool = [(i, rng.choice("ab"), rng.choice(words), rng.choice(words), f"2022-0{rng.randrange(1, 9)}-01") for i in range(120)]
    gold = [(rng.choice("ab"), rng.choice(words) + " " + rng.choice(words), f"2022-0{rng.randrange(1, 4)}-01") for _ in range(3)]
    got = store.leak_flags(spark.createDataFrame(pool, "i int, hotel string, pos string, neg string, d string"), spark.createDataFrame(gold, "hotel string, text string, d string"), "hotel", "pos", "neg", "d")
    key = lambda s: " ".join(s.split())[:120]
    for r in got.collect():
        want = any(h == r.hotel and (d == r.d or any(t and key(t) == key(g) for t in (r.pos, r.neg, f"{r.pos} {r.neg}".strip()))) for h, g, d in gold)
        assert r.in_gold == want
    assert got.count() == len(pool)


def test_bags(spark):
    gold = spark.createDataFrame([(1, "a", "positive", "c")] * 2 + [(2, "b", "negative", "c")], "instance_id int, key string, sentiment string, category string")
    predicted = spark.createDataFrame([(1, "a", "positive", "c")] * 3, gold.schema)
    r = evaluate.prf(evaluate.bag_counts(gold, predicted, "instance_id", "key", "sentiment", "category")).first()
    assert (r.gold, r.pred, r.hits, r.precision, r.recall, r.f1) == (3, 3, 2, 0.6667, 0.6667, 0.6667)
    inst = spark.createDataFrame([(1, "en", "L0"), (2, "other", "L1")], "instance_id int, language string, length string")
    assert evaluate.covers(evaluate.sliced(gold, predicted, inst), "language").first().covers


def test_default_score_and_bad_models(spark):
    row = lambda s: spark.createDataFrame([(5, s)], "n_words int, score double").select(reliability.propensity_features()[1].alias("x")).first().x
    assert row(0.0) == 0.0 and row(None) == config.DEFAULT_SCORE
    assert reliability.verdict(0.8, 0.1, 0.4, 30) == "GO" and reliability.verdict(0.8, 0.1, 0.4, 29) == "NO-GO" == reliability.verdict(None, 0.1, 0.4, 99)
    with pytest.raises(ValueError, match="features"):
        reliability.apply_weights(spark.range(1), F.lit(True), ([1.0], 0.0))
    assert one(spark, reliability.is_image(F.unhex(F.lit("FFD8FF" + "00" * 9)))) and not one(spark, reliability.is_image(F.unhex(F.lit("FFD8FF"))))


def test_logistic_fit_matches_newton(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((300, 2))
    y = (rng.random(300) < 1 / (1 + np.exp(-(x @ [1.0, -2.0] + 0.5)))).astype(float)
    w, b = reliability.fit_logistic(spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y, strict=True)], "a double, b double, y double"), ["a", "b"], "y")
    z, beta = np.column_stack([x, np.ones(300)]), np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ beta))
        pen = np.diag([1.0, 1.0, 0.0])
        beta -= np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + pen, z.T @ (p - y) + pen @ beta)
    assert [*w, b] == pytest.approx(beta.tolist(), abs=1e-4)


def test_samples_don_t_depend_on_partitions(spark):
    rows = spark.range(500).withColumn("cell", F.col("id") % 3)
    a = {r.id for r in sampling.stratified(rows, ["cell"], 30, 1, "id").collect()}
    assert a == {r.id for r in sampling.stratified(rows.repartition(7), ["cell"], 30, 1, "id").collect()} and len(a) == 30


def injected(spark, n=2000):
    rng = random.Random(6)
    rows = [(f"r{i // 2}", f"2022-{(i // 2) % 12 + 1:02d}", rng.choice(["VN", "WEST"]), "AM_FOOD", rng.choice(["positive", "negative"]), i) for i in range(n)]
    return spark.createDataFrame(rows, "review_uid string, period string, bloc string, taxonomy_code string, sentiment string, idx int")


def test_injections_change_only_what_they_claim(spark):
    quads = injected(spark)
    rows = set(map(tuple, quads.collect()))
    less = inject.composition(quads, F.col("bloc") == "VN", 1, "idx")
    got = list(map(tuple, less.collect()))
    assert set(got) <= rows and 0 < len(got) < len(rows)
    share = {r.period: r.s for r in less.groupBy("period").agg(F.avg((F.col("bloc") == "VN").cast("double")).alias("s")).collect()}
    assert share["2022-01"] > 0.7 > 0.3 > share["2022-12"]
    flipped = {r.idx: r for r in inject.valence(quads, "AM_FOOD", 0.5, "2022-06", 1, "idx").collect()}
    changed = [r for r in quads.collect() if flipped[r.idx].sentiment != r.sentiment]
    assert changed and all(r.period >= "2022-06" and r.sentiment == "positive" for r in changed)
    moved = inject.shuffle(quads, 3)
    assert moved.groupBy("review_uid").agg(F.count_distinct("period").alias("n")).where("n > 1").count() == 0
    count = lambda df: sorted((r.period, r["count"]) for r in df.groupBy("period").count().collect())
    assert count(moved) == count(quads) and moved.join(quads, ["idx", "period"]).count() < quads.count() / 2


def test_pseudo_labels_and_loop(spark):
    schema = "review_uid string, phi string, text string, conf_seq double, p_posterior double, aspect_term string, taxonomy_code string, opinion_term string, sentiment string, ord int"
    rows = [(f"r{i}", "POS", "t", 0.9 if i % 3 else 0.1, 0.9, "a", "AM_POOL", "o", "negative" if i % 2 else "positive", 0) for i in range(30)]
    quads = spark.createDataFrame(rows, schema)
    out = selftrain.pseudo_rows(quads, empty_ratio=0.5)
    assert out.where("n_quads > 0").count() == 20 and out.where("n_quads = 0").count() == 10
    scores = iter([0.5, 0.6, 0.55])
    gold = selftrain.pseudo_rows(quads, 0, 0)
    history = selftrain.loop(gold, lambda m, s: quads, lambda g, p: object(), lambda m: next(scores))
    assert [h["accepted"] for h in history] == [True, True, False] and history[-1]["stop"] == "no gain"


def test_drift_refuses_what_can_t_work(spark):
    quads = aggregate.with_taxonomy(injected(spark, 100).withColumn("stratum", F.col("bloc")).withColumn("phi", F.lit("NEG")).withColumn("w", F.lit(1.0)).withColumn("hotel_id", F.lit("h")))
    with pytest.raises(ValueError, match="cohort"):
        drift.drift(quads, cohort=spark.createDataFrame([], "hotel_id string"))
    with pytest.raises(ValueError, match="weight"):
        drift.drift(quads.withColumn("w", F.lit(0.0)))
    with pytest.raises(ValueError, match="on its own"):
        harness.valence_sweep(quads, "AM_WIFI", "2022-06", ("idx",))


def test_drift_finds_an_injected_change(spark):
    rng = random.Random(7)
    rows = []
    for m in range(36):
        for k in range(90):
            code = ("FAC_ROOM", "AM_POOL", "AM_FOOD")[k % 3]
            bad = rng.random() < (0.2 + 0.015 * m if code == "AM_FOOD" else 0.35)
            rows.append((f"r{m}_{k}", f"{2020 + m // 12}-{m % 12 + 1:02d}", rng.choice(["VN", "WEST"]), code, "negative" if bad else "positive", "POS", 1.0, "h"))
    quads = aggregate.with_taxonomy(spark.createDataFrame(rows, "review_uid string, period string, stratum string, taxonomy_code string, sentiment string, phi string, w double, hotel_id string"))
    got = {(r.aspect, r.channel): r for r in drift.drift(quads, n_perm=199).collect()}
    assert got["AM_FOOD", "val_adj"].significant and got["AM_FOOD", "val_adj"].slope_per_year > 0.1 and got["AM_FOOD", "val_adj"].verdict_val == "REAL"
    assert not got["FAC_ROOM", "val_adj"].significant


# ---------------------------------------------------------------- sources


def test_jsonl(spark, tmp_path):
    df = spark.createDataFrame([(1, "é|\n", None), (2, None, {"u": "c"})], "a int, b string, m map<string,string>")
    assert jsonl.write_jsonl(df, f"file://{tmp_path}/t") == 2
    assert sorted(r.a for r in jsonl.read_jsonl(spark, f"file://{tmp_path}/t", df.schema).collect()) == [1, 2]
    (tmp_path / "bad.jsonl").write_text('{"a": 1}\n\n{"a": ]\n')
    with pytest.raises(Exception, match="(?i)malformed"):
        jsonl.read_jsonl(spark, f"file://{tmp_path}/bad.jsonl", "a int").collect()
    lines = jsonl.with_line(spark.read.text(f"file://{tmp_path}/bad.jsonl")).collect()
    assert [r.line for r in lines] == [1, 2, 3]
    jsonl.save_model(spark, f"file://{tmp_path}/m", [1.0], 0.5, ["x"], "GO")
    assert jsonl.load_model(spark, f"file://{tmp_path}/m", ["x"]) == ([1.0], 0.5)
    with pytest.raises(ValueError, match="fitted"):
        jsonl.load_model(spark, f"file://{tmp_path}/m", ["y"])
    jsonl.save_model(spark, f"file://{tmp_path}/m", [1.0], 0.5, ["x"], "NO-GO")
    assert jsonl.load_model(spark, f"file://{tmp_path}/m", ["x"]) is None


def test_cli_runs_a_step_once(spark, tmp_path):
    from aspectdrift import cli

    injected(spark, 3000).withColumn("stratum", F.col("bloc")).withColumn("phi", F.lit("NEG")).withColumn("w", F.lit(1.0)).withColumn("hotel_id", F.lit("h")).write.parquet(f"{tmp_path}/quads")
    go = lambda **kw: cli.run(spark, "drift", f"file://{tmp_path}/quads", f"file://{tmp_path}/out", n_perm=19, **kw)
    assert go() and not go() and go(force=True)
    assert spark.read.parquet(f"{tmp_path}/out").where("channel = 'val_adj'").count() == 1


# ---------------------------------------------------------------- parsing of any script, fits, ranks, models


@pytest.mark.parametrize("raw, want", [
    ("ngày\u00a05 tháng\u20036\u00a0năm\u30002024", "2024-06-05"), ("ngày ٥ tháng ٦ năm ٢٠٢٤", "2024-06-05"), ("２０２４-０６-０５", "2024-06-05"), ("5\u00a0/6/2024", None), ("ngày5 tháng 6 năm 2024", None),
])
def test_dates_with_any_blanks_and_digits(spark, raw, want):
    assert one(spark, parse.review_date(F.lit(raw))["iso_date"]) == want


def test_nights_and_scores_of_any_script(spark):
    assert one(spark, parse.nights(F.lit("2\u00a0đêm"))) == 2 and one(spark, parse.nights(F.lit("١٢ đêm"))) == 12 and one(spark, parse.score(F.lit("Đạt điểm ９,５"))) == 9.5


def test_fields_with_any_blanks(spark):
    got = one(spark, codec.parse_linearized(F.lit("<quad> a |\tAM_POOL\t|\u00a0b | positive\n</quad>")))
    assert [(q.aspect_term, q.taxonomy_code, q.opinion_term, q.sentiment) for q in got] == [("a", "AM_POOL", "b", "positive")]


def test_logistic_fit_is_the_minimum(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.standard_normal((400, 3))
    y = (rng.random(400) < 1 / (1 + np.exp(-(x @ [1.5, -2, 0] + 0.3)))).astype(float)
    w = rng.random(400) + 0.1
    table = spark.createDataFrame([(*map(float, r), float(a), float(b)) for r, a, b in zip(x, y, w, strict=True)], "a double, b double, c double, y double, w double")
    coefficients, bias = reliability.fit_logistic(table, ["a", "b", "c"], "y", "w")
    p = 1 / (1 + np.exp(-(x @ coefficients + bias)))
    slope = x.T @ (w * (p - y)) + coefficients
    assert np.abs(slope).max() < 1e-6 and abs((w * (p - y)).sum()) < 1e-6
    with pytest.raises(ValueError, match="one class"):
        reliability.fit_logistic(table.withColumn("y", F.lit(1.0)), ["a"], "y")


def test_ranks_and_areas_match_plain_sorting(spark):
    rng = random.Random(6)
    rows = [(rng.randrange(40), rng.gauss(0, 1) if k % 3 else float(rng.randrange(5)), rng.randrange(2), "hot" if k % 4 else "b") for k in range(600)]
    table = spark.createDataFrame(rows, "a int, s double, y int, slice string")
    ranks = lambda v: [sum(u < x for u in v) + (sum(u == x for u in v) + 1) / 2 for x in v]
    ra, rs = ranks([r[0] for r in rows]), ranks([r[1] for r in rows])
    ma, ms = sum(ra) / 600, sum(rs) / 600
    rho = sum((p - ma) * (q - ms) for p, q in zip(ra, rs, strict=True)) / (sum((p - ma) ** 2 for p in ra) * sum((q - ms) ** 2 for q in rs)) ** 0.5
    got = evaluate.spearman(table, "a", "s").first()
    assert got.n == 600 and got.rho == pytest.approx(rho)
    for r in evaluate.auc(table, "s", "y", "slice").collect():
        own = [x for x in rows if x[3] == r.slice]
        pos, neg = [x[1] for x in own if x[2]], [x[1] for x in own if not x[2]]
        assert r.auc == pytest.approx(sum((p > q) + (p == q) / 2 for p in pos for q in neg) / len(pos) / len(neg)) and r.n == len(own)
    assert evaluate.gate(table.limit(10), "a", "s", 30, -1.0).first().verdict == "NO-GO"
    assert evaluate.spearman(table.limit(0), "a", "s").first().n == 0 and evaluate.auc(table.where("y = 1"), "s", "y").first().auc is None


def test_audit_takes_the_last_mark(spark):
    quads_ = spark.createDataFrame([("u", 1), ("v", 2), ("w", 3)], "quad_uid string, x int")
    audit = spark.createDataFrame([("u", 0, 1), ("u", 1, 2), ("v", None, 1), ("z", 1, 1)], "quad_uid string, correct int, at int")
    assert [(r.quad_uid, r.correct) for r in reliability.audited(quads_, audit, "at").collect()] == [("u", 1)]


def test_review_of_a_quad(spark):
    for name, want in (("r1_Q2", "r1"), ("a_Q1_Q12", "a_Q1"), ("r_Q1Q2", "r"), ("none", "none")):
        assert one(spark, reliability.review_of(F.lit(name))) == want


def test_refused_models_take_the_live_one_away(spark, tmp_path):
    path = f"file://{tmp_path}/bridge"
    assert jsonl.publish_model(spark, path, [1.0], 0.5, ["f"], "GO") == path and jsonl.load_model(spark, path, ["f"]) == ([1.0], 0.5)
    assert jsonl.publish_model(spark, path, [2.0], 0.5, ["f"], "NO-GO") == path + ".refused"
    assert not (tmp_path / "bridge").exists() and jsonl.load_model(spark, path + ".refused", ["f"]) is None


def test_lines_are_numbered_in_order(spark, tmp_path):
    rows = jsonl.with_line(spark.range(0, 1000, 1, 7).withColumn("line", F.lit("old")))
    assert [(r.id, r.line) for r in rows.orderBy("line").collect()] == [(k, k + 1) for k in range(1000)] and rows.columns == ["id", "line"]
    n = jsonl.write_generated(spark.range(50), lambda it: (b.assign(text="é") for b in it), "id long, text string", f"file://{tmp_path}/made")
    assert n == 50 and jsonl.read_jsonl(spark, f"file://{tmp_path}/made", "id long, text string").where("text = 'é'").count() == 50
    assert jsonl.head(spark.range(100), 3).count() == 3


def test_extractor_and_enrichment(spark):
    units = spark.createDataFrame([("u", "POS", "The pool and the food"), ("v", "NEG", "No food, no pools"), ("w", "POS", None)], "review_uid string, phi string, text string")
    got = lexicon.extract(units, {"AM_POOL": ["pool"], "AM_FOOD": ["food", "the food"]})
    assert sorted((r.review_uid, r.taxonomy_code, r.aspect_term, r.sentiment) for r in got.collect()) == [("u", "AM_FOOD", "the food", "positive"), ("u", "AM_POOL", "pool", "positive"), ("v", "AM_FOOD", "food", "negative")]
    rows = {r.review_uid + r.taxonomy_code: r for r in posterior.enriched(got).collect()}
    assert rows["vAM_FOOD"].sentiment == "negative" and not rows["vAM_FOOD"].p_model_exact and rows["uAM_POOL"].conf_seq == 1.0 and not rows["uAM_POOL"].provenance_flip


def test_poisson_draws_have_mean_and_variance_one(spark):
    r = spark.range(20000).select(inference.poisson_times((F.col("id") + 0.5) / 20000).alias("k")).agg(F.avg("k").alias("m"), F.var_pop("k").alias("v")).first()
    assert r.m == pytest.approx(1, abs=1e-3) and r.v == pytest.approx(1, abs=1e-2)


def test_final_runs_need_recall_and_permutations(spark):
    from aspectdrift.plans.drift import drift

    none = spark.createDataFrame([], "hotel_id string")
    with pytest.raises(ValueError, match="recall"):
        drift(none, final=True)


def test_scratch_folder_must_be_shared_on_a_cluster():
    from types import SimpleNamespace

    from aspectdrift.sources import scratch

    fake = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=SimpleNamespace(master="spark://a:7077"))
    with pytest.raises(ValueError, match="checkpoint"):
        scratch.folder(fake)


def raw_reviews(spark, n=1500):
    """Reviews of all months of the window, two hotels, some without date, some twice."""
    rng, rows = random.Random(8), []
    words = ["the breakfast", "our room", "wifi", "the staff", "a pool", "noise"]
    for k in range(n):
        y, m = divmod(2 + k % 36, 12)
        date = None if k % 97 == 0 else f"ngày {k % 28 + 1} tháng {m + 1} năm {2022 + y}"
        rows.append((f"h{k % 2}", f"guest {k}", date, " ".join(rng.sample(words, 2)) + " was fine", " and ".join(rng.sample(words, 3)) + " were bad", "Đạt điểm 9,0", rng.choice(["Pháp", "Việt Nam"]), "Nhóm", "2 đêm", None))
    schema = "hotel_id string, name string, review_date string, review_positive string, review_negative string, review_score string, country string, state string, date string, room string"
    return spark.createDataFrame([*rows, *rows[:50]], schema)


def test_all_steps_from_raw_reviews_to_verdicts(spark, tmp_path):
    from aspectdrift import cli

    raw_reviews(spark).repartition(3).write.parquet(f"{tmp_path}/raw")
    spark.createDataFrame([("h0", "r1", "the breakfast was fine"), ("h1", "r2", "x")], "hotel_id string, source_review_id string, text string").write.parquet(f"{tmp_path}/meta")
    spark.createDataFrame([("r1", "train"), ("r2", "test")], "source_review_id string, split string").write.parquet(f"{tmp_path}/splits")
    terms = [("breakfast", "AM_FOOD"), ("room", "FAC_ROOM"), ("staff", "SER_ATTITUDE"), ("pool", "AM_POOL")]
    spark.createDataFrame([x for x in terms for _ in range(4)], "aspect_term string, taxonomy_code string").write.parquet(f"{tmp_path}/quads")
    engine = config.EngineConfig(level="category", permutations=19, work_dir=f"file://{tmp_path}/work")
    go = lambda: cli.run_all(spark, f"file://{tmp_path}/raw", engine, f"file://{tmp_path}/quads", gold=f"file://{tmp_path}/meta", splits=f"file://{tmp_path}/splits")
    assert all(go().values()) and not any(go().values())
    read = lambda name: spark.read.parquet(engine.table(name))
    assert read("store").count() == 1500 - 16 and read("drift").where("channel = 'adj'").count() == 3 and read("verdicts").count() >= 1
    assert read("audit").count() > 0 and read("weights").where("w_source = 'conf_seq' AND w > 0").count() == read("extract").count()
    report = f"file://{tmp_path}/report.json"
    assert cli.run(spark, "store-report", f"file://{tmp_path}/raw", report, gold=f"file://{tmp_path}/meta", splits=f"file://{tmp_path}/splits")
    got = spark.read.option("multiLine", True).json(report).first()
    assert (got.read, got.drop_no_date, got.drop_dup, got.written) == (1550, 17, 49, 1484)
    quads_ = harness.smoke_quads(read("store"))
    late, early = (quads_.where(f"taxonomy_code = 'AM_FOOD' AND {c}").agg(F.avg((F.col("sentiment") == "negative").cast("double"))).first()[0] for c in ("period > '2024-08'", "period < '2022-09'"))
    assert late > early + 0.15 and quads_.select("taxonomy_code").distinct().count() == 5


def test_images_of_all_kinds(spark):
    heads = {b"\xff\xd8\xff" + bytes(9): True, b"\x89PNG\r\n\x1a\n" + bytes(4): True, b"GIF87a" + bytes(6): True, b"GIF89a" + bytes(6): True, b"BM" + bytes(10): True, b"RIFF\0\0\0\0WEBP": True,
             b"RIFF\0\0\0\0WAVE": False, b"\xff\xd8\xff": False, b"<html>" + bytes(20): False, b"": False}
    rows = spark.createDataFrame([(bytearray(k), v) for k, v in heads.items()], "content binary, want boolean")
    assert rows.where(reliability.is_image(F.col("content")) != F.col("want")).count() == 0


def test_intervals_and_collapsing(spark):
    cell = spark.createDataFrame([("p", "a", "x", 5.0, 1.0, 1.0, 1), ("p", "b", "x", 1.0, 1.0, 1.0, 2), ("p", "c", "x", 2.0, 0.0, 1.0, 1)], "period string, stratum string, aspect string, total double, neg double, complaint double, n_complaints long")
    got = {r.stratum: (r.total, r.neg, r.n_complaints) for r in aggregate.collapsed(cell, 3).collect()}
    assert got == {"a": (5.0, 1.0, 1), "other": (3.0, 1.0, 3)}
