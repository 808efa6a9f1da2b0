"""What must not grow faster than the input: rows are read once, work is shared, tasks stay small."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from aspectdrift import catalog
from aspectdrift.functions import text
from aspectdrift.operators import aggregate, codec, evaluate, inference, reliability, sampling, store
from aspectdrift.plans import harness, quad_view, text_queries


def counted(spark, df):
    """df that counts, in an accumulator, how many of its rows are worked out."""
    seen = spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    return df.mapInArrow(run, df.schema), seen


VECTORS = [("2020-01", "s", "a", "x", 1.0), ("2020-01", "s", "a", "x", 0.5), ("2020-01", "t", "é", "y", 2.0), ("2020-02", "s", None, "x", 1.0), ("2020-02", "t", "b", "y", 0.25), ("2020-02", "t", "c", "x", 3.0)]


def test_bootstrap_draws_once_and_as_by_hand(spark):
    rows, seen = counted(spark, spark.createDataFrame(VECTORS, "period string, stratum string, review_uid string, aspect string, w double"))
    ref = spark.createDataFrame([("s", 0.5), ("t", 0.5)], "stratum string, wref double")
    got = inference.bootstrap_shares(rows, ref, spark.createDataFrame([("x",), ("y",)], "aspect string"), 6, 7, 0.0).collect()
    assert seen.value == len(VECTORS)
    steps = inference._poisson_steps()
    want = {}
    for b in range(1, 7):
        cells = {}
        for p, s, uid, a, w in VECTORS:
            h = hashlib.md5(("7|%d" % ((b - 1) // 4) + ("" if uid is None else f"|{uid}")).encode()).hexdigest()
            u = int(h[8 * ((b - 1) % 4):][:8], 16) / 2**32
            cells[p, s, a] = cells.get((p, s, a), 0) + w * sum(u >= x for x in steps)
        for p in ("2020-01", "2020-02"):
            of = lambda s, a: cells.get((p, s, a), 0)  # noqa: E731,B023
            whole = sum(of(s, a) for s in "st" for a in "xy")
            if not whole:
                continue
            share = lambda s, a: of(s, a) / (of(s, "x") + of(s, "y")) if of(s, "x") + of(s, "y") else (of("s", a) + of("t", a)) / whole  # noqa: E731,B023
            want |= {(b, p, a): (share("s", a) + share("t", a)) / 2 for a in "xy"}
    assert {(r.b, r.period, r.aspect): r.adj for r in got} == pytest.approx(want)


def test_bootstrap_cells_leave_a_task_in_parts(monkeypatch):
    import pyarrow as pa

    whole = pa.RecordBatch.from_pylist([dict(zip(("period", "stratum", "aspect", "review_uid", "w"), (p, s, a, u, w), strict=True)) for p, s, u, a, w in VECTORS])
    def total():
        sums = {}
        for out in inference._drawn(iter([whole, whole.slice(2)]), 6, 7):
            for r in out.to_pylist():
                k = r["period"], r["stratum"], r["aspect"]
                sums[k] = sums.get(k, 0) + np.array(r["sums"])
        return {k: list(v) for k, v in sums.items()}
    once = total()
    monkeypatch.setattr(inference, "HELD", 12)
    monkeypatch.setattr(inference, "AT_ONCE", 6)
    assert total() == once and len(once) == 5


def test_poisson_counts_are_the_columns(spark):
    bits = np.array([0, 1, 1580030168, 1580030169, 3160060337, 4294967295, 4294967000], np.uint32)
    rows = spark.createDataFrame([(int(b),) for b in bits], "b long").select("b", inference.poisson_times(F.col("b") / float(1 << 32)).alias("k"))
    assert {r.b: r.k for r in rows.collect()} == dict(zip(map(int, bits), map(int, inference.poisson_counts(bits)), strict=True))


def test_stratified_sample_reads_its_rows_once(spark):
    rows, seen = counted(spark, spark.range(500).select("id", (F.col("id") % 7).alias("cell")))
    assert len(sampling.stratified(rows, ["cell"], 30, 1, "id").collect()) == 28 and seen.value == 500


ODD = ["", "a", "x" * 500, "é, " * 400, "Ångström ﬁ " * 90, "-" * 500 + "late words", "a\u0301" * 300, "word " * 71 + "e\u0301 after", "Σ" * 130 + "ΑΣ", "İ" * 200, "日本語。" * 100, "ﬀ" * 500, "a" * 359 + "\u0301b", "! a" * 200]


def test_start_of_a_normal_form_is_that_of_the_whole(spark):
    draw = random.Random(3)
    texts = ODD + ["".join(draw.choice(["a", "B", " ", "é", ".", "ﬁ", "\u0301", "_", "9", "word"]) for _ in range(draw.randrange(600))) for _ in range(200)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = rows.select(text.norm_start(F.col("t"), 120).alias("a"), F.substring(text.norm_text(F.col("t")), 1, 120).alias("b"), text.unstable(F.col("t")).alias("u"), F.col("t").rlike(f"[^{text.STABLE}]").alias("v")).collect()
    assert all(r.a == r.b and r.u == r.v for r in got)


def test_rows_without_a_leak_key_do_not_meet_in_one_task(spark):
    pool = spark.range(4000).select("id", F.lit("h").alias("hotel"), F.concat(F.lit("text "), "id").alias("pos"), F.lit("").alias("neg"))
    gold = spark.createDataFrame([("h", "text 7"), ("h", "")], "hotel string, text string")
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        out = store.leak_flags(pool, gold, "hotel", "pos", "neg")
        assert [r.id for r in out.where("in_gold").collect()] == [7]
        cut = store.flagged(pool.withColumn("k", F.lit("")), gold, "hotel", [F.col("k")])  # the last join is the only one
        assert cut.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < 2000
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_statuses_carry_starts_of_normal_forms_only(spark):
    rows = spark.createDataFrame([(1, "h", "n", "2023-01-05", "Good " * 300, None)], "line long, hotel_id string, name string, review_date string, review_positive string, review_negative string")
    got = store.status(rows)
    assert not {"norm_pos", "norm_neg"} & set(got.columns) and got.select(F.length("leak_pos")).first()[0] == store.LEAK_CHARS


SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["slice_covers", "prf_slices", "audit_gate"])
def test_query_joins_the_star_once(spark, monkeypatch, name):
    rows, seen = counted(spark, quad_view.quads(spark, SF))
    monkeypatch.setattr(text_queries, "quads", lambda *_: rows)
    assert catalog.QUERIES[name](spark, SF).collect() and seen.value == quad_view.quads(spark, SF).count()


@pytest.mark.parametrize("run", [
    lambda q: harness.shuffle_control(q), lambda q: harness.valence_sweep(q, "SMALL_1", "1998-06", text_queries.KEY), lambda q: harness.composition_test(q, F.col("bloc") == "ASIA", text_queries.KEY)])
def test_injected_runs_read_quads_once(spark, monkeypatch, run):
    def drift(q, **_):
        return q.groupBy(F.lit("adj").alias("channel"), F.lit("SMALL_1").alias("aspect"), F.lit("1998-06").alias("changepoint")).agg((F.count("*") < 0).alias("significant"))

    rows, seen = counted(spark, quad_view.quads(spark, SF))
    monkeypatch.setattr(harness, "drift", drift)
    run(rows).collect()
    # a sweep first looks whether the code is there at all
    assert quad_view.quads(spark, SF).count() <= seen.value < 2 * quad_view.quads(spark, SF).count() + 1


def test_pairs_and_ranks_read_their_rows_once(spark):
    quads, seen = counted(spark, spark.range(60).select(F.concat(F.col("id") % 9, F.lit("_Q"), "id").alias("quad_id"), F.concat(F.lit("c"), F.col("id") % 4).alias("category")))
    images = spark.range(9).select(F.col("id").cast("string").alias("review"), F.col("id").cast("string").alias("image"))
    cats, splits = spark.createDataFrame([(f"c{i}",) for i in range(9)], "category string"), spark.createDataFrame([("1", "test")], "review string, split string")
    assert reliability.verifier_pairs(images, quads, splits, cats, 1).count() and seen.value == 60
    pairs, seen = counted(spark, spark.range(50).select("id", (F.col("id") % 7).alias("b")))
    assert evaluate.spearman(pairs, "id", "b").first().n == 50 and seen.value == 50
    scored, seen = counted(spark, spark.range(50).select("id", (F.col("id") % 2).cast("int").alias("y")))
    assert evaluate.auc(scored, "id", "y").first().n == 50 and seen.value == 50


def test_bags_move_before_they_are_counted_and_nulls_equal_nothing(spark):
    gold = spark.createDataFrame([("a", "x"), ("a", "x"), ("a", None), ("b", "y")], "i string, k string")
    predicted = spark.createDataFrame([("a", "x"), ("a", None), ("c", "y")], "i string, k string")
    counts = evaluate.bag_counts(gold, predicted, "i", "k")
    assert sorted(map(str, counts.collect())) == sorted(map(str, (spark.createDataFrame([("a", "x", 2, 1, 1), ("a", None, 1, 0, 0), ("a", None, 0, 1, 0), ("b", "y", 1, 0, 0), ("c", "y", 0, 1, 0)], "i string, k string, gold long, pred long, hits long").collect())))
    for rows in (counts, catalog.QUERIES["quad_names"](spark, SF), catalog.QUERIES["bag_intersection"](spark, SF)):
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "REPARTITION_BY_COL" in plan and "FullOuter" not in plan and "ReplicateRows" not in plan


def test_codec_parse_holds_no_group_and_parses_in_batches(spark):
    plan = text_queries.QUERIES["codec_parse"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "sort_array" not in plan and "lambda" not in plan


def test_joined_md5_is_that_of_the_sorted_terms(spark):
    rows = [(i % 3, str(i * 7919 % 1000), f"é{i}" if i % 5 else None) for i in range(400)] + [(4, "1", "only")]
    df = spark.createDataFrame(rows, "number int, k string, t string").repartition(5)
    got = {r.number: (r.n, r.md5) for r in aggregate.joined_md5(df, 6, ["k"], F.concat_ws("/", "k", "t")).collect()}
    want = {}
    for g in (0, 1, 2, 4):
        terms = ["/".join(filter(None, r[1:])) for r in sorted((r for r in rows if r[0] == g), key=lambda r: r[1])]
        want[g] = len(terms), hashlib.md5(";".join(terms).encode()).hexdigest()
    assert got == want


def test_joined_md5_takes_groups_in_turn_over_batches():
    import pyarrow as pa

    whole = pa.RecordBatch.from_pydict({"number": pa.array([2, 2, 1, 2, 1, 1], pa.int32()), "term": [";a", ";", ";é", ";b", ";c", ";d"]})
    out = [r for b in aggregate._hashed(iter([whole.slice(0, 2), whole.slice(2, 3), whole.slice(5), whole.slice(6)])) for r in b.to_pylist()]
    assert {r["number"]: (r["n"], r["md5"]) for r in out} == {2: (3, hashlib.md5(b"a;;b").hexdigest()), 1: (3, hashlib.md5("é;c;d".encode()).hexdigest())}
    assert list(aggregate._hashed(iter([whole.slice(6)]))) == []


def parsed_by_hand(target, table):
    out = []
    for chunk in target.split("<quad>")[1:] if target is not None else []:
        f = [x.strip(text.SPACES) for x in chunk.split("</quad>")[0].strip(text.SPACES).split("|")]
        at = [1] if len(f) == 4 else [i for i, x in enumerate(f[:-1]) if x in table]
        if len(f) < 4 or len(at) != 1 or f[at[0]] not in table or f[-1] not in ("positive", "neutral", "negative"):
            continue
        a, o = (" | ".join(x).strip(text.SPACES) for x in (f[: at[0]], f[at[0] + 1 : -1]))
        for plain, code in reversed(codec.ESCAPES):
            a, o = a.replace(code, plain), o.replace(code, plain)
        if a and o:
            out.append((None if a == "NULL" else a, f[at[0]], table[f[at[0]]], None if o == "NULL" else o, f[-1], a == "NULL", o == "NULL"))
    return out


def test_parser_reads_as_by_hand(spark):
    table, rng = {"C_1": "C", "D": "É"}, random.Random(3)
    piece = ["<quad>", "</quad>", "|", "|", "|", "C_1", "D", "positive", "negative", "x", "é\U0001F600", " ", "\t", "\u3000", "\x1c", "&amp;", "&#124;", "&lt;quad&gt;", "&amp;lt;quad&gt;", "NULL", "<", "quad>"]
    good = ["<quad>", " ", "a", " ", "|", "\u00a0", "C_1", " ", "|", "b", "|", "\n", "positive", "\u3000", "</quad>"]
    made = ["".join(rng.choice(piece) for _ in range(rng.randrange(40))) for _ in range(1500)]
    for _ in range(3000):  # nearly whole ones
        parts = good * rng.randrange(1, 4)
        for _ in range(rng.randrange(4)):
            i = rng.randrange(len(parts))
            parts[i : i + rng.randrange(2)] = [rng.choice(piece)]
        made.append("".join(parts))
    made += [None, "", "<quad>", "a | C_1 | b | positive", None]
    df = spark.createDataFrame(list(enumerate(made)), "i int, t string").select("i", codec.parse_linearized(F.col("t"), table).alias("q"))
    assert df.schema["q"].dataType.simpleString() == codec.PARSED
    got = {r.i: [tuple(q) for q in r.q] for r in df.collect()}
    want = {i: parsed_by_hand(t, table) for i, t in enumerate(made)}
    assert got == want and sum(map(len, want.values())) > 1000 and any("|" in q[0] for qs in want.values() for q in qs if q[0])


def test_parser_takes_empty_batches_and_broken_utf8(spark):
    assert codec.parsed(codec.pa.array([], "string"), {"C": "C"}).to_pylist() == [] and codec.parsed(codec.pa.array([None, "x"]), {"C": "C"}).to_pylist() == [[], []]
    raw = spark.sql("SELECT CAST(X'3C717561643E61FF7C437C627C706F736974697665' AS STRING) AS t")
    assert [tuple(q)[:2] for q in raw.select(codec.parse_linearized(F.col("t"), {"C": "C"})).first()[0]] == [("a\ufffd", "C")]
