"""python -m aspectdrift.cli STEP --in PATH --out PATH: run one step over tables, or `all` of them in order.

A step whose table is complete is skipped unless --force. An output that ends with .json is one small report, any other a
Parquet table. Inputs ending with .json, .jsonl or .gz are JSON lines.
"""

from __future__ import annotations

import argparse
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aspectdrift import config
from aspectdrift.functions.text import quad_uid
from aspectdrift.operators import aggregate, codec, evaluate, inference, lexicon, posterior, reliability, sampling, selftrain, store
from aspectdrift.plans import harness
from aspectdrift.plans.drift import drift
from aspectdrift.sources import jsonl

Options = dict[str, object]


def _read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path) if ".json" in path or path.endswith(".gz") else spark.read.parquet(path)


def _where(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def done(spark: SparkSession, path: str) -> bool:
    """Whether a step's table is complete: Spark leaves _SUCCESS last; a report is there as a whole or not."""
    fs, at = _where(spark, path if path.endswith(".json") else f"{path}/_SUCCESS")
    return fs.exists(at)


def _rated(rows: DataFrame) -> DataFrame:
    rows = rows if "reportable" in rows.columns else aggregate.with_taxonomy(rows)
    return rows if "stratum" in rows.columns else rows.withColumn("stratum", F.concat_ws("|", "country_bloc", "traveller"))


def _lexicon(spark: SparkSession, o: Options) -> dict[str, list[str]]:
    """Terms by code, out of gold quads."""
    mined = lexicon.mine(_read(spark, o["gold"])).where(F.col("code").isin(*config.code_to_category()))  # a few terms a code
    return {r.code: sorted(r.terms) for r in mined.groupBy("code").agg(F.collect_list("term").alias("terms")).collect()}


def _named(rows: DataFrame) -> DataFrame:
    return rows if "quad_uid" in rows.columns else rows.withColumn("quad_uid", quad_uid(F.col("review_uid"), F.col("phi"), F.col("taxonomy_code"), F.col("opinion_term")))


def _store(spark, rows, o):
    return store.store(rows if "line" in rows.columns else jsonl.with_line(rows), *store.gold_sides(_read(spark, o["gold"]), _read(spark, o["splits"])))


def _store_report(spark, rows, o):
    statuses = store.status(rows if "line" in rows.columns else jsonl.with_line(rows))
    return store.report(statuses, store.stored(statuses, *store.gold_sides(_read(spark, o["gold"]), _read(spark, o["splits"]))))


def _cohorts(spark, rows, o):
    return store.cohorts(store.hotel_counts(rows), store.gold_sides(_read(spark, o["gold"]), _read(spark, o["splits"]))[1])


def _extract(spark, rows, o):
    return posterior.enriched(lexicon.extract(store.units(rows).join(rows.drop("text_pos", "text_neg"), "review_uid"), _lexicon(spark, o)))


def _data(spark, rows, o):
    return codec.training_rows(codec.dated(rows, _read(spark, o["gold"])) if o["gold"] else rows)


def _data_report(spark, rows, o):
    made = codec.training_rows(rows).withColumn("n_parsed", F.size(codec.parse_linearized(F.col("target"))))
    split = rows.select("instance_id", "split") if "split" in rows.columns else rows.select("instance_id", F.lit("all").alias("split"))
    return codec.data_report(made.join(split, "instance_id"))


def _eval(spark, rows, o):
    return evaluate.prf(evaluate.bag_counts(_read(spark, o["gold"]), rows, "instance_id", "key"))


def _pseudo(spark, rows, o):
    return selftrain.pseudo_rows(rows, seed=o["seed"])


def _audit(spark, rows, o):
    return sampling.quad_sample(_named(rows), 300, o["seed"])


def _d0(spark, rows, o):
    return sampling.review_sample(rows, 300, o["seed"])


def _bridge(spark, rows, o):
    """Fit on scored quads, measure against the audit, publish or take away; the report says what happened."""
    model = reliability.fit_bridge(reliability.ipw(rows) if "ipw" not in rows.columns else rows)
    report = reliability.bridge_gate(_named(rows), _read(spark, o["gold"]).withColumn("at", F.monotonically_increasing_id()), model, "at")
    jsonl.publish_model(spark, o["model"], *model, list(reliability.FEATURES), report.first().verdict)
    return report


def _weights(spark, rows, o):
    model = jsonl.load_model(spark, o["model"], list(reliability.FEATURES)) if o["model"] and done(spark, o["model"]) else None
    return reliability.apply_weights(rows, rows["taxonomy_code"].isin(*config.code_to_category()), model)


def _drift(spark, rows, o):
    hotels = _read(spark, o["cohort"]) if o["cohort"] else None
    recall = _read(spark, o["recall"]) if o["recall"] else None
    return drift(_rated(rows), o["level"], hotels, o["n_perm"], o["n_boot"], seed=o["seed"], recall=recall, final=o["final"])


def _inject(spark, rows, o):
    run = {"level": o["level"], "n_perm": o["n_perm"], "seed": o["seed"]}
    key = ("review_uid", "phi", "taxonomy_code", "opinion_term", "aspect_term")
    if o["test"] == "composition":
        return harness.composition_test(_rated(rows), F.col("country_bloc") == "VN", key, **run)
    if o["test"] == "valence":
        return harness.valence_sweep(_rated(rows), o["aspect"], o["start"], key, **run)
    return harness.shuffle_control(_rated(rows), **run)


def _smoke(spark, rows, o):
    return harness.smoke_quads(rows, o["seed"])


def _verdicts(spark, rows, o):
    return inference.verdict_counts(rows)


STEPS: dict[str, Callable[[SparkSession, DataFrame, Options], DataFrame]] = {
    "store": _store, "store-report": _store_report, "cohorts": _cohorts, "units": lambda spark, rows, o: store.units(rows), "extract": _extract, "data": _data, "data-report": _data_report, "eval": _eval,
    "pseudo": _pseudo, "d0": _d0, "audit": _audit, "bridge": _bridge, "weights": _weights, "drift": _drift, "verdicts": _verdicts, "smoke": _smoke, "inject": _inject,
}
#: What `all` runs, each on the table of the one named: raw reviews come in, the drift report comes out.
ORDER = (("store", None), ("cohorts", "store"), ("d0", "store"), ("extract", "store"), ("audit", "extract"), ("weights", "extract"), ("drift", "weights"), ("verdicts", "drift"))
DEFAULTS: Options = {"gold": None, "splits": None, "cohort": None, "model": None, "recall": None, "level": "taxonomy_code", "n_perm": config.PERMUTATIONS, "n_boot": 0, "seed": config.SEED, "final": False, "test": "shuffle", "aspect": None, "start": None}


def run(spark: SparkSession, step: str, source: str, out: str, force: bool = False, **options) -> bool:
    """True if the step ran, False if its table was there already."""
    if step not in STEPS:
        raise ValueError(f"no step {step}")
    if not force and done(spark, out):
        return False
    result = STEPS[step](spark, _read(spark, source), DEFAULTS | options)
    if out.endswith(".json"):
        jsonl.write_report(result, out)
    else:
        result.write.mode("overwrite").parquet(out)
    return True


def run_all(spark: SparkSession, source: str, engine: config.EngineConfig, quads: str | None = None, force: bool = False, **options) -> dict[str, bool]:
    """All steps in order under the engine's folder; quads, gold quads to mine terms from, stand in for gold in `extract`. Which ones ran."""
    ran = {}
    settings = {"level": engine.level, "n_perm": engine.permutations, "n_boot": engine.bootstraps, "seed": engine.seed} | options
    for step, on in ORDER:
        own = settings | ({"gold": quads} if step == "extract" else {})
        ran[step] = run(spark, step, engine.table(on) if on else source, engine.table(step), force, **own)
    return ran


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("step", choices=("all", *STEPS))
    p.add_argument("--in", dest="source", required=True)
    p.add_argument("--out", required=True)
    for name in ("gold", "splits", "cohort", "model", "recall", "quads", "aspect", "start"):
        p.add_argument(f"--{name}")
    p.add_argument("--test", default="shuffle", choices=("composition", "valence", "shuffle"))
    p.add_argument("--level", default="taxonomy_code", choices=("taxonomy_code", "category"))
    p.add_argument("--n-perm", type=int, default=config.PERMUTATIONS)
    p.add_argument("--n-boot", type=int, default=0)
    p.add_argument("--seed", type=int, default=config.SEED)
    p.add_argument("--final", action="store_true")
    p.add_argument("--force", action="store_true")
    a = vars(p.parse_args(args))
    step, source, out, quads = (a.pop(k) for k in ("step", "source", "out", "quads"))
    spark = SparkSession.builder.appName("aspectdrift").getOrCreate()
    if step == "all":
        engine = config.EngineConfig(level=a["level"], permutations=a["n_perm"], bootstraps=a["n_boot"], seed=a["seed"], work_dir=out)
        print(run_all(spark, source, engine, quads, a.pop("force"), **a))
    else:
        print("ran" if run(spark, step, source, out, **a) else "was done")


if __name__ == "__main__":
    main()
