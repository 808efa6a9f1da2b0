"""Every query with oracle SQL gives DuckDB's rows; the others run; the entry point works without the optional part."""

import hashlib
import inspect
import subprocess
import sys
from pathlib import Path

import oracle
import pytest

from aspectdrift import catalog
from aspectdrift.operators import inference
from aspectdrift.plans import harness

SF = "/root/testdata/sf0.001"
SLOW = {"composition_test", "valence_sweep", "shuffle_control", "drift_report_bootstrap"}


@pytest.fixture(scope="module")
def con():
    return oracle.duck(SF)


@pytest.mark.parametrize("name", sorted(set(catalog.ORACLE_SQL) - SLOW))
def test_query_matches_oracle(spark, con, name):
    assert oracle.compare(spark, con, name, catalog.QUERIES[name], catalog.ORACLE_SQL[name], SF) is None


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLE_SQL)


def units_by_hand(docs, labelled):
    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
    return sorted((k, phi, md5(t)) for k, text, source in docs if k not in labelled for phi, t in (("POS", text), ("NEG", source)) if t)


def test_units_of_odd_rows(spark, tmp_path):
    odd = [(1, "x" * 5000, "web"), (2, None, "web"), (3, "", ""), (4, "short", None), (6, "labelled", "web"), (9, "é\U0001f600" * 30, "books")]
    spark.createDataFrame(odd, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(6, 1), (6, 0)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    assert sorted(map(tuple, catalog.QUERIES["unpivot_units"](spark, str(tmp_path)).collect())) == units_by_hand(odd, {6})


@pytest.mark.parametrize("name", ["composition_test", "drift_report", "drift_report_bootstrap", "shuffle_control", "valence_sweep"])
def test_permutations_suffice_for_a_single_effect(spark, monkeypatch, name):
    class Seen(Exception):
        pass

    def look(rows, n_perm, seed):
        raise Seen(rows.where("channel IN ('adj', 'val_adj')").select("series_id").distinct().count(), n_perm)

    monkeypatch.setattr(inference, "permutation_p", look)
    with pytest.raises(Seen) as seen:
        catalog.QUERIES[name](spark, SF)
    m, n_perm = seen.value.args
    assert m >= 12 and inference.diagnostics(m, n_perm)["single_effect_reachable"]


@pytest.mark.parametrize("name, arg", [("valence_sweep", "deltas"), ("shuffle_control", "repeats")])
def test_harness_queries_run_all_deltas_and_repeats(spark, monkeypatch, name, arg):
    shape, calls = inspect.signature(getattr(harness, name)), []
    monkeypatch.setattr(harness, name, lambda *a, **k: calls.append(shape.bind(*a, **k)) or spark.createDataFrame([(0.0,)], "mean_rate double"))
    catalog.QUERIES[name](spark, SF)
    assert calls[0].arguments.get(arg, shape.parameters[arg].default) == shape.parameters[arg].default


def test_nothing_else_imports_the_optional_part():
    root = Path(__file__).resolve().parent.parent
    used = [p for p in (root / "aspectdrift").rglob("*.py") if "llm" not in p.relative_to(root).parts and "llm" in p.read_text()]
    assert not used


def test_entry_point_without_the_optional_part():
    code = "import sys; sys.modules['aspectdrift.llm'] = None\nimport __spark_entry__ as e\nassert len(e.queries()) > 50 and not any(q[:2] == 'op' and q[2].isdigit() for q in e.queries())"
    root = Path(__file__).resolve().parent.parent
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)
