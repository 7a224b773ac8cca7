"""The entry points, and registered queries against their SQL twins."""

import os

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tools.check_queries import TABLES, canonical

FOLDER = "/root/testdata/sf0.001"
# All of them with MOVELENS_ALL=1; tools/check_queries.py does the same at any size.
SAMPLE = [
    "spell_builder", "window_stats_pre_post", "asof_nearest_tolerance", "baseline_fallback_lookup", "pct_rank_joint",
    "report_card_full", "cross_region_flow", "binned_trend_by_group", "alias_canonical", "loo_explanation",
    "similar_subjects", "oof_predictions", "scoring_spells", "scoring_moves", "scoring_loans", "csv_round_trip", "history_flatten", "loan_facts",
    "form_vs_own_league", "league_leaderboard", "snapshot_scenarios", "weight_profiles",
]
NAMES = sorted(oracle_sql()) if os.environ.get("MOVELENS_ALL") else SAMPLE

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


def test_every_twin_has_a_query():
    assert set(oracle_sql()) <= set(queries())
    assert len(queries()) >= 100


def test_entry(spark):
    df = entry(spark)
    assert df.columns[:3] == ["event_id", "user_id", "segment"] and df.count() > 0


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    df = queries()[name](spark, FOLDER)
    result = con.execute(oracle_sql()[name])
    columns = [c[0] for c in result.description]
    assert sorted(df.columns) == sorted(columns)
    assert canonical([tuple(r) for r in df.collect()], df.columns) == canonical(result.fetchall(), columns)


def test_other_queries_work_without_the_optional_parts(tmp_path):
    """A copy without the training-data folder and the pipeline registers everything else."""
    import shutil
    import subprocess
    import sys

    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copy(os.path.join(here, "__spark_entry__.py"), tmp_path)
    shutil.copytree(os.path.join(here, "movelens"), tmp_path / "movelens", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    said = subprocess.run(
        [sys.executable, "-c", "import __spark_entry__ as e; print(*sorted(e.queries()))"], cwd=tmp_path, capture_output=True, text=True, timeout=120,
        env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    names = said.stdout.split()
    assert len(names) >= 140 and not [n for n in names if n.startswith("op") and "_" in n and n.split("_")[0][2:].isdigit()] and "pipeline" not in names
