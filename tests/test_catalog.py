import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent.parent / "tools"))

import check_oracles  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from tidemark.catalog import queries  # noqa: E402

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="needs the test tables")


@pytest.fixture(scope="module")
def db():
    connection = check_oracles.connect(FOLDER)
    yield connection
    connection.close()


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_its_sql(spark, db, name):
    verdict = check_oracles.compare(spark, db, FOLDER, name)
    assert verdict.startswith("equal") and "TYPES" not in verdict, verdict


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["series_id", "model", "t", "prediction", "lower_conf", "upper_conf"] and df.count() > 0


@pytest.mark.parametrize("name", ["q_pivot_scenarios_by_season", "q_fold_summary_by_season"])
def test_every_season_is_kept(spark, name):
    assert {r.season for r in entry.queries()[name](spark, FOLDER).select("season").distinct().collect()} == {20, 50, 100}


def test_search_runs_the_documented_share(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(queries.search, "run_search", lambda rows, spec, configs, *_, **__: seen.extend(configs) or spark.range(0))
    queries._searched.__wrapped__(spark, FOLDER)
    assert len(seen) == len({c["config_id"] for c in seen}) == 1958 == int(0.1 * queries.search.grid_size())


def test_prepared_features_are_the_defaults(spark):
    names = entry.queries()["q_prepare"](spark, FOLDER).columns
    assert all(f"stat_y_lag{k}" in names for k in (1, 2, 3, 4, 5, 6, 7, 14)) and "cal_Karfreitag_Counter" in names


def test_entry_without_what_only_the_text_operators_need(monkeypatch):
    import importlib

    gone = ("tidemark.llm", "corpus_pipeline", "public_tokenizers")
    for name in [m for m in sys.modules if m.startswith(gone)]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "public_tokenizers", None)
    try:
        bare = importlib.reload(entry)
        assert bare.text_queries is None and bare.corpus_pipeline is None and "q_lags" in bare.queries()
    finally:
        monkeypatch.undo()
        importlib.reload(entry)


def test_entry_does_not_hide_other_missing_modules(monkeypatch):
    monkeypatch.setattr(entry, "OPTIONAL", ("nothing",))
    with pytest.raises(ModuleNotFoundError):
        entry._optional("tidemark.llm_missing")
