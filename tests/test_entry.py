"""The registered queries: complete, and a sample of them against their SQL twins."""

import duckdb
import pytest

import __spark_entry__ as entry
from loreworks.plans.tables import RAW

SF = "/root/testdata/sf0.001"
SAMPLE = ["c16_incremental_diff", "q10_weighted_rrf", "e06_latency_stats", "g04_node_states", "l11_pair_tool_calls", "p06_briefing_totals", "t02_find_cycles", "m09_prior_attempts", "a03_replay_policy", "w08_event_rates"]


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["qid", "chunk_id", "score", "rank"] and df.limit(1).count() == 1


def test_every_twin_has_a_query():
    assert set(entry.twins()) <= set(entry.queries())


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_its_twin(spark, name):
    con = duckdb.connect()
    for table in RAW:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    show = lambda v: round(v, 6) + 0.0 if isinstance(v, float) else v
    ours = sorted(repr(tuple(show(r[c]) for c in cols)) for r in df.collect())
    rel = con.sql(entry.twins()[name])
    order = [rel.columns.index(c) for c in cols]
    theirs = sorted(repr(tuple(show(r[i]) for i in order)) for r in rel.fetchall())
    assert ours == theirs


def test_empty_texts_have_no_chunks_in_spark_and_sql(spark, tmp_path):
    texts = ["", None, " ", "a" * 800, "b" * 801, ""]
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    docs = [(i, x, "en", "src1", len(x or "")) for i, x in enumerate(texts)]
    spark.createDataFrame(docs, columns).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("c02_chunk_id", "c06_approx_tokens", "c22_script_census", "c25_fingerprint", "e11_overflow_report"):
        df = entry.queries()[name](spark, str(tmp_path))
        rel = con.sql(entry.twins()[name])
        assert sorted(map(tuple, df.select(rel.columns).collect())) == sorted(rel.fetchall()), name
