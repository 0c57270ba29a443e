"""The pipeline's stages on the smallest tables and on odd rows, and every query with SQL against DuckDB."""

import string

import duckdb
import pytest

import corpus_pipeline
from atalaya.llm import common, queries
from test_jaccard import slow_set
from test_near import roots

SF = "/root/testdata/sf0.001"
FOLD = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
STAGES = dict(corpus_pipeline.STAGES)


def test_stages_equal_brute_force(spark):
    docs = common.table(spark, SF, "documents")
    columns = docs.columns
    found = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = common.stored(stage(spark, docs, SF), "test")
        found[name] = docs.collect()
        assert name == "packing" or docs.columns == columns
    kept = {r.doc_id: r.text for r in found["language"]}
    last = {}
    for i, t in sorted(kept.items()):
        last[(t or "").translate(FOLD)] = i
    assert {r.doc_id for r in found["exact dedup"]} == set(last.values())
    sets = {i: slow_set(kept[i]) for i in last.values()}
    near = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9]
    assert {r.doc_id for r in found["near dedup"]} == set(roots(near, sets).values())
    mixed = [r.doc_id for r in found["source mixing"]]
    assert len(set(mixed)) == len(mixed) and set(mixed) < {r.doc_id for r in found["near dedup"]}
    assert {r.doc_id for r in found["packing"]} == set(mixed)


def test_stages_take_odd_and_empty_tables(spark, odd_docs, no_docs):
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, odd_docs, SF).collect()
        assert stage(spark, no_docs, SF).count() == 0
    rest = STAGES["language"](spark, odd_docs, SF).collect()
    assert not {3, 4, 5, 10} & {r.doc_id for r in rest}


def plain(row):
    return tuple(repr(round(x, 9)) if isinstance(x, float) else str(x) for x in row)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    columns = ", ".join(sorted(df.columns))
    want = con.sql(f"SELECT {columns} FROM ({queries.ORACLES[name]})").fetchall()
    assert sorted(map(plain, df.select(*sorted(df.columns)).collect())) == sorted(map(plain, want))


def test_scratch_is_deleted(spark):
    common.stored(spark.range(3), "gone")
    assert common.release(spark) > 0 and common.release(spark) == 0
