"""The registered queries over the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from landmosaic.llm import entries, suffix
from landmosaic.llm.common import table

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.mark.parametrize("name", list(entries.queries()))
def test_query(spark, name):
    df = entry.queries()[name](spark, DATA)
    rows = df.collect()
    source = {"op2_language": "pages", "op9_topk": None, "op8_packing": None, "op11_phrases": None, "op13_bestfit": None}.get(name, "documents")
    assert rows and (source is None or len(rows) == table(spark, DATA, source).count())
    if name in entries.oracle_sql():
        con = duckdb.connect()
        for of in ("embeddings", "documents"):
            con.execute(f"CREATE VIEW {of} AS SELECT * FROM '{DATA}/{of}.parquet'")
        found = con.execute(entries.oracle_sql()[name])
        names = [x[0] for x in found.description]
        assert sorted(tuple(r[c] for c in names) for r in rows) == sorted(found.fetchall())
    if name == "op4_suffix_dedup":
        want = suffix.brute_force([(r.doc_id, r.text) for r in table(spark, DATA, "documents").collect()])
        assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows} == want
