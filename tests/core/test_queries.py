import duckdb
import pytest

import __spark_entry__
from veilsift import queries

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CHECKED = ["value_entropy", "non_secret_structure", "tokens", "pattern_matches", "fusion_merged", "findings", "baseline_classes", "blob_newest_ref", "path_decision", "merge_spans", "tumbling_counts", "max_commits", "severity_by_detector", "excerpts", "report_paths", "error_codes"]


def plain(v):
    return round(v, 9) if isinstance(v, float) else str(v)[:26] if hasattr(v, "isoformat") else v


@pytest.mark.parametrize("name", CHECKED)
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got = queries.QUERIES[name](spark, DATA)
    want = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    order = sorted(names)
    a = sorted(repr([plain(r[c]) for c in order]) for r in got.collect())
    b = sorted(repr([plain(r[names.index(c)]) for c in order]) for r in want.fetchall())
    assert a == b


def test_contract(spark):
    known = __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(known)
    assert __spark_entry__.entry(spark).count() == 12
