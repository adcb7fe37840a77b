import re

import duckdb
import pytest

from siltlog.plans import catalog

DATA = "/root/testdata/sf0.001"
QUERIES, ORACLE = catalog.queries(), catalog.oracle_sql()


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return [columns[k] for k in order], sorted(str([r[k] for k in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_oracle(spark, name):
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{DATA}/events.parquet'")
    want = con.execute(ORACLE[name])
    want = _rows([c[0] for c in want.description], want.fetchall())
    df = QUERIES[name](spark, DATA)
    assert _rows(df.columns, [tuple(r) for r in df.collect()]) == want


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)


def test_flagship(spark):
    assert catalog.flagship(spark, DATA).count() > 0


@pytest.mark.parametrize("name", ["q03_images_current_month", "q05_monthly_hits_by_url", "q08_recent_hits", "q09_recent_html_hits", "q11_referrer", "q12_prolific_visitors"])
@pytest.mark.parametrize("text", ["", "_sql"])
def test_reports_of_recent_days_read_their_partitions(spark, name, text):
    plan = QUERIES[name + text](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^]]*day#", plan)


def test_limits_come_before_the_joins_for_shown_columns(spark):
    plan = QUERIES["q07_recent_entries"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    first = plan.index("GlobalLimit", plan.index("GlobalLimit") + 1)
    assert "Join" not in plan[first:plan.index("Relation", first)]
