"""Every registered query against its SQL on the smallest tables."""

import glob
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry

D = "/root/testdata/sf0.001"


def plain(df):
    def v(x):
        if x is None or x is pd.NaT or x is pd.NA or isinstance(x, float) and np.isnan(x):
            return None
        return x.item() if isinstance(x, np.generic) else x

    return sorted((tuple(v(x) for x in r) for r in df[sorted(df.columns)].itertuples(index=False, name=None)), key=repr)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("set timezone='UTC'")
    for f in glob.glob(f"{D}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(entry.catalog.ORACLE))
def test_query_against_sql(spark, duck, name):
    got, want = entry.queries()[name](spark, D).toPandas(), duck.sql(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


@pytest.mark.parametrize("name", sorted(set(entry.catalog.QUERIES) - set(entry.catalog.ORACLE)))
def test_other_queries_run(spark, name):
    assert entry.queries()[name](spark, D).count() > 0


def test_entry(spark):
    assert entry.entry(spark).columns == ["sample_id", "task_id", "learn_type", "prompt", "chosen", "rejected", "image"]


def test_generation_prompts_hold_all_earlier_tasks_and_gaps(spark, tmp_path):
    """More earlier tasks and weak cases in a domain than any list is cut at, and rows without an id, against the SQL."""
    c = duckdb.connect()
    c.sql("set timezone='UTC'")
    n = "i, CASE WHEN i < 130 THEN 'task' || i END AS task_id, 'Sort the rows of sheet ' || i AS instruction"
    c.sql(f"copy (select t.* replace ('seed' as step, 'os' as domain, r.task_id as task_id, r.instruction as instruction, t.config[1:0] as config) from (select * from '{D}/task_config.parquet' limit 1) t, (select {n} from range(131) x(i)) r) to '{tmp_path}/task_config.parquet'")
    said = "'{\"agent_pass\": false, \"agent_failure_analysis\": \"Gap ' || i || '.\"}'"
    case = f"i, CASE WHEN i < 89 THEN i + CASE WHEN agent = 'teacher' THEN 1000 ELSE 0 END END AS verify_id, agent, 'task' || i AS task_id, agent = 'teacher' AS agent_pass, {said} AS result"
    rows = f"select v.* replace ('seed' as step, 'os' as domain, r.verify_id as verify_id, r.agent as agent, r.task_id as task_id, r.agent_pass as agent_pass, r.result as result) from (select * from '{D}/verify_result.parquet' limit 1) v, (select {case} from range(90) x(i), (values ('student'), ('teacher')) a(agent) where i < 89 or agent = 'student') r"
    c.sql(f"copy ({rows} union all select v.* replace ('seed' as step, 'os' as domain, 2000 as verify_id, 'teacher' as agent, 'task89' as task_id, true as agent_pass) from (select * from '{D}/verify_result.parquet' limit 1) v) to '{tmp_path}/verify_result.parquet'")
    for t in ("task_config", "verify_result"):
        c.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet'")
    got, want = entry.queries()["generation_prompts"](spark, str(tmp_path)).toPandas(), c.sql(entry.oracle_sql()["generation_prompts"]).df()
    assert len(got) == 262 and plain(got) == plain(want)
    for with_gaps, prompt in zip(got["with_gaps"], got["prompt"]):
        assert all(f"- Sort the rows of sheet {i}\n" in prompt for i in range(131))
        assert not with_gaps or all(f"task{i}: Gap {i}." in prompt for i in range(90)), prompt
