import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"


def test_every_sql_counterpart_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship_query(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 4 and sum(r["resolved"] for r in rows) > 0


def test_plans_push_down_and_prune(spark):
    plan = entry.queries()["a2_sla_breaches_by_priority"](spark, SMALL)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<event_id:bigint,value:double,props:string>" in text
