"""Runs a registered query and its SQL on the same tables and compares the rows."""

from pathlib import Path

import duckdb

SF = "/root/testdata/sf0.01"


def sql_rows(sql, sf=SF):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(sf).glob("*.parquet"):
        source = f"{p}/*.parquet" if p.is_dir() else str(p)
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{source}')")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(r[i] for i in order) for r in cur.fetchall()), key=repr)


def spark_rows(df):
    names = sorted(df.columns)
    return names, sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


def assert_same(spark, query, sql, sf=SF):
    got, want = spark_rows(query(spark, sf)), sql_rows(sql, sf)
    assert got[0] == want[0]
    extra, missing = set(got[1]) - set(want[1]), set(want[1]) - set(got[1])
    assert got[1] == want[1], (len(got[1]), len(want[1]), list(extra)[:5], list(missing)[:5])


def heaviest(spark, run):
    """Of the stages that `run` executes over shuffled rows, the most that a task reads as a multiple of the mean."""
    store = spark.sparkContext._jsc.sc().statusStore()
    bus = spark.sparkContext._jsc.sc().listenerBus()
    gateway = spark.sparkContext._gateway
    listed = lambda: store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
    bus.waitUntilEmpty()
    known = listed()
    before = {known.apply(k).stageId() for k in range(known.size())}
    for key, value in (("spark.sql.adaptive.coalescePartitions.enabled", "false"), ("spark.sql.autoBroadcastJoinThreshold", "-1")):
        spark.conf.set(key, value)
    try:
        run()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    bus.waitUntilEmpty()
    worst, stages = 0.0, listed()
    for s in (stages.apply(k) for k in range(stages.size())):
        if s.stageId() in before or s.shuffleReadRecords() < 20_000 or s.numTasks() < 4:
            continue
        tasks = store.taskList(s.stageId(), s.attemptId(), 1000)
        read = [tasks.apply(i).taskMetrics().get().shuffleReadMetrics().recordsRead() for i in range(tasks.size()) if tasks.apply(i).taskMetrics().isDefined()]
        worst = max(worst, max(read) * len(read) / sum(read))
    return worst
