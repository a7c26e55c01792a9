"""The views as Spark joins them: the rows of their SQL, and how the lines move."""

import datetime as dt

from pyspark.sql import functions as F

from cohortspark.jobs import curation
from cohortspark.jobs.survival import one_gene
from cohortspark.operators import km, roc
from cohortspark.sources import adapters

SF = "/root/testdata/sf0.01"


def same(a, b):
    assert a.columns == b.columns
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def odd_tables(spark, at):
    """Patients twice, in two cohorts, in none and without a number; parts twice, with two genes, with none; lines and orders of nobody."""
    day = lambda k: dt.datetime(2020, 1, 1) + dt.timedelta(days=k)
    write = lambda name, rows, schema: spark.createDataFrame(rows, schema).write.parquet(f"{at}/{name}.parquet")
    write("customer", [(1, "A", 0, 1.0), (1, "A", 0, 1.0), (2, "A", 1, 2.0), (2, "B", 1, 2.0), (3, None, 1, 3.0), (None, "A", 1, 3.0), (4, "B", 2, None)], "c_custkey long, c_mktsegment string, c_nationkey int, c_acctbal double")
    write("part", [(1, "g"), (1, "g"), (2, "g"), (2, "h"), (3, None), (None, "g")], "p_partkey long, p_brand string")
    write("orders", [(k, c, day(7 * k), "1-URGENT" if k % 2 else "2-HIGH") for k, c in enumerate([1, 1, 2, 2, 3, None, 4, 9, 4])] + [(None, 1, day(3), "1-URGENT"), (1, 1, day(7), "1-URGENT")], "o_orderkey long, o_custkey long, o_orderdate timestamp, o_orderpriority string")
    lines = [(o, p, float(10 * o + p)) for o in range(10) for p in (1, 2, 3, 8)] + [(None, 1, 5.0), (1, None, 5.0), (0, 1, None), (8, 1, float("nan"))]
    write("lineitem", lines, "l_orderkey long, l_partkey long, l_extendedprice double")
    return str(at)


def test_views_equal_their_sql(spark, tmp_path):
    for d in (SF, odd_tables(spark, tmp_path)):
        same(adapters.probes(spark, d), adapters.view(spark, d, adapters.PROBES))
        e = adapters.view(spark, d, adapters.EXPR)
        same(adapters.expr(spark, d), e)
        same(adapters.merged(spark, d), adapters.surv(spark, d).join(e, ["dataset", "sample_id"]))


def test_rows_of_patients_move_by_patient(spark, monkeypatch):
    """Where no table is small enough to broadcast, values move by patient alone, in as many tasks as the lines ask for."""
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(adapters, "TASK_ROWS", 1000)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for df in (one_gene(spark, SF), adapters.merged(spark, SF), adapters.probes(spark, SF)):
            text = plan(df)
            assert "hashpartitioning(dataset" not in text and "hashpartitioning(c_mktsegment" not in text
            assert ", 60), REPARTITION_BY_NUM" in text
        # a gene is chosen before its lines meet orders: one of the brands, not all, goes on
        assert one_gene(spark, SF).where(F.col("gene") != "Brand#11").isEmpty()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_rows_dealt_by_lines_move_no_more(spark, monkeypatch):
    """Tables that meet the lines' rows are dealt to as many tasks as those: no join deals the rows again, nor does the matrix of probes."""
    monkeypatch.setattr(adapters, "TASK_ROWS", 1000)
    names = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "200"}
    before = {k: spark.conf.get(k) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        moves = lambda df: [x for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hash" in x]
        again = lambda df, key: [x for x in moves(df) if f"hashpartitioning({key}" in x and "REPARTITION_BY_NUM" not in x]
        for df in (adapters.merged(spark, SF), adapters.expr(spark, SF), adapters.probes(spark, SF), curation._matrix(spark, SF)):
            assert again(df, "sample_id") == []
        for df in (adapters.probes(spark, SF), curation._matrix(spark, SF)):
            assert again(df, "probe_id") == again(df, "ID_REF") == again(df, "dataset") == []
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_markers_rows_are_made_once(spark):
    """What makes the rows of a search over cuts or of areas runs once, however many of their sums read them."""
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            made.add(len(b))
            yield b

    rows = [("A", "g", k, float(k % 37 + 1), k % 3 % 2, float(k * 7 % 101)) for k in range(300)]
    schema = "dataset string, gene string, sample_id long, time double, status int, value double"
    for run in (lambda x: km.adjusted_cut_p(x, ["dataset", "gene"]), lambda x: roc.auc(x, ["dataset", "gene"], 20.0), lambda x: roc.auc(x, ["dataset", "gene"], 20.0, "NNE")):
        before = made.value
        assert run(spark.createDataFrame(rows, schema).mapInPandas(count, schema)).count() == 1
        assert made.value - before == 300
