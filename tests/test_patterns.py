"""Codons by pattern over many CDSs, of which many are alike."""

import os

import pytest
from codonlake.operators import metagene
from pyspark.sql import functions as F

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def many(spark, tmp_path_factory):
    """The smallest tables with each customer forty times, 5,000 keys apart: copies of one path."""
    if not os.path.isdir(FOLDER):
        pytest.skip("needs the test tables")
    folder = str(tmp_path_factory.mktemp("many"))
    spark.read.parquet(f"{FOLDER}/events.parquet").write.parquet(f"{folder}/events.parquet")
    c = spark.read.parquet(f"{FOLDER}/customer.parquet").crossJoin(spark.range(40)).withColumn("c_custkey", F.col("c_custkey") + F.col("id") * 5000).drop("id")
    c.coalesce(2).write.parquet(f"{folder}/customer.parquet")
    return folder


def same_as_sql(spark, folder, name):
    import __spark_entry__
    import duckdb

    con = duckdb.connect()
    for t in ("events", "customer"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    got, want = __spark_entry__.queries()[name](spark, folder), con.execute(__spark_entry__.oracle_sql()[name])
    order = [[d[0] for d in want.description].index(c) for c in got.columns]
    rows = sorted((tuple(r[k] for k in order) for r in want.fetchall()), key=str)
    assert sorted((tuple(r) for r in got.collect()), key=str) == rows and rows


def test_a_template_is_that_of_all_copies(spark, many):
    codons = [(5, 1, 0), (1, 1, 1), (0, 2, 1), (9, 0, 3)]
    times = [3, 1, 4, 2]
    x = spark.createDataFrame([(*c, n) for c, n in zip(codons, times, strict=True)], "c0 long, c1 long, c2 long, n long").withColumnRenamed("n", "times")
    every = x.withColumn("times", F.explode(F.expr("array_repeat(1, cast(times as int))"))).drop("times")
    for one, all_of_them in ((metagene.template(x, 3, F.col("times")), metagene.template(every, 3)), (metagene.fit_a0(x, (1 / 3, 1 / 3, 1 / 3), 3, times=F.col("times")), metagene.fit_a0(every, (1 / 3, 1 / 3, 1 / 3), 3))):
        for a, b in zip(one.collect(), all_of_them.collect(), strict=True):
            assert all(p == (pytest.approx(q, rel=1e-9) if isinstance(q, float) else q) for p, q in zip(a, b, strict=True))
    assert metagene.template(x.limit(0), 3, F.col("times")).first().n_codons == 0
    same_as_sql(spark, many, "qc_background")


def test_corners_and_means_are_those_of_all_copies(spark, many):
    x = spark.createDataFrame([(4, 0, 0, 3), (1, 1, 1, 1), (0, 2, 1, 4)], "c0 long, c1 long, c2 long, times long")
    every = x.withColumn("k", F.explode(F.expr("array_repeat(1, cast(times as int))"))).drop("k", "times")
    assert sorted(metagene.ternary(x, times=F.col("times")).collect()) == sorted(metagene.ternary(every).collect())
    assert tuple(metagene.mean_shares(x, F.col("times")).first()) == pytest.approx(tuple(metagene.mean_shares(every).first()))
    same_as_sql(spark, many, "qc_vertices")


def test_cdss_of_one_path_are_counted_once(spark, many):
    from codonlake.plans import quality

    cds = quality._cds(spark, many)
    one = metagene.alike(cds)
    n = one.agg(F.count(F.lit(1)).alias("rows"), F.sum("copies").alias("copies")).first()
    assert n.copies == cds.count() and n.rows * 40 == n.copies
    same_as_sql(spark, many, "qc_patterns")


def scans(df, column):
    """The scans of tables with the column in a query's plan, and those of tables that were made before it."""
    plan = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
    return sum("Relation [" in line and f"{column}#" in line for line in plan), sum("LogicalRDD" in line for line in plan)


def test_patterns_are_counted_in_one_job(spark, many):
    from codonlake.plans import quality

    assert scans(quality.qc_patterns(spark, many), "c_custkey") == (1, 0)


def test_corners_and_means_are_found_in_one_pass(spark, many):
    from codonlake.plans import quality

    x = spark.createDataFrame([(4, 0, 0, 3), (1, 1, 1, 1), (0, 2, 1, 4), (0, 0, 9, 2), (0, 0, 0, 5)], "c0 long, c1 long, c2 long, times long")
    times = F.col("times")
    both = metagene.vertices(metagene.ternary(x, times=times)).join(metagene.mean_shares(x, times))
    got = metagene.corners_and_means(x, times=times)
    assert got.columns == both.columns and tuple(got.first()) == pytest.approx(tuple(both.first()))
    assert tuple(metagene.corners_and_means(x.limit(0)).first()) == (0.0,) * 6
    assert scans(quality.qc_vertices(spark, many), "c_custkey") == (1, 0)
