import pytest
from conftest import tuples
from pyspark.sql import functions as F

from lexiflow.operators import joins
from lexiflow.session import spread


@pytest.fixture
def skewed(spark):
    """A third of all rows has one key."""
    n = F.col("id")
    key = F.when(n % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), n % 50))
    return spark.range(3000).select(key.alias("k"), "id")


@pytest.fixture
def table(spark):
    rows = [("hot", 1)] + [(f"k{i}", i) for i in range(30)]
    return spark.createDataFrame(rows, "k string, v long")


@pytest.mark.parametrize("how", ["inner", "left", "left_anti", "left_semi"])
def test_both_ways_give_the_plain_join(skewed, table, how):
    plain = skewed.join(table, "k", how)
    small = joins.lookup_join(skewed, table, "k", how)
    large = joins.lookup_join(skewed, table, "k", how, max_rows=5)

    def rows(df):
        return sorted(map(str, df.select(*plain.columns).collect()))

    assert rows(small) == rows(plain)
    assert rows(large) == rows(plain)


def test_null_keys_stay_on_the_left(spark, table):
    df = spark.createDataFrame([(None, 1), ("hot", 2)], "k string, id long")
    got = joins.lookup_join(df, table, "k", "left", max_rows=5)
    assert got.count() == 2
    assert tuples(got.where("k is not null"), "v") == [(1,)]


def test_size_check(spark, table):
    assert joins.fits_broadcast(table)
    assert not joins.fits_broadcast(table, max_rows=30)
    assert not joins.fits_broadcast(table, max_bytes=100)


def logical(df):
    return df._jdf.queryExecution().logical().toString()


def test_bounds_of_the_caller_hold(skewed, table):
    assert "broadcast" in logical(joins.lookup_join(skewed, table, "k"))
    for bounds in ({"max_rows": 2}, {"max_bytes": 50}):
        assert "broadcast" not in logical(joins.lookup_join(skewed, table, "k", **bounds))


def test_many_entries_of_a_hot_key(spark, skewed, table):
    extra = spark.range(1000).select(F.lit("hot").alias("k"), F.col("id").alias("v"))
    many = table.unionByName(extra)
    got = joins.lookup_join(skewed, many, "k", max_rows=100)
    assert got.count() == skewed.join(many, "k").count()


def test_rows_are_read_by_the_join_only(spark, skewed, table):
    """Planning runs a measuring job, and a storing one beyond the bound; none reads the rows."""
    failing = skewed.withColumn("id", F.raise_error(F.lit("read too early")))
    for bound in ({}, {"max_rows": 5}):
        spark.sparkContext.setJobGroup(f"planning {bound}", "")
        joins.lookup_join(failing, table, "k", **bound)
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup(f"planning {bound}")
        assert len(jobs) <= 3
    spark.sparkContext.setJobGroup("", "")


def test_spread_runs_no_job(spark, skewed):
    shuffled = skewed.groupBy("k").count()
    spark.sparkContext.setJobGroup("spreading", "")
    assert spread(shuffled).count() == shuffled.count()
    spark.sparkContext.setJobGroup("spreading 2", "")
    spread(shuffled)
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("spreading 2")
    spark.sparkContext.setJobGroup("", "")
