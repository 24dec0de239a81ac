from pyspark.sql import functions as F

from gridloom.llm import _shared as S


def test_only_scratch_tables_are_dropped(spark, tmp_path):
    kept = str(tmp_path / "gridloom" / "mine")
    spark.range(5).write.parquet(kept)
    mine, scratch = spark.read.parquet(kept), S.materialise(spark.range(5), "numbers")
    S.drop_scratch(mine)
    S.drop_scratch(scratch)
    assert spark.read.parquet(kept).count() == 5
    assert not [p for p in tmp_path.rglob("numbers-*")]
    try:
        gone = spark.read.parquet(scratch.inputFiles()[0]).count() == 0
    except Exception:
        gone = True
    assert gone


def test_ranks(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("part"), (F.col("id") * 7 % 11).alias("cell"), F.xxhash64("id").alias("h"))
    got = S.ranked(df, ["part"], "cell", [F.col("h")], "rank").collect()
    for part in range(3):
        rows = sorted((r["cell"], r["h"], r["rank"]) for r in got if r["part"] == part)
        assert [r[2] for r in rows] == list(range(len(rows)))


def test_join_by_share(spark):
    """A hot key is joined without a shuffle, null keys pass, all others are joined as usual."""
    rows = spark.range(5000).selectExpr("id", "case when id % 3 = 0 then null when id % 3 = 1 then -1 else id % 50 end as k")
    table = rows.where("k is not null and k != 7").groupBy(F.col("k").alias("of")).agg(F.count("*").alias("n"))
    got = S.joined_by_share(rows, table, F.col("k"), "of", "n")
    assert got.columns == ["id", "k", "of", "n"]
    assert sorted(map(str, got.collect())) == sorted(map(str, rows.join(table, F.col("k") == F.col("of"), "left").collect()))
