"""The plan of scans with hot keys grows with the number of scans, not with a power of it."""

from pyspark.sql import functions as F

from movelens.operators.scan import Skew, ordered_scan


def scans_in(df):
    text = df._jdf.queryExecution().optimizedPlan().toString()
    return text.count("Relation [") + text.count("LogicalRDD")


def test_chained_hot_scans_stay_linear(spark):
    base = spark.range(400).select((F.col("id") % 3).alias("k"), F.col("id").alias("t"), (F.col("id") % 7).alias("v"))
    skew = Skew(hot_rows=5, pieces=4)
    df, sizes = base, []
    for i in range(4):
        df = ordered_scan(df, ["k"], ["t"], sums={f"s{i}": F.col("v")}, last={f"l{i}": F.col("v")}, skew=skew)
        sizes.append(scans_in(df))
    assert max(sizes) <= sizes[0] + 1
    plain = base
    for i in range(4):
        plain = ordered_scan(plain, ["k"], ["t"], sums={f"s{i}": F.col("v")}, last={f"l{i}": F.col("v")}, skew=Skew(rows_at_most=400))
    assert sorted(map(tuple, df.collect())) == sorted(map(tuple, plain.collect()))


def test_lag_is_the_row_before_across_segments(spark):
    """Also where the value before is null, and at a hot key's segment borders."""
    rows = [(i % 3, i, None if i % 5 == 0 else i * 10) for i in range(200)]
    df = spark.createDataFrame(rows, "k long, t long, v long")
    want = sorted((k, t, rows[t - 3][2] if t >= 3 else None) for k, t, _ in rows)
    for skew in (Skew(rows_at_most=200), Skew(hot_rows=10, pieces=8)):
        out = ordered_scan(df, ["k"], ["t"], lag={"p": F.col("v")}, skew=skew)
        assert sorted(map(tuple, out.select("k", "t", "p").collect())) == want
