import pytest
from pyspark.sql import functions as F

from touchline import settled
from touchline.operators.candidates import numbered, upserted


def wide(spark, n):
    return spark.range(n).select(((F.col("id") * 7_919) % n).alias("k"), *[F.concat(F.lit("x" * 40), F.col("id").cast("string")).alias(f"c{i}") for i in range(6)])


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_numbers_of_a_million_wide_rows(spark, adaptive):
    """Nothing is lost, doubled or misnumbered, however the partitions fall."""
    n = 1_000_003
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        out = numbered(wide(spark, n), ["k"], spark.createDataFrame([(41,)], "id long"))
        got = out.agg(F.count(F.lit(1)), F.count_distinct("id"), F.min("id"), F.max("id"), F.count_if(F.col("id") != F.col("k") + 42), F.max(F.length("c5"))).first()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert tuple(got) == (n, n, 42, n + 41, 0, 47)


def test_positions_of_nothing_and_ties(spark):
    assert settled.positions(spark.range(0).orderBy("id")).count() == 0
    ties = spark.range(1000).select((F.col("id") % 3).alias("k")).orderBy(F.desc("k"))
    rows = settled.positions(ties).collect()
    assert sorted(r["position"] for r in rows) == list(range(1000))
    assert [r["k"] for r in sorted(rows, key=lambda r: r["position"])] == [2] * 333 + [1] * 333 + [0] * 334


def test_upserted_keeps_known_and_numbers_new(spark):
    new = spark.createDataFrame([("b", 1), ("a", 2), ("c", 3), ("a", 4)], "k string, v int")
    old = spark.createDataFrame([("c", 9)], "k string, id long")
    assert sorted(map(tuple, upserted(new, old, ["k"], ["k", "v"]).select("k", "v", "id").collect())) == [("a", 2, 10), ("b", 1, 11)]


def test_a_cluster_without_a_shared_folder_is_an_error():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"
        getConf = staticmethod(lambda: Conf())
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="share"):
        settled.shared_folder(Session())
