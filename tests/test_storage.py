"""Tables kept for an application."""

import time

from oddsmill.sources.storage import discard, files_digest, kept


def test_kept_once_until_a_file_changes(spark, tmp_path):
    path, made = str(tmp_path / "t"), []
    spark.range(5).write.parquet(path)

    def make():
        made.append(1)
        return spark.read.parquet(path).selectExpr("sum(id) AS total")

    read = lambda name="sums": kept(name, [spark.read.parquet(path)], make).first().total
    assert [read(), read(), len(made)] == [10, 10, 1]
    assert read("sums|other parameters") == 10 and len(made) == 2
    time.sleep(0.01)
    spark.range(7).write.mode("overwrite").parquet(path)
    assert [read(), read(), len(made)] == [21, 21, 3]


def test_kept_again_when_the_written_table_is_gone(spark, tmp_path):
    path, made = str(tmp_path / "t"), []
    spark.range(3).write.parquet(path)

    def make():
        made.append(1)
        return spark.read.parquet(path)

    first = kept("gone", [spark.read.parquet(path)], make)
    discard(first)
    assert kept("gone", [spark.read.parquet(path)], make).count() == 3 and len(made) == 2


def test_digest_counts_every_file(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(4).repartition(2).write.parquet(path)
    one = files_digest(spark.read.parquet(path))
    spark.range(4).coalesce(1).write.mode("append").parquet(path)
    two = files_digest(spark.read.parquet(path))
    assert one != two and one.split(":")[0] == "2" and two.split(":")[0] == "3"
