from pyspark.sql import functions as F

from tallyfield.sources import readers
from tallyfield.streaming import incremental


def rows(spark, ids):
    data = [(i, None, "a", 1, "1.1", i % 3, None, "ip", None, "[]", None) for i in ids]
    return spark.createDataFrame(data, readers.CLASSIFICATIONS)


def test_touched_keys_are_aggregated_again(spark, tmp_path):
    arrivals, history, results = (str(tmp_path / n) for n in ("in", "history", "results"))
    count = lambda df: df.groupBy("subject_id").agg(F.count(F.lit(1)).alias("n"))
    for ids in (range(9), range(9, 12)):
        rows(spark, ids).coalesce(1).write.mode("append").parquet(arrivals)
        stream = incremental.arrivals(spark, arrivals)
        incremental.update_touched(stream, history, results, ["subject_id"], count, str(tmp_path / "state")).awaitTermination()
    got = {r["subject_id"]: r["n"] for r in incremental.current(spark, results, ["subject_id"]).collect()}
    assert got == {0: 4, 1: 4, 2: 4}


def test_readers(spark, tmp_path):
    (tmp_path / "e.csv").write_text('user_id,workflow_id,workflow_version,annotations,subject_data\n1,2,3.4,"[{""task"":""T""}]","{""77"":{}}"\n2,2,3.5,[],"{""78"":{}}"\n')
    got = readers.csv_export(spark, str(tmp_path / "e.csv")).collect()
    assert sorted(r["subject_id"] for r in got) == [77, 78] and {r["workflow_id"] for r in got} == {2}
    (tmp_path / "v.tsv").write_text('subject\tuser\tspecies\tevent\n1\t"u"\tlion\tx\n1\tv\t\tx\n2\tw\tbad:one\tx\n3\tw\tlion\ttutorial\n')
    assert sorted((r["user"], r["species"] or "") for r in readers.species_votes(spark, str(tmp_path / "v.tsv")).collect()) == [("u", "lion"), ("v", "")]
    (tmp_path / "roi.tsv").write_text("a\t0,192\t192,192\n")
    regions = readers.regions_of_interest(spark, str(tmp_path / "roi.tsv"))
    points = spark.createDataFrame([("a", 50.0, 120.0), ("a", 50.0, 80.0), ("a", 500.0, 120.0), ("b", 1.0, 1.0)], "path string, x double, y double")
    assert [r["inside"] for r in readers.inside_region(points, regions).orderBy("path", "x", "y").collect()] == [False, True, False, True]


def test_old_rows_are_kept_and_repeats_dropped(spark, tmp_path):
    data = [(1, "2030-01-01"), (2, None), (3, "1999-01-01"), (1, "2030-01-01"), (3, "1999-01-01")]
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    for n, (i, at) in enumerate(data):  # a file and a batch each
        row = spark.createDataFrame([(i, None, "a", 1, "1.1", 1, None, "ip", None, "[]", None)], readers.CLASSIFICATIONS).withColumn("created_at", F.lit(at).cast("timestamp"))
        row.coalesce(1).write.mode("append").parquet(path)
    once = incremental.without_repeats(incremental.arrivals(spark, path, files=1))
    once.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == [1, 2, 3]
