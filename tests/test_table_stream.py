"""Sample tables as streams."""

import os

from postmill.plans import queries_streams
from postmill.plans.queries_streams import stream_text, table_stream


def folder_of(spark, sf_dir, root, parts):
    for name in ("documents", "labels"):
        table = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        table.repartition(parts).write.parquet(f"{root}/{name}.parquet")
    return str(root)


def test_a_table_that_is_a_folder_of_files_is_read_whole(spark, sf_dir, tmp_path):
    got = stream_text(spark, folder_of(spark, sf_dir, tmp_path, 3))
    assert sorted(got.collect()) == sorted(stream_text(spark, sf_dir).collect())
    assert got.count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()


def test_only_the_table_is_read(spark, sf_dir, tmp_path):
    sf = folder_of(spark, sf_dir, tmp_path, 2)
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    table_stream(spark, sf, "labels").writeStream.format("parquet").option("path", out).option("checkpointLocation", state) \
        .trigger(availableNow=True).start().awaitTermination()
    assert os.path.isdir(out) and spark.read.parquet(out).count() == spark.read.parquet(f"{sf}/labels.parquet").count()


def test_a_table_without_rows(spark, sf_dir, tmp_path):
    spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert stream_text(spark, str(tmp_path)).collect() == []


def test_hourly_volume_takes_as_many_batches_for_many_files(spark, sf_dir, tmp_path, monkeypatch):
    spark.read.parquet(f"{sf_dir}/events.parquet").repartition(7).write.parquet(str(tmp_path / "events.parquet"))
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    monkeypatch.setattr(queries_streams, "places", lambda _: (out, state))
    monkeypatch.setattr(queries_streams.sample, "table", lambda s, sf, n: s.read.parquet(f"{sf}/{n}.parquet").repartition(7))
    got = sorted(queries_streams.stream_hourly_volume(spark, str(tmp_path)).collect())
    assert len([d for d in os.listdir(out) if d.startswith("batch=")]) <= 4
    monkeypatch.undo()
    assert got == sorted(queries_streams.stream_hourly_volume(spark, sf_dir).collect())
