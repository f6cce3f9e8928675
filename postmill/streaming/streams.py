"""Streams over message files. Every query is started by a function that returns it, so callers
decide between draining what is there and running on."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState

from postmill.functions.masking import mask_pii
from postmill.operators import addresses as A
from postmill.session import STREAM_STATE_CONF
from postmill.sinks import writers


def file_stream(spark: SparkSession, path: str, schema: T.StructType, pattern: str = "*.parquet",
                files_per_trigger: int = 64) -> DataFrame:
    return (spark.readStream.schema(schema).option("pathGlobFilter", pattern)
            .option("maxFilesPerTrigger", files_per_trigger).parquet(path))


def _spill_state(spark: SparkSession) -> None:
    """State stores that may outgrow memory, unless the session already chose one."""
    for key, value in STREAM_STATE_CONF.items():
        if spark.conf.get(key, None) in (None, "") or "HDFSBacked" in spark.conf.get(key):
            spark.conf.set(key, value)


def _start(df: DataFrame, out: str, checkpoint: str, mode: str = "append", drain: bool = True) -> StreamingQuery:
    writer = df.writeStream.format("parquet").outputMode(mode).option("path", out)
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if drain else writer).start()


def stream_text(texts: DataFrame, out: str, checkpoint: str, column: str = "text", drain: bool = True) -> StreamingQuery:
    """Masked texts, row by row; no state."""
    return _start(texts.withColumn("processed", mask_pii(F.col(column))), out, checkpoint, drain=drain)


def stream_dedup(records: DataFrame, key: str, out: str, checkpoint: str, drain: bool = True) -> StreamingQuery:
    """One row per key, whatever its age: archives are not read in the order of time, so no row is ever too late.

    Which of several copies arrives first is not fixed; rows without a key all pass (they are told apart by their own
    place). The state holds each key once, on disk, in partitions by key.
    """
    _spill_state(records.sparkSession)
    once = records.withColumn("_key", _row_key(key)).dropDuplicates(["_key"]).drop("_key")
    return _start(once, out, checkpoint, drain=drain)


def _row_key(key: str) -> Column:
    """The key; rows without one are told apart by their place."""
    return F.coalesce(F.nullif(F.col(key), F.lit("")), F.concat(F.lit("row:"), F.col("scan_pos").cast("string")))


def stream_keep_first(records: DataFrame, key: str, out: str, checkpoint: str, drain: bool = True) -> StreamingQuery:
    """The row of the least ``scan_pos`` per key, whatever the order in which rows arrive.

    The output are changes: a row with ``change`` 1, and later, if a row of a lesser place comes, one of -1 that takes it back
    (its key and place alone) beside the new one. ``first_rows`` puts them together. The state holds a place per key.
    """
    _spill_state(records.sparkSession)
    keyed = records.withColumn("_key", _row_key(key)).withColumn("change", F.lit(1))
    names = records.columns
    out_schema = T.StructType([*records.schema.fields, T.StructField("_key", T.StringType()), T.StructField("change", T.IntegerType())])
    for field in out_schema.fields:
        field.nullable = True

    def least(of: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = state.get[0] if state.exists else None
        best = place = None
        for batch in batches:
            if len(batch) > 1:
                at = int(batch["scan_pos"].to_numpy().argmin())
                batch = batch.iloc[at:at + 1]
            here = int(batch["scan_pos"].iat[0])
            if place is None or here < place:
                best, place = batch, here
        if known is not None and place >= known:
            return
        state.update((place,))
        if known is not None:
            gone = {n: None for n in names} | {"scan_pos": known, "_key": of[0], "change": -1}
            yield pd.DataFrame([gone], columns=[*names, "_key", "change"]).astype({"scan_pos": "int64"})
        # Most keys come once, so their row passes as it came.
        yield best

    changes = keyed.groupBy("_key").applyInPandasWithState(
        least, out_schema, "place long", "append", "NoTimeout")
    return _start(changes, out, checkpoint, drain=drain)


def first_rows(changes: DataFrame) -> DataFrame:
    """The rows that the changes of ``stream_keep_first`` leave, one per key."""
    gone = changes.where("change < 0").select("_key", "scan_pos")
    return changes.where("change > 0").join(gone, ["_key", "scan_pos"], "left_anti").drop("_key", "change")


def stream_export(records: DataFrame, out: str, checkpoint: str, formats: Sequence[str],
                  drain: bool = True) -> StreamingQuery:
    """Each micro-batch goes to every format. A batch owns the folder of its number, so a batch that
    is run again after a failure replaces its own output. Records need an id: a place in the whole
    scan is not known to a batch."""
    chosen = writers.formats_of(formats)

    def write(batch: DataFrame, batch_id: int) -> None:
        writers.fan_out(batch, f"{out}/batch={batch_id}", chosen, mode="overwrite", fill_ids=False)
    query = records.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (query.trigger(availableNow=True) if drain else query).start()


def stream_address_counts(records: DataFrame, out: str, checkpoint: str, drain: bool = True) -> StreamingQuery:
    """Running mentions and roles per address. Each batch writes the addresses it changed, under its
    number; ``latest_counts`` reads the newest state of each."""
    _spill_state(records.sparkSession)
    counted = A.count_mentions(A.explode_addresses(records))

    def write(changed: DataFrame, batch_id: int) -> None:
        changed.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
    query = (counted.writeStream.outputMode("update").foreachBatch(write)
             .option("checkpointLocation", checkpoint))
    return (query.trigger(availableNow=True) if drain else query).start()


def latest_counts(spark: SparkSession, out: str) -> DataFrame:
    """Newest count and roles per address from the batches of ``stream_address_counts``.

    Counts never fall, so the newest row of an address is the one with the highest count.
    """
    changes = spark.read.parquet(out)
    return changes.groupBy("address").agg(F.max("n").alias("n"), F.bit_or("bits").alias("bits"))


def stream_hourly_volume(events: DataFrame, time: str, out: str, checkpoint: str, drain: bool = True) -> StreamingQuery:
    """Rows per hour of event time. Each batch writes the hours it changed, open ones and late rows included;
    ``latest_volume`` reads the newest count of each. The state is one row per hour."""
    _spill_state(events.sparkSession)
    hourly = events.groupBy(F.window(time, "1 hour").alias("hour")).agg(F.count(F.lit(1)).alias("n"))

    def write(changed: DataFrame, batch_id: int) -> None:
        changed.select(F.col("hour.start").alias("hour_start"), "n").write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
    query = hourly.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
    return (query.trigger(availableNow=True) if drain else query).start()


def latest_volume(spark: SparkSession, out: str) -> DataFrame:
    """Newest count per hour; counts never fall."""
    return spark.read.parquet(out).groupBy("hour_start").agg(F.max("n").alias("n"))
