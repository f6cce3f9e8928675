"""Named queries that drain a stream and read what it wrote."""

from __future__ import annotations

from pyspark.sql import functions as F

from postmill.functions.masking import mask_pii
from postmill.operators import addresses as A
from postmill.plans import statements as S
from postmill.plans.queries_messages import records
from postmill.session import shared_dir
from postmill.sinks import writers
from postmill.sources import sample
from postmill.streaming import streams

Q: dict[str, tuple] = {}


def query(sql: str | None):
    def add(fn):
        Q[fn.__name__] = (fn, sql)
        return fn
    return add


def table_stream(spark, sf: str, name: str):
    """A sample table as a stream, whether it is one file or a folder of files."""
    schema = sample.table(spark, sf, name).schema
    # A path without a pattern must be a folder; the pattern finds the table alone.
    return streams.file_stream(spark, f"{sf}/{name}.parque[t]", schema, "*")


def record_stream(spark, sf: str, *columns: str):
    """Records written as files and read as a stream."""
    path = shared_dir(spark, "stream-in")
    df = records(spark, sf).select(*columns)
    df.write.parquet(path)
    return streams.file_stream(spark, path, df.schema, files_per_trigger=4)


def a_quarter(spark, path: str) -> int:
    """Files per batch, so that what was written comes in four: batches cost the same whatever they hold."""
    return max(1, -(-len(spark.read.parquet(path).inputFiles()) // 4))


def places(spark) -> tuple[str, str]:
    return shared_dir(spark, "stream-out"), shared_dir(spark, "stream-state")


@query(f"SELECT doc_id, {S.mask('text')} AS processed FROM documents")
def stream_text(spark, sf):
    out, state = places(spark)
    texts = table_stream(spark, sf, "documents").select("doc_id", "text")
    streams.stream_text(texts, out, state).awaitTermination()
    return spark.read.schema("doc_id long, processed string").parquet(out)


@query(S.query(S.RECORDS, 'SELECT DISTINCT "Email_ID" FROM records'))
def stream_dedup(spark, sf):
    out, state = places(spark)
    df = record_stream(spark, sf, "Email_ID", "Date_Received_Timestamp", "scan_pos")
    streams.stream_dedup(df, "Email_ID", out, state).awaitTermination()
    return spark.read.parquet(out).select("Email_ID")


@query(S.query(S.RECORDS, 'SELECT "Email_ID", "Subject", scan_pos FROM records QUALIFY row_number() OVER (PARTITION BY "Email_ID" ORDER BY scan_pos) = 1'))
def stream_keep_first(spark, sf):
    """The last rows come first: two files in falling order of place, one per batch."""
    out, state = places(spark)
    path = shared_dir(spark, "stream-in")
    df = records(spark, sf).select("Email_ID", "Subject", "scan_pos")
    df.withColumn("part", F.pmod(-F.expr("scan_pos div 65536"), F.lit(2))).repartition("part").write.partitionBy("part").parquet(path)
    df = streams.file_stream(spark, f"{path}/part=*", df.schema, files_per_trigger=1)
    streams.stream_keep_first(df, "Email_ID", out, state).awaitTermination()
    return streams.first_rows(spark.read.parquet(out))


@query(S.query(S.RECORDS, f"""SELECT f AS format, "Email_ID", {S.mask('"Body"')} AS "Body" FROM records, (SELECT unnest(['csv', 'json']) AS f)"""))
def stream_export(spark, sf):
    out, state = places(spark)
    df = record_stream(spark, sf, "Email_ID", "Subject", "Body").withColumn("Body", mask_pii(F.col("Body")))
    streams.stream_export(df, out, state, ["csv", "json"]).awaitTermination()
    csv = writers.read_csv(spark, f"{out}/batch=*/csv").select(F.lit("csv").alias("format"), "Email_ID", "Body")
    json = spark.read.schema(df.schema).json(f"{out}/batch=*/json").select(F.lit("json").alias("format"), "Email_ID", "Body")
    return csv.unionByName(json)


@query(S.query(S.RECORDS + "," + S.mentions("records"), """SELECT address, count(*) AS n,
  array_to_string(list_sort(list(DISTINCT role)), '; ') AS roles FROM mentions GROUP BY address"""))
def stream_address_counts(spark, sf):
    out, state = places(spark)
    df = record_stream(spark, sf, *[f for f, _, _ in A.ROLES])
    streams.stream_address_counts(df, out, state).awaitTermination()
    latest = streams.latest_counts(spark, out)
    return latest.select("address", "n", F.array_join(A.role_names(F.col("bits")), "; ").alias("roles"))


@query("""SELECT strftime(h, '%Y-%m-%d %H:%M') AS hour_start, n FROM (
    SELECT date_trunc('hour', ts) AS h, count(*) AS n FROM events GROUP BY 1)""")
def stream_hourly_volume(spark, sf):
    """Events in four parts by day, read in as many batches, however many files the parts are written as."""
    out, state = places(spark)
    path = shared_dir(spark, "stream-in")
    events = sample.table(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"))
    part = F.when(F.col("ts").isNull(), 0).otherwise(F.pmod(F.datediff(F.lit("2100-01-01"), "ts"), F.lit(4)))
    events.withColumn("part", part).write.partitionBy("part").parquet(path)
    events = streams.file_stream(spark, f"{path}/part=*", events.schema, files_per_trigger=a_quarter(spark, path))
    streams.stream_hourly_volume(events, "ts", out, state).awaitTermination()
    return streams.latest_volume(spark, out).select(F.date_format("hour_start", "yyyy-MM-dd HH:mm").alias("hour_start"), "n")
