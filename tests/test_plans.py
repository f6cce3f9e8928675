"""What the physical plans must and must not hold."""

from pyspark.sql import functions as F

from postmill.functions.masking import mask_pii
from postmill.operators import addresses, dedup, messages
from postmill.sources import sample


def plan(df):
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_address_report_shuffles_once_and_reads_few_columns(spark, tmp_path, sf_dir):
    messages.build_records(sample.mailbox(spark, sf_dir)).write.parquet(str(tmp_path / "r"))
    records = spark.read.parquet(str(tmp_path / "r"))
    text = plan(addresses.address_report(records, ordered=False))
    assert text.count("Exchange hashpartitioning") <= 2 and text.count("hashpartitioning(address") >= 1
    assert "partial_bit_or" in text and "ObjectHashAggregate" not in text and "SortAggregate" not in text
    schema = next(line for line in text.splitlines() if line.startswith("ReadSchema"))
    assert "Body" not in schema and "Sender_Email" in schema


def test_masking_stays_in_generated_code(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", mask_pii(F.col("text")).alias("m"))
    text = plan(df)
    assert "* Project" in text and "Exchange" not in text
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in text


def test_keep_first_aggregates_narrow_rows_only(spark, tmp_path, sf_dir):
    messages.build_records(sample.mailbox(spark, sf_dir)).write.parquet(str(tmp_path / "r"))
    text = plan(dedup.keep_first(spark.read.parquet(str(tmp_path / "r")), F.col("Email_ID")))
    assert "partial_min" in text and "Window" not in text
    narrow = [line for line in text.splitlines() if line.startswith("ReadSchema")]
    assert any("Body" not in line for line in narrow)


def test_folder_filter_reaches_the_scan(spark, tmp_path, sf_dir):
    sample.mailbox(spark, sf_dir).write.parquet(str(tmp_path / "m"))
    page = messages.folder_page(spark.read.parquet(str(tmp_path / "m")), "/Root/Inbox", 0, 10)
    assert "PushedFilters: [IsNotNull(folder_path), EqualTo(folder_path,/Root/Inbox)]" in plan(page)
