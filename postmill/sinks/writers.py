"""Writers. All of them write many part files from the tasks that hold the rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postmill.functions.flat import csv_value, spaced_json
from postmill.operators.messages import with_fallback_id
from postmill.schema import ADDRESS_FIELDS, EXPORT_FIELDS, HOST_FIELDS
from postmill.sinks.render import mbox_text, rendered

FORMATS = ("csv", "json", "eml", "mbox")
ADDRESS_FORMATS = ("json", "csv")
CSV_OPTIONS = {"header": "true", "escape": '"', "multiLine": "true", "ignoreLeadingWhiteSpace": "false",
               "ignoreTrailingWhiteSpace": "false", "emptyValue": ""}
# Rows per file where a format would otherwise make very large files.
ROWS_PER_FILE = 1_000_000


def _save(df: DataFrame, fmt: str, path: str, compress: bool = False, mode: str = "errorifexists", **options: str) -> str:
    writer = df.write.mode(mode).options(**options).option("maxRecordsPerFile", ROWS_PER_FILE)
    if compress:
        writer = writer.option("compression", "gzip")
    writer.format(fmt).save(path)
    return path


def formats_of(formats: Sequence[str], allowed: Sequence[str] = FORMATS) -> list[str]:
    """Lower-cased, each once, in the order given; unknown ones are an error."""
    chosen = list(dict.fromkeys(f.lower() for f in formats))
    unknown = [f for f in chosen if f not in allowed]
    if unknown or not chosen:
        raise ValueError(f"formats must be some of {', '.join(allowed)}; got {', '.join(formats) or 'none'}")
    return chosen


# --- message records ---------------------------------------------------------------------------


def write_json(records: DataFrame, path: str, compress: bool = False, mode: str = "errorifexists",
               fill_ids: bool = True) -> str:
    """JSON lines with all fields. Records without an id get one from their place in the scan."""
    keyed = with_fallback_id(records) if fill_ids and "scan_pos" in records.columns else records
    return _save(keyed, "json", path, compress, mode, ignoreNullFields="false")


def keyed_document(records: DataFrame, pretty: bool = False) -> DataFrame:
    """One JSON object per record as a ``"id": {...}`` member text, for callers that want the keyed
    form. The members stay rows: a single object cannot be written in parallel."""
    body = F.to_json(F.struct(*records.columns), {"ignoreNullFields": "false", "pretty": str(pretty).lower()})
    return records.select("Email_ID", F.concat(spaced_json(F.col("Email_ID"), T.StringType()), F.lit(":"), body).alias("member"))


def csv_rows(records: DataFrame, fields: Sequence[str] = EXPORT_FIELDS) -> DataFrame:
    """The projection of the CSV export: chosen fields as text; absent ones are empty."""
    types = {f.name: f.dataType for f in records.schema.fields}
    return records.select(*[
        (csv_value(F.col(f), types[f]) if f in types else F.lit("")).alias(f) for f in fields])


def write_csv(records: DataFrame, path: str, fields: Sequence[str] = EXPORT_FIELDS, compress: bool = False,
              mode: str = "errorifexists") -> str:
    return _save(csv_rows(records, fields), "csv", path, compress, mode, **CSV_OPTIONS)


def read_csv(spark, path: str, fields: Sequence[str] = EXPORT_FIELDS) -> DataFrame:
    schema = T.StructType([T.StructField(f, T.StringType()) for f in fields])
    back = spark.read.schema(schema).options(**CSV_OPTIONS).csv(path)
    return back.select(*[F.coalesce(F.col(f), F.lit("")).alias(f) for f in fields])


def write_eml(records: DataFrame, path: str, compress: bool = False, mode: str = "errorifexists") -> str:
    """Rendered messages keyed by file name, as table rows: one file per task, not one per message."""
    return _save(rendered(records), "parquet", path, compress, mode)


def write_mbox(records: DataFrame, path: str, compress: bool = False, mode: str = "errorifexists") -> str:
    """Mailbox text. Each part file is a valid mailbox on its own."""
    return _save(records.select(mbox_text().alias("value")), "text", path, compress, mode)


def write_index(index: DataFrame, path: str, mode: str = "errorifexists") -> str:
    return _save(index, "parquet", path, mode=mode)


def write_attachments(stored: DataFrame, path: str, mode: str = "errorifexists") -> str:
    """Path and bytes of stored attachments, written from the tasks that hold them."""
    kept = [c for c in ("Email_ID", "scan_pos", "folder_path", "message_index", "attachment_index", "stored_name", "path",
                        "content") if c in stored.columns]
    stored.select(*kept).write.mode(mode).option("maxRecordsPerFile", 100_000).parquet(path)
    return path


_WRITERS: dict[str, Callable[..., str]] = {
    "json": write_json, "csv": write_csv, "mbox": write_mbox, "eml": write_eml}


def fan_out(records: DataFrame, path: str, formats: Sequence[str], compress: bool = False,
            mode: str = "errorifexists", fill_ids: bool = True, keep: bool = True) -> dict[str, str]:
    """Write every format from one computation of the records.

    They are kept on executors' disks for the writes (unless the caller does so, ``keep=False``); a lost executor only
    recomputes its part.
    """
    chosen = formats_of(formats)
    kept = records.persist(StorageLevel.DISK_ONLY) if keep and len(chosen) > 1 else records
    try:
        out = {}
        for fmt in chosen:
            extra = {"fill_ids": fill_ids} if fmt == "json" else {}
            out[fmt] = _WRITERS[fmt](kept, f"{path}/{fmt}", compress=compress, mode=mode, **extra)
        return out
    finally:
        if kept is not records:
            kept.unpersist()


# --- reports -----------------------------------------------------------------------------------


def _joined(c: Column) -> Column:
    return F.array_join(F.filter(F.array_sort(c), lambda x: x != ""), "; ")


def address_csv_rows(report: DataFrame) -> DataFrame:
    lists = [f for f, t in report.dtypes if t.startswith("array")]
    return report.select(*[(_joined(F.col(f)) if f in lists else F.col(f).cast("string")).alias(f)
                           for f in ADDRESS_FIELDS])


def write_address_csv(report: DataFrame, path: str, compress: bool = False) -> str:
    return _save(address_csv_rows(report), "csv", path, compress, **CSV_OPTIONS)


def write_host_csv(report: DataFrame, path: str, compress: bool = False) -> str:
    rows = report.select(*[F.col(f).cast("string").alias(f) for f in HOST_FIELDS])
    return _save(rows, "csv", path, compress, **CSV_OPTIONS)


def write_address_json(addresses: DataFrame, hosts: DataFrame, path: str) -> dict[str, str]:
    """The two halves of the address document as JSON lines."""
    return {"addresses": _save(addresses, "json", f"{path}/addresses"),
            "hosts": _save(hosts, "json", f"{path}/hosts")}


def json_text(df: DataFrame, column: str) -> Column:
    """A column as JSON text with blanks after commas and colons."""
    return spaced_json(F.col(column), df.schema[column].dataType)
