"""The two jobs a user runs: export a mailbox, and report its addresses."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.operators import addresses as A
from postmill.operators import attachments as T
from postmill.functions.masking import mask_pii
from postmill.operators import dedup, index, messages, spelling, textsteps
from postmill.operators.numbering import numbered
from postmill.schema import MASKED_FIELDS
from postmill.sinks import writers


@dataclass
class Options:
    formats: Sequence[str] = ("json",)
    deduplicate: bool = False
    mask: bool = False
    mask_all_text: bool = False
    custom_patterns: dict[str, str] | None = None
    dictionary: DataFrame | None = None
    grammar: Callable[[], textsteps.Rewriter] | None = None
    neural: Callable[[], textsteps.Rewriter] | None = None
    index: bool = False
    compress: bool = False
    attachment_text: bool = False
    run_id: str = "run"


@dataclass
class Result:
    run_id: str
    paths: dict[str, str] = field(default_factory=dict)
    email_count: int = 0
    attachments_saved: int = 0
    address_count: int = 0
    host_count: int = 0


def records_of(raw: DataFrame, options: Options) -> DataFrame:
    """Records of a mailbox after duplicate removal, masking, spelling and the user's rewriters, as one plan."""
    records = messages.build_records(readable(raw))
    if options.deduplicate:
        records = dedup.keep_first(records, dedup.record_key())
    if options.mask:
        records = messages.mask_records(records, options.custom_patterns, options.mask_all_text)
    if options.dictionary is not None:
        records = spelling.correct_columns(records, options.dictionary, "scan_pos", {f: f for f in MASKED_FIELDS})
    steps = [textsteps.chunked(options.grammar)] if options.grammar else []
    steps += [textsteps.prompted(options.neural)] if options.neural else []
    for step in steps:
        records = records.withColumns({f: textsteps.rewrite(F.col(f), step) for f in MASKED_FIELDS})
    return records


def readable(raw: DataFrame) -> DataFrame:
    """The rows that the reader could parse; others only hold a position."""
    return messages.drop_unparsed(raw) if "_corrupt_record" in raw.columns else raw


def stored_attachments(raw: DataFrame, records: DataFrame, attachments: DataFrame) -> DataFrame:
    """Accepted attachments of the given records with the path each is stored under.

    Attachments name their message by its position in the folder, and positions count every row of ``raw``: those
    that duplicate removal drops and those that could not be parsed as well. Names are unique per Email_ID, also where
    several records share one. All of this works on ids and names; the bytes take part in the last join only.
    """
    places = raw.where(F.col("folder_path").isNotNull() & F.col("pos").isNotNull()).select("folder_path", "pos", "scan_pos")
    located = messages.with_message_index(places).drop("pos").join(records.select("scan_pos", "Email_ID"), "scan_pos")
    narrow = T.with_safe_name(T.accepted(attachments)).select(*T.MESSAGE, "attachment_index", "safe_name")
    named = narrow.join(located, T.MESSAGE)
    s, i = F.col("scan_pos"), F.col("attachment_index")
    blocks = [F.expr(f"scan_pos div {messages.SUPER_BLOCK}"), F.expr(f"scan_pos div {messages.BLOCK}"), s,
              F.expr(f"attachment_index div {T.BLOCK}")]
    ordered = numbered(named, ["Email_ID"], [s, i], blocks, "file_no")
    paths = T.stored_paths(T.with_stored_name(ordered, ["Email_ID"], "file_no"))
    place = [*T.MESSAGE, "attachment_index"]
    return attachments.select(*place, "content").join(paths.drop("file_no"), place)


def with_attachment_text(records: DataFrame, saved: DataFrame, attachments: DataFrame) -> DataFrame:
    """Records with the metadata, texts and types of their stored attachments."""
    described = T.describe_content(T.with_safe_name(T.accepted(attachments)))
    place = [*T.MESSAGE, "attachment_index"]
    of_records = described.join(saved.select(*place, "scan_pos", "stored_name"), place)
    return T.enrich_messages(records, T.enrich(of_records, ["scan_pos"]), "scan_pos")


def masked_attachment_text(records: DataFrame, custom: dict[str, str] | None) -> DataFrame:
    """Attachment texts masked like the other text fields, in the record's text and in its metadata."""
    def masked(m: Column) -> Column:
        text = m["extracted_text"]
        return m.withField("extracted_text", F.when(text.isNotNull(), mask_pii(text, custom)))
    return records.withColumns({"Attachment_Content": mask_pii(F.col("Attachment_Content"), custom),
                                "Attachment_Metadata": F.transform("Attachment_Metadata", masked)})


def extract(spark: SparkSession, raw: DataFrame, out: str, options: Options,
            attachments: DataFrame | None = None) -> Result:
    """Write the mailbox in every chosen format; with ``attachments`` also their bytes.

    ``attachments`` carries folder_path and message_index, the position among all rows of ``raw`` in that folder;
    only those of kept messages are stored. With ``attachment_text`` their metadata and texts are exported too.
    A run does not replace another: the run's folder must be new.
    """
    chosen = writers.formats_of(options.formats)
    records = records_of(raw, options)
    result = Result(options.run_id)
    if attachments is not None:
        stored = stored_attachments(raw, records, attachments)
        path = f"{out}/{options.run_id}/attachments"
        result.paths["attachments"] = writers.write_attachments(stored, path)
        # What was written is read back without the bytes, so names are computed once.
        saved = spark.read.parquet(path).drop("content")
        records = T.with_saved_paths(records, saved.select("scan_pos", "attachment_index", "path"), "scan_pos")
        if options.attachment_text:
            records = with_attachment_text(records, saved, attachments)
            if options.mask and options.mask_all_text:
                records = masked_attachment_text(records, options.custom_patterns)
    base = f"{out}/{options.run_id}"
    kept = records.persist(StorageLevel.DISK_ONLY)  # for all formats, the index and the totals
    try:
        # Records always carry an id, so no positions need to be counted for it.
        result.paths.update(writers.fan_out(kept, base, chosen, options.compress, fill_ids=False, keep=False))
        if options.index:
            result.paths["index"] = writers.write_index(index.index_view(kept), f"{base}/index")
        totals = kept.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("Attachment_Paths")).alias("a")).first()
    finally:
        kept.unpersist()
    result.email_count, result.attachments_saved = totals["n"], totals["a"] or 0
    return result


def address_reports(raw: DataFrame, deduplicate: bool = False) -> tuple[DataFrame, DataFrame]:
    """Address and host report of a mailbox."""
    records = messages.build_records(raw)
    if deduplicate:
        records = dedup.keep_first(records, dedup.record_key())
    return A.address_report(records), A.host_report(records)


def addresses(raw: DataFrame, out: str, options: Options) -> Result:
    """Write the address and host reports; a mailbox without addresses is an error."""
    chosen = writers.formats_of(options.formats, writers.ADDRESS_FORMATS)
    report, hosts = address_reports(raw, options.deduplicate)
    result = Result(options.run_id)
    base = f"{out}/{options.run_id}"
    report, hosts = report.persist(), hosts.persist()
    try:
        result.address_count, result.host_count = report.count(), hosts.count()
        if not result.address_count:
            raise RuntimeError("no addresses found")
        if "json" in chosen:
            result.paths.update(writers.write_address_json(report, hosts, base))
        if "csv" in chosen:
            result.paths["addresses_csv"] = writers.write_address_csv(report, f"{base}/addresses_csv")
            if result.host_count:
                result.paths["hosts_csv"] = writers.write_host_csv(hosts, f"{base}/hosts_csv")
    finally:
        report.unpersist()
        hosts.unpersist()
    return result
