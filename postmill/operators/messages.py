"""From mailbox rows to message records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.functions import headers as H
from postmill.functions import identity as I
from postmill.functions import masking, text
from postmill.operators.numbering import numbered
from postmill.schema import EXTRA_MASKED_FIELDS, MASKED_FIELDS

# Rows per piece when positions are counted.
BLOCK = 1 << 16
SUPER_BLOCK = 1 << 28


def build_records(raw: DataFrame) -> DataFrame:
    """One record per mailbox row: 27 derived fields plus the row's place in the mailbox.

    A single projection, so a job that needs seven of the fields reads only their source
    columns.
    """
    h = F.col("transport_headers")
    name, email = F.col("sender_name"), F.col("sender_email_address")
    mid = text.text_or_empty(F.col("internet_message_id"))
    refs, parent = H.references(h), H.parent_id(h)
    delivered, sent = F.col("delivery_time"), F.col("client_submit_time")
    fields: dict[str, Column] = {
        "Email_ID": I.email_id(mid, F.col("subject"), email, name, delivered),
        "Date_Received": F.coalesce(I.timestamp_text(delivered), F.lit("")),
        "Date_Received_Timestamp": I.epoch_seconds(delivered),
        "Date_Sent": F.coalesce(I.timestamp_text(sent), F.lit("")),
        "Date_Sent_Timestamp": I.epoch_seconds(sent),
        "From": I.from_display(name, email),
        "Sender_Email": text.text_or_empty(email),
        "To": text.text_or_empty(F.col("display_to")),
        "CC": text.text_or_empty(F.col("display_cc")),
        "BCC": text.text_or_empty(F.col("display_bcc")),
        "Reply_To": H.header_field(h, "reply-to"),
        "Subject": text.text_or_empty(F.col("subject")),
        "Body": text.resolve_body(F.col("plain_text_body"), F.col("html_body"), F.col("rtf_body")),
        "HTML_Body": text.clean_utf8(F.col("html_body")),
        "Importance": I.importance(F.col("priority")),
        "Attachment_Count": F.coalesce(F.col("number_of_attachments"), F.lit(0)),
        "Attachment_Paths": F.array().cast("array<string>"),
        "Message_ID": mid,
        "Content_Type": text.text_or_empty(F.col("message_class")),
        "Email_Client": H.header_field(h, "x-mailer"),
        "Return_Path": H.header_field(h, "return-path"),
        "Client_Info": text.text_or_empty(F.col("message_class")),
        "Thread_ID": H.thread_id(refs, parent, mid),
        "Parent_ID": parent,
        "References": refs,
        "Received_Hops": H.received_hops(h),
        "Full_Headers": text.text_or_empty(h),
    }
    place = ["folder_path", "pos", "scan_pos", "is_read"]
    return raw.select(*place, *[c.alias(n) for n, c in fields.items()])


def drop_unparsed(df: DataFrame, corrupt: str = "_corrupt_record") -> DataFrame:
    """Rows the reader could not parse go; the marker column too."""
    return df.where(F.col(corrupt).isNull()).drop(corrupt)


def with_message_index(df: DataFrame) -> DataFrame:
    """0-based position inside the folder."""
    p = F.col("pos")
    blocks = [F.expr(f"pos div {SUPER_BLOCK}"), F.expr(f"pos div {BLOCK}")]
    return numbered(df, ["folder_path"], [p], blocks, "message_index")


def with_scan_index(df: DataFrame) -> DataFrame:
    """0-based position in the depth-first scan over all folders."""
    s = F.col("scan_pos")
    blocks = [F.expr(f"scan_pos div {SUPER_BLOCK}"), F.expr(f"scan_pos div {BLOCK}")]
    return numbered(df, [], [s], blocks, "scan_index")


def with_fallback_id(df: DataFrame) -> DataFrame:
    """Records without an Email_ID get ``email_{position in the scan}``.

    Positions are counted on the narrow pair (place, id); only those of records without an id are
    joined back, so the wide rows stay where they are.
    """
    has_id = F.coalesce(F.col("Email_ID"), F.lit("")) != ""
    places = with_scan_index(df.select("scan_pos", has_id.alias("_has_id")))
    given = places.where(~F.col("_has_id")).select(
        "scan_pos", F.concat(F.lit("email_"), F.col("scan_index").cast("string")).alias("_given"))
    return df.join(given, "scan_pos", "left").withColumn("Email_ID", F.coalesce("_given", "Email_ID")).drop("_given")


def folder_page(df: DataFrame, folder: str, start: int = 0, limit: int = 100) -> DataFrame:
    """Records of one folder from position ``start``, at most ``limit`` (a page, by request).

    Rows marked unparsed (``parsed`` false, where the column exists) hold a position but do not
    count towards the page. Positions are counted on the narrow place; the page's rows are then picked by a join with
    at most ``limit`` places, so that bodies are never shuffled.
    """
    if not folder.startswith("/") or not folder.strip("/"):
        raise ValueError("folder must be an absolute path such as /Root/Inbox")
    if limit <= 0:
        return with_message_index(df).limit(0)
    rows = df.where(F.col("folder_path") == folder)
    flags = ["parsed"] if "parsed" in df.columns else []
    places = with_message_index(rows.select("folder_path", "pos", *flags)).where(F.col("message_index") >= start)
    if flags:
        places = places.where("parsed")
    # The limit bounds what is broadcast.
    wanted = places.orderBy("message_index").limit(limit).select("folder_path", "pos", "message_index")
    page = rows.join(F.broadcast(wanted), ["folder_path", "pos"])
    return page.select(*[rows[c] for c in df.columns], "message_index").orderBy("message_index").limit(limit)


def mask_records(df: DataFrame, custom: dict[str, str] | None = None, mask_all_text: bool = False) -> DataFrame:
    """Mask the six text fields, once, ahead of every sink."""
    fields = MASKED_FIELDS + (EXTRA_MASKED_FIELDS if mask_all_text else [])
    texts = [f for f in fields if dict(df.dtypes).get(f) == "string"]
    return df.withColumns({f: masking.mask_pii(F.col(f), custom) for f in texts})
