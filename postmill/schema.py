"""Explicit schemas and field lists. Nothing is inferred at read time."""

from __future__ import annotations

from pyspark.sql import types as T

# One row per message as it lies in the mailbox, before any derivation.
# scan_pos is the row's place in the depth-first scan and is unique.
MESSAGES = T.StructType([
    T.StructField("folder_path", T.StringType()),
    T.StructField("pos", T.LongType()),
    T.StructField("scan_pos", T.LongType()),
    T.StructField("internet_message_id", T.StringType()),
    T.StructField("subject", T.StringType()),
    T.StructField("sender_name", T.StringType()),
    T.StructField("sender_email_address", T.StringType()),
    T.StructField("display_to", T.StringType()),
    T.StructField("display_cc", T.StringType()),
    T.StructField("display_bcc", T.StringType()),
    T.StructField("delivery_time", T.TimestampType()),
    T.StructField("client_submit_time", T.TimestampType()),
    T.StructField("plain_text_body", T.StringType()),
    T.StructField("html_body", T.StringType()),
    T.StructField("rtf_body", T.StringType()),
    T.StructField("message_class", T.StringType()),
    T.StructField("transport_headers", T.StringType()),
    T.StructField("number_of_attachments", T.IntegerType()),
    T.StructField("priority", T.IntegerType()),
    T.StructField("is_read", T.BooleanType()),
])

ATTACHMENTS = T.StructType([
    T.StructField("folder_path", T.StringType()),
    T.StructField("message_index", T.LongType()),
    T.StructField("attachment_index", T.LongType()),
    T.StructField("long_filename", T.StringType()),
    T.StructField("file_name", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("size", T.StringType()),
    T.StructField("content", T.BinaryType()),
])

FOLDERS = T.StructType([
    T.StructField("folder_path", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("parent_path", T.StringType()),
])

DICTIONARY = T.StructType([
    T.StructField("word", T.StringType()),
    T.StructField("freq", T.LongType()),
])

# --- fixed values: export field names and their order -----------------------------------------
EXPORT_FIELDS = [
    "Email_ID", "Date_Received", "Date_Sent", "From", "Sender_Email", "To", "CC", "BCC", "Reply_To",
    "Subject", "Body", "Importance", "Attachment_Count", "Attachment_Paths", "Attachment_Metadata",
    "Attachment_Content", "Attachment_Types", "Message_ID", "Content_Type", "Email_Client",
    "Return_Path", "Client_Info", "Thread_ID", "Parent_ID", "References", "Received_Hops",
    "Full_Headers",
]
ADDRESS_FIELDS = ["Address", "Count", "Roles", "Domains", "Names"]
HOST_FIELDS = ["Host", "Count"]
INDEX_FIELDS = [
    "Subject", "From", "Sender_Email", "To", "CC", "BCC", "Date_Received", "Date_Sent",
    "Attachment_Count", "Attachment_Paths", "Email_ID",
]
MASKED_FIELDS = ["Subject", "Body", "From", "To", "CC", "BCC"]
EXTRA_MASKED_FIELDS = ["Sender_Email", "Reply_To", "HTML_Body", "Full_Headers", "Attachment_Content"]
# ----------------------------------------------------------------------------------------------
