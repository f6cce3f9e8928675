"""Named queries over attachments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.functions import files as X
from postmill.operators import attachments as T
from postmill.operators import charsets as CS
from postmill.operators import messages
from postmill.plans import jobs
from postmill.plans import statements as S
from postmill.plans.queries_messages import records
from postmill.session import shared_dir, written
from postmill.sinks import writers
from postmill.sources import sample

Q: dict[str, tuple] = {}


def query(sql: str | None):
    def add(fn):
        Q[fn.__name__] = (fn, sql)
        return fn
    return add


def attachments(spark: SparkSession, sf: str) -> DataFrame:
    return sample.attachments(spark, sf)


def guarded(spark: SparkSession, sf: str) -> DataFrame:
    return T.with_safe_name(T.guard_sizes(attachments(spark, sf)))


def typed(spark: SparkSession, sf: str) -> DataFrame:
    df = guarded(spark, sf)
    return df.withColumn("mime_type", X.mime_from_content(F.col("content"), F.col("safe_name")))


@query(S.query(S.ATTACHMENTS, """SELECT folder_path, message_index, attachment_index,
  coalesce(given_name, 'attachment_' || attachment_index) AS filename, try_cast(size AS BIGINT) AS size FROM att"""))
def scan_attachments(spark, sf):
    return T.list_attachments(attachments(spark, sf))


@query(S.query(S.ATTACHMENTS, "SELECT doc_id, safe_name FROM guarded"))
def attachment_safe_name(spark, sf):
    return guarded(spark, sf).select("doc_id", "safe_name")


@query(S.query(S.ATTACHMENTS, "SELECT doc_id, rejection FROM guarded"))
def attachment_size_guard(spark, sf):
    return guarded(spark, sf).select("doc_id", "rejection")


# What was written is to be read again; texts that are all ASCII are UTF-8 in any of the single-byte charsets.
_WRITTEN = rf"""SELECT doc_id, CASE WHEN k = 5 THEN 'utf-16-le' WHEN k = 0 OR NOT regexp_matches(t, '[^\x00-\x7F]') THEN 'utf-8'
    ELSE ['{"', '".join(CS.CHARSETS)}'][k] END AS charset, t AS text
  FROM (SELECT doc_id, k, CASE k WHEN 1 THEN regexp_replace(x, '[^\x00-\x7FÀ-ÿ]', '?', 'g') WHEN 2 THEN translate(a, '{sample.CENTRAL[0]}', '{sample.CENTRAL[1]}')
    WHEN 3 THEN translate(a, '{sample.CYRILLIC[0]}', '{sample.CYRILLIC[1]}') WHEN 4 THEN translate(a, '{sample.KATAKANA[0]}', '{sample.KATAKANA[1]}')
    ELSE x END AS t
  FROM (SELECT doc_id, doc_id % 6 AS k, coalesce(text, '') AS x, regexp_replace(coalesce(text, ''), '[^\x00-\x7F]', '?', 'g') AS a FROM documents))"""


@query(_WRITTEN)
def decode_guess(spark, sf):
    """Documents in six encodings, read by a model that was learned from all of them."""
    contents = written(sample.reencoded(spark, sf).select("doc_id", "charset", "content"), "contents")
    return CS.decode_guess(contents.select("doc_id", "content"), CS.learn(contents)).select("doc_id", "charset", "text")


@query(S.query(S.ATTACHMENTS, """SELECT doc_id, CASE WHEN s > 52428800 THEN 'Attachment too large (' || s || ' bytes > 50MB)' END AS error_message
  FROM (SELECT doc_id, try_cast(size AS BIGINT) AS s FROM att)"""))
def content_size_limit(spark, sf):
    size = F.col("size").try_cast("bigint")
    return attachments(spark, sf).select("doc_id", X.content_limit_error(size).alias("error_message"))


@query(S.query(S.ATTACHMENTS, f"SELECT doc_id, {S.mime_by_name('given_name')} AS mime_type FROM att"))
def mime_from_extension(spark, sf):
    name = F.coalesce(F.nullif(F.col("long_filename"), F.lit("")), F.col("file_name"))
    return attachments(spark, sf).select("doc_id", X.mime_from_extension(name).alias("mime_type"))


@query(S.query(S.DESCRIBED, "SELECT doc_id, mime_type FROM typed", True))
def mime_from_content(spark, sf):
    return typed(spark, sf).select("doc_id", "mime_type")


@query(S.query(S.DESCRIBED, "SELECT doc_id, content_type FROM routed", True))
def content_category(spark, sf):
    return typed(spark, sf).select("doc_id", X.content_category(F.col("mime_type")).alias("content_type"))


@query(S.query(S.DESCRIBED, "SELECT doc_id, mime_type FROM routed WHERE method <> 'fallback'", True))
def supported_types(spark, sf):
    return typed(spark, sf).where(X.is_supported(F.col("mime_type"))).select("doc_id", "mime_type")


@query(S.query(S.ATTACHMENTS, "SELECT doc_id, content_text AS text FROM att"))
def decode_text(spark, sf):
    return attachments(spark, sf).select("doc_id", X.decode_text(F.col("content")).alias("text"))


@query(S.query(S.DESCRIBED, "SELECT doc_id, method, CASE WHEN method = 'direct' THEN content_text END AS extracted_text FROM routed", True))
def extraction_route(spark, sf):
    df = typed(spark, sf).withColumn("method", X.extraction_method(F.col("mime_type")))
    return df.select("doc_id", "method", F.when(F.col("method") == "direct", X.decode_text(F.col("content"))).alias("extracted_text"))


@query(S.query(S.ATTACHMENTS, r"""SELECT doc_id, CASE lower(regexp_extract(given_name, '\.([^.]*)$', 1)) WHEN 'pdf' THEN 'PDF'
  WHEN 'docx' THEN 'DOCX' WHEN 'txt' THEN 'TXT' WHEN 'png' THEN 'IMG' WHEN 'zip' THEN 'ZIP' ELSE 'FILE' END AS kind FROM att"""))
def file_kind(spark, sf):
    return attachments(spark, sf).select("doc_id", X.file_kind(F.col("file_name")).alias("kind"), "long_filename").select(
        "doc_id", F.when(F.col("long_filename") != "", X.file_kind(F.col("long_filename"))).otherwise(F.col("kind")).alias("kind"))


@query(S.query(S.STORED, "SELECT folder_path, message_index, attachment_index, stored_name FROM stored", True))
def conflict_names(spark, sf):
    return T.stored_names(T.with_safe_name(T.accepted(attachments(spark, sf))))


_INBOX = S.RECORDS + "," + S.STORED.strip() + """,
located AS (SELECT "Email_ID", scan_pos, folder_path, row_number() OVER (PARTITION BY folder_path ORDER BY pos) - 1 AS message_index FROM records)"""


def _located(spark, sf) -> DataFrame:
    return messages.with_message_index(records(spark, sf).select("Email_ID", "scan_pos", "folder_path", "pos")).drop("pos")


@query(S.query(_INBOX, """SELECT l."Email_ID", a.doc_id, a.attachment_index, octet_length(a.content) AS n_bytes FROM located l
  JOIN att a ON a.folder_path = l.folder_path AND a.message_index = l.message_index""", True))
def message_attachments(spark, sf):
    slim = attachments(spark, sf).select(*T.MESSAGE, "attachment_index", "doc_id", F.octet_length("content").cast("bigint").alias("n_bytes"))
    return T.message_attachments(_located(spark, sf), slim).select("Email_ID", "doc_id", "attachment_index", "n_bytes")


_PATHS = S.STORED + """,
wanted AS (SELECT doc_id, message_index || '/' || safe_name AS path FROM guarded),
files AS (SELECT s.message_index || '/' || s.stored_name AS path, octet_length(g.content) AS size FROM stored s
  JOIN guarded g ON g.message_index = s.message_index AND g.attachment_index = s.attachment_index)"""


def _wanted_and_files(spark, sf) -> tuple[DataFrame, DataFrame]:
    g = guarded(spark, sf)
    wanted = g.select("doc_id", F.concat_ws("/", F.col("message_index").cast("string"), "safe_name").alias("path"))
    ok = g.where(F.col("rejection").isNull()).select(
        *T.MESSAGE, "attachment_index", "safe_name", F.octet_length("content").cast("bigint").alias("size"))
    stored = T.with_stored_name(ok)
    return wanted, stored.select(F.concat_ws("/", F.col("message_index").cast("string"), "stored_name").alias("path"), "size")


@query(S.query(_PATHS, "SELECT w.doc_id, w.path, f.size FROM wanted w LEFT JOIN files f ON f.path = w.path", True))
def resolve_attachment_paths(spark, sf):
    return T.resolve_paths(*_wanted_and_files(spark, sf)).select("doc_id", "path", "size")


@query(S.query(_PATHS, "SELECT doc_id, path FROM wanted WHERE path NOT IN (SELECT path FROM files)", True))
def missing_attachments(spark, sf):
    return T.missing_paths(*_wanted_and_files(spark, sf)).select("doc_id", "path")


@query(S.query(S.DESCRIBED, """SELECT folder_path, message_index,
    string_agg(CASE WHEN method = 'direct' THEN content_text END, chr(10) || chr(10) ORDER BY attachment_index) AS content,
    string_agg(DISTINCT mime_type, '; ' ORDER BY mime_type) AS types,
    string_agg(attachment_index || ':' || stored_name || ':' || n_bytes || ':' || content_type || ':' || method, '; ' ORDER BY attachment_index) AS metadata
  FROM routed JOIN stored USING (folder_path, message_index, attachment_index) GROUP BY folder_path, message_index""", True))
def attachment_enrichment(spark, sf):
    att = T.with_safe_name(T.accepted(attachments(spark, sf)))
    enriched = T.enrich(T.with_stored_name(T.describe_content(att)), T.MESSAGE)
    line = F.transform("Attachment_Metadata", lambda m: F.concat_ws(
        ":", m["index"].cast("string"), m["filename"], m["size"].cast("string"), m["content_type"], m["text_extraction_method"]))
    return enriched.select(*T.MESSAGE, F.nullif(F.col("Attachment_Content"), F.lit("")).alias("content"),
                           F.array_join("Attachment_Types", "; ").alias("types"), F.array_join(line, "; ").alias("metadata"))


_SAVED = _INBOX + """,
saved AS (SELECT l."Email_ID", l.scan_pos, s.attachment_index, l."Email_ID" || '/' || s.stored_name AS path, octet_length(g.content) AS n_bytes
  FROM located l JOIN stored s ON s.folder_path = l.folder_path AND s.message_index = l.message_index
  JOIN guarded g ON g.message_index = s.message_index AND g.attachment_index = s.attachment_index)"""


def _saved(spark, sf) -> DataFrame:
    """Paths settled on ids and names; the bytes are joined last and once."""
    att = attachments(spark, sf)
    names = T.stored_names(T.with_safe_name(T.accepted(att)).select(*T.MESSAGE, "attachment_index", "safe_name"))
    paths = T.stored_paths(names.join(_located(spark, sf), T.MESSAGE))
    place = [*T.MESSAGE, "attachment_index"]
    return att.select(*place, "content").join(paths, place)


@query(S.query(_SAVED, 'SELECT "Email_ID", path, n_bytes FROM saved', True))
def save_attachments(spark, sf):
    path = writers.write_attachments(_saved(spark, sf), shared_dir(spark, "attachments"))
    return spark.read.parquet(path).select("Email_ID", "path", F.octet_length("content").cast("bigint").alias("n_bytes"))


@query(S.query(_SAVED, """SELECT r.scan_pos, coalesce(string_agg(s.path, '; ' ORDER BY s.attachment_index), '') AS paths,
  CASE WHEN count(s.path) > 0 THEN count(s.path) ELSE any_value(r."Attachment_Count") END AS "Attachment_Count"
  FROM records r LEFT JOIN saved s ON s.scan_pos = r.scan_pos GROUP BY r.scan_pos""", True))
def saved_paths_per_message(spark, sf):
    saved = _saved(spark, sf).select("scan_pos", "attachment_index", "path")
    out = T.with_saved_paths(records(spark, sf), saved, "scan_pos")
    return out.select("scan_pos", F.array_join("Attachment_Paths", "; ").alias("paths"), F.col("Attachment_Count").cast("bigint"))


_EXPORTED = S.UNIQUE + "," + S.DESCRIBED.strip() + """,
located AS (SELECT "Email_ID", scan_pos, folder_path, row_number() OVER (PARTITION BY folder_path ORDER BY pos) - 1 AS message_index FROM records),
files AS (SELECT l.scan_pos, r.attachment_index, l."Email_ID" || '/' || s.stored_name AS path, r.mime_type,
    CASE WHEN r.method = 'direct' THEN r.content_text END AS content_text
  FROM located l JOIN routed r ON r.folder_path = l.folder_path AND r.message_index = l.message_index
  JOIN stored s ON s.folder_path = r.folder_path AND s.message_index = r.message_index AND s.attachment_index = r.attachment_index)"""


@query(S.query(_EXPORTED, """SELECT k.scan_pos, any_value(k."Email_ID") AS "Email_ID",
  CASE WHEN count(f.path) > 0 THEN count(f.path) ELSE any_value(k."Attachment_Count") END AS "Attachment_Count",
  coalesce(string_agg(f.path, '; ' ORDER BY f.attachment_index), '') AS paths,
  coalesce(string_agg(f.content_text, chr(10) || chr(10) ORDER BY f.attachment_index), '') AS content,
  coalesce(string_agg(DISTINCT f.mime_type, '; ' ORDER BY f.mime_type), '') AS types
  FROM kept k LEFT JOIN files f ON f.scan_pos = k.scan_pos GROUP BY k.scan_pos""", True))
def extract_with_attachments(spark, sf):
    """The export job with duplicate removal, stored files and their texts, read back from its JSON."""
    options = jobs.Options(formats=["json"], deduplicate=True, attachment_text=True)
    raw = sample.mailbox(spark, sf)
    result = jobs.extract(spark, raw, shared_dir(spark, "extract"), options, attachments(spark, sf))
    back = spark.read.schema("scan_pos long, Email_ID string, Attachment_Count long, Attachment_Paths array<string>, "
                             "Attachment_Content string, Attachment_Types array<string>").json(result.paths["json"])
    return back.select("scan_pos", "Email_ID", "Attachment_Count", F.array_join("Attachment_Paths", "; ").alias("paths"),
                       F.col("Attachment_Content").alias("content"), F.array_join("Attachment_Types", "; ").alias("types"))
