"""Attachments: listing, size guard, stored names, content metadata, joins to messages."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.functions import files as X
from postmill.operators.numbering import numbered
from postmill.session import written

MESSAGE = ["folder_path", "message_index"]
# Rows per piece when positions are counted.
BLOCK = 4096


def list_attachments(att: DataFrame) -> DataFrame:
    """Index, file name and size; a size that is no whole number is null."""
    name = X.first_name(F.col("long_filename"), F.col("file_name"), F.col("name"), index=F.col("attachment_index"))
    return att.select(*MESSAGE, "attachment_index", name.alias("filename"),
                      F.col("size").try_cast("bigint").alias("size"))


def guard_sizes(att: DataFrame) -> DataFrame:
    """Adds ``rejection``: why an attachment is not stored, null if it is."""
    return att.withColumn("rejection", X.size_rejection(F.col("size"), F.octet_length("content")))


def accepted(att: DataFrame) -> DataFrame:
    return guard_sizes(att).where(F.col("rejection").isNull()).drop("rejection")


def rejected(att: DataFrame) -> DataFrame:
    return guard_sizes(att).where(F.col("rejection").isNotNull())


def with_safe_name(att: DataFrame) -> DataFrame:
    fallback = F.concat(F.lit("attachment_"), F.col("attachment_index").cast("string"))
    raw = F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in ("long_filename", "file_name", "name")])
    return att.withColumn("safe_name", X.safe_name(raw, fallback))


# --- stored names ------------------------------------------------------------------------------
#
# The n-th file of one name in a message becomes name, name_2, name_3, ... and skips numbers taken
# by a file that came earlier under that literal name. A "link" is such a literal name: child
# ``a_2.txt`` of parent ``a.txt`` with number 2. Without links (nearly always) the position of the
# file among its equals gives the number. With links, the parent skips a child's number if the child
# came first, else the child finds its own name taken. A name has at most as many children as its
# message has files.


def _links(att: DataFrame, keys: list[str], index: str, name: str) -> DataFrame | None:
    """Pairs of present names where one is the other plus a number, with the parent's earlier files; None if there is no such pair."""
    names = att.groupBy(*keys, name).agg(F.min(index).alias("child_first"))
    stem = X.name_stem(F.col(name))
    pattern = r"^(.+)_([2-9]|[1-9][0-9]+)$"
    children = names.withColumn("number", F.regexp_extract(stem, pattern, 2).try_cast("bigint"))
    children = children.where(F.col("number").isNotNull()).select(
        *keys, F.col(name).alias("child"), "number", "child_first",
        F.concat(F.regexp_extract(stem, pattern, 1), X.name_suffix(F.col(name))).alias(name))
    linked = written(children.join(names.select(*keys, name), keys + [name]), "links")
    if linked.isEmpty():
        return None
    # Position of the child's first file among the parent's files: number the parent's files and the
    # markers together, then take away the markers before.
    parents = linked.select(*keys, name).distinct()
    rows = att.join(parents, keys + [name], "left_semi").select(
        *keys, name, F.col(index).alias("at"), F.lit(None).cast("string").alias("child"))
    marks = linked.select(*keys, name, F.col("child_first").alias("at"), "child")
    order = [F.col("at"), F.col("child").isNotNull(), F.col("child")]
    placed = numbered(rows.unionByName(marks), keys + [name], order, [F.expr(f"at div {BLOCK}")], "place")
    marked = numbered(marks, keys + [name], order, [F.expr(f"at div {BLOCK}")], "mark")
    at_marks = placed.where(F.col("child").isNotNull()).drop("at").join(
        marked.drop("at"), keys + [name, "child"])
    earlier = at_marks.select(*keys, name, "child", (F.col("place") - F.col("mark")).alias("earlier"))
    return linked.drop("child_first").join(earlier, keys + [name, "child"])


def _settle(links: DataFrame, keys: list[str], name: str) -> DataFrame:
    """(keys, name, child, number, skip, nth) of ``links`` with ``taken`` of the parents known.

    Children are visited by number; the s-th skip happens where the parent has not had enough conflicts by then:
    number - 1 - conflicts > skips so far, which ``nth`` counts. A parent's children stream through a task that keeps
    nothing but that count.
    """
    parent = [*keys, name]
    rows = links.select(*parent, "child", "number", "earlier", "taken")
    fields = rows.select(*parent, "child", "number").schema.simpleString()[len("struct<"):-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, skips = None, 0
        for batch in batches:
            found: list[tuple[bool, int]] = []
            of = zip(*(batch.column(c).to_pylist() for c in parent), strict=True)
            facts = zip(*(batch.column(c).to_pylist() for c in ("number", "earlier", "taken")), strict=True)
            for key, (number, earlier, taken) in zip(of, facts, strict=True):
                last, skips = key, skips if key == last else 0
                skip = number - 1 - max(earlier - (0 if taken else 1), 0) > skips
                skips += skip
                found.append((skip, skips))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in (*parent, "child", "number")), pa.array([f[0] for f in found], pa.bool_()),
                 pa.array([f[1] for f in found], pa.int64())], [*parent, "child", "number", "skip", "nth"])

    ordered = rows.repartition(*parent).sortWithinPartitions(*parent, "number")
    return ordered.mapInArrow(run, f"{fields},skip:boolean,nth:bigint")


def _rules(links: DataFrame, keys: list[str], name: str) -> tuple[DataFrame, DataFrame]:
    """(keys, name) of the linked names that are taken from their first file on, and (keys, name, number, nth) of all
    skips; parents before children, to any depth."""
    as_child = links.select(*keys, F.col("child").alias(name)).distinct()
    level = links.join(as_child, keys + [name], "left_anti").withColumn("taken", F.lit(False))
    taken = skips = None
    while True:
        done = written(_settle(level, keys, name), "settled")
        heirs = done.select(*keys, F.col("child").alias(name), (~F.col("skip")).alias("taken"))
        found = heirs.where("taken").drop("taken"), done.where("skip").select(*keys, name, "number", "nth")
        taken, skips = found if taken is None else (taken.unionByName(found[0]), skips.unionByName(found[1]))
        level = links.join(heirs, keys + [name])
        if level.isEmpty():
            return taken, skips


def _numbers(rows: DataFrame, skips: DataFrame, keys: list[str], index: str, name: str) -> DataFrame:
    """(keys, index, _skipped): how many of its name's skips lie below each file's number.

    The n-th skip of a name lies below the number of a file with that many conflicts or more as the skipped number
    exceeds n: files and skips are counted together in that order, the files before are taken away.
    """
    some = rows.join(skips.select(*keys, name).distinct(), keys + [name], "left_semi").select(
        *keys, name, index, "_place", F.col("_conflict").alias("_value"), F.lit(1).alias("_kind"))
    marks = skips.select(*keys, name, F.lit(None).cast(dict(rows.dtypes)[index]).alias(index), F.lit(None).cast("long").alias("_place"),
                         (F.col("number") - F.col("nth")).alias("_value"), F.lit(0).alias("_kind"))
    both = some.withColumn("_place", F.col("_place").cast("long")).unionByName(marks)
    counted = numbered(both, keys + [name], [F.col("_value"), F.col("_kind")], [F.expr(f"_value div {BLOCK}")], "_at")
    return counted.where("_kind = 1").select(*keys, index, (F.col("_at") - (F.col("_place") - 1)).alias("_skipped"))


def stored_names(att: DataFrame, keys: Sequence[str] = tuple(MESSAGE), index: str = "attachment_index",
                 name: str = "safe_name") -> DataFrame:
    """keys, index and ``stored_name``, unique within ``keys``.

    Only keys, index and name are read, once: that narrow table is written to the shared folder and
    all steps work on it. Literal numbered names are followed through all generations (``a``,
    ``a_2``, ``a_2_2``, ...), one round of small joins for each.
    """
    keys = list(keys)
    att = written(att.select(*keys, index, name), "names")
    placed = numbered(att, keys + [name], [F.col(index)], [F.expr(f"{index} div {BLOCK}")], "_place", first=1)
    links = _links(att, keys, index, name)
    if links is None:
        rows = placed.withColumn("_conflict", F.col("_place").cast("bigint") - 1).withColumn("_skipped", F.lit(0))
    else:
        taken, skips = _rules(written(links, "numbered-links"), keys, name)
        known = placed.join(taken.withColumn("_taken", F.lit(True)), keys + [name], "left")
        rows = written(known.withColumn("_conflict", F.col("_place").cast("bigint") - F.when(F.col("_taken"), 0).otherwise(1)).drop("_taken"), "conflicts")
        rows = rows.join(_numbers(rows, skips, keys, index, name), [*keys, index], "left")
    number = F.col("_conflict") + 1 + F.coalesce("_skipped", F.lit(0))
    numbered_name = F.concat(X.name_stem(F.col(name)), F.lit("_"), number.cast("string"), X.name_suffix(F.col(name)))
    return rows.select(*keys, index, F.when(F.col("_conflict") == 0, F.col(name)).otherwise(numbered_name)
                       .alias("stored_name"))


def with_stored_name(att: DataFrame, keys: Sequence[str] = tuple(MESSAGE), index: str = "attachment_index",
                     **options) -> DataFrame:
    """Adds ``stored_name``; the wide rows take part in one join only."""
    return att.join(stored_names(att, keys, index, **options), [*keys, index])


# --- content -----------------------------------------------------------------------------------


def describe_content(att: DataFrame, name: str = "safe_name", max_mb: int = X.MAX_CONTENT_MB,
                     size: str | None = None, decode: Callable[[Column], Column] = X.decode_text, **options) -> DataFrame:
    """Per attachment: size, type, category, text, route and error. ``decode`` gives the text of bytes that are read directly.

    Bytes are dropped here, ahead of any shuffle. The type depends on the name's extension only, so
    stored names can be joined afterwards. ``size`` names a column to use in place of the content's
    length.
    """
    c = F.col("content")
    length = F.coalesce(F.octet_length(c), F.lit(0)).cast("bigint") if size is None else F.col(size).cast("bigint")
    gone = ("content", "size", "long_filename", "file_name", "name", "rejection")
    extra = [k for k in att.columns if k not in gone]
    sized = att.withColumn("_size", length).withColumn("error_message", X.content_limit_error(F.col("_size"), max_mb))
    ok = F.col("error_message").isNull()
    typed = sized.withColumn("mime_type", F.when(ok, X.mime_from_content(c, F.col(name))).otherwise(X.OCTET_STREAM))
    routed = typed.withColumn("text_extraction_method", F.when(ok, X.extraction_method(F.col("mime_type"), **options)))
    return routed.select(
        *extra, F.col("_size").alias("size"), "mime_type",
        F.when(ok, X.content_category(F.col("mime_type"))).otherwise("binary").alias("content_type"),
        decode(F.when(F.col("text_extraction_method") == "direct", c)).alias("extracted_text"),
        "text_extraction_method", F.lit(None).cast("int").alias("page_count"), "error_message")


def enrich(described: DataFrame, keys: Sequence[str] = ("Email_ID",), name: str = "stored_name") -> DataFrame:
    """One row per message: metadata structs in order, texts joined by a blank line, distinct types.

    A row is as large as the message's own attachments. ``attachment_texts`` keeps the texts apart, a row each, where
    they are too large for one row.
    """
    meta = F.struct(F.col("attachment_index").alias("index"), F.col(name).alias("filename"), "size", "mime_type", "content_type",
                    "extracted_text", "text_extraction_method", "page_count", "error_message")
    grouped = described.groupBy(*keys).agg(F.sort_array(F.collect_list(meta)).alias("Attachment_Metadata"))
    m = F.col("Attachment_Metadata")
    texts = F.filter(m["extracted_text"], lambda t: t.isNotNull() & (t != ""))
    return grouped.select(
        *keys, m, F.array_join(texts, "\n\n").alias("Attachment_Content"),
        F.sort_array(F.array_distinct(m["mime_type"])).alias("Attachment_Types"))


def attachment_texts(described: DataFrame, keys: Sequence[str] = ("Email_ID",)) -> DataFrame:
    """The texts as a table of their own, by message and attachment."""
    return described.where(F.coalesce("extracted_text", F.lit("")) != "").select(*keys, "attachment_index", "extracted_text")


def enrich_messages(records: DataFrame, enriched: DataFrame, key: str = "Email_ID") -> DataFrame:
    """Records with the enrichment columns; messages without attachments get empty ones."""
    joined = records.join(enriched, key, "left")
    return joined.withColumns({
        "Attachment_Metadata": F.coalesce("Attachment_Metadata", F.array().cast(enriched.schema["Attachment_Metadata"].dataType)),
        "Attachment_Content": F.coalesce("Attachment_Content", F.lit("")),
        "Attachment_Types": F.coalesce("Attachment_Types", F.array().cast("array<string>")),
    })


# --- joins -------------------------------------------------------------------------------------


def message_attachments(messages: DataFrame, att: DataFrame) -> DataFrame:
    """Every attachment with its message; both sides are matched on the message's place."""
    return messages.join(att, MESSAGE)


def stored_paths(att: DataFrame, email_id: str = "Email_ID") -> DataFrame:
    """``{Email_ID}/{stored_name}`` per stored attachment."""
    return att.withColumn("path", F.concat_ws("/", email_id, "stored_name"))


def with_saved_paths(records: DataFrame, stored: DataFrame, key: str = "Email_ID") -> DataFrame:
    """Attachment_Paths of each record from the stored attachments, in one row; the count follows if any."""
    paths = stored.groupBy(key).agg(
        F.sort_array(F.collect_list(F.struct("attachment_index", "path")))["path"].alias("_paths"),
        F.count(F.lit(1)).cast("int").alias("_saved"))
    joined = records.join(paths, key, "left")
    return joined.withColumns({
        "Attachment_Paths": F.coalesce("_paths", F.array().cast("array<string>")),
        "Attachment_Count": F.coalesce("_saved", "Attachment_Count"),
    }).drop("_paths", "_saved")


def resolve_paths(wanted: DataFrame, stored: DataFrame) -> DataFrame:
    """Each wanted path with the stored size, null where the file is missing."""
    return wanted.join(stored.select("path", "size"), "path", "left")


def missing_paths(wanted: DataFrame, stored: DataFrame) -> DataFrame:
    return wanted.join(stored, "path", "left_anti")
