"""Folder paths, counts and the folder tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def folder_path(segments: Column) -> Column:
    """``/Root/A/B`` from names root first; an empty root is ``Root``, other blanks ``(Unnamed)``."""
    named = F.transform(segments, lambda s, i: F.coalesce(
        F.nullif(s, F.lit("")), F.when(i == 0, "Root").otherwise("(Unnamed)")))
    path = F.when(F.coalesce(F.size(segments), F.lit(0)) <= 0, F.array(F.lit("Root"))).otherwise(named)
    return F.concat(F.lit("/"), F.array_join(path, "/"))


def path_segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda s: s != "")


def normal_path(path: Column) -> Column:
    """Path with empty segments gone and a leading ``Root`` ensured; null unless absolute."""
    parts = path_segments(path)
    rooted = F.when(F.try_element_at(parts, F.lit(1)) == "Root", parts).otherwise(
        F.concat(F.array(F.lit("Root")), parts))
    return F.when(F.startswith(path, F.lit("/")) & (F.size(parts) > 0),
                  F.concat(F.lit("/"), F.array_join(rooted, "/")))


def resolve_folder(folders: DataFrame, path: str) -> DataFrame:
    """The folder at an absolute path; no row if there is none, the first of equal siblings."""
    if not path or not path.startswith("/"):
        raise ValueError("folder must be an absolute path such as /Root/Inbox")
    if not path.strip("/"):
        raise ValueError("invalid folder path")
    found = folders.where(normal_path(F.col("folder_path")) == normal_path(F.lit(path)))
    return found.orderBy("folder_path").limit(1)


def folders_of(messages: DataFrame) -> DataFrame:
    """Every folder that holds messages, and all its ancestors."""
    used = messages.groupBy("folder_path").agg(F.count(F.lit(1)).alias("_n")).select("folder_path")
    parts = path_segments(F.col("folder_path"))
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.concat(
        F.lit("/"), F.array_join(F.slice(parts, F.lit(1), n), "/")))
    paths = used.select(F.explode(prefixes).alias("folder_path")).distinct()
    return describe(paths)


def describe(paths: DataFrame) -> DataFrame:
    p = F.col("folder_path")
    parent = F.when(F.size(path_segments(p)) > 1, F.regexp_replace(p, "/[^/]*$", "")).otherwise("")
    return paths.select(p, F.substring_index(p, "/", -1).alias("name"), parent.alias("parent_path"))


def folder_counts(folders: DataFrame, messages: DataFrame) -> DataFrame:
    """Message and unread counts of every folder, empty ones included."""
    counts = messages.groupBy("folder_path").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~F.col("is_read")).alias("unread"))
    return folders.join(counts, "folder_path", "left").select(
        "folder_path", "name",
        F.coalesce("n", F.lit(0)).alias("total_count"), F.coalesce("unread", F.lit(0)).alias("unread_count"))


def non_empty(counts: DataFrame) -> DataFrame:
    return counts.where("total_count > 0")


def tree_counts(counts: DataFrame) -> DataFrame:
    """Messages in the tree, and folders below the root."""
    return counts.agg(
        F.coalesce(F.sum("total_count"), F.lit(0)).alias("messages"),
        F.greatest(F.count(F.lit(1)) - 1, F.lit(0)).alias("folders"))


def total_email_count(counts: DataFrame) -> DataFrame:
    return counts.agg(F.coalesce(F.sum("total_count"), F.lit(0)).alias("total"))


def count_messages(messages: DataFrame) -> DataFrame:
    return messages.agg(F.count(F.lit(1)).alias("messages"))
