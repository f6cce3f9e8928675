"""Merkle manifest of a dataset: sibling-shift self-joins build the trees, proofs come back down them."""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.llm.places import placed
from postmill.session import written

ARITY = 8
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def digest(*parts: Column) -> Column:
    """Lower-case hex SHA-256 of the parts one after another."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, ``:`` and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(**values: Column) -> Column:
    return digest(*(field(values[name]) for name in FIELDS))


def lowered(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


@dataclass(frozen=True)
class Forest:
    """The trees over some leaves, level by level.

    ``leaves`` has tree, idx, n and the leaves' own columns; ``levels[k]`` has a row (tree, idx, n, h, kids) per node of
    level k + 1, n being the nodes of that level and kids the digests below it; ``roots`` has (tree, height, h).
    """

    leaves: DataFrame
    levels: list[DataFrame]
    roots: DataFrame
    arity: int


def _parents(nodes: DataFrame, arity: int) -> DataFrame:
    """One level up: (tree, idx, n, h, kids) from (tree, idx, n, h).

    A node in slot zero computes the indices of its siblings (XOR for two, offsets otherwise) and meets them in an equality
    join on the index; what it finds, in the order of the slots, is the parent.
    """
    shift = (lambda i, k: i.bitwiseXOR(F.lit(1)) if k else i) if arity == 2 else (lambda i, k: i + k)
    first = nodes.filter(F.col("idx") % arity == 0)
    asked = first.select("tree", "n", F.col("idx").alias("base"), F.explode(F.array(
        *(shift(F.col("idx"), k) for k in range(arity)))).alias("want")).filter("want < n")
    found = asked.join(nodes.select("tree", F.col("idx").alias("want"), "h"), ["tree", "want"])
    # At most as many as a node has slots.
    kids = F.transform(F.array_sort(F.collect_list(F.struct("want", "h"))), lambda s: s["h"])
    return found.groupBy("tree", "base").agg(F.first("n").alias("n"), kids.alias("kids")).select(
        "tree", (F.col("base") / arity).cast("long").alias("idx"), F.ceil(F.col("n") / arity).alias("n"),
        F.sha2(F.array_join("kids", ""), 256).alias("h"), "kids")


def forest(leaves: DataFrame, order: list[str], arity: int = ARITY) -> Forest:
    """Trees over ``leaves`` (tree, h and more), whose leaves ascend by ``order`` and then by digest within each tree."""
    if arity < 2:
        raise ValueError("a node needs two slots at least")
    rows = written(placed(leaves, "tree", [*order, "h"]), "leaves")
    most = rows.agg(F.max("n")).first()[0] or 0
    nodes, levels = rows.select("tree", "idx", "n", "h"), []
    while most > 1:
        levels.append(written(_parents(nodes.filter("n > 1"), arity), "level"))
        nodes, most = levels[-1].select("tree", "idx", "n", "h"), -(-most // arity)
    roots = rows.filter("n = 1").select("tree", F.lit(0).alias("height"), "h")
    for height, level in enumerate(levels, 1):
        roots = roots.unionByName(level.filter("n = 1").select("tree", F.lit(height).alias("height"), "h"))
    return Forest(rows, levels, written(roots, "roots"), arity)


STEPS = "array<struct<left:string,right:string>>"


def _step(kids: Column, slot: Column) -> Column:
    """The digests left and right of a slot, each side as one string."""
    side = lambda start, length: F.array_join(F.slice(kids, start, length), "")
    return F.array(F.struct(side(F.lit(1), slot).alias("left"),
                            side(slot + 2, F.greatest(F.size(kids) - slot - 1, F.lit(0))).alias("right")))


def proofs(trees: Forest, above: DataFrame) -> DataFrame:
    """The leaves with ``steps``, the siblings of each level from the leaf up, and the columns of ``above``.

    ``above`` has tree, height, ``up`` (the steps above the tree's root) and further columns to be handed down. A
    node's steps go to its children with the list of them, so that a level is joined once, by (tree, idx).
    """
    more = [c for c in above.columns if c not in ("tree", "height", "up")]
    arity, height = trees.arity, len(trees.levels)
    down = above.filter(F.col("height") == height).select("tree", F.lit(0).cast("long").alias("idx"), "up", *more) if height else None
    for level in range(height, 0, -1):
        met = trees.levels[level - 1].select("tree", "idx", "kids").join(down, ["tree", "idx"])
        if level > 1:
            kids = met.select("tree", "idx", "kids", "up", *more, F.posexplode("kids").alias("slot", "_h"))
            down = kids.select("tree", (F.col("idx") * arity + F.col("slot")).alias("idx"),
                               F.concat(_step(F.col("kids"), F.col("slot")), "up").alias("up"), *more)
            roots = above.filter(F.col("height") == level - 1)
            down = written(down.unionByName(roots.select("tree", F.lit(0).cast("long").alias("idx"), "up", *more)), "down")
    single = above.filter(F.col("height") == 0).select(
        "tree", F.lit(0).cast("long").alias("idx"), F.lit(None).cast("array<string>").alias("kids"), "up", *more)
    parents = met.select("tree", "idx", "kids", "up", *more).unionByName(single) if height else single
    parents = parents.withColumnRenamed("idx", "parent")
    joined = trees.leaves.withColumn("parent", (F.col("idx") / arity).cast("long")).join(parents, ["tree", "parent"])
    own = F.when(F.col("kids").isNull(), F.array().cast(STEPS)).otherwise(
        _step(F.col("kids"), (F.col("idx") % arity).cast("int")))
    return joined.withColumn("steps", F.concat(own, "up")).drop("parent", "kids", "up")


def folded(leaf: Column, steps: Column) -> Column:
    """The root that a leaf leads to."""
    return F.aggregate(steps, leaf, lambda h, s: digest(s["left"], h, s["right"]))


def proof_digest(steps: Column) -> Column:
    return F.sha2(F.array_join(F.transform(steps, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def leaves_of(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """(tree, doc_id, h, other): a row per document; ``other`` is the leaf with the text ``tampered``, null if that is the same.

    tree is the language as a key that sorts by UTF-8 bytes, null before all.
    """
    row = docs.select(*(docs[name] for name in FIELDS), (docs["text"] if tampered is None else tampered).alias("_tampered"))
    values = {name: F.col(name) for name in FIELDS}
    other = F.when(F.col("_tampered") != F.col("text"), leaf_of(**{**values, "text": F.col("_tampered")}))
    tree = F.coalesce(F.concat(F.lit("v"), F.col("lang").cast("string")), F.lit("n"))
    return row.select(tree.alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), leaf_of(**values).alias("h"), other.alias("other"))


def manifest(docs: DataFrame, tampered: Column | None = None, arity: int = ARITY) -> tuple[DataFrame, str | None]:
    """(leaves with their proofs, root) of ``docs``: a tree per language, and a tree over their roots.

    The leaves have (tree, idx, n, doc_id, h, other, subroot, steps). A table without rows has the root None.
    """
    langs = forest(written(leaves_of(docs, tampered), "hashed"), ["doc_id"], arity)
    tops = forest(langs.roots.select(F.lit("").alias("tree"), F.col("tree").alias("lang_tree"), "height", "h"), ["lang_tree"], arity)
    found = tops.roots.first()
    ends = tops.roots.select("tree", "height", F.array().cast(STEPS).alias("up"))
    above = proofs(Forest(tops.leaves.withColumnRenamed("height", "lang_height"), tops.levels, tops.roots, arity), ends)
    above = written(above.select(F.col("lang_tree").alias("tree"), F.col("lang_height").alias("height"),
                                 F.col("steps").alias("up"), F.col("h").alias("subroot")), "above")
    return proofs(langs, above), found and found["h"]


def audited(docs: DataFrame, arity: int = ARITY) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) per row of ``docs``.

    Where 3 divides the CRC-32 of the doc_id's digits, the text is tampered with (A-Z in small letters) before its leaf is
    folded up the untampered siblings; verified tells whether the result is the root. Leaves of equal doc_id
    are ordered by digest, those without one come first and are never tampered with; equal rows are leaves of
    their own. Null fields count as ``-``, which no value gives. An empty table gives an empty result.
    """
    chosen = F.crc32(docs["doc_id"].cast("string")) % 3 == 0
    rows, root = manifest(docs, F.when(chosen, lowered(docs["text"])).otherwise(docs["text"]), arity)
    out = rows.select("doc_id", F.col("h").alias("leaf"), "subroot", F.lit(root).cast("string").alias("root"),
                      proof_digest(F.col("steps")).alias("proof_sha256"),
                      folded(F.coalesce("other", "h"), F.col("steps")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
