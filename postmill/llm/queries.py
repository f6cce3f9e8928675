"""The registered queries: name -> (function of session and table folder, SQL of the same result or None)."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from postmill.llm import (
    bpe, cnn, decontaminate, licenses, merkle, records, rules, simhash, tokencounts, toxicity, urlgraph, variants, warc,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts encoded and decoded again, as digests."""
    vocabulary = (public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return bpe.digests(bpe.round_trip(_table(spark, sf_dir, "documents"), *vocabulary))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found in all documents by template windows."""
    return decontaminate.checked(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text scored by the model that the rows not held out teach."""
    return toxicity.scored(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_url_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url judged by the rules or by its host's place in the link graph."""
    return urlgraph.judged(_table(spark, sf_dir, "pages"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents before and after redaction."""
    return tokencounts.counted(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"),
                               public_tokenizers.PATTERN)


def op7_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text scored by the network that the rows not held out teach."""
    return cnn.scored(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC records and read back through the index."""
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every text and the verdict of the compression bands."""
    return rules.judged(_table(spark, sf_dir, "documents"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and notices in every text."""
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merkle proofs of all documents, a third of them tampered with."""
    return merkle.audited(_table(spark, sf_dir, "documents"))


def op12_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all texts written as binary records and read back."""
    return records.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op13_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants among the words of all documents."""
    return variants.variants(_table(spark, sf_dir, "documents"))


# Base32 of the SHA-1: its 40 hex digits as 160 bits, taken by five.
OP8_SQL = """
WITH hashed AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages
), bits AS (
  SELECT page_id, html, h, array_to_string(list_transform(range(1, 41), lambda i:
           ['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111']
           [instr('0123456789abcdef', substr(h, i, 1))]), '') AS b
  FROM hashed
), firsts AS (SELECT html, min(page_id) AS first_id FROM hashed GROUP BY html)
SELECT page_id, CAST(strlen(bits.html) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1
         + 16 * CAST(substr(b, 5 * i + 1, 1) AS INT) + 8 * CAST(substr(b, 5 * i + 2, 1) AS INT)
         + 4 * CAST(substr(b, 5 * i + 3, 1) AS INT) + 2 * CAST(substr(b, 5 * i + 4, 1) AS INT)
         + CAST(substr(b, 5 * i + 5, 1) AS INT), 1)), '') AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM bits JOIN firsts ON bits.html = firsts.html
"""


def _crc32(text: str) -> str:
    """CRC-32 of a text's UTF-8 in SQL, four bits at a time: the low ones of a byte, then the high ones."""
    # The remainders of the sixteen four-bit values for the reflected polynomial EDB88320.
    table = ("[0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948, 3988292384, 4027552580, "
             "3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108]")
    digit = f"hex(encode({text}))[k + 2 - 2 * (k % 2)]"
    return f"""xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, 2 * strlen({text})),
        lambda k: (instr('0123456789ABCDEF', {digit}) - 1)::BIGINT)),
        lambda c, d: xor(c >> 4, ({table})[1 + (xor(c, d) & 15)]::BIGINT)))"""


def _field(value: str) -> str:
    return f"coalesce(strlen(CAST({value} AS VARCHAR)) || ':' || CAST({value} AS VARCHAR), '-')"


def _levels(name: str, start: str) -> str:
    """Levels of the trees whose leaves ``start`` selects: (l, tree, idx, n, h)."""
    return f"""{name} AS ({start} UNION ALL
  SELECT l + 1, tree, idx // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY idx)) FROM {name} WHERE n > 1
  GROUP BY l, tree, idx // 8, n)"""


def _steps(levels: str, leaves: str, first: int) -> str:
    """(tree, leaf, l, lft, rgt): siblings of a leaf's ancestors at each level, numbered from ``first``."""
    up = "x.idx // CAST(pow(8, y.l) AS BIGINT)"
    return f"""SELECT x.tree, x.idx AS leaf, y.l + {first} AS l,
    coalesce(string_agg(y.h, '' ORDER BY y.idx) FILTER (y.idx < {up}), '') AS lft,
    coalesce(string_agg(y.h, '' ORDER BY y.idx) FILTER (y.idx > {up}), '') AS rgt
  FROM {leaves} x JOIN {levels} y ON x.tree = y.tree AND y.n > 1 AND y.idx // 8 = x.idx // CAST(pow(8, y.l + 1) AS BIGINT)
  GROUP BY x.tree, x.idx, y.l"""


_UPPER, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_HEAD = " || ".join(map(_field, ("doc_id", "source", "lang", "n_chars")))

OP11_SQL = f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, coalesce('v' || lang, 'n') AS tree, sha256({_HEAD} || {_field("text")}) AS h,
         CASE WHEN {_crc32("CAST(doc_id AS VARCHAR)")} % 3 = 0
              THEN sha256({_HEAD} || {_field(f"translate(text, '{_UPPER}', '{_SMALL}')")})
              ELSE sha256({_HEAD} || {_field("text")}) END AS other,
         row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS idx, count(*) OVER (PARTITION BY lang) AS n
  FROM documents
), {_levels("langs", "SELECT 0 AS l, tree, idx, n, h FROM leaves")}, subroots AS (
  SELECT tree, h, row_number() OVER (ORDER BY tree) - 1 AS idx, count(*) OVER () AS n FROM langs WHERE n = 1
), {_levels("tops", "SELECT 0 AS l, '' AS tree, idx, n, h FROM subroots")}, own AS (
  {_steps("langs", "leaves", 0)}
), above AS (
  {_steps("tops", "(SELECT '' AS tree, idx FROM subroots)", 100)}
), steps AS (
  SELECT tree, leaf, l, lft, rgt FROM own
  UNION ALL SELECT leaves.tree, leaves.idx, above.l, lft, rgt
  FROM leaves JOIN subroots ON leaves.tree = subroots.tree JOIN above ON above.leaf = subroots.idx
), proofs AS (
  SELECT tree, leaf, string_agg(lft || rgt, '' ORDER BY l) AS siblings, list(lft || '|' || rgt ORDER BY l) AS steps
  FROM steps GROUP BY tree, leaf
), folded AS (
  SELECT doc_id, leaves.h AS leaf, subroots.h AS subroot, (SELECT h FROM tops WHERE n = 1) AS root,
         sha256(coalesce(siblings, '')) AS proof_sha256,
         list_reduce(list_prepend(other, coalesce(steps, [])), lambda h, s: sha256(split_part(s, '|', 1) || h || split_part(s, '|', 2))) AS folded_root
  FROM leaves JOIN subroots ON leaves.tree = subroots.tree
  LEFT JOIN proofs ON proofs.tree = leaves.tree AND proofs.leaf = leaves.idx
)
SELECT *, folded_root = root AS verified FROM folded
"""

OP13_SQL = f"""
WITH RECURSIVE found AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), '{_UPPER}', '{_SMALL}') AS run FROM documents
), hashed AS (
  SELECT run, count(*) AS n, {_crc32("doc_id || ':' || run")} AS h FROM found WHERE length(run) >= 7 GROUP BY doc_id, run
), read AS (
  SELECT n, CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word
  FROM hashed
), words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM read WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2
), cut AS (
  SELECT word, n, substr(word, 1, i) AS a, substr(word, i + 2) AS b
  FROM (SELECT word, n, unnest(range(0, length(word))) AS i FROM words)
), pairs AS (
  SELECT x.word AS word, y.word AS other FROM cut x JOIN cut y ON x.a = y.a AND x.b = y.b AND x.word <> y.word
  UNION SELECT cut.word, words.word FROM cut JOIN words ON cut.a || cut.b = words.word
  UNION SELECT words.word, cut.word FROM cut JOIN words ON cut.a || cut.b = words.word
), ranked AS (
  SELECT pairs.word, other, o.n AS other_n, count(*) OVER (PARTITION BY pairs.word) AS n_near,
         row_number() OVER (PARTITION BY pairs.word ORDER BY o.n DESC, other) AS place
  FROM pairs JOIN words o ON o.word = other
), formed AS (
  SELECT words.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 10 * n THEN other END AS form,
         CASE WHEN other_n >= 10 * n THEN other_n END AS form_n
  FROM words LEFT JOIN ranked ON ranked.word = words.word AND place = 1
), ways AS (
  SELECT word, word AS root FROM formed
  UNION ALL SELECT ways.word, formed.form FROM ways JOIN formed ON formed.word = ways.root WHERE formed.form IS NOT NULL
)
SELECT formed.word, formed.form, ways.root, formed.n, formed.n_near, formed.form_n
FROM formed JOIN ways ON ways.word = formed.word JOIN formed ends ON ends.word = ways.root AND ends.form IS NULL
"""

Q: dict[str, tuple] = {
    "op1_simhash": (op1_simhash, None),
    "op2_decontamination": (op2_decontamination, None),
    "op3_toxicity": (op3_toxicity, None),
    "op4_byte_bpe": (op4_byte_bpe, None),
    "op5_url_graph": (op5_url_graph, None),
    "op6_token_counts": (op6_token_counts, None),
    "op7_quality_cnn": (op7_quality_cnn, None),
    "op8_warc": (op8_warc, OP8_SQL),
    "op9_quality_rules": (op9_quality_rules, None),
    "op10_licenses": (op10_licenses, None),
    "op11_merkle": (op11_merkle, OP11_SQL),
    "op12_records": (op12_records, None),
    "op13_variants": (op13_variants, OP13_SQL),
}
