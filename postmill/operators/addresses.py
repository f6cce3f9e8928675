"""Address and transport-host reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.functions import address as A
from postmill.functions.text import strip

# --- fixed values: source field, role name, whether the field lists several recipients -----------
ROLES = [
    ("Sender_Email", "sender", False),
    ("Reply_To", "reply-to", False),
    ("Return_Path", "return-path", False),
    ("To", "to", True),
    ("CC", "cc", True),
    ("BCC", "bcc", True),
]
# ----------------------------------------------------------------------------------------------

# Between entries of an array while the six fields share one text column.
SEPARATOR = "\x01"


def explode_addresses(df: DataFrame) -> DataFrame:
    """One row per address mention: ``address`` and ``role_bit`` (position of the role in ROLES).

    One pass over the message: the six fields are stacked, empty ones dropped, and recipient
    lists split. An array column is taken as an already split list: its entries may hold commas.
    """
    arrays = [f for f, t in df.dtypes if t.startswith("array")]
    listed = [bit for bit, (field, _, many) in enumerate(ROLES) if many and field not in arrays]
    ready = [bit for bit, (field, _, _) in enumerate(ROLES) if field in arrays]
    cells = []
    for bit, (field, _, _) in enumerate(ROLES):
        cells += [F.lit(bit), F.array_join(F.col(field), SEPARATOR) if bit in ready else F.col(field)]
    stacked = df.select(F.stack(F.lit(len(ROLES)), *cells).alias("role_bit", "cell"))
    stacked = stacked.where(F.col("cell").isNotNull() & (F.col("cell") != ""))
    parts = F.when(F.col("role_bit").isin(listed), F.split("cell", "[;,]"))
    if ready:
        parts = parts.when(F.col("role_bit").isin(ready), F.split("cell", SEPARATOR))
    parts = parts.otherwise(F.array("cell"))
    mentions = stacked.select("role_bit", F.explode(parts).alias("part"))
    return (mentions.select("role_bit", A.normal_address(F.col("part")).alias("address"))
            .where(~F.col("address").isin("", "none")))


def role_names(bits: Column) -> Column:
    """Role names held in a bit set, in alphabetical order."""
    named = sorted((role, bit) for bit, (_, role, _) in enumerate(ROLES))
    flags = F.array(*[F.when(bits.bitwiseAND(1 << bit) != 0, role) for role, bit in named])
    return F.array_compact(flags)


def count_mentions(mentions: DataFrame) -> DataFrame:
    """Per address: number of mentions and the set of its roles as bits.

    Both are fixed-width, so the aggregate runs in hash maps with map-side combine and an
    address found in a third of all messages reaches the shuffle as one row per task.
    """
    return mentions.groupBy("address").agg(
        F.count(F.lit(1)).alias("n"), F.bit_or(F.expr("shiftleft(1, role_bit)")).alias("bits"))


def address_report(df: DataFrame, compact: bool = False, ordered: bool = True) -> DataFrame:
    """Address, Count, Roles, Domains, Names; every list sorted.

    Domain and name depend on the address alone, so each list has one entry. ``compact`` leaves
    empty domains and names out.
    """
    counted = count_mentions(explode_addresses(df))
    a = F.col("address")

    def one(c: Column) -> Column:
        return F.when(c == "", F.array().cast("array<string>")).otherwise(F.array(c)) if compact else F.array(c)
    report = counted.select(
        a.alias("Address"), F.col("n").alias("Count"), role_names(F.col("bits")).alias("Roles"),
        one(A.address_domain(a)).alias("Domains"), one(A.address_name(a)).alias("Names"))
    return report.orderBy("Address") if ordered else report


def explode_hosts(df: DataFrame) -> DataFrame:
    """One row per host value: ``hop`` as given and ``Host``; empty hops are still among them."""
    is_array = dict(df.dtypes)["Received_Hops"].startswith("array")
    hops = df.select((F.explode("Received_Hops") if is_array else F.col("Received_Hops")).alias("hop"))
    return hops.select("hop", strip(F.lower("hop")).alias("Host"))


def host_report(df: DataFrame, top: int | None = None) -> DataFrame:
    """Host and Count, most frequent first, ties by host; ``top`` keeps that many.

    Empty hops are left out by the count: a filter ahead of it would be pushed down and have the
    header parsed a second time.
    """
    counted = explode_hosts(df).groupBy("Host").agg(F.count_if(F.col("hop") != "").alias("Count")).where("Count > 0")
    ordered = counted.orderBy(F.desc("Count"), "Host")
    return ordered.limit(top) if top else ordered


def recipient_rollup(df: DataFrame) -> DataFrame:
    """Distinct recipients over To, CC and BCC per message, in order of first mention."""
    lists = [A.split_recipients(F.col(c)) for c in ("To", "CC", "BCC")]
    return df.withColumn("Recipients", F.array_distinct(F.concat(*lists)))
