"""Named queries for the address and host reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.functions.headers import received_hops
from postmill.operators import addresses as A
from postmill.operators import index
from postmill.plans import statements as S
from postmill.plans.queries_messages import records
from postmill.schema import ADDRESS_FIELDS, HOST_FIELDS
from postmill.session import shared_dir
from postmill.sinks import writers
from postmill.sources import sample

Q: dict[str, tuple] = {}


def query(sql: str | None):
    def add(fn):
        Q[fn.__name__] = (fn, sql)
        return fn
    return add


def traffic(spark: SparkSession, sf: str) -> DataFrame:
    return sample.traffic(spark, sf)


def traffic_hosts(spark: SparkSession, sf: str) -> DataFrame:
    return traffic(spark, sf).select(received_hops(F.col("Full_Headers")).alias("Received_Hops"))


def flattened(df: DataFrame) -> DataFrame:
    """List columns as text, for comparison."""
    return df.select(*[(F.array_join(c, "; ") if t.startswith("array") else F.col(c)).alias(c) for c, t in df.dtypes])


_T = S.TRAFFIC + "," + S.mentions("traffic")
_R = S.RECORDS + "," + S.mentions("records")


def _report(clean: bool = False) -> str:
    def lst(c: str) -> str:
        keep = f" FILTER (WHERE {c} <> '')" if clean else ""
        return f"coalesce(array_to_string(list_sort(list(DISTINCT {c}){keep}), '; '), '')"
    return (f'SELECT address AS "Address", count(*) AS "Count", {lst("role")} AS "Roles", {lst("domain")} AS "Domains", '
            f'{lst("name")} AS "Names" FROM mention_parts GROUP BY address')


@query(S.query(_T, _report()))
def address_report(spark, sf):
    return flattened(A.address_report(traffic(spark, sf)))


@query(S.query(_R, _report()))
def address_report_mailbox(spark, sf):
    return flattened(A.address_report(records(spark, sf)))


@query(S.query(_R, _report(clean=True)))
def address_report_compact(spark, sf):
    return flattened(A.address_report(records(spark, sf), compact=True))


_HOSTS = 'SELECT lower(trim("Received_Hops")) AS "Host", count(*) AS "Count" FROM {t} GROUP BY 1'


@query(S.query(S.TRAFFIC, _HOSTS.format(t="traffic")))
def host_report(spark, sf):
    return A.host_report(traffic_hosts(spark, sf))


@query(S.query(S.TRAFFIC, _HOSTS.format(t="traffic") + ' ORDER BY "Count" DESC, "Host" LIMIT 10'))
def top_hosts(spark, sf):
    return A.host_report(traffic_hosts(spark, sf), top=10)


@query(S.query(_T, 'SELECT DISTINCT address AS "Address" FROM mentions ORDER BY 1'))
def addresses_sorted(spark, sf):
    return A.address_report(traffic(spark, sf)).select("Address")


@query(S.query(_R, """SELECT address AS "Address", array_to_string(list_sort(list(DISTINCT role)), ',') AS "Roles" FROM mentions GROUP BY address"""))
def sorted_arrays(spark, sf):
    return A.address_report(records(spark, sf), ordered=False).select("Address", F.array_join("Roles", ",").alias("Roles"))


@query(S.query(_T, "SELECT role, count(*) AS n, count(DISTINCT address) AS addresses FROM mentions GROUP BY role"))
def union_roles(spark, sf):
    exploded = A.explode_addresses(traffic(spark, sf))
    # Counted per address first, so the distinct count moves one row per address and role.
    per = exploded.groupBy("role_bit", "address").agg(F.count(F.lit(1)).alias("n"))
    role = F.element_at(F.array(*[F.lit(r) for _, r, _ in A.ROLES]), F.col("role_bit") + 1)
    return per.groupBy(role.alias("role")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("addresses"))


@query(S.query(S.RECORDS, """SELECT scan_pos, array_to_string(list_transform(list_filter(list_transform(r, lambda x, i: {'x': x, 'i': i}),
    lambda s: list_position(r, s.x) = s.i), lambda s: s.x), '|') AS "Recipients"
  FROM (SELECT scan_pos, list_filter(list_transform(string_split(replace("To" || ';' || "CC" || ';' || "BCC", ',', ';'), ';'),
    lambda x: trim(x)), lambda x: x <> '') AS r FROM records)"""))
def recipient_rollup(spark, sf):
    return A.recipient_rollup(records(spark, sf)).select("scan_pos", F.array_join("Recipients", "|").alias("Recipients"))


@query(S.query(_R, """SELECT (SELECT count(*) FROM records) AS email_count, 0::BIGINT AS attachments_saved,
  (SELECT count(DISTINCT address) FROM mentions) AS address_count,
  (SELECT count(DISTINCT lower(trim("Received_Hops"))) FROM records) AS host_count"""))
def run_summary(spark, sf):
    r = records(spark, sf)
    return index.run_summary(r, A.address_report(r, ordered=False), A.host_report(r))


@query(S.query(_R, _report()))
def sink_address_csv(spark, sf):
    path = writers.write_address_csv(A.address_report(records(spark, sf)), shared_dir(spark, "address-csv"))
    back = writers.read_csv(spark, path, ADDRESS_FIELDS)
    return back.withColumn("Count", F.col("Count").cast("bigint"))


@query(S.query(S.TRAFFIC, _HOSTS.format(t="traffic")))
def sink_host_csv(spark, sf):
    path = writers.write_host_csv(A.host_report(traffic_hosts(spark, sf)), shared_dir(spark, "host-csv"))
    return writers.read_csv(spark, path, HOST_FIELDS).withColumn("Count", F.col("Count").cast("bigint"))


@query(S.query(_R, f"""SELECT 'address' AS part, "Address" AS label, "Count" AS n, "Roles" AS detail FROM ({_report()})
  UNION ALL SELECT 'host', "Host", "Count", '' FROM ({_HOSTS.format(t='records')})"""))
def sink_address_json(spark, sf):
    r = records(spark, sf)
    report, hosts = A.address_report(r), A.host_report(r)
    paths = writers.write_address_json(report, hosts, shared_dir(spark, "address-json"))
    a = spark.read.schema(report.schema).json(paths["addresses"])
    h = spark.read.schema(hosts.schema).json(paths["hosts"])
    return (a.select(F.lit("address").alias("part"), F.col("Address").alias("label"), F.col("Count").alias("n"),
                     F.array_join("Roles", "; ").alias("detail"))
            .unionByName(h.select(F.lit("host").alias("part"), F.col("Host").alias("label"), F.col("Count").alias("n"),
                                  F.lit("").alias("detail"))))
