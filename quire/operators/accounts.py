"""Accounts and their devices: sessions judged, devices met at sign-in, notifications acknowledged, samples chosen by risk, findings in texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.operators.ranked import at_places
from quire.plans.registry import query
from quire.sources.tables import table

NOW = 1_000_000  # the second at which sessions are judged


@query(f"""with s as (select o_orderkey as session, o_custkey as user_id, o_orderkey % 60 as device_id, {NOW} + (o_orderkey % 21 - 7) * 100 as expires from orders), u as (select c_custkey as id, c_name as username, case when c_acctbal < 0 then 'disabled' else 'active' end as status from customer), d as (select n_nationkey as id, n_name as name, case when n_regionkey = 1 then 'revoked' else 'active' end as status from nation)
select session, username, d.name as device, case when expires <= {NOW} then 'SESSION_EXPIRED' when u.status <> 'active' then 'ACCOUNT_DISABLED' when d.status <> 'active' then 'DEVICE_DISABLED' else 'ok' end as verdict from s join u on s.user_id = u.id join d on s.device_id = d.id""")
def session_verdicts(spark, sf_dir):
    """Sessions with their user and device, and the first reason that speaks against each; a session without either is none."""
    s = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("session"), F.col("o_custkey").alias("user_id"), (F.col("o_orderkey") % 60).alias("device_id"), (NOW + (F.col("o_orderkey") % 21 - 7) * 100).alias("expires"))
    u = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("u_id"), F.col("c_name").alias("username"), (F.col("c_acctbal") >= 0).alias("u_active"))
    d = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("d_id"), F.col("n_name").alias("device"), (F.col("n_regionkey") != 1).alias("d_active"))
    met = s.join(u, F.col("user_id") == F.col("u_id")).join(d, F.col("device_id") == F.col("d_id"))
    verdict = F.when(F.col("expires") <= NOW, "SESSION_EXPIRED").when(~F.col("u_active"), "ACCOUNT_DISABLED").when(~F.col("d_active"), "DEVICE_DISABLED").otherwise("ok")
    return met.select("session", "username", "device", verdict.alias("verdict"))


def signed_in(devices: DataFrame, logins: DataFrame) -> DataFrame:
    """devices (user_id, fingerprint, name, created, seen, logins) after logins (user_id, fingerprint, name, second): a known device takes the last name and second, an unknown one is new.

    Many logins of a device are one row before the two sides meet.
    """
    new = logins.groupBy(F.col("user_id").alias("u"), F.col("fingerprint").alias("f")).agg(F.min("second").alias("first"), F.max_by("name", F.struct("second", "name")).alias("last_name"), F.max("second").alias("last"), F.count("*").alias("n"))
    both = devices.join(new, (F.col("user_id") == F.col("u")) & (F.col("fingerprint") == F.col("f")), "full_outer")
    return both.select(
        F.coalesce("user_id", "u").alias("user_id"), F.coalesce("fingerprint", "f").alias("fingerprint"), F.coalesce("last_name", "name").alias("name"), F.coalesce("created", "first").alias("created"), F.greatest("seen", "last").alias("seen"),
        (F.coalesce("logins", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("logins"), F.col("user_id").isNull().alias("is_new"),
    )


@query("""with d as (select c_custkey as user_id, 'f' || (c_custkey % 7) as fingerprint, c_mktsegment as name, 100::bigint as created, 200::bigint as seen, 1::bigint as logins from customer where c_custkey % 3 > 0), l as (select o_custkey as user_id, 'f' || (o_orderkey % 7) as fingerprint, o_orderpriority as name, (o_orderkey % 1000)::bigint as second from orders),
n as (select user_id, fingerprint, min(second) as first, arg_max(name, (second, name)) as last_name, max(second) as last, count(*) as n from l group by 1, 2)
select coalesce(d.user_id, n.user_id) as user_id, coalesce(d.fingerprint, n.fingerprint) as fingerprint, coalesce(last_name, name) as name, coalesce(created, first) as created, greatest(seen, last) as seen, coalesce(logins, 0) + coalesce(n, 0) as logins, d.user_id is null as is_new from d full outer join n on d.user_id = n.user_id and d.fingerprint = n.fingerprint""")
def devices_after_logins(spark, sf_dir):
    """Devices by user and fingerprint after a log of sign-ins: met again or new."""
    d = table(spark, sf_dir, "customer").where("c_custkey % 3 > 0").select(F.col("c_custkey").alias("user_id"), F.concat(F.lit("f"), (F.col("c_custkey") % 7).cast("string")).alias("fingerprint"), F.col("c_mktsegment").alias("name"), F.lit(100).cast("bigint").alias("created"), F.lit(200).cast("bigint").alias("seen"), F.lit(1).cast("bigint").alias("logins"))
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user_id"), F.concat(F.lit("f"), (F.col("o_orderkey") % 7).cast("string")).alias("fingerprint"), F.col("o_orderpriority").alias("name"), (F.col("o_orderkey") % 1000).cast("bigint").alias("second"))
    return signed_in(d, o)


def acknowledged(notes: DataFrame, acks: DataFrame) -> DataFrame:
    """notes (id, user_id, at) with acknowledgements (id, user_id, second) applied: the first that a note's own user gives counts, a note that has one keeps it; 0 is none."""
    first = acks.groupBy(F.col("id").alias("a_id"), F.col("user_id").alias("a_user")).agg(F.min("second").alias("second"))
    met = notes.join(first, (F.col("id") == F.col("a_id")) & (F.col("user_id") == F.col("a_user")), "left")
    open_ = F.col("at") == 0
    return met.select("id", "user_id", F.when(open_, F.coalesce("second", F.lit(0))).otherwise(F.col("at")).alias("at"), (open_ & F.col("second").isNotNull()).alias("changed"))


@query("with n as (select o_orderkey as id, o_custkey as user_id, case when o_orderkey % 4 = 0 then o_orderkey % 50 + 1 else 0 end::bigint as at_ from orders), a as (select l_orderkey as id, case when l_linenumber % 3 = 0 then l_suppkey else o_custkey end as user_id, (100 + l_linenumber)::bigint as second from lineitem join orders on l_orderkey = o_orderkey where l_linenumber > 2) select id, user_id, case when at_ = 0 then coalesce((select min(second) from a where a.id = n.id and a.user_id = n.user_id), 0) else at_ end as \"at\", at_ = 0 and exists (select 1 from a where a.id = n.id and a.user_id = n.user_id) as changed from n")
def notifications_acknowledged(spark, sf_dir):
    """Notifications after their users' acknowledgements; others' count for nothing."""
    n = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"), F.when(F.col("o_orderkey") % 4 == 0, F.col("o_orderkey") % 50 + 1).otherwise(0).cast("bigint").alias("at"))
    a = table(spark, sf_dir, "lineitem").where("l_linenumber > 2").join(n.select(F.col("id").alias("o"), F.col("user_id").alias("owner")), F.col("l_orderkey") == F.col("o"))
    a = a.select(F.col("l_orderkey").alias("id"), F.when(F.col("l_linenumber") % 3 == 0, F.col("l_suppkey")).otherwise(F.col("owner")).alias("user_id"), (100 + F.col("l_linenumber")).cast("bigint").alias("second"))
    return acknowledged(n, a)


SAMPLE = 40


def sampled(records: DataFrame, size: int = SAMPLE) -> DataFrame:
    """(id, risk) of a sample of records: those at risk, the greatest first, then others spread evenly over the order of ids."""
    risky = records.where("risk > 0").orderBy(F.desc("risk"), "id").limit(size)
    taken = risky.count()  # at most size
    if taken >= size:
        return risky
    rest, need = records.where("risk <= 0"), size - taken
    n = rest.count()
    if n <= need:
        return risky.unionByName(rest)
    # The places of the sample among the others: only their ids' order is asked for, by counts of ranges.
    places = [n // 2] if need == 1 else sorted({round(k * (n - 1) / (need - 1)) for k in range(need)})
    return risky.unionByName(at_places(rest, "id", places))


_RISK = "select o_orderkey as id, (case when o_orderkey % 97 = 0 then (o_orderkey % 5) * 100 else 0 end + case when o_orderkey % 89 = 0 then 80 else 0 end + case when o_orderkey % 211 = 0 then 2 * (o_custkey % 4) else 0 end)::bigint as risk from orders where o_orderstatus <> 'P' and o_orderkey % 13 = 0"


@query(f"""with r as ({_RISK}), a as (select id, risk from r where risk > 0 order by risk desc, id limit {SAMPLE}), b as (select id, risk, row_number() over (order by id) - 1 as place, count(*) over () as n from r where risk <= 0), k as (select {SAMPLE} - (select count(*) from a) as need),
p as (select distinct case when need = 1 then (select any_value(n) from b) // 2 else round_even(i * ((select any_value(n) from b) - 1) / (need - 1)::double, 0)::bigint end as place from k, range({SAMPLE}) t(i) where i < need) select id, risk from a union all select id, risk from b where n <= (select need from k) or place in (select place from p)""")
def render_samples(spark, sf_dir):
    """A sample of records to be looked at: those at risk first, the others spread evenly."""
    o = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P' and o_orderkey % 13 = 0")
    k = F.col("o_orderkey")
    risk = F.when(k % 97 == 0, k % 5 * 100).otherwise(0) + F.when(k % 89 == 0, 80).otherwise(0) + F.when(k % 211 == 0, 2 * (F.col("o_custkey") % 4)).otherwise(0)
    return sampled(o.select(k.alias("id"), risk.cast("bigint").alias("risk")))


FINDINGS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "digest": r"\b[0-9a-f]{64}\b", "absolute_path": r"(?:[A-Za-z]:\\|/home/|/Users/)\S+", "file_name": r"\S+\.docx\b"}


@query(" union all ".join(f"select '{k}' as code, '/documents/' || doc_id as path from documents where regexp_matches(text, '{p}')" for k, p in FINDINGS.items()) + " union all " + " union all ".join(f"select '{k}', '/pages/' || page_id from pages where regexp_matches(html, '{p}')" for k, p in FINDINGS.items()))
def public_findings(spark, sf_dir):
    """What texts must not show, by code and path, without the values."""
    def of(name: str, key: str, text: str) -> DataFrame:
        found = F.array_compact(F.array(*[F.when(F.col(text).rlike(p), F.lit(k)) for k, p in FINDINGS.items()]))
        return table(spark, sf_dir, name).select(F.explode(found).alias("code"), F.concat(F.lit(f"/{name}/"), F.col(key).cast("string")).alias("path"))

    return of("documents", "doc_id", "text").unionByName(of("pages", "page_id", "html"))


@query("select c_custkey as user_id, c_name as name, (row_number() over (partition by c_nationkey order by c_mktsegment <> 'BUILDING', c_acctbal desc, lower(c_name), c_custkey))::integer as place from customer")
def preset_order(spark, sf_dir):
    """Presets of each owner in the order in which they are shown: the default kind first, then the most used, then by name and id."""
    order = W.partitionBy("c_nationkey").orderBy(F.col("c_mktsegment") != "BUILDING", F.desc("c_acctbal"), F.lower("c_name"), "c_custkey")
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"), F.row_number().over(order).alias("place"))
