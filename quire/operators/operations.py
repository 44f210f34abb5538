"""Operational analytics over tasks, users, devices and requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.plans.registry import query
from quire.sources.tables import DAILY_ERRORS, ERRORS, TASKS_SQL, table, tasks

ERR = ", ".join(f"'{e}'" for e in ERRORS)
ERR3 = ", ".join(f"'{e}'" for e in DAILY_ERRORS)
T = f"with t as ({TASKS_SQL})"


def _is(status: str):
    return F.col("status") == status


def _count(condition) -> F.Column:
    return F.count_if(condition)


@query(f"{T} select count(*) as total, count_if(status = 'done')::bigint as done, count_if(status in ({ERR}))::bigint as error, count(distinct ip) as unique_ips, coalesce(sum(duration), 0)::bigint as total_bytes, coalesce(avg(case when status = 'done' then duration end), 0) as avg_ms from t")
def task_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals, distinct clients and the mean duration of finished tasks."""
    done = F.avg(F.when(_is("done"), F.col("duration")))
    return tasks(spark, sf_dir).agg(F.count("*").alias("total"), _count(_is("done")).alias("done"), _count(F.col("status").isin(*ERRORS)).alias("error"), F.count_distinct("ip").alias("unique_ips"), F.coalesce(F.sum("duration"), F.lit(0)).alias("total_bytes"), F.coalesce(done, F.lit(0.0)).alias("avg_ms"))


@query(f"{T} select cast(created_at as date) as day, count(*) as total, count_if(status = 'done')::bigint as done, count_if(status in ({ERR}))::bigint as error from t group by 1")
def task_daily_trend(spark, sf_dir):
    """Tasks a day, with all error states counted."""
    return tasks(spark, sf_dir).groupBy(F.to_date("created_at").alias("day")).agg(F.count("*").alias("total"), _count(_is("done")).alias("done"), _count(F.col("status").isin(*ERRORS)).alias("error"))


@query(f"{T} select cast(created_at as date) as day, count(*) as total, count_if(status = 'done')::bigint as done, count_if(status in ({ERR3}))::bigint as error, sum(duration)::bigint as total_bytes, count(distinct ip) as unique_ips from t where status = 'done' or status in ({ERR}) group by 1")
def task_daily_rollup_three_errors(spark, sf_dir):
    """The daily rollup over log events: it counts three of the error states only, and every call."""
    ended = tasks(spark, sf_dir).where(_is("done") | F.col("status").isin(*ERRORS))
    return ended.groupBy(F.to_date("created_at").alias("day")).agg(F.count("*").alias("total"), _count(_is("done")).alias("done"), _count(F.col("status").isin(*DAILY_ERRORS)).alias("error"), F.sum("duration").alias("total_bytes"), F.count_distinct("ip").alias("unique_ips"))


@query(f"{T} select ip, count(*) as c, count_if(status = 'done')::bigint as done, count_if(status in ({ERR}))::bigint as error, max(created_at) as last_at, arg_max(event_type, seq) as last_file, max(seq) as last_seq from t group by ip")
def task_top_keys_latest(spark, sf_dir):
    """Per client: counts and its latest task, one aggregation instead of a lookup per row."""
    return tasks(spark, sf_dir).groupBy("ip").agg(F.count("*").alias("c"), _count(_is("done")).alias("done"), _count(F.col("status").isin(*ERRORS)).alias("error"), F.max("created_at").alias("last_at"), F.max_by("event_type", "seq").alias("last_file"), F.max("seq").alias("last_seq"))


@query(f"{T} select ip, event_type, arg_max(status, seq) as status, arg_max(duration, seq) as duration, arg_min(created_at, seq) as created_at, arg_max(created_at, seq) as done_at from t group by 1, 2")
def task_latest_state(spark, sf_dir):
    """Upsert of a log: the last value of every column wins, but the first created_at stays."""
    return tasks(spark, sf_dir).groupBy("ip", "event_type").agg(F.max_by("status", "seq").alias("status"), F.max_by("duration", "seq").alias("duration"), F.min_by("created_at", "seq").alias("created_at"), F.max_by("created_at", "seq").alias("done_at"))


def page_bounds(total: int, page: int, size: int) -> tuple[int, int, int]:
    """(page, size, offset): size is clamped to 1..100 and page to the last one."""
    size = min(100, max(1, size))
    page = min(max(1, page), max(1, -(-total // size)))
    return page, size, (page - 1) * size


@query("select p_partkey, p_name, p_brand from part where p_name ilike '%RED%' or p_brand ilike '%#1%' order by p_partkey desc limit 50 offset 50")
def task_search_page(spark, sf_dir):
    """Search regardless of ASCII case, then the second page by descending id."""
    found = table(spark, sf_dir, "part").where(F.col("p_name").ilike("%RED%") | F.col("p_brand").ilike("%#1%"))
    return found.select("p_partkey", "p_name", "p_brand").orderBy(F.desc("p_partkey")).offset(50).limit(50)


@query(f"{T} select seq, ip, status from t order by seq desc limit 20 offset (select greatest(0, (least(99999, (count(*) + 19) // 20) - 1) * 20) from t)")
def task_last_page(spark, sf_dir):
    """A page beyond the end is clamped to the last one after the count."""
    t = tasks(spark, sf_dir)
    _, size, offset = page_bounds(t.count(), 99_999, 20)
    return t.select("seq", "ip", "status").orderBy(F.desc("seq")).offset(offset).limit(size)


USERS = "select c_custkey as user_id, c_name as username, c_nationkey as region from customer"
RECENT = "timestamp '1998-01-01'"


@query("select c.c_custkey as user_id, n.n_name as region, coalesce(o.n, 0)::bigint as devices, o.last_seen, o.app_version from customer c join nation n on c.c_nationkey = n.n_nationkey left join (select o_custkey, count(*) as n, max(o_orderdate) as last_seen, arg_max(o_orderpriority, (o_orderdate, o_orderkey)) as app_version from orders group by 1) o on o.o_custkey = c.c_custkey")
def user_board(spark, sf_dir):
    """Per user: device count, last seen and the newest device's version; correlated lookups become one aggregation."""
    orders = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("devices"), F.max("o_orderdate").alias("last_seen"), F.max_by("o_orderpriority", F.struct("o_orderdate", "o_orderkey")).alias("app_version"))
    users = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return users.join(orders, F.col("c_custkey") == F.col("o_custkey"), "left").select(F.col("c_custkey").alias("user_id"), F.col("n_name").alias("region"), F.coalesce("devices", F.lit(0)).alias("devices"), "last_seen", "app_version")


@query(f"select c_custkey as user_id, c_name as username from customer where exists (select 1 from orders where o_custkey = c_custkey and o_orderdate >= {RECENT})")
def user_online(spark, sf_dir):
    """Users with a device seen lately: EXISTS as a semi join."""
    seen = table(spark, sf_dir, "orders").where(F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp_ntz"))
    return table(spark, sf_dir, "customer").join(seen, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("username"))


@query(f"select c_custkey as user_id, c_name as username from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_orderdate >= {RECENT})")
def user_offline(spark, sf_dir):
    """Users without one: NOT EXISTS as an anti join."""
    seen = table(spark, sf_dir, "orders").where(F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp_ntz"))
    return table(spark, sf_dir, "customer").join(seen, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("username"))


@query("select (select count(*) from customer) as users, (select count(*) from customer where c_acctbal >= 0) as active_users, (select count(*) from orders) as devices, (select count(*) from orders where o_orderstatus = 'O') as online_devices, (select count(distinct o_custkey) from orders) as users_with_device")
def user_overview(spark, sf_dir):
    """The overview's scalar counts, one aggregation a table."""
    users = table(spark, sf_dir, "customer").agg(F.count("*").alias("users"), F.count_if(F.col("c_acctbal") >= 0).alias("active_users"))
    devices = table(spark, sf_dir, "orders").agg(F.count("*").alias("devices"), F.count_if(F.col("o_orderstatus") == "O").alias("online_devices"), F.count_distinct("o_custkey").alias("users_with_device"))
    return users.join(devices)  # one row each


_DETAIL = "case o_orderstatus when 'O' then 0 when 'P' then 1 else 2 end"


@query(f"select o_custkey as user_id, o_orderkey as device_id, o_orderstatus as state, n, n_online from (select *, row_number() over (partition by o_custkey order by {_DETAIL}, o_orderdate desc, o_orderkey) as rn, count(*) over (partition by o_custkey) as n, (count_if(o_orderstatus = 'O') over (partition by o_custkey))::bigint as n_online from orders) where rn = 1")
def user_detail_current_device(spark, sf_dir):
    """Summary and current device of each user: online ones first, then the latest, then the smallest id."""
    order = F.when(F.col("o_orderstatus") == "O", 0).when(F.col("o_orderstatus") == "P", 1).otherwise(2)
    best = F.min_by(F.struct("o_orderkey", "o_orderstatus"), F.struct(order, -F.unix_micros(F.col("o_orderdate").cast("timestamp")), F.col("o_orderkey")))
    out = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("user_id")).agg(best.alias("d"), F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "O").alias("n_online"))
    return out.select("user_id", F.col("d.o_orderkey").alias("device_id"), F.col("d.o_orderstatus").alias("state"), "n", "n_online")


@query("select o.o_orderkey as request_id, c.c_name as username, coalesce(n.n_name, '') as device_name from orders o join customer c on o.o_custkey = c.c_custkey left join nation n on n.n_nationkey = c.c_nationkey + 15 where coalesce(n.n_name, '') <> 'NATION_20'")
def request_list_left_device(spark, sf_dir):
    """Requests with their user and, where there is one, their device; the filter keeps rows without a device."""
    req = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    req = req.join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey") + 15, "left")
    name = F.coalesce("n_name", F.lit(""))
    return req.where(name != "NATION_20").select(F.col("o_orderkey").alias("request_id"), F.col("c_name").alias("username"), name.alias("device_name"))


@query("select c_name as username, n_name as device_name, c_mktsegment as platform from customer join nation on c_nationkey = n_nationkey where c_acctbal > 0 and n_regionkey in (select r_regionkey from region where r_name <> 'ASIA')")
def device_list(spark, sf_dir):
    """Devices of active users: inner joins with filters and a semi join by an id set."""
    regions = table(spark, sf_dir, "region").where(F.col("r_name") != "ASIA")
    nations = table(spark, sf_dir, "nation").join(regions, F.col("n_regionkey") == F.col("r_regionkey"), "left_semi")
    return table(spark, sf_dir, "customer").where("c_acctbal > 0").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_name").alias("username"), F.col("n_name").alias("device_name"), F.col("c_mktsegment").alias("platform"))


@query("select cast(make_timestamp(cast(floor(epoch_us(ts) / 1000000) as bigint) * 1000000) as date) as day, count(*) as requests, count_if(event_type = 'purchase')::bigint as succeeded, count_if(event_type = 'error')::bigint as failed from events where ts >= timestamp '2024-01-10' group by 1")
def request_trend_utc(spark, sf_dir):
    """Requests by UTC day of their epoch seconds."""
    e = table(spark, sf_dir, "events").where(F.col("ts") >= F.lit("2024-01-10").cast("timestamp_ntz"))
    second = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000)
    return e.groupBy(F.to_date(F.timestamp_seconds(second)).alias("day")).agg(F.count("*").alias("requests"), F.count_if(F.col("event_type") == "purchase").alias("succeeded"), F.count_if(F.col("event_type") == "error").alias("failed"))


@query(f"{T} select seq, ip, (count(*) over (partition by ip order by second range between 3599 preceding and current row))::bigint as uploads, (count(*) over (partition by ip order by second range between 3599 preceding and current row)) >= 3 as over_quota from t")
def quota_window_count(spark, sf_dir):
    """Uploads of a client in the hour up to each one, against a quota."""
    n = F.count("*").over(W.partitionBy("ip").orderBy("second").rangeBetween(-3599, 0))
    return tasks(spark, sf_dir).select("seq", "ip", n.alias("uploads"), (n >= 3).alias("over_quota"))


@query(f"{T} select ip as user_id, event_type as request, count(*) as attempts, count(distinct status) as states, count(distinct duration) as payloads, count(distinct duration) > 1 as conflict from t group by 1, 2")
def request_lifecycle_conflicts(spark, sf_dir):
    """Replays of a request are harmless while the payload is the same; different payloads conflict."""
    return tasks(spark, sf_dir).groupBy(F.col("ip").alias("user_id"), F.col("event_type").alias("request")).agg(F.count("*").alias("attempts"), F.count_distinct("status").alias("states"), F.count_distinct("duration").alias("payloads"), (F.count_distinct("duration") > 1).alias("conflict"))


@query(f"{T} select event_type as stage, count(*) as total, count_if(ip % 7 <> 0)::bigint as succeeded, count_if(ip % 7 = 0)::bigint as failed, (quantile_disc(duration, 0.5) filter (where ip % 7 <> 0))::bigint as p50, (quantile_disc(duration, 0.95) filter (where ip % 7 <> 0))::bigint as p95, (max(duration) filter (where ip % 7 <> 0))::bigint as most from t group by 1")
def stage_latency_percentiles(spark, sf_dir):
    """Nearest-rank percentiles of a stage over its successes."""
    ok = F.col("ip") % 7 != 0
    return tasks(spark, sf_dir).groupBy(F.col("event_type").alias("stage")).agg(
        F.count("*").alias("total"), F.count_if(ok).alias("succeeded"), F.count_if(~ok).alias("failed"),
        F.expr("cast(percentile_disc(0.5) within group (order by duration) filter (where ip % 7 <> 0) as bigint)").alias("p50"),
        F.expr("cast(percentile_disc(0.95) within group (order by duration) filter (where ip % 7 <> 0) as bigint)").alias("p95"),
        F.max(F.when(ok, F.col("duration"))).alias("most"),
    )


_P90 = "list_sort(list(q))[cast(floor((count(*) - 1) * 0.9 + 0.5) as bigint) + 1]"


@query(f"select flag, min(q) as least, median(q) as middle, max(q) as most, count(*) as n, sum(q)::bigint as total, sum(q * q)::bigint as squares, {_P90} as p90 from (select l_returnflag || l_linestatus as flag, cast(l_quantity as bigint) as q from lineitem) group by flag")
def stage_stddev_median(spark, sf_dir):
    """Benchmark statistics; the deviation follows from integer sums, so no float order matters."""
    q = F.col("l_quantity").cast("bigint")
    x = table(spark, sf_dir, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("flag"), q.alias("q"))
    # p90 is the value at rank floor((n - 1) * 0.9 + 0.5): a count per value and a running sum, no list of all values.
    per = x.groupBy("flag", "q").agg(F.count("*").alias("c"))
    by = W.partitionBy("flag")
    ranked = per.withColumn("upto", F.sum("c").over(by.orderBy("q"))).withColumn("n", F.sum("c").over(by))
    ranked = ranked.withColumn("rank", F.floor((F.col("n") - 1) * 0.9 + 0.5)).withColumn("low", F.floor((F.col("n") - 1) / 2)).withColumn("high", F.ceil((F.col("n") - 1) / 2))
    first = lambda r: F.min(F.when(F.col("upto") > F.col(r), F.col("q")))
    return ranked.groupBy("flag").agg(F.min("q").alias("least"), ((first("low") + first("high")) / 2.0).alias("middle"), F.max("q").alias("most"), F.sum("c").alias("n"), F.sum(F.col("q") * F.col("c")).alias("total"), F.sum(F.col("q") * F.col("q") * F.col("c")).alias("squares"), first("rank").alias("p90"))


@query(f"{T} select seq, ip, status, keep_rank from (select *, row_number() over (partition by ip order by case when status in ('queued', 'processing') then 0 else 1 end desc, seq desc) as keep_rank from t) where keep_rank <= 5")
def cache_prune_tail(spark, sf_dir):
    """Cache pruning keeps the last entries of (active, then done): finished tasks outlive active ones."""
    active = F.when(F.col("status").isin("queued", "processing"), 0).otherwise(1)
    rank = F.row_number().over(W.partitionBy("ip").orderBy(F.desc(active), F.desc("seq")))
    return tasks(spark, sf_dir).withColumn("keep_rank", rank.cast("bigint")).where("keep_rank <= 5").select("seq", "ip", "status", "keep_rank")


@query(f"{T} select seq, ip, row_number() over (partition by ip order by seq) as queue_position, count(*) over (partition by ip) as queued from t where status = 'queued'")
def queue_position(spark, sf_dir):
    """Place of every waiting task in its queue."""
    by = W.partitionBy("ip")
    waiting = tasks(spark, sf_dir).where(_is("queued"))
    return waiting.select("seq", "ip", F.row_number().over(by.orderBy("seq")).cast("bigint").alias("queue_position"), F.count("*").over(by).alias("queued"))


@query(f"{T} select seq, case when status in ('queued', 'processing') then 'interrupted' else status end as status, status in ('queued', 'processing') as recovered from t")
def restart_recovery(spark, sf_dir):
    """After a restart, tasks that were waiting or running are interrupted."""
    live = F.col("status").isin("queued", "processing")
    return tasks(spark, sf_dir).select("seq", F.when(live, "interrupted").otherwise(F.col("status")).alias("status"), live.alias("recovered"))


@query("select p_partkey as preset_id, p_brand as name, p_size as owner_id, p_type in ('ECONOMY') as is_system from part where p_type = 'ECONOMY' or p_size % 3 = 0 or (p_size % 3 = 1 and p_size = 7)")
def preset_visibility(spark, sf_dir):
    """Presets that are a system's, public, or private to the asking owner."""
    p = table(spark, sf_dir, "part")
    system, public = F.col("p_type") == "ECONOMY", F.col("p_size") % 3 == 0
    own = (F.col("p_size") % 3 == 1) & (F.col("p_size") == 7)
    return p.where(system | public | own).select(F.col("p_partkey").alias("preset_id"), F.col("p_brand").alias("name"), F.col("p_size").alias("owner_id"), system.alias("is_system"))


@query("select lower(p_name) as name, p_size as owner_id, count(*) as n, min(p_partkey) as first_id from part group by 1, 2 having count(*) > 1")
def preset_name_conflicts(spark, sf_dir):
    """Names that are not unique for an owner, regardless of case."""
    return table(spark, sf_dir, "part").groupBy(F.lower("p_name").alias("name"), F.col("p_size").alias("owner_id")).agg(F.count("*").alias("n"), F.min("p_partkey").alias("first_id")).where("n > 1")


@query("select p_partkey, p_size as owner_id, case when rn = 1 then p_name else p_name || ' (' || rn || ')' end as name from (select *, row_number() over (partition by p_size, lower(p_name) order by p_partkey) as rn from part)")
def owner_migration_rename(spark, sf_dir):
    """Merging owners renames later presets of the same name by number."""
    rn = F.row_number().over(W.partitionBy("p_size", F.lower("p_name")).orderBy("p_partkey"))
    name = F.when(rn == 1, F.col("p_name")).otherwise(F.concat("p_name", F.lit(" ("), rn.cast("string"), F.lit(")")))
    return table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").alias("owner_id"), name.alias("name"))


@query(f"{T} select ip as user_id, max(second) as last_seen, max(second) + 1800 >= (select max(second) from t) as online from t group by 1")
def session_online(spark, sf_dir):
    """A user is online if seen within 1800 seconds of now; now is the log's last second."""
    t = tasks(spark, sf_dir)
    now = t.agg(F.max("second").alias("now"))
    return t.groupBy(F.col("ip").alias("user_id")).agg(F.max("second").alias("last_seen")).join(F.broadcast(now)).select("user_id", "last_seen", (F.col("last_seen") + 1800 >= F.col("now")).alias("online"))


@query(f"{T} select ip as request_id, count(*) as deliveries, count(distinct status) as payloads, case when count(distinct status) > 1 then 'conflict' else 'stored' end as outcome, arg_min(status, seq) as status from t group by 1")
def outbox_idempotent(spark, sf_dir):
    """At-least-once delivery: equal payloads are stored once, different ones are a conflict."""
    return tasks(spark, sf_dir).groupBy(F.col("ip").alias("request_id")).agg(F.count("*").alias("deliveries"), F.count_distinct("status").alias("payloads"), F.when(F.count_distinct("status") > 1, "conflict").otherwise("stored").alias("outcome"), F.min_by("status", "seq").alias("status"))


@query("select conv_id as notification_id, turn, role, row_number() over (partition by role order by conv_id, turn) as place from conversations qualify place <= 25")
def notification_batch(spark, sf_dir):
    """Oldest notifications first, a capped batch for each receiver."""
    place = F.row_number().over(W.partitionBy("role").orderBy("conv_id", "turn"))
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("notification_id"), "turn", "role", place.cast("bigint").alias("place")).where("place <= 25")


@query("select c_custkey as user_id from customer where c_custkey not in (select o_custkey from orders where o_orderstatus = 'F')")
def cascade_delete_rest(spark, sf_dir):
    """What stays after users with a deleted device are removed."""
    gone = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select("o_custkey")
    return table(spark, sf_dir, "customer").join(gone, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select(F.col("c_custkey").alias("user_id"))


@query(f"{T} select ip as id, min(seq) as first_seq, max(seq) as last_seq, count(*) as updates, arg_max(status, seq) = 'failed' as deleted from t group by 1")
def tombstone_latest(spark, sf_dir):
    """Settings and bans as a log: the latest row per key wins, and a tombstone hides it."""
    return tasks(spark, sf_dir).groupBy(F.col("ip").alias("id")).agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.count("*").alias("updates"), (F.max_by("status", "seq") == "failed").alias("deleted"))
