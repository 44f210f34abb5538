"""Sessions as a stateful stream: sign-in, refreshes that are not written too often, expiry by timers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quire.plans.registry import query
from quire.streaming.tasks import drained, events

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
LIFE, REFRESH = 7 * 86_400, 86_400  # seconds


class Sessions(StatefulProcessor):
    """One session a client: (expires, seen) in seconds, and a timer at its expiry."""

    def __init__(self, life: int, refresh: int):
        self.life, self.refresh = life, refresh

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.session = handle.getValueState("session", "expires bigint, seen bigint")

    def _told(self, key: tuple, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(key[0], second, kind) for second, kind in rows], columns=["ip", "second", "kind"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.session.get() if self.session.exists() else None
        before, out = known, []
        for second in pd.concat(list(rows)).sort_values(["second", "seq"])["second"].tolist():
            if known is not None and second >= known[0]:
                out.append((known[0], "expired"))
                known = None
            if known is None:
                known = (second + self.life, second)
                out.append((second, "login"))
            elif second - known[1] >= self.refresh:
                known = (known[0], second)
                out.append((second, "refresh"))
        if before is None or before[0] != known[0]:
            if before is not None:
                self.handle.deleteTimer(before[0] * 1000)
            self.handle.registerTimer(known[0] * 1000)
        self.session.update(known)
        yield self._told(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        second = expiredTimerInfo.getExpiryTimeInMs() // 1000
        self.session.clear()
        yield self._told(key, [(second, "expired")])

    def close(self) -> None:
        pass


def sessions(stream: DataFrame, life: int = LIFE, refresh: int = REFRESH, delay: str = "1 hour") -> DataFrame:
    """(ip, second, kind) of sign-ins, written refreshes and expiries; a session ends life seconds after its sign-in, whether or not its client comes back."""
    second = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).cast("bigint")
    rows = stream.select(F.col("user_id").alias("ip"), F.col("event_id").alias("seq"), second.alias("second"), F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", delay)
    return rows.groupBy("ip").transformWithStateInPandas(Sessions(life, refresh), "ip bigint, second bigint, kind string", "Append", "EventTime")


SESSIONS_SQL = f"""with recursive t as (select user_id as ip, event_id as seq, cast(floor(epoch_us(ts) / 1000000) as bigint) as second from events), n as (select *, row_number() over (partition by ip order by second, seq) as k from t),
r(ip, k, second, expires, seen, was, kind) as (select ip, k, second, second + {LIFE}, second, null::bigint, 'login' from n where k = 1
  union all select n.ip, n.k, n.second, case when n.second >= r.expires then n.second + {LIFE} else r.expires end, case when n.second >= r.expires or n.second - r.seen >= {REFRESH} then n.second else r.seen end, case when n.second >= r.expires then r.expires end,
    case when n.second >= r.expires then 'login' when n.second - r.seen >= {REFRESH} then 'refresh' else 'kept' end from r join n on n.ip = r.ip and n.k = r.k + 1),
last as (select ip, arg_max(expires, k) as expires from r group by 1)
select ip, second, kind from r where kind <> 'kept' union all select ip, was, 'expired' from r where was is not null
union all select ip, expires, 'expired' from last where expires * 1000 <= (select floor(epoch_us(max(ts)) / 1000) - 3600000 from events)"""


@query(SESSIONS_SQL)
def stream_sessions(spark, sf_dir):
    """Sign-ins, refreshes at most once a day, and expiries after seven days."""
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        return drained(sessions(events(spark, sf_dir)))
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
