"""Queries on time-ordered rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import histogram as h
from tessera.operators import series as s
from tessera.streaming.windows import sessions
from tessera.plans.common import ORDER, SQL_BINNED, events, r6


def binned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return h.assign(events(spark, sf_dir), ["value"], 30)


def lag_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.lag_pairs(events(spark, sf_dir), "user_id", ORDER, ["value"], 3).select("event_id", "value", "value_t")


def transition_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.stochastic(s.transitions(binned(spark, sf_dir), "user_id", ORDER, 1)).select("src", "dst", "c", r6("p").alias("p"))


def transition_counts_by_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = binned(spark, sf_dir).withColumn("parity", (F.col("user_id") % 2).cast("int"))
    return s.transitions(rows, "user_id", ORDER, 2, "parity")


def top_destinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.top_destinations(s.transitions(binned(spark, sf_dir), "user_id", ORDER, 1), 3)


def destination_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.destinations(s.transitions(binned(spark, sf_dir), "user_id", ORDER, 1)).select("least", r6("mean").alias("mean"), "most")


def block_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.block_error(events(spark, sf_dir), "user_id", ORDER, "value", 5).select("user_id", "blocks", r6("se").alias("se"))


def acf_direct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.autocorrelation(events(spark, sf_dir), "user_id", ORDER, "value", 5).select("lag", r6("acf").alias("acf"))


def timescale(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir)
    smooth = s.running(rows, "user_id", ORDER, "value")
    return s.timescale(smooth, "user_id", ORDER, "run_sum", 1).select(r6("r").alias("r"), F.round("tau", 4).alias("tau"))


def subsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.subsample(events(spark, sf_dir), "user_id", ORDER, 10).select("user_id", "event_id", "value")


def equilibration_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.trim(events(spark, sf_dir), "user_id", ORDER, 20, 40).select("user_id", "event_id")


def first_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = s.first_row(events(spark, sf_dir), "user_id", ORDER, "value", "origin")
    return out.select("event_id", r6(F.col("value") - F.col("origin")).alias("moved"))


def running_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.running(events(spark, sf_dir), "user_id", ORDER, "value").select("event_id", F.round("run_sum", 4).alias("run_sum"), r6(F.sqrt("run_var")).alias("run_sd"))


def rescaled_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).withColumn("rate", F.floor("value") + 1)
    return s.rescaled_lag(rows, "user_id", ORDER, "value", F.col("rate"), 250.0).select("event_id", F.round(F.col("value_t") / 7, 5).alias("seventh"))


def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of a user with gaps under twelve hours."""
    return sessions(events(spark, sf_dir), "ts", "user_id").select("user_id", "n", F.unix_timestamp(F.col("w.start").cast("timestamp")).alias("first_s"))


QUERIES = {f.__name__: f for f in (lag_pairs, transition_counts, transition_counts_by_window, top_destinations, destination_statistics, block_average, acf_direct, timescale, subsample, equilibration_trim, first_frame, running_moments, rescaled_lag, session_windows)}

_W = "(PARTITION BY user_id ORDER BY ts, event_id)"
_T = f"{SQL_BINNED}, l AS (SELECT user_id, bin src, lead(bin) OVER {_W} dst FROM m), c AS (SELECT src, dst, count(*) c FROM l WHERE dst IS NOT NULL GROUP BY 1,2)"

SQL = {
    "lag_pairs": f"SELECT event_id, value, value_t FROM (SELECT event_id, value, lead(value,3) OVER {_W} value_t FROM events) WHERE value_t IS NOT NULL",
    "transition_counts": f"WITH {_T} SELECT src, dst, c, round(c/sum(c) OVER (PARTITION BY src),6) AS p FROM c",
    "transition_counts_by_window": f"WITH {SQL_BINNED}, l AS (SELECT CAST(user_id%2 AS INT) parity, bin src, lead(bin,2) OVER {_W} dst FROM m) SELECT parity, src, dst, count(*) AS c FROM l WHERE dst IS NOT NULL GROUP BY ALL",
    "top_destinations": f"WITH {_T} SELECT * FROM (SELECT src, dst, c, row_number() OVER (PARTITION BY src ORDER BY c DESC, dst) AS rank FROM c) WHERE rank <= 3",
    "destination_statistics": f"WITH {_T}, k AS (SELECT src, count(DISTINCT dst) k FROM c GROUP BY src) SELECT min(k) AS least, round(avg(k),6) AS mean, max(k) AS most FROM k",
    "block_average": f"""WITH n AS (SELECT user_id, value, (row_number() OVER {_W} - 1)//5 b FROM events), m AS (SELECT user_id, b, avg(value) m FROM n GROUP BY 1,2 HAVING count(*)=5)
SELECT user_id, count(*) AS blocks, round(stddev_samp(m)/sqrt(count(*)),6) AS se FROM m GROUP BY 1""",
    "acf_direct": "WITH d AS (SELECT user_id, ts, event_id, value - avg(value) OVER (PARTITION BY user_id) d FROM events), a AS (SELECT d, "
    + ", ".join(f"lead(d,{k}) OVER {_W} d{k}" for k in range(1, 6))
    + " FROM d) "
    + " UNION ALL ".join(f"SELECT {k} AS lag, round(avg(d*d{k})/avg(d*d),6) AS acf FROM a" for k in range(1, 6)),
    "timescale": f"""WITH s AS (SELECT user_id, ts, event_id, sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) x FROM events), l AS (SELECT x, lead(x) OVER {_W} y FROM s), r AS (SELECT corr(x,y) r FROM l WHERE y IS NOT NULL)
SELECT round(r,6) AS r, round(CASE WHEN r>0 AND r<1 THEN -1/ln(r) END,4) AS tau FROM r""",
    "subsample": f"SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER {_W} - 1 k FROM events) WHERE k % 10 = 0",
    "equilibration_trim": f"SELECT user_id, event_id FROM (SELECT *, row_number() OVER {_W} - 1 k, count(*) OVER (PARTITION BY user_id) n FROM events) WHERE k >= 20 AND n > 60",
    "first_frame": f"SELECT event_id, round(value - first_value(value) OVER {_W},6) AS moved FROM events",
    "running_moments": "SELECT event_id, round(sum(value) OVER w,4) AS run_sum, round(stddev_pop(value) OVER w,6) AS run_sd FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)",
    "rescaled_lag": """WITH t AS (SELECT event_id, user_id, ts, value, coalesce(sum(floor(value)+1) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) s FROM events),
n AS (SELECT *, lead(s) OVER (PARTITION BY user_id ORDER BY ts, event_id) s1, lead(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) v1 FROM t)
SELECT a.event_id, round((b.value + (a.s+250-b.s)/(b.s1-b.s)*(b.v1-b.value))/7,5) AS seventh FROM n a JOIN n b ON a.user_id=b.user_id AND a.s+250>=b.s AND a.s+250<b.s1""",
    "session_windows": f"""WITH g AS (SELECT user_id, ts, event_id, CASE WHEN ts < lag(ts) OVER {_W} + INTERVAL 12 HOURS THEN 0 ELSE 1 END g FROM events), s AS (SELECT user_id, ts, sum(g) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) k FROM g)
SELECT user_id, count(*) AS n, CAST(floor(epoch(min(ts))) AS BIGINT) AS first_s FROM s GROUP BY user_id, k""",
}
