"""Queries of kept state: stores merged in versions, finding episodes, snapshots that arrive."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import contract as C
from ..sources.keyed_store import KeyedStore
from ..sources.shared import shared_root
from ..streaming import streams as ST
from .registry import query, table

#: Where the three slices of the orders end.
CUTS = ("1997-03-01", "1999-06-01", "2100-01-01")


def _place(spark, label: str) -> str:
    return f"{shared_root(spark)}/state/{label}-{uuid.uuid4().hex}"


def _added(old, new):
    """Counts and sums go up, the newest date wins."""
    o = old.withColumnsRenamed({c: f"o_{c}" for c in old.columns if c != "customer"})
    both = new.join(o, "customer", "full")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return both.select("customer", (zero("orders") + zero("o_orders")).alias("orders"), (zero("cents") + zero("o_cents")).alias("cents"), F.greatest("latest", "o_latest").alias("latest"))


_TOTALS = " UNION ALL ".join(f"SELECT {v} AS version, o_custkey AS customer, count(*) AS orders, sum(CAST(round(o_totalprice * 100) AS BIGINT))::BIGINT AS cents, max(o_orderdate)::DATE AS latest FROM orders WHERE o_orderdate < DATE '{cut}' GROUP BY 2" for v, cut in enumerate(CUTS, 1))


@query("S16_R21_order_store", f"WITH t AS ({_TOTALS}) SELECT version::BIGINT AS version, customer, orders, cents, latest FROM t")
def order_store(spark, sf_dir):
    """Orders arrive in three slices of time and are added to their customers' rows; the store as of each version."""
    orders = table(spark, sf_dir, "orders")
    store = KeyedStore(spark, _place(spark, "customers"), ["customer"], "customer long, orders long, cents long, latest date", 16)
    for version, (low, high) in enumerate(zip(("0001-01-01", *CUTS), CUTS), 1):
        part = orders.where((F.col("o_orderdate") >= F.lit(low).cast("date")) & (F.col("o_orderdate") < F.lit(high).cast("date")))
        new = part.groupBy(F.col("o_custkey").alias("customer")).agg(F.count("*").alias("orders"), F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("cents"), F.max("o_orderdate").cast("date").alias("latest"))
        store.merge(new, version, _added)
        store.merge(new.limit(0), version, _added)  # a version that is there stays as it is
    out = [store.read(v).withColumn("version", F.lit(v).cast("long")) for v in (1, 2, 3)]
    return out[0].unionByName(out[1]).unionByName(out[2])


FINDINGS = "path string, rule string, severity string, state string, first_seen string, last_seen string, seen_count long, resolved_at string, event string"
CHECKS = ("2024-01-11", "2024-01-21", "2024-02-01")
_CHECK = "SELECT DISTINCT user_id::VARCHAR AS path, event_type AS rule, CASE WHEN event_type = 'error' THEN 'critical' ELSE 'warning' END AS severity FROM events WHERE value > 150 AND ts < TIMESTAMP '{1}' AND ts >= TIMESTAMP '{0}'"


def _told(n: int) -> str:
    """The findings after check n, by the rules of the lifecycle."""
    day = CHECKS[n]
    current = _CHECK.format("2024-01-01" if n == 0 else CHECKS[n - 1], day)
    prior = f"f{n - 1}" if n else "(SELECT NULL::VARCHAR AS path, NULL::VARCHAR AS rule, NULL::VARCHAR AS severity, NULL::VARCHAR AS state, NULL::VARCHAR AS first_seen, NULL::VARCHAR AS last_seen, 0::BIGINT AS seen_count, NULL::VARCHAR AS resolved_at WHERE false)"
    return f"""c{n} AS ({current}), f{n} AS (SELECT coalesce(c.path, p.path) AS path, coalesce(c.rule, p.rule) AS rule, coalesce(c.severity, p.severity) AS severity,
  CASE WHEN c.path IS NOT NULL THEN 'open' WHEN p.state = 'open' THEN 'resolved' ELSE p.state END AS state, CASE WHEN c.path IS NOT NULL AND p.state IS DISTINCT FROM 'open' THEN '{day}' ELSE p.first_seen END AS first_seen,
  CASE WHEN c.path IS NOT NULL THEN '{day}' ELSE p.last_seen END AS last_seen, CASE WHEN c.path IS NULL THEN p.seen_count WHEN p.state = 'open' THEN p.seen_count + 1 ELSE 1 END::BIGINT AS seen_count,
  CASE WHEN c.path IS NULL THEN CASE WHEN p.state = 'open' THEN '{day}' ELSE p.resolved_at END END AS resolved_at,
  CASE WHEN c.path IS NOT NULL AND p.state = 'open' THEN 'still_open' WHEN c.path IS NOT NULL THEN 'opened' WHEN p.state = 'open' THEN 'resolved' ELSE 'unchanged' END AS event
  FROM c{n} c FULL JOIN {prior} p ON c.path = p.path AND c.rule = p.rule)"""


@query("J14_R2_finding_store", f"WITH {_told(0)}, {_told(1)}, {_told(2)} SELECT * FROM f2")
def finding_store(spark, sf_dir):
    """Three checks over the events (a finding: a user's values of a type over 150), each merged into the store of findings."""
    events = table(spark, sf_dir, "events").where("value > 150")
    store = KeyedStore(spark, _place(spark, "findings"), ["path", "rule"], FINDINGS, 16)
    for version, (low, high) in enumerate(zip(("2024-01-01", *CHECKS), CHECKS), 1):
        seen = events.where((F.col("ts") >= F.lit(low).cast("timestamp")) & (F.col("ts") < F.lit(high).cast("timestamp")))
        now = seen.select(F.col("user_id").cast("string").alias("path"), F.col("event_type").alias("rule"), F.when(F.col("event_type") == "error", "critical").otherwise("warning").alias("severity")).distinct()
        # what is not seen any more is resolved, so all buckets take part
        store.merge(now, version, lambda old, new, day=high: C.lifecycle(old, new, day), everywhere=True)
    return store.read()


def _slices(spark, sf_dir, columns, n):
    """The events as n files of a stream, one after the other in time; returns their folder and schema."""
    t = table(spark, sf_dir, "events").select(*columns)
    path = _place(spark, "events")
    bounds = t.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).first()
    step = (bounds["b"] - bounds["a"]) / n
    for k in range(n):
        low, high = bounds["a"] + step * k, bounds["a"] + step * (k + 1)
        upper = F.col("ts") < F.lit(high) if k < n - 1 else F.lit(True)
        t.where((F.col("ts") >= F.lit(low)) & upper).coalesce(1).write.mode("append").parquet(path)
    return path, t.schema


QUIET = 3 * 86400


@query("ST4_finding_stream", f"""WITH w AS (SELECT max(ts) - INTERVAL 1 DAY AS now FROM events), e AS (SELECT user_id, event_type, ts, CASE WHEN ts - lag(ts) OVER k <= INTERVAL {QUIET} SECOND THEN 0 ELSE 1 END AS opens FROM events WHERE value > 100 WINDOW k AS (PARTITION BY user_id, event_type ORDER BY ts)),
g AS (SELECT *, sum(opens) OVER (PARTITION BY user_id, event_type ORDER BY ts, opens DESC ROWS UNBOUNDED PRECEDING) AS n FROM e),
f AS (SELECT user_id, event_type, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS seen_count FROM g GROUP BY user_id, event_type, n)
SELECT user_id, event_type, first_seen, last_seen, seen_count, last_seen + INTERVAL {QUIET} SECOND AS resolved_at FROM f, w WHERE last_seen + INTERVAL {QUIET} SECOND < now""")
def finding_episodes(spark, sf_dir):
    """Events over 100 as sightings, in files of time; those not seen for three days are resolved, unless the stream ends before."""
    path, schema = _slices(spark, sf_dir, ["ts", "user_id", "event_type", "value"], 4)
    out = _place(spark, "episodes")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    sightings = stream.select("user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"), (F.col("value") > 100).alias("seen"))
    ST.drained(ST.finding_episodes(sightings, "ts", ["user_id", "event_type"], QUIET, "seen"), out, f"{out}-checkpoint")
    return spark.read.parquet(out).select("user_id", "event_type", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("first_seen", "last_seen")], "seen_count", F.col("resolved_at").cast("timestamp_ntz").alias("resolved_at"))


@query("ST5_snapshot_changes", """WITH b AS (SELECT min(ts) AS a, (epoch_us(max(ts)) - epoch_us(min(ts))) / 4 AS step FROM events), p AS (SELECT DISTINCT event_type, user_id, least(3, floor((epoch_us(ts) - epoch_us(a)) / step))::INT AS part FROM events, b WHERE value > 60),
j AS (SELECT coalesce(n.event_type, o.event_type) AS event_type, coalesce(n.user_id, o.user_id) AS user_id, coalesce(n.part, o.part + 1) AS part, CASE WHEN o.part IS NULL THEN 'entrant' WHEN n.part IS NULL THEN 'exit' ELSE 'held' END AS state FROM p n FULL JOIN p o ON n.event_type = o.event_type AND n.user_id = o.user_id AND n.part = o.part + 1)
SELECT * FROM j WHERE part < 4""")
def event_snapshots(spark, sf_dir):
    """Users by type in four parts of the events, each against the part before it; the third part is delivered twice."""
    events = table(spark, sf_dir, "events")
    bounds = events.agg(F.unix_micros(F.min("ts").cast("timestamp")).alias("a"), F.unix_micros(F.max("ts").cast("timestamp")).alias("b")).first()
    step = (bounds["b"] - bounds["a"]) / 4
    part = F.least(F.lit(3), F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - bounds["a"]) / step).cast("int"))
    rows = events.where("value > 60").select("event_type", "user_id", part.alias("part"))
    path, out = _place(spark, "snapshots"), _place(spark, "moves")
    for k in (0, 1, 2, 2, 3):
        rows.where(F.col("part") == k).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)
    ST.snapshot_changes(stream, "part", ["event_type", "user_id"], out, f"{out}-checkpoint")
    return spark.read.parquet(out).select("event_type", "user_id", "part", "state")
