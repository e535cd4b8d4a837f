"""Type 2 dimensions and point-in-time reads."""

from __future__ import annotations

from pyspark.sql import functions as F

from dayslice.functions import columns as C
from dayslice.operators import joins, scd2
from dayslice.plans import customers
from dayslice.session import materialize

from . import recipes as R
from .recipes import with_tables
from .registry import query

LAST = "2002-01-01"

_CHANGES = """chg AS (SELECT *, lag(tier) OVER (PARTITION BY customer_id ORDER BY snapshot_date) AS prev,
    row_number() OVER (PARTITION BY customer_id ORDER BY snapshot_date) AS rn FROM snapshots_v),
ver AS (SELECT customer_id, tier, snapshot_date, lead(snapshot_date) OVER (PARTITION BY customer_id ORDER BY snapshot_date) AS nxt,
    row_number() OVER (PARTITION BY customer_id ORDER BY snapshot_date) AS version
  FROM chg WHERE rn = 1 OR tier IS DISTINCT FROM prev),
dim AS (SELECT customer_id, tier, snapshot_date AS effective_date,
    CASE WHEN nxt IS NULL THEN DATE '9999-12-31' ELSE CAST(nxt - INTERVAL 1 DAY AS DATE) END AS expiration_date,
    nxt IS NULL AS is_current, version FROM ver)"""
_DIM_COLS = """customer_id, tier, CAST(effective_date AS VARCHAR) AS effective_date,
  CAST(expiration_date AS VARCHAR) AS expiration_date, is_current, version"""


def closed_dim(spark, sf):
    return scd2.scd2_from_snapshots(R.snapshots_v(spark, sf), ["customer_id"], ["tier"])


def stored_history(snaps, **options):
    """Versions up to the last snapshot, as a table on disk, which is what a daily run starts from."""
    earlier = snaps.where(F.col("snapshot_date") < C.day(LAST))
    return materialize(scd2.scd2_from_snapshots(earlier, ["customer_id"], ["tier"], **options), "history")


@query("scd2_from_snapshots", with_tables(f"WITH {_CHANGES} SELECT {_DIM_COLS} FROM dim", "snapshots_v"))
def scd2_from_snapshots(spark, sf):
    return closed_dim(spark, sf)


@query("scd2_closed", with_tables(f"WITH {_CHANGES} SELECT {_DIM_COLS} FROM dim", "snapshots_v"))
def scd2_closed(spark, sf):
    """History up to the last snapshot, then that snapshot applied as a daily run would."""
    snaps = R.snapshots_v(spark, sf)
    before = stored_history(snaps)
    today = snaps.where(F.col("snapshot_date") == C.day(LAST))
    return scd2.apply_scd2_closed(before, today, ["customer_id"], ["tier"], LAST)


@query(
    "scd2_open",
    with_tables(
        f"""WITH {_CHANGES},
old AS (SELECT row_number() OVER (ORDER BY substr(md5(customer_id || '|' || CAST(snapshot_date AS VARCHAR)), 1, 4),
    customer_id, snapshot_date) AS customer_key, * FROM ver WHERE snapshot_date < DATE '{LAST}'),
new AS (SELECT (SELECT COALESCE(MAX(customer_key), 0) FROM old) + row_number() OVER (
    ORDER BY substr(md5(CAST(customer_id AS VARCHAR)), 1, 4), customer_id) AS customer_key, *
  FROM ver WHERE snapshot_date = DATE '{LAST}')
SELECT customer_key, customer_id, tier, CAST(snapshot_date AS VARCHAR) AS effective_from,
  CAST(nxt AS VARCHAR) AS effective_to, nxt IS NULL AS is_current
FROM (SELECT * FROM old UNION ALL SELECT * FROM new)""",
        "snapshots_v",
    ),
)
def scd2_open(spark, sf):
    snaps = R.snapshots_v(spark, sf)
    before = stored_history(snaps, closed=False, surrogate="customer_key")
    today = snaps.where(F.col("snapshot_date") == C.day(LAST))
    return scd2.apply_scd2_open(before, today, ["customer_id"], ["tier"], LAST)


@query(
    "scd2_close_missing",
    with_tables(
        f"""WITH {_CHANGES}, prior AS (SELECT * FROM snapshots_v WHERE snapshot_date < DATE '{LAST}')
SELECT COUNT(*) AS versions, CAST(SUM(CASE WHEN is_current
    AND customer_id IN (SELECT customer_id FROM snapshots_v WHERE snapshot_date = DATE '{LAST}') THEN 1 ELSE 0 END) AS BIGINT) AS current_rows
FROM dim""",
        "snapshots_v",
    ),
)
def scd2_close_missing(spark, sf):
    snaps = R.snapshots_v(spark, sf)
    before = stored_history(snaps)
    today = snaps.where(F.col("snapshot_date") == C.day(LAST))
    dim = scd2.apply_scd2_closed(before, today, ["customer_id"], ["tier"], LAST, close_missing=True)
    return dim.agg(F.count("*").alias("versions"), C.count_if(F.col("is_current")).alias("current_rows"))


@query(
    "as_of",
    with_tables(
        f"""WITH {_CHANGES} SELECT customer_id, tier, version FROM dim
WHERE DATE '1999-06-30' BETWEEN effective_date AND expiration_date""",
        "snapshots_v",
    ),
)
def as_of(spark, sf):
    dim = closed_dim(spark, sf)
    return scd2.as_of(dim, "1999-06-30", "effective_date", "expiration_date").select(
        "customer_id", "tier", "version"
    )


@query(
    "join_as_of",
    with_tables(
        f"""WITH {_CHANGES} SELECT o.order_id, o.customer_id, CAST(o.amount AS DOUBLE) AS amount, d.tier, d.version
FROM orders_v o LEFT JOIN dim d ON d.customer_id = o.customer_id
  AND o.order_date BETWEEN d.effective_date AND d.expiration_date""",
        "snapshots_v", "orders_v",
    ),
)
def join_as_of(spark, sf):
    joined = joins.join_as_of(
        R.orders_v(spark, sf), closed_dim(spark, sf), ["customer_id"],
        "order_date", "effective_date", "expiration_date",
    )
    return joined.select("order_id", "customer_id", "amount", "tier", "version")


@query(
    "join_as_of_sorted",
    with_tables(
        f"""WITH {_CHANGES} SELECT o.order_id, o.customer_id, CAST(o.amount AS DOUBLE) AS amount, d.tier, d.version
FROM orders_v o LEFT JOIN dim d ON d.customer_id = o.customer_id
  AND o.order_date BETWEEN d.effective_date AND d.expiration_date""",
        "snapshots_v", "orders_v",
    ),
)
def join_as_of_sorted(spark, sf):
    """By one sorted run for each customer; customers of many orders are cut into ranges of time."""
    joined = joins.join_as_of_sorted(
        R.orders_v(spark, sf), materialize(closed_dim(spark, sf), "dim"), ["customer_id"],
        "order_date", "effective_date", "expiration_date", hot_rows=20,
    )
    return joined.select("order_id", "customer_id", "amount", "tier", "version")


_CLOSING = """days AS (SELECT d, lead(d) OVER (ORDER BY d) AS next_day FROM (SELECT DISTINCT snapshot_date AS d FROM seen)),
marked AS (SELECT s.customer_id, s.tier, s.snapshot_date, d.next_day,
    lag(s.tier) OVER w AS prev, lag(d.next_day) OVER w AS expected
  FROM seen s JOIN days d ON d.d = s.snapshot_date WINDOW w AS (PARTITION BY s.customer_id ORDER BY s.snapshot_date)),
numbered AS (SELECT *, SUM(CASE WHEN expected = snapshot_date AND tier IS NOT DISTINCT FROM prev THEN 0 ELSE 1 END)
    OVER (PARTITION BY customer_id ORDER BY snapshot_date) AS version FROM marked)"""


@query(
    "scd2_from_snapshots_closing",
    with_tables(
        f"""WITH seen AS (SELECT * FROM snapshots_v WHERE (customer_id + year(snapshot_date)) % 4 <> 0), {_CLOSING}
SELECT customer_id, MAX(tier) AS tier, CAST(MIN(snapshot_date) AS VARCHAR) AS effective_date,
  CAST(CASE WHEN MAX(snapshot_date) = (SELECT MAX(d) FROM days) THEN DATE '9999-12-31' ELSE CAST(MAX(next_day) - INTERVAL 1 DAY AS DATE) END AS VARCHAR) AS expiration_date,
  MAX(snapshot_date) = (SELECT MAX(d) FROM days) AS is_current, CAST(version AS BIGINT) AS version
FROM numbered GROUP BY customer_id, version""",
        "snapshots_v",
    ),
)
def scd2_from_snapshots_closing(spark, sf):
    """Customers are left out of one snapshot in four: their versions end, and start anew when they come back."""
    seen = R.snapshots_v(spark, sf).where((F.col("customer_id") + F.year("snapshot_date")) % 4 != 0)
    return scd2.scd2_from_snapshots_closing(seen, ["customer_id"], ["tier"])


@query(
    "join_current",
    with_tables(
        f"""WITH {_CHANGES} SELECT d.tier, COUNT(*) AS orders, CAST(SUM(o.amount) AS DOUBLE) AS amount
FROM orders_v o JOIN dim d ON d.customer_id = o.customer_id AND d.is_current GROUP BY 1""",
        "snapshots_v", "orders_v",
    ),
)
def join_current(spark, sf):
    joined = joins.join_current(R.orders_v(spark, sf), closed_dim(spark, sf), ["customer_id"])
    return joined.groupBy("tier").agg(F.count("*").alias("orders"), F.sum("amount").alias("amount"))


@query(
    "overlapping_versions",
    with_tables(
        f"""WITH {_CHANGES}, bad AS (SELECT * REPLACE (CAST(expiration_date + INTERVAL 30 DAY AS DATE) AS expiration_date)
  FROM dim WHERE NOT is_current UNION ALL SELECT * FROM dim WHERE is_current)
SELECT customer_id, version, CAST(effective_date AS VARCHAR) AS effective_date FROM bad b
WHERE EXISTS (SELECT 1 FROM bad a WHERE a.customer_id = b.customer_id AND a.version < b.version
  AND a.expiration_date >= b.effective_date)""",
        "snapshots_v",
    ),
)
def overlapping_versions(spark, sf):
    longer = F.when(F.col("is_current"), F.col("expiration_date")).otherwise(
        F.date_add("expiration_date", 30)
    )
    bad = closed_dim(spark, sf).withColumn("expiration_date", longer)
    return scd2.overlapping_versions(
        bad, ["customer_id"], "version", "effective_date", "expiration_date"
    ).select("customer_id", "version", "effective_date")


@query(
    "version_gaps",
    with_tables(
        f"""WITH {_CHANGES}, cut AS (SELECT * FROM dim WHERE version <> 2)
SELECT customer_id, version, CAST(nxt AS VARCHAR) AS next_start FROM (
  SELECT *, lead(effective_date) OVER (PARTITION BY customer_id ORDER BY effective_date) AS nxt FROM cut)
WHERE nxt > CAST(expiration_date + INTERVAL 1 DAY AS DATE)""",
        "snapshots_v",
    ),
)
def version_gaps(spark, sf):
    holes = closed_dim(spark, sf).where("version <> 2")
    return scd2.gaps_between_versions(holes, ["customer_id"]).select(
        "customer_id", "version", "next_start"
    )


@query(
    "scd2_problems",
    with_tables(
        f"""WITH {_CHANGES}, bad AS (SELECT customer_id, version, is_current, effective_date,
  CASE WHEN version = 3 AND NOT is_current THEN CAST(expiration_date + INTERVAL 30 DAY AS DATE) ELSE expiration_date END AS expiration_date
  FROM dim WHERE version <> 2),
k AS (SELECT customer_id, COUNT(*) FILTER (WHERE is_current) AS cur FROM bad GROUP BY 1),
o AS (SELECT COUNT(*) AS n FROM bad b WHERE EXISTS (SELECT 1 FROM bad a WHERE a.customer_id = b.customer_id
  AND a.version < b.version AND a.expiration_date >= b.effective_date)),
g AS (SELECT COUNT(*) AS n FROM (SELECT expiration_date, lead(effective_date) OVER (PARTITION BY customer_id ORDER BY version) AS nxt FROM bad)
  WHERE nxt > CAST(expiration_date + INTERVAL 1 DAY AS DATE)),
r AS (SELECT COUNT(*) AS n FROM (SELECT 1 FROM bad GROUP BY customer_id, version HAVING COUNT(*) > 1))
SELECT (SELECT COUNT(*) FROM k WHERE cur > 1) AS several_current, (SELECT COUNT(*) FROM k WHERE cur = 0) AS no_current,
  (SELECT n FROM o) AS overlaps, (SELECT n FROM g) AS gaps, (SELECT n FROM r) AS repeated_versions""",
        "snapshots_v",
    ),
)
def scd2_problems(spark, sf):
    """A damaged dimension: second versions lost, third versions too long."""
    longer = F.when((F.col("version") == 3) & ~F.col("is_current"), F.date_add("expiration_date", 30))
    bad = closed_dim(spark, sf).where("version <> 2").withColumn(
        "expiration_date", F.coalesce(longer, F.col("expiration_date"))
    )
    return scd2.scd2_problems(bad, ["customer_id"])


@query("tier_history", with_tables(
    f"WITH {_CHANGES} SELECT tier, COUNT(*) AS versions, COUNT(DISTINCT customer_id) AS customers FROM dim GROUP BY 1",
    "snapshots_v",
))
def tier_history(spark, sf):
    history = customers.tier_history(R.snapshots_v(spark, sf), attr="tier")
    return history.groupBy("tier").agg(
        F.count("*").alias("versions"), F.count_distinct("customer_id").alias("customers")
    )
