"""Load patterns: slices, upserts, change data."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from dayslice.errors import SchemaDriftError
from dayslice.functions import columns as C
from dayslice.operators import load, shape
from dayslice.operators.dedup import keep_first, keep_latest
from dayslice.plans import ads, orders as order_plans
from dayslice.session import new_dir
from dayslice.sources import writers
from dayslice.sources.readers import read_partitioned

from . import recipes as R
from .recipes import with_tables
from .registry import query

_ORDER_COLS = """order_id, customer_id, CAST(order_date AS VARCHAR) AS order_date, order_status,
  CAST(amount AS DOUBLE) AS amount, partner"""
DS = "2001-07-15"


@query(
    "replace_slice",
    with_tables(
        f"""SELECT {_ORDER_COLS} FROM orders_v WHERE order_date <> DATE '{DS}'
UNION ALL SELECT order_id, customer_id, CAST(order_date AS VARCHAR), 'X', CAST(amount AS DOUBLE), partner
FROM orders_v WHERE order_date = DATE '{DS}'""",
        "orders_v",
    ),
)
def replace_slice(spark, sf):
    tgt = R.orders_v(spark, sf)
    day = shape.on_day(tgt, "order_date", DS).withColumn("order_status", F.lit("X"))
    return load.replace_slice(tgt, day, "order_date", DS)


@query(
    "delete_range",
    with_tables(
        f"SELECT {_ORDER_COLS} FROM orders_v WHERE order_date NOT BETWEEN DATE '1996-01-01' AND DATE '1998-12-31'",
        "orders_v",
    ),
)
def delete_range(spark, sf):
    return load.delete_range(R.orders_v(spark, sf), "order_date", "1996-01-01", "1998-12-31")


@query(
    "upsert_scd1",
    with_tables(
        """WITH old AS (SELECT customer_id, max_by(partner, order_id) AS partner,
  MIN(order_date) AS first_seen_date, MAX(order_date) AS last_updated_date
  FROM orders_v WHERE order_date < DATE '2001-01-01' GROUP BY 1),
new AS (SELECT customer_id, max_by(partner, order_id) AS partner FROM orders_v
  WHERE order_date >= DATE '2001-01-01' GROUP BY 1)
SELECT COALESCE(n.customer_id, o.customer_id) AS customer_id, COALESCE(n.partner, o.partner) AS partner,
  CAST(COALESCE(o.first_seen_date, DATE '2001-08-01') AS VARCHAR) AS first_seen_date,
  CAST(CASE WHEN n.customer_id IS NOT NULL THEN DATE '2001-08-01' ELSE o.last_updated_date END AS VARCHAR) AS last_updated_date
FROM old o FULL JOIN new n ON n.customer_id = o.customer_id""",
        "orders_v",
    ),
)
def upsert_scd1(spark, sf):
    orders = R.orders_v(spark, sf)
    cut = C.day(R.ORDER_CUT)
    dim = orders.where(F.col("order_date") < cut).groupBy("customer_id").agg(
        F.max_by("partner", "order_id").alias("partner"),
        F.min("order_date").alias("first_seen_date"),
        F.max("order_date").alias("last_updated_date"),
    )
    batch = orders.where(F.col("order_date") >= cut).groupBy("customer_id").agg(
        F.max_by("partner", "order_id").alias("partner")
    )
    return load.upsert_scd1(dim, batch, ["customer_id"], ["partner"], "2001-08-01")


_BASKETS = """base AS (SELECT customer_id, order_date, SUM(amount) AS amount FROM orders_v GROUP BY 1, 2),
old AS (SELECT * FROM base WHERE order_date < DATE '2001-01-01'),
new AS (SELECT customer_id, order_date, amount + 1 AS amount FROM base WHERE order_date >= DATE '2000-07-01')"""


@query(
    "upsert_all",
    with_tables(
        f"""WITH {_BASKETS}
SELECT customer_id, CAST(order_date AS VARCHAR) AS order_date, CAST(amount AS DOUBLE) AS amount FROM new
UNION ALL SELECT o.customer_id, CAST(o.order_date AS VARCHAR), CAST(o.amount AS DOUBLE) FROM old o
WHERE NOT EXISTS (SELECT 1 FROM new n WHERE n.customer_id = o.customer_id AND n.order_date = o.order_date)""",
        "orders_v",
    ),
)
def upsert_all(spark, sf):
    base = R.orders_v(spark, sf).groupBy("customer_id", "order_date").agg(
        F.sum("amount").alias("amount")
    )
    tgt = base.where(F.col("order_date") < C.day("2001-01-01"))
    src = base.where(F.col("order_date") >= C.day("2000-07-01")).withColumn(
        "amount", (F.col("amount") + 1).cast("decimal(28,2)")
    )
    return load.upsert_all(tgt, src, ["customer_id", "order_date"])


@query(
    "upsert_dedup",
    with_tables(
        """WITH src AS (SELECT order_id, line_no, quantity, price FROM items_v WHERE return_flag = 'R'
  QUALIFY row_number() OVER (PARTITION BY order_id, line_no ORDER BY quantity, price) = 1),
tgt AS (SELECT order_id, line_no, quantity, price FROM items_v WHERE return_flag <> 'R'
  QUALIFY row_number() OVER (PARTITION BY order_id, line_no ORDER BY quantity, price) = 1)
SELECT order_id, line_no, quantity, CAST(price AS DOUBLE) AS price FROM src
UNION ALL SELECT order_id, line_no, quantity, CAST(price AS DOUBLE) FROM tgt t
WHERE NOT EXISTS (SELECT 1 FROM src s WHERE s.order_id = t.order_id AND s.line_no = t.line_no)""",
        "items_v",
    ),
)
def upsert_dedup(spark, sf):
    items = R.items_v(spark, sf)
    cols = ["order_id", "line_no", "quantity", "price"]
    src = items.where(F.col("return_flag") == "R").select(cols)
    tgt = keep_first(items.where(F.col("return_flag") != "R").select(cols), cols[:2], ["quantity"])
    return load.upsert_dedup(tgt, src, ["order_id", "line_no"], ["quantity"])


@query(
    "insert_missing",
    with_tables(
        """WITH tgt AS (SELECT customer_id, MIN(order_id) AS order_id FROM orders_v WHERE order_status = 'F' GROUP BY 1),
src AS (SELECT customer_id, MIN(order_id) AS order_id FROM orders_v WHERE order_status <> 'F' GROUP BY 1)
SELECT * FROM tgt UNION ALL SELECT s.* FROM src s WHERE NOT EXISTS (SELECT 1 FROM tgt t WHERE t.customer_id = s.customer_id)""",
        "orders_v",
    ),
)
def insert_missing(spark, sf):
    orders = R.orders_v(spark, sf)
    done = F.col("order_status") == "F"
    tgt = orders.where(done).groupBy("customer_id").agg(F.min("order_id").alias("order_id"))
    src = orders.where(~done).select("customer_id", "order_id")
    return load.insert_missing(tgt, src, ["customer_id"], ["order_id"])


@query(
    "update_where",
    with_tables(
        """SELECT order_id, CASE WHEN order_id IN (SELECT order_id FROM items_v WHERE return_flag = 'R')
  THEN 'returned' ELSE order_status END AS order_status, CAST(amount AS DOUBLE) AS amount FROM orders_v""",
        "orders_v", "items_v",
    ),
)
def update_where(spark, sf):
    orders = R.orders_v(spark, sf).select("order_id", "order_status", "amount")
    return load.update_where(
        orders, R.returns_v(spark, sf), ["order_id"], {"order_status": F.lit("returned")}
    )


@query(
    "upsert_ad_dimension",
    with_tables(
        """SELECT ad_id, max_by(campaign_id, event_date) AS campaign_id, CAST(MIN(event_date) AS VARCHAR) AS first_seen_date,
  CAST(MAX(event_date) AS VARCHAR) AS last_active_date, max_by(ctr, event_date) AS latest_ctr
FROM agg_ads GROUP BY 1""",
        "agg_ads",
    ),
)
def upsert_ad_dimension(spark, sf):
    daily = ads.ad_daily(ads.fact_ad_events(R.ad_raw(spark, sf)))
    attrs = {"campaign_id": "campaign_id", "latest_ctr": "ctr"}
    history = daily.where(F.col("event_date") != C.day("2024-01-20"))
    dim = load.activity_from_history(history, "ad_id", "event_date", attrs)
    late = shape.on_day(daily, "event_date", "2024-01-20")
    return load.upsert_activity(dim, late, "ad_id", "2024-01-20", attrs)


_CDC = """base AS (SELECT * FROM changes_v WHERE updated_at < TIMESTAMP '2024-01-16'
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY updated_at DESC) = 1),
tgt AS (SELECT user_id, event_id, amount, updated_at FROM base WHERE op <> 'D'),
last AS (SELECT * FROM changes_v WHERE updated_at >= TIMESTAMP '2024-01-16'
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY updated_at DESC) = 1)"""


def cdc_tables(spark, sf):
    changes, cut = R.changes_v(spark, sf), C.day(R.CDC_CUT)
    old = keep_latest(changes.where(F.col("updated_at") < cut), ["user_id"], ["updated_at"])
    tgt = old.where(F.col("op") != "D").select("user_id", "event_id", "amount", "updated_at")
    return tgt, changes.where(F.col("updated_at") >= cut)


@query(
    "latest_change",
    with_tables(
        """SELECT user_id, event_id, CAST(amount AS DOUBLE) AS amount, op,
  strftime(updated_at, '%Y-%m-%d %H:%M:%S.%f') AS updated_at FROM changes_v
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY updated_at DESC) = 1""",
        "changes_v",
    ),
)
def latest_change(spark, sf):
    last = keep_latest(R.changes_v(spark, sf), ["user_id"], ["updated_at"])
    return last.withColumn("updated_at", F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


@query(
    "apply_cdc",
    with_tables(
        f"""WITH {_CDC}
SELECT user_id, event_id, CAST(amount AS DOUBLE) AS amount, strftime(updated_at, '%Y-%m-%d %H:%M:%S.%f') AS updated_at FROM (
  SELECT * FROM tgt t WHERE NOT EXISTS (SELECT 1 FROM last l WHERE l.user_id = t.user_id)
  UNION ALL SELECT user_id, event_id, amount, updated_at FROM last WHERE op <> 'D')""",
        "changes_v",
    ),
)
def apply_cdc(spark, sf):
    tgt, batch = cdc_tables(spark, sf)
    new = load.apply_cdc(tgt, batch, ["user_id"], ["updated_at"])
    return new.withColumn("updated_at", F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


@query(
    "cdc_out_of_order",
    with_tables(
        """SELECT user_id, event_id, CAST(amount AS DOUBLE) AS amount, strftime(updated_at, '%Y-%m-%d %H:%M:%S.%f') AS updated_at
FROM (SELECT * FROM changes_v QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY updated_at DESC) = 1) WHERE op <> 'D'""",
        "changes_v",
    ),
)
def cdc_out_of_order(spark, sf):
    """The change log in three batches, the newest first and one of them twice."""
    changes = R.changes_v(spark, sf)
    time = F.col("updated_at")
    late, early = time >= C.day("2024-01-20"), time < C.day("2024-01-10")
    table = spark.createDataFrame([], changes.schema)
    for part in (late, early, ~(late | early), early):
        table = load.merge_changes(table, changes.where(part), ["user_id"], ["updated_at"])
    return load.live(table).withColumn("updated_at", F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss.SSSSSS")).select(
        "user_id", "event_id", "amount", "updated_at"
    )


@query(
    "scd1_backfill",
    with_tables(
        """SELECT customer_id, max_by(partner, (order_date, order_id)) AS partner, CAST(MIN(day) AS VARCHAR) AS first_seen_date,
  CAST(MAX(day) AS VARCHAR) AS last_updated_date
FROM (SELECT *, CAST(date_trunc('year', order_date) AS DATE) AS day FROM orders_v WHERE order_date >= DATE '1999-01-01')
GROUP BY 1""",
        "orders_v",
    ),
)
def scd1_backfill(spark, sf):
    """Three years, each its last partner, loaded in the wrong order and one of them twice."""
    orders = R.orders_v(spark, sf).withColumn("year", F.trunc("order_date", "YYYY").cast("string"))
    last = orders.groupBy("customer_id", "year").agg(F.max_by("partner", F.struct("order_date", "order_id")).alias("partner"))
    dim = spark.createDataFrame([], "customer_id bigint, partner string, first_seen_date date, last_updated_date date")
    for ds in ("2001-01-01", "1999-01-01", "2000-01-01", "1999-01-01"):
        batch = last.where(F.col("year") == ds).select("customer_id", "partner")
        dim = load.upsert_scd1(dim, batch, ["customer_id"], ["partner"], ds)
    return dim


@query(
    "snapshot_as_of",
    with_tables(
        """SELECT customer_id, tier, CAST(snapshot_date AS VARCHAR) AS snapshot_date FROM snapshots_v
WHERE snapshot_date = (SELECT MAX(snapshot_date) FROM snapshots_v WHERE snapshot_date <= DATE '1999-06-30')""",
        "snapshots_v",
    ),
)
def snapshot_as_of(spark, sf):
    return load.read_as_of(R.snapshots_v(spark, sf), "snapshot_date", "1999-06-30")


@query(
    "snapshot_append",
    with_tables(
        """SELECT product_id, stock_qty, '2001-08-01' AS snapshot_date FROM products_v
UNION ALL SELECT product_id, stock_qty + 5, '2001-08-02' FROM products_v""",
        "products_v",
    ),
)
def snapshot_append(spark, sf):
    stock = R.products_v(spark, sf).select("product_id", "stock_qty")
    first = load.snapshot(stock, "2001-08-01")
    second = load.snapshot(stock.withColumn("stock_qty", F.col("stock_qty") + 5), "2001-08-02")
    return load.replace_slice(first, second, "snapshot_date", "2001-08-02")


@query(
    "customer_daily_backfill",
    with_tables(
        """SELECT customer_id, CAST(order_date AS VARCHAR) AS order_date, COUNT(*) AS order_count,
  CAST(SUM(amount) AS DOUBLE) AS total_amount
FROM orders_v GROUP BY customer_id, order_date""",
        "orders_v",
    ),
)
def customer_daily_backfill(spark, sf):
    return order_plans.customer_daily(R.orders_v(spark, sf))


@query(
    "published_slices",
    with_tables(
        """SELECT CAST(date_trunc('month', order_date) AS DATE)::VARCHAR AS month, COUNT(*) AS n_rows,
  CAST(SUM(amount) AS DOUBLE) AS amount
FROM orders_v WHERE customer_id IS NOT NULL AND amount > 0 GROUP BY 1""",
        "orders_v",
    ),
)
def published_slices(spark, sf):
    """Whole table written in month slices, the last one replaced by a second run."""
    path = new_dir(spark, "published")
    orders = R.orders_v(spark, sf).withColumn("month", F.trunc("order_date", "MM"))
    valid = orders.where(shape.valid_order(0.0, inclusive=False))
    writers.write_slices(valid, path, "month")
    last = dt.date(2001, 7, 1)
    writers.publish(valid.where(F.col("month") == C.day(last)), path, "month", last)
    schema = valid.drop("month").schema.add("month", "date")
    return read_partitioned(spark, path, schema).groupBy("month").agg(
        F.count("*").alias("n_rows"), F.sum("amount").alias("amount")
    )


@query(
    "merge_buckets",
    with_tables(
        f"""WITH {_CDC}
SELECT user_id, event_id, CAST(amount AS DOUBLE) AS amount, strftime(updated_at, '%Y-%m-%d %H:%M:%S.%f') AS updated_at FROM (
  SELECT * FROM tgt t WHERE NOT EXISTS (SELECT 1 FROM last l WHERE l.user_id = t.user_id)
  UNION ALL SELECT user_id, event_id, amount, updated_at FROM last WHERE op <> 'D')""",
        "changes_v",
    ),
)
def merge_buckets(spark, sf):
    """Change data applied to a bucketed table on disk, twice, which must not matter, the second time with int keys."""
    path = new_dir(spark, "bucketed")
    tgt, batch = cdc_tables(spark, sf)
    writers.create_buckets(tgt, path, "user_id", 16)

    def merge(old, new):
        return load.apply_cdc(old, new, ["user_id"], ["updated_at"])

    for changes in (batch, batch.withColumn("user_id", F.col("user_id").cast("int"))):
        writers.merge_buckets(spark, path, changes, "user_id", merge, 16)
    whole = writers.read_buckets(spark, path)
    return whole.withColumn("updated_at", F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


@query(
    "evolved_buckets",
    with_tables(
        f"""WITH {_CDC}, first AS (SELECT user_id, event_id, CAST(amount AS DOUBLE) AS amount, op AS kind FROM last WHERE user_id % 2 = 0),
later AS (SELECT user_id, event_id, CAST(amount AS DOUBLE) AS amount, NULL AS kind FROM last WHERE user_id % 3 = 0)
SELECT * FROM later
UNION ALL SELECT * FROM first f WHERE NOT EXISTS (SELECT 1 FROM later l WHERE l.user_id = f.user_id)
UNION ALL SELECT user_id, event_id, CAST(amount AS DOUBLE), NULL FROM tgt t
  WHERE NOT EXISTS (SELECT 1 FROM later l WHERE l.user_id = t.user_id) AND NOT EXISTS (SELECT 1 FROM first f WHERE f.user_id = t.user_id)""",
        "changes_v",
    ),
)
def evolved_buckets(spark, sf):
    """A batch with one more column and a narrower id, then one without it, merged into a table of buckets on disk."""
    path = new_dir(spark, "evolved")
    tgt, changes = cdc_tables(spark, sf)
    last = keep_latest(changes, ["user_id"], ["updated_at"])
    writers.create_buckets(tgt.select("user_id", F.col("event_id").cast("int").alias("event_id"), "amount"), path, "user_id", 16)

    def merge(old, new):
        return load.upsert_all(old, new, ["user_id"])

    wider = last.where("user_id % 2 = 0").select("user_id", "event_id", "amount", F.col("op").alias("kind"))
    plain = last.where("user_id % 3 = 0").select("user_id", F.col("event_id").cast("int").alias("event_id"), "amount")
    for batch in (wider, plain):
        writers.merge_buckets(spark, path, batch, "user_id", merge)
    narrowed = last.select("user_id", F.col("event_id").cast("string").alias("event_id"), "amount")
    try:
        writers.merge_buckets(spark, path, narrowed, "user_id", merge)
    except SchemaDriftError:
        return writers.read_buckets(spark, path)
    raise AssertionError("a number became text without a refusal")


@query(
    "evolved_slices",
    with_tables(
        """SELECT order_id, CAST(amount AS DOUBLE) AS amount, CASE WHEN order_date >= DATE '1998-01-01' THEN partner END AS partner,
  CAST(date_trunc('year', order_date) AS DATE)::VARCHAR AS year FROM orders_v""",
        "orders_v",
    ),
)
def evolved_slices(spark, sf):
    """Years written one after the other; a column is added on the way, and old slices give NULL for it."""
    path = new_dir(spark, "slices")
    orders = R.orders_v(spark, sf).withColumn("year", F.trunc("order_date", "YEAR"))
    old = orders.where(F.col("order_date") < C.day("1998-01-01"))
    writers.write_evolving(old.select("order_id", "amount", "year"), path, "year")
    writers.write_evolving(orders.join(old.select("order_id"), "order_id", "left_anti").select("order_id", "amount", "partner", "year"), path, "year")
    return writers.read_evolving(spark, path)
