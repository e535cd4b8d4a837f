"""Contracts, quality suites, reconciliation, and privacy."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dayslice.functions import columns as C
from dayslice.functions import privacy
from dayslice.operators import access, contracts, load, quality, reconcile
from dayslice.operators.shape import validate_orders
from dayslice.plans import ads, orders as order_plans
from dayslice.session import materialize

from . import recipes as R
from .loads import cdc_tables
from .recipes import with_tables
from .registry import query
from .reports import channel_sides

SUITE = [
    {"expectation_type": quality.ROW_COUNT, "kwargs": {"min_value": 1}},
    {"expectation_type": quality.EXISTS, "kwargs": {"column": "order_id"}},
    {"expectation_type": quality.NOT_NULL, "kwargs": {"column": "customer_id"}},
    {"expectation_type": quality.BETWEEN, "kwargs": {"column": "amount", "min_value": 0}},
    {"expectation_type": quality.UNIQUE, "kwargs": {"column": "order_id"}},
]

_SUITE_SQL = """WITH t AS ({rows}),
c AS (SELECT COUNT(*) AS n, COUNT(*) FILTER (WHERE customer_id IS NULL) AS no_customer,
  COUNT(*) FILTER (WHERE amount < 0) AS negative, COUNT(amount) AS amounts FROM t),
u AS (SELECT COALESCE(SUM(k) FILTER (WHERE k > 1), 0) AS copies, COALESCE(SUM(k), 0) AS keyed
  FROM (SELECT COUNT(*) AS k FROM t WHERE order_id IS NOT NULL GROUP BY order_id)),
r AS (
SELECT 'expect_table_row_count_to_be_between' AS expectation, '-' AS "column", n >= 1 AS success,
  CAST(CASE WHEN n < 1 THEN 1 ELSE 0 END AS BIGINT) AS unexpected, NULL::BIGINT AS seen FROM c
UNION ALL SELECT 'expect_column_to_exist', 'order_id', TRUE, 0, NULL FROM c
UNION ALL SELECT 'expect_column_values_to_not_be_null', 'customer_id', no_customer = 0, no_customer, n FROM c
UNION ALL SELECT 'expect_column_values_to_be_between', 'amount', negative = 0, negative, amounts FROM c
UNION ALL SELECT 'expect_column_values_to_be_unique', 'order_id', copies = 0, CAST(copies AS BIGINT), CAST(keyed AS BIGINT) FROM u)
SELECT expectation, "column", success, unexpected, unexpected * 100.0::DOUBLE / seen AS unexpected_percent FROM r"""


@query(
    "quality_suite_clean",
    with_tables(_SUITE_SQL.format(rows="SELECT order_id, customer_id, amount FROM orders_v"), "orders_v"),
)
def quality_suite_clean(spark, sf):
    return quality.run_suite(R.orders_v(spark, sf), SUITE)


@query(
    "quality_suite_broken",
    with_tables(
        _SUITE_SQL.format(
            rows="""SELECT order_id, customer_id, amount FROM bronze_orders UNION ALL
SELECT order_id, customer_id, amount FROM bronze_orders WHERE order_date >= DATE '2001-01-01'"""
        ),
        "bronze_orders",
    ),
)
def quality_suite_broken(spark, sf):
    raw = R.bronze_orders(spark, sf)
    again = raw.where(F.col("order_date") >= C.day(R.ORDER_CUT))
    return quality.run_suite(raw.unionByName(again), SUITE)


@query(
    "schema_drift",
    """SELECT 'added' AS kind, 'props' AS "column", COUNT(props) AS present FROM events
UNION ALL SELECT 'retyped', 'event_id', COUNT(event_id) FROM events
UNION ALL SELECT 'missing', 'campaign_id', 0 FROM (SELECT COUNT(*) FROM events)""",
)
def schema_drift(spark, sf):
    """Drift of the events table against an older contract, with how many rows carry each column."""
    events = R.table(spark, sf, "events")
    contract = {**contracts.contract_of(events), "event_id": "string", "campaign_id": "string"}
    contract.pop("props")
    drift = contracts.check_schema(events, contract)
    found = [
        ("added", c, F.count(c)) for c in drift.added
    ] + [("retyped", c, F.count(c)) for c in drift.retyped] + [("missing", c, F.count_if(F.lit(False))) for c in drift.missing]
    counted = events.agg(*[e.alias(f"c{i}") for i, (_, _, e) in enumerate(found)])
    rows = F.array(
        *[
            F.struct(F.lit(k).alias("kind"), F.lit(c).alias("column"), F.col(f"c{i}").alias("present"))
            for i, (k, c, _) in enumerate(found)
        ]
    )
    return counted.select(F.explode(rows).alias("r")).select("r.*")


@query(
    "align_contract",
    """SELECT o_orderstatus, COUNT(*) AS n_rows, COUNT(CAST(o_orderkey AS VARCHAR)) AS keyed, 0::BIGINT AS with_note,
  CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS amount FROM orders GROUP BY 1""",
)
def align_contract(spark, sf):
    schema = T.StructType.fromDDL(
        "o_orderkey string, o_orderstatus string, o_totalprice decimal(18,2), note string"
    )
    aligned = contracts.align(R.table(spark, sf, "orders"), schema, fill_missing=True)
    return aligned.groupBy("o_orderstatus").agg(
        F.count("*").alias("n_rows"),
        F.count("o_orderkey").alias("keyed"),
        F.count("note").alias("with_note"),
        F.sum("o_totalprice").alias("amount"),
    )


def _check_sql(rows: list[tuple[str, str, str, str]]) -> str:
    return "\nUNION ALL ".join(
        f"SELECT '{n}' AS check_name, {p} AS passed, CAST({e} AS DOUBLE) AS expected, CAST({o} AS DOUBLE) AS observed FROM t"
        for n, p, e, o in rows
    )


@query(
    "recon_orders",
    with_tables(
        """WITH silver AS (SELECT * FROM bronze_orders WHERE customer_id IS NOT NULL AND amount >= 0),
fact AS (SELECT * REPLACE (CASE WHEN order_date = DATE '1998-02-04' THEN amount + 1 ELSE amount END AS amount) FROM silver WHERE order_date <> DATE '1998-02-03'),
dim AS (SELECT c_custkey AS customer_id FROM customer WHERE c_mktsegment <> 'MACHINERY'),
lost AS (SELECT COUNT(*) AS n FROM fact f WHERE NOT EXISTS (SELECT 1 FROM dim d WHERE d.customer_id = f.customer_id)),
t AS (SELECT (SELECT COUNT(*) FROM silver) AS s, (SELECT SUM(amount) FROM silver) AS a, (SELECT COUNT(*) FROM fact) AS f, (SELECT SUM(amount) FROM fact) AS b,
  (SELECT n FROM lost) AS l, (SELECT COUNT(*) FROM silver WHERE order_date <> DATE '1998-02-05') AS r,
  (SELECT COUNT(*) FROM orders_v WHERE order_date = DATE '2001-07-10') AS today,
  (SELECT COUNT(*) FROM orders_v WHERE order_date = DATE '2001-07-09') AS prior)
"""
        + _check_sql(
            [
                ("count_match", "s = f", "s", "f"),
                ("sum_match", "a = b", "a", "b"),
                ("rollup_match", "f = r", "f", "r"),
                ("unique_key", "TRUE", "f", "f"),
                ("rules_ok", "l = 0", "0", "l"),
                ("no_orphans", "l = 0", "0", "l"),
                ("dod_ok", "prior = 0 OR abs(today - prior) <= 0.5 * prior", "prior", "today"),
            ]
        ),
        "bronze_orders", "orders_v",
    ),
)
def recon_orders(spark, sf):
    """Layers built apart: the fact lost one day and changed another, the rollup lost a third, the dimension lacks a segment."""
    silver = validate_orders(R.bronze_orders(spark, sf))
    changed = F.when(F.col("order_date") == C.day("1998-02-04"), F.col("amount") + 1).otherwise(F.col("amount"))
    rows = silver.select("order_id", "customer_id", changed.cast("decimal(18,2)").alias("amount"), "order_date")
    fact = materialize(rows.where(F.col("order_date") != C.day("1998-02-03")), "fact")
    customers = R.table(spark, sf, "customer").where("c_mktsegment <> 'MACHINERY'")
    dim = customers.select(F.col("c_custkey").alias("customer_id"))
    rollup = order_plans.customer_daily(silver.where(F.col("order_date") != C.day("1998-02-05")))
    return reconcile.evaluate(
        reconcile.recon_count(silver, fact),
        reconcile.recon_sum(silver, fact, "amount"),
        reconcile.recon_rollup(fact, rollup, "order_count"),
        reconcile.check_unique(fact, ["order_id"]),
        reconcile.recon_rules(fact, dim, "customer_id", "amount"),
        reconcile.check_no_orphans(fact, dim, ["customer_id"]),
        reconcile.recon_dod(R.orders_v(spark, sf), "order_date", "2001-07-10"),
    )


@query(
    "recon_corrupted",
    with_tables(
        """WITH t AS (SELECT COUNT(*) AS s, COUNT(*) FILTER (WHERE partner <> '5-LOW') AS k, SUM(amount) AS a,
  SUM(CASE WHEN partner <> '5-LOW' THEN amount + 100 ELSE 0 END) AS b,
  COUNT(*) FILTER (WHERE partner <> '5-LOW' AND order_status = 'P') AS lost FROM orders_v)
"""
        + _check_sql(
            [
                ("count_match", "s = k", "s", "k"),
                ("sum_match", "a = b", "a", "b"),
                ("no_orphans", "lost = 0", "0", "lost"),
                ("unique_key", "s = 0", "s", "2 * s"),
                ("positive_revenue", "FALSE", "0", "0"),
                ("not_null_partner", "s = 0", "0", "s - k"),
            ]
        ),
        "orders_v",
    ),
)
def recon_corrupted(spark, sf):
    """Injected defects: each check has to fail."""
    src = R.orders_v(spark, sf)
    tgt = src.where("partner <> '5-LOW'").withColumn("amount", F.col("amount") + 100)
    dim = src.where("order_status <> 'P'").select("order_id")
    nameless = src.withColumn("partner", F.nullif("partner", F.lit("5-LOW")))
    renamed = src.withColumn("revenue", F.lit(None).cast("decimal(18,2)"))
    return reconcile.evaluate(
        reconcile.recon_count(src, tgt),
        reconcile.recon_sum(src, tgt, "amount"),
        reconcile.check_no_orphans(tgt, dim, ["order_id"]),
        reconcile.check_unique(src.unionAll(src), ["order_id"]),
        reconcile.check_positive(renamed, "revenue"),
        reconcile.check_not_null(nameless, "partner"),
    )


@query(
    "recon_ads",
    with_tables(
        """WITH t AS (SELECT
  (SELECT COUNT(*) FROM fact_ads) AS n,
  (SELECT COUNT(*) FROM fact_ads WHERE event_type = 'impression') AS i,
  (SELECT COUNT(*) FROM agg_ads WHERE clicks > impressions OR ctr > 1) AS bad)
"""
        + _check_sql(
            [
                ("unique_key", "TRUE", "n", "n"),
                ("tieout", "TRUE", "i", "i"),
                ("rules_ok", "bad = 0", "0", "bad"),
                ("source_reachable", "TRUE", "1", "1"),
                ("not_empty", "n > 0", "1", "n"),
            ]
        ),
        "fact_ads", "agg_ads",
    ),
)
def recon_ads(spark, sf):
    fact = ads.fact_ad_events(R.ad_raw(spark, sf))
    daily = ads.ad_daily(fact)
    return reconcile.evaluate(
        reconcile.check_unique(fact, ["event_id"]),
        reconcile.recon_tieout(fact, daily, "impression", "impressions"),
        reconcile.check_rules(daily, ads.ad_daily_rules()),
        reconcile.check_source(R.ad_raw(spark, sf)),
        reconcile.check_positive(fact),
    )


@query(
    "ad_rule_violations",
    with_tables(
        """SELECT COUNT(*) FILTER (WHERE clicks > impressions OR ctr > 1) AS bad_rows,
  COUNT(*) FILTER (WHERE clicks > impressions) AS clicks_over_impressions, 0::BIGINT AS negative_counts,
  COUNT(*) FILTER (WHERE ctr > 1) AS ctr_range, 0::BIGINT AS reach_over_events FROM agg_ads""",
        "agg_ads",
    ),
)
def ad_rule_violations(spark, sf):
    daily = ads.ad_daily(ads.fact_ad_events(R.ad_raw(spark, sf)))
    return reconcile.count_violations(daily, ads.ad_daily_rules())


@query(
    "recon_ad_dimension",
    with_tables(
        """WITH t AS (SELECT (SELECT COUNT(DISTINCT ad_id) FROM agg_ads) AS n,
  (SELECT COUNT(*) FROM (SELECT max_by(ctr, event_date) AS c FROM agg_ads GROUP BY ad_id) WHERE c > 1) AS bad)
"""
        + _check_sql(
            [
                ("unique_key", "TRUE", "n", "n"),
                ("date_order", "TRUE", "0", "0"),
                ("complete", "TRUE", "0", "0"),
                ("share_range", "bad = 0", "0", "bad"),
            ]
        ),
        "agg_ads",
    ),
)
def recon_ad_dimension(spark, sf):
    daily = ads.ad_daily(ads.fact_ad_events(R.ad_raw(spark, sf)))
    dim = load.activity_from_history(
        daily, "ad_id", "event_date", {"campaign_id": "campaign_id", "latest_ctr": "ctr"}
    )
    return reconcile.evaluate(*reconcile.check_activity_dim(dim, daily, "ad_id", "2024-01-31"))


@query(
    "recon_cdc",
    with_tables(
        """WITH base AS (SELECT * FROM changes_v WHERE updated_at < TIMESTAMP '2024-01-16'
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY updated_at DESC) = 1),
last AS (SELECT * FROM changes_v WHERE updated_at >= TIMESTAMP '2024-01-16'
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY updated_at DESC) = 1),
t AS (SELECT (SELECT COUNT(*) FROM base b WHERE op <> 'D' AND NOT EXISTS (SELECT 1 FROM last l WHERE l.user_id = b.user_id))
    + (SELECT COUNT(*) FROM last WHERE op <> 'D') AS n,
  (SELECT COUNT(*) FROM base b WHERE op <> 'D' AND EXISTS (SELECT 1 FROM last l WHERE l.user_id = b.user_id AND l.op = 'D')) AS dead)
"""
        + _check_sql(
            [
                ("unique_key", "TRUE", "n", "n"),
                ("no_tombstone", "TRUE", "0", "0"),
                ("tombstone_before", "dead = 0", "0", "dead"),
            ]
        ),
        "changes_v",
    ),
)
def recon_cdc(spark, sf):
    tgt, batch = cdc_tables(spark, sf)
    new = load.apply_cdc(tgt, batch, ["user_id"], ["updated_at"])
    key, order = ["user_id"], ["updated_at"]
    return reconcile.evaluate(
        reconcile.check_unique(new, key),
        reconcile.check_no_tombstone(new, batch, key, order),
        reconcile.check_no_tombstone(tgt, batch, key, order, name="tombstone_before"),
    )


@query(
    "trace_layers",
    with_tables(
        """SELECT layer, CAST(day AS VARCHAR) AS day, n_rows, n_values, CAST(total AS DOUBLE) AS total FROM (
  SELECT 'bronze' AS layer, order_date AS day, COUNT(*) AS n_rows, COUNT(amount) AS n_values, SUM(amount) AS total FROM bronze_orders GROUP BY 1, 2
  UNION ALL SELECT 'silver', order_date, COUNT(*), COUNT(amount), SUM(amount) FROM bronze_orders
  WHERE customer_id IS NOT NULL AND amount >= 0 GROUP BY 1, 2)""",
        "bronze_orders",
    ),
)
def trace_layers(spark, sf):
    bronze = R.bronze_orders(spark, sf)
    return reconcile.trace_layers({"bronze": bronze, "silver": validate_orders(bronze)}, "order_date", "amount")


@query(
    "recon_channels",
    with_tables(
        """WITH mart AS (SELECT product_id, region IN ('ASIA', 'EUROPE') AS partner, SUM(price) AS amount FROM seller_items
  WHERE NOT (region = 'EUROPE' AND return_flag = 'R') GROUP BY 1, 2),
t AS (SELECT CAST((SELECT SUM(price) FROM seller_items WHERE region NOT IN ('ASIA', 'EUROPE')) AS DECIMAL(28,2)) AS d,
  CAST((SELECT SUM(price) FROM seller_items WHERE region IN ('ASIA', 'EUROPE')) AS DECIMAL(28,2)) AS m,
  CAST((SELECT SUM(amount) FROM mart WHERE NOT partner) AS DECIMAL(28,2)) AS d2, CAST((SELECT SUM(amount) FROM mart WHERE partner) AS DECIMAL(28,2)) AS m2)
"""
        + _check_sql([("revenue_direct", "d = d2", "d", "d2"), ("revenue_marketplace", "m = m2", "m", "m2")]),
        "seller_items",
    ),
)
def recon_channels(spark, sf):
    """The marts come from their own pass over the items; the one of the marketplace has lost the returned items of one region."""
    direct, market = channel_sides(spark, sf)
    sold = R.seller_items(spark, sf).where("NOT (region = 'EUROPE' AND return_flag = 'R')")
    partner = F.col("region").isin(*R.PARTNER_REGIONS).alias("partner")
    mart = materialize(sold.groupBy("product_id", partner).agg(F.sum("price").alias("amount")), "channel-mart")
    pairs = {"direct": (direct, mart.where("NOT partner")), "marketplace": (market, mart.where("partner"))}
    return reconcile.evaluate(*reconcile.recon_channels(pairs, "amount"))


@query(
    "run_summary",
    with_tables(
        """WITH t AS (SELECT (SELECT COUNT(*) FROM orders_v) AS n, (SELECT COUNT(*) FROM items_v) AS i),
r AS ("""
        + _check_sql(
            [
                ("rows_orders", "TRUE", "n", "n"),
                ("rows_items", "TRUE", "i", "i"),
                ("not_empty", "TRUE", "1", "n"),
            ]
        )
        + """) SELECT *, '2001-08-01' AS run_date, '2001-08-01 06:30:00' AS finished_at FROM r""",
        "orders_v", "items_v",
    ),
)
def run_summary(spark, sf):
    orders = R.orders_v(spark, sf)
    counts = {"orders": orders.count(), "items": R.items_v(spark, sf).count()}
    checks = reconcile.evaluate(reconcile.check_positive(orders))
    return reconcile.run_summary(checks, counts, "2001-08-01", "2001-08-01 06:30:00")


_MASK_PHONE = r"regexp_replace(phone, '(\d{3})\d{4}(\d{3})', '\1****\2')"
_MASK_EMAIL = r"regexp_replace(email, '(^[^@]{2})[^@]+(@.+)', '\1***\2')"

POLICY = {
    "tables": [
        {"user": "admin", "privileges": ["SELECT", "INSERT"]},
        {
            "user": "analyst_asia",
            "schema": "gold",
            "table": "customers",
            "privileges": ["SELECT"],
            "filter": "region = 'ASIA'",
            "columns": [
                {"name": "phone", "mask": "phone"},
                {"name": "email", "mask": "email"},
                {"name": "cccd", "mask": "null"},
            ],
        },
        {
            "user": "analyst",
            "schema": "silver|gold",
            "table": "customers",
            "privileges": ["SELECT"],
            "columns": [
                {"name": "full_name", "mask": "null"},
                {"name": "phone", "mask": "phone"},
                {"name": "email", "mask": "email"},
                {"name": "cccd", "mask": "hash"},
                {"name": "account_balance", "mask": "null"},
            ],
        },
    ]
}


@query(
    "mask_contact",
    with_tables(f"SELECT customer_id, {_MASK_PHONE} AS phone, {_MASK_EMAIL} AS email FROM customers_v", "customers_v"),
)
def mask_contact(spark, sf):
    return R.customers_v(spark, sf).select(
        "customer_id",
        privacy.mask_phone("phone").alias("phone"),
        privacy.mask_email("email").alias("email"),
    )


@query(
    "hash_email",
    with_tables("SELECT customer_id, segment, sha256(email) AS email_masked FROM customers_v", "customers_v"),
)
def hash_email(spark, sf):
    people = R.customers_v(spark, sf).select("customer_id", "segment", "email")
    return access.hash_column(people, "email")


@query(
    "customer_tiers",
    with_tables(
        """SELECT customer_id, CASE WHEN account_balance < 50000000 THEN 'low' WHEN account_balance < 200000000 THEN 'medium' ELSE 'high' END AS balance_tier,
  CASE WHEN credit_score < 580 THEN 'poor' WHEN credit_score < 670 THEN 'fair' WHEN credit_score < 740 THEN 'good'
    WHEN credit_score < 800 THEN 'very_good' ELSE 'excellent' END AS credit_tier
FROM customers_v""",
        "customers_v",
    ),
)
def customer_tiers(spark, sf):
    tiers = access.with_tiers(R.customers_v(spark, sf), "account_balance", "credit_score")
    return access.minimize(tiers, {"customer_id", "balance_tier", "credit_tier"})


@query(
    "minimized_customers",
    with_tables("SELECT customer_id, segment, region FROM customers_v", "customers_v"),
)
def minimized_customers(spark, sf):
    return access.minimize(
        R.customers_v(spark, sf), {"customer_id", "segment", "region", "registered_at"}
    )


@query(
    "secure_view_analyst",
    with_tables(
        f"""SELECT customer_id, NULL::VARCHAR AS full_name, {_MASK_PHONE} AS phone, {_MASK_EMAIL} AS email, sha256(cccd) AS cccd,
  segment, region, NULL::DOUBLE AS account_balance FROM customers_v""",
        "customers_v",
    ),
)
def secure_view_analyst(spark, sf):
    people = R.customers_v(spark, sf).drop("credit_score", "province")
    return access.secure_view(people, POLICY, "analyst", "gold.customers")


@query(
    "secure_view_region",
    with_tables(
        f"""SELECT customer_id, full_name, {_MASK_PHONE} AS phone, {_MASK_EMAIL} AS email, NULL::VARCHAR AS cccd,
  region FROM customers_v WHERE region = 'ASIA'""",
        "customers_v",
    ),
)
def secure_view_region(spark, sf):
    people = R.customers_v(spark, sf).select("customer_id", "full_name", "phone", "email", "cccd", "region")
    return access.secure_view(people, POLICY, "analyst_asia", "gold.customers")


@query(
    "secure_view_bypass",
    with_tables("SELECT region, COUNT(*) AS in_table, CASE WHEN region = 'ASIA' THEN COUNT(*) ELSE 0 END AS in_view FROM customers_v GROUP BY 1", "customers_v"),
)
def secure_view_bypass(spark, sf):
    """A user of the regional view asks for every region of the table, one after the other, and gets rows of one only."""
    people = R.customers_v(spark, sf)
    view = access.secure_view(people, POLICY, "analyst_asia", "gold.customers")
    asked = [r["region"] for r in people.select("region").distinct().collect()]  # five by design of the data
    got = reduce(DataFrame.unionByName, [view.where(F.col("region") == r).agg(F.lit(r).alias("region"), F.count("*").alias("in_view")) for r in asked])
    return people.groupBy("region").agg(F.count("*").alias("in_table")).join(got, "region")


@query(
    "pii_audit",
    """SELECT 'PII_ACCESS' AS event, 'build_gold' AS job, 'gold.customers' AS "table", 'phone,email' AS pii_columns,
  COUNT(*) AS record_count, '2001-08-01' AS execution_date, '2001-08-01T06:00:00Z' AS "timestamp" FROM customer""",
)
def pii_audit(spark, sf):
    n = R.table(spark, sf, "customer").count()
    ds, at = "2001-08-01", "2001-08-01T06:00:00Z"
    first = access.audit_row(spark, "read_silver", "silver.customers", ["phone"], 0, ds, "2001-08-01T05:00:00Z")
    log = first.unionByName(
        access.audit_row(spark, "build_gold", "gold.customers", ["phone", "email"], n, ds, at)
    )
    return access.audit_tail(log, 1).withColumn("pii_columns", F.array_join("pii_columns", ","))


@query(
    "customers_silver",
    with_tables(
        """SELECT customer_id, lower(email) AS email, segment,
  CASE WHEN segment IN ('BUILDING', 'FURNITURE') THEN '2001-08-01' ELSE '2001-07-01' END AS updated_at FROM customers_v""",
        "customers_v",
    ),
)
def customers_silver(spark, sf):
    """Two segments arrive today, each row twice and untidy; the rest is in the silver table."""
    people = R.customers_v(spark, sf).select("customer_id", "email", "segment")
    today = people.where(F.col("segment").isin("BUILDING", "FURNITURE"))
    untidy = today.withColumn("email", F.concat(F.lit("  "), F.upper("email"), F.lit(" ")))
    batch = untidy.withColumn("registered_at", F.lit("2001-01-02").cast("timestamp_ntz")).unionByName(
        untidy.withColumn("registered_at", F.lit("2001-01-01").cast("timestamp_ntz"))
    )
    bronze = batch.withColumn("ingested_at", C.day("2001-08-01"))
    silver = people.withColumns(
        {"registered_at": F.lit(None).cast("timestamp_ntz"), "updated_at": C.day("2001-07-01")}
    )
    return access.customers_silver(bronze, silver, "2001-08-01").drop("registered_at")
