"""Marts on small fixtures that hold one of each known defect."""

from __future__ import annotations

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from dayslice.plans import ads, customers, delivery, inventory, orders as order_plans, revenue

from .conftest import d, rows


@pytest.fixture(scope="module")
def shop(spark):
    data = [
        ("o1", 1, None, d("2026-06-01"), 100.0, 5.0, 0.0, 105.0, "web"),
        ("o2", 1, "F1", d("2026-06-07"), 200.0, 0.0, 50.0, 150.0, "app"),
        ("o3", 2, "F1", d("2026-06-07"), 10.0, 5.0, 40.0, 0.0, "web"),
        ("o4", 2, None, d("2026-06-07"), 30.0, 0.0, 0.0, 30.0, "web"),
    ]
    return spark.createDataFrame(
        data,
        "order_id string, customer_id int, voucher_code string, order_date date, subtotal double, "
        "shipping_fee double, discount_amount double, total_amount double, channel string",
    )


@pytest.fixture(scope="module")
def vouchers(spark):
    return spark.createDataFrame([("F1", "FLASHSALE"), ("W1", "WEEKEND")], "voucher_code string, campaign_id string")


def test_bug_orders_are_counted_but_not_summed(shop):
    got = rows(revenue.direct_revenue(shop, "2026-06-07"))
    assert got == [(d("2026-06-07"), 2, Decimal("180.00"), 1, 1)]


def test_net_revenue_is_floored_and_checked(spark):
    sales = spark.createDataFrame(
        [("p", d("2026-06-01"), 333, 3, Decimal("0.0800"), 919, d("2026-06-16")),
         ("p", d("2026-06-20"), 100, 1, Decimal("0.0500"), 96, d("2026-07-05"))],
        "partner string, order_date date, sale_price bigint, quantity_sold int, commission_rate decimal(6,4), net_revenue bigint, settlement_date date",
    )
    got = rows(revenue.marketplace_revenue(sales), "order_date", "gross_revenue", "net_revenue", "commission_cost", "mismatched_rows")
    assert got == [(d("2026-06-01"), 999, 919, 80, 0), (d("2026-06-20"), 100, 95, 5, 1)]
    assert rows(revenue.earned_vs_received(sales)) == [(d("2026-06-01"), 1015, 919), (d("2026-07-01"), 0, 96)]


def test_channels_are_combined_with_totals(spark, shop):
    market = spark.createDataFrame([(d("2026-06-07"), "p", 40)], "order_date date, partner string, net_revenue bigint")
    both = revenue.revenue_by_channel(revenue.direct_revenue(shop), market)
    totals = {(r.channel, r.partner): float(r.revenue) for r in revenue.channel_totals(both).collect()}
    assert totals[("ALL", "ALL")] == 325.0 and totals[("direct", "ALL")] == 285.0 and totals[("marketplace", "p")] == 40.0


def test_two_refunds_do_not_multiply_an_order(spark, shop):
    returns = spark.createDataFrame(
        [("o1", "refunded", 20.0), ("o1", "refunded", 30.0), ("o1", "approved", 99.0), ("o2", "pending", 5.0)],
        "order_id string, status string, refund_amount double",
    )
    net = {r.order_id: float(r.net_amount) for r in revenue.net_after_refund(shop, returns).collect()}
    assert net == {"o1": 55.0, "o2": 150.0, "o3": 0.0, "o4": 30.0}


def test_spend_discounts_and_top(shop, vouchers):
    june = revenue.avg_customer_spend(shop, "month").first()
    assert (june.customers, june.avg_spend) == (2, 142.5)
    impact = {r.campaign_id: (r.orders, float(r.discount)) for r in revenue.discount_impact(shop, vouchers).collect()}
    assert impact == {"FLASHSALE": (2, 90.0), "none": (2, 0.0)}
    assert [r.customer_id for r in revenue.top_customers(shop, 1).collect()] == [1]


def test_campaign_effect_counts_unused_campaigns(spark, shop, vouchers):
    items = spark.createDataFrame([("o2", 120.0), ("o2", 80.0), ("o3", 10.0)], "order_id string, total_price double")
    got = {r.campaign_id: (r.uses, float(r.revenue), float(r.discount_cost)) for r in customers.campaign_effect(vouchers, shop, items).collect()}
    assert got == {"FLASHSALE": (2, 210.0, 90.0), "WEEKEND": (0, 0.0, 0.0)}


@pytest.fixture(scope="module")
def shipments(spark):
    return spark.createDataFrame(
        [("o1", "ghn", "delivered", "2026-06-01 18:00:00", "2026-06-02 06:00:00", 1, None, "HN"),
         ("o2", "ghn", "failed", "2026-06-07 10:00:00", None, 3, "refused", "HN"),
         ("o3", "ghtk", "failed", "2026-06-07 10:00:00", None, 1, None, "SG")],
        "order_id string, carrier string, status string, shipped_at string, delivered_at string, "
        "delivery_attempts int, failure_reason string, recipient_province string",
    ).withColumns({c: F.col(c).cast("timestamp") for c in ("shipped_at", "delivered_at")})


def test_delivery(shop, shipments):
    rate = {(r.order_date.day, r.carrier): (r.orders, r.delivered, r.failed, r.success_rate) for r in delivery.delivery_rate(shop, shipments).collect()}
    assert rate == {(1, "ghn"): (1, 1, 0, 1.0), (7, "ghn"): (1, 0, 1, 0.0), (7, "ghtk"): (1, 0, 1, 0.0), (7, "unassigned"): (1, 0, 0, 0.0)}
    assert rows(delivery.delivery_time(shipments)) == [("ghn", 1, 12.0)]
    assert rows(delivery.redelivery_rate(shipments), "carrier", "redelivery_rate") == [("ghn", 0.5), ("ghtk", 0.0)]
    assert rows(delivery.failure_reasons(shipments)) == [("refused", 1, 0.5), ("unknown", 1, 0.5)]
    assert rows(delivery.province_failures(shipments), "recipient_province", "failure_rate") == [("HN", 0.5), ("SG", 1.0)]


def test_return_rate_counts_an_order_once(spark, shop):
    products = spark.createDataFrame([(1, "toys"), (2, "toys"), (3, "books")], "product_id int, category string")
    items = spark.createDataFrame([("o1", 1), ("o1", 2), ("o1", 3), ("o4", 1)], "order_id string, product_id int")
    returns = spark.createDataFrame([("o1",), ("o1",)], "order_id string")
    assert rows(delivery.return_rate(shop, items, returns, products)) == [
        ("books", "web", 1, 1, 1.0), ("toys", "web", 2, 1, 0.5)
    ]


def test_lifecycle_and_repeat(spark):
    history = spark.createDataFrame(
        [(1, d("2026-01-01")), (1, d("2026-01-20")), (1, d("2026-03-01")), (2, d("2026-01-01")), (2, d("2026-02-15")), (3, d("2026-03-01")), (4, d("2026-01-05")), (4, d("2026-01-05"))],
        "customer_id int, order_date date",
    )
    states = {r.customer_id: (r.state, r.orders) for r in customers.lifecycle(history, "2026-03-10", 30).collect()}
    assert states == {1: ("repeat", 3), 2: ("repeat", 2), 3: ("new", 1), 4: ("inactive", 2)}
    assert {r.state for r in customers.lifecycle(history, "2026-01-01", 30).collect()} == {"new"}
    assert rows(customers.repeat_rate(history)) == [(4, 2, 0.5)]


def test_tier_spend_and_ratings(spark, shop):
    people = spark.createDataFrame([(1, "gold"), (2, "gold"), (3, "silver")], "customer_id int, loyalty_tier string")
    got = {(r.loyalty_tier, r.spend_band): (r.customers, float(r.total_spend)) for r in customers.tier_spend(people, shop, (100,), ("low", "high")).collect()}
    assert got == {("gold", "high"): (1, 255.0), ("gold", "low"): (1, 30.0), ("silver", "low"): (1, 0.0)}
    reviews = spark.createDataFrame([("o1", 1, 5, None), ("o1", 1, 4, "ok"), ("o4", 1, 3, None)], "order_id string, product_id int, rating int, comment string")
    products = spark.createDataFrame([(1, "toys")], "product_id int, category string")
    assert rows(customers.ratings(reviews, products, shop)) == [("toys", "web", 3, 1, 4.0)]


def test_products(spark):
    products = spark.createDataFrame([(1, "a", 10.0, 12.0), (2, "a", 10.0, 8.0), (3, "a", 10.0, 9.0)], "product_id int, category string, base_price double, cost_price double")
    items = spark.createDataFrame([(2, 1, 7.0), (3, 0, 1.0), (3, 2, 9.5)], "product_id int, quantity int, sale_price double")
    assert rows(inventory.loss_making(products, items), "product_id", "is_loss_making", "is_sold_below_cost") == [
        (1, True, False), (2, False, True)
    ]
    ranked = inventory.best_slow_sellers(items, products, 1)
    assert rows(ranked, "side", "product_id", "units") == [("best", 3, 2), ("slow", 1, 0)]


def test_sell_through(spark):
    stock = spark.createDataFrame([(1, 70), (2, 5)], "product_id int, stock_qty bigint")
    sales = spark.createDataFrame([(1, d("2026-06-07"), 50), (1, d("2026-06-05"), 20), (1, d("2026-05-31"), 999)], "product_id int, sale_date date, units bigint")
    plain = {r.product_id: (r.avg_daily_units, r.days_to_stockout) for r in inventory.sell_through(stock, sales, "2026-06-07").collect()}
    assert plain == {1: (10.0, 7.0), 2: (0.0, None)}
    calm = inventory.sell_through(stock, sales, "2026-06-07", exclude=["2026-06-07"]).where("product_id = 1").first()
    assert calm.avg_daily_units == pytest.approx(20 / 6)
    with pytest.raises(ValueError):
        inventory.sell_through(stock, sales, "2026-06-07", days=1, exclude=["2026-06-07"])


def test_spike_days(spark):
    days = spark.createDataFrame([(d(f"2026-06-0{i}"),) for i in range(1, 6) for _ in range(9 if i == 5 else 3)], "order_date date")
    assert rows(inventory.daily_volume(days, 2.5).where("is_spike"), "order_date", "ratio") == [(d("2026-06-05"), 3.0)]


def test_genres(spark):
    plays = spark.createDataFrame([(1, 7, "2026-03-01 23:59:59", 90_000), (1, 8, "2026-03-01 00:00:00", 60_000), (2, 7, "2026-03-02 00:00:00", 1_000)],
                                  "track_id int, user_id int, at string, ms_played int").withColumn("played_at", F.col("at").cast("timestamp_ntz"))
    tracks = spark.createDataFrame([(1, "jazz"), (2, "rock")], "track_id int, genre string")
    one = rows(ads.genre_daily(plays, tracks, "2026-03-01"), "genre", "play_count", "unique_listeners", "minutes_played")
    assert one == [("jazz", 2, 2, 2.5)]
    assert ads.genre_daily(plays, tracks).count() == 2


def test_risk_without_building_pairs(spark):
    orders = spark.createDataFrame([("a", "done"), ("b", "open")], "order_id string, order_status string")
    items = spark.createDataFrame([("a",), ("a",), ("b",)], "order_id string")
    pays = spark.createDataFrame([("a", "credit_card", 2, 100.0), ("a", "voucher", 1, None), ("b", "x", 1, 1.0)], "order_id string, payment_type string, payment_installments int, payment_value double")
    from dayslice.functions.columns import risk_score

    pairs = order_plans.item_payment_pairs(orders, items, pays)
    plain = pairs.groupBy("order_status").agg(F.sum(risk_score("payment_type", "payment_installments", "payment_value")).alias("s"), F.count("*").alias("n"))
    got = order_plans.risk_by_status(items, orders, pays)
    assert [(s, float(t), n) for s, t, n in rows(got)] == [(s, round(t, 4), n) for s, t, n in rows(plain)]
