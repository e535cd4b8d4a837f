"""Ad events: fact, daily metrics, campaign roll-ups and their alerts."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import count_if, day, half_up, safe_ratio, total
from ..operators.dedup import keep_first
from ..operators.shape import in_domain, normalize_ids, on_day, select_known
from ..sources.readers import date_series

ID_COLUMNS = ("event_id", "ad_id", "campaign_id", "user_id")
KNOWN_COLUMNS = (*ID_COLUMNS, "event_type", "event_ts", "device_type", "cost_micros")
EVENT_TYPES = ("impression", "click")


def fact_ad_events(raw: DataFrame, ds: str | dt.date | None = None) -> DataFrame:
    """Silver fact: known event types, text ids, one row per event (the earliest), typed date."""
    typed = normalize_ids(in_domain(raw, "event_type", EVENT_TYPES), ID_COLUMNS)
    dated = typed.withColumn("event_date", F.col("event_ts").cast("date"))
    known = select_known(dated, KNOWN_COLUMNS, ["event_date"])
    sliced = known if ds is None else on_day(known, "event_date", ds)
    return keep_first(sliced, ["event_id"], ["event_ts"])


def ad_daily(
    fact: DataFrame, ds: str | dt.date | None = None, approx: bool = False
) -> DataFrame:
    """Impressions, clicks, reach and click rate per ad and day.

    `approx` swaps the exact reach for a sketch, which removes the shuffle on user ids.
    """
    rows = fact if ds is None else on_day(fact, "event_date", ds)
    reach = F.approx_count_distinct("user_id", 0.01) if approx else F.count_distinct("user_id")
    return (
        rows.groupBy("event_date", "ad_id", "campaign_id")
        .agg(
            count_if(F.col("event_type") == "impression").alias("impressions"),
            count_if(F.col("event_type") == "click").alias("clicks"),
            reach.alias("unique_users"),
        )
        .withColumn("ctr", safe_ratio("clicks", "impressions"))
    )


#: 2^14 registers: a standard error of 0.8 % of the reach.
SKETCH_SIZE = 14


def reach_sketches(fact: DataFrame, ds: str | dt.date | None = None, by: Sequence[str] = ("ad_id",)) -> DataFrame:
    """One mergeable sketch of the users for each day and ad; store it as a slice, like `ad_daily`."""
    rows = fact if ds is None else on_day(fact, "event_date", ds)
    return rows.groupBy("event_date", *by).agg(F.hll_sketch_agg("user_id", F.lit(SKETCH_SIZE)).alias("users"))


def reach(sketches: DataFrame, lo: str | dt.date, hi: str | dt.date, by: Sequence[str] = ("ad_id",)) -> DataFrame:
    """Users reached from lo to hi, both included, from stored sketches alone; `days` are those with a sketch.

    Days overlap in their users, so daily reach cannot be added up; sketches can be united without reading an event again.
    """
    inside = sketches.where(F.col("event_date").between(day(lo), day(hi)))
    return inside.groupBy(*by).agg(
        F.hll_sketch_estimate(F.hll_union_agg("users")).alias("reach"), F.count_distinct("event_date").cast("bigint").alias("days")
    )


def missing_days(sketches: DataFrame, lo: str | dt.date, hi: str | dt.date) -> DataFrame:
    """Days from lo to hi for which no sketch is stored: a reach over them would be too low."""
    wanted = date_series(sketches.sparkSession, lo, hi, "event_date")
    return wanted.join(sketches.select("event_date").distinct(), "event_date", "left_anti")


def ad_daily_rules() -> dict[str, Column]:
    """Conditions every row of `ad_daily` meets."""
    shown, clicked = F.col("impressions"), F.col("clicks")
    return {
        "clicks_over_impressions": clicked <= shown,
        "negative_counts": (shown >= 0) & (clicked >= 0),
        "ctr_range": F.col("ctr").between(0.0, 1.0),
        "reach_over_events": F.col("unique_users") <= shown + clicked,
    }


def campaign_metrics(events: DataFrame, by: tuple[str, ...] = ("campaign",)) -> DataFrame:
    """One row per campaign from one row per impression; some impressions were clicked."""
    return (
        events.groupBy(*by)
        .agg(
            F.count("*").alias("impressions"),
            count_if(F.col("is_click")).alias("clicks"),
            total("cost_usd").alias("spend_usd"),
        )
        .withColumn("ctr", safe_ratio("clicks", "impressions"))
    )


def _names_where(flag: Column) -> Column:
    """Sorted campaign names; one row per campaign and date goes in, so the list is short."""
    return F.array_sort(F.collect_list(F.when(flag, F.col("campaign"))))


def over_budget(metrics: DataFrame, budget: float, ds: str | None = None, by: str = "date") -> DataFrame:
    """Per date: total spend and the campaigns above the daily budget."""
    dated = metrics if ds is None else metrics.withColumn(by, day(ds))
    names = _names_where(F.col("spend_usd") > F.lit(budget).cast("decimal(18,2)"))
    return dated.groupBy(by).agg(
        F.sum("spend_usd").cast("double").alias("total_spend_usd"),
        names.alias("over_budget_campaigns"),
    ).withColumn("budget_usd", F.lit(float(budget)))


def low_ctr(metrics: DataFrame, min_ctr: float, ds: str | None = None, by: str = "date") -> DataFrame:
    """Per date: campaigns with a click rate below the threshold, and what they cost."""
    dated = metrics if ds is None else metrics.withColumn(by, day(ds))
    low = F.col("ctr") < F.lit(min_ctr)
    names = _names_where(low)
    wasted = F.coalesce(F.sum(F.when(low, F.col("spend_usd"))), F.lit(0))
    return dated.groupBy(by).agg(
        names.alias("low_ctr_campaigns"), wasted.cast("double").alias("wasted_spend_usd")
    ).withColumn("min_ctr", F.lit(float(min_ctr)))


def genre_daily(plays: DataFrame, tracks: DataFrame, ds: str | dt.date | None = None) -> DataFrame:
    """Plays, listeners and minutes per day and genre."""
    dated = plays.withColumn("dt", F.col("played_at").cast("date"))
    rows = dated if ds is None else plays.where(
        (F.col("played_at") >= day(ds)) & (F.col("played_at") < F.date_add(day(ds), 1))
    ).withColumn("dt", day(ds))
    return rows.join(tracks.select("track_id", "genre"), "track_id").groupBy("dt", "genre").agg(
        F.count("*").alias("play_count"),
        F.count_distinct("user_id").alias("unique_listeners"),
        half_up(F.sum("ms_played") / 60000.0, 2).alias("minutes_played"),
    )
