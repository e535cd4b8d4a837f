"""Who may see what: approved columns, masked views, row filters, and the access trail.

A policy is {"tables": [rule, ...]}; the first rule whose `user`, `schema` and `table`
patterns match decides, and no match means no access. A rule has `privileges`, and may
have `columns` ([{"name", "mask"}], a mask name or a function of the column) and `filter`
(a boolean SQL expression on the unmasked columns).
"""

from __future__ import annotations

import json
import re
from collections.abc import Collection, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import AccessDenied
from ..functions.columns import as_col, day, tier
from ..functions.privacy import MASKS, hash_text
from .dedup import keep_latest
from .load import upsert_dedup

Policy = Mapping[str, Sequence[Mapping[str, object]]]

# Tier bounds and labels of the customer analytics table.
BALANCE_BOUNDS = (50_000_000, 200_000_000)
BALANCE_LABELS = ("low", "medium", "high")
CREDIT_BOUNDS = (580, 670, 740, 800)
CREDIT_LABELS = ("poor", "fair", "good", "very_good", "excellent")


def hash_column(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """Replace a column by its hash; an absent column gives a NULL hash, so the schema is stable."""
    target = out or f"{col}_masked"
    if col not in df.columns:
        return df.withColumn(target, F.lit(None).cast("string"))
    return df.withColumn(target, hash_text(col)).drop(col)


def minimize(df: DataFrame, allowed: Collection[str], wanted: Sequence[str] | None = None) -> DataFrame:
    """Project to approved columns; asking for any other is an error."""
    cols = [c for c in df.columns if c in allowed] if wanted is None else list(wanted)
    denied = [c for c in cols if c not in allowed]
    if denied:
        raise AccessDenied(f"columns not approved: {denied}")
    return df.select(*cols)


def load_policy(text: str) -> Policy:
    """A policy from JSON; a mask that is not known or a rule without privileges is an error."""
    policy = json.loads(text)
    for rule in policy["tables"]:
        if "privileges" not in rule:
            raise ValueError(f"rule without privileges: {rule}")
        unknown = [c["mask"] for c in rule.get("columns", ()) if c["mask"] not in MASKS]
        if unknown:
            raise ValueError(f"unknown masks {unknown}; known are {sorted(MASKS)}")
    return policy


def _matches(rule: Mapping[str, object], field: str, value: str) -> bool:
    return re.fullmatch(str(rule.get(field, ".*")), value) is not None


def find_rule(policy: Policy, role: str, table: str) -> Mapping[str, object] | None:
    """First rule for a role and a `schema.table` name."""
    schema, _, name = table.rpartition(".")
    for rule in policy["tables"]:
        if _matches(rule, "user", role) and _matches(rule, "schema", schema) and _matches(rule, "table", name):
            return rule
    return None


def allowed(policy: Policy, role: str, table: str, privilege: str = "SELECT") -> Mapping[str, object]:
    """The rule that grants a privilege, or AccessDenied."""
    rule = find_rule(policy, role, table)
    if rule is None or privilege not in rule.get("privileges", ()):
        raise AccessDenied(f"{role} has no {privilege} on {table}")
    return rule


def secure_view(df: DataFrame, policy: Policy, role: str, table: str) -> DataFrame:
    """The table as a role sees it: filtered on real values, then masked.

    A later filter by the user sees masked values and filtered rows only.
    """
    rule = allowed(policy, role, table)
    rows = df.where(F.expr(str(rule["filter"]))) if rule.get("filter") else df
    masks = {str(m["name"]): m["mask"] for m in rule.get("columns", ())}
    out: list[Column] = []
    for field in df.schema.fields:
        mask = masks.get(field.name)
        if mask is None:
            out.append(F.col(field.name))
        elif callable(mask):
            out.append(mask(F.col(field.name)).alias(field.name))
        else:
            masked = MASKS[str(mask)](F.col(field.name), field.dataType.simpleString())
            out.append(masked.alias(field.name))
    return rows.select(*out)


def audit_row(
    spark: SparkSession,
    job: str,
    table: str,
    pii_columns: Sequence[str],
    record_count: int,
    ds: str,
    at: str,
) -> DataFrame:
    """One access record: names and a count, never values. The time is passed in."""
    return spark.createDataFrame(
        [("PII_ACCESS", job, table, list(pii_columns), record_count, ds, at)],
        "event string, job string, table string, pii_columns array<string>, "
        "record_count bigint, execution_date string, timestamp string",
    )


def audit_tail(log: DataFrame, n: int = 20) -> DataFrame:
    """The newest n access records."""
    return log.orderBy(F.col("timestamp").desc(), F.col("job"), F.col("table")).limit(n)


def clean_customers(bronze: DataFrame) -> DataFrame:
    """Trim names, phones and addresses and bring e-mail addresses to one spelling."""
    wanted = {
        "full_name": F.trim("full_name"),
        "email": F.lower(F.trim("email")),
        "phone": F.trim("phone"),
        "address": F.trim("address"),
    }
    return bronze.withColumns({c: e for c, e in wanted.items() if c in bronze.columns})


def customers_silver(
    bronze: DataFrame,
    silver: DataFrame | None,
    ds: str,
    key: str = "customer_id",
    order: str = "registered_at",
    ingested: str = "ingested_at",
) -> DataFrame:
    """The day's customers, cleaned and one per key, upserted into the silver table."""
    rows = clean_customers(bronze.where(F.col(ingested) == day(ds)).drop(ingested))
    batch = rows.withColumn("updated_at", day(ds))
    if silver is None:
        return keep_latest(batch, [key], [order])
    return upsert_dedup(silver, batch, [key], [order], latest=True)


def with_tiers(df: DataFrame, balance: Column | str, credit: Column | str) -> DataFrame:
    """Replace exact balance and score by tiers; unknown numbers have no tier."""
    return df.withColumns(
        {
            "balance_tier": tier(as_col(balance), BALANCE_BOUNDS, BALANCE_LABELS),
            "credit_tier": tier(as_col(credit), CREDIT_BOUNDS, CREDIT_LABELS),
        }
    )
