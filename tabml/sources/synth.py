"""A synthetic customers table with one column per code path of the pipeline, built from the
keys of any table (so it has as many rows as its source and is spread like it). Draws are seeded
hashes of (key, column salt): deterministic, no driver state, any size."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PLAN_TIERS = ("basic", "pro", "enterprise")
REGIONS = ("north", "south", "east", "west")


def _u(key: Column, salt: int, seed: int) -> Column:
    """Uniform [0, 1) from a 64-bit hash of (key, salt, seed)."""
    h = F.xxhash64(key, F.lit(salt), F.lit(seed))
    return F.pmod(h, F.lit(1 << 31)).cast("double") / float(1 << 31)


def _normal(key: Column, salt: int, seed: int, mu: float, sd: float) -> Column:
    """Box-Muller from two uniforms."""
    u1 = F.greatest(_u(key, salt, seed), F.lit(1e-12))
    u2 = _u(key, salt + 1000, seed)
    return F.lit(mu) + F.lit(sd) * F.sqrt(-2 * F.log(u1)) * F.cos(F.lit(2 * math.pi) * u2)


def _pick(u: Column, values: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.floor(u * len(values)) + 1).cast("int"))


def synth_customers(keys: DataFrame, key: str, seed: int = 42, leaky: bool = False) -> DataFrame:
    k = F.col(key)
    churned = F.floor(_u(k, 1, seed) * 2).cast("int")
    out = keys.select(
        k.alias("__k"), churned.alias("churned"),
        (churned * 40 + _normal(k, 2, seed, 100.0, 15.0)).alias("monthly_spend"),
        (churned * 3 + F.floor(-2.0 * F.log(F.greatest(_u(k, 3, seed), F.lit(1e-12))))).cast("int").alias("support_tickets"),
        F.when(_u(k, 4, seed) < 0.15, F.lit(None)).otherwise(F.floor(30 + _u(k, 5, seed) * 1970))
        .cast("double").alias("account_age_days"),
        _normal(k, 6, seed, 0.0, 1.0).alias("random_noise"),
        F.lit(1.0).alias("constant_flag"),
        ((churned == 1) & (_u(k, 7, seed) < 0.8)).alias("is_premium"),
        _pick(_u(k, 8, seed), PLAN_TIERS).alias("plan_tier"),
        F.when(_u(k, 9, seed) < 0.12, F.lit(None).cast("string")).otherwise(_pick(_u(k, 10, seed), REGIONS)).alias("region"),
        F.format_string("CUST-%05d", k.cast("long")).alias("customer_ref"),
        F.timestamp_add("DAY", F.floor(_u(k, 11, seed) * 1200).cast("int"),
                        F.lit("2021-01-01 00:00:00").cast("timestamp_ntz")).alias("signed_up"))
    if leaky:
        out = out.withColumn("cancellation_logged",
                             F.when(_u(F.col("__k"), 12, seed) < 0.995, F.col("churned")).otherwise(1 - F.col("churned")))
    return out.drop("__k")
