"""A rule-based scorer of payments, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The rule table.
AMOUNT_STEPS = ((10000, 50), (5000, 30), (1000, 10))
RISKY_COUNTRIES = ("NK", "IR", "SY")
RISKY_SCORE = 50
CERTAIN_AMOUNT, CERTAIN_SCORE = 50000, 100
BLOCKED_FROM, REVIEW_FROM = 80, 50
ALERT_CHANNEL = "fraud_alerts"
RESULT_PREFIX = "fraud:"


def amount(payload: Column) -> Column:
    """Digits right after ``"amount":``, 0 if there are none."""
    return F.coalesce(F.regexp_extract(payload, '"amount":([0-9]*)', 1).try_cast("bigint"), F.lit(0))


def country(payload: Column) -> Column:
    return F.coalesce(F.regexp_extract(payload, '"country":"([^"]*)', 1), F.lit(""))


def score(amount: Column, country: Column) -> Column:
    points = F.lit(0)
    for limit, add in reversed(AMOUNT_STEPS):
        points = F.when(amount > limit, add).otherwise(points)
    points = points + F.when(country.isin(*RISKY_COUNTRIES), RISKY_SCORE).otherwise(0)
    return F.when(amount > CERTAIN_AMOUNT, CERTAIN_SCORE).otherwise(points)


def decision(score: Column) -> Column:
    return F.when(score >= BLOCKED_FROM, "BLOCKED").when(score >= REVIEW_FROM, "REVIEW").otherwise("OK")


def result(score: Column, decision: Column, amount: Column, country: Column) -> Column:
    """What the scorer stores, as JSON without escapes."""
    return F.format_string('{"score":%d,"decision":"%s","amount":%d,"country":"%s"}', score, decision, amount, country)


def alert(key: Column, score: Column, country: Column) -> Column:
    """The message that a blocked payment publishes."""
    return F.format_string("BLOCKED: %s score=%d country=%s", key, score, country)
