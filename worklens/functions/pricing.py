"""Rates and tiers of models."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: dollars for a million tokens: input, output, cache write, cache read
RATES = {"haiku": (0.80, 4.0, 1.00, 0.08), "sonnet": (3.00, 15.0, 3.75, 0.30), "opus": (15.00, 75.0, 18.75, 1.50)}
KINDS = ("tokens_in", "tokens_out", "cache_creation_tokens", "cache_read_tokens")


def tier_of(model: Column) -> Column:
    """haiku, opus or sonnet by the name's parts; null for other names."""
    m = F.lower(model)
    return F.when(m.contains("haiku"), "haiku").when(m.contains("opus"), "opus").when(m.contains("sonnet"), "sonnet")


def resolve_tier(model: Column) -> Column:
    """The tier that prices a model: sonnet for other names, null only without a name."""
    return F.when(model.isNotNull() & (model != ""), F.coalesce(tier_of(model), F.lit("sonnet")))


def rate(model: Column, kind: int) -> Column:
    m = F.lower(F.coalesce(model, F.lit("")))
    return F.when(m.contains("haiku"), RATES["haiku"][kind]).when(m.contains("opus"), RATES["opus"][kind]).otherwise(RATES["sonnet"][kind])


def cost(model: Column, tokens: list[Column], digits: int = 6) -> Column:
    """Dollars for the four kinds of tokens (null: 0) at the model's rate, rounded."""
    total = sum((F.coalesce(t, F.lit(0)) * rate(model, k) for k, t in enumerate(tokens)), F.lit(0.0))
    return F.round(total / 1e6, digits)
