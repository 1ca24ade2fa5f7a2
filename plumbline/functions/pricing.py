"""Column expressions for quantities, labor and material."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from plumbline import refdata as R


def lookup(key: Column, table: dict, default=None) -> Column:
    """A small constant dictionary as a ``when`` chain, so it stays inside codegen."""
    expr = reduce(lambda acc, kv: F.when(key == kv[0], F.lit(kv[1])) if acc is None
                  else acc.when(key == kv[0], F.lit(kv[1])), table.items(), None)
    return expr if default is None else expr.otherwise(F.lit(default))


def half_up(x: Column, digits: int = 0) -> Column:
    """Round halves toward plus infinity (-2.5 -> -2), unlike ``round``."""
    scale = float(10 ** digits)
    return F.floor(x * scale + 0.5) / scale


def unit_for(kind: Column) -> Column:
    return (F.when(kind == "trim", "lf").when(kind.isin("door", "window"), "ea").otherwise("sqft"))


def complexity(**flags: bool) -> float:
    return reduce(lambda m, name: m * R.COMPLEXITY[name], [n for n, on in flags.items() if on], 1.0)


def production_rate(kind: Column, **flags: bool) -> Column:
    """Units per hour; NULL for an unpriced type, which later yields zero hours."""
    return lookup(kind, R.PRODUCTION_RATES) / F.lit(complexity(**flags))


def coverage(substrate: Column) -> Column:
    """Square feet per gallon: the first listed word contained in the substrate decides."""
    text = F.lower(substrate)
    expr = F.when(substrate.isNull() | (substrate == ""), F.lit(R.BASE_COVERAGE))
    for word, divisor in R.SUBSTRATE_COVERAGE:
        expr = expr.when(text.contains(word), F.lit(R.BASE_COVERAGE / divisor))
    return expr.otherwise(F.lit(R.BASE_COVERAGE))


def mode_factor(mode: Column) -> Column:
    return lookup(F.coalesce(mode, F.lit("net")), R.MODE_FACTOR, 1.0)


def quantity(kind: Column, sqft: Column, lf: Column, count: Column, mode: Column) -> Column:
    unit = unit_for(kind)
    return (F.when(unit == "sqft", F.coalesce(sqft, F.lit(0.0)) * mode_factor(mode))
            .when(unit == "lf", F.coalesce(lf, F.lit(0.0)))
            .otherwise(F.coalesce(count.cast("double"), F.lit(1.0))))


def labor_hours(qty: Column, coats: Column, rate: Column) -> Column:
    return F.when(rate > 0, qty * coats / rate).otherwise(F.lit(0.0))


def labor_cost(hours: Column, hourly: Column, burden: float = R.BURDEN) -> Column:
    return hours * hourly * F.lit(1 + burden)


def with_waste(gallons: Column, waste: Column) -> Column:
    return gallons * (F.lit(1.0) + waste)


def gallons(kind: Column, qty: Column, coats: Column, substrate: Column, waste: Column) -> Column:
    unit = unit_for(kind)
    painted = qty * coats
    raw = (F.when(unit == "sqft", painted / coverage(substrate))
           .when(unit == "lf", painted / F.lit(R.TRIM_LF_PER_GALLON))
           .otherwise(painted * F.lit(R.GALLONS_PER_OPENING)))
    return with_waste(raw, waste)


def billable(status: Column, kind: Column, finish: Column) -> Column:
    """Rows that reach the bid."""
    counted_only = kind.startswith("annotation:") | kind.startswith("symbol:")
    paint_scope = F.coalesce(finish, F.lit("paint")).isin(R.PAINTABLE_FINISHES)
    return (status != "excluded") & ~counted_only & ((kind != "wall-path") | paint_scope)


def token_cost(model: Column, tokens_in: Column, tokens_out: Column,
               cache_read: Column | None = None, cache_write: Column | None = None) -> Column:
    """Dollars for one call; cache tokens are billed on top of the plain input tokens."""
    parts = [(tokens_in, 0), (tokens_out, 1), (cache_read, 2), (cache_write, 3)]
    total = F.lit(0.0)
    for tokens, slot in parts:
        if tokens is None:
            continue
        price = lookup(model, {m: p[slot] for m, p in R.PRICES.items()}, 0.0)
        total = total + F.coalesce(tokens, F.lit(0)) / F.lit(1_000_000.0) * price
    return total


def stored_input_tokens(tokens_in: Column, cache_read: Column, cache_write: Column) -> Column:
    return tokens_in + F.coalesce(cache_read, F.lit(0)) + F.coalesce(cache_write, F.lit(0))


def wall_height(basis: Column, ceiling_ft: Column, custom_ft: Column) -> Column:
    """Height preset in feet (S35); measured area is length times this."""
    return (F.when(basis == "ceiling", ceiling_ft).when(basis == "13ft", F.lit(13.0))
            .when(basis == "deck", F.lit(16.0)).otherwise(custom_ft))


def confidence_band(confidence: Column) -> Column:
    return F.when(confidence >= 0.8, "high").when(confidence >= 0.6, "medium").otherwise("low")


def percent_error(measured: Column, truth: Column) -> Column:
    return F.try_divide((measured - truth) * 100.0, truth)
