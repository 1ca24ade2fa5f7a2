"""Label normalisation, matching keys, parsing of short texts and message wording."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from plumbline import refdata as R


def room_key(label: Column) -> Column:
    """Lower case, runs of white space to one blank, trimmed; a missing label is '' (S10)."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(label, F.lit(""))), r"\s+", " "))


def alnum_key(label: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(label, F.lit(""))), "[^a-z0-9]+", "")


def like_any(label: Column, pattern: str) -> Column | None:
    """OR of case-insensitive substrings separated by ``|``; None when nothing is left."""
    words = [w.strip() for w in pattern.split("|") if w.strip()]
    if not words:
        return None
    return reduce(lambda a, b: a | b, [F.lower(label).contains(w.lower()) for w in words])


def expand_rooms(pattern: str) -> str:
    """Add the listed synonyms of every alternative to a room filter."""
    words: list[str] = []
    for word in (w.strip() for w in pattern.split("|")):
        for candidate in [word, *R.ROOM_SYNONYMS.get(word.lower(), [])]:
            if candidate and candidate not in words:
                words.append(candidate)
    return "|".join(words)


def plural(n: Column, one: str, many: str) -> Column:
    return F.when(n == 1, F.lit(one)).otherwise(F.lit(many))


def fixed(x: Column, digits: int) -> Column:
    """Fixed-point text, halves up."""
    scale = float(10 ** digits)
    return F.format_string(f"%.{digits}f", F.floor(x * scale + 0.5) / scale)


def whole(x: Column) -> Column:
    return F.floor(x + 0.5).cast("bigint").cast("string")


def capitalised(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substr(text, F.lit(2)))


def symbol_name(kind: Column) -> Column:
    return F.regexp_replace(kind, "^symbol:", "")


def pretty_symbol(name: Column) -> Column:
    """``single_door`` -> ``Single Door``; letters after the first stay as they are."""
    words = F.transform(F.split(name, "_"),
                        lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2))))
    return F.array_join(words, " ")


def limiter_name(key: Column) -> Column:
    expr = F.when(key == "global:per-minute", "AI calls per minute")
    for prefix, name in R.LIMITER_NAMES:
        expr = expr.when(key.startswith(prefix), name)
    return expr.otherwise(key)


def percentage(text: Column) -> Column:
    """A percentage 0..100 from ``12%``, ``12 percent`` or ``0.12``; NULL when unclear."""
    def number(pattern: str) -> Column:
        found = F.regexp_extract(text, pattern, 1)
        return F.when(found != "", found.cast("double"))

    signed = number(r"(\d+(?:\.\d+)?)\s*%")
    worded = number(r"(\d+(?:\.\d+)?)\s*(?:percent|pct)\b")
    fraction = number(r"\b(0?\.\d+)\b")
    fraction = F.when((fraction > 0) & (fraction <= 1), fraction * 100)
    value = F.coalesce(signed, worded, fraction)
    return F.when(value.isNotNull(), F.floor(F.least(value, F.lit(100.0)) * 10 + 0.5) / 10)


def sha_key(*parts: Column) -> Column:
    """SHA-256 of the parts joined by NUL (I5); absent trailing parts are skipped."""
    return F.sha2(F.concat_ws("\u0000", *parts), 256)


def csv_field(value: Column) -> Column:
    """Quote only when a quote, comma or line break is present; NULL is empty."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(text.rlike('[",\\n]'), quoted).otherwise(text)


def surface_action(change: Column, kind: Column, room: Column, paint: Column, coats: Column,
                   substrate: Column) -> Column:
    """Sentence for a single-surface edit."""
    place = F.when(room.isNull() | (room == ""), F.lit("")).otherwise(F.concat(F.lit(" in "), room))
    what = F.concat(F.lit("a "), kind, place)
    return (F.when(change == "accepted", F.concat(F.lit("Accepted "), what, F.lit(".")))
            .when(change == "excluded", F.concat(F.lit("Excluded "), what, F.lit(" from the bid.")))
            .when(F.coalesce(paint, F.lit("")) != "",
                  F.concat(F.lit("Changed paint on "), what, F.lit(" to "), paint, F.lit(".")))
            .when(coats.isNotNull(),
                  F.concat(F.lit("Changed coats on "), what, F.lit(" to "), coats.cast("string"), F.lit(".")))
            .when(F.coalesce(substrate, F.lit("")) != "",
                  F.concat(F.lit("Changed substrate on "), what, F.lit(" to "), substrate, F.lit(".")))
            .otherwise(F.concat(F.lit("Updated "), what, F.lit("."))))


def bulk_action(n: Column, status: Column, paint: Column, coats: Column) -> Column:
    """Sentence for an edit by id list."""
    count = F.concat(n.cast("string"), F.lit(" surface"), plural(n, "", "s"))
    return (F.when(status == "accepted", F.concat(F.lit("Accepted "), count, F.lit(".")))
            .when(status == "excluded", F.concat(F.lit("Excluded "), count, F.lit(" from the bid.")))
            .when(F.coalesce(paint, F.lit("")) != "",
                  F.concat(F.lit("Changed paint on "), count, F.lit(" to "), paint, F.lit(".")))
            .when(coats.isNotNull(),
                  F.concat(F.lit("Changed coats on "), count, F.lit(" to "), coats.cast("string"), F.lit(".")))
            .otherwise(F.concat(F.lit("Updated "), count, F.lit("."))))


# --- benchmark labels (S12, S13) -------------------------------------------------------------
#: fixed values: words without matching power, for scored and for yes/no matching
SCORED_STOP_WORDS = ["the", "a", "of", "to", "and", "or", "for", "in", "on", "at", "room", "area", "main",
                     "master", "suite", "no"]
FUZZY_STOP_WORDS = ["room", "area", "space", "the", "of", "at"]


def plain_label(label: Column, drop_notes: bool = True) -> Column:
    """Lower-case words of a label; notes in round or square brackets can be dropped first."""
    text = F.lower(F.coalesce(label, F.lit("")))
    if drop_notes:
        text = F.regexp_replace(text, r"\([^)]*\)|\[[^\]]*\]", "")
    return F.trim(F.regexp_replace(text, r"[^a-z0-9]+", " "))


def label_tokens(plain: Column, stop_words: list[str], min_len: int = 3) -> Column:
    words = F.split(plain, " ")
    kept = F.filter(words, lambda w: F.length(w) >= min_len)
    return F.array_distinct(F.array_except(kept, F.array(*[F.lit(w) for w in stop_words])))


def jaccard(a: Column, b: Column) -> Column:
    return F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b)))
