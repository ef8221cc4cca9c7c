"""Prompt terms, slugs and human-readable formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    blank = r"[\s\x1c-\x1f\x85\p{Z}]+"
    return F.regexp_replace(text, f"^{blank}|{blank}$", "")


def prompt_segments(prompt: Column) -> Column:
    """Segments of a prompt between full stops (line ends are blanks, semicolons stops), trimmed, empty ones dropped.

    A prompt of separators alone is one segment: itself, as it is written."""
    parts = F.filter(F.transform(F.split(F.translate(prompt, "\n;", " ."), r"\."), strip), lambda s: s != "")
    return F.when(F.size(parts) > 0, parts).when(strip(prompt) != "", F.array(strip(prompt))).otherwise(parts)


def prompt_terms(prompt: Column) -> Column:
    """Lower-cased distinct segments in order."""
    return F.array_distinct(F.transform(prompt_segments(prompt), lambda s: F.lower(s)))


def norm_label(label: Column) -> Column:
    return F.trim(F.replace(F.lower(label), F.lit("_"), F.lit("-")))


def label_match(label: Column, terms: Column) -> Column:
    """True if the label equals a term; no terms match all."""
    return (F.size(terms) == 0) | F.exists(terms, lambda t: norm_label(t) == norm_label(label))


def label_slug(label: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.trim(label)), "[^a-z0-9]+", "_"), F.lit("_"))


def prompt_from_names(names: Column) -> Column:
    """Distinct names (case counts) in order, joined by full stops."""
    trimmed = F.filter(F.transform(names, lambda s: F.trim(s)), lambda s: s != "")
    return F.array_join(F.array_distinct(trimmed), ". ")


def merge_prompt(prompt: Column, names: Column) -> Column:
    """The prompt's terms and the lower-cased names that it lacks, joined by full stops."""
    more = F.transform(names, lambda s: F.lower(F.trim(s)))
    return F.array_join(F.array_distinct(F.concat(prompt_terms(prompt), F.filter(more, lambda s: s != ""))), ". ")


def fmt_bytes(n: Column) -> Column:
    x = n.cast("double")
    out = F.when(F.abs(x) < 1024, F.concat(x.cast("bigint").cast("string"), F.lit(" B")))
    for power, unit in enumerate(("KB", "MB", "GB"), 1):
        out = out.when(F.abs(x) < 1024.0 ** (power + 1), F.format_string(f"%.2f {unit}", F.bround(x / 1024.0**power, 2)))
    return F.when(n.isNull(), "—").otherwise(out.otherwise(F.format_string("%.2f TB", F.bround(x / 1024.0**4, 2))))


def one_digit(x: Column) -> Column:
    """x (0 or more) with one digit after the point: the nearest one to the double as it is, ties to the even digit, as printf has it.

    The double nearest to 12.35 is less than that, so it is 12.3. The distance from the middle of two digits is exact where it is small:
    16 x and 4 x are, and so are the differences of numbers that are near each other."""
    k = F.floor(x * 10)
    off = (x * 16 - (2 * k + 1)) + x * 4
    n = k + F.when((off > 0) | ((off == 0) & (k % 2 == 1)), 1).otherwise(0)
    return F.concat(F.floor(n / 10).cast("string"), F.lit("."), (n % 10).cast("string"))


def fmt_sec(s: Column) -> Column:
    """Seconds as text: to a tenth below a minute (`one_digit`), minutes and whole seconds (ties to even) below an hour, else hours and
    minutes; a dash for null and less than 0."""
    m = F.floor(s / 60)
    return (
        F.when(s.isNull() | (s < 0), "—")
        .when(s < 60, F.concat(one_digit(s), F.lit(" с")))
        .when(m < 60, F.format_string("%d мин %s с", m, F.bround(s - m * 60).cast("int").cast("string")))
        .otherwise(F.format_string("%d ч %d мин", F.floor(m / 60), m % 60))
    )


def fmt_ms(ms: Column) -> Column:
    return F.when(ms.isNull(), "—").when(ms < 1000, F.format_string("%.0f ms", ms)).otherwise(F.format_string("%.2f s", ms / 1000))
