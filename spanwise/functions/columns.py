"""Column expressions built from Spark's own functions: codes, ages, combinations, statistics."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Race codes of the demographics feed.
RACE_LABELS = {"01": "White", "02": "Black or African American", "04": "Asian or Pacific Islander", "06": "Some Other Race", "09": "Unknown", "11": "Hispanic or Latino"}
# Lower bounds and names of the age buckets above the first.
AGE_BUCKETS = [(25, "25-34"), (35, "35-44"), (45, "45-54"), (55, "55-64"), (65, "65-74"), (75, "75+")]
YOUNGEST = "18-24"
# Ingredient names that mark a product as an opioid.
OPIOID_TERMS = ("morphine", "oxycodone", "hydrocodone", "hydromorphone", "oxymorphone", "codeine", "fentanyl", "tapentadol", "tramadol", "meperidine", "methadone", "buprenorphine", "butorphanol", "nalbuphine", "pentazocine", "levorphanol", "opium", "dihydrocodeine")


def zero_filled(code: Column, width: int = 11) -> Column:
    """Left-padded with zeros; longer codes stay whole (lpad alone would cut them)."""
    return F.when(F.length(code) < width, F.lpad(code, width, "0")).otherwise(code)


def ndc11(code: Column) -> Column:
    """An NDC written 4-4-2, 5-3-2, 5-4-1 or 5-4-2 as eleven digits (5-4-2); eleven digits stay; anything else is null."""
    part = F.split(code, "-")
    fits = code.rlike(r"^(\d{4,5}-\d{4}-\d{2}|\d{5}-\d{3}-\d{2}|\d{5}-\d{4}-\d)$")
    joined = F.concat(F.lpad(part[0], 5, "0"), F.lpad(part[1], 4, "0"), F.lpad(part[2], 2, "0"))
    return F.when(fits, joined).when(code.rlike(r"^\d{11}$"), code)


def starts_with_any(code: Column, prefixes: Iterable[str]) -> Column:
    """LIKE-prefix test against a short list; dots and a trailing % in the list are dropped."""
    return reduce(or_, (code.startswith(p.replace(".", "").removesuffix("%")) for p in prefixes), F.lit(False))


def code_cluster(code: Column) -> Column:
    """Three-character cluster of an ICD-10 code: upper case, letters and digits only; null unless it has the shape of one."""
    clean = F.regexp_replace(F.upper(code), "[^0-9A-Z]", "")
    return F.when(clean.rlike("^[A-Z][0-9A-Z]{2,6}$"), F.substring(clean, 1, 3))


def letter_and_digits(code: Column) -> Column:
    """The leading letter and two digits of a code, else null."""
    return F.nullif(F.regexp_extract(code, r"^([A-Za-z]\d{2})", 1), F.lit(""))


def age_bucket(age: Column) -> Column:
    out = F.when(age >= AGE_BUCKETS[-1][0], AGE_BUCKETS[-1][1])
    for least, name in reversed(AGE_BUCKETS[:-1]):
        out = out.when(age >= least, name)
    return out.when(age.isNotNull(), YOUNGEST)


def race_label(code: Column) -> Column:
    pairs = [x for k, v in RACE_LABELS.items() for x in (F.lit(k), F.lit(v))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), code), F.lit("Other/Unmapped"))


def shortened(name: Column, most: int = 40) -> Column:
    return F.when(F.length(name) > most, F.concat(F.substring(name, 1, most - 3), F.lit("..."))).otherwise(name)


def has_term(names: Column, terms: Iterable[str] = OPIOID_TERMS) -> Column:
    """Does any string of the array hold one of the terms, whatever its case?"""
    return F.coalesce(F.exists(names, lambda x: F.lower(x).rlike("|".join(terms))), F.lit(False))


def pairs_of(items: Column) -> Column:
    """Unordered pairs of an array's elements, in the array's order."""
    return F.flatten(F.transform(items, lambda x, i: F.transform(F.slice(items, i + 2, F.size(items)), lambda y: F.struct(x.alias("item1"), y.alias("item2")))))


def trios_of(items: Column) -> Column:
    """Unordered trios of an array's elements, in the array's order."""

    def with_third(x: Column, i: Column) -> Column:
        rest = F.slice(items, i + 2, F.size(items))
        return F.flatten(F.transform(rest, lambda y, j: F.transform(F.slice(rest, j + 2, F.size(rest)), lambda z: F.struct(x.alias("item1"), y.alias("item2"), z.alias("item3")))))

    return F.flatten(F.transform(items, with_third))


def chi_square(a: Column, b: Column, c: Column, d: Column) -> Column:
    """2x2 chi-square with Yates' correction; null when a margin is empty."""
    a, b, c, d = (x.cast("double") for x in (a, b, c, d))
    n = a + b + c + d
    off = F.greatest(F.abs(a * d - b * c) - n / 2, F.lit(0.0))
    margins = (a + b) * (c + d) * (a + c) * (b + d)
    return F.when(margins > 0, n * off * off / margins)


# The published Chebyshev coefficients for erfc (relative error below 1.2e-7).
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def erfc(z: Column) -> Column:
    """Complementary error function of z >= 0."""
    t = 1 / (1 + z / 2)
    tail = F.lit(ERFC[-1])
    for c in reversed(ERFC[:-1]):
        tail = F.lit(c) + t * tail
    return t * F.exp(-z * z + tail)


def chi_square_p(chi2: Column) -> Column:
    """Upper tail with one degree of freedom; 1 for null."""
    return F.coalesce(erfc(F.sqrt(chi2 / 2)), F.lit(1.0))

