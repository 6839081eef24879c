"""Score formulas as column expressions. Numbers are fixed values of the data model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def temporal_spread(days: Column, dates: Column) -> Column:
    """By the days between first and last date: .4 without dates, .7 with one, then falling from 1."""
    return (
        F.when(dates == 0, 0.4).when(dates == 1, 0.7).when(days <= 30, 1.0).when(days <= 90, 0.85).when(days <= 180, 0.7).when(days <= 365, 0.5).otherwise(0.25)
    )


def calibrated(raw: Column, votes: Column) -> Column:
    """Logistic around .55 with a bonus of .05 a further vote up to .15, within .05 and .99."""
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-(raw - 0.55) * 6)) + F.least(F.lit(0.15), (votes - 1) * 0.05)
    return F.round(F.least(F.lit(0.99), F.greatest(F.lit(0.05), p)), 4)


def source_credibility(tier: Column, official_kind: Column, official: Column) -> Column:
    base = F.when(tier == "A", 0.9).when(tier == "B", 0.6).when(tier == "C", 0.3).when(tier == "D", 0.1).otherwise(0.15)
    return F.round(F.least(F.lit(1.0), base + F.when(official_kind, 0.2).otherwise(0.0) + F.when(official, 0.1).otherwise(0.0)), 4)


def evidence_weight(kind: Column, strength: Column, official_type: Column, official_source: Column) -> Column:
    """Class times strength, raised for official types and sources."""
    c = F.when(kind == "hard", 0.75).when(kind == "support", 0.35).when(kind == "seed", 0.12).otherwise(0.35)
    s = F.when(strength == "strong", 1.0).when(strength == "moderate", 0.7).when(strength == "weak", 0.4).otherwise(0.7)
    return c * s * F.when(official_type, 1.35).otherwise(1.0) * F.when(official_source, 1.2).otherwise(1.0)


def banded(value: Column, bands: tuple[tuple[float, str], ...], other: str) -> Column:
    """The label of the first band whose lower end the value reaches."""
    out = None
    for least, label in bands:
        out = F.when(value >= least, label) if out is None else out.when(value >= least, label)
    return out.otherwise(other)


STATUS = ((0.8, "confirmed"), (0.6, "likely_true"), (0.4, "partially_confirmed"), (0.2, "unverified"), (0.1, "likely_false"))
STRENGTH = ((0.82, "strong"), (0.74, "moderate"))
RISK = ((5, "critical"), (3, "high"), (2, "medium"))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets as arrays, to four places; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.round(F.size(F.array_intersect(a, b)) / union, 4))
