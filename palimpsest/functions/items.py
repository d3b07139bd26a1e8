"""Column expressions of memory items: fact keys, contents, expiry, recency and the blended score."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Policy:
    """Parameters of recall."""

    consolidation: bool = True
    supersession: bool = True
    recency: bool = True
    w_similarity: float = 1.0
    w_recency: float = 0.25
    w_importance: float = 0.1
    half_life: float = 21.0

    @property
    def label(self) -> str:
        """Its name in reports; superseding does nothing without consolidation."""
        parts = [("recency", self.recency), ("consolidation", self.consolidation), ("supersession", self.consolidation and self.supersession)]
        return "+".join(n for n, on in parts if on) or "flat-vector"


def policy_label(recency: Column, consolidation: Column, supersession: Column) -> Column:
    name = F.concat_ws("+", F.when(recency, "recency"), F.when(consolidation, "consolidation"), F.when(consolidation & supersession, "supersession"))
    return F.when(name == "", "flat-vector").otherwise(name)


def is_fact(attribute: Column) -> Column:
    """An empty attribute is no fact, like a null one."""
    return F.coalesce(attribute != "", F.lit(False))


def humanised(attribute: Column) -> Column:
    return F.replace(attribute, F.lit("_"), F.lit(" "))


def fact_content(attribute: Column, value: Column) -> Column:
    return F.concat(humanised(attribute), F.lit(": "), F.coalesce(value, F.lit("")))


def word_count(text: Column) -> Column:
    """Words between white space."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda w: w != "")).cast("long")


def expired(created_day: Column, ttl_days: Column, now: Column) -> Column:
    """Older than its time to live, strictly; never without one."""
    return F.coalesce(now - created_day > ttl_days, F.lit(False))


def recency(created_day: Column, now: Column, half_life: float | Column = 21.0) -> Column:
    """Halves every half_life days; 1 for days to come."""
    return F.pow(F.lit(0.5), F.greatest(F.lit(0), now - created_day) / half_life)


def blended(similarity: Column, created_day: Column, importance: Column, now: Column, policy: Policy = Policy()) -> Column:
    score = similarity * policy.w_similarity
    if policy.recency:
        score = score + policy.w_recency * recency(created_day, now, policy.half_life) + policy.w_importance * importance
    # What is beyond is noise of the order of summation, and would decide ties.
    return F.round(score, 12)


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda t, x: t + x)


def _let(value: Column, then) -> Column:
    """then(value), with value worked out once."""
    return F.transform(F.array(value), then)[0]


def l2_normalised(v: Column) -> Column:
    """Unit length; a vector of zeros stays."""
    scaled = lambda p: F.transform(p["v"], lambda x: x.cast("double") / F.when(p["n"] == 0, F.lit(1.0)).otherwise(p["n"]))
    return _let(v, lambda u: _let(F.struct(u.alias("v"), F.sqrt(dot(u, u)).alias("n")), scaled))
