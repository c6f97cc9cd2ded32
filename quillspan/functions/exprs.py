"""Column expressions: ratios with stated null rules, outcome rules, text helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Retention bounds of the historical response use (fixed values).
DIRECT, SURFACE, TRANSFORMATIVE = 0.90, 0.60, 0.15
#: Windows in milliseconds (fixed values).
PRE_MS = POST_MS = 30_000
RECONSULT_MS = 60_000

#: Spellings of the five request outcomes (fixed values).
OUTCOMES = ("accept_unchanged", "accepted_modified", "non_adoption", "presented_no_selection", "request_without_suggestion")
STATES = ("direct_adoption", "modified_adoption", "non_adoption")
#: Further spellings of the outcomes (fixed values).
SPELLINGS = {
    "direct_adoption": "accept_unchanged",
    "accepted_unchanged": "accept_unchanged",
    "modified_adoption": "accepted_modified",
    "accept_modified": "accepted_modified",
    "no_selection": "presented_no_selection",
    "no_suggestion": "request_without_suggestion",
    "request_without_presented_suggestion": "request_without_suggestion",
}
#: What stands for a missing number in text (fixed values).
MISSING = ("", "None", "none", "nan", "NaN", "NA", "N/A", "null")
#: Names for readers (fixed values).
STATE_LABELS = {"direct_adoption": "Direct Adoption", "modified_adoption": "Modified Adoption", "non_adoption": "Non-Adoption"}
OUTCOME_LABELS = {"accept_unchanged": "Direct Adoption", "accepted_modified": "Modified Adoption", "non_adoption": "Non-Adoption", "presented_no_selection": "No Selection", "request_without_suggestion": "No Suggestion"}
INDICATOR_LABELS = {
    "human_generation_before_ai": "Human Generation Before AI",
    "consultation_density": "Consultation Density",
    "ai_contribution": "AI Contribution",
    "ai_retention": "AI Retention",
    "non_adoption": "Non-Adoption",
    "post_ai_editing": "Post-AI Editing",
    "reconsultation": "Reconsultation",
    "response_latency": "Response Latency",
    "transition_entropy": "Transition Entropy",
    "consultation_burstiness": "Consultation Burstiness",
}


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def safe_ratio(num: Column | str, den: Column | str) -> Column:
    """0.0 where the denominator is not positive (session metrics)."""
    return F.when(_c(den) > 0, _c(num) / _c(den)).otherwise(F.lit(0.0))


def ratio(num: Column | str, den: Column | str) -> Column:
    """Null where a side is null or the denominator is not positive (features)."""
    return F.when(_c(num).isNotNull() & (_c(den) > 0), _c(num) / _c(den))


def log1p(x: Column | str) -> Column:
    return F.when(_c(x) >= 0, F.log1p(_c(x)))


def strip(x: Column | str) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(F.regexp_replace(_c(x), r"(?U)^\s+", ""), r"(?U)\s+$", "")


def finite(x: Column | str) -> Column:
    """Null for NaN and infinite numbers."""
    return F.when(~F.isnan(_c(x)) & (F.abs(_c(x)) != float("inf")), _c(x))


def optional_double(x: Column | str, missing: tuple[str, ...] = MISSING, *, stripped: bool = True, checked: bool = True) -> Column:
    """Text to double. What stands for a missing number, and NaN and infinite numbers, are null; other text fails the job.

    The readers of the tables differ in what stands for a missing number (`missing`), the
    oldest one neither strips nor looks at the value (stripped, checked).
    """
    text = strip(_c(x).cast("string")) if stripped else _c(x).cast("string")
    value = text.cast("double")
    return F.when(~text.isin(*missing), finite(value) if checked else value)


def optional_int(x: Column | str) -> Column:
    """Text to a whole number, by way of double (cut, not rounded); what stands for a missing number is null."""
    return optional_double(x, MISSING[:5] + MISSING[7:]).cast("long")


def required(x: Column, field: str) -> Column:
    """The value; a null one fails the job."""
    return F.when(x.isNull(), F.raise_error(F.lit(f"{field} is missing"))).otherwise(x)


def normalized_outcome(x: Column | str) -> Column:
    """One of the five outcomes from any of its spellings, whatever their case, hyphens or spaces; another word fails the job."""
    word = F.regexp_replace(F.lower(strip(x)), "[- ]", "_")
    known = F.create_map(*[F.lit(w) for pair in ({o: o for o in OUTCOMES} | SPELLINGS).items() for w in pair])
    return F.when(_c(x).isNull() | known[word].isNull(), F.raise_error(F.concat(F.lit("unknown request outcome "), F.coalesce(_c(x), F.lit("null"))))).otherwise(known[word])


def labelled(x: Column | str, names: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(w) for pair in names.items() for w in pair])[_c(x)]


def adoption(inserted: Column | str, surviving: Column | str, contiguous: Column | str) -> Column:
    """Three-way outcome of a selection from its final provenance."""
    ins, sur = _c(inserted), _c(surviving)
    return F.when((ins <= 0) | (sur <= 0), STATES[2]).when((ins == sur) & _c(contiguous), STATES[0]).otherwise(STATES[1])


def response_use(opened: Column, inserted: Column, retention: Column) -> Column:
    r = F.coalesce(retention, F.lit(0.0))
    return (
        F.when(~opened, "No Suggestion").when(~inserted, "Non-Adoption").when(r >= DIRECT, "Direct Retention")
        .when(r >= SURFACE, "Surface Revision").when(r >= TRANSFORMATIVE, "Transformative Revision").otherwise("Withdrawal")
    )


def share_group(x: Column | str, low: Column, high: Column) -> Column:
    return F.when(_c(x) <= low, "Low").when(_c(x) <= high, "Moderate").otherwise("High")


def phase(index: Column | str, n: Column | str) -> Column:
    """early, middle or late by place (from 0) among n."""
    i, m = _c(index), _c(n) - 1
    return F.when(3 * i <= m, "early").when(3 * i <= 2 * m, "middle").otherwise("late")
