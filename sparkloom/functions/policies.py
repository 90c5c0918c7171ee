"""Policies and scores as columns; what they weigh is a parameter."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F


def _clamped(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), x))


@dataclass(frozen=True)
class TtlPolicy:
    """Of keys that begin with prefix. deterministic: only answers at temperature 0 are kept, others for no time at all."""

    prefix: str
    seconds: int
    deterministic: bool = False


#: The usual policies: embeddings 30 days, answers of a model a day, tools ten minutes.
TTL_POLICIES = (TtlPolicy("emb:", 2_592_000), TtlPolicy("llm:", 86_400, True), TtlPolicy("tool:", 600))


def ttl(key: Column, temperature: Column | None = None, policies: tuple[TtlPolicy, ...] = TTL_POLICIES, default: int = 3600) -> Column:
    """Seconds by the first policy whose prefix the key has. A null temperature is 0."""
    out = F.lit(default)
    warm = F.lit(False) if temperature is None else F.coalesce(temperature, F.lit(0.0)) != 0
    for p in reversed(policies):
        own = F.when(warm, F.lit(0)).otherwise(F.lit(p.seconds)) if p.deterministic else F.lit(p.seconds)
        out = F.when(F.startswith(key, F.lit(p.prefix)), own).otherwise(out)
    return out


def stale(key: Column, cached_version: Column, current: Column) -> Column:
    """Whether a cached entry is older than its namespace; a missing version is 0."""
    return F.coalesce(cached_version, F.lit(0)) < F.coalesce(current, F.lit(0))


def namespace(key: Column) -> Column:
    """What stands before the first colon, or default."""
    return F.when(F.contains(key, F.lit(":")), F.substring_index(key, ":", 1)).otherwise(F.lit("default"))


@dataclass(frozen=True)
class RiskPolicy:
    """The defaults are fixed values, as scores of the platform have them."""

    high_amount: float = 100_000.0
    high_amount_score: int = 30
    some_amount: float = 25_000.0
    some_amount_score: int = 15
    issue_score: int = 25
    vendor_score: int = 20
    urgent_score: int = 10
    high: int = 50
    medium: int = 25


def risk_score(amount: Column, high_issues: Column, risky_vendors: Column, urgent: Column, policy: RiskPolicy = RiskPolicy()) -> Column:
    """0 to 100: by amount, for each issue of high severity, for each item of a risky vendor, and for urgency."""
    by_amount = F.when(amount > policy.high_amount, policy.high_amount_score).when(amount > policy.some_amount, policy.some_amount_score).otherwise(0)
    return F.least(F.lit(100).cast("long"), by_amount + policy.issue_score * high_issues + policy.vendor_score * risky_vendors + F.when(urgent, policy.urgent_score).otherwise(0))


def risk_level(score: Column, policy: RiskPolicy = RiskPolicy()) -> Column:
    return F.when(score >= policy.high, "high").when(score >= policy.medium, "medium").otherwise("low")


#: Fixed patterns of what matters in a message, and of what doesn't.
IMPORTANT = (r"(?i)important", r"(?i)remember", r"(?i)critical", r"(?i)must\s+(?:have|do|be)", r"(?i)requirement")
TRIVIAL = (r"(?i)^(ok|okay|thanks|thank you|got it)\.?$", r"(?i)^(yes|no|sure)\.?$")


def importance(text: Column, tokens: Column, tool_calls: Column, referenced: Column, high: tuple[str, ...] = IMPORTANT, low: tuple[str, ...] = TRIVIAL) -> Column:
    """0 to 1: 0.5, and 0.2 more for each high pattern, 0.3 less for each low one, 0.15 more for tool calls, 0.1 for over 100 tokens and
    0.25 if a later message refers to it."""
    add = lambda c, x: F.when(c, F.lit(x)).otherwise(F.lit(0.0))
    score = F.lit(0.5) + add(tool_calls, 0.15) + add(tokens > 100, 0.1) + add(referenced, 0.25)
    for p in high:
        score = score + add(F.rlike(text, F.lit(p)), 0.2)
    for p in low:
        score = score - add(F.rlike(text, F.lit(p)), 0.3)
    return _clamped(score, 0, 1)


@dataclass(frozen=True)
class QualityPolicy:
    """Weights of the dimensions, and what a phrase costs. The defaults are fixed values, as scores of the platform have them."""

    weights: dict = field(default_factory=lambda: {"resolution": 0.30, "response": 0.25, "efficiency": 0.15, "sentiment": 0.15, "compliance": 0.15})
    prohibited: dict = field(default_factory=lambda: {"i promise": 10, "definitely": 10, "always": 10, "never fails": 10})
    card_cost: int = 50


def has_card_number(text: Column) -> Column:
    """A word of 13 to 16 digits that passes the Luhn check."""
    return F.exists(F.regexp_extract_all(text, F.lit(r"\b[0-9]{13,16}\b"), F.lit(0)), lambda x: F.call_function("luhn_check", x))


def compliance_cost(text: Column, policy: QualityPolicy = QualityPolicy()) -> Column:
    """What a message costs of a conversation's 100 points."""
    cost = F.when(has_card_number(text), policy.card_cost).otherwise(0)
    for phrase, n in policy.prohibited.items():
        cost = cost + F.when(F.contains(F.lower(text), F.lit(phrase)), n).otherwise(0)
    return cost


def quality(resolved: Column, escalated: Column, transfers: Column, seconds: Column, messages: Column, sentiment: Column, cost: Column, response: Column | None = None, policy: QualityPolicy = QualityPolicy()) -> Column:
    """0 to 100. response: points of the answers' quality by a model, 50 where there are none; sentiment: -1 to 1."""
    points = lambda x: F.greatest(F.lit(0.0), F.lit(100.0) - x)
    by = {
        "resolution": points(F.when(escalated, 30).otherwise(0) + F.when(resolved, 0).otherwise(50) + 10 * F.greatest(F.lit(0), transfers - 2)),
        "response": F.lit(50.0) if response is None else F.coalesce(response, F.lit(50.0)),
        "efficiency": points(F.when(seconds > 600, 20).otherwise(0) + F.when(seconds > 900, 20).otherwise(0) + F.least(F.lit(100), 2 * F.greatest(F.lit(0), messages - 15))),
        "sentiment": (sentiment + 1) * 50,
        "compliance": points(cost),
    }
    return sum((F.lit(policy.weights[k]) * v for k, v in by.items()), F.lit(0.0))
