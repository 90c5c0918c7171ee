"""Rules of a service desk as columns: cache times of tools, intents, skills, waiting times, service levels, worker choice and recovery. What they
weigh is a parameter."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# They must be those that users of the platform have.
TOOL_POLICIES = {
    "get_stock_price": "no_cache", "get_account_balance": "no_cache", "check_service_status": "no_cache",
    "get_weather": "short_ttl", "get_exchange_rate": "short_ttl", "list_active_orders": "short_ttl",
    "search_products": "medium_ttl", "get_user_preferences": "medium_ttl", "list_team_members": "medium_ttl",
    "get_company_info": "long_ttl", "get_product_details": "long_ttl", "get_documentation": "long_ttl",
    "get_country_codes": "until_invalidated", "get_timezone_info": "until_invalidated", "get_schema_definition": "until_invalidated",
}
POLICY_SECONDS = {"no_cache": 0, "short_ttl": 45, "medium_ttl": 600, "long_ttl": 14_400, "until_invalidated": 31_536_000}
INTENT_AGENTS = {
    "order_status": "order", "order_modification": "order", "return_refund": "order", "technical_support": "technical", "billing_inquiry": "billing",
    "billing_dispute": "billing", "account_management": "billing", "general_inquiry": "triage", "complaint": "escalation", "feedback": "triage",
}
WAITS = {"critical": "Less than 1 minute", "urgent": "1-2 minutes", "high": "2-5 minutes", "normal": "5-10 minutes", "low": "10-15 minutes"}
# End of fixed values.


def looked_up(key: Column, table: dict, default=None) -> Column:
    """The value of key in a small table, else default."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), F.lit(default))


def tool_ttl(tool: Column, policies: dict[str, str] = TOOL_POLICIES, seconds: dict[str, int] = POLICY_SECONDS, default: str = "no_cache") -> Column:
    """Seconds that a tool's result may be kept. An unknown tool has the policy default."""
    return looked_up(looked_up(tool, policies, default), seconds)


def adaptive_ttl(accesses: Column, invalidations: Column, age: Column, base: float = 3600.0, least: float = 30.0, most: float = 86_400.0, young: float = 60.0) -> Column:
    """Seconds by use: up to twice base for many accesses an hour, down to a quarter for invalidations, within least and most. An entry
    younger than young seconds, or without an age, has base."""
    per_hour = lambda n: n / age * 3600
    longer = F.least(F.lit(2.0), 1 + per_hour(accesses) / 100)
    shorter = F.greatest(F.lit(0.25), 1 - per_hour(invalidations) * 0.5)
    clamped = F.greatest(F.lit(least), F.least(F.lit(most), base * longer * shorter))
    return F.when(age >= young, clamped).otherwise(F.lit(base))


def agent(intent: Column) -> Column:
    return looked_up(intent, INTENT_AGENTS, "triage")


def wait_time(priority: Column) -> Column:
    return looked_up(priority, WAITS, WAITS["normal"])


def skills(intent: Column, tier: Column, sentiment: Column, low: float = -0.5) -> Column:
    """Array of the skills that a transfer needs, in a fixed order; general_support if there is none."""
    has = lambda *words: F.greatest(*[F.coalesce(F.contains(intent, F.lit(w)), F.lit(False)) for w in words], F.lit(False))
    each = [
        F.when(has("billing", "payment"), "billing_specialist"), F.when(has("technical"), "technical_specialist"), F.when(has("order"), "order_specialist"),
        F.when(tier == "enterprise", "enterprise_support"), F.when(sentiment < low, "de_escalation"),
    ]
    found = F.filter(F.array(*each), lambda s: s.isNotNull())
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("general_support")))


@dataclass(frozen=True)
class ServiceLevel:
    first_response_ms: float = 30_000
    handle_seconds: float = 480
    automation: float = 70.0
    escalation: float = 15.0
    tool_failures: float = 0.1


def service_level(first_response_ms: Column, handle_seconds: Column, automation: Column, escalation: Column, config: ServiceLevel = ServiceLevel()) -> dict[str, Column]:
    """Which levels are met: rates are percentages; times must be below, rates at the limit or better."""
    return {"first_response": first_response_ms < config.first_response_ms, "resolution_rate": automation >= config.automation, "escalation_rate": escalation <= config.escalation, "handle_time": handle_seconds < config.handle_seconds}


def advice(met: dict[str, Column], failing: Column) -> Column:
    """Array of what to do: for each unmet level but the handling time, and for each name in the array failing."""
    texts = {"first_response": "scale triage", "resolution_rate": "review escalation reasons", "escalation_rate": "train for escalations"}
    own = F.filter(F.array(*[F.when(~met[k], F.lit(v)) for k, v in texts.items()]), lambda x: x.isNotNull())
    return F.concat(own, F.transform(failing, lambda t: F.concat(F.lit("review "), t)))


def worker_load(connections: Column, weight: Column) -> Column:
    """Connections by capacity: the least is the one to choose."""
    return connections / F.greatest(weight, F.lit(1e-9))


def weighted_load(connections: Column, weight: Column, mean_ms: Column) -> Column:
    """The same with one connection more, and slower workers dearer; without a latency a worker counts as instant."""
    return worker_load(connections + 1, weight) * (1 + F.coalesce(mean_ms, F.lit(0.0)) / 1000)


def recovery(attempts: Column, checkpoint: Column, intact: Column, backup: Column, most: int = 3) -> dict[str, Column]:
    """What becomes of an interrupted task: recovered, resume (its checkpoint, the backup of a broken one, or null to start anew), data_loss and error."""
    tired = attempts >= most
    broken = checkpoint.isNotNull() & ~F.coalesce(intact, F.lit(False))
    lost = tired | (broken & backup.isNull())
    error = F.when(tired, "attempts exceeded").when(lost, "checkpoint corrupted, no backup")
    return {"recovered": ~lost, "resume": F.when(~lost, F.when(broken, backup).otherwise(checkpoint)), "data_loss": lost, "error": error}
