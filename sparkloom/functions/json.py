"""JSON text: repair of damaged records, and checks of parameters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: An escaped surrogate: first a whole pair, which is kept as group 1, else one that stands alone, high or low.
_HEX = "[0-9a-fA-F]{2}"
SURROGATE = rf"(\\u[dD][89abAB]{_HEX}\\u[dD][c-fC-F]{_HEX})|\\u[dD][89a-fA-F]{_HEX}"


def repair(text: Column) -> Column:
    """text without escaped surrogates that have no partner and, unless it ends with }, with what is open closed: a string, then all brackets, then all
    braces. It closes by number, not by nesting, so the result need not be valid; json_valid tells."""
    t = F.regexp_replace(text, SURROGATE, "$1")
    count = lambda c: F.length(t) - F.length(F.replace(t, F.lit(c), F.lit("")))
    quote = F.when(count('"') % 2 == 1, F.lit('"')).otherwise(F.lit(""))
    open_of = lambda a, b: F.greatest(count(a) - count(b), F.lit(0))
    closed = F.concat(t, quote, F.repeat(F.lit("]"), open_of("[", "]")), F.repeat(F.lit("}"), open_of("{", "}")))
    return F.when(F.rlike(t, F.lit(r"\}\s*$")), t).otherwise(closed)


def json_valid(text: Column) -> Column:
    return F.try_parse_json(text).isNotNull()


@dataclass(frozen=True)
class Param:
    """kind: string, integer, number, boolean, array or object; any other kind isn't checked."""

    name: str
    kind: str
    required: bool = False
    choices: tuple[str, ...] = ()


#: Beginnings of the names that schema_of_variant gives to each kind.
KINDS = {"string": ("STRING",), "integer": ("BIGINT",), "number": ("BIGINT", "DOUBLE", "DECIMAL", "FLOAT"), "boolean": ("BOOLEAN",), "array": ("ARRAY",), "object": ("OBJECT",)}


def first_error(text: Column, params: list[Param]) -> Column:
    """The first parameter in order that is missing, of another kind, or none of its choices; null if all is well. A JSON null is there
    but of no kind. Text that isn't JSON has no parameters."""
    v = F.try_parse_json(text)
    error = F.lit(None).cast("string")
    for p in reversed(params):
        value = F.try_variant_get(v, f"$.{p.name}", "variant")
        kind = F.schema_of_variant(value)
        fits = F.lit(False)
        for k in KINDS.get(p.kind, ()):
            fits = fits | F.startswith(kind, F.lit(k))
        here = F.when(value.isNull(), F.lit(f"missing {p.name}") if p.required else error)
        if p.kind in KINDS:
            here = here.when(~fits, F.lit(f"{p.name} is no {p.kind}"))
        if p.choices:
            here = here.when(~F.try_variant_get(v, f"$.{p.name}", "string").isin(*p.choices), F.lit(f"{p.name} is none of its choices"))
        error = here.otherwise(error)
    return error


def checked_record(text: Column) -> dict[str, Column]:
    """Of a conversation's record in JSON its first error (no object, id is missing, messages is no list; null for none), and how many messages it
    has and how many are sound: objects with a role and a text. A list among sound parts is kept whatever the rest is."""
    value = F.try_parse_json(text)
    kind = F.schema_of_variant(value)
    whole = F.startswith(kind, F.lit("OBJECT"))
    listed = F.try_variant_get(value, "$.messages", "array<variant>")
    own = F.when(whole, F.coalesce(listed, F.array().cast("array<variant>"))).otherwise(F.array().cast("array<variant>"))
    part = lambda m, name: F.try_variant_get(m, f"$.{name}", "string").isNotNull()
    sound = F.filter(own, lambda m: part(m, "role") & part(m, "text"))
    missing = F.try_variant_get(value, "$.id", "string").isNull()
    error = F.when(~F.coalesce(whole, F.lit(False)), "no object").when(missing, "id is missing").when(listed.isNull(), "messages is no list")
    return {"error": error, "n_messages": F.size(own).cast("long"), "n_kept": F.size(sound).cast("long")}
