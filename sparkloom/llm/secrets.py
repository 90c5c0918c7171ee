"""Secret scan behind a trigram inverted index, in DataFrame expressions only.

Each rule's regular expression gives a Boolean query over lower-case trigrams that every match must contain. Postings
(trigram, document) are made for the trigrams that occur in a query; a document whose postings meet a rule's query is a
candidate and only then searched. Rules without mandatory trigrams scan every text.

Spans are in code points, end exclusive, leftmost and non-overlapping for each kind.

Defined cases: a null text is empty; repeated rows have the same spans each; an empty table gives no rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm._common import TMP, durable, fenced, row_key, text_or_empty


@dataclass(frozen=True)
class SecretRule:
    """group: the group whose length counts; base: listed by base_sha256."""

    kind: str
    pattern: str
    group: int = 0
    min_chars: int = 1
    base: bool = False


RULES = (
    SecretRule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, True),
    SecretRule("access", r"AKIA[A-Z0-9]+", 0, 18, True),
    SecretRule("hex", r"[0-9a-f]{16,}", 0, 16, True),  # the same spans as of [0-9a-f]+ with 16 characters or more
    SecretRule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    SecretRule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    SecretRule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
)


def trigram_query(pattern: str):
    """A trigram, ("and", ...) or ("or", ...) that each match satisfies in lower case; None if nothing is mandatory."""

    def all_of(parts: list):
        parts = [p for p in dict.fromkeys(parts) if p is not None]
        return None if not parts else parts[0] if len(parts) == 1 else ("and", *parts)

    def walk(tree) -> object:
        parts, run = [], ""

        def end():
            nonlocal run
            parts.extend(run[i : i + 3] for i in range(len(run) - 2))
            run = ""

        for op, arg in tree:
            name = str(op)
            if name == "LITERAL" and arg < 128:
                run += chr(arg).lower()
                continue
            if name == "SUBPATTERN":
                inner = list(arg[3])
                if all(str(o) == "LITERAL" and a < 128 for o, a in inner):
                    run += "".join(chr(a).lower() for _, a in inner)
                    continue
                end()
                parts.append(walk(inner))
                continue
            end()
            if name == "BRANCH":
                options = [walk(list(x)) for x in arg[1]]
                parts.append(None if None in options else ("or", *options))
            elif name in ("MAX_REPEAT", "POSSESSIVE_REPEAT") and arg[0] > 0:
                parts.append(walk(list(arg[2])))
        end()
        return all_of(parts)

    return walk(list(re._parser.parse(pattern)))


def _trigrams(query) -> set[str]:
    return set() if query is None else {query} if isinstance(query, str) else set().union(*map(_trigrams, query[1:]))


def _holds(query, has) -> Column:
    if isinstance(query, str):
        return has(query)
    return reduce(Column.__and__ if query[0] == "and" else Column.__or__, [_holds(q, has) for q in query[1:]])


def postings(docs: DataFrame, trigrams: list[str], text_col: str, key: Column) -> DataFrame:
    """(key, trigram) for the trigrams asked for."""
    low = docs.select(key.alias("key"), F.lower(text_or_empty(text_col)).alias("low"))
    found = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in trigrams]))
    return low.select("key", F.explode(found).alias("trigram"))


def candidates(index: DataFrame, queries: dict[str, object]) -> DataFrame:
    """(key, kinds): the postings of each document, intersected by the rules' queries."""
    has = {t: f"t{i}" for i, t in enumerate(sorted(set().union(*map(_trigrams, queries.values()))))}
    sets = index.groupBy("key").agg(*[F.max(F.col("trigram") == t).alias(c) for t, c in has.items()])
    kinds = F.array_compact(F.array(*[F.when(_holds(q, lambda t: F.col(has[t])), F.lit(k)) for k, q in queries.items()]))
    return sets.select("key", kinds.alias("kinds")).where(F.size("kinds") > 0)


SPAN = "array<struct<start:int,rank:int,end:int,kind:string>>"


def _spans(text: Column, rule: SecretRule, rank: int) -> Column:
    gaps = F.transform(F.split(text, rule.pattern, -1), F.length)
    whole = F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)), F.length)
    counted = F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)), F.length)
    steps = F.transform(whole, lambda n, i: F.struct(F.get(gaps, i).alias("gap"), n.alias("n"), F.get(counted, i).alias("counted")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

    def add(acc: Column, x: Column) -> Column:
        a = acc["at"] + x["gap"]
        span = F.struct(a.alias("start"), F.lit(rank).alias("rank"), (a + x["n"]).alias("end"), F.lit(rule.kind).alias("kind"))
        return F.struct((a + x["n"]).alias("at"), F.when(x["counted"] >= rule.min_chars, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    return F.when(text.rlike(rule.pattern), F.aggregate(steps, start, add)["out"]).otherwise(F.array().cast(SPAN))


def scan(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", rules: tuple[SecretRule, ...] = RULES) -> DataFrame:
    """docs without text_col, with spans, ordered by start and then by the order of the rules."""
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    indexed = {k: q for k, q in queries.items() if q is not None}
    key = row_key(id_col, text_col)
    plain = docs.withColumn(f"{TMP}key", key).withColumn(f"{TMP}text", text_or_empty(text_col)).drop(text_col, "spans")
    text = F.col(f"{TMP}text")
    everywhere = F.concat(F.array().cast(SPAN), *[_spans(text, r, i) for i, r in enumerate(rules) if queries[r.kind] is None])
    out = fenced(plain.withColumn(f"{TMP}full", everywhere).drop(f"{TMP}text"), [f"{TMP}full"])
    if not indexed:
        return out.withColumn("spans", F.array_sort(f"{TMP}full")).drop(f"{TMP}full", f"{TMP}key")
    trigrams = sorted(set().union(*map(_trigrams, indexed.values())))
    chosen = durable(candidates(postings(docs, trigrams, text_col, key), indexed))
    hits = plain.select(f"{TMP}key", f"{TMP}text").join(chosen.withColumnRenamed("key", f"{TMP}key"), f"{TMP}key")
    own = [F.when(F.array_contains("kinds", r.kind), _spans(text, r, i)).otherwise(F.array().cast(SPAN)) for i, r in enumerate(rules) if queries[r.kind] is not None]
    found = durable(fenced(hits.select(f"{TMP}key", F.concat(*own).alias(f"{TMP}found")), [f"{TMP}found"]).where(F.size(f"{TMP}found") > 0).dropDuplicates([f"{TMP}key"]))
    both = out.join(found, f"{TMP}key", "left")
    spans = F.array_sort(F.concat(F.col(f"{TMP}full"), F.coalesce(f"{TMP}found", F.array().cast(SPAN))))
    return fenced(both.withColumn("spans", spans).drop(f"{TMP}full", f"{TMP}found", f"{TMP}key"), ["spans"])


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def op5(docs: DataFrame) -> DataFrame:
    found, base = scan(docs.select("doc_id", "text")), [r.kind for r in RULES if r.base]
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, base), F.sha2(_listed(F.filter("spans", lambda x: x["kind"].isin(base))).cast("binary"), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))
