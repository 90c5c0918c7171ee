"""Rules that are data: predicates, delegations and the choice of a threshold."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """holds: SQL over the table's columns, or a Column. A null verdict fails the rule."""

    name: str
    holds: str | Column
    severity: str = "high"


def evaluate(df: DataFrame, rules: list[Rule], keep: list[str]) -> DataFrame:
    """(keep..., rule, severity, holds), a row for each row and rule, in one scan."""
    verdicts = [F.struct(F.lit(r.name).alias("rule"), F.lit(r.severity).alias("severity"), F.coalesce(F.expr(r.holds) if isinstance(r.holds, str) else r.holds, F.lit(False)).alias("holds")) for r in rules]
    return df.select(*keep, F.inline(F.array(*verdicts)))


def delegate(chain: DataFrame, delegations: DataFrame, registry: DataFrame, approver: str = "approver", at: str = "at") -> DataFrame:
    """chain with acting: the delegate of the first rule (pos, approver, delegate, until) of its approver that is not over at `at` and whose
    delegate is in registry (id), else the approver. An approver's rules are put into one array, so a row of chain stays one."""
    known = delegations.join(registry.select(F.col("id").alias("delegate")).distinct(), "delegate", "left_semi")
    own = known.groupBy(F.col("approver").alias(approver)).agg(F.sort_array(F.collect_list(F.struct("pos", "delegate", "until"))).alias("__rules"))
    valid = lambda r: r["until"].isNull() | (r["until"] >= F.col(at))
    first = F.get(F.filter("__rules", valid), F.lit(0))["delegate"]
    return chain.join(own, approver, "left").withColumn("acting", F.coalesce(first, F.col(approver))).drop("__rules")


def tune_threshold(samples: DataFrame, similarity: str, correct: str, least: int = 100, default: float = 0.95) -> DataFrame:
    """One row (recommended, f1, n, note): the similarity, to two decimals, from which on answers have the best F1; of ties the
    highest. Fewer samples than least give no recommendation, samples of which none is correct give 1. Similarities are counted by
    bucket first, so what is ranked has as many rows as there are buckets."""
    counts = samples.where(F.col(similarity).isNotNull()).groupBy(F.bround(F.col(similarity), 2).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(correct)).alias("good"))
    above, whole = W.orderBy(F.desc("bucket")), W.partitionBy()
    hits, right = F.sum("n").over(above), F.sum("good").over(above)
    scored = counts.select("bucket", "n", "good", F.sum("good").over(whole).alias("total"), F.when(right > 0, 2 * right / (hits + F.sum("good").over(whole))).otherwise(0.0).alias("f1"))
    best = scored.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.max("total").alias("total"), F.max(F.struct("f1", "bucket")).alias("b"))
    few, none = F.col("n") < least, F.col("total") == 0
    return best.select(
        F.when(few, None).when(none, 1.0).when(F.col("b.f1") > 0, F.col("b.bucket")).otherwise(default).alias("recommended"),
        F.when(few, None).when(none, 0.0).otherwise(F.round("b.f1", 9)).alias("f1"),
        "n",
        F.when(few, F.lit(f"fewer than {least} samples")).when(none, "no sample is correct").alias("note"),
    )


def within_limit(df: DataFrame, limit: int) -> DataFrame:
    """df, or an error if it has more rows than limit; nothing is cut off. The rows are counted up to the limit only."""
    if df.limit(limit + 1).count() > limit:
        raise RuntimeError(f"more than {limit} rows")
    return df


def multi_get(values: DataFrame, keys: DataFrame, key: str, most: int = 100_000) -> DataFrame:
    """A row for each of keys with its columns of values, null where there are none. More than most keys are refused."""
    return within_limit(keys, most).join(values, key, "left")


def matching(must: dict[str, object]) -> Column:
    """Whether a row meets all conditions: a column's value, one of a list, or (least, most) with None for no bound; None is null. No
    conditions are met by all."""
    out = F.lit(True)
    for name, want in must.items():
        c = F.col(name)
        if want is None:
            one = c.isNull()
        elif isinstance(want, (list, set, frozenset)):
            one = c.isin(list(want))
        elif isinstance(want, tuple):
            least, most = want
            one = (F.lit(True) if least is None else c >= least) & (F.lit(True) if most is None else c <= most)
        else:
            one = c == want
        out = out & F.coalesce(one, F.lit(False))
    return out
