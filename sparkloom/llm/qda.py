"""Document quality by a regularised quadratic discriminant over transformed statistics of a text.

1. Each text becomes a vector of statistics of characters, words, lines and repeats, transformed so that short and long texts
   of a class lie in one cloud: counts by logarithm, shares as log(SHARE_FLOOR + k / (n + SHARE_PRIOR)). Texts are read
   once; the vectors are written to the shared folder.
2. Fitting needs only each class's count, sums and sums of products. Tasks add up their rows, Spark adds up the tasks' entries,
   and the driver gets one number for each entry of two matrices, whatever the number of labels; no row is sampled.
3. A class's covariance is shrunk towards the pooled one and then towards its own mean variance; its Cholesky factor is made once on the driver and
   sent with the model. A score is the logistic of the difference of log densities (Mahalanobis distances through the
   factors, log determinants) and log priors. The difference is divided by temperature first: statistics of one text are
   dependent, so their densities overstate the evidence.

Labels are met by their key, and nothing but the text is an input of a score: no id, language, source or label.

Defined cases: a null text counts as empty; an empty text has a score like any other; a null id is in no label's set and, as text, is
treated as empty when folds are dealt; rows without a label, or with one that is neither 0 nor 1, don't count in
the fit, and a document with several labels, or a label with several documents, counts once for each pair; if a class has no rows, the
prior of classes decides alone (0.5 for no rows at all); repeated rows are scored each; an empty table gives no rows; columns other than the id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm._common import TMP, durable

#: Words and characters that a share's denominator starts from, and what is added to a share before its logarithm.
SHARE_PRIOR, SHARE_FLOOR = 25, 0.02
#: Bytes of characters that prose seldom has.
SYMBOLS = b"#*$%&|<>^~@_=+\\{}[]"
#: Bytes of texts whose classes are counted at once.
PIECE = 4 << 20
STATISTICS = ("words", "distinct", "length", "spread", "upper", "symbols", "digits", "shouts", "stops", "commas", "lines", "lone", "echo", "distinct_lines")


@dataclass(frozen=True)
class QdaRules:
    """to_pooled: share of the pooled covariance in a class's; to_sphere: share of its mean variance on the diagonal; temperature: what
    the difference of log densities is divided by."""

    to_pooled: float = 0.1
    to_sphere: float = 0.02
    temperature: float = 4.0
    folds: int = 5


def _classes() -> np.ndarray:
    """Class of each byte: 1 upper case, 2 symbols, 3 digits, 4 exclamation and question marks, 5 stops, 6 commas and the like, 7 other letters."""
    kind = np.zeros(256, np.uint8)
    for k, chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", SYMBOLS, b"0123456789", b"!?", b".", b",;:-()\"'", bytes(range(97, 123))), 1):
        kind[list(chars)] = k
    kind[0xC2:] = 7  # first bytes of longer characters; those that go on with them don't count
    return kind


def statistics(texts: list[bytes]) -> np.ndarray:
    """A row of STATISTICS for each text in UTF-8."""
    kind = _classes()
    out = np.zeros((len(texts), len(STATISTICS)))
    share = lambda k, n: np.log(SHARE_FLOOR + k / (n + SHARE_PRIOR))
    for i, text in enumerate(texts):
        counts = np.zeros(8, np.int64)
        for a in range(0, len(text), PIECE):
            counts += np.bincount(kind[np.frombuffer(text, np.uint8, min(PIECE, len(text) - a), a)], minlength=8)
        _, upper, symbols, digits, shouts, stops, commas, lower = counts.tolist()
        letters = upper + lower
        chars = letters + symbols + digits + shouts + stops + commas
        words = text.split()
        n = len(words)
        size = np.fromiter(map(len, words), np.int64, n)
        total = int(size.sum())
        mean = (total + 5 * SHARE_PRIOR) / (n + SHARE_PRIOR)
        spread = (float(((size - mean) ** 2).sum()) + 9 * SHARE_PRIOR) / (n + SHARE_PRIOR)
        lines = text.split(b"\n")
        out[i] = (
            np.log(n + 5), np.log(len(set(words)) + 5), np.log(mean), np.log(spread), share(upper, letters), share(symbols, chars), share(digits, chars), share(shouts, chars),
            share(stops, n), share(commas, n), share(len(lines), n), share(int((size == 1).sum()), n), share(sum(map(eq, words, words[1:])), n), np.log((len(set(lines)) + 5) / (len(lines) + 5)),
        )
    return out


def with_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, x): the statistics of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = statistics([(t or "").encode() for t in batch.column(1).to_pylist()])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], [id_col, "x"])

    own = docs.select(F.col(id_col).alias(id_col), F.col(text_col).alias(f"{TMP}text"))
    return own.mapInArrow(run, f"`{id_col}` {own.schema[id_col].dataType.simpleString()}, x array<double>")


@dataclass(frozen=True)
class Model:
    """mean, factor (lower Cholesky factor of the covariance) and log determinant of the classes 0 and 1; log odds of their priors."""

    mean: tuple[np.ndarray, np.ndarray]
    factor: tuple[np.ndarray, np.ndarray]
    log_det: tuple[float, float]
    log_odds: float
    temperature: float

    def score(self, x: np.ndarray) -> np.ndarray:
        density = []
        for m, f, d in zip(self.mean, self.factor, self.log_det):
            z = np.linalg.solve(f, (x - m).T)
            density.append(-0.5 * ((z * z).sum(axis=0) + d))
        odds = (density[1] - density[0]) / self.temperature + self.log_odds
        return 1 / (1 + np.exp(-np.clip(odds, -700, 700)))


def moments(labelled: DataFrame, label: str = "label") -> dict[int, tuple[int, np.ndarray, np.ndarray]]:
    """Count, sums and sums of products of x in each class 0 and 1 of labelled (x, label)."""
    k = len(STATISTICS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, k + 1, k + 1))
        for batch in batches:
            x = np.asarray(batch.column(0).flatten()).reshape(-1, k)
            x = np.hstack([np.ones((len(x), 1)), x])
            y = batch.column(1).to_numpy(zero_copy_only=False)
            for c in (0, 1):
                sums[c] += x[y == c].T @ x[y == c]
        at = np.arange(sums.size)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(sums.ravel())], ["at", "v"])

    parts = labelled.where(F.col(label).isin(0, 1)).select("x", F.col(label).cast("int").alias("y")).mapInArrow(run, "at int, v double")
    total = np.zeros(2 * (k + 1) ** 2)
    for r in parts.groupBy("at").agg(F.sum("v").alias("v")).collect():  # 450 rows
        total[r["at"]] = r["v"]
    total = total.reshape(2, k + 1, k + 1)
    return {c: (round(total[c, 0, 0]), total[c, 0, 1:], total[c, 1:, 1:]) for c in (0, 1)}


def model_of(sums: dict[int, tuple[int, np.ndarray, np.ndarray]], rules: QdaRules = QdaRules()) -> Model:
    k = len(STATISTICS)
    n = {c: sums[c][0] for c in (0, 1)}
    odds = float(np.log((n[1] + 1) / (n[0] + 1)))
    if not (n[0] and n[1]):  # the classes' priors decide
        zero, one = np.zeros(k), np.eye(k)
        return Model((zero, zero), (one, one), (0.0, 0.0), odds, rules.temperature)
    mean = {c: sums[c][1] / n[c] for c in (0, 1)}
    scatter = {c: sums[c][2] - n[c] * np.outer(mean[c], mean[c]) for c in (0, 1)}
    pooled = (scatter[0] + scatter[1]) / (n[0] + n[1])
    factor, log_det = [], []
    for c in (0, 1):
        own = (1 - rules.to_pooled) * scatter[c] / n[c] + rules.to_pooled * pooled
        own = (1 - rules.to_sphere) * own + rules.to_sphere * max(np.trace(own) / k, 1e-6) * np.eye(k)
        f = np.linalg.cholesky((own + own.T) / 2)
        factor.append(f)
        log_det.append(2 * float(np.log(np.diag(f)).sum()))
    return Model((mean[0], mean[1]), (factor[0], factor[1]), (log_det[0], log_det[1]), odds, rules.temperature)


def remainder(id_col: str, folds: int) -> Column:
    """The fold of a row: crc32 of its id as text, modulo folds."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds


def fit(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", rules: QdaRules = QdaRules()) -> Model:
    """The model of all rows of stats (with_statistics) that have a label, but those of fold 0."""
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & (remainder(id_col, rules.folds) != 0))
    known = known.select(id_col, F.col(label_col).alias("label"))
    return model_of(moments(stats.join(known, id_col)), rules)


def scored(stats: DataFrame, model: Model, id_col: str = "doc_id") -> DataFrame:
    """(id, score) of stats."""
    k = len(STATISTICS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch.column(1).flatten()).reshape(-1, k)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x))], [id_col, "score"])

    return stats.select(id_col, "x").mapInArrow(run, f"`{id_col}` {stats.schema[id_col].dataType.simpleString()}, score double")


def op13(docs: DataFrame, labels: DataFrame, rules: QdaRules = QdaRules()) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    stats = durable(with_statistics(docs))
    out = scored(stats, fit(stats, labels, rules=rules))
    return out.select("doc_id", (remainder("doc_id", rules.folds) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
