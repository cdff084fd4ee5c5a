"""Quality by a sparse ensemble of rules over text statistics, evaluated as Spark columns."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import fresh, lean, sized, small_batches
from ._text import mix

SAMPLE = 8_000  #: labelled documents that the model is fitted on: those with the least hash of their ids
TREES = 24  #: boosted trees that give the rules
LEVELS = 3  #: conditions in a rule at most
BINS = 32  #: thresholds tried for each statistic
PENALTY = 0.002  #: lasso penalty, for a mean loss
CUT = 0.5  #: least probability of good quality that is accepted
STATISTICS = ("log_chars", "log_words", "word_length", "symbols", "bangs", "bars", "digits", "shouted", "lines", "distinct_words", "distinct_lines")


_SPACES = tuple(map(ord, " \t\n\x0b\f\r"))
_SYMBOLS = tuple(map(ord, "#$%&*@^~<>{}\\"))
_CODES = 0x110000


@cache
def _tables() -> np.ndarray:
    """For every character whether it is white space, a symbol, a digit or an upper-case letter, as bits."""
    kind = np.zeros(_CODES, dtype=np.uint8)
    kind[list(_SPACES)] |= 1
    kind[list(_SYMBOLS)] |= 2
    kind[48:58] |= 4
    kind[[c for c in range(_CODES) if unicodedata.category(chr(c)) == "Lu"]] |= 8
    return kind


def _distinct(codes: np.ndarray, apart: np.ndarray, off: np.ndarray) -> np.ndarray:
    """For each text the number of distinct runs of characters that aren't ``apart``, by 64-bit hashes."""
    n = len(codes)
    inside = ~apart
    begins = inside.copy()
    begins[1:] &= apart[:-1]
    first = off[:-1][off[:-1] < n]
    begins[first] = inside[first]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.zeros(len(off) - 1, np.int64)
    at = np.arange(n) - starts[np.maximum(np.cumsum(begins) - 1, 0)]
    with np.errstate(over="ignore"):
        part = np.cumprod(np.full(int(at.max()) + 1, 0x100000001B3, dtype=np.uint64))[np.maximum(at, 0)] * (codes.astype(np.uint64) + np.uint64(1))
        part[apart] = 0
        doc = np.searchsorted(off, starts, side="right") - 1
        key = mix(np.add.reduceat(part, starts)) + mix(doc.astype(np.uint64) + np.uint64(1))
    return np.bincount(doc[np.unique(key, return_index=True)[1]], minlength=len(off) - 1)


def statistics(texts: pa.Array) -> np.ndarray:
    """(texts x STATISTICS) of whole texts; null counts as empty. Words are what white space parts, as a split does:
    an empty one before or after it counts."""
    strings = [t or "" for t in texts.to_pylist()]
    off = np.concatenate([[0], np.cumsum([len(t) for t in strings])]).astype(np.int64)
    codes = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    kind = _tables()[codes]
    total = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[off])
    n, some = np.diff(off), np.flatnonzero(np.diff(off))
    head = np.zeros(len(codes), dtype=bool)
    head[off[:-1][some]] = True
    space, upper, line = (kind & 1).astype(bool), (kind & 8).astype(bool), codes == 10
    runs = lambda mask: mask & (head | ~np.concatenate([[False], mask[:-1]]))
    size, words, lines = np.maximum(n, 1), total(runs(space)) + 1, total(line) + 1
    second = upper & ~runs(upper) & np.concatenate([[False], runs(upper)[:-1]])  # a run's second letter
    edge = np.zeros(len(n), dtype=bool)
    edge[some] = space[off[:-1][some]] | space[off[1:][some] - 1]
    distinct = _distinct(codes, space, off) + (edge | (n == 0))
    empty = np.ones(len(n), dtype=bool)  # whether a line is empty: at an end, or two line breaks together
    pair = line & (head | np.concatenate([[False], line[:-1]]))
    last = np.zeros(len(n), dtype=bool)
    last[some] = line[off[1:][some] - 1]
    empty[some] = (total(pair)[some] > 0) | last[some]
    lines_distinct = _distinct(codes, line, off) + empty
    values = [np.log1p(n), np.log1p(words), size / words, total(kind & 2 > 0) / size, total(codes == 33) / size, total(codes == 124) / size, total(kind & 4 > 0) / size, total(second) / words, lines / words, distinct / words, lines_distinct / lines]
    return np.column_stack(values)


def _statistics_column(text: Column) -> Column:
    """The statistics as a struct, by one pass over the text. It is marked so that it is evaluated once for each row
    and not copied into every condition of the rules."""

    def batches(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for a in arrays:
            parts = [statistics(b.column(0)) for b in sized(iter([pa.record_batch([a], names=["text"])]), "text")]
            x = np.concatenate(parts) if parts else np.zeros((0, len(STATISTICS)))
            yield pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(c)) for c in x.T], names=list(STATISTICS))

    def run(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from lean(batches)(arrays)

    return F.arrow_udf(run, ", ".join(f"{n} double" for n in STATISTICS)).asNondeterministic()(text)


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, threshold, whether above) with its weight."""

    conditions: tuple[tuple[int, float, bool], ...]
    weight: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        return np.all([(x[:, f] > t) == above for f, t, above in self.conditions], axis=0)


@dataclass(frozen=True)
class Model:
    rules: tuple[Rule, ...]
    bias: float

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.bias - sum((r.weight * r.holds(x) for r in self.rules), np.zeros(len(x)))))

    def column(self, stats: Column) -> Column:
        """The probability as a column over the struct ``stats``."""
        z = F.lit(float(self.bias))
        for r in self.rules:
            held = F.lit(True)
            for f, t, above in r.conditions:
                value = stats[STATISTICS[f]]
                held = held & (value > F.lit(t) if above else value <= F.lit(t))
            z = z + F.when(held, F.lit(r.weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def _grow(x: np.ndarray, cuts: list[np.ndarray], grad: np.ndarray, hess: np.ndarray, rows: np.ndarray, path: tuple, found: list) -> np.ndarray:
    """A regression tree on gradients; appends the path of every node below the root to ``found`` and gives
    the step of each row."""
    step = np.zeros(len(x))
    best = (1e-9, -1, 0.0)
    g, h = grad[rows].sum(), hess[rows].sum()
    if len(path) < LEVELS and len(rows) >= 20:
        for f in range(x.shape[1]):
            if not len(cuts[f]):
                continue
            at = np.searchsorted(cuts[f], x[rows, f], side="left")
            gl = np.cumsum(np.bincount(at, weights=grad[rows], minlength=len(cuts[f]) + 1))[:-1]
            hl = np.cumsum(np.bincount(at, weights=hess[rows], minlength=len(cuts[f]) + 1))[:-1]
            nl = np.cumsum(np.bincount(at, minlength=len(cuts[f]) + 1))[:-1]
            gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1)
            gain[(nl < 10) | (len(rows) - nl < 10)] = 0
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (float(gain[k]), f, float(cuts[f][k]))
    if best[1] < 0:
        step[rows] = -g / (h + 1)
        return step
    _, f, t = best
    for above in (False, True):
        own = path + ((f, t, above),)
        found.append(own)
        step += _grow(x, cuts, grad, hess, rows[(x[rows, f] > t) == above], own, found)
    return step


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Boosted trees give the candidate rules; a logistic lasso by accelerated proximal gradient picks and
    weighs them. One class only, no rows, or too few of them for a split, gives no rules."""
    good = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
    base = float(np.log(good / (1 - good)))
    if len(np.unique(y)) < 2:
        return Model((), base)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    z, paths = np.full(len(y), base), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-z))
        z += 0.3 * _grow(x, cuts, p - y, p * (1 - p), np.arange(len(y)), (), paths)
    paths = list(dict.fromkeys(paths))
    if not paths:
        return Model((), base)
    a = np.column_stack([Rule(p, 0.0).holds(x) for p in paths]).astype(float)
    w, bias = np.zeros(a.shape[1]), base
    v, vb, momentum = w.copy(), bias, 1.0
    rate = 4 * len(y) / (np.linalg.norm(a, 2) ** 2 + len(y))
    for _ in range(400):
        err = (1 / (1 + np.exp(-(a @ v + vb))) - y) / len(y)
        new = v - rate * (a.T @ err)
        new = np.sign(new) * np.maximum(np.abs(new) - rate * PENALTY, 0)
        new_bias = vb - rate * err.sum()
        after = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        v, vb = new + (momentum - 1) / after * (new - w), new_bias + (momentum - 1) / after * (new_bias - bias)
        w, bias, momentum = new, new_bias, after
    return Model(tuple(Rule(p, float(c)) for p, c in zip(paths, w) if c), float(bias))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Fit on at most SAMPLE labelled documents, a documented bound: the rows of ``labels`` with the least hash
    of their ids (of repeated ids the best label, and the text with the least hash). Null ids, labels and texts
    are left out; other columns don't matter; no rows, or labels of one class, give a model without rules. What
    comes to the driver is one row of statistics for each of them, however long the texts are."""
    chosen = labels.select(F.col(id_col).alias("i"), F.col(label_col).alias("y")).where("i is not null and y is not null").groupBy("i").agg(F.max("y").alias("y"))
    chosen = chosen.orderBy(F.xxhash64("i"), "i").limit(SAMPLE).collect()
    if not chosen:
        return Model((), 0.0)
    frame = docs.sparkSession.createDataFrame([(r.i, int(r.y)) for r in chosen], f"i {docs.schema[id_col].dataType.simpleString()}, y int")
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("x")).where("x is not null").join(F.broadcast(frame), "i").withColumn("s", _statistics_column(F.col("x")))  # SAMPLE rows
    least = F.min(F.struct(F.xxhash64("x").alias("h"), F.col("y"), F.col("s"))).alias("r")
    got = rows.groupBy("i").agg(least).orderBy("i").select("r.y", "r.s.*").toArrow().to_pandas()
    return fit(got[list(STATISTICS)].to_numpy(), (got["y"].to_numpy() > 0).astype(float))


def _scored(docs: DataFrame, model: Model, text_col: str) -> tuple[DataFrame, str, Column]:
    """``docs`` with a column of its statistics and the probability as an expression over it."""
    small_batches(docs.sparkSession)
    name = fresh(docs, "text_statistics")
    probability = F.when(F.length(F.col(text_col)) > 0, model.column(F.col(name))).otherwise(F.lit(0.0))
    return docs.withColumn(name, _statistics_column(F.col(text_col))), name, probability


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", cut: float = CUT) -> DataFrame:
    """``(doc_id, quality, accepted)`` for every row: the statistics by one pass over the whole texts, the rules by
    column expressions over them; no shuffle. Null and empty texts have quality 0 and aren't accepted; a probability of exactly
    ``cut`` is accepted; repeated rows and null ids are rows like any other; other columns, whatever their names,
    don't matter; an empty table gives no rows."""
    rows, _, p = _scored(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), model, "text")
    return rows.select("doc_id", F.round(p, 6).alias("quality"), (p >= cut).alias("accepted"))


def keep_good(docs: DataFrame, model: Model, text_col: str = "text", cut: float = CUT) -> DataFrame:
    """``docs`` without the rows that ``score`` doesn't accept; all columns as they were, whatever their names."""
    rows, name, p = _scored(docs, model, text_col)
    return rows.where(p >= cut).drop(name)
