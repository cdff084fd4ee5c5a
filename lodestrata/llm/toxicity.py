"""Toxicity by a chain of linear classifiers over hashed words."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import lean, sized, small_batches
from ._text import mix, words
from .neardup import _compare

SAMPLE = 8_000  #: labelled documents that the models are fitted on: those with the least hash of their ids
SAMPLE_BYTES = 32 << 20  #: of the texts of these documents together: of the chosen ones, in the order of their hashes, those that fit
BITS = 40  #: of a hashed feature
FOLDS = 4  #: folds of the out-of-fold predictions
PREFIXES = (4, 5, 6, 7, 8)  #: bytes of a word's beginnings, features beside the word: compounds and inflections share them
SUPPORT = 5  #: documents of the sample that must hold a word for it to count
TELLING = 5.0  #: least z score of a word's log odds between the classes
COPIES = 0.6  #: sample documents that share so much of their words are one row of the training
CUT = 0.5  #: probability from which a category is given
#: Weak labels of the earlier categories: a document that holds any of the words. Toxic documents without a seed are
#: no negatives of these, since their kind isn't known, but the positives of a category of their own, unnamed. The
#: last category, toxic, is fitted on the table of labels.
SEEDS = {
    "insult": ("idiot", "moron", "clown", "loser", "fool", "imbecile", "trottel", "dummkopf", "versager", "abruti", "crétin", "imbécile", "idiota", "imbécil", "payaso"),
    "demeaning": ("worthless", "pathetic", "stupid", "useless", "dumb", "wertlos", "erbärmlich", "nutzlos", "minable", "stupide", "pathétique", "patético", "estúpido", "despreciable"),
    "disgust": ("trash", "scum", "disgusting", "garbage", "filth", "vermin", "abschaum", "ekelhaft", "ungeziefer", "ordure", "dégoûtant", "vermine", "basura", "escoria", "asqueroso"),
}
CATEGORIES = (*SEEDS, "unnamed", "toxic")


def features(arr: pa.Array, keys: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashed words (odd numbers) and words' beginnings (even ones) of each text, each once, and the place of
    each text's first; one more at the end. With ``keys``, which are sorted, only those among them, as places."""
    h, first, begins = words(arr, PREFIXES)
    n = len(first) - 1
    doc = np.repeat(np.arange(n, dtype=np.uint64), np.diff(first))
    mask = np.uint64((1 << BITS) - 2)
    parts = [(h & mask | np.uint64(1), doc)] + [(x & mask, doc[own]) for own, x in begins]
    if keys is not None:
        some = np.zeros(1 << 16, dtype=bool)
        some[(keys & np.uint64(0xFFFF)).astype(np.int64)] = True
        parts = [(x[m], d[m]) for x, d in parts for m in (some[(x & np.uint64(0xFFFF)).astype(np.int64)],)]
    at, doc = np.concatenate([x for x, _ in parts]), np.concatenate([d for _, d in parts])
    if keys is not None:
        place = np.searchsorted(keys, at)
        hit = np.flatnonzero(keys[np.minimum(place, len(keys) - 1)] == at) if len(keys) else np.zeros(0, np.int64)
        at, doc = place[hit].astype(np.uint64), doc[hit]
    if n >> (64 - BITS):
        raise ValueError("too many texts at once")
    both = np.unique((doc << np.uint64(BITS)) | at)
    return (both & np.uint64((1 << BITS) - 1)).astype(np.int64), np.searchsorted(both, np.arange(n + 1, dtype=np.uint64) << np.uint64(BITS))


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of ``values`` for each text; 0 for one without words."""
    total = np.concatenate([[0.0], np.cumsum(values)])
    return total[first[1:]] - total[first[:-1]]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Link:
    """One model of the chain: weights of the features by their places, weights of the earlier probabilities
    (as logits) and bias."""

    word: np.ndarray
    earlier: np.ndarray
    bias: float

    def predict(self, at: np.ndarray, first: np.ndarray, before: np.ndarray) -> np.ndarray:
        return _sigmoid(_sums(self.word[at], first) + before @ self.earlier + self.bias)


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def _fit(at: np.ndarray, first: np.ndarray, size: int, before: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 150) -> Link:
    """Logistic regression with an L2 penalty by Adagrad over all rows at once, on the words that SUPPORT rows
    hold and of which the log odds between the classes have a z score of TELLING."""
    n = len(first) - 1
    doc = np.repeat(np.arange(n), np.diff(first))
    link = Link(np.zeros(size), np.zeros(before.shape[1]), 0.0)
    pos, neg = weight * y, weight * (1 - y)
    if not pos.sum() or not neg.sum():
        link.bias = float(_logit(np.array([pos.sum() / weight.sum()]))[0]) if weight.sum() else 0.0
        return link
    a, b = np.bincount(at, weights=pos[doc], minlength=size), np.bincount(at, weights=neg[doc], minlength=size)
    odds = np.log((a + 0.5) / (pos.sum() - a + 0.5)) - np.log((b + 0.5) / (neg.sum() - b + 0.5))
    z = odds / np.sqrt(1 / (a + 0.5) + 1 / (b + 0.5) + 1 / (pos.sum() - a + 0.5) + 1 / (neg.sum() - b + 0.5))
    some = (a + b >= SUPPORT) & (np.abs(z) >= TELLING)
    used = np.flatnonzero(some)
    keep = some[at]
    at, doc = np.searchsorted(used, at[keep]), doc[keep]
    word, gw = np.zeros(len(used)), np.zeros(len(used))
    ge, gb = np.zeros(before.shape[1]), 0.0
    for _ in range(rounds):
        err = (_sigmoid(np.bincount(doc, weights=word[at], minlength=n) + before @ link.earlier + link.bias) - y) * weight
        g = np.bincount(at, weights=err[doc], minlength=len(used)) + 0.05 * word
        gw += g * g
        word -= 0.5 * g / np.sqrt(gw + 1e-8)
        g = before.T @ err + 0.05 * link.earlier
        ge += g * g
        link.earlier -= 0.2 * g / np.sqrt(ge + 1e-8)
        gb += err.sum() ** 2
        link.bias -= 0.5 * err.sum() / np.sqrt(gb + 1e-8)
    link.word[used] = word
    return link


def _copies(at: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each row the first row of its group of near copies, by 64 minwise values of its whole words."""
    n = len(first) - 1
    doc = np.repeat(np.arange(n), np.diff(first))
    whole = at & 1 == 1
    at, first = at[whole], np.searchsorted(doc[whole], np.arange(n + 1))
    sketch = np.zeros((n, 64), dtype=np.uint8)
    some = np.flatnonzero(np.diff(first))
    for k in range(64):
        v = mix(at.astype(np.uint64) + np.uint64(k << BITS))
        if len(some):
            sketch[some, k] = mix(np.minimum.reduceat(v, first[some])) & np.uint64(255)
    group = np.arange(n)
    for root, q in _compare(sketch, int(64 * COPIES)):
        group[q] = root
    return group


@dataclass
class Chain:
    """Models in order, over the features ``keys``, which are sorted."""

    keys: np.ndarray
    links: list[Link]


def fit_chain(at: np.ndarray, first: np.ndarray, labels: np.ndarray, known: np.ndarray | None = None, group: np.ndarray | None = None) -> Chain:
    """A model for each column of ``labels``, in order, fitted on the rows that are true in ``known``'s column
    (all if there is none). Each is given the probabilities of those before it;
    for training these are out-of-fold predictions, since a model is too sure of the rows it was fitted on.
    Near copies share the weight of one row and a fold, else what tells their text apart would count. Features
    that fewer than SUPPORT rows have are dropped, and in the end those that no model uses."""
    n = len(first) - 1
    group = _copies(at, first) if group is None else group
    weight = 1 / np.bincount(group, minlength=n)[group]
    fold = (mix(group.astype(np.uint64)) % np.uint64(FOLDS)).astype(np.int64)
    doc = np.repeat(np.arange(n), np.diff(first))
    keys, at, count = np.unique(at, return_inverse=True, return_counts=True)
    often = count >= SUPPORT
    keep = often[at]
    at, first = (np.cumsum(often) - 1)[at[keep]], np.searchsorted(doc[keep], np.arange(n + 1))
    keys = keys[often].astype(np.uint64)
    links, before = [], np.zeros((n, 0))
    for k in range(labels.shape[1]):
        y = labels[:, k].astype(float)
        w = weight if known is None else weight * known[:, k]
        held = np.zeros(n)
        for f in range(FOLDS):
            held[fold == f] = _fit(at, first, len(keys), before, y, w * (fold != f)).predict(at, first, before)[fold == f]
        links.append(_fit(at, first, len(keys), before, y, w))
        before = np.column_stack([before, _logit(held)])
    used = np.any([m.word != 0 for m in links], axis=0) if links else np.zeros(len(keys), bool)
    return Chain(keys[used], [Link(m.word[used], m.earlier, m.bias) for m in links])


def score(links: list[Link], at: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(texts x categories) probabilities, each model fed with those before it."""
    before = np.zeros((len(first) - 1, 0))
    out = []
    for link in links:
        out.append(link.predict(at, first, before))
        before = np.column_stack([before, _logit(out[-1])])
    return np.column_stack(out)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", toxic_col: str = "toxic") -> Chain:
    """Fit the chain on at most SAMPLE labelled documents of SAMPLE_BYTES together, a documented bound: the rows of
    ``labels`` with the least hash of their ids (of repeated ids the greatest label, and the text with the least
    hash). Null labels, ids and texts are left out; other columns don't matter; without any rows all
    probabilities are one half, which counts as not toxic."""
    seeds = {c: (words(pa.array([" ".join(w)]))[0] & np.uint64((1 << BITS) - 1) | np.uint64(1)) for c, w in SEEDS.items()}
    chosen = labels.select(F.col(id_col).alias("i"), F.col(toxic_col).alias("y")).where("i is not null and y is not null").groupBy("i").agg(F.max("y").alias("y"))
    chosen = chosen.orderBy(F.xxhash64("i"), "i").limit(SAMPLE).collect()
    if not chosen:
        return Chain(np.zeros(0, np.uint64), [Link(np.zeros(0), np.zeros(k), 0.0) for k in range(len(CATEGORIES))])
    kind = f"i {docs.schema[id_col].dataType.simpleString()}"
    src = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("x")).where("x is not null")
    ids = docs.sparkSession.createDataFrame([(r.i,) for r in chosen], kind)
    size = F.min(F.struct(F.xxhash64("x").alias("h"), F.octet_length("x").alias("n"))).alias("r")
    sizes = {r.i: r.r for r in src.join(F.broadcast(ids), "i").groupBy("i").agg(size).collect()}  # SAMPLE rows, no texts
    taken, room = [], SAMPLE_BYTES
    for r in chosen:
        if r.i in sizes and sizes[r.i].n <= room:
            taken.append((r.i, int(r.y), sizes[r.i].h))
            room -= sizes[r.i].n
    frame = docs.sparkSession.createDataFrame(taken, f"{kind}, y int, h long")
    rows = src.withColumn("h", F.xxhash64("x")).join(F.broadcast(frame), ["i", "h"])  # SAMPLE rows
    rows = rows.groupBy("i").agg(F.max("y").alias("y"), F.first("x").alias("x")).orderBy("i")  # a repeated row counts once

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sized(batches, "x"):
            at, first = features(b.column("x"))
            yield pa.record_batch([b.column("y"), pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(at))], names=["y", "at"])

    got = rows.select("y", "x").mapInArrow(run, "y int, at array<bigint>").toArrow()
    lists = got["at"].combine_chunks()
    at, first = np.array(lists.flatten()), np.concatenate([[0], np.cumsum(np.array(lists.value_lengths()))]).astype(np.int64)
    n = len(first) - 1
    doc = np.repeat(np.arange(n), np.diff(first))
    weak = [np.bincount(doc, weights=np.isin(at, s.astype(np.int64)), minlength=n) > 0 for s in seeds.values()]
    toxic, seeded = np.array(got["y"]) > 0, np.any(weak, axis=0)
    unnamed, sure = toxic & ~seeded, np.ones(n, dtype=bool)
    return fit_chain(at, first, np.column_stack([*weak, unnamed, toxic]), np.column_stack([*[~unnamed] * len(weak), ~(toxic & seeded), sure]))


def classify(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text", cut: float = CUT) -> DataFrame:
    """``(doc_id, p_<category> ..., toxic)`` for every row, in one pass without a shuffle; ``toxic`` is
    ``p_toxic > cut``, so a tie isn't. Texts of any length are looked at whole; a null or empty one has the
    probabilities of one without words. Repeated rows and null ids are rows like any other; other columns,
    whatever their names, don't matter; an empty table gives no rows."""
    small_batches(docs.sparkSession)
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    names = ["doc_id", *(f"p_{c}" for c in CATEGORIES), "toxic"]

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sized(batches, "text"):
            at, first = features(b.column("text"), chain.keys)
            p = np.round(score(chain.links, at, first), 6)
            yield pa.record_batch([b.column("doc_id"), *(pa.array(c) for c in p.T), pa.array(p[:, -1] > cut)], names=names)

    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, {', '.join(f'p_{c} double' for c in CATEGORIES)}, toxic boolean")
