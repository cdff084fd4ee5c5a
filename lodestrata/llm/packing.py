"""Token sequences packed into bins of fixed size, each where the sum of squares becomes smallest."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pieces
from ._shared import lean, sized, small_batches

CAPACITY = 2048  #: tokens in a bin


class Packer:
    """Bins that are open, for items that come one after the other.

    ``count[g]`` is the number of open bins with ``g`` units left. An item of size s goes into the bin, or the
    new one, for which the sum of ``count[g]**2`` over 0 < g < capacity is least afterwards; ties go to an open
    bin, then to the least room. Sizes must lie between 1 and capacity. The work is one vector operation over
    the gaps for each item, whatever the number of bins.
    """

    def __init__(self, capacity: int):
        self.capacity, self.total = capacity, 0
        self.count = np.zeros(capacity + 1, dtype=np.int64)
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]

    def put(self, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bin and place in it of each item, taken in order."""
        count, capacity = self.count, self.capacity
        bins, starts = np.empty(len(sizes), dtype=np.int64), np.empty(len(sizes), dtype=np.int64)
        far = np.iinfo(np.int64).max
        for k, s in enumerate(sizes.tolist()):
            if s == capacity:
                bins[k], starts[k] = self.total, 0
                self.total += 1
                continue
            # change of the sum: the bin leaves gap g (1 - 2 count[g]) and enters gap g - s (1 + 2 count[g - s])
            gain = 1 - 2 * count[s:capacity]
            gain[1:] += 1 + 2 * count[1 : capacity - s]
            gain[count[s:capacity] == 0] = far
            g = s + int(gain.argmin())
            if gain[g - s] <= 1 + 2 * count[capacity - s]:
                b = self.open[g].pop()
                count[g] -= 1
            else:
                b, g = self.total, capacity
                self.total += 1
            bins[k], starts[k] = b, capacity - g
            if g > s:
                self.open[g - s].append(b)
                count[g - s] += 1
        return bins, starts


def sum_of_squares(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and place of each item in bins of their own."""
    return Packer(capacity).put(sizes)


class Tokens:
    """The ids of texts. Up to pieces.GIANT characters they are those of ``pieces.encode``; a longer text is cut at
    its last space before every so many characters, and the parts encoded one by one, so that near a cut the
    segmentation may be another; decoded in order they are the text in any case."""

    def __init__(self, v: pieces.Vocabulary):
        self.first, self.rest = v.library(), v.library(False)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        heads, at, parts = [], [], []
        for i, t in enumerate(texts):
            t = t or ""
            lo = _cut(t, 0, pieces.GIANT)
            heads.append(t[:lo])
            while lo < len(t):
                hi = _cut(t, lo, pieces.GIANT)
                at.append(i)
                parts.append(t[lo:hi])
                lo = hi
        found = [np.array(x, dtype=np.int32) for x in self.first.encode(heads, num_threads=1)]
        more: dict[int, list[np.ndarray]] = {}
        for i, x in zip(at, self.rest.encode(parts, num_threads=1) if parts else []):
            more.setdefault(i, [found[i]]).append(np.array(x, dtype=np.int32))
        for i, x in more.items():
            found[i] = np.concatenate(x)
        return found


def _cut(text: str, lo: int, most: int) -> int:
    """End of the part of ``text`` that begins at ``lo``: before its last space within ``most`` characters, if any."""
    if len(text) - lo <= most:
        return len(text)
    space = text.rfind(" ", lo + 1, lo + most)
    return space if space > lo else lo + most


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, model: str = pieces.MODEL) -> DataFrame:
    """``(doc_id, piece, n_tokens, bin_group, bin, start, ids)``: where each piece of each document lies, and its ids.

    A document of more than ``capacity`` tokens is cut into pieces of ``capacity`` and a rest; only the rest
    competes for room, the others fill bins of their own. A null or empty text is a piece of 0 tokens in no bin
    (null ``bin`` and ``start``). The rule places pieces as they come, so that every task packs the rows of its
    partition while it encodes them, in their order, into bins of its own, ``bin_group``: nothing is shuffled or
    held, and the last bins of each partition are all that parallel work wastes. Repeated rows and rows of null
    id are packed each for itself. Very long texts: see ``Tokens``. Other columns, whatever their names, don't
    matter; no rows give no rows.
    """
    small_batches(docs.sparkSession)
    v = pieces.Vocabulary(model)
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, packer, group = None, Packer(capacity), TaskContext.get().partitionId()
        for b in sized(batches, "text"):
            tokens = tokens or Tokens(v)
            ids = tokens.encode(b.column("text").to_pylist())
            n = np.array([len(x) for x in ids], dtype=np.int64)
            count = np.maximum(1, -(-n // capacity))
            at = np.repeat(np.arange(len(n)), count)
            piece = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
            size = np.minimum(n[at] - piece * capacity, capacity)
            bins, starts = np.zeros(len(at), dtype=np.int64), np.zeros(len(at), dtype=np.int64)
            some = np.flatnonzero(size > 0)
            bins[some], starts[some] = packer.put(size[some])
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(np.concatenate(ids)))
            values = [b.column("doc_id").take(pa.array(at)), pa.array(piece, pa.int32()), pa.array(size), pa.array(np.full(len(at), group), pa.int32()), pa.array(bins, mask=size == 0), pa.array(starts, mask=size == 0), lists]
            yield pa.record_batch(values, names=["doc_id", "piece", "n_tokens", "bin_group", "bin", "start", "ids"])

    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, piece int, n_tokens long, bin_group int, bin long, start long, ids array<int>")


def sequences(packed: DataFrame) -> DataFrame:
    """``(bin_group, bin, n_tokens, ids, pieces)`` of what ``pack`` gives: the bins as token sequences to train on, each
    with the pieces ``(doc_id, piece, start, n_tokens)`` that lie in it, by their starts. Pieces without tokens lie
    in no bin. A bin is as long as its capacity at most, and so is what one group gathers."""
    one = F.struct("start", F.col("doc_id"), "piece", "n_tokens", "ids")
    bins = packed.where("bin is not null").groupBy("bin_group", "bin").agg(F.sum("n_tokens").alias("n_tokens"), F.sort_array(F.collect_list(one)).alias("all"))
    of = F.transform("all", lambda p: F.struct(p["doc_id"].alias("doc_id"), p["piece"].alias("piece"), p["start"].alias("start"), p["n_tokens"].alias("n_tokens")))
    return bins.select("bin_group", "bin", "n_tokens", F.flatten(F.transform("all", lambda p: p["ids"])).alias("ids"), of.alias("pieces"))
