"""SentencePiece encoding and decoding: the best segmentation under the piece scores, whatever the length."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import lean, settle, sized, small_batches

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
GIANT = 40_000  #: longer texts, in characters, are split into chunks; float32 sums of scores are exact up to here
CHUNK = 8_192  #: characters of a chunk
LANES = 24  #: chunks that go through the dynamic program side by side
TASK = 4 * LANES  #: chunks of a task
UNIT = 32  #: scores are whole multiples of 1 / UNIT nats, so that sums are exact in any order
_NEVER = -(1 << 60)
_SPACE = "▁"


class Vocabulary:
    """Pieces of a model file. A file with scores of unigram log probabilities keeps them, in units; one of
    merge ranks has none, and its pieces get those of Zipf's law, -log(rank + 1)."""

    def __init__(self, path: str = MODEL):
        from sentencepiece import sentencepiece_model_pb2 as pb

        self.path = path
        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        ranked = model.trainer_spec.model_type != 1
        model.trainer_spec.model_type = 1
        rank = 0
        self.scores: dict[str, tuple[int, int]] = {}
        self.bytes = [-1] * 256
        self.table: list[bytes] = []
        for i, p in enumerate(model.pieces):
            self.table.append(p.piece.replace(_SPACE, " ").encode() if p.type in (1, 4) else b"")
            if p.type == 1:
                rank += 1
                p.score = -round(UNIT * math.log(rank + 1)) if ranked else round(UNIT * p.score)
                self.scores[p.piece] = (int(p.score), i)
            elif p.type == 6:
                self.bytes[int(p.piece[3:5], 16)] = i
                self.table[-1] = bytes([int(p.piece[3:5], 16)])
            elif p.type == 2:
                self.unknown = i
        if -1 in self.bytes:
            raise ValueError("the model has no piece for every byte, so that texts may not survive a round trip")
        self.longest = max(map(len, self.scores))
        self.missing = min(s for s, _ in self.scores.values()) - 10  # as the library scores an unknown character
        self.prefix = _SPACE if model.normalizer_spec.add_dummy_prefix else ""
        if model.normalizer_spec.precompiled_charsmap or model.normalizer_spec.remove_extra_whitespaces:
            raise ValueError("the model changes texts before it encodes them; only identity is supported")
        self.proto = model.SerializeToString()

    def library(self, begin: bool = True):
        """The library's processor; without ``begin`` for texts that go on from another, which get no prefix."""
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto.FromString(self.proto)
        model.normalizer_spec.add_dummy_prefix &= begin
        return sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())

    def decode(self, ids: list[int]) -> str:
        """The text of ``ids``; invalid UTF-8 is replaced."""
        raw = b"".join(map(self.table.__getitem__, ids))
        return (raw[1:] if self.prefix and raw[:1] == b" " else raw).decode("utf-8", "replace")

    def trie(self) -> "Trie":
        if not hasattr(self, "_trie"):
            self._trie = Trie(self.scores)
        return self._trie


class Trie:
    """Edges as sorted (node, character) keys, so that all positions of a text walk down at once."""

    def __init__(self, scores: dict[str, tuple[int, int]]):
        nodes: list[dict[int, int]] = [{}]
        ends: dict[int, tuple[int, int]] = {}
        for piece, found in scores.items():
            at = 0
            for c in map(ord, piece):
                if c not in nodes[at]:
                    nodes.append({})
                    nodes[at][c] = len(nodes) - 1
                at = nodes[at][c]
            ends[at] = found
        edges = sorted((n << 21 | c, to) for n, out in enumerate(nodes) for c, to in out.items())
        self.keys, self.to = np.array([k for k, _ in edges]), np.array([t for _, t in edges])
        self.score, self.id = np.full(len(nodes), _NEVER), np.full(len(nodes), -1)
        for n, (s, i) in ends.items():
            self.score[n], self.id[n] = s, i

    def walk(self, codes: np.ndarray, starts: np.ndarray, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For every length the places in ``starts`` from which a piece of it begins, and the piece's node.
        ``codes`` must go on for ``longest`` places after the last start."""
        at, node = np.arange(len(starts)), np.zeros(len(starts), dtype=np.int64)
        for n in range(longest):
            key = (node << 21) | codes[starts[at] + n]
            i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[i] == key
            at, node = at[hit], self.to[i[hit]]
            if not len(at):
                return
            full = self.id[node] >= 0
            yield n + 1, at[full], node[full]


class Lattice:
    """Several chunks with all pieces that begin in them, laid out by where pieces end: ``score[e, lane, j]``
    is of the piece from e - longest + j to e, so that the first maximum is the longest piece."""

    def __init__(self, v: Vocabulary, texts: list[str], sizes: list[int]):
        self.v, self.sizes = v, sizes
        longest, width = v.longest, max(sizes) + 2 * v.longest + 1
        codes = np.zeros((len(texts), width), dtype=np.int64)
        for k, t in enumerate(texts):
            c = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
            codes[k, : len(c)] = c
        self.codes = codes
        lane, pos = np.nonzero(np.arange(width)[None, :] < np.array(sizes)[:, None])
        self.score = np.full((max(sizes) + longest + 1, len(texts), longest), _NEVER)
        self.piece = np.full(self.score.shape, -1, dtype=np.int32)
        trie = v.trie()
        single = np.zeros(len(pos), dtype=bool)
        for n, at, node in trie.walk(codes.ravel(), lane * width + pos, longest):
            self.score[pos[at] + n, lane[at], longest - n] = trie.score[node]
            self.piece[pos[at] + n, lane[at], longest - n] = trie.id[node]
            if n == 1:
                single[at] = True
        self.score[pos[~single] + 1, lane[~single], longest - 1] = v.missing

    def matrices(self) -> np.ndarray:
        """(lanes, entry, exit): the best score from a cut ``entry`` characters after a chunk's begin to the
        first cut at or after its end, ``exit`` characters behind that."""
        longest, lanes = self.v.longest, len(self.sizes)
        best = np.full((len(self.score) + longest, lanes, longest), _NEVER)  # [place + longest, lane, entry]
        for e in range(len(self.score)):
            if e:
                window = best[e : e + longest].transpose(1, 2, 0) + self.score[e][:, None, :]
                best[e + longest] = np.maximum(window.max(axis=2), _NEVER)
            if e < longest:
                best[e + longest, :, e] = 0
        return np.stack([best[n + longest : n + 2 * longest, k, :].T for k, n in enumerate(self.sizes)])

    def paths(self, entry: np.ndarray) -> list[tuple[list[int], list[tuple[int, list[int]] | None]]]:
        """For every chunk, given the scores of its entries: the ids that its best paths to all exits end up
        sharing first, and for each exit the entry it comes from and the ids that remain (None: no path)."""
        longest, lanes = self.v.longest, len(self.sizes)
        best = np.full((len(self.score) + longest, lanes), _NEVER)
        back = np.zeros((len(self.score), lanes), dtype=np.int32)  # length of the last piece, 0: the entry
        row = np.arange(lanes)
        for e in range(len(self.score)):
            if e:
                window = best[e : e + longest].T + self.score[e]
                j = window.argmax(axis=1)
                best[e + longest] = np.maximum(window[row, j], _NEVER)
                back[e] = longest - j
            if e < longest:  # an entry's last piece began before the chunk, so it wins ties
                use = entry[:, e] >= best[e + longest]
                best[e + longest, use] = entry[use, e]
                back[e, use] = 0
        out = []
        for k, n in enumerate(self.sizes):
            found: list[tuple[int, list[int]] | None] = []
            for b in range(longest):
                if best[n + b + longest, k] <= _NEVER // 2:
                    found.append(None)
                    continue
                e, ids = n + b, []
                while back[e, k]:
                    size = int(back[e, k])
                    i = int(self.piece[e, k, longest - size])
                    ids += [i] if i >= 0 else [self.v.bytes[x] for x in reversed(chr(self.codes[k, e - 1]).encode("utf-8", "surrogatepass"))]
                    e -= size
                found.append((e, ids[::-1]))
            some = [f for f in found if f]
            same = 0
            if some and len({f[0] for f in some}) == 1:
                low, high = min(f[1] for f in some), max(f[1] for f in some)
                same = next((i for i, (a, b) in enumerate(zip(low, high)) if a != b), min(len(low), len(high)))
            out.append((some[0][1][:same] if some else [], [f and (f[0], f[1][same:]) for f in found]))
        return out


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus products of stacks of matrices."""
    out = np.full(a.shape, _NEVER)
    for j in range(a.shape[2]):
        np.maximum(out, a[:, :, j, None] + b[:, None, j, :], out=out)
    return np.maximum(out, _NEVER)


def scan(m: np.ndarray) -> np.ndarray:
    """Products of the first 1, 2, ... matrices, by pairs: its depth is the logarithm of their number."""
    if len(m) == 1:
        return m
    half = scan(product(m[0 : len(m) - 1 : 2], m[1::2]))
    out = np.empty_like(m)
    out[0], out[1::2] = m[0], half
    if len(m) > 2:
        out[2::2] = product(half[: len(m[2::2])], m[2::2])
    return out


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, giant: int = GIANT, chunk: int = CHUNK) -> DataFrame:
    """``(doc_id, n_tokens, ids, round_trip)`` for every row: the ids of the best-scoring segmentation (ties:
    the longer last piece) and whether decoding them gives back the text.

    Texts of up to ``giant`` characters go through the library's lattice search in one pass without a shuffle.
    Longer ones are split into chunks; each yields a matrix of best scores from every boundary state to every
    other, the matrices of a text are multiplied by an associative scan, and with the scores of its entries
    each chunk is traced back by itself. Both ways give the same ids. A null text has null ids, an empty one
    none. Characters that no piece has become bytes. Repeated rows and null ids are rows like any other; other
    columns, whatever their names, don't matter; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    v = Vocabulary(model)
    if chunk < v.longest:
        raise ValueError("a chunk must be longer than a piece")
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens int, ids array<int>, round_trip boolean"

    @lean
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lib = None
        for b in sized(batches, "text", 1 << 20):
            lib = lib or v.library()
            texts = b.column("text").to_pylist()
            ids = [None if t is None else x for t, x in zip(texts, lib.encode([t or "" for t in texts], num_threads=1))]
            trip = [None if x is None else v.decode(x) == t for x, t in zip(ids, texts)]
            yield pa.record_batch([b.column("doc_id"), pa.array([None if x is None else len(x) for x in ids], pa.int32()), pa.array(ids, pa.list_(pa.int32())), pa.array(trip)], names=["doc_id", "n_tokens", "ids", "round_trip"])

    @lean
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = TaskContext.get().partitionId() << 33
        for b in sized(batches, "text", 1 << 20):
            for r, text in enumerate(b.column("text").to_pylist()):
                norm = v.prefix + text
                starts = range(0, len(norm), chunk)
                yield pa.record_batch([b.column("doc_id").take(pa.array([r] * len(starts))), pa.array([n] * len(starts)), pa.array(range(len(starts)), pa.int32()), pa.array([min(chunk, len(norm) - s) for s in starts], pa.int32()), pa.array([norm[s : s + chunk + v.longest] for s in starts])], names=["doc_id", "row", "k", "n", "part"])
                n += 1

    def lattices(b: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, Lattice]]:
        for at in range(0, b.num_rows, LANES):
            s = b.slice(at, LANES)
            yield s, Lattice(v, [p.replace(" ", _SPACE) for p in s.column("part").to_pylist()], s.column("n").to_pylist())

    @lean
    def transfer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s, lattice in lattices(b):
                yield pa.record_batch([s.column("row"), s.column("k"), pa.array([m.tobytes() for m in lattice.matrices()], pa.binary())], names=["row", "k", "matrix"])

    def combine(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k")
        m = np.stack([np.frombuffer(x, dtype=np.int64).reshape(v.longest, v.longest) for x in pdf["matrix"]])
        first = np.full(v.longest, _NEVER)
        first[0] = 0
        entries = [first, *scan(m)[:-1, 0, :]]
        return pd.DataFrame({"row": pdf["row"].to_numpy(), "k": pdf["k"].to_numpy(), "entry": [(np.maximum(e - e.max(), _NEVER)).tobytes() for e in entries]})

    @lean
    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s, lattice in lattices(b):
                found = lattice.paths(np.stack([np.frombuffer(x, dtype=np.int64) for x in s.column("entry").to_pylist()]))
                ends = [[None if f is None else {"entry": f[0], "ids": f[1]} for f in exits] for _, exits in found]
                yield pa.record_batch([s.column("doc_id"), s.column("row"), s.column("k"), s.column("part"), s.column("n"), pa.array([p for p, _ in found], pa.list_(pa.int32())), pa.array(ends, pa.list_(pa.struct([("entry", pa.int32()), ("ids", pa.list_(pa.int32()))])))], names=["doc_id", "row", "k", "part", "n", "shared", "exits"])

    @lean
    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                parts = sorted(b.column("parts")[r].as_py(), key=lambda p: p["k"])
                out, exit_ = [], 0
                for p in reversed(parts):
                    end = p["exits"][exit_]
                    out.append(p["shared"] + end["ids"])
                    exit_ = end["entry"]
                ids = [i for x in reversed(out) for i in x]
                text = "".join(p["part"][: p["n"]] for p in parts)[len(v.prefix) :]
                yield pa.record_batch([b.column("doc_id").slice(r, 1), pa.array([len(ids)], pa.int32()), pa.array([ids], pa.list_(pa.int32())), pa.array([v.decode(ids) == text])], names=["doc_id", "n_tokens", "ids", "round_trip"])

    long = F.coalesce(F.length("text"), F.lit(0)) > giant
    chunks = settle(src.where(long).mapInArrow(cut, f"doc_id {kind}, row long, k int, n int, part string"), "chunks")
    spread = chunks.repartition(max(1, -(-chunks.count() // TASK)), "row", "k")  # both ways, so that no task has many more
    entries = spread.mapInArrow(transfer, "row long, k int, matrix binary").groupBy("row").applyInPandas(combine, "row long, k int, entry binary")
    traced = spread.join(entries, ["row", "k"]).select("doc_id", "row", "k", "n", "part", "entry")
    traced = traced.mapInArrow(trace, f"doc_id {kind}, row long, k int, part string, n int, shared array<int>, exits array<struct<entry:int,ids:array<int>>>")
    joined = traced.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.collect_list(F.struct("k", "n", "part", "shared", "exits")).alias("parts")).mapInArrow(join, schema)
    return src.where(~long).mapInArrow(whole, schema).unionByName(joined)


def decode(encoded: DataFrame, ids_col: str = "ids", model: str = MODEL) -> DataFrame:
    """``encoded`` with a column ``text``, the decoded ids; null for null. Ids beyond the vocabulary are an
    error. An existing column ``text`` is replaced."""
    v = Vocabulary(model)

    @F.pandas_udf("string")
    def one(ids: pd.Series) -> pd.Series:
        return ids.map(lambda x: None if x is None else v.decode(x))

    return encoded.withColumn("text", one(F.col(ids_col)))
