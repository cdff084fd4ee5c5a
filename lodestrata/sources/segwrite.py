"""Segments written from rows: the inverse of the reader, so that plain tables become an index."""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from ..functions.codec import pack, put_text, put_tlong, put_varied, put_zdouble, put_zfloat, zigzag
from .segments import ADDRESSES, ALL_MISSING, BINARY, BLOCK, CONST, DELTA, END_MAGIC, FIXED, GCD, MAGIC, MONOTONIC, NONE_MISSING, NUMERIC, SETS, SINGLE, SORTED, SORTED_NUMERIC, SORTED_SET, SPARSE, TABLE, VARIABLE, open_path

CHUNK = 16_384  #: bytes of stored documents in a chunk
WIDTHS = (1, 2, 4, 8, 12, 16, 20, 24, 28, 32, 40, 48, 56, 64)  #: of columnar numbers
TERMS = 48  #: entries of a block of terms
GROUP = 25  #: terms of one prefix that get a block of their own
LEAF = 1_024  #: points of a leaf
WHOLE = (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 12, 16, 21, 32)  #: widths that may be packed into words
SHIFT = 16  #: log2 of the values in a block of rising numbers
ROWS, BYTES = 1 << 18, 16 << 20  #: rows and Arrow bytes of a segment, which its writer and readers hold; a partition of more gives several
SLICE = 1_024  #: rows that are counted at once for that
_ID = bytes(range(16))


def _lz4(data: bytes) -> bytes:
    return pa.Codec("lz4_raw").compress(data, asbytes=True)


@dataclass(frozen=True)
class Field:
    """How a column is indexed. ``options``: 0 not, 1 documents, 2 and frequencies, 3 and positions, 4 and offsets (of
    which only the pointers are written). ``dv``: numeric, binary, sorted, sorted_set or sorted_numeric. ``points``:
    bytes of a dimension, 0 for none. ``stored``: string, binary, int, float, long or double."""

    name: str
    number: int = 0
    options: int = 0
    norms: bool = False
    stored: str | None = None
    dv: str | None = None
    points: int = 0
    dims: int = 1


def _i(v: int, n: int = 8) -> bytes:
    return (v & (1 << 8 * n) - 1).to_bytes(n, "big")


def _texts(values: list[str]) -> bytes:
    return put_varied(len(values)) + b"".join(map(put_text, values))


def _pairs(values: dict[str, str]) -> bytes:
    return put_varied(len(values)) + b"".join(put_text(k) + put_text(v) for k, v in values.items())


def head(codec: str, version: int = 0, named: bool = True) -> bytes:
    return _i(MAGIC, 4) + put_text(codec) + _i(version, 4) + (_ID + b"\0" if named else b"")


def closed(body: bytes) -> bytes:
    """``body`` with its footer."""
    body = bytes(body) + _i(END_MAGIC, 4) + _i(0, 4)
    return body + _i(zlib.crc32(body))


def _bits(v: int) -> int:
    return next(w for w in WIDTHS if v >> w == 0)


def _padded(values: np.ndarray, bits: int) -> bytes:
    return pack(values, bits, whole_words=False) + b"\0\0\0"


def field_infos(fields: list[Field]) -> bytes:
    kinds = (None, "numeric", "binary", "sorted", "sorted_set", "sorted_numeric")
    body = head("fields") + put_varied(len(fields))
    for f in fields:
        body += put_text(f.name) + put_varied(f.number) + bytes([0 if f.norms else 2, f.options, kinds.index(f.dv)]) + _i(-1) + _pairs({}) + put_varied(f.dims if f.points else 0)
        body += put_varied(f.points) if f.points else b""
    return closed(body)


def _line(values: list[int]) -> bytes:
    """Average step, width and packed distances from the line through the first value."""
    average = (values[-1] - values[0]) // max(1, len(values) - 1)
    delta = [zigzag(v - values[0] - average * i) for i, v in enumerate(values)]
    bits = max(delta).bit_length()
    return put_varied(average) + put_varied(bits) + pack(delta, bits, whole_words=False)


def _spread(values: list[int]) -> bytes:
    if len(set(values)) == 1:
        return put_varied(0) + put_varied(values[0])
    bits = max(values).bit_length()
    return put_varied(bits) + pack(values, bits, whole_words=False)


def stored(fields: list[Field], docs: dict[str, list], n: int, chunk: int = CHUNK) -> tuple[bytes, bytes]:
    """The index of chunks and the chunks of ``n`` documents. A value may be a list, which gives several."""
    put = {"string": put_text, "binary": put_text, "int": lambda v: put_varied(zigzag(v)), "float": put_zfloat, "long": put_tlong, "double": put_zdouble}
    tags = list(put)
    ways = [(put_varied(f.number << 3 | tags.index(f.stored)), put[f.stored], docs[f.name]) for f in fields if f.stored]
    data, starts, bases = bytearray(head("stored") + put_varied(chunk) + put_varied(2)), [], []
    kept: list[tuple[int, bytes]] = []
    size = dirty = 0
    for i in range(n):
        parts = [code + way(v) for code, way, values in ways if values[i] is not None for v in (values[i] if isinstance(values[i], list) else (values[i],))]
        kept.append((len(parts), b"".join(parts)))
        size += len(kept[-1][1])
        if size >= chunk or i == n - 1:
            dirty += size < chunk
            starts.append(len(data))
            bases.append(i + 1 - len(kept))
            sliced = size >= 2 * chunk
            data += put_varied(bases[-1]) + put_varied(len(kept) << 1 | sliced)
            for values in ([n for n, _ in kept], [len(b) for _, b in kept]):
                data += put_varied(values[0]) if len(kept) == 1 else _spread(values)
            raw = b"".join(b for _, b in kept)
            data += b"".join(_lz4(raw[a : a + chunk]) for a in range(0, size, chunk)) if sliced else _lz4(raw)
            kept, size = [], 0
    index = head("index") + put_varied(2)
    for lo in range(0, len(starts), 1024):
        b, p = bases[lo : lo + 1024], starts[lo : lo + 1024]
        index += put_varied(len(b)) + put_varied(b[0]) + _line(b) + put_varied(p[0]) + _line(p)
    end = put_varied(len(data))
    return closed(index + b"\0" + end), closed(bytes(data) + put_varied(len(starts)) + put_varied(dirty))


class _Columns:
    """Meta data and data of columnar values, side by side."""

    def __init__(self):
        self.meta, self.data = head("dv-meta"), bytearray(head("dv-data"))

    def there(self, mask: list[bool]) -> int:
        if all(mask):
            return NONE_MISSING
        if not any(mask):
            return ALL_MISSING
        at = len(self.data)
        self.data += np.packbits(np.array(mask), bitorder="little").tobytes()
        return at

    def rising(self, values: list[int], shift: int) -> bytes:
        """Blocks of rising numbers as a line and distances from it; gives their description."""
        begin, meta = len(self.data), b""
        for lo in range(0, len(values), 1 << shift):
            v = np.array(values[lo : lo + (1 << shift)], np.int64)
            average = np.float32((v[-1] - v[0]) / max(1, len(v) - 1))
            delta = v - (average * np.arange(len(v), dtype=np.float32)).astype(np.int64)
            low = int(delta.min())
            bits = _bits(int(delta.max()) - low) if delta.max() > low else 0
            meta += _i(low) + struct.pack(">f", average) + _i(len(self.data) - begin) + bytes([bits])
            self.data += _padded(delta - low, bits) if bits else b""
        return meta

    def numbers(self, number: int, values: list[int | None], form: int | None = None) -> None:
        """An entry in the smallest format: one value, a table, multiples, differences; or few documents."""
        some = [v for v in values if v is not None]
        if form is None and len(some) * 16 < len(values) and some:
            docs = [i for i, v in enumerate(values) if v is not None]
            begin = len(self.data)
            blocks = self.rising(docs, SHIFT)
            self.meta += put_varied(SPARSE) + _i(begin) + put_varied(len(docs)) + put_varied(SHIFT) + blocks + _i(len(self.data)) + put_varied(len(some)) + b"\0" + put_varied(number) + bytes([NUMERIC])
            self.numbers(number, some, DELTA)
            self.meta += _i(len(self.data))
            return
        missing = self.there([v is not None for v in values])
        full = np.array([0 if v is None else v for v in values], np.int64)
        low, high = (int(full.min()), int(full.max())) if len(full) else (0, 0)
        distinct = np.unique(full)
        above = lambda v: v.astype(np.uint64) - np.uint64(low % (1 << 64))  # noqa: E731 - exact, as it is taken modulo 2**64
        step = int(np.gcd.reduce(above(distinct))) if len(distinct) else 0
        wide, small = _bits(high - low), _bits(max(0, len(distinct) - 1))
        if form is None:
            form = CONST if len(distinct) <= 1 else TABLE if len(distinct) <= 255 and small < wide else GCD if step > 1 else DELTA
        self.meta += put_varied(form) + _i(missing) + _i(len(self.data)) + put_varied(len(values))
        if form == CONST:
            self.meta += _i(low)
        elif form == TABLE:
            self.meta += put_varied(len(distinct)) + b"".join(map(_i, distinct.tolist())) + put_varied(small)
            self.data += _padded(np.searchsorted(distinct, full), small)
        else:
            step = step if form == GCD else 1
            bits = _bits((high - low) // step)
            self.meta += _i(low) + (_i(step) if form == GCD else b"") + put_varied(bits)
            self.data += _padded(above(full) // np.uint64(max(step, 1)), bits)
        self.meta += _i(len(self.data))

    def addresses(self, number: int, values: list[int]) -> None:
        begin = len(self.data)
        blocks = self.rising(values, SHIFT)
        self.meta += put_varied(MONOTONIC) + _i(NONE_MISSING) + _i(begin) + put_varied(len(values) - 1) + put_varied(SHIFT) + blocks + _i(len(self.data))

    def bytes_(self, values: list[bytes | None]) -> None:
        missing, begin = self.there([v is not None for v in values]), 0
        sizes = [len(v) for v in values if v is not None]
        low, high = min(sizes, default=0), max(sizes, default=0)
        fixed = low == high and None not in values
        begin = len(self.data)
        self.data += b"".join(v or b"" for v in values)
        self.meta += put_varied(FIXED if fixed else VARIABLE) + _i(missing) + put_varied(low) + put_varied(high) + put_varied(len(values)) + _i(begin)
        if not fixed:
            at = len(self.data)
            blocks = self.rising([0, *np.cumsum([len(v or b"") for v in values]).tolist()], SHIFT)
            self.meta += _i(at) + put_varied(SHIFT) + blocks + _i(len(self.data))


def columns(fields: list[Field], docs: dict[str, list], sets: int | None = None) -> tuple[bytes, bytes]:
    """Meta data and data of all columnar fields; ``sets`` forces the layout of several values a document."""
    c = _Columns()
    kinds = {"numeric": NUMERIC, "binary": BINARY, "sorted": SORTED, "sorted_set": SORTED_SET, "sorted_numeric": SORTED_NUMERIC}
    for f in fields:
        if not f.dv:
            continue
        own, kind = put_varied(f.number), kinds[f.dv]
        c.meta += own + bytes([kind])
        values = docs[f.name]
        if kind == NUMERIC:
            c.numbers(f.number, values)
            continue
        if kind == BINARY:
            c.bytes_(values)
            continue
        lists = [[] if v is None else v if isinstance(v, list) else [v] for v in values]
        lists = [sorted(set(x)) if kind == SORTED_SET else sorted(x) for x in lists]
        words = sorted({w for x in lists for w in x})
        if kind != SORTED_NUMERIC:
            place = {w: k for k, w in enumerate(words)}
            lists = [[place[w] for w in x] for x in lists]
        form = SINGLE
        if kind != SORTED:
            single = all(len(x) <= 1 for x in lists) if kind == SORTED_SET else all(len(x) == 1 for x in lists)
            table = sorted({tuple(x) for x in lists})
            form = sets if sets is not None else SINGLE if single else SETS if len(table) <= 255 and sum(map(len, table)) <= 256 else ADDRESSES
            c.meta += put_varied(form)
            if form == SETS:
                flat = [v for x in table for v in x]
                c.meta += _i(len(flat), 4) + b"".join(map(_i, flat)) + _i(len(table), 4) + b"".join(_i(len(x), 4) for x in table)
            if form == SINGLE and kind == SORTED_SET:
                c.meta += own + bytes([SORTED])
        if kind != SORTED_NUMERIC:
            c.meta += own + bytes([BINARY])
            c.bytes_(words)
        c.meta += own + bytes([NUMERIC])
        if form == SETS:
            where = {x: k for k, x in enumerate(table)}
            c.numbers(f.number, [where[tuple(x)] for x in lists], DELTA)
        elif form == ADDRESSES:
            c.numbers(f.number, [v for x in lists for v in x], DELTA)
            c.meta += own + bytes([NUMERIC])
            c.addresses(f.number, [0, *np.cumsum([len(x) for x in lists]).tolist()])
        else:
            missing = -1 if kind != SORTED_NUMERIC else None
            c.numbers(f.number, [x[0] if x else missing for x in lists], DELTA)
    return closed(c.meta + put_varied(0xFFFFFFFF)), closed(bytes(c.data))


def norms(fields: list[Field], lengths: dict[int, list[int]]) -> tuple[bytes, bytes]:
    meta, data = head("norm-meta"), head("norm-data")
    for f in fields:
        if f.options and f.norms:
            v = lengths[f.number]
            high = max(v, default=0)
            width = 0 if len(set(v)) <= 1 else next(w for w in (1, 2, 4, 8) if high >> 8 * w == 0)
            meta += put_varied(f.number) + bytes([width]) + _i(len(data) if width else high)
            data += b"".join(_i(x, width) for x in v) if width else b""
    return closed(meta + put_varied(0xFFFFFFFF)), closed(data)


class _Terms:
    """Blocks of the terms of all fields, their postings and the directories."""

    def __init__(self, words: bool = False):
        """With ``words`` the widths of WHOLE are packed into words of 8 bytes of which no value crosses the border."""
        self.tim, self.tip, self.doc = bytearray(head("terms")), head("prefixes"), bytearray(head("docs"))
        self.words = frozenset(WHOLE if words else ())
        self.doc += put_varied(2) + b"".join(put_varied((1 << 5 if b in self.words else 0) | b - 1) for b in range(1, 33))
        self.fields: list[bytes] = []
        self.pointers: list[int] = []

    def _posting(self, lo: int, hi: int, freqs: bool) -> int:
        at, full = len(self.doc), hi - (hi - lo) % BLOCK
        for k in range(lo, full, BLOCK):
            for v in (self.delta, self.freq) if freqs else (self.delta,):
                v = v[k : k + BLOCK]
                bits = int(v.max()).bit_length() if (v != v[0]).any() else 0
                self.doc += bytes([bits]) + (put_varied(int(v[0])) if not bits else _in_words(v.tolist(), bits) if bits in self.words else pack(v, bits, whole_words=False))
        self.doc += self.rest[self.places[full] : self.places[hi]]
        return at

    def _blocks(self, f: Field, terms: list[tuple[bytes, int, int, int]], depth: int) -> tuple[int, bytes]:
        """Write the blocks of ``terms``, which share ``depth`` bytes; where they begin and, if there are several, the
        first bytes and places of those after the first."""
        prefix = depth
        entries: list[tuple[bytes, tuple | None, int]] = []
        if len(terms) <= TERMS:
            entries = [(t[0][prefix:], t, -1) for t in terms]
        else:
            groups: dict[bytes, list] = {}
            for t in terms:
                groups.setdefault(t[0][prefix : prefix + 1], []).append(t)
            for first, own in groups.items():
                if first and len(own) >= GROUP:
                    entries.append((first, None, self._blocks(f, own, prefix + 1)[0]))
                else:
                    entries += [(t[0][prefix:], t, -1) for t in own]
        cuts = [0]
        for k in range(1, len(entries)):  # floor blocks begin with a byte that the one before doesn't have
            if k - cuts[-1] >= TERMS and entries[k][0][:1] != entries[k - 1][0][:1]:
                cuts.append(k)
        cuts.append(len(entries))
        begin: list[int] = []
        for lo, hi in zip(cuts, cuts[1:]):
            some, at = entries[lo:hi], len(self.tim)
            begin.append(at)
            leaf = all(t is not None for _, t, _ in some)
            suffix = stats = meta = b""
            fp = 0
            for s, t, sub in some:
                if t is None:
                    suffix += put_varied(len(s) << 1 | 1) + s + put_varied(at - sub)
                    continue
                suffix += put_varied(len(s) if leaf else len(s) << 1) + s
                _, lo, up, total = t
                df = up - lo
                stats += put_varied(df) + (put_varied(total - df) if f.options != 1 else b"")
                pointer = self._posting(lo, up, f.options > 1) if df > 1 else max(fp, len(self.doc))
                meta += put_varied(pointer - fp) + b"\0" * ((f.options >= 3) + (f.options >= 4)) + (put_varied(int(self.delta[lo])) if df == 1 else b"")
                fp = pointer
                meta += put_varied(0) if f.options >= 3 and total > BLOCK else b""
                meta += put_varied(0) if df > BLOCK else b""
            last = hi == len(entries)
            self.tim += put_varied(len(some) << 1 | last) + put_varied(len(suffix) << 1 | leaf) + suffix + put_text(stats) + put_text(meta)
        floor = put_varied(len(begin) - 1) + b"".join(entries[k][0][:1] + put_varied(b - begin[0] << 1 | 1) for k, b in zip(cuts[1:], begin[1:])) if len(begin) > 1 else b""
        return begin[0], floor

    def add(self, f: Field, words: list[bytes], cuts: np.ndarray, docs: np.ndarray, freqs: np.ndarray) -> None:
        """The terms ``words``, in order, whose documents and frequencies lie between ``cuts``."""
        self.delta, self.freq = np.diff(docs, prepend=0), freqs
        self.delta[cuts[:-1]] = docs[cuts[:-1]]  # the first of each term
        pairs = np.stack([self.delta << 1 | (freqs == 1), freqs], axis=1) if f.options > 1 else self.delta[:, None]
        there = np.stack([np.ones(len(docs), bool), freqs != 1], axis=1) if f.options > 1 else np.ones((len(docs), 1), bool)
        self.rest, places = _all_varied(pairs[there])
        self.places = places[np.concatenate([[0], np.cumsum(there.sum(axis=1))])]
        total = np.add.reduceat(freqs, cuts[:-1])
        terms = list(zip(words, cuts[:-1].tolist(), cuts[1:].tolist(), total.tolist()))
        at, floor = self._blocks(f, terms, 0)
        root = put_varied(at << 2 | 2 | bool(floor)) + floor
        self.fields.append(
            put_varied(f.number) + put_varied(len(terms)) + put_text(root) + (put_varied(int(total.sum())) if f.options != 1 else b"") + put_varied(len(docs))
            + put_varied(len(np.unique(docs))) + put_varied(1 + (f.options >= 3) + (f.options >= 4)) + put_text(words[0]) + put_text(words[-1])
        )
        self.pointers.append(len(self.tip))
        self.tip += head("automaton", 6, named=False) + b"\0\1" + put_text(root[::-1]) + b"\0" + put_varied(0) + put_varied(1) + b"\0"

    def files(self) -> tuple[bytes, bytes, bytes]:
        tim = self.tim + put_varied(len(self.fields)) + b"".join(self.fields) + _i(len(self.tim))
        tip = self.tip + b"".join(map(put_varied, self.pointers)) + _i(len(self.tip))
        return closed(tim), closed(tip), closed(bytes(self.doc))


def _all_varied(values: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Numbers of variable length, one after the other, and where each begins and the last ends."""
    values = values.astype(np.uint64)
    sizes = np.ones(len(values), np.int64)
    for k in range(1, 10):
        sizes += values >> np.uint64(7 * k) > 0
    places = np.concatenate([[0], np.cumsum(sizes)])
    out = np.zeros(places[-1], np.uint8)
    for k in range(int(sizes.max(initial=0))):
        own = np.flatnonzero(sizes > k)
        out[places[own] + k] = (values[own] >> np.uint64(7 * k) & np.uint64(0x7F)).astype(np.uint8) | np.where(sizes[own] > k + 1, 0x80, 0).astype(np.uint8)
    return out.tobytes(), places


def inverted(texts: list[str | None]) -> tuple[list[int], list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of each text; all terms in order, and the documents and frequencies of each, which lie between cuts."""
    lengths, parts, some = [], [], []
    for text in texts:
        found = tokens(text) if text else []
        lengths.append(len(found))
        some += found
        if len(some) > 1 << 16:
            parts.append(pa.array(some, pa.string()).dictionary_encode())
            some = []
    parts.append(pa.array(some, pa.string()).dictionary_encode())
    whole = pa.chunked_array(parts).unify_dictionaries()
    terms = whole.chunk(0).dictionary
    order = pc.sort_indices(terms).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    codes = rank[np.concatenate([c.indices.to_numpy() for c in whole.chunks])]
    key, freqs = np.unique(codes * max(1, len(texts)) + np.repeat(np.arange(len(texts)), lengths), return_counts=True)
    cuts = np.searchsorted(key, np.arange(len(order) + 1) * max(1, len(texts)))
    return lengths, [t.encode() for t in terms.take(pa.array(order)).to_pylist()], cuts, key % max(1, len(texts)), freqs.astype(np.int64)


def _in_words(values: list[int], bits: int) -> bytes:
    each = 64 // bits
    rows = [values[i : i + each] for i in range(0, len(values), each)]
    return b"".join(_i(sum(v << bits * k for k, v in enumerate(r))) for r in rows)


def _sortable(v: int, n: int) -> bytes:
    return _i(v + (1 << 8 * n - 1), n)


def _packed_points(values: list, n: int) -> np.ndarray:
    """Points x dimensions x ``n`` bytes: whole numbers, a list of them for each point, which sort as bytes as they do."""
    flat = np.array(values, object if n > 8 else np.int64)
    flat = flat[:, None] if flat.ndim == 1 else flat
    if n > 8:
        return np.frombuffer(b"".join(_sortable(v, n) for v in flat.ravel()), np.uint8).reshape(*flat.shape, n)
    raw = (flat.astype(np.uint64) + np.uint64(1 << 8 * n - 1)).astype(">u8")
    return raw.view(np.uint8).reshape(*flat.shape, 8)[:, :, 8 - n :]


def tree(docs: np.ndarray, raw: np.ndarray, at: int, leaf: int = LEAF) -> tuple[bytes, int]:
    """Leaves and the tree over them of the points ``raw`` (points x dimensions x bytes) of ``docs``, in a file that has
    ``at`` bytes so far, and where the tree begins."""
    total, dims, size = raw.shape
    count = 1
    while -(-total // count) > leaf:
        count *= 2
    out, starts, splits = bytearray(), [], {}
    words = np.zeros((total, dims, -(-size // 8) * 8), np.uint8)  # bytes as numbers, most significant first
    words[:, :, words.shape[2] - size :] = raw
    words = words.view(">u8").astype(np.uint64)

    def ends(own: np.ndarray, d: int) -> tuple[bytes, bytes]:
        for k in range(words.shape[2]):
            v = words[own, d, k]
            low, high = (own[v == v.min()], own[v == v.max()]) if not k else (low[(w := words[low, d, k]) == w.min()], high[(w := words[high, d, k]) == w.max()])
        return raw[low[0], d].tobytes(), raw[high[0], d].tobytes()

    def write(own: np.ndarray) -> None:
        starts.append(at + len(out))
        ids, n = docs[own], len(own)
        out.extend(put_varied(n))
        step = np.diff(ids, prepend=0)
        if (step >= 0).all():
            out.extend(b"\0" + b"".join(map(put_varied, step.tolist())))
        else:
            width = 4 if n % 2 or int(ids.max()) >> 24 else 3
            out.extend(bytes([8 * width]) + ids.astype(">u4").view(np.uint8).reshape(-1, 4)[:, 4 - width :].tobytes())
        prefix = []
        for d in range(dims):
            low, high = ends(own, d)
            k = next((i for i in range(size) if low[i] != high[i]), size)
            prefix.append(k)
            out.extend(put_varied(k) + low[:k])
        run = next((d for d in range(dims) if prefix[d] < size), -1)
        out.extend(_i(run, 1))
        if run < 0:
            return
        first = raw[own, run, prefix[run]]
        rest = np.concatenate([raw[own, d, prefix[d] + (d == run) :] for d in range(dims)], axis=1)
        cuts = [0, *(np.flatnonzero(np.diff(first)) + 1).tolist(), n]
        for lo, hi in zip(cuts, cuts[1:]):
            for i in range(lo, hi, 255):
                k = min(255, hi - i)
                out.extend(bytes([first[i], k]) + rest[i : i + k].tobytes())

    def split(node: int, own: np.ndarray, depth: int) -> None:
        if node >= count:
            write(own)
            return
        d = depth % dims
        own = own[np.lexsort((docs[own], *(words[own, d, k] for k in reversed(range(words.shape[2])))))]
        half = len(own) // 2
        splits[node] = (d, raw[own[half], d].tobytes())
        split(node * 2, own[:half], depth + 1)
        split(node * 2 + 1, own[half:], depth + 1)

    def leftmost(node: int) -> int:
        while node < count:
            node *= 2
        return starts[node - count]

    def index(node: int, base: int, left: bool, last: tuple[bytes, ...], negative: tuple[bool, ...]) -> bytes:
        own = b"" if left else put_varied(leftmost(node) - base)
        if node >= count:
            return own
        base = leftmost(node)
        d, value = splits[node]
        prefix = next((i for i in range(size) if value[i] != last[d][i]), size)
        first = (last[d][prefix] - value[prefix] if negative[d] else value[prefix] - last[d][prefix]) if prefix < size else 0
        own += put_varied((first * (1 + size) + prefix) * dims + d) + value[prefix + 1 :]
        now = (*last[:d], value, *last[d + 1 :])
        a = index(node * 2, base, True, now, (*negative[:d], True, *negative[d + 1 :]))
        return own + (put_varied(len(a)) if node * 2 < count else b"") + a + index(node * 2 + 1, base, False, now, (*negative[:d], False, *negative[d + 1 :]))

    every = np.arange(total)
    split(1, every, 0)
    begin = at + len(out)
    packed_index = index(1, 0, False, (bytes(size),) * dims, (False,) * dims)
    bounds = [ends(every, d) for d in range(dims)]
    out += head("tree", 4, named=False) + b"".join(map(put_varied, (dims, leaf, size, count))) + b"".join(a for a, _ in bounds) + b"".join(b for _, b in bounds) + put_varied(total) + put_varied(len(np.unique(docs))) + put_text(packed_index)
    return bytes(out), begin


def tokens(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


def segment(name: str, fields: list[Field], docs: list[dict] | dict[str, list], compound: bool = False, sets: int | None = None, leaf: int = LEAF, chunk: int = CHUNK, words: bool = False) -> dict[str, bytes]:
    """Files of one segment, of rows or of columns. Text of indexed fields is cut into runs of ASCII letters and digits, in
    lower case."""
    fields = [replace(f, number=k) for k, f in enumerate(fields)]
    rows = len(docs) if isinstance(docs, list) else len(docs[fields[0].name])
    docs = {f.name: [d.get(f.name) for d in docs] for f in fields} if isinstance(docs, list) else docs
    files = {".fnm": field_infos(fields)}
    if any(f.stored for f in fields):
        files[".fdx"], files[".fdt"] = stored(fields, docs, rows, chunk)
    if any(f.dv for f in fields):
        files["_0.dvm"], files["_0.dvd"] = columns(fields, docs, sets)
    lengths: dict[int, list[int]] = {}
    terms = _Terms(words)
    for f in fields:
        if f.options:
            lengths[f.number], found, *post = inverted(docs[f.name])
            if found:
                terms.add(f, found, *post)
    if any(f.options for f in fields):
        files["_0.tim"], files["_0.tip"], files["_0.doc"] = terms.files()
        if any(f.options >= 3 for f in fields):
            files["_0.pos"] = closed(head("positions"))
        if any(f.options >= 4 for f in fields):
            files["_0.pay"] = closed(head("payloads"))
    if any(f.options and f.norms for f in fields):
        files[".nvm"], files[".nvd"] = norms(fields, lengths)
    pointed = {}
    dim = head("points")
    for f in fields:
        if f.points:
            own = [i for i, v in enumerate(docs[f.name]) if v is not None]
            if own:
                body, pointed[f.number] = tree(np.array(own), _packed_points([docs[f.name][i] for i in own], f.points), len(dim), leaf)
                dim += body
    if pointed:
        files[".dim"] = closed(dim)
        files[".dii"] = closed(head("points-index") + put_varied(len(pointed)) + b"".join(put_varied(n) + put_varied(p) for n, p in pointed.items()))
    if compound:
        cfs, entries = head("compound"), b""
        for n, raw in files.items():
            entries += put_text(n) + _i(len(cfs)) + _i(len(raw))
            cfs += raw
        files = {".cfs": closed(cfs), ".cfe": closed(head("entries") + put_varied(len(files)) + entries)}
    listed = [name + n for n in files] + [name + ".si"]
    files[".si"] = closed(head("segment") + b"".join(_i(v, 4) for v in (6, 6, 0)) + _i(rows, 4) + bytes([1 if compound else 0xFF]) + _pairs({"source": "rows"}) + _texts(listed) + _pairs({}) + put_varied(0))
    return {name + n: raw for n, raw in files.items()}


def commit(names: list[str], counter: int = 0, user_data: dict[str, str] | None = None) -> bytes:
    body = head("segments") + bytes([6, 6, 0]) + _i(len(names)) + _i(counter, 4) + _i(len(names), 4) + bytes([6, 6, 0])
    for n in names:
        body += put_text(n) + b"\1" + _ID + put_text("rows") + _i(-1) + _i(0, 4) + _i(-1) + _i(-1) + _texts([]) + _i(0, 4)
    return closed(body + _pairs(user_data or {}))


def portions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of ``batches`` in their order, as tables of ROWS or BYTES at most; one row may be longer."""
    kept: list[pa.RecordBatch] = []
    rows = size = 0
    for b in batches:
        at = 0
        while at < b.num_rows:
            own = b.slice(at, min(SLICE, ROWS - rows))
            while own.num_rows > 1 and size + own.nbytes > BYTES:
                own = own.slice(0, own.num_rows // 2)
            if kept and size + own.nbytes > BYTES:
                yield pa.Table.from_batches(kept)
                kept, rows, size = [], 0, 0
                continue
            kept.append(own)
            at, rows, size = at + own.num_rows, rows + own.num_rows, size + own.nbytes
            if rows == ROWS:
                yield pa.Table.from_batches(kept)
                kept, rows, size = [], 0, 0
    if kept:
        yield pa.Table.from_batches(kept)


def write_segments(df: DataFrame, path: str, fields: list[Field], compound: bool = False) -> list[str]:
    """Write every partition of ``df`` as a segment, or as several of ROWS rows or BYTES at most, each under a name of its
    own, so that a task that runs again leaves files that no commit names; gives the names. Rows are numbered in the
    order in which their partition has them. An empty partition gives no segment. A null is no value, in any column;
    a number that isn't finite is stored as it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = open_path(path)
        for docs in map(pa.Table.to_pydict, portions(batches)):  # null is None in every type, and no number changes
            system.create_dir(root, recursive=True)
            name = "_" + uuid.uuid4().hex
            for n, raw in segment(name, fields, docs, compound).items():
                with system.open_output_stream(f"{root}/{n}") as out:
                    out.write(raw)
            yield pa.record_batch([pa.array([name]), pa.array([len(docs[fields[0].name])])], names=["name", "docs"])

    return sorted(r.name for r in df.select(*[f.name for f in fields]).mapInArrow(run, "name string, docs long").collect())  # a row for each segment


def write_commit(path: str, names: list[str], generation: str, user_data: dict[str, str] | None = None) -> None:
    """Name the segments of the index; a reader sees them from then on. The file gets its name when it is whole."""
    system, root = open_path(path)
    system.create_dir(root, recursive=True)
    with system.open_output_stream(f"{root}/pending_{generation}") as out:
        out.write(commit(names, user_data=user_data))
    system.move(f"{root}/pending_{generation}", f"{root}/segments_{generation}")


def write_index(df: DataFrame, path: str, fields: list[Field], compound: bool = False, generation: str = "1") -> list[str]:
    """Write ``df`` as an index: segments, then the commit point that names them."""
    names = write_segments(df, path, fields, compound)
    write_commit(path, names, generation)
    return names
