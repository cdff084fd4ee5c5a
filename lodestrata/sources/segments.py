"""Files of a segmented index: commit points, segments and the structures in them, decoded from bytes.

Everything works on ranges of files that are read a page at a time, so that a task holds a page and a batch of
rows and not a file. Deleted documents are given like any others, since no file here tells which they are.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
from pyarrow import fs

from ..functions.codec import Corrupt, Cursor, bytes_for, lz4_decode, unpack, unzigzag

MAGIC, END_MAGIC = 0x3FD76C17, 0xC02893E8
BLOCK = 128  #: values of a packed block of postings
PAGE = 256 << 10  #: bytes read at once
NONE_MISSING, ALL_MISSING = -1, -2
NUMERIC, BINARY, SORTED, SORTED_SET, SORTED_NUMERIC = range(5)
DELTA, GCD, TABLE, MONOTONIC, CONST, SPARSE = range(6)
FIXED, VARIABLE, PREFIX = range(3)
ADDRESSES, SINGLE, SETS = range(3)
_DV = ("numeric", "binary", "sorted", "sorted_set", "sorted_numeric")
_NUMBER_FORMATS = ("DELTA", "GCD", "TABLE", "MONOTONIC", "CONST", "SPARSE")


class Unsupported(Corrupt):
    """A layout that is known and not decoded here."""


class Pages(Cursor):
    """A cursor over a range of an open file."""

    def __init__(self, f, base: int, length: int):
        super().__init__(b"", 0, length)
        self.f, self.base, self.low = f, base, 0

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > self.end:
            raise Corrupt(f"{n} bytes wanted at {self.at}, the data end at {self.end}")
        i = self.at - self.low
        if i < 0 or i + n > len(self.data):
            self.f.seek(self.base + self.at)
            self.data, self.low, i = self.f.read(min(max(n, PAGE), self.end - self.at)), self.at, 0
            if len(self.data) < n:
                raise Corrupt(f"the file ends before {self.base + self.at + n}")
        self.at += n
        return self.data[i : i + n]

    def part(self, at: int, n: int) -> bytes:
        self.at = at
        return self.take(n)


def header(c: Cursor, named: bool = True) -> dict:
    """Magic number, codec name and version; with ``named`` also id and suffix."""
    magic = c.u(4)
    if magic != MAGIC:
        raise Corrupt(f"no header: {magic:08x}")
    found = {"magic": magic, "codec": c.text(), "format_version": c.u(4), "object_id": None, "suffix_length": None, "suffix": None}
    if named:
        found["object_id"] = c.take(16).hex()
        found["suffix_length"] = c.u(1)
        found["suffix"] = c.take(found["suffix_length"]).decode()
    return found


def footer(c: Pages) -> dict:
    """The last 16 bytes, and the CRC-32 of all but the last 8, read in pages."""
    c.at = c.end - 16
    found = {"footer_magic": c.u(4), "checksum_algo": c.u(4), "checksum_expected": c.u(8)}
    c.at, crc = 0, 0
    while c.at < c.end - 8:
        crc = zlib.crc32(c.take(min(PAGE, c.end - 8 - c.at)), crc)
    found |= {"checksum_actual": crc, "ok": found["footer_magic"] == END_MAGIC and crc == found["checksum_expected"]}
    return found


def open_path(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _whole(system: fs.FileSystem, path: str) -> Pages:
    f = system.open_input_file(path)
    return Pages(f, 0, f.size())


def commit(system: fs.FileSystem, root: str, generation: str) -> dict:
    """The commit point ``segments_<generation>`` with its segments, in order."""
    c = _whole(system, f"{root}/segments_{generation}")
    found = {"generation": generation} | {k: v for k, v in header(c).items() if k in ("codec", "format_version", "object_id")}
    found["index_version"] = ".".join(str(c.u(1)) for _ in range(3))
    found["index_update_count"], found["name_counter"], n = c.i64(), c.u(4), c.u(4)
    found["segment_count"], found["min_segment_version"] = n, ".".join(str(c.u(1)) for _ in range(3))
    found["segments"] = []
    for _ in range(n):
        s = {"seg_name": c.text(), "has_segment": c.u(1) == 1, "segment_id": c.take(16).hex(), "codec": c.text(), "del_gen": c.i64(), "del_count": c.u(4)}
        s |= {"field_info_gen": c.i64(), "doc_values_gen": c.i64(), "field_info_files": c.texts(), "dv_field_count": c.u(4)}
        s["dv_fields"] = {c.u(4): c.texts() for _ in range(s["dv_field_count"])}
        found["segments"].append(s)
    found["user_data"] = c.pairs()
    return found


def latest(system: fs.FileSystem, root: str) -> str:
    """The generation of the newest commit point: the greatest in base 36."""
    names = [f.base_name[9:] for f in system.get_file_info(fs.FileSelector(root)) if f.base_name.startswith("segments_")]
    if not names:
        raise FileNotFoundError(f"no commit point in {root}")
    return max(names, key=lambda n: int(n, 36))


RANGES = (DELTA, GCD, TABLE, CONST)  #: formats of numbers that can be decoded from any place


def ranged(one: dict) -> bool:
    """Whether the values of a field, by its meta data, can be decoded for a range of documents."""
    return one["type"] == NUMERIC and one["numeric"]["format"] in RANGES


def packed(c: Cursor, n: int, bits: int) -> np.ndarray:
    return unpack(c.take(bytes_for(n, bits)), n, bits).astype(np.int64)


class Segment:
    """One segment: its description, its files, loose or in a compound file, and their structures."""

    def __init__(self, system: fs.FileSystem, root: str, name: str):
        self.system, self.root, self.name = system, root, name
        self.read_blocks = self.read_leaves = 0  # of terms and of points, so far

    @cached_property
    def info(self) -> dict:
        c = _whole(self.system, f"{self.root}/{self.name}.si")
        header(c)
        found = {"version": ".".join(str(c.u(4)) for _ in range(3)), "segment_size": c.u(4), "is_compound_file": c.u(1) != 0xFF}
        found |= {"diagnostics": c.pairs(), "files": c.texts(), "attributes": c.pairs(), "num_sort_fields": c.vint()}
        if found["num_sort_fields"]:
            raise Unsupported(f"segment {self.name} is sorted")
        return found

    @property
    def size(self) -> int:
        return self.info["segment_size"]

    @cached_property
    def entries(self) -> dict[str, tuple[int, int]]:
        """Files inside the compound file."""
        if not self.info["is_compound_file"]:
            return {}
        c = _whole(self.system, f"{self.root}/{self.name}.cfe")
        header(c)
        return {name: (at, n) for name, at, n in ((c.text(), c.i64(), c.i64()) for _ in range(c.vint()))}

    @cached_property
    def files(self) -> list[str]:
        """Loose files of the segment, without folders."""
        listed = self.info["files"]
        if listed:
            return sorted(listed)
        own = (f.base_name for f in self.system.get_file_info(fs.FileSelector(self.root)) if f.is_file)
        return sorted(n for n in own if n.startswith((self.name + ".", self.name + "_")))

    def open(self, extension: str) -> Pages | None:
        """The logical file of this extension; None if the segment has none."""
        for name, (at, n) in self.entries.items():
            if name.endswith(extension):
                return Pages(self.system.open_input_file(f"{self.root}/{self.name}.cfs"), at, n)
        for name in self.files:
            if name.endswith(extension):
                return _whole(self.system, f"{self.root}/{name}")
        return None

    def all_files(self) -> Iterator[tuple[str, Pages]]:
        for name in self.files:
            yield name, _whole(self.system, f"{self.root}/{name}")
        for name, (at, n) in self.entries.items():
            yield self.name + name, Pages(self.system.open_input_file(f"{self.root}/{self.name}.cfs"), at, n)

    @cached_property
    def fields(self) -> dict[int, dict]:
        c = self.open(".fnm")
        if c is None:
            return {}
        header(c)
        found = {}
        for _ in range(c.vint()):
            f = {"field_name": c.text(), "field_number": c.vint(), "field_bits": c.u(1), "index_option_bits": c.u(1), "doc_values_bits": c.u(1), "doc_values_gen": c.i64(), "attributes": c.pairs(), "dimension_count": c.vint()}
            f["dimension_member_bytes"] = c.vint() if f["dimension_count"] else 0
            f |= {"store_term_vec": bool(f["field_bits"] & 1), "omit_norm": bool(f["field_bits"] & 2), "store_payload": bool(f["field_bits"] & 4)}
            found[f["field_number"]] = f
        return found

    # stored documents

    @cached_property
    def _chunks(self) -> tuple[int, list[dict], int]:
        c = self.open(".fdx")
        if c is None:
            return 0, [], 0
        header(c)
        version = c.vint()
        found, block = [], 0
        while n := c.vint():
            base, average, bits = c.vint(), c.vint(), c.vint()
            docs = [base + average * i + unzigzag(int(d)) for i, d in enumerate(packed(c, n, bits))]
            base, average, bits = c.vlong(), c.vlong(), c.vint()
            at = [base + average * i + unzigzag(int(d)) for i, d in enumerate(packed(c, n, bits))]
            found += [{"block_id": block, "chunk_id": i, "doc_base": d, "start_pointer": p} for i, (d, p) in enumerate(zip(docs, at))]
            block += 1
        return version, found, c.vlong()

    def chunks(self) -> list[dict]:
        """Chunks of stored documents: first document and start of each."""
        return self._chunks[1]

    def stored_info(self) -> dict | None:
        """Chunk size, the place where the chunks end, and the numbers of chunks and of those that weren't full when
        they were written, which follow there; ``tail_ok``: these are the last bytes before the footer."""
        c = self.open(".fdt")
        if c is None:
            return None
        header(c)
        found = {"chunk_size": c.vint(), "packed_version": self._chunks[0], "max_pointer": self._chunks[2]}
        c.at = found["max_pointer"]
        found |= {"num_chunks": c.vlong(), "num_dirty_chunks": c.vlong()}
        return found | {"tail_ok": c.at == c.end - 16 and found["num_chunks"] == len(self.chunks())}

    def chunk(self, c: Pages, at: int, chunk_size: int) -> tuple[int, np.ndarray, np.ndarray, bytes]:
        """First document, fields of each document, where each begins and ends, and the chunk's bytes."""
        c.at = at
        base, token = c.vint(), c.vint()
        n = token >> 1
        if n == 1:
            counts, lengths = np.array([c.vint()]), np.array([c.vint()])
        else:
            counts, lengths = self._spread(c, n), self._spread(c, n)
        off = np.concatenate([[0], np.cumsum(lengths)])
        if not token & 1:
            return base, counts, off, lz4_decode(c, int(off[-1])) if off[-1] else b""
        parts, left = [], int(off[-1])
        while left > 0:  # a very long document is compressed slice by slice
            parts.append(lz4_decode(c, min(left, chunk_size)))
            left -= len(parts[-1])
        return base, counts, off, b"".join(parts)

    @staticmethod
    def _spread(c: Cursor, n: int) -> np.ndarray:
        bits = c.vint()
        if bits > 31:
            raise Corrupt(f"a width of {bits} bits")
        return packed(c, n, bits) if bits else np.full(n, c.vint())

    def stored(self, starts: list[int]) -> Iterator[dict]:
        c = self.open(".fdt")
        header(c)
        chunk_size = c.vint()
        for at in starts:
            base, counts, off, data = self.chunk(c, at, chunk_size)
            for i, n in enumerate(counts.tolist()):
                d = Cursor(data, int(off[i]), int(off[i + 1]))
                for ord_ in range(n):
                    code = d.vlong()
                    number, tag = code >> 3, code & 7
                    if number not in self.fields or tag > 5:
                        raise Corrupt(f"field {number} with type {tag} in document {base + i}")
                    row = {"doc_id": base + i, "ord": ord_, "doc_start_ptr": int(off[i]), "field_number": number, "field_name": self.fields[number]["field_name"], "type_tag": tag}
                    row[("str", "bin", "int", "float", "long", "double")[tag]] = (d.text, d.blob, d.zint, d.zfloat, d.tlong, d.zdouble)[tag]()
                    yield row

    # columns

    def dv_meta(self) -> list[dict]:
        """A dictionary for each field: its type and the entries by role."""
        c = self.open(".dvm")
        if c is None:
            return []
        header(c)
        found = []
        while (number := c.vint()) != 0xFFFFFFFF:
            info, kind = self.fields[number], c.u(1)
            one: dict = {"info": info, "type": kind}
            if kind == NUMERIC:
                one["numeric"] = self._number_entry(c, number)
            elif kind == BINARY:
                one["binary"] = self._binary_entry(c)
            elif kind == SORTED:
                self._next(c, number, BINARY)
                one["binary"] = self._binary_entry(c)
                self._next(c, number, NUMERIC)
                one["ord"] = self._number_entry(c, number)
            elif kind in (SORTED_SET, SORTED_NUMERIC):
                one["ss"] = ss = self._set_entry(c)
                if kind == SORTED_SET:
                    if ss["format"] == SINGLE:
                        self._next(c, number, SORTED)
                    self._next(c, number, BINARY)
                    one["binary"] = self._binary_entry(c)
                    role = "ord"
                else:
                    role = "ord" if ss["format"] == SETS else "numeric"
                self._next(c, number, NUMERIC)
                one[role] = self._number_entry(c, number)
                if ss["format"] == ADDRESSES:
                    self._next(c, number, NUMERIC)
                    one["ord_index"] = self._number_entry(c, number)
            else:
                raise Corrupt(f"field {number} has values of type {kind}")
            found.append(one)
        return found

    @staticmethod
    def _next(c: Cursor, number: int, kind: int) -> None:
        if (c.vint(), c.u(1)) != (number, kind):
            raise Corrupt(f"an entry of field {number} and type {kind} is missing")

    @staticmethod
    def _blocks(c: Cursor, n: int, shift: int) -> list[tuple[int, float, int, int]]:
        return [(c.i64(), float(np.frombuffer(c.take(4), ">f4")[0]), c.i64(), c.u(1)) for _ in range(-(-n >> shift))]

    def _number_entry(self, c: Cursor, number: int) -> dict:
        e: dict = {"format": c.vint(), "missing_offset": c.i64()}
        if e["format"] == SPARSE:
            e["docs"], e["shift"] = c.vlong(), c.vint()
            e["blocks"] = self._blocks(c, e["docs"], e["shift"])
        e["offset"], e["count"] = c.i64(), c.vlong()
        kind = e["format"]
        if kind == CONST:
            e["min_value"] = c.i64()
        elif kind == DELTA:
            e["min_value"], e["bits_per_value"] = c.i64(), c.vint()
        elif kind == GCD:
            e["min_value"], e["gcd"], e["bits_per_value"] = c.i64(), c.i64(), c.vint()
        elif kind == TABLE:
            n = c.vint()
            if n > 255:
                raise Corrupt(f"a table of {n} values")
            e["table"], e["bits_per_value"] = [c.i64() for _ in range(n)], c.vint()
        elif kind == MONOTONIC:
            e["shift"] = c.vint()
            e["blocks"] = self._blocks(c, e["count"] + 1, e["shift"])
        elif kind == SPARSE:
            c.u(1)
            self._next(c, number, NUMERIC)
            e["values"] = self._number_entry(c, number)
        else:
            raise Corrupt(f"numbers in format {kind}")
        e["end_offset"] = c.i64()
        return e

    def _binary_entry(self, c: Cursor) -> dict:
        e = {"format": c.vint(), "missing_offset": c.i64(), "min_length": c.vint(), "max_length": c.vint(), "count": c.vlong(), "offset": c.i64()}
        if e["format"] == VARIABLE:
            e["addr_offset"], e["shift"] = c.i64(), c.vint()
            e["blocks"] = self._blocks(c, e["count"] + 1, e["shift"])
            e["addr_end_offset"] = c.i64()
        elif e["format"] == PREFIX:
            e |= {"addr_offset": c.i64(), "pack_ints_version": c.vint(), "block_size": c.vint(), "reversed_index_offset": c.i64()}
        elif e["format"] != FIXED:
            raise Corrupt(f"bytes in format {e['format']}")
        return e

    @staticmethod
    def _set_entry(c: Cursor) -> dict:
        e: dict = {"format": c.vint()}
        if e["format"] == SETS:
            n = c.u(4)
            if n > 256:
                raise Corrupt(f"a table of {n} values")
            e["table"] = [c.i64() for _ in range(n)]
            e["offsets"] = [0, *np.cumsum([c.u(4) for _ in range(c.u(4))]).tolist()]
        elif e["format"] not in (ADDRESSES, SINGLE):
            raise Corrupt(f"sets in format {e['format']}")
        return e

    @staticmethod
    def _monotonic(d: Pages, at: int, n: int, e: dict) -> np.ndarray:
        out, step = np.empty(n, np.int64), 1 << e["shift"]
        for b, (low, average, offset, bits) in enumerate(e["blocks"]):
            lo, k = b * step, min(step, n - b * step)
            line = (np.float32(average) * np.arange(k, dtype=np.float32)).astype(np.int64)
            delta = unpack(d.part(at + offset, bytes_for(k, bits)), k, bits).astype(np.int64) if bits else 0
            out[lo : lo + k] = low + line + delta
        return out

    def _numbers(self, d: Pages, e: dict, n: int, lo: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Values and whether each of ``n`` places from ``lo``, a multiple of 8, has one; the formats in RANGES are
        decoded from there, others must begin at 0."""
        kind = e["format"]
        if kind == SPARSE:
            docs = self._monotonic(d, e["missing_offset"], e["docs"], e)
            values, there = np.zeros(n, np.int64), np.zeros(n, bool)
            values[docs], there[docs] = self._numbers(d, e["values"], e["docs"])[0], True
            return values, there
        if kind == CONST:
            values = np.full(n, e["min_value"])
        elif kind == MONOTONIC:
            return self._monotonic(d, e["offset"], n, e), np.ones(n, bool)
        else:
            bits = e["bits_per_value"]
            raw = unpack(d.part(e["offset"] + lo * bits // 8, bytes_for(n, bits)), n, bits).astype(np.int64)
            values = np.array(e["table"], np.int64)[raw] if kind == TABLE else raw * np.int64(e.get("gcd", 1)) + np.int64(e["min_value"])
        return values, self._there(d, e["missing_offset"], n, lo)

    @staticmethod
    def _there(d: Pages, at: int, n: int, lo: int = 0) -> np.ndarray:
        if at in (NONE_MISSING, ALL_MISSING):
            return np.full(n, at == NONE_MISSING)
        return np.unpackbits(np.frombuffer(d.part(at + lo // 8, -(-n // 8)), np.uint8), count=n, bitorder="little").astype(bool)

    def _bytes(self, d: Pages, e: dict) -> list[bytes]:
        if e["format"] == FIXED:
            n = e["max_length"]
            raw = d.part(e["offset"], e["count"] * n)
            return [raw[i * n : i * n + n] for i in range(e["count"])]
        if e["format"] == PREFIX:
            raise Unsupported("prefix-compressed bytes")
        off = self._monotonic(d, e["addr_offset"], e["count"] + 1, e).tolist()
        raw = d.part(e["offset"], off[-1])
        return [raw[a:b] for a, b in zip(off, off[1:])]

    def dv_values(self, name: str, lo: int = 0, hi: int | None = None) -> Iterator[dict]:
        """``doc_id, ord, long_value, bin_value`` of every value of a field in the documents from ``lo`` to before
        ``hi``; of sorted ones the place in the dictionary is the long value."""
        for doc, ord_, values, words in self.dv_arrays(name, lo, hi):
            for k, (i, o) in enumerate(zip(doc.tolist(), ord_.tolist())):
                v = None if values is None else int(values[k])
                yield {"field_name": name, "doc_id": i, "ord": o, "long_value": v, "bin_value": None if words is None else words[k if v is None else v]}

    def dv_arrays(self, name: str, lo: int = 0, hi: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray | None, list[bytes] | None]]:
        """What ``dv_values`` gives, as arrays: documents, places within them, numbers, and bytes, which the numbers
        choose or, without numbers, one of each document."""
        one = next(o for o in self.dv_meta() if o["info"]["field_name"] == name)
        hi = self.size if hi is None else min(hi, self.size)
        if lo >= hi:
            return
        doc, values, words = self._dv_arrays(one, lo - lo % 8, hi) if ranged(one) else self._dv_arrays(one, 0, self.size)
        ord_ = np.arange(len(doc)) - np.searchsorted(doc, doc)
        own = slice(*np.searchsorted(doc, [lo, hi]).tolist())
        yield doc[own], ord_[own], None if values is None else values[own], words[own] if values is None else words

    def _dv_arrays(self, one: dict, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray | None, list[bytes] | None]:
        d, kind, n = self.open(".dvd"), one["type"], hi - lo
        if kind == BINARY:
            there = self._there(d, one["binary"]["missing_offset"], n)
            return np.flatnonzero(there), None, [v for v, t in zip(self._bytes(d, one["binary"]), there.tolist()) if t]
        words = self._bytes(d, one["binary"]) if "binary" in one else None
        form = one["ss"]["format"] if "ss" in one else SINGLE
        if form == ADDRESSES:
            off = self._numbers(d, one["ord_index"], n + 1)[0]
            values = self._numbers(d, one["numeric" if words is None else "ord"], int(off[-1]))[0]
            doc = np.repeat(np.arange(n), np.diff(off))
        elif form == SETS:
            off, table = np.array(one["ss"]["offsets"]), np.array(one["ss"]["table"], np.int64)
            which = self._numbers(d, one["ord"], n)[0]
            sizes = off[which + 1] - off[which]
            doc = np.repeat(np.arange(n), sizes)
            values = table[np.repeat(off[which], sizes) + np.arange(len(doc)) - np.repeat(np.cumsum(sizes) - sizes, sizes)]
        else:
            values, there = self._numbers(d, one["ord" if "ord" in one else "numeric"], n, lo)
            doc = np.flatnonzero(there if words is None else there & (values >= 0))
            values = values[doc]
            doc = doc + lo
        return doc, values, words

    def norm_fields(self) -> list[tuple[int, int, int]]:
        """(field, bytes of a value, offset) of the fields with norms."""
        c = self.open(".nvm")
        if c is None:
            return []
        header(c)
        found = []
        while (number := c.vint()) != 0xFFFFFFFF:
            info = self.fields[number]
            if not info["index_option_bits"] or info["omit_norm"]:
                raise Corrupt(f"field {info['field_name']} must not have norms")
            found.append((number, c.u(1), c.i64()))
        return found

    def norms(self, number: int, lo: int = 0, hi: int | None = None) -> np.ndarray:
        """Norms of the documents from ``lo`` to before ``hi``; only their bytes are read."""
        n = max(0, (self.size if hi is None else min(hi, self.size)) - lo)
        width, at = next((w, o) for f, w, o in self.norm_fields() if f == number)
        if not width or not n:
            return np.full(n, at)
        raw = np.frombuffer(self.open(".nvd").part(at + width * lo, width * n), np.uint8).reshape(-1, width).astype(np.int64)
        return sum((raw[:, k] << (8 * (width - 1 - k)) for k in range(width)), np.zeros(n, np.int64))

    # points

    def point_fields(self) -> dict[int, int]:
        c = self.open(".dii")
        if c is None:
            return {}
        header(c)
        return {f: p for f, p in ((c.vint(), c.vlong()) for _ in range(c.vint()))}

    def tree(self, number: int, c: Pages) -> dict:
        c.at = self.point_fields()[number]
        version = header(c, named=False)["format_version"]
        t = {"version": version, "num_dims": c.vint(), "max_points_in_leaf": c.vint(), "bytes_per_dim": c.vint(), "num_leaves": c.vint()}
        if version < 4 or not t["num_leaves"]:
            raise Unsupported(f"a tree of version {version} with {t['num_leaves']} leaves")
        size = t["num_dims"] * t["bytes_per_dim"]
        return t | {"min_packed": c.take(size), "max_packed": c.take(size), "point_count": c.vlong(), "doc_count": c.vint(), "index": c.blob()}

    @staticmethod
    def leaves(t: dict) -> list[tuple[int, list[bytes], list[bytes]]]:
        """Where the leaves begin, left to right, with the least and the greatest value that each may have on every
        dimension. A node is given by its number; a right child adds to the pointer that it inherits, a left one
        has it; a split value is written as its difference from the last one of its dimension."""
        c, dims, size, first = Cursor(t["index"]), t["num_dims"], t["bytes_per_dim"], t["num_leaves"]
        cut = lambda raw: [raw[d * size : (d + 1) * size] for d in range(dims)]
        out: list[tuple[int, list[bytes], list[bytes]]] = []
        # node, place in the index, pointer, whether left, last split values, which were met going left, bounds
        todo: list[tuple] = [(1, 0, 0, False, [bytes(size)] * dims, [False] * dims, cut(t["min_packed"]), cut(t["max_packed"]))]
        while todo:
            node, at, pointer, left, last, negative, low, high = todo.pop()
            c.at = at
            if not left:
                pointer += c.vlong()
            if node >= first:
                out.append((pointer, low, high))
                continue
            code = c.vint()
            d, prefix, differs = code % dims, code // dims % (1 + size), code // dims // (1 + size)
            value = last[d][:prefix]
            if prefix < size:
                byte = last[d][prefix] + (-differs if negative[d] else differs)
                if not 0 <= byte < 256:
                    raise Corrupt(f"a split value that isn't one at node {node}")
                value += bytes([byte]) + c.take(size - prefix - 1)
            skip = c.vint() if node * 2 < first else 0
            put = lambda old, new, d=d: [*old[:d], new, *old[d + 1 :]]
            now = put(last, value)
            todo += [(node * 2 + 1, c.at + skip, pointer, False, now, put(negative, False), put(low, value), high), (node * 2, c.at, pointer, True, now, put(negative, True), low, put(high, value))]
        return out

    def points(self, number: int, box: dict[int, tuple[bytes, bytes]] | None = None) -> Iterator[tuple[int, list[int], np.ndarray]]:
        """(leaf, documents, documents x dimensions x bytes) of every leaf; with ``box`` only of those which may hold
        a value between the two of any of its dimensions. Leaves that can't aren't read."""
        c = self.open(".dim")
        t = self.tree(number, c)
        dims, size = t["num_dims"], t["bytes_per_dim"]
        for k, (at, low, high) in enumerate(self.leaves(t)):
            if box is not None and not any(a <= high[d] and low[d] <= b for d, (a, b) in box.items()):
                continue
            self.read_leaves += 1
            c.at = at
            n, mode = c.vint(), c.u(1)
            if mode == 0:
                docs = np.cumsum([c.vint() for _ in range(n)]).tolist()
            elif mode in (24, 32):
                own = np.frombuffer(c.take(n * (mode // 8)), np.uint8).reshape(n, mode // 8).astype(np.int64)
                docs = sum(own[:, k] << 8 * (mode // 8 - 1 - k) for k in range(mode // 8)).tolist()
            else:
                raise Corrupt(f"documents of a leaf in {mode} bits")
            out, prefix = np.zeros((n, dims, size), np.uint8), []
            for d in range(dims):
                prefix.append(c.vint())
                out[:, d, : prefix[d]] = np.frombuffer(c.take(prefix[d]), np.uint8)
            runs = c.u(1)
            if runs >= dims and runs != 0xFF:
                raise Corrupt(f"runs in dimension {runs} of {dims}")
            i = 0
            while i < n:
                run = n
                if runs != 0xFF:
                    byte, run = c.u(1), c.u(1)
                    if i == 0:
                        prefix[runs] += 1
                    if not run or i + run > n:
                        raise Corrupt("runs don't cover the leaf")
                    out[i : i + run, runs, prefix[runs] - 1] = byte
                rest = [size - p for p in prefix]
                raw = np.frombuffer(c.take(run * sum(rest)), np.uint8).reshape(run, sum(rest))
                for d in range(dims):
                    out[i : i + run, d, prefix[d] :] = raw[:, sum(rest[:d]) : sum(rest[: d + 1])]
                i += run
            yield k, docs, out

    # terms and postings

    @cached_property
    def term_fields(self) -> dict[int, dict]:
        c, tip = self.open(".tim"), self.open(".tip")
        if c is None:
            return {}
        for f in (c, tip):
            f.at = f.end - 24
            f.at = f.i64()
        found = {}
        for _ in range(c.vint()):
            number, terms = c.vint(), c.vlong()
            root, info = c.blob(), self.fields[number]
            t = {"field_number": number, "field_name": info["field_name"], "num_terms": terms, "num_bytes": len(root), "root_code": root, "index_opts": info["index_option_bits"], "index_start_ptr": tip.vlong()}
            t["sum_total_term_freq"] = -1 if info["index_option_bits"] == 1 else c.vlong()
            t |= {"sum_doc_freq": c.vlong(), "doc_count": c.vint(), "longs_size": c.vint(), "min_term": c.blob(), "max_term": c.blob()}
            found[number] = t
        if c.at != c.end - 24:
            raise Corrupt("the directory of fields doesn't end where it should")
        return found

    def automaton(self, number: int) -> dict:
        """The header of a field's index of prefixes. It isn't walked: Spark sorts and filters the terms."""
        c = self.open(".tip")
        c.at = self.term_fields[number]["index_start_ptr"]
        version = header(c, named=False)["format_version"]
        if version < 5 or c.u(1) == 1:
            raise Unsupported("a packed automaton, or one of an older version")
        found = {"field_name": self.fields[number]["field_name"], "format_version": version, "empty_output": c.blob()[::-1] if c.u(1) == 1 else None}
        kind = c.u(1)
        if kind > 2:
            raise Corrupt(f"an automaton over inputs of kind {kind}")
        return found | {"input_bytes": 1 << kind, "start_node": c.vlong(), "num_bytes": c.vlong()}

    def terms(self, number: int, within: list[tuple[bytes, bytes | None]] | None = None) -> Iterator[dict]:
        """Terms in the order of their bytes, with statistics and pointers; with ``within`` only those in one of these
        closed intervals (None: without end). Blocks of prefixes that none has, and those behind the last, aren't
        read; ``term_ord`` is then known only up to the first gap, and null behind it."""
        c, t, info = self.open(".tim"), self.term_fields[number], self.fields[number]
        opts = info["index_option_bits"]
        if t["longs_size"] != 1 + (opts >= 3) + (opts >= 3 and (opts >= 4 or info["store_payload"])):
            raise Corrupt(f"field {info['field_name']} has {t['longs_size']} pointers a term")
        gap = False

        def may(low: bytes, end: bytes | None) -> bool:
            """Whether terms from ``low`` to before ``end`` may be wanted."""
            return within is None or any((b is None or low <= b) and (end is None or a < end) for a, b in within)

        def after(prefix: bytes) -> bytes | None:
            """The least bytes behind all that begin with ``prefix``."""
            kept = prefix.rstrip(b"\xff")
            return kept[:-1] + bytes([kept[-1] + 1]) if kept else None

        def block(at: int, prefix: bytes, floors: list[tuple[bytes, int]]) -> Iterator[dict]:
            nonlocal gap
            spots = [(prefix, at), *floors] if floors else None
            last, k = False, 0
            while not last:  # a floor block is followed by others of the same prefix
                if spots:
                    end = spots[k + 1][0] if k + 1 < len(spots) else after(prefix)
                    low, at = spots[k]
                    k += 1
                    if not may(low, end):
                        gap, last = True, k == len(spots)
                        continue
                self.read_blocks += 1
                c.at = at
                code = c.vint()
                n, last = code >> 1, code & 1
                if not n:
                    raise Corrupt(f"an empty block at {at}")
                code = c.vint()
                leaf = code & 1
                suffixes, stats, meta = Cursor(c.take(code >> 1)), Cursor(c.blob()), Cursor(c.blob())
                end, fp = c.at, [0, 0, 0]
                for _ in range(n):
                    code = suffixes.vint()
                    term = prefix + suffixes.take(code if leaf else code >> 1)
                    if within is not None and all(b is not None and term > b for _, b in within):
                        return
                    if not leaf and code & 1:
                        sub = at - suffixes.vlong()
                        if may(term, after(term)):
                            yield from block(sub, term, [])
                        else:
                            gap = True
                        continue
                    df = stats.vint()
                    row = {"term": term, "doc_freq": df, "total_term_freq": df + stats.vlong() if opts != 1 else df}
                    for j in range(t["longs_size"]):
                        fp[j] += meta.vlong()
                    row |= {"doc_start_fp": fp[0], "pos_start_fp": fp[1], "payload_start_fp": fp[2], "singleton_doc_id": meta.vint() if df == 1 else -1}
                    if opts >= 3 and row["total_term_freq"] > BLOCK:
                        meta.vlong()
                    row["skip_offset"] = meta.vlong() if df > BLOCK else -1
                    yield row | {"gap": gap}
                at = end

        code = Cursor(t["root_code"])
        root = code.vlong()
        floors = []
        if root & 1:
            floors = [(code.take(1), (root >> 2) + (code.vlong() >> 1)) for _ in range(code.vint())]
        wanted = lambda term: within is None or any(a <= term and (b is None or term <= b) for a, b in within)
        for n, row in enumerate(block(root >> 2, b"", floors)):
            if wanted(row["term"]):
                yield {"field_name": t["field_name"], "term_ord": None if row.pop("gap") else n} | row

    def postings(self, number: int, within: list[tuple[bytes, bytes | None]] | None = None) -> Iterator[tuple[bytes, np.ndarray, np.ndarray | None]]:
        """(term, documents, frequencies) of every term, or of those ``within`` (see ``terms``); no frequencies where
        none are indexed."""
        c = self.open(".doc")
        header(c)
        c.vint()
        widths = [(code >> 5, (code & 31) + 1) for code in (c.vint() for _ in range(32))]
        freqs = self.fields[number]["index_option_bits"] >= 2

        def values() -> np.ndarray:
            bits = c.u(1)
            if bits > 32:
                raise Corrupt(f"a block of {bits} bits")
            if not bits:
                return np.full(BLOCK, c.vint())
            kind, width = widths[bits - 1]
            if kind == 0:
                return packed(c, BLOCK, width)
            each = 64 // width
            words = np.frombuffer(c.take(8 * -(-BLOCK // each)), ">u8").astype(np.uint64)
            return ((words[:, None] >> (np.arange(each, dtype=np.uint64) * np.uint64(width))) & np.uint64((1 << width) - 1)).ravel()[:BLOCK].astype(np.int64)

        for t in self.terms(number, within):
            n = t["doc_freq"]
            if n == 1:
                yield t["term"], np.array([t["singleton_doc_id"]]), np.array([t["total_term_freq"]]) if freqs else None
                continue
            c.at = t["doc_start_fp"]
            delta, freq = np.empty(n, np.int64), np.ones(n, np.int64)
            full = n - n % BLOCK
            for lo in range(0, full, BLOCK):
                delta[lo : lo + BLOCK] = values()
                if freqs:
                    freq[lo : lo + BLOCK] = values()
            for i in range(full, n):
                code = c.vint()
                delta[i] = code >> 1 if freqs else code
                if freqs and not code & 1:
                    freq[i] = c.vint()
            yield t["term"], np.cumsum(delta), freq if freqs else None
