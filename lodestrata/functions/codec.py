"""Scalar codecs of the on-disk format, each with its inverse: cursors for the readers, whole Arrow columns for
queries. All integers are big-endian; lengths and small numbers are of variable length, 7 bits a byte."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401 - pa.compute
from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS_MS = (1, 1_000, 3_600_000, 86_400_000)


class Corrupt(ValueError):
    """Bytes that the format doesn't allow."""


class Cursor:
    """A place in bytes that are held in memory; each task has its own."""

    def __init__(self, data: bytes, at: int = 0, end: int | None = None):
        self.data, self.at, self.end = data, at, len(data) if end is None else end

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > self.end:
            raise Corrupt(f"{n} bytes wanted at {self.at}, the data end at {self.end}")
        self.at += n
        return self.data[self.at - n : self.at]

    def u(self, n: int) -> int:
        return int.from_bytes(self.take(n), "big")

    def i64(self) -> int:
        return int.from_bytes(self.take(8), "big", signed=True)

    def _varied(self, most: int) -> int:
        value = 0
        for k in range(most):
            b = self.u(1)
            value |= (b & 0x7F) << (7 * k)
            if b < 0x80:
                return value
        raise Corrupt(f"a number of more than {most} bytes ends at {self.at}")

    def vint(self) -> int:
        return self._varied(5) & 0xFFFFFFFF

    def vlong(self) -> int:
        return self._varied(9)

    def zint(self) -> int:
        return unzigzag(self.vint())

    def blob(self) -> bytes:
        return self.take(self.vint())

    def text(self) -> str:
        return self.blob().decode("utf-8")

    def texts(self) -> list[str]:
        return [self.text() for _ in range(self.vint())]

    def pairs(self, n: int | None = None) -> dict[str, str]:
        return {k: v for k, v in ((self.text(), self.text()) for _ in range(self.vint() if n is None else n))}

    def zfloat(self) -> float:
        b = self.u(1)
        if b == 0xFF:
            return struct.unpack(">f", self.take(4))[0]
        if b & 0x80:
            return float((b & 0x7F) - 1)
        return struct.unpack(">f", bytes([b]) + self.take(3))[0]

    def zdouble(self) -> float:
        b = self.u(1)
        if b == 0xFF:
            return struct.unpack(">d", self.take(8))[0]
        if b == 0xFE:
            return struct.unpack(">f", self.take(4))[0]
        if b & 0x80:
            return float((b & 0x7F) - 1)
        return struct.unpack(">d", bytes([b]) + self.take(7))[0]

    def tlong(self) -> int:
        b = self.u(1)
        low = b & 0x1F
        if b & 0x20:
            low |= self.vlong() << 5
        return unzigzag(low) * UNITS_MS[b >> 6]

    def packed(self, n: int, bits: int) -> list[int]:
        """``n`` integers of ``bits`` bits, most significant first, in whole bytes."""
        return unpack(self.take(bytes_for(n, bits)), n, bits).tolist()


def unzigzag(v: int) -> int:
    return (v >> 1) ^ -(v & 1)


def zigzag(v: int) -> int:
    return (v << 1) if v >= 0 else ((-v) << 1) - 1


def bytes_for(n: int, bits: int) -> int:
    return -(-n * bits // 8)


def words(n: int, bits: int) -> int:
    return -(-bytes_for(n, bits) // 8)


SPREAD = 8_192  #: values whose bits are spread out at once; a multiple of 8, so that every part begins with a byte


def unpack(raw: bytes, n: int, bits: int) -> np.ndarray:
    """Any width from 0 to 64, values across word borders included; SPREAD at a time, however many there are."""
    out = np.zeros(n, dtype=np.uint64)
    if not bits:
        return out
    data = np.frombuffer(raw, dtype=np.uint8)
    wide = np.zeros((min(n, SPREAD), 64), dtype=np.uint8)
    for lo in range(0, n, SPREAD):
        k = min(SPREAD, n - lo)
        wide[:k, 64 - bits :] = np.unpackbits(data[lo * bits // 8 : lo * bits // 8 + bytes_for(k, bits)], count=k * bits).reshape(k, bits)
        out[lo : lo + k] = np.packbits(wide[:k], axis=1).view(">u8").ravel()
    return out


def pack(values: list[int] | np.ndarray, bits: int, whole_words: bool = True) -> bytes:
    v = np.asarray(values, dtype=np.uint64).astype(">u8")
    flat = np.unpackbits(v.view(np.uint8).reshape(len(v), 8), axis=1)[:, 64 - bits :].ravel() if bits else np.zeros(0, np.uint8)
    raw = np.packbits(flat).tobytes()
    return raw.ljust(8 * words(len(v), bits), b"\0") if whole_words else raw


def put_varied(v: int) -> bytes:
    if v < 0:
        raise ValueError(f"{v} has no variable-length form")
    out = bytearray()
    while v >= 0x80:
        out.append(v & 0x7F | 0x80)
        v >>= 7
    out.append(v)
    return bytes(out)


def put_text(s: str | bytes) -> bytes:
    raw = s.encode() if isinstance(s, str) else s
    return put_varied(len(raw)) + raw


def put_zfloat(v: float) -> bytes:
    if -1 <= v <= 125 and v == int(v) and not (v == 0 and np.signbit(v)):
        return bytes([0x80 | int(v) + 1])
    raw = struct.pack(">f", v)
    return raw if raw[0] < 0x80 else b"\xff" + raw


def put_zdouble(v: float) -> bytes:
    if -1 <= v <= 124 and v == int(v) and not (v == 0 and np.signbit(v)):
        return bytes([0x80 | int(v) + 1])
    single = struct.unpack(">f", struct.pack(">f", v))[0] if abs(v) < 3e38 else None
    if single == v:
        return b"\xfe" + struct.pack(">f", v)
    raw = struct.pack(">d", v)
    return raw if raw[0] < 0x80 else b"\xff" + raw


def put_tlong(v: int) -> bytes:
    unit = next(k for k in (3, 2, 1, 0) if v % UNITS_MS[k] == 0)
    z = zigzag(v // UNITS_MS[unit])
    head = unit << 6 | z & 0x1F
    return bytes([head | 0x20]) + put_varied(z >> 5) if z >> 5 else bytes([head])


def lz4_decode(c: Cursor, size: int) -> bytes:
    """One block of at least ``size`` bytes: literals and copies by turns; a copy may overlap what it writes."""
    out = bytearray()
    while len(out) < size:
        token = c.u(1)
        n = token >> 4
        if n == 15:
            n += _run(c)
        out += c.take(n)
        if len(out) >= size:
            break
        back = int.from_bytes(c.take(2), "little")
        if not 0 < back <= len(out):
            raise Corrupt(f"a copy reaches {back} bytes back from {len(out)}")
        n = (token & 15) + 4
        if n == 19:
            n += _run(c)
        if back >= n:
            at = len(out) - back
            out += out[at : at + n]
        else:
            unit = bytes(out[-back:])
            out += (unit * (n // back + 1))[:n]
    return bytes(out)


def _run(c: Cursor) -> int:
    n = 0
    while (b := c.u(1)) == 255:
        n += 255
    return n + b


def lz4_encode(data: bytes) -> bytes:
    """A block of greedy matches of 4 bytes and up; the last 5 bytes are literals, as the format asks."""
    out, seen, at, start = bytearray(), {}, 0, 0

    def put(literals: bytes, back: int, n: int) -> None:
        a, b = len(literals), n - 4 if back else 0
        out.append(min(a, 15) << 4 | min(b, 15))
        for v in (a,):
            if v >= 15:
                out.extend(b"\xff" * ((v - 15) // 255) + bytes([(v - 15) % 255]))
        out.extend(literals)
        if back:
            out.extend(back.to_bytes(2, "little"))
            if b >= 15:
                out.extend(b"\xff" * ((b - 15) // 255) + bytes([(b - 15) % 255]))

    while at + 12 < len(data):
        key = data[at : at + 4]
        old = seen.get(key, -1)
        seen[key] = at
        if old >= 0 and at - old < 65_536:
            n = 4
            while at + n < len(data) - 5 and data[old + n] == data[at + n]:
                n += 1
            put(data[start:at], at - old, n)
            at += n
            start = at
        else:
            at += 1
    put(data[start:], 0, 0)
    return bytes(out)


def checksum(raw: bytes) -> int:
    """CRC-32 of all but the last 8 bytes, which hold it."""
    return zlib.crc32(raw[:-8])


# Whole columns: null for null


def _udf(kind: str):
    """An Arrow UDF that is made when it is used, as that needs a session."""

    def wrap(f):
        def column(*cols):
            return F.arrow_udf(f, kind)(*cols)

        column.__name__, column.__doc__, column.arrays = f.__name__, f.__doc__, f
        return column

    return wrap


def _there(arr: pa.Array) -> np.ndarray:
    return arr.is_valid().to_numpy(zero_copy_only=False)


def _numbers(arr: pa.Array, kind: type) -> np.ndarray:
    return arr.fill_null(0).to_numpy(zero_copy_only=False).astype(kind, copy=False)


def _joined(table: np.ndarray, n: np.ndarray, there: np.ndarray) -> pa.Array:
    """Binary values from a matrix of bytes: the first ``n`` of every row; null where there is none."""
    n = np.where(there, n, 0)
    off = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
    flat = table[np.arange(table.shape[1])[None, :] < n[:, None]]
    mask = None if there.all() else pa.py_buffer(np.packbits(there, bitorder="little").tobytes())
    return pa.Array.from_buffers(pa.binary(), len(n), [mask, pa.py_buffer(off.tobytes()), pa.py_buffer(flat.tobytes())])


def _apart(binary: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows x width) bytes of values, with zeros after their ends; their lengths; and which there are. An empty
    value or one of more bytes is an error."""
    there = _there(binary)
    off = np.frombuffer(binary.buffers()[1], dtype=np.int32)[binary.offset : binary.offset + len(binary) + 1].astype(np.int64)
    raw = np.frombuffer(binary.buffers()[2], dtype=np.uint8) if binary.buffers()[2] else np.zeros(0, np.uint8)
    n = np.where(there, np.diff(off), 0)
    if ((n == 0) & there).any() or (n > width).any():
        raise Corrupt(f"a value of no bytes or of more than {width}")
    out = np.zeros((len(n), width), dtype=np.uint8)
    row = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    out[row, place] = raw[off[row] + place]
    return out, n, there


def _groups(v: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows x most) bytes of the variable-length form, 7 bits a byte and the lowest first, and their numbers."""
    groups = (v[:, None] >> (np.arange(most, dtype=np.uint64) * np.uint64(7))[None, :]).astype(np.uint8) & 0x7F
    n = np.maximum(1, most - (groups[:, ::-1] != 0).argmax(axis=1))
    n[v == 0] = 1
    groups[np.arange(most)[None, :] < (n - 1)[:, None]] |= 0x80
    return groups, n


def _ungroup(raw: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Numbers from rows of bytes that are each whole to the ``n``-th; an error if the form says otherwise."""
    own = np.arange(raw.shape[1])[None, :] < n[:, None]
    last = np.arange(raw.shape[1])[None, :] == n[:, None] - 1
    if ((raw >= 0x80) != (own & ~last))[own].any():
        raise Corrupt("a variable-length number doesn't end where it should")
    parts = np.where(own, raw & 0x7F, 0).astype(np.uint64) << (np.arange(raw.shape[1], dtype=np.uint64) * np.uint64(7))[None, :]
    return parts.sum(axis=1, dtype=np.uint64)


@_udf("binary")
def to_varied(v: pa.Array) -> pa.Array:
    """The variable-length form; negative numbers have none and are an error."""
    x = _numbers(v, np.int64)
    if (x < 0).any():
        raise ValueError("a negative number has no variable-length form")
    return _joined(*_groups(x.astype(np.uint64), 9), _there(v))


@_udf("long")
def from_varied(b: pa.Array) -> pa.Array:
    raw, n, there = _apart(b, 9)
    return pa.array(_ungroup(raw, n).astype(np.int64), mask=~there)


def _to_zfloating(v: pa.Array, size: int, small: int) -> pa.Array:
    """One byte for whole numbers from -1 to ``small``, ``size`` bytes for positive ones, one more for negative;
    doubles that a float holds take 5."""
    kind = np.float32 if size == 4 else np.float64
    x = _numbers(v, kind)
    out = np.zeros((len(x), size + 1), dtype=np.uint8)
    raw = x.astype(f">f{size}").view(np.uint8).reshape(len(x), size)
    positive = raw[:, 0] < 0x80
    out[positive, :size] = raw[positive]
    out[~positive, 0], out[~positive, 1:] = 0xFF, raw[~positive]
    n = np.where(positive, size, size + 1)
    with np.errstate(all="ignore"):
        if size == 8:
            single = x.astype(np.float32)
            fits = (np.abs(x) < 3e38) & (single == x)
            out[fits, 0], out[fits, 1:5], n[fits] = 0xFE, single[fits].astype(">f4").view(np.uint8).reshape(-1, 4), 5
        whole = (x >= -1) & (x <= small) & (x == np.trunc(x)) & ~((x == 0) & np.signbit(x))
    out[whole, 0], n[whole] = (0x80 | (x[whole].astype(np.int64) + 1)).astype(np.uint8), 1
    return _joined(out, n, _there(v))


def _from_zfloating(b: pa.Array, size: int) -> pa.Array:
    raw, n, there = _apart(b, size + 1)
    first = raw[:, 0]
    far, single, whole = first == 0xFF, (first == 0xFE) & (size == 8), (first >= 0x80)
    want = np.where(far, size + 1, np.where(single, 5, np.where(whole, 1, size)))
    if (want != n)[there].any():
        raise Corrupt("a number has too few or too many bytes")
    read = lambda part, k: np.ascontiguousarray(part[:, :k]).view(f">f{k}").ravel().astype(np.float64)
    out = np.where(far, read(raw[:, 1:], size), read(raw, size))
    out = np.where(whole & ~far & ~single, (first & 0x7F).astype(np.float64) - 1, out)
    if size == 8:
        out = np.where(single, read(raw[:, 1:], 4), out)
    return pa.array(out.astype(np.float32 if size == 4 else np.float64), mask=~there)


@_udf("binary")
def to_zdouble(v: pa.Array) -> pa.Array:
    return _to_zfloating(v, 8, 124)


@_udf("double")
def from_zdouble(b: pa.Array) -> pa.Array:
    return _from_zfloating(b, 8)


@_udf("binary")
def to_zfloat(v: pa.Array) -> pa.Array:
    return _to_zfloating(v, 4, 125)


@_udf("float")
def from_zfloat(b: pa.Array) -> pa.Array:
    return _from_zfloating(b, 4)


@_udf("binary")
def to_tlong(v: pa.Array) -> pa.Array:
    """Times in the longest unit that divides them."""
    x = _numbers(v, np.int64)
    unit = np.select([x % UNITS_MS[k] == 0 for k in (3, 2, 1)], [3, 2, 1], 0)
    x = x // np.array(UNITS_MS)[unit]
    z = ((x << 1) ^ (x >> 63)).astype(np.uint64)
    rest, n = _groups(z >> np.uint64(5), 9)
    more = z >> np.uint64(5) > 0
    head = (unit << 6 | (z & np.uint64(0x1F)).astype(np.int64) | more * 0x20).astype(np.uint8)
    return _joined(np.column_stack([head, rest]), np.where(more, n + 1, 1), _there(v))


@_udf("long")
def from_tlong(b: pa.Array) -> pa.Array:
    raw, n, there = _apart(b, 10)
    more = (raw[:, 0] & 0x20) != 0
    if ((n > 1) != more)[there].any():
        raise Corrupt("a time has too few or too many bytes")
    low = (raw[:, 0] & 0x1F).astype(np.uint64) | _ungroup(raw[:, 1:], np.where(more, n - 1, 0)) << np.uint64(5)
    x = (low >> np.uint64(1)).astype(np.int64) ^ -(low & np.uint64(1)).astype(np.int64)
    return pa.array(x * np.array(UNITS_MS)[raw[:, 0] >> 6], mask=~there)


@_udf("binary")
def to_lz4(v: pa.Array) -> pa.Array:
    """Blocks of strings or bytes."""
    return pa.array([None if x is None else lz4_encode(x.encode() if isinstance(x, str) else x) for x in v.to_pylist()], pa.binary())


@_udf("string")
def from_lz4(b: pa.Array, size: pa.Array) -> pa.Array:
    return pa.array([None if x is None or n is None else lz4_decode(Cursor(x), n).decode() for x, n in zip(b.to_pylist(), size.to_pylist())], pa.string())


def to_packed(bits: int):
    """Lists of numbers in ``bits`` bits each; one that doesn't fit, or a null in a list, is an error."""

    @_udf("binary")
    def run(v: pa.Array) -> pa.Array:
        flat = v.flatten()
        if flat.null_count or len(flat) and bits < 63 and not 0 <= int(pa.compute.min(flat).as_py()) <= int(pa.compute.max(flat).as_py()) < 1 << bits:
            raise ValueError(f"a list holds a null or a number of more than {bits} bits")
        return pa.array([None if x is None else pack(x, bits) for x in v.to_pylist()], pa.binary())

    return run


def from_packed(bits: int):
    @_udf("array<bigint>")
    def run(b: pa.Array, n: pa.Array) -> pa.Array:
        return pa.array([None if x is None or k is None else unpack(x, k, bits).astype(np.int64) for x, k in zip(b.to_pylist(), n.to_pylist())], pa.list_(pa.int64()))

    return run


# Expressions that the JVM evaluates


def zigzag_column(v: Column) -> Column:
    return F.shiftleft(v, 1).bitwiseXOR(F.shiftright(v, 63))


def unzigzag_column(v: Column) -> Column:
    return F.shiftrightunsigned(v, 1).bitwiseXOR(-v.bitwiseAND(F.lit(1)))


def unsigned_column(b: Column | str, at: int, n: int) -> Column:
    """``n`` bytes from place ``at`` (from 1) as an unsigned number; 8 bytes need a decimal."""
    text = F.conv(F.hex(F.substring(b, at, n)), 16, 10)
    return text.cast("decimal(20,0)" if n > 7 else "bigint")


def colon_hex_column(b: Column) -> Column:
    return F.lower(F.regexp_replace(F.hex(b), "(..)(?!$)", "$1:"))


def time_unit_column(ms: Column) -> Column:
    """The unit in which a time is written: day, hour, second or millisecond, the longest that divides it."""
    return F.when(ms % UNITS_MS[3] == 0, "day").when(ms % UNITS_MS[2] == 0, "hour").when(ms % UNITS_MS[1] == 0, "second").otherwise("ms")
