"""Credentials in texts, found by one automaton for all rules in one pass over the bytes."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import automaton
from ._shared import fresh, lean, sized, small_batches
from ._text import flat

LANE = 1024  #: bytes that one lane of the scan decides
SLICE = 2 << 20  #: bytes of text scanned at once


WORD = frozenset({*range(48, 58), *range(65, 91), *range(97, 123)})
TOKEN = WORD | {45, 95}


@dataclass(frozen=True)
class Rule:
    """``pattern``: see automaton; its matches are of bounded length, so that one scan finds them. ``apart``: the
    byte before isn't one of these. ``tail``: a match goes on over the longest that this expression matches next,
    of any length; if ``needed``, it is none where the expression doesn't match."""

    name: str
    pattern: str
    apart: frozenset[int] = frozenset()
    tail: str = ""
    needed: bool = False


#: What follows the first line of a private key: anything up to its last line, as long as no other line of five dashes
#: comes before; or, of a key that is cut off, header lines and lines of base64 as far as they go.
_TO_END = r"[^\-]*(?:-{1,4}[^\-]+)*-----END [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----"
_BREAK, _BASE64 = r"(?:\s|\\[nr])+", r"[A-Za-z0-9+/=]"
_CUT_OFF = rf"(?:{_BREAK}[A-Za-z][A-Za-z0-9\-]*:[^\r\n]*)*(?:(?:{_BREAK}{_BASE64}{{20,}})+(?:{_BREAK}{_BASE64}+)?(?:{_BREAK}={_BASE64}{{4}})?|{_BREAK}{_BASE64}+\s*$)?"

RULES = (
    Rule("aws_access_key", r"(?:AKIA|ASIA)[0-9A-Z]{16}", apart=TOKEN),
    Rule("github_token", r"gh[pousr]_[A-Za-z0-9]{36}", apart=TOKEN),
    Rule("gitlab_token", r"glpat-[A-Za-z0-9_]{20}", apart=TOKEN),
    Rule("google_api_key", r"AIza[0-9A-Za-z_\-]{35}", apart=TOKEN),
    Rule("slack_token", r"xox[abprs]-[0-9A-Za-z]{8}", apart=TOKEN, tail=r"[0-9A-Za-z\-]*"),
    Rule("stripe_key", r"[sr]k_(?:live|test)_[0-9A-Za-z]{24}", apart=TOKEN, tail=r"[0-9A-Za-z]*"),
    Rule("sk_key", r"sk-[A-Za-z0-9]{20}", apart=TOKEN, tail=r"[A-Za-z0-9]*"),
    Rule("json_web_token", r"eyJ[A-Za-z0-9_\-]{10}", apart=TOKEN, tail=r"[A-Za-z0-9_\-]*(?:\.[A-Za-z0-9_\-]+){0,2}"),
    Rule("private_key", r"-----BEGIN ", tail=rf"[A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----(?:{_TO_END}|{_CUT_OFF})", needed=True),
    Rule("url_password", r"://", tail=r"[^\s/:@\"'<>`]*:[^\s/@\"'<>`]{3,}@", needed=True),
    Rule("assigned_secret", r"(?i)(?:token|secret|passwd|password|api_key|apikey|access_key)", apart=WORD, tail=r"[\"']?\s*[:=]\s*[\"']?[A-Za-z0-9_+/\-][A-Za-z0-9_+/=\-]{15,}", needed=True),
)



class Scanner:
    """All rules compiled; the byte 255, which UTF-8 doesn't use, stands between documents and in no class."""

    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        heads = [automaton.parse(r.pattern) for r in rules]
        tails = [automaton.parse(r.tail) for r in rules]
        self.longest = max(map(automaton.longest, heads), default=0) + 1
        self.all = automaton.build([("cat", [("set", frozenset(range(256)) - r.apart), t]) if r.apart else t for r, t in zip(rules, heads)], search=True)
        self.back = [automaton.build([automaton.reverse(t)], search=False) for t in heads]
        self.whole = [automaton.build([("cat", [h, t if r.needed else ("rep", t, 0, 1)])], search=False) for r, h, t in zip(rules, heads, tails)]

    def ends(self, buf: np.ndarray) -> list[tuple[int, int]]:
        """(offset of a match's last byte, rule) in ``buf``. Lanes of LANE bytes go through the automaton side
        by side, each from ``longest`` bytes before its own: what began earlier can't end in it."""
        a, warm = self.all, self.longest
        lanes = -(-len(buf) // LANE)
        if not lanes:
            return []
        cls = np.full(warm + lanes * LANE, a.byte_class[255], dtype=np.uint8)
        cls[warm : warm + len(buf)] = a.byte_class[buf]
        cols = np.ascontiguousarray(np.lib.stride_tricks.as_strided(cls, (lanes, warm + LANE), (LANE, 1)).T)
        state = np.full(lanes, a.start, dtype=np.int32)
        at = np.empty(lanes, dtype=np.int32)
        found = []
        for k in range(warm + LANE):
            np.add(state, cols[k], out=at, casting="unsafe")
            np.take(a.table, at, out=state, mode="clip")
            if k >= warm and state.max() >= a.accepting:
                for lane in np.flatnonzero(state >= a.accepting):
                    pos = int(lane) * LANE + k - warm
                    found += [(pos, r) for r in a.rules[(int(state[lane]) - a.accepting) // a.classes]]
        return sorted(found)

    def _starts(self, buf: np.ndarray, last: int, r: int) -> list[int]:
        """First bytes of the rule's matches that end with the byte at ``last``."""
        a, state, out = self.back[r], self.back[r].start, []
        for pos in range(last, max(-1, last - self.longest), -1):
            state = int(a.table[state + int(a.byte_class[buf[pos]])])
            if state == a.dead:
                break
            if state >= a.accepting and (pos == 0 or int(buf[pos - 1]) not in self.rules[r].apart):
                out.append(pos)
        return out

    def spans(self, arr: pa.Array) -> list[tuple[int, int, int, int]]:
        """(document, rule, first byte, byte after the last): of each rule the leftmost matches that don't
        overlap, each as long as it can be."""
        raw, off = flat(arr)
        n = len(off) - 1
        buf = np.full(len(raw) + n + 1, 255, dtype=np.uint8)
        text = np.ones(len(buf), dtype=bool)
        text[off + np.arange(n + 1)] = False
        buf[text] = raw
        begin = off[:-1] + np.arange(n) + 1
        by: dict[tuple[int, int], list[int]] = defaultdict(list)
        for pos, r in self.ends(buf):
            by[int(np.searchsorted(begin, pos, side="right")) - 1, r].append(pos)
        out = []
        for (d, r), lasts in by.items():
            lo = free = int(begin[d])
            for s in sorted({s for last in lasts for s in self._starts(buf, last, r)}):
                if s >= free and (e := self.whole[r].match(buf, s)) > s:
                    out.append((d, r, s - lo, e - lo))
                    free = e
        return sorted(out, key=lambda x: (x[0], x[2], x[1]))


def findings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``(doc_id, rule, nth, start, secret)``: every match; ``nth`` counts a rule's matches in a row's text
    from 1, ``start`` is in characters from 0. No shuffle: one pass over the texts.

    Null and empty texts have none; very long ones are scanned whole. Repeated rows, and rows of null id, have
    their own findings. Matches of different rules may overlap; of one rule that begins at one place the longest
    counts. Other columns, whatever their names, don't matter; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    scanner = Scanner(rules)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sized(batches, "text", SLICE):
            texts = b.column("text")
            hits = scanner.spans(texts)
            if not hits:
                continue
            raw, off = flat(texts)
            rows: list[list] = [[], [], [], []]
            seen: dict[tuple[int, int], int] = defaultdict(int)
            for d, r, s, e in hits:
                seen[d, r] += 1
                one = raw[off[d] : off[d + 1]]
                rows[0].append(scanner.rules[r].name)
                rows[1].append(seen[d, r])
                rows[2].append(int(((one[:s] & 0xC0) != 0x80).sum()))
                rows[3].append(one[s:e].tobytes().decode("utf-8", "replace"))
            ids = b.column("doc_id").take(pa.array([h[0] for h in hits]))
            yield pa.record_batch([ids, pa.array(rows[0]), pa.array(rows[1], pa.int32()), pa.array(rows[2], pa.int64()), pa.array(rows[3])], names=["doc_id", "rule", "nth", "start", "secret"])

    kind = src.schema["doc_id"].dataType.simpleString()
    return src.mapInArrow(run, f"doc_id {kind}, rule string, nth int, start bigint, secret string")


def redact(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with every secret in ``text_col`` replaced by ``[rule]`` and ``length_col``, if there is such
    a column, the new length of changed texts. No row goes; other columns, whatever their names, null, empty and
    clean texts stay as they were; repeated rows are changed each; an empty table stays empty. Overlapping matches
    of several rules are replaced together under the name of the first. Only the text goes to Python, and only
    changed texts come back."""
    small_batches(docs.sparkSession)
    scanner = Scanner(rules)

    def changed(texts: pa.Array) -> pa.Array:
        by: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        for d, r, s, e in scanner.spans(texts):
            if by[d] and s < by[d][-1][2]:
                r0, s0, e0 = by[d][-1]
                by[d][-1] = (r0, s0, max(e, e0))
            else:
                by[d].append((r, s, e))
        out: list[str | None] = [None] * len(texts)
        for d, found in by.items():
            one, parts, at = texts[d].as_py().encode(), [], 0
            for r, s, e in found:
                parts += [one[at:s], f"[{scanner.rules[r].name}]".encode()]
                at = e
            out[d] = b"".join([*parts, one[at:]]).decode("utf-8", "replace")
        return pa.array(out, pa.string())

    def texts(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for a in arrays:
            parts = [changed(b.column(0)) for b in sized(iter([pa.record_batch([a], names=["text"])]), "text", SLICE)]
            yield pa.concat_arrays(parts) if parts else pa.nulls(0, pa.string())

    def run(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from lean(texts)(arrays)

    name = fresh(docs, "text_changed")
    rows = docs.withColumn(name, F.arrow_udf(run, "string").asNondeterministic()(F.col(text_col)))  # so that it is evaluated once
    new = {text_col: F.coalesce(F.col(name), F.col(text_col))}
    if length_col in docs.columns:
        new[length_col] = F.when(F.col(name).isNotNull(), F.length(name).cast(docs.schema[length_col].dataType)).otherwise(F.col(length_col))
    return rows.select(*[new.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])
