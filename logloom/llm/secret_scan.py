"""Secret scans with one combined automaton.

All rules are compiled into one minimal deterministic automaton, which reads the bytes of a
text once and reports where matches end. A small automaton of the reversed rule then walks
back from such an end to the leftmost start after the previous match of that rule.

Defined results: a null or empty text has no spans; repeated rows give repeated rows; other
columns are not read by ``find_secrets`` and are kept as they are by ``redact_secrets``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.automaton import Automaton, parse, reverse
from logloom.llm.bpe import slices
from logloom.llm.vocab import release


@dataclass(frozen=True)
class SecretRule:
    """``pattern`` in the form of ``automaton.parse``; ``group`` must have ``least`` characters (0: all)."""

    kind: str
    pattern: str
    least: int = 1
    group: int = 0
    any_case: bool = False


# The rules of the result contract, in its order.
BASE_RULES = (
    SecretRule(
        "assign",
        r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        6,
        2,
        True,
    ),
    SecretRule("access", "AKIA[A-Z0-9]+", 20),
    SecretRule("hex", "[0-9a-f]{24,}", 24),
)
# Key formats with a prefix of their own.
MORE_RULES = (
    SecretRule("github", "gh[pousr]_[A-Za-z0-9]+", 40),
    SecretRule("slack", "xox[abprs]-[A-Za-z0-9-]+", 20),
    SecretRule("google", "AIza[A-Za-z0-9_-]+", 39),
)
RULES = BASE_RULES + MORE_RULES


class Scanner:
    """The compiled rules; ``spans(text)`` is the list of ``(kind number, start, end)`` in code points."""

    def __init__(self, rules: Sequence[SecretRule] = RULES):
        nodes = [parse(r.pattern, r.any_case) for r in rules]
        self.forward = Automaton(nodes, anywhere=True)
        self.backward = [Automaton([reverse(n)], anywhere=False) for n in nodes]
        self._least = [r.least for r in rules]
        self._group = [
            re.compile(r.pattern, re.IGNORECASE | re.ASCII if r.any_case else re.ASCII) if r.group else None
            for r in rules
        ]
        self._number = [r.group for r in rules]

    def spans(self, text: str | None) -> list[tuple[int, int, int]]:
        if not text:
            return []
        data = text.encode("utf-8")
        table, accepting, s, hits = self.forward.table, self.forward.accepting, self.forward.start, []
        for i, b in enumerate(data):
            s = table[s | b]
            if s >= accepting:
                hits.append((i, s))
        if not hits:
            return []
        marks, found = self.forward.marks, []
        for k in range(len(self._least)):
            ends, bit = [], 1 << k
            for i, s in hits:
                if marks[s >> 8] & bit:
                    if ends and ends[-1] == i:
                        ends[-1] = i + 1
                    else:
                        ends.append(i + 1)
            floor = 0
            for end in ends:
                start = self._start(k, data, floor, end)
                if start < 0:
                    continue
                floor = end
                part = data[start:end]
                if self._group[k]:
                    m = self._group[k].fullmatch(part.decode("utf-8"))
                    length = len(m[self._number[k]]) if m else 0
                else:
                    length = len(part)
                if length >= self._least[k]:
                    found.append((start, k, end))
        if len(data) == len(text):
            return [(k, a, b) for a, k, b in sorted(found)]
        point, at, n = {}, 0, 0
        for x in sorted({p for a, _, b in found for p in (a, b)}):
            n += len(data[at:x].decode("utf-8"))
            at, point[x] = x, n
        return [(k, point[a], point[b]) for a, k, b in sorted(found)]

    def _start(self, k: int, data: bytes, floor: int, end: int) -> int:
        """Leftmost start at ``floor`` or later of a match that ends at ``end``; -1 without one."""
        auto, best = self.backward[k], -1
        s, table, accepting, dead = auto.start, auto.table, auto.accepting, auto.dead
        for i in range(end - 1, floor - 1, -1):
            s = table[s | data[i]]
            if s >= accepting:
                best = i
            elif s == dead:
                break
        return best


_SCANNERS: dict[tuple[SecretRule, ...], Scanner] = {}


def scanner(rules: tuple[SecretRule, ...]) -> Scanner:
    """One compiled scanner per Python worker."""
    if rules not in _SCANNERS:
        _SCANNERS[rules] = Scanner(rules)
    return _SCANNERS[rules]


SPANS = "array<struct<kind:string,start:int,end:int>>"


def find_secrets(
    df: DataFrame, id_column: str = "doc_id", text_column: str = "text", rules: tuple[SecretRule, ...] = RULES
) -> DataFrame:
    """One row per row of ``df``: ``id`` and ``secrets``, its spans by start, then by rule."""
    rules = tuple(rules)
    shape = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        scan, kinds = scanner(rules), [r.kind for r in rules]
        for batch in batches:
            for part in slices(batch):
                spans = [
                    [{"kind": kinds[k], "start": a, "end": b} for k, a, b in scan.spans(t)]
                    for t in part.column(1).to_pylist()
                ]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(spans, shape)], ["id", "secrets"])

    kind = df.schema[id_column].dataType.simpleString()
    return df.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).mapInArrow(
        run, f"id {kind}, secrets {SPANS}"
    )


def redact_secrets(
    df: DataFrame, text_column: str = "text", mask: str = "[{kind}]", rules: tuple[SecretRule, ...] = RULES
) -> DataFrame:
    """``df`` with every span of its texts replaced by ``mask``; overlapping spans become one, named by the first.

    Null texts stay null, rows and the other columns stay as they are.
    """
    rules = tuple(rules)
    at = df.columns.index(text_column)

    def clean(scan: Scanner, text: str | None) -> str | None:
        spans = scan.spans(text)
        if not spans:
            return text
        out, last = [], 0
        for k, a, b in spans:
            if a >= last:
                out += [text[last:a], mask.format(kind=rules[k].kind)]
            last = max(last, b)
        return "".join([*out, text[last:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        scan = scanner(rules)
        for batch in batches:
            for part in slices(batch):
                texts = pa.array([clean(scan, t) for t in part.column(at).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays(
                    [texts if i == at else c for i, c in enumerate(part.columns)], schema=part.schema
                )

    return df.mapInArrow(run, df.schema)
