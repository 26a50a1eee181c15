"""Secret scans: fixed patterns, and sliding-window entropy per character class.

Fixed patterns give the spans ``assign``, ``access`` and ``hex``. Besides them every candidate string (an unbroken run of
letters, digits and ``+/_=-`` of at least 20 characters) slides a window of 20 over each character class it consists of:
every run of hexadecimal digits by itself, and the whole as base 64. The window's Shannon entropy is kept by adding the character that enters and
removing the one that leaves. A candidate whose entropy reaches the class's threshold somewhere is a span ``entropy``,
unless the allow-list suppresses it (words without digits, one repeated alphabet, UUIDs, dates and version paths,
documented example keys) or a fixed pattern has it already. Where a fixed pattern has only a part of a candidate, what is left of it
on either side is judged by itself.

Positions are code points, end exclusive. Null texts are empty; repeated rows give equal results; an empty table gives an
empty one. Every text is read whole, row by row, where it lies.
"""

from __future__ import annotations

import hashlib
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from waybill.llm.common import append_columns

# The patterns of the three base kinds.
ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "entropy")

WINDOW = 20
#: Bits per character that a window has to reach, by class. Random hex has about 3.4 in 20 characters, random base 64 about 4.2.
HEX_BITS = 3.0
BASE64_BITS = 3.9
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
_HEXADECIMAL = re.compile(rf"[0-9a-fA-F]{{{WINDOW},}}")
_ALLOWED = re.compile(
    r"[A-Za-z/_=+-]*"  # no digit: words, paths, rules of characters
    r"|[0-9/_=+-]*"  # no letter: numbers, dates
    r"|[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"  # UUID
    r"|(?i:[a-z0-9]{1,12}[/_-])+[a-z0-9]{0,12}"  # short parts with separators: names of files and versions
    r"|.*EXAMPLE.*")

_PART = [0.0] + [k / WINDOW * math.log2(WINDOW / k) for k in range(1, WINDOW + 1)]


def window_entropy(text: str, window: int = WINDOW) -> float:
    """The largest Shannon entropy (bits per character) of any window of ``text``; the text has at least one window."""
    part = _PART if window == WINDOW else [0.0] + [k / window * math.log2(window / k) for k in range(1, window + 1)]
    counts: dict[str, int] = {}
    now = 0.0
    for c in text[:window]:
        k = counts.get(c, 0)
        counts[c] = k + 1
        now += part[k + 1] - part[k]
    best = now
    for gone, c in zip(text, text[window:]):
        if gone != c:
            k = counts[gone]
            counts[gone] = k - 1
            now += part[k - 1] - part[k]
            k = counts.get(c, 0)
            counts[c] = k + 1
            now += part[k + 1] - part[k]
            if now > best:
                best = now
    return best


def is_random(candidate: str) -> bool:
    if _ALLOWED.fullmatch(candidate):
        return False
    # A name or path glued to hexadecimal digits does not make them base 64, whose bound they hardly reach.
    if any(not _ALLOWED.fullmatch(run) and window_entropy(run) >= HEX_BITS for run in _HEXADECIMAL.findall(candidate)):
        return True
    return not _HEXADECIMAL.fullmatch(candidate) and window_entropy(candidate) >= BASE64_BITS


def _left(a: int, b: int, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """A candidate's parts of a window's length that no base span has; the candidate itself unless one lies inside it or around it."""
    if not any(x <= a and b <= y or a <= x and y <= b for x, _, y in base):
        return [(a, b)]
    parts, at = [], a
    for x, _, y in sorted(base):
        if y > a and x < b:
            parts.append((at, x))
            at = max(at, y)
    return [(x, y) for x, y in [*parts, (at, b)] if y - x >= WINDOW]


def find(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans and all spans as (start, index of the kind, kind, end) sorted by start, then kind."""
    base = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 8]
    base += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    base += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    base.sort()
    more, near, i = [], [], 0
    for m in _CANDIDATE.finditer(text):
        # Both come in order, so each base span is met where it overlaps candidates and then left behind.
        while i < len(base) and base[i][0] < m.end():
            near.append(base[i])
            i += 1
        near = [s for s in near if s[2] > m.start()]
        more += [(a, 3, b) for a, b in _left(*m.span(), near) if is_random(text[a:b])]
    return base, sorted(base + more)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def scan(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` without its text, with n_assign, n_access, n_hex, n_entropy, base_sha256 and spans."""
    fields = T.StructType(
        [T.StructField(f"n_{k}", T.LongType()) for k in KINDS] + [T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())])

    def compute(texts: pa.Array) -> list:
        counts, digest, spans = [[] for _ in KINDS], [], []
        for t in texts:
            base, every = find(t.as_py())
            for i, column in enumerate(counts):
                column.append(sum(kind == i for _, kind, _ in every))
            digest.append(hashlib.sha256(joined(base).encode()).hexdigest())
            spans.append(joined(every))
        return [*(pa.array(c, pa.int64()) for c in counts), pa.array(digest, pa.string()), pa.array(spans, pa.string())]

    return append_columns(df, fields, compute, text).drop(text)


def redact(text: str, mark: str = "[secret]") -> str:
    """``text`` with every span replaced; overlapping spans become one mark."""
    out, at = [], 0
    for start, _, end in find(text)[1]:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join(out) + text[at:]
