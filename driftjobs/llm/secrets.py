"""Secret scans: single patterns, and parts that only together make a credential."""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftjobs.llm.common import fine_text, sized_batches, tidy

ASSIGN = re.compile(
    r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"""
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Parts too weak to report alone: short access identifiers, short hex, mixed base64 runs, and endpoints.
WEAK_ACCESS = re.compile(r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{4,}")
WEAK_SECRET = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}(?![A-Za-z0-9+/_=-])")
ENDPOINT = re.compile(r"(?<![A-Za-z0-9+])[A-Za-z][A-Za-z0-9+]+://[^\x20\t-\r\"'<>]{4,}|\b(?:\d{1,3}\.){3}\d{1,3}(?::\d{1,5})?\b")
BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "weak_access", "weak_secret", "endpoint")
SPANS = "array<struct<kind:string,start:int,end:int>>"

Span = tuple[int, int, int]  # start, kind's place in KINDS, end


def base_spans(text: str) -> list[Span]:
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return found + [(m.start(), 2, m.end()) for m in HEX.finditer(text)]


def weak_spans(text: str) -> list[Span]:
    found = [(m.start(), 3, m.end()) for m in WEAK_ACCESS.finditer(text)] if "AKIA" in text or "ASIA" in text else []
    found += [(m.start(), 4, m.end()) for m in WEAK_SECRET.finditer(text) if _random_looking(m.group())]
    return found + [(m.start(), 5, m.end()) for m in ENDPOINT.finditer(text)]


def _random_looking(run: str) -> bool:
    """Letters and digits both, and over 3 bits a character."""
    if not (any(c.isdigit() for c in run) and any(c.isalpha() for c in run)):
        return False
    n = len(run)
    return -sum(k / n * math.log2(k / n) for k in Counter(run).values()) > 3.0


def linked(strong: list[Span], weak: list[Span], scope: int) -> list[Span]:
    """The weak spans that a complementary part accompanies within ``scope`` code points.

    An interval join of sorted starts and ends: an identifier (access) needs a secret (assign, hex, weak
    secret); a weak secret needs an identifier or an endpoint; an endpoint needs a secret. Nearest
    neighbours decide, so no pairs are listed. A part doesn't complement one that it overlaps.
    """
    role = {0: "secret", 1: "id", 2: "secret", 3: "id", 4: "secret", 5: "endpoint"}
    needs = {3: ("secret",), 4: ("id", "endpoint"), 5: ("secret",)}
    covered = sorted((s, e) for s, _, e in strong)
    ends_before = [e for _, e in covered]
    for i in range(1, len(ends_before)):
        ends_before[i] = max(ends_before[i], ends_before[i - 1])

    def inside_strong(start: int, end: int) -> bool:
        at = bisect_left(covered, (end, -1))
        return at > 0 and ends_before[at - 1] > start

    weak = [w for w in weak if not inside_strong(w[0], w[2])]
    starts: dict[str, list[int]] = {"id": [], "secret": [], "endpoint": []}
    ends: dict[str, list[int]] = {"id": [], "secret": [], "endpoint": []}
    for start, kind, end in strong + weak:
        starts[role[kind]].append(start)
        ends[role[kind]].append(end)
    for places in (*starts.values(), *ends.values()):
        places.sort()

    def near(start: int, end: int, name: str) -> bool:
        after, before = bisect_left(starts[name], end), bisect_right(ends[name], start)
        return after < len(starts[name]) and starts[name][after] - end <= scope or before > 0 and ends[name][before - 1] >= start - scope

    return [(s, k, e) for s, k, e in weak if any(near(s, e, name) for name in needs[k])]


def scan(text: str | None, scope: int) -> list[Span]:
    """All spans by start, then kind as listed in KINDS."""
    if not text:
        return []
    strong = base_spans(text)
    weak = weak_spans(text)
    return sorted(strong + (linked(strong, weak, scope) if weak else []))


def secret_spans(text: F.Column, scope: int = 200) -> F.Column:
    """Spans (kind, start, end in code points, end exclusive) of a text column; none for null and empty texts."""

    @F.arrow_udf(SPANS)
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
        for texts in batches:
            rows = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in scan(t.as_py(), scope)] for t in texts]
            yield pa.array(rows, pa.list_(kind))
        tidy()

    return find(text)


def scan_secrets(docs: DataFrame, text_col: str = "text", scope: int = 200) -> DataFrame:
    """``docs`` with ``secret_spans``, ``n_assign``, ``n_access`` and ``n_hex``, which replace columns of those names.

    Whole texts are scanned, each where it lies: a scope never crosses a text, so nothing is shuffled.
    Null and empty texts have no spans; texts and parts of any length count; repeated rows stay; an empty
    table stays empty. Bytes that aren't UTF-8 count as U+FFFD, also in the offsets.
    """
    found = sized_batches(docs).withColumn("secret_spans", secret_spans(fine_text(text_col), scope))
    return found.withColumns({f"n_{k}": _count(k) for k in BASE_KINDS})


def _count(kind: str) -> F.Column:
    return F.size(F.filter("secret_spans", lambda s: s["kind"] == kind)).cast("long")


def spans_text(spans: F.Column, kinds: tuple[str, ...] = KINDS) -> F.Column:
    """``kind:start:end`` of the spans of these kinds, joined by commas."""
    own = F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(own, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(docs: DataFrame, text_col: str = "text", scope: int = 200) -> DataFrame:
    """``docs`` with every reported span of the text replaced by ``[kind]``; overlapping spans are one, named after the first.

    Texts without spans, nulls and all other columns stay as they are, but that bytes which aren't UTF-8 become U+FFFD.
    """

    @F.arrow_udf("string")
    def clean(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([_redacted(t.as_py(), scope) for t in texts], pa.string())
        tidy()

    return sized_batches(docs).withColumn(text_col, clean(fine_text(text_col)))


def _redacted(text: str | None, scope: int) -> str | None:
    spans = scan(text, scope)
    if not spans:
        return text
    merged: list[list[int]] = []
    for start, kind, end in spans:
        if merged and start < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], end)
        else:
            merged.append([start, kind, end])
    out, at = [], 0
    for start, kind, end in merged:
        out += [text[at:start], f"[{KINDS[kind]}]"]
        at = end
    return "".join([*out, text[at:]])
