"""Secret scans that link the parts of a credential."""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from logweir.llm.words import forget, slices

# Strong findings: pattern, group whose length counts, and that length (fixed values).
BASE = {
    "assign": (
        re.compile(
            r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
            r"""([A-Za-z0-9+/_.=-]+)""",
            re.IGNORECASE | re.ASCII,
        ),
        2,
        8,
    ),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    "hex": (re.compile(r"[0-9a-f]+"), 0, 32),
}
# Candidates that mean nothing alone.
WEAK = {
    "user": re.compile(
        r"""(?:user(?:name)?|login|client_?id|access_?key(?:_?id)?)["']?\x20*[:=]\x20*["']?"""
        r"""[A-Za-z0-9+/_.@-]{3,}""",
        re.IGNORECASE | re.ASCII,
    ),
    "key": re.compile(r"(?<![A-Za-z0-9+/=])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=])"),
    "endpoint": re.compile(r"""https?://[^\s"'<>]+""", re.ASCII),
}
KINDS = (*BASE, *WEAK)
# What a kind is a part of.
PARTS = {
    "assign": "secret",
    "hex": "secret",
    "key": "secret",
    "access": "identifier",
    "user": "identifier",
    "endpoint": "endpoint",
}
# Parts that must lie within the scope of a weak candidate for it to be reported.
COMPLEMENTS = {
    "user": ("secret",),
    "key": ("identifier",),
    "endpoint": ("secret", "identifier"),
}
# Bytes of text masked at once.
MASKED_BYTES = 4_000_000
# Code points between two parts of one credential.
SCOPE = 300
# Texts without any of this hold no finding; a fast pattern without captures.
_MAY_HOLD = (
    r"""AKIA[A-Z0-9]{12}|[0-9a-f]{32}|[A-Za-z0-9+/]{40}|"""
    r"""(?i:(?:password|passwd|secret|token|api_?key)["']?\x20*[:=])"""
)

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """Leftmost matches per kind, without those that are too short."""
    found = []
    for kind, (pattern, group, least) in BASE.items():
        if kind == "hex":
            # The runs of 32 and more are the same whether or not shorter ones are matched.
            pattern = _LONG_HEX
        for m in pattern.finditer(text):
            if m.end(group) - m.start(group) >= least:
                found.append((kind, m.start(), m.end()))
    return found


_LONG_HEX = re.compile(r"[0-9a-f]{32,}")


def linked_spans(text: str, base: list[Span], scope: int = SCOPE) -> list[Span]:
    """Weak candidates with all their complementary parts within ``scope`` code points.

    An interval join by position: spans lie sorted per part, and since those of a part are
    disjoint or nearly so, the nearest before and behind a candidate decide.
    """
    taken = sorted((a, b) for _, a, b in base)
    begins = [a for a, _ in taken]
    weak = []
    for kind, pattern in WEAK.items():
        for m in pattern.finditer(text):
            k = bisect.bisect_left(begins, m.end())
            # Those of base kinds overlap each other at most by a few, so look back a little.
            if not any(b > m.start() for _, b in taken[max(0, k - 3) : k]):
                weak.append((kind, m.start(), m.end()))
    parts: dict[str, list[tuple[int, int]]] = {}
    for kind, a, b in sorted([*base, *weak], key=lambda s: s[1:]):
        parts.setdefault(PARTS[kind], []).append((a, b))
    starts = {part: [a for a, _ in spans] for part, spans in parts.items()}
    furthest = {}
    for part, spans in parts.items():
        most, ends = -1, []
        for _, b in spans:
            most = max(most, b)
            ends.append(most)
        furthest[part] = ends

    def near(part: str, a: int, b: int) -> bool:
        if part not in parts:
            return False
        before = bisect.bisect_right(starts[part], b + scope)
        return before > 0 and furthest[part][before - 1] >= a - scope

    return [s for s in weak if all(near(part, s[1], s[2]) for part in COMPLEMENTS[s[0]])]


def _joined(spans: list[Span]) -> str:
    order = sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
    return ",".join(f"{kind}:{a}:{b}" for kind, a, b in order)


def secrets(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Secrets of each row of ``docs``, of which only ``doc_id`` and ``text`` are read.

    ``n_assign``, ``n_access`` and ``n_hex`` count the base findings, ``base_sha256`` is the
    digest of their spans and ``spans`` lists all spans ``kind:start:end`` in code points, end
    exclusive, by start and then kind. Weak candidates (user names, 40-character keys,
    endpoints) that do not overlap a base finding are added where all complementary parts lie
    within ``scope`` code points in the same text. Null and empty texts have no findings; one
    row comes out per row that goes in, whatever its other columns.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=16_000_000):
            column = batch.column("text")
            held = pc.fill_null(pc.match_substring_regex(column, _MAY_HOLD), False)
            empty = ([0, 0, 0], hashlib.sha256(b"").hexdigest(), "")
            rows = [empty] * batch.num_rows
            for k in pc.indices_nonzero(held).to_pylist():
                text = column[k].as_py()
                base = base_spans(text)
                counts = [sum(s[0] == kind for s in base) for kind in BASE]
                digest = hashlib.sha256(_joined(base).encode()).hexdigest()
                rows[k] = (counts, digest, _joined(base + linked_spans(text, base, scope)))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    *(pa.array([r[0][n] for r in rows], pa.int64()) for n in range(3)),
                    pa.array([r[1] for r in rows], pa.string()),
                    pa.array([r[2] for r in rows], pa.string()),
                ],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        scan,
        f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string",
    )


def redacted(text: str, scope: int = SCOPE, mark: str = "[SECRET]") -> str:
    """The text with every finding, and what lies between overlapping ones, as ``mark``."""
    base = base_spans(text)
    parts, at = [], 0
    for _, a, b in sorted([*base, *linked_spans(text, base, scope)], key=lambda s: s[1:]):
        if a >= at:
            parts += [text[at:a], mark]
        at = max(at, b)
    return "".join([*parts, text[at:]])


def redact(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """``docs`` with the secrets of ``text`` masked; all other columns as they are."""

    def mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in slices(batches, limit=MASKED_BYTES):
            place = batch.schema.get_field_index("text")
            column = batch.column(place)
            held = pc.fill_null(pc.match_substring_regex(column, _MAY_HOLD), False)
            if pc.any(held).as_py():
                texts = column.to_pylist()
                for k in pc.indices_nonzero(held).to_pylist():
                    texts[k] = redacted(texts[k], scope)
                batch = batch.set_column(place, "text", pa.array(texts, column.type))
            yield batch

    return docs.mapInArrow(mask, docs.schema)
