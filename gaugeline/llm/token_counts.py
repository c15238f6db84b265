"""Token counts of sections by offset-mapped attribution.

A document is encoded once, as a whole. Each token has a span of code points (its bytes' first to last code point); the
document's sections are spans too. Both are sorted, so they are joined interval by interval with binary search. A token
that lies in one section counts there; one that crosses a boundary goes by the rule: `start`, the section of its first
code point; `end`, that of its last; `most`, the one that holds most of it, the first among equals. Tokens outside all
sections count to the section -1.

Defined results: a null or empty text has one empty section and no tokens; equal rows are counted each; other columns
are not looked at; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_parts

RULES = ("start", "end", "most")
COUNTS = "doc_id long, section int, start int, stop int, n_tokens long, n_crossing long"


def line_spans(text: str) -> list[tuple[int, int]]:
    """The lines of a text, each with its line end."""
    out, at = [], 0
    for line in text.split("\n"):
        out.append((at, min(len(text), at + len(line) + 1)))
        at += len(line) + 1
    return out


def token_spans(text: str, lengths):
    """(first, past the last) code point of tokens with these byte lengths."""
    import numpy as np

    ends = np.cumsum(lengths)
    raw = np.frombuffer(text.encode(), np.uint8)
    if len(raw) == len(text):
        return ends - lengths, ends
    point = np.cumsum((raw & 0xC0) != 0x80) - 1
    return point[ends - lengths], point[ends - 1] + 1


def attribute(spans, first, past, rule: str):
    """The tokens of each of the sorted, disjoint spans, those of none last, and how many of them cross."""
    import numpy as np

    starts, stops = np.array([s for s, _ in spans], np.int64), np.array([e for _, e in spans], np.int64)

    def holder(point):
        at = np.searchsorted(starts, point, "right") - 1
        # an empty span starts where the next one does: the last of equal starts holds the point
        return np.where((at >= 0) & (point < stops[np.maximum(at, 0)]), at, len(spans))

    a, b = holder(first), holder(past - 1)
    crossing = a != b
    where = a if rule in ("start", "most") else b
    if rule == "most" and crossing.any():
        where = where.copy()
        for i in np.flatnonzero(crossing):
            lo, hi = np.searchsorted(stops, first[i], "right"), np.searchsorted(starts, past[i], "left")
            held = [(min(stops[k], past[i]) - max(starts[k], first[i]), -k) for k in range(lo, hi)]
            out = past[i] - first[i] - sum(n for n, _ in held)
            most = max(held, default=(0, 0))
            where[i] = -most[1] if most[0] > 0 and most[0] >= out else len(spans)
    n = len(spans) + 1
    return np.bincount(where, minlength=n), np.bincount(where[crossing], minlength=n)


def section_tokens(df: DataFrame, path: str, rule: str = "start", key: str = "doc_id", text: str = "text", sections: str | None = None) -> DataFrame:
    """doc_id, section, start, stop, n_tokens, n_crossing. sections: a column of sorted, disjoint spans
    (array<struct<start,stop>>); by default the lines."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")

    def run(found):
        import numpy as np
        import pyarrow as pa

        from .tokens import batches, encoder

        enc = encoder(path, "leading")
        for batch in in_parts(found):
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            given = batch.column(2).to_pylist() if sections else None
            for at, some in batches(texts):
                out: list[list] = [[], [], [], [], [], []]
                for i, (t, raw) in enumerate(zip(some, enc.encode(some), strict=True), at):
                    spans = [(s["start"], s["stop"]) for s in given[i] or []] if given else line_spans(t)
                    n, crossing = attribute(spans, *token_spans(t, enc.lengths[np.frombuffer(raw, "<u4")]), rule) if raw else ([0] * (len(spans) + 1),) * 2
                    last = len(spans) + bool(n[-1])
                    out[0] += [keys[i]] * last
                    out[1] += [*range(len(spans)), -1][:last]
                    out[2] += [*(s for s, _ in spans), 0][:last]
                    out[3] += [*(e for _, e in spans), 0][:last]
                    out[4] += list(n)[:last]
                    out[5] += list(crossing)[:last]
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=[c.split()[0] for c in COUNTS.split(", ")])

    columns = [F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), *([F.col(sections).alias("sections")] if sections else [])]
    return df.select(*columns).mapInArrow(run, COUNTS)
