"""All spans of a text rewritten in one sweep.

``sanitize_span`` gives a text for every span, which for a log with many findings is the
text many times over.  Here a unit stays one row: its spans are merged into stretches that
do not overlap, and the text is put together once from what lies between them.

A stretch is a longest run of spans each of which begins before the furthest end so far;
spans that only touch stay apart.  It is replaced by the placeholder of its first span, by
start, then by place in the array, so no character that any span covers is left.  Spans
that do not overlap give what ``replace_span`` gives when applied from the last to the first.

Defined results: spans may come in any order and more than once.  A span whose rule has no
placeholder, without an offset, empty, or outside the text, is left out; one that reaches
beyond the text ends with it.  Without spans the text is returned as it is, null as null.

Running ends over ordered spans and cuts by place are linear in an Arrow batch.  With SQL
functions each cut counts code points from the start of the text again.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textwarden.functions.rules import Rule
from textwarden.operators.spans import placeholder_of, with_spans

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def stretches(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of each stretch, and the place of the span it is named after."""
    order = np.argsort(start, kind="stable")
    begin, reach = start[order], np.maximum.accumulate(end[order])
    fresh = np.ones(len(order), bool)
    fresh[1:] = begin[1:] >= reach[:-1]
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(order)) - 1
    return begin[first], reach[last], order[first]


def swept(text: str, start: np.ndarray, end: np.ndarray, placeholder: Sequence[str]) -> str:
    """The text with each stretch replaced."""
    inside = np.flatnonzero(start < len(text))
    if not len(inside):
        return text
    start, end = start[inside], np.minimum(end[inside], len(text))
    placeholder = [placeholder[i] for i in inside.tolist()]
    out, at = [], 0
    for a, b, own in zip(*(x.tolist() for x in stretches(start, end))):
        out += [text[at:a], placeholder[own]]
        at = b
    out.append(text[at:])
    return "".join(out)


def _sweep(text: pa.Array, start: pa.Array, end: pa.Array, placeholder: pa.Array) -> pa.Array:
    cuts = start.offsets.to_numpy()
    starts, ends = (x.flatten().to_numpy(zero_copy_only=False) for x in (start, end))
    names = placeholder.flatten().to_pylist()
    base, out = cuts[0], []
    for one, a, b in zip(text, cuts[:-1] - base, cuts[1:] - base):
        one = one.as_py()
        out.append(one if one is None or a == b else swept(one, starts[a:b], ends[a:b], names[a:b]))
    return pa.array(out, pa.string())


def sweep_text(text: Column, spans: Column, rules: Sequence[Rule] | None = None) -> Column:
    """The text without its ``spans``, an array of ``(start, end, pattern_id, ...)``."""
    whole = F.transform(
        spans,
        lambda s: F.struct(
            s["start"].cast("long").alias("start"),
            s["end"].cast("long").alias("end"),
            placeholder_of(s["pattern_id"], rules).alias("placeholder"),
        ),
    )
    usable = F.filter(
        whole,
        lambda s: (s["start"] >= 0) & s["end"].isNotNull() & (s["start"] < s["end"]) & s["placeholder"].isNotNull(),
    )
    usable = F.coalesce(usable, F.filter(F.array(F.struct(
        F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("end"), F.lit("").alias("placeholder")
    )), lambda s: F.lit(False)))
    return F.arrow_udf(_sweep, "string")(
        text, *(usable.getField(name) for name in ("start", "end", "placeholder"))
    )


def sanitize_spans(
    df: DataFrame, rules: Sequence[Rule] | None = None, text: str = "text", out: str = "sanitized"
) -> DataFrame:
    """The units that have findings, once each, with all spans of all rules replaced."""
    kept = [F.col(c) for c in df.columns if c != out]
    found = with_spans(df, rules, text)
    return found.select(*kept, sweep_text(F.col(text), F.col("spans"), rules).alias(out))
