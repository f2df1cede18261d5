"""Exact spans of findings, their line positions, and single-span rewrites.

Offsets are 0-based code points, the end exclusive.  Everything happens inside the
row: no shuffle, and texts no rule hits are filtered out first.

Per matched rule the text is cut into hits and the gaps between them, and each piece
is measured.  Measures add up, so offsets are running sums; line positions are too,
where a piece with a line end starts counting characters anew.  The sums are taken in
blocks, then over the blocks: an array grown one element at a time is copied each
time, which for a log file with a million hits would never end.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textwarden.functions.detect import with_matched
from textwarden.functions.rewrite import replace_span
from textwarden.functions.rules import MAX_TEXT_BYTES, Rule, builtin_rules
from textwarden.functions.sqltext import ident
from textwarden.functions.text import utf16_length
from textwarden.sources.corpus import is_excluded, size_gate

_BLOCK = 256
_RULE = "'ord', p.ord, 'id', p.id, 'label', p.label"
_PLACE = "struct<at:int,line:int,character:int>"
_MARK = f"array<struct<begin:{_PLACE},fin:{_PLACE}>>"


def _place(at: str, line: str, character: str) -> str:
    return f"named_struct('at', {at}, 'line', {line}, 'character', {character})"


def _advance(place: tuple[str, str, str], measure: str) -> tuple[str, str, str]:
    """Offset, line and character behind a measured piece of text."""
    at, line, character = place
    return (
        f"{at} + {measure}.at",
        f"{line} + {measure}.line",
        f"if({measure}.line > 0, {measure}.tail, {character} + {measure}.at)",
    )


def _shift(base: str, place: str) -> tuple[str, str, str]:
    """A place counted from ``base``, counted from the start of the text."""
    return (
        f"{base}.at + {place}.at",
        f"{base}.line + {place}.line",
        f"{place}.character + if({place}.line > 0, 0, {base}.character)",
    )


def _of(place: str) -> tuple[str, str, str]:
    return f"{place}.at", f"{place}.line", f"{place}.character"


_START = _place("0", "0", "0")


def _measure(part: str, following: str, positions: bool) -> str:
    r"""Length of the part, the line ends in it, and the characters behind the last.

    A line end is ``\r\n``, ``\n`` or ``\r``.  A ``\r`` closing the part is only half of
    one when the next character is ``\n``: it then counts with the next part.
    """
    if not positions:
        return f"named_struct('at', length({part}), 'line', 0, 'tail', 0)"

    def count(what: str) -> str:
        return f"(length({part}) - length(replace({part}, '{what}', '')))"

    halved = f"(endswith({part}, '\\r') AND startswith({following}, '\\n'))"
    returns = f"{count(r'\r')} - {count(r'\r\n')} div 2 - int({halved})"
    breaks = f"int({count(r'\n')} + if(contains({part}, '\\r'), {returns}, 0))"
    whole = f"if({halved}, left({part}, length({part}) - 1), {part})"
    tail = f"substring_index(substring_index({whole}, '\\n', -1), '\\r', -1)"
    return (
        f"named_struct('at', length({part}), 'line', {breaks}, "
        f"'tail', length({tail}) + int({halved}))"
    )


def _pieces(text: str, matched: str) -> str:
    """Per matched rule its hits and the gaps around them."""
    return (
        f"transform({matched}, p -> named_struct({_RULE}, "
        f"'hits', regexp_extract_all({text}, p.regex, 0), 'gaps', split({text}, p.regex, -1)))"
    )


def _segments(positions: bool) -> str:
    """Per hit the measures of the gap before it and of the hit; an empty hit ends its rule."""
    empty = "array_position(p.hits, '')"
    hits = f"if({empty} > 0, slice(p.hits, 1, int({empty}) - 1), p.hits)"
    gap = _measure("get(p.gaps, i)", "hit", positions)
    hit = _measure("hit", "coalesce(get(p.gaps, i + 1), '')", positions)
    measured = f"transform({hits}, (hit, i) -> named_struct('gap', {gap}, 'hit', {hit}))"
    return f"transform(_pieces, p -> named_struct({_RULE}, 'segments', {measured}))"


def _blocks() -> str:
    """Per block the places of its hits, counted from its start, and the place it ends at."""
    begin = _advance(_of("state.fin"), "seg.gap")
    fin = _advance(begin, "seg.hit")
    mark = f"named_struct('begin', {_place(*begin)}, 'fin', {_place(*fin)})"
    first = f"named_struct('fin', {_START}, 'marks', CAST(array() AS {_MARK}))"
    step = f"named_struct('fin', {_place(*fin)}, 'marks', concat(state.marks, array({mark})))"
    heads = (
        f"if(size(p.segments) > 0, sequence(1, size(p.segments), {_BLOCK}), CAST(array() AS array<int>))"
    )
    folded = f"aggregate(slice(p.segments, head, {_BLOCK}), {first}, (state, seg) -> {step})"
    return (
        f"transform(_segments, p -> named_struct({_RULE}, "
        f"'blocks', transform({heads}, head -> {folded})))"
    )


def _bases() -> str:
    """The place each block starts at, next to the blocks."""
    step = (
        f"named_struct('here', {_place(*_shift('state.here', 'block.fin'))}, "
        "'bases', concat(state.bases, array(state.here)))"
    )
    first = f"named_struct('here', {_START}, 'bases', CAST(array() AS array<{_PLACE}>))"
    folded = f"aggregate(p.blocks, {first}, (state, block) -> {step}, state -> state.bases)"
    return f"transform(_blocks, p -> named_struct({_RULE}, 'blocks', p.blocks, 'bases', {folded}))"


def _spans(positions: bool) -> str:
    begin, fin = _shift("base", "mark.begin"), _shift("base", "mark.fin")
    fields = [
        ("start", begin[0]), ("ord", "p.ord"), ("end", fin[0]), ("pattern_id", "p.id"), ("label", "p.label"),
    ]
    if positions:
        fields += [
            ("line", begin[1]), ("character", begin[2]), ("end_line", fin[1]), ("end_character", fin[2]),
        ]
    span = "named_struct(" + ", ".join(f"'{name}', {sql}" for name, sql in fields) + ")"
    placed = f"zip_with(p.blocks, p.bases, (block, base) -> transform(block.marks, mark -> {span}))"
    return f"array_sort(flatten(transform(_based, p -> flatten({placed}))))"


def with_spans(
    df: DataFrame,
    rules: Sequence[Rule] | None = None,
    text: str = "text",
    positions: bool = False,
    matched: str | None = None,
) -> DataFrame:
    """Keeps units with findings and adds ``spans``, sorted by start, then rule order.

    ``matched`` names an existing column of matched rules to use instead of ``rules``.
    """
    name = matched or "matched"
    if matched:
        found = df.filter(F.size(matched) > 0)
    else:
        found = with_matched(df, rules, text, only_found=True)
    kept = [c for c in found.columns if c != name]
    steps = {
        "_pieces": _pieces(ident(text), ident(name)),
        "_segments": _segments(positions),
        "_blocks": _blocks(),
        "_based": _bases(),
        "spans": _spans(positions),
    }
    # Each step reads the one before more than once, hence a column for each.
    for column, step in steps.items():
        found = found.select(*kept, F.expr(step).alias(column))
    return found


def detect_spans(
    df: DataFrame,
    rules: Sequence[Rule] | None = None,
    text: str = "text",
    positions: bool = False,
    keep: Sequence[str] | None = None,
    matched: str | None = None,
) -> DataFrame:
    """One row per span: the columns in ``keep`` (all but the text) and the span."""
    if keep is None:
        keep = [c for c in df.columns if c not in (text, matched)]
    wide = with_spans(df, rules, text, positions, matched)
    return wide.select(*keep, F.inline("spans"))


def span_positions(
    df: DataFrame, rules: Sequence[Rule] | None = None, text: str = "text"
) -> DataFrame:
    """Spans with 0-based line and character of start and end."""
    return detect_spans(df, rules, text, positions=True)


def utf16_offset(text: Column, offset: Column) -> Column:
    """A code point offset counted in UTF-16 units."""
    return utf16_length(F.substring(text, F.lit(1), offset))


def diagnostics_rows(
    df: DataFrame,
    rules: Sequence[Rule] | None = None,
    text: str = "text",
    path: str = "path",
    globs: Sequence[str] = (),
    max_bytes: int = MAX_TEXT_BYTES,
    source: str = "textwarden",
) -> DataFrame:
    """One warning per span; none for units that are too large or excluded."""
    units = size_gate(df, max_bytes, text)
    if globs:
        units = units.filter(~is_excluded(F.col(path), globs))
    kept = [c for c in df.columns if c != text]
    return span_positions(units, rules, text).select(
        *kept,
        "line",
        "character",
        "end_line",
        "end_character",
        F.concat(F.lit("Sensitive data detected: "), F.col("label")).alias("message"),
        F.lit("Warning").alias("severity"),
        F.col("pattern_id").alias("code"),
        F.lit(source).alias("diagnostic_source"),
    )


def placeholder_of(pattern_id: Column, rules: Sequence[Rule] | None = None) -> Column:
    """Placeholder of the first rule with the id, or null."""
    first: dict[str, str] = {}
    for rule in builtin_rules() if rules is None else rules:
        first.setdefault(rule.id, rule.placeholder)
    if not first:
        return F.lit(None).cast("string")
    table = F.create_map(*[F.lit(x) for pair in first.items() for x in pair])
    return F.try_element_at(table, pattern_id)


def sanitize_span(
    df: DataFrame,
    rules: Sequence[Rule] | None = None,
    text: str = "text",
    start: str = "start",
    end: str = "end",
    pattern_id: str = "pattern_id",
    out: str = "sanitized",
) -> DataFrame:
    """Replaces just the span named in each row; an unknown rule leaves the text alone."""
    placeholder = placeholder_of(F.col(pattern_id), rules)
    return df.select(
        "*", replace_span(F.col(text), F.col(start), F.col(end), placeholder).alias(out)
    )


def sanitize_first_span(
    df: DataFrame, rules: Sequence[Rule] | None = None, text: str = "text"
) -> DataFrame:
    """Replaces the first span of every unit that has one."""
    kept = df.columns
    first = with_spans(df, rules, text).select(*kept, F.get("spans", F.lit(0)).alias("_span"))
    spread = first.select(
        *kept,
        F.col("_span.start").alias("start"),
        F.col("_span.end").alias("end"),
        F.col("_span.pattern_id").alias("pattern_id"),
    )
    return sanitize_span(spread, rules, text)
