"""One large set of user rules for all texts, found through an index of their literals.

A set that is too large to be unrolled into the plan stays a table.  Every hit of a rule
holds the rule's literal, whose pieces of four bytes make up the index.  A text meets a rule
only if it holds every one of them; that is a join of numbers, the pieces of the texts
against the index.  What is left is a short list of rules for each text.  It is joined to the
text, which is moved once however many rules it meets, and tried there: a regex is compiled
for each text it is tried on, which costs less than to move the text for each rule.

A set that is small enough to be sent to every task needs no join: texts meet the rules where
they lie (``plain_rules``), and only a regex that asks for more than plain text is tried on them.

Rules without a literal of four signs, or in a set that is sent without any, cannot be found
this way.  They are unrolled, as sets of ordinary size are, and too many of them is an error.

Defined results: a null text meets no rule; rows with one key count as one text each only
if their texts agree, so keys are unique; rules keep their order, equal ids are all kept.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textwarden.functions import dialect
from textwarden.functions.detect import MATCHED_TYPE, hit_flags, matched_rules
from textwarden.functions.sqltext import computed_once, ident
from textwarden.operators import plain_rules
from textwarden.operators.custom_rules import MAX_LITERAL_RULES, can_hit, collect_rules
from textwarden.operators.staging import broadcast_if_small, measured, stage

# Workers need not have this package: what tasks call travels with them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bytes of a piece; rules whose literal has fewer signs are unrolled.
PIECE = 4
#: Rule sets up to this size, as JSON text, are sent to every task: some 50 000 rules.
SENT_BYTES = 16 * 1024 * 1024


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _pieces_of(texts: pd.Series) -> pd.Series:
    def one(text: bytes | None) -> np.ndarray:
        signs = np.frombuffer(text or b"", np.uint8)
        if len(signs) < PIECE:
            return np.empty(0, np.int32)
        low = np.where((signs >= 65) & (signs <= 90), signs | 32, signs).astype(np.uint32)
        pieces = sum(low[i : len(low) - PIECE + 1 + i] << np.uint32(8 * i) for i in range(PIECE))
        return np.unique(pieces.astype(np.uint32)).view(np.int32)

    return texts.map(one, na_action=None)


def _pieces(text: str) -> Column:
    """The distinct pieces of a text in UTF-8, each as a number; ASCII letters in lower case."""
    return _pieces_of(F.col(text).cast("binary"))


def rule_index(rules: DataFrame) -> DataFrame:
    """``(piece, ord, pieces)``: every piece of every rule's literal, and how many the rule has."""
    named = rules.filter(F.length("literal") >= PIECE).select("ord", _pieces("literal").alias("all"))
    return named.select("ord", F.size("all").alias("pieces"), F.explode("all").alias("piece"))


def met_rules(units: DataFrame, rules: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, _met)``: for each text that holds all pieces of some rules, these rules in order."""
    index = broadcast_if_small(rule_index(rules))
    held = units.select(F.col(key).alias(key), _pieces(text).alias("all")).select(key, F.explode("all").alias("piece"))
    met = held.join(index, "piece").groupBy(key, "ord").agg(F.count("*").alias("n"), F.first("pieces").alias("pieces"))
    entry = F.struct("ord", "id", "label", "risk", "critical", F.col("java_regex").alias("regex"), "needle").alias("entry")
    entries = broadcast_if_small(rules.select("ord", entry))
    # Dealt by key while the rows are two numbers; the entries join them where they lie.
    pairs = met.filter("n = pieces").select(key, "ord").repartition(key).join(entries, "ord")
    return pairs.groupBy(key).agg(F.sort_array(F.collect_list("entry")).alias("_met"))


_FOUND = f"sure {MATCHED_TYPE}, tried array<struct<regex:string,rules:{MATCHED_TYPE}>>"


def _sent(units: DataFrame, rules: DataFrame, text: str) -> tuple[DataFrame, list[int]]:
    """Units with ``_plain``, the rules found and to be tried in each; places of the rules left out.

    Rules with one regex are one pattern, so it is looked for once.
    """
    fields = ("ord", "id", "label", "risk", "critical", "java_regex")
    table = rules.select(*fields, "regex", "flags").orderBy("ord").toArrow().combine_chunks()
    patterns: dict[str, list[int]] = {}
    for place, regex in enumerate(table["java_regex"].to_pylist()):
        patterns.setdefault(regex, []).append(place)
    one = table.select(["regex", "flags"]).take(pa.array([own[0] for own in patterns.values()], pa.int64()))
    probes = [plain_rules.probe(dialect.translate(*row)) for row in zip(*(c.to_pylist() for c in one.columns))]
    left_out = [place for own, probe in zip(patterns.values(), probes) if probe is None for place in own]
    named = {regex: own for (regex, own), probe in zip(patterns.items(), probes) if probe is not None}
    index = plain_rules.plain_index([probe for probe in probes if probe is not None])

    columns = [pa.concat_arrays(table[name].chunks or [pa.array([], table[name].type)]) for name in fields]
    order = pa.array([place for own in named.values() for place in own], pa.int64())
    entries = pa.StructArray.from_arrays(columns, names=[*fields[:-1], "regex"]).take(order)
    first = np.cumsum([0, *map(len, named.values())])
    own = pa.ListArray.from_arrays(first.astype(np.int32), entries)
    entry = pa.StructArray.from_arrays([pa.array(list(named), pa.string()), own], names=["regex", "rules"])
    # Workers have no classes of this package to read an index with.
    parts = tuple(index), first, entries, entry
    sent = units.sparkSession.sparkContext.broadcast(parts)

    @F.arrow_udf(_FOUND)
    def found_in(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        arrays, first, entries, entry = sent.value
        index = plain_rules.Plain(*arrays)
        for batch in batches:
            texts = batch.cast(pa.binary())
            # What is given back at once is bounded too, however many rules each text meets.
            for begin, end in plain_rules.portions(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
                found = plain_rules.plain_hits(index, texts.slice(begin, end - begin).to_pylist())
                (ends, sure), (tried_ends, tried) = found
                owner, member = plain_rules.spread(first, sure)
                # The lists end at patterns; counted in rules they end behind all rules of these.
                ends = np.searchsorted(owner, ends).astype(np.int32)
                lists = (ends, entries.take(pa.array(member))), (tried_ends, entry.take(pa.array(tried)))
                yield pa.StructArray.from_arrays([pa.ListArray.from_arrays(*x) for x in lists], names=["sure", "tried"])

    places = table["ord"].take(pa.array(left_out[: MAX_LITERAL_RULES + 1], pa.int64())).to_pylist()
    return units.select("*", found_in(F.col(text)).alias("_plain")), places


def match_shared_rules(
    units: DataFrame, rules: DataFrame, key: str = "doc_id", text: str = "text", max_sent: int = 0
) -> DataFrame:
    """Units with ``matched``: built-in rules, then those of a compiled set of any size.

    ``rules`` comes from ``compile_rules(raw, max_custom, key=None)``.  A set that measures at
    most ``max_sent`` bytes is sent to every task and no text is moved; a larger one is joined
    to the texts.
    """
    rules = stage(rules)
    if max_sent and measured(rules) <= max_sent:
        joined, left_out = _sent(units, rules, text)
        plain = collect_rules(rules.filter(F.col("ord").isin(left_out)))
        tried = f"filter(_plain.tried, r -> rlike({ident(text)}, r.regex))"
        found = f"cast(concat(_plain.sure, flatten(transform({tried}, r -> r.rules))) AS {MATCHED_TYPE})"
    else:
        plain = collect_rules(rules.filter(F.col("literal").isNull() | (F.length("literal") < PIECE)))
        joined = units.join(met_rules(units, rules, key, text), key, "left")
        tried = f"filter(_met, r -> {can_hit(ident(text))} AND coalesce(rlike({ident(text)}, r.regex), false))"
        found = (
            f"cast(transform(coalesce({tried}, array()), r -> named_struct('ord', r.ord, 'id', r.id, 'label', r.label, "
            f"'risk', r.risk, 'critical', r.critical, 'regex', r.regex)) AS {MATCHED_TYPE})"
        )
    flagged = computed_once(joined, _flags=hit_flags(ident(text), plain), _found=found)
    both = F.expr(f"array_sort(concat(cast({matched_rules('_flags', plain)} AS {MATCHED_TYPE}), _found))")
    return flagged.select(*units.columns, both.alias("matched"))
