"""What the rows of one owner do to the monitor's state, one after the other.

Used by the batch monitor for the rows of a chunk, and by the stream for those of a
micro-batch.  The state is a counter, a hash and numbers of ticks; no text is part of it.

What a sanitize decision puts in place of a text is remembered by the number of its tick, not
by its hash, so no text has to be rewritten to find outcomes.  Nothing is ever compared with
it: the decision also opens a suppression, so the next tick is suppressed, whatever its text,
and is then the one remembered.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

# Workers need not have this package: what tasks call travels with them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: The hash of the empty text.
EMPTY_KEY = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row ``(text, rows)`` for the rows of a batch that share a text; the rest of each is in the list.

    The monitor looks again and again at texts that have not changed.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        text = batch.column("text").dictionary_encode()
        rest = [c for c in batch.schema.names if c != "text"]
        rows = pa.StructArray.from_arrays([batch.column(c) for c in rest], rest)
        # Rows without a text come last and are one group.
        known = len(text.dictionary)
        group = pc.fill_null(text.indices, known).to_numpy(zero_copy_only=False)
        sizes = np.bincount(group, minlength=known)
        lists = pa.ListArray.from_arrays(
            pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), rows.take(pa.array(np.argsort(group, kind="stable")))
        )
        texts = text.dictionary if len(sizes) == known else pa.concat_arrays([text.dictionary, pa.nulls(1, text.dictionary.type)])
        yield pa.RecordBatch.from_arrays([texts, lists], ["text", "rows"])


class Step(NamedTuple):
    """A row without its text."""

    seq: int
    kind: str
    choice: str | None
    path: str | None
    text_key: str | None
    is_empty: bool | None
    too_large: bool | None
    is_low: bool | None


class State(NamedTuple):
    """Suppressions open, the remembered text, and the alert that waits for an answer."""

    opened: int = 0
    memory: str = EMPTY_KEY
    alert_seq: int | None = None
    alert_path: str | None = None


def step(
    state: State, row: Step, is_ignored: Callable[[str], bool], ignore: Callable[[str], None]
) -> tuple[State, str | None, int | None]:
    """The state after a row, the row's outcome, and the tick a sanitize decision answers.

    An alert is answered once, before the next tick; any other decision is ``refused``
    and changes nothing.
    """
    if row.kind == "suppress":
        return state._replace(opened=state.opened + 1), None, None
    if row.kind == "decision":
        if state.alert_seq is None:
            return state, "refused", None
        after = State(state.opened, state.memory)
        if row.choice == "sanitize":
            cleaned = f"sanitized {state.alert_seq}"
            return after._replace(opened=state.opened + 1, memory=cleaned), "applied", state.alert_seq
        if row.choice == "ignore" and state.alert_path:
            ignore(state.alert_path)
        return after, "applied", None
    if state.opened > 0:
        return State(state.opened - 1, row.text_key), "suppressed", None
    if row.is_empty or row.text_key == state.memory:
        return State(0, state.memory), "unchanged", None
    after = State(0, row.text_key)
    if row.too_large:
        return after, "too_large", None
    if row.path and is_ignored(row.path):
        return after, "ignored", None
    if row.is_low:
        return after, "low", None
    return after._replace(alert_seq=row.seq, alert_path=row.path), "alert", None


#: What a chunk says: the state of its last owner, the paths that owner ignored, the outcomes of its rows.
SAYS = (
    "what string, chunk int, owner string, opened int, memory string, alert_seq long, alert_path string, "
    "path string, seq long, outcome string, tick_seq long"
)
_SAYS = pa.schema(
    [("what", pa.string()), ("chunk", pa.int32()), ("owner", pa.string()), ("opened", pa.int32()), ("memory", pa.string()),
     ("alert_seq", pa.int64()), ("alert_path", pa.string()), ("path", pa.string()),
     ("seq", pa.int64()), ("outcome", pa.string()), ("tick_seq", pa.int64())]
)


def _entries(chunk: int, rows: pa.Table, given: pa.Table, outcomes: bool) -> Iterator[dict]:
    rows = rows.sort_by([("owner", "ascending"), ("seq", "ascending")])
    owners = rows.column("owner").to_pylist()
    steps = map(Step, *(rows.column(c).to_pylist() for c in Step._fields))
    states, ignored = {}, {}
    for r in given.to_pylist():
        if r["what"] == "state":
            states[r["owner"]] = State(r["opened"], r["memory"], r["alert_seq"], r["alert_path"])
        else:
            ignored.setdefault(r["owner"], set()).add(r["path"])
    owner, state, known, added = None, State(), set(), []
    for name, row in zip(owners, steps):
        if name != owner:
            owner, state, known, added = name, states.get(name, State()), ignored.get(name, set()), []

        def ignore(path: str, known=known, added=added) -> None:
            if path not in known:
                known.add(path)
                added.append(path)

        state, outcome, tick = step(state, row, known.__contains__, ignore)
        if outcomes and outcome:
            yield {"what": "outcome", "owner": name, "seq": row.seq, "outcome": outcome, "tick_seq": tick}
    if not outcomes:
        yield {"what": "state", "owner": owner, **state._asdict()}
        yield from ({"what": "ignored", "owner": owner, "path": path} for path in added)


def run_chunk(rows: pa.Table, given: pa.Table, outcomes: bool = False) -> pa.Table:
    """What a chunk's rows lead to from the states and ignored paths it is given."""
    if not rows.num_rows:
        return _SAYS.empty_table()
    chunk = rows.column("chunk")[0].as_py()
    return pa.Table.from_pylist([e | {"chunk": chunk} for e in _entries(chunk, rows, given, outcomes)], _SAYS)


def run_rows(state: State, rows: Iterable[Step], is_ignored, ignore) -> tuple[State, list[tuple[Step, str, int | None]]]:
    """The rows of one owner, in order."""
    out = []
    for row in rows:
        state, outcome, tick = step(state, row, is_ignored, ignore)
        if outcome:
            out.append((row, outcome, tick))
    return state, out
