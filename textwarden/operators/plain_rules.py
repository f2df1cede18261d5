"""Very many rules tried on a text at once, where they ask for plain text.

Most rules of users are words: literal text, word boundaries, white space between.  The texts
they begin with make up a trie of steps of four bytes, which is walked from all places of many
texts together, with whole arrays; the rest of a rule is followed from where its beginning
stands.  So rules cost little that do not, however many there are and however alike they begin.
Of other rules the literal text is looked up, which tells the texts to try their regex on.

Bytes are compared, which is the same as comparing signs: the first byte of a sign in UTF-8 is
never inside another, and word signs and their boundaries are ASCII.  White space beyond ASCII
is not followed; such a place leaves the text to the regex.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
from pyspark import cloudpickle

from textwarden.functions.dialect import EDGE, ONE, SOME, TEXT, Translated

# Workers need not have this package: what tasks call travels with them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bytes of text, or places in a long text, that are looked at together.
BLOCK = 1 << 20
#: Beginnings that are followed together.
PAIRS = 1 << 21
#: Bytes of a step in the trie.
KEY = 4
# A step from a node: the text ends after 1 to 4 bytes, or goes on after the four.
_ON = KEY + 1
_MASKS = [np.uint32((1 << 8 * min(code, KEY)) - 1) for code in range(_ON + 1)]
_HASH = np.uint64(0x9E3779B97F4A7C15)
#: Between texts; no byte of UTF-8.
_WALL = b"\xff"
#: Signs of a run that are followed one by one in all places together.
_STEPWISE = 16


def _table(members: Iterable[int]) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(members)] = True
    return out


_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32
_WORD = _table([*range(48, 58), *range(65, 91), *range(97, 123), 95])
_CLASSES = {"s": _table([*range(9, 14), 32]), "d": _table(range(48, 58)), "w": _WORD}
# First bytes of the white space beyond ASCII.
_MAYBE = {"s": _table([0xC2, 0xE1, 0xE2, 0xE3, 0xEF]), "d": _table([]), "w": _table([])}
_BEYOND = {"s": re.compile(rb"[^\t-\r ]"), "d": re.compile(rb"[^0-9]"), "w": re.compile(rb"[^0-9A-Za-z_]")}
_KINDS = [(TEXT, ""), (EDGE, ""), *((kind, name) for kind in (ONE, SOME) for name in _CLASSES)]


class Plain(NamedTuple):
    """Patterns as arrays, and the trie of their first texts.

    A key of the trie is a node, a code and up to four bytes; its value is a node, or the list of
    the patterns that begin with this text.
    """

    first: np.ndarray  # first step of each pattern; the next pattern's is behind the last
    begun: np.ndarray  # the step behind the first text
    head: np.ndarray  # bytes of the first text
    edge: np.ndarray  # whether a boundary before it is still to be tested
    kind: np.ndarray
    start: np.ndarray  # where the text of each step is in ``signs``
    size: np.ndarray
    signs: np.ndarray
    folded: np.ndarray
    exact: np.ndarray
    keys: np.ndarray
    values: np.ndarray
    maybe: np.ndarray  # false where no key has this hash
    codes: np.ndarray  # bits of the codes of each node
    lists: np.ndarray
    members: np.ndarray
    roots: tuple[tuple[bool, bool, int], ...]  # case ignored, at the start of a word, node


def probe(regex: Translated) -> tuple[tuple[tuple[str, str], ...], bool, bool] | None:
    """``(steps, folded, exact)`` to look for, or None if no text is certain to be in a hit.

    If not ``exact``, the steps are in all texts the regex hits, and in others.
    """
    if regex.steps is not None:
        return regex.steps, regex.folded, True
    if regex.needle and not any(0xD800 <= ord(ch) <= 0xDFFF or ch == "\uFFFD" for ch in regex.needle):
        return ((TEXT, regex.needle),), regex.folded, False
    return None


def plain_index(probes: Sequence[tuple[tuple[tuple[str, str], ...], bool, bool]]) -> Plain:
    """The probes as arrays."""
    first, begun, head, edge, kind, start, size, signs = [0], [], [], [], [], [], [], bytearray()
    roots: dict[tuple[bool, bool], int] = {}
    trie: dict[int, int] = {}
    codes: list[int] = []
    lists: list[list[int]] = []

    def node() -> int:
        codes.append(0)
        return len(codes) - 1

    def step(at: int, code: int, text: bytes) -> int:
        codes[at] |= 1 << code
        return at << 35 | code << 32 | int.from_bytes(text, "little")

    for number, (steps, folded, _) in enumerate(probes):
        for name, value in steps:
            found = value.encode() if name == TEXT else b""
            kind.append(_KINDS.index((name, "" if name == TEXT else value)))
            start.append(len(signs))
            size.append(len(found))
            signs += found
        lead = next(i for i, (name, _) in enumerate(steps) if name == TEXT)
        text = steps[lead][1].encode()
        begun.append(first[-1] + lead + 1)
        first.append(len(kind))
        head.append(len(text))
        at_word = lead > 0 and bool(_WORD[text[0]])
        edge.append(lead > 0 and not at_word)
        if (folded, at_word) not in roots:
            roots[folded, at_word] = node()
        at, done = roots[folded, at_word], 0
        while len(text) - done > KEY:
            key = step(at, _ON, text[done : done + KEY])
            if key not in trie:
                trie[key] = node()
            at, done = trie[key], done + KEY
        key = step(at, len(text) - done, text[done:])
        if key not in trie:
            trie[key] = len(lists)
            lists.append([])
        lists[trie[key]].append(number)

    keys = np.array(sorted(trie), np.uint64)
    maybe = np.zeros(1 << min(24, max(16, len(keys).bit_length() + 4)), bool)
    maybe[_hashed(keys, maybe)] = True
    return Plain(
        *(np.array(x, np.int64) for x in (first, begun, head)), np.array(edge, bool),
        *(np.array(x, np.int64) for x in (kind, start, size)), np.array(list(signs), np.uint8),
        np.array([p[1] for p in probes], bool), np.array([p[2] for p in probes], bool),
        keys, np.array([trie[k] for k in keys.tolist()], np.int64), maybe, np.array(codes, np.uint8),
        np.cumsum([0, *map(len, lists)]), np.array([n for own in lists for n in own], np.int64),
        tuple((*which, root) for which, root in sorted(roots.items())),
    )


def _hashed(keys: np.ndarray, maybe: np.ndarray) -> np.ndarray:
    return (keys * _HASH) >> np.uint64(65 - len(maybe).bit_length())


def spread(first: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(i, member)`` for every member of the list ``which[i]``; list ``k`` is ``first[k]:first[k + 1]``."""
    sizes = first[which + 1] - first[which]
    owner = np.repeat(np.arange(len(which)), sizes)
    ends = np.cumsum(sizes)
    place = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes, sizes)
    return owner, first[which][owner] + place


def _joined(parts: Sequence[np.ndarray]) -> np.ndarray:
    return np.concatenate(parts) if parts else np.empty(0, np.int64)


def _begins(index: Plain, signs: np.ndarray, places: np.ndarray, root: int) -> tuple[np.ndarray, np.ndarray]:
    """``(place, list)`` for each text of the trie that stands at a place."""
    found: list[tuple[np.ndarray, np.ndarray]] = []
    began, node, depth = places, None, 0
    while len(began):
        # What was met so far lies in the text, so the next four bytes are at most its wall and the fill.
        four = signs[began + depth].astype(np.uint32)
        for i in range(1, KEY):
            four |= signs[began + (depth + i)].astype(np.uint32) << np.uint32(8 * i)
        on = _joined([]), _joined([])
        for code in range(1, _ON + 1):
            if node is None:
                if not index.codes[root] >> code & 1:
                    continue
                some, base = slice(None), np.uint64(root << 35 | code << 32)
            else:
                some = np.flatnonzero(index.codes[node] >> code & 1)
                base = node[some].astype(np.uint64) << np.uint64(35) | np.uint64(code << 32)
            key = (four[some] & _MASKS[code]) | base
            held = np.flatnonzero(index.maybe[_hashed(key, index.maybe)])
            at = np.minimum(np.searchsorted(index.keys, key[held]), len(index.keys) - 1)
            same = index.keys[at] == key[held]
            step = began[some][held[same]], index.values[at[same]]
            if code == _ON:
                on = step
            else:
                found.append(step)
        (began, node), depth = on, depth + KEY
    return _joined([x for x, _ in found]), _joined([x for _, x in found])


def _run_end(block: bytes, raw: np.ndarray, at: np.ndarray, name: str) -> np.ndarray:
    """The first place behind the run of a class that starts at each place."""
    at, left = at.copy(), np.arange(len(at))
    for _ in range(_STEPWISE):
        left = left[_CLASSES[name][raw[at[left]]]]
        if not len(left):
            return at
        at[left] += 1
    end = 0
    for i in left[np.argsort(at[left])].tolist():
        # Places in one run share its end.
        if at[i] >= end:
            end = _BEYOND[name].search(block, at[i]).start()
        at[i] = end
    return at


def _same_text(index: Plain, both: np.ndarray, at: np.ndarray, pattern: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Whether the text of a step stands at a place."""
    ok = np.ones(len(at), bool)
    size, start, side = index.size[step], index.start[step], index.folded[pattern].astype(np.int64)
    left = np.arange(len(at))
    for j in range(int(size.max(initial=0))):
        left = left[size[left] > j]
        same = both[side[left], at[left] + j] == index.signs[start[left] + j]
        ok[left[~same]] = False
        left = left[same]
        if not len(left):
            break
    return ok


def _follow(
    index: Plain, block: bytes, both: np.ndarray, word: np.ndarray, place: np.ndarray, pattern: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the beginnings that are hits, and of those only the regex can tell."""
    raw, hits, open_ = both[0], [], []
    left = np.flatnonzero(~index.edge[pattern] | (word[place] != word[place - 1]))
    at, step = place[left] + index.head[pattern[left]], index.begun[pattern[left]]
    while len(left):
        over = step == index.first[pattern[left] + 1]
        hits.append(left[over])
        left, at, step = left[~over], at[~over], step[~over]
        ok, unsure, kinds = np.zeros(len(left), bool), np.zeros(len(left), bool), index.kind[step]
        for number in np.unique(kinds).tolist():
            name, value = _KINDS[number]
            some = np.flatnonzero(kinds == number)
            here = at[some]
            if name == EDGE:
                ok[some] = word[here] != word[here - 1]
            elif name == TEXT:
                ok[some] = _same_text(index, both, here, pattern[left[some]], step[some])
                at[some] += index.size[step[some]]
            elif name == ONE:
                ok[some] = _CLASSES[value][raw[here]]
                unsure[some] = _MAYBE[value][raw[here]]
                at[some] += 1
            else:
                end = _run_end(block, raw, here, value)
                unsure[some] = _MAYBE[value][raw[end]]
                ok[some] = (end > here) & ~unsure[some]
                at[some] = end
        open_.append(left[unsure])
        left, at, step = left[ok], at[ok], step[ok] + 1
    return _joined(hits), _joined(open_)


def _portions(sizes: np.ndarray) -> list[slice]:
    """Neighbours whose sizes add up to about ``PAIRS`` at most."""
    cuts = np.flatnonzero(np.diff((np.cumsum(sizes) - 1) // PAIRS)) + 1
    bounds = [0, *cuts.tolist(), len(sizes)]
    return [slice(a, b) for a, b in zip(bounds, bounds[1:])]


def _block_hits(index: Plain, texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """``(text, pattern)`` as one number each, distinct: certain hits, and what is left to the regex."""
    block = _WALL + _WALL.join(texts) + _WALL + bytes(KEY)
    raw = np.frombuffer(block, np.uint8)
    both = np.stack([raw, _LOW[raw]])
    word = _WORD[raw]
    starts = np.cumsum([1, *(len(t) + 1 for t in texts)])
    count = len(index.exact)
    sure, tried = [], []
    for low in range(1, int(starts[-1]), BLOCK):
        high = min(low + BLOCK, int(starts[-1]))
        at_words = np.flatnonzero(word[low:high] & ~word[low - 1 : high - 1]) + low
        for folded, at_word, root in index.roots:
            places = at_words if at_word else np.arange(low, high)
            begins, lists = _begins(index, both[int(folded)], places, root)
            for some in _portions(index.lists[lists + 1] - index.lists[lists]):
                owner, member = spread(index.lists, lists[some])
                place, pattern = begins[some][owner], index.members[member]
                hits, open_ = _follow(index, block, both, word, place, pattern)
                pair = (np.searchsorted(starts, place, "right") - 1) * count + pattern
                exact = index.exact[pattern[hits]]
                sure.append(np.unique(pair[hits[exact]]))
                tried.append(np.unique(np.concatenate([pair[hits[~exact]], pair[open_]])))
    certain = np.unique(_joined(sure))
    return certain, np.setdiff1d(_joined(tried), certain)


def portions(sizes: Sequence[int]) -> Iterator[tuple[int, int]]:
    """Neighbours of about ``BLOCK`` bytes at most, as ``(begin, end)``; a larger text is alone."""
    begin = held = 0
    for at, size in enumerate(sizes):
        if at > begin and held + size > BLOCK:
            yield begin, at
            begin, held = at, 0
        held += size
    yield begin, len(sizes)


def plain_hits(index: Plain, texts: Sequence[bytes | None]) -> tuple[tuple[np.ndarray, np.ndarray], ...]:
    """Lists of patterns for each text, as ``(0 and the end of each, patterns)``: certain hits, and those to try."""
    count = max(1, len(index.exact))
    out = []
    for pairs in _block_hits(index, [text or b"" for text in texts]):
        ends = np.concatenate([[0], np.cumsum(np.bincount(pairs // count, minlength=len(texts)))])
        out.append((ends.astype(np.int32), (pairs % count).astype(np.int32)))
    return tuple(out)
