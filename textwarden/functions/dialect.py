"""Rewrites JavaScript regular expressions for Java (Spark) and RE2 (DuckDB).

Rule files carry JavaScript syntax.  Spark runs ``java.util.regex``, where the
same text can mean something else (``\\b`` and ``\\s`` over non-ASCII text, ``$``
before a last newline, ``{{``, ``[a&&b]``) or does not compile at all.  Each
construct is emitted again in a form that means the same in the target.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

JAVA = "java"
RE2 = "re2"

_WORD = "A-Za-z0-9_"
_DIGITS = set("0123456789")
_WORD_CHARS = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_")
_CONTROL = {"n": "\n", "r": "\r", "t": "\t", "v": "\v", "f": "\f"}
# White space and line ends as JavaScript defines them.
_SPACE_POINTS = (
    (0x09, 0x0D), (0x20, 0x20), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A),
    (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000), (0xFEFF, 0xFEFF),
)
_EOL_POINTS = ((0x0A, 0x0A), (0x0D, 0x0D), (0x2028, 0x2029))
_MAX_REPEAT = 2**31 - 1

#: Kinds of steps in a plain pattern.
TEXT, EDGE, ONE, SOME = "text", "edge", "one", "some"


# General categories and the scripts in wide use, as both dialects name them.
CATEGORIES = frozenset(
    "L Lu Ll Lt Lm Lo M Mn Mc Me N Nd Nl No P Pc Pd Ps Pe Pi Pf Po S Sm Sc Sk So Z Zs Zl Zp C Cc Cf Co Cn".split()
)
SCRIPTS = frozenset(
    "Arabic Armenian Bengali Bopomofo Cherokee Common Cyrillic Devanagari Ethiopic Georgian Greek Gujarati "
    "Gurmukhi Han Hangul Hebrew Hiragana Inherited Kannada Katakana Khmer Lao Latin Malayalam Mongolian Myanmar "
    "Oriya Sinhala Syriac Tamil Telugu Thaana Thai Tibetan".split()
)


class RegexError(ValueError):
    """The pattern is not valid, or has no equivalent on the target."""


@dataclass(frozen=True)
class Translated:
    pattern: str
    groups: int
    names: dict[str, int]
    #: Text every match holds, in lower case if ``folded``; None if nothing is certain.
    needle: str | None = None
    folded: bool = False
    #: What the pattern asks for in order, if it is no more than that; see ``_plain``.
    steps: tuple[tuple[str, str], ...] | None = None


@dataclass
class _Part:
    """One emitted piece, with what is known of its first and last character."""

    text: str
    starts_word: bool = False
    first: str | None = None
    ends_word: bool = False
    nullable: bool = False
    boundary: bool = False
    assertion: bool = False
    repeatable: bool = True
    unbounded: bool = False
    char: str | None = None
    must: str = ""
    steps: tuple[tuple[str, str], ...] | None = None


def _code(point: int, target: str) -> str:
    if target == RE2:
        return f"\\x{{{point:x}}}"
    return f"\\x{{{point:x}}}" if point > 0xFFFF else f"\\u{point:04X}"


def _ranges(points, target: str) -> str:
    return "".join(
        _code(a, target) if a == b else f"{_code(a, target)}-{_code(b, target)}" for a, b in points
    )


def space_class(target: str = JAVA) -> str:
    """Body of a character class holding JavaScript white space."""
    return _ranges(_SPACE_POINTS, target)


def literal(text: str, target: str = JAVA) -> str:
    """A pattern that matches exactly ``text``."""
    out = []
    for ch in text:
        if ch in _WORD_CHARS or (ord(ch) > 0x7E and ch.isprintable()):
            out.append(ch)
        elif 0x20 <= ord(ch) < 0x7F:
            out.append("\\" + ch if ch != " " else " ")
        else:
            out.append(_code(ord(ch), target))
    return "".join(out)


class _Reader:
    def __init__(self, source: str, flags: str, target: str):
        self.src, self.at, self.target = source, 0, target
        self.ignore_case = "i" in flags
        self.multiline = "m" in flags
        self.dot_all = "s" in flags
        self.unicode = "u" in flags
        self.names = self._group_names()
        self.total = self._count_groups()
        self.opened = 0

    # -- whole pattern -----------------------------------------------------
    def run(self) -> Translated:
        part = self._choice()
        if self.at < len(self.src):
            raise RegexError("unmatched ')'")
        text = part.text
        if self.ignore_case and self.target == JAVA:
            text = f"(?i:{text})"
        needle, folded = part.must, self.ignore_case
        if folded:
            needle = needle.lower() if needle.isascii() else ""
        needle = needle if len(needle) > 1 else None
        return Translated(text, self.total, self.names, needle, folded, _plain(part.steps, folded))

    def _group_openers(self):
        """(index, name) of each capturing group, left to right."""
        depth_class, i = False, 0
        while i < len(self.src):
            ch = self.src[i]
            if ch == "\\":
                i += 1
            elif depth_class:
                depth_class = ch != "]"
            elif ch == "[":
                depth_class = True
            elif ch == "(":
                named = re.match(r"\(\?<([^=!>][^>]*)>", self.src[i:])
                if named:
                    yield named.group(1)
                elif not self.src.startswith("(?", i):
                    yield None
            i += 1

    def _group_names(self) -> dict[str, int]:
        names: dict[str, int] = {}
        for number, name in enumerate(self._group_openers(), 1):
            if name is not None:
                if name in names or not re.fullmatch(r"[A-Za-z_$][\w$]*", name):
                    raise RegexError(f"bad group name {name}")
                names[name] = number
        return names

    def _count_groups(self) -> int:
        return sum(1 for _ in self._group_openers())

    def _peek(self) -> str:
        return self.src[self.at] if self.at < len(self.src) else ""

    # -- structure ---------------------------------------------------------
    def _choice(self) -> _Part:
        branches = [self._sequence()]
        while self._peek() == "|":
            self.at += 1
            branches.append(self._sequence())
        if len(branches) == 1:
            return branches[0]
        known = all(b.first is not None and not b.nullable for b in branches)
        return _Part(
            "|".join(b.text for b in branches),
            first="".join(b.first for b in branches) if known else None,
            starts_word=all(b.starts_word for b in branches),
            ends_word=all(b.ends_word for b in branches),
            nullable=any(b.nullable for b in branches),
            unbounded=any(b.unbounded for b in branches),
        )

    def _sequence(self) -> _Part:
        parts: list[_Part] = []
        while self._peek() not in ("", "|", ")"):
            parts.append(self._repeat(self._term()))
        for i, part in enumerate(parts):
            if part.boundary:
                part.text = self._boundary(parts, i)
        solid = [p for p in parts if not p.assertion]
        return _Part(
            "".join(p.text for p in parts),
            first=solid[0].first if solid and not solid[0].nullable else None,
            starts_word=bool(solid) and solid[0].starts_word and not solid[0].nullable,
            ends_word=bool(solid) and solid[-1].ends_word and not solid[-1].nullable,
            nullable=all(p.nullable for p in solid),
            unbounded=any(p.unbounded for p in parts),
            must=self._certain(parts),
            steps=tuple(s for p in parts for s in p.steps) if all(p.steps is not None for p in parts) else None,
        )

    @staticmethod
    def _certain(parts: list[_Part]) -> str:
        """The longest text that is there whenever the sequence matches."""
        best = run = ""
        for part in parts:
            if part.char is not None:
                run += part.char
            elif not part.assertion:
                run = ""
            best = max(best, run, part.must, key=len)
        return best

    def _boundary(self, parts: list[_Part], i: int) -> str:
        """An ASCII word boundary; one-sided where a neighbour decides the other side."""
        if self.target == RE2:
            return r"\b"
        after = parts[i + 1] if i + 1 < len(parts) else None
        before = parts[i - 1] if i else None
        # Looking at the next character first rules most places out at less cost.
        ahead = f"(?=[{after.first}])" if after and after.first and not after.nullable else ""
        if after and after.starts_word and not after.nullable:
            return f"{ahead}(?<![{_WORD}])"
        if before and before.ends_word and not before.nullable:
            return f"(?![{_WORD}])"
        return f"{ahead}(?:(?<![{_WORD}])(?=[{_WORD}])|(?<=[{_WORD}])(?![{_WORD}]))"

    def _term(self) -> _Part:
        ch = self._peek()
        self.at += 1
        if ch == "(":
            return self._group()
        if ch == "[":
            return self._class()
        if ch == "\\":
            return self._escape()
        eol = _ranges(_EOL_POINTS, self.target)
        if ch == ".":
            return _Part("(?s:.)" if self.dot_all else f"[^{eol}]")
        if ch == "^":
            if not self.multiline:
                text = r"\A"
            else:
                text = f"(?<![^{eol}])" if self.target == JAVA else "(?m:^)"
            return _Part(text, nullable=True, assertion=True, repeatable=False)
        if ch == "$":
            if not self.multiline:
                text = r"\z"
            else:
                text = f"(?![^{eol}])" if self.target == JAVA else "(?m:$)"
            return _Part(text, nullable=True, assertion=True, repeatable=False)
        if ch in "*+?":
            raise RegexError("nothing to repeat")
        if ch == "{" and (self.unicode or re.match(r"\d+(,\d*)?\}", self.src[self.at:])):
            raise RegexError("nothing to repeat")
        if ch in "]}" and self.unicode:
            raise RegexError(f"lone {ch}")
        return self._char(ch)

    def _group(self) -> _Part:
        rest = self.src[self.at:]
        head, assertion, behind = "(", False, False
        named = re.match(r"\?<([^=!>][^>]*)>", rest)
        if named:
            self.at += named.end()
            self.opened += 1
        elif rest.startswith("?:"):
            head, self.at = "(?:", self.at + 2
        elif rest.startswith(("?=", "?!", "?<=", "?<!")):
            if self.target == RE2:
                raise RegexError("RE2 has no lookaround")
            behind = rest[1] == "<"
            size = 3 if behind else 2
            head, assertion, self.at = "(" + rest[:size], True, self.at + size
        elif rest.startswith("?"):
            raise RegexError("invalid group")
        else:
            self.opened += 1
        body = self._choice()
        if self._peek() != ")":
            raise RegexError("unterminated group")
        self.at += 1
        if behind and body.unbounded:
            raise RegexError("lookbehind without an upper bound")
        return _Part(
            f"{head}{body.text})",
            first=None if assertion else body.first,
            starts_word=body.starts_word and not assertion,
            ends_word=body.ends_word and not assertion,
            nullable=body.nullable or assertion,
            assertion=assertion,
            repeatable=not (assertion and (behind or self.unicode)),
            unbounded=body.unbounded,
            must="" if assertion else body.must,
            steps=None if assertion else body.steps,
        )

    def _repeat(self, part: _Part) -> _Part:
        found = re.match(r"(?:[*+?]|\{(\d+)(,(\d*))?\})\??", self.src[self.at:])
        if not found:
            return part
        if not part.repeatable:
            raise RegexError("nothing to repeat")
        token = found.group(0)
        low, high = (found.group(1), found.group(3)) if token[0] == "{" else (None, None)
        least = int(low) if low else {"*": 0, "+": 1, "?": 0}.get(token[0], 0)
        endless = token[0] in "*+" or (token[0] == "{" and found.group(2) and not high)
        if high and int(high) < least:
            raise RegexError("numbers out of order in repeat")
        if max(least, int(high or 0)) > _MAX_REPEAT:
            raise RegexError("repeat is too large")
        self.at += len(token)
        if re.match(r"[*+?]|\{\d+(,\d*)?\}", self.src[self.at:]):
            raise RegexError("nothing to repeat")
        text = f"(?:{part.text})" if part.assertion or part.boundary else part.text
        one = part.steps[0] if part.steps and len(part.steps) == 1 else None
        some = token[0] == "+" and one is not None and one[0] == ONE
        return _Part(
            text + token, part.starts_word, part.first, part.ends_word, part.nullable or least == 0,
            assertion=part.assertion, unbounded=part.unbounded or bool(endless),
            must=part.must if least else "",
            steps=((SOME, one[1]),) if some else None,
        )

    # -- atoms -------------------------------------------------------------
    def _char(self, ch: str) -> _Part:
        word = ch in _WORD_CHARS
        other = ch.swapcase() if self.ignore_case else ch
        if other != ch and len(other) == 1 and (self.target == RE2 or ord(ch) > 0x7F):
            both = literal(ch, self.target) + literal(other, self.target)
            return _Part(f"[{both}]", word, both, word, char=ch, steps=((TEXT, ch),))
        return _Part(
            literal(ch, self.target), word, literal(ch, self.target), word, char=ch, steps=((TEXT, ch),)
        )

    def _escape(self) -> _Part:
        ch = self._peek()
        if not ch:
            raise RegexError("pattern ends in a backslash")
        self.at += 1
        if ch == "b":
            return _Part(
                "", nullable=True, boundary=True, assertion=True, repeatable=False, steps=((EDGE, ""),)
            )
        if ch == "B":
            if self.target == RE2:
                text = r"\B"
            else:
                text = f"(?:(?<![{_WORD}])(?![{_WORD}])|(?<=[{_WORD}])(?=[{_WORD}]))"
            return _Part(text, nullable=True, assertion=True, repeatable=False)
        if ch in "dDwWsS":
            body = {"d": "0-9", "w": _WORD, "s": space_class(self.target)}[ch.lower()]
            word = ch in "dw"
            first = None if ch.isupper() else body
            steps = None if ch.isupper() else ((ONE, ch),)
            return _Part(f"[{'^' if ch.isupper() else ''}{body}]", word, first, word, steps=steps)
        if ch in "pP" and self.unicode:
            return _Part(self._property(ch))
        if ch == "k" and self.names:
            name = re.match(r"<([^>]+)>", self.src[self.at:])
            if not name or name.group(1) not in self.names:
                raise RegexError("unknown group name")
            self.at += name.end()
            return self._reference(self.names[name.group(1)])
        if ch in "123456789":
            digits = re.match(r"\d*", self.src[self.at:]).group(0)
            number = int(ch + digits)
            if number <= self.total:
                self.at += len(digits)
                return self._reference(number)
        return self._char(self._code_escape(ch))

    def _reference(self, number: int) -> _Part:
        if self.target == RE2:
            raise RegexError("RE2 has no back reference")
        return _Part(f"(?:\\{number})", nullable=True, unbounded=True)

    def _property(self, ch: str) -> str:
        found = re.match(r"\{(?:(General_Category|gc|Script|sc)=)?(\w+)\}", self.src[self.at:])
        if not found or self.target == RE2:
            raise RegexError("unsupported property escape")
        self.at += found.end()
        key, value = found.groups()
        if key in ("Script", "sc"):
            if value not in SCRIPTS:
                raise RegexError("unsupported property escape")
            return f"\\{ch}{{script={value}}}"
        if value not in CATEGORIES:
            raise RegexError("unsupported property escape")
        return f"\\{ch}{{{value}}}"

    def _code_escape(self, ch: str) -> str:
        """The character meant by ``\\ch``; the cursor is behind ``ch``."""
        rest = self.src[self.at:]
        if ch in _CONTROL:
            return _CONTROL[ch]
        for lead, form in (("x", r"([0-9A-Fa-f]{2})"), ("u", r"([0-9A-Fa-f]{4})")):
            found = re.match(form, rest) if ch == lead else None
            if found:
                self.at += found.end()
                return chr(int(found.group(1), 16))
        if ch == "u" and self.unicode:
            found = re.match(r"\{([0-9A-Fa-f]+)\}", rest)
            if found and int(found.group(1), 16) <= 0x10FFFF:
                self.at += found.end()
                return chr(int(found.group(1), 16))
        if ch == "c" and re.match(r"[A-Za-z]", rest):
            self.at += 1
            return chr(ord(rest[0]) % 32)
        if ch in "01234567" and not (self.unicode and ch != "0"):
            octal = re.match(r"[0-3]?[0-7]{1,2}", ch + rest).group(0) if rest[:1] in set("01234567") and rest else ch
            self.at += len(octal) - 1
            return chr(int(octal, 8))
        if self.unicode and (ch.isalnum() or ch == "_"):
            raise RegexError(f"invalid escape \\{ch}")
        if ch == "c":
            self.at -= 1
            return "\\"
        return ch

    # -- classes -----------------------------------------------------------
    def _class_atom(self):
        """One member: a character, or the text of a shorthand class."""
        ch = self._peek()
        if not ch:
            raise RegexError("unterminated class")
        self.at += 1
        if ch != "\\":
            return ch, None
        ch = self._peek()
        if not ch:
            raise RegexError("pattern ends in a backslash")
        self.at += 1
        if ch == "b":
            return "\b", None
        if ch in "dws":
            return None, {"d": "0-9", "w": _WORD, "s": space_class(self.target)}[ch]
        if ch in "DWS":
            if self.target == RE2:
                if ch == "S":
                    raise RegexError("RE2 has no nested class")
                return None, "\\" + ch
            return None, f"[^{ {'D': '0-9', 'W': _WORD, 'S': space_class(JAVA)}[ch] }]"
        if ch in "pP" and self.unicode:
            return None, self._property(ch)
        if ch == "-":
            return "-", None
        return self._code_escape(ch), None

    def _class(self) -> _Part:
        negated = self._peek() == "^"
        self.at += negated
        members: list[str] = []
        word = not negated
        while True:
            if not self._peek():
                raise RegexError("unterminated class")
            if self._peek() == "]":
                self.at += 1
                break
            first, shorthand = self._class_atom()
            last = first
            ahead = self.src[self.at + 1:self.at + 2]
            if self._peek() == "-" and ahead not in ("]", ""):
                mark = self.at
                self.at += 1
                last, other = self._class_atom()
                if first is None or last is None:
                    if self.unicode:
                        raise RegexError("class in a range")
                    self.at, last = mark, first
                elif ord(last) < ord(first):
                    raise RegexError("range out of order")
            if shorthand is not None:
                members.append(shorthand)
                word = word and shorthand in ("0-9", _WORD)
                continue
            members.append(self._member(first, last))
            both = first in _WORD_CHARS and last in _WORD_CHARS
            same_kind = (
                first == last
                or {first, last} <= _DIGITS
                or (first.isupper() and last.isupper())
                or (first.islower() and last.islower())
            )
            word = word and both and same_kind
        if not members:
            if not negated:
                return _Part("(?!)" if self.target == JAVA else r"[^\x{0}-\x{10ffff}]")
            return _Part("(?s:.)")
        body = "".join(members)
        first = None if negated else body
        return _Part(f"[{'^' if negated else ''}{body}]", word, first, word)

    def _member(self, first: str, last: str) -> str:
        def emit(a: str, b: str) -> str:
            low = literal(a, self.target)
            return low if a == b else f"{low}-{literal(b, self.target)}"

        text = emit(first, last)
        if not self.ignore_case:
            return text
        if first == last:
            other = first.swapcase()
            if other != first and len(other) == 1 and (self.target == RE2 or ord(first) > 0x7F):
                text += emit(other, other)
        elif self.target == RE2:
            for lo, hi in (("a", "z"), ("A", "Z")):
                a, b = max(first, lo), min(last, hi)
                if a <= b:
                    text += emit(a.swapcase(), b.swapcase())
        return text


def _in_class(ch: str, kind: str) -> bool:
    """Whether ``\\d``, ``\\w`` or ``\\s`` takes the character."""
    if kind == "s":
        return any(a <= ord(ch) <= b for a, b in _SPACE_POINTS)
    return ch in (_DIGITS if kind == "d" else _WORD_CHARS)


def _plain(steps: tuple[tuple[str, str], ...] | None, folded: bool) -> tuple[tuple[str, str], ...] | None:
    """The steps of a pattern that can be followed without going back, else None.

    A step is text, a word boundary, one sign of ``\\d``, ``\\w`` or ``\\s``, or a run of them.
    Text comes first, behind boundaries at most.  A run is followed by nothing it could have
    taken itself, so it is always taken whole.  Text is in lower case if case is ignored, which
    Java then does for ASCII alone.
    """
    if steps is None:
        return None
    merged: list[tuple[str, str]] = []
    for kind, value in steps:
        if kind == TEXT and merged and merged[-1][0] == TEXT:
            merged[-1] = (TEXT, merged[-1][1] + value)
        else:
            merged.append((kind, value))
    texts = [value for kind, value in merged if kind == TEXT]
    first = next((kind for kind, _ in merged if kind != EDGE), None)
    # Signs that UTF-8 cannot hold, and the one that broken bytes are read as.
    odd = any(0xD800 <= ord(ch) <= 0xDFFF or ch == "\uFFFD" for text in texts for ch in text)
    if first != TEXT or odd or (folded and not all(text.isascii() for text in texts)):
        return None
    for i, (kind, value) in enumerate(merged):
        ahead, other = merged[i + 1] if kind == SOME and i + 1 < len(merged) else (None, "")
        if ahead == TEXT and _in_class(other[0], value):
            return None
        if ahead in (ONE, SOME) and (value == "s") == (other == "s"):
            return None
    return tuple((kind, value.lower() if folded and kind == TEXT else value) for kind, value in merged)


def check_flags(flags: str) -> str:
    """Accepts a JavaScript flag string or raises ``RegexError``."""
    for flag in flags:
        if flag not in "dgimsuvy" or flags.count(flag) > 1:
            raise RegexError(f"bad flags {flags}")
    if "u" in flags and "v" in flags:
        raise RegexError(f"bad flags {flags}")
    for flag in "vy":
        if flag in flags:
            raise RegexError(f"flag {flag} is not supported")
    return flags


def translate(source: str, flags: str = "g", target: str = JAVA) -> Translated:
    """``source`` in the target's syntax, or ``RegexError``."""
    return _Reader(source, check_flags(flags), target).run()


def replacement(text: str, regex: Translated, target: str = JAVA) -> str:
    """A JavaScript replacement string in the target's syntax."""

    def group(number: int) -> str:
        return f"${number}" if target == JAVA else f"\\{number}"

    def plain(piece: str) -> str:
        special = "\\$" if target == JAVA else "\\"
        return "".join("\\" + c if c in special else c for c in piece)

    out, i = [], 0
    while i < len(text):
        rest = text[i:]
        number = re.match(r"\$(\d{1,2})", rest)
        named = re.match(r"\$<([^>]*)>", rest) if regex.names else None
        if rest.startswith("$$"):
            out.append(plain("$"))
            i += 2
        elif rest.startswith("$&"):
            out.append(group(0))
            i += 2
        elif rest.startswith(("$`", "$'")):
            raise RegexError("text before or after a match cannot be inserted")
        elif named:
            out.append(group(regex.names[named.group(1)]) if named.group(1) in regex.names else "")
            i += named.end()
        elif number and any(1 <= int(n) <= regex.groups for n in (number[1], number[1][0])):
            digits = number[1] if 1 <= int(number[1]) <= regex.groups else number[1][0]
            out.append(group(int(digits)))
            i += 1 + len(digits)
            if i < len(text) and text[i] in _DIGITS and target == JAVA:
                out.append("\\" + text[i])
                i += 1
        else:
            out.append(plain(text[i]))
            i += 1
    return "".join(out)
