"""Licence scans by sentence rules, with DataFrame operations only.

A text is cut into sentences; sentences that speak of licences are normalised and mapped
to identifiers of known licence sentences; ordered rules then match sequences of
identifiers.  A rule takes the identifiers it matched, so a later, more general rule sees
only what is left, and what no rule takes is reported as unmatched.  Everything happens
in the task that reads the text: there is no shuffle.

Defined results: null and empty texts, and texts without such sentences, have no licence
sentences and empty strings; repeated rows each get their own, equal, answer.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import or_
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Unknown sentences count only in texts with any of these words.
SPEAKS = r"(?i)licen[cs]|copyright|warrant|as is|permission|redistribut|public domain|all rights reserved|neither the name|in no event"
#: The same on a normalised sentence.
SPEAKS_NORMAL = r"licen[cs]|copyright|warrant|as is|permission|redistribut|public domain|all rights reserved|neither the name|in no event"
_BREAK = "\x1e"
_ENDS = r"[.!?;][\x20\x09-\x0D]+|\n[\x20\x09-\x0D]*\n"
_VERSION = r"(?:version |v\.? ?)?([0-9]+(?:\.[0-9]+)*)"
_GRANT = "redistribution and use in source and binary forms"


class Sentence(NamedTuple):
    """A known sentence: any normalised sentence that holds ``pattern``; a group becomes part of the id."""

    id: str
    pattern: str
    #: What every text with such a sentence holds; ``~`` stands for what may be between two words.
    needs: str


#: Known sentences; the first counts where two begin at one place.
SENTENCES = (
    Sentence("spdx", r"spdx-license-identifier ([a-z0-9.+-]+)", "spdx"),
    Sentence("agpl", r"gnu affero general public licen[cs]e(?:.*? " + _VERSION + r")?", "licen[cs]"),
    Sentence("lgpl", r"gnu (?:lesser|library) general public licen[cs]e(?:.*? " + _VERSION + r")?", "licen[cs]"),
    Sentence("gpl", r"gnu general public licen[cs]e(?:.*? " + _VERSION + r")?", "licen[cs]"),
    Sentence("apache", r"apache licen[cs]e(?: " + _VERSION + r")?", "licen[cs]"),
    Sentence("mozilla", r"mozilla public licen[cs]e(?:.*? " + _VERSION + r")?", "licen[cs]"),
    Sentence("eclipse", r"eclipse public licen[cs]e(?:.*? " + _VERSION + r")?", "licen[cs]"),
    Sentence("cc0", r"cc0(?: " + _VERSION + r")?|creative commons zero", r"\bcc0|creative~commons"),
    Sentence("ccbyncsa", r"cc[- ]by-nc-sa(?:[- ]" + _VERSION + r")?|creative commons attribution-noncommercial-sharealike", r"\bcc~by|creative~commons"),
    Sentence("ccbyncnd", r"cc[- ]by-nc-nd(?:[- ]" + _VERSION + r")?|creative commons attribution-noncommercial-noderiv", r"\bcc~by|creative~commons"),
    Sentence("ccbync", r"cc[- ]by-nc(?:[- ]" + _VERSION + r")?|creative commons attribution-noncommercial", r"\bcc~by|creative~commons"),
    Sentence("ccbysa", r"cc[- ]by-sa(?:[- ]" + _VERSION + r")?|creative commons attribution-sharealike", r"\bcc~by|creative~commons"),
    Sentence("ccbynd", r"cc[- ]by-nd(?:[- ]" + _VERSION + r")?|creative commons attribution-noderiv", r"\bcc~by|creative~commons"),
    Sentence("ccby", r"cc[- ]by(?:[- ]" + _VERSION + r")?|creative commons attribution", r"\bcc~by|creative~commons"),
    # Short names; the long ones above are tried first.
    Sentence("agpl", r"\b(?:gnu )?agpl(?:[- ]?" + _VERSION + r")?(?:-only|-or-later|\+)?\b", r"\bagpl"),
    Sentence("lgpl", r"\b(?:gnu )?lgpl(?:[- ]?" + _VERSION + r")?(?:-only|-or-later|\+)?\b", r"\blgpl"),
    Sentence("gpl", r"\b(?:gnu )?gpl(?:[- ]?" + _VERSION + r")?(?:-only|-or-later|\+)?\b", r"\bgpl"),
    Sentence("apache", r"\bapache[- ]" + _VERSION, "apache"),
    Sentence("mozilla", r"\bmpl[- ]?" + _VERSION, r"\bmpl(?:~)?v?[0-9]"),
    Sentence("eclipse", r"\bepl[- ]?" + _VERSION, r"\bepl(?:~)?v?[0-9]"),
    Sentence("boost", r"\bboost software licen[cs]e(?: " + _VERSION + r")?|\bbsl-([0-9.]+)", r"licen[cs]|\bbsl-"),
    Sentence("artistic", r"\bartistic licen[cs]e(?: " + _VERSION + r")?|\bartistic-([0-9.]+)", r"licen[cs]|artistic-"),
    Sentence("zlib", r"\bzlib(?: libpng)? licen[cs]e|licen[cs]ed? (?:under )?(?:the )?zlib\b", "licen[cs]"),
    Sentence("mitnamed", r"\bmit licen[cs]e|licen[cs]ed? (?:under )?(?:the )?mit\b", "licen[cs]"),
    Sentence("bsdnamed", r"\b([0-9])-clause bsd|bsd[- ]([0-9])-clause|bsd licen[cs]e", "clause~bsd|bsd~[0-9]|licen[cs]"),
    Sentence("iscnamed", r"\bisc licen[cs]e", "licen[cs]"),
    Sentence("mitgrant", r"permission is hereby granted free of charge to any person obtaining a copy", "permission"),
    Sentence("mitnotice", r"above copyright notice and this permission notice shall be included", "permission"),
    Sentence("iscgrant", r"permission to use copy modify and or distribute this software for any purpose", "permission"),
    # From the last beginning before its end: no text is read on from every beginning.
    Sentence("bsdgrant", _GRANT + r"(?:(?!" + _GRANT + r").)*?are permitted", "redistribut"),
    Sentence("bsdsource", r"redistributions of source code must retain", "redistribut"),
    Sentence("bsdbinary", r"redistributions in binary form must reproduce", "redistribut"),
    Sentence("bsdendorse", r"neither the name(?:(?!neither the name).)*?(?:endorse|promote)", "neither~the~name"),
    Sentence("publicdomain", r"free and unencumbered software released into the public domain|in the public domain", "public~domain"),
    Sentence("asis", r"provided as is|without warranty of any kind|without warranties or conditions", "as~is|warrant"),
    Sentence("liability", r"in no event shall", "in~no~event"),
    Sentence("laterversion", r"at your option any later version", "any~later~version"),
    Sentence("copyright", r"^copyright|copyright c |all rights reserved", "copyright|all~rights~reserved"),
)

_NEEDS = tuple(dict.fromkeys("|".join(k.needs for k in SENTENCES).split("|")))


def _longest(need: str) -> str:
    """The longest word that a need spells out."""
    return max(re.findall("[a-z0-9]+", re.sub(r"\\b|\[[^]]*\]|\(\?:~\)\?|~", " ", need)), key=len)


#: A text without any of these words, in lower case, and without the short needs, has no known sentence and
#: does not speak of licences.  Words are found by plain search; a text may put a line end or other signs
#: between any two of a need.
WORDS = tuple(dict.fromkeys(_longest(n) for n in _NEEDS if len(_longest(n)) > 3))
SHORT = "(?i)" + "|".join(n for n in _NEEDS if len(_longest(n)) <= 3).replace("~", "[^A-Za-z0-9]+")
_TOKEN = r"[a-z0-9][a-z0-9.+-]*"
#: A whole SPDX expression; brackets are blanks by then.
_SPDX = rf"\bspdx-license-identifier {_TOKEN}(?: (?:or|and|with) {_TOKEN})*"


def _head(known: Sentence) -> str:
    """How a known sentence begins: its pattern without what its version or end adds, and without groups."""
    if known.id == "spdx":
        return _SPDX
    out = known.pattern
    for lead in (".*? ", " ", "[- ]"):
        out = out.replace(f"(?:{lead}{_VERSION})?", "")
    # What ends a sentence is looked for, but may stand behind other known ones.
    for begin in (_GRANT, "neither the name"):
        if out.startswith(begin):
            out = f"{begin}(?={out[len(begin):]})"
    return rf"\b(?:{re.sub(r'[(](?![?])', '(?:', out)})" + r"(?![a-z0-9])" * (known.id in ("cc0", "ccby"))


#: Any known sentence.
KNOWN = "|".join(_head(k) for k in SENTENCES)


class Rule(NamedTuple):
    """An ordered rule: a licence and the sequence of identifiers that means it.

    ``tail``: disclaimers may follow and belong to it.
    """

    licence: str
    sequence: tuple[str, ...]
    tail: bool = False

    @property
    def pattern(self) -> str:
        """Every identifier stands between spaces of its own."""
        return "".join(f" {part} " for part in self.sequence) + "(?: (?:asis|liability) )*" * self.tail


def _named(licence: str, id_: str, version: str) -> Rule:
    major, minor = version.split(".")
    return Rule(f"{licence}-{version}", (f"{id_}:{major}" + (f"[.]{minor}" if minor != "0" else "(?:[.]0)?"),))


#: Licences whose SPDX identifiers are known, as the list writes them; any other one is ``SPDX``.
SPDX_NAMES = (
    "MIT MIT-0 Zlib ISC 0BSD BSD-2-Clause BSD-3-Clause BSD-3-Clause-Clear BSD-4-Clause BSL-1.0 Unlicense WTFPL NCSA "
    "PostgreSQL PSF-2.0 OpenSSL curl X11 HPND Vim Beerware Artistic-1.0 Artistic-2.0 Apache-1.1 Apache-2.0 "
    "GPL-1.0 GPL-2.0 GPL-3.0 LGPL-2.0 LGPL-2.1 LGPL-3.0 AGPL-1.0 AGPL-3.0 MPL-1.0 MPL-1.1 MPL-2.0 EPL-1.0 EPL-2.0 "
    "CDDL-1.0 CDDL-1.1 EUPL-1.1 EUPL-1.2 OFL-1.1 MS-PL MS-RL AFL-3.0 OSL-3.0 ODbL-1.0 PDDL-1.0 CC0-1.0 "
    "CC-BY-3.0 CC-BY-4.0 CC-BY-SA-3.0 CC-BY-SA-4.0 CC-BY-NC-4.0 CC-BY-ND-4.0 CC-BY-NC-SA-4.0 CC-BY-NC-ND-4.0"
).split()


def _spdx_pattern(name: str) -> str:
    """An identifier in lower case; of a family with versions also its "only" and "or later" forms."""
    own = "spdx:" + re.escape(name.lower()).replace("\\-", "-")
    return own + "(?:[+]|-only|-or-later)?" * (name[-1].isdigit() and "." in name)


_ANY = "(?::[0-9.]+)?"
#: Longer sequences first; the bare names last.
RULES = (
    Rule("MIT", ("mitgrant", "mitnotice"), True),
    Rule("ISC", ("iscgrant",), True),
    Rule("BSD-3-Clause", ("bsdgrant", "bsdsource", "bsdbinary", "bsdendorse"), True),
    Rule("BSD-2-Clause", ("bsdgrant", "bsdsource", "bsdbinary"), True),
    Rule("Unlicense", ("publicdomain",), True),
    _named("GPL", "gpl", "3.0"), _named("GPL", "gpl", "2.0"), _named("LGPL", "lgpl", "3.0"),
    _named("LGPL", "lgpl", "2.1"), _named("AGPL", "agpl", "3.0"), _named("Apache", "apache", "2.0"),
    _named("MPL", "mozilla", "2.0"), _named("EPL", "eclipse", "2.0"), _named("EPL", "eclipse", "1.0"),
    _named("CC0", "cc0", "1.0"), _named("CC-BY-NC-SA", "ccbyncsa", "4.0"), _named("CC-BY-NC-ND", "ccbyncnd", "4.0"),
    _named("CC-BY-NC", "ccbync", "4.0"), _named("CC-BY-SA", "ccbysa", "4.0"), _named("CC-BY-ND", "ccbynd", "4.0"),
    _named("CC-BY", "ccby", "4.0"),
    _named("BSL", "boost", "1.0"), _named("Artistic", "artistic", "2.0"), _named("Artistic", "artistic", "1.0"),
    Rule("Zlib", ("zlib",)), *(Rule(name, (_spdx_pattern(name),)) for name in SPDX_NAMES),
    Rule("MIT", ("mitnamed",)), Rule("ISC", ("iscnamed",)), Rule("BSD-3-Clause", ("bsdnamed:3",)),
    Rule("BSD-2-Clause", ("bsdnamed:2",)), Rule("BSD", ("bsdnamed",)), Rule("SPDX", ("spdx:[a-z0-9.+-]+",)),
    Rule("BSL", ("boost" + _ANY,)), Rule("Artistic", ("artistic" + _ANY,)),
    Rule("GPL", ("gpl" + _ANY,)), Rule("LGPL", ("lgpl" + _ANY,)), Rule("AGPL", ("agpl" + _ANY,)),
    Rule("Apache", ("apache" + _ANY,)), Rule("MPL", ("mozilla" + _ANY,)), Rule("EPL", ("eclipse" + _ANY,)),
    Rule("CC", ("cc(?:0|by[a-z]*)" + _ANY,)),
)


def normal_sentences(text: Column) -> Column:
    """The normalised sentences that are known or, in a text that ``SPEAKS``, speak of licences, in order."""
    cut = F.split(F.regexp_replace(text, _ENDS, _BREAK), _BREAK)
    plain = F.transform(cut, lambda s: F.regexp_replace(s, r"[^A-Za-z0-9.+-]+", " "))
    # '-' and '.' stay between two letters or digits only, so signs of comments are no words.
    plain = F.transform(plain, lambda s: F.regexp_replace(s, r"(?<![A-Za-z0-9])[.-]|[.-](?![A-Za-z0-9])", " "))
    plain = F.transform(plain, lambda s: F.trim(F.lower(F.regexp_replace(s, " +", " "))))
    speaking = F.filter(plain, lambda s: s.rlike(SPEAKS_NORMAL + "|" + KNOWN))
    return F.when(text.rlike(SPEAKS), speaking).otherwise(F.filter(plain, lambda s: s.rlike(KNOWN)))


def sentence_ids(sentence: Column) -> Column:
    """The distinct identifiers of a normalised sentence in order of place; ``other`` if it has none.

    The sentence is cut before every known one, so a version is never taken from the next.
    Where two begin at one place, the first in ``SENTENCES`` counts.
    """
    cut = F.split(F.regexp_replace(sentence, f"({KNOWN})", _BREAK + "$1"), _BREAK)
    found = F.array_distinct(F.flatten(F.transform(F.filter(cut, lambda _, k: k > 0), _part_ids)))
    return F.when(sentence.rlike(KNOWN), found).otherwise(F.array(F.lit("other")))


def _part_ids(part: Column) -> Column:
    """The identifiers of a part that begins with a known sentence, with the groups its pattern caught."""
    out = F.array(F.lit("other"))
    for known in reversed(SENTENCES):
        groups = re.compile(known.pattern).groups
        if known.id == "spdx":
            names = F.split(F.regexp_extract(part, f"^{_SPDX}", 0), " (?:or|and|with) |^spdx-license-identifier ")
            ids = F.transform(F.filter(names, lambda n: n != ""), lambda n: F.concat(F.lit("spdx:"), n))
        elif groups:
            caught = F.concat(F.lit(""), *(F.regexp_extract(part, f"^(?:{known.pattern})", k + 1) for k in range(groups)))
            ids = F.array(F.when(caught == "", F.lit(known.id)).otherwise(F.concat(F.lit(known.id + ":"), caught)))
        else:
            ids = F.array(F.lit(known.id))
        # What ends a sentence may stand in a later part.
        begins = _GRANT if known.id == "bsdgrant" else "neither the name" if known.id == "bsdendorse" else _head(known)
        out = F.when(part.rlike(f"^(?:{begins})"), ids).otherwise(out)
    return out


def match_rules(ids: Column) -> Column:
    """``(left, found)``: the ordered rules applied to a list of identifiers."""
    start = F.struct(
        F.concat(F.lit(" "), F.array_join(ids, "  "), F.lit(" ")).alias("left"),
        F.array().cast("array<string>").alias("found"),
    )
    rules = F.array(*(F.struct(F.lit(r.licence).alias("licence"), F.lit(r.pattern).alias("sequence")) for r in RULES))

    def apply(state: Column, rule: Column) -> Column:
        hit = F.regexp_like(state["left"], rule["sequence"])
        return F.struct(
            F.when(hit, F.regexp_replace(state["left"], rule["sequence"], F.lit("  "))).otherwise(state["left"]).alias("left"),
            F.when(hit, F.array_append(state["found"], rule["licence"])).otherwise(state["found"]).alias("found"),
        )

    return F.aggregate(rules, start, apply)


def scan_licenses(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, n_sentences, sentence_ids, licenses, unmatched)``, one row per document."""
    low = F.lower(F.col(text))
    speaks = F.coalesce(reduce(or_, [F.contains(low, F.lit(w)) for w in WORDS]) | F.col(text).rlike(SHORT), F.lit(False))
    none = F.array().cast("array<string>")
    rows = docs.select(F.col(key).alias("_id"), F.when(speaks, normal_sentences(F.col(text))).otherwise(none).alias("_sentences"))
    rows = rows.withColumn("_ids", F.flatten(F.transform("_sentences", sentence_ids)))
    rows = rows.withColumn("_match", match_rules(F.col("_ids")))
    return rows.select(
        F.col("_id").alias(key),
        F.size("_sentences").cast("long").alias("n_sentences"),
        F.array_join("_ids", " ").alias("sentence_ids"),
        F.array_join(F.array_sort(F.array_distinct("_match.found")), " AND ").alias("licenses"),
        F.trim(F.regexp_replace("_match.left", " +", " ")).alias("unmatched"),
    )
