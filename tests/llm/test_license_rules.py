import random
import re

from .samples import SCHEMA, messy_rows
from textwarden.llm import license_rules

MIT = (
    "Copyright (c) 2020 Someone\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\n"
    "of this software, to deal in it. The above copyright notice and this permission notice shall be included in\n"
    "all copies. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND. In no event shall the authors be liable."
)
CASES = {
    "Some prose.\nLicensed under the Apache License, Version 2.0.": ("Apache-2.0", ""),
    "Released under the MIT License.": ("MIT", ""),
    "Licensed under CC BY-NC 4.0.": ("CC-BY-NC-4.0", ""),
    "This work is licensed under the GNU General Public License, version 3.": ("GPL-3.0", ""),
    "GNU Lesser General Public License version 2.1. Apache License 1.1.": ("Apache AND LGPL-2.1", ""),
    MIT: ("MIT", "copyright"),
    "Redistribution and use in source and binary forms, with or without modification, are permitted. "
    "Redistributions of source code must retain this. Redistributions in binary form must reproduce it. "
    "Neither the name nor contributors may be used to endorse products.": ("BSD-3-Clause", ""),
    "Redistributions in binary form must reproduce it. Redistributions of source code must retain this.": (
        "", "bsdbinary bsdsource"),
    "SPDX-License-Identifier: MIT OR Zlib": ("MIT AND Zlib", ""),
    "SPDX-License-Identifier: LicenseRef-own": ("SPDX", ""),
    "Licensed under GPLv3.": ("GPL-3.0", ""),
    "License: Apache-2.0": ("Apache-2.0", ""),
    "license: GPL-2.0-only": ("GPL-2.0", ""),
    "GNU GPL version 2 or later": ("GPL-2.0", ""),
    "It is under the GNU LGPL v2.1+ and parts under AGPL-3.0-or-later": ("AGPL-3.0 AND LGPL-2.1", ""),
    "Boost Software License - Version 1.0": ("BSL-1.0", ""),
    "The Artistic License 2.0": ("Artistic-2.0", ""),
    "the zlib/libpng license": ("Zlib", ""),
    "License: MIT": ("MIT", ""),
    "License: BSD-3-Clause": ("BSD-3-Clause", ""),
    "Covered by the MPL 2.0; see also EPL-2.0": ("EPL-2.0 AND MPL-2.0", ""),
    "A simple example: the Apache scouts exemplified gplus in 2.0 ways": ("", ""),
    "Our licence to operate was renewed.": ("", "other"),
    "No such words.": ("", ""),
}


def test_cases(spark):
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(CASES)], SCHEMA)
    got = {r.doc_id: (r.licenses, r.unmatched) for r in license_rules.scan_licenses(docs).collect()}
    assert list(CASES.values()) == [got[i] for i in range(len(CASES))]


def test_messy(messy, nothing):
    got = license_rules.scan_licenses(messy).collect()
    assert len(got) == len(messy_rows()) and all(r.n_sentences == 0 and r.licenses == "" for r in got)
    assert license_rules.scan_licenses(nothing).count() == 0
    plan = license_rules.scan_licenses(messy)._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Python" not in plan


#: A text for every known sentence, without further words that speak of licences where the sentence has none.
EXAMPLES = {
    "SPDX-License-Identifier: Zlib": "spdx:zlib",
    "Under the GNU Affero General Public License version 3": "agpl:3",
    "Under the GNU Lesser General Public License version 2.1": "lgpl:2.1",
    "Under the GNU General Public\nLicence, version 2": "gpl:2",
    "Apache License 2.0": "apache:2.0",
    "Mozilla Public License 2.0": "mozilla:2.0",
    "Eclipse Public License 1.0": "eclipse:1.0",
    "Released as CC0 1.0.": "cc0:1.0",
    "Dedicated under Creative\nCommons Zero": "cc0",
    "Data: CC BY-NC-SA 4.0": "ccbyncsa:4.0",
    "Data: CC BY-NC-ND 4.0": "ccbyncnd:4.0",
    "Data: CC BY-NC 4.0": "ccbync:4.0",
    "This dataset is available under CC BY-SA 4.0.": "ccbysa:4.0",
    "Data: CC-BY-ND 4.0": "ccbynd:4.0",
    "Data: CC BY 4.0": "ccby:4.0",
    "Creative Commons Attribution 4.0": "ccby",
    "The MIT License": "mitnamed",
    "Released under the BSD 2-Clause.": "bsdnamed:2",
    "A 3-clause\nBSD text": "bsdnamed:3",
    "Under AGPLv3": "agpl:3",
    "Under LGPL-2.1": "lgpl:2.1",
    "Under GPL 2": "gpl:2",
    "Under Apache 2.0": "apache:2.0",
    "Under MPL-2.0": "mozilla:2.0",
    "Under EPL v1.0": "eclipse:1.0",
    "Boost Software License": "boost",
    "Artistic-2.0": "artistic:2.0",
    "Licensed under zlib": "zlib",
    "The ISC License": "iscnamed",
    "Permission is hereby granted, free of charge, to any person obtaining a copy": "mitgrant",
    "The above copyright notice and this permission notice shall be included": "mitnotice",
    "Permission to use, copy, modify, and/or distribute this software for any purpose": "iscgrant",
    "Redistribution and use in source and binary forms are permitted": "bsdgrant",
    "Redistributions of source code must retain it": "bsdsource",
    "Redistributions in binary form must reproduce it": "bsdbinary",
    "Neither\nthe name nor it may be used to endorse": "bsdendorse",
    "This is in the public\ndomain": "publicdomain",
    "It is provided as\nis": "asis",
    "In no\nevent shall they pay": "liability",
    "Or, at your option, any later\nversion": "laterversion",
    "All rights\nreserved": "copyright",
    "A hash is 3fcc0a1, see acc by mail, or cc bypass": "",
}


def test_every_known_sentence_passes_the_gates(spark):
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(EXAMPLES)], SCHEMA)
    got = {r.doc_id: r.sentence_ids for r in license_rules.scan_licenses(docs).collect()}
    assert [got[i] for i in range(len(EXAMPLES))] == list(EXAMPLES.values())
    assert {e.split(":")[0] for e in EXAMPLES.values() if e} == {k.id for k in license_rules.SENTENCES}


#: Sentences that hold several: identifiers, licences, what is left.
SEVERAL = {
    "Licensed under either of Apache License, Version 2.0 or the MIT license": ("apache:2.0 mitnamed", "Apache-2.0 AND MIT", ""),
    "The MIT license or GNU General Public License or the Apache License, Version 2.0": (
        "mitnamed gpl apache:2.0", "Apache-2.0 AND GPL AND MIT", ""),
    "SPDX-License-Identifier: MIT OR Zlib": ("spdx:mit spdx:zlib", "MIT AND Zlib", ""),
    "-- SPDX-License-Identifier: (GPL-2.0+ WITH Classpath-exception-2.0) OR CC0-1.0.\n-- More": (
        "spdx:gpl-2.0+ spdx:classpath-exception-2.0 spdx:cc0-1.0", "CC0-1.0 AND GPL-2.0 AND SPDX", ""),
    "-- Permission is hereby granted, free of charge, to any person obtaining\n-- a copy of it: the above copyright\n"
    "-- notice and this permission notice shall be included.": ("mitgrant mitnotice", "MIT", ""),
    "-- Redistribution and use in source and binary\n-- forms under the BSD license are permitted": (
        "bsdgrant bsdnamed", "BSD", "bsdgrant"),
    "GNU General Public License, version 2 or, at your option, any later version": ("gpl:2 laterversion", "GPL-2.0", "laterversion"),
    "Data: CC BY-NC-SA 4.0, CC BY 4.0 and CC BY 4.0": ("ccbyncsa:4.0 ccby:4.0", "CC-BY-4.0 AND CC-BY-NC-SA-4.0", ""),
}


def test_all_identifiers_of_a_sentence(spark):
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(SEVERAL)], SCHEMA)
    got = {r.doc_id: r for r in license_rules.scan_licenses(docs).collect()}
    assert [(r.sentence_ids, r.licenses, r.unmatched) for r in (got[i] for i in range(len(SEVERAL)))] == list(SEVERAL.values())


def test_every_spdx_name_is_a_licence(spark):
    names = license_rules.SPDX_NAMES
    forms = [(n, n) for n in names] + [(f"{n}-or-later", n) for n in names if n.startswith(("GPL", "LGPL", "AGPL"))]
    docs = spark.createDataFrame([(i, f"# SPDX-License-Identifier: {f}\n# x", None, None, None) for i, (f, _) in enumerate(forms)], SCHEMA)
    got = {r.doc_id: r.licenses for r in license_rules.scan_licenses(docs).collect()}
    assert [got[i] for i in range(len(forms))] == [n for _, n in forms]


def test_beginnings_without_end_take_no_time(spark):
    import time

    begins = ["Redistribution and use in source and binary forms ", "neither the name ", "GNU General Public License ", "mit license bsd "]
    docs = spark.createDataFrame([(i, b * (200_000 // len(b)), None, None, None) for i, b in enumerate(begins)], SCHEMA).repartition(4)
    began = time.perf_counter()
    got = {r.doc_id: r for r in license_rules.scan_licenses(docs).collect()}
    assert time.perf_counter() - began < 20
    assert got[0].licenses == got[1].licenses == "" and got[2].licenses == "GPL"


def _plain(text):
    """The scan again, sentence by sentence and rule by rule, with Python's own tools."""
    L = license_rules
    text = text or ""  # without any gate
    sentences = []
    for s in re.split(r"[.!?;][ \t-\r]+|\n[ \t-\r]*\n", text):
        s = "".join(c if c.isascii() and (c.isalnum() or c in ".+-") else " " for c in s)
        s = "".join(
            " " if c in ".-" and not (0 < i < len(s) - 1 and s[i - 1].isalnum() and s[i + 1].isalnum()) else c for i, c in enumerate(s)
        )
        sentences.append(" ".join(s.lower().split()))
    starts = lambda s: [m.start() for m in re.finditer(L.KNOWN, s)]
    speaks = bool(re.search(L.SPEAKS, text))
    kept = [s for s in sentences if starts(s) or (speaks and re.search(L.SPEAKS_NORMAL, s))]
    ids = []
    for s in kept:
        own, at = [], starts(s)
        for a, b in zip(at, [*at[1:], len(s)]):
            part = s[a:b]
            for known in L.SENTENCES:
                head = L._GRANT if known.id == "bsdgrant" else "neither the name" if known.id == "bsdendorse" else L._head(known)
                if not re.match(head, part):
                    continue
                if known.id == "spdx":
                    own += ["spdx:" + t for t in re.split(" (?:or|and|with) ", re.match(L._SPDX, part)[0].split(" ", 1)[1])]
                else:
                    m = re.match(known.pattern, part)
                    caught = "".join(g or "" for g in m.groups()) if m else ""
                    own.append(f"{known.id}:{caught}" if caught else known.id)
                break
        ids += list(dict.fromkeys(own)) or ["other"]
    left, found = "".join(f" {i} " for i in ids), set()
    for rule in L.RULES:
        after = re.sub(rule.pattern, "  ", left)
        found |= {rule.licence} if after != left else set()
        left = after
    return len(kept), " ".join(ids), " AND ".join(sorted(found)), " ".join(left.split())


def test_against_a_plain_version(spark):
    r = random.Random(2)
    said = [*CASES, *SEVERAL, *EXAMPLES]
    texts = [" ".join(r.choice(said) + r.choice([".", "", "\n", "\n\n", ";", ","]) for _ in range(r.randint(1, 4))) for _ in range(300)]
    texts += [row.text for row in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], SCHEMA).repartition(8)
    got = {x.doc_id: (x.n_sentences, x.sentence_ids, x.licenses, x.unmatched) for x in license_rules.scan_licenses(docs).collect()}
    assert [(t, got[i]) for i, t in enumerate(texts) if got[i] != _plain(t)] == []
    assert sum(bool(v[2]) for v in got.values()) > 200
