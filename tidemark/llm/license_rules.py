"""The signature rules of the license scan.

Patterns are matched on the words of a text in lower case, joined by single
blanks, so punctuation and line breaks don't matter. One rule a line:
``priority | label | keyword | pattern``. A rule is tried only on texts that hold
its keyword. A higher priority wins where detections lie inside each other; of
equal ones the longer. ``{v}`` and ``{n}`` stand for the versions of the family.
"""

from __future__ import annotations

BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

RULES = r"""
90 | gpl-{v} | general public | gnu general public license(?: gpl)?(?: as published by the free software foundation)?(?: either)? v(?:ersion)? ?{v}
95 | gpl-{v}-or-later | general public | gnu general public license(?: as published by the free software foundation)?(?: either)? v(?:ersion)? ?{v}(?: of the license)? or at your option any later version
95 | gpl-{v}-only | general public | gnu general public license v(?:ersion)? ?{v} only
85 | gpl-{v} | gpl | gplv{v}
85 | gpl-{v} | gpl | gpl v(?:ersion)? ?{v}
85 | gpl-{v} | gpl | gpl {v}
90 | lgpl-{n} | lesser | gnu lesser general public license(?: as published by the free software foundation)?(?: either)? v(?:ersion)? ?{n}
90 | lgpl-{n} | library | gnu library general public license v(?:ersion)? ?{n}
85 | lgpl-{n} | lgpl | lgplv{n}
85 | lgpl-{n} | lgpl | lgpl v?(?:ersion )?{n}
90 | agpl-{v} | affero | gnu affero general public license v(?:ersion)? ?{v}
85 | agpl-{v} | agpl | agplv{v}
85 | agpl-{v} | agpl | agpl v?(?:ersion )?{v}
90 | gfdl-{f} | documentation | gnu free documentation license v(?:ersion)? ?{f}
85 | gfdl-{f} | gfdl | gfdl v?(?:ersion )?{f}
60 | lgpl | lesser | gnu lesser general public license
60 | agpl | affero | gnu affero general public license
60 | gfdl | documentation | gnu free documentation license
50 | gpl | general public | general public license
90 | apache-{a} | apache | apache license v(?:ersion)? ?{a}
90 | apache-{a} | apache | apache software license v(?:ersion)? ?{a}
85 | apache-{a} | apache | apache {a}
85 | apache-{a} | apache | licensed under the apache license v(?:ersion)? ?{a}
85 | apache-2.0 | apache | you may not use this file except in compliance with the license .{0,80}apache org licenses license 2 0
60 | apache | apache | apache software license
60 | apache | apache | licensed under apache
90 | mit | permission is hereby | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
80 | mit | mit | (?:released|licensed|available|distributed) under (?:the )?(?:terms of the )?mit licen[cs]e
70 | mit | mit | mit licensed
70 | mit | mit | the mit licen[cs]e mit
85 | mit-0 | mit | mit no attribution
85 | x11 | x11 | x11 license
85 | expat | expat | expat license
95 | bsd-3-clause | redistribution and use | redistribution and use in source and binary forms .{0,900}neither the name of
90 | bsd-2-clause | redistribution and use | redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
90 | bsd-{b}-clause | bsd | bsd {b} clause(?: licen[cs]e)?
90 | bsd-{b}-clause | bsd | {b} clause bsd(?: licen[cs]e)?
85 | bsd-3-clause | bsd | new bsd licen[cs]e
85 | bsd-3-clause | bsd | modified bsd licen[cs]e
85 | bsd-2-clause | bsd | simplified bsd licen[cs]e
85 | bsd-2-clause | bsd | freebsd licen[cs]e
60 | bsd | bsd | bsd licen[cs]e
60 | bsd | bsd | bsd style licen[cs]e
95 | cc-by-{k}-{c} | cc by | cc by {k_words} {c_words}
92 | cc-by-{k} | cc by | cc by {k_words}
90 | cc-by-{c} | cc by | cc by {c_words}
95 | cc-by-{k}-{c} | creative commons | creative commons {k_names} {c_words}
92 | cc-by-{k} | creative commons | creative commons {k_names}
80 | cc-by-{c} | creative commons | creative commons attribution(?: licen[cs]e)? v?(?:ersion )?{c_words}
75 | cc-by | creative commons | creative commons attribution
95 | cc-by-{k}-{c} | creativecommons | creativecommons org licenses by {k_words} {c_words}
90 | cc-by-{c} | creativecommons | creativecommons org licenses by {c_words}
60 | cc | creative commons | creative commons licen[cs]e
60 | cc | creative commons | licensed under (?:a )?creative commons
90 | cc0-1.0 | cc0 | cc0(?: 1 0)?(?: universal)?
90 | cc0-1.0 | creativecommons | creativecommons org publicdomain zero 1 0
85 | cc-pdm | public domain mark | public domain mark(?: 1 0)?
90 | mpl-{m} | mozilla | mozilla public licen[cs]e v?(?:ersion )?{m}
85 | mpl-{m} | mpl | mpl v?(?:ersion )?{m}
60 | mpl | mozilla | mozilla public licen[cs]e
90 | epl-{e} | eclipse | eclipse public licen[cs]e v?(?:ersion )?{e}
85 | epl-{e} | epl | epl v?(?:ersion )?{e}
60 | epl | eclipse | eclipse public licen[cs]e
90 | cddl-{d} | common development | common development and distribution licen[cs]e v?(?:ersion )?{d}
85 | cddl-{d} | cddl | cddl v?(?:ersion )?{d}
60 | cddl | common development | common development and distribution licen[cs]e
90 | eupl-{u} | european union | european union public licen[cs]e v?(?:ersion )?{u}
85 | eupl-{u} | eupl | eupl v?(?:ersion )?{u}
90 | osl-{o} | open software | open software licen[cs]e v?(?:ersion )?{o}
90 | afl-{o} | academic free | academic free licen[cs]e v?(?:ersion )?{o}
90 | artistic-{g} | artistic | artistic licen[cs]e v?(?:ersion )?{g}
60 | artistic | artistic | artistic licen[cs]e
90 | ofl-1.1 | open font | sil open font licen[cs]e(?: v?(?:ersion )?1 1)?
90 | odbl-1.0 | open database | open database licen[cs]e(?: odbl)?(?: v?1 0)?
85 | odc-by-1.0 | open data commons | open data commons attribution licen[cs]e
85 | pddl-1.0 | open data commons | open data commons public domain dedication
85 | cdla-{q} | community data | community data licen[cs]e agreement {q}
90 | bsl-1.0 | boost | boost software licen[cs]e(?: v?(?:ersion )?1 0)?
90 | isc | isc | isc licen[cs]e
90 | isc | permission to use | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
90 | zlib | zlib | zlib licen[cs]e
85 | zlib | altered source | altered source versions must be plainly marked as such
90 | unlicense | unencumbered | this is free and unencumbered software released into the public domain
85 | unlicense | unlicense | the unlicense
90 | wtfpl | wtfpl | wtfpl
90 | psf-2.0 | python software | python software foundation licen[cs]e(?: v?(?:ersion )?2)?
90 | ruby | ruby | ruby licen[cs]e
90 | php-3.01 | php | php licen[cs]e(?: v?(?:ersion )?3 01)?
90 | postgresql | postgresql | postgresql licen[cs]e
90 | openssl | openssl | openssl licen[cs]e
90 | ms-pl | microsoft public | microsoft public licen[cs]e
90 | ms-rl | microsoft reciprocal | microsoft reciprocal licen[cs]e
90 | ncsa | university of illinois | university of illinois ncsa open source licen[cs]e
90 | upl-1.0 | universal permissive | universal permissive licen[cs]e
90 | vim | vim | vim licen[cs]e
90 | w3c | w3c | w3c software (?:notice and )?licen[cs]e
90 | cecill-{z} | cecill | cecill {z}
90 | qpl-1.0 | q public | q public licen[cs]e
90 | ecl-2.0 | educational community | educational community licen[cs]e(?: v?(?:ersion )?2 0)?
90 | sspl-1.0 | server side | server side public licen[cs]e
90 | busl-1.1 | business source | business source licen[cs]e(?: 1 1)?
90 | elastic-2.0 | elastic | elastic licen[cs]e(?: 2 0)?
90 | commons-clause | commons clause | commons clause(?: licen[cs]e)?(?: condition)?
90 | openrail-m | openrail | (?:bigscience |creativeml )?openrail m
90 | fair-source | fair source | fair source licen[cs]e
95 | spdx-{s} | spdx | spdx licen[cs]e identifier {s_words}
50 | public-domain | public domain | (?:in|into|to) the public domain
50 | public-domain | public domain | public domain dedication
40 | all-rights-reserved | all rights | all rights reserved
40 | proprietary | proprietary | proprietary (?:and confidential|software|licen[cs]e)
40 | proprietary | written permission | (?:no part|may not be) .{0,60}(?:reproduced|copied|distributed) .{0,80}written permission
35 | copyright-notice | copyright | copyright (?:c )?(?:19|20)[0-9]{2}
30 | unnamed-license | licensed under | licensed under the terms
30 | unnamed-license | subject to | subject to the terms and conditions of the licen[cs]e
30 | unnamed-license | license agreement | end user licen[cs]e agreement
"""

# Versions and variants of the families.
VERSIONS = {
    "v": ["1", "2", "3"],
    "n": ["2", "2.1", "3"],
    "f": ["1.1", "1.2", "1.3"],
    "a": ["1.0", "1.1", "2.0"],
    "b": ["0", "2", "3", "4"],
    "c": ["1.0", "2.0", "2.5", "3.0", "4.0"],
    "k": ["sa", "nc", "nd", "nc-sa", "nc-nd"],
    "m": ["1.0", "1.1", "2.0"],
    "e": ["1.0", "2.0"],
    "d": ["1.0", "1.1"],
    "u": ["1.0", "1.1", "1.2"],
    "o": ["1.0", "1.1", "2.0", "2.1", "3.0"],
    "g": ["1.0", "2.0"],
    "q": ["permissive", "sharing"],
    "z": ["1.0", "2.0", "2.1", "b", "c"],
    "s": ["mit", "apache-2.0", "bsd-2-clause", "bsd-3-clause", "gpl-2.0", "gpl-3.0", "lgpl-2.1", "lgpl-3.0", "agpl-3.0", "mpl-2.0", "isc", "cc0-1.0", "cc-by-4.0", "unlicense", "zlib"],
}
NAMES = {
    "sa": "attribution share ?alike",
    "nc": "attribution non ?commercial",
    "nd": "attribution no ?deriv(?:ative|ativ)e?s?",
    "nc-sa": "attribution non ?commercial share ?alike",
    "nc-nd": "attribution non ?commercial no ?deriv(?:ative|ativ)e?s?",
}


def expanded() -> list[tuple[int, str, str, str]]:
    """(priority, label, keyword, pattern) of every rule, families written out."""
    out = []
    for line in filter(None, map(str.strip, RULES.splitlines())):
        priority, label, keyword, pattern = (x.strip() for x in line.split(" | ", 3))
        todo = [(label, pattern)]
        for key, values in VERSIONS.items():
            if not any(f"{{{key}}}" in x or f"{{{key}_words}}" in x or f"{{{key}_names}}" in x for x in (label, pattern)):
                continue
            todo = [
                (
                    a.replace(f"{{{key}}}", v),
                    b.replace(f"{{{key}_words}}", _spoken(v)).replace(f"{{{key}_names}}", NAMES.get(v, v)).replace(f"{{{key}}}", _spoken(v)),
                )
                for a, b in todo
                for v in values
            ]
        out += [(int(priority), a, keyword, b) for a, b in todo]
    return out


def _spoken(version: str) -> str:
    """A version as it reads among words: 2.0 is "2 0"; a whole number may have a 0 behind it."""
    words = version.replace(".", " ").replace("-", " ")
    return f"{words}(?: 0)?" if version.isdigit() else words
