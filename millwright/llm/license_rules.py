"""Signatures of licenses, as regular expressions over normalised words.

Text is lower case with every run of punctuation and white space as one space, so "Apache-2.0" reads ``apache 2 0``.
Each rule has a label, a priority, a relevance, and a keyword: the longest run of letters without which its expression
cannot match. Tags say most, then notices ("licensed under ..."), sentences of the license text itself, addresses, and
plain mentions of a name.
"""

from __future__ import annotations

import re

#: kind: (priority, relevance)
KINDS = {"tag": (5, 1.0), "notice": (4, 0.95), "text": (3, 0.9), "address": (2, 0.8), "name": (1, 0.6), "hint": (0, 0.3)}

_V = "(?:v|version|versions?) ?"

#: label, tag, expressions of the name
NAMED = [
    ("mit", "mit", ["(?:the )?mit license", "(?:the )?expat license", "mit x11 license"]),
    ("mit-0", "mit 0", ["mit no attribution(?: license)?"]),
    ("apache-1.1", "apache 1 1", [f"apache (?:software )?license (?:{_V})?1 1"]),
    ("apache-2.0", "apache 2 0", [f"apache (?:software )?license (?:{_V})?2(?: 0)?", "asl 2 0"]),
    ("gpl-1.0", "gpl 1 0(?: only| or later)?", [f"gnu general public license (?:{_V})1", f"gpl ?(?:{_V})1(?: 0)?"]),
    ("gpl-2.0", "gpl 2 0(?: only| or later)?", [f"(?:gnu )?general public license (?:{_V})?2", f"(?:gnu )?gpl ?(?:{_V})?2(?: 0)?"]),
    ("gpl-3.0", "gpl 3 0(?: only| or later)?", [f"(?:gnu )?general public license (?:{_V})?3", f"(?:gnu )?gpl ?(?:{_V})?3(?: 0)?"]),
    ("gpl-2.0", "gpl 2 0 with classpath exception 2 0", ["gplv2"]),
    ("gpl-3.0", "gpl 3 0 with gcc exception 3 1", ["gplv3"]),
    ("lgpl-2.0", "lgpl 2 0(?: only| or later)?", [f"(?:gnu )?library general public license (?:{_V})?2(?: 0)?"]),
    ("lgpl-2.1", "lgpl 2 1(?: only| or later)?", [f"(?:gnu )?lesser general public license (?:{_V})?2 1", "(?:gnu )?lgpl ?(?:v|version )?2 1"]),
    ("lgpl-3.0", "lgpl 3 0(?: only| or later)?", [f"(?:gnu )?lesser general public license (?:{_V})?3", "(?:gnu )?lgpl ?(?:v|version )?3(?: 0)?"]),
    ("agpl-3.0", "agpl 3 0(?: only| or later)?", [f"(?:gnu )?affero general public license(?: (?:{_V})?3)?"]),
    ("gfdl", "gfdl 1 [123](?: only| or later)?", ["gnu free documentation license"]),
    ("bsd-2-clause", "bsd 2 clause", ["(?:2|two) clause bsd(?: license)?", "(?:simplified|freebsd) bsd? ?license", "bsd 2 clause(?: license)?"]),
    ("bsd-3-clause", "bsd 3 clause", ["(?:3|three) clause bsd(?: license)?", "bsd 3 clause(?: license)?", "new bsd license clause"]),
    ("bsd-4-clause", "bsd 4 clause", ["(?:4|four) clause bsd(?: license)?", "bsd 4 clause(?: license)?"]),
    ("bsd-0-clause", "0bsd", ["(?:0|zero) clause bsd(?: license)?", "bsd zero clause(?: license)?"]),
    ("bsd-new", "bsd 3 clause clear", ["(?:new|modified|revised) bsd license"]),
    ("bsd", "bsd", ["(?:the )?bsd license", "bsd style license"]),
    ("isc", "isc", ["(?:the )?isc license"]),
    ("mpl-1.1", "mpl 1 1", [f"mozilla public license (?:{_V})?1 1"]),
    ("mpl-2.0", "mpl 2 0", [f"mozilla public license (?:{_V})?2(?: 0)?"]),
    ("mpl", "mpl 1 0", ["mozilla public license"]),
    ("epl-1.0", "epl 1 0", [f"eclipse public license (?:{_V})?1(?: 0)?"]),
    ("epl-2.0", "epl 2 0", [f"eclipse public license (?:{_V})?2(?: 0)?"]),
    ("cpl-1.0", "cpl 1 0", ["common public license"]),
    ("cddl-1.0", "cddl 1 0", ["common development and distribution license(?: (?:v|version) ?1(?: 0)?)?"]),
    ("eupl", "eupl 1 [012]", ["european union public licen[cs]e"]),
    ("cecill", "cecill(?: 2 [01]| b| c)?", ["cecill(?: [bc])? free software license", "licence cecill"]),
    ("artistic-1.0", "artistic 1 0", ["artistic license 1(?: 0)?", "perl artistic license"]),
    ("artistic-2.0", "artistic 2 0", ["artistic license (?:v|version )?2(?: 0)?"]),
    ("zlib", "zlib", ["zlib license", "zlib libpng license"]),
    ("libpng", "libpng(?: 2 0)?", ["libpng license"]),
    ("bsl-1.0", "bsl 1 0", ["boost software license"]),
    ("unlicense", "unlicense", ["(?:the )?unlicense"]),
    ("wtfpl", "wtfpl", ["do what the f\\S+ you want to public license", "wtfpl(?: license)?"]),
    ("cc0-1.0", "cc0 1 0", ["cc0(?: 1 0)?(?: universal)?", "creative commons zero cc0"]),
    ("cc-by-4.0", "cc by 4 0", ["cc by 4 0", "creative commons attribution 4 0(?: international)?(?: public)? license"]),
    ("cc-by-3.0", "cc by 3 0", ["cc by 3 0", "creative commons attribution 3 0(?: unported)? license"]),
    ("cc-by-sa-4.0", "cc by sa 4 0", ["cc by sa 4 0", "creative commons attribution share ?alike 4 0(?: international)?(?: public)? license"]),
    ("cc-by-sa-3.0", "cc by sa 3 0", ["cc by sa 3 0", "creative commons attribution share ?alike 3 0(?: unported)? license"]),
    ("cc-by-nc-4.0", "cc by nc 4 0", ["cc by nc 4 0", "creative commons attribution non ?commercial 4 0(?: international)?(?: public)? license"]),
    ("cc-by-nc-3.0", "cc by nc 3 0", ["cc by nc 3 0", "creative commons attribution non ?commercial 3 0(?: unported)? license"]),
    ("cc-by-nd-4.0", "cc by nd 4 0", ["cc by nd 4 0", "creative commons attribution no ?derivatives 4 0(?: international)?(?: public)? license"]),
    ("cc-by-nc-sa-4.0", "cc by nc sa 4 0", ["cc by nc sa 4 0", "creative commons attribution non ?commercial share ?alike 4 0(?: international)?(?: public)? license"]),
    ("cc-by-nc-nd-4.0", "cc by nc nd 4 0", ["cc by nc nd 4 0", "creative commons attribution non ?commercial no ?derivatives 4 0(?: international)?(?: public)? license"]),
    ("ofl-1.1", "ofl 1 1", ["sil open font license", "open font license(?: (?:v|version) ?1 1)?"]),
    ("odbl", "odbl 1 0", ["open (?:data commons )?open database license", "open database license"]),
    ("odc-by", "odc by 1 0", ["open data commons attribution license"]),
    ("pddl", "pddl 1 0", ["public domain dedication and license"]),
    ("psf-2.0", "psf 2 0", ["python software foundation license", "psf license(?: agreement)?"]),
    ("postgresql", "postgresql", ["postgresql license"]),
    ("openssl", "openssl", ["openssl license"]),
    ("ms-pl", "ms pl", ["microsoft public license"]),
    ("ms-rl", "ms rl", ["microsoft reciprocal license"]),
    ("osl-3.0", "osl 3 0", ["open software license (?:v|version )?3(?: 0)?"]),
    ("afl-3.0", "afl 3 0", ["academic free license(?: (?:v|version) ?3(?: 0)?)?"]),
    ("ncsa", "ncsa", ["university of illinois ncsa open source license", "ncsa open source license"]),
    ("vim", "vim", ["vim license"]),
    ("php-3.01", "php 3 01", ["php license(?: version)? 3 01"]),
    ("ruby", "ruby", ["ruby license"]),
    ("w3c", "w3c", ["w3c software (?:notice and )?license"]),
    ("sspl-1.0", "sspl 1 0", ["server side public license"]),
    ("busl-1.1", "busl 1 1", ["business source license"]),
    ("elastic-2.0", "elastic 2 0", ["elastic license 2 0"]),
    ("beerware", "beerware", ["beer ?ware license"]),
    ("x11", "x11", ["x11 license"]),
    ("curl", "curl", ["curl license"]),
    ("icu", "icu", ["icu license"]),
    ("upl-1.0", "upl 1 0", ["universal permissive license"]),
    ("blueoak-1.0.0", "blueoak 1 0 0", ["blue oak model license"]),
    ("openrail", "openrail", ["(?:bigscience |creativeml )?open ?rail(?: m)?(?: license)?"]),
    ("llama-community", "llama2", ["llama [23] community license"]),
]

#: label, sentence of the license text or notice
SENTENCES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", "the software is provided as is without warranty of any kind .{0,80}noninfringement"),
    ("mit", "to use copy modify merge publish distribute sublicense and or sell copies"),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance"),
    ("apache-2.0", "without warranties or conditions of any kind either express or implied"),
    ("apache-2.0", "see the license for the specific language governing permissions and limitations"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl-2.0", "general public license as published by the free software foundation either version 2"),
    ("gpl-3.0", "general public license as published by the free software foundation either version 3"),
    ("gpl", "without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license"),
    ("gpl", "you should have received a copy of the gnu general public license"),
    ("lgpl", "you should have received a copy of the gnu lesser general public license"),
    ("agpl-3.0", "you should have received a copy of the gnu affero general public license"),
    ("gpl-3.0", "everyone is permitted to copy and distribute verbatim copies of this license document"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "redistributions of source code must retain the above copyright notice"),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-3-clause", "may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-4-clause", "all advertising materials mentioning features or use of this software must display"),
    ("bsd", "in no event shall the copyright holders? or contributors be liable for any direct indirect incidental special exemplary or consequential damages"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license"),
    ("epl-2.0", "made available under the terms of the eclipse public license"),
    ("zlib", "the origin of this software must not be misrepresented"),
    ("zlib", "altered source versions must be plainly marked as such"),
    ("bsl-1.0", "distributed under the boost software license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc0-1.0", "has waived all copyright and related or neighboring rights"),
    ("public-domain", "(?:is|was|been) (?:placed|released|dedicated) (?:in|into|to) the public domain"),
    ("public-domain", "this (?:work|file|software|document|text) is in the public domain"),
    ("ofl-1.1", "this font software is licensed under the sil open font license"),
    ("artistic-2.0", "under the terms of the artistic license"),
    ("proprietary", "all rights reserved"),
    ("proprietary", "proprietary and confidential"),
    ("proprietary", "unauthorized (?:copying|use|reproduction|distribution) of this (?:file|software|document) .{0,60}prohibited"),
    ("proprietary", "may not be reproduced .{0,80}without (?:the )?(?:prior )?written (?:consent|permission)"),
    ("beerware", "you can buy me a beer in return"),
    ("psf-2.0", "psf hereby grants licensee a nonexclusive royalty free world wide license"),
    ("non-commercial", "for (?:personal|research|academic|educational)(?: and)? non ?commercial use only"),
    ("non-commercial", "may not be used for commercial purposes"),
    ("share-alike", "derivative works must be (?:licensed|distributed) under the same (?:license|terms)"),
    ("attribution", "provided that (?:proper|appropriate) attribution is given"),
]

#: label, words of an address
ADDRESSES = [
    ("mit", "opensource org licenses? mit(?: license(?: php)?)?"),
    ("apache-2.0", "(?:www )?apache org licenses license 2 0(?: txt| html)?"),
    ("gpl-2.0", "(?:www )?gnu org licenses (?:old licenses )?gpl 2 0(?: txt| html)?"),
    ("gpl-3.0", "(?:www )?gnu org licenses gpl 3 0(?: txt| html)?"),
    ("gpl", "(?:www )?gnu org licenses(?: gpl)?(?: html)?"),
    ("lgpl-2.1", "(?:www )?gnu org licenses (?:old licenses )?lgpl 2 1(?: txt| html)?"),
    ("lgpl-3.0", "(?:www )?gnu org licenses lgpl 3 0(?: txt| html)?"),
    ("agpl-3.0", "(?:www )?gnu org licenses agpl 3 0(?: txt| html)?"),
    ("bsd", "opensource org licenses? bsd license(?: php)?"),
    ("bsd-2-clause", "opensource org licenses? bsd 2 clause"),
    ("bsd-3-clause", "opensource org licenses? bsd 3 clause"),
    ("mpl-2.0", "(?:www )?mozilla org mpl 2 0"),
    ("epl-2.0", "(?:www )?eclipse org legal epl (?:v20|2 0)(?: html)?"),
    ("bsl-1.0", "(?:www )?boost org license 1 0 txt"),
    ("unlicense", "(?:www )?unlicense org"),
    ("wtfpl", "(?:www )?wtfpl net"),
    ("cc-by-4.0", "creativecommons org licenses by 4 0"),
    ("cc-by-3.0", "creativecommons org licenses by 3 0"),
    ("cc-by-sa-4.0", "creativecommons org licenses by sa 4 0"),
    ("cc-by-sa-3.0", "creativecommons org licenses by sa 3 0"),
    ("cc-by-nc-4.0", "creativecommons org licenses by nc 4 0"),
    ("cc-by-nd-4.0", "creativecommons org licenses by nd 4 0"),
    ("cc-by-nc-sa-4.0", "creativecommons org licenses by nc sa 4 0"),
    ("cc-by-nc-nd-4.0", "creativecommons org licenses by nc nd 4 0"),
    ("cc0-1.0", "creativecommons org publicdomain zero 1 0"),
    ("odbl", "opendatacommons org licenses odbl"),
    ("pddl", "opendatacommons org licenses pddl"),
    ("ofl-1.1", "scripts sil org ofl"),
    ("isc", "opensource org licenses? isc"),
]

#: label, words that hint at a license without naming its version
HINTS = [
    ("gpl", "(?:gnu )?general public license"),
    ("lgpl", "(?:gnu )?lesser general public license"),
    ("apache", "apache (?:software )?license"),
    ("gpl", "(?:the )?gpl"),
    ("lgpl", "(?:the )?lgpl"),
    ("agpl", "(?:the )?agpl"),
    ("creative-commons", "creative commons(?: license)?"),
    ("copyleft", "copyleft"),
    ("open-source", "open source license"),
]


#: Every expression needs one of these: texts without any are not looked at further.
GATE_STEMS = (
    "licen", "spdx", "gpl", "bsd", "cc0", "cecill", "wtfpl", "attribution", "hereby", "software", "copyright", "copyleft", "warrant",
    "redistrib", "domain", "reserved", "proprietary", "unauthori", "reproduced", "beer", "commercial", "derivative", "boost",
    "mozilla", "eclipse", "commons", "scripts", "rail", "classpath", "sublicense", "advertising", "endorse", "damages", "altered",
    "specific", "gnu", "apache",
)
GATE_WORDS = ("cc", "asl")
GATE = f"(?i)(?:{'|'.join(GATE_STEMS)})|(?<![a-z])(?:{'|'.join(GATE_WORDS)})(?![a-z])"


def needed(expression: str) -> list[str]:
    """Runs of letters and digits that every match of the expression holds."""
    before = None
    while before != expression:
        before = expression
        expression = re.sub(r"\(\?:([^()|]*)\)(?!\?)", r"\1", expression, count=1)
        if before == expression:
            expression = re.sub(r"\(\?:[^()]*\)\??", "|", expression, count=1)
    expression = re.sub(r"\[[^]]*\]\??|\\[wS]\+|\.\{[^}]*\}", "|", expression)
    return re.findall(r"[a-z0-9]+", re.sub(r"[a-z0-9 ]\?", "|", expression))


def rules() -> list[tuple[int, str, str, int, float, str]]:
    """(number, label, keyword, priority, relevance, expression) of every rule."""
    found = []

    def add(kind, label, expression, keyword_from=None):
        keyword = max(needed(keyword_from or expression), key=len)
        found.append((len(found), label, keyword, *KINDS[kind], expression))

    for label, tag, names in NAMED:
        add("tag", label, f"spdx license identifier (?:{tag})")
        for name in names:
            add("notice", label, f"(?:licensed|released|distributed|published|available|provided|covered)(?: \\w+)? under (?:the )?(?:terms of )?(?:the )?(?:{name})", name)
            add("name", label, name)
    for kind, entries in (("text", SENTENCES), ("address", ADDRESSES), ("hint", HINTS)):
        for label, expression in entries:
            add(kind, label, expression)
    return found
