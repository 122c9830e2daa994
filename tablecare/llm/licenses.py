"""License scans: ordered signature rules gated by keywords, and phrases whose places are counted.

A rule is a regular expression over lower-cased text with single spaces, a label, a confidence and a priority. A rule
is only tried on a text that holds one of its keywords, of which each of its matches holds one, found by one pass of an Aho-Corasick automaton over all keywords.
Detections are taken by priority, then length, then place; one whose interval lies inside that of a detection taken
before it is suppressed, so `gnu lesser general public license v2.1` does not also report a plain gpl.
"""

from __future__ import annotations

import re
from collections import defaultdict
from functools import lru_cache
from math import prod
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_set, lower_ascii, runs, text_pieces, unused

#: Phrases of whole words and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: How sure one place of a phrase is.
PHRASE_CONFIDENCE = 0.8

#: A character of a word, after A-Z are lower case.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_IN_WORD = byte_set((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))

_V = r"(?:,? (?:version|v\.?|ver\.?) ?|[ -]v?)"
_LATER = r"(?:(?: or|,? or \(at your option\)) (?:any )?later(?: version)?|\+)?"
_CC = r"(?:creative commons|cc)[ -]"
_BY = r"(?:attribution|by)"
_NC, _ND, _SA = r"(?:non-?commercial|nc)", r"(?:no-?deriv(?:ative|s|atives)?(?: works)?|nd)", r"(?:share-?alike|sa)"

# Signatures by license. Each line: label; words of which a text must hold one; what the license is called; a sentence of its
# text, of its notice or of its address, if it has a telling one. Versions stand with the license they belong to.
_FAMILIES = [
    ("mit", "mit|expat", r"(?:the )?(?:mit|expat)(?: \(expat\))? licen[cs]e(?: \(mit\))?", "permission is hereby granted|permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit-0", "mit", r"mit no attribution(?: licen[cs]e)?|mit-0", ""),
    ("apache-1.0", "apache", rf"apache (?:software )?licen[cs]e{_V}1\.0|apache-1\.0", ""),
    ("apache-1.1", "apache", rf"apache (?:software )?licen[cs]e{_V}1\.1|apache-1\.1", ""),
    ("apache-2.0", "apache|asl2|asl 2", rf"apache (?:software )?licen[cs]e{_V}2(?:\.0)?|apache-?2(?:\.0)?|asl ?2(?:\.0)?", "apache.org|https?://(?:www\\.)?apache\\.org/licenses/license-2\\.0"),
    ("apache", "apache", r"apache (?:software )?licen[cs]e", "apache.org|https?://(?:www\\.)?apache\\.org/licenses"),
    ("gpl-1.0", "general public", rf"(?:gnu )?general public licen[cs]e{_V}1(?:\.0)?{_LATER}", ""),
    ("gpl-2.0", "general public", rf"(?:gnu )?general public licen[cs]e{_V}2(?:\.0)?{_LATER}", "gnu.org|https?://(?:www\\.)?gnu\\.org/licenses/(?:old-licenses/)?gpl-2\\.0"),
    ("gpl-3.0", "general public", rf"(?:gnu )?general public licen[cs]e{_V}3(?:\.0)?{_LATER}", "gnu.org|https?://(?:www\\.)?gnu\\.org/licenses/gpl-3\\.0"),
    ("gpl-2.0", "gpl", rf"gpl{_V}2(?:\.0)?{_LATER}", ""),
    ("gpl-3.0", "gpl", rf"gpl{_V}3(?:\.0)?{_LATER}", ""),
    ("gpl", "general public", r"(?:gnu )?general public licen[cs]e", "this program is free software|this program is free software: you can redistribute it and/or modify it under the terms of the gnu general public license"),
    ("lgpl-2.0", "general public", rf"(?:gnu )?library general public licen[cs]e{_V}2(?:\.0)?{_LATER}", ""),
    ("lgpl-2.1", "general public", rf"(?:gnu )?lesser general public licen[cs]e{_V}2\.1{_LATER}", "gnu.org|https?://(?:www\\.)?gnu\\.org/licenses/(?:old-licenses/)?lgpl-2\\.1"),
    ("lgpl-3.0", "general public", rf"(?:gnu )?lesser general public licen[cs]e{_V}3(?:\.0)?{_LATER}", "gnu.org|https?://(?:www\\.)?gnu\\.org/licenses/lgpl-3\\.0"),
    ("lgpl-2.1", "lgpl", rf"lgpl{_V}2\.1{_LATER}", ""),
    ("lgpl-3.0", "lgpl", rf"lgpl{_V}3(?:\.0)?{_LATER}", ""),
    ("lgpl", "general public", r"(?:gnu )?(?:lesser|library) general public licen[cs]e", ""),
    ("agpl-3.0", "affero", rf"(?:gnu )?affero general public licen[cs]e{_V}3(?:\.0)?{_LATER}", "gnu.org|https?://(?:www\\.)?gnu\\.org/licenses/agpl"),
    ("agpl-3.0", "agpl", rf"agpl{_V}3(?:\.0)?{_LATER}", ""),
    ("agpl", "affero", r"(?:gnu )?affero general public licen[cs]e", ""),
    ("gfdl-1.1", "free documentation", rf"(?:gnu )?free documentation licen[cs]e{_V}1\.1{_LATER}", ""),
    ("gfdl-1.2", "free documentation", rf"(?:gnu )?free documentation licen[cs]e{_V}1\.2{_LATER}", ""),
    ("gfdl-1.3", "free documentation", rf"(?:gnu )?free documentation licen[cs]e{_V}1\.3{_LATER}", "permission is granted|permission is granted to copy, distribute and/or modify this document under the terms of the gnu free documentation license"),
    ("gfdl", "free documentation", r"(?:gnu )?free documentation licen[cs]e", ""),
    ("bsd-2-clause", "bsd", r"(?:simplified|2-clause|two-clause|freebsd) bsd(?: licen[cs]e)?|bsd[ -]2[ -]clause(?: licen[cs]e)?", ""),
    ("bsd-3-clause", "bsd", r"(?:new|modified|revised|3-clause|three-clause) bsd(?: licen[cs]e)?|bsd[ -]3[ -]clause(?: licen[cs]e)?", "neither the name|neither the name of .{1,80}? nor the names of its contributors may be used to endorse or promote products"),
    ("bsd-4-clause", "bsd", r"(?:original|old|4-clause|four-clause) bsd(?: licen[cs]e)?|bsd[ -]4[ -]clause(?: licen[cs]e)?", "all advertising materials|all advertising materials mentioning features or use of this software must display"),
    ("0bsd", "bsd", r"(?:zero-clause|0-clause|free public) bsd(?: licen[cs]e)?|0bsd", ""),
    ("bsd", "bsd", r"bsd(?:[ -]style)? licen[cs]e", "redistributions of source code|redistributions of source code must retain the above copyright notice"),
    ("isc", "isc", r"isc licen[cs]e", "permission to use, copy|permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl-1.0", "mozilla", rf"mozilla public licen[cs]e{_V}1\.0", ""),
    ("mpl-1.1", "mozilla", rf"mozilla public licen[cs]e{_V}1\.1", ""),
    ("mpl-2.0", "mozilla", rf"mozilla public licen[cs]e{_V}2(?:\.0)?", "mozilla.org|https?://(?:www\\.)?mozilla\\.org/mpl/2\\.0"),
    ("mpl-2.0", "mpl", rf"mpl{_V}2(?:\.0)?", ""),
    ("mpl", "mozilla", r"mozilla public licen[cs]e", ""),
    ("epl-1.0", "eclipse", rf"eclipse public licen[cs]e{_V}1(?:\.0)?", ""),
    ("epl-2.0", "eclipse", rf"eclipse public licen[cs]e{_V}2(?:\.0)?", "eclipse.org|https?://(?:www\\.)?eclipse\\.org/legal/epl"),
    ("epl", "eclipse", r"eclipse public licen[cs]e", ""),
    ("edl-1.0", "eclipse", rf"eclipse distribution licen[cs]e(?:{_V}1(?:\.0)?)?", ""),
    ("cddl-1.0", "common development", rf"common development and distribution licen[cs]e(?:{_V}1(?:\.0)?)?", ""),
    ("cddl-1.1", "common development", rf"common development and distribution licen[cs]e{_V}1\.1", ""),
    ("cpl-1.0", "common public", rf"common public licen[cs]e(?:{_V}1(?:\.0)?)?", ""),
    ("ipl-1.0", "ibm", rf"ibm public licen[cs]e(?:{_V}1(?:\.0)?)?", ""),
    ("artistic-1.0", "artistic", rf"artistic licen[cs]e{_V}1(?:\.0)?", ""),
    ("artistic-2.0", "artistic", rf"artistic licen[cs]e{_V}2(?:\.0)?", ""),
    ("artistic", "artistic|same terms as perl", r"artistic licen[cs]e|same terms as perl(?: itself)?", ""),
    ("bsl-1.0", "boost", rf"boost software licen[cs]e(?:{_V}1(?:\.0)?)?", "boost.org|https?://(?:www\\.)?boost\\.org/license_1_0"),
    ("busl-1.1", "business source", rf"business source licen[cs]e(?:{_V}1\.1)?", ""),
    ("sspl-1.0", "server side", rf"server side public licen[cs]e(?:{_V}1(?:\.0)?)?", ""),
    ("elastic-2.0", "elastic", rf"elastic licen[cs]e(?:{_V}2(?:\.0)?)?", ""),
    ("unlicense", "unlicense", r"(?:the )?unlicense", "free and unencumbered|this is free and unencumbered software released into the public domain"),
    ("wtfpl", "want to public", r"do what the f[\w*]+ you want to public licen[cs]e", ""),
    ("wtfpl", "wtfpl", r"wtfpl", ""),
    ("zlib", "zlib", r"zlib(?:/libpng)? licen[cs]e", "this software is provided 'as-is'|this software is provided 'as-is', without any express or implied warranty"),
    ("libpng", "libpng|png reference", r"(?:png reference library|libpng) licen[cs]e", ""),
    ("openssl", "openssl", r"openssl(?:[ /-]ssleay)? licen[cs]e", ""),
    ("python-2.0", "python|psf", rf"python(?: software foundation)? licen[cs]e(?:{_V}2(?:\.0)?)?|psf licen[cs]e", ""),
    ("php-3.0", "php", rf"php licen[cs]e(?:{_V}3(?:\.0)?)?", ""),
    ("php-3.01", "php", rf"php licen[cs]e{_V}3\.01", ""),
    ("ruby", "ruby", r"ruby(?:'s)? licen[cs]e", ""),
    ("postgresql", "postgresql", r"postgresql licen[cs]e", ""),
    ("vim", "vim", r"vim licen[cs]e", ""),
    ("w3c", "w3c", r"w3c software (?:notice and )?licen[cs]e", ""),
    ("x11", "x11", r"x11 licen[cs]e", ""),
    ("ncsa", "ncsa", r"(?:university of illinois/?)?ncsa(?: open source)? licen[cs]e", ""),
    ("ecl-2.0", "educational", rf"educational community licen[cs]e(?:{_V}2(?:\.0)?)?", ""),
    ("eupl-1.1", "european union", rf"european union public licen[cs]e{_V}1\.1", ""),
    ("eupl-1.2", "european union", rf"european union public licen[cs]e(?:{_V}1\.2)?", ""),
    ("osl-3.0", "open software", rf"open software licen[cs]e(?:{_V}3(?:\.0)?)?", ""),
    ("afl-3.0", "academic free", rf"academic free licen[cs]e(?:{_V}3(?:\.0)?)?", ""),
    ("ms-pl", "microsoft|ms-pl", r"microsoft public licen[cs]e|ms-pl", ""),
    ("ms-rl", "microsoft|ms-rl", r"microsoft reciprocal licen[cs]e|ms-rl", ""),
    ("ofl-1.1", "font", rf"(?:sil )?open font licen[cs]e(?:{_V}1\.1)?", ""),
    ("lppl-1.3", "latex", rf"latex project public licen[cs]e(?:{_V}1\.3[abc]?)?", ""),
    ("odbl-1.0", "open database|odbl", rf"open database licen[cs]e(?:{_V}1(?:\.0)?)?|odbl", ""),
    ("odc-by-1.0", "open data commons", rf"open data commons attribution licen[cs]e(?:{_V}1(?:\.0)?)?", ""),
    ("pddl-1.0", "public domain dedication", rf"public domain dedication and licen[cs]e(?:{_V}1(?:\.0)?)?", ""),
    ("cc0-1.0", "cc0", r"cc0(?:[ -]1(?:\.0)?)?(?: universal)?", "creativecommons.org|https?://(?:www\\.)?creativecommons\\.org/publicdomain/zero"),
    ("openrail", "openrail|open rail", r"(?:creativeml |bigscience |bigcode )?open ?rail(?:\+\+)?(?:-m)?(?: licen[cs]e)?", ""),
    ("qpl-1.0", "q public", rf"q public licen[cs]e(?:{_V}1(?:\.0)?)?", ""),
    ("ncgl", "open government", rf"open government licen[cs]e(?:{_V}[123](?:\.0)?)?", ""),
    ("public-domain", "public domain", r"(?:released|placed|dedicated|is) (?:in|into|to) the public domain", ""),
    ("all-rights-reserved", "rights reserved", r"all rights reserved", ""),
    ("proprietary", "proprietary", r"proprietary and confidential|confidential and proprietary|proprietary licen[cs]e", ""),
]
_CC_KINDS = {"by": "", "by-sa": _SA, "by-nd": _ND, "by-nc": _NC, "by-nc-sa": rf"{_NC}[ -]{_SA}", "by-nc-nd": rf"{_NC}[ -]{_ND}"}
_CC_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")


# Telling phrases of license texts, notices, headers and exceptions, one by one, as their authors wrote them.
# Each line: label; the words that a match holds, of which the text must hold one; the phrase as a pattern over single spaces.
_TEXTS = [
    ("mit", "software is furnished to do so", r"to permit persons to whom the software is furnished to do so"),
    ("mit", "substantial portions of the software", r"shall be included in all copies or substantial portions of the software"),
    ("mit", "provided \"as is\"", r"the software is provided \"as is\", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability"),
    ("mit-0", "without restriction", r"to deal in the software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the software, and to permit persons to whom the software is furnished to do so\. the software is provided"),
    ("apache-2.0", "apache license", r"licensed under the apache license, version 2\.0 \(the \"license\"\)"),
    ("apache-2.0", "asf", r"licensed to the apache software foundation \(asf\) under one or more contributor license agreements"),
    ("apache-2.0", "except in compliance", r"you may not use this file except in compliance with the license\. you may obtain a copy of the license at"),
    ("apache-2.0", "required by applicable law", r"unless required by applicable law or agreed to in writing, software distributed under the license is distributed on an \"as is\" basis"),
    ("apache-1.1", "end-user documentation", r"the end-user documentation included with the redistribution, if any, must include the following acknowledg(?:e)?ment"),
    ("gpl", "without even the implied", r"without any warranty; without even the implied warranty of merchantability or fitness for a particular purpose\. see the gnu general public license"),
    ("gpl", "received a copy of the gnu", r"you should have received a copy of the gnu general public license along with"),
    ("gpl-2.0", "either version 2", r"gnu general public license as published by the free software foundation; either version 2"),
    ("gpl-3.0", "either version 3", r"gnu general public license as published by the free software foundation, either version 3"),
    ("lgpl", "lesser general public", r"you should have received a copy of the gnu lesser general public license along with"),
    ("lgpl-2.1", "lesser general public", r"gnu lesser general public license as published by the free software foundation; either version 2\.1"),
    ("lgpl-3.0", "lesser general public", r"gnu lesser general public license as published by the free software foundation,? either version 3"),
    ("agpl-3.0", "affero", r"gnu affero general public license as published by the free software foundation,? either version 3"),
    ("agpl-3.0", "through a computer network", r"all users interacting with it remotely through a computer network"),
    ("gpl-classpath-exception", "linking this library", r"linking this library statically or dynamically with other modules is making a combined work based on this library"),
    ("gpl-classpath-exception", "classpath", r"(?:the )?[\"']?classpath[\"']? exception"),
    ("gpl-gcc-exception", "runtime library exception", r"gcc runtime library exception"),
    ("gpl-font-exception", "font exception", r"(?:gpl )?font exception"),
    ("gpl-bison-exception", "bison parser", r"you may create a larger work that contains part or all of the bison parser skeleton"),
    ("gpl-autoconf-exception", "configuration script", r"a configuration script generated by autoconf"),
    ("gpl-linux-syscall-note", "normal system calls", r"does not cover user programs that use kernel services by normal system calls"),
    ("apache-llvm-exception", "llvm exception", r"llvm exceptions? to the apache 2\.0 license|apache license v?2\.0 with llvm exceptions?"),
    ("openssl-exception", "openssl", r"special exception, .{0,80}?permission to link .{0,80}?openssl"),
    ("bsd", "source and binary forms", r"redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("bsd", "redistributions in binary form", r"redistributions in binary form must reproduce the above copyright notice"),
    ("bsd", "copyright holders and contributors", r"this software is provided by the copyright holders and contributors \"as is\""),
    ("bsd-3-clause", "endorse or promote", r"may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-patent", "patent license", r"each copyright holder and contributor hereby grants .{0,160}?patent license"),
    ("isc", "above copyright notice and this permission notice", r"provided that the above copyright notice and this permission notice appear in all copies"),
    ("0bsd", "author disclaims all warranties", r"with or without fee is hereby granted\. the software is provided \"as is\" and the author disclaims all warranties"),
    ("mpl-2.0", "source code form", r"this source code form is subject to the terms of the mozilla public license, v\. ?2\.0"),
    ("mpl-1.1", "mozilla public license version 1.1", r"subject to the mozilla public license version 1\.1"),
    ("epl-1.0", "accompanying materials", r"this program and the accompanying materials are made available under the terms of the eclipse public license v1\.0"),
    ("epl-2.0", "accompanying materials", r"this program and the accompanying materials are made available under the terms of the eclipse public license v?\.? ?2\.0"),
    ("cddl-1.0", "common development and distribution", r"subject to the terms of the common development and distribution license"),
    ("zlib", "must not be misrepresented", r"the origin of this software must not be misrepresented"),
    ("zlib", "altered source versions", r"altered source versions must be plainly marked as such"),
    ("bsl-1.0", "boost software", r"distributed under the boost software license, version 1\.0"),
    ("unlicense", "anyone is free to copy", r"anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"),
    ("cc0-1.0", "waived all copyright", r"has waived all copyright and related (?:or|and) neighbou?ring rights"),
    ("cc0-1.0", "to the extent possible under law", r"to the extent possible under law, .{0,120}?(?:waived|dedicated) all copyright"),
    ("wtfpl", "you just do", r"you just do what the f\S{1,4} you want to"),
    ("artistic-2.0", "standard version", r"distribute verbatim copies of the source form of the standard version"),
    ("ofl-1.1", "sil open font", r"licensed under the sil open font license, version 1\.1"),
    ("ofl-1.1", "reserved font name", r"with reserved font names?"),
    ("psf-2.0", "psf hereby|python software foundation", r"psf hereby grants licensee a nonexclusive, royalty-free|license agreement is between the python software foundation"),
    ("ncsa", "names of its contributors", r"neither the names of .{1,80}? nor the names of its contributors may be used to endorse or promote products derived from this software"),
    ("ms-pl", "microsoft public", r"this license governs use of the accompanying software\. .{0,60}?microsoft public license"),
    ("postgresql", "without a written agreement", r"and without a written agreement is hereby granted, provided that the above copyright notice"),
    ("curl", "daniel stenberg", r"copyright \(c\) .{4,40}?, daniel stenberg"),
    ("json", "for good, not evil", r"the software shall be used for good, not evil"),
    ("beerware", "buy me a beer", r"you can buy me a beer in return"),
    ("commons-clause", "commons clause", r"commons clause.{0,20}? license condition"),
    ("sspl-1.0", "server side public", r"server side public license,? version 1"),
    ("busl-1.1", "business source", r"business source license,? (?:version )?1\.1"),
    ("elastic-2.0", "elastic license", r"elastic license (?:version )?2\.0"),
    ("all-rights-reserved", "no part of this", r"no part of this (?:publication|work|document) may be reproduced\b.{0,160}?without (?:the )?prior written permission"),
    ("proprietary", "trade secret", r"contains? (?:confidential|proprietary) information and trade secrets?"),
]


#: A run of what Python takes as white space, for RE2.
_SPACE = r"[\t-\r\x1c-\x20\x{85}\pZ]+"


class Rule(NamedTuple):
    priority: int  # lower goes first
    label: str
    keyword: str  # or several, parted by |: each match of the pattern holds one of them
    pattern: re.Pattern
    confidence: float


@lru_cache(maxsize=1)
def rules() -> list[Rule]:
    """All rules in order: tags, notices, sentences and addresses, names with versions, names alone, hints."""
    out = []

    def add(priority: int, label: str, keyword: str, pattern: str, confidence: float) -> None:
        edge = r"(?<![^\W_])(?:%s)(?![^\W_])" if priority != 2 else "(?:%s)"
        out.append(Rule(priority, label, keyword, re.compile(edge % pattern), confidence))

    for label in dict.fromkeys(f[0] for f in _FAMILIES):
        if label not in ("all-rights-reserved", "proprietary", "public-domain"):
            add(0, label, "spdx", rf"spdx-license-identifier: ?{re.escape(label)}(?:-only|-or-later|\+)?", 1.0)
    for label, keyword, name, sentence in _FAMILIES:
        versioned = bool(re.search(r"-\d", label))
        add(1, label, keyword, rf"(?:is |are )?(?:licen[cs]ed|released|distributed|available|provided|published) under (?:the )?(?:terms of )?(?:the )?(?:conditions of )?(?:{name})", 0.95)
        add(3 if versioned else 4, label, keyword, name, 0.8 if versioned else 0.7)
        if sentence:
            gate, _, text = sentence.partition("|")
            add(2, label, gate, text, 0.9)
    for label, keyword, pattern in _TEXTS:
        add(2, label, keyword, pattern, 0.9)
    for kind, extra in _CC_KINDS.items():
        tail = rf"[ -]{extra}" if extra else ""
        for version in _CC_VERSIONS:
            add(0, f"cc-{kind}-{version}", "spdx", rf"spdx-license-identifier: ?cc-{kind}-{re.escape(version)}", 1.0)
            wanted = rf"{_CC}{_BY}{tail}[ -]{re.escape(version)}(?: (?:international|unported|generic|license))*"
            add(1, f"cc-{kind}-{version}", "licensed under|licenced under", rf"licen[cs]ed under (?:a |the )?{wanted}", 0.95)
            add(3, f"cc-{kind}-{version}", "cc|creative commons", wanted, 0.85)
            add(2, f"cc-{kind}-{version}", "creativecommons.org", rf"https?://(?:www\.)?creativecommons\.org/licenses/{kind}/{re.escape(version)}", 0.95)
        add(4, f"cc-{kind}", "cc|creative commons", rf"{_CC}{_BY}{tail}(?: licen[cs]e)?", 0.7)
    for keyword, pattern in (("license|licence", r"see (?:the )?licen[cs]e (?:file )?for (?:more )?details"), ("licensed|licenced", r"licen[cs]ed under"), ("license|licence", r"end[ -]user licen[cs]e agreement"), ("copyright", r"copyright (?:\(c\)|©)? ?(?:19|20)\d\d")):
        add(5, "unclassified", keyword, pattern, 0.3)
    return sorted(out, key=lambda r: r.priority)


@lru_cache(maxsize=1)
def _gates() -> tuple[ahocorasick.Automaton, dict[str, list[int]], str]:
    by_keyword = defaultdict(list)
    for i, rule in enumerate(rules()):
        for keyword in rule.keyword.split("|"):
            by_keyword[keyword].append(i)
    automaton = ahocorasick.Automaton()
    for keyword in by_keyword:
        automaton.add_word(keyword, keyword)
    automaton.make_automaton()
    return automaton, dict(by_keyword), "|".join(_SPACE.join(map(re.escape, k.split(" "))) for k in sorted(by_keyword))


class Detection(NamedTuple):
    label: str
    start: int
    end: int
    confidence: float
    priority: int


def detect(text: str, gated: bool = True) -> list[Detection]:
    """Detections in a lower-cased text, offsets in it with its white space as single spaces; suppression applied.

    Without the gate all rules are tried, with the same result.
    """
    text = re.sub(r"\s+", " ", text)
    automaton, by_keyword, _ = _gates()
    tried = sorted({i for k in {k for _, k in automaton.iter(text)} for i in by_keyword[k]}) if gated else range(len(rules()))
    found = [Detection(r.label, m.start(), m.end(), r.confidence, r.priority) for i in tried for r in [rules()[i]] for m in r.pattern.finditer(text)]
    return sorted(_not_contained(sorted(set(found), key=lambda d: (d.priority, d.start - d.end, d.start, d.label))), key=lambda d: (d.start, d.end, d.label))


def _not_contained(ranked: list[Detection]) -> list[Detection]:
    """Detections that no kept one before them contains.

    One contains d if, of those that start at d's start or before, the furthest end is not before d's. A binary indexed
    tree over starts holds the furthest ends, so n detections take n log n steps.
    """
    place = {start: i + 1 for i, start in enumerate(sorted({d.start for d in ranked}))}
    furthest, kept = [-1] * (len(place) + 1), []
    for d in ranked:
        i, end = place[d.start], -1
        while i:
            end = max(end, furthest[i])
            i &= i - 1
        if end < d.end:
            kept.append(d)
            i = place[d.start]
            while i < len(furthest):
                furthest[i] = max(furthest[i], d.end)
                i += i & -i
    return kept


def phrase_places(text: str, phrases: dict[str, str] = PHRASES) -> list[tuple[int, str]]:
    """(word where it starts, label) of every place of a phrase in a lower-cased text, in order."""
    words = re.findall(WORD, text)
    wanted = [(p.split(), label) for p, label in phrases.items()]
    return sorted((i, label) for parts, label in wanted for i, w in enumerate(words) if w == parts[0] and words[i : i + len(parts)] == parts)


_FOUND = pa.struct([("label", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("confidence", pa.float64())])


def scan(docs: DataFrame, phrases: dict[str, str] = PHRASES, prefix: str = "") -> DataFrame:
    """docs with <prefix>n_words, n_base, first_word, last_word, base_labels, labels, score and detections.

    Words, places and base labels are of the phrases; labels adds those of the rules' detections other than
    `unclassified`, which a detection list still shows. score is how sure it is that some license stands in the text: one
    less the chance that every place of a phrase (PHRASE_CONFIDENCE) and every detection kept errs, 0 with none. A null or empty text has no words and nothing found (empty labels, null first and last word).
    Columns keep their names and values but for those that this adds. Rows are independent of one another.
    """
    gate = "|".join(sorted({re.escape(p.split()[-1]) for p in phrases}))

    @F.arrow_udf("struct<n_words: long, n_base: long, first_word: long, last_word: long, base_labels: string, labels: string, score: double, detections: array<struct<label: string, start: int, end: int, confidence: double>>>")
    def work(texts: pa.Array) -> pa.Array:
        pattern = f"{gate}|{_gates()[2]}"
        n_words, out = [], []
        for row, to, data, offsets in text_pieces(texts):
            data = lower_ascii(data)
            _, _, owner = runs(data, offsets, _IN_WORD)
            n_words.append(np.bincount(owner, minlength=to - row))
            low = pa.LargeStringArray.from_buffers(to - row, pa.py_buffer(np.ascontiguousarray(offsets)), pa.py_buffer(np.ascontiguousarray(data)))
            hit = pc.match_substring_regex(low, pattern).to_numpy(zero_copy_only=False)
            for k in range(to - row):
                if not hit[k]:
                    out.append((0, None, None, "", "", 0.0, []))
                    continue
                text = low[k].as_py()
                places = phrase_places(text, phrases)
                base = {label for _, label in places}
                found = detect(text)
                labels = base | {d.label for d in found if d.label != "unclassified"}
                score = 1 - prod(1 - d.confidence for d in found) * (1 - PHRASE_CONFIDENCE) ** len(places)
                out.append((len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(sorted(base)), ",".join(sorted(labels)), score, [dict(zip(("label", "start", "end", "confidence"), d, strict=False)) for d in found]))
        columns = list(zip(*out, strict=True)) or [[]] * 7
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(_FOUND)]
        words = pa.array(np.concatenate(n_words) if n_words else np.zeros(0, np.int64), pa.int64())
        return pa.StructArray.from_arrays([words, *(pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True))], ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections"])

    names = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections")
    own = unused(docs, "scan")[0]
    return docs.withColumn(own, work(F.col("text"))).withColumns({f"{prefix}{n}": F.col(f"{own}.{n}") for n in names}).drop(own)
