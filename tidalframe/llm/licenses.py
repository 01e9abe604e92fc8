r"""License scan by ordered signature rules, in Spark SQL.

Rules are regular expressions over the folded text: A-Z lower-cased, words apart by one space.
A text is scanned only if it passes a gate, and by a rule only if it has one of the rule's keywords.
Both are derived from the rules and are necessary for a match, so that they drop no detection.
Rules have four priorities: SPDX tags, notices ("licensed under ..."), full names with version,
bare family names. A detection whose interval lies in one of a better priority, or in a longer
one of its own, is suppressed; of equal intervals and priorities the first label of the alphabet
stays. The rules are hand-written passages of licence texts, names and tags, the latter two also
inside the templates of notices.

Beside them stands the base: places where the words of a phrase follow each other. Null counts
as the empty text, which has no words, no labels and the score 0. Repeated rows score alike, an
empty table gives an empty result, and extra columns are not read. Whole texts are scanned: the
places of a rule are summed up in blocks, so that time grows with the length of a very long text
and not with its square.
"""

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

# The base phrases with their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Label, pattern of the name in folded words, pattern of its SPDX tag.
LICENSES = [
    ("apache-2.0", "apache (?:software )?licen[cs]e,? (?:version |v)?2(?: 0)?", "apache 2 0"),
    ("apache-1.1", "apache (?:software )?licen[cs]e (?:version |v)?1 1", "apache 1 1"),
    ("mit", "(?:mit|expat) licen[cs]e", "mit"),
    ("mit-0", "mit no attribution(?: licen[cs]e)?", "mit 0"),
    ("x11", "x11 licen[cs]e", "x11"),
    ("isc", "isc licen[cs]e", "isc"),
    ("bsd-2-clause", "(?:(?:2|two) clause bsd|simplified bsd|freebsd) licen[cs]e", "bsd 2 clause"),
    ("bsd-3-clause", "(?:(?:3|three) clause bsd|(?:new|modified|revised) bsd) licen[cs]e", "bsd 3 clause"),
    ("bsd-4-clause", "(?:(?:4|four) clause bsd|original bsd) licen[cs]e", "bsd 4 clause"),
    ("0bsd", "zero clause bsd(?: licen[cs]e)?", "0bsd"),
    ("bsd", "bsd(?: style)? licen[cs]e", "bsd"),
    ("gpl-1.0", "gnu general public licen[cs]e (?:version |v)1(?: 0)?", "gpl 1 0(?: only| or later)?"),
    ("gpl-2.0", "gnu (?:general public licen[cs]e|gpl) (?:version |v)?2(?: 0)?", "gpl 2 0(?: only| or later)?"),
    ("gpl-3.0", "gnu (?:general public licen[cs]e|gpl) (?:version |v)?3(?: 0)?", "gpl 3 0(?: only| or later)?"),
    ("lgpl-2.1", "gnu (?:lesser|library) general public licen[cs]e (?:version |v)?2 1", "lgpl 2 1(?: only| or later)?"),
    ("lgpl-2.0", "gnu (?:lesser|library) general public licen[cs]e (?:version |v)?2(?: 0)?", "lgpl 2 0(?: only| or later)?"),
    ("lgpl-3.0", "gnu lesser general public licen[cs]e (?:version |v)?3(?: 0)?", "lgpl 3 0(?: only| or later)?"),
    ("lgpl", "(?:gnu )?(?:lesser|library) general public licen[cs]e", "lgpl"),
    ("agpl-3.0", "(?:gnu )?affero general public licen[cs]e (?:version |v)?3(?: 0)?", "agpl 3 0(?: only| or later)?"),
    ("agpl", "(?:gnu )?affero general public licen[cs]e", "agpl"),
    ("gfdl-1.3", "gnu free documentation licen[cs]e(?: (?:version |v)?1 3)?", "gfdl 1 3(?: only| or later)?"),
    ("mpl-1.1", "mozilla public licen[cs]e (?:version |v)?1 1", "mpl 1 1"),
    ("mpl-2.0", "mozilla public licen[cs]e(?: (?:version |v)?2(?: 0)?)?", "mpl 2 0"),
    ("epl-1.0", "eclipse public licen[cs]e (?:version |v)?1(?: 0)?", "epl 1 0"),
    ("epl-2.0", "eclipse public licen[cs]e(?: (?:version |v)?2(?: 0)?)?", "epl 2 0"),
    ("cddl-1.0", "common development and distribution licen[cs]e(?: (?:version |v)?1(?: 0)?)?", "cddl 1 0"),
    ("cpl-1.0", "common public licen[cs]e(?: (?:version |v)?1(?: 0)?)?", "cpl 1 0"),
    ("eupl-1.2", "european union public licen[cs]e(?: (?:version |v)?1 2)?", "eupl 1 2"),
    ("bsl-1.0", "boost software licen[cs]e(?: (?:version |v)?1(?: 0)?)?", "bsl 1 0"),
    ("artistic-2.0", "artistic licen[cs]e (?:version |v)?2(?: 0)?", "artistic 2 0"),
    ("artistic-1.0", "artistic licen[cs]e", "artistic 1 0"),
    ("zlib", "zlib(?: libpng)? licen[cs]e", "zlib"),
    ("wtfpl", "do what the f\\S{1,9} you want to public licen[cs]e", "wtfpl"),
    ("unlicense", "the unlicense", "unlicense"),
    ("python-2.0", "python software foundation licen[cs]e(?: (?:version |v)?2)?", "(?:python|psf) 2 0"),
    ("php-3.01", "php licen[cs]e(?: (?:version |v)?3(?: 0?1)?)?", "php 3 01"),
    ("ruby", "ruby licen[cs]e", "ruby"),
    ("postgresql", "postgresql licen[cs]e", "postgresql"),
    ("openssl", "openssl licen[cs]e", "openssl"),
    ("ofl-1.1", "(?:sil )?open font licen[cs]e(?: (?:version |v)?1 1)?", "ofl 1 1"),
    ("cc0-1.0", "(?:cc0|creative commons zero)(?: 1 0)?(?: universal)?", "cc0 1 0"),
    *[(f"cc-{code}-{v}", f"(?:cc {words}|creative commons {long}) (?:(?:international |unported )?(?:licen[cs]e )?(?:version )?)?{v[0]} {v[2]}", f"cc {words} {v[0]} {v[2]}") for code, words, long in (("by", "by", "attribution"), ("by-sa", "by sa", "attribution share ?alike"), ("by-nd", "by nd", "attribution no ?deriv(?:ative)?s"), ("by-nc", "by nc", "attribution non ?commercial"), ("by-nc-sa", "by nc sa", "attribution non ?commercial share ?alike"), ("by-nc-nd", "by nc nd", "attribution non ?commercial no ?deriv(?:ative)?s")) for v in ("2.0", "2.5", "3.0", "4.0")],
    ("odbl-1.0", "open (?:data commons open )?database licen[cs]e(?: (?:version |v)?1(?: 0)?)?", "odbl 1 0"),
    ("busl-1.1", "business source licen[cs]e(?: (?:version |v)?1 1)?", "busl 1 1"),
    ("sspl-1.0", "server side public licen[cs]e(?: (?:version |v)?1(?: 0)?)?", "sspl 1 0"),
    ("elastic-2.0", "elastic licen[cs]e(?: (?:version |v)?2(?: 0)?)?", "elastic 2 0"),
]
# Label, priority, keyword, pattern.
PHRASES = [
    ("mit", 2, "permission is hereby granted", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("isc", 2, "permission to use copy modify", "permission to use copy modify and or distribute this software for any purpose with or without fee"),
    ("bsd", 2, "redistribution and use", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("gpl", 2, "free software", "this (?:program|library) is free software you can redistribute it and or modify it"),
    ("public-domain", 2, "public domain", "(?:released|placed|dedicated) (?:in|into|to) the public domain"),
    ("public-domain", 4, "public domain", "public domain"),
    ("proprietary", 2, "all rights reserved", "all rights reserved"),
    ("proprietary", 3, "proprietary and", "proprietary and confidential"),
    ("mit", 4, "mit license", "mit license"),
    ("apache", 4, "apache license", "apache license"),
    ("gpl", 4, "general public license", "(?:gnu )?general public license"),
    ("creative-commons", 4, "creative commons", "creative commons(?: licen[cs]e)?"),
    ("copyright", 4, "copyright", "copyright (?:c )?(?:19|20)\\d\\d"),
]
# Label and pattern of passages that tell a licence text, in folded words.
PASSAGES = [
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell"),
    ("mit-0", "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided as is"),
    ("x11", "except as contained in this notice the name of the x consortium shall not be used in advertising"),
    ("isc", "permission to use copy modify and (?:or )?distribute this software (?:and its documentation )?for any purpose (?:with or without fee|and without fee) is hereby granted provided that the above copyright notice"),
    ("0bsd", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is"),
    ("hpnd", "permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted provided that the above copyright notice appears? in all copies and that both"),
    ("bsd-2-clause", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd-2-clause", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd-3-clause", "neither the name of (?:the )?(?:copyright holder|author|university|\\S{1,30}) nor the names of (?:its|his|other) contributors may be used to endorse or promote products"),
    ("bsd-3-clause-clear", "no express or implied licenses to any party s patent rights are granted by this license"),
    ("bsd-4-clause", "all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("apache-2.0", "terms and conditions for use reproduction and distribution 1 definitions license shall mean"),
    ("apache-2.0", "grant of copyright license subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide"),
    ("apache-2.0", "if the work includes a notice text file as part of its distribution then any derivative works that you distribute must include a readable copy"),
    ("apache-1.1", "the end user documentation included with the redistribution if any must include the following acknowledge?ment this product includes software developed by the apache software foundation"),
    ("apache-1.1", "products derived from this software may not be called apache nor may apache appear in their name"),
    ("gpl", "either version (?:1|2|3) of the license or at your option any later version"),
    ("gpl", "you should have received a copy of the gnu general public license along with this (?:program|software|library|file)"),
    ("gpl", "this (?:program|software|library) is distributed in the hope that it will be useful but without any warranty"),
    ("gpl-2.0", "the licenses for most software are designed to take away your freedom to share and change it by contrast the gnu general public license"),
    ("gpl-2.0", "activities other than copying distribution and modification are not covered by this license they are outside its scope"),
    ("gpl-2.0", "accompany it with the complete corresponding machine readable source code which must be distributed under the terms of sections 1 and 2 above"),
    ("gpl-3.0", "the gnu general public license is a free copyleft license for software and other kinds of works"),
    ("gpl-3.0", "no covered work shall be deemed part of an effective technological measure under any applicable law"),
    ("gpl-3.0", "to propagate a work means to do anything with it that without permission would make you directly or secondarily liable for infringement"),
    ("gpl-3.0", "you may convey verbatim copies of the program s source code as you receive it in any medium"),
    ("lgpl", "you should have received a copy of the gnu (?:lesser|library) general public license along with this (?:library|program)"),
    ("lgpl-2.1", "this is the first released version of the lesser gpl it also counts as the successor of the gnu library public license"),
    ("lgpl-2.1", "a work that uses the library in isolation is not a derivative work of the library and therefore falls outside the scope of this license"),
    ("lgpl-3.0", "this version of the gnu lesser general public license incorporates the terms and conditions of version 3"),
    ("agpl-3.0", "you should have received a copy of the gnu affero general public license along with this program"),
    ("agpl-3.0", "if you modify the program your modified version must prominently offer all users interacting with it remotely through a computer network"),
    ("gfdl-1.3", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("gfdl-1.3", "with no invariant sections no front cover texts and no back cover texts"),
    ("classpath-exception-2.0", "the copyright holders of this library give you permission to link this library with independent modules to produce an executable"),
    ("gcc-exception-3.1", "you have permission to propagate a work of target code formed by combining the runtime library with independent modules"),
    ("llvm-exception", "if as a result of your compiling your source code portions of this software are embedded into an object form of such source code"),
    ("font-exception-2.0", "if you create a document which uses this font and embed this font or unaltered portions of this font into the document"),
    ("mpl-1.1", "the contents of this file are subject to the mozilla public license version 1 1"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-2.0", "if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("mpl-2.0", "this source code form is incompatible with secondary licenses as defined by the mozilla public license"),
    ("epl-1.0", "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0"),
    ("epl-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license (?:v ?2 0|2 0)"),
    ("epl-2.0", "any use reproduction or distribution of the program constitutes recipient s acceptance of this agreement"),
    ("cddl-1.0", "the contents of this file are subject to the terms of the common development and distribution license"),
    ("cddl-1.0", "when distributing covered code include this cddl header in each file"),
    ("cpl-1.0", "the accompanying program is provided under the terms of this common public license"),
    ("ipl-1.0", "the accompanying program is provided under the terms of this ibm public license"),
    ("eupl-1.2", "this european union public licence the eupl applies to the work"),
    ("bsl-1.0", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("bsl-1.0", "must be included in all copies of the software in whole or in part and all derivative works of the software unless such copies or derivative works are solely in the form of machine executable object code"),
    ("artistic-2.0", "this license establishes the terms under which a given free software package may be copied modified distributed and or redistributed"),
    ("artistic-1.0", "the intent of this document is to state the conditions under which a package may be copied such that the copyright holder maintains some semblance of artistic control"),
    ("perl", "it under the same terms as perl itself"),
    ("zlib", "the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("zlib", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("zlib", "in no event will the authors? be held liable for any damages arising from the use of this software"),
    ("libpng-2.0", "the contributing authors and glenn randers pehrson disclaim all warranties"),
    ("wtfpl", "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed"),
    ("wtfpl", "you just do what the f\\S{1,9} you want to"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary"),
    ("blessing", "may you do good and not evil may you find forgiveness for yourself and forgive others"),
    ("beerware", "if we meet some ?day and you think this stuff is worth it you can buy me a beer in return"),
    ("json", "the software shall be used for good not evil"),
    ("python-2.0", "psf hereby grants licensee a nonexclusive royalty free world ?wide license to reproduce analyze test perform and or display publicly"),
    ("cnri-python", "cnri hereby grants licensee a nonexclusive royalty free world ?wide license"),
    ("php-3.01", "products derived from this software may not be called php nor may php appear in their name"),
    ("ruby", "you may make and give away verbatim copies of the source form of the software without restriction provided that you duplicate all of the original copyright notices"),
    ("postgresql", "in no event shall the university of california be liable to any party for direct indirect special incidental or consequential damages"),
    ("openssl", "this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("ssleay", "this product includes cryptographic software written by eric young"),
    ("ofl-1.1", "the goals of the open font license ofl are to stimulate worldwide development of collaborative font projects"),
    ("ofl-1.1", "neither the font software nor any of its individual components in original or modified versions may be sold by itself"),
    ("ncsa", "neither the names of (?:the )?\\S{1,40} (?:\\S{1,40} )?(?:\\S{1,40} )?(?:\\S{1,40} )?nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("ncsa", "university of illinois ncsa open source license"),
    ("cc0-1.0", "the person who associated a work with this deed has dedicated the work to the public domain"),
    ("cc0-1.0", "affirmer hereby overtly fully permanently irrevocably and unconditionally waives abandons and surrenders all of affirmer s copyright"),
    ("cc-by-4.0", "by exercising the licensed rights defined below you accept and agree to be bound by the terms and conditions of this creative commons attribution 4 0 international public license"),
    ("cc-by-sa-4.0", "by exercising the licensed rights defined below you accept and agree to be bound by the terms and conditions of this creative commons attribution sharealike 4 0 international public license"),
    ("cc-by-nc-4.0", "by exercising the licensed rights defined below you accept and agree to be bound by the terms and conditions of this creative commons attribution noncommercial 4 0 international public license"),
    ("creative-commons", "the work as defined below is provided under the terms of this creative commons public license ccpl or license"),
    ("creative-commons", "this work is licensed under (?:a|the) creative commons"),
    ("odbl-1.0", "this database is made available under the open database license"),
    ("pddl-1.0", "this database is made available under the public domain dedication and license"),
    ("odc-by-1.0", "this database is made available under the open data commons attribution license"),
    ("ogl-uk-3.0", "contains public sector information licensed under the open government licence v3 0"),
    ("etalab-2.0", "licence ouverte (?:open licence )?(?:version )?2 0"),
    ("dl-de-by-2.0", "datenlizenz deutschland namensnennung (?:version )?2 0"),
    ("busl-1.1", "the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work"),
    ("busl-1.1", "effective on the change date or the fourth anniversary of the first publicly available distribution"),
    ("sspl-1.0", "if you make the functionality of the program or a modified version available to third parties as a service you must make the service source code available"),
    ("elastic-2.0", "you may not provide the software to third parties as a hosted or managed service"),
    ("commons-clause", "the license does not grant to you and you are not granted the right to sell the software"),
    ("commons-clause", "commons clause license condition v1 0"),
    ("polyform-noncommercial-1.0.0", "polyform noncommercial license 1 0 0"),
    ("polyform-noncommercial-1.0.0", "any noncommercial purpose is a permitted purpose"),
    ("mulanps-2.0", "mulan psl v2 you can use this software according to the terms and conditions of the mulan psl v2"),
    ("ms-pl", "this license governs use of the accompanying software if you use the software you accept this license"),
    ("ms-pl", "microsoft public license(?: ms pl)?"),
    ("ms-rl", "microsoft reciprocal license(?: ms rl)?"),
    ("apsl-2.0", "apple public source license (?:version )?2 0"),
    ("nasa-1.3", "nasa open source agreement version 1 3"),
    ("upl-1.0", "universal permissive license(?: (?:version |v)?1 0)?"),
    ("vim", "there are no restrictions on distributing unmodified copies of vim"),
    ("curl", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is"),
    ("sleepycat", "redistributions in any form must be accompanied by information on how to obtain complete source code for the db software"),
    ("qpl-1.0", "the q public license(?: version 1 0)?"),
    ("openrail", "use based restrictions as referenced in paragraph 5 must be included as an enforceable provision"),
    ("bigscience-bloom-rail-1.0", "bigscience rail license v1 0"),
    ("proprietary", "this software is the (?:confidential and )?proprietary (?:information|property) of"),
    ("proprietary", "unauthorized (?:copying|reproduction|use|distribution) of this (?:file|software|document|material) (?:via any medium )?is strictly prohibited"),
    ("proprietary", "no part of this (?:publication|book|document|software|work) may be reproduced"),
    ("proprietary", "this end user licen[cs]e agreement eula is a legal agreement between you"),
    ("public-domain", "this (?:work|file|software|code|document) (?:is|has been placed) in the public domain"),
    ("public-domain", "no copyright is claimed"),
]
# Fixed value: what stands before the name or tag in a notice.
NOTICE = "(?:licen[cs]ed|released|distributed|published|available|provided|made available|covered) (?:by|under)(?: the)?(?: terms of)?(?: the)?"
#: Matches whose offsets are summed up together.
BLOCK = 64
SCORES = {1: 1.0, 2: 0.95, 3: 0.8, 4: 0.5}


def variants(pattern: str) -> list[str]:
    """What a pattern of the tables matches, with a line feed for each class of signs."""
    out, at = [], 0

    def sequence() -> list[str]:
        nonlocal at
        done, now = [], [""]
        while at < len(pattern) and pattern[at] != ")":
            if pattern[at] == "|":
                done, now, at = done + now, [""], at + 1
                continue
            if pattern.startswith("(?:", at):
                at += 3
                parts = sequence()
                at += 1
            elif m := re.compile(r"\[([a-z]+)\]").match(pattern, at):
                parts, at = list(m[1]), m.end()
            elif m := re.compile(r"\\.(?:\{[^}]*\})?").match(pattern, at):
                parts, at = ["\n"], m.end()
            else:
                parts, at = [pattern[at]], at + 1
            if pattern.startswith("?", at):
                parts, at = ["", *parts], at + 1
            now = [a + b for a in now for b in parts]
        return done + now

    while at < len(pattern):
        out += sequence()
    return out


def shortest(keys) -> tuple[str, ...]:
    """Keys without those that contain another."""
    return tuple(sorted(k for k in set(keys) if not any(o != k and o in k for o in keys)))


def keywords(pattern: str, words: int = 2) -> tuple[str, ...]:
    """The first words of all variants: folded text that matches has one of them."""
    return shortest({f" {' '.join(v.split(' ')[:words])} ".partition("\n")[0] for v in variants(pattern) if "," not in v})


def rules() -> list[tuple[int, int, str, tuple[str, ...], str]]:
    """(order, priority, label, keywords, pattern) of all rules."""
    out = []
    for label, name, tag in LICENSES:
        out.append((1, label, ("spdx",), f"spdx licen[cs]e identifier {tag}"))
        out.append((2, label, keywords(f"{name}|{tag}"), f"{NOTICE} (?:{name}|{tag})"))
        out.append((2, label, ("subject to",), f"subject to(?: the)?(?: terms (?:and conditions )?of)?(?: the)? (?:{name})"))
        out.append((3, label, keywords(name), name))
    out += [(2, label, keywords(pattern, 5), pattern) for label, pattern in PASSAGES]
    out += [(priority, label, (keyword,), pattern) for label, priority, keyword, pattern in PHRASES]
    return [(k, priority, label, words, pattern) for k, (priority, label, words, pattern) in enumerate(sorted(out, key=lambda r: r[0]))]


#: What a text has if a rule matches, but for notices with a tag, which TAGGED finds.
KEYWORDS = shortest({"spdx", *(k for _, _, k, _ in PHRASES), *(k for _, pattern in PASSAGES for k in keywords(pattern, 5)), *(next((w for w in ("licens", "licenc") if w in v), k) for _, name, _ in LICENSES for v in variants(name) for k in keywords(name) if "," not in v and f" {v} ".startswith(k))})
TAGGED = f" {NOTICE} (?:{'|'.join(tag for _, _, tag in LICENSES)})(?= )"


WORD = r"0-9a-z\x{80}-\x{10FFFF}"


def folded(text: Column) -> Column:
    """Words with a space before and after each."""
    low = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(low, f"[^{WORD}]+", " ")), F.lit(" "))


def _spaces(text: str) -> str:
    return f"(length({text}) - length(replace({text}, ' ', '')))"


def base_columns(norm: str) -> dict[str, str]:
    """SQL of the counts and places of the base phrases in folded text."""
    counts, firsts, lasts, labels = [], [], [], []
    for phrase, label in BASE.items():
        parts = f"split({norm}, ' {phrase}(?= )', -1)"
        words = len(phrase.split())
        counts.append(f"size({parts}) - 1")
        firsts.append(f"CASE WHEN size({parts}) > 1 THEN {_spaces(f'{parts}[0]')} END")
        lasts.append(f"CASE WHEN size({parts}) > 1 THEN {_spaces(norm)} - 1 - ({_spaces(f'element_at({parts}, -1)')} - 1) - {words} END")
        labels.append(f"CASE WHEN contains({norm}, ' {phrase} ') THEN '{label}' END")
    return {"n_base": " + ".join(counts), "first_word": f"least({', '.join(firsts)})", "last_word": f"greatest({', '.join(lasts)})", "base": f"array_sort(array_compact(array({', '.join(labels)})))"}


def detections(norm: str) -> str:
    """SQL of struct(labels, score): rules of which a keyword occurs, then suppression.

    Detections are sorted by start, longer first, better priority first, so whatever contains
    a detection comes before it; a fold keeps the farthest end of each priority.
    """
    q = lambda s: "r'" + s + "'"
    table = "array(" + ", ".join(f"named_struct('p', {p}, 'l', '{label}', 'k', array({', '.join(map(q, words))}), 'x', {q(f' (?:{pattern})(?= )')})" for _, p, label, words, pattern in rules()) + ")"
    active = f"filter({table}, r -> exists(r.k, k -> contains({norm}, k)))"
    # Lengths of what stands before each match and of the match; offsets are summed up in blocks.
    pieces = f"zip_with(split({norm}, r.x, -1), regexp_extract_all({norm}, r.x, 0), (s, m) -> named_struct('s', length(s), 'm', coalesce(length(m), 0)))"
    block = f"slice(ds, b * {BLOCK} + 1, {BLOCK})"
    ends = f"""aggregate(transform(sequence(0, (size(ds) - 1) div {BLOCK}), b -> aggregate({block}, 0, (t, d) -> t + d.s + d.m)),
        array(0), (o, t) -> concat(o, array(element_at(o, -1) + t)))"""
    inside_block = f"""aggregate({block}, named_struct('at', os[b], 'out', cast(array() AS array<struct<s: int, e: int>>)),
        (a, d) -> named_struct('at', a.at + d.s + d.m, 'out', CASE WHEN d.m > 0 THEN concat(a.out, array(named_struct('s', a.at + d.s, 'e', a.at + d.s + d.m))) ELSE a.out END), a -> a.out)"""
    places = f"flatten(flatten(transform(array({pieces}), ds -> transform(array({ends}), os -> flatten(transform(sequence(0, (size(ds) - 1) div {BLOCK}), b -> {inside_block}))))))"
    found = f"flatten(transform({active}, r -> transform({places}, d -> named_struct('s', d.s, 'e', -d.e, 'p', r.p, 'l', r.l))))"
    inside = " OR ".join(f"(d.p >= {p} AND a.m{p} >= -d.e)" for p in SCORES)
    marks = ", ".join(f"'m{p}', CASE WHEN d.p = {p} THEN greatest(a.m{p}, -d.e) ELSE a.m{p} END" for p in SCORES)
    worth = "CASE d.p " + " ".join(f"WHEN {p} THEN {v}D" for p, v in SCORES.items()) + " END"
    start = ", ".join(f"'m{p}', -1" for p in SCORES)
    return f"""aggregate(array_sort({found}), named_struct({start}, 'labels', cast(array() AS array<string>), 'score', 0.0D),
        (a, d) -> named_struct({marks}, 'labels', CASE WHEN {inside} THEN a.labels ELSE array_union(a.labels, array(d.l)) END, 'score', CASE WHEN {inside} THEN a.score ELSE greatest(a.score, {worth}) END),
        a -> named_struct('labels', a.labels, 'score', a.score))"""


def gate(norm: str) -> str:
    """SQL of a condition that holds wherever a rule matches."""
    return " OR ".join([*(f"contains({norm}, '{k}')" for k in KEYWORDS), f"{norm} RLIKE r'{TAGGED}'"])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), folded(common.text_or_empty(text_col)).alias("__t"))
    passes = gate("__t")
    base = base_columns("__t")
    none = "named_struct('labels', cast(array() AS array<string>), 'score', 0.0D)"
    empty = "named_struct('n', 0, 'f', cast(null AS int), 'l', cast(null AS int), 'b', cast(array() AS array<string>))"
    seen = f"named_struct('n', {base['n_base']}, 'f', {base['first_word']}, 'l', {base['last_word']}, 'b', {base['base']})"
    rows = rows.select("doc_id", F.expr(f"CASE WHEN __t = '  ' THEN 0 ELSE {_spaces('__t')} - 1 END").cast("long").alias("n_words"), F.expr(f"CASE WHEN contains(__t, ' license ') THEN {seen} ELSE {empty} END").alias("__b"), F.expr(f"CASE WHEN {passes} THEN {detections('__t')} ELSE {none} END").alias("__d"))
    return rows.select(
        "doc_id",
        "n_words",
        F.col("__b.n").cast("long").alias("n_base"),
        F.col("__b.f").cast("long").alias("first_word"),
        F.col("__b.l").cast("long").alias("last_word"),
        F.array_join("__b.b", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("__b.b", "__d.labels")), ",").alias("labels"),
        F.greatest(F.col("__d.score"), F.when(F.col("__b.n") > 0, 0.5).otherwise(0.0)).alias("score"),
    )
