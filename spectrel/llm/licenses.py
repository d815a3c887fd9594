"""License scans by ordered signature rules.

Every rule is a regex over the lower-cased text with a priority and keywords, one of which every match contains (they are taken from
the regex); an Aho-Corasick automaton finds the keywords of all rules in one pass, and only rules of which a keyword occurs run. Detections are taken in the order of their rules'
priority, then the longer first, then by place; one that overlaps none taken before is taken, one contained in a taken one is
suppressed, and one that overlaps a taken one in part is suppressed if it has a lower priority.

Besides, base phrases are found as words that stand consecutively; their labels always stay.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from re import _constants, _parser

import ahocorasick
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from spectrel.llm.common import LOWER, alnum_words, per_text, read

#: Base phrases and labels.
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

#: One license a line: SPDX id | a word for the reader | name | address | a sentence of its own after such words. Blanks stand for any white space.
LICENSES = r"""
gpl-1.0 | general public | gnu general public license,? (?:version |v\.? ?)1(?:\.0)?\b | gnu\.org/licenses/(?:old-licenses/)?gpl-1 |
gpl-2.0 | general public | gnu general public license,? (?:\(gpl\),? )?(?:version |v\.? ?)2(?:\.0)?\b | gnu\.org/licenses/(?:old-licenses/)?gpl-2 | free software foundation ; either version 2 of the license,? or
gpl-3.0 | general public | gnu general public license,? (?:\(gpl\),? )?(?:version |v\.? ?)3(?:\.0)?\b | gnu\.org/licenses/gpl-3 | free software foundation ; either version 3 of the license,? or
lgpl-2.0 | general public | gnu library general public license,? (?:version |v\.? ?)2(?:\.0)?\b | gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.0 | library general public license ; gnu library general public license
lgpl-2.1 | general public | gnu lesser general public license,? (?:version |v\.? ?)2\.1\b | gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.1 | version 2.1 of the license ; either version 2\.1 of the license
lgpl-3.0 | general public | gnu lesser general public license,? (?:version |v\.? ?)3(?:\.0)?\b | gnu\.org/licenses/lgpl-3 | lesser general public ; gnu lesser general public license as published by the free software foundation,? (?:either )?version 3
agpl-3.0 | affero | (?:gnu )?affero general public license,? (?:version |v\.? ?)3(?:\.0)?\b | gnu\.org/licenses/agpl-3 | affero general public ; gnu affero general public license as published by the free software foundation
gfdl-1.1 | free documentation | gnu free documentation license,? (?:version |v\.? ?)1\.1\b | gnu\.org/licenses/(?:old-licenses/)?fdl-1\.1 |
gfdl-1.2 | free documentation | gnu free documentation license,? (?:version |v\.? ?)1\.2\b | gnu\.org/licenses/(?:old-licenses/)?fdl-1\.2 |
gfdl-1.3 | free documentation | gnu free documentation license,? (?:version |v\.? ?)1\.3\b | gnu\.org/licenses/fdl-1\.3 | invariant sections ; with no invariant sections,? no front-cover texts
apache-1.0 | apache | apache (?:software )?license,? (?:version |v\.? ?)1\.0\b | apache\.org/licenses/license-1\.0 | apache group ; developed by the apache group for use in the apache http server
apache-1.1 | apache | apache (?:software )?license,? (?:version |v\.? ?)1\.1\b | apache\.org/licenses/license-1\.1 | apache software foundation ; this product includes software developed by the apache software foundation
apache-2.0 | apache | apache (?:software )?license,? (?:version |v\.? ?)?2(?:\.0)?\b | apache\.org/licenses/license-2\.0 | apache license ; you may not use this (?:file|work|software) except in compliance with the (?:apache )?license
mit | mit | (?:the )?mit (?:x11 )?(?:/x11 )?licen[sc]e\b | opensource\.org/licenses?/mit\b | free of charge ; permission is hereby granted,? free of charge,? to any person obtaining a copy
mit-0 | mit no attribution | mit no attribution(?: licen[sc]e)? | github\.com/aws/mit-0 |
x11 | x consortium | x11 licen[sc]e distribution modification variant | opensource\.org/licenses?/x11 | x consortium ; the name of the x consortium shall not be used in advertising
isc | isc | (?:the )?isc licen[sc]e\b | opensource\.org/licenses?/isc\b | with or without fee ; permission to use,? copy,? modify,? and/or distribute this software for any purpose with or without fee
0bsd | bsd | (?:zero[- ]clause|0-clause|0) ?bsd(?: licen[sc]e)? | opensource\.org/licenses?/0bsd |
bsd-1-clause | bsd | bsd 1-clause(?: licen[sc]e)? | opensource\.org/licenses?/bsd-1-clause |
bsd-2-clause | bsd | (?:simplified bsd|bsd 2-clause|2-clause bsd|freebsd)(?: licen[sc]e)? | opensource\.org/licenses?/bsd-2-clause | provided that the following conditions ; redistribution and use in source and binary forms,? with or without modification,? are permitted
bsd-3-clause | bsd | (?:new bsd|modified bsd|revised bsd|bsd 3-clause|3-clause bsd)(?: licen[sc]e)? | opensource\.org/licenses?/bsd-3-clause | endorse or promote ; neither the name of .{1,120}? may be used to endorse or promote products
bsd-4-clause | bsd | (?:original bsd|bsd 4-clause|4-clause bsd)(?: licen[sc]e)? | directory\.fsf\.org/wiki/license:bsd-4clause | acknowledgement ; all advertising materials mentioning features or use of this software must display
bsd | bsd | (?:bsd[- ]style|bsd) licen[sc]e\b | |
mpl-1.0 | mozilla public | mozilla public license,? (?:version |v\.? ?)1\.0\b | mozilla\.org/mpl/1\.0 |
mpl-1.1 | mozilla public | mozilla public license,? (?:version |v\.? ?)1\.1\b | mozilla\.org/mpl/(?:mpl-)?1\.1 | mozilla public license version ; subject to the mozilla public license version 1\.1
mpl-2.0 | mozilla public | mozilla public license,? (?:version |v\.? ?)2(?:\.0)?\b | mozilla\.org/(?:en-us/)?mpl/2\.0 | source code form ; this source code form is subject to the terms of the mozilla public license
epl-1.0 | eclipse public | eclipse public license,? (?:- |version |v\.? ?)?1(?:\.0)?\b | eclipse\.org/legal/epl-v10 |
epl-2.0 | eclipse public | eclipse public license,? (?:- |version |v\.? ?)?2(?:\.0)?\b | eclipse\.org/legal/epl-(?:2\.0|v20) | program and the accompanying ; this program and the accompanying materials are made available under the terms
edl-1.0 | eclipse distribution | eclipse distribution license,? (?:- |version |v\.? ?)?1(?:\.0)?\b | eclipse\.org/org/documents/edl-v10 |
cddl-1.0 | common development and dist | common development and distribution license,? (?:\(cddl\),? )?(?:version |v\.? ?)?1(?:\.0)?\b | opensource\.org/licenses?/cddl-1 |
cddl-1.1 | common development and dist | common development and distribution license,? (?:\(cddl\),? )?(?:version |v\.? ?)?1\.1\b | glassfish\.java\.net/public/cddl |
cpl-1.0 | common public | common public license,? (?:version |v\.? ?)?1(?:\.0)?\b | opensource\.org/licenses?/cpl1 |
artistic-1.0 | artistic | artistic license,? (?:version |v\.? ?)?1(?:\.0)?\b | opensource\.org/licenses?/artistic-(?:license-)?1 |
artistic-2.0 | artistic | artistic license,? (?:version |v\.? ?)?2(?:\.0)?\b | opensource\.org/licenses?/artistic-(?:license-)?2 | standard version ; you may distribute verbatim copies of the source form of the standard version
perl | perl | same terms as perl(?: 5)?(?: itself)? | dev\.perl\.org/licenses | perl itself ; redistribute it and/or modify it under the same terms as perl
bsl-1.0 | boost | boost software license,? (?:- )?(?:version |v\.? ?)?1(?:\.0)?\b | boost\.org/license_1_0 | machine-executable object ; machine-executable object code generated by a source language processor
zlib | zlib | zlib(?:/libpng)? licen[sc]e\b | (?:zlib\.net/zlib_license|opensource\.org/licenses?/zlib) | as-is ; provided 'as-is',? without any express or implied warranty
libpng | libpng | libpng licen[sc]e\b | libpng\.org/pub/png/src/libpng-license | png reference library ; the png reference library is supplied
unlicense | unlicense | (?:the )?unlicense\b | unlicense\.org | free and unencumbered ; this is free and unencumbered software released into the public domain
wtfpl | public license | do what the .{1,10}? you want to public license | wtfpl\.net |
cc0-1.0 | cc0 | (?:creative commons )?cc0(?:[- ]1\.0| universal| 1\.0 universal)? | creativecommons\.org/publicdomain/zero/1\.0 | waived all copyright ; has waived all copyright and related or neighboring rights
cc-pdm-1.0 | public domain mark | public domain mark(?: 1\.0)? | creativecommons\.org/publicdomain/mark/1\.0 |
cc-by-1.0 | cc | (?:creative commons attribution|cc[- ]by)[- ]1\.0\b | creativecommons\.org/licenses/by/1\.0 |
cc-by-2.0 | cc | (?:creative commons attribution|cc[- ]by)[- ]2\.0\b | creativecommons\.org/licenses/by/2\.0 |
cc-by-2.5 | cc | (?:creative commons attribution|cc[- ]by)[- ]2\.5\b | creativecommons\.org/licenses/by/2\.5 |
cc-by-3.0 | cc | (?:creative commons attribution|cc[- ]by)[- ]3\.0\b | creativecommons\.org/licenses/by/3\.0 |
cc-by-4.0 | cc | (?:creative commons attribution|cc[- ]by)[- ]4\.0\b | creativecommons\.org/licenses/by/4\.0 |
cc-by-sa-2.0 | cc | (?:creative commons attribution-share ?alike|cc[- ]by[- ]sa)[- ]2\.0\b | creativecommons\.org/licenses/by-sa/2\.0 |
cc-by-sa-3.0 | cc | (?:creative commons attribution-share ?alike|cc[- ]by[- ]sa)[- ]3\.0\b | creativecommons\.org/licenses/by-sa/3\.0 |
cc-by-sa-4.0 | cc | (?:creative commons attribution-share ?alike|cc[- ]by[- ]sa)[- ]4\.0\b | creativecommons\.org/licenses/by-sa/4\.0 |
cc-by-nd-4.0 | cc | (?:creative commons attribution-no ?deriv(?:ative)?s?|cc[- ]by[- ]nd)[- ]4\.0\b | creativecommons\.org/licenses/by-nd/4\.0 |
cc-by-nc-2.0 | cc | (?:creative commons attribution-non ?commercial|cc[- ]by[- ]nc)[- ]2\.0\b | creativecommons\.org/licenses/by-nc/2\.0 |
cc-by-nc-3.0 | cc | (?:creative commons attribution-non ?commercial|cc[- ]by[- ]nc)[- ]3\.0\b | creativecommons\.org/licenses/by-nc/3\.0 |
cc-by-nc-4.0 | cc | (?:creative commons attribution-non ?commercial|cc[- ]by[- ]nc)[- ]4\.0\b | creativecommons\.org/licenses/by-nc/4\.0 |
cc-by-nc-sa-4.0 | cc | (?:creative commons attribution-non ?commercial-share ?alike|cc[- ]by[- ]nc[- ]sa)[- ]4\.0\b | creativecommons\.org/licenses/by-nc-sa/4\.0 |
cc-by-nc-nd-4.0 | cc | (?:creative commons attribution-non ?commercial-no ?deriv(?:ative)?s?|cc[- ]by[- ]nc[- ]nd)[- ]4\.0\b | creativecommons\.org/licenses/by-nc-nd/4\.0 |
cc-by-nc-nd | cc | cc[- ]by[- ]nc[- ]nd\b | creativecommons\.org/licenses/by-nc-nd/ |
cc-by-nc-sa | cc | cc[- ]by[- ]nc[- ]sa\b | creativecommons\.org/licenses/by-nc-sa/ |
cc-by-nc | cc | cc[- ]by[- ]nc\b | creativecommons\.org/licenses/by-nc/ |
cc-by-nd | cc | cc[- ]by[- ]nd\b | creativecommons\.org/licenses/by-nd/ |
cc-by-sa | cc | cc[- ]by[- ]sa\b | creativecommons\.org/licenses/by-sa/ |
odbl-1.0 | open database | (?:odc )?open database license(?: \(odbl\))?(?: v?1\.0)? | opendatacommons\.org/licenses/odbl |
odc-by-1.0 | open data commons | open data commons attribution license(?: v?1\.0)? | opendatacommons\.org/licenses/by |
pddl-1.0 | public domain dedication | (?:open data commons )?public domain dedication (?:and|&) licen[sc]e | opendatacommons\.org/licenses/pddl |
cdla-permissive-2.0 | community data | community data license agreement[- –]+permissive(?:[- ,]+(?:version )?2\.0)? | cdla\.(?:dev|io)/permissive |
cdla-sharing-1.0 | community data | community data license agreement[- –]+sharing(?:[- ,]+(?:version )?1\.0)? | cdla\.(?:dev|io)/sharing |
ogl-uk-3.0 | open government | open government licen[sc]e(?: v?3\.0)? | nationalarchives\.gov\.uk/doc/open-government-licence |
eupl-1.1 | european union public | european union public licen[sc]e,? (?:version |v\.? ?)?1\.1\b | joinup\.ec\.europa\.eu/.{0,40}?eupl1\.1 |
eupl-1.2 | european union public | european union public licen[sc]e,? (?:version |v\.? ?)?1\.2\b | joinup\.ec\.europa\.eu/.{0,40}?eupl | eupl ; licensed under the eupl
ms-pl | microsoft public | microsoft public license(?: \(ms-pl\))? | opensource\.org/licenses?/ms-pl |
ms-rl | microsoft reciprocal | microsoft reciprocal license(?: \(ms-rl\))? | opensource\.org/licenses?/ms-rl |
ofl-1.1 | open font | (?:sil )?open font license,? ?(?:\(ofl\) )?(?:version |v\.? ?)?(?:1\.1)? | (?:scripts\.sil\.org/ofl|openfontlicense\.org) | reserved font name ; with reserved font name
ncsa | university of illinois | university of illinois(?:/ncsa)? open source license | opensource\.org/licenses?/ncsa |
psf-2.0 | python software foundation | python software foundation license(?: version 2)? | docs\.python\.org/.{0,20}?license | psf license ; psf license agreement for python
python-2.0 | python license | python license(?: 2\.0)? | |
php-3.01 | php | php license,? (?:version |v\.? ?)?3\.01\b | php\.net/license/3_01 | php software ; this product includes php software
ruby | ruby | ruby'?s? licen[sc]e\b | ruby-lang\.org/en/about/license | ruby itself ; under the same terms as ruby
tcl | tcl | tcl/tk licen[sc]e\b | tcl\.tk/software/tcltk/license |
openssl | openssl | openssl licen[sc]e\b | openssl\.org/source/license | openssl project ; developed by the openssl project
curl | curl | curl licen[sc]e\b | curl\.(?:se|haxx\.se)/docs/copyright |
icu | icu | icu license\b | unicode\.org/.{0,40}?icu/license |
unicode-dfs | unicode | unicode(?:,? inc\.?)? (?:license agreement|terms of use) | unicode\.org/(?:license|copyright) |
ijg | independent jpeg | independent jpeg group licen[sc]e | | independent jpeg group ; based in part on the work of the independent jpeg group
postgresql | postgresql | (?:the )?postgresql licen[sc]e\b | postgresql\.org/about/licen[cs]e |
vim | vim | vim licen[sc]e\b | vimdoc\.sourceforge\.net/.{0,40}?license |
w3c | w3c | w3c software (?:notice and )?license | w3\.org/consortium/legal/.{0,20}?copyright-software |
afl-3.0 | academic free | academic free license,? (?:version |v\.? ?)?3(?:\.0)? | opensource\.org/licenses?/afl-3 |
osl-3.0 | open software license | open software license,? (?:version |v\.? ?)?3(?:\.0)? | opensource\.org/licenses?/osl-3 |
ecl-2.0 | educational community | educational community license,? (?:version |v\.? ?)?2(?:\.0)? | opensource\.org/licenses?/ecl-2 |
qpl-1.0 | q public | q public license(?:,? version 1(?:\.0)?)? | opensource\.org/licenses?/qpl |
lppl-1.3c | latex project | latex project public license(?:,? (?:version |v\.? ?)?1\.3c?)? | latex-project\.org/lppl |
blueoak-1.0.0 | blue oak | blue oak model license(?: 1\.0\.0)? | blueoakcouncil\.org/license |
mulan-psl-2.0 | mulan | mulan psl v2|mulan permissive software license,? version 2 | license\.coscl\.org\.cn/mulanpsl2 |
busl-1.1 | business source | business source license(?: 1\.1)? | mariadb\.com/bsl11 |
sspl-1.0 | server side public | server side public license(?:,? v(?:ersion )?1)? | mongodb\.com/licensing/server-side |
elastic-2.0 | elastic | elastic license(?: 2\.0)? | elastic\.co/licensing/elastic-license |
openrail-m | rail | (?:creativeml |bigscience )?open ?rail(?:\+\+)?[- ]?m? licen[sc]e | huggingface\.co/spaces/.{0,40}?license |
bigscience-rail-1.0 | bigscience | bigscience (?:bloom )?rail (?:license )?1\.0 | |
llama-community | llama | llama \d(?:\.\d)? community license agreement | (?:ai\.meta|llama)\.com/.{0,20}?license |
proprietary | confidential | (?:proprietary and confidential|confidential and proprietary) | | all rights reserved ; unauthorized copying of this file,? via any medium,? is strictly prohibited
public-domain | public domain | (?:released|placed|dedicated|is) (?:in|into|to) the public domain | | no copyright ; no copyright is claimed
cc-by | creative commons attribution | creative commons attribution(?: international| unported)?(?: license)? | creativecommons\.org/licenses/by/ |
lgpl | lesser general public | gnu lesser general public license | gnu\.org/(?:licenses|copyleft)/lgpl |
agpl | affero | affero general public license | gnu\.org/licenses/agpl |
gpl | general public | gnu general public license | gnu\.org/(?:licenses|copyleft)/gpl | gnu gpl ; (?:under|of) the gnu gpl
apache | apache | apache (?:software )?license | apache\.org/licenses/? |
mpl | mozilla public | mozilla public license | mozilla\.org/(?:en-us/)?mpl |
epl | eclipse public | eclipse public license | eclipse\.org/legal/epl |
"""
#: Kinds of rules by priority, and the score that a detection of each gives.
TAG, SENTENCE, ADDRESS, NOTICE, NAME = range(5)
SCORES = (1.0, 0.95, 0.9, 0.8, 0.6)
#: The score of base phrases alone.
BASE_SCORE = 0.5


@dataclass(frozen=True)
class Rule:
    name: str
    label: str
    keywords: tuple[str, ...]
    pattern: re.Pattern
    kind: int


def needles(pattern: str) -> tuple[str, ...]:
    """Strings of which every match of the pattern contains one: the set whose shortest is longest; none if the pattern has no such set."""

    def of(tree) -> tuple[str, ...]:
        sets, run = [], ""
        for op, arg in [*tree, (None, None)]:
            if op is _constants.LITERAL:
                run += chr(arg)
                continue
            sets.append((run,) if run else ())
            run = ""
            if op is _constants.SUBPATTERN:
                sets.append(of(arg[-1]))
            elif op is _constants.BRANCH:
                each = [of(x) for x in arg[1]]
                sets.append(tuple(dict.fromkeys(w for x in each for w in x)) if all(each) else ())
            elif op in (_constants.MAX_REPEAT, _constants.MIN_REPEAT) and arg[0]:
                sets.append(of(arg[2]))
        return max(sets, key=lambda x: min(map(len, x), default=0))

    return of(_parser.parse(pattern))


def rules() -> list[Rule]:
    """The rules in the order of their priority: by kind, then as the licenses are listed (special ones before general ones)."""
    out = []
    # blanks outside of brackets stand for white space
    space = lambda p: re.sub(r"(?<!\[-) (\??)(?![^\[]*\])", lambda m: r"\s*" if m[1] else r"\s+", p.strip())
    for line in LICENSES.strip().splitlines():
        spdx, _, name, address, sentence = _fields(line)
        # keywords come from the part of the pattern that is the rule's own
        add = lambda kind, part, pattern: out.append(Rule(f"{spdx}/{kind}", spdx, needles(part), re.compile(pattern), kind))  # noqa: B023, E731
        add(TAG, re.escape(spdx), rf"(?:spdx[-\s]licen[sc]e[-\s]identifier|licen[sc]e)\s*[:=]\s*[\"'(]*{re.escape(spdx)}(?:-only|-or-later|\+)?(?![\w.-]*\w)")
        if sentence:
            pattern = space(sentence.partition(" ; ")[2])
            add(SENTENCE, pattern, pattern)
        if address:
            add(ADDRESS, space(address), rf"(?:https?://)?(?:www\.)?(?:{space(address)})[\w./-]*")
        add(NOTICE, space(name), rf"(?:licen[sc]ed|released|distributed|available|published|covered|provided)\s+(?:under|by|with)\s+(?:the\s+|an?\s+)?(?:terms\s+(?:and\s+conditions\s+)?of\s+)?(?:the\s+)?(?:{space(name)})")
        add(NAME, space(name), rf"(?<!\w)(?:{space(name)})")
    return sorted(out, key=lambda r: r.kind)


def _fields(line: str) -> list[str]:
    """Five fields; a bar inside a group belongs to its pattern."""
    out, depth, at = [""], 0, 0
    while at < len(line):
        c = line[at]
        depth += (c == "(") - (c == ")") if not (at and line[at - 1] == "\\") else 0
        if c == "|" and depth <= 0 and line[at - 1 : at] == " " and (at + 1 == len(line) or line[at + 1] == " ") and len(out) < 5:
            out.append("")
        else:
            out[-1] += c
        at += 1
    return [x.strip() for x in (out + [""] * 5)[:5]]


class Scanner:
    def __init__(self, ordered: list[Rule] | None = None):
        self.rules = ordered if ordered is not None else rules()
        self.automaton = ahocorasick.Automaton()
        by: dict[str, list[int]] = {}
        if not all(r.keywords for r in self.rules):
            raise ValueError("a rule has no keyword")
        for i, r in enumerate(self.rules):
            for word in r.keywords:
                by.setdefault(word, []).append(i)
        for word, which in by.items():
            self.automaton.add_word(word, which)
        self.automaton.make_automaton()
        self.base = [(f" {p} ".encode(), label) for p, label in BASE]

    def detect(self, text: str) -> list[tuple[int, int, int]]:
        """(rule's number, start, end) of the detections that are taken, in the order of the text; text is lower-cased."""
        run: set[int] = set()
        for _, which in self.automaton.iter(text):
            run.update(which)
        found = []
        for i in run:
            found += [(i, *m.span()) for m in self.rules[i].pattern.finditer(text)]
        found.sort(key=lambda d: (d[0], d[1] - d[2], d[1]))
        return self.resolve(found)

    @staticmethod
    def resolve(found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Of detections in the order of priority, those that overlap none taken before."""
        from bisect import bisect_right, insort

        taken: list[tuple[int, int, int]] = []  # by start; they don't overlap
        for i, a, b in found:
            at = bisect_right(taken, (a, 1 << 60, 0))
            if not (at and taken[at - 1][1] > a) and not (at < len(taken) and taken[at][0] < b) and b > a:
                insort(taken, (a, b, i))
        return [(i, a, b) for a, b, i in taken]

    def base_places(self, words: list[bytes]) -> list[tuple[int, str]]:
        """(word's number, label) of the base phrases."""
        joined = b" " + b" ".join(words) + b" "
        out = []
        for phrase, label in self.base:
            at, n, last = joined.find(phrase), 0, 0
            while at >= 0:
                n += joined.count(b" ", last, at)
                last = at
                out.append((n, label))
                at = joined.find(phrase, at + 1)
        return out


DETECTION = T.StructType([T.StructField("rule", T.StringType()), T.StructField("label", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
OUT = [("n_words", T.LongType()), ("n_base", T.LongType()), ("first_word", T.LongType()), ("last_word", T.LongType()), ("base_labels", T.StringType()), ("labels", T.StringType()), ("score", T.DoubleType()), ("detections", T.ArrayType(DETECTION))]


def license_scan(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs (or the columns keep) and what the scan finds in every whole text.

    n_words; n_base, first_word, last_word: the base phrases' places (null if there is none); base_labels and labels (with those of the
    rules), both distinct, sorted and joined by commas; score: that of the best detection, BASE_SCORE for base phrases alone, else 0;
    detections: rule, label, start and end in characters. A null text counts as empty: no words, empty labels, score 0. Rows
    that repeat are scanned each. Columns of docs with the names of new ones are replaced. An empty table gives an empty table.
    """

    def make():
        scan = Scanner()

        def do(texts):
            cols: list[list] = [[] for _ in OUT]
            for t in texts:
                words = alnum_words(t)
                places = scan.base_places(words)
                at = [p for p, _ in places]
                base = {x for _, x in places}
                found = scan.detect(t.translate(LOWER).decode("utf-8", "replace")) if t else []
                own = [scan.rules[i] for i, _, _ in found]
                score = max([SCORES[r.kind] for r in own], default=BASE_SCORE if base else 0.0)
                detections = [{"rule": r.name, "label": r.label, "start": a, "end": b} for r, (_, a, b) in zip(own, found, strict=True)]
                row = (len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(base | {r.label for r in own})), score, detections)
                for c, v in zip(cols, row, strict=True):
                    c.append(v)
            return cols

        return do

    return per_text(docs, text, OUT, make, keep)


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """license_scan() of all documents; edge cases as defined there."""
    return license_scan(read(spark, sf_dir, "documents"), keep=["doc_id"]).drop("detections")
