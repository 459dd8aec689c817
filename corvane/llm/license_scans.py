"""Licence scans by sentence rules.

A text is cut into sentences: after . ! ? before a blank, at blank lines, after a colon at a line's end and at list
marks.  Wrapped lines are joined, and marks of comments at their edges vanish, since a sentence is reduced to lower-cased
letters and digits.  Known sentences become identifiers; a sentence that is unknown as a whole is looked up line by
line, as notices often stand on lines of their own without an end mark.  A licence of several sentences is a run of
identifiers; such rules are tried in order, and a run that one has matched is spent, so fuller licences stand before
their parts.  Every other identifier that is a licence of its own names it.

SPDX expressions are read whole: every operand of AND and OR, whatever its parentheses, is a notice of its own.  "+" after a
GNU licence is its "or later" form, after another it changes nothing; an exception (WITH) leaves its licence's name.

Known sentences hold one of ANCHORS, so texts without any are passed over after a plain search.

Cases: a null or empty text has no identifiers and no licence; a sentence repeated in a text gives its identifier each
time but names the licence once; licences are listed in the order of the rules, then of first appearance; repeated rows
give equal rows; texts are read whole; an empty table gives an empty result; other columns may have any names, as only
the named ones are read.
"""

from __future__ import annotations

import itertools
import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.base import bound

#: SPDX identifiers, whether they restrict use, and names in normal form.
LICENSES = (
    ("MIT", False, ("mit license", "mit licence", "expat license")),
    ("Apache-2.0", False, ("apache license version 2 0", "apache license 2 0", "apache 2 0 license", "apache software license version 2 0")),
    ("Apache-1.1", False, ("apache software license version 1 1", "apache license 1 1")),
    ("BSD-2-Clause", False, ("bsd 2 clause license", "2 clause bsd license", "simplified bsd license")),
    ("BSD-3-Clause", False, ("bsd 3 clause license", "3 clause bsd license", "new bsd license", "modified bsd license")),
    ("0BSD", False, ("zero clause bsd license", "bsd zero clause license")),
    ("ISC", False, ("isc license",)),
    ("Zlib", False, ("zlib license",)),
    ("BSL-1.0", False, ("boost software license version 1 0", "boost software license 1 0")),
    ("PostgreSQL", False, ("postgresql license",)),
    ("PSF-2.0", False, ("python software foundation license version 2", "psf license")),
    ("Artistic-2.0", False, ("artistic license 2 0", "artistic license version 2 0")),
    ("Unlicense", False, ("unlicense",)),
    ("WTFPL", False, ("wtfpl",)),
    ("OFL-1.1", False, ("sil open font license version 1 1", "sil open font license 1 1")),
    ("MPL-1.1", True, ("mozilla public license version 1 1", "mozilla public license 1 1")),
    ("MPL-2.0", True, ("mozilla public license version 2 0", "mozilla public license 2 0", "mozilla public license v 2 0")),
    ("EPL-1.0", True, ("eclipse public license version 1 0", "eclipse public license 1 0", "eclipse public license v1 0")),
    ("EPL-2.0", True, ("eclipse public license version 2 0", "eclipse public license 2 0", "eclipse public license v 2 0", "eclipse public license v2 0")),
    ("CDDL-1.0", True, ("common development and distribution license version 1 0", "common development and distribution license 1 0")),
    ("EUPL-1.2", True, ("european union public licence version 1 2", "eupl version 1 2", "european union public license version 1 2")),
    ("CECILL-2.1", True, ("cecill free software license agreement version 2 1",)),
    ("MS-PL", True, ("microsoft public license",)),
    ("MIT-0", False, ("mit no attribution", "mit no attribution license")),
    ("NCSA", False, ("university of illinois ncsa open source license", "ncsa license")),
    ("UPL-1.0", False, ("universal permissive license version 1 0", "universal permissive license v 1 0")),
    ("BlueOak-1.0.0", False, ("blue oak model license 1 0 0", "blue oak model license version 1 0 0")),
    ("MulanPSL-2.0", False, ("mulan psl v2", "mulan permissive software license version 2")),
    ("AFL-3.0", False, ("academic free license version 3 0", "academic free license 3 0")),
    ("OSL-3.0", True, ("open software license version 3 0", "open software license 3 0")),
    ("EUPL-1.1", True, ("eupl version 1 1", "european union public license version 1 1", "european union public licence version 1 1")),
    ("BUSL-1.1", True, ("business source license 1 1", "business source license version 1 1")),
    ("SSPL-1.0", True, ("server side public license version 1", "server side public license v 1")),
    ("Elastic-2.0", True, ("elastic license 2 0", "elastic license version 2 0")),
    ("CC0-1.0", False, ("cc0 1 0 universal", "creative commons zero v1 0 universal", "cc0 1 0", "cc0")),
)
#: The GNU licences: part of the identifier, name, versions.
GNU = (("GPL", "gnu general public license", ("2", "3")), ("LGPL", "gnu lesser general public license", ("2 1", "3")), ("AGPL", "gnu affero general public license", ("3",)))
#: Creative Commons elements in the identifier, in long names; versions.
CC = {"BY": "attribution", "NC": "noncommercial", "ND": "noderivatives", "SA": "sharealike"}
CC_KINDS = ("BY", "BY-SA", "BY-ND", "BY-NC", "BY-NC-SA", "BY-NC-ND")
CC_VERSIONS = ("1 0", "2 0", "2 5", "3 0", "4 0")
#: How a notice begins, in normal form; what follows is the name of a licence.
NOTICE = r"^(?:this(?: [a-z]+){1,5} (?:is|are) )?(?:licensed|released|distributed|published|provided|(?:made )?available) under (?:the terms of )?(?:the )?|^licen[sc]e (?:the )?"
#: A notice that ends in the word; what is between is the name.
LICENSED = (r"^this [a-z]+ (?:is|are) (.+) licensed$", "licensed under {0}1")
#: Sentences of licence texts and headers in normal form, and their identifiers.
TEXTS = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-notice",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-open",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd-binary",
    "all advertising materials mentioning features or use of this software must display the following acknowledgement": "bsd-advert",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-names",
    "neither the name of the organization nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-names",
    "neither the name of the author nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-names",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "ISC",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "0BSD",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": "Zlib",
    "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies": "PostgreSQL",
    "this is free and unencumbered software released into the public domain": "Unlicense",
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license": "Apache-2.0",
    "you may not use this file except in compliance with the license": "apache-file",
    "apache license version 2 0 january 2004 http www apache org licenses": "Apache-2.0",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "MPL-2.0",
    "the contents of this file are subject to the mozilla public license version 1 1 the license you may not use this file except in compliance with the license": "MPL-1.1",
    "the contents of this file are subject to the terms of the common development and distribution license the license": "CDDL-1.0",
    "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0 which accompanies this distribution and is available at http www eclipse org legal epl v10 html": "EPL-1.0",
    "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0": "EPL-2.0",
    "this program and the accompanying materials are made available under the terms of the eclipse public license v2 0 which accompanies this distribution and is available at https www eclipse org legal epl 2 0": "EPL-2.0",
    "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following": "BSL-1.0",
    "this font software is licensed under the sil open font license version 1 1": "OFL-1.1",
    "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed": "WTFPL",
    "or at your option any later version": "later",
    "gnu general public license version 2 june 1991": "GPL-2.0-only",
    "gnu general public license version 3 29 june 2007": "GPL-3.0-only",
    "gnu lesser general public license version 2 1 february 1999": "LGPL-2.1-only",
    "gnu lesser general public license version 3 29 june 2007": "LGPL-3.0-only",
    "gnu affero general public license version 3 19 november 2007": "AGPL-3.0-only",
    "this work is in the public domain": "Public-Domain",
    "this software is in the public domain": "Public-Domain",
    "all rights reserved": "All-Rights-Reserved",
}
#: Rules of several sentences, in order.
RULES = (
    ("BSD-4-Clause", ("bsd-open", "bsd-source", "bsd-binary", "bsd-advert", "bsd-names")),
    ("BSD-3-Clause", ("bsd-open", "bsd-source", "bsd-binary", "bsd-names")),
    ("BSD-2-Clause", ("bsd-open", "bsd-source", "bsd-binary")),
    ("MIT", ("mit-grant", "mit-notice")),
    ("Apache-2.0", ("Apache-2.0", "apache-file")),
)
ANCHORS = ("licen", "released", "distributed", "published", "provided", "available", "wtfpl", "permi", "redistribut", "copyright", "reserved", "domain", "later", "cc0", "unencumbered", "advertising", "eupl", "psf")


def _normal(name: str) -> str:
    return re.sub(r"[^a-z0-9]+", " ", name.lower()).strip()


def known_sentences() -> tuple[dict[str, str], tuple[tuple[str, tuple[str, ...]], ...], dict[str, bool]]:
    """Sentences with their identifiers, rules of several sentences, and the licences with whether they restrict use.

    Notices stand in one form: "licensed under" and the name."""
    named: list[tuple[str, str]] = []
    licences = {"Public-Domain": False, "All-Rights-Reserved": True}
    rules = list(RULES)
    for spdx, strict, names in LICENSES:
        licences[spdx] = strict
        named += [(n, spdx) for n in names]
    sentences = {}
    for short, name, versions in GNU:
        for v in versions:
            whole = v if " " in v else f"{v} 0"
            only, later = (f"{short}-{whole.replace(' ', '.')}-{x}" for x in ("only", "or-later"))
            licences |= {only: True, later: True}
            rules.append((later, (only, "later")))
            forms = [f"{name} version {v}", f"{name} v{v}", f"{name} {v}", f"{_normal(short)}v{v}", f"{name} version {whole}", f"{name} v{whole}"]
            named += [(f, only) for f in forms] + [(f"{f} only", only) for f in forms]
            named += [(f"{f} {x}", later) for f in forms for x in ("or later", "or any later version", "or at your option any later version")]
            sentences[f"spdx license identifier {_normal(f'{short}-{whole}')}"] = only
            named.append((_normal(f"{short}-{whole}"), only))
            of = name.removesuffix(" license")
            for thing in ("program", "library", "software", "file"):
                free = f"this {thing} is free software you can redistribute it and or modify it under the terms of the {of} license"
                sentences |= {
                    f"{free} as published by the free software foundation either version {v} of the license or at your option any later version": later,
                    f"{free} as published by the free software foundation version {v} of the license": only,
                    f"{free} version {v} as published by the free software foundation": only,
                }
    for kind, v in itertools.product(CC_KINDS, CC_VERSIONS):
        spdx = f"CC-{kind}-{v.replace(' ', '.')}"
        licences[spdx] = kind != "BY"
        long = "creative commons " + " ".join(CC[x] for x in kind.split("-"))
        named += [(f"{_normal('CC ' + kind)} {v}", spdx), *((f"{long} {v} {x}", spdx) for x in ("international license", "international", "license", "unported license"))]
    for licence in [*licences, *(r[0] for r in rules)]:
        licences.setdefault(licence, False)
        if licence not in ("Public-Domain", "All-Rights-Reserved"):
            sentences[f"spdx license identifier {_normal(licence)}"] = licence
            named.append((_normal(licence), licence))
    sentences |= {f"licensed under {name}": spdx for name, spdx in named}
    return sentences | {re.sub(NOTICE, "licensed under ", s): i for s, i in TEXTS.items()}, tuple(rules), licences


SENTENCES, RUNS, RESTRICTS = known_sentences()
UNIT, BLANKS_ = "\x1e", r"[\x20\x09-\x0D]"
#: "v. 2.0" is no end of a sentence.
VERSION = (rf"\b([vV])\.{BLANKS_}+([0-9])", "{0}1 {0}2")
LATER = (r"\b([AL]?GPL-?v?[0-9][0-9.]*)\+", "{0}1-or-later")
TAG, SPDX_ID = "SPDX-License-Identifier:", r"[A-Za-z0-9.+-]+"
#: A field of a licence's name with operators is an SPDX expression as well.
FIELD = (rf"((?:^|\n)[^A-Za-z0-9\n]*)[Ll]icen[sc]e:([ \t]*[( \t]*{SPDX_ID}[ \t)]+(?:OR|AND|WITH)[ \t(]+{SPDX_ID})", "{0}1" + TAG + "{0}2")
#: An expression after its tag; what is left out of it; where its operands part.
EXPRESSION = rf"^[ \t]*[( \t]*{SPDX_ID}(?:[ \t)]+(?:OR|AND|WITH|or|and|with)[ \t(]+{SPDX_ID})*"
WITHOUT = rf"[ \t)]+(?:WITH|with)[ \t(]+{SPDX_ID}|\+"
BETWEEN = r"[ \t)]+(?:OR|AND|or|and)[ \t(]+"
BREAKS = rf":{BLANKS_}*\n|:{BLANKS_}+\(?[0-9a-e]{{1,2}}[.)]{BLANKS_}|\n[^A-Za-z0-9\n]*\n|\n[^A-Za-z0-9\n]*\(?(?:[0-9]{{1,2}}|[a-e])\){BLANKS_}|[.!?]{BLANKS_}+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def expressions_apart(text: Column) -> Column:
    """The text, with each operand of its SPDX expressions in a sentence with a tag of its own."""
    tag = UNIT + TAG + " "

    def one(p: Column) -> Column:
        head = F.regexp_extract(p, EXPRESSION, 0)
        operands = F.regexp_replace(F.regexp_replace(head, WITHOUT, ""), BETWEEN, tag)
        return F.concat(F.lit(tag), operands, F.substring(p, F.length(head) + 1, F.length(p)))

    parts = lambda ps: F.concat(F.get(ps, 0), F.array_join(F.transform(F.slice(ps, F.lit(2), F.size(ps)), one), ""))
    return F.when(F.contains(text, F.lit(TAG)), bound(F.split(text, TAG), parts)).otherwise(text)


def sentence_ids(text: Column) -> Column:
    """Identifiers of the known sentences of a text, in order."""
    cut = F.regexp_replace(text, VERSION[0], VERSION[1].format("$"))
    cut = F.regexp_replace(cut, LATER[0], LATER[1].format("$"))
    cut = expressions_apart(F.regexp_replace(cut, FIELD[0], FIELD[1].format("$")))
    cut = F.regexp_replace(cut, BREAKS, UNIT)
    low = F.regexp_replace(F.translate(cut, UPPER, LOWER), rf"[^a-z0-9\n{UNIT}]+", " ")
    low = F.replace(F.replace(low, F.lit(" \n"), F.lit("\n")), F.lit("\n "), F.lit("\n"))
    known = lambda s: s.isin(*SENTENCES)
    plain = lambda s: F.regexp_replace(F.regexp_replace(F.trim(s), LICENSED[0], LICENSED[1].format("$")), NOTICE, "licensed under ")
    lines = lambda u: F.filter(F.transform(F.split(u, "\n"), plain), known)
    found = F.flatten(F.transform(F.split(low, UNIT), lambda u: bound(plain(F.translate(u, "\n", " ")), lambda s: F.when(known(s), F.array(s)).otherwise(lines(u)))))
    table = F.from_json(F.lit(json.dumps(SENTENCES)), "map<string,string>")
    ids = F.transform(found, lambda s: F.element_at(table, s))
    low_all = F.lower(text)
    hint = F.lit(False)
    for a in ANCHORS:
        hint |= F.contains(low_all, F.lit(a))
    return F.when(hint, ids).otherwise(F.array().cast("array<string>"))


def licenses(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_sentences known, sentence_ids in order, licenses (comma-joined) and restricted of every row."""
    d = docs.select(docs[id_column], sentence_ids(F.coalesce(docs[text], F.lit(""))).alias("__ids"))
    # each identifier stands between its own bars, so that neighbouring matches do not share one
    d = d.withColumn("__run", F.array_join(F.transform("__ids", lambda x: F.concat(F.lit("|"), x, F.lit("|"))), ""))
    said = []
    for n, (name, run) in enumerate(RUNS):
        pattern = F.lit("".join(f"|{i}|" for i in run))
        d = d.withColumn(f"__r{n}", F.contains("__run", pattern)).withColumn("__run", F.replace("__run", pattern, F.lit("#")))
        said.append(F.when(F.col(f"__r{n}"), F.lit(name)))
    alone = F.filter(F.split("__run", r"[|#]+"), lambda x: x.isin(*RESTRICTS))
    names = F.array_distinct(F.concat(F.array_compact(F.array(*said)), alone))
    d = d.withColumn("__names", names)
    strict = F.exists("__names", lambda x: x.isin(*[k for k, v in RESTRICTS.items() if v]))
    return d.select(id_column, F.size("__ids").cast("long").alias("n_sentences"), F.array_join("__ids", ",").alias("sentence_ids"), F.array_join("__names", ",").alias("licenses"), strict.alias("restricted"))


def _oracle() -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    table = ", ".join(f"({q(s)}, {q(i)})" for s, i in SENTENCES.items())
    steps, last = [], "b"
    for n, (_, run) in enumerate(RUNS):
        p = "".join(f"|{i}|" for i in run)
        steps.append(f"q{n} as (select * exclude (run), contains(run, '{p}') r{n}, replace(run, '{p}', '#') run from {last})")
        last = f"q{n}"
    whole = ", ".join(f"case when r{n} then '{name}' end" for n, (name, _) in enumerate(RUNS))
    names = ", ".join(map(q, RESTRICTS))
    strict = ", ".join(q(k) for k, v in RESTRICTS.items() if v)
    unit = r"\x1e"
    bs = chr(92)
    cut = "coalesce(text, '')"
    for pattern, by in (VERSION, LATER, FIELD):
        cut = f"regexp_replace({cut}, {q(pattern)}, {q(by.format(bs))}, 'g')"
    tag = f"chr(30) || {q(TAG + ' ')}"
    operands = f"regexp_replace(regexp_replace(regexp_extract(p, {q(EXPRESSION)}), {q(WITHOUT)}, '', 'g'), {q(BETWEEN)}, {tag}, 'g')"
    cut = f"array_to_string(list_transform(string_split({cut}, {q(TAG)}), lambda p, i: case when i = 1 then p else {tag} || {operands} || substr(p, length(regexp_extract(p, {q(EXPRESSION)})) + 1) end), '')"
    plain = lambda x: f"regexp_replace(regexp_replace(trim({x}), {q(LICENSED[0])}, {q(LICENSED[1].format(bs))}), {q(NOTICE)}, 'licensed under ')"
    cut = f"regexp_replace({cut}, {q(BREAKS)}, chr(30), 'g')"
    low = f"replace(replace(regexp_replace(translate({cut}, '{UPPER}', '{LOWER}'), '[^a-z0-9\\n{unit}]+', ' ', 'g'), ' ' || chr(10), chr(10)), chr(10) || ' ', chr(10))"
    return f"""with k as (select * from (values {table}) t(s, id)), m as (select list(s) s from k),
      a as (select row_number() over () rid, doc_id, string_split({low}, chr(30)) u from documents),
      w as (select rid, i, u[i] u, {plain("replace(u[i], chr(10), ' ')")} s from (select rid, u, unnest(range(1, len(u) + 1)) i from a)),
      f as (select w.rid, w.i, 0 j, k.id from w join k on w.s = k.s
        union all select l.rid, l.i, l.j, k.id from (select rid, i, unnest(range(1, len(string_split(u, chr(10))) + 1)) j, u from w where s not in (select s from k)) l join k on {plain("string_split(l.u, chr(10))[l.j]")} = k.s),
      g as (select rid, list(id order by i, j) ids from f group by rid),
      b as (select doc_id, coalesce(ids, []) ids, coalesce(array_to_string(list_transform(ids, lambda x: '|' || x || '|'), ''), '') run from a left join g on a.rid = g.rid),
      {", ".join(steps)},
      n as (select doc_id, ids, list_filter([{whole}], lambda x: x is not null) || list_filter(regexp_split_to_array(run, '[|#]+'), lambda x: x in ({names})) n from {last}),
      d as (select doc_id, ids, list_filter(n, lambda x, i: list_position(n, x) = i) n from n)
      select doc_id, len(ids)::bigint n_sentences, array_to_string(ids, ',') sentence_ids, array_to_string(n, ',') licenses,
        len(list_filter(n, lambda x: x in ({strict}))) > 0 restricted from d"""


ORACLE_SQL = _oracle()
