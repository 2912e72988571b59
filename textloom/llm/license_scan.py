"""License scans by sentence rules, in DataFrame functions only.

Texts are cut into sentences, sentences normalised to lower-case words, and those that are known license sentences
become identifiers. A known sentence that would be cut inside is known by its pieces, which must follow each other.
Marks at line starts, as those of comments, don't count. A rule is a sequence of identifiers; rules are tried in order, longest first, on the sequence of
a document's identifiers. A rule that matches claims its sentences, so a later rule doesn't report them again.

Only texts that hold a trigger are cut; each known sentence holds one, so none is missed.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Known license sentences by identifier.
SENTENCES = {
    "apache2-ref": "Licensed under the Apache License, Version 2.0.",
    "apache2-long": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    "apache2-asf": "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements.",
    "apache2-notice": "See the NOTICE file distributed with this work for additional information regarding copyright ownership.",
    "apache2-asf-grant": "The ASF licenses this file to you under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    "apache2-obtain": "You may obtain a copy of the License at",
    "apache2-warranty": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "apache2-limits": "See the License for the specific language governing permissions and limitations under the License.",
    "mit-ref": "Released under the MIT License.",
    "mit-ref2": "Licensed under the MIT License.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit0-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.",
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "json-good": "The Software shall be used for Good, not Evil.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "isc-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    "0bsd-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "bsd-redistribute": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-advertising": "All advertising materials mentioning features or use of this software must display the following acknowledgement:",
    "bsd-names": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "gpl2-grant": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl3-ref": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-grant": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "gpl-details": "See the GNU General Public License for more details.",
    "gpl-copy": "You should have received a copy of the GNU General Public License along with this program.",
    "agpl3-grant": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "agpl-details": "See the GNU Affero General Public License for more details.",
    "lgpl21-grant": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "lgpl3-grant": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "lgpl-warranty": "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "lgpl-details": "See the GNU Lesser General Public License for more details.",
    "gfdl-grant": "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.3 or any later version published by the Free Software Foundation; with no Invariant Sections, no Front-Cover Texts, and no Back-Cover Texts.",
    "gfdl-copy": "A copy of the license is included in the section entitled \"GNU Free Documentation License\".",
    "mpl2-subject": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "mpl2-obtain": "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "mpl2-obtain-http": "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "mpl11-subject": "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\"); you may not use this file except in compliance with the License.",
    "cddl-subject": "The contents of this file are subject to the terms of the Common Development and Distribution License (the \"License\").",
    "cddl-comply": "You may not use this file except in compliance with the License.",
    "epl1": "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html",
    "epl2": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "zlib-warranty": "This software is provided 'as-is', without any express or implied warranty.",
    "zlib-liability": "In no event will the authors be held liable for any damages arising from the use of this software.",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "boost-header": "Distributed under the Boost Software License, Version 1.0.",
    "unlicense-domain": "This is free and unencumbered software released into the public domain.",
    "unlicense-anyone": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "cc0-dedicated": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide.",
    "cc0-warranty": "This software is distributed without any warranty.",
    "wtfpl-grant": "You can redistribute it and/or modify it under the terms of the Do What The Fuck You Want To Public License, Version 2, as published by Sam Hocevar.",
    "beerware": "As long as you retain this notice you can do whatever you want with this stuff.",
    "perl": "This library is free software; you can redistribute it and/or modify it under the same terms as Perl itself.",
    "postgresql-grant": "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies.",
    "hpnd-grant": "Permission to use, copy, modify, and distribute this software and its documentation for any purpose and without fee is hereby granted, provided that the above copyright notice appear in all copies and that both that copyright notice and this permission notice appear in supporting documentation.",
    "psf": "Licensed to PSF under a Contributor Agreement.",
    "ofl-subject": "This Font Software is licensed under the SIL Open Font License, Version 1.1.",
    "eupl": "Licensed under the EUPL.",
    "mspl-governs": "This license governs use of the accompanying software.",
    "mspl-accept": "If you use the software, you accept this license.",
    "mspl-reject": "If you do not accept the license, do not use the software.",
    "elastic2": "Licensed under the Elastic License 2.0; you may not use this file except in compliance with the Elastic License 2.0.",
    "cc-by-nc4": "Licensed under CC BY-NC 4.0.",
    "cc-by4": "Licensed under CC BY 4.0.",
    "cc-by-sa4": "Licensed under CC BY-SA 4.0.",
    "cc-by-nd4": "Licensed under CC BY-ND 4.0.",
    "cc-by-nc-sa4": "Licensed under CC BY-NC-SA 4.0.",
    "cc-by3-work": "This work is licensed under a Creative Commons Attribution 3.0 Unported License.",
    "cc-by4-work": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa4-work": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc-by-nc4-work": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "cc-by-nd4-work": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "cc-by-nc-sa4-work": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "cc-by-nc-nd4-work": "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
    "all-rights": "All rights reserved, no license is granted.",
}
#: Other wordings of known sentences, by identifier.
VARIANTS = (
    ("mit-notice", "The above copyright notice and this permission notice (including the next paragraph) shall be included in all copies or substantial portions of the Software."),
    ("mit-notice", "The above copyright notice and this permission notice shall be included in all copies of the Software."),
    ("mit-notice", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of this Software."),
    ("mit-notice", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software and its documentation."),
    ("mit-warranty", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NONINFRINGEMENT."),
    ("bsd-names", "Neither the names of the copyright holders nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("bsd-names", "Neither the name of the copyright holders nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
)
#: Unknown sentences that may stand between two sentences of a rule at most, as lines of copyright or addresses do.
MOST_SKIPPED = 8
#: Rules in order, as (rule, license, sequence of sentences).
RULES = (
    ("apache-2.0-asf-header", "Apache-2.0", ("apache2-asf", "apache2-notice", "apache2-asf-grant", "apache2-obtain", "apache2-warranty", "apache2-limits")),
    ("apache-2.0-full-header", "Apache-2.0", ("apache2-long", "apache2-obtain", "apache2-warranty", "apache2-limits")),
    ("bsd-4-clause-text", "BSD-4-Clause", ("bsd-redistribute", "bsd-source", "bsd-binary", "bsd-advertising", "bsd-names")),
    ("bsd-3-clause-text", "BSD-3-Clause", ("bsd-redistribute", "bsd-source", "bsd-binary", "bsd-names")),
    ("json-text", "JSON", ("mit-grant", "mit-notice", "json-good", "mit-warranty")),
    ("gpl-2.0-full-header", "GPL-2.0-or-later", ("gpl2-grant", "gpl-warranty", "gpl-details", "gpl-copy")),
    ("gpl-3.0-full-header", "GPL-3.0-or-later", ("gpl-grant", "gpl-warranty", "gpl-details", "gpl-copy")),
    ("apache-2.0-header", "Apache-2.0", ("apache2-long", "apache2-obtain", "apache2-warranty")),
    ("bsd-2-clause-text", "BSD-2-Clause", ("bsd-redistribute", "bsd-source", "bsd-binary")),
    ("mit-full-text", "MIT", ("mit-grant", "mit-notice", "mit-warranty")),
    ("agpl-3.0-header", "AGPL-3.0-or-later", ("agpl3-grant", "gpl-warranty", "agpl-details")),
    ("lgpl-2.1-full-header", "LGPL-2.1-or-later", ("lgpl21-grant", "lgpl-warranty", "lgpl-details")),
    ("lgpl-3.0-full-header", "LGPL-3.0-or-later", ("lgpl3-grant", "lgpl-warranty", "lgpl-details")),
    ("zlib-text", "Zlib", ("zlib-warranty", "zlib-liability", "zlib-grant")),
    ("ms-pl-text", "MS-PL", ("mspl-governs", "mspl-accept", "mspl-reject")),
    ("mit-text", "MIT", ("mit-grant", "mit-notice")),
    ("mit-0-text", "MIT-0", ("mit0-grant", "mit-warranty")),
    ("mit-terms", "MIT", ("mit-grant", "mit-warranty")),
    ("isc-text", "ISC", ("isc-grant", "isc-warranty")),
    ("0bsd-text", "0BSD", ("0bsd-grant", "isc-warranty")),
    ("gpl-3.0-header", "GPL-3.0-or-later", ("gpl-grant", "gpl-warranty")),
    ("gpl-2.0-header", "GPL-2.0-or-later", ("gpl2-grant", "gpl-warranty")),
    ("lgpl-2.1-header", "LGPL-2.1-or-later", ("lgpl21-grant", "lgpl-warranty")),
    ("mpl-2.0-header", "MPL-2.0", ("mpl2-subject", "mpl2-obtain")),
    ("mpl-2.0-header-http", "MPL-2.0", ("mpl2-subject", "mpl2-obtain-http")),
    ("cddl-1.0-header", "CDDL-1.0", ("cddl-subject", "cddl-comply")),
    ("gfdl-1.3-notice", "GFDL-1.3-or-later", ("gfdl-grant", "gfdl-copy")),
    ("unlicense-text", "Unlicense", ("unlicense-domain", "unlicense-anyone")),
    ("cc0-1.0-notice", "CC0-1.0", ("cc0-dedicated", "cc0-warranty")),
    ("apache-2.0-notice", "Apache-2.0", ("apache2-long",)),
    ("apache-2.0-asf-notice", "Apache-2.0", ("apache2-asf-grant",)),
    ("gpl-3.0-grant", "GPL-3.0-or-later", ("gpl-grant",)),
    ("gpl-2.0-grant", "GPL-2.0-or-later", ("gpl2-grant",)),
    ("agpl-3.0-grant", "AGPL-3.0-or-later", ("agpl3-grant",)),
    ("lgpl-2.1-grant", "LGPL-2.1-or-later", ("lgpl21-grant",)),
    ("lgpl-3.0-grant", "LGPL-3.0-or-later", ("lgpl3-grant",)),
    ("mit-grant", "MIT", ("mit-grant",)),
    ("mit-0-grant", "MIT-0", ("mit0-grant",)),
    ("isc-grant", "ISC", ("isc-grant",)),
    ("0bsd-grant", "0BSD", ("0bsd-grant",)),
    ("bsd-conditions", "BSD", ("bsd-redistribute",)),
    ("mpl-2.0-notice", "MPL-2.0", ("mpl2-subject",)),
    ("mpl-1.1-notice", "MPL-1.1", ("mpl11-subject",)),
    ("cddl-1.0-notice", "CDDL-1.0", ("cddl-subject",)),
    ("epl-1.0-notice", "EPL-1.0", ("epl1",)),
    ("epl-2.0-notice", "EPL-2.0", ("epl2",)),
    ("zlib-grant", "Zlib", ("zlib-grant",)),
    ("bsl-1.0-notice", "BSL-1.0", ("boost-header",)),
    ("unlicense-notice", "Unlicense", ("unlicense-domain",)),
    ("cc0-1.0-dedication", "CC0-1.0", ("cc0-dedicated",)),
    ("wtfpl-grant", "WTFPL", ("wtfpl-grant",)),
    ("beerware-notice", "Beerware", ("beerware",)),
    ("perl-terms", "Artistic-1.0-Perl OR GPL-1.0-or-later", ("perl",)),
    ("postgresql-grant", "PostgreSQL", ("postgresql-grant",)),
    ("hpnd-grant", "HPND", ("hpnd-grant",)),
    ("psf-notice", "PSF-2.0", ("psf",)),
    ("ofl-1.1-notice", "OFL-1.1", ("ofl-subject",)),
    ("eupl-reference", "EUPL-1.2", ("eupl",)),
    ("gfdl-1.3-grant", "GFDL-1.3-or-later", ("gfdl-grant",)),
    ("elastic-2.0-notice", "Elastic-2.0", ("elastic2",)),
    ("apache-2.0-reference", "Apache-2.0", ("apache2-ref",)),
    ("mit-reference", "MIT", ("mit-ref",)),
    ("mit-reference-2", "MIT", ("mit-ref2",)),
    ("gpl-3.0-reference", "GPL-3.0-only", ("gpl3-ref",)),
    ("cc-by-nc-4.0-reference", "CC-BY-NC-4.0", ("cc-by-nc4",)),
    ("cc-by-sa-4.0-reference", "CC-BY-SA-4.0", ("cc-by-sa4",)),
    ("cc-by-4.0-reference", "CC-BY-4.0", ("cc-by4",)),
    ("cc-by-nd-4.0-reference", "CC-BY-ND-4.0", ("cc-by-nd4",)),
    ("cc-by-nc-sa-4.0-reference", "CC-BY-NC-SA-4.0", ("cc-by-nc-sa4",)),
    ("cc-by-3.0-work", "CC-BY-3.0", ("cc-by3-work",)),
    ("cc-by-4.0-work", "CC-BY-4.0", ("cc-by4-work",)),
    ("cc-by-sa-4.0-work", "CC-BY-SA-4.0", ("cc-by-sa4-work",)),
    ("cc-by-nc-4.0-work", "CC-BY-NC-4.0", ("cc-by-nc4-work",)),
    ("cc-by-nd-4.0-work", "CC-BY-ND-4.0", ("cc-by-nd4-work",)),
    ("cc-by-nc-sa-4.0-work", "CC-BY-NC-SA-4.0", ("cc-by-nc-sa4-work",)),
    ("cc-by-nc-nd-4.0-work", "CC-BY-NC-ND-4.0", ("cc-by-nc-nd4-work",)),
    ("all-rights-reserved", "proprietary", ("all-rights",)),
)
#: Each known sentence holds one of these, whatever its case and however it is wrapped.
TRIGGER = r"(?i)licen[cs]e|warrant|copyright|redistribut|permission|acknowledgement|mozilla|liable|unencumbered|compiled|notice|evil|eupl|psf|CC BY"
_MARK = "\u0001"
#: The first three words of known sentences, before which a line's end ends a sentence.
_STARTERS = sorted({" ".join(s.split()[:3]).rstrip(".,;") for s in SENTENCES.values()}, key=lambda x: (-len(x), x))


#: Marks at a line's start: # // * -- ; > <!-- and whatever else has no letter, digit or end of a sentence; a batch file's ::.
_LEADING = r"(?md)^(?:::)?[^\p{L}\p{N}\n.!?:]+"
#: An end of a sentence, and the quotes or comment's end that close it.
_END = r"""([.!?:][*/>)\]}"'-]*)[ \t\n\x0B\f\r]+"""


_STARTS = "|".join(map(re.escape, _STARTERS))


def normalised(sentence: str) -> str:
    return re.sub("[^a-z0-9]+", " ", sentence.lower()).strip()


def sentences_of(text: Column) -> Column:
    """Sentences end at . ! ? : before white space, at blank lines, and at line ends before three words that start a known one; marks at line starts are left out."""
    text = F.regexp_replace(F.regexp_replace(text, _LEADING, ""), _END, "$1" + _MARK)
    text = F.regexp_replace(text, r"\n[ \t\r]*\n", _MARK)
    return F.split(F.regexp_replace(text, rf"\n[ \t]*({_STARTS})", _MARK + "$1"), _MARK)


def _pieces() -> tuple[dict[str, str], list[tuple[str, str]]]:
    """Identifiers of the normalised pieces that texts are cut into, and (identifier, run of pieces) of the sentences that are cut inside.

    A sentence that isn't cut is a piece with its own identifier; pieces of others are numbered, as some share one.
    """
    cut = [(k, [normalised(p) for p in re.split(_END.replace("(", "(?:", 1), s)]) for k, s in [*SENTENCES.items(), *VARIANTS]]
    known = {p[0]: f"<{k}>" for k, p in cut if len(p) == 1}
    for _, pieces in cut:
        for p in pieces if len(pieces) > 1 else ():
            known.setdefault(p, f"<{len(known)}>")
    return known, [(f"<{k}>", "".join(known[p] for p in pieces)) for k, pieces in cut if len(pieces) > 1]


#: Pieces of no sentence are unknown; runs of too many unknown sentences are a bar, others nothing.
_GAPS = ((r"<\d+>", "|"), (rf"\|{{{MOST_SKIPPED + 1},}}", "!"), (r"\|", ""))


def scan_licenses(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, rule, license, matches): a row for each document and rule that matches, matches being how often.

    Between two sentences of a rule up to MOST_SKIPPED others may stand.

    Null and empty texts have none. Rows of one id, null included, are scanned and reported each for itself; other
    columns aren't carried; an empty table gives an empty result.
    """
    id_, text = F.col(f"`{id_column}`").alias("id"), F.col(f"`{text_column}`")
    pieces, cut = _pieces()
    known = F.create_map(*(F.lit(x) for pair in pieces.items() for x in pair))
    plain = F.transform(sentences_of(text), lambda s: F.trim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", " ")))
    # other sentences are bars, until pieces side by side have become their sentence
    ids = F.array_join(F.transform(plain, lambda s: F.when(s == "", "").otherwise(F.coalesce(F.try_element_at(known, s), F.lit("|")))), "")
    for sentence, run in cut:
        ids = F.replace(ids, F.lit(run), F.lit(sentence))
    # a few other sentences don't part a rule's, more do
    for found, instead in _GAPS:
        ids = F.regexp_replace(ids, found, instead)
    rows = docs.filter(text.rlike(TRIGGER)).select(id_, ids.alias("ids")).filter(F.contains("ids", F.lit("<")))

    rules = F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(lic).alias("license"), F.lit("".join(f"<{k}>" for k in seq)).alias("seq")) for r, lic, seq in RULES))
    found = "array<struct<rule:string,license:string,matches:bigint>>"

    def claim(s: Column, r: Column) -> Column:
        left = F.replace(s["ids"], r["seq"], F.lit("#"))
        times = ((F.length(s["ids"]) - F.length(left)) / (F.length(r["seq"]) - 1)).cast("long")
        hit = F.array(F.struct(r["rule"].alias("rule"), r["license"].alias("license"), times.alias("matches")))
        return F.when(F.contains(s["ids"], r["seq"]), F.struct(left.alias("ids"), F.concat(s["found"], hit).alias("found"))).otherwise(s)

    rows = rows.select("id", F.aggregate(rules, F.struct(F.col("ids"), F.array().cast(found).alias("found")), claim)["found"].alias("found"))
    return rows.select("id", F.explode("found").alias("f")).select(F.col("id").alias(id_column), "f.rule", "f.license", "f.matches")


def oracle_sql() -> str:
    """DuckDB SQL for scan_licenses over documents."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    pieces, cut = _pieces()
    keys, values = ", ".join(map(quote, pieces)), ", ".join(map(quote, pieces.values()))
    text = f"regexp_replace(regexp_replace(text, {quote(_LEADING.replace('(?md)', '(?m)'))}, '', 'g'), {quote(_END)}, '\\1' || chr(1), 'g')"
    text = f"regexp_replace(regexp_replace({text}, '\\n[ \\t\\r]*\\n', chr(1), 'g'), {quote(rf'\n[ \t]*({_STARTS})')}, chr(1) || '\\1', 'g')"
    plain = "trim(regexp_replace(lower(x), '[^a-z0-9]+', ' ', 'g'))"
    ids = f"array_to_string(list_transform(s, lambda x: CASE WHEN {plain} = '' THEN '' ELSE coalesce(map([{keys}], [{values}])[{plain}], '|') END), '')"
    for sentence, run in cut:
        ids = f"replace({ids}, '{run}', '{sentence}')"
    for found, instead in _GAPS:
        ids = f"regexp_replace({ids}, {quote(found)}, '{instead}', 'g')"
    sql = f"""WITH cut AS (SELECT doc_id, string_split({text}, chr(1)) AS s FROM documents WHERE regexp_matches(text, '{TRIGGER}')),
    r0 AS MATERIALIZED (SELECT row_number() OVER () AS k, doc_id, {ids} AS ids FROM cut)"""
    for i, (_, _, seq) in enumerate(RULES):
        sql += f",\n    r{i + 1} AS MATERIALIZED (SELECT k, doc_id, replace(ids, {quote(''.join(f'<{k}>' for k in seq))}, '#') AS ids FROM r{i})"
    parts = [f"SELECT a.doc_id, {quote(r)} AS rule, {quote(lic)} AS license, CAST((length(a.ids) - length(b.ids)) / {len(''.join(f'<{k}>' for k in seq)) - 1} AS BIGINT) AS matches FROM r{i} a JOIN r{i + 1} b USING (k) WHERE a.ids <> b.ids" for i, (r, lic, seq) in enumerate(RULES)]
    return sql + "\n    " + "\n    UNION ALL ".join(parts)
