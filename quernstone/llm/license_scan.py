"""Licence recognition by sentence rules, in DataFrame functions only.

A text is cut into sentences (after . ! ? ; : before white space, at lines without
letters and digits, and after list marks such as "(a)" or "2)" that begin a line)
and these into lines; each line is normalised (lower case, every run of other
characters than letters and digits one space).  A licence sentence is a run of
consecutive lines of one sentence that, joined by spaces, is an entry of a table of
licence sentences: wrapped texts count, and so do notices on a line of their own.
Runs are taken from the left, the longest first, and do not overlap.
The identifiers found, in order, form the document's sequence; the ordered rules
are runs of identifiers.  The first rule that occurs is taken out of the sequence
wherever it stands before the next is tried, so a licence's whole text is not
reported again as its parts.

Only documents that hold one of the sentences' anchor words are cut up, which
loses nothing: every rule holds one.  There is one pass and no shuffle; the
tables are literals of the plan.  Null and empty texts hold no licence; repeated rows
and rows without an id each get theirs; very long texts are read whole.  Of licences
whose sentences could be read two ways (ties), the longer sentence and the earlier
rule win.  Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Sentences of public licences and their customary notices, by identifier.
SENTENCES = {
    "mit_name": "The MIT License",
    "mit_name_plain": "MIT License",
    "mit_notice": "Released under the MIT License.",
    "mit_licensed": "Licensed under the MIT License.",
    "mit_project": "This project is licensed under the MIT License.",
    "mit_grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit_condition": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "apache_name": "Apache License Version 2.0, January 2004",
    "apache_notice": "Licensed under the Apache License, Version 2.0.",
    "apache_header": "Licensed under the Apache License, Version 2.0 (the \"License\");",
    "apache_comply": "you may not use this file except in compliance with the License.",
    "apache_copy": "You may obtain a copy of the License at",
    "apache_warranty": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "gpl2_notice": "This work is licensed under the GNU General Public License, version 2.",
    "gpl3_notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl_free": "This program is free software;",
    "library_free": "This library is free software;",
    "gpl1_later": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 1, or (at your option) any later version.",
    "gpl2_later": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl3_later": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl2_only": "you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
    "gpl2_only_old": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; version 2 of the License.",
    "gpl3_only": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 3 of the License.",
    "lgpl2_later": "you can redistribute it and/or modify it under the terms of the GNU Library General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "lgpl21_later": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "lgpl3_later": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "agpl3_later": "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl_warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;",
    "library_warranty": "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;",
    "gpl_copy": "You should have received a copy of the GNU General Public License along with this program.",
    "gpl_copy_see": "You should have received a copy of the GNU General Public License along with this program; if not, see",
    "bsd_grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd_source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd_binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd_names": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "isc_grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "bsd0_grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "mpl2_notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "mpl11_notice": "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\");",
    "zlib_grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "boost_grant": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:",
    "boost_notice": "Distributed under the Boost Software License, Version 1.0.",
    "unlicense_public": "This is free and unencumbered software released into the public domain.",
    "unlicense_free": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "epl2_notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at",
    "cc_by_notice": "Licensed under CC BY 4.0.",
    "cc_by_sa_notice": "Licensed under CC BY-SA 4.0.",
    "cc_by_nc_notice": "Licensed under CC BY-NC 4.0.",
    "cc0_notice": "Licensed under CC0 1.0.",
    "cc_by_work": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc_by_sa_work": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
}
# Ordered rules: the licence and its run of sentences, longer runs before their parts.
RULES = [
    ("MIT", ("mit_name", "mit_grant", "mit_condition")),
    ("MIT", ("mit_name_plain", "mit_grant", "mit_condition")),
    ("MIT", ("mit_grant", "mit_condition")),
    ("BSD-3-Clause", ("bsd_grant", "bsd_source", "bsd_binary", "bsd_names")),
    ("BSD-2-Clause", ("bsd_grant", "bsd_source", "bsd_binary")),
    ("Apache-2.0", ("apache_header", "apache_comply", "apache_copy", "apache_warranty")),
    ("MPL-1.1", ("mpl11_notice", "apache_comply", "apache_copy")),
    ("MPL-1.1", ("mpl11_notice", "apache_comply")),
    ("Apache-2.0", ("apache_header", "apache_comply", "apache_copy")),
    ("Apache-2.0", ("apache_header", "apache_comply")),
    ("Apache-2.0", ("apache_name",)),
    ("GPL-1.0-or-later", ("gpl_free", "gpl1_later")),
    ("GPL-2.0-or-later", ("gpl_free", "gpl2_later", "gpl_warranty", "gpl_copy")),
    ("GPL-2.0-or-later", ("gpl_free", "gpl2_later", "gpl_warranty", "gpl_copy_see")),
    ("GPL-2.0-or-later", ("gpl_free", "gpl2_later", "gpl_warranty")),
    ("GPL-2.0-or-later", ("gpl_free", "gpl2_later")),
    ("GPL-3.0-or-later", ("gpl_free", "gpl3_later", "gpl_warranty", "gpl_copy")),
    ("GPL-3.0-or-later", ("gpl_free", "gpl3_later", "gpl_warranty")),
    ("GPL-3.0-or-later", ("gpl_free", "gpl3_later")),
    ("GPL-2.0-only", ("gpl_free", "gpl2_only", "gpl_warranty", "gpl_copy")),
    ("GPL-2.0-only", ("gpl_free", "gpl2_only")),
    ("GPL-2.0-only", ("gpl_free", "gpl2_only_old")),
    ("GPL-3.0-only", ("gpl_free", "gpl3_only")),
    ("LGPL-2.0-or-later", ("library_free", "lgpl2_later")),
    ("LGPL-2.1-or-later", ("library_free", "lgpl21_later")),
    ("LGPL-3.0-or-later", ("gpl_free", "lgpl3_later")),
    ("AGPL-3.0-or-later", ("gpl_free", "agpl3_later")),
    ("GPL-family", ("gpl_warranty", "gpl_copy")),
    ("ISC", ("isc_grant",)),
    ("0BSD", ("bsd0_grant",)),
    ("MPL-1.1", ("mpl11_notice",)),
    ("MPL-2.0", ("mpl2_notice",)),
    ("Zlib", ("zlib_grant",)),
    ("BSL-1.0", ("boost_grant",)),
    ("BSL-1.0", ("boost_notice",)),
    ("Unlicense", ("unlicense_public", "unlicense_free")),
    ("Unlicense", ("unlicense_public",)),
    ("EPL-2.0", ("epl2_notice",)),
    ("MIT", ("mit_project",)),
    ("MIT", ("mit_notice",)),
    ("MIT", ("mit_licensed",)),
    ("MIT", ("mit_name",)),
    ("MIT", ("mit_name_plain",)),
    ("Apache-2.0", ("apache_notice",)),
    ("GPL-2.0", ("gpl2_notice",)),
    ("GPL-3.0", ("gpl3_notice",)),
    ("CC-BY-4.0", ("cc_by_notice",)),
    ("CC-BY-SA-4.0", ("cc_by_sa_notice",)),
    ("CC-BY-NC-4.0", ("cc_by_nc_notice",)),
    ("CC0-1.0", ("cc0_notice",)),
    ("CC-BY-4.0", ("cc_by_work",)),
    ("CC-BY-SA-4.0", ("cc_by_sa_work",)),
]
ANCHORS = ("licen", "permission", "redistribut", "warrant", "copyright", "unencumbered")
CUT = r"([.!?;:])[ \t\r\n]+"
MARK = r"(?<![^\n|])[^a-z0-9\n|]*(?:[0-9]{1,2}|[a-z])[)][ \t]+"
# Points and marks that end no sentence: "v. 2.0" and the two places in the GNU notices.
KEEP = [(r"([ \t\n,(]v)[.]([ \t\r\n])", "$1 $2"), (r"(software[^a-z0-9]+foundation);([ \t\r\n][^a-z0-9]*(?:either[^a-z0-9]+)?version)", "$1 $2"), (r"(this[^a-z0-9]+program);([ \t\r\n][^a-z0-9]*if[^a-z0-9]+not)", "$1 $2")]


def normalised(text: str) -> str:
    return " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split())


def sentence_table() -> dict[str, str]:
    """Normalised sentence -> identifier."""
    out: dict[str, str] = {}
    for name, text in SENTENCES.items():
        text = text.lower()
        for pattern, to in KEEP:
            text = re.sub(pattern, to.replace("$", "\\"), text)
        parts = [p for p in map(normalised, re.sub(CUT, r"\1\n", text).split("\n")) if p]
        if len(parts) != 1:
            raise ValueError(f"{name} is not one sentence")
        if parts[0] in out:
            raise ValueError(f"{name} repeats {out[parts[0]]}")
        out[parts[0]] = name
    held = {name for text, name in out.items() if any(a in text for a in ANCHORS)}
    if not all(held & set(run) for _, run in RULES):
        raise ValueError("a rule without an anchor word")
    return out


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sentences: dict[str, str] | None = None, rules: list[tuple[str, tuple[str, ...]]] | None = None) -> DataFrame:
    """One row a document and licence: doc_id, license, n_matches (runs of its rules), n_sentences (licence sentences of the document)."""
    table, rules = sentences or sentence_table(), rules or RULES
    text = F.lower(F.col(text_col).cast("string"))
    some = None
    for a in ANCHORS:
        some = F.contains(text, F.lit(a)) if some is None else some | F.contains(text, F.lit(a))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).filter(some)
    known = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    # | ends a sentence, a line end stays one.
    cut = F.translate("text", "|", "-")
    for pattern, to in KEEP:
        cut = F.regexp_replace(cut, pattern, to)
    cut = F.regexp_replace(cut, CUT, "|")
    cut = F.regexp_replace(F.regexp_replace(cut, r"\n[^a-z0-9|]*\n", "|"), MARK, "|")
    lines = F.trim(F.regexp_replace(F.regexp_replace(cut, r"[^a-z0-9\n|]+", " "), r" *([\n|]) *", "$1"))
    longest = sorted(table, key=lambda t: (-len(t), t))
    one_of = "|".join(r"[ \n]".join(map(re.escape, t.split(" "))) for t in longest)
    runs = F.regexp_extract_all(lines, F.lit(rf"(?<![^\n|])(?:{one_of})(?![^\n|])"), F.lit(0))
    names = F.transform(runs, lambda s: F.try_element_at(known, F.replace(s, F.lit("\n"), F.lit(" "))))
    found = rows.select("doc_id", F.filter(names, lambda x: x.isNotNull()).alias("ids")).filter(F.size("ids") > 0)
    state = found.select("doc_id", F.size("ids").cast("long").alias("n_sentences"), F.array_join(F.transform("ids", lambda x: F.concat(F.lit("<"), x, F.lit(">"))), "").alias("seq"))
    counts = []
    for k, (_, run) in enumerate(rules):
        pattern = "".join(f"<{x}>" for x in run)
        n = ((F.length("seq") - F.length(F.replace("seq", F.lit(pattern), F.lit("")))) / len(pattern)).cast("long")
        counts.append(f"r{k}")
        state = state.withColumns({f"r{k}": n, "seq": F.replace("seq", F.lit(pattern), F.lit("|"))})
    hits = F.filter(F.array(*[F.struct(F.lit(name).alias("license"), F.col(c).alias("n")) for (name, _), c in zip(rules, counts)]), lambda x: x["n"] > 0)
    each = state.select("doc_id", "n_sentences", hits.alias("hits"))
    names = F.array_distinct(F.transform("hits", lambda x: x["license"]))
    one = each.select("doc_id", "n_sentences", "hits", F.explode(names).alias("license"))
    total = F.aggregate(F.filter("hits", lambda x: x["license"] == F.col("license")), F.lit(0).cast("long"), lambda a, x: a + x["n"])
    return one.select("doc_id", "license", total.alias("n_matches"), "n_sentences")


def oracle() -> str:
    """The same in DuckDB's SQL, over documents, for sentences that are not wrapped (a brute-force test holds wrapped ones)."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    table = ", ".join(f"({q(k)}, {q(v)})" for k, v in sentence_table().items())
    steps = ["s0 AS (SELECT doc_id, n AS n_sentences, seq AS q0 FROM seq)"]
    for k, (_, run) in enumerate(RULES):
        pattern = "".join(f"<{x}>" for x in run)
        steps.append(f"s{k + 1} AS (SELECT *, CAST((length(q{k}) - length(replace(q{k}, {q(pattern)}, ''))) / {len(pattern)} AS BIGINT) AS r{k}, replace(q{k}, {q(pattern)}, '|') AS q{k + 1} FROM s{k})")
    kept = "lower(text)"
    for pattern, to in KEEP:
        kept = f"regexp_replace({kept}, {q(pattern)}, {q(to.replace('$', chr(92)))}, 'g')"
    last = f"s{len(RULES)}"
    rows = " UNION ALL ".join(f"SELECT doc_id, n_sentences, {q(name)} AS license, r{k} AS n FROM {last}" for k, (name, _) in enumerate(RULES))
    return f"""WITH known(t, id) AS (VALUES {table}),
cut AS (SELECT doc_id, string_split(regexp_replace({kept}, '([.!?;:])[ \\t\\r\\n]+', '\\1' || chr(10), 'g'), chr(10)) AS a FROM documents WHERE text IS NOT NULL),
sent AS (SELECT doc_id, generate_subscripts(a, 1) AS i, trim(regexp_replace(unnest(a), '[^a-z0-9]+', ' ', 'g')) AS t FROM cut),
seq AS (SELECT doc_id, count(*) AS n, string_agg('<' || id || '>', '' ORDER BY i) AS seq FROM sent JOIN known USING (t) GROUP BY doc_id),
{", ".join(steps)}, u AS ({rows})
SELECT doc_id, license, CAST(sum(n) AS BIGINT) AS n_matches, CAST(any_value(n_sentences) AS BIGINT) AS n_sentences FROM u WHERE n > 0 GROUP BY doc_id, license"""
