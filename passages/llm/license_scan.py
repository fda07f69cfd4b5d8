"""License scans: sentence-rule recognition.

Texts are cut into sentences, each sentence (and, if it isn't known, each of its ends that begins with a line) is
normalised and looked up among known licence sentences, and the
identifiers met in a document, in order, are matched against ordered rules (sequences of identifiers that must
follow one another with no other known sentence between). A rule whose match lies inside a longer rule's match
in the same document is dropped, so a full licence text isn't also reported as its parts.

The sentence table and the rules are part of the program (they don't grow with the corpus) and are broadcast;
sentences that aren't known drop out in the same stage in which they are cut, so only hits are shuffled.

Defined results: null and empty texts give no row; a row is given once for each rule and document with its number
of matches; each row is read by itself and those of one id are then added up, so that repeated ones raise ``matches`` (``first_sentence`` is the least);
a null id is an id; texts of any length are read whole, in time linear in their length; an empty table gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window, functions as F

#: Ordered rules: (licence, rule, sentences in order).
_MIT_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
_MIT_NOTICE = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_AS_IS = "The software is provided \"as is\", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement."
_MIT_LIABLE = "In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software."
_APACHE_LINE = "Licensed under the Apache License, Version 2.0."
_APACHE = ("Licensed under the Apache License, Version 2.0 (the \"License\");", "you may not use this file except in compliance with the License.", "You may obtain a copy of the License at", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.", "See the License for the specific language governing permissions and limitations under the License.")
_GPL_LINE = "This work is licensed under the GNU General Public License, version 3."
_GPL_HEAD = "This program is free software:"
_GPL3 = "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
_GPL2 = "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."
_GPL_HOPE = "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;"
_GPL_MERCH = "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."
_GPL_SEE = "See the GNU General Public License for more details."
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_1 = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BSD_2 = "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
#: Stands for one word or more, as the holder's name (one with a full stop and a space in it ends the sentence, and isn't recognised).
ANY = "anyholder"
_BSD_3 = "Neither the name of anyholder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
_UNLICENSE = ("This is free and unencumbered software released into the public domain.", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.")
_MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."
_BSD_BY = "This software is provided by anyholder \"as is\" and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed."
_LATER = "you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation{} either version {} of the License, or (at your option) any later version."
_ZLIB = ("This software is provided 'as-is', without any express or implied warranty.", "In no event will the authors be held liable for any damages arising from the use of this software.", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:")
_ZLIB_3 = ("The origin of this software must not be misrepresented;", "you must not claim that you wrote the original software.", "If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.", "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.", "This notice may not be removed or altered from any source distribution.")
RULES: tuple[tuple[str, str, tuple[str, ...]], ...] = (
    ("MIT", "mit_line", ("Released under the MIT License.",)),
    ("MIT", "mit_licensed", ("Licensed under the MIT License.",)),
    ("MIT", "mit_grant", (_MIT_GRANT,)),
    ("MIT", "mit_grant_notice", (_MIT_GRANT, _MIT_NOTICE)),
    ("MIT", "mit_text", (_MIT_GRANT, _MIT_NOTICE, _AS_IS, _MIT_LIABLE)),
    ("Apache-2.0", "apache_line", (_APACHE_LINE,)),
    ("Apache-2.0", "apache_head", (_APACHE[0], _APACHE[1])),
    ("Apache-2.0", "apache_notice", _APACHE),
    ("GPL-3.0-only", "gpl3_line", (_GPL_LINE,)),
    ("GPL-3.0-or-later", "gpl3_head", (_GPL_HEAD, _GPL3)),
    ("GPL-3.0-or-later", "gpl3_notice", (_GPL_HEAD, _GPL3, _GPL_HOPE, _GPL_MERCH, _GPL_SEE)),
    ("GPL-2.0-or-later", "gpl2_head", (_GPL2,)),
    ("CC-BY-NC-4.0", "cc_by_nc_line", ("Licensed under CC BY-NC 4.0.",)),
    ("CC-BY-4.0", "cc_by_line", ("Licensed under CC BY 4.0.",)),
    ("CC-BY-SA-4.0", "cc_by_sa_line", ("Licensed under CC BY-SA 4.0.",)),
    ("BSD-2-Clause", "bsd2_text", (_BSD_HEAD, _BSD_1, _BSD_2)),
    ("BSD-3-Clause", "bsd3_text", (_BSD_HEAD, _BSD_1, _BSD_2, _BSD_3)),
    ("BSD-2-Clause", "bsd2_disclaimer", (_BSD_HEAD, _BSD_1, _BSD_2, _BSD_BY)),
    ("BSD-3-Clause", "bsd3_disclaimer", (_BSD_HEAD, _BSD_1, _BSD_2, _BSD_3, _BSD_BY)),
    ("LGPL-2.1-or-later", "lgpl21_head", ("This library is free software;", _LATER.format("Lesser General Public License", ";", "2.1"))),
    ("LGPL-3.0-or-later", "lgpl3_head", (_LATER.format("Lesser General Public License", ",", "3"),)),
    ("AGPL-3.0-or-later", "agpl3_head", (_LATER.format("Affero General Public License", ",", "3"),)),
    ("CC0-1.0", "cc0_waiver", ("To the extent possible under law, anyholder has waived all copyright and related or neighboring rights to this work.",)),
    ("CC0-1.0", "cc0_software", ("To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide.", "This software is distributed without any warranty.")),
    ("EPL-2.0", "epl2_notice", ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",)),
    ("BSL-1.0", "bsl1_line", ("Distributed under the Boost Software License, Version 1.0.",)),
    ("Zlib", "zlib_grant", _ZLIB),
    ("Zlib", "zlib_text", _ZLIB + _ZLIB_3),
    ("ISC", "isc_grant", (_ISC,)),
    ("Unlicense", "unlicense_head", _UNLICENSE),
    ("MPL-2.0", "mpl_notice", (_MPL,)),
)
#: Licence texts wrap lines, so a single line break is a space here; ``_hits`` also tries it as the start of a sentence.
_SQL_ENDS = r"[.!?;:]+[ \t\r\n]+|[.!?;:]+\z|\n[ \t\r]*\n+"
#: The same cuts in linear time: an end is tried where its marks begin and nowhere else in them.
_ENDS = r"(?<![.!?;:])[.!?;:]++(?:[ \t\r\n]++|\z)|\n[ \t\r]*+\n++"


def normal(sentence: str) -> str:
    return re.sub(r"[^a-z0-9]+", " ", sentence.lower()).strip()


def _tables(rules):
    ids: dict[str, int] = {}
    seqs = []
    for licence, rule, sentences in rules:
        seqs.append((licence, rule, "," + ",".join(str(ids.setdefault(normal(s), len(ids) + 1)) for s in sentences) + ",", len(sentences)))
    return sorted(ids.items(), key=lambda x: x[1]), seqs


#: The Apache notice ends a line without a full stop and then gives an address, which may follow on the same line.
_MORE = tuple(("Apache-2.0", "apache_notice", (*_APACHE[:2], f"{_APACHE[2]} {s}://www.apache.org/licenses/LICENSE-2.0{e}", *_APACHE[3:])) for s in ("http", "https") for e in ("", ".html", ".txt"))


def _pieces(text: str) -> list[str]:
    return [n for s in re.split(_ENDS.replace(r"\z", r"\Z"), text.lower()) if (n := normal(s))]


def _cut(rules):
    """The rules with their sentences cut as documents are: each by itself, and run together where that gives other pieces."""
    out = []
    for licence, rule, sentences in rules:
        ways = ([p for s in sentences for p in _pieces(s)], _pieces(" ".join(sentences)))
        out += [(licence, rule, w) for i, w in enumerate(ways) if w not in ways[:i]]
    return out


def _short(known, seqs) -> tuple[list[int], list[str]]:
    """A piece as short as "2.0" is common: it counts only after the piece that it follows in a rule. These pieces, and what they may follow."""
    short = [i for k, i in known if len(k) < 8]
    return short, sorted({f"{a},{b}" for _, _, seq, _ in seqs for a, b in zip(seq.split(",")[1:-1], seq.split(",")[2:-1]) if int(b) in short})


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES) -> DataFrame:
    """(doc_id, license, rule, matches, first_sentence): ``first_sentence`` is the place of the first match among the document's sentences."""
    spark = docs.sparkSession
    known, seqs = _tables(_cut(rules + _MORE if rules is RULES else rules))
    heads = {}
    for licence, rule, seq, n in seqs:
        heads.setdefault(int(seq.split(",")[1]), []).append((licence, rule, seq, n))
    starts = spark.createDataFrame([(sid, *r) for sid, rs in heads.items() for r in rs], "sid int, license string, rule string, seq string, n int")
    hits = _hits(docs, id_col, text_col, known)
    w = Window.partitionBy("row").orderBy("pos")
    short, follows = _short(known, seqs)
    if short:
        hits = hits.withColumn("two", F.concat_ws(",", F.lag("sid").over(w), "sid")).filter(~F.col("sid").isin(short) | F.col("two").isin(follows)).drop("two")
    longest = max(n for *_, n in seqs)
    # each hit with the identifiers from it on, as far as the longest rule reaches
    follow = hits.select("*", F.row_number().over(w).alias("at"), *[F.lead("sid", j).over(w).alias(f"n{j}") for j in range(1, longest)])
    follow = follow.select("doc_id", "row", "pos", "at", "sid", F.concat(F.lit(","), F.concat_ws(",", "sid", *[f"n{j}" for j in range(1, longest)]), F.lit(",")).alias("ahead"))
    found = follow.join(F.broadcast(starts), "sid").filter("startswith(ahead, seq)")
    # a match inside another's span: one that starts no later and ends no earlier, and is longer
    reach = Window.partitionBy("row")
    ends = found.withColumn("end", F.col("at") + F.col("n"))
    before = reach.orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    here = Window.partitionBy("row", "at")
    kept = ends.select("*", F.coalesce(F.max("end").over(before), F.lit(0)).alias("covered"), F.max("end").over(here).alias("longest")).filter("end > covered AND end = longest")
    return kept.groupBy("doc_id", "license", "rule").agg(F.count("*").alias("matches"), F.min("pos").cast("long").alias("first_sentence"))


def _hits(docs, id_col, text_col, known):
    """(doc_id, row, pos, sid): known sentences. A piece that isn't known as a whole is known by the longest of its ends that begins with one of its lines."""
    least, most = min(len(k) for k, _ in known), max(len(k) for k, _ in known)
    sids = F.create_map(*[F.lit(x) for k, i in known if f" {ANY} " not in k for x in (k, i)])
    open_ = [(*k.split(f" {ANY} "), i) for k, i in known if f" {ANY} " in k]
    known_as = lambda x: F.coalesce(F.element_at(sids, x), *[F.when(F.startswith(x, F.lit(f"{a} ")) & F.endswith(x, F.lit(f" {b}")) & (F.length(x) > len(a) + len(b) + 2), F.lit(i)) for a, b, i in open_])
    flat = lambda c: F.trim(F.regexp_replace(c, "[^a-z0-9]+", " "))
    # a sentence's normal form is never longer than itself, so short ones drop out before they are normalised
    rows = docs.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col(text_col).alias("t"))
    cut = rows.select("doc_id", "row", F.posexplode(F.split(F.lower("t"), _ENDS)).alias("pos", "s")).filter(F.length("s") >= least)
    # each step is a generator of one row, which keeps the optimizer from working it out again wherever it is used
    one = lambda df, name, c: df.select("doc_id", "row", "pos", F.inline(F.array(F.struct(c.alias(name)))))
    tail = one(cut, "tail", F.array_join(F.filter(F.transform(F.split("s", "\n"), flat), lambda x: x != ""), "\n"))
    # only the last characters of a piece can be a known sentence: one more than the longest has are kept, so that a cut line is too long to be one
    lines = one(tail, "lines", F.split(F.when(F.length("tail") > most, F.right("tail", F.lit(most + 1))).otherwise(F.col("tail")), "\n"))
    ends = F.transform(F.sequence(F.lit(1), F.size("lines")), lambda i: F.array_join(F.slice("lines", i, F.size("lines")), " "))
    ends = F.filter(ends, lambda x: F.length(x).between(least, most))
    found = F.filter(F.transform(ends, known_as), lambda x: x.isNotNull())
    return one(lines, "sid", F.get(found, F.lit(0))).filter("sid IS NOT NULL")


def oracle() -> str:
    """The same over ``documents``: pieces and their ends of whole lines, the longest known one of each, then runs of identifiers."""
    known, seqs = _tables(_cut(RULES + _MORE))
    longest, least, most = max(n for *_, n in seqs), min(len(k) for k, _ in known), max(len(k) for k, _ in known)
    short, follows = _short(known, seqs)
    values = lambda rows: ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)
    leads = ", ".join(f"lead(sid, {j}) OVER w AS n{j}" for j in range(1, longest))
    ahead = "',' || concat_ws(',', sid, " + ", ".join(f"n{j}" for j in range(1, longest)) + ") || ','"
    apart = f"sid NOT IN ({', '.join(map(str, short))}) OR two IN ({', '.join(repr(x) for x in follows)})" if short else "true"
    return rf"""
WITH known(sentence, sid) AS (VALUES {values(known)}), rules(license, rule, seq, n) AS (VALUES {values(seqs)}),
cut AS (SELECT doc_id, row_number() OVER () AS row_id, regexp_split_to_array(lower(text), '{_SQL_ENDS}') AS a FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, row_id, unnest(a) AS s, generate_subscripts(a, 1) - 1 AS pos FROM cut),
li AS (SELECT doc_id, row_id, pos, list_filter(list_transform(string_split(s, chr(10)), lambda x: trim(regexp_replace(x, '[^a-z0-9]+', ' ', 'g'))), lambda x: x <> '') AS lines FROM s WHERE length(s) >= {least}),
ends AS (SELECT doc_id, row_id, pos, unnest(list_transform(range(1, len(lines) + 1), lambda i: array_to_string(lines[i:], ' '))) AS sentence FROM li),
fit AS (SELECT ends.*, sid FROM ends JOIN known USING (sentence) UNION ALL SELECT ends.*, sid FROM ends JOIN known k ON contains(k.sentence, ' {ANY} ') AND ends.sentence LIKE replace(k.sentence, ' {ANY} ', ' _% ') WHERE length(ends.sentence) <= {most}),
hit AS (SELECT doc_id, row_id, pos, arg_max(sid, length(sentence)) AS sid FROM fit GROUP BY ALL),
hits AS (SELECT * FROM (SELECT *, concat_ws(',', lag(sid) OVER (PARTITION BY row_id ORDER BY pos), sid) AS two FROM hit) WHERE {apart}),
f AS (SELECT *, row_number() OVER w AS ord, {leads} FROM hits WINDOW w AS (PARTITION BY row_id ORDER BY pos)),
m AS (SELECT doc_id, row_id, pos, ord, license, rule, ord + n AS e FROM (SELECT *, {ahead} AS ahead FROM f) JOIN rules ON starts_with(ahead, seq)),
k AS (SELECT * FROM m a WHERE NOT EXISTS (SELECT 1 FROM m b WHERE b.row_id = a.row_id AND b.ord <= a.ord AND b.e >= a.e AND (b.ord < a.ord OR b.e > a.e)))
SELECT doc_id, license, rule, count(*) AS matches, CAST(min(pos) AS BIGINT) AS first_sentence FROM k GROUP BY ALL"""
