"""Operator 2: licence recognition by sentence rules, in built-in functions only.

A text is cut into sentences at punctuation and line ends, or, if more known
sentences come out that way, at punctuation and blank lines (licence texts are
often wrapped). They are normalised (A-Z lower-cased, runs of other characters
than letters and digits to one space; without a letter they are dropped).
Normalised sentences
map to identifiers: known licence sentences by equality, notices of copyright
by their first word, licence tags by their name; a sentence that is none of
these but has a legal word is "?", and all others are "-". The sequence of a
text's identifiers (runs of "-" as one) is matched against rules in order: a
rule is a sequence of identifiers and names a licence, and what it matches is
taken out before the next rule is tried, so that longer rules come first.

All of it is per row: nothing is shuffled. Defined results: null and empty
texts have no sentences, an empty list of identifiers and no licence; repeated
sentences and licences are reported once in `licences`, in the order of rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import table, unused

# Normalised sentences of public licence texts and notices, with identifiers of our own.
SENTENCES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mitgrant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mitnotice",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "mitasis",
    "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software": "mitliable",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "iscgrant",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsdgrant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsdsource",
    "1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsdsource",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsdbinary",
    "2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsdbinary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsdname",
    "3 neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsdname",
    "licensed under the apache license version 2 0": "apache20",
    "licensed under the apache license version 2 0 the license": "apache20",
    "you may not use this file except in compliance with the license": "apachecomply",
    "you may obtain a copy of the license at": "apachecopy",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "apacheasis",
    "http www apache org licenses license 2 0": "apacheurl",
    "see the license for the specific language governing permissions and limitations under the license": "apachesee",
    "this work is licensed under the gnu general public license version 2": "gpl2",
    "this work is licensed under the gnu general public license version 3": "gpl3",
    "this program is free software": "gplfree",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "gplterms",
    "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation": "lgplterms",
    "either version 2 of the license or at your option any later version": "later2",
    "either version 2 1 of the license or at your option any later version": "later21",
    "either version 3 of the license or at your option any later version": "later3",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl20",
    "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0": "mplcopy",
    "licensed under cc by 4 0": "ccby4",
    "licensed under cc by sa 4 0": "ccbysa4",
    "licensed under cc by nc 4 0": "ccbync4",
    "licensed under cc by nd 4 0": "ccbynd4",
    "this work is licensed under a creative commons attribution 4 0 international license": "ccby4",
    "this work is licensed under a creative commons attribution sharealike 4 0 international license": "ccbysa4",
    "this work is licensed under a creative commons attribution noncommercial 4 0 international license": "ccbync4",
    "licensed under the mit license": "mit",
    "this project is licensed under the mit license": "mit",
    "released under the mit license": "mit",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "all rights reserved": "reserved",
}
# Names in licence tags, normalised.
TAGS = {"mit": "mit", "apache 2 0": "apache20", "gpl 2 0 only": "gpl2", "gpl 3 0 only": "gpl3", "mpl 2 0": "mpl20", "isc": "iscgrant", "unlicense": "unlicense", "cc by 4 0": "ccby4", "cc by sa 4 0": "ccbysa4"}
# Ordered rules, a licence and its sequence of identifiers.
RULES = [
    ("BSD-3-Clause", "bsdgrant bsdsource bsdbinary bsdname"),
    ("BSD-2-Clause", "bsdgrant bsdsource bsdbinary"),
    ("MIT", "mitgrant mitnotice mitasis mitliable"),
    ("MIT", "mitgrant mitnotice"),
    ("Apache-2.0", "apache20 apachecomply apachecopy apacheurl apacheasis apachesee"),
    ("Apache-2.0", "apache20 apachecomply apachecopy apacheasis apachesee"),
    ("Apache-2.0", "apache20 apachecomply"),
    ("LGPL-2.1-or-later", "gplfree lgplterms later21"),
    ("LGPL-3.0-or-later", "gplfree lgplterms later3"),
    ("GPL-2.0-or-later", "gplfree gplterms later2"),
    ("GPL-3.0-or-later", "gplfree gplterms later3"),
    ("MPL-2.0", "mpl20 mplcopy"),
    ("Apache-2.0", "apache20"),
    ("GPL-2.0", "gpl2"),
    ("GPL-3.0", "gpl3"),
    ("MPL-2.0", "mpl20"),
    ("MIT", "mit"),
    ("ISC", "iscgrant"),
    ("CC-BY-4.0", "ccby4"),
    ("CC-BY-SA-4.0", "ccbysa4"),
    ("CC-BY-NC-4.0", "ccbync4"),
    ("CC-BY-ND-4.0", "ccbynd4"),
    ("Unlicense", "unlicense"),
    ("Proprietary", "copyright reserved"),
]
LEGAL = "(^| )(licen[cs]e|licen[cs]ed|licen[cs]es|warranty|warranties|redistribut[a-z]*|sublicense|copyright)( |$)"
TAG = "spdx license identifier "
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: Every text with a known sentence or a legal word has one of these; the others need no cutting.
GATE = "licen[cs]|copyright|redistribut|warrant|permission|rights reserved|free software|public domain|mpl"


def sentences(lower: Column, wrapped: bool) -> Column:
    """Normalised sentences of a lower-cased text; lines end sentences unless `wrapped`."""
    if wrapped:
        lower = F.regexp_replace(F.regexp_replace(lower, r"\n[ \t\r]*\n", ". "), r"\n", " ")
    cut = F.regexp_replace(lower, r"([.!?;])[ \t\r\n]+", "$1\n")
    plain = F.regexp_replace(cut, r"[^a-z0-9\n]+", " ")
    return F.filter(F.transform(F.split(plain, "\n"), lambda s: F.trim(s)), lambda s: F.regexp_like(s, F.lit("[a-z]")))


def identifier(sentence: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in {**SENTENCES, **{TAG + k: v for k, v in TAGS.items()}}.items() for x in pair])
    other = F.when(F.startswith(sentence, F.lit("copyright ")), "copyright").when(F.regexp_like(sentence, F.lit(LEGAL)), "?").otherwise("-")
    return F.coalesce(F.try_element_at(known, sentence), other)


def recognise(docs: DataFrame) -> DataFrame:
    """The rows of docs with identifiers, licences (both arrays) and n_unknown."""
    lower = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), UPPER, LOWER)
    lines, wrapped = (F.transform(sentences(lower, w), identifier) for w in (False, True))
    known = lambda ids: F.size(F.filter(ids, lambda x: ~x.isin("-", "?")))
    none = F.expr("CAST(array() AS array<string>)")
    ids = F.when(F.regexp_like(lower, F.lit(GATE)), F.when(known(wrapped) > known(lines), wrapped).otherwise(lines)).otherwise(none)
    mark = unused(docs, "__licence")
    ids_of, rest = f"{mark}_ids", f"{mark}_rest"
    # Of neighbouring sentences without an identifier one stands for all.
    out = docs.withColumn(ids_of, ids).withColumn(rest, F.regexp_replace(F.concat(F.lit(" "), F.array_join(ids_of, "  "), F.lit(" ")), "( -  )+", " -  "))
    for n, (licence, rule) in enumerate(RULES):
        found = " " + rule.replace(" ", "  ") + " "
        out = out.withColumn(f"{mark}{n}", F.when(F.contains(rest, F.lit(found)), licence)).withColumn(rest, F.replace(rest, F.lit(found), F.lit(" + ")))
    licences = F.array_distinct(F.array_compact(F.array(*[f"{mark}{n}" for n in range(len(RULES))])))
    out = out.withColumn("identifiers", F.filter(ids_of, lambda x: x != "-")).withColumn("licences", licences)
    out = out.withColumn("n_unknown", F.size(F.filter(ids_of, lambda x: x == "?")).cast("long"))
    return out.drop(*[c for c in out.columns if c.startswith(mark)])


def op2_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = recognise(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.size("identifiers").cast("long").alias("n_sentences"), F.array_join("identifiers", ",").alias("identifiers"), F.array_join("licences", ",").alias("licences"), "n_unknown")


def _sql() -> str:
    known = {**SENTENCES, **{TAG + k: v for k, v in TAGS.items()}}
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in known.items())
    ids = f"CASE x {cases} ELSE CASE WHEN starts_with(x, 'copyright ') THEN 'copyright' WHEN regexp_matches(x, '{LEGAL}') THEN '?' ELSE '-' END END"
    cut = r"list_filter(list_transform(string_split(regexp_replace(regexp_replace({}, '([.!?;])[ \t\r\n]+', '\1' || chr(10), 'g'), '[^a-z0-9\n]+', ' ', 'g'), chr(10)), lambda s: trim(s)), lambda s: regexp_matches(s, '[a-z]'))".format
    wrapped = r"regexp_replace(regexp_replace(t, '\n[ \t\r]*\n', '. ', 'g'), '\n', ' ', 'g')"
    steps, rest = [], "s0"
    for n, (licence, rule) in enumerate(RULES):
        mark = " " + rule.replace(" ", "  ") + " "
        steps.append(f"s{n + 1} AS (SELECT k, doc_id, ids, CASE WHEN contains(rest, '{mark}') THEN list_append(l, '{licence}') ELSE l END AS l, replace(rest, '{mark}', ' + ') AS rest FROM s{n})")
        rest = f"s{n + 1}"
    return f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents),
b AS (SELECT k, doc_id, list_transform({cut("t")}, lambda x: {ids}) AS a, list_transform({cut(wrapped)}, lambda x: {ids}) AS b FROM d),
i AS (SELECT k, doc_id, CASE WHEN len(list_filter(b, lambda x: x NOT IN ('-', '?'))) > len(list_filter(a, lambda x: x NOT IN ('-', '?'))) THEN b ELSE a END AS ids FROM b),
s0 AS (SELECT k, doc_id, ids, CAST([] AS VARCHAR[]) AS l, regexp_replace(' ' || array_to_string(ids, '  ') || ' ', '( -  )+', ' -  ', 'g') AS rest FROM i),
{", ".join(steps)}
SELECT doc_id, CAST(len(list_filter(ids, lambda x: x <> '-')) AS BIGINT) AS n_sentences, array_to_string(list_filter(ids, lambda x: x <> '-'), ',') AS identifiers,
  array_to_string(list_filter(l, lambda x, n: NOT list_contains(l[1:n-1], x)), ',') AS licences, CAST(len(list_filter(ids, lambda x: x = '?')) AS BIGINT) AS n_unknown FROM {rest}
"""


OP2_SQL = _sql()
