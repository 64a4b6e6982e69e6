"""Licence scans by sentence rules.

A text is cut into sentences, at line ends and after '.', '!', '?' or ';' before white space, once line by
line and once with the lines of a paragraph joined, because licence sentences often wrap. A
normalised sentence that is in SENTENCES becomes its identifier; the sequence of a document's
identifiers is matched against the ordered RULES; the first rule that matches gives the licence of
the sequence's kind, and all that match are listed.

Defined results: null and empty texts have no sentence and the licence 'none'; sentences that are not
known are skipped; every row is judged by its own text, whatever its doc_id; an empty table gives an empty one; extra
columns are not used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Well-known sentences of public licence notices, normalised (lower case, each run of
# other characters than letters and digits one space).
SENTENCES: list[tuple[str, str]] = [
    ("ApacheRef", "licensed under the apache license version 2 0"),
    ("ApacheRef", "released under the apache license version 2 0"),
    ("ApacheGrant", "licensed under the apache license version 2 0 the license"),
    ("ApacheComply", "you may not use this file except in compliance with the license"),
    ("ApacheCopy", "you may obtain a copy of the license at"),
    ("ApacheCopy", "you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("ApacheAsIs", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("ApacheSee", "see the license for the specific language governing permissions and limitations under the license"),
    ("ApacheRef", "spdx license identifier apache 2 0"),
    ("MITRef", "released under the mit license"),
    ("MITRef", "licensed under the mit license"),
    ("MITRef", "distributed under the mit license"),
    ("MITRef", "this project is licensed under the mit license"),
    ("MITRef", "spdx license identifier mit"),
    ("MITGrant", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"),
    ("MITNotice", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("MITAsIs", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("GPL3Ref", "this work is licensed under the gnu general public license version 3"),
    ("GPL3Ref", "licensed under the gnu general public license version 3"),
    ("GPL3Ref", "spdx license identifier gpl 3 0 only"),
    ("GPL3Ref", "spdx license identifier gpl 3 0 or later"),
    ("GPL2Ref", "this work is licensed under the gnu general public license version 2"),
    ("GPL2Ref", "licensed under the gnu general public license version 2"),
    ("GPL2Ref", "spdx license identifier gpl 2 0 only"),
    ("GPL2Ref", "spdx license identifier gpl 2 0 or later"),
    ("GPLFree", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("GPLFree2", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("GPLHope", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("GPLSee", "see the gnu general public license for more details"),
    ("LGPLRef", "licensed under the gnu lesser general public license version 3"),
    ("LGPLRef", "spdx license identifier lgpl 3 0 only"),
    ("AGPLRef", "licensed under the gnu affero general public license version 3"),
    ("AGPLRef", "spdx license identifier agpl 3 0 only"),
    ("BSDGrant", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("BSDSource", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("BSDBinary", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("BSDName", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("BSD3Ref", "spdx license identifier bsd 3 clause"),
    ("BSD2Ref", "spdx license identifier bsd 2 clause"),
    ("MPLRef", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("MPLRef", "licensed under the mozilla public license version 2 0"),
    ("MPLRef", "spdx license identifier mpl 2 0"),
    ("ISCGrant", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("UnlicenseGrant", "this is free and unencumbered software released into the public domain"),
    ("CC0Ref", "licensed under cc0 1 0"),
    ("CCBYRef", "licensed under cc by 4 0"),
    ("CCBYSARef", "licensed under cc by sa 4 0"),
    ("CCBYNCRef", "licensed under cc by nc 4 0"),
    ("CCBYNDRef", "licensed under cc by nd 4 0"),
    ("CCBYNCSARef", "licensed under cc by nc sa 4 0"),
    ("CCBYNCNDRef", "licensed under cc by nc nd 4 0"),
    ("Reserved", "all rights reserved"),
]

#: Ordered rules over a sequence of identifiers, each between blanks: (licence, identifiers in order).
#: A rule matches when its identifiers follow one another, with other known sentences between them allowed.
RULES: list[tuple[str, list[str]]] = [
    ("Apache-2.0", ["ApacheGrant", "ApacheComply", "ApacheSee"]),
    ("Apache-2.0", ["ApacheGrant"]),
    ("Apache-2.0", ["ApacheRef"]),
    ("MIT", ["MITGrant", "MITNotice"]),
    ("MIT", ["MITGrant"]),
    ("MIT", ["MITRef"]),
    ("BSD-3-Clause", ["BSDGrant", "BSDSource", "BSDBinary", "BSDName"]),
    ("BSD-2-Clause", ["BSDGrant", "BSDSource", "BSDBinary"]),
    ("BSD-3-Clause", ["BSD3Ref"]),
    ("BSD-2-Clause", ["BSD2Ref"]),
    ("GPL-3.0-or-later", ["GPLFree"]),
    ("GPL-2.0-or-later", ["GPLFree2"]),
    ("GPL-3.0", ["GPL3Ref"]),
    ("GPL-2.0", ["GPL2Ref"]),
    ("LGPL-3.0", ["LGPLRef"]),
    ("AGPL-3.0", ["AGPLRef"]),
    ("MPL-2.0", ["MPLRef"]),
    ("ISC", ["ISCGrant"]),
    ("Unlicense", ["UnlicenseGrant"]),
    ("CC0-1.0", ["CC0Ref"]),
    ("CC-BY-4.0", ["CCBYRef"]),
    ("CC-BY-SA-4.0", ["CCBYSARef"]),
    ("CC-BY-NC-4.0", ["CCBYNCRef"]),
    ("CC-BY-ND-4.0", ["CCBYNDRef"]),
    ("CC-BY-NC-SA-4.0", ["CCBYNCSARef"]),
    ("CC-BY-NC-ND-4.0", ["CCBYNCNDRef"]),
    ("proprietary", ["Reserved"]),
]


def _guards() -> list[str]:
    """Words such that each sentence has one of them, taken by how many sentences are left that have them."""
    left, out = [t for _, t in SENTENCES], []
    while left:
        words = sorted({w for t in left for w in t.split() if len(w) > 4 or w == max(t.split(), key=len)})
        out.append(max(words, key=lambda w: sum(w in t.split() for t in left)))
        left = [t for t in left if out[-1] not in t.split()]
    return out


GUARDS = _guards()


def _pattern(ids: list[str]) -> str:
    return " " + " (.* )?".join(ids) + " "


def scan(docs: DataFrame, *, text="text", doc_id="doc_id") -> DataFrame:
    """Per row of docs: doc_id, sentence_ids (in order, blank-joined), license (of the first rule that
    matches, or 'none'), licenses (all that match, in rule order, comma-joined).
    """
    known = F.map_from_arrays(F.array(*[F.lit(t) for _, t in SENTENCES]), F.array(*[F.lit(i) for i, _ in SENTENCES]))
    body = F.coalesce("_text", F.lit(""))
    lower = lambda c: F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    leaders = F.regexp_replace(body, r"\n[ \t]*(//|\*|#|--)?[ \t]*(?=[^\s/*#-])", " ")

    def found_in(c: Column, way: int) -> Column:
        normal = lambda s: F.trim(F.regexp_replace(lower(s), "[^a-z0-9]+", " "))
        ids = F.transform(F.split(F.regexp_replace(c, r"([.!?;])\s+", "$1\n"), "\n", -1), lambda s: F.try_element_at(known, normal(s)))
        return F.transform(F.array(F.array_compact(ids)), lambda x: F.struct(F.size(x).alias("n"), F.lit(-way).alias("w"), x.alias("ids")))

    best = F.array_max(F.concat(found_in(body, 0), found_in(leaders, 1)))["ids"]
    maybe = F.lit(False)
    for word in GUARDS:
        maybe = maybe | F.contains(F.col("_lower"), F.lit(word))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text")).withColumn("_lower", lower(F.coalesce("_text", F.lit(""))))
    out = rows.select("doc_id", F.when(maybe, F.array_join(best, " ")).otherwise(F.lit("")).alias("sentence_ids"))
    padded = F.concat(F.lit(" "), "sentence_ids", F.lit(" "))
    found = F.array_distinct(F.array_compact(F.array(*[F.when(padded.rlike(_pattern(ids)), F.lit(name)) for name, ids in RULES])))
    return out.withColumn("_found", found).select(
        "doc_id", "sentence_ids", F.coalesce(F.try_element_at("_found", F.lit(1)), F.lit("none")).alias("license"), F.array_join("_found", ",").alias("licenses")
    )


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


#: The same in DuckDB SQL. The look-ahead of the joined form is a captured character there.
ORACLE = rf"""
WITH known(sid, sentence) AS (VALUES {_values(SENTENCES)}),
rules(nr, license, pattern) AS (VALUES {_values([(i, n, _pattern(x)) for i, (n, x) in enumerate(RULES)])}),
ways AS (SELECT doc_id, 0 AS way, text AS t FROM documents UNION ALL
         SELECT doc_id, 1, regexp_replace(text, '\n[ \t]*(//|\*|#|--)?[ \t]*([^\s/*#-])', ' \2', 'g') FROM documents),
cuts AS (SELECT doc_id, way, string_split(regexp_replace(t, '([.!?;])\s+', '\1' || chr(10), 'g'), chr(10)) AS a FROM ways),
units AS (SELECT doc_id, way, unnest(a) AS raw, unnest(range(len(a))) AS pos FROM cuts),
hits AS (SELECT DISTINCT doc_id, way, pos, sid FROM units JOIN known
         ON sentence = trim(regexp_replace(translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', ' ', 'g'))),
seqs AS (SELECT doc_id, way, count(*) AS n, string_agg(sid, ' ' ORDER BY pos) AS ids FROM hits GROUP BY ALL),
best AS (SELECT doc_id, arg_max(ids, n * 2 - way) AS ids FROM seqs GROUP BY doc_id),
base AS (SELECT d.doc_id, coalesce(b.ids, '') AS ids FROM documents d LEFT JOIN best b USING (doc_id)),
m AS (SELECT doc_id, license, min(nr) AS nr FROM base JOIN rules ON regexp_matches(' ' || ids || ' ', pattern) GROUP BY ALL),
l AS (SELECT doc_id, string_agg(license, ',' ORDER BY nr) AS ls, arg_min(license, nr) AS first FROM m GROUP BY doc_id)
SELECT doc_id, ids AS sentence_ids, coalesce(first, 'none') AS license, coalesce(ls, '') AS licenses FROM base LEFT JOIN l USING (doc_id)
"""
