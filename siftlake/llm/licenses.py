"""License scans by sentence rules: known sentences get identifiers, identifier sequences meet ordered rules.

Main path: Spark SQL functions only. A text is normalised; its sentences end at sentence ends and blank lines, and may begin
and end at any line end between. So a known sentence is found on a line of its own as well as wrapped over several
lines, and a constant map (its size is that of the knowledge base below) names it. The identifiers of a document, in
order, form one string, over which the rules are matched from the most to the least specific; what a rule has used is
blanked, so that later, broader rules cannot use it again.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sentence identifier -> normalised sentences: lower case, every run of other characters than a-z, 0-9, + and . is one
#: blank, full stops only inside numbers.
SENTENCES: dict[str, list[str]] = {
    "ApacheRef2": ["licensed under the apache license version 2.0", "licensed under the apache license version 2.0 the license", "released under the apache license version 2.0", "this work is licensed under the apache license version 2.0", "licensed under apache 2.0"],
    "ApacheUse": ["you may not use this file except in compliance with the license"],
    "ApacheCopy": ["you may obtain a copy of the license at"],
    "ApacheAsIs": ["unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"],
    "ApacheLang": ["see the license for the specific language governing permissions and limitations under the license"],
    "MITRef": ["released under the mit license", "licensed under the mit license", "this work is licensed under the mit license", "distributed under the mit license", "mit license", "the mit license", "the mit license mit"],
    "MITPerm": ["permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"],
    "MITNotice": ["the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"],
    "AsIsSoftware": ["the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"],
    "MITLiable": ["in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"],
    "ISCRef": ["isc license", "the isc license", "licensed under the isc license", "released under the isc license"],
    "ISCPerm": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"],
    "GPL3Ref": ["this work is licensed under the gnu general public license version 3", "licensed under the gnu general public license version 3", "released under the gnu general public license version 3", "gnu general public license version 3"],
    "GPL2Ref": ["this work is licensed under the gnu general public license version 2", "licensed under the gnu general public license version 2", "released under the gnu general public license version 2"],
    "GPLFree": ["this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"],
    "GPLFree2": ["this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"],
    "LGPLFree": ["this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2.1 of the license or at your option any later version", "this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version"],
    "AGPLFree": ["this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"],
    "EPL2": ["this program and the accompanying materials are made available under the terms of the eclipse public license 2.0 which is available at https www.eclipse.org legal epl 2.0", "licensed under the eclipse public license version 2.0"],
    "BSL1": ["boost software license version 1.0", "distributed under the boost software license version 1.0", "licensed under the boost software license version 1.0"],
    "ZlibPerm": ["permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"],
    "LGPLRef": ["licensed under the gnu lesser general public license version 3", "licensed under the gnu lesser general public license version 2.1"],
    "AGPLRef": ["licensed under the gnu affero general public license version 3"],
    "MPLRef": ["this source code form is subject to the terms of the mozilla public license v", "licensed under the mozilla public license version 2.0"],
    "BSDRedist": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "BSDSource": ["redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"],
    "BSDBinary": ["redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"],
    "BSDDisclaim": ["this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"],
    "BSDLiable": ["in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage", "in no event shall the copyright owner or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"],
    "BSD3Ref": ["bsd 3 clause license", "licensed under the bsd 3 clause license", "released under the bsd 3 clause license"],
    "BSDRef": ["licensed under the bsd license", "released under the bsd license"],
    "CCBY": ["licensed under cc by 4.0", "this work is licensed under cc by 4.0", "this work is licensed under a creative commons attribution 4.0 international license"],
    "CCBYSA": ["licensed under cc by sa 4.0", "this work is licensed under a creative commons attribution sharealike 4.0 international license"],
    "CCBYNC": ["licensed under cc by nc 4.0", "this work is licensed under cc by nc 4.0", "this work is licensed under a creative commons attribution noncommercial 4.0 international license"],
    "CCBYND": ["licensed under cc by nd 4.0"],
    "CC0": ["released under cc0 1.0", "licensed under cc0 1.0", "this work is dedicated to the public domain"],
    "AllRights": ["all rights reserved"],
    "Unlicense": ["this is free and unencumbered software released into the public domain"],
}

#: Sentences with a name in them: (identifier, head, tail); up to ``GAP`` words may stand between.
NAMED = [("BSDEndorse", "neither the name of", "nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"), ("BSDEndorse", "neither the names of", "nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"), ("BSDEndorse", "neither the name of", "nor the names of their contributors may be used to endorse or promote products derived from this software without specific prior written permission")]
GAP = 60

#: Ordered rules: (licence, regular expression over ``;id`` items). Full texts come before references.
RULES: list[tuple[str, str]] = [
    ("Apache-2.0", ";ApacheRef2;ApacheUse(;ApacheCopy)?;ApacheAsIs(;ApacheLang)?"),
    ("MIT", "(;MITRef)?(;AllRights)?;MITPerm;MITNotice(;AsIsSoftware)?(;MITLiable)?"),
    ("ISC", "(;ISCRef)?(;AllRights)?;ISCPerm"),
    ("BSD-3-Clause", "(;BSD3Ref)?(;AllRights)?;BSDRedist;BSDSource;BSDBinary;BSDEndorse(;BSDDisclaim)?(;BSDLiable)?"),
    ("BSD-2-Clause", "(;AllRights)?;BSDRedist;BSDSource;BSDBinary(;BSDDisclaim)?(;BSDLiable)?"),
    ("AGPL-3.0-or-later", ";AGPLFree"),
    ("LGPL", ";LGPLFree"),
    ("GPL-3.0-or-later", ";GPLFree"),
    ("GPL-2.0-or-later", ";GPLFree2"),
    ("AGPL-3.0", ";AGPLRef"),
    ("LGPL", ";LGPLRef"),
    ("GPL-3.0", ";GPL3Ref"),
    ("GPL-2.0", ";GPL2Ref"),
    ("Apache-2.0", ";ApacheRef2"),
    ("MPL-2.0", ";MPLRef"),
    ("MIT", ";MITRef"),
    ("ISC", ";ISCRef"),
    ("BSD-3-Clause", ";BSD3Ref"),
    ("BSD", ";BSDRef"),
    ("EPL-2.0", ";EPL2"),
    ("BSL-1.0", ";BSL1"),
    ("Zlib", ";ZlibPerm"),
    ("CC-BY-NC-4.0", ";CCBYNC"),
    ("CC-BY-SA-4.0", ";CCBYSA"),
    ("CC-BY-ND-4.0", ";CCBYND"),
    ("CC-BY-4.0", ";CCBY"),
    ("CC0-1.0", ";CC0"),
    ("Unlicense", ";Unlicense"),
    ("proprietary", "^(;AllRights)+$"),  # only in a text that names no licence
]

#: A sentence ends at . ! or ? before white space or the end, and at a blank line. A version number does not end one.
_CUT = r"[!?]+(?=[\x20\t\n\r]|$)|\.(?=[\x20\t\n\r]|$)"
#: Every known sentence holds one of these, so a text without them holds none. A blank stands for what is a blank when normalised.
_HINT = "licen|permission|redistribution|free software|warrant|endorse|liable|public domain|all rights reserved|released under cc0|copyright|free and unencumbered"
_wrapped = lambda s: re.sub(r"\\? ", r"[ \\n]", re.escape(s))
_named = lambda head, tail, blank: head + blank + f"(?:[a-z0-9.+]+{blank}){{0,{GAP}}}" + tail
#: The known sentences, the longest first, from a line start to a line end; their blanks may be single line ends.
_KNOWN = r"(?<![^\n])(?:" + "|".join([_named(_wrapped(h), _wrapped(t), r"[ \n]") for _, h, t in NAMED] + [_wrapped(s) for s in sorted((s for all_ in SENTENCES.values() for s in all_), key=lambda s: (-len(s), s))]) + r")(?![^\n])"


def _lines(text: Column) -> Column:
    """The normalised lines of a text; blank lines, and lines of marks only, are empty, and an empty line follows each sentence end."""
    lower = F.regexp_replace(F.lower(text), "\r\n?", "\n")
    words = F.regexp_replace(F.regexp_replace(lower, _CUT, "\n\n"), r"[^a-z0-9.+\n]+", " ")
    return F.regexp_replace(words, r"^ +| +$| *\n *", "\n")


def sentence_ids(text: Column) -> Column:
    """The identifiers of the known sentences of a text, in order (an array; empty for null, empty or foreign texts)."""
    known = F.create_map(*[x for k, all_ in SENTENCES.items() for s in all_ for x in (F.lit(s), F.lit(k))])
    found = F.regexp_extract_all(_lines(F.coalesce(text, F.lit(""))), F.lit(_KNOWN), F.lit(0))
    told = lambda s: F.coalesce(F.try_element_at(known, s), *[F.when(s.startswith(h + " ") & s.endswith(" " + t), k) for k, h, t in NAMED])
    return F.transform(found, lambda s: told(F.translate(s, "\n", " ")))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, license, n_sentences, rule_no, sentence_ids)``: one row per document and rule that matched.

    The whole text is read, however long: a row is scanned by itself. Null and empty texts give no row; repeated rows are scanned
    once each, and a null id is an id like any other; a rule that matches several places counts once, ``n_sentences`` being the
    known sentences it used. Where two rules could use one sentence the earlier rule has it. An empty table gives an empty result. Extra columns are ignored.
    """
    hint = F.lower(F.col(text_col)).rlike(_HINT.replace(" ", "[^a-z0-9.+]+"))
    found = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).where(hint).select("_id", sentence_ids(F.col("_text")).alias("_ids")).where(F.size("_ids") > 0)
    left = F.concat(F.lit(";"), F.array_join("_ids", ";"), F.lit(";"))
    rows = found.select("_id", "_ids", left.alias("_left"))
    hits = []
    for i, (name, rule) in enumerate(RULES):
        # the used items go, one separator stays: what was apart does not become neighbours, as "~" is in between
        nxt = F.regexp_replace("_left", rule.removesuffix("$") + ("(?=;$)" if rule.endswith("$") else "(?=;)"), ";~")
        rows = rows.withColumn("_next", nxt).withColumn(f"_n{i}", _items(F.col("_left")) - _items(F.col("_next"))).drop("_left").withColumnRenamed("_next", "_left")
        hits.append(F.when(F.col(f"_n{i}") > 0, F.struct(F.lit(name).alias("license"), F.col(f"_n{i}").cast("long").alias("n_sentences"), F.lit(i).alias("rule_no"))))
    one = rows.select("_id", "_ids", F.explode(F.filter(F.array(*hits), lambda x: x.isNotNull())).alias("_hit"))
    return one.select(F.col("_id").alias(id_col), "_hit.license", "_hit.n_sentences", "_hit.rule_no", F.array_join("_ids", ";").alias("sentence_ids"))


def _items(joined: Column) -> Column:
    """How many identifiers are left; each begins with a capital letter after a semicolon."""
    return F.regexp_count(joined, F.lit(";[A-Z]"))


def sql(table: str = "documents") -> str:
    """The same scan in DuckDB SQL, with a cut of its own: paragraphs, their lines, and every run of lines, joined, against the knowledge base."""
    values = ", ".join(f"('{s}', '{k}')" for k, all_ in SENTENCES.items() for s in all_)
    named = " ".join(f"WHEN regexp_full_match(s, '{_named(h, t, ' ')}') THEN '{k}'" for k, h, t in NAMED)
    steps, prev = [], "start"
    for i, (_, rule) in enumerate(RULES):
        # RE2 has no look-ahead: the closing semicolon is matched and put back
        pattern = rule.removesuffix("$") + (";$" if rule.endswith("$") else ";")
        steps.append(f"r{i} AS (SELECT *, regexp_replace(l{i}, '{pattern}', ';~;', 'g') AS l{i + 1} FROM {prev})")
        prev = f"r{i}"
    count = lambda i: f"len(regexp_extract_all(l{i}, ';[A-Z]'))"
    picks = " UNION ALL ".join(f"SELECT doc_id, '{name}' AS license, {count(i)} - {count(i + 1)} AS n_sentences, {i} AS rule_no, ids FROM {prev}" for i, (name, _) in enumerate(RULES))
    return f"""WITH known(s, k) AS (VALUES {values}),
docs AS (SELECT doc_id, row_number() OVER () AS r, string_split(regexp_replace(replace(replace(lower(text), chr(13) || chr(10), chr(10)), chr(13), chr(10)), '([!?]+|[.])([ \\t\\n]|$)', chr(10) || chr(10), 'g'), chr(10)) AS a FROM {table}),
lines AS (SELECT doc_id, r, generate_subscripts(a, 1) AS i, trim(regexp_replace(unnest(a), '[^a-z0-9.+]+', ' ', 'g')) AS s FROM docs),
par AS (SELECT *, sum(CASE WHEN s = '' THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i) AS p FROM lines),
own AS (SELECT r, doc_id, p, list(s ORDER BY i) AS s, list(i ORDER BY i) AS i FROM par WHERE s <> '' GROUP BY r, doc_id, p),
runs AS (SELECT r, doc_id, i[a] AS i, i[z] AS j, array_to_string(s[a:z], ' ') AS s FROM (SELECT *, unnest(range(a, least(a + 150, len(s) + 1))) AS z FROM (SELECT *, unnest(range(1, len(s) + 1)) AS a FROM own))),
hits AS (SELECT r, doc_id, i, j, CASE WHEN known.k IS NOT NULL THEN known.k {named} END AS k FROM runs LEFT JOIN known USING (s)),
best AS (SELECT * FROM hits x WHERE k IS NOT NULL AND NOT EXISTS (SELECT 1 FROM hits y WHERE y.k IS NOT NULL AND y.r = x.r AND y.i <= x.i AND y.j >= x.j AND (y.i < x.i OR y.j > x.j))),
ids AS (SELECT doc_id, r, string_agg(k, ';' ORDER BY i) AS ids FROM best GROUP BY doc_id, r),
start AS (SELECT doc_id, ids, ';' || ids || ';' AS l0 FROM ids),
{", ".join(steps)}
SELECT doc_id, license, n_sentences, rule_no::INTEGER AS rule_no, ids AS sentence_ids FROM ({picks}) WHERE n_sentences > 0"""


assert all(re.fullmatch(r"\^?(\(?;\w+\)?[?+]?)+\$?", r) for _, r in RULES)
assert all(re.search(_HINT, s) for all_ in [*SENTENCES.values(), [t for _, _, t in NAMED]] for s in all_)
