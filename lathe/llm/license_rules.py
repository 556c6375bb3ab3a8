"""Licence recognition by sentence rules. DataFrame functions only.

A text is cut into pieces at line ends and at . ! ? : ; before a space, and each piece is
normalised (lower case, runs of anything but a-z and 0-9 become one space). A known
licence sentence is found where it equals a run of whole pieces, so that it may be
wrapped anywhere, stand in a comment, or hold a ':' or ';' or an address of its own line;
a run that begins earlier comes first, then the longer one, and a piece is used once.
A sentence may have slots (``*``) for the words that differ from text to text, such as a
holder's name. Copyright lines and list marks ("2", "b") are left out; any other piece stays
in the sequence as unknown. The sequence is matched against ordered rules: a rule that finds
its identifiers one after the other, with nothing unknown between them, takes them, wherever
they stand and as often, and names its licence; what no rule takes is reported as unmatched.
"All rights reserved" belongs to some licences' texts and names none by itself.

A line ``SPDX-License-Identifier:`` is read as an expression: each listed identifier in it names
a licence, in any case, with its exception where WITH gives one; short forms without "only" or
"or later" are read as SPDX does.

Lines are not joined before the cut: a notice below a line without a full stop would be
lost in it. ``n_sentences`` counts pieces, so each line of a wrapped sentence counts.

Sentence table and rules are small and written into the expression; their number is a
property of the rule set, not of the corpus. One pass over the texts, no shuffle.

``scan_sql`` looks up single pieces in the whole table, but for slots. It agrees with the scan
on texts whose known sentences each stand in one piece, as all do in the test tables.

Defined results: a null or empty text has no sentence and no licence; a licence named by
two rules or matched twice is listed once, in rule order; repeated rows are judged each;
extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SENTENCE_END = r"[.!?:;][ \t]+|[.!?:;]?[\n\r]+"

#: Identifier and normalised sentence, from the licences' public texts and notices.
SENTENCES = (
    ("ApacheNotice", "licensed under the apache license version 2 0"),
    ("ApacheNotice", "licensed under the apache license version 2 0 the license"),
    ("ApacheUse", "you may not use this file except in compliance with the license"),
    ("ApacheCopy", "you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("ApacheAsIs", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("ApacheSee", "see the license for the specific language governing permissions and limitations under the license"),
    ("MitName", "released under the mit license"),
    ("MitName", "licensed under the mit license"),
    ("MitName", "the mit license"),
    ("MitGrant", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("MitNotice", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("MitAsIs", "the software is provided as is without warranty of any kind express or implied"),
    ("BsdGrant", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("BsdSource", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("BsdBinary", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("BsdEndorse", "neither the name of * nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("GplThree", "this work is licensed under the gnu general public license version 3"),
    ("GplThree", "licensed under the gnu general public license version 3"),
    ("GplFree", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("GplHope", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("GplSee", "see the gnu general public license for more details"),
    ("CcByNc", "licensed under cc by nc 4 0"),
    ("CcBy", "licensed under cc by 4 0"),
    ("CcBySa", "licensed under cc by sa 4 0"),
    ("CcZero", "dedicated to the public domain under cc0 1 0"),
    ("AllRights", "all rights reserved"),
)

#: Further sentences in full, as the published licence texts and headers have them.
PUBLISHED = (
    ("ApacheCopy", "you may obtain a copy of the license at https www apache org licenses license 2 0"),
    ("MitName", "mit license"),
    ("MitName", "mit license mit"),
    ("MitName", "the mit license mit"),
    ("MitGrant", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"),
    ("MitNotice", "the above copyright notice and this permission notice including the next paragraph shall be included in all copies or substantial portions of the software"),
    ("MitAsIs", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("BsdEndorse", "neither the name of * nor the names of * contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("BsdEndorse", "the name of * may not be used to endorse or promote products derived from this software without specific prior written permission"),
    ("BsdAdvert", "all advertising materials mentioning features or use of this software must display the following acknowledgement"),
    ("BsdThanks", "this product includes software developed by *"),
    ("BsdThanks", "this product includes software developed by * and its contributors"),
    ("BsdThanks", "this product includes software developed by * and other contributors"),
    ("BsdAsIs", "this software is provided by * as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"),
    ("GplTwoFree", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("GplTwoOnly", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation"),
    ("GplCopy", "you should have received a copy of the gnu general public license along with this program"),
    ("GplCopy", "if not see https www gnu org licenses"),
    ("GplCopy", "if not see http www gnu org licenses"),
    ("LgplTwoFree", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version"),
    ("LgplFree", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("LgplHope", "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("LgplSee", "see the gnu lesser general public license for more details"),
    ("AgplFree", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("AgplSee", "see the gnu affero general public license for more details"),
    ("MplSubject", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("MplCopy", "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0"),
    ("MplCopy", "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0"),
    ("EplTwo", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0"),
    ("EplTwo", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at http www eclipse org legal epl 2 0"),
    ("IscGrant", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("IscGrant", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("ZeroBsdGrant", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("IscAsIs", "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"),
    ("BoostNotice", "distributed under the boost software license version 1 0"),
    ("BoostName", "boost software license version 1 0 august 17th 2003"),
    ("BoostGrant", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following"),
    ("UnlicenseFree", "this is free and unencumbered software released into the public domain"),
    ("UnlicenseAnyone", "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
    ("ZlibAsIs", "this software is provided as is without any express or implied warranty"),
    ("ZlibLiable", "in no event will the authors be held liable for any damages arising from the use of this software"),
    ("ZlibGrant", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"),
    ("GplThreeText", "gnu general public license version 3 29 june 2007"),
    ("GplTwoText", "gnu general public license version 2 june 1991"),
    ("LgplTwoText", "gnu lesser general public license version 2 1 february 1999"),
    ("LgplThreeText", "gnu lesser general public license version 3 29 june 2007"),
    ("AgplText", "gnu affero general public license version 3 19 november 2007"),
    ("ApacheText", "apache license version 2 0 january 2004"),
    ("MplText", "mozilla public license version 2 0"),
    ("EplText", "eclipse public license v 2 0"),
    ("EplText", "eclipse public license v2 0"),
    ("CcByText", "creative commons attribution 4 0 international public license"),
    ("CcBySaText", "creative commons attribution sharealike 4 0 international public license"),
    ("CcByNcText", "creative commons attribution noncommercial 4 0 international public license"),
    ("CcBy", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("CcBySa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("CcByNc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("CcByNcSa", "this work is licensed under a creative commons attribution noncommercial sharealike 4 0 international license"),
    ("CcByNd", "this work is licensed under a creative commons attribution noderivatives 4 0 international license"),
)

#: Identifiers that a line ``SPDX-License-Identifier: ...`` names.
SPDX = (
    "0BSD", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-SA-4.0", "CC0-1.0", "EPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later",
    "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT", "MPL-2.0", "PostgreSQL", "Python-2.0", "Unlicense", "WTFPL", "Zlib",
)
#: Short forms that SPDX has given up, and what they mean.
SHORT = (
    ("AGPL-3.0", "AGPL-3.0-only"), ("AGPL-3.0+", "AGPL-3.0-or-later"), ("GPL-2.0", "GPL-2.0-only"), ("GPL-2.0+", "GPL-2.0-or-later"), ("GPL-3.0", "GPL-3.0-only"), ("GPL-3.0+", "GPL-3.0-or-later"),
    ("LGPL-2.1", "LGPL-2.1-only"), ("LGPL-2.1+", "LGPL-2.1-or-later"), ("LGPL-3.0", "LGPL-3.0-only"), ("LGPL-3.0+", "LGPL-3.0-or-later"),
)

#: Licence and the identifiers that name it, longest rules first.
RULES = (
    ("Apache-2.0", ("ApacheNotice", "ApacheUse", "ApacheCopy", "ApacheAsIs", "ApacheSee")),
    ("Apache-2.0", ("ApacheNotice", "ApacheUse", "ApacheCopy")),
    ("MIT", ("MitName", "MitGrant", "MitNotice", "MitAsIs")),
    ("MIT", ("MitGrant", "MitNotice", "MitAsIs")),
    ("BSD-3-Clause", ("BsdGrant", "BsdSource", "BsdBinary", "BsdEndorse")),
    ("BSD-2-Clause", ("BsdGrant", "BsdSource", "BsdBinary")),
    ("GPL-3.0-or-later", ("GplFree", "GplHope", "GplSee")),
    ("GPL-3.0-or-later", ("GplFree",)),
    ("Apache-2.0", ("ApacheNotice",)),
    ("MIT", ("MitName",)),
    ("GPL-3.0-only", ("GplThree",)),
    ("CC-BY-NC-4.0", ("CcByNc",)),
    ("CC-BY-4.0", ("CcBy",)),
    ("CC-BY-SA-4.0", ("CcBySa",)),
    ("CC0-1.0", ("CcZero",)),
)

#: Tried before RULES, longest first. The BSD texts begin with a copyright line that reserves all rights.
PUBLISHED_RULES = (
    ("BSD-4-Clause", ("AllRights", "BsdGrant", "BsdSource", "BsdBinary", "BsdAdvert", "BsdThanks", "BsdEndorse", "BsdAsIs")),
    ("BSD-4-Clause", ("BsdGrant", "BsdSource", "BsdBinary", "BsdAdvert", "BsdThanks", "BsdEndorse", "BsdAsIs")),
    ("BSD-4-Clause", ("AllRights", "BsdGrant", "BsdSource", "BsdBinary", "BsdAdvert", "BsdThanks", "BsdEndorse")),
    ("BSD-4-Clause", ("BsdGrant", "BsdSource", "BsdBinary", "BsdAdvert", "BsdThanks", "BsdEndorse")),
    ("BSD-3-Clause", ("AllRights", "BsdGrant", "BsdSource", "BsdBinary", "BsdEndorse", "BsdAsIs")),
    ("BSD-3-Clause", ("BsdGrant", "BsdSource", "BsdBinary", "BsdEndorse", "BsdAsIs")),
    ("BSD-2-Clause", ("AllRights", "BsdGrant", "BsdSource", "BsdBinary", "BsdAsIs")),
    ("BSD-2-Clause", ("BsdGrant", "BsdSource", "BsdBinary", "BsdAsIs")),
    ("BSD-3-Clause", ("AllRights", "BsdGrant", "BsdSource", "BsdBinary", "BsdEndorse")),
    ("BSD-2-Clause", ("AllRights", "BsdGrant", "BsdSource", "BsdBinary")),
    ("GPL-3.0-or-later", ("GplFree", "GplHope", "GplSee", "GplCopy", "GplCopy")),
    ("GPL-3.0-or-later", ("GplFree", "GplHope", "GplSee", "GplCopy")),
    ("GPL-2.0-or-later", ("GplTwoFree", "GplHope", "GplSee", "GplCopy", "GplCopy")),
    ("GPL-2.0-or-later", ("GplTwoFree", "GplHope", "GplSee")),
    ("GPL-2.0-or-later", ("GplTwoFree",)),
    ("GPL-2.0-only", ("GplTwoOnly", "GplHope", "GplSee")),
    ("GPL-2.0-only", ("GplTwoOnly",)),
    ("LGPL-2.1-or-later", ("LgplTwoFree", "LgplHope", "LgplSee")),
    ("LGPL-2.1-or-later", ("LgplTwoFree",)),
    ("LGPL-3.0-or-later", ("LgplFree", "LgplHope", "LgplSee")),
    ("LGPL-3.0-or-later", ("LgplFree",)),
    ("AGPL-3.0-or-later", ("AgplFree", "GplHope", "AgplSee")),
    ("AGPL-3.0-or-later", ("AgplFree",)),
    ("MPL-2.0", ("MplSubject", "MplCopy")),
    ("MPL-2.0", ("MplSubject",)),
    ("EPL-2.0", ("EplTwo",)),
    ("ISC", ("IscGrant", "IscAsIs")),
    ("ISC", ("IscGrant",)),
    ("0BSD", ("ZeroBsdGrant", "IscAsIs")),
    ("BSL-1.0", ("BoostName", "BoostGrant")),
    ("BSL-1.0", ("BoostNotice",)),
    ("Unlicense", ("UnlicenseFree", "UnlicenseAnyone")),
    ("Unlicense", ("UnlicenseFree",)),
    ("Zlib", ("ZlibAsIs", "ZlibLiable", "ZlibGrant")),
    ("GPL-3.0-only", ("GplThreeText",)),
    ("GPL-2.0-only", ("GplTwoText",)),
    ("LGPL-2.1-only", ("LgplTwoText",)),
    ("LGPL-3.0-only", ("LgplThreeText",)),
    ("AGPL-3.0-only", ("AgplText",)),
    ("Apache-2.0", ("ApacheText",)),
    ("MPL-2.0", ("MplText",)),
    ("EPL-2.0", ("EplText",)),
    ("CC-BY-4.0", ("CcByText",)),
    ("CC-BY-SA-4.0", ("CcBySaText",)),
    ("CC-BY-NC-4.0", ("CcByNcText",)),
    ("CC-BY-NC-SA-4.0", ("CcByNcSa",)),
    ("CC-BY-ND-4.0", ("CcByNd",)),
)
ALL_SENTENCES, ALL_RULES = SENTENCES + PUBLISHED, PUBLISHED_RULES + RULES

#: Words that a slot may hold.
SLOT = r"[a-z0-9]+(?:[ |][a-z0-9]+){0,15}?"
#: Pieces that say nothing: copyright lines, and marks of lists.
NEUTRAL = r"^(?:(?:c )?copyright\b.*|[0-9]{1,2}|[a-z]|i{1,3})$"


def _run(sentence: str) -> str:
    """The pattern of a sentence in the pieces, which bars divide; a bar within it counts as a space."""
    return sentence.replace(" ", "[ |]").replace("*", SLOT)


def pieces_of(text: Column) -> Column:
    """Normalised pieces with a letter or digit."""
    plain = lambda s: F.trim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", " "))
    return F.filter(F.transform(F.split(text, SENTENCE_END), plain), lambda s: s != "")


def sequence_of(joined: Column, sentences: tuple[tuple[str, str], ...] = ALL_SENTENCES) -> Column:
    """Of pieces with a bar before and after each: identifiers of known sentences, '?' for other pieces; nothing if nothing is known."""
    longest_first = sorted({s for _, s in sentences}, key=lambda s: (-len(s), s))
    known_run = r"\|(?:" + "|".join(map(_run, longest_first)) + r")(?=\|)"
    known, names = F.array(*(F.lit(s) for _, s in sentences)), F.array(*(F.lit(i) for i, _ in sentences))
    slotted = [s for s in longest_first if "*" in s]

    def written(run: Column) -> Column:
        """The words of a run; of a sentence whose slots are filled, as the table has it."""
        words = F.trim(F.translate(run, "|", " "))
        for s in slotted:
            words = F.regexp_replace(words, "^" + s.replace("*", SLOT) + "$", s)
        return words

    def name(words: Column) -> Column:
        at = F.array_position(known, words).cast("int")
        return F.when(at > 0, F.element_at(names, at)).when(words.rlike(NEUTRAL), "").otherwise("?")

    pieces = F.regexp_extract_all(joined, F.lit(known_run + r"|\|[^|]+(?=\|)"), F.lit(0))
    # Few texts hold a known sentence; only theirs are taken apart.
    return F.when(joined.rlike(known_run), F.filter(F.transform(F.transform(pieces, written), name), lambda i: i != ""))


def spdx_licences(text: Column) -> Column:
    """Licences that ``SPDX-License-Identifier:`` lines name, in order."""
    read = {i.lower(): i for i in SPDX} | {short.lower(): whole for short, whole in SHORT}
    table = F.create_map(*(F.lit(x) for pair in read.items() for x in pair))
    terms = F.regexp_extract_all(text, F.lit(r"(?i)SPDX-License-Identifier:[ \t]*([^\n\r]*)"), F.lit(1))
    words = F.regexp_extract_all(F.array_join(terms, " ; "), F.lit(r"(?i)[a-z0-9][a-z0-9.+-]*(?:[ \t]+with[ \t]+[a-z0-9.+-]+)?"), F.lit(0))

    def one(w: Column) -> Column:
        parts = F.split(w, "[ \t]+")
        name = F.try_element_at(table, F.lower(parts[0]))
        return F.when(F.size(parts) > 1, F.concat(name, F.lit(" WITH "), F.get(parts, 2))).otherwise(name)

    named = F.filter(F.transform(words, one), lambda n: n.isNotNull())
    return F.when(F.contains(F.lower(text), F.lit("spdx-license-identifier:")), named)


def scan_licences(docs: DataFrame, sentences: tuple[tuple[str, str], ...] = ALL_SENTENCES, rules: tuple[tuple[str, tuple[str, ...]], ...] = ALL_RULES) -> DataFrame:
    """doc_id, n_sentences, identifiers (joined), licences (joined, null if none), n_unmatched."""
    text = F.col("text").cast("string")
    nothing = F.array().cast("array<string>")
    # A step a projection, so that the pieces are made once.
    out = docs.select("doc_id", pieces_of(text).alias("said"), F.coalesce(spdx_licences(text), nothing).alias("spdx"))
    out = out.select("doc_id", "spdx", F.coalesce(F.size("said"), F.lit(0)).alias("n"), F.concat(F.lit("|"), F.array_join("said", "|"), F.lit("|")).alias("joined"))
    out = out.select("doc_id", "spdx", "n", F.coalesce(sequence_of(F.col("joined"), sentences), nothing).alias("ids"))
    mark = lambda x: F.when(x == "?", x).otherwise(F.concat(F.lit("<"), x, F.lit(">")))
    known = F.filter("ids", lambda x: x != "?")
    out = out.select("doc_id", "spdx", F.col("n").cast("long").alias("n_sentences"), F.array_join(known, " ").alias("identifiers"), F.array_join(F.transform("ids", mark), "").alias("rest"))
    # Most documents hold no known sentence; for the others the rules are tried in order.
    acc = F.struct(F.col("rest").alias("rest"), F.array().cast("array<string>").alias("found"))
    table = F.array(*(F.struct(F.lit(name).alias("name"), F.lit("".join(f"<{i}>" for i in seq)).alias("seq")) for name, seq in rules))
    # What a rule has taken stays as an unknown piece, so that what stood around it doesn't move together.
    step = lambda a, r: F.when(F.contains(a["rest"], r["seq"]), F.struct(F.replace(a["rest"], r["seq"], F.lit("?")).alias("rest"), F.array_append(a["found"], r["name"]).alias("found"))).otherwise(a)
    out = out.withColumn("m", F.when(F.col("rest") != "", F.aggregate(table, acc, step)))
    unmatched = F.coalesce(F.length("m.rest") - F.length(F.replace(F.col("m.rest"), F.lit("<"), F.lit(""))), F.lit(0)).cast("long")
    found = F.array_distinct(F.concat(F.coalesce("m.found", F.array().cast("array<string>")), "spdx"))
    return out.select("doc_id", "n_sentences", "identifiers", F.nullif(F.array_join(found, ", "), F.lit("")).alias("licences"), unmatched.alias("n_unmatched"))


def scan_sql(sentences: tuple[tuple[str, str], ...] = ALL_SENTENCES, rules: tuple[tuple[str, tuple[str, ...]], ...] = ALL_RULES) -> str:
    """The same scan as one SQL statement over ``documents``, but for slots, sentences over several pieces, and SPDX lines with operators."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    table = "MAP {" + ", ".join(f"{quote(s)}: {quote(i)}" for s, i in {s: i for i, s in sentences}.items()) + "}"
    spdx = "MAP {" + ", ".join(f"{quote(a.lower())}: {quote(b)}" for a, b in [(i, i) for i in SPDX] + list(SHORT)) + "}"
    sql = f"""WITH cut AS (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '[.!?:;][ \\t]+|[.!?:;]?[\\n\\r]+'),
  lambda s: trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g'))), lambda s: s <> '') AS said,
  list_filter(list_transform(regexp_extract_all(text, '(?i)SPDX-License-Identifier:[ \\t]*([A-Za-z0-9.+-]+)', 1), lambda s: {spdx}[lower(s)]), lambda s: s IS NOT NULL) AS tags FROM documents),
named AS (SELECT doc_id, tags, coalesce(len(said), 0) AS n, coalesce(list_filter(list_transform(said, lambda s: CASE WHEN regexp_matches(s, '{NEUTRAL}') THEN '' ELSE coalesce({table}[s], '?') END), lambda i: i <> ''), []) AS ids FROM cut),
r0 AS (SELECT doc_id, n, tags, array_to_string(list_filter(ids, lambda i: i <> '?'), ' ') AS identifiers, array_to_string(list_transform(ids, lambda i: CASE WHEN i = '?' THEN i ELSE '<' || i || '>' END), '') AS rest, []::VARCHAR[] AS found FROM named)"""
    for k, (name, seq) in enumerate(rules):
        s = quote("".join(f"<{i}>" for i in seq))
        sql += f",\nr{k + 1} AS (SELECT doc_id, n, tags, identifiers, replace(rest, {s}, '?') AS rest, CASE WHEN contains(rest, {s}) THEN list_append(found, {quote(name)}) ELSE found END AS found FROM r{k})"
    both = f"SELECT *, list_concat(found, coalesce(tags, [])) AS every FROM r{len(rules)}"
    once = "list_filter(every, lambda x, i: list_position(every, x) = i)"
    return sql + f"\nSELECT doc_id, CAST(n AS BIGINT) AS n_sentences, identifiers, nullif(array_to_string({once}, ', '), '') AS licences, CAST(length(rest) - length(replace(rest, '<', '')) AS BIGINT) AS n_unmatched FROM ({both})"
