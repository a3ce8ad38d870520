"""Licence statements by sentence rules. DataFrame functions only."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Licences and the names that notices give them, in the normal form of words.
NAMES = {
    "MIT": ["mit license", "mit"],
    "Apache-2.0": ["apache license version 2.0", "apache license 2.0", "apache 2.0 license", "apache 2.0"],
    "GPL-2.0": ["gnu general public license version 2", "gnu general public license v2.0", "gnu gpl v2", "gplv2", "gpl 2.0", "gpl 2.0 only"],
    "GPL-2.0-or-later": ["gnu general public license version 2 or later", "gplv2 or later", "gpl 2.0 or later"],
    "GPL-3.0": ["gnu general public license version 3", "gnu general public license v3.0", "gnu gpl v3", "gplv3", "gpl 3.0", "gpl 3.0 only"],
    "GPL-3.0-or-later": ["gnu general public license version 3 or later", "gplv3 or later", "gpl 3.0 or later"],
    "LGPL-2.1": ["gnu lesser general public license version 2.1", "gnu lesser general public license v2.1", "lgplv2.1", "lgpl 2.1"],
    "LGPL-3.0": ["gnu lesser general public license version 3", "gnu lesser general public license v3.0", "lgplv3", "lgpl 3.0"],
    "AGPL-3.0": ["gnu affero general public license version 3", "gnu affero general public license v3.0", "agplv3", "agpl 3.0"],
    "GFDL-1.3": ["gnu free documentation license version 1.3", "gfdl 1.3"],
    "BSD": ["bsd license"],
    "BSD-2-Clause": ["bsd 2 clause license", "2 clause bsd license", "simplified bsd license", "bsd 2 clause"],
    "BSD-3-Clause": ["bsd 3 clause license", "3 clause bsd license", "new bsd license", "modified bsd license", "bsd 3 clause"],
    "ISC": ["isc license", "isc"],
    "Zlib": ["zlib license", "zlib"],
    "BSL-1.0": ["boost software license version 1.0", "boost software license 1.0", "bsl 1.0"],
    "MPL-1.1": ["mozilla public license version 1.1", "mozilla public license 1.1", "mpl 1.1"],
    "MPL-2.0": ["mozilla public license version 2.0", "mozilla public license 2.0", "mozilla public license v 2.0", "mpl 2.0"],
    "EPL-1.0": ["eclipse public license version 1.0", "eclipse public license 1.0", "eclipse public license v1.0", "epl 1.0"],
    "EPL-2.0": ["eclipse public license version 2.0", "eclipse public license 2.0", "eclipse public license v2.0", "epl 2.0"],
    "EUPL-1.2": ["european union public license version 1.2", "european union public license 1.2", "eupl 1.2"],
    "CDDL-1.0": ["common development and distribution license version 1.0", "common development and distribution license 1.0", "cddl 1.0"],
    "Artistic-2.0": ["artistic license 2.0", "artistic license version 2.0", "artistic 2.0"],
    "OFL-1.1": ["sil open font license version 1.1", "sil open font license 1.1", "ofl 1.1"],
    "ODbL-1.0": ["open database license", "open data commons open database license", "odbl", "odbl 1.0"],
    "PostgreSQL": ["postgresql license", "postgresql"],
    "Unlicense": ["unlicense"],
    "WTFPL": ["wtfpl"],
    "CC0-1.0": ["cc0 1.0", "cc0", "creative commons zero v1.0 universal", "creative commons cc0 1.0 universal license"],
    "CC-BY-3.0": ["cc by 3.0", "creative commons attribution 3.0 license", "creative commons attribution 3.0 unported license"],
    "CC-BY-4.0": ["cc by 4.0", "creative commons attribution 4.0 license", "creative commons attribution 4.0 international license"],
    "CC-BY-SA-3.0": ["cc by sa 3.0", "creative commons attribution sharealike 3.0 license", "creative commons attribution sharealike 3.0 unported license"],
    "CC-BY-SA-4.0": ["cc by sa 4.0", "creative commons attribution sharealike 4.0 license", "creative commons attribution sharealike 4.0 international license"],
    "CC-BY-NC-4.0": ["cc by nc 4.0", "creative commons attribution noncommercial 4.0 international license"],
    "CC-BY-ND-4.0": ["cc by nd 4.0", "creative commons attribution noderivatives 4.0 international license"],
    "CC-BY-NC-SA-4.0": ["cc by nc sa 4.0", "creative commons attribution noncommercial sharealike 4.0 international license"],
    "CC-BY-NC-ND-4.0": ["cc by nc nd 4.0", "creative commons attribution noncommercial noderivatives 4.0 international license"],
}

#: How a notice begins.
SUBJECTS = ["project", "work", "software", "program", "code", "library", "package", "document", "text", "page", "file", "content"]
VERBS = ["licensed", "released", "distributed", "available"]

#: Identifiers of well-known sentences of licence texts, in the normal form of words.
SENTENCES = {
    "licensed under the apache license version 2.0 the license you may not use this file except in compliance with the license": "ApacheUse",
    "you may obtain a copy of the license at http www.apache.org licenses license 2.0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "ApacheCopy",
    "see the license for the specific language governing permissions and limitations under the license": "ApacheSee",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "MitGrant",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "MitWarranty",
    "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software": "MitLiability",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "Gpl3OrLater",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "Gpl2OrLater",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version": "Agpl3OrLater",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2.1 of the license or at your option any later version": "Lgpl21OrLater",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "GplWarranty",
    "see the gnu general public license for more details": "GplSee",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "BsdGrant",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "IscGrant",
    "this source code form is subject to the terms of the mozilla public license v 2.0": "Mpl2Notice",
    "this is free and unencumbered software released into the public domain": "UnlicenseGrant",
    "this work is dedicated to the public domain": "PublicDomain",
    "all rights reserved": "AllRights",
}

#: Ordered rules: a sequence of sentence identifiers and what it says. A rule takes its sentences from later ones.
RULES = [
    (("ApacheUse", "ApacheCopy", "ApacheSee"), "Apache-2.0"),
    (("MitGrant", "MitWarranty", "MitLiability"), "MIT"),
    (("Gpl3OrLater", "GplWarranty", "GplSee"), "GPL-3.0-or-later"),
    (("AllRights", "BsdGrant"), "BSD"),
    (("ApacheUse",), "Apache-2.0"),
    (("MitGrant",), "MIT"),
    (("Gpl3OrLater",), "GPL-3.0-or-later"),
    (("Gpl2OrLater",), "GPL-2.0-or-later"),
    (("Agpl3OrLater",), "AGPL-3.0-or-later"),
    (("Lgpl21OrLater",), "LGPL-2.1-or-later"),
    (("BsdGrant",), "BSD"),
    (("IscGrant",), "ISC"),
    (("Mpl2Notice",), "MPL-2.0"),
    (("UnlicenseGrant",), "Unlicense"),
    (("PublicDomain",), "public-domain"),
    (("AllRights",), "all-rights-reserved"),
    (("Unknown",), "unknown"),
    *[((f"Ref {licence}",), licence) for licence in NAMES],
]

#: Every way to begin a notice is the same word to the lookup, so names need no sentence for each of them.
LEAD = rf"^(?:(?:this (?:{'|'.join(SUBJECTS)}) is )?(?:{'|'.join(VERBS)}) under (?:the terms of )?(?:the |a |an )?|spdx license identifier )"


def canonical(sentence: str) -> str:
    return re.sub(LEAD, "under ", sentence)


KNOWN = {
    **{f"under {name}": f"Ref {licence}" for licence, names in NAMES.items() for name in names},
    **{canonical(sentence): name for sentence, name in SENTENCES.items()},
}
#: The first two words of every known sentence, or the only one of a piece.
STARTS = sorted(
    {" ".join(s.split(" ")[:n]) for s in SENTENCES for n in (1, 2)}
    | {*VERBS, *[f"{v} under" for v in VERBS], "this", *[f"this {s}" for s in SUBJECTS], "spdx", "spdx license"}
)
#: No form of a known sentence is longer; a longer run of pieces can't be one.
LONGEST = max(map(len, KNOWN)) + 80
MOST_WORDS = max(s.count(" ") for s in KNOWN) + 12

#: A run of pieces beyond SHORT has its whole lead; it can only become a known sentence if it begins like one.
SHORT = 60
HEADS = sorted({" ".join(s.split(" ")[:n]) for s in KNOWN for n in range(1, 5)})

#: Ends of pieces of text.
MARK = "\u0001"
#: Beginnings of words of which every sentence that counts has one (without looking at case).
SPEAKS = "licen[sc]|copyright|warrant|permi|reserved|domain|under"


def pieces(text: Column) -> Column:
    """Pieces of the text as their words, in lower case and parted by single spaces. A word is a run of a-z, 0-9 and inner dots.

    A piece ends at . ! or ? before white space, at an empty line, and at a line end before a capital letter. A
    sentence is one piece or several: lines are also wrapped before capital letters.
    """
    cut = F.regexp_replace(text, "([.!?])[ \\t\\r\\n]+", "$1" + MARK)
    cut = F.regexp_replace(cut, "\\n[ \\t\\r]*([A-Z\\n])", MARK + "$1")
    words = F.regexp_extract_all(cut, F.lit(MARK + "|[A-Za-z0-9]+(?:\\.[A-Za-z0-9]+)*"), F.lit(0))
    said = F.replace(F.lower(F.array_join(words, " ")), F.lit("licence"), F.lit("license"))
    return F.filter(F.transform(F.split(said, MARK), lambda s: F.btrim(s)), lambda s: s != "")


def _bound(value: Column, use) -> Column:  # noqa: ANN001
    """use(value), with the value made once."""
    return F.transform(F.array(value), use)[0]


def _found(parts: Column) -> Column:
    """For each piece (length, id) of the longest known sentence that begins there; its length is counted in pieces.

    Known sentences are looked up in one hash set, so the cost doesn't depend on their number.
    """
    ids = F.create_map(*[F.lit(x) for pair in KNOWN.items() for x in pair])

    def longer(state: Column, piece: Column) -> Column:
        def looked_up(both: Column) -> Column:
            hit = both["form"].isin(list(KNOWN))
            open_end = (F.length(both["joined"]) <= SHORT) | F.substring_index(both["form"], " ", 4).isin(HEADS) & (F.length(both["joined"]) <= LONGEST)
            return F.struct(
                F.when(open_end, both["joined"]).alias("joined"), (state["n"] + 1).alias("n"),
                F.when(hit, state["n"] + 1).otherwise(state["length"]).alias("length"),
                F.when(hit, both["form"]).otherwise(state["form"]).alias("form"),
            )

        joined = F.btrim(F.concat_ws(" ", state["joined"], piece))
        grown = _bound(joined, lambda j: _bound(F.struct(j.alias("joined"), F.regexp_replace(j, LEAD, "under ").alias("form")), looked_up))
        return F.when(state["joined"].isNull(), state).otherwise(grown)

    def longest(i: Column) -> Column:
        start = F.struct(F.lit("").alias("joined"), F.lit(0).alias("n"), F.lit(0).alias("length"), F.lit("").alias("form"))
        return F.aggregate(F.slice(parts, i + 1, MOST_WORDS), start, longer, lambda s: F.struct(s["length"].alias("length"), s["form"].alias("form")))

    def other(piece: Column) -> Column:
        speaks = piece.contains("licens") | piece.contains("licenc") | piece.contains("copyright")
        return F.struct(F.lit(0).alias("length"), F.when(speaks, "Unknown").otherwise("").alias("id"))

    def one(piece: Column, i: Column) -> Column:
        known = _bound(longest(i), lambda h: F.when(h["length"] > 0, F.struct(h["length"].alias("length"), F.element_at(ids, h["form"]).alias("id"))))
        return F.coalesce(F.when(F.substring_index(piece, " ", 2).isin(STARTS), known), other(piece))

    return F.transform(parts, one)


def statement_ids(text: Column) -> Column:
    """Identifiers of the sentences in reading order, each as <id>.

    Of two known sentences where one begins inside the other, the one that begins first counts; at one place the
    longer one does.
    """

    def told(found: Column) -> Column:
        most = F.array_max(F.transform(found, lambda h: h["length"]))

        def within_another(j: Column, reach: Column) -> Column:
            back = F.least(reach - 1, j)
            return F.when(back >= 1, F.exists(F.sequence(F.lit(1), back), lambda k: F.get(found, j - k)["length"] > k)).otherwise(False)

        return _bound(most, lambda reach: F.array_join(
            F.transform(found, lambda h, j: F.when((h["id"] == "") | within_another(j, reach), "").otherwise(F.concat(F.lit("<"), h["id"], F.lit(">")))), ""
        ))

    return _bound(pieces(text), lambda parts: _bound(_found(parts), told))


def license_statements(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, rule, licence, statements): what each document says about its licence.

    Sentences are looked up among the known ones, however their lines are wrapped; another piece that speaks of a
    licence or copyright counts as Unknown and the rest is skipped. The identifiers in reading order are matched
    against the ordered rules. All work stays inside the row: nothing is shuffled, and a repeated or null id changes
    nothing. Null and empty texts say nothing and give no row.
    """
    rules = F.array(*[
        F.struct(F.lit(n).alias("rule"), F.lit("".join(f"<{x}>" for x in ids)).alias("ids"), F.lit(name).alias("licence"))
        for n, (ids, name) in enumerate(RULES)
    ])
    empty = F.array().cast("array<struct<rule:int,licence:string,statements:int>>")

    def apply(state: Column, rule: Column) -> Column:
        times = (F.length(state["told"]) - F.length(F.replace(state["told"], rule["ids"], F.lit("")))) / F.length(rule["ids"])
        hit = F.struct(rule["rule"].alias("rule"), rule["licence"].alias("licence"), times.cast("int").alias("statements"))
        return F.struct(
            F.replace(state["told"], rule["ids"], F.lit("<>")).alias("told"),
            F.when(times > 0, F.array_append(state["found"], hit)).otherwise(state["found"]).alias("found"),
        )

    speaking = docs.where(F.col(text).rlike(f"(?i){SPEAKS}"))
    rows = speaking.select(F.col(id_column).alias("doc_id"), statement_ids(F.col(text)).alias("told")).where("told <> ''")
    found = F.aggregate(rules, F.struct(F.col("told"), empty.alias("found")), apply, lambda state: state["found"])
    return rows.select("doc_id", F.explode(found).alias("hit")).select("doc_id", "hit.rule", "hit.licence", "hit.statements")
