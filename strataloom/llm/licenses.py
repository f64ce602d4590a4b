"""Licence scans by sentence rules.

1. A text is normalised (comment marks at line starts go, white space runs
   become one space, lower case) and cut into sentences; a licence tag stays
   together with its value, and one of several values becomes a sentence for
   each.
2. Each sentence that speaks of licences gets the identifier of the first
   sentence pattern that it matches, or ``unknown``.
3. The sequence of identifiers is matched against ordered licence rules, each
   a sequence of identifiers; what a rule matches is taken out before the next
   rule is tried.

Only built-in functions are used, and :func:`oracle` writes the same rules as
DuckDB SQL.

Defined results: null and empty texts, and texts without licence sentences,
have empty strings and zero counts; a licence that several passages state is
named once, in rule order; repeated rows are scanned each; very long texts are
scanned whole; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of licence sentences: each pattern below implies one of them.
HINT = "licen[cs]e|copyright|warrant(y|ies)|redistribut|permission is hereby|permission to use, copy|public domain|all rights reserved|creative commons|cc by|cc0|endorse or promote|spdx-"

#: Licences that tags name (fixed values).
TAGS = (
    "Apache-2.0 MIT MIT-0 ISC 0BSD BSD-2-Clause BSD-3-Clause BSL-1.0 Zlib Unlicense WTFPL Artistic-2.0 EPL-1.0 EPL-2.0 MPL-1.1 MPL-2.0 "
    "GPL-1.0-or-later GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later LGPL-2.0-only LGPL-2.0-or-later LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later AGPL-3.0-only AGPL-3.0-or-later "
    "CC0-1.0 CC-BY-4.0 CC-BY-3.0 CC-BY-SA-4.0 CC-BY-SA-3.0 CC-BY-NC-4.0 CC-BY-ND-4.0 CC-BY-NC-SA-4.0 CC-BY-NC-ND-4.0 Python-2.0 OFL-1.1"
).split()
#: Tags that older texts use, and what they mean (fixed values).
OLD_TAGS = {
    "GPL-2.0": "GPL-2.0-only", "GPL-2.0+": "GPL-2.0-or-later", "GPL-3.0": "GPL-3.0-only", "GPL-3.0+": "GPL-3.0-or-later", "LGPL-2.1": "LGPL-2.1-only", "LGPL-2.1+": "LGPL-2.1-or-later",
    "LGPL-3.0": "LGPL-3.0-only", "LGPL-3.0+": "LGPL-3.0-or-later", "AGPL-3.0": "AGPL-3.0-only",
}

#: Sentence patterns, tried in this order on lower-case sentences (fixed values).
PHRASES = [
    ("agplLater", r"gnu affero general public licen[cs]e.*(or later|any later version)"),
    ("agpl3", r"gnu affero general public licen[cs]e"),
    ("lgplVersion21Later", r"gnu lesser general public licen[cs]e.*version 2\.1.*(or later|any later version)"),
    ("lgplVersion3Later", r"gnu lesser general public licen[cs]e.*version 3.*(or later|any later version)"),
    ("lgplVersion21", r"gnu lesser general public licen[cs]e.*version 2\.1"),
    ("lgplVersion3", r"gnu lesser general public licen[cs]e.*version 3"),
    ("lgpl", r"gnu lesser general public licen[cs]e"),
    ("gplVersion3Later", r"under the (terms of the )?gnu general public licen[cs]e.*version 3.*(or later|any later version)"),
    ("gplVersion2Later", r"under the (terms of the )?gnu general public licen[cs]e.*version 2.*(or later|any later version)"),
    ("gplVersion3", r"under the (terms of the )?gnu general public licen[cs]e.*version 3"),
    ("gplVersion2", r"under the (terms of the )?gnu general public licen[cs]e.*version 2"),
    ("gplFree", r"redistribute it and/or modify it under the terms of the gnu general public licen[cs]e"),
    ("gplHope", r"in the hope that it will be useful, but without any warranty"),
    ("gplCopy", r"received a copy of the gnu general public licen[cs]e"),
    ("apache2Under", r"under the (terms of the )?apache licen[cs]e,? (version )?2\.0"),
    ("apache2Obtain", r"you may obtain a copy of the licen[cs]e at"),
    ("apacheAsIs", r"distributed under the licen[cs]e is distributed on an .?as is.? basis"),
    ("mitUnder", r"under the (terms of the )?mit licen[cs]e"),
    ("mitGrant", r"permission is hereby granted, free of charge, to any person obtaining a copy"),
    ("mitNotice", r"copyright notice and this permission notice shall be included"),
    ("softwareAsIs", r"software is provided .?as is.?,? without warranty"),
    ("iscUnder", r"under the (terms of the )?isc licen[cs]e"),
    ("iscGrant", r"permission to use, copy, modify, and(/or)? distribute this software for any purpose with or without fee is hereby granted"),
    ("iscAsIs", r"software is provided .?as is.? and the author disclaims all warranties"),
    ("unlicenseFree", r"free and unencumbered software released into the public domain"),
    ("boost1", r"boost software licen[cs]e"),
    ("zlibUnder", r"under the (terms of the )?zlib licen[cs]e"),
    ("artistic2", r"artistic licen[cs]e,? (version )?2\.0"),
    ("eclipse2", r"eclipse public licen[cs]e,? (- )?(v\.? ?|version )?2\.0"),
    ("eclipse1", r"eclipse public licen[cs]e,? (- )?(v\.? ?|version )?1\.0"),
    ("mpl2", r"mozilla public licen[cs]e,? (v\. ?|version )2\.0"),
    ("wtfpl", r"do what the fuck you want to public licen[cs]e"),
    ("ofl11", r"sil open font licen[cs]e,? (version )?1\.1"),
    ("ccByNcSa4", r"under (the |a )?(cc by-nc-sa 4\.0|creative commons attribution-noncommercial-sharealike 4\.0)"),
    ("ccByNcNd4", r"under (the |a )?(cc by-nc-nd 4\.0|creative commons attribution-noncommercial-noderivatives 4\.0)"),
    ("ccByNc4", r"under (the |a )?(cc by-nc 4\.0|creative commons attribution-noncommercial 4\.0)"),
    ("ccByNd4", r"under (the |a )?(cc by-nd 4\.0|creative commons attribution-noderivatives 4\.0)"),
    ("ccBySa4", r"under (the |a )?(cc by-sa 4\.0|creative commons attribution-sharealike 4\.0)"),
    ("ccBySa3", r"under (the |a )?(cc by-sa 3\.0|creative commons attribution-sharealike 3\.0)"),
    ("ccBy4", r"under (the |a )?(cc by 4\.0|creative commons attribution 4\.0)"),
    ("ccBy3", r"under (the |a )?(cc by 3\.0|creative commons attribution 3\.0)"),
    ("cc0", r"(cc0 1\.0|dedicated to the public domain)"),
    ("bsdGrant", r"redistribution and use in source and binary forms"),
    ("bsdSource", r"redistributions of source code must retain"),
    ("bsdBinary", r"redistributions in binary form must reproduce"),
    ("bsdNames", r"may be used to endorse or promote products"),
    ("allRights", r"all rights reserved"),
    ("copyright", r"copyright (\(c\) |© )?[0-9][0-9][0-9][0-9]"),
]

#: Licence rules, tried in this order after those of the tags (fixed values).
NAMED = [
    ("Apache-2.0", ["apache2Under", "apache2Obtain", "apacheAsIs"]),
    ("Apache-2.0", ["apache2Under"]),
    ("MIT", ["mitUnder"]),
    ("MIT", ["mitGrant", "mitNotice", "softwareAsIs"]),
    ("MIT", ["mitGrant", "softwareAsIs"]),
    ("MIT-grant-only", ["mitGrant"]),
    ("ISC", ["iscGrant", "iscAsIs"]),
    ("ISC", ["iscGrant"]),
    ("ISC", ["iscUnder"]),
    ("AGPL-3.0-or-later", ["agplLater"]),
    ("AGPL-3.0-only", ["agpl3"]),
    ("LGPL-2.1-or-later", ["lgplVersion21Later"]),
    ("LGPL-3.0-or-later", ["lgplVersion3Later"]),
    ("LGPL-2.1-only", ["lgplVersion21"]),
    ("LGPL-3.0-only", ["lgplVersion3"]),
    ("LGPL", ["lgpl"]),
    ("GPL-3.0-or-later", ["gplVersion3Later", "gplHope", "gplCopy"]),
    ("GPL-2.0-or-later", ["gplVersion2Later", "gplHope", "gplCopy"]),
    ("GPL-3.0-or-later", ["gplVersion3Later"]),
    ("GPL-2.0-or-later", ["gplVersion2Later"]),
    ("GPL-3.0-only", ["gplVersion3"]),
    ("GPL-2.0-only", ["gplVersion2"]),
    ("GPL", ["gplFree", "gplHope", "gplCopy"]),
    ("GPL", ["gplFree"]),
    ("Unlicense", ["unlicenseFree"]),
    ("BSL-1.0", ["boost1"]),
    ("Zlib", ["zlibUnder"]),
    ("Artistic-2.0", ["artistic2"]),
    ("EPL-2.0", ["eclipse2"]),
    ("EPL-1.0", ["eclipse1"]),
    ("MPL-2.0", ["mpl2"]),
    ("WTFPL", ["wtfpl"]),
    ("OFL-1.1", ["ofl11"]),
    ("CC-BY-NC-SA-4.0", ["ccByNcSa4"]),
    ("CC-BY-NC-ND-4.0", ["ccByNcNd4"]),
    ("CC-BY-NC-4.0", ["ccByNc4"]),
    ("CC-BY-ND-4.0", ["ccByNd4"]),
    ("CC-BY-SA-4.0", ["ccBySa4"]),
    ("CC-BY-SA-3.0", ["ccBySa3"]),
    ("CC-BY-4.0", ["ccBy4"]),
    ("CC-BY-3.0", ["ccBy3"]),
    ("CC0-1.0", ["cc0"]),
    ("BSD-3-Clause", ["bsdGrant", "bsdSource", "bsdBinary", "bsdNames"]),
    ("BSD-2-Clause", ["bsdGrant", "bsdSource", "bsdBinary"]),
    ("AllRightsReserved", ["copyright", "allRights"]),
    ("AllRightsReserved", ["allRights"]),
]

TAG = "spdx-license-identifier"


def _tag_pattern(name: str) -> str:
    escaped = name.lower().replace(".", r"\.").replace("+", r"\+")
    return rf"^{TAG} \(*{escaped}[).,;]*( |$)"


#: All sentence patterns and rules: those of the tags come first.
SENTENCES = [(f"tag{t}", _tag_pattern(t)) for t in (*TAGS, *OLD_TAGS)] + PHRASES
RULES = [(t, [f"tag{t}"]) for t in TAGS] + [(new, [f"tag{old}"]) for old, new in OLD_TAGS.items()] + NAMED
#: Values of a tag that are told apart.
TAG_VALUES = 4


def licence_names() -> list[str]:
    return list(dict.fromkeys(name for name, _ in RULES))


def _sequence(ids: list[str]) -> str:
    return "".join(f"<{i}>" for i in ids)


def sentences(text: Column) -> Column:
    """Normalised sentences of a text."""
    plain = F.regexp_replace(F.lower(text), r"(^|\n)[ \t]*(//+|[#*;]+|--+)", "$1 ")
    flat = F.regexp_replace(plain, r"[\x20\x09-\x0D]+", " ")
    flat = F.replace(flat, F.lit(f"{TAG}: "), F.lit(f"\n{TAG} "))
    for _ in range(TAG_VALUES - 1):
        flat = F.regexp_replace(flat, rf"{TAG} ([^ \n]+) (or|and) ", f"{TAG} $1\n{TAG} ")
    return F.split(F.regexp_replace(flat, r"([.!?;:]) ", "$1\n"), "\n")


def sentence_id(sentence: Column) -> Column:
    """The identifier of a sentence; null if it doesn't speak of licences."""
    s = F.trim(sentence)
    out = F.when(~s.rlike(HINT), F.lit(None).cast("string"))
    for name, pattern in SENTENCES:
        out = out.when(s.rlike(pattern), name)
    return out.otherwise("unknown")


def _matched(ids: Column) -> Column:
    """The licences of a sequence of identifiers, in rule order: rules are folded over the rest of the sequence."""
    rules = F.array(*[F.struct(F.lit(_sequence(wanted)).alias("seq"), F.lit(name).alias("name")) for name, wanted in RULES])
    start = F.struct(F.concat(F.lit("<"), F.array_join(ids, "><"), F.lit(">")).alias("rest"), F.array().cast("array<string>").alias("names"))

    def step(acc: Column, rule: Column) -> Column:
        met = F.struct(F.replace(acc["rest"], rule["seq"], F.lit("|")).alias("rest"), F.array_append(acc["names"], rule["name"]).alias("names"))
        return F.when(F.contains(acc["rest"], rule["seq"]), met).otherwise(acc)

    found = F.aggregate(rules, start, step, lambda acc: acc["names"])
    none = F.array().cast("array<string>")
    return F.when(F.size(ids) > 0, F.array_intersect(F.array(*[F.lit(n) for n in licence_names()]), found)).otherwise(none)


def scan_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_sentences`` (of licences), ``sentence_ids``, ``licenses`` and ``n_unknown``; no shuffle."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    ids = F.filter(F.transform(sentences(text), sentence_id), lambda x: x.isNotNull())
    # a sentence that has a hint lies in a text that has it: comment marks and white space inside one don't hide it
    ids = F.when(F.regexp_replace(F.lower(text), r"[\x20\x09-\x0D/#*;-]+", " ").rlike(LOOSE_HINT), ids).otherwise(F.array().cast("array<string>"))
    out = docs.select(F.col(id_col), ids.alias("ids"))
    return out.select(
        id_col,
        F.size("ids").cast("long").alias("n_sentences"),
        F.array_join("ids", ",").alias("sentence_ids"),
        F.array_join(_matched(F.col("ids")), ",").alias("licenses"),
        F.size(F.filter("ids", lambda x: x == "unknown")).cast("long").alias("n_unknown"),
    )


#: HINT on a text whose comment marks are spaces.
LOOSE_HINT = HINT.replace("spdx-", "spdx ")


def oracle() -> str:
    """The same scan as DuckDB SQL, without the look at the whole text that saves time."""
    case = " ".join(f"when regexp_matches(trim(x, ' '), '{p}') then '{n}'" for n, p in SENTENCES)
    tags = "replace(regexp_replace(t, '[\\x20\\x09-\\x0D]+', ' ', 'g'), '" + TAG + ": ', chr(10) || '" + TAG + " ')"
    for _ in range(TAG_VALUES - 1):
        tags = f"regexp_replace({tags}, '{TAG} ([^ \\n]+) (or|and) ', '{TAG} \\1' || chr(10) || '{TAG} ', 'g')"
    rules = ", ".join(f"'{_sequence(wanted)}' || chr(2) || '{name}'" for name, wanted in RULES)
    names = ", ".join(f"'{n}'" for n in licence_names())
    rest, seq = "split_part(a, chr(1), 1)", "split_part(r, chr(2), 1)"
    return rf"""
with plain as (
  select doc_id, regexp_replace(lower(coalesce(text, '')), '(^|\n)[ \t]*(//+|[#*;]+|--+)', '\1 ', 'g') t from documents
), flat as (
  select doc_id, regexp_replace({tags}, '([.!?;:]) ', '\1' || chr(10), 'g') p from plain
), base as (
  select doc_id, list_filter(list_transform(string_split(p, chr(10)), lambda x: case when not regexp_matches(trim(x, ' '), '{HINT}') then null {case} else 'unknown' end), lambda x: x is not null) ids from flat
), folded as (
  select *, case when len(ids) > 0 then list_reduce(list_prepend('<' || array_to_string(ids, '><') || '>' || chr(1) || ',', [{rules}]),
    lambda a, r: case when contains({rest}, {seq}) then replace({rest}, {seq}, '|') || chr(1) || split_part(a, chr(1), 2) || split_part(r, chr(2), 2) || ',' else a end) else '' end f from base
)
select doc_id, len(ids)::bigint n_sentences, array_to_string(ids, ',') sentence_ids,
  array_to_string(list_filter([{names}], lambda n: contains(split_part(f, chr(1), 2), ',' || n || ',')), ',') licenses,
  len(list_filter(ids, lambda x: x = 'unknown'))::bigint n_unknown
from folded
"""
