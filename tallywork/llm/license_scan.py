"""Licence recognition by sentences and ordered rules; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywork.llm.common import page_texts

#: Known licence sentences. A sentence is compared in normal form (lower case, every run of other characters
#: than letters and digits one space); the first pattern found in it names it.
SENTENCES = (
    ("bsd_redistribution", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd_source", "redistributions of source code must retain the above copyright notice"),
    ("bsd_binary", "redistributions in binary form must reproduce the above copyright notice"),
    ("bsd_endorse", "neither the name of .* may be used to endorse or promote products derived from this software"),
    ("mit_grant", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit_notice", "the above copyright notice and this permission notice shall be included in all copies"),
    ("isc_grant", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mit_name", "(released|licensed|distributed|available) under the (terms of the )?mit licen[cs]e"),
    ("apache_name", "(released|licensed|distributed) under the apache licen[cs]e version 2 0"),
    ("apache_use", "you may not use this file except in compliance with the licen[cs]e"),
    ("apache_copy", "you may obtain a copy of the licen[cs]e at"),
    ("apache_basis", "software distributed under the licen[cs]e is distributed on an as is basis"),
    ("apache_limits", "see the licen[cs]e for the specific language governing permissions and limitations"),
    ("lgpl_redistribute", "redistribute it and or modify it under the terms of the gnu (lesser|library) general public licen[cs]e"),
    ("agpl_redistribute", "redistribute it and or modify it under the terms of the gnu affero general public licen[cs]e"),
    ("gpl_redistribute", "redistribute it and or modify it under the terms of the gnu general public licen[cs]e"),
    ("gpl_or_later", "either version [0-9]( [0-9])? of the licen[cs]e or at your option any later version"),
    ("gpl_name_3", "(released|licensed|distributed) under the (terms of the )?gnu general public licen[cs]e version 3"),
    ("gpl_name_2", "(released|licensed|distributed) under the (terms of the )?gnu general public licen[cs]e version 2"),
    ("gpl_hope", "this program is distributed in the hope that it will be useful but without any warranty"),
    ("gpl_copy", "you should have received a copy of the gnu (lesser |affero )?general public licen[cs]e"),
    ("mpl_terms", "this source code form is subject to the terms of the mozilla public licen[cs]e v 2 0"),
    ("cc_by_nc", "(released|licensed|available) under (the )?(a )?(cc|creative commons) by nc 4 0"),
    ("cc_by_sa", "(released|licensed|available) under (the )?(a )?(cc|creative commons) by sa 4 0"),
    ("cc_by", "(released|licensed|available) under (the )?(a )?(cc|creative commons) by 4 0"),
    ("cc_zero", "(dedicated|released) (to|into) the public domain"),
    ("as_is", "(the|this) software is provided (by .*)?as is"),
    ("no_liability", "in no event shall .* be liable for any"),
    ("all_rights", "all rights reserved"),
    ("copyright_line", "copyright (c )?[0-9]{4}"),
)

#: Rules in order, each a licence and a pattern over the identifiers of a page's licence sentences, which are
#: written one after another, each followed by a comma. What a rule has matched isn't open to later ones.
RULES = (
    ("BSD-3-Clause", "bsd_redistribution,bsd_source,bsd_binary,bsd_endorse,(as_is,)?(no_liability,)?"),
    ("BSD-2-Clause", "bsd_redistribution,bsd_source,bsd_binary,(as_is,)?(no_liability,)?"),
    ("MIT", "(mit_name,)?mit_grant,mit_notice,(as_is,)?(no_liability,)?"),
    ("ISC", "isc_grant,(as_is,)?(no_liability,)?"),
    ("Apache-2.0", "apache_name,(apache_use,)?(apache_copy,)?(apache_basis,)?(apache_limits,)?"),
    ("LGPL-or-later", "lgpl_redistribute,(gpl_or_later,)?(gpl_hope,)?(gpl_copy,)?"),
    ("AGPL-or-later", "agpl_redistribute,(gpl_or_later,)?(gpl_hope,)?(gpl_copy,)?"),
    ("GPL-or-later", "gpl_redistribute,(gpl_or_later,)?(gpl_hope,)?(gpl_copy,)?"),
    ("GPL-3.0", "gpl_name_3,"),
    ("GPL-2.0", "gpl_name_2,"),
    ("MPL-2.0", "mpl_terms,"),
    ("CC-BY-NC-4.0", "cc_by_nc,"),
    ("CC-BY-SA-4.0", "cc_by_sa,"),
    ("CC-BY-4.0", "cc_by,"),
    ("MIT", "mit_name,"),
    ("public-domain", "cc_zero,"),
    ("all-rights-reserved", "(copyright_line,)?all_rights,"),
)

# Headers of the GNU licences, with the versions that they grant. The SQL twin takes SENTENCES, RULES and HINTS as they stand and
# gives a sentence one name; these go beyond it.
_TERMS = "redistribute it and or modify it under the terms of"
_GPL = "the gnu (lesser |library |affero )?general public licen[cs]e"
_OF = f"( of (the licen[cs]e|{_GPL}))?( as published by the free software foundation)?"
_LATER = f"{_OF} or (at your option )?(any )?(later|newer)"
_HEADER = f"{_TERMS} ({_GPL}( a?l?gpl)?( as published by the (free software foundation|fsf)( inc)?)?( either| under| only)* v(ersion )?|version )"


def _version(number: str) -> str:
    number = rf"{number}(?! [0-9]\b)(?!{_LATER}\b)"
    return (f"{_HEADER}{number}|^(either )?version {number} of the licen[cs]e|"
            f"either version [0-9]( [0-9])?{_OF} or (at your option )?version {number}")


#: Patterns that stand for those of SENTENCES with the same names, or come after them.
VERSIONS = {
    **{f"{k}gpl_redistribute": f"{_TERMS} (version [0-9]( [0-9])? of )?the gnu {word}general public licen[cs]e"
       for k, word in (("l", "(lesser|library) "), ("a", "affero "), ("", ""))},
    "gpl_or_later": f"either version [0-9]( [0-9])?{_OF} or (at your option )?any later version|"
                    f"^version [0-9]( [0-9])?{_OF} or at your option any later version|{_HEADER}[0-9]( [0-9])?{_LATER}",
    "gnu_version_1": _version("1( 0)?"), "gnu_version_2": _version("2( 0)?"), "gnu_version_21": _version("2 1"),
    "gnu_version_3": _version("3( 0)?"),
}
_PATTERNS = {**dict(SENTENCES), **VERSIONS}

#: In place of the or-later rules, those that need the grant, one version, and none.
GNU_RULES = tuple(
    (licence + name, f"{licence.lower()}_redistribute,{version}(gpl_hope,)?(gpl_copy,)?")
    for licence in ("LGPL", "AGPL", "GPL") for name, version in (
        ("-or-later", "gpl_or_later,"), ("-1.0", "gnu_version_1,"), ("-2.0", "gnu_version_2,"), ("-2.1", "gnu_version_21,"),
        ("-3.0", "gnu_version_3,"), ("", ""))
) + tuple((f"{licence}-3.0", rf"(?<=<{licence}-2\.[01]>)gnu_version_3,(gpl_hope,)?(gpl_copy,)?") for licence in ("LGPL", "GPL"))
_RULES = (*GNU_RULES, *(r for r in RULES if not r[0].endswith("-or-later")))

#: Licence words. In the normal form, a sentence without any of these or of MORE_HINTS can't be a licence sentence.
HINTS = "licen[cs]e|copyright|redistribut|permission|rights reserved|public domain|under cc|creative commons|as.is|liable|of the gnu|endorse|warrant"
#: Further ones, which the SQL twin doesn't know: it looks for HINTS in the sentence as written, with one blank for white space.
MORE_HINTS = f"under (the )?(a )?cc|{VERSIONS['gpl_or_later']}"
#: A sentence that isn't known has a licence word by one of these in the normal form, or by AS_IS as written: "as, is" is none.
AS_IS = "as.is"
WORDS = "|".join([*(h for h in HINTS.split("|") if h != AS_IS), MORE_HINTS])
UNKNOWN = "unknown"

SENTENCE_END = r"(?<=[.!?;:])\s+"


def normal_form(sentence: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(sentence), "[^a-z0-9]+", " "))


def _identifiers(sentence: Column) -> Column:
    """The names of all known sentences in a normalised one, by their places, each once; none in an unknown one."""
    found = F.array(*(
        F.struct(F.regexp_instr(sentence, F.lit(rf"\b(?:{pattern})\b")).alias("place"), F.lit(i).alias("nr"), F.lit(name).alias("name"))
        for i, (name, pattern) in enumerate(_PATTERNS.items())))
    return F.transform(F.array_sort(F.filter(found, lambda x: x["place"] > 0)), lambda x: x["name"])


def scan_licenses(pages: DataFrame) -> DataFrame:
    """(page_id, licenses, sentences, n_known, n_unknown) for each row of ``pages(page_id, html)``.

    A text is cut into sentences after . ! ? ; : and white space. Those with a licence word in their normal form, where wrapped
    and commented lines read as one, are mapped to the identifiers of all known sentences in them (SENTENCES, VERSIONS); ``sentences`` lists them by their places. GNU_RULES
    and RULES are tried in their order on the sequence of known ones. ``licenses`` holds the licences found, in the order of the text,
    each once. A GNU licence is named with the version that its header grants, "or-later" or neither. ``n_known`` counts sentences that
    hold a known one, ``n_unknown`` those with a licence word that hold none. Missing and empty texts have empty lists.

    Row by row, no shuffle. All but the sentences with a licence word are dropped by one pattern before the rest.
    """
    split = page_texts(pages).select("page_id", F.filter(
        F.transform(F.split("html", SENTENCE_END), lambda s: F.struct(s.alias("written"), normal_form(s).alias("normal"))),
        lambda s: s["normal"].rlike(f"{HINTS}|{MORE_HINTS}")).alias("candidates"))
    named = split.select("page_id", F.filter(
        F.transform("candidates", lambda s: F.struct(_identifiers(s["normal"]).alias("names"), (
            s["normal"].rlike(WORDS) | F.regexp_replace(s["written"], r"\s+", " ").rlike(f"(?i){AS_IS}")).alias("hinted"))),
        lambda s: s["hinted"] | (F.size(s["names"]) > 0))["names"].alias("names"))
    known = named.select(
        "page_id", F.flatten(F.transform("names", lambda n: F.when(F.size(n) > 0, n).otherwise(F.array(F.lit(UNKNOWN))))).alias("sentences"),
        F.flatten("names").alias("known"), F.size(F.filter("names", lambda n: F.size(n) > 0)).alias("n_known"),
        F.size("names").alias("n_sentences")).withColumn(
        "sequence", F.when(F.size("known") > 0, F.concat(F.lit(","), F.array_join("known", ","), F.lit(","))).otherwise(F.lit("")))
    sequence = F.col("sequence")
    for licence, pattern in _RULES:
        # a licence found is written as "<name>", which no pattern of identifiers meets
        sequence = F.regexp_replace(sequence, f"(?<=[,>]){pattern}", f"<{licence}>")
    found = F.regexp_extract_all(sequence, F.lit("<([^>]*)>"), 1)
    return known.select(
        "page_id", F.array_distinct(found).alias("licenses"), "sentences", F.col("n_known").cast("long").alias("n_known"),
        (F.col("n_sentences") - F.col("n_known")).cast("long").alias("n_unknown"))
