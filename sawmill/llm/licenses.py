"""Licence scan by sentence rules.

A text is cut into sentences. Each sentence is normalised and mapped to the identifiers of all known
phrases in it, in order of position. Scope is settled within the sentence: a licence's name counts after a grant
("licensed under ..."), and not after a negation ("not licensed under ..."). The document's
sequence of identifiers is matched against ordered licence rules: at each place the first rule whose
identifiers follow one another there wins and consumes them. Other sentences don't interrupt a sequence.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sawmill.llm.common import SPACE, col, text_of

LICENSE = r"licen[cs]e"
_AFTER = rf"(?: (?:international|unported|generic|universal|public|{LICENSE}|version|v))*"


def _number(number: str) -> str:
    """A version's digits as they stand in a normalised sentence: ``2.0`` as "2" or "2 0"."""
    major, minor = number.split(".")
    return rf"{major}(?: 0)?" if minor == "0" else f"{major} {minor}"


def _version(number: str) -> str:
    """A version right after a name: "2 0", "v2", "version 2" and the like."""
    return rf"(?: ?version| ?v)? ?{_number(number)}"


# GNU families (names over the normalised sentence: lower case, runs of other characters
# than a-z and 0-9 as one space) with their published versions, the longer version first.
GNU = [
    ("agpl", "AGPL", rf"(?:gnu )?affero general public {LICENSE}|gnu agpl|agpl", ["3.0", "1.0"]),
    ("lgpl", "LGPL", rf"(?:gnu )?(?:lesser|library) general public {LICENSE}|gnu lgpl|lgpl", ["2.1", "3.0", "2.0"]),
    ("gpl", "GPL", rf"(?:gnu )?general public {LICENSE}|gnu gpl|gpl", ["3.0", "2.0", "1.0"]),
]

# Licences that are named with a version.
VERSIONED = [
    ("Apache", rf"apache(?: software)?(?: {LICENSE})?", ["2.0", "1.1", "1.0"]),
    ("MPL", rf"mozilla public {LICENSE}|mpl", ["2.0", "1.1", "1.0"]),
    ("EPL", rf"eclipse public {LICENSE}|epl", ["2.0", "1.0"]),
    ("EUPL", rf"european union public {LICENSE}|eupl", ["1.2", "1.1", "1.0"]),
    ("CDDL", rf"common development and distribution {LICENSE}|cddl", ["1.1", "1.0"]),
    ("BSL", rf"boost software {LICENSE}", ["1.0"]),
    ("OFL", rf"(?:sil )?open font {LICENSE}|sil ofl|ofl", ["1.1", "1.0"]),
    ("Artistic", rf"(?:perl )?artistic {LICENSE}", ["2.0", "1.0"]),
    ("MS-PL", rf"microsoft public {LICENSE}|ms pl", [""]),
    ("Zlib", rf"zlib(?: libpng)? {LICENSE}", [""]),
    ("ISC", rf"isc {LICENSE}", [""]),
    ("MIT", rf"(?:mit|expat)(?: x11)? {LICENSE}", [""]),
    ("PostgreSQL", rf"postgresql {LICENSE}", [""]),
    ("PSF-2.0", rf"python software foundation {LICENSE}(?: version 2)?|psf {LICENSE}", [""]),
    ("BSD-3-Clause", rf"(?:new|modified|revised|3 clause|three clause) bsd(?: {LICENSE})?|bsd (?:3|three) clause(?: {LICENSE})?", [""]),
    ("BSD-2-Clause", rf"(?:simplified|freebsd|2 clause|two clause) bsd(?: {LICENSE})?|bsd (?:2|two) clause(?: {LICENSE})?", [""]),
    ("BSD-4-Clause", rf"(?:original|4 clause|four clause) bsd(?: {LICENSE})?|bsd (?:4|four) clause(?: {LICENSE})?", [""]),
    ("0BSD", rf"0bsd|zero clause bsd(?: {LICENSE})?|bsd zero clause(?: {LICENSE})?", [""]),
    ("Unlicense", rf"the un{LICENSE}", [""]),
]

# Conditions of the Creative Commons licences, the longer first, and their versions.
CC_CONDITIONS = [
    ("NC-ND", " nc nd| non ?commercial no ?deriv(?:ative|ative works|atives|s)"),
    ("NC-SA", " nc sa| non ?commercial share ?alike"),
    ("NC", " nc| non ?commercial"),
    ("ND", " nd| no ?deriv(?:ative|ative works|atives|s)"),
    ("SA", " sa| share ?alike"),
    ("", ""),
]
CC_VERSIONS = ["4 0", "3 0", "2 5", "2 0", ""]  # none stands for the newest, 4.0

# Sentences of the licences' own texts and headers.
TEXTS = [
    ("boost_grant", r"permission is hereby granted free of charge to any person or organization obtaining a copy"),
    ("mit_grant", r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit_notice", r"the above copyright notice and this permission notice shall be included"),
    ("isc_grant", r"permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted provided that"),
    ("0bsd_grant", r"permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted"),
    ("isc_part", r"permission to use copy modify and (?:or )?distribute this software"),
    ("apache2_copy", rf"you may obtain a copy of the {LICENSE} at"),
    ("apache2_text", rf"apache {LICENSE} version 2 0 january 2004"),
    ("bsd_redist", r"redistribution and use in source and binary forms"),
    ("bsd_source", r"redistributions of source code must retain the above copyright notice"),
    ("bsd_binary", r"redistributions in binary form must reproduce the above copyright notice"),
    ("bsd_adverts", r"all advertising materials mentioning features or use of this software"),
    ("bsd_names", r"may be used to endorse or promote products"),
    ("zlib_origin", r"the origin of this software must not be misrepresented"),
    ("zlib_altered", r"altered source versions must be plainly marked as such"),
    ("zlib_notice", r"this notice may not be removed or altered from any source distribution"),
    ("wtfpl", rf"do what the fuck you want to public {LICENSE}"),
    ("unencumbered", r"this is free and unencumbered software released into the public domain"),
    ("public_domain", r"released into the public domain"),
    ("cc0", r"cc0(?: 1 0)?|creative commons zero"),
    ("as_is", r"(?:the|this) (?:software|work|material) is provided as is|provided by (?:[a-z0-9]+ ){1,12}as is"),
]

# Phrases that bind or lift a grant.
_VERB = "licen[cs]ed|released|distributed|published|available|provided|offered|relicensed"
GLUE = [
    ("x_not", rf"(?:not|never|no longer|neither|isn t|aren t|wasn t)(?: [a-z]+)? (?:(?:{_VERB}) under|subject to the terms|covered by)|not under"),
    ("mit_ref", rf"(?:(?:{_VERB}) under (?:the )?|spdx {LICENSE} identifier )mit(?: x11)?(?: {LICENSE})?"),
    ("grant", rf"(?:{_VERB}|modify it|redistribute it|used)(?: [a-z]+)? under|covered (?:by|under)|subject to the terms|under the terms|under (?:either|both)|spdx {LICENSE} identifier"),
    ("or_later", r"or (?:at your option )?any (?:later|newer) version|or (?:later|newer)"),
]


def _id(name: str, version: str = "") -> str:
    return re.sub(r"[^a-z0-9]+", "_", f"{name} {version}".strip().lower())


def _phrases() -> list[tuple[str, str]]:
    """Identifier and pattern of every phrase; where several match at a place, the first one counts.  ``k_``: counts without
    a grant, ``n_``: a name that needs one, ``v_``: the version of a ``k_`` name, ``x_not``, ``grant``: scope."""
    out = [*GLUE[:2], *TEXTS]
    for name, _, pattern, versions in GNU:
        out += [(_id("k_" + name, v), f"(?:{pattern}){_version(v)}") for v in versions] + [("k_" + name, pattern)]
    for name, pattern, versions in VERSIONED:
        out += [(_id("n_" + name, v), f"(?:{pattern})" + (_version(v) if v else "")) for v in versions]
    for name, pattern in CC_CONDITIONS:
        out += [(_id(f"n_cc_by_{name}", v), f"(?:cc|creative commons) (?:by|attribution)(?:{pattern})" + (f"{_AFTER} {v}" if v else ""))
                for v in CC_VERSIONS]
    numbers = sorted({v for _, _, _, versions in GNU for v in versions}, key=lambda v: (v.endswith(".0"), v))
    out += [(_id("v", v), rf"(?:version|v) ?{_number(v)}") for v in numbers]
    return [(name, rf"\b(?:{pattern})\b") for name, pattern in [*out, *GLUE[2:]]]


def _rules() -> list[tuple[str, list[str]]]:
    """Licence and its identifiers, in order: at a place the first that fits wins."""
    out = [
        ("BSL-1.0", ["boost_grant"]),
        ("MIT", ["mit_grant", "mit_notice", "as_is"]), ("MIT", ["mit_grant", "mit_notice"]), ("MIT", ["mit_grant"]), ("MIT", ["mit_ref"]),
        ("ISC", ["isc_grant", "as_is"]), ("ISC", ["isc_grant"]), ("0BSD", ["0bsd_grant", "as_is"]), ("0BSD", ["0bsd_grant"]), ("ISC", ["isc_part"]),
        ("BSD-4-Clause", ["bsd_redist", "bsd_source", "bsd_binary", "bsd_adverts", "bsd_names"]),
        ("BSD-3-Clause", ["bsd_redist", "bsd_source", "bsd_binary", "bsd_names"]), ("BSD-2-Clause", ["bsd_redist", "bsd_source", "bsd_binary"]),
        ("Zlib", ["zlib_origin", "zlib_altered", "zlib_notice"]), ("Zlib", ["zlib_origin", "zlib_altered"]),
        ("Apache-2.0", ["n_apache_2_0", "apache2_copy"]), ("Apache-2.0", ["apache2_text"]),
        ("WTFPL", ["wtfpl"]), ("Unlicense", ["unencumbered"]), ("Unlicense", ["public_domain"]), ("CC0-1.0", ["cc0"]),
    ]
    for name, spdx, _, versions in GNU:
        for v in versions:
            for ids in ([_id("k_" + name, v)], ["k_" + name, _id("v", v)], ["m_" + name, _id("v", v)]):
                out += [(f"{spdx}-{v}-or-later", [*ids, "or_later"]), (f"{spdx}-{v}-only", ids)]
    out += [(f"{spdx}-{versions[-1]}-or-later", ["k_" + name]) for name, spdx, _, versions in GNU]
    out += [(f"{name}-{v}" if v else name, [_id("n_" + name, v)]) for name, _, versions in VERSIONED for v in versions]
    for name, _ in CC_CONDITIONS:
        out += [("-".join(x for x in ("CC-BY", name, v.replace(" ", ".") or "4.0") if x), [_id(f"n_cc_by_{name}", v)]) for v in CC_VERSIONS]
    return out


def _key(ids: list[str]) -> str:
    return "".join(f"<{i}>" for i in ids)


PHRASES, RULES = _phrases(), _rules()
PHRASE_PATTERN = "|".join(pattern for _, pattern in PHRASES)
RULE_PATTERN = "|".join(_key(ids) for _, ids in RULES)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Sentences end at a mark followed by white space, or at an empty line; not at ";", after which headers name the version.
SPLIT = rf"[.!?]{SPACE}+|\n{SPACE}*\n"
SHORT = rf"\b([Vv])\.{SPACE}+([0-9])"  # "v. 2.0" ends no sentence
NEGATED = "<x_not>(?:<(?:[knv]_[a-z0-9_]+|or_later)>)*"  # up to the next grant, text or end of the sentence
BEFORE_GRANT = "^(?:<[^g][^>]*>)*"
SCOPE = "<(?:grant|x_not)>"
LOOSE = "(<[km]_[^>]+>)(<v_[^>]+>)?(<or_later>)?|<(?:v_[^>]+|or_later)>"
#: Every phrase but ``GLUE`` and versions holds a word that begins like this, so a text without any has no licence sentence.
HINT = (r"(?i)(?:^|[^a-z0-9])(?:(?:un)?licen|permission|redistribut|provided|domain|apache|mozilla|creative|(?:free|0)?bsd|advertising|"
        r"misrepresented|plainly|removed|endorse|(?:[al]?gpl|mpl|epl|eupl|cddl|ofl|cc0?|mit|ms)(?![a-uw-z]))")
#: What a sentence may add to the one before it.
SENTENCE_HINT = HINT[:-1] + r"|version|v[^a-z]|later|newer)"


def normalise(text: Column) -> Column:
    return F.regexp_replace(F.translate(text, UPPER, LOWER), "[^a-z0-9]+", " ")


def sentence_ids(sentence: Column) -> Column:
    """Identifiers of all phrases of a normalised sentence, as ``<id><id>``, after grants and negations are settled."""
    def name_of(phrase: Column) -> Column:
        out = F.lit(None).cast("string")
        for name, pattern in reversed(PHRASES):
            out = F.when(phrase.rlike(f"^{pattern}$"), F.lit(f"<{name}>")).otherwise(out)
        return out
    found = F.concat_ws("", F.transform(F.regexp_extract_all(sentence, F.lit(PHRASE_PATTERN), 0), name_of))
    said = F.regexp_replace(found, NEGATED, "")
    first = F.regexp_extract(said, BEFORE_GRANT, 0)
    mentioned = F.regexp_replace(F.regexp_replace(first, "<n_[^>]+>", ""), "<k_(a|l)?gpl>", "<m_$1gpl>")
    return F.concat(mentioned, F.substr(said, F.length(first) + 1))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col``, ``sentence_ids`` and ``licenses`` (arrays, in text order).

    ``sentence_ids`` holds the identifiers that count (versions and "or later" only beside their name; a GNU licence that is
    mentioned without a grant as ``m_...``). ``licenses`` names every matched rule's licence, repeats included; a GNU licence granted
    without a version stands for its first one "or-later".  Null, empty and other texts without a licence sentence give
    empty arrays.  Repeated rows are scanned each.  An empty table gives an empty result.  Other columns are not
    read.  Whole texts are read, of any length.  Narrow: no shuffle.
    """
    text = text_of(text_col)
    sentences = F.filter(F.split(F.regexp_replace(text, SHORT, "$1 $2"), SPLIT), lambda s: s.rlike(SENTENCE_HINT))
    each = F.transform(sentences, lambda s: sentence_ids(normalise(s)))
    sequence = F.regexp_replace(F.regexp_replace(F.concat_ws("", each), SCOPE, ""), LOOSE, "$1$2$3")
    none = F.array().cast("array<string>")
    found = docs.select(col(id_col).alias(id_col), F.when(text.rlike(HINT), sequence).otherwise(F.lit("")).alias("_sequence"))
    names = F.create_map(*[F.lit(x) for key, name in {_key(ids): name for name, ids in reversed(RULES)}.items() for x in (key, name)])
    matched = F.transform(F.regexp_extract_all("_sequence", F.lit(RULE_PATTERN), 0), lambda x: F.element_at(names, x))
    known = F.col("_sequence") != ""
    return found.select(col(id_col),
                        F.when(known, F.regexp_extract_all("_sequence", F.lit("[a-z0-9_]+"), 0)).otherwise(none).alias("sentence_ids"),
                        F.when(known, matched).otherwise(none).alias("licenses"))


def oracle() -> str:
    """DuckDB SQL for the digest columns of the registered query, over every text (no hint)."""
    phrases = " ".join(f"WHEN regexp_matches(p, '^{p}$') THEN '<{n}>'" for n, p in PHRASES)
    names = " ".join(f"WHEN m = '{_key(ids)}' THEN '{n}'" for n, ids in RULES)
    return rf"""
WITH s AS (
  SELECT doc_id, regexp_replace(array_to_string(list_transform(regexp_extract_all(
           regexp_replace(translate(s, '{UPPER}', '{LOWER}'), '[^a-z0-9]+', ' ', 'g'), '{PHRASE_PATTERN}'),
           lambda p: CASE {phrases} END), ''), '{NEGATED}', '', 'g') AS said, n
  FROM (SELECT doc_id, unnest(sentences) AS s, unnest(range(len(sentences))) AS n
        FROM (SELECT doc_id, string_split_regex(regexp_replace(coalesce(text, ''), '{SHORT}', '\1 \2', 'g'), '{SPLIT}') AS sentences FROM documents))),
f AS (SELECT *, regexp_extract(said, '{BEFORE_GRANT}') AS first FROM s),
g AS (
  SELECT doc_id, regexp_replace(regexp_replace(string_agg(
           regexp_replace(regexp_replace(first, '<n_[^>]+>', '', 'g'), '<k_(a|l)?gpl>', '<m_\1gpl>', 'g')
           || substr(said, length(first) + 1), '' ORDER BY n), '{SCOPE}', '', 'g'), '{LOOSE}', '\1\2\3', 'g') AS ids
  FROM f GROUP BY doc_id),
m AS (SELECT doc_id, regexp_extract_all(ids, '[a-z0-9_]+') AS ids, regexp_extract_all(ids, '{RULE_PATTERN}') AS found FROM g)
SELECT doc_id, len(ids)::INTEGER AS n_identifiers, array_to_string(ids, ',') AS sentence_ids,
       array_to_string(list_transform(found, lambda m: CASE {names} END), ',') AS licenses
FROM m
"""
