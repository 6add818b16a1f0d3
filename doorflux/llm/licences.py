"""License scans: sentences of known licences, and ordered rules over their sequence.

A text is cut into sentences, which are brought into a plain form (lower case, comment
marks, quotes and other signs gone, one space). A sentence that says what a licence
says gets that sentence's identifier, with the version it names; if it says several
things, it gets all their identifiers, in order. The sequence of
identifiers is then read from the left: the first rule, in the order listed, whose
identifiers follow one another there names a licence and takes them; an identifier that
no rule takes is left over.

* a name that is denied ("not licensed under …") gives no identifier
* several rules may fit at one place: the first listed holds, longer ones before shorter
* an empty table gives an empty result
* null and empty texts have no sentence and no licence
* every row is scanned whole, repeated rows each; other columns are ignored
* sentences without an identifier may stand between those of a rule
"""

from __future__ import annotations

import re
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doorflux.llm.common import map_texts

#: What stands before the name of a licence; "or" and "and" only where "under" came before.
_LEAD = r"\b(?:under|governed by|or|and)(?: either| both)?(?: of)?(?: the| an?)?(?: terms of)?(?: either| both)?(?: of)?(?: the)? "
# What well-known licences say, as expressions over plain sentences.
SENTENCES = (
    ("spdx", r"spdx license identifier ([a-z0-9.+-]+(?: (?:and|or|with) [a-z0-9.+-]+)*)"),
    ("mit_name", _LEAD + r"(?:mit|expat)(?: x11)?(?: licen[cs]e|(?= (?:or|and) .*\blicen[cs]es?\b))"),
    ("mit_grant", r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit_notice", r"the above copyright notice and this permission notice (?:\(including the next paragraph\) )?shall be included in"),
    ("as_is", r"the software is provided as is without warranty of any kind"),
    ("no_liability", r"in no event shall the authors or copyright holders be liable"),
    ("mit_field", r"\blicen[cs]e field (?:the )?(?:mit|expat)\b"),
    ("isc_name", _LEAD + r"isc licen[cs]e"),
    ("isc_field", r"\blicen[cs]e field (?:the )?isc\b"),
    ("isc_grant", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd_grant", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd_source", r"redistributions of source code must retain the above copyright notice"),
    ("bsd_binary", r"redistributions in binary form must reproduce the above copyright notice"),
    ("bsd_advert", r"all advertising materials mentioning features or use of this software"),
    ("bsd_endorse", r"neither the name of .* may be used to endorse or promote products|the names? of .* may not be used to endorse or promote products"),
    ("bsd_name", _LEAD + r"(?:new |modified |simplified )?(?:([234])[ -]clause )?bsd(?:[ -]style| ([234])[ -]clause)? licen[cs]e"),
    ("bsd_field", r"\blicen[cs]e field (?:the )?(?:new |modified |simplified )?(?:([234])[ -]clause )?bsd\b(?:[ -]([234])[ -]clause)?"),
    ("apache_name", _LEAD + r"apache(?: software)?(?: licen[cs]e,?(?: version| v)? ?([0-9.]*[0-9])?| v?([0-9.]*[0-9]) licen[cs]e)"),
    ("apache_field", r"\blicen[cs]e field (?:the )?apache\b(?: licen[cs]e)?,?(?: version)?[ -]?v?([0-9.]*[0-9])?"),
    ("apache_use", r"you may not use this file except in compliance with the licen[cs]e"),
    ("apache_copy", r"you may obtain a copy of the licen[cs]e at"),
    ("apache_as_is", r"distributed under the license is distributed on an as is basis"),
    ("lgpl_name", r"\bgnu (?:lesser|library) general public licen[cs]e,?(?: as published by the free software foundation)?,?(?: either)?(?: version| v)? ?([0-9.]*[0-9])?"),
    ("agpl_name", r"\bgnu affero general public licen[cs]e,?(?: as published by the free software foundation)?,?(?: either)?(?: version| v)? ?([0-9.]*[0-9])?"),
    ("gpl_name", r"\bgnu general public licen[cs]e,?(?: as published by the free software foundation)?,?(?: either)?(?: version| v)? ?([0-9.]*[0-9])?"),
    ("lgpl_field", r"\blicen[cs]e field (?:the )?(?:gnu )?lgpl[ -]?v?([0-9.]*[0-9])?"),
    ("agpl_field", r"\blicen[cs]e field (?:the )?(?:gnu )?agpl[ -]?v?([0-9.]*[0-9])?"),
    ("gpl_field", r"\blicen[cs]e field (?:the )?(?:gnu )?gpl[ -]?v?([0-9.]*[0-9])?"),
    ("gpl_later", r"\b(?:either )?version ([0-9.]*[0-9]) of the licen[cs]e(?: or at your option any later version)?"),
    ("gpl_warranty", r"without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("lgpl_see", r"see the gnu (?:lesser|library) general public licen[cs]e for more details"),
    ("agpl_see", r"see the gnu affero general public licen[cs]e for more details"),
    ("gpl_see", r"see the gnu general public licen[cs]e for more details"),
    ("lgpl_copy", r"you should have received a copy of the gnu (?:lesser|library) general public licen[cs]e"),
    ("agpl_copy", r"you should have received a copy of the gnu affero general public licen[cs]e"),
    ("gpl_copy", r"you should have received a copy of the gnu general public licen[cs]e"),
    ("mpl_name", r"mozilla public licen[cs]e,?(?: version| v)? ?([0-9.]*[0-9])?"),
    ("epl_name", r"eclipse public licen[cs]e,?(?: version| v)? ?([0-9.]*[0-9])?"),
    ("cc0", r"\bcc0\b|creative commons zero"),
    ("cc_name", r"\b(?:cc|creative commons)[ -](by(?:[ -](?:nc|sa|nd))*)(?: ([0-9.]*[0-9]))?"),
    ("cc_words", r"\bcreative commons attribution((?:[ -](?:non-?commercial|share ?-?alike|no ?-?deriv(?:ative)?s))*)(?: licen[cs]e)?,?(?: version)?(?: ([0-9.]*[0-9]))?"),
    ("zlib_name", _LEAD + r"zlib(?: libpng)? licen[cs]e"),
    ("zlib_field", r"\blicen[cs]e field (?:the )?zlib\b"),
    ("zlib_as_is", r"this software is provided as-is without any express or implied warranty"),
    ("zlib_liable", r"in no event will the authors? be held liable for any damages arising from the use of this software"),
    ("zlib_grant", r"permission is granted to anyone to use this software for any purpose,? including commercial applications,? and to alter it and redistribute it freely"),
    ("zlib_origin", r"the origin of this software must not be misrepresented"),
    ("zlib_altered", r"altered source versions must be plainly marked as such"),
    ("zlib_notice", r"this notice may not be removed or altered from any source distribution"),
    ("artistic_name", r"\bartistic licen[cs]e,?(?: version| v)? ?([0-9.]*[0-9])?"),
    ("wtfpl", r"\bwtfpl\b|do what the fuck you want to public licen[cs]e"),
    ("wtfpl_grant", r"you just do what the fuck you want to"),
    ("unlicense", r"this is free and unencumbered software released into the public domain"),
    ("boost_name", r"boost software licen[cs]e,?(?: version| v)? ?([0-9.]*[0-9])?"),
)


def _gnu_rules(kind: str) -> list[tuple[tuple[str, ...], str]]:
    """The sentences of a GNU licence in their order, any of them left out but those that name it."""
    order = (f"{kind}_name", "gpl_later", "gpl_warranty", f"{kind}_see", f"{kind}_copy")
    some = [x for n in range(len(order), 0, -1) for x in combinations(order, n)]
    return [(x, f"{kind.upper()}-*") for x in some if {order[0], *order[3:]} & set(x) and (x[0] == order[0] or "gpl_later" not in x)]


#: Identifiers that follow one another, and the licence that they make; ``*`` is the version.
#: Later versions are told by the sentence's own words.
RULES = (
    (("spdx",), "*"),
    (("mit_grant", "mit_notice", "as_is", "no_liability"), "MIT"),
    (("mit_grant", "mit_notice", "as_is"), "MIT"),
    (("mit_grant", "mit_notice"), "MIT"),
    (("isc_grant",), "ISC"),
    (("zlib_as_is", "zlib_liable", "zlib_grant", "zlib_origin", "zlib_altered", "zlib_notice"), "Zlib"),
    (("zlib_grant", "zlib_origin", "zlib_altered", "zlib_notice"), "Zlib"),
    (("zlib_as_is", "zlib_liable", "zlib_grant"), "Zlib"),
    (("zlib_grant",), "Zlib"),
    (("bsd_grant", "bsd_source", "bsd_binary", "bsd_advert", "bsd_endorse"), "BSD-4-Clause"),
    (("bsd_grant", "bsd_source", "bsd_binary", "bsd_endorse"), "BSD-3-Clause"),
    (("bsd_grant", "bsd_source", "bsd_binary"), "BSD-2-Clause"),
    (("apache_name", "apache_use", "apache_copy", "apache_as_is"), "Apache-*"),
    (("apache_name", "apache_use", "apache_copy"), "Apache-*"),
    *_gnu_rules("lgpl"),
    *_gnu_rules("agpl"),
    *_gnu_rules("gpl"),
    (("mit_name",), "MIT"),
    (("bsd_name",), "BSD-*-Clause"),
    (("apache_name",), "Apache-*"),
    (("mpl_name",), "MPL-*"),
    (("epl_name",), "EPL-*"),
    (("cc0",), "CC0"),
    (("cc_name",), "CC-*"),
    (("cc_words",), "CC-*"),
    (("isc_name",), "ISC"),
    (("zlib_name",), "Zlib"),
    (("artistic_name",), "Artistic-*"),
    (("wtfpl", "wtfpl_grant"), "WTFPL"),
    (("wtfpl",), "WTFPL"),
    (("wtfpl_grant",), "WTFPL"),
    (("mit_field",), "MIT"),
    (("isc_field",), "ISC"),
    (("zlib_field",), "Zlib"),
    (("bsd_field",), "BSD-*-Clause"),
    (("apache_field",), "Apache-*"),
    (("lgpl_field",), "LGPL-*"),
    (("agpl_field",), "AGPL-*"),
    (("gpl_field",), "GPL-*"),
    (("unlicense",), "Unlicense"),
    (("boost_name",), "BSL-*"),
)

#: A text without any of these has no licence sentence.
HINTS = ("licen", "permission", "redistribut", "copyright", "warrant", "as is", "mozilla", "creative commons", "cc by", "cc-by", "cc0", "public domain", "endorse", "liable", "advertising", "wtfpl", "what the fuck", "misrepresented", "plainly marked", "removed or altered")

_END = re.compile(r"(?<=[.!?;:])(?<!dentifier:)(?<!icen[cs]e:)\s+|\n\s*\n|\n(?=\s*(?:[*#/\-]|[0-9a-z]\.\s|\([a-z0-9]\)))")
_DROP = re.compile(r"[^\w.+(),\s-]|_")
_KNOWN = [(name, re.compile(regex)) for name, regex in SENTENCES]
_LED = frozenset(name for name, regex in SENTENCES if regex.startswith(_LEAD))


#: A licence that is named only to say that it does not hold.
_DENIED = re.compile(r"\b(?:not|never|no longer) (?:be |been )?(?:licen[cs]ed|released|distributed|available|covered|governed)\b(?!.*\b(?:but|instead|rather)\b)|\bnot $")
#: A licence field, as in a package's description; its colon would be lost.
_FIELD = re.compile(r"\b(licen[cs]e)[ \t]*:[ \t]*(?=\S)")
#: What the words of Creative Commons are in its short names.
_CC_WORDS = (("non", "nc"), ("share", "sa"), ("deriv", "nd"))


def plain(sentence: str) -> str:
    words = _DROP.sub(" ", _FIELD.sub(r"\1 field ", sentence.lower())).split()
    # list marks and lone signs at the start say nothing
    while words and re.fullmatch(r"[(]?[0-9a-z]?[.)]|[-+.,()]+", words[0]):
        words.pop(0)
    text = " ".join(w.strip("(),-.") if not re.fullmatch(r"\(including|paragraph\)", w) else w for w in words)
    return re.sub(r" +", " ", text).replace("spdx-license-identifier", "spdx license identifier").strip()


def sentences(text: str) -> list[tuple[str, str]]:
    """Identifier and version of each licence sentence, in order."""
    low = text.lower()
    if not any(h in low for h in HINTS) and "spdx" not in low:
        return []
    out = []
    for part in _sentence_parts(text):
        held = part.lower()
        if not any(h in held for h in HINTS) and "spdx" not in held:
            continue
        said = plain(part)
        hits = sorted((m.start(), order, m) for order, (_, regex) in enumerate(_KNOWN) for m in regex.finditer(said))
        taken: list[tuple[str, re.Match]] = []
        for start, order, match in hits:
            name = _KNOWN[order][0]
            led = name not in _LED or re.search(r"\b(?:under|governed by)\b", said[:match.end()])
            if name.endswith(("_name", "_words")) and _DENIED.search(said[:start]):
                continue
            if led and (not taken or start >= taken[-1][1].end()):
                taken.append((name, match))
        for k, (name, match) in enumerate(taken):
            version = " ".join(g for g in match.groups() if g)
            if name == "cc_words":
                words, number = match.group(1), match.group(2) or ""
                version = " ".join(["by", *(short for word, short in _CC_WORDS if word in words), number]).strip()
            if "gpl" in name or name == "spdx":
                rest = said[match.start():taken[k + 1][1].start() if k + 1 < len(taken) else None]
                later = "any later version" in rest or "or later" in said[match.end():match.end() + 12].replace("-", " ")
                version += "-or-later" * (later and bool(version))
            out.append((name, version))
    return out


def _sentence_parts(text: str) -> list[str]:
    """Sentences; a line end alone ends one only if no licence sentence runs on over it."""
    parts = []
    for piece in _END.split(text):
        lines = piece.split("\n")
        held = ""
        for line in lines:
            # a new line that starts with a capital after a full stop is cut by _END already
            held = f"{held} {line.strip(' */#-')}" if held else line
        parts.append(held)
    return parts


def licences(found: list[tuple[str, str]]) -> tuple[list[str], int]:
    """Licences in order, each named once, and the number of identifiers left over."""
    names = [name for name, _ in found]
    out, left, at = [], 0, 0
    while at < len(found):
        for sequence, licence in RULES:
            if tuple(names[at:at + len(sequence)]) == sequence:
                version = next((v for _, v in found[at:at + len(sequence)] if v), "")
                if licence == "CC-*":
                    version = re.sub(r"[ -]+", "-", version.upper())
                name = licence.replace("*", version) if version else licence.split("-*")[0].replace("*", "")
                out.append(name)
                at += len(sequence)
                break
        else:
            left += 1
            at += 1
    return list(dict.fromkeys(out)), left


def scan_texts(texts: list[str]) -> dict[str, list]:
    found = [sentences(t) for t in texts]
    named = [licences(f) for f in found]
    return {
        "licences": [n for n, _ in named],
        "sentence_ids": [[name for name, _ in f] for f in found],
        "unmatched": [left for _, left in named],
    }


def scan(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of every row, its ``licences``, ``sentence_ids`` and ``unmatched``."""
    return map_texts(
        docs.select(*keep, F.col("text").alias("_text")), "_text",
        "licences array<string>, sentence_ids array<string>, unmatched bigint", scan_texts,
    )
