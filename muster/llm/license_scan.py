"""License scans: ordered signature rules over whole texts, in Spark expressions only.

Each rule is a regular expression over the words of a text with single spaces between them, with a label, a priority and a
keyword that each of its matches holds. A text is searched for the keywords first, and only the rules of those it holds are
tried. Every place a rule matches is
a detection with its word interval. Detections are put in order (earlier start, longer, stronger priority), and one whose interval
lies within that of another of at least its priority is suppressed. Nothing is shuffled: a row holds all it needs.

The rules are made from the families below (a family says how a license is named, and each way of stating a license turns that
name into a signature) and from hand-written signatures of identifiers, notices and license texts. Very long texts, and texts of very
many matches, are scanned whole; matches are gathered in short arrays, so that work grows with them and not with their square. A null text is an empty one: no words, no places, no labels, score 0. Repeated documents are judged row
by row.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from muster.llm.columns import spare

#: The phrases whose places are counted, and their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Rule:
    label: str
    keyword: str
    priority: int
    regex: str


@dataclass(frozen=True)
class Family:
    """How a license is named, in lower-cased words; ``versions`` are words after the name, each with its label's ending.

    Every text that ``full`` fits holds ``keyword``; ``short`` is the name in SPDX identifiers, word for word.
    """

    label: str
    keyword: str
    full: str
    short: str
    versions: tuple[str, ...] = ()


FAMILIES = (
    Family("gpl", "gpl", "(?:gnu )?gpl", "gpl", ("1 0", "2 0", "3 0")),
    Family("gpl", "general public license", "(?:gnu )?general public license", "gnu general public", ("1", "2", "3")),
    Family("lgpl", "lgpl", "(?:gnu )?lgpl", "lgpl", ("2 0", "2 1", "3 0")),
    Family("lgpl", "lesser general public", "(?:gnu )?lesser general public license", "lesser general public", ("2 1", "3")),
    Family("agpl", "agpl", "(?:gnu )?agpl", "agpl", ("1 0", "3 0")),
    Family("agpl", "affero", "(?:gnu )?affero general public license", "affero general public", ("1", "3")),
    Family("gfdl", "free documentation", "(?:gnu )?free documentation license", "gfdl", ("1 1", "1 2", "1 3")),
    Family("apache", "apache", "apache(?: software)? license", "apache", ("1 0", "1 1", "2 0")),
    Family("mit", "t license", "(?:the )?(?:mit|expat) license", "mit"),
    Family("bsd-2-clause", "bsd", "(?:simplified|2 clause|freebsd) bsd license|bsd 2 clause(?: license)?", "bsd 2 clause"),
    Family("bsd-3-clause", "bsd", "(?:new|modified|revised|3 clause) bsd license|bsd 3 clause(?: license)?", "bsd 3 clause"),
    Family("bsd", "bsd", "(?:original |4 clause )?bsd(?: style)? license", "bsd"),
    Family("isc", "isc", "isc license", "isc"),
    Family("mpl", "mozilla", "mozilla public license", "mozilla public", ("1 0", "1 1", "2 0")),
    Family("mpl", "mpl", "mpl", "mpl", ("1 0", "1 1", "2 0")),
    Family("epl", "eclipse", "eclipse public license", "epl", ("1 0", "2 0")),
    Family("eupl", "european union public", "european union public licen[cs]e", "eupl", ("1 1", "1 2")),
    Family("cddl", "distribution license", "common development and distribution license", "cddl", ("1 0", "1 1")),
    Family("cpl", "common public license", "common public license", "cpl", ("1 0",)),
    Family("artistic", "artistic", "(?:the )?(?:perl )?artistic license", "artistic", ("1 0", "2 0")),
    Family("bsl", "boost", "boost software license", "bsl", ("1 0",)),
    Family("zlib", "zlib", "zlib(?: libpng)? license", "zlib"),
    Family("unlicense", "unlicense", "(?:the )?unlicense", "unlicense"),
    Family("wtfpl", "wtfpl", "wtfpl", "wtfpl", ("2",)),
    Family("python", "python software foundation", "python software foundation license", "psf", ("2",)),
    Family("python", "python license", "python license", "python", ("2",)),
    Family("postgresql", "postgresql", "postgresql license", "postgresql"),
    Family("openssl", "openssl", "openssl license", "openssl"),
    Family("php", "php", "php license", "php", ("3 0", "3 01")),
    Family("osl", "open software license", "open software license", "osl", ("1 0", "2 0", "3 0")),
    Family("ofl", "open font", "(?:sil )?open font license", "ofl", ("1 0", "1 1")),
    Family("odbl", "open database", "open database license", "odbl", ("1 0",)),
    Family("cc0", "cc0", "(?:creative commons )?cc0", "cc0", ("1 0",)),
    Family("cc-by", "cc by", "cc by", "cc by", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    Family("cc-by-sa", "cc by sa", "cc by sa", "cc by sa", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    Family("cc-by-nd", "cc by nd", "cc by nd", "cc by nd", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    Family("cc-by-nc", "cc by nc", "cc by nc", "cc by nc", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    Family("cc-by-nc-sa", "cc by nc sa", "cc by nc sa", "cc by nc sa", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    Family("cc-by-nc-nd", "cc by nc nd", "cc by nc nd", "cc by nc nd", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    Family("cc-by", "creative commons", "creative commons attribution", "creative commons attribution", ("2 0", "3 0", "4 0")),
    Family("cc-by-sa", "creative commons", "creative commons attribution share ?alike", "attribution sharealike", ("2 0", "3 0", "4 0")),
    Family("cc-by-nc", "creative commons", "creative commons attribution non ?commercial", "attribution noncommercial", ("2 0", "3 0", "4 0")),
    Family("cc-by-nd", "creative commons", "creative commons attribution no ?deriv(?:s|atives|ative works)", "attribution noderivatives",
           ("2 0", "3 0", "4 0")),
    Family("cc-by-nc-sa", "creative commons", "creative commons attribution non ?commercial share ?alike",
           "attribution noncommercial sharealike", ("2 0", "3 0", "4 0")),
    Family("cc-by-nc-nd", "creative commons", "creative commons attribution non ?commercial no ?deriv(?:s|atives|ative works)",
           "attribution noncommercial noderivatives", ("2 0", "3 0", "4 0")),
)

#: Ways of stating a license, strongest first: (priority, how sure it is, the signature around the full name or the short one).
STATEMENTS = (
    (1, 1.0, "spdx license identifier {short}"),
    (2, 0.95, "(?:licen[sc]ed|released|distributed|available|published|provided) under (?:the (?:terms of )?)?(?:the )?{full}"),
    (2, 0.95, "subject to (?:the (?:terms of )?)?(?:the )?{full}"),
    (3, 0.8, "{full}"),
)
#: Short names that no ``full`` covers. Alone they may be other words, so they count only where a license is stated (priority 2).
STATED = ("gfdl", "epl", "eupl", "cddl", "cpl", "bsl", "psf", "osl", "ofl", "odbl")
#: Rules that name no license of a family: (label, keyword, priority, signature).
OTHERS = (
    ("all-rights-reserved", "all rights reserved", 4, "all rights reserved"),
    ("copyright", "copyright", 5, "copyright (?:c )?(?:19|20)[0-9]{2}"),
    ("proprietary", "proprietary", 4, "proprietary and confidential"),
    ("public-domain", "public domain", 4, "(?:dedicated to|released into|placed in) the public domain"),
    ("permission-notice", "permission is hereby granted", 2, "permission is hereby granted free of charge to any person obtaining a copy"),
    ("redistribution-notice", "redistribution and use", 2, "redistribution and use in source and binary forms"),
    ("gpl", "this program is free software", 2, "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("apache-2.0", "unless required by applicable law", 2,
     "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("isc", "with or without fee is hereby granted", 2,
     "permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "free and unencumbered software", 2, "this is free and unencumbered software released into the public domain"),
    ("warranty-disclaimer", "without warranty", 5, "without warranty of any kind"),
)
#: Names joined with their versions, bare identifiers and the parts of expressions: (label, keyword, priority, signature).
IDENTIFIERS = (
    ("gpl-1.0", "gplv1", 2, "(?:gnu )?gplv1(?: 0)?"),
    ("gpl-2.0", "gplv2", 2, "(?:gnu )?gplv2(?: 0)?"),
    ("gpl-3.0", "gplv3", 2, "(?:gnu )?gplv3(?: 0)?"),
    ("lgpl-2.0", "lgplv2", 2, "(?:gnu )?lgplv2(?: 0)?"),
    ("lgpl-2.1", "lgplv2 1", 2, "(?:gnu )?lgplv2 1"),
    ("lgpl-3.0", "lgplv3", 2, "(?:gnu )?lgplv3(?: 0)?"),
    ("agpl-3.0", "agplv3", 2, "(?:gnu )?agplv3(?: 0)?"),
    ("apache-1.1", "apache 1 1", 3, "apache 1 1"),
    ("apache-2.0", "apache 2 0", 3, "apache 2 0"),
    ("apache-2.0", "apachev2", 3, "apachev2(?: 0)?"),
    ("epl-1.0", "epl 1 0", 3, "epl 1 0"),
    ("epl-2.0", "epl 2 0", 3, "epl 2 0"),
    ("eupl-1.1", "eupl 1 1", 3, "eupl 1 1"),
    ("eupl-1.2", "eupl 1 2", 3, "eupl 1 2"),
    ("cddl-1.0", "cddl 1 0", 3, "cddl 1 0"),
    ("cddl-1.1", "cddl 1 1", 3, "cddl 1 1"),
    ("cpl-1.0", "cpl 1 0", 3, "cpl 1 0"),
    ("bsl-1.0", "bsl 1 0", 3, "bsl 1 0"),
    ("osl-3.0", "osl 3 0", 3, "osl 3 0"),
    ("ofl-1.1", "ofl 1 1", 3, "ofl 1 1"),
    ("odbl-1.0", "odbl 1 0", 3, "odbl 1 0"),
    ("gfdl-1.2", "gfdl 1 2", 3, "gfdl 1 2"),
    ("gfdl-1.3", "gfdl 1 3", 3, "gfdl 1 3"),
    ("artistic-2.0", "artistic 2 0", 3, "artistic 2 0"),
    ("0bsd", "0bsd", 3, "0bsd"),
    ("mit", "mit or", 1, "mit(?= or (?:apache|gpl|lgpl|bsd|mpl|isc|unlicense|zlib|0bsd|cc0))"),
    ("mit", "or mit", 1, "(?<=(?:apache 2 0|gpl 2 0|gpl 3 0|[23] clause|mpl 2 0|isc|unlicense|zlib|0bsd) or )mit"),
    ("isc", "isc", 1, "spdx license identifier (?:[a-z0-9]+ ){1,8}(?:or|and) isc"),
)
SURENESS = {1: 1.0, 2: 0.95, 3: 0.8, 4: 0.7, 5: 0.4}
_LEVELS = max(SURENESS)


def rules() -> list[Rule]:
    """All rules: strongest priority first, then as the families are listed; short names and texts of licenses last."""
    out = []
    named = [(priority, statement, f, "spdx license identifier" if "{short}" in statement else f.keyword, f"(?:{f.full})")
             for priority, _, statement in STATEMENTS for f in FAMILIES]
    named += [(priority, statement, f, f" {f.short}", f.short)
              for priority, _, statement in STATEMENTS if priority == 2 for f in FAMILIES if f.short in STATED]
    for priority, statement, f, keyword, full in named:
        name = statement.format(full=full, short=f.short)
        for version in f.versions:
            ending = version.replace(" ", "-") if " " in version else f"{version}-0"
            words = re.sub(r" 0$", "(?: 0)?", version)
            out.append(Rule(f"{f.label}-{ending.replace('-', '.')}", keyword, priority,
                            f" {name}(?: license| public license)?(?: as published by the free software foundation)?(?: either)?"
                            f"(?: version| v)? v?{words}(?= )"))
        out.append(Rule(f.label, keyword, priority + (1 if f.versions and priority > 1 else 0), f" {name}(?= )"))
    out += [Rule(label, keyword, priority, f" {regex}(?= )") for label, keyword, priority, regex in (*OTHERS, *IDENTIFIERS)]
    # either spelling of the word; an identifier line has but one
    spdx = "spdx license identifier"
    return [r if spdx in r.regex else Rule(r.label, r.keyword.replace("license", "licen"), r.priority, r.regex.replace("license", "licen[sc]e"))
            for r in out]


def spaced(text: Column) -> Column:
    """The words of a text in lower case, each after one space, and a space at the end; a text without words is one space."""
    lower = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    return F.concat(F.lit(" "), F.ltrim(F.regexp_replace(F.concat(lower, F.lit(" ")), _SEPARATORS, " ")))


def _spaces(text: Column) -> Column:
    return (F.octet_length(text) - F.octet_length(F.replace(text, F.lit(" "), F.lit("")))).cast("int")


_DETECTION = "struct<start:int,less:int,priority:int,rule:int,end:int,label:string>"


#: Elements folded at a time: appending to an array copies it, so long ones are made of short ones.
CHUNK = 256


def _folded(items: Column, start: Column, step: Callable[[Column, Column], Column], out: str) -> Column:
    """All elements that ``step`` appends to the array ``out`` of its state, a chunk of ``items`` at a time.

    Work is linear in the items up to their square over that of ``CHUNK``: 100,000 of them are 400 short arrays.
    """
    def chunk(all_: Column, seen: Column, number: Column) -> Column:
        own = F.slice(all_, number * CHUNK + 1, CHUNK)
        begin = F.struct(seen["state"].alias("state"), F.lit([]).cast(f"array<{_DETECTION}>").alias(out))
        done = F.aggregate(own, begin, step)
        return F.transform(F.array(done), lambda d: F.struct(
            d["state"].alias("state"), F.concat(seen["parts"], F.array(d[out])).alias("parts")))[0]

    def whole(all_: Column) -> Column:
        begin = F.struct(start.alias("state"), F.lit([]).cast(f"array<array<{_DETECTION}>>").alias("parts"))
        numbers = F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / CHUNK).cast("int"))
        return F.flatten(F.aggregate(numbers, begin, lambda seen, number: chunk(all_, seen, number))["parts"])

    # a lambda's variable: the items are made once, not once a chunk
    none = F.lit([]).cast(f"array<{_DETECTION}>")
    return F.transform(F.array(items), lambda all_: F.when(F.size(all_) > 0, whole(all_)).otherwise(none))[0]


def _matches(text: Column, rule: Column) -> Column:
    """Detections of one rule: the text is cut at marks around each match, and words are counted along the pieces."""
    mark = "\x01"  # no word holds it
    pieces = F.split(F.regexp_replace(text, rule["regex"], F.lit(f"{mark}$0{mark}")), mark)
    start = F.struct(F.lit(0).alias("at"), F.lit(False).alias("inside"))

    def step(seen: Column, piece: Column) -> Column:
        at, inside = seen["state"]["at"], seen["state"]["inside"]
        end = at + _spaces(piece)
        own = F.struct(at.alias("start"), (-end).alias("less"), rule["priority"].alias("priority"), rule["number"].alias("rule"),
                       end.alias("end"), rule["label"].alias("label"))
        return F.struct(F.struct(end.alias("at"), (~inside).alias("inside")).alias("state"),
                        F.when(inside, F.concat(seen["found"], F.array(own))).otherwise(seen["found"]).alias("found"))

    return _folded(pieces, start, step, "found")


def _unsuppressed(found: Column) -> Column:
    """Detections not within an earlier one of at least their priority, in the order start, longest, strongest.

    The state holds, for each priority, how far the detections of at least that priority reach so far.
    """
    start = F.array(*[F.lit(0)] * _LEVELS)

    def step(seen: Column, own: Column) -> Column:
        within = F.element_at(seen["state"], own["priority"]) >= own["end"]
        reach = F.transform(seen["state"], lambda r, i: F.when(i + 1 >= own["priority"], F.greatest(r, own["end"])).otherwise(r))
        return F.struct(reach.alias("state"), F.when(within, seen["kept"]).otherwise(F.concat(seen["kept"], F.array(own))).alias("kept"))

    return _folded(F.array_sort(found), start, step, "kept")


def scan(documents: DataFrame, *, text: str = "text", out: str = "licenses", own: list[Rule] | None = None) -> DataFrame:
    """``documents`` with a struct ``out`` (one of that name is replaced).

    n_words; n_base, first_word, last_word and base_labels of the base phrases; detections (start and end in words, label,
    priority); labels; score, the sureness of the strongest detection (0.5 if only base phrases are found, else 0).
    """
    made = rules() if own is None else own
    names = [spare(documents, n) for n in ("own_words", "own_keywords", "own_found")]
    words, keyed, detected = (F.col(n) for n in names)
    table = F.array(*[F.struct(F.lit(k).alias("number"), F.lit(r.label).alias("label"), F.lit(r.keyword).alias("keyword"),
                               F.lit(r.priority).alias("priority"), F.lit(r.regex).alias("regex")) for k, r in enumerate(made)])
    keywords = F.array(*[F.lit(k) for k in sorted({r.keyword for r in made})])
    held = documents.withColumn(names[0], spaced(F.col(text)))
    held = held.withColumn(names[1], F.filter(keywords, lambda k: F.contains(words, k)))
    tried = F.filter(table, lambda r: F.array_contains(keyed, r["keyword"]))
    found = F.flatten(F.transform(tried, lambda r: _matches(words, r)))
    none = F.lit([]).cast(f"array<{_DETECTION}>")
    held = held.withColumn(names[2], F.when(F.size(keyed) > 0, _unsuppressed(found)).otherwise(none))

    n_words = _spaces(words) - 1
    places, firsts, lasts, labels = [], [], [], []
    for phrase, label in BASE:
        there = F.contains(words, F.lit(f" {phrase} "))
        places.append(F.when(there, F.regexp_count(words, F.lit(f" {phrase}(?= )"))).otherwise(0))
        firsts.append(F.when(there, _spaces(F.substring_index(words, f" {phrase} ", 1))))
        lasts.append(F.when(there, n_words - len(phrase.split()) - _spaces(F.substring_index(words, f" {phrase} ", -1))))
        labels.append(F.when(there, F.lit(label)))
    base = F.array_compact(F.array(*labels))
    sureness = F.element_at(F.array(*[F.lit(SURENESS[p]) for p in sorted(SURENESS)]), F.array_min(F.transform(detected, lambda d: d["priority"])))
    return held.withColumn(out, F.struct(
        n_words.cast("bigint").alias("n_words"), sum(places).cast("bigint").alias("n_base"),
        F.least(*firsts).cast("bigint").alias("first_word"), F.greatest(*lasts).cast("bigint").alias("last_word"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, F.transform(detected, lambda d: d["label"]))), ",").alias("labels"),
        F.when(F.size(detected) > 0, sureness).when(F.size(base) > 0, 0.5).otherwise(0.0).alias("score"),
        F.transform(detected, lambda d: F.struct(d["start"], d["end"], d["label"], d["priority"])).alias("detections"),
    )).drop(*names)
