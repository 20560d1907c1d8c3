"""Licence notices: ordered signature rules over normalized words.

Rules are regular expressions on the lower-cased words of a text, each with a keyword that every match
holds at a word start and that must be in the text before the expression is tried, a label and a priority.
Detections are intervals of words. One that lies within a longer one goes; of equal intervals the rule with
the smaller priority stays.
"""
from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"           # before lower-casing
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

# Fixed phrases: the words of a notice and its label.
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

# Names of a family as expressions, its label, versions and the words that announce one.
FAMILIES = (
    ("gpl", r"(?:gnu )?(?:general public licen[cs]e|gpl)", ("1", "2", "3"), "gpl|general public"),
    ("lgpl", r"(?:gnu )?(?:lesser|library) general public licen[cs]e|(?:gnu )?lgpl", ("2", "2.1", "3"), "lgpl|general public"),
    ("agpl", r"(?:gnu )?affero general public licen[cs]e|(?:gnu )?agpl", ("1", "3"), "agpl|affero"),
    ("fdl", r"(?:gnu )?free documentation licen[cs]e|(?:gnu )?fdl", ("1.1", "1.2", "1.3"), "documentation licen~|fdl"),
    ("apache", r"apache (?:software )?licen[cs]e|asl", ("1.0", "1.1", "2.0"), "apache|asl"),
    ("mpl", r"mozilla public licen[cs]e|mpl", ("1.0", "1.1", "2.0"), "mozilla public|mpl"),
    ("epl", r"eclipse public licen[cs]e|epl", ("1.0", "2.0"), "eclipse public|epl"),
    ("cddl", r"common development and distribution licen[cs]e|cddl", ("1.0", "1.1"), "cddl|common development"),
    ("cpl", r"common public licen[cs]e", ("0.5", "1.0"), "common public"),
    ("eupl", r"european union public licen[cs]e|eupl", ("1.0", "1.1", "1.2"), "european union public|eupl"),
    ("artistic licen~", r"artistic licen[cs]e", ("1.0", "2.0"), "artistic licen~"),
    ("osl", r"open software licen[cs]e", ("1.0", "2.0", "2.1", "3.0"), "open software"),
    ("afl", r"academic free licen[cs]e", ("1.1", "1.2", "2.0", "2.1", "3.0"), "academic free"),
    ("boost", r"boost software licen[cs]e|bsl", ("1.0",), "boost software|bsl"),
    ("python", r"python software foundation licen[cs]e|psf licen[cs]e", ("2",), "python software|psf"),
    ("zope public", r"zope public licen[cs]e", ("1.1", "2.0", "2.1"), "zope public"),
    ("ofl", r"sil open font licen[cs]e|open font licen[cs]e", ("1.0", "1.1"), "font licen~"),
    ("lppl", r"latex project public licen[cs]e|lppl", ("1.0", "1.2", "1.3"), "latex project|lppl"),
    ("unlicense", r"the unlicense", (), "unlicense"),
    ("wtfpl", r"wtfpl|do what the fuck you want to public licen[cs]e", ("2",), "wtfpl|do what the"),
    ("zlib", r"zlib licen[cs]e", (), "zlib licen~"),
    ("isc", r"isc licen[cs]e", (), "isc licen~"),
    ("mit", r"mit(?: x11)? licen[cs]e|expat licen[cs]e", (), "mit licen~|mit x11|expat"),
    ("bsd-2", r"(?:2|two) clause bsd(?: licen[cs]e)?|simplified bsd licen[cs]e|freebsd licen[cs]e", (), "bsd|freebsd"),
    ("bsd-3", r"(?:3|three) clause bsd(?: licen[cs]e)?|(?:new|modified) bsd licen[cs]e", (), "bsd"),
    ("bsd-4", r"(?:4|four) clause bsd(?: licen[cs]e)?|original bsd licen[cs]e", (), "bsd"),
    ("bsd", r"bsd(?: style)? licen[cs]e", (), "bsd"),
)
CC_PARTS = ("by", "by sa", "by nc", "by nd", "by nc sa", "by nc nd")
CC_NAMES = {"by": "attribution", "sa": "share ?alike", "nc": "non ?commercial", "nd": "no ?deriv(?:ative)?s?(?: works)?"}
CC_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")
SPDX = ("0bsd", "afl-3.0", "agpl-3.0", "apache-1.1", "apache-2.0", "artistic-2.0", "bsd-2-clause", "bsd-3-clause",
        "bsl-1.0", "cc0-1.0", "cc-by-4.0", "cc-by-sa-4.0", "cddl-1.0", "ecl-2.0", "epl-1.0", "epl-2.0", "eupl-1.2",
        "gfdl-1.3", "gpl-2.0", "gpl-3.0", "isc", "lgpl-2.1", "lgpl-3.0", "mit", "mpl-2.0", "ms-pl", "ncsa", "ofl-1.1",
        "osl-3.0", "postgresql", "unlicense", "upl-1.0", "wtfpl", "zlib")
NOTICES = (
    ("all-rights-reserved", r"all rights reserved", "rights reserved"),
    ("public-domain", r"(?:dedicated to|released (?:in)?to|placed in) the public domain|public domain dedication", "public domain"),
    ("proprietary", r"proprietary and confidential|unauthori[sz]ed (?:copying|use|distribution) (?:of this \w+ )?is (?:strictly )?prohibited",
     "proprietary|prohibited"),
    ("permissive-text", r"permission is hereby granted free of charge to any person obtaining a copy", "hereby granted"),
    ("isc-text", r"permission to use copy modify and or distribute this software for any purpose", "permission to use"),
    ("bsd-text", r"redistribution and use in source and binary forms with or without modification", "redistribution and use"),
    ("as-is", r"(?:provided|distributed) (?:on an )?as is(?: basis)?(?: without warrant(?:y|ies))?", "as is"),
    ("copyright-line", r"copyright (?:c )?(?:19|20)\d\d(?: (?:19|20)\d\d)*", "copyright"),
)


def _version(text: str) -> str:
    number = text.replace(".", " ")
    zero = "(?: 0)?" if " " not in number else ""
    return rf"(?: v| version)? ?v?{number}{zero}"


def signatures() -> list[tuple[str, str, str, int, float]]:
    """All rules in order: label, expression, keyword expression, priority, weight.

    Each family gives a rule for each version with and without "or later", for a grant ("licensed under
    the ..."), a named link and the bare name; Creative Commons and SPDX identifiers are spelled out.
    """
    rules: list[tuple[str, str, str, float]] = []
    for label in SPDX:
        words = re.sub(r"[^a-z0-9]+", " ", label)
        rules.append((label, rf"spdx license identifier {words}(?: only| or later)?", "spdx", 1.0))
    for parts in CC_PARTS:
        label = "cc-" + parts.replace(" ", "-")
        long = " ".join(CC_NAMES[p] for p in parts.split())
        for version in CC_VERSIONS:
            v = version.replace(".", " ")
            rules.append((f"{label}-{version}", rf"(?:cc|creative commons) {parts} {v}", "cc|creative commons", 1.0))
            rules.append((f"{label}-{version}", rf"creativecommons org licenses {parts} {v}", "creativecommons", 1.0))
            rules.append((f"{label}-{version}", rf"(?:creative commons )?{long} {v}(?: international| generic| unported)?(?: public)? licen[cs]e", "creative commons|attribution", 0.95))
        rules.append((label, rf"(?:cc|creative commons) {parts}", "cc|creative commons", 0.8))
        rules.append((label, rf"creative commons {long}", "creative commons", 0.8))
    rules.append(("cc0", r"cc0(?: 1 0)?(?: universal)?|creative commons zero", "cc0|creative commons", 0.9))
    for label, name, versions, keyword in FAMILIES:
        for version in versions:
            v = _version(version)
            rules.append((f"{label}-{version}-or-later", rf"(?:{name}){v}(?: of the licen[cs]e)? or (?:at your option )?(?:any )?(?:later|newer)(?: version)?", keyword, 1.0))
            rules.append((f"{label}-{version}", rf"(?:{name}){v}(?: only)?", keyword, 0.95))
        rules.append((label, rf"(?:licensed|released|distributed|published|available) under (?:the )?(?:terms of )?(?:the )?(?:{name})", keyword, 0.9))
        rules.append((label, rf"(?:{name})", keyword, 0.6))
    rules += [(label, expression, keyword, 0.4) for label, expression, keyword in NOTICES]
    return [(label, f"(?<= )(?:{expression})(?= )", keyword, k, weight)
            for k, (label, expression, keyword, weight) in enumerate(rules)]


def _phrases(keyword: str) -> list[str]:
    """The literal phrases of a rule's keyword: alternatives, ~ standing for both spellings of license."""
    return [k.replace("~", end) for k in keyword.split("|") for end in (("se", "ce") if "~" in k else ("",))]


def _gate(phrases: list[str]) -> str:
    """An expression that holds for every text with one of the phrases at a word start; the last word may go on,
    as versions are joined to names. Tried at word starts only, by first letter."""
    by_letter: dict[str, list[str]] = {}
    for phrase in sorted(set(phrases)):
        by_letter.setdefault(phrase[0], []).append(phrase[1:].replace(" ", GAP))
    tree = "|".join(f"{letter}(?:{'|'.join(rest)})" for letter, rest in by_letter.items())
    return f"(?i)(?:^|{GAP[:-1]})(?:{tree})"


def normalized(text: Column) -> Column:
    """The words of a text, A-Z lower-cased, with one space around each."""
    return F.concat(F.lit(" "), F.translate(F.trim(F.regexp_replace(text, GAP, " ")), UPPER, UPPER.lower()), F.lit(" "))


def let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def _places(norm: Column, expression: Column) -> Column:
    """Word intervals (at, to) of all matches of an expression in a normalized text.

    The text before a match is the pieces and matches before it, so its spaces tell the match's word.
    """
    found = F.regexp_extract_all(norm, expression, F.lit(0))

    def walk(hits: Column) -> Column:
        pieces = F.split(norm, expression, -1)
        return let(pieces, lambda p: F.aggregate(
            F.transform(hits, lambda m, k: F.struct(_spaces(F.get(p, k)).alias("gap"), _spaces(m).alias("own"))),
            F.struct(F.lit(-1).alias("word"), F.array().cast("array<struct<at:int,to:int>>").alias("out")),
            lambda state, m: F.struct(
                (state["word"] + m["gap"] + m["own"]).alias("word"),
                F.concat(state["out"], F.array(F.struct((state["word"] + m["gap"]).alias("at"),
                                                        (state["word"] + m["gap"] + m["own"] + 1).alias("to")))).alias("out")),
            lambda state: state["out"]))

    return let(found, lambda hits: F.when(F.size(hits) > 0, walk(hits)).otherwise(
        F.array().cast("array<struct<at:int,to:int>>")))


def scan(docs: DataFrame, rules: list[tuple[str, str, str, int, float]] | None = None) -> DataFrame:
    """Columns doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and detections
    (label, at, to, weight; words from 0, end exclusive) of each row of docs.

    Base phrases count at every place and their labels always stay. Of the rules' detections those within
    a longer one, or equal to one of a smaller priority, go; labels are the base ones and those of the
    rest. score is the largest weight among them, at least 0.6 for a base phrase, 0 for a text without any.
    Null and empty texts have no words. Repeated rows are repeated, other columns are ignored. Texts
    without any keyword are only read once, by the gate and the word count.
    """
    rules = signatures() if rules is None else rules
    table = F.array(*(F.struct(F.lit(label).alias("label"), F.lit(expression).alias("expression"),
                               F.array(*map(F.lit, _phrases(keyword))).alias("keywords"), F.lit(k).alias("priority"),
                               F.lit(weight).alias("weight")) for label, expression, keyword, k, weight in rules))
    phrases = sorted({phrase for rule in rules for phrase in _phrases(rule[2])})
    spots = "array<struct<label:string,at:int,to:int,priority:int,weight:double>>"

    def labelled(places: Column, label: Column, priority: Column, weight: Column) -> Column:
        return F.transform(places, lambda p: F.struct(label.alias("label"), p["at"].alias("at"), p["to"].alias("to"),
                                                      priority.alias("priority"), weight.alias("weight")))

    def base(norm: Column) -> Column:
        return F.concat(*(labelled(_places(norm, F.lit(f"(?<= ){phrase}(?= )")), F.lit(label), F.lit(-1), F.lit(0.6))
                          for phrase, label in BASE))

    def ruled(norm: Column) -> Column:
        present = F.filter(F.array(*map(F.lit, phrases)), lambda k: F.contains(norm, F.concat(F.lit(" "), k)))
        tried = let(present, lambda here: F.filter(table, lambda r: F.arrays_overlap(r["keywords"], here)))
        return F.flatten(F.transform(tried, lambda r: labelled(_places(norm, r["expression"]), r["label"],
                                                               r["priority"], r["weight"])))

    def resolved(all_spots: Column) -> Column:
        def beaten(a: Column) -> Column:
            return F.exists(all_spots, lambda b: (b["at"] <= a["at"]) & (b["to"] >= a["to"]) & (
                (b["to"] - b["at"] > a["to"] - a["at"]) | (b["priority"] < a["priority"])))
        return F.filter(all_spots, lambda a: ~beaten(a))

    text = F.coalesce("text", F.lit(""))
    parts = F.when(text.rlike(_gate(phrases + [p for p, _ in BASE])), let(normalized(text), lambda norm: F.struct(
        base(norm).cast(spots).alias("base"), let(ruled(norm).cast(spots), resolved).alias("rules"))))
    none = F.array().cast(spots)
    labels = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    of = lambda a: F.transform(a, lambda x: x["label"])
    return (docs.select("doc_id", F.regexp_count(text, F.lit(WORD)).cast("long").alias("n_words"), parts.alias("p"))
            .select("doc_id", "n_words", F.coalesce("p.base", none).alias("base"), F.coalesce("p.rules", none).alias("rules"))
            .select("doc_id", "n_words", F.size("base").cast("long").alias("n_base"),
                    F.array_min(F.transform("base", lambda x: x["at"])).cast("long").alias("first_word"),
                    F.array_max(F.transform("base", lambda x: x["at"])).cast("long").alias("last_word"),
                    labels(of(F.col("base"))).alias("base_labels"),
                    labels(F.concat(of(F.col("base")), of(F.col("rules")))).alias("labels"),
                    F.coalesce(F.array_max(F.transform(F.concat("base", "rules"), lambda x: x["weight"])), F.lit(0.0)).alias("score"),
                    F.transform("rules", lambda x: F.struct(x["label"].alias("label"), x["at"].alias("at"), x["to"].alias("to"),
                                                            x["weight"].alias("weight"))).alias("detections")))
