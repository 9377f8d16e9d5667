"""License scan: ordered signature rules over words, in SQL functions alone.

A text becomes its lower-case words, each followed by a space. Rules are regular
expressions over that form, gated by a keyword: a rule is tried only where the text
holds its keyword, and a text without any keyword skips the scan. Where detections
overlap, one that lies inside another of the same or a stronger priority is suppressed;
base phrases are always kept.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = "abcdefghijklmnopqrstuvwxyz"
#: A word of the contract, on text whose capitals are still there.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: Base phrases: (words, label).
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))


@dataclass(frozen=True)
class Rule:
    """``pattern`` over lower-case words, each with a space behind; smaller priority is stronger."""

    keyword: str
    pattern: str
    label: str
    priority: int
    confidence: float


def _rules() -> tuple[Rule, ...]:
    """The signature rules in their order, written by family.

    ``~`` in a pattern stands for one optional word of a few, ``#`` for a version.
    """
    out: list[Rule] = []

    def add(keyword: str, label: str, priority: int, confidence: float, *patterns: str) -> None:
        for p in patterns:
            p = p.replace("#", r"(?:version |v )?(?:v?[0-9]+ )(?:[0-9]+ )?")
            p = p.replace("~", r"(?:[a-z0-9]+ ){0,3}?")
            out.append(Rule(keyword, p, label, priority, confidence))

    # Tags: the strongest evidence.
    for name, label in (
        ("mit", "mit"), ("apache 2 0", "apache-2.0"), ("gpl 2 0 only", "gpl-2.0"), ("gpl 2 0 or later", "gpl-2.0+"),
        ("gpl 3 0 only", "gpl-3.0"), ("gpl 3 0 or later", "gpl-3.0+"), ("lgpl 2 1 only", "lgpl-2.1"),
        ("lgpl 2 1 or later", "lgpl-2.1+"), ("lgpl 3 0 only", "lgpl-3.0"), ("lgpl 3 0 or later", "lgpl-3.0+"),
        ("agpl 3 0 only", "agpl-3.0"), ("agpl 3 0 or later", "agpl-3.0+"), ("bsd 2 clause", "bsd-2-clause"),
        ("bsd 3 clause", "bsd-3-clause"), ("isc", "isc"), ("mpl 2 0", "mpl-2.0"), ("epl 1 0", "epl-1.0"),
        ("epl 2 0", "epl-2.0"), ("cc0 1 0", "cc0-1.0"), ("cc by 4 0", "cc-by-4.0"), ("cc by sa 4 0", "cc-by-sa-4.0"),
        ("cc by nc 4 0", "cc-by-nc-4.0"), ("cc by nd 4 0", "cc-by-nd-4.0"), ("unlicense", "unlicense"),
        ("zlib", "zlib"), ("bsl 1 0", "bsl-1.0"), ("wtfpl", "wtfpl"), ("artistic 2 0", "artistic-2.0"),
        ("0bsd", "0bsd"), ("ms pl", "ms-pl"), ("ncsa", "ncsa"), ("postgresql", "postgresql"), ("ofl 1 1", "ofl-1.1"),
        ("cddl 1 0", "cddl-1.0"), ("eupl 1 2", "eupl-1.2"), ("python 2 0", "python-2.0"), ("x11", "x11"),
        ("vim", "vim"), ("w3c", "w3c"), ("odbl 1 0", "odbl-1.0"), ("blueoak 1 0 0", "blueoak-1.0.0"),
    ):
        add("spdx", label, 1, 1.0, rf"spdx license identifier {name} ")

    # Titles of licenses, with and without versions.
    for title, label, versions in (
        ("apache", "apache", ("1 0", "1 1", "2 0")),
        ("mozilla public", "mpl", ("1 0", "1 1", "2 0")),
        ("eclipse public", "epl", ("1 0", "2 0")),
        ("academic free", "afl", ("2 1", "3 0")),
        ("artistic", "artistic", ("1 0", "2 0")),
        ("open software", "osl", ("2 1", "3 0")),
        ("common public", "cpl", ("1 0",)),
        ("educational community", "ecl", ("1 0", "2 0")),
        ("european union public", "eupl", ("1 1", "1 2")),
        ("open font", "ofl", ("1 0", "1 1")),
        ("boost software", "bsl", ("1 0",)),
        ("common development and distribution", "cddl", ("1 0", "1 1")),
        ("open database", "odbl", ("1 0",)),
        ("microsoft public", "ms-pl", ()),
        ("microsoft reciprocal", "ms-rl", ()),
        ("zope public", "zpl", ("1 1", "2 0", "2 1")),
        ("sleepycat", "sleepycat", ()),
        ("python software foundation", "psf", ("2",)),
        ("university of illinois ncsa open source", "ncsa", ()),
        ("business source", "busl", ("1 1",)),
        ("server side public", "sspl", ("1",)),
        ("elastic", "elastic", ("1", "2 0")),
        ("do what the fuck you want to public", "wtfpl", ("2",)),
        ("postgresql", "postgresql", ()),
        ("openssl", "openssl", ()),
        ("php", "php", ("3 0", "3 01")),
        ("ruby", "ruby", ()),
        ("zlib", "zlib", ()),
        ("curl", "curl", ()),
        ("isc", "isc", ()),
        ("mit", "mit", ()),
        ("bsd", "bsd", ()),
        ("x11", "x11", ()),
        ("eiffel forum", "efl", ("2",)),
        ("reciprocal public", "rpl", ("1 5",)),
        ("q public", "qpl", ("1 0",)),
        ("nethack general public", "ngpl", ()),
        ("lucent public", "lpl", ("1 02",)),
        ("ibm public", "ipl", ("1 0",)),
        ("intel open source", "intel", ()),
        ("netscape public", "npl", ("1 0", "1 1")),
        ("sun industry standards source", "sissl", ()),
        ("vovida software", "vsl", ("1 0",)),
        ("w3c software", "w3c", ()),
        ("creative commons", "cc", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ):
        add("licen", label, 3, 0.8, rf"{title} licen[cs]e ")
        for v in versions:
            add("licen", f"{label}-{v.replace(' ', '.')}", 2, 0.95, rf"{title} licen[cs]e (?:version |v )?v?{v} ")

    # The GNU family: base name, versions, options, abbreviations.
    for name, label in (("", "gpl"), ("lesser ", "lgpl"), ("library ", "lgpl"), ("affero ", "agpl"), ("free documentation ", "gfdl")):
        body = "license " if label == "gfdl" else "general public license "
        add("licen", label, 3, 0.85, rf"gnu {name}{body}")
        for v in ("1", "2", "2 1", "3"):
            if (label, v) in (("gpl", "2 1"), ("agpl", "2"), ("agpl", "2 1"), ("gfdl", "2"), ("gfdl", "2 1")):
                continue
            dotted = v.replace(" ", ".") if " " in v else v + ".0"
            add("licen", f"{label}-{dotted}", 2, 0.95, rf"(?:gnu )?{name}{body}(?:as published by the free software foundation )?(?:either )?(?:version |v ){v} (?:0 )?(?!or (?:any )?later)")
            add("licen", f"{label}-{dotted}+", 1, 0.97, rf"(?:gnu )?{name}{body}(?:as published by the free software foundation )?(?:either )?(?:version |v ){v} (?:0 )?(?:of the license )?or (?:at your option )?(?:any )?later ")
    for name in ("gpl", "lgpl", "agpl", "gfdl"):
        add(name, name, 4, 0.5, rf"{name} (?=licen[cs]ed? )", rf"under ~{name} ")
        for v in ("1", "2", "2 1", "3"):
            dotted = v.replace(" ", ".") if " " in v else v + ".0"
            add(name, f"{name}-{dotted}", 3, 0.8, rf"{name} ?v?{v} (?:0 )?", rf"{name}v{v} ")

    # BSD by the number of clauses, and its clauses in words.
    for n, word in ((1, "one"), (2, "two"), (3, "three"), (4, "four")):
        add("bsd", f"bsd-{n}-clause", 2, 0.9, rf"(?:{n}|{word}) clause bsd ", rf"bsd (?:{n}|{word}) clause ")
    add("bsd", "bsd", 3, 0.75, r"new bsd ", r"modified bsd ", r"simplified bsd ", r"bsd style ", r"original bsd ", r"freebsd copyright ")
    add("redistribution", "bsd-2-clause", 3, 0.8, r"redistribution and use in source and binary forms with or without modification are permitted ")
    add("redistributions", "bsd-2-clause", 4, 0.7, r"redistributions of source code must retain the above copyright notice ", r"redistributions in binary form must reproduce the above copyright notice ")
    add("endorse", "bsd-3-clause", 3, 0.85, r"may be used to endorse or promote products derived from this software without ")
    add("acknowledg", "bsd-4-clause", 3, 0.85, r"must display the following acknowledg[e]?ment ")

    # Grants and notices in words.
    add("granted", "mit", 3, 0.9, r"permission is hereby granted free of charge to any person obtaining a copy ")
    add("granted", "isc", 3, 0.85, r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted ")
    add("granted", "hpnd", 4, 0.7, r"permission to use copy modify and distribute this software and its documentation ~for any purpose ~is hereby granted ")
    add("warrant", "disclaimer", 5, 0.3, r"without warranty of any kind ", r"without warranties or conditions of any kind ", r"without any warranty ", r"provided as is without ~warranty ")
    add("provided", "disclaimer", 5, 0.3, r"the software is provided as is ")
    add("implied", "disclaimer", 5, 0.3, r"any express or implied warranties ")
    add("notice", "mit", 4, 0.7, r"the above copyright notice and this permission notice shall be included ")
    add("altered", "zlib", 3, 0.85, r"altered source versions must be plainly marked as such ")
    add("origin", "zlib", 3, 0.85, r"the origin of this software must not be misrepresented ")
    add("compliance", "apache-2.0", 3, 0.9, r"you may not use this file except in compliance with the license ")
    add("unencumbered", "unlicense", 3, 0.9, r"free and unencumbered software released into the public domain ")
    add("domain", "public-domain", 4, 0.6, r"(?:released|dedicated|placed) (?:in|in|to) ?(?:in)?to the public domain ", r"(?:is|are) in the public domain ", r"public domain dedication ")
    add("beer", "beerware", 3, 0.9, r"beer ?ware license ", r"you can buy me a beer in return ")
    add("wtfpl", "wtfpl", 3, 0.9, r"wtfpl ")
    add("warranties", "disclaimer", 5, 0.3, r"disclaims all warranties ")
    for word in ("released", "licensed", "distributed", "available", "covered", "provided", "published", "offered", "shared", "governed"):
        for name, label in (
            ("mit", "mit"), ("apache", "apache"), ("bsd", "bsd"), ("isc", "isc"), ("mozilla public", "mpl"),
            ("eclipse public", "epl"), ("gnu general public", "gpl"), ("gnu lesser general public", "lgpl"),
            ("gnu affero general public", "agpl"), ("creative commons", "cc"), ("boost software", "bsl"),
            ("artistic", "artistic"), ("zlib", "zlib"),
        ):
            add(word, label, 2, 0.9, rf"{word} (?:under|by) (?:the )?(?:terms of )?(?:the )?{name} licen[cs]e ")
    for code in ("by", "by sa", "by nc", "by nd", "by nc sa", "by nc nd"):
        dashed = code.replace(" ", "-")
        for v in ("1 0", "2 0", "2 5", "3 0", "4 0"):
            add("cc by", f"cc-{dashed}-{v.replace(' ', '.')}", 2, 0.9, rf"cc {code} {v} ")
    for phrase, label in (
        ("attribution", "cc-by"), ("attribution share ?alike", "cc-by-sa"), ("attribution non ?commercial", "cc-by-nc"),
        ("attribution no ?deriv(?:ative)?s", "cc-by-nd"), ("attribution non ?commercial share ?alike", "cc-by-nc-sa"),
        ("attribution non ?commercial no ?deriv(?:ative)?s", "cc-by-nc-nd"), ("zero", "cc0"),
    ):
        add("creative", label, 2, 0.9, rf"creative commons {phrase} ")
        for v in ("2 0", "3 0", "4 0"):
            add("creative", f"{label}-{v.replace(' ', '.')}", 1, 0.95, rf"creative commons {phrase} {v} ")
    add("rights", "proprietary", 5, 0.4, r"all rights reserved ", r"some rights reserved ")
    add("confidential", "proprietary", 3, 0.8, r"proprietary and confidential ", r"confidential and proprietary ")
    add("redistribute", "proprietary", 4, 0.6, r"(?:may|do) not (?:copy or )?redistribute ", r"redistribute without ~permission ")
    for phrase, label in BASE:
        out.append(Rule("licen", phrase + " ", label, 0, 0.8))
    return tuple(out)


RULES = _rules()
#: Distinct keywords; the gate of the whole scan.
KEYWORDS = tuple(dict.fromkeys(r.keyword for r in RULES))
#: What the raw text must hold for a keyword to stand in it: the first words of the
#: keywords, without those that hold another one.
_FIRST = tuple(dict.fromkeys(w.split(" ")[0] for w in KEYWORDS))
GATE = tuple(w for w in _FIRST if not any(o != w and o in w for o in _FIRST))


def _sql_string(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _rule_table() -> Column:
    """The rules as one constant: an array, for each keyword, of its rules."""
    groups = []
    for word in KEYWORDS:
        own = ", ".join(
            f"named_struct('p', {_sql_string('(?<![^ ])' + r.pattern)}, 'label', {_sql_string(r.label)}, "
            f"'priority', {r.priority}, 'confidence', {r.confidence}D, 'base', {str(r.priority == 0).lower()})"
            for r in RULES
            if r.keyword == word
        )
        groups.append(f"named_struct('keyword', {_sql_string(word)}, 'rules', array({own}))")
    return F.expr(f"array({', '.join(groups)})")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def word_form(text: Column) -> Column:
    """The lower-case words of ``text``, a space behind each."""
    bare = F.regexp_replace(lower_ascii(text), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")
    return F.when(F.length(F.trim(bare)) == 0, "").otherwise(F.concat(F.trim(bare), F.lit(" ")))


def _spaces(s: Column) -> Column:
    return F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))


def _matched_rules(form: Column) -> Column:
    """The rules that match ``form``, with the numbers of words of their matches and between them.

    Each pattern runs once for the matches and once for what lies between; only numbers
    go on, so a text of very many matches costs its length.
    """

    def of_rule(rule: Column) -> Column:
        return F.struct(
            rule["priority"].alias("priority"),
            rule["label"].alias("label"),
            rule["confidence"].alias("confidence"),
            rule["base"].alias("base"),
            rule["p"].alias("p"),
            F.transform(F.regexp_extract_all(form, rule["p"], F.lit(0)), _spaces).alias("inside"),
            F.transform(F.split(form, rule["p"]), _spaces).alias("between"),
        )

    tried = F.filter(_rule_table(), lambda g: F.contains(form, g["keyword"]))
    rules = F.flatten(F.transform(tried, lambda g: F.filter(g["rules"], lambda r: F.rlike(form, r["p"]))))
    return F.transform(rules, of_rule)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """License detections of every row of ``docs``, a row for each.

    ``n_words``, ``n_base``, ``first_word``, ``last_word`` and ``base_labels`` follow the
    base phrases; ``labels`` adds those of the rules that were not suppressed; ``score``
    is the chance that at least one kept detection is right, as their confidences have
    it; ``n_detections`` counts the kept ones. A null text counts as empty; a null id
    stays null; repeated rows give repeated results; an empty table gives none; other
    columns are ignored. Detections of one document travel in one small shuffle keyed
    by row, never by text.
    """
    form = F.col("form")
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    any_word = reduce(or_, (F.contains(F.lower(text), F.lit(w)) for w in GATE))
    rows = docs.select(
        docs[id_col].cast("long").alias("doc_id"),
        F.monotonically_increasing_id().alias("row"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("n_words"),
        F.when(any_word, word_form(text)).alias("form"),
    )
    found = F.when(form.isNotNull(), _matched_rules(form))
    rows = rows.select("doc_id", "row", "n_words", F.explode_outer(found).alias("r"))
    rows = rows.select("doc_id", "row", "n_words", "r.*")
    rows = rows.select(
        "doc_id", "row", "n_words", "priority", "label", "confidence", "base", "p",
        F.posexplode_outer(F.arrays_zip("inside", F.slice("between", 1, F.size("inside")).alias("before"))).alias("k", "m"),
    ).repartition("row")
    # Words up to the end of a match: those of all matches of its rule so far and before them.
    so_far = Window.partitionBy("row", "p").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("end", F.sum(F.col("m.inside") + F.col("m.before")).over(so_far)).withColumn("start", F.col("end") - F.col("m.inside"))

    # A detection lies inside another one exactly if an earlier one, by start and then by
    # descending end, ends no sooner; the order also settles equal spans.
    earlier = (
        Window.partitionBy("row")
        .orderBy("start", F.desc("end"), "priority", "label")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    covered = F.lit(False)
    for p in sorted({r.priority for r in RULES} - {0}):
        reach = F.max(F.when((F.col("priority") <= p), F.col("end"))).over(earlier)
        covered = covered | ((F.col("priority") == p) & (reach >= F.col("end")))
    rows = rows.withColumn("kept", F.col("start").isNotNull() & (F.col("base") | ~F.coalesce(covered, F.lit(False))))
    kept, base = F.col("kept"), F.col("base") & F.col("kept")
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    miss = F.sum(F.when(kept, F.log(1 - F.least(F.col("confidence"), F.lit(0.999)))))
    return rows.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"),
        F.first("n_words").alias("n_words"),
        F.count_if(base).cast("long").alias("n_base"),
        F.min(F.when(base, F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("start"))).cast("long").alias("last_word"),
        joined(F.when(base, F.col("label"))).alias("base_labels"),
        joined(F.when(kept, F.col("label"))).alias("labels"),
        F.coalesce(F.round(1 - F.exp(miss), 6), F.lit(0.0)).alias("score"),
        F.count_if(kept).cast("long").alias("n_detections"),
    ).drop("row")
