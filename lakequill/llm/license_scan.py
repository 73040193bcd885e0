"""License scans: ordered signature rules behind a keyword gate, overlaps resolved by priority and containment.

A text is lower-cased (A-Z) and cut into words of digits, letters and characters
beyond ASCII; rules are regular expressions over words joined by one blank.  A
rule starts with its keyword, so the gate is a set lookup for each word: only
where a word is some rule's keyword are that keyword's rules tried, on the words
from there on (``SPAN``, more than any rule can take) and, for grants, on those
before (``BACK``).  Every place of the whole text is looked at.

Detections are resolved within their text: one goes if another of equal or
better priority covers all its words and is longer, or stands on the same words
with a better priority or an earlier rule.  Detections that only overlap both
stay.  Base rules (plain names) are reported a second time without suppression.

All of it is expressions on one row: no shuffle, no Python worker, and a lost
task is redone alone.  The covering test is a running maximum in blocks, so a
text with very many detections costs n * BLOCK steps, not n squared.

Defined results: a null text is an empty one, without words and detections, score
0.  Very long texts are scanned whole.  Repeated rows each get their result; an
empty table gives an empty one.  A column of the input named like the result is
replaced, all others pass through, whatever their names.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import ascii_lower, col, free_name

#: Fixed value: words of a license text.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases and labels of the base rules.
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

NOTICE, GRANT, TAG, NAME, PLAIN = 1, 2, 3, 4, 5
#: How sure a detection of each priority is that the text carries a license.
WEIGHT = {NOTICE: 1.0, GRANT: 0.95, TAG: 0.9, NAME: 0.75, PLAIN: 0.5}
SPAN, BACK, BLOCK = 64, 8, 256

_GRANTED = "(?:licensed|licenced|released|distributed|available|provided|published|covered|redistributable) (?:under|by) (?:the )?(?:terms of )?(?:the )?"
_TAGGED = "(?:spdx license identifier|license|licence) "
_LATER = "(?: of the license)? or (?:at your option )?any later version"


@dataclass(frozen=True)
class Rule:
    """``pattern`` starts with a literal word, its keyword; ``before`` must end where the pattern starts."""

    label: str
    priority: int
    pattern: str
    before: str | None = None
    base: bool = False

    @property
    def keyword(self) -> str:
        word = re.match(r"[^ ()|?\[\]\\*+.^$]+(?= |$|\(\?: )", self.pattern)
        if not word:
            raise ValueError(f"a rule starts with a literal word: {self.pattern}")
        return word.group()


#: Label, full name, short name, versions (none: the name alone).
_FAMILIES = (
    ("apache", "apache(?: software)? license", "apache", "1.0 1.1 2.0"),
    ("mpl", "mozilla public license", "mpl", "1.0 1.1 2.0"),
    ("epl", "eclipse public license", "epl", "1.0 2.0"),
    ("cddl", "common development and distribution license", "cddl", "1.0 1.1"),
    ("cpl", "common public license", "cpl", "1.0"),
    ("cpal", "common public attribution license", "cpal", "1.0"),
    ("eupl", "european union public licen[cs]e", "eupl", "1.0 1.1 1.2"),
    ("osl", "open software license", "osl", "1.0 2.0 2.1 3.0"),
    ("afl", "academic free license", "afl", "1.1 1.2 2.0 2.1 3.0"),
    ("artistic", "artistic license", "artistic", "1.0 2.0"),
    ("psf", "python software foundation license", "psf", "2.0"),
    ("boost", "boost software license", "bsl", "1.0"),
    ("ofl", "sil open font license", "ofl", "1.0 1.1"),
    ("odbl", "open database license", "odbl", "1.0"),
    ("odc-by", "open data commons attribution license", "odc by", "1.0"),
    ("pddl", "open data commons public domain dedication", "pddl", "1.0"),
    ("cecill", "cecill(?: free software)? license", "cecill", "1.0 1.1 2.0 2.1"),
    ("lppl", "latex project public license", "lppl", "1.0 1.1 1.2 1.3"),
    ("sspl", "server side public license", "sspl", "1.0"),
    ("elastic", "elastic license", "elastic", "1.0 2.0"),
    ("busl", "business source license", "busl", "1.0 1.1"),
    ("php", "php license", "php", "3.0 3.1"),
    ("zpl", "zope public license", "zpl", "1.1 2.0 2.1"),
    ("qpl", "q public license", "qpl", "1.0"),
    ("apsl", "apple public source license", "apsl", "1.0 1.1 1.2 2.0"),
    ("rpl", "reciprocal public license", "rpl", "1.1 1.5"),
    ("nposl", "non profit open software license", "nposl", "3.0"),
    ("upl", "universal permissive license", "upl", "1.0"),
    ("mulan-psl", "mulan permissive software license", "mulanpsl", "1.0 2.0"),
    ("unicode", "unicode license", "unicode", "3.0"),
    ("cc0", "cc0(?: universal)?", "cc0", "1.0"),
    ("mit", "mit(?: x11)? license", "mit", ""),
    ("mit", "expat license", "expat", ""),
    ("x11", "x11 license", "x11", ""),
    ("isc", "isc license", "isc", ""),
    ("zlib", "zlib license", "zlib", ""),
    ("ncsa", "university of illinois ncsa open source license", "ncsa", ""),
    ("ms-pl", "microsoft public license", "ms pl", ""),
    ("ms-rl", "microsoft reciprocal license", "ms rl", ""),
    ("wtfpl", "do what the f[a-z]* you want to public license", "wtfpl", ""),
    ("unlicense", "unlicense", "unlicense", ""),
    ("postgresql", "postgresql license", "postgresql", ""),
    ("openssl", "openssl license", "openssl", ""),
    ("vim", "vim license", "vim", ""),
    ("ruby", "ruby license", "ruby", ""),
    ("json", "json license", "json", ""),
    ("curl", "curl license", "curl", ""),
    ("sleepycat", "sleepycat license", "sleepycat", ""),
    ("beerware", "beer ware license", "beerware", ""),
    ("bsd-2-clause", "simplified bsd license", "bsd 2 clause(?: license)?", ""),
    ("bsd-2-clause", "freebsd license", "bsd 2 clause simplified", ""),
    ("bsd-3-clause", "new bsd license", "bsd 3 clause(?: license)?", ""),
    ("bsd-3-clause", "modified bsd license", "bsd 3 clause new", ""),
    ("bsd-4-clause", "original bsd license", "bsd 4 clause(?: license)?", ""),
    ("bsd", "bsd(?: style)? license", "bsd", ""),
    ("0bsd", "zero clause bsd license", "0bsd", ""),
)
_GNU = (("gpl", "gnu general public license(?: gpl)?", "1.0 2.0 3.0"), ("lgpl", "gnu (?:lesser|library) general public license(?: lgpl)?", "2.0 2.1 3.0"),
        ("agpl", "gnu affero general public license(?: agpl)?", "1.0 3.0"), ("gfdl", "gnu free documentation license(?: gfdl| fdl)?", "1.1 1.2 1.3"))
_CREATIVE = (("by", "attribution"), ("by-sa", "attribution share ?alike"), ("by-nc", "attribution non ?commercial"), ("by-nd", "attribution no ?deriv(?:ative)?s"),
             ("by-nc-sa", "attribution non ?commercial share ?alike"), ("by-nc-nd", "attribution non ?commercial no ?deriv(?:ative)?s"))
#: Sentences of the license texts themselves.
_NOTICES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", "copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", "neither the name of(?: the)?(?: [^ ]+){1,8} nor the names of its contributors may be used to endorse or promote products"),
    ("bsd-4-clause", "advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("mpl-2.0", "source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-1.1", "contents of this file are subject to the mozilla public license version 1 1"),
    ("epl-2.0", "accompanying materials are made available under the terms of the eclipse public license(?: v)? 2 0"),
    ("epl-1.0", "accompanying materials are made available under the terms of the eclipse public license v1 0"),
    ("cddl", "contents of this file are subject to the terms of the common development and distribution license"),
    ("gpl-2.0-or-later", "redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("gpl-3.0-or-later", "redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("lgpl-2.1-or-later", "redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version"),
    ("zlib", "implied warranty in no event will the authors be held liable for any damages"),
    ("zlib", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("boost-1.0", "boost software license version 1 0 august 17th 2003"),
    ("unlicense", "unencumbered software released into the public domain"),
    ("wtfpl", "permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed"),
    ("ofl-1.1", "font software is licensed under the sil open font license version 1 1"),
    ("cc0-1.0", "extent possible under law(?: [^ ]+){1,12} waived all copyright and related or neighboring rights"),
    ("cc-by-4.0", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa-4.0", "licensed under a creative commons attribution share ?alike 4 0 international license"),
    ("beerware", "retain this notice you can do whatever you want with this stuff"),
    ("json", "software shall be used for good not evil"),
    ("public-domain", "dedicated to the public domain"),
    ("public-domain", "released into the public domain"),
    ("proprietary", "rights reserved unauthori[sz]ed copying of this file via any medium is strictly prohibited"),
)


def _version(number: str) -> str:
    major, minor = number.split(".")
    return f"(?: version)?(?: v)? v?{major}" + ("(?: 0)?" if minor == "0" else f" {minor}")


def _named() -> list[tuple[str, str, bool]]:
    """(label, pattern, may it stand without a grant or tag)."""
    out = []
    for label, full, short, versions in _FAMILIES:
        for number in versions.split():
            out += [(f"{label}-{number}", full + _version(number), True), (f"{label}-{number}", short + _version(number), True)]
        out += [(label, full, True), (label, short, not versions and short.count(" ") > 0)]
    for label, full, versions in _GNU:
        for number in versions.split():
            plain = _version(number)
            for name in (full, label):
                published = f"{name}(?: as published by the free software foundation)?(?: either)?{plain}"
                out += [(f"{label}-{number}-or-later", published + _LATER, True), (f"{label}-{number}-or-later", f"{name}{plain} or later", True)]
                out += [(f"{label}-{number}-only", f"{name}{plain} only", True), (f"{label}-{number}", published, True)]
            out.append((f"{label}-{number}", f"{label}v{number.removesuffix('.0').replace('.', ' ')}", True))
        out += [(label, full, True), (label, label, False)]
    for short, full in _CREATIVE:
        words = short.replace("-", " ")
        for number in ("1.0", "2.0", "2.5", "3.0", "4.0"):
            out += [(f"cc-{short}-{number}", f"creative commons {full}{_version(number)}(?: international| unported| generic)?(?: public)?(?: license)?", True)]
            out += [(f"cc-{short}-{number}", f"cc {words}{_version(number)}", True)]
        out += [(f"cc-{short}", f"creative commons {full}(?: license)?", True), (f"cc-{short}", f"cc {words}", True)]
    return out


def signature_rules() -> tuple[Rule, ...]:
    """The rules in order: notices, grants, tags, names, base phrases."""
    named = list(dict.fromkeys(_named()))
    rules = [Rule(label, NOTICE, text) for label, text in _NOTICES]
    rules += [Rule(label, GRANT, text, _GRANTED) for label, text, _ in named]
    rules += [Rule(label, TAG, text, _TAGGED) for label, text, _ in named]
    rules += [Rule(label, NAME, text) for label, text, alone in named if alone]
    return (*rules, *(Rule(label, PLAIN, phrase, base=True) for phrase, label in BASE))


RULES = signature_rules()
_SAME = "struct<pattern:string,rules:array<struct<ord:int,priority:int,label:string,base:boolean,before:string>>>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once: a lambda would compute it at each use."""
    return F.transform(F.array(value), body)[0]


def _rule_map(rules: Sequence[Rule]) -> Column:
    """Keyword to its patterns and their rules, a constant of the plan: its size is that of the rule list, not of the data."""
    by_word: dict[str, dict[str, list[dict]]] = {}
    for number, r in enumerate(rules):
        one = {"ord": number, "priority": r.priority, "label": r.label, "base": r.base, "before": r.before and f"(?:^| ){r.before}$"}
        by_word.setdefault(r.keyword, {}).setdefault(f"^(?:{r.pattern}) ", []).append(one)
    flat = {word: [{"pattern": p, "rules": same} for p, same in found.items()] for word, found in by_word.items()}
    return F.from_json(F.lit(json.dumps(flat)), f"map<string,array<{_SAME}>>")


def _blanks(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def _tried(patterns: Column, ahead: Column, behind: Column, at: Column) -> Column:
    """Detections of the given patterns at one place; words end with a blank each in ``ahead`` and ``behind``."""
    hits = F.transform(patterns, lambda p: F.struct(F.call_function("regexp_extract", ahead, p["pattern"], F.lit(0)).alias("hit"), p["rules"].alias("rules")))

    def led(rule):
        lead = F.when(rule["before"].isNull(), " ").otherwise(F.call_function("regexp_extract", behind, rule["before"], F.lit(0)))
        return F.struct(lead.alias("lead"), rule.alias("rule"))

    def placed(hit):
        return lambda d: F.struct(
            (at - _blanks(F.ltrim(d["lead"]))).alias("start"), (at + _blanks(hit)).alias("end"), d["rule"]["priority"].alias("priority"),
            d["rule"]["ord"].alias("rule"), d["rule"]["label"].alias("label"), d["rule"]["base"].alias("base"),
        )

    each = lambda h: F.transform(F.filter(F.transform(h["rules"], led), lambda d: d["lead"] != ""), placed(h["hit"]))
    return F.flatten(F.transform(F.filter(hits, lambda h: h["hit"] != ""), each))


def _detections(words: Column, rules: Sequence[Rule]) -> Column:
    table = _rule_map(rules)
    keywords = sorted({r.keyword for r in rules})
    places = F.filter(F.transform(words, lambda w, i: F.when(w.isin(keywords), i)), lambda i: i.isNotNull())

    def at(i):
        first = F.greatest(i - BACK, F.lit(0))
        ahead = F.concat(F.array_join(F.slice(words, i + 1, SPAN), " "), F.lit(" "))
        behind = F.when(i > 0, F.concat(F.array_join(F.slice(words, first + 1, i - first), " "), F.lit(" "))).otherwise("")
        return _let(F.struct(ahead.alias("ahead"), behind.alias("behind")), lambda x: _tried(F.element_at(table, F.get(words, i)), x["ahead"], x["behind"], i))

    return F.flatten(F.transform(places, at))


def _most_before(values: Column) -> Column:
    """For each place of an array the largest value ahead of it (-1: none), in blocks."""
    cut = lambda v: F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int")), lambda b: F.slice(v, b * BLOCK + 1, BLOCK))
    first = lambda v, n: F.when(n > 0, F.array_max(F.slice(v, 1, n))).otherwise(-1)
    inside = lambda blocks, tops: F.flatten(F.transform(blocks, lambda v, b: _let(first(tops, b), lambda m: F.transform(v, lambda _, j: F.greatest(m, first(v, j))))))
    return F.when(F.size(values) == 0, F.array().cast("array<int>")).otherwise(
        _let(cut(values), lambda blocks: _let(F.transform(blocks, lambda v: F.array_max(v)), lambda tops: inside(blocks, tops)))
    )


def _resolved(found: Column, priorities: Sequence[int]) -> Column:
    """Detections that none of equal or better priority covers."""

    def of_priority(p):
        ordered = F.array_sort(F.transform(F.filter(found, lambda d: d["priority"] <= p), lambda d: F.struct(d["start"].alias("start"), (-d["end"]).alias("back"), d.alias("d"))))
        most = lambda v: _most_before(F.transform(v, lambda d: d["d"]["end"]))
        free = lambda v, m: F.filter(F.arrays_zip(v.alias("v"), m.alias("m")), lambda x: (x["v"]["d"]["priority"] == p) & (x["m"] < x["v"]["d"]["end"]))
        return F.transform(_let(ordered, lambda v: _let(most(v), lambda m: free(v, m))), lambda x: x["v"]["d"])

    return F.array_sort(F.concat(*[of_priority(p) for p in priorities]))


def scan_licenses(docs: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES, out: str = "licenses") -> DataFrame:
    """``docs`` with a struct column: n_words, found (detections that stay, by place) and base (all base places).

    A detection has start and end (words from 0, the end beyond), priority, rule
    (its place in the rules), label and base; found also has its words.
    """
    kept = [c for c in docs.columns if c.lower() != out.lower()]
    words, spots = free_name(docs, "_words"), free_name(docs, "_spots")
    rows = docs.select(*[col(c) for c in kept], F.regexp_extract_all(ascii_lower(F.coalesce(col(text), F.lit(""))), F.lit(WORD), F.lit(0)).alias(words))
    rows = rows.select(*[col(c) for c in kept], words, _detections(F.col(words), rules).alias(spots))
    shown = lambda d: F.struct(*[d[c].alias(c) for c in ("start", "end", "priority", "rule", "label", "base")], F.array_join(F.slice(words, d["start"] + 1, d["end"] - d["start"]), " ").alias("words"))
    found = _let(F.col(spots), lambda s: F.transform(_resolved(s, sorted({r.priority for r in rules})), shown))
    none = F.from_json(F.lit("[]"), "array<struct<start:int,end:int,priority:int,rule:int,label:string,base:boolean,words:string>>")
    base = F.array_sort(F.filter(spots, lambda d: d["base"]))
    return rows.select(
        *[col(c) for c in kept],
        F.struct(F.size(words).cast("long").alias("n_words"), F.when(F.size(spots) > 0, found).otherwise(none).alias("found"), base.alias("base")).alias(out),
    )


def digest(licenses: str = "licenses") -> list[Column]:
    """Columns of a report: counts, places, labels and score."""
    s = F.col(licenses)
    starts = F.transform(s["base"], lambda d: d["start"].cast("long"))
    names = lambda found: F.transform(found, lambda d: d["label"])
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    weight = F.create_map(*[F.lit(x) for pair in WEIGHT.items() for x in pair])
    best = F.array_min(F.transform(F.concat(F.transform(s["found"], lambda d: d["priority"]), F.transform(s["base"], lambda d: d["priority"])), lambda p: p))
    return [
        s["n_words"].alias("n_words"), F.size(s["base"]).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        joined(names(s["base"])).alias("base_labels"), joined(F.concat(names(s["base"]), names(s["found"]))).alias("labels"),
        F.coalesce(F.element_at(weight, best), F.lit(0.0)).alias("score"),
    ]
