"""License scan by ordered signature rules, with DataFrame functions only.

A rule has a label, keywords, a priority and a regex over the text's lower-cased
words joined by single spaces. Names of licenses meet rules for the ways to announce
one, SPDX expressions and denials among them; notices, conditions and headers that
name no license are rules of their own. A detection is dropped if its interval lies
in that of a detection of the same or a better priority; of equal intervals the
better priority, then the earlier rule, stays. Denials are of the best priority and
have no label, so "not under the gpl 2 license" takes what is inside it away.

Texts without any gate word never meet a regex. The others meet the names and notices
whose keyword they contain, and each place found meets the rules of its name in the
``REACH`` characters ahead of it and behind it, which no rule exceeds. So a text is
read once a name, not once a rule.

Base phrases are looked up word by word beside the rules and always kept.

Gated texts are reduced to distinct ones before the rules run, so a license that is
copied a million times is scanned once; no text is shuffled otherwise.

Defined results: an empty table gives an empty result; null or empty text has no words, no labels and score 0; repeated
rows get equal results; other columns are carried along.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
# What no word holds, as Java's classes: control characters, space and punctuation of ASCII.
SEPARATOR = r"[\x00-\x20\p{Punct}\x7F]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BASE_PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)
# What may not follow a name without a version: its version, or the start of a header that tells it.
_BARE = r"(?! as published)(?!(?: licen[sc]e)?(?: version| v)? ?\d)"
# Label, keywords (every match holds one of them), regex of the name among words that are joined by one space.
FAMILIES = (
    ("mit", ("mit",), r"(?:the )?mit(?: expat| x11)?"),
    ("mit-0", ("mit",), r"mit (?:0|no attribution)"),
    ("apache-2", ("apache",), r"(?:the )?apache(?: software)?(?: license| licence)?(?: version| v)? ?2(?: 0)?"),
    ("apache-1.1", ("apache",), r"(?:the )?apache(?: software)?(?: license)?(?: version)? 1 1"),
    ("apache-1", ("apache",), r"(?:the )?apache(?: software)?(?: license)?(?: version)? 1 0"),
    ("bsd-2", ("bsd",), r"(?:the )?(?:simplified bsd|freebsd|bsd 2 clause|2 clause bsd|two clause bsd)"),
    ("bsd-3", ("bsd",), r"(?:the )?(?:modified bsd|new bsd|revised bsd|bsd 3 clause|3 clause bsd|three clause bsd)"),
    ("bsd-4", ("bsd",), r"(?:the )?(?:original bsd|bsd 4 clause|4 clause bsd)"),
    ("0bsd", ("0bsd",), r"0bsd"),
    ("isc", ("isc",), r"(?:the )?isc"),
    ("gpl-1", ("gpl", "general public"), r"(?:the )?(?:gnu )?(?:gpl|general public license)(?: version| v)? ?1(?: 0)?"),
    ("gpl-2", ("gpl", "general public"), r"(?:the )?(?:gnu )?(?:gpl|general public license)(?: version| v)? ?2(?: 0)?(?: only)?"),
    ("gpl-2+", ("later",), r"(?:the )?(?:gnu )?(?:gpl|general public license)(?: version| v)? ?2(?: 0)? or(?: at your option)?(?: any)? later"),
    ("gpl-3", ("gpl", "general public"), r"(?:the )?(?:gnu )?(?:gpl|general public license)(?: version| v)? ?3(?: 0)?(?: only)?"),
    ("gpl-3+", ("later",), r"(?:the )?(?:gnu )?(?:gpl|general public license)(?: version| v)? ?3(?: 0)? or(?: at your option)?(?: any)? later"),
    ("lgpl-2", ("lgpl", "general public"), r"(?:the )?(?:gnu )?(?:lgpl|library general public license)(?: version| v)? ?2(?: 0)?"),
    ("lgpl-2.1", ("lgpl", "general public"), r"(?:the )?(?:gnu )?(?:lgpl|lesser general public license)(?: version| v)? ?2 1"),
    ("lgpl-3", ("lgpl", "general public"), r"(?:the )?(?:gnu )?(?:lgpl|lesser general public license)(?: version| v)? ?3(?: 0)?"),
    ("agpl-3", ("agpl", "affero"), r"(?:the )?(?:gnu )?(?:agpl|affero general public license)(?: version| v)? ?3(?: 0)?"),
    ("mpl-1.1", ("mpl", "mozilla"), r"(?:the )?(?:mpl|mozilla public license)(?: version| v)? ?1 1"),
    ("mpl-2", ("mpl", "mozilla"), r"(?:the )?(?:mpl|mozilla public license)(?: version| v)? ?2(?: 0)?"),
    ("epl-1", ("ecl",), r"(?:the )?eclipse public license(?: version| v)? ?1(?: 0)?"),
    ("epl-2", ("ecl",), r"(?:the )?eclipse public license(?: version| v)? ?2(?: 0)?"),
    ("cddl-1", ("cddl",), r"(?:the )?cddl(?: version| v)? ?1(?: 0)?"),
    ("eupl-1.2", ("eupl",), r"(?:the )?eupl(?: version| v)? ?1 2"),
    ("artistic-2", ("artistic",), r"(?:the )?artistic(?: license)?(?: version)? 2(?: 0)?"),
    ("artistic-1", ("artistic",), r"(?:the )?artistic(?: license)?(?: version)? 1(?: 0)?"),
    ("boost-1", ("boost",), r"(?:the )?boost software(?: license)?(?: version)?(?: 1 0)?"),
    ("zlib", ("zlib",), r"(?:the )?zlib(?: libpng)?"),
    ("unlicense", ("unlicense",), r"(?:the )?unlicense"),
    ("wtfpl", ("wtfpl",), r"(?:the )?wtfpl"),
    ("cc0-1", ("cc0",), r"cc0(?: 1 0)?(?: universal)?"),
    ("cc-by", ("cc by", "cc attribution", "creative commons"), r"(?:cc|creative commons) (?:by|attribution)(?: [1-4] \d)?"),
    ("cc-by-sa", ("sa", "alike"), r"(?:cc|creative commons) (?:by|attribution) (?:sa|share ?alike)(?: [1-4] \d)?"),
    ("cc-by-nd", ("n",), r"(?:cc|creative commons) (?:by|attribution) (?:nd|no ?deriv(?:ative)?s)(?: [1-4] \d)?"),
    ("cc-by-nc", ("nc", "commercial"), r"(?:cc|creative commons) (?:by|attribution) (?:nc|non ?commercial)(?: [1-4] \d)?"),
    ("cc-by-nc-sa", ("sa", "alike"), r"(?:cc|creative commons) (?:by|attribution) (?:nc|non ?commercial) (?:sa|share ?alike)(?: [1-4] \d)?"),
    ("cc-by-nc-nd", ("nd", "deriv"), r"(?:cc|creative commons) (?:by|attribution) (?:nc|non ?commercial) (?:nd|no ?deriv(?:ative)?s)(?: [1-4] \d)?"),
    ("odbl-1", ("odbl",), r"odbl(?: 1 0)?"),
    ("ofl-1.1", ("sil",), r"(?:the )?sil open font(?: license)?(?: version)?(?: 1 1)?"),
    ("python-2", ("python",), r"(?:the )?python software foundation"),
    ("ncsa", ("ncsa",), r"(?:the )?(?:university of illinois )?ncsa(?: open source)?"),
    ("proprietary", ("reserved",), r"all rights reserved"),
    ("apache", ("apache",), r"(?:the )?apache(?: software)?" + _BARE),
    ("bsd", ("bsd",), r"(?:the )?bsd" + _BARE),
    ("gpl", ("gpl", "general public"), r"(?:the )?(?:gnu )?(?:gpl|general public license)" + _BARE),
    ("lgpl", ("lgpl", "general public"), r"(?:the )?(?:gnu )?(?:lgpl|lesser general public license)" + _BARE),
    ("agpl", ("agpl", "affero"), r"(?:the )?(?:gnu )?(?:agpl|affero general public license)" + _BARE),
    ("mpl", ("mpl", "mozilla"), r"(?:the )?(?:mpl|mozilla public license)" + _BARE),
)
_OF = r"(?:the )?(?:terms (?:and conditions )?of )?"
_TOLD = r"(?:(?:re|dual )?licen[sc]ed|released|distributed|published|provided|(?:made )?available|shared|offered|covered|governed) "
# Priority (1 is best) and regex around a name.
WAYS = (
    (1, r"spdx license identifier {}"),
    (1, r"(?={0} )(?<=spdx license identifier [0-9a-z ]{{1,120}} (?:or|and) ){0}"),
    (2, r"(?:licen[sc]ed|relicensed|dual licen[sc]ed) under " + _OF + r"{}(?: public)?(?: licen[sc]e)?"),
    (2, r"(?:released|distributed|published|provided|(?:made )?available|shared|offered) under " + _OF + r"{}(?: licen[sc]e)?"),
    (2, r"(?:subject to|governed by|covered by) " + _OF + r"{}(?: licen[sc]e)?"),
    (3, r"under " + _OF + r"{} licen[sc]e"),
    (3, r"licen[sc]e(?: is| type| name)? {}"),
    (4, r"{} licen[sc]ed?"),
)
# A denial takes what is inside it away.
DENIAL = (0, r"(?:not|never|no longer) (?:" + _TOLD + r")?(?:under|by) " + _OF + r"{}(?: licen[sc]e)?")
# Characters that a rule may span ahead of a name and behind it.
REACH = 260, 40
# Names that say it all by themselves.
ALONE = ("0bsd", "gpl-2", "gpl-2+", "gpl-3", "gpl-3+", "lgpl-2.1", "lgpl-3", "agpl-3", "mpl-2", "unlicense", "wtfpl", "cc0-1",
         "cc-by", "cc-by-sa", "cc-by-nd", "cc-by-nc", "cc-by-nc-sa", "cc-by-nc-nd", "proprietary")
_FSF = " as published by the free software foundation (?:either )?version "
_LATER = "(?: of the license)?(?: or)?(?: at your option)? any later version"
# Notices, conditions and headers: label, priority, keywords (every match holds one of them), regex.
SIGNATURES = (
    ("mit", 2, ("hereby granted",), r"permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("boost-1", 2, ("hereby granted",), r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software"),
    ("isc", 2, ("hereby granted",), r"permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted provided that"),
    ("0bsd", 2, ("hereby granted",), r"permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted(?! provided)"),
    ("bsd", 3, ("redistribution and use",), r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3", 2, ("nor the names",), r"neither the name of (?:[^ ]{1,40} ){1,12}?nor the names of (?:its|the|any) (?:copyright holders or )?contributors may be used to endorse"),
    ("bsd-4", 2, ("advertising materials",), r"all advertising materials mentioning features or use of this software must display"),
    ("apache-2", 2, ("in compliance",), r"you may not use this file except in compliance with the license"),
    ("apache-2", 2, ("apache org",), r"apache org licenses license 2 0"),
    ("gpl-2", 2, ("general public",), "(?:gnu )?general public license" + _FSF + "2(?: 0)?(?: of the license)?"),
    ("gpl-2+", 2, ("later",), "(?:gnu )?general public license" + _FSF + "2(?: 0)?" + _LATER),
    ("gpl-3", 2, ("general public",), "(?:gnu )?general public license" + _FSF + "3(?: 0)?(?: of the license)?"),
    ("gpl-3+", 2, ("later",), "(?:gnu )?general public license" + _FSF + "3(?: 0)?" + _LATER),
    ("lgpl-2.1", 2, ("general public",), "(?:gnu )?lesser general public license" + _FSF + "2 1(?: of the license)?(?:" + _LATER + ")?"),
    ("lgpl-3", 2, ("general public",), "(?:gnu )?lesser general public license" + _FSF + "3(?: 0)?(?: of the license)?(?:" + _LATER + ")?"),
    ("agpl-3", 2, ("affero",), "(?:gnu )?affero general public license" + _FSF + "3(?: 0)?(?: of the license)?(?:" + _LATER + ")?"),
    ("mpl-2", 2, ("source code form",), r"this source code form is subject to the terms of the mozilla public license v(?:ersion)? 2 0"),
    ("epl-2", 2, ("accompanying materials",), r"the accompanying materials are made available under the terms of the eclipse public license v(?:ersion)? ?2 0"),
    ("unlicense", 2, ("unencumbered",), r"this is free and unencumbered software released into the public domain"),
    ("public-domain", 3, ("public domain",), r"(?:dedicated to|released into|placed in(?:to)?|donated to) the public domain"),
    ("zlib", 2, ("held liable",), r"provided as is without any express or implied warranty in no event will the authors be held liable for any damages"),
    ("wtfpl", 2, ("you want to public",), r"do what the [^ ]{1,8} you want to public license"),
    ("cc0-1", 2, ("creativecommons org",), r"creativecommons org publicdomain zero 1 0"),
    ("cc-by", 2, ("creativecommons org",), r"creativecommons org licenses by [1-4] \d"),
    ("cc-by-sa", 2, ("creativecommons org",), r"creativecommons org licenses by sa [1-4] \d"),
    ("cc-by-nd", 2, ("creativecommons org",), r"creativecommons org licenses by nd [1-4] \d"),
    ("cc-by-nc", 2, ("creativecommons org",), r"creativecommons org licenses by nc [1-4] \d"),
    ("cc-by-nc-sa", 2, ("creativecommons org",), r"creativecommons org licenses by nc sa [1-4] \d"),
    ("cc-by-nc-nd", 2, ("creativecommons org",), r"creativecommons org licenses by nc nd [1-4] \d"),
)
_SEP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# A text without any of these, in lower case, holds no license ...
GATE = ("licen", "gpl", "spdx", "reserved", "0bsd", "wtfpl", "cc0", "cc", "mpl", "creative", "under", "subject", "governed", "covered",
        "hereby", "redistribution", "advertising", "endorse", "unencumbered", "domain", "liable", "creativecommons")
# ... nor does one without this.
SURE = (
    r"licen[sc]|gpl|spdx|0bsd|wtfpl|cc0|(?<![0-9a-z])mpl|rights{s}reserved|creative{s}commons|(?<![0-9a-z])cc{s}(?:by|attribution)"
    r"|(?<![0-9a-z])(?:under|by|to){s}(?:(?:the|terms|and|conditions|of|gnu){s})*"
    r"(?:mit|apache|bsd|isc|mpl|mozilla|eclipse|cddl|eupl|artistic|boost|zlib|python|ncsa|odbl|sil|university|freebsd"
    r"|simplified|modified|new|revised|original|two|three|[234](?![0-9]))(?![a-z])"
    r"|hereby{s}granted|redistribution{s}and{s}use|advertising{s}materials|nor{s}the{s}names|unencumbered|public{s}domain|held{s}liable|creativecommons"
).replace("{s}", _SEP)


def cores() -> list[tuple[str, tuple[str, ...], str, list[tuple[int, int, str, str]]]]:
    """(name, keywords, regex of the core, rules around it) of every name and notice.

    A rule is (order, priority, label, regex) and each of its matches holds a match of its core. The label of a denial is empty.
    """
    made, order = [], 0
    for label, keywords, name in FAMILIES:
        around = [(p, label, way.format(f"(?:{name})")) for p, way in WAYS] + [(DENIAL[0], "", DENIAL[1].format(f"(?:{name})"))]
        around += [(3, label, name)] if label in ALONE else []
        made.append((label, keywords, name, around))
    made += [(label, keywords, regex, [(p, label, regex)]) for label, p, keywords, regex in SIGNATURES]
    out = []
    for label, keywords, core, around in made:
        numbered = [(order + i, p, name, rf"(?<= ){regex}(?= )") for i, (p, name, regex) in enumerate(around)]
        out.append((label, keywords, rf"(?<= )(?:{core})(?= )", numbered))
        order += len(around)
    return out


def rules() -> list[tuple[int, int, str, tuple[str, ...], str]]:
    """(order, priority, label, keywords, regex) of every rule."""
    return [(i, p, label, keywords, regex) for _, keywords, _, around in cores() for i, p, label, regex in around]


def _places(words: Column, phrase: str) -> Column:
    """Word indexes at which the phrase's words stand."""
    parts = phrase.split()

    def here(i: Column) -> Column:
        same = F.get(words, i) == parts[0]
        for k, part in enumerate(parts[1:], 1):
            same = same & (F.get(words, i + k) == part)
        return same

    return F.filter(F.sequence(F.lit(0), F.size(words) - 1), here)


def _n_words(text: Column) -> Column:
    """How many words a text has: parts between its separators, less an empty part at either end."""
    parts = F.split(text, SEPARATOR + "+")
    first, last = F.element_at(parts, 1) == "", (F.size(parts) > 1) & (F.element_at(parts, -1) == "")
    return F.size(parts) - first.cast("int") - last.cast("int")


def _joined(words: Column) -> Column:
    return F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))


def detections(texts: DataFrame) -> DataFrame:
    """Surviving detections of distinct texts (``key``, ``norm``): key, label, priority."""
    rule_type = "array<struct<rank:int,priority:int,label:string,regex:string>>"
    table = F.from_json(F.lit(_cores_json()), f"array<struct<core:int,keywords:array<string>,regex:string,rules:{rule_type}>>")
    ahead, behind = REACH
    pieces = (
        texts.withColumn("c", F.explode(F.filter(table, lambda r: F.exists(r["keywords"], lambda k: F.contains(F.col("norm"), k)))))
        .where(F.rlike(F.col("norm"), F.col("c.regex")))
        .select(
            "key", F.col("c.core").alias("core"), F.split(F.col("norm"), F.col("c.regex"), -1).alias("between"),
            F.regexp_extract_all("norm", F.col("c.regex"), F.lit(0)).alias("names"),
        )
    )
    cut = F.transform("between", lambda x: F.struct(F.right(x, F.lit(ahead)).alias("tail"), F.left(x, F.lit(behind)).alias("head"), F.length(x).alias("n")))
    n = F.size("names")
    zipped = F.arrays_zip(F.col("names").alias("name"), F.slice("cut", F.lit(1), n).alias("before"), F.slice("cut", F.lit(2), n).alias("after"))
    at = pieces.select("key", "core", "names", cut.alias("cut")).select("key", "core", F.posexplode(zipped).alias("j", "p"))
    at = at.select(
        "key", "core", "j", F.length("p.name").alias("size"), F.col("p.before").alias("before"),
        F.concat("p.before.tail", "p.name", "p.after.head").alias("around"),
    )
    so_far = W.partitionBy("key", "core").orderBy("j")
    begin = F.sum(F.col("before.n") + F.col("size")).over(so_far) - F.col("size") - F.length("before.tail")
    tried = at.select("key", "core", "around", begin.alias("begin")).withColumn("rule", F.explode(F.get(table, F.col("core"))["rules"]))
    met = tried.where(F.rlike(F.col("around"), F.col("rule.regex")))
    start = F.col("begin") + F.length(F.get(F.split(F.col("around"), F.col("rule.regex"), 2), F.lit(0)))
    placed = met.select(
        "key", "rule.rank", "rule.priority", "rule.label", start.alias("start"),
        (start + F.length(F.regexp_extract_all("around", F.col("rule.regex"), F.lit(0))[0])).alias("stop"),
    )
    earlier = W.partitionBy("key").orderBy("start", F.desc("stop"), "priority", "rank").rowsBetween(W.unboundedPreceding, -1)
    inside = F.lit(False)
    for p in sorted({p for _, p, *_ in rules()}):
        reach = F.max(F.when(F.col("priority") <= p, F.col("stop"))).over(earlier)
        inside = inside | ((F.col("priority") == p) & F.coalesce(reach >= F.col("stop"), F.lit(False)))
    return placed.withColumn("inside", inside).where("not inside and label != ''").select("key", "label", "priority")


def _cores_json() -> str:
    named = ("rank", "priority", "label", "regex")
    return json.dumps([
        {"core": i, "keywords": keywords, "regex": regex, "rules": [dict(zip(named, r)) for r in around]}
        for i, (_, keywords, regex, around) in enumerate(cores())
    ])


def scan_licenses(docs: DataFrame, text: str = "text", phrases: Sequence[tuple[str, str]] = BASE_PHRASES) -> DataFrame:
    """``docs`` with n_words, n_base, first_word, last_word, base_labels, labels and score.

    score is 1 for a base phrase or an SPDX line, and less by 0.2 for each step down
    in priority of the best detection otherwise. Columns of those names are replaced.
    """
    own = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    rest = [c for c in docs.columns if c not in own]
    t = F.col(text)
    counted = docs.select(
        *[F.col(f"`{c}`") for c in rest], t.alias("__text"),
        F.coalesce(_n_words(t), F.lit(0)).cast("long").alias("n_words"),
    )
    gate_on = F.coalesce(_gate(F.col("__text"), phrases), F.lit(False))
    none = F.lit(None).cast("long")
    plain = counted.where(~gate_on).select(
        *[f"`{c}`" for c in rest], "n_words", F.lit(0).cast("long").alias("n_base"), none.alias("first_word"),
        none.alias("last_word"), F.lit("").alias("base_labels"), F.lit("").alias("labels"), F.lit(0.0).alias("score"),
    )
    found = counted.where(gate_on).withColumns(
        {"__key": F.sha2("__text", 256), "__words": F.regexp_extract_all(F.translate("__text", UPPER, LOWER), F.lit(WORD), F.lit(0))}
    )
    found = found.withColumn("__norm", _joined(F.col("__words"))).drop("__text")
    for i, (phrase, _) in enumerate(phrases):
        at = F.when(F.col("__norm").contains(f" {phrase} "), _places(F.col("__words"), phrase))
        found = found.withColumn(f"__at{i}", F.coalesce(at, F.array().cast("array<int>")))
    places = F.concat(*[F.col(f"__at{i}") for i in range(len(phrases))])
    base = F.array_sort(F.array_distinct(F.filter(
        F.array(*[F.when(F.size(f"__at{i}") > 0, F.lit(label)) for i, (_, label) in enumerate(phrases)]), lambda x: x.isNotNull()
    )))
    found = found.select(
        *[f"`{c}`" for c in rest], "__key", "__norm", "n_words", F.size(places).cast("long").alias("n_base"),
        F.array_min(places).cast("long").alias("first_word"), F.array_max(places).cast("long").alias("last_word"),
        base.alias("__base"),
    )
    distinct = found.groupBy(F.col("__key").alias("key")).agg(F.first("__norm").alias("norm"))
    labels = detections(distinct).groupBy(F.col("key").alias("__key")).agg(
        F.collect_set("label").alias("__labels"), F.min("priority").alias("__best")
    )
    score = F.when(F.size("__base") > 0, 1.0).when(F.col("__best").isNotNull(), 1.0 - 0.2 * (F.col("__best") - 1)).otherwise(0.0)
    joined = found.drop("__norm").join(labels, "__key", "left")
    every = F.array_sort(F.array_union("__base", F.coalesce(F.col("__labels"), F.array().cast("array<string>"))))
    return plain.unionByName(joined.select(
        *[f"`{c}`" for c in rest], "n_words", "n_base", "first_word", "last_word", F.array_join("__base", ",").alias("base_labels"),
        F.array_join(every, ",").alias("labels"), F.round(score, 6).alias("score"),
    ))


def _gate(text: Column, phrases: Sequence[tuple[str, str]]) -> Column:
    """Whether a text may hold a license at all: substrings first, one regex on what passes."""
    lower = F.lower(text)
    some = F.lit(False)
    for word in (*GATE, *(p.split()[0] for p, _ in phrases)):
        some = some | lower.contains(word)
    return some & lower.rlike("|".join([SURE, *(_SEP.join(p.split()) for p, _ in phrases)]))
