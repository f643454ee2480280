"""License scans with ordered signature rules.

A text becomes its words (runs of 0-9, a-z and non-ASCII after lower-casing A-Z), joined by single
blanks. Texts without any of a few keywords, of which each rule needs one, are not looked at further;
of the rules, only those run whose own words occur: the longest plain run of words of a hand-written
signature, a family's hint for a rule about names. The rules are the signatures of ``signatures.py``
(grant texts, conditions, notices, addresses, short tags) and the ways in which a license is named.
Each is a regular expression over the joined words with a label, a confidence and a priority (its
place by confidence; earlier is stronger). Of the detections, one that lies within another goes (of
two with the same place the weaker one). Of those left that overlap, the strongest stays, then the
strongest that does not overlap it, and so on; a detection beaten by one that is itself beaten stays.
A name that is denied ("not licensed under the ...") hides what lies within it and gives no label.
The base phrases are found beside this and always stay. Everything is column expressions.

Rules for odd input: null is the empty text: no words, no labels, score 0. Ties between detections
are settled by priority, then by start. Very long texts are read whole. Repeated rows each get their
result, further columns are not looked at; empty tables give none.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, only
from .signatures import SIGNATURES
from .spans import match_spans

SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))  # fixed values

# Label, keyword every text with it has, name as a pattern over words, identifier as words.
FAMILIES = (
    ("mit", "mit|expat", "(?:mit|expat) licen[sc]e", "mit"),
    ("mit-0", "mit", "mit no attribution", "mit 0"),
    ("apache-1.1", "apache", "apache (?:software )?licen[sc]e v?(?:version )?1 1", "apache 1 1"),
    ("apache-2.0", "apache", "apache (?:software )?licen[sc]e v?(?:version )?2(?: 0)?", "apache 2 0"),
    ("apache", "apache", "apache (?:software )?licen[sc]e", "apache"),
    ("gpl-2.0", "gpl|general", "(?:gnu )?(?:gpl|general public licen[sc]e) (?:v|version )?2(?: 0)?", "gpl 2 0(?: only| or later)?"),
    ("gpl-3.0", "gpl|general", "(?:gnu )?(?:gpl|general public licen[sc]e) (?:v|version )?3(?: 0)?", "gpl 3 0(?: only| or later)?"),
    ("gpl", "general", "(?:gnu )?general public licen[sc]e", "gpl"),
    ("lgpl-2.1", "lgpl|lesser", "(?:gnu )?(?:lgpl|lesser general public licen[sc]e) (?:v|version )?2 1", "lgpl 2 1(?: only| or later)?"),
    ("lgpl-3.0", "lgpl|lesser", "(?:gnu )?(?:lgpl|lesser general public licen[sc]e) (?:v|version )?3(?: 0)?", "lgpl 3 0(?: only| or later)?"),
    ("lgpl", "lesser|library", "(?:gnu )?(?:lesser|library) general public licen[sc]e", "lgpl"),
    ("agpl-3.0", "agpl|affero", "(?:gnu )?(?:agpl|affero general public licen[sc]e)(?: (?:v|version )?3(?: 0)?)?", "agpl 3 0(?: only| or later)?"),
    ("bsd-2-clause", "bsd", "(?:simplified bsd|bsd 2 clause|freebsd) licen[sc]e", "bsd 2 clause"),
    ("bsd-3-clause", "bsd", "(?:new bsd|modified bsd|bsd 3 clause|revised bsd) licen[sc]e", "bsd 3 clause"),
    ("bsd-4-clause", "bsd", "(?:original bsd|bsd 4 clause) licen[sc]e", "bsd 4 clause"),
    ("bsd", "bsd", "bsd (?:style )?licen[sc]e", "bsd"),
    ("isc", "isc", "isc licen[sc]e", "isc"),
    ("mpl-1.1", "mozilla|mpl", "mozilla public licen[sc]e (?:v|version )?1 1", "mpl 1 1"),
    ("mpl-2.0", "mozilla|mpl", "mozilla public licen[sc]e(?: (?:v|version )?2(?: 0)?)?", "mpl 2 0"),
    ("epl-1.0", "eclipse|epl", "eclipse public licen[sc]e (?:v|version )?1(?: 0)?", "epl 1 0"),
    ("epl-2.0", "eclipse|epl", "eclipse public licen[sc]e(?: (?:v|version )?2(?: 0)?)?", "epl 2 0"),
    ("cddl-1.0", "cddl|common", "common development and distribution licen[sc]e", "cddl 1 0"),
    ("cpl-1.0", "common|cpl", "common public licen[sc]e", "cpl 1 0"),
    ("artistic-2.0", "artistic", "artistic licen[sc]e (?:v|version )?2(?: 0)?", "artistic 2 0"),
    ("artistic", "artistic", "artistic licen[sc]e", "artistic 1 0"),
    ("zlib", "zlib", "zlib(?: libpng)? licen[sc]e", "zlib"),
    ("unlicense", "unlicense", "the unlicense", "unlicense"),
    ("wtfpl", "wtfpl", "wtfpl(?: licen[sc]e)?", "wtfpl"),
    ("boost-1.0", "boost|bsl", "boost software licen[sc]e", "bsl 1 0"),
    ("cc0-1.0", "cc0|zero", "(?:cc0|creative commons zero)(?: 1 0)?(?: universal)?", "cc0 1 0"),
    ("cc-by-4.0", "cc|creative", "(?:cc by|creative commons attribution) 4 0(?: international)?", "cc by 4 0"),
    ("cc-by-sa-4.0", "cc|creative", "(?:cc by sa|creative commons attribution share ?alike) 4 0(?: international)?", "cc by sa 4 0"),
    ("cc-by-nc-4.0", "cc|creative", "(?:cc by nc|creative commons attribution non ?commercial) 4 0", "cc by nc 4 0"),
    ("cc-by", "creative", "creative commons(?: attribution)? licen[sc]e", "cc by 3 0"),
    ("python-2.0", "python|psf", "python software foundation licen[sc]e", "python 2 0"),
    ("postgresql", "postgresql", "postgresql licen[sc]e", "postgresql"),
    ("openssl", "openssl", "openssl licen[sc]e", "openssl"),
    ("ofl-1.1", "ofl|font", "(?:sil )?open font licen[sc]e(?: 1 1)?", "ofl 1 1"),
    ("eupl-1.2", "eupl|european", "european union public licen[sc]e", "eupl 1 2"),
    ("odbl-1.0", "odbl|database", "open (?:data commons open )?database licen[sc]e", "odbl 1 0"),
    ("proprietary", "rights", "all rights reserved", "licenseref proprietary"),
    ("public-domain", "public", "(?:dedicated to|released into|placed in|in) the public domain", "licenseref public domain"),
)
# Confidence and shape of the ways in which a license is named; stronger ones first.
FORMS = (
    (1.0, "spdx license identifier {id}", "spdx"),
    (0.95, "(?:is |are )?licen[sc]ed under (?:the )?(?:terms of )?(?:the )?{name}", "under"),
    (0.95, "(?:released|distributed|published|available) under (?:the )?(?:terms of )?(?:the )?{name}", "under"),
    (0.9, "subject to (?:the )?(?:terms of )?(?:the )?{name}", "subject"),
    (0.85, "(?:see|accept|read) (?:the )?{name}", ""),
    (0.8, "{name}", ""),
)
DENIED = "(?:not|never|no longer) (?:licen[sc]ed|released|distributed|published|available) under (?:the )?(?:terms of )?(?:the )?{name}"
# Of these parts of words every text that a rule matches has at least one.
KEYWORDS = (
    "license", "licence", "spdx", "gpl", "wtfpl", "cc0", "commons", "reserved", "domain", "hereby", "copyright", "warrant",
    "redistribut", "bsd", "mpl", "eclipse", "openssl", "cddl", "eupl", "unauthorized", "attribution", "advertising", "consortium",
    "contributors", "prominently", "statically", "perl", "misrepresented", "compile", "evil", "retain", "parties", "copying",
    "documentation", "publish", "fuck", "font", "jpeg", "released", "distributed", "sil", "apache", "reproduction",
    "executable", "reproduced",
)
CC_BY = f"cc{SEPARATORS}by"  # the same for the one name without such a word
VARIABLE = r"\(\?:[^()]*\)\??|\[[^\]]*\]\??|.\?"  # the parts of a signature that are not plain text


def signature_rules() -> list[tuple[list[str], str, str, float, int]]:
    """(plain texts of which one must occur, pattern over joined words, label, confidence, priority); strongest first.

    A rule without a label only hides what lies within its detections.
    """
    rules = []
    for label, confidence, body in SIGNATURES:
        rules.append(([max(re.split(VARIABLE, body), key=len)], f" {body}(?= )", label, confidence))
    for label, hint, name, identifier in FAMILIES:
        for confidence, form, keyword in FORMS:
            body = form.replace("{id}", identifier).replace("{name}", f"(?:{name})")
            rules.append(((keyword or hint).split("|"), f" {body}(?= )", label, confidence))
        rules.append((["not ", "never ", "no longer "], f" {DENIED.replace('{name}', f'(?:{name})')}(?= )", "", 1.0))
    rules.sort(key=lambda r: -r[3])  # stable: signatures before names, specific families before general ones
    return [(*rule, priority) for priority, rule in enumerate(rules)]


def _words_in(part: Column) -> Column:
    """Blanks in a piece of the joined text: each word has one before it."""
    return (F.length(part) - F.length(F.replace(part, F.lit(" "), F.lit("")))).cast("bigint")


KIND = "array<struct<s:bigint,back:bigint,priority:int,e:bigint,label:string,confidence:double>>"


def _strongest(chain: Column) -> Column:
    """Of detections that hang together by overlaps, those that no stronger one left overlaps."""
    ranked = F.array_sort(chain, lambda x, y: F.when(x["priority"] != y["priority"], x["priority"] - y["priority"])
                          .otherwise(F.signum(x["s"] - y["s"]).cast("int")))

    def take(kept: Column, x: Column) -> Column:
        hit = F.exists(kept, lambda k: (k["s"] < x["e"]) & (x["s"] < k["e"]))
        return F.when(hit, kept).otherwise(F.concat(kept, F.array(x)))

    return F.when(F.size(chain) < 2, chain).otherwise(F.aggregate(ranked, F.array().cast(KIND), take))


def _resolved(found: Column) -> Column:
    """Detections left after containment and overlap; an array of (s, e, priority, label, confidence)."""
    ordered = F.array_sort(found.cast(KIND))  # by start, longest first, strongest first
    none = F.array().cast(KIND)

    def outer(kept: Column, x: Column) -> Column:
        inside = (F.size(kept) > 0) & (x["e"] <= F.try_element_at(kept, F.lit(-1))["e"])
        return F.when(inside, kept).otherwise(F.concat(kept, F.array(x)))

    def chained(a: Column, x: Column) -> Column:
        apart = (F.size(a["open"]) > 0) & (x["s"] >= F.try_element_at(a["open"], F.lit(-1))["e"])
        return F.struct(
            F.when(apart, F.concat(a["done"], _strongest(a["open"]))).otherwise(a["done"]).cast(KIND).alias("done"),
            F.when(apart, F.array(x)).otherwise(F.concat(a["open"], F.array(x))).cast(KIND).alias("open"),
        )

    start = F.struct(none.alias("done"), none.alias("open"))
    left = F.aggregate(F.aggregate(ordered, none, outer), start, chained, lambda a: F.concat(a["done"], _strongest(a["open"])))
    return F.filter(F.array_sort(left), lambda x: x["label"] != "")


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_words, base (array of start, label by start), detections (resolved)."""
    rows = only(docs, id=id_col, text=text_col)
    pieces = F.split(F.coalesce("text", F.lit("")), SEPARATORS, -1)
    rows = rows.withColumn("pieces", pieces).withColumn("lowered", F.lower("text"))
    gate = reduce(or_, [F.contains("lowered", F.lit(w)) for w in KEYWORDS]) | F.rlike("lowered", F.lit(CC_BY))
    empty = (F.col("pieces")[0] == "").cast("int") + (
        (F.size("pieces") > 1) & (F.element_at("pieces", -1) == "")
    ).cast("int")
    joined = F.concat(F.lit(" "), F.array_join(F.filter("pieces", lambda w: w != ""), " "), F.lit(" "))
    rows = rows.select(
        "id", (F.size("pieces") - empty).cast("bigint").alias("n_words"),
        F.when(gate, F.translate(joined, UPPER, LOWER)).alias("joined"),
    )
    text = F.col("joined")
    none = F.array().cast("array<struct<s:bigint,e:bigint,label:string>>")

    def labelled(label: str) -> Callable[[Column], Column]:
        return lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit(label).alias("label"))

    base = F.flatten(
        F.array(
            *(
                F.when(
                    F.contains(text, F.lit(phrase)),
                    F.transform(
                        match_spans(text, F.lit(f" {phrase}(?= )"), measure=_words_in),
                        labelled(label),
                    ),
                ).otherwise(none)
                for phrase, label in BASE
            )
        )
    )
    rules = F.array(
        *(
            F.struct(F.array(*map(F.lit, h)).alias("hints"), F.lit(p).alias("pattern"), F.lit(name).alias("label"),
                     F.lit(c).alias("confidence"), F.lit(i).alias("priority"))
            for h, p, name, c, i in signature_rules()
        )
    )

    def run(r: Column) -> Column:
        return F.transform(
            match_spans(text, r["pattern"], measure=_words_in),
            lambda x: F.struct(
                x["s"].alias("s"), (-x["e"]).alias("back"), r["priority"].alias("priority"), x["e"].alias("e"),
                r["label"].alias("label"), r["confidence"].alias("confidence"),
            ),
        )

    hints = sorted({h for rule in signature_rules() for h in rule[0]})
    present = F.filter(F.array(*map(F.lit, hints)), lambda h: F.contains(text, h))
    # A lambda's variable is computed once; a column would be computed again for every rule.
    open_rules = F.transform(
        F.array(present),
        lambda p: F.filter(rules, lambda r: F.arrays_overlap(r["hints"], p) & F.rlike(text, r["pattern"])),
    )[0]
    found = _resolved(F.flatten(F.transform(open_rules, run)))
    return rows.select(
        "id", "n_words",
        F.when(text.isNotNull(), F.array_sort(base)).otherwise(none).alias("base"),
        F.when(text.isNotNull(), found).alias("detections"),
    )


def summarise(found: DataFrame) -> DataFrame:
    """Counts, labels and score of each row of ``detect``."""
    labels = "array<string>"
    base_labels = F.array_sort(F.array_distinct(F.transform("base", lambda x: x["label"]))).cast(labels)
    own = F.coalesce(F.transform("detections", lambda x: x["label"]).cast(labels), F.array().cast(labels))
    score = F.greatest(
        F.coalesce(F.array_max(F.transform("detections", lambda x: x["confidence"])), F.lit(0.0)),
        F.when(F.size("base") > 0, F.lit(0.8)).otherwise(F.lit(0.0)),
    )
    return found.select(
        "id", "n_words", F.size("base").cast("bigint").alias("n_base"),
        F.array_min(F.transform("base", lambda x: x["s"])).alias("first_word"),
        F.array_max(F.transform("base", lambda x: x["s"])).alias("last_word"),
        F.array_join(base_labels, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base_labels, own)), ",").alias("labels"),
        score.alias("score"),
    )
