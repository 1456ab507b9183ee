"""License scan with ordered signature rules, gated by keywords."""

from __future__ import annotations

import re
from bisect import bisect
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import text_slices

# Everything but ASCII letters and digits and non-ASCII characters separates words.
SEPARATORS = bytes(
    (c + 32 if 65 <= c <= 90 else c if c >= 0x80 or chr(c).isalnum() else 32) for c in range(256)
)
# Phrases and labels that every scan reports (fixed values).
BASE = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

# The rules, most specific families first. A line is: label | keywords | pattern over lower-case words
# with one space in between. Every match holds one of the keywords (with commas in between). Rules further up win over rules further down where detections overlap.
# V stands for a version number, L for license or licence.
RULES = r"""
agpl-3.0|affero|gnu affero general public L (?:version |v ?)?3(?: 0)?(?: only| or later)?
agpl-1.0|affero|affero general public L (?:version |v ?)?1(?: 0)?
agpl|affero|gnu affero general public L
agpl-3.0|agpl|agpl ?v?3(?: 0)?(?: only| or later)?
agpl|agpl|(?:under|licensed) (?:the )?agpl
lgpl-3.0|lesser|gnu lesser general public L (?:version |v ?)?3(?: 0)?(?: only| or later)?
lgpl-2.1|lesser|gnu lesser general public L (?:version |v ?)?2 1(?: only| or later)?
lgpl-2.0|library|gnu library general public L (?:version |v ?)?2(?: 0)?
lgpl|lesser,library|gnu (?:lesser|library) general public L
lgpl|lesser|lesser general public L
lgpl-3.0|lgpl|lgpl ?v?3(?: 0)?(?: only| or later)?
lgpl-2.1|lgpl|lgpl ?v?2 1(?: only| or later)?
lgpl-2.0|lgpl|lgpl ?v?2(?: 0)?(?: only| or later)?
lgpl|lgpl|(?:under|licensed) (?:the )?(?:gnu )?lgpl
gpl-3.0|general|gnu general public L (?:version |v ?)3(?: 0)?(?: only| or later)?
gpl-3.0|general|general public L as published by the free software foundation (?:either )?version 3
gpl-2.0|general|gnu general public L (?:version |v ?)2(?: 0)?(?: only| or later)?
gpl-2.0|general|general public L as published by the free software foundation (?:either )?version 2
gpl-1.0|general|gnu general public L (?:version |v ?)1(?: 0)?(?: only| or later)?
gpl-classpath|classpath|general public L (?:(?:version |v ?)?2(?: 0)? )?with (?:the )?classpath exception
gpl-linking|exception|general public L .{0,40}with (?:a )?(?:special )?linking exception
gpl-3.0|gpl|gnu gpl ?v?(?:ersion )?3(?: 0)?
gpl-2.0|gpl|gnu gpl ?v?(?:ersion )?2(?: 0)?
gpl-3.0|gpl|gpl ?v3(?: 0)?(?: only| or later)?
gpl-2.0|gpl|gpl ?v2(?: 0)?(?: only| or later)?
gpl-3.0|gpl|gpl 3(?: 0)?(?: only| or later)?
gpl-2.0|gpl|gpl 2(?: 0)?(?: only| or later)?
gpl|gpl|(?:under|licensed) (?:the )?(?:gnu )?gpl
gpl|free software foundation|terms of the gnu general public L as published by the free software foundation
gpl|general|general public L
gfdl-1.3|documentation|gnu free documentation L (?:version |v ?)?1 3
gfdl-1.2|documentation|gnu free documentation L (?:version |v ?)?1 2
gfdl-1.1|documentation|gnu free documentation L (?:version |v ?)?1 1
gfdl|documentation|gnu free documentation L
gfdl|gfdl|gfdl(?: 1 [123])?
apache-2.0|apache|apache L (?:version |v ?)?2(?: 0)?
apache-1.1|apache|apache (?:software )?L (?:version |v ?)?1 1
apache-1.0|apache|apache (?:software )?L (?:version |v ?)?1(?: 0)?
apache-2.0|apache|www apache org licenses license 2 0
apache-2.0|apache|apache ?(?:v|version )?2(?: 0)? L
apache|apache|apache (?:software )?L
apache|apache|apache software foundation .{0,60}contributor L agreements
mit|mit licen|(?:the )?mit L
mit|style licen|(?:mit|x11|expat) style L
mit|expat|(?:the )?expat L
mit|x11|(?:the )?(?:mit )?x11 L
mit|permission|permission is hereby granted free of charge to any person obtaining a copy of this software
mit|permission|the above copyright notice and this permission notice shall be included in all copies
mit-0|mit no|mit no attribution
mit-0|mit 0|mit 0 L
bsd-4-clause|bsd|bsd (?:4|four) clause(?: L)?
bsd-4-clause|advertising|all advertising materials mentioning features or use of this software must display
bsd-3-clause|bsd|bsd (?:3|three) clause(?: L)?
bsd-3-clause|bsd|(?:3|three) clause bsd(?: L)?
bsd-3-clause|endorse|may be used to endorse or promote products derived from this software without specific prior written permission
bsd-2-clause|bsd|bsd (?:2|two) clause(?: L)?
bsd-2-clause|bsd|(?:2|two) clause bsd(?: L)?
bsd-2-clause|redistributions|redistributions in binary form must reproduce the above copyright notice
bsd-2-clause|redistributions|redistributions of source code must retain the above copyright notice
bsd-2-clause|bsd|simplified bsd L
bsd-2-clause|bsd|freebsd L
bsd-3-clause|bsd|(?:new|revised|modified) bsd L
bsd-4-clause|bsd|(?:original|old) bsd L
0bsd|bsd|(?:zero clause bsd|bsd zero clause|bsd 0 clause)(?: L)?
bsd|bsd|(?:the )?bsd (?:style )?L
isc|isc licen|(?:the )?isc L
isc|permission|permission to use copy modify and or distribute this software for any purpose with or without fee
mpl-2.0|mozilla|mozilla public L (?:version |v ?)?2(?: 0)?
mpl-1.1|mozilla|mozilla public L (?:version |v ?)?1 1
mpl-1.0|mozilla|mozilla public L (?:version |v ?)?1(?: 0)?
mpl|mozilla|mozilla public L
mpl-2.0|mpl|mpl ?v?2(?: 0)?
mpl-1.1|mpl|mpl ?v?1 1
epl-2.0|eclipse|eclipse public L (?:version |v ?)?2(?: 0)?
epl-1.0|eclipse|eclipse public L (?:version |v ?)?1(?: 0)?
epl|eclipse|eclipse public L
edl-1.0|eclipse|eclipse distribution L (?:version |v ?)?1(?: 0)?
epl-2.0|epl|epl ?v?2(?: 0)?
epl-1.0|epl|epl ?v?1(?: 0)?
cpl-1.0|common public|common public L (?:version |v ?)?1(?: 0)?
cpl|common public|common public L
ipl-1.0|ibm|ibm public L (?:version |v ?)?1(?: 0)?
cddl-1.1|cddl|cddl ?v?1 1
cddl-1.0|cddl|cddl ?v?1(?: 0)?
cddl-1.1|common development|common development and distribution L (?:version |v ?)?1 1
cddl-1.0|common development|common development and distribution L (?:version |v ?)?1(?: 0)?
cddl|common development|common development and distribution L
eupl-1.2|european union|european union public (?:L|licence) (?:version |v ?)?1 2
eupl-1.1|european union|european union public (?:L|licence) (?:version |v ?)?1 1
eupl|european union|european union public L
eupl-1.2|eupl|eupl ?v?1 2
eupl|eupl|(?:under|licensed) (?:the )?eupl
artistic-2.0|artistic|artistic L (?:version |v ?)?2(?: 0)?
artistic-1.0|artistic|artistic L (?:version |v ?)?1(?: 0)?
artistic|artistic|(?:the |perl )?artistic L
perl|perl|same terms as perl(?: itself)?
boost-1.0|boost|boost software L (?:version |v ?)?1(?: 0)?
boost|boost|boost software L
bsl-1.1|business source|business source L (?:version |v ?)?1 1
bsl|business source|business source L
zlib|zlib|zlib libpng L
zlib|zlib|(?:the )?zlib L
zlib|misrepresented|altered source versions must be plainly marked as such and must not be misrepresented
libpng|libpng|(?:the )?libpng L
unlicense|unlicense|(?:the )?unlicense
unlicense|unencumbered|free and unencumbered software released into the public domain
wtfpl|wtfpl|wtfpl
wtfpl|what the|do what the f\w+ you want to public L
beerware|beer|beer ?ware L
python-2.0|python|python (?:software foundation )?L (?:version |v ?)?2(?: 0)?
psf-2.0|psf|psf L (?:version |v ?)?2(?: 0)?
psf|python|python software foundation L
php-3.01|php|php L (?:version |v ?)?3 01
php-3.0|php|php L (?:version |v ?)?3(?: 0)?
php|php|(?:the )?php L
ruby|ruby|(?:the )?ruby L
ruby|ruby|same (?:license|terms) as ruby
openssl|openssl|openssl (?:project )?L
ssleay|ssleay|(?:original )?ssleay L
curl|curl licen|(?:the )?curl L
postgresql|postgresql|(?:the )?postgresql L
ncsa|illinois|university of illinois ncsa open source L
ncsa|ncsa|ncsa (?:open source )?L
afl-3.0|academic free|academic free L (?:version |v ?)?3(?: 0)?
afl|academic free|academic free L
osl-3.0|open software|open software L (?:version |v ?)?3(?: 0)?
osl|open software|open software L
ms-pl|microsoft|microsoft public L
ms-rl|microsoft|microsoft reciprocal L
upl-1.0|universal permissive|universal permissive L (?:version |v ?)?1(?: 0)?
qpl-1.0|qpl,q public|(?:q public L|qpl) ?(?:version |v ?)?1(?: 0)?
ofl-1.1|open font|sil open font L (?:version |v ?)?1 1
ofl|open font|(?:sil )?open font L
odbl-1.0|database|open (?:data commons open )?database L (?:version |v ?)?1(?: 0)?
odbl|database|open (?:data commons open )?database L
odc-by-1.0|attribution|open data commons attribution L
pddl-1.0|public domain|(?:open data commons )?public domain dedication and L
cdla-permissive|community data|community data L agreement permissive
cdla-sharing|community data|community data L agreement sharing
ogl-uk-3.0|open government|open government L (?:version |v ?)?3(?: 0)?
ogl-uk-2.0|open government|open government L (?:version |v ?)?2(?: 0)?
ogl-uk|open government|open government L
cecill-2.1|cecill|cecill (?:version |v ?)?2 1
cecill-b|cecill|cecill b
cecill-c|cecill|cecill c
cecill|cecill|cecill(?: free software)? L
llama-3|llama|(?:meta )?llama 3(?: \d)? community L
llama-2|llama|(?:meta )?llama 2 community L
openrail-m|openrail,open rail|(?:creativeml |bigcode )?open ?rail m
openrail|rail licen|(?:bigscience )?(?:open )?rail L
sspl-1.0|server side|server side public L(?: (?:version |v ?)?1(?: 0)?)?
elastic-2.0|elastic|elastic L (?:version |v ?)?2(?: 0)?
commons-clause|commons clause|commons clause (?:L )?condition
cc-zero|cc0,cc 0|cc ?0(?: 1 0)?(?: universal)?
cc-zero|creative|creative commons zero(?: v?1 0)?(?: universal)?
cc-pdm|public domain|(?:creative commons )?public domain mark(?: 1 0)?
cc|creative|licensed under (?:a |the )?creative commons L
cc|creative|creative commons L
public-domain|public domain|(?:is|are|been|placed|released|dedicated) (?:in|into|to) the public domain
public-domain|asserted|no copyright is asserted
all-rights-reserved|rights reserved|all rights reserved
proprietary|proprietary|proprietary and confidential
proprietary|confidential|confidential and proprietary
proprietary|proprietary|(?:under|is) (?:a )?proprietary L
proprietary|unauthorized|unauthorized (?:copying|reproduction|use|distribution) (?:of this \w+ )?is (?:strictly )?prohibited
proprietary|without|may not be (?:copied|reproduced|redistributed|distributed) without (?:the )?(?:prior |express )?(?:written )?permission
non-commercial|commercial|for non ?commercial (?:use|purposes) only
research-only|research|for (?:academic |scientific )?research (?:use|purposes) only
eula|end user|end user L agreement
warranty|warranty|provided as is without (?:any )?warranty of any kind
warranty|warranties|without warranties or conditions of any kind
warranty|warranty|without even the implied warranty of merchantability or fitness
spdx|spdx|spdx license identifier [a-z0-9]+(?: \d)*
copyright|copyright|copyright (?:c )?(?:19|20)\d\d
"""
# Names of the elements of Creative Commons licenses (fixed values): label, short form, long form.
CC_ELEMENTS = (
    ("by-nc-nd", "by nc nd", "attribution non ?commercial no ?deriv(?:ative)?s"),
    ("by-nc-sa", "by nc sa", "attribution non ?commercial share ?alike"),
    ("by-nc", "by nc", "attribution non ?commercial"),
    ("by-nd", "by nd", "attribution no ?deriv(?:ative)?s"),
    ("by-sa", "by sa", "attribution share ?alike"),
    ("by", "by", "attribution"),
)
CC_VERSIONS = ("4 0", "3 0", "2 5", "2 0", "1 0")
# Identifiers that stand behind an SPDX marker, as words (fixed values).
SPDX = (
    "agpl 3 0", "apache 2 0", "artistic 2 0", "bsd 2 clause", "bsd 3 clause", "bsl 1 0", "cc0 1 0", "cc by 4 0",
    "cc by sa 4 0", "epl 2 0", "eupl 1 2", "gpl 2 0", "gpl 3 0", "isc", "lgpl 2 1", "lgpl 3 0", "mit", "mpl 2 0",
    "ofl 1 1", "unlicense", "zlib",
)


@dataclass(frozen=True)
class Rule:
    label: str
    keywords: tuple[str, ...]
    pattern: str
    priority: int


def license_rules() -> list[Rule]:
    """All rules in order of priority: exact identifiers, then the families, each from specific to general."""
    found: list[tuple[str, str, str]] = []
    for name in SPDX:
        found.append((re.sub(r"(?<=\d) (?=\d)", ".", name).replace(" ", "-"), "spdx", f"spdx license identifier {name}(?: only| or later)?"))
    for label, short, long in CC_ELEMENTS:
        for version in CC_VERSIONS:
            dashed = f"cc-{label}-{version.replace(' ', '.')}"
            found.append((dashed, "cc by", f"cc {short} {version}"))
            found.append((dashed, "creative", f"creative commons {long} (?:L )?{version}(?: international| unported| generic)?(?: L)?"))
            found.append((dashed, "creative", f"creative ?commons org licenses {short} {version}"))
    for label, short, long in CC_ELEMENTS:
        found.append((f"cc-{label}", "creative", f"creative commons {long}"))
        found.append((f"cc-{label}", "cc by", f"cc {short}"))
    for line in RULES.strip().splitlines():
        found.append(tuple(line.split("|", 2)))
    return [
        Rule(label, tuple(keywords.split(",")), re.sub(r"\bL\b", "licen[cs]e", pattern), rank)
        for rank, (label, keywords, pattern) in enumerate(found)
    ]


@dataclass(frozen=True)
class Detection:
    label: str
    priority: int
    first: int
    last: int


class Scanner:
    """Finds phrases and rule matches in texts; made once per task."""

    def __init__(self, rules: list[Rule]):
        self.rules = [(r, re.compile(f"(?<= ){r.pattern}(?= )")) for r in rules]
        by_keyword: dict[str, list[int]] = {}
        for i, r in enumerate(rules):
            for keyword in r.keywords:
                by_keyword.setdefault(keyword, []).append(i)
        # Keywords are looked for as bytes before a text is taken apart any further.
        self.gates = [(k.encode(), tuple(rs)) for k, rs in by_keyword.items()]
        self.phrases = [(f" {phrase} ".encode(), label, phrase.count(" ") + 1) for phrase, label in BASE]

    def phrase_places(self, joined: bytes) -> list[tuple[int, int, str]]:
        """(first word, last word, label) of every place where a base phrase stands."""
        out = []
        for phrase, label, words in self.phrases:
            at = joined.find(phrase)
            first = seen = 0
            while at >= 0:
                first += joined.count(b" ", seen, at)
                seen = at
                out.append((first, first + words - 1, label))
                at = joined.find(phrase, at + 1)
        return out

    def rule_matches(self, joined: bytes) -> list[Detection]:
        live = sorted({i for word, rules in self.gates if word in joined for i in rules})
        if not live:
            return []
        text = joined.decode()
        found = []
        for i in live:
            rule, pattern = self.rules[i]
            first, seen = -1, 0
            for m in pattern.finditer(text):
                first += text.count(" ", seen, m.start())
                seen = m.start()
                found.append(Detection(rule.label, rule.priority, first, first + m.group().count(" ")))
        return suppressed(found)

    def scan(self, text: str):
        words = text.encode().translate(SEPARATORS).split()
        joined = b" %b " % b" ".join(words)
        return len(words), self.phrase_places(joined), self.rule_matches(joined)


def suppressed(found: list[Detection]) -> list[Detection]:
    """Detections that stay when overlaps are resolved, in order of place.

    First, a detection whose interval lies strictly inside another one goes, whatever its priority: a
    longer signature says more ("mit license" inside a whole permission notice). Of the rest, the
    better (smaller) priority wins wherever two intervals overlap; equal intervals keep the first rule.
    Detections apart from one another all stay.
    """
    free: list[Detection] = []
    reach = -1
    # By start, longest first: an interval is contained exactly if an earlier one reaches as far.
    for d in sorted(found, key=lambda d: (d.first, -d.last, d.priority)):
        same = bool(free) and (free[-1].first, free[-1].last) == (d.first, d.last)
        if d.last > reach or same:
            free.append(d)
            reach = max(reach, d.last)
    kept: list[Detection] = []
    for d in sorted(free, key=lambda d: (d.priority, d.first)):
        at = bisect(kept, d.first, key=lambda k: k.first)
        if (at == 0 or kept[at - 1].last < d.first) and (at == len(kept) or d.last < kept[at].first):
            kept.insert(at, d)
    return kept


def scan_licenses(
    docs: DataFrame, rules: list[Rule] | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """License mentions of whole texts, one row per input row.

    Base: every place where the words of a phrase of ``BASE`` stand one after another (places may
    share words of other phrases). On top, the ordered ``rules`` (default :func:`license_rules`) run
    on the texts that hold one of their keywords, and :func:`suppressed` settles overlaps.

    Returns the id, ``n_words``, ``n_base``, ``first_word`` and ``last_word`` (smallest and largest
    start of a base place, else null), ``base_labels`` and ``labels`` (base labels and those of the
    rules; distinct, sorted, joined by commas, empty if there are none), ``score`` (see
    :func:`confidence`) and ``spans``
    (label, first and last word of every detection by a rule).

    A narrow pass, bounded by a slice of texts. A null text has no words: counts are 0, labels empty.
    Null ids, repeated rows and other columns change nothing.
    """
    rules = license_rules() if rules is None else rules

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        for batch in batches:
            for rows in text_slices(batch, 1):
                out: dict[str, list] = {n: [] for n in OUT.names}
                for text in rows.column(1).to_pylist():
                    n_words, places, found = scanner.scan(text or "")
                    base = sorted({label for *_, label in places})
                    labels = sorted({*base, *(d.label for d in found)})
                    starts = [first for first, *_ in places]
                    out["n_words"].append(n_words)
                    out["n_base"].append(len(places))
                    out["first_word"].append(min(starts, default=None))
                    out["last_word"].append(max(starts, default=None))
                    out["base_labels"].append(",".join(base))
                    out["labels"].append(",".join(labels))
                    out["score"].append(confidence(places, found))
                    out["spans"].append([{"label": d.label, "first": d.first, "last": d.last} for d in found])
                columns = [rows.column(0), *(pa.array(out[f.name], f.type) for f in OUT)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc", *OUT.names])

    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run,
        f"doc {kind}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, "
        "labels string, score double, spans array<struct<label: string, first: bigint, last: bigint>>",
    )
    return rows.withColumnRenamed("doc", id_col)


OUT = pa.schema(
    [
        ("n_words", pa.int64()),
        ("n_base", pa.int64()),
        ("first_word", pa.int64()),
        ("last_word", pa.int64()),
        ("base_labels", pa.string()),
        ("labels", pa.string()),
        ("score", pa.float64()),
        ("spans", pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64())]))),
    ]
)


def confidence(places: list[tuple[int, int, str]], found: list[Detection]) -> float:
    """0 without evidence, 0.5 for a mention alone, up to 1 as detections get longer and more exact."""
    if not places and not found:
        return 0.0
    longest = max([last - first + 1 for first, last, _ in places] + [d.last - d.first + 1 for d in found])
    versioned = any(c.isdigit() for d in found for c in d.label)
    return round(min(1.0, 0.5 + 0.05 * min(longest, 6) + 0.2 * versioned), 6)
