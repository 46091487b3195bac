"""Personal data by weak supervision, in DataFrame expressions only.

Spans come from patterns. The four base kinds have fixed rules and always stay. Looser patterns propose further spans, and
four labelers (pattern, gazetteer, context for, context against) vote on every span or abstain. Expectation-
maximisation over the counts of the vote patterns estimates how reliable each labeler is; the posteriors train a linear
classifier of spans, which decides about the proposed ones. What reaches the driver is one row for each combination of kind,
votes and three yes-no features: a few thousand whatever the table's size.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: The base kinds in their order, then the added ones.
KINDS = ("email", "ip", "card", "phone", "ssn", "name")
BASE = 4

# Patterns equal to the fixed ones in what they match, written so that no text makes them slow: a match can only start at
# the start of a run, or where the match before ended, and runs are never given back.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IP_PARTS = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?:\.|$)){4}$"

# Looser patterns of the method's own spans.
SPELT_EMAIL = r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]{2,40}+ ?(?:\(at\)|\[at\]) ?[A-Za-z0-9-]{2,40}+(?: ?(?:\(dot\)|\[dot\]|\.) ?[A-Za-z]{2,12}){1,3}"
LOCAL_PHONE = r"(?<![0-9A-Za-z+.-])(?<!\+[0-9]{1,3}[\x20])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z.-])"
SSN = r"(?<![0-9A-Za-z.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"
NAME = r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Madame|Monsieur|Señor|Señora)\.? \p{Lu}\p{Ll}{1,20}+(?: \p{Lu}\p{Ll}{1,20}+)?"

#: (kind, pattern, a sign that every match contains) of the base spans and of the looser ones.
STRICT = (("email", EMAIL, "@"), ("ip", IP, r"[0-9]\.[0-9]"), ("card", CARD, r"(?:[0-9][\x20-]?){13}[0-9]"), ("phone", PHONE, r"\+[0-9]"))
LOOSE = (
    ("email", SPELT_EMAIL, r"[(\[]at[)\]]"), ("phone", LOCAL_PHONE, r"[0-9]{3}[\x20.-][0-9]{4}"), ("ssn", SSN, r"[0-9]-[0-9]{2}-[0-9]"),
    ("name", NAME, r"(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Madame|Monsieur|Señor|Señora)\.? "),
)

#: Gazetteers and cue words of the labelers; besides the names of domains, every name of two letters counts as a country's.
TOP_DOMAINS = "com org net edu gov mil int info biz name pro mobi app dev io ai cloud online shop site store tech xyz agency email jobs museum travel [a-z]{2}"
GIVEN_NAMES = (
    "james john robert michael william david richard joseph thomas charles christopher daniel matthew anthony mark donald steven paul andrew joshua kenneth kevin brian george edward "
    "mary patricia jennifer linda elizabeth barbara susan jessica sarah karen nancy lisa margaret betty sandra ashley dorothy kimberly emily donna michelle carol amanda melissa laura "
    "hans peter klaus jürgen wolfgang dieter manfred uwe stefan andreas matthias markus florian anna maria ursula monika petra sabine renate helga karin brigitte ingrid claudia "
    "jean pierre michel andré philippe rené louis alain jacques bernard nicolas julien marie jeanne françoise monique catherine nathalie isabelle jacqueline sylvie camille "
    "antonio josé manuel francisco juan javier carlos miguel rafael pedro jesús luis carmen josefa isabel dolores pilar teresa ana cristina lucía rosa mercedes"
)
CUES = "mail email e-mail contact call phone tel telephone fax mobile cell reach ip host server address card visa mastercard payment ssn social security name signed kontakt telefon correo"
AGAINST = "version build release isbn order part serial invoice section chapter page figure table password key token"
BEFORE = 28
ABSTAIN = -1


#: Items of an array that are walked before their states are set aside, so that a long array costs little more than a short one.
WALK = 256


def running(items: Column, start: Column, step: Callable[[Column, Column], Column], kind: str = "int") -> Column:
    """The state after each item of an array, from `step(state, item)`."""
    none = F.array().cast(f"array<{kind}>")
    last = lambda a: F.get(a, F.size(a) - 1)

    def walk(done: Column, block: Column) -> Column:
        before = F.coalesce(last(last(done)), start)
        part = F.slice(items, block * WALK + 1, F.lit(WALK))
        return F.array_append(done, F.aggregate(part, none, lambda out, x: F.array_append(out, step(F.coalesce(last(out), before), x))))

    blocks = F.sequence(F.lit(0), F.floor((F.size(items) - 1) / WALK).cast("int"))
    walked = F.flatten(F.aggregate(blocks, F.array().cast(f"array<array<{kind}>>"), walk))
    return F.when(F.size(items) > 0, walked).otherwise(none)


def spans_of(found: Column, gaps: Column, kind: str, loose: bool) -> Column:
    """Array of (kind, start, end, loose, match, before) from the matches and the texts between them."""
    lengths = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda gap, match: F.struct(F.char_length(gap).alias("gap"), F.char_length(match).alias("match")))
    ends = running(lengths, F.lit(0), lambda at, x: at + x["gap"] + x["match"])
    placed = F.transform(F.arrays_zip(found.alias("match"), ends.alias("end"), F.slice(gaps, 1, F.size(found)).alias("gap")), lambda x: F.struct(
        F.lit(KINDS.index(kind)).alias("kind"), (x["end"] - F.char_length(x["match"])).alias("start"), x["end"].alias("end"), F.lit(loose).alias("loose"),
        x["match"].alias("match"), F.right(x["gap"], F.lit(BEFORE)).alias("before"),
    ))
    empty = F.array().cast("array<struct<kind:int,start:int,end:int,loose:boolean,match:string,before:string>>")
    return F.when(F.size(found) > 0, placed).otherwise(empty)


def apart_from(loose: Column, base: Column) -> Column:
    """The loose spans that overlap no base span, in the order of their starts: one walk forward and one backward over both."""
    marked = lambda spans, own: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(own).alias("base"), s["end"].alias("end"), s.alias("span")))
    both = F.array_sort(F.concat(marked(base, True), marked(loose, False)))
    high = running(both, F.lit(-1), lambda m, s: F.when(s["base"], F.greatest(m, s["end"])).otherwise(m))
    low = F.reverse(running(F.reverse(both), F.lit((1 << 31) - 1), lambda m, s: F.when(s["base"], F.least(m, s["start"])).otherwise(m)))
    seen = F.arrays_zip(both.alias("s"), high.alias("high"), low.alias("low"))
    free = F.filter(seen, lambda x: ~x["s"]["base"] & (x["high"] <= x["s"]["start"]) & (x["low"] >= x["s"]["end"]))
    return F.when((F.size(base) > 0) & (F.size(loose) > 0), F.transform(free, lambda x: x["s"]["span"])).otherwise(loose)


def first_come(spans: Column) -> Column:
    """Of spans (start, kind, end) in order, those that overlap none that was taken before."""
    ends = running(spans, F.lit(0), lambda end, s: F.when(s["start"] >= end, s["end"]).otherwise(end))
    return F.filter(spans, lambda s, i: s["start"] >= F.when(i > 0, F.get(ends, i - 1)).otherwise(0))


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the check sum."""
    back = F.transform(F.sequence(F.lit(1), F.char_length(number)), lambda i: F.substr(F.reverse(number), i, F.lit(1)).cast("int"))
    worth = F.transform(back, lambda d, i: F.when(i % 2 == 1, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d))
    return F.aggregate(worth, F.lit(0), lambda total, d: total + d) % 10 == 0


def base_rule(span: Column) -> Column:
    """The fixed rule of the span's kind for a match of the kind's pattern."""
    n = F.char_length(digits(span["match"]))
    return (
        F.when(span["kind"] == 0, True).when(span["kind"] == 1, span["match"].rlike(IP_PARTS))
        .when(span["kind"] == 2, F.when(n.between(14, 19), luhn(digits(span["match"]))).otherwise(False)).otherwise(n.between(10, 15))
    )


def any_of(words: str) -> str:
    return "(?i)(?<![a-z])(?:" + "|".join(words.split()) + r")(?![a-z])"


def votes_of(span: Column) -> list[Column]:
    """1, 0 or abstain from each labeler: pattern, gazetteer, context for, context against."""
    match, kind, number = span["match"], span["kind"], digits(span["match"])
    pattern = (
        F.when(kind == 0, F.when(match.rlike(r"[@\])][^@]*[A-Za-z]{2,}$"), 1).otherwise(0)).when(kind == 1, F.when(match.rlike(r"^0|\.0[0-9]"), 0).otherwise(1))
        .when(kind == 2, 1).when(kind == 3, F.when(number.rlike(r"^1?[2-9][0-9]{2}[2-9][0-9]{6}$"), 1).when(number.rlike("^(.)\\1+$"), 0).otherwise(ABSTAIN))
        .when(kind == 4, F.when(number.rlike("^(000|666|9)|^...00|0000$"), 0).otherwise(1)).otherwise(1)
    )
    gazetteer = (
        F.when(kind == 0, F.when(match.rlike(r"(?i)[. )\]](?:" + "|".join(TOP_DOMAINS.split()) + ")$"), 1).otherwise(ABSTAIN))
        .when(kind == 1, F.when(match.rlike(r"^(?:0|127|255)\."), 0).otherwise(ABSTAIN)).when(kind == 2, F.when(number.rlike("^(?:4|5[1-5]|2[2-7]|3[47]|6)"), 1).otherwise(0))
        .when(kind == 5, F.when(match.rlike(any_of(GIVEN_NAMES)), 1).otherwise(ABSTAIN)).otherwise(ABSTAIN)
    )
    context = F.when(span["before"].rlike(any_of(CUES)), 1).otherwise(ABSTAIN)
    against = F.when(span["before"].rlike(any_of(AGAINST) + "|[#=]$"), 0).otherwise(ABSTAIN)
    return [v.cast("int") for v in (pattern, gazetteer, context, against)]


def features_of(span: Column) -> list[Column]:
    """Yes-no features of a span that the labelers do not use."""
    return [span["match"].contains(" "), span["before"].rlike(r"[:(]\s*$"), span["match"].rlike("[0-9]")]


def posteriors(counts: dict[tuple, float], rounds: int = 50) -> dict[tuple, float]:
    """Probability that a span is right for each (kind, loose, votes), by expectation-maximisation.

    Each labeler has one reliability (the chance that a vote it gives is right), kept within (0.5, 1) as they are taken to be
    better than chance; each kind and source has a prior.
    """
    labelers = len(next(iter(counts))[2]) if counts else 0
    right, prior = [0.8] * labelers, defaultdict(lambda: 0.5)
    out: dict[tuple, float] = {}
    for _ in range(rounds):
        for kind, loose, votes in counts:
            for_, against = prior[kind, loose], 1 - prior[kind, loose]
            for v, r in zip(votes, right, strict=True):
                if v != ABSTAIN:
                    for_, against = for_ * (r if v else 1 - r), against * (1 - r if v else r)
            out[kind, loose, votes] = for_ / (for_ + against)
        good, total = [4.0] * labelers, [5.0] * labelers  # a weak belief in 0.8
        mass, size = defaultdict(lambda: 1.0), defaultdict(lambda: 2.0)
        for (kind, loose, votes), n in counts.items():
            p = out[kind, loose, votes]
            mass[kind, loose] += n * p
            size[kind, loose] += n
            for j, v in enumerate(votes):
                if v != ABSTAIN:
                    good[j] += n * (p if v else 1 - p)
                    total[j] += n
        right = [min(0.99, max(0.55, g / t)) for g, t in zip(good, total, strict=True)]
        for key in size:
            prior[key] = min(0.98, max(0.02, mass[key] / size[key]))
    return out


def encoded(kind: int, loose: bool, votes: tuple, features: tuple) -> list[float]:
    """Inputs of the span classifier: the kind and source, a signed input for each labeler, the features."""
    return [float(kind == k) for k in range(len(KINDS))] + [float(loose)] + [0.0 if v == ABSTAIN else 2.0 * v - 1 for v in votes] + [float(f) for f in features]


def fit_classifier(rows: list[tuple[list[float], float, float]], rounds: int = 400, rate: float = 0.5, decay: float = 1e-3) -> list[float]:
    """Weights and bias of a logistic regression on (inputs, soft label, count)."""
    if not rows:
        return []
    w, total = [0.0] * (len(rows[0][0]) + 1), sum(n for _, _, n in rows)
    for _ in range(rounds):
        grad = [decay * x for x in w]
        for x, y, n in rows:
            error = (1 / (1 + math.exp(-max(-30.0, min(30.0, w[-1] + sum(a * b for a, b in zip(w, x)))))) - y) * n / total
            for i, v in enumerate(x):
                grad[i] += error * v
            grad[-1] += error
        w = [a - rate * g for a, g in zip(w, grad, strict=True)]
    return w


def classified(span: Column, weights: list[float]) -> Column:
    """The classifier's linear score of a voted span."""
    terms = [F.when(span["kind"] == k, w).otherwise(0.0) for k, w in enumerate(weights[: len(KINDS)])]
    terms.append(span["loose"].cast("double") * weights[len(KINDS)])
    rest = weights[len(KINDS) + 1 : -1]
    for j in range(4):
        terms.append(F.when(span["votes"][j] == ABSTAIN, 0.0).otherwise(span["votes"][j] * 2 - 1) * rest[j])
    for j, w in enumerate(rest[4:]):
        terms.append(span["features"][j].cast("double") * w)
    return sum(terms, F.lit(weights[-1]))


def joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def in_order(spans: Column) -> Column:
    return F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], s["kind"], s["end"])))


def find_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, base, all): arrays of (start, kind, end) of every text, in code points, ends exclusive.

    A null text counts as empty; without spans both arrays are empty. Added spans never overlap a base span or an added one that starts
    earlier. Equal texts have equal spans; an empty table gives no rows; other columns are not read.
    """
    text = F.coalesce(docs["text"], F.lit(""))
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text.alias("text"))
    # a pattern is only run over texts that have its sign; each result is a column of its own, so that none is found twice
    every = [(*p, False) for p in STRICT] + [(*p, True) for p in LOOSE]
    rows = rows.select("doc_id", "text", *[F.when(F.col("text").rlike(sign), F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias(f"found{i}") for i, (_, pattern, sign, _) in enumerate(every)])
    rows = rows.select(
        "doc_id", *[F.coalesce(f"found{i}", F.array().cast("array<string>")).alias(f"found{i}") for i in range(len(every))],
        *[F.when(F.size(f"found{i}") > 0, F.split("text", pattern, -1)).otherwise(F.array().cast("array<string>")).alias(f"gaps{i}") for i, (_, pattern, _, _) in enumerate(every)],
    )
    spans = [spans_of(F.col(f"found{i}"), F.col(f"gaps{i}"), kind, loose) for i, (kind, _, _, loose) in enumerate(every)]
    found = rows.select("doc_id", F.filter(F.concat(*spans[: len(STRICT)]), base_rule).alias("base"), F.concat(*spans[len(STRICT) :]).alias("loose"))

    def voted(s: Column) -> Column:
        return F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["loose"].alias("loose"), F.array(*votes_of(s)).alias("votes"), F.array(*features_of(s)).alias("features"))

    found = found.select("doc_id", "base", apart_from(F.col("loose"), F.col("base")).alias("loose"))
    found = stored(found.select("doc_id", F.transform("base", voted).alias("base"), F.transform("loose", voted).alias("loose")), "spans")
    each = found.select(F.explode(F.concat("base", "loose")).alias("s")).groupBy("s.kind", "s.loose", "s.votes", "s.features").count()
    patterns = [(r["kind"], r["loose"], tuple(r["votes"]), tuple(r["features"]), r["count"]) for r in each.collect()]
    counts: dict[tuple, float] = defaultdict(float)
    for kind, loose_, votes, _, n in patterns:
        counts[kind, loose_, votes] += n
    sure = posteriors(counts)
    weights = fit_classifier([(encoded(k, s, v, f), sure[k, s, v], n) for k, s, v, f, n in patterns])
    accepted = F.filter("loose", lambda s: classified(s, weights) > 0) if weights else F.col("loose")

    added = first_come(in_order(accepted))
    return found.select("doc_id", in_order(F.col("base")).alias("base"), added.alias("added")).select("doc_id", "base", F.array_sort(F.concat("base", "added")).alias("all"))


def count_of(spans: str, kind: str) -> Column:
    """How many spans of an array have the kind."""
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("long")


def personal_data(docs: DataFrame) -> DataFrame:
    """Counts of the base kinds, checksum of the base spans and all spans of every text; the rules of `find_spans` hold."""
    counts = [count_of("base", kind).alias(f"n_{kind}") for kind in KINDS[:BASE]]
    return find_spans(docs).select("doc_id", *counts, F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), joined(F.col("all")).alias("spans"))
