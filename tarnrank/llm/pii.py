"""Personal data by weak-supervision aggregation, in DataFrame functions only.

Candidate spans come from regular expressions, a superset of the four base forms. Labelers (strict
form, gazetteer, words before, words around, checksum and range, boundary) vote on each: yes, no or
nothing. Expectation-maximisation over the counts of vote patterns estimates each labeler's
reliability by kind and a probability for each pattern. A logistic span classifier is trained on
those with features of the span and its context that no labeler reads (length, digits, parts, capitals,
what stands next to it, the line it is on), so it also tells apart candidates with the same votes.
A candidate of a base form always stays; others stay if the classifier says so and no checksum or
range speaks against them. Added spans have no greatest length.

The driver sees patterns of votes and features and their counts: at most 3 ** 6 x 3 ** 6 for each
kind, whatever the corpus. Counts are taken as shares, so that a model does not depend on size.

Rows: null text is the empty text and has no spans; repeated rows count and are returned each time;
null ids are kept. Whole texts are searched. Columns other than the two named are dropped. Where a
table has no candidates, nothing is learnt and nothing is added.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .spans import joined, with_spans

#: The base kinds, as listed.
BASE = ["email", "ip", "card", "phone"]
KINDS = [*BASE, "ssn", "name"]
LABELERS = ["form", "gazetteer", "before", "around", "check", "edge"]
#: Features, each 0, 1 or 2.
FEATURES = ["length", "digits", "parts", "capitals", "next", "line"]

_LOCAL = "[A-Za-z0-9._%+-]"
_TITLE = "Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Mlle|Sr|Sra"
#: Common given names and endings of domains.
GIVEN = """
Adam Alice Amy Andrea Andrew Angela Anna Anne Anthony Antonio Barbara Benjamin Betty Brian Camille Carlos Carmen Carol Catherine Charles Christian
Christine Christopher Claire Claudia Daniel David Deborah Diego Dietmar Donald Donna Dorothy Edward Elena Elizabeth Emily Emma Eric Eva Francisco
Frank Gary George Hans Helen Henry Isabel Jack Jacob James Jan Jason Javier Jean Jeffrey Jennifer Jessica Joan John Jonathan Jorge Joseph Joshua Juan
Julia Julie Karen Karin Karl Kathleen Kenneth Kevin Kimberly Klaus Larry Laura Laurent Lisa Linda Louis Lucas Luis Manuel Marc Margaret Maria Marie
Mark Martin Mary Matthew Melissa Michael Michelle Miguel Monika Nancy Nathalie Nicholas Nicole Olivia Pablo Pamela Patricia Patrick Paul Pedro Peter
Philippe Pierre Rachel Raymond Rebecca Richard Robert Ronald Rosa Ruth Ryan Samantha Samuel Sandra Sarah Scott Sharon Silvia Simon Sophia Sophie
Stefan Stephanie Stephen Steven Susan Sylvie Theresa Thomas Timothy Ursula Victor Virginia Walter William Wolfgang
""".split()
DOMAINS = "com org net edu gov mil int io dev app info biz ai co me de fr es uk eu it nl be at ch pt pl se no dk fi ie cz ru ua tr in cn jp kr au nz ca us mx br ar cl".split()
_GIVEN = "|".join(GIVEN)
#: Patterns of candidates, (kind, pattern, clue that a text with one must match).
CANDIDATES = [
    ("email", rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    ("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ""),
    ("card", r"[0-9](?:[\x20-]?[0-9]){13,}+", ""),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]"),
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{2,}+\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]{2,}+(?:\x20?[\[(]dot[\])]\x20?[A-Za-z0-9-]{2,}+)+", r"[\[(]at[\])]"),
    ("phone", r"(?<![0-9+().-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9-])", ""),
    ("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", ""),
    ("name", rf"(?<![A-Za-z])(?=[A-Z])(?:{_TITLE})\.?\x20[A-Z][a-z]++(?:\x20[A-Z][a-z]++)?", rf"(?=[A-Z])(?:{_TITLE})\.?\x20[A-Z]"),
    ("name", rf"(?<![A-Za-z])(?=[A-Z][a-z]++\x20[A-Z])(?:{_GIVEN})\x20[A-Z][a-z]++", rf"(?=[A-Z][a-z]++\x20[A-Z])(?:{_GIVEN})\x20[A-Z]"),
]
#: Fixed values by kind: strict form; gazetteer of endings, prefixes and names; words before; words around that speak against.
FORM = {
    "email": rf"^{_LOCAL}{{1,64}}@(?:[A-Za-z0-9-]++\.)++[A-Za-z]{{2,24}}$",
    "ip": r"^(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?:\.|$)){4}",
    "card": r"^(?:[0-9]{14,19}|[0-9]{4}(?:[\x20-][0-9]{4}){3})$",
    "phone": r"^\+[0-9]{1,3}[\x20.-]?\(?[0-9]{1,4}\)?(?:[\x20.-]?[0-9]{2,4}){2,4}$",
    "ssn": r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$",
    "name": rf"^(?:(?:{_TITLE})\.?\x20)?[A-Z][a-z]+\x20[A-Z][a-z]+$",
}
GAZETTEER = {
    "email": rf"(?i:{'|'.join(DOMAINS)})$",
    "ip": r"^(?:10|127|172|192)\.",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|36|38|6011|65)",
    "phone": r"^\+(?:1|33|34|44|49|39|41|43)(?![0-9]{12})",
    "ssn": r"^[0-7]",
    "name": rf"(?<![A-Za-z])(?:{_GIVEN})(?![A-Za-z])",
}
BEFORE = {
    "email": r"(?:e-?mail|mail|contact|write to|correo|courriel)[^a-z]{0,4}$",
    "ip": r"(?:\bip|address|host|server|adresse)[^a-z]{0,4}$",
    "card": r"(?:card|visa|mastercard|amex|credit|karte|tarjeta|carte)[^a-z]{0,4}$",
    "phone": r"(?:phone|tel|call|mobile|cell|fax|telefon|teléfono)[^a-z]{0,4}$",
    "ssn": r"(?:ssn|social security)[^a-z]{0,12}$",
    "name": r"(?:name|dear|signed|author|by)[^a-z]{0,4}$",
}
AGAINST = r"(?<![a-z])(?:version|release|isbn|issn|order|invoice|serial|sku|hash|commit|token|id|ref|no|nr|section)[^a-z]{0,4}$"
AFTER = r"^[^a-z]{0,4}(?:items?|pieces|units|pages|euros?|dollars|percent|bytes|street|avenue|inc|ltd|gmbh)(?![a-z])"


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and ``found``: kind, start, end, base (whether a base form), votes (-1, 0, 1 by labeler), features (0, 1, 2)."""
    df = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    names = []
    for i, (kind, pattern, clue) in enumerate(CANDIDATES):
        names.append((f"c{i}", kind, i < len(BASE)))
        df = with_spans(df, "text", f"c{i}", pattern, F.col("text").rlike(clue) if clue else None)
    parts = []
    for name, kind, strict in names:
        parts.append(F.transform(name, _voter(kind, strict)))
    found = F.concat(*parts)
    # a second pattern's span is dropped where a base span of its kind overlaps it
    base = F.filter(found, lambda s: s["base"])
    df = df.select("id", base.alias("sure"), F.filter(found, lambda s: ~s["base"]).alias("maybe"))
    apart = F.filter("maybe", lambda m: ~F.exists("sure", lambda s: (s["kind"] == m["kind"]) & (s["start"] < m["end"]) & (m["start"] < s["end"])))
    df = df.select("id", "sure", F.array_distinct(apart).alias("maybe"))
    # of two such spans of a kind, one that lies within the other goes
    inside = lambda m, o: (o["kind"] == m["kind"]) & (o["start"] <= m["start"]) & (o["end"] >= m["end"]) & (o["end"] - o["start"] > m["end"] - m["start"])
    outer = F.filter("maybe", lambda m: ~F.exists("maybe", lambda o: inside(m, o)))
    return df.select("id", F.concat("sure", outer).alias("found"))


def _voter(kind: str, strict: bool):
    return lambda s: _voted(s, kind, strict)


def _voted(s: Column, kind: str, strict: bool) -> Column:
    value, text = s["value"], F.col("text")
    digits = F.regexp_replace(value, "[^0-9]", "")
    before = F.lower(F.substring(text, F.greatest(F.lit(1), s["start"] - 23), F.least(F.lit(24), s["start"])))
    following = F.lower(F.substring(text, s["end"] + 1, F.lit(24)))
    after = F.substring(text, s["end"] + 1, F.lit(1))
    n = F.length(digits)
    check = {
        "email": F.lit(True),
        "ip": F.forall(F.split(value, r"\."), lambda p: _at_most_255(p)),
        "card": (n >= 14) & (n <= 19) & _luhn(digits),
        "phone": (n >= 10) & (n <= 15),
        "ssn": F.lit(True),
        "name": F.lit(True),
    }[kind]
    yes_no = lambda c, no=-1: F.when(c, 1).otherwise(no)
    votes = [
        yes_no(value.rlike(FORM[kind])),
        yes_no(value.rlike(GAZETTEER[kind]), 0),
        yes_no(before.rlike(BEFORE[kind]), 0),
        F.when(before.rlike(AGAINST) | following.rlike(AFTER), -1).otherwise(0),
        yes_no(check) if kind in ("ip", "card", "phone") else F.lit(0),
        yes_no(~before.rlike(r"[a-z0-9_./=-]$") & ~after.rlike(r"[A-Za-z0-9_=/]")),
    ]
    three = lambda x, low, high: F.when(x <= low, 0).when(x <= high, 1).otherwise(2)
    features = [
        three(s["end"] - s["start"], *{"email": (14, 24), "ip": (9, 12), "card": (15, 18), "phone": (12, 15), "ssn": (10, 11), "name": (10, 16)}[kind]),
        three(n, *{"email": (0, 3), "ip": (6, 9), "card": (15, 16), "phone": (10, 12), "ssn": (8, 9), "name": (0, 1)}[kind]),
        three(F.size(F.split(value, r"[^A-Za-z0-9]+")), 2, 4),
        three(F.length(F.regexp_replace(value, "[^A-Z]", "")), 0, 2),
        F.when(following.rlike(r"^[.,;:!?)\]'\"]?(?:\s|$)"), 0).when(following.rlike("^[a-z0-9]"), 2).otherwise(1),
        F.when(before.rlike(r"(?:^|\n)\s*$"), 0).when(before.rlike(r"[:=(<\"']\s*$"), 1).otherwise(2),
    ]
    base, small = check if strict else F.lit(False), lambda xs: F.array(*[x.cast("tinyint") for x in xs])
    return F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), base.alias("base"), small(votes).alias("votes"), small(features).alias("features"))


def _at_most_255(part: Column) -> Column:
    plain = F.ltrim(part, F.lit("0"))
    return (F.length(plain) < 3) | ((F.length(plain) == 3) & (plain <= "255"))


def _luhn(digits: Column) -> Column:
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2) % 10 + F.floor(d.cast("int") / 5).cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, d: a + d) % 10 == 0


Pattern = tuple[str, tuple[int, ...], tuple[int, ...], bool, int]


def patterns(found: DataFrame) -> list[Pattern]:
    """kind, votes, features, base and how many candidates: pre-aggregated counts over all rows."""
    rows = found.select(F.explode("found").alias("s")).groupBy("s.kind", "s.votes", "s.features", "s.base").agg(F.count("*").alias("n")).collect()
    return sorted((r["kind"], tuple(r["votes"]), tuple(r["features"]), r["base"], r["n"]) for r in rows)


def aggregate_votes(counts: list[Pattern], rounds: int = 50) -> tuple[dict, dict]:
    """Expectation-maximisation by kind: probability by (kind, votes), reliabilities by kind.

    Reliabilities are P(vote | truth) for each labeler, smoothed by one count; the start is the
    votes' balance. Labelers are independent given the truth.
    """
    chance, reliability = {}, {}
    for kind in sorted({k for k, *_ in counts}):
        merged: dict[tuple[int, ...], int] = {}
        for k, v, *_, n in counts:
            if k == kind:
                merged[v] = merged.get(v, 0) + n
        votes, n = np.array(list(merged), int), np.array(list(merged.values()), float)
        p = 1 / (1 + np.exp(-votes.sum(1)))
        for _ in range(rounds):
            prior = (n @ p + 1) / (n.sum() + 2)
            by = np.array([[[((n * w)[votes[:, j] == v].sum() + 1) / (n @ w + 3) for v in (-1, 0, 1)] for j in range(votes.shape[1])] for w in (1 - p, p)])
            score = [np.log(q) + sum(np.log(by[y, j, votes[:, j] + 1]) for j in range(votes.shape[1])) for y, q in ((0, 1 - prior), (1, prior))]
            p = 1 / (1 + np.exp(np.clip(score[0] - score[1], -50, 50)))
        chance |= {(kind, tuple(v)): float(x) for v, x in zip(votes.tolist(), p, strict=True)}
        reliability[kind] = by
    return chance, reliability


#: Candidates that a kind's counts are scaled to before training: the weight of the ridge is the same at every size.
SCALE = 10_000.0


def train(counts: list[Pattern], rounds: int = 30) -> dict[str, list[float]]:
    """Weights by kind of the span classifier: bias, each labeler's yes and no, then each feature's 1 and 2.

    Logistic regression by Newton steps with a unit ridge, on the shares of patterns and the
    probabilities of :func:`aggregate_votes`; a base form is positive whatever the votes.
    """
    chance, _ = aggregate_votes(counts)
    weights = {}
    for kind in sorted({k for k, *_ in counts}):
        own = [(v, f, b, n) for k, v, f, b, n in counts if k == kind]
        x = np.array([_inputs(v, f) for v, f, _, _ in own])
        y = np.array([1.0 if b else chance[kind, v] for v, _, b, _ in own])
        n = np.array([m for *_, m in own], float)
        n *= SCALE / n.sum()
        w = np.zeros(x.shape[1])
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            w += np.linalg.solve((x.T * (n * p * (1 - p))) @ x + np.eye(len(w)), x.T @ (n * (y - p)) - w)
        weights[kind] = [float(v) for v in w]
    return weights


def _inputs(votes, features) -> list[float]:
    return [1.0, *(float(c == y) for c in votes for y in (1, -1)), *(float(c == y) for c in features for y in (1, 2))]


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id and ``found`` (kind, start, end, base), base forms and added spans.

    Candidates are found in one pass over the texts and written without them; no text is shuffled.
    """
    found = materialize(candidates(docs, id_col, text_col))
    weights = train(patterns(found))

    def chosen(s: Column) -> Column:
        score = F.lit(-1.0)
        for kind, (bias, *each) in weights.items():
            inputs = [s["votes"][j] == v for j in range(len(LABELERS)) for v in (1, -1)] + [s["features"][j] == v for j in range(len(FEATURES)) for v in (1, 2)]
            terms = [F.when(given, w).otherwise(0.0) for given, w in zip(inputs, each, strict=True)]
            score = F.when(s["kind"] == kind, sum(terms, F.lit(bias))).otherwise(score)
        return s["base"] | ((score > 0) & (s["votes"][LABELERS.index("check")] >= 0))

    kept = F.transform(F.filter("found", chosen), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["base"].alias("base")))
    return found.select(F.col("id").alias(id_col), kept.alias("found"))


def digest(found: DataFrame) -> DataFrame:
    """doc_id and found to the columns of the report."""
    base = F.filter("found", lambda s: s["base"])
    count = lambda kind: F.size(F.filter("found", lambda s: s["base"] & (s["kind"] == kind))).cast("long")
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in BASE], F.sha2(joined(base, BASE), 256).alias("base_sha256"), joined(F.col("found"), KINDS).alias("spans"))
