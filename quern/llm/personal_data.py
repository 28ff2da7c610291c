"""Personal data by weak supervision: base patterns always count; regex, gazetteer, context and shape labelers vote on
further candidate spans, expectation-maximisation estimates how reliable each labeler is, and a naive Bayes span
classifier, trained on the posteriors, decides.

Only DataFrame functions touch documents. The driver gets one count for each pattern of votes and bucketed features
(a bounded number), never a span.

The patterns differ from the contract's only in possessive quantifiers and look-behinds where backtracking could not
find another match, so each text is scanned in linear time and without recursion.

Cases: null text is empty and has no spans; without candidates nothing is added; positions count code points, the end
is exclusive; equal texts get equal spans; other columns are ignored by find() and kept by redact().
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import Scratch, fresh, let

#: The base kinds in order, with their patterns.
LOCAL = "[A-Za-z0-9._%+-]"
BASE = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without this has no match of the kind.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
#: Kinds in the order in which spans are listed; the last two come from the method only.
KINDS = (*BASE, "secret", "id")
#: A word that names a secret, and what stands between it and its value.
NAMED = r"(?i:pass(?:word|wd|phrase)?|pwd|secret|token|api[_-]?key|access[_-]?key|auth[_-]?key)[\"']?\x20?[:=]\x20?[\"']?"
#: Formats of candidates. A candidate is any match; each labeler then votes on it.
FORMATS = {
    "named": rf"(?<![A-Za-z0-9]){NAMED}[^\s\"'<>,;]{{6,}}+",
    "signed": r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+(?:\.[A-Za-z0-9_-]*+)?",
    "uuid": r"(?<![A-Za-z0-9-])[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}(?![A-Za-z0-9-])",
    "iban": r"(?<![A-Za-z0-9_])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20[0-9]{1,3}|[A-Z0-9]{1,3})?(?![A-Za-z0-9_])",
    "opened": r"(?<![A-Za-z0-9_])(?:sk-|xox[abprs]-|glpat-|ya29\.|SG\.|pypi-)[A-Za-z0-9_+/=.-]{12,}+",
    "padded": r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9+/]{20,}+={1,2}(?![A-Za-z0-9=])",
    "run": r"(?<![A-Za-z0-9_])[A-Za-z0-9_]{12,}+(?![A-Za-z0-9_])",
    "phone": r"(?<![0-9+(-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[.-][0-9]{4}(?![0-9-])|(?<![0-9+(.-])0[0-9]{2,4}[\x20/-][0-9]{5,8}(?![0-9-])",
    "number": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
#: All begin where a word may begin, which is looked at once for all of them, and with one of these characters.
CANDIDATE = "(?<![A-Za-z0-9_])(?=[A-Za-z0-9_(/+])(?:" + "|".join(FORMATS.values()) + ")"
#: Openings of well-known keys, and the country codes of account numbers.
KEY_STARTS = (
    "AKIA", "ASIA", "AIza", "AC", "SK", "EAAC", "dop_v1_", "eyJ", "ghp_", "gho_", "ghs_", "ghu_", "github_pat_", "glpat", "hf_", "key_", "npm_", "pat_", "pk_live", "pk_test",
    "pypi-", "rk_live", "rk_test", "secret_", "shpat_", "sk-", "sk_live", "sk_test", "SG.", "sq0", "token_", "whsec_", "xoxa", "xoxb", "xoxp", "xoxr", "xoxs", "ya29.",
)
COUNTRIES = "AD AE AL AT AZ BA BE BG BH BR CH CR CY CZ DE DK DO EE ES FI FO FR GB GE GI GL GR GT HR HU IE IL IS IT JO KW KZ LB LI LT LU LV MC MD ME MK MR MT MU NL NO PK PL PS PT QA RO RS SA SE SI SK SM TN TR UA VG XK".split()
#: Fixed value: ordinary pieces of names, addresses of pages and files.
ORDINARY = "about article blog category chapter com content data default example figure file html http https image images index info item jpg json list main name net news org page pages pdf php png post product section test the user value version www".split()
#: Words that stand before secrets and personal numbers, and before other long numbers and names.
CONTEXT = r"(?i)(?:pass(?:word|wd|phrase)?|pwd|token|secret|api.?key|access.?key|credential|auth|tel|phone|mobile|fax|call|ssn|social|account|iban|passport|license)[^A-Za-z0-9]{0,6}$"
OTHERWISE = r"(?i)(?:isbn|issn|doi|version|chapter|page|figure|table|order|invoice|commit|build|revision|https?:/|www\.)[^A-Za-z0-9]{0,6}$|/$"
LABELERS = ("regex", "gazetteer", "context", "shape")
FEATURES = ("length", "digits", "case", "mark")


def _spans(text: Column, kind: str, valid) -> Column:
    """array<struct<kind, start, end, match, before>> of the leftmost non-overlapping matches that are valid."""
    pattern = BASE.get(kind, CANDIDATE)
    empty = F.array().cast("array<struct<start:int,stop:int,found:string,before:string>>")

    def placed(found: Column) -> Column:
        def walk(between: Column) -> Column:
            start = F.struct(F.lit(0).alias("at"), empty.alias("out"))

            def step(a: Column, i: Column) -> Column:
                at = a["at"] + F.length(F.get(between, i))
                m = F.get(found, i)
                end = at + F.length(m)
                item = F.struct(at.alias("start"), end.alias("stop"), m.alias("found"), F.right(F.get(between, i), F.lit(24)).alias("before"))
                return F.struct(end.alias("at"), F.concat(a["out"], F.array(item)).alias("out"))

            return F.aggregate(F.sequence(F.lit(0), F.size(found) - 1), start, step, lambda a: a["out"])

        return F.when(F.size(found) == 0, empty).otherwise(F.filter(let(F.split(text, pattern, -1), walk), lambda s: valid(s["found"])))

    def scanned() -> Column:
        return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)

    needs = NEEDS.get(kind)
    return F.when(F.contains(text, F.lit(needs)), scanned()).otherwise(empty) if needs else scanned()


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    """16 to 19 digits whose Luhn sum ends in 0."""

    def total(d: Column) -> Column:
        n = F.length(d)

        def value(i: Column) -> Column:
            x = F.substring(d, i, F.lit(1)).cast("int")
            twice = (n - i) % 2 == 1
            return F.when(twice, F.when(x > 4, 2 * x - 9).otherwise(2 * x)).otherwise(x)

        return n.between(16, 19) & (F.aggregate(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), value), F.lit(0), lambda a, x: a + x) % 10 == 0)

    return let(_digits(m), lambda d: F.when(F.length(d).between(16, 19), total(d)).otherwise(F.lit(False)))


VALID = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: F.forall(F.split(m, r"\."), lambda x: F.coalesce(x.try_cast("bigint") <= 255, F.lit(False))),
    "card": _luhn,
    "phone": lambda m: F.length(_digits(m)).between(8, 15),
}


def base_spans(text: Column) -> Column:
    """array<struct<kind (its place in KINDS), start, stop>>, by kind, then start."""

    def of(k: int, kind: str) -> Column:
        return F.transform(_spans(text, kind, VALID[kind]), lambda s: F.struct(F.lit(k).alias("kind"), s["start"].alias("start"), s["stop"].alias("stop")))

    return F.concat(*(of(k, kind) for k, kind in enumerate(BASE)))


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def _described(s: Column) -> Column:
    """A candidate with its kind, votes and features, all small integers. A named one is its value alone."""
    m = F.regexp_replace(s["found"], rf"^{NAMED}(?=[^\s\"'<>,;]{{6}})", "")
    named = F.length(s["found"]) - F.length(m)
    before = F.concat(s["before"], F.substring(s["found"], F.lit(1), named))
    shifted = F.struct((s["start"] + named).alias("start"), s["stop"].alias("stop"), m.alias("found"), before.alias("before"))
    return let(shifted, _judged)


def _judged(s: Column) -> Column:
    m, n, before = s["found"], F.length(s["found"]), s["before"]
    d = F.length(_digits(m))
    letters = F.length(F.regexp_replace(m, "[^A-Za-z]", ""))
    upper = F.length(F.regexp_replace(m, "[^A-Z]", ""))
    whole = lambda *names: m.rlike("^(?:" + "|".join(FORMATS[x] for x in names) + ")$")
    iban, id_number = whole("iban"), whole("number")
    plain = m.rlike(r"^(?:[0-9]++|[A-Za-z]++|[a-z]++(?:_[a-z]++)*+_?[0-9]{0,4})$")
    kind = F.when(iban | whole("uuid") | id_number, KINDS.index("id")).when(letters > 0, KINDS.index("secret")).when(m.rlike(r"[^0-9]"), KINDS.index("phone")).when(n.between(13, 19), KINDS.index("card")).otherwise(KINDS.index("id"))
    formatted = m.rlike(r"^(?:AKIA[0-9A-Z]{16}|[0-9a-f]{16}|[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64}|[0-9a-f]{128})$") & (d > 0) | whole("signed", "uuid", "iban", "opened", "padded", "phone", "number")
    ordinary = m.rlike("(?i)(?:^|[_./+-])(?:" + "|".join(ORDINARY) + ")(?:$|[_./+0-9-])")
    return F.struct(
        kind.alias("kind"),
        s["start"].alias("start"),
        s["stop"].alias("stop"),
        _vote(formatted, plain).alias("regex"),
        _vote(m.rlike("^(?:" + "|".join(x.replace(".", r"\.") for x in KEY_STARTS) + ")") & (d > 0) | iban & F.left(m, F.lit(2)).isin(COUNTRIES), ordinary).alias("gazetteer"),
        _vote(before.rlike(CONTEXT), before.rlike(OTHERWISE)).alias("context"),
        _vote((d * 100).between(n * 15, n * 85) & (letters > 0), (d * 100 < n * 5) & (upper == 0) | (d == n)).alias("shape"),
        F.least(F.lit(4), (n / 10).cast("int")).alias("length"),
        F.least(F.lit(4), (d * 5 / n).cast("int")).alias("digits"),
        F.when(letters == 0, 0).when(upper == 0, 1).when(upper == letters, 2).otherwise(3).alias("case"),
        F.when(m.rlike("[^A-Za-z0-9]"), 1).otherwise(0).alias("mark"),
    )


def candidates(text: Column, base: Column) -> Column:
    """Described candidates that overlap no base span."""
    free = lambda c: ~F.exists(base, lambda b: (b["start"] < c["stop"]) & (c["start"] < b["stop"]))
    # letters alone are words, but for values that are named as secrets and long runs that change case over and over
    likely = lambda m: m.rlike(rf"[0-9]|^{NAMED}|(?:[a-z][A-Z].*){{3}}")
    return F.transform(F.filter(_spans(text, "candidate", likely), free), _described)


class SpanModel:
    """prior and, for each feature and value, the log odds that the naive Bayes classifier adds."""

    def __init__(self, prior: float, odds: dict[str, dict[int, float]], accuracy: dict[str, float]):
        self.prior, self.odds, self.accuracy = prior, odds, accuracy

    def accepts(self, c: Column) -> Column:
        z = F.lit(self.prior)
        for f, by in self.odds.items():
            v = F.lit(0.0)
            for value, o in sorted(by.items()):
                v = F.when(c[f] == value, o).otherwise(v)
            z = z + v
        return z >= 0


def fit(counts: dict[tuple, int], rounds: int = 40, few: float = 10.0) -> SpanModel:
    """counts: by (votes of LABELERS, values of FEATURES). Estimates each labeler's accuracy, where it votes, then trains the classifier.

    The classifier sees the features and the votes. With no counts it accepts nothing.
    """
    if not counts:
        return SpanModel(-1.0, {}, {})
    n = len(LABELERS)
    acc, prior = [0.8] * n, 0.0
    post: dict[tuple, float] = {}
    for _ in range(rounds):
        right, voted, total, yes = [2.0] * n, [2.5] * n, 2.0, 1.0
        for key, k in counts.items():
            z = prior + sum(v * math.log(a / (1 - a)) for v, a in zip(key[:n], acc))
            p = post[key] = 1 / (1 + math.exp(-z))
            total, yes = total + k, yes + k * p
            for r, v in enumerate(key[:n]):
                if v:
                    voted[r] += k
                    right[r] += k * (p if v > 0 else 1 - p)
        acc = [min(0.98, max(0.55, a / b)) for a, b in zip(right, voted)]
        share = min(0.95, max(0.05, yes / total))
        prior = math.log(share / (1 - share))
    names = (*LABELERS, *FEATURES)
    mass = {y: defaultdict(lambda: 1.0) for y in (0, 1)}
    whole = {0: 1.0, 1: 1.0}
    values = defaultdict(set)
    for key, k in counts.items():
        for y, p in ((1, post[key]), (0, 1 - post[key])):
            whole[y] += k * p
            for f, v in zip(names, key):
                values[f].add(v)
                mass[y][f, v] += k * p
    odds: dict[str, dict[int, float]] = {}
    for f, vs in values.items():
        for v in vs:
            x = math.log(mass[1][f, v] / (whole[1] + len(vs))) - math.log(mass[0][f, v] / (whole[0] + len(vs)))
            seen = mass[1][f, v] + mass[0][f, v]
            # what was seen seldom says little; a vote stays evidence in its direction
            x *= seen / (seen + few)
            odds.setdefault(f, {})[v] = x if f in FEATURES or not v else max(x, 0.0) if v > 0 else min(x, 0.0)
    return SpanModel(math.log(whole[1] / whole[0]), odds, dict(zip(LABELERS, acc)))


def _counts(df: DataFrame, cands: str) -> dict[tuple, int]:
    names = (*LABELERS, *FEATURES)
    rows = df.select(F.explode(cands).alias("c")).groupBy(*(F.col(f"c.{x}").alias(x) for x in names)).agg(F.count("*").alias("n")).collect()
    return {tuple(r[:-1]): r[-1] for r in rows}


def _written(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["stop"])), ",")


def _all_spans(base: Column, cands: Column, model: SpanModel) -> Column:
    added = F.transform(F.filter(cands, model.accepts), lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["stop"].alias("stop")))
    return F.array_sort(F.concat(base, added))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, the number of base spans of each kind, base_sha256, spans (base and added)."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    seen = docs.select(F.col(id_col).alias("doc_id"), let(base_spans(t), lambda b: F.struct(b.alias("base"), candidates(t, b).alias("cands"))).alias("s")).select("doc_id", "s.base", "s.cands")
    held = Scratch(docs.sparkSession, "personal-data").write(seen, "spans")
    model = fit(_counts(held, "cands"))
    base = F.col("base")
    number = lambda k: F.size(F.filter(base, lambda s: s["kind"] == k)).cast("long")
    numbers = [number(k).alias(f"n_{kind}") for k, kind in enumerate(BASE)]
    return held.select("doc_id", *numbers, F.sha2(_written(base).cast("binary"), 256).alias("base_sha256"), _written(_all_spans(base, F.col("cands"), model)).alias("spans"))


def redact(docs: DataFrame, text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """docs with every span replaced by its kind in brackets; overlapping spans become one, named by the first. length_col is counted anew."""
    s = fresh(docs, "pii_spans")
    t = F.coalesce(F.col(text_col), F.lit(""))
    seen = docs.withColumn(s, let(base_spans(t), lambda x: F.struct(x.alias("b"), candidates(t, x).alias("c"))))
    model = fit(_counts(seen.select(F.col(s)["c"].alias("c")), "c"))
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    by_place = lambda x: F.array_sort(F.transform(x, lambda y: F.struct(y["start"].alias("start"), y["stop"].alias("stop"), y["kind"].alias("kind"))))

    def rewrite(spans: Column) -> Column:
        def step(a: Column, x: Column) -> Column:
            piece = F.concat(F.substring(t, a["at"] + 1, x["start"] - a["at"]), F.get(names, x["kind"]))
            return F.when(x["start"] < a["at"], F.struct(F.greatest(a["at"], x["stop"]).alias("at"), a["out"].alias("out"))).otherwise(F.struct(x["stop"].alias("at"), F.concat(a["out"], piece).alias("out")))

        return F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda a: F.concat(a["out"], F.substring(t, a["at"] + 1, F.length(t))))

    spans = by_place(_all_spans(F.col(s)["b"], F.col(s)["c"], model))
    new = let(spans, lambda x: F.when(F.size(x) == 0, F.col(text_col)).otherwise(rewrite(x)))
    out = seen.withColumn(text_col, new)
    if length_col and length_col in docs.columns:
        out = out.withColumn(length_col, F.length(F.col(text_col)).cast("long"))
    return out.select(*docs.columns)
