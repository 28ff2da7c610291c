"""Quality rules by weak supervision: each rule votes for, against or abstains; expectation-maximisation estimates
how each rule votes on good and on bad documents; the posterior probability of quality decides.

Only DataFrame functions touch documents. What reaches the driver is a count for each pattern of votes: at most 3 to
the power of the number of rules, whatever the input.

Cases: null text has no words; texts under 50 words, or with over half their words in repeated 3-word windows, fail
the base rules whatever the votes say; with no documents the model is its prior; equal rows get equal verdicts;
other columns are ignored by rate() and kept by keep_good(), whose own column gets a name that the table lacks.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import SPACE_CHARS, Scratch, fresh, let, words

#: Fixed value: the characters that count as symbols.
SYMBOLS = "#*$%&|<>"
#: The rules, in the order of their votes.
RULES = ("length", "word_length", "symbols", "repeated_words", "repeated_lines", "capitals", "wordless", "marked_words")
VOTES = (-1, 0, 1)


def _repeat_words(w: Column) -> Column:
    """Words in 3-word windows that occur twice or more; windows are compared by 64-bit hashes."""
    n = F.size(w)
    windows = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda j: F.xxhash64(F.get(w, j), F.get(w, j + 1), F.get(w, j + 2)))).otherwise(F.array().cast("array<bigint>"))

    def covered(ordered: Column) -> Column:
        same = lambda i, k: F.coalesce(F.get(ordered, i)["h"] == F.get(ordered, i + k)["h"], F.lit(False))
        twice = F.filter(F.sequence(F.lit(0), F.size(ordered) - 1), lambda i: same(i, -1) | same(i, 1))
        starts = F.sort_array(F.transform(twice, lambda i: F.get(ordered, i)["p"]))
        start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("total"))
        return F.aggregate(starts, start, lambda a, s: F.struct(s.alias("last"), (a["total"] + F.least(F.lit(3), s - a["last"])).alias("total")), lambda a: a["total"])

    return let(
        windows,
        lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(
            let(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p")))), covered)
        ),
    )


def measures(text: Column) -> Column:
    """A struct of what the rules look at, over the whole text."""
    t = F.coalesce(text, F.lit(""))
    left = lambda chars: F.length(F.translate(t, chars, "")).cast("long")  # noqa: E731  code points without these
    lines = F.filter(F.split(t, "\n", -1), lambda x: F.length(F.translate(x, SPACE_CHARS, "")) > 0)
    by_word = let(
        words(text),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            _repeat_words(w).alias("n_repeat_words"),
            F.size(F.filter(w, lambda x: ~x.rlike(r"\p{L}"))).cast("long").alias("n_wordless"),
            F.size(F.filter(w, lambda x: x.rlike(r"[#*$%&|<>]|\p{L}[^\p{L}\s]*!!"))).cast("long").alias("n_marked"),
        ),
    )
    by_line = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    return let(
        by_word,
        lambda w: let(
            by_line,
            lambda x: F.struct(
                w["n_words"].alias("n_words"),
                left(SPACE_CHARS).alias("word_chars"),
                (F.length(t) - left(SYMBOLS)).cast("long").alias("n_symbols"),
                x["n_dup_lines"].alias("n_dup_lines"),
                w["n_repeat_words"].alias("n_repeat_words"),
                x["n_lines"].alias("n_lines"),
                w["n_wordless"].alias("n_wordless"),
                w["n_marked"].alias("n_marked"),
                F.length(F.regexp_replace(t, r"\P{Lu}+", "")).cast("long").alias("n_capitals"),
            ),
        ),
    )


def votes(m: Column) -> list[Column]:
    """A vote of each rule in RULES: 1 good, -1 bad, 0 abstains."""

    def vote(bad: Column, good: Column) -> Column:
        return F.when(bad, -1).when(good, 1).otherwise(0)

    n = m["n_words"]
    return [
        vote(n < 50, n >= 100),
        vote((m["word_chars"] * 10 < n * 25) | (m["word_chars"] > n * 12), (m["word_chars"] >= n * 3) & (m["word_chars"] <= n * 9)),
        vote(m["n_symbols"] * 10 > n, m["n_symbols"] * 50 <= n),
        vote(m["n_repeat_words"] * 100 > n * 30, m["n_repeat_words"] * 100 <= n * 15),
        vote(m["n_dup_lines"] * 100 > m["n_lines"] * 30, (m["n_dup_lines"] == 0) & (m["n_lines"] > 1)),
        vote(m["n_capitals"] * 100 > m["word_chars"] * 30, m["n_capitals"] * 100 <= m["word_chars"] * 10),
        vote(m["n_wordless"] * 100 > n * 20, m["n_wordless"] * 100 <= n * 5),
        vote(m["n_marked"] * 100 > n * 10, m["n_marked"] * 100 <= n),
    ]


def base_failed(m: Column) -> Column:
    return (m["n_words"] < 50) | (m["n_repeat_words"] * 100 > m["n_words"] * 50)


@dataclass(frozen=True)
class Model:
    """prior: log odds of good. odds[rule][vote + 1]: what a vote adds to them. like[y][rule][vote + 1]: its probability in class y."""

    prior: float
    odds: tuple[tuple[float, ...], ...]
    like: tuple

    def posterior(self, v: list[Column]) -> Column:
        z = F.lit(self.prior)
        for vote, odds in zip(v, self.odds):
            z = z + F.when(vote == -1, odds[0]).when(vote == 1, odds[2]).otherwise(odds[1])
        return 1 / (1 + F.exp(-z))


def fit(counts: dict[tuple[int, ...], int], rounds: int = 60, smooth: float = 1.0) -> Model:
    """Expectation-maximisation over counts of vote patterns.

    It starts from the votes: one against makes a document doubtful, two make it likely bad. A rule's votes stay
    evidence in the direction that they state: a vote against never raises the odds, a vote for never lowers them.
    """
    n_rules = len(RULES)
    good = {p: (0.95, 0.4, 0.1)[min(2, sum(v < 0 for v in p))] for p in counts}
    prior, odds, like = math.log(4), [(0.0, 0.0, 0.0)] * n_rules, ()
    for _ in range(rounds):
        total = [smooth, 4 * smooth]
        tally = [[[smooth] * 3 for _ in range(n_rules)] for _ in range(2)]
        for p, n in counts.items():
            for y, share in ((1, good[p]), (0, 1 - good[p])):
                total[y] += n * share
                for r, v in enumerate(p):
                    tally[y][r][v + 1] += n * share
        like = tuple(tuple(tuple(x / sum(t) for x in t) for t in tally[y]) for y in range(2))
        prior = math.log(total[1] / total[0])
        odds = []
        for r in range(n_rules):
            o = [math.log(like[1][r][k] / like[0][r][k]) for k in range(3)]
            odds.append((min(o[0], 0.0), o[1], max(o[2], 0.0)))
        for p in counts:
            z = prior + sum(odds[r][v + 1] for r, v in enumerate(p))
            good[p] = 1 / (1 + math.exp(-max(-700.0, min(700.0, z))))
    return Model(prior, tuple(odds), like)


def _pattern_counts(df: DataFrame, names: list[str]) -> dict[tuple[int, ...], int]:
    return {tuple(r[:-1]): r[-1] for r in df.groupBy(*names).agg(F.count("*").alias("n")).collect()}


def rate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, the base counts, base_failed, the votes, posterior (probability of good), kept."""
    names = [f"vote_{r}" for r in RULES]
    m = docs.select(F.col(id_col).alias("doc_id"), measures(F.col(text_col)).alias("m"))
    s = Scratch(docs.sparkSession, "quality-rules")
    held = s.write(m.select("doc_id", "m.*", *(v.cast("int").alias(n) for v, n in zip(votes(F.col("m")), names)), base_failed(F.col("m")).alias("base_failed")), "votes")
    model = fit(_pattern_counts(held, names))
    p = model.posterior([F.col(n) for n in names])
    return held.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", *names, p.alias("posterior"), (~F.col("base_failed") & (p >= 0.5)).alias("kept"))


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs without the rows that the rules reject; all columns stay, and no text is shuffled."""
    m = fresh(docs, "rules")
    # measured twice: verdicts written beside the texts took one more copy of the table on disk
    seen = docs.withColumn(m, measures(F.col(text_col)))
    names = [f"v{k}" for k in range(len(RULES))]
    model = fit(_pattern_counts(seen.select(*(v.alias(n) for v, n in zip(votes(F.col(m)), names))), names))
    return seen.where(~base_failed(F.col(m)) & (model.posterior(votes(F.col(m))) >= 0.5)).drop(m)
