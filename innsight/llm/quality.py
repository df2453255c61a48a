"""Document quality by weak supervision: rules vote or abstain, expectation-maximisation over the
vote patterns estimates how each rule votes on good and on bad documents, and the posterior
probability of good decides. Native expressions only.

One pass computes the text statistics and the votes and stores them (the expensive part runs once).
The patterns of votes are counted over all documents with map-side partial sums: there are at most
3^len(RULES) of them however large the corpus, so their counts go to the driver, where EM runs to
convergence. The fitted model is a sum of per-rule log odds, applied as a plain column expression.

Defined results: null or empty text has no words; it fails the base rules. Repeated rows get equal
verdicts. Columns named like an output are replaced; an empty table gives an empty result (the
model then has its starting values).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from innsight.llm.common import quoted, stored

WORD_BREAK = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "[#*$%&|<>]"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

# Frequent function words of English, German, French and Spanish, in lower case (fixed values).
STOP_WORDS = (
    "the of and to in a is that it for was on are as with his they at be this have from or by not but what all were "
    "we when your can an which there their if will der die das und ist in zu den von mit für auf nicht ein eine sich "
    "des dem im auch es als an le la les de des et un une du est que qui dans pour par sur pas en au avec il el los "
    "las y una por para con su del se lo como más o").split()

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
         "n_lines", "n_distinct_words", "n_stop_words", "n_capitals")

GOOD, BAD, ABSTAIN = 1, 0, -1


def _ratio(a: str, b: str) -> Column:
    return F.col(a) / F.greatest(F.col(b), F.lit(1))


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, F.lit(BAD)).when(good, F.lit(GOOD)).otherwise(F.lit(ABSTAIN))


def rules() -> dict[str, Column]:
    """Rule name → vote. Ratios between the two bounds abstain."""
    return {
        "length": _vote(F.col("n_words") < MIN_WORDS, F.col("n_words") >= 100),
        "symbols": _vote(_ratio("n_symbols", "n_words") > 0.2, _ratio("n_symbols", "n_words") < 0.02),
        "repeats": _vote(_ratio("n_repeat_words", "n_words") > 0.4, _ratio("n_repeat_words", "n_words") < 0.2),
        "capitals": _vote(_ratio("n_capitals", "n_words") > 0.3, _ratio("n_capitals", "n_words") < 0.05),
        "stop_words": _vote(_ratio("n_stop_words", "n_words") < 0.06, _ratio("n_stop_words", "n_words") > 0.12),
        "vocabulary": _vote(_ratio("n_distinct_words", "n_words") < 0.15, _ratio("n_distinct_words", "n_words") > 0.3),
        "lines": _vote(_ratio("n_dup_lines", "n_lines") > 0.4, _ratio("n_dup_lines", "n_lines") < 0.1),
        "word_length": _vote((_ratio("word_chars", "n_words") < 2.5) | (_ratio("word_chars", "n_words") > 14),
                             _ratio("word_chars", "n_words").between(3.5, 10)),
    }


def with_stats(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` and the text statistics. Three-word windows are compared by their 64-bit hashes; they
    are found by sorting (hash, position) within the row, so a long text costs n log n."""
    kept = [c for c in df.columns if c.lower() not in STATS and c != text]
    out = df.select(*[quoted(c) for c in kept], quoted(text).alias("__text"),
                    F.coalesce(quoted(text), F.lit("")).alias("__t"))
    out = out.withColumn("__w", F.array_remove(F.split("__t", WORD_BREAK), ""))
    out = out.withColumn("__l", F.filter(F.split("__t", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")))
    out = out.withColumns({
        "n_words": F.size("__w").cast("long"),
        "word_chars": F.char_length(F.array_join("__w", "")).cast("long"),
        "n_symbols": F.regexp_count("__t", F.lit(SYMBOLS)).cast("long"),
        "n_dup_lines": (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long"),
        "n_lines": F.size("__l").cast("long"),
        "n_distinct_words": F.size(F.array_distinct("__w")).cast("long"),
        "n_stop_words": F.size(F.filter("__w", lambda x: x.isin(STOP_WORDS))).cast("long"),
        "n_capitals": F.regexp_count("__t", F.lit("\\p{Lu}{2,}")).cast("long"),
        "__s": F.expr("array_sort(transform(if(size(__w) < 3, array(), sequence(0, size(__w) - 3)), "
                      "i -> struct(xxhash64(__w[i], __w[i + 1], __w[i + 2]) AS h, i AS p)))"),
    })
    out = out.withColumn("__p", F.expr(
        "array_sort(transform(filter(__s, (x, i) -> x.h <=> get(__s, i - 1).h OR x.h <=> get(__s, i + 1).h), x -> x.p))"))
    # a window covers three words, less where the next one found starts earlier
    out = out.withColumn("n_repeat_words", F.expr(
        "aggregate(transform(__p, (p, i) -> least(3, get(__p, i + 1) - p)), 0L, (a, b) -> a + b)"))
    return out.select(*[quoted(c) for c in kept], F.col("__text").alias(text), *STATS)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


@dataclass(frozen=True)
class LabelModel:
    """Prior of good, and per rule its accuracies where it votes: P(votes good | good) and
    P(votes bad | bad). An abstention says nothing about the document."""
    prior: float
    right: dict[str, tuple[float, float]]

    def weights(self, rule: str) -> dict[int, float]:
        """Vote → log odds of good."""
        good, bad = self.right[rule]
        return {GOOD: math.log(good / (1 - bad)), BAD: math.log((1 - good) / bad)}

    def log_odds(self, votes: dict[str, int]) -> float:
        return math.log(self.prior / (1 - self.prior)) + sum(self.weights(r).get(v, 0.0) for r, v in votes.items())

    def column(self) -> Column:
        """The posterior probability of good, from the vote columns."""
        odds = F.lit(math.log(self.prior / (1 - self.prior)))
        for rule in self.right:
            weight, vote = self.weights(rule), F.col(f"vote_{rule}")
            odds = odds + F.when(vote == GOOD, weight[GOOD]).when(vote == BAD, weight[BAD]).otherwise(0.0)
        return 1 / (1 + F.exp(-odds))


def fit(patterns: list[tuple[tuple[int, ...], int]], names: list[str], steps: int = 200) -> LabelModel:
    """EM, started from a weighted majority of the votes. One pseudo-count per cell keeps every rate
    inside (0, 1); a rule never gets the opposite sign of what it says: where its good (bad) votes
    turn out less frequent among good (bad) documents, its two rates are set to say nothing."""
    total = sum(n for _, n in patterns)
    prior, right = 0.8, {name: (0.9, 0.6) for name in names}
    if not total:
        return LabelModel(prior, right)
    post = []
    for votes, _ in patterns:
        good, bad = sum(v == GOOD for v in votes), sum(v == BAD for v in votes)
        post.append(1 / (1 + math.exp(3 * bad - good)))  # a bad vote is the rarer one and starts with more weight
    for _ in range(steps):
        prior = (sum(p * n for p, (_, n) in zip(post, patterns)) + 1) / (total + 2)
        for j, name in enumerate(names):
            seen = {(v, c): 1.0 for v in (GOOD, BAD) for c in (GOOD, BAD)}
            for p, (votes, n) in zip(post, patterns):
                if votes[j] != ABSTAIN:
                    seen[votes[j], GOOD] += p * n
                    seen[votes[j], BAD] += (1 - p) * n
            good = seen[GOOD, GOOD] / (seen[GOOD, GOOD] + seen[BAD, GOOD])
            bad = seen[BAD, BAD] / (seen[BAD, BAD] + seen[GOOD, BAD])
            right[name] = (good, bad) if good + bad > 1 else (0.5, 0.5)
        model = LabelModel(prior, dict(right))
        new = [1 / (1 + math.exp(-model.log_odds(dict(zip(names, votes))))) for votes, _ in patterns]
        moved, post = max(abs(a - b) for a, b in zip(new, post)), new
        if moved < 1e-9:
            break
    return model


def score(df: DataFrame, text: str = "text", keep_text: bool = True) -> tuple[DataFrame, LabelModel]:
    """``df`` with the statistics, the votes (``vote_<rule>``), ``base_failed``, ``quality`` (posterior)
    and ``kept``; and the fitted model. The scored rows are stored in the shared folder."""
    votes = rules()
    made = {"base_failed", "quality", "kept", *(f"vote_{r}" for r in votes)}
    stats = with_stats(df.select(*[quoted(c) for c in df.columns if c.lower() not in made]), text)
    if not keep_text:
        stats = stats.drop(text)
    rows = stored(stats.withColumns({**{f"vote_{r}": v for r, v in votes.items()}, "base_failed": base_failed()}),
                  "quality")
    names = list(votes)
    counted = rows.groupBy(*[f"vote_{r}" for r in names]).count().collect()  # at most 3^len(names) rows
    model = fit(sorted((tuple(r[:-1]), r[-1]) for r in counted), names)
    scored = rows.withColumn("quality", model.column())
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= 0.5)), model


def filter_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the base rules or the posterior reject go."""
    private = {c: f"__c{i}" for i, c in enumerate(docs.columns)}  # no column is taken for an output
    text = next(n for c, n in private.items() if c.lower() == "text")
    scored, _ = score(docs.select(*[quoted(c).alias(n) for c, n in private.items()]), text)
    return scored.filter("kept").select(*[F.col(n).alias(c) for c, n in private.items()])
