"""Quality rules by weak supervision, in DataFrame functions only.

Every rule votes good (1), bad (-1) or abstains (0). Expectation-maximisation over
the counts of vote patterns (at most 3 to the number of rules, whatever the corpus
holds) estimates how each rule votes on good and on bad text and how common good
text is; a document's posterior probability of being good then decides, in place of
"all rules must pass".

Defined results: a null text has no words and fails; repeated rows are scored alike;
other columns pass through the filter untouched, whatever their names; an empty
table gives no rows. Windows of words are told apart by a 64-bit hash, so two
different windows of one document are confused with probability about 1e-13 even
at a thousand words.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable

#: Words of a repeated window.
WINDOW = 5
SPACE = r"[\x20\x09-\x0D]+"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
SIGNALS = [*COUNTS, "n_lines", "n_distinct", "n_exclaims", "n_capitals", "n_stops"]


def _repeat_words(words: str, windows: str) -> Column:
    """Words covered by windows whose hash occurs twice or more: sort (hash, place), keep equal neighbours, add up the union."""
    at = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    none = F.array(F.lit(None).cast("struct<h:bigint,i:int>"))
    beside = F.arrays_zip(at.alias("own"), F.concat(none, at).alias("before"), F.concat(F.slice(at, 2, F.size(windows)), none).alias("after"))
    same = lambda z, k: F.coalesce(z["own"]["h"] == z[k]["h"], F.lit(False))
    again = F.transform(F.filter(beside, lambda z: same(z, "before") | same(z, "after")), lambda z: z["own"]["i"])
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
    covered = F.aggregate(F.sort_array(again), zero, lambda s, i: F.struct((s["n"] + (i + F.lit(WINDOW) - F.greatest(i, s["end"])).cast("long")).alias("n"), (i + F.lit(WINDOW)).alias("end")))
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("long")).otherwise(covered["n"])


def with_signals(docs: DataFrame, keep: Column) -> DataFrame:
    """``keep`` as ``row``, and one long column for each of SIGNALS."""
    out = docs.select(keep.alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    out = out.withColumn("words", F.filter(F.split("text", SPACE), lambda w: w != ""))
    out = out.withColumn("lines", F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    word = lambda i: F.get(F.col("words"), i)
    hashes = F.transform(F.sequence(F.lit(0), F.size("words") - WINDOW), lambda i: F.xxhash64(*(word(i + k) for k in range(WINDOW))))
    out = out.withColumn("windows", F.when(F.size("words") > WINDOW, hashes).otherwise(F.array().cast("array<bigint>")))
    text_of = F.col("text")
    made = {
        "n_words": F.size("words"),
        "word_chars": F.length(F.array_join("words", "")),
        "n_symbols": F.regexp_count(text_of, F.lit("[#*$%&|<>]")),
        "n_dup_lines": F.size("lines") - F.size(F.array_distinct("lines")),
        "n_repeat_words": _repeat_words("words", "windows"),
        "n_lines": F.size("lines"),
        "n_distinct": F.size(F.array_distinct("words")),
        "n_exclaims": F.regexp_count(text_of, F.lit("!")),
        "n_capitals": F.regexp_count(text_of, F.lit(r"\p{Lu}")),
        "n_stops": F.regexp_count(text_of, F.lit(r"[.?](?=[\x09-\x20]|$)")),
    }
    return out.select("row", *(made[x].cast("long").alias(x) for x in SIGNALS))


def rules() -> dict[str, Column]:
    """The votes, from the signals: 1 good, -1 bad, 0 abstains.

    A missing fault is no merit, so fault rules only condemn or abstain. Each kind of
    fault is seen by two rules: agreement is what the estimate learns from.
    """
    c = {x: F.col(x) for x in SIGNALS}
    bad = lambda x: F.when(x, -1).otherwise(0)
    vote = lambda x, good: F.when(x, -1).when(good, 1).otherwise(0)
    n, chars = c["n_words"], c["word_chars"]
    return {
        "symbols_a_word": bad(c["n_symbols"] * 10 > n * 3),
        "symbols_a_character": bad(c["n_symbols"] * 100 > chars * 3),
        "shouting": bad(c["n_exclaims"] * 10 > n * 3),
        "capitals": bad(c["n_capitals"] * 2 > chars),
        "repeats": bad(c["n_repeat_words"] * 5 > n),
        "variety": bad(c["n_distinct"] * 100 < n * 15),
        "lines": bad(c["n_dup_lines"] * 10 > c["n_lines"] * 3),
        "length": vote(n < 10, n >= 50),
        "word_length": vote((chars < n * 2) | (chars > n * 15), chars.between(n * 3, n * 11)),
        "sentences": vote((c["n_stops"] * 100 < n) & (n >= 50), (c["n_stops"] * 50 >= n) & (c["n_stops"] * 3 <= n)),
    }


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)


#: Where the estimate starts, as shares of votes (bad, abstain, good): a rule condemns
#: few good texts, and each condemns only some of the bad ones.
START = {"good": (0.002, 0.598, 0.4), "bad": (0.25, 0.35, 0.4)}
#: The start also stays in as this share of the evidence, so that the classes keep their meaning.
PRIOR_SHARE = 0.1


def estimate(patterns: dict[tuple[int, ...], int], n_rules: int, rounds: int = 60) -> tuple[float, list[dict[int, float]]]:
    """EM over counts of vote patterns: (log odds of good, for each rule the log odds that each vote adds)."""
    total = sum(patterns.values())
    share = 0.85
    p = {k: [dict(zip((-1, 0, 1), START[k], strict=True)) for _ in range(n_rules)] for k in START}

    def odds() -> tuple[float, list[dict[int, float]]]:
        return math.log(share / (1 - share)), [{v: math.log(p["good"][j][v] / p["bad"][j][v]) for v in (-1, 0, 1)} for j in range(n_rules)]

    for _ in range(rounds if total else 0):
        base, each = odds()
        good = {x: 1 / (1 + math.exp(-max(-500.0, min(500.0, base + sum(each[j][v] for j, v in enumerate(x)))))) for x in patterns}
        mass = sum(good[x] * n for x, n in patterns.items())
        extra = PRIOR_SHARE * total
        share = (mass + extra * 0.85) / (total + extra)
        for k, weight, held in (("good", good.__getitem__, mass), ("bad", lambda x: 1 - good[x], total - mass)):
            for j in range(n_rules):
                for i, v in enumerate((-1, 0, 1)):
                    seen = sum(weight(x) * n for x, n in patterns.items() if x[j] == v)
                    p[k][j][v] = (seen + extra * START[k][i]) / (held + extra)
    return odds()


def fitted(votes: DataFrame) -> Column:
    """The posterior probability of good text, as a Column over the vote columns of ``votes``."""
    names = votes.columns
    counts = {tuple(r)[:-1]: r["count"] for r in votes.groupBy(*names).count().collect()}  # at most 3^rules rows
    base, each = estimate(counts, len(names))
    logit = F.lit(base)
    for name, add in zip(names, each, strict=True):
        logit = logit + F.when(F.col(name) == -1, add[-1]).when(F.col(name) == 1, add[1]).otherwise(add[0])
    return 1 / (1 + F.exp(-logit))


def voted(docs: DataFrame, keep: Column) -> tuple[DataFrame, Column]:
    """``keep`` as ``row``, SIGNALS and votes of every row, worked out once and written; and the posterior over them."""
    votes = {f"vote_{k}": v for k, v in rules().items()}
    made = durable(with_signals(docs, keep).withColumns(votes))
    return made, fitted(made.select(*votes))


def score(docs: DataFrame) -> DataFrame:
    """doc_id, the counts of SIGNALS, base_failed, quality (posterior) and kept of every row."""
    made, quality = voted(docs, F.col("doc_id"))
    return made.select(F.col("row").alias("doc_id"), *SIGNALS, base_failed().alias("base_failed"), quality.alias("quality")).withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= 0.5))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass; each is written once beside its votes and never shuffled."""
    made, quality = voted(docs, F.struct("*"))
    return made.where(~base_failed() & (quality >= 0.5)).select("row.*")
