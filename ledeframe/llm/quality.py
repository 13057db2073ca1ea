"""Quality rules as weak supervision, with built-in functions only.

Each rule looks at one measured share of a document and votes good (1), bad (-1) or
abstains (0). Expectation-maximisation over the vote patterns estimates, for each
rule, how often it is right on good and on bad documents, and how common good
documents are; a document's quality is its posterior probability of being good.
There are at most 3^rules patterns whatever the number of documents, so a round is
one small aggregate and only its few parameters come to the driver.

Counts inside a text are folds over its own arrays: the only shuffle is the pattern
count, aggregated before it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledeframe.llm.common import WORD, cut_lineage, words_of

SYMBOLS = "#*$%&|<>"
REPEAT_WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED = 30  # per cent of the words

GOOD_LEAST = 0.998

# Rule: share of the document it looks at, (good below, bad from) - in between it abstains.
RULES = {
    "symbols": ("n_symbols / n_words", 0.05, 0.25),
    "repeats": ("n_repeat_words / n_words", 0.05, 0.25),
    "lines": ("n_dup_lines / greatest(n_lines, 1)", 0.15, 0.4),
    "capitals": ("n_capitals / greatest(word_chars, 1)", 0.15, 0.4),
    "shouting": ("n_shouts / n_words", 0.05, 0.4),
    "digits": ("n_digits / greatest(word_chars, 1)", 0.15, 0.4),
    "word_size": ("abs(word_chars / n_words - 6)", 3.0, 5.0),
}


def _length_without(text: Column, other_than: str) -> Column:
    return F.length(F.regexp_replace(text, f"[^{other_than}]+", "")).cast("long")


def _repeated_words(words: Column) -> Column:
    """Words in windows of 8 that occur twice or more in the array."""
    window = REPEAT_WINDOW
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    starts = F.sequence(F.lit(0), F.size(words) - window)
    get = lambda a, i: F.get(a, i)
    bind = lambda value, body: F.get(F.transform(F.array(value), body), F.lit(0))
    windows = bind(hashes, lambda hs: F.transform(starts, lambda i: F.xxhash64(F.slice(hs, i + 1, window))))

    def covered(ws):
        sorted_ = F.array_sort(F.transform(ws, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twin = lambda s, k: F.coalesce(get(s, k - 1)["h"] == get(s, k)["h"], F.lit(False)) | F.coalesce(get(s, k + 1)["h"] == get(s, k)["h"], F.lit(False))
        twins = lambda s: F.filter(F.transform(s, lambda x, k: F.when(twin(s, k), x["i"])), lambda i: i.isNotNull())
        total = F.aggregate(
            F.array_sort(bind(sorted_, twins)),
            F.struct(F.lit(-window).alias("last"), F.lit(0).cast("long").alias("sum")),
            lambda a, i: F.struct(i.alias("last"), (a["sum"] + F.least(F.lit(window), i - a["last"])).alias("sum")),
            lambda a: a["sum"],
        )
        return F.when(F.size(F.array_distinct(ws)) == F.size(ws), F.lit(0).cast("long")).otherwise(total)

    return F.when(F.size(words) < window, F.lit(0).cast("long")).otherwise(bind(windows, covered))


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and its counts: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines,
    n_capitals, n_shouts, n_digits. A null text counts as empty: all zero."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    split = docs.select(
        F.col(id_col).alias("doc_id"),
        text.alias("_text"),
        words_of(text).alias("_words"),
        F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD)).alias("_lines"),
    )
    return split.select(
        "doc_id",
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        _length_without(F.col("_text"), "#*$%&|<>").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        _repeated_words(F.col("_words")).alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        _length_without(F.col("_text"), "A-Z").alias("n_capitals"),
        _length_without(F.col("_text"), "!?").alias("n_shouts"),
        _length_without(F.col("_text"), "0-9").alias("n_digits"),
    )


def vote(measured: DataFrame) -> DataFrame:
    """``measured`` with one int column vote_<rule> each; a document without words gets abstentions."""
    for name, (share, good, bad) in RULES.items():
        x = F.expr(share)
        ballot = F.when(F.col("n_words") == 0, 0).when(x < good, 1).when(x >= bad, -1).otherwise(0)
        measured = measured.withColumn(f"vote_{name}", ballot)
    return measured


def log_odds(params: dict[str, tuple[float, float]], prior: float) -> Column:
    """Log odds of good, given each rule's rates of being right on good and on bad documents."""
    total = F.lit(math.log(prior / (1 - prior)))
    for name, (on_good, on_bad) in params.items():
        v = F.col(f"vote_{name}")
        total = total + F.when(v == 1, math.log(on_good / (1 - on_bad))).when(v == -1, math.log((1 - on_good) / on_bad)).otherwise(0.0)
    return total


def fit_rates(votes: DataFrame, rounds: int = 15) -> tuple[dict[str, tuple[float, float]], float]:
    """Expectation-maximisation over vote patterns: {rule: (right on good, right on bad)} and the share of good.

    It starts from rules that hardly ever fail a good document but see only one bad
    document in five, with one document in ten bad: a junk document fails one or two
    rules and passes the others. Rates are smoothed by one vote of each kind and stay
    in (0, 1). As a rule votes bad only where clean text hardly comes, its rate of
    being right on good documents is held at ``GOOD_LEAST`` or more; without that
    the likelihood may count all junk that one rule alone sees as good. No documents
    leave the start values.
    """
    names = list(RULES)
    params, prior = {n: (0.999, 0.2) for n in names}, 0.9
    # At most 3^rules rows: one partition, so that a round is one small task.
    patterns = cut_lineage(votes.groupBy(*[f"vote_{n}" for n in names]).agg(F.count(F.lit(1)).alias("n")).repartition(1))
    for _ in range(rounds):
        good = 1 / (1 + F.exp(-log_odds(params, prior)))
        p = patterns.withColumn("_good", F.col("n") * good).withColumn("_bad", F.col("n") - F.col("_good"))
        sums = [F.sum("n").alias("n"), F.sum("_good").alias("good")]
        for n in names:
            for side in ("good", "bad"):
                for value, word in ((1, "up"), (-1, "down")):
                    sums.append(F.sum(F.when(F.col(f"vote_{n}") == value, F.col(f"_{side}")).otherwise(0.0)).alias(f"{n}_{side}_{word}"))
        row = p.agg(*sums).first()
        if not row["n"]:
            break
        prior = (row["good"] + 1) / (row["n"] + 2)
        right = lambda yes, no: (yes + 1) / (yes + no + 2)
        params = {n: (max(GOOD_LEAST, min(1 - 1e-6, right(row[f"{n}_good_up"], row[f"{n}_good_down"]))), right(row[f"{n}_bad_down"], row[f"{n}_bad_up"])) for n in names}
    return params, prior


def quality_verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """One row per row of ``docs``: doc_id, the counts, base_failed, quality (posterior, 0 to 1) and kept.

    base_failed: under 20 words, or over 30 % of the words in repeated windows. kept:
    not base_failed and quality at least ``least``. Repeated rows count as often as
    they occur and get equal verdicts; a text without words fails.
    """
    votes = cut_lineage(vote(measure(docs, id_col, text_col)))
    params, prior = fit_rates(votes)
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    scored = votes.withColumn("base_failed", failed).withColumn("quality", 1 / (1 + F.exp(-log_odds(params, prior))))
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= least))
