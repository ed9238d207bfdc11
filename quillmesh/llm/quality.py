"""Quality by weak supervision: rules vote or abstain, and expectation-maximisation weighs them.

Only DataFrame functions run here. The rules' votes are counted by pattern, of which
there are at most three to the power of the rules; every step of the estimation is an
aggregate over that small table.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.words import SPACES, words
from quillmesh.plans.lineage import cut

SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEATED = 50, 50
#: Log odds of bad that a lone bad vote leaves, whatever the other rules say.
MARGIN = 3.0


def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body``."""
    return F.transform(F.array(value), body)[0]


def _repeated_words(w: Column) -> Column:
    """Words of ``w`` inside a three-word window that occurs twice or more.

    Windows are told apart by their hashes; where all differ there is nothing to find.
    Else the hashes are sorted with their places, so equal ones are neighbours.
    """

    def covered(s: Column) -> Column:
        hits = F.filter(s, lambda x, i: F.get(s, i - 1)["h"].eqNullSafe(x["h"]) | F.get(s, i + 1)["h"].eqNullSafe(x["h"]))
        return F.size(F.array_distinct(F.flatten(F.transform(hits, lambda x: F.array(x["p"], x["p"] + 1, x["p"] + 2)))))

    def found(h: Column) -> Column:
        placed = F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p")))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_let(F.sort_array(placed), covered))

    windows = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    return F.when(F.size(w) < 3, F.lit(0)).otherwise(_let(windows, found)).cast("long")


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id and the measures that the rules read.

    ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` and, for the rules,
    ``n_lines, n_upper, n_marks, n_stops``. Null, empty and blank texts measure 0 everywhere.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(F.col("t"), "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    base = docs.select(F.col(id_col), text.alias("t"), words(text).alias("w")).withColumn("lines", lines)
    among = lambda a: F.length("t") - F.length(F.translate("t", a, ""))
    return base.select(
        id_col,
        F.size("w").cast("long").alias("n_words"),
        F.length(F.translate("t", SPACES, "")).cast("long").alias("word_chars"),
        among(SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeated_words(F.col("w")).alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        among("ABCDEFGHIJKLMNOPQRSTUVWXYZ").cast("long").alias("n_upper"),
        among("!?").cast("long").alias("n_marks"),
        among(".").cast("long").alias("n_stops"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, F.lit(-1)).when(good, F.lit(1)).otherwise(F.lit(0))


def rules() -> dict[str, Column]:
    """Each rule votes 1 (good), -1 (bad) or 0 (abstains)."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    per_word = lambda c: F.col(c) / n
    return {
        "length": _vote(F.col("n_words") >= 100, F.lit(False)),
        "word_length": _vote(per_word("word_chars").between(3, 9), (per_word("word_chars") < 2) | (per_word("word_chars") > 15)),
        "symbols": _vote(per_word("n_symbols") < 0.02, per_word("n_symbols") > 0.2),
        "symbol_share": _vote(F.col("n_symbols") < 0.005 * F.col("word_chars"), F.col("n_symbols") > 0.05 * F.col("word_chars")),
        "lines": _vote(F.col("n_dup_lines") <= 0.1 * F.col("n_lines"), F.col("n_dup_lines") > 0.5 * F.col("n_lines")),
        "repeats": _vote(per_word("n_repeat_words") < 0.15, per_word("n_repeat_words") > 0.4),
        "capitals": _vote(F.col("n_upper") <= 0.1 * F.col("word_chars"), F.col("n_upper") > 0.4 * F.col("word_chars")),
        "marks": _vote(per_word("n_marks") < 0.1, per_word("n_marks") > 0.5),
        "sentences": _vote(per_word("n_stops").between(0.01, 0.5), F.lit(False)),
    }


@dataclass
class LabelModel:
    """Prior of good, and for each rule the log ratio of every vote's chance under good and bad."""

    prior: float
    ratio: dict[str, dict[int, float]]

    def heard(self) -> LabelModel:
        """The model with bad votes that each outweigh the prior and all that the other rules may approve."""
        best = {r: max(t.values()) for r, t in self.ratio.items()}
        most = math.log(self.prior / (1 - self.prior)) + sum(best.values())
        return LabelModel(self.prior, {r: {**t, -1: min(t[-1], best[r] - most - MARGIN)} for r, t in self.ratio.items()})

    def posterior(self) -> Column:
        """Probability of good, given the vote columns."""
        logit = F.lit(math.log(self.prior / (1 - self.prior)))
        for name, table in self.ratio.items():
            logit = logit + F.when(F.col(name) == 1, F.lit(table[1])).when(F.col(name) == -1, F.lit(table[-1])).otherwise(F.lit(table[0]))
        return 1 / (1 + F.exp(-logit))


#: Where estimation starts, and what a hundred imagined documents of either kind vote: the chance of each vote.
START = {"good": {1: 0.9, 0: 0.095, -1: 0.005}, "bad": {1: 0.75, 0: 0.05, -1: 0.2}}


def estimate(patterns: DataFrame, names: list[str], rounds: int = 12, prior: float = 0.8, imagined: float = 100.0) -> LabelModel:
    """Expectation-maximisation over vote patterns with their counts ``n``.

    A rule's vote (good, bad or none) depends on the hidden quality only, with chances
    of its own under good and bad. Low quality has many kinds that rarely meet, so
    silence of the other rules must count for little: their chances to stay silent or
    approve are learned for bad documents too. A hundred imagined documents of each
    kind that vote as in ``START`` smooth the estimates. A bad vote never speaks for
    a document, nor a good one against it, and an abstention tells nothing. Of a kind
    that only one rule sees, estimation alone takes the rule for unreliable as the
    imagined documents fade; ``LabelModel.heard``, an option of ``judge``, makes its
    vote count at every size.
    """
    chance = {r: {k: dict(v) for k, v in START.items()} for r in names}

    def model() -> LabelModel:
        ratio = {}
        for r, c in chance.items():
            log = {v: math.log(c["good"][v] / c["bad"][v]) for v in (1, 0, -1)}
            ratio[r] = {1: max(log[1], 0.0), 0: 0.0, -1: min(log[-1], 0.0)}
        return LabelModel(prior, ratio)

    for _ in range(rounds):
        seen = patterns.withColumn("good", model().posterior() * F.col("n")).withColumn("bad", F.col("n") - F.col("good"))
        sums = [F.sum(c).alias(c) for c in ("n", "good", "bad")]
        sums += [F.sum(F.when(F.col(r) == v, F.col(c)).otherwise(0.0)).alias(f"{r}|{c}|{v}") for r in names for c in ("good", "bad") for v in (1, 0, -1)]
        row = seen.agg(*sums).first()
        if not row["n"]:
            break
        prior = min(max((row["good"] + 0.8 * imagined) / (row["n"] + imagined), 0.05), 0.95)
        chance = {r: {c: {v: (row[f"{r}|{c}|{v}"] + imagined * START[c][v]) / (row[c] + imagined) for v in (1, 0, -1)} for c in ("good", "bad")} for r in names}
    return model()


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, floor: bool = True) -> DataFrame:
    """One row a document: id, measures, ``base_failed``, ``posterior`` and ``kept``.

    ``kept``: the base rules hold and the posterior probability of good reaches
    ``threshold``. Without ``floor`` the learned weights alone give the posterior; with it a
    single bad vote keeps it below one half. Votes are weighed on the documents that the base rules let through. Repeated rows are judged each; an empty table gives no rows.
    """
    measured = cut(measures(docs, id_col, text_col))
    votes = rules()
    voted = measured.withColumns({f"vote_{k}": v for k, v in votes.items()})
    names = [f"vote_{k}" for k in votes]
    patterns = cut(voted.where(~base_failed()).groupBy(*names).agg(F.count("*").alias("n")))
    model = estimate(patterns, names)
    model = model.heard() if floor else model
    out = voted.withColumn("base_failed", base_failed()).withColumn("posterior", model.posterior())
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold))
