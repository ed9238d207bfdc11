"""URL filtering by a character language-model ratio behind explicit rules."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.plans.lineage import broadcast_if, cut

#: Rules as (host and path, verdict).
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
#: Longest context in characters, and the alphabet size that unseen characters share evenly.
ORDER, ALPHABET = 5, 256
_LOWER_A_TO_Z = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: What stands before a url and after it in the models, and nowhere else.
START, END = "\x02", "\x03"
#: Scores are binned by this for calibration.
BIN = 0.01


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for a null url or one without ``://``."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), *_LOWER_A_TO_Z)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def matching_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits: its host or a subdomain of it, and a path that starts with its path; else null."""
    out = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: len(r[0])):
        site, _, start = rule.partition("/")
        fits = ((host == site) | host.endswith(f".{site}")) & path.startswith(f"/{start}")
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def grams(url: Column) -> Column:
    """Each character of a url and the end mark, after the ``ORDER`` characters before it; letters fold case."""
    clean = F.translate(F.coalesce(url, F.lit("")), START + END + _LOWER_A_TO_Z[0], "  " + _LOWER_A_TO_Z[1])
    chars = F.split(F.concat(F.lit(START * ORDER), clean, F.lit(END)), "")

    def windows(c: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(c) - ORDER - 1), lambda i: F.concat(*[F.get(c, i + k) for k in range(ORDER + 1)]))

    return F.transform(F.array(chars), windows)[0]


def gram_ratios(counts: DataFrame) -> DataFrame:
    """``(gram, ratio)`` from ``counts(gram, good, bad)``: log probability of its last character as accepted less that as rejected.

    Each model interpolates contexts of length 0 to ``ORDER`` (Witten-Bell): a context
    seen ``n`` times with ``t`` different characters trusts its own counts by ``n``
    parts and the next shorter context by ``t``. Contexts are exact strings; their table
    grows with the urls and is joined by its own keys, an order at a time.
    """
    shorter = None
    for k in range(ORDER + 1):
        level = counts.groupBy(F.right("gram", F.lit(k + 1)).alias("gram")).agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
        context = Window.partitionBy(F.left("gram", F.lit(k)))
        sides = ("good", "bad")
        level = level.withColumns({f"n_{s}": F.sum(s).over(context) for s in sides} | {f"t_{s}": F.greatest(F.sum((F.col(s) > 0).cast("long")).over(context), F.lit(1)) for s in sides})
        if shorter is None:
            level = level.withColumns({f"s_{s}": F.lit(1.0 / ALPHABET) for s in sides})
        else:
            known = shorter.select(F.col("gram").alias("__short"), *[F.col(f"p_{s}").alias(f"s_{s}") for s in sides])
            level = level.join(known, F.right("gram", F.lit(k)) == F.col("__short"))
        shorter = level.select("gram", *[((F.col(s) + F.col(f"t_{s}") * F.col(f"s_{s}")) / (F.col(f"n_{s}") + F.col(f"t_{s}"))).alias(f"p_{s}") for s in sides])
    return shorter.select("gram", (F.log("p_good") - F.log("p_bad")).alias("ratio"))


@dataclass
class UrlModel:
    """``ratios(gram, ratio)`` of every gram of the urls at hand, and the calibrated threshold."""

    ratios: DataFrame
    n_grams: int
    threshold: float = 0.0


def with_ratio(rows: DataFrame, model: UrlModel, key: str, url: str, max_broadcast_rows: int = 500_000) -> DataFrame:
    """``(key, ratio)`` of each row: the mean over the url's characters and end mark of their grams' ratios.

    ``key`` tells the rows apart. The table of grams is broadcast if it is small enough;
    beyond that urls and grams meet by a shuffle.
    """
    each = rows.select(key, F.explode(grams(F.col(url))).alias("gram"))
    return each.join(broadcast_if(model.ratios, model.n_grams, max_broadcast_rows), "gram").groupBy(key).agg(F.avg("ratio").alias("ratio"))


def calibrated(seen: DataFrame) -> float:
    """Where accepted and rejected rows of ``seen(ratio, accepted)`` err alike; 0 with one kind only, or none."""
    bins = seen.groupBy(F.floor(F.col("ratio") / BIN).alias("bin")).agg(F.sum(F.col("accepted").cast("long")).alias("good"), F.sum((~F.col("accepted")).cast("long")).alias("bad"))
    marks = sorted((r["bin"], r["good"], r["bad"]) for r in bins.collect())
    good, bad = sum(m[1] for m in marks), sum(m[2] for m in marks)
    if not good or not bad:
        return 0.0
    lost, passed, best = 0, bad, (1.0, 0)
    for b, g, w in marks:
        best = min(best, (abs(lost / good - passed / bad), b))
        lost, passed = lost + g, passed - w
    return best[1] * BIN


def score(rows: DataFrame, key: str, url: str, accepted: str, max_broadcast_rows: int = 500_000) -> tuple[DataFrame, float]:
    """``(key, ratio)`` of all ``rows``, and the threshold, from those whose ``accepted`` is not null.

    A fifth of the labelled urls (by hash) is kept out of the counts and sets the
    threshold. Every url counts as often as it occurs. Null urls are scored as empty ones
    and teach nothing.
    """
    known = F.col(accepted).isNotNull() & F.col(url).isNotNull()
    held = F.pmod(F.xxhash64(url), F.lit(5)) == 0
    teaches = lambda kind: F.coalesce((known & ~held & (F.col(accepted) == kind)).cast("long"), F.lit(0))
    each = rows.select(teaches(True).alias("good"), teaches(False).alias("bad"), F.explode(grams(F.col(url))).alias("gram"))
    counts = cut(each.groupBy("gram").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")))
    model = UrlModel(cut(gram_ratios(counts)), counts.count())
    scored = cut(with_ratio(rows, model, key, url, max_broadcast_rows))
    model.threshold = calibrated(rows.where(known & held).select(key, F.col(accepted).alias("accepted")).join(scored, key))
    return scored, model.threshold


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, max_broadcast_rows: int = 500_000) -> DataFrame:
    """``(id, host, path, rule, ratio, verdict)`` of every url.

    A matching rule decides; the urls that rules decide teach the two models, which
    decide the rest: ``allow`` at or above the calibrated threshold. Null urls and those without ``://`` have empty host and path and are
    judged by the models; repeated rows are judged each; an empty table gives no
    rows. Other columns of ``pages`` are not read.
    """
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col), F.col(url_col).alias("__url"), host.alias("host"), path.alias("path"), F.monotonically_increasing_id().alias("__row"))
    rows = rows.withColumn("rule", matching_rule(F.col("host"), F.col("path"), rules))
    verdict = F.lit(None).cast("string")
    for rule, said in rules:
        verdict = F.when(F.col("rule") == rule, F.lit(said)).otherwise(verdict)
    rows = cut(rows.withColumn("__said", verdict).withColumn("__accepted", F.col("__said") == "allow"))
    ratios, threshold = score(rows, "__row", "__url", "__accepted", max_broadcast_rows)
    judged = rows.join(ratios, "__row", "left")
    by_model = F.when(F.col("ratio") >= threshold, F.lit("allow")).otherwise(F.lit("block"))
    return judged.select(id_col, "host", "path", "rule", "ratio", F.coalesce("__said", by_model).alias("verdict"))
