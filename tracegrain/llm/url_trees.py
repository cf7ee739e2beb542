"""URL filters: longest-prefix rules, and gradient-boosted trees on lexical features for what no rule fits.

The trees learn from the URLs that a rule labels. Features come from the URL alone: lengths, depth, digit ratio, entropy of
characters, numbers of parameters, hyphens and labels, and the smoothed share of blocked URLs among labelled ones
with the same host suffix (its last two labels, and its top label). A labelled URL's shares are taken over the other folds
(``FOLDS``, by a hash of the host), so that its own label and its host's are not among what it learns from. Shares are counted over
all labelled rows; the trees are fitted on about ``SAMPLE`` of them at most, those with the smallest hashes of URL and page.

A null URL or one without ``://`` has an empty host and path, fits no rule and is judged by the trees; ties between rules of equal
length go to the first in order; very long URLs are read whole; rows that repeat, share an id or have none are judged each by its
own URL; if the rules label nothing all is allowed, and if they give one verdict only that one is the model's; an empty table
gives no rows; other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracegrain.llm.shared import materialise

FOLDS = 5
#: Labelled rows that the trees are fitted on.
SAMPLE = 200_000
NUMBERS = ["url_length", "host_length", "path_length", "labels", "depth", "digits", "entropy", "params", "hyphens", "has_www", "path_digits", "has_fragment", "https", "suffix_rate", "top_rate"]


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL."""
    rest = F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def match_rules(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null without one."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, text in sorted(rules, key=lambda r: len(r[1])):
        own, slash, rest = text.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def _share(text: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(text, pattern, "")) / F.greatest(F.length(text), F.lit(1))


def lexical(pages: DataFrame) -> DataFrame:
    """Adds the features that need no other rows, and the suffixes."""
    url = F.coalesce("url", F.lit(""))
    chars = F.filter(F.split(url, ""), lambda c: c != "")
    n = F.greatest(F.size(chars), F.lit(1))
    share = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda x: x == c)) / n)
    labels = F.split("host", r"\.")
    return pages.withColumns(
        {
            "url_length": F.length(url), "host_length": F.length("host"), "path_length": F.length("path"), "labels": F.size(labels), "depth": F.size(F.split("path", "/")), "digits": _share(url, "[^0-9]"),
            "entropy": F.coalesce(F.aggregate(share, F.lit(0.0), lambda a, p: a - p * F.log2(p)), F.lit(0.0)), "params": F.size(F.split(F.regexp_extract(url, r"\?([^#]*)", 1), "[&;]")), "hyphens": F.length(F.regexp_replace("host", "[^-]", "")),
            "has_www": F.col("host").startswith("www.").cast("int"), "path_digits": _share(F.col("path"), "[^0-9]"), "has_fragment": url.contains("#").cast("int"), "https": url.startswith("https").cast("int"),
            "top": F.element_at(labels, -1), "suffix": F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), "."),
        }
    )


def _rates(rows: DataFrame, key: str, name: str, prior: float, weight: float = 20.0) -> DataFrame:
    """The share of blocked rows for each suffix: over all folds but one for the labelled rows of that one, over all for the others (fold -1)."""
    by_fold = rows.where("fold >= 0").groupBy(key, "fold").agg(F.sum("label").alias("blocked"), F.count("*").alias("n"))
    whole = by_fold.groupBy(key).agg(F.sum("blocked").alias("all_blocked"), F.sum("n").alias("all_n"), F.collect_list(F.struct("fold", "blocked", "n")).alias("parts"))
    # At most one part for each fold, and nothing taken away for fold -1.
    none = F.struct(F.lit(-1).cast("long").alias("fold"), F.lit(0.0).alias("blocked"), F.lit(0).cast("long").alias("n"))
    each = whole.withColumn("part", F.explode(F.concat("parts", F.array(none))))
    rate = (F.col("all_blocked") - F.col("part.blocked") + weight * prior) / (F.col("all_n") - F.col("part.n") + weight)
    return each.select(key, "part.fold", rate.alias(name))


def prepare(pages: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """Each page with host, path, rule, label (1 block, 0 allow, null without a rule), fold and lexical features, as a table."""
    host, path = split_url(F.col("url"))
    base = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    rule, said = match_rules(F.col("host"), F.col("path"), rules)
    rows = base.withColumns({"rule": rule, "said": said, "at": F.pmod(F.xxhash64("url", "page_id"), F.lit(1 << 40))})
    label = F.when(F.col("said") == "block", 1.0).when(F.col("said") == "allow", 0.0)
    fold = F.when(F.col("said").isNull(), F.lit(-1)).otherwise(F.pmod(F.xxhash64("host"), F.lit(FOLDS))).cast("long")
    return materialise(lexical(rows).withColumns({"label": label, "fold": fold}).drop("url"), "url-features")


def fit(rows: DataFrame, trees: int = 20, depth: int = 4, sample: int = SAMPLE):
    """Learn from prepared rows; a function that adds ``chance`` of block to prepared rows, or None if they hold no two labels."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    known = rows.agg(F.count("label").alias("n"), F.coalesce(F.sum("label"), F.lit(0.0)).alias("blocked")).first()
    if known.blocked in (0.0, float(known.n)):
        return None
    prior = known.blocked / known.n
    rates = {key: materialise(_rates(rows, key, name, prior), name) for key, name in (("suffix", "suffix_rate"), ("top", "top_rate"))}

    def featured(rows: DataFrame) -> DataFrame:
        for key, table in rates.items():
            rows = rows.join(table, [key, "fold"], "left").fillna({f"{key}_rate": prior})
        return VectorAssembler(inputCols=NUMBERS, outputCol="features").transform(rows)

    some = rows.where(F.col("label").isNotNull() & (F.col("at") < F.lit(min(1.0, sample / known.n)) * (1 << 40)))
    learned = materialise(featured(some).select("features", "label"), "url-sample")
    model = GBTClassifier(labelCol="label", maxIter=trees, maxDepth=depth, stepSize=0.2, seed=7, checkpointInterval=-1, maxBins=64).fit(learned)
    return lambda rows: model.transform(featured(rows)).withColumn("chance", vector_to_array(F.col("probability"))[1])


def judge(pages: DataFrame, rules: list[tuple[str, str]], trees: int = 20, depth: int = 4) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of each page; score is the trees' chance of block, null where a rule decides."""
    rows = prepare(pages, rules)
    score = fit(rows, trees, depth)
    out = ["page_id", "host", "path", "rule"]
    if score is None:
        one = F.when(F.lit(rows.where("label = 1").limit(1).count() > 0), "block").otherwise("allow")
        return rows.select(*out, F.coalesce("said", one).alias("verdict"), F.lit(None).cast("double").alias("score"))
    verdict = F.coalesce("said", F.when(F.col("chance") > 0.5, "block").otherwise("allow"))
    return score(rows).select(*out, verdict.alias("verdict"), F.when(F.col("rule").isNull(), F.col("chance")).alias("score"))
