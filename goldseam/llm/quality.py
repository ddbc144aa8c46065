"""Quality rules whose cutoffs come from labelled documents with a bound on false rejections.

Every rule scores a document (higher is worse) and rejects scores above a cutoff. Cutoffs are chosen per
stratum (language) from a fixed grid, on the labelled good documents that pass the base rules. For a cutoff
that rejects k of n such documents, the exact binomial tail P(X <= k) with X ~ B(n, risk) is the p-value
of "it rejects more than ``risk`` of the good documents". Cutoffs are tested from lenient to strict and
testing stops at the first that is not significant, which keeps the error of a whole grid at its level;
the level is shared out over all rules and strata (Bonferroni), and the permitted risk over the rules.
So with probability 1 - ERROR no stratum loses more than RISK of its good documents to the rules.
Where there are too few labels to show that, a rule rejects nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from goldseam.llm.common import SPACE_CLASS, fresh, if_small, staged

#: Good documents that a stratum may lose to all rules together, and the chance that this fails.
RISK = 0.02
ERROR = 0.05

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
_BLANKS = " \t\n\x0b\f\r"
#: Terms of a binomial tail that are summed; what is left beyond is bounded from above.
TAIL_TERMS = 20_000


@dataclass(frozen=True)
class Rule:
    """Rejects documents whose ``score`` (SQL over the features, a whole number) is above a cutoff."""

    name: str
    score: str
    grid: tuple[int, ...]


RULES = (
    Rule("symbols", "n_symbols * 1000 div n_words", (1000, 800, 600, 500, 400, 300, 250, 200, 150, 100)),
    Rule("duplicate_lines", "n_dup_lines * 1000 div n_lines", (950, 900, 800, 700, 600, 500, 400, 300)),
    Rule("repeated_words", "n_repeat_words * 1000 div n_words", (180, 160, 140, 120, 100, 80, 60)),
    Rule("long_words", "word_chars * 100 div n_words", (3000, 2500, 2000, 1500, 1200, 1000)),
    Rule("short_words", "-(word_chars * 100 div n_words)", (-150, -200, -250, -300)),
)

FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def with_features(docs: DataFrame) -> DataFrame:
    """``docs`` (which has no column of these names) with FEATURES and base_failed.

    Words are runs of anything but ASCII white space. A null or empty text has none and fails the base
    rules. n_repeat_words counts the words inside five-word windows that occur at least twice: windows
    are hashed, equal hashes are found by sorting, and overlapping windows count a word once.
    """
    names = docs.columns
    t, w, h, g, s, d, v = (fresh(names, x) for x in ("_t", "_w", "_h", "_g", "_s", "_d", "_v"))
    step = docs.withColumn(t, F.coalesce("text", F.lit("")))
    bare = F.btrim(F.col(t), F.lit(_BLANKS))
    step = step.withColumn(w, F.when(bare == "", F.array().cast("array<string>")).otherwise(
        F.split(bare, SPACE_CLASS + "+")))
    lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(_BLANKS)) != "")
    step = step.withColumns({
        "n_words": F.size(w).cast("long"),
        "word_chars": F.length(F.array_join(w, "")).cast("long"),
        "n_symbols": (F.length(t) - F.length(F.regexp_replace(t, "[#*$%&|<>]", ""))).cast("long"),
        h: F.transform(w, lambda x: F.xxhash64(x)),
        v: F.transform(lines, lambda x: F.xxhash64(x)),
    })
    windows = F.expr(
        f"transform(sequence(0, size({h}) - {WINDOW}), i -> xxhash64("
        + ", ".join(f"{h}[i + {k}]" for k in range(WINDOW)) + "))"
    )
    step = step.withColumns({
        "n_lines": F.size(v).cast("long"),
        "n_dup_lines": (F.size(v) - F.size(F.array_distinct(v))).cast("long"),
        g: F.when(F.size(h) >= WINDOW, windows).otherwise(F.array().cast("array<bigint>")),
    })
    repeats = F.size(F.array_distinct(g)) < F.size(g)
    step = step.withColumn(s, F.when(repeats, F.sort_array(
        F.transform(g, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    step = step.withColumn(d, F.expr(
        f"sort_array(transform(filter({s}, (x, j) -> (j > 0 AND {s}[j - 1].h = x.h)"
        f" OR (j < size({s}) - 1 AND {s}[j + 1].h = x.h)), x -> x.i))"))
    covered = F.expr(
        f"aggregate(zip_with(slice({d}, 2, size({d})), slice({d}, 1, size({d}) - 1),"
        f" (b, a) -> least(b - a, {WINDOW})), {WINDOW}L, (c, x) -> c + x)"
    )
    step = step.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
    failed = (F.col("n_words") < MIN_WORDS) | (
        F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT
    )
    return step.withColumn("base_failed", failed).drop(t, w, h, g, s, d, v)


def _log_gamma(x: Column) -> Column:
    """ln of the gamma function for x > 0: Stirling's series at x + 10, taken back by ten factors."""
    y = x + F.lit(10.0)
    series = 1 / (12 * y) - 1 / (360 * F.pow(y, 3)) + 1 / (1260 * F.pow(y, 5))
    stirling = (y - 0.5) * F.log(y) - y + F.lit(0.9189385332046727) + series
    for i in range(10):
        stirling = stirling - F.log(x + F.lit(float(i)))
    return stirling


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(X <= k) for X ~ B(n, p), given k < n * p: the term at k, and downward its shrinking ratios."""
    a, b = n.cast("double"), k.cast("double")
    top = F.exp(
        _log_gamma(a + 1) - _log_gamma(b + 1) - _log_gamma(a - b + 1)
        + b * F.log(F.lit(p)) + (a - b) * F.log(F.lit(1 - p))
    )
    odds = F.lit((1 - p) / p)
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))

    def add(state: Column, j: Column) -> Column:
        i = b - j.cast("double") + 1
        term = state["term"] * i * odds / (a - i + 1)
        return F.struct(term.alias("term"), (state["total"] + term).alias("total"))

    last = F.least(k, F.lit(TAIL_TERMS).cast("long"))
    steps = F.when(last > 0, F.sequence(F.lit(1).cast("long"), last)).otherwise(
        F.array().cast("array<bigint>"))
    summed = F.aggregate(steps, start, add)
    ratio = (b - last) * odds / (a - b + last + 1)
    beyond = F.when(k > last, summed["term"] * ratio / (1 - ratio)).otherwise(0.0)
    return top * (summed["total"] + beyond)


def stratum(name: str = "lang") -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(name)), F.lit(""))


def learn_cutoffs(features: DataFrame, labels: DataFrame) -> DataFrame:
    """(stratum, <rule> ...): the chosen cutoff of each rule per stratum, null where it rejects nothing.

    ``features`` has doc_id, lang and the features (a written table); ``labels`` has doc_id and
    quality. A document is good if any of its labels says quality 1; null labels say nothing. A null
    language is a stratum of its own. Labelled documents meet their labels on doc_id and are folded
    to one row per stratum before the second shuffle.
    """
    good = labels.where("quality = 1 AND doc_id IS NOT NULL").select("doc_id").distinct()
    holdout = features.where("NOT base_failed").join(good, "doc_id", "left_semi")
    rejected = [
        F.sum(F.expr(f"if({rule.score} > {cut}, 1L, 0L)")).alias(f"k{r}_{c}")
        for r, rule in enumerate(RULES)
        for c, cut in enumerate(rule.grid)
    ]
    counts = staged(
        holdout.groupBy(stratum().alias("stratum")).agg(F.count("*").alias("n"), *rejected),
        "quality-holdout",
    )
    strata = max(counts.count(), 1)
    risk, level = RISK / len(RULES), ERROR / (len(RULES) * strata)
    tests = counts.select("stratum", "n", F.inline(F.array(*[
        F.struct(F.lit(r).alias("rule"), F.lit(c).alias("step"), F.col(f"k{r}_{c}").alias("k"))
        for r, rule in enumerate(RULES) for c in range(len(rule.grid))
    ])))
    passed = F.when(F.col("k") < F.col("n") * risk, binomial_tail(F.col("n"), F.col("k"), risk) <= level)
    first_failure = tests.groupBy("stratum", "rule").agg(
        F.min(F.when(~F.coalesce(passed, F.lit(False)), F.col("step"))).alias("failed"))
    chosen = []
    for r, rule in enumerate(RULES):
        steps = F.coalesce(F.col("failed"), F.lit(len(rule.grid)))
        grid = F.array(*map(F.lit, rule.grid))
        cut = F.when(steps > 0, F.element_at(grid, F.greatest(steps, F.lit(1))))
        chosen.append(F.max(F.when(F.col("rule") == r, cut)).alias(rule.name))
    return staged(first_failure.groupBy("stratum").agg(*chosen), "quality-cutoffs")


def _with_rejections(features: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """``features`` with rejections: how many rules (the base rules count as one) reject the document."""
    key = fresh(features.columns, "_stratum")
    own = cutoffs.select(F.col("stratum").alias(key), *[F.col(r.name).alias(f"_cut_{r.name}") for r in RULES])
    joined = features.withColumn(key, stratum()).join(if_small(own, 80), key, "left")
    rejections = F.col("base_failed").cast("int")
    for rule in RULES:
        above = F.when(~F.col("base_failed"), F.expr(rule.score) > F.col(f"_cut_{rule.name}"))
        rejections = rejections + F.coalesce(above, F.lit(False)).cast("int")
    return joined.withColumn("rejections", rejections).drop(key, *[f"_cut_{r.name}" for r in RULES])


def with_verdicts(features: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """``features`` with kept: the base rules and every rule with a cutoff let the document pass."""
    judged = _with_rejections(features, cutoffs)
    return judged.withColumn("kept", F.col("rejections") == 0).drop("rejections")


def quality_verdicts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, features, base_failed, kept) for every row of ``docs``.

    Repeated rows are judged alike; a null doc_id has no label but is judged; other columns are not
    read. Without labels nothing beyond the base rules is rejected; empty tables give empty results.
    """
    features = staged(
        with_features(docs.select("doc_id", "text", "lang")).drop("text"), "quality-features"
    )
    judged = with_verdicts(features, learn_cutoffs(features, labels))
    return judged.select("doc_id", *FEATURES, "base_failed", "kept")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that the rules keep; cutoffs are learnt from ``docs`` itself.

    Features are written once to learn from and computed once more to judge, so that no text is stored.
    The verdict is one sum over both, as the optimizer would move a condition on the features alone
    below them and so compute them several times.
    """
    features = staged(
        with_features(docs.select("doc_id", "text", "lang")).drop("text"), "quality-features"
    )
    cutoffs = learn_cutoffs(features, labels)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    judged = _with_rejections(with_features(docs.select(row, "text", "lang")), cutoffs)
    return judged.where("rejections = 0").select("_row.*")
