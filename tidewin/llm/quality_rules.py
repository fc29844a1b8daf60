r"""Risk-controlled quality rules: cutoffs certified on labelled holdouts by exact binomial bounds.

Every rule is a ratio of text counts with a fixed grid of cutoffs, written down before any label is read.
In each stratum (language), a cutoff is certified if, at a false-rejection rate of alpha, so few rejected
good documents as were seen would have a probability of at most delta / (number of tests): the exact
(Clopper-Pearson) bound, with Bonferroni's correction over strata x rules x cutoffs. As all tests hold at
once, the choice among certified cutoffs may look at the labels: the one whose rejected bad documents
most exceed `cost` times its rejected good ones, and of equals the mildest. The rules' alphas add up to the
stated risk, so all rules together falsely reject at most `risk` of a stratum with confidence
1 - delta. A stratum without enough labels certifies nothing and keeps its documents.

Words are runs of bytes other than \x20 and \x09-\x0D. Everything is DataFrame functions; the counts are
made inside each row, so no text is exploded or shuffled. Repeated windows are found among sorted numbers, a
window's hash above its position, and equal neighbours are compared word by word; a text in which different windows
share a hash is sorted by the words themselves, so counts are exact.

Defined cases: a null text has no words and fails the base rule; a null lang is a stratum of its own;
labels that are null or name no document are ignored; repeated document rows give repeated results, and
repeated label rows count once, as good if any of them says so; empty tables give empty results or no
cutoffs; columns other than the named ones are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .support import read, stage

RISK = 0.02
DELTA = 0.05
COST = 4.0
#: Beyond so many strata the threshold table is joined by a shuffle instead of being broadcast.
BROADCAST_STRATA = 10_000
SPACES = "\t\n\x0b\x0c\r"

#: name -> (numerator, denominator, cutoffs from mild to strict): a document is rejected above the cutoff.
RULES = {
    "symbols": ("n_symbols", "n_words", (2.5, 2.0, 1.5, 1.0, 0.75, 0.5, 0.3, 0.2, 0.1, 0.05)),
    "dup_lines": ("n_dup_lines", "n_words", (0.2, 0.1, 0.05, 0.03, 0.02, 0.01)),
    "repeats": ("n_repeat_words", "n_words", (0.45, 0.4, 0.35, 0.3, 0.25, 0.2)),
    "long_words": ("word_chars", "n_words", (20.0, 15.0, 12.0, 10.0, 9.0, 8.0)),
}


#: Positions take the low bits of a key, hashes the others.
_PLACES = (1 << 24) - 1
_KEYS = f"transform(sequence(0, size(_w) - 3), i -> (xxhash64(_w[i], _w[i + 1], _w[i + 2]) & ~{_PLACES}L) | i)"
_SAME = "_w[{a}] = _w[{b}] and _w[{a} + 1] = _w[{b} + 1] and _w[{a} + 2] = _w[{b} + 2]"
_AT = [f"cast({x} & {_PLACES}L as int)" for x in "ab"]


def _neighbours(array: str, pair: str) -> str:
    """Of each two neighbours (a, b) of a sorted array the pair, where it isn't null."""
    rest = f"greatest(size({array}) - 1, 0)"
    return f"filter(zip_with(slice({array}, 1, {rest}), slice({array}, 2, {rest}), (a, b) -> {pair}), x -> x is not null)"


#: Positions of windows that are equal, in pairs; (-1, -1) where two hashes are equal and the words are not.
_TWINS = _neighbours("_k", f"if((a ^ b) & ~{_PLACES}L <> 0, null, if({_SAME.format(a=_AT[0], b=_AT[1])}, array({_AT[0]}, {_AT[1]}), array(-1, -1)))")
#: The same, by sorting the words.
_EXACT = _neighbours("sort_array(transform(sequence(0, size(_w) - 3), i -> named_struct('t', concat_ws(' ', _w[i], _w[i + 1], _w[i + 2]), 'i', i)))", "if(a.t = b.t, array(a.i, b.i), null)")


def _counted(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def text_counts(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words (longs)."""
    plain = F.translate("_text", SPACES, " " * len(SPACES))
    step = docs.select(*keep, _counted(F.col(text_col)).alias("_text"))
    step = step.select(
        *keep,
        F.array_remove(F.split(plain, " "), "").alias("_w"),
        F.length(F.translate("_text", " " + SPACES, "")).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(F.translate("_text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        F.filter(F.split("_text", "\n"), lambda line: F.length(F.translate(line, " " + SPACES, "")) > 0).alias("_lines"),
    )
    step = step.select(
        *keep, "word_chars", "n_symbols",
        F.size("_w").cast("long").alias("n_words"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        "_w", F.expr(f"if(size(_w) < 4, cast(array() as array<bigint>), sort_array({_KEYS}))").alias("_k"),
    )
    step = step.select(*keep, "word_chars", "n_symbols", "n_words", "n_dup_lines", "_w", F.expr(_TWINS).alias("_t"))
    step = step.select(*keep, "word_chars", "n_symbols", "n_words", "n_dup_lines", F.expr(f"sort_array(array_distinct(flatten(if(size(_w) > {_PLACES + 1} or exists(_t, x -> x[0] < 0), {_EXACT}, _t))))").alias("_p"))
    gaps = "aggregate(zip_with(slice(_p, 1, size(_p) - 1), slice(_p, 2, size(_p) - 1), (a, b) -> least(b - a, 3)), 3, (n, x) -> n + x)"
    return step.select(*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", F.expr(f"cast(if(size(_p) = 0, 0, {gaps}) as long)").alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _ratio(top: str, bottom: str) -> Column:
    return F.coalesce(F.try_divide(F.col(top).cast("double"), F.col(bottom).cast("double")), F.lit(0.0))


def most_allowed(n: Column, alpha: float, level: Column) -> Column:
    """The largest k with P(X <= k) <= level for X binomial (n, alpha), or -1: an exact sum in logarithms,
    which ends long before n since only k below n * alpha can qualify."""
    odds = F.log(F.lit(alpha / (1 - alpha)))
    start = F.struct((n * F.log1p(F.lit(-alpha))).alias("term"), (n * F.log1p(F.lit(-alpha))).alias("total"), F.lit(-1).cast("long").alias("k"))

    def step(acc: Column, i: Column) -> Column:
        # At i, `total` is ln P(X <= i) and k the last index that qualified before it.
        k = F.when((acc["k"] == i - 1) & (acc["total"] <= F.log(level)), i).otherwise(acc["k"])
        term = F.when(i < n, acc["term"] + F.log((n - i).cast("double")) - F.log((i + 1).cast("double")) + odds).otherwise(F.lit(-1e300))
        high = F.greatest(acc["total"], term)
        return F.struct(term.alias("term"), (high + F.log(F.exp(acc["total"] - high) + F.exp(term - high))).alias("total"), k.cast("long").alias("k"))

    return F.aggregate(F.sequence(F.lit(0).cast("long"), F.ceil(n * alpha).cast("long")), start, step, lambda acc: acc["k"])


def certify(counts: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA, cost: float = COST, stratum: str = "stratum") -> DataFrame:
    """stratum, and for each rule its certified cutoff or null. `counts` holds doc_id, stratum and counts."""
    alpha = risk / len(RULES)
    grid = sum(len(cutoffs) for _, _, cutoffs in RULES.values())
    truth = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.max("quality") > 0).alias("good"))
    held = counts.where(~base_failed()).join(truth, "doc_id")
    good = F.col("good")
    sums = [F.sum(good.cast("long")).alias("n_good")]
    for rule, (top, bottom, cutoffs) in RULES.items():
        for c, cutoff in enumerate(cutoffs):
            over = _ratio(top, bottom) > cutoff
            sums += [F.count_if(over & good).alias(f"{rule}_{c}_good"), F.count_if(over & ~good).alias(f"{rule}_{c}_bad")]
    seen = held.groupBy(stratum).agg(*sums)
    tests = [
        F.struct(F.lit(rule).alias("rule"), F.lit(-c).alias("mild"), F.lit(cutoff).alias("cutoff"), F.col(f"{rule}_{c}_good").alias("lost"), F.col(f"{rule}_{c}_bad").alias("caught"))
        for rule, (_, _, cutoffs) in RULES.items()
        for c, cutoff in enumerate(cutoffs)
    ]
    strata = seen.select(F.count(F.lit(1)).alias("strata"))
    level = F.lit(delta) / (F.col("strata") * grid)
    # `strata` is a single aggregated row, so this join adds a column and no rows.
    tried = seen.crossJoin(F.broadcast(strata)).withColumn("allowed", most_allowed(F.col("n_good"), alpha, level)).select(stratum, "allowed", F.explode(F.array(*tests)).alias("t"))
    gain = F.col("t.caught") - F.lit(cost) * F.col("t.lost")
    passed = tried.where((F.col("t.lost") <= F.col("allowed")) & (gain > 0))
    best = passed.groupBy(stratum, F.col("t.rule").alias("rule")).agg(F.max(F.struct(gain.alias("gain"), F.col("t.mild"), F.col("t.cutoff"))).alias("m"))
    return best.groupBy(stratum).agg(*[F.max(F.when(F.col("rule") == rule, F.col("m.cutoff"))).alias(f"{rule}_cutoff") for rule in RULES])


def apply_cutoffs(counts: DataFrame, cutoffs: DataFrame, stratum: str = "stratum") -> DataFrame:
    """counts with base_failed and kept."""
    cutoffs = cutoffs.withColumnRenamed(stratum, "_at")
    side = F.broadcast(cutoffs) if cutoffs.count() <= BROADCAST_STRATA else cutoffs
    joined = counts.join(side, F.col(stratum).eqNullSafe(F.col("_at")), "left")
    rejected = F.lit(False)
    for rule, (top, bottom, _) in RULES.items():
        rejected = rejected | F.coalesce(_ratio(top, bottom) > F.col(f"{rule}_cutoff"), F.lit(False))
    return joined.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~rejected).drop("_at", *[f"{r}_cutoff" for r in RULES])


def quality_filter(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **how) -> DataFrame:
    """doc_id, stratum, the five counts, base_failed and kept for every document."""
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("stratum"))
    counts = stage(text_counts(named, keep=("doc_id", "stratum")), "quality-counts")
    cutoffs = stage(certify(counts, labels.select(F.col("doc_id").cast("long"), F.col("quality")), **how), "quality-cutoffs")
    return apply_cutoffs(counts, cutoffs)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts and the verdict for every document, with cutoffs certified on `labels`."""
    out = quality_filter(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
