"""Quality rules whose cutoffs carry a risk guarantee; DataFrame functions only.

Features are computed in one pass over the texts.  The cutoffs of all rules form
one ladder, from the loosest step to the strictest; a step has all cutoffs of
the steps before it, so the documents it rejects only grow.  Per stratum of
labelled documents each step's rejections of good documents are held against an
exact binomial bound, and of the steps that pass the one that best separates bad
from good documents is used.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetscope.llm.common import SPACE_RUN, SPACES, materialize, whole_text

WINDOW = 8

#: Rule -> ratio of two features; a document fails above the rule's cutoff.
RATIOS: Mapping[str, str] = {
    "symbols": "n_symbols / greatest(word_chars, 1)",
    "long_words": "word_chars / greatest(n_words, 1)",
    "repeats": "n_repeat_words / greatest(n_words, 1)",
    "dup_lines": "n_dup_lines / greatest(n_lines, 1)",
}

#: The steps in order.  Rules that aim at junk come first, those that also touch plain lists and verse last.
LADDER: Sequence[tuple[str, float]] = (
    ("symbols", 0.5), ("long_words", 40.0), ("symbols", 0.3), ("long_words", 24.0), ("symbols", 0.2), ("long_words", 16.0),
    ("symbols", 0.1), ("long_words", 12.0), ("symbols", 0.05), ("long_words", 10.0), ("symbols", 0.02), ("long_words", 8.0),
    ("symbols", 0.01), ("long_words", 7.0),
    ("dup_lines", 0.9), ("repeats", 0.25), ("dup_lines", 0.7), ("repeats", 0.2), ("dup_lines", 0.5), ("repeats", 0.15),
    ("dup_lines", 0.3), ("repeats", 0.1), ("dup_lines", 0.2), ("repeats", 0.05), ("dup_lines", 0.1),
)


def _covered(positions: Column, width: int) -> Column:
    """Words under windows of ``width`` that start at the sorted ``positions``."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-width).cast("int").alias("last"))
    step = lambda acc, p: F.struct(
        (acc["n"] + F.least(F.lit(width), p - acc["last"])).alias("n"), p.alias("last")
    )
    return F.aggregate(positions, start, step, lambda acc: acc["n"])


def text_features(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """Per row: ``keep`` columns, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words.

    Nothing is shuffled and no row is exploded: windows are 64-bit hashes in an
    array of the row, and only rows whose window hashes repeat are sorted.
    Null and empty texts, and texts of white space only, give zeros.
    """
    base = df.select(F.col(id_col).alias("doc_id"), *[F.col(c) for c in keep], whole_text(text_col).alias("__text"))
    trimmed = F.btrim("__text", F.lit(SPACES))
    words = base.withColumn("__trimmed", trimmed).withColumn(
        "__words",
        F.when(F.col("__trimmed") == "", F.array().cast("array<string>")).otherwise(F.split("__trimmed", SPACE_RUN)),
    )
    has_word = F.filter(F.split("__text", "\n"), lambda line: F.btrim(line, F.lit(SPACES)) != "")
    hashed = words.select(
        "doc_id",
        *keep,
        F.size("__words").cast("long").alias("n_words"),
        F.char_length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        F.regexp_count("__text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        has_word.alias("__lines"),
        F.transform("__words", lambda w: F.xxhash64(w)).alias("__hashes"),
    )
    last = F.size("__hashes") - WINDOW
    windows = hashed.withColumn(
        "__windows",
        F.when(
            last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(F.slice("__hashes", i + 1, WINDOW)))
        ).otherwise(F.array().cast("array<bigint>")),
    )
    repeats = F.size(F.array_distinct("__windows")) < F.size("__windows")
    in_order = windows.withColumn(
        "__order",
        F.when(
            repeats,
            F.sort_array(F.transform("__windows", lambda h, i: F.struct(h.alias("h"), i.alias("p")))),
        ).otherwise(F.array().cast("array<struct<h:bigint,p:int>>")),
    ).drop("__windows", "__hashes")
    neighbour = lambda i: F.try_element_at(F.col("__order"), i)["h"]
    twice = F.filter(
        F.transform(
            "__order",
            lambda x, i: F.when(
                (x["h"] == neighbour(i + 2)) | ((i > 0) & (x["h"] == neighbour(F.greatest(i, F.lit(1))))), x["p"]
            ),
        ),
        lambda p: p.isNotNull(),
    )
    return in_order.select(
        "doc_id",
        *keep,
        "n_words",
        "word_chars",
        "n_symbols",
        F.size("__lines").cast("long").alias("n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("__order") > 0, _covered(F.sort_array(twice), WINDOW)).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def base_failed() -> Column:
    """The fixed rules: too short, or mostly repeated."""
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def binomial_cdf(k: Column, n: Column, p: Column) -> Column:
    """P(X <= k) for X ~ Binomial(n, p), summed term by term from X = 0 in log space."""
    state = lambda log_term, total: F.struct(log_term.alias("l"), total.alias("s"))
    log_zero = n * F.log1p(-p)
    odds = F.log(p) - F.log1p(-p)

    def add(acc: Column, j: Column) -> Column:
        term = acc["l"] + F.log((n - j + 1) / j) + odds
        return state(term, acc["s"] + F.exp(term))

    return F.when(k <= 0, F.exp(log_zero)).otherwise(
        F.aggregate(F.sequence(F.lit(1).cast("long"), k), state(log_zero, F.exp(log_zero)), add, lambda acc: acc["s"])
    )


def first_step(ladder: Sequence[tuple[str, float]] = LADDER) -> Column:
    """Number (from 1) of the first step that rejects the document, null if none does."""
    above = [F.when(F.expr(RATIOS[rule]) > F.lit(cut), F.lit(i + 1)) for i, (rule, cut) in enumerate(ladder)]
    return F.coalesce(*above)


def risk_controlled_steps(
    labelled: DataFrame,
    n_steps: int = len(LADDER),
    max_false_rejection: float = 0.025,
    alpha: float = 0.05,
) -> DataFrame:
    """``stratum, step``: the last step to use in each stratum, 0 where none has the guarantee.

    ``labelled`` has ``stratum``, ``first_step`` and a boolean ``good``.  Step ``s``
    rejects ``k(s)`` of a stratum's ``n`` good documents.  It passes if
    P(Bin(n, max_false_rejection) <= k(s)) <= alpha / strata, i.e. if the exact
    (Clopper-Pearson) upper bound of its false rejection rate is within
    ``max_false_rejection``; Bonferroni corrects for the strata.

    Guarantee: with probability 1 - alpha no stratum's step in use rejects more
    than ``max_false_rejection`` of its good documents.  Proof: k grows with s, so
    the passing steps are the first ones.  Let t be the first step whose true rate
    is above the limit.  A step from t on can only be used if t passes, and then
    k(t) is binomial with a rate above the limit, so t passes with probability at
    most alpha / strata (fixed-sequence testing: the ladder costs no correction).
    Which passing step is used does not matter to this; it is the one with the
    largest difference between the rejected shares of bad and of good documents,
    the loosest of equals.

    Strata with too few good documents for even a step without rejections are
    tested together as one; its guarantee is then one for their union.
    """
    n_strata = labelled.groupBy("stratum").agg(F.count_if("good").alias("n")).agg(F.count(F.lit(1)).alias("n_strata"))
    counted = labelled.groupBy("stratum").agg(
        F.count_if("good").alias("n"),
        F.count_if(~F.col("good")).alias("m"),
        *[F.count_if(F.col("good") & (F.col("first_step") <= s)).alias(f"k{s}") for s in range(1, n_steps + 1)],
        *[F.count_if(~F.col("good") & (F.col("first_step") <= s)).alias(f"b{s}") for s in range(1, n_steps + 1)],
    )
    limit = F.lit(max_false_rejection)
    level = F.lit(alpha) / F.col("n_strata")
    # One row per stratum from here on.
    sized = counted.crossJoin(F.broadcast(n_strata)).withColumn("few", F.pow(1 - limit, F.col("n")) > level)
    sums = [c for c in counted.columns if c != "stratum"]
    pools = sized.groupBy(F.when(F.col("few"), F.lit(None)).otherwise(F.col("stratum")).alias("pool"), "few", "n_strata").agg(
        F.collect_list("stratum").alias("named"), F.count_if(F.col("stratum").isNull()).alias("unnamed"), *[F.sum(c).alias(c) for c in sums]
    )
    k = lambda s: F.col(f"k{s}")
    passes = lambda s: (k(s) <= F.col("n") * limit) & (binomial_cdf(F.least(k(s), F.floor(F.col("n") * limit)), F.col("n"), limit) <= level)
    gain = lambda s: F.col(f"b{s}") / F.greatest(F.col("m"), F.lit(1)) - k(s) / F.greatest(F.col("n"), F.lit(1))
    choices = [F.when(passes(s), F.struct(gain(s).alias("gain"), F.lit(-s).alias("step"))) for s in range(1, n_steps + 1)]
    none = F.struct(F.lit(0.0).alias("gain"), F.lit(0).alias("step"))
    chosen = pools.withColumn("step", -F.greatest(none, *choices)["step"])
    # A null stratum is no element of the list.
    names = F.when(F.col("unnamed") > 0, F.concat("named", F.array(F.lit(None).cast("string")))).otherwise(F.col("named"))
    return chosen.select(F.explode(names).alias("stratum"), "step")


def quality_verdicts(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    stratum_col: str = "lang",
    max_false_rejection: float = 0.025,
    alpha: float = 0.05,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Features of every row, ``base_failed``, and ``kept``; before them the columns ``keep`` of ``docs``.

    ``labels`` has the id and ``quality`` (1 good, 0 bad, null ignored); of
    repeated labels the best counts.  A null stratum is a stratum of its own; a
    stratum without labels has only the fixed rules.  ``kept`` is false if
    ``base_failed``, else true unless a step in use rejects the row.  Repeated
    rows get a row each, an empty table none.
    """
    picked = docs.select(
        F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(stratum_col).cast("string").alias("stratum"),
        *[F.col(c).alias(f"__keep{i}") for i, c in enumerate(keep)],
    )
    carried = [f"__keep{i}" for i in range(len(keep))]
    features = materialize(text_features(picked, keep=["stratum", *carried]), "quality-features")
    features = features.withColumn("first_step", first_step())
    truth = (
        labels.where("quality is not null")
        .groupBy(F.col(id_col).alias("doc_id"))
        .agg((F.max("quality") > 0).alias("good"))
    )
    labelled = features.where(~base_failed()).join(truth, "doc_id").select("stratum", "first_step", "good")
    steps = risk_controlled_steps(materialize(labelled, "quality-labelled"), len(LADDER), max_false_rejection, alpha)
    steps = materialize(steps.withColumnRenamed("stratum", "__stratum"), "quality-steps")
    judged = features.join(steps, F.col("stratum").eqNullSafe(F.col("__stratum")), "left")
    rejected = F.coalesce(F.col("first_step") <= F.col("step"), F.lit(False))
    return judged.select(
        *[F.col(c).alias(name) for c, name in zip(carried, keep, strict=True)],
        F.col("doc_id").alias(id_col),
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        base_failed().alias("base_failed"),
        (~base_failed() & ~rejected).alias("kept"),
    )


def good_documents(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", **options: float
) -> DataFrame:
    """The rows of ``docs`` that ``quality_verdicts`` keeps, all columns unchanged; each row is judged by its own text."""
    whole = docs.select(F.struct(*docs.columns).alias("__row"), *dict.fromkeys((id_col, text_col, stratum_col)))
    return quality_verdicts(whole, labels, id_col, text_col, stratum_col, keep=["__row"], **options).where("kept").select("__row.*")
