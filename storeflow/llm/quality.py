"""Document quality by Bradley-Terry ranking.

Two documents of different label make a preference pair. The score of a document
is a weighted sum of text features; the weights minimise the logistic loss on the
feature differences of the pairs. Scores are then cut at the quantile that leaves
out as large a share of the labelled sample as was labelled bad.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storeflow.llm import work
from storeflow.llm.tables import table

SAMPLE_ROWS = 20_000  # labelled rows used for fitting, chosen by a hash of their id
PAIRS = 100_000
RIDGE = 1e-3
SEED = 17


def features(text: Column) -> dict[str, Column]:
    """Numeric features of a text; a short text has values near those of an empty one."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    chars = F.length(text)
    n_words = F.size(words)
    # No feature is the length itself: short clean texts are not worse.
    share = lambda part, whole: part / (whole + 10)  # noqa: E731  small for the little that a short text shows
    without = lambda pattern: chars - F.length(F.regexp_replace(text, pattern, ""))
    again = F.aggregate(
        words,
        F.struct(F.lit("").alias("last"), F.lit(0).alias("n")),
        lambda a, w: F.struct(w.alias("last"), (a["n"] + (a["last"] == w).cast("int")).alias("n")),
        lambda a: a["n"],
    )
    symbols = without(r"[^\p{L}\p{N}\s.,;:'\"()-]+")
    return {
        "upper": share(without(r"\p{Lu}+"), chars),
        "digits": share(without(r"\p{N}+"), chars),
        "symbols": share(symbols, chars),
        "symbols_per_word": F.least(share(symbols, n_words), F.lit(3.0)),
        "stops": share(without(r"[.,;:]+"), chars),
        "word_length": F.least((chars + 60) / (n_words + 10), F.lit(30.0)),
        "repeats": share(again, n_words),
        "repeated_words": share(n_words - F.size(F.array_distinct(words)), n_words),
        "repeated_lines": share(F.size(lines) - F.size(F.array_distinct(lines)), F.size(lines)),
    }


NAMES = tuple(
    "upper digits symbols symbols_per_word stops word_length repeats repeated_words"
    " repeated_lines".split()
)


@dataclass(frozen=True)
class Ranking:
    weights: tuple[float, ...]  # for plain feature values, in the order of NAMES
    cut: float  # the quantile of the labelled rows' scores that a document must reach
    rows: int


def pair_weights(x: np.ndarray, good: np.ndarray, pairs: int = PAIRS, seed: int = SEED) -> np.ndarray:
    """Weights of the pairwise logistic loss, by Newton steps, for standardised features."""
    rng = np.random.default_rng(seed)
    ups, downs = np.flatnonzero(good), np.flatnonzero(~good)
    weights = np.zeros(x.shape[1])
    if not len(ups) or not len(downs):
        return weights
    diff = x[rng.choice(ups, pairs)] - x[rng.choice(downs, pairs)]
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(diff @ weights, -30, 30)))
        slope = diff.T @ (p - 1) / pairs + RIDGE * weights
        bend = (diff * (p * (1 - p))[:, None]).T @ diff / pairs + RIDGE * np.eye(x.shape[1])
        step = np.linalg.solve(bend, slope)
        weights -= step
        if np.abs(step).max() < 1e-8:
            break
    return weights


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    sample_rows: int = SAMPLE_ROWS,
) -> Ranking:
    """Learn weights from at most ``sample_rows`` labelled rows, the first ones by a hash of the id; the cut from all.

    Labels other than 0 and 1, null ids and labels without a document are
    ignored; repeated labels and documents count as often as they occur. Without
    both labels nothing can be learned: all weights are 0 and every score is 0.5.
    """
    known = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").alias("label")).where(
        F.col("label").isin(0, 1) & F.col("id").isNotNull()
    )
    chosen = known.orderBy(F.xxhash64("id", F.lit(SEED)), "id", "label").limit(sample_rows)
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    # The sample has sample_rows rows of two numbers at most.
    rows = (
        texts.join(F.broadcast(chosen), "id")
        .select("id", "label", F.array(*(c.cast("double") for c in features(F.col("text")).values())).alias("x"))
        .orderBy("id", "label", "x")
        .limit(2 * sample_rows)
        .toArrow()
    )
    if not rows.num_rows:
        return Ranking((0.0,) * len(NAMES), 0.0, 0)
    x = np.array(rows.column("x").to_pylist())
    good = np.array(rows.column("label").to_pylist()) == 1
    scale = np.where(x.std(0) > 1e-12, x.std(0), 1.0)
    weights = pair_weights((x - x.mean(0)) / scale, good) / scale
    plain = Ranking(tuple(map(float, weights)), 0.0, len(x))
    if not weights.any():
        return plain
    scored = work.written(texts.select("id", _total(F.col("text"), plain).alias("score")).join(known, "id").drop("id"), "scores")
    share = scored.agg(F.avg((F.col("label") == 0).cast("double"))).first()[0]
    return Ranking(plain.weights, quantile(scored, share), len(x))


def quantile(rows: DataFrame, share: float, least: int = 10_000, bins: int = 1000) -> float:
    """numpy's quantile of the column score: ranges are narrowed by counting until one holds ``least`` rows."""
    at = F.col("score")
    n, low, high = rows.agg(F.count(at), F.min(at), F.max(at)).first()
    rank = share * (n - 1)
    left, inside = int(rank), n
    while inside > least and low < high:
        number = F.least(F.floor((at - low) / ((high - low) / bins)), F.lit(bins - 1))
        held = rows.where(at.between(low, high)).groupBy(number.alias("bin"))
        for _, inside, low, high in held.agg(F.count(at), F.min(at), F.max(at)).orderBy("bin").collect():
            if left < inside:
                break
            left -= inside
    value = low
    if low < high:
        value = np.sort([r[0] for r in rows.where(at.between(low, high)).select(at).collect()])[left]
    up_to, above = rows.agg(F.count(F.when(at <= float(value), 1)), F.min(F.when(at > float(value), at))).first()
    following = value if up_to > int(rank) + 1 or above is None else above
    return float(value + (following - value) * (rank - int(rank)))


def _total(text: Column, ranking: Ranking) -> Column:
    values = features(text)
    total = F.lit(-ranking.cut)
    for name, weight in zip(NAMES, ranking.weights):
        total = total + F.lit(weight) * values[name]
    return total


def score(text: Column, ranking: Ranking) -> Column:
    """0 to 1; 0.5 is the cut."""
    total = _total(text, ranking)
    return 1 / (1 + F.exp(-F.least(F.greatest(total, F.lit(-30.0)), F.lit(30.0))))


def held_out(id_col: str, folds: int, fold: int) -> Column:
    """A null id is never held out."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string")) % folds == fold, F.lit(False))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(~held_out("doc_id", 3, 1))
    ranking = fit(docs, labels)
    return docs.select(
        "doc_id", held_out("doc_id", 3, 1).alias("held_out"), score(F.col("text"), ranking).alias("score")
    ).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


QUERIES = {"op10_quality": op10_quality}
SQL: dict[str, str] = {}
