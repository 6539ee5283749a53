"""Quality rules combined by weak supervision.

Each rule votes good (+1) or bad (-1) on a document, or abstains (0).  Rules
differ in how often they err on good and on bad documents; expectation-
maximisation estimates both rates for every rule, and the share of good
documents, from the votes alone.  A document is kept by its posterior
probability of being good, not by passing every rule.

The votes of all documents meet as a histogram of vote patterns: with R rules it
has at most 3**R rows whatever the size of the corpus, so EM runs on the driver
over exact counts.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Fixed values of the query's contract.
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
SYMBOLS = b"#*$%&|<>"
BLANKS = b" \t\n\r\x0b\x0c"

#: Frequent words of the corpus languages, by which prose is known.
STOP_WORDS = (
    "a an and are as at be by for from have he in is it not of on or that the this to was were which with you "
    "au aux avec ce dans de des du elle en est et il la le les mais ne ou par pas pour que qui sur un une "
    "als auch auf das dem den der des die ein eine für im ist mit nicht sich sie und von war zu "
    "al como con del el es esta las lo los más no para pero por se sin su una y"
).split()
_STOP = frozenset(w.encode() for w in STOP_WORDS)
_UPPER, _LOWER = bytes(range(65, 91)), bytes(range(97, 123))

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: name, measure as a share, bad beyond or below, good within; between them the rule abstains.
RULES = ("symbols", "repeats", "duplicate_lines", "shouting", "word_length", "stop_words", "stops", "one_word")


def measure(b: bytes) -> tuple[list[int], list[int]]:
    """The five counts of MEASURES and the votes of RULES on one text (UTF-8)."""
    words = b.split()
    n, size = len(words), len(b)
    blanks = size - len(b.translate(None, BLANKS))
    points = size if b.isascii() else int(np.count_nonzero(np.frombuffer(b, np.int8) >= -64))
    chars, symbols = points - blanks, size - len(b.translate(None, SYMBOLS))
    lines = [line for line in b.split(b"\n") if line.strip()]
    dup_lines = len(lines) - len(set(lines))
    repeated, top = 0, n
    if n >= 3:
        h = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
        with np.errstate(over="ignore"):
            t = (h[:-2] * np.uint64(0x9E3779B97F4A7C15) ^ (h[1:-1] >> np.uint64(7))) * np.uint64(0xBF58476D1CE4E5B9) + h[1:-1] * np.uint64(0x94D049BB133111EB) + (h[2:] ^ (h[2:] >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
        s = np.sort(t)
        twice = s[1:][s[1:] == s[:-1]]
        if len(twice):
            at = np.minimum(np.searchsorted(twice, t), len(twice) - 1)
            hit, covered = twice[at] == t, np.zeros(n, bool)
            for k in range(3):
                covered[k : n - 2 + k] |= hit
            repeated = int(covered.sum())
        h = np.sort(h)
        ends = np.flatnonzero(np.append(h[1:] != h[:-1], True))
        top = int(np.diff(ends, prepend=-1).max())
    counts = [n, chars, symbols, dup_lines, repeated]
    if not n:
        return counts, [0] * len(RULES)
    upper, lower = size - len(b.translate(None, _UPPER)), size - len(b.translate(None, _LOWER))
    stop, ends = sum(map(_STOP.__contains__, words)) / n, (b.count(b".") + b.count(b"!") + b.count(b"?")) / n
    mean, short = chars / n, n < MIN_WORDS

    def vote(bad: bool, good: bool) -> int:
        return -1 if bad else 1 if good else 0

    return counts, [
        vote(symbols > 0.08 * chars, symbols < 0.02 * chars),
        vote(repeated > 0.3 * n, repeated < 0.12 * n and not short),
        vote(dup_lines > 0.3 * len(lines), dup_lines == 0 and len(lines) > 2),
        vote(upper > 0.4 * (upper + lower), upper < 0.15 * (upper + lower)),
        vote(mean > 14 or mean < 2, 3 <= mean <= 10),
        vote(stop < 0.05 and not short, stop > 0.1),
        vote((ends > 0.6 or ends < 0.002) and not short, 0.01 < ends < 0.35),
        vote(top > 0.3 * n and not short, top < 0.15 * n),
    ]


def fit(patterns: Sequence[tuple[Sequence[int], int]], rounds: int = 200, tolerance: float = 1e-9) -> tuple[float, np.ndarray, np.ndarray]:
    """EM over (votes, count) -> share of good, P(vote +1 | good) and P(vote +1 | bad) of each rule.

    Abstentions say nothing.  Pseudo-counts keep the classes from changing places
    and hold rules that seldom vote: good documents pass a rule 49 times in 50,
    bad ones 8 times in 20, since each rule knows its own kind of bad document.
    """
    if not patterns:
        return 0.85, np.full(len(RULES), 0.98), np.full(len(RULES), 0.4)
    votes, weight = np.array([p for p, _ in patterns], float), np.array([c for _, c in patterns], float)
    up, down = votes > 0, votes < 0
    share, good, bad = 0.85, np.full(votes.shape[1], 0.98), np.full(votes.shape[1], 0.4)
    for _ in range(rounds):
        p = posterior(votes, share, good, bad)
        g, b = weight * p, weight * (1 - p)
        new = (g.sum() + 17) / (weight.sum() + 20), (g @ up + 49) / (g @ (up | down) + 50), (b @ up + 8) / (b @ (up | down) + 20)
        moved = max(abs(new[0] - share), np.abs(new[1] - good).max(), np.abs(new[2] - bad).max())
        share, good, bad = new
        if moved < tolerance:
            break
    return float(share), good, bad


def posterior(votes: np.ndarray, share: float, good: np.ndarray, bad: np.ndarray) -> np.ndarray:
    votes = np.asarray(votes, float)
    up, down = votes > 0, votes < 0
    odds = np.log(share / (1 - share)) + up @ (np.log(good) - np.log(bad)) + down @ (np.log1p(-good) - np.log1p(-bad))
    return 1 / (1 + np.exp(-np.clip(odds, -700, 700)))


def measured(docs: DataFrame, carried: Sequence[str] = ("doc_id",)) -> DataFrame:
    """__c0, __c1, ... (the ``carried`` columns), MEASURES and ``pattern``: the votes as a number in base 3."""
    import pyarrow as pa
    from pyspark.sql import types as T

    columns = [F.col(c).alias(f"__c{i}") for i, c in enumerate(carried)]
    inner = docs.select(*columns, F.col("text").cast("binary").alias("__text"))
    fields = inner.schema.fields[:-1]
    power = [3**k for k in range(len(RULES))]

    def run(batches):
        for batch in batches:
            found = [measure(t.as_py() or b"") for t in batch.column("__text")]
            counts = [pa.array([c[k] for c, _ in found], pa.int64()) for k in range(len(MEASURES))]
            pattern = pa.array([sum(p * (v + 1) for p, v in zip(power, votes)) for _, votes in found], pa.int32())
            kept = [batch.column(i) for i in range(len(fields))]
            yield pa.RecordBatch.from_arrays([*kept, *counts, pattern], [*(f.name for f in fields), *MEASURES, "pattern"])

    schema = T.StructType([*fields, *(T.StructField(m, T.LongType()) for m in MEASURES), T.StructField("pattern", T.IntegerType())])
    return inner.mapInArrow(run, schema)


def judge_quality(docs: DataFrame, carried: Sequence[str] = ("doc_id",), least: float = 0.5, store: bool = True) -> DataFrame:
    """``carried`` columns, MEASURES, base_failed, quality (posterior) and kept.

    ``store``: measures are kept in the shared folder between the two passes.
    Without it each document is measured twice, once for the model and once for
    its verdict: right where whole texts are carried, of which no copy is then written.

    Null and empty texts have no words and fail; repeated rows and ids are
    judged one by one; an empty table gives no rows; columns that are not
    carried are not read; a carried column with a name of the result gets ``_in`` after it.
    """
    spark = docs.sparkSession
    table = stored(measured(docs, carried), "quality") if store else measured(docs, carried)
    votes = table if store else measured(docs, ())
    histogram = [(r.pattern, r.n) for r in votes.groupBy("pattern").agg(F.count("*").alias("n")).collect()]  # at most 3 ** len(RULES)
    histogram.sort()
    digits = [[p // 3**k % 3 - 1 for k in range(len(RULES))] for p, _ in histogram]
    model = fit([(d, n) for d, (_, n) in zip(digits, histogram)])
    quality = posterior(np.array(digits).reshape(-1, len(RULES)), *model)
    judged = spark.createDataFrame([(int(p), float(q)) for (p, _), q in zip(histogram, quality)], "pattern int, quality double")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    # at most 3 ** len(RULES) rows
    joined = table.join(F.broadcast(judged), "pattern").withColumn("base_failed", failed)
    joined = joined.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= least))
    result = (*MEASURES, "base_failed", "quality", "kept")
    return joined.select(*(F.col(f"__c{i}").alias(f"{c}_in" if c in result else c) for i, c in enumerate(carried)), *result)


def op5_quality_rules(spark, sf_dir: str) -> DataFrame:
    out = judge_quality(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", *MEASURES, "base_failed", "kept", "quality")
