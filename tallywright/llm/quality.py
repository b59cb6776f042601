"""Quality classifier: a sparse rule ensemble over statistics of whole texts.

Boosted trees are grown on labelled documents; every path in them, from the root to any node, becomes a
conjunctive rule; an L1-penalised logistic regression keeps a few rules; and those are compiled into one
Spark column expression over the table of statistics.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywright.llm import kernels as K
from tallywright.llm.common import only, stored
from tallywright.llm.streams import lean

STATISTICS = (
    "log_chars", "log_words", "word_bytes", "upper_share", "digit_share", "symbol_share", "bang_rate", "bar_rate",
    "stop_rate", "comma_rate", "line_rate", "distinct_words", "top_word", "same_as_before", "distinct_runs",
    "odd_endings", "beyond_ascii", "short_words", "longest_word", "capital_words", "digit_words", "distinct_lines",
)
#: About this many labelled documents are drawn, by a hash of doc_id, where there are more.
TRAIN_ROWS = 20_000
THRESHOLD = 0.3
FOLDS = 5


def _flags(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[np.frombuffer(chars, np.uint8)] = True
    return out


_UPPER, _LETTER, _DIGIT = _flags(bytes(range(65, 91))), _flags(bytes([*range(65, 91), *range(97, 123)])), _flags(b"0123456789")
_SYMBOL, _ODD = _flags(b"#$%&*|<>{}[]\\/=~^_@+`"), _flags(b"!#$%&*|@=~^_+<>")


def chunk_statistics(c: K.Chunk) -> np.ndarray:
    """n x len(STATISTICS) statistics of the chunk's texts; all finite, 0 where undefined."""
    b, n = c.data, c.n

    def count(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(mask)))
        return (total[c.bounds[1:]] - total[c.bounds[:-1]]).astype(float)

    size = np.diff(c.bounds).astype(float)
    starts, ends, doc = K.word_spans(c)
    words = np.bincount(doc, minlength=n).astype(float)
    per_doc = lambda x: np.bincount(doc, weights=x, minlength=n)
    share = lambda a, d: np.divide(a, d, out=np.zeros(n), where=d > 0)
    chars = size - count((b & 0xC0) == 0x80)
    lengths = (ends - starts).astype(float)
    h = K.span_hashes(K.LOWER[b], starts, ends)
    kinds, of = K.distinct_sorted(h, doc)
    top, runs, of_runs = np.zeros(n), np.zeros(n), np.zeros(n)
    if len(h):
        ordered = np.sort(K.keyed(h, doc))
        cut = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
        np.maximum.at(top, (ordered[cut] >> np.uint64(K.HASH_BITS)).astype(np.int64), np.diff(np.append(cut, len(ordered))).astype(float))
        s, s_doc = K.shingle_hashes(h, doc)
        runs, of_runs = np.bincount(s_doc, minlength=n).astype(float), np.bincount(K.distinct_sorted(s, s_doc)[1], minlength=n).astype(float)
    before = np.zeros(len(h), bool)
    before[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    has_digit = np.concatenate(([0], np.cumsum(_DIGIT[b])))
    longest = np.zeros(n)
    np.maximum.at(longest, doc, lengths)
    newline = np.flatnonzero(b == 10)
    edges = np.union1d(newline + 1, c.bounds)
    line_doc = np.searchsorted(c.bounds, edges[:-1], side="right") - 1
    line_ends = edges[1:] - np.isin(edges[1:] - 1, newline)
    lines = np.bincount(line_doc, minlength=n).astype(float) if len(line_doc) else np.zeros(n)
    own_lines = np.bincount(K.distinct_sorted(K.span_hashes(b, edges[:-1], line_ends), line_doc)[1], minlength=n) if len(line_doc) else np.zeros(n)
    letters = count(_LETTER[b])
    return np.stack([
        np.log1p(chars), np.log1p(words), share(per_doc(lengths), words), share(count(_UPPER[b]), letters), share(count(_DIGIT[b]), size),
        share(count(_SYMBOL[b]), size), share(count(b == 33), words), share(count(b == 124), words), share(count(b == 46), words),
        share(count(b == 44), words), share(lines, words), share(np.bincount(of, minlength=n).astype(float), words), share(top, words),
        share(per_doc(before), words), share(of_runs, runs), share(per_doc(_ODD[b[ends - 1]] if len(ends) else lengths), words),
        share(count(b > 127), size), share(per_doc(lengths <= 3), words), np.log1p(longest), share(per_doc(_UPPER[b[starts]] if len(starts) else lengths), words),
        share(per_doc(has_digit[ends] > has_digit[starts]), words), share(own_lines.astype(float), lines),
    ], axis=1)


def statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, the STATISTICS) of every row of ``docs`` (doc_id, text); null texts count as empty."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in K.chunks(batch.column("text")):
                x = chunk_statistics(c)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(c.first_row, c.n), *(pa.array(x[:, j]) for j in range(x.shape[1]))], ["doc_id", *STATISTICS])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(lean(each), "doc_id long, " + ", ".join(f"{s} double" for s in STATISTICS))


Condition = tuple[int, bool, float]  # statistic, above, threshold


@dataclass
class RuleModel:
    """score = logistic(bias + sum of the weights of the rules that hold)."""

    bias: float
    rules: list[tuple[float, tuple[Condition, ...]]]

    def column(self) -> Column:
        """The score as one expression over the columns named in STATISTICS."""
        total = F.lit(self.bias)
        for weight, rule in self.rules:
            holds = F.lit(True)
            for j, above, at in rule:
                holds = holds & ((F.col(STATISTICS[j]) > at) if above else (F.col(STATISTICS[j]) <= at))
            total = total + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.bias + sum((w * holds(rule, x) for w, rule in self.rules), np.zeros(len(x))))))


def holds(rule: tuple[Condition, ...], x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for j, above, at in rule:
        out &= (x[:, j] > at) if above else (x[:, j] <= at)
    return out


def tree_rules(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.3, least: int = 20) -> list[tuple[Condition, ...]]:
    """The distinct paths of boosted trees on quantile bins."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, 33)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    margin, found = np.full(len(y), np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))), {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        gradient, weight = y - p, p * (1 - p) + 1e-9
        nodes: list[tuple[np.ndarray, tuple[Condition, ...]]] = [(np.arange(len(y)), ())]
        for level in range(depth + 1):
            grown = []
            for rows, path in nodes:
                best = None
                if level < depth and len(rows) >= 2 * least:
                    for j, e in enumerate(edges):
                        if not len(e):
                            continue
                        n, g, w = (np.cumsum(np.bincount(binned[rows, j], weights=v, minlength=len(e) + 1))[:-1] for v in (None, gradient[rows], weight[rows]))
                        G, W = gradient[rows].sum(), weight[rows].sum()
                        gain = g * g / (w + 1) + (G - g) ** 2 / (W - w + 1) - G * G / (W + 1)
                        gain[(n < least) | (len(rows) - n < least)] = -1
                        k = int(gain.argmax())
                        if gain[k] > 1e-3 and (best is None or gain[k] > best[0]):
                            best = (gain[k], j, k)
                if best is None:
                    margin[rows] += rate * gradient[rows].sum() / (weight[rows].sum() + 1)
                    continue
                _, j, k = best
                for above in (False, True):
                    side = rows[(binned[rows, j] > k) == above]
                    longer = tuple(sorted({*path, (j, above, float(edges[j][k]))}))
                    found[longer] = None
                    grown.append((side, longer))
            nodes = grown
            if not nodes:
                break
    return list(found)


def lasso_logistic(r: np.ndarray, y: np.ndarray, penalty: float, steps: int = 300) -> tuple[float, np.ndarray]:
    """Bias and weights of an L1-penalised logistic regression, by accelerated proximal gradient steps."""
    n, m = r.shape
    bias, w, mom, old = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))), np.zeros(m), np.zeros(m + 1), 1.0
    step = 4 * n / max(1e-9, np.linalg.norm(np.column_stack([r, np.ones(n)]), 2) ** 2)
    now = np.append(w, bias)
    mom = now.copy()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(r @ mom[:m] + mom[m])))
        g = np.append(r.T @ (p - y), (p - y).sum()) / n
        new = mom - step * g
        new[:m] = np.sign(new[:m]) * np.maximum(np.abs(new[:m]) - step * penalty, 0)
        t = (1 + (1 + 4 * old * old) ** 0.5) / 2
        mom, now, old = new + (old - 1) / t * (new - now), new, t
    return float(now[m]), now[:m]


def fit(x: np.ndarray, y: np.ndarray) -> RuleModel:
    """A rule ensemble for labels 0 and 1; constant where there are no labels or only one kind."""
    if not len(y) or y.min() == y.max() or len(y) < 10:
        mean = (y.sum() + 1) / (len(y) + 2)
        return RuleModel(float(np.log(mean / (1 - mean))), [])
    x, y = x.astype(float), y.astype(float)
    check = np.arange(len(y)) % 5 == 0
    rules = tree_rules(x[~check], y[~check], least=max(3, min(20, len(y) // 50)))
    table = np.stack([holds(rule, x) for rule in rules], axis=1).astype(np.float32)
    best = None
    for penalty in (0.02, 0.01, 0.005, 0.002, 0.001):
        b, w = lasso_logistic(table[~check], y[~check], penalty)
        p = np.clip(1 / (1 + np.exp(-(table[check] @ w + b))), 1e-6, 1 - 1e-6)
        loss = -(y[check] * np.log(p) + (1 - y[check]) * np.log(1 - p)).mean()
        if best is None or loss < best[0] - 1e-4:
            best = (loss, penalty)
    b, w = lasso_logistic(table, y, best[1])
    kept = [int(i) for i in np.argsort(-np.abs(w)) if abs(w[i]) > 1e-3]
    return RuleModel(b, [(float(w[i]), rules[i]) for i in kept])


def held_out() -> Column:
    """Whether crc32 of doc_id as text leaves 0 modulo FOLDS; such rows teach nothing."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(FOLDS)) == 0, F.lit(True))


def trained(stats: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> RuleModel:
    """A model from the labelled rows of ``stats`` that aren't held out, about ``train_rows`` of them."""
    quality = labels.filter("quality in (0, 1) and doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg((F.avg("quality") >= 0.5).cast("int").alias("quality"))
    known = stats.filter(~held_out()).join(quality, F.col("doc_id") == F.col("id")).drop("id")
    n = known.count()
    if n > train_rows:
        known = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * train_rows / n))
    rows = known.orderBy("doc_id", *STATISTICS).toPandas()
    return fit(rows[list(STATISTICS)].to_numpy(), rows["quality"].to_numpy(float))


def scored(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs`` (doc_id, text).

    ``labels`` has doc_id and quality; other values than 0 and 1 are not used, repeated labels are
    averaged. Null and empty texts are scored like others, by statistics of 0. A null doc_id is held out.
    Repeated rows get equal scores. Without usable labels the score is a constant. Other columns, among
    them lang and source, are not read. An empty table gives no rows.
    """
    stats = stored(statistics(docs), "statistics")
    model = trained(stats, labels, train_rows)
    out = stats.select("doc_id", held_out().alias("held_out"), model.column().alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that are not rejected, columns unchanged.

    Where rows repeat a doc_id they go only if each of them is rejected. A null doc_id stays.
    """
    told = scored(docs, labels, threshold).filter("doc_id is not null").groupBy("doc_id").agg(F.max("predicted").alias("best"))
    return only(docs, "doc_id", told.filter("best = 0").select("doc_id"), "left_anti")
