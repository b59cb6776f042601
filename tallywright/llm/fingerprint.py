"""Document fingerprints: one-permutation MinHash, optimally densified, packed to low-order bits.

A text's distinct five-word shingles (see ``kernels``) are hashed once into BINS bins; an empty bin
borrows along its own probe sequence. BITS low-order bits of every bin's mixed minimum are packed into
lower-case hex. Two fingerprints agree in a bin with probability J + (1 - J) / 2**BITS, so the share of
agreeing bins is corrected for chance agreement before it is given as a likeness.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallywright.llm import kernels as K
from tallywright.llm.common import stored

BINS = 256
BITS = 4
RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def bins_of(texts: pa.Array, bins: int = BINS, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """n x bins low-order bits of each text, and whether it has any shingle."""
    probes = K.probe_table(bins)
    values, some = [np.zeros((0, bins), np.uint8)], [np.zeros(0, bool)]
    for c in K.chunks(texts, bins=bins):
        h, doc = K.distinct_sorted(*K.shingle_hashes(*K.word_hashes(c)))
        low = K.mix(K.one_permutation(h, doc, c.n, bins, probes) + np.uint64(1)).astype(np.uint8) & np.uint8((1 << bits) - 1)
        has = np.bincount(doc, minlength=c.n) > 0
        low[~has] = 0
        values.append(low)
        some.append(has)
    return np.concatenate(values), np.concatenate(some)


def packed(values: np.ndarray, some: np.ndarray, bits: int = BITS) -> list[str]:
    """Hex of the bits, most significant first; a text without shingles has the empty fingerprint."""
    planes = ((values[:, :, None] >> np.arange(bits - 1, -1, -1, dtype=np.uint8)) & 1).reshape(len(values), -1)
    rows = np.packbits(planes, axis=1)
    return [r.tobytes().hex() if s else "" for r, s in zip(rows, some)]


def likeness(a: np.ndarray, some_a: np.ndarray, b: np.ndarray, some_b: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Estimated Jaccard similarity, row by row; two empty fingerprints are alike (1), one alone is not (0)."""
    chance = 0.5**bits
    near = np.clip(((a == b).mean(1) - chance) / (1 - chance), 0.0, 1.0) if len(a) else np.zeros(0)
    return np.where(some_a & some_b, near, (some_a == some_b).astype(float))


def _judged(ids: list, texts: list[str], following: list[str]) -> dict[str, list]:
    """The result's columns for texts and the texts that follow them."""
    edited = [t[: len(t) - len(t) // 2] + f[: len(t) // 2] for t, f in zip(texts, following)]
    own, own_some = bins_of(pa.array(texts, pa.large_string()))
    new, new_some = bins_of(pa.array(edited, pa.large_string()))
    if len(texts) > 1 and all(f is t for f, t in zip(following, texts[1:])):
        last, last_some = bins_of(pa.array(following[-1:], pa.large_string()))
        nxt, nxt_some = np.concatenate((own[1:], last)), np.concatenate((own_some[1:], last_some))
    else:
        nxt, nxt_some = bins_of(pa.array(following, pa.large_string()))
    return {
        "doc_id": ids, "n_chars": [len(t) for t in texts],
        "edited_sha256": [hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest() for e in edited],
        "fingerprint": packed(own, own_some), "edited_fingerprint": packed(new, new_some),
        "near_edited": likeness(own, own_some, new, new_some).tolist(), "near_next": likeness(own, own_some, nxt, nxt_some).tolist(),
    }


_STEP = RESULT + ", part int, role string, edge_text string"
_STEP_ARROW = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("part", pa.int32()), ("role", pa.string()), ("edge_text", pa.string())])


def _batch(columns: dict[str, list]) -> pa.RecordBatch:
    n = len(columns["doc_id"])
    return pa.RecordBatch.from_pydict({f.name: columns.get(f.name, [None] * n) for f in _STEP_ARROW}, schema=_STEP_ARROW)


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Judge each row against the one after it; a partition's outer rows go on with their texts."""
    part = TaskContext.get().partitionId()
    held: tuple | None = None
    for batch in batches:
        ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").fill_null("").to_pylist()
        if not ids:
            continue
        if held is None:
            yield _batch({"doc_id": ids[:1], "part": [part], "role": ["first"], "edge_text": texts[:1]})
        else:
            ids, texts = [held[0], *ids], [held[1], *texts]
        if len(ids) > 1:
            yield _batch(_judged(ids[:-1], texts[:-1], texts[1:]))
        held = ids[-1], texts[-1]
    if held is not None:
        yield _batch({"doc_id": [held[0]], "part": [part], "role": ["last"], "edge_text": [held[1]]})


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text) with its fingerprint and its likeness to an edited text.

    The edited text has the last floor(n_chars / 2) code points replaced by the first as many (or all)
    of the next document, in descending doc_id; after the last comes the first. Null texts count as
    empty; an empty or wordless text has the fingerprint "". Rows that repeat a doc_id follow each other
    in ascending text, a null doc_id comes after all others. A single row follows itself. Other columns
    are not read. An empty table gives no rows.

    The texts are shuffled once, by ranges of doc_id, and walked in order; only the outer rows of each
    range, two per partition, are matched afterwards.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    order = [F.col("doc_id").desc_nulls_last()]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    walked = docs.repartitionByRange(parts, *order).sortWithinPartitions(*order, "text").mapInArrow(_walk, _STEP)
    walked = stored(walked, "fingerprints")
    result = [c.split()[0] for c in RESULT.split(", ")]
    done = walked.filter("role is null").select(*result)

    # Two rows per partition are left: each partition's last row and the next partition's first.
    firsts = walked.filter("role = 'first'").select(F.col("part").alias("at"), F.col("edge_text").alias("following"))
    by_part = Window.orderBy("at")
    nexts = firsts.select("at", F.lead("at").over(by_part).alias("to"), F.min("at").over(by_part).alias("least")).select("at", F.coalesce("to", "least").alias("to"))
    last = walked.filter("role = 'last'").select("doc_id", "part", "edge_text")
    edges = last.join(nexts, F.col("part") == F.col("at")).drop("at").join(firsts, F.col("to") == F.col("at"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield _batch(_judged(*(batch.column(x).to_pylist() for x in ("doc_id", "edge_text", "following")))).select(result)

    return done.union(edges.select("doc_id", "edge_text", "following").mapInArrow(judge, RESULT))
