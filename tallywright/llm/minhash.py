"""Near-duplicate documents: one-permutation MinHash, banded buckets, star-shaped candidates.

Every document's distinct word shingles are hashed once; a one-permutation sketch with optimal
densification gives ``bands`` x ``rows`` values. Documents that agree on a whole band meet in a
bucket. In a bucket only its least document is compared with the others (a star), so a bucket of n
documents gives n - 1 candidates. Candidates are confirmed on full shingle sets. What the stars leave
open is settled in a second round: documents of one bucket that are still in different components
are compared with each other by longer sketches, in tiles of bounded size, and those that may be
similar enough are confirmed on full sets too, so what met in a bucket is not lost.

At the defaults (40 bands of 5) a pair of similarity 0.75 meets with probability
1 - (1 - 0.75**5)**40 = 0.99998, more similar ones more surely.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywright.llm import kernels as K
from tallywright.llm.common import BROADCAST_IDS, only, stored
from tallywright.llm.components import components
from tallywright.llm.streams import grouped, lean

PERCENT = 75
BANDS = 40
ROWS = 5


def band_keys(sketch: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """n x bands hashes of a sketch's bands, different for each band."""
    keys = np.zeros((len(sketch), bands), np.uint64)
    for r in range(rows):
        keys = K.mix(keys * np.uint64(31) + sketch[:, r::rows] + np.uint64(r))
    return K.mix(keys + np.arange(bands, dtype=np.uint64)[None, :] * np.uint64(K.BASE)).view(np.int64)


def sketches(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, shingle: int = K.SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, same, bands): size of the shingle set, a 128-bit digest of it, band hashes.

    ``docs`` has doc_id and text. Empty sets have a null ``same`` and no bands.
    """
    probes = K.probe_table(bands * rows)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in K.chunks(batch.column("text"), bins=bands * rows):
                h, doc = K.distinct_sorted(*K.shingle_hashes(*K.word_hashes(c), shingle))
                n = np.bincount(doc, minlength=c.n)
                sketch = K.one_permutation(h, doc, c.n, bands * rows, probes)
                keys = band_keys(sketch, bands, rows)
                some = n > 0
                digest = np.zeros((c.n, 2), np.uint64)
                if len(h):
                    at = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
                    digest[some, 0] = np.add.reduceat(h, at)
                    digest[some, 1] = np.bitwise_xor.reduceat(K.mix(h + np.uint64(1)), at)
                flat = pa.array(keys[some].reshape(-1))
                ends = np.concatenate(([0], np.cumsum(some * bands))).astype(np.int32)
                same = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), c.n, [None, pa.py_buffer(np.ascontiguousarray(digest).tobytes())]).cast(pa.binary())
                same = pa.compute.if_else(pa.array(some), same, pa.scalar(None, pa.binary()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(c.first_row, c.n), pa.array(n.astype(np.int64)), same, pa.ListArray.from_arrays(pa.array(ends), flat)],
                    ["doc_id", "n_shingles", "same", "bands"],
                )

    return docs.select("doc_id", "text").mapInArrow(lean(each), "doc_id long, n_shingles long, same binary, bands array<long>")


def confirmed(pairs: DataFrame, docs: DataFrame, percent: int = PERCENT, shingle: int = K.SHINGLE) -> DataFrame:
    """Those (a, b) of ``pairs`` whose full shingle sets have 100 * common >= percent * union."""
    pairs = stored(pairs, "pairs")
    text = only(docs.select("doc_id", "text"), "doc_id", pairs.select(F.explode(F.array("a", "b"))))
    pairs = pairs.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # few bytes, much work
    both = pairs.join(text.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b").join(
        text.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a"
    )

    def sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        return K.distinct_sorted(*K.shingle_hashes(*K.word_hashes(next(K.chunks(column, 1 << 62))), shingle))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = (pa.compute.binary_length(batch.column(x)).fill_null(0).to_numpy(zero_copy_only=False) for x in ("text_a", "text_b"))
            total = np.cumsum(np.maximum.reduce(list(sizes)))
            at, n = 0, batch.num_rows
            while at < n:
                to = min(at + K.CHUNK_ROWS, max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + K.CHUNK_BYTES, side="right"))))
                part = batch.slice(at, to - at)
                (h_a, doc_a), (h_b, doc_b) = sets(part.column("text_a")), sets(part.column("text_b"))
                h, doc = np.concatenate((h_a, h_b)), np.concatenate((doc_a, doc_b))
                keyed = np.sort(K.keyed(h, doc))
                common = np.bincount((keyed[1:][keyed[1:] == keyed[:-1]] >> np.uint64(K.HASH_BITS)).astype(np.int64), minlength=to - at)
                union = np.bincount(doc, minlength=to - at) - common
                keep = pa.array((common > 0) & (100 * common >= percent * union))
                yield pa.RecordBatch.from_arrays([part.column("a").filter(keep), part.column("b").filter(keep)], ["a", "b"])
                at = to

    return both.select("a", "text_a", "b", "text_b").mapInArrow(lean(each), "a long, b long").distinct()


#: Sets with copies, of 24 bytes each, that are sent to every executor (about 30 MB); more are joined by a shuffle.
BROADCAST_COPIED = 500_000
#: Bins of the second round's sketches, kept as one byte each, and rows of a bucket's tile.
SIGNATURE = 1024
TILE = 1024


def likely(met: DataFrame, docs: DataFrame, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS, shingle: int = K.SHINGLE) -> DataFrame:
    """Pairs (a, b) with different labels in one bucket of ``met`` that may be similar enough.

    ``met`` has key, doc_id, n_shingles, label. A pair goes on if its sizes allow the similarity and its
    one-byte sketches agree in a share of bins no more than five standard deviations below it (one pair
    in three million at the very threshold is missed). A pair is looked at only in the bucket of its
    first common band, so it comes once. Large buckets are cut into tiles that meet pairwise, so a task
    holds two tiles at most.
    """
    probes, band_probes = K.probe_table(SIGNATURE), K.probe_table(bands * rows)
    j = percent / 100
    chance = j + (1 - j) / 256
    least = SIGNATURE * (chance - 5 * (chance * (1 - chance) / SIGNATURE) ** 0.5)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in K.chunks(batch.column("text"), bins=SIGNATURE):
                h, doc = K.distinct_sorted(*K.shingle_hashes(*K.word_hashes(c), shingle))
                low = K.mix(K.one_permutation(h, doc, c.n, SIGNATURE, probes)).astype(np.uint8)
                keys = band_keys(K.one_permutation(h, doc, c.n, bands * rows, band_probes), bands, rows)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(c.first_row, c.n), pa.array([x.tobytes() + k.tobytes() for x, k in zip(low, keys)], pa.binary())], ["id", "sign"])

    signs = only(docs.select("doc_id", "text"), "doc_id", met.select("doc_id")).mapInArrow(lean(sign), "id long, sign binary")
    cuts = met.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > TILE).select(F.col("key").alias("k"), F.ceil(F.col("n") / TILE).alias("many"))
    if cuts.count() <= BROADCAST_IDS:  # a row per TILE rows of ``met`` at most
        cuts = F.broadcast(cuts)  # a hot bucket's rows stay where they are
    tiles = (
        met.join(cuts, F.col("key") == F.col("k"), "left").withColumn("cuts", F.coalesce("many", F.lit(1).cast("long"))).withColumn("own", F.pmod(F.xxhash64("doc_id"), "cuts"))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cuts") - 1)))
        .select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") <= F.col("other")).alias("left"), "doc_id", "n_shingles", "label")
    )
    signed = tiles.join(signs, F.col("doc_id") == F.col("id")).drop("id")
    signed = signed.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "doc_id")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (key, i, jj), part in grouped(batches, ("key", "i", "j")):
            ids, n, label = (part.column(x).to_numpy() for x in ("doc_id", "n_shingles", "label"))
            left = part.column("left").to_numpy(zero_copy_only=False)
            raw = np.frombuffer(b"".join(part.column("sign").to_pylist()), np.uint8).reshape(len(ids), -1)
            sig, keys = raw[:, :SIGNATURE], np.ascontiguousarray(raw[:, SIGNATURE:]).view(np.int64)
            a = np.arange(len(ids)) if i == jj else np.flatnonzero(left)
            b = a if i == jj else np.flatnonzero(~left)
            found: list[np.ndarray] = [np.zeros((2, 0), np.int64)]
            for x in a:
                y = b[b > x] if i == jj else b
                y = y[(label[y] != label[x]) & (ids[y] != ids[x]) & (100 * np.minimum(n[y], n[x]) >= percent * np.maximum(n[y], n[x]))]
                if len(y):
                    common = keys[y] == keys[x]
                    y = y[common.any(1) & (keys[x][common.argmax(1)] == key)]
                    y = y[(sig[y] == sig[x]).sum(1) >= least]
                    found.append(np.stack([np.minimum(ids[x], ids[y]), np.maximum(ids[x], ids[y])]))
            both = np.concatenate(found, axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], ["a", "b"])

    return signed.mapInArrow(lean(compare), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS, shingle: int = K.SHINGLE) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept.

    Words are runs of other characters than space and tab to carriage return, A-Z lower-cased; a set is
    the distinct shingles of a whole text, a shorter text being one shingle. component_id is the least
    doc_id reachable over links, kept tells whether it is the row's own. Null, empty and wordless texts
    have an empty set and link with nothing. Rows that repeat a doc_id are one document that links by
    any of its texts. A null doc_id stays alone: component_id is null and kept true. Other columns of
    ``docs`` are not read, whatever their names. An empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sk = stored(sketches(docs, bands, rows, shingle), "sketches")
    known = sk.filter("doc_id is not null and same is not null")
    groups = known.groupBy("same").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    copied = groups.filter("first <> last").select(F.col("same").alias("of"), "first")
    if copied.count() <= BROADCAST_COPIED:
        copied = F.broadcast(copied)  # the sketches stay where they are, and so does a hot group of copies
    marked = known.select("doc_id", "same", "n_shingles", "bands").join(copied, F.col("same") == F.col("of"), "left")
    copies = marked.filter("first is not null and doc_id <> first").select("first", "doc_id")

    single = marked.filter("first is null or doc_id = first")
    bucketed = single.select(F.explode("bands").alias("key"), "doc_id", "n_shingles")
    heads = bucketed.groupBy("key").agg(F.min(F.struct("doc_id", "n_shingles")).alias("head"), F.max("doc_id").alias("top")).filter("head.doc_id <> top")
    shared = heads.select(F.col("key").alias("bucket"), F.col("head.doc_id").alias("center"), F.col("head.n_shingles").alias("n_center"))
    met = bucketed.join(shared, F.col("key") == F.col("bucket")).filter("doc_id <> center").select("key", "center", "n_center", "doc_id", "n_shingles")
    met = stored(met, "buckets")
    fits = f"100 * least(n_center, n_shingles) >= {percent} * greatest(n_center, n_shingles)"
    stars = met.filter(fits).select(F.col("center").alias("a"), F.col("doc_id").alias("b")).distinct()
    links = confirmed(stars, docs, percent, shingle)
    first = components(copies.select(F.col("first").alias("a"), F.col("doc_id").alias("b")).distinct().union(links))

    # Second round: what one bucket still holds in different components.
    labels = first.select(F.col("node").alias("id"), F.col("component").alias("label"))
    placed = met.join(labels, F.col("doc_id") == F.col("id"), "left").select(
        "key", "center", "doc_id", "n_shingles", F.coalesce("label", "doc_id").alias("label")
    )
    open_keys = placed.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select(F.col("key").alias("k"))
    open_rows = stored(placed.join(open_keys, F.col("key") == F.col("k")).select("key", "doc_id", "n_shingles", "label"), "open")
    rest = likely(open_rows, docs, percent, bands, rows, shingle)
    more = confirmed(rest, docs, percent, shingle)
    joined = components(first.filter("node <> component").toDF("a", "b").union(more))
    out = sk.join(joined, F.col("doc_id") == F.col("node"), "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
