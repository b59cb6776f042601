"""Near-duplicate embeddings by a pivot-permutation index.

Reference vectors (pivots) are drawn from a bounded sample, none close to another. A vector is described by
its PREFIX nearest pivots. A link is a pair that shares at least SHARED of them and whose cosine in double
precision reaches the bound; neither the number of vectors nor the way they are laid out enters into it.

Every pair that shares SHARED pivots meets. Pivots have numbers, and a vector stands in the inverted lists of
its pivots with the lowest numbers, all but the SHARED - 1 last: there a pair has its lowest common pivot. A
long list is split by a second pivot and again by a third where that makes the lists shorter; a pair then has
its two or three lowest common pivots in one list. In other lists where it meets it is passed over, so each
link counts once. Lists are worked through in blocks that hold a bounded number of vectors while those of the
blocks after them stream past; a block gives counts and a spanning forest of its links, never its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywright.llm.common import BROADCAST_IDS, stored
from tallywright.llm.components import components

COSINE = 0.95
PREFIX = 8
SHARED = 3
#: Pivots at most, whatever the number of vectors; they are drawn from SAMPLE vectors by a hash of vec_id.
PIVOTS = 512
SAMPLE = 4096
#: Vectors of a list by one pivot, and of one by two, beyond which it is split by one more. Links don't depend on it.
ONE_PIVOT, TWO_PIVOTS = 8192, 8192
#: Vectors that a block holds, and that meet them at a time.
BLOCK = 2048
STREAM = 512


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.flatten() if not isinstance(column, pa.ChunkedArray) else column.combine_chunks().flatten()
    return np.asarray(flat.to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow in the squares
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _spread(sample: np.ndarray, n: int, apart: float) -> np.ndarray:
    """n of the sample's rows, each the farthest from those before it; fewer where the rest has a cosine of ``apart`` to one.

    Pivots closer than links are long would tell linked vectors apart.
    """
    chosen, near = [0], sample @ sample[0]
    while len(chosen) < min(n, len(sample)) and near.min() < apart:
        i = int(near.argmin())
        chosen.append(i)
        near = np.maximum(near, sample @ sample[i])
    return sample[chosen]


def usable(vectors: DataFrame, all_rows: bool = False) -> DataFrame:
    """vec_id, v of the rows that can link: whole finite vectors that aren't zero; of ``all_rows`` with a null v elsewhere."""
    single = dict(vectors.dtypes)["embedding"] == "array<float>"
    v = F.col("embedding") if single else F.col("embedding").cast("array<double>")
    finite = F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf")).cast("double")))
    good = F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda e: e != 0)
    good = F.coalesce(good, F.lit(False))
    kept = vectors if all_rows else vectors.filter(good)
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(good, v).alias("v"))


def _described(rows: DataFrame, pivots: np.ndarray, dim: int) -> DataFrame:
    """rep, copies, v and near: the numbers of the PREFIX nearest pivots, lowest first."""
    sent = rows.sparkSession.sparkContext.broadcast(pivots)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _unit(_matrix(batch.column("v"), dim))
            k = min(PREFIX, len(sent.value))
            near = np.sort(np.argsort(-(x @ sent.value.T), axis=1, kind="stable")[:, :k], axis=1).astype(np.int32)
            lists = pa.ListArray.from_arrays(np.arange(0, near.size + 1, k, dtype=np.int32), pa.array(near.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column("rep"), batch.column("copies"), batch.column("v"), lists], ["rep", "copies", "v", "near"])

    return rows.mapInArrow(each, f"rep long, copies long, v {dict(rows.dtypes)['v']}, near array<int>")


def _placed(described: DataFrame, n_pivots: int) -> DataFrame:
    """list, block, role, rep, copies, v, near: role 0 where a vector is held, 1 where it meets the held ones.

    The pivots of a list are the digits of its number to the base 4096, each plus one. A vector is held in one
    block of a list and meets those before it.
    """
    prefix, shared = min(PREFIX, n_pivots), min(SHARED, n_pivots)
    bounds = [ONE_PIVOT, TWO_PIVOTS, float("inf")][: shared - 1] + [float("inf")]
    digit = F.get("near", "at").cast("long") + 1
    rows = described.withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(prefix - shared)))).withColumn("list", digit)
    out = None
    for depth, bound in enumerate(bounds, 1):
        last = prefix - shared + depth
        sizes = rows.groupBy("list").agg(F.count("*").alias("n")).filter(F.col("n") > min(BLOCK, bound))
        sizes = stored(sizes, "lists")
        split, n_split = None, 0
        if bound < float("inf"):
            # a split is worth while where it leaves fewer pairs that meet
            long = sizes.filter(F.col("n") > bound).withColumnRenamed("list", "of")
            parted = rows.join(F.broadcast(long), F.col("list") == F.col("of"))  # no more than there are sets of pivots
            parted = parted.withColumn("at", F.explode(F.sequence(F.col("at") + 1, F.lit(last)))).withColumn("list", F.col("of") * 4096 + digit)
            parts = parted.groupBy("of", "n", "list").agg(F.count("*").alias("m")).groupBy("of", "n").agg(F.sum(F.col("m") * F.col("m")).alias("after"))
            split = stored(parts.filter(F.col("after") < F.col("n") * F.col("n")).select("of"), "split")
            n_split = split.count()
        if n_split:
            sizes = sizes.join(F.broadcast(split), F.col("list") == F.col("of"), "left_anti")
        blocks = sizes.filter(F.col("n") > BLOCK).select(F.col("list").alias("large"), F.ceil(F.col("n") / BLOCK).alias("blocks"))
        n_blocks = blocks.count()
        if n_blocks <= BROADCAST_IDS:
            blocks = F.broadcast(blocks)
        here = rows.join(F.broadcast(split), F.col("list") == F.col("of"), "left_anti") if n_split else rows
        if n_blocks:
            here = here.join(blocks, F.col("list") == F.col("large"), "left")
            own = F.pmod(F.xxhash64("rep"), F.coalesce("blocks", F.lit(1).cast("long")))
            here = here.withColumn("own", own).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), "own"))).withColumn("role", (F.col("block") < F.col("own")).cast("int"))
        else:
            here = here.withColumn("block", F.lit(0).cast("long")).withColumn("role", F.lit(0))
        here = here.select("list", "block", "role", "rep", "copies", "v", "near")
        out = here if out is None else out.union(here)
        if not n_split:
            break
        rows = rows.join(F.broadcast(split), F.col("list") == F.col("of"))
        rows = rows.withColumn("at", F.explode(F.sequence(F.col("at") + 1, F.lit(last)))).withColumn("list", F.col("of") * 4096 + digit).drop("of")
    return out


def _linked(described: DataFrame, dim: int, n_pivots: int, cosine: float) -> DataFrame:
    """(rep, n, other): links counted with their copies, and one edge of a spanning forest, null if none."""
    shared, words = min(SHARED, n_pivots), -(-n_pivots // 64)
    rows = _placed(described, n_pivots).repartition("list", "block").sortWithinPartitions("list", "block", "role", "near")

    def bits(near: np.ndarray) -> np.ndarray:
        out = np.zeros((len(near), words), np.uint64)
        for j in range(near.shape[1]):
            out[np.arange(len(near)), near[:, j] >> 6] |= np.uint64(1) << (near[:, j] & 63).astype(np.uint64)
        return out

    def load(batch: pa.RecordBatch) -> tuple:
        near = np.asarray(batch.column("near").flatten().to_numpy(zero_copy_only=False)).reshape(batch.num_rows, -1)
        return batch.column("rep").to_numpy(), batch.column("copies").to_numpy(), _unit(_matrix(batch.column("v"), dim)), near, bits(near)

    def shares(q: np.ndarray, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(q), len(x)), np.int16)
        for w in range(words):
            out += np.bitwise_count(q[:, None, w] & x[None, :, w])
        return out

    def counted(link: np.ndarray, q: np.ndarray, q_copies: np.ndarray, x: np.ndarray, x_copies: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Each one's links and the least id of its component inside the block."""
        most, low_q, low_x = np.iinfo(np.int64).max, q.copy(), x.copy()
        while True:
            new_q = np.minimum(low_q, np.where(link, low_x[None, :], most).min(1))
            new_x = np.minimum(low_x, np.where(link, new_q[:, None], most).min(0))
            if (new_q == low_q).all() and (new_x == low_x).all():
                break
            low_q, low_x = new_q, new_x
        for ids, n, low in ((q, link @ x_copies, low_q), (x, q_copies @ link, low_x)):
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n.astype(np.int64)), pa.array(low, mask=low == ids)], ["rep", "n", "other"])

    def meet(number: int, looking: tuple, held: tuple, itself: int | None = None) -> Iterator[pa.RecordBatch]:
        """Links of the list between the looking and the held; ``itself``: where the looking stand among the held."""
        pivots = []
        while number:
            number, d = divmod(number, 4096)
            pivots.insert(0, d - 1)
        depth = len(pivots)
        q_rep, q_copies, q, q_near, q_mask = looking
        rep, copies, x, near, mask = held if itself is None else (p[: itself + len(q)] for p in held)
        at = np.arange(len(rep))
        if len(at) > STREAM and (q_near[0, :depth] == q_near[-1, :depth]).all() and (q_near[0, :depth] != pivots).any():
            # rows are sorted, so all that look have these lowest pivots; they meet those with the same in the list of these
            at = np.flatnonzero((near[:, :depth] != q_near[0, :depth]).any(1))
        link = (q @ x[at].T >= cosine) & (q_rep[:, None] != rep[None, at])
        if itself is not None:
            link &= itself + np.arange(len(q))[:, None] > at[None, :]
        for checked in (False, True):
            a, b = np.flatnonzero(link.any(1)), np.flatnonzero(link.any(0))
            if not len(a):
                return
            link, at = link[np.ix_(a, b)], at[b]
            q_rep, q_copies, q_mask = q_rep[a], q_copies[a], q_mask[a]
            if not checked:
                below = np.array([(1 << min(max(pivots[-1] - 64 * w, 0), 64)) - 1 for w in range(words)], np.uint64)  # those before the list's last
                link &= (shares(q_mask, mask[at]) >= shared) & (shares(q_mask & below, mask[at] & below) == depth - 1)
        yield from counted(link, q_rep, q_copies, rep[at], copies[at])

    def among(number: int, held: tuple) -> Iterator[pa.RecordBatch]:
        for s in range(0, len(held[0]), STREAM):
            yield from meet(number, tuple(p[s : s + STREAM] for p in held), held, s)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, gathered, held = None, [], None
        for batch in batches:
            lists, block, role = (batch.column(c).to_numpy() for c in ("list", "block", "role"))
            cut = np.flatnonzero((np.diff(lists) != 0) | (np.diff(block) != 0) | (np.diff(role) != 0)) + 1
            for at, to in zip([0, *cut.tolist()], [*cut.tolist(), batch.num_rows]):
                if at == to:
                    continue
                key = (int(lists[at]), int(block[at]))
                if gathered and (key != now or role[at]):  # all that the block holds is there
                    if key == now or sum(g.num_rows for g in gathered) > 1:
                        held = tuple(np.concatenate(p) for p in zip(*map(load, gathered)))
                        yield from among(now[0], held)
                    gathered = []
                if key != now:
                    now, held = key, None
                if not role[at]:
                    gathered.append(batch.slice(at, to - at))
                elif held is not None:
                    for s in range(at, to, STREAM):
                        yield from meet(key[0], load(batch.slice(s, min(STREAM, to - s))), held)
        if gathered:
            yield from among(now[0], tuple(np.concatenate(p) for p in zip(*map(load, gathered))))

    return rows.mapInArrow(each, "rep long, n long, other long")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """One row per row of ``vectors`` (vec_id, embedding): vec_id, n_links, component_id, kept.

    Links are pairs found with a cosine of at least ``cosine`` in double precision; nothing below it links.
    Vectors that are null, empty or zero or hold null or non-finite components link with nothing, nor do
    vectors of different lengths. Equal vectors are worked on once and counted as often as they have
    ids; a vec_id that comes with different embeddings counts as one vector for each. component_id is
    the least vec_id reachable, kept tells whether it is the row's own. A null vec_id stays alone:
    component_id is null and kept true. Other columns are not read; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    # vectors are told apart by 128 bits, so that only these go back to the ids
    ready = usable(vectors).withColumns({"h": F.xxhash64("v", F.lit(0)), "g": F.xxhash64(F.lit(1), "v")})
    ids = stored(ready.select("vec_id", "h", "g").distinct(), "ids")
    reps = ids.groupBy("h", "g").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    groups = ready.groupBy("h", "g").agg(F.first("v").alias("v")).join(reps, ["h", "g"])
    groups = stored(groups.select("v", "rep", "copies", "h", "g"), "vectors")
    dims = sorted(r.dim for r in groups.select(F.size("v").alias("dim")).distinct().collect())
    found = None
    for dim in dims:
        rows = groups.filter(F.size("v") == dim)
        sample = rows.select("v", F.xxhash64("rep").alias("h")).orderBy("h").limit(SAMPLE).toPandas()
        pivots = _spread(_unit(np.stack(sample["v"].to_list()).astype(np.float64)), PIVOTS, 2 * cosine - 1)  # twice a link's squared length apart
        links = _linked(stored(_described(rows, pivots, dim), "described"), dim, len(pivots), cosine)
        found = links if found is None else found.union(links)
    if found is None:
        found = spark.createDataFrame([], "rep long, n long, other long")
    found = stored(found, "links")
    linked = found.groupBy("rep").agg(F.sum("n").alias("n")).withColumnRenamed("rep", "linked")
    joined = components(found.filter("other is not null").select("rep", "other").distinct())
    told = groups.select("rep", "copies", "h", "g").join(linked, F.col("rep") == F.col("linked"), "left").join(joined, F.col("rep") == F.col("node"), "left")
    told = told.select("h", "g", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    every = usable(vectors, all_rows=True)
    able = F.col("v").isNotNull()  # the others get a key of their own that is nowhere else, or one task would get them all
    keys = every.select("vec_id", F.when(able, F.xxhash64("v", F.lit(0))).otherwise(F.xxhash64("vec_id")).alias("h"), F.when(able, F.xxhash64(F.lit(1), "v")).alias("g"))
    out = keys.join(told, ["h", "g"], "left").select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
