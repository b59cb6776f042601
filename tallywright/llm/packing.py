"""Best-fit packing of tokenised documents with Martello-Toth dominance reduction.

Packing depends on lengths only, and there are at most ``capacity`` of them, so the driver packs a
histogram: every step below handles all pieces of one length at once, and the plan's size depends on
the capacity, not on the corpus. The pieces then take their places by their rank within their length.

Reduction: for every remaining length, longest first and again until nothing changes, a set is fixed for
good where it dominates all others that could hold it: the length alone if nothing fits beside it; with
the longest that fits, if that fills the sequence, if no two remaining pieces fit beside it or if no three
do and no two are longer together; with two others, if no three fit and any one or two that fit can be
dealt to these two. What no rule fixes is packed best-fit, in descending length.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallywright.llm import kernels as K
from tallywright.llm.common import stored
from tallywright.llm.streams import lean
from tallywright.llm.tokenids import Encoder

CAPACITY = 2048
END_ID = 0
#: Slices of one length are ranked independently; there are so many that one holds about this many pieces.
SLICE_ROWS = 100_000


@dataclass
class Plan:
    """Where the pieces of each length go: runs of (pieces, first sequence, pieces a sequence, offset)."""

    runs: dict[int, list[tuple[int, int, int, int]]] = field(default_factory=dict)
    sequences: int = 0
    fixed: int = 0

    def add(self, length: int, pieces: int, first: int, each: int, offset: int) -> None:
        self.runs.setdefault(length, []).append((pieces, first, each, offset))

    def fix(self, left: _Lengths, lengths: tuple[int, ...], k: int) -> None:
        """``k`` sequences of one piece of each of ``lengths``."""
        offset = 0
        for x in dict.fromkeys(lengths):
            each = lengths.count(x)
            self.add(x, each * k, self.sequences, each, offset)
            left.take(x, each * k)
            offset += each * x
        self.sequences, self.fixed = self.sequences + k, self.fixed + k


class _Lengths:
    """Remaining counts by length, with the shortest and the longest that fits."""

    def __init__(self, counts: dict[int, int]):
        self.n = {k: v for k, v in counts.items() if v > 0}
        self.order = sorted(self.n)

    def take(self, length: int, k: int) -> None:
        self.n[length] -= k
        if not self.n[length]:
            del self.n[length]
            self.order.pop(bisect.bisect_left(self.order, length))

    def most(self, room: int) -> int | None:
        i = bisect.bisect_right(self.order, room)
        return self.order[i - 1] if i else None

    def shortest(self, k: int) -> list[int]:
        out: list[int] = []
        for x in self.order:
            out += [x] * min(k - len(out), self.n[x])
            if len(out) == k:
                break
        return out


def _reduce(left: _Lengths, capacity: int, plan: Plan) -> None:
    """Fix dominating sets for every length, longest first and in bulk, until a pass over all fixes none."""
    found = True
    while found:
        found = False
        for top in reversed(left.order.copy()):
            while top in left.n and _fixed(left, top, capacity, plan):
                found = True


def _fixed(left: _Lengths, top: int, capacity: int, plan: Plan) -> bool:
    """Fix sequences with ``top`` whose set dominates every other set with it; False if no rule holds.

    A set dominates another if the other's pieces can be dealt to its own so that each holds what it gets.
    """
    room, have = capacity - top, left.n[top]
    others = lambda x: left.n[x] - (x == top)  # noqa: E731 - without the piece that is to be placed
    mate = left.most(room)
    if mate == top and have == 1:
        mate = left.most(top - 1)
    if mate is None:
        plan.fix(left, (top,), have)
        return True
    small = left.shortest(4)
    if top in small:
        small.remove(top)
    small = small[:3]
    k = have // 2 if mate == top else min(have, left.n[mate])
    if top + mate == capacity or len(small) < 2 or small[0] + small[1] > room:
        plan.fix(left, (top, mate), k)
        return True
    if len(small) == 3 and sum(small) <= room:
        return False
    a, b = _best_two(left, others, room)
    if mate >= a + b:
        plan.fix(left, (top, mate), k)
        return True
    if mate <= b and _most_smaller(left, others, room) <= a:
        # as long as no length runs out, the same holds for the next one
        plan.fix(left, (top, a, b), max(1, min(have, left.n[a], left.n[b]) // 3 - 1))
        return True
    return False


def _best_two(left: _Lengths, others: Callable[[int], int], room: int) -> tuple[int, int]:
    """The two other lengths with the largest sum within ``room``, of which there are some."""
    best, lo, hi = (0, 0), 0, bisect.bisect_right(left.order, room) - 1
    while lo <= hi:
        a, b = left.order[lo], left.order[hi]
        if not others(a):
            lo += 1
        elif a + b > room or others(b) < 1 + (lo == hi):
            hi -= 1
        else:
            if a + b > sum(best):
                best = (a, b)
            lo += 1
    return best


def _most_smaller(left: _Lengths, others: Callable[[int], int], room: int) -> int:
    """The greatest length that another one, as long or longer, fits beside in ``room``."""
    for i in range(bisect.bisect_right(left.order, room // 2) - 1, -1, -1):
        x = left.order[i]
        if others(x):
            y = x if others(x) > 1 else next((z for z in left.order[i + 1 : i + 3] if others(z)), room)
            if x + y <= room:
                return x
    return 0


def _best_fit(left: _Lengths, capacity: int, plan: Plan) -> None:
    """Best-fit in descending length; equal sequences are filled in one step."""
    groups: dict[int, list[tuple[int, int]]] = {}  # free room: runs of sequences (first, count)
    rooms: list[int] = []

    def put(room: int, first: int, count: int) -> None:
        if count and room:
            if room not in groups:
                bisect.insort(rooms, room)
                groups[room] = []
            groups[room].append((first, count))

    for length in reversed(left.order):
        n = left.n[length]
        while n:
            i = bisect.bisect_left(rooms, length)
            if i < len(rooms):
                room = rooms[i]
                first, count = groups[room].pop()
                if not groups[room]:
                    del groups[room]
                    rooms.pop(i)
            else:
                room, first, count = capacity, plan.sequences, -(-n // (capacity // length))
                plan.sequences += count
            each = room // length
            full = min(count, n // each)
            if full:
                plan.add(length, full * each, first, each, capacity - room)
                n -= full * each
                put(room - full * 0 - each * length, first, full)
                first, count = first + full, count - full
            if n and count and n < each:
                plan.add(length, n, first, n, capacity - room)
                put(room - n * length, first, 1)
                first, count, n = first + 1, count - 1, 0
            put(room, first, count)


def plan_packing(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """A plan for ``counts`` pieces of each length from 1 to ``capacity``."""
    plan, left = Plan(), _Lengths(counts)
    _reduce(left, capacity, plan)
    _best_fit(left, capacity, plan)
    return plan


PIECE = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids and ``end_id``, cut at ``capacity``."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = Encoder.of(tokenizer_path), end_id.to_bytes(4, "little")
        for batch in batches:
            docs_of, rows = batch.column("doc_id").to_pylist(), []
            for c in K.chunks(batch.column("text")):
                ids, bounds = encoder.chunk(c)
                raw, bounds = ids.astype("<u4").tobytes(), (4 * bounds).tolist()
                for k in range(c.n):
                    data = raw[bounds[k] : bounds[k + 1]] + end
                    for i, at in enumerate(range(0, len(data), 4 * capacity)):
                        part = data[at : at + 4 * capacity]
                        rows.append((docs_of[c.first_row + k], i, at // 4, len(part) // 4, zlib.crc32(part)))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), PIECE)] if rows else [pa.array([], f.type) for f in PIECE], schema=PIECE)

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(lean(each), "doc_id long, piece int, start long, length long, ids_crc32 long")


def packed(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Every piece of ``docs`` (doc_id, text) with its sequence_id and its offset there.

    Null and empty texts are one piece, the end id. Documents of at most ``capacity`` ids stay whole.
    Repeated rows and null doc_ids are packed like any others. Other columns are not read. An empty
    table gives no rows.

    The driver gets the number of pieces of each length: ``capacity`` numbers at most.
    """
    spark = docs.sparkSession
    cut = stored(pieces(docs, tokenizer_path, capacity, end_id), "pieces")
    slices = 64 + cut.count() // SLICE_ROWS
    cut = cut.withColumn("slice", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(slices)).cast("int"))
    tally = stored(cut.groupBy("length", "slice").agg(F.count("*").alias("n")), "tally")
    counts = {int(r.length): r.n for r in tally.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = plan_packing(counts, capacity)
    runs = []
    for length, parts in plan.runs.items():
        at = 0
        for n, first, each, offset in parts:
            runs.append((length, at, at + n, first, each, offset))
            at += n
    before = Window.partitionBy("length").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    start_df = tally.select(F.col("length").alias("l"), F.col("slice").alias("s"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    by_length: dict[int, list] = {}
    for length, *run in runs:
        by_length.setdefault(length, []).append(tuple(run))
    run_df = spark.createDataFrame([(k, v) for k, v in by_length.items()], "k long, runs array<struct<lo:long,hi:long,first:long,each:long,offset:long>>")
    in_slice = Window.partitionBy("length", "slice").orderBy("doc_id", "piece", "ids_crc32")
    ranked = cut.withColumn("r", F.row_number().over(in_slice) - 1)
    ranked = ranked.join(start_df, F.expr("length = l and slice = s")).withColumn("r", F.col("r") + F.col("ahead"))
    # A row per length, so at most ``capacity``; its runs are bounded by the capacity too.
    placed = ranked.join(F.broadcast(run_df), F.col("length") == F.col("k"))
    placed = placed.withColumn("run", F.expr("filter(runs, x -> x.lo <= r and r < x.hi)[0]"))
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        F.expr("run.first + (r - run.lo) div run.each").alias("sequence_id"),
        F.expr("run.offset + ((r - run.lo) % run.each) * length").alias("offset"),
    )
