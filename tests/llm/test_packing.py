import random
import zlib
from collections import Counter
from math import ceil

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tallywright.llm import kernels as K
from tallywright.llm import packing, tokenids

from .cases import DOC_SCHEMA, documents

PATH = public_tokenizers.path("word_bpe_49k.json")


def check(placed, capacity):
    """placed: (sequence, offset, length). Sequences are gapless from 0 and hold at most capacity."""
    by = {}
    for s, o, n in placed:
        by.setdefault(s, []).append((o, n))
    for parts in by.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= capacity
    return len(by)


def spread(plan):
    return [(first + i // each, offset + i % each * length, length) for length, runs in plan.runs.items() for n, first, each, offset in runs for i in range(n)]


def best_fit(counts, capacity):
    rooms = []
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            fit = [r for r in rooms if r >= length]
            if fit:
                rooms.remove(min(fit))
                rooms.append(min(fit) - length)
            else:
                rooms.append(capacity - length)
    return len(rooms)


@pytest.mark.parametrize("seed", range(8))
def test_plans(seed):
    draw = random.Random(seed)
    for _ in range(60):
        capacity = draw.choice([7, 20, 100])
        counts = Counter(draw.randint(1, draw.choice([capacity, max(1, capacity // 3)])) for _ in range(draw.randrange(70)))
        plan = packing.plan_packing(dict(counts), capacity)
        placed = spread(plan)
        assert Counter(n for _, _, n in placed) == counts
        assert check(placed, capacity) == plan.sequences <= best_fit(counts, capacity)


def optimum(items, capacity):
    """The least number of sequences, over all subsets of few items."""
    fits = [m for m in range(1, 1 << len(items)) if sum(x for i, x in enumerate(items) if m >> i & 1) <= capacity]
    best = [0] + [len(items)] * ((1 << len(items)) - 1)
    for m in range(1, 1 << len(items)):
        low = m & -m
        best[m] = min(1 + best[m ^ f] for f in fits if f & low and f & m == f)
    return best[-1]


@pytest.mark.parametrize("seed", range(4))
def test_reduction_keeps_an_optimum(seed):
    """What the reduction fixes, and the best packing of the rest, is a best packing; every rule is met."""
    draw, seen = random.Random(seed), set()
    for _ in range(150):
        capacity = draw.choice([10, 23, 50])
        counts = Counter(draw.randint(max(1, capacity // draw.choice([4, 5, 9])), capacity) for _ in range(draw.randrange(1, 9)))
        plan, left = packing.Plan(), packing._Lengths(dict(counts))
        packing._reduce(left, capacity, plan)
        check(spread(plan), capacity)
        rest = [x for x, n in left.n.items() for _ in range(n)]
        assert plan.fixed + optimum(rest, capacity) == optimum(list(counts.elements()), capacity)
        seen.update(Counter(s for s, _, _ in spread(plan)).values())
    assert seen == {1, 2, 3}


def test_fixed_share_on_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    counts = {r.length: r["count"] for r in packing.pieces(docs, PATH).groupBy("length").count().collect()}
    plan = packing.plan_packing(counts)
    assert plan.sequences == ceil(sum(k * v for k, v in counts.items()) / 2048)
    assert plan.fixed - counts[2048] > 10  # more than the full pieces


def test_large_counts_stay_small():
    counts = {n: 1_000_000 // n for n in range(1, 2049)}
    plan = packing.plan_packing(counts, 2048)
    assert sum(map(len, plan.runs.values())) < 50_000
    assert plan.sequences <= 1.01 * ceil(sum(k * v for k, v in counts.items()) / 2048)


def test_runs_give_the_tokenizers_ids(monkeypatch):
    monkeypatch.setattr(tokenids, "REMEMBERED", 200)
    draw, tokenizer, encoder = random.Random(1), Tokenizer.from_file(PATH), tokenids.Encoder(PATH)
    parts = ["a", "B", "é", "e\u0301", " ", "\n", "\u00a0", "\u0301", "Σ", "σ", "'s", "<|endoftext|>", "1", "½", "!!", "\x1c", "\x85", "ß", "İ", "\u200b", "\t\t", "'", "ll", "😀", "\u3000", "É", "Ž", "×", "÷", "ſ", "ª", "»", "<", "|", "22", "the", "\x00", "ŉ", "don't", "."]
    for most in (7, 300, 1 << 20):
        for _ in range(40):
            texts = ["".join(draw.choice(parts) for _ in range(draw.randrange(30))) for _ in range(50)] + [None]
            for c in K.chunks(pa.array(texts, pa.string()), most):
                ids, bounds = encoder.chunk(c)
                for k in range(c.n):
                    text = texts[c.first_row + k] or ""
                    assert ids[bounds[k] : bounds[k + 1]].tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_documents(spark):
    df = documents(spark)
    got = packing.packed(df, PATH).collect()
    tokenizer, want = Tokenizer.from_file(PATH), []
    for r in df.collect():
        ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids + [0]
        for i in range(0, len(ids), 2048):
            part = ids[i : i + 2048]
            want.append((r.doc_id, i // 2048, i, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=key) == sorted(want, key=key)
    n = check([(r.sequence_id, r.offset, r.length) for r in got], 2048)
    assert n == best_fit(Counter(w[3] for w in want), 2048)
    assert packing.packed(spark.createDataFrame([], DOC_SCHEMA), PATH).collect() == []
