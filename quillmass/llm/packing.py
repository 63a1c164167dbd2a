"""Best-fit packing (operator 10): token sequences of at most ``capacity`` from whole documents.

A document's ids, then one separator, are cut into pieces only where they exceed the capacity. Pieces are dealt
to groups of bounded size; each group packs best-fit decreasing, and dual feasible functions bound the number
of bins that any packing of the group needs. A group whose bins equal its bound is certified and keeps them
(but for its emptiest bin); groups with a gap give back the pieces of all bins that are not full. What was given
back is dealt anew to fewer groups, which exchanges documents between them, and packed again.

Null texts count as empty (their sequence is the separator alone). Repeated rows and ids are packed row by row.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import cut, release_memory, text_or_empty
from .tokens import _built, broadcast_vocabulary

#: Rows of an Arrow batch that are Python objects at a time.
BATCH_ROWS = 1024
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _encoder(vocabulary: bpe.Vocabulary) -> bpe.ChunkEncoder:
    return bpe.ChunkEncoder(vocabulary, bpe.compiled_encoder(vocabulary))


def pieces(documents: DataFrame, vocabulary: str, capacity: int = 2048, separator: int = 0, with_ids: bool = False) -> DataFrame:
    """One row for each piece of each document. The first piece of a longer document holds the remainder."""
    shared = broadcast_vocabulary(documents.sparkSession, vocabulary)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        release_memory()
        encoder = _built(shared, _encoder, "chunks")
        end = np.array([separator], dtype="<i4").tobytes()
        for batch in (b.slice(at, BATCH_ROWS) for b in batches for at in range(0, b.num_rows, BATCH_ROWS)):
            keys, starts, lengths, numbers, sums, parts = [], [], [], [], [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = encoder.encode_bytes(text) + end
                n = len(data) // 4
                first = n % capacity or capacity
                for k, start in enumerate([0, *range(first, n, capacity)]):
                    stop = first if k == 0 else start + capacity
                    part = data[4 * start : 4 * stop]
                    keys.append(key)
                    numbers.append(k)
                    starts.append(start)
                    lengths.append(stop - start)
                    sums.append(zlib.crc32(part))
                    if with_ids:
                        parts.append(np.frombuffer(part, "<i4"))
            columns = [pa.array(keys, pa.int64()), pa.array(numbers, pa.int32()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(sums, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array(parts, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = PIECE + (", ids array<int>" if with_ids else "")
    return documents.select("doc_id", text_or_empty().alias("text")).mapInArrow(run, schema)


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[int]:
    """The bin of each item: longest items first, each into the fullest bin that still takes it."""
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    bins = [0] * len(lengths)
    room: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by free space
    free: list[int] = []  # the sorted free spaces that some bin has
    opened = 0
    for i in order:
        need = lengths[i]
        at = bisect.bisect_left(free, need)
        if at == len(free):
            b, left = opened, capacity - need
            opened += 1
        else:
            space = free[at]
            b, left = room[space].pop(), space - need
            if not room[space]:
                free.pop(at)
        bins[i] = b
        if left:
            if not room[left]:
                bisect.insort(free, left)
            room[left].append(b)
    return bins


def bins_needed(lengths: list[int], capacity: int) -> int:
    """A lower bound on the bins, by the dual feasible functions u(k) and U(e) of the bin packing literature."""
    counts: dict[int, int] = {}
    for x in lengths:
        counts[x] = counts.get(x, 0) + 1
    items = sorted(counts.items())
    best = -(-sum(x * n for x, n in items) // capacity)
    for k in range(1, 25):
        # u(k): x (k + 1) rounded down, over k, unless it is whole
        total = 0
        for x, n in items:
            whole, rest = divmod(x * (k + 1), capacity)
            total += n * (whole * capacity if rest else x * k)
        best = max(best, -(-total // (k * capacity)))
    for small in sorted({x for x, _ in items if 2 * x <= capacity})[:: max(1, len(items) // 64)]:
        # U(e): items over capacity - e count as whole bins, items under e not at all
        total = sum(n * (capacity if x > capacity - small else x if x >= small else 0) for x, n in items)
        best = max(best, -(-total // capacity))
    return best


def _pack_group(capacity: int, stage: int, last: bool):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "piece", "row_key"], ascending=[False, True, True, True], na_position="first").reset_index(drop=True)
        lengths = rows["length"].tolist()
        bins = pd.Series(best_fit_decreasing(lengths, capacity))
        filled = rows["length"].groupby(bins).transform("sum")
        total = rows["length"].groupby(bins).sum()
        certified = len(total) == bins_needed(lengths, capacity)
        if last:
            keep = pd.Series(True, index=rows.index)
        elif certified:
            emptiest = total.idxmin()
            keep = (bins != emptiest) | (total[emptiest] * 2 > capacity)
        else:
            keep = filled == capacity
        rows["sequence_id"] = (stage << 56) + (int(key[0]) << 28) + bins.astype("int64")
        rows["offset"] = rows["length"].groupby(bins).cumsum() - rows["length"]
        rows["kept"] = keep
        return rows

    return run


def pack(found: DataFrame, capacity: int = 2048, group_rows: int = 20_000, rounds: int = 4) -> DataFrame:
    """Adds sequence_id and offset to pieces. Ids of sequences are unique; offsets leave no gaps.

    ``group_rows`` bounds what one task packs; the last round's groups take whatever is left, dealt to groups
    of that size too, so no round collects an unbounded group. Pieces of full length are sequences of their own.
    """
    if not 0 < capacity < 1 << 24:
        raise ValueError("capacity must be positive")
    names = found.columns
    keyed = found.withColumn("row_key", F.monotonically_increasing_id())
    keyed = cut(keyed)
    whole = keyed.filter(F.col("length") >= capacity).withColumn("sequence_id", -1 - F.col("row_key")).withColumn("offset", F.lit(0).cast("long"))
    left = keyed.filter(F.col("length") < capacity)
    done = [whole.select(*names, "sequence_id", "offset")]
    schema = keyed.schema.simpleString()[len("struct<") : -1].replace(":", " ") + ", sequence_id long, offset long, kept boolean"
    for stage in range(1, rounds + 1):
        n = left.count()
        if not n:
            break
        groups = max(1, -(-n // group_rows))
        last = stage == rounds or groups == 1
        dealt = left.withColumn("_group", F.pmod(F.xxhash64("row_key", F.lit(stage)), F.lit(groups)))
        packed = dealt.groupBy("_group").applyInPandas(_wrapped(_pack_group(capacity, stage, last)), schema)
        packed = cut(packed)
        done.append(packed.filter("kept").select(*names, "sequence_id", "offset"))
        if last:
            break
        left = packed.filter(~F.col("kept")).drop("sequence_id", "offset", "kept")
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def _wrapped(run):
    def of(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return run(key, rows.drop(columns="_group"))

    return of


def pack_documents(documents: DataFrame, vocabulary: str, capacity: int = 2048, separator: int = 0, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids) for every piece of every row."""
    return pack(pieces(documents, vocabulary, capacity, separator, with_ids), capacity)
