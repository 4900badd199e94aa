"""Best-fit packing with swap-based local search.

Documents are encoded and cut in one pass; pieces are dealt to shards of about
``SHARD`` pieces.  Within a shard pieces are packed best-fit in order of length;
then the least full bin gives documents to other underfull bins: it moves one,
or exchanges one for a smaller one, or two for a smaller one, whenever that
raises the sum of squared fills, until it is empty or no exchange is left.
Each step raises an integer that the bins bound, so the search ends.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import staged
from .encode import encoder

END_ID = 2
SHARD = 32_768


def cut_documents(docs: DataFrame, tokenizer: str, ranks: str | None = None, pattern: str | None = None, capacity: int = 1024,
                  with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces (doc_id, piece, start, length, ids_crc32 [, ids]) of at most ``capacity`` tokens.

    A document is its ids and the end id; only longer ones are cut, into pieces
    of ``capacity``, of which the first may be shorter.  A null text counts as
    empty and gives one piece of the end id alone.
    """
    kind = dict(docs.dtypes)[id_col]
    end = np.array([END_ID], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, ranks, pattern)
        for b in batches:
            row, piece, start, length, crc, held = [], [], [], [], [], []
            for i, ids in enumerate(enc.ids_of(t or "" for t in b.column(1).to_pylist())):
                ids += end
                n = len(ids) // 4
                at, stop = 0, (n - 1) % capacity + 1
                for k in range(-(-n // capacity)):
                    part = ids[4 * at:4 * stop]
                    row.append(i)
                    piece.append(k)
                    start.append(at)
                    length.append(stop - at)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        held.append(np.frombuffer(part, "<u4").astype(np.int64))
                    at, stop = stop, stop + capacity
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            cols = [b.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            if with_ids:
                names.append("ids")
                cols.append(pa.array(held, pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins (lists of indices): longest first, each into the fullest bin that takes it."""
    bins: list[list[int]] = []
    by_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
    gaps = 0                                        # bit g: some bin has gap g
    for i in np.argsort(-sizes, kind="stable").tolist():
        n = int(sizes[i])
        fits = gaps >> n
        if fits:
            g = n + (fits & -fits).bit_length() - 1
            b = by_gap[g].pop()
            if not by_gap[g]:
                gaps &= ~(1 << g)
            bins[b].append(i)
        else:
            g, b = capacity, len(bins)
            bins.append([i])
        if g > n:
            by_gap[g - n].append(b)
            gaps |= 1 << (g - n)
    return bins


def local_search(sizes: np.ndarray, bins: list[list[int]], capacity: int) -> list[list[int]]:
    """Empty the least full bins by moves and exchanges that raise the sum of squared fills."""
    fill = np.array([int(sizes[b].sum()) for b in bins], dtype=np.int64)
    stuck = np.zeros(len(bins), dtype=bool)
    while True:
        open_bins = np.flatnonzero((fill > 0) & (fill < capacity))
        open_bins = open_bins[np.argsort(fill[open_bins], kind="stable")]
        gap = capacity - fill[open_bins]
        room = np.cumsum(gap[::-1])[::-1] - gap         # gaps of the fuller bins: a bin that they can't take stays
        able = np.flatnonzero(~stuck[open_bins] & (room >= fill[open_bins]))
        if not len(able):
            return [b for b in bins if b]
        a = int(open_bins[able[0]])
        if _give(sizes, bins, fill, a, open_bins[able[0] + 1:], capacity):
            stuck[:] = False            # gaps have changed: other bins may give now
        else:
            stuck[a] = True


def _give(sizes: np.ndarray, bins: list[list[int]], fill: np.ndarray, a: int, others: np.ndarray, capacity: int) -> bool:
    """Let bin ``a`` give until it is empty or stuck; whether it was emptied."""
    while bins[a] and len(others):
        gap = capacity - fill[others]
        mine = np.array(bins[a], dtype=np.int64)
        x = sizes[mine]
        # a move: the largest document that fits anywhere, into the tightest gap
        fits = x <= gap.max(initial=0)
        if fits.any():
            i = int(mine[fits][x[fits].argmax()])
            room = np.where(gap >= sizes[i], gap, capacity + 1)
            _exchange(sizes, bins, fill, a, int(others[room.argmin()]), [i], [])
            others = others[fill[others] < capacity]
            continue
        # an exchange of one or two documents for a smaller one: the one that fills most.  Of all pairs only
        # their sums matter, and of all documents of a size only the one whose bin has most room
        theirs = np.array([j for b in others.tolist() for j in bins[b]], dtype=np.int64)
        owner = np.repeat(np.arange(len(others)), [len(bins[b]) for b in others.tolist()])
        most = np.lexsort((-gap[owner], sizes[theirs]))
        y, first = np.unique(sizes[theirs][most], return_index=True)
        most = most[first]
        room = gap[owner[most]]
        i, j = np.tril_indices(len(mine), -1)
        sums, which = np.unique(np.concatenate([x, x[i] + x[j]]), return_index=True)
        d = sums[:, None] - y[None, :]
        d[(d <= 0) | (d > room[None, :])] = 0
        at, k = np.unravel_index(int(d.argmax()), d.shape) if d.size else (0, 0)
        if not d.size or d[at, k] == 0:
            return False
        pair = which[at] - len(mine)
        give = [int(mine[which[at]])] if pair < 0 else [int(mine[i[pair]]), int(mine[j[pair]])]
        _exchange(sizes, bins, fill, a, int(others[owner[most[k]]]), give, [int(theirs[most[k]])])
        others = others[(fill[others] < capacity) & (fill[others] >= fill[a])]
    return not bins[a]


def _exchange(sizes, bins, fill, a: int, b: int, give: list[int], take: list[int]) -> None:
    bins[a] = [i for i in bins[a] if i not in give] + take
    bins[b] = [i for i in bins[b] if i not in take] + give
    d = int(sizes[give].sum()) - int(sizes[take].sum())
    fill[a] -= d
    fill[b] += d


def pack_pieces(pieces: DataFrame, capacity: int = 1024, shard: int = SHARD) -> DataFrame:
    """Adds sequence_id and offset to pieces with a ``length`` of at most ``capacity``.

    Sequences are filled without gaps from offset 0 and numbered by shard and bin
    (any numbers, no order).  Pieces are dealt to shards by their row, so repeated
    documents spread; an empty table gives an empty result.
    """
    pieces = staged(pieces, "packing-pieces")
    number = F.monotonically_increasing_id()
    partial = pieces.filter(F.col("length") < capacity)
    shards = max(1, math.ceil(partial.count() / shard))
    dealt = partial.withColumn("shard_", F.pmod(F.xxhash64(number), F.lit(shards)).cast("int"))
    fields = [f for f in pieces.columns]

    def run(key, batch):
        sizes = batch.column("length").to_numpy().astype(np.int64)
        sequence, offset = np.zeros(len(sizes), dtype=np.int64), np.zeros(len(sizes), dtype=np.int64)
        base = key[0].as_py() << 32
        for n, b in enumerate(local_search(sizes, best_fit(sizes, capacity), capacity)):
            sequence[b] = base + n
            offset[b] = np.cumsum(sizes[b]) - sizes[b]
        out = batch.select(fields)
        return out.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    schema = StructType([*pieces.schema.fields, StructField("sequence_id", LongType()), StructField("offset", LongType())])
    # a full piece is a sequence of its own, numbered below 0 where it stands
    full = pieces.filter(F.col("length") >= capacity).withColumns({"sequence_id": -1 - number, "offset": F.lit(0).cast("long")})
    return dealt.groupBy("shard_").applyInArrow(run, schema).unionByName(full)


def pack_documents(docs: DataFrame, tokenizer: str, ranks: str | None = None, pattern: str | None = None, capacity: int = 1024,
                   with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents with their sequence and offset; see ``cut_documents`` and ``pack_pieces``.

    Every row is packed, repeated ones each on their own; null texts count as
    empty, null ids are kept; other columns are ignored.
    """
    return pack_pieces(cut_documents(docs, tokenizer, ranks, pattern, capacity, with_ids, id_col, text_col), capacity)
