"""Variable-capacity best-fit packing of documents into training sequences.

Documents longer than the greatest length are cut into pieces of it.  Pieces are numbered in the order
of a hash and every ``pack_rows`` of them are a pack, however often an id repeats; each pack is packed on its own, so any number of executors share the work and only each pack's last bins are
not full.  Within a pack, longest first, a piece goes to the open bin that it fills best.  If none has room, a bin is
opened of that permitted length which costs least for what the remaining pieces could fill of it.  At the end each
bin shrinks to the least permitted length that holds its content.
"""

from __future__ import annotations

import bisect
from collections import Counter
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.ordering import positions
from tidemark.llm.pieces import token_counts
from tidemark.session import stage


@dataclass(frozen=True)
class Settings:
    """Permitted sequence lengths, the fixed cost of a sequence beside its length, and pieces in a pack."""

    lengths: tuple[int, ...] = (1024, 2048, 4096, 8192)
    sequence_cost: int = 64
    pack_rows: int = 16384


class Sizes:
    """How many pieces of each size are left; the greatest size within a limit."""

    def __init__(self, sizes: list[int]):
        self.count = Counter(sizes)
        self.order = sorted(self.count)

    def take(self, size: int) -> None:
        self.count[size] -= 1
        if not self.count[size]:
            del self.order[bisect.bisect_left(self.order, size)]

    def fill(self, room: int) -> int:
        """What of so much room the remaining pieces fill, the largest that fits always first."""
        left, limit = room, room
        while limit > 0:
            k = bisect.bisect_right(self.order, min(left, limit))
            if not k:
                break
            size = self.order[k - 1]
            left -= size * min(self.count[size], left // size)
            limit = size - 1
        return room - left


def pack(sizes: list[int], settings: Settings) -> list[tuple[int, int, int]]:
    """(bin, offset, bin length) for each size; bins are numbered in the order they are opened."""
    lengths = sorted(settings.lengths)
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    left = Sizes(sizes)
    rooms: list[tuple[int, int]] = []  # (room, bin) of open bins, sorted
    used: list[int] = []
    placed: list[tuple[int, int]] = [(0, 0)] * len(sizes)
    for i in order:
        size = sizes[i]
        left.take(size)
        k = bisect.bisect_left(rooms, (size, -1))
        if k < len(rooms):
            room, b = rooms.pop(k)
        else:
            def cost(length: int) -> tuple[float, int]:
                return (settings.sequence_cost + length) / (size + left.fill(length - size)), length
            b, room = len(used), min((c for c in lengths if c >= size), key=cost)
            used.append(0)
        placed[i] = b, used[b]
        used[b] += size
        if room > size:
            bisect.insort(rooms, (room - size, b))
    final = [next(c for c in lengths if c >= u) for u in used]
    return [(b, offset, final[b]) for b, offset in placed]


def pieces_of(sized: DataFrame, settings: Settings) -> DataFrame:
    """(doc_id, piece, start, length) of rows (doc_id, size); sizes under 1 give nothing."""
    most = max(settings.lengths)
    cut = sized.where(F.col("size") > 0).withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(most).cast("long"))))
    return cut.select(
        "doc_id", F.call_function("div", F.col("start"), F.lit(most)).cast("int").alias("piece"), "start",
        F.least(F.lit(most).cast("long"), F.col("size") - F.col("start")).cast("int").alias("length"),
    )


def best_fit(sized: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, piece, start, length, pack, bin, offset, bin_length: where each piece of each row (doc_id, size) lies.

    Rows of size null or under 1 take no room and do not appear.  Repeated rows are packed each for itself, in the
    order of id, start and length, and may lie in neighbouring packs; null ids are packed like others.  An empty table gives no rows.
    """
    if not settings.lengths or min(settings.lengths) < 1:
        raise ValueError("sequence lengths must be positive")
    # written first: numbering looks at its rows twice, and sizes may be costly
    pieces = stage(pieces_of(sized.select("doc_id", F.col("size").cast("long").alias("size")), settings))
    mixed = pieces.select("*", F.lit(0).alias("all"), F.xxhash64("doc_id", "piece").alias("mix"))
    numbered = positions(mixed, "all", ["mix", "doc_id", "start", "length"])
    dealt = numbered.select("doc_id", "piece", "start", "length", F.call_function("div", F.col("pos"), F.lit(settings.pack_rows)).cast("int").alias("pack"))
    kind = sized.schema["doc_id"].dataType.simpleString()

    def run(one: pd.DataFrame) -> pd.DataFrame:
        one = one.sort_values(["doc_id", "start", "length"], kind="stable", na_position="first")
        placed = pack(one["length"].tolist(), settings)
        return one.assign(bin=[p[0] for p in placed], offset=[p[1] for p in placed], bin_length=[p[2] for p in placed])

    return dealt.groupBy("pack").applyInPandas(run, f"doc_id {kind}, piece int, start long, length int, pack int, bin int, offset int, bin_length int")


def pack_documents(docs: DataFrame, settings: Settings = Settings(), model: str | None = None) -> DataFrame:
    """``best_fit`` of whole texts; a text's size is its pieces in a public vocabulary and one end mark."""
    sized = token_counts(docs, model).select("doc_id", (F.col("n_tokens") + 1).alias("size"))
    return best_fit(sized, settings)
