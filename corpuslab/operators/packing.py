"""Best-fit packing of token sequences into rows of one length.

``place_sequences`` says where every token of every document goes: what does not fit into a row's last room goes on in a
later row. ``pack_sequences`` is the cropping form, in which that rest is lost.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUFFER_DOCS = 1_000
REFILL_DOCS = 128
ROWS_PER_BATCH = 256
# Documents that are placed together; a group is as large on any cluster.
GROUP_DOCS = 20_000
PACKED_SCHEMA = "part int, row_no long, tokens array<int>, n_docs int, n_cropped long, complete boolean"


class _Buffer:
    """Documents waiting for a row, by length, first come first out among equals."""

    def __init__(self) -> None:
        self.lengths: list[int] = []
        self.waiting: dict[int, deque] = {}
        self.size = 0

    def add(self, doc: np.ndarray | tuple[int, int], size: int | None = None) -> None:
        size = len(doc) if size is None else size
        queue = self.waiting.get(size)
        if queue is None:
            queue = self.waiting[size] = deque()
            insort(self.lengths, size)
        queue.append(doc)
        self.size += 1

    def _take(self, at: int) -> np.ndarray:
        length = self.lengths[at]
        queue = self.waiting[length]
        doc = queue.popleft()
        if not queue:
            del self.waiting[length]
            self.lengths.pop(at)
        self.size -= 1
        return doc

    def longest_within(self, room: int) -> np.ndarray | None:
        at = bisect_right(self.lengths, room) - 1
        return None if at < 0 else self._take(at)

    def shortest(self) -> np.ndarray:
        return self._take(0)


def pack_documents(docs: Iterator[np.ndarray], capacity: int, buffer_docs: int = BUFFER_DOCS, refill: int = REFILL_DOCS):
    """Yield ``(tokens, documents, cropped tokens)`` per row; the last row may be short.

    The longest buffered document that fits goes next; when none fits, the shortest is cropped to
    fill the row and its rest is lost.
    """
    buffer, more = _Buffer(), True
    row: list[np.ndarray] = []
    used = cropped = 0
    while True:
        while more and buffer.size < buffer_docs:
            for _ in range(refill):
                doc = next(docs, None)
                if doc is None:
                    more = False
                    break
                buffer.add(doc)
        if not buffer.size:
            break
        doc = buffer.longest_within(capacity - used)
        if doc is None:
            doc = buffer.shortest()
            cropped += len(doc) - (capacity - used)
            doc = doc[: capacity - used]
        row.append(doc)
        used += len(doc)
        if used == capacity:
            yield np.concatenate(row), len(row), cropped
            row, used, cropped = [], 0, 0
    if row:
        yield np.concatenate(row), len(row), cropped


def pack_sequences(
    docs: DataFrame, key: str, tokens: str, sequence_length: int, bos_id: int, partitions: int | None = None,
    buffer_docs: int = BUFFER_DOCS,
) -> DataFrame:
    """Rows of ``sequence_length + 1`` tokens; every row starts with ``bos_id``.

    Documents are range-partitioned by key, so packing keeps their order and each partition packs on
    its own with a bounded buffer. The last, short row of a partition comes out with ``complete`` false
    rather than being lost.
    """
    capacity = sequence_length + 1
    narrow = docs.select(F.col(key).alias("doc_key"), F.col(tokens).alias("doc_tokens"))
    ranged = narrow.repartitionByRange(partitions, "doc_key") if partitions else narrow.repartitionByRange("doc_key")
    placed = ranged.sortWithinPartitions("doc_key").select("doc_tokens", F.spark_partition_id().alias("part"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = 0

        def documents() -> Iterator[np.ndarray]:
            nonlocal part
            for batch in batches:
                if batch.num_rows:
                    part = batch.column("part")[0].as_py()
                yield from _token_lists(batch.column("doc_tokens"), bos_id)

        rows, first = [], 0
        for row in pack_documents(documents(), capacity, buffer_docs):
            rows.append(row)
            if len(rows) == ROWS_PER_BATCH:
                yield _batch(rows, part, first, capacity)
                first, rows = first + len(rows), []
        if rows:
            yield _batch(rows, part, first, capacity)

    return placed.mapInArrow(pack, PACKED_SCHEMA)


def place_documents(
    lengths: Iterator[int], capacity: int, crop: bool = False, buffer_docs: int = BUFFER_DOCS, refill: int = REFILL_DOCS
) -> Iterator[tuple[int, int, int, int, int]]:
    """Yield (document, begin, end, row, place) of each piece; a piece takes one place more than it has tokens, for a start token.

    The longest waiting document that fits goes next; when none fits, the shortest fills the row, and its rest waits
    like a document, unless ``crop`` drops it.
    """
    buffer, docs, more, row, used = _Buffer(), enumerate(lengths), True, 0, 0
    while True:
        while more and buffer.size < buffer_docs:
            for _ in range(refill):
                doc = next(docs, None)
                if doc is None:
                    more = False
                    break
                buffer.add((doc[0], 0, doc[1]), doc[1] + 1)
        if not buffer.size:
            return
        room = capacity - used
        doc, begin, end = buffer.longest_within(room) or buffer.shortest()
        stop = min(end, begin + room - 1)
        yield doc, begin, stop, row, used
        used += stop - begin + 1
        if stop < end and not crop:
            buffer.add((doc, stop, end), end - stop + 1)
        if used == capacity:
            row, used = row + 1, 0


def place_sequences(
    docs: DataFrame, key: str, tokens: str, sequence_length: int, crop: bool = False, group_docs: int = GROUP_DOCS, buffer_docs: int = BUFFER_DOCS
) -> DataFrame:
    """(doc_key, begin, end, part, row_no, at): tokens ``begin`` to ``end`` of a document stand behind a start token at place ``at`` of a row.

    Rows have ``sequence_length + 1`` places and all begin with a start token; the last of a part may be short. Keys are
    unique. Parts are cut by a hash of the key, as many as the number of documents asks for, so the result is the same
    for any cluster and any layout. Lengths alone are moved; with ``crop`` what a row has no room for is in no piece.
    """
    capacity = sequence_length + 1
    narrow = docs.select(F.col(key).alias("doc_key"), F.coalesce(F.size(tokens), F.lit(0)).alias("n"))
    narrow = narrow.withColumn("n", F.greatest("n", F.lit(0)).cast("long"))
    parts = max(1, -(-narrow.count() // group_docs))
    dealt = narrow.withColumn("part", F.pmod(F.xxhash64("doc_key"), F.lit(parts)).cast("int"))
    kind = dict(narrow.dtypes)["doc_key"]

    def place(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("doc_key")
        placed = list(place_documents(iter(rows["n"].to_pylist()), capacity, crop, buffer_docs))
        doc, begin, end, row, at = (np.array(c, np.int64) for c in zip(*placed))
        return pa.table({
            "doc_key": rows["doc_key"].take(pa.array(doc)), "begin": begin, "end": end,
            "part": pa.array(np.full(len(doc), rows["part"][0].as_py()), pa.int32()), "row_no": row, "at": pa.array(at, pa.int32()),
        })

    return dealt.groupBy("part").applyInArrow(place, f"doc_key {kind}, begin long, end long, part int, row_no long, at int")


def placed_rows(placements: DataFrame, docs: DataFrame, key: str, tokens: str, bos_id: int) -> DataFrame:
    """(part, row_no, tokens): the rows that ``placements`` describe. A row's pieces are at most as many as its places."""
    texts = docs.select(F.col(key).alias("doc_key"), F.col(tokens).alias("_tokens"))
    piece = F.concat(F.array(F.lit(bos_id)), F.slice(F.coalesce("_tokens", F.array().cast("array<int>")), F.col("begin").cast("int") + 1, (F.col("end") - F.col("begin")).cast("int")))
    rows = placements.join(texts, placements["doc_key"].eqNullSafe(texts["doc_key"])).select("part", "row_no", F.struct("at", piece.alias("tokens")).alias("p"))
    made = rows.groupBy("part", "row_no").agg(F.array_sort(F.collect_list("p")).alias("p"))
    return made.select("part", "row_no", F.flatten("p.tokens").alias("tokens"))


def _token_lists(column: pa.ListArray, bos_id: int) -> Iterator[np.ndarray]:
    """Each document's tokens behind the start token, cut from the batch's own buffer."""
    values = column.values.to_numpy(zero_copy_only=False)
    offsets = column.offsets.to_numpy()
    for begin, end in zip(offsets[:-1], offsets[1:]):
        doc = np.empty(end - begin + 1, dtype=np.int32)
        doc[0] = bos_id
        doc[1:] = values[begin:end]
        yield doc


def _batch(rows: list[tuple], part: int, first: int, capacity: int) -> pa.RecordBatch:
    tokens, n_docs, n_cropped = zip(*rows)
    lengths = np.array([len(t) for t in tokens])
    offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(len(rows), part, dtype=np.int32)),
            pa.array(np.arange(first, first + len(rows), dtype=np.int64)),
            pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(tokens))),
            pa.array(n_docs, pa.int32()),
            pa.array(n_cropped, pa.int64()),
            pa.array(lengths == capacity),
        ],
        names=["part", "row_no", "tokens", "n_docs", "n_cropped", "complete"],
    )


def packing_totals(packed: DataFrame) -> DataFrame:
    """Tokens placed, cropped and left in short rows: with the input they balance."""
    return packed.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum("n_docs").cast("bigint").alias("n_docs"),
        F.sum(F.size("tokens")).cast("bigint").alias("tokens_placed"),
        F.sum("n_cropped").cast("bigint").alias("tokens_cropped"),
        F.coalesce(F.sum(F.when(~F.col("complete"), F.size("tokens"))), F.lit(0)).cast("bigint").alias("tokens_in_short_rows"),
    )
