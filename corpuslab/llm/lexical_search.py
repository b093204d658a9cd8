"""Ranked lexical search of a set of items over all documents, with equal bags scored once.

A document is cut down to the items' vocabulary: its bag, the count of each vocabulary term. What a score needs besides
is the length norm m, so documents with equal bag and m form a class and have equal scores for every item. Bags are
made where the text is read, N, L and the document frequencies are sums over them, and rows meet by a hash of bag and m;
rows are of a class only where hash, m and all bytes of the bag are equal. Of each class the ``best`` smallest ids are
kept, before and after the shuffle, so a class with a third of all documents costs no more than another. A task scores
each of its classes once for all items, as products of matrices whose entries are whole numbers below 2 ** 53, and gives
its members, in ascending id, that score; the best of every task meet in a ranking by item.

Results by definition: scores are the sums of weight * ((10 ** 9 * tf) div (1000 * tf + 8 * m)) over an item's terms,
repeats included, with m = 100 - 75 + (75 * n * N) div L and weight floor(1000 * ln((2 N + 2) / (2 df + 1))). Null and
empty texts have no terms and are never found. Equal scores come in ascending id, null ids last, repeated ids as often
as there are rows. Items that have no term, or none that any document holds, have no row; equal rows of items (id and
text) count once; an empty table on either side gives an empty result. Texts are read whole, whatever their length, and
other columns are not carried. Items are taken in blocks of bounded size, each of which is one pass over the documents.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpuslab.llm import common, ranges
from corpuslab.llm.words import HashIndex, piecewise_hashes
from corpuslab.session import checkpointed

FOUND = "item long, score long, doc_id {}"
_TERM = np.ones(256, bool)
_TERM[:128] = False
_TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
# Cells of the matrix that holds the classes scored in a go (8 bytes each).
CELLS = 1 << 21
# Below this every sum of whole numbers is exact in a double.
EXACT = 1 << 53


@dataclass(frozen=True)
class Settings:
    """``block_items`` and ``block_bytes`` bound what is broadcast of the items: a block has one item at least."""

    best: int = 10
    block_items: int = 4096
    block_bytes: int = 8_000_000


def terms_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lower-cased bytes, starts, ends, first term of each text and their number at the end)."""
    low = _LOWER[data]
    return low, *ranges.cut(low, offsets, _TERM)


class Vocabulary:
    """The distinct terms of a block of items, found by hash and confirmed byte for byte."""

    def __init__(self, texts: list[str]):
        counted = []
        for text in texts:
            raw = np.frombuffer(text.encode(), np.uint8)
            low, starts, ends, _ = terms_of(raw, np.array([0, len(raw)]))
            counted.append(Counter(bytes(low[a:b]) for a, b in zip(starts, ends, strict=True)))
        self.terms = sorted(set().union(*counted))
        number = {t: k for k, t in enumerate(self.terms)}
        self.items = [{number[t]: n for t, n in c.items()} for c in counted]
        sizes = np.array([len(t) for t in self.terms], np.int64)
        self.bytes = np.frombuffer(b"".join(self.terms), np.uint8)
        self.starts, self.sizes = np.cumsum(sizes) - sizes, sizes
        hashes = piecewise_hashes(self.bytes, self.starts, self.starts + sizes)
        if len(np.unique(hashes)) < len(hashes):
            raise ValueError("two terms share a hash")
        self.index = HashIndex(hashes)

    def find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number of each range's term, or -1."""
        found = self.index.find(piecewise_hashes(data, starts, ends)).astype(np.int64)
        at = np.flatnonzero(found >= 0)
        at = at[self.sizes[found[at]] == (ends - starts)[at]]
        out = np.full(len(starts), -1, np.int64)
        for part in ranges.pieces((ends - starts)[at]):
            own = at[part]
            sizes = (ends - starts)[own]
            same = data[ranges.flat(starts[own], sizes)] == self.bytes[ranges.flat(self.starts[found[own]], sizes)]
            wrong = np.add.reduceat(~same, np.cumsum(sizes) - sizes) > 0 if len(own) else np.zeros(0, bool)
            out[own[~wrong]] = found[own[~wrong]]
        return out


def _bags(shared):
    """A text's number of terms and its bag: pairs of 32-bit numbers, term and count, by term."""

    @F.arrow_udf("struct<n long, bag binary>")
    def bags(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        vocabulary = shared.value
        width = max(1, len(vocabulary.terms))
        for column in columns:
            counts, bags = [np.zeros(0, np.int64)], []
            for _, _, data, offsets in common.arrow_slices(column):
                low, starts, ends, first = terms_of(data, offsets)
                number = vocabulary.find(low, starts, ends)
                text = np.repeat(np.arange(len(first) - 1), np.diff(first))
                cells, times = np.unique((text * width + number)[number >= 0], return_counts=True)
                pairs = np.stack([cells % width, times], axis=1).astype("<u4")
                at = np.searchsorted(cells, np.arange(len(first)) * width)
                bags += [pairs[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
                counts.append(np.diff(first))
            yield pa.StructArray.from_arrays([pa.array(np.concatenate(counts)), pa.array(bags, pa.binary())], ["n", "bag"])
        common.give_back()

    return bags


def _frequencies(bags: DataFrame, terms: int) -> np.ndarray:
    """In how many documents each of the block's terms occurs: a sum in each task, then over the tasks."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(terms, np.int64)
        for batch in batches:
            pairs = np.frombuffer(b"".join(batch.column(0).to_pylist()), "<u4").reshape(-1, 2)
            seen += np.bincount(pairs[:, 0], minlength=terms)
        used = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(seen[used])], ["term", "n"])

    got = bags.select("bag").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(terms, np.int64)
    out[got["term"].to_numpy()] = got["n"].to_numpy()
    return out


def weights(n_docs: int, frequencies: np.ndarray) -> np.ndarray:
    return np.floor(1000 * np.log((2 * n_docs + 2) / (2 * frequencies + 1))).astype(np.int64)


class Scorer:
    """Scores of classes for the items of a block, in whole numbers."""

    def __init__(self, items: list[dict[int, int]], weight: np.ndarray):
        self.width, self.weight = len(weight), weight
        self.times = np.zeros((self.width, len(items)))
        for k, item in enumerate(items):
            self.times[list(item), k] = list(item.values())
        # A term adds at most its weight times 10 ** 6 for each time that the item holds it.
        bound = max((sum(n * int(weight[t]) for t, n in item.items()) for item in items), default=0) * 10**6
        self.exact = bound < EXACT
        if not self.exact:
            self.times = self.times.astype(np.int64)

    def scores(self, bags: list[bytes], m: np.ndarray) -> np.ndarray:
        pairs = np.frombuffer(b"".join(bags), "<u4").reshape(-1, 2).astype(np.int64)
        row = np.repeat(np.arange(len(bags)), np.array([len(b) // 8 for b in bags], np.int64))
        term, tf = pairs[:, 0], pairs[:, 1]
        cells = np.zeros((len(bags), self.width), np.float64 if self.exact else np.int64)
        cells[row, term] = self.weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[row]))
        return (cells @ self.times).astype(np.int64)


def _best_of(shared, best: int, kind: str):
    """(item, score, doc_id) of the best members among a task's classes, whose rows follow one another by ascending id."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer: Scorer = shared.value
        n_items = scorer.times.shape[1]
        rows = max(1, CELLS // (scorer.width + n_items))
        top: list[list[tuple[int, bool, object]]] = [[] for _ in range(n_items)]
        before, before_scores = (None, None), None
        for batch in batches:
            bags, norms, ids = batch.column("bag").to_pylist(), batch.column("m").to_numpy(), batch.column("doc_id").to_pylist()
            for low in range(0, len(bags), rows):
                part, m = bags[low : low + rows], norms[low : low + rows]
                member = np.empty(len(part), np.int64)  # which class a row is of; -1: that of the row before this part
                one, last, at = [], before, -1
                for k, key in enumerate(zip(part, m.tolist(), strict=True)):
                    if key != last:
                        one.append(k)
                        last, at = key, at + 1
                    member[k] = at
                found = scorer.scores([part[k] for k in one], m[np.array(one, np.int64)])
                if before_scores is not None:
                    found = np.concatenate([found, before_scores[None]])  # member -1 is its last row
                before, before_scores = last, found[at].copy()
                for item in range(n_items):
                    own = found[member, item]
                    rank = top[item]
                    least = rank[-1][0] if len(rank) == best else 0
                    good = np.flatnonzero((own > 0) & (own >= -least))
                    if len(good):
                        rank += [(-int(own[k]), ids[low + k] is None, ids[low + k] or 0) for k in good.tolist()]
                        rank.sort()
                        del rank[best:]
        flat = [(item, -s, None if null else i) for item, rank in enumerate(top) for s, null, i in rank]
        items, scores, ids = zip(*flat, strict=True) if flat else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(items, pa.int64()), pa.array(scores, pa.int64()), pa.array(ids, kind)], ["item", "score", "doc_id"])
        common.give_back()

    return search


def _blocks(items: DataFrame, settings: Settings) -> Iterator[list[tuple[object, str]]]:
    """Blocks of (item_id, text), of bounded size; the items come to the driver a partition at a time."""
    block, size = [], 0
    for row in items.select("item_id", common.text_of().alias("text")).distinct().orderBy("item_id", "text").toLocalIterator():
        n = len(row["text"].encode())
        if block and (len(block) >= settings.block_items or size + n > settings.block_bytes):
            yield block
            block, size = [], 0
        block.append((row["item_id"], row["text"]))
        size += n
    if block:
        yield block


def _search_block(docs: DataFrame, block: list[tuple[object, str]], settings: Settings) -> DataFrame:
    spark, id_type = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    vocabulary = Vocabulary([text for _, text in block])
    bags = _bags(spark.sparkContext.broadcast(vocabulary))
    counted = checkpointed(docs.select("doc_id", bags(F.col("text")).alias("b")).select("doc_id", "b.n", "b.bag"))
    totals = counted.agg(F.count_if(F.col("n") > 0).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    weight = weights(totals["docs"], _frequencies(counted, len(vocabulary.terms)))
    scorer = spark.sparkContext.broadcast(Scorer(vocabulary.items, weight))
    norm = 25 + F.call_function("div", F.lit(75).cast("long") * F.col("n") * F.lit(totals["docs"]), F.lit(max(1, totals["terms"])))
    usable = counted.where(F.length("bag") > 0).select("doc_id", "bag", norm.alias("m"))
    hashed = usable.withColumn("key", F.xxhash64("bag", "m"))
    members = Window.partitionBy("key", "m", "bag").orderBy(F.col("doc_id").asc_nulls_last())
    classes = hashed.withColumn("turn", F.row_number().over(members)).where(F.col("turn") <= settings.best)
    classes = classes.sortWithinPartitions("key", "m", "bag", "turn").select("bag", "m", "doc_id")
    kind = pa.schema([("doc_id", pa.int32() if id_type == "int" else pa.int64())]).field("doc_id").type
    found = classes.mapInArrow(_best_of(scorer, settings.best, kind), FOUND.format(id_type))
    ranking = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(ranking)).where(F.col("rank") <= settings.best)
    names = spark.createDataFrame([(k, item_id) for k, (item_id, _) in enumerate(block)], "item long, item_id long")
    return ranked.join(F.broadcast(names), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's ``best`` documents with a score above 0, among all of ``docs``."""
    found = None
    for block in _blocks(items, settings):
        part = _search_block(docs.select("doc_id", "text"), block, settings)
        found = part if found is None else found.unionByName(part)
    if found is None:
        id_type = docs.schema["doc_id"].dataType.simpleString()
        return docs.sparkSession.createDataFrame([], f"item_id long, rank int, doc_id {id_type}, score long")
    return found
