"""Benchmark decontamination by latent semantic retrieval.

The benchmark is taken in blocks of ``block`` items. The terms of a block's items are its vocabulary; how many
documents hold each term is counted over all documents. Items, and windows of the documents' words, are TF-IDF
vectors over that vocabulary, projected onto the leading right singular vectors of the matrix of all passages of all
documents and of the block's items: no document is left out and none is sampled. A distributed randomised SVD finds
these: test vectors are multiplied by the matrix and its transpose inside the partitions, and only terms x rank sums
come back. Texts are cut into words once a block; their words' places in the vocabulary are checkpointed for the rest.

Documents are read as windows of 24, 48, 72, ... words that start a third of their length apart; an item is looked
for in windows half as long again as itself or more, so that some window holds it whole. Candidates are the items whose cosine with a
window in the latent space reaches the share ``cosine`` of the item's own length there. Windows that hold
fewer uncommon words of the items, or of one item, than a match would need are passed over, which loses nothing.
A candidate is confirmed when its longest common subsequence with the window keeps the share ``whole`` of the item's
words, or the share ``partly`` of them and of its answer's (what follows the last question mark or ``answer:``, else
the last quarter): a paraphrase that keeps the answer.

Results by definition: one row (doc_id, item_id, overlap, answer_overlap, cosine) for each document and item found,
none for other documents. Null and empty texts hold nothing; items without a word are never found; rows that share
an id are matched each on its own, and the best match of each pair of ids is returned. An empty table on either
side gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.llm import common
from corpuslab.llm.near_dedup import common_in_band
from corpuslab.llm.words import HashIndex, words_of
from corpuslab.session import checkpointed, released

# The passages are read in so many tasks at least, their sums are dealt to so many groups of terms.
FIT_PARTS = 16
FIT_GROUPS = 8
PASSAGE = 32
# The terms in most documents are counted in dense blocks of passages, all others one by one.
DENSE = 512
DENSE_ROWS = 4096
# An item's uncommon words are this share of its words, those in fewest documents.
UNCOMMON = 0.6
# Windows are multiples of three steps long and a third of themselves apart.
STEP = 8


@dataclass(frozen=True)
class Settings:
    """``block`` bounds what is broadcast at once. A latent space is fitted on all documents, whatever the block."""

    rank: int = 96
    extra: int = 16
    powers: int = 1
    cosine: float = 0.2
    whole: float = 0.75
    partly: float = 0.65
    block: int = 512
    seed: int = 7


@dataclass
class Items:
    """A block of benchmark items: their words and answers as hashes, and the vocabulary of them all."""

    ids: list
    words: list[np.ndarray]
    answers: list[np.ndarray]
    vocabulary: np.ndarray
    index: HashIndex
    windows: np.ndarray


def _hashes(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    return words_of(data, np.array([0, len(data)]))[3]


def items_of(rows: list) -> Items:
    ids, words, answers, windows = [], [], [], []
    for r in rows:
        text = r["text"] or ""
        low = text.lower()
        cut = max(low.rfind("?") + 1, low.rfind("answer:") + 7 if "answer:" in low else 0)
        own = _hashes(text)
        if not len(own):
            continue
        answer = _hashes(text[cut:]) if cut else own[:0]
        ids.append(r["item_id"])
        words.append(own)
        answers.append(answer if len(answer) else own[-max(1, len(own) // 4) :])
        windows.append(STEP * 3 * ceil(len(own) / (STEP * 2)))
    vocabulary = np.unique(np.concatenate(words)) if words else np.zeros(0, np.uint64)
    return Items(ids, words, answers, vocabulary, HashIndex(vocabulary), np.array(windows, np.int64))


def _code(items: Items) -> np.dtype:
    return np.dtype(np.int16 if len(items.vocabulary) < 1 << 15 else np.int32)


def coded(docs: DataFrame, items: Items) -> DataFrame:
    """(doc_id, terms) of (doc_id, text): the places of a text's words in the vocabulary, -1 for words that it lacks."""
    kind = _code(items)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in common.arrow_slices(batch.column(1)):
                _, _, _, hashes, first = words_of(data, offsets)
                terms = items.index.find(hashes).astype(kind)
                where = pa.py_buffer((first * kind.itemsize).astype(np.int32))
                column = pa.Array.from_buffers(pa.binary(), high - low, [None, where, pa.py_buffer(terms)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), column], ["doc_id", "terms"])
        common.give_back()

    return docs.mapInArrow(code, docs.select("doc_id").schema.add("terms", "binary"))


def _terms(column: pa.Array, kind: np.dtype) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, terms, first word of each text and the number of words at the end) of runs of rows."""
    for low, _, data, offsets in common.arrow_slices(column, pa.large_binary()):
        yield low, data.view(kind), offsets // kind.itemsize


def document_frequencies(words: DataFrame, items: Items) -> tuple[np.ndarray, int]:
    """In how many documents each term of the vocabulary occurs, over all documents; and how many documents there are."""
    width, kind = len(items.vocabulary), _code(items)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(width + 1, np.int64)
        for batch in batches:
            for _, terms, first in _terms(batch.column(0), kind):
                owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
                own = np.unique(owner[terms >= 0] * width + terms[terms >= 0])
                seen[:width] += np.bincount(own % width, minlength=width)
                seen[width] += len(first) - 1
        used = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(seen[used])], ["term", "n"])
        common.give_back()

    got = words.select("terms").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(width + 1, np.int64)
    out[got["term"].to_numpy()] = got["n"].to_numpy()
    return out[:width], int(out[width])


def _multiply(kind: np.dtype, idf: np.ndarray, dense: np.ndarray, basis: np.ndarray):
    """Of one partition: the sum over its passages of (passage transposed) x (passage x basis), by term."""
    weighted = (basis * idf[:, None]).astype(np.float32)
    place = np.full(len(idf), -1)
    place[dense] = np.arange(len(dense))

    def add(total: np.ndarray, terms: np.ndarray, passage: np.ndarray, n: int) -> None:
        norm = np.sqrt(np.bincount(passage, idf[terms] ** 2, n))
        at = place[terms]
        own = at >= 0
        counts = np.bincount(passage[own] * len(dense) + at[own], minlength=n * len(dense)).reshape(n, -1).astype(np.float32)
        image = counts @ weighted[dense]
        terms, passage = terms[~own], passage[~own]
        heads = np.flatnonzero(np.diff(passage, prepend=-1))
        if len(heads):
            image[passage[heads]] += np.add.reduceat(weighted[terms], heads, axis=0)
        image *= (np.maximum(norm, 1e-12) ** -2).astype(np.float32)[:, None]
        total[dense] += counts.T @ image
        order = np.argsort(terms, kind="stable")
        heads = np.flatnonzero(np.diff(terms[order], prepend=-1))
        if len(heads):
            total[terms[order][heads]] += np.add.reduceat(image[passage[order]], heads, axis=0)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(basis.shape)
        for batch in batches:
            for _, terms, first in _terms(batch.column(0), kind):
                # A text's passages follow those of the texts before it.
                count = -(-np.diff(first) // PASSAGE)
                owner = np.repeat(np.arange(len(count)), np.diff(first))
                passage = (np.cumsum(count) - count)[owner] + (np.arange(len(terms)) - first[owner]) // PASSAGE
                terms, passage = terms[terms >= 0], passage[terms >= 0]
                for low in range(0, int(count.sum()), DENSE_ROWS):
                    a, b = np.searchsorted(passage, (low, low + DENSE_ROWS))
                    if a < b:
                        add(total, terms[a:b], passage[a:b] - low, int(passage[b - 1]) - low + 1)
        total *= idf[:, None]
        used = np.flatnonzero(total.any(axis=1))
        values = pa.FixedSizeListArray.from_arrays(pa.array(total[used].ravel().astype(np.float32)), total.shape[1]).cast(pa.list_(pa.float32()))
        yield pa.RecordBatch.from_arrays([pa.array(used), values], ["term", "v"])
        common.give_back()

    return multiply


def _added(rows: pa.Table) -> pa.Table:
    terms, v = rows["term"].to_numpy(), rows["v"].combine_chunks().flatten().to_numpy().reshape(rows.num_rows, -1)
    order = np.argsort(terms, kind="stable")
    heads = np.flatnonzero(np.diff(terms[order], prepend=-1))
    total = np.add.reduceat(v[order], heads, axis=0) if len(heads) else v
    values = pa.FixedSizeListArray.from_arrays(pa.array(total.ravel()), v.shape[1]).cast(pa.list_(pa.float32()))
    return pa.table({"term": terms[order][heads], "v": values})


def _leading(basis: np.ndarray, image: np.ndarray) -> np.ndarray:
    """Eigenvectors, largest first, of the least positive matrix that takes the orthonormal ``basis`` to ``image`` (Nystroem)."""
    values, turn = np.linalg.eigh((basis.T @ image + image.T @ basis) / 2)
    kept = values > values[-1] * 1e-7
    return np.linalg.svd(image @ (turn[:, kept] / np.sqrt(values[kept])), full_matrices=False)[0]


def fit(words: DataFrame, items: Items, idf: np.ndarray, seen: np.ndarray, settings: Settings) -> np.ndarray:
    """Leading right singular vectors (terms x rank) of all passages of ``words``, by a randomised range finder."""
    width, kind = len(idf), _code(items)
    k = min(settings.rank + settings.extra, width)
    dense = np.sort(np.argsort(-seen, kind="stable")[:DENSE])
    # A task brings sums of all terms, so there are as many as the cluster works on, not one for each partition.
    words = words.select("terms").coalesce(max(FIT_PARTS, 2 * words.sparkSession.sparkContext.defaultParallelism))

    def product(basis: np.ndarray) -> np.ndarray:
        parts = words.mapInArrow(_multiply(kind, idf, dense, basis), "term long, v array<float>")
        summed = parts.groupBy(F.col("term") % FIT_GROUPS).applyInArrow(_added, "term long, v array<float>").toArrow()
        image = np.zeros((width, k))
        if summed.num_rows:
            image[summed["term"].to_numpy()] = summed["v"].combine_chunks().flatten().to_numpy().reshape(-1, k)
        return image

    basis = np.linalg.qr(np.random.default_rng(settings.seed).standard_normal((width, k)))[0]
    for _ in range(settings.powers):
        basis = np.linalg.qr(product(basis))[0]
    return np.ascontiguousarray(_leading(basis, product(basis))[:, : settings.rank]).astype(np.float32)


def _kept(item: np.ndarray, region: np.ndarray) -> float:
    return common_in_band(item, region, len(region)) / len(item)


def _search(items: Items, idf: np.ndarray, seen: np.ndarray, basis: np.ndarray, settings: Settings, types: list[pa.DataType]):
    """Rows (doc_id, item_id, overlap, answer_overlap, cosine) of each batch of (doc_id, terms)."""
    projected = basis * idf[:, None].astype(np.float32)
    latent = np.zeros((len(items.ids), basis.shape[1]), np.float32)
    reach, needs = np.zeros(len(items.ids)), np.zeros(len(items.ids))
    pairs = []
    for i, w in enumerate(items.words):
        terms = items.index.find(w)
        v = projected[terms].sum(axis=0)
        length = float(np.linalg.norm(v))
        latent[i] = v / max(length, 1e-12)
        reach[i] = settings.cosine * length / max(float(np.sqrt((np.bincount(terms) ** 2 * idf[: terms.max() + 1] ** 2).sum())), 1e-12)
        rare = terms[np.argsort(seen[terms], kind="stable")[: ceil(UNCOMMON * len(w))]]
        needs[i] = len(rare) - (1 - settings.partly) * len(w)
        pairs += [(t, i) for t in np.unique(rare).tolist()]
    # The items that hold an uncommon term t are holders[listed[t] : listed[t + 1]].
    pairs = np.array(sorted(pairs), np.int64).reshape(-1, 2)
    holders, listed = pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(len(basis) + 1))
    uncommon = listed[1:] > listed[:-1]
    times = [np.bincount(items.index.find(w), minlength=len(basis)).astype(np.int16) for w in items.words]
    levels = [(w, np.flatnonzero(items.windows == w)) for w in np.unique(items.windows)]

    def candidates(terms: np.ndarray, first: np.ndarray) -> Iterator[tuple]:
        """(text, item, first word, word after, cosine) of the windows that come near an item."""
        rare = np.concatenate([[0], np.cumsum((terms >= 0) & uncommon[terms])])
        size = np.diff(first)
        for window, own in levels:
            step = window // 3
            count = np.where(size > 0, np.maximum(-(-size // step) - 2, 1), 0)
            text = np.repeat(np.arange(len(size)), count)
            begin = first[text] + (np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)) * step
            end = np.minimum(begin + window, first[text + 1])
            near = np.flatnonzero(rare[end] - rare[begin] >= needs[own].min())
            for low in range(0, len(near), 4096):
                at = near[low : low + 4096]
                spread = end[at] - begin[at]
                word = np.repeat(begin[at] - (np.cumsum(spread) - spread), spread) + np.arange(spread.sum())
                term, part = terms[word], np.repeat(np.arange(len(at)), spread)
                known = term >= 0
                term, part = term[known], part[known]
                # How many of an item's uncommon words each window holds, by the items that have each word.
                few = uncommon[term]
                lists = listed[term[few] + 1] - listed[term[few]]
                ends = np.cumsum(lists)
                owner = holders[np.repeat(listed[term[few]] - (ends - lists), lists) + np.arange(lists.sum())]
                shared = np.bincount(np.repeat(part[few], lists) * len(needs) + owner, minlength=len(at) * len(needs))
                hit, item = np.nonzero(shared.reshape(len(at), -1)[:, own] >= needs[own])
                if not len(hit):
                    continue
                # The latent vectors of the windows that are left, and their cosines with those items.
                place = np.full(len(at), -1)
                used = np.unique(hit)
                place[used] = np.arange(len(used))
                mine = place[part] >= 0
                term, part = term[mine], place[part[mine]]
                heads = np.flatnonzero(np.diff(part, prepend=-1))
                if len(heads) < len(used):  # windows without any term of the vocabulary
                    full = np.unique(part)
                    kept = np.isin(place[hit], full)
                    hit, item = hit[kept], item[kept]
                    place[used] = np.searchsorted(full, np.arange(len(used)))
                if not len(heads):
                    continue
                v = np.add.reduceat(projected[term], heads, axis=0)
                norm = np.maximum(np.sqrt(np.add.reduceat(idf[term] ** 2, heads)), 1e-12)
                cosine = np.einsum("ij,ij->i", v[place[hit]], latent[own[item]]) / norm[place[hit]]
                passed = np.flatnonzero(cosine >= reach[own[item]])
                for k in passed.tolist():
                    w = at[hit[k]]
                    yield int(text[w]), int(own[item[k]]), int(begin[w]), int(end[w]), float(cosine[k])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = batch.column(0), []
            for low, terms, first in _terms(batch.column(1), _code(items)):
                best: dict[tuple, tuple] = {}
                for doc, i, begin, end, cosine in candidates(terms, first):
                    # Words that the item lacks keep nothing; what is left bounds the subsequence.
                    own = terms[begin:end]
                    own = own[(own >= 0) & (times[i][own] > 0)]
                    if np.minimum(np.bincount(own, minlength=len(basis)), times[i]).sum() < settings.partly * len(items.words[i]):
                        continue
                    region = items.vocabulary[own]
                    overlap = _kept(items.words[i], region)
                    if overlap >= settings.partly and overlap > best.get((doc, i), (0.0,))[0]:
                        best[doc, i] = (overlap, _kept(items.answers[i], region), cosine)
                for (doc, i), (overlap, answer, cosine) in best.items():
                    if overlap >= settings.whole or answer >= settings.partly:
                        out.append((ids[low + doc].as_py(), items.ids[i], overlap, answer, cosine))
            columns = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], ["doc_id", "item_id", "overlap", "answer_overlap", "cosine"])
        common.give_back()

    return search


def _blocks(benchmark: DataFrame, size: int) -> Iterator[list]:
    """The benchmark's rows, about ``size`` at a time: rows fall to blocks by a hash, and one block is fetched at a time."""
    blocks = ceil(benchmark.count() / size)
    for i in range(blocks):
        own = benchmark if blocks == 1 else benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == i)
        yield own.orderBy("item_id", "text").collect()


def find_leaks(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, item_id, overlap, answer_overlap, cosine) of every document and benchmark item that it holds."""
    docs, benchmark = docs.select("doc_id", "text"), benchmark.select("item_id", "text")
    kinds = docs.select("doc_id").schema.fields + benchmark.select("item_id").schema.fields
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kinds) + ", overlap double, answer_overlap double, cosine double"
    types = list(pa.schema([(f.name, _arrow_type(f)) for f in kinds]).types) + [pa.float64()] * 3
    found = None
    for rows in _blocks(benchmark, settings.block):
        items = items_of(rows)
        if not items.ids:
            continue
        words = checkpointed(coded(docs, items))
        seen, total = document_frequencies(words, items)
        idf = np.log((total + 2) / (seen + 1))
        own = docs.sparkSession.createDataFrame(list(enumerate(r["text"] for r in rows)), "doc_id long, text string")
        basis = fit(words.select("terms").unionByName(coded(own, items).select("terms")), items, idf, seen, settings)
        part = checkpointed(words.mapInArrow(_search(items, idf, seen, basis, settings, types), schema))
        released(words)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return docs.sparkSession.createDataFrame([], schema)
    best = F.max(F.struct("overlap", "answer_overlap", "cosine"))
    return found.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", "b.*")


def _arrow_type(field) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(field.dataType)


def without_leaks(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``docs`` without those that hold a benchmark item; columns and kept rows are unchanged.

    A row goes by its id and its text: other texts of the same id, or of none, stay.
    """
    marked = common.wrapped(docs, "doc_id", "text").withColumn("_row", common.row_of(F.col("doc_id"), F.sha2("text", 256)))
    leaks = find_leaks(marked.select(F.col("_row").alias("doc_id"), "text"), benchmark, settings)
    return common.without(marked, leaks.select(F.col("doc_id").alias("_row")).distinct(), "_row").select("_user.*")
