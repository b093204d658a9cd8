"""Near duplicates by order MinHash: shingles of five words, similarity 0.8 or more.

A text's k-mers are its runs of five words, labelled with their occurrence number, so that repeats count. A sketch
takes the ``minima`` k-mers of least hash and keeps them in the order in which the text has them: two texts agree on
a sketch when they share these k-mers in the same order. ``rows`` sketches make a band; texts that agree on a band
are candidates. In each band's bucket the members are first compared with leaders, the smallest member and, in a large
bucket, the one whose k-mers are the most common ones, so a bucket of thousands of copies costs two comparisons each.
What the leaders leave open is settled exactly: in small buckets every pair of different classes is a candidate; of the
texts in large buckets that still hold several classes every pair that shares one of its rarest k-mers, as two similar
texts must (prefix filter). A candidate pair is verified
on the whole word sequences: the k-mers in common, repeats counted, over those in either must reach ``similarity``,
and an alignment inside a band around the diagonal must keep the share ``aligned`` of the words in order.

Results by definition: class_id is the smallest id of the class. Texts with the same words are one class; a text of
fewer than five words has one k-mer, all its words. Null texts and texts without a word, and rows without an id, are
alone (class_id is their id). Rows that share an id and a text are in one class and all stay or all go; other texts of
an id are judged each on its own. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslab.llm import common
from corpuslab.llm.words import mixed, words_of
from corpuslab.session import checkpointed, released

_M = np.uint64(0x9FB21C651E98DF25)
# What leaders leave open is compared completely in buckets of at most SMALL texts, by _rest() in larger ones.
SMALL = 16
# Texts' words that one task reads.
TEXTS = 5_000
# K-mers are counted in so many slots (8 MB): collisions blur the order of the prefixes, which may be any order.
SLOTS = 1 << 20
LEVEL = 1.05


@dataclass(frozen=True)
class Settings:
    shingle: int = 5
    similarity: float = 0.8
    aligned: float = 0.6
    minima: int = 3
    rows: int = 2
    bands: int = 20


def shingles(hashes: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each k-mer, first k-mer of each text and the number at the end)."""
    n = len(hashes)
    out = np.zeros(n, np.uint64)
    end = np.repeat(first[1:], np.diff(first))
    for j in range(size):
        out = out * _M
        if j < n:
            inside = np.arange(n - j) + j < end[: n - j]
            out[: n - j] += np.where(inside, hashes[j:], np.uint64(0))
    counts = np.diff(first)
    start = np.repeat(first[:-1], counts)
    keep = (np.arange(n) + size <= end) | (np.arange(n) == start)
    kept = np.where(counts > 0, np.maximum(counts - size + 1, 1), 0)
    return mixed(out[keep]), np.concatenate([[0], np.cumsum(kept)])


def occurrences(kmers: np.ndarray, first: np.ndarray) -> np.ndarray:
    """How many times each k-mer has come before in its text."""
    text = np.repeat(np.arange(len(first) - 1, dtype=np.uint64), np.diff(first))
    own = kmers + text * _M
    order = np.argsort(own, kind="stable")
    ranked = own[order]
    new = np.ones(len(own), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    at = np.arange(len(own))
    out = np.empty(len(own), np.uint64)
    out[order] = at - np.maximum.accumulate(np.where(new, at, 0))
    return out


def _least(values: np.ndarray, first: np.ndarray, text: np.ndarray, limit: np.ndarray, m: int) -> np.ndarray:
    """Places of the ``m`` smallest values of each text, in text order. ``limit`` lets about a dozen of each text pass."""
    chosen, todo, factor = [], np.ones(len(first) - 1, bool), 1
    size = np.diff(first)
    at = np.flatnonzero(values < limit)
    while True:
        order = at[np.lexsort((values[at], text[at]))]
        owner = text[order]
        begin = np.searchsorted(owner, owner)
        got = np.bincount(owner, minlength=len(size))
        enough = todo & (got >= np.minimum(size, m))
        chosen.append(order[(np.arange(len(order)) - begin < m) & enough[owner]])
        todo &= ~enough
        if not todo.any():
            return np.sort(np.concatenate(chosen))
        factor *= 8
        open_ = np.flatnonzero(todo[text])
        bound = limit[open_] if factor < 1 << 40 else np.uint64(0xFFFFFFFFFFFFFFFF)
        wide = bound > np.uint64(0xFFFFFFFFFFFFFFFF) // np.uint64(min(factor, 1 << 40))
        at = open_[wide | (values[open_] < bound * np.uint64(min(factor, 1 << 40)))]


def band_keys(kmers: np.ndarray, first: np.ndarray, settings: Settings) -> np.ndarray:
    """One 64-bit key for each text and band."""
    texts, size = len(first) - 1, np.diff(first)
    labelled = mixed(kmers + occurrences(kmers, first) * np.uint64(0xA24BAED4963EE407))
    text = np.repeat(np.arange(texts), size)
    share = np.minimum(12.0 / np.maximum(size, 1), 1.0)
    limit = np.minimum(share * 2.0**64, 2.0**64 - 4096).astype(np.uint64)
    limit[share >= 1] = np.uint64(0xFFFFFFFFFFFFFFFF)
    limit = np.repeat(limit, size)
    keys = np.empty((texts, settings.bands), np.uint64)
    draws = mixed(np.arange(1, 2 * settings.bands * settings.rows + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) | np.uint64(1)
    sketch = 0
    for band in range(settings.bands):
        key = np.full(texts, band + 1, np.uint64)
        for _ in range(settings.rows):
            values = (labelled ^ draws[2 * sketch]) * draws[2 * sketch + 1]
            places = _least(values, first, text, limit, settings.minima)
            owner = text[places]
            rank = np.arange(len(places)) - np.searchsorted(owner, owner)
            for j in range(settings.minima):
                own = rank == j
                key[owner[own]] = mixed(key[owner[own]] * _M + kmers[places[own]])
            key = mixed(key + _M)
            sketch += 1
        keys[:, band] = key
    return keys


def _sketched(settings: Settings):
    @F.arrow_udf("struct<whole binary, bands array<bigint>>")
    def sketch(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            wholes, bands, empty = [], [], []
            for _, _, data, offsets in common.arrow_slices(column):
                _, _, _, hashes, first = words_of(data, offsets)
                kmers, start = shingles(hashes, first, settings.shingle)
                place = np.arange(len(hashes), dtype=np.uint64) - np.repeat(first[:-1], np.diff(first)).astype(np.uint64)
                both = np.zeros((len(first) - 1, 2), np.uint64)
                full = np.flatnonzero(np.diff(first))
                if len(full):
                    both[full, 0] = np.add.reduceat(mixed(hashes + place * _M), first[full])
                    both[full, 1] = np.add.reduceat(mixed((hashes ^ _M) * np.uint64(3) + place * np.uint64(0xA24BAED4963EE407)), first[full])
                wholes += [x.tobytes() for x in both]
                bands.append(band_keys(kmers, start, settings))
                empty.append(np.diff(first) == 0)
            empty = np.concatenate(empty) if empty else np.zeros(0, bool)
            keys = np.concatenate(bands) if bands else np.zeros((0, settings.bands), np.uint64)
            lists = pa.ListArray.from_arrays(np.arange(len(keys) + 1, dtype=np.int32) * settings.bands, keys.view(np.int64).ravel())
            yield pa.StructArray.from_arrays([pa.array(wholes, pa.binary()), lists], ["whole", "bands"], mask=pa.array(empty))
        common.give_back()

    return sketch


def _worded():
    """The words of a text in order, as 32 bits of their hashes: verification moves these twice for each pair."""

    @F.arrow_udf("array<int>")
    def word_hashes(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            parts, ends = [np.zeros(0, np.uint32)], [np.zeros(1, np.int64)]
            for _, _, data, offsets in common.arrow_slices(column):
                _, _, _, hashes, first = words_of(data, offsets)
                parts.append((hashes >> np.uint64(32)).astype(np.uint32))
                ends.append(ends[-1][-1] + first[1:])
            yield pa.ListArray.from_arrays(np.concatenate(ends).astype(np.int32), np.concatenate(parts).view(np.int32))
        common.give_back()

    return word_hashes


def common_in_band(x: np.ndarray, y: np.ndarray, half: int) -> int:
    """Words that the best alignment of x and y keeps, when it stays within ``half`` of the diagonal.

    Bit-parallel: bit j of ``row`` is cleared where the alignment with the first j + 1 words of y gains one.
    """
    n = min(len(x), len(y))
    differs = np.flatnonzero(x[:n] != y[:n])
    head = int(differs[0]) if len(differs) else n
    x, y = x[head:], y[head:]
    n = min(len(x), len(y))
    differs = np.flatnonzero(x[len(x) - n :][::-1] != y[len(y) - n :][::-1])
    tail = int(differs[0]) if len(differs) else n
    x, y = x[: len(x) - tail], y[: len(y) - tail]
    if not len(x) or not len(y):
        return head + tail
    masks: dict[int, int] = {}
    for j, w in enumerate(y.tolist()):
        masks[w] = masks.get(w, 0) | (1 << j)
    full = (1 << len(y)) - 1
    band, row = (1 << (2 * half + 1)) - 1, full
    for i, w in enumerate(x.tolist()):
        match = masks.get(w, 0)
        if match:
            match &= (band << (i - half)) if i >= half else band >> (half - i)
            gained = row & match
            row = ((row + gained) | (row - gained)) & full
    return head + tail + len(y) - row.bit_count()


def similar(x: np.ndarray, y: np.ndarray, settings: Settings) -> bool:
    """Whether two word sequences are near duplicates."""
    if not len(x) or not len(y):
        return False
    kmers, first = shingles(np.concatenate([x, y]).astype(np.uint64), np.array([0, len(x), len(x) + len(y)]), settings.shingle)
    sizes = np.diff(first)
    if sizes.min() < settings.similarity * sizes.max():
        return False
    labelled = mixed(kmers + occurrences(kmers, first) * np.uint64(0xA24BAED4963EE407))
    shared = len(np.intersect1d(labelled[: first[1]], labelled[first[1] :], assume_unique=True))
    if shared < settings.similarity * (sizes.sum() - shared):
        return False
    half = max(32, abs(len(x) - len(y)) + max(len(x), len(y)) // 4)
    return 2 * common_in_band(x, y, half) >= settings.aligned * (len(x) + len(y))


def _labelled(column: pa.Array, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """(labelled k-mers, first of each text and the number at the end) of word hashes, as ``similar`` has them."""
    words = column.values.to_numpy(zero_copy_only=False).view(np.uint32)
    offsets = column.offsets.to_numpy().astype(np.int64)
    kmers, first = shingles(words[offsets[0] : offsets[-1]].astype(np.uint64), offsets - offsets[0], settings.shingle)
    return mixed(kmers + occurrences(kmers, first) * np.uint64(0xA24BAED4963EE407)), first


def _slots(kmers: np.ndarray) -> np.ndarray:
    return (kmers >> np.uint64(64 - SLOTS.bit_length() + 1)).astype(np.int64)


def _frequencies(words: DataFrame, settings: Settings) -> np.ndarray:
    """In how many of the texts the k-mers of each slot occur."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(SLOTS, np.int64)
        for batch in batches:
            seen += np.bincount(_slots(_labelled(batch.column(0), settings)[0]), minlength=SLOTS)
        used = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(seen[used])], ["slot", "n"])
        common.give_back()

    got = words.select("words").mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(SLOTS, np.int64)
    out[got["slot"].to_numpy()] = got["n"].to_numpy()
    return out


def _prefixed(words: DataFrame, settings: Settings) -> DataFrame:
    """(doc_id, size, centrality, lone, prefix): the number of k-mers, the mean logarithm of how many texts have each, and
    the rarest ones: two texts of the similarity have one of these in common. The first ``lone`` of them are counted but
    not listed, as no other text has them; a collision only lists more."""
    shared = words.sparkSession.sparkContext.broadcast(_frequencies(words, settings))

    @F.arrow_udf("struct<size long, centrality double, lone long, prefix array<bigint>>")
    def prefixes(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            kmers, first = _labelled(column, settings)
            size = np.diff(first)
            seen = shared.value[_slots(kmers)]
            text = np.repeat(np.arange(len(size)), size)
            order = np.lexsort((kmers, seen, text))
            # Similar texts share at least ``similarity`` of either's k-mers.
            most = size - np.ceil(settings.similarity * size - 1e-9).astype(np.int64) + (size > 0)
            lone = np.minimum(np.bincount(text[seen == 1], minlength=len(size)), most)
            place = np.arange(len(order)) - first[text]
            rare = order[(place >= lone[text]) & (place < most[text])]
            centrality = np.bincount(text, np.log2(seen), minlength=len(size)) / np.maximum(size, 1)
            lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(most - lone)]).astype(np.int32), kmers[rare].view(np.int64))
            yield pa.StructArray.from_arrays([pa.array(size), pa.array(centrality), pa.array(lone), lists], ["size", "centrality", "lone", "prefix"])
        common.give_back()

    return words.select("doc_id", prefixes(F.col("words")).alias("p")).select("doc_id", "p.*")


def _verifier(settings: Settings):
    @F.arrow_udf("boolean")
    def verify(pairs: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for left, right in pairs:
            sides = [(a.values.to_numpy(zero_copy_only=False).view(np.uint32), a.offsets.to_numpy()) for a in (left, right)]
            (x, i), (y, j) = sides
            yield pa.array([similar(x[i[k] : i[k + 1]], y[j[k] : j[k + 1]], settings) for k in range(len(left))], pa.bool_())
        common.give_back()

    return verify


def _open(placed: DataFrame) -> DataFrame:
    """(key, n) of the buckets that hold several classes."""
    found = placed.groupBy("key").agg(F.max("n").alias("n"), F.min("root").alias("low"), F.max("root").alias("high"))
    return found.where("low <> high").select("key", "n")


def _ordered(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """(a, b, a_root, b_root), a before b, from the columns ``left``, ``right`` and their ``_root``; each pair once."""
    first = F.col(left) < F.col(right)
    return pairs.select(
        F.least(left, right).alias("a"), F.greatest(left, right).alias("b"),
        F.when(first, F.col(f"{left}_root")).otherwise(F.col(f"{right}_root")).alias("a_root"),
        F.when(first, F.col(f"{right}_root")).otherwise(F.col(f"{left}_root")).alias("b_root"),
    ).distinct()


def _led(members: DataFrame, central: DataFrame | None) -> DataFrame:
    """Pairs of each member with its bucket's leaders: the smallest member and, of more than SMALL, the most central one."""
    leaders = members.groupBy("key").agg(F.min("rep").alias("leader"))
    if central is not None:
        many = members.where(F.col("n") > SMALL).select("key", "rep").join(central.select(F.col("doc_id").alias("rep"), "centrality"), "rep")
        best = many.groupBy("key").agg(F.min(F.struct(-F.col("centrality"), "rep")).alias("best")).select("key", F.col("best.rep").alias("leader"))
        leaders = leaders.unionByName(best)
    met = members.select("key", "rep").join(leaders, "key").where("rep <> leader")
    return _ordered(met.select("rep", "leader", F.col("rep").alias("rep_root"), F.col("leader").alias("leader_root")), "rep", "leader")


def _small(placed: DataFrame, open_: DataFrame) -> DataFrame:
    """All pairs of different classes in the open buckets of at most SMALL members."""
    few = placed.select("key", "rep", "root").join(open_.where(F.col("n") <= SMALL).select("key"), "key", "left_semi")
    x, y = (few.select("key", F.col("rep").alias(n), F.col("root").alias(f"{n}_root")) for n in ("x", "y"))
    return _ordered(x.join(y, "key").where("x_root < y_root"), "x", "y")


def _rest(placed: DataFrame, open_: DataFrame, prefixed: DataFrame, settings: Settings) -> DataFrame:
    """(a, b, a_root, b_root) of the pairs of different classes, among the texts of large open buckets, that a prefix
    filter with places lets pass: no other pair among them can be similar.

    Similar texts x, y share at least t / (1 + t) of both sizes added, for the similarity t. So at the first k-mer that
    they share, in the order of the prefixes, as many must be left in each. x, the smaller, is held by its own size
    alone; y once for each level of sizes of x, a ratio of LEVEL apart, by the level's lower end.
    """
    share = settings.similarity / (1 + settings.similarity)
    texts = placed.join(open_.where(F.col("n") > SMALL).select("key"), "key", "left_semi").select("rep", "root").distinct()
    # Only the texts that are still open have their k-mers laid out.
    held = texts.join(prefixed.select(F.col("doc_id").alias("rep"), "size", "lone", "prefix"), "rep")
    at = held.select("rep", "root", "size", "lone", F.posexplode("prefix").alias("place", "kmer"))
    at = at.withColumn("place", F.col("place") + F.col("lone")).drop("lone")
    several = at.groupBy("kmer").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("kmer")
    at = checkpointed(at.join(several, "kmer", "left_semi"))
    level = lambda size: F.floor(F.log(size.cast("double")) / float(np.log(LEVEL)))
    left = F.col("size") - F.col("place") + 1e-6
    x = at.where(left >= 2 * share * F.col("size")).withColumn("level", level(F.col("size")))
    y = at.withColumn("level", F.explode(F.sequence(level(settings.similarity * F.col("size")) - 1, level(F.col("size")))))
    # A level's lower end, taken a little lower for rounding, but no size is under the similarity times the larger one's.
    least = F.greatest(F.pow(F.lit(LEVEL), F.col("level")) * (1 - 1e-9), settings.similarity * F.col("size"))
    y = y.where(left >= share * (F.col("size") + least))
    named = lambda side, n: side.select("kmer", "level", *[F.col(c).alias(f"{n}_{c}") for c in ("rep", "root", "size", "place")])
    x, y = named(x, "x"), named(y, "y")
    # Classes that meet in a k-mer first, then their members: pairs inside a large class are never made.
    classes = [side.select("kmer", "level", f"{n}_root").distinct() for side, n in ((x, "x"), (y, "y"))]
    met = classes[0].join(classes[1], ["kmer", "level"]).where("x_root <> y_root")
    pairs = met.join(x, ["kmer", "level", "x_root"]).join(y, ["kmer", "level", "y_root"])
    enough = share * (F.col("x_size") + F.col("y_size")) - 1e-6
    pairs = pairs.where((F.col("x_size") <= F.col("y_size")) & (F.col("x_size") - F.col("x_place") >= enough) & (F.col("y_size") - F.col("y_place") >= enough))
    return _ordered(pairs.withColumnsRenamed({"x_rep": "x", "y_rep": "y"}), "x", "y")


def _found(pairs: DataFrame, words: DataFrame, settings: Settings) -> DataFrame:
    """(a, b): the classes of the pairs that are near duplicates. The words of each side are moved once."""
    sides = pairs.join(words.select(F.col("doc_id").alias("b"), F.col("words").alias("b_words")), "b").join(
        words.select(F.col("doc_id").alias("a"), F.col("words").alias("a_words")), "a"
    )
    return sides.where(_verifier(settings)("a_words", "b_words")).select(F.col("a_root").alias("a"), F.col("b_root").alias("b"))


def _links(members: DataFrame, words: DataFrame, total: int, settings: Settings) -> DataFrame | None:
    """(node, root) of the distinct texts that have a near duplicate, or None.

    First the members (key, rep, n) of each bucket meet its leaders. Then every pair of different classes is compared
    that a bucket still holds: all in a small one, those that the prefix filter lets pass in a large one.
    """
    large = members.where(F.col("n") > SMALL).select(F.col("rep").alias("doc_id")).distinct()
    central = None
    if not (large := common.settled(large, total)).isEmpty():
        central = checkpointed(_prefixed(words.join(large, "doc_id", "left_semi"), settings))
    led = common.settled(_led(members, central), total)
    count = led.count()
    if not count:
        return None
    roots = common.components(_found(led, words, settings))
    placed = members.join(roots, members["rep"] == roots["node"], "left").select("key", "rep", "n", F.coalesce("root", "rep").alias("root"))
    placed = common.settled(placed, total)
    open_ = common.settled(_open(placed), total)
    left = _small(placed, open_)
    if central is not None and not open_.where(F.col("n") > SMALL).isEmpty():
        left = left.unionByName(_rest(placed, open_, central, settings)).distinct()
    left = common.settled(left.join(led.select("a", "b"), ["a", "b"], "left_anti"), total)
    count = left.count()
    if count:
        joined = common.components(_found(left, words, settings))
        moved = roots.join(joined.select(F.col("node").alias("root"), F.col("root").alias("_new")), "root", "left")
        alone = joined.join(roots, "node", "left_anti")
        merged = common.settled(moved.select("node", F.coalesce("_new", "root").alias("root")).unionByName(alone.select("node", "root")), total)
        released(roots, joined)
        roots = merged
    released(large, led, placed, open_, left, *([] if central is None else [central]))
    return roots


def _row() -> Column:
    """Rows are told apart by id and text; the smallest id comes first."""
    return F.struct("doc_id", F.unhex(F.md5("text")).alias("digest"))


def _placed(docs: DataFrame, settings: Settings) -> DataFrame:
    """(row, class_row, class_size) of every row of ``docs``; class_row is null where a row is alone by definition."""
    sketch = _sketched(settings)
    sketched = checkpointed(docs.select(_row().alias("row"), sketch(F.col("text")).alias("s")).select("row", "s.whole", "s.bands"))
    rows = sketched.count()
    usable = sketched.where(F.col("whole").isNotNull() & F.col("row.doc_id").isNotNull())
    texts = usable.groupBy("whole").agg(F.min("row").alias("rep"), F.count("*").alias("copies"), F.any_value("bands").alias("bands"))
    texts = common.settled(texts, rows)
    keys = texts.select("rep", F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    total = texts.count() * settings.bands
    members = common.settled(common.join_skewed(keys, common.settled(shared, total), "key", "n", total).where(F.col("n").isNotNull()), total)
    words = common.only(docs.select(_row().alias("doc_id"), "text"), members.select(F.col("rep").alias("doc_id")).distinct())
    words = words.dropDuplicates(["doc_id"]).select("doc_id", _worded()(F.col("text")).alias("words"))
    words = common.settled(words, rows, TEXTS)
    roots = _links(members.select("key", "rep", "n"), words, total, settings)
    if roots is None:
        classes = texts.select("whole", "copies", F.col("rep").alias("class_row"))
    else:
        classes = texts.join(roots, texts["rep"] == roots["node"], "left").select("whole", "copies", F.coalesce("root", "rep").alias("class_row"))
    classes = common.settled(classes, rows)
    released(members, words)
    sizes = classes.groupBy("class_row").agg(F.sum("copies").alias("class_size"))
    placed = common.join_skewed(
        sketched.select("row", "whole"), common.settled(classes.join(sizes, "class_row"), rows), "whole", "copies", rows
    )
    own = F.col("class_row").isNull() | F.col("row.doc_id").isNull()
    return placed.select("row", F.when(~own, F.col("class_row")).alias("class_row"), "class_size")


def _kept() -> Column:
    return F.col("class_row").isNull() | (F.col("class_row") == F.col("row"))


def find_classes(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, class_id, class_size, kept) of every row of ``docs``: kept is true for the row that its class is named after."""
    own = F.col("class_row").isNull()
    return _placed(docs, settings).select(
        F.col("row.doc_id").alias("doc_id"),
        F.when(own, F.col("row.doc_id")).otherwise(F.col("class_row.doc_id")).alias("class_id"),
        F.when(own, F.lit(1)).otherwise(F.col("class_size")).cast("long").alias("class_size"),
        _kept().alias("kept"),
    )


def keep_one(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``docs`` with one document of each class; columns and kept rows are unchanged.

    A row goes by its id and its text: other texts of the same id, or of none, stay.
    """
    gone = checkpointed(_placed(docs, settings)).where(~_kept()).select(common.row_of(F.col("row.doc_id"), F.hex("row.digest")).alias("_row"))
    marked = common.wrapped(docs, "doc_id", "text").withColumn("_row", common.row_of(F.col("doc_id"), F.upper(F.md5("text"))))
    return common.without(marked, gone.distinct(), "_row").select("_user.*")
