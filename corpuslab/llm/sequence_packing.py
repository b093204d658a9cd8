"""Documents packed into as few token sequences as can be, by swap-based local search.

A document's tokens are the tokenizer's ids, without special ones, and one end token; only longer documents are cut, into
pieces of ``capacity`` tokens, of which the last may be shorter. Full pieces are sequences by themselves. All others are
dealt into groups of about ``group`` pieces, each of which is packed by itself: every piece goes, longest first, to the
bin with the least room for it, and then underfull bins, the fullest first, take tokens from the others while squared
fill grows: by a move of one piece, an exchange of one for one, one for two or two for one, the one that leaves the least
room. A bin that is full is settled; one that has given everything is gone. What a group leaves underfull is dealt anew
with the bins of other groups, until one group holds the rest or a round takes away few bins. Only ids and lengths are
shuffled, never texts or tokens.

Results by definition: every row of the documents gives one piece or more, null and empty texts one piece of the end
token alone. Sequences hold whole pieces without gaps from offset 0; their numbers mean nothing. Rows are told apart by a
number of their own, so repeated and null ids are packed like others. An empty table gives an empty result. Columns
besides ``doc_id`` are not carried. A slice of texts is tokenised at a time; memory follows the longest text.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.llm import common, ranges
from corpuslab.llm.words import HashIndex, folded
from corpuslab.session import checkpointed

PIECE = "piece int, start long, length long, ids_crc32 long"
# Words of at most so many bytes are remembered by a worker, so many of them.
LONGEST_WORD, MOST_WORDS = 64, 400_000
# A round that takes away less than this share of the underfull bins is the last.
GAIN = 0.02
# Partners for an exchange of one for two are looked for in so many of the emptiest bins.
EMPTIEST = 8
# Of the pieces of one length so many are tried as partners.
SAME = 8
_encoders: dict[int, Encoder] = {}
# How the tokenizers that are read by words cut a text (fixed value).
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# Plain bytes: visible ASCII but for the apostrophe, which may cut a word, and the sign that special tokens begin with.
_PLAIN = np.zeros(256, bool)
_PLAIN[0x21:0x7F] = True
_PLAIN[[0x27, 0x3C]] = False
_KIND = np.full(256, 3, np.int8)
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = 1
_KIND[0x30:0x3A] = 2


@dataclass(frozen=True)
class Settings:
    capacity: int = 2048
    end_id: int = 0
    group: int = 4096


class Merges:
    """The merges of a byte-level BPE with word ends, for many words at once.

    Every turn merges, in each word that still has one, all places of the pair that comes first in the tokenizer's
    order, from left to right. A merge makes only pairs that come later, so this is what merging one by one gives.
    """

    def __init__(self, vocabulary: dict[str, int], merges: list[list[str]], suffix: str):
        bytes_ = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        others = [b for b in range(256) if b not in bytes_]
        letter = {b: chr(b) for b in bytes_} | {b: chr(256 + k) for k, b in enumerate(others)}
        self.inner = np.array([vocabulary[letter[b]] for b in range(256)], np.int64)
        self.last = np.array([vocabulary[letter[b] + suffix] for b in range(256)], np.int64)
        left = np.array([vocabulary[a] for a, _ in merges], np.uint64)
        right = np.array([vocabulary[b] for _, b in merges], np.uint64)
        self.made = np.array([*(vocabulary[a + b] for a, b in merges), -1], np.int64)
        self.index = HashIndex(left << np.uint64(32) | right)
        self.none = len(merges)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        found = self.index.find(left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64))
        return np.where(found < 0, self.none, found).astype(np.int32)

    def ids(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, number of each one's ids)."""
        size = ends - starts
        symbols = self.inner[data[ranges.flat(starts, size)]]
        close = np.cumsum(size) - 1
        symbols[close] = self.last[data[ends - 1]]
        rank = np.full(len(symbols), self.none, np.int32)
        rank[:-1] = self._ranks(symbols[:-1], symbols[1:])
        rank[close] = self.none
        words, out, sizes = np.arange(len(size)), [], np.zeros(len(size), np.int64)
        done = []
        while len(words):
            begin = np.cumsum(size) - size
            best = np.minimum.reduceat(rank, begin)
            more = best < self.none
            if not more.all():
                ready = np.repeat(~more, size)
                out.append(symbols[ready])
                done.append(words[~more])
                sizes[words[~more]] = size[~more]
                symbols, rank, words, size, best = symbols[~ready], rank[~ready], words[more], size[more], best[more]
                if not len(words):
                    break
            chosen = np.flatnonzero(rank == np.repeat(best, size))
            if len(chosen) > 1:
                # In a row of places that overlap every other one is merged, from the first on.
                new = np.concatenate([[True], chosen[1:] != chosen[:-1] + 1])
                at = np.arange(len(chosen))
                chosen = chosen[(at - np.maximum.accumulate(np.where(new, at, 0))) % 2 == 0]
            symbols[chosen] = self.made[rank[chosen]]
            ends_word = np.zeros(len(symbols), bool)
            ends_word[np.cumsum(size) - 1] = True
            ends_word[chosen] = ends_word[chosen + 1]
            kept = np.ones(len(symbols), bool)
            kept[chosen + 1] = False
            size = np.add.reduceat(kept, np.cumsum(size) - size, dtype=np.int64)
            symbols, rank, ends_word = symbols[kept], rank[kept], ends_word[kept]
            at = chosen - np.arange(len(chosen))
            at = np.concatenate([at, at[at > 0] - 1])
            inner = ~ends_word[at]
            rank[at[~inner]] = self.none
            at = at[inner]
            rank[at] = self._ranks(symbols[at], symbols[at + 1])
        flat, sized = np.concatenate([np.zeros(0, np.int64), *out]), np.concatenate([np.zeros(0, np.int64), *done])
        begin = np.empty(len(sizes), np.int64)
        begin[sized] = np.cumsum(sizes[sized]) - sizes[sized]
        return flat[ranges.flat(begin, sizes)], sizes


class Encoder:
    """A tokenizer over many texts at once.

    Where the file is a lower-casing BPE that drops white space and cuts words as WORDS says, every distinct word of a
    slice is encoded once: plain ones (ASCII and Latin-1 letters, digits and signs) by Merges, all others by the
    tokenizer itself. Of any other file each text is encoded whole.
    """

    def __init__(self, tokenizer: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_str(tokenizer)
        self.known: dict[bytes, list[int]] = {}
        parts = json.loads(tokenizer)
        model, cuts = parts["model"], (parts.get("pre_tokenizer") or {}).get("pretokenizers", [])
        by_words = (
            [n.get("type") for n in (parts.get("normalizer") or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
            and [c.get("type") for c in cuts] == ["Split", "ByteLevel"] and cuts[0]["pattern"] == {"Regex": WORDS}
            and model.get("type") == "BPE" and model.get("end_of_word_suffix") and not model.get("dropout")
            and not any(t["lstrip"] or t["rstrip"] or not t["content"].startswith("<") for t in parts["added_tokens"])
        )
        self.merges = None
        if by_words:
            pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
            self.merges = Merges(model["vocab"], pairs, model["end_of_word_suffix"])

    def _encoded(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.known) > MOST_WORDS:
            self.known.clear()
        lists = [self.known.get(w) for w in words]
        missing = [k for k, x in enumerate(lists) if x is None]
        for k, found in zip(missing, self.tokenizer.encode_batch([words[k].decode() for k in missing], add_special_tokens=False), strict=True):
            lists[k] = found.ids
            if len(words[k]) <= LONGEST_WORD:
                self.known[words[k]] = found.ids
        sizes = np.array([len(x) for x in lists], np.int64)
        return np.fromiter(chain.from_iterable(lists), np.int64, int(sizes.sum())), sizes

    def _words(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
        """(bytes with plain words in lower case, starts, ends, whether plain, first word of each text and their number)."""
        starts, ends, _ = ranges.cut(data, offsets, ~ranges.SPACES)
        follows = np.zeros(len(data), bool)
        lead = np.flatnonzero(data[:-1] == 0xC3)
        lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]
        follows[lead] = follows[lead + 1] = True
        odd = ~(_PLAIN[data] | follows)
        count = np.zeros(len(data) + 1, np.int64)
        np.cumsum(odd, out=count[1:])
        plain = np.zeros(len(data) + 1, bool)
        whole = count[ends] == count[starts]
        plain[ranges.flat(starts[whole], (ends - starts)[whole])] = True
        low = np.where(plain[:-1], folded(data), data)
        # A plain stretch is cut where letters, digits and signs meet, and around every digit.
        kind = np.where(follows, 1, _KIND[data])
        cuts = np.flatnonzero(plain[1:-1] & plain[:-2] & ((kind[1:] != kind[:-1]) | (kind[1:] == 2))) + 1
        cuts = cuts[~np.isin(cuts, starts)]
        starts, ends = np.sort(np.concatenate([starts, cuts])), np.sort(np.concatenate([ends, cuts]))
        return low, starts, ends, plain[starts], np.searchsorted(starts, offsets)

    def ids(self, data: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts with their end token, first id of each text and their number at the end)."""
        if self.merges is None:
            raw = data.tobytes()
            flat, own = self._encoded([raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)])
            first = np.arange(len(offsets))
        else:
            low, starts, ends, plain, first = self._words(data, offsets)
            number, one = ranges.numbered(low, starts, ends)
            easy = plain[one]
            raw = low.tobytes()
            hard = [raw[a:b] for a, b in zip(starts[one[~easy]].tolist(), ends[one[~easy]].tolist(), strict=True)]
            found, counts = zip(self.merges.ids(low, starts[one[easy]], ends[one[easy]]), self._encoded(hard), strict=True)
            sizes, begin = np.empty(len(one), np.int64), np.empty(len(one), np.int64)
            sizes[easy], sizes[~easy] = counts
            begin[easy] = np.cumsum(counts[0]) - counts[0]
            begin[~easy] = np.cumsum(counts[1]) - counts[1] + len(found[0])
            own = sizes[number]
            flat = np.concatenate(found)[ranges.flat(begin[number], own)]
        before = np.concatenate([[0], np.cumsum(own)])[first] + np.arange(len(first))
        out = np.full(int(before[-1]), end_id, np.uint32)
        places = np.ones(len(out), bool)
        places[before[1:] - 1] = False
        out[places] = flat
        return out, before


def encoder(tokenizer: str) -> Encoder:
    key = zlib.crc32(tokenizer.encode())
    if key not in _encoders:
        _encoders[key] = Encoder(tokenizer)
    return _encoders[key]


def _pieces(shared, settings: Settings, with_ids: bool):
    kind = f"array<struct<{PIECE}{', ids array<int>' if with_ids else ''}>>"

    @F.arrow_udf(kind)
    def pieces(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            fields: list[list] = [[], [], [], [], []]
            ends = [0]
            for _, _, data, offsets in common.arrow_slices(column):
                ids, first = encoder(shared.value).ids(data, offsets, settings.end_id)
                ids = ids.astype("<u4")
                for low, high in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                    for k, start in enumerate(range(0, high - low, settings.capacity)):
                        own = ids[low + start : min(high, low + start + settings.capacity)]
                        for field, value in zip(fields, (k, start, len(own), zlib.crc32(own.tobytes()), own), strict=True):
                            field.append(value)
                    ends.append(len(fields[0]))
            arrays = [pa.array(fields[0], pa.int32()), *(pa.array(f, pa.int64()) for f in fields[1:4])]
            names = ["piece", "start", "length", "ids_crc32"]
            if with_ids:
                flat = np.concatenate([np.zeros(0, np.uint32), *fields[4]]).astype(np.int32)
                arrays.append(pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(fields[2])]).astype(np.int32), flat))
                names.append("ids")
            yield pa.ListArray.from_arrays(np.array(ends, np.int32), pa.StructArray.from_arrays(arrays, names))
        common.give_back()

    return pieces


def pieces_of(docs: DataFrame, tokenizer: str, settings: Settings, with_ids: bool = False) -> DataFrame:
    """(number, doc_id, piece, start, length, ids_crc32[, ids]) of every row of ``docs``; fixed by a checkpoint."""
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer)
    cut = docs.select("doc_id", F.explode(_pieces(shared, settings, with_ids)(F.col("text"))).alias("p"))
    return checkpointed(cut.select(F.monotonically_increasing_id().alias("number"), "doc_id", "p.*"))


class Bins:
    """Bins of pieces, by their lengths; ``search`` settles what can be filled and empties what it can."""

    def __init__(self, lengths: list[int], capacity: int):
        self.lengths, self.capacity = lengths, capacity
        self.bins: list[list[int]] = []
        self.fill: list[int] = []

    def best_fit(self) -> None:
        """Every piece, longest first, in the bin with the least room that is enough."""
        rooms, by_room = 0, {}
        for piece in sorted(range(len(self.lengths)), key=lambda k: (-self.lengths[k], k)):
            size = self.lengths[piece]
            enough = rooms >> size
            if enough:
                room = size + (enough & -enough).bit_length() - 1
                at = by_room[room].pop()
                if not by_room[room]:
                    rooms ^= 1 << room
            else:
                room, at = self.capacity, len(self.bins)
                self.bins.append([])
                self.fill.append(0)
            self.bins[at].append(piece)
            self.fill[at] += size
            left = room - size
            if left:
                by_room.setdefault(left, []).append(at)
                rooms |= 1 << left

    def given(self, bins: list[list[int]]) -> None:
        self.bins = bins
        self.fill = [sum(self.lengths[p] for p in b) for b in bins]

    def search(self) -> None:
        """Passes over the underfull bins, from the fullest, until none of them gains."""
        self.of, self.at, self.there = {}, {}, 0
        open_ = [k for k in range(len(self.bins)) if 0 < self.fill[k] < self.capacity]
        for k in open_:
            self._offer(k)
        gained = True
        while gained:
            gained = False
            open_ = [k for k in open_ if 0 < self.fill[k] < self.capacity]
            open_.sort(key=lambda k: -self.fill[k])
            self.emptiest = open_[: -EMPTIEST - 1 : -1]
            for k in open_:
                if 0 < self.fill[k] < self.capacity:
                    self._withdraw(k)
                    while self.fill[k] < self.capacity and self._take(k):
                        gained = True
                    if self.fill[k] < self.capacity:
                        self._offer(k)

    def _offer(self, k: int) -> None:
        for p in self.bins[k]:
            self._add(p, k)

    def _withdraw(self, k: int) -> None:
        for p in self.bins[k]:
            self._drop(p)

    def _add(self, p: int, k: int) -> None:
        size = self.lengths[p]
        self.of[p] = k
        self.at.setdefault(size, {})[p] = None
        self.there |= 1 << size

    def _drop(self, p: int) -> None:
        size = self.lengths[p]
        del self.of[p]
        del self.at[size][p]
        if not self.at[size]:
            self.there ^= 1 << size

    def _largest(self, most: int, above: int) -> int:
        """The greatest length on offer that is over ``above`` and at most ``most``, or 0."""
        size = (self.there & ((1 << (most + 1)) - 1)).bit_length() - 1
        return size if size > above else 0

    def _take(self, k: int) -> bool:
        """The exchange that leaves bin ``k`` the least room, if it makes squared fill greater."""
        room, own, lengths = self.capacity - self.fill[k], self.bins[k], self.lengths
        best, give, take = 0, (), ()
        given = [((), 0), *(((p,), lengths[p]) for p in {lengths[p]: p for p in own}.values())]
        given += [((p, q), lengths[p] + lengths[q]) for i, p in enumerate(own) for q in own[:i]] if len(own) <= 12 else []
        for out, size in given:
            got = self._largest(size + room, size + best)
            while got:
                # Squared fill grows where the partner's bin has less than this one will have.
                less = self.fill[k] + got - size
                p = next((p for p in islice(self.at[got], SAME) if self.fill[self.of[p]] < less), None)
                if p is not None:
                    best, give, take = got - size, out, (p,)
                    break
                got = self._largest(got - 1, size + best)
            if best == room:
                break
        if best < room:
            for b in self.emptiest:
                if b == k or not 0 < self.fill[b] <= self.fill[k] or len(self.bins[b]) > 12:
                    continue
                two = self.bins[b]
                for i, p in enumerate(two):
                    for q in two[:i]:
                        for out, size in given:
                            if len(out) < 2 and best < lengths[p] + lengths[q] - size <= room:
                                best, give, take = lengths[p] + lengths[q] - size, out, (p, q)
        if not best:
            return False
        b = self.of[take[0]]
        for p in take:
            self._drop(p)
            self.bins[b].remove(p)
            own.append(p)
        for p in give:
            own.remove(p)
            self.bins[b].append(p)
            self._add(p, b)
        self.fill[k] += best
        self.fill[b] -= best
        return True


def _packed(settings: Settings, fresh: bool):
    """One group: its pieces with the number and place in their sequence."""

    def pack(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("sequence_id", "ascending"), ("offset", "ascending"), ("number", "ascending")])
        bins = Bins(rows["length"].to_pylist(), settings.capacity)
        if fresh:
            bins.best_fit()
        else:
            known: dict[int, list[int]] = {}
            for place, sequence in enumerate(rows["sequence_id"].to_pylist()):
                known.setdefault(sequence, []).append(place)
            bins.given(list(known.values()))
        bins.search()
        number = rows["number"].to_pylist()
        sequence, offset, full = [0] * len(number), [0] * len(number), [False] * len(number)
        for pieces, fill in zip(bins.bins, bins.fill, strict=True):
            at, name = 0, min((number[p] for p in pieces), default=0)
            for p in sorted(pieces):
                sequence[p], offset[p], full[p] = name, at, fill == settings.capacity
                at += bins.lengths[p]
        for name, values, kind in (("sequence_id", sequence, pa.int64()), ("offset", offset, pa.int64()), ("full", full, pa.bool_())):
            rows = rows.set_column(rows.schema.get_field_index(name), name, pa.array(values, kind))
        return rows

    return pack


def place(pieces: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``pieces`` (number, length and others) with ``sequence_id`` and ``offset``."""
    start = pieces.select(*pieces.columns, F.col("number").alias("sequence_id"), F.lit(0).cast("long").alias("offset"), (F.col("length") == settings.capacity).alias("full"))
    done, open_ = start.where("full"), start.where(~F.col("full"))
    left = count = open_.count()
    number = 0
    while count:
        groups = -(-count // settings.group)
        dealt = open_.withColumn("_group", F.pmod(F.xxhash64("sequence_id", F.lit(number)), F.lit(groups)))
        packed = dealt.groupBy("_group").applyInArrow(_packed(settings, number == 0), dealt.schema).drop("_group")
        packed = checkpointed(packed)
        done, open_ = done.unionByName(packed.where("full")), packed.where(~F.col("full"))
        facts = open_.agg(F.count("*").alias("n"), F.count_if(F.col("number") == F.col("sequence_id")).alias("bins")).first()
        count, number = facts["n"], number + 1
        if groups == 1 or (number > 1 and facts["bins"] > (1 - GAIN) * left):
            break
        left = facts["bins"]
    return done.unionByName(open_).drop("full")


def pack(docs: DataFrame, tokenizer: str, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of ``docs``.

    ``tokenizer`` is the text of a tokenizer's file, which every task gets: a few megabytes, whatever the documents.
    """
    return place(pieces_of(docs, tokenizer, settings), settings).drop("number")


def sequences(docs: DataFrame, tokenizer: str, settings: Settings = Settings()) -> DataFrame:
    """(sequence_id, tokens, doc_ids): the packed sequences themselves; a sequence has at most ``capacity`` tokens."""
    pieces = pieces_of(docs, tokenizer, settings, with_ids=True)
    placed = place(pieces.drop("ids"), settings)
    rows = placed.join(pieces.select("number", "ids"), "number").select("sequence_id", F.struct("offset", "ids", "doc_id").alias("p"))
    made = rows.groupBy("sequence_id").agg(F.array_sort(F.collect_list("p")).alias("p"))
    return made.select("sequence_id", F.flatten("p.ids").alias("tokens"), F.col("p.doc_id").alias("doc_ids"))
