"""Language-model scores by a hierarchical Pitman-Yor model.

A word follows a context, the word before it.  Each context is a restaurant whose customers are the words that
followed it in training and whose tables each serve one word; a table is a customer of the restaurant above: that of
the contexts that end alike, and above these one that all share, whose tables draw from all known words and one
unknown word evenly.  Customers are seated by the Chinese restaurant process and re-seated by Gibbs sampling; the
probabilities of a text are averages over the last sweeps.

Everything about one word, its customers in all restaurants, is held in one shard.  Given the numbers of tables in
each restaurant, which are summed over all shards after every sweep, words are seated on their own.  There are
``CONTEXTS`` restaurants below (previous words fall into them by a hash) and so these sums have a fixed size; the
counts of words and pairs grow with the training texts and never leave the tasks.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.words import Numbers, arrow, column, importable, portions, spread, sums
from plumbline.session import scratch_folder

LOWER = bytes(x + 32 if 65 <= x <= 90 else x for x in range(256))
#: Contexts that end alike are a class; a context's number is that of its class and ``WITHIN`` bits of its hash.
CLASSES, WITHIN = 64, 10
CONTEXTS = CLASSES << WITHIN
STRENGTH = 1.0
#: Sweeps over all customers, and how many of the last are averaged.
SWEEPS, AVERAGED = 3, 2
#: Characters of the texts for each shard of words, and tokens and texts that a task holds at once.
SHARD_CHARACTERS, BLOCK_TOKENS, BLOCK_TEXTS = 12_000_000, 2_000_000, 65_536
WORDS_KEPT = 400_000
CELLS = 500_000
#: Customers of a word in a restaurant whose tables are drawn at once.
PARTY = 16
#: The end of a text is a token, and the context of its first word; no word is empty.
BOUNDARY = b""

ROW = {x: pa.binary() for x in ("words", "sizes", "contexts", "counts", "holders", "docs", "times")}
SENT = {"shard": pa.int32(), "kind": pa.int32(), "block": pa.int64(), **ROW}
SENT_COLUMNS = "shard int, kind int, block long, " + ", ".join(f"{x} binary" for x in ROW)
MODEL, REQUEST, TEXTS = 0, 1, 2
TOLD = {"block": pa.int64(), "kind": pa.int32(), "docs": pa.binary(), "score": pa.binary(), "base": pa.binary(), "known": pa.binary()}
TOLD_COLUMNS = "block long, kind int, docs binary, score binary, base binary, known binary"
TOTAL = {"class": pa.int32(), "numbers": pa.binary()}
SCALARS = ("tokens", "words", "tables0", "ones2", "twos2", "ones1", "twos1", "ones0", "twos0")


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from training; a NULL ``doc_id`` counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 7 == 2


def cut(values: np.ndarray) -> np.ndarray:
    """Where each stretch of equal values begins."""
    return np.flatnonzero(np.concatenate([np.ones(min(1, len(values)), dtype=bool), values[1:] != values[:-1]]))


def stretches(starts: np.ndarray, size: int) -> np.ndarray:
    return np.diff(starts, append=size)


class Coder:
    """Numbers of words, their hashes, and the contexts that they are."""

    def __init__(self) -> None:
        self.forget()

    def forget(self) -> None:
        self.numbers = Numbers()
        self.hashes, self.contexts = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint16)

    def tokens(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of all tokens one after the other, each text's with its end; and how many each text has."""
        lists = [(x or "").encode().translate(LOWER).split() for x in texts]
        end = self.numbers[BOUNDARY]
        numbers, bounds = self.numbers.of(lists)
        sizes = np.diff(bounds)
        out = np.full(len(numbers) + len(texts), end, dtype=np.int32)
        out[np.arange(len(numbers)) + np.repeat(np.arange(len(texts)), sizes)] = numbers
        if fresh := self.numbers.fresh:
            digest = xxhash.xxh64_intdigest
            hashes = np.array([digest(x) for x in fresh], dtype=np.uint64)
            classes = np.array([digest(x[-2:]) % CLASSES for x in fresh], dtype=np.uint64)
            contexts = classes << np.uint64(WITHIN) | hashes >> np.uint64(64 - WITHIN)
            self.hashes = np.concatenate([self.hashes, hashes])
            self.contexts = np.concatenate([self.contexts, contexts.astype(np.uint16)])
            fresh.clear()
        return out, sizes + 1


class Block:
    """Tokens of some texts, counted together."""

    def __init__(self, coder: Coder, shards: int) -> None:
        self.coder, self.shards = coder, shards
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.tokens = self.texts = 0

    def add(self, texts: Sequence[str | None]) -> np.ndarray:
        numbers, sizes = self.coder.tokens(texts)
        self.parts.append((numbers, sizes))
        self.tokens += len(numbers)
        self.texts += len(texts)
        return sizes

    def keys(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The words that occur, by shard and hash, as hashes and shards; and of each token, its word's place and context."""
        numbers = np.concatenate([x for x, _ in self.parts])
        end = self.coder.numbers[BOUNDARY]
        before = np.concatenate([np.array([end], dtype=np.int32), numbers[:-1]])
        seen = np.zeros(len(self.coder.numbers), dtype=bool)
        seen[numbers] = True
        words = np.flatnonzero(seen)
        hashes = self.coder.hashes[words]
        shards = (hashes % np.uint64(self.shards)).astype(np.int64)
        order = np.lexsort((hashes, shards))
        place = np.zeros(len(seen), dtype=np.uint64)
        place[words[order]] = np.arange(len(words), dtype=np.uint64)
        return hashes[order], shards[order], place[numbers], self.coder.contexts[before].astype(np.uint64)

    def counted(self) -> Iterator[pa.RecordBatch]:
        """A row for each shard: its words, how many contexts each follows, which, and how often."""
        if not self.tokens:
            return
        hashes, shards, place, context = self.keys()
        keys, counts = np.unique(place << np.uint64(16) | context, return_counts=True)
        yield from self.rows(MODEL, 0, hashes, shards, keys, counts=counts)

    def requested(self, block: int) -> Iterator[pa.RecordBatch]:
        """The same, and for each context the texts in which it is, and how often it is there."""
        if not self.tokens:
            return
        hashes, shards, place, context = self.keys()
        sizes = np.concatenate([x for _, x in self.parts])
        text = np.repeat(np.arange(len(sizes), dtype=np.uint64), sizes)
        keys, times = np.unique(place << np.uint64(32) | context << np.uint64(16) | text, return_counts=True)
        pairs = keys >> np.uint64(16)
        starts = cut(pairs)
        holders = stretches(starts, len(keys))
        docs = (keys & np.uint64(0xFFFF)).astype(np.uint16)
        yield from self.rows(REQUEST, block, hashes, shards, pairs[starts], holders=holders, docs=docs, times=times)

    def rows(self, kind, block, hashes, shards, keys, counts=None, holders=None, docs=None, times=None) -> Iterator[pa.RecordBatch]:
        word = (keys >> np.uint64(16)).astype(np.int64)
        sizes = np.bincount(word, minlength=len(hashes)).astype(np.uint32)
        contexts = (keys & np.uint64(0xFFFF)).astype(np.uint16)
        ends = np.cumsum(np.append(0, sizes), dtype=np.int64)
        inside = None if holders is None else np.cumsum(np.append(0, holders), dtype=np.int64)
        starts = cut(shards)
        for low, high in zip(starts, [*starts[1:], len(shards)], strict=True):
            a, b = ends[low], ends[high]
            row = {"words": hashes[low:high].tobytes(), "sizes": sizes[low:high].tobytes(), "contexts": contexts[a:b].tobytes()}
            if counts is not None:
                row["counts"] = counts[a:b].astype(np.int64).tobytes()
            if holders is not None:
                c, d = inside[a], inside[b]
                row["holders"] = holders[a:b].astype(np.uint32).tobytes()
                row["docs"], row["times"] = docs[c:d].tobytes(), times[c:d].astype(np.uint32).tobytes()
            yield sent(int(shards[low]), kind, block, row)


def sent(shard: int, kind: int, block: int, row: dict[str, bytes]) -> pa.RecordBatch:
    columns = {"shard": [shard], "kind": [kind], "block": [block], **{x: [row.get(x, b"")] for x in ROW}}
    return arrow(columns, SENT)


def counting(shards: int):
    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder()
        block = Block(coder, shards)
        for _, texts in portions(batches):
            block.add(texts)
            if block.tokens > BLOCK_TOKENS or len(coder.numbers) > WORDS_KEPT:
                yield from block.counted()
                coder.forget()
                block = Block(coder, shards)
        yield from block.counted()

    return count


def requesting(shards: int):
    """Rows for the shards, and one for each block with the ids of its texts, their tokens and whether they are held out."""

    def request(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, number = Coder(), TaskContext.get().partitionId() << 32
        block, ids, flags, sizes = Block(coder, shards), [], [], []

        def told() -> Iterator[pa.RecordBatch]:
            if block.texts:
                yield from block.requested(number)
                row = {"words": np.concatenate(ids).tobytes(), "contexts": np.concatenate(flags).tobytes(), "sizes": np.concatenate(sizes).tobytes()}
                yield sent(number % shards, TEXTS, number, row)

        for part, texts in portions(batches):
            for low in range(0, len(texts), BLOCK_TEXTS):
                some = part.slice(low, BLOCK_TEXTS)
                if block.texts + some.num_rows > BLOCK_TEXTS or block.tokens > BLOCK_TOKENS or len(coder.numbers) > WORDS_KEPT:
                    yield from told()
                    coder.forget()
                    number += 1
                    block, ids, flags, sizes = Block(coder, shards), [], [], []
                sizes.append(block.add(texts[low : low + BLOCK_TEXTS]))
                ids.append(some.column(0).fill_null(0).to_numpy())
                held = some.column(1).to_numpy(zero_copy_only=False).astype(np.uint8)
                flags.append(held | some.column(0).is_null().to_numpy(zero_copy_only=False).astype(np.uint8) << 1)
        yield from told()

    return request


def rows_of(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: batch.column(j)[i].as_py() for j, name in enumerate(batch.schema.names)}


def read(row: dict, **types) -> list[np.ndarray]:
    return [np.frombuffer(row[name], dtype=kind) for name, kind in types.items()]


def merged(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row of each shard from the rows of all blocks, which come one shard after the other."""
    shard, held = None, []

    def told() -> Iterator[pa.RecordBatch]:
        words, sizes, contexts, counts = (np.concatenate(x) for x in zip(*held, strict=True))
        distinct, place = np.unique(words, return_inverse=True)
        keys = np.repeat(place.astype(np.uint64), sizes) << np.uint64(16) | contexts
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        starts = cut(keys)
        keys, counts = keys[starts], np.add.reduceat(counts, starts)
        sizes = np.bincount((keys >> np.uint64(16)).astype(np.int64), minlength=len(distinct)).astype(np.uint32)
        contexts = (keys & np.uint64(0xFFFF)).astype(np.uint16)
        yield sent(shard, MODEL, -1, {"words": distinct.tobytes(), "sizes": sizes.tobytes(), "contexts": contexts.tobytes(), "counts": counts.tobytes()})

    for row in rows_of(batches):
        if row["shard"] != shard:
            if held:
                yield from told()
            shard, held = row["shard"], []
        held.append(read(row, words=np.uint64, sizes=np.uint32, contexts=np.uint16, counts=np.int64))
    if held:
        yield from told()


@dataclass
class Totals:
    """What the seating of words takes from all shards: customers and tables of the restaurants, and scalars."""

    customers2: np.ndarray
    tables2: np.ndarray
    tables1: np.ndarray
    scalars: dict[str, int]

    @property
    def customers1(self) -> np.ndarray:
        return self.tables2.reshape(CLASSES, -1).sum(axis=1)

    @property
    def customers0(self) -> int:
        return int(self.tables1.sum())

    def discounts(self) -> tuple[float, float, float]:
        """Of the lowest restaurants, the classes and the top, from how many words have one and two customers there."""
        return tuple(
            min(0.95, max(0.05, ones / max(1, ones + 2 * twos)))
            for ones, twos in ((self.scalars[f"ones{i}"], self.scalars[f"twos{i}"]) for i in (2, 1, 0))
        )

    def base(self) -> float:
        return 1 / (self.scalars["words"] + 1)


@dataclass
class Opening:
    """The weight of a new table for each entry, when ``t`` tables stand there.

    That is ``strength + discount * (rest + t)`` times the probability of the word in the restaurant above, of which the
    entry's own tables are customers.
    """

    discount: float
    rest: np.ndarray
    mass: np.ndarray
    slope: float
    least: np.ndarray
    below: np.ndarray

    def of(self, t: np.ndarray | int) -> np.ndarray:
        above = np.maximum(self.mass + self.slope * t, self.least) / self.below
        return (STRENGTH + self.discount * (self.rest + t)) * above

    def at(self, rows: np.ndarray) -> Opening:
        return Opening(self.discount, self.rest[rows], self.mass[rows], self.slope, self.least[rows], self.below[rows])


def ways(discount: float) -> np.ndarray:
    """For up to ``PARTY`` customers, the weight of all seatings of ``c`` at ``t`` tables, but for what opening the tables weighs."""
    found = np.zeros((PARTY + 1, PARTY + 1))
    found[1, 1] = 1
    for c in range(2, PARTY + 1):
        t = np.arange(1, c + 1)
        found[c, t] = found[c - 1, t - 1] + (c - 1 - discount * t) * found[c - 1, t]
    return found


class Seating:
    """The tables of many entries, an entry being a word in a restaurant; at first one table each.

    Entries of up to ``PARTY`` customers need no more than the number of their tables, which is drawn for all its customers
    at once; of others the sizes of the tables are held, and their customers are seated one by one.
    """

    def __init__(self, customers: np.ndarray) -> None:
        self.customers = customers.astype(np.int64)
        self.tables = np.ones(len(customers), dtype=np.int32)
        self.large = np.flatnonzero(self.customers > PARTY)
        self.sizes = self.customers[self.large]

    def sweep(self, customers: np.ndarray, opening: Opening, pick: np.random.Generator) -> None:
        """Seat all of the ``customers``, of whom there may be more or fewer than before, anew."""
        large = np.flatnonzero(customers > PARTY)
        sizes = self.sizes_of(large)
        self.customers = customers.astype(np.int64)
        known = ways(opening.discount)
        for c in range(2, PARTY + 1):
            rows = np.flatnonzero(customers == c)
            if len(rows):
                weights, running, own = np.empty((len(rows), c)), np.ones(len(rows)), opening.at(rows)
                for t in range(1, c + 1):
                    weights[:, t - 1] = known[c, t] * running
                    if t < c:
                        running *= own.of(t)
                weights = np.cumsum(weights, axis=1)
                self.tables[rows] = 1 + (weights[:, :-1] <= (pick.random(len(rows)) * weights[:, -1])[:, None]).sum(axis=1)
        self.tables[customers == 1] = 1
        lengths = self.tables[large].astype(np.int64)
        starts = np.cumsum(lengths) - lengths
        order = np.lexsort((customers[large], lengths))
        found, low = [], 0
        while low < len(order):
            width = int(lengths[order[low]])
            high = min(len(order), low + max(1, CELLS // (width + 4)))
            high = low + int(np.searchsorted(lengths[order[low:high]], 2 * width + 4, "right"))
            some = order[low:high]
            table = np.zeros((len(some), int(lengths[some].max()) + 3), dtype=np.int64)
            table[np.arange(table.shape[1]) < lengths[some, None]] = sizes[spread(starts[some], lengths[some])]
            table = reseated(table, self.customers[large[some]], opening.at(large[some]), pick)
            self.tables[large[some]] = (table > 0).sum(axis=1)
            found.append((some, table[table > 0]))
            low = high
        lengths = self.tables[large].astype(np.int64)
        starts = np.cumsum(lengths) - lengths
        self.large, self.sizes = large, np.zeros(int(lengths.sum()), dtype=np.int64)
        for some, seated_ in found:
            self.sizes[spread(starts[some], lengths[some])] = seated_

    def sizes_of(self, entries: np.ndarray) -> np.ndarray:
        """The sizes of the tables of some entries, one after the other; where none are held, all tables but one are of one."""
        lengths = self.tables[entries].astype(np.int64)
        starts = np.cumsum(lengths) - lengths
        found = np.ones(int(lengths.sum()), dtype=np.int64)
        found[starts] = self.customers[entries] - lengths + 1
        there = np.isin(entries, self.large)
        own = self.tables[self.large].astype(np.int64)
        begun = np.cumsum(own) - own
        at = np.searchsorted(self.large, entries[there])
        found[spread(starts[there], lengths[there])] = self.sizes[spread(begun[at], own[at])]
        return found


def wider(table: np.ndarray) -> np.ndarray:
    return np.concatenate([table, np.zeros_like(table)], axis=1)


def seat(table: np.ndarray, seen: np.ndarray, opening: np.ndarray, discount: float, barred: np.ndarray | None, pick) -> np.ndarray:
    """Seat one customer more in each of the rows ``seen``, which is not at the first table where that is ``barred``."""
    some = table[seen]
    weights = np.where(some > 0, some - discount, 0.0)
    if barred is not None:
        weights[barred, 0] = 0
    running = np.cumsum(weights, axis=1)
    at = (running <= (pick.random(len(seen)) * (running[:, -1] + opening))[:, None]).sum(axis=1)
    fresh = at == some.shape[1]
    free = (some == 0).argmax(axis=1)
    if (fresh & (some[np.arange(len(seen)), free] > 0)).any():
        table = wider(table)
        free = (table[seen] == 0).argmax(axis=1)
    table[seen, np.where(fresh, free, at)] += 1
    return table


def left_at(some: np.ndarray, pick: np.random.Generator, first: int = 0) -> np.ndarray:
    """The table of a customer chosen evenly among those at the tables from ``first`` on."""
    running = np.cumsum(some[:, first:], axis=1)
    return np.minimum(first + (running <= (pick.random(len(some)) * running[:, -1])[:, None]).sum(axis=1), some.shape[1] - 1)


def reseated(table: np.ndarray, customers: np.ndarray, opening: Opening, pick: np.random.Generator) -> np.ndarray:
    """The tables after a Gibbs sweep: for as many steps as there are customers, one chosen evenly leaves and is seated anew.

    Most steps take a customer from the largest table back to it; how many such steps come before the next other one
    is drawn from its geometric distribution, and they are not gone through one by one.
    """
    d = opening.discount
    need = customers - table.sum(axis=1)
    while len(seen := np.flatnonzero(need > 0)):
        table = seat(table, seen, opening.at(seen).of((table[seen] > 0).sum(axis=1)), d, None, pick)
        need[seen] -= 1
    while len(seen := np.flatnonzero(need < 0)):
        table[seen, left_at(table[seen], pick)] -= 1
        need[seen] += 1
    table = -np.sort(-table, axis=1)
    steps = customers.copy()
    seen = np.flatnonzero(customers > 1)
    while len(seen):
        some, all_ = table[seen], customers[seen]
        first, t = some[:, 0], (some > 0).sum(axis=1)
        back = (first - 1 - d) / (all_ - 1 - d * t + opening.at(seen).of(t))
        stay = np.where(first > 1, first / all_ * back, 0.0)
        steps[seen] -= pick.geometric(np.maximum(1 - stay, 1e-15))
        on = steps[seen] >= 0
        seen, some, all_, first, stay = seen[on], some[on], all_[on], first[on], stay[on]
        if not len(seen):
            break
        from_first = pick.random(len(seen)) * (1 - stay) < first / all_ - stay
        at = np.where(from_first, 0, left_at(some, pick, 1))
        table[seen, at] -= 1
        t = (table[seen] > 0).sum(axis=1)
        table = seat(table, seen, opening.at(seen).of(t), d, from_first & (first > 1), pick)
    return table


class Shard:
    """The customers of some words in all restaurants."""

    def __init__(self, row: dict | None = None) -> None:
        row = row or dict.fromkeys(ROW, b"")
        self.words, sizes, self.contexts, counts = read(row, words=np.uint64, sizes=np.uint32, contexts=np.uint16, counts=np.int64)
        word = np.repeat(np.arange(len(self.words)), sizes)
        self.pairs = word << 16 | self.contexts
        of_class = word * CLASSES + (self.contexts >> WITHIN)
        starts = cut(of_class)
        self.classes = of_class[starts]
        self.class_of = np.repeat(np.arange(len(starts), dtype=np.int32), stretches(starts, len(of_class)))
        self.word_of = self.classes // CLASSES
        self.counts = np.bincount(word, counts, len(self.words)).astype(np.int64)
        self.seats2 = Seating(counts)
        self.seats1 = Seating(np.bincount(self.class_of, minlength=len(starts)))
        self.seats0 = Seating(np.bincount(self.word_of, minlength=len(self.words)))

    def masses(self, totals: Totals, discounts) -> tuple[np.ndarray, np.ndarray]:
        """Numerators of the words' probabilities in the classes and at the top."""
        _, d1, d0 = discounts
        top = self.seats0.customers - d0 * self.seats0.tables + (STRENGTH + d0 * totals.scalars["tables0"]) * totals.base()
        p0 = top / (STRENGTH + totals.customers0)
        new = STRENGTH + d1 * totals.tables1[self.classes % CLASSES]
        return self.seats1.customers - d1 * self.seats1.tables + new * p0[self.word_of], top

    def sweep(self, totals: Totals, discounts, pick: np.random.Generator) -> None:
        """Seat all customers anew, from the lowest restaurants up, by the numbers of tables that all shards had before."""
        d2, d1, d0 = discounts
        middle, top = self.masses(totals, discounts)
        p0 = top / (STRENGTH + totals.customers0)
        of_class = self.classes % CLASSES
        new = (STRENGTH + d1 * totals.tables1[of_class]) * p0[self.word_of]
        t = self.seats2.tables
        low = Opening(
            d2, totals.tables2[self.contexts] - t, middle[self.class_of] - t, 1.0, new[self.class_of],
            STRENGTH + totals.customers1[of_class][self.class_of],
        )
        self.seats2.sweep(self.seats2.customers, low, pick)
        t = self.seats1.tables
        least = np.full(len(self.words), (STRENGTH + d0 * totals.scalars["tables0"]) * totals.base())
        below = np.full(len(t), STRENGTH + totals.customers0)
        between = Opening(d1, totals.tables1[of_class] - t, top[self.word_of] - t, 1.0, least[self.word_of], below)
        self.seats1.sweep(np.bincount(self.class_of, self.seats2.tables, len(t)).astype(np.int64), between, pick)
        t = self.seats0.tables
        even = np.full(len(t), totals.base())
        high = Opening(d0, totals.scalars["tables0"] - t, even, 0.0, even, np.ones(len(t)))
        self.seats0.sweep(np.bincount(self.word_of, self.seats1.tables, len(t)).astype(np.int64), high, pick)

    def totals(self) -> Totals:
        def of(values: np.ndarray, weights: np.ndarray, size: int) -> np.ndarray:
            return np.bincount(values, weights, size).astype(np.int64)

        few = {f"{name}{i}": int((x.customers == n).sum()) for i, x in ((2, self.seats2), (1, self.seats1), (0, self.seats0)) for name, n in (("ones", 1), ("twos", 2))}
        return Totals(
            of(self.contexts, self.seats2.customers, CONTEXTS), of(self.contexts, self.seats2.tables, CONTEXTS),
            of(self.classes % CLASSES, self.seats1.tables, CLASSES),
            {"tokens": int(self.counts.sum()), "words": len(self.words), "tables0": int(self.seats0.tables.sum()), **few},
        )

    def sample(self, totals: Totals, discounts) -> Sample:
        middle, top = self.masses(totals, discounts)
        low = self.seats2.customers - discounts[0] * self.seats2.tables
        new1 = STRENGTH + discounts[1] * totals.tables1
        kept1 = self.seats1.customers - discounts[1] * self.seats1.tables
        return Sample(totals, discounts, low, kept1, new1, top)

    def probabilities(self, words: np.ndarray, sizes: np.ndarray, contexts: np.ndarray, samples: Sequence[Sample]) -> tuple[np.ndarray, np.ndarray]:
        """Of each pair, averaged over the samples; and the counts of the words, 0 for one not seen in training."""
        place = found(self.words, words)
        word = np.repeat(place, sizes)
        classes = (contexts >> WITHIN).astype(np.int64)
        pair = found(self.pairs, np.where(word < 0, -1, word << 16 | contexts))
        middle = found(self.classes, np.where(word < 0, -1, word * CLASSES + classes))
        total = np.zeros(len(word))
        for x in samples:
            p0 = held(x.top, word, (STRENGTH + x.discounts[2] * x.totals.scalars["tables0"]) * x.totals.base())
            p0 = p0 / (STRENGTH + x.totals.customers0)
            p1 = (held(x.middle, middle) + x.new1[classes] * p0) / (STRENGTH + x.totals.customers1[classes])
            new = STRENGTH + x.discounts[0] * x.totals.tables2[contexts]
            total += (held(x.low, pair) + new * p1) / (STRENGTH + x.totals.customers2[contexts])
        return total / len(samples), held(self.counts, place).astype(np.int64)


@dataclass
class Sample:
    """A state of the seating: what customers leave to a word in the restaurants, less their discounts."""

    totals: Totals
    discounts: tuple[float, float, float]
    low: np.ndarray
    middle: np.ndarray
    new1: np.ndarray
    top: np.ndarray


def found(among: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """The place of each value asked for, -1 if it is not there."""
    if not len(among):
        return np.full(len(asked), -1)
    at = np.minimum(np.searchsorted(among, asked), len(among) - 1)
    return np.where(among[at] == asked, at, -1)


def held(values: np.ndarray, place: np.ndarray, otherwise: float = 0.0) -> np.ndarray:
    return np.where(place < 0, otherwise, values[place] if len(values) else otherwise)


def seated(shard: int, row: dict | None, before: Sequence[Totals], seed: int) -> Iterator[Shard]:
    """The shard after each of its sweeps, which are as many as ``before`` has totals to sweep by, always the same ones."""
    one = Shard(row)
    yield one
    for i, totals in enumerate(before):
        one.sweep(totals, before[0].discounts(), np.random.default_rng([seed, shard, i]))
        yield one


def totals_of(model: DataFrame, before: Sequence[Totals], seed: int) -> Totals:
    """The sums over all shards after ``len(before)`` sweeps.  The sweeps before the last are repeated, not stored."""

    def sweep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = np.zeros((CLASSES, 2 << WITHIN), dtype=np.int64)
        rest = np.zeros(CLASSES + len(SCALARS), dtype=np.int64)
        for row in rows_of(batches):
            *_, shard = seated(row["shard"], row, before, seed)
            found = shard.totals()
            whole += np.concatenate([x.reshape(CLASSES, -1) for x in (found.customers2, found.tables2)], axis=1)
            rest += np.concatenate([found.tables1, [found.scalars[x] for x in SCALARS]])
        numbers = [x.tobytes() for x in whole]
        yield arrow({"class": [*range(CLASSES), CLASSES], "numbers": [*numbers, rest.tobytes()]}, TOTAL)

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums_: dict[int, np.ndarray] = {}
        for row in rows_of(batches):
            (numbers,) = read(row, numbers=np.int64)
            sums_[row["class"]] = sums_.get(row["class"], 0) + numbers
        if sums_:
            yield arrow({"class": list(sums_), "numbers": [x.tobytes() for x in sums_.values()]}, TOTAL)

    columns = "class int, numbers binary"
    rows = model.mapInArrow(sweep, columns).repartition("class").mapInArrow(add, columns).collect()
    numbers = {row["class"]: np.frombuffer(row["numbers"], dtype=np.int64) for row in rows}
    nothing = np.zeros(2 << WITHIN, dtype=np.int64)
    halves = np.stack([numbers.get(i, nothing) for i in range(CLASSES)]).reshape(CLASSES, 2, -1)
    rest = numbers.get(CLASSES, np.zeros(CLASSES + len(SCALARS), dtype=np.int64))
    scalars = dict(zip(SCALARS, rest[CLASSES:].tolist(), strict=True))
    return Totals(halves[:, 0].ravel(), halves[:, 1].ravel(), rest[:CLASSES], scalars)


@dataclass
class Model:
    """The counts of all shards as a stored table, and the totals after each sweep, the first before any."""

    rows: DataFrame
    shards: int
    totals: list[Totals]
    seed: int


def train(texts: DataFrame, sweeps: int = SWEEPS, seed: int = 11) -> Model:
    """Count and seat the words of ``texts (text)``; a NULL text is an empty one, and has its end alone."""
    spark = texts.sparkSession
    importable(spark)
    texts = texts.select(column("text").cast("string").alias("text"))
    characters = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = 1 + int(characters) // SHARD_CHARACTERS
    folder = scratch_folder(spark, "customers")
    counts = texts.mapInArrow(counting(shards), SENT_COLUMNS).repartition("shard").sortWithinPartitions("shard")
    counts.mapInArrow(merged, SENT_COLUMNS).select("shard", "kind", "block", *ROW).write.parquet(folder)
    rows = spark.read.schema(SENT_COLUMNS).parquet(folder)
    totals: list[Totals] = []
    for _ in range(sweeps + 1):
        totals.append(totals_of(rows, totals, seed))
    return Model(rows, shards, totals, seed)


def score(docs: DataFrame, model: Model, averaged: int = AVERAGED) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` for every row of ``docs``.

    Texts are not sent about: each block of texts asks every shard for the probabilities of its pairs, along with the
    texts that hold them, and gets back sums for its texts.
    """
    importable(docs.sparkSession)
    doc_id = column("doc_id").cast("long")
    asked = docs.select(doc_id.alias("doc_id"), held_out(doc_id).alias("held"), column("text").cast("string").alias("text"))
    asked = asked.mapInArrow(requesting(model.shards), SENT_COLUMNS)
    totals, seed = model.totals, model.seed

    def answer(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, shard, samples = None, Shard(), []
        for row in rows_of(batches):
            if row["kind"] == TEXTS:
                yield arrow({"block": [row["block"]], "kind": [0], "docs": [row["words"]], "score": [row["sizes"]], "base": [row["contexts"]], "known": [b""]}, TOLD)
                continue
            if row["shard"] != number:
                number, samples = row["shard"], []
                for i, shard in enumerate(seated(number, row if row["kind"] == MODEL else None, totals[:-1], seed)):
                    if i > len(totals) - 1 - averaged:
                        samples.append(shard.sample(totals[i], totals[0].discounts()))
            if row["kind"] == REQUEST:
                yield answered(row, shard, samples)

    def finish(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = None
        for row in rows_of(batches):
            if row["kind"] == 0:
                if block:
                    yield block.told()
                block = Answer(row, totals[0].scalars["tokens"])
            else:
                block.add(row)
        if block:
            yield block.told()

    everything = model.rows.select(asked.columns).union(asked).repartition("shard").sortWithinPartitions("shard", "kind")
    answers = everything.mapInArrow(answer, TOLD_COLUMNS).repartition("block").sortWithinPartitions("block", "kind")
    return answers.mapInArrow(finish, SCORES)


def answered(row: dict, shard: Shard, samples: Sequence[Sample]) -> pa.RecordBatch:
    kinds = {"words": np.uint64, "sizes": np.uint32, "contexts": np.uint16, "holders": np.uint32, "docs": np.uint16, "times": np.uint32}
    words, sizes, contexts, holders, docs, times = read(row, **kinds)
    p, counts = shard.probabilities(words, sizes, contexts, samples)
    scalars = samples[0].totals.scalars
    base = np.log10((counts + 1) / (scalars["tokens"] + scalars["words"] + 1))
    pair = np.repeat(np.arange(len(contexts)), holders)
    word = np.repeat(np.arange(len(words)), sizes)[pair]
    some, at = np.unique(docs, return_inverse=True)
    columns = {
        "block": [row["block"]], "kind": [1], "docs": [some.tobytes()],
        "score": [np.bincount(at, np.log10(p)[pair] * times).tobytes()],
        "base": [np.bincount(at, base[word] * times).tobytes()],
        "known": [np.bincount(at, (counts > 0)[word] * times).astype(np.uint32).tobytes()],
    }
    return arrow(columns, TOLD)


SCORED = {
    "doc_id": pa.int64(), "held_out": pa.bool_(), "n_tokens": pa.int64(), "n_known": pa.int64(), "train_tokens": pa.int64(),
    "base_score": pa.float64(), "score": pa.float64(),
}
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


class Answer:
    """The sums for the texts of a block."""

    def __init__(self, row: dict, tokens: int) -> None:
        self.ids, self.sizes, self.flags = read(row, docs=np.int64, score=np.int64, base=np.uint8)
        self.tokens = tokens
        self.score, self.base = np.zeros(len(self.ids)), np.zeros(len(self.ids))
        self.known = np.zeros(len(self.ids), dtype=np.int64)

    def add(self, row: dict) -> None:
        docs, score, base, known = read(row, docs=np.uint16, score=np.float64, base=np.float64, known=np.uint32)
        self.score[docs] += score
        self.base[docs] += base
        self.known[docs] += known

    def told(self) -> pa.RecordBatch:
        columns = {
            "doc_id": pa.array(self.ids, mask=(self.flags & 2) > 0), "held_out": (self.flags & 1) > 0, "n_tokens": self.sizes,
            "n_known": self.known, "train_tokens": np.full(len(self.ids), self.tokens), "base_score": self.base, "score": self.score,
        }
        return arrow(columns, SCORED)


def report(docs: DataFrame, sweeps: int = SWEEPS, averaged: int = AVERAGED) -> DataFrame:
    """Scores of all rows by the model of those that are not held out.

    NULL and empty texts have their end alone.  Without training rows every token is unknown, with probability 1.  A
    table without rows gives none.
    """
    return score(docs, train(docs.where(~held_out(column("doc_id").cast("long"))), sweeps), averaged)
