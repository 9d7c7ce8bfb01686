"""Passages of a benchmark in documents, found through the CGK embedding and verified by edit distance.

Texts are compared as words: runs of letters and digits in lower case.  A document holds an item of
``n`` words if some stretch of it is ``floor(0.2 n)`` or fewer word insertions, deletions and
substitutions away.

The CGK embedding copies a sequence into one three times as long; a random bit drawn for the place
and the word decides whether the walk moves on or repeats the word.  Two sequences a few edits
apart fall into step again after each edit, so that many places of their copies agree: edit distance
becomes Hamming distance.  Sampling a few places and asking for equality, again and again with other
bits and places, finds the pairs whose copies agree well.

Windows as long as an item start where the diagonal of a run of words shared with it begins.  Which
ones are worth embedding is decided by counts that lose nothing: ``k`` edits leave a run of
``(n - k) / (k + 1)`` words of the item intact, and at least ``n - 1 - 2 k`` of its word pairs.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.words import arrow, column, portions, spread, texts_of

SIMILARITY = 0.8
REPEATS = 48
SAMPLED = 2
WORDS_AT_ONCE = 1_000_000
KEPT = bytes(c if chr(c).isalnum() or c >= 128 else 32 for c in range(256))
FOUND = {
    "doc_id": pa.int64(), "item_id": pa.int64(), "distance": pa.int64(),
    "start_word": pa.int64(), "end_word": pa.int64(),
}


def normal_words(text: str | None) -> list[bytes]:
    return (text or "").lower().encode().translate(KEPT).split()


def mixed(x: np.ndarray) -> np.ndarray:
    """Evenly spread 64-bit hashes of numbers."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Sampler:
    """Hashes of sampled places of CGK copies: one for each repeat."""

    def __init__(self, repeats: int = REPEATS, sampled: int = SAMPLED, seed: int = 7) -> None:
        self.repeats, self.sampled, self.seed = repeats, sampled, seed

    def keys(self, rows: np.ndarray) -> np.ndarray:
        """A row of keys for each row of words, all of one length."""
        count, n = rows.shape
        # Walks have passed the end by about the place 2 n, where all copies agree.
        places = np.random.default_rng([self.seed, n]).integers(0, max(1, 2 * n), (self.repeats, self.sampled))
        padded = np.concatenate([rows, np.full((count, 1), -1)], axis=1)
        own = np.arange(self.repeats, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        at = np.zeros((count, self.repeats), dtype=np.int64)
        keys = np.broadcast_to(own, (count, self.repeats)).copy()
        line = np.arange(count)[:, None]
        for place in range(int(places.max(initial=0)) + 1):
            word = padded[line, at]
            for _ in range(self.sampled):
                taken = places[:, _] == place
                if taken.any():
                    keys[:, taken] = mixed(keys[:, taken] * np.uint64(31) + word[:, taken].astype(np.uint64))
            salt = np.uint64((place + 1) * 0xD1B54A32D192ED03 & (2**64 - 1))
            bit = mixed(word.astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D) + own + salt) >> np.uint64(63)
            at = np.minimum(at + bit.astype(np.int64), n)
        return keys


class Postings:
    """For hashes of word runs: the items and the places in them."""

    def __init__(self, keys: np.ndarray, items: np.ndarray, places: np.ndarray) -> None:
        order = np.argsort(keys, kind="stable")
        self.items, self.places = items[order], places[order]
        self.keys, self.first, self.many = np.unique(keys[order], return_index=True, return_counts=True)

    def at(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of ``keys`` are there, and their numbers here."""
        if not len(self.keys):
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        number = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        there = np.nonzero(self.keys[number] == keys)[0]
        return there, number[there]

    def expand(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each posting of each number: which of ``numbers`` it is of, its item and its place."""
        many = self.many[numbers]
        chosen = spread(self.first[numbers], many)
        return np.repeat(np.arange(len(numbers)), many), self.items[chosen], self.places[chosen]


def runs(ids: np.ndarray, size: int, base: int) -> np.ndarray:
    """A number for each run of ``size`` words, that of the run starting there."""
    key = ids[: len(ids) - size + 1].copy()
    for i in range(1, size):
        key = key * base + ids[i : len(ids) - size + 1 + i]
    return key


class Finder:
    """A block of items, and the search for them in texts."""

    def __init__(self, items: list[tuple[int, str | None]], similarity: float = SIMILARITY, sampler: Sampler | None = None) -> None:
        words = [(name, normal_words(text)) for name, text in items]
        words = [(name, text) for name, text in words if text]
        self.names = pa.array([name for name, _ in words], type=pa.int64())
        self.number = {w: i for i, w in enumerate(dict.fromkeys(chain.from_iterable(t for _, t in words)), 1)}
        self.base = len(self.number) + 1
        self.texts = [np.array([self.number[w] for w in text], dtype=np.int64) for _, text in words]
        self.size = np.array([len(t) for t in self.texts], dtype=np.int64)
        self.edits = np.floor(self.size * (1 - similarity) + 1e-9).astype(np.int64)
        intact = np.minimum(3, np.maximum(1, -(-(self.size - self.edits) // (self.edits + 1))))
        self.pairs = np.unique(np.concatenate([runs(t, 2, self.base) for t in self.texts if len(t) > 1] or [[0]]))
        self.seeds = {int(s): self.seeds_of(int(s), np.nonzero(intact == s)[0]) for s in np.unique(intact)}
        self.sampler = sampler or Sampler()
        self.tables = {int(n): self.table_of(np.nonzero(self.size == n)[0]) for n in np.unique(self.size)}

    def seeds_of(self, size: int, items: np.ndarray) -> Postings:
        keys = [runs(self.texts[i], size, self.base) for i in items]
        places = [np.arange(len(k)) for k in keys]
        owners = [np.full(len(k), i) for i, k in zip(items, keys, strict=True)]
        return Postings(*(np.concatenate(x) for x in (keys, owners, places)))

    def table_of(self, items: np.ndarray) -> Postings:
        keys = self.sampler.keys(np.stack([self.texts[i] for i in items]))
        return Postings(keys.ravel(), np.repeat(items, keys.shape[1]), np.zeros(keys.size, dtype=np.int64))

    def search(self, texts: list[str | None]) -> dict[str, np.ndarray]:
        """The best place of each item in each text that holds it."""
        lists = [normal_words(x) for x in texts]
        bounds = np.zeros(len(lists) + 1, dtype=np.int64)
        np.cumsum([len(x) for x in lists], out=bounds[1:])
        ids = np.fromiter(map(self.number.get, chain.from_iterable(lists), repeat(0)), dtype=np.int64, count=bounds[-1])
        text, start, item = self.candidates(*self.windows(ids, bounds), ids, bounds)
        return self.verified(text, start, item, ids, bounds)

    def windows(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(text, start, size)`` of the windows to embed."""
        shared = np.zeros(len(ids) + 1, dtype=np.int64)
        if len(ids) > 1:
            pair = runs(ids, 2, self.base)
            known = np.searchsorted(self.pairs, pair)
            known = self.pairs[np.minimum(known, len(self.pairs) - 1)] == pair
            known &= (ids[:-1] > 0) & (ids[1:] > 0)
            shared[1:-1] = np.cumsum(known)
            shared[-1] = shared[-2]
        found = []
        for size, seeds in self.seeds.items():
            if len(ids) < size:
                continue
            keys = runs(ids, size, self.base)
            usable = np.logical_and.reduce([ids[i : len(ids) - size + 1 + i] > 0 for i in range(size)])
            place = np.nonzero(usable)[0]
            there, number = seeds.at(keys[place])
            which, item, offset = seeds.expand(number)
            at = place[there][which]
            text = np.searchsorted(bounds, at, "right") - 1
            start, n, k = at - offset, self.size[item], self.edits[item]
            low = np.maximum(start - k, bounds[text])
            high = np.minimum(start + n + k, bounds[text + 1])
            enough = shared[np.maximum(high - 1, low)] - shared[low] >= n - 1 - 2 * k
            keep = enough & (high - low >= n - k) & (at + size <= bounds[text + 1])
            found.append(np.stack([text[keep], start[keep] - bounds[text[keep]], n[keep]], axis=1))
        table = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 3), dtype=np.int64)
        return table[:, 0], table[:, 1], table[:, 2]

    def candidates(self, text, start, size, ids, bounds) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows and items that share a key in some repeat."""
        found = [np.zeros((0, 3), dtype=np.int64)]
        for n in np.unique(size):
            chosen = np.nonzero(size == n)[0]
            for part in np.array_split(chosen, -(-len(chosen) // 4096)):
                place = start[part, None] + np.arange(n)
                inside = (place >= 0) & (place < np.diff(bounds)[text[part], None])
                first = bounds[text[part], None]
                words = np.where(inside, ids[np.where(inside, place + first, first)], 0)
                keys = self.sampler.keys(words)
                there, number = self.tables[int(n)].at(keys.ravel())
                which, item, _ = self.tables[int(n)].expand(number)
                window = part[there[which] // keys.shape[1]]
                found.append(np.unique(np.stack([text[window], start[window], item], axis=1), axis=0))
        table = np.concatenate(found)
        return table[:, 0], table[:, 1], table[:, 2]

    def verified(self, text, start, item, ids, bounds) -> dict[str, np.ndarray]:
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for n in np.unique(self.size[item]):
            chosen = np.nonzero(self.size[item] == n)[0]
            k = int(self.edits[item[chosen[0]]])
            for part in np.array_split(chosen, -(-len(chosen) // 2048)):
                length = np.diff(bounds)[text[part]]
                low = np.maximum(0, start[part] - k)
                place = low[:, None] + np.arange(n + 2 * k)
                inside = place < np.minimum(length, start[part] + n + k)[:, None]
                first = bounds[text[part], None]
                # -1 stands beyond the text and 0 for words of no item; neither equals any of an item's.
                region = np.where(inside, ids[np.where(inside, place + first, first)], -1)
                wanted = np.stack([self.texts[i] for i in item[part]])
                last = edit_row(wanted, region, True)
                last[:, 1:][~inside] = n + k + 1
                distance, end = last.min(axis=1), last.argmin(axis=1)
                good = distance <= k
                back = end[good, None] - 1 - np.arange(n + 2 * k)
                turned = np.where(back >= 0, region[good][np.arange(good.sum())[:, None], np.maximum(back, 0)], -1)
                length_back = edit_row(wanted[good][:, ::-1], turned, False).argmin(axis=1)
                for j, taken in zip(np.nonzero(good)[0], length_back, strict=True):
                    key = (int(text[part[j]]), int(item[part[j]]))
                    stop = int(low[j] + end[j])
                    value = (int(distance[j]), stop - int(taken), stop)
                    if key not in best or value < best[key]:
                        best[key] = value
        rows = sorted((t, i, *v) for (t, i), v in best.items())
        columns = np.array(rows, dtype=np.int64).reshape(-1, 5)
        return {"text": columns[:, 0], "item": columns[:, 1], "distance": columns[:, 2], "start": columns[:, 3], "end": columns[:, 4]}


def edit_row(wanted: np.ndarray, region: np.ndarray, free_start: bool) -> np.ndarray:
    """The last row of the edit distances of each row of ``wanted`` to the beginnings of ``region``.

    With ``free_start`` they are those to the best stretch that ends there.
    """
    width = np.arange(region.shape[1] + 1)
    row = np.tile(np.zeros_like(width) if free_start else width, (len(wanted), 1))
    for i in range(wanted.shape[1]):
        step = np.empty_like(row)
        step[:, 0] = i + 1
        step[:, 1:] = np.minimum(row[:, :-1] + (region != wanted[:, i : i + 1]), row[:, 1:] + 1)
        row = np.minimum.accumulate(step - width, axis=1) + width
    return row


def blocks_of(benchmark: DataFrame, item_column: str, text_column: str) -> Iterator[list[tuple[int, str]]]:
    """The items, some at a time: each block is of about ``WORDS_AT_ONCE`` words, whatever their number."""
    items = benchmark.select(column(item_column).cast("long").alias("item_id"), column(text_column).cast("string").alias("text"))
    items = items.where("text IS NOT NULL")
    words = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-int(words) // (5 * WORDS_AT_ONCE)))
    for block in range(blocks):
        here = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        yield [tuple(row) for row in here.orderBy("item_id", "text").collect()]


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    item_column: str = "item_id",
    text_column: str = "text",
    similarity: float = SIMILARITY,
) -> DataFrame:
    """``(doc_id, item_id, distance, start_word, end_word)`` of the best place of each item in each row.

    The items are the query set, held by every task in blocks of a bounded number of words; the
    documents are read once for each block.  NULL and empty texts hold nothing and are held by
    nothing; of rows and items that are repeated, each gives its own rows.  An item's place may
    have up to a fifth of its words changed; the window search then finds it in all but a few of a
    thousand cases (``tests/llm/test_contamination.py`` measures it), and always if it is unchanged.
    """
    found = None
    for items in blocks_of(benchmark, item_column, text_column):
        finder = Finder(items, similarity)
        part = texts_of(docs).mapInArrow(searching(finder), "doc_id long, item_id long, distance long, start_word long, end_word long")
        found = part if found is None else found.union(part)
    return found


def searching(finder: Finder):
    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in portions(batches):
            got = finder.search(texts)
            ids = part.column(0).take(pa.array(got["text"]))
            columns = {
                "doc_id": ids, "item_id": finder.names.take(pa.array(got["item"])), "distance": got["distance"],
                "start_word": got["start"], "end_word": got["end"],
            }
            yield arrow(columns, FOUND)

    return search


def clean(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` that hold no item, as they were."""
    kept = docs
    text = docs.columns.index("text")
    schema = docs.schema

    for items in blocks_of(benchmark, "item_id", "text"):
        finder = Finder(items, similarity)

        def without(batches: Iterable[pa.RecordBatch], finder: Finder = finder) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                order = [*(i for i in range(batch.num_columns) if i != text), text]
                for part, texts in portions([batch.select(order)]):
                    held = np.unique(finder.search(texts)["text"])
                    stay = np.setdiff1d(np.arange(part.num_rows), held)
                    yield part.take(pa.array(stay)).select(batch.schema.names)

        texts_of(docs)
        kept = kept.mapInArrow(without, schema)
    return kept
