"""SentencePiece encoding with the N best segmentations, and decoding.

The best segmentations are those with the largest sums of piece scores.  Forward Viterbi scores
tell exactly how good the best beginning of every path can be, which makes them exact heuristics
for an A* search backwards over the lattice of pieces: every path it completes is the next best.

No piece goes on after a blank or beyond a line break, so that the lattice of a text falls apart there
into those of chunks, which repeat.  The two best scores of all new chunks are found at once; a
segmentation among the ``n`` best of a text differs from the best one in some of the ``n - 1`` chunks
whose second best costs least, and only these are searched.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from heapq import heappop, heappush

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.pieces import SPACE, Pieces, alike, arcs, characters, pieces_of
from plumbline.llm.words import Numbers, Ragged, arrow, importable, portions, sums, texts_of

VOCABULARY = "piece_bpe_32k.model"
CHUNK = re.compile(f"\n|{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+")
#: In place of a chunk: the character itself that pieces use for a blank.
MARK = 0
CHUNKS_KEPT = 300_000
SEGMENTATION = pa.list_(pa.struct([("score", pa.float64()), ("ids", pa.binary())]))
ENCODED = {"doc_id": pa.int64(), "segmentations": SEGMENTATION, "restored": pa.bool_()}
ENCODED_SQL = "doc_id long, segmentations array<struct<score: double, ids: binary>>, restored boolean"


def chunks(text: str | None) -> list:
    """The chunks of a text, a blank put before it; together they are the text.  An empty one has none."""
    if not text:
        return []
    if SPACE in text:
        parts = text.split(SPACE)
        found = CHUNK.findall(SPACE + parts[0].replace(" ", SPACE))
        for part in parts[1:]:
            found += [MARK, *CHUNK.findall(part.replace(" ", SPACE))]
        return found
    if "  " in text or text[0] == " ":
        return CHUNK.findall(SPACE + text.replace(" ", SPACE))
    found = (SPACE + text.replace(" ", f" {SPACE}").replace("\n", " \n ")).split(" ")
    return [x for x in found if x] if "\n" in text else found


class Lattice:
    """Segmentations of chunks: pieces, and for a character that is none its bytes at a low score."""

    def __init__(self, pieces: Pieces) -> None:
        self.pieces = pieces
        self.low = pieces.low
        self.scores = np.append(pieces.scores, -np.inf)
        self.number = {text: i for i, text in enumerate(pieces.texts)}

    def ids_of(self, text: str) -> list[int]:
        known = self.number.get(text)
        if known is not None:
            return [int(self.pieces.ids[known])]
        return self.pieces.byte_id[list(text.encode("utf-8", "surrogatepass"))].tolist()

    def best(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids one after the other, how many each word has, its best score, and how far off its second best is."""
        ids: list[np.ndarray] = [np.zeros(0, dtype=np.int64)] * len(words)
        top, gap = np.zeros(len(words)), np.zeros(len(words))
        for part in alike(words, 200_000):
            table, lengths = characters([words[i] for i in part])
            found = arcs(self.pieces, table)
            width, line = table.shape[1], np.arange(len(part))
            first = np.full((len(part), width + 1), -np.inf)
            second = first.copy()
            back = np.zeros((len(part), width + 1), dtype=np.int64)
            first[:, 0] = 0
            for j in range(1, width + 1):
                for n in range(1, min(len(found), j) + 1):
                    ids_here = found[n - 1][:, j - n]
                    add = self.scores[ids_here]
                    if n == 1:
                        add = np.where(ids_here < 0, self.low, add)
                    one, two = first[:, j - n] + add, second[:, j - n] + add
                    better = one > first[:, j]
                    second[:, j] = np.where(better, np.maximum(first[:, j], two), np.maximum(second[:, j], one))
                    first[better, j] = one[better]
                    back[better, j] = n
            top[part] = first[line, lengths]
            gap[part] = first[line, lengths] - second[line, lengths]
            at, steps = lengths.copy(), []
            while at.any():
                size = back[line, at]
                numbers = np.full(len(part), -2, dtype=np.int64)
                for n in np.unique(size[at > 0]):
                    here = (size == n) & (at > 0)
                    numbers[here] = found[n - 1][line[here], at[here] - n]
                at -= np.where(at > 0, size, 0)
                steps.append(numbers)
            if not steps:
                continue
            path = np.stack(steps[::-1], axis=1)
            strange = (path == -1).any(axis=1)
            for i, row in zip(part.tolist(), path, strict=True):
                ids[i] = row[row != -2]
            for k in np.nonzero(strange)[0]:
                ids[part[k]] = np.array(self.cut(words[part[k]], back[k]), dtype=np.int64)
            for k in np.nonzero(~strange)[0]:
                ids[part[k]] = self.pieces.ids[ids[part[k]]]
        counts = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        return np.concatenate([*ids, np.zeros(0, dtype=np.int64)]), counts, top, gap

    def cut(self, word: str, back: np.ndarray) -> list[int]:
        found, at = [], len(word)
        while at:
            size = int(back[at])
            found.append(self.ids_of(word[at - size : at]))
            at -= size
        return [x for part in reversed(found) for x in part]

    def search(self, word: str, n: int) -> list[tuple[float, list[int]]]:
        """The ``n`` best segmentations of a chunk, best first; fewer if there are no more.

        Paths of equal score come in a fixed order: at first the one that ends in shorter pieces.
        """
        ends: list[list[tuple[int, float]]] = [[] for _ in range(len(word) + 1)]
        ahead = [0.0] + [-np.inf] * len(word)
        for j in range(1, len(word) + 1):
            for size in range(1, min(self.pieces.longest, j) + 1):
                known = self.number.get(word[j - size : j])
                if known is not None:
                    score = float(self.scores[known])
                elif size == 1:
                    score = self.low
                else:
                    continue
                ends[j].append((size, score))
                ahead[j] = max(ahead[j], ahead[j - size] + score)
        # Of equal hopes the one met last goes first, which finishes a path before it begins another.
        heap = [(-ahead[-1], 0, len(word), 0.0, None)]
        found, met = [], 0
        while heap and len(found) < n:
            _, _, at, behind, path = heappop(heap)
            if at == 0:
                ids, start = [], 0
                while path is not None:
                    size, path = path
                    ids += self.ids_of(word[start : start + size])
                    start += size
                found.append((behind, ids))
                continue
            for size, score in reversed(ends[at]):
                met -= 1
                so_far = behind + score
                heappush(heap, (-(so_far + ahead[at - size]), met, at - size, so_far, (size, path)))
        return found


class Encoder:
    """Encodes texts; what it knows of chunks is kept for the texts to come, if not too much."""

    def __init__(self, model_file: str, n_best: int) -> None:
        self.lattice = Lattice(pieces_of(model_file))
        self.n_best = n_best
        pieces = self.lattice.pieces
        self.bytes = [b""] * pieces.size
        for i, text in zip(pieces.ids.tolist(), pieces.texts, strict=True):
            self.bytes[i] = text.replace(SPACE, " ").encode()
        for byte, i in enumerate(pieces.byte_id.tolist()):
            self.bytes[i] = bytes([byte])
        self.start()

    def start(self) -> None:
        self.numbers, self.ids = Numbers(), Ragged(np.uint32)
        self.words: list = []
        self.top, self.gap = np.zeros(0), np.zeros(0)
        self.others: dict = {}

    def learn(self, fresh: list) -> None:
        words = [x for x in fresh if x != MARK]
        flat, counts, top, gap = self.lattice.best(words)
        if len(words) < len(fresh):
            place = fresh.index(MARK)
            mark = self.lattice.pieces.byte_id[list(SPACE.encode())]
            at = int(counts[:place].sum())
            flat = np.insert(flat, at, mark)
            counts, top = np.insert(counts, place, len(mark)), np.insert(top, place, self.lattice.low)
            gap = np.insert(gap, place, np.inf)
        self.ids.append(flat, counts)
        self.words += fresh
        self.top, self.gap = np.concatenate([self.top, top]), np.concatenate([self.gap, gap])

    def encode(self, texts: list[str | None]) -> list[list[tuple[float, bytes]]]:
        """For each text its best segmentations: their scores, and ids as little-endian unsigned 32-bit integers."""
        if len(self.numbers) > CHUNKS_KEPT:
            self.start()
        numbers, bounds = self.numbers.of([chunks(x) for x in texts])
        if self.numbers.fresh:
            self.learn(list(self.numbers.fresh))
            self.numbers.fresh.clear()
        flat, counts = self.ids.take(numbers)
        ends = np.concatenate([[0], np.cumsum(counts)])
        scores = sums(self.top[numbers], bounds)
        raw = flat.astype("<u4").tobytes()
        out = []
        for i in range(len(texts)):
            low, high = int(bounds[i]), int(bounds[i + 1])
            best = raw[4 * ends[low] : 4 * ends[high]]
            found = [(float(scores[i]), best)]
            if high > low and self.n_best > 1:
                gaps = self.gap[numbers[low:high]]
                most = min(self.n_best - 1, len(gaps))
                few = np.argpartition(gaps, most - 1)[:most] if most < len(gaps) else np.arange(len(gaps))
                # Of equal gaps the first chunks go first, whichever the partition happens to give.
                limit = gaps[few].max()
                few = np.concatenate([np.nonzero(gaps < limit)[0], np.nonzero(gaps == limit)[0]])[:most]
                found += self.changed(best, np.sort(few[np.isfinite(gaps[few])]) + low, numbers, ends, low, float(scores[i]))
            out.append(found)
        return out

    def changed(self, best, places, numbers, ends, low, score) -> list[tuple[float, bytes]]:
        """The further segmentations of a text that change the chunks at ``places``."""
        ways: list[tuple[float, tuple[int, ...]]] = [(0.0, ())]
        lists = []
        for place in places:
            number = int(numbers[place])
            if number not in self.others:
                self.others[number] = self.lattice.search(self.words[number], self.n_best)
            lists.append(self.others[number])
            top = lists[-1][0][0]
            ways = sorted((cost + top - way[0], (*taken, k)) for cost, taken in ways for k, way in enumerate(lists[-1]))
            ways = ways[: self.n_best]
        found = []
        for cost, taken in ways[1:]:
            parts, done = [], 0
            for place, options, k in zip(places, lists, taken, strict=True):
                if k:
                    start, end = (4 * int(ends[p] - ends[low]) for p in (place, place + 1))
                    parts += [best[done:start], np.array(options[k][1], dtype="<u4").tobytes()]
                    done = end
            found.append((score - cost, b"".join([*parts, best[done:]])))
        return found

    def decode(self, ids: bytes) -> str:
        return self.bytes_of(ids)[1:].decode("utf-8", "replace")

    def bytes_of(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


def encode(
    docs: DataFrame, n_best: int = 4, model_file: str | None = None, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """``(doc_id, segmentations, restored)`` for every row.

    ``segmentations`` are the ``n_best`` best of the text, best first, or all if there are fewer: the
    score, and the ids as little-endian unsigned 32-bit integers.  A NULL or empty text has one, without
    ids.  ``restored`` says that decoding the best one gave the text (an empty one for NULL).
    """
    model_file = model_file or public_tokenizers.path(VOCABULARY)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model_file, n_best)
        for part, texts in portions(batches):
            found = encoder.encode(texts)
            restored = [encoder.decode(x[0][1]) == (t or "") for x, t in zip(found, texts, strict=True)]
            told = [[{"score": s, "ids": ids} for s, ids in x] for x in found]
            yield arrow({"doc_id": part.column(0), "segmentations": told, "restored": restored}, ENCODED)

    return texts_of(docs, id_column, text_column).mapInArrow(run, ENCODED_SQL)


def decode(encoded: DataFrame, model_file: str | None = None) -> DataFrame:
    """``(doc_id, text)`` from rows of ``doc_id`` and ``ids`` as :func:`encode` gives them; NULL stays NULL."""
    model_file = model_file or public_tokenizers.path(VOCABULARY)
    importable(encoded.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model_file, 1)
        for batch in batches:
            texts = [None if x is None else encoder.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, type=pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def report(docs: DataFrame) -> DataFrame:
    best = F.col("segmentations")[0]["ids"]
    return encode(docs).select(
        "doc_id",
        (F.octet_length(best) / 4).cast("long").alias("n_tokens"),
        F.crc32(best).alias("ids_crc32"),
        F.transform("segmentations", lambda x: x["score"]).alias("scores"),
        F.transform("segmentations", lambda x: F.crc32(x["ids"])).alias("crc32s"),
        "restored",
    )
