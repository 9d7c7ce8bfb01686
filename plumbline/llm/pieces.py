"""A fixed public vocabulary of pieces, and the lattice of all segmentations of many words at once."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import cache

import numpy as np

STEP = np.uint64(0x9E3779B97F4A7C15)
SPACE = "▁"
NEVER = -1e8


class Pieces:
    """The ordinary pieces of a SentencePiece model file: their texts, ids and scores.

    Control pieces and byte pieces are not among them; ``byte_id`` says which piece stands for each
    byte.  Pieces of blanks alone have a score below ``NEVER`` in the file, as a last resort; they
    take ``low`` here, which is also the score of a character that is no piece.
    """

    def __init__(self, model_file: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        size = model.vocab_size()
        usual = [
            i
            for i in range(size)
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
        ]
        self.ids = np.array(usual, dtype=np.int64)
        self.texts = [model.id_to_piece(i) for i in usual]
        scores = np.array([model.get_score(i) for i in usual])
        self.low = float(scores[scores > NEVER].min()) - 10
        self.scores = np.maximum(scores, self.low)
        self.byte_id = np.array([model.piece_to_id(f"<0x{i:02X}>") for i in range(256)], dtype=np.int64)
        self.size = size
        self.longest = max(map(len, self.texts))
        hashes = np.array([self.hash_of(x) for x in self.texts], dtype=np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.order = hashes[order], order.astype(np.int32)
        # Most looked-up stretches are no pieces, which a table of one byte for a hash's ending tells first.
        self.perhaps = np.zeros(1 << 22, dtype=bool)
        self.perhaps[hashes >> np.uint64(42)] = True

    def __len__(self) -> int:
        return len(self.texts)

    @staticmethod
    def hash_of(text: str) -> int:
        value = 0
        for x in text:
            value = (value * int(STEP) + ord(x) + 1) & (2**64 - 1)
        return value

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The number of the piece of each hash, -1 if there is none."""
        found = np.full(hashes.shape, -1, dtype=np.int32)
        maybe = np.nonzero(self.perhaps[hashes.ravel() >> np.uint64(42)])[0]
        asked = hashes.ravel()[maybe]
        at = np.minimum(np.searchsorted(self.hashes, asked), len(self.hashes) - 1)
        right = self.hashes[at] == asked
        found.ravel()[maybe[right]] = self.order[at[right]]
        return found


@cache
def pieces_of(model_file: str) -> Pieces:
    return Pieces(model_file)


def characters(words: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points, a row for each word, zero beyond its end; and the lengths."""
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    width = int(lengths.max(initial=0))
    table = np.zeros((len(words), width), dtype=np.uint32)
    flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    table[np.arange(width) < lengths[:, None]] = flat
    return table, lengths


def alike(words: Sequence[str], cells: int = 400_000) -> Iterator[np.ndarray]:
    """Positions of words of like lengths, so that their rows come to about ``cells`` characters."""
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    order = np.argsort(lengths, kind="stable")
    start = 0
    while start < len(order):
        width = max(1, int(lengths[order[start]]))
        end = min(len(order), start + max(1, cells // width))
        # Rows get little longer than their shortest word.
        end = min(end, start + int(np.searchsorted(lengths[order[start:end]], width * 1.25 + 1, "right")))
        yield order[start:end]
        start = end


def arcs(pieces: Pieces, table: np.ndarray) -> list[np.ndarray]:
    """For each length from 1: the piece of that length starting at each place of each word, or -1."""
    width = table.shape[1]
    letter = table.astype(np.uint64) + np.uint64(1)
    hashes = letter
    found = [pieces.find(hashes)]
    for size in range(2, min(pieces.longest, width) + 1):
        hashes = hashes[:, :-1] * STEP + letter[:, size - 1 :]
        found.append(pieces.find(hashes))
    return found
