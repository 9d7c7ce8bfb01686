"""Language identification by unigram piece models that sum over all segmentations."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.pieces import SPACE, Pieces, alike, arcs, characters, pieces_of
from plumbline.llm.words import Numbers, arrow, column, importable, portions, sums, texts_of
from plumbline.session import scratch_folder

VOCABULARY = "piece_bpe_32k.model"
#: ASCII letters in lower case, and bytes of other characters, which are looked at word by word.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
LETTER_RUN = re.compile(r"[^\W\d_]+")
#: Numbers grow by this factor a character, which keeps products of many probabilities in range.
SCALE = 1000.0
UNKNOWN = 1e-7
LONGEST = 64
WORDS_KEPT = 250_000
UNDETERMINED = "und"
COUNTED = {"lang": pa.string(), "word": pa.string(), "n": pa.int64()}
EXPECTED = {"lang": pa.int64(), "piece": pa.int64(), "n": pa.float64()}
PREDICTED = {"doc_id": pa.int64(), "lang_pred": pa.string(), "score": pa.float64()}


def raw_words(text: str | None) -> list[bytes]:
    return (text or "").lower().encode().translate(LETTERS).split()


def letter_runs(raw: bytes) -> list[str]:
    if raw.isascii():
        return [raw.decode()]
    return LETTER_RUN.findall(raw.decode())


@dataclass
class Model:
    """Languages, their shares of the training rows, and the probability of each piece in each."""

    languages: list[str]
    prior: np.ndarray
    probability: np.ndarray
    vocabulary: str


def scaled(pieces: Pieces, probability: np.ndarray) -> np.ndarray:
    """With a factor for each character, and a row of zeros at the end for what is no piece."""
    sizes = np.array([len(x) for x in pieces.texts], dtype=np.float64)
    return np.concatenate([probability * (SCALE**sizes)[:, None], np.zeros((1, probability.shape[1]))])


def forward(found: list[np.ndarray], weight, size: int, width: int, rescaled: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Sums over the segmentations of each beginning of each word, and the logs of what they were divided by."""
    count = len(found[0])
    alpha = np.zeros((count, width + 1, size))
    alpha[:, 0] = 1.0
    logs = np.zeros((count, width + 1))
    for j in range(1, width + 1):
        for n in range(1, min(len(found), j) + 1):
            alpha[:, j] += alpha[:, j - n] * weight(found[n - 1][:, j - n])
        unknown = found[0][:, j - 1] < 0
        alpha[unknown, j] += alpha[unknown, j - 1] * (UNKNOWN * SCALE)
        logs[:, j] = logs[:, j - 1]
        if rescaled and j % 16 == 0:
            most = alpha[:, j - 15 : j + 1].max(axis=(1, 2))
            alpha[:, j - 15 : j + 1] /= most[:, None, None]
            logs[:, j - 15 : j + 1] += np.log(most)[:, None]
    return alpha, logs


def log_likelihoods(pieces: Pieces, weights: np.ndarray, words: Sequence[str]) -> np.ndarray:
    """A row for each word, a column for each language."""
    out = np.zeros((len(words), weights.shape[1]))
    for part in alike(words):
        table, lengths = characters([words[i] for i in part])
        alpha, logs = forward(arcs(pieces, table), lambda ids: weights[ids], weights.shape[1], table.shape[1])
        line = np.arange(len(part))
        ends = np.log(np.maximum(alpha[line, lengths], 1e-300)) + logs[line, lengths][:, None]
        out[part] = ends - lengths[:, None] * np.log(SCALE)
    return out


def expectations(
    pieces: Pieces, weights: np.ndarray, words: Sequence[str], langs: np.ndarray, counts: np.ndarray
) -> np.ndarray:
    """How often each piece is expected in each language, over all segmentations of the words."""
    expected = np.zeros(weights.size)
    size = weights.shape[1]
    for part in alike(words, 200_000):
        table, lengths = characters([words[i] for i in part])
        width, lang, line = table.shape[1], langs[part], np.arange(len(part))
        found = arcs(pieces, table)

        def weight(ids: np.ndarray, lang: np.ndarray = lang) -> np.ndarray:
            return weights[ids, lang][:, None]

        alpha, _ = forward(found, weight, 1, width, rescaled=False)
        alpha = alpha[:, :, 0]
        beta = np.zeros((len(part), width + 1))
        beta[line, lengths] = 1.0
        for j in range(width - 1, -1, -1):
            for n in range(1, min(len(found), width - j) + 1):
                beta[:, j] += weights[found[n - 1][:, j], lang] * beta[:, j + n]
            unknown = (found[0][:, j] < 0) & (j < lengths)
            beta[unknown, j] += beta[unknown, j + 1] * (UNKNOWN * SCALE)
        share = counts[part] / np.maximum(beta[:, 0], 1e-300)
        for n in range(1, len(found) + 1):
            ids = found[n - 1]
            there = ids >= 0
            row, place = np.nonzero(there)
            got = alpha[row, place] * weights[ids[there], lang[row]] * beta[row, place + n] * share[row]
            expected += np.bincount(ids[there] * size + lang[row], got, minlength=weights.size)
    return expected.reshape(weights.shape)


def train(
    labelled: DataFrame,
    text_column: str = "text",
    lang_column: str = "lang",
    vocabulary: str | None = None,
    rounds: int = 2,
    smoothing: float = 0.01,
) -> Model:
    """Piece probabilities of each language by expectation-maximisation over all words of all rows.

    Rows with a NULL language or text teach nothing.  Words longer than ``LONGEST`` letters are
    learnt in stretches of that many.  What comes to the driver is a number for each piece and
    language.
    """
    spark = labelled.sparkSession
    importable(spark)
    vocabulary = vocabulary or public_tokenizers.path(VOCABULARY)
    rows = labelled.select(column(lang_column).alias("lang"), column(text_column).cast("string").alias("text")).where(
        "lang IS NOT NULL AND text IS NOT NULL"
    )
    folder = scratch_folder(spark, "words")
    rows.mapInArrow(counted, "lang string, word string, n long").groupBy("lang", "word").agg(
        F.sum("n").alias("n")
    ).write.parquet(folder)
    words = spark.read.schema("lang string, word string, n long").parquet(folder)
    shares = rows.groupBy("lang").count().orderBy("lang").collect()
    languages = [row["lang"] for row in shares]
    total = np.array([row["count"] for row in shares], dtype=np.float64)
    pieces = pieces_of(vocabulary)
    probability = np.full((len(pieces), len(languages)), 1 / len(pieces))
    for _ in range(rounds if languages else 0):
        found = words.mapInArrow(expecting(vocabulary, languages, probability), "lang long, piece long, n double")
        got = found.groupBy("lang", "piece").agg(F.sum("n").alias("n")).toPandas()
        sums_ = np.zeros_like(probability)
        sums_[got["piece"].to_numpy(), got["lang"].to_numpy()] = got["n"].to_numpy()
        probability = (sums_ + smoothing) / (sums_.sum(axis=0) + smoothing * len(pieces))
    return Model(languages, total / max(1.0, total.sum()), probability, vocabulary)


def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, texts in portions(batches, 4_000_000):
        by_lang: dict[str, Counter] = {}
        for lang, text in zip(part.column(0).to_pylist(), texts, strict=True):
            by_lang.setdefault(lang, Counter()).update(raw_words(text))
        for lang, raw in by_lang.items():
            words: Counter = Counter()
            for word, n in raw.items():
                for run in letter_runs(word):
                    for i in range(0, len(run), LONGEST):
                        words[run[i : i + LONGEST]] += n
            yield arrow({"lang": [lang] * len(words), "word": list(words), "n": list(words.values())}, COUNTED)


def expecting(vocabulary: str, languages: list[str], probability: np.ndarray):
    number = {lang: i for i, lang in enumerate(languages)}

    def expect(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(vocabulary)
        weights = scaled(pieces, probability)
        total = np.zeros(weights.shape)
        for batch in batches:
            langs = np.array([number[x] for x in batch.column(0).to_pylist()], dtype=np.int64)
            words = [SPACE + x for x in batch.column(1).to_pylist()]
            total += expectations(pieces, weights, words, langs, batch.column(2).to_numpy().astype(np.float64))
        piece, lang = np.nonzero(total[:-1])
        yield arrow({"lang": lang, "piece": piece, "n": total[piece, lang]}, EXPECTED)

    return expect


class Scorer:
    """Scores of words, each kept for the texts to come as long as there are not too many."""

    def __init__(self, model: Model) -> None:
        self.model, self.pieces = model, pieces_of(model.vocabulary)
        self.weights = scaled(self.pieces, model.probability)
        self.numbers = Numbers()
        self.kept = np.zeros((0, len(model.languages) + 1))

    def rows(self, raw: list[bytes]) -> np.ndarray:
        """For each raw word: its log likelihoods, and how many letters it has."""
        words = [letter_runs(x) for x in raw]
        flat = [SPACE + x for runs in words for x in runs]
        bounds = np.concatenate([[0], np.cumsum([len(x) for x in words])]).astype(np.int64)
        each = np.zeros((len(flat), self.kept.shape[1]))
        each[:, :-1] = log_likelihoods(self.pieces, self.weights, flat)
        each[:, -1] = [len(x) - 1 for x in flat]
        return sums(each, bounds)

    def score(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        languages = self.model.languages
        if not languages:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts))
        if len(self.numbers) > WORDS_KEPT:
            self.numbers.forget()
            self.kept = self.kept[:0]
        ids, bounds = self.numbers.of([raw_words(x) for x in texts])
        if self.numbers.fresh:
            self.kept = np.concatenate([self.kept, self.rows(self.numbers.fresh)])
            self.numbers.fresh.clear()
        total = np.stack([sums(self.kept[ids, k], bounds) for k in range(self.kept.shape[1])], axis=1)
        logs = total[:, :-1] + np.log(self.model.prior)
        best = logs.argmax(axis=1)
        with np.errstate(under="ignore"):
            share = 1 / np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1)
        letters = total[:, -1] > 0
        return [languages[b] if x else UNDETERMINED for b, x in zip(best, letters, strict=True)], np.where(letters, share, 0.0)


def predicting(model: Model):
    def predict(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for part, texts in portions(batches):
            names, score = scorer.score(texts)
            yield arrow({"doc_id": part.column(0), "lang_pred": names, "score": score}, PREDICTED)

    return predict


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, lang_pred, score)`` for every row: the likeliest language and its probability.

    A text that is NULL, empty or without a letter is ``und`` with score 0; equally likely languages
    go to the first by name.  A model taught by nothing answers ``und``.
    """
    return texts_of(docs).mapInArrow(predicting(model), "doc_id long, lang_pred string, score double")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def report(docs: DataFrame) -> DataFrame:
    model = train(docs.where(~held_out(F.col("doc_id"))))
    found = predict(docs, model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def recognised(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose language is told with a probability of ``least`` or more, as they were."""
    text, schema = docs.columns.index("text"), docs.schema

    def keep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            order = [*(i for i in range(batch.num_columns) if i != text), text]
            for part, texts in portions([batch.select(order)]):
                names, score = scorer.score(texts)
                stay = [n != UNDETERMINED and s >= least for n, s in zip(names, score, strict=True)]
                yield part.filter(pa.array(stay, type=pa.bool_())).select(batch.schema.names)

    importable(docs.sparkSession)
    return docs.mapInArrow(keep, schema)
