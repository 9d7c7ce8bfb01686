"""Token ids of documents in binary files, in the order of ``doc_id``.

A file holds a stretch of documents: ``MAGIC``; the ids of all of them one after the other in patched
frame-of-reference blocks; the starts of the blocks as ``uint64``; the ``doc_id`` of each document as ``int64``,
a ``uint8`` that is 1 where it is NULL, and its number of ids as ``uint32``; ``TAIL``; ``MAGIC`` again.  Blocks but
the last hold ``BLOCK`` ids each, so that any stretch of ids is read from the blocks that it touches.

Which files count, in which order and how many ids they hold stands in a table beside them.  A task writes
under a name of its own; what failed or doubled tasks leave is in no row of the table, and no reader meets it.
"""

from __future__ import annotations

import gc
import json
import re
import struct
import uuid
from array import array
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm import pfor
from plumbline.llm.words import Numbers, Ragged, arrow, importable, sized, texts_of
from plumbline.session import scratch_folder

VOCABULARY = "word_bpe_49k.json"
END = 2
MAGIC = b"PFORIDS1"
TAIL = struct.Struct("<QQQQ")
WORDS_KEPT, PARTS_KEPT = 500_000, 1_000_000
TEXT_IN_FILE, CHARACTERS = 32_000_000, 2_000_000
WRITTEN = {"file": pa.string(), "place": pa.int64(), "docs": pa.int64(), "tokens": pa.int64()}
READ = {"doc_id": pa.int64(), "start": pa.int64(), "n_tokens": pa.int64(), "ids": pa.binary()}
#: How the tokenizer file that words are learnt for states its normaliser and its splitter.
NORMALISER = {
    "type": "Sequence",
    "normalizers": [
        {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"},
    ],
}
SPLITTER = {
    "type": "Sequence",
    "pretokenizers": [
        {
            "type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
            "behavior": "Removed", "invert": True,
        },
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
#: How the vocabulary's own splitting cuts a word without blanks; the last part stands for signs of any kind.
PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
#: Signs that normalise, split and lower-case as plainly as that pattern says.
PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")


def byte_letters() -> list[str]:
    """The letter that byte-level vocabularies use for each byte."""
    usual = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in usual]
    return [chr(b) if b in usual else chr(256 + rest.index(b)) for b in range(256)]


class Encoder:
    """Ids of texts by the tokenizers library, which is asked once for each part of a word as long as parts are kept.

    That is for a vocabulary that normalises and splits as ``NORMALISER`` and ``SPLITTER`` say: it drops white space
    and joins nothing across it, so that the ids of a text are those of its words.  With any other, which ``by_word`` tells,
    the library gets whole texts.
    """

    def __init__(self, model_file: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(model_file)
        stated = json.loads(self.tokenizer.to_str())
        self.by_word = stated["normalizer"] == NORMALISER and stated["pre_tokenizer"] == SPLITTER and stated["post_processor"] is None
        self.letters = byte_letters()
        self.parts: dict[str, bytes] = {}
        self.start()

    def start(self) -> None:
        # An empty word is what stands before the first blank of a text, and has no ids.
        self.numbers, self.ids = Numbers(), Ragged(np.uint32)
        assert (self.numbers[b""], self.numbers[END]) == (0, 1)
        self.numbers.fresh.clear()
        self.ids.append(np.array([END], dtype=np.uint32), np.array([0, 1]))

    def mapped(self, part: str) -> str:
        return part if part.isascii() else "".join(map(self.letters.__getitem__, part.encode()))

    def learn(self, fresh: list[bytes]) -> None:
        cut: list[list[str]] = []
        others = []
        for i, raw in enumerate(fresh):
            if raw.isalpha():
                cut.append([raw.lower().decode()])
            elif raw[:-1].isalpha() and 33 <= raw[-1] <= 126:
                cut.append([raw[:-1].lower().decode(), chr(raw[-1])])
            elif PLAIN.fullmatch(word := raw.decode()) and "<|" not in word:
                cut.append(PARTS.findall(word.lower()))
            else:
                cut.append([])
                others.append(i)
        tokenize, known = self.tokenizer.model.tokenize, self.parts
        unseen = {x for parts in cut for x in parts}.difference(known)
        known.update((x, array("I", [token.id for token in tokenize(self.mapped(x))]).tobytes()) for x in unseen)
        ids = [known[parts[0]] if len(parts) == 1 else b"".join([known[x] for x in parts]) for parts in cut]
        encoded = self.tokenizer.encode_batch_fast([fresh[i].decode() for i in others], add_special_tokens=False)
        for i, found in zip(others, encoded, strict=True):
            ids[i] = array("I", found.ids).tobytes()
        lengths = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4
        self.ids.append(np.frombuffer(b"".join(ids), dtype=np.uint32), lengths)
        if len(known) > PARTS_KEPT:
            known.clear()

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each with ``END`` behind it, and how many each has; a NULL text is an empty one."""
        texts = pc.fill_null(texts, "")
        if not self.by_word:
            found = [x.ids for x in self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
            counts = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) + 1
            flat = np.full(int(counts.sum()), END, dtype=np.uint32)
            inside = np.ones(len(flat), dtype=bool)
            inside[np.cumsum(counts) - 1] = False
            flat[inside] = np.fromiter(chain.from_iterable(found), dtype=np.uint32, count=int(inside.sum()))
            return flat, counts
        if len(self.numbers) > WORDS_KEPT:
            self.start()
        lists = pc.ascii_split_whitespace(texts)
        sizes = pc.list_value_length(lists).to_numpy()
        # A portion's words go through Python once each, however often they are there.
        coded = lists.flatten().dictionary_encode()
        words = pc.cast(coded.dictionary, pa.binary()).to_pylist()
        number = np.fromiter(map(self.numbers.__getitem__, words), dtype=np.int64, count=len(words))
        if self.numbers.fresh:
            # What is learnt holds no cycles, and looking for some among so many lists takes a tenth of the time.
            gc.disable()
            try:
                self.learn(self.numbers.fresh)
            finally:
                gc.enable()
            self.numbers.fresh.clear()
        all_words = np.ones(int(sizes.sum()) + len(sizes), dtype=np.int64)
        ends = np.cumsum(sizes + 1)
        inside = np.ones(len(all_words), dtype=bool)
        inside[ends - 1] = False
        all_words[inside] = number[coded.indices.to_numpy()]
        flat, counts = self.ids.take(all_words)
        return flat, np.diff(np.cumsum(counts)[ends - 1], prepend=0)


@cache
def encoder_of(model_file: str) -> Encoder:
    return Encoder(model_file)


class File:
    """Writes one file and gives its row of the table."""

    def __init__(self, folder: str, place: int) -> None:
        self.fs, path = pyarrow.fs.FileSystem.from_uri(folder)
        self.fs.create_dir(path)
        self.place, self.name = place, f"{place:08d}-{uuid.uuid4().hex}.pfor"
        self.out = self.fs.open_output_stream(f"{path}/{self.name}")
        self.out.write(MAGIC)
        self.at, self.starts, self.left = len(MAGIC), [], np.zeros(0, dtype=np.uint32)
        self.ids, self.counts = [], []
        self.tokens = 0

    def add(self, doc_ids: pa.Array, flat: np.ndarray, counts: np.ndarray) -> None:
        self.ids.append(doc_ids)
        self.counts.append(counts)
        self.tokens += len(flat)
        ready = np.concatenate([self.left, flat])
        whole = len(ready) // pfor.BLOCK * pfor.BLOCK
        self.put(ready[:whole])
        self.left = ready[whole:]

    def put(self, values: np.ndarray) -> None:
        for block in pfor.pack(values):
            self.starts.append(self.at)
            self.out.write(block)
            self.at += len(block)

    def close(self) -> dict:
        self.put(self.left)
        ids = pa.chunked_array(self.ids).combine_chunks()
        counts = np.concatenate(self.counts)
        self.out.write(np.array(self.starts, dtype="<u8").tobytes())
        self.out.write(ids.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
        self.out.write(ids.is_null().to_numpy(zero_copy_only=False).astype(np.uint8).tobytes())
        self.out.write(counts.astype("<u4").tobytes())
        self.out.write(TAIL.pack(self.at, len(self.starts), len(counts), self.tokens) + MAGIC)
        self.out.close()
        return {"file": self.name, "place": self.place, "docs": len(counts), "tokens": self.tokens}


class Reader:
    """Reads ids from a file without the blocks that it does not need."""

    def __init__(self, folder: str, name: str) -> None:
        fs, path = pyarrow.fs.FileSystem.from_uri(folder)
        self.file = fs.open_input_file(f"{path}/{name}")
        end = self.file.size() - len(MAGIC)
        last = self.file.read_at(TAIL.size + len(MAGIC), end - TAIL.size)
        if last[TAIL.size :] != MAGIC or self.file.read_at(len(MAGIC), 0) != MAGIC:
            raise ValueError(f"{name} is not a whole file of token ids")
        self.blocks_end, blocks, docs, self.tokens = TAIL.unpack(last[: TAIL.size])
        index = self.file.read_at(8 * blocks + 13 * docs, self.blocks_end)
        self.starts = np.frombuffer(index, "<u8", blocks).astype(np.int64)
        ids = np.frombuffer(index, "<i8", docs, 8 * blocks)
        null = np.frombuffer(index, np.uint8, docs, 8 * blocks + 8 * docs).astype(bool)
        self.doc_ids = pa.array(ids, mask=null)
        self.counts = np.frombuffer(index, "<u4", docs, 8 * blocks + 9 * docs).astype(np.int64)

    def ids(self, start: int, count: int) -> np.ndarray:
        """``count`` ids from the id with number ``start`` of the file."""
        if not count:
            return np.zeros(0, dtype=np.uint32)
        first, last = start // pfor.BLOCK, (start + count - 1) // pfor.BLOCK
        low = self.starts[first]
        high = self.starts[last + 1] if last + 1 < len(self.starts) else self.blocks_end
        raw = self.file.read_at(int(high - low), int(low))
        found = pfor.unpack(raw, self.starts[first : last + 1] - low)
        return found[start - first * pfor.BLOCK :][:count]


def qualified(spark: SparkSession, folder: str) -> str:
    """The folder as a URI: one without a scheme is Spark's default file system's, not this machine's."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def write(
    docs: DataFrame, folder: str, model_file: str | None = None, id_column: str = "doc_id", text_column: str = "text"
) -> None:
    """Encode all texts and write them to ``folder``, which all executors must reach.

    A NULL text is an empty one, and has the end id alone.  Documents go by ``doc_id``, NULL first;
    rows that repeat one by their text.  Rows are dealt by ranges of both, a file to a range, so that files come to about
    ``TEXT_IN_FILE`` characters.  A table without rows gives no file.
    """
    spark = docs.sparkSession
    model_file = model_file or public_tokenizers.path(VOCABULARY)
    rows = texts_of(docs, id_column, text_column)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # Rows of one id are told apart by how their texts begin, an order that the whole texts refine.
    begins = F.substring(F.col("text"), 1, 40).alias("begins")
    ordered = (
        rows.select("doc_id", begins, "text")
        .repartitionByRange(1 + size // TEXT_IN_FILE, F.asc_nulls_first("doc_id"), F.asc_nulls_first("begins"))
        .select("doc_id", "text")
        .sortWithinPartitions("doc_id", "text")
    )
    target = qualified(spark, folder)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(model_file)
        file = None
        for part in sized(batches, CHARACTERS):
            # The number of the range, which is that of the partition.
            file = file or File(f"{target}/ids", TaskContext.get().partitionId())
            file.add(part.column(0), *encoder.encode(part.column(1)))
        if file is not None:
            yield arrow({k: [v] for k, v in file.close().items()}, WRITTEN)

    written = ordered.mapInArrow(run, "file string, place long, docs long, tokens long")
    written.write.mode("overwrite").parquet(f"{folder}/files")


def bases(table: DataFrame) -> DataFrame:
    """``(file, base)``: the ids of all files before it, summed within a thousand files and over the thousands."""
    table = table.withColumn("thousand", F.floor(F.col("place") / 1000))
    whole = table.groupBy("thousand").agg(F.sum("tokens").alias("tokens"))
    above = F.sum("tokens").over(Window.orderBy("thousand")) - F.col("tokens")
    inside = F.sum("tokens").over(Window.partitionBy("thousand").orderBy("place")) - F.col("tokens")
    files = table.withColumn("inside", inside).join(whole.select("thousand", above.alias("above")), "thousand")
    return files.select("file", (F.col("above") + F.col("inside")).alias("base"))


def read(spark: SparkSession, folder: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids)`` of every document in the files, ``ids`` as they are stored unpacked.

    ``start`` counts the ids of all documents before it; ``ids`` are little-endian unsigned 32-bit integers.
    """
    importable(spark)
    table = spark.read.schema("file string, place long, docs long, tokens long").parquet(f"{folder}/files")
    files = bases(table)
    target = qualified(spark, folder)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                reader = Reader(f"{target}/ids", name)
                ends = np.concatenate([[0], np.cumsum(reader.counts)])
                at = 0
                while at < len(reader.counts):
                    to = max(at + 1, int(np.searchsorted(ends, ends[at] + 500_000, "right")) - 1)
                    raw = reader.ids(int(ends[at]), int(ends[to] - ends[at])).astype("<u4").tobytes()
                    parts = [raw[4 * (ends[i] - ends[at]) : 4 * (ends[i + 1] - ends[at])] for i in range(at, to)]
                    columns = {
                        "doc_id": reader.doc_ids.slice(at, to - at), "start": base + ends[at:to],
                        "n_tokens": reader.counts[at:to], "ids": parts,
                    }
                    yield arrow(columns, READ)
                    at = to

    dealt = files.repartition(max(1, table.count()), "file")
    return dealt.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def report(docs: DataFrame) -> DataFrame:
    folder = scratch_folder(docs.sparkSession, "tokens")
    write(docs, folder)
    return read(docs.sparkSession, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
