"""Token ids in Parquet list columns.

A row holds a document's id, its number of ids and their list. Documents are dealt by
ranges of (doc_id, text hash), so files follow each other in ascending doc_id order and
rows do within a file. Ids are dictionary- or delta-encoded, row groups and pages have
set sizes, and the writer adds page indexes, so a reader can fetch counts without ids
and ids of a range of documents without the rest.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, scratch_path, small_batches

END_ID = 2
ROW_GROUP_BYTES = 32 << 20
PAGE_BYTES = 64 << 10
FILE_BYTES = 64 << 20
#: Ranges of ids dealt to tasks; beyond it a task writes several files in a row.
MOST_RANGES = 20_000
#: Different words whose ids a task remembers; beyond it the memory starts anew.
MEMORY_WORDS = 600_000
#: Text that a task encodes at a time.
SLICE_BYTES = 4 << 20


def _byte_kinds() -> np.ndarray:
    """0: ASCII white space, 1: letter, 2: digit, 3: punctuation but the apostrophe, 4: the rest."""
    kind = np.full(256, 4, np.uint8)
    kind[[9, 10, 11, 12, 13, 32]] = 0
    kind[[*range(65, 91), *range(97, 123)]] = 1
    kind[48:58] = 2
    kind[[x for x in range(33, 127) if kind[x] == 4 and x != 39]] = 3
    return kind


def word_starts(data: np.ndarray, documents: np.ndarray) -> np.ndarray:
    """Where words start in the texts' bytes: at each document, after white space, around digits, and between letters and punctuation.

    The tokenizer drops white space and merges across none of these, so a text's ids are
    its words' ids in a row; the apostrophe, with which it joins letters, parts nothing.
    """
    if not len(data):
        return np.zeros(0, np.int64)
    k = _byte_kinds()[data]
    was, now = k[:-1], k[1:]
    low, high = np.minimum(was, now), np.maximum(was, now)
    parts = (now != 0) & ((was == 0) | (now == 2) | (was == 2) | ((low == 1) & (high == 3)))
    at = np.concatenate(([True], parts))
    at[documents[documents < len(data)]] = True
    return np.flatnonzero(at)


class _Memory:
    """A tokenizer and the ids of the words it has met. A task has its own: workers that wait for tasks would keep it."""

    def __init__(self, vocab: str, end_id: int):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocab)
        self.end_id = end_id
        # which ids close a word, if the tokenizer marks them
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.last = None
        if suffix:
            self.last = np.zeros(self.tokenizer.get_vocab_size(), bool)
            self.last[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith(suffix)]] = True
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        # ids of the end, then of all known words, in arrays that grow by doubling; where each starts
        self.flat, self.ends, self.n = np.full(1 << 16, self.end_id, np.int32), np.zeros(1 << 16, np.int64), 1
        self.ends[1] = 1

    def _ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words in a row, and how many each has."""
        if self.last is not None and words[0].isalpha():
            # words of letters alone end with the one id that closes a word: they are encoded in lines, which takes less than one by one
            lines = [" ".join(words[i : i + 64]) for i in range(0, len(words), 64)]
            flat = np.fromiter(chain.from_iterable(e.ids for e in self.tokenizer.encode_batch_fast(lines, add_special_tokens=False)), np.int32)
            stops = np.flatnonzero(self.last[flat]) + 1
            if len(stops) == len(words) and stops[-1] == len(flat):
                return flat, np.diff(stops, prepend=0)
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), np.int32, int(size.sum())), size

    def learn(self, words: list[str]) -> None:
        letters = [w for w in words if w.isalpha()]
        rest = [w for w in words if not w.isalpha()]
        for group in (letters, rest):
            for at in range(0, len(group), 4096):
                some = group[at : at + 4096]
                flat, size = self._ids(some)
                self.known.update(zip(some, range(self.n, self.n + len(some)), strict=True))
                start = int(self.ends[self.n])
                while len(self.ends) < self.n + len(some) + 1:
                    self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
                while len(self.flat) < start + len(flat):
                    self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
                self.flat[start : start + len(flat)] = flat
                self.ends[self.n + 1 : self.n + len(some) + 1] = start + np.cumsum(size)
                self.n += len(some)

    def places(self, words: list[str]) -> np.ndarray:
        """Each word's place among the known ones; 0 is the end."""
        if len(self.known) > MEMORY_WORDS:
            self.clear()
        known = self.known
        self.learn(list(dict.fromkeys(w for w in words if w not in known)))
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))

    def spell(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words in a row, and where each word's start among them (n + 1 numbers)."""
        first = self.ends[place]
        size = self.ends[place + 1] - first
        out = np.concatenate(([0], np.cumsum(size)))
        return self.flat[np.arange(out[-1]) + np.repeat(first - out[:-1], size)], out


def _encoder(vocab: str, end_id: int):
    """A function of Arrow batches (…, text) that replaces the text by its ids; a word is encoded once for as long as it is remembered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import pyarrow.compute as pc

        memory = _Memory(vocab, end_id)
        added = [t.content for t in memory.tokenizer.get_added_tokens_decoder().values()]

        def encode(texts: pa.Array) -> pa.ListArray:
            texts = pc.fill_null(texts, "").cast(pa.string())
            _, offsets, raw = texts.buffers()
            o = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1]
            data = np.frombuffer(raw, np.uint8)[o[0] : o[-1]] if o[-1] > o[0] else np.zeros(0, np.uint8)
            o = (o - o[0]).astype(np.int64)
            starts = word_starts(data, o)
            # a text with the string of an added token is one word: the tokenizer alone knows what to do with it
            whole = np.zeros(len(texts), bool)
            for a in added:
                whole |= pc.match_substring(texts, a, ignore_case=True).to_numpy(zero_copy_only=False)
            if whole.any():
                inside = whole[np.searchsorted(o, starts, side="right") - 1]
                starts = starts[~inside | np.isin(starts, o)]
            bounds = np.searchsorted(starts, o)
            ends = np.append(starts, len(data)).astype(np.int32)
            words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(ends), pa.py_buffer(data)).dictionary_encode()
            names = pc.ascii_trim_whitespace(words.dictionary)
            # the tokenizer lowers letters itself, but composes them with marks before that
            plain = pc.if_else(pc.string_is_ascii(names), pc.ascii_lower(names), names).to_pylist()
            if whole.any():
                plain = [n if any(a.lower() in n.lower() for a in added) else p for n, p in zip(names.to_pylist(), plain, strict=True)]
            place = memory.places(plain)[words.indices.to_numpy(zero_copy_only=False)] if len(starts) else np.zeros(0, np.int64)
            # the end counts as word 0 after each document's words
            ids, at = memory.spell(np.insert(place, bounds[1:], 0))
            return pa.ListArray.from_arrays(pa.array(at[bounds + np.arange(len(bounds))].astype(np.int32)), pa.array(ids))

        for batch in batches:
            # slices of a set size bound the memory whatever the batch holds
            k = batch.schema.get_field_index("text")
            sizes = np.concatenate(([0], np.cumsum(pc.fill_null(pc.binary_length(batch.column(k)), 0).to_numpy(zero_copy_only=False))))
            at = 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(sizes, sizes[at] + SLICE_BYTES)))
                part = batch.slice(at, to - at)
                ids = encode(part.column(k))
                count = np.diff(ids.offsets.to_numpy()).astype(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(i) for i in range(part.num_columns) if i != k] + [pa.array(count), ids], names=[f for f in part.schema.names if f != "text"] + ["n_tokens", "ids"])
                at = to

    return run


def write_token_files(docs: DataFrame, path: str, vocab: str, end_id: int = END_ID, encoding: str = "dictionary", row_group_bytes: int = ROW_GROUP_BYTES, page_bytes: int = PAGE_BYTES, file_bytes: int = FILE_BYTES) -> None:
    """Encode (doc_id, text) and write the files below ``path``.

    Null texts count as empty and have the end id alone; null ids come first; equal ids
    are ordered by a hash of their text; an empty table writes no rows; other columns are
    ignored. A text may hold the string of one of the tokenizer's added tokens, which then
    gets that token's id, as the library does by default. ``encoding``: "dictionary" or "delta".
    """
    narrow = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias("_h"))
    total, rows = narrow.agg(F.sum(F.octet_length("text")), F.count(F.lit(1))).first()
    total = total or 0
    parts = max(1, min(MOST_RANGES, -(-total // file_bytes)), min(docs.sparkSession.sparkContext.defaultParallelism, total >> 20))
    dealt = narrow.repartitionByRange(int(parts), "doc_id", "_h").sortWithinPartitions("doc_id", "_h").drop("_h")
    ids = dealt.mapInArrow(_encoder(vocab, end_id), "doc_id long, n_tokens long, ids array<int>")
    with small_batches(docs.sparkSession):  # long texts wait in small batches, on both sides of the worker
        (
            ids.write.option("parquet.block.size", row_group_bytes)
            .option("parquet.page.size", page_bytes)
            .option("parquet.enable.dictionary", str(encoding == "dictionary").lower())
            .option("parquet.writer.version", "v2")
            .option("maxRecordsPerFile", max(1, 2 * rows * file_bytes // max(total, 1)))
            .parquet(path)
        )


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Rows with ``file`` and ``row`` (places of the file in the order and of the row in it) beside doc_id, n_tokens and ids."""
    name = F.col("_metadata.file_name")
    # the task's number, then the file's among the task's
    place = F.regexp_extract(name, r"part-(\d+)", 1).cast("long") * 1_000_000 + F.regexp_extract(name, r"-c(\d+)", 1).cast("long")
    read = spark.read.schema("doc_id long, n_tokens long, ids array<int>").parquet(path)
    return read.select("doc_id", "n_tokens", "ids", place.alias("file"), F.col("_metadata.row_index").alias("row"))


def _crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids = b.column(b.schema.get_field_index("ids"))
        values, o = ids.values.to_numpy(zero_copy_only=False).astype("<u4"), ids.offsets.to_numpy()
        crc = [zlib.crc32(values[o[i] : o[i + 1]].tobytes()) for i in range(len(ids))]
        keep = [i for i, n in enumerate(b.schema.names) if n != "ids"]
        yield pa.RecordBatch.from_arrays([b.column(i) for i in keep] + [pa.array(np.diff(o).astype(np.int64)), pa.array(np.array(crc, dtype=np.int64))], names=[b.schema.names[i] for i in keep] + ["n_read", "ids_crc32"])


def token_digest(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, ``start``, ``n_tokens``, ``ids_crc32`` of each document, from the files.

    The counts are summed by file first, so the running sum over a file starts from the
    sum of the files before it and no task sees more than a file's rows.
    """
    rows = read_token_files(spark, path)
    files = cut(rows.groupBy("file").agg(F.sum("n_tokens").alias("n")))  # reads the counts alone
    before = files.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")).select("file", "before")
    with small_batches(spark):  # lists of ids wait in small batches; what is kept of them is a few numbers a document
        read = cut(rows.select("file", "row", "doc_id", "n_tokens", "ids").mapInArrow(_crc, "file long, row long, doc_id long, n_tokens long, n_read long, ids_crc32 long"))
    order = Window.partitionBy("file").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    return read.join(before, "file").select("doc_id", (F.col("before") + F.coalesce(F.sum("n_tokens").over(order), F.lit(0))).cast("long").alias("start"), F.col("n_read").alias("n_tokens"), "ids_crc32")


def encode_documents(docs: DataFrame, vocab: str, encoding: str = "dictionary") -> DataFrame:
    """Write the files into the shared folder and return their digest."""
    path = scratch_path(docs.sparkSession, "token-files")
    write_token_files(docs, path, vocab, encoding=encoding)
    return token_digest(docs.sparkSession, path)
