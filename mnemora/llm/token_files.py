"""Token ids as Arrow IPC files of fixed-size lists: equal-length sequences and masks, read without a copy.

Documents are dealt by ranges of doc_id and sorted; the task of a range writes ``part-N.arrow``, where the ids of its
documents, each closed by the end id, follow one another in sequences of ``LENGTH`` ids, ``ROWS`` sequences to a batch, and
``part-N.docs.arrow`` with doc_id, start and n_tokens in that file. The mask is false behind the last id of a file. A file is
written under a name of its own and then renamed, so a repeated task replaces its like. Ids take 16 bits where the
vocabulary allows it.
"""

from __future__ import annotations

import uuid
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .bpe import vocabulary_path
from .chunks import Chunks
from .common import fresh_folder, saved, table

LENGTH = 2048
ROWS = 64
END_ID = 1


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder in any store that Arrow reaches."""
    if "://" in uri:
        return pafs.FileSystem.from_uri(uri)
    return pafs.LocalFileSystem(), uri.removeprefix("file:")


@lru_cache(2)
def loaded(path: str) -> tuple[Chunks, np.dtype]:
    """Encoder of the tokenizers library behind a memory of chunks, once per Python worker."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    kind = np.dtype("<u2" if tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
    return Chunks(lambda texts: [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)], kind.itemsize), kind


class SequenceFile:
    """Writes ids into batches of ROWS sequences; holds less than one batch besides the ids given."""

    def __init__(self, sink, kind: np.dtype):
        self.type = pa.from_numpy_dtype(kind)
        self.kind, self.rest, self.total = kind, np.zeros(0, kind), 0
        schema = pa.schema([("ids", pa.list_(self.type, LENGTH)), ("mask", pa.list_(pa.bool_(), LENGTH))])
        self.writer = pa.ipc.new_file(sink, schema)

    def add(self, ids: np.ndarray) -> None:
        self.total += len(ids)
        self.rest = np.concatenate([self.rest, ids])
        size = ROWS * LENGTH
        full = len(self.rest) // size * size
        for at in range(0, full, size):
            self._batch(self.rest[at : at + size], size)
        self.rest = self.rest[full:].copy()

    def _batch(self, ids: np.ndarray, n: int) -> None:
        columns = [pa.array(ids, self.type), pa.array(np.arange(len(ids)) < n)]
        lists = [pa.FixedSizeListArray.from_arrays(c, LENGTH) for c in columns]
        self.writer.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.writer_schema(lists)))

    @staticmethod
    def writer_schema(lists) -> pa.Schema:
        return pa.schema([("ids", lists[0].type), ("mask", lists[1].type)])

    def close(self) -> None:
        n = len(self.rest)
        if n:
            self._batch(np.concatenate([self.rest, np.zeros(-n % LENGTH, self.kind)]), n)
        self.writer.close()


def _write(folder: str, path: str, end_id: int):
    def run(batches):
        part = TaskContext.get().partitionId()
        chunks, kind = loaded(path)
        store, root = filesystem(folder)
        store.create_dir(root, recursive=True)
        own = f"{root}/.{part:06d}-{uuid.uuid4().hex}"
        names = {f"{own}.arrow": f"{root}/part-{part:06d}.arrow", f"{own}.docs.arrow": f"{root}/part-{part:06d}.docs.arrow"}
        docs = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
        ids_name, docs_name = names
        n_docs = 0
        with store.open_output_stream(ids_name) as ids_sink, store.open_output_stream(docs_name) as docs_sink:
            file, index = SequenceFile(ids_sink, kind), pa.ipc.new_file(docs_sink, docs)
            for batch in batches:
                ids, bounds = chunks.encoded(batch["text"])
                sizes = np.diff(bounds) + 1
                starts = file.total + np.concatenate([[0], np.cumsum(sizes)])[:-1]
                index.write_batch(pa.RecordBatch.from_arrays(
                    [batch["doc_id"].cast(pa.int64()), pa.array(starts, pa.int64()), pa.array(sizes)], schema=docs))
                file.add(np.insert(ids, bounds[1:], end_id))
                n_docs += batch.num_rows
            file.close()
            index.close()
        for name, final in names.items():
            if n_docs:
                store.move(name, final)
            else:
                store.delete_file(name)
        if n_docs:
            yield pa.RecordBatch.from_pydict({"part": [part], "n_docs": [n_docs], "n_tokens": [file.total]})

    return run


def write_tokens(documents: DataFrame, path: str, folder: str, end_id: int = END_ID) -> DataFrame:
    """Write the files of all rows into ``folder``; returns one row per file: part, n_docs, n_tokens.

    Order: doc_id (null first), then text. Null text is empty, so it holds the end id alone. No rows, no files.
    """
    dealt = documents.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return saved(dealt.mapInArrow(_write(folder, path, end_id), "part long, n_docs long, n_tokens long"), "token-files")


class SequenceReader:
    """Sequences of one file by number, and ids by place; a local file is mapped, nothing is copied."""

    def __init__(self, folder: str, part: int):
        store, root = filesystem(folder)
        name = f"{root}/part-{part:06d}.arrow"
        source = pa.memory_map(name) if isinstance(store, pafs.LocalFileSystem) else store.open_input_file(name)
        self.file = pa.ipc.open_file(source)
        self.held = (-1, None)

    def _flat(self, batch: int) -> np.ndarray:
        if self.held[0] != batch:
            self.held = (batch, self.file.get_batch(batch).column("ids").flatten().to_numpy())
        return self.held[1]

    def sequence(self, number: int) -> tuple[np.ndarray, pa.Array]:
        """Ids and mask of one sequence."""
        rows = self.file.get_batch(number // ROWS)
        at = number % ROWS
        return rows.column("ids")[at].values.to_numpy(), rows.column("mask")[at].values

    def ids(self, start: int, n: int):
        """The ids from a place on, as views of at most a batch."""
        size = ROWS * LENGTH
        while n:
            flat = self._flat(start // size)
            take = min(n, size - start % size)
            yield flat[start % size : start % size + take]
            start, n = start + take, n - take


def read_tokens(files: DataFrame, folder: str) -> DataFrame:
    """Per document of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    ``files`` is what ``write_tokens`` returned: one small row per file, whose sizes give each file's first place.
    """
    spark = files.sparkSession
    sizes = sorted((r["part"], r["n_tokens"]) for r in files.collect())
    parts = [p for p, _ in sizes]
    base = np.concatenate([[0], np.cumsum([n for _, n in sizes])]).astype(np.int64)
    held = spark.sparkContext.broadcast((parts, base))

    def run(batches):
        parts, base = held.value
        for batch in batches:
            for number in batch["id"].to_pylist():
                reader = SequenceReader(folder, parts[number])
                store, root = filesystem(folder)
                docs = pa.ipc.open_file(store.open_input_file(f"{root}/part-{parts[number]:06d}.docs.arrow"))
                for i in range(docs.num_record_batches):
                    rows = docs.get_batch(i)
                    crcs = []
                    for start, n in zip(rows["start"].to_pylist(), rows["n_tokens"].to_pylist()):
                        crc = 0
                        for view in reader.ids(start, n):
                            crc = zlib.crc32(view.astype("<u4").tobytes(), crc)
                        crcs.append(crc)
                    starts = rows["start"].to_numpy() + base[number]
                    yield pa.RecordBatch.from_arrays(
                        [rows["doc_id"], pa.array(starts), rows["n_tokens"], pa.array(crcs, pa.int64())],
                        ["doc_id", "start", "n_tokens", "ids_crc32"])

    return spark.range(0, len(parts), 1, max(1, len(parts))).mapInArrow(
        run, "doc_id long, start long, n_tokens long, ids_crc32 long"
    )


def op4(spark, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    folder = fresh_folder(spark, "tokens")
    return read_tokens(write_tokens(documents, vocabulary_path(), folder), folder)
