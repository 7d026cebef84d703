"""Token counts of the documents in flat, unindexed token files, by separator scan.

A flat file is nothing but ids of a fixed width; an end-of-document id closes each document.
Files are cut into blocks of equal size wherever these fall. Each block is searched at once for
separators with numpy. A prefix scan over the blocks of a file, in two levels, tells each block
how many documents have ended before it and where the last of them ended; so a document
that begins in one block and ends in another, however many lie between, is counted whole.

Defined results: an empty document has 0 tokens; ids after a file's last separator are an
unfinished document, reported with `closed` false; an empty file gives no rows; in `written`,
a null or empty text is a separator alone and repeated rows are written again; special tokens that
stand in a text are written as the characters they are, so that none is taken for a separator; an
id that the files' width can't hold is an error.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batch, held, pick, shared_dir, stored, text_slices, utf8
from .packing import WordEncoder

BLOCK_BYTES = 1 << 20
#: Blocks of a file that are scanned together on the first level.
SPAN = 4096


def _open(uri: str):
    import pyarrow.fs

    return pyarrow.fs.FileSystem.from_uri(uri)


def flat(ids: np.ndarray, separator: int, kind: str) -> bytes:
    """The bytes of ids of a fixed width; ids that don't fit, or would end the document, are an error."""
    most = int(ids.max(initial=0))
    if most > np.iinfo(kind).max or (ids == separator).any():
        raise ValueError(f"id {most} doesn't fit {kind}, or the separator {separator} is an id of the text")
    return ids.astype(kind).tobytes()


def written(docs: DataFrame, tokenizer: str, separator: int, folder: str, kind: str = "<u2") -> DataFrame:
    """Writes each partition's documents as a flat file; (file, bytes, ids): which documents it holds, in order.

    A task that is run again writes another file, and only files in the result count.
    """
    schema = pa.schema([("file", pa.string()), ("bytes", pa.int64()), ("ids", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = held(f"literal words of {tokenizer}", lambda: WordEncoder(tokenizer, literal=True))
        context = TaskContext.get()
        name = f"{folder}/tokens-{context.partitionId() if context else 0:06d}-{uuid.uuid4().hex}.bin"
        end, size, ids, out = np.array([separator], kind).tobytes(), 0, [], None
        for b in text_slices(batches, most=4 << 20):
            if out is None:
                fs, path = _open(name)
                out = fs.open_output_stream(path)
            for i, x in zip(b.column(0).to_pylist(), encode(utf8(b.column(1)))):
                data = flat(np.frombuffer(x, "<u4"), separator, kind) + end
                out.write(data)
                size += len(data)
                ids.append(i)
        if out is not None:
            out.close()
            yield batch(schema, [name], [size], [ids])

    return pick(docs, "doc_id", "text").mapInArrow(run, "file string, bytes long, ids array<long>")


def searched(files: DataFrame, separator: int, kind: str = "<u2", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(file, block, first, n, ends): each block's first id's place, its number of ids, and the places of its separators in the file.

    files: (file, bytes).
    """
    width = np.dtype(kind).itemsize
    block_bytes -= block_bytes % width
    schema = pa.schema([("file", pa.string()), ("block", pa.int64()), ("first", pa.int64()), ("n", pa.int64()), ("ends", pa.list_(pa.int64()))])
    ranges = files.where("bytes > 0").select("file", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("bytes") - 1) / block_bytes))).alias("block"))
    spark = files.sparkSession
    ranges = ranges.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1), "file", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held()
        for b in batches:
            for r in b.to_pylist():
                fs, path = _open(r["file"])
                with fs.open_input_file(path) as f:
                    f.seek(r["block"] * block_bytes)
                    ids = np.frombuffer(f.read(min(block_bytes, r["bytes"] - r["block"] * block_bytes)), kind)
                first = r["block"] * (block_bytes // width)
                yield batch(schema, [r["file"]], [r["block"]], [first], [len(ids)], [np.flatnonzero(ids == separator) + first])

    return ranges.mapInArrow(run, "file string, block long, first long, n long, ends array<long>")


def scanned(blocks: DataFrame) -> DataFrame:
    """Each block with `documents` (ended before it in its file) and `last` (the place of the last separator before it, or -1)."""
    blocks = blocks.withColumn("span", F.floor(F.col("block") / SPAN))
    spans = blocks.groupBy("file", "span").agg(F.sum(F.size("ends")).alias("n_ends"), F.max(F.array_max("ends")).alias("latest"))
    before = Window.partitionBy("file").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select("file", "span", F.sum("n_ends").over(before).alias("span_documents"), F.max("latest").over(before).alias("span_last"))
    inside = Window.partitionBy("file", "span").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    out = blocks.withColumn("documents", F.coalesce(F.sum(F.size("ends")).over(inside), F.lit(0))).withColumn("last", F.max(F.array_max("ends")).over(inside))
    out = out.join(spans, ["file", "span"])
    return out.select("file", "block", "first", "n", "ends", (F.col("documents") + F.coalesce("span_documents", F.lit(0))).alias("documents"), F.coalesce("last", "span_last", F.lit(-1)).alias("last"))


def counted(blocks: DataFrame) -> DataFrame:
    """(file, document, start, n_tokens, closed) of every document, from searched blocks, a stored table."""
    blocks = scanned(blocks)
    # each separator ends a document that began after the separator before it, in this block or an earlier one
    starts = F.concat(F.array("last"), F.slice("ends", 1, 2**30))
    ended = blocks.select("file", "documents", F.posexplode(F.zip_with(F.slice(starts, F.lit(1), F.size("ends")), "ends", lambda a, b: F.struct((a + 1).alias("start"), b.alias("end")))).alias("k", "d"))
    ended = ended.select("file", (F.col("documents") + F.col("k")).alias("document"), F.col("d.start").alias("start"), (F.col("d.end") - F.col("d.start")).alias("n_tokens"), F.lit(True).alias("closed"))
    whole = blocks.groupBy("file").agg(F.max(F.col("first") + F.col("n")).alias("size"), F.max(F.greatest("last", F.coalesce(F.array_max("ends"), F.lit(-1)))).alias("latest"), F.max(F.col("documents") + F.size("ends")).alias("document"))
    left = whole.where("latest < size - 1").select("file", "document", (F.col("latest") + 1).alias("start"), (F.col("size") - F.col("latest") - 1).alias("n_tokens"), F.lit(False).alias("closed"))
    return ended.unionByName(left)


def document_counts(docs: DataFrame, tokenizer: str, separator: int, kind: str = "<u2", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_tokens, file_number, start): writes documents as flat files in the shared folder and scans these."""
    folder = f"{shared_dir(docs.sparkSession)}/millrace-flat-{uuid.uuid4().hex}"
    fs, path = _open(folder)
    fs.create_dir(path)
    files = stored(written(docs, tokenizer, separator, folder, kind), "flat-files")
    blocks = stored(searched(files.select("file", "bytes"), separator, kind, block_bytes), "flat-blocks")
    fs.delete_dir(path)
    names = files.select("file", F.posexplode("ids").alias("document", "doc_id"))
    found = counted(blocks).join(names.withColumn("document", F.col("document").cast("long")), ["file", "document"])
    return found.select("doc_id", "n_tokens", F.regexp_extract("file", r"tokens-(\d+)-", 1).cast("long").alias("file_number"), "start")
