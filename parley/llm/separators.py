"""Token counts of documents in flat token files that have no index.

A file is a row of 16-bit token ids in which an end-of-document id follows each document. Files are read in blocks by byte
range, each block by any task; a block gives the places of its separators. A running maximum of the last separator and a
running count over the blocks of a file (a prefix scan) then tell where each block's first document began and which number
it has, so a document may lie across any number of blocks.

Tokens behind a file's last separator make a last document that is not complete. Two separators in a row: a document of no
tokens. An empty file: no document. A file with an odd number of bytes: an error. Null text in `write`: no tokens. The
string of the end-of-document token in a text is ordinary text there, since its id must end documents alone. A very long
text is one row of ids over as many blocks as it takes. Repeated rows are written and counted each. An empty table writes
no file and gives no row. Only doc_id and text are read, so that other columns' names can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

END = 50256
#: Tokens in a block, and bytes after which a writer begins another file.
BLOCK_TOKENS, FILE_BYTES = 1 << 19, 256 << 20


def write(docs: DataFrame, folder: str, ranks_path: str, pattern: str, end: int = END) -> DataFrame:
    """Writes all texts' ids to token files in the folder, one run of files for each task.

    Gives doc_id, file, number (the document's place among the file's documents), bytes (of the file; on its last row).
    Write the result down before it is used twice: another evaluation writes other files.
    """
    from parley.llm.bytepairs import text_ids
    from parley.llm.shared import slices

    def run(batches: Iterator[pa.RecordBatch]):
        fs, path = pyarrow.fs.FileSystem.from_uri(folder)
        fs.create_dir(path, recursive=True)
        task, mine = TaskContext.get(), text_ids(ranks_path, pattern)
        file, out, at, number = "", None, 0, 0
        for batch in slices(batches):
            if out is None or at >= FILE_BYTES:
                if out is not None:
                    out.close()
                    yield row([None], [file], [None], [at])
                file, at, number = f"tokens-{task.partitionId():06d}-{task.taskAttemptId()}-{number}.bin", 0, 0
                out = fs.open_output_stream(f"{path}/{file}")
            ids, border = mine([t or "" for t in batch.column("text").to_pylist()])
            data = np.insert(ids, border[1:], end).astype("<u2").tobytes()
            out.write(data)
            n = batch.num_rows
            yield row(batch.column("doc_id"), [file] * n, np.arange(number, number + n), [None] * n)
            at, number = at + len(data), number + n
        if out is not None:
            out.close()
            yield row([None], [file], [None], [at])

    def row(ids, file, number, size) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(file, pa.string()), pa.array(number, pa.int64()), pa.array(size, pa.int64())], names=["doc_id", "file", "number", "bytes"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, file string, number long, bytes long")


def scan(files: DataFrame, folder: str, end: int = END, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """file, number, token_start, n_tokens, complete of every document in the files (file, bytes) of the folder."""

    def run(batches):
        fs, path = pyarrow.fs.FileSystem.from_uri(folder)
        for batch in batches:
            for file, block, size in zip(*(batch.column(c).to_pylist() for c in ("file", "block", "bytes")), strict=True):
                if size % 2:
                    raise ValueError(f"{file}: not a row of 16-bit ids")
                start = block * block_tokens
                with fs.open_input_file(f"{path}/{file}") as f:
                    ids = np.frombuffer(f.read_at(min(block_tokens, size // 2 - start) * 2, start * 2), "<u2")
                ends = np.flatnonzero(ids == end) + start
                columns = [pa.array([file]), pa.array([block], pa.int64()), pa.array([size // 2], pa.int64()), pa.array([ends.tolist()], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["file", "block", "tokens", "ends"])

    number = F.ceil(F.col("bytes") / (2 * block_tokens))
    blocks = files.where("bytes > 0").select("file", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), number.cast("long") - 1)).alias("block"))
    blocks = blocks.repartition("file", "block").mapInArrow(run, "file string, block long, tokens long, ends array<long>")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    told = blocks.withColumns(
        {
            "open": F.coalesce(F.max(F.try_element_at("ends", F.lit(-1))).over(before), F.lit(-1).cast("long")),
            "done": F.coalesce(F.sum(F.size("ends")).over(before), F.lit(0).cast("long")),
            "last": F.max("block").over(Window.partitionBy("file")) == F.col("block"),
        }
    )
    # the file's last block closes a document that no separator ends
    tail = F.coalesce(F.try_element_at("ends", F.lit(-1)), F.col("open"))
    ends = F.when(F.col("last") & (tail < F.col("tokens") - 1), F.concat("ends", F.array("tokens"))).otherwise(F.col("ends"))
    told = told.select("file", "open", "done", "tokens", ends.alias("ends")).select("file", "open", "done", "tokens", "ends", F.posexplode("ends").alias("k", "stop"))
    start = F.when(F.col("k") == 0, F.col("open")).otherwise(F.try_element_at("ends", F.col("k"))) + 1
    return told.select("file", (F.col("done") + F.col("k")).alias("number"), start.alias("token_start"), (F.col("stop") - start).alias("n_tokens"), (F.col("stop") < F.col("tokens")).alias("complete"))


def token_counts(docs: DataFrame, ranks_path: str, pattern: str, end: int = END) -> DataFrame:
    """doc_id, n_tokens of every document: its ids are written to token files, which are then scanned for separators."""
    from parley.llm.shared import stored, work_dir

    folder = work_dir(docs.sparkSession, "tokens")
    told = stored(write(docs, folder, ranks_path, pattern, end), "token-files")
    found = scan(told.where("bytes is not null").select("file", "bytes"), folder, end)
    # file names compress so well that the table looks small enough to broadcast, but it has a row for each document
    rows = told.where("number is not null").select("doc_id", "file", "number").hint("merge")
    return rows.join(found, ["file", "number"]).select("doc_id", "n_tokens")
