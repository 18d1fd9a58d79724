"""Token counts of flat token files by a separator scan.

A flat file holds token identifiers one after another, each document closed by an end-of-document
identifier, and nothing else: no index, no lengths. The file is read in blocks by many tasks. Each
block is searched for separators at once and yields the lengths between them; a prefix scan of the
separators per block says which document of the file each piece belongs to, and the pieces of a
document that spans blocks are added up.
"""

from __future__ import annotations

import base64
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from registra.session import shared_dir
from registra.sources.tables import written

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: The identifier after the vocabulary's last; no text is encoded to it.
SEPARATOR = 50256
# Fixed value: how the vocabulary's tokenizer splits text
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space as the pattern knows it, in runs for which its matcher would run out of stack.
_LONG_BLANK = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{1000,}")
FILE_BYTES = 64 << 20
BLOCK_BYTES = 1 << 20
#: Blocks whose separators are added up in one group; groups are then scanned themselves.
GROUP_BLOCKS = 1024


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class Encoder:
    """Identifiers of texts of any length.

    A long run of white space is one part of a text, but for its last character where another follows.
    Such parts are encoded without the pattern, whose matcher fails on a million blanks.
    """

    def __init__(self, ranks: dict[bytes, int]):
        import tiktoken

        self.parts = tiktoken.Encoding("flat", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.part = tiktoken.Encoding("part", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> list[int]:
        ids, start = [], 0
        for run in _LONG_BLANK.finditer(text):
            ids += self.parts.encode_ordinary(text[start: run.start()])
            start = run.end() if run.end() == len(text) else run.end() - 1
            ids += self.part.encode_ordinary(text[run.start(): start])
        return ids + self.parts.encode_ordinary(text[start:])


def write_flat(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, separator: int = SEPARATOR) -> DataFrame:
    """Encode texts into flat files of 16-bit identifiers in the shared folder.

    Returns ``key``, ``file`` and ``ordinal``, the place of the document in its file: what was written
    where, but no lengths. Null and empty texts are written as a bare separator; runs of white space, letters
    or marks may have any length. A task that is run
    again writes files of its own; only the files of the run that counted are listed.
    """
    spark = docs.sparkSession
    folder = shared_dir(spark, "tokens")
    with open(vocabulary, "rb") as f:
        table = spark.sparkContext.broadcast(f.read())  # a fixed file, under 1 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, table.value.splitlines())}
        encoder = Encoder(ranks)
        system, root = _open(folder)
        system.create_dir(root, recursive=True)
        name, out, ordinal, size = "", None, 0, 0
        try:
            for batch in batches:
                files, ordinals = [], []
                for value in batch.column(1):
                    if out is None:
                        name = uuid.uuid4().hex
                        out, ordinal, size = system.open_output_stream(f"{root}/{name}"), 0, 0
                    ids = encoder.encode(value.as_py() or "")
                    ids.append(separator)
                    blob = np.array(ids, np.uint16).tobytes()
                    out.write(blob)
                    files.append(f"{folder}/{name}")
                    ordinals.append(ordinal)
                    ordinal, size = ordinal + 1, size + len(blob)
                    if size >= FILE_BYTES:
                        out.close()
                        out = None
                yield pa.record_batch([batch.column(0), pa.array(files, pa.string()), pa.array(ordinals, pa.int64())], names=["key", "file", "ordinal"])
        finally:
            if out is not None:
                out.close()

    kind = docs.schema[key].dataType.simpleString()
    listed = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, file string, ordinal bigint")
    return written(listed, "token-files").withColumnRenamed("key", key)


def blocks(files: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``file``, ``block``, ``offset`` and ``size`` of all blocks of the files in column ``file``."""

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0).to_pylist()
            found = []
            for name in names:
                system, path = _open(name)
                found.append(system.get_file_info(path).size)
            yield pa.record_batch([pa.array(names, pa.string()), pa.array(found, pa.int64())], names=["file", "bytes"])

    sized = files.select("file").distinct().mapInArrow(sizes, "file string, bytes bigint").where("bytes > 0")
    last = F.floor((F.col("bytes") - 1) / block_bytes).cast("bigint")
    return sized.select("file", "bytes", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("block")).select(
        "file", "block", (F.col("block") * block_bytes).alias("offset"), F.least(F.lit(block_bytes), F.col("bytes") - F.col("block") * block_bytes).alias("size")
    )


def scan_block(ids: np.ndarray, separator: int) -> np.ndarray:
    """Tokens before the first separator, between separators, and after the last."""
    at = np.flatnonzero(ids == separator)
    return np.diff(np.concatenate([[-1], at, [len(ids)]])) - 1


def count_tokens(files: DataFrame, separator: int = SEPARATOR, width: int = 2, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``file``, ``ordinal``, ``n_tokens`` and ``closed`` of every document in flat files.

    Identifiers are little-endian and ``width`` bytes wide, and ``block_bytes`` is a multiple of that.
    An empty file holds no document. What follows the last separator is one more document, not
    ``closed``, if it has any token.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, counts, pieces = [], [], []
            for name, block, offset, size in zip(*(batch.column(i).to_pylist() for i in range(4))):
                system, path = _open(name)
                with system.open_input_file(path) as f:
                    ids = np.frombuffer(f.read_at(size, offset), f"<u{width}")
                lengths = scan_block(ids, separator)
                names.append((name, block))
                counts.append(len(lengths) - 1)
                pieces.append(lengths)
            yield pa.record_batch(
                [pa.array([n[0] for n in names], pa.string()), pa.array([n[1] for n in names], pa.int64()), pa.array(counts, pa.int64()), pa.array(pieces, pa.list_(pa.int64()))],
                names=["file", "block", "closed", "pieces"],
            )

    dealt = blocks(files, block_bytes).repartition(F.col("file"), F.col("block"))
    scanned = written(dealt.mapInArrow(scan, "file string, block bigint, closed bigint, pieces array<bigint>"), "separators")
    group = F.floor(F.col("block") / GROUP_BLOCKS).cast("bigint").alias("group")
    totals = scanned.groupBy("file", group).agg(F.sum("closed").alias("n"))
    ahead = Window.partitionBy("file").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(F.col("file").alias("f"), F.col("group").alias("g"), F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base"))
    ahead = Window.partitionBy("file", "group").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    inner = scanned.withColumn("group", group).withColumn("inside", F.coalesce(F.sum("closed").over(ahead), F.lit(0)))
    pieces = (
        inner.join(totals, (F.col("file") == F.col("f")) & (F.col("group") == F.col("g")))
        .select("file", (F.col("base") + F.col("inside")).alias("first"), "closed", F.posexplode("pieces").alias("at", "n"))
        .select("file", (F.col("first") + F.col("at")).alias("ordinal"), "n", (F.col("at") < F.col("closed")).alias("ends"))
    )
    return (
        pieces.groupBy("file", "ordinal").agg(F.sum("n").alias("n_tokens"), F.max("ends").alias("closed"))
        .where("closed or n_tokens > 0")
    )


def token_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``key`` and ``n_tokens`` for each row of ``docs``: written to flat files, then counted by the scan."""
    listed = write_flat(docs, key, text, vocabulary)
    counted = count_tokens(listed).select(F.col("file").alias("f"), F.col("ordinal").alias("o"), "n_tokens")
    return listed.join(counted, (F.col("file") == F.col("f")) & (F.col("ordinal") == F.col("o"))).select(key, "n_tokens")


