"""Raw JSON snapshots: one document per year, either a list of cards or ``{"cards": [...]}``."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from registra.sources.tables import written

ENVELOPE = "cards"


def read_snapshots(
    spark: SparkSession,
    path: str,
    schema: T.StructType | None = None,
    lines: bool = False,
    partitions: int | None = None,
) -> DataFrame:
    """Cards of all snapshot files with ``source_file`` and ``pos``.

    ``(source_file, pos)`` orders cards as they were written: files by name, cards by position.
    A whole-document snapshot is parsed by one task per file; :func:`read_envelopes` reads large ones
    by many tasks, and JSON lines (``lines=True``) are split by Spark. ``partitions`` spreads the cards of a few whole
    documents over more tasks for the steps that follow. Give ``schema`` (the fields of one card) to avoid
    the extra pass that finds it. A folder without snapshots is an error.
    """
    names_only = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(path)
    if names_only.select("path").isEmpty():
        raise FileNotFoundError(f"no JSON files in {path}")
    # a broken document must stop the load, not turn into empty records
    reader = spark.read.option("pathGlobFilter", "*.json").option("mode", "FAILFAST")
    if not lines:
        reader = reader.option("multiLine", True)
    if schema is not None:
        fields = list(schema.fields)
        if not lines:
            fields.append(T.StructField(ENVELOPE, T.ArrayType(schema)))
        reader = reader.schema(T.StructType(fields))
    raw = reader.json(path)

    # A file that Spark splits starts each split at its own offset; ids grow within a split.
    row = F.monotonically_increasing_id()
    raw = raw.select(
        *raw.columns,
        F.col("_metadata.file_name").alias("source_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        row.alias("_row"),
    )
    names = [c for c in raw.columns if c not in (ENVELOPE, "source_file", "_block", "_row")]
    if ENVELOPE not in raw.columns:
        cards = raw.select(
            *names, "source_file", F.struct("_block", "_row", F.lit(0).alias("_in")).alias("pos")
        )
        return cards.repartition(partitions) if partitions else cards

    # One document holds either the envelope or one bare card per row.
    unpacked = raw.select("*", F.posexplode_outer(ENVELOPE).alias("_in", "_card"))
    inner = {f.name for f in raw.schema[ENVELOPE].dataType.elementType.fields}
    fields = [
        F.when(F.col("_card").isNotNull(), F.col("_card").getField(n)).otherwise(F.col(n)).alias(n)
        if n in inner and n in names
        else (F.col("_card").getField(n) if n in inner else F.col(n)).alias(n)
        for n in [*names, *sorted(inner - set(names))]
    ]
    empty_envelope = F.col(ENVELOPE).isNotNull() & F.col("_card").isNull()
    cards = unpacked.where(~empty_envelope).select(
        *fields,
        "source_file",
        F.struct("_block", "_row", F.coalesce("_in", F.lit(0)).alias("_in")).alias("pos"),
    )
    return cards.repartition(partitions) if partitions else cards


#: What stands before the first card of a document that :func:`read_envelopes` reads.
_HEAD = r"^\s*(?:\{[^{\[]*\"" + ENVELOPE + r"\"\s*:\s*)?\[\s*"
_EMPTY = _HEAD + r"\]"


#: What a byte outside strings adds to the depth.
_DEPTH = np.zeros(256, np.int64)
_DEPTH[[ord(c) for c in "{["]], _DEPTH[[ord(c) for c in "}]"]] = 1, -1


def _brackets(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Places of the brackets, the number of quotes before each, and that of all quotes; escaped quotes are none."""
    quotes = np.flatnonzero(data == ord('"'))
    plain = np.flatnonzero(data != ord("\\"))
    if len(plain) < len(data):
        before = np.searchsorted(plain, quotes)
        last = np.where(before > 0, plain[before - 1], -1)
        quotes = quotes[(quotes - 1 - last) % 2 == 0]
    at = np.flatnonzero(_DEPTH[data])
    return at, np.searchsorted(quotes, at), len(quotes)


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, bool]]:
    """The rows of each batch that are of one split, their bytes with the braces, and whether another split begins."""
    last = None
    for b in batches:
        if not len(b):
            continue
        files, splits = b.column("file").dictionary_encode().indices.to_numpy(), b.column("split").to_numpy()
        cuts = np.flatnonzero((np.diff(files) != 0) | (np.diff(splits) != 0)) + 1
        for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(b)]):
            part = b.slice(i, j - i)
            texts = pc.binary_join_element_wise(part.column("text").cast(pa.large_string()), pa.scalar("", pa.large_string()), pa.scalar("}", pa.large_string()))
            place = (part.column("file")[0].as_py(), part.column("split")[0].as_py())
            ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
            yield part, np.frombuffer(texts.buffers()[2], np.uint8)[ends[0] : ends[-1]], place != last
            last = place


def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per split: its quotes, what it adds to the depth, the least depth that a closing bracket leaves (each for a
    start outside and inside a string), its first and last piece."""
    row, names = None, ("file", "split", "quotes", "outside", "inside", "low_outside", "low_inside", "head", "last")

    def told():
        return pa.RecordBatch.from_pylist([dict(zip(names, [*row[:3], *row[3], *row[4], *row[5:]]))], _SURVEY)

    for part, data, fresh in _stretches(batches):
        if fresh:
            if row:
                yield told()
            row = [part.column("file")[0].as_py(), part.column("split")[0].as_py(), 0, [0, 0], [None, None], part.column("text")[0].as_py(), None]
        at, before, quotes = _brackets(data)
        kind = data[at]
        for h in (0, 1):
            out = (before + row[2] + h) % 2 == 0
            depth = row[3][h] + np.cumsum(np.where(out, _DEPTH[kind], 0))
            low = depth[out & (kind == ord("]"))]
            if len(low):
                row[4][h] = int(low.min()) if row[4][h] is None else min(row[4][h], int(low.min()))
            row[3][h] = int(depth[-1])
        row[2] += quotes
        row[6] = part.column("text")[len(part) - 1].as_py()
    if row:
        yield told()


_SURVEY = pa.schema([("file", pa.string()), ("split", pa.int64()), *[(n, pa.int64()) for n in ("quotes", "outside", "inside", "low_outside", "low_inside")],
                     ("head", pa.string()), ("last", pa.string())])
_SEGMENTS = pa.schema([("file", pa.string()), ("source_file", pa.string()), ("split", pa.int64()), ("n", pa.int64()), ("text", pa.string()), ("done", pa.bool_())])


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What lies between the ends of cards, numbered within the split; the last segment of a split may be open."""
    carry, n, over, name = b"", 0, True, None

    def rows(data: bytes, ends: list[int], done: bool) -> pa.RecordBatch:
        offsets = np.array([0, *ends], np.int32)
        k = len(ends)
        texts = pa.StringArray.from_buffers(k, pa.py_buffer(offsets), pa.py_buffer(data))
        columns = [pa.array([v] * k, _SEGMENTS.types[i]) for i, v in enumerate(name)]
        return pa.RecordBatch.from_arrays([*columns, pa.array(np.arange(n, n + k)), texts, pa.array([done] * k)], schema=_SEGMENTS)

    for part, data, fresh in _stretches(batches):
        if fresh:
            if carry and not over:
                yield rows(carry, [len(carry)], False)
            first = part.slice(0, 1).to_pylist()[0]
            name = (first["file"], first["source_file"], first["split"])
            carry, n, over, quotes, depth, base = b"", 0, first["over"], int(first["starts_inside"]), first["depth"], first["base"]
        if over:
            continue
        at, before, more = _brackets(data)
        kind = data[at]
        out = (before + quotes) % 2 == 0
        deep = depth + np.cumsum(np.where(out, _DEPTH[kind], 0))
        left = np.flatnonzero(out & (kind == ord("]")) & (deep < base))
        over = len(left) > 0
        closes = out & (kind == ord("}")) & (deep == base)
        ends = at[closes] if not over else at[closes & (np.arange(len(at)) < left[0])]
        whole, start = carry + data.tobytes(), len(carry)
        if len(ends):
            yield rows(whole, (ends + start + 1).tolist(), True)
            n += len(ends)
        carry = b"" if over else whole[int(ends[-1]) + start + 1:] if len(ends) else whole
        quotes, depth = quotes + more, int(deep[-1])
    if carry and not over:
        yield rows(carry, [len(carry)], False)


def read_envelopes(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Cards of documents ``{"cards": [...]}`` or ``[...]``, each read by many tasks.

    A document is cut at closing braces, which Spark does by byte ranges, and read twice. The first reading
    tells of each split its quotes and brackets, for a start inside and outside a string; summed up over the splits
    of the file they say how each split starts. The second cuts it into cards, which run until the depth of the
    list is reached again. Only cards that cross splits are shuffled. The columns are those of :func:`read_snapshots`; ``schema`` gives the fields of a card.

    In an envelope nothing nested, and no string with a bracket, may stand before the cards; what
    follows them is ignored. Cards are objects. Any other document stops the load, as do unclosed ones.
    """
    pieces = spark.read.option("lineSep", "}").text(path).select(
        F.col("value").alias("text"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_name").alias("source_file"),
        F.col("_metadata.file_block_start").alias("split"),
    )
    survey = pieces.mapInArrow(
        _survey, "file string, split bigint, quotes bigint, outside bigint, inside bigint, low_outside bigint, low_inside bigint, head string, last string")
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    splits = written(survey, "splits")  # a row per split
    splits = splits.withColumn("starts_inside", F.coalesce(F.sum("quotes").over(before) % 2 == 1, F.lit(False)))
    splits = splits.withColumn("change", F.when(F.col("starts_inside"), F.col("inside")).otherwise(F.col("outside")))
    splits = splits.withColumn("depth", F.coalesce(F.sum("change").over(before), F.lit(0).cast("bigint")))
    low = F.col("depth") + F.when(F.col("starts_inside"), F.col("low_inside")).otherwise(F.col("low_outside"))
    splits = splits.withColumn("low", F.min(low).over(before))
    base = F.when(F.col("head").rlike(r"^\s*\["), 1).otherwise(2)
    heads = splits.where((F.col("split") == 0) & F.col("head").rlike(r"\S")).select(
        F.col("file").alias("f"), F.struct(base.alias("base"), F.col("head").rlike(_HEAD).alias("fits"), F.col("head").rlike(_EMPTY).alias("empty")).alias("head"))
    ends = splits.groupBy(F.col("file").alias("e")).agg(
        F.sum("change").alias("rest"), F.sum("quotes").alias("all_quotes"), F.max_by("last", "split").alias("last"))
    # what follows the last brace is a piece too, for which a closing brace was counted
    listed = (F.col("head.base") == 1) & F.col("last").rlike(r"\]\s*$")
    left = F.when(listed | F.col("last").rlike(r"^\s+$"), -1).otherwise(0)
    sound = F.col("head.fits") & (F.col("rest") == left) & (F.col("all_quotes") % 2 == 0)
    heads = heads.join(ends, F.col("f") == F.col("e")).select(
        "f", F.when(sound, F.col("head.base")).otherwise(F.raise_error(F.concat(F.lit("not a list of cards: "), F.col("f"))).cast("int")).alias("base"),
        F.col("head.empty").alias("empty"),
    )
    starts = splits.join(heads, F.col("file") == F.col("f")).where("not empty").select(
        "f", F.col("split").alias("s"), "starts_inside", "depth", "base", F.coalesce(F.col("low") < F.col("base"), F.lit(False)).alias("over"))
    # both readings have the same splits, since the second one is written here
    known = pieces.join(F.broadcast(starts), (F.col("file") == F.col("f")) & (F.col("split") == F.col("s"))).drop("f", "s")
    segments = written(known.mapInArrow(_segments, "file string, source_file string, split bigint, n bigint, text string, done boolean"), "segments")
    counts = segments.groupBy(F.col("file").alias("f"), F.col("split").alias("s")).agg(F.count_if("done").alias("cards"))
    earlier = Window.partitionBy("f").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("f", "s", F.coalesce(F.sum("cards").over(earlier), F.lit(0).cast("bigint")).alias("cards"))
    placed = segments.join(F.broadcast(counts), (F.col("file") == F.col("f")) & (F.col("split") == F.col("s")))
    placed = placed.withColumn("card", F.col("cards") + F.col("n"))
    inner = F.col("done") & ((F.col("n") > 0) | (F.col("split") == 0))
    across = placed.where(~inner).groupBy("file", "source_file", "card").agg(
        F.array_sort(F.collect_list(F.struct("split", "text"))).alias("p"), F.max("done").alias("done")).where("done")  # the segments of one card
    across = across.select("source_file", "card", F.array_join(F.transform("p", lambda x: x["text"]), "").alias("text"))
    whole = placed.where(inner).select("source_file", "card", "text").unionByName(across)
    start = F.when(F.col("card") == 0, F.regexp_replace("text", _HEAD, "")).otherwise(F.regexp_replace("text", r"^[\s,]+", ""))
    cards = whole.select("source_file", "card", F.from_json(start, schema, {"mode": "FAILFAST"}).alias("c"))
    zero = F.lit(0).cast("bigint")
    return cards.select("c.*", "source_file", F.struct(zero.alias("_block"), zero.alias("_row"), F.col("card").alias("_in")).alias("pos"))


def union_snapshots(*frames: DataFrame) -> DataFrame:
    """Stack frames by column name; columns a frame lacks become null."""
    if not frames:
        raise ValueError("no snapshots given")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def with_source(df: DataFrame, name: str = "source_file") -> DataFrame:
    """Tag rows of a file-based frame with the name of their file."""
    return df.select("*", F.col("_metadata.file_name").alias(name))


def flatten_structs(df: DataFrame, sep: str = "_", keep: Sequence[str] = ()) -> DataFrame:
    """Turn struct fields of any depth into columns named ``outer<sep>inner``.

    Columns in ``keep`` stay as they are.
    """

    def leaves(dtype: T.StructType, path: tuple[str, ...]):
        for field in dtype.fields:
            here = (*path, field.name)
            if isinstance(field.dataType, T.StructType) and field.name not in keep:
                yield from leaves(field.dataType, here)
            else:
                yield here

    return df.select(
        *[
            F.col(".".join(f"`{p}`" for p in path)).alias(sep.join(path))
            for path in leaves(df.schema, ())
        ]
    )
