"""Vector work: source texts, encoding, nearest neighbours and context tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from registra.functions.numeric import round_dec
from registra.functions.text import is_blank, prefix
from registra.functions.vectors import unit
from registra.operators.paging import top_k_per_group
from registra.session import remove, shared_dir
from registra.sources.tables import KEY, discard, written

# ---- fixed values -------------------------------------------------------------------------
TEXT_CUT = 2_000
DIMENSIONS = 384
BATCH = 64
LISTS = 100
SOURCES = 5
# ---- end of fixed values ------------------------------------------------------------------

# Questions whose vectors travel with every task; more are read by the tasks, so many at a time.
MAX_SENT_QUESTIONS = 2_000
# Numbers of the vectors that a task holds while it goes through all questions.
HELD_NUMBERS = 1 << 23
# Files that the rows of one cell are written to.
FILES_PER_CELL = 4
# Similarities worked out at a time in one task, with what says whether they are allowed.
MAX_PRODUCTS = 1_000_000
# Similarities that agree to this many digits are ties and are ordered by key.
TIE_DIGITS = 9

Encoder = Callable[[list[str]], np.ndarray]


def source_texts(df: DataFrame, cut: int | None = None) -> DataFrame:
    """Key and text to encode: groundwork, else annotation; blank keys and texts are left out.

    ``cut`` keeps that many characters of each text (``TEXT_CUT`` for encoders that read no more).
    """
    texts = [F.col(c) for c in ("scientific_groundwork", "annotation") if c in df.columns]
    text = F.coalesce(*texts) if texts else F.lit(None).cast("string")
    rows = df.select(F.col(KEY), text.alias("source_text"))
    usable = ~is_blank(F.col(KEY)) & ~is_blank(F.col("source_text"))
    text = F.col("source_text") if cut is None else prefix(F.col("source_text"), cut)
    return rows.where(usable).select(KEY, text.alias("source_text"))


def hashing_encoder(dim: int = DIMENSIONS) -> Encoder:
    """Deterministic stand-in for a language model: hashed character trigrams, length one."""

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim))
        for row, text in enumerate(texts):
            codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le"), dtype=np.uint32)
            codes = codes.astype(np.uint64)
            grams = (codes[:-2] * 1_000_003 + codes[1:-1]) * 1_000_003 + codes[2:]
            grams ^= grams >> 29
            grams = grams * np.uint64(0xBF58476D1CE4E5B9)
            grams ^= grams >> 32
            sign = np.where(grams & 1, 1.0, -1.0)
            out[row] = np.bincount((grams >> 1) % dim, weights=sign, minlength=dim)
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norms > 0, norms, 1.0)

    return encode


def embed_texts(
    texts: DataFrame,
    make_encoder: Callable[[], Encoder],
    text_column: str = "source_text",
    batch: int = BATCH,
) -> DataFrame:
    """Add ``embedding``. The encoder is made once per task and called with ``batch`` texts."""
    schema = T.StructType(
        [*texts.schema.fields, T.StructField("embedding", T.ArrayType(T.FloatType()))]
    )

    def encode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = None
        for frame in frames:
            if encoder is None and len(frame):  # no model for tasks without texts
                encoder = make_encoder()
            for start in range(0, len(frame), batch):
                part = frame.iloc[start : start + batch]
                vectors = encoder(part[text_column].tolist()).astype(np.float32)
                yield part.assign(embedding=list(vectors))

    return texts.mapInPandas(encode, schema)


# ---- nearest neighbours -------------------------------------------------------------------

_HITS = "question_id string, {key} string, score double"


def _unit_rows(m: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; a row without length becomes NaN."""
    norms = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norms > 0, norms, np.nan)


def _matrix(column: pd.Series) -> np.ndarray:
    vectors = [np.asarray(v, dtype=np.float64) for v in column]
    if len({len(v) for v in vectors}) > 1:
        raise ValueError("question vectors differ in length")
    return _unit_rows(np.stack(vectors))


def _arrow_matrix(column: pa.ListArray, dim: int) -> np.ndarray:
    """Unit vectors straight from the flat values of an Arrow list column."""
    lengths = np.diff(column.offsets.to_numpy())
    if (lengths != dim).any():
        raise ValueError(f"a stored vector has {lengths[lengths != dim][0]} numbers, a question {dim}")
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return _unit_rows(flat.reshape(len(column), dim))


def _with_vector(questions: DataFrame, *more: str) -> DataFrame:
    return questions.where(F.col("embedding").isNotNull()).select(F.col("question_id").cast("string"), "embedding", *more)


def _sent(questions: DataFrame, *more: str) -> pd.DataFrame | None:
    """The questions that have a vector, each id once. None: more than travel with the tasks."""
    sent = _with_vector(questions, *more).limit(MAX_SENT_QUESTIONS + 1).toPandas()
    if len(sent) > MAX_SENT_QUESTIONS:
        return None
    if sent["question_id"].isna().any() or not sent["question_id"].is_unique:
        raise ValueError("every question needs an id of its own")
    return sent


@dataclass(frozen=True)
class _Asked:
    """Questions in blocks: a frame that travels with the tasks, or numbered folders that tasks read.

    A folder is opened by ``pyarrow.fs``, so the shared folder must be in a store that knows.
    """

    sent: pd.DataFrame | None = None
    folder: str | None = None
    blocks: int = 1

    @staticmethod
    def of(questions: DataFrame, *more: str) -> _Asked:
        """The questions with an id of their own and a vector, and the columns ``more``."""
        sent = _sent(questions, *more)
        return _Asked(sent) if sent is not None else _Asked(None, *_written_blocks(questions, *more))

    def empty(self) -> bool:
        return self.sent is not None and self.sent.empty

    def each(self) -> Iterator[pd.DataFrame]:
        for i in range(self.blocks):
            if self.sent is not None:
                yield self.sent
            else:
                where, root = fs.FileSystem.from_uri(self.folder) if ":" in self.folder else (fs.LocalFileSystem(), self.folder)
                yield pq.read_table(f"{root}/block={i}", filesystem=where, partitioning=None).to_pandas()

    def settled(self, hits: DataFrame) -> DataFrame:
        """The hits; where they read question folders they are written and those deleted."""
        if self.folder is None:
            return hits
        hits = written(hits, "hits")
        remove(hits.sparkSession, self.folder)
        return hits


def _written_blocks(questions: DataFrame, *more: str) -> tuple[str, int]:
    """Folder and number of blocks of ``MAX_SENT_QUESTIONS`` questions.

    The questions are written with their partition and place in it. The sizes of the partitions before
    make that a number without gaps, which cuts the blocks whatever the ids are.
    """
    spark = questions.sparkSession
    at = F.monotonically_increasing_id()
    placed = written(
        _with_vector(questions, *more).withColumns(
            {"part": F.shiftright(at, 33), "place": at.bitwiseAND(F.lit((1 << 33) - 1))}),
        "placed-questions",
    )
    again = placed.groupBy("question_id").count().where("question_id IS NULL OR count > 1")
    if not again.isEmpty():
        raise ValueError("every question needs an id of its own")
    sizes = placed.groupBy("part").count().orderBy("part").collect()  # as many as partitions
    ends = np.cumsum([r["count"] for r in sizes]).tolist()
    starts = spark.createDataFrame(
        [(r["part"], end - r["count"]) for r, end in zip(sizes, ends)], "part bigint, before bigint")
    block = F.floor((F.col("before") + F.col("place")) / MAX_SENT_QUESTIONS).cast("bigint").alias("block")
    numbered = placed.join(F.broadcast(starts), "part").select("question_id", "embedding", *more, block)
    folder, blocks = shared_dir(spark, "question-blocks"), -(-ends[-1] // MAX_SENT_QUESTIONS)
    numbered.repartition("block").write.partitionBy("block").parquet(folder)
    discard(placed)
    return folder, blocks


def _best(q: np.ndarray, keys: np.ndarray, score: np.ndarray, k: int):
    """First ``k`` per question by score, then key. A missing score comes last."""
    order = np.lexsort((keys, -score, q))
    q, keys, score = q[order], keys[order], score[order]
    starts = np.r_[0, np.flatnonzero(q[1:] != q[:-1]) + 1] if len(q) else np.array([], int)
    place = np.arange(len(q)) - np.repeat(starts, np.diff(np.r_[starts, len(q)]))
    return q[place < k], keys[place < k], score[place < k]


class _TopK:
    """Running best ``k`` records per question; holds ``k`` rows per question, no more."""

    def __init__(self, questions: np.ndarray, k: int):
        self.questions, self.k = questions, k
        self.q = np.array([], dtype=np.int64)
        self.keys = np.array([], dtype=object)
        self.score = np.array([], dtype=np.float64)

    def add(self, keys: np.ndarray, vectors: np.ndarray, cells: np.ndarray | None = None, allowed: np.ndarray | None = None):
        """``allowed`` has a row for each question and a column for each cell."""
        step = max(self.k + 1, MAX_PRODUCTS // max(1, len(self.questions)))
        for i in range(0, len(keys), step):
            part = slice(i, i + step)
            self._add(keys[part], vectors[part], None if allowed is None else allowed[:, cells[part]].T)

    def _add(self, keys: np.ndarray, vectors: np.ndarray, allowed: np.ndarray | None):
        sims = np.round(vectors @ self.questions.T, TIE_DIGITS) + 0.0
        sims = np.where(np.isnan(sims), -np.inf, sims)
        floor = np.full(sims.shape[1], -np.inf)
        ranked = sims if allowed is None else np.where(allowed, sims, -np.inf)
        if len(sims) > self.k:
            floor = np.partition(ranked, len(sims) - self.k, axis=0)[len(sims) - self.k]
        keep = ranked >= floor
        if allowed is not None:
            keep &= allowed
        rows, q = np.nonzero(keep)
        self.q, self.keys, self.score = _best(
            np.r_[self.q, q], np.r_[self.keys, keys[rows]], np.r_[self.score, sims[rows, q]], self.k
        )

    def frame(self, ids: np.ndarray, key: str) -> pd.DataFrame:
        score = np.where(np.isneginf(self.score), np.nan, self.score)
        return pd.DataFrame({"question_id": ids[self.q], key: self.keys, "score": score})

    def batch(self, ids: np.ndarray, key: str) -> pa.RecordBatch:
        frame = self.frame(ids, key)
        types = pa.schema([("question_id", pa.string()), (key, pa.string()), ("score", pa.float64())])
        return pa.RecordBatch.from_pandas(frame, schema=types, preserve_index=False)


def _keys(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def _first_hits(hits: DataFrame, k: int, key: str) -> DataFrame:
    score = F.when(~F.isnan("score"), F.col("score"))
    hits = hits.withColumn("score", score)
    return top_k_per_group(hits, ["question_id"], [F.desc_nulls_last("score"), F.asc(key)], k)


def _records(store: DataFrame, key: str) -> DataFrame:
    return store.where(F.col("embedding").isNotNull()).select(
        F.col(key).cast("string").alias(key), "embedding"
    )


def _held(batches: Iterator[pa.RecordBatch], dim: int, key: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray | None]]:
    """Keys, unit vectors and cells (if there are any) of as many records as a task holds."""
    parts, numbers = [], 0

    def joined():
        return tuple(None if p[0] is None else np.concatenate(p) for p in zip(*parts))

    for b in batches:
        if not len(b):
            continue
        cells = b.column("cell").to_numpy() if "cell" in b.schema.names else None
        parts.append((_keys(b.column(key)), _arrow_matrix(b.column("embedding"), dim), cells))
        numbers += len(b) * dim
        if numbers >= HELD_NUMBERS:
            yield joined()
            parts, numbers = [], 0
    if parts:
        yield joined()


def _scan(
    records: DataFrame, asked: _Asked, k: int, key: str,
    allowed: Callable[[pd.DataFrame, np.ndarray], np.ndarray] | None = None,
) -> DataFrame:
    """One pass over the records for all questions.

    A task goes through the blocks of questions for the vectors it holds and gives out the best ``k``
    of each question; Spark ranks them, spilling where needed. ``allowed`` says which cells a
    question may take records from.
    """
    if asked.empty():
        return records.sparkSession.createDataFrame([], _HITS.format(key=key) + ", rank int")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(asked.each())
        dim = len(first["embedding"].iloc[0])
        for keys, vectors, cells in _held(batches, dim, key):
            for block in asked.each():
                matrix = _matrix(block["embedding"])
                best = _TopK(matrix, k)
                best.add(keys, vectors, cells, None if allowed is None else allowed(block, matrix))
                yield best.batch(block["question_id"].to_numpy(dtype=object), key)

    return _first_hits(records.mapInArrow(scan, _HITS.format(key=key)), k, key)


def nearest(store: DataFrame, questions: DataFrame, k: int = 10, key: str = KEY) -> DataFrame:
    """Exact nearest records: ``question_id, key, score, rank``.

    ``questions`` holds ``question_id`` and ``embedding``, at most ``MAX_SENT_QUESTIONS`` rows (any
    number: :func:`nearest_to_all`); one without a vector finds nothing. Every task multiplies its
    batches with the question matrix and keeps the best ``k`` per question, so only those reach the
    shuffle. All vectors must have the length of the questions'.
    """
    sent = _sent(questions)
    if sent is None:
        raise ValueError(f"at most {MAX_SENT_QUESTIONS} questions travel with the tasks; see nearest_to_all")
    return _scan(_records(store, key), _Asked(sent), k, key)


def nearest_to_all(store: DataFrame, questions: DataFrame, k: int = 10, key: str = KEY) -> DataFrame:
    """The result of :func:`nearest` for any number of questions, by one scan of the store.

    More than ``MAX_SENT_QUESTIONS`` are written in blocks to the shared folder, where the tasks read
    them, and answered at once.
    """
    asked = _Asked.of(questions)
    return asked.settled(_scan(_records(store, key), asked, k, key))


def with_records(store: DataFrame, projects: DataFrame) -> DataFrame:
    """Store rows whose project exists. Rows without a key have none."""
    return store.where(F.col(KEY).isNotNull()).join(projects.select(KEY), KEY, "left_semi")


SEARCH_VIEW = (
    "name", "annotation", "year", "executor_name", "nioktr_types", "budget_total_thousands",
    "keyword_list",
)
CONTEXT_VIEW = ("name", "year", "executor_name")


def semantic_search(
    store: DataFrame,
    projects: DataFrame,
    questions: DataFrame,
    k: int = 10,
    columns: tuple[str, ...] = SEARCH_VIEW,
) -> DataFrame:
    """The ``k`` closest projects per question with attributes and similarity.

    Keys are ranked first, so attributes are fetched for ``k`` rows per question only. The ranked
    keys are written: the store is scanned once whatever is built on them, and the planner knows how
    few they are, so it sends them to the projects and the store instead of shuffling those.
    """
    if not 1 <= k <= 50:
        raise ValueError("k must be 1 to 50")
    hits = written(nearest_to_all(with_records(store, projects), questions, k), "hits")
    names = {"executor_name": "institution"}
    attributes = projects.select(
        KEY, *[F.col(c).alias(names.get(c, c)) for c in columns]
    )
    place = ["question_id", "rank", KEY]
    texts = hits.select(*place).join(store.select(KEY, "source_text"), KEY)
    return (
        hits.join(attributes, KEY)
        .join(texts, place)
        .withColumn("similarity", round_dec(F.col("score"), 3))
        .drop("score")
    )


def retrieve_context(
    store: DataFrame, projects: DataFrame, questions: DataFrame, k: int = SOURCES
) -> DataFrame:
    """Sources for a table of questions."""
    return semantic_search(store, projects, questions, k, CONTEXT_VIEW)


def unanswered(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """Questions without any source."""
    return questions.select(F.col("question_id").cast("string")).join(
        hits.select("question_id").distinct(), "question_id", "left_anti"
    )


# ---- approximate search -------------------------------------------------------------------


@dataclass(frozen=True)
class IvfIndex:
    """Records with the ``cell`` they fall in, the centre of every cell, and its radius.

    The radius is the distance of the cell's farthest unit vector from the centre, so no record of a
    cell is nearer to a question than the centre's distance less the radius.
    """

    records: DataFrame
    centres: np.ndarray
    radii: np.ndarray

    def save(self, path: str) -> IvfIndex:
        """Write the records by cell, so that a search reads the probed cells only.

        The rows of a cell go to a few tasks, which write one file each.
        """
        salt = F.pmod(F.xxhash64(KEY), F.lit(FILES_PER_CELL))
        dealt = self.records.repartition("cell", salt)
        dealt.write.mode("overwrite").partitionBy("cell").parquet(path)
        spark = self.records.sparkSession
        return IvfIndex(spark.read.parquet(path), self.centres, self.radii)

    def probed(self, matrix: np.ndarray, probes: int) -> np.ndarray:
        """Which cells (columns) are among the ``probes`` closest to each question (row)."""
        closest = np.argsort(-np.nan_to_num(matrix @ self.centres.T), axis=1, kind="stable")
        probed = np.zeros((len(matrix), len(self.centres)), dtype=bool)
        np.put_along_axis(probed, closest[:, : min(probes, len(self.centres))], True, axis=1)
        return probed

    def most_similar(self, matrix: np.ndarray) -> np.ndarray:
        """The similarity that a record of each cell (column) can have at most to each question (row)."""
        squares = (matrix**2).sum(1)[:, None] + (self.centres**2).sum(1)[None] - 2 * matrix @ self.centres.T
        gap = np.maximum(np.sqrt(np.maximum(squares, 0)) - self.radii, 0)
        return np.nan_to_num(1 - gap**2 / 2, nan=1.0)


def build_ivf(store: DataFrame, lists: int = LISTS, seed: int = 42, rounds: int = 20) -> IvfIndex:
    """Cluster the unit vectors into ``lists`` cells."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    points = store.withColumn("_point", array_to_vector(unit(F.col("embedding"))))
    means = KMeans(
        k=lists, seed=seed, maxIter=rounds, featuresCol="_point", predictionCol="cell"
    )
    model = means.fit(points.select("_point"))
    centres = np.array(model.clusterCenters())
    records = model.transform(points).drop("_point")
    return IvfIndex(records, centres, _radii(records, centres))


def _radii(records: DataFrame, centres: np.ndarray) -> np.ndarray:
    def farthest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = np.zeros(len(centres))
        for b in batches:
            cells = b.column("cell").to_numpy()
            if len(cells):
                away = np.linalg.norm(_arrow_matrix(b.column("embedding"), centres.shape[1]) - centres[cells], axis=1)
                np.maximum.at(most, cells, np.nan_to_num(away, nan=2.0))
        yield pa.record_batch([pa.array(np.arange(len(centres))), pa.array(most)], names=["cell", "away"])

    far = records.select("cell", "embedding").mapInArrow(farthest, "cell bigint, away double")
    rows = far.groupBy("cell").agg(F.max("away").alias("away")).collect()  # as many as cells
    radii = np.zeros(len(centres))
    for r in rows:
        radii[r["cell"]] = r["away"]
    return radii


def ivf_search(index: IvfIndex, questions: DataFrame, k: int = 10, probes: int = 10,
               key: str = KEY) -> DataFrame:
    """Nearest records within the ``probes`` cells closest to each question.

    With as many probes as cells the result equals :func:`nearest_to_all`. Questions come in any number.
    """
    asked = _Asked.of(questions)

    def allowed(block: pd.DataFrame, matrix: np.ndarray) -> np.ndarray:
        return probed(matrix, probes)

    probed = _without_records(index).probed
    return asked.settled(_scan(_cells(index, asked, allowed, key), asked, k, key, allowed))


def _without_records(index: IvfIndex) -> IvfIndex:
    """Centres and radii alone, which travel with the tasks."""
    return IvfIndex(None, index.centres, index.radii)


def _cells(index: IvfIndex, asked: _Asked, allowed, key: str) -> DataFrame:
    """The records to scan: those of the wanted cells, where the questions are at hand."""
    records = index.records.select(F.col(key).cast("string").alias(key), "embedding", "cell")
    if asked.sent is None or asked.sent.empty:
        return records
    wanted = allowed(asked.sent, _matrix(asked.sent["embedding"])).any(axis=0)
    return records.where(F.col("cell").isin([int(c) for c in np.flatnonzero(wanted)]))


def bounded_search(index: IvfIndex, questions: DataFrame, k: int = 10, probes: int = 2,
                   key: str = KEY) -> DataFrame:
    """Exact nearest records, reading only cells that can hold one.

    The closest ``probes`` cells give each question a ``k``-th similarity. A cell that was not read
    can improve on it only if its centre's distance less its radius allows; those cells are read as well.
    """
    first = written(ivf_search(index, questions, k, probes, key), "first-hits")
    reached = first.groupBy("question_id").agg(
        F.when(F.count("score") == k, F.min("score")).alias("floor"))
    limits = _with_vector(questions).join(reached, "question_id", "left").withColumn(
        "floor", F.coalesce("floor", F.lit(-2.0)))
    asked, bounds = _Asked.of(limits, "floor"), _without_records(index)

    def allowed(block: pd.DataFrame, matrix: np.ndarray) -> np.ndarray:
        reach = bounds.most_similar(matrix) >= block["floor"].to_numpy()[:, None] - 10.0 ** (1 - TIE_DIGITS)
        return reach & ~bounds.probed(matrix, probes)

    more = asked.settled(_scan(_cells(index, asked, allowed, key), asked, k, key, allowed))
    return _first_hits(first.drop("rank").unionByName(more.drop("rank")), k, key)


def recall(found: DataFrame, exact: DataFrame, key: str = KEY) -> DataFrame:
    """Share of the exact neighbours that were found."""
    hit = found.select("question_id", key).withColumn("_hit", F.lit(1))
    return exact.join(hit, ["question_id", key], "left").agg(
        F.count(F.lit(1)).alias("expected"),
        F.count("_hit").alias("found"),
        round_dec(F.count("_hit") / F.count(F.lit(1)), 4).alias("recall"),
    )


def questions_from(spark: SparkSession, texts: dict[str, str], encoder: Encoder) -> DataFrame:
    """A question table from texts typed by a user."""
    vectors = encoder(list(texts.values())).astype(np.float32)
    rows = [(i, t, v.tolist()) for (i, t), v in zip(texts.items(), vectors)]
    return spark.createDataFrame(rows, "question_id string, question string, embedding array<float>")
