"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terselake.sources.shared import materialise, remove_path, scratch, shared_dir, written  # noqa: F401

#: Rows whose crc32(doc_id) falls in this residue are held out of every fit.
HOLDOUT_FOLDS, HOLDOUT_RESIDUE = 5, 0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread_join(left: DataFrame, right: DataFrame, key: str, counted: str, limit: int, salt: Column | None = None) -> DataFrame:
    """Inner join on ``key``; right has one row of each key, with the number of left's rows in ``counted``.

    A key of more than ``limit`` rows is dealt into slices of about that many, and its row of right goes
    to each; the numbers of slices are broadcast, for less than left's rows / limit keys. ``salt``
    deals left's rows; it must not change when a task runs again: a hash of columns that tell rows apart,
    or by default the places of rows, for a left that is read from files.
    """
    slices = F.ceil(F.col(counted) / limit)
    hot = F.broadcast(right.where(F.col(counted) > limit).select(key, slices.alias("_slices")))
    own = F.pmod(F.monotonically_increasing_id() if salt is None else salt, F.coalesce(F.col("_slices"), F.lit(1)))
    dealt = left.join(hot, key, "left").withColumn("_slice", own).drop("_slices")
    return dealt.join(right.withColumn("_slice", F.explode(F.sequence(F.lit(0).cast("long"), slices - 1))), [key, "_slice"]).drop("_slice")


def held_out(doc_id) -> "F.Column":
    """True for the rows kept out of every fit; a null id counts as not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % HOLDOUT_FOLDS == HOLDOUT_RESIDUE, F.lit(False))


#: Rows of a batch. Whole texts travel in batches, on both sides of the JVM border at once.
BATCH_ROWS = 2000
_BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``mapInArrow`` in batches of at most ``BATCH_ROWS``; the session's setting is lowered to that."""
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(_BATCH_CONF)) <= BATCH_ROWS:
        conf.set(_BATCH_CONF, str(BATCH_ROWS))
    return df.mapInArrow(fn, schema)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]], schema) -> DataFrame:
    """``map_arrow`` with a function of one batch; Arrow batches keep the copy across the JVM border cheap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from fn(batch)

    return map_arrow(df, run, schema)


def texts_of(batch: pa.RecordBatch, column: str, field: str | None = None) -> Iterator[str]:
    """The texts of a column, or of a field of a struct column, one at a time (null counts as empty), without a list of all of them."""
    values = batch.column(batch.schema.get_field_index(column))
    for value in values if field is None else values.field(values.type.get_field_index(field)):
        yield value.as_py() or ""


_kept: dict = {}


def kept_in_worker(key, make: Callable):
    """make(), kept for this worker's next batches.

    Workers are used again by later stages; only one value is kept at a time, so that the tables of
    different operators do not add up.
    """
    if key not in _kept:
        forget()
        _kept[key] = make()
    return _kept[key]


def forget() -> None:
    """Drop what this worker keeps, if anything, before work that needs none of it."""
    if _kept:
        _kept.clear()
        give_back()


def give_back() -> None:
    """Hand freed memory back to the system."""
    gc.collect()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library: freed memory stays with the process
        pass


class BoundedMemo(dict):
    """A dict that computes missing values and stays bounded.

    When it holds ``limit`` entries it becomes the older of two generations; entries that are asked
    for again come back from there, the others go with the next change.
    """

    def __init__(self, compute: Callable, limit: int):
        super().__init__()
        self.compute, self.limit, self.older = compute, limit, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.compute(key)
        if len(self) >= self.limit:
            self.older = self.copy()
            self.clear()
        self[key] = value
        return value


def labelled_sample(
    docs: DataFrame, labels: DataFrame, target: str, limit: int, sample_bytes: int, featurise: Callable[[str], bytes], id_col: str = "doc_id", text_col: str = "text"
) -> list[tuple[bytes, int]]:
    """(featurise(text), label) of labelled texts outside the held-out fold, in a fixed order.

    The sample: the ``limit`` labelled ids that are the smallest by a seeded hash; one text for each
    (of texts that share an id, the one of the least hash), passed over where it would bring the sum of
    the texts' bytes over ``sample_bytes``. Both bounds are parameters of the models. Labels may
    repeat (the larger counts); a label other than 0 or 1, or null, is left out.

    Texts become features where they lie: keys are aggregated first, and a task passes over copies
    of a text that it has had, so neither whole texts nor repeated rows meet in one task.
    """
    spark = docs.sparkSession
    picked = (
        labels.select(F.col(id_col).cast("long").alias("sample_id"), F.col(target).cast("int").alias("label"))
        .where(F.col("label").isin(0, 1) & F.col("sample_id").isNotNull() & ~held_out(F.col("sample_id")))
        .groupBy("sample_id").agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("sample_id", F.lit(17)), "sample_id").limit(limit)
    )
    texts = docs.select(F.col(id_col).cast("long").alias("sample_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    digest, size = F.xxhash64("text").alias("digest"), F.octet_length("text").cast("long").alias("size")
    # broadcast: the picked rows number at most `limit`, and so do the rows that reach the driver
    keys = texts.join(F.broadcast(picked), "sample_id").select("sample_id", "label", digest, size).groupBy("sample_id", "label").agg(F.min(F.struct("digest", "size")).alias("k"))
    chosen, held = {}, 0
    for r in sorted(keys.select(F.xxhash64("sample_id", F.lit(17)).alias("place"), "sample_id", "label", "k.digest", "k.size").collect()):
        if held + r.size <= sample_bytes:
            held += r.size
            chosen[r.sample_id] = (len(chosen), r.label, r.digest)
    if not chosen:
        return []
    wanted = spark.createDataFrame([(i, place, digest) for i, (place, _, digest) in chosen.items()], "sample_id long, place int, digest long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        had: set[int] = set()
        for batch in batches:
            places, cells = [], []
            for place, text in zip(batch.column(0).to_pylist(), texts_of(batch, "text"), strict=True):
                if place not in had:
                    had.add(place)
                    places.append(place)
                    cells.append(featurise(text))
            yield pa.RecordBatch.from_arrays([pa.array(places, pa.int32()), pa.array(cells, pa.binary())], ["place", "cell"])

    found = texts.select("sample_id", "text", digest).join(F.broadcast(wanted), ["sample_id", "digest"]).select("place", "text")
    found = map_arrow(found, run, "place int, cell binary")
    cells: list[bytes] = [b""] * len(chosen)
    for place, cell in found.dropDuplicates(["place"]).toLocalIterator():
        cells[place] = bytes(cell)
    return [(cells[place], label) for place, label, _ in chosen.values()]
