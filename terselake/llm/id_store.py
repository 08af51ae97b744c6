"""Token-ID output: a content-addressed store of id streams.

Documents are encoded with a tokenizers file; an end id closes each. A polynomial rolling hash
over 16 ids cuts each stream into chunks of some hundred ids at places that depend on the ids
alone, so equal passages give equal chunks. A chunk's address is a 16-byte BLAKE2b of its ids; each
distinct chunk is stored once, with the document that comes first. A document's recipe lists its
chunks; its Merkle root covers their addresses, and a shard's manifest root covers its
documents.

Files (Parquet, zstd), rows in ascending order of doc_id, file by file::

    store/           doc_id, row, start, n_tokens, digests, lengths, held, shared, payload, root, shard
    manifest/        shard, first_start, n_docs, n_tokens, root

A file holds one range of (doc_id, row); within it, shards are cut by their tokens, and a document's
``start`` counts from the start of its shard, whose own is in the manifest. ``payload`` holds the ids
of the chunks kept here, as little-endian unsigned numbers of 2 bytes (4 for a vocabulary over
65,536), and ``held`` says which they are. A reader decodes rows that hold all their chunks by
themselves; only chunks that other rows lack are looked up by address. Every read compares the
shards with the manifest first, recomputes the addresses and the roots, and fails on a difference or a
missing chunk.

Scale: ranges are sampled by Spark, over (doc_id, row), so a repeated id is split like any other; rows
stream through a task, whatever its range holds; the driver sees one sum for each range; chunks that
very many documents share are dealt into slices.

Edge cases: null or empty text is the end id alone; a null doc_id sorts first; repeated rows are
documents of their own, in a stable order, whose chunks are stored once; an empty table gives
no rows.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import zlib
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terselake.llm import common
from terselake.llm.word_table import WordTable

END_ID = 1
#: Rolling window, expected, least and greatest length of a chunk in ids.
ROLL, MEAN_BITS, LEAST, GREATEST = 16, 9, 128, 4096
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_TURN = np.uint64(0xD6E8FEB86659FD93)
_WORDS = 200_000
#: Ids cut at once; a longer stream goes alone.
_AT_ONCE = 50_000
#: Latin letters that are stable under NFC, then ASCII punctuation without the apostrophe.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")


def _byte_characters() -> list[str]:
    """The printable character that stands for each byte: itself in Latin-1, or the next one from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


_CHARACTERS = _byte_characters()


def id_width(raw: bytes) -> int:
    """Bytes of an id: 2 if all ids of the tokenizer file fit."""
    made = json.loads(raw)
    top = max([*made["model"]["vocab"].values(), *(t["id"] for t in made.get("added_tokens", []))])
    return 2 if top < 1 << 16 else 4


# The parts of a tokenizer file for which stretches between white space are independent and case is dropped.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}


class Encoder:
    """ids of whole texts, as the tokenizers library gives them with add_special_tokens=False.

    The strings of added tokens in a text become those tokens, as in the library. Where the file's
    splitting pattern removes white space and no match crosses it, the ids of a text are those of its
    space-separated stretches in a row, which a bounded table keeps; texts of any other tokenizer
    file are encoded as a whole.
    """

    def __init__(self, raw: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_buffer(raw)
        self.width = id_width(raw)
        self.dtype, self.code = np.dtype(f"<u{self.width}"), "H" if self.width == 2 else "I"
        made = json.loads(raw)
        pre = (made.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
        byte_level = len(pre) == 2 and pre[1].get("type") == "ByteLevel" and not pre[1].get("add_prefix_space") and not pre[1].get("use_regex")
        # an added token has to lie within a stretch, and outside what the direct way takes for letters and marks
        added = all(re.search(r"[!-/:-@\[-`{-~][A-Za-z]", t["content"]) and not any(c.isspace() for c in t["content"]) and not any(t[k] for k in ("single_word", "lstrip", "rstrip", "normalized")) for t in made.get("added_tokens", []))
        self.direct = made.get("normalizer") == _NORMALIZER and byte_level and pre[0] == _SPLIT and added
        self.model = self.tokenizer.model
        self.word = common.BoundedMemo(self._piece, _WORDS)
        self.table = WordTable(self._stretch, self.dtype)

    def _ids(self, text: str) -> bytes:
        return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _piece(self, piece: str) -> bytes:
        """The ids of letters or of marks, which the splitting pattern keeps as one pre-token."""
        spelled = piece if piece.isascii() else "".join([_CHARACTERS[b] for b in piece.encode()])
        return array(self.code, [t.id for t in self.model.tokenize(spelled)]).tobytes()

    def _stretch(self, data: bytes, first: bool) -> bytes:
        stretch = data.decode("utf-8", "surrogatepass")
        if m := _PLAIN.fullmatch(stretch):  # letters and marks are pieces of their own, and case is dropped
            return self.word[m[1].lower()] + (self.word[m[2]] if m[2] else b"")
        return self._ids(stretch)

    def encode_all(self, texts: Iterable[str]) -> Iterator[np.ndarray]:
        """The ids of each text, the end id last."""
        end = np.array([END_ID], self.dtype)
        if not self.direct:
            for text in texts:
                yield np.concatenate([np.frombuffer(self._ids(text), self.dtype), end])
            return
        # a line feed is white space like a space to such a tokenizer, so lines split as well
        for ids in self.table.ids(t.replace("\n", " ") for t in texts):
            yield np.concatenate([ids, end])


def encoder(raw: bytes) -> Encoder:
    return common.kept_in_worker(hashlib.sha256(raw).hexdigest(), lambda: Encoder(raw))


_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_rows(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        for k, base in enumerate((_BASE, _BASE_INVERSE)):
            _powers[k] = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, base, np.uint64)]))
    return [p[:n] for p in _powers]


def cuts(ids: np.ndarray, starts: list[int]) -> list[list[int]]:
    """Ends of the chunks of some id streams that lie one after another: where the rolling hash of
    the last ROLL ids of a stream is rare, within bounds. Ends count from the stream's own start."""
    up, down = _power_rows(len(ids))
    total = np.cumsum((ids.astype(np.uint64) + np.uint64(1)) * down)  # of id[k] * base**-k, modulo 2**64
    rolled = total.copy()
    rolled[ROLL:] -= total[:-ROLL]
    rolled *= up
    rare = np.flatnonzero((rolled * _TURN) >> np.uint64(64 - MEAN_BITS) == 0) + 1
    stops = [*starts[1:], len(ids)]
    # an end less than LEAST >= ROLL ids from a stream's start is not used, so no window reaches into the stream before
    first, last = np.searchsorted(rare, np.add(starts, LEAST)).tolist(), np.searchsorted(rare, stops, side="right").tolist()
    places, out = rare.tolist(), []
    for start, stop, a, b in zip(starts, stops, first, last, strict=True):
        n, ends, at = stop - start, [], 0
        for place in places[a:b]:
            end = place - start
            while end - at > GREATEST:
                at += GREATEST
                ends.append(at)
            if end - at >= LEAST:
                ends.append(end)
                at = end
        while n - at > GREATEST:
            at += GREATEST
            ends.append(at)
        if at < n:
            ends.append(n)
        out.append(ends)
    return out


def cut(ids: np.ndarray) -> list[int]:
    return cuts(ids, [0])[0]


def address(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


def merkle(leaves: list[bytes]) -> bytes:
    """Root of a binary hash tree; an odd node moves up as it is."""
    level = [hashlib.sha256(b"\0" + x).digest() for x in leaves] or [hashlib.sha256(b"").digest()]
    while len(level) > 1:
        level = [hashlib.sha256(b"\1" + level[k] + level[k + 1]).digest() if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
    return level[0]


@dataclass(frozen=True)
class Store:
    path: str
    width: int

    @property
    def documents(self) -> str:
        return f"{self.path}/store"

    @property
    def manifest(self) -> str:
        return f"{self.path}/manifest"


_STORED = "doc_id long, row long, start long, n_tokens long, digests array<binary>, lengths array<int>, held array<boolean>, shared array<boolean>, payload binary, root binary, shard long"
_STAGED = "doc_id long, row long, n_tokens long, digests array<binary>, lengths array<int>, ids binary"
_MANIFEST = "shard long, first_start long, n_docs long, n_tokens long, root binary"
#: A shard's number is its range's, shifted by so many bits, and its place in the range.
_RANGE_BITS = 24
#: Rows of a digest beyond which it is hot, at the least; and how many may be at the most.
_HOT_ROWS, _HOT_DIGESTS = 256, 1000
#: Rows and payload bytes given back at once.
_ROWS_AT_ONCE, _BYTES_AT_ONCE = 2000, 16 << 20


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def write(docs: DataFrame, tokenizer_path: str, path: str | None = None, shard_tokens: int = 8_000_000, id_col: str = "doc_id", text_col: str = "text") -> Store:
    """Encode whole texts and write the store; a shard has at most shard_tokens tokens and one document more."""
    spark = docs.sparkSession
    with open(tokenizer_path, "rb") as f:
        raw = f.read()
    store = Store(path or common.shared_dir(spark, "id-store"), id_width(raw))
    sent = spark.sparkContext.broadcast(raw)  # the tokenizer file, whatever the data

    def encode(batch: pa.RecordBatch):
        e = encoder(sent.value)
        n, digests, lengths, streams = [], [], [], []
        held: list[np.ndarray] = []

        def flush():
            sizes = [len(x) for x in held]
            for ids, ends in zip(held, cuts(np.concatenate(held), np.cumsum([0, *sizes[:-1]]).tolist()), strict=True):
                stream, begins = ids.tobytes(), [0, *ends[:-1]]
                n.append(len(ids))
                digests.append([address(stream[a * e.width:b * e.width]) for a, b in zip(begins, ends, strict=True)])
                lengths.append([b - a for a, b in zip(begins, ends, strict=True)])
                streams.append(stream)
            held.clear()

        size = 0
        for ids in e.encode_all(common.texts_of(batch, "text")):
            held.append(ids)
            size += len(ids)
            if size >= _AT_ONCE:
                flush()
                size = 0
        if held:
            flush()
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(digests, pa.list_(pa.binary())), pa.array(lengths, pa.list_(pa.int32())), pa.array(streams, pa.binary())],
            _names(_STAGED),
        )

    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col(text_col).alias("text"))
    staged_path = common.shared_dir(spark, "ids")
    common.map_batches(named, encode, _STAGED).write.option("compression", "zstd").parquet(staged_path)
    staged = spark.read.schema(_STAGED).parquet(staged_path)

    tokens, chunks = staged.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)), F.coalesce(F.sum(F.size("digests")), F.lit(0))).head()
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), tokens // (4 * shard_tokens) + 1)

    places = staged.select("doc_id", "row", F.posexplode("digests").alias("pos", "digest"))
    first = F.min(F.struct(F.col("doc_id").isNotNull().alias("named"), "doc_id", "row", "pos"))
    repeated_path = common.shared_dir(spark, "repeated")
    repeated = common.written(places.groupBy("digest").agg(F.count("*").alias("n"), first.alias("f")).where("n > 1").select("digest", "n", F.col("f.row").alias("own_row"), F.col("f.pos").alias("own_pos")), repeated_path)
    marks = common.spread_join(places, repeated, "digest", "n", max(_HOT_ROWS, chunks // _HOT_DIGESTS), F.xxhash64("row", "pos"))
    marks_path = common.shared_dir(spark, "marks")
    marks = common.written(marks.select("doc_id", "row", F.lit(0).alias("kind"), "pos", ((F.col("row") == F.col("own_row")) & (F.col("pos") == F.col("own_pos"))).alias("owned")), marks_path)
    # a document's marks come just before it in its range
    mixed = staged.withColumn("kind", F.lit(1)).unionByName(marks, allowMissingColumns=True)
    ordered = mixed.repartitionByRange(ranges, "doc_id", "row").sortWithinPartitions("doc_id", "row", "kind")
    ordered = ordered.select("kind", "pos", "owned", *_names(_STAGED))
    width, names = store.width, _names(_STORED)

    def lay_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.forget()  # the encoder's tables
        shard, start = TaskContext.get().partitionId() << _RANGE_BITS, 0
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.list_(pa.bool_()), pa.list_(pa.bool_()), pa.binary(), pa.binary(), pa.int64()]
        out: list[list] = [[] for _ in names]
        size, marked = 0, {}

        def batch_of() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names)
            for c in out:
                c.clear()
            return made

        for batch in batches:
            kinds, pos, owned, docs_, rows_, counts = (batch.column(k).to_pylist() for k in range(6))
            for k, kind in enumerate(kinds):
                if not kind:
                    marked[pos[k]] = owned[k]
                    continue
                digests, lengths, stream = (batch.column(c)[k].as_py() for c in (6, 7, 8))
                held, kept, at = [marked.get(j, True) for j in range(len(digests))], [], 0
                for here, n in zip(held, lengths, strict=True):
                    if here:
                        kept.append(stream[at:at + n * width])
                    at += n * width
                if start >= shard_tokens:
                    shard, start = shard + 1, 0
                payload = b"".join(kept)
                for column, value in zip(out, (docs_[k], rows_[k], start, counts[k], digests, lengths, held, [j in marked for j in range(len(digests))], payload, merkle(digests), shard), strict=True):
                    column.append(value)
                start += counts[k]
                size += len(payload)
                marked = {}
                if len(out[0]) >= _ROWS_AT_ONCE or size >= _BYTES_AT_ONCE:
                    yield batch_of()
                    size = 0
        if out[0]:
            yield batch_of()

    common.map_arrow(ordered, lay_out, _STORED).write.option("compression", "zstd").parquet(store.documents)
    sealed = _sealed(spark, store)
    sealed.write.parquet(store.manifest)
    for gone in (staged_path, repeated_path, marks_path):
        common.remove_path(spark, gone)
    return store


def _seal(t: pa.Table) -> pa.Table:
    """Counts and root of a shard; root is empty if its documents don't follow one another."""
    t = t.sort_by([("start", "ascending")])
    start, n = t.column("start").to_pylist(), t.column("n_tokens").to_pylist()
    whole = start[0] == 0 and all(a + b == c for a, b, c in zip(start, n, start[1:]))
    root = merkle([r.as_py() for r in t.column("root")]) if whole else b""
    return pa.table({"shard": t.column("shard").slice(0, 1), "n_docs": pa.array([len(n)], pa.int64()), "n_tokens": pa.array([sum(n)], pa.int64()), "root": pa.array([root], pa.binary())})


def _sealed(spark: SparkSession, store: Store) -> DataFrame:
    """The manifest as the files have it; raises if the ranges don't ascend."""
    rows = spark.read.schema(_STORED).parquet(store.documents)
    place = F.struct(F.col("doc_id").isNotNull().alias("named"), "doc_id", "row")
    split = F.shiftright("shard", _RANGE_BITS).alias("range")
    bounds = rows.groupBy(split).agg(F.sum("n_tokens").alias("n"), F.min(place).alias("low"), F.max(place).alias("high"))
    bases, at, reached = [], 0, None  # one row for each range
    for r in sorted(bounds.collect(), key=lambda r: r.range):
        low, high = ((x.named, x.doc_id or 0, x.row) for x in (r.low, r.high))
        if reached is not None and low <= reached:
            raise ValueError("the ranges of the store don't ascend")
        bases.append((r.range, at))
        at, reached = at + r.n, high
    shards = rows.select("shard", "start", "n_tokens", "root").groupBy("shard").applyInArrow(_seal, "shard long, n_docs long, n_tokens long, root binary")
    before = F.coalesce(F.sum("n_tokens").over(Window.partitionBy("range").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    based = shards.withColumn("range", split).join(F.broadcast(spark.createDataFrame(bases, "range long, base long")), "range")
    return based.withColumn("first_start", F.col("base") + before).select(*_names(_MANIFEST))


def streams(spark: SparkSession, store: Store) -> DataFrame:
    """``doc_id, row, start, n_tokens, ids`` (payload bytes) of every document, put together from the files and verified."""
    return _read(spark, store, lambda ids: ids, "ids binary", pa.binary())


def checksums(spark: SparkSession, store: Store) -> DataFrame:
    """``doc_id, row, start, n_tokens, ids_crc32`` of every document, read back and verified."""
    width = store.width

    def crc(ids: bytes) -> int:
        return zlib.crc32(np.frombuffer(ids, f"<u{width}").astype("<u4").tobytes())

    return _read(spark, store, crc, "ids_crc32 long", pa.int64())


def _read(spark: SparkSession, store: Store, result, field: str, kind: pa.DataType) -> DataFrame:
    if not verify_manifest(spark, store):
        raise ValueError("the store differs from its manifest")
    rows, width, name = spark.read.schema(_STORED).parquet(store.documents), store.width, field.split()[0]
    schema = f"doc_id long, row long, shard long, start long, n_tokens long, {field}"

    def rebuild(digests: list[bytes], lengths: list[int], held: list[bool], payload: bytes, fetched: dict[int, bytes], root: bytes) -> bytes:
        parts, at = [], 0
        for k, (digest, size) in enumerate(zip(digests, lengths, strict=True)):
            if held[k]:
                part = payload[at:at + size * width]
                at += size * width
            elif (part := fetched.get(k)) is None:
                raise ValueError("a borrowed chunk is missing from the store")
            if address(part) != digest:
                raise ValueError("a stored chunk differs from its address")
            parts.append(part)
        if merkle(digests) != root:
            raise ValueError("a recipe differs from its root")
        return b"".join(parts)

    def decode(batch: pa.RecordBatch):
        get = {c: batch.column(k) for k, c in enumerate(batch.schema.names)}
        fetched = get["fetched"].to_pylist() if "fetched" in get else [None] * batch.num_rows
        out = [
            result(rebuild(d.as_py(), n.as_py(), h.as_py(), p.as_py(), {x["pos"]: x["part"] for x in f or ()}, r.as_py()))
            for d, n, h, p, f, r in zip(get["digests"], get["lengths"], get["held"], get["payload"], fetched, get["root"], strict=True)
        ]
        yield pa.RecordBatch.from_arrays([get["doc_id"], get["row"], get["shard"], get["start"], get["n_tokens"], pa.array(out, kind)], _names(schema))

    def give(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        out: tuple[list, list] = ([], [])
        for digests, lengths, held, shared, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            at = 0
            for digest, size, here, wanted in zip(digests, lengths, held, shared, strict=True):
                if here:
                    if wanted:
                        out[0].append(digest)
                        out[1].append(payload[at:at + size * width])
                    at += size * width
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.binary())], ["digest", "part"])

    lacks = F.exists("held", lambda h: ~h)
    own = common.map_batches(rows.where(~lacks).drop("shared"), decode, schema)
    wanted = rows.where(lacks).select("row", F.posexplode(F.arrays_zip("digests", "held")).alias("pos", "x")).where("not x.held").select("row", "pos", F.col("x.digests").alias("digest"))
    givers = rows.where(F.exists(F.zip_with("held", "shared", lambda h, s: h & s), lambda x: x)).select("digests", "lengths", "held", "shared", "payload")
    counts = wanted.groupBy("digest").agg(F.count("*").alias("n"))
    given = common.map_batches(givers, give, "digest binary, part binary").join(counts, "digest")
    n = rows.agg(F.coalesce(F.sum(F.size("digests")), F.lit(0))).head()[0]
    parts = common.spread_join(wanted, given, "digest", "n", max(_HOT_ROWS, n // _HOT_DIGESTS), F.xxhash64("row", "pos")).groupBy("row").agg(F.collect_list(F.struct("pos", "part")).alias("fetched"))
    lent = common.map_batches(rows.where(lacks).drop("shared").join(parts, "row", "left"), decode, schema)
    starts = spark.read.schema(_MANIFEST).parquet(store.manifest).select("shard", "first_start")
    every = own.unionByName(lent).join(starts, "shard")
    return every.select("doc_id", "row", (F.col("first_start") + F.col("start")).alias("start"), "n_tokens", name)


def verify_manifest(spark: SparkSession, store: Store) -> bool:
    """Whether every shard's place, counts and root follow from its documents, and no shard is missing or added."""
    try:
        found = _sealed(spark, store)
    except ValueError:
        return False
    manifest = spark.read.schema(_MANIFEST).parquet(store.manifest)
    return found.unionAll(manifest).groupBy(*_names(_MANIFEST)).agg(F.count("*").alias("k")).where("k <> 2").limit(1).count() == 0
