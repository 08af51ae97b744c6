"""Benchmark decontamination: a prefix-filtered set join of documents with benchmark windows.

Words: A-Z lower-cased, maximal runs of bytes that are digits, letters or above 0x7F. A window is
``window`` consecutive words of an item (a shorter, non-empty item is one window). Its tokens are
its shingles of ``SHINGLE`` words (of all its words, if fewer). All of a window must occur, in order
and side by side, so the containment threshold is 1 and the prefix is one token: the rarest of its
shingles, by their counts over all documents. Then:

1. the benchmark's shingles are counted over all documents, in one pass;
2. every window keeps its rarest shingle; one that occurs nowhere rules its window out;
3. in a second pass documents emit the places of prefix shingles, with the words around them;
4. places and windows are joined on the shingle; bounds on position and length discard those whose
   window would reach beyond the text, and the words are compared one by one.

What a pass emits is held down by a bitmap of the wanted shingles' hashes: at most ``MAX_BITS`` bits
are broadcast, whatever the size of the benchmark; a fuller bitmap only lets more rows through to the
join, which is exact. Equal texts are matched once in a task, and shingles, windows and texts that
occur very often are dealt into slices.

Edge cases: a null or empty text has no words and is clean; a null item_id or an item without
words takes no part; repeated items count once; repeated documents get equal rows; an
empty benchmark leaves every document clean; texts of any length are read in pieces.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, StructField, StructType

from terselake.llm import common

SHINGLE = 3
#: Bits of a bitmap: about this many for each value, within bounds.
BITS_EACH, MIN_BITS, MAX_BITS = 64, 1 << 16, 1 << 28
#: Rows of a key beyond which it is hot, at the least; and how many hot keys there may be at the most.
HOT_ROWS, HOT_KEYS = 256, 1000
#: Texts read at once, in bytes; a longer text is read in pieces of that size.
_PIECE = 1 << 18
#: Digests of texts that a task remembers.
_SEEN = 200_000
#: ASCII upper case to lower case; ASCII that is no letter or digit to a space.
_TABLE = bytes((c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32) for c in range(256))
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_LETTERS = np.random.default_rng(21).integers(1, 2**63, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def translated(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass").translate(_TABLE)


def words_of(text: str) -> list[bytes]:
    return translated(text).split()


# ---------------------------------------------------------------- hashes of words and shingles


_powers: list[list[np.ndarray]] = [[np.ones(1, np.uint64)] * 2] * 2


def _power_rows(k: int, n: int) -> list[np.ndarray]:
    """The powers of a base and of its inverse, modulo 2**64."""
    if len(_powers[k][0]) < n:
        size = max(n, 2 * _PIECE)
        _powers[k] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, base, np.uint64)])) for base in (_BASES[k], pow(_BASES[k], -1, 1 << 64))]
    return _powers[k]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(29))


def _sums(values: np.ndarray, k: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The polynomial hashes of values[start:end]."""
    up, down = _power_rows(k, len(values) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * down[:len(values)])])
    return _mixed((total[ends] - total[starts]) * up[starts] + (ends - starts).astype(np.uint64))


@dataclass
class Piece:
    """The words of some whole texts, or of a part of a long one."""

    data: bytes
    starts: np.ndarray  # of the words in data
    ends: np.ndarray
    text: np.ndarray  # the text that each word belongs to
    place: np.ndarray  # its place there
    first: int  # words before this one, and from `last` on, belong to the pieces next to this one
    last: int

    @classmethod
    def of(cls, data: bytes) -> "Piece":
        is_word = np.frombuffer(data, np.uint8) != 32
        edge = np.flatnonzero(np.diff(np.concatenate([[False], is_word, [False]]).astype(np.int8)))
        starts, ends = edge[::2], edge[1::2]
        return cls(data, starts, ends, np.zeros(len(starts), np.int64), np.arange(len(starts)), 0, len(starts))

    def word_hashes(self) -> np.ndarray:
        return _sums(_LETTERS[np.frombuffer(self.data, np.uint8)], 0, self.starts, self.ends)

    def words(self, a: int, b: int) -> str:
        return " ".join(self.data[x:y].decode("utf-8", "surrogatepass") for x, y in zip(self.starts[a:b].tolist(), self.ends[a:b].tolist()))


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """The hash of each run of `size` words."""
    at = np.arange(max(0, len(hashes) - size + 1))
    return _sums(hashes, 1, at, at + size)


def pieces(texts: Iterable[str], window: int) -> Iterator[Piece]:
    """All words of all texts; of a long text the pieces overlap, so that a window around any word is whole in one."""
    held: list[bytes] = []
    numbers: list[int] = []
    size = 0

    def several() -> Piece:
        piece = Piece.of(b" ".join(held))
        offsets = np.cumsum([0, *(len(x) + 1 for x in held)])[:-1]
        which = np.searchsorted(offsets, piece.starts, side="right") - 1
        piece.text = np.array(numbers)[which]
        piece.place = np.arange(len(which)) - np.searchsorted(which, which)
        return piece

    for number, text in enumerate(texts):
        data = translated(text)
        if len(data) <= _PIECE:
            held.append(data)
            numbers.append(number)
            size += len(data)
            if size >= _PIECE:
                yield several()
                held, numbers, size = [], [], 0
            continue
        at, carried, before, done = 0, b"", 0, 0  # before: words ahead of the carried ones; done: words handed out
        while at < len(data):
            cut = data.find(b" ", at + _PIECE)
            cut = len(data) if cut < 0 else cut
            piece = Piece.of(carried + data[at:cut])
            at, n = cut, len(piece.starts)
            piece.text, piece.place = np.full(n, number), np.arange(n) + before
            piece.first = done - before
            piece.last = n if at == len(data) else max(piece.first, n - window)
            done = before + piece.last
            yield piece
            keep = max(0, piece.last - window)
            carried = piece.data[piece.starts[keep]:] if keep < n else b""
            before += min(keep, n)
    if held:
        yield several()


# ---------------------------------------------------------------- bitmaps


@dataclass(frozen=True)
class Bitmap:
    """A set of hashes by their first bits: never misses one, and may hold others."""

    words: np.ndarray
    bits: int

    def holds(self, h: np.ndarray) -> np.ndarray:
        at = h >> np.uint64(64 - self.bits)
        return (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def bitmap(hashes: DataFrame, column: str = "h") -> Bitmap:
    """Of a column of hashes; at most MAX_BITS / 64 rows reach the driver."""
    n = hashes.count()
    bits = max(MIN_BITS, min(MAX_BITS, 1 << (max(1, n * BITS_EACH) - 1).bit_length())).bit_length() - 1
    at = F.shiftrightunsigned(F.col(column), 64 - bits)
    one = F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int"))
    rows = hashes.select(F.shiftright(at, 6).alias("word"), one.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    words = np.zeros(1 << (bits - 6), np.uint64)
    words[rows.column("word").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return Bitmap(words, bits)


# ---------------------------------------------------------------- the benchmark


def benchmark_windows(benchmark: DataFrame, window: int, item_col: str, text_col: str) -> DataFrame:
    """``item, key, size, words, shingles``: the distinct windows of each item; key is a 128-bit hash of the words."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for item, text in zip(batch.column(0).to_pylist(), common.texts_of(batch, "text"), strict=True):
            piece = Piece.of(translated(text))
            n = len(piece.starts)
            size = min(window, n)
            if not size:
                continue
            short = min(SHINGLE, size)
            h = shingles(piece.word_hashes(), short).view(np.int64)
            found: dict[bytes, tuple[str, list[int]]] = {}
            for k in range(n - size + 1):
                words = piece.words(k, k + size)
                found.setdefault(xxhash.xxh3_128_digest(words.encode("utf-8", "surrogatepass")), (words, h[k:k + size - short + 1].tolist()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([item] * len(found)), pa.array(list(found), pa.binary()), pa.array([size] * len(found), pa.int32()), pa.array([w for w, _ in found.values()]), pa.array([s for _, s in found.values()], pa.list_(pa.int64()))],
                ["item", "key", "size", "words", "shingles"],
            )

    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text")).where("item is not null").distinct()
    return common.map_batches(items, run, "item string, key binary, size int, words string, shingles array<long>")


def shingle_counts(texts: DataFrame, wanted: Bitmap, sizes: list[int], window: int) -> DataFrame:
    """``h, n``: how often the shingles of the bitmap occur in all texts."""
    sent = texts.sparkSession.sparkContext.broadcast(wanted)  # at most MAX_BITS

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for piece in pieces(common.texts_of(batch, "text"), window):
            hashes = piece.word_hashes()
            every = [h[ok] for _, h, ok in _wanted(piece, hashes, sent.value, sizes)]
            h, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *every]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], ["h", "n"])

    return common.map_batches(texts, run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def _wanted(piece: Piece, hashes: np.ndarray, wanted: Bitmap, sizes: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(size, hashes, mask of the shingles that the bitmap holds) of each size; a shingle lies in one text and counts in one piece."""
    for size in sizes:
        h = shingles(hashes, size)
        ok = wanted.holds(h)
        if len(h):
            ok &= piece.text[:len(h)] == piece.text[size - 1:]
            ok[:piece.first] = False
            ok[piece.last:] = False
        yield size, h, ok


def _limit(total: int) -> int:
    return max(HOT_ROWS, total // HOT_KEYS)


def prefixes(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """``h, n, offset, size, words, key``: of each distinct window that may occur its rarest shingle, of equals the first."""
    distinct = windows.dropDuplicates(["key"]).drop("item")
    tokens = distinct.select("key", F.posexplode("shingles").alias("offset", "h"))
    listed = tokens.groupBy("h").agg(F.count("*").alias("m")).join(counts, "h")  # of the counted ones, those that are no shingle of the benchmark go here
    m = distinct.agg(F.coalesce(F.sum(F.size("shingles")), F.lit(0))).head()[0]
    known = common.spread_join(tokens, listed, "h", "m", _limit(m), F.xxhash64("key", "offset"))
    rarest = known.groupBy("key").agg(F.min(F.struct("n", "offset", "h")).alias("r"), F.count("*").alias("k"))
    # a window with a shingle that occurs nowhere has fewer known ones than it has shingles
    return distinct.join(rarest, "key").where(F.col("k") == F.size("shingles")).select("r.h", "r.n", "r.offset", "size", "words", "key")


# ---------------------------------------------------------------- the documents


_FOUND = "doc_id long, text binary, n_words long, maybe boolean, place long, h long, ahead int, around string"


def digest(text: str) -> bytes:
    return xxhash.xxh3_128_digest(text.encode("utf-8", "surrogatepass"))


def _places(narrow: DataFrame, wanted: Bitmap, sizes: list[int], window: int) -> DataFrame:
    """One row for each document (h is null), and one for each place of a wanted shingle in a distinct text."""
    sent = narrow.sparkSession.sparkContext.broadcast(wanted)  # at most MAX_BITS
    names = [c.split()[0] for c in _FOUND.split(", ")]
    types = [pa.int64(), pa.binary(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            digests = [digest(t) for t in common.texts_of(batch, "text")]
            n_words, maybe = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, bool)
            new = [d not in seen for d in digests]
            rows: list[tuple] = []
            for piece in pieces(common.texts_of(batch, "text"), window):
                if len(piece.text):
                    np.maximum.at(n_words, piece.text, piece.place + 1)
                for size, h, ok in _wanted(piece, piece.word_hashes(), sent.value, sizes):
                    at = np.flatnonzero(ok)
                    maybe[piece.text[at]] = True
                    for p, t, value in zip(at.tolist(), piece.text[at].tolist(), h[at].view(np.int64).tolist(), strict=True):
                        if new[t]:
                            low = p - min(window - size, int(piece.place[p]), p)
                            high = min(p + window, len(piece.text))
                            high -= int(np.count_nonzero(piece.text[p:high] != t))
                            rows.append((None, digests[t], None, None, int(piece.place[p]), value, p - low, piece.words(low, high)))
                if len(rows) >= 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(zip(*rows), types, strict=True)], names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(zip(*rows), types, strict=True)], names)
            # copies within a batch are all emitted; those of later batches are not
            if len(seen) > _SEEN:
                seen.clear()
            seen.update(d for d, m in zip(digests, maybe.tolist()) if m)
            none = [pa.nulls(batch.num_rows, x) for x in types[4:]]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary()), pa.array(n_words), pa.array(maybe), *none], names)

    return common.map_arrow(narrow, run, _FOUND)


def _salted(places: DataFrame, rare: DataFrame) -> DataFrame:
    """Places joined with the windows of their shingle; a shingle of many places is dealt into slices."""
    total = rare.select("h", "n").distinct().agg(F.coalesce(F.sum("n"), F.lit(0))).head()[0]
    slices = F.ceil(F.col("n") / _limit(total))
    hot = rare.where(slices > 1).select("h", slices.alias("slices")).distinct()  # less than total / limit rows
    own = F.pmod(F.xxhash64("text", "place"), F.coalesce(F.col("slices"), F.lit(1)))
    left = places.join(F.broadcast(hot), "h", "left").withColumn("slice", own).drop("slices")
    right = rare.withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), slices - 1)))
    return left.join(right, ["h", "slice"])


@dataclass(frozen=True)
class Found:
    documents: DataFrame  # doc_id, text (digest), n_words, maybe
    texts: DataFrame  # text, copies, n_hit, items: of every text that may be hit


def search(docs: DataFrame, benchmark: DataFrame, window: int, id_col: str | None, item_col: str, text_col: str) -> Found:
    spark = docs.sparkSession
    narrow = docs.select((F.col(id_col).cast("long") if id_col else F.lit(None).cast("long")).alias("doc_id"), F.col(text_col).alias("text"))
    windows = common.materialise(benchmark_windows(benchmark, window, item_col, text_col), "windows")
    sizes = sorted({min(SHINGLE, r.size) for r in windows.select("size").distinct().collect()})  # at most `window` rows
    tokens = windows.select(F.explode("shingles").alias("h")).distinct()
    counts = shingle_counts(narrow.select("text"), bitmap(tokens), sizes, window)
    rare = common.materialise(prefixes(windows, counts), "prefixes")
    found = common.materialise(_places(narrow, bitmap(rare.select("h").distinct()), sizes, window), "places")

    joined = _salted(found.where("h is not null").select("text", "place", "h", "ahead", "around"), rare)
    around = F.split("around", " ")
    since = F.col("ahead") - F.col("offset")
    in_bounds = (since >= 0) & (since + F.col("size") <= F.size(around))
    same = F.array_join(F.slice(around, F.greatest(since, F.lit(0)) + 1, F.col("size")), " ") == F.col("words")
    hits = common.materialise(joined.where(in_bounds & same).select("text", (F.col("place") - F.col("offset")).alias("start"), "size", "key", "n").distinct(), "hits")

    def covered(spans: Column) -> Column:
        """Words in the union of some spans, sorted by start."""
        step = lambda acc, s: F.struct((acc["n"] + F.greatest(F.lit(0).cast("long"), s["stop"] - F.greatest(s["start"], acc["to"]))).alias("n"), F.greatest(acc["to"], s["stop"]).alias("to"))
        return F.aggregate(spans, F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to")), step, lambda acc: acc["n"])

    spans = hits.select("text", "start", (F.col("start") + F.col("size")).alias("stop")).distinct().groupBy("text").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("spans"))
    owners = windows.groupBy("key").agg(F.collect_set("item").alias("items"))
    held = hits.select("text", "key").distinct()
    used = held.groupBy("key").agg(F.count("*").alias("n")).join(owners, "key")
    total = held.count()
    items = common.spread_join(held, used, "key", "n", _limit(total), F.xxhash64("text")).select("text", F.explode("items").alias("item")).groupBy("text").agg(F.collect_set("item").alias("items"))
    documents = found.where("h is null").select("doc_id", "text", "n_words", "maybe")
    copies = documents.where("maybe").groupBy("text").agg(F.count("*").alias("copies"))
    hit = spans.select("text", covered(F.col("spans")).alias("n_hit")).join(items, "text")
    texts = copies.join(hit, "text", "left").select("text", "copies", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    return Found(documents, common.materialise(texts, "texts"))


def overlaps(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Per document row: ``doc_id, n_words, n_hit, n_items, items array<string>``."""
    found = search(docs, benchmark, window, id_col, item_col, text_col)
    total = found.texts.agg(F.coalesce(F.sum("copies"), F.lit(0))).head()[0]
    looked = common.spread_join(found.documents.where("maybe"), found.texts, "text", "copies", _limit(total)).select("doc_id", "n_words", "n_hit", "items")
    clean = found.documents.where("not maybe").select("doc_id", "n_words", F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<string>").alias("items"))
    return looked.unionByName(clean).select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """The rows without a hit, with every column they came with.

    Rows whose text is surely not among the hit ones pass as they are; only the others, few beside the
    hit ones themselves, are joined.
    """
    found = search(docs, benchmark, window, None, item_col, text_col)
    bad = found.texts.where("n_hit > 0").select("text", "copies")
    first = lambda digests: np.frombuffer(b"".join([d[:8] for d in digests]), "<i8")
    wanted = bitmap(common.map_batches(bad.select("text"), lambda batch: [pa.RecordBatch.from_arrays([pa.array(first(batch.column(0).to_pylist()))], ["h"])], "h long"))
    total = bad.agg(F.coalesce(F.sum("copies"), F.lit(0))).head()[0]
    sent = docs.sparkSession.sparkContext.broadcast(wanted)  # at most MAX_BITS
    held = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"))

    def name(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        digests = [digest(t) for t in common.texts_of(batch, "row", text_col)]
        near = sent.value.holds(first(digests).view(np.uint64))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary()), pa.array(near)], ["row", "text", "near"])

    marked = common.map_batches(held, name, StructType([StructField("row", docs.schema), StructField("text", BinaryType()), StructField("near", BooleanType())]))
    hot = F.col("copies") > _limit(total)
    # hot: less than total / limit rows
    rest = marked.where("near").join(F.broadcast(bad.where(hot).select("text")), "text", "left_anti").join(bad.where(~hot).select("text"), "text", "left_anti")
    return marked.where("not near").select("row.*").unionByName(rest.select("row.*"))
