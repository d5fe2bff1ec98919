"""Token ids on disk as wavelet matrices, one compressed file per shard.

Documents are dealt by ranges of their id and encoded in order. A shard is one self-contained block of bytes: a header,
the documents' ids and lengths, for each of sixteen bit planes the ones before every block (rank) and the plane's bits in
pieces compressed on their own. A token is read from sixteen pieces, whatever the size of the shard. Spark writes the
shards as rows of Parquet in the shared folder, so lost tasks are repeated and half-written files never count.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window

from .common import Workspace, table
from .subwords import default_tokenizer, give_back, text_encoder

#: Fixed values of the shard format: bits between two counts of ones, and bytes of a plane compressed together.
MAGIC = b"TWWM2\0\0\0"
HEADER = struct.Struct("<8sQIIII")
PLANES = 16
BLOCK = 512
PIECE = 1 << 16
END_ID = 0

#: Parameter: tokens at which a shard is closed (a longer document has a shard of its own size).
SHARD_TOKENS = 2_000_000


class WaveletMatrix:
    """Bit planes of a sequence of numbers below 2 ** 16, highest bit first, each plane in the order that the planes
    above leave: zeros before ones. Answers access, rank, select and occurrences from the planes alone.

    plane(level, piece) gives the bytes of one piece of a plane; ranks[level][k] are the ones before block k.
    """

    def __init__(self, n: int, zeros: Sequence[int], ranks: np.ndarray, plane):
        self.n, self.zeros, self.ranks, self._plane = n, zeros, ranks, plane
        self._read: dict[tuple[int, int], np.ndarray] = {}

    @classmethod
    def build(cls, ids: np.ndarray) -> tuple[list[int], np.ndarray, list[bytes]]:
        """(zeros, ranks, planes) of a sequence."""
        v = ids.astype(np.uint16)
        zeros, ranks, planes = [], np.zeros((PLANES, -(-len(v) // BLOCK) + 1), "<u4"), []
        for level in range(PLANES):
            bit = (v & np.uint16(1 << (PLANES - 1 - level))) != 0
            packed = np.packbits(bit)
            planes.append(packed.tobytes())
            if len(v):
                ranks[level, 1:] = np.cumsum(np.add.reduceat(np.bitwise_count(packed), np.arange(0, len(packed), BLOCK // 8), dtype=np.int64))
            low = np.compress(~bit, v)
            zeros.append(len(low))
            v = np.concatenate([low, np.compress(bit, v)])
        return zeros, ranks, planes

    def _piece(self, level: int, piece: int) -> np.ndarray:
        if (level, piece) not in self._read:
            self._read[level, piece] = np.frombuffer(self._plane(level, piece), np.uint8)
        return self._read[level, piece]

    def bits(self, level: int) -> np.ndarray:
        pieces = -(-((self.n + 7) // 8) // PIECE)
        whole = np.concatenate([np.zeros(0, np.uint8), *(self._piece(level, k) for k in range(pieces))])
        return np.unpackbits(whole, count=self.n).view(bool)

    def to_ids(self) -> np.ndarray:
        """The whole sequence, from the lowest plane up."""
        v = np.zeros(self.n, np.uint16)
        for level in range(PLANES - 1, -1, -1):
            bit = self.bits(level)
            above = np.empty_like(v)
            above[~bit] = v[: self.zeros[level]]
            above[bit] = v[self.zeros[level]:] | np.uint16(1 << (PLANES - 1 - level))
            v = above
        return v

    def _ones(self, level: int, i: int) -> int:
        """Ones before position i of a plane: the stored count of its block and the bits of that block before i."""
        block, size = i // BLOCK, BLOCK // 8
        found = int(self.ranks[level][block])
        if i % BLOCK:
            piece = self._piece(level, block * size // PIECE)
            at = block * size % PIECE
            found += int(np.unpackbits(piece[at: at + size], count=i % BLOCK).sum())
        return found

    def access(self, i: int) -> int:
        value = 0
        for level in range(PLANES):
            ones = self._ones(level, i)
            bit = self._ones(level, i + 1) - ones
            value = value << 1 | bit
            i = self.zeros[level] + ones if bit else i - ones
        return value

    def _range(self, value: int, start: int, end: int) -> tuple[int, int]:
        """Where the occurrences of value at start to end - 1 stand below the last plane."""
        if value >> PLANES:
            return 0, 0
        for level in range(PLANES):
            a, b = self._ones(level, start), self._ones(level, end)
            one = value >> (PLANES - 1 - level) & 1
            start, end = (self.zeros[level] + a, self.zeros[level] + b) if one else (start - a, end - b)
        return start, end

    def rank(self, value: int, start: int, end: int) -> int:
        """How often value is at positions start to end - 1."""
        a, b = self._range(value, start, end)
        return b - a

    def select(self, value: int, k: int) -> int:
        """The position of the k-th (from 0) occurrence of value, or -1."""
        if k >= self.rank(value, 0, self.n):
            return -1
        low, high = 0, self.n
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (low, middle) if self.rank(value, 0, middle) > k else (middle, high)
        return low

    def occurrences(self, value: int) -> np.ndarray:
        """All positions of value in ascending order: from below the last plane back up."""
        start, end = self._range(value, 0, self.n)
        at = np.arange(start, end)
        for level in range(PLANES - 1, -1, -1) if len(at) else ():
            bit = self.bits(level)
            one = value >> (PLANES - 1 - level) & 1
            at = np.flatnonzero(bit if one else ~bit)[at - (self.zeros[level] if one else 0)]
        return at


def write_shard(keys: Sequence[int | None], lengths: Sequence[int], ids: np.ndarray) -> bytes:
    """One shard as bytes. Header; index (null map, document ids, lengths, zeros and ranks of the planes), compressed;
    sizes of the pieces; the pieces, compressed one by one."""
    if len(ids) and int(ids.max()) >> PLANES:
        raise ValueError(f"token ids must be below {1 << PLANES}")
    zeros, ranks, planes = WaveletMatrix.build(ids)
    index = zstandard.compress(b"".join([
        np.array([k is None for k in keys], np.uint8).tobytes(), np.array([k or 0 for k in keys], "<i8").tobytes(),
        np.array(lengths, "<u8").tobytes(), np.array(zeros, "<u8").tobytes(), ranks.tobytes(),
    ]), 1)
    pieces = [zstandard.compress(p[i: i + PIECE], 1) for p in planes for i in range(0, len(p), PIECE)]
    body = b"".join([index, np.array([len(p) for p in pieces], "<u4").tobytes(), *pieces])
    return HEADER.pack(MAGIC, len(ids), len(keys), PLANES, zlib.crc32(body), len(index)) + body


def read_shard(data: bytes) -> tuple[list[int | None], np.ndarray, WaveletMatrix]:
    """Document ids, lengths and the tokens of a shard, whose planes are read when asked for; raises if it is damaged."""
    magic, n, docs, planes, check, size = HEADER.unpack_from(data)
    view = memoryview(data)[HEADER.size:]
    if magic != MAGIC or planes != PLANES or zlib.crc32(view) != check:
        raise ValueError("not a whole shard of token ids")
    index, per_plane = zstandard.decompress(view[:size]), -(-((n + 7) // 8) // PIECE)
    none = np.frombuffer(index, np.uint8, docs)
    keys = np.frombuffer(index, "<i8", docs, docs)
    lengths = np.frombuffer(index, "<u8", docs, 9 * docs).astype(np.int64)
    zeros = [int(z) for z in np.frombuffer(index, "<u8", PLANES, 17 * docs)]
    ranks = np.frombuffer(index, "<u4", offset=17 * docs + 8 * PLANES).reshape(PLANES, -1)
    sizes = np.frombuffer(view, "<u4", PLANES * per_plane, size).astype(np.int64)
    ends = size + sizes.nbytes // 2 + np.cumsum(sizes)

    def plane(level: int, piece: int) -> bytes:
        k = level * per_plane + piece
        return zstandard.decompress(view[ends[k] - sizes[k]: ends[k]])

    return [None if x else int(k) for x, k in zip(none, keys)], lengths, WaveletMatrix(n, zeros, ranks, plane)


SHARDS = "part int, number int, n_tokens long, data binary"
READ = "part int, number int, at int, _id long, offset long, n_tokens long, ids_crc32 long"


def _encode(path: str, shard_tokens: int):
    schema = pa.schema([("part", pa.int32()), ("number", pa.int32()), ("n_tokens", pa.int64()), ("data", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, number = text_encoder(path), TaskContext.get().partitionId(), 0
        keys, lengths, parts, size = [], [], [], 0

        def shard():
            ids = np.concatenate([np.zeros(0, np.uint16), *parts])
            data = write_shard(keys, lengths, ids)
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((part, number, len(ids), data), schema)], schema=schema)

        for batch in batches:
            at, ids_of = 0, batch.column(0).to_pylist()
            for ids, counts in encoder.ids(batch.column(1)):
                if len(ids) and int(ids.max()) >> PLANES:
                    raise ValueError(f"token ids must be below {1 << PLANES}")
                ids = np.insert(ids.astype(np.uint16), np.cumsum(counts), END_ID)
                ends = np.concatenate([[0], np.cumsum(counts + 1)])
                doc = 0
                while doc < len(counts):
                    stop = int(np.searchsorted(ends, ends[doc] + shard_tokens - size))
                    stop = min(max(stop, doc + 1), len(counts))
                    keys += ids_of[at + doc: at + stop]
                    lengths += (counts[doc: stop] + 1).tolist()
                    parts.append(ids[ends[doc]: ends[stop]])
                    size += int(ends[stop] - ends[doc])
                    doc = stop
                    if size >= shard_tokens:
                        yield shard()
                        keys, lengths, parts, size, number = [], [], [], 0, number + 1
                at += len(counts)
        if keys:
            yield shard()
        give_back()

    return run


def write_token_shards(
    docs: DataFrame, work: Workspace, *, tokenizer_path: str, shard_tokens: int = SHARD_TOKENS, id_col="doc_id", text_col="text",
) -> DataFrame:
    """Encode all texts in ascending id order (NULL ids first, equal ids by text) and write the shards; one row each."""
    ordered = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    # Ranges of the id alone: rows with one id stay together, and no task gets more than its share of ids.
    dealt = ordered.repartitionByRange("_id").sortWithinPartitions("_id", "_text")
    return work.write(dealt.mapInArrow(_encode(tokenizer_path, shard_tokens), SHARDS), "shards")


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, number, data in zip(*(batch.column(i).to_pylist() for i in range(3))):
            keys, lengths, matrix = read_shard(data)
            ids = matrix.to_ids().astype("<u4")
            ends = np.cumsum(lengths)
            starts = ends - lengths
            crc = [zlib.crc32(ids[a:b]) for a, b in zip(starts, ends)]
            n = len(keys)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(n, part, np.int32)), pa.array(np.full(n, number, np.int32)), pa.array(np.arange(n, dtype=np.int32)),
                pa.array(keys, pa.int64()), pa.array(starts), pa.array(lengths), pa.array(crc, pa.int64()),
            ], names=["part", "number", "at", "_id", "offset", "n_tokens", "ids_crc32"])


def read_token_shards(shards: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """Read the shards back: the id, start (tokens of all documents before it), n_tokens and ids_crc32 per document."""
    per_part = shards.groupBy("part").agg(F.sum("n_tokens").alias("_n"))
    # One row per range of ids, as many as there are partitions, whatever the number of documents.
    before = per_part.select("part", (F.sum("_n").over(Window.orderBy("part")) - F.col("_n")).alias("_before"))
    in_part = Window.partitionBy("part").orderBy("number")
    starts = shards.select("part", "number", (F.sum("n_tokens").over(in_part) - F.col("n_tokens")).alias("_in")).join(
        before, "part",
    ).select("part", "number", (F.col("_before") + F.col("_in")).alias("_start"))
    docs = shards.select("part", "number", "data").mapInArrow(_decode, READ)
    return docs.join(starts, ["part", "number"]).select(
        F.col("_id").alias(id_col), (F.col("_start") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32",
    )


def token_output(docs: DataFrame, *, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write all documents as shards of token ids and read them back, one row per input row.

    Every document's ids end with id 0. A NULL or empty text is that id alone; repeated rows and equal ids each have
    their place, NULL ids come first. Ids are whole numbers (or texts of them; other texts raise). Other columns of the
    input are not looked at; an empty table gives no shards and an empty result. The tokenizer's ids must be below 65,536.
    """
    work = Workspace(docs.sparkSession, "token-output")
    return read_token_shards(write_token_shards(docs, work, tokenizer_path=tokenizer_path, id_col=id_col, text_col=text_col), id_col=id_col)


def _each(shards: DataFrame, answer, schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield answer(row, *read_shard(row["data"]))

    return shards.select("part", "number", "data").mapInArrow(run, schema)


def token_frequencies(shards: DataFrame, tokens: Sequence[int]) -> DataFrame:
    """(token, n): how often each of the given ids stands in all shards, from two ranks per plane and shard."""
    def answer(row, keys, lengths, matrix):
        return pa.RecordBatch.from_pydict({"token": list(tokens), "n": [matrix.rank(t, 0, matrix.n) for t in tokens]})

    return _each(shards, answer, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def token_occurrences(shards: DataFrame, tokens: Sequence[int], *, id_col: str = "doc_id") -> DataFrame:
    """(token, part, number, at, id, offset): every place of the given ids. A place is a document's row in its shard
    (part, number, at), which also tells rows with one id apart, and the offset of the token in it."""
    def answer(row, keys, lengths, matrix):
        ends = np.cumsum(lengths)
        at = [matrix.occurrences(t) for t in tokens]
        places = np.concatenate([np.zeros(0, np.int64), *at])
        doc = np.searchsorted(ends, places, "right")
        return pa.RecordBatch.from_pydict({
            "token": np.repeat(np.array(tokens, np.int64), [len(a) for a in at]), "part": np.full(len(doc), row["part"], np.int32),
            "number": np.full(len(doc), row["number"], np.int32), "at": doc.astype(np.int32),
            id_col: pa.array(keys, pa.int64()).take(pa.array(doc)), "offset": places - (ends - lengths)[doc],
        })

    return _each(shards, answer, f"token long, part int, number int, at int, {id_col} long, offset long")


def tokens_at(shards: DataFrame, wanted: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """(id, offset, token) for wanted rows (id, offset); without the offsets that a document does not have.

    Only the index of a shard is read to find a document's shard; the places wanted of it are then dealt to the shard
    (and to 16 copies of it, so that one shard wanted often is not one task). Rows with one id each answer.
    """
    def index(row, keys, lengths, matrix):
        n = len(keys)
        return pa.RecordBatch.from_pydict({
            "part": np.full(n, row["part"], np.int32), "number": np.full(n, row["number"], np.int32), "_id": pa.array(keys, pa.int64()),
            "_start": np.cumsum(lengths) - lengths, "_n": lengths,
        })

    places = _each(shards, index, "part int, number int, _id long, _start long, _n long")
    wanted = wanted.select(F.col(id_col).cast("long").alias("_id"), F.col("offset").cast("long").alias("offset"))
    found = wanted.join(places, "_id").where((F.col("offset") >= 0) & (F.col("offset") < F.col("_n"))).select(
        "part", "number", F.pmod(F.xxhash64("_id", "offset"), F.lit(16)).cast("int").alias("_copy"), "_id", "offset",
        (F.col("_start") + F.col("offset")).alias("_place"),
    )
    copies = shards.select("part", "number", "data", F.explode(F.array(*[F.lit(k) for k in range(16)])).alias("_copy"))
    key = ["part", "number", "_copy"]

    def read(shard: pa.Table, rows: pa.Table) -> pa.Table:
        matrix = read_shard(shard["data"][0].as_py())[2] if rows.num_rows else None
        return pa.table({
            id_col: rows["_id"], "offset": rows["offset"],
            "token": pa.array([matrix.access(p) for p in rows["_place"].to_pylist()], pa.int64()),
        })

    needed = copies.join(found.select(key).distinct(), key, "left_semi")
    return needed.groupBy(key).cogroup(found.groupBy(key)).applyInArrow(read, f"{id_col} long, offset long, token long")


def op3_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output(table(spark, sf_dir, "documents"), tokenizer_path=default_tokenizer())
