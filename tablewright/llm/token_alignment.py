"""How two tokenizers cut the same texts, and which of their ids belong together over the whole corpus.

Every text is encoded by both tokenizers; byte offsets at which tokens of both end cut them into groups, and all tokens
of a group are linked across. How many documents hold a pair of linked ids is counted externally:

1. A task turns a block of texts into one spill: its records (pair, document, links) in order of the pair, compressed,
   and its run: the distinct pairs with their numbers of documents.
2. Runs are cut by a radix of the first id, and runs of one radix are merged k ways by a heap, up to FAN at once and in
   as many rounds as it takes. A merged run is ordered by the first id, so the highest count of an id is at hand when
   its pairs have passed.
3. Counts stream back to the runs they came from, round by round, and meet the records of their spill, which have never
   left it: there they become the figures of the documents.

A pair that all documents hold is one entry of a run, so no key gathers rows; a merge reads a bounded number of runs.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyspark.sql.functions as F
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructField, StructType

from .common import Workspace, table
from .subwords import KEPT_BYTES, KEPT_CHUNKS, ChunkTable, Encoder, calls, cut_block, default_pieces, default_tokenizer, give_back, joined_text, ragged
from .wordcodes import mix, text_blocks

#: Parameters: bytes of texts of a spill (a longer text has one of its own) and its rows, entries of runs that a radix gets, runs merged
#: at once, entries merged in one step of the heap, and links beyond which a group's ids are counted before they are paired.
SPILL_BYTES = 8 << 20
SPILL_ROWS = 2_000
RADIX_ENTRIES = 2_000_000
FAN = 512
MERGE_STEP = 1 << 18
WIDE_GROUP = 1 << 14

#: Ids of both sides in one number.
ID_BITS = 20
_LOW = (1 << ID_BITS) - 1
DOC_BITS = 64 - 2 * ID_BITS


class Pieces:
    """A sentencepiece model: ids of texts, and the bytes of each id."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        names = [self.model.id_to_piece(i) for i in range(n)]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
        self.width = np.array([len(b) for b in self.bytes], np.int64)
        probe = " ½  ﬁ　é\t\n A "
        #: Whether texts may be cut at blanks and line breaks: nothing is rewritten and no piece reaches over them.
        self.cuts = (
            not any("\n" in p or "▁" in p.lstrip("▁") for p in names)
            and b"".join(self.bytes[i] for i in self.model.encode(probe)) == b" " + probe.encode()
            and [names[i] for i in self.model.encode("x x")][:1] == ["▁x"]
        )

    def after(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of texts that begin with white space, as they are in the middle of a text."""
        return [np.array(ids[1:], np.int64) for ids in self.model.encode(["x" + t for t in texts], num_threads=1)]

    def each(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(ids, np.int64) for ids in self.model.encode(texts, num_threads=1)]


def _flat(parts: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.int64), *parts]).astype(np.int64)


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values between bounds."""
    return np.diff(np.concatenate([[0], np.cumsum(values)])[first])


def pair_up(group: np.ndarray, m: np.ndarray, n: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, pair, links) of the groups, m ids of one and n of the other side each; group names their owner."""
    a_first, b_first = np.cumsum(m) - m, np.cumsum(n) - n
    size = m * n
    wide = np.flatnonzero(size > WIDE_GROUP)
    size[wide] = 0
    g = np.repeat(np.arange(len(size)), size)
    k = ragged(np.zeros(len(size), np.int64), size)
    owner, pair = [group[g]], [a[a_first[g] + k // n[g]] << ID_BITS | b[b_first[g] + k % n[g]]]
    links = [np.ones(len(g), np.int64)]
    for w in wide.tolist():
        (ids, times), (others, other_times) = (
            np.unique(x[at: at + size], return_counts=True) for x, at, size in ((a, a_first[w], m[w]), (b, b_first[w], n[w]))
        )
        pair.append((ids[:, None] << ID_BITS | others[None, :]).ravel())
        links.append((times[:, None] * other_times[None, :]).ravel())
        owner.append(np.full(len(pair[-1]), group[w]))
    return _flat(owner), _flat(pair), _flat(links)


def summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of their values."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(values[order], first) if len(keys) else values


class AlignmentTable(ChunkTable):
    """Groups of the chunks met so far. flat holds the distinct pairs of a chunk, links how often it has each."""

    def __init__(self, first: Encoder, second: Pieces):
        self.second = second
        self.cuts = first.cuts and second.cuts
        self.vocabulary = [pa.array(x.bytes, pa.binary()) for x in (first, second)]
        super().__init__(first)

    def clear(self) -> None:
        super().clear()
        self.flat, self.links = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.figures = np.zeros((0, 4), np.int64)
        self.fits, self.texts = np.zeros(0, bool), pa.array([], pa.large_binary())

    def full(self) -> bool:
        # An entry takes more than ids alone do.
        return len(self.known) > KEPT_CHUNKS // 4 or self.known.nbytes > KEPT_BYTES // 3

    def add(self, new: pa.Array) -> np.ndarray:
        joined = self.encoder.joins(new)[0] & ~pc.match_substring(new, "▁").to_numpy(zero_copy_only=False) if self.cuts else np.zeros(len(new), bool)
        together = new.filter(pa.array(joined))
        found = self._groups(together, True) if len(together) else None
        if found is None:
            joined, together, found = np.zeros(len(new), bool), new.slice(0, 0), ()
        alone = new.filter(pa.array(~joined))
        every = [*([found] if found else []), *(self._groups(alone.slice(i, 1), False) or self._none() for i in range(len(alone)))]
        for lengths, pairs, links, figures, fits, texts in every:
            self.length, self.flat = np.concatenate([self.length, lengths]), np.concatenate([self.flat, pairs])
            self.links, self.figures = np.concatenate([self.links, links]), np.concatenate([self.figures, figures])
            self.fits, self.texts = np.concatenate([self.fits, fits]), pa.concat_arrays([self.texts, texts])
        self.start = np.cumsum(self.length) - self.length
        return np.concatenate([np.flatnonzero(joined), np.flatnonzero(~joined)])

    def _none(self):
        """A text whose tokens do not spell it."""
        none = np.zeros(0, np.int64)
        return np.zeros(1, np.int64), none, none, np.zeros((1, 4), np.int64), np.zeros(1, bool), pa.array([b""], pa.large_binary())

    def _groups(self, chunks: pa.Array, many: bool):
        """Groups of chunks encoded in long texts, or of one; None if a tokenizer's bytes are not those of the text, or
        the bounds of the chunks not those of groups."""
        text, bounds = joined_text(chunks)
        if many or self.cuts:
            parts = [str(text[i:j], "utf-8") for i, j in calls(bounds)]
            a, b = _flat(self.encoder.each(parts)), _flat(self.second.after(parts))
        else:
            whole = str(text, "utf-8")
            a, b = _flat(self.encoder.each([whole])), _flat(self.second.each([whole[1:]]))
        for ids, vocabulary in zip((a, b), self.vocabulary):
            spelt = pc.binary_join(pa.ListArray.from_arrays([0, len(ids)], vocabulary.take(pa.array(ids))), b"")[0].as_py() if len(ids) else b""
            if spelt != bytes(text):
                return None
        a_ends, b_ends = np.cumsum(self.encoder.width[a]), np.cumsum(self.second.width[b])
        ends = np.intersect1d(a_ends, b_ends, assume_unique=True)
        chunk = np.searchsorted(bounds[1:], ends)
        first = np.searchsorted(chunk, np.arange(len(chunks) + 1))
        if not np.array_equal(ends[first[1:] - 1], bounds[1:]):
            return None
        a_group, b_group = np.searchsorted(ends, a_ends), np.searchsorted(ends, b_ends)
        m, n = np.bincount(a_group, minlength=len(ends)), np.bincount(b_group, minlength=len(ends))
        owner, pair, links = pair_up(chunk, m, n, a, b)
        keys, links = summed(owner << 2 * ID_BITS | pair, links)
        figures = np.stack([_sums(m, first), _sums(n, first), np.diff(first), _sums(m * n, first)], axis=1)
        lengths = np.bincount(keys >> 2 * ID_BITS, minlength=len(chunks))
        return lengths, keys & ((1 << 2 * ID_BITS) - 1), links, figures, np.ones(len(chunks), bool), self._spelling(a, b, a_group, b_group, m, n, first)

    @staticmethod
    def _spelling(a, b, a_group, b_group, m, n, first) -> pa.Array:
        """Groups as `a1,a2|b1;`, one text per chunk."""
        before = np.cumsum(m + n) - (m + n)
        at_a = before[a_group] + np.arange(len(a)) - (np.cumsum(m) - m)[a_group]
        at_b = before[b_group] + m[b_group] + np.arange(len(b)) - (np.cumsum(n) - n)[b_group]
        ids, sign = np.empty(len(a) + len(b), np.int64), np.zeros(len(a) + len(b), np.int64)
        ids[at_a], ids[at_b] = a, b
        sign[before + m - 1], sign[before + m + n - 1] = 1, 2
        signs = pa.array([",", "|", ";"], pa.large_string()).take(pa.array(sign))
        made = pc.binary_join_element_wise(pa.array(ids).cast(pa.large_string()), signs, pa.scalar("", pa.large_string()))
        text, bounds = joined_text(made)
        chunk = np.append(before, len(ids))[first]
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first) - 1, [None, pa.py_buffer(bounds[chunk].astype(np.int64)), pa.py_buffer(text)])


@functools.lru_cache(maxsize=2)
def _table(first: str, second: str) -> AlignmentTable:
    a, b = Encoder(first, plain=True), Pieces(second)
    if max(a.size, len(b.bytes)) > 1 << ID_BITS:
        raise ValueError(f"vocabularies of more than {1 << ID_BITS} ids")
    return AlignmentTable(a, b)


def pack(**columns) -> bytes:
    """Columns of equal length as one compressed block."""
    batch = pa.RecordBatch.from_pydict(columns)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpack(data: bytes) -> list[pa.Array]:
    return pa.ipc.open_stream(data).read_next_batch().columns


def write_run(pairs: np.ndarray, n: np.ndarray, **more) -> bytes:
    return pack(step=np.diff(pairs, prepend=np.int64(0)), n=n, **more)


def read_run(data: bytes) -> list[np.ndarray]:
    """Pairs, numbers of documents, and what else the run has."""
    step, *rest = (c.to_numpy(zero_copy_only=False) for c in unpack(data))
    return [np.cumsum(step), *rest]


def radix_of(pairs: np.ndarray, radixes: int) -> np.ndarray:
    return (mix((pairs >> ID_BITS).astype(np.uint64)) % np.uint64(radixes)).astype(np.int64)


def _spill(first: str, second: str):
    blank, nothing = pa.scalar(" ", pa.large_string()), pa.scalar("", pa.large_string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, number = _table(first, second), TaskContext.get().partitionId() << 32
        for batch in batches:
            for low in range(0, batch.num_rows, SPILL_ROWS):
                rows = batch.slice(low, SPILL_ROWS)
                text = rows.column(1).cast(pa.large_string()).fill_null("")
                text = pc.if_else(pc.not_equal(text, ""), pc.binary_join_element_wise(blank, text, nothing), text)
                for at, end, data, offsets in text_blocks(text, SPILL_BYTES):
                    if made.full():
                        made.clear()
                    yield _spill_block(made, number, rows.column(0).slice(at, end - at), data, offsets)
                    number += 1
        give_back()

    return run


def _spill_block(made: AlignmentTable, number: int, ids: pa.Array, data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
    docs = len(ids)
    if docs >> DOC_BITS:
        raise ValueError("too many rows in one batch")
    if made.cuts:
        chunks, first = cut_block(data, offsets)
    else:
        chunks = pa.LargeStringArray.from_buffers(docs, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data)))
        chunks, first = chunks.filter(pc.not_equal(chunks, "")).dictionary_encode(), np.concatenate([[0], np.cumsum(np.diff(offsets) > 0)])
    entries = made.find(chunks.dictionary)[chunks.indices.to_numpy()]
    doc = np.repeat(np.arange(docs), np.diff(first))
    fits = np.ones(docs, bool)
    fits[doc[~made.fits[entries]]] = False
    figures = np.stack([_sums(made.figures[entries, k], first) for k in range(4)], axis=1) * fits[:, None]
    text, bounds = joined_text(made.texts.take(pa.array(entries)))
    bounds = bounds[first]
    digests = [hashlib.sha256(text[a: b - 1]).hexdigest() if ok and b > a else "" for a, b, ok in zip(bounds[:-1].tolist(), bounds[1:].tolist(), fits.tolist())]

    # Each chunk of a document once, with its number; then its pairs.
    wanted = fits[doc]
    held, times = summed(doc[wanted] << 32 | entries[wanted], np.ones(int(wanted.sum()), np.int64))
    doc, entry = held >> 32, held & 0xFFFFFFFF
    lengths = made.length[entry]
    at = ragged(made.start[entry], lengths)
    keys, links = summed(
        (made.flat[at] << DOC_BITS | np.repeat(doc, lengths)).astype(np.uint64), made.links[at] * np.repeat(times, lengths),
    )
    pairs, doc = (keys >> np.uint64(DOC_BITS)).astype(np.int64), (keys & np.uint64((1 << DOC_BITS) - 1)).astype(np.uint32)
    distinct, n = np.unique(pairs, return_counts=True)
    return pa.RecordBatch.from_pydict({
        "spill": pa.array([number], pa.int64()), "entries": pa.array([len(distinct)], pa.int64()),
        "run": pa.array([write_run(distinct, n.astype(np.int64))], pa.binary()),
        "records": pa.array([pack(doc=doc, links=links)], pa.binary()),
        "docs": pa.array([pack(id=ids, a=figures[:, 0], b=figures[:, 1], groups=figures[:, 2], links=figures[:, 3], sha=digests)], pa.binary()),
    })


SPILLS = "spill long, entries long, run binary, records binary, docs binary"
RUNS = "radix long, id long, run binary"


def _cut(radixes: int):
    """The run of a spill as a run per radix."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for spill, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                pairs, n = read_run(data.as_py())
                radix = radix_of(pairs, radixes)
                there = np.unique(radix)
                runs = [write_run(pairs[radix == r], n[radix == r]) for r in there]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(there), pa.array([spill] * len(there), pa.int64()), pa.array(runs, pa.binary())], names=["radix", "id", "run"],
                )

    return run


def merge(runs: list[list[np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Merges k runs into blocks of (pairs, sums) in order.

    The heap holds the last pair of the block that each run is at. Whatever is not beyond the smallest of these is known
    whole in all runs, and leaves them together.
    """
    step = max(1, MERGE_STEP // max(1, len(runs)))
    heap = [(int(pairs[min(step, len(pairs)) - 1]), r) for r, (pairs, _) in enumerate(runs) if len(pairs)]
    heapq.heapify(heap)
    at = [0] * len(runs)
    while heap:
        bound, found = heap[0][0], []
        for r, (pairs, n) in enumerate(runs):
            end = at[r] + int(np.searchsorted(pairs[at[r]: at[r] + step], bound, "right"))
            if end > at[r]:
                found.append((pairs[at[r]: end], n[at[r]: end]))
            at[r] = end
        yield summed(np.concatenate([p for p, _ in found]), np.concatenate([n for _, n in found]))
        while heap and heap[0][0] <= bound:
            _, r = heapq.heappop(heap)
            pairs = runs[r][0]
            if at[r] < len(pairs):
                heapq.heappush(heap, (int(pairs[min(at[r] + step, len(pairs)) - 1]), r))


def merged(runs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    blocks = list(merge([read_run(r) for r in runs]))
    return _flat([p for p, _ in blocks]), _flat([n for _, n in blocks])


def _merge(key: tuple, rows: pa.Table) -> pa.Table:
    run = write_run(*merged(rows["run"].to_pylist()))
    return pa.table({"radix": pa.array([key[0].as_py()], pa.int64()), "id": pa.array([key[1].as_py()], pa.int64()), "run": pa.array([run], pa.binary())})


def highest(pairs: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Which pairs have the highest count of their first id, ties included."""
    first = np.flatnonzero(np.diff(pairs >> ID_BITS, prepend=-1))
    if not len(first):
        return np.zeros(0, bool)
    return n == np.repeat(np.maximum.reduceat(n, first), np.diff(np.append(first, len(n))))


def _top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A run of all there is of a radix, with the mark of the highest counts."""
    for batch in batches:
        for radix, number, data in zip(*(batch.column(i).to_pylist() for i in range(3))):
            pairs, n = read_run(data)
            yield pa.RecordBatch.from_arrays(
                [pa.array([radix], pa.int64()), pa.array([number], pa.int64()), pa.array([write_run(pairs, n, best=highest(pairs, n))], pa.binary())],
                names=["radix", "id", "run"],
            )


def _back(runs: pa.Table, above: pa.Table) -> pa.Table:
    """Counts of a merged run, to the runs it was made of."""
    if not runs.num_rows or not above.num_rows:
        return pa.table({"radix": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "run": pa.array([], pa.binary())})
    all_pairs, n, best = read_run(above["run"][0].as_py())
    out = []
    for data in runs["run"].to_pylist():
        pairs = read_run(data)[0]
        at = np.searchsorted(all_pairs, pairs)
        out.append(write_run(pairs, n[at], best=best[at]))
    return pa.table({"radix": runs["radix"], "id": runs["id"], "run": pa.array(out, pa.binary())})


def pair_counts(runs: DataFrame, work: Workspace, n_runs: int, fan: int = FAN) -> DataFrame:
    """Runs (radix, id, run) of n_runs spills with, for each of their pairs, the count over all runs and whether it is
    the highest of its first id."""
    levels, numbers = [runs], [n_runs]
    key = ["radix", "_above"]

    def grouped(df: DataFrame, above: int) -> DataFrame:
        return df.withColumn("_above", F.pmod(F.xxhash64("id"), F.lit(above)).cast("long"))

    while not levels[1:] or numbers[-1] > 1:
        numbers.append(-(-numbers[-1] // fan))
        made = grouped(levels[-1], numbers[-1]).groupBy(key).applyInArrow(_merge, RUNS)
        levels.append(work.write(made, f"runs-{len(levels)}"))
    found = levels.pop().mapInArrow(_top, RUNS)
    for k in range(len(levels) - 1, -1, -1):
        found = grouped(levels[k], numbers[k + 1]).groupBy(key).cogroup(found.withColumnRenamed("id", "_above").groupBy(key)).applyInArrow(_back, RUNS)
    return found


def _figures(radixes: int, names: list[str]):
    def run(spill: pa.Table, counts: pa.Table) -> pa.Table:
        ids, a, b, groups, links, sha = unpack(spill["docs"][0].as_py())
        pairs, n = read_run(spill["run"][0].as_py())
        doc, per_link = (c.to_numpy() for c in unpack(spill["records"][0].as_py()))
        count, best = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), bool)
        radix = radix_of(pairs, radixes)
        for r, data in zip(counts["radix"].to_pylist(), counts["run"].to_pylist()):
            _, count[radix == r], best[radix == r] = read_run(data)
        n_best, count_sum = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
        np.add.at(n_best, doc, per_link * np.repeat(best, n))
        np.add.at(count_sum, doc, per_link * np.repeat(count, n))
        return pa.table(dict(zip(names, [ids, a, b, groups, links, pa.array(n_best), pa.array(count_sum), sha])))

    return run


def align_tokens(docs: DataFrame, *, first: str, second: str, id_col: str = "doc_id", text_col: str = "text", fan: int = FAN) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), one row per input row.

    first is a file of the tokenizers library, second one of sentencepiece. NULL and empty texts, and texts that either
    side's tokens do not spell (a blank before them), have no tokens: zeros and ''. Repeated rows count as documents of
    their own; equal and NULL ids each keep their row. An empty table gives an empty result. Other columns are not looked at.
    """
    work = Workspace(docs.sparkSession, "token-alignment")
    some = docs.select(F.col(id_col), F.col(text_col).cast("string"))
    spills = work.write(some.mapInArrow(_spill(first, second), SPILLS), "spills")
    n_spills, entries = spills.agg(F.count("*"), F.coalesce(F.sum("entries"), F.lit(0))).first()
    radixes = max(16, -(-entries // RADIX_ENTRIES))
    runs = work.write(spills.select("spill", "run").mapInArrow(_cut(radixes), RUNS), "runs")
    counts = pair_counts(runs, work, max(1, n_spills), fan).withColumnRenamed("id", "spill")
    out = StructType([StructField(id_col, docs.schema[id_col].dataType)]).add("n_a", "long").add("n_b", "long").add("n_groups", "long").add(
        "n_links", "long").add("n_best", "long").add("count_sum", "long").add("groups_sha256", "string")
    return spills.groupBy("spill").cogroup(counts.groupBy("spill")).applyInArrow(_figures(radixes, out.names), out)


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokens(table(spark, sf_dir, "documents"), first=default_tokenizer(), second=default_pieces())
