"""Token ids of whole texts with every distinct word encoded once.

Used inside Arrow functions. Texts are cut into chunks (white space and what follows it) by their bytes, chunks are
dictionary-encoded by Arrow, and only chunks not met before go to the tokenizer, many in one call. The ids of a text are
gathered from the chunks' ids with numpy; no Python code runs per word of a text.

Cutting is exact only for tokenizers that never join a word with white space after it. `Encoder` reads the tokenizer's
file and encodes whole texts where that is not certain.
"""

from __future__ import annotations

import functools
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .wordcodes import text_blocks

#: Parameters: bytes of texts worked on at once, chunks kept, bytes of chunks kept, chunks in one call.
BLOCK = 8 << 20
KEPT_CHUNKS = 1_000_000
KEPT_BYTES = 32 << 20
CALL_CHUNKS = 256

_nothing = pa.scalar("", pa.large_string())
_cuts = np.zeros(256, bool)
_cuts[[0x20, 0x0A]] = True
_space = np.zeros(256, bool)
_space[[0x20, *range(0x09, 0x0E), *range(0x1C, 0x20)]] = True


def chunk_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the chunks that tile the texts, and for each text the number of chunks before it (one more at the end).

    A chunk begins at a blank or line break after a sign that is no white space. Signs of three bytes that might be white
    space (first byte E1 to E3) count as such, which only leaves two chunks in one.
    """
    cut = _cuts[data]
    if len(data):
        before = np.zeros(len(data), bool)
        before[1:] = _space[data[:-1]]
        before[2:] |= (data[:-2] == 0xC2) & ((data[1:-1] == 0x85) | (data[1:-1] == 0xA0))
        before[3:] |= (data[:-3] >= 0xE1) & (data[:-3] <= 0xE3) & (data[2:-1] >= 0x80)
        cut &= ~before
        cut[0] = True
        cut[offsets[offsets < len(data)]] = True
    bounds = np.append(np.flatnonzero(cut), len(data)).astype(np.int64)
    return bounds, np.searchsorted(bounds[:-1], offsets)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions start, start + 1, ... of each range, one range after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 ones for themselves, the rest
    in order from code point 256."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    """A tokenizer file of the tokenizers library. plain: special tokens inside texts are ordinary text."""

    def __init__(self, path: str, *, plain: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.tokenizer.encode_special_tokens = plain
        model, first = spec["model"], spec.get("pre_tokenizer") or {}
        added = spec.get("added_tokens") or []
        #: Whether words and the white space after them are never joined, so that texts may be cut between them.
        self.cuts = (
            not spec.get("normalizer") and first.get("type") == "ByteLevel" and first.get("use_regex", True)
            and not first.get("add_prefix_space") and model.get("type") == "BPE"
            and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
            and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or any(c.isspace() for c in t["content"]) for t in added)
            and not (plain and any(not t["special"] for t in added))
        )
        self.marks = [] if plain else [t["content"] for t in added]
        vocabulary = model["vocab"] if isinstance(model.get("vocab"), dict) else {}
        self.size = max([self.tokenizer.get_vocab_size() - 1, *vocabulary.values(), *(t["id"] for t in added)]) + 1
        #: The bytes that each id stands for, if the vocabulary is byte-level.
        self.bytes: list[bytes] = [b""] * self.size
        letters = {c: b for b, c in byte_letters().items()}
        for token, i in vocabulary.items():
            self.bytes[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        for t in added:
            self.bytes[t["id"]] = t["content"].encode()
        self.width = np.array([len(b) for b in self.bytes], np.int64)

    def each(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def joins(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Which chunks may stand in one text with others, as their ids do not depend on neighbours, and which of these
        need a line break before them."""
        offsets, data = np.frombuffer(chunks.buffers()[1], np.int64)[: len(chunks) + 1], np.frombuffer(chunks.buffers()[2], np.uint8)
        at, end = offsets[:-1], offsets[1:]
        first, last = data[at], data[end - 1]
        second, third = data[np.maximum(end - 2, at)], data[np.maximum(end - 3, at)]
        open_end = _space[last] | ((second == 0xC2) & ((last == 0x85) | (last == 0xA0))) | ((third >= 0xE1) & (third <= 0xE3) & (last >= 0x80))
        lead = ~_cuts[first]
        joined = ~open_end & ~(lead & (_space[first] | (first == 0xC2) | ((first >= 0xE1) & (first <= 0xE3))))
        for mark in self.marks:
            joined &= ~pc.match_substring(chunks, mark).to_numpy(zero_copy_only=False)
        return joined, lead

    def chunks(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(order, lengths, ids): the ids of distinct, non-empty chunks one after the other, in the order returned."""
        joined, lead = self.joins(chunks)
        found = self._together(chunks.filter(pa.array(joined)), lead[joined])
        if found is None:
            joined, found = np.zeros(len(chunks), bool), (np.zeros(0, np.int64), np.zeros(0, np.uint32))
        own = self.each(chunks.filter(pa.array(~joined)).to_pylist())
        lengths = np.concatenate([found[0], np.array([len(x) for x in own], np.int64)])
        return np.concatenate([np.flatnonzero(joined), np.flatnonzero(~joined)]), lengths, np.concatenate([found[1], *own])

    def _together(self, chunks: pa.Array, lead: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """Chunks encoded in long texts and told apart by the bytes of their tokens; None if a token spans two."""
        if not len(chunks):
            return np.zeros(0, np.int64), np.zeros(0, np.uint32)
        # A line break before a chunk without white space is a token of its own; it is taken off again.
        texts, bounds = joined_text(pc.binary_join_element_wise(pa.array(np.where(lead, "\n", "")).cast(pa.large_string()), chunks, _nothing))
        ids = np.concatenate(self.each([str(texts[a:b], "utf-8") for a, b in calls(bounds)]))
        bounds = bounds[1:]
        ends = np.cumsum(self.width[ids])
        last = np.searchsorted(ends, bounds)
        if not len(ends) or last[-1] >= len(ends) or not np.array_equal(ends[last], bounds):
            return None
        starts = np.concatenate([[0], last[:-1] + 1])
        if (self.width[ids[starts[lead]]] != 1).any():
            return None
        keep = np.ones(len(ids), bool)
        keep[starts[lead]] = False
        return last + 1 - starts - lead, ids[keep]


def joined_text(texts: pa.Array) -> tuple[memoryview, np.ndarray]:
    """The bytes of all texts of an array one after the other, and their bounds."""
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset: texts.offset + len(texts) + 1]
    return memoryview(texts.buffers()[2])[bounds[0]: bounds[-1]], bounds - bounds[0]


def calls(bounds: np.ndarray) -> list[tuple[int, int]]:
    """Bounds of the texts of one call each."""
    at = np.append(bounds[:-1:CALL_CHUNKS], bounds[-1])
    return list(zip(at[:-1].tolist(), at[1:].tolist()))


class ChunkTable:
    """What is known of the chunks met so far, ragged: chunk k has flat[start[k]: start[k] + length[k]]."""

    def __init__(self, encoder: Encoder):
        self.encoder = encoder
        self.clear()

    def clear(self) -> None:
        self.known = pa.array([], pa.large_string())
        self.length, self.flat = np.zeros(0, np.int64), np.zeros(0, np.uint32)
        self.start = np.zeros(0, np.int64)

    def add(self, new: pa.Array) -> np.ndarray:
        """Encode new chunks; returns the order in which they were numbered."""
        order, lengths, flat = self.encoder.chunks(new)
        self.length, self.flat = np.concatenate([self.length, lengths]), np.concatenate([self.flat, flat])
        self.start = np.cumsum(self.length) - self.length
        return order

    def find(self, distinct: pa.Array) -> np.ndarray:
        """The number of each chunk; new ones are encoded and added."""
        at = pc.index_in(distinct, value_set=self.known).fill_null(-1).to_numpy().astype(np.int64)
        missing = np.flatnonzero(at < 0)
        if len(missing):
            new = distinct.take(pa.array(missing))
            order = self.add(new)
            at[missing[order]] = len(self.known) + np.arange(len(order))
            self.known = pa.concat_arrays([self.known, new.take(pa.array(order))])
        return at

    def full(self) -> bool:
        return len(self.known) > KEPT_CHUNKS or self.known.nbytes > KEPT_BYTES


def cut_block(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The chunks of a block as a dictionary-encoded array, and the number of chunks before each text."""
    bounds, first = chunk_bounds(data, offsets)
    data = np.ascontiguousarray(data)
    chunks = pa.LargeStringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds), pa.py_buffer(data))
    return chunks.dictionary_encode(), first


class TextEncoder:
    """Token ids of columns of texts."""

    def __init__(self, path: str, *, plain: bool = False):
        self.encoder = Encoder(path, plain=plain)
        self.table = ChunkTable(self.encoder)

    def _entries(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.table.full():
            self.table.clear()
        chunks, first = cut_block(data, offsets)
        return self.table.find(chunks.dictionary)[chunks.indices.to_numpy()], first

    def ids(self, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Block by block, all rows in order: the ids of its texts one after the other, and each text's number of ids."""
        if not self.encoder.cuts:
            for at in range(0, len(column), CALL_CHUNKS):
                own = self.encoder.each([t or "" for t in column.slice(at, CALL_CHUNKS).to_pylist()])
                yield np.concatenate(own), np.array([len(x) for x in own], np.int64)
            return
        for _, _, data, offsets in text_blocks(column, BLOCK):
            entries, first = self._entries(data, offsets)
            lengths = self.table.length[entries]
            before = np.concatenate([[0], np.cumsum(lengths)])
            yield self.table.flat[ragged(self.table.start[entries], lengths)], np.diff(before[first])

    def counts(self, column: pa.Array) -> np.ndarray:
        """The number of ids of each text; 0 for NULL."""
        if not self.encoder.cuts:
            return np.concatenate([np.zeros(0, np.int64), *(n for _, n in self.ids(column))])
        out = [np.zeros(0, np.int64)]
        for _, _, data, offsets in text_blocks(column, BLOCK):
            entries, first = self._entries(data, offsets)
            out.append(np.diff(np.concatenate([[0], np.cumsum(self.table.length[entries])])[first]))
        return np.concatenate(out)


def give_back() -> None:
    """At the end of a task: memory that Arrow keeps for later goes back, as workers live on."""
    pa.default_memory_pool().release_unused()


@functools.lru_cache(maxsize=2)
def text_encoder(path: str, plain: bool = False) -> TextEncoder:
    """One per worker and file; workers are used again for later tasks."""
    return TextEncoder(path, plain=plain)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def default_pieces() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")
