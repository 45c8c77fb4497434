"""Token-id shards coded with a static range asymmetric numeral system (rANS).

A shard holds whole documents in order.  Its ids are cut into blocks of equal length; all blocks of
the shard share one frequency table and are coded independently.  A block interleaves ``LANES``
64-bit states over one stream of 32-bit words (token t belongs to lane t mod LANES), and every
``CHECKPOINT`` rounds it stores the decoder's states and its place in the stream, so that any
stretch between checkpoints can be decoded on its own.  Each block has a CRC-32 of its stored words
and one of its ids.  numpy steps all lanes of all blocks at once to encode, and all lanes of all
stretches at once to decode.

Bytes of a shard, little-endian: header; document ids (int64), their null flags (uint8) and token
counts (uint64); symbols (uint32) and frequencies (uint32), deflated; per block: crc32 of the ids,
crc32 of the words, number of words (uint32 each), word offsets of the checkpoints (uint32); states
at the checkpoints (uint64); the words of all blocks.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np

MAGIC = b"RANSIDS1"
PROB_BITS = 20
LOW = np.uint64(1 << 31)
LANES = 16
BLOCK = 16_384
CHECKPOINT = 256
_HEADER = struct.Struct("<8sQQQIIIII")  # magic, docs, ids, padded block length, blocks, lanes, checkpoint, symbols, table bytes
_WORD = np.uint64(32)


def shared_table(counts: np.ndarray) -> np.ndarray:
    """Frequencies of at least 1 that sum to 2**PROB_BITS, in proportion to positive counts.

    Needs no more than 2**PROB_BITS symbols.  The rounding remainder goes to the commonest symbol,
    the first of those on a tie.
    """
    total = 1 << PROB_BITS
    if len(counts) > total:
        raise ValueError(f"{len(counts)} symbols don't fit a table of {total} slots")
    share = counts.astype(np.float64) * ((total - len(counts)) / counts.sum())
    freq = np.floor(share).astype(np.int64) + 1
    freq[int(np.argmax(counts))] += total - int(freq.sum())
    return freq.astype(np.uint64)


@dataclass
class Shard:
    doc_ids: list[int | None]
    lengths: np.ndarray
    ids: np.ndarray

    def documents(self):
        """(doc_id, start in the shard, ids) of each document."""
        ends = np.cumsum(self.lengths)
        for doc_id, end, n in zip(self.doc_ids, ends.tolist(), self.lengths.tolist(), strict=True):
            yield doc_id, end - n, self.ids[end - n : end]


def _alphabet(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct ids in order, each id's place among them, and their counts."""
    if int(ids.max()) >= 1 << 22:
        return np.unique(ids, return_inverse=True, return_counts=True)
    counts = np.bincount(ids)
    symbols = np.flatnonzero(counts)
    place = np.zeros(len(counts), np.int32)
    place[symbols] = np.arange(len(symbols), dtype=np.int32)
    return symbols, place[ids], counts[symbols]


def encode(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    """A shard's bytes; ids holds the documents' unsigned 32-bit ids one after the other."""
    n = len(ids)
    if sum(lengths) != n or len(lengths) != len(doc_ids):
        raise ValueError("lengths don't match the ids")
    docs = np.array([d or 0 for d in doc_ids], "<i8").tobytes() + np.array([d is None for d in doc_ids], "u1").tobytes()
    docs += np.array(lengths, "<u8").tobytes()
    if not n:
        return _HEADER.pack(MAGIC, len(doc_ids), 0, 0, 0, LANES, CHECKPOINT, 0, 0) + docs
    symbols, index, counts = _alphabet(ids)
    freq = shared_table(counts)
    cum = np.cumsum(freq) - freq
    table = zlib.compress(symbols.astype("<u4").tobytes() + freq.astype("<u4").tobytes(), 1)
    blocks = -(-n // BLOCK)
    rounds = -(-(-(-n // blocks)) // LANES)
    padded = np.full(blocks * rounds * LANES, int(np.argmax(counts)), np.int32)
    padded[:n] = index
    grid = np.ascontiguousarray(padded.reshape(blocks, rounds, LANES).transpose(1, 0, 2))
    x = np.full((blocks, LANES), LOW, np.uint64)
    words = np.zeros((rounds, blocks, LANES), np.uint32)
    sent = np.zeros((rounds, blocks, LANES), bool)
    marks = range(0, rounds, CHECKPOINT)
    states = np.zeros((blocks, len(marks), LANES), np.uint64)
    limit_shift, bits = np.uint64(63 - PROB_BITS), np.uint64(PROB_BITS)
    for r in range(rounds - 1, -1, -1):
        s = grid[r]
        f = freq[s]
        full = x >= f << limit_shift
        words[r] = x & np.uint64(0xFFFFFFFF)
        sent[r] = full
        x = np.where(full, x >> _WORD, x)
        q = x // f
        x = (q << bits) + (x - q * f) + cum[s]
        if r % CHECKPOINT == 0:
            states[:, r // CHECKPOINT] = x
    per_round = sent.sum(2, dtype=np.uint32)
    before = (np.cumsum(per_round, 0, dtype=np.uint32) - per_round)[list(marks)].T
    words, sent = np.ascontiguousarray(words.transpose(1, 0, 2)), np.ascontiguousarray(sent.transpose(1, 0, 2))
    streams = [words[b][sent[b]].astype("<u4").tobytes() for b in range(blocks)]
    raw = [ids[b * rounds * LANES : (b + 1) * rounds * LANES].astype("<u4").tobytes() for b in range(blocks)]
    meta = np.array([[zlib.crc32(i), zlib.crc32(w), len(w) // 4] for i, w in zip(raw, streams, strict=True)], "<u4")
    head = _HEADER.pack(MAGIC, len(doc_ids), n, rounds * LANES, blocks, LANES, CHECKPOINT, len(symbols), len(table))
    return b"".join(
        [head, docs, table, meta.tobytes(), before.astype("<u4").tobytes(), states.astype("<u8").tobytes(), *streams]
    )


def decode(data: bytes) -> Shard:
    """Read a shard back, all stretches between checkpoints in parallel; raises ValueError on damage."""
    magic, n_docs, n, length, blocks, lanes, step, n_symbols, table_bytes = _HEADER.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a token-id shard")
    at = _HEADER.size

    def take(dtype: str, count: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(data, dtype, count, at)
        at += out.nbytes
        return out

    doc_ids, nulls, lengths = take("<i8", n_docs), take("u1", n_docs), take("<u8", n_docs).astype(np.int64)
    names = [None if z else d for d, z in zip(doc_ids.tolist(), nulls.tolist(), strict=True)]
    if not n:
        return Shard(names, lengths, np.zeros(0, np.uint32))
    table = zlib.decompress(data[at : at + table_bytes])
    at += table_bytes
    symbols = np.frombuffer(table, "<u4", n_symbols)
    freq = np.frombuffer(table, "<u4", n_symbols, 4 * n_symbols).astype(np.uint64)
    cum = np.cumsum(freq) - freq
    slots = np.repeat(np.arange(n_symbols, dtype=np.uint32), freq.astype(np.int64))
    rounds = length // lanes
    marks = -(-rounds // step)
    meta = take("<u4", 3 * blocks).reshape(blocks, 3)
    before = take("<u4", blocks * marks).reshape(blocks, marks).astype(np.int64)
    states = take("<u8", blocks * marks * lanes).reshape(blocks, marks, lanes)
    first = np.cumsum(meta[:, 2], dtype=np.int64) - meta[:, 2]
    words = take("<u4", int(meta[:, 2].sum(dtype=np.int64)))
    for b in range(blocks):
        if zlib.crc32(words[first[b] : first[b] + meta[b, 2]].tobytes()) != meta[b, 1]:
            raise ValueError(f"block {b}: its words are damaged")
    out = np.empty((rounds, blocks, lanes), np.uint32)
    # Stretches in order of their checkpoint: those of the last one may be shorter and so come last.
    x = np.ascontiguousarray(states.transpose(1, 0, 2)).reshape(marks * blocks, lanes).astype(np.uint64)
    pos = (before + first[:, None]).T.reshape(-1).copy()
    low_bits, bits = np.uint64((1 << PROB_BITS) - 1), np.uint64(PROB_BITS)
    words = np.append(words, np.uint32(0)).astype(np.uint64)
    stretch = out.reshape(rounds, blocks * lanes)
    short = rounds - (marks - 1) * step
    for r in range(min(step, rounds)):
        live = marks if r < short else marks - 1
        if live * blocks < len(x):
            x, pos = x[: live * blocks], pos[: live * blocks]
        slot = x & low_bits
        s = slots[slot.astype(np.int64)]
        stretch[r::step][:live] = s.reshape(live, blocks * lanes)
        x = freq[s] * (x >> bits) + slot - cum[s]
        empty = x < LOW
        used = np.cumsum(empty, 1)
        where = np.minimum(pos[:, None] + used - 1, len(words) - 1)
        x = np.where(empty, x << _WORD | words[where], x)
        pos = pos + used[:, -1]
    index = out.transpose(1, 0, 2).reshape(blocks, length)
    ids = symbols[index.reshape(-1)][:n]
    for b in range(blocks):
        if zlib.crc32(ids[b * length : (b + 1) * length].tobytes()) != meta[b, 0]:
            raise ValueError(f"block {b}: its ids are damaged")
    return Shard(names, lengths, ids)
