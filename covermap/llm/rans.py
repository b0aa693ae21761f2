"""Static range asymmetric numeral system over interleaved lanes.

Token t of a block belongs to lane t % lanes; all lanes share one frequency table and one stream of 24-bit words. The
encoder walks backwards and the decoder forwards, a row of lanes at a time. At every checkpoint the states of
all lanes and the place in the stream are kept with a checksum of the segment's ids, so that segments can be
decoded independently.

States lie between 2**28 and 2**52 and so are whole numbers that a double holds exactly. Quotients are exact too:
x / f is at least 1 / f away from the next whole number unless it is one, which is more than rounding moves it.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np

PRECISION = 20
LANES = 2048
#: Tokens between two checkpoints; a multiple of the lanes.
SEGMENT_TOKENS = 1 << 18

_LOW = 2.0**28
_WORD = 2.0**24
_SCALE = 2.0**PRECISION
_ROOM = 2.0 ** (28 - PRECISION + 24)


def scaled_frequencies(counts: np.ndarray) -> np.ndarray:
    """Frequencies that sum to 2**PRECISION, at least 1 for each id that occurs."""
    total, present = int(counts.sum()), np.flatnonzero(counts)
    scaled = np.zeros(len(counts), dtype=np.int64)
    if not len(present):
        return scaled
    if len(present) > 1 << PRECISION:
        raise ValueError("more ids than the precision can tell apart")
    scaled[present] = np.maximum(1, (counts[present].astype(float) * ((1 << PRECISION) / total)).astype(np.int64))
    excess = int(scaled.sum()) - (1 << PRECISION)
    for symbol in present[np.argsort(-scaled[present], kind="stable")]:
        if excess == 0:
            break
        change = min(excess, int(scaled[symbol]) - 1) if excess > 0 else excess
        scaled[symbol] -= change
        excess -= change
    return scaled


def _packed(words: np.ndarray) -> bytes:
    return np.ascontiguousarray(words.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3]).tobytes()


def _unpacked(stream: bytes, first: int, end: int | None) -> np.ndarray:
    part = np.frombuffer(stream, dtype=np.uint8)[3 * first : None if end is None else 3 * end].reshape(-1, 3)
    words = np.zeros((len(part), 4), dtype=np.uint8)
    words[:, :3] = part
    return words.view("<u4").ravel().astype(np.float64)


@dataclass
class Block:
    n_tokens: int
    lanes: int
    words: bytes  # the stream, 24-bit little-endian
    states: list[bytes]  # at the start of each segment, 64-bit little-endian for each lane
    offsets: list[int]  # where in the stream each segment begins, in words
    checksums: list[int]  # crc32 of each segment's ids as 32-bit little-endian


class Coder:
    """Encodes and decodes blocks with one shared table of frequencies."""

    def __init__(self, frequencies: np.ndarray):
        self.frequencies = frequencies.astype(np.float64)
        self.starts = np.concatenate([[0], np.cumsum(frequencies)[:-1]]).astype(np.float64)
        self._symbols: np.ndarray | None = None

    @property
    def symbols(self) -> np.ndarray:
        """The id that each slot of the table belongs to."""
        if self._symbols is None:
            self._symbols = np.repeat(np.arange(len(self.frequencies), dtype=np.int32), self.frequencies.astype(np.int64))
        return self._symbols

    def encode(self, ids: np.ndarray, lanes: int = LANES, segment: int = SEGMENT_TOKENS) -> Block:
        steps = -(-len(ids) // lanes)
        state = np.full(lanes, _LOW)
        frequency, start = self.frequencies[ids], self.starts[ids]
        pieces: list[np.ndarray] = [np.empty(0, np.uint32)] * steps
        states = []
        for step in range(steps - 1, -1, -1):
            f, c = frequency[step * lanes : (step + 1) * lanes], start[step * lanes : (step + 1) * lanes]
            x = state[: len(f)]
            full = np.flatnonzero(x >= f * _ROOM)
            if len(full):
                over = x[full]
                high = np.floor(over / _WORD)
                pieces[step] = (over - high * _WORD).astype(np.uint32)
                x[full] = high
            quotient = np.floor(x / f)
            state[: len(f)] = quotient * (_SCALE - f) + x + c
            if step * lanes % segment == 0:
                states.append(state.astype("<u8").tobytes())
        sums = np.concatenate([[0], np.cumsum([len(piece) for piece in pieces])]).astype(np.int64)
        raw = ids.astype("<u4")
        return Block(
            len(ids), lanes, _packed(np.concatenate(pieces)) if steps else b"", states[::-1],
            [int(sums[first // lanes]) for first in range(0, len(ids), segment)],
            [zlib.crc32(raw[first : first + segment].tobytes()) for first in range(0, len(ids), segment)])

    def decode_segment(self, block: Block, number: int, segment: int = SEGMENT_TOKENS) -> np.ndarray:
        """The ids of one segment, from its checkpoint alone."""
        first = number * segment
        count = min(segment, block.n_tokens - first)
        end = block.offsets[number + 1] if number + 1 < len(block.offsets) else None
        words = _unpacked(block.words, block.offsets[number], end)
        state = np.frombuffer(block.states[number], dtype="<u8").astype(np.float64)
        place, lanes, symbols = 0, block.lanes, self.symbols
        result = np.empty(count, dtype=np.uint32)
        for done in range(0, count, lanes):
            x = state[: min(lanes, count - done)]
            high = np.floor(x / _SCALE)
            slot = x - high * _SCALE
            symbol = symbols[slot.astype(np.int32)]
            x = self.frequencies[symbol] * high + slot - self.starts[symbol]
            low = np.flatnonzero(x < _LOW)
            x[low] = x[low] * _WORD + words[place : place + len(low)]
            place += len(low)
            state[: len(x)] = x
            result[done : done + len(x)] = symbol
        if zlib.crc32(result.astype("<u4").tobytes()) != block.checksums[number]:
            raise ValueError(f"checksum of segment {number} does not match")
        return result

    def decode(self, block: Block, segment: int = SEGMENT_TOKENS) -> np.ndarray:
        parts = [self.decode_segment(block, number, segment) for number in range(len(block.states))]
        return np.concatenate(parts) if parts else np.empty(0, np.uint32)
