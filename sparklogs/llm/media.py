"""Media columns: AVI motion-JPEG files as binary columns, written, parsed, decoded and cut into shots.

A frame is a gray baseline JPEG of 8 x 8 blocks. Each block is flat and holds one sample, so the quantised DC value is
exactly that sample and decoding loses nothing. Frames of a batch are coded and decoded together: the k-th symbol of
every frame is one vector step, whatever the number of documents; long documents are coded in runs of frames.

The decoder reads any baseline motion-JPEG: frames of any size, gray or colour with subsampled components, AC
coefficients, restart markers, and frames without Huffman tables of their own, as most cameras write them.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sparklogs.llm.common import buffers, expand, slices

SIDE = 8
BLOCKS = SIDE * SIDE
RATE = 25
#: Frames that are coded or decoded at once.
RUN = 1 << 14
#: DC categories 0 to 8 get these code lengths; the only AC code is "end of block", one bit.
_DC_LENGTHS = (4, 4, 4, 4, 4, 4, 3, 3, 2)


def _canonical(lengths: tuple[int, ...]) -> list[tuple[int, int]]:
    """(code, length) of each symbol by JPEG's rule: codes count up within a length, shorter lengths first."""
    code, out, last = 0, {}, 0
    for length, symbol in sorted((n, s) for s, n in enumerate(lengths)):
        code <<= length - last
        out[symbol], last = (code, length), length
        code += 1
    return [out[s] for s in range(len(lengths))]


_DC = _canonical(_DC_LENGTHS)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _header() -> bytes:
    by_length = sorted((n, s) for s, n in enumerate(_DC_LENGTHS))
    dc = bytes(sum(n == k for n, _ in by_length) for k in range(1, 17)) + bytes(s for _, s in by_length)
    ac = bytes([1] + [0] * 15) + b"\x00"
    return b"".join([
        b"\xff\xd8", _segment(0xDB, b"\x00" + bytes([8] * 64)), _segment(0xC0, struct.pack(">BHHB", 8, SIDE * 8, SIDE * 8, 1) + b"\x01\x11\x00"),
        _segment(0xC4, b"\x00" + dc), _segment(0xC4, b"\x10" + ac), _segment(0xDA, b"\x01\x01\x00\x00\x3f\x00"),
    ])


HEADER = _header()


def _place(target: np.ndarray, start: np.ndarray, data: np.ndarray, count: np.ndarray) -> None:
    target[expand(start, count)] = data


def encode_frames(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """JPEG bytes of all frames, one after another, and their lengths; ``samples`` is (frames, 64) of bytes."""
    frames = len(samples)
    step = np.diff(samples.astype(np.int32), axis=1, prepend=128)
    size = np.abs(step)
    kind = np.zeros(511, np.int64)
    kind[1:] = np.floor(np.log2(np.arange(1, 511))).astype(np.int64) + 1
    cat = np.minimum(kind[size], 8)
    code, length = (np.array([x[k] for x in _DC], np.int64) for k in (0, 1))
    extra = np.where(step < 0, step + (1 << cat) - 1, step)
    word = ((code[cat] << cat) | extra) << 1  # and the end-of-block bit, code 0
    bits = length[cat] + cat + 1
    used = bits.sum(axis=1)
    held = (used + 7) // 8
    at = np.concatenate([[0], np.cumsum(held)])
    where = (at[:-1, None] * 8 + np.cumsum(bits, axis=1) - bits).ravel()
    word, bits = word.ravel().astype(np.uint64), bits.ravel()
    flat = np.zeros(int(at[-1]) + 4, np.uint8)
    lifted = word << (np.uint64(32) - bits.astype(np.uint64) - (where & 7).astype(np.uint64))
    for k in range(4):  # codes do not overlap, so adding is the same as or-ing
        part = ((lifted >> np.uint64(24 - 8 * k)) & np.uint64(255)).astype(np.float64)
        flat += np.bincount((where >> 3) + k, part, len(flat)).astype(np.uint8)
    tail = (held * 8 - used).astype(np.int64)
    flat[at[1:] - 1] |= ((1 << tail) - 1).astype(np.uint8)
    flat = flat[: int(at[-1])]
    full = flat == 255
    stuffed = np.zeros(len(flat) + int(full.sum()), np.uint8)
    before = np.cumsum(full) - full
    stuffed[np.arange(len(flat)) + before] = flat
    grown = np.concatenate([[0], np.cumsum(full)])
    scan = held + grown[at[1:]] - grown[at[:-1]]
    total = scan + len(HEADER) + 2
    start = np.cumsum(total) - total
    out = np.empty(int(total.sum()), np.uint8)
    out[start[:, None] + np.arange(len(HEADER))] = np.frombuffer(HEADER, np.uint8)
    _place(out, start + len(HEADER), stuffed, scan)
    out[start + total - 2], out[start + total - 1] = 0xFF, 0xD9
    assert len(total) == frames
    return out, total


def _chunks(samples: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The video chunks of some frames, where each begins, and the length of its data."""
    data, length = encode_frames(samples)
    chunk = length + (length & 1) + 8
    start = np.cumsum(chunk) - chunk
    movie = np.zeros(int(chunk.sum()), np.uint8)
    movie[start[:, None] + np.arange(4)] = np.frombuffer(b"00dc", np.uint8)
    movie[start[:, None] + 4 + np.arange(4)] = length.astype("<u4").view(np.uint8).reshape(-1, 4)
    _place(movie, start + 8, data, length)
    return movie.tobytes(), start, length


def _file(movie: bytes, start: np.ndarray, length: np.ndarray) -> bytes:
    """An AVI file of chunks that begin at ``start``, with the index chunk ``idx1``."""
    n = len(start)
    index = np.zeros((n, 4), "<u4")
    index[:, 0], index[:, 1], index[:, 2], index[:, 3] = int.from_bytes(b"00dc", "little"), 16, start + 4, length
    main = struct.pack("<14I", 1_000_000 // RATE, 0, 0, 16, n, 0, 1, 0, SIDE * 8, SIDE * 8, 0, 0, 0, 0)
    stream = b"vidsMJPG" + struct.pack("<10I4H", 0, 0, 0, 1, RATE, 0, n, 0, 2**32 - 1, 0, 0, 0, SIDE * 8, SIDE * 8)
    form = struct.pack("<IiiHH4sIiiII", 40, SIDE * 8, SIDE * 8, 1, 24, b"MJPG", 0, 0, 0, 0, 0)
    box = lambda tag, body: tag + struct.pack("<I", len(body)) + body
    head = box(b"LIST", b"hdrl" + box(b"avih", main) + box(b"LIST", b"strl" + box(b"strh", stream) + box(b"strf", form)))
    size = 4 + len(head) + 12 + len(movie) + 8 + 16 * n
    if size >= 1 << 32:
        raise ValueError("an AVI file holds 4 GB, which is about 1 GB of text")
    return b"".join([b"RIFF", struct.pack("<I", size), b"AVI ", head, struct.pack("<4sI4s", b"LIST", len(movie) + 4, b"movi"), movie, b"idx1", struct.pack("<I", 16 * n), index.tobytes()])


def write_avi(samples: np.ndarray, count: np.ndarray) -> list[bytes]:
    """One AVI file for each document: ``count[i]`` frames of ``samples``, with the index chunk ``idx1``."""
    last = np.cumsum(count)
    if len(samples) > RUN and len(count) == 1:  # one long document
        runs = [_chunks(samples[at : at + RUN]) for at in range(0, len(samples), RUN)]
        base = np.cumsum([0, *(len(m) for m, _, _ in runs)])
        return [_file(b"".join(m for m, _, _ in runs), np.concatenate([b + s for b, (_, s, _) in zip(base, runs, strict=False)]), np.concatenate([n for _, _, n in runs]))]
    movie, start, length = _chunks(samples)
    bound = np.append(start, len(movie))
    files = []
    for n, end in zip(count.tolist(), last.tolist(), strict=True):
        lo, hi = int(bound[end - n]), int(bound[end])
        files.append(_file(movie[lo:hi], start[end - n : end] - lo, length[end - n : end]))
    return files


def _walk(file: bytes, at: int, end: int) -> Iterator[tuple[int, int]]:
    """Offset and length of each video chunk between two places, also inside lists."""
    while at + 8 <= end:
        tag, size = file[at : at + 4], struct.unpack_from("<I", file, at + 4)[0]
        if tag == b"LIST":
            yield from _walk(file, at + 12, min(at + 8 + size, end))
        elif tag[2:] == b"dc":
            yield at + 8, size
        at += 8 + size + (size & 1)


def read_index(file: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Offset and length of each video chunk, from ``idx1``; its offsets count from the ``movi`` tag or the file's start.

    A file without an index is read chunk by chunk.
    """
    if file[:4] != b"RIFF" or file[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    at, movie, index = 12, None, None
    while at + 8 <= len(file):
        tag, size = file[at : at + 4], struct.unpack_from("<I", file, at + 4)[0]
        if tag == b"LIST" and file[at + 8 : at + 12] == b"movi":
            movie = at + 8, at + 8 + size
        elif tag == b"idx1":
            index = np.frombuffer(file, "<u4", size // 16 * 4, at + 8).reshape(-1, 4)
        at += 8 + size + (size & 1)
    if movie is None:
        raise ValueError("no movi list")
    if index is None:
        found = np.array(list(_walk(file, movie[0] + 4, movie[1])), np.int64).reshape(-1, 2)
        return found[:, 0], found[:, 1]
    index = index[(index[:, 0] >> 16) == int.from_bytes(b"dc", "little")]
    offset = index[:, 2].astype(np.int64)
    base = movie[0] if not len(offset) or file[movie[0] + offset[0] : movie[0] + offset[0] + 4] == index[0, 0].tobytes() else 0
    return offset + base + 8, index[:, 3].astype(np.int64)


def frame_seconds(file: bytes) -> float:
    """Seconds a frame stands, from the main header."""
    at = file.find(b"avih", 12, 4096)
    micros = struct.unpack_from("<I", file, at + 8)[0] if at >= 0 else 0
    return micros / 1e6 if micros else 1 / RATE


_ZIGZAG = np.array(sorted(range(64), key=lambda k: (k // 8 + k % 8, k % 8 if (k // 8 + k % 8) % 2 else k // 8)))
#: What 8 coefficients of a row or column add to its 8 values.
_BASIS = np.array([[(0.5 if k else 0.5 / np.sqrt(2)) * np.cos((2 * x + 1) * k * np.pi / 16) for x in range(8)] for k in range(8)])
# Huffman tables of frames that bring none (number of codes of each length, then the symbols). All other AC
# symbols follow the listed ones in ascending order.
_COMMON = {
    (0, 0): ("00 01 05 01 01 01 01 01 01 00 00 00 00 00 00 00", "00 01 02 03 04 05 06 07 08 09 0a 0b"),
    (0, 1): ("00 03 01 01 01 01 01 01 01 01 01 00 00 00 00 00", "00 01 02 03 04 05 06 07 08 09 0a 0b"),
    (1, 0): ("00 02 01 03 03 02 04 03 05 05 04 04 00 00 01 7d", "01 02 03 00 04 11 05 12 21 31 41 06 13 51 61 07 22 71 14 32 81 91 a1 08 23 42 b1 c1 15 52 d1 f0 24 33 62 72 82"),
    (1, 1): ("00 02 01 02 04 04 03 04 07 05 04 04 00 01 02 77", "00 01 02 03 11 04 05 21 31 06 12 41 51 07 61 71 13 22 32 81 08 14 42 91 a1 b1 c1 09 23 33 52 f0 15 62 72 d1 0a 16 24 34 e1 25 f1"),
}


def _lookup(counts: bytes, symbols: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Code length and symbol for every 16 bits; length 0 where no code begins so."""
    length, value = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
    code, k = 0, 0
    for n in range(1, 17):
        for _ in range(counts[n - 1]):
            span = slice(code << (16 - n), (code + 1) << (16 - n))
            length[span], value[span] = n, symbols[k]
            code, k = code + 1, k + 1
        code <<= 1
    return length, value


@functools.cache
def _common_tables() -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
    out = {}
    for key, (counts, symbols) in _COMMON.items():
        own = bytes.fromhex(symbols)
        if key[0]:
            own += bytes(r << 4 | n for r in range(16) for n in range(1, 11) if (r << 4 | n) not in own)
        out[key] = _lookup(bytes.fromhex(counts), own)
    return out


class Header:
    """What a baseline frame says before its data: size, components, quantisers, Huffman tables and restart interval."""

    def __init__(self, frame: bytes):
        at, self.restart, self.quant, self.tables, self.size = 2, 0, {}, dict(_common_tables()), None
        if frame[:2] != b"\xff\xd8":
            raise ValueError("not a JPEG frame")
        while True:
            if frame[at] != 0xFF or at + 4 > len(frame):
                raise ValueError("no marker where one is due")
            marker, size = frame[at + 1], struct.unpack_from(">H", frame, at + 2)[0]
            body = frame[at + 4 : at + 2 + size]
            if marker == 0xDB:
                while body:
                    wide = body[0] >> 4
                    self.quant[body[0] & 15] = np.frombuffer(body, ">u2" if wide else np.uint8, 64, 1).astype(np.int64)
                    body = body[65 + 64 * wide :]
            elif marker == 0xC4:
                while body:
                    n = sum(body[1:17])
                    self.tables[body[0] >> 4, body[0] & 15] = _lookup(body[1:17], body[17 : 17 + n])
                    body = body[17 + n :]
            elif marker in (0xC0, 0xC1):
                if body[0] != 8:
                    raise ValueError("not eight bits a sample")
                self.size = struct.unpack_from(">HH", body, 1)
                self.parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])]
            elif 0xC2 <= marker <= 0xCF and marker != 0xC8 and marker != 0xCC:
                raise ValueError("not a baseline frame")
            elif marker == 0xDD:
                self.restart = struct.unpack(">H", body)[0]
            at += 2 + size
            if marker == 0xDA:
                break
        if self.size is None or body[0] != len(self.parts):
            raise ValueError("not one scan of all components")
        self.length = at
        self.codes = {body[1 + 2 * i]: (body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])}
        single = len(self.parts) == 1
        across, down = (1, 1) if single else (max(p[1] for p in self.parts), max(p[2] for p in self.parts))
        self.mcus = -(-self.size[0] // (8 * down)), -(-self.size[1] // (8 * across))
        #: For each component: blocks down and across in an MCU, quantiser, DC and AC table.
        self.components = [(1 if single else v, 1 if single else h, self.quant[q], self.tables[0, self.codes[i][0]], self.tables[1, self.codes[i][1]]) for i, h, v, q in self.parts]


def _clean(data: np.ndarray, start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """The coded bytes of all frames without stuffing and markers, where each frame's begin, and those of its restarts."""
    scan = data[expand(start, count)]
    after = np.zeros(len(scan), bool)
    after[1:] = scan[:-1] == 255
    after[np.cumsum(count)[:-1]] = False
    mark = after & (scan >= 0xD0) & (scan <= 0xD7)
    drop = (after & (scan == 0)) | mark
    drop[:-1] |= mark[1:]
    kept = np.concatenate([[0], np.cumsum(~drop)])
    ends = np.cumsum(count)
    where, owner = kept[np.flatnonzero(mark)], np.searchsorted(ends, np.flatnonzero(mark), "right")
    cut = np.searchsorted(owner, np.arange(len(count) + 1))
    return scan[~drop], kept[ends - count], [where[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]


def _decode(data: np.ndarray, start: np.ndarray, length: np.ndarray, head: Header) -> tuple[list[np.ndarray], list[tuple[np.ndarray, ...]]]:
    """Quantised DC values (frames, blocks) of each component, in MCU order, and all other values that are not zero as
    (component, frame, block, place, value). All frames have one header; a symbol of every frame is one step."""
    scan, first, restarts = _clean(data, start + head.length, length - head.length)
    scan = np.concatenate([scan, np.zeros(8, np.uint8)])
    wide = scan[:-7].astype(np.uint64)
    for k in range(1, 5):
        wide = (wide << np.uint64(8)) | scan[k : len(scan) - 7 + k]
    at, frames = first * 8, np.arange(len(start))
    top = (len(wide) - 1) * 8

    def symbol(own: np.ndarray, table: tuple[np.ndarray, np.ndarray], mask: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The next symbol of some frames, the value after it, and how many values it skips."""
        here = at[own]
        bits = (wide[np.minimum(here, top) >> 3] << (here & 7).astype(np.uint64)) & np.uint64((1 << 40) - 1)
        code = (bits >> np.uint64(24)).astype(np.int64)
        n, s = table[0][code], table[1][code]
        cat = s & mask
        raw = (bits >> (40 - n - cat).astype(np.uint64)).astype(np.int64) & ((1 << cat) - 1)
        at[own] = here + n + cat
        return s, np.where((cat > 0) & (raw < (1 << np.maximum(cat - 1, 0))), raw - (1 << cat) + 1, raw), s >> 4

    mcus = head.mcus[0] * head.mcus[1]
    out = [np.empty((len(start), mcus * down * across), np.int32) for down, across, *_ in head.components]
    rest: list[tuple[np.ndarray, ...]] = []
    level = [np.zeros(len(start), np.int64) for _ in head.components]
    for mcu in range(mcus):
        if head.restart and mcu and mcu % head.restart == 0:
            nth = mcu // head.restart - 1
            if any(len(r) <= nth for r in restarts):
                raise ValueError("a restart marker is missing")
            at[:] = np.array([r[nth] for r in restarts]) * 8
            level = [np.zeros(len(start), np.int64) for _ in head.components]
        for c, (down, across, _, dc, ac) in enumerate(head.components):
            for block in range(mcu * down * across, (mcu + 1) * down * across):
                level[c] = level[c] + symbol(frames, dc, 15)[1]
                out[c][:, block] = level[c]
                own, place = frames, np.zeros(len(start), np.int64)
                while len(own):
                    s, value, skip = symbol(own, ac, 15)
                    go = s != 0
                    if not go.any():
                        break
                    own, place, value, full = own[go], place[go] + skip[go] + 1, value[go], s[go] == 0xF0
                    if (place > 63).any():
                        raise ValueError("more than 64 values in a block")
                    if not full.all():
                        rest.append((np.full((~full).sum(), c), own[~full], np.full((~full).sum(), block), place[~full], value[~full]))
                    own, place = own[place < 63], place[place < 63]
    return out, rest


def _runs(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> Iterator[tuple[np.ndarray, Header]]:
    """Numbers of frames with one header, ``RUN`` at most."""
    left = np.arange(len(start))
    while len(left):
        part = left[:RUN]
        head = Header(data[start[part[0]] : start[part[0]] + length[part[0]]].tobytes())
        own = data[start[part[0]] : start[part[0]] + head.length]
        long = length[part] >= head.length
        same = np.zeros(len(part), bool)
        same[long] = (data[start[part[long]][:, None] + np.arange(head.length)] == own).all(axis=1)
        yield part[same], head
        left = np.concatenate([part[~same], left[RUN:]])


def decode_frames(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """(frames, blocks) samples: the mean of each block of the first component, which AC values do not change."""
    out = None
    for own, head in _runs(data, start, length):
        values = _decode(data, start[own], length[own], head)[0][0]
        mean = np.clip(values * int(head.components[0][2][0]) // 8 + 128, 0, 255).astype(np.uint8)
        if out is None:
            out = np.empty((len(start), mean.shape[1]), np.uint8)
        if mean.shape[1] != out.shape[1]:
            raise ValueError("frames of different sizes")
        out[own] = mean
    return np.zeros((0, BLOCKS), np.uint8) if out is None else out


def decode_planes(frame: bytes) -> list[np.ndarray]:
    """The samples of each component of a frame, at the component's own resolution."""
    data = np.frombuffer(frame, np.uint8)
    head = Header(frame)
    dc, rest = _decode(data, np.zeros(1, np.int64), np.array([len(frame)]), head)
    planes = []
    for c, (down, across, quant, *_) in enumerate(head.components):
        values = np.zeros((dc[c].shape[1], 64))
        values[:, 0] = dc[c][0]
        for part, _, block, place, value in rest:
            values[block[part == c], place[part == c]] = value[part == c]
        square = np.zeros_like(values)
        square[:, _ZIGZAG] = values * quant
        pixels = np.einsum("nuv,uy,vx->nyx", square.reshape(-1, 8, 8), _BASIS, _BASIS) + 128
        rows, columns = head.mcus
        grid = pixels.reshape(rows, columns, down, across, 8, 8).transpose(0, 2, 4, 1, 3, 5).reshape(rows * down * 8, columns * across * 8)
        most_down, most_across = (1, 1) if len(head.parts) == 1 else (max(p[2] for p in head.parts), max(p[1] for p in head.parts))
        height, width = -(-head.size[0] * down // most_down), -(-head.size[1] * across // most_across)
        planes.append(np.clip(np.rint(grid[:height, :width]), 0, 255).astype(np.uint8))
    return planes


def shots(samples: np.ndarray, count: np.ndarray, bins: int = 16, near: int = 8, factor: float = 2.0) -> list[np.ndarray]:
    """First frames of the shots of each document.

    A cut lies where the difference of two frames' histograms exceeds ``factor`` times the mean difference over ``near``
    frames to either side, so the threshold follows the local activity; ties and the first frame never cut.
    """
    frames = len(samples)
    own = np.repeat(np.arange(frames) * bins, samples.shape[1]) + (samples.ravel() * bins >> 8 if samples.dtype != np.uint8 else samples.ravel() // (256 // bins))
    hist = np.bincount(own, minlength=frames * bins).reshape(frames, bins)
    diff = np.zeros(frames, np.int64)
    diff[1:] = np.abs(hist[1:] - hist[:-1]).sum(axis=1)
    last = np.cumsum(count)
    first = last - count
    diff[first[count > 0]] = 0
    total = np.concatenate([[0], np.cumsum(diff)])
    lo = np.maximum(np.arange(frames) - near, np.repeat(first, count) + 1)
    hi = np.minimum(np.arange(frames) + near + 1, np.repeat(last, count))
    around = total[hi] - total[np.minimum(lo, hi)] - diff
    others = np.maximum(hi - lo - 1, 1)
    cut = np.flatnonzero((diff > 0) & (diff * others > factor * around))
    split = np.searchsorted(cut, first), np.searchsorted(cut, last)
    return [np.concatenate([[0], cut[a:b] - f]) if n else np.zeros(0, np.int64) for a, b, f, n in zip(*split, first, count, strict=True)]


def _payloads(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Samples (frames, 64) and the number of frames of each text, zero bytes filling the last frame."""
    size = np.diff(at)
    count = np.maximum(1, -(-size // BLOCKS))
    flat = np.zeros(int(count.sum()) * BLOCKS, np.uint8)
    flat[expand((np.cumsum(count) - count) * BLOCKS, size)] = raw
    return flat.reshape(-1, BLOCKS), count


def texts_as_video(texts: pa.Array) -> list[bytes]:
    """Each text's UTF-8 bytes, padded with zero bytes to a positive multiple of 64, as a motion-JPEG AVI file."""
    return write_avi(*_payloads(*buffers(texts)))


def decode_videos(files: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Samples of all frames of some AVI files, of one size, and the number of frames of each."""
    data = np.frombuffer(b"".join(files), np.uint8)
    base = np.cumsum([0, *map(len, files[:-1])])
    found = [read_index(f) for f in files]
    start = np.concatenate([b + s for b, (s, _) in zip(base, found, strict=True)]) if found else np.zeros(0, np.int64)
    length = np.concatenate([n for _, n in found]) if found else np.zeros(0, np.int64)
    return decode_frames(data, start, length), np.array([len(s) for s, _ in found], np.int64)


def decoded(files: list[bytes]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """(numbers of files, samples, frames of each): all at once where their frames are alike, else one by one.

    Files that are no baseline motion-JPEG AVI are left out.
    """
    try:
        yield list(range(len(files))), *decode_videos(files)
    except (ValueError, IndexError, KeyError, struct.error):
        for i, file in enumerate(files):
            try:
                found = decode_videos([file])
            except (ValueError, IndexError, KeyError, struct.error):
                continue
            yield [i], *found


def media_table(docs: DataFrame) -> DataFrame:
    """``docs`` with a binary column ``media``, the AVI file of each text (null counts as empty); other columns go on."""
    schema = docs.select(*[c for c in docs.columns if c != "media"]).schema.add("media", "binary")
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit=1 << 20):
                files = pa.array(texts_as_video(part.column("text")), pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(c) if c != "media" else files for c in names], names)

    return docs.select(*[c for c in docs.columns if c != "media"]).mapInArrow(run, schema)


def media_clips(media: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per shot: key, clip, first_frame, frames, start_s, end_s, mean sample; null media gives no rows, and so does
    a file that is no baseline motion-JPEG AVI."""
    kind = media.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, clip int, first_frame int, frames int, start_s double, end_s double, mean double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "media", 8 << 20):
                part = part.filter(part.column("media").is_valid())
                keys, files, rows = part.column(key).to_pylist(), part.column("media").to_pylist(), []
                for own, samples, count in decoded(files):
                    base = 0
                    for i, n, cuts in zip(own, count.tolist(), shots(samples, count), strict=True):
                        tick = frame_seconds(files[i])
                        for c, (a, b) in enumerate(zip(cuts.tolist(), [*cuts[1:].tolist(), n], strict=False)):
                            rows.append((keys[i], c, a, b - a, a * tick, b * tick, float(samples[base + a : base + b].mean())))
                        base += n
                if rows:
                    names = [x.split()[0] for x in schema.split(", ")]
                    kinds = [part.schema.field(key).type, *[pa.int32()] * 3, *[pa.float64()] * 3]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return media.select(key, "media").mapInArrow(run, schema)


def media_digests(docs: DataFrame) -> DataFrame:
    """Store each text as video, read the stored bytes back and describe them; one row per document, see ``op3``.

    The feature lists the frames, the shots and their first frames. Null text is empty and makes one frame of zeros;
    repeated rows give equal rows; extra columns are ignored; an empty table gives no rows.
    """
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit=1 << 20):
                raw, at = buffers(part.column("text"))
                files = write_avi(*_payloads(raw, at))
                samples, count = decode_videos(files)
                back, end = memoryview(samples.reshape(-1)), np.cumsum(count) * BLOCKS
                own = [back[b - n * BLOCKS : b] for b, n in zip(end.tolist(), count.tolist(), strict=True)]
                features = [f"frames={n};shots={len(c)};starts={','.join(map(str, c.tolist()))}" for n, c in zip(count.tolist(), shots(samples, count), strict=True)]
                columns = [
                    part.column("doc_id"), pa.array(np.diff(at)), pa.array([len(x) for x in own], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in own]),
                    pa.array([zlib.crc32(x[-64:]) for x in own], pa.int64()), pa.array([len(x) for x in files], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in files]), pa.array(features),
                ]
                yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)
