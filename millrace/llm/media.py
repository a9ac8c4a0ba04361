"""Media columns as Matroska (operator 2).

``mux`` stores a payload losslessly as unsigned 8-bit PCM in a Matroska file: EBML header, Info, Tracks,
Clusters of laced SimpleBlocks and Cues. ``packets`` parses any such file - variable-length element ids and
sizes, clusters, all four lacings, cues - into a packet table (track, timestamp, key frame, byte range), and
``demux`` reads the payload back through those byte ranges.

Times. A block's time is its cluster's and its own, in units of the file's TimestampScale. The frames of a lace
follow each other by the track's DefaultDuration, or by equal shares of the block's duration; where a file
states neither, the time of all frames but the first is unknown (null).

Semantics of the query. The payload is the text in UTF-8 (null: empty) and bytes 255 up to a positive
multiple of ``UNIT``. Equal texts give equal values, whatever their rows, so ties and repeated rows give equal
rows; a very long text is a longer file, never cut. Other columns, whatever their names, are ignored. An empty
table gives no rows. A damaged file gives the packets before the damage and one row with its ``error``.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import map_texts, ship, small_batches, table

UNIT = 576
#: Frames of a laced block, and blocks of a cluster.
LACE, BLOCKS = 8, 16
#: Samples a second: one frame of UNIT samples lasts TICK milliseconds.
RATE, TICK = 8000, 72

# Fixed values of the Matroska format: element ids.
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
EBML_VERSION, EBML_READ, EBML_MAX_ID, EBML_MAX_SIZE, DOC_TYPE, DOC_VERSION, DOC_READ = 0x4286, 0x42F7, 0x42F2, 0x42F3, 0x4282, 0x4287, 0x4285
TIMESTAMP_SCALE, DURATION, MUX_APP, WRITE_APP = 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID, AUDIO, RATE_HZ, CHANNELS, BIT_DEPTH = 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0xE1, 0xB5, 0x9F, 0x6264
DEFAULT_DURATION = 0x23E383
TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, BLOCK_DURATION, REFERENCE_BLOCK = 0xE7, 0xA3, 0xA0, 0xA1, 0x9B, 0xFB
SEEK_HEAD, CHAPTERS, TAGS, ATTACHMENTS = 0x114D9B74, 0x1043A770, 0x1254C367, 0x1941A469
CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
TOP = {CLUSTER, CUES, INFO, TRACKS, SEEK_HEAD, CHAPTERS, TAGS, ATTACHMENTS}
MASTERS = {EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES, TRACK_ENTRY, AUDIO, CUE_POINT, CUE_POSITIONS}


def vint(n: int, width: int = 0) -> bytes:
    """An element size; the all-ones value of a width means unknown and isn't used."""
    w = width or next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return (n | 1 << 7 * w).to_bytes(w, "big")


def element(ident: int, body: bytes) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + vint(len(body)) + body


def uint(ident: int, n: int) -> bytes:
    return element(ident, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def read_id(data: bytes, at: int) -> tuple[int, int]:
    width = 9 - data[at].bit_length()
    if width > 4 or at + width > len(data):
        raise ValueError(f"no element id at byte {at}")
    return int.from_bytes(data[at : at + width], "big"), at + width


def read_vint(data: bytes, at: int) -> tuple[int | None, int, int]:
    """Value (None: unknown size), the place after it, its width."""
    width = 9 - data[at].bit_length()
    if width > 8 or at + width > len(data):
        raise ValueError(f"no variable-length integer at byte {at}")
    n = int.from_bytes(data[at : at + width], "big") - (1 << 7 * width)
    return None if n == (1 << 7 * width) - 1 else n, at + width, width


def block(track: int, offset: int, frames: list[bytes], lacing: int = 2) -> bytes:
    """A SimpleBlock's body. lacing: 0 none, 1 Xiph, 2 fixed size, 3 EBML."""
    lacing = lacing if len(frames) > 1 else 0
    out = [vint(track), struct.pack(">hB", offset, 0x80 | lacing << 1)]
    if lacing:
        out.append(bytes([len(frames) - 1]))
    if lacing == 1:
        out += [b"\xff" * (len(f) // 255) + bytes([len(f) % 255]) for f in frames[:-1]]
    if lacing == 3:
        out.append(vint(len(frames[0])))
        for a, b in zip(frames, frames[1:-1], strict=False):
            d = len(b) - len(a)
            w = next(w for w in range(1, 9) if abs(d) < (1 << 7 * w - 1) - 1)
            out.append(vint(d + (1 << 7 * w - 1) - 1, w))
    return b"".join(out + frames)


def mux(payload: bytes, unit: int = UNIT, lacing: int = 2) -> bytes:
    n = len(payload) // unit
    head = element(EBML, uint(EBML_VERSION, 1) + uint(EBML_READ, 1) + uint(EBML_MAX_ID, 4) + uint(EBML_MAX_SIZE, 8) + element(DOC_TYPE, b"matroska") + uint(DOC_VERSION, 4) + uint(DOC_READ, 2))
    info = element(INFO, uint(TIMESTAMP_SCALE, 1_000_000) + element(DURATION, struct.pack(">d", n * TICK)) + element(MUX_APP, b"millrace") + element(WRITE_APP, b"millrace"))
    audio = element(AUDIO, element(RATE_HZ, struct.pack(">d", RATE)) + uint(CHANNELS, 1) + uint(BIT_DEPTH, 8))
    tracks = element(TRACKS, element(TRACK_ENTRY, uint(TRACK_NUMBER, 1) + uint(TRACK_UID, 1) + uint(TRACK_TYPE, 2) + uint(DEFAULT_DURATION, TICK * 1_000_000) + element(CODEC_ID, b"A_PCM/INT/LIT") + audio))
    body, at, cues = [info, tracks], len(info) + len(tracks), []
    for first in range(0, n, LACE * BLOCKS):
        parts = [uint(TIMESTAMP, first * TICK)]
        for k in range(first, min(n, first + LACE * BLOCKS), LACE):
            frames = [payload[i * unit : (i + 1) * unit] for i in range(k, min(n, k + LACE))]
            parts.append(element(SIMPLE_BLOCK, block(1, (k - first) * TICK, frames, lacing)))
        cues.append(element(CUE_POINT, uint(CUE_TIME, first * TICK) + element(CUE_POSITIONS, uint(CUE_TRACK, 1) + uint(CUE_CLUSTER, at))))
        body.append(cluster := element(CLUSTER, b"".join(parts)))
        at += len(cluster)
    return head + element(SEGMENT, b"".join([*body, element(CUES, b"".join(cues))]))


def laced(data: bytes, at: int, end: int, lacing: int) -> list[tuple[int, int]]:
    """Byte ranges (start, end) of a block's frames."""
    if not lacing:
        return [(at, end)]
    n, at = data[at] + 1, at + 1
    sizes: list[int] = []
    if lacing == 1:
        for _ in range(n - 1):
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            sizes.append(size + data[at])
            at += 1
    elif lacing == 3 and n > 1:
        size, at, _ = read_vint(data, at)
        sizes.append(size)
        for _ in range(n - 2):
            d, at, w = read_vint(data, at)
            sizes.append(sizes[-1] + (d if d is not None else (1 << 7 * w) - 1) - ((1 << 7 * w - 1) - 1))
    elif lacing == 2:
        if (end - at) % n:
            raise ValueError("a fixed-size lace doesn't divide")
        sizes = [(end - at) // n] * (n - 1)
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("a lace is longer than its block")
    out = []
    for s in sizes:
        out.append((at, at + s))
        at += s
    return out


class Damaged(ValueError):
    """What can't be read of a file; the container has the packets before it."""


class Container:
    """What a Matroska file holds.

    packets: rows (track, time in ms, key, start, end, time in ns), times None where unknown; tracks: number to codec;
    cues: rows (time, track, cluster's place). With ``whole`` false, damage ends the reading and is kept in ``error``.
    """

    def __init__(self, data: bytes, whole: bool = True):
        self.data, self.packets, self.tracks, self.cues = data, [], {}, []
        self.clusters: list[int] = []
        self.segment = self.time = self.cue_time = self.cue_track = self.track = 0
        self.scale, self.durations, self.error = 1_000_000, {}, None
        try:
            self._walk(0, len(data), 0)
        except (IndexError, struct.error, RecursionError, ValueError) as e:
            self.error = str(e) if isinstance(e, ValueError) else "the file ends inside an element"
            if whole:
                raise Damaged(self.error) from e

    def _frames(self, at: int, stop: int, key: bool | None, duration: int | None) -> None:
        """The packets of one block; ``key`` None: a SimpleBlock, whose flags tell."""
        track, p, _ = read_vint(self.data, at)
        offset, flags = struct.unpack_from(">hB", self.data, p)
        frames = laced(self.data, p + 3, stop, flags >> 1 & 3)
        begin = (self.time + offset) * self.scale
        each = self.durations.get(track) or (duration * self.scale // len(frames) if duration is not None else None)
        for k, (a, b) in enumerate(frames):
            ns = begin if k == 0 else None if each is None else begin + k * each
            self.packets.append((track, None if ns is None else ns // 1_000_000, bool(flags & 0x80) if key is None else key, a, b, ns))

    def _group(self, at: int, stop: int) -> None:
        """A BlockGroup: its block is a key frame if it refers to no other."""
        found, refers, duration = None, False, None
        while at < stop:
            ident, at = read_id(self.data, at)
            size, at, _ = read_vint(self.data, at)
            if size is None or at + size > stop:
                raise ValueError(f"element {ident:x} runs over its parent's end")
            if ident == BLOCK:
                found = at, at + size
            elif ident == REFERENCE_BLOCK:
                refers = True
            elif ident == BLOCK_DURATION:
                duration = int.from_bytes(self.data[at : at + size], "big")
            at += size
        if found:
            self._frames(*found, not refers, duration)

    def _walk(self, at: int, end: int, parent: int, open_end: bool = False) -> int:
        data = self.data
        while at < end:
            begin = at
            ident, at = read_id(data, at)
            size, at, _ = read_vint(data, at)
            if open_end and parent == CLUSTER and ident in TOP:  # a cluster of unknown size ends here
                return begin
            stop = end if size is None else at + size
            if stop > end:
                raise ValueError(f"element {ident:x} runs over its parent's end")
            if ident == BLOCK_GROUP:
                self._group(at, stop)
            elif ident in MASTERS:
                if ident == SEGMENT:
                    self.segment = at
                elif ident == CLUSTER:
                    self.clusters.append(begin - self.segment)
                stop = self._walk(at, stop, ident, size is None)
            elif ident == SIMPLE_BLOCK:
                self._frames(at, stop, None, None)
            elif ident == CODEC_ID:
                self.tracks[self.track] = data[at:stop].decode("ascii", "replace")
            elif ident in (TIMESTAMP, TIMESTAMP_SCALE, DEFAULT_DURATION, TRACK_NUMBER, CUE_TIME, CUE_TRACK, CUE_CLUSTER):
                n = int.from_bytes(data[at:stop], "big")
                if ident == TIMESTAMP:
                    self.time = n
                elif ident == TIMESTAMP_SCALE:
                    self.scale = n
                elif ident == DEFAULT_DURATION:
                    self.durations[self.track] = n
                elif ident == TRACK_NUMBER:
                    self.track = n
                elif ident == CUE_TIME:
                    self.cue_time = n
                elif ident == CUE_TRACK:
                    self.cue_track = n
                else:
                    self.cues.append((self.cue_time, self.cue_track, n))
            at = stop
        return at


def demux(c: Container, track: int = 1) -> bytes:
    return b"".join(c.data[a:b] for t, _, _, a, b, _ in c.packets if t == track)


def feature(c: Container, payload: bytes) -> str:
    """Packets, clusters, duration, mean and deviation of the samples, and a 16-bin histogram of their values."""
    x = np.frombuffer(payload, dtype=np.uint8)
    bins = np.bincount(x >> 4, minlength=16)
    values = np.arange(256)
    full = np.bincount(x, minlength=256)
    mean = float((full * values).sum() / max(1, x.size))
    var = float((full * (values - mean) ** 2).sum() / max(1, x.size))
    return f"packets={len(c.packets)};clusters={len(c.clusters)};ms={c.packets[-1][1] + TICK};mean={mean:.4f};std={var**0.5:.4f};hist={','.join(map(str, bins.tolist()))}"


FIELDS = T.StructType(
    [T.StructField(n, t()) for n, t in (("n_bytes", T.LongType), ("payload_bytes", T.LongType), ("payload_sha256", T.StringType), ("tail_crc32", T.LongType), ("media_bytes", T.LongType), ("media_sha256", T.StringType), ("feature", T.StringType), ("n_packets", T.LongType), ("n_cues", T.LongType))]
)


def pad(text: str | None, unit: int = UNIT) -> tuple[int, bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + b"\xff" * ((-len(raw)) % unit if raw else unit)


def digest(texts: list) -> list:
    rows = []
    for t in texts:
        n, payload = pad(t)
        media = mux(payload)
        c = Container(media)
        back = demux(c)
        rows.append((n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature(c, back), len(c.packets), len(c.cues)))
    return [list(x) for x in zip(*rows, strict=True)] or [[] for _ in FIELDS.fields]


STORED = T.StructType([T.StructField("media", T.BinaryType())])
#: Fields of a packet; ``error`` is null in all rows but that of a file's damage, where the others are.
PACKET = ("track", "timestamp_ms", "key", "start", "end", "timestamp_ns", "error")
PACKETS = T.ArrayType(T.StructType([T.StructField(n, t()) for n, t in zip(PACKET, (T.IntegerType, T.LongType, T.BooleanType, T.LongType, T.LongType, T.LongType, T.StringType), strict=True)]))
#: Files of a batch at most: whole files meet in memory.
FILES = 64


def store(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds ``media``: each text's payload as a Matroska file."""
    return map_texts(docs, text_col, lambda: lambda ts: [[mux(pad(t)[1]) for t in ts]], STORED, keep)


def packet_table(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row for each packet of each file: id_col and PACKET. Null and empty media have none; a damaged file has a last row with its ``error``."""
    small_batches(media.sparkSession)
    ship(media.sparkSession)
    schema = T.StructType([T.StructField("id", media.schema[id_col].dataType), T.StructField("p", PACKETS)])
    arrow = to_arrow_type(PACKETS)

    def rows(m: bytes | None) -> list[dict]:
        if not m:
            return []
        c = Container(m, whole=False)
        found = [dict(zip(PACKET, (*p, None), strict=True)) for p in c.packets]
        return found + [{"error": c.error}] * (c.error is not None)

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, FILES):
                b = whole.slice(at, FILES)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(rows, b.column(1).to_pylist()), type=arrow)], names=["id", "p"])

    return media.select(F.col(id_col).alias("id"), F.col(media_col).alias("m")).mapInArrow(run, schema).select(F.col("id").alias(id_col), F.explode("p").alias("p")).select(id_col, "p.*")


def media_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores each text, reads the stored bytes back and returns their digests and features."""
    return map_texts(docs, text_col, lambda: digest, FIELDS, [id_col])


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digest(table(spark, sf_dir, "documents"))
