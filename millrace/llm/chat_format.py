"""Chat formatting by columnar byte assembly (operator 11).

Conversations become texts for training: each turn is ``open``, its role, ``middle``, its text, ``close``, and the
assistant's texts are marked as what the loss counts. Turns meet by one shuffle on their conversation and are sorted
within the task. A batch is then assembled as columns, never turn by turn: numpy computes the length of each segment
(marks, contents, and the pieces that escapes cut contents into), their cumulative offsets in the output, and the source
index of each byte; one gather copies all of them into one preallocated buffer, and the Arrow strings of the batch
are that buffer with the offsets of the conversations.

Escapes. Where a content holds a control string of the template, with any number of escapes after its first character,
one more escape is put there. So no content holds a bare control string, and taking one escape from each place that
has any gives the content back, whatever it was.

Long conversations. One of more than ``WHOLE_TURNS`` turns or ``WHOLE_BYTES`` bytes is found by counting before
anything is shuffled, and is dealt out by blocks of ``BLOCK_TURNS`` turns: each block is a part of its own, in one piece or, beyond
``WHOLE_BYTES``, in several. All others are one piece, part 0, piece 0. What a task holds is one batch and one piece.
Pieces in the order of part and piece are the conversation; its spans count from the start of their piece.

Semantics. Turns go by ``turn``, null turns last, ties by role and text; all rows count, repeated ones too. Null texts
and roles are empty; any role is written and read back as it is. Rows without a conversation's id can't be put
together: each is a conversation of its own, with a null id. Texts are taken whole, however long. Other columns are
ignored, whatever their names; an empty table gives no rows. What reads the output hashes a long conversation's pieces
one after the other, as a digest is made in one go; it holds one piece at a time.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, ship, small_batches, table

#: A conversation beyond these is dealt out in parts; a piece is closed beyond these bytes.
WHOLE_TURNS, WHOLE_BYTES = 20_000, 16 << 20
BLOCK_TURNS = 4096
#: Marked conversations up to this number are broadcast, others are joined.
BROADCAST = 100_000
#: Output bytes that are assembled at once; a single longer turn is assembled alone.
STEP = 4 << 20


@dataclass(frozen=True)
class Template:
    """The marks of a turn, and the control strings that contents may not hold. All begin with a character that they have nowhere else."""

    open: str = "<s>[INST] "
    middle: str = " [/INST]\n"
    close: str = "</s>"
    controls: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]")
    escape: str = "\\"
    learned: tuple[str, ...] = ("assistant",)
    found: re.Pattern = field(init=False, repr=False)
    bare: re.Pattern = field(init=False, repr=False)

    def __post_init__(self):
        if len(self.escape.encode()) != 1 or not self.controls:
            raise ValueError("an escape is one ASCII character, and there must be control strings")
        heads = {c[0] for c in self.controls}
        if any(self.escape in c or h in c[1:] or len(c) < 2 for c in self.controls for h in heads):
            raise ValueError("control strings have two characters or more, no escape, and first characters that none of them has later")
        if not (any(c in self.middle for c in self.controls) and any(c in self.close for c in self.controls) and any(c in self.open for c in self.controls)):
            raise ValueError("each mark of a turn needs a control string")
        e = re.escape(self.escape)
        one = "|".join(f"{re.escape(c[0])}{{}}{re.escape(c[1:])}" for c in self.controls)
        object.__setattr__(self, "found", re.compile(one.replace("{}", f"{e}*").encode()))
        object.__setattr__(self, "bare", re.compile(one.replace("{}", f"{e}+")))

    def plain(self, content: str) -> str:
        """A content without its escapes."""
        return self.bare.sub(lambda m: m[0].replace(self.escape, "", 1), content)

    def parse(self, text: str) -> list[tuple[str, str]]:
        """(role, text) of each turn of a formatted text."""
        out, at = [], 0
        while at < len(text):
            if not text.startswith(self.open, at):
                raise ValueError(f"no turn begins at {at}")
            middle = text.index(self.middle, at + len(self.open))
            close = text.index(self.close, middle + len(self.middle))
            out.append((self.plain(text[at + len(self.open) : middle]), self.plain(text[middle + len(self.middle) : close])))
            at = close + len(self.close)
        return out


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Data, starts and sizes of an Arrow string column without nulls."""
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None and column.buffers()[2].size else np.empty(0, np.uint8)
    return data, offsets[:-1], np.diff(offsets)


def escapes(template: Template, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and places in ``data`` before which an escape goes: after the first byte of each control string."""
    if not sizes.sum():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    low = int(starts[0])
    hits = [(m.start(), m.end()) for m in template.found.finditer(data[low : int(starts[-1] + sizes[-1])])]
    begin, end = np.array(hits, np.int64).reshape(-1, 2).T + low
    row = np.searchsorted(starts, begin, "right") - 1
    inside = end <= starts[row] + sizes[row]  # one that two rows make up isn't there
    return row[inside], begin[inside] + 1


class Assembled:
    """The formatted turns of a batch: one buffer, and where each turn and each of their contents begins and ends in it."""

    def __init__(self, template: Template, roles: pa.Array, texts: pa.Array):
        n = len(texts)
        marks = [template.open.encode(), template.middle.encode(), template.close.encode(), template.escape.encode()]
        parts = [np.frombuffer(b"".join(marks), np.uint8)]
        mark_size = np.array([len(m) for m in marks], np.int64)
        mark_start = np.cumsum(mark_size) - mark_size
        shift, segments = int(mark_size.sum()), []
        every = np.arange(n)

        def add(row, slot, place, start, size):
            segments.append([np.broadcast_to(np.asarray(x, np.int64), np.shape(row)) for x in (row, slot, place, start, size)])

        for k, slot in enumerate((0, 2, 4)):
            add(every, slot, 0, mark_start[k], mark_size[k])
        for slot, column in ((1, roles), (3, texts)):
            data, starts, sizes = bytes_of(column)
            low, high = (int(starts[0]), int(starts[-1] + sizes[-1])) if n else (0, 0)
            row, place = escapes(template, data, starts, sizes)
            # A content's pieces lie between its start, its escapes' places and its end.
            first, last = np.append(starts, place), np.append(every, row)
            order = np.lexsort((first, last))
            first, last = first[order], last[order]
            follows = np.append(last[1:] == last[:-1], False) if first.size else np.empty(0, bool)
            ends = np.where(follows, np.append(first[1:], 0), (starts + sizes)[last]) if first.size else first
            add(last, slot, first - low, first - low + shift, ends - first)
            add(row, slot, place - low, mark_start[3], mark_size[3])  # before the piece that begins there
            parts.append(data[low:high])
            shift += high - low
        row, slot, place, start, size = (np.concatenate(x) for x in zip(*segments, strict=True))
        is_piece = (start >= mark_size.sum()).astype(np.int64)
        order = np.lexsort((is_piece, place, slot, row))
        row, slot, start, size = row[order], slot[order], start[order], size[order]
        offset = np.cumsum(size) - size
        total = int(size.sum())
        pool = np.concatenate(parts)
        self.buffer = np.empty(total, np.uint8)
        ends = offset + size
        large, done = np.append(np.flatnonzero(size >= STEP), size.size), 0
        while done < size.size:  # some segments at a time, so that the index stays small
            if size[done] >= STEP:
                self.buffer[offset[done] : ends[done]] = pool[start[done] : start[done] + size[done]]
                done += 1
                continue
            to = min(int(large[np.searchsorted(large, done)]), max(done + 1, int(np.searchsorted(ends, offset[done] + STEP, "right"))))
            index = np.repeat(start[done:to] - offset[done:to], size[done:to]) + np.arange(offset[done], ends[to - 1])
            np.take(pool, index, out=self.buffer[offset[done] : ends[to - 1]])
            done = to
        self.turn_start = offset[np.searchsorted(row, every)]
        self.turn_end = ends[np.searchsorted(row, every, "right") - 1]
        at = row * 5 + slot
        self.text_start = offset[np.searchsorted(at, every * 5 + 3)]
        self.text_end = ends[np.searchsorted(at, every * 5 + 3, "right") - 1]

    def points(self, *places: np.ndarray) -> list[np.ndarray]:
        """Code points before each of some places."""
        at = np.unique(np.concatenate([np.zeros(1, np.int64), *places]))
        begins = (self.buffer & 0xC0) != 0x80
        inner = at[at < begins.size]
        counts = np.add.reduceat(begins, inner, dtype=np.int64) if inner.size else np.empty(0, np.int64)
        before = np.append(0, np.cumsum(counts))[: at.size]
        return [before[np.searchsorted(at, x)] for x in places]


PIECES = "conv long, whole boolean, part long, piece long, formatted string, n_chars long, mask_starts array<long>, mask_ends array<long>"
NAMES = ["conv", "whole", "part", "piece", "formatted", "n_chars", "mask_starts", "mask_ends"]


def assemble(template: Template, rows: pa.RecordBatch, piece: np.ndarray) -> pa.RecordBatch:
    """Rows conv, whole, part, role, text in order, and the piece of each, as one row a piece."""
    conv, whole, part = rows.column(0), rows.column(1), rows.column(2)
    a = Assembled(template, rows.column(3).cast(pa.large_string()), rows.column(4).cast(pa.large_string()))
    key = [np.asarray(pc.fill_null(conv, 0)), np.asarray(conv.is_null()), np.asarray(part), piece]
    new = np.append(True, np.any([k[1:] != k[:-1] for k in key], axis=0)) if len(rows) else np.empty(0, bool)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(rows)) - 1
    begin, end = a.turn_start[first], a.turn_end[last]
    text = pa.LargeStringArray.from_buffers(first.size, pa.py_buffer(np.append(begin, end[-1:]).astype(np.int64)), pa.py_buffer(a.buffer))
    learned = np.flatnonzero(np.asarray(pc.is_in(rows.column(3), pa.array(template.learned, pa.string()))))
    of = np.searchsorted(first, learned, "right") - 1
    lists = pa.array(np.append(0, np.cumsum(np.bincount(of, minlength=first.size))), pa.int32())
    from_, to, *edges = a.points(begin, end, a.text_start[learned], a.text_end[learned])
    spans = [pa.ListArray.from_arrays(lists, pa.array(x - from_[of], pa.int64())) for x in edges]
    at = pa.array(first)
    return pa.RecordBatch.from_arrays([conv.take(at), whole.take(at), part.take(at), pa.array(piece[first], pa.int64()), text.cast(pa.string()), pa.array(to - from_, pa.int64()), *spans], names=NAMES)


def assembled(template: Template, batches, most: int):
    """Pieces of rows that come in order. Rows of an open piece wait for the next batch."""
    waiting: pa.RecordBatch | None = None
    piece = 0  # of the rows that wait
    for b in batches:
        if not len(b):
            continue
        rows = b if waiting is None else pa.concat_batches([waiting, b])
        conv = np.asarray(pc.fill_null(rows.column(0), 0)), np.asarray(rows.column(0).is_null()), np.asarray(rows.column(2))
        new = np.append(True, np.any([k[1:] != k[:-1] for k in conv], axis=0))
        of = np.cumsum(new) - 1
        size = np.cumsum(np.asarray(pc.add(pc.binary_length(rows.column(3)), pc.binary_length(rows.column(4)))).astype(np.int64) + 1)
        first = np.flatnonzero(new)
        before = np.append(0, size)[first][of]
        # Parts of long conversations break where their bytes do; what is whole stays whole.
        own = np.where(np.asarray(rows.column(1)), 0, (size - before) // most) + np.where(of == 0, piece, 0)
        number = own
        start = int(np.flatnonzero((of == of[-1]) & (number == number[-1]))[0])
        if start:
            yield assemble(template, rows.slice(0, start), number[:start])
        waiting, piece = rows.slice(start), int(number[-1])
    if waiting is not None:
        yield assemble(template, waiting, np.full(len(waiting), piece, np.int64))


def format_chats(turns: DataFrame, template: Template | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv, whole, part, piece, formatted, n_chars, mask_starts, mask_ends: the loss counts the code points of the spans [start, end)."""
    template = template or Template()
    spark = turns.sparkSession
    small_batches(spark)
    ship(spark)
    none = F.lit("")
    rows = turns.select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col).cast("string"), none).alias("role"), F.coalesce(F.col(text_col).cast("string"), none).alias("text"))
    size = rows.filter("conv IS NOT NULL").groupBy("conv").agg(F.count("*").alias("n"), F.sum(F.octet_length("text") + F.octet_length("role")).alias("bytes"))
    long = checkpoint(size.filter((F.col("n") > WHOLE_TURNS) | (F.col("bytes") > WHOLE_BYTES)).select("conv", F.lit(True).alias("long")))
    count = long.count()
    marked = rows.withColumn("long", F.lit(False))
    if count:
        marked = rows.join(F.broadcast(long) if count <= BROADCAST else long, "conv", "left").select("conv", "turn", "role", "text", F.coalesce("long", F.lit(False)).alias("long"))
    alone, last = F.col("conv").isNull(), F.lit((1 << 62) // BLOCK_TURNS)
    part = F.when(alone, F.monotonically_increasing_id()).when(F.col("long"), F.coalesce(F.floor(F.col("turn") / BLOCK_TURNS), last)).otherwise(F.lit(0))
    dealt = marked.select("conv", (~F.col("long")).alias("whole"), part.cast("long").alias("part"), "turn", "role", "text").repartition("conv", "part")
    ordered = dealt.sortWithinPartitions("conv", "part", F.asc_nulls_last("turn"), "role", "text").select("conv", "whole", "part", "role", "text")
    return ordered.mapInArrow(lambda batches: assembled(template, batches, WHOLE_BYTES), PIECES)


class Digests:
    """What is read back from the pieces of one conversation, one after the other."""

    def __init__(self, template: Template):
        self.template, self.turns, self.loss = template, hashlib.sha256(), hashlib.sha256()
        self.n = self.loss_chars = self.chars = 0

    def add(self, text: str, starts: list[int], ends: list[int]) -> None:
        for role, content in self.template.parse(text):
            self.turns.update(f"{role}\n{content}\n".encode("utf-8", "surrogatepass"))
            self.n += 1
        for a, b in zip(starts, ends, strict=True):
            learned = self.template.plain(text[a:b])
            self.loss.update(learned.encode("utf-8", "surrogatepass"))
            self.loss_chars += len(learned)
        self.chars += len(text)

    def row(self, conv) -> tuple:
        return conv, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
TYPES = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
#: On the way to it: rows of a conversation, or pieces of a long one that are still to be put together.
HALF = f"{READ}, place long, conv long, part long, piece long, formatted string, mask_starts array<long>, mask_ends array<long>"
REST = ["conv", "part", "piece", "formatted", "mask_starts", "mask_ends"]


def digests(rows: list) -> list[pa.Array]:
    return [pa.array([r[i] for r in rows], t) for i, t in enumerate(TYPES)]


def read_back(formatted: DataFrame, template: Template | None = None) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of each conversation, from the formatted texts and their spans alone.

    Whole conversations are read where they are; only what is read is shuffled. Pieces of long ones meet in order.
    """
    template = template or Template()
    names = [c.split()[0] for c in HALF.split(", ")]

    def whole(batches):
        for b in batches:
            own = b.filter(b.column(1))
            out = []
            for conv, text, starts, ends in zip(*[own.column(c).to_pylist() for c in ("conv", "formatted", "mask_starts", "mask_ends")], strict=True):
                d = Digests(template)
                d.add(text, starts, ends)
                out.append(d.row(conv))
            rest = b.filter(pc.invert(b.column(1)))
            if out:
                none = [pa.nulls(len(out), rest.column(c).type) for c in REST]
                yield pa.RecordBatch.from_arrays([*digests(out), own.column("part"), *none], names=names)
            if len(rest):
                yield pa.RecordBatch.from_arrays([*[pa.nulls(len(rest), t) for t in TYPES], rest.column("conv"), *[rest.column(c) for c in REST]], names=names)

    def pieces(batches):
        now, conv = None, None
        for b in batches:
            done, out = b.filter(pc.is_null(b.column("formatted"))), []
            for c, text, starts, ends in zip(*[b.filter(pc.is_valid(b.column("formatted"))).column(x).to_pylist() for x in ("conv", "formatted", "mask_starts", "mask_ends")], strict=True):
                if now is None or c != conv:
                    if now is not None:
                        out.append(now.row(conv))
                    now, conv = Digests(template), c
                now.add(text, starts, ends)
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([done.column(i), x]) for i, x in enumerate(digests(out))], names=names[: len(TYPES)])
        if now is not None:
            yield pa.RecordBatch.from_arrays(digests([now.row(conv)]), names=names[: len(TYPES)])

    read = formatted.select(*NAMES).mapInArrow(whole, HALF)
    return read.repartition("conv_id", "place").sortWithinPartitions("conv", "part", "piece").mapInArrow(pieces, READ)


def example(spark: SparkSession) -> DataFrame:
    """Conversation -1: control strings inside texts."""
    return spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))


OP11_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
k AS (SELECT *, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS alone FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn ASC NULLS LAST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn ASC NULLS LAST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(23 + length(role) + length(text) + len(regexp_extract_all(role || ' ' || text, '<\\*/?s>|\[\\*/?INST\]')))::BIGINT AS formatted_chars
FROM k GROUP BY conv_id, alone
"""


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return read_back(format_chats(turns.unionByName(example(spark))))
