"""Sum-of-squares online packing of token sequences into fixed windows.

A document of n ids gives its full windows at once; what remains is placed, in the order of arrival,
into the fill level that makes the sum of squared counts of partly filled windows smallest.  The counts
lie in an array over the levels.  Each task packs the documents that it reads, without a shuffle, and
holds open windows only.  The sum of squares keeps these few (2,000 documents of any length leave some
hundreds); ``max_open`` of :func:`pack` bounds the memory of a task all the same: beyond it, and at the task's
end, the emptiest windows are cut up to fill the fullest, and the placing goes on.  The one window that stays
partly filled is split into power-of-two sequences, so a task pads nothing.

Results that are defined: a null or empty text is the closing id alone; documents that repeat an id
are packed one by one; a null id is carried along; a text of any length is encoded in blocks; extra columns
are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from quern.llm.common import narrow, slices, texts_as_bytes
from quern.runtime import ship

WINDOW = 2048
END = 1
#: Open windows of a task; each holds at most WINDOW ids of four bytes.
MAX_OPEN = 16_384
#: Sequence ids are the task's number and the sequence's number within it.
SEQUENCE_BITS = 40

_ENCODERS: dict[str, Callable[[str], np.ndarray]] = {}


def _byte_alphabet() -> dict[str, int]:
    """Printable stand-ins of byte-level vocabularies: printable bytes as themselves, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


#: A place where no token of a byte-level vocabulary goes on: one blank between two other characters.
_CUT = re.compile(r"(?<=\S) (?=\S)")
_VOID = re.compile(r"\s{2000}")


def text_blocks(text: str, size: int = 1 << 20) -> Iterator[str]:
    """The text in blocks of bounded length (where it has such blanks), none of which cuts a token."""
    at = 0
    while at < len(text):
        blank = _CUT.search(text, at + size) if at + size < len(text) else None
        end = blank.start() if blank else len(text)
        yield text[at:end]
        at = end


def encoder(path: str) -> Callable[[str], np.ndarray]:
    """Ids of a text under a byte-level BPE tokenizer file, as ``tokenizers`` gives them without added special tokens.

    A block that holds a special token's string, or so long a run of blanks that rank merging would overflow its
    stack, goes to ``tokenizers``.  Other blocks are encoded by rank merging over
    the file's own vocabulary, in which the ids of merged tokens are their ranks; a probe text is encoded both ways,
    and where the two differ, ``tokenizers`` encodes all texts.
    """
    if path not in _ENCODERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        slow = Tokenizer.from_file(path)

        def by_tokenizers(text: str) -> np.ndarray:
            return np.array(slow.encode(text, add_special_tokens=False).ids, np.uint32)

        probe = "Ünïcode  and\n\n\tspaces, don't 1234567 $$$ 漢字 🙂 end. "
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        fixed = [x["content"] for x in spec.get("added_tokens", [])]
        # A special token that reaches over blanks may lie across two blocks.
        wide = any(x.get("lstrip") or x.get("rstrip") or re.search(r"\s", x["content"]) for x in spec.get("added_tokens", []))
        alphabet = _byte_alphabet()
        chosen = by_tokenizers
        try:
            ranks = {bytes(alphabet[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in fixed}
            merge = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

            def of_block(text: str) -> np.ndarray:
                if any(token in text for token in fixed) or _VOID.search(text):
                    return by_tokenizers(text)
                return np.array(merge(text), np.uint32)

            def by_ranks(text: str) -> np.ndarray:
                blocks = [of_block(b) for b in ([text] if wide else text_blocks(text))]
                return blocks[0] if len(blocks) == 1 else np.concatenate([np.zeros(0, np.uint32), *blocks])

            if np.array_equal(by_ranks(probe), by_tokenizers(probe)):
                chosen = by_ranks
        except (KeyError, ValueError):
            pass  # not a byte-level vocabulary
        _ENCODERS[path] = chosen
    return _ENCODERS[path]


class Packer:
    """Level array and open windows of one task; a piece is (tag, start, ids)."""

    def __init__(self, window: int = WINDOW, max_open: int = MAX_OPEN) -> None:
        self.window, self.max_open = window, max_open
        self.counts = np.zeros(window + 1, np.int64)
        self.open: list[list[list[tuple]]] = [[] for _ in range(window + 1)]
        self.n_open = 0

    def add(self, tag, ids: np.ndarray) -> Iterator[list[tuple]]:
        """Sequences (lists of pieces) that this document completes."""
        full = len(ids) // self.window * self.window
        for start in range(0, full, self.window):
            yield [(tag, start, ids[start : start + self.window])]
        rest = ids[full:]
        if not len(rest):
            return
        level = self._level(len(rest))
        pieces = self._take(level) if level else []
        pieces.append((tag, full, rest))
        if level + len(rest) == self.window:
            yield pieces
        else:
            self._put(level + len(rest), pieces)
            if self.n_open > self.max_open:
                yield from self._consolidate()

    def _level(self, n: int) -> int:
        """The level whose use changes the sum of squares least; of equals the fullest."""
        top = self.window - n
        counts = self.counts
        # Moving a window from h to h + n changes the sum by 2 * (N[h + n] - N[h]) + 2; a new window by 2 * N[n] + 1.
        change = 2 * (counts[n : self.window + 1] - counts[: top + 1]) + 2
        change[top] -= 1  # a full window counts no more
        change[0] = 2 * counts[n] + 1 if top else 0
        usable = counts[: top + 1] > 0
        usable[0] = True
        change[~usable] = np.iinfo(np.int64).max
        return top - int(np.argmin(change[::-1]))

    def _take(self, level: int) -> list[tuple]:
        self.counts[level] -= 1
        self.n_open -= 1
        return self.open[level].pop()

    def _put(self, level: int, pieces: list[tuple]) -> None:
        self.counts[level] += 1
        self.n_open += 1
        self.open[level].append(pieces)

    def _consolidate(self) -> Iterator[list[tuple]]:
        """Fill the fullest windows with pieces of the emptiest; one window stays open."""
        levels = [(level, w) for level in range(self.window, 0, -1) for w in self.open[level]]
        for level in range(self.window + 1):
            self.open[level] = []
        self.counts[:] = 0
        self.n_open = 0
        low, high = 0, len(levels) - 1
        spare: list[tuple] = []
        while low <= high or spare:
            if low <= high:
                level, pieces = levels[low]
                low += 1
            else:
                level, pieces = 0, []
            gap = self.window - level
            while gap and (spare or low <= high):
                if not spare:
                    spare = levels[high][1][::-1]
                    high -= 1
                tag, start, ids = spare.pop()
                if len(ids) > gap:
                    spare.append((tag, start + gap, ids[gap:]))
                    ids = ids[:gap]
                pieces.append((tag, start, ids))
                gap -= len(ids)
            if gap:
                self._put(self.window - gap, pieces)
            else:
                yield pieces

    def close(self) -> Iterator[list[tuple]]:
        yield from self._consolidate()
        for level in range(self.window + 1):
            for pieces in self.open[level]:
                # Split into sequences whose lengths are the powers of two that add up to the level.
                left = level
                pieces = pieces[::-1]
                while left:
                    room = 1 << (left.bit_length() - 1)
                    left -= room
                    sequence = []
                    while room:
                        tag, start, ids = pieces.pop()
                        if len(ids) > room:
                            pieces.append((tag, start + room, ids[room:]))
                            ids = ids[:room]
                        sequence.append((tag, start, ids))
                        room -= len(ids)
                    yield sequence
            self.open[level] = []


def pack(
    df: DataFrame,
    tokenizer: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    end_id: int = END,
    with_ids: bool = False,
    max_open: int = MAX_OPEN,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, on request, its ids.

    ``tokenizer`` is a file that every executor can open; by default the public byte-level vocabulary.
    """
    docs = narrow(df, id_col, text_col)
    ship(df.sparkSession)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    fields = [docs.schema["doc_id"], *(StructField(n, LongType()) for n in names[1:])]
    if with_ids:
        names, fields = [*names, "ids"], [*fields, StructField("ids", ArrayType(LongType()))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = tokenizer
        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("byte_bpe_50k.json")
        encode = encoder(path)
        packer = Packer(window, max_open)
        base, made = TaskContext.get().partitionId() << SEQUENCE_BITS, 0
        id_type = None
        rows: list[tuple] = []

        def emit(sequence: list[tuple]) -> None:
            nonlocal made
            offset = 0
            for (doc_id, total), start, ids in sequence:
                row = (doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, base + made, offset)
                rows.append((*row, ids.tolist()) if with_ids else row)
                offset += len(ids)
            made += 1

        def flush() -> pa.RecordBatch:
            columns = list(zip(*rows))
            rows.clear()
            arrays = [pa.array(columns[0], id_type), *(pa.array(c, pa.int64()) for c in columns[1:7])]
            if with_ids:
                arrays.append(pa.array(columns[7], pa.list_(pa.int64())))
            return pa.RecordBatch.from_arrays(arrays, names)

        for batch in batches:
            for part in slices(batch, 1):
                id_type = part.column(0).type
                for doc_id, text in zip(part.column(0).to_pylist(), texts_as_bytes(part.column(1))):
                    ids = np.append(encode(text.decode()), np.uint32(end_id))
                    for sequence in packer.add((doc_id, len(ids)), ids):
                        emit(sequence)
                        if len(rows) > 4096:
                            yield flush()
        for sequence in packer.close():
            emit(sequence)
        if rows:
            yield flush()

    return docs.select("doc_id", "text").mapInArrow(run, StructType(fields))
