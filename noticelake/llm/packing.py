"""Packing token sequences by multiway differencing (operator 5).

Every text becomes token ids and one end id. Documents are cut into pieces, whole windows first;
what is left of them goes to blocks of ``WINDOWS`` windows. In a block, Karmarkar-Karp multiway
differencing starts with one partial partition per group of pieces and always merges the two
with the largest spread, the fullest windows of one onto the emptiest of the other. If a window
of the result exceeds the capacity, the block is done again with one window more.

Blocks are filled inside a task, in the order of its rows, so packing needs no shuffle and a
task holds one block. A piece is cut where a block reaches its share of tokens (``WINDOWS`` times
the capacity less ``SLACK``), so that windows end up full but for the slack.

Defined results: null text is empty; an empty text is its end id alone; texts are taken whole;
equal rows are packed one by one; a null doc_id stays null; an empty table gives no sequences;
extra columns are ignored. Sequence ids are unique per run: the partition's number and a count.
"""

from __future__ import annotations

import heapq
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticelake.llm import tokens as tk

CAPACITY = 2048
END_ID = 1
#: Windows of a block, the largest piece in a block, and the tokens left free per window.
WINDOWS = 128
PIECE = 512
SLACK = 8
VOCABULARY = "word_bpe_49k.json"
#: Words that a task remembers with their ids.
REMEMBERED = 1_000_000


class WordIds(dict):
    """Ids of a whitespace-separated word, as little-endian 32-bit bytes.

    The tokenizer splits at white space and drops it, so a text's ids are those of its words.
    Words of plain letters, digits and signs skip the normaliser, which would not change them;
    all others go through the tokenizer.
    """

    #: Letters that are their own NFC form and have one plain lower-case letter.
    _SIMPLE = re.compile(r"[!-;=-~À-ÖØ-öø-įĲ-ňŊ-ž]+")
    #: The tokenizer's own split, for the characters above. Fixed values.
    _SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ž]+|[0-9]|[^a-zß-öø-ž0-9]+")

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.mapped = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.parts: dict[str, bytes] = {}

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        text = word.decode()
        if self._SIMPLE.fullmatch(text):
            ids = b"".join(self._part(x) for x in self._SPLIT.findall(text.lower()))
        else:
            ids = array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        self[word] = ids
        return ids

    def _part(self, part: str) -> bytes:
        ids = self.parts.get(part)
        if ids is None:
            if len(self.parts) >= REMEMBERED:
                self.parts.clear()
            mapped = part if part.isascii() else self.mapped.pre_tokenize_str(part)[0][0]
            ids = array("I", [x.id for x in self.tokenizer.model.tokenize(mapped)]).tobytes()
            self.parts[part] = ids
        return ids

    def of(self, text: bytes | None) -> bytes:
        return b"".join(map(self.__getitem__, (text or b"").split()))


def differencing(sizes: list[int], windows: int) -> list[list[int]]:
    """Indices of ``sizes`` in ``windows`` groups of nearly equal sums."""
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    heap, parts = [], []
    for at in range(0, len(order), windows):
        # One piece per window: the same partial partition as merging them one by one.
        chunk = order[at: at + windows]
        sums = np.zeros(windows, np.int64)
        sums[: len(chunk)] = [sizes[i] for i in chunk]
        parts.append((sums, [[i] for i in chunk] + [[] for _ in range(windows - len(chunk))]))
        heap.append((-int(sums.max() - sums.min()), len(parts) - 1))
    heapq.heapify(heap)
    while len(heap) > 1:
        (a, left), (b, right) = (parts[heapq.heappop(heap)[1]] for _ in range(2))
        up, down = np.argsort(a, kind="stable"), np.argsort(-b, kind="stable")
        sums = a[up] + b[down]
        parts.append((sums, [left[i] + right[j] for i, j in zip(up, down, strict=True)]))
        heapq.heappush(heap, (-int(sums.max() - sums.min()), len(parts) - 1))
    return parts[heap[0][1]][1] if heap else []


def fill_windows(sizes: list[int], capacity: int) -> list[list[int]]:
    """Groups of at most ``capacity``; one window more whenever one exceeds it."""
    if max(sizes, default=0) > capacity:
        raise ValueError("a piece is larger than a window")
    windows = max(1, -(-sum(sizes) // capacity)) if sizes else 0
    while True:
        groups = [g for g in differencing(sizes, windows) if g] if windows else []
        if all(sum(sizes[i] for i in g) <= capacity for g in groups):
            return groups
        windows += 1


class Packer:
    """Pieces in, placed pieces out. Holds one block."""

    def __init__(self, task: int, capacity: int, windows: int, piece: int, slack: int):
        self.next = task << 33
        self.capacity, self.piece = capacity, min(piece, capacity)
        self.share = windows * (capacity - slack)
        self.block, self.held, self.out = [], 0, []

    def add(self, document: tuple, total: int):
        """``document`` starts each output row; its ``total`` tokens are cut into pieces."""
        start = 0
        while total - start >= self.capacity:
            self.out.append((*document, start, self.capacity, self.next, 0))
            self.next += 1
            start += self.capacity
        while start < total:
            n = min(total - start, self.piece, self.share - self.held)
            self.block.append((document, start, n))
            self.held += n
            start += n
            if self.held == self.share:
                self.flush()

    def flush(self):
        for group in fill_windows([n for _, _, n in self.block], self.capacity):
            offset = 0
            for i in group:
                document, start, n = self.block[i]
                self.out.append((*document, start, n, self.next, offset))
                offset += n
            self.next += 1
        self.block, self.held = [], 0


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID,
         windows: int = WINDOWS, piece: int = PIECE, slack: int = SLACK, with_ids: bool = False) -> DataFrame:
    """One row per piece: its place in the document and in its sequence, and a CRC32 of its ids.

    ``path`` is a tokenizer file on every worker (by default the public vocabulary's place there).
    ``with_ids`` adds ``ids``, the tokens themselves.
    """
    tk.bound_batches(docs.sparkSession)
    ids_kind = ", ids array<int>" if with_ids else ""
    end = np.array([end_id], "<u4").tobytes()

    @tk.tidy
    def emit(batches: Iterator[pa.RecordBatch]):
        words = WordIds(path or vocabulary_path())
        packer = Packer(TaskContext.get().partitionId(), capacity, windows, piece, slack)

        def rows():
            placed, packer.out = packer.out, []
            doc, total, kept, start, n, sequence, offset = (list(x) for x in zip(*placed, strict=True))
            pieces = [ids[4 * s: 4 * (s + m)] for ids, s, m in zip(kept, start, n, strict=True)]
            columns = [
                pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array(n, pa.int64()),
                pa.array([zlib.crc32(x) for x in pieces], pa.int64()), pa.array(total, pa.int64()),
                pa.array(sequence, pa.int64()), pa.array(offset, pa.int64()),
            ]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if with_ids:
                columns.append(pa.array([np.frombuffer(x, "<i4") for x in pieces], pa.list_(pa.int32())))
                names.append("ids")
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            texts = batch.column("text").cast(pa.large_binary())
            for doc, text in zip(batch.column("doc_id").to_pylist(), texts, strict=True):
                ids = words.of(text.as_py()) + end
                packer.add((doc, len(ids) // 4, ids), len(ids) // 4)
                if len(packer.out) >= 2000:
                    yield rows()
        packer.flush()
        if packer.out:
            yield rows()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        emit, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
        "sequence_id long, offset long" + ids_kind)
