"""Packing into sequences of several context sizes.

Each task packs the documents it reads, so no token is shuffled and a lost task is simply run again with the same result.
Documents are tokenised, then handled in blocks of a bounded number of tokens:

* a document is routed to the smallest context size (tier) that holds it; what exceeds the longest goes there in whole
  windows first, and its rest is routed;
* each tier packs by best fit, longest pieces first; the gaps of the longest windows are filled from shorter tiers;
* a gap that nothing fits is filled with the start of a waiting piece, whose rest waits on, so windows leave full;
* what is left at a task's end leaves in full windows of ever shorter tiers, and then of ever smaller powers of two, so
  that no sequence is padded (with tiers that are not powers of two the last one is, to the smallest tier).

Full windows of a tier are collected into step groups of equal token counts.

Defined cases: a null text is an empty one, and an empty one is its end token alone; repeated rows are packed each; an empty
table gives an empty result; null ids are carried along.
"""

from __future__ import annotations

import string
import zlib
from array import array
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grovemark.llm.common import table

TIERS = (512, 1024, 2048, 4096)
END = 2
VOCABULARY = "word_bpe_49k.json"
#: Tokens that are packed together, tokens of a step group, chunks whose ids a worker remembers, bytes tokenised together.
BLOCK_TOKENS, STEP_TOKENS, WORDS_KEPT, SLICE = 1_000_000, 32_768, 2_000_000, 1 << 23
OUT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"


class WordTokens:
    """Ids by a tokenizer that drops blanks and never joins across them, as unsigned 32-bit integers.

    A chunk is what stands from one blank-separated beginning to the next. The chunks of a slice of text are told apart and
    counted in Arrow; each distinct one is looked up once, and all ids are then gathered by numpy. Chunks that are not yet
    known are tokenised in one call and cut at the tokens that end a word, where their number of words is certain.
    """

    def __init__(self, path: str | None = None, keep: int = WORDS_KEPT) -> None:
        if path is None:
            import public_tokenizers

            path = public_tokenizers.path(VOCABULARY)
        from tokenizers import Tokenizer

        self.tokenizer, self.keep = Tokenizer.from_file(path), keep
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        # The known chunks in order of their numbers, all their ids, and where each chunk's begin.
        self.known, self.flat, self.at = pa.array([], pa.binary()), np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def encoded(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def learn(self, chunks: list[bytes]) -> tuple[list[int], np.ndarray, np.ndarray]:
        """An order of the chunks, all their ids in that order, and how many each has."""
        texts = b"\0".join(chunks).decode("utf-8", "replace").split("\0")
        if len(texts) != len(chunks):
            texts = [c.decode("utf-8", "replace") for c in chunks]
        words = [certain_words(t) for t in texts]
        order, ids, counts = [], [], []

        def one_by_one(part: list[int]) -> None:
            for k in part:
                order.append(k)
                ids.append(self.encoded(texts[k]))
                counts.append(np.array([len(ids[-1])]))

        sure = [k for k, w in enumerate(words) if w]
        for lo in range(0, len(sure), 2000):
            part = sure[lo : lo + 2000]
            got = self.encoded(" ".join([texts[k] for k in part]))
            last = np.cumsum([words[k] for k in part]) - 1
            ends = np.nonzero(self.ends[got])[0]
            if len(ends) == last[-1] + 1 and ends[-1] == len(got) - 1:
                order += part
                ids.append(got)
                counts.append(np.diff(ends[last], prepend=-1))
            else:
                one_by_one(part)
        one_by_one([k for k, w in enumerate(words) if not w])
        return order, np.concatenate(ids), np.concatenate(counts)

    def slice(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """data: bytes of whole texts, or of a part of one that ends before a chunk; starts: where its texts begin. All ids,
        and how many precede each start."""
        data = _TO_BLANK[data]
        blank = data == 32
        first = np.zeros(len(data), bool)
        first[1:] = blank[:-1] & ~blank[1:]
        first[starts[starts < len(data)]] = True
        at = np.nonzero(first)[0]
        chunks = pa.BinaryArray.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(np.append(at, len(data)).astype(np.int32)), pa.py_buffer(data)]).dictionary_encode()
        numbers = pc.fill_null(pc.index_in(chunks.dictionary, value_set=self.known), -1).to_numpy().astype(np.int64)
        flat, begins, n = self.flat, self.at, len(self.known)
        lacking = np.nonzero(numbers < 0)[0]
        if len(lacking):
            new = chunks.dictionary.take(pa.array(lacking))
            order, ids, counts = self.learn(new.to_pylist())
            numbers[lacking[order]] = np.arange(n, n + len(lacking))
            flat, begins = np.concatenate([flat, ids]), np.concatenate([begins, begins[-1] + np.cumsum(counts)])
            if n + len(lacking) <= self.keep:
                self.known, self.flat, self.at = pa.concat_arrays([self.known, new.take(pa.array(order))]), flat, begins
        number = numbers[chunks.indices.to_numpy()]
        counts = begins[number + 1] - begins[number]
        before = np.concatenate([[0], np.cumsum(counts)])
        out = flat[np.repeat(begins[number] - before[:-1], counts) + np.arange(before[-1])]
        return out, before[np.searchsorted(at, starts)]

    def ids(self, texts: pa.Array) -> list[bytes]:
        """Of each text its ids as little-endian unsigned 32-bit integers."""
        texts = texts.cast(pa.large_binary())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        out: list[list[bytes]] = [[] for _ in range(len(texts))]
        lo, end = int(offsets[0]), int(offsets[-1])
        while lo < end:
            hi = min(end, lo + SLICE)
            if hi < end and hi not in offsets:
                # A slice ends with a blank; where it holds none, with the next one.
                inner = np.nonzero(_TO_BLANK[data[lo:hi]] == 32)[0]
                if len(inner):
                    hi = lo + int(inner[-1]) + 1
                else:
                    hi += next((k + 1 for k in range(end - hi) if _TO_BLANK[data[hi + k]] == 32 or hi + k + 1 in offsets), end - hi)
            k0, k1 = int(np.searchsorted(offsets, lo, "right")) - 1, int(np.searchsorted(offsets, hi, "left"))
            got, before = self.slice(data[lo:hi], np.maximum(offsets[k0:k1], lo) - lo)
            cuts = np.append(before, len(got))
            for k in range(k0, k1):
                out[k].append(got[cuts[k - k0] : cuts[k - k0 + 1]].tobytes())
            lo = hi
        return [x[0] if len(x) == 1 else b"".join(x) for x in out]


def certain_words(text: str) -> int:
    """How many words (tokens that end one) a chunk has, where that is certain: letters, then perhaps ASCII punctuation. Else 0."""
    text = text.rstrip(" ")
    if text.isascii():
        return 1 if text.isalpha() else 2 if text.rstrip(string.punctuation).isalpha() else 0
    core = text.rstrip(string.punctuation)
    if core.isalpha() and "Σ" not in core and core.lower().isalpha():
        return 1 if len(core) == len(text) else 2
    return 0


#: Of this Python worker: what one task has learned serves the next. It changes no result.
_LEARNED: dict[str | None, WordTokens] = {}


def word_tokens(path: str | None) -> WordTokens:
    if path not in _LEARNED:
        _LEARNED[path] = WordTokens(path)
    return _LEARNED[path]


_TO_BLANK = np.arange(256, dtype=np.uint8)
_TO_BLANK[9:14] = 32


_OUT = pa.schema([(c.split()[0], pa.int32() if c.endswith(" int") else pa.int64()) for c in OUT.split(", ")])


class Packer:
    """Packs (document, start, length) pieces; emits sequences that are full."""

    def __init__(self, tiers: tuple[int, ...] = TIERS) -> None:
        self.tiers = tiers
        self.waiting: list[tuple[int, int, int]] = []  # (length, start, document), kept sorted

    def block(self, pieces: list[tuple[int, int, int]]) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
        """pieces: (document, start, length). Yields (tier, pieces of one full sequence)."""
        top = self.tiers[-1]
        for doc, start, length in pieces:
            while length > top:
                yield top, [(doc, start, top)]
                start, length = start + top, length - top
            self.waiting.append((length, start, doc))
        self.waiting.sort()
        # Routed to the smallest tier that holds it: in sorted order the tiers are runs of the list.
        for tier in reversed(self.tiers):
            lower = self.tiers[self.tiers.index(tier) - 1] if tier != self.tiers[0] else 0
            while self.waiting and self.waiting[-1][0] > lower and sum_reaches(self.waiting, tier):
                yield tier, self.window(tier)

    def window(self, tier: int) -> list[tuple[int, int, int]]:
        """The longest waiting piece, then the longest that fits each time (of shorter tiers, once this one has none), then
        the beginning of the longest left."""
        out, gap = [], tier
        while gap:
            k = bisect_right(self.waiting, (gap, 1 << 62, 1 << 62)) - 1
            if k >= 0:
                length, start, doc = self.waiting.pop(k)
                out.append((doc, start, length))
                gap -= length
            else:
                length, start, doc = self.waiting.pop()
                out.append((doc, start, gap))
                insort(self.waiting, (length - gap, start + gap, doc))
                gap = 0
        return out

    def finish(self) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
        """What is left, in windows of the tiers and then of ever smaller powers of two: all of them are full."""
        left = sum(w[0] for w in self.waiting)
        small = [1 << k for k in reversed(range(self.tiers[0].bit_length() - 1))] if self.tiers[0] & (self.tiers[0] - 1) == 0 else []
        for tier in [*reversed(self.tiers), *small]:
            while left >= tier:
                yield tier, self.window(tier)
                left -= tier
        if self.waiting:
            yield self.tiers[0], [(doc, start, length) for length, start, doc in self.waiting]
            self.waiting = []


def sum_reaches(waiting: list[tuple[int, int, int]], n: int) -> bool:
    """Whether the waiting pieces hold n tokens; looks at the longest first and so at few."""
    total = 0
    for w in reversed(waiting):
        total += w[0]
        if total >= n:
            return True
    return False


class Steps:
    """Deals full windows to groups of STEP_TOKENS tokens of one tier, so that the steps of a run weigh the same."""

    def __init__(self, task: int) -> None:
        self.next, self.open = task << 32, {}

    def group(self, tier: int) -> int:
        g, room = self.open.get(tier, (0, 0))
        if not room:
            g, room = self.next, max(1, STEP_TOKENS // tier)
            self.next += 1
        self.open[tier] = g, room - 1
        return g


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, tiers: tuple[int, ...] = TIERS) -> DataFrame:
    """One row per piece, see OUT. tier: the sequence's context size; step_group: the sequences of one step."""
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        words, packer, steps = word_tokens(tokenizer), Packer(tiers), Steps(task)
        end, held, sequence, number = array("I", [END]).tobytes(), {}, task << 32, 0

        def rows(made: Iterator[tuple[int, list[tuple[int, int, int]]]]) -> pa.RecordBatch:
            nonlocal sequence
            out, gone = [], set()
            for tier, pieces in made:
                group, offset = steps.group(tier), 0
                for doc, start, length in pieces:
                    name, ids = held[doc]
                    out.append((name, start, length, zlib.crc32(memoryview(ids)[4 * start : 4 * (start + length)]), len(ids) // 4, sequence, offset, tier, group))
                    offset += length
                    gone.add(doc)
                sequence += 1
            for doc in gone.difference(w[2] for w in packer.waiting):
                del held[doc]
            columns = list(zip(*out, strict=True)) if out else [()] * len(_OUT)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _OUT, strict=True)], schema=_OUT)

        block, tokens = [], 0
        for b in batches:
            for name, ids in zip(b.column(0).to_pylist(), words.ids(b.column(1)), strict=True):
                ids += end
                held[number] = name, ids
                block.append((number, 0, len(ids) // 4))
                number += 1
                tokens += len(ids) // 4
                if tokens >= BLOCK_TOKENS:
                    yield rows(packer.block(block))
                    block, tokens = [], 0
        yield rows(packer.block(block))
        yield rows(packer.finish())

    return narrow.mapInArrow(packed, OUT)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
