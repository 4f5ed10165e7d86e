"""Best-fit packing of tokenised documents by bin completion.

Sequences hold `capacity` tokens. Documents of more are cut into pieces of the full capacity, the first piece being the rest.
How many pieces there are of each length (at most `capacity` different numbers, whatever the corpus) is all that the packing
needs: bin completion (completion.py) works on these counts, and ends with a proven least number of sequences or, after
`effort` steps, with the fewest it has found and the bound it knows, both of which are logged.

The plan, a list of fillings with how often each is used, is bounded as the counts are. Pieces get their ranks within their
length by range-sorting and prefix sums, and a rank finds its sequence and place in the plan by binary search, so no task
sees more than its rows.

Defined results: a null text is empty, and an empty document is its end token alone; rows that repeat an id are documents of
their own; an id may be null. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import logging
import os
import string
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Work, slices
from .completion import Filling, pack

_LOG = logging.getLogger(__name__)
_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


@lru_cache(2)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


_PUNCTUATION = string.punctuation


class Encoder:
    """A byte-level BPE tokenizer's ids of whole texts, with a memory of chunks.

    Its pattern ends a token at every space that follows something other than white space, so a text is cut there and each
    chunk, from its space on, is encoded alone; only chunks not met lately reach the tokenizer. A chunk of Latin letters, with
    ASCII punctuation after them or not, has its cuts in sight and goes to the tokenizer's model part by part; other chunks
    go through all of the tokenizer. Texts in which the cut isn't certain (two white-space characters in a row, one of the
    tokenizer's added tokens) go to it whole, as do all texts if the tokenizer turns out to be of another kind.
    """

    def __init__(self, path: str, most: int = 800_000):
        self.own, self.known, self.tails, self.most = tokenizer(path), {}, {}, most
        self.model, self.letters = self.own.model, dict(enumerate(_byte_letters()))
        self.added = [t.content for t in self.own.get_added_tokens_decoder().values()]
        probe = "Ab c's\nde, f. 12 é\nÀß.\n\nx! don't (y)" * 3
        words = probe.split(" ")
        try:
            self.chunked = self._ids([probe])[0] == self._ids([words[0]])[0] + b"".join(self._words(words[1:]))
        except Exception:  # noqa: BLE001 - a model that doesn't know byte letters
            self.chunked = False

    def _ids(self, texts: list[str]) -> list[bytes]:
        out = []
        for i in range(0, len(texts), 256):
            out += [np.array(e.ids, "<u4").tobytes() for e in self.own.encode_batch_fast(texts[i : i + 256], add_special_tokens=False)]
        return out

    def _tail(self, text: str) -> bytes:
        if text not in self.tails:
            self.tails[text] = self._ids([text])[0]
        return self.tails[text]

    def _word(self, word: str, lead: str) -> bytes | None:
        """The ids of letters and punctuation after them; None if it is anything else."""
        core = word.rstrip(_PUNCTUATION)
        if not core.isalpha():
            return None
        if core.isascii():
            letters = core
        elif max(core) < "\u0250":
            letters = core.encode().decode("latin-1").translate(self.letters)
        else:
            return None
        ids = array("I", [t.id for t in self.model.tokenize(lead + letters)]).tobytes()
        return ids if len(core) == len(word) else ids + self._tail(word[len(core) :])

    def _words(self, words: list[str]) -> list[bytes]:
        """The ids of chunks, each a space and a word."""
        out, hard, space = [], [], self.letters[32]
        for i, word in enumerate(words):
            ids = self._word(word, space)
            if ids is None and "\n" in word:
                parts = [self._word(p, "" if k else space) for k, p in enumerate(word.split("\n"))]
                ids = None if None in parts else self._tail("\n").join(parts)
            out.append(ids)
            if ids is None:
                hard.append(i)
        for i, ids in zip(hard, self._ids([f" {words[i]}" for i in hard]), strict=True):
            out[i] = ids
        return out

    def _certain(self, text: str) -> bool:
        return not (any(t in text for t in self.added) or "  " in text or "\n " in text or " \n" in text or text.startswith(" ") or text.endswith(" ") or "\t" in text or "\r" in text or "\x0b" in text or "\x0c" in text or _other_space(text))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit numbers."""
        out: list[bytes | None] = [None] * len(texts)
        whole = [i for i, t in enumerate(texts) if not (self.chunked and self._certain(t))]
        for i, ids in zip(whole, self._ids([texts[i] for i in whole]), strict=True):
            out[i] = ids
        cut = {i: t.split(" ") for i, t in enumerate(texts) if out[i] is None}
        # a chunk is kept under its word: that is " word", but for a text's first
        own = set().union(*cut.values()) if cut else set()
        if len(self.known) > self.most:  # what these texts use goes on
            self.known = {w: self.known[w] for w in own.intersection(self.known)}
        new = list(own.difference(self.known))
        self.known.update(zip(new, self._words(new), strict=True))
        firsts = [self._word(words[0], "") for words in cut.values()]
        hard = [k for k, ids in enumerate(firsts) if ids is None]
        spelled = [words[0] for words in cut.values()] if hard else []
        for k, ids in zip(hard, self._ids([spelled[k] for k in hard]), strict=True):
            firsts[k] = ids
        get = self.known.__getitem__
        for (i, words), first in zip(cut.items(), firsts, strict=True):
            out[i] = first + b"".join(map(get, words[1:]))
        return out


@lru_cache(1)
def encoder(path: str) -> Encoder:
    """One for all tasks of a Python worker."""
    return Encoder(path)


def _byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: printable ones stand for themselves, the others follow
    from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


#: White space beyond ASCII. Looking for one of these in a text whose characters are all smaller costs nothing.
_SPACES = [chr(i) for i in range(128, 0x3001) if chr(i).isspace()]


def _other_space(text: str) -> bool:
    return not text.isascii() and any(c in text for c in _SPACES)


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces."""
    rest = length % capacity or capacity
    return [(0, rest), *[(at, capacity) for at in range(rest, length, capacity)]] if length > capacity else [(0, length)]


def _pieces(path: str, end: int, capacity: int, with_ids: bool):
    stop = np.array([end], "<u4").tobytes()

    def run(batches):
        own = encoder(path)
        for rows in batches:
            for part in slices(rows, "text", 2 << 20):
                columns: list[list] = [[] for _ in range(6)]
                texts = [t or "" for t in part.column("text").to_pylist()]
                for key, ids in zip(part.column("doc_id").to_pylist(), own.encode(texts), strict=True):
                    ids += stop
                    for number, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                        piece = ids[4 * start : 4 * (start + length)]
                        for column, value in zip(columns, (key, number, start, length, zlib.crc32(piece), piece), strict=True):
                            column.append(value)
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
                n = 6 if with_ids else 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)][:n], names[:n])

    return run


def _ranked(rows_in):
    """The number of the partition, and each row's rank among the partition's rows of its length."""
    from pyspark import TaskContext

    part, length, seen = TaskContext.get().partitionId(), None, 0
    for rows in rows_in:
        lengths = np.asarray(rows.column("length"), np.int64)
        if not len(lengths):
            continue
        heads = np.flatnonzero(np.concatenate(([True], lengths[1:] != lengths[:-1])))
        ranks = np.arange(len(lengths)) - np.repeat(heads, np.diff(np.append(heads, len(lengths))))
        if lengths[0] == length:
            ranks[: heads[1] if len(heads) > 1 else len(ranks)] += seen
        length, seen = int(lengths[-1]), int(ranks[-1]) + 1
        yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(np.full(len(lengths), part), pa.int64()), pa.array(ranks, pa.int64())], [*rows.schema.names, "part", "rank"])


class Places:
    """From a piece's length and rank to its sequence and its place there."""

    def __init__(self, plan: list[tuple[Filling, int]]):
        rows, taken, sequence = [], {}, 0
        for filling, used in plan:
            offset = 0
            for s in sorted(filling, reverse=True):
                rows.append((s, taken.get(s, 0), sequence, filling[s], offset))
                taken[s] = taken.get(s, 0) + used * filling[s]
                offset += s * filling[s]
            sequence += used
        self.sequences = sequence
        rows.sort()
        self.length, self.first, self.sequence, self.times, self.offset = (np.array([r[k] for r in rows], np.int64) for k in range(5))
        self.keys = self.length * (1 << 48) + self.first

    def of(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.keys, length * (1 << 48) + rank, "right") - 1
        nth = rank - self.first[at]
        return self.sequence[at] + nth // self.times[at], self.offset[at] + nth % self.times[at] * length


def _placed(places):
    def run(rows_in):
        for rows in rows_in:
            length, rank = (np.asarray(rows.column(c), np.int64) for c in ("length", "rank"))
            sequence, offset = places.value.of(length, rank)
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*[rows.column(c) for c in names], pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    return run


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end: int = 0, effort: int = 200_000) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: a row for each piece. effort: the search's most steps."""
    spark = docs.sparkSession
    work = Work(spark, "packing")
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = work.save(slim.mapInArrow(_pieces(tokenizer_path, end, capacity, False), _PIECE), "pieces")
    counts = {r.length: r["count"] for r in pieces.groupBy("length").count().collect()}  # `capacity` rows at most
    plan = pack(counts, capacity, effort)
    _LOG.info("%d sequences; no packing has fewer than %d", plan.bins, plan.bound)
    places = Places(plan.fillings)
    ordered = pieces.repartitionByRange("length", "doc_id", "piece", "start", "ids_crc32").sortWithinPartitions("length", "doc_id", "piece", "start", "ids_crc32")
    ranked = work.save(ordered.mapInArrow(_ranked, _PIECE + ", part long, rank long"), "ranked")
    work.drop("pieces")
    # range-sorted partitions share a length with their neighbours only: partitions + lengths rows at most
    sizes = sorted(ranked.groupBy("length", "part").count().collect())
    before, taken = [], {}
    for length, part, n in sizes:
        before.append((length, part, taken.get(length, 0)))
        taken[length] = taken.get(length, 0) + n
    offsets = spark.createDataFrame(before, "length long, part long, before long")
    exact = ranked.join(F.broadcast(offsets), ["length", "part"]).withColumn("rank", F.col("rank") + F.col("before"))
    return exact.mapInArrow(_placed(spark.sparkContext.broadcast(places)), _PIECE + ", sequence_id long, offset long")


def sequences(docs: DataFrame, packed: DataFrame, tokenizer_path: str, capacity: int = 2048, end: int = 0) -> DataFrame:
    """sequence_id, ids: the packed sequences themselves (ids as little-endian unsigned 32-bit numbers)."""
    pieces = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_pieces(tokenizer_path, end, capacity, True), _PIECE + ", ids binary")
    joined = pieces.dropDuplicates(["doc_id", "piece", "ids_crc32"]).select("doc_id", "piece", "ids_crc32", "ids").join(packed, ["doc_id", "piece", "ids_crc32"])
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))  # a sequence's parts: `capacity` tokens at most
    return joined.groupBy("sequence_id").agg(F.array_join(F.transform(parts, lambda p: F.hex(p.ids)), "").alias("ids")).withColumn("ids", F.unhex("ids"))
