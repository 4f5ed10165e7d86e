"""Benchmark decontamination with a distributed positional inverted index.

The index is partitioned by document: a segment holds some megabytes of text as a sorted term list, a dictionary of the
terms' words and, for each term, the rising list of its positions, counted over the segment's words. Segments are rows of a
table. Test items are few and travel to every segment, in blocks of a bounded number of words; a segment looks up their
terms (by a 64-bit hash, then by the word itself) and for each window starts from its rarest term's list, shifted by the
term's place in the window, and intersects the other terms' shifted lists from rare to common until none or whole phrases
are left. So nothing is shuffled, and a word or passage in every document makes lists longer but no task larger.

Words: A-Z lower-cased, runs of 0-9, a-z and anything beyond ASCII. A window is `window` consecutive words of an item; a
shorter item, if it has words, is one window. A proximity match is a span of one document, at most `slop` words longer than
the window, that holds all the window's words, repeats included, in any order.

Defined results: a null text has no words; items without an id or words take no part; item rows that repeat an id are
windows of one item; document rows that repeat an id are rows of their own; an id may be null. Empty tables give no rows, or
documents without hits. Other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, Work, batch, hash_words, slices, utf8

#: Bytes that are no word's to a space, A-Z to a-z.
_WORDS = bytes(b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in LOWER)

_INDEX = pa.schema([("doc_ids", pa.list_(pa.int64())), ("marks", pa.list_(pa.string())), ("doc_ends", pa.binary()), ("terms", pa.binary()), ("words", pa.binary()), ("list_ends", pa.binary()), ("positions", pa.binary())])
_INDEX_DDL = "doc_ids array<long>, marks array<string>, doc_ends binary, terms binary, words binary, list_ends binary, positions binary"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_WORDS).split()


def _segment(part: pa.RecordBatch) -> pa.RecordBatch:
    texts = [t.translate(_WORDS) for t in utf8(part.column("text"))]
    buffer = b" ".join(texts)
    starts, ends, h = hash_words(buffer)
    edges = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    order = np.argsort(h, kind="stable")
    sorted_h = h[order]
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(h)), bool), sorted_h[1:] != sorted_h[:-1])))
    spelled = b" ".join([buffer[a:b] for a, b in zip(starts[order[first]].tolist(), ends[order[first]].tolist(), strict=True)])
    positions = order.astype(np.uint32)
    positions[1:] -= positions[:-1].copy()
    blobs = np.searchsorted(starts, edges).astype(np.int64), sorted_h[first], spelled, np.append(first[1:], len(h)).astype(np.int64), positions
    marks = part.column("mark").to_pylist() if "mark" in part.schema.names else None
    return batch(_INDEX, [part.column("doc_id").to_pylist()], [marks], *([b if isinstance(b, bytes) else b.tobytes()] for b in blobs))


def _indexed(segment_bytes: int):
    def run(batches):
        for rows in batches:
            for part in slices(rows, "text", segment_bytes):
                yield _segment(part)

    return run


def build_index(docs: DataFrame, segment_bytes: int = 4 << 20, mark: F.Column | None = None) -> DataFrame:
    """The index of all documents, as a table: a row a segment. mark: a string that the index carries for each document, for
    those whose documents have no id of their own."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *([] if mark is None else [mark.alias("mark")]))
    return Work(docs.sparkSession, "index").save(slim.mapInArrow(_indexed(segment_bytes), _INDEX_DDL).withColumn("segment", F.monotonically_increasing_id()), "segments")


class Segment:
    def __init__(self, row: dict):
        self.doc_ids, self.marks = row["doc_ids"], row["marks"]
        self.doc_ends, self.list_ends = (np.frombuffer(row[k], np.int64) for k in ("doc_ends", "list_ends"))
        self.terms, self.row = np.frombuffer(row["terms"], np.uint64), row
        self.positions = np.cumsum(np.frombuffer(row["positions"], np.uint32), dtype=np.uint32)

    def lists(self, words: list[bytes]) -> list[np.ndarray]:
        """The positions of each word."""
        none = np.empty(0, np.int64)
        if not len(self.terms) or not words:
            return [none] * len(words)
        at = np.searchsorted(self.terms, hash_words(b" ".join(words))[2])
        spelled, out = self.row["words"].split(b" "), []
        for word, i in zip(words, at.tolist(), strict=True):
            found = i < len(spelled) and spelled[i] == word
            out.append(self.positions[self.list_ends[i - 1] if i else 0 : self.list_ends[i]].astype(np.int64) if found else none)
        return out

    def doc_of(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.doc_ends, position, "right")


def phrase(lists: list[np.ndarray]) -> np.ndarray:
    """The starts of the phrase whose words have these lists: shifted lists are intersected, the rarest first."""
    order = sorted(range(len(lists)), key=lambda k: len(lists[k]))
    starts = lists[order[0]] - order[0]
    for k in order[1:]:
        if not len(starts):
            break
        at = np.searchsorted(lists[k], starts + k)
        starts = starts[(at < len(lists[k])) & (lists[k][np.minimum(at, len(lists[k]) - 1)] == starts + k)]
    return starts


def nearby(lists: dict[bytes, np.ndarray], wanted: dict[bytes, int], most: int):
    """The shortest spans (first, last) of `most` words or fewer with all wanted words, from each place of the rarest one."""
    rarest = min(wanted, key=lambda w: len(lists[w]))
    anchors = lists[rarest]
    for word, places in lists.items():
        low = np.searchsorted(places, anchors - most + 1)
        anchors = anchors[(low < len(places)) & (places[np.minimum(low, len(places) - 1)] < anchors + most)] if len(places) else anchors[:0]
    for anchor in anchors.tolist():
        near = sorted((p, w) for w, places in lists.items() for p in places[np.searchsorted(places, anchor - most + 1) : np.searchsorted(places, anchor + most)].tolist())
        missing, held, left, best = sum(wanted.values()), dict.fromkeys(wanted, 0), 0, None
        for p, w in near:
            held[w] += 1
            missing -= held[w] <= wanted[w]
            while not missing:
                first, word = near[left]
                if p - first < most and first <= anchor <= p and (best is None or p - first < best[1] - best[0]):
                    best = (first, p)
                held[word] -= 1
                missing += held[word] < wanted[word]
                left += 1
        if best:
            yield best


def windows(items: list[tuple[int, list[bytes]]], size: int):
    """(item id, the window's words) of all windows."""
    for item, words in items:
        for i in range(max(1, len(words) - size + 1)):
            if words:
                yield item, words[i : i + size]


def _phrases(sent, size: int):
    def run(batches):
        items = sent.value
        vocabulary = sorted({w for _, words in items for w in words})
        sought = {}
        for item, words in windows(items, size):
            sought.setdefault(tuple(words), set()).add(item)
        for rows in batches:
            for row in rows.to_pylist():
                segment = Segment(row)
                lists = dict(zip(vocabulary, segment.lists(vocabulary), strict=True))
                edges = np.zeros(len(segment.positions) + 1, np.int64)
                found: dict[int, set] = {}
                for words, of in sought.items():
                    own = [lists[w] for w in words]
                    if not all(map(len, own)):
                        continue
                    starts = phrase(own)
                    starts = starts[segment.doc_of(starts) == segment.doc_of(starts + len(words) - 1)]
                    np.add.at(edges, starts, 1)
                    np.add.at(edges, starts + len(words), -1)
                    for doc in np.unique(segment.doc_of(starts)).tolist():
                        found.setdefault(doc, set()).update(of)
                bounds = np.flatnonzero(np.diff(np.concatenate(([0], (np.cumsum(edges[:-1]) > 0).view(np.int8), [0]))))
                yield _rows(row["segment"], segment, bounds[0::2], bounds[1::2], found)

    return run


def _rows(number: int, segment: Segment, firsts: np.ndarray, ends: np.ndarray, found: dict[int, set]) -> pa.RecordBatch:
    """A row for each document: its words, the runs of hit words in it, and the items found. A run that goes on into the next
    document is cut there."""
    doc_ends = segment.doc_ends
    inner = doc_ends[np.searchsorted(firsts, doc_ends, "left") > np.searchsorted(ends, doc_ends, "right")] if len(firsts) else doc_ends[:0]
    firsts, ends = np.union1d(firsts, inner), np.union1d(ends, inner)
    doc = np.searchsorted(doc_ends, firsts, "right")
    begins = np.concatenate((np.zeros(min(1, len(doc_ends)), np.int64), doc_ends[:-1]))
    spans = pa.StructArray.from_arrays([pa.array(firsts - begins[doc], pa.int64()), pa.array(ends - begins[doc], pa.int64())], names=["first", "end"])
    places = np.searchsorted(doc, np.arange(len(doc_ends) + 1)).astype(np.int32)
    n = len(doc_ends)
    return pa.RecordBatch.from_arrays(
        [pa.array([number] * n, pa.int64()), pa.array(np.arange(n)), pa.array(segment.doc_ids, pa.int64()), pa.array(segment.marks or [None] * n, pa.string()), pa.array(doc_ends - begins), pa.ListArray.from_arrays(pa.array(places), spans), pa.array([sorted(found.get(d, ())) for d in range(n)], pa.list_(pa.int64()))],
        ["segment", "place", "doc_id", "mark", "n_words", "spans", "item_ids"],
    )


def _near(sent, size: int, slop: int):
    def run(batches):
        items = sent.value
        vocabulary = sorted({w for _, words in items for w in words})
        for rows in batches:
            for row in rows.to_pylist():
                segment, out = Segment(row), set()
                lists = dict(zip(vocabulary, segment.lists(vocabulary), strict=True))
                for item, words in windows(items, size):
                    wanted = {w: words.count(w) for w in words}
                    for first, last in nearby({w: lists[w] for w in wanted}, wanted, len(words) + slop):
                        a, b = segment.doc_of(np.array([first, last])).tolist()
                        if a == b:
                            start = int(segment.doc_ends[a - 1]) if a else 0
                            out.add((segment.doc_ids[a], item, first - start, last - start))
                schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("first", pa.int64()), ("last", pa.int64())])
                yield batch(schema, *zip(*sorted(out, key=repr), strict=True)) if out else batch(schema, [], [], [], [])

    return run


def _blocks(items: DataFrame, block_words: int):
    """The items with their words, in blocks of bounded size: the driver holds one at a time, which is sent to all segments."""
    held, size = [], 0
    for row in items.where("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").toLocalIterator():
        held.append((row.item_id, words_of(row.text)))
        size += len(held[-1][1])
        if size >= block_words:
            yield held
            held, size = [], 0
    if held:
        yield held


def _by_block(index: DataFrame, items: DataFrame, block_words: int, task, schema: str, only: str) -> tuple[DataFrame, int]:
    """The rows of task(block) over the index for each block of items, and how many blocks there are; of blocks after the first
    those rows for which `only` holds. A block is broadcast, its rows are stored, and it is forgotten: neither the driver nor
    the plan holds more than one."""
    context, work = index.sparkSession.sparkContext, Work(index.sparkSession, "matches")
    stored, held = [], []
    for block in _blocks(items, block_words):
        if held:
            sent = context.broadcast(held)
            rows = index.mapInArrow(task(sent), schema)
            stored.append(work.save(rows.where(only) if stored else rows, f"block-{len(stored)}"))
            sent.destroy()
        held = block
    last = index.mapInArrow(task(context.broadcast(held)), schema)
    if not stored:
        return last, 1
    return reduce(DataFrame.unionByName, [*stored, last.where(only)]), len(stored) + 1


def phrase_matches(index: DataFrame, items: DataFrame, window: int = 10, block_words: int = 1 << 20) -> DataFrame:
    """doc_id, mark, n_words, spans (runs of hit words, [first, end)), item_ids: a row for each document."""
    schema = "segment long, place long, doc_id long, mark string, n_words long, spans array<struct<first:long,end:long>>, item_ids array<long>"
    rows, blocks = _by_block(index, items, block_words, lambda sent: _phrases(sent, window), schema, "size(spans) > 0")
    if blocks > 1:  # a document has a row of the first, and of each that hits it
        flat = lambda c: F.flatten(F.collect_list(c))
        rows = rows.groupBy("segment", "place").agg(F.first("doc_id").alias("doc_id"), F.first("mark").alias("mark"), F.first("n_words").alias("n_words"), F.array_sort(flat("spans")).alias("spans"), F.array_sort(F.array_distinct(flat("item_ids"))).alias("item_ids"))
    return rows.drop("segment", "place")


def hit_words() -> F.Column:
    """The number of words inside any of the sorted spans, which may overlap."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    step = lambda acc, s: F.struct((acc.n + F.greatest(F.lit(0), s.end - F.greatest(s.first, acc.end))).alias("n"), F.greatest(acc.end, s.end).alias("end"))
    return F.aggregate("spans", zero, step, lambda acc: acc.n)


def proximity_matches(index: DataFrame, items: DataFrame, window: int = 10, slop: int = 5, block_words: int = 1 << 20) -> DataFrame:
    """doc_id, item_id, first, last: the spans of the documents' words that match a window nearly."""
    schema = "doc_id long, item_id long, first long, last long"
    return _by_block(index, items, block_words, lambda sent: _near(sent, window, slop), schema, "true")[0].distinct()
