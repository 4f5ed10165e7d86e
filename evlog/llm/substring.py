"""Substring dedup by De Bruijn compaction.

A window of `size` words, a k-mer, is an edge between the two shorter windows in it. What is repeated is found in two rounds
of the keyed exchange. First, each block sends the hashes of its minimisers: for a window the least hash among its inner
windows of half the size, so that equal windows have equal minimisers. Windows whose minimiser stands in one place only are
unique, and most of a corpus is done with. Of the rest each block sends its different k-mers, each with its count and with
the word after it and before it (or that these differ), and learns which are repeated and whether the path is nonbranching
there: all occurrences go on with one word, or come from one.

Repeated k-mers that follow each other along a nonbranching edge, and occur as often as each other, compact into one path;
each occurrence of a path is a row with its source coordinates: first k-mer, length, document, start, and a 128-bit digest of
the words of the whole span, as they are written. Paths meet in a Spark join: spans that agree in first k-mer, length and
digest are one repeated text. The earliest occurrence by (doc_id, start) stays, and every word that a later occurrence covers
goes. A path with as many equal spans as its first k-mer has occurrences holds all occurrences of its k-mers. Where there are
fewer, hashes have met: such spans, and no others, are cut into their single k-mers and joined once more, by these alone.

Words are cut at ASCII white space; words and k-mers are found by 64-bit hashes, and equal only if their digests are.

Defined results: a null text has no words; texts of fewer than `size` words have no windows; rows without an id are the
first in order; rows that repeat an id are ordered by start and then by where they are stored. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Work, hash_words, join_hot, mix
from .exchange import Exchange, Rule, add, answers_of, each_block, same

_GOLD = np.uint64(0x9E37_79B9_7F4A_7C15)
_MINIMISER, _KMER = 1, 2
_SPAN = pa.schema([("path", pa.int64()), ("kmers", pa.int64()), ("digest", pa.binary()), ("count", pa.int64()), ("block", pa.int64()), ("doc_id", pa.int64()), ("place", pa.int64()), ("start", pa.int64())])
_SPAN_DDL = "path long, kmers long, digest binary, count long, block long, doc_id long, place long, start long"


def windows(h: np.ndarray, size: int) -> np.ndarray:
    """A hash of each window of `size` words, put together from windows of powers of two."""
    out, held, done, width = None, h, 0, 1
    n = len(h) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    while True:
        if size & width:
            part = held[done : done + n]
            out = part if out is None else mix(out * _GOLD + part)
            done += width
        if done == size:
            return out
        held = mix(held[:-width] * _GOLD + (held[width:] ^ np.uint64(width)))
        width *= 2


def least_places(h: np.ndarray, width: int) -> np.ndarray:
    """For each run of `width` entries the place of the leftmost least."""
    n = len(h) - width + 1
    place, span = np.arange(len(h)), 1
    pick = lambda a, b: np.where(h[a] <= h[b], a, b)
    while span * 2 <= width:
        place = pick(place[:-span], place[span:])
        span *= 2
    return pick(place[:n], place[width - span : width - span + n])


class Block:
    """A block's words and windows; windows across two documents are left out (inside)."""

    def __init__(self, texts: list[bytes], size: int):
        self.size, buffer = size, b"\n".join(texts)
        starts, ends, self.words = hash_words(buffer)
        edges = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
        self.ends = np.searchsorted(starts, edges)
        self.begins = np.concatenate(([0], self.ends[:-1])) if len(texts) else self.ends
        self.doc = np.repeat(np.arange(len(texts)), self.ends - self.begins)
        n = max(0, len(self.words) - size + 1)
        self.inside = np.flatnonzero(self.doc[:n] == self.doc[size - 1 :]) if n else np.empty(0, np.int64)
        if len(self.inside):
            inner = windows(self.words, (size + 1) // 2)
            self.place = least_places(inner, size - (size + 1) // 2 + 1)[self.inside]
            chosen = np.unique(self.place)
            self.minimisers, at, self.counts = np.unique(inner[chosen], return_inverse=True, return_counts=True)
            self.of = at[np.searchsorted(chosen, self.place)]
        else:
            self.minimisers, self.of, self.counts = (np.empty(0, t) for t in (np.uint64, np.int64, np.int64))

    def repeated(self, answers: list[dict] | None) -> None:
        """starts: the windows whose minimiser stands in two places or more; kmers: theirs, sorted; at: each one's place there."""
        totals = answers_of(answers, _MINIMISER)
        self.starts = self.inside[totals[self.of] > 1] if len(self.of) else self.inside
        all_kmers = windows(self.words, self.size)
        self.kmers, self.at, self.n = np.unique(all_kmers[self.starts], return_inverse=True, return_counts=True)
        side = (mix(self.words) >> np.uint64(32)) | np.uint64(1)
        after, before = self.starts + self.size, self.starts - 1
        has_next = after < self.ends[self.doc[self.starts]]
        has_before = before >= self.begins[self.doc[self.starts]]
        self.next = np.where(has_next, side[np.minimum(after, len(side) - 1)], np.uint64(0)) if len(side) else np.empty(0, np.uint64)
        self.before = np.where(has_before, side[np.maximum(before, 0)], np.uint64(0)) if len(side) else np.empty(0, np.uint64)


def _one(values: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """For each of n keys the one value of its entries; 0 if they differ or one is 0."""
    if not n:
        return np.empty(0, np.uint64)
    order = np.argsort(at, kind="stable")
    heads = np.searchsorted(at[order], np.arange(n))
    low, high = np.minimum.reduceat(values[order], heads), np.maximum.reduceat(values[order], heads)
    return np.where(low == high, low, np.uint64(0))


def _send_minimisers(size: int):
    def run(_, texts, __):
        block = Block(texts, size)
        yield _MINIMISER, block.minimisers, (block.counts,)

    return run


def _send_kmers(size: int):
    def run(_, texts, answers):
        block = Block(texts, size)
        block.repeated(answers)
        n = len(block.kmers)
        yield _KMER, block.kmers, (block.n, _one(block.next, block.at, n), _one(block.before, block.at, n))

    return run


_RULES = {
    _MINIMISER: Rule((add,), lambda totals: np.minimum(totals, 2)),
    # how often, and whether all occurrences go on with one word, or come from one
    _KMER: Rule((add, same, same), lambda totals, after, before: totals * 4 + (after > 0) + 2 * (before > 0)),
}


def _digest(text: bytes) -> bytes:
    return hashlib.blake2b(text, digest_size=16).digest()


def _spans(size: int, single: bool = False):
    """The occurrences of the compacted paths in each block. single: those of each k-mer of the spans in the rows' `broken`."""

    def run(batches):
        for rows in batches:
            broken = rows.column("broken").to_pylist() if single else None
            for i, (number, doc_ids, texts, answers) in enumerate(each_block(rows)):
                block = Block(texts, size)
                block.repeated(answers)
                flags = answers_of(answers, _KMER).astype(np.int64)
                flags = flags[block.at] if len(block.at) else flags
                live = np.flatnonzero(flags >= 8)
                starts, flags, kmers = block.starts[live], flags[live], block.kmers[block.at[live]].view(np.int64)
                if not len(starts):
                    continue
                if single:
                    wanted = np.concatenate([block.begins[b["place"]] + b["start"] + np.arange(b["kmers"]) for b in broken[i]])
                    some = np.flatnonzero(np.isin(starts, wanted))
                    starts, flags, kmers = starts[some], flags[some], kmers[some]
                    heads = np.arange(len(starts))
                else:
                    # an edge goes on the path of the edge before it if both stand next to each other, neither branches there, and
                    # neither occurs more often than the other
                    on = (starts[1:] == starts[:-1] + 1) & (block.doc[starts[1:]] == block.doc[starts[:-1]]) & (flags[:-1] & 1 > 0) & (flags[1:] & 2 > 0) & (flags[:-1] >> 2 == flags[1:] >> 2)
                    heads = np.flatnonzero(np.concatenate(([True], ~on)))
                lengths = np.diff(np.append(heads, len(starts)))
                docs, first = block.doc[starts[heads]].tolist(), starts[heads].tolist()
                spelled = b"\n".join(texts).split()  # the words that were hashed, in the same order
                ends = np.cumsum(np.fromiter(map(len, spelled), np.int64, len(spelled)) + 1)
                buffer, begins = b" ".join(spelled), np.concatenate(([0], ends))
                digests = [_digest(buffer[begins[s] : begins[s + n + size - 1]].rstrip(b" ")) for s, n in zip(first, lengths.tolist(), strict=True)]
                own = [doc_ids[d] for d in docs]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(kmers[heads]), pa.array(lengths), pa.array(digests, pa.binary()), pa.array(flags[heads] >> 2), pa.array([number] * len(own), pa.int64()), pa.array(own, pa.int64()), pa.array(docs, pa.int64()), pa.array(np.array(first, np.int64) - block.begins[docs])],
                    _SPAN.names,
                )

    return run


def _kept(size: int):
    """Each document's words less those that its removed spans cover."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])

    def run(batches):
        for rows in batches:
            gone = rows.column("gone").to_pylist()
            for i, (_, doc_ids, texts, _) in enumerate(each_block(rows)):
                spans: dict[int, list] = {}
                for g in gone[i] or []:
                    spans.setdefault(g["place"], []).append((g["start"], g["kmers"]))
                ids, n, removed, kept, held = [], [], [], [], 0
                for place, (doc_id, text) in enumerate(zip(doc_ids, texts, strict=True)):
                    words, edges = text.split(), None
                    if place in spans:
                        edges = np.zeros(len(words) + 1, np.int64)
                        for start, kmers in spans[place]:
                            edges[start] += 1
                            edges[start + kmers + size - 1] -= 1
                        left = np.flatnonzero(np.cumsum(edges[:-1]) == 0).tolist()
                        rest = [words[k] for k in left]
                    else:
                        rest = words
                    ids.append(doc_id)
                    n.append(len(words))
                    removed.append(len(words) - len(rest))
                    kept.append(b" ".join(rest).decode())
                    held += len(text)
                    if held > 16 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((ids, n, removed, kept), schema, strict=True)], schema=schema)
                        ids, n, removed, kept, held = [], [], [], [], 0
                if ids:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((ids, n, removed, kept), schema, strict=True)], schema=schema)

    return run


def dedup_substrings(docs: DataFrame, size: int = 20) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words that stay, joined by a space): a row for each document."""
    with Exchange(docs, "substring") as exchange:
        work = exchange.work
        total = exchange.blocks.agg(F.sum(F.expr("aggregate(texts, 0L, (a, t) -> a + octet_length(t))"))).first()[0] or 0
        minimisers = exchange.send(_send_minimisers(size), {_MINIMISER: _RULES[_MINIMISER]}, total // 30, "minimisers")
        work.release()
        kmers = exchange.send(_send_kmers(size), {_KMER: _RULES[_KMER]}, total // 20, "kmers", exchange.meet(minimisers))
        work.release()
        met = exchange.meet(minimisers, kmers)
        spans, paths = _joined(work, met.mapInArrow(_spans(size), _SPAN_DDL), "paths")
        broken = paths.where("n <> count")
        if broken.isEmpty():
            tables = [(spans, paths)]
        else:
            whole = work.save(spans.join(broken.select("name"), "name", "left_anti"), "whole-spans")
            cut = spans.join(broken.select("name"), "name", "left_semi").groupBy("block").agg(F.collect_list(F.struct("place", "start", "kmers")).alias("broken"))
            again = met.join(cut, "block").mapInArrow(_spans(size, True), _SPAN_DDL)
            tables = [(whole, paths.where("n = count")), _joined(work, again, "kmers-alone")]
        for name in ("minimisers", "kmers"):
            work.drop(name)
        work.release()
        later = [join_hot(own, found.drop("count"), "name", "n", own.count()).where(F.col("at") != F.col("first")).select("block", "place", "start", "kmers") for own, found in tables]
        gone = reduce(DataFrame.unionByName, later).groupBy("block").agg(F.collect_list(F.struct("place", "start", "kmers")).alias("gone"))
        out = work.save(exchange.blocks.join(gone.hint("shuffle_hash"), "block", "left").mapInArrow(_kept(size), "doc_id long, n_words long, n_removed long, kept string"), "kept")
    for name in ("paths-spans", "paths", "whole-spans", "kmers-alone-spans", "kmers-alone"):
        work.drop(name)
    return out


def _joined(work: Work, spans: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """The spans under their names, and for each name its first span, its spans, and the occurrences of its first k-mer."""
    place = F.struct(F.coalesce(F.col("doc_id"), F.lit(-(2**63))).alias("doc_id"), "start", "block", "place")
    text = F.sha2(F.concat(F.hex("path"), F.lit("/"), F.hex("kmers"), F.lit("/"), F.hex("digest")), 256)
    named = work.save(spans.select(text.alias("name"), "kmers", "count", "block", "place", "start", place.alias("at")), f"{name}-spans")
    found = work.save(named.groupBy("name").agg(F.min("at").alias("first"), F.count("*").alias("n"), F.max("count").alias("count")), name)
    return named.drop("count"), found


