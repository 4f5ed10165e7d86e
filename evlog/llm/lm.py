"""Language-model scoring by deleted interpolation.

A token's probability mixes maximum-likelihood estimates of all orders: λ_n c(context, token) / c(context) for n from
`order` down to 2, λ_1 c(token) / N, and λ_0 / (V + 1). The weights depend on how often the longest context was seen, by
powers of two, and are learned by expectation-maximisation on held-out counts: every training token is held out in turn,
its estimates coming from all counts less itself. The estimates of all training tokens are counted by context-frequency
bucket and by size (in thirds of an octave), so that EM runs on a table whose size does not depend on the corpus.

Counts come through the keyed exchange: each block of documents sends its different n-grams with their training counts and
gets the corpus's counts back. n-grams are told apart by 64-bit hashes.

Defined results: a null text is empty and has the end token alone; a text's first context is the beginning, seen as often as
there are training texts; rows without an id train; rows that repeat count each. Without training texts every token has
probability 1 / (V + 1) = 1. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, hash_words, mix
from .exchange import Exchange, Rule, add, answers_of, each_block

_END = np.uint64(0xE703_7ED1_A0B4_28DB)
_GOLD = np.uint64(0x9E37_79B9_7F4A_7C15)
_STEPS = 3  # sizes of estimates an octave
_SIZES = 40 * _STEPS + 2  # size 0: no estimate


def held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 1


class Tokens:
    """A block's tokens and n-grams. keys[n]: the different n-grams, sorted; at[n]: each token's n-gram among them."""

    def __init__(self, doc_ids: list[int | None], texts: list[bytes], order: int):
        buffer = b"\n".join(texts).translate(LOWER)
        starts, _, words = hash_words(buffer)
        edges = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
        upto = np.searchsorted(starts, edges)
        self.ends = upto + np.arange(len(texts))  # places of the end tokens
        self.firsts = np.concatenate(([0], self.ends[:-1] + 1))
        tokens = np.full(len(words) + len(texts), _END)
        real = np.ones(len(tokens), bool)
        real[self.ends] = False
        tokens[real] = words
        self.doc_ids, self.held_out = doc_ids, np.array([held_out(d) for d in doc_ids])
        self.training = np.repeat(~self.held_out, self.ends - self.firsts + 1)
        self.keys, self.at, gram = [None], [None], tokens
        for n in range(1, order + 1):
            if n > 1:
                before = np.concatenate((gram[:1], gram[:-1]))
                before[self.firsts] = np.uint64(n)
                gram = mix(mix(before + _GOLD) ^ tokens)
            keys, at = np.unique(gram, return_inverse=True)
            self.keys.append(keys)
            self.at.append(at)

    def counts(self, answers: list[dict]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """For n = 1, 2 … each token's n-gram count, and the count of the context before it (of n-1 tokens; n = 1: none)."""
        own = [None, *[answers_of(answers, n).astype(np.int64) for n in range(1, len(self.keys))]]
        texts_seen = own[1][np.searchsorted(self.keys[1], _END)] if len(own[1]) else 0
        grams = [own[n][self.at[n]] for n in range(1, len(self.keys))]
        contexts = [None]
        for g in grams[:-1]:
            before = np.concatenate((g[:1], g[:-1]))
            before[self.firsts] = texts_seen
            contexts.append(before)
        return grams, contexts


def frequency_bucket(counts: np.ndarray) -> np.ndarray:
    """0 for none, else 1 + the whole part of log2."""
    return np.where(counts > 0, np.frexp(np.maximum(counts, 1).astype(np.float64))[1], 0)


def _send(order: int):
    def run(doc_ids, texts, _):
        tokens = Tokens(doc_ids, texts, order)
        for n in range(1, order + 1):
            yield n, tokens.keys[n], (np.bincount(tokens.at[n][tokens.training], minlength=len(tokens.keys[n])),)

    return run


#: How an n-gram's counts are answered; of single tokens also how many there are, different and in all.
_COUNTS = Rule((add,), lambda totals: totals)
_TOKEN_COUNTS = Rule((add,), lambda totals: totals, lambda totals: [int((totals > 0).sum()), int(totals.sum())])


def _estimates(grams: list, contexts: list, n_tokens: int, less: int) -> list[np.ndarray]:
    """Maximum-likelihood estimates of orders 1, 2 …, from the counts less the token itself (less = 1) or all (0)."""
    out = [(grams[0] - less) / max(1, n_tokens - less)]
    for g, c in zip(grams[1:], contexts[1:], strict=True):
        out.append(np.where(c > less, (g - less) / np.maximum(1, c - less), 0.0))
    return out


def _sizes(estimates: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.where(estimates > 0, 1 + np.clip(np.rint(-_STEPS * np.log2(np.maximum(estimates, 1e-300))), 0, _SIZES - 2), 0).astype(np.int64)


def _held_out_counts(order: int, n_tokens: int):
    """Rows (bucket, sizes as one number, n) of each block's training tokens."""

    def run(batches):
        for rows in batches:
            for _, doc_ids, texts, answers in each_block(rows):
                tokens = Tokens(doc_ids, texts, order)
                grams, contexts = ([None if x is None else x[tokens.training] for x in c] for c in tokens.counts(answers))
                cell = frequency_bucket(contexts[-1] - 1) if order > 1 else np.zeros(len(grams[0]), np.int64)
                for e in _estimates(grams, contexts, n_tokens, 1):
                    cell = cell * _SIZES + _sizes(e)
                cells, n = np.unique(cell, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(cells.astype(np.int64)), pa.array(n.astype(np.int64))], ["cell", "n"])

    return run


def learn_weights(cells: np.ndarray, n: np.ndarray, order: int, vocabulary: int, rounds: int = 60) -> np.ndarray:
    """λ by bucket (rows) for orders 0, 1, 2 …: EM over the held-out counts. A token more for each weight keeps all above 0."""
    estimates = [np.full(len(cells), 1.0 / (vocabulary + 1))]
    rest, sizes = cells.copy(), []
    for _ in range(order):
        sizes.append(rest % _SIZES)
        rest //= _SIZES
    estimates += [np.where(s > 0, 2.0 ** (-(s - 1) / _STEPS), 0.0) for s in reversed(sizes)]
    p, buckets = np.array(estimates).T, 64
    weights = np.full((buckets, order + 1), 1.0 / (order + 1))
    for _ in range(rounds):
        share = weights[rest] * p
        share *= (n / np.maximum(share.sum(1), 1e-300))[:, None]
        got = 1.0 + np.array([np.bincount(rest, share[:, k], minlength=buckets) for k in range(order + 1)]).T
        weights = got / got.sum(1, keepdims=True)
    return weights


def _scored(order: int, n_tokens: int, vocabulary: int, weights: np.ndarray):
    def run(batches):
        for rows in batches:
            for _, doc_ids, texts, answers in each_block(rows):
                tokens = Tokens(doc_ids, texts, order)
                grams, contexts = tokens.counts(answers)
                w = weights[frequency_bucket(contexts[-1]) if order > 1 else np.zeros(len(grams[0]), np.int64)]
                p, weight = w[:, 0] / (vocabulary + 1), w[:, 0].copy()
                # where a context was never seen its order has no estimate: the others share its weight
                for k, (e, c) in enumerate(zip(_estimates(grams, contexts, n_tokens, 0), contexts, strict=True), 1):
                    there = np.ones(len(e), bool) if c is None else c > 0
                    p += np.where(there, w[:, k] * e, 0.0)
                    weight += np.where(there, w[:, k], 0.0)
                p /= np.maximum(1e-300, weight)
                base = np.log10((grams[0] + 0.5) / (n_tokens + 0.5 * (vocabulary + 1)))
                total = lambda x: np.add.reduceat(x, tokens.firsts)  # noqa: E731, B023
                lengths = tokens.ends - tokens.firsts + 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids, pa.int64()), pa.array(tokens.held_out), pa.array(lengths), pa.array(total((grams[0] > 0).astype(np.int64))), pa.array(np.full(len(lengths), n_tokens)), pa.array(total(base)), pa.array(total(np.log10(p)))],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return run


def score(docs: DataFrame, order: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: a row for each document."""
    with Exchange(docs, "lm") as exchange:
        work = exchange.work
        bytes_ = exchange.blocks.agg(F.sum(F.expr("aggregate(texts, 0L, (a, t) -> a + octet_length(t))"))).first()[0] or 0
        answers = exchange.send(_send(order), {n: _COUNTS if n > 1 else _TOKEN_COUNTS for n in range(1, order + 1)}, bytes_ // 6 * order, "counts")
        vocabulary, n_tokens = answers.facts(1) or (0, 0)
        work.release()
        met = exchange.meet(answers)
        counted = met.mapInArrow(_held_out_counts(order, n_tokens), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
        cells = work.save(counted, "cells").toPandas()  # 64 buckets x _SIZES**order at most, whatever the corpus
        untrained = np.eye(1, order + 1).repeat(64, axis=0)  # all weight on order 0
        weights = untrained if not n_tokens else learn_weights(cells["cell"].to_numpy(np.int64), cells["n"].to_numpy(np.float64), order, vocabulary)
        schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
        out = work.save(met.mapInArrow(_scored(order, n_tokens, vocabulary, weights), schema), "scores")
    work.drop("counts")
    work.drop("cells")
    return out
