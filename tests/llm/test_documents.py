"""Operators over documents, held against brute force, on a small table with nulls, repeats, ties, empty and odd texts."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from evlog.llm import completion, decontaminate, langid, linededup, lm, packing, simhash, substring
from evlog.llm.queries import tokenizer_path

DDL = "doc_id long, text string, lang string, source string, n_chars long, hash string, batch int, code long"
SPACES = r"[^\x20\x09-\x0D]+"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    words = [f"{a}{b}" for a in ("Ka", "lo", "mi", "né", "Tu") for b in ("ra", "se", "ti", "vo", "ßu", "nn")]
    sentence = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, line = sentence(45), "  A Line that stands in very many documents of this table \t"
    base = sentence(120)
    texts = [None, "", " \n\t ", "one", "Two words", "three little words", "12345 !!!", sentence(30), base, base, base + " end", base.replace("Kara", "Kasa", 1)]
    texts += [sentence(20) + " " + passage + " " + sentence(rng.randrange(1, 30)) for _ in range(6)]
    texts += [sentence(12) + "\n" + line + "\n" + sentence(9) for _ in range(7)] + [line.upper() + "\n\n" + line]
    texts += [("ab " * 60).strip(), ("x y z " * 30), sentence(9000), "né" * 3000, "emoji 😀 " * 12, "a  b\t\tc\x0bd\x0ce\r\nf"]
    out = [(i * 3 + 1, t, "ab"[i % 2] if i % 5 else None, None if i % 4 == 0 else "s", None, "h", 1, 2) for i, t in enumerate(texts)]
    return [*out, out[8], (None, base, None, None, None, None, None, None), (None, passage, "a", "s", 1, "h", 1, 2)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DDL).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DDL)


def listed(df, *columns):
    return Counter(tuple(r) for r in df.select(*columns).collect())


# -- line dedup


def lines_by_hand(rows, min_chars=40, min_docs=5):
    key = lambda x: lower(x.strip(" \t\n\v\f\r"))
    holders = defaultdict(list)
    for doc, text, *_ in rows:
        if doc is not None:
            for k in {key(x) for x in (text or "").split("\n")}:
                holders[k].append(doc)
    out = []
    for doc, text, *_ in rows:
        own = (text or "").split("\n")
        gone = lambda x: doc is not None and len(key(x)) >= min_chars and len(holders[key(x)]) >= min_docs and max(holders[key(x)]) != doc  # noqa: E731, B023
        kept = [x for x in own if not gone(x)]
        out.append((doc, None if text is None else "\n".join(kept), len(own), len(own) - len(kept)))
    return Counter(out)


@pytest.mark.parametrize("batches, fanout", [(1, 4), (5, 2)])
def test_line_dedup(docs, rows, batches, fanout):
    found = linededup.dedup_lines(docs, least_batches=batches, fanout=fanout)
    assert listed(found, "doc_id", "text", "_n_lines", "_n_dropped") == lines_by_hand(rows)
    assert found.columns == [*docs.columns, "_n_lines", "_n_dropped"]
    assert found.agg(F.sum("_n_dropped")).first()[0] > 5


def test_line_dedup_of_nothing(empty):
    assert linededup.dedup_lines(empty).count() == 0


def test_runs_are_sorted_levelled_and_compacted(spark):
    from evlog.llm.common import Work

    lines = lambda number, width=3: spark.createDataFrame([(bytes([k]), 100 - number) for k in range(number, number + width)], "hash binary, doc_id long")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with large runs
    try:
        with linededup.Runs(Work(spark, "runs"), fanout=2) as runs:
            for number in range(7):
                runs.add(lines(number))
            assert [len(level) for level in runs.levels] == [1, 1, 1]
            merged = {bytes(r.hash): (r.n, r.keeper) for r in runs.merged().collect()}
            assert merged[bytes([2])] == (3, 100) and merged[bytes([6])] == (3, 96) and merged[bytes([8])] == (1, 94)
            for table in runs.all():
                hashes = [bytes(r.hash) for r in table.collect()]
                assert len(set(hashes)) == len(hashes)
            # a batch is shuffled once, runs are joined and merged as they lie
            new = plan(runs.new(lines(7)))
            assert new.count("Exchange") == 1 and new.count("SortMergeJoin") == 3 and new.count("Sort [") == 1 and new.count("Bucketed: true") == 3
            assert "Exchange" not in plan(runs.merged()) and "Sort [" not in plan(runs.merged())
            names = [name for level in runs.levels for name, _ in level]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert not any(spark.catalog.tableExists(name) for name in names) and spark.conf.get(linededup._ORDERING) == "false"


def test_an_id_far_from_the_others_makes_no_difference(spark):
    line = "a line that is long enough to be looked at, and more"
    docs = spark.createDataFrame([(i, line) for i in [*range(40), 2**62, -(2**62)]] + [(5, line)] * 3, "doc_id long, text string")
    found = linededup.dedup_lines(docs, batch_docs=5, most_batches=6)
    assert {r.doc_id for r in found.where("_n_dropped = 0").collect()} == {2**62} and found.count() == 45


# -- SimHash


def print_of(text):
    words = re.findall(SPACES.encode(), lower(text).encode())
    parts = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    counts = [0] * 64
    for p in parts:
        h = xxhash.xxh64_intdigest(p, 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(parts))


def components_by_hand(codes, distance=3):
    codes = sorted(set(codes))
    root = {c: c for c in codes}

    def find(c):
        while root[c] != c:
            c = root[c]
        return c

    for i, a in enumerate(codes):
        for b in codes[i + 1 :]:
            if (a ^ b).bit_count() <= distance and find(a) != find(b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {c: find(c) for c in codes}


def test_simhash(docs, rows):
    codes = [print_of(t) for _, t, *_ in rows]
    root = components_by_hand(codes)
    least = defaultdict(lambda: None)
    for (doc, *_), code in zip(rows, codes, strict=True):
        if doc is not None:
            least[root[code]] = doc if least[root[code]] is None else min(doc, least[root[code]])
    want = Counter((doc, code - (code >> 63 << 64), least[root[code]]) for (doc, *_), code in zip(rows, codes, strict=True))
    assert listed(simhash.near_duplicates(docs), "doc_id", "code", "component_id") == want


def test_simhash_keeps_one_of_each_group(docs, rows):
    kept = [r.doc_id for r in simhash.keep_one(docs.where("doc_id is not null")).collect()]
    root = components_by_hand([print_of(t) for _, t, *_ in rows])
    groups = defaultdict(set)
    for doc, text, *_ in rows:
        if doc is not None:
            groups[root[print_of(text)]].add(doc)
    assert sorted(kept) == sorted(min(g) for g in groups.values())


def test_simhash_of_nothing(empty):
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("group_rows", [1 << 21, 10])
def test_gray_index_in_groups_and_split_groups(spark, group_rows):
    """Clusters of codes and unrelated ones; with small groups every group is split again and no link is lost."""
    from evlog.llm.common import Work
    from evlog.llm.components import components

    rng = random.Random(group_rows)
    codes = set()
    for _ in range(30):
        code = rng.getrandbits(64)
        for _ in range(25):
            codes.add(code ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(0, 4))))
    signed = [(c - (c >> 63 << 64),) for c in codes]
    groups = simhash._grouped(spark.createDataFrame(signed, "code long"), 3, group_rows).repartition("group").sortWithinPartitions("group")
    found = components(Work(spark, "test"), groups.mapInArrow(simhash._linked(3, most=50), "a long, b long"))
    want = components_by_hand(codes)
    by_root = defaultdict(list)
    for c, r in want.items():
        by_root[r].append(c - (c >> 63 << 64))
    assert {r.a: r.b for r in found.collect()} == {c: min(g) for g in by_root.values() for c in g if c != min(g)}


def test_components_of_a_long_chain(spark):
    from evlog.llm.common import Work
    from evlog.llm.components import components

    chain = [(i + 1, i) for i in range(60)] + [(200, 100)]
    found = components(Work(spark, "test"), spark.createDataFrame(chain, "a long, b long"))
    assert {r.a: r.b for r in found.collect()} == {i: 0 for i in range(1, 61)} | {200: 100}


# -- decontamination

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def hits_by_hand(rows, items, window):
    sought = []
    for item, text in items:
        words = WORD.findall(lower(text).encode())
        if item is not None and words:
            sought += [(item, words[i : i + window]) for i in range(max(1, len(words) - window + 1))]
    out = []
    for doc, text, *_ in rows:
        words, hit, found = WORD.findall(lower(text).encode()), set(), set()
        for item, own in sought:
            for i in range(len(words) - len(own) + 1):
                if words[i : i + len(own)] == own:
                    hit |= set(range(i, i + len(own)))
                    found.add(item)
        out.append((doc, len(words), len(hit), tuple(sorted(found))))
    return Counter(out)


@pytest.mark.parametrize("block_words", [1 << 20, 15])
def test_decontamination(spark, docs, rows, block_words):
    passage = rows[-1][1]
    items = [(7, passage), (2, " ".join(passage.split()[5:30]).upper()), (3, "Two, WORDS!"), (4, None), (5, "..."), (None, passage), (7, "three little"), (9, "ab ab ab ab ab ab ab ab ab ab ab ab")]
    index = decontaminate.build_index(docs, segment_bytes=4000)
    found = decontaminate.phrase_matches(index, spark.createDataFrame(items, "item_id long, text string"), block_words=block_words).withColumn("n_hit", decontaminate.hit_words())
    got = Counter((r.doc_id, r.n_words, r.n_hit, tuple(r.item_ids)) for r in found.collect())
    assert got == hits_by_hand(rows, items, 10)
    assert sum(bool(k[2]) for k in got.elements()) > 8


def test_decontamination_of_nothing(spark, docs, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.phrase_matches(decontaminate.build_index(empty), none).count() == 0
    found = decontaminate.phrase_matches(decontaminate.build_index(docs), none)
    assert found.count() == docs.count() and found.where(F.size("spans") > 0).count() == 0


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "x a q b c y"), (2, "c z b a"), (3, "a b"), (4, "a . . . . . . b c"), (5, "a a b c"), (6, "a u v w s t b c")], "doc_id long, text string")
    items = spark.createDataFrame([(9, "A b c")], "item_id long, text string")
    found = decontaminate.proximity_matches(decontaminate.build_index(docs), items, window=3, slop=1)
    assert listed(found, "doc_id", "item_id", "first", "last") == Counter({(1, 9, 1, 4): 1, (2, 9, 0, 3): 1, (4, 9, 0, 2): 1, (5, 9, 1, 3): 1})


# -- substring dedup


def removed_by_hand(rows, size):
    seen, out = set(), []
    for doc, text, *_ in sorted(rows, key=lambda r: r[0]):
        words = re.findall(SPACES, text or "")
        gone = set()
        for i in range(len(words) - size + 1):
            key = tuple(words[i : i + size])
            if key in seen:
                gone |= set(range(i, i + size))
            seen.add(key)
        kept = [w for i, w in enumerate(words) if i not in gone]
        out.append((doc, len(words), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("size", [20, 5, 2])
def test_substring_dedup(spark, rows, size):
    own = {r[0]: r for r in rows if r[0] is not None}.values()
    docs = spark.createDataFrame(list(own), DDL).repartition(3)
    found = substring.dedup_substrings(docs, size).withColumn("kept", F.sha2("kept", 256))
    assert listed(found, "doc_id", "n_words", "n_removed", "kept") == removed_by_hand(own, size)


@pytest.mark.parametrize("bits", [0, 1, 3])
def test_substring_dedup_where_hashes_meet(spark, rows, monkeypatch, bits):
    """The words beside a k-mer are told apart by a few bits only, so that paths are compacted across branches: those spans are
    cut again, and the result is the same."""
    own = list({r[0]: r for r in rows if r[0] is not None}.values())
    own += [(1000 + i, " ".join(["p q r s t u"] * 3 + [f"x{i % 3} y{i % 2} z w v"] * 3), "a", "s", 1, "h", 1, 2) for i in range(8)]
    real = substring.Block.repeated

    def blurred(self, answers):
        real(self, answers)
        for side in (self.next, self.before):
            side[side > 0] = (side[side > 0] >> np.uint64(5)) % np.uint64(1 << bits) + np.uint64(1)

    monkeypatch.setattr(substring.Block, "repeated", blurred)
    for size in (20, 4):
        found = substring.dedup_substrings(spark.createDataFrame(own, DDL), size).withColumn("kept", F.sha2("kept", 256))
        assert listed(found, "doc_id", "n_words", "n_removed", "kept") == removed_by_hand(own, size)


def test_kmers_whose_hashes_meet_are_told_apart(spark, monkeypatch):
    """All k-mers of a size have one of eight hashes."""
    real = substring.windows
    monkeypatch.setattr(substring, "windows", lambda h, size: real(h, size) % np.uint64(8) if size == 5 else real(h, size))
    rng = random.Random(4)
    own = [(i, " ".join(rng.choice("abc") for _ in range(30))) for i in range(6)]
    found = substring.dedup_substrings(spark.createDataFrame(own, "doc_id long, text string"), 5).withColumn("kept", F.sha2("kept", 256))
    assert listed(found, "doc_id", "n_words", "n_removed", "kept") == removed_by_hand(own, 5)


@pytest.mark.parametrize("fan", [2, 4, 4096])
def test_exchange_by_one_level_and_two(docs, rows, monkeypatch, fan):
    """With tiny buckets and a small fan keys go through nodes; counts are the same."""
    monkeypatch.setattr(lm.Exchange.__init__, "__defaults__", (4000, 64, fan, 2))
    assert listed(lm.score(docs).select("doc_id", "n_tokens", "n_known", "train_tokens", F.round("score", 6).alias("score")), "doc_id", "n_tokens", "n_known", "train_tokens", "score") == monkeypatch_free(docs)
    own = {r[0]: r for r in rows if r[0] is not None}.values()
    found = substring.dedup_substrings(docs.sparkSession.createDataFrame(list(own), DDL).repartition(3), 5).withColumn("kept", F.sha2("kept", 256))
    assert listed(found, "doc_id", "n_words", "n_removed", "kept") == removed_by_hand(own, 5)


_WHOLE = {}


def monkeypatch_free(docs):
    """The scores with the usual buckets."""
    if not _WHOLE:
        defaults, lm.Exchange.__init__.__defaults__ = lm.Exchange.__init__.__defaults__, (4 << 20, 1 << 20, 4096, 512)
        _WHOLE["scores"] = listed(lm.score(docs).select("doc_id", "n_tokens", "n_known", "train_tokens", F.round("score", 6).alias("score")), "doc_id", "n_tokens", "n_known", "train_tokens", "score")
        lm.Exchange.__init__.__defaults__ = defaults
    return _WHOLE["scores"]


def test_substring_dedup_with_null_and_repeated_ids(docs, empty):
    found = substring.dedup_substrings(docs)
    assert found.count() == docs.count()
    base = found.where("doc_id = 25").orderBy("n_removed").collect()
    assert [r.n_removed for r in base] == [120, 120]  # the row without an id comes first
    assert substring.dedup_substrings(empty).count() == 0


# -- language model


def test_lm_counts_and_scores(docs, rows):
    end = object()
    tokens = {i: [*re.findall(SPACES, lower(t)), end] for i, (_, t, *_) in enumerate(rows)}
    out = lambda d: d is not None and zlib.crc32(str(d).encode()) % 5 == 1
    train = [tokens[i] for i, r in enumerate(rows) if not out(r[0])]
    one = Counter(t for own in train for t in own)
    two = Counter((a, b) for own in train for a, b in zip([None, *own], own, strict=False))
    before = Counter(a for own in train for a in [None, *own[:-1]])
    n, v = sum(one.values()), len(one)
    bucket = lambda c: c.bit_length()
    cells = Counter()
    for own in train:
        for a, b in zip([None, *own], own, strict=False):
            cell = bucket(before[a] - 1)
            for e in ((one[b] - 1) / (n - 1), (two[a, b] - 1) / (before[a] - 1) if before[a] > 1 else 0.0):
                cell = cell * lm._SIZES + int(lm._sizes(np.array([e]))[0])
            cells[cell] += 1
    weights = lm.learn_weights(np.array(list(cells)), np.array(list(cells.values()), float), 2, v)
    assert np.allclose(weights.sum(1), 1) and (weights > 0).all()
    want = {}
    for i, (doc, *_) in enumerate(rows):
        base = score = 0.0
        for a, b in zip([None, *tokens[i]], tokens[i], strict=False):
            base += np.log10((one[b] + 0.5) / (n + 0.5 * (v + 1)))
            w = weights[bucket(before[a])]
            p = w[0] / (v + 1) + w[1] * one[b] / n
            score += np.log10(p + w[2] * two[a, b] / before[a] if before[a] else p / (1 - w[2]))
        want.setdefault(doc, []).append((out(doc), len(tokens[i]), sum(t in one for t in tokens[i]), n, base, score))
    got = defaultdict(list)
    for r in lm.score(docs).collect():
        got[r.doc_id].append(tuple(r)[1:])
    assert got.keys() == want.keys()
    for doc in want:
        for a, b in zip(sorted(got[doc]), sorted(want[doc]), strict=True):
            assert a[:4] == b[:4] and a[4:] == pytest.approx(b[4:], rel=1e-9)


class LmByHand:
    """The model over dictionaries, with an EM of its own over all training tokens one by one."""

    def __init__(self, texts, order):
        self.order, self.train = order, [[*t.split(), None] for t in texts]
        self.counts = [None, *[Counter(self.gram(n, own, i) for own in self.train for i in range(len(own))) for n in range(1, order + 1)]]
        self.n, self.v = sum(self.counts[1].values()), len(self.counts[1])
        tokens = [(self.bucket(own, i, 1), [1 / (self.v + 1), *map(self.rounded, self.estimates(own, i, 1))]) for own in self.train for i in range(len(own))]
        self.weights = [[1 / (order + 1)] * (order + 1)] * 64
        for _ in range(60):
            got = [[1.0] * (order + 1) for _ in range(64)]
            for b, p in tokens:
                share = [w * x for w, x in zip(self.weights[b], p, strict=True)]
                for k, x in enumerate(share):
                    got[b][k] += x / sum(share)
            self.weights = [[x / sum(g) for x in g] for g in got]

    @staticmethod
    def rounded(e):
        return 2.0 ** (round(3 * np.log2(e)) / 3) if e else 0.0

    def gram(self, n, own, i):
        return own[i] if n == 1 else (n, own[0]) if i == 0 else (self.gram(n - 1, own, i - 1), own[i])

    def context(self, n, own, i):
        return len(self.train) if i == 0 else self.counts[n - 1][self.gram(n - 1, own, i - 1)]

    def bucket(self, own, i, less=0):
        return (self.context(self.order, own, i) - less).bit_length() if self.order > 1 else 0

    def estimates(self, own, i, less=0):
        out = [(self.counts[1][own[i]] - less) / (self.n - less)]
        for n in range(2, self.order + 1):
            c = self.context(n, own, i) - less
            out.append((self.counts[n][self.gram(n, own, i)] - less) / c if c > 0 else 0.0)
        return out

    def p(self, own, i):
        w, e = self.weights[self.bucket(own, i)], self.estimates(own, i)
        there = [True, True, *[self.context(n, own, i) > 0 for n in range(2, self.order + 1)]]
        return sum(x * y for x, y, t in zip(w, [1 / (self.v + 1), *e], there, strict=True) if t) / sum(x for x, t in zip(w, there, strict=True) if t)


@pytest.mark.parametrize("order", [1, 2, 3])
def test_lm_equals_dictionaries_and_sums_to_one(spark, order):
    rng = random.Random(order)
    rows = [(i, " ".join(rng.choice("aabbcd") for _ in range(rng.randint(0, 12)))) for i in range(60)] + [(1000 + i, " ".join(rng.choice("abcdxy") for _ in range(6))) for i in range(30)]
    model = LmByHand([t for i, t in rows if zlib.crc32(str(i).encode()) % 5 != 1], order)
    scores = {r.doc_id: r.score for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string"), order).collect()}
    for i, text in rows:
        own = [*text.split(), None]
        assert scores[i] == pytest.approx(sum(np.log10(model.p(own, k)) for k in range(len(own))), rel=1e-6), text
    for context in ("", "a", "a b", "x", "a x", "x a", "d d c"):
        assert sum(model.p([*context.split(), w], len(context.split())) for w in [*model.counts[1], "unseen"]) == pytest.approx(1)


@pytest.mark.parametrize("order", [1, 3])
def test_lm_other_orders_give_probabilities(docs, order):
    for r in lm.score(docs, order).collect():
        assert r.score < 0 and r.n_known <= r.n_tokens


def test_lm_of_nothing_and_without_training(spark, empty):
    assert lm.score(empty).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)
    row = lm.score(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).first()
    assert (row.train_tokens, row.n_known, row.n_tokens) == (0, 0, 3) and row.score == pytest.approx(0)


def test_lm_beats_its_base_on_held_out_texts(spark, sf):
    scored = lm.score(spark.read.parquet(f"{sf}/documents.parquet")).where("held_out")
    assert scored.agg(F.sum(F.col("score") - F.col("base_score"))).first()[0] > 0


# -- language ID


def test_language_id_on_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("held_out", langid.held_out())
    model = langid.train(docs.where("not held_out"))
    found = langid.predict(docs.where("held_out"), model)
    assert found.agg(F.avg((F.col("_lang") == F.col("lang")).cast("int"))).first()[0] > 0.98
    assert found.where("_score < 0 or _score > 1").count() == 0


def test_language_id_of_odd_texts(docs, rows):
    found = langid.predict(docs, langid.train(docs))
    assert found.columns == [*docs.columns, "_lang", "_score"] and found.count() == len(rows)
    for r in found.collect():
        assert (r["_lang"] == "und") == (not any(c.isalpha() for c in r.text or "")), r.text


def test_language_id_without_labels(docs, empty):
    none = langid.train(docs.where("lang = 'zz'"))
    assert none.languages == [] and {r["_lang"] for r in langid.predict(docs, none).collect()} == {"und"}
    assert langid.predict(empty, none).count() == 0


def test_language_id_bounds_its_matrix(docs):
    with pytest.raises(ValueError, match="too large"):
        langid.train(docs, most_cells=1 << 15)


# -- packing


def test_encoder_equals_the_tokenizer(rows):
    encoder, own = packing.Encoder(tokenizer_path()), packing.tokenizer(tokenizer_path())
    texts = [t or "" for _, t, *_ in rows] + ["don't we'll\nI'm", "a\u3000b c\u00a0d e", "<|endoftext|> x <|endoftext|>", "a<|endoftext|>b c", "x <|endoftext|>", " lead", "trail ", "a\n\nb", "x\n y", "12,5 %% 7"]
    want = [np.array(own.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert encoder.chunked and encoder.encode(texts) == want == encoder.encode(texts)
    assert 50256 in own.encode("<|endoftext|>", add_special_tokens=False).ids


def test_packing(docs, rows, empty):
    own = packing.tokenizer(tokenizer_path())
    want = Counter()
    for doc, text, *_ in rows:
        ids = [*own.encode(text or "", add_special_tokens=False).ids, 0]
        rest = len(ids) % 2048
        cuts = [0, *range(rest or 2048, len(ids), 2048), len(ids)] if len(ids) > 2048 else [0, len(ids)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[doc, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    packed = packing.pack_documents(docs, tokenizer_path())
    rows_ = packed.collect()
    assert Counter(tuple(r)[:5] for r in rows_) == want
    bins = defaultdict(list)
    for r in rows_:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) == -(-sum(r.length for r in rows_) // 2048)
    assert packing.pack_documents(empty, tokenizer_path()).count() == 0


def test_sequences_hold_their_pieces(docs):
    unlike = docs.where("doc_id < 30").dropDuplicates(["doc_id"])
    packed = packing.pack_documents(unlike, tokenizer_path())
    ids = {r.sequence_id: bytes(r.ids) for r in packing.sequences(unlike, packed, tokenizer_path()).collect()}
    for r in packed.collect():
        assert zlib.crc32(ids[r.sequence_id][4 * r.offset : 4 * (r.offset + r.length)]) == r.ids_crc32


def smallest(sizes, capacity):
    """The least number of bins, by trying everything."""
    best = len(sizes)

    def place(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(sizes):
            best = len(rooms)
            return
        for k, room in enumerate(rooms):
            if room >= sizes[i] and room not in rooms[:k]:
                place(i + 1, [*rooms[:k], room - sizes[i], *rooms[k + 1 :]])
        place(i + 1, [*rooms, capacity - sizes[i]])

    place(0, [])
    return best


def held(plan, capacity):
    assert all(sum(s * k for s, k in f.items()) <= capacity and n > 0 for f, n in plan)
    return Counter({s: sum(f.get(s, 0) * n for f, n in plan) for s in {s for f, _ in plan for s in f}})


@pytest.mark.parametrize("seed", range(500))
def test_bin_completion_finds_the_least_number_of_bins(seed):
    rng = random.Random(seed)
    low, high = rng.choice([(15, 60), (1, 100), (20, 45), (30, 55), (5, 30)])
    sizes = sorted((rng.randint(low, high) for _ in range(rng.randint(1, 10))), reverse=True)
    if seed % 3 == 0:  # sizes that come again
        sizes = sorted((rng.choice(sizes[:4]) for _ in range(10)), reverse=True)
    plan = completion.pack(dict(Counter(sizes)), 100)
    best = smallest(sizes, 100)
    assert held(plan.fillings, 100) == Counter(sizes)
    assert plan.bins == plan.bound == best and plan.proven
    first = completion.best_fit_decreasing(dict(Counter(sizes)), 100)
    assert held(first, 100) == Counter(sizes) and sum(n for _, n in first) == best_fit_by_hand(sizes, 100)


def best_fit_by_hand(sizes, capacity):
    rooms = []
    for s in sorted(sizes, reverse=True):
        fits = [r for r in rooms if r >= s]
        if fits:
            rooms.remove(min(fits))
        rooms.append((min(fits) if fits else capacity) - s)
    return len(rooms)


def test_bin_completion_where_best_fit_is_not_enough():
    counts = {35: 2, 20: 1, 45: 2, 38: 3, 37: 1, 18: 1, 39: 1, 27: 2, 41: 2, 40: 1, 25: 1}
    assert sum(n for _, n in completion.best_fit_decreasing(counts, 100)) == 7
    plan = completion.pack(counts, 100)
    assert (plan.bins, plan.bound, plan.proven) == (6, 6, True)


def test_bin_completion_tells_the_gap_when_it_stops():
    counts = {35: 2, 20: 1, 45: 2, 38: 3, 37: 1, 18: 1, 39: 1, 27: 2, 41: 2, 40: 1, 25: 1}
    plan = completion.pack(counts, 100, effort=2)
    assert held(plan.fillings, 100) == Counter(counts) and plan.bound <= 6 < plan.bins and not plan.proven


def test_bin_completion_of_many_sizes():
    rng = random.Random(1)
    counts = Counter(rng.randint(1, 2048) for _ in range(20_000))
    plan = completion.pack(dict(counts), 2048)
    assert held(plan.fillings, 2048) == counts and plan.bins - plan.bound <= 0.002 * plan.bins
    assert completion.pack({}, 2048) == completion.Plan([], 0, True)


def dominates(better, other):
    """Whether the parts of `other` fit, put together, into those of `better`."""

    def place(parts, rooms):
        return not parts or any(room >= parts[0] and place(parts[1:], rooms[:i] + [room - parts[0]] + rooms[i + 1 :]) for i, room in enumerate(rooms))

    return sum(better) >= sum(other) and place(sorted(other, reverse=True), list(better))


@pytest.mark.parametrize("seed", range(60))
def test_undominated_fillings(seed):
    """All fillings that no other dominates, by comparing all pairs."""
    rng = random.Random(seed)
    parts, room = [rng.randint(1, 30) for _ in range(rng.randint(1, 9))], rng.randint(10, 60)
    sizes = sorted(set(parts), reverse=True)
    counts = [parts.count(s) for s in sizes]
    every = {tuple(sorted(c)) for n in range(len(parts) + 1) for c in itertools.combinations(parts, n) if sum(c) <= room}
    want = {c for c in every if not any(o != c and dominates(o, c) for o in every)}
    found = [tuple(sorted(sizes[i] for i, k in f.items() for _ in range(k))) for f in completion.completions(sizes, counts, 0, room, completion._Budget(10**6), lambda: room)]
    assert len(set(found)) == len(found) and set(found) == want
    assert [room - sum(f) for f in found] == sorted(room - sum(f) for f in found)


@pytest.mark.parametrize("seed", range(200))
def test_lower_bound(seed):
    rng = random.Random(seed)
    sizes = [rng.randint(1, 100) for _ in range(rng.randint(1, 8))]
    own = Counter(sizes)
    bound = completion.lower_bound(np.array(sorted(own)), np.array([own[s] for s in sorted(own)]), 100)
    assert -(-sum(sizes) // 100) <= bound <= smallest(sorted(sizes, reverse=True), 100)


@pytest.mark.parametrize("buffer", [b"", b" ", b"a", b" a", b"a ", b"ab  c\n\td", b"one two three-four five\x0bsix" * 3, "né 中文 x".encode(), b"w" * 50 + b" " + b"w" * 8 + b" " + b"w" * 9])
def test_words_are_found_and_told_apart(buffer):
    from evlog.llm.common import hash_words

    start, end, h = hash_words(buffer)
    words = [buffer[a:b] for a, b in zip(start, end, strict=True)]
    assert words == buffer.split()
    assert len(set(zip(words, h.tolist(), strict=True))) == len(set(words)) == len(set(h.tolist()))


# -- language ID, held against dictionaries


def grams_by_hand(text, sizes=(1, 2, 3)):
    kept = "".join((c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else " " for c in f" {text} ")
    kept = re.sub(" +", " ", kept)
    return [kept[i : i + n] for n in sizes for i in range(len(kept) - n + 1)] if text else []


def bucket_of(gram, buckets):
    return int(langid.grams(np.array([ord(c) for c in gram], np.uint32), (len(gram),), buckets)[0])


def posterior_by_hand(rows, text, buckets, smoothing=0.5, evidence=200):
    """Multinomial naive Bayes with a dictionary of buckets for each language."""
    labelled = [(t, lang) for _, t, lang, *_ in rows if t is not None and lang is not None]
    own = [bucket_of(g, buckets) for g in grams_by_hand(text)]
    likely = {}
    for lang in sorted({x for _, x in labelled}):
        counts = Counter(bucket_of(g, buckets) for t, x in labelled if x == lang for g in grams_by_hand(t))
        total = sum(counts.values()) + smoothing * buckets
        mean = sum(np.log((counts[b] + smoothing) / total) for b in own) / len(own)
        likely[lang] = mean * min(len(own), evidence) + np.log(sum(x == lang for _, x in labelled) / len(labelled))
    most = max(likely.values())
    weight = {k: np.exp(v - most) for k, v in likely.items()}
    best = max(sorted(weight), key=weight.get)
    return best, weight[best] / sum(weight.values())


def test_language_id_equals_dictionaries(spark):
    rng = random.Random(8)
    words = {"a": ["the", "house", "is", "old", "near"], "b": ["das", "Haus", "ist", "älter", "groß"], "c": ["la", "casa", "está", "más", "vieja"]}
    rows = [(i, " ".join(rng.choice(words[lang]) for _ in range(rng.randint(1, 40))) + rng.choice(["", "!", " 12", "\n"]), lang) for i, lang in enumerate("abc" * 8)]
    rows += [(50, None, "a"), (51, "unlabelled words", None), (52, "", "b"), (53, "x", "c"), (54, "İſtanbul ǅ 中文 مرحبا", "a"), rows[0]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    model = langid.train(docs, buckets=1 << 9)
    asked = [*rows, (60, "haus house casa", None), (61, "the " * 500, None), (62, "?! 7", None), (63, "e", None)]
    got = {r.doc_id: (r._lang, r._score) for r in langid.predict(spark.createDataFrame(asked, docs.schema), model).collect()}
    for key, text, _ in asked:
        if not any(c.isalpha() for c in text or ""):
            assert got[key] == ("und", 0.0)
            continue
        lang, score = posterior_by_hand(rows, text, 1 << 9)
        assert got[key][0] == lang and got[key][1] == pytest.approx(score, rel=1e-4), text


@pytest.mark.parametrize("slice_", [1, 2, 3, 7, 50])
def test_long_texts_are_counted_in_slices(slice_):
    rng = random.Random(slice_)
    for text in ("", " ", "a", "..", "ab, cd", "".join(rng.choice("aÉ  .ß中9\n") for _ in range(200)), " x" * 40, "y  " * 40):
        want = Counter(bucket_of(g, 1 << 12) for g in grams_by_hand(text))
        found, n, letters = langid.counted(text, (1, 2, 3), 1 << 12, slice_)
        assert dict(zip(found.tolist(), n.tolist(), strict=True)) == want and letters == any(c.isalpha() for c in text)


# -- columns that are there already

CLASHING = ["_lang", "_score", "_doc", "_gone", "_n_lines", "_n_dropped", "_kept", "_mark", "_rows", "_leaked", "_text", "_hot", "code", "mark", "hash", "hashes", "batch", "block", "n", "keeper", "segment", "place", "spans", "part", "rank", "length", "bucket", "kind", "Words"]


def test_operators_with_clashing_columns(spark, docs, rows):
    odd = docs
    for name in CLASHING:
        odd = odd.drop(name).withColumn(name, F.lit(7))
    n = len(rows)
    found = langid.predict(odd, langid.train(odd))
    assert found.columns == [*odd.columns, "_lang_", "_score_"] and found.count() == n
    lines = linededup.dedup_lines(odd)
    assert lines.columns == [*odd.columns, "_n_lines_", "_n_dropped_"]
    assert listed(lines, "doc_id", "text", "_n_lines_", "_n_dropped_") == lines_by_hand(rows) and lines.where("_gone <> 7 or hash <> 7").count() == 0
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns and kept.count() == simhash.keep_one(docs).count()
    assert listed(simhash.near_duplicates(odd), "doc_id", "code", "component_id") == listed(simhash.near_duplicates(docs), "doc_id", "code", "component_id")
    items = spark.createDataFrame([(1, rows[-1][1], 5, 5)], "item_id long, text string, mark int, words int")
    assert listed(decontaminate.phrase_matches(decontaminate.build_index(odd), items), "doc_id", "n_words") == Counter((d, len(WORD.findall(lower(t).encode()))) for d, t, *_ in rows)
    assert lm.score(odd).count() == substring.dedup_substrings(odd).count() == n
    assert packing.pack_documents(odd, tokenizer_path()).count() == packing.pack_documents(docs, tokenizer_path()).count()
