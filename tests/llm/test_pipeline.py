"""The pipeline's stages, each on its own input, and the whole."""

import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from evlog.llm import completion, decontaminate
from evlog.llm.queries import tokenizer_path


def test_stages_keep_the_columns_and_clean_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("extra", F.lit(1))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        before, after = docs.count(), out.count()
        assert 0.6 * before < after <= before, name


def test_stages_with_odd_rows(spark, sf):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "!!! 123", "en", "s", 7), (4, "plain words of some text here", "en", "s", 29), (4, "plain words of some text here", "en", "s", 29), (None, "a row without an id", None, None, 3), (9, "x " * 50_000, "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf).collect()
        stage(spark, docs.limit(0), sf).collect()
    kept = {r.doc_id for r in corpus_pipeline.STAGES[0][1](spark, docs, sf).collect()}
    assert kept == {4, None, 9}


def test_the_whole(spark, sf):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    out = corpus_pipeline.run(spark, sf).collect()
    ids = {r.doc_id for r in out}
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    leaked = {r.doc_id for r in decontaminate.phrase_matches(decontaminate.build_index(docs.where(F.col("doc_id").isin(sorted(ids)))), bench).where(F.size("spans") > 0).collect()}
    gone = docs.count() - len(ids)
    assert 0 < gone < 0.5 * docs.count()
    # what leaks in the raw texts of kept documents can only be lines that line dedup took out
    assert len(leaked) < 0.02 * len(ids) + 2
    pieces = Counter((r.doc_id, r.piece) for r in out)
    assert max(pieces.values()) == 1


# -- the stages and the whole, held against plain Python


def by_hand(rows, items):
    """What each stage makes of (doc_id, text, lang, source, n_chars) rows, from the brute-force versions of the operators."""
    from collections import defaultdict

    from test_documents import components_by_hand, hits_by_hand, posterior_by_hand, print_of

    known = [r for r in rows if r[0] is None or zlib.crc32(str(r[0]).encode()) % 4 != 2]
    out = []
    for r in rows:
        if any(c.isalpha() for c in r[1] or ""):
            lang, score = posterior_by_hand(known, r[1], 1 << 15)
            if score >= corpus_pipeline.LEAST_SCORE:
                out.append(r)
    yield out
    kept = [next(iter(lines_by_hand_of(r, out))) for r in out]
    out = [(r[0], text, *r[2:4], len(text) if dropped else r[4]) for r, (text, dropped) in zip(out, kept, strict=True)]
    yield out
    root = components_by_hand([print_of(r[1]) for r in out])
    groups = defaultdict(list)
    for r in out:
        if r[0] is not None:
            groups[root[print_of(r[1])]].append(r)
    out = [min(g, key=lambda r: r[0]) for g in groups.values()] + [r for r in out if r[0] is None]
    yield out
    out = [r for r in out if not next(iter(hits_by_hand([r], items, 10)))[2]]
    yield out


def lines_by_hand_of(row, rows):
    """(text, lines dropped) of one row among all."""
    from test_documents import lower

    key = lambda x: lower(x.strip(" \t\n\v\f\r"))
    holders = {}
    for doc, text, *_ in rows:
        if doc is not None:
            for k in {key(x) for x in (text or "").split("\n")}:
                holders.setdefault(k, []).append(doc)
    own = (row[1] or "").split("\n")
    kept = [x for x in own if row[0] is None or len(key(x)) < 40 or len(holders[key(x)]) < 5 or max(holders[key(x)]) == row[0]]
    yield "\n".join(kept) if len(kept) < len(own) else row[1], len(own) - len(kept)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(12)
    words = {"en": "the house near old river runs slow and green with stones under every bridge".split(), "de": "das alte Haus steht am Fluß und über jeder Brücke hängt grünes Licht".split(), "fr": "la vieille maison près du fleuve où chaque pont garde une lumière verte".split()}
    line = "this very line stands in many of the documents, word for word"
    item = " ".join(rng.choice(words["en"]) for _ in range(14))
    say = lambda lang, n: " ".join(rng.choice(words[lang]) for _ in range(n))
    texts = [(lang, say(lang, rng.randint(15, 60))) for lang in ("en", "de", "fr") * 8]
    texts += [("en", say("en", 12) + "\n" + line + "\n" + say("en", 12)) for _ in range(6)]
    base = say("en", 400)
    texts += [("en", base), ("en", base), ("en", base.replace("river", "stream", 1))]
    texts += [("en", f"{say('en', 20)} {item.upper()} {say('en', 20)}"), (None, "??? 123"), (None, None), ("de", ""), ("xx", "§§ q §§"), (None, say("fr", 5)), ("en", say("en", 3000))]
    rows = [(i * 5 + 1, text, lang, "s", 1) for i, (lang, text) in enumerate(texts)]
    # rows that share an id of which one is contaminated; rows without an id, one of them contaminated; a row twice
    rows += [(9001, say("de", 30), "de", "s", 2), (9001, f"{item} {say('en', 9)}", "en", "s", 3), (None, f"{say('fr', 9)} {item}", "en", "s", 4), (None, say("fr", 40), "fr", "s", 5), rows[3]]
    return rows, [(1, item), (2, "no such words here")]


DDL = "doc_id long, text string, lang string, source string, n_chars long"


def listed(rows):
    return Counter(tuple(r) for r in rows)


def test_stages_equal_brute_force(spark, corpus, tmp_path):
    rows, items = corpus
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(rows, DDL).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    before, sizes = rows, [len(rows)]
    for (name, stage), want in zip(corpus_pipeline.STAGES, by_hand(rows, items), strict=False):
        found = stage(spark, spark.createDataFrame(before, DDL).repartition(3), str(tmp_path)).collect()
        assert listed(found) == listed(want), name
        before = want
        sizes.append(len(want))
    assert sizes[0] > sizes[1] > sizes[3] > sizes[4] and sizes[1] == sizes[2]
    own = Tokenizer.from_file(tokenizer_path())
    pieces = Counter()
    for r in before:
        n = len(own.encode(r[1] or "", add_special_tokens=False).ids) + 1
        cuts = [0, *range(n % 2048 or 2048, n, 2048), n] if n > 2048 else [0, n]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            pieces[r[0], k, a, b - a] += 1
    for packed in (corpus_pipeline.STAGES[4][1](spark, spark.createDataFrame(before, DDL), str(tmp_path)).collect(), corpus_pipeline.run(spark, str(tmp_path)).collect()):
        assert Counter((r.doc_id, r.piece, r.start, r.length) for r in packed) == pieces
        bins = {}
        for r in packed:
            bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert all(sorted(o for o, _ in b) == [sum(n for o, n in b if o < at) for at, _ in sorted(b)] and sum(n for _, n in b) <= 2048 for b in bins.values())
        assert len(bins) == completion.pack(dict(Counter(n for b in bins.values() for _, n in b)), 2048).bins


CLASHING = ["_lang", "_score", "_doc", "_gone", "_n_lines", "_n_dropped", "_kept", "_mark", "_rows", "_leaked", "_leaked_text", "_text", "_hot", "hash", "mark", "n", "segment"]


def test_stages_with_clashing_columns(spark, corpus, tmp_path):
    rows, items = corpus
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame(rows, DDL)
    odd = docs.select("*", *[F.lit(7).alias(c) for c in CLASHING])
    for name, stage in corpus_pipeline.STAGES:
        found, plain = stage(spark, odd, str(tmp_path)), stage(spark, docs, str(tmp_path))
        if name != "best-fit packing":
            assert found.columns == odd.columns and found.where(" or ".join(f"{c} <> 7" for c in CLASHING)).count() == 0, name
            assert listed(found.select(docs.columns).collect()) == listed(plain.collect()), name
        else:
            assert found.count() == plain.count()
