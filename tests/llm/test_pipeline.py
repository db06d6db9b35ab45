"""The pipeline stage by stage, each held against brute force on what the one before left."""

import os
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__
import corpus_pipeline
from concordat.llm import decontamination, ngram_join, quality_rules, queries, resampling, tokens

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables are not here")


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, before = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, DATA).write.parquet(str(tmp_path / name))
        left = spark.read.parquet(str(tmp_path / name))
        if name == "packing":
            lib_counts = {r.doc_id: r.n_tokens + 1 for r in tokens.count_tokens(docs).collect()}
            pieces = left.collect()
            assert sum(r.length for r in pieces) == sum(lib_counts.values()) and {r.doc_id for r in pieces} == set(before)
            break
        assert left.columns == columns
        after = {r.doc_id: r.text for r in left.collect()}
        gone = set(before) - set(after)
        assert set(after) <= set(before)
        if name == "quality_rules":
            kept = {r.doc_id for r in quality_rules.quality_metrics(docs).collect() if r.kept}
            assert set(after) == kept and gone
        elif name == "quality_classifier":
            labels, corpus = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("labels", "documents"))
            kept = {r.doc_id for r in resampling.resample(docs, labels, corpus=corpus).collect() if r.kept}
            assert set(after) == kept and len(gone) < 0.05 * len(before)
        elif name == "ngram_jaccard_join":

            def shingles(t):
                w = t.lower().split()
                return {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))}

            sets = {i: shingles(t) for i, t in before.items()}
            ids = sorted(sets)
            link = {i: [j for j in ids if j != i and 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j]))] for i in ids}
            want, seen = set(), set()
            for i in ids:
                if i not in seen:
                    want.add(i)
                    todo = [i]
                    while todo:
                        x = todo.pop()
                        if x not in seen:
                            seen.add(x)
                            todo += link[x]
            assert set(after) == want
        elif name == "benchmark_decontamination":
            items = [decontamination.normal(r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
            assert gone == {i for i, t in before.items() if any(near(x, decontamination.normal(t)) for x in items)}
        docs, before = left, after
    assert corpus_pipeline.run(spark, DATA).count() == len(pieces)


def near(item, text, percent=8):
    """Whether some part of a text is within the budget of edits, column by column of the edit matrix."""
    if item in text:
        return True
    budget = len(item) * percent // 100
    column = np.arange(len(item) + 1)
    letters = np.array(list(item))
    for c in text:
        step = np.minimum(column[:-1] + (letters != c), column[1:] + 1)
        column = np.concatenate([[0], step])
        column = np.minimum.accumulate(column - np.arange(len(column))) + np.arange(len(column))  # and insertions
        if column[-1] <= budget:
            return True
    return False


WORDS = "the of and to a in that is was for it with as on be at by this are from".split()


def hostile_tables(spark, folder):
    """Documents of every awkward kind beside good and bad prose, labels and benchmark of the same kind."""
    draw = random.Random(21)
    prose = lambda n, seed: " ".join(random.Random(seed).choices([*WORDS, *(f"wort{k}" for k in range(300))], k=n)) + "."
    junk = lambda n, seed: " ".join(random.Random(seed).choices([f"zz{k}q" for k in range(60)] + ["the", "of"], k=n)) + "."
    rows = [(k, prose(120, k)) for k in range(60)] + [(100 + k, junk(120, k)) for k in range(40)]
    rows += [(200, prose(120, 0)), (201, prose(120, 0).replace("wort1 ", "other ", 1)), (None, prose(90, 500)), (None, prose(90, 501)), (7, prose(90, 502)), (7, prose(90, 502))]
    rows += [(300, None), (301, ""), (302, " \n\t "), (303, "x"), (304, prose(60_000, 600)), (305, "é " * 30 + "\U0001f642 ́"), (None, None)]
    item = prose(30, 700)
    rows += [(400, prose(80, 701) + " " + item + " " + prose(80, 702)), (401, prose(80, 703) + " " + item.replace("the", "thx", 1).upper() + " " + prose(80, 704))]
    draw.shuffle(rows)
    docs = [(i, t, "en", "s", len(t or ""), "mine", 1) for i, t in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, __cls string, weight int").repartition(5).write.parquet(f"{folder}/documents.parquet")
    marks = [(k, 1) for k in range(60)] + [(100 + k, 0) for k in range(40)] + [(None, 1), (5, None), (999, 1)]
    spark.createDataFrame(marks, "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None), (3, ""), (None, "short one")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return rows


def test_hostile_documents(spark, tmp_path):
    folder = str(tmp_path)
    rows = hostile_tables(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    left = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, folder).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        assert docs.columns == spark.read.parquet(f"{folder}/documents.parquet").columns
        left[name] = Counter(r.doc_id for r in docs.select("doc_id").collect())
    assert not set(range(300, 304)) & set(left["quality_rules"]) and left["quality_rules"][304] == 1 and left["quality_rules"][None] == 2
    junk_left = [i for i in left["quality_classifier"] if i is not None and 100 <= i < 140]
    assert len(left["quality_rules"]) > len(left["quality_classifier"]) and not junk_left
    assert sum(i in left["quality_classifier"] for i in range(60)) >= 50  # a sample: texts at the cut change places
    joined = left["ngram_jaccard_join"]
    assert joined[None] == 2 and joined[7] == 2 and 200 not in joined and 201 not in joined  # of id 7 one text of each
    assert not {400, 401} & set(left["benchmark_decontamination"]) and set(joined) - set(left["benchmark_decontamination"]) == {400, 401}
    pieces = corpus_pipeline.run(spark, folder).collect()
    assert Counter(r.doc_id for r in pieces if r.start == 0) == left["benchmark_decontamination"]
    assert len(rows) > len(pieces)


def test_texts_that_are_no_utf8(spark, tmp_path):
    """Every stage takes them as if U+FFFD stood for the broken bytes, and carries the bytes along."""
    given = pq.read_table(f"{DATA}/documents.parquet")
    texts = [t.encode() for t in given["text"].to_pylist()]
    whole = max(texts[:50], key=len)
    texts[:2] = [whole[:300] + b" \xff\xfe " + whole[300:600], whole[600:1200] + b"\xe2\x82"]
    left = {}
    for kind in ("raw", "replaced"):
        folder = str(tmp_path / kind)
        os.mkdir(folder)
        for t in ("labels", "benchmark"):
            os.symlink(f"{DATA}/{t}.parquet", f"{folder}/{t}.parquet")
        column = pa.array(texts if kind == "raw" else [t.decode("utf-8", "replace").encode() for t in texts], pa.binary()).view(pa.string())
        pq.write_table(given.set_column(given.column_names.index("text"), "text", column), f"{folder}/documents.parquet")
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
            stage(spark, docs, folder).write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
        kept = {r.doc_id: bytes(r.text) for r in docs.selectExpr("doc_id", "cast(text as binary) as text").collect()}
        left[kind] = kept, {r.doc_id: r.doc_tokens for r in corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()}
    ids = given["doc_id"].to_pylist()[:2]
    (raw, raw_tokens), (replaced, replaced_tokens) = left["raw"], left["replaced"]
    assert set(raw) == set(replaced) and raw_tokens == replaced_tokens and set(ids) <= set(raw)
    assert [raw[i] for i in ids] == texts[:2] and replaced[ids[0]] != texts[0]


@pytest.mark.parametrize("empty", ["documents", "labels", "benchmark"])
def test_empty_tables(spark, tmp_path, empty):
    folder = str(tmp_path)
    hostile_tables(spark, folder + "/full")
    for t in ("documents", "labels", "benchmark"):
        df = spark.read.parquet(f"{folder}/full/{t}.parquet")
        (df.limit(0) if t == empty else df).write.parquet(f"{folder}/{t}.parquet")
    kept = {r.doc_id for r in corpus_pipeline.run(spark, folder).collect()}
    assert (kept == set()) == (empty == "documents")
    assert (400 in kept) == (empty == "benchmark")
    assert any(i is not None and 100 <= i < 140 for i in kept) == (empty == "labels")


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="driver tables are not here")
def test_recall_of_the_join(spark):
    """All links of ten thousand documents, by an index from every shingle to the sets that have it."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    number, of, sets = {}, {}, []
    for i, text in docs.collect():
        s = ngram_join.shingle_set(text, 5)
        of[i] = number.setdefault(s.tobytes(), len(sets))
        if of[i] == len(sets):
            sets.append(s)
    sizes = np.array([len(s) for s in sets])
    owner, shingle = np.repeat(np.arange(len(sets)), sizes), np.concatenate(sets)
    order = np.lexsort((owner, shingle))
    owner, shingle = owner[order], shingle[order]
    starts = np.flatnonzero(np.concatenate([[True], shingle[1:] != shingle[:-1]]))
    counts = np.diff([*starts, len(shingle)])
    pairs = []
    for n in np.unique(counts[counts > 1]):
        held = owner[starts[counts == n][:, None] + np.arange(n)]
        left, right = np.triu_indices(n, 1)
        pairs.append((held[:, left] << 32 | held[:, right]).ravel())
    pair, common = np.unique(np.concatenate(pairs), return_counts=True)
    a, b = pair >> 32, pair & 0xFFFFFFFF
    link = 9 * common >= 4 * (sizes[a] + sizes[b])
    want = np.bincount(a[link], minlength=len(sets)) + np.bincount(b[link], minlength=len(sets))
    found = {r.doc_id: r.n_links for r in ngram_join.near_duplicates(docs).collect()}
    assert all(n <= want[of[i]] for i, n in found.items())
    got = dict((of[i], n) for i, n in found.items())
    assert link.sum() > 30 and sum(got.values()) >= 0.99 * 2 * link.sum()


def test_registry():
    names = list(__spark_entry__.queries())
    for n in range(1, 11):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert "pipeline" in names


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracle(spark, name):
    import duckdb

    db = duckdb.connect()
    for t in ("documents", "pages", "labels", "benchmark"):
        db.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    df, rel = queries.queries()[name](spark, DATA), db.sql(queries.oracle_sql()[name])
    names = sorted(df.columns)
    assert names == sorted(rel.columns)
    at = [rel.columns.index(n) for n in names]
    plain = lambda v: round(v, 9) if isinstance(v, float) else v
    assert sorted(repr([plain(r[n]) for n in names]) for r in df.collect()) == sorted(repr([plain(r[k]) for k in at]) for r in rel.fetchall())
