"""Joins, matching, tokens, packing, resampling, fixity and the pipeline against brute force."""

import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from concordat.llm import common, decontamination, fixity, machine, ngram_join, packing, resampling, tokens

WORDS = [f"w{k}" for k in range(4000)]
EMPTY = "doc_id long, text string"


def shingles(text):
    words = (text or "").lower().split()
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()


def corpus():
    """Families of near copies at all similarities, copies, and texts that share one long passage."""
    draw = random.Random(11)
    texts = []
    for family in range(14):
        base = draw.choices(WORDS, k=draw.randint(60, 200))
        for _ in range(draw.randint(2, 9)):
            copy = list(base)
            for _ in range(draw.randint(0, 6)):
                copy[draw.randrange(len(copy))] = draw.choice(WORDS)
            texts.append(" ".join(copy))
    texts += [texts[0]] * 5 + [texts[1].upper()]
    passage = draw.choices(WORDS, k=50)
    texts += [" ".join(draw.choices(WORDS, k=60) + passage + draw.choices(WORDS, k=60)) for _ in range(150)]
    big = draw.choices(WORDS, k=120)
    for k in range(140):
        copy = list(big)
        copy[k % 120] = f"x{k}"
        texts.append(" ".join(copy))
    return texts + [None, "", " \n", "one two", "One  two", "a b c d", "long " * 20_000]


def test_join_against_brute_force(spark):
    rows = list(enumerate(corpus())) + [(None, corpus()[0]), (0, corpus()[0])]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, cls string").repartition(5)
    config = ngram_join.JoinConfig(small=16, block_sets=32)
    found = ngram_join.near_duplicates(df, config=config).collect()
    assert len(found) == len(rows)

    members = defaultdict(list)
    for i, t in rows:
        members[shingles(t)].append(i)
    sets = [s for s in members if s]
    links = defaultdict(set)
    for a in range(len(sets)):
        for b in range(a):
            common_n = len(sets[a] & sets[b])
            if 9 * common_n >= 4 * (len(sets[a]) + len(sets[b])):
                links[a].add(b)
                links[b].add(a)
    seen, comp = set(), {}
    for a in range(len(sets)):
        if a not in seen:
            todo, group = [a], []
            while todo:
                x = todo.pop()
                if x not in seen:
                    seen.add(x)
                    group.append(x)
                    todo += links[x]
            low = min(i for x in group for i in members[sets[x]] if i is not None)
            comp |= {x: low for x in group}
    number = {s: k for k, s in enumerate(sets)}
    texts = dict(rows[:-2]) | {None: rows[0][1]}
    assert max(map(len, links.values())) > 100
    for r in found:
        s = shingles(texts[r.doc_id])
        want = (comp[number[s]], len(links[number[s]]), len(members[s])) if s else (r.doc_id, 0, 1)
        assert (r.class_id, r.n_links, r.n_copies) == want
    kept = ngram_join.keep_one_of_each(df, config=config)
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == df.columns
    assert Counter(ids) == Counter([*{r.class_id for r in found}, None])
    assert ngram_join.near_duplicates(df.limit(0)).count() == 0 and ngram_join.keep_one_of_each(df.limit(0)).count() == 0


def test_repeated_ids_keep_their_texts(spark):
    """A row goes only if its own class keeps another one, also if other texts have its id."""
    draw = random.Random(4)
    one, two, three, four = (draw.choices(WORDS, k=80) for _ in range(4))
    near = [*two[:79], "other"]
    rows = [(7, one), (7, two), (7, three), (7, three), (3, near), (7, four), (9, four), (9, one), (2, three), (7, []), (7, []), (None, one), (5, four[:40])]
    df = spark.createDataFrame([(i, " ".join(w), "x") for i, w in rows], "doc_id long, text string, __lost string").repartition(4)
    kept = ngram_join.keep_one_of_each(df)
    assert kept.columns == df.columns
    want = [(7, one), (3, near), (2, three), (7, four), (7, []), (7, []), (None, one), (5, four[:40])]
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter((i, " ".join(w)) for i, w in want)


def test_links_of_rows_without_an_id(spark):
    draw = random.Random(6)
    one, two, three = (draw.choices(WORDS, k=100) for _ in range(3))
    left, right = ["left"] * 8 + one[8:], one[:92] + ["right"] * 8  # both are linked to `one`, not to each other
    rows = [(4, left), (9, right), (None, one), (None, two), (None, two), (None, [*two[:99], "end"]), (None, [*three[:99], "end"]), (8, three), (None, draw.choices(WORDS, k=50)), (None, [])]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], EMPTY).repartition(3)
    found = Counter(tuple(r) for r in ngram_join.near_duplicates(df).collect())
    assert found == Counter([(4, 4, 1, 1), (9, 4, 1, 1), (None, 4, 2, 1), *[(None, None, 1, 2)] * 2, (None, None, 1, 1), (None, 8, 1, 1), (8, 8, 1, 1), *[(None, None, 0, 1)] * 2])
    assert Counter(r.doc_id for r in ngram_join.keep_one_of_each(df).collect()) == Counter([4, 8, *[None] * 7])


def test_runs_hold_the_recall_at_every_depth():
    """Trees over random coordinates of pairs at the threshold: none may be split off more often than asked."""
    config, draw = ngram_join.JoinConfig(), np.random.default_rng(12)

    def missed(runs, depth, n=400_000):
        shared = draw.binomial(ngram_join.COORDS, 0.8, n)[:, None] / ngram_join.COORDS
        lost = np.ones(n, dtype=bool)
        for _ in range(runs):
            pairs = (draw.random((n, 1)) < 0.8).sum(axis=1)
            for _ in range(depth):  # nodes that still hold both of a pair
                first = draw.binomial(pairs, shared[:, 0])
                again = draw.binomial(first, np.maximum(shared[:, 0] - 1 / ngram_join.COORDS, 0))  # another coordinate, not the same
                pairs = first + again + draw.binomial(pairs - first, shared[:, 0])
            lost &= pairs == 0
        return lost.mean()

    assert config.branches == 2
    for depth in (0, 4, config.max_depth):
        assert missed(config.runs, depth) <= 1 - config.recall + 5e-5
    shallow = ngram_join.JoinConfig(max_depth=3)
    assert abs(missed(2, 3) / shallow.miss(2) - 1) < 0.05


def test_word_hashes_do_not_depend_on_place(monkeypatch):
    words = ["alpha", "béta", "x" * 300, "d"]
    one = common.word_hashes(" ".join(words * 50).encode())
    assert len(set(one.tolist())) == 4 and (one[:4] == one[-4:]).all()
    monkeypatch.setattr(common, "BLOCK", 64)
    assert (common.word_hashes(("\t\n" + " ".join(words * 50)).encode()) == one).all()
    assert len(common.word_hashes(b"")) == 0 and len(common.word_hashes(b" \n")) == 0


def test_prefilter_never_loses(spark):
    ids = spark.range(0, 3000).select((F.col("id") * 5).alias("id"))
    for bits in (1 << 26, 1 << 15):
        wrong = spark.range(15_000).select("id", common.maybe_in(ids, F.col("id"), bits).alias("m")).filter("id % 5 = 0 and not m").count()
        assert wrong == 0


def edit(item, text):
    column = list(range(len(item) + 1))
    best = column[-1]
    for c in text:
        last, column[0] = column[:], 0
        for k in range(1, len(item) + 1):
            column[k] = min(last[k - 1] + (item[k - 1] != c), last[k] + 1, column[k - 1] + 1)
        best = min(best, column[-1])
    return best


def test_myers_distance():
    draw = random.Random(2)
    for _ in range(300):
        item = "".join(draw.choices("abc", k=draw.randint(1, 70)))
        text = "".join(draw.choices("abc", k=draw.randint(0, 60)))
        got = decontamination.myers(decontamination.masks(item), len(item), text, len(item))
        assert (got[0] if got else len(item)) == edit(item, text)


def test_leaks_against_brute_force(spark):
    draw = random.Random(5)
    items = [" ".join("".join(draw.choices("abcdefgh", k=draw.randint(2, 7))) for _ in range(12)) for _ in range(12)]
    texts = []
    for k in range(60):
        body = list(draw.choice(items))
        for _ in range(draw.randint(0, 9)):
            at = draw.randrange(len(body))
            body[at : at + draw.randint(0, 1)] = draw.choice(["", "q", "zz"])
        texts.append("Lead  in\n" + "".join(body).upper() + " and\tout " + "".join(draw.choices("abc ", k=80)))
    docs = [(k, t, "x") for k, t in enumerate(texts)] + [(None, texts[0], "x"), (900, None, "x"), (901, "", "x")]
    bench = list(enumerate(items)) + [(50, None), (51, "lead in"), (52, ""), (53, "ead i"), (None, items[0])]
    df = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    config = decontamination.MatchConfig(block_chars=400)
    found = {(r.doc_id, r.item_id): r.distance for r in decontamination.find_leaks(df, spark.createDataFrame(bench, "item_id long, text string"), config=config).collect()}
    want = {}
    for i, t, _ in docs:
        for j, x in bench:
            x, t_ = decontamination.normal(x), decontamination.normal(t)
            if len(x) < config.min_chars:
                if x and re.search(rf"(?<!\w){re.escape(x)}(?!\w)", t_):
                    want[i, j] = 0
            elif (d := edit(x, t_)) <= config.budget(len(x)):
                want[i, j] = d
    assert found == want and len(want) > 20 and any(j == 51 for _, j in want) and not any(j == 53 for _, j in want)
    kept = decontamination.drop_leaks(df, spark.createDataFrame(bench, "item_id long, text string"), config=config)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i, _, _ in docs} - {i for i, j in want if j not in (51, 53)}
    (long_hit,) = decontamination.find_leaks(spark.createDataFrame([(1, "word " * 60_000 + items[3])], EMPTY), spark.createDataFrame(bench, "item_id long, text string")).filter("item_id = 3").collect()
    assert long_hit.distance == 0 and long_hit.end_char == 300_000 + len(items[3])
    assert decontamination.find_leaks(df.limit(0), spark.createDataFrame(bench, "item_id long, text string")).count() == 0
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.find_leaks(df, none).count() == 0 and decontamination.drop_leaks(df, none).count() == len(docs)


PATH = tokens.tokenizer_path("word_bpe_49k.json")
ODD = list("ab'st re llΣσς  \x1c\x85é́ \t\n12٣，。!?.,🙂ÀİKẛ̣ẗ'dmve\u200b\ufeff½中ǅ") + ["<|endoftext|>", "<|STARTOFTEXT|>", "<|startoftext|>", "'ll", "'Ve", "T̈", "word", "Naïve", "unbelievably"]


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def reader():
    return machine.Machine(PATH)


def test_machine_matches_library(reader):
    """Ids and counts, chunks of any size, and a table that is forgotten again and again."""
    draw, lib, small = random.Random(1), library(), tokens.Transducer(machine.Machine(PATH, 9))
    texts = ["".join(draw.choices(ODD, k=draw.randint(0, 14))) for _ in range(4000)]
    texts += ["".join(draw.choices("abcdefghijklmnopqrstuvwxyzäéß", k=draw.randint(1, 30))) for _ in range(3000)]
    want = [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)]
    raw = [t.encode() for t in texts]
    assert [x.tolist() for x in reader.ids(raw)] == want
    assert reader.count(raw) == [len(w) for w in want]
    for size in (1, 2, 3, 7, 1 << 16):
        some = draw.sample(range(len(raw)), 400)
        assert small.counts([raw[k] for k in some], size) == [len(want[k]) for k in some]


def test_machine_on_all_scripts(reader):
    """Characters of all planes, those that Python's tables do not know yet included; combining marks of such
    tables may come in another order, so marks are left to the test above."""
    import unicodedata

    draw = random.Random(15)
    low, high = [chr(c) for c in range(32, 0x250)], [chr(c) for c in [*range(0x250, 0xD800), *range(0xE000, 0x20000)] if unicodedata.category(chr(c))[0] != "M"]
    texts = ["".join(draw.choice(low if draw.random() < 0.6 else high) for _ in range(draw.randint(1, 12))) for _ in range(6000)]
    texts += ["a" + chr(c) + "1" for first, last in machine.LATER_LETTERS + machine.LATER_DIGITS for c in (first, last)] + [chr(c) + "b" for c in machine.LATER_CASES]
    want = [e.ids for e in library().encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in reader.ids([t.encode() for t in texts])] == want


def test_merges_against_plain_merging():
    """Whether tokens are made of their symbols, and whether two stay apart, by merging in full."""
    merges, draw = machine.Merges(PATH), random.Random(7)
    single = {s[0]: t for t, s in merges.symbols.items() if len(s) == 1}

    def merged(symbols):
        ids = [single[s] for s in symbols]
        while (turns := [(merges.merged[a << 32 | b], k) for k, (a, b) in enumerate(zip(ids, ids[1:])) if a << 32 | b in merges.merged]):
            turn, k = min(turns)
            ids[k : k + 2] = [whole[turn]]
        return ids

    whole = {turn: t for t, turn in enumerate(merges.turn) if turn}
    some = draw.sample(sorted(merges.symbols), 3000)
    assert all(merges.sound(t) == (merged(merges.symbols[t]) == [t]) for t in some)
    open_ = [t for t in some if merges.sound(t) and merges.symbols[t][-1] < machine.LAST]
    pairs = [(draw.choice(open_), t) for t in some if merges.sound(t)] + [divmod(k, 1 << 32) for k in list(merges.merged)[:500]] + [(t, t) for t in open_[:300]]
    assert all(merges.apart(a, b) == (merged(merges.symbols[a] + merges.symbols[b]) == [a, b]) for a, b in pairs if merges.sound(a) and merges.sound(b))


def test_state_maps_compose_in_any_grouping(reader):
    transducer = tokens.Transducer(reader)
    maps = transducer.state_maps([b"ab", b"c d", b"", b" ", b"ef g", b"h"])
    assert maps[0] == (b"ab", None, b"") and maps[3] == (b"", 0, b"")
    left = [[tokens.EDGE, *maps, tokens.EDGE]]
    while len(left[0]) > 1:  # one after the other
        left = [transducer.level([left[0][:2]])[0] + left[0][2:]]
    assert left[0][0] == transducer.scan([[tokens.EDGE, *maps, tokens.EDGE]])[0] == (b"", reader.count([b"abc d ef gh"])[0], b"")


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        machine.Machine(tokens.tokenizer_path("byte_bpe_50k.json"))


LONG = "Überall, it's the 1st Wörter-list; naïve déjà-vu! " * 6000
TEXTS = ["Hello, World! It's fine.", None, "", "é " * 3000, "same same", "same same", "<|endoftext|> x", "a" * 3000, LONG, "x" + LONG.replace(" ", "") + "y"]


def test_counts_and_packing(spark):
    lib = library()
    rows = [(k, t, "x") for k, t in enumerate(TEXTS + TEXTS[:8] * 2)] + [(None, "null id", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n string").repartition(3)
    ids = {i: [*lib.encode(t or "", add_special_tokens=False).ids, 1] for i, t, _ in rows}
    texts = {i: t for i, t, _ in rows}
    for r in tokens.count_tokens(df).collect():
        text = texts[r.doc_id] or ""
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), len(ids[r.doc_id]) - 1, len(ids[r.doc_id]) - 1 > 2048)
    config = packing.PackConfig(window=64, chunk_bytes=5000)
    pieces = packing.pack(df, config=config, with_ids=True).cache()
    got = defaultdict(list)
    for r in pieces.collect():
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes()) and r.doc_tokens == len(ids[r.doc_id]) and len(part) == r.length > 0
        got[r.sequence_id].append((r.offset, r.length))
    for spans in got.values():
        ends = [0]
        for offset, length in sorted(spans):
            assert offset == ends[-1]
            ends.append(offset + length)
        assert ends[-1] <= 64
    fills = [sum(n for _, n in s) for s in got.values()]
    assert sum(fills) == sum(map(len, (ids[i] for i, _, _ in rows))) and sum(f < 64 for f in fills) <= 1
    whole = packing.sequences(pieces, config).collect()
    assert all(len(s.ids) == (s.fill if s.fill & (s.fill - 1) == 0 else 64) for s in whole) and len(whole) == len(fills)
    empty = spark.createDataFrame([], EMPTY)
    assert packing.pack(empty).count() == 0 and tokens.count_tokens(empty).count() == 0


def test_resampling(spark):
    """Log weights, keys, the cut and the sample against plain counting."""
    draw = random.Random(3)
    good = [" ".join(draw.choices(WORDS[:300], k=40)) for _ in range(300)]
    bad = [" ".join(draw.choices(WORDS[2000:2300], k=40)) for _ in range(100)]
    rows = [(k, t, 1.0) for k, t in enumerate(good + bad)] + [(None, good[0], 1.0), (1000, None, 1.0), (1001, "", 1.0), (5, good[5], 1.0), (1002, good[7] * 3000, 1.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, log_weight double").repartition(4)
    marks = [(k, int(k < 300)) for k in range(0, 400, 2)]
    labels = spark.createDataFrame([*marks, (1, None), (None, 1), (2, 0)], "doc_id long, quality int")
    config = resampling.ResamplingConfig(keep_good=0.95)
    found = resampling.resample(df, labels, config=config).collect()
    assert len(found) == len(rows)

    def buckets(text):
        words = (text or "").lower().split()
        hashed = [common.word_hashes(w.encode())[0] for w in words]
        pairs = [common.mix64(np.array([a]) * np.uint64(0xC2B2AE3D27D4EB4F) + b)[0] for a, b in zip(hashed, hashed[1:])]
        return Counter(int(h >> np.uint64(64 - config.bucket_bits)) for h in hashed + pairs)

    size, chosen = 1 << config.bucket_bits, {i for i, q in marks if q}
    counted = [(i, buckets(t)) for i, t, _ in rows[:-1]] + [(1002, Counter({b: n for b, n in buckets(rows[-1][1]).items()}))]
    raw, target = Counter(), Counter()
    for i, c in counted:
        raw += c
        if i in chosen:
            target += c

    def weight(c, target):
        every, aimed = sum(raw.values()) + size, sum(target.values()) + size
        ratio = lambda b: (target[b] + 1) / aimed / ((raw[b] + 1) / every)
        n = sum(c.values())
        return 20 * sum(k * np.log(0.95 * ratio(b) + 0.05) for b, k in c.items()) / np.sqrt(n) if n else 0.0

    by_id = {(i, sum(c.values())): weight(c, target) for i, c in counted}
    for r in found:
        assert r.log_weight == pytest.approx(by_id[r.doc_id, r.n_features], abs=1e-6)
        noise = int(common.mix64(common.mix64(np.array([r.doc_id or 0], dtype=np.uint64)) + np.uint64(config.seed))[0])
        assert r.gumbel_key - r.log_weight == pytest.approx(-np.log(-np.log(((noise >> 12) + 0.5) / 2**52)), abs=1e-6)
    aside = sorted(weight(c, target - c) for i, c in counted if i in chosen)
    cut = aside[int(0.05 * len(aside))]
    k = sum(r.log_weight >= cut for r in found)
    least = sorted((r.gumbel_key for r in found), reverse=True)[k - 1]
    assert 200 < k < 330 and all(r.kept == (r.gumbel_key >= least) for r in found)
    kept = {r.doc_id for r in found if r.kept}
    held_out = list(range(1, 400, 2))
    assert sum(i in kept for i in held_out if i < 300) > 130 and not any(i in kept for i in held_out if i >= 300)

    stays = resampling.filter_resampled(df, labels, config=config)
    assert stays.columns == df.columns and Counter(r.doc_id for r in stays.collect()) == Counter(r.doc_id for r in found if r.kept)
    assert all(r.kept for r in resampling.resample(df, labels.limit(0)).collect())
    assert resampling.resample(df.limit(0), labels).count() == 0 and resampling.filter_resampled(df.limit(0), labels).count() == 0
    bad_only = df.filter("doc_id >= 300 and doc_id < 400")  # judged by models of the whole table
    assert resampling.filter_resampled(bad_only, labels, config=config, corpus=df).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="driver tables are not here")
def test_held_out_labels(spark):
    """Fitted on half of the labels, held against the other half."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    kept = resampling.resample(docs, labels.filter(half)).filter("kept").select("doc_id")
    share = {r.quality: r.n for r in labels.filter(~half).join(kept, "doc_id").groupBy("quality").agg(F.count("*").alias("n")).collect()}
    every = {r.quality: r.n for r in labels.filter(~half).groupBy("quality").agg(F.count("*").alias("n")).collect()}
    assert share[1] / every[1] > 0.99 and share.get(0, 0) / every[0] < 0.1


def test_kth_largest_is_exact(spark):
    draw = random.Random(9)
    values = [draw.choice([draw.getrandbits(64) - (1 << 63), draw.randint(-5, 5)]) for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    for k in (1, 150, 250, 500):
        assert resampling.kth_largest(df, "v", k) == sorted(values, reverse=True)[k - 1]
    assert resampling.kth_largest(df, "v", 501) is None


def test_ordered_bits():
    x = np.array([-np.inf, -1e300, -1.5, -0.0, 0.0, 1e-300, 2.5, np.inf])
    assert (np.diff(resampling.ordered_bits(x)) >= 0).all()


def test_fixity(spark):
    pages = [(k, f"http://h{k % 7}/p{k}", "<p>" + "x" * (k * 13 % 400) + "</p>", "x") for k in range(300)] + [(None, None, None, "x"), (5, "http://h5/p5", "other version", "x"), (7, "http://h0/p7", "<p>" + "x" * 91 + "</p>", "x")]
    a = spark.createDataFrame(pages, "page_id long, url string, html string, digest string")
    config = fixity.FixityConfig(records_per_file=40, range_bytes=2000, fanout=3)
    assert fixity.audit(a, a.repartition(3), config).count() == 0
    b = a.filter("page_id is null or page_id <> 11").withColumn("html", F.when(F.col("page_id") == 33, F.overlay("html", F.lit("#"), 2)).otherwise(F.col("html")))
    b = b.union(spark.createDataFrame([(999, "http://new", "n", "x")], a.schema)).union(a.filter("page_id = 44"))
    found = {(r.id, r.kind) for r in fixity.audit(a, b, config).collect()}
    assert found == {(11, "missing"), (33, "changed"), (999, "extra"), (44, "changed")}
    many = a.unionByName(spark.createDataFrame([(None, None, f"version {k}", "x") for k in range(700)], a.schema))  # one id and URL
    assert fixity.audit(many, many.repartition(5), config).count() == 0
    lost = fixity.audit(many, many.filter("html is null or html <> 'version 5'"), config).collect()
    assert {r.kind for r in lost} == {"missing", "changed"} and all(r.id is None for r in lost)
    none = a.limit(0)
    assert fixity.audit(none, none, config).count() == 0
    assert {r.kind for r in fixity.audit(none, a, config).collect()} == {"extra"} and {r.kind for r in fixity.audit(a, none, config).collect()} == {"missing"}


def test_offsets_fill_files_without_gaps(spark):
    a = spark.createDataFrame([(k, f"u{k}", "y" * (k % 50)) for k in range(200)], "page_id long, url string, html string")
    rows = fixity.manifest(fixity.records(a), fixity.FixityConfig(records_per_file=50)).collect()
    for file in {r.file for r in rows}:
        at = 0
        for r in sorted((r for r in rows if r.file == file), key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
