"""The pipeline, each of its stages and the registered queries against brute-force versions."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from asterfold.llm import common, decontam, langid, secrets, simhash, toxicity

BPE = common.tokenizer_path("byte_bpe_50k.json")
SOUNDS = {"aa": "ba lo mi te sa nu ro vi pe da lu gi".split(), "bb": "krz ych sto wie prz szy dzi czk och wny".split()}
#: Columns of documents, then others with names that the operators use themselves.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, accepted string, score double, found string, fp long, component_id long, item_id long, start int"


def prose(rng, lang, n):
    return " ".join("".join(rng.choice(SOUNDS[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n)) + "."


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng, at = random.Random(3), str(tmp_path_factory.mktemp("corpus"))
    items = [(k, prose(rng, "aa", 25)) for k in range(4)] + [(8, None), (9, ""), (0, "short")]
    rows = [(k, prose(rng, lang, 60), lang) for k, lang in enumerate(["aa", "bb"] * 60)]
    texts = {k: t for k, t, _ in rows}
    rows += [(300, texts[4], "aa"), (301, texts[4], "aa"), (301, texts[4], "aa"), (None, texts[4], "aa"), (302, texts[6] + " Ba", "aa")]  # copies
    rows += [(None, prose(rng, "aa", 50), "aa"), (None, prose(rng, "bb", 50), None), (7, prose(rng, "bb", 40), "bb")]  # no id, an id of two texts
    rows += [(310 + k, f"{prose(rng, 'bb', 20)} {items[k][1]} {prose(rng, 'bb', 20)}", "bb") for k in range(3)] + [(None, f"{prose(rng, 'aa', 30)} {items[3][1]}", None)]
    rows += [(320, f"{prose(rng, 'aa', 40)} password=abcDEF123456xyz {prose(rng, 'aa', 9)}", "aa"), (None, f"{prose(rng, 'aa', 44)} 0123456789abcdef77 é", "aa")]
    rows += [(330, None, "aa"), (331, "", "bb"), (332, "12 !! 34", None), (333, prose(rng, "aa", 3000), "aa"), (334, prose(rng, "bb", 55), "bb"), (334, None, None)]
    spark.createDataFrame([(*r, "s", len(r[1] or ""), "x", 0.5, "f", 1, 2, 3, 4) for r in rows], SCHEMA).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def read(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


def bag(df):
    return Counter(map(tuple, df.collect()))


def brute_language(docs):
    import zstandard

    learned = langid.learn_dictionaries(docs, F.lit(True))

    def size(text, data):
        content = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return len(zstandard.ZstdCompressor(level=langid.LEVEL, dict_data=content, write_content_size=False).compress(text.lower().encode()))

    def kept(text):
        if not text or not re.search(r"[^\W\d_]", text):
            return False
        best, second, *_ = sorted(size(text, d) for d in learned.values())
        return (second - best) / best >= langid.MARGIN

    return [r for r in docs.collect() if kept(r.text)]


def brute_distinct(rows):
    fps, root = [simhash.fingerprint(r.text) for r in rows], list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, a in enumerate(fps):
        for j in range(i):
            if (a ^ fps[j]).bit_count() <= 2:
                root[find(i)] = find(j)
    groups = {}
    for k, r in enumerate(rows):
        groups.setdefault(find(k), []).append(r)
    return groups.values()


def holds(text, item):
    low, item = text.lower(), item.lower()
    cost = [0] * (len(low) + 1)
    for i, c in enumerate(item, 1):
        last, cost = cost, [i]
        for j, d in enumerate(low, 1):
            cost.append(min(last[j - 1] + (c != d), last[j] + 1, cost[j - 1] + 1))
    return min(cost) <= decontam.edit_budget(len(item))


def test_language_stage(spark, folder):
    docs = read(spark, folder)
    got = corpus_pipeline.language(spark, docs, folder)
    assert bag(got) == Counter(map(tuple, brute_language(docs))) and got.columns == docs.columns
    ids = {r.doc_id for r in got.collect()}
    assert set(range(120)) <= ids and not ids & {330, 331, 332}


def test_near_duplicate_stage(spark, folder):
    docs = read(spark, folder)
    got = corpus_pipeline.near_duplicates(spark, docs, folder)
    groups, kept = brute_distinct(docs.collect()), bag(got)
    assert sum(kept.values()) == len(groups) and got.columns == docs.columns
    for group in groups:
        ids = [r.doc_id for r in group if r.doc_id is not None]
        mine = [r for r in set(group) if tuple(r) in kept]
        assert len(mine) == 1 and mine[0].doc_id == min(ids, default=None)
    twice = docs.where("doc_id > 300 or doc_id is null")  # the kept row itself is repeated
    assert sum(bag(corpus_pipeline.near_duplicates(spark, twice, folder)).values()) == len(brute_distinct(twice.collect()))


def test_benchmark_stage(spark, folder):
    docs, items = read(spark, folder), [r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    items = [t for t in items if t and len(t) >= decontam.LEAST_CHARS]
    some = docs.where("doc_id is null or doc_id < 20 or doc_id between 310 and 332")
    want = [r for r in some.collect() if not any(holds(r.text or "", t) for t in items)]
    got = corpus_pipeline.benchmark(spark, some, folder)
    assert bag(got) == Counter(map(tuple, want)) and some.count() - len(want) == 4
    assert bag(decontam.without_benchmark(docs, spark.createDataFrame([], "item_id long, text string"))) == bag(docs)


def masked(text):
    patterns = [(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12), (r"AKIA[A-Z0-9]+", 0, 18), (r"[0-9a-f]+", 0, 16)]
    cut = sorted(m.span() for p, g, least in patterns for m in re.finditer(p, text) if len(m[g]) >= least)
    for a, b in reversed(cut):
        text = f"{text[:a]}[SECRET]{text[b:]}"
    return text


def test_secret_stage(spark, folder):
    docs = read(spark, folder)
    got = corpus_pipeline.secret_spans(spark, docs, folder)
    want = Counter()
    for r in docs.collect():
        t = r.text and masked(r.text)
        want[tuple({**r.asDict(), "text": t, "n_chars": len(t) if t != r.text else r.n_chars}.values())] += 1
    assert bag(got) == want and got.columns == docs.columns and bag(got) != bag(docs)


def test_run_packs_what_the_stages_keep(spark, folder):
    from tokenizers import Tokenizer

    docs, library = read(spark, folder), Tokenizer.from_file(BPE)
    items = [r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").where("length(text) >= 32").collect()]
    kept = [min(g, key=lambda r: (r.doc_id is None, r.doc_id)) for g in brute_distinct(brute_language(docs))]
    texts = [(r.doc_id, masked(r.text)) for r in kept if not any(t.lower() in r.text.lower() for t in items)]
    want = Counter()
    for doc, text in texts:
        ids = np.array([*library.encode(text, add_special_tokens=False).ids, 2], "<u4")
        edges = [0, *range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)]
        want.update((doc, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)))
    got = corpus_pipeline.run(spark, folder).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    fills = Counter()
    for r in got:
        fills[r.sequence_id] += r.length
    assert max(fills.values()) <= 1024 and len(fills) <= 1.05 * sum(fills.values()) / 1024 + 1


def test_stages_take_an_empty_table(spark, folder):
    docs = read(spark, folder).limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0, name


SF = "/root/testdata/sf0.01"


def test_op4_query_finds_every_passage(spark):
    docs, items = ([(r[0], r.text) for r in spark.read.parquet(f"{SF}/{t}.parquet").where("text is not null").collect()] for t in ("documents", "benchmark"))
    flat = lambda t: re.sub(r"\s+", " ", t.lower())
    exact = {(d, i) for i, t in items for d, text in docs if flat(t) in flat(text)}
    got = {(r.doc_id, r.item_id): r for r in decontam.op4_decontamination(spark, SF).collect()}
    assert exact and exact <= set(got)
    text, item = dict(docs), dict(items)
    assert all(holds(text[d], item[i]) for d, i in set(got) - exact)


def test_op7_and_op10_queries_hold_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    lang = {r.doc_id: r.lang for r in docs.where("lang is not null").select("doc_id", "lang").collect()}
    rows = langid.op7_language_id(spark, SF).collect()
    held = [r for r in rows if r.held_out and r.doc_id in lang]
    assert len(rows) == docs.count() and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.9
    label = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    scores = toxicity.op10_toxicity(spark, SF).collect()
    assert len(scores) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in scores)
    known = [(r.predicted, label[r.doc_id]) for r in scores if r.held_out and r.doc_id in label]
    hits, said, toxic = sum(a and b for a, b in known), sum(a for a, _ in known), sum(b for _, b in known)
    assert toxic and hits >= 0.6 * toxic and hits >= 0.9 * said
