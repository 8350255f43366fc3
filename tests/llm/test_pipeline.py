"""The pipeline's stages against plain versions of what they do."""

import random
from collections import Counter

import corpus_pipeline
from parley.llm.decontamination import shingles_of, words_of
from parley.llm.quality_rules import apply_rules
from tests.llm.cases import words

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def corpus():
    rng = random.Random(11)
    items = [words(rng, 30) for _ in range(4)]
    texts = [words(rng, 150) for _ in range(80)]
    rows = list(enumerate(texts))
    rows += [(100 + i, texts[i]) for i in range(10)]  # copies
    rows += [(200 + i, words(rng, 60) + " " + items[i] + " " + words(rng, 60)) for i in range(4)]  # leaks
    rows += [(300 + i, " ".join(w + "###" for w in words(rng, 80).split())) for i in range(60)]  # junk
    rows += [(400, None), (401, ""), (402, "few words only")]
    docs = [(i, t, "en", "s0" if i % 3 else "s1", len(t or "")) for i, t in rows]
    labels = [(i, 1, 0) for i in range(80)] + [(300 + i, 0, 0) for i in range(60)]
    return docs, list(enumerate(items)), labels


def test_stages_do_what_they_say(spark, tmp_path):
    docs, items, labels = corpus()
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    now, got = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        now = stage(spark, now, str(tmp_path))
        now.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        got[name] = now.collect()
        if i < len(corpus_pipeline.STAGES) - 1:
            assert now.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    clean = {*range(80), *range(100, 110), *range(200, 204)}
    assert {r.doc_id for r in got["quality_rules"]} == clean
    assert {r.doc_id for r in got["near_copies"]} == clean - {*range(100, 110)}
    leaked = {i for i, t, *_ in docs if any(len(s & shingles_of(words_of(t))) >= 0.8 * len(s) for s in (shingles_of(words_of(x)) for _, x in items))}
    assert leaked == {*range(200, 204)} and {r.doc_id for r in got["benchmark_leaks"]} == set(range(80))
    mix = Counter(r.doc_id for r in got["source_mix"])
    assert set(mix) <= set(range(80)) and 40 < sum(mix.values()) < 130
    assert Counter(r.doc_id for r in got["token_files"]) == mix
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows) == Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got["token_files"])


def test_empty_documents_pass_all_stages(spark, tmp_path):
    _, items, labels = corpus()
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert apply_rules(spark.createDataFrame([], SCHEMA), []).count() == 0
