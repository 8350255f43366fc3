"""Quality rules and the quality classifier against plain Python."""

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from parley.llm import quality_classifier as Q
from parley.llm import quality_rules as R
from parley.llm.textstats import COUNTS, RATIOS, count_batch, repeated_windows
from tests.llm.cases import documents, frame


def plain(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_counts_equal_plain_python():
    texts = [r[1] for r in documents()]
    got = count_batch(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        assert tuple(int(got[k][i]) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == plain(t), t


def test_counts_of_an_empty_batch():
    assert all(len(v) == 0 for v in count_batch(pa.array([], pa.string())).values())


def test_clashing_window_keys_fall_back_to_exact_ranks(monkeypatch):
    from parley.llm import textstats

    codes, doc = np.array([1, 2, 3, 4, 5, 1, 2, 3, 4, 5, 9, 9]), np.zeros(12, np.int64)
    exact = repeated_windows(codes, doc)
    monkeypatch.setattr(textstats, "_KEYS", np.zeros(6, np.uint64))
    assert (repeated_windows(codes, doc) == exact).all() and exact.sum() == 10


def learnable(n=400):
    rng = np.random.default_rng(3)
    x = rng.random((n, len(RATIOS)))
    bad = (x[:, 0] > 0.8) | ((x[:, 3] < 0.3) & (x[:, 5] > 0.5))
    return x, (~bad).astype(int)


def test_rules_are_learned_in_order_and_precise():
    x, y = learnable()
    rules = R.learn_rules(x, y)
    hit = np.zeros(len(x), bool)
    for r in rules:
        hit |= R.covers(x, r.conditions)
    assert rules and (hit == (y == 0)).mean() > 0.97


@pytest.mark.parametrize("y", [np.ones(5, int), np.zeros(5, int), np.zeros(0, int)])
def test_rules_need_both_classes(y):
    assert R.learn_rules(np.random.default_rng(0).random((len(y), len(RATIOS))), y) == []


def test_apply_rules_keeps_columns_and_clean_rows(spark):
    docs = frame(spark)
    rules = [R.Rule((R.Condition("symbol_share", True, 0.2),), 3, 1.0)]
    kept = R.apply_rules(docs, rules)
    assert kept.columns == docs.columns
    want = Counter(r[0] for r in documents() if not (plain(r[1])[0] < 10 or 100 * plain(r[1])[4] > 20 * plain(r[1])[0] or plain(r[1])[2] > 0.2 * len(r[1])))
    assert Counter(r.doc_id for r in kept.collect()) == want
    assert R.apply_rules(frame(spark, []), rules).count() == 0


def test_forest_fits_and_flat_arrays_traverse():
    x, y = learnable()
    model = Q.fit(x[:300], y[:300])
    assert ((Q.predict(model, x[300:]) >= 0.5) == y[300:]).mean() > 0.93
    assert (Q.predict(Q.fit(x[:0], y[:0]), x) == 0.5).all()


def plain_walk(model, row):
    """One document down every tree, node by node."""
    total = model.base
    for node in model.roots:
        while model.feature[node] >= 0:
            node = model.left[node] if row[model.feature[node]] <= model.threshold[node] else model.right[node]
        total += model.value[node]
    return 1 / (1 + np.exp(-total))


def test_scores_equal_a_plain_tree_walk():
    x, y = learnable()
    model = Q.fit(x[:200], y[:200], trees=15)
    got = Q.scorer(model).over_arrays
    assert np.allclose(Q.predict(model, x), [plain_walk(model, row) for row in x], rtol=0, atol=1e-12)
    texts = [r[1] for r in documents()]
    rows = Q.ratios(count_batch(pa.array(texts, pa.string())))
    assert np.allclose(np.array(got(pa.array(texts, pa.string()))), [plain_walk(model, row) for row in rows], rtol=0, atol=1e-12)


def test_op1_and_op8_over_tables(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(240):
        text = " ".join("".join(rng.choice(list("abcdefgh"), 5)) for _ in range(40))
        rows.append((i, text if i % 4 else text.replace(" ", "### "), "en", "s", 1, None, None, None))
    frame(spark, [*rows, *documents()]).write.parquet(f"{tmp_path}/documents.parquet")
    marks = [(i, 1 if i % 4 else 0, 0) for i in range(240)] + [(None, 1, 0), (3, None, None)]
    spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    one = R.op1_quality_rules(spark, str(tmp_path)).collect()
    assert len(one) == len(rows) + len(documents())
    texts = Counter((r[0], *plain(r[1])) for r in [*rows, *documents()])
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in one) == texts
    for r in one:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept)
    # The learned verdict, recomputed: the list is learned again, and read rule by rule over plain ratios.
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    rules = R.learn_rules(*R.labelled_sample(docs, spark.read.parquet(f"{tmp_path}/labels.parquet")))
    names, want = list(RATIOS), Counter()
    for r in [*rows, *documents()]:
        x = Q.ratios(count_batch(pa.array([r[1]], pa.string())))[0]
        fires = [all(x[names.index(c.feature)] > c.threshold if c.above else x[names.index(c.feature)] <= c.threshold for c in rule.conditions) for rule in rules]
        n, _, _, _, repeated = plain(r[1])
        want[r[0], not (n < 10 or 100 * repeated > 20 * n) and not any(fires)] += 1
    assert rules and Counter((r.doc_id, r.kept) for r in one) == want
    eight = Q.op8_quality_classifier(spark, str(tmp_path)).collect()
    assert len(eight) == len(one) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in eight)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in eight if r.doc_id is not None)
    held = [r for r in eight if r.held_out and r.doc_id < 240 and len(rows) > r.doc_id]
    assert np.mean([r.predicted == (r.doc_id % 4 > 0) for r in held]) > 0.9


def test_ratio_names_are_counts():
    assert all(a in COUNTS and (b is None or b in COUNTS) for a, b in RATIOS.values())


def test_one_text_of_an_id_is_collected_and_it_is_always_the_same(spark):
    docs = [(i % 5, f"{'word ' * 12}{i}", "en", "s", 1, None, None, None) for i in range(60)] + [(None, "x", None, None, None, None, None, None)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(5)] + [(None, 1)], "doc_id bigint, quality int")
    one = R.labelled_sample(frame(spark, docs), labels)
    two = R.labelled_sample(frame(spark, docs[::-1]).repartition(7), labels)
    assert one[0].shape == (5, len(RATIOS)) and (one[0] == two[0]).all() and (one[1] == two[1]).all()
    assert R.labelled_sample(frame(spark, docs), labels, 3)[0].shape == (3, len(RATIOS))


def test_op1_and_op8_over_empty_tables(spark, tmp_path):
    no_labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    for name, rows in (("none", []), ("some", documents())):
        frame(spark, rows).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        no_labels.write.parquet(f"{tmp_path}/{name}/labels.parquet")
        one, eight = R.op1_quality_rules(spark, f"{tmp_path}/{name}").collect(), Q.op8_quality_classifier(spark, f"{tmp_path}/{name}").collect()
        assert len(one) == len(eight) == len(rows)
        assert all(r.kept == (not r.base_failed) for r in one) and {r.score for r in eight} <= {0.5}
