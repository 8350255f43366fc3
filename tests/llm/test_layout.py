"""Sharding, mixing and token files."""

import zlib
from collections import Counter, defaultdict
from math import exp, factorial
from statistics import mean

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from parley.llm import mixing as M
from parley.llm import sharding as S
from parley.llm import tokens as T
from tests.llm.cases import documents, frame


def test_running_totals_equal_a_loop(spark):
    rows = [(i % 17 - 3, (i * 7919) % 100) for i in range(500)] + [(None, 4), (None, 5)]
    df = spark.createDataFrame(rows, "k bigint, v bigint")
    for n in (8, 100, 100_000):
        got = sorted((r.before, r.v) for r in S.running_totals(df, ["k", "v"], {"before": F.col("v")}, n).collect())
        at = 0
        for before, v in got:
            assert before == at or v == 0
            at = before + v
        assert at == sum(v for _, v in rows)


def test_sharding_keeps_clashing_columns_and_names_those_it_adds(spark):
    names = ["parley_tie", "parley_part", "parley_before", "parley_rank", "parley_first", "parley_sum_0", "parley_amount_0", "_bucket"]
    sized = spark.createDataFrame([(i % 3, 20, *["mine"] * len(names)) for i in range(50)], "doc_id bigint, size bigint, " + ", ".join(f"{x} string" for x in names))
    out = S.assign_shards(sized, 4, ["doc_id", "size"], 10)
    assert out.columns == [*sized.columns, "shard", "slot"] and {tuple(r)[2:-2] for r in out.collect()} == {("mine",) * len(names)}
    with pytest.raises(ValueError, match="shard"):
        S.assign_shards(sized.withColumn("shard", F.lit(1)), 4, ["doc_id"])


def test_one_id_of_many_rows_is_split(spark):
    sized = spark.createDataFrame([(7, 20)] * 400 + [(None, 30)] * 200, "doc_id bigint, size bigint")
    rows = S.running_totals(sized, ["doc_id", "size"], {"before": F.col("size")}, 50)
    assert sorted(r.before for r in rows.collect()) == [30 * i for i in range(200)] + [6000 + 20 * i for i in range(400)]


@pytest.mark.parametrize("n", [1, 3, 40])
def test_shards_are_contiguous_balanced_and_gapless(spark, tmp_path, n):
    sized = spark.createDataFrame([(i, 16 + (i * 37) % 211) for i in range(2000)], "doc_id bigint, size bigint")
    out = sorted(S.assign_shards(sized, n, ["doc_id", "size"], 300).select("doc_id", "size", "shard", "slot").collect())
    assert [r.shard for r in out] == sorted(r.shard for r in out)
    by = defaultdict(list)
    for r in out:
        by[r.shard].append(r)
    assert sorted(by) == list(range(n))
    assert all([r.slot for r in v] == list(range(len(v))) for v in by.values())
    totals = [sum(r.size for r in v) for v in by.values()]
    assert max(totals) - min(totals) <= 2 * max(r.size for r in out)


def test_op2_over_awkward_rows(spark, tmp_path):
    frame(spark).write.parquet(f"{tmp_path}/documents.parquet")
    out = S.op2_sharding(spark, str(tmp_path)).collect()
    want = Counter((r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in documents())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == want
    by = defaultdict(list)
    for r in out:
        by[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and {r.law for r in out} == {"bytes"}


def test_empty_tables(spark, tmp_path):
    frame(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    assert S.op2_sharding(spark, str(tmp_path)).count() == 0
    assert M.op3_mixing_sources(spark, str(tmp_path)).count() == 0
    assert T.op6_token_ids(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("rate", [0.2, 1.0, 3.7, 60.0])
def test_cumulative_is_the_poisson_distribution(spark, rate):
    cdf = spark.range(1).select(M.cumulative(F.lit(rate)).alias("c")).first().c
    total = 0.0
    for k in range(30):
        total += exp(-rate) * rate**k / factorial(k)
        assert abs(cdf[k] - total) < 1e-12
    assert cdf[-1] > 1 - 1e-12


@pytest.mark.parametrize("rate", [0.5, 2.0, 150.0])
def test_copies_have_the_target_mean_and_variance(spark, rate):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("a").alias("source"))
    mixed, _, _ = M.mix_sources(docs, {"a": 1.0}, 4000 * rate)
    n = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    counts = [n.get(i, 0) for i in range(4000)]
    assert abs(mean(counts) - rate) < 5 * (rate / 4000) ** 0.5
    assert 0.85 * rate < np.var(counts) < 1.15 * rate


def test_mix_keeps_columns_nulls_and_weights(spark):
    docs = frame(spark).withColumn("copy_no", F.lit("mine"))
    mixed, copy, key = M.mix_sources(docs, {"s0": 1.0, None: 1.0}, 400)
    assert copy == "copy_no_1" and mixed.columns == [*docs.columns, copy, key]
    rows = mixed.collect()
    assert {r.source for r in rows} == {"s0", None} and {r.copy_no for r in rows} == {"mine"}
    again = M.mix_sources(docs.repartition(7), {"s0": 1.0, None: 1.0}, 400)[0].collect()
    assert Counter(map(str, rows)) == Counter(map(str, again))
    with pytest.raises(ValueError):
        M.mix_sources(docs, {"s0": -1.0})


def test_token_files_equal_whole_text_encoding(spark, tmp_path):
    frame(spark).write.parquet(f"{tmp_path}/documents.parquet")
    got = T.op6_token_ids(spark, str(tmp_path)).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path(T.VOCABULARY))
    want = Counter()
    for r in documents():
        ids = [*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 1]
        want[r[0], len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens


def test_start_is_the_place_in_the_files(spark, tmp_path):
    import pyarrow.parquet as pq

    docs = spark.createDataFrame([(1, "a b c d e f g h i"), (1, "a"), (1, "a b c"), (2, "a"), (None, "x y"), (None, None)] + [(3, f"w{i}") for i in range(50)], "doc_id bigint, text string")
    path = str(tmp_path / "tokens")
    T.write_tokens(docs.repartition(3), path)
    flat, at, want = [], 0, []
    for f in sorted((tmp_path / "tokens").glob("part-*.parquet")):
        t = pq.read_table(f)
        for doc, ids in zip(t["doc_id"].to_pylist(), t["ids"].to_pylist(), strict=True):
            want.append((doc, at, len(ids)))
            at += len(ids)
            flat += ids
    order = [x[0] for x in want]
    assert order == sorted(order, key=lambda d: (d is not None, d or 0))
    assert Counter((r.doc_id, r.start, r.n_tokens) for r in T.token_digest(spark, path).collect()) == Counter(want)
    assert Counter((r.doc_id, r.start, r.n_tokens) for r in T.read_counts(spark, path).collect()) == Counter(want)


def test_a_range_of_documents_reads_some_pages_only(spark, tmp_path):
    import pyarrow.parquet as pq

    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *(F.md5(F.concat(F.col("id").cast("string"), F.lit(str(k)))) for k in range(8))).alias("text"))
    path = str(tmp_path / "tokens")
    T.write_tokens(docs.coalesce(1), path)
    (file,) = (tmp_path / "tokens").glob("part-*.parquet")
    column = pq.ParquetFile(file).metadata.row_group(0).column(2)
    assert column.path_in_schema == "ids.list.element" and column.has_offset_index and column.total_compressed_size > 4 * T.PAGE_BYTES
    some = spark.read.parquet(path).filter("doc_id between 2000 and 2009")
    assert "PushedFilters: [IsNotNull(doc_id), GreaterThanOrEqual(doc_id,2000), LessThanOrEqual(doc_id,2009)]" in some._jdf.queryExecution().executedPlan().toString()
    # Row numbers survive page skipping, and only the pages of the range are decoded.
    rows = some.select("doc_id", F.size("ids").alias("n"), F.col("_metadata.row_index").alias("i"))
    assert [(r.doc_id, r.i) for r in rows.orderBy("doc_id").collect()] == [(k, k) for k in range(2000, 2010)]
    scan = spark.read.parquet(path)
    read = scan.filter("doc_id >= 2000 and doc_id <= 2009").select(F.col("doc_id"), F.size("ids"))
    plan = read._jdf.queryExecution().executedPlan()
    plan.executeCollect()
    leaf = plan.collectLeaves().apply(0)
    assert leaf.metrics().apply("numOutputRows").value() < 4000


def test_kept_columns_may_not_clash(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a", "z")], "doc_id bigint, text string, ids string")
    with pytest.raises(ValueError, match="ids"):
        T.write_tokens(docs, str(tmp_path / "t"), keep=("ids",))
    T.write_tokens(docs.withColumn("parley_tie", F.lit(1)), str(tmp_path / "t"), keep=("parley_tie",))
    assert spark.read.parquet(str(tmp_path / "t")).columns == ["doc_id", "parley_tie", "n_tokens", "ids"]


def test_token_files_have_chosen_layout(spark, tmp_path):
    import glob

    import pyarrow.parquet as pq

    path = str(tmp_path / "tokens")
    T.write_tokens(frame(spark), path, keep=("lang",))
    meta = [pq.ParquetFile(f).metadata for f in glob.glob(f"{path}/*.parquet")]
    columns = {m.row_group(g).column(c).path_in_schema: m.row_group(g).column(c) for m in meta for g in range(m.num_row_groups) for c in range(m.num_columns)}
    assert "DELTA_BINARY_PACKED" in str(columns["doc_id"].encodings) and "DICTIONARY" in str(columns["ids.list.element"].encodings)
    assert all(c.has_offset_index for c in columns.values())
    counts = T.read_counts(spark, path)
    assert "ids" not in counts._jdf.queryExecution().executedPlan().toString()


def test_part_cache_is_bounded_and_exact(monkeypatch):
    import random

    import pyarrow as pa

    monkeypatch.setattr(T, "CACHE_PARTS", 50)
    cache = T.WordCache(public_tokenizers.path(T.VOCABULARY))
    rng = random.Random(2)
    letters = "aZéİßÿ'’.-_#<|>12²½ \n\t\u0301≠ſıçÇ”“…\xa0\x1c 日本😀Ⅷ´`^~×÷"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 40))) for _ in range(3000)] + ["<|endoftext|> x<|startoftext|>y", "don't we'll it's I'VE", "a." * 500]
    for a in range(0, len(texts), 100):
        part = texts[a : a + 100]
        assert cache.encode(pa.array(part), 1).to_pylist() == [[*cache.tokenizer.encode(t, add_special_tokens=False).ids, 1] for t in part]
        assert len(cache.now.number) + len(cache.older.number) < 5000
    whole = T.WordCache(public_tokenizers.path("byte_bpe_50k.json"))
    assert not whole.by_word and whole.encode(pa.array(["a b", None]), 1).to_pylist() == [[*whole.tokenizer.encode("a b").ids, 1], [1]]
