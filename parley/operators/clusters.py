"""Cluster agreement, silhouettes, unit vectors and known-item queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.operators.retrieval import dot, norm

# Words that never make a key word, the characters of a token, and those that mark a token as telling.
STOP_WORDS = (
    "about", "after", "again", "also", "been", "before", "being", "between", "could", "does", "from", "have", "into", "more", "only", "other", "should", "some", "such",
    "than", "that", "their", "then", "there", "these", "they", "this", "those", "through", "using", "very", "want", "what", "when", "where", "which", "while", "with", "would",
    "без", "более", "быть", "будет", "вот", "всего", "где", "для", "если", "есть", "ещё", "как", "какие", "когда", "который", "между", "может", "можно", "надо", "нужно",
    "после", "почему", "при", "про", "сделать", "так", "также", "только", "уже", "чтобы", "этого", "это",
)
KNOWN_TOKEN, TELLING = r"[\p{L}\p{N}_./:+#@-]{3,}", r"[0-9_./:+#@-]"
MOST_QUERY_CHARS = 500


def unit(v: Column) -> Column:
    """The vector over its length; zeros stay."""
    n = norm(v)
    return F.transform(v, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(F.lit(0.0)))


def _table(rows: DataFrame, a: str, b: str) -> DataFrame:
    return rows.groupBy(a, b).agg(F.count(F.lit(1)).cast("double").alias("n"))


def adjusted_rand(rows: DataFrame, a: str, b: str) -> DataFrame:
    t = _table(rows, a, b)
    pairs = lambda df: df.agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("s"), F.sum("n").alias("n")).first()
    both, pa, pb = pairs(t), pairs(t.groupBy(a).agg(F.sum("n").alias("n"))), pairs(t.groupBy(b).agg(F.sum("n").alias("n")))
    n = both["n"] or 0.0
    if n < 2:
        return rows.sparkSession.createDataFrame([(1.0,)], "ari double")
    expected = pa["s"] * pb["s"] / (n * (n - 1) / 2)
    top, bottom = both["s"] - expected, (pa["s"] + pb["s"]) / 2 - expected
    return rows.sparkSession.createDataFrame([(round(top / bottom, 6) if bottom else 1.0,)], "ari double")


def normalized_mutual_information(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Mutual information over the geometric mean of the entropies."""
    t = _table(rows, a, b)
    ta, tb = t.groupBy(a).agg(F.sum("n").alias("na")), t.groupBy(b).agg(F.sum("n").alias("nb"))
    n = t.agg(F.sum("n")).first()[0] or 1.0
    mi = t.join(ta, a).join(tb, b).agg(F.sum(F.col("n") / n * F.ln(F.col("n") * n / (F.col("na") * F.col("nb")))).alias("mi"))
    entropy = lambda df, c: df.agg((-F.sum(F.col(c) / n * F.ln(F.col(c) / n))).alias("h")).first()["h"] or 0.0
    h = (entropy(ta, "na") * entropy(tb, "nb")) ** 0.5
    return mi.select(F.round(F.when(F.lit(h) > 0, F.col("mi") / h).otherwise(1.0), 6).alias("nmi"))


def silhouettes(vectors: DataFrame) -> DataFrame:
    """Cosine silhouettes.  The mean cosine distance to a cluster is 1 - u . S / n for its vector sum S: no pairs.

    vectors(vec_id, embedding, label) -> (vec_id, silhouette) of rows that share their cluster.  The cluster sums are
    one row a label.
    """
    rows = vectors.select("vec_id", "label", unit(F.col("embedding")).alias("u"))
    parts = rows.select("label", F.posexplode("u").alias("i", "x")).groupBy("label", "i").agg(F.sum("x").alias("x"))
    sums = parts.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("s"))
    sums = sums.join(rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")), "label").select(F.col("label").alias("other"), "s", "n")
    far = rows.join(F.broadcast(sums))
    same = F.col("label") == F.col("other")
    inner = dot(F.col("u"), F.col("s"))
    mean = F.when(same, F.when(F.col("n") > 1, (F.col("n") - 1 - (inner - dot(F.col("u"), F.col("u")))) / (F.col("n") - 1))).otherwise((F.col("n") - inner) / F.col("n"))
    g = far.withColumn("_m", mean).groupBy("vec_id").agg(F.max(F.when(same, F.col("_m"))).alias("own"), F.min(F.when(~same, F.col("_m"))).alias("near"))
    return g.filter("own is not null").select("vec_id", ((F.col("near") - F.col("own")) / F.greatest("own", "near")).alias("silhouette"))


def known_item_queries(docs: DataFrame, doc_id: str, text: str, width: int = 12, keywords: int = 6) -> DataFrame:
    """(doc_id, verbatim, keyword): a hash-placed window of words, and the longest distinct words in order of place."""
    w = docs.select(F.col(doc_id).alias("doc_id"), F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({KNOWN_TOKEN})"), F.lit(1)), F.lower).alias("w"))
    n = F.size("w") - width + 1
    offset = F.conv(F.substring(F.sha2(F.col("doc_id").cast("string"), 256), 1, 8), 16, 10).cast("bigint") % F.greatest(n, F.lit(1))
    verbatim = F.when(n > 0, F.array_join(F.slice("w", (offset + 1).cast("int"), F.lit(width)), " "))
    long = F.filter(F.array_distinct("w"), lambda x: (F.length(x) >= 5) & ~x.isin(*STOP_WORDS))
    signal = lambda x: F.when(x.rlike(TELLING), 0).otherwise(1)
    ranked = F.slice(F.array_sort(F.transform(long, lambda x, i: F.struct(signal(x).alias("a"), (-F.length(x)).alias("b"), i.alias("i"), x.alias("t")))), 1, keywords)
    placed = F.array_sort(F.transform(ranked, lambda x: F.struct(x["i"].alias("i"), x["t"].alias("t"))))
    keyword = F.when(F.size(ranked) >= 5, F.array_join(F.transform(placed, lambda x: x["t"]), " "))
    short = lambda c: F.when(F.length(c) <= MOST_QUERY_CHARS, c)
    return w.select("doc_id", short(verbatim).alias("verbatim"), short(keyword).alias("keyword"))
