"""Quality classifier: a sparse rule ensemble over text statistics.

1. Statistics: one Arrow pass counts byte classes and word shapes of every whole text.
2. Rules: a small random forest is fitted to labelled rows; every path from a root to a node is a
   conjunctive rule over statistics.
3. Weights: lasso logistic regression over the rules' 0/1 values leaves a few with weights.
4. The weighted rules become one Spark column expression, which scores all documents.

Fitting uses at most ``SAMPLE`` labelled rows (the lowest hashes of their identifiers), so the model
costs the same at every size; scoring covers every document.

Rules: labels are learnt only from rows whose crc32 of the identifier mod 4 is not 2; neither
labels, language, source nor identifier are inputs of a score. A null text is the empty text, whose
statistics are all 0. Several labels of one document count as their largest; null labels do not
count. Without labels of both classes every score is the smoothed share of label 1 (0.5 without any).
A null identifier is not held out and never learnt from.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keelson.llm.common import boxed, buffers, mix64, pieces, read, save

SAMPLE = 12_000
TREES, DEPTH, SEED = 24, 4, 7
LASSO = 0.001
THRESHOLD = 0.7
TEXT_LIMIT = 1 << 20

(LOWER, UPPER, DIGIT, SPACE, LINE, PUNCT, BANG, SYMBOL, WIDE, OTHER) = range(10)
STATS = ["log_bytes", "log_words", "word_length", "upper", "digits", "punct", "bangs", "symbols", "wide", "lines",
         "caps_words", "title_words", "symbol_ends", "bang_ends", "stop_ends", "bare_symbols", "repeats", "distinct"]
PREFIX = "_stat_"


def byte_classes() -> np.ndarray:
    table = np.full(256, OTHER, np.uint8)
    for own, chars in ((PUNCT, b".,;:'\"-()?"), (BANG, b"!"), (SYMBOL, b"#$%&*+/<=>@[\\]^_`{|}~"),
                       (SPACE, b" \t\v\f\r"), (LINE, b"\n")):
        table[list(chars)] = own
    table[ord("a"):ord("z") + 1] = LOWER
    table[ord("A"):ord("Z") + 1] = UPPER
    table[ord("0"):ord("9") + 1] = DIGIT
    table[128:] = WIDE
    return table


CLASSES = byte_classes()
MULTIPLIER = 0x9E3779B97F4A7C15 | 1


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """(m ** i, m ** -i) mod 2 ** 64 for i < n."""
    out = np.ones((2, n), np.uint64)
    out[0, 1:], out[1, 1:] = MULTIPLIER, pow(MULTIPLIER, -1, 1 << 64)
    return tuple(np.multiply.accumulate(out, axis=1))


def statistics(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One row of STATS per text of a batch of UTF-8 texts."""
    docs = len(off) - 1
    size = np.diff(off)
    kind = CLASSES[data]
    owner = np.repeat(np.arange(docs), size)
    count = np.bincount(owner * 10 + kind, minlength=docs * 10).reshape(docs, 10).astype(float)
    inside = (kind != SPACE) & (kind != LINE)
    first = np.zeros(len(data) + 1, bool)
    first[off[:-1]] = True
    starts = np.flatnonzero(inside & (first[:-1] | np.append(True, ~inside[:-1])))
    ends = np.flatnonzero(inside & (np.append(first[1:-1], True) | np.append(~inside[1:], True))) + 1
    of = owner[starts]

    def per_doc(mask):
        return np.bincount(of, weights=mask, minlength=docs)

    words = np.bincount(of, minlength=docs).astype(float)
    length = ends - starts
    uppers = np.concatenate([[0], np.cumsum(kind == UPPER)])
    lowers = np.concatenate([[0], np.cumsum(kind == LOWER)])
    up, low = uppers[ends] - uppers[starts], lowers[ends] - lowers[starts]
    end_kind, start_kind = kind[ends - 1], kind[starts]
    up_pow, down_pow = powers(len(data) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up_pow[:-1])])
    word = mix64((sums[ends] - sums[starts]) * down_pow[starts])
    again = np.zeros(len(word), bool)
    again[1:] = (word[1:] == word[:-1]) & (of[1:] == of[:-1])
    own = distinct_owners(of, word)
    n, w, letters = np.maximum(size, 1), np.maximum(words, 1), np.maximum(count[:, LOWER] + count[:, UPPER], 1)
    return np.stack([
        np.log1p(size), np.log1p(words), per_doc(length) / w, count[:, UPPER] / letters, count[:, DIGIT] / n,
        count[:, PUNCT] / n, count[:, BANG] / n, count[:, SYMBOL] / n, count[:, WIDE] / n, count[:, LINE] / w,
        per_doc((up > 0) & (low == 0) & (length > 1)) / w, per_doc((start_kind == UPPER) & (low > 0)) / w,
        per_doc(end_kind == SYMBOL) / w, per_doc(end_kind == BANG) / w, per_doc(end_kind == PUNCT) / w,
        per_doc((length == 1) & (end_kind == SYMBOL)) / w, per_doc(again) / w,
        np.bincount(own, minlength=docs) / w], axis=1)


def distinct_owners(of: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The text of each distinct (text, word)."""
    key = mix64(word + of.astype(np.uint64) * np.uint64(MULTIPLIER))
    order = np.argsort(key, kind="stable")
    key = key[order]
    fresh = np.append(True, key[1:] != key[:-1])[:len(key)]
    return of[order][fresh]


def with_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with a column for each statistic of the text."""
    names = [PREFIX + s for s in STATS]
    out = docs.withColumn(PREFIX + "text", F.coalesce(F.col(text_col), F.lit("")).cast("binary"))
    schema = T.StructType([*docs.schema.fields, *[T.StructField(x, T.DoubleType()) for x in names]])

    def run(batches):
        for batch in batches:
            data, off = buffers(batch.column(batch.num_columns - 1))
            for a, b in pieces(off, TEXT_LIMIT):
                table = statistics(data[off[a]:off[b]], off[a:b + 1] - off[a])
                rows = batch.slice(a, b - a)
                cols = [rows.column(i) for i in range(rows.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*cols, *[pa.array(c) for c in table.T]], [*rows.schema.names[:-1], *names])
    return out.mapInArrow(run, schema)


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, text_col: str = "text") -> DataFrame:
    """Statistics and label of at most ``sample`` labelled documents that are not held out; the
    bounded set of identifiers is broadcast to the documents."""
    learn = (labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out())
             .groupBy("doc_id").agg(F.max("quality").cast("double").alias("_label"))
             .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
             .withColumnRenamed("doc_id", "_id"))
    rows = (docs.select("doc_id", F.col(text_col).alias("_text"))
            .join(F.broadcast(learn), F.col("doc_id") == F.col("_id")).select("_id", "_label", "_text"))
    stats = with_statistics(rows, "_text").drop("_text")
    return save(save(stats, "labelled").coalesce(1).sortWithinPartitions("_id"), "labelled-sorted")


def tree_rules(model) -> list[tuple]:
    """Every path from a root to a node as a conjunction ((statistic, is_above, threshold), ...)."""
    found = set()

    def walk(node, path):
        if path:
            found.add(tuple(sorted(path)))
        if node.getClass().getSimpleName() == "InternalNode":
            split = node.split()
            at = (int(split.featureIndex()), float(split.threshold()))
            walk(node.leftChild(), path + [(at[0], False, at[1])])
            walk(node.rightChild(), path + [(at[0], True, at[1])])

    for tree in model.trees:
        walk(tree._call_java("rootNode"), [])
    return sorted(found)


def rule_column(rule: tuple) -> Column:
    cond = F.lit(True)
    for stat, above, at in rule:
        col = F.col(PREFIX + STATS[stat])
        cond = cond & ((col > at) if above else (col <= at))
    return F.when(cond, F.lit(1.0)).otherwise(F.lit(0.0))


def rule_values(sample: DataFrame, rules: list[tuple]) -> DataFrame:
    """(_label, _values): the 0/1 values of all rules, one array per sampled row."""
    def run(batches):
        for batch in batches:
            stats = np.stack([batch.column(i + 1).to_numpy() for i in range(len(STATS))], 1)
            hits = [np.all([(stats[:, i] > at) == above for i, above, at in rule], axis=0) for rule in rules]
            flat = np.stack(hits, 1).astype(float).ravel()
            offsets = np.arange(0, len(flat) + 1, len(rules), dtype=np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, flat)], ["_label", "_values"])
    return sample.select("_label", *[PREFIX + s for s in STATS]).mapInArrow(run, "_label double, _values array<double>")


def fit(sample: DataFrame, trees: int = TREES, depth: int = DEPTH, lasso: float = LASSO) -> dict:
    """{"bias": b, "rules": [(rule, weight)]} from a sample of statistics and ``_label``."""
    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import array_to_vector

    counts = {r["_label"]: r["count"] for r in sample.groupBy("_label").count().collect()}
    ones, all_rows = counts.get(1.0, 0), sum(counts.values())
    if not ones or ones == all_rows:
        p = (ones + 1) / (all_rows + 2)
        return {"bias": math.log(p / (1 - p)), "rules": []}
    stats = VectorAssembler(inputCols=[PREFIX + s for s in STATS], outputCol="_features").transform(sample)
    forest = RandomForestClassifier(labelCol="_label", featuresCol="_features", numTrees=trees, maxDepth=depth, seed=SEED,
                                    featureSubsetStrategy="onethird", minInstancesPerNode=max(1, min(4, all_rows // 100)))
    rules = tree_rules(forest.fit(stats.select("_features", "_label")))
    if not rules:
        p = (ones + 1) / (all_rows + 2)
        return {"bias": math.log(p / (1 - p)), "rules": []}
    values = rule_values(sample, rules).select("_label", array_to_vector("_values").alias("_rules"))
    lr = LogisticRegression(labelCol="_label", featuresCol="_rules", elasticNetParam=1.0, regParam=lasso,
                            standardization=False, maxIter=60)
    model = lr.fit(values.select("_rules", "_label"))
    return {"bias": float(model.intercept),
            "rules": [(r, float(w)) for r, w in zip(rules, model.coefficients.toArray()) if w != 0]}


def score_column(model: dict) -> Column:
    total = F.lit(model["bias"])
    for rule, weight in model["rules"]:
        total = total + rule_column(rule) * F.lit(weight)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict:
    return fit(labelled_sample(docs, labels, sample))


def scored(docs: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """(row, score): whole rows boxed beside their score."""
    return with_statistics(boxed(docs, text=F.col(text_col)), "text").select("row", score_column(model).alias("score"))


def op3_quality(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, read(spark, sf_dir, "labels"))
    return scored(docs, model).select(
        "row.doc_id", held_out("row.doc_id").alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the classifier accepts, with their columns as they are."""
    return scored(docs, train(docs, labels)).where(F.col("score") >= threshold).select("row.*")
