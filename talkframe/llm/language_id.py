"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ORDERS = (1, 2, 3)
BUCKETS = 1 << 15
#: Characters that are hashed at a time; long texts go in pieces of this length that overlap by the longest n-gram.
PIECE = 1 << 18


def gram_buckets(text: str, buckets: int = BUCKETS) -> Iterator[np.ndarray]:
    """The hash buckets of every character n-gram of the lower-cased text, piece by piece."""
    reach = max(ORDERS) - 1
    for at in range(0, max(len(text), 1), PIECE):
        fresh = min(PIECE, len(text) - at)
        codes = np.frombuffer(text[at : at + PIECE + reach].lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        letters = np.concatenate([codes, np.full(reach, 32, np.uint64)])
        last = at + PIECE >= len(text)
        n = len(codes) if last else min(fresh, len(codes))
        key = np.zeros(n, np.uint64)
        out = []
        for k in range(max(ORDERS)):
            key = (key + letters[k : k + n] + np.uint64(k + 1)) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
            if k + 1 in ORDERS:
                out.append((key >> np.uint64(40)) % np.uint64(buckets))
        yield np.concatenate(out).astype(np.int64)


@dataclass
class Model:
    """log_probs: buckets x classes, float32; priors: classes."""

    classes: list[str]
    log_probs: np.ndarray
    priors: np.ndarray

    def scores(self, texts: list[str]) -> np.ndarray:
        """Log joint probabilities, texts x classes: the sparse text-by-bucket matrix times log_probs, batch by batch."""
        out = np.tile(self.priors.astype(np.float64), (len(texts), 1))
        rows, starts, filled = [], [], 0
        queue: list[np.ndarray] = []

        def flush() -> None:
            nonlocal queue, rows, starts, filled
            if queue:
                parts = np.add.reduceat(self.log_probs[np.concatenate(queue)], starts, axis=0, dtype=np.float64)
                np.add.at(out, rows, parts)
            queue, rows, starts, filled = [], [], [], 0

        for i, text in enumerate(texts):
            for ix in gram_buckets(text, len(self.log_probs)):
                if len(ix):
                    queue.append(ix), rows.append(i), starts.append(filled)
                    filled += len(ix)
                if filled > PIECE:
                    flush()
        flush()
        return out


def fit(docs: DataFrame, text_col: str = "text", label_col: str = "lang", buckets: int = BUCKETS, most_bytes: int = 256 << 20) -> Model | None:
    """Counts every n-gram of every labelled row, on the executors; null where there is no labelled row.

    Each input partition counts its rows into one vector per class and sends the counts that are not 0; Spark sums them up by class and bucket. What
    reaches the driver is classes x `buckets` numbers, whatever the input; more than `most_bytes` of them is an error.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for label, text in zip(batch.column(1).to_pylist(), batch.column(0), strict=True):
                have = sums.setdefault(label, np.zeros(buckets + 1, np.int64))
                have[buckets] += 1  # documents
                for ix in gram_buckets(text.as_py(), buckets):
                    have[:buckets] += np.bincount(ix, minlength=buckets)
        for label, have in sums.items():
            ix = np.flatnonzero(have)
            yield pa.RecordBatch.from_arrays([pa.array([label] * len(ix), pa.string()), pa.array(ix), pa.array(have[ix])], names=["label", "bucket", "n"])

    rows = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(label_col).cast("string").alias("label")).where("label is not null")
    parts = rows.mapInArrow(count, "label string, bucket bigint, n bigint").groupBy("label", "bucket").agg(F.sum("n").alias("n"))
    by_class = parts.groupBy("label").agg(F.collect_list("bucket").alias("ix"), F.collect_list("n").alias("n"))
    most = most_bytes // (8 * buckets)
    found = by_class.limit(most + 1).collect()
    if not found:
        return None
    if len(found) > most:
        raise ValueError(f"more than {most} classes are too many for one broadcast model of {most_bytes} bytes")
    found = sorted(found, key=lambda r: r.label)
    counts = np.zeros((buckets + 1, len(found)))
    for k, r in enumerate(found):
        counts[r.ix, k] = r.n
    priors, counts = counts[buckets], counts[:buckets]
    logs = np.log(counts + 0.5) - np.log(counts.sum(0) + 0.5 * buckets)
    return Model([r.label for r in found], logs.astype(np.float32), np.log(priors / priors.sum()))


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's id with lang_pred (most probable class, the first by name on ties) and score (its probability, 0 to 1).

    `und` with score 0 where the text is null or has no letter, or where nothing was learned. Repeated rows are scored
    each, an empty table gives an empty result, other columns are ignored. The model is a Spark broadcast of bounded size.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.classes, model.log_probs, model.priors) if model else None)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*shared.value) if shared.value else None
        for batch in batches:
            n = batch.num_rows
            names, probs = ["und"] * n, [0.0] * n
            texts = [(i, t) for i in range(n) if (t := batch.column(1)[i].as_py()) and any(map(str.isalpha, t))] if m else []
            if texts:
                joint = m.scores([t for _, t in texts])
                best = joint.argmax(1)
                p = 1 / np.exp(joint - joint.max(1, keepdims=True)).sum(1)
                for (i, _), b, x in zip(texts, best, p, strict=True):
                    names[i], probs[i] = m.classes[b], float(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(probs, pa.float64())], names=["id", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(score, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)


def fold(n: int, id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo n; a null id has the checksum of the empty text."""
    return F.crc32(F.encode(F.coalesce(F.col(id_col).cast("string"), F.lit("")), "UTF-8")) % n
