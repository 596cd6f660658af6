"""Counters, latencies, error rates and reports."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkframe.functions.times import round_binary


def session_calls(calls: DataFrame, duration: str = "dur_us") -> DataFrame:
    """session_id, n_calls, total, mean and the nearest-rank p95: the value at index int(0.95 * n), capped at the last."""
    by = Window.partitionBy("session_id")
    rows = calls.withColumns({"_r": F.row_number().over(by.orderBy(duration)), "_n": F.count(F.lit(1)).over(by)})
    rank = F.least(F.expr("_n * 95 div 100"), F.col("_n") - 1) + 1
    return rows.groupBy("session_id").agg(F.count(F.lit(1)).alias("n_calls"), F.sum(duration).alias("total_us"), F.round(F.avg(F.col(duration) / 1000), 6).alias("mean_ms"), F.max(F.when(F.col("_r") == rank, F.col(duration))).alias("p95_us"))


def ratio(top: Column, bottom: Column) -> Column:
    """A ratio, 0 where there is nothing to divide by."""
    return F.when(bottom > 0, top / bottom).otherwise(0.0)


def error_counts(refs: list[np.ndarray], hyps: list[np.ndarray]) -> np.ndarray:
    """Substitutions, insertions and deletions (rows of three) of pairs of word codes (0 and more); on ties a match or substitution comes before a
    deletion, before an insertion. All pairs advance together, one reference word at a time, in memory that grows with the hypotheses only."""
    n, m = np.array([len(r) for r in refs]), np.array([len(h) for h in hyps])
    ref, hyp = np.full((len(n), max(n.max(), 1)), -1), np.full((len(n), m.max()), -2)
    for k, (r, h) in enumerate(zip(refs, hyps, strict=True)):
        ref[k, : len(r)], hyp[k, : len(h)] = r, h
    at = np.arange(hyp.shape[1] + 1)
    dist, subs, ins = np.tile(at, (len(n), 1)), np.zeros((len(n), len(at)), np.int64), np.tile(at, (len(n), 1))
    out = np.zeros((len(n), 3), np.int64)

    def done(i: int) -> None:
        k = np.flatnonzero(n == i)
        s, a = subs[k, m[k]], ins[k, m[k]]
        out[k] = np.stack([s, a, dist[k, m[k]] - s - a], 1)

    done(0)
    for i in range(n.max()):
        same = hyp == ref[:, i : i + 1]
        up = dist + 1
        best = up.copy()
        np.minimum(best[:, 1:], dist[:, :-1] + ~same, out=best[:, 1:])
        row = np.minimum.accumulate(best - at, axis=1) + at
        # A match comes first, then a substitution, a deletion, an insertion; an insertion carries on from the last cell that is none.
        diag = np.zeros(row.shape, bool)
        least = np.minimum(dist[:, 1:], row[:, :-1])
        diag[:, 1:] = same | (dist[:, :-1] <= least)
        down = ~diag
        down[:, 1:] &= dist[:, 1:] <= row[:, :-1]
        row[:, 1:] = np.where(same, dist[:, :-1], row[:, 1:])
        origin = np.maximum.accumulate(np.where(diag | down, at, 0), axis=1)
        s, a = subs.copy(), ins.copy()
        s[:, 1:] = np.where(diag[:, 1:], subs[:, :-1] + ~same, subs[:, 1:])
        a[:, 1:] = np.where(diag[:, 1:], ins[:, :-1], ins[:, 1:])
        dist, subs, ins = row, np.take_along_axis(s, origin, 1), np.take_along_axis(a, origin, 1) + at - origin
        done(i + 1)
    return out


def batch_errors(ref: pa.Array, hyp: pa.Array, cells: int = 1 << 15) -> np.ndarray:
    """`error_counts` of two columns of word arrays, pairs of like lengths together."""
    both = pa.concat_arrays([ref.flatten(), hyp.flatten()]).dictionary_encode(null_encoding="encode").indices.to_numpy()
    cut = lambda col, codes: np.split(codes, np.cumsum(np.diff(col.offsets.to_numpy()))[:-1])
    refs, hyps = cut(ref, both[: len(ref.flatten())]), cut(hyp, both[len(ref.flatten()) :])
    out = np.zeros((len(refs), 3), np.int64)
    order = sorted(range(len(refs)), key=lambda k: (len(hyps[k]), len(refs[k])))
    while order:
        some = order[-max(1, cells // (len(hyps[order[-1]]) + 1)) :]
        del order[-len(some) :]
        out[some] = error_counts([refs[k] for k in some], [hyps[k] for k in some])
    return out


def wer_rows(pairs: DataFrame) -> DataFrame:
    """Id, s, i, d, ref_words, hyp_words, wer (the number of insertions where the reference is empty) of (id, ref, hyp) word arrays,
    of any length, taken for many rows at a time."""
    ids = [c for c in pairs.columns if c not in ("ref", "hyp")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                counts = batch_errors(batch.column("ref"), batch.column("hyp"))
                sizes = [pa.array(np.diff(batch.column(c).offsets.to_numpy()), pa.int32()) for c in ("ref", "hyp")]
                cols = [*(batch.column(c) for c in ids), *(pa.array(c, pa.int32()) for c in counts.T), *sizes]
                yield pa.RecordBatch.from_arrays(cols, names=[*ids, "s", "i", "d", "ref_words", "hyp_words"])

    shape = ", ".join(f"`{c}` {pairs.schema[c].dataType.simpleString()}" for c in ids)
    rows = pairs.mapInArrow(run, f"{shape}, s int, i int, d int, ref_words int, hyp_words int")
    errors = F.col("s") + F.col("i") + F.col("d")
    return rows.withColumn("wer", F.when(F.col("ref_words") == 0, F.col("hyp_words").cast("double")).otherwise(errors / F.col("ref_words")))


#: Distinct words of a pair that can be told apart as code points.
MOST_WORDS = 1_000_000


def edit_distances(pairs: DataFrame) -> DataFrame:
    """Q2: `pairs` with distance, without the words, and without Python: a pair's distinct words become code points, and two texts of such are compared by the built-in
    distance. Null for pairs of more than MOST_WORDS distinct words (wer_rows takes any)."""
    known = F.array_distinct(F.concat("ref", "hyp"))
    point = lambda p: F.lpad(F.hex(p + F.when(p < 0xD800 - 255, 255).otherwise(0x800 + 255)), 8, "0")  # noqa: E731 (surrogates are no characters)
    code = lambda c: F.decode(F.unhex(F.array_join(F.transform(F.transform(c, lambda w: F.array_position("_known", w)), point), "")), "UTF-32")
    rows = pairs.withColumn("_known", known)
    distance = F.when(F.size("_known") <= MOST_WORDS, F.levenshtein(code("ref"), code("hyp")))
    return rows.withColumn("distance", distance).select(*(c for c in pairs.columns if c not in ("ref", "hyp")), "distance")


def micro_wer() -> Column:
    """A10: errors over reference words."""
    return F.sum(F.col("s") + F.col("i") + F.col("d")) / F.greatest(F.sum("ref_words"), F.lit(1))


def bench_report(runs: DataFrame) -> DataFrame:
    """One row over all, and one per language and per category, in one pass: level, value and the aggregates."""
    groups = runs.groupingSets([[], ["language"], ["category"]], "language", "category")
    out = groups.agg(
        F.grouping_id().alias("g"), F.count(F.lit(1)).alias("n_samples"), F.sum("audio_us").alias("audio_us"), F.sum("processing_us").alias("processing_us"),
        F.round(F.avg("wer"), 6).alias("avg_wer"), F.round(micro_wer(), 6).alias("weighted_wer"),
        F.round(F.avg(ratio(F.col("processing_us"), F.col("audio_us"))), 6).alias("avg_rtf"), F.round(ratio(F.sum("processing_us"), F.sum("audio_us")), 6).alias("overall_rtf"),
        F.round(F.coalesce(F.avg(F.when(F.col("latency_us") > 0, F.col("latency_us") / 1000)), F.lit(0.0)), 6).alias("avg_latency_ms"),
        F.round(F.coalesce(F.avg(F.when(F.col("p95_us") > 0, F.col("p95_us") / 1000)), F.lit(0.0)), 6).alias("p95_latency_ms"),
        F.count_distinct("language").alias("n_languages"), F.array_join(F.sort_array(F.collect_set("category")), ",").alias("categories"),
    )
    level = F.when(F.col("g") == 3, "all").when(F.col("g") == 1, "language").otherwise("category")
    return out.withColumns({"level": level, "value": F.when(F.col("g") == 3, "").otherwise(F.coalesce("language", "category"))}).drop("g", "language", "category")


def compare_systems(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Micro error rate and real-time factor of each system."""
    return runs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.round(100 * micro_wer(), 6).alias("wer_pct"), F.round(ratio(F.sum("processing_us"), F.sum("audio_us")), 6).alias("rtf"))


def sweet_spot(points: DataFrame) -> DataFrame:
    """Points that are both fast and right: below the smaller of 1 and 0.85 of the largest factor, and of 12 and 0.45 of the largest rate. The joined table is
    one row of two maxima."""
    most = points.agg(F.max("rtf").alias("_x"), F.max("wer_pct").alias("_y"))
    return points.join(F.broadcast(most)).where((F.col("rtf") < F.least(F.lit(1.0), 0.85 * F.col("_x"))) & (F.col("wer_pct") < F.least(F.lit(12.0), 0.45 * F.col("_y")))).drop("_x", "_y")


#: The decimals of a report's fields.
DECIMALS = {"duration_s": 2, "wer": 4, "processing_time_s": 2, "rtf": 3, "avg_latency_ms": 1, "p95_latency_ms": 1, "peak_memory_mb": 1}


def rounded(rows: DataFrame, decimals: dict[str, int] = DECIMALS) -> DataFrame:
    """The fields of a report at their number of decimals, as Python rounds them."""
    return rows.withColumns({c: round_binary(F.col(c).cast("double"), n) for c, n in decimals.items() if c in rows.columns})


def grouped(runs: DataFrame, key: str) -> DataFrame:
    """The runs of each value of `key`, in the order of the values (`place`, from 1; null first): n, avg_wer, audio_us. The window sees one row per value."""
    groups = runs.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("wer"), 6).alias("avg_wer"), F.sum("audio_us").alias("audio_us"))
    return groups.withColumn("place", F.row_number().over(Window.orderBy(F.col(key).asc_nulls_first()))).orderBy("place")


def grade(value: Column, good: float, fair: float) -> Column:
    """Good, fair or poor by two upper bounds."""
    return F.when(value < good, "good").when(value < fair, "fair").otherwise("poor")


def timing_report(lines: DataFrame) -> DataFrame:
    """session_id, n_lines, n_negative, n_inverted, n_backwards, timing_valid, monotonic."""
    by = Window.partitionBy("session_id").orderBy("line_no")
    rows = lines.withColumn("_back", F.coalesce(F.col("start_cs") < F.lag("start_cs").over(by), F.lit(False)))
    out = rows.groupBy("session_id").agg(F.count(F.lit(1)).alias("n_lines"), F.count_if((F.col("start_cs") < 0) | (F.col("end_cs") < 0)).alias("n_negative"), F.count_if(F.col("end_cs") < F.col("start_cs")).alias("n_inverted"), F.count_if("_back").alias("n_backwards"))
    return out.withColumns({"timing_valid": (F.col("n_negative") == 0) & (F.col("n_inverted") == 0), "monotonic": F.col("n_backwards") == 0})


def timing_messages(lines: DataFrame) -> DataFrame:
    """session_id, message: one row for each timing fault of a line (numbered from 0 in its session): negative or inverted times, a start before the one before."""
    by = Window.partitionBy("session_id").orderBy("line_no")
    rows = lines.select("session_id", (F.row_number().over(by) - 1).alias("i"), (F.col("start_cs") / 100).alias("s"), (F.col("end_cs") / 100).alias("e"), (F.lag("start_cs").over(by) / 100).alias("b"))
    told = lambda when, form, *cols: F.when(when, F.format_string(form, "i", *cols))
    faults = F.array(
        told(F.col("s") < 0, "Line %d: negative start %.2fs", "s"), told(F.col("e") < 0, "Line %d: negative end %.2fs", "e"),
        told(F.col("e") < F.col("s"), "Line %d: end (%.2fs) < start (%.2fs)", "e", "s"), told(F.col("s") < F.col("b"), "Line %d: start (%.2fs) < previous start (%.2fs)", "s", "b"),
    )
    return rows.select("session_id", F.explode(F.array_compact(faults)).alias("message"))


#: Checks in the order of a report.
CHECKS = ("no_anomalies", "has_words", "has_lines", "timing_valid", "timing_monotonic", "fast_enough")


def health_report(lines: DataFrame, metrics_: DataFrame, most_rtf: float = 2.0) -> DataFrame:
    """session_id, check_no, name, ok, in long form: no anomaly, words, lines, valid and monotonic times, and a real-time factor below `most_rtf`. Tables: lines (with
    n_tokens), and session_id, rtf, n_anomalies of each session; a session without lines has none."""
    timing = timing_report(lines).join(lines.groupBy("session_id").agg(F.sum("n_tokens").alias("n_words")).hint("merge"), "session_id")
    rows = metrics_.join(timing.hint("merge"), "session_id", "left").fillna(0, ["n_words", "n_lines"])
    ok = [F.col("n_anomalies") == 0, F.col("n_words") > 0, F.col("n_lines") > 0, F.coalesce("timing_valid", F.lit(True)), F.coalesce("monotonic", F.lit(True)), F.col("rtf") < most_rtf]
    checks = F.array(*(F.struct(F.lit(k).alias("check_no"), F.lit(name).alias("name"), c.alias("ok")) for k, (name, c) in enumerate(zip(CHECKS, ok, strict=True), 1)))
    return rows.select("session_id", F.inline(checks))


def timestamp_accuracy(pred: DataFrame, ref: DataFrame, ahead: int = 3) -> DataFrame:
    """Id, n_matched, mae, max and median of the start deltas. Words are matched from left to right, each with the first equal
    one of the next `ahead` reference words, letters and digits alone in lower case. Tables: id, ix, word, start_cs. The match is a fold over one id's words; null where nothing matches."""
    as_list = lambda df, name: df.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ix", "word", "start_cs"))), lambda x: F.struct(F.regexp_replace(F.lower(x["word"]), r"[^\p{L}\p{N}]+", "").alias("w"), x["start_cs"].cast("bigint").alias("t"))).alias(name))
    both = as_list(pred, "p").join(as_list(ref, "r").hint("merge"), "id", "full_outer")
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<bigint>").alias("deltas"))

    def step(acc: Column, p: Column) -> Column:
        near = F.slice(F.col("r"), acc["at"] + 1, F.lit(ahead))
        hit = F.array_position(F.transform(near, lambda x: x["w"]), p["w"]).cast("int")
        found = F.struct((acc["at"] + hit).alias("at"), F.concat(acc["deltas"], F.array(p["t"] - F.element_at(F.col("r"), F.greatest(acc["at"] + hit, F.lit(1)))["t"])).alias("deltas"))
        return F.when((p["w"] != "") & (hit > 0), found).otherwise(acc)

    rows = both.withColumn("d", F.transform(F.aggregate(F.coalesce("p", F.array().cast(both.schema["p"].dataType)), start, step)["deltas"], lambda x: F.abs(x)))
    rows = rows.withColumn("d", F.array_sort("d")).withColumn("n", F.size("d"))
    mid = lambda k: F.get(F.col("d"), k)
    median = (mid(F.floor((F.col("n") - 1) / 2).cast("int")) + mid(F.floor(F.col("n") / 2).cast("int"))) / 2
    total = F.aggregate("d", F.lit(0).cast("bigint"), lambda a, x: a + x)
    return rows.select("id", F.col("n").alias("n_matched"), F.when(F.col("n") > 0, F.round(total / F.col("n"), 6)).alias("mae_cs"), F.array_max("d").alias("max_cs"), F.when(F.col("n") > 0, median).alias("median_cs"))
