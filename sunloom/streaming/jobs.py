"""Incremental jobs: what is new since the last run, over files as they arrive.

The polling jobs run with availableNow: a run takes what is there and ends; the checkpoint folder remembers it. Sinks
are written by foreachBatch under the batch's number, so a batch that is run again replaces its own rows. What follows
from a sink starts from what both stores hold, so it can be run at any time, and again.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.times import DAY, HOUR, micros
from ..operators import hist, limb, quality, tracks
from ..plans.asof import bucketed_range_join
from ..plans.tables import table


def read_feed(spark: SparkSession, path: str, schema, files_per_batch: int | None = None) -> DataFrame:
    """A folder of Parquet files as a stream."""
    reader = spark.readStream.schema(schema)
    return (reader if files_per_batch is None else reader.option("maxFilesPerTrigger", files_per_batch)).parquet(path)


def run_batches(stream: DataFrame, checkpoint: str, job: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Run a job over all that is new, batch by batch, and end."""
    query = stream.writeStream.foreachBatch(job).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def _replace(df: DataFrame, path: str, batch: int) -> None:
    df.withColumn("batch", F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    """A store, or None before its first write."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def update_histograms(images: DataFrame, store: str, checkpoint: str, value: str, edges: Sequence[float], by: Sequence[str] = ("data_id", "instrument", "date_obs"), mu: str | None = None, mu_edges: Sequence[float] | None = None, known: DataFrame | None = None) -> StreamingQuery:
    """T1, first half: counts of the pixels of new images, by bins of value (and of mu), added to the store.

    A batch writes its own counts, so an image whose pixels come in several batches is the sum of them (histograms()), and
    a batch that runs again replaces what it wrote. known: images that have histograms elsewhere, which are left out (J8).
    """

    def job(batch: DataFrame, number: int) -> None:
        new = batch if known is None else batch.join(known.select(by[0]).distinct(), by[0], "left_anti")
        if mu is None:
            part = hist.hist1d(new, list(by), F.col(value), edges).withColumnRenamed("i_y", "i_int")
        else:
            part = hist.hist2d(new, list(by), F.col(mu), mu_edges, F.col(value), edges).withColumnsRenamed({"i_x": "i_mu", "i_y": "i_int"})
        _replace(part, store, number)

    return run_batches(images, checkpoint, job)


def histograms(spark: SparkSession, store: str) -> DataFrame:
    """The histograms of a store: the counts of all batches summed."""
    parts = spark.read.parquet(store)
    return parts.groupBy(*[c for c in parts.columns if c not in ("n", "batch")]).agg(F.sum("n").alias("n"))


def due_centers(store: DataFrame, done: DataFrame | None, centers: DataFrame, days: float, date: str = "date_obs", limit: DataFrame | None = None, again: DataFrame | None = None) -> DataFrame:
    """Window centres to be fitted: at least days / 2 before the last histogram (T1), and either without a fit, or with
    histograms in their window that came in batches after their fit, or in `again` if there are any such batches.

    store: the parts with their batch; done: center, upto (the last batch that a fit knew). limit: a table whose last
    center bounds them (T2).
    """
    half = F.expr(f"INTERVAL {round(days * 43200)} SECOND")
    ends = store.agg((F.max(date) - half).alias("__last"), F.max("batch").alias("__batch"))  # one row
    due = centers.select("center").distinct().crossJoin(F.broadcast(ends)).where("center <= __last")
    if limit is not None:
        due = due.crossJoin(F.broadcast(limit.agg(F.max("center").alias("__most")))).where("center <= __most")
    if done is None:
        return due.select("center")
    fits = done.groupBy("center").agg(F.max("upto").alias("__upto"))
    due = due.join(fits, "center", "left")
    arrivals = store.groupBy(date).agg(F.max("batch").alias("__came")).withColumn("__t", micros(F.col(date)))
    width = round(days * DAY / 2)
    spans = fits.select("center", "__upto", (micros(F.col("center")) - width).alias("__lo"), (micros(F.col("center")) + width).alias("__hi"))
    late = bucketed_range_join(arrivals, spans, "__t", "__lo", "__hi", max(1, width)).where(F.col("__came") > F.col("__upto")).select("center").distinct()
    out = due.where("__upto IS NULL").select("center").unionByName(due.join(late, "center", "left_semi").select("center"))
    if again is not None:
        out = out.unionByName(due.where("__upto < __batch").join(again.select("center"), "center", "left_semi").select("center"))
    return out.distinct()


def coefficients(spark: SparkSession, fits: str, by: Sequence[str] = ("instrument", "center")) -> DataFrame | None:
    """The latest fit of each group in a store of fits; None before the first."""
    rows = _stored(spark, fits)
    if rows is None:
        return None
    rest = [c for c in rows.columns if c not in by and c != "version"]
    return rows.groupBy(*by).agg(F.max_by(F.struct(*rest), "version").alias("__r")).select(*by, "__r.*")


def update_fits(spark: SparkSession, store: str, fits: str, centers: DataFrame, days: float, fit: Callable[[DataFrame, DataFrame], DataFrame], date: str = "date_obs", limit: str | None = None, again: Callable[[DataFrame], DataFrame] | None = None) -> int:
    """T1 and T2, second half: fit(histograms, due centres) for what is due, kept as a new version of their rows.

    The state is what the two stores hold: a run that failed is repeated under the same version, and one without news
    writes nothing. limit: a store of other fits, whose last centre bounds these. again: the centres that any news
    changes, from the histograms. Returns the centres fitted.
    """
    parts, old = _stored(spark, store), _stored(spark, fits)
    bound = None
    if limit is not None:
        bound = _stored(spark, limit)
        if bound is None:
            return 0
    if parts is None:
        return 0
    bins = histograms(spark, store)
    due = table(due_centers(parts, old, centers, days, date, bound, None if again is None else again(bins)), "due_centers")
    n = due.count()
    if n:
        upto = parts.agg(F.max("batch")).first()[0]
        version = 0 if old is None else old.agg(F.max("version")).first()[0] + 1
        rows = fit(bins, due).withColumns({"upto": F.lit(upto).cast("long"), "version": F.lit(version)})
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("version").parquet(fits)
    return n


def update_limb(spark: SparkSession, store: str, fits: str, centers: DataFrame, edges: Sequence[float], mu_centers: Sequence[float], model: str = "theoretic", days: float = 180, **options) -> int:
    """T1, second half: limb parameters of the due weeks, from a store of histograms by i_mu and i_int (A3, A4, A10)."""
    names = F.array(*[F.lit(float(m)) for m in mu_centers])

    def fit(bins: DataFrame, due: DataFrame) -> DataFrame:
        sums = hist.window_hist(bins, due, days, bin_cols=["i_mu", "i_int"])
        shares = hist.normalize(sums, ["instrument", "center", "i_mu"]).withColumn("mu", names[F.col("i_mu")])
        return limb.fit_limb(shares, edges, model, ["instrument", "center"], **options)

    return update_fits(spark, store, fits, centers, days, fit)


def update_scaling(spark: SparkSession, store: str, fits: str, centers: DataFrame, reference: str, edges: Sequence[float], days: float = 180, limit: str | None = None, within: float = 1e-4) -> int:
    """Scaling coefficients of the due weeks (A34), up to the last week of a store of limb fits. Weeks before the
    reference's first are scaled to that one, so any news fits them again."""

    def first(bins: DataFrame) -> DataFrame:
        return hist.first_window(bins, centers, reference, days)

    def again(bins: DataFrame) -> DataFrame:
        return centers.crossJoin(F.broadcast(first(bins))).where("center <= __first").select("center")  # one row

    return update_fits(spark, store, fits, centers, days, lambda bins, due: hist.fit_scaling(bins, due, reference, edges, days, within=within, first=first(bins)), limit=limit, again=again)


def update_maps(new_images: DataFrame, path: str, checkpoint: str, build: Callable[[DataFrame], DataFrame], date: str = "map_date") -> StreamingQuery:
    """Products of the dates that new images touch are built again and replace the old ones."""

    def job(batch: DataFrame, number: int) -> None:
        build(batch).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(date).parquet(path)

    return run_batches(new_images, checkpoint, job)


#: State of a run: when each recent frame was, and the ids of its regions; all within the window.
STATE = "last long, frames array<bigint>, times array<timestamp>, regions array<array<long>>, ids array<array<long>>"


def track_stream(links: DataFrame, thr: float, window_hours: float, weight: str = "proximity", near_thr: float = 0.0, keep: float | None = None) -> DataFrame:
    """T4: track ids as frames arrive in order.

    links: run, frame, ts, region, and `old`: array of (old_frame, old_region, share_new, share_old), the overlaps with
    earlier frames (J17), and if it is there `near`: array of (old_frame, old_region, d), the nearest earlier regions
    (J18), found before the stream or in the batch; thresholds as of track(). Each run keeps the regions of its trailing window as
    state and drops older ones; a run without news for the window's length ends.
    """

    def fold(key: tuple, pages, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        memory: dict = {}
        if state.exists:
            last, frames, times, regions, ids = state.get
            memory = {"last": last, "labels": {(f, r): i for f, rs, ns in zip(frames, regions, ids, strict=True) for r, i in zip(rs, ns, strict=True)}}
            memory["recent"] = tracks.deque((f, pd.Timestamp(t), list(rs)) for f, t, rs in zip(frames, times, regions, strict=True))
        rows = pd.concat(list(pages), ignore_index=True)
        old = [(r.frame, r.region, o["old_frame"], o["old_region"], o["share_new"], o["share_old"]) for r in rows.itertuples(index=False) for o in (r.old if r.old is not None else ())]
        over = pd.DataFrame(old, columns=["frame", "region", "old_frame", "old_region", "share_new", "share_old"])
        near = None
        if "near" in rows.columns:
            near = pd.DataFrame([(r.frame, r.region, o["old_frame"], o["old_region"], o["d"]) for r in rows.itertuples(index=False) for o in (r.near if r.near is not None else ())], columns=["frame", "region", "old_frame", "old_region", "d"])
        out = tracks.fold_tracks(rows[["run", "frame", "ts", "region"]], over, thr, window_hours, weight, memory, near, near_thr, keep)
        recent, labels = list(memory["recent"]), memory["labels"]
        state.update((int(memory["last"]), [int(f) for f, _, _ in recent], [t.to_pydatetime() for _, t, _ in recent], [[int(r) for r in rs] for _, _, rs in recent], [[int(labels[f, r]) for r in rs] for f, _, rs in recent]))
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), int(recent[-1][1].timestamp() * 1000)) + int(window_hours * 3_600_000) + 1)
        yield out

    late = links.withWatermark("ts", f"{round(window_hours)} hours")
    return late.groupBy("run").applyInPandasWithState(fold, tracks.TRACKED, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def feed_counts(feed: DataFrame, time: str = "ts", by: str = "event_type", every: str = "1 hour", late: str = "2 hours", key: Sequence[str] = ("event_id",)) -> DataFrame:
    """T5: arrivals per window and kind, repeats within the watermark dropped; windows under a quota show gaps."""
    once = feed.withWatermark(time, late).dropDuplicatesWithinWatermark(list(key))
    return once.groupBy(F.window(time, every).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), by, "n")


#: State of a kind: the last observation that is final, those that wait for the watermark, and the gaps told of.
GAP_STATE = "last bigint, waiting array<bigint>, told array<bigint>, silent bigint"
GAPS = "key string, kind string, at timestamp, missing long"


def feed_gaps(feed: DataFrame, cadence_hours: float, start, time: str = "ts", by: str = "instrument", late: str = "2 hours") -> DataFrame:
    """T5: gaps in the feed of each kind (key), as it arrives.

    Rows of kind `final` are observations that the watermark has passed, with the observations lost before them, as gaps()
    finds them on the finished feed (W3). Before that, `gap` tells of observations lost before one that came, as far as
    is known, and `repair` that the gap before one is smaller, since a late one came. `silent` tells that a kind's next
    observation is overdue while others come: at its due time, with the observations lost up to the watermark.
    """
    step, begin = round(cadence_hours * HOUR), int(pd.Timestamp(start).timestamp() * 1_000_000)

    def lost(t: int, before: int) -> int:
        """As round() does in SQL: halves away from zero."""
        x = (t - before) / step - 1
        return int(abs(x) + 0.5) * (1 if x >= 0 else -1)

    def follow(key: tuple, pages, state: GroupState):
        last, waiting, told, silent = (begin - step, [], [], 0)
        if state.exists:
            last, waiting, told, silent = state.get
            waiting, told = list(waiting), list(told)
        out, mark = [], state.getCurrentWatermarkMs() * 1000
        known = dict(zip(told[::2], told[1::2], strict=True))
        new = sorted(int(t.value) // 1000 for df in pages for t in df["ts"])
        waiting = sorted(waiting + new)
        before = last
        for t in waiting:
            n = lost(t, before)
            if n > 0 and t not in known:
                out.append(("gap", t, n))
            elif t in known and n < known[t]:
                out.append(("repair", t, n))
            if n > 0 or t in known:
                known[t] = n
            before = t
        while waiting and waiting[0] <= mark:
            t = waiting.pop(0)
            out.append(("final", t, lost(t, last)))
            last, silent = t, 0
        known = {t: n for t, n in known.items() if t in set(waiting)}
        if not waiting and mark > last + 2 * step and (n := lost(mark, last)) > silent:
            out.append(("silent", last + step, n))
            silent = n
        state.update((last, waiting, [x for p in sorted(known.items()) for x in p], silent))
        due = waiting[0] if waiting else max(mark, last + 2 * step)
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), due // 1000) + 1)
        if out:
            yield pd.DataFrame({"key": [str(key[0])] * len(out), "kind": [k for k, _, _ in out], "at": pd.to_datetime([t for _, t, _ in out], unit="us"), "missing": [n for _, _, n in out]})

    rows = feed.select(F.col(by).alias("key"), F.col(time).cast("timestamp").alias("ts")).withWatermark("ts", late)
    return rows.groupBy("key").applyInPandasWithState(follow, GAPS, GAP_STATE, "append", GroupStateTimeout.EventTimeTimeout)


def feed_flags(feed: DataFrame, rules: DataFrame) -> DataFrame:
    """T5: image flags (W8) on the feed of histogram moments; rules are a small table that each batch reads."""
    return quality.flag_images(feed, F.broadcast(rules))
