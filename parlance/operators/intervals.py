"""Segments of recordings as intervals: merging, overlap, scores, anchors, assignment, windows.

All take and give DataFrames. ``keys`` name the recording; times are seconds as doubles. Orders are
total: ties in (start, end) go by ``tie``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.functions.nulls import changed, truly, zero_sum
from parlance.operators import ranks

K = ["audio_id"]


def time_bin(t: Column, bin_s: float) -> Column:
    """Number of the bin of a time: grows with it in Spark's order (null before all, NaN after all)."""
    return F.when(F.isnan(t), F.lit((1 << 63) - 1)).otherwise(F.floor(t / bin_s))


def islands(df: DataFrame, keys: list[str] = K, speaker: str = "speaker", start: str = "start_s", end: str = "end_s", tie: str = "seg_id", max_gap: float = 0.5, bin_s: float | None = None) -> DataFrame:
    """``df`` with ``run`` (turns of one speaker) and ``island`` (parts of a run with gaps up to ``max_gap``).

    The running end need not restart at a new island: after a break the next start lies beyond it. ``bin_s``
    deals a long recording over time bins (:func:`_binned_islands`), with the same result.
    """
    if bin_s:
        return _binned_islands(df, keys, speaker, start, end, tie, max_gap, bin_s)
    order = Window.partitionBy(*keys).orderBy(start, end, tie)
    before = Window.partitionBy(*keys, "run").orderBy(start, end, tie).rowsBetween(Window.unboundedPreceding, -1)
    turn = F.when(F.row_number().over(order) == 1, 1).otherwise(changed(F.col(speaker), F.lag(speaker).over(order)).cast("int"))
    runs = df.withColumn("__turn", turn).withColumn("run", F.sum("__turn").over(order)).drop("__turn")
    reach = F.max(end).over(before)
    new = (reach.isNull() | (F.col(start) - reach > max_gap)).cast("int")
    return runs.withColumn("__new", new).withColumn("island", F.sum("__new").over(Window.partitionBy(*keys, "run").orderBy(start, end, tie))).drop("__new")


def _binned_islands(df: DataFrame, keys: list[str], speaker: str, start: str, end: str, tie: str, max_gap: float, bin_s: float) -> DataFrame:
    """:func:`islands` with no window longer than a time bin of a recording.

    A bin is scanned alone; what it passes on is one row: its first and last speaker, its turns, and the end that
    its last run reaches. Those rows, one a bin, are chained in the recording, so that each bin learns the run that
    is open at its border and that run's reach. With it the breaks of the bin's first run are known, and the
    islands of open runs are counted over the bins in the same way. Rows of one start are in one bin.
    """
    at = [*keys, "__bin"]
    order, chain = Window.partitionBy(*at).orderBy(start, end, tie), Window.partitionBy(*keys).orderBy("__bin")
    place = F.struct(F.col(start), F.col(end), F.col(tie))
    turn = F.when(F.row_number().over(order) == 1, 0).otherwise(changed(F.col(speaker), F.lag(speaker).over(order)).cast("int"))
    before = Window.partitionBy(*at, "__own").orderBy(start, end, tie).rowsBetween(Window.unboundedPreceding, -1)
    rows = df.withColumn("__bin", time_bin(F.col(start), bin_s)).withColumn("__turn", turn).withColumn("__own", F.sum("__turn").over(order)).withColumn("__reach", F.max(end).over(before))

    one = F.struct(F.col(speaker).alias("s"))
    state = rows.groupBy(*at).agg(F.min_by(one, place).alias("first"), F.max_by(one, place).alias("last"), F.sum("__turn").alias("turns"), F.max(F.struct("__own", F.col(end).alias("e")))["e"].alias("tail"))
    head = F.lag("last").over(chain)
    state = state.withColumn("__new_run", F.when(head.isNull(), 1).otherwise(changed(F.col("first.s"), head["s"]).cast("int")))
    state = state.withColumn("__run_end", F.sum(F.col("turns") + F.col("__new_run")).over(chain))
    among = Window.partitionBy(*keys, "__run_end").orderBy("__bin")  # the bins at whose end one run is open
    state = state.withColumn("__open", F.max("tail").over(among)).withColumn("__carried", F.when(F.col("__new_run") == 0, F.lag("__open").over(chain)))
    state = state.select(*at, (F.col("__run_end") - F.col("turns")).alias("__base"), "__carried", "__new_run", "__run_end")

    known = _with_state(rows, state, at)
    reach = F.when(F.col("__own") == 0, F.greatest("__reach", "__carried")).otherwise(F.col("__reach"))
    known = known.withColumn("__new", (reach.isNull() | (F.col(start) - reach > max_gap)).cast("int"))
    known = known.withColumn("__isle", F.coalesce(F.sum("__new").over(Window.partitionBy(*at, "__own").orderBy(start, end, tie)), F.lit(0)))
    counted = known.groupBy(*at, "__new_run", "__run_end").agg(F.max(F.struct("__own", "__isle"))["__isle"].alias("isles"))
    counted = counted.withColumn("__open", F.sum("isles").over(among)).withColumn("__before", F.when(F.col("__new_run") == 0, F.lag("__open").over(chain)))

    out = _with_state(known, counted.select(*at, "__before"), at)
    more = F.when(F.col("__own") == 0, F.coalesce("__before", F.lit(0))).otherwise(0)
    return out.select(*df.columns, (F.col("__base") + F.col("__own")).alias("run"), (F.col("__isle") + more).alias("island"))


def _with_state(rows: DataFrame, state: DataFrame, at: list[str]) -> DataFrame:
    """Rows with the other columns of their bin's row; null keys and bins meet."""
    s = state.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(at)], *[c for c in state.columns if c not in at])
    on = F.lit(True)
    for i, k in enumerate(at):
        on = on & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    return rows.join(s, on).drop(*[f"__k{i}" for i in range(len(at))])


def merge_adjacent(df: DataFrame, keys: list[str] = K, speaker: str = "speaker", start: str = "start_s", end: str = "end_s", tie: str = "seg_id", max_gap: float = 0.5, bin_s: float | None = None) -> DataFrame:
    """One row for each island: its first row's columns with the end reached, ``n_merged`` and ``merged_ids``.

    ``duration_s`` is given anew only where rows were merged, as the ends of a single row stay its own. ``bin_s`` as in :func:`islands`.
    """
    marked = islands(df, keys, speaker, start, end, tie, max_gap, bin_s)
    place = F.struct(F.col(start), F.col(end), F.col(tie))
    first = [F.min_by(c, place).alias(c) for c in df.columns if c not in (*keys, end, "duration_s")]
    out = marked.groupBy(*keys, "run", "island").agg(
        *first, F.max(end).alias(end), F.count("*").alias("n_merged"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(start, end, F.col(tie).alias("__id")))), lambda s: s["__id"].cast("string")), ",").alias("merged_ids")
    )
    return out.withColumn("duration_s", F.col(end) - F.col(start))


def count_islands(df: DataFrame, keys: list[str] = K, **how) -> DataFrame:
    """Rows and islands of each recording."""
    return islands(df, keys, **how).groupBy(*keys).agg(F.count("*").alias("n_segments"), F.count_distinct("run", "island").alias("n_islands"))


def overlap_regions(df: DataFrame, keys: list[str] = K, start: str = "start_s", end: str = "end_s", bin_s: float | None = None) -> DataFrame:
    """Stretches in which more than one interval is open (``start``, ``end``); touching ones are one.

    A sweep over the ends: +1 at a start, -1 at an end, summed by time so that ends meet starts.
    Intervals without length are left out. ``bin_s`` deals a long recording over time bins: what is open at a
    bin's border is summed over one row a bin, and the times at which a stretch begins or ends are numbered likewise.
    """
    real = df.filter(F.col(end) > F.col(start))
    ends = real.select(*keys, F.col(start).alias("t"), F.lit(1).alias("d")).unionByName(real.select(*keys, F.col(end).alias("t"), F.lit(-1).alias("d")))
    if bin_s:
        levels = ends.groupBy(*keys, "t").agg(F.sum("d").alias("d"))
        swept = ranks.running(levels, time_bin(F.col("t"), bin_s), [F.col("t")], {"before": "d"}, keys)
        was, now = F.col("before") > 1, F.col("before") + F.col("d") > 1
        edges = swept.filter(was != now).select(*keys, "t", now.cast("long").alias("begins"))
        nth = ranks.running(edges, time_bin(F.col("t"), bin_s), [F.col("t")], {"nth": "begins"}, keys)
        return nth.groupBy(*keys, (F.col("nth") + F.col("begins")).alias("region")).agg(F.min("t").alias(start), F.max("t").alias(end)).drop("region")
    order = Window.partitionBy(*keys).orderBy("t")
    levels = ends.groupBy(*keys, "t").agg(F.sum("d").alias("d")).withColumn("open", F.sum("d").over(order)).withColumn("next", F.lead("t").over(order))
    busy = levels.filter((F.col("open") > 1) & F.col("next").isNotNull())
    cut = F.coalesce(F.lag("next").over(order) != F.col("t"), F.lit(True)).cast("int")
    return busy.withColumn("cut", cut).withColumn("region", F.sum("cut").over(order)).groupBy(*keys, "region").agg(F.min("t").alias(start), F.max("next").alias(end)).drop("region")


def overlap_seconds(df: DataFrame, others: DataFrame, keys: list[str] = K, row_id: str = "seg_id", start: str = "start_s", end: str = "end_s", bin_s: float | None = None) -> DataFrame:
    """``df`` with ``overlap_s``: the seconds of each interval that lie in ``others``, 0 without any.

    ``bin_s`` deals long recordings over time bins; a pair is counted in the bin where its common part begins.
    """
    o = others.select(*[F.col(k).alias(f"__o_{k}") for k in keys], F.col(start).alias("__a"), F.col(end).alias("__b"))
    mine, on = df, [F.col(k) == F.col(f"__o_{k}") for k in keys]
    low, high = F.greatest(start, "__a"), F.least(end, "__b")
    hit = (F.col(start) < F.col("__b")) & (F.col(end) > F.col("__a"))
    if bin_s:
        bins = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / bin_s), F.greatest(F.floor(F.col(b) / bin_s), F.floor(F.col(a) / bin_s))))
        mine, o = df.withColumn("__bin", bins(start, end)), o.withColumn("__obin", bins("__a", "__b"))
        on += [F.col("__bin") == F.col("__obin"), F.floor(low / bin_s) == F.col("__bin")]
    cond = hit
    for c in on:
        cond = cond & c
    found = mine.join(o, cond).groupBy(*keys, row_id).agg(F.sum(high - low).alias("overlap_s"))
    return df.join(found, [*keys, row_id], "left").withColumn("overlap_s", F.coalesce("overlap_s", F.lit(0.0)))


def scored(df: DataFrame, min_duration: float = 0.7, min_rms: float = -40.0, min_anchor: float = 1.2, max_anchor_overlap: float = 0.0, skip_first: float = 1.5, start: str = "start_s", end: str = "end_s") -> DataFrame:
    """``df`` (with ``overlap_s`` and ``rms``) with ratios, reasons against export and against anchors, and both flags."""
    length = F.col(end) - F.col(start)
    ratio = F.coalesce(F.try_divide(F.col("overlap_s"), length), F.lit(0.0))
    short, weak = truly(length < min_duration), truly(F.col("rms") < min_rms)
    drop = F.array_compact(F.array(F.when(short, F.lit("short")), F.when(weak, F.lit("low_energy"))))
    no_anchor = [F.when(short, F.lit("short")), F.when(weak, F.lit("low_energy")), F.when(truly(length < min_anchor), F.lit("short_anchor")), F.when(truly(ratio > max_anchor_overlap), F.lit("overlap")), F.when(truly(F.col(start) < skip_first), F.lit("initial_window"))]
    anchor = F.array_sort(F.array_distinct(F.array_compact(F.array(*no_anchor))))
    out = df.withColumn("duration_s", length).withColumn("overlap_ratio", ratio)
    return (
        out.withColumn("drop_reasons", F.array_join(drop, ";"))
        .withColumn("anchor_reasons", F.array_join(anchor, ";"))
        .withColumn("valid_export", F.size(drop) == 0)
        .withColumn("valid_anchor", F.size(anchor) == 0)
    )


def anchors(df: DataFrame, keys: list[str] = K, speaker: str = "speaker", n: int = 3, tie: str = "seg_id", start: str = "start_s") -> DataFrame:
    """The ``n`` best valid anchors of each speaker, with ``anchor_rank``: longest, loudest, least overlapped, earliest."""
    order = Window.partitionBy(*keys, speaker).orderBy(F.desc("duration_s"), F.desc_nulls_last("rms"), "overlap_ratio", start, tie)
    return df.filter("valid_anchor").withColumn("anchor_rank", F.row_number().over(order)).filter(F.col("anchor_rank") <= n)


def assign_points(words: DataFrame, segments: DataFrame, keys: list[str] = K, word_id: str = "word_id", seg_id: str = "seg_id", tolerance: float | None = 0.4, bin_s: float = 600.0) -> DataFrame:
    """For each word (``w_start``, ``w_end``) its segment: of the largest overlap, else the nearest to its middle.

    Gives ``word_id, seg_id, overlap_s, distance_s, how`` (overlap, nearest or none). Ties go to the
    earlier segment. With a ``tolerance`` the nearest must be within it. Words and segments that touch
    meet in time bins of ``bin_s``, which should be longer than most segments, as a segment is in every bin it touches; for the other words the last segment before and the first one after
    their middle are found in one sweep of the recording, so no word meets all segments.
    """
    own = [F.col(k).alias(f"__s_{k}") for k in keys]
    s = segments.select(*own, F.col(seg_id), F.col("start_s").alias("__a"), F.col("end_s").alias("__b"))
    same = F.lit(True)
    for k in keys:
        same = same & (F.col(k) == F.col(f"__s_{k}"))
    bins = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / bin_s), F.greatest(F.floor(F.col(b) / bin_s), F.floor(F.col(a) / bin_s))))
    w = words.withColumn("__m", (F.col("w_start") + F.col("w_end")) / 2)
    overlap = F.greatest(F.least("w_end", "__b") - F.greatest("w_start", "__a"), F.lit(0.0))
    inside = (F.col("__m") >= F.col("__a")) & (F.col("__m") <= F.col("__b"))
    met = w.withColumn("__bin", bins("w_start", "w_end")).join(s.withColumn("__obin", bins("__a", "__b")), same & (F.col("__bin") == F.col("__obin"))).withColumn("overlap_s", overlap).filter((F.col("overlap_s") > 0) | inside)
    away = F.when(F.col("__m") < F.col("__a"), F.col("__a") - F.col("__m")).when(F.col("__m") > F.col("__b"), F.col("__m") - F.col("__b")).otherwise(0.0)
    best = F.struct((-F.col("overlap_s")).alias("o"), F.when(F.col("overlap_s") > 0, 0.0).otherwise(away).alias("d"), F.col("__a"), F.col("__b"), F.col(seg_id))
    touched = met.groupBy(*keys, word_id).agg(F.min_by(F.struct(seg_id, "overlap_s", away.alias("distance_s")), best).alias("x"))
    rest = w.join(touched.select(*keys, word_id), [*keys, word_id], "left_anti")
    segment, none = F.struct(F.col("__a").alias("a"), F.col("__b").alias("b"), F.col(seg_id).alias("id")), F.lit(None)
    points = rest.select(*keys, F.col("__m").alias("t"), F.col(word_id), none.cast(segments.select(F.struct(F.col("start_s").alias("a"), F.col("end_s").alias("b"), F.col(seg_id).alias("id")).alias("z")).schema["z"].dataType).alias("z"))
    events = points.unionByName(s.select(*[F.col(f"__s_{k}").alias(k) for k in keys], F.col("__a").alias("t"), none.cast(words.schema[word_id].dataType).alias(word_id), segment.alias("z")))
    line = Window.partitionBy(*keys).orderBy("t").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = Window.partitionBy(*keys).orderBy(F.desc("t")).rangeBetween(Window.unboundedPreceding, Window.currentRow)  # a frame to the end is quadratic
    back = F.max_by("z", F.when(F.col("z").isNotNull(), F.struct(F.col("z.b"), (-F.col("z.a")).alias("na")))).over(line)
    near = events.withColumn("p", back).withColumn("q", F.min("z").over(ahead)).filter(F.col("z").isNull())
    gap = lambda z: F.when(F.col("t") < F.col(f"{z}.a"), F.col(f"{z}.a") - F.col("t")).when(F.col("t") > F.col(f"{z}.b"), F.col("t") - F.col(f"{z}.b")).otherwise(0.0)
    sides = F.array_sort(F.array_compact(F.array(*[F.when(F.col(z).isNotNull(), F.struct(gap(z).alias("d"), F.col(f"{z}.a").alias("a"), F.col(f"{z}.b").alias("b"), F.col(f"{z}.id").alias("id"))) for z in "pq"])))
    nearest = near.withColumn("one", F.get(sides, F.lit(0)))
    nearest = nearest.select(*keys, word_id, F.when(F.col("one").isNotNull(), F.struct(F.col("one.id").alias(seg_id), F.lit(0.0).alias("overlap_s"), F.col("one.d").alias("distance_s"))).alias("x"))
    picked = touched.unionByName(nearest)
    close = F.lit(True) if tolerance is None else F.col("x.distance_s") <= tolerance
    how = F.when(F.col("x.overlap_s") > 0, "overlap").when(truly(close) & F.col(f"x.{seg_id}").isNotNull(), "nearest").otherwise("none")
    out = picked.withColumn("how", how)
    return out.select(*keys, word_id, F.when(F.col("how") != "none", F.col(f"x.{seg_id}")).alias(seg_id), F.col("x.overlap_s").alias("overlap_s"), F.col("x.distance_s").alias("distance_s"), "how")


def segment_texts(segments: DataFrame, assigned: DataFrame, words: DataFrame, keys: list[str] = K, word_id: str = "word_id", seg_id: str = "seg_id") -> DataFrame:
    """Each segment with its words in order (``text``), their number and probabilities; empty ones stay."""
    w = assigned.filter(F.col(seg_id).isNotNull()).select(*keys, word_id, seg_id).join(words, [*keys, word_id])
    text = F.trim(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("w_start", word_id, "word"))), lambda x: x["word"]), " "))
    found = w.groupBy(*keys, seg_id).agg(text.alias("text"), F.count("*").alias("n_words"), F.avg("prob").alias("mean_prob"), F.min("prob").alias("min_prob"), F.min("w_start").alias("first_s"), F.max("w_end").alias("last_s"))
    return segments.join(found, [*keys, seg_id], "left").fillna({"text": "", "n_words": 0})


def speaker_windows(df: DataFrame, keys: list[str] = K, speaker: str = "speaker", most: int = 4, max_gap: float = 1.25, min_words: int = 4, tie: str = "seg_id") -> DataFrame:
    """All windows of 1 to ``most`` consecutive segments of a speaker with gaps up to ``max_gap`` and enough words.

    ``df`` needs ``text`` and ``n_words``. Gives ``first_id, last_id, n_joined, start_s, end_s, text, n_words``.
    """
    order = Window.partitionBy(*keys).orderBy("start_s", "end_s", tie)
    broken = changed(F.col(speaker), F.lag(speaker).over(order)) | truly(F.col("start_s") - F.lag("end_s").over(order) > max_gap)
    runs = df.withColumn("__cut", broken.cast("int")).withColumn("run", F.sum("__cut").over(order)).withColumn("ord", F.row_number().over(order))
    parts = []
    own = Window.partitionBy(*keys, "run").orderBy("ord")
    for n in range(1, most + 1):
        frame = own.rowsBetween(0, n - 1)
        w = runs.withColumn("n_joined", F.count("*").over(frame)).withColumn("last_id", F.last(tie).over(frame)).withColumn("__e", F.max("end_s").over(frame)).withColumn("__w", F.sum("n_words").over(frame)).withColumn("__t", F.collect_list("text").over(frame))
        parts.append(w.filter(F.col("n_joined") == n))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out = out.filter(F.col("__w") >= min_words)
    return out.select(*keys, speaker, F.col(tie).alias("first_id"), "last_id", "n_joined", "start_s", F.col("__e").alias("end_s"), F.array_join("__t", " ").alias("text"), F.col("__w").alias("n_words"))


def best_by_distance(distances: dict[str, Column]) -> tuple[Column, Column, Column, Column]:
    """(best, second, best distance, margin) of named distances in a row; NaN and infinite ones count as missing."""
    if len(distances) < 2:
        raise ValueError("at least two distance columns are needed")
    fine = [F.when(c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")), F.struct(c.cast("double").alias("d"), F.lit(n).alias("n"))) for n, c in distances.items()]
    ordered = F.array_sort(F.array_compact(F.array(*fine)))
    one, two = F.get(ordered, F.lit(0)), F.get(ordered, F.lit(1))
    return one["n"], two["n"], one["d"], two["d"] - one["d"]


def relabel(original: Column, best: Column, margin: Column, least: float) -> tuple[Column, Column]:
    """(label, changed): the best where the margin reaches ``least``, else the original, also without a margin."""
    label = F.when(truly(margin >= least), best).otherwise(original)
    return label, changed(label, original)


def overlap_sweep(df: DataFrame, thresholds: tuple[float, ...] = (0.0, 0.01, 0.03, 0.05, 0.1, 0.15, 0.2, 0.3), column: str = "overlap_ratio") -> DataFrame:
    """Segments up to and over each threshold, in one pass."""
    spark = df.sparkSession
    steps = F.broadcast(spark.createDataFrame([(t,) for t in thresholds], "threshold double"))
    at = F.col(column) <= F.col("threshold")
    out = df.select(column).crossJoin(steps).groupBy("threshold").agg(F.count("*").alias("n"), zero_sum(at.cast("long")).alias("n_within"))
    return out.withColumn("share_within", F.col("n_within") / F.col("n")).withColumn("n_over", F.col("n") - F.col("n_within"))


def anchor_sweep(df: DataFrame, thresholds: tuple[float, ...] = (0.0, 0.01, 0.03, 0.05, 0.1, 0.15, 0.2, 0.3), keys: list[str] = K, speaker: str = "speaker", least: int = 3, speakers: int = 2) -> DataFrame:
    """For each overlap limit: candidates, and recordings in which ``speakers`` speakers have ``least`` anchors."""
    steps = F.broadcast(df.sparkSession.createDataFrame([(t,) for t in thresholds], "threshold double"))
    per = df.crossJoin(steps).groupBy("threshold", *keys, speaker).agg(F.sum((F.col("overlap_ratio") <= F.col("threshold")).cast("long")).alias("n"))
    calls = per.groupBy("threshold", *keys).agg(F.sum("n").alias("n"), F.sum((F.col("n") >= least).cast("long")).alias("able"))
    out = calls.groupBy("threshold").agg(F.sum("n").alias("candidates"), F.sum((F.col("able") >= speakers).cast("long")).alias("able_calls"), F.count("*").alias("calls"), F.avg("n").alias("mean_candidates"), F.min("n").alias("min_candidates"), F.max("n").alias("max_candidates"))
    return out.withColumn("coverage", F.col("able_calls") / F.col("calls"))


def recommended_threshold(sweep: DataFrame, enough: float = 0.9) -> DataFrame:
    """The strictest threshold with enough coverage, else that of the best coverage."""
    good = F.min(F.when(F.col("coverage") >= enough, F.col("threshold")))
    return sweep.agg(F.coalesce(good, F.max_by("threshold", F.struct("coverage", -F.col("threshold")))).alias("threshold"))
