"""Robust scaling of acoustic features, and prosodic scores and states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions.nulls import truly
from parlance.operators.ranks import number_bucket, numbered, quantiles, running, with_medians

#: Weights of the scaled features in each score.
AROUSAL = {"rms_audio_dbfs": 0.35, "energy_dynamic_range": 0.20, "pitch_range_p90_p10": 0.20, "spectral_centroid_mean": 0.15, "zcr_mean": 0.10}
TENSION = {"pitch_std": 0.25, "pitch_range_p90_p10": 0.25, "rms_audio_std": 0.20, "spectral_rolloff_mean": 0.20, "zcr_mean": 0.10}
INTENSITY = {"rms_audio_dbfs": 0.60, "energy_dynamic_range": 0.25, "spectral_centroid_mean": 0.15}
SCORES = {"arousal": AROUSAL, "tension": TENSION, "intensity": INTENSITY}


def candidates(df: DataFrame, duration: tuple[float, float] = (0.5, 30.0), max_overlap: float = 0.2, min_rms: float = -45.0, need_role: bool = True, stem: str = "audio_id", order: tuple[str, ...] = ("audio_id", "start_s", "end_s", "seg_id")) -> DataFrame:
    """Segments fit for acoustic features, numbered from 0 in a total order (``prosody_row_id``).

    Unknown overlap counts as none, unknown loudness as silence. Roles that say that there is none, and
    the collected recordings ``all`` and ``all_...``, are left out.
    """
    length = F.col("end_s") - F.col("start_s")
    ok = length.between(*duration) & (F.coalesce("overlap_ratio", F.lit(0.0)) <= max_overlap) & (F.coalesce("rms", F.lit(-999.0)) >= min_rms)
    if need_role:
        ok = ok & F.col("role").isNotNull() & ~F.lower("role").isin("nan", "none", "", "no_textual_proxy")
    name = F.lower(F.col(stem).cast("string"))
    ok = ok & F.col(stem).isNotNull() & (name != "all") & ~name.startswith("all_")
    return numbered(df.withColumn("duration_for_prosody", length).filter(truly(ok)), list(order), "prosody_row_id")


def robust_scaled(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` with ``z_`` of each column: 0.6745 (x - median) / MAD.

    Where the MAD is 0 the sample deviation about the mean serves; where that is 0 too, z is 0. Means and medians
    are one row, read before the plan goes on, and so are the MADs: as constants they do not have ``df`` made anew at each use.
    """
    half = {c: [0.5] for c in columns}
    first = df.agg(*[F.avg(c).cast("double").alias(f"avg_{c}") for c in columns], *[F.stddev_samp(c).alias(f"std_{c}") for c in columns])
    one = first.crossJoin(quantiles(df, half, {(c, 0.5): f"med_{c}" for c in columns})).first().asDict()
    known = lambda v: F.lit(v).cast("double")
    away = df.select(*[F.abs(F.col(c) - known(one[f"med_{c}"])).alias(c) for c in columns])
    mads = quantiles(away, half, {(c, 0.5): c for c in columns}).first()

    def z(c: str) -> Column:
        mad, std = known(mads[c]), F.coalesce(known(one[f"std_{c}"]), F.lit(0.0))
        by_mad = 0.6745 * (F.col(c) - known(one[f"med_{c}"])) / F.when(mad > 0, mad)
        by_std = F.when(std > 0, (F.col(c) - known(one[f"avg_{c}"])) / F.when(std > 0, std)).otherwise(F.col(c) * 0)
        return F.when(mad > 0, by_mad).otherwise(by_std)

    return df.select("*", *[z(c).alias(f"z_{c}") for c in columns])


def scaled_01(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` with each column clipped to its 1st and 99th percentile and scaled to 0..1; null if those meet. The percentiles are read before the plan goes on."""
    ends = quantiles(df, {c: [0.01, 0.99] for c in columns}, {(c, q): f"{n}_{c}" for c in columns for n, q in (("lo", 0.01), ("hi", 0.99))}).first()

    def scale(c: str) -> Column:
        lo, hi = F.lit(ends[f"lo_{c}"]).cast("double"), F.lit(ends[f"hi_{c}"]).cast("double")
        return F.when(hi > lo, (F.least(F.greatest(F.col(c), lo), hi) - lo) / F.when(hi > lo, hi - lo))

    return df.select(*[c for c in df.columns if c not in columns], *[F.when(F.col(c).isNotNull(), scale(c)).alias(c) for c in columns])


def prosodic_scores(df: DataFrame, ok: Column, high: float = 0.75) -> DataFrame:
    """``df`` with arousal, tension, intensity and calm scores and the prosodic state.

    Features are scaled over all rows, also those that are not ``ok``, whose scores are then masked. A
    missing feature makes its scores missing.
    """
    names = sorted({c for w in SCORES.values() for c in w})
    z = robust_scaled(df, names)
    raw = z.select(*df.columns, *[sum((w * F.col(f"z_{c}") for c, w in weights.items()), F.lit(0.0)).alias(f"{n}_proxy_score") for n, weights in SCORES.items()])
    out = scaled_01(raw, [f"{n}_proxy_score" for n in SCORES]).withColumn("calm_proxy_score", 1 - F.col("arousal_proxy_score"))
    out = out.withColumns({f"{n}_proxy_score": F.when(ok, F.col(f"{n}_proxy_score")) for n in (*SCORES, "calm")})
    over = lambda n: truly(F.col(f"{n}_proxy_score") >= high)
    state = F.when(~ok, "sin_score").when(over("tension"), "alta_tension_prosodica").when(over("arousal"), "alta_activacion").when(over("calm"), "calma_prosodica").otherwise("neutral_prosodico")
    return out.withColumn("prosodic_state", state)


def aggregates(df: DataFrame, key_sets: list[list[str]], measures: list[str]) -> DataFrame:
    """Count, sum, mean, median and maximum of the measures over several key sets, with ``level`` naming the set.

    A row is read once for all sets; the medians are selected by counted buckets, whatever a group's size.
    """
    every = list(dict.fromkeys(k for ks in key_sets for k in ks))
    sets = [F.struct(F.lit("+".join(ks)).alias("level"), *[(F.col(k) if k in ks else F.lit(None)).cast("string").alias(k) for k in every]) for ks in key_sets]
    rows = df.select(F.explode(F.array(*sets)).alias("__g"), *measures).select("__g.*", *[F.col(c).alias(f"__m_{c}") for c in measures])
    by = ["level", *every]
    sums = rows.groupBy(*by).agg(*[f(f"__m_{c}").alias(f"{c}_{n}") for c in measures for n, f in (("count", F.count), ("sum", F.sum), ("mean", F.avg), ("max", F.max))])
    out = with_medians(sums, rows, {f"__m_{c}": f"{c}_median" for c in measures}, by)
    return out.select(*by, *[f"{c}_{n}" for c in measures for n in ("count", "sum", "mean", "median", "max")])


def iqr_outliers(df: DataFrame, column: str, times: float = 1.5) -> DataFrame:
    """``df`` with ``is_outlier``: outside the quartiles by ``times`` their distance."""
    q = quantiles(df, {column: [0.25, 0.75]}, {(column, 0.25): "__q1", (column, 0.75): "__q3"})
    span = times * (F.col("__q3") - F.col("__q1"))
    out = (F.col(column) < F.col("__q1") - span) | (F.col(column) > F.col("__q3") + span)
    return df.crossJoin(F.broadcast(q)).withColumn("is_outlier", truly(out)).drop("__q1", "__q3")


def described(df: DataFrame, columns: list[str]) -> DataFrame:
    """Count, mean, deviation, least, exact quartiles and largest of each column, one row each; no task holds a column's values."""
    shares = {"p25": 0.25, "p50": 0.5, "p75": 0.75}
    before, after = [("n", F.count), ("mean", F.avg), ("std", F.stddev_samp), ("min", F.min)], [("max", F.max)]
    facts = df.agg(*[f(c).cast("double").alias(f"{c}_{n}") for c in columns for n, f in before + after])
    ends = quantiles(df, {c: list(shares.values()) for c in columns}, {(c, q): f"{c}_{n}" for c in columns for n, q in shares.items()})
    order = [n for n, _ in before] + list(shares) + [n for n, _ in after]
    items = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), *[F.col(f"{c}_{n}").alias(n) for n in order]) for c in columns]))
    return facts.crossJoin(F.broadcast(ends)).select(items.alias("x")).select("x.*")


def ecdf(df: DataFrame, column: str) -> DataFrame:
    """Each value with the share of rows up to it; counted by value before the running sum."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("__n"))
    out = running(counts, number_bucket(F.col(column)), [F.col(column)], {"__below": "__n"})
    return out.select(column, ((F.col("__below") + F.col("__n")) / F.col("__below_all")).alias("share"))
