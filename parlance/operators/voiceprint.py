"""Speaker vectors: filters, samples, profiles, pairs, identification, relabelling."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from parlance.functions.nulls import truly, truthy
from parlance.functions.vectors import cosine, dot, mean_vectors, unit
from parlance.operators.ranks import by_digest, numbered


def spread(c: Column, salt: str) -> Column:
    """Hex digest that orders keys at random but the same in every run."""
    return F.sha2(F.concat(F.lit(f"{salt}|"), c.cast("string")), 256)


def usable_segments(df: DataFrame, duration: tuple[float, float] = (1.5, 20.0), max_overlap: float = 0.05, min_rms: float = -40.0) -> DataFrame:
    """Segments of known persons in a role, of fit length, overlap and loudness, and valid for export."""
    ok = F.col("role").isin("AGENT", "CLIENT") & F.col("person_id").isNotNull() & F.col("duration_s").between(*duration)
    ok = ok & (F.coalesce("overlap_ratio", F.lit(0.0)) <= max_overlap) & (F.coalesce("rms", F.lit(-999.0)) >= min_rms) & truthy(F.col("valid_export"))
    return df.filter(truly(ok))


def anchor_segments(df: DataFrame, min_duration: float = 1.2, max_overlap: float = 0.05, min_rms: float = -40.0) -> DataFrame:
    """The looser selection for centroids."""
    return df.filter((F.col("duration_s") >= min_duration) & (F.col("overlap_ratio") <= max_overlap) & (F.col("rms") >= min_rms) & F.col("speaker").isNotNull())


def person_samples(df: DataFrame, keys: list[str], vector: str = "v") -> DataFrame:
    """One sample for each person and recording: sums, and the unit mean of the unit vectors."""
    base = df.withColumn("__u", unit(F.col(vector)))
    facts = base.groupBy(*keys).agg(F.count("*").alias("n_segments"), F.sum("duration_s").alias("seconds"), F.avg("duration_s").alias("mean_s"))
    centre = mean_vectors(base, keys, "__u", "__c").select(*keys, unit(F.col("__c")).alias("sample_vector"))
    named = numbered(facts, keys, "__no").withColumn("sample_id", F.format_string("S%06d", F.col("__no"))).drop("__no")
    return named.join(centre, keys).select(*facts.columns, "sample_vector", "sample_id")


def eligible(samples: DataFrame, person: str = "person_id", min_samples: int = 2, min_seconds: float = 10.0) -> DataFrame:
    """Totals of each person and whether they suffice; unknown seconds suffice."""
    out = samples.groupBy(person).agg(F.count("*").alias("n_samples"), F.sum("seconds").alias("seconds"))
    return out.withColumn("eligible", (F.col("n_samples") >= min_samples) & F.coalesce(F.col("seconds") >= min_seconds, F.lit(True)))


def identity_split(persons: DataFrame, person: str = "person_id", test: float = 0.3, salt: str = "pairs") -> DataFrame:
    """Persons dealt into train and test, ceil(test * n) of them to test, by a digest's order."""
    ranked = by_digest(persons, spread(F.col(person), salt), person, "__r", "__n")
    return ranked.select(*persons.columns, F.when(F.col("__r") <= F.ceil(test * F.col("__n")), "test").otherwise("train").alias("part"))


def open_set_split(persons: DataFrame, person: str = "person_id", unknown: float = 0.2, test: float = 0.3, salt: str = "open") -> DataFrame:
    """Persons dealt into unknown, known_test and calibration (at least one each of the first two)."""
    ranked = by_digest(persons, spread(F.col(person), salt), person, "__r", "__n")
    rank, n = F.col("__r"), F.col("__n")
    n_unknown = F.greatest(F.lit(1), F.round(unknown * n).cast("long"))
    n_test = F.greatest(F.lit(1), F.round(test * (n - n_unknown)).cast("long"))
    return ranked.select(*persons.columns, F.when(rank <= n_unknown, "unknown").when(rank <= n_unknown + n_test, "known_test").otherwise("calibration").alias("part"))


def call_split(samples: DataFrame, person: str = "person_id", sample: str = "sample_id", query: float = 0.3, least: int = 2, salt: str = "calls") -> DataFrame:
    """Samples of each person dealt into query and enrolment (at least ``least`` enrolled)."""
    ranked = by_digest(samples, spread(F.col(sample), salt), sample, "__r", "__n", [person])
    asked = F.least(F.greatest(F.lit(1), F.round(query * F.col("__n")).cast("long")), F.greatest(F.col("__n") - least, F.lit(0)))
    return ranked.select(*samples.columns, F.when(F.col("__r") <= asked, "query").otherwise("enrolment").alias("use"))


def verification_pairs(samples: DataFrame, person: str = "person_id", sample: str = "sample_id", vector: str = "v", recording: str | None = None, most_genuine: int = 500, pool: int = 64, ratio: int = 3, most_impostor: int = 200_000, salt: str = "pairs") -> DataFrame:
    """Genuine and impostor pairs with their cosine: ``a, b, same, cosine``.

    Genuine pairs are made among a person's first ``pool`` samples, which are taken in turn from its
    recordings in a digest's order; pairs of different recordings go first, those of one recording fill
    up, and ``most_genuine`` of a person stay. Impostor pairs are ``ratio`` for each genuine one, at most
    ``most_impostor``: a sample with its next ones of other persons in a digest's order. No cross product is
    formed, keys alone are paired, and none is there twice.
    """
    rec = F.col(recording) if recording else F.lit(None)
    s = samples.select(F.col(person).alias("p"), F.col(sample).alias("s"), rec.cast("string").alias("c")).withColumn("o", spread(F.col("s"), salt))
    turn = by_digest(s, F.col("o"), "s", "turn", keys=["p", "c"]).filter(F.col("turn") <= pool)
    few = turn.withColumn("rn", F.row_number().over(Window.partitionBy("p").orderBy("turn", "o", "s"))).filter(F.col("rn") <= pool)
    a, b = few.select("p", F.col("s").alias("a"), F.col("c").alias("ca")), few.select(F.col("p").alias("p2"), F.col("s").alias("b"), F.col("c").alias("cb"))
    both = a.join(b, (F.col("p") == F.col("p2")) & (F.col("a") < F.col("b")))
    order = Window.partitionBy("p").orderBy(truly(F.col("ca") == F.col("cb")), spread(F.concat_ws("/", "a", "b"), salt), "a", "b")
    genuine = both.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= most_genuine).select("a", "b", F.lit(1).alias("same"))
    placed = by_digest(s.select("p", "s", "o"), F.col("o"), "s", "i", "n")
    wanted = F.least(genuine.agg(F.count("*").alias("g")).select("g").scalar() * ratio, F.lit(most_impostor))
    steps = F.least(F.ceil(wanted / F.col("n")).cast("int") * 2 + 2, (F.col("n") - 1).cast("int"))
    step = placed.filter((F.col("i") <= wanted) & (F.col("n") > 1)).withColumn("k", F.explode(F.sequence(F.lit(1), steps)))
    left = step.select(F.col("p").alias("p1"), F.col("s").alias("s1"), ((F.col("i") + F.col("k") - 1) % F.col("n") + 1).alias("j"))
    right = placed.select(F.col("p").alias("p2"), F.col("s").alias("s2"), F.col("i").alias("j"))
    mixed = left.join(right, "j").filter("p1 <> p2").select(F.least("s1", "s2").alias("a"), F.greatest("s1", "s2").alias("b")).distinct()
    chosen = mixed.withColumn("o", spread(F.concat_ws("/", "a", "b"), salt))
    impostor = by_digest(chosen, F.col("o"), "a", "rn").filter(F.col("rn") <= wanted).select("a", "b", F.lit(0).alias("same"))
    va, vb = (samples.select(F.col(sample).alias(k), F.col(vector).alias(f"v{k}")) for k in "ab")
    pairs = genuine.unionByName(impostor).join(va, "a").join(vb, "b")
    return pairs.select("a", "b", "same", cosine(F.col("va"), F.col("vb")).alias("cosine"))


def centres(samples: DataFrame, person: str = "person_id", vector: str = "v") -> DataFrame:
    """Unit centroid of each person's unit vectors: ``person, n_vectors, profile``."""
    return mean_vectors(samples.withColumn("__u", unit(F.col(vector))), [person], "__u", "__c").select(person, "n_vectors", unit(F.col("__c")).alias("profile"))


def profiles(samples: DataFrame, person: str = "person_id", vector: str = "v") -> DataFrame:
    """:func:`centres` with mean, deviation and extremes of the cosines to them."""
    base = samples.withColumn("__u", unit(F.col(vector)))
    centre = centres(samples, person, vector)
    within = base.join(centre, person).withColumn("__s", dot(F.col("__u"), F.col("profile")))
    facts = within.groupBy(person).agg(F.avg("__s").alias("within_mean"), F.stddev_pop("__s").alias("within_std"), F.min("__s").alias("within_min"), F.max("__s").alias("within_max"))
    return centre.join(facts, person)


def _rows(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def _away(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows to points."""
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (points * points).sum(1)[None] - 2 * x @ points.T, 0))


def cells(points: np.ndarray, ring: float):
    """Arrow batches of profiles with their cell: the nearest pivot and the ring around it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = _away(_rows(batch.column("__p"), points.shape[1]), points)
            b = d.argmin(1) if len(d) else np.zeros(0, np.int64)
            r = np.floor(d[np.arange(len(d)), b] / ring)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(b.astype(np.int32)), pa.array(r.astype(np.int32))], [*batch.schema.names, "__b", "__r"])

    return run


def visits(points: np.ndarray, ring: float):
    """Arrow batches of queries with the cells (a pivot and a range of its rings) that can hold one of their two nearest profiles.

    Pivots are profiles, so the second nearest profile is no farther than the second nearest pivot, at ``u``. A cell is left out
    if its ring lies wholly nearer or farther than ``u`` around the query's distance to its pivot, or if the plane between
    its pivot and one of the query's nearest pivots is farther than ``u``.
    """
    between = _away(points, points)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = np.flatnonzero(np.asarray(batch.column("__q").is_valid()))
            lists: list[list[dict] | None] = [None] * batch.num_rows
            for a in range(0, len(known), 256):
                at = known[a : a + 256]
                d = _away(_rows(batch.column("__q").take(pa.array(at)), points.shape[1]), points)
                order = np.argsort(d, axis=1, kind="stable")
                u = (np.take_along_axis(d, order[:, 1:2], 1) if len(points) > 1 else np.full((len(d), 1), 5.0)) + 1e-6
                plane = np.full(d.shape, -np.inf)
                for j in order[:, :8].T:
                    gap = between[j]
                    here = d**2 - np.take_along_axis(d, j[:, None], 1) ** 2
                    plane = np.maximum(plane, np.divide(here, 2 * gap, out=np.full(d.shape, -np.inf), where=gap > 1e-9))
                low, high = np.maximum(np.floor((d - u) / ring), 0).astype(int), np.floor((d + u) / ring).astype(int)
                for i, row, lo, hi in zip(at, plane <= u, low, high):
                    lists[i] = [{"b": int(b), "lo": int(lo[b]), "hi": int(hi[b])} for b in np.flatnonzero(row)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lists, pa.list_(pa.struct([("b", pa.int32()), ("lo", pa.int32()), ("hi", pa.int32())])))], [*batch.schema.names, "__cells"])

    return run


def probes(queries: DataFrame, profile: DataFrame, sample: str = "sample_id", person: str = "person_id", vector: str = "v", pivots: int = 256, part: int = 128, ring: float = 0.1) -> DataFrame:
    """What :func:`identified` compares: ``sample, truth, __q`` with ``__held``, the profiles of one block of a cell that the bounds leave."""
    q = queries.select(F.col(sample), F.col(person).alias("truth"), unit(F.col(vector)).alias("__q"))
    p = profile.select(F.col(person).alias("best"), F.col("profile").alias("__p")).filter("__p IS NOT NULL")
    some = p.orderBy(F.xxhash64("best"), "best").limit(pivots).select("__p").toArrow()  # at most ``pivots`` rows
    if not some.num_rows:
        return q.select("*", F.lit(None).cast(ArrayType(StructType(p.schema.fields))).alias("__held"))
    column = some.column("__p").combine_chunks()
    points = _rows(column, len(column[0]))
    placed = p.mapInArrow(cells(points, ring), StructType([*p.schema.fields, StructField("__b", IntegerType()), StructField("__r", IntegerType())]))
    sizes = placed.groupBy("__b", "__r").agg(F.ceil(F.count("*") / part).alias("__n"))
    held = placed.join(sizes, ["__b", "__r"]).withColumn("__k", F.pmod(F.xxhash64("best"), F.col("__n")))
    held = held.groupBy("__b", "__r", "__k").agg(F.collect_list(F.struct("best", "__p")).alias("__held"))  # some ``part`` profiles
    cell = ArrayType(StructType([StructField("b", IntegerType()), StructField("lo", IntegerType()), StructField("hi", IntegerType())]))
    asked = q.mapInArrow(visits(points, ring), StructType([*q.schema.fields, StructField("__cells", cell)])).select(*q.columns, F.explode_outer("__cells").alias("__c"))
    met = asked.join(held, (F.col("__c.b") == F.col("__b")) & F.col("__r").between(F.col("__c.lo"), F.col("__c.hi")), "left")
    return met.filter("__held IS NOT NULL OR __c IS NULL").select(sample, "truth", "__q", "__held")


def identified(queries: DataFrame, profile: DataFrame, sample: str = "sample_id", person: str = "person_id", vector: str = "v", pivots: int = 256, part: int = 128, ring: float = 0.1) -> DataFrame:
    """Best and second profile of each query by cosine, with the margin: ``sample, truth, best, best_score, second_score, margin``.

    Exact at any number of profiles, by bounds instead of comparing all: profiles of unit length lie in cells, the nearest of ``pivots`` profiles and a ring of
    width ``ring`` around it, dealt in blocks of some ``part``; a query visits the cells that the triangle inequality leaves
    (:func:`visits`), and each block gives its two best. About the root of the number of profiles is a good number of pivots; they are
    collected and go to every task. Ties go to the lesser person. A query without a vector, or where there are no profiles, has a row without a best one; with one profile there is no second.
    """
    found = probes(queries, profile, sample, person, vector, pivots, part, ring)
    scores = F.transform("__held", lambda x: F.struct((-dot(F.col("__q"), x["__p"])).alias("s"), x["best"].alias("best")))
    two = found.select(sample, "truth", F.slice(F.array_sort(scores), 1, 2).alias("__two"))
    best = F.array_sort(F.array_distinct(F.flatten(F.collect_list("__two"))))
    out = two.groupBy(sample, "truth").agg(best.alias("__two"))
    one, other = F.get("__two", F.lit(0)), F.get("__two", F.lit(1))
    return out.select(sample, "truth", one["best"].alias("best"), (-one["s"]).alias("best_score"), (-other["s"]).alias("second_score"), (other["s"] - one["s"]).alias("margin"))


def open_set_decisions(found: DataFrame, known: DataFrame, threshold: float, sample: str = "sample_id", person: str = "person_id") -> DataFrame:
    """KNOWN with the best person from the threshold up, else UNKNOWN; and whether that is right."""
    enrolled = known.select(F.col(person).alias("truth"), F.lit(True).alias("__k")).distinct()
    out = found.join(enrolled, "truth", "left").withColumn("truth_known", F.coalesce("__k", F.lit(False))).drop("__k")
    yes = F.col("best_score") >= threshold
    out = out.withColumn("decision", F.when(yes, "KNOWN").otherwise("UNKNOWN")).withColumn("assigned", F.when(yes, F.col("best").cast("string")).otherwise(F.concat(F.lit("UNKNOWN::"), F.col(sample).cast("string"))))
    return out.withColumn("correct", F.when(F.col("truth_known"), yes & (F.col("best") == F.col("truth"))).otherwise(~yes))


def nearest_centroid(df: DataFrame, centroids: DataFrame, keys: list[str], speaker: str = "speaker", vector: str = "v", margin: float = 0.01, tie: str = "seg_id") -> DataFrame:
    """Segments relabelled to the nearest centroid of their recording (cosine distance).

    With one centroid, or a margin of at least ``margin`` to the second, the nearest one's label, else the original's; also without
    a vector.
    """
    c = centroids.select(*keys, F.col(speaker).alias("__name"), F.col("centroid").alias("__c"))
    pairs = df.join(c, keys, "left").withColumn("__d", F.when(F.col(vector).isNotNull(), 1 - cosine(F.col(vector), F.col("__c"))))
    near = F.array_sort(F.collect_list(F.when(F.col("__d").isNotNull(), F.struct(F.col("__d").alias("d"), F.col("__name").alias("n")))))
    rows = pairs.groupBy(*keys, tie).agg(F.first(speaker).alias(speaker), near.alias("x"))
    one, two = F.get("x", F.lit(0)), F.get("x", F.lit(1))
    sure = one.isNotNull() & (two.isNull() | truly(two["d"] - one["d"] >= margin))
    out = rows.withColumn("distance", one["d"]).withColumn("margin", two["d"] - one["d"]).withColumn("speaker_final", F.when(sure, one["n"]).otherwise(F.col(speaker)))
    return out.withColumn("changed", F.coalesce(F.col("speaker_final") != F.col(speaker), F.lit(True))).drop("x")
