"""Tables behind the reports of each phase, and the joins that prepare them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions.nulls import first_text, truly
from parlance.operators.matching import keep_first, null_safe_join
from parlance.operators.ranks import by_digest, with_medians
from parlance.operators.sentiment import long_metrics


def named_counts(counts: dict[str, DataFrame]) -> DataFrame:
    """(metric, value) of one-row, one-column tables, under their names in order."""
    out = None
    for name, one in counts.items():
        row = one.select(F.lit(name).alias("metric"), F.col(one.columns[0]).cast("double").alias("value"))
        out = row if out is None else out.unionByName(row)
    if out is None:
        raise ValueError("no counts")
    return out


def rows(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n"))


def different(df: DataFrame, *columns: str) -> DataFrame:
    """How many combinations of the columns there are, without missing ones."""
    return df.agg(F.count_distinct(*columns).alias("n"))


def relabel_summary(df: DataFrame, keys: list[str], changed: str = "changed", margin: str = "margin") -> DataFrame:
    """For each recording: segments, changed ones and their share, mean, median and largest margin."""
    hit = F.col(changed).cast("long")
    facts = df.groupBy(*keys).agg(F.count("*").alias("n_segments"), F.sum(hit).alias("n_changed"), F.avg(hit).alias("share_changed"), F.avg(margin).alias("mean_margin"), F.max(margin).alias("max_margin"))
    return with_medians(facts, df, {margin: "median_margin"}, keys)


def per_call_accuracy(df: DataFrame, keys: list[str], truth: str, predicted: str, names: tuple[str, ...] = ("AGENT", "CLIENT")) -> DataFrame:
    """For each call the counts of each true and predicted name, 0 where none, and the share of equal ones; rows without either name are left out."""
    both = df.filter(F.col(truth).isin(*names) & F.col(predicted).isin(*names))
    cells = [F.sum(((F.col(truth) == a) & (F.col(predicted) == b)).cast("long")).alias(f"{a}_as_{b}") for a in names for b in names]
    return both.groupBy(*keys).agg(*cells, F.avg((F.col(truth) == F.col(predicted)).cast("int")).alias("accuracy"))


def proxy_summary(segments: DataFrame, turns: DataFrame, candidates: DataFrame, accepted: DataFrame, strict: DataFrame, mapping: DataFrame, labelled: DataFrame, key: str = "audio_id", speaker: str = "speaker", text: str = "text", label: str = "proxy_role") -> DataFrame:
    """The thirteen counts of the textual proxy as (metric, value)."""
    with_text = segments.filter(F.trim(F.coalesce(text, F.lit(""))) != "")
    done = labelled.filter(F.col(label).isNotNull())
    return named_counts({
        "audios_diarized": different(segments, key), "segments_diarized": rows(segments), "segments_with_text": rows(with_text), "audios_with_official_turns": different(turns, key), "official_turns": rows(turns),
        "alignment_candidates": rows(candidates), "accepted_matches": rows(accepted), "audios_with_accepted_matches": different(accepted, key), "speakers_with_accepted_matches": different(accepted, key, speaker),
        "strict_mappings": rows(strict), "aggregated_mappings": rows(mapping), "audios_labeled": different(done, key), "segments_labeled": rows(done),
    })


def pairwise_summary(segments: DataFrame, samples: DataFrame, persons: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """Verification as (metric, value): sizes, eligible persons, and accuracy, precision, recall and F1 of pairs (``same``, ``cosine``) at the threshold."""
    from parlance.operators.evaluation import auc, confusion

    c = confusion(pairs, threshold, "same", "cosine")
    head = named_counts({"segments": rows(segments), "samples": rows(samples), "persons": rows(persons), "eligible_persons": rows(persons.filter("eligible")), "pairs": rows(pairs)})
    return head.unionByName(long_metrics(c.select("accuracy", "precision", "recall", "f1"))).unionByName(long_metrics(auc(pairs, "same", "cosine").select("auc")))


def open_set_summary(samples: DataFrame, persons: DataFrame, profiles: DataFrame, metrics: DataFrame, threshold: float) -> DataFrame:
    """Identification as (metric, value): sizes, threshold and rates."""
    head = named_counts({"samples": rows(samples), "persons": rows(persons), "profiles": rows(profiles)})
    known = metrics.select("identification_rate", (1 - F.col("false_acceptance_rate")).alias("unknown_rejection_rate"), "overall_accuracy", F.lit(threshold).alias("threshold"))
    return head.unionByName(long_metrics(known))


def prosody_summary(segments: DataFrame, candidates: DataFrame, scores: DataFrame, ok: Column, key: str, role: str, measures: list[str], label: str | None = None) -> DataFrame:
    """One wide row: sizes, recordings, roles, mean and median of the measures, and the most frequent label (ties by name)."""
    facts = [F.count("*").alias("n_scored"), F.sum(truly(ok).cast("long")).alias("n_ok"), F.count_distinct(key).alias("n_audios"), F.count_distinct(role).alias("n_roles")]
    facts += [F.avg(m).alias(f"mean_{m}") for m in measures]
    out = with_medians(scores.agg(*facts), scores, {m: f"median_{m}" for m in measures}).crossJoin(rows(segments).withColumnRenamed("n", "n_segments")).crossJoin(rows(candidates).withColumnRenamed("n", "n_candidates"))
    if label:
        counts = scores.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("k"))
        top = counts.agg(F.min_by(F.struct(label, "k"), F.struct(-F.col("k"), label)).alias("x")).select(F.col(f"x.{label}").alias("most_common_label"), F.col("x.k").alias("most_common_n"))
        out = out.crossJoin(top)
    return out


def fusion_summary(fused: DataFrame, correlations: DataFrame, disagreement: DataFrame) -> DataFrame:
    """(metric, value): segments, comparable ones, Pearson of each pair, percent of masked frustration at two digits."""
    sizes = fused.agg(F.count("*").alias("segments"), F.sum((F.col("has_audio") & F.col("has_text")).cast("long")).alias("comparable"))
    pearson = correlations.select(F.concat(F.lit("pearson_"), "x").alias("metric"), F.col("pearson").alias("value"))
    masked = disagreement.agg(F.round(100 * F.avg(F.col("masked_frustration").cast("int")), 2).alias("pct_masked_frustration"))
    return long_metrics(sizes).unionByName(pearson).unionByName(long_metrics(masked))


def alignment_summary(matches: DataFrame, key: str) -> DataFrame:
    """For each call: aligned turns, accepted ones, and the mean combined score."""
    return matches.groupBy(key).agg(F.count("*").alias("n_turns"), F.sum(F.col("accepted").cast("long")).alias("n_accepted"), F.avg("combined").alias("mean_combined"))


def accepted_matches(matches: DataFrame, key: str, turn: str = "turn") -> DataFrame:
    """Accepted matches by call, turn and falling score."""
    return matches.filter("accepted").orderBy(key, turn, F.desc("combined"))


def has_comparable(df: DataFrame) -> DataFrame:
    """One row: whether any segment has both modalities."""
    return df.agg(F.coalesce(F.max(F.col("has_audio") & F.col("has_text")), F.lit(False)).alias("usable"))


def duration_gap(df: DataFrame, seconds: str, minutes: str) -> DataFrame:
    """``df`` with ``gap_min``: how far measured seconds and stated minutes are apart."""
    return df.withColumn("gap_min", F.abs(F.col(seconds) / 60 - F.col(minutes)))


def with_aliases(df: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """Each alias filled from its source where it is missing, or made; aliases without a source are left as they are."""
    for alias, source in aliases.items():
        if source in df.columns:
            df = df.withColumn(alias, F.coalesce(alias, source) if alias in df.columns else F.col(source))
    return df


def sampled_by(df: DataFrame, group: str, key: str, n: int, salt: str = "sample") -> DataFrame:
    """``n`` rows of each group (a missing one is a group) in the order of a digest of the key."""
    digest = F.sha2(F.concat(F.lit(f"{salt}|"), F.col(key).cast("string")), 256)
    return by_digest(df, digest, key, "__nth", keys=[group]).filter(F.col("__nth") <= n).drop("__nth")


def with_person(vectors: DataFrame, mapping: DataFrame, keys: list[str]) -> DataFrame:
    """Vectors with their speaker's role and the person behind it: the agent's or the client's hash.

    ``mapping`` has ``keys, role, agent_hash, customer_hash``; of several rows of a key the first by its columns counts.
    """
    rest = ["role", "agent_hash", "customer_hash"]
    one, _ = keep_first(mapping.select(*keys, *rest), keys, *[F.col(c).asc_nulls_last() for c in rest])
    out = null_safe_join(vectors, one, keys).withColumn("role", F.upper(F.trim("role")))
    person = F.when(F.col("role") == "AGENT", F.col("agent_hash")).when(F.col("role") == "CLIENT", F.col("customer_hash"))
    return out.withColumn("person", first_text(person))


def role_coverage(df: DataFrame, key: str) -> DataFrame:
    """For each role, the missing one included: segments, those with a person, recordings and persons."""
    return df.groupBy("role").agg(F.count("*").alias("n_segments"), F.count("person").alias("n_with_person"), F.count_distinct(key).alias("n_audios"), F.count_distinct("person").alias("n_persons"))


def with_metadata(df: DataFrame, metadata: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Left join of metadata, one row of each key: the first in the order."""
    one, _ = keep_first(metadata, keys, *[F.col(c).asc_nulls_last() for c in order])
    return null_safe_join(df, one, keys)


def validation_table(raw: DataFrame, merged: DataFrame, stages: dict[str, DataFrame], keys: list[str], seg_id: str = "seg_id", members: str = "merged_ids", group: str = "merge_id") -> DataFrame:
    """Raw segments with the merged segment each went into and, for each stage, whether it is there.

    ``merged`` has ``seg_id`` and the ids of its raw segments joined by commas; a stage is a table with the keys and ``seg_id``.
    """
    kind = raw.schema[seg_id].dataType
    into = merged.select(*keys, F.col(seg_id).alias(group), F.explode(F.split(members, ",")).alias("__m")).select(*keys, F.trim("__m").cast(kind).alias(seg_id), group)
    out = null_safe_join(raw, into.dropDuplicates([*keys, seg_id]), [*keys, seg_id]).withColumn("in_merged", F.col(group).isNotNull())
    for name, df in stages.items():
        mark = df.select(*keys, seg_id).distinct().withColumn("__there", F.lit(True))
        out = null_safe_join(out, mark, [*keys, seg_id]).withColumn(f"in_{name}", F.coalesce("__there", F.lit(False))).drop("__there")
    return out


def consolidated(shards: list[DataFrame], valid: Column, keys: list[str], order: list[Column]) -> DataFrame:
    """Shards under one another, valid rows only, the first of each key."""
    out = shards[0]
    for s in shards[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    first, _ = keep_first(out.filter(truly(valid)), keys, *order)
    return first


def text_base(segments: DataFrame, transcripts: DataFrame, keys: list[str], min_words: int = 2) -> DataFrame:
    """Segments with the transcript under the same keys and times (rounded to milliseconds), and whether it has enough words."""
    from parlance.operators.matching import time_key_join

    return time_key_join(segments, transcripts, keys).withColumn("eligible", truly(F.col("n_words") >= min_words))


def served(queries: DataFrame, profile: DataFrame, threshold: float, size: int, sample: str = "sample_id", person: str = "person_id", vector: str = "v") -> DataFrame:
    """Open-set answers against stored profiles; a vector of another length than ``size`` raises."""
    from parlance.operators.voiceprint import identified

    wrong = F.size(vector) != size
    checked = queries.withColumn(vector, F.when(wrong, F.raise_error(F.concat(F.lit(f"a vector of {size} components is needed, not "), F.size(vector).cast("string"))).cast(queries.schema[vector].dataType)).otherwise(F.col(vector)))
    found = identified(checked, profile, sample, person, vector)
    yes = F.col("best_score") >= threshold
    return found.withColumn("decision", F.when(yes, "KNOWN").otherwise("UNKNOWN")).withColumn("assigned", F.when(yes, F.col("best").cast("string")).otherwise(F.concat(F.lit("UNKNOWN::"), F.col(sample).cast("string"))))


def plane(df: DataFrame, vector: str = "v", into: str = "xy") -> DataFrame:
    """Vectors standardised and projected on their two principal components."""
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    base = df.withColumn("__x", array_to_vector(F.col(vector).cast("array<double>")))
    scaled = StandardScaler(withMean=True, withStd=True, inputCol="__x", outputCol="__z").fit(base).transform(base)
    out = PCA(k=2, inputCol="__z", outputCol="__p").fit(scaled).transform(scaled)
    return out.withColumn(into, vector_to_array("__p")).drop("__x", "__z", "__p")


def text_pair_scores(df: DataFrame, key: str, a: str, b: str, weights: tuple[float, float] = (0.55, 0.45)) -> DataFrame:
    """``key, cosine, containment, score`` of two texts of a row: TF-IDF of character grams over the two, and token containment; 0 where one is blank."""
    from parlance.operators.roles import gram_cosines, token_scores

    cos = gram_cosines(df, key, a, b).withColumnRenamed("cosine", "__c")
    both = token_scores(df.select(key, F.col(a).alias("__x"), F.col(b).alias("__y")), "__x", "__y").join(cos, key, "left")
    blank = truly(F.trim("__x") == "") | truly(F.trim("__y") == "") | F.col("__x").isNull() | F.col("__y").isNull()
    cosine = F.coalesce("__c", F.lit(0.0))
    score = F.when(blank, 0.0).otherwise(weights[0] * cosine + weights[1] * F.col("containment"))
    return both.select(key, cosine.alias("cosine"), "containment", score.alias("score"))


def pairs_of_centroids(samples: DataFrame, person: str, sample: str, vector: str) -> DataFrame:
    """Genuine and impostor pairs of recordings' centroids under the proxy's smaller bounds: 20 of a person, 20,000 impostors."""
    from parlance.operators.voiceprint import verification_pairs

    return verification_pairs(samples, person, sample, vector, most_genuine=20, most_impostor=20_000)


def sample_sets(samples: DataFrame, parts: DataFrame, person: str = "person_id") -> DataFrame:
    """Samples of the persons that were dealt into parts, with their part."""
    return samples.join(parts.select(person, "part"), person)


def anchor_centroids(anchors: DataFrame, vectors: DataFrame, keys: list[str], speaker: str = "speaker", seg_id: str = "seg_id", vector: str = "v") -> DataFrame:
    """Unit mean of the unit vectors of each speaker's anchors, and their number; anchors without a vector count for nothing."""
    from parlance.functions.vectors import mean_vectors, unit

    own = anchors.select(*keys, speaker, seg_id).join(vectors.select(F.col(seg_id), unit(F.col(vector)).alias("__u")), seg_id)
    return mean_vectors(own, [*keys, speaker], "__u", "__c").select(*keys, speaker, "n_vectors", unit(F.col("__c")).alias("centroid"))


def run_totals(summary: DataFrame) -> DataFrame:
    """One row over all recordings: how many, their segments, valid ones, anchors, overlap regions and overlapped seconds."""
    names = [c for c in ("n_segments", "n_valid_export", "n_valid_anchor", "n_regions", "region_s") if c in summary.columns]
    return summary.agg(F.count("*").alias("n_recordings"), *[F.sum(c).alias(c) for c in names])
