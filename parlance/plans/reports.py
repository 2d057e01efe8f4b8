"""Further queries of the catalogue: the tables behind reports, and the joins that prepare them."""

from __future__ import annotations

from pyspark.sql import functions as F

from parlance.functions import names as N
from parlance.functions import nulls
from parlance.functions import text as X
from parlance.functions.vectors import mean_vectors, unit
from parlance.operators import evaluation, fusion, intervals, matching, prosody, reports, roles, sentiment, summaries, voiceprint
from parlance.plans import adapters as A
from parlance.plans import catalogue as C
from parlance.plans.catalogue import R, query

THRESHOLD = 0.3


@query(f"WITH {C._SCORED} SELECT audio_id, seg_id FROM sc WHERE len_s >= 600 AND overlap_ratio <= 0.5 AND rms >= -40 AND speaker IS NOT NULL")
def anchor_segment_filter(spark, d):
    return voiceprint.anchor_segments(C._scored(spark, d), 600.0, 0.5, -40.0).select("audio_id", "seg_id")


@query(f"WITH {C._TFIDF} SELECT audio_id, turn, win AS window, {R('comb', 'combined')} FROM al WHERE comb >= 0.2 AND cosine >= 0.1 AND cont >= 0.05 AND margin >= 0.001")
def accepted_text_matches(spark, d):
    return reports.accepted_matches(C._aligned(spark, d), "audio_id").select("audio_id", "turn", "window", "combined")


@query(f"WITH {C._TFIDF} SELECT audio_id, count(*) AS n_turns, count(*) FILTER (comb >= 0.2 AND cosine >= 0.1 AND cont >= 0.05 AND margin >= 0.001) AS n_accepted, {R('avg(comb)', 'mean_combined')} FROM al GROUP BY audio_id")
def alignment_processing_summary(spark, d):
    return reports.alignment_summary(C._aligned(spark, d), "audio_id")


@query(f"WITH {C._PARTS} SELECT sample_id, CASE WHEN asked THEN 'query' ELSE 'enrolment' END AS use FROM us")
def call_split_use(spark, d):
    return C._uses(spark, d).select("sample_id", "use")


_ELIGIBLE = f"{C._SAMPLES}, id AS (SELECT *, printf('S%06d', row_number() OVER (ORDER BY person_id, audio_key) - 1) AS sample_id FROM f), el AS (SELECT person_id FROM f GROUP BY 1 HAVING count(*) >= 3 AND sum(seconds) >= 10), pt AS (SELECT person_id, CASE WHEN row_number() OVER (ORDER BY sha256('pairs|' || person_id), person_id) <= ceil(0.3 * count(*) OVER ()) THEN 'test' ELSE 'train' END AS part FROM el)"


@query(f"WITH {_ELIGIBLE} SELECT sample_id, part FROM id JOIN pt USING (person_id)")
def pairwise_sample_sets(spark, d):
    s = C._samples(spark, d)
    fit = voiceprint.eligible(s, min_samples=3, min_seconds=10.0).filter("eligible").select("person_id")
    return reports.sample_sets(s, voiceprint.identity_split(fit)).select("sample_id", "part")


_CENTROID_PAIRS = f"""{_ELIGIBLE}, ct AS (SELECT id.person_id, id.sample_id, list(x / n ORDER BY i) AS v FROM m JOIN nn USING (person_id, audio_key) JOIN id USING (person_id, audio_key) GROUP BY ALL),
so AS (SELECT *, sha256('pairs|' || sample_id) AS o FROM ct), fw AS (SELECT * FROM so QUALIFY row_number() OVER (PARTITION BY person_id ORDER BY o, sample_id) <= 64),
g AS (SELECT a.sample_id AS a, b.sample_id AS b FROM fw a JOIN fw b ON a.person_id = b.person_id AND a.sample_id < b.sample_id QUALIFY row_number() OVER (PARTITION BY a.person_id ORDER BY sha256('pairs|' || a.sample_id || '/' || b.sample_id), a.sample_id, b.sample_id) <= 20),
wt AS (SELECT least(3 * count(*), 20000) AS w FROM g), pl AS (SELECT person_id, sample_id, row_number() OVER (ORDER BY o, sample_id) AS i, count(*) OVER () AS n FROM so),
sp AS (SELECT pl.*, w, unnest(range(1, least(CAST(ceil(w / n) AS BIGINT) * 2 + 2, n - 1) + 1)) AS k FROM pl, wt WHERE i <= w AND n > 1),
mx AS (SELECT DISTINCT least(sp.sample_id, q.sample_id) AS a, greatest(sp.sample_id, q.sample_id) AS b, w FROM sp JOIN pl q ON q.i = (sp.i + k - 1) % sp.n + 1 WHERE sp.person_id <> q.person_id),
im AS (SELECT a, b FROM mx QUALIFY row_number() OVER (ORDER BY sha256('pairs|' || a || '/' || b), a) <= w)"""


@query(f"WITH {_CENTROID_PAIRS}, u2 AS (SELECT a, b, 1 AS same FROM g UNION ALL SELECT a, b, 0 FROM im) SELECT a, b, CAST(same AS BIGINT) AS same, {R(C._cos('p.v', 'q.v'), 'cosine')} FROM u2 JOIN ct p ON p.sample_id = a JOIN ct q ON q.sample_id = b")
def proxy_centroid_pairs(spark, d):
    return reports.pairs_of_centroids(C._samples(spark, d), "person_id", "sample_id", "sample_vector")


@query(f"WITH {C._ASSIGN} SELECT audio_id, word_id, seg_id, CASE WHEN o > 0 THEN 'overlap' WHEN seg_id IS NOT NULL THEN 'nearest' ELSE 'none' END AS how FROM pk")
def asr_fallback_assignment(spark, d):
    words, segs = C._words_and_segments(spark, d)
    return intervals.assign_points(words, segs, tolerance=None, bin_s=86_400.0).select("audio_id", "word_id", "seg_id", "how")


@query(f"WITH {C._FUSE} SELECT count(*) > 0 AS usable FROM fu WHERE a1 IS NOT NULL AND t1 IS NOT NULL")
def comparison_usable(spark, d):
    return reports.has_comparable(C._fused(spark, d))


@query(f"WITH {A.SEG} SELECT audio_id, seg_id, {R('abs((end_s - start_s) / 60 - seg_id % 9)', 'gap_min')} FROM seg")
def metadata_duration_check(spark, d):
    s = A.segments(spark, d).withColumn("seconds", F.col("end_s") - F.col("start_s")).withColumn("minutes", (F.col("seg_id") % 9).cast("double"))
    return reports.duration_gap(s, "seconds", "minutes").select("audio_id", "seg_id", "gap_min")


_PAIR_SUMMARY = f"""{C._IMPOSTOR}, pr AS (SELECT 1 AS y, {C._cos('va', 'vb')} AS s FROM g UNION ALL SELECT 0, {C._cos('x.v', 'z.v')} FROM im JOIN vec x ON x.sample_id = a JOIN vec z ON z.sample_id = b),
pe AS (SELECT person_id, count(*) >= 3 AND sum(seconds) >= 10 AS ok FROM (SELECT person_id, audio_key, sum(seconds) AS seconds FROM vec GROUP BY ALL) GROUP BY 1),
cf AS (SELECT count(*) AS n, count(*) FILTER (s >= {THRESHOLD} AND y = 1) AS tp, count(*) FILTER (s >= {THRESHOLD} AND y = 0) AS fp, count(*) FILTER (s < {THRESHOLD} AND y = 1) AS fn, count(*) FILTER (s < {THRESHOLD} AND y = 0) AS tn FROM pr),
rs AS (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS r FROM pr), au AS (SELECT count(*) FILTER (y = 1) AS p, count(*) FILTER (y = 0) AS q, sum(r) FILTER (y = 1) AS r FROM rs)"""
_PAIR_METRICS = {
    "segments": "(SELECT count(*) FROM vec)", "samples": "(SELECT count(*) FROM (SELECT DISTINCT person_id, audio_key FROM vec))", "persons": "(SELECT count(*) FROM pe)", "eligible_persons": "(SELECT count(*) FROM pe WHERE ok)", "pairs": "(SELECT n FROM cf)",
    "accuracy": "(SELECT (tp + tn) / n FROM cf)", "precision": "(SELECT coalesce(tp / nullif(tp + fp, 0), 0) FROM cf)", "recall": "(SELECT coalesce(tp / nullif(tp + fn, 0), 0) FROM cf)", "f1": "(SELECT coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) FROM cf)",
    "auc": "(SELECT (r - p * (p + 1) / 2.0) / (p * q) FROM au)",
}


@query(f"WITH {_PAIR_SUMMARY} " + " UNION ALL ".join(f"SELECT '{k}' AS metric, {R(v, 'value')}" for k, v in _PAIR_METRICS.items()))
def pairwise_verification_summary(spark, d):
    s = C._samples(spark, d)
    return reports.pairwise_summary(A.vectors(spark, d), s, voiceprint.eligible(s, min_samples=3, min_seconds=10.0), C._pairs(spark, d), THRESHOLD)


_OPEN = {
    "samples": "(SELECT count(*) FROM vec)", "persons": "(SELECT count(*) FROM ps)", "profiles": "(SELECT count(*) FROM pf)", "identification_rate": "(SELECT count(*) FILTER (known AND ok) / count(*) FILTER (known) FROM de)",
    "unknown_rejection_rate": "(SELECT 1 - count(*) FILTER (NOT known AND yes) / count(*) FILTER (NOT known) FROM de)", "overall_accuracy": "(SELECT count(*) FILTER (ok) / count(*) FROM de)", "threshold": "0.3",
}


@query(f"WITH {C._FOUND}, de AS (SELECT *, s >= 0.3 AS yes, CASE WHEN known THEN s >= 0.3 AND best = truth ELSE s < 0.3 END AS ok FROM fd) " + " UNION ALL ".join(f"SELECT '{k}' AS metric, {R(v, 'value')}" for k, v in _OPEN.items()))
def open_set_final_summary(spark, d):
    v = A.vectors(spark, d)
    metrics = evaluation.open_set_metrics(voiceprint.open_set_decisions(C._found(spark, d), C._known(spark, d), THRESHOLD))
    return reports.open_set_summary(v, v.select("person_id").distinct(), C._profiles(spark, d), metrics, THRESHOLD)


_RELABELLED = f"{C._PARTS}, {C._centre('audio_key, person_id', 'en')}, di AS (SELECT sample_id, pf.person_id AS name, 1 - {C._cos('v', 'profile')} AS d FROM u JOIN pf ON u.audio_key = pf.audio_key), rk AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY d, name) AS rn, lead(d) OVER (PARTITION BY sample_id ORDER BY d, name) AS d2 FROM di), rl AS (SELECT u.audio_key, u.person_id, d2 - d AS margin, CASE WHEN d IS NULL OR d2 - d < 0.01 THEN u.person_id ELSE name END AS final FROM u LEFT JOIN rk USING (sample_id) WHERE rn IS NULL OR rn = 1)"


@query(f"WITH {_RELABELLED} SELECT audio_key, count(*) AS n_segments, count(*) FILTER (final <> person_id) AS n_changed, {R('avg(CAST(final <> person_id AS INT))', 'share_changed')}, {R('avg(margin)', 'mean_margin')}, {R('quantile_cont(margin, 0.5)', 'median_margin')}, {R('max(margin)', 'max_margin')} FROM rl GROUP BY audio_key")
def relabel_summary_by_audio(spark, d):
    c = mean_vectors(C._uses(spark, d).filter("use = 'enrolment'").withColumn("u", unit(F.col("v"))), ["audio_key", "person_id"], "u").withColumnRenamed("person_id", "speaker")
    q = A.vectors(spark, d).select("audio_key", "sample_id", F.col("person_id").alias("speaker"), "v")
    return reports.relabel_summary(voiceprint.nearest_centroid(q, c, ["audio_key"], tie="sample_id"), ["audio_key"])


@query(f"WITH {A.TXT}, p AS (SELECT audio_id, role, CASE WHEN seg_id % 3 = 0 THEN 'CLIENT' ELSE role END AS guess FROM txt WHERE role IS NOT NULL) SELECT audio_id, count(*) FILTER (role = 'AGENT' AND guess = 'AGENT') AS AGENT_as_AGENT, count(*) FILTER (role = 'AGENT' AND guess = 'CLIENT') AS AGENT_as_CLIENT, count(*) FILTER (role = 'CLIENT' AND guess = 'AGENT') AS CLIENT_as_AGENT, count(*) FILTER (role = 'CLIENT' AND guess = 'CLIENT') AS CLIENT_as_CLIENT, {R('avg(CAST(role = guess AS INT))', 'accuracy')} FROM p GROUP BY audio_id")
def per_call_role_accuracy(spark, d):
    t = A.transcripts(spark, d).withColumn("guess", F.when(F.col("seg_id") % 3 == 0, F.when(F.col("role").isNotNull(), "CLIENT")).otherwise(F.col("role")))
    return reports.per_call_accuracy(t, ["audio_id"], "role", "guess")


_MEASURES = ("arousal", "tension", "intensity", "calm")


@query(f"WITH {C._PROS}, ca AS (SELECT count(*) AS n FROM seg WHERE end_s - start_s BETWEEN 0.5 AND 30) SELECT (SELECT count(*) FROM seg) AS n_segments, (SELECT n FROM ca) AS n_candidates, count(*) AS n_scored, count(*) FILTER (ok) AS n_ok, count(DISTINCT audio_id) AS n_audios, count(DISTINCT event_type) AS n_roles, " + ", ".join(f"{R(f'avg({m})', f'mean_{m}_proxy_score')}, {R(f'quantile_cont({m}, 0.5)', f'median_{m}_proxy_score')}" for m in _MEASURES) + ", (SELECT prosodic_state FROM st GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS most_common_label, (SELECT count(*) FROM st GROUP BY prosodic_state ORDER BY 1 DESC LIMIT 1) AS most_common_n FROM st")
def prosody_run_summary(spark, d):
    s = A.segments(spark, d)
    fit = prosody.candidates(s.withColumn("overlap_ratio", F.lit(0.0)).withColumn("rms", F.lit(0.0)), need_role=False)
    return reports.prosody_summary(s, fit, C._prosodic(spark, d), F.col("event_type") != "error", "audio_id", "event_type", [f"{m}_proxy_score" for m in _MEASURES], "prosodic_state")


@query(f"WITH {C._DIS}, bo AS (SELECT * FROM fu WHERE a1 IS NOT NULL AND t1 IS NOT NULL) SELECT 'segments' AS metric, {R('count(*)', 'value')} FROM fu UNION ALL SELECT 'comparable', {R('count(*)', 'value')} FROM bo UNION ALL SELECT 'pearson_tension_proxy_score', {R('corr(tension, t1)', 'value')} FROM bo UNION ALL SELECT 'pearson_arousal_proxy_score', {R('corr(arousal, t1)', 'value')} FROM bo UNION ALL SELECT 'pct_masked_frustration', {R('round(100 * avg(CAST(t1 >= 0 AND neg AS INT)), 2)', 'value')} FROM di")
def fusion_run_summary(spark, d):
    fused = C._fused(spark, d)  # once: each call reads medians and percentiles of all features anew
    both = fusion.comparable(fused)
    pairs = fusion.correlations(both, [("tension_proxy_score", "t1"), ("arousal_proxy_score", "t1")])
    return reports.fusion_summary(fused, pairs, C._disagreed(both))


_OKS = "comb >= 0.2 AND cosine >= 0.1 AND cont >= 0.05 AND margin >= 0.001"
_PROXY = {
    "audios_diarized": "(SELECT count(DISTINCT audio_id) FROM txt)", "segments_diarized": "(SELECT count(*) FROM txt)", "segments_with_text": "(SELECT count(*) FROM txt WHERE trim(text) <> '')", "audios_with_official_turns": "(SELECT count(DISTINCT audio_id) FROM tt)",
    "official_turns": "(SELECT count(*) FROM tt)", "alignment_candidates": "(SELECT count(*) FROM al)", "accepted_matches": f"(SELECT count(*) FROM al WHERE {_OKS})", "audios_with_accepted_matches": f"(SELECT count(DISTINCT audio_id) FROM al WHERE {_OKS})",
    "speakers_with_accepted_matches": f"(SELECT count(DISTINCT (audio_id, win % 2)) FROM al WHERE {_OKS})", "strict_mappings": f"(SELECT count(DISTINCT audio_id) FROM al WHERE {_OKS} AND win % 2 = 0)", "aggregated_mappings": "(SELECT count(*) FROM (SELECT DISTINCT audio_id, role FROM txt WHERE role IS NOT NULL))",
    "audios_labeled": "(SELECT count(DISTINCT audio_id) FROM txt WHERE role IS NOT NULL)", "segments_labeled": "(SELECT count(*) FROM txt WHERE role IS NOT NULL)",
}


@query(f"WITH {C._TFIDF} " + " UNION ALL ".join(f"SELECT '{k}' AS metric, {R(v, 'value')}" for k, v in _PROXY.items()))
def textual_proxy_summary(spark, d):
    t, al = A.transcripts(spark, d), C._aligned(spark, d)
    ok = al.filter("accepted").withColumn("speaker", F.col("window") % 2)
    strict = ok.filter("speaker = 0").select("audio_id").distinct()
    mapping = t.filter("role IS NOT NULL").select("audio_id", "role").distinct()
    return reports.proxy_summary(t, t.filter("role = 'CLIENT'"), al, ok, strict, mapping, t.withColumn("proxy_role", F.col("role")))


_SIDES = f"""{A.TXT}, sd AS (SELECT audio_id, coalesce(string_agg(text, ' ' ORDER BY seg_id) FILTER (role = 'CLIENT'), '') AS a, coalesce(string_agg(text, ' ' ORDER BY seg_id) FILTER (role = 'AGENT'), '') AS b FROM txt GROUP BY 1),
ids AS (SELECT audio_id, 'a' AS id, a AS text FROM sd UNION ALL SELECT audio_id, 'b', b FROM sd),
wd AS (SELECT audio_id, id, ' ' || w || ' ' AS w FROM (SELECT audio_id, id, unnest(string_split(trim(regexp_replace(regexp_replace(strip_accents(lower(text)), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g')), ' ')) AS w FROM ids) WHERE w <> ''),
gr AS (SELECT audio_id, id, substr(w, i, n) AS gram FROM (SELECT audio_id, id, w, n, unnest(range(1, length(w) - n + 2)) AS i FROM wd, (VALUES (3), (4), (5)) v(n) WHERE length(w) >= n)),
tf AS (SELECT audio_id, id, gram, count(*) AS tf FROM gr GROUP BY ALL), df AS (SELECT audio_id, gram, count(*) AS df FROM tf GROUP BY ALL), w1 AS (SELECT tf.*, tf * (ln(3 / (1 + df)) + 1) AS w FROM tf JOIN df USING (audio_id, gram)),
l AS (SELECT audio_id, id, sqrt(sum(w * w)) AS len FROM w1 GROUP BY ALL), ww AS (SELECT w1.audio_id, w1.id, gram, w / len AS w FROM w1 JOIN l USING (audio_id, id)),
co AS (SELECT x.audio_id, sum(x.w * y.w) AS c FROM ww x JOIN ww y ON x.audio_id = y.audio_id AND x.gram = y.gram AND x.id = 'a' AND y.id = 'b' GROUP BY 1),
tk AS (SELECT audio_id, a, b, {A.tokens_sql('a', X.STOPWORDS)} AS x, {A.tokens_sql('b', X.STOPWORDS)} AS y FROM sd),
sc AS (SELECT tk.audio_id, a, b, coalesce(c, 0.0) AS c, CASE WHEN len(x) = 0 OR len(y) = 0 THEN 0.0 ELSE len(list_intersect(x, y)) / least(len(x), len(y)) END AS k FROM tk LEFT JOIN co USING (audio_id))"""


@query(f"WITH {_SIDES} SELECT audio_id, {R('c', 'cosine')}, {R('k', 'containment')}, {R('CASE WHEN trim(a) = ' + repr('') + ' OR trim(b) = ' + repr('') + ' THEN 0.0 ELSE CAST(0.55 AS DOUBLE) * c + CAST(0.45 AS DOUBLE) * k END', 'score')} FROM sc")
def text_pair_score(spark, d):
    t = A.transcripts(spark, d)
    text = lambda role: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == role, F.struct("seg_id", "text")))), lambda x: x["text"]), " ")
    return reports.text_pair_scores(t.groupBy("audio_id").agg(text("CLIENT").alias("a"), text("AGENT").alias("b")), "audio_id", "a", "b")


_PAIRED = f"""{C._EVID}, ot AS (SELECT audio_id, role, trim(string_agg(trim(text), ' ' ORDER BY seg_id)) AS rt FROM txt WHERE role IS NOT NULL AND audio_id % 7 > 0 GROUP BY ALL), oc AS (SELECT audio_id, count(*) AS k, min(length(rt)) AS least FROM ot GROUP BY 1),
pr AS (SELECT ev.audio_id, speaker, role, ev.audio_id || '|' || speaker || '|' || role AS pair, evidence_text AS a, rt AS b, n_words, seconds, n_rows FROM ev JOIN ot USING (audio_id) JOIN oc USING (audio_id) WHERE k = 2 AND least > 0),
ids AS (SELECT pair, 'a' AS id, a AS text FROM pr UNION ALL SELECT pair, 'b', b FROM pr),
wd AS (SELECT pair, id, ' ' || w || ' ' AS w FROM (SELECT pair, id, unnest(string_split(trim(regexp_replace(regexp_replace(strip_accents(lower(text)), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g')), ' ')) AS w FROM ids) WHERE w <> ''),
gr AS (SELECT pair, id, substr(w, i, n) AS gram FROM (SELECT pair, id, w, n, unnest(range(1, length(w) - n + 2)) AS i FROM wd, (VALUES (3), (4), (5)) v(n) WHERE length(w) >= n)),
tf AS (SELECT pair, id, gram, count(*) AS tf FROM gr GROUP BY ALL), df AS (SELECT pair, gram, count(*) AS df FROM tf GROUP BY ALL), w1 AS (SELECT tf.*, tf * (ln(3 / (1 + df)) + 1) AS w FROM tf JOIN df USING (pair, gram)),
l AS (SELECT pair, id, sqrt(sum(w * w)) AS len FROM w1 GROUP BY ALL), ww AS (SELECT w1.pair, w1.id, gram, w / len AS w FROM w1 JOIN l USING (pair, id)), co AS (SELECT x.pair, sum(x.w * y.w) AS c FROM ww x JOIN ww y ON x.pair = y.pair AND x.gram = y.gram AND x.id = 'a' AND y.id = 'b' GROUP BY 1),
tk AS (SELECT pr.*, {A.tokens_sql('a', X.STOPWORDS)} AS x, {A.tokens_sql('b', X.STOPWORDS)} AS y FROM pr),
sc AS (SELECT tk.*, CASE WHEN trim(a) = '' OR trim(b) = '' THEN 0.0 ELSE CAST(0.55 AS DOUBLE) * coalesce(c, 0.0) + CAST(0.45 AS DOUBLE) * CASE WHEN len(x) = 0 OR len(y) = 0 THEN 0.0 ELSE len(list_intersect(x, y)) / least(len(x), len(y)) END END AS s FROM tk LEFT JOIN co USING (pair)),
s1 AS (SELECT audio_id, speaker, n_words, seconds, n_rows, max(CASE WHEN role = 'AGENT' THEN s END) AS a, max(CASE WHEN role = 'CLIENT' THEN s END) AS c FROM sc GROUP BY ALL),
s2 AS (SELECT *, row_number() OVER (PARTITION BY audio_id ORDER BY n_words DESC, seconds DESC, n_rows DESC, speaker) AS rn FROM s1),
s3 AS (SELECT audio_id, max(CASE WHEN rn = 1 THEN speaker END) AS x, max(CASE WHEN rn = 2 THEN speaker END) AS y, coalesce(max(CASE WHEN rn = 1 THEN a END), 0) + coalesce(max(CASE WHEN rn = 2 THEN c END), 0) AS st, coalesce(max(CASE WHEN rn = 1 THEN c END), 0) + coalesce(max(CASE WHEN rn = 2 THEN a END), 0) AS cr FROM s2 WHERE rn <= 2 GROUP BY audio_id)"""


@query(f"WITH {_PAIRED} SELECT audio_id, CASE WHEN round(st - cr, 9) >= 0 THEN x ELSE y END AS agent_speaker, {R('greatest(st, cr)', 'pair_score')}, {R('greatest(st, cr) - least(st, cr)', 'pair_margin')}, CASE WHEN y IS NULL THEN 'less_than_two_speakers_with_evidence' WHEN greatest(st, cr) < 0.1 THEN 'rejected_low_aggregate_score' WHEN greatest(st, cr) - least(st, cr) < 0.01 THEN 'assigned_low_margin_aggregate_text' ELSE 'accepted_speaker_role' END AS status FROM s3 UNION ALL SELECT audio_id, NULL, NULL, NULL, CASE WHEN coalesce(k, 0) < 2 THEN 'missing_both_official_roles' ELSE 'empty_official_role_text' END FROM (SELECT DISTINCT audio_id FROM ev) LEFT JOIN oc USING (audio_id) WHERE coalesce(k, 0) < 2 OR least = 0")
def role_audit_by_text(spark, d):
    """Speakers mapped by the texts of their evidence; a seventh of the calls counts as without official turns, so that all statuses are there."""
    t = A.transcripts(spark, d)
    turns = t.filter("role IS NOT NULL AND audio_id % 7 > 0").select("audio_id", "role", F.col("seg_id").alias("turn"), F.col("text").alias("turn_text"))
    return roles.role_audit(C._evidence(spark, d), turns, "audio_id").select("audio_id", "agent_speaker", "pair_score", "pair_margin", "status")


_LONG_NAMES = f"{C._NAMES}, n2 AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN name WHEN 1 THEN 'raw_bajas_raw_' || page_id || '_WHISPER_words.CSV' ELSE 'comercial_' || page_id || '_clean_whisper_asr_segments.mp3' END AS name FROM nm)"


@query(f"WITH {_LONG_NAMES} SELECT page_id, " + C._nested(C._BASE, r"(?i)\.(csv|wav|mp3|flac)$", *[f"(?i){s}$" for s in N.TRANSCRIPTION_SUFFIXES], f"^({'|'.join(N.ALL_PREFIXES)})+") + " AS id FROM n2")
def transcription_ids(spark, d):
    p, k = F.col("page_id").cast("string"), F.col("page_id") % 3
    name = F.when(k == 0, F.col("name")).when(k == 1, F.concat(F.lit("raw_bajas_raw_"), p, F.lit("_WHISPER_words.CSV"))).otherwise(F.concat(F.lit("comercial_"), p, F.lit("_clean_whisper_asr_segments.mp3")))
    return C._names(spark, d).select("page_id", N.transcription_id(name).alias("id"))


@query(rf"WITH {A.TXT} SELECT audio_id, seg_id, md5(trim(regexp_replace(regexp_replace(array_to_string(list_transform(string_split(text, ' '), lambda w: ' ' || w || ' ,'), ''), '\s+', ' ', 'g'), ' ([,.;:!?])', '\1', 'g'))) AS text_md5 FROM txt")
def joined_words_text(spark, d):
    words = F.transform(F.split("text", " "), lambda w: F.concat(F.lit(" "), w, F.lit(" ,")))
    return A.transcripts(spark, d).select("audio_id", "seg_id", F.md5(X.joined_words(words)).alias("text_md5"))


@query(f"SELECT c_custkey, {R('coalesce(TRY_CAST(CASE c_custkey % 3 WHEN 0 THEN c_name ELSE CAST(c_acctbal AS VARCHAR) END AS DOUBLE), -1)', 'number')} FROM customer")
def tolerant_numbers(spark, d):
    raw = F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")).otherwise(F.col("c_acctbal").cast("string"))
    return A.table(spark, d, "customer").select("c_custkey", nulls.safe_float(raw, -1.0).alias("number"))


@query(f"WITH {A.VEC} SELECT sample_id, {R('CAST(v[1] AS FLOAT)', 'emb_0000')}, {R('CAST(v[64] AS FLOAT)', 'emb_0063')}, true AS back FROM vec")
def embedding_wide_and_back(spark, d):
    wide = summaries.wide_vectors(A.vectors(spark, d).select("sample_id", "v"), "v", 64)
    back = summaries.narrow_vectors(wide, into="back").join(A.vectors(spark, d).select("sample_id", "v"), "sample_id").select("sample_id", (F.col("back") == F.col("v").cast("array<float>")).alias("back"))
    return wide.select("sample_id", F.col("emb_0000").cast("double"), F.col("emb_0063").cast("double")).join(back, "sample_id")


@query(f"WITH {A.TXT}, r AS (SELECT audio_id || '/' || seg_id AS uid, 1 AS attempt, 'old' AS result FROM txt UNION ALL SELECT audio_id || '/' || seg_id, 2, label FROM txt WHERE seg_id % 2 = 0), n AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY uid ORDER BY attempt DESC) = 1) SELECT audio_id, seg_id, attempt::BIGINT AS attempt, result FROM txt LEFT JOIN n ON uid = audio_id || '/' || seg_id AND seg_id % 3 > 0")
def newest_result_join(spark, d):
    uid = F.concat_ws("/", F.col("audio_id").cast("string"), F.col("seg_id").cast("string"))
    t = A.transcripts(spark, d).withColumn("uid", uid)
    first = t.select("uid", F.lit(1).alias("attempt"), F.lit("old").alias("result"))
    both = first.unionByName(t.filter("seg_id % 2 = 0").select("uid", F.lit(2).alias("attempt"), F.col("label").alias("result")))
    keyed = t.withColumn("uid", F.when(F.col("seg_id") % 3 > 0, F.col("uid")))
    return sentiment.merged_results(keyed, both, "uid", F.col("attempt")).select("audio_id", "seg_id", "attempt", "result")


@query("WITH i AS (SELECT c_nationkey, c_custkey % 5 AS shelf, c_custkey FROM customer WHERE c_acctbal > 0 QUALIFY row_number() OVER (PARTITION BY c_nationkey, c_custkey % 5 ORDER BY c_custkey) = 1) SELECT s_suppkey, c_custkey FROM supplier LEFT JOIN i ON s_nationkey = c_nationkey AND s_suppkey % 5 = shelf")
def inventory_metadata_join(spark, d):
    inventory = A.table(spark, d, "customer").filter("c_acctbal > 0").select(F.col("c_nationkey").alias("nation"), (F.col("c_custkey") % 5).alias("shelf"), "c_custkey")
    left = A.table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("nation"), (F.col("s_suppkey") % 5).alias("shelf"))
    return reports.with_metadata(left, inventory, ["nation", "shelf"], ["c_custkey"]).select("s_suppkey", "c_custkey")


@query(f"WITH {A.TXT}, r AS (SELECT audio_id, seg_id, speaker, round(start_s, 3) AS a, round(end_s, 3) AS b, min(label) AS result, arg_min(n_words, label) AS words FROM (SELECT * FROM txt WHERE seg_id % 2 = 0 UNION ALL SELECT * REPLACE ('zz' AS label) FROM txt WHERE seg_id % 4 = 0) GROUP BY ALL) SELECT t.audio_id, t.seg_id, result, coalesce(words >= 2, false) AS eligible FROM txt t LEFT JOIN r ON t.audio_id = r.audio_id AND t.seg_id = r.seg_id AND t.speaker IS NOT DISTINCT FROM r.speaker AND round(t.start_s, 3) = a AND round(t.end_s, 3) = b")
def text_base_join(spark, d):
    t = A.transcripts(spark, d)
    keys = ["audio_id", "seg_id", "speaker"]
    side = lambda df: df.select(*keys, (F.col("start_s") + 0.0001).alias("start_s"), (F.col("end_s") + 0.0001).alias("end_s"), "n_words", F.col("label").alias("result"))
    right = side(t.filter("seg_id % 2 = 0")).unionByName(side(t.filter("seg_id % 4 = 0").withColumn("label", F.lit("zz"))))
    return reports.text_base(t.select(*keys, "start_s", "end_s"), right, keys).select("audio_id", "seg_id", "result", "eligible")


@query(f"WITH {A.VEC}, x AS (SELECT sample_id, audio_key, CASE WHEN audio_key % 5 = 0 THEN NULL WHEN person_id % 2 = 0 THEN 'AGENT' ELSE 'CLIENT' END AS role, CASE WHEN audio_key % 5 = 0 OR person_id % 2 = 1 AND audio_key % 3 = 0 THEN NULL WHEN person_id % 2 = 0 THEN 'a' || audio_key % 7 ELSE 'c' || audio_key END AS person FROM vec) SELECT role, count(*) AS n_segments, count(person) AS n_with_person, count(DISTINCT audio_key) AS n_audios, count(DISTINCT person) AS n_persons FROM x GROUP BY role")
def role_person_coverage(spark, d):
    v = A.vectors(spark, d).withColumn("speaker", F.col("person_id") % 2)
    k = F.col("audio_key")
    mapping = v.filter(k % 5 > 0).select("audio_key", "speaker", F.when(F.col("speaker") == 0, " agent ").otherwise("client").alias("role"), F.concat(F.lit("a"), (k % 7).cast("string")).alias("agent_hash"), F.when(k % 3 == 0, "nan").otherwise(F.concat(F.lit("c"), k.cast("string"))).alias("customer_hash"))
    return reports.role_coverage(reports.with_person(v, mapping, ["audio_key", "speaker"]), "audio_key")


@query("WITH m AS (SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1) SELECT c_custkey, o_orderkey FROM customer LEFT JOIN m ON c_custkey = o_custkey")
def mapping_metadata_join(spark, d):
    orders = A.table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    return reports.with_metadata(A.table(spark, d, "customer").select("c_custkey"), orders, ["c_custkey"], ["o_orderkey"])


@query(f"WITH {C._ISLES}, gp AS (SELECT audio_id, seg_id, first_value(seg_id) OVER (PARTITION BY audio_id, run, island ORDER BY start_s, end_s, seg_id) AS merge_id, event_type FROM o4) SELECT audio_id, seg_id, merge_id, true AS in_merged, event_type = 'click' AS in_clicks, event_type <> 'error' AS in_final FROM gp")
def segment_validation_table(spark, d):
    s = A.segments(spark, d)
    merged = intervals.merge_adjacent(s, max_gap=C.GAP)
    ids = merged.withColumn("merged_ids", F.array_join(F.transform("merged_ids", lambda x: x.cast("string")), ",")) if dict(merged.dtypes)["merged_ids"].startswith("array") else merged
    out = reports.validation_table(s.select("audio_id", "seg_id"), ids, {"clicks": s.filter("event_type = 'click'"), "final": s.filter("event_type <> 'error'")}, ["audio_id"])
    return out.select("audio_id", "seg_id", "merge_id", "in_merged", "in_clicks", "in_final")


@query("WITH u AS (SELECT * FROM orders WHERE o_totalprice > 1000) SELECT o_custkey, o_orderkey FROM u QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) = 1")
def consolidated_canonical_rows(spark, d):
    o = A.table(spark, d, "orders")
    shards = [o.filter("o_orderstatus = 'F'"), o.filter("o_orderstatus <> 'F'")]
    return reports.consolidated(shards, F.col("o_totalprice") > 1000, ["o_custkey"], [F.desc("o_orderdate"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey")


@query(f"WITH {A.SEG} SELECT event_type, seg_id FROM seg QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY sha256('sample|' || seg_id), seg_id) <= 25")
def sample_by_group(spark, d):
    return reports.sampled_by(A.segments(spark, d), "event_type", "seg_id", 25).select("event_type", "seg_id")


@query(f"WITH {C._PROS} SELECT audio_id, seg_id, {R('arousal', 'arousal_score')}, {R('coalesce(CASE WHEN seg_id % 2 = 0 THEN 0.5 END, tension)', 'tension_score')} FROM st")
def compatibility_aliases(spark, d):
    p = C._prosodic(spark, d).withColumn("tension_score", F.when(F.col("seg_id") % 2 == 0, 0.5))
    return reports.with_aliases(p, {"arousal_score": "arousal_proxy_score", "tension_score": "tension_proxy_score", "ser_label": "ser_pred_label"}).select("audio_id", "seg_id", "arousal_score", "tension_score")


@query(f"WITH {A.TXT} SELECT audio_id, seg_id, md5({A.normal_sql('text')}) AS norm_md5, n_words FROM txt")
def normalised_transcripts(spark, d):
    return A.transcripts(spark, d).select("audio_id", "seg_id", F.md5(X.normalize_text(F.col("text"))).alias("norm_md5"), "n_words")


@query(f"WITH {A.VEC} SELECT sample_id, vec.audio_key, c_name FROM vec LEFT JOIN customer ON c_custkey = vec.audio_key")
def renamed_key_join(spark, d):
    c = A.table(spark, d, "customer").select(F.col("c_custkey").alias("audio_key"), "c_name")
    return matching.null_safe_join(A.vectors(spark, d).select("sample_id", "audio_key"), c, ["audio_key"])


_STEM2 = C._nested("regexp_extract(trim(name), '([^/]*)$', 1)", r"(?i)\.wav$", "(?i)_clean$")


@query(f"WITH {C._NAMES}, s AS (SELECT page_id, {_STEM2} AS stem FROM nm), b AS (SELECT *, CASE WHEN starts_with(stem, 'raw_bajas_') THEN 'raw_bajas' WHEN starts_with(stem, 'raw_') THEN 'raw' END AS source, regexp_replace(trim(stem), '^(raw_bajas_|raw_)', '') AS base FROM s) SELECT page_id, stem, source, base, array_to_string(list_sort(list_distinct(list_filter([stem, base, source || '_' || base], lambda v: v IS NOT NULL AND trim(v) <> ''))), '|') AS variants FROM b")
def metadata_keys(spark, d):
    name = F.col("name")
    source = N.metadata_source(name)
    stem = N.metadata_stem(name)
    return C._names(spark, d).select("page_id", stem.alias("stem"), source.alias("source"), N.without_source(stem).alias("base"), F.array_join(N.metadata_variants(name, source), "|").alias("variants"))


@query(f"WITH {C._NAMES}, x AS (SELECT page_id, name, CASE page_id % 5 WHEN 0 THEN ' NaN ' WHEN 1 THEN '  ' WHEN 2 THEN '<NA>' ELSE ' ' || page_id || '.0 ' END AS raw FROM nm) SELECT page_id, regexp_replace(regexp_extract(trim(name), '([^/]*)$', 1), '(.)\\.[^.]*$', '\\1') AS file_key, CASE WHEN lower(trim(raw)) IN ('', 'nan', 'none', '<na>') THEN NULL ELSE trim(raw) END AS identifier, regexp_replace(trim(raw), '\\.0$', '') AS normal FROM x")
def identifier_keys(spark, d):
    k = F.col("page_id") % 5
    raw = F.when(k == 0, " NaN ").when(k == 1, "  ").when(k == 2, "<NA>").otherwise(F.concat(F.lit(" "), F.col("page_id").cast("string"), F.lit(".0 ")))
    x = C._names(spark, d).withColumn("raw", raw)
    return x.select("page_id", N.file_key(F.col("name")).alias("file_key"), nulls.first_text(F.col("raw")).alias("identifier"), F.regexp_replace(F.trim("raw"), "\\.0$", "").alias("normal"))


@query(f"WITH {C._SCORED}, rk AS (SELECT *, row_number() OVER (PARTITION BY audio_id, speaker ORDER BY len_s DESC, rms DESC, overlap_ratio, start_s, seg_id) AS anchor_rank FROM sc WHERE len(ar) = 0), {A.VEC}, {C._UNIT}, an AS (SELECT audio_id, speaker, un FROM rk JOIN u ON u.sample_id = seg_id WHERE anchor_rank <= 3), {C._centre('audio_id, speaker', 'an')}, cn AS (SELECT audio_id, speaker, count(*) AS n_vectors FROM an GROUP BY ALL) SELECT audio_id, speaker, n_vectors, {R('profile[1]', 'first_component')}, {R('profile[64]', 'last_component')} FROM pf JOIN cn USING (audio_id, speaker)")
def anchor_centroids(spark, d):
    v = A.vectors(spark, d).select(F.col("sample_id").alias("seg_id"), "v")
    c = reports.anchor_centroids(intervals.anchors(C._scored(spark, d)), v, ["audio_id"])
    return c.select("audio_id", "speaker", "n_vectors", F.get("centroid", F.lit(0)).alias("first_component"), F.get("centroid", F.lit(63)).alias("last_component"))


@query(f"WITH {C._SCORED}, o AS (SELECT count(*) AS n, sum(b - a) AS s FROM ovl) SELECT (SELECT count(DISTINCT audio_id) FROM sc) AS n_recordings, (SELECT count(*) FROM sc) AS n_segments, (SELECT count(*) FROM sc WHERE len(dr) = 0) AS n_valid_export, (SELECT count(*) FROM sc WHERE len(ar) = 0) AS n_valid_anchor, (SELECT n FROM o) AS n_regions, {R('(SELECT coalesce(s, 0) FROM o)', 'region_s')}")
def diarization_run_totals(spark, d):
    return reports.run_totals(summaries.recording_summary(C._scored(spark, d), intervals.overlap_regions(A.segments(spark, d)), ["audio_id"]))
