"""Named queries over the bundled tables, each an application of operators, with the same in SQL.

Doubles are rounded to six digits on both sides, since sums depend on the order of rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.functions import labels as L
from parlance.functions import names as N
from parlance.functions import text as X
from parlance.functions.vectors import mean_vectors, unit
from parlance.operators import audits, evaluation, fusion, intervals, keywords, matching, prosody, roles, sentiment, summaries, textjoin, voiceprint
from parlance.plans import adapters as A

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

#: A small lexicon whose keywords are in the bundled texts; a full one is loaded by ``keywords.load_lexicon``.
LEXICON: keywords.Lexicon = {
    "baja_cancelacion": ["cion", "mente"], "facturacion_cobros": ["que", "por"], "incidencia_tecnica": ["tion", "with"], "reclamacion_queja": ["heit", "keit"],
    "insatisfaccion_urgencia": ["eaux"], "fraude_seguridad": ["erst"], "retencion_comercial": ["ble"], "espera_derivacion": ["ing"],
    "instalacion_citas": ["zu"], "alta_contratacion": ["from"], "gestion_administrativa": ["elle", "avec"], "vulnerabilidad_impacto": ["ich"],
}
GAP = 3600.0
THRESHOLDS = (0.0, 0.01, 0.03, 0.05, 0.1, 0.15, 0.2, 0.3)


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six digits, without a negative zero; the tiny summand parts values that lie between two of them."""
    return df.select(*[(F.round(F.col(c) + 1e-9, 6) + 0.0).alias(c) if t == "double" else F.col(c).cast("long").alias(c) if t == "int" else F.col(c) for c, t in df.dtypes])


def R(expr: str, name: str) -> str:
    return f"round(CAST({expr} AS DOUBLE) + CAST(1e-9 AS DOUBLE), 6) + 0.0 AS {name}"


def query(sql: str | None = None):
    """Register a query under its name, with its SQL."""

    def wrap(f: Query) -> Query:
        QUERIES[f.__name__] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return wrap


# --- themes ---------------------------------------------------------------------------------------


def _spotted(spark: SparkSession, d: str) -> DataFrame:
    return keywords.spotted(A.transcripts(spark, d), LEXICON)


def _kw(theme: str) -> str:
    ks = sorted(set(LEXICON[theme]))
    return f"list_filter({ks!r}, lambda k: contains(norm, k))"


_SPOT = f"{A.TXT}, n AS (SELECT *, {A.normal_sql('text')} AS norm FROM txt), kw AS (SELECT *, {', '.join(f'len({_kw(t)}) AS c_{t}' for t in LEXICON)} FROM n), k2 AS (SELECT *, {' + '.join(f'c_{t}' for t in LEXICON)} AS total, {' + '.join(f'CAST(c_{t} > 0 AS BIGINT)' for t in LEXICON)} AS themes FROM kw)"
_CALLS = (
    f"{_SPOT}, calls AS (SELECT audio_id, count(*) AS n_segments, count(*) FILTER (themes > 0) AS n_critical, sum(total) AS total_matches, {', '.join(f'sum(c_{t}) AS m_{t}' for t in LEXICON)}, round(count(*) FILTER (themes > 0) / count(*), 4) AS pct_critical,"
    f" {' + '.join(f'max(CAST(c_{t} > 0 AS INT))' for t in LEXICON)} AS n_themes, list_filter([{', '.join(f'CASE WHEN max(c_{t}) > 0 THEN {t!r} END' for t in LEXICON)}], lambda x: x IS NOT NULL) AS theme_list FROM k2 GROUP BY 1),"
    " scored AS (SELECT *, 3 * pct_critical + ln(1 + CAST(total_matches AS DOUBLE)) + CAST(0.5 AS DOUBLE) * n_themes AS score FROM calls),"
    " ranked AS (SELECT *, round((rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0) / count(*) OVER (), 4) AS percentile FROM scored)"
)


def _calls(spark: SparkSession, d: str) -> DataFrame:
    return keywords.by_call(_spotted(spark, d), LEXICON, ["audio_id"])


@query(f"WITH {_CALLS} SELECT audio_id, n_segments, n_critical, CAST(total_matches AS BIGINT) AS total_matches, CAST(n_themes AS BIGINT) AS n_themes, array_to_string(theme_list, ',') AS themes, {R('pct_critical', 'pct_critical')}, {R('score', 'score')}, {R('percentile', 'percentile')} FROM ranked ORDER BY ranked.score DESC, audio_id LIMIT 30")
def call_criticality_topk(spark, d):
    top = keywords.top_calls(_calls(spark, d), 30)
    return top.select("audio_id", "n_segments", "n_critical", "total_matches", "n_themes", F.array_join("themes", ",").alias("themes"), "pct_critical", "score", "percentile")


_THEMES = " UNION ALL ".join(f"SELECT '{t}' AS theme, count(*) AS n_segments, count(*) FILTER (c_{t} > 0) AS n_hits, CAST(sum(c_{t}) AS BIGINT) AS n_matches FROM k2" for t in LEXICON)


@query(f"WITH {_SPOT}, t AS ({_THEMES}) SELECT theme, n_segments, n_hits, n_matches, {R('round(100 * n_hits / n_segments, 2)', 'pct')} FROM t")
def theme_summary(spark, d):
    return keywords.theme_summary(_spotted(spark, d), LEXICON)


_ROLE_THEMES = " UNION ALL ".join(f"SELECT role, '{t}' AS theme, count(*) AS n, count(*) FILTER (c_{t} > 0) AS hits FROM k2 WHERE role IS NOT NULL GROUP BY role" for t in LEXICON)


@query(f"WITH {_SPOT}, t AS ({_ROLE_THEMES}) SELECT theme, {R('coalesce(max(CASE WHEN role = ' + repr('AGENT') + ' THEN round(100 * hits / n, 2) END), 0)', 'AGENT')}, {R('coalesce(max(CASE WHEN role = ' + repr('CLIENT') + ' THEN round(100 * hits / n, 2) END), 0)', 'CLIENT')} FROM t GROUP BY theme")
def theme_by_role_pivot(spark, d):
    per = keywords.theme_summary(_spotted(spark, d), LEXICON, "role")
    return per.groupBy("theme").pivot("role", ["AGENT", "CLIENT"]).agg(F.first("pct")).na.fill(0.0)


@query(f"WITH {_CALLS}, s AS (SELECT audio_id, avg(value) AS m FROM txt GROUP BY 1) SELECT audio_id, {R('percentile', 'percentile')}, {R('greatest(-m, 0.0)', 'negativity')}, {R('CAST(0.6 AS DOUBLE) * percentile + CAST(0.4 AS DOUBLE) * greatest(-m, 0.0)', 'combined')} FROM ranked JOIN s USING (audio_id)")
def keyword_sentiment_combined(spark, d):
    s = sentiment.grouped(A.transcripts(spark, d), ["audio_id"])
    return keywords.with_sentiment(_calls(spark, d), s, ["audio_id"]).select("audio_id", "percentile", "negativity", "combined")


@query(f"WITH {A.TXT} SELECT audio_id, seg_id, {R('end_s - start_s', 'duration_s')}, CAST(length(trim(text)) AS BIGINT) AS n_chars, CAST({A.words_sql('trim(text)')} AS BIGINT) AS n_words FROM txt")
def segment_prepare(spark, d):
    return keywords.prepared(A.transcripts(spark, d).drop("n_words")).select("audio_id", "seg_id", "duration_s", "n_chars", "n_words")


@query(f"WITH {_SPOT}, x AS (SELECT unnest(list_filter([{', '.join(f'CASE WHEN c_{t} > 0 THEN {t!r} END' for t in LEXICON)}], lambda x: x IS NOT NULL)) AS theme FROM k2) SELECT theme, count(*) AS n FROM x GROUP BY theme ORDER BY n DESC, theme LIMIT 6")
def theme_explode_topk(spark, d):
    return _spotted(spark, d).select(F.explode("critical_themes").alias("theme")).groupBy("theme").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "theme").limit(6)


@query(f"WITH {_CALLS}, t AS ({_THEMES}) SELECT (SELECT count(*) FROM k2) AS n_segments, (SELECT count(DISTINCT audio_id) FROM k2) AS n_calls, (SELECT count(*) FROM k2 WHERE themes > 0) AS n_critical, (SELECT CAST(sum(total) AS BIGINT) FROM k2) AS total_matches, {R('(SELECT max(score) FROM ranked)', 'max_score')}, (SELECT count(*) FROM ranked WHERE n_critical > 0) AS n_critical_calls, (SELECT theme FROM t ORDER BY n_hits DESC, theme DESC LIMIT 1) AS top_theme, {R('(SELECT count(*) FILTER (themes > 0) / count(*) FROM k2)', 'share_critical')}")
def keyword_final_summary(spark, d):
    return keywords.final_summary(_spotted(spark, d), _calls(spark, d), keywords.theme_summary(_spotted(spark, d), LEXICON), "audio_id")


#: Some two hundred keywords, as a full lexicon has: short fragments made by a rule, dealt over the themes.
WIDE_LEXICON: keywords.Lexicon = {t: [a + b for a in "abcdefghijklmnopqrst" for b in "aeinorstu" if (ord(a) * 7 + ord(b)) % 12 == i] + LEXICON[t] for i, t in enumerate(LEXICON)}
WORD_LEXICON: keywords.Lexicon = {"articulos": ["the", "la", "le", "der", "die", "el", "les"], "enlaces": ["and", "y", "et", "und", "of the", "de la"], "nada": ["...", ""]}


def _wide(lexicon: keywords.Lexicon, found: str) -> str:
    one = " UNION ALL ".join(f"SELECT '{t}' AS theme, list_filter({sorted({k.strip() for k in ks} - {'', '...'})!r}, lambda k: {found}) AS m FROM n" for t, ks in lexicon.items())
    return f"WITH {A.TXT}, n AS (SELECT {A.normal_sql('text')} AS norm FROM txt), o AS ({one}) SELECT theme, count(*) AS n_segments, count(*) FILTER (len(m) > 0) AS n_hits, CAST(sum(len(m)) AS BIGINT) AS n_matches, {R('round(100 * count(*) FILTER (len(m) > 0) / count(*), 2)', 'pct')} FROM o GROUP BY theme"


@query(_wide(WIDE_LEXICON, "contains(norm, k)"))
def theme_summary_wide_lexicon(spark, d):
    return keywords.theme_summary(keywords.spotted(A.transcripts(spark, d), WIDE_LEXICON), WIDE_LEXICON)


@query(_wide(WORD_LEXICON, "contains(' ' || norm || ' ', ' ' || k || ' ')"))
def theme_summary_whole_words(spark, d):
    return keywords.theme_summary(keywords.spotted(A.transcripts(spark, d), WORD_LEXICON, bounded=True), WORD_LEXICON)


# --- intervals ------------------------------------------------------------------------------------

_ISLES = f"""{A.SEG}, o1 AS (SELECT *, CASE WHEN lag(speaker) OVER w IS NULL OR lag(speaker) OVER w <> speaker THEN 1 ELSE 0 END AS turn FROM seg WINDOW w AS (PARTITION BY audio_id ORDER BY start_s, end_s, seg_id)),
o2 AS (SELECT *, sum(turn) OVER (PARTITION BY audio_id ORDER BY start_s, end_s, seg_id) AS run FROM o1),
o3 AS (SELECT *, max(end_s) OVER (PARTITION BY audio_id, run ORDER BY start_s, end_s, seg_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM o2),
o4 AS (SELECT *, sum(CASE WHEN reach IS NULL OR start_s - reach > {GAP} THEN 1 ELSE 0 END) OVER (PARTITION BY audio_id, run ORDER BY start_s, end_s, seg_id) AS island FROM o3)"""


@query(f"WITH {_ISLES} SELECT audio_id, CAST(run AS BIGINT) AS run, CAST(island AS BIGINT) AS island, first(speaker) AS speaker, {R('min(start_s)', 'start_s')}, {R('max(end_s)', 'end_s')}, count(*) AS n_merged FROM o4 GROUP BY audio_id, run, island")
def merge_adjacent_islands(spark, d):
    m = intervals.merge_adjacent(A.segments(spark, d), max_gap=GAP)
    return m.select("audio_id", "run", "island", "speaker", "start_s", "end_s", "n_merged")


@query(f"WITH {_ISLES} SELECT audio_id, arg_min(seg_id, (start_s, end_s, seg_id)) AS seg_id, {R('max(end_s) - min(start_s)', 'duration_s')}, string_agg(CAST(seg_id AS VARCHAR), ',' ORDER BY start_s, end_s, seg_id) AS merged_ids FROM o4 GROUP BY audio_id, run, island")
def merge_adjacent_ids(spark, d):
    return intervals.merge_adjacent(A.segments(spark, d), max_gap=GAP).select("audio_id", "seg_id", "duration_s", "merged_ids")


@query(f"WITH {_ISLES} SELECT audio_id, count(*) AS n_segments, count(DISTINCT (run, island)) AS n_islands FROM o4 GROUP BY audio_id")
def count_merged_segments(spark, d):
    return intervals.count_islands(A.segments(spark, d), max_gap=GAP)


_SWEEP = f"""{A.SEG}, ev AS (SELECT audio_id, start_s AS t, 1 AS d FROM seg WHERE end_s > start_s UNION ALL SELECT audio_id, end_s, -1 FROM seg WHERE end_s > start_s),
lv AS (SELECT audio_id, t, sum(d) AS d FROM ev GROUP BY 1, 2), op AS (SELECT *, sum(d) OVER w AS open, lead(t) OVER w AS nxt FROM lv WINDOW w AS (PARTITION BY audio_id ORDER BY t)),
busy AS (SELECT * FROM op WHERE open > 1 AND nxt IS NOT NULL), cut AS (SELECT *, CASE WHEN lag(nxt) OVER w IS NULL OR lag(nxt) OVER w <> t THEN 1 ELSE 0 END AS c FROM busy WINDOW w AS (PARTITION BY audio_id ORDER BY t)),
reg AS (SELECT *, sum(c) OVER (PARTITION BY audio_id ORDER BY t) AS g FROM cut), ovl AS (SELECT audio_id, min(t) AS a, max(nxt) AS b FROM reg GROUP BY audio_id, g)"""


@query(f"WITH {_SWEEP} SELECT audio_id, {R('a', 'start_s')}, {R('b', 'end_s')} FROM ovl")
def overlap_regions_sweep(spark, d):
    return intervals.overlap_regions(A.segments(spark, d))


@query(ORACLE_SQL["merge_adjacent_islands"])
def merge_adjacent_binned(spark, d):
    """The islands again, each recording dealt over bins of a day."""
    m = intervals.merge_adjacent(A.segments(spark, d), max_gap=GAP, bin_s=86_400.0)
    return m.select("audio_id", "run", "island", "speaker", "start_s", "end_s", "n_merged")


@query(ORACLE_SQL["overlap_regions_sweep"])
def overlap_regions_binned(spark, d):
    return intervals.overlap_regions(A.segments(spark, d), bin_s=86_400.0)


_OVER = f"{_SWEEP}, so AS (SELECT seg.*, coalesce((SELECT sum(least(seg.end_s, b) - greatest(seg.start_s, a)) FROM ovl WHERE ovl.audio_id = seg.audio_id AND seg.start_s < b AND seg.end_s > a), 0.0) AS overlap_s FROM seg)"


def _overlapped(spark, d):
    s = A.segments(spark, d)
    return intervals.overlap_seconds(s, intervals.overlap_regions(s), bin_s=86_400.0)


@query(f"WITH {_OVER} SELECT audio_id, seg_id, {R('overlap_s', 'overlap_s')}, {R('coalesce(overlap_s / nullif(end_s - start_s, 0), 0.0)', 'overlap_ratio')} FROM so")
def segment_overlap_ratio(spark, d):
    return intervals.scored(_overlapped(spark, d)).select("audio_id", "seg_id", "overlap_s", "overlap_ratio")


def _scored(spark, d):
    return intervals.scored(_overlapped(spark, d), min_duration=600.0, min_rms=-40.0, min_anchor=1200.0, max_anchor_overlap=0.5, skip_first=86_400.0)


_SCORED = f"""{_OVER}, r AS (SELECT *, end_s - start_s AS len_s, coalesce(overlap_s / nullif(end_s - start_s, 0), 0.0) AS overlap_ratio FROM so),
sc AS (SELECT *, list_filter([CASE WHEN len_s < 600 THEN 'short' END, CASE WHEN rms < -40 THEN 'low_energy' END], lambda x: x IS NOT NULL) AS dr,
list_sort(list_filter([CASE WHEN len_s < 600 THEN 'short' END, CASE WHEN rms < -40 THEN 'low_energy' END, CASE WHEN len_s < 1200 THEN 'short_anchor' END, CASE WHEN overlap_ratio > 0.5 THEN 'overlap' END, CASE WHEN start_s < 86400 THEN 'initial_window' END], lambda x: x IS NOT NULL)) AS ar FROM r)"""


@query(f"WITH {_SCORED} SELECT audio_id, seg_id, {R('len_s', 'duration_s')}, array_to_string(dr, ';') AS drop_reasons, array_to_string(ar, ';') AS anchor_reasons, len(dr) = 0 AS valid_export, len(ar) = 0 AS valid_anchor FROM sc")
def scored_segments_reasons(spark, d):
    return _scored(spark, d).select("audio_id", "seg_id", "duration_s", "drop_reasons", "anchor_reasons", "valid_export", "valid_anchor")


@query(f"WITH {_SCORED}, rk AS (SELECT *, row_number() OVER (PARTITION BY audio_id, speaker ORDER BY len_s DESC, rms DESC, overlap_ratio, start_s, seg_id) AS anchor_rank FROM sc WHERE len(ar) = 0) SELECT audio_id, speaker, seg_id, anchor_rank FROM rk WHERE anchor_rank <= 3")
def anchors_topk_per_speaker(spark, d):
    return intervals.anchors(_scored(spark, d)).select("audio_id", "speaker", "seg_id", "anchor_rank")


_TH = ", ".join(f"(CAST({t} AS DOUBLE))" for t in THRESHOLDS)


@query(f"WITH {_SCORED}, th(threshold) AS (VALUES {_TH}) SELECT threshold, count(*) AS n, count(*) FILTER (round(overlap_ratio, 9) <= threshold) AS n_within, {R('count(*) FILTER (round(overlap_ratio, 9) <= threshold) / count(*)', 'share_within')}, count(*) FILTER (round(overlap_ratio, 9) > threshold) AS n_over FROM sc, th GROUP BY threshold")
def overlap_threshold_sweep(spark, d):
    return intervals.overlap_sweep(_scored(spark, d).withColumn("overlap_ratio", F.round("overlap_ratio", 9)), THRESHOLDS)


_ASWEEP = f"""{_SCORED}, th(threshold) AS (VALUES {_TH}), per AS (SELECT threshold, audio_id, speaker, count(*) FILTER (round(overlap_ratio, 9) <= threshold) AS n FROM sc, th GROUP BY ALL),
cl AS (SELECT threshold, audio_id, sum(n) AS n, count(*) FILTER (n >= 3) AS able FROM per GROUP BY ALL),
sw AS (SELECT threshold, CAST(sum(n) AS BIGINT) AS candidates, count(*) FILTER (able >= 2) AS able_calls, count(*) AS calls, avg(n) AS mean_candidates, CAST(min(n) AS BIGINT) AS min_candidates, CAST(max(n) AS BIGINT) AS max_candidates, count(*) FILTER (able >= 2) / count(*) AS coverage FROM cl GROUP BY threshold)"""


def _anchor_sweep(spark, d):
    return intervals.anchor_sweep(_scored(spark, d).withColumn("overlap_ratio", F.round("overlap_ratio", 9)), THRESHOLDS)


@query(f"WITH {_ASWEEP} SELECT threshold, candidates, able_calls, calls, {R('mean_candidates', 'mean_candidates')}, min_candidates, max_candidates, {R('coverage', 'coverage')} FROM sw")
def anchor_threshold_simulation(spark, d):
    return _anchor_sweep(spark, d)


@query(f"WITH {_ASWEEP} SELECT coalesce((SELECT min(threshold) FROM sw WHERE coverage >= 0.9), (SELECT threshold FROM sw ORDER BY coverage DESC, threshold LIMIT 1)) AS threshold")
def anchor_threshold_recommendation(spark, d):
    return intervals.recommended_threshold(_anchor_sweep(spark, d))


@query(f"WITH {_OVER} SELECT audio_id, count(*) AS n_segments, {R('sum(overlap_s)', 'overlap_s')}, {R('sum(overlap_s) / nullif(sum(end_s - start_s), 0)', 'weighted_ratio')}, count(*) FILTER (overlap_s > 0) AS n_overlapped FROM so GROUP BY audio_id")
def overlap_by_audio(spark, d):
    s = _overlapped(spark, d)
    return s.groupBy("audio_id").agg(F.count("*").alias("n_segments"), F.sum("overlap_s").alias("overlap_s"), F.try_divide(F.sum("overlap_s"), F.sum(F.col("end_s") - F.col("start_s"))).alias("weighted_ratio"), F.sum((F.col("overlap_s") > 0).cast("long")).alias("n_overlapped"))


_MARGINS = (0.0, 0.005, 0.01, 0.02, 0.03, 0.05, 0.1)


@query(f"""WITH {A.SEG}, dd AS (SELECT *, abs(sin(seg_id)) AS d0, abs(cos(seg_id)) AS d1 FROM seg), b AS (SELECT *, CASE WHEN d0 <= d1 THEN 'SPEAKER_00' ELSE 'SPEAKER_01' END AS best, abs(d1 - d0) AS margin FROM dd),
m(least) AS (VALUES {', '.join(f'(CAST({m} AS DOUBLE))' for m in _MARGINS)}), x AS (SELECT least, audio_id, seg_id, start_s, end_s, speaker, CASE WHEN margin >= least THEN best ELSE speaker END AS label FROM b, m),
o AS (SELECT *, CASE WHEN lag(label) OVER w IS NULL OR lag(label) OVER w <> label THEN 1 ELSE 0 END AS turn FROM x WINDOW w AS (PARTITION BY least, audio_id ORDER BY start_s, end_s, seg_id))
SELECT least AS margin, count(*) FILTER (label <> speaker) AS n_changed, CAST(sum(turn) AS BIGINT) AS n_turns FROM o GROUP BY least""")
def relabel_margin_sweep(spark, d):
    s = A.segments(spark, d).withColumn("d0", F.abs(F.sin("seg_id"))).withColumn("d1", F.abs(F.cos("seg_id")))
    best, _, _, margin = intervals.best_by_distance({"SPEAKER_00": F.col("d0"), "SPEAKER_01": F.col("d1")})
    steps = F.broadcast(spark.createDataFrame([(m,) for m in _MARGINS], "least double"))
    x = s.withColumn("best", best).withColumn("gap", margin).crossJoin(steps)
    label, moved = intervals.relabel(F.col("speaker"), F.col("best"), F.col("gap"), F.col("least"))
    x = x.withColumn("moved", moved).withColumn("label", label)
    runs = intervals.islands(x, ["least", "audio_id"], "label", max_gap=1e18)
    return runs.groupBy("least", "audio_id").agg(F.sum(F.col("moved").cast("long")).alias("c"), F.max("run").alias("t")).groupBy(F.col("least").alias("margin")).agg(F.sum("c").alias("n_changed"), F.sum("t").alias("n_turns"))


def _words_and_segments(spark, d):
    s = A.segments(spark, d)
    words = s.filter("event_type = 'click'").select("audio_id", F.col("seg_id").alias("word_id"), F.col("start_s").alias("w_start"), (F.col("start_s") + 60).alias("w_end"), F.col("event_type").alias("word"), (1 / (1 + F.col("value"))).alias("prob"))
    return words, s.filter("event_type <> 'click'")


_ASSIGN = f"""{A.SEG}, wd AS (SELECT audio_id, seg_id AS word_id, start_s AS w_start, start_s + 60 AS w_end, event_type AS word, 1 / (1 + value) AS prob FROM seg WHERE event_type = 'click'),
pr AS (SELECT wd.*, s.seg_id, s.start_s, s.end_s, greatest(least(w_end, s.end_s) - greatest(w_start, s.start_s), 0.0) AS o, CASE WHEN (w_start + w_end) / 2 < s.start_s THEN s.start_s - (w_start + w_end) / 2 WHEN (w_start + w_end) / 2 > s.end_s THEN (w_start + w_end) / 2 - s.end_s ELSE 0.0 END AS away FROM wd LEFT JOIN (SELECT * FROM seg WHERE event_type <> 'click') s USING (audio_id)),
pk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY audio_id, word_id ORDER BY o DESC, CASE WHEN o > 0 THEN 0.0 ELSE away END, start_s, end_s, seg_id) AS rn FROM pr) WHERE rn = 1),
asg AS (SELECT audio_id, word_id, CASE WHEN o > 0 OR away <= 3600 THEN seg_id END AS seg_id, o, away, CASE WHEN o > 0 THEN 'overlap' WHEN away <= 3600 THEN 'nearest' ELSE 'none' END AS how FROM pk)"""


def _assigned(spark, d):
    words, segs = _words_and_segments(spark, d)
    return intervals.assign_points(words, segs, tolerance=3600.0, bin_s=86_400.0)


@query(f"WITH {_ASSIGN} SELECT audio_id, word_id, seg_id, how, {R('o', 'overlap_s')}, {R('away', 'distance_s')} FROM asg")
def nearest_within_tolerance(spark, d):
    return _assigned(spark, d)


@query(f"WITH {_ASSIGN} SELECT s.audio_id, s.seg_id, count(a.word_id) AS n_words, {R('avg(w.prob)', 'mean_prob')}, {R('min(w.w_start)', 'first_s')}, coalesce(string_agg(w.word, ' ' ORDER BY w.w_start, w.word_id), '') AS text FROM (SELECT * FROM seg WHERE event_type <> 'click') s LEFT JOIN asg a ON a.audio_id = s.audio_id AND a.seg_id = s.seg_id LEFT JOIN wd w ON w.audio_id = a.audio_id AND w.word_id = a.word_id GROUP BY 1, 2")
def max_overlap_assignment(spark, d):
    words, segs = _words_and_segments(spark, d)
    return intervals.segment_texts(segs, _assigned(spark, d), words).select("audio_id", "seg_id", "n_words", "mean_prob", "first_s", "text")


@query(f"""WITH {A.TXT}, o AS (SELECT *, row_number() OVER (PARTITION BY audio_id ORDER BY start_s, end_s, seg_id) AS i FROM (SELECT * REPLACE (CASE WHEN seg_id % 4 < 2 THEN 'a' ELSE 'b' END AS speaker) FROM txt)),
j AS (SELECT a.audio_id, a.speaker, a.seg_id AS first_id, b.seg_id AS last_id, b.i - a.i + 1 AS n_joined, a.i AS x, b.i AS y, a.start_s FROM o a JOIN o b ON a.audio_id = b.audio_id AND b.i BETWEEN a.i AND a.i + 3),
g AS (SELECT j.*, (SELECT bool_and(m.speaker = j.speaker) FROM o m WHERE m.audio_id = j.audio_id AND m.i BETWEEN x AND y) AS same, coalesce((SELECT bool_and(n.start_s - m.end_s <= 60) FROM o m JOIN o n ON n.audio_id = m.audio_id AND n.i = m.i + 1 WHERE m.audio_id = j.audio_id AND m.i BETWEEN x AND y - 1), true) AS close,
(SELECT sum(n_words) FROM o m WHERE m.audio_id = j.audio_id AND m.i BETWEEN x AND y) AS n_words, (SELECT string_agg(text, ' ' ORDER BY i) FROM o m WHERE m.audio_id = j.audio_id AND m.i BETWEEN x AND y) AS text FROM j)
SELECT audio_id, speaker, first_id, last_id, n_joined, CAST(n_words AS BIGINT) AS n_words, md5(text) AS text_md5 FROM g WHERE same AND close AND n_words >= 4""")
def windows_1_to_4(spark, d):
    t = A.transcripts(spark, d).withColumn("speaker", F.when(F.col("seg_id") % 4 < 2, "a").otherwise("b"))
    return intervals.speaker_windows(t, max_gap=60.0).select("audio_id", "speaker", "first_id", "last_id", "n_joined", "n_words", F.md5("text").alias("text_md5"))


# --- matching and identity ------------------------------------------------------------------------


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus = 'F', o_orderdate DESC, o_orderkey) AS rn FROM orders) SELECT o_custkey, o_orderkey, o_orderstatus FROM r WHERE rn = 1")
def canonical_dedup_keep_first(spark, d):
    first, _ = matching.keep_first(A.table(spark, d, "orders"), ["o_custkey"], F.col("o_orderstatus") == "F", F.desc("o_orderdate"), F.col("o_orderkey"))
    return first.select("o_custkey", "o_orderkey", "o_orderstatus")


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus = 'F', o_orderdate DESC, o_orderkey) AS rn FROM orders) SELECT o_custkey, o_orderkey FROM r WHERE rn > 1")
def dropped_duplicates_anti(spark, d):
    _, rest = matching.keep_first(A.table(spark, d, "orders"), ["o_custkey"], F.col("o_orderstatus") == "F", F.desc("o_orderdate"), F.col("o_orderkey"))
    return rest.select("o_custkey", "o_orderkey")


@query("SELECT o_custkey, count(DISTINCT o_orderpriority) AS n_names, array_to_string(list_sort(list_distinct(list(o_orderpriority)))[1:10], '|') AS examples FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderpriority) > 1")
def duplicate_summary_having(spark, d):
    return matching.duplicate_summary(A.table(spark, d, "orders"), "o_custkey", "o_orderpriority")


@query("""WITH l AS (SELECT c_custkey, c_nationkey, c_acctbal FROM customer), r AS (SELECT o_orderkey, o_custkey, o_custkey % 25 AS o_nation, o_totalprice, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders),
p AS (SELECT l.*, r.*, CASE WHEN o_custkey IS NULL THEN NULL WHEN c_nationkey = o_nation THEN 1 WHEN n = 1 THEN 2 ELSE 3 END AS m, abs(c_acctbal - o_totalprice) AS diff FROM l LEFT JOIN r ON c_custkey = o_custkey),
k AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY m NULLS LAST, diff NULLS LAST, o_orderkey) AS rn FROM p)
SELECT c_custkey, o_orderkey, CASE m WHEN 1 THEN 'exact' WHEN 2 THEN 'unique' WHEN 3 THEN 'nearest' ELSE 'none' END AS method, """ + R("diff", "size_diff") + " FROM k WHERE rn = 1")
def cascade_metadata_match(spark, d):
    left = A.table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    right = A.table(spark, d, "orders").select("o_orderkey", "o_custkey", (F.col("o_custkey") % 25).alias("o_nation"), "o_totalprice")
    out = matching.cascade_match(left, right, "c_custkey", [("c_nationkey", "o_nation")], ("c_custkey", "o_custkey"), ("c_acctbal", "o_totalprice"), "o_orderkey")
    return out.select("c_custkey", "o_orderkey", "method", "size_diff")


_NAMES = "nm AS (SELECT page_id, CASE page_id % 7 WHEN 0 THEN 'raw_' || (9150000000 + page_id) || '_clean.wav' WHEN 1 THEN 'raw_bajas_' || (9150000000 + page_id) || '.wav' WHEN 2 THEN '/a/b/' || (9150000000 + page_id) || '_clean.WAV' WHEN 3 THEN 'raw_bajas_' || page_id || '_final_merged.csv' WHEN 4 THEN 'comercial_raw_' || page_id || '_clean.wav' WHEN 5 THEN 'x raw_ ' || (9150000000 + page_id) || '.mp3' ELSE 'note_' || page_id || '_transcribed_segments_raw.flac' END AS name FROM pages)"


def _names(spark, d):
    p, k = F.col("page_id"), F.col("page_id") % 7
    long, short = (F.lit(9150000000) + p).cast("string"), p.cast("string")
    name = F.when(k == 0, F.concat(F.lit("raw_"), long, F.lit("_clean.wav"))).when(k == 1, F.concat(F.lit("raw_bajas_"), long, F.lit(".wav"))).when(k == 2, F.concat(F.lit("/a/b/"), long, F.lit("_clean.WAV")))
    name = name.when(k == 3, F.concat(F.lit("raw_bajas_"), short, F.lit("_final_merged.csv"))).when(k == 4, F.concat(F.lit("comercial_raw_"), short, F.lit("_clean.wav"))).when(k == 5, F.concat(F.lit("x raw_ "), long, F.lit(".mp3")))
    return A.table(spark, d, "pages").select("page_id", name.otherwise(F.concat(F.lit("note_"), short, F.lit("_transcribed_segments_raw.flac"))).alias("name"))


_BASE = "regexp_extract(name, '([^/]*)$', 1)"


def _nested(expr: str, *patterns: str) -> str:
    for p in patterns:
        expr = f"regexp_replace({expr}, '{p}', '')"
    return expr


_SUFF = [f"{s}$" for s in N.SUFFIXES]
_STEM = r"regexp_replace(regexp_extract(name, '([^/]*)$', 1), '(.)\.[^.]*$', '\1')"


@query(f"""WITH {_NAMES}, s AS (SELECT *, {_STEM} AS stem FROM nm) SELECT page_id,
{_nested(_BASE, r"(?i)\.wav$", r"(?i)\.csv$", *_SUFF, "^(raw_bajas_|raw_comercial_|raw_)")} AS recording_id,
{_nested(_BASE, r"(?i)\.(wav|mp3|m4a|flac|ogg)$", *[f"{s}$" for s in N.STEM_SUFFIXES])} AS stem,
{_nested(_BASE, r"\.csv$", "_final_merged$", r"\.wav$", "_clean$", "^(raw_bajas_|raw_comercial_|raw_|bajas_|comercial_)+")} AS consolidation_id,
CASE WHEN regexp_matches(stem, '^(raw_bajas|raw)_([0-9]+)(_clean)?$') THEN regexp_extract(stem, '^(raw_bajas|raw)_([0-9]+)(_clean)?$', 1) WHEN regexp_matches(stem, '^([0-9]+)(_clean)?$') THEN NULL WHEN regexp_matches(stem, '[0-9]{{10,}}') THEN CASE WHEN contains(stem, 'raw_bajas') THEN 'raw_bajas' WHEN contains(stem, 'raw_') THEN 'raw' END END AS source,
CASE WHEN regexp_matches(stem, '^(raw_bajas|raw)_([0-9]+)(_clean)?$') THEN regexp_extract(stem, '^(raw_bajas|raw)_([0-9]+)(_clean)?$', 2) WHEN regexp_matches(stem, '^([0-9]+)(_clean)?$') THEN regexp_extract(stem, '^([0-9]+)', 1) WHEN regexp_matches(stem, '[0-9]{{10,}}') THEN regexp_extract(stem, '[0-9]{{10,}}') END AS number FROM s""")
def audio_identity_parse(spark, d):
    n = _names(spark, d)
    source, number = N.source_and_id(F.col("name"))
    return n.select("page_id", N.recording_id(F.col("name")).alias("recording_id"), N.recording_stem(F.col("name")).alias("stem"), N.consolidation_id(F.col("name")).alias("consolidation_id"), source.alias("source"), number.alias("number"))


@query(f"""WITH {_NAMES}, i AS (SELECT page_id, {_nested(_BASE, r"(?i)\.wav$", r"(?i)\.csv$", *_SUFF, "^(raw_bajas_|raw_comercial_|raw_)")} AS k FROM nm),
v AS (SELECT page_id, unnest([0, 1, 2, 3, 4, 5]) AS priority, unnest([k, 'raw_' || k, 'raw_bajas_' || k, k || '_clean', 'raw_' || k || '_clean', 'raw_bajas_' || k || '_clean']) AS key FROM i),
r AS (SELECT CASE doc_id % 3 WHEN 0 THEN 'raw_' || (9150000000 + doc_id) WHEN 1 THEN (9150000000 + doc_id) || '_clean' ELSE CAST(9150000000 + doc_id AS VARCHAR) END AS key, doc_id FROM documents),
f AS (SELECT page_id, priority, v.key, doc_id, row_number() OVER (PARTITION BY page_id ORDER BY priority, doc_id) AS rn FROM v JOIN r ON v.key = r.key)
SELECT i.page_id, CAST(priority AS BIGINT) AS priority, f.key AS matched_key, doc_id FROM i LEFT JOIN f ON f.page_id = i.page_id AND rn = 1""")
def priority_variant_lookup(spark, d):
    k, n = F.col("doc_id") % 3, (F.lit(9150000000) + F.col("doc_id")).cast("string")
    files = A.table(spark, d, "documents").select("doc_id", F.when(k == 0, F.concat(F.lit("raw_"), n)).when(k == 1, F.concat(n, F.lit("_clean"))).otherwise(n).alias("file_key"))
    return matching.priority_lookup(_names(spark, d), files, "page_id", N.name_variants(F.col("name")), "file_key", ["doc_id"]).drop("name")


@query("SELECT c_custkey, substr(sha256('salt_' || trim(c_name)), 1, 16) AS id_hash, substr(sha256(c_name), 1, 16) AS name_hash FROM customer")
def salted_hash_ids(spark, d):
    return A.table(spark, d, "customer").select("c_custkey", X.salted_hash(F.col("c_name"), "salt").alias("id_hash"), X.text_hash(F.col("c_name")).alias("name_hash"))


@query(f"WITH {A.SEG}, u AS (SELECT audio_id, substr(sha256(audio_id || '|' || printf('%.6f', start_s) || '|' || printf('%.6f', end_s) || '|' || speaker), 1, 24) AS uid FROM seg) SELECT audio_id, count(*) AS n, sha256(string_agg(uid, '|' ORDER BY uid)) AS fingerprint FROM u GROUP BY audio_id")
def fingerprint_set(spark, d):
    s = A.segments(spark, d).withColumn("uid", N.segment_uid(F.col("audio_id"), F.col("start_s"), F.col("end_s"), F.col("speaker")))
    return s.groupBy("audio_id").agg(F.count("*").alias("n"), N.set_fingerprint(F.col("uid")).alias("fingerprint"))


@query("WITH q AS (SELECT quantile_cont(o_totalprice, 0.25) AS a, quantile_cont(o_totalprice, 0.75) AS b FROM orders) SELECT o_orderstatus, count(*) AS n, count(*) FILTER (o_totalprice < a - 1.5 * (b - a) OR o_totalprice > b + 1.5 * (b - a)) AS n_outliers FROM orders, q GROUP BY 1")
def duration_outliers_iqr(spark, d):
    out = prosody.iqr_outliers(A.table(spark, d, "orders"), "o_totalprice")
    return out.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.sum(F.col("is_outlier").cast("long")).alias("n_outliers"))


_DESCRIBE = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", {R('count(' + c + ')', 'n')}, {R('avg(' + c + ')', 'mean')}, {R('stddev_samp(' + c + ')', 'std')}, {R('min(' + c + ')', 'min')}, {R('quantile_cont(' + c + ', 0.25)', 'p25')}, {R('quantile_cont(' + c + ', 0.5)', 'p50')}, {R('quantile_cont(' + c + ', 0.75)', 'p75')}, {R('max(' + c + ')', 'max')} FROM (SELECT CAST(o_totalprice AS DOUBLE) AS o_totalprice, CAST(o_custkey AS DOUBLE) AS o_custkey FROM orders)"
    for c in ("o_totalprice", "o_custkey")
)


@query(_DESCRIBE)
def profile_describe(spark, d):
    return prosody.described(A.table(spark, d, "orders"), ["o_totalprice", "o_custkey"])


@query("WITH c AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) SELECT o_custkey, n, n >= 2 AS trainable FROM c")
def counts_per_identity(spark, d):
    o = A.table(spark, d, "orders")
    often = matching.rows_of_repeated(o, "o_custkey").select("o_custkey").distinct().withColumn("trainable", F.lit(True))
    return o.groupBy("o_custkey").agg(F.count("*").alias("n")).join(often, "o_custkey", "left").fillna({"trainable": False})


@query("SELECT (SELECT count(DISTINCT c_custkey) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)) AS only_left, (SELECT count(DISTINCT o_custkey) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)) AS only_right, (SELECT count(DISTINCT c_custkey) FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)) AS common, (SELECT count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders)) = 0 AND (SELECT count(*) FROM (SELECT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer)) = 0 AS equal_sets")
def key_set_equality(spark, d):
    return matching.key_sets(A.table(spark, d, "customer"), A.table(spark, d, "orders"), "c_custkey", "o_custkey")


@query(f"WITH {A.SEG}, {A.TXT}, a AS (SELECT audio_id, seg_id, round_even(start_s / 1000, 0) AS k FROM seg), b AS (SELECT audio_id, round_even(start_s / 10, 0) AS k, min(text) AS text FROM txt GROUP BY 1, 2) SELECT a.audio_id, a.seg_id, b.text IS NOT NULL AS found FROM a LEFT JOIN b ON a.audio_id = b.audio_id AND a.k = b.k")
def audio_text_join(spark, d):
    a = A.segments(spark, d).select("audio_id", "seg_id", (F.col("start_s") / 1000).alias("start_s"))
    b = A.transcripts(spark, d).select("audio_id", (F.col("start_s") / 10).alias("start_s"), "text")
    return matching.time_key_join(a, b, ["audio_id"], ("start_s",), 0).select("audio_id", "seg_id", F.col("text").isNotNull().alias("found"))


# --- sentiment ------------------------------------------------------------------------------------


def _measures(prefix: str = "") -> str:
    shares = ", ".join(R(f"avg(CASE WHEN label = '{x}' THEN 1.0 ELSE 0.0 END)", f"pct_{x}") for x in sentiment.LABELS)
    return f"count(*) AS n_segments, {R('avg(value)', 'avg_sentiment')}, {shares}, CASE WHEN avg(value) IS NULL THEN 'unknown' WHEN avg(value) <= -0.25 THEN 'negative' WHEN avg(value) >= 0.25 THEN 'positive' ELSE 'neutral' END AS sentiment_class"


@query(f"WITH {A.TXT} SELECT audio_id, {_measures()} FROM txt GROUP BY audio_id")
def sentiment_call_aggregate(spark, d):
    return sentiment.grouped(A.transcripts(spark, d), ["audio_id"])


@query(f"WITH {A.TXT} SELECT audio_id, role, {_measures()} FROM txt GROUP BY audio_id, role")
def sentiment_call_role(spark, d):
    return sentiment.grouped(A.transcripts(spark, d), ["audio_id", "role"])


@query(f"WITH {A.TXT}, s AS (SELECT * REPLACE (CAST(seg_id % 2 AS VARCHAR) AS speaker) FROM txt), c AS (SELECT audio_id, speaker, role, count(*) AS n FROM s WHERE role IS NOT NULL GROUP BY ALL), t AS (SELECT audio_id, speaker, role FROM (SELECT *, row_number() OVER (PARTITION BY audio_id, speaker ORDER BY n DESC, role) AS rn FROM c) WHERE rn = 1), g AS (SELECT audio_id, speaker, {_measures()} FROM s GROUP BY audio_id, speaker) SELECT g.*, t.role AS dominant_role FROM g LEFT JOIN t USING (audio_id, speaker)")
def sentiment_speaker_mode(spark, d):
    return sentiment.by_speaker(A.transcripts(spark, d).withColumn("speaker", (F.col("seg_id") % 2).cast("string")), ["audio_id"])


@query(f"WITH {A.TXT}, p AS (SELECT *, start_s / nullif(max(end_s) OVER (PARTITION BY audio_id), 0) AS pos FROM txt), q AS (SELECT *, CASE WHEN pos IS NULL THEN 'unknown' WHEN pos < CAST(1 AS DOUBLE) / 3 THEN 'inicio' WHEN pos < CAST(2 AS DOUBLE) / 3 THEN 'mitad' ELSE 'final' END AS phase FROM p) SELECT phase, role, {_measures()} FROM q GROUP BY phase, role")
def sentiment_by_phase(spark, d):
    return sentiment.grouped(sentiment.with_phase(A.transcripts(spark, d), ["audio_id"]), ["phase", "role"])


@query(f"WITH {A.TXT}, g AS (SELECT audio_id, avg(value) AS m, {_measures()} FROM txt WHERE role = 'CLIENT' GROUP BY audio_id) SELECT * EXCLUDE (m) FROM g ORDER BY m NULLS LAST, audio_id LIMIT 20")
def most_negative_clients(spark, d):
    return sentiment.most_negative(A.transcripts(spark, d), ["audio_id"])


@query(f"WITH {A.TXT} SELECT role, count(*) AS n, {R('100 * count(*) / sum(count(*)) OVER ()', 'pct')} FROM txt GROUP BY role")
def label_distribution(spark, d):
    return sentiment.distribution(A.transcripts(spark, d), "role")


_QS = {"n_segments": "count(*)", "n_calls": "count(DISTINCT audio_id)", "n_empty": "count(*) FILTER (trim(text) = '')", "n_eligible": "count(*) FILTER (n_words >= 2)", "mean_words": "avg(n_words)", "median_words": "quantile_cont(n_words, 0.5)", "n_no_role": "count(*) FILTER (role IS NULL)"}


@query(f"WITH {A.TXT} " + " UNION ALL ".join(f"SELECT '{k}' AS metric, {R(v, 'value')} FROM txt" for k, v in _QS.items()))
def quality_summary_long(spark, d):
    return sentiment.quality_summary(A.transcripts(spark, d), "audio_id")


# --- prosody and fusion ---------------------------------------------------------------------------


def _z_sql(c: str, src: str) -> str:
    return f"""m_{c} AS (SELECT quantile_cont({c}, 0.5) AS med, avg({c}) AS mean, stddev_samp({c}) AS sd FROM {src}), d_{c} AS (SELECT quantile_cont(abs({c} - med), 0.5) AS mad FROM {src}, m_{c})"""


def _z(c: str) -> str:
    return f"(CASE WHEN (SELECT mad FROM d_{c}) > 0 THEN CAST(0.6745 AS DOUBLE) * ({c} - (SELECT med FROM m_{c})) / (SELECT mad FROM d_{c}) WHEN (SELECT sd FROM m_{c}) > 0 THEN ({c} - (SELECT mean FROM m_{c})) / (SELECT sd FROM m_{c}) ELSE {c} * 0 END)"


@query(f"WITH {A.SEG}, b AS (SELECT audio_id, seg_id, value, rms, CAST(CASE WHEN seg_id % 10 = 0 THEN 1 ELSE 0 END AS DOUBLE) AS rare FROM seg), {_z_sql('value', 'b')}, {_z_sql('rms', 'b')}, {_z_sql('rare', 'b')} SELECT audio_id, seg_id, {R(_z('value'), 'z_value')}, {R(_z('rms'), 'z_rms')}, {R(_z('rare'), 'z_rare')} FROM b")
def robust_zscore_scaling(spark, d):
    b = A.segments(spark, d).select("audio_id", "seg_id", "value", "rms", F.when(F.col("seg_id") % 10 == 0, 1.0).otherwise(0.0).alias("rare"))
    return prosody.robust_scaled(b, ["value", "rms", "rare"]).select("audio_id", "seg_id", "z_value", "z_rms", "z_rare")


_FEATURES = sorted({c for w in prosody.SCORES.values() for c in w})
_FEAT = {c: f"CAST((seg_id * {7 + 4 * i}) % {101 + 6 * i} AS DOUBLE) + value / {3 + i}" for i, c in enumerate(_FEATURES)}
_RAW = {n: " + ".join(f"CAST({x} AS DOUBLE) * z_{c}" for c, x in w.items()) for n, w in prosody.SCORES.items()}


def _sc(n: str) -> str:
    return f"(CASE WHEN (SELECT hi_{n} FROM e) > (SELECT lo_{n} FROM e) THEN (least(greatest(raw_{n}, (SELECT lo_{n} FROM e)), (SELECT hi_{n} FROM e)) - (SELECT lo_{n} FROM e)) / ((SELECT hi_{n} FROM e) - (SELECT lo_{n} FROM e)) END)"


_PROS = f"""{A.SEG}, b AS (SELECT audio_id, seg_id, event_type, value, rms, event_type <> 'error' AS ok, {', '.join(f'{e} AS {c}' for c, e in _FEAT.items())} FROM seg), {', '.join(_z_sql(c, 'b') for c in _FEATURES)},
z AS (SELECT *, {', '.join(f'{_z(c)} AS z_{c}' for c in _FEATURES)} FROM b), w AS (SELECT *, {', '.join(f'{e} AS raw_{n}' for n, e in _RAW.items())} FROM z), e AS (SELECT {', '.join(f'quantile_cont(raw_{n}, 0.01) AS lo_{n}, quantile_cont(raw_{n}, 0.99) AS hi_{n}' for n in _RAW)} FROM w),
p AS (SELECT *, {', '.join(f'CASE WHEN ok THEN {_sc(n)} END AS {n}' for n in _RAW)}, CASE WHEN ok THEN 1 - {_sc('arousal')} END AS calm FROM w),
st AS (SELECT *, CASE WHEN NOT ok THEN 'sin_score' WHEN tension >= 0.75 THEN 'alta_tension_prosodica' WHEN arousal >= 0.75 THEN 'alta_activacion' WHEN calm >= 0.75 THEN 'calma_prosodica' ELSE 'neutral_prosodico' END AS prosodic_state FROM p)"""


def _prosodic(spark, d):
    s = A.segments(spark, d)
    feats = {c: ((F.col("seg_id") * (7 + 4 * i)) % (101 + 6 * i)).cast("double") + F.col("value") / (3 + i) for i, c in enumerate(_FEATURES)}
    return prosody.prosodic_scores(s.withColumns(feats), F.col("event_type") != "error")


@query(f"WITH {_PROS} SELECT audio_id, seg_id, {R('arousal', 'arousal_proxy_score')}, {R('tension', 'tension_proxy_score')}, {R('intensity', 'intensity_proxy_score')}, {R('calm', 'calm_proxy_score')}, prosodic_state FROM st")
def prosodic_state_scores(spark, d):
    return _prosodic(spark, d).select("audio_id", "seg_id", "arousal_proxy_score", "tension_proxy_score", "intensity_proxy_score", "calm_proxy_score", "prosodic_state")


@query(f"WITH {_OVER}, c AS (SELECT *, coalesce(overlap_s / nullif(end_s - start_s, 0), 0.0) AS ov, CASE seg_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'none' ELSE speaker END AS role FROM so) SELECT audio_id, seg_id, {R('end_s - start_s', 'duration_for_prosody')}, row_number() OVER (ORDER BY audio_id, start_s, end_s, seg_id) - 1 AS prosody_row_id FROM c WHERE end_s - start_s BETWEEN 600 AND 60000 AND round(ov, 9) <= 0.5 AND rms >= -45 AND role IS NOT NULL AND role <> 'none'")
def prosody_candidates(spark, d):
    k = F.col("seg_id") % 4
    s = intervals.scored(_overlapped(spark, d)).withColumn("overlap_ratio", F.round("overlap_ratio", 9)).withColumn("role", F.when(k == 1, "none").when(k > 1, F.col("speaker")))
    return prosody.candidates(s, (600.0, 60_000.0), 0.5).select("audio_id", "seg_id", "duration_for_prosody", "prosody_row_id")


_KEYSETS = [["audio_id"], ["speaker"], ["audio_id", "speaker"], ["event_type"]]


def _level_sql(ks: list[str]) -> str:
    keys = ", ".join(f"CAST({k if k in ks else 'NULL'} AS VARCHAR) AS {k}" for k in ("audio_id", "speaker", "event_type"))
    aggs = ", ".join(f"count({m}) AS {m}_count, {R(f'sum({m})', f'{m}_sum')}, {R(f'avg({m})', f'{m}_mean')}, {R(f'quantile_cont({m}, 0.5)', f'{m}_median')}, {R(f'max({m})', f'{m}_max')}" for m in ("value", "rms"))
    return f"SELECT '{'+'.join(ks)}' AS level, {keys}, {aggs} FROM seg GROUP BY {', '.join(ks)}"


@query(f"WITH {A.SEG} " + " UNION ALL ".join(map(_level_sql, _KEYSETS)))
def multi_key_rollup(spark, d):
    return prosody.aggregates(A.segments(spark, d), _KEYSETS, ["value", "rms"])


@query(f"WITH {A.SEG}, v AS (SELECT event_type, count(*) AS n FROM seg GROUP BY 1), x AS (SELECT CAST(n AS DOUBLE) AS n, count(*) AS k FROM v GROUP BY 1) SELECT n, {R('sum(k) OVER (ORDER BY n) / sum(k) OVER ()', 'share')} FROM x")
def value_ecdf(spark, d):
    per = A.segments(spark, d).groupBy("event_type").agg(F.count("*").cast("double").alias("n"))
    return prosody.ecdf(per, "n")


_FUSE = f"{_PROS}, fu AS (SELECT st.*, CASE WHEN seg_id % 5 < 4 THEN tension END AS a1, CASE WHEN seg_id % 3 > 0 THEN CAST(seg_id % 11 AS DOUBLE) / 5 - 1 END AS t1, CASE WHEN seg_id % 4 > 0 THEN speaker END AS role FROM st JOIN (SELECT seg_id, speaker FROM seg) USING (seg_id))"


def _fused(spark, d):
    p = _prosodic(spark, d)
    k = F.col("seg_id")
    p = p.withColumn("a1", F.when(k % 5 < 4, F.col("tension_proxy_score"))).withColumn("t1", F.when(k % 3 > 0, (k % 11).cast("double") / 5 - 1)).withColumn("role", F.when(k % 4 > 0, F.col("speaker")))
    return fusion.modalities(p, ["a1"], ["t1"])


@query(f"WITH {_FUSE} SELECT count(*) AS n, count(*) FILTER (a1 IS NOT NULL AND t1 IS NOT NULL) AS \"both\", count(*) FILTER (a1 IS NOT NULL AND t1 IS NULL) AS audio_only, count(*) FILTER (a1 IS NULL AND t1 IS NOT NULL) AS text_only, count(*) FILTER (a1 IS NULL AND t1 IS NULL) AS neither, {R('round(100 * count(*) FILTER (a1 IS NOT NULL AND t1 IS NOT NULL) / count(*), 1)', 'pct_both')} FROM fu")
def coverage_modalities(spark, d):
    return fusion.coverage(_fused(spark, d))


@query(f"WITH {A.SEG}, b AS (SELECT CAST(value AS DOUBLE) AS a, CAST(seg_id % 17 AS DOUBLE) AS b FROM seg WHERE seg_id % 3 > 0), r AS (SELECT a, b, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 AS rb FROM b) SELECT 'value' AS x, 'turn' AS y, count(*) AS n, {R('corr(a, b)', 'pearson')}, {R('corr(ra, rb)', 'spearman')} FROM r")
def correlations_pearson_spearman(spark, d):
    s = A.segments(spark, d).select("value", F.when(F.col("seg_id") % 3 > 0, (F.col("seg_id") % 17).cast("double")).alias("turn"))
    return fusion.correlations(s, [("value", "turn")])


@query(f"WITH {_FUSE} SELECT prosodic_state, count(*) FILTER (role = 'SPEAKER_00') AS SPEAKER_00, count(*) FILTER (role = 'SPEAKER_01') AS SPEAKER_01 FROM fu WHERE role IS NOT NULL GROUP BY prosodic_state")
def crosstab_state_label(spark, d):
    return fusion.crosstab(_fused(spark, d), "prosodic_state", "role", ["SPEAKER_00", "SPEAKER_01"])


_DIS = f"{_FUSE}, q AS (SELECT quantile_cont(tension, 0.75) AS qt, quantile_cont(arousal, 0.75) AS qa FROM fu WHERE a1 IS NOT NULL AND t1 IS NOT NULL), di AS (SELECT fu.*, coalesce(tension >= qt, false) OR coalesce(arousal >= qa, false) AS neg FROM fu, q WHERE a1 IS NOT NULL AND t1 IS NOT NULL)"


def _disagreed(both):
    return fusion.disagreement(both, ["tension_proxy_score", "arousal_proxy_score"], "t1")


def _disagreement(spark, d):
    return _disagreed(fusion.comparable(_fused(spark, d)))


@query(f"WITH {_DIS} SELECT audio_id, count(*) AS n, count(*) FILTER (neg) AS n_negative, count(*) FILTER (t1 >= 0 AND neg) AS n_masked, count(*) FILTER (t1 < 0 AND NOT neg) AS n_contained FROM di GROUP BY audio_id")
def disagreement_p75(spark, d):
    n = lambda c: F.sum(F.col(c).cast("long"))
    return _disagreement(spark, d).groupBy("audio_id").agg(F.count("*").alias("n"), n("audio_negative").alias("n_negative"), n("masked_frustration").alias("n_masked"), n("contained_negativity").alias("n_contained"))


@query(f"WITH {_DIS} SELECT role, count(*) AS n, {R('avg(tension)', 'mean_tension_proxy_score')}, {R('avg(t1)', 'mean_t1')}, {R('avg(CAST(t1 >= 0 AND neg AS INT))', 'mean_masked_frustration')} FROM di WHERE role IS NOT NULL GROUP BY role")
def role_fusion_aggregate(spark, d):
    return fusion.fused(_disagreement(spark, d), ["role"], ["tension_proxy_score", "t1", "masked_frustration"])


# --- roles and text alignment ---------------------------------------------------------------------


def _dialogues(spark, d):
    t = A.transcripts(spark, d)
    line = F.concat(F.when(F.col("role") == "AGENT", "Agente 1: ").when(F.col("role") == "CLIENT", "CLIENTE - ").otherwise(""), F.regexp_replace("text", "[:\\-]", " "))
    return t.groupBy("audio_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg_id", line.alias("l")))), lambda x: x["l"]), "\n").alias("dialogue"))


_WORD_RUNS = r"len(regexp_extract_all({0}, '[\p{{L}}\p{{N}}_]+'))"
_TURNS = rf"""{A.TXT}, ln AS (SELECT audio_id, seg_id, row_number() OVER (PARTITION BY audio_id ORDER BY seg_id, k) AS line, role, k, x FROM (SELECT audio_id, seg_id, role, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS k, unnest(string_split(regexp_replace(text, '[:\-]', ' ', 'g'), chr(10))) AS x FROM txt)),
hd AS (SELECT *, CASE WHEN k = 1 AND role IS NOT NULL THEN 1 ELSE 0 END AS h FROM ln), rn AS (SELECT *, sum(h) OVER (PARTITION BY audio_id ORDER BY line) AS raw FROM hd),
tu AS (SELECT audio_id, raw, arg_min(role, line) AS role, string_agg(trim(x), ' ' ORDER BY line) FILTER (trim(x) <> '') AS turn_text FROM rn WHERE raw > 0 GROUP BY audio_id, raw),
ot AS (SELECT audio_id, row_number() OVER (PARTITION BY audio_id ORDER BY raw) - 1 AS turn, role, turn_text FROM tu WHERE {_WORD_RUNS.format('turn_text')} >= 4 AND length(turn_text) >= 18)"""


def _turns(spark, d):
    return roles.official_turns(_dialogues(spark, d), "audio_id", "dialogue")


@query(f"WITH {_TURNS} SELECT audio_id, turn, role, md5(turn_text) AS text_md5 FROM ot")
def turns_parse_prefix(spark, d):
    return _turns(spark, d).select("audio_id", "turn", "role", F.md5("turn_text").alias("text_md5"))


@query(f"WITH {_TURNS} SELECT audio_id, turn, role FROM ot WHERE audio_id IN (SELECT audio_id FROM ot GROUP BY 1 HAVING count(DISTINCT role) = 2)")
def both_roles_filter(spark, d):
    return roles.with_both_roles(_turns(spark, d), "audio_id").select("audio_id", "turn", "role")


_PAIRS = f"dt AS (SELECT doc_id, {A.tokens_sql('text', X.STOPWORDS)} AS x FROM documents), bt AS (SELECT item_id, {A.tokens_sql('text', X.STOPWORDS)} AS y FROM benchmark), pr AS (SELECT *, len(list_intersect(x, y)) AS k FROM dt, bt), sc AS (SELECT doc_id, item_id, k / least(len(x), len(y)) AS c, k / (len(x) + len(y) - k) AS j FROM pr WHERE k > 0), bs AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY c DESC, j DESC, item_id) AS rn FROM sc)"


@query(f"WITH {_PAIRS} SELECT doc_id, item_id, {R('c', 'containment')}, {R('j', 'jaccard')} FROM bs WHERE rn = 1")
def token_containment_jaccard(spark, d):
    return textjoin.best_items(A.table(spark, d, "documents"), A.table(spark, d, "benchmark"))


_TFIDF = rf"""{A.TXT}, tt AS (SELECT audio_id, 't' || seg_id AS id, text FROM txt WHERE role = 'CLIENT'), wt AS (SELECT audio_id, 'w' || seg_id AS id, text FROM txt WHERE role = 'AGENT'), ids AS (SELECT * FROM tt UNION ALL SELECT * FROM wt),
wd AS (SELECT audio_id, id, ' ' || w || ' ' AS w FROM (SELECT audio_id, id, unnest(string_split(trim(regexp_replace(regexp_replace(strip_accents(lower(text)), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g')), ' ')) AS w FROM ids) WHERE w <> ''),
gr AS (SELECT audio_id, id, substr(w, i, n) AS gram FROM (SELECT audio_id, id, w, n, unnest(range(1, length(w) - n + 2)) AS i FROM wd, (VALUES (3), (4), (5)) v(n) WHERE length(w) >= n)),
tf AS (SELECT audio_id, id, gram, count(*) AS tf FROM gr GROUP BY ALL), nn AS (SELECT audio_id, count(*) AS n FROM ids GROUP BY 1), df AS (SELECT audio_id, gram, count(*) AS df FROM tf GROUP BY ALL),
w1 AS (SELECT tf.*, tf * (ln((1 + n) / (1 + df)) + 1) AS w FROM tf JOIN df USING (audio_id, gram) JOIN nn USING (audio_id)), l AS (SELECT audio_id, id, sqrt(sum(w * w)) AS len FROM w1 GROUP BY ALL), ww AS (SELECT w1.audio_id, w1.id, gram, w / len AS w FROM w1 JOIN l USING (audio_id, id)),
cs AS (SELECT a.audio_id, a.id AS ta, b.id AS tb, sum(a.w * b.w) AS cosine FROM ww a JOIN ww b ON a.audio_id = b.audio_id AND a.gram = b.gram WHERE a.id LIKE 't%' AND b.id LIKE 'w%' GROUP BY ALL),
pt AS (SELECT cs.*, {A.tokens_sql('tt.text', X.STOPWORDS)} AS x, {A.tokens_sql('wt.text', X.STOPWORDS)} AS y FROM cs JOIN tt ON tt.audio_id = cs.audio_id AND tt.id = ta JOIN wt ON wt.audio_id = cs.audio_id AND wt.id = tb),
cm AS (SELECT *, CASE WHEN len(x) = 0 OR len(y) = 0 THEN 0 ELSE len(list_intersect(x, y)) / least(len(x), len(y)) END AS cont FROM pt), sc AS (SELECT *, CAST(0.65 AS DOUBLE) * cosine + CAST(0.35 AS DOUBLE) * cont AS comb FROM cm),
bs AS (SELECT *, row_number() OVER w AS rn, lead(comb) OVER w AS sec FROM sc WINDOW w AS (PARTITION BY audio_id, ta ORDER BY comb DESC, CAST(substr(tb, 2) AS BIGINT))),
al AS (SELECT audio_id, CAST(substr(ta, 2) AS BIGINT) AS turn, CAST(substr(tb, 2) AS BIGINT) AS win, cosine, cont, comb, comb - coalesce(sec, 0.0) AS margin FROM bs WHERE rn = 1)"""


def _aligned(spark, d):
    t = A.transcripts(spark, d)
    turns = t.filter("role = 'CLIENT'").select("audio_id", F.col("seg_id").alias("turn"), F.col("text").alias("turn_text"))
    wins = t.filter("role = 'AGENT'").select("audio_id", F.col("seg_id").alias("window"), F.col("text").alias("window_text"))
    return roles.aligned(turns, wins, "audio_id", accept=(0.2, 0.1, 0.05, 0.001))


@query(f"WITH {_TFIDF} SELECT audio_id, turn, {R('cosine', 'cosine')}, {R('cont', 'containment')}, {R('comb', 'combined')}, {R('margin', 'margin')} FROM al")
def char_ngram_tfidf_alignment(spark, d):
    return _aligned(spark, d).select("audio_id", "turn", "cosine", "containment", "combined", "margin")


_SENS = (0.1, 0.2, 0.3, 0.4, 0.5)


@query(f"WITH {_TFIDF}, th(threshold) AS (VALUES {', '.join(f'(CAST({t} AS DOUBLE))' for t in _SENS)}), u AS (SELECT audio_id, comb, 'combined' AS metric, comb AS value FROM al UNION ALL SELECT audio_id, comb, 'cosine', cosine FROM al UNION ALL SELECT audio_id, comb, 'containment', cont FROM al) SELECT metric, threshold, count(*) FILTER (value >= threshold) AS n, count(DISTINCT CASE WHEN value >= threshold THEN audio_id END) AS n_calls, {R('avg(CASE WHEN value >= threshold THEN comb END)', 'mean_combined')} FROM u, th GROUP BY metric, threshold")
def match_threshold_sensitivity(spark, d):
    return roles.threshold_sensitivity(_aligned(spark, d), "audio_id", ["combined", "cosine", "containment"], _SENS)


_EVID = f"""{A.TXT}, eb AS (SELECT audio_id, seg_id, start_s, text, n_words, CAST(seg_id % 2 AS VARCHAR) AS speaker, end_s - start_s AS dur, CAST(seg_id % 3 AS DOUBLE) / 20 AS ov FROM txt WHERE n_words >= 3 AND end_s - start_s > 0),
ep AS (SELECT *, sum(CAST(ov <= 0.05 AS INT)) OVER w >= 2 AND sum(CASE WHEN ov <= 0.05 THEN dur ELSE 0 END) OVER w >= 6 AND sum(CASE WHEN ov <= 0.05 THEN n_words ELSE 0 END) OVER w >= 15 AS strict FROM eb WINDOW w AS (PARTITION BY audio_id, speaker)),
er AS (SELECT *, row_number() OVER w AS rn, coalesce(sum(dur) OVER (PARTITION BY audio_id, speaker ORDER BY ov, n_words DESC, dur DESC, start_s, seg_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bef FROM ep WHERE NOT strict OR ov <= 0.05 WINDOW w AS (PARTITION BY audio_id, speaker ORDER BY ov, n_words DESC, dur DESC, start_s, seg_id)),
ev AS (SELECT audio_id, speaker, string_agg(trim(text), ' ' ORDER BY rn) AS evidence_text, count(*) AS n_rows, CAST(sum(n_words) AS BIGINT) AS n_words, sum(dur) AS seconds FROM er WHERE rn <= 10 AND bef < 25 GROUP BY ALL)"""


def _evidence(spark, d):
    t = A.transcripts(spark, d)
    t = t.withColumn("speaker", (F.col("seg_id") % 2).cast("string")).withColumn("duration_s", F.col("end_s") - F.col("start_s")).withColumn("overlap_ratio", (F.col("seg_id") % 3).cast("double") / 20)
    return roles.evidence(t, ["audio_id", "speaker"])


@query(f"WITH {_EVID} SELECT audio_id, speaker, md5(evidence_text) AS text_md5, n_rows, n_words, {R('seconds', 'seconds')}, CASE WHEN n_rows < 2 THEN 'low_segment_count' WHEN seconds < 6 THEN 'low_duration' WHEN n_words < 15 THEN 'low_word_count' ELSE 'sufficient_evidence' END AS evidence_status FROM ev")
def role_evidence_cumulative_stop(spark, d):
    return _evidence(spark, d).select("audio_id", "speaker", F.md5("evidence_text").alias("text_md5"), "n_rows", "n_words", "seconds", "evidence_status")


_ASSIGNED = f"""{A.TXT}, s1 AS (SELECT audio_id, CAST(seg_id % 3 AS VARCHAR) AS speaker, sum(n_words) AS evidence, avg(CASE WHEN role = 'AGENT' THEN 1.0 ELSE 0.0 END) AS a, avg(CASE WHEN role = 'CLIENT' THEN 1.0 ELSE 0.0 END) AS c FROM txt GROUP BY ALL),
s2 AS (SELECT *, row_number() OVER (PARTITION BY audio_id ORDER BY evidence DESC, speaker) AS rn FROM s1), s3 AS (SELECT audio_id, max(CASE WHEN rn = 1 THEN speaker END) AS x, max(CASE WHEN rn = 2 THEN speaker END) AS y, coalesce(max(CASE WHEN rn = 1 THEN a END), 0) + coalesce(max(CASE WHEN rn = 2 THEN c END), 0) AS st, coalesce(max(CASE WHEN rn = 1 THEN c END), 0) + coalesce(max(CASE WHEN rn = 2 THEN a END), 0) AS cr FROM s2 WHERE rn <= 2 GROUP BY audio_id)"""


@query(f"WITH {_ASSIGNED} SELECT audio_id, CASE WHEN st >= cr THEN x ELSE y END AS agent_speaker, CASE WHEN st >= cr THEN y ELSE x END AS client_speaker, {R('greatest(st, cr)', 'pair_score')}, {R('greatest(st, cr) - least(st, cr)', 'pair_margin')}, CASE WHEN y IS NULL THEN 'less_than_two_speakers_with_evidence' WHEN greatest(st, cr) < 0.1 THEN 'rejected_low_aggregate_score' WHEN greatest(st, cr) - least(st, cr) < 0.01 THEN 'assigned_low_margin_aggregate_text' ELSE 'accepted_speaker_role' END AS status FROM s3")
def speaker_role_assignment(spark, d):
    t = A.transcripts(spark, d).withColumn("speaker", (F.col("seg_id") % 3).cast("string"))
    per = t.groupBy("audio_id", "speaker").agg(F.sum("n_words").alias("evidence"), *[F.avg(F.when(F.col("role") == r, 1.0).otherwise(0.0)).alias(r) for r in ("AGENT", "CLIENT")])
    scores = per.select("audio_id", "speaker", "evidence", F.explode(F.array(*[F.struct(F.lit(r).alias("role"), F.col(r).alias("score")) for r in ("AGENT", "CLIENT")])).alias("x")).select("audio_id", "speaker", "evidence", "x.*")
    return roles.role_pairs(scores, "audio_id")


_STRICT = f"""{A.TXT}, m AS (SELECT audio_id, CAST(seg_id % 2 AS VARCHAR) AS speaker, role FROM txt WHERE role IS NOT NULL), c AS (SELECT audio_id, speaker, role, count(*) AS n FROM m GROUP BY ALL), p AS (SELECT *, n / sum(n) OVER (PARTITION BY audio_id, speaker) AS purity FROM c),
g AS (SELECT *, row_number() OVER (PARTITION BY audio_id, role ORDER BY n DESC, purity DESC, speaker) AS rn FROM p WHERE n >= 2 AND purity >= 0.7), b AS (SELECT * FROM g WHERE rn = 1), ok AS (SELECT audio_id FROM b GROUP BY 1 HAVING count(*) = 2 AND count(DISTINCT speaker) = 2)"""


def _strict(spark, d):
    t = A.transcripts(spark, d).filter("role IS NOT NULL").withColumn("speaker", (F.col("seg_id") % 2).cast("string"))
    return roles.strict_mapping(t, "audio_id")


@query(f"WITH {_STRICT} SELECT audio_id, speaker, role, n, {R('purity', 'purity')} FROM b WHERE audio_id IN (SELECT audio_id FROM ok)")
def strict_role_mapping(spark, d):
    return _strict(spark, d)


@query(f"WITH {_STRICT}, mp AS (SELECT audio_id, speaker, role FROM b WHERE audio_id IN (SELECT audio_id FROM ok)) SELECT t.audio_id, t.seg_id, mp.role AS role_proxy, row_number() OVER (PARTITION BY t.audio_id ORDER BY start_s, end_s, seg_id) - 1 AS ordinal FROM txt t LEFT JOIN mp ON mp.audio_id = t.audio_id AND mp.speaker = CAST(t.seg_id % 2 AS VARCHAR)")
def propagate_roles(spark, d):
    t = A.transcripts(spark, d).drop("role").withColumn("speaker", (F.col("seg_id") % 2).cast("string"))
    return roles.propagated(t, _strict(spark, d).select("audio_id", "speaker", F.col("role").alias("role_proxy")), ["audio_id", "speaker"]).select("audio_id", "seg_id", "role_proxy", "ordinal")


_PART = "CASE WHEN CAST('0x' || substr(sha256('split|' || audio_id), 1, 8) AS BIGINT) % 100 < 70 THEN 'train' ELSE 'test' END"


_HOLD = f"{A.TXT}, x AS (SELECT *, {_PART} AS part, CAST(seg_id % 2 AS VARCHAR) AS speaker2 FROM txt WHERE role IS NOT NULL), l AS (SELECT speaker2, role AS predicted FROM (SELECT speaker2, role, row_number() OVER (PARTITION BY speaker2 ORDER BY count(*) DESC, role) AS rn FROM x WHERE part = 'train' GROUP BY speaker2, role) WHERE rn = 1), t AS (SELECT x.role, predicted FROM x JOIN l USING (speaker2) WHERE part = 'test')"


def _held_out(spark, d):
    """Held-out turns with the role that their speaker has most often in the others."""
    t = A.transcripts(spark, d).filter("role IS NOT NULL").withColumn("speaker2", (F.col("seg_id") % 2).cast("string")).withColumn("part", roles.holdout_part(F.col("audio_id")))
    counts = t.filter("part = 'train'").groupBy("speaker2", "role").agg(F.count("*").alias("n"))
    learnt = counts.groupBy("speaker2").agg(F.min_by("role", F.struct(-F.col("n"), "role")).alias("predicted"))
    return t.filter("part = 'test'").join(learnt, "speaker2")


@query(f"WITH {_HOLD}, p AS (SELECT role, count(*) AS n, count(*) FILTER (role = predicted) AS k FROM t GROUP BY 1) SELECT CAST(sum(n) AS BIGINT) AS n, {R('sum(k) / sum(n)', 'accuracy')}, {R('avg(k / n)', 'balanced_accuracy')}, count(*) AS n_classes FROM p")
def holdout_metrics(spark, d):
    return evaluation.holdout(_held_out(spark, d), ["audio_id"], "role", "predicted")


_OF = "count(*) FILTER (role = c AND predicted = c) AS hit, count(*) FILTER (predicted = c) AS said, count(*) FILTER (role = c) AS support"


@query(f"WITH {_HOLD}, k AS (SELECT c, {_OF} FROM t, (VALUES ('AGENT'), ('CLIENT')) v(c) GROUP BY c) SELECT c AS role, {R('coalesce(hit / nullif(said, 0), 0)', 'precision')}, {R('coalesce(hit / nullif(support, 0), 0)', 'recall')}, {R('coalesce(2 * hit / nullif(said + support, 0), 0)', 'f1')}, support FROM k")
def holdout_by_role(spark, d):
    return evaluation.by_class(_held_out(spark, d), "role", "predicted")


@query(f"WITH {_HOLD}, v(c) AS (VALUES ('AGENT'), ('CLIENT')) SELECT a.c AS truth, b.c AS predicted, (SELECT count(*) FROM t WHERE t.role = a.c AND t.predicted = b.c) AS n FROM v a, v b")
def holdout_confusion(spark, d):
    return evaluation.confusion_by_class(_held_out(spark, d), "role", "predicted")


@query(f"WITH {A.TXT} SELECT audio_id, seg_id, CASE WHEN regexp_matches(speaker, '^user$') THEN 'CLIENT' ELSE NULL END AS strict_role, CASE WHEN upper(trim(role)) IN ('AGENT', 'CLIENT') THEN upper(trim(role)) ELSE 'UNKNOWN' END AS plain_role, printf('%02d:%02d', CAST(floor(start_s / 60) AS INT), CAST(start_s % 60 AS INT)) AS clock FROM (SELECT * FROM txt)")
def labels_and_clock(spark, d):
    t = A.transcripts(spark, d)
    return t.select("audio_id", "seg_id", L.strict_role(F.when(F.col("speaker") == "user", "Cliente ").otherwise(F.col("speaker"))).alias("strict_role"), L.plain_role(F.col("role")).alias("plain_role"), X.clock(F.col("start_s")).alias("clock"))


# --- voices ---------------------------------------------------------------------------------------


@query(f"WITH {_SCORED} SELECT audio_id, seg_id FROM sc WHERE len_s BETWEEN 600 AND 60000 AND overlap_ratio <= 0.5 AND rms >= -40 AND len(dr) = 0")
def voice_filter(spark, d):
    s = _scored(spark, d).withColumn("role", F.lit("AGENT")).withColumn("person_id", F.col("audio_id"))
    return voiceprint.usable_segments(s, (600.0, 60_000.0), 0.5, -40.0).select("audio_id", "seg_id")


_UNIT = "u AS (SELECT *, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS un FROM vec)"


def _flat_vectors(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    return df.select(*keys, F.posexplode(column).alias("i", "x"))


@query(f"WITH {A.VEC}, e AS (SELECT person_id, unnest(range(0, 64)) AS i, unnest(v) AS x FROM vec) SELECT person_id, i, {R('avg(x)', 'x')} FROM e GROUP BY ALL")
def centroids_by_person(spark, d):
    return _flat_vectors(mean_vectors(A.vectors(spark, d), ["person_id"], "v"), ["person_id"], "centroid")


_SAMPLES = f"{A.VEC}, {_UNIT}, e AS (SELECT person_id, audio_key, unnest(range(0, 64)) AS i, unnest(un) AS x FROM u), m AS (SELECT person_id, audio_key, i, avg(x) AS x FROM e GROUP BY ALL), nn AS (SELECT person_id, audio_key, sqrt(sum(x * x)) AS n FROM m GROUP BY ALL), f AS (SELECT person_id, audio_key, count(*) AS n_segments, sum(seconds) AS seconds FROM vec GROUP BY ALL)"


def _samples(spark, d):
    return voiceprint.person_samples(A.vectors(spark, d).withColumnRenamed("seconds", "duration_s"), ["person_id", "audio_key"])


@query(f"WITH {_SAMPLES}, id AS (SELECT *, printf('S%06d', row_number() OVER (ORDER BY person_id, audio_key) - 1) AS sample_id FROM f) SELECT person_id, audio_key, n_segments, {R('seconds', 'seconds')}, sample_id, {R('(SELECT x / n FROM m JOIN nn USING (person_id, audio_key) WHERE m.person_id = id.person_id AND m.audio_key = id.audio_key AND i = 0)', 'first_component')} FROM id")
def audio_person_samples(spark, d):
    return _samples(spark, d).select("person_id", "audio_key", "n_segments", "seconds", "sample_id", F.get("sample_vector", F.lit(0)).alias("first_component"))


@query(f"WITH {A.VEC}, f AS (SELECT person_id, audio_key, sum(seconds) AS seconds FROM vec GROUP BY ALL) SELECT person_id, count(*) AS n_samples, {R('sum(seconds)', 'seconds')}, count(*) >= 3 AND sum(seconds) >= 10 AS eligible FROM f GROUP BY person_id")
def identity_eligibility(spark, d):
    return voiceprint.eligible(_samples(spark, d), min_samples=3, min_seconds=10.0)


@query(f"WITH {A.VEC}, p AS (SELECT DISTINCT person_id FROM vec), a AS (SELECT person_id, row_number() OVER (ORDER BY sha256('pairs|' || person_id), person_id) AS r, row_number() OVER (ORDER BY sha256('open|' || person_id), person_id) AS o, count(*) OVER () AS n FROM p), b AS (SELECT *, greatest(1, CAST(round(0.2 * n) AS BIGINT)) AS nu FROM a), c AS (SELECT *, greatest(1, CAST(round(0.3 * (n - nu)) AS BIGINT)) AS nt FROM b) SELECT person_id, CASE WHEN r <= ceil(0.3 * n) THEN 'test' ELSE 'train' END AS pair_part, CASE WHEN o <= nu THEN 'unknown' WHEN o <= nu + nt THEN 'known_test' ELSE 'calibration' END AS open_part FROM c")
def identity_split_disjoint(spark, d):
    p = A.vectors(spark, d).select("person_id").distinct()
    a = voiceprint.identity_split(p).withColumnRenamed("part", "pair_part")
    b = voiceprint.open_set_split(p).withColumnRenamed("part", "open_part")
    return a.join(b, "person_id")


def _dot(a: str, b: str) -> str:
    return f"list_sum(list_transform(range(1, len({a}) + 1), lambda i: {a}[i] * {b}[i]))"


def _cos(a: str, b: str) -> str:
    return f"{_dot(a, b)} / (sqrt({_dot(a, a)}) * sqrt({_dot(b, b)}))"


_GENUINE = f"""{A.VEC}, so AS (SELECT *, sha256('pairs|' || sample_id) AS o FROM vec), tn AS (SELECT *, row_number() OVER (PARTITION BY person_id, audio_key ORDER BY o, sample_id) AS turn FROM so),
fw AS (SELECT * FROM tn QUALIFY row_number() OVER (PARTITION BY person_id ORDER BY turn, o, sample_id) <= 64),
g AS (SELECT a.sample_id AS a, b.sample_id AS b, a.v AS va, b.v AS vb FROM fw a JOIN fw b ON a.person_id = b.person_id AND a.sample_id < b.sample_id QUALIFY row_number() OVER (PARTITION BY a.person_id ORDER BY a.audio_key = b.audio_key, sha256('pairs|' || a.sample_id || '/' || b.sample_id), a.sample_id, b.sample_id) <= 500)"""
_IMPOSTOR = f"""{_GENUINE}, wt AS (SELECT least(3 * count(*), 200000) AS w FROM g), pl AS (SELECT person_id, sample_id, v, row_number() OVER (ORDER BY o, sample_id) AS i, count(*) OVER () AS n FROM so),
st AS (SELECT pl.*, w, unnest(range(1, least(CAST(ceil(w / n) AS BIGINT) * 2 + 2, n - 1) + 1)) AS k FROM pl, wt WHERE i <= w AND n > 1),
mx AS (SELECT DISTINCT least(st.sample_id, q.sample_id) AS a, greatest(st.sample_id, q.sample_id) AS b, w FROM st JOIN pl q ON q.i = (st.i + k - 1) % st.n + 1 WHERE st.person_id <> q.person_id),
im AS (SELECT a, b FROM mx QUALIFY row_number() OVER (ORDER BY sha256('pairs|' || a || '/' || b), a) <= w)"""


def _pairs(spark, d):
    return voiceprint.verification_pairs(A.vectors(spark, d), recording="audio_key")


@query(f"WITH {_GENUINE} SELECT a, b, {R(_cos('va', 'vb'), 'cosine')} FROM g")
def verification_genuine_pairs(spark, d):
    return _pairs(spark, d).filter("same = 1").select("a", "b", "cosine")


@query(f"WITH {_IMPOSTOR} SELECT a, b, {R(_cos('x.v', 'y.v'), 'cosine')} FROM im JOIN vec x ON x.sample_id = a JOIN vec y ON y.sample_id = b")
def verification_impostor_pairs(spark, d):
    return _pairs(spark, d).filter("same = 0").select("a", "b", "cosine")


@query(f"WITH {_IMPOSTOR}, k(same, n) AS (SELECT 1, count(*) FROM g UNION ALL SELECT 0, count(*) FROM im) SELECT CAST(same AS BIGINT) AS same, CAST(n AS BIGINT) AS n, true AS distinct_persons_hold FROM k WHERE n > 0")
def verification_pair_counts(spark, d):
    v = A.vectors(spark, d).select("sample_id", "person_id")
    p = _pairs(spark, d).join(v.select(F.col("sample_id").alias("a"), F.col("person_id").alias("pa")), "a").join(v.select(F.col("sample_id").alias("b"), F.col("person_id").alias("pb")), "b")
    right = (F.col("pa") == F.col("pb")) == (F.col("same") == 1)
    return p.groupBy("same").agg(F.count("*").alias("n"), F.min(right).alias("distinct_persons_hold"))


_ROC = f"{A.DOC}, lv AS (SELECT s AS threshold, sum(CAST(y = 1 AS INT)) AS p, sum(CAST(y = 0 AS INT)) AS n FROM doc GROUP BY 1), rc AS (SELECT threshold, sum(p) OVER w / sum(p) OVER () AS tpr, sum(n) OVER w / sum(n) OVER () AS fpr FROM lv WINDOW w AS (ORDER BY threshold DESC))"


@query(f"WITH {_ROC} SELECT (SELECT threshold FROM rc ORDER BY round(abs(fpr - (1 - tpr)), 12), threshold DESC LIMIT 1) AS eer_threshold, {R('(SELECT (fpr + 1 - tpr) / 2 FROM rc ORDER BY round(abs(fpr - (1 - tpr)), 12), threshold DESC LIMIT 1)', 'eer')}, (SELECT threshold FROM rc ORDER BY round(tpr - fpr, 12) DESC, threshold DESC LIMIT 1) AS youden_threshold, {R('(SELECT tpr - fpr FROM rc ORDER BY round(tpr - fpr, 12) DESC, threshold DESC LIMIT 1)', 'youden')}")
def roc_eer_youden(spark, d):
    return evaluation.thresholds(A.documents(spark, d))


@query(f"WITH {A.DOC}, r AS (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS k FROM doc), a AS (SELECT count(*) FILTER (y = 1) AS n_pos, count(*) FILTER (y = 0) AS n_neg, sum(k) FILTER (y = 1) AS sk FROM r), c AS (SELECT count(*) FILTER (s >= 40 AND y = 1) AS tp, count(*) FILTER (s >= 40 AND y = 0) AS fp, count(*) FILTER (s < 40 AND y = 1) AS fn, count(*) FILTER (s < 40 AND y = 0) AS tn FROM doc) SELECT n_pos, n_neg, {R('(sk - n_pos * (n_pos + 1) / 2.0) / (n_pos * n_neg)', 'auc')}, tp, fp, fn, tn, {R('(tp + tn) / (tp + fp + fn + tn)', 'accuracy')}, {R('tp / (tp + fp)', 'precision')}, {R('tp / (tp + fn)', 'recall')}, {R('2 * tp / (2 * tp + fp + fn)', 'f1')} FROM a, c")
def auc_confusion_f1(spark, d):
    doc = A.documents(spark, d)
    return evaluation.auc(doc).crossJoin(evaluation.confusion(doc, 40.0))


@query(f"WITH {A.DOC} SELECT CAST(y AS BIGINT) AS y, count(*) AS n, {R('avg(s)', 'mean_score')}, {R('quantile_cont(s, 0.5)', 'median_score')} FROM doc GROUP BY y")
def pair_score_summary(spark, d):
    return evaluation.pair_summary(A.documents(spark, d))


_PARTS = f"""{A.VEC}, {_UNIT}, cn AS (SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY sha256('calls|' || sample_id), sample_id) AS cr, count(*) OVER (PARTITION BY person_id) AS pn FROM u),
us AS (SELECT * EXCLUDE (cr, pn), cr <= least(greatest(1, CAST(round(0.3 * pn) AS BIGINT)), greatest(pn - 2, 0)) AS asked FROM cn),
ps AS (SELECT person_id, row_number() OVER (ORDER BY sha256('open|' || person_id), person_id) > greatest(1, CAST(round(0.2 * count(*) OVER ()) AS BIGINT)) AS known FROM (SELECT DISTINCT person_id FROM vec)),
en AS (SELECT * FROM us WHERE NOT asked)"""


def _centre(keys: str, rows: str) -> str:
    """Unit centroids of ``rows`` by ``keys`` as ``pf``."""
    return f"e AS (SELECT {keys}, unnest(range(0, 64)) AS i, unnest(un) AS x FROM {rows}), m AS (SELECT {keys}, i, avg(x) AS x FROM e GROUP BY ALL), n AS (SELECT {keys}, sqrt(sum(x * x)) AS n FROM m GROUP BY ALL), pf AS (SELECT {keys}, list(x / n ORDER BY i) AS profile FROM m JOIN n USING ({keys}) GROUP BY ALL)"


_PROF = f"{_PARTS}, {_centre('person_id', 'en')}"


def _uses(spark, d):
    """All samples, dealt within each person into enrolment and queries."""
    return voiceprint.call_split(A.vectors(spark, d))


def _known(spark, d):
    """Persons who are enrolled; the others are unknown."""
    return voiceprint.open_set_split(A.vectors(spark, d).select("person_id").distinct()).filter("part <> 'unknown'").select("person_id")


def _profiles(spark, d):
    return voiceprint.profiles(_uses(spark, d).filter("use = 'enrolment'"))


@query(f"WITH {_PROF}, w AS (SELECT en.person_id, {_dot('un', 'profile')} AS s FROM en JOIN pf USING (person_id)) SELECT person_id, count(*) AS n_vectors, {R('avg(s)', 'within_mean')}, {R('stddev_pop(s)', 'within_std')}, {R('min(s)', 'within_min')}, {R('max(s)', 'within_max')} FROM w GROUP BY person_id")
def speaker_profiles(spark, d):
    return _profiles(spark, d).select("person_id", "n_vectors", "within_mean", "within_std", "within_min", "within_max")


_FOUND = f"{_PROF}, q AS (SELECT * FROM us WHERE asked), sc AS (SELECT sample_id, q.person_id AS truth, pf.person_id AS best, {_dot('un', 'profile')} AS s FROM q, pf WHERE pf.person_id IN (SELECT person_id FROM ps WHERE known)), rk AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY s DESC, best) AS rn, lead(s) OVER (PARTITION BY sample_id ORDER BY s DESC, best) AS second FROM sc), fd AS (SELECT rk.*, known FROM rk JOIN ps ON person_id = truth WHERE rn = 1)"


def _found(spark, d):
    return voiceprint.identified(_uses(spark, d).filter("use = 'query'"), voiceprint.centres(_uses(spark, d).filter("use = 'enrolment'").join(_known(spark, d), "person_id", "left_semi")))


@query(f"WITH {_FOUND} SELECT sample_id, CAST(truth AS BIGINT) AS truth, CAST(best AS BIGINT) AS best, {R('s', 'best_score')}, {R('second', 'second_score')}, {R('s - second', 'margin')} FROM fd")
def open_set_top1_top2(spark, d):
    return _found(spark, d)


@query(f"WITH {_FOUND}, de AS (SELECT *, s >= 0.3 AS yes, CASE WHEN known THEN s >= 0.3 AND best = truth ELSE s < 0.3 END AS ok FROM fd) SELECT count(*) FILTER (known) AS n_known, count(*) FILTER (NOT known) AS n_unknown, {R('count(*) FILTER (known AND ok) / count(*) FILTER (known)', 'identification_rate')}, {R('count(*) FILTER (known AND NOT yes) / count(*) FILTER (known)', 'false_rejection_rate')}, {R('count(*) FILTER (NOT known AND yes) / count(*) FILTER (NOT known)', 'false_acceptance_rate')}, {R('count(*) FILTER (ok) / count(*)', 'overall_accuracy')} FROM de")
def open_set_decision_metrics(spark, d):
    return evaluation.open_set_metrics(voiceprint.open_set_decisions(_found(spark, d), _known(spark, d), 0.3))


@query(f"WITH {_PARTS}, {_centre('audio_key, person_id', 'en')}, di AS (SELECT sample_id, u.person_id, pf.person_id AS name, 1 - {_cos('v', 'profile')} AS d FROM u JOIN pf ON u.audio_key = pf.audio_key), rk AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY d, name) AS rn, lead(d) OVER (PARTITION BY sample_id ORDER BY d, name) AS d2 FROM di) SELECT sample_id, {R('d', 'distance')}, {R('d2 - d', 'margin')}, CAST(CASE WHEN d IS NULL OR d2 - d < 0.01 THEN u.person_id ELSE name END AS BIGINT) AS speaker_final FROM u LEFT JOIN rk USING (sample_id) WHERE rn IS NULL OR rn = 1")
def nearest_centroid_relabel(spark, d):
    """All samples against the centroids of their own recording's speakers."""
    c = mean_vectors(_uses(spark, d).filter("use = 'enrolment'").withColumn("u", unit(F.col("v"))), ["audio_key", "person_id"], "u").withColumnRenamed("person_id", "speaker")
    q = A.vectors(spark, d).select("audio_key", "sample_id", F.col("person_id").alias("speaker"), "v")
    return voiceprint.nearest_centroid(q, c, ["audio_key"], tie="sample_id").select("sample_id", "distance", "margin", "speaker_final")


# --- audits ---------------------------------------------------------------------------------------

_CHECKS = [audits.Check("rows", "n >= 20"), audits.Check("two_speakers", "speakers = 2"), audits.Check("unique_ids", "ids = n"), audits.Check("no_negative_length", "shortest >= 0"), audits.Check("long_enough", "seconds > 100000")]


@query(f"WITH {A.SEG}, a AS (SELECT audio_id, count(*) AS n, count(DISTINCT speaker) AS speakers, count(DISTINCT seg_id) AS ids, min(end_s - start_s) AS shortest, sum(end_s - start_s) AS seconds FROM seg GROUP BY 1), f AS (SELECT *, list_filter([CASE WHEN NOT n >= 20 THEN 'rows' END, CASE WHEN NOT speakers = 2 THEN 'two_speakers' END, CASE WHEN NOT ids = n THEN 'unique_ids' END, CASE WHEN NOT shortest >= 0 THEN 'no_negative_length' END, CASE WHEN NOT seconds > 100000 THEN 'long_enough' END], lambda x: x IS NOT NULL) AS l FROM a) SELECT audio_id, n, speakers, array_to_string(l, ',') AS failed_checks, len(l) = 0 AS valid FROM f")
def data_quality_rules(spark, d):
    length = F.col("end_s") - F.col("start_s")
    aggs = [F.count("*").alias("n"), F.count_distinct("speaker").alias("speakers"), F.count_distinct("seg_id").alias("ids"), F.min(length).alias("shortest"), F.sum(length).alias("seconds")]
    return audits.audited(A.segments(spark, d), ["audio_id"], aggs, _CHECKS).select("audio_id", "n", "speakers", "failed_checks", "valid")


@query(f"WITH {A.SEG}, x AS (SELECT speaker, lead(speaker) OVER (PARTITION BY audio_id ORDER BY start_s, end_s, seg_id) AS nxt FROM seg) SELECT speaker, count(*) FILTER (nxt = 'SPEAKER_00') AS SPEAKER_00, count(*) FILTER (nxt = 'SPEAKER_01') AS SPEAKER_01, {R('count(*) FILTER (nxt = ' + repr('SPEAKER_00') + ') / count(nxt)', 'share_SPEAKER_00')}, {R('count(*) FILTER (nxt = ' + repr('SPEAKER_01') + ') / count(nxt)', 'share_SPEAKER_01')} FROM x GROUP BY speaker")
def transition_matrix(spark, d):
    from pyspark.sql import Window

    order = Window.partitionBy("audio_id").orderBy("start_s", "end_s", "seg_id")
    s = A.segments(spark, d).withColumn("next", F.lead("speaker").over(order))
    return audits.transition_matrix(s, "speaker", "next", ["SPEAKER_00", "SPEAKER_01"])


# --- summaries ------------------------------------------------------------------------------------


@query(f"WITH {_SCORED}, o AS (SELECT audio_id, count(*) AS n_regions, sum(b - a) AS region_s FROM ovl GROUP BY 1), s AS (SELECT audio_id, count(*) AS n_segments, count(DISTINCT speaker) AS n_speakers, max(end_s) AS last_s, count(*) FILTER (len(dr) = 0) AS n_valid_export, count(*) FILTER (len(ar) = 0) AS n_valid_anchor FROM sc GROUP BY 1) SELECT audio_id, n_segments, n_speakers, {R('last_s', 'last_s')}, n_valid_export, n_valid_anchor, coalesce(n_regions, 0) AS n_regions, {R('coalesce(region_s, 0)', 'region_s')}, {R('n_valid_export / n_segments', 'valid_share')}, {R('n_valid_anchor / n_segments', 'anchor_share')} FROM s LEFT JOIN o USING (audio_id)")
def recording_summary(spark, d):
    return summaries.quality_table(summaries.recording_summary(_scored(spark, d), intervals.overlap_regions(A.segments(spark, d)), ["audio_id"]))


@query(f"WITH {A.TXT}, p AS (SELECT audio_id, count(DISTINCT speaker) AS k FROM txt GROUP BY 1) SELECT k AS n_speakers, count(*) AS n, {R('count(*) / sum(count(*)) OVER ()', 'share')} FROM p GROUP BY k")
def speakers_per_recording(spark, d):
    return summaries.speakers_per_recording(A.transcripts(spark, d), ["audio_id"])


_DBS = tuple(range(10, 55, 5))


@query(f"WITH {A.SEG}, p AS (SELECT audio_id, top_db, avg(CASE WHEN rms < -top_db THEN 1.0 ELSE 0.0 END) AS r FROM seg, (VALUES {', '.join(f'({x})' for x in _DBS)}) t(top_db) GROUP BY ALL) SELECT CAST(top_db AS BIGINT) AS top_db, count(r) AS n, {R('avg(r)', 'mean')}, {R('quantile_cont(r, 0.5)', 'median')}, {R('stddev_samp(r)', 'std')}, {R('min(r)', 'min')}, {R('max(r)', 'max')}, count(*) FILTER (r > 0.6) AS n_high FROM p GROUP BY top_db")
def silence_threshold_sweep(spark, d):
    steps = F.broadcast(spark.createDataFrame([(x,) for x in _DBS], "top_db int"))
    per = A.segments(spark, d).crossJoin(steps).groupBy("audio_id", "top_db").agg(F.avg(F.when(F.col("rms") < -F.col("top_db"), 1.0).otherwise(0.0)).alias("silence_ratio"))
    return summaries.silence_summary(per)


@query(f"WITH {A.VEC}, e AS (SELECT person_id, audio_key, unnest(range(0, 64)) AS i, unnest(v) AS x FROM vec), m AS (SELECT person_id, audio_key, list(x ORDER BY i) AS c FROM (SELECT person_id, audio_key, i, avg(x) AS x FROM e GROUP BY ALL) GROUP BY ALL) SELECT p.audio_key AS a, q.audio_key AS b, {R('max(' + _cos('p.c', 'q.c') + ')', 'similarity')} FROM m p JOIN m q ON p.person_id = q.person_id AND p.audio_key < q.audio_key GROUP BY ALL")
def speaker_similarity_between_recordings(spark, d):
    c = mean_vectors(A.vectors(spark, d), ["person_id", "audio_key"], "v").withColumnRenamed("person_id", "group")
    return summaries.speaker_similarity(c, "audio_key")


@query(f"WITH {A.DOC} SELECT CASE WHEN s < 10 THEN 0 WHEN s >= 90 THEN 9 ELSE CAST(floor((s - 10) / 10) AS BIGINT) + 1 END AS bin, count(*) AS n FROM doc GROUP BY 1")
def score_histogram(spark, d):
    return summaries.histogram(A.documents(spark, d), "s", 10.0, 90.0, 8)


@query("WITH c AS (SELECT c_custkey, c_nationkey || '.0' AS nk, CASE c_custkey % 4 WHEN 0 THEN ' nan ' ELSE c_name END AS nm FROM customer) SELECT c_custkey, regexp_replace(trim(nk), '\\.0$', '') AS nation, CASE WHEN lower(trim(nm)) IN ('', 'nan', 'none', '<na>') THEN NULL ELSE trim(nm) END AS name, CASE WHEN lower(trim(nm)) IN ('', 'nan', 'none', '<na>') THEN NULL ELSE substr(sha256('salt_' || trim(nm)), 1, 16) END AS name_hash FROM c")
def metadata_preparation(spark, d):
    c = A.table(spark, d, "customer").select("c_custkey", F.concat(F.col("c_nationkey").cast("string"), F.lit(".0")).alias("nation"), F.when(F.col("c_custkey") % 4 == 0, " nan ").otherwise(F.col("c_name")).alias("name"))
    return summaries.metadata(c, "salt", {"name": "name_hash"}, ["nation", "name"])


@query(f"WITH {_NAMES} SELECT CASE WHEN contains(lower(name), 'baja') THEN 'Bajas' WHEN regexp_matches(lower(name), 'comercial|venta') OR lower(name) LIKE 'raw\\_%' ESCAPE '\\' OR lower(name) IN ('raw', 'general') THEN 'Comerciales' ELSE 'No identificado' END AS corpus, count(*) AS n FROM nm GROUP BY 1")
def corpus_classification(spark, d):
    return _names(spark, d).groupBy(summaries.corpus_of(F.col("name")).alias("corpus")).agg(F.count("*").alias("n"))


from parlance.plans import reports  # noqa: E402,F401  (registers its queries)
