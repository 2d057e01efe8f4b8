"""Theme spotting by keywords, and calls ranked by how critical they are."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from parlance.functions.text import count_words, normalize_text
from parlance.operators.ranks import average_ranks

Lexicon = dict[str, list[str]]

#: The themes of a full lexicon, in order.
THEMES = (
    "baja_cancelacion", "facturacion_cobros", "incidencia_tecnica", "reclamacion_queja", "insatisfaccion_urgencia", "fraude_seguridad",
    "retencion_comercial", "espera_derivacion", "instalacion_citas", "alta_contratacion", "gestion_administrativa", "vulnerabilidad_impacto",
)


def load_lexicon(path: str) -> Lexicon:
    """A lexicon from a JSON object of theme to keywords."""
    with open(path, encoding="utf-8") as f:
        return {str(t): [str(k) for k in ks] for t, ks in json.load(f).items()}


def prepared(df: DataFrame, text: str = "text", start: str = "start_s", end: str = "end_s") -> DataFrame:
    """Segments with trimmed text, ``duration_s`` (given or from the times), ``n_chars`` and ``n_words``."""
    t = F.trim(F.coalesce(F.col(text), F.lit("")))
    given = F.col("duration_s").cast("double") if "duration_s" in df.columns else F.lit(None).cast("double")
    return df.withColumn(text, t).withColumn("duration_s", F.coalesce(given, F.col(end) - F.col(start))).withColumn("n_chars", F.length(text)).withColumn("n_words", count_words(F.col(text)))


def matches(normal: Column, words: list[str]) -> Column:
    """Sorted distinct keywords, as normalised as the text, that are in it, also within words; keywords of nothing but marks match nothing."""
    listed = F.sort_array(F.array_distinct(F.array(*[normalize_text(F.lit(w)) for w in words]))) if words else F.array().cast("array<string>")
    return F.filter(listed, lambda k: (k != "") & F.contains(normal, k))


def normal_lexicon(spark: SparkSession, lexicon: Lexicon) -> dict[str, list[str]]:
    """Each theme's keywords, normalised like the texts, sorted and distinct; those of nothing but marks are left out. One small job."""
    rows = [(i, t, k) for i, (t, ks) in enumerate(lexicon.items()) for k in ks]
    found = spark.createDataFrame(rows, "i int, theme string, word string").select("theme", normalize_text(F.col("word")).alias("word")).filter("word <> ''").distinct().collect() if rows else []
    return {t: sorted(r.word for r in found if r.theme == t) for t in lexicon}


def automaton(words: dict[str, list[str]], bounded: bool):
    """An Aho-Corasick automaton over all themes' keywords: each end gives the keyword and the themes that have it. ``bounded`` keywords carry their blanks."""
    import ahocorasick

    themes: dict[str, list[str]] = {}
    for t, ks in words.items():
        for k in ks:
            themes.setdefault(k, []).append(t)
    built = ahocorasick.Automaton()
    for k, ts in themes.items():
        built.add_word(f" {k} " if bounded else k, (k, tuple(ts)))
    if themes:
        built.make_automaton()
    return built


def matched_by_automaton(df: DataFrame, lexicon: Lexicon, normal: str, bounded: bool = False) -> DataFrame:
    """``df`` with ``kw_<theme>_matched`` of each theme, found in one pass over each text whatever the number of keywords.

    The automaton goes to the executors once, as a broadcast of the size of the lexicon. A normalised text has single blanks, so a keyword ``bounded`` by
    words is one with a blank on either side of it in the text between two blanks.
    """
    words = normal_lexicon(df.sparkSession, lexicon)
    shared = df.sparkSession.sparkContext.broadcast(automaton(words, bounded))
    names = list(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = shared.value
        for batch in batches:
            lists: dict[str, list[list[str]]] = {t: [] for t in names}
            for text in batch.column(normal).to_pylist():
                hits: dict[str, set[str]] = {}
                if text and len(found):
                    for _, (k, ts) in found.iter(f" {text} " if bounded else text):
                        for t in ts:
                            hits.setdefault(t, set()).add(k)
                for t in names:
                    lists[t].append(sorted(hits[t], key=str.encode) if t in hits else [])
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(lists[t], pa.list_(pa.string())) for t in names]], [*batch.schema.names, *[f"kw_{t}_matched" for t in names]])

    return df.mapInArrow(run, StructType([*df.schema.fields, *[StructField(f"kw_{t}_matched", ArrayType(StringType())) for t in names]]))


def spotted(df: DataFrame, lexicon: Lexicon, text: str = "text", bounded: bool = False, few: int = 64) -> DataFrame:
    """``df`` with the matches, count and flag of each theme, their sums, and the themes found in lexicon order.

    Keywords are normalised like the text. They match anywhere, also within words, or as whole words if ``bounded``. Up to ``few`` of them
    are constants of the plan, each looked for in each text; more go through one automaton (:func:`matched_by_automaton`), with the same matches.
    """
    out = df.withColumn("text_norm", normalize_text(F.col(text)))
    if bounded or sum(map(len, lexicon.values())) > few:
        out = matched_by_automaton(out, lexicon, "text_norm", bounded)
    else:
        out = out.withColumns({f"kw_{t}_matched": matches(F.col("text_norm"), ks) for t, ks in lexicon.items()})
    out = out.withColumns({f"kw_{t}_count": F.size(f"kw_{t}_matched") for t in lexicon})
    out = out.withColumns({f"kw_{t}_flag": F.col(f"kw_{t}_count") > 0 for t in lexicon})
    found = F.array_compact(F.array(*[F.when(F.col(f"kw_{t}_flag"), F.lit(t)) for t in lexicon]))
    total = sum((F.col(f"kw_{t}_count") for t in lexicon), F.lit(0))
    return out.withColumn("critical_themes", found).withColumn("n_critical_themes", F.size("critical_themes")).withColumn("total_matches", total).withColumn("has_critical", F.col("n_critical_themes") > 0)


def by_call(df: DataFrame, lexicon: Lexicon, keys: list[str]) -> DataFrame:
    """Calls ranked by ``3 * share + ln(1 + matches) + 0.5 * themes``, with the percentile of the score.

    The share of critical segments is rounded to four digits before it is used. All themes are
    summed in one aggregate.
    """
    sums = [F.sum(f"kw_{t}_count").alias(f"{t}_matches") for t in lexicon]
    any_ = [F.max(F.col(f"kw_{t}_flag").cast("int")).alias(f"__{t}") for t in lexicon]
    out = df.groupBy(*keys).agg(F.count("*").alias("n_segments"), F.sum(F.col("has_critical").cast("long")).alias("n_critical"), F.sum("total_matches").alias("total_matches"), *sums, *any_)
    themes = F.array_compact(F.array(*[F.when(F.col(f"__{t}") == 1, F.lit(t)) for t in lexicon]))
    out = out.withColumn("pct_critical", F.round(F.col("n_critical") / F.col("n_segments"), 4)).withColumn("themes", themes).withColumn("n_themes", F.size("themes"))
    out = out.withColumn("score", 3 * F.col("pct_critical") + F.log1p(F.col("total_matches")) + 0.5 * F.col("n_themes")).drop(*[f"__{t}" for t in lexicon])
    ranks = average_ranks(out, "score", "__rank").select(F.col("score").alias("__score"), F.round(F.col("__rank") / F.col("n_rows"), 4).alias("percentile"))
    return out.join(ranks, out["score"] == ranks["__score"]).drop("__score")


def top_calls(calls: DataFrame, n: int = 30, tie: str = "audio_id") -> DataFrame:
    return calls.orderBy(F.desc("score"), tie).limit(n)


def theme_summary(df: DataFrame, lexicon: Lexicon, group: str | None = None) -> DataFrame:
    """For each theme (and group, missing groups left out): segments, hits, share in percent, matches."""
    base = df if group is None else df.filter(F.col(group).isNotNull())
    keys = [] if group is None else [group]
    one = F.explode(F.array(*[F.struct(F.lit(t).alias("theme"), F.col(f"kw_{t}_flag").alias("flag"), F.col(f"kw_{t}_count").alias("n")) for t in lexicon]))
    out = base.select(*keys, one.alias("x")).groupBy(*keys, "x.theme").agg(F.count("*").alias("n_segments"), F.sum(F.col("x.flag").cast("long")).alias("n_hits"), F.sum("x.n").alias("n_matches"))
    return out.withColumn("pct", F.round(100 * F.col("n_hits") / F.col("n_segments"), 2))


def final_summary(df: DataFrame, calls: DataFrame, themes: DataFrame, call_key: str) -> DataFrame:
    """One row of totals and the most frequent theme."""
    a = df.agg(F.count("*").alias("n_segments"), F.count_distinct(call_key).alias("n_calls"), F.sum(F.col("has_critical").cast("long")).alias("n_critical"), F.sum("total_matches").alias("total_matches"))
    b = calls.agg(F.max("score").alias("max_score"), F.sum((F.col("n_critical") > 0).cast("long")).alias("n_critical_calls"))
    c = themes.agg(F.max_by("theme", F.struct("n_hits", "theme")).alias("top_theme"))
    return a.crossJoin(b).crossJoin(c).withColumn("share_critical", F.col("n_critical") / F.col("n_segments"))


def with_sentiment(calls: DataFrame, sentiment: DataFrame, keys: list[str]) -> DataFrame:
    """Percentile and negative sentiment as one score: ``0.6 * percentile + 0.4 * max(-mean, 0)``."""
    bad = F.coalesce(F.greatest(-F.col("avg_sentiment"), F.lit(0.0)), F.lit(0.0))
    return calls.join(sentiment.select(*keys, "avg_sentiment"), keys, "left").withColumn("negativity", bad).withColumn("combined", 0.6 * F.col("percentile") + 0.4 * F.col("negativity"))
