"""Who speaks: official turns, text alignment, evidence, and speakers mapped to roles."""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.functions.labels import AGENT_NAMES, CLIENT_NAMES, strict_role
from parlance.functions.nulls import truly
from parlance.functions.text import char_grams, containment, count_word_runs, jaccard, match_tokens

#: Fixed format: what may stand between a role's name and what is said.
TURN = rf"(?i)^\s*({'|'.join(sorted((*AGENT_NAMES, *CLIENT_NAMES), key=len, reverse=True))})\s*[#\d_\-. ]*\s*[:\-]\s*(.*)$"


def official_turns(df: DataFrame, key: str, text: str, min_words: int = 4, min_chars: int = 18) -> DataFrame:
    """Turns of a dialogue with role prefixes: ``key, turn, role, turn_text``.

    Lines without a prefix go on the turn before; those before the first prefix are left out. Turns
    of agents and clients that are long enough stay and are numbered anew from 0.
    """
    lines = F.split(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "\\r\\n?", "\n"), "\n")
    rows = df.select(key, F.posexplode(lines).alias("line", "t"))
    order = Window.partitionBy(key).orderBy("line")
    head = F.col("t").rlike(TURN)
    rows = rows.withColumn("named", F.when(head, F.regexp_extract("t", TURN, 1))).withColumn("said", F.when(head, F.regexp_extract("t", TURN, 2)).otherwise(F.trim("t"))).withColumn("raw", F.sum(head.cast("int")).over(order))
    said = F.array_join(F.filter(F.transform(F.array_sort(F.collect_list(F.struct("line", "said"))), lambda x: F.trim(x["said"])), lambda s: s != ""), " ")
    turns = rows.filter("raw > 0").groupBy(key, "raw").agg(F.min_by("named", "line").alias("named"), said.alias("turn_text")).withColumn("role", strict_role(F.col("named")))
    long = turns.filter(F.col("role").isNotNull() & (count_word_runs(F.col("turn_text")) >= min_words) & (F.length("turn_text") >= min_chars))
    return long.withColumn("turn", F.row_number().over(Window.partitionBy(key).orderBy("raw")) - 1).select(key, "turn", "role", "turn_text")


def with_both_roles(turns: DataFrame, key: str) -> DataFrame:
    """Turns of the calls in which both roles speak."""
    both = turns.groupBy(key).agg(F.count_distinct("role").alias("n")).filter("n = 2").select(key)
    return turns.join(both, key, "left_semi")


def token_scores(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """``pairs`` with containment and Jaccard of their match tokens."""
    return pairs.withColumn("__a", match_tokens(F.col(a))).withColumn("__b", match_tokens(F.col(b))).withColumn("containment", containment(F.col("__a"), F.col("__b"))).withColumn("jaccard", jaccard(F.col("__a"), F.col("__b"))).drop("__a", "__b")


#: Characters of text in one task when grams are made: a gram a character for each of three lengths, counted in about 100 MB.
TASK_CHARS = 1 << 19


def dealt_by_size(texts: DataFrame, keys: list[str], size: Column) -> DataFrame:
    """``texts`` dealt by ``keys`` into as many tasks as their size asks for, so that a task's grams do not grow with the table.

    The size is summed before the plan goes on. What is grouped by the keys and more afterwards stays in its task: texts travel, not their grams.
    """
    total = texts.agg(F.sum(size)).first()[0] or 0
    return texts.repartition(int(total // TASK_CHARS) + 1, *keys)


def gram_weights(texts: DataFrame, group: list[str], text_id: str, text: str) -> DataFrame:
    """Unit-length TF-IDF weights of character 3- to 5-grams within each group: ``group, text_id, gram, w``.

    idf = ln((1 + n) / (1 + df)) + 1 over the group's texts. A group's texts are in one task; none travels as grams.
    """
    dealt = dealt_by_size(texts.select(*group, text_id, text), group, F.length(text)).withColumn("n", F.count("*").over(Window.partitionBy(*group)))
    grams = dealt.select(*group, text_id, "n", F.explode_outer(char_grams(F.col(text))).alias("gram")).filter("gram IS NOT NULL")  # the inner form makes the grams twice
    tf = grams.groupBy(*group, text_id, "n", "gram").agg(F.count("*").alias("tf"))
    df = F.count("*").over(Window.partitionBy(*group, "gram"))
    raw = tf.select(*group, text_id, "gram", (F.col("tf") * (F.log((1 + F.col("n")) / (1 + df)) + 1)).alias("raw"))
    return raw.select(*group, text_id, "gram", (F.col("raw") / F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy(*group, text_id)))).alias("w"))


def gram_cosines(pairs: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """``key, cosine`` of the two texts of each row by TF-IDF weights of their character grams, as :func:`gram_weights` has them over the two; ``key`` is unique, and without shared grams there is no row.

    The grams of a row are counted side by side in the row's task, with both counts in one row of the gram: of two texts a gram is in one or in both.
    """
    dealt = dealt_by_size(pairs.select(key, a, b), [key], F.coalesce(F.length(a), F.lit(0)) + F.coalesce(F.length(b), F.lit(0)))
    of = lambda c, side: F.transform(char_grams(F.col(c)), lambda g: F.struct(F.xxhash64(g).alias("gram"), F.lit(side).alias("side")))
    listed = F.concat(of(a, 0), of(b, 1))
    grams = dealt.select(key, F.explode_outer(listed).alias("x")).select(key, "x.gram", "x.side").filter("gram IS NOT NULL")
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    counts = grams.groupBy(key, "gram").agg(F.count(F.when(F.col("side") == 0, 1)).alias("x"), F.count(F.when(F.col("side") == 1, 1)).alias("y"))
    idf = F.when((F.col("x") > 0) & (F.col("y") > 0), 1.0).otherwise(log(3 / 2) + 1)
    sums = counts.select(key, (x * y).alias("p"), (x * idf).alias("wx"), (y * idf).alias("wy")).groupBy(key).agg(F.sum("p").alias("p"), F.sqrt(F.sum(F.col("wx") * F.col("wx"))).alias("la"), F.sqrt(F.sum(F.col("wy") * F.col("wy"))).alias("lb"))
    return sums.filter("p > 0").select(key, (F.col("p") / (F.col("la") * F.col("lb"))).alias("cosine"))


#: Turns whose windows one task compares; a call of more turns is dealt over several tasks.
STRIPE = 256


def _window_cosines(turns: DataFrame, windows: DataFrame, key: str, turn_id: str, window_id: str) -> DataFrame:
    """``key, turn_id, window_id, cosine`` of the turns and windows of a call that share a gram.

    A call's texts go to one task, or where it has more than ``STRIPE`` turns to one for each so many: there all its texts count in idf,
    and the stripe's turns are compared. Texts travel once; grams, weights and products stay in the task.
    """
    sides = turns.select(key, F.lit(True).alias("is_turn"), F.col(turn_id).alias("id"), F.col("turn_text").alias("t")).unionByName(windows.select(key, F.lit(False).alias("is_turn"), F.col(window_id).alias("id"), F.col("window_text").alias("t")))
    calls = turns.groupBy(key).agg(F.ceil(F.count("*") / STRIPE).cast("int").alias("stripes"))
    sizes = sides.groupBy(key).agg(F.count("*").alias("n")).join(calls, key)
    copies = sides.join(sizes, key).withColumn("stripe", F.explode(F.sequence(F.lit(0), F.col("stripes") - 1)))
    dealt = dealt_by_size(copies, [key, "stripe"], F.length("t"))
    by = [key, "stripe"]
    mine = F.col("is_turn") & (F.pmod(F.xxhash64("id"), F.col("stripes")) == F.col("stripe"))
    listed = F.transform(char_grams(F.col("t")), lambda g: F.xxhash64(g))
    grams = dealt.select(*by, "is_turn", "id", "n", mine.alias("mine"), F.explode_outer(listed).alias("gram")).filter("gram IS NOT NULL")
    tf = grams.groupBy(*by, "is_turn", "id", "n", "mine", "gram").agg(F.count("*").alias("tf"))
    df = F.count("*").over(Window.partitionBy(*by, "gram"))
    raw = tf.select(*by, "is_turn", "id", "mine", "gram", (F.col("tf") * (F.log((1 + F.col("n")) / (1 + df)) + 1)).alias("raw"))
    w = raw.select("*", (F.col("raw") / F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy(*by, "is_turn", "id")))).alias("w"))
    listed_of = lambda which: F.collect_list(F.when(which, F.struct("id", "w")))
    met = w.filter(F.col("mine") | ~F.col("is_turn")).groupBy(*by, "gram").agg(listed_of(F.col("is_turn")).alias("a"), listed_of(~F.col("is_turn")).alias("b")).filter((F.size("a") > 0) & (F.size("b") > 0))
    products = met.select(*by, F.explode("a").alias("a"), "b").select(*by, "a", F.explode("b").alias("b"))
    return products.select(*by, F.col("a.id").alias(turn_id), F.col("b.id").alias(window_id), (F.col("a.w") * F.col("b.w")).alias("p")).groupBy(*by, turn_id, window_id).agg(F.sum("p").alias("cosine")).drop("stripe")


def aligned(turns: DataFrame, windows: DataFrame, key: str, turn_id: str = "turn", window_id: str = "window", cos_weight: float = 0.65, accept: tuple[float, float, float, float] = (0.70, 0.50, 0.35, 0.03)) -> DataFrame:
    """For each turn the best window of its call by ``0.65 cosine + 0.35 containment``, with the margin to the second.

    ``turns`` has ``turn_text``, ``windows`` has ``window_text``. ``accepted`` needs the combined
    score, the cosine, the containment and the margin at their limits. Only windows that share a gram are pairs.
    """
    cos = _window_cosines(turns, windows, key, turn_id, window_id)
    pairs = token_scores(cos.join(turns, [key, turn_id]).join(windows, [key, window_id]), "turn_text", "window_text")
    pairs = pairs.withColumn("combined", cos_weight * F.col("cosine") + (1 - cos_weight) * F.col("containment"))
    order = Window.partitionBy(key, turn_id).orderBy(F.desc("combined"), window_id)
    best = pairs.withColumn("rn", F.row_number().over(order)).withColumn("second", F.lead("combined").over(order)).filter("rn = 1")
    best = best.withColumn("margin", F.col("combined") - F.coalesce("second", F.lit(0.0)))
    ok = (F.col("combined") >= accept[0]) & (F.col("cosine") >= accept[1]) & (F.col("containment") >= accept[2]) & (F.col("margin") >= accept[3])
    return best.withColumn("accepted", ok).drop("rn")


def threshold_sensitivity(matches: DataFrame, key: str, metrics: list[str], thresholds: tuple[float, ...] = (0.3, 0.5, 0.6, 0.7, 0.8)) -> DataFrame:
    """For each metric and limit: matches, calls, and mean combined score, in one pass."""
    grid = F.broadcast(matches.sparkSession.createDataFrame([(t,) for t in thresholds], "threshold double"))
    items = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics]))
    rows = matches.select(key, "combined", items.alias("x")).crossJoin(grid).withColumn("hit", F.col("x.value") >= F.col("threshold"))
    out = rows.groupBy("x.metric", "threshold").agg(F.sum(F.col("hit").cast("long")).alias("n"), F.count_distinct(F.when(F.col("hit"), F.col(key))).alias("n_calls"), F.avg(F.when(F.col("hit"), F.col("combined"))).alias("mean_combined"))
    return out


def evidence_rows(df: DataFrame, keys: list[str], min_words: int = 3, strict_overlap: float = 0.05, pool: tuple[int, float, int] = (2, 6.0, 15), most_rows: int = 10, seconds: float = 25.0, tie: str = "seg_id") -> DataFrame:
    """Segments that speak for a speaker's role (``keys`` name the speaker).

    From the segments with hardly any overlap, if they have enough rows, seconds and words, else from
    all; least overlapped, longest in words and time, earliest first, until 10 rows or 25 seconds; the row that
    crosses the limit stays. Where there is a ``status``, a speaker's ``ok`` segments go alone, if there are any.
    """
    base = df.filter((F.col("n_words") >= min_words) & (F.col("duration_s") > 0))
    whole = Window.partitionBy(*keys)
    if "status" in df.columns:
        fine = F.lower(F.coalesce("status", F.lit(""))) == "ok"
        base = base.withColumn("__any", F.max(fine.cast("int")).over(whole)).filter(fine | (F.col("__any") == 0)).drop("__any")
    strict = F.col("overlap_ratio") <= strict_overlap
    enough = (F.sum(strict.cast("int")).over(whole) >= pool[0]) & (F.sum(F.when(strict, F.col("duration_s")).otherwise(0.0)).over(whole) >= pool[1]) & (F.sum(F.when(strict, F.col("n_words")).otherwise(0)).over(whole) >= pool[2])
    chosen = base.withColumn("strict_pool", enough).filter(~F.col("strict_pool") | strict)
    order = Window.partitionBy(*keys).orderBy("overlap_ratio", F.desc("n_words"), F.desc("duration_s"), "start_s", tie)
    before = F.coalesce(F.sum("duration_s").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return chosen.withColumn("rn", F.row_number().over(order)).withColumn("before_s", before).filter((F.col("rn") <= most_rows) & (F.col("before_s") < seconds)).drop("before_s")


def evidence(df: DataFrame, keys: list[str], tie: str = "seg_id", pool: tuple[int, float, int] = (2, 6.0, 15), **how) -> DataFrame:
    """One row for each speaker: text in the order of choice, rows, words, seconds, overlap, and whether they suffice."""
    rows = evidence_rows(df, keys, tie=tie, pool=pool, **how)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "text"))), lambda x: F.trim(x["text"])), " ")
    out = rows.groupBy(*keys).agg(text.alias("evidence_text"), F.count("*").alias("n_rows"), F.sum("n_words").alias("n_words"), F.sum("duration_s").alias("seconds"), F.max("overlap_ratio").alias("max_overlap"), F.avg("overlap_ratio").alias("mean_overlap"))
    status = F.when(F.col("n_rows") < pool[0], "low_segment_count").when(F.col("seconds") < pool[1], "low_duration").when(F.col("n_words") < pool[2], "low_word_count").otherwise("sufficient_evidence")
    return out.withColumn("evidence_status", status)


def role_pairs(scores: DataFrame, key: str, min_score: float = 0.10, min_margin: float = 0.01) -> DataFrame:
    """Two speakers mapped to the two roles by the better of both assignments.

    ``scores``: ``key, speaker, role, evidence, score`` and, where known, ``seconds`` and ``n_rows``. The two speakers with the
    most evidence (then seconds, rows, least name) take part; an assignment scores the sum of its two scores. Gives ``key, agent_speaker, client_speaker, pair_score, pair_margin, status``.
    """
    more = [c for c in ("seconds", "n_rows") if c in scores.columns]
    speakers = scores.groupBy(key, "speaker").agg(F.max("evidence").alias("evidence"), *[F.max(c).alias(c) for c in more], F.max(F.when(F.col("role") == "AGENT", F.col("score"))).alias("a"), F.max(F.when(F.col("role") == "CLIENT", F.col("score"))).alias("c"))
    order = Window.partitionBy(key).orderBy(F.desc("evidence"), *[F.desc(c) for c in more], "speaker")
    two = speakers.withColumn("rn", F.row_number().over(order)).filter("rn <= 2")
    z = lambda c, n: F.coalesce(F.max(F.when(F.col("rn") == n, F.col(c))), F.lit(0.0))
    one = two.groupBy(key).agg(F.max(F.when(F.col("rn") == 1, F.col("speaker"))).alias("s1"), F.max(F.when(F.col("rn") == 2, F.col("speaker"))).alias("s2"), (z("a", 1) + z("c", 2)).alias("straight"), (z("c", 1) + z("a", 2)).alias("crossed"))
    first = F.col("straight") >= F.col("crossed")
    best, other = F.greatest("straight", "crossed"), F.least("straight", "crossed")
    status = F.when(F.col("s2").isNull(), "less_than_two_speakers_with_evidence").when(best < min_score, "rejected_low_aggregate_score").when(best - other < min_margin, "assigned_low_margin_aggregate_text").otherwise("accepted_speaker_role")
    return one.select(key, F.when(first, F.col("s1")).otherwise(F.col("s2")).alias("agent_speaker"), F.when(first, F.col("s2")).otherwise(F.col("s1")).alias("client_speaker"), best.alias("pair_score"), (best - other).alias("pair_margin"), status.alias("status"))


def strict_mapping(matches: DataFrame, key: str, min_matches: int = 2, min_purity: float = 0.7) -> DataFrame:
    """Best speaker of each role by accepted matches (``key, speaker, role``), kept where both roles have different ones.

    Gives ``key, speaker, role, n, purity``.
    """
    counts = matches.groupBy(key, "speaker", "role").agg(F.count("*").alias("n"))
    pure = counts.withColumn("purity", F.col("n") / F.sum("n").over(Window.partitionBy(key, "speaker")))
    good = pure.filter((F.col("n") >= min_matches) & (F.col("purity") >= min_purity))
    best = good.withColumn("rn", F.row_number().over(Window.partitionBy(key, "role").orderBy(F.desc("n"), F.desc("purity"), "speaker"))).filter("rn = 1")
    both = best.groupBy(key).agg(F.count("*").alias("roles"), F.count_distinct("speaker").alias("speakers")).filter("roles = 2 AND speakers = 2").select(key)
    return best.join(both, key, "left_semi").select(key, "speaker", "role", "n", "purity")


def propagated(segments: DataFrame, mapping: DataFrame, keys: list[str], tie: str = "seg_id") -> DataFrame:
    """Segments with their speaker's role and their number within the call from 0."""
    order = Window.partitionBy(keys[0]).orderBy("start_s", "end_s", tie)
    return segments.join(mapping, keys, "left").withColumn("ordinal", F.row_number().over(order) - 1)


def holdout_part(key: Column, salt: str = "split") -> Column:
    """train (70 %) or test by a digest of the key, the same in every run."""
    number = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{salt}|"), key.cast("string")), 256), 1, 8), 16, 10).cast("bigint") % 100
    return F.when(number < 70, "train").otherwise("test")


def role_scores(evidence_table: DataFrame, official: DataFrame, key: str) -> DataFrame:
    """``0.55 cosine + 0.45 containment`` of each speaker's evidence with each role's official text."""
    more = [c for c in ("seconds", "n_rows") if c in evidence_table.columns]
    e = evidence_table.select(key, "speaker", F.col("evidence_text").alias("a"), F.col("n_words").alias("evidence"), *more)
    pairs = e.join(official.select(key, "role", F.col("role_text").alias("b")), key).withColumn("pair", F.concat_ws("|", F.col(key).cast("string"), "speaker", "role"))
    cos = gram_cosines(pairs, "pair", "a", "b")
    both = token_scores(pairs, "a", "b").join(cos, "pair", "left")
    blank = truly(F.trim("a") == "") | truly(F.trim("b") == "")
    score = 0.55 * F.coalesce("cosine", F.lit(0.0)) + 0.45 * F.col("containment")
    return both.withColumn("score", F.when(blank, 0.0).otherwise(score)).select(key, "speaker", "role", "evidence", *more, "score")


def role_audit(evidence_table: DataFrame, turns: DataFrame, key: str, order: str = "turn", min_score: float = 0.10, min_margin: float = 0.01) -> DataFrame:
    """The mapping of each call with evidence and why there is none: the columns of :func:`role_pairs`.

    ``turns``: ``key, role, turn_text`` and their order. Calls without official turns of both roles are
    ``missing_both_official_roles``, those in which a role says nothing ``empty_official_role_text``.
    """
    said = F.trim(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "turn_text"))), lambda x: F.trim(F.coalesce(x["turn_text"], F.lit("")))), " "))
    official = turns.filter(F.col("role").isin("AGENT", "CLIENT")).groupBy(key, "role").agg(said.alias("role_text"))
    facts = official.groupBy(key).agg(F.count("*").alias("__roles"), F.min(F.length("role_text")).alias("__least"))
    calls = evidence_table.select(key).distinct().join(facts, key, "left")
    both = F.coalesce(F.col("__roles"), F.lit(0)) == 2
    status = F.when(~both, "missing_both_official_roles").when(F.col("__least") == 0, "empty_official_role_text")
    left_out = calls.withColumn("status", status)
    fit = left_out.filter("status IS NULL").select(key)
    pairs = role_pairs(role_scores(evidence_table.join(fit, key, "left_semi"), official, key), key, min_score, min_margin)
    none = left_out.filter("status IS NOT NULL").select(key, *[F.lit(None).cast(t).alias(c) for c, t in pairs.dtypes if c not in (key, "status")], "status")
    return pairs.unionByName(none)
