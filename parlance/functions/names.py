"""Identity of recordings from their file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What stages append to and put before a recording's name.
SUFFIXES = ("_final_merged", "_final_segments", "_transcribed_segments", "_raw", "_clean")
STEM_SUFFIXES = ("_final_segments", "_final_merged", "_transcribed_segments", "_raw", "_clean")
PREFIXES = ("raw_bajas_", "raw_comercial_", "raw_")
ALL_PREFIXES = ("raw_bajas_", "raw_comercial_", "raw_", "bajas_", "comercial_")


def basename(c: Column) -> Column:
    return F.regexp_extract(c, "([^/]*)$", 1)


def _without(c: Column, suffixes: tuple[str, ...]) -> Column:
    for s in suffixes:
        c = F.regexp_replace(c, f"{s}$", "")
    return c


def recording_id(c: Column) -> Column:
    """Base id: without extension, stage suffixes in turn, and one source prefix."""
    x = F.regexp_replace(F.regexp_replace(basename(c), "(?i)\\.wav$", ""), "(?i)\\.csv$", "")
    return F.regexp_replace(_without(x, SUFFIXES), f"^({'|'.join(PREFIXES)})", "")


def recording_stem(c: Column, clean: bool = True) -> Column:
    """Without audio extension and stage suffixes; ``clean=False`` keeps ``_clean``. Null as empty."""
    x = F.regexp_replace(basename(F.coalesce(c, F.lit(""))), "(?i)\\.(wav|mp3|m4a|flac|ogg)$", "")
    return _without(x, STEM_SUFFIXES if clean else STEM_SUFFIXES[:-1])


def consolidation_id(c: Column) -> Column:
    """As :func:`recording_id` with all prefixes taken off as often as they stand there."""
    x = basename(c)
    for s in ("\\.csv", "_final_merged", "\\.wav", "_clean"):
        x = F.regexp_replace(x, f"{s}$", "")
    return F.regexp_replace(x, f"^({'|'.join(ALL_PREFIXES)})+", "")


def plain_name(c: Column) -> Column:
    """Base name without ``.wav``; nothing else goes."""
    return F.regexp_replace(basename(c), "(?i)\\.wav$", "")


def source_and_id(c: Column) -> tuple[Column, Column]:
    """(source, id) by three patterns in turn: prefixed digits, digits alone, ten digits anywhere."""
    stem = F.regexp_replace(basename(c), "(?<=.)\\.[^.]*$", "")
    prefixed, bare = "^(raw_bajas|raw)_([0-9]+)(?:_clean)?$", "^([0-9]+)(?:_clean)?$"
    within = F.regexp_extract(stem, "([0-9]{10,})", 1)
    source = F.when(stem.rlike(prefixed), F.regexp_extract(stem, prefixed, 1)).when(stem.rlike(bare), None)
    source = source.when(within != "", F.when(F.contains(stem, F.lit("raw_bajas")), "raw_bajas").when(F.contains(stem, F.lit("raw_")), "raw"))
    number = F.when(stem.rlike(prefixed), F.regexp_extract(stem, prefixed, 2)).when(stem.rlike(bare), F.regexp_extract(stem, bare, 1)).when(within != "", within)
    return source, number


def name_variants(c: Column) -> Column:
    """Keys under which a recording may be filed, in order of preference."""
    stem = recording_id(c)
    made = [stem, *[F.concat(F.lit(p), stem) for p in ("raw_", "raw_bajas_")]]
    return F.array_distinct(F.array(*made, *[F.concat(m, F.lit("_clean")) for m in made]))


def segment_uid(audio: Column, start: Column, end: Column, speaker: Column) -> Column:
    """24 hex digits of a segment's place and speaker."""
    number = lambda x: F.format_string("%.6f", x.cast("double"))
    return F.substring(F.sha2(F.concat_ws("|", audio.cast("string"), number(start), number(end), speaker), 256), 1, 24)


def set_fingerprint(uid: Column) -> Column:
    """Digest of a set of ids, whatever their order."""
    return F.sha2(F.array_join(F.array_sort(F.collect_list(uid)), "|"), 256)


#: What transcription appends to a name, in the order in which it is taken off.
TRANSCRIPTION_SUFFIXES = ("_final_merged", "_transcribed_segments", "_whisper_words", "_whisper_asr_segments", "_clean")


def transcription_id(c: Column) -> Column:
    """Base id in any case of letters: without table or sound extension, each suffix once, and source prefixes as often as they stand there."""
    x = F.regexp_replace(basename(c), "(?i)\\.(csv|wav|mp3|flac)$", "")
    for s in TRANSCRIPTION_SUFFIXES:
        x = F.regexp_replace(x, f"(?i){s}$", "")
    return F.regexp_replace(x, f"^({'|'.join(ALL_PREFIXES)})+", "")


def metadata_stem(c: Column) -> Column:
    """Trimmed base name without ``.wav`` and one ``_clean``, in any case of letters."""
    return F.regexp_replace(F.regexp_replace(basename(F.trim(c)), "(?i)\\.wav$", ""), "(?i)_clean$", "")


def metadata_source(c: Column) -> Column:
    """raw_bajas or raw, by how the stem begins; null otherwise."""
    s = metadata_stem(c)
    return F.when(F.startswith(s, F.lit("raw_bajas_")), "raw_bajas").when(F.startswith(s, F.lit("raw_")), "raw")


def without_source(stem: Column) -> Column:
    """A stem without one source prefix, the longer one first."""
    return F.regexp_replace(F.trim(stem), "^(raw_bajas_|raw_)", "")


def metadata_variants(c: Column, source: Column) -> Column:
    """Sorted distinct keys of a recording across tables: the stem, the bare id, and the id under its source's prefix."""
    stem = metadata_stem(c)
    base = without_source(stem)
    named = F.when(source.isin("raw", "raw_bajas"), F.concat(source, F.lit("_"), base))
    return F.array_sort(F.filter(F.array_distinct(F.array_compact(F.array(stem, base, named))), lambda v: F.trim(v) != ""))


def file_key(c: Column) -> Column:
    """Trimmed base name without its last extension; blank as null."""
    t = F.trim(c)
    return F.when(t != "", F.regexp_replace(basename(t), "(?<=.)\\.[^.]*$", ""))
