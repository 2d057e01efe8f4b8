"""Roles, sentiment labels, phases."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parlance.functions.text import fold_accents

#: Spellings of roles.
AGENT_NAMES = ("AGENT", "AGENTE", "ASESOR", "ASESORA", "OPERADOR", "OPERADORA", "COMERCIAL")
CLIENT_NAMES = ("CLIENT", "CLIENTE", "CUSTOMER", "USUARIO", "USUARIA")
#: Spellings of sentiment labels, and the star ratings that count as well where text and sound meet.
NEGATIVE = ("neg", "negative", "negativo", "label_0")
NEUTRAL = ("neu", "neutral", "label_1")
POSITIVE = ("pos", "positive", "positivo", "label_2")
NEGATIVE_STARS = ("1 star", "2 stars")
NEUTRAL_STARS = ("3 stars",)
POSITIVE_STARS = ("4 stars", "5 stars")


def strict_role(c: Column) -> Column:
    """AGENT or CLIENT of a role's spelling, else null."""
    bare = F.regexp_replace(fold_accents(F.upper(F.trim(c))), "[^A-Z]", "")
    return F.when(bare.isin(*AGENT_NAMES), "AGENT").when(bare.isin(*CLIENT_NAMES), "CLIENT")


def plain_role(c: Column) -> Column:
    """AGENT, CLIENT or UNKNOWN."""
    r = F.upper(F.trim(c))
    return F.when(r.isin("AGENT", "CLIENT"), r).otherwise("UNKNOWN")


def sentiment_label(c: Column) -> Column:
    """negative, neutral or positive; other labels pass in lower case."""
    x = F.lower(F.trim(c))
    return F.when(x.isin(*NEGATIVE), "negative").when(x.isin(*NEUTRAL), "neutral").when(x.isin(*POSITIVE), "positive").otherwise(x)


def spanish_label(c: Column) -> Column:
    """negativo, neutral or positivo, of star ratings too; other labels pass in lower case."""
    x = F.lower(F.trim(c))
    return F.when(x.isin(*NEGATIVE, *NEGATIVE_STARS), "negativo").when(x.isin(*NEUTRAL, *NEUTRAL_STARS), "neutral").when(x.isin(*POSITIVE, *POSITIVE_STARS), "positivo").otherwise(x)


def sentiment_value(c: Column) -> Column:
    """-1, 0 or 1 of a normalised label in either language, else null."""
    return F.when(c.isin("negative", "negativo"), -1.0).when(c == "neutral", 0.0).when(c.isin("positive", "positivo"), 1.0)


def mean_sentiment_class(c: Column, edge: float = 0.25) -> Column:
    return F.when(c.isNull(), "unknown").when(c <= -edge, "negative").when(c >= edge, "positive").otherwise("neutral")


def call_phase(position: Column) -> Column:
    """Third of a call in which a relative position lies."""
    return F.when(position.isNull(), "unknown").when(position < 1 / 3, "inicio").when(position < 2 / 3, "mitad").otherwise("final")


PHASE_ORDER = {"inicio": 0, "mitad": 1, "final": 2, "unknown": 3}
