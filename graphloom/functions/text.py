"""String expressions shared by the sources and operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the 32-bit FNV-1a hash: its offset basis and prime.
FNV_BASIS, FNV_PRIME = 2166136261, 16777619


#: White space that is trimmed.
SPACE = " \t\n\r\x0b\x0c"


def trimmed(c: Column) -> Column:
    """Without white space at either end."""
    return F.btrim(c, F.lit(SPACE))


def blank_to_null(c: Column) -> Column:
    """Trimmed; null if nothing is left."""
    return F.nullif(trimmed(c), F.lit(""))


def fnv1a(c: Column) -> Column:
    """32-bit FNV-1a of the UTF-8 bytes, as a long."""
    digits = F.hex(c.cast("binary"))
    at = F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(2)) - 1, F.lit(2))
    step = lambda h, i: (h.bitwiseXOR(F.conv(F.substr(digits, i, F.lit(2)), 16, 10).cast("long")) * FNV_PRIME).bitwiseAND(F.lit(0xFFFFFFFF))
    return F.when(F.length(digits) == 0, F.lit(FNV_BASIS).cast("long")).otherwise(F.aggregate(at, F.lit(FNV_BASIS).cast("long"), step))


def contains_ignoring_case(c: Column, part: str) -> Column:
    return F.contains(F.lower(c), F.lit(part.lower()))


def same_ignoring_case(c: Column, value: str) -> Column:
    return F.lower(c) == value.lower()


def strip_fence(c: Column) -> Column:
    """What stands inside a leading markdown fence, less a ``json`` tag; other text as it is."""
    inner = F.split(c, "```", -1)[1]
    return F.when(c.startswith("```"), F.when(inner.startswith("json"), F.substring(inner, 5, 1 << 30)).otherwise(inner)).otherwise(c)


#: Names that stand for a provider.
PROVIDER_ALIASES = {"gemini": "google"}


def model_parts(c: Column, default_provider: str = "google") -> tuple[Column, Column]:
    """(provider, name) of a model string ``provider/name``; without a provider, the default one."""
    has = F.contains(c, F.lit("/"))
    prefix = F.when(has, F.split_part(c, F.lit("/"), F.lit(1))).otherwise(F.lit(default_provider))
    alias = F.create_map(*[F.lit(x) for pair in PROVIDER_ALIASES.items() for x in pair])
    name = F.when(has, F.substr(c, F.instr(c, "/") + 1)).otherwise(c)
    return F.coalesce(F.try_element_at(alias, prefix), prefix), name
