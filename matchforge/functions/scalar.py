"""Small Column functions: guards, groups, time buckets, masks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ROLES = ["TOP", "JUNGLE", "MIDDLE", "BOTTOM", "UTILITY"]
# Build labels, their coarse group and their sibling in the group.
BUILD_GROUPS = {
    "crit": "physical", "lethality": "physical", "on_hit": "physical", "attack_damage": "physical",
    "ability_power": "magic", "utility_enchanter": "utility", "utility_protection": "utility",
    "ar_tank": "tank", "mr_tank": "tank", "ad_off_tank": "tank", "ap_off_tank": "tank",
}

# Builds that are smoothed together; the two of a group are each other's siblings.
SIBLINGS = {"ap": ("ability_power", "ap_off_tank"), "ad": ("attack_damage", "ad_off_tank"), "tank": ("ar_tank", "mr_tank"), "utility": ("utility_enchanter", "utility_protection")}


def lookup_map(pairs: dict, key: Column, default=None) -> Column:
    """Value of a literal map, the default where the key is not in it."""
    m = F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])
    found = F.try_element_at(m, key)
    return found if default is None else F.coalesce(found, F.lit(default))


def build_group(build: Column) -> Column:
    return lookup_map(BUILD_GROUPS, build, "none")


def smoothing_group(build: Column) -> Column:
    """The group that a build is smoothed with; a build of no group is its own."""
    return F.coalesce(lookup_map({b: g for g, pair in SIBLINGS.items() for b in pair}, build), build)


def sibling_build(build: Column) -> Column:
    """The other build of a build's group; null where it has none."""
    return lookup_map({a: b for x, y in SIBLINGS.values() for a, b in ((x, y), (y, x))}, build)


def to_nullable(value: Column, missing) -> Column:
    """The value, null where it is the one that stands for a missing value."""
    return F.nullif(value, F.lit(missing))


def ratio(a: Column, b: Column) -> Column:
    """a / b where b is above 1e-9, else 0."""
    return F.when(b > 1e-9, a / b).otherwise(F.lit(0.0))


def over_one(a: Column, b: Column) -> Column:
    """a over b, b counted as 1 at least."""
    return a / F.greatest(b, F.lit(1.0))


def nearest_minute(ms: Column) -> Column:
    return F.when(ms <= 0, F.lit(0)).otherwise(F.floor((ms + 30_000) / 60_000) * 60_000).cast("long")


def minute_bucket(ms: Column, last: int = 46) -> Column:
    return F.least(F.floor(ms / 60_000), F.lit(last)).cast("int")


def bitmask(flags: list[tuple[Column, int]]) -> Column:
    """Flags (0, 1 or null) at their bits, as a long."""
    out = F.lit(0).cast("long")
    for flag, bit in flags:
        out = out + F.coalesce(flag.cast("long"), F.lit(0)) * F.lit(1 << bit)
    return out


def continent(match_id: Column, prefixes: dict) -> Column:
    return lookup_map(prefixes, F.lower(F.split(match_id, "_")[0]), "unknown")


def hash32(x: Column) -> Column:
    """The first 32 bits of an MD5 as a number; the same in other engines."""
    return F.conv(F.substring(F.md5(x.cast("string")), 1, 8), 16, 10).cast("long")


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def signed_log(x: Column) -> Column:
    return F.signum(x) * F.log1p(F.abs(x))


def season_of(at: Column, starts: list) -> Column:
    """Number of the season (from 1) whose start is the last one not after a time; null before the first."""
    out = F.lit(None).cast("int")
    for i, start in enumerate(sorted(starts), 1):
        out = F.when(at >= F.lit(start), F.lit(i)).otherwise(out)
    return out


def ordered_distinct(items: Column) -> Column:
    """Items of an array without empties and repeats, in the order of their first appearance."""
    return F.array_distinct(F.filter(items, lambda x: x.isNotNull() & (x != "")))
