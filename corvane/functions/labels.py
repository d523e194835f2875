"""Label functions: condition ladders, multi-hot names, thresholds, names and modalities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Substrings of a modality and the group they stand for, in order of precedence.
MODALITY_GROUPS = ((("t1", "t2", "mri", "mr", "flair", "dwi"), "mri"), (("ct",), "ct"), (("pet",), "pet"))
TRAINING_MODALITY_GROUPS = ((("t1", "t2", "mri", "flair", "dwi"), "mri"), (("ct",), "ct"), (("pet",), "pet"), (("us", "ultrasound"), "us"))


def _entries(conditions: dict[str, Column]) -> Column:
    return F.array(*(F.struct(F.lit(k).alias("name"), v.cast("double").alias("value")) for k, v in conditions.items()))


def condition_names(no_finding: Column, conditions: dict[str, Column]) -> tuple[Column, Column]:
    """Positive and negative condition names of a 1 / 0 / -1 / null row.

    No finding (1) makes all negative; else 1 is positive, -1 neither, and the rest,
    nulls and NaN too, negative.
    """
    all_names = F.array(*(F.lit(k) for k in conditions))
    clear = F.coalesce(no_finding == 1, F.lit(False))
    entries = _entries(conditions)
    names = lambda keep: F.transform(F.filter(entries, keep), lambda e: e["name"])
    positive = F.when(clear, F.array().cast("array<string>")).otherwise(names(lambda e: F.coalesce(e["value"] == 1, F.lit(False))))
    negative = F.when(clear, all_names).otherwise(names(lambda e: ~F.coalesce(e["value"].isin(1.0, -1.0), F.lit(False))))
    return positive, negative


def truthy_names(conditions: dict[str, Column]) -> tuple[Column, Column]:
    """Names of the conditions that are neither null nor 0, and of the others."""
    entries = _entries(conditions)
    held = lambda e: F.coalesce(e["value"] != 0, F.lit(False))
    return F.transform(F.filter(entries, held), lambda e: e["name"]), F.transform(F.filter(entries, lambda e: ~held(e)), lambda e: e["name"])


def mapped_names(flags: dict[str, Column], names: dict[str, str]) -> tuple[Column, Column]:
    """Distinct mapped names of the flags set and of those not set; a name may be in both."""
    positive, negative = truthy_names(flags)
    table = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
    return tuple(F.array_distinct(F.transform(side, lambda n: table[n])) for side in (positive, negative))


def is_positive_class(code: Column) -> Column:
    """Of four classes, 1 and 3 are positive."""
    return code.isin(1, 3)


def passes_logit(logit: Column) -> Column:
    """1 where the sigmoid of a logit is at least one half."""
    return (1 / (1 + F.exp(-logit)) >= 0.5).cast("int")


def modality_group(modality: Column, groups=MODALITY_GROUPS) -> Column:
    """The group of a lower-cased modality: the first whose substring it holds, else itself."""
    out, low = F.when(F.lit(False), ""), F.lower(modality)
    for parts, group in groups:
        out = out.when(low.rlike("|".join(parts)), group)
    return out.otherwise(low)


def first_true(flags: dict[str, Column]) -> Column:
    """The first name whose flag is true; null if none is."""
    return F.coalesce(*(F.when(flag, name) for name, flag in flags.items()))


def looked_up(key: Column, table: dict, default: Column | None = None) -> Column:
    """A key's value in a literal table; ``default`` (null) if it has none."""
    found = F.try_element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), key)
    return found if default is None else F.coalesce(found, default)


def kept_targets(names: Column, corrections: dict[str, str], supported: list[str]) -> Column:
    """Corrected, supported, distinct target names, sorted."""
    table = F.create_map(*(F.lit(x) for pair in corrections.items() for x in pair)) if corrections else None
    right = F.transform(names, lambda n: F.coalesce(F.try_element_at(table, n), n)) if table is not None else names
    return F.array_sort(F.array_distinct(F.filter(right, lambda n: n.isin(supported))))


def anatomy_corrections(vertebrae: dict[str, int], names: dict[str, str]) -> dict[str, str]:
    """A correction table: given names, and ``vertebrae L1`` and the like for every region's numbers."""
    return names | {f"vertebrae {region}{i}": f"{region}{i}" for region, n in vertebrae.items() for i in range(1, n + 1)}


def orientation(spacing: Column, edges: Column) -> Column:
    """The plane (0 to 2) whose two in-plane spacings differ least; ties go to the plane of equal edges, else to 0."""
    gap = lambda a, b: F.abs(spacing[a] - spacing[b])
    even = lambda a, b: F.when(edges[a] == edges[b], 0).otherwise(1)
    planes = [F.struct(F.round(gap(*ab), 9).alias("gap"), even(*ab).alias("even"), F.lit(k).alias("plane")) for k, ab in enumerate(((1, 2), (0, 2), (0, 1)))]
    return F.array_min(F.array(*planes))["plane"]


def path_key(path: Column, first: int, last: int, joiner: str = "-") -> Column:
    """The segments of a path from ``first`` to ``last`` (counted from the end, 1 is the last), joined, without a suffix."""
    parts = F.split(path, "/")
    picked = F.array_compact(F.array(*(F.try_element_at(parts, F.lit(-k)) for k in range(first, last - 1, -1))))
    return F.regexp_replace(F.array_join(picked, joiner), r"\.[A-Za-z0-9]+(?:\.gz)?$", "")


def moved(path: Column, old: str, new: str) -> Column:
    """A path with its leading ``old`` replaced by ``new``."""
    return F.when(F.startswith(path, F.lit(old)), F.concat(F.lit(new), F.substring(path, F.lit(len(old) + 1), F.length(path)))).otherwise(path)
