"""Scalar expressions: seeds, names, paths, parsing of settings, schedules, vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def derive_seed(seed: Column, name: Column) -> Column:
    """First 32 bits of SHA-256 of "seed:name", the same in every process and engine."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", seed.cast("string"), name), 256), 1, 8), 16, 10).cast("bigint")


def seeded_order(seed: Column | str, *names: Column) -> Column:
    """Hex digest to sort by for a seeded shuffle."""
    return F.sha2(F.concat_ws(":", seed if isinstance(seed, Column) else F.lit(seed), *(n.cast("string") for n in names)), 256)


def auto_name(prefix: str, i: Column, n: Column) -> Column:
    """Zero-padded ordinal name, at least two digits wide."""
    return F.concat(F.lit(prefix), F.lpad(i.cast("string"), F.greatest(F.lit(2), F.length(n.cast("string"))), F.lit("0")))


def is_url(c: Column) -> Column:
    return F.lower(c).rlike("^https?://")


def strip_leading_dotdot(c: Column) -> Column:
    return F.regexp_replace(c, r"^(\.\./)+", "")


def resolve_path(c: Column, base: str) -> Column:
    """Absolute paths stay; others are joined to ``base``; ``.`` and ``..`` steps are folded."""
    full = F.when(c.startswith("/"), c).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), c))
    steps = F.filter(F.split(full, "/"), lambda s: (s != "") & (s != "."))
    folded = F.aggregate(steps, F.array().cast("array<string>"), lambda acc, s: F.when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.lit(0), F.size(acc) - 1))).otherwise(F.concat(acc, F.array(s))))
    return F.concat(F.lit("/"), F.array_join(folded, "/"))


def label_path(c: Column, labels_dir: str | None = None) -> Column:
    """Label file of an image: the last ``images`` folder becomes ``labels``, the suffix ``.txt``.

    With ``labels_dir`` the file has the image's stem there; without an ``images`` folder it
    stands beside the image.
    """
    stem = F.regexp_replace(c, r"\.[^./]*$", "")
    if labels_dir:
        return F.concat(F.lit(labels_dir.rstrip("/") + "/"), F.regexp_replace(stem, "^.*/", ""), F.lit(".txt"))
    return F.concat(F.regexp_replace(stem, "^(.*/|)images/", "$1labels/"), F.lit(".txt"))


def split_once(c: Column) -> tuple[Column, Column]:
    """What stands before and after the first slash."""
    parts = F.split(c, "/", 2)
    return parts[0], F.get(parts, F.lit(1))


def image_id(path: Column, root: str) -> Column:
    """Path below ``root`` without its suffix."""
    return F.regexp_replace(F.regexp_replace(path, f"^{root.rstrip('/')}/", ""), r"\.[^./]*$", "")


def truthy(c: Column, default: bool) -> Column:
    """1, true, yes, y, on in any case; null takes the default."""
    return F.coalesce(F.lower(F.trim(c)).isin("1", "true", "yes", "y", "on"), F.lit(default))


def bounded_number(c: Column, default: float, least: float | None = None) -> Column:
    """A number from text; what doesn't parse takes the default, what lies below ``least`` is raised to it."""
    x = F.coalesce(c.try_cast("double"), F.lit(float(default)))
    return x if least is None else F.greatest(F.lit(float(least)), x)


def csv_floats(c: Column, default: list[float]) -> Column:
    """Numbers of a comma list; one bad item makes the whole list the default."""
    items = F.filter(F.split(c, ","), lambda x: F.trim(x) != "")
    parsed = F.transform(items, lambda x: F.trim(x).try_cast("double"))
    bad = F.coalesce(F.exists(parsed, lambda x: x.isNull()), F.lit(True)) | (F.size(items) == 0)
    return F.when(bad, F.array(*(F.lit(float(x)) for x in default))).otherwise(parsed)


def csv_words(c: Column) -> Column:
    return F.transform(F.filter(F.split(c, ","), lambda x: F.trim(x) != ""), lambda x: F.lower(F.trim(x)))


def safe_scalar(c: Column) -> Column:
    """A number, 0 where there is none."""
    return F.coalesce(c.try_cast("double"), F.lit(0.0))


def ordered_names(c: Column) -> Column:
    """Class names of a map with integer-like keys, trimmed, in the order of the keys."""
    return F.transform(F.array_sort(F.transform(F.map_entries(c), lambda e: F.struct(e["key"].cast("int").alias("k"), e["value"].alias("v")))), lambda e: F.trim(e["v"]))


def iso_seconds(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")


def warmup_cosine(step: Column, warm: Column, total: Column) -> Column:
    """Learning-rate factor: linear up to ``warm``, then half a cosine."""
    s, w, t = (x.cast("double") for x in (step, warm, total))
    return F.when(s < w, s / F.greatest(F.lit(1.0), w)).otherwise((F.lit(1.0) + F.cos(F.pi() * (s - w) / F.greatest(F.lit(1.0), t - w))) / 2)


def hashed_bits(seed: int, *parts: Column) -> Column:
    """52 bits, as a double, from the SHA-256 of the seed and the parts, joined by colons."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(str(seed)), *(p.cast("string") for p in parts)), 256), 1, 13), 16, 10).cast("double")


def uniform(seed: int, *parts: Column) -> Column:
    """A number in (0, 1] of a row's parts, the same in every engine."""
    return (hashed_bits(seed, *parts) + 1.0) / F.lit(float(2**52))


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays of numbers, summed in order, in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def let(value: Column, f) -> Column:
    """``f(value)`` with the value worked out once, also where ``f`` uses it inside a lambda."""
    return F.element_at(F.transform(F.array(value), f), 1)


def l2_normalise(a: Column, eps: float = 1e-12) -> Column:
    """The vector over its length, the length held at ``eps`` at least."""
    return let(F.greatest(norm(a), F.lit(eps)), lambda n: F.transform(a, lambda x: x.cast("double") / n))
