"""Scalar expressions: names, guards, intervals.  All are plain columns, so they fuse into code generation."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Integer weights add up to this scale.
WEIGHT_SCALE = 1 << 24
#: The held-out set of the track-corrected intervals.
TRACKS, FRAMES_PER_TRACK = 421, 30
#: Corruption -> family.
FAMILIES = {
    "gaussian_noise": "noise", "shot_noise": "noise", "impulse_noise": "noise", "speckle_noise": "noise",
    "defocus_blur": "blur", "motion_blur": "blur", "zoom_blur": "blur", "glass_blur": "blur", "gaussian_blur": "blur",
    "snow": "weather", "frost": "weather", "fog": "weather", "spatter": "weather",
    "brightness": "digital", "contrast": "digital", "pixelate": "digital", "jpeg_compression": "digital",
    "elastic_transform": "digital", "saturate": "digital",
    "clean": "clean",
}
#: The corruptions of the bank, those held back, and the severities.
SEEN = ("gaussian_noise", "shot_noise", "impulse_noise", "defocus_blur", "motion_blur", "zoom_blur", "snow", "frost", "fog", "contrast", "pixelate", "jpeg_compression")
UNSEEN = ("speckle_noise", "gaussian_blur", "brightness", "elastic_transform")
SEVERITIES = (1, 3, 5)
ALGORITHMS = ("FedAvg", "FedProx", "FedLC", "FedDisco", "FIPA")


def track_of(name: Column) -> Column:
    """File name without extension and trailing ``_<digits>``; without such a tail, the whole stem."""
    stem = F.regexp_replace(name, r"\.[^./]*$", "")
    return F.coalesce(F.nullif(F.regexp_extract(stem, r"^(.+)_\d+$", 1), F.lit("")), stem)


def condition_name(corruption: Column, severity: Column) -> Column:
    return F.concat(corruption, F.lit("_s"), severity.cast("string"))


def _base(condition: Column) -> Column:
    return F.regexp_replace(condition, "_again$", "")


def corruption_of(condition: Column) -> Column:
    """``fog_s5`` -> ``fog``; a name without severity is its own corruption; a second visit's tail goes."""
    b = _base(condition)
    return F.coalesce(F.nullif(F.regexp_extract(b, r"^(.+)_s(\d+)$", 1), F.lit("")), b)


def severity_of(condition: Column) -> Column:
    return F.nullif(F.regexp_extract(_base(condition), r"^(.+)_s(\d+)$", 2), F.lit("")).cast("int")


def family_of(corruption: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in FAMILIES.items() for x in kv])
    return F.coalesce(F.try_element_at(table, corruption), F.lit("other"))


def shuffle_seed(name: Column, base: int = 0) -> Column:
    """``base`` plus the trailing number of the name, else plus its crc32; mod 2**31."""
    n = F.nullif(F.regexp_extract(name, r"(\d+)$", 1), F.lit("")).cast("long")
    return F.pmod(F.lit(base) + F.coalesce(n, F.crc32(name.cast("binary"))), F.lit(2**31)).cast("long")


def derive_seed(*parts: object) -> int:
    """A 32-bit seed from any parts: blake2b of their texts, each ended by a zero byte."""
    digest = hashlib.blake2b("".join(f"{p}\0" for p in parts).encode(), digest_size=8).digest()
    return int.from_bytes(digest, "big") % (2**32 - 1)


def derived_seed(*parts: Column) -> Column:
    """:func:`derive_seed` of the rows' parts (texts and whole numbers), in Arrow batches: the engine has no blake2b of its own."""

    @F.pandas_udf("long")
    def run(text: pd.Series) -> pd.Series:
        return text.map(lambda t: int.from_bytes(hashlib.blake2b(t.encode(), digest_size=8).digest(), "big") % (2**32 - 1))

    return run(F.concat(*[F.concat(F.coalesce(p.cast("string"), F.lit("None")), F.lit("\0")) for p in parts]))


def effective_algorithm(algorithm: Column, round_number: Column, warmup: Column) -> Column:
    """Preconditioned aggregation runs as plain averaging until its warm-up is over; unknown names raise."""
    known = F.when(warmup < 0, F.raise_error(F.lit("negative warm-up"))).when(~algorithm.isin(*ALGORITHMS), F.raise_error(F.concat(F.lit("unknown rule "), algorithm)))
    return known.when((algorithm == "FIPA") & (round_number < warmup), F.lit("FedAvg")).otherwise(algorithm)


def client_denominator(algorithm: Column, total: Column, encrypted: Column) -> Column:
    """What a client divides an aggregate by: total size for sums, the integer scale for encrypted discounts, else 1."""
    return (
        F.when(algorithm.isin("FedAvg", "FedProx", "FedLC"), total.cast("double"))
        .when((algorithm == "FedDisco") & encrypted, F.lit(float(WEIGHT_SCALE)))
        .otherwise(F.lit(1.0))
    )


def descale(values: Column, denominator: Column) -> Column:
    return F.when(denominator > 0, F.transform(values, lambda x: x / denominator)).otherwise(values)


def payload_guard(kind: Column, expected: str) -> Column:
    """The payload kind (missing: weights), or an error if it is not the expected one."""
    found = F.coalesce(kind, F.lit("weights"))
    return F.when(found == expected, found).otherwise(F.raise_error(F.concat(F.lit(f"expected {expected}, got "), found)))


def retention(accuracy: Column, clean: Column) -> Column:
    return F.when(clean > 0, accuracy / clean).otherwise(F.raise_error(F.lit("clean accuracy must be positive")).cast("double"))


def effective_sample_size(n: Column, tracks: int = TRACKS, frames: int = FRAMES_PER_TRACK, rho: float = 1.0) -> Column:
    """Independent observations in n images of ``tracks`` tracks, by the design effect; at least 1."""
    all_ = float(tracks * frames)
    touched = F.when(n >= all_, F.lit(float(tracks))).otherwise(F.lit(float(tracks)) * (F.lit(1.0) - F.pow(F.lit(1.0) - n / F.lit(all_), F.lit(float(frames)))))
    return F.when(n <= 0, F.lit(1.0)).otherwise(F.greatest(F.lit(1.0), n / (F.lit(1.0) + (n / touched - 1) * rho)))


def wilson(p: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """The Wilson interval of a proportion, clipped to [0, 1]."""
    d = 1 + z * z / n
    centre = (p + z * z / (2 * n)) / d
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / d
    return F.greatest(F.lit(0.0), centre - half), F.least(F.lit(1.0), centre + half)


def accuracy_interval(accuracy: Column, n: Column) -> tuple[Column, Column]:
    return wilson(accuracy, effective_sample_size(n))


def file_stem(name: Column) -> Column:
    """A name safe for files: anything but letters, digits, dot, underscore and dash becomes a dash."""
    return F.regexp_replace(name, r"[^A-Za-z0-9._-]", "-")


def layer_matches(layer: Column, *prefixes: str) -> Column:
    """A layer named by a prefix or standing below one."""
    hit = F.lit(False)
    for p in prefixes:
        hit = hit | (layer == p) | layer.startswith(p + ".")
    return hit


def symmetric_kl_term(m1: Column, v1: Column, m2: Column, v2: Column, floor: float = 1e-8) -> Column:
    """One channel's share of the symmetric divergence of two Gaussians."""
    a, b, d = F.greatest(v1, F.lit(floor)), F.greatest(v2, F.lit(floor)), m1 - m2
    return (a + d * d) / (2 * b) + (b + d * d) / (2 * a) - 1


def estimated_bytes(images: Column, size: Column) -> Column:
    """Disk for images of size x size pixels, at 17.3 KB for 128 x 128."""
    return images * F.lit(17.3e3) * F.pow(size / 128.0, F.lit(2.0))
