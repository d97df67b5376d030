"""Column helpers that the operators share: scope, bits, vectors, time, geometry, scores."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- scope ---------------------------------------------------------------------------------------


def normalize_path(path: Column, fold: bool = False) -> Column:
    """Separators become one slash each, a trailing slash goes; `fold` lower-cases."""
    p = F.regexp_replace(path, r"[\\/]+", "/")
    p = F.regexp_replace(p, r"(?<=.)/$", "")
    return F.lower(p) if fold else p


def in_scope(key: Column, root: str) -> Column:
    """Whether a path is the root or lies under it; siblings that share its prefix don't, nor does null.
    Equality and a prefix: both reach the parquet scan."""
    k = F.coalesce(key, F.lit(""))
    return (k == root) | k.startswith(root.rstrip("/") + "/")


def relation(a: Column, b: Column) -> Column:
    """How root `b` lies to root `a`: same, child, parent or disjoint."""
    return F.when(a == b, "same").when(F.startswith(b, F.concat(a, F.lit("/"))), "child").when(F.startswith(a, F.concat(b, F.lit("/"))), "parent").otherwise("disjoint")


# ---- bits and vectors ----------------------------------------------------------------------------


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two 64-bit hashes; 64 if one is missing."""
    return F.coalesce(F.bit_count(a.bitwiseXOR(b)), F.lit(64))


def sign_bits(vector: Column, bits: int = 64) -> Column:
    """A 64-bit hash of the signs of a vector, first element in the highest bit."""
    return F.aggregate(F.slice(vector, 1, bits), F.lit(0).cast("long"), lambda h, x: F.shiftleft(h, 1).bitwiseOR(F.when(x > 0, 1).otherwise(0).cast("long")))


def bands(h: Column) -> Column:
    """The four 16-bit bands of a 64-bit hash, as an array of (band, value)."""
    one = lambda i: F.struct(F.lit(i).alias("band"), F.shiftrightunsigned(h, 48 - 16 * i).bitwiseAND(F.lit(0xFFFF)).alias("value"))
    return F.array(*map(one, range(4)))


def dot(a: Column, b: Column) -> Column:
    """Dot product in double precision, added from the first element on."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """The vector at length 1; null if it is empty, zero or not finite."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    # the norm is bound to a variable, else it is worked out anew for each element
    scaled = lambda norm: F.when(~bad & (norm > 0), F.transform(v, lambda x: x.cast("double") / norm))
    return F.transform(F.array(F.sqrt(dot(v, v))), scaled)[0]


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


# ---- numbers and time ----------------------------------------------------------------------------


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def clip(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), x))


def seconds(ts: Column) -> Column:
    """Epoch seconds of a timestamp without zone."""
    return F.unix_seconds(ts.cast("timestamp"))


def time_from_name(name: Column) -> Column:
    """Epoch seconds of a YYYYMMDD[_-]HHMMSS stamp in a file name, null if there is none or it is no date."""
    got = lambda i: F.regexp_extract(name, r"(20\d{6})[_-]?(\d{6})", i)
    return F.unix_seconds(F.try_to_timestamp(F.nullif(F.concat(got(1), got(2)), F.lit("")), F.lit("yyyyMMddHHmmss")))


def time_from_exif(text: Column) -> Column:
    """Epoch seconds of an EXIF date (two formats; NULs and spaces around it go), null on failure."""
    t = F.trim(F.replace(text, F.lit("\0"), F.lit("")))
    tries = (F.try_to_timestamp(t, F.lit(f)) for f in ("yyyy:MM:dd HH:mm:ss", "yyyy-MM-dd HH:mm:ss"))
    return F.unix_seconds(F.coalesce(*tries))


def capture_time(exif: Column, name: Column, mtime_ns: Column) -> Column:
    """EXIF time, else the time in the name, else the file time."""
    return F.coalesce(time_from_exif(exif), time_from_name(name), F.floor(mtime_ns / 1_000_000_000))


# ---- geometry ------------------------------------------------------------------------------------


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of boxes (x0, y0, x1, y1); 0 for empty ones."""
    side = lambda i: F.greatest(F.lit(0.0), F.least(a[i + 2], b[i + 2]) - F.greatest(a[i], b[i]))
    area = lambda c: (c[2] - c[0]) * (c[3] - c[1])
    both = side(0) * side(1)
    return F.coalesce(F.try_divide(both, area(a) + area(b) - both), F.lit(0.0))


def contains_center(outer: Column, inner: Column) -> Column:
    mid = lambda c, i: (c[i] + c[i + 2]) / 2
    return mid(inner, 0).between(outer[0], outer[2]) & mid(inner, 1).between(outer[1], outer[3])


# ---- scores --------------------------------------------------------------------------------------


#: Megapixels that earn the full bonus, and the variance that makes a sharpness of one half: fixed values.
FULL_MEGAPIXELS, HALF_SHARP = 12.0, 500.0


def resolution_bonus(width: Column, height: Column, reference_mp: float = FULL_MEGAPIXELS) -> Column:
    """From 0 to 1 by megapixels; 0 for a picture of unknown size."""
    return F.when((width > 0) & (height > 0), F.least(F.lit(1.0), width.cast("double") * height / 1e6 / reference_mp)).otherwise(0.0)


def normalize_sharpness(variance: Column, reference: float = HALF_SHARP) -> Column:
    """From 0 to 1, v / (v + reference); 0 without a positive variance."""
    return F.when(variance > 0, variance / (variance + reference)).otherwise(0.0)


def keep_score(quality: Column, face: Column, bonus: Column) -> Column:
    """0.6 of quality (0 to 100), 0.3 of face quality and 0.1 of the resolution bonus."""
    return 0.6 * clip(quality / 100) + 0.3 * F.coalesce(face, F.lit(0.0)) + 0.1 * bonus


#: Weights of the utility score: fixed values.
UTILITY_WEIGHTS = {"quality": 0.40, "face_clarity": 0.25, "exposure": 0.15, "subject_completeness": 0.12, "occlusion_inverse": 0.08}


def utility(**terms: Column) -> Column:
    """Weighted mean of the terms that are present, their weights scaled up to 1; 0 if none is."""
    pairs = [(F.lit(UTILITY_WEIGHTS[k]), v) for k, v in terms.items()]
    total = reduce(add, (F.when(v.isNotNull(), w * v).otherwise(0.0) for w, v in pairs))
    weight = reduce(add, (F.when(v.isNotNull(), w).otherwise(0.0) for w, v in pairs))
    return F.coalesce(F.try_divide(total, weight), F.lit(0.0))


def keeper_budget(n: Column, most: int = 3) -> Column:
    """min(most, 1 + floor(log2 n)), at most n - 1 and at least 1. Bit length instead of a logarithm."""
    bits = F.length(F.bin(n.cast("long")))
    return F.greatest(F.lit(1), F.least(F.lit(most), bits, n.cast("int") - 1)).cast("int")


def token_estimate(text: Column) -> Column:
    return F.ceil(F.octet_length(text) / 3)


def fingerprint(ids: Column) -> Column:
    """Sixteen hex digits of the hash of a set of ids, in numeric order."""
    ordered = F.transform(F.array_sort(F.array_distinct(ids)), lambda x: x.cast("string"))
    return F.substring(F.sha2(F.array_join(ordered, ","), 256), 1, 16)
