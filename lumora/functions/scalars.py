"""Scalar functions as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that mark an incomplete sequence in its name.
FRAGMENT_WORDS = ("fragment", "truncated", "partial")
RESIDUES = "ACDEFGHIKLMNPQRSTVWY"


def is_isoform(accession: Column) -> Column:
    """Whether the second '-' field is all digits."""
    return F.coalesce(F.get(F.split(accession, "-"), F.lit(1)).rlike("^[0-9]+$"), F.lit(False))


def canonical(accession: Column) -> Column:
    return F.substring_index(accession, "-", 1)


def is_fragment(name: Column, words: tuple[str, ...] = FRAGMENT_WORDS) -> Column:
    """Whether a name has one of the words; a missing name has none."""
    return F.coalesce(F.lower(name).rlike(rf"(^|[^\p{{L}}\p{{N}}_])({'|'.join(words)})([^\p{{L}}\p{{N}}_]|$)"), F.lit(False))


def is_valid(seq: Column, least: int = 50) -> Column:
    """Long enough, and of the 20 residues alone."""
    return F.coalesce((F.length(seq) >= least) & seq.rlike(f"^[{RESIDUES}]+$"), F.lit(False))


def normalised(text: Column) -> Column:
    """Pasted text without spaces, in upper case."""
    return F.upper(F.regexp_replace(text, r"\s+", ""))


def sequence_hash(seq: Column) -> Column:
    """MD5 of the upper-cased sequence without stop marks."""
    return F.md5(F.replace(F.upper(seq), F.lit("*"), F.lit("")))


def envelope(seq: Column, start: Column, end: Column) -> Column:
    """Residues start to end, counted from 1, both included."""
    return F.substring(seq, start, F.greatest(end - start + 1, F.lit(0)))


def wrapped(seq: Column, width: int = 60) -> Column:
    return F.regexp_replace(seq, f"(.{{{width}}})(?=.)", "$1\n")


def rendered_list(numbers: Column) -> Column:
    """[1, 2, 3]"""
    return F.concat(F.lit("["), F.array_join(F.transform(numbers, lambda x: x.cast("string")), ", "), F.lit("]"))


def config_hash(model: Column, layers: Column, pooling: Column, *more: Column) -> Column:
    """The first 16 digits of the SHA-256 of model|layers|pooling[|longest|stride]; with more parts the layers are sorted."""
    return F.substring(F.sha2(F.concat_ws("|", model, rendered_list(F.array_sort(layers) if more else layers), pooling, *(m.cast("string") for m in more)), 256), 1, 16)


def word_size(identity: Column) -> Column:
    """The word length that a clustering identity asks for."""
    out = F.lit(5)
    for limit, n in ((0.4, 2), (0.5, 3), (0.6, 4), (0.7, 5)):
        out = F.when((identity >= limit) & (identity < 1.0), n).otherwise(out) if limit < 0.7 else F.when(identity >= limit, n).otherwise(out)
    return out


def confidence_flag(p: Column, high: float = 0.7) -> Column:
    return F.when(p >= high, "high").otherwise("low")


RECOMMEND_HIGH, RECOMMEND_LOW = "high confidence: can be used directly", "low confidence: review by hand or validate by experiment"


def recommendation(flag: Column) -> Column:
    return F.when(flag == "high", RECOMMEND_HIGH).otherwise(RECOMMEND_LOW)


def integrity_band(score: Column) -> Column:
    return F.when(score > 0.7, "good").when(score > 0.5, "moderate").otherwise("low")


def signed_percent(x: Column) -> Column:
    """+12.3%"""
    return F.format_string("%+.1f%%", x)


def improvement(value: Column, base: Column) -> Column:
    """Percent above a base; 0 where the base is 0."""
    return F.coalesce(F.try_divide((value - base) * 100, base), F.lit(0.0))


def mean_pool(layers: Column) -> Column:
    """The mean vector of an array of vectors of one length; of none, an empty one."""
    first = F.get(layers, F.lit(0))
    total = F.aggregate(layers, F.transform(first, lambda _: F.lit(0.0)), lambda acc, v: F.zip_with(acc, v, lambda x, y: x + y.cast("double")))
    return F.coalesce(F.transform(total, lambda x: x / F.size(layers)), F.array().cast("array<double>"))


def layer_residue_pool(layers: Column) -> Column:
    """The mean over residues of the mean over layers, of layers x residues x dimensions."""
    residues = F.transform(F.sequence(F.lit(0), F.size(F.get(layers, F.lit(0))) - 1), lambda r: mean_pool(F.transform(layers, lambda layer: F.get(layer, r))))
    return mean_pool(residues)


def cls_pick(layers: Column) -> Column:
    """The first residue's vector in the last layer."""
    return F.transform(F.get(F.element_at(layers, -1), F.lit(0)), lambda x: x.cast("double"))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))
