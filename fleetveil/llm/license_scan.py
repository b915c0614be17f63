"""License scan with DataFrame operations only.

Texts and templates are sequences of five-word shingles; a template of fewer words is one shingle
as a whole, and texts are cut into shingles of that length too. A text is cut into overlapping windows
of one and a half times a size class, half a class apart, so a template's place lies wholly in
some window of its class. Windows whose MinHash agrees with a template's in one of the bands
retrieve it; the number of bands follows from the collision probability that is asked for. A
retrieved template matches if the window contains enough of its shingles, compared as text.

A band's minimum can only agree if it is a shingle of the template, so windows without any
template shingle, and texts without any of a few words that hit all template shingles, are
left out beforehand; nothing that could collide is.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, bound, documents, stored, text_or_empty
from .license_templates import TEMPLATES

SHINGLE = 5
CONTAINMENT_PERCENT = 80
#: Least probability that a window holding a match retrieves its template.
PROBABILITY = 0.999_9

# Words too common to tell anything.
_COMMON = frozenset(
    "a all an and any are as at be by can do for from has he in is it may no not of on or "
    "that the this to under was will with you your".split()
)
_EDGES = "[]().,;:!?\"'*#$%&|<>{}"


def least_similarity() -> float:
    """Jaccard similarity that a match has with its window, at least.

    The template fills more than half its class, the window is one and a half classes long,
    and the part that may be missing adds to the union.
    """
    share = CONTAINMENT_PERCENT / 100
    half = 0.5
    return share * half / (1.5 + (1 - share) * half)


def bands(probability: float = PROBABILITY) -> int:
    """Bands of one row each for which a match collides with the given probability."""
    return math.ceil(math.log(1 - probability) / math.log(1 - least_similarity()))


def words(text: Column) -> Column:
    """Lower-cased words without marks at their edges; words of marks only are left out."""
    edges = "[" + "".join("\\" + c for c in _EDGES) + "]+"
    other = SPACE.replace("[", "[^").rstrip("+")
    bare = F.regexp_replace(F.lower(text), f"(?<!{other}){edges}|{edges}(?!{other})", "")
    return F.filter(F.split(bare, SPACE), lambda w: w != "")


def shingles(sequence: Column, width: int = SHINGLE) -> Column:
    """All shingles of ``width`` words in order; a shorter sequence is one shingle as a whole."""

    def cut(words: Column) -> Column:
        count = F.greatest(F.size(words) - width + 1, F.least(F.size(words), F.lit(1)))
        starts = F.slice(F.sequence(F.lit(0), F.greatest(count, F.lit(1))), F.lit(1), count)
        return F.transform(starts, lambda i: F.array_join(F.slice(words, i + 1, width), " "))

    return bound(sequence, cut)


def min_hashes(window: Column) -> list[Column]:
    """One minimum for each band over the hashes of a window's shingles."""

    def least(band: int) -> Column:
        return F.array_min(F.transform(window, lambda s: F.xxhash64(s, F.lit(band))))

    return [least(band) for band in range(bands())]


def _size_class(n: Column) -> Column:
    """The next power of two, so that a template fills more than half its class."""
    return F.pow(F.lit(2.0), F.ceil(F.log2(n.cast("double")))).cast("int")


def template_frame(spark: SparkSession, templates=TEMPLATES) -> DataFrame:
    """(template, license, width and texts of shingles, size class) of templates; empty texts go."""
    frame = spark.createDataFrame(list(templates), "template string, license string, text string")
    cut = frame.select("template", "license", words(text_or_empty()).alias("w")).where(F.size("w") > 0)
    whole = cut.select(
        "template", "license", F.least(F.size("w"), F.lit(SHINGLE)).alias("width"),
        F.array_distinct(shingles(F.col("w"))).alias("ts"),
    )
    return whole.withColumn("cls", _size_class(F.size("ts")))


def hitting_words(shingle_texts: list[str]) -> list[str]:
    """A few words such that every shingle has one: long ones, which few texts have, first.

    Only words without inner marks are taken, so that they are found however a text is cut.
    """
    left = [{w for w in s.split(" ") if not set(w) & set(_EDGES)} for s in shingle_texts]
    if not all(left):
        raise ValueError("a template has a shingle of words with inner marks only")
    chosen: list[str] = []
    while left:
        counts = Counter(w for s in left for w in s)
        best = max(counts, key=lambda w: (w not in _COMMON, len(w) >= 6, counts[w], len(w), w))
        chosen.append(best)
        left = [s for s in left if best not in s]
    return chosen


def _given(x: Column) -> Column:
    return x.isNotNull()


def _windows(s: Column, hits: Column, width: int, size_class: int) -> Column:
    """The windows of a size class that contain one of the places ``hits``."""
    length, step = max(1, size_class * 3 // 2), max(1, size_class // 2)

    def starts(p: Column) -> Column:
        first = F.greatest(F.ceil((p - length + 1) / step), F.lit(0)).cast("int")
        return F.transform(F.sequence(first, F.floor(p / step).cast("int")), lambda k: k * step)

    def window(at: Column) -> Column:
        return F.struct(
            F.lit(width).alias("width"), F.lit(size_class).alias("cls"), at.alias("start"),
            F.slice(s, at + 1, length).alias("window"),
        )

    return F.transform(F.array_distinct(F.flatten(F.transform(hits, starts))), window)


def license_matches(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """One row per document and template found in it.

    (doc_id, template, license, containment, first_word, last_word): the best window's share
    of the template's shingles and the words it spans, counted after edge marks are removed;
    of equal windows the first. Null and empty texts match nothing; rows that share a doc_id
    are one document; a null doc_id is one too; other columns are ignored; without
    documents or templates the result is empty.
    """
    spark = docs.sparkSession
    known = template_frame(spark, templates)
    # The templates are a list in this process: its size bounds all that follows from it.
    listed = known.collect()
    texts = sorted({s for r in listed for s in r.ts})
    widths = sorted({r.width for r in listed})
    anchors = hitting_words(texts)
    if not anchors:
        docs, anchors = docs.limit(0), [""]
    pieces = F.split(F.lower("text"), SPACE[:-2] + "".join("\\" + c for c in _EDGES) + "]+")
    held = docs.select("doc_id", text_or_empty().alias("text")).where(
        F.arrays_overlap(pieces, F.array(*[F.lit(w) for w in anchors]))
    )

    # Only windows around a template shingle are made; a generator computes them once a text.
    def windows_of(sequence: Column, width: int) -> Column:
        here = [r for r in listed if r.width == width]
        among = F.array(*[F.lit(t) for t in sorted({t for r in here for t in r.ts})])
        classes = sorted({r.cls for r in here})
        return bound(shingles(sequence, width), lambda s: bound(
            F.array_intersect(s, among), lambda known: bound(
                F.filter(F.transform(s, lambda x, i: F.when(F.array_contains(known, x), i)), _given),
                lambda hits: F.concat(*[_windows(s, hits, width, c) for c in classes]),
            )
        ))

    found = F.explode(
        bound(words(F.col("text")), lambda w: F.concat(*[windows_of(w, k) for k in widths]))
    ) if widths else F.explode(
        F.array().cast("array<struct<width:int,cls:int,start:int,window:array<string>>>")
    )
    windows = stored(held.select("doc_id", found.alias("w")).select("doc_id", "w.*"), "license-windows")
    keyed = windows.withColumn("mins", F.array(*min_hashes(F.col("window")))).select(
        "doc_id", "width", "cls", "start", "window", F.posexplode("mins").alias("band", "value")
    )
    sought = known.withColumn("mins", F.array(*min_hashes(F.col("ts")))).select(
        "template", "license", "ts", "width", "cls", F.posexplode("mins").alias("band", "value")
    )
    met = keyed.join(F.broadcast(sought), ["width", "cls", "band", "value"]).dropDuplicates(
        ["doc_id", "template", "start"]
    )
    shared = F.size(F.array_intersect("ts", "window"))
    exact = met.withColumn("shared", shared).where(
        F.col("shared") * 100 >= F.size("ts") * CONTAINMENT_PERCENT
    )
    hits = F.filter(
        F.transform("window", lambda s, i: F.when(F.array_contains("ts", s), i)),
        lambda i: i.isNotNull(),
    )
    best = exact.select(
        "doc_id", "template", "license",
        F.struct(
            (F.col("shared") / F.size("ts")).alias("containment"), (-F.col("start")).alias("order"),
            (F.col("start") + F.array_min(hits)).cast("long").alias("first_word"),
            (F.col("start") + F.array_max(hits) + F.col("width") - 1).cast("long").alias("last_word"),
        ).alias("best"),
    ).groupBy("doc_id", "template", "license").agg(F.max("best").alias("best"))
    return best.select(
        "doc_id", "template", "license", "best.containment", "best.first_word", "best.last_word"
    )


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_matches(documents(spark, sf_dir))
