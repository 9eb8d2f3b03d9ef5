"""Licence scans: sparse TF-IDF cosine to templates, then inheritance from the nearest ancestor directory; DataFrame operations only."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import free_names, store
from .licence_texts import TEMPLATES

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = "[a-z0-9]+"
#: Names of files that state the licence of their directory.
LICENCE_FILE = r"(?i)(?:^|/)(?:licen[cs]e|copying|unlicense)[^/]*$"
#: A text without any of these, in lower case, is not looked at; every template has one.
HINTS = ("licen", "redistribut", "permission is", "permission to", "without warrant", "express or implied", "public domain", "prior written permission")
#: A tag that names its licence itself.
TAG = r"SPDX-License-Identifier:[ \t]*\(?([A-Za-z0-9][A-Za-z0-9.+\-]*(?:[ \t]+(?:AND|OR|WITH)[ \t]+[A-Za-z0-9][A-Za-z0-9.+\-]*)*)"
#: Words too common in prose to say where a notice stands.
COMMON = "a an all and any are as at be by can for form free from given has have if in into is it may no not of on one or other out shall such that the their there these this to under use was we which will with without work you your".split()


class Index:
    """Weights and places of the templates' terms.

    A term's weight is its count times ln((1 + T) / (1 + templates with it)) + 1; a term of no template
    weighs as one with none, so that other words in a window count against it.
    """

    def __init__(self, templates: Sequence[tuple[str, str, str]]):
        if any(not any(h in text.lower() for h in HINTS) for _, _, text in templates):
            raise ValueError("a template has none of the hints")
        words = [re.findall(WORD, text.lower()) for _, _, text in templates]
        spread = Counter(t for own in words for t in set(own))
        self.idf = {t: math.log((1 + len(words)) / (1 + n)) + 1 for t, n in spread.items()}
        self.other = math.log(1 + len(words)) + 1
        #: (template, licence, whether it counts in licence files alone, words)
        self.templates = [(i, licence, kind == "title", len(own)) for i, ((licence, kind, _), own) in enumerate(zip(templates, words, strict=True))]
        #: (term, template, weight over the template's norm)
        self.weights: list[tuple[str, int, float]] = []
        #: (term, template, place)
        self.places: list[tuple[str, int, int]] = []
        for i, own in enumerate(words):
            counts = Counter(own)
            norm = math.sqrt(sum((n * self.idf[t]) ** 2 for t, n in counts.items()))
            self.weights += [(t, i, n * self.idf[t] / norm) for t, n in counts.items()]
            self.places += [(t, i, q) for q, t in enumerate(own) if t not in COMMON]


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(f"({WORD})"), F.lit(1))


def nearest_template(texts: DataFrame, index: Index, threshold: float) -> DataFrame:
    """(_row, cosine, licence) of the rows (_row, _named, _words) that reach the threshold; on a tie the licence that sorts last.

    Each template is laid over a text where most of its words, common ones
    apart, fall on the same ones (the first of several such places), and the
    words under it are compared by the cosine. Line breaks and comment marks
    are no words, so wrapped notices are as good as whole ones. The postings
    are as few as the words of the templates passed in, so they are broadcast.
    """
    spark = texts.sparkSession
    small = lambda rows, schema: F.broadcast(spark.createDataFrame(rows, schema))
    places = small(index.places, "term string, template int, place int")
    shapes = small(index.templates, "template int, licence string, title boolean, length int")
    weights = small(index.weights, "term string, template int, weight double")
    idf = small(list(index.idf.items()), "term string, idf double")

    seen = texts.select("_row", F.posexplode("_words").alias("at", "term")).join(places, "term")
    laid = seen.groupBy("_row", "template").agg(F.mode(F.col("at") - F.col("place"), True).alias("start"))
    windows = texts.join(laid, "_row").join(shapes, "template").where("_named or not title")
    under = F.explode(F.slice("_words", F.greatest(F.col("start"), F.lit(0)) + 1, F.col("length")))
    terms = windows.select("_row", "template", "licence", under.alias("term")).groupBy("_row", "template", "licence", "term").agg(F.count("*").alias("n"))
    own = F.col("n") * F.coalesce("idf", F.lit(index.other))
    scored = (
        terms.join(idf, "term", "left")
        .join(weights, ["term", "template"], "left")
        .groupBy("_row", "template", "licence")
        .agg(F.sum(own * F.col("weight")).alias("dot"), F.sqrt(F.sum(own * own)).alias("norm"))
    )
    best = scored.select("_row", F.struct(F.round(F.col("dot") / F.col("norm"), 6).alias("cosine"), "licence").alias("m")).where(F.col("m.cosine") >= threshold)
    return best.groupBy("_row").agg(F.max("m").alias("m")).select("_row", "m.cosine", "m.licence")


def scan_licences(
    files: DataFrame, path: Column, id_col: str = "doc_id", text_col: str = "text", templates: Sequence[tuple[str, str, str]] = TEMPLATES, threshold: float = 0.8
) -> DataFrame:
    """Licence of every row: stated in the file, or inherited from the nearest directory above with a licence file.

    Columns: ``id_col``, path, licence (an SPDX identifier or expression),
    basis (``tag``, ``header``, ``inherited`` or null), licence_dir, cosine. An
    SPDX tag is taken at its word, the first of several. Otherwise a file has
    the licence of the template nearest to a part of it, at a cosine of
    ``threshold`` or more. A file named as a licence file speaks for its
    directory; of several in a directory, that whose path sorts first does. A
    file without a statement takes that of the nearest directory at or above
    its own. Null and empty texts state nothing, a null path lies in no
    directory, rows repeat as they stand in files; other columns are not read.

    Texts without a hint of a licence, which is most of them, are passed over
    in one scan; of the others only the words are kept. All that follows is
    keyed by row, template and word, so a notice that stands in very many
    files gathers nowhere. Directories, not files, are joined to their
    ancestors.
    """
    index = Index(templates)
    path_, licence_, basis_, dir_, cosine_ = free_names([id_col], "path", "licence", "basis", "licence_dir", "cosine")
    text = F.coalesce(F.col(text_col), F.lit(""))
    lowered = F.lower(text)
    hinted = F.lit(False)
    for hint in HINTS:
        hinted |= F.contains(F.col("_lowered"), F.lit(hint))
    slim = store(
        files.select(F.col(id_col).alias("_id"), path.alias("_path"), text.alias("_text"), lowered.alias("_lowered"), F.monotonically_increasing_id().alias("_row")).select(
            "_row", "_id", "_path",
            F.coalesce(F.col("_path").rlike(LICENCE_FILE), F.lit(False)).alias("_named"),
            F.regexp_extract("_path", r"(?s)^(.*)/[^/]*$", 1).alias("_dir"),
            F.when(hinted, words_of(F.col("_text"))).alias("_words"),
            F.when(F.contains(F.col("_lowered"), F.lit("spdx-license-identifier:")), F.regexp_extract("_text", TAG, 1)).alias("_tag"),
        ),
        "licences",
    )
    found = nearest_template(slim.where("size(_words) > 0").select("_row", "_named", "_words"), index, threshold)
    tag = F.when(F.col("_tag") != "", F.regexp_replace("_tag", r"[ \t]+", " "))
    own = (
        slim.drop("_words")
        .join(found, "_row", "left")
        .select(
            "_id", "_path", "_dir", "_named",
            F.coalesce(tag, "licence").alias("_licence"),
            F.when(tag.isNotNull(), "tag").when(F.col("licence").isNotNull(), "header").alias("_basis"),
            F.when(tag.isNotNull(), F.lit(1.0)).otherwise(F.col("cosine")).alias("_cosine"),
        )
    )
    speaking = (
        own.where("_named and _licence is not null and _path is not null")
        .groupBy(F.col("_dir").alias("_from"))
        .agg(F.min(F.struct("_path", (-F.col("_cosine")).alias("far"), "_licence")).alias("first"))
        .select("_from", F.col("first._licence").alias("_given"))
    )
    parts = F.split(F.col("_dir"), "/", -1)
    upward = (
        own.where("_path is not null").select("_dir").distinct()
        .select("_dir", F.explode(F.sequence(F.lit(0), F.size(parts))).alias("_depth"))
        .select("_dir", F.array_join(F.slice(parts, F.lit(1), F.col("_depth")), "/").alias("_from"), "_depth")
    )
    nearest = upward.join(speaking, "_from").groupBy("_dir").agg(F.max(F.struct("_depth", "_from", "_given")).alias("near")).select("_dir", "near._from", "near._given")
    inherits = F.col("_licence").isNull() & F.col("_path").isNotNull()
    return own.join(nearest, "_dir", "left").select(
        F.col("_id").alias(id_col),
        F.col("_path").alias(path_),
        F.coalesce("_licence", F.when(inherits, F.col("_given"))).alias(licence_),
        F.coalesce("_basis", F.when(inherits & F.col("_given").isNotNull(), "inherited")).alias(basis_),
        F.when(inherits, F.col("_from")).alias(dir_),
        F.col("_cosine").alias(cosine_),
    )
