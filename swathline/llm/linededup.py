"""Cross-site boilerplate lines, found by their spread over sites, and removed.

A line is what stands between line feeds; it is compared by a 64-bit hash of its text without surrounding white space, every
inner run of white space (tabs, carriage returns and wide spaces too) counting as one space.
One HyperLogLog sketch of the sites is kept per line hash; sketches merge by aggregation, also before the shuffle, so a
line that is everywhere costs as much as any other. Lines whose estimate is near the threshold get an exact distinct
count; those clearly beyond it are boilerplate, those clearly below it aren't.

A boilerplate line stays in the document with the smallest id among those that hold it and leaves all others, so
that of a group of copies one document stays whole. Lines of fewer than ``min_words`` words are never boilerplate:
they repeat by chance. Words are parted by any white space; in scripts written without spaces every character counts as one.
``min_words`` = 1 judges every line that isn't empty. A document whose lines all go keeps its row, with an empty text.

Null text: stays null, no lines. Null site: counts as no site. Null id: the row counts towards the sites and is left as it
is. Repeated rows: each loses the same lines; rows that share the smallest id all keep theirs. Empty table: empty result.
Extra columns are carried along unchanged, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swathline.llm.common import unused_names
from swathline.session import cut_lineage

MIN_SITES = 4
MIN_WORDS = 4
LOG_K = 10
#: An estimate within so many standard errors of the threshold is counted exactly.
ERRORS = 4
#: White space beside the space in ASCII and beyond it, and the characters of scripts that don't part words by it (Thai to Khmer,
#: kana, Han).
SPACES = r"\t\x0b\f\r\x1c\x1d\x1e\x1f"
WIDE_SPACES = r"\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
UNSPACED = (
    r"\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u2e80-\u2fdf\u3005-\u3007\u3021-\u3029\u3038-\u30ff"
    r"\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\x{20000}-\x{3ffff}"
)


def _single_spaced(text: Column) -> Column:
    """The text with one space for all white space but line feeds."""
    wide = _has_other_scripts(text) & text.rlike(f"[{WIDE_SPACES}]")
    other = F.contains(text, F.lit("  ")) | text.rlike(f"[{SPACES}]") | wide
    return F.when(other, F.regexp_replace(text, f"[ {SPACES}{WIDE_SPACES}]+", " ")).otherwise(text)


def _has_other_scripts(text: Column) -> Column:
    """Whether some character takes more than one byte."""
    return F.octet_length(text) != F.char_length(text)


def _long_enough(line: Column, min_words: int) -> Column:
    """Whether a trimmed line of single-spaced text has ``min_words`` words and any at all."""
    spaced = F.substring_index(line, " ", max(min_words, 1) - 1) != line
    unspaced = line.rlike(f"^(?:(?:[{UNSPACED}]|[^ {UNSPACED}]++) ?+){{{min_words}}}")
    return (line != "") & (spaced | (_has_other_scripts(line) & unspaced))


def _lines(docs: DataFrame, min_words: int, id_col: str, text_col: str, site_col: str) -> DataFrame:
    """(doc, body, site, at, line): hashes of text, site and line, and the place of each line that is long enough.

    The texts are split and compared here alone; all that follows works on hashes and places.
    """
    text = F.col(text_col).cast("string")
    split = docs.select(
        F.col(id_col).alias("doc"),
        F.xxhash64(text).alias("body"),
        F.when(F.col(site_col).isNotNull(), F.xxhash64(F.col(site_col))).alias("site"),
        F.posexplode(F.split(_single_spaced(text), "\n")).alias("at", "text"),
    ).withColumn("text", F.trim("text"))
    return split.filter(_long_enough(F.col("text"), min_words)).select("doc", "body", "site", "at", F.xxhash64("text").alias("line"))


def _spread(lines: DataFrame, min_sites: int, log_k: int) -> DataFrame:
    error = ERRORS * 1.04 / (1 << log_k) ** 0.5
    spread = lines.groupBy("line").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("site", log_k)).alias("estimate"), F.min("doc").alias("first")
    )
    possible = cut_lineage(spread.filter(F.col("estimate") >= F.lit(min_sites / (1 + error))))
    near = possible.filter(F.col("estimate") <= F.lit(min_sites / (1 - error)))
    by_site = lines.filter(F.col("site").isNotNull()).select("line", "site").distinct()  # a common line has few sites
    exact = by_site.join(near.select("line"), "line", "left_semi").groupBy("line").agg(F.count("*").alias("exact"))
    return (
        possible.join(exact, "line", "left")
        .withColumn("sites", F.coalesce("exact", F.col("estimate").cast("bigint")))
        .filter(F.col("sites") >= min_sites)
        .select("line", "first", "sites")
    )


def boilerplate(
    docs: DataFrame, min_sites: int = MIN_SITES, min_words: int = MIN_WORDS, log_k: int = LOG_K, id_col: str = "doc_id",
    text_col: str = "text", site_col: str = "source",
) -> DataFrame:
    """(line, first, sites): the hash of each boilerplate line, the smallest id that holds it, and its number of sites."""
    return _spread(cut_lineage(_lines(docs, min_words, id_col, text_col, site_col)), min_sites, log_k)


def remove_boilerplate(
    docs: DataFrame, min_sites: int = MIN_SITES, min_words: int = MIN_WORDS, log_k: int = LOG_K, id_col: str = "doc_id",
    text_col: str = "text", site_col: str = "source", removed_col: str | None = None,
) -> DataFrame:
    """The documents, with boilerplate lines taken out of their text; ``removed_col``: how many, if a name is given."""
    lines = cut_lineage(_lines(docs, min_words, id_col, text_col, site_col))
    bad = cut_lineage(_spread(lines, min_sites, log_k).filter(F.col("first").isNotNull()))
    doc, body, drop = unused_names(docs, "doc", "body", "drop")
    drops = (
        lines.join(bad, "line")
        .filter(F.col("doc") != F.col("first"))
        .groupBy(F.col("doc").alias(doc), F.col("body").alias(body))
        .agg(F.collect_set("at").alias(drop))
    )
    own = F.xxhash64(F.col(text_col).cast("string"))
    joined = docs.join(drops, (F.col(id_col) == F.col(doc)) & (own == F.col(body)), "left")
    stays = F.filter(F.split(F.col(text_col), "\n"), lambda _, at: ~F.array_contains(F.col(drop), at))
    touched = F.col(drop).isNotNull()
    columns = [
        F.when(touched, F.array_join(stays, "\n")).otherwise(F.col(c)).alias(c) if c == text_col else F.col(c)
        for c in docs.columns
    ]
    if removed_col:
        columns.append(F.when(touched, F.size(drop)).otherwise(0).cast("bigint").alias(removed_col))
    return joined.select(*columns)
