"""Column functions over text."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

WIDE = "。！？"
TERMINATORS = ".!?" + WIDE
#: A sentence: what stands before a terminator or a line's end, with its terminators.
SENTENCE = r"[^.!?。！？\n]+[.!?。！？]*"
WIKI_LINK = r"\[\[([^\]]+)\]\]"


def strip(c: Column) -> Column:
    """Without white space at both ends."""
    return F.btrim(c, F.lit(" \t\n\f\r"))


def cut(c: Column, wide: str, narrow: str) -> Column:
    """c split at `wide`, by the pattern `narrow` where c holds no wide terminator: a set of ASCII marks is much faster to test."""
    has = reduce(or_, (F.contains(c, F.lit(x)) for x in WIDE))
    return F.when(has, F.split(c, wide)).otherwise(F.split(c, narrow))


def sentences(c: Column) -> Column:
    """Stripped sentences (see SENTENCE) that are not empty, terminators kept; cut at their ends, which takes a third of the time of matching them."""
    ends = [rf"(?<=[{x}])(?![{x}])|\n" for x in (TERMINATORS, ".!?")]
    parts = F.filter(cut(c, *ends), lambda s: ~F.left(s, F.lit(1)).isin(*TERMINATORS))  # a run alone is no sentence
    return F.filter(F.transform(parts, strip), lambda s: s != "")


def first_sentences(c: Column, n: int, least: int, head: int = 1000) -> Column:
    """The sentences of a text as far as is needed: its first one and the first `n` of `least` letters or more are those of `sentences`.

    They are cut from the text's first `head` letters where these hold more than `n` such sentences, else
    from the whole text. A beginning is cut where the text is, so only its last sentence can differ.
    """
    begun = F.array(sentences(F.left(c, F.lit(head))))  # in an array, so that it is worked out once
    return F.get(F.transform(begun, lambda s: F.when(F.size(F.filter(s, lambda x: F.length(x) >= least)) > n, s).otherwise(sentences(c))), F.lit(0))


def query_terms(c: Column) -> Column:
    """Distinct search terms: [a-z0-9_]+ tokens, and CJK runs with their 2- and 3-grams."""
    tokens = F.regexp_extract_all(F.lower(c), F.lit(r"[a-z0-9_]+|[\x{4e00}-\x{9fff}]+"), F.lit(0))

    def grams(t: Column) -> Column:
        def of(n: int) -> Column:
            last = F.length(t) - (n - 1)
            return F.when(last > 0, F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(t, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

        return F.when(t.rlike(r"^[\x{4e00}-\x{9fff}]+$"), F.concat(F.array(t), of(2), of(3))).otherwise(F.array(t))

    return F.array_distinct(F.flatten(F.transform(tokens, grams)))


def count_of(text: Column, term: Column) -> Column:
    """Occurrences of term in text that do not overlap."""
    return ((F.length(text) - F.length(F.replace(text, term, F.lit("")))) / F.length(term)).cast("int")


def running_sums(values: Column) -> Column:
    """array<long>: the sum of an array of numbers up to each place, in parts of square-root size, so that a long array takes n to the power of 1.5 steps."""
    k = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(values)))).cast("int")
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)
    empty = F.array().cast("array<int>")
    parts = F.transform(F.when(F.size(values) > 0, F.sequence(F.lit(0), F.floor((F.size(values) - 1) / k).cast("int"))).otherwise(empty), lambda b: F.slice(values, b * k + 1, k))
    sums = F.transform(parts, total)
    begins = F.transform(sums, lambda _, i: total(F.slice(sums, F.lit(1), i)))
    return F.flatten(F.zip_with(parts, begins, lambda part, begin: F.transform(part, lambda _, i: begin + total(F.slice(part, F.lit(1), i + 1)))))


def slug(c: Column) -> Column:
    """File-name slug: unsafe characters out, blanks to hyphens, runs of hyphens to one."""
    safe = F.regexp_replace(F.trim(c), r'[<>:"/\\|?*\x00-\x1f]', "")
    dashed = F.regexp_replace(F.replace(safe, F.lit(" "), F.lit("-")), "-{2,}", "-")
    bare = F.regexp_replace(dashed, "^-+|-+$", "")
    return F.when(bare == "", F.trim(c)).otherwise(bare)


def safe_name(c: Column, replacement: str = "_", most: int = 255) -> Column:
    """File name: control characters out, path parts and all but letters, digits, marks and `._- ()[]{}` replaced, runs of the replacement to one, no dots or blanks at the ends."""
    bare = F.regexp_replace(c, r"\p{C}", "")
    flat = F.regexp_replace(F.regexp_replace(bare, r"\.\.|/|\\", replacement), r"[^\p{L}\p{N}\p{M}._\- ()\[\]{}]", replacement)
    one = F.regexp_replace(flat, f"(?:{replacement}){{2,}}", replacement)
    cut = F.left(F.regexp_replace(one, r"^[. ]+|[. ]+$", ""), F.lit(most))
    return F.when(F.coalesce(c, F.lit("")) == "", F.lit(replacement)).when(cut == "", F.lit("unnamed")).otherwise(cut)


def artifact_name(c: Column, most: int) -> Column:
    """Name of an artifact's file from a title or concept: unsafe characters out, at most so many letters."""
    return F.left(F.trim(F.regexp_replace(c, r'[<>:"/\\|?*]', "")), F.lit(most))


def shortened(c: Column, most: int, suffix: str = "...") -> Column:
    """A text of more than `most` letters, cut to that length with a suffix in it."""
    return F.when(F.length(c) > most, F.concat(F.left(c, F.lit(most - len(suffix))), F.lit(suffix))).otherwise(c)


def clean_references(c: Column) -> Column:
    """Text for a note vault: source ids in brackets as a reference, front matter and compile dates out, blank lines to one."""
    c = F.regexp_replace(c, r"\(SRC-(\d{4})\)", "📚 来源: SRC-$1")
    c = F.regexp_replace(c, r"(?s)^---\n.*?\n---\n", "")
    c = F.regexp_replace(c, r"(?m)^> 编译时间：.*$", "")
    return strip(F.regexp_replace(c, r"\n{3,}", "\n\n"))


def base_stem(c: Column) -> Column:
    """A file stem without the suffix that its source's id gave it."""
    return F.regexp_replace(c, r"_SRC-\d+$", "")


def manifest_id(c: Column) -> Column:
    """The first source id in a vector's or file's name; empty if none."""
    return F.regexp_extract(c, r"(SRC-\d+)", 1)


def without_embedded_images(c: Column) -> Column:
    """Markdown or HTML text without base64 image data."""
    return F.regexp_replace(c, r"data:image/[a-zA-Z+.-]+;base64,[A-Za-z0-9+/=]+", "")


def expand_abbreviations(c: Column, table: dict[str, str]) -> Column:
    """Whole-word, case-insensitive replacement, in the table's order."""
    for short, full in table.items():
        c = F.regexp_replace(c, rf"(?i)\b{short}\b", full)
    return c


def rewrite_terms(c: Column, table: dict[str, str]) -> Column:
    """Literal replacements in the table's order; a later one sees what an earlier one wrote."""
    for old, new in table.items():
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def error_kind(c: Column) -> Column:
    """rate_limit, timeout or other, from an error message."""
    low = F.lower(c)
    return F.when(low.contains("429") | low.contains("rate"), "rate_limit").when(low.contains("timeout") | low.contains("timed out"), "timeout").otherwise("other")
