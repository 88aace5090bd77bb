"""Scalar text functions as Column expressions; nothing here leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .jsregex import SPACE, js

# Fixed value: marker between head and tail of a truncated file.
FILE_CUT_MARKER = "\n\n[... TRUNCATED — middle section omitted for token budget ...]\n\n"


# -- lengths and token estimates ------------------------------------------------

def units(s: Column) -> Column:
    """Length in UTF-16 code units (an astral character counts twice)."""
    pair = r"[\x{10000}-\x{10FFFF}]"
    return F.when(s.rlike(pair), F.length(s) + F.regexp_count(s, F.lit(pair))).otherwise(F.length(s))


def tokens(s: Column) -> Column:
    """Four characters to the token, rounded up."""
    return F.ceil(units(s) / 4)


def trace_tokens(chars: Column) -> Column:
    """Session digests use the coarser 0.4 tokens per character."""
    return chars * F.lit(0.4)


def head_and_tail(content: Column, budget: Column) -> Column:
    half = F.floor(budget / 2 * 4).cast("int")
    return F.concat(F.left(content, half), F.lit(FILE_CUT_MARKER), F.right(content, half))


def cut_middle(content: Column, budget: int) -> Column:
    """Keep head and tail of a text that is over ``budget`` tokens."""
    return F.when(tokens(content) <= budget, content).otherwise(head_and_tail(content, F.lit(budget)))


# -- white space ----------------------------------------------------------------

def trim(s: Column) -> Column:
    """Trim every kind of white space, newlines included.

    Few texts begin or end with any, and the pattern is tried at every character: it runs on those only.
    """
    edges = F.concat(F.left(s, F.lit(1)), F.right(s, F.lit(1)))
    return F.when(edges.rlike(SPACE), F.regexp_replace(s, rf"^{SPACE}+|{SPACE}+\z", "")).otherwise(s)


def squeeze(s: Column) -> Column:
    return F.regexp_replace(s, f"{SPACE}+", " ")


def strip_punctuation(s: Column) -> Column:
    return F.regexp_replace(s, js(r"[^\w\s]"), "")


def clean_control(s: Column) -> Column:
    """Blank control characters, then cap at 200 characters."""
    return F.left(F.regexp_replace(s, r"[\x00-\x1F\x7F]", " "), F.lit(200))


# -- summaries ------------------------------------------------------------------

def summary_key(s: Column) -> Column:
    """Summary as compared by the report merge: squeeze, then strip."""
    return strip_punctuation(squeeze(trim(F.lower(s))))


def summary_normal(s: Column) -> Column:
    """Summary as normalised for model comparison: strip, then squeeze."""
    return squeeze(strip_punctuation(trim(F.lower(s))))


def words_key(s: Column) -> Column:
    """Distinct words of a summary for the report merge."""
    return F.array_distinct(F.array_remove(F.split(summary_key(s), " "), ""))


def words_raw(s: Column) -> Column:
    """Distinct words for the scan merge; leading blanks leave an empty word."""
    return F.array_distinct(F.split(F.lower(s), f"{SPACE}+"))


def words_plain(s: Column) -> Column:
    """Distinct non-empty words for model voting."""
    return F.array_remove(words_raw(s), "")


def jaccard(a: Column, b: Column, both_empty: float = 1.0) -> Column:
    """Set similarity of two arrays of distinct words."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either == 0, F.lit(both_empty)).otherwise(both / either)


# -- locations ------------------------------------------------------------------

def file_of(location: Column) -> Column:
    """Text before the first colon, trimmed, case kept."""
    return trim(F.split_part(location, F.lit(":"), F.lit(1)))


def file_key(location: Column) -> Column:
    """File used to compare findings: lower case and trimmed."""
    return trim(F.lower(F.split_part(location, F.lit(":"), F.lit(1))))


def file_lower(location: Column) -> Column:
    """File used by model voting: lower case, not trimmed."""
    return F.split_part(F.lower(location), F.lit(":"), F.lit(1))


def line_lenient(location: Column) -> Column:
    """Leading integer of the second colon part, or null."""
    part = F.split_part(location, F.lit(":"), F.lit(2))
    return F.regexp_extract(part, rf"^{SPACE}*([+-]?\d+)", 1).try_cast("long")


def inline_path(location: Column) -> Column:
    """Path of a strict ``path:line[-line]`` location, or null."""
    good = _inline(location, 2).try_cast("long") > 0
    return F.when(good, _inline(location, 1))


def inline_line(location: Column) -> Column:
    line = _inline(location, 2).try_cast("long")
    return F.when(line > 0, line)


def _inline(location: Column, group: int) -> Column:
    return F.nullif(F.regexp_extract(location, js(r"^(.+?):(\d+)(?:-\d+)?$"), group), F.lit(""))


def sarif_file(location: Column) -> Column:
    pattern = js(r"^(.+?)(?::(\d+))?$")
    return F.when(location.rlike(pattern), F.regexp_extract(location, pattern, 1)).otherwise(location)


def sarif_line(location: Column) -> Column:
    digits = F.regexp_extract(location, js(r"^(.+?)(?::(\d+))?$"), 2)
    # More digits than a long holds: the largest line there is.
    return F.when(digits == "", F.lit(1).cast("long")).otherwise(F.coalesce(digits.try_cast("long"), F.lit((1 << 63) - 1)))


def location_normal(location: Column) -> Column:
    """Lower, trim, drop a trailing line number, forward slashes."""
    bare = F.regexp_replace(trim(F.lower(location)), r":\d+\z", "")
    return F.replace(bare, F.lit("\\"), F.lit("/"))


def fingerprint(location: Column, category: Column, summary: Column) -> Column:
    """Line-independent identity of a finding."""
    text = F.concat_ws("||", file_of(location), trim(F.lower(category)),
                       F.left(trim(F.lower(summary)), F.lit(100)))
    return F.sha2(text, 256)


def entropy(s: Column) -> Column:
    """Shannon entropy in bits per character."""
    chars = F.filter(F.split(s, ""), lambda c: c != "")
    n = F.size(chars)
    total = F.aggregate(
        F.array_distinct(chars), F.lit(0.0),
        lambda acc, c: acc - ((n - F.size(F.array_remove(chars, c))) / n)
        * F.log2((n - F.size(F.array_remove(chars, c))) / n))
    return F.when(F.coalesce(F.length(s), F.lit(0)) == 0, F.lit(0.0)).otherwise(total)


# -- paths and hosts ------------------------------------------------------------

def normalize_path(path: Column) -> Column:
    """Collapse ``.`` and ``..`` segments."""
    stack = F.aggregate(
        F.split(path, "/"), F.array().cast("array<string>"),
        lambda acc, part: F.when(part == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .when(part == ".", acc).otherwise(F.array_append(acc, part)))
    return F.array_join(stack, "/")


def is_relative(spec: Column) -> Column:
    return spec.startswith("./") | spec.startswith("../") | spec.isin(".", "..")


def clean_domain(domain: Column) -> Column:
    return F.left(trim(squeeze(F.regexp_replace(domain, r"[\r\n\t]", ""))), F.lit(253))


def hostname(url: Column) -> Column:
    """Lower-case host of a URL or bare host name; null when malformed."""
    full = F.when(url.contains("://"), url).otherwise(F.concat(F.lit("https://"), url))
    host = F.regexp_extract(full, r"^[A-Za-z][A-Za-z0-9+.\-]*:/{2,}(?:[^/?#\\]*@)?(\[[0-9A-Fa-f:.]+\]|[^/?#\\:@\s]+)(?::\d{0,5})?(?:[/?#\\].*)?\z", 1)
    return F.when(F.coalesce(url, F.lit("")) != "", F.nullif(F.lower(host), F.lit("")))


# -- responses ------------------------------------------------------------------

def extract_patch(raw: Column) -> Column:
    """Fenced diff, else a bare unified diff, else the whole text."""
    fenced = js(r"```(?:diff|patch)?\s*\n([\s\S]*?)```", "i")
    bare = js(r"((?:diff --git|---)\s[\s\S]*)")
    return trim(F.when(raw.rlike(fenced), F.regexp_extract(raw, fenced, 1))
                .when(raw.rlike(bare), F.regexp_extract(raw, bare, 1)).otherwise(raw))


def extract_explanation(raw: Column) -> Column:
    pattern = js(r"Explanation:\s*(.+)", "i")
    return F.when(raw.rlike(pattern), trim(F.regexp_extract(raw, pattern, 1))).otherwise(
        F.lit("Fix applied for the described issue."))


def clamp_score(score: Column) -> Column:
    """Round half up and clamp to 0..100; non-finite is 0."""
    bad = score.isNull() | F.isnan(score) | (F.abs(score) == float("inf"))
    return F.when(bad, F.lit(0)).otherwise(
        F.greatest(F.lit(0), F.least(F.lit(100), F.floor(score + 0.5)))).cast("int")


def duration(ms: Column) -> Column:
    sec = F.floor(ms / 1000)
    return (F.when(ms.isNull(), F.lit("unknown"))
            .when(sec < 60, F.concat(sec.cast("string"), F.lit("s")))
            .otherwise(F.concat(F.floor(sec / 60).cast("string"), F.lit("m "),
                                (sec % 60).cast("string"), F.lit("s"))))
