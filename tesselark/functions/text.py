"""Scalar functions on code, paths and HTTP operations, as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words without search meaning.
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "been", "being", "by", "can", "could", "did", "do", "does",
    "for", "from", "had", "has", "have", "how", "if", "in", "into", "is", "it", "its", "of", "on", "or",
    "that", "the", "their", "then", "there", "these", "this", "those", "to", "was", "were", "what", "when",
    "where", "which", "while", "who", "why", "will", "with", "would",
)

# Paths of tests, of tests in graphs (end-to-end ones too), and of entry points.
TEST_PATH = r"(^|/)(test|tests|__tests__|spec|specs|fixture|fixtures)(/|$)|\.(test|spec)\.[^.]+$"
GRAPH_TEST_PATH = r"(^|/)(__tests__|test|tests|e2e|fixtures?|specs?)(/|$)|\.(test|spec)\.[^.]+$"
ENTRY_PATH = r"(^|/)(index|main|app|server|cli|entry|worker)\.[^.]+$|(^|/)bin/"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def like_contains(column, needle: str) -> Column:
    """Case-insensitive contains in which the caller's % and _ stay wildcards."""
    return F.lower(_c(column)).like(f"%{needle.lower()}%")


def base_name(path) -> Column:
    return F.element_at(F.split(_c(path), "/"), -1)


def top_directory(path, levels: int = 1) -> Column:
    """The first directories of a path, or '.' for a file at the root."""
    parts = F.split(_c(path), "/")
    directories = F.slice(parts, 1, F.least(F.lit(levels), F.size(parts) - 1))
    return F.when(F.size(parts) < 2, F.lit(".")).otherwise(F.array_join(directories, "/"))


def normal_path(path) -> Column:
    """Forward slashes, without a leading ./ ."""
    return F.regexp_replace(F.regexp_replace(_c(path), r"\\", "/"), r"^(\./)+", "")


def is_test_path(path, in_graph: bool = False) -> Column:
    return F.lower(_c(path)).rlike(GRAPH_TEST_PATH if in_graph else TEST_PATH)


def is_entry_path(path) -> Column:
    return F.lower(_c(path)).rlike(ENTRY_PATH)


def normal_signature(text, most: int = 500) -> Column:
    return F.substring(F.trim(F.regexp_replace(_c(text), r"\s+", " ")), 1, most)


def split_identifier(text) -> Column:
    """Words of an identifier set apart: fooBar, HTTPServer and back slashes."""
    x = F.regexp_replace(_c(text), r"(\p{Ll}|\p{N})(\p{Lu})", "$1 $2")
    x = F.regexp_replace(x, r"(\p{Lu}+)(\p{Lu}\p{Ll})", "$1 $2")
    return F.lower(F.regexp_replace(x, r"\\", "/"))


def stem(word) -> Column:
    """A light suffix stemmer; the first rule that fits applies."""
    w = _c(word)
    n = F.length(w)
    cut = lambda k: w.substr(F.lit(1), n - k)
    return (
        F.when(n <= 3, w)
        .when(w.endswith("ies") & (n > 5), F.concat(cut(3), F.lit("y")))
        .when(w.endswith("ing") & (n > 6), cut(3))
        .when(w.endswith("ed") & (n > 5), cut(2))
        .when(w.endswith("es") & (n > 5), cut(2))
        .when(w.endswith("s") & ~w.endswith("ss") & (n > 4), cut(1))
        .otherwise(w)
    )


def stem_of(word: str) -> str:
    """The same stem of a word that is known beforehand."""
    n = len(word)
    if n <= 3:
        return word
    for end, least, cut, add in (("ies", 5, 3, "y"), ("ing", 6, 3, ""), ("ed", 5, 2, ""), ("es", 5, 2, "")):
        if word.endswith(end) and n > least:
            return word[:-cut] + add
    return word[:-1] if word.endswith("s") and not word.endswith("ss") and n > 4 else word


def code_tokens(text) -> Column:
    """Stemmed search tokens of code or prose; single characters and stop words are left out."""
    raw = F.regexp_extract_all(split_identifier(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
    return F.filter(F.transform(raw, stem), lambda t: (F.length(t) > 1) & ~t.isin(*STOP_WORDS))


def identifier(text) -> Column:
    """All letters and digits of an identifier, folded, without what separates its words."""
    return F.array_join(F.regexp_extract_all(split_identifier(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)), "")


def char_grams(word, size: int = 3) -> Column:
    """Distinct n-grams of a word between ^ and $."""
    return F.array_distinct(every_gram(word, size))


def every_gram(word, size: int = 3) -> Column:
    """All n-grams of a word between ^ and $, in order."""
    padded = F.concat(F.lit("^"), _c(word), F.lit("$"))
    places = F.sequence(F.lit(1), F.greatest(F.length(padded) - (size - 1), F.lit(1)))
    return F.transform(places, lambda i: padded.substr(i, F.lit(size)))


def dice(a, b) -> Column:
    """Dice coefficient of two arrays of distinct items."""
    total = F.size(_c(a)) + F.size(_c(b))
    return F.coalesce(F.try_divide(2.0 * F.size(F.array_intersect(_c(a), _c(b))), total), F.lit(0.0))


def normal_api_path(path) -> Column:
    """A route or URL path in canonical form: no origin or query, parameters as {}, single slashes."""
    x = F.trim(_c(path))
    for pattern, to in (
        (r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]*", ""),
        (r"^\$\{[^}]*\}", ""),
        (r"[?#].*$", ""),
        (r"\$\{[^}]*\}", "{}"),
        (r":[A-Za-z_][A-Za-z0-9_]*", "{}"),
        (r"\[[^\]/]*\]", "{}"),
        (r"\{[^}/]*\}", "{}"),
        (r"<[^>/]*>", "{}"),
        (r"/[0-9]+(/|$)", "/{}$1"),
        (r"/[0-9]+(/|$)", "/{}$1"),
        (r"/+", "/"),
        (r"([^/])\{\}$", "$1"),
        (r"(.)/$", "$1"),
    ):
        x = F.regexp_replace(x, pattern, to)
    return F.when(x == "", F.lit("/")).when(x.startswith("/"), x).otherwise(F.concat(F.lit("/"), x))


def normal_method(method) -> Column:
    return F.coalesce(F.nullif(F.upper(F.trim(_c(method))), F.lit("")), F.lit("ANY"))


def methods_agree(a, b) -> Column:
    return (_c(a) == _c(b)) | (_c(a) == "ANY") | (_c(b) == "ANY")


def service_slug(name) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(_c(name)), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def fnv1a(text) -> Column:
    """FNV-1a, 32 bits, over the characters' codes, as a non-negative long."""
    codes = F.transform(F.filter(F.split(_c(text), ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    return F.aggregate(codes, F.lit(2166136261).cast("long"), lambda h, c: (h.bitwiseXOR(c) * F.lit(16777619)).bitwiseAND(F.lit(4294967295)))


def dot(a, b) -> Column:
    """Dot product of two numeric arrays."""
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a, b) -> Column:
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b))), F.lit(0.0))


def blast_risk(symbols, files) -> Column:
    """Risk of a change from how many symbols and files it reaches."""
    s, f = _c(symbols), _c(files)
    return F.when((s >= 40) | (f >= 15), "critical").when((s >= 15) | (f >= 7), "high").when((s >= 5) | (f >= 3), "medium").otherwise("low")


def clamp(value, default: int, low: int, high: int) -> int:
    """A bound given by a caller: missing or zero means the default; then clamped."""
    try:
        n = int(value) if value is not None else 0
    except (TypeError, ValueError):
        n = 0
    return max(low, min(high, n or default))
