"""Scalar building blocks; all stay inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str


def _c(x: ColumnLike) -> Column:
    return F.col(x) if isinstance(x, str) else x


def stable_id(text: ColumnLike) -> Column:
    """First 16 hex digits of the SHA-256 of the text."""
    return F.substring(F.sha2(_c(text), 256), 1, 16)


def text_or_none(value: ColumnLike) -> Column:
    """A null is written as the word None, as the data model's text templates do."""
    return F.coalesce(_c(value).cast("string"), F.lit("None"))


def hash_number(key: ColumnLike, seed: str) -> Column:
    """A seeded 32-bit number of the key; the same in any engine that has SHA-256."""
    digest = F.sha2(F.concat(_c(key), F.lit(":" + seed)), 256)
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def pick(key: ColumnLike, seed: str, choices: list[Column]) -> Column:
    """One of the choices, by the key's seeded hash."""
    return F.element_at(F.array(*choices), (hash_number(key, seed) % len(choices) + 1).cast("int"))


def shuffle_order(key: ColumnLike, seed: str) -> list[Column]:
    """Sort keys for a seeded, repeatable shuffle; ties fall to the key."""
    return [F.sha2(F.concat(F.lit(seed + ":"), _c(key)), 256), _c(key)]


# The characters that Unicode calls white space.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(text: ColumnLike) -> Column:
    """Without white space at either end, Unicode spaces included."""
    return F.btrim(_c(text), F.lit(SPACES))


def word_count(text: ColumnLike) -> Column:
    """Words between white space, Unicode spaces included."""
    return F.coalesce(F.regexp_count(_c(text), F.lit(r"(?U)\S+")), F.lit(0)).cast("bigint")


def token_estimate(text: ColumnLike) -> Column:
    """1.3 tokens a word, as a double."""
    return word_count(text) * F.lit(1.3)


def line_count(content: ColumnLike) -> Column:
    """Line feeds in the bytes plus one; the empty file has one line."""
    raw = F.decode(_c(content), "ISO-8859-1")
    return (F.length(raw) - F.length(F.replace(raw, F.lit("\n"), F.lit(""))) + 1).cast("bigint")


# Suffix of a file name to language; headers count as C++.
EXTENSION_LANGUAGE = {
    ".py": "python", ".java": "java", ".ts": "typescript", ".tsx": "typescript", ".js": "javascript",
    ".jsx": "javascript", ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".hpp": "cpp", ".h": "cpp", ".c": "c",
    ".rs": "rust", ".go": "go",
}


def suffix_of(path: ColumnLike) -> Column:
    return F.lower(F.regexp_extract(_c(path), r"(\.[^./]+)$", 1))


def language_of(path: ColumnLike) -> Column:
    """Language by lower-cased suffix, null where unknown."""
    pairs = [F.lit(x) for kv in EXTENSION_LANGUAGE.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), suffix_of(path))


def excluded(path: ColumnLike, patterns: list[str]) -> Column:
    """Whether a path has any pattern, stars and outer slashes dropped, as a substring."""
    cores = [core for p in patterns if (core := p.replace("**/", "").replace("/**", ""))]
    return reduce(lambda a, b: a | b, (F.contains(_c(path), F.lit(core)) for core in cores), F.lit(False))


def dot(a: ColumnLike, b: ColumnLike) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: ColumnLike, b: ColumnLike) -> Column:
    """Cosine of two vectors; null for a zero vector."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
