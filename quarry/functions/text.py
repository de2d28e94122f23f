"""The text normal form and what is derived from it, as Column functions."""

from __future__ import annotations

import re
from itertools import combinations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Longest prefix and longest fuzzy term, in characters.
MAX_PREFIX, MAX_FUZZY = 32, 32
_SPLIT = r"[^\p{IsAlphabetic}\p{N}]+"


def normalize(x: Column) -> Column:
    """Unicode white space trimmed, lower case."""
    return F.lower(F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))


def tokens(x: Column) -> Column:
    """Runs of letters and digits of the lower-cased text, in order; null gives an empty array."""
    return F.filter(F.split(F.lower(F.coalesce(x, F.lit(""))), _SPLIT), lambda t: t != "")


def prefixes(t: Column) -> Column:
    """Every prefix of a token, up to MAX_PREFIX characters."""
    return F.when(F.length(t) >= 1, F.transform(F.sequence(F.lit(1), F.least(F.lit(MAX_PREFIX), F.length(t))), lambda i: F.left(t, i))).otherwise(F.array().cast("array<string>"))


def grams(x: Column, n: int = 3) -> Column:
    """Distinct n-grams of the whole text, spaces and punctuation included."""
    return F.when(F.length(x) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(x) - (n - 1)), lambda i: F.substring(x, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def extension(path: Column) -> Column:
    """What follows the last dot of the last component; null without a dot that leads no name."""
    base = F.element_at(F.split(path, "/"), -1)
    return F.when(base.rlike(r"^.+\.[^.]*$"), F.regexp_extract(base, r"^.+\.([^.]*)$", 1))


def basename(path: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(path, "/+$", ""), "/"), -1)


def components(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda c: c != "")


def ancestors(path: Column) -> Column:
    """All proper ancestors of an absolute path, the root left out."""
    parts = components(path)
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i), "/")))).otherwise(F.array().cast("array<string>"))


def renamed(path: Column, old: Column, new: Column) -> Column:
    """The path with the prefix old (itself or an ancestor) replaced by new; others as they are."""
    return F.when(path == old, new).when(F.startswith(path, F.concat(old, F.lit("/"))), F.concat(new, F.substring(path, F.length(old) + 1, F.length(path)))).otherwise(path)


def keep_both_name(name: Column, n: Column) -> Column:
    """'stem copy n.ext', without the number for the first copy."""
    ext = extension(name)
    stem = F.when(ext.isNull(), name).otherwise(F.left(name, F.length(name) - F.length(ext) - 1))
    return F.concat(stem, F.lit(" copy"), F.when(n > 1, F.concat(F.lit(" "), n.cast("string"))).otherwise(""), F.when(ext.isNull(), "").otherwise(F.concat(F.lit("."), ext)))


def is_fuzzy_term(t: Column) -> Column:
    """2 to 32 characters, a letter, and no run of five digits."""
    return F.length(t).between(2, MAX_FUZZY) & t.rlike(r"\p{IsAlphabetic}") & ~t.rlike(r"\p{N}{5}")


def fuzzy_match(t: Column, q: str) -> Column:
    """Edit distance of at most 2 from the query term, for terms that are fuzzy."""
    return is_fuzzy_term(t) & (F.levenshtein(t, F.lit(q), 2) >= 0)


def count_term(x: Column, t: str) -> Column:
    """Non-overlapping occurrences, 8 at most."""
    if not t:
        return F.lit(0).cast("long")
    found = F.floor((F.length(x) - F.length(F.replace(x, F.lit(t), F.lit("")))) / F.lit(len(t)))
    return F.least(F.coalesce(found, F.lit(0)), F.lit(8)).cast("long")


def escape_field(x: Column) -> Column:
    """A field of a tab-separated report: backslash, tab, newline and return are escaped."""
    for raw, shown in (("\\", "\\\\"), ("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r")):
        x = F.replace(x, F.lit(raw), F.lit(shown))
    return x


def python_tokens(text: str) -> list[str]:
    """tokens() for the driver's query parser."""
    out, word = [], []
    for c in text.lower():
        if c.isalnum():
            word.append(c)
        elif word:
            out.append("".join(word))
            word = []
    return [*out, "".join(word)] if word else out


def deletions(term: str, most: int = 2) -> list[str]:
    """The term and what is left of it after up to two deletions, without the empty string; none for terms that aren't fuzzy."""
    if not 2 <= len(term) <= MAX_FUZZY or not any(c.isalpha() for c in term) or re.search(r"\d{5}", term):
        return []
    keys = {"".join(c for k, c in enumerate(term) if k not in gone) for n in range(most + 1) for gone in combinations(range(len(term)), n)}
    return sorted(keys - {""})


@F.pandas_udf(T.ArrayType(T.StringType()))
def deletion_keys(terms: pd.Series) -> pd.Series:
    return terms.map(lambda t: deletions(t) if t else [])


_SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
_SNIPPET = T.StructType([T.StructField("text", T.StringType()), T.StructField("highlights", T.ArrayType(_SPAN))])


@F.pandas_udf(_SNIPPET)
def snippet(frame: pd.DataFrame) -> pd.DataFrame:
    """Of columns text, needles (array) and context: the first place of the longest needle found, in bytes of UTF-8."""
    rows = [_snippet(t, list(n) if n is not None else [], int(c)) for t, n, c in frame.itertuples(index=False)]
    return pd.DataFrame(rows, columns=["text", "highlights"])


def _snippet(text: str | None, needles: list[str], context: int):
    raw = (text or "").encode()
    low = (text or "").lower().encode()
    for needle in sorted(needles, key=lambda n: -len(n.encode())):
        at = low.find(needle.lower().encode()) if needle else -1
        if at >= 0:
            a, b = max(0, at - context), min(len(raw), at + len(needle.encode()) + context)
            while a > 0 and raw[a] & 0xC0 == 0x80:
                a -= 1
            while b < len(raw) and raw[b] & 0xC0 == 0x80:
                b += 1
            return raw[a:b].decode("utf-8", "ignore"), [{"start": at - a, "end": at - a + len(needle.encode())}]
    return None, []
