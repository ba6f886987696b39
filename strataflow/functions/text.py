"""Tokenisers and full-text scoring as column expressions and DataFrame aggregations."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lineage import cut

#: Word boundaries inside identifiers: store terms, question terms, catalog terms.
STORE = r"(?<=[\p{Ll}\p{Nd}])(?=\p{Lu})"
QUESTION = r"(?<=[\p{Ll}\p{Nd}])(?=\p{Lu})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})"
CATALOG = r"(?<=\p{Ll})(?=\p{Lu})|(?<=[\p{L}\p{Nd}])(?=\p{Lu}\p{Ll})"
SEPARATORS = r"[^\p{L}\p{Nd}]+"


def identifier_tokens(text: Column, boundary: str = STORE, lower: bool = True) -> Column:
    spaced = F.regexp_replace(text, boundary, " ")
    return F.array_remove(F.split(F.lower(spaced) if lower else spaced, SEPARATORS), "")


@cache
def diacritics() -> tuple[str, str]:
    """Characters to fold and what they become, position by position; those beyond the second text's end go.

    By rule: a character that decomposes into an ASCII letter and combining marks becomes that letter, and the
    combining diacritical marks (U+0300 to U+036F) go.
    """
    parts = {chr(c): unicodedata.normalize("NFD", chr(c)) for c in range(0xC0, 0x2000)}
    folded = {c: d[0] for c, d in parts.items() if len(d) > 1 and d[0].isascii() and d[0].isalpha() and all(unicodedata.category(m) == "Mn" for m in d[1:])}
    marks = "".join(chr(c) for c in range(0x300, 0x370))
    return "".join(folded) + marks, "".join(folded.values())


def fold(text: Column) -> Column:
    """``text`` without diacritics."""
    return F.translate(text, *diacritics())


def folded(text: str) -> str:
    """The same, lower-cased, for a request's terms."""
    these, into = diacritics()
    return text.translate(str.maketrans(dict(zip(these, into)) | dict.fromkeys(these[len(into) :], ""))).lower()


#: What parts words of a search text: anything but letters, numbers, and private characters.
BETWEEN_WORDS = r"[^\p{L}\p{N}\p{Co}]+"


def plain_tokens(text: Column) -> Column:
    """Lower-cased runs of letters and numbers without diacritics, without camel-case splitting."""
    return F.array_remove(F.split(F.lower(fold(F.coalesce(text, F.lit("")))), BETWEEN_WORDS), "")


K1, B = 1.2, 0.75


def idf(documents: Column, having: Column) -> Column:
    """Inverse document frequency; one that would not be positive is 1e-6."""
    x = F.log((documents - having + 0.5) / (having + 0.5))
    return F.when(x > 0, x).otherwise(1e-6)


def saturated(f: Column, size: Column, average: Column, k1: float = K1, b: float = B) -> Column:
    """The part of a BM25 term that grows with its hits ``f`` and falls with the document's size."""
    return f * (k1 + 1) / (f + k1 * (1 - b + b * size / average))


def postings(docs: DataFrame, keys: list[str], fields: dict[str, Column]) -> DataFrame:
    """(keys, field, pos, token) of every token array in ``fields``."""
    arrays = F.array(*[F.struct(F.lit(n).alias("field"), c.alias("tokens")) for n, c in fields.items()])
    return docs.select(*keys, F.explode(arrays).alias("f")).select(*keys, F.col("f.field").alias("field"), F.posexplode("f.tokens").alias("pos", "token"))


def _once(rows: DataFrame, key: str) -> DataFrame:
    """The fields of struct column ``c``, computed once: an outer explode of one element stops the
    optimizer from copying their expressions into every later use."""
    return rows.select(key, F.explode_outer(F.array("c")).alias("c")).select(key, "c.*")


def bm25(docs: DataFrame, key: str, fields: dict[str, Column], weights: dict[str, float], groups: list[list[str]], phrases: list[str] = (), k1: float = K1, b: float = B) -> DataFrame:
    """(key, score) of documents that match any AND-group of prefix terms or any quoted phrase.

    The score is the sum over query phrases of IDF * f*(k1+1) / (f + k1*(1-b+b*D/avgdl)), where f is the
    weighted hits over the fields; an IDF that would not be positive is 1e-6. A group's terms count in a
    document only if the whole group matches it; their document frequencies ignore the group. All terms
    are counted in one pass over the documents with array functions, so no postings are shuffled.
    """
    prefixes = [(g, folded(t)) for g, terms in enumerate(groups) for t in terms]
    quoted = [[folded(w) for w in p.split() if w] for p in phrases]
    rows = _once(docs.select(key, F.struct(*[c.alias(f"_{n}") for n, c in fields.items()]).alias("c")), key)

    def weighted(count) -> Column:
        total = F.lit(0.0)
        for n in fields:
            total = total + F.lit(float(weights[n])) * count(F.col(f"_{n}"))
        return total

    def phrase_hits(words: list[str]):
        w = F.array(*[F.lit(x) for x in words])
        return lambda tokens: F.size(F.filter(F.sequence(F.lit(0), F.size(tokens)), lambda i: F.slice(tokens, i + 1, len(words)) == w)).cast("double")

    hits = [weighted(lambda tokens, t=t: F.size(F.filter(tokens, lambda x: x.startswith(t))).cast("double")).alias(f"h{i}") for i, (_, t) in enumerate(prefixes)]
    hits += [weighted(phrase_hits(w)).alias(f"h{len(prefixes) + i}") for i, w in enumerate(quoted)]
    size = F.lit(0)
    for n in fields:
        size = size + F.size(F.col(f"_{n}"))
    # the counts serve the totals and the scores; written once, they cost one pass over the texts
    counted = cut(rows.select(key, F.struct(size.cast("double").alias("D"), *hits).alias("c")).select(key, "c.*"))
    n_terms = len(hits)
    stats = counted.agg(F.count("*").cast("double").alias("N"), F.avg("D").alias("avgdl"), *[F.sum((F.col(f"h{i}") > 0).cast("double")).alias(f"n{i}") for i in range(n_terms)])
    joined = counted.crossJoin(F.broadcast(stats))  # one row of totals beside each document
    true = [F.lit(True)] * len(groups)
    for i, (g, _) in enumerate(prefixes):
        true[g] = true[g] & (F.col(f"h{i}") > 0)
    matched, score = F.lit(False), F.lit(0.0)
    for i in range(n_terms):
        applies = true[prefixes[i][0]] if i < len(prefixes) else F.col(f"h{i}") > 0
        matched = matched | applies
        f = F.when(applies, F.col(f"h{i}")).otherwise(0.0)
        score = score + idf(F.col("N"), F.col(f"n{i}")) * saturated(f, F.col("D"), F.col("avgdl"), k1, b)
    return joined.filter(matched).select(key, score.alias("score"))


def match_groups(text: str, groups: list[list[str]], phrases: list[str]) -> list[list[str]]:
    """The AND-groups of a request; without any group or phrase every term of the text is a group of its own."""
    if groups or phrases:
        return [g for g in groups if g]
    import re

    return [[t] for t in re.split(r"[^\w]|_", folded(text)) if t]


def matched_fields(terms: list[str], fields: dict[str, Column]) -> Column:
    """Names of the fields that hold any of the whole terms."""
    t = F.array(*[F.lit(x) for x in terms])
    return F.filter(F.array(*[F.when(F.arrays_overlap(c, t), F.lit(n)) for n, c in fields.items()]), lambda x: x.isNotNull())
