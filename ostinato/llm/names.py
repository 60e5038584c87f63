"""Freely typed names mapped to the entries of a reference list.

A name is folded (compatibility forms, letter case, accents, look-alike letters, digits typed for
letters), stripped of what marks a take (the patterns BEFORE and AFTER, both parameters), and split into tokens;
the name without any gaps is one more token. Each distinct token is joined to the vocabulary of the list (its
tokens, and its entries without gaps) by edit distance: pairs that share a pair of letters or the first letter
are compared, counting insertions, deletions, replacements and swaps of neighbours. Words of four letters and
more that are as close as CLOSE share a pair of letters, their ends counted, so that no such pair is lost; what
can't be as close by its length or by Levenshtein's distance (at most twice the one with swaps) is left out
before any Python. Abbreviations count as close to the words they begin or are drawn from. Corrected tokens are combined by soft TF-IDF: an
entry's score is the cosine of the name's and its own weights, each product scaled by closeness; the
closeness of the whole, gapless name counts if higher. The best entry is taken at LEAST or more, if it
leads the next by LEAD.

Null, blank and foreign names come out unmatched (null entry). Rows aren't merged: repeated rows and null
keys give a row each. An empty list leaves every name unmatched. If entries have the same name, the
smallest id stands for it. Extra columns are left out.
"""

from __future__ import annotations

import math
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ostinato.session import broadcast_if_small, checkpointed

LEAST = 0.7
LEAD = 0.04
CLOSE = 0.7
#: Entries up to which the vocabulary is broadcast; a longer list is joined by shuffles.
LIST_ROWS = 20_000
#: Look-alike letters of other alphabets, digits typed for letters.
LOOK_ALIKE = str.maketrans("аеёіїјкмнорстухѕԁαεικνορτυχ", "aeeiijkmhopctyxsdaeiknoptux")
DIGITS = str.maketrans("013457", "oieast")
#: What marks a take in front of a name and behind it, by default.
BEFORE = (r"^\s*(?:clip\s*\d+\s*[:.\-]|\[\s*\d+\s*\]|\d{1,3}\s*[._):\-]|#\s*\d+)\s*")
AFTER = (r"(?:[\s,_\-]*(?:\(\s*take\s*\d+\s*\)|\(\s*again\s*\)|-\s*ok|\bbis|\.wav|#\s*\d+|\bv\d+|-t\d+|_\d+|\s\d+|[!?;*])|(?<=[^\W\d])\d|(?<=\.)\d)\s*$")


def fold(name: str, before: str = BEFORE, after: str = AFTER) -> str:
    """name in plain small letters, without what marks a take."""
    s = unicodedata.normalize("NFD", unicodedata.normalize("NFKC", name).casefold())
    s = "".join(c for c in s if not unicodedata.combining(c)).translate(LOOK_ALIKE).strip()
    while True:
        t = re.sub(after, "", re.sub(before, "", s)).strip()
        if t == s:
            return s
        s = t


def tokens(name: str, before: str = BEFORE, after: str = AFTER) -> list[tuple[str, bool, bool]]:
    """(token, is it marked as an abbreviation, is it the whole name) of a name."""
    s = re.sub(r"[&+]", " and ", fold(name, before, after))
    out = []
    for m in re.finditer(r"[^\W_]+", s):
        word = m.group()
        if any(c.isalpha() for c in word):
            word = word.translate(DIGITS)
        out.append((word, s[m.end() : m.end() + 1] in (".", "/"), False))
    whole = "".join(t for t, _, _ in out)
    if whole and not whole.isdigit():
        out.append((whole, False, True))
    return out


def edits(a: str, b: str) -> int:
    """Edit distance with swaps of neighbours (each stretch edited once)."""
    before, last = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and y == a[i - 2]:
                d = min(d, before[j - 2] + 1)
            row.append(d)
        before, last = last, row
    return last[-1]


def _drawn_from(short: str, word: str) -> bool:
    left = iter(word)
    return short[:1] == word[:1] and all(c in left for c in short)


def closeness(token: str, word: str, marked: bool, whole: bool) -> float:
    """1 for the same word, less for each edit; 0.5 + 0.1 for each letter of an abbreviation, at most 0.95."""
    best = 1.0 - edits(token, word) / max(len(token), len(word))
    if not whole and len(token) < len(word):
        if word.startswith(token) and (marked or len(token) >= 3):
            best = max(best, min(0.95, 0.5 + 0.1 * len(token)))
        elif len(token) >= 3 and _drawn_from(token, word):
            best = max(best, min(0.9, 0.45 + 0.1 * len(token)))
    return best


def _tokens(c: Column, before: str, after: str) -> Column:
    def split(names: pd.Series) -> pd.Series:
        return names.map(lambda n: [{"token": t, "marked": m, "whole": w} for t, m, w in tokens(n, before, after)])

    return F.pandas_udf(split, "array<struct<token string, marked boolean, whole boolean>>")(c)


def _closeness(*cols: str) -> Column:
    def close(token: pd.Series, word: pd.Series, marked: pd.Series, whole: pd.Series) -> pd.Series:
        return pd.Series([closeness(*x) for x in zip(token, word, marked, whole, strict=True)], dtype="float64")

    return F.pandas_udf(close, "double")(*cols)


def _grams(c: str):
    """First letter and pairs of neighbouring letters, the ends of the word marked."""
    marked = F.concat(F.lit("^"), F.col(c), F.lit("$"))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) + 1), lambda i: F.substr(marked, i, F.lit(2))))


def _split(df: DataFrame, name: str, before: str, after: str) -> DataFrame:
    return df.withColumn("x", F.explode(_tokens(F.col(name), before, after))).select("*", "x.token", "x.marked", "x.whole").drop("x")


def _may_be_close(token: str = "token", word: str = "word", whole: str = "whole") -> Column:
    """Can the two be as close as CLOSE, or one abbreviate the other?"""
    a, b = F.length(token), F.length(word)
    most = F.floor((1 - CLOSE) * F.greatest(a, b) + 1e-9).cast("int")  # edits that leave them that close
    typed = (F.abs(a - b) <= most) & (F.levenshtein(token, word) <= 2 * most)
    short = ~F.col(whole) & (a < b) & (F.substr(token, F.lit(1), F.lit(1)) == F.substr(word, F.lit(1), F.lit(1)))
    return typed | short


def match_names(names: DataFrame, entries: DataFrame, before: str = BEFORE, after: str = AFTER) -> DataFrame:
    """Best entry of each distinct name (column name) among entries (entry_id, entry): name, entry_id, entry, score.

    The words of the list, the tokens of the names and the pairs that are close are written once each.
    """
    listed = entries.filter(F.trim("entry") != "").groupBy("entry").agg(F.min("entry_id").alias("entry_id"))
    word = _split(listed, "entry", before, after).select("entry_id", "entry", F.col("token").alias("word"), "whole").distinct()
    word = checkpointed(word)
    hint = F.broadcast if word.count() <= 8 * LIST_ROWS else lambda df: df
    n_entries = max(word.select("entry_id").distinct().count(), 1)
    top = math.log(n_entries) + 0.1
    single = word.filter("NOT whole")
    weight = single.groupBy("word").agg((F.log(F.lit(n_entries) / F.countDistinct("entry_id")) + 0.1).alias("idf"))
    # One row for each word of an entry, with its weight and the entry's norm.
    single = single.join(hint(weight), "word").withColumn("entry_norm", F.sqrt(F.sum(F.col("idf") * F.col("idf")).over(Window.partitionBy("entry_id"))))
    single = checkpointed(single.select("word", "entry_id", "idf", "entry_norm"))
    distinct = names.filter(F.col("name").isNotNull() & (F.trim("name") != "")).select("name").distinct()
    said = checkpointed(_split(distinct, "name", before, after).select("name", "token", "marked", "whole").distinct())
    # Distinct tokens against the vocabulary.
    vocabulary = word.select("word", "whole").distinct().withColumn("gram", F.explode(_grams("word")))
    asked = said.select("token", "marked", "whole").distinct().withColumn("gram", F.explode(_grams("token")))
    near = (
        asked.join(hint(vocabulary), ["gram", "whole"])
        .select("token", "marked", "whole", "word")
        .distinct()
        .filter(_may_be_close())
        .withColumn("close", _closeness("token", "word", "marked", "whole"))
        .filter((F.col("close") >= CLOSE) | (F.col("marked") & (F.col("close") >= 0.6)))
    )
    hits = checkpointed(said.join(near, ["token", "marked", "whole"], "left"))
    # Weights of the name's tokens: of the closest word, the highest of all for a token that is close to none.
    singles = hits.filter("NOT whole").join(hint(single), "word", "left")
    own = F.coalesce(F.max_by("idf", F.struct("close", "idf")), F.lit(top)).alias("own")
    words = F.array_distinct(F.array_compact(F.collect_list(F.when(F.col("word").isNotNull(), F.struct("word", "entry_id", "idf", "entry_norm", "close")))))
    said_as = singles.groupBy("name", "token").agg(own, words.alias("words"))
    norm = F.sqrt(F.sum(F.col("own") * F.col("own")).over(Window.partitionBy("name")))
    soft = (
        said_as.withColumn("norm", norm)
        .select("name", "token", "own", "norm", F.explode("words").alias("w"))
        .select("name", "token", "w.word", "w.entry_id", (F.col("own") * F.col("w.idf") * F.col("w.close") / (F.col("norm") * F.col("w.entry_norm"))).alias("p"))
        .groupBy("name", "entry_id", "word")
        .agg(F.max(F.struct("p", "token")).alias("m"))
        .groupBy("name", "entry_id", F.col("m.token").alias("token"))
        .agg(F.max("m.p").alias("p"))  # a token stands for one word of an entry
        .groupBy("name", "entry_id")
        .agg(F.sum("p").alias("score"))
    )
    gapless = (
        hits.filter("whole AND word IS NOT NULL")
        .join(hint(word.filter("whole").select("word", "entry_id")), "word")
        .select("name", "entry_id", F.col("close").alias("score"))
    )
    ranked = soft.unionByName(gapless).groupBy("name", "entry_id").agg(F.round(F.max("score"), 6).alias("score"))
    w = Window.partitionBy("name").orderBy(F.desc("score"), "entry_id")
    return (
        ranked.select("*", F.row_number().over(w).alias("place"), F.lead("score", 1, 0.0).over(w).alias("next"))
        .filter((F.col("place") == 1) & (F.col("score") >= LEAST) & (F.col("score") - F.col("next") >= LEAD))
        .join(hint(word.select("entry_id", "entry").distinct()), "entry_id")
        .select("name", "entry_id", "entry", "score")
    )


def map_names(rows: DataFrame, key: str, name: str, entries: DataFrame, entry_id: str, entry: str) -> DataFrame:
    """Every row with its entry: key, name, entry_id, entry, score; the last three are null where none is meant."""
    listed = entries.select(F.col(entry_id).alias("entry_id"), F.col(entry).alias("entry"))
    mapped = checkpointed(match_names(rows.select(F.col(name).alias("name")), listed))
    return (
        rows.select(F.col(key).alias("key"), F.col(name).alias("name"))
        .join(broadcast_if_small(mapped), "name", "left")
        .select(F.col("key").alias(key), F.col("name").alias(name), F.col("entry_id").alias(entry_id), F.col("entry").alias(entry), "score")
    )
