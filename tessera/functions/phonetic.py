"""Phonetic codes by an ordered list of rewriting rules, as one expression.

The rules become the alternatives of one pattern, each of which finds its sound in a list of sounds that stands behind
the word; what an alternative matches is replaced by what it found. Codes are made for distinct terms only and joined back.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T

MAX_LETTERS = 64
MAX_CODE = 12
QUERY_CODE = 8
V, NO_V = "[aeiouy]", "[b-df-hj-np-tv-xz]"
#: What stands before a piece, the piece, what stands behind it (``^`` and ``$``: begin and end of the word),
#: and what the piece sounds like; the first rule that matches at a place counts.
RULES = [
    ("^", "k", "n", ""),
    ("^", "g", "n", ""),
    ("^", "p", "n", ""),
    ("^", "a", "e", ""),
    ("^", "w", "r", ""),
    ("=", "[abd-z]", "", ""),
    ("^", V, "", "A"),
    ("", V, "", ""),
    ("m", "b", "$", ""),
    ("", "b", "", "B"),
    ("s", "ch", "", "K"),
    ("", "ch", "", "X"),
    ("", "c", "[eiy]", "S"),
    ("", "c", "", "K"),
    ("", "dg", "[eiy]", "J"),
    ("", "d", "", "T"),
    ("", "f", "", "F"),
    ("[ao]u", "gh", "", "F"),
    ("", "gh", "", ""),
    ("", "g", "ne?$", ""),
    ("", "g", "n[eiy]", "J"),
    ("", "g", "n", "K"),
    ("", "g", "[eiy]", "J"),
    ("", "g", "", "K"),
    ("^", "h", V, "H"),
    (NO_V, "h", V, "H"),
    ("", "h", "", ""),
    ("", "j", "", "J"),
    ("c", "k", "", ""),
    ("", "k", "", "K"),
    ("", "l", "", "L"),
    ("", "m", "", "M"),
    ("", "n", "", "N"),
    ("", "ph", "", "F"),
    ("", "p", "", "P"),
    ("", "q", "", "K"),
    ("", "r", "", "R"),
    ("", "sh", "", "X"),
    ("", "si[oa]", "", "X"),
    ("", "s", "", "S"),
    ("", "th", "", "0"),
    ("", "ti[oa]", "", "X"),
    ("", "t", "ch", ""),
    ("", "t", "", "T"),
    ("", "v", "", "F"),
    ("", "w", V, "W"),
    ("", "w", "", ""),
    ("", "x", "", "KS"),
    ("", "z", "", "S"),
]
#: Stands between a word and the sounds, which it has in the order of this string.
END, SOUNDS = "#", "".join(sorted({c for *_, sound in RULES for c in sound}))


def transducer() -> tuple[str, str]:
    """(pattern, replacement) of all rules: every group holds a sound or nothing. A doubled letter, the rule of ``=``, is
    one that a group before it holds."""
    parts, kept, n = [], [], 0
    for before, piece, behind, sound in RULES:
        if before == "=":
            n += 1
            parts.append(rf"(?<=({piece}))\{n}")
            continue
        look = {"": "", "^": "^"}.get(before, f"(?<={before})")
        ahead = f"(?={behind.replace('$', END)})" if behind else ""
        found = "".join(f"(?=[^{END}]*{END}[^{c}]*({c}))" for c in sound)
        kept += range(n + 1, n + 1 + len(sound))
        n += len(sound)
        parts.append(f"{look}{piece}{ahead}{found}")
    return "|".join(parts), "".join(f"${k}" for k in kept)


def code_column(term: Column, max_code: int = MAX_CODE) -> Column:
    """The code of a term's ASCII letters; null if there are none, or none that sounds."""
    pattern, found = transducer()
    word = T.ascii_lower(F.substring(F.regexp_replace(term, "[^A-Za-z]", ""), 1, MAX_LETTERS))
    word = F.regexp_replace(word, "^x", "s")
    told = F.substring_index(F.regexp_replace(F.concat(word, F.lit(END + SOUNDS)), pattern, found), END, 1)
    code = F.substring(F.regexp_replace(told, r"(.)\1+", "$1"), 1, min(max_code, MAX_CODE))
    return F.nullif(code, F.lit(""))


def rules_sql(word: str, at: str) -> tuple[str, str]:
    """(sound, length of the piece) at place ``at`` of a word, as CASE expressions for engines without look-around."""
    before, here = f"substr({word}, 1, {at} - 1)", f"substr({word}, {at})"
    sounds, sizes = [], []
    for look, piece, behind, sound in RULES:
        if look == "=":
            test = f"{at} > 1 AND substr({word}, {at}, 1) = substr({word}, {at} - 1, 1) AND regexp_matches({here}, '^{piece}')"
        else:
            test = f"regexp_matches({here}, '^{piece}{f'({behind})' if behind else ''}')"
            if look:
                test = f"{at} = 1 AND {test}" if look == "^" else f"regexp_matches({before}, '{look}$') AND {test}"
        sounds.append(f"WHEN {test} THEN '{sound}'")
        sizes.append(f"WHEN {test} THEN {len(re.sub(r'\[[^]]*\]', '_', piece))}")
    return f"CASE {' '.join(sounds)} ELSE '' END", f"CASE {' '.join(sizes)} ELSE 1 END"


def codes_of(words: DataFrame, term: str = "term", max_code: int = MAX_CODE) -> DataFrame:
    """(term, code) of distinct terms, dealt anew: they are few bytes, which would be put together in few tasks, and much work."""
    spark = words.sparkSession
    parts = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # not a plain column: that a code is there would be inferred, and every code made twice
    return words.select(term).repartition(parts).select(term, F.explode_outer(F.array(code_column(F.col(term), max_code))).alias("code"))


def with_codes(rows: DataFrame, term: str = "term", max_code: int = MAX_CODE) -> DataFrame:
    """``rows`` with ``code`` (null where a term has no letters), made once for each distinct term."""
    return rows.join(codes_of(rows.select(term).distinct(), term, max_code), term)


#: Stands before a code that is a term; no token has it.
MARK = "~"


def code_freqs(counted: DataFrame, keys: list[str], n: str) -> DataFrame:
    """(keys, term, n) of counted terms, told by their codes: a code counts all its terms; terms without letters have none."""
    coded = with_codes(counted).where("code is not null")
    return coded.groupBy(*keys, F.concat(F.lit(MARK), "code").alias("term")).agg(F.sum(n).alias(n))
