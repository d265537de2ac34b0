"""Scalar text functions as column expressions: tokens, normalisation, keys, morphology, punctuation."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Runs of letters, digits, underscore, hyphen and apostrophe.
TOKEN = r"[\p{L}\p{N}_'-]+"
#: The same characters, those looked up in a table named first: Java is twice as fast with it.
IN_TOKEN = r"[a-zA-Z0-9_'\-[\p{L}\p{N}]]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MAX_TOKEN = 64


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ascii_lower(text: Column | str) -> Column:
    """Lower-cases A-Z only; other letters keep their case."""
    return F.translate(col(text), UPPER, LOWER)


def tokens(text: Column | str) -> Column:
    return F.regexp_extract_all(col(text), F.lit(IN_TOKEN + "++"), F.lit(0))


def terms(text: Column | str, max_token: int = MAX_TOKEN) -> Column:
    """Normalised tokens, in order, repeats included; each cut to ``max_token`` characters."""
    return F.regexp_extract_all(ascii_lower(text), F.lit(f"({IN_TOKEN}{{1,{max_token}}}+){IN_TOKEN}*+"), F.lit(1))


def order_key(term: Column | str) -> Column:
    """Fixed-width key whose string order stands for the order of unsigned term ids."""
    return F.substring(F.sha2(col(term), 256), 1, 16)


def numeric_id(text: Column | str) -> Column:
    """A non-negative 60-bit id."""
    return F.conv(F.substring(F.sha2(col(text), 256), 1, 15), 16, 10).cast("bigint")


def xor_fold(x: Column | str) -> Column:
    """A 64-bit id folded to 32 bits."""
    x = col(x)
    return x.bitwiseXOR(F.shiftrightunsigned(x, 32)).bitwiseAND(F.lit(4294967295))


def q16_ratio(part: Column | str, whole: Column | str) -> Column:
    """part / whole in units of 1 / 65536, clamped to 0 .. 65536; 0 where whole is 0."""
    part, whole = col(part), col(whole)
    safe = F.when(whole == 0, F.lit(1)).otherwise(whole)
    return F.when(whole == 0, F.lit(0).cast("bigint")).otherwise(F.least(F.greatest(F.floor(part * 65536 / safe), F.lit(0)), F.lit(65536))).cast("bigint")


def clamp(x: Column, low: int, high: int) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def saturated_product(*factors: Column) -> Column:
    """Product of non-negative longs that stops at the largest long instead of failing."""
    out = factors[0].cast("bigint")
    for f in factors[1:]:
        out = F.coalesce(F.try_multiply(out, f.cast("bigint")), F.lit(2**63 - 1))
    return out


def utf8_prefix(text: Column | str, n: int) -> Column:
    """The longest beginning of whole characters that has at most n bytes in UTF-8."""
    if n < 0:
        raise ValueError("n must be 0 or more")
    t = col(text)
    data = F.encode(t, "UTF-8")
    first = lambda k: F.decode(F.substring(data, 1, max(k, 0)), "UTF-8")
    starts = lambda k: ~F.hex(F.substring(data, max(k, 0) + 1, 1)).between("80", "BF")
    return F.when(F.octet_length(data) <= n, t).when(starts(n), first(n)).when(starts(n - 1), first(n - 1)).when(starts(n - 2), first(n - 2)).otherwise(first(n - 3))


def utf8_starts(data: Column, n: int) -> Column:
    """Where the pieces of a binary text begin: each is the longest run of whole characters of at most n bytes."""
    if n < 4:
        raise ValueError("a piece must have room for any character")
    whole = lambda at: ~F.hex(F.substring(data, at + 1, F.lit(1))).between("80", "BF")
    size = F.octet_length(data)

    def more(starts: Column, _: Column) -> Column:
        at = F.element_at(starts, -1) + n
        cut = F.when(whole(at), at).when(whole(at - 1), at - 1).when(whole(at - 2), at - 2).otherwise(at - 3)
        return F.when(at >= size, starts).otherwise(F.concat(starts, F.array(cut)))

    one = F.array(F.lit(0))
    return F.when(size == 0, F.array().cast("array<int>")).when(size <= n, one).otherwise(F.aggregate(F.sequence(F.lit(1), F.floor(size / (n - 3)).cast("int") + 1), one, more))


def utf8_pieces(text: Column | str, n: int) -> Column:
    """A text in pieces of at most n bytes, none split within a character; an empty text has none."""

    def cut(data: Column) -> Column:
        def of(starts: Column) -> Column:
            end = lambda i: F.coalesce(F.get(starts, i + 1), F.octet_length(data))
            return F.transform(starts, lambda s, i: F.decode(F.substring(data, s + 1, end(i) - s), "UTF-8"))

        return _let(utf8_starts(data, n), of)

    t = col(text)
    return F.when(F.octet_length(t).between(1, n), F.array(t)).otherwise(_let(F.encode(t, "UTF-8"), cut))


#: The SplitMix64 step and its two multipliers.
MIX_STEP, MIX_BY = 0x9E3779B97F4A7C15, (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
_WORD = Decimal(1 << 64)


def _unsigned(x: Column) -> Column:
    return (x.cast("decimal(20,0)") + F.lit(_WORD)) % F.lit(_WORD)


def _signed(u: Column) -> Column:
    half = F.lit(Decimal(1 << 63))
    return ((u + half) % F.lit(_WORD) - half).cast("bigint")


def _let(x: Column, of) -> Column:
    """of(x), with x computed once however often ``of`` names it."""
    return F.transform(F.array(x), of)[0]


def _times(x: Column, by: int) -> Column:
    """The low 64 bits of a product, in two halves of exact decimals: the long product would overflow."""
    high, low = divmod(by, 1 << 32)
    half = Decimal(1 << 32)
    return _let(_unsigned(x), lambda u: _signed(u * F.lit(Decimal(high)) % F.lit(half) * F.lit(half) + u * F.lit(Decimal(low))))


def mix64(x: Column | str) -> Column:
    """SplitMix64 of a 64-bit id, as a signed long of the same bits."""
    shifted = lambda n: lambda z: z.bitwiseXOR(F.shiftrightunsigned(z, n))
    z = _let(_signed(_unsigned(col(x)) + F.lit(Decimal(MIX_STEP))), shifted(30))
    z = _let(_times(z, MIX_BY[0]), shifted(27))
    return _let(_times(z, MIX_BY[1]), shifted(31))


def counted(words: Column | str) -> Column:
    """Array of (term, tf) of an array of terms: each once, with how often it stands there."""

    def of(s: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        end = lambda begins, k: F.coalesce(F.get(begins, k + 1), F.size(s))
        runs = _let(starts, lambda begins: F.transform(begins, lambda i, k: F.struct(F.get(s, i).alias("term"), (end(begins, k) - i).cast("bigint").alias("tf"))))
        return F.when(F.size(s) > 0, runs)

    return _let(F.sort_array(words), of)


def count_of(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("bigint")


def punctuation(text: Column | str) -> dict[str, Column]:
    """Counts of marks: !, ?, "...", quotes, runs of two or more equal ! or ?, and whether all is ASCII."""
    t = col(text)
    return {
        "exclamations": count_of(t, "!"),
        "questions": count_of(t, r"\?"),
        "ellipses": count_of(t, r"\.\.\."),
        "quotes": count_of(t, "[\"']"),
        "repeat_punct_runs": count_of(t, "!{2,}") + count_of(t, r"\?{2,}"),
        "ascii_only": (F.octet_length(t) == F.length(t)).cast("bigint"),
    }


#: Words that make a message mathematical or code.
MATH_WORDS = ["sqrt", "sin", "cos", "tan", "log", "ln"]
CODE_WORDS = ["fn", "pub", "use", "let", "const", "class", "def", "import", "return", "println", "panic", "stacktrace", "exception"]


def has_word(words: Column, some: list[str]) -> Column:
    return F.arrays_overlap(words, F.array(*map(F.lit, some)))


def has_math(text: Column | str, words: Column) -> Column:
    t = col(text)
    return (t.rlike("[0-9]") & t.rlike(r"[-+*/=^]")) | has_word(words, MATH_WORDS)


def has_code(text: Column | str, words: Column) -> Column:
    t = col(text)
    return t.contains("```") | (t.rlike("[{}]") & t.contains(";")) | has_word(words, CODE_WORDS)


#: Fixed values: (rule, ending, what replaces it, least length of what is left before it).
BRIDGE_RULES = [(1, "ies", "y", 1), (2, "es", "", 1), (3, "s", "", 1), (4, "ing", "", 2), (5, "ing", "e", 2), (6, "ed", "", 2)]
UNDOUBLE_RULE = 7
STANDALONE_RULES = [(1, "ies", "y", 1), (2, "es", "", 2), (3, "s", "", 3), (4, "ing", "", 3), (5, "ing", "e", 3), (6, "ed", "", 3), (7, "ed", "e", 3)]


def morphology(term: Column | str, rules: list[tuple[int, str, str, int]] = BRIDGE_RULES, undouble: bool = True) -> Column:
    """Array of (rule, variant) of a lower-case term of three characters or more."""
    t = col(term)
    n = F.length(t)
    none = F.lit(None).cast("struct<rule:int,variant:string>")
    out = []
    for rule, ending, instead, least in rules:
        stem = F.substring(t, F.lit(1), n - len(ending))
        one = F.struct(F.lit(rule).alias("rule"), F.concat(stem, F.lit(instead)).alias("variant"))
        out.append(F.when(t.endswith(ending) & (n - len(ending) >= least), one).otherwise(none))
    if undouble:
        stem = F.substring(t, F.lit(1), n - 2)
        twice = F.substring(t, n - 2, F.lit(1)) == F.substring(t, n - 3, F.lit(1))
        one = F.struct(F.lit(UNDOUBLE_RULE).alias("rule"), F.substring(t, F.lit(1), n - 3).alias("variant"))
        out.append(F.when(t.endswith("ed") & (n >= 4) & twice, one).otherwise(none))
    return F.when(n >= 3, F.filter(F.array(*out), lambda v: v.isNotNull())).otherwise(F.array().cast("array<struct<rule:int,variant:string>>"))
