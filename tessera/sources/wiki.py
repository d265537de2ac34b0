"""Encyclopedia and dictionary dumps: TSV and XML pages (bz2 too), wikitext dictionary entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.lexicon import POS, RELATIONS

#: What a page is read as: text with or without attributes.
PAGE = "title STRING, ns BIGINT, revision STRUCT<text: STRUCT<_VALUE: STRING, `_xml:space`: STRING>>"


def read_tsv(spark: SparkSession, path: str, max_docs: int | None = None) -> DataFrame:
    """(title, text) of ``title<TAB>text`` lines; lines without a tab are skipped."""
    lines = spark.read.text(path).select(F.regexp_replace("value", r"\r$", "").alias("value")).where(F.col("value").contains("\t"))
    parts = F.split("value", "\t", 2)
    out = lines.select(parts[0].alias("title"), parts[1].alias("text"))
    return out if max_docs is None else out.limit(max_docs)


def read_xml(spark: SparkSession, path: str, max_docs: int | None = None) -> DataFrame:
    """(title, text) of the main namespace's pages; ``.bz2`` files are read as they are.

    A dump is read as records that end with a page's end tag, so a file of any size is dealt to many tasks: a task finds
    the first end tag after its own beginning, bz2 blocks too. Each record is one page, after what stands before it; the
    roots around pages are not looked at, so a file may have several.
    """
    records = spark.read.option("lineSep", "</page>").text(path)
    page = F.regexp_extract("value", r"(?s)<page[\s>].*$", 0)
    pages = records.select(page.alias("page")).where("page <> ''").select(F.from_xml(F.concat("page", F.lit("</page>")), PAGE, {"ignoreSurroundingSpaces": "false"}).alias("p")).select("p.*")
    out = pages.where("ns = 0 or ns is null").select("title", F.coalesce("revision.text._VALUE", F.lit("")).alias("text")).where("title is not null")
    return out if max_docs is None else out.limit(max_docs)


#: The named entities of XML.
NAMED = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}


def character(code: Column) -> Column:
    """The character of a number; what is none becomes U+FFFD."""
    good = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    return F.decode(F.unhex(F.lpad(F.hex(F.when(good, code).otherwise(F.lit(0xFFFD))), 8, "0")), "UTF-32")


def decoded(text: Column | str = "text") -> Column:
    """A text with its entities decoded, for texts that no XML reader has seen; unknown ones stay as they are."""

    def one(part: Column) -> Column:
        name = F.regexp_extract(part, "^(#[0-9]+|#[xX][0-9a-fA-F]+|[a-z]+);", 1)
        rest = F.substring(part, F.length(name) + 2, F.length(part))
        digits = lambda skip: F.regexp_replace(F.substring(name, F.lit(skip), F.length(name)), "^0+(?=.)", "")
        number = lambda d, base: F.when(F.length(d) <= 8, F.conv(d, base, 10).cast("bigint")).otherwise(F.lit(-1))
        sign = F.when(name.rlike("^#[xX]"), character(number(digits(3), 16))).when(name.startswith("#"), character(number(digits(2), 10)))
        for known, char in NAMED.items():
            sign = sign.when(name == known, F.lit(char))
        return F.coalesce(F.concat(sign, rest), F.concat(F.lit("&"), part))

    parts = F.split(F.col(text) if isinstance(text, str) else text, "&")
    return F.array_join(F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(one(p))), "")


def identified(pages: DataFrame) -> DataFrame:
    """Pages with doc_id from their title."""
    from tessera.functions.text import numeric_id

    return pages.withColumn("doc_id", numeric_id(F.concat(F.lit("doc:"), "title")))


#: Limits of a dictionary page.
PAGE_BYTES, MAX_SENSES, MAX_RELATED, MAX_IPA, MAX_ITEM = 128 * 1024, 16, 32, 8, 96
#: A heading has as many equals signs before as behind; four at most.
HEADING = r"^(={2,4})(?!=)(.*)\1[ \t]*$"
LABELS = r"^(?:\s*\{\{lb\|en\|.*?\}\})*"


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def gloss(line: Column) -> Column:
    """What a line of definition tells, without the labels before it; null for examples and other lines."""
    told = trimmed(F.regexp_replace(trimmed(F.regexp_extract(line, r"^\s*#+(?![#:])(.*)$", 1)), LABELS, ""))
    return F.when(told != "", told)


def fields(line: Column) -> Column:
    """The first three fields of each template of a line, trimmed; those of fewer are left out."""
    each = F.transform(F.regexp_extract_all(line, F.lit(r"\{\{(.*?)\}\}"), F.lit(1)), lambda t: F.transform(F.split(t, r"\|"), trimmed))
    return F.filter(each, lambda f: F.size(f) >= 3)


def targets(line: Column) -> Column:
    """The words that a line names: of links, then of templates."""
    links = F.transform(F.regexp_extract_all(line, F.lit(r"\[\[(.*?)\]\]"), F.lit(1)), lambda x: trimmed(F.substring_index(x, "|", 1)))
    named = F.filter(fields(line), lambda f: f[0].isin("l", "m") & (f[1] == "en"))
    return F.filter(F.concat(links, F.transform(named, lambda f: f[2])), lambda t: t != "")


def sounds(line: Column) -> Column:
    told = F.filter(fields(line), lambda f: (f[0] == "IPA") & (f[1] == "en") & (f[2] != "") & (F.octet_length(f[2]) <= MAX_ITEM))
    return F.transform(told, lambda f: f[2])


def sections(text: Column) -> Column:
    """Of a page: (part, mask, told): whether its English section was met and left (1, 2), its parts of speech, and the
    section's lines, each with what it is a line of. One fold over the lines of a page, which PAGE_BYTES bound."""
    bits = F.create_map(*[F.lit(x) for name, bit in POS.items() for x in (name.capitalize(), bit)])
    kinds = F.create_map(*[F.lit(x) for name in RELATIONS for x in (name.capitalize(), name)], F.lit("Pronunciation"), F.lit("ipa"))

    def step(acc: Column, line: Column) -> Column:
        level = F.length(line["marks"])
        part = F.when((level == 2) & (acc["part"] < 2), F.when(acc["part"] == 1, 2).when(line["head"] == "English", 1).otherwise(0)).otherwise(acc["part"])
        inside = acc["part"] == 1
        bit = F.when(inside & (level == 3), F.coalesce(F.try_element_at(bits, line["head"]), F.lit(0)))
        mask = acc["mask"].bitwiseOR(F.coalesce(bit, F.lit(0)))
        allowed = F.when(level == 2, False).otherwise(F.coalesce(bit > 0, acc["allowed"]))
        kind = F.when(level == 2, "").when(bit.isNotNull(), F.when(bit > 0, "body").otherwise(""))
        kind = kind.when(inside & (level == 4), F.when(acc["allowed"] | (acc["mask"] > 0), F.coalesce(F.try_element_at(kinds, line["head"]), F.lit("body"))).otherwise("")).otherwise(acc["kind"])
        tells = inside & (level == 0) & (acc["kind"] != "") & ((acc["kind"] != "body") | acc["allowed"])
        told = F.when(tells, F.concat(acc["told"], F.array(F.struct(acc["kind"].alias("kind"), line["line"].alias("line"))))).otherwise(acc["told"])
        return F.struct(part.alias("part"), allowed.alias("allowed"), mask.alias("mask"), kind.alias("kind"), told.alias("told"))

    def headed(raw: Column) -> Column:
        line = F.regexp_replace(raw, r"\r+$", "")
        head = trimmed(F.regexp_extract(line, HEADING, 2))
        return F.struct(F.when(head != "", F.regexp_extract(line, HEADING, 1)).otherwise("").alias("marks"), head.alias("head"), line.alias("line"))

    start = F.struct(F.lit(0).alias("part"), F.lit(False).alias("allowed"), F.lit(0).alias("mask"), F.lit("").alias("kind"), F.array().cast("array<struct<kind:string,line:string>>").alias("told"))
    return F.aggregate(F.transform(F.split(text, "\n"), headed), start, step)


def parse_dictionary(pages: DataFrame) -> DataFrame:
    """(title, pos_mask, glosses, relations, ipa) of (title, text) pages with an English section that tells anything.

    Pages of more than PAGE_BYTES are left out; lists end at MAX_SENSES glosses, MAX_RELATED words of a relation and
    MAX_IPA pronunciations. A page is parsed where it is read.
    """
    own = pages.where(F.octet_length("text") <= PAGE_BYTES).select("title", sections(F.col("text")).alias("s")).where("s.part > 0")
    lines = lambda kind: F.transform(F.filter("s.told", lambda t: t["kind"] == kind), lambda t: t["line"])
    glosses = F.slice(F.filter(F.transform(lines("body"), gloss), lambda g: g.isNotNull()), 1, MAX_SENSES)
    of = lambda kind: F.transform(F.slice(F.flatten(F.transform(lines(kind), targets)), 1, MAX_RELATED), lambda t: F.struct(F.lit(kind).alias("type"), t.alias("target")))
    ipa = F.slice(F.flatten(F.transform(lines("ipa"), sounds)), 1, MAX_IPA)
    out = own.select("title", F.col("s.mask").cast("bigint").alias("pos_mask"), glosses.alias("glosses"), F.concat(*[of(r) for r in RELATIONS]).alias("relations"), ipa.alias("ipa"))
    return out.where("pos_mask <> 0 or size(glosses) + size(relations) + size(ipa) > 0")
