"""Large dumps read by many tasks, and dictionary pages parsed where they are read."""

import bz2
import random

import pytest
from tessera.operators import lexicon
from tessera.sources import wiki


def pages_of(n, rng):
    return [(f"Page {i}", i % 7 == 0, " ".join("w%d" % rng.randrange(10**6) for _ in range(rng.randrange(1, 400)))) for i in range(n)]


@pytest.mark.parametrize("packed", [False, True])
def test_one_file_is_read_by_many_tasks(spark, tmp_path, packed):
    rng = random.Random(1)
    pages = pages_of(1500, rng)
    body = "<mediawiki>\n<siteinfo/>\n" + "".join(f"  <page>\n    <title>{t}</title>\n    <ns>{int(talk)}</ns>\n    <revision><id>3</id><text bytes=\"9\" xml:space=\"preserve\">{x} &lt;ref&gt;\n</text></revision>\n  </page>\n" for t, talk, x in pages) + "</mediawiki>\n<mediawiki><page><title>Empty</title><ns>0</ns><revision><text/></revision></page></mediawiki>"
    file = tmp_path / ("dump.xml.bz2" if packed else "dump.xml")
    file.write_bytes(bz2.compress(body.encode(), 1) if packed else body.encode())
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 150_000)
    try:
        got = wiki.read_xml(spark, str(file))
        assert got.rdd.getNumPartitions() > 3
        rows = got.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted(map(tuple, rows)) == sorted([(t, x + " <ref>\n") for t, talk, x in pages if not talk] + [("Empty", "")])
    assert wiki.read_xml(spark, str(file), max_docs=5).count() == 5


def parsed(spark, text):
    rows = wiki.parse_dictionary(spark.createDataFrame([("x", text)], "title string, text string")).collect()
    return rows[0].asDict(recursive=True) if rows else None


ENGLISH = "==English==\n===Noun===\n"


@pytest.mark.parametrize(
    ("line", "want"),
    [
        ("# A test sense", ["A test sense"]),
        ("# {{lb|en|slang}}{{lb|en|foo}}   A test", ["A test"]),
        ("# A {{lb|en|slang}} test", ["A {{lb|en|slang}} test"]),
        ("# {{lb|en|slang} A test", ["{{lb|en|slang} A test"]),
        ("## deeper", ["deeper"]),
        ("#: example", []),
        ("##: example", []),
        ("  # led by space \r", ["led by space"]),
        ("#", []),
        ("plain text", []),
    ],
)
def test_glosses(spark, line, want):
    got = parsed(spark, ENGLISH + line)
    assert got["glosses"] == want and got["pos_mask"] == 1


def test_relations_and_sounds(spark):
    text = ENGLISH + "====Synonyms====\n* [[a|shown]], {{l|en|b}}, {{m|en| c |t}}, {{l|fr|no}}, [[ ]], [[d|x|y]]\n====Derived terms====\n" + "".join(f"* [[t{k}]]\n" for k in range(40)) + "====Pronunciation====\n* {{IPA|en|/x/|/y/}} {{IPA|fr|/z/}}\n* {{IPA|en|" + "é" * 49 + "}}\n" + "* {{IPA|en|/q/}}\n" * 9
    got = parsed(spark, text)
    assert [r["target"] for r in got["relations"] if r["type"] == "synonyms"] == ["a", "d", "b", "c"]
    assert [r["target"] for r in got["relations"] if r["type"] == "derived terms"] == [f"t{k}" for k in range(32)]
    assert got["ipa"] == ["/x/"] + ["/q/"] * 7


def test_sections(spark):
    assert parsed(spark, "==French==\n===Noun===\n# test") is None
    assert parsed(spark, "no heading at all") is None and parsed(spark, "==English==\nnothing") is None
    assert parsed(spark, ENGLISH + "# x" + "y" * wiki.PAGE_BYTES) is None
    got = parsed(spark, "==Latin==\n===Verb===\n# no\n==English==\n===Etymology===\n# no\n====Synonyms====\n* [[no]]\n===Verb===\n# one\n====Usage notes====\n# two\n===Proper noun===\n# three\n====Odd=====\n===Anagrams===\n# no\n====Antonyms====\n* [[yes]]\n==German==\n===Noun===\n# no\n==English==\n===Adverb===\n# no")
    assert got["pos_mask"] == lexicon.POS["verb"] | lexicon.POS["proper noun"] and got["glosses"] == ["one", "two", "three"]
    assert got["relations"] == [{"type": "antonyms", "target": "yes"}]
    many = parsed(spark, ENGLISH + "# g\n" * 30)
    assert len(many["glosses"]) == wiki.MAX_SENSES


def test_no_python_in_the_plan(spark):
    pages = spark.createDataFrame([("x", ENGLISH)], "title string, text string")
    plan = wiki.parse_dictionary(pages)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Exchange" not in plan
