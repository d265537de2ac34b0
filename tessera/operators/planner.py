"""Answer planning: hints, follow-ups, forecasts and plans as scored rows from rule tables, and rendering.

Input rows have id, n_items (evidence), n_segments, and the columns of ``pragmatics.features``. A rule
is a condition with the rows it yields; the best score of an id and key wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import wording
from tessera.operators.pragmatics import flag

MAX_ITEMS, STRENGTH = 64, 500
MAX_INTENTS, MAX_QUESTIONS = 32, 16


def switches(rows: DataFrame) -> DataFrame:
    """``rows`` with clarify, steps, direct, caveats and compare_hint."""
    n = F.col("n_items")
    any_of = lambda *names: F.greatest(*[flag(x).cast("int") for x in names], F.lit(0)) == 1
    return rows.withColumns({
        "clarify": (n == 0) | (flag("question") & (flag("follow_up") | (n < 2))),
        "steps": any_of("constraints", "code", "math", "problem_solve", "logic_puzzle", "explain", "focus_steps"),
        "direct": (flag("question") & (n <= 8)) | any_of("recommend", "summarize", "focus_summary"),
        "caveats": flag("safety") | (n == 0),
        "compare_hint": (F.col("n_segments") >= 2) | flag("compare"),
    })


#: A rule: condition -> (key, score). The conditions use the columns of ``switches``.
Rules = list[tuple[Column, str, int]]


#: Rule keys and scores, here and in the rules below.
def hint_rules() -> Rules:
    n, clarify = F.col("n_items"), F.col("clarify")
    return [
        (clarify, "Clarify", 100),
        (~clarify, "AssumeAndAnswer", 50),
        (F.col("steps"), "Steps", 40),
        (n >= 3, "SummaryFirst", 30),
        (flag("summarize") & (n >= 1), "SummaryFirst", 70),
        (F.col("n_segments") >= 2, "Compare", 25),
        (flag("compare"), "Compare", 65),
    ]


def follow_up_rules() -> Rules:
    to_steps, to_example, to_summary = flag("focus_steps"), flag("focus_example"), flag("focus_summary")
    s, e, p, z = flag("summarize"), flag("explain"), flag("problem_solve"), flag("logic_puzzle")
    return [
        (F.col("clarify"), "100", 100), (flag("constraints"), "101", 70), (flag("request"), "103", 60), (flag("recommend"), "110", 72), (flag("compare") & flag("compare_targets"), "113", 74),
        (s & to_steps, "114", 72), (s & ~to_steps & to_example, "111", 70), (s & ~to_steps & ~to_example, "111", 68),
        (e & to_summary, "115", 74), (e & ~to_summary & to_example, "112", 72), (e & ~to_summary & ~to_example, "112", 70),
        (p, "104", 75), (p, "105", 70), (p, "106", 65), (p, "107", 60), (z, "108", 80), (z, "109", 75), (F.lit(True), "102", 40),
    ]


def intent_rules() -> Rules:
    p = flag("problem_solve")
    return [
        (F.col("clarify"), "Clarify", 100), (flag("logic_puzzle"), "Clarify", 60), (F.lit(True), "Example", 80), (F.lit(True), "MoreDetail", 60), (flag("compare"), "Compare", 80), (F.col("compare_hint"), "Compare", 55),
        (flag("recommend"), "NextSteps", 72), (flag("request"), "NextSteps", 50), (flag("summarize"), "MoreDetail", 68), (flag("explain"), "MoreDetail", 72), (p, "MoreDetail", 50), (p, "Verify", 55), (flag("code"), "Verify", 40),
        (flag("code"), "Implementation", 45), (F.col("steps"), "Implementation", 35), (flag("safety"), "Risks", 70), (F.col("caveats"), "Risks", 65),
    ]


def question_rules() -> Rules:
    c, p, z = F.col("clarify"), flag("problem_solve"), flag("logic_puzzle")
    s, e = flag("summarize"), flag("explain")
    special = flag("compare") | flag("recommend") | s | e
    plain = c & ~z & ~p
    return [
        (F.lit(True), "200", 50), (c & z, "208", 95), (c & z, "209", 90),
        (c & ~z & p, "204", 95), (c & ~z & p, "205", 90), (c & ~z & p, "206", 85), (c & ~z & p, "207", 80), (c & ~z & p, "201", 70),
        (plain & special, "201", 78), (plain & ~special, "201", 90), (c & flag("recommend"), "210", 88),
        (c & s & flag("focus_steps"), "214", 88), (c & s & ~flag("focus_steps") & flag("focus_example"), "215", 86), (c & s & ~flag("focus_steps") & ~flag("focus_example"), "211", 84),
        (c & e & flag("focus_summary"), "216", 90), (c & e & ~flag("focus_summary") & flag("focus_example"), "217", 88), (c & e & ~flag("focus_summary") & ~flag("focus_example"), "212", 86), (F.lit(True), "202", 60),
        (F.col("compare_hint") & flag("compare") & flag("compare_targets"), "213", 94), (F.col("compare_hint") & flag("compare") & ~flag("compare_targets"), "203", 92), (F.col("compare_hint") & ~flag("compare"), "203", 55),
    ]


def fired(rows: DataFrame, rules: Rules, most: int | None = None) -> DataFrame:
    """(id, key, score, place): each key once with its best score, best first, at most ``most``."""
    one = [F.when(condition, F.struct(F.lit(score).cast("bigint").alias("score"), F.lit(key).alias("key"))) for condition, key, score in rules]
    each = rows.select("id", F.explode(F.filter(F.array(*one), lambda x: x.isNotNull())).alias("x"))
    best = each.groupBy("id", F.col("x.key").alias("key")).agg(F.max("x.score").alias("score"))
    out = best.withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy(F.col("score").desc(), "key")).cast("bigint"))
    return out if most is None else out.where(F.col("place") <= most)


def hints(rows: DataFrame) -> DataFrame:
    return fired(switches(rows), hint_rules())


def follow_ups(rows: DataFrame) -> DataFrame:
    return fired(switches(rows), follow_up_rules())


def forecast_intents(rows: DataFrame) -> DataFrame:
    return fired(switches(rows), intent_rules(), MAX_INTENTS)


def forecast_questions(rows: DataFrame) -> DataFrame:
    return fired(switches(rows), question_rules(), MAX_QUESTIONS)


def basic_plan(items: DataFrame) -> DataFrame:
    """(id, item_ix, kind, ref, strength): a bullet for each of the first items (id, item_ix)."""
    return items.where(F.col("item_ix") < MAX_ITEMS).select("id", F.col("item_ix").cast("bigint").alias("item_ix"), F.lit("bullet").alias("kind"), F.col("item_ix").cast("bigint").alias("ref"), F.lit(STRENGTH).cast("bigint").alias("strength"))


def guided_plan(rows: DataFrame) -> DataFrame:
    """(id, item_ix, kind, ref): to clarify, a summary and, for procedures, a step an item; else a summary
    if it comes first, a step or bullet an item, and a caveat if there is cause and room."""
    s = switches(rows)
    n = F.least(F.col("n_items"), F.lit(MAX_ITEMS)).cast("int")
    part = lambda kind, ref: F.struct(F.lit(kind).alias("kind"), ref.cast("bigint").alias("ref"))
    empty = F.array().cast("array<struct<kind:string,ref:bigint>>")
    each = lambda kind: F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: part(kind, i))).otherwise(empty)
    summary = F.array(part("summary", F.lit(0)))
    first = (F.col("n_items") >= 3) | (flag("summarize") & (F.col("n_items") >= 1))
    clear = F.concat(F.when(first, summary).otherwise(empty), F.when(F.col("steps"), each("step")).otherwise(each("bullet")))
    clear = F.slice(clear, 1, MAX_ITEMS)
    clear = F.when(F.col("caveats") & (F.size(clear) < MAX_ITEMS), F.concat(clear, F.array(part("caveat", F.lit(0))))).otherwise(clear)
    asking = F.slice(F.concat(summary, F.when(F.col("steps"), each("step")).otherwise(empty)), 1, MAX_ITEMS)
    return s.select("id", F.posexplode(F.when(F.col("clarify"), asking).otherwise(clear)).alias("item_ix", "x")).select("id", F.col("item_ix").cast("bigint").alias("item_ix"), "x.kind", "x.ref")


def clarifying_question(rows: DataFrame) -> DataFrame:
    """(id, question): one short question where clarifying is called for and questions are allowed."""
    c = switches(rows)
    asked = F.when(flag("logic_puzzle"), "Which values may each variable take?").when(flag("problem_solve"), "What did you expect, and what happened instead?").when(flag("compare") & ~flag("compare_targets"), "Which two things should be compared?").otherwise("Could you say a little more about what you need?")
    return c.where(F.col("clarify") & (F.col("max_questions") > 0)).select("id", F.substring(asked, 1, 256).alias("question"))


#: Sections in reading order, with their headings.
SECTIONS = {"summary": "In short", "step": "Steps", "bullet": "Details", "caveat": "Please note"}


def rendered(plan: DataFrame, texts: DataFrame, directives: DataFrame, questions: DataFrame | None = None, chosen: DataFrame | None = None) -> DataFrame:
    """(id, answer): plan items as text by section; texts is (id, ref, text), directives has tone, style
    and format_flags. ``chosen`` (id, site, choice) picks the phrases that are used (``wording.choices``); what is said
    stays the same."""
    kinds = F.create_map(*[F.lit(x) for k, v in SECTIONS.items() for x in (k, v)])
    order = F.array(*map(F.lit, SECTIONS))
    words = wording.phrased(directives.select("id", "tone", "style", "format_flags", "max_preface"), chosen)
    rows = plan.join(texts, ["id", "ref"], "left").join(words.select("id", "tone", "style", "format_flags", "transition", "closer"), "id")
    on = lambda bit: F.col("format_flags").bitwiseAND(F.lit(1 << bit)) != 0
    debug = F.col("style") == "Debug"
    shown = F.when(F.col("kind") == "summary", on(2) | F.col("style").isin("Default", "Debug")).when(F.col("kind") == "step", on(3) | F.col("style").isin("Checklist", "StepByStep", "Debug")).when(F.col("kind") == "bullet", on(5) | F.col("style").isin("Default", "Debug")).otherwise(on(4) | (F.col("tone") == "Cautious") | debug)
    rows = rows.where(shown).withColumn("section", F.array_position(order, F.col("kind")))
    number = F.row_number().over(Window.partitionBy("id", "section").orderBy("item_ix")).cast("string")
    lead = F.when(on(1), F.concat(number, F.lit(". "))).otherwise(F.lit("- "))
    rows = rows.withColumn("line", F.concat(lead, F.coalesce("text", F.lit("(no text)"))))
    body = rows.groupBy("id", "section", "kind").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("item_ix", "line"))), lambda x: x["line"]), "\n").alias("body"), *[F.first(c).alias(c) for c in ("transition", "closer")])
    heading = kinds[F.col("kind")]
    heading = F.when(F.col("kind") == "bullet", F.col("transition")).when(F.col("kind") == "caveat", F.col("closer")).otherwise(heading)
    out = body.withColumn("part", F.concat(heading, F.lit(":\n"), F.col("body"))).groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section", "part"))), lambda x: x["part"]), "\n\n").alias("answer"))
    out = words.select("id", F.when(F.col("max_preface") > 0, F.col("opener")).alias("preface"), "other").join(out, "id", "left")
    if questions is not None:
        out = out.join(questions, "id", "left").withColumn("question", F.concat("other", F.lit(" "), "question"))
    else:
        out = out.withColumn("question", F.lit(None).cast("string"))
    return out.select("id", F.concat_ws("\n\n", "preface", "answer", "question").alias("answer"))
