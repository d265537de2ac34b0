"""Message features: cue words and pairs become flags, counts and integer scores, all as expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T

#: Cue words.
WORDS = {
    "wh": ["what", "why", "how", "when", "where", "who", "which"],
    "request": ["please"],
    "constraints": ["must", "should", "avoid", "never", "only", "require", "requires"],
    "meta": ["system", "assistant", "model", "prompt", "chatgpt", "gpt"],
    "follow_first": ["and", "also", "so"],
    "hedge": ["maybe", "perhaps", "probably", "likely", "kinda", "sorta"],
    "intensifier": ["very", "extremely", "super", "really", "so"],
    "profanity": ["damn", "shit", "fuck"],
    "apology": ["sorry", "apologies"],
    "gratitude": ["thanks", "thank", "appreciate"],
    "insult": ["idiot", "stupid", "moron"],
    "safety": ["suicide", "self-harm", "kill", "murder"],
    "brainstorm": ["brainstorm", "ideas", "options"],
    "debate": ["debate", "argue", "argument", "prove", "refute"],
    "first_person": ["i", "me", "my", "mine"],
    "negative": ["hate", "angry", "frustrated", "annoyed", "upset"],
    "problem": ["no", "not", "never", "none", "missing", "empty"],
    "compare": ["compare", "versus", "vs", "difference"],
    "recommend": ["recommend", "recommended", "best"],
    "summarize": ["summarize", "summary", "recap", "overview", "tldr"],
    "explain": ["explain", "walkthrough", "reasoning"],
    "target": ["and", "or", "between"],
    "explicit_target": ["vs", "versus", "between"],
    "focus_summary": ["brief", "short", "overview", "recap", "tldr"],
    "focus_steps": ["steps", "step", "detailed", "detail", "walkthrough"],
    "focus_example": ["example", "sample", "demo", "illustration"],
    "imperative": ["do", "make", "show", "tell", "give", "write", "explain", "help", "build", "implement", "fix"],
}
#: Cue pairs of neighbouring words.
PAIRS = {
    "request": ["can you", "could you", "would you"],
    "constraints": ["do not"],
    "follow": ["what about", "how about"],
    "hedge": ["i think", "kind of"],
    "brainstorm": ["what if"],
    "compare": ["better than", "compare with"],
    "recommend": ["which best", "what best"],
    "summarize": ["sum up"],
    "explain": ["walk through", "explain why", "explain how"],
    "focus_summary": ["high level", "sum up"],
    "focus_steps": ["step by", "next steps", "walk through"],
    "focus_example": ["for example"],
}
#: Flags, by bit.
FLAGS = ["question", "request", "constraints", "math", "code", "meta_prompt", "follow_up", "safety", "problem_solve", "logic_puzzle", "compare", "recommend", "summarize", "explain", "compare_targets", "focus_summary", "focus_steps", "focus_example"]
MODES = ["Unknown", "Ask", "Command", "Vent", "Debate", "Brainstorm"]
FOLLOW_UP_BYTES = 80
SCORES = ["emphasis", "temperature", "arousal", "politeness", "formality", "directness", "empathy", "valence"]


def flag(name: str) -> Column:
    return F.col("flags").bitwiseAND(F.lit(1 << FLAGS.index(name))) != 0


def features(messages: DataFrame, text_col: str = "text", problem_words: list[str] | None = None, puzzle_words: list[str] | None = None, verbs: list[str] | None = None) -> DataFrame:
    """``messages`` with counts, flags (a bit set), mode and scores; a null text counts as empty.

    The last three arguments bring a lexicon's cue words and verbs, if there is one.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = messages.withColumn("_text", text).withColumn("_w", T.tokens(T.ascii_lower(F.col("_text")))).withColumn("_p", F.when(F.size("_w") > 1, F.zip_with(F.slice("_w", F.lit(1), F.greatest(F.size("_w") - 1, F.lit(0))), F.slice("_w", F.lit(2), F.greatest(F.size("_w") - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>")))
    w, p, t = F.col("_w"), F.col("_p"), F.col("_text")
    lit = lambda words: F.array(*map(F.lit, words))
    word = lambda name: F.arrays_overlap(w, lit(WORDS[name]))
    pair = lambda name: F.arrays_overlap(p, lit(PAIRS[name]))
    many = lambda name: F.size(F.filter(w, lambda x: x.isin(WORDS[name]))).cast("bigint")
    either = lambda name: word(name) | pair(name)
    first = F.coalesce(F.get(w, F.lit(0)), F.lit(""))
    first_pair = F.coalesce(F.get(p, F.lit(0)), F.lit(""))
    marks = T.punctuation(t)
    out = out.withColumns({k: v for k, v in marks.items()})
    out = out.withColumns({
        "byte_len": F.octet_length(t).cast("bigint"),
        "caps_words": F.size(F.filter(T.tokens(t), lambda x: x.rlike("^[A-Z]{2,}$"))).cast("bigint"),
        "hedge_count": many("hedge") + F.size(F.filter(p, lambda x: x.isin(PAIRS["hedge"]))),
        "intensifier_count": many("intensifier"),
        "profanity_count": many("profanity"),
        "apology_count": many("apology"),
        "gratitude_count": many("gratitude"),
        "insult_count": many("insult"),
    })
    questions = F.col("questions") > 0
    constraints = either("constraints")
    asked = word("request") | first_pair.isin(PAIRS["request"])
    question = questions | first.isin(WORDS["wh"]) | (word("wh") & (asked | constraints))
    imperative = first.isin(WORDS["imperative"])
    if verbs:
        imperative = imperative | (~asked & ~question & first.isin(verbs))
    request = asked | (~questions & imperative)
    qr = question | request | constraints
    puzzle = problem = F.lit(False)
    if puzzle_words:
        hits = F.size(F.filter(w, lambda x: x.isin(puzzle_words)))
        puzzle = (hits > 0) & (constraints | question | (hits >= 2))
    if problem_words:
        problem = F.arrays_overlap(w, lit(problem_words)) & qr
    at = lambda some, pos: F.array_position(F.transform(some, pos), True)
    compare_at = at(w, lambda x: x.isin(WORDS["compare"]))
    pair_at = at(p, lambda x: x.isin(PAIRS["compare"]))
    back = at(F.reverse(w), lambda x: x.isin(WORDS["target"]))
    last_target = F.when(back > 0, F.size(w) - back + 1).otherwise(F.lit(0))
    targets = word("explicit_target") | ((compare_at > 0) & (last_target >= compare_at)) | ((pair_at > 0) & (last_target > pair_at + 1)) | (F.array_contains(p, "option a") & F.array_contains(p, "option b"))
    follow = first_pair.isin(PAIRS["follow"]) | ((F.col("byte_len") <= FOLLOW_UP_BYTES) & question & first.isin(WORDS["follow_first"]))
    values = {
        "question": question, "request": request, "constraints": constraints, "math": T.has_math(t, w), "code": T.has_code(t, w), "meta_prompt": word("meta"), "follow_up": follow, "safety": word("safety"),
        "problem_solve": problem | (question & request & (word("problem") | word("negative"))), "logic_puzzle": puzzle,
        "compare": either("compare") & qr, "recommend": either("recommend") & qr, "summarize": either("summarize") & qr, "explain": either("explain") & qr, "compare_targets": targets & qr,
        "focus_summary": (either("focus_summary") | either("summarize")) & qr, "focus_steps": (either("focus_steps") | either("explain")) & qr, "focus_example": either("focus_example") & qr,
    }
    bits = F.lit(0).cast("bigint")
    for k, name in enumerate(FLAGS):
        bits = bits + F.when(values[name], 1 << k).otherwise(0)
    cue = {"_negative": word("negative"), "_person": word("first_person"), "_debate": word("debate"), "_brain": either("brainstorm")}
    out = out.withColumn("flags", bits).withColumns(cue)
    c = F.col
    yes = lambda condition, n: F.when(condition, n).otherwise(0)
    rude = (c("profanity_count") > 0) | (c("insult_count") > 0)
    out = out.withColumn("emphasis", T.clamp(30 * c("exclamations") + 20 * c("questions") + 200 * c("repeat_punct_runs") + 120 * c("caps_words") + 40 * c("ellipses"), 0, 1000))
    out = out.withColumns({
        "temperature": T.clamp(150 + 200 * c("repeat_punct_runs") + 25 * c("exclamations") + 180 * c("profanity_count") + 220 * c("insult_count") + 80 * c("caps_words"), 0, 1000),
        "arousal": T.clamp(150 + F.floor(c("emphasis") / 2) + 50 * c("intensifier_count"), 0, 1000),
        "politeness": T.clamp(500 + 200 * c("gratitude_count") + 160 * c("apology_count") - 300 * c("profanity_count") - 350 * c("insult_count"), 0, 1000),
        "formality": T.clamp(500 + 80 * c("apology_count") + 50 * c("gratitude_count") - 150 * c("profanity_count") - 150 * c("insult_count") - 5 * c("exclamations") - 20 * c("repeat_punct_runs"), 0, 1000),
        "directness": T.clamp(500 - 150 * c("hedge_count") + yes(flag("request"), 200) + yes(flag("constraints"), 80) - yes(flag("question"), 50), 0, 1000),
        "empathy": T.clamp(100 + yes(flag("safety"), 700) + 200 * c("apology_count") + yes(c("_negative"), 200) + yes(rude, 150), 0, 1000),
        "valence": T.clamp(200 * c("gratitude_count") + 100 * c("apology_count") - 250 * c("profanity_count") - 300 * c("insult_count") - yes(c("_negative"), 150) - yes(flag("safety"), 200), -1000, 1000),
    })
    vent = (c("temperature") >= 700) & (rude | (c("_person") & c("_negative")))
    out = out.withColumn("mode", F.when(flag("question"), "Ask").when(flag("request"), "Command").when(c("_debate"), "Debate").when(c("_brain"), "Brainstorm").when(vent, "Vent").otherwise("Unknown"))
    #: What each mode adds.
    more = {"Ask": {"temperature": -50, "arousal": -50, "directness": -50}, "Command": {"directness": 100}, "Vent": {"temperature": 100, "politeness": -150, "empathy": 150, "valence": -100}, "Debate": {"formality": 50}, "Brainstorm": {"directness": -25}}
    for mode, changes in more.items():
        out = out.withColumns({k: F.when(c("mode") == mode, T.clamp(c(k) + n, -1000 if k == "valence" else 0, 1000)).otherwise(c(k)) for k, n in changes.items()})
    out = out.withColumn("formality", F.when(flag("meta_prompt"), T.clamp(c("formality") + 50, 0, 1000)).otherwise(c("formality")))
    return out.withColumns({k: c(k).cast("bigint") for k in SCORES}).drop("_text", "_w", "_p", *cue)


TONES, STYLES = ["Neutral", "Supportive", "Direct", "Cautious"], ["Default", "Debug", "StepByStep", "Checklist"]
#: Format flags, by bit.
FORMATS = ["bullets", "numbered", "summary", "next_steps", "risks", "assumptions"]


def directives(rows: DataFrame) -> DataFrame:
    """Rows of ``features`` with tone, style, format_flags and limits for an answer."""
    c = F.col
    asks = flag("question") | (c("questions") > 0)
    commanded = flag("request") | (c("mode") == "Command")
    tone = F.when(flag("safety"), "Cautious").when((c("empathy") >= 650) | (c("mode") == "Vent"), "Supportive").when((c("directness") >= 700) & (c("politeness") <= 350), "Direct").when((c("arousal") >= 650) & (c("directness") >= 600), "Direct").otherwise("Neutral")
    style = F.when(flag("code"), "Debug").when(flag("math"), "StepByStep").when(flag("constraints") | (c("mode") == "Command"), "Checklist").when(c("mode") == "Brainstorm", "StepByStep").otherwise("Default")
    out = rows.withColumns({"tone": tone, "style": style})
    solving = flag("problem_solve") | flag("logic_puzzle")
    on = {
        "bullets": (c("style") == "Debug") | ((c("style") == "Checklist") & ~commanded),
        "numbered": (c("style") == "StepByStep") | ((c("style") == "Checklist") & commanded),
        "summary": c("byte_len") >= 300,
        "next_steps": commanded | solving,
        "risks": flag("safety"),
        "assumptions": asks & ~flag("constraints"),
    }
    bits = F.lit(0).cast("bigint")
    for k, name in enumerate(FORMATS):
        bits = bits + F.when(on[name], 1 << k).otherwise(0)
    #: Codes of what a choice rests on.
    calm = ~flag("safety")
    gentle = calm & (c("empathy") < 650)
    because = {
        1: flag("safety"), 2: calm & (c("empathy") >= 650), 3: gentle & (c("mode") == "Vent"), 4: gentle & (c("mode") != "Vent") & (c("directness") >= 700) & (c("politeness") <= 350),
        10: flag("code"), 11: flag("math"), 12: flag("constraints"), 13: flag("request"), 14: asks, 15: c("byte_len") >= 300, 16: c("politeness") <= 350, 17: c("arousal") >= 650, 18: flag("problem_solve"), 19: flag("logic_puzzle"),
    }
    rationale = F.filter(F.array(*[F.when(condition, F.lit(code)) for code, condition in because.items()]), lambda x: x.isNotNull())
    by_tone = lambda *n: F.element_at(F.array(*[F.lit(x) for x in n]), F.array_position(F.array(*map(F.lit, TONES)), c("tone")).cast("int")).cast("bigint")
    return out.withColumns({"format_flags": bits, "max_softeners": by_tone(1, 2, 0, 1), "max_preface": by_tone(0, 1, 0, 1), "max_hedges": by_tone(2, 2, 1, 3), "max_questions": ((asks & ~flag("constraints")) | solving).cast("bigint"), "rationale": rationale})
