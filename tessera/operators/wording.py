"""Wording of answers by a sequence model: which of a site's ready phrases is used, never what is said.

A token names a site, what the phrase belongs to there, and its number: ``opener:Direct:1``. A model of earlier answers'
tokens (``ngram``) tells what followed the same last tokens; of the choices of the longest such context, those that the
site and the tone allow count, the commonest first. Where none is left, a site keeps its first phrase.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import ngram
from tessera.operators.pragmatics import TONES

#: The phrases: for each site and what it stands for there, the first is the one used without a choice.
PHRASES = {
    "opener": {
        "Neutral": ["Here is what I found.", "Found so far."],
        "Supportive": ["That sounds hard; here is what I found.", "Let us take this step by step."],
        "Direct": ["The answer:", "In brief:"],
        "Cautious": ["Please treat this with care.", "This may need a second look."],
    },
    "transition": {"details": ["Details", "Details, briefly"]},
    "closer": {"caveat": ["Please note", "Keep in mind"]},
    "other": {"question": ["One question:", "To be sure:"]},
}
SITES = list(PHRASES)
#: Tokens of an answer that a model is asked with, and a reply's length from which it counts as long.
ORDER, BRIEF = 4, 100


def token(site: str, what: str, k: int) -> str:
    return f"{site}:{what}:{k}"


def allow_list(spark: SparkSession) -> DataFrame:
    """(site, tone, next): the tokens that a site may use in a tone; openers belong to one, the others to all."""
    rows = [(site, tone, token(site, what, k)) for tone in TONES for site, each in PHRASES.items() for what, texts in each.items() if site != "opener" or what == tone for k in range(len(texts))]
    return spark.createDataFrame(rows, "site string, tone string, next string")


def observed(replies: DataFrame) -> DataFrame:
    """(stream, turn, place, token) of earlier replies (stream, turn, tone, text): which phrases a reply of this tone and
    shape stands for. Short replies count as the second wording; a closer is one that warns, a question one that asks."""
    k = F.when(F.length("text") < BRIEF, "1").otherwise("0")
    told = lambda site, what: F.concat(F.lit(f"{site}:"), what, F.lit(":"), k)
    sites = F.array(
        told("opener", F.col("tone")),
        told("transition", F.lit("details")),
        F.when(F.col("tone") == "Cautious", told("closer", F.lit("caveat"))),
        F.when(F.col("text").contains("?"), told("other", F.lit("question"))),
    )
    each = replies.where("text is not null").select("stream", "turn", F.posexplode(sites).alias("place", "token"))
    return each.where("token is not null")


def trained(tokens: DataFrame, order: int = ORDER) -> DataFrame:
    """The model of observed tokens: counts of contexts within a stream, pruned."""
    return ngram.pruned(ngram.counts(ngram.streams(tokens, "stream", ["turn", "place"], "token", order)))


def choices(model: DataFrame, asked: DataFrame) -> DataFrame:
    """(id, site, choice, cnt, ctx_len) for each answer to come (id, tone, back: its conversation's last tokens): the
    chosen phrase of every site that the longest known context has an allowed one for."""
    found = ngram.next_choices(model, asked.select(F.col("id").alias("stream"), "back")).join(asked.select(F.col("id").alias("stream"), "tone"), "stream")
    fit = ngram.allowed(found.withColumn("site", F.substring_index("next", ":", 1)), allow_list(asked.sparkSession))
    best = F.row_number().over(Window.partitionBy("stream", "site").orderBy(F.col("cnt").desc(), "next"))
    return fit.withColumn("_n", best).where("_n = 1").select(F.col("stream").alias("id"), "site", F.col("next").alias("choice"), "cnt", "ctx_len")


def phrased(told: DataFrame, chosen: DataFrame | None = None) -> DataFrame:
    """``told`` (id, tone, more) with opener, transition, closer and other: the texts that each answer uses."""
    texts = F.create_map(*[F.lit(x) for site, each in PHRASES.items() for what, some in each.items() for k, text in enumerate(some) for x in (token(site, what, k), text)])
    first = {"opener": F.concat(F.lit("opener:"), F.col("tone"), F.lit(":0")), **{site: F.lit(token(site, next(iter(PHRASES[site])), 0)) for site in SITES[1:]}}
    out = told
    if chosen is not None:
        named = chosen.groupBy("id").agg(*[F.max(F.when(F.col("site") == site, F.col("choice"))).alias(f"_{site}") for site in SITES])
        out = out.join(named, "id", "left")
        first = {site: F.coalesce(F.col(f"_{site}"), c) for site, c in first.items()}
    return out.select(*told.columns, *[F.try_element_at(texts, c).alias(site) for site, c in first.items()])
