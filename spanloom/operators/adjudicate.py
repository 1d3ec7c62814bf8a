"""Review of doubtful rows by a language model: tasks, cached verdicts, and what a verdict changes."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions import text as T
from spanloom.options import AdjudicationOptions

#: A client: system and user prompt to the answer's text.
Client = Callable[[str, str, int], str]
NONE_LABEL = "无"


def eligible(rows: DataFrame, keys: list[str]) -> DataFrame:
    """[F15, X6] Groups to review and why; the first reason of suspicious, untraced, added, ambiguous counts.

    ``rows`` has ``evidence``, ``upstream_ref``, ``ambiguous`` and ``n_candidates``.
    """
    some = lambda c: F.bool_or(F.coalesce(c, F.lit(False)))
    flags = rows.groupBy(*keys).agg(
        some(F.col("evidence").contains("[suspicious]")).alias("suspicious"),
        F.bool_and(F.col("upstream_ref") == "").alias("untraced"),
        some(F.col("evidence").contains("[added]")).alias("added"),
        some(F.col("ambiguous")).alias("ambiguous"),
        F.max("n_candidates").alias("n_candidates"),
    )
    kind = F.when(F.col("suspicious"), "suspicious").when(F.col("untraced"), "untraced").when(F.col("added"), "added").when(F.col("ambiguous"), "ambiguous")
    return flags.withColumn("task_type", kind).filter(F.col("task_type").isNotNull() & (F.col("n_candidates") > 0)).select(*keys, "task_type")


def prompt(downstream: Column, candidates: Column, note: Column, o: AdjudicationOptions = AdjudicationOptions()) -> Column:
    """[N34, N27] The question: the clipped downstream text and the labelled, clipped candidates."""
    listed = F.array_join(F.transform(candidates, lambda c: F.concat(F.lit("["), c["label"], F.lit("] "), c["doc"], F.lit(" "), c["key"], F.lit("\n"), T.clipped(c["content"], o.clip_candidate))), "\n\n")
    return F.concat_ws("\n\n", F.concat(F.lit("下游内容:\n"), T.clipped(downstream, o.clip_downstream)), F.concat(F.lit("候选上游:\n"), listed), note)


def cache_key(model: Column, system: Column, user: Column) -> Column:
    """[S11] What identifies an answer."""
    return F.sha2(F.concat_ws("\n", model, system, user).cast("binary"), 256)


def parsed_answer(text: Column) -> Column:
    """[N31, JSON] Verdict, confidence, evidence and reasoning of the outermost object; null without one."""
    return F.from_json(T.outermost_json(text), "verdict string, confidence double, key_evidence string, reasoning string", {"mode": "PERMISSIVE"})


def asked(tasks: DataFrame, client: Client, cache: DataFrame | None = None, *, system: str = "", first_tokens: int = 2000, most_tokens: int = 8000, attempts: int = 3, pause: float = 1.0) -> DataFrame:
    """[X10, S11, K9] Answers to tasks ``seq``, ``cache_key``, ``user``: known ones from the cache, others from the client.

    An answer that holds no object is asked for again with twice the tokens, failures after a
    growing pause; a task that fails stays without text. ``cached`` tells which came from the cache.
    """
    known = tasks.join(cache.select("cache_key", "answer"), "cache_key", "left") if cache is not None else tasks.withColumn("answer", F.lit(None).cast("string"))

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            answers, errors = [], []
            for user in frame["user"]:
                answer, error, tokens = None, None, first_tokens
                for attempt in range(attempts):
                    try:
                        text = client(system, user, tokens)
                        begin, end = text.find("{"), text.rfind("}")
                        json.loads(text[begin : end + 1])
                        answer = text
                        break
                    except ValueError as e:
                        error, tokens = repr(e), min(2 * tokens, most_tokens)
                    except Exception as e:  # noqa: BLE001
                        error = repr(e)
                        time.sleep(pause * 2**attempt)
                answers.append(answer)
                errors.append(None if answer else error)
            yield pd.DataFrame({"seq": frame["seq"], "cache_key": frame["cache_key"], "answer": answers, "error": errors})

    fresh = known.filter(F.col("answer").isNull()).select("seq", "cache_key", "user").mapInPandas(ask, "seq long, cache_key string, answer string, error string").withColumn("cached", F.lit(False))
    old = known.filter(F.col("answer").isNotNull()).select("seq", "cache_key", "answer", F.lit(None).cast("string").alias("error"), F.lit(True).alias("cached"))
    return old.unionByName(fresh)


def normal_verdict(raw: Column, labels: Column) -> Column:
    """[X7] A label; else, unless it holds the word for none, the first label that it contains; else none or the raw text."""
    said = T.strip(F.coalesce(raw, F.lit("")))
    inside = F.get(F.filter(labels, lambda x: said.contains(x)), F.lit(0))
    return F.when(F.array_contains(labels, said) | (said == NONE_LABEL), said).when(said.contains(NONE_LABEL), said).otherwise(F.coalesce(inside, F.lit(NONE_LABEL)))


def bounded_confidence(c: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(c, F.lit(0.0))))


def disposition(task_type: Column, verdict: Column, confidence: Column, in_group: Column, o: AdjudicationOptions = AdjudicationOptions()) -> Column:
    """[X8] What to do with a verdict: ignore, opinion, none, confirm, advise, or suggest another."""
    return (
        F.when(confidence < o.opinion, "ignore")
        .when(task_type == "suspicious", "opinion")
        .when(verdict == NONE_LABEL, "none")
        .when(in_group & (confidence >= o.auto_confirm), "confirm")
        .when(in_group, "advise")
        .otherwise("suggest_other")
    )


def disposed(rows: DataFrame, verdicts: DataFrame, keys: list[str], o: AdjudicationOptions = AdjudicationOptions()) -> DataFrame:
    """[X8] Rows with ``ai_opinion``; a confirmed group is ambiguous no more. ``verdicts`` has the keys, ``outcome``, ``verdict``, ``confidence``, ``reasoning``."""
    text = F.when(F.col("outcome") != "ignore", F.concat(F.col("outcome"), F.lit(": "), F.col("verdict"), F.format_string(" (%.2f) ", "confidence"), F.substring(F.coalesce("reasoning", F.lit("")), 1, o.reasoning_clip)))
    joined = rows.join(verdicts.select(*keys, "outcome", text.alias("ai_opinion")), keys, "left")
    return joined.withColumn("ambiguous", F.col("ambiguous") & ~F.coalesce(F.col("outcome") == "confirm", F.lit(False))).drop("outcome")


def with_names(text: Column, labels: Column) -> Column:
    """[X9] A text with labels replaced by what they stand for, longer labels first; ``labels`` is an array of label and name."""
    ordered = F.array_sort(labels, lambda a, b: F.length(b["label"]) - F.length(a["label"]))
    return F.aggregate(ordered, text, lambda t, x: F.replace(t, x["label"], x["name"]))


def answer_counts(verdicts: DataFrame) -> DataFrame:
    """[A19] How many verdicts had each outcome."""
    return verdicts.groupBy("outcome").agg(F.count("*").alias("verdicts")).orderBy("outcome")


def first_of_group(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).filter("_n = 1").drop("_n")
