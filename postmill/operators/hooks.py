"""Hooks for what a caller brings: models for verdicts and embeddings and a provider of web snippets, called in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.functions.dictionary import bound
from postmill.values import RETRYABLE, TOO_LARGE

WIDTH = 64
ATTEMPTS = "array<struct<number:int,model:string,kind:string,message:string>>"


class ModelError(Exception):
    """What a model or provider raises, for a whole batch, or gives in place of one answer, when it fails. Other exceptions are faults of
    the program and end the task."""


@dataclass(frozen=True)
class Model:
    """call: from a series of prompts and the number of the attempt to as many answers or ModelErrors. size_is_final: after a
    request too large, this model is not asked again for the same prompt."""

    name: str
    call: Callable[[pd.Series, int], Sequence]
    size_is_final: bool = False


def kind_of(message: str) -> str:
    """too_large, retryable or other, by the words of an error."""
    low = message.lower()
    return "too_large" if any(m in low for m in TOO_LARGE) else "retryable" if any(m in message for m in RETRYABLE) else "other"


def _called(call, some: pd.Series) -> list:
    """Answers, ModelErrors and Nones, one for each of some."""
    try:
        return list(call(some))
    except ModelError as e:
        return [e] * len(some)


def embedded(df: DataFrame, text: Column, model: Callable[[pd.Series], Sequence], name: str = "embedding") -> DataFrame:
    """df with the vector of each text that is not blank, and `name`_error, why a text that was asked has none. model: from a
    series of texts to as many vectors, ModelErrors or Nones."""

    @F.pandas_udf("vector array<double>, error string")
    def vectors(texts: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame({"vector": [None] * len(texts), "error": [None] * len(texts)}, index=texts.index, dtype=object)
        some = texts[texts.notna() & (texts.str.strip() != "")]
        if len(some):
            for i, v in zip(some.index, _called(model, some), strict=True):
                if v is None or isinstance(v, ModelError):
                    out.at[i, "error"] = str(v or "no vector")
                else:
                    out.at[i, "vector"] = [float(x) for x in v]
        return out

    return df.withColumn("_made", vectors(text)).withColumns({name: F.col("_made.vector"), f"{name}_error": F.col("_made.error")}).drop("_made")


def hashed_words(text: Column, width: int = WIDTH) -> Column:
    """An offline stand-in for a model, all in the JVM: counts of words by hash. Null for texts without words. Words are hashed
    once each; their places are sorted with one more of every place, and a count is how far a place's run reaches, less that one."""

    def ends(places: Column) -> Column:
        return F.filter(F.sequence(F.lit(1), F.size(places)), lambda i: ~F.get(places, i).eqNullSafe(F.get(places, i - 1)))

    def counts(ends: Column) -> Column:
        begins = F.concat(F.array(F.lit(0)), F.slice(ends, 1, width - 1))
        return F.zip_with(ends, begins, lambda end, begin: (end - begin - 1).cast("double"))

    def vector(words: Column) -> Column:
        places = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(width)).cast("int"))
        every = F.sort_array(F.concat(places, F.sequence(F.lit(0), F.lit(width - 1))))
        return F.when(F.size(words) > 0, bound(every, lambda p: bound(ends(p), counts)))

    return bound(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != ""), vector)


def with_snippets(df: DataFrame, query: Column, provider: Callable[[pd.Series], Sequence], most: int = 5, name: str = "snippets") -> DataFrame:
    """df with the first web snippets of each query, joined by blanks, and `name`_error, why one that was asked has none; null
    queries are not asked. provider: from a series of queries to as many lists of snippets, ModelErrors or Nones."""

    @F.pandas_udf("found string, error string")
    def found(queries: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame({"found": [""] * len(queries), "error": [None] * len(queries)}, index=queries.index, dtype=object)
        some = queries[queries.notna()]
        if len(some):
            for i, own in zip(some.index, _called(provider, some), strict=True):
                if own is None or isinstance(own, ModelError):
                    out.at[i, "error"] = str(own or "no answer")
                else:
                    out.at[i, "found"] = " ".join(own[:most])
        return out

    return df.withColumn("_made", found(query)).withColumns({name: F.col("_made.found"), f"{name}_error": F.col("_made.error")}).drop("_made")


def ask_in_turn(df: DataFrame, prompt: Column, models: Sequence[Model], most: int = 4, name: str = "answer") -> DataFrame:
    """df with name, the first answer to the prompt, `name`_model, who gave it, and attempts: number, model, kind (ok, too_large,
    retryable or other) and message of each. Null prompts are not asked.

    Attempts go through models in turn, up to most; each round asks only for the rows of the batch that are still without
    an answer. A row that is too large for a model whose size is final goes on to the next without another try there, and the
    round does not count as an attempt. All rounds of a batch are one task's, so nothing is shuffled between them.
    """
    turns = [(n, models[n % len(models)]) for n in range(most)]

    @F.pandas_udf(f"answer string, model string, attempts {ATTEMPTS}")
    def ask(prompts: pd.Series) -> pd.DataFrame:
        answers, by = {}, {}
        tried: dict = {i: [] for i in prompts.index}
        final: dict = {m.name: set() for m in models}
        open_ = list(prompts.index[prompts.notna()])
        for n, model in turns:
            some = [i for i in open_ if i not in final[model.name]]
            if not some:
                continue
            for i, a in zip(some, _called(lambda p, n=n, model=model: model.call(p, n), prompts.loc[some]), strict=True):
                failed = a is None or isinstance(a, ModelError)
                message = str(a or "no answer") if failed else None
                kind = kind_of(message) if failed else "ok"
                tried[i].append({"number": n, "model": model.name, "kind": kind, "message": message})
                if not failed:
                    answers[i], by[i] = a, model.name
                elif kind == "too_large" and model.size_is_final:
                    final[model.name].add(i)
            open_ = [i for i in open_ if i not in answers]
        rows = list(prompts.index)
        return pd.DataFrame({"answer": [answers.get(i) for i in rows], "model": [by.get(i) for i in rows], "attempts": [tried[i] for i in rows]}, index=prompts.index)

    return df.withColumn("_made", ask(prompt)).withColumns({name: F.col("_made.answer"), f"{name}_model": F.col("_made.model"), "attempts": F.col("_made.attempts")}).drop("_made")


def attempt_rows(asked: DataFrame, keys: list[str]) -> DataFrame:
    """One row per attempt of what ask_in_turn() gave: keys, number, model, kind, message."""
    return asked.select(*keys, F.explode("attempts").alias("_a")).select(*keys, "_a.*")
