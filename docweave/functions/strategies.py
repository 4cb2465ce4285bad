"""Routing strategies by name: each gives a decision and a confidence for a question, as one column."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from docweave.functions import routing

Strategy = Callable[[Column], Column]

_registered: dict[str, Strategy] = {}


def strategy(name: str) -> Callable[[Strategy], Strategy]:
    """Registers ``fn(text) -> struct(result boolean, confidence double)``; a name is taken once."""
    def wrap(fn: Strategy) -> Strategy:
        if name in _registered:
            raise ValueError(f"strategy {name} is registered")
        _registered[name] = fn
        return fn

    return wrap


def unregister(name: str) -> None:
    _registered.pop(name, None)


def names() -> list[str]:
    return sorted(_registered)


def votes(questions: DataFrame, text: str, chosen: list[str] | None = None) -> DataFrame:
    """``questions`` once per strategy, in the order of ``chosen`` (all, by name): with strategy, result and confidence (0 to 1).

    All strategies of a row are evaluated in one pass. An unknown name fails before anything runs; a null vote is no decision
    with confidence 0.
    """
    use = names() if chosen is None else chosen
    if unknown := sorted(set(use) - set(_registered)):
        raise KeyError(f"no strategy {', '.join(unknown)}")
    ballot = [F.struct(F.lit(n).alias("strategy"), F.coalesce(v["result"], F.lit(False)).alias("result"),
                       F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(v["confidence"].cast("double"), F.lit(0.0)))).alias("confidence"))
              for n in use for v in [_registered[n](F.col(text))]]
    none = F.array().cast("array<struct<strategy: string, result: boolean, confidence: double>>")
    return questions.select("*", F.explode(F.array(*ballot) if ballot else none).alias("_v")).select(*questions.columns, "_v.*")


strategy("keyword")(routing.keyword_strategy)


@strategy("smalltalk")
def smalltalk(text: Column) -> Column:
    """Greetings need no search, with the confidence that the keyword vote gives them; on others it has no opinion."""
    vote = routing.keyword_strategy(text)
    greeted = ~vote["result"] & (vote["confidence"] >= 0.9)
    return F.struct(F.lit(False).alias("result"), F.when(greeted, vote["confidence"]).otherwise(0.0).alias("confidence"))
