"""Model providers. A provider is a column expression, or a Python callable over Arrow batches for a real model.

The stubs are deterministic column expressions, so plans and tests need no network and stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stacklight.config import DEFAULTS
from stacklight.functions.text import is_blank
from stacklight.ontology import CAPS, EMOTIONS, vocabulary

CHARACTERS = "abcdefghijklmnopqrstuvwxyz0123456789"
# Letters that the emotion stub counts.
LETTERS = {"anger": "a", "disgust": "d", "fear": "f", "joy": "j", "neutral": "n", "sadness": "s", "surprise": "u"}


def stub_zero_shot(key: Column, text: Column, labels: list[str]) -> Column:
    """struct(labels, scores): three quarters for the first label if the key is even, else for the second."""
    first = F.when(key % 2 == 0, F.lit(0.75)).otherwise(F.lit(0.25))
    return F.struct(F.array(*[F.lit(x) for x in labels]).alias("labels"), F.array(first, 1 - first, *[F.lit(0.0)] * (len(labels) - 2)).alias("scores"))


def best_label(prediction: Column) -> Column:
    """The label with the highest score; the first of equal ones."""
    return F.element_at(prediction["labels"], F.array_position(prediction["scores"], F.array_max(prediction["scores"])).cast("int"))


def stub_emotions(sentence: Column) -> dict[str, Column]:
    """A score for each label: how often its letter occurs, over length + 1."""
    n = F.length(sentence)
    return {k: (n - F.length(F.replace(sentence, F.lit(c), F.lit("")))) / (n + 1) for k, c in LETTERS.items()}


def stub_embedding(text: Column) -> Column:
    """A vector of how often each small letter and digit occurs."""
    t = F.lower(F.coalesce(text, F.lit("")))
    return F.array(*[(F.length(t) - F.length(F.replace(t, F.lit(c), F.lit("")))).cast("double") for c in CHARACTERS])


def zero_shot_model(load: Callable[[], Callable[[list[str], list[str]], list[list[float]]]]) -> Callable[[Column, Column, list[str]], Column]:
    """A provider for enrich.imputed() and enrich.evaluation() from a real model.

    load() runs once in each worker and gives a function of (texts, labels) to the scores of each text by label; it is called with an Arrow batch at a time."""

    def provider(key: Column, text: Column, labels: list[str]) -> Column:
        @F.pandas_udf("labels array<string>, scores array<double>")
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            score = load()
            for b in batches:
                got = score([x or "" for x in b], labels)
                yield pd.DataFrame({"labels": [labels] * len(b), "scores": [[float(y) for y in x] for x in got]})

        return run(text)

    return provider


#: Sentences that a model of emotions gets in one call.
SENTENCES = 4096


def emotion_model(load: Callable[[], Callable[[list[str]], list[dict[str, float]]]]) -> Callable[[Column], Column]:
    """A column of the greatest score of each emotion over the sentences of a text, by a real model.

    It is called with the sentences of many texts, SENTENCES at most, a long text's in several calls; of each text only the greatest scores so far are kept, so memory doesn't grow with texts."""

    @F.pandas_udf(", ".join(f"{e} double" for e in EMOTIONS))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        score = load()
        for b in batches:
            best: dict[str, list[float | None]] = {e: [None] * len(b) for e in EMOTIONS}
            parts = ((i, y) for i, x in enumerate(b) if x is not None for y in x.split("."))
            while some := [*islice(parts, SENTENCES)]:
                for (i, _), got in zip(some, score([y for _, y in some]), strict=True):
                    for e, top in best.items():
                        v = float(got[e])
                        if top[i] is None or v > top[i]:
                            top[i] = v
            yield pd.DataFrame(best)

    return run


def embedding_model(load: Callable[[], Callable[[list[str]], list[list[float]]]]) -> Callable[[Column], Column]:
    """A column of vectors by a real model, an Arrow batch at a time."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        embed = load()
        for b in batches:
            yield pd.Series([[float(y) for y in x] for x in embed([x or "" for x in b])])

    return run


@dataclass(frozen=True)
class ExtractorConfig:
    # The model and its settings.
    model: str = "gpt-4o-mini"
    temperature: float = 0.0
    attempts: int = DEFAULTS.extraction_attempts
    save_every: int = 50
    #: What a step of the cache takes at least, once steps have grown.
    step_seconds: float = 20.0
    prompt_chars: int = DEFAULTS.prompt_chars


def prompt(title: str, description: str, config: ExtractorConfig = ExtractorConfig()) -> list[tuple[str, str]]:
    """(role, text) of the messages that ask for one book's concepts: the closed vocabularies, how many of each, and the book."""
    ask = ["Name the concepts of a book from its title and description. Answer with five lists."]
    for field, most in CAPS.items():
        if field == "settings":
            ask.append(f"{field}: no more than {most} places or times, hyphenated, in words of your own.")
        else:
            ask.append(f"{field}: {'1' if field == 'themes' else '0'} to {most}, only of: {', '.join(vocabulary(field))}.")
    ask.append("A list may be empty. Other concepts are refused.")
    return [("system", "\n".join(ask)), ("human", f"Title: {title}\nDescription: {description[: config.prompt_chars]}")]


def human_prompt(title: Column, description: Column, config: ExtractorConfig = ExtractorConfig()) -> Column:
    """The book's part of the prompt, as a column."""
    return F.concat(F.lit("Title: "), F.coalesce(title, F.lit("")), F.lit("\nDescription: "), F.substring(F.coalesce(description, F.lit("")), 1, config.prompt_chars))


def prompted(load: Callable[[ExtractorConfig], Callable[[list[tuple[str, str]]], dict | None]], config: ExtractorConfig = ExtractorConfig()) -> Callable[[str, str], dict | None]:
    """A provider for extract() that prompts a chat model; load(config) makes the client once in each worker."""
    made: list = []

    def provider(title: str, description: str) -> dict | None:
        if not made:
            made.append(load(config))
        return made[0](prompt(title, description, config))

    return provider


FIELDS = ("themes", "settings", "moods", "tropes", "forms")
OUTCOME = "isbn13 long, " + ", ".join(f"{f} array<string>" for f in FIELDS) + ", outcome string, attempts int, error string"


def outcomes(df: DataFrame, provider: Callable[[str, str], dict | None], config: ExtractorConfig = ExtractorConfig()) -> DataFrame:
    """A row for each book: its concepts, and the outcome: extracted, blank (no description), refused (no answer) or failed (an error in each attempt, the last one told).

    The provider is called on the executors, a batch of rows at a time, so calls run in parallel and a lost task is repeated."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for isbn, title, description in zip(b.isbn13, b.title, b.description, strict=True):
                got, error, n, outcome = None, None, 0, "blank" if not (description or "").strip() else "failed"
                while outcome == "failed" and n < config.attempts:
                    n += 1
                    try:
                        got = provider(title, description[: config.prompt_chars])
                        outcome, error = ("refused" if got is None else "extracted"), None
                    except Exception as e:  # whatever the model's client raises; it is told in the row
                        error = f"{type(e).__name__}: {e}"
                rows.append((isbn, *[list((got or {}).get(f) or []) for f in FIELDS], outcome, n, error))
            yield pd.DataFrame(rows, columns=["isbn13", *FIELDS, "outcome", "attempts", "error"])

    return df.select("isbn13", F.coalesce("title", F.lit("")).alias("title"), "description").mapInPandas(run, OUTCOME)


def extract(df: DataFrame, provider: Callable[[str, str], dict | None], config: ExtractorConfig = ExtractorConfig()) -> DataFrame:
    """(isbn13, themes, settings, moods, tropes, forms) of the books that the provider answers for."""
    return outcomes(df.where(~is_blank(F.col("description"))), provider, config).where("outcome = 'extracted'").select("isbn13", *FIELDS)
