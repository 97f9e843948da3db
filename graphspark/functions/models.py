"""Calls of a language model over rows, by a pluggable client."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .text import capitalize_words, english_join, json_list

# The templates of the prompts.
ADD_LINK = "The drug {drug} treats {disease}. Suppose that {source} now {relation} {target}. Could the drug still treat the disease? Answer YES or NO, then give the path, a line for each step: Type: Name | relation | Type: Name."
EDIT_LINK = "Known steps:\n{steps}\nSuppose that the step {edge} were changed to {relation}. What would happen to the disease? Choose: {options}."


def prompt(template: str, **columns: Column) -> Column:
    """The template with its {fields} filled in from columns."""
    out = F.lit(template)
    for name, c in columns.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(c.cast("string"), F.lit("")))
    return out


def echo_client() -> Callable[[str], str]:
    """A stand-in that needs no network: YES or NO by the prompt's length, and its last line."""
    return lambda p: ("YES" if len(p) % 2 else "NO") + "\n" + p.rstrip().rsplit("\n", 1)[-1]


def ask(df: DataFrame, prompt_column: str, client: Callable[[], Callable[[str], str]] = echo_client, out: str = "answer", threads: int = 32, attempts: int = 6, pause: float = 5.0, most_pause: float = 90.0) -> DataFrame:
    """Add answers and ``<out>_error``; each task opens one client and asks in parallel, failures are tried again after growing pauses.

    A null prompt gets a null answer without a call; an empty table makes no call.
    """
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.StringType()), T.StructField(f"{out}_error", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = client()

        def one(text: str) -> tuple[str | None, str | None]:
            last = None
            for k in range(attempts if text is not None else 0):
                try:
                    return call(text), None
                except Exception as e:  # told in the error column
                    last = str(e)
                    if k + 1 < attempts:
                        time.sleep(min(most_pause, pause * 2**k) * (1 + random.random() / 10))
            return None, last

        with ThreadPoolExecutor(threads) as pool:
            for pdf in batches:
                got = list(pool.map(one, pdf[prompt_column]))
                yield pdf.assign(**{out: [g[0] for g in got], f"{out}_error": [g[1] for g in got]})

    return df.mapInPandas(run, schema)


# The words of prompts for types of nodes (one, several), types whose names keep their letters, and short names of models.
TYPE_WORDS = {"Drug": ("drug", "drugs"), "ChemicalSubstance": ("chemical substance", "chemical substances"), "Protein": ("protein", "proteins"), "GeneFamily": ("gene family", "gene families"), "Disease": ("disease", "diseases"), "BiologicalProcess": ("biological process", "biological processes")}
KEEP_CASE = ["Protein", "GeneFamily"]
MODEL_ALIASES = {"small": "model-small-latest", "large": "model-large-latest"}
FACTUAL = "The drug {drug} is {known} for {disease}.{hints} Give the way in which it acts, a line for each step: Type: Name | relation | Type: Name.{examples}"


def alias(name: Column, aliases: dict[str, str] = MODEL_ALIASES) -> Column:
    """A model's full name; one without an alias stays."""
    out = name
    for short, full in aliases.items():
        out = F.when(name == short, full).otherwise(out)
    return out


def type_words(kind: Column, several: bool = False) -> Column:
    """A type in words, with capitals; types without words stay as they are."""
    out = kind
    for t, words in TYPE_WORDS.items():
        out = F.when(kind == t, F.lit(words[several])).otherwise(out)
    return capitalize_words(out)


def node_words(name: Column, kind: Column) -> Column:
    """A node's name with capitals, unless its type keeps them."""
    return F.when(kind.isin(KEEP_CASE), name).otherwise(capitalize_words(name))


def example_line(line: Column) -> Column:
    """A line "Type: name (id) | relation | Type: name (id)" as prompts show it: no ids, types in words, names with capitals."""
    parts = F.split(F.regexp_replace(line, " \\([^)]+\\)", ""), " \\| ")
    side = lambda x: F.concat(type_words(F.split_part(x, F.lit(": "), F.lit(1))), F.lit(": "), capitalize_words(F.regexp_replace(x, "^[^:]*: ", "")))
    return F.concat_ws(" | ", side(F.get(parts, 0)), F.get(parts, 1), side(F.get(parts, 2)))


def with_examples(text: Column, examples: Column) -> Column:
    """A prompt with its examples (an array of texts), numbered; none adds nothing."""
    shown = F.transform(examples, lambda x, k: F.concat(F.lit("Example "), (k + 1).cast("string"), F.lit(":\n"), x))
    return F.when(F.size(F.coalesce(examples, F.array().cast("array<string>"))) > 0, F.concat(text, F.lit("\n\n"), F.array_join(shown, "\n\n"))).otherwise(text)


def factual_prompt(drug: Column, disease: Column, known: Column, hints: Column, examples: Column) -> Column:
    """A factual question; hints (an array of names associated with the disease) and examples may be empty."""
    told = F.when(F.size(hints) > 0, F.concat(F.lit(" The disease is associated with "), english_join(hints), F.lit(".")))
    return with_examples(prompt(FACTUAL, drug=drug, disease=disease, known=known, hints=told, examples=F.lit("")), examples)


def masked_hints(hints: DataFrame, key: str, name: str, similarities: DataFrame, most: float = 0.2) -> DataFrame:
    """Hints (key, name) without those too similar to the disease: similarities has (key, name, score); no score counts as 0."""
    j = hints.join(similarities.select(key, name, "score"), [key, name], "left")
    return j.where(F.coalesce("score", F.lit(0.0)) <= most).select(*hints.columns)


class PromptBuilder:
    """What builds prompts: a subclass gives ``text``, an expression over a row's columns; ``build`` adds it to a table."""

    def text(self) -> Column:
        raise NotImplementedError

    def build(self, df: DataFrame, out: str = "prompt") -> DataFrame:
        return df.withColumn(out, self.text())


def moderated(df: DataFrame, prompts: list[Column], moderator: str, client: Callable[[], Callable[[str], str]] = echo_client, **options) -> DataFrame:
    """Several prompts are asked, then one with all their answers ({answer_1}, {answer_2}, ...); adds the answers and ``verdict``."""
    asked = df
    for k, p in enumerate(prompts, 1):
        asked = ask(asked.withColumn(f"_p{k}", p), f"_p{k}", client, out=f"answer_{k}", **options).drop(f"_p{k}")
    last = prompt(moderator, **{f"answer_{k}": F.col(f"answer_{k}") for k in range(1, len(prompts) + 1)})
    return ask(asked.withColumn("_pm", last), "_pm", client, out="verdict", **options).drop("_pm")


def asked_lists(df: DataFrame, prompt_column: str, follow_ups: list[str], client: Callable[[], Callable[[str], str]] = echo_client, out: str = "items", **options) -> DataFrame:
    """Add a JSON list out of the answer; where there is none, each follow-up ({prompt}, {answer}) asks again. Null where all fail."""
    got = ask(df, prompt_column, client, out="_a", **options).withColumn(out, json_list(F.col("_a"))).drop("_a_error")
    for text in follow_ups:
        again = F.when(F.col(out).isNull(), prompt(text, prompt=F.col(prompt_column), answer=F.col("_a")))
        got = ask(got.withColumn("_p", again), "_p", client, out="_b", **options)
        got = got.withColumns({out: F.coalesce(out, json_list(F.col("_b"))), "_a": F.coalesce("_b", "_a")}).drop("_b", "_b_error", "_p")
    return got.drop("_a")
