"""Text and decision-tree functions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from asterfold.functions.binding import bound, present

TREE = "array<struct<node: string, question: string, answer: string>>"


def word_count(c: Column) -> Column:
    t = F.regexp_replace(c, r"^\s+|\s+$", "")
    return F.when(t == "", 0).otherwise(F.size(F.split(t, r"\s+")))


def filled(template: str, slot: str, value: Column) -> Column:
    """The template with the value in its slot; a template without the slot raises."""
    if slot not in template:
        raise ValueError(f"the template has no {slot}")
    return F.replace(F.lit(template), F.lit(slot), value)


def restored(response: Column) -> tuple[Column, Column]:
    """A raw response without white space around it, and its words; null where nothing is left."""
    bare = F.regexp_replace(response, r"^\s+|\s+$", "")
    return F.nullif(bare, F.lit("")), word_count(response)


def instructed(instruction: str, text: Column) -> Column:
    if not instruction.strip():
        raise ValueError("a query needs an instruction")
    return F.concat(F.lit(f"Instruct: {instruction}\nQuery: "), text)


def without_trailing(c: Column, tokens: list[str]) -> Column:
    """The text without the tokens at its end, in any number and order, and without white space there."""
    return F.regexp_replace(c, rf"(?:\s*(?:{'|'.join(map(re.escape, tokens))}))*\s*$", "")


def place_key(ra: Column, dec: Column) -> Column:
    return F.format_string("%.8f,%.8f", ra, dec)


def tree(c: Column) -> Column:
    return F.from_json(c, TREE)


def tree_path(c: Column) -> Column:
    """The nodes' names: `node`, else question_answer. A tree without nodes, and a node without a name, raise."""
    name = lambda n: present(F.coalesce(n["node"], F.concat(n["question"], F.lit("_"), n["answer"])), "name of a node")
    return bound(tree(c), lambda t: F.when(F.size(t) == 0, F.raise_error(F.lit("a tree without nodes"))).otherwise(F.transform(t, name)))


def tree_answers(c: Column) -> Column:
    """question -> answer; of repeated questions the last answer."""

    def answers(asked: Column) -> Column:
        keys = F.array_distinct(F.transform(asked, lambda n: n["question"]))
        return bound(keys, lambda ks: F.map_from_arrays(ks, F.transform(ks, lambda q: F.element_at(F.filter(asked, lambda n: n["question"] == q), -1)["answer"])))

    return bound(F.filter(tree(c), lambda n: n["question"].isNotNull()), answers)


def path_overlap(human: Column, judge: Column) -> Column:
    """Share of the human path's nodes that the judge's path has."""
    return F.try_divide(F.size(F.array_intersect(judge, human)).cast("double"), F.size(human))


def stated(answer: Column) -> Column:
    return F.when(answer.isNull() | (answer == "not-mentioned"), "not-stated").otherwise(answer)
