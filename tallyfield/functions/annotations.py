"""Reading the JSON of annotations inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ENTRY = "array<struct<task:string,value:string>>"


def plain_json(text: Column) -> Column:
    """JSON text; where it is a JSON string that holds JSON, the inner text."""
    inner = F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<string>")[0]
    return F.when(F.ltrim(text).startswith('"'), inner).otherwise(text)


def entries(annotations: Column) -> Column:
    """Array of (task, value), ``value`` as JSON text (strings without quotes); null where it can't be read."""
    plain = plain_json(annotations)
    # one element that is no object makes the whole array unreadable; then each is read by itself
    each = F.transform(F.from_json(plain, "array<string>"), lambda e: F.from_json(e, "struct<task:string,value:string>"))
    return F.coalesce(F.from_json(plain, ENTRY), F.filter(each, lambda e: e.isNotNull()))


def index_ballot(value: Column, n_answers: Column) -> Column:
    """``value`` as zero-based index below ``n_answers`` if it is a whole number or the text of one, else null."""
    bare = F.trim(value)
    number = F.when(bare.rlike(r"^[+-]?\d+(\.\d*)?([eE][+-]?\d{1,3})?$"), bare.try_cast("double"))
    fits = (number >= 0) & (number < n_answers) & (number == F.floor(number))
    return F.when(fits, number.cast("int"))


def task_ballot(annotations: Column, task: Column, n_answers: Column) -> Column:
    """The last valid ballot that ``annotations`` holds for ``task``."""
    ballots = F.transform(
        F.filter(entries(annotations), lambda e: e["task"] == task),
        lambda e: index_ballot(e["value"], n_answers),
    )
    valid = F.filter(ballots, lambda b: b.isNotNull())
    return F.try_element_at(valid, F.lit(-1))


def written_lines(annotations: Column) -> Column:
    """All texts that marks carry, in their order: ``text``, then the text values of ``details``."""
    items = F.flatten(F.transform(entries(annotations), lambda e: F.coalesce(F.from_json(e["value"], "array<string>"), F.array().cast("array<string>"))))
    marks = F.transform(F.filter(items, lambda i: i.startswith("{")), lambda i: F.from_json(i, "struct<text:string,details:string>"))

    def lines(mark: Column) -> Column:
        details = F.coalesce(F.from_json(mark["details"], "array<string>"), F.array().cast("array<string>"))
        said = F.transform(details, lambda d: F.from_json(d, "struct<value:string>")["value"])
        return F.concat(F.array(mark["text"]), said)

    return F.filter(F.flatten(F.transform(marks, lines)), lambda x: x.isNotNull())
