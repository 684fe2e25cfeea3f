"""Nested records as related flat tables.

Method: Dewey labelling. Every node of a record gets the path of ordinals that leads to it (``1.0.2``: third
child of the first child of the second task); cutting the last ordinal gives the parent's label, and nodes are
grouped into tables by their schema path. Records nest without bound, which no fixed JVM schema covers, so one
Arrow-batched pass labels whole records; each record is labelled alone, without a shuffle, and repeated
deliveries fall together afterwards because label and id make equal rows.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NODE_SCHEMA = (
    "id long, dewey string, parent string, schema_path string, ordinal int, name string, kind string, value string"
)
FLAT_SCHEMA = "id long, level string, dewey string, parent string, task string, item_pos int, child string, value string"


MARK = re.compile(r'\s*(?:([\[\]{},:])|("(?:[^"\\]|\\.)*")|([^\s\[\]{},:"]+))')


def parse_deep(text: str):
    """JSON of any depth of nesting, by a stack of its own (the built-in reader's depth is limited); ValueError if malformed."""
    top: list = []
    stack: list = [(top, "value")]
    at, end = 0, len(text.rstrip())
    while at < end:
        m = MARK.match(text, at)
        if m is None:
            raise ValueError(f"no JSON at {at}")
        at = m.end()
        sign, holder, state = m.group(1), *stack[-1][:2]
        if sign in ("]", "}"):
            if len(stack) == 1 or isinstance(holder, list) != (sign == "]") or state not in ("first", "after"):
                raise ValueError(f"misplaced {sign} at {at}")
            stack.pop()
        elif sign == ",":
            if state != "after" or len(stack) == 1:
                raise ValueError(f"misplaced , at {at}")
            stack[-1] = (holder, "value" if isinstance(holder, list) else "name")
        elif sign == ":":
            if state != "colon":
                raise ValueError(f"misplaced : at {at}")
            stack[-1] = (holder, "value", stack[-1][2])
        elif isinstance(holder, dict) and state in ("first", "name"):
            if not m.group(2):
                raise ValueError(f"no name at {at}")
            stack[-1] = (holder, "colon", json.loads(m.group(2)))
        elif state in ("first", "value"):
            value = [] if sign == "[" else {} if sign == "{" else json.loads(m.group(2) or m.group(3))
            if isinstance(holder, list):
                holder.append(value)
            else:
                holder[stack[-1][2]] = value
            stack[-1] = (holder, "after")
            if sign:
                stack.append((value, "first"))
        else:
            raise ValueError(f"misplaced value at {at}")
    if len(stack) > 1 or len(top) != 1:
        raise ValueError("unfinished JSON")
    return top[0]


def load(text: str | None):
    """The value of JSON text, of JSON inside a JSON string at any depth of encoding; None where it can't be read."""
    while isinstance(text, str):
        try:
            text = json.loads(text)
        except RecursionError:
            try:
                text = parse_deep(text)
            except ValueError:
                return None
        except ValueError:
            return None
    return text


def kind_of(value) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, (int, float)):
        return "number"
    return "string" if isinstance(value, str) else "array" if isinstance(value, list) else "object"


def walk(value) -> Iterator[tuple[str, str | None, str, int, str | None, str, str | None]]:
    """(dewey, parent, schema path, ordinal, name, kind, leaf value) of all nodes below the root, depth first."""
    stack = [(value, "", "$")]
    while stack:
        node, label, path = stack.pop()
        if isinstance(node, dict):
            pairs = [(k, x, f"{path}.{k}") for k, x in node.items()]
        else:
            pairs = [(None, x, f"{path}[]") for x in node] if isinstance(node, list) else []
        below = []
        for n, (name, x, at) in enumerate(pairs):
            own = f"{label}.{n}" if label else str(n)
            kind = kind_of(x)
            leaf = None if kind in ("array", "object", "null") else x if kind == "string" else json.dumps(x)
            yield own, label or None, at, n, name, kind, leaf
            if kind in ("array", "object"):
                below.append((x, own, at))
        stack += reversed(below)


def dewey_nodes(rows: DataFrame, id_column: str, json_column: str) -> DataFrame:
    """All nodes of a JSON column, as ``NODE_SCHEMA``; one table for each value of ``schema_path``.

    A parent's label is the child's without its last ordinal; children of the root have a null parent. Null, empty
    and unreadable JSON give no rows; repeated rows of one id give their nodes once; other columns are ignored.
    """

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                out += [(key, *node) for node in walk(load(text))]
            yield _batch(out, NODE_SCHEMA)

    picked = rows.select(F.col(id_column).cast("long").alias("id"), F.col(json_column).alias("j")).where("j IS NOT NULL")
    return picked.mapInArrow(label, NODE_SCHEMA).dropDuplicates(["id", "dewey"])


#: What repeats in annotations: fields that hold lists, and fields that hold entries by name; where a list is expected, a
#: single object in ``SINGLE`` counts as its only entry.
LISTS, NAMED, SINGLE = ("value", "details"), ("answers",), ("value",)
#: Which table the nodes of a schema path belong to.
ENTRY_PATH = re.compile(r"\$\[\](\.value\[\])*")
FOLLOW_UP_PATH = re.compile(r"\$\[\](\.value\[\])+(\.details\[\]|\.answers\.\*)")


def repeated_nodes(record) -> Iterator[tuple[str, str, int, str | None, object]]:
    """(label, schema path, ordinal, name, value) of everything that repeats in a record, parents first.

    The label is a Dewey label over entries of lists and named entries: the fields of an object add no level of their
    own, and a node's named entries are numbered behind its list entries. Cutting the last ordinal gives the parent.
    """
    stack = [(str(n), "$[]", n, None, x) for n, x in enumerate(record)][::-1] if isinstance(record, list) else []
    while stack:
        node = stack.pop()
        yield node
        label, path, _, _, value = node
        if not isinstance(value, dict):
            continue
        below, at = [], 0
        for field in LISTS:
            held = value.get(field)
            if isinstance(held, dict) and field in SINGLE:
                held = [held]
            if isinstance(held, list):
                first = at if field not in SINGLE else 0
                below += [(f"{label}.{first + n}", f"{path}.{field}[]", n, None, x) for n, x in enumerate(held)]
                at = first + len(held) if field not in SINGLE else at
        for field in NAMED:
            held = value.get(field)
            if isinstance(held, dict):
                below += [(f"{label}.{at + n}", f"{path}.{field}.*", n, name, x) for n, (name, x) in enumerate(held.items())]
                at += len(held)
        stack += reversed(below)


def flatten(record, wanted: frozenset[str]) -> Iterator[tuple]:
    """(level, dewey, parent, task, item_pos, child, value) of one record's tasks, items and follow-ups.

    Nodes are grouped into tables by their schema path; each finds its parent's row, and through it the enclosing
    task, by cutting its own label. A node whose parent isn't in the table it must be in gives no row.
    """
    tables: dict[str, str] = {}
    tasks: dict[str, str | None] = {}
    items: dict[str, tuple[str | None, int]] = {}
    for label, path, n, name, value in repeated_nodes(record):
        table = tables.get(path)
        if table is None:
            table = tables[path] = "entry" if ENTRY_PATH.fullmatch(path) else "follow-up" if FOLLOW_UP_PATH.fullmatch(path) else ""
        parent = label.rpartition(".")[0]
        if table == "entry" and isinstance(value, dict) and "task" in value:
            if parent and parent not in tasks:
                continue
            said, task = value.get("value"), value["task"]
            tasks[label] = task = task if isinstance(task, str) or task is None else json.dumps(task)
            if "tasks" in wanted:
                plain = None if isinstance(said, (list, dict)) or said is None else said if isinstance(said, str) else json.dumps(said)
                yield "tasks", label, parent or None, task, n if parent else None, None, plain
        elif table == "entry" and parent in tasks and value is not None:
            items[label] = tasks[parent], n
            if "items" in wanted:
                yield "items", label, parent, tasks[parent], n, None, value if isinstance(value, str) else json.dumps(value)
        elif table == "follow-up" and parent in items and "follow_ups" in wanted:
            if name is None and not isinstance(value, dict):
                continue
            said = value.get("value") if name is None else value
            task, pos = items[parent]
            yield "follow_ups", label, parent, task, pos, str(n) if name is None else name, None if said is None else json.dumps(said)


def flat_tables(rows: DataFrame, levels: tuple[str, ...] = ("tasks", "items", "follow_ups"), keep_values: bool = True) -> DataFrame:
    """The tables of tasks, items and follow-ups of ``annotations`` (``id, annotations``), told apart by ``level``.

    Each row has its Dewey label, its parent's label, the innermost task, the position of the item in that task's
    value and, for follow-ups, ``child``: the position among ``details`` or the question's code. A combo's inner
    task has the combo as parent. Null entries count for positions but give no rows; null, empty or unreadable
    JSON, values of the wrong type and entries without ``task`` give none either; a single object in place of an
    array counts as its only entry. Rows that repeat an id give their rows once; other columns are ignored.
    """
    wanted = frozenset(levels)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                record = load(text)
                if isinstance(record, dict):
                    record = [record]
                out += [(key, *node) for node in flatten(record, wanted)]
            yield _batch(out, FLAT_SCHEMA, None if keep_values else "value")

    picked = rows.select(F.col("id").cast("long").alias("id"), F.col("annotations").alias("j")).where("j IS NOT NULL")
    return picked.mapInArrow(label, FLAT_SCHEMA).dropDuplicates(["id", "level", "dewey"])


def _batch(rows: list[tuple], schema: str, blank: str | None = None) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
    names, types = zip(*((n, kinds[t]) for n, t in (c.split() for c in schema.split(", "))), strict=True)
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays(
        [pa.nulls(len(c), t) if n == blank else pa.array(c, t) for c, n, t in zip(columns, names, types, strict=True)],
        names=list(names),
    )
