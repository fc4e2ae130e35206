"""Deeply nested JSON records as path-value-ordinal triples and flat tables."""

from __future__ import annotations

import re
from collections.abc import Iterator
from json.decoder import scanstring

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BLANK = re.compile(r"[ \t\n\r]*")
_SCALAR = re.compile(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][-+]?\d+)?|true|false|null")
_AROUND = " \t\n\r\x0b\x0c\x85\xa0  ﻿"


class Broken(ValueError):
    """The text is not one complete JSON object."""


def triples(text: str, repeated: frozenset[str], wanted: re.Pattern[str] | None = None) -> list[tuple[str, list[int], str, str | None]]:
    """(path, ordinals, type, value) of the objects and scalars of one JSON object, in document order.

    A path names the fields from the top, ``[]`` after each that repeats; ordinals are the places, from 0, in those
    lists. Below a field of ``repeated`` one object in place of a list is a list of one; null elements keep their
    place and yield nothing. ``wanted`` keeps only matching paths. One pass with an explicit stack: memory follows
    the depth and what is kept, and no depth is too deep. Byte-order marks and white space around are ignored; text
    that holds JSON text is read through. Raises Broken for anything else than one complete object.
    """
    s = text.strip(_AROUND)
    while s[:1] == '"':
        try:
            s, end = _string_around(s)
        except ValueError as e:
            raise Broken from e
        s = s.strip(_AROUND)
    if s[:1] != "{":
        raise Broken
    out: list[tuple[str, list[int], str, str | None]] = []
    keep: dict[str, bool] = {}
    names: dict[tuple[str, str], str] = {}
    ords: list[int] = []
    # a frame: [is list, path, counts an ordinal, place in the list]
    stack: list[list] = []
    blank, n, i = _BLANK.match, len(s), 0
    path, state = "", "value"

    def emit(p: str, kind: str, value: str | None) -> None:
        k = keep.get(p)
        if k is None:
            k = keep[p] = wanted is None or wanted.fullmatch(p) is not None
        if k:
            out.append((p, ords.copy(), kind, value))

    try:
        while True:
            i = blank(s, i).end()
            c = s[i]
            if state == "value":
                if c == "{":
                    one = not (stack and stack[-1][0]) and path.rpartition(".")[2] in repeated and bool(stack)
                    if one:
                        path += "[]"
                        ords.append(0)
                    emit(path, "object", None)
                    stack.append([False, path, one, 0])
                    i, state = i + 1, "first"
                    continue
                if c == "[":
                    path += "[]"
                    ords.append(0)
                    stack.append([True, path, True, 0])
                    i = blank(s, i + 1).end()
                    if s[i] == "]":
                        state = "close"
                    continue
                if c == '"':
                    value, i = scanstring(s, i + 1, True)
                    emit(path, "string", value)
                else:
                    m = _SCALAR.match(s, i)
                    if not m:
                        raise Broken
                    i, value = m.end(), m.group()
                    if value != "null":
                        emit(path, "boolean" if value in ("true", "false") else "number", value)
                state = "after"
                continue
            top = stack[-1]
            if state == "after":
                if c == ",":
                    i += 1
                    if top[0]:
                        top[3] += 1
                        ords[-1] = top[3]
                        path, state = top[1], "value"
                    else:
                        state = "key"
                    continue
                state = "close"
            if state == "first":
                state = "close" if c == "}" else "key"
            if state == "key":
                if c != '"':
                    raise Broken
                key, i = scanstring(s, i + 1, True)
                i = blank(s, i).end()
                if s[i] != ":":
                    raise Broken
                i += 1
                at = (top[1], key)
                path = names.get(at) or names.setdefault(at, f"{top[1]}.{_escape(key)}")
                state = "value"
                continue
            if c != ("]" if top[0] else "}"):
                raise Broken
            i += 1
            stack.pop()
            if top[2]:
                ords.pop()
            if not stack:
                if blank(s, i).end() != n:
                    raise Broken
                return out
            state = "after"
    except (IndexError, ValueError) as e:
        raise Broken from e


def _escape(key: str) -> str:
    """Field names cannot be taken for the marks of a path."""
    return key.replace("~", "~0").replace(".", "~1").replace("[", "~2")


def _string_around(s: str) -> tuple[str, int]:
    value, end = scanstring(s, 1, True)
    if _BLANK.match(s, end).end() != len(s):
        raise Broken
    return value, end


def shred(records: DataFrame, *, key: str, payload: str, keep: list[str], repeated: list[str], paths: str | None = None) -> DataFrame:
    """Rows (``key``, ``keep``, ``path``, ``ords``, ``seq``, ``vtype``, ``value``): the triples of every record.

    Records that are not one complete JSON object, are null or empty yield nothing. ``paths`` is a regular expression
    that whole paths must match; only those leave the Python worker. Arrow batches in and out, one pass, no shuffle.
    """
    fields, wanted = frozenset(repeated), re.compile(paths) if paths else None
    src = records.select(F.col(key), *keep, F.col(payload).alias("_payload"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1])
    names = src.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):  # the triples of a batch must fit beside it
                part = batch.slice(start, 512)
                at, path, ords, seq, kind, value = [], [], [], [], [], []
                for row, text in enumerate(part.column(part.num_columns - 1).to_pylist()):
                    if not text:
                        continue
                    try:
                        found = triples(text, fields, wanted)
                    except Broken:
                        continue
                    for j, (p, o, k, v) in enumerate(found):
                        at.append(row), path.append(p), ords.append(o), seq.append(j), kind.append(k), value.append(v)
                take = pa.array(at, pa.int64())
                cols = [part.column(c).take(take) for c in range(len(names))]
                new = [pa.array(path, pa.string()), pa.array(ords, pa.list_(pa.int32())), pa.array(seq, pa.int32()), pa.array(kind, pa.string()), pa.array(value, pa.string())]
                yield pa.RecordBatch.from_arrays([*cols, *new], [*names, "path", "ords", "seq", "vtype", "value"])

    return src.mapInArrow(run, f"{schema}, path string, ords array<int>, seq int, vtype string, value string")


def instances(t: DataFrame, keys: list[str], ancestor: Column, attributes: dict[str, str]) -> DataFrame:
    """One flat table: the triples of one repeated ancestor pivoted to a row for each of its objects.

    ``ancestor`` is the path of the object that a triple belongs to; ``attributes`` maps column names to field paths
    below it. A field that is written twice in one object has its last value. Columns: ``keys``, ``ancestor``,
    ``ords`` (places of the object and of all that hold it) and the attributes.
    """
    field = F.expr("substr(path, length(ancestor) + 2)")
    aggs = [F.max(F.when(field == name, F.struct("seq", "value"))).alias(a) for a, name in attributes.items()]
    g = t.withColumn("ancestor", ancestor).groupBy(*keys, "ancestor", "ords").agg(F.count(F.lit(1)).alias("_n"), *aggs)
    return g.select(*keys, "ancestor", "ords", *[F.col(f"{a}.value").alias(a) for a in attributes])
