"""Walks over nested text that regular expressions can't follow: JSON objects at any depth, and balanced braces. Each is one Arrow function from a column of texts to a column of arrays."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: A quoted string with its escapes (one that never ends goes on to the end of the text), or a brace.
_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*(?:"|\\?\Z)|\'(?:[^\'\\]|\\.)*(?:\'|\\?\Z)|[{}]', re.S)


def flat_objects(text: str | None, key: str) -> list[str]:
    """All objects of a JSON text, at any depth, that have ``key``: outer ones before inner ones, in the order of the text; each as JSON without its nested values. No JSON, no objects."""
    try:
        open_values = [json.loads(text)] if text else []
    except (ValueError, RecursionError):
        return []
    found = []
    while open_values:
        value = open_values.pop()
        if isinstance(value, dict):
            if key in value:
                found.append(json.dumps({k: v for k, v in value.items() if not isinstance(v, dict | list)}, ensure_ascii=False))
            open_values += reversed(value.values())
        elif isinstance(value, list):
            open_values += reversed(value)
    return found


def enclosing_objects(text: str | None, marker: str) -> list[str | None]:
    """For each place of ``marker`` the innermost object ``{...}`` around it, with braces inside quoted strings left out of account; null where none is open there, or it is never closed."""
    if not text:
        return []
    places, at = [], text.find(marker)
    while at >= 0:
        places.append(at)
        at = text.find(marker, at + len(marker))
    if not places:
        return []
    starts, stack, ends, k = [], [], {}, 0
    for token in _TOKEN.finditer(text):
        while k < len(places) and places[k] <= token.start():
            starts.append(stack[-1] if stack else None)
            k += 1
        if token[0] == "{":
            stack.append(token.start())
        elif token[0] == "}" and stack:
            ends[stack.pop()] = token.end()
    starts += [stack[-1] if stack else None] * (len(places) - len(starts))
    return [text[s : ends[s]] if s in ends else None for s in starts]


def objects_with(text: Column, key: str) -> Column:
    """``flat_objects`` of a column: an array of JSON texts, empty for a null."""
    return F.pandas_udf(lambda texts: pd.Series([flat_objects(t, key) for t in texts]), "array<string>")(text)


def objects_around(text: Column, marker: str) -> Column:
    """``enclosing_objects`` of a column: an array with a text or null for each place of the marker, empty for a null."""
    return F.pandas_udf(lambda texts: pd.Series([enclosing_objects(t, marker) for t in texts]), "array<string>")(text)
