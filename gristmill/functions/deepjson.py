"""JSON that nests deeper than the standard reader goes."""

from __future__ import annotations

import json
import re

TOKEN = re.compile(r'[ \t\n\r]*(?:([{}\[\]:,])|("(?:[^"\\]|\\.)*")|([^\s{}\[\]:,"]+))', re.S)
_DECODER = json.JSONDecoder()


def read_value(text: str, at: int = 0) -> tuple[object, int]:
    """The value that begins at ``at`` and where it ends; ValueError if there is none. Nesting has no bound."""
    while at < len(text) and text[at] in " \t\n\r":
        at += 1
    try:
        return _DECODER.raw_decode(text, at)
    except RecursionError:
        return _read_deep(text, at)


def read(text: str) -> object:
    """The only value of a text."""
    value, end = read_value(text)
    if text[end:].strip(" \t\n\r"):
        raise ValueError("more than one value")
    return value


def _read_deep(text: str, at: int) -> tuple[object, int]:
    open_: list = []
    keys: list[str] = []
    expect = "value"
    while True:
        found = TOKEN.match(text, at)
        if not found:
            raise ValueError(f"no JSON at {at}")
        at = found.end()
        mark, string, word = found.groups()
        if expect == "colon" and mark == ":":
            expect = "value"
            continue
        if expect in ("key", "first key") and string:
            keys.append(json.loads(string))
            expect = "colon"
            continue
        if expect in ("value", "first value") and mark and mark in "{[":
            open_.append({} if mark == "{" else [])
            expect = "first key" if mark == "{" else "first value"
            continue
        if expect == "next" and mark == ",":
            expect = "key" if isinstance(open_[-1], dict) else "value"
            continue
        if expect in ("value", "first value") and (string or word):
            value = json.loads(string or word)
        elif open_ and expect in ("next", "first key", "first value") and mark == ("}" if isinstance(open_[-1], dict) else "]"):
            value = open_.pop()
        else:
            raise ValueError(f"no JSON at {at}")
        if not open_:
            return value, at
        if isinstance(open_[-1], dict):
            open_[-1][keys.pop()] = value
        else:
            open_[-1].append(value)
        expect = "next"
