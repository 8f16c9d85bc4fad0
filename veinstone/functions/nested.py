"""JSON of any depth: the library's parser, and past the interpreter's limit one with an explicit stack."""

from __future__ import annotations

import json
import re
from json.decoder import scanstring

_SPACE = re.compile(r"[ \t\n\r]*")
_NUMBER = re.compile(r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?")
_WORD = re.compile(r"true|false|null|NaN|-?Infinity")
_WORDS = {"true": True, "false": False, "null": None}


def parse_json(text: str) -> object:
    """The value with its numbers as written; ValueError if the text is not whole JSON."""
    try:
        return json.loads(text, parse_int=str, parse_float=str, parse_constant=str)
    except RecursionError:
        return _deep(text)


def _deep(text: str) -> object:
    root: list = []
    stack: list = [root]
    keys: list = [None]
    at, state = 0, "value"
    while True:
        at = _SPACE.match(text, at).end()
        ch, top = text[at : at + 1], stack[-1]
        if state == "after" and len(stack) == 1:
            if ch:
                raise ValueError(f"more at {at}")
            return root[0]
        if state != "value" and len(stack) > 1 and state != "key" and ch == ("}" if isinstance(top, dict) else "]"):
            stack.pop()
            keys.pop()
            at, state = at + 1, "after"
            continue
        if state == "after":
            if ch != ",":
                raise ValueError(f"no comma at {at}")
            at, state = at + 1, "key" if isinstance(top, dict) else "value"
            continue
        if state == "key" or state == "first" and isinstance(top, dict):
            if ch != '"':
                raise ValueError(f"no name at {at}")
            keys[-1], at = scanstring(text, at + 1, True)
            at = _SPACE.match(text, at).end()
            if text[at : at + 1] != ":":
                raise ValueError(f"no colon at {at}")
            at, state = at + 1, "value"
            continue
        value: object
        if ch in ("{", "["):
            value, at = {} if ch == "{" else [], at + 1
        elif ch == '"':
            value, at = scanstring(text, at + 1, True)
        elif m := _WORD.match(text, at) or _NUMBER.match(text, at):
            value, at = _WORDS.get(m[0], m[0]), m.end()
        else:
            raise ValueError(f"no value at {at}")
        if isinstance(top, dict):
            top[keys[-1]] = value
        else:
            top.append(value)
        state = "after"
        if isinstance(value, (dict, list)):
            stack.append(value)
            keys.append(None)
            state = "first"
