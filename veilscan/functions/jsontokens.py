"""One pass over the tokens of a JSON text with an explicit path stack.

For documents nested deeper than a JSON parser or a fixed projection goes: no
recursion, so depth is bounded by the text alone. Comments and trailing commas
are tolerated like ``tolerant_parse`` does, and of a repeated key the last value
counts.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

TOKEN = re.compile(r'[ \t\r\n]*(?:([{}\[\]:,])|("(?:[^"\\\x00-\x1f]|\\["\\/bfnrt]|\\u[0-9a-fA-F]{4})*")|(-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null))')
SPACE = re.compile(r"[ \t\r\n]*\Z")
#: (pattern, replacement) of the tolerant reading, in turn.
CLEANING = [(re.compile(r"/\*[\s\S]*?\*/"), ""), (re.compile(r"(^|[^:])//.*$", re.M), r"\1"), (re.compile(r",(\s*[}\]])"), r"\1")]

Step = str | int


def split(text: str) -> list[str] | None:
    """Tokens of the text, None if something is no token."""
    out, at = [], 0
    while found := TOKEN.match(text, at):
        out.append(found[found.lastindex])
        at = found.end()
    return out if SPACE.match(text, at) else None


def superseded(tokens: list[str]) -> dict[int, int] | None:
    """{first token: token after it} of the members that a later equal key replaces; None if the tokens are no object or array."""
    dead: dict[int, int] = {}
    stack: list[dict | None] = []  # an object's members so far, None for an array
    starts: list[tuple[str, int]] = []  # key and first token of the open member of each open object
    want = "value"
    for at, token in enumerate(tokens):
        if want == "done":
            return None
        if want in ("value", "first") and not (want == "first" and token == "]"):
            if token in "{[":
                stack.append({} if token == "{" else None)
                starts.append(("", at))
                want = "key or end" if token == "{" else "first"
                continue
            if token in "}]:,":
                return None
        elif want in ("key", "key or end") and token[0] == '"':
            starts[-1] = (json.loads(token), at)
            want = "colon"
            continue
        elif want == "colon" and token == ":":
            want = "value"
            continue
        elif want == "next" and token == ",":
            want = "value" if stack[-1] is None else "key"
            continue
        elif (token == "}" and want in ("next", "key or end") and stack[-1] is not None) or (token == "]" and want in ("next", "first") and stack[-1] is None):
            stack.pop()
            starts.pop()
        else:
            return None
        # a value has ended
        if not stack:
            if token not in "}]":
                return None  # a lone scalar is no document
            want = "done"
            continue
        if stack[-1] is not None:
            key, start = starts[-1]
            if key in stack[-1]:
                dead[stack[-1][key][0]] = stack[-1][key][1]
            stack[-1][key] = (start, at + 1)
        want = "next"
    return dead if want == "done" else None


def strings(tokens: list[str], dead: dict[int, int]) -> Iterator[tuple[list[Step], str, bool]]:
    """(path, text, is key) of every string value and object key; the path list is the walk's own and changes."""
    path: list[Step] = []
    kinds: list[str] = []
    at, key_next = 0, False
    while at < len(tokens):
        token = tokens[at]
        if key_next and at in dead:
            at = dead[at]
            if tokens[at] == ",":
                at += 1
            else:
                key_next = False
            continue
        if token in "{[":
            kinds.append(token)
            path.append("" if token == "{" else 0)
            key_next = token == "{" and tokens[at + 1] != "}"
        elif token in "}]":
            kinds.pop()
            path.pop()
            key_next = False
        elif token == ",":
            if kinds[-1] == "[":
                path[-1] += 1
            else:
                key_next = True
        elif token[0] == '"':
            text = json.loads(token)
            if key_next:
                yield path[:-1], text, True
                path[-1] = text
                key_next = False
            else:
                yield path, text, False
        at += 1


def shown(path: list[Step]) -> str:
    return "".join(f"[{s}]" if isinstance(s, int) else f".{s}" for s in path)


def tool_place(path: list[Step]) -> tuple[int, str, int, int] | None:
    """(rank, server, number, steps) of the tool that a path leads into."""
    if len(path) >= 4 and path[0] in ("mcpServers", "servers") and isinstance(path[1], str) and path[2] == "tools" and isinstance(path[3], int):
        return (0 if path[0] == "mcpServers" else 1), path[1], path[3], 4
    if len(path) >= 2 and path[0] == "tools" and isinstance(path[1], int):
        return 2, "", path[1], 2
    return None


def is_config(path: list[Step]) -> bool:
    if len(path) < 3 or path[0] not in ("mcpServers", "servers") or not isinstance(path[1], str):
        return False
    return (len(path) == 3 and path[2] in ("command", "url")) or (len(path) == 4 and (path[2] == "args" and isinstance(path[3], int) or path[2] == "env" and isinstance(path[3], str)))


def entries(raw: str) -> Iterator[tuple[str, str | None, str, bool, int]]:
    """(kind, path, text, is key, count) of what there is to check in a tool document.

    Kinds: ``tool`` (a string of a tool), ``config`` (a configuration value), ``shadow``
    (a tool name defined ``count`` times, its places as path), ``raw`` (no document).
    """
    tokens = split(raw)
    dead = None if tokens is None else superseded(tokens)
    if dead is None:
        clean = raw
        for pattern, by in CLEANING:
            clean = pattern.sub(by, clean)
        tokens = split(clean)
        dead = None if tokens is None else superseded(tokens)
    if dead is None:
        yield "raw", None, raw, False, 0
        return
    names: dict[str, list[tuple[int, str, int]]] = {}
    for path, text, is_key in strings(tokens, dead):
        place = tool_place(path)
        if place:
            rank, server, number, steps = place
            base = f"tools[{number}]" if rank == 2 else f"mcpServers.{server}.tools[{number}]"
            yield "tool", base + shown(path[steps:]), text, is_key, 0
            if not is_key and text and path[steps:] == ["name"]:
                names.setdefault(text, []).append((rank, server, number))
        elif not is_key and is_config(path):
            yield "config", shown(path[1:])[1:], text, False, 0
    for name, places in names.items():
        if len(places) > 1:
            yield "shadow", ", ".join(f"tools[{n}]" if rank == 2 else f"{server}.tools[{n}]" for rank, server, n in sorted(places)), name, False, len(places)
