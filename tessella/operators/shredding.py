"""Deeply nested JSON records as related flat tables.

Columnar shredding: every record becomes column chunks, one per path, each a
sequence of (repetition level, definition level, value).  A path names members
only; ``[]`` after a member marks a repetition.  Tables are put together again
per repeated ancestor from the level sequences alone: a repetition level of r
advances the position at depth r and resets those below it.

Defined cases: null, blank or unreadable text gives no rows; a string that is
itself the JSON text of an object or array counts as what it encodes, at any
depth, the record included; an object in place of a member listed in
``ALWAYS_LISTS`` is its element 0; elements that are no objects are not listed
but keep their position; of a repeated member name the last counts;
``NaN`` and ``Infinity`` are no JSON; records of any depth are read whole.  Records need no common schema; a path
first met late in a record is filled up with the levels of its parent so far.
"""

from __future__ import annotations

import json
import re
import sys
from collections.abc import Callable, Iterator
from json.decoder import scanstring

import pyarrow as pa
from pyspark.sql import DataFrame

from tessella.plans.durable import spread

#: Members that are arrays by contract (fixed values of the record format).
ALWAYS_LISTS = frozenset(("stages", "entities", "intents", "slots", "steps", "calls", "results", "signals", "metrics", "parts"))

_BAD = object()
#: Marks a repetition within a path; shown as ``[]``.
_REP = "\x00"


def _no_constant(name: str):
    raise ValueError(name)


_DECODER = json.JSONDecoder(parse_constant=_no_constant)


def decode(text: str | None):
    """The JSON value of a text, or _BAD."""
    if text is None:
        return _BAD
    try:
        return _DECODER.decode(text.lstrip("﻿"))
    except ValueError:
        return _BAD
    except RecursionError:
        return decode_deep(text.lstrip("﻿"))


_SPACE = re.compile(r"[ \t\n\r]*")
_NUMBER = re.compile(r"-?(?:0|[1-9]\d*)(\.\d+)?([eE][-+]?\d+)?", re.A)
_WORDS = {"true": True, "false": False, "null": None}


def decode_deep(text: str):
    """The JSON value of a text nested to any depth, by a list of open containers instead of calls."""
    at, end = _SPACE.match(text, 0).end(), len(text)
    #: Open containers; an object's next member name stands beside it.
    held: list = []
    names: list = []
    try:
        while True:
            ch = text[at]
            closed = False
            if ch in "{[":
                held.append({} if ch == "{" else [])
                names.append(None)
                at = _SPACE.match(text, at + 1).end()
                if text[at] != ("}" if ch == "{" else "]"):
                    if ch == "{":
                        at = _member_name(text, at, names)
                    continue
                at, closed = at + 1, True
            elif ch == '"':
                value, at = scanstring(text, at + 1, True)
            else:
                m = _NUMBER.match(text, at)
                if m:
                    value, at = (float if m[1] or m[2] else int)(m[0]), m.end()
                else:
                    word = next((w for w in _WORDS if text.startswith(w, at)), None)
                    if word is None:
                        return _BAD
                    value, at = _WORDS[word], at + len(word)
            # the value goes into what is open around it, which may close with it
            while True:
                if closed:
                    value = held.pop()
                    names.pop()
                at = _SPACE.match(text, at).end()
                if not held:
                    return value if at == end else _BAD
                around = held[-1]
                if isinstance(around, dict):
                    around[names[-1]] = value
                else:
                    around.append(value)
                if text[at] == ",":
                    at = _SPACE.match(text, at + 1).end()
                    if isinstance(around, dict):
                        at = _member_name(text, at, names)
                    break
                if text[at] != ("}" if isinstance(around, dict) else "]"):
                    return _BAD
                at, closed = at + 1, True
    except (ValueError, IndexError):
        return _BAD


def _member_name(text: str, at: int, names: list) -> int:
    """Reads ``"name" :`` into the last of ``names``; where the value begins."""
    if text[at] != '"':
        raise ValueError(at)
    names[-1], at = scanstring(text, at + 1, True)
    at = _SPACE.match(text, at).end()
    if text[at] != ":":
        raise ValueError(at)
    return _SPACE.match(text, at + 1).end()


def _at_any_depth(text: str, walk: Callable[[], None]) -> None:
    """Runs a walk over a record; the calls it may nest grow with the record's brackets only where it takes that many."""
    try:
        walk()
    except RecursionError:
        was = sys.getrecursionlimit()
        sys.setrecursionlimit(was + 8 * (text.count("{") + text.count("[")))
        try:
            walk()
        finally:
            sys.setrecursionlimit(was)


def _open(value):
    """A string that is the JSON text of an object or array as what it encodes."""
    while isinstance(value, str):
        s = value.strip()
        if len(s) < 2 or s[0] not in '{["' or s[-1] not in '}]"':
            return value
        inner = decode(s)
        if inner is _BAD or not isinstance(inner, (dict, list, str)):
            return value
        if isinstance(inner, str):
            # text of a text counts only if an object or array is inside
            deep = _open(inner)
            return deep if isinstance(deep, (dict, list)) else value
        return inner
    return value


class Chunk:
    """One path's column chunk; ``rep_max`` is the number of repetitions on the path."""

    __slots__ = ("path", "rep_max", "def_max", "rep", "dfn", "val", "kids", "repeated")

    def __init__(self, path: str, rep_max: int, def_max: int, repeated: bool):
        self.path, self.rep_max, self.def_max, self.repeated = path, rep_max, def_max, repeated
        self.rep: list[int] = []
        self.dfn: list[int] = []
        self.val: list = []
        self.kids: dict[str, Chunk] = {}


class _OBJECT:
    """The value of a level that holds an object; a class, so that it stays itself when a task is shipped."""


class _ARRAY:
    """The value of a level that holds an array right inside an array, or the one at the top."""


def _kid(node: Chunk, name: str, repeated: bool, n_before: int) -> Chunk:
    key = name + _REP if repeated else name
    kid = node.kids.get(key)
    if kid is None:
        # an array right inside an array, or at the top, has no member name
        shown = name.replace(_REP, "")
        path = node.path + ("." if shown and node.path else "") + shown + (_REP if repeated else "")
        kid = Chunk(path, node.rep_max + repeated, node.def_max + 1, repeated)
        # the elements of the parent before this one had nothing here
        kid.rep = node.rep[:n_before]
        kid.dfn = node.dfn[:n_before]
        kid.val = [None] * n_before
        node.kids[key] = kid
    return kid


def _absent(node: Chunk, rep: int, dfn: int) -> None:
    """Levels of a missing member, for it and all paths below."""
    node.rep.append(rep)
    node.dfn.append(dfn)
    node.val.append(None)
    for kid in node.kids.values():
        _absent(kid, rep, dfn)


def _put(node: Chunk, value, rep: int, leaves: bool) -> None:
    """Append one value at ``node``, whose path is defined down to it.  ``leaves`` False prunes the columns of scalar members."""
    n_before = len(node.rep)
    node.rep.append(rep)
    node.dfn.append(node.def_max)
    if isinstance(value, dict):
        node.val.append(_OBJECT)
        seen = set()
        for name, member in value.items():
            if leaves or (member.__class__ in _NESTED and (member.__class__ is not str or member[:1] in _OPENERS)):
                seen.add(_member(node, name, member, rep, n_before, leaves))
    elif isinstance(value, list):
        node.val.append(_ARRAY)
        seen = {_list(node, "", value, rep, n_before, leaves)}
    else:
        node.val.append(value)
        seen = set()
    if len(seen) < len(node.kids):
        for key, kid in node.kids.items():
            if key not in seen:
                _absent(kid, rep, node.def_max)


#: What may hold an object or array; a text does if it begins like JSON.
_NESTED = frozenset((dict, list, str))
_OPENERS = frozenset('{["\t\n\r \x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0')


def _member(node: Chunk, name: str, member, rep: int, n_before: int, leaves: bool) -> str:
    member = _open(member)
    if isinstance(member, dict) and name in ALWAYS_LISTS:
        member = [member]
    if isinstance(member, list):
        return _list(node, name, member, rep, n_before, leaves)
    kid = _kid(node, name, False, n_before)
    if member is None:
        _absent(kid, rep, node.def_max)
    else:
        _put(kid, member, rep, leaves)
    return name


def _list(node: Chunk, name: str, items: list, rep: int, n_before: int, leaves: bool) -> str:
    kid = _kid(node, name, True, n_before)
    if not items:
        _absent(kid, rep, node.def_max)
    first = True
    for item in items:
        _put(kid, _open(item), rep if first else kid.rep_max, leaves)
        first = False
    return name + _REP


def shred(text: str | None, leaves: bool = True) -> list[Chunk]:
    """The column chunks of one record, parents before children; none for an unreadable record."""
    value = decode(text)
    if value is _BAD:
        return []
    value = _open(value)
    if not isinstance(value, (dict, list)):
        return []
    root = Chunk("", 0, 0, False)

    def walk() -> None:
        nonlocal root
        root = Chunk("", 0, 0, False)
        _put(root, value, 0, leaves)

    _at_any_depth(text, walk)
    out, todo = [], [root]
    while todo:
        chunk = todo.pop()
        out.append(chunk)
        todo.extend(chunk.kids.values())
    return out


def positions(chunk: Chunk) -> Iterator[tuple[int, tuple[int, ...]]]:
    """(entry number, positions by depth) of the defined entries of a chunk, from its levels alone."""
    at = [-1] * chunk.rep_max
    for i, (r, d) in enumerate(zip(chunk.rep, chunk.dfn)):
        if r == 0:
            at = [0] * chunk.rep_max
        else:
            at[r - 1] += 1
            for k in range(r, chunk.rep_max):
                at[k] = 0
        if d == chunk.def_max:
            yield i, tuple(at)


def _render(path: str, at: tuple[int, ...]) -> str:
    parts = path.split(_REP)
    return "".join(p + (f"[{at[k]}]" if k < len(parts) - 1 else "") for k, p in enumerate(parts))


def _places(chunks: list[Chunk]) -> Iterator[tuple[str, tuple[int, ...], tuple[str, tuple[int, ...]]]]:
    """(path, positions, parent's path and positions) of every object that is an array's element; the root is ("", ())."""
    listed: set = set()
    for chunk in sorted((c for c in chunks if c.repeated), key=lambda c: c.rep_max):
        for i, at in positions(chunk):
            if chunk.val[i] is _OBJECT:
                parent = _owner(chunk.path, at, chunk.rep_max - 1, listed)
                listed.add((chunk.path, at))
                yield chunk.path, at, parent


def _owner(path: str, at: tuple[int, ...], depth: int, listed) -> tuple[str, tuple[int, ...]]:
    """The deepest listed object on a path within its first ``depth`` repetitions."""
    ends = [i + 1 for i, ch in enumerate(path) if ch == _REP]
    for d in range(depth, 0, -1):
        key = (path[: ends[d - 1]], at[:d])
        if key in listed:
            return key
    return "", ()


def objects(chunks: list[Chunk]) -> list[tuple[str, str, str]]:
    """(obj_path, parent_path, table) of every object that is an array's element, from the level sequences.

    ``table`` is the repeated path without positions: one flat table each.
    """
    return [(_render(path, at), _render(*parent), path.replace(_REP, "[]")) for path, at, parent in _places(chunks)]


def values(chunks: list[Chunk], listed) -> dict[tuple[str, tuple[int, ...]], list[tuple[str, str]]]:
    """Every scalar of a record as (name, JSON text), by the listed object around it or the root, from the level sequences.

    The name is the path from that object on, with positions: ``ms``, ``request.client.build``, ``span[0]``.
    A path may hold scalars in one place and objects or arrays in another.  A null is a value as an element, not as a member.
    """
    own: dict[tuple[str, tuple[int, ...]], list[tuple[str, str]]] = {}
    for c in chunks:
        for i, at in positions(c):
            v = c.val[i]
            if v is _OBJECT or v is _ARRAY:
                continue
            key = _owner(c.path, at, c.rep_max, listed)
            name = _render(c.path[len(key[0]) :], at[len(key[1]) :])
            own.setdefault(key, []).append((name.removeprefix(".") if key[0] else name, json.dumps(v, ensure_ascii=False)))
    return own


_LEVELS = "trace_id bigint, path string, rep_max int, def_max int, rep array<int>, dfn array<int>, val array<string>"


def column_chunks(df: DataFrame, id_col: str = "id", json_col: str = "trace") -> DataFrame:
    """trace_id, path, rep_max, def_max, rep, dfn, val: the shredded form, a row per record and path that holds scalars or ends there; values as JSON text."""

    def run(batches):
        for b in batches:
            out = {k: [] for k in ("trace_id", "path", "rep_max", "def_max", "rep", "dfn", "val")}
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for c in shred(text):
                    # a path may hold scalars in one place and objects or arrays in another
                    if c.kids and all(d < c.def_max or v is _OBJECT or v is _ARRAY for d, v in zip(c.dfn, c.val)):
                        continue
                    for name, v in (("trace_id", key), ("path", c.path.replace(_REP, "[]")), ("rep_max", c.rep_max), ("def_max", c.def_max), ("rep", c.rep), ("dfn", c.dfn)):
                        out[name].append(v)
                    out["val"].append([None if d < c.def_max else "{}" if v is _OBJECT else "[]" if v is _ARRAY else json.dumps(v, ensure_ascii=False) for d, v in zip(c.dfn, c.val)])
            i32 = pa.int32()
            yield pa.RecordBatch.from_arrays(
                [pa.array(out["trace_id"], pa.int64()), pa.array(out["path"], pa.string()), pa.array(out["rep_max"], i32), pa.array(out["def_max"], i32), pa.array(out["rep"], pa.list_(i32)), pa.array(out["dfn"], pa.list_(i32)), pa.array(out["val"], pa.list_(pa.string()))],
                names=list(out),
            )

    return spread(df.select(id_col, json_col)).mapInArrow(run, _LEVELS)


def object_rows(df: DataFrame, id_col: str = "id", json_col: str = "trace", roots: bool = False) -> DataFrame:
    """trace_id, obj_path, parent_path, obj_table, fields: a row per array element that is an object.

    ``roots`` adds a row per readable record for the record itself: obj_path and obj_table ``''``, parent_path null.  ``fields``
    maps the scalars that belong to no listed object further in, by their path from this one on, to their JSON text (see
    ``values``); with ``roots`` no scalar of a record is left out.  One pass, no shuffle.
    """

    def run(batches):
        for b in batches:
            ids, paths, parents, tables, fields = [], [], [], [], []
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                chunks = shred(text)
                if not chunks:
                    continue
                places = list(_places(chunks))
                own = values(chunks, {(path, at) for path, at, _ in places})
                for path, at, parent in ([("", (), None)] if roots else []) + places:
                    ids.append(key)
                    paths.append(_render(path, at))
                    parents.append(None if parent is None else _render(*parent))
                    tables.append(path.replace(_REP, "[]"))
                    fields.append(own.get((path, at), []))
            s = pa.string()
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(paths, s), pa.array(parents, s), pa.array(tables, s), pa.array(fields, pa.map_(s, s))], names=["trace_id", "obj_path", "parent_path", "obj_table", "fields"])

    return spread(df.select(id_col, json_col)).mapInArrow(run, "trace_id bigint, obj_path string, parent_path string, obj_table string, fields map<string,string>")


def object_links(df: DataFrame, id_col: str = "id", json_col: str = "trace") -> DataFrame:
    """trace_id, obj_path, parent_path only: the parent-child links without the values."""

    def run(batches):
        for b in batches:
            ids, paths, parents = [], [], []
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for path, parent, _ in objects(shred(text, leaves=False)):
                    ids.append(key)
                    paths.append(path)
                    parents.append(parent)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(paths, pa.string()), pa.array(parents, pa.string())], names=["trace_id", "obj_path", "parent_path"])

    return spread(df.select(id_col, json_col)).mapInArrow(run, "trace_id bigint, obj_path string, parent_path string")
