import json

from hypothesis import given, settings
from hypothesis import strategies as st

from tessella.operators.shredding import ALWAYS_LISTS, decode, decode_deep, _places, _render, column_chunks, object_links, object_rows, objects, shred, values


def brute(value, path="", parent="", out=None):
    def opened(x):
        while isinstance(x, str):
            try:
                y = json.loads(x)
            except ValueError:
                return x
            if isinstance(y, (dict, list)):
                return y
            if not isinstance(y, str):
                return x
            x = y
        return x

    value = opened(value)
    if isinstance(value, dict):
        for k, x in value.items():
            x = opened(x)
            if k in ALWAYS_LISTS and isinstance(x, dict):
                x = [x]
            brute(x, f"{path}.{k}" if path else k, parent, out)
    elif isinstance(value, list):
        for i, x in enumerate(value):
            p, x = f"{path}[{i}]", opened(x)
            if isinstance(x, dict):
                out.append((p, parent))
                brute(x, p, p, out)
            else:
                brute(x, p, parent, out)
    return out


leaf = st.one_of(st.none(), st.booleans(), st.integers(-9, 9), st.text("ab", max_size=3))
name = st.sampled_from(["stages", "steps", "a", "b", "parts"])
tree = st.recursive(leaf, lambda t: st.one_of(st.lists(t, max_size=3), st.dictionaries(name, t, max_size=3), st.dictionaries(name, t, max_size=2).map(json.dumps)), max_leaves=20)


@settings(max_examples=400, deadline=None)
@given(tree)
def test_links_match_a_plain_walk(value):
    text = json.dumps(value)
    want = sorted(brute(value, out=[])) if isinstance(value, (dict, list, str)) else []
    for leaves in (True, False):
        assert sorted(x[:2] for x in objects(shred(text, leaves))) == want


def test_levels_of_optional_and_repeated_members():
    chunks = {c.path.replace("\x00", "[]"): c for c in shred('{"s":[{"x":1},{"t":[{"x":2},{"x":3}]},{"t":[]}]}')}
    c = chunks["s[].t[].x"]
    assert (c.rep_max, c.rep, c.dfn) == (2, [0, 1, 2, 1], [1, 3 + 0, 3, 1][:1] + [3, 3, 1])
    assert chunks["s[].x"].val == [1, None, None]


def test_unreadable_and_odd_records():
    for bad in (None, "", "  ", "{", "{'a': 1}", '{"a": NaN}', "nope", "[" * 5000 + "]" * 5000):
        assert objects(shred(bad)) == [] or bad[:2] == "[["
    assert [x[:2] for x in objects(shred('"{\\"steps\\": {\\"n\\": 1}}"'))] == [("steps[0]", "")]
    assert [x[:2] for x in objects(shred('[[{"a":1}],2,{"b":[3]}]'))] == [("[2]", ""), ("[0][0]", "")]
    assert [x[:2] for x in objects(shred('{"a[]":[{"b.c":[{}]}]}'))] == [("a[][0]", ""), ("a[][0].b.c[0]", "a[][0]")]


def test_tables(spark):
    rows = [(1, '{"stages":[{"name":"x","ms":3,"steps":[{"n":1}]}]}', "k"), (2, None, "k"), (3, "{}", "k")]
    df = spark.createDataFrame(rows, "id bigint, trace string, path string")
    got = {(r.trace_id, r.obj_path, r.parent_path, r.obj_table, tuple(sorted(r.fields.items()))) for r in object_rows(df).collect()}
    assert got == {(1, "stages[0]", "", "stages[]", (("ms", "3"), ("name", '"x"'))), (1, "stages[0].steps[0]", "stages[0]", "stages[].steps[]", (("n", "1"),))}
    assert {(r.path, tuple(r.rep), tuple(r.dfn), tuple(r.val)) for r in column_chunks(df).where("trace_id = 1").collect()} == {
        ("stages[].name", (0,), (2,), ('"x"',)), ("stages[].ms", (0,), (2,), ("3",)), ("stages[].steps[].n", (0,), (3,), ("1",))
    }
    assert object_links(df.limit(0)).collect() == []


def scalars(value, path="", out=None):
    """Path and JSON text of every scalar, by a plain walk; null members are left out."""
    value = opened(value)
    for k, x in value.items() if isinstance(value, dict) else enumerate(value):
        x = opened(x)
        p = f"{path}[{k}]" if isinstance(value, list) else f"{path}.{k}" if path else k
        if isinstance(value, dict) and k in ALWAYS_LISTS and isinstance(x, dict):
            x = [x]
        if isinstance(x, (dict, list)):
            scalars(x, p, out)
        elif x is not None or isinstance(value, list):
            out.append((p, json.dumps(x)))
    return out


def opened(x):
    while isinstance(x, str):
        try:
            y = json.loads(x)
        except ValueError:
            return x
        if isinstance(y, (dict, list)):
            return y
        if not isinstance(y, str):
            return x
        x = y
    return x


@settings(max_examples=400, deadline=None)
@given(tree)
def test_no_scalar_is_left_out(value):
    chunks = shred(json.dumps(value))
    places = list(_places(chunks))
    got = []
    for (path, at), fields in values(chunks, {x[:2] for x in places}).items():
        obj = _render(path, at)
        got += [(obj + ("" if not obj or n.startswith("[") else ".") + n, v) for n, v in fields]
    assert sorted(got) == (sorted(scalars(value, out=[])) if isinstance(opened(value), (dict, list)) else [])


def test_root_rows_arrays_of_scalars_and_mixed_paths(spark):
    text = '{"v":"2","request":{"client":{"build":7}},"entities":[{"span":[3,9],"x":1},{"x":{"y":2}}],"tags":["a",null,{"t":[[5]]}]}'
    df = spark.createDataFrame([(1, text), (2, "[4]"), (3, "{"), (4, "{}")], "id bigint, trace string")
    got = {(r.trace_id, r.obj_path, r.parent_path, r.obj_table): r.fields for r in object_rows(df, roots=True).collect()}
    assert got == {
        (1, "", None, ""): {"v": '"2"', "request.client.build": "7", "tags[0]": '"a"', "tags[1]": "null"},
        (1, "entities[0]", "", "entities[]"): {"span[0]": "3", "span[1]": "9", "x": "1"},
        (1, "entities[1]", "", "entities[]"): {"x.y": "2"},
        (1, "tags[2]", "", "tags[]"): {"t[0][0]": "5"},
        (2, "", None, ""): {"[0]": "4"},
        (4, "", None, ""): {},
    }
    assert {r.path: list(r.val) for r in column_chunks(df).where("trace_id = 1").collect()}["entities[].x"] == ["1", "{}"]


def test_query_keeps_the_scalars_of_the_trace_itself(spark, data):
    from tessella.queries.problems import p4_tables

    tops = [json.loads(r.fields) for r in p4_tables(spark, data).where("obj_path = ''").collect()]
    assert len(tops) > 100 and sum("trace_version" in t for t in tops) > 50


def test_records_of_any_depth():
    for depth in (300, 400, 3_000, 60_000 // 4):
        text = '{"a":[' * depth + "{}" + "]}" * depth
        got = objects(shred(text, leaves=False)) if depth < 4_000 else None
        if got is not None:
            assert len(got) == depth and sorted(len(p) for p, *_ in got) == [5 * k - 1 for k in range(1, depth + 1)]
        assert decode(text) is not None and decode_deep(text[:-1]) is decode_deep("")
    quoted = json.dumps({"x": '{"steps":[' * 500 + "{}" + "]}" * 500})
    assert len(objects(shred(quoted, leaves=False))) == 500


@settings(max_examples=300, deadline=None)
@given(st.recursive(st.one_of(leaf, st.floats(allow_nan=False, allow_infinity=False), st.text(max_size=4)), lambda t: st.one_of(st.lists(t, max_size=3), st.dictionaries(st.text(max_size=2), t, max_size=3)), max_leaves=15), st.sampled_from([None, 1]), st.integers(0, 60))
def test_the_deep_decoder_reads_what_json_reads(value, indent, cut):
    text = json.dumps(value, indent=indent, ensure_ascii=bool(cut % 2))
    assert decode_deep(f" {text}\n") == value
    for broken in (text[:cut], text[:cut] + "," + text[cut:], text + "x", text[cut:]):
        try:
            want = json.loads(broken, parse_constant=lambda _: 1 / 0)
        except (ValueError, ZeroDivisionError):
            assert decode_deep(broken) is decode_deep("")
        else:
            assert decode_deep(broken) == want
