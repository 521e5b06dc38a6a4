import json

from hypothesis import given, settings
from hypothesis import strategies as st

from weftline.operators.nested import Index, flatten_json, index_nodes

leaf = st.one_of(st.none(), st.booleans(), st.integers(-(10**6), 10**6), st.floats(allow_nan=False, allow_infinity=False), st.text(max_size=6))
keys = st.one_of(st.sampled_from(["plays", "participants", "boxscore", "a.b", 'q"', "\\", "é", ""]), st.text(max_size=3))
tree = st.recursive(leaf, lambda c: st.one_of(st.lists(c, max_size=4), st.dictionaries(keys, c, max_size=4)), max_leaves=20)


def whole(text):
    try:
        json.loads(text, parse_constant=lambda c: 1 / 0)
        return True
    except Exception:
        return False


def brute(text, lone=("participants",), embedded=("boxscore",)):
    out = []
    if not whole(text):
        return out

    def walk(v, p):
        if isinstance(v, dict):
            for k, x in v.items():
                q = f"{p}.{k}" if p else k
                if k in embedded and isinstance(x, str) and whole(x):
                    x = json.loads(x)
                    if k in lone and isinstance(x, dict):
                        pass
                if k in lone and isinstance(x, dict):
                    out.append(q + "[0]")
                    walk(x, q + "[0]")
                else:
                    walk(x, q)
        elif isinstance(v, list):
            for i, x in enumerate(v):
                if isinstance(x, dict):
                    out.append(f"{p}[{i}]")
                walk(x, f"{p}[{i}]")

    walk(json.loads(text), "")
    return out


def paths(texts):
    got = [[] for _ in texts]
    for _, c in index_nodes([t.encode("utf-8", "surrogatepass") for t in texts], frozenset(["participants"]), frozenset(["boxscore"])):
        for d, p in zip(c["doc"], c["path"].to_pylist()):
            got[d].append(p)
    return got


@settings(max_examples=150, deadline=None)
@given(st.lists(tree, min_size=1, max_size=4), st.sampled_from([None, 1, (",", ":")]))
def test_paths_match_a_recursive_walk(values, style):
    texts = [json.dumps(v, ensure_ascii=False) if style is None else json.dumps(v, indent=1) if style == 1 else json.dumps(v, separators=style) for v in values]
    got = paths(texts)
    for t, g in zip(texts, got):
        assert sorted(g) == sorted(brute(t)), t


@settings(max_examples=200, deadline=None)
@given(tree, st.integers(0, 60), st.sampled_from(["", "}", "]", ",", ":", '"', "\\", "x", "0", "{", "-", "\n", "\x01", "tru", "01", "1.", "\\u12"]))
def test_wholeness_matches_a_strict_parser(value, at, junk):
    t = json.dumps(value)
    t = t[: at % (len(t) + 1)] + junk + (t[at % (len(t) + 1) :] if at % 2 else "")
    assert bool(Index([t.encode()]).whole[0]) == whole(t), repr(t)


def test_broken_neighbours_do_not_disturb():
    texts = ['{"plays":[{"a":1}', '{"plays":[{"a":1},2,{"b":[{}]}]}', "", 'null', '"', '{"boxscore":"{\\"teams\\":[{\\"x\\":1}]}"}']
    assert paths(texts) == [[], ["plays[0]", "plays[2]", "plays[2].b[0]"], [], [], [], ["boxscore.teams[0]"]]


def test_flat_tables_keep_links(spark):
    rows = [(1, '{"plays":[{"id":1,"participants":{"p":7}},5,{"id":2,"participants":[{"p":8},{"p":9}]}]}', "x"), (2, None, "x"), (3, "{", "x")]
    df = flatten_json(spark.createDataFrame(rows, "id long, js string, node_path string"), "id", "js", lone=["participants"])
    got = {(r["node_path"], r["parent_path"], r["array_path"], r["elem_no"], r["node_json"]) for r in df.collect()}
    assert ("plays[2].participants[1]", "plays[2]", "plays.participants", 1, '{"p":9}') in got
    assert ("plays[0].participants[0]", "plays[0]", "plays.participants", 0, '{"p":7}') in got
    assert len(got) == 5


def test_very_long_text(spark):
    big = json.dumps({"plays": [{"n": i, "t": "x" * 50} for i in range(40_000)]})
    df = flatten_json(spark.createDataFrame([(1, big)], "id long, js string"), "id", "js", body=False)
    assert df.count() == 40_000


def test_empty_table(spark):
    assert flatten_json(spark.createDataFrame([], "id long, js string"), "id", "js").count() == 0
