"""Deep merge against a plain recursive one."""

import json

from shelfmark.operators import settings


def plain(base, patch):
    if not isinstance(base, dict) or not isinstance(patch, dict):
        return patch
    return {**base, **{k: plain(base[k], v) if isinstance(v, dict) and isinstance(base.get(k), dict) else v for k, v in patch.items()}}


def test_cases(spark):
    cases = [({"a": {"b": 1, "c": [1, 2]}, "d": "x"}, {"a": {"c": [3]}, "e": {"f": {"g": None}}}), ({"a": 1}, {"a": {"b": 2}}), ({"a": {"b": 2}}, {"a": 1}),
             ({"a": {}}, {"a": {"b": {}}}), ({"a": {"b": 1}}, {"a": {}}), ({}, {}), ({}, {"x": [{"y": 1}]}), ({"a": {"b": {"c": 1, "d": 2}}}, {"a": {"b": {"c": None}}}),
             ({"q\"uote.d": {"k": "v\\n"}}, {"q\"uote.d": {"l": "\u00e9"}}), ({"a": [1]}, {"a": {"b": 1}}), ({"a": None}, {"a": {"b": 1}}), ({"a": 1}, {"b": {}})]
    rows = [(i, json.dumps(a), json.dumps(b)) for i, (a, b) in enumerate(cases)]
    rows += [(100, '{"a":{"b":1}}', None), (101, '{"a":1}', "no json"), (102, None, '{"b":2}')]
    docs = spark.createDataFrame(rows, "id long, base string, patch string")
    got = {r.id: json.loads(r.document) for r in settings.rebuild(settings.deep_merge(docs)).collect()}
    want = {i: plain(a, b) for i, (a, b) in enumerate(cases)}
    want |= {100: {"a": {"b": 1}}, 101: {"a": 1}, 102: {"b": 2}}
    assert got == want
    assert settings.deep_merge(docs.limit(0)).collect() == []


def test_merging_shuffles_nothing_whatever_the_depth(spark):
    def deep(n, end):
        return {"k": deep(n - 1, end), "n": n} if n else end

    cases = [(deep(11, {"x": {}}), deep(11, {"x": {"y": 1}})), (deep(9, {}), deep(4, {})), (deep(3, 5), deep(9, None)), (deep(8, [1]), deep(8, {})), (None, deep(6, {}))]
    docs = spark.createDataFrame([(i, json.dumps(a) if a else None, json.dumps(b)) for i, (a, b) in enumerate(cases)], "id long, base string, patch string")
    merged = settings.deep_merge(docs)
    got = {r.id: r.document for r in settings.rebuild(merged).collect()}
    assert got == {i: json.dumps(plain(a, b), sort_keys=True, separators=(",", ":")) for i, (a, b) in enumerate(cases)}
    assert "Exchange" not in merged._jdf.queryExecution().executedPlan().toString()
