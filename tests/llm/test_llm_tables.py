"""Vectors, mixing, shards, chats and the pipeline against plain readings; every operator on an empty table."""

import hashlib
import json
import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F, types as T

import corpus_pipeline
import samples
from tablescout.llm import apportion, chat, licenses, minhash, mixing, neighbours, packing, quality, secrets, sharding, substring


@pytest.fixture(scope="module")
def rows():
    return samples.odd_rows()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return samples.documents(spark, rows).repartition(5).cache()


VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
                        *(T.StructField(c, T.StringType()) for c in ("v", "n", "codes", "query_id", "score"))])


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "x", "x", "x", "x", "x") for i, v in rows], VECTORS)


def expected_neighbours(rows, is_query, k=5):
    usable = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            usable[i] = min(usable.get(i, v), v)

    def total(a, b):
        s = 0.0
        for x, y in zip(a, b):
            s = s + float(x) * float(y)
        return s

    found = []
    for q, a in usable.items():
        if is_query(q):
            scored = sorted((-(total(a, b) / (math.sqrt(total(a, a)) * math.sqrt(total(b, b)))), i)
                            for i, b in usable.items() if i != q and len(a) == len(b))
            found += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(found)


def test_neighbours(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    base = [[float(x) for x in v] for v in rng.normal(size=(300, 24)).astype(np.float32)]
    rows = [(i, v) for i, v in enumerate(base)]
    rows += [(400 + i, base[7]) for i in range(40)]  # copies tie
    rows += [(500 + i, [2.0 * x for x in base[8]]) for i in range(9)]
    rows += [(600, None), (601, []), (602, [0.0] * 24), (603, [None] * 24), (604, [float("nan")] * 24), (605, [float("inf")] * 24),
             (None, base[3]), (606, [1.0, 2.0]), (610, [2.0, 1.0]), (620, [2.0**-100] * 24), (10, base[11]), (10, base[10])]
    for blocks in ({}, {"query_block": 3, "candidate_block": 17}):
        found = neighbours.nearest(vectors(spark, rows), F.col("vec_id") % 10 == 0, **blocks)
        assert sorted(map(tuple, found.collect())) == expected_neighbours(rows, lambda i: i % 10 == 0)


def test_quantised_bounds_hold():
    import numpy as np

    rng = np.random.default_rng(4)
    m = rng.normal(size=(50, 2000)) * rng.random((50, 1)) * 1e3
    codes, scale, loss = neighbours.quantise(m)
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    near = neighbours.products(codes, codes) * scale[:, None] * scale
    assert (np.abs(near - unit @ unit.T) <= loss[:, None] + loss + loss[:, None] * loss + neighbours.MARGIN).all()
    assert (neighbours.products(codes, codes) == codes.astype(np.int64) @ codes.astype(np.int64).T).all()


def highest_quotients(votes, total):
    seats = dict.fromkeys(votes, 0)
    for _ in range(total):
        best = min((p for p in votes if votes[p] > 0), key=lambda p: (-votes[p] / (2 * seats[p] + 1), p))
        seats[best] += 1
    return {p: n for p, n in seats.items()}


def test_apportionment(spark):
    rng = random.Random(6)
    rows, expected = [], {}
    for group in range(25):
        votes = {p: float(rng.choice([0, 1, 1, rng.randint(1, 50), rng.randint(1, 10_000)])) for p in range(rng.randint(1, 30))}
        votes[0] = 3.0
        total = rng.choice([0, 1, 7, 100, 1000])
        rows += [(group, p, v, total) for p, v in votes.items()]
        expected |= {(group, p): n for p, n in highest_quotients(votes, total).items()}
    df = spark.createDataFrame(rows, "g int, p int, votes double, total long")
    found = {(r["g"], r["p"]): r["seats"] for r in apportion.apportion(df, ["g"], ["g", "p"]).collect()}
    assert {k: found.get(k, 0) for k in expected} == expected


def expected_targets(sizes):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    wanted, full = 1.5 * sum(sizes.values()), set()
    while True:
        rest = wanted - sum(2 * sizes[s] for s in full)
        free = [s for s in names if s not in full]
        target = {s: 2.0 * sizes[s] for s in full} | {s: rest * weight[s] / sum(weight[f] for f in free) for s in free}
        over = {s for s in free if target[s] > 2 * sizes[s] + 1e-9}
        if not over:
            return target
        full |= over


def test_mix(docs, rows):
    found = mixing.digest(mixing.plan(docs, shard=500)).collect()
    assert len(found) == len(rows)
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += len(samples.words(text))
    targets = expected_targets(sizes)
    by_id = defaultdict(list)
    for i, text, source in rows:
        by_id[i].append((len(samples.words(text)), source))
    taken = defaultdict(int)
    for r in found:
        size, source = by_id[r["doc_id"]][0]
        assert r["size"] == size and r["source_size"] == sizes[source] and math.isclose(r["target"], targets[source], abs_tol=1e-6)
        assert 0 <= r["taken"] <= 2 * size
        taken[source] += r["taken"]
    assert all(abs(taken[s] - targets[s]) <= 2 * mixing.BLOCK + 0.01 * targets[s] for s in targets)
    again = mixing.digest(mixing.plan(docs.repartition(2), shard=500)).collect()
    assert sorted(map(repr, found)) == sorted(map(repr, again))


def test_mixed_rows_hold_the_taken_words(docs, rows):
    unique = docs.where("doc_id is not null and doc_id <> 15")
    planned = {r["did"]: r for r in mixing.plan(unique, shard=500).collect()}
    got = defaultdict(list)
    found = mixing.mixed(unique, shard=500)
    assert found.columns == docs.columns
    for r in found.collect():
        got[r["doc_id"]].append(r)
    texts = {i: t for i, t, _ in rows}
    for i, plan in planned.items():
        own = samples.words(texts[i])
        parts = sorted((samples.words(r["text"]) for r in got[i]), key=len)
        expected = [own] * plan["rounds"] + [x for x in (own[: plan["head"]], own[plan["tail_from"] : plan["tail_from"] + plan["tail"]]) if x]
        assert sorted(parts) == sorted(expected) and sum(map(len, parts)) == plan["taken"]
        assert all(r["n_chars"] == len(r["text"]) for r in got[i])


def test_mixed_rows_of_documents_that_share_an_id(spark):
    """NULL and repeated ids on several texts and sources, and rows that are repeated whole."""
    rows = [(None, samples.prose(400 + i, 40 + 13 * i), f"s{i % 2}") for i in range(12)]
    rows += [(7, samples.prose(500 + i, 30 + 11 * i), f"s{i % 3}") for i in range(12)]
    rows += [(None, rows[0][1], "s1"), (9, rows[0][1], "s0")] + [(8, samples.prose(600, 50), "s0")] * 5 + [(i, samples.prose(700 + i, 60), None) for i in range(20, 30)]
    docs = samples.documents(spark, rows)
    planned = defaultdict(int)
    for r in mixing.plan(docs, shard=300).select("key", "did", "mark", "size", "taken").collect():
        planned[r["key"], r["did"], r["mark"]] += r["taken"]
    found = mixing.mixed(docs, shard=300)
    again = mixing.mixed(docs.repartition(7), shard=300)
    assert sorted(map(repr, found.collect())) == sorted(map(repr, again.collect()))
    # A part holds other words than its document, so it is found by the columns that it keeps.
    document = {(d[0], d["id"]): t for d, t in zip(docs.collect(), (r[1] for r in rows))}
    got = defaultdict(int)
    for r in found.collect():
        text = document[r["doc_id"], r["id"]]
        assert r["text"].strip() in text
        got["n" if r["source"] is None else "s" + r["source"], r["doc_id"], text] += len(samples.words(r["text"]))
    marks = {(r["key"], r["did"], r["mark"]): (r["key"], None if r["did"] == -(2**63) else r["did"], r["text"]) for r in docs.select(
        mixing._source_key().alias("key"), mixing.identifier().alias("did"), mixing.text_mark().alias("mark"), "text").collect()}
    expected = {marks[k]: n for k, n in planned.items() if n}
    assert dict(got) == expected and sum(expected.values()) > 1000


def check_shards(found, rows, within):
    texts = defaultdict(list)
    for i, text, _ in rows:
        texts[i].append((text or "").encode())
    slots, sizes = defaultdict(list), defaultdict(int)
    assert len(found) == len(rows)
    for r in found:
        assert r["size"] == len(texts[r["doc_id"]][0]) + 8 and r["law"] == "bytes" and r["grown_shard"] is None
        slots[r["shard"]].append(r["slot"])
        sizes[r["shard"]] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(24))
    mean = sum(sizes.values()) / 24
    assert max(sizes.values()) <= mean + within * mean


def test_shards(spark, docs, rows):
    import zlib

    found = sharding.shard(docs).collect()
    check_shards(found, rows, 24)  # one text is larger than all shards
    by_id = {i: t for i, t, _ in rows}
    assert all(r["text_crc32"] == zlib.crc32((by_id[r["doc_id"]] or "").encode()) for r in found)
    many = [(i, samples.prose(i % 1500, 5 + i % 37), None) for i in range(3000)] + [(5000 + i, samples.prose(1, 30), None) for i in range(1500)]
    found = sharding.shard(samples.documents(spark, many)).collect()
    check_shards(found, many, 0.02)
    groups = defaultdict(set)
    texts = {i: t for i, t, _ in many}
    for r in found:
        groups[texts[r["doc_id"]]].add(r["shard"])
    assert sum(len(g) > 1 for g in groups.values()) <= 1  # only the group that is larger than a shard


def test_no_group_that_fits_a_shard_is_divided(spark):
    """Groups of copies of a fifth of a shard up to all of it."""
    rows = [(i, samples.prose(2000 + i, 12), None) for i in range(4000)]
    per_shard = sum(len(t) + 8 for _, t, _ in rows) / 24
    for g, part in enumerate((0.2, 0.3, 0.5, 0.7, 0.9)):
        text = samples.prose(9000 + g, 40)
        rows += [(10_000 * (g + 1) + k, text, None) for k in range(int(part * per_shard / (len(text) + 8)))]
    found = sharding.shard(samples.documents(spark, rows)).collect()
    check_shards(found, rows, 0.05)
    texts = {i: t for i, t, _ in rows}
    groups = defaultdict(set)
    for r in found:
        groups[texts[r["doc_id"]]].add(r["shard"])
    assert {len(g) for g in groups.values()} == {1}
    assert not any(r["divided"] for r in found)


MESSAGES = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()),
                         T.StructField("text", T.StringType()), *(T.StructField(c, T.StringType()) for c in ("v", "row", "calls", "level", "answer"))])


def messages(spark, rows):
    return spark.createDataFrame([(*r, *"abcde") for r in rows], MESSAGES)


def call(*calls, **more):
    return json.dumps({"tool_calls": [dict(zip(("id", "name", "arguments"), c)) for c in calls]} | more)


def result(call_id, content):
    return json.dumps({"content": content, "tool_call_id": call_id})


CHAT = [
    (1, 0, "user", 'say "hé"\n\t'), (1, 1, "assistant", call(("a", "sum", {"y": 2, "x": 1.50}), ("b", "sum", {"x": "$call:a", "y": 1}), content="ok")),
    (1, 3, "tool", result("a", {"z": 1, "b": [1, 2]})), (1, 2, "tool", result("b", None)), (1, 4, "tool", result("zz", 1)), (1, 5, "tool", result("a", "late")),
    (1, 6, "assistant", call(("a", "sum", {"x": 1, "y": 1}), ("c", "sum", {"x": True, "y": 1}), ("d", "sum", {"x": 1}), ("e", "other", {}), ("f", "sum", {"x": 1, "y": 2, "k": 0}))),
    (2, 0, "assistant", call(("p", "sum", {"x": "$call:q", "y": 1}), ("q", "sum", {"x": "$call:p", "y": 1}))),
    (2, 1, "tool", result("p", 1)), (3, 0, "user", None), (3, 1, None, "{not json"), (None, 0, "tool", result("a", 1)), (3, 2, "tool", "plain"),
    (4, 0, "user", "x"), (4, 0, "user", "x"), (None, None, "user", ""),
]
SCHEMAS = {"sum": {"x": ("number", True), "y": ("number", True)}}


def test_chat_links(spark):
    found = chat.link(messages(spark, CHAT), SCHEMAS).collect()
    assert len(found) == len(CHAT)
    own = {(r["conv_id"], r["turn"]): r for r in found}
    first = own[1, 1]
    assert first["json"] == ('{"content":"ok","role":"assistant","tool_calls":[{"arguments":{"x":1.5,"y":2},"id":"a","name":"sum"},'
                             '{"arguments":{"x":"$call:a","y":1},"id":"b","name":"sum"}]}')
    assert (first["n_calls"], first["n_answered"], first["n_valid"], first["call_issues"]) == (2, 2, 1, "wrong_type:x")
    assert [(own[1, t]["link"], own[1, t]["anchor"], own[1, t]["level"]) for t in (3, 2, 4, 5)] == [
        ("linked", 1, 1), ("linked", 1, 2), ("orphan", 4, 0), ("repeated", 5, 0)]
    assert own[1, 3]["json"] == '{"content":{"b":[1,2],"z":1},"role":"tool","tool_call_id":"a"}'
    assert own[1, 6]["call_issues"] == "repeated_id,wrong_type:x,missing:y,unknown_tool,unexpected:k"
    assert own[2, 0]["call_issues"] == "cycle_or_unknown_reference" and own[2, 1]["link"] == "linked"
    assert own[None, 0]["link"] == "orphan"
    assert json.loads(own[1, 0]["json"]) == {"content": CHAT[0][3], "role": "user"}
    assert own[3, 0]["json"] == '{"content":null,"role":"user"}' and own[3, 1]["json"] == '{"content":"{not json","role":null}'


def test_chat_checks_against_declared_tools(spark):
    """Tools that a message declares hold for its conversation alone and come before the caller's."""
    declared = json.dumps({"content": None, "tools": [
        {"type": "function", "function": {"name": "find", "parameters": {"type": "object", "properties": {
            "q": {"type": "string"}, "k": {"type": "integer"}, "odd": {"type": "whatever"}}, "required": ["q", "bare"]}}},
        {"name": "now"}, {"name": "find", "parameters": {"properties": {}}}, {"no": "name"}, 7,
        {"name": "sum", "parameters": {"properties": {"x": {"type": "string"}}}}]})
    tried = [("find", '{"q": "a", "bare": 1}', "valid"), ("find", '{"q": "a", "bare": [], "k": 3.0, "odd": {}}', "valid"),
             ("find", '{"q": "a"}', "missing:bare"), ("find", '{"bare": 1, "k": "x"}', "wrong_type:k"),
             ("find", '{"q": null, "bare": 1}', "missing:q"), ("find", '{"q": "a", "bare": 1, "z": 1, "y": 1}', "unexpected:y"),
             ("find", "[1]", "not_an_object"), ("find", "null", "not_an_object"), ("now", "{}", "valid"), ("now", '{"t": 1}', "unexpected:t"),
             ("sum", '{"x": "text"}', "valid"), ("gone", "{}", "unknown_tool")]
    rows = [(1, 0, "system", declared), (2, 0, "system", "plain"), (2, 1, "assistant", '{"tool_calls": [{"id": "a", "name": "find", "arguments": {}}]}'),
            (2, 2, "assistant", '{"tool_calls": [{"id": "b", "name": "sum", "arguments": {"x": 1, "y": 2}}]}'), (None, 0, "system", declared)]
    rows += [(1, i + 1, "assistant", '{"tool_calls": [{"id": "c%d", "name": "%s", "arguments": %s}]}' % (i, name, arguments))
             for i, (name, arguments, _) in enumerate(tried)]
    found = {(r["conv_id"], r["turn"]): r for r in chat.link(messages(spark, rows), SCHEMAS).collect()}
    assert len(found) == len(rows)
    for i, (_, _, issue) in enumerate(tried):
        row = found[1, i + 1]
        assert (row["call_issues"] or "valid", row["n_valid"]) == (issue, int(issue == "valid"))
    assert found[2, 1]["call_issues"] == "unknown_tool" and found[2, 2]["n_valid"] == 1


def test_chat_numbers_have_one_form(spark):
    """However a number is spelt, its value has one text; strings that look like numbers stay."""
    spellings = {"100": ("100", "100.0", "1e2", "1E+2", "10000e-2"), "1.5": ("1.5", "1.50", "15e-1"), "0": ("0", "-0", "0.0", "0e5"),
                 "-2": ("-2", "-2.0"), "12345678901234567890": ("12345678901234567890", "12345678901234567890.0")}
    rows, expected = [], []
    for value, ways in spellings.items():
        for way in ways:
            text = '{"tool_calls": [{"id": "a", "name": "t", "arguments": {"s": "1e2, [1.0]: \\"2.50\\" \\\\", "n":%s, "l": [%s ,%s]}}]}' % (way, way, way)
            rows.append((len(rows), 0, "assistant", text))
            expected.append((value, "valid" if "." not in value else "wrong_type:n"))
    schema = {"t": {"n": ("integer", True), "s": ("string", True), "l": ("array", True)}}
    found = {r["conv_id"]: r for r in chat.link(messages(spark, rows), schema).collect()}
    for i, (value, issue) in enumerate(expected):
        assert '"arguments":{"l":[%s,%s],"n":%s,"s":"1e2, [1.0]: \\"2.50\\" \\\\"}' % (value, value, value) in found[i]["json"]
        assert (found[i]["call_issues"] or "valid") == issue
    odd = chat.link(messages(spark, [(1, 0, "tool", '{"tool_call_id": "x", "content": 1e-30}'), (2, 0, "tool", '{"tool_call_id": "x", "content": [1.0, oops}')])).collect()
    texts = {r["conv_id"]: r["json"] for r in odd}
    assert json.loads(texts[1])["content"] == 1e-30 and json.loads(texts[2])["content"] == '{"tool_call_id": "x", "content": [1.0, oops}'


def test_chat_order_and_files(spark, tmp_path):
    linked = chat.link(messages(spark, CHAT[:7]), SCHEMAS)
    order = [r["turn"] for r in linked.orderBy("anchor", "level", "slot", "turn").collect()]
    assert order == [0, 1, 3, 2, 4, 5, 6]
    chat.write_conversations(linked, str(tmp_path / "chats"), 2)
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "chats")).collect()]
    assert len(lines) == 7 and all(json.loads(x)["conv_id"] == 1 for x in lines)


def test_chains_of_calls(spark):
    rows = [(1, f"c{i}", [f"c{i - 1}"] if i else []) for i in range(6)] + [(1, "d", ["c5", "c1"]), (1, "x", ["y"]), (1, "y", ["x"])]
    df = spark.createDataFrame(rows, "conv_id long, call_id string, needs array<string>")
    assert {r["call_id"]: r["level"] for r in chat.levels(df).collect()} == {f"c{i}": i for i in range(6)} | {"d": 6}


def test_levels_of_any_graph(spark):
    """Chains, several needs, cycles, unknown needs and self references against a plain topological order."""
    rng = random.Random(5)
    graphs = {}
    for conv in range(12):
        names = [f"n{i}" for i in range(40)]
        graph = {n: sorted(rng.sample(names[:i], min(i, rng.choice([0, 1, 1, 1, 1, 2, 3])))) for i, n in enumerate(names)}
        for n in rng.sample(names, 3 if conv % 2 else 0):
            graph[n] = sorted(set(graph[n]) | {rng.choice([n, "unknown", names[-1]])})
        graphs[conv] = graph
    expected = {}
    for conv, graph in graphs.items():
        level = {}
        for _ in graph:
            level |= {n: 1 + max((level[m] for m in needs), default=-1) for n, needs in graph.items() if all(m in level for m in needs)}
        expected |= {(conv, n): v for n, v in level.items()}
    df = spark.createDataFrame([(c, n, needs) for c, g in graphs.items() for n, needs in g.items()], "conv_id long, call_id string, needs array<string>")
    found = chat.levels(df).collect()
    assert len(found) == len(expected) and {(r["conv_id"], r["call_id"]): r["level"] for r in found} == expected


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    for result in (
        substring.drop_repeats(none), minhash.near_duplicates(none), minhash.keep_one(none), packing.digest(packing.pack(none)),
        quality.digest(quality.judge(none)), quality.keep_good(none), secrets.digest(secrets.find_secrets(none)), secrets.redact(none),
        licenses.scan_licenses(none), mixing.digest(mixing.plan(none)), mixing.mixed(none), sharding.shard(none),
        chat.link(messages(spark, CHAT).limit(0)), neighbours.nearest(vectors(spark, [(1, [1.0])]).limit(0), F.col("vec_id") % 50 == 0),
    ):
        assert result.collect() == []


def test_pipeline_stages(spark, docs, rows, tmp_path):
    """Each stage on what the one before kept; its decisions take effect and columns stay."""
    from tablescout.session import materialize

    leak = [(900, samples.prose(90, 100) + " password=hunter2222", "a")]
    now = samples.documents(spark, rows + leak)
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        last, now = now, materialize(stage(spark, now, ""), name)
        seen[name] = now
        if name != "lexical_packing":
            assert now.columns == docs.columns and now.schema["doc_id"].dataType == docs.schema["doc_id"].dataType
    ids = {name: [r["doc_id"] for r in df.select("doc_id").collect()] for name, df in seen.items()}
    assert not {1, 2, 3, 4, 12, 14, 15} & set(ids["quality_rules"]) and {6, 7, 8, 200, 900, None} <= set(ids["quality_rules"])
    expected = samples.classes([r for r in rows + leak if r[0] in set(ids["quality_rules"])])
    assert sorted(map(repr, ids["near_duplicates"])) == sorted(repr(None if i == -(2**63) else i) for i, c in expected.items() if i == c)
    assert sorted(map(repr, ids["secret_scans"])) == sorted(map(repr, ids["near_duplicates"]))
    assert seen["secret_scans"].where("doc_id = 900").first()["text"].endswith(" [SECRET]")
    assert set(ids["lexical_packing"]) == set(ids["source_mix"]) <= set(ids["secret_scans"])


def test_pipeline_runs(spark):
    import os

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no test tables")
    found = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert found.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and found.count() > 0
