"""Group ids against union-find, and special cases."""

import random

import pytest

from trama.llm import components


def union_find(pairs):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in list(parent)}


def run(spark, rows):
    df = spark.createDataFrame([(*r, 1) for r in rows], "origem string, destino string, grupo int")
    got = components.group_ids(df).collect()
    assert len({r["entidade"] for r in got}) == len(got)
    return {r["entidade"]: r["grupo"] for r in got}


@pytest.mark.parametrize("seed", [1, 2])
def test_random_graphs_chains_and_hubs(spark, seed):
    rng = random.Random(seed)
    pairs = [(f"r{rng.randrange(400):03d}", f"r{rng.randrange(400):03d}") for _ in range(300)]
    pairs += [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(150)]
    pairs += [("hub", f"h{i:03d}") for i in range(200)] + [("h001", "hub"), ("self", "self")]
    assert run(spark, pairs) == union_find(pairs)


def test_null_empty_repeated_and_reversed(spark):
    rows = [(None, "a"), ("", "b"), ("c", ""), ("x", "y"), ("y", "x"), ("x", "y"), ("z", "z"), ("w", None)]
    assert run(spark, rows) == {"x": "x", "y": "x", "z": "z"}


def test_hub_with_a_third_of_all_links(spark):
    rng = random.Random(3)
    pairs = [("hub", f"h{i:04d}") for i in range(700)] + [(f"r{rng.randrange(900):03d}", f"r{rng.randrange(900):03d}") for _ in range(600)]
    pairs += [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(400)] + [("c017", "h0003")]
    rows = spark.createDataFrame(pairs, "v string, w string")
    assert components.hot_keys(rows, "v") == ["hub"]
    assert run(spark, pairs) == union_find(pairs)


def test_a_long_chain_takes_few_levels(spark, monkeypatch):
    seen, plain = [], components._level
    monkeypatch.setattr(components, "_level", lambda *a: seen.append(a[1]) or plain(*a))
    pairs = [(f"c{i:05d}", f"c{i + 1:05d}") for i in range(3000)]
    assert run(spark, pairs) == union_find(pairs)
    assert len(seen) <= 6


def test_empty_table(spark):
    df = spark.createDataFrame([], "origem string, destino string")
    assert components.group_ids(df).count() == 0


def test_long_id(spark):
    big = "x" * 50_000
    assert run(spark, [(big, "a")]) == {big: "a", "a": "a"}
