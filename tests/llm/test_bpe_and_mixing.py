"""Token ids against an independent encoder; mixing against its own promises."""

import base64

import pytest

from trama.llm import bpe, mixing


@pytest.fixture(scope="module")
def reference():
    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


TEXTS = [None, "", " ", "aaaaaaa", "a" * 5000, "Reunião às 10h, R$ 1.234,56!", "\n\n \t x ", "😀😀 naïve", "\x00�", "<|endoftext|>", "it's we'll", "x" * 3 + " " * 50 + "y", "ab" * 40_000]


def test_ids_equal_reference(spark, reference):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] + [(0, "dup", "x"), (0, "dup", "x")], "doc_id long, text string, ids string")
    got = [(r["doc_id"], r["ids"]) for r in bpe.encode(df).collect()]
    want = [(i, reference.encode_ordinary(t) if t else []) for i, t in enumerate(TEXTS)] + [(0, reference.encode_ordinary("dup"))] * 2
    assert sorted(got) == sorted(want)
    assert bpe.encode(df.limit(0)).count() == 0


def test_memory_starts_anew(reference):
    enc = bpe.Encoder(bpe.vocabulary_path(), keep=3)
    for t in ("one two three four five", "six seven", "one two"):
        assert enc.encode([t]).to_pylist() == [reference.encode_ordinary(t)]
    assert enc.count([None, "one two"]).tolist() == [0, 2]


def test_budgets_shares_and_siblings():
    leaf = lambda s, d, w, t, r=1: {"mistura": "m", "source": s, "dominio": d, "idioma": "pt", "peso": w, "reps": r, "tokens": t, "docs": 1}
    leaves = [leaf("a", "x", 1, 100), leaf("b", "x", 1, 1000), leaf("c", "y", 2, 1000)]
    exact = {r["source"]: round(r["budget"]) for r in mixing.planned(leaves, "exact")}
    assert exact == {"a": 100, "b": 100, "c": 200}
    short = {r["source"]: round(r["budget"]) for r in mixing.budgets(leaves, 800)}
    assert short == {"a": 100, "b": 300, "c": 400}  # the sibling takes the shortage, not the other domain
    most = {r["source"]: round(r["budget"]) for r in mixing.budgets(leaves, 10**9)}
    assert most == {"a": 100, "b": 1000, "c": 1000}


def test_shortages_two_levels_deep():
    def leaf(s, d, lang, w, t, r=1):
        return {"mistura": "m", "source": s, "dominio": d, "idioma": lang, "peso": w, "reps": r, "tokens": t, "docs": 1}

    leaves = [leaf("a", "x", "pt", 1, 100), leaf("b", "x", "pt", 1, 50, 3), leaf("c", "x", "es", 2, 400), leaf("none", "x", "", 2, 0), leaf("d", "y", "pt", 6, 5000)]
    # 6 : 6 by weight; in x the empty source's part goes to pt and es (1000 : 1000), pt can give 250 and es 400, so y takes the rest
    assert {r["source"]: round(r["budget"]) for r in mixing.budgets(leaves, 4000)} == {"a": 100, "b": 150, "c": 400, "none": 0, "d": 3350}
    # here the domain can meet its part: a full source gives way to its sibling, the empty one to those of its domain
    assert {r["source"]: round(r["budget"]) for r in mixing.budgets(leaves, 460)} == {"a": 58, "b": 58, "c": 115, "none": 0, "d": 230}
    assert {r["source"]: round(r["budget"]) for r in mixing.budgets(leaves, 840)} == {"a": 100, "b": 110, "c": 210, "none": 0, "d": 420}
    assert sum(r["budget"] for r in mixing.budgets(leaves)) == 5550


def test_select(spark):
    docs = [(i, "word " * (i % 50 + 1), "pt", "big" if i % 3 else "small", 1) for i in range(600)] + [(1000, None, None, "small", 1), (1001, "", None, "big", 1), (1002, "x y", None, None, 1)]
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, tokens int")
    m = spark.createDataFrame([("m", "big", 3.0, 1), ("m", "small", 1.0, 4), ("m", "small", 1.0, 4), ("m", "none", 1.0, 2), ("n", "small", 5.0, 3), (None, "x", 1.0, 1)], "mistura string, source string, peso double, max_repeticoes int")
    where = spark.createDataFrame([("big", "x"), ("big", "x")], "source string, dominio string")
    uses, shares = mixing.select(d, m, where, "exact")
    u = uses.collect()
    assert all(1 <= r["vezes"] <= (1 if r["source"] == "big" else 4) for r in u) and len({(r["mistura"], r["doc_id"]) for r in u}) == len(u)
    s = {(r["mistura"], r["source"]): r for r in shares.collect()}
    # the empty source is in the domain of "small", which takes its part
    assert abs(s["m", "big"]["parte"] - 0.6) < 0.01 and abs(s["m", "small"]["parte"] - 0.4) < 0.01 and s["m", "none"]["tokens"] == 0
    assert s["n", "small"]["usos"] == 3 * 200 and s["n", "small"]["parte"] == 1.0
    again = mixing.select(d.repartition(7), m, where, "exact")[0].collect()
    assert sorted(map(str, again)) == sorted(map(str, u))
    assert mixing.select(d.limit(0), m, where)[0].count() == 0 and mixing.select(d, m.limit(0), where)[1].count() == 0
    all_, got = mixing.select(d, m, where)[0].groupBy("mistura").agg({"doc_id": "count"}).collect(), {(r["mistura"], r["source"]): r for r in mixing.select(d, m, where)[1].collect()}
    assert len(all_) == 2 and abs(sum(r["tokens"] for (k, _), r in got.items() if k == "m") - got["m", "big"]["tokens_disponiveis"] - got["m", "small"]["tokens_disponiveis"]) < 60
