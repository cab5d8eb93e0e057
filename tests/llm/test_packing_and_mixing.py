import random
from collections import Counter, defaultdict
from itertools import product

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.llm.mixing import fit_counts, mixture, mixture_plan, mixture_shares
from millrace.llm.packing import best_fit, pack, sequences
from millrace.llm.tokens import VOCABULARIES, has_vocabularies, sized_texts, token_counter


def slow_best_fit(items, capacity, barred):
    bins, where = [], {}
    for i in sorted(range(len(items)), key=lambda i: -items[i][0]):
        size, source, cluster = items[i]
        fits = [
            (b["room"], n) for n, b in enumerate(bins)
            if b["room"] >= size and cluster not in b["clusters"] and not any(barred.get(source, 0) >> s & 1 for s in b["sources"])
        ]
        if fits:
            n = min(fits)[1]
        else:
            n = len(bins)
            bins.append({"room": capacity, "clusters": set(), "sources": set()})
        bins[n]["room"] -= size
        bins[n]["clusters"].add(cluster)
        bins[n]["sources"].add(source)
        where[i] = n
    return bins


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 20), st.integers(0, 3), st.integers(0, 8)), max_size=40))
def test_best_fit(items):
    barred = {0: 1 << 1, 1: 1 << 0}
    where = best_fit(items, 20, barred)
    held = defaultdict(list)
    for item, n in zip(items, where):
        held[n].append(item)
    for own in held.values():
        assert sum(x[0] for x in own) <= 20
        assert max(Counter(x[2] for x in own).values()) == 1
        assert not {0, 1} <= {x[1] for x in own}
    assert sorted(held) == list(range(len(held)))
    free = [(s, 0, i) for i, (s, _, _) in enumerate(items)]
    assert len(set(best_fit(free, 20))) == len(slow_best_fit(free, 20, {}))


def sized(spark, data):
    return spark.createDataFrame(data, "doc_id long, source string, n_tokens long, cluster long, piece string")


def test_pack_frame(spark):
    rng = random.Random(6)
    data = [(i, rng.choice(["a", "b", None]), rng.randint(1, 60), rng.randint(0, 150), "z") for i in range(400)]
    data += [(900, "a", 250, 900, "z"), (901, "a", 100, 901, "z"), (902, "a", 0, 902, "z"), (903, None, None, 903, "z")]
    packed = pack(sized(spark, data), "doc_id", "source", 100, group_items=100)
    rows = packed.collect()
    by_doc, by_bin = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append((r.first_token, r.n_tokens))
        by_bin[r.sequence_id].append(r)
    size = {i: n for i, _, n, _, _ in data}
    cluster = {i: c for i, _, _, c, _ in data}
    assert set(by_doc) == {i for i, n in size.items() if n}
    for i, pieces in by_doc.items():
        assert sum(n for _, n in pieces) == size[i] and len(pieces) == -(-size[i] // 100)
    for own in by_bin.values():
        assert sum(r.n_tokens for r in own) <= 100 and len({cluster[r.doc_id] for r in own}) == len(own)
    assert sequences(packed, 100).agg(F.sum("n_tokens")).first()[0] == sum(n or 0 for n in size.values())
    assert pack(sized(spark, []), "doc_id", "source", 100).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 12), st.integers(1, 3), max_size=5), st.integers(0, 60))
def test_fit_is_the_best_subset_sum(available, budget):
    take = fit_counts(available, budget)
    total = sum(s * n for s, n in take.items())
    assert all(0 <= n <= available[s] for s, n in take.items())
    sums = {sum(s * n for s, n in zip(available, ns)) for ns in product(*(range(n + 1) for n in available.values()))}
    assert total <= budget
    if sum(s * n for s, n in available.items()) <= budget:
        assert total == max(sums)
    assert budget - total <= max(available, default=0) or total == max(x for x in sums if x <= budget)


def test_large_budget_is_met_exactly():
    rng = random.Random(2)
    available = {rng.randint(20, 3000): rng.randint(1, 5000) for _ in range(300)}
    budget = sum(s * n for s, n in available.items()) // 3
    assert sum(s * n for s, n in fit_counts(available, budget).items()) == budget


def test_mixture(spark):
    rng = random.Random(9)
    data = [(i, s, rng.randint(5, 40), i, "z") for i, s in enumerate(["a"] * 300 + ["b"] * 20 + ["c"] * 60 + [None] * 30)] + [(999, "a", 0, 1, "z")]
    targets = spark.createDataFrame([("a", 5.0, 2), ("b", 4.0, 3), ("c", 3.0, 4), ("none", 1.0, 2), ("zero", 0.0, 2), ("null", None, None)], "source string, weight double, max_repeats int")
    docs = sized(spark, data)
    plan = mixture_plan(docs, "source", targets, 0.5)
    total = sum(r[2] for r in data)
    shares = {r.source: r for r in mixture_shares(plan).collect()}
    held = defaultdict(int)
    for _, s, n, _, _ in data:
        held[s] += n
    used, repeats = defaultdict(int), defaultdict(list)
    for r in mixture(docs, "doc_id", "source", plan).collect():
        used[r.source] += r.n_tokens * r.repeats
        repeats[r.source].append(r.repeats)
    for s, (w, most) in {"a": (5, 2), "b": (4, 3), "c": (3, 4)}.items():
        target = w / 13 * 0.5 * total
        assert shares[s].short == (held[s] * most < target)
        assert used[s] == shares[s].actual_tokens and max(repeats[s]) <= most
        assert used[s] == held[s] * most if shares[s].short else 0 <= target - used[s] < 1.5
    assert shares["none"].short and shares["none"].actual_tokens == 0 and not shares["zero"].short and set(used) == {"a", "b", "c"}
    assert {tuple(r) for r in mixture(docs, "doc_id", "source", plan).collect()} == {tuple(r) for r in mixture(docs.repartition(7), "doc_id", "source", plan).collect()}
    assert {r.short for r in mixture_shares(mixture_plan(docs.limit(0), "source", targets, 0.5)).collect()} == {False}


@pytest.mark.skipif(not has_vocabularies(), reason="no vocabularies here")
@pytest.mark.parametrize("name", ["byte_bpe_50k.tiktoken", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_token_counts(spark, name):
    counter = token_counter(f"{VOCABULARIES}/{name}")
    assert counter([""]) == [0] and counter(["hello there"])[0] >= 2
    df = spark.createDataFrame([(1, "s", "Hello  there"), (2, None, None), (3, "s", ""), (4, "s", "hello there"), (5, "s", "word " * 50_000)], "doc_id long, source string, text string")
    rows = {r.doc_id: r for r in sized_texts(df, "doc_id", "source", "text", f"{VOCABULARIES}/{name}").collect()}
    assert rows[2].n_tokens == rows[3].n_tokens == 0 and rows[1].cluster == rows[4].cluster != rows[5].cluster and rows[5].n_tokens >= 50_000


@pytest.mark.skipif(not has_vocabularies(), reason="no vocabularies here")
def test_both_libraries_count_alike():
    texts = ["It's 9 a.m. — naïve café?", "これは文章です", "x" * 300, "a  b\n\n c"]
    assert token_counter(f"{VOCABULARIES}/byte_bpe_50k.tiktoken")(texts) == token_counter(f"{VOCABULARIES}/byte_bpe_50k.json")(texts)
