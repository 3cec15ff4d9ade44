import hashlib
import random
import re
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from graphonic.llm import decontaminate as d

from .data import docs, empty

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(pairs, items, window=10):
    known = defaultdict(set)
    for item, text in items:
        w = words(text)
        n = min(window, len(w))
        for i in range(len(w) - n + 1) if n else ():
            known[tuple(w[i : i + n])].add(item)
    out = []
    for doc, text in pairs:
        w, hit, met = words(text), set(), set()
        for n in {len(k) for k in known}:
            for i in range(len(w) - n + 1):
                if found := known.get(tuple(w[i : i + n])):
                    hit |= set(range(i, i + n))
                    met |= found
        out.append((doc, len(w), len(hit), len(met), hashlib.sha256(",".join(sorted(met)).encode()).hexdigest(), bool(hit)))
    return sorted(out)


def pick(df):
    return sorted(tuple(r) for r in df.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect())


@pytest.mark.parametrize("bound", [10**9, 0])
def test_equals_brute_force(spark, bound):
    rng, df = random.Random(2), docs(spark)
    pairs = [(r.doc_id, r.text) for r in df.collect()]
    items = [("1", pairs[0][1]), ("2", "W0É Word1 word2"), ("3", None), ("4", ""), ("5", "word5"), ("1", "word9 word10")]
    items += [(str(10 + k), " ".join(words(t)[3:20])) for k, (_, t) in enumerate(rng.sample(pairs[:60], 12))]
    bench = spark.createDataFrame(items, "item_id string, text string")
    got = d.decontaminate(df, bench, text_bytes=bound)
    clean = [(i, t) for i, t in items if t is not None]
    assert pick(got) == brute(pairs, clean)
    keep = d.clean(df, bench, text_bytes=bound)
    assert keep.columns == df.columns
    assert sorted(r.doc_id for r in keep.collect()) == sorted(x[0] for x in brute(pairs, clean) if not x[5])


def test_empty_tables(spark):
    bench = spark.createDataFrame([("1", "a b")], "item_id string, text string")
    assert d.decontaminate(empty(spark), bench).count() == 0
    assert not d.decontaminate(docs(spark), bench.where("false")).where("contaminated").count()


def test_spans_and_items(spark):
    df = spark.createDataFrame([(1, "x a b c y a b c")], "doc_id long, text string")
    r = d.decontaminate(df, spark.createDataFrame([("7", "A, b; c!")], "item_id string, text string")).first()
    assert [(s.start, s.end) for s in r.spans] == [(1, 4), (5, 8)] and list(r["items"]) == ["7"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=60), st.lists(st.integers(0, 3), min_size=10, max_size=30))
def test_winnowing_misses_no_window(a, b):
    import pyarrow as pa

    text, item = " ".join(map(str, a)), " ".join(map(str, b))
    index = d.Index([("1", item)])
    found = {(i, n) for i, n, _ in index.windows(d.Words(pa.array([text])))}
    known = {tuple(b[i : i + 10]) for i in range(len(b) - 9)}
    assert found == {(i, 10) for i in range(len(a) - 9) if tuple(a[i : i + 10]) in known}


def test_size_of_the_index():
    """The index of a benchmark near its bound is what it is measured as, about ten times its text."""
    rng = random.Random(3)
    items = [(str(i), " ".join(f"w{rng.randint(0, 99999)}" for _ in range(100))) for i in range(2000)]
    index = d.Index(items)
    text = sum(len(t) + len(i) for i, t in items)
    assert index.nbytes < 8 * text and len(__import__("pickle").dumps(index)) < 1.2 * index.nbytes
    assert {n for _, _, found in index.windows(d.Words(__import__("pyarrow").array([items[7][1]]))) for n in found} == {"7"}
