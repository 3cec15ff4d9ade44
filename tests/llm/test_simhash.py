import random
import re

import numpy as np
import pyarrow as pa
import xxhash

from graphonic.llm import simhash as s

from .data import docs, empty


def fingerprint(text, n=3):
    w = [x for x in re.split(r"[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + n]), 42) for i in range(max(1, len(w) - n + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(pairs):
    fp = sorted((i, fingerprint(t)) for i, t in pairs)
    group = {i: i for i, _ in fp}
    changed = True
    while changed:
        changed = False
        for i, x in fp:
            for j, y in fp:
                if bin(x ^ y).count("1") <= 2 and group[i] != group[j]:
                    group[i] = group[j] = min(group[i], group[j])
                    changed = True
    return sorted((i, f"{x:016x}", group[i]) for i, x in fp)


def test_equals_brute_force(spark, tmp_path, monkeypatch):
    df = docs(spark)
    pairs = [(r.doc_id, r.text) for r in df.collect()]
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(tuple(r) for r in s.op4_simhash_near_dedup(spark, str(tmp_path)).collect())
    assert got == components(pairs)


def test_empty_table(spark):
    assert s.near_duplicates(empty(spark)).count() == 0


def test_long_chain_of_links(spark):
    """Fingerprints that each differ from the next in two bits are one component."""
    rng, x, chain = random.Random(4), 12345, []
    bits = rng.sample(range(64), 60)
    for k in range(30):
        chain.append(x)
        x ^= 1 << bits[2 * k] | 1 << bits[2 * k + 1]
    signed = np.array(chain, np.uint64).view(np.int64).tolist()
    order = list(range(30))
    rng.shuffle(order)
    distinct = spark.createDataFrame([(signed[k], i + 100) for i, k in enumerate(order)], "fp long, rep long")
    named = s.links(distinct)
    edges = named.join(distinct.toDF("a", "ra"), "a").join(distinct.toDF("b", "rb"), "b").selectExpr("ra as a", "rb as b")
    assert {r.component for r in s.components(edges).collect()} == {100}


def test_replicas_are_never_broadcast(spark):
    """At the threshold that Spark has by itself, where the planner takes the replicas for a small table."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10485760b")
    try:
        distinct = spark.range(1000).selectExpr("xxhash64(id) as fp", "id as rep").unionAll(spark.createDataFrame([(5, 2000), (6, 2001)], "fp long, rep long"))
        found = s.links(distinct)
        assert (5, 6) in {tuple(r) for r in found.collect()}
        assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_covering_finds_every_link():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    for flips in (0, 1, 2):
        y = x.copy()
        for _ in range(flips):
            y ^= np.uint64(1) << rng.integers(0, 64, len(y)).astype(np.uint64)
        row, anchor = s.covering(y)
        met = set(zip(row.tolist(), anchor.tolist()))
        assert len(met) == len(row) and all((i, int(h)) in met for i, h in enumerate(s.homes(x)))


def test_fingerprints_of_sliced_and_null_columns():
    texts = ["one two three four", None, "", "a", "ÀB c", "x " * 50]
    column = pa.array(["skip", *texts]).slice(1)
    assert s.fingerprints(column).tolist() == [fingerprint(t) for t in texts]


def shingles(text, n=5):
    w = [x for x in re.split(r"[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def alike(a, b):
    return 1.0 if a == b else len(a & b) / len(a | b)


def groups(pairs):
    """Brute force of ``similar``: every pair whose sets of five-word shingles have a similarity of 0.8 or more."""
    sets = [(i, shingles(t)) for i, t in pairs]
    group = s._Forest()
    for k, (i, x) in enumerate(sets):
        for j, y in sets[:k]:
            if min(len(x), len(y)) >= 0.8 * max(len(x), len(y)) and alike(x, y) >= 0.8:
                group.joins(i, j)
    return {i: group.root(i) for i, _ in sets}


def test_similar_equals_brute_force(spark):
    rng = random.Random(6)
    base = [" ".join(f"t{rng.randint(0, 400)}" for _ in range(150)) for _ in range(12)]
    near = [" ".join("new" if k == i else w for k, w in enumerate(t.split())) for i, t in enumerate(base)]
    repeated = ["spam " * 400 + f"tail {k} of its own, tail {k}" for k in range(4)]  # equal fingerprints but for a few shingles
    pairs = sorted([(r.doc_id, r.text) for r in docs(spark).dropDuplicates(["doc_id"]).collect()] + [(1000 + i, t) for i, t in enumerate(base + near + repeated)])
    df = spark.createDataFrame(pairs, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in s.similar(df).collect()}
    assert got == groups(pairs)
    assert all(got[1000 + i] == got[1012 + i] for i in range(12)) and len({got[1000 + i] for i in range(12)}) == 12
    assert s.similar(empty(spark)).count() == 0


def test_similar_finds_pairs_at_the_threshold(spark):
    """Of pairs at a similarity of 0.8 to 0.83, at least 0.95 are found; below 0.8, none."""
    rng = random.Random(12)
    pairs, kind = [], {}
    while len(kind) < 400:
        words = [f"v{rng.randint(0, 30000)}" for _ in range(rng.randint(80, 400))]
        other = list(words)
        for k in rng.sample(range(len(words)), max(1, int(len(words) * rng.uniform(0.015, 0.035)))):
            other[k] = f"v{rng.randint(0, 30000)}"
        a, b = " ".join(words), " ".join(other)
        x = alike(shingles(a), shingles(b))
        if 0.76 <= x < 0.83:
            n = 10 * len(kind)
            kind[n] = x >= 0.8
            pairs += [(n, a), (n + 1, b)]
    df = spark.createDataFrame(pairs, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in s.similar(df).collect()}
    found = {n: got[n] == got[n + 1] for n in kind}
    assert all(kind[n] for n in kind if found[n])
    assert sum(found[n] for n in kind if kind[n]) >= 0.95 * sum(kind.values()) > 50


def test_large_groups_are_compared_in_blocks(spark):
    """Anchors and groups beyond the bounds: the same groups as in one piece."""
    rng = random.Random(9)
    words = [f"t{rng.randint(0, 5000)}" for _ in range(400)]
    texts = [" ".join(w if k != i else "new" for k, w in enumerate(words)) for i in range(120)]
    chain = [words[k : k + 200] for k in range(0, 200, 8)]  # each like the next, not like those further on
    pairs = [(i, t) for i, t in enumerate(texts)] + [(500 + i, texts[0]) for i in range(50)] + [(700 + i, " ".join(w)) for i, w in enumerate(chain)]
    df = spark.createDataFrame(pairs, "doc_id long, text string").repartition(5)
    want = groups(pairs)
    assert {want[i] for i in range(550) if i in want} == {0} and {want[700 + i] for i in range(25)} == {700}
    assert {r.doc_id: r.component_id for r in s.similar(df).collect()} == want
    own = [(i, *np.ascontiguousarray(x).view(np.int64).tolist()) for (i, _), x in zip(pairs, s.several_fingerprints(s.Shingles(pa.array([t for _, t in pairs])), s.PRINTS))]
    distinct = spark.createDataFrame(own, ", ".join(["rep long", *(f"f{k} long" for k in range(s.PRINTS))]))
    whole = {r.node: r.component for r in s.components(s.candidates(distinct)).collect()}
    for rows in (7,):
        assert {r.node: r.component for r in s.components(s.candidates(distinct, block_rows=rows)).collect()} == whole
    known = spark.createDataFrame([(i, 0, t) for i, t in pairs], "rep long, component long, text string")
    for size in (20_000,):
        got = {r.node: r.component for r in s.components(s.verified(known, block_bytes=size)).collect()}
        assert {i: got.get(i, i) for i, _ in pairs} == want


def test_chunks_of_sorted_rows():
    rng = np.random.default_rng(1)
    for most in (1, 2, 5, 100):
        for _ in range(40):
            key = np.sort(rng.integers(0, 4, rng.integers(0, 30)))
            cuts = np.sort(rng.integers(0, len(key) + 1, 3))
            batches = [pa.RecordBatch.from_arrays([pa.array(k), pa.array(v)], names=["k", "v"]) for k, v in zip(np.split(key, cuts), np.split(np.arange(len(key)), cuts))]
            seen = list(s._chunks(iter(batches), most))
            assert np.concatenate([r[:, 1] for r, _ in seen]).tolist() == list(range(len(key))) if seen else not len(key)
            whole = [k for r, b in seen if b is None for k in set(r[:, 0].tolist())]
            parts = {}
            for r, b in seen:
                if b is not None:
                    assert len(set(r[:, 0].tolist())) == 1 and len(r) <= most
                    parts.setdefault(int(r[0, 0]), []).append(b)
            assert len(whole) == len(set(whole)) and not set(whole) & set(parts)
            assert all(b == list(range(len(b))) for b in parts.values())
            assert all((key == k).sum() > most for k in parts)
            assert all((key == k).sum() <= most + max(len(b) for b in batches) for k in whole)


def test_rows_of_an_anchor_are_linked_through_each_other(monkeypatch):
    """What is near a row that another has reached is linked, in any order of the rows."""
    rng = np.random.default_rng(8)
    for order in range(4):
        fps = [rng.integers(0, 2**63, s.SHOWN, dtype=np.uint64) for _ in range(3)]
        for k in range(177):  # chains: each row 30 bits from one before
            row = fps[max(0, k - int(rng.integers(1, 9)))].copy()
            for bit in rng.choice(64 * s.SHOWN, 30, replace=False).tolist():
                row[bit // 64] ^= np.uint64(1 << bit % 64)
            fps.append(row)
        rows = np.array(fps)[rng.permutation(len(fps))]
        close = np.bitwise_count(rows[:, None] ^ rows).sum(axis=2, dtype=np.int64) <= s.MOST_BITS
        want, got = s._Forest(), s._Forest()
        for a, b in np.argwhere(close).tolist():
            want.joins(a, b)
        monkeypatch.setattr(s, "STEP", 500 if order % 2 else 1_000_000, raising=False)
        for i, j in s._close_rows(rows, s.MOST_BITS):
            assert close[i, j].all()
            for a, b in zip(i.tolist(), j.tolist()):
                assert got.joins(a, b)
        assert [got.root(x) for x in range(len(rows))] == [want.root(x) for x in range(len(rows))]
