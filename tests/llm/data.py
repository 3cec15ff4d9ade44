"""Small documents with every awkward case."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, row long, component_id long, shard int, license string"


def rows(seed=5, n=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}é" if i % 7 == 0 else f"word{i}" for i in range(80)]
    out = []
    for i in range(n):
        out.append(" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 60))))
    out += [None, "", "   \n", None, "a", "A", out[0], out[0], out[1] + " extra", "x " * 3000, "ß" * 5000, "All rights reserved.", "tail  two spaces\n\nend. "]
    langs = ["en", None, "de"]
    made = [(i, t, langs[i % 3], None if i % 5 == 0 else f"s{i % 2}", None if t is None else len(t), 0.5, 1, 2, 3, "x") for i, t in enumerate(out)]
    return [*made, made[3]]


def docs(spark, **kw):
    return spark.createDataFrame(rows(**kw), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
