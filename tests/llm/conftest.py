import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, idx long, r int, label string"


def brute_components(nodes, linked):
    """Smallest member per connected group, by plain union."""
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


@pytest.fixture(scope="session")
def texts():
    """Ids and texts: null, empty, blank, one word, long, copies, near copies, repeated passages, other scripts."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice(["the", "on", "re", "in", "er", "at", "É", "ß"]) for _ in range(rng.randrange(1, 4)))
    base = [word() for _ in range(300)]
    passage = [word() for _ in range(70)]
    near = base[:150] + ["changed"] + base[151:]
    texts = [None, "", "  \n\t ", "word", " ".join(base), " ".join(base), "\n".join(base), " ".join(near), " ".join(base[:40] + passage + base[200:260])]
    texts += [" ".join([word() for _ in range(30)] + passage + [word() for _ in range(20)]) for _ in range(3)]
    texts += [" ".join(word() for _ in range(9000)), "日本語 テキスト \x1c 　 ΣΑΣ İ <|endoftext|>", "a b c", "A B C"]
    texts += [" ".join(word() for _ in range(rng.randrange(1, 90))) for _ in range(25)]
    return [(100 - 2 * i, t) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The texts with columns whose names the operators use inside."""
    rows = [(i, t, None if i % 3 else "en", None if i % 5 == 0 else f"s{i % 4}", len(t or ""), 1, 2, "x") for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def odd(spark):
    """Repeated rows, two texts under one id and rows without id."""
    rows = [(1, "a b c d e f", None, None, 3, 1, 2, "x")] * 3 + [(1, "other words", "en", "s", 1, 1, 2, "x"), (None, "a b c d e f", "en", "s", 1, 1, 2, "x"), (None, None, None, None, None, None, None, None), (2, None, "en", "s", 1, 1, 2, "x")]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
