"""Documents with everything that may go wrong, for all operators."""

import random

import pytest

WORDS = [f"{a}{b}" for a in ("ka", "lo", "mi", "ne", "pu", "ra", "so", "ti") for b in ("dan", "fer", "gil", "hor", "jun", "kel", "lim", "nos")]
#: names that operators use inside, as columns of the input
CLASHES = ["k", "bands", "th", "row", "weight", "h", "size", "copies", "shard", "slot", "target", "rank", "source_size", "skey", "part", "n_words", "id", "class_id", "kept", "y", "score", "a.b", "slot.", "key_a", "own_a", "copy", "words", "n_hit", "x", "digest"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHES)


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def edited(rng, text, share):
    words = text.split()
    for _ in range(max(1, int(share * len(words)))):
        words[rng.randrange(len(words))] = rng.choice(WORDS)
    return " ".join(words)


@pytest.fixture(scope="session")
def texts():
    """Id and text: originals, exact and near copies, shared passages, nulls, empty and blank ones, a very long one, repeated ids and rows."""
    rng = random.Random(5)
    out, n = [], 0
    for _ in range(40):
        base = sentence(rng, rng.choice((12, 60, 150)))
        for share in (0, 0, 0.005, 0.01, 0.02, 0.1, 0.3)[: rng.randrange(1, 8)]:
            out.append((n, edited(rng, base, share) if share else base))
            n += 1
    passage = sentence(rng, 60)
    out += [(n + i, sentence(rng, 80) + " " + passage + " " + sentence(rng, 80)) for i in range(4)]
    n += 4
    out += [(n, None), (n + 1, ""), (n + 2, " \n\t "), (n + 3, "one"), (n + 4, "two words"), (n + 5, "?!,."), (None, "a text without an id at all"), (None, None), (n + 6, sentence(rng, 30_000))]
    out += [(n + 7, "Größe naïve café 日本語 текст " * 3), (n + 8, out[0][1].upper()), (5, out[5][1]), (5, sentence(rng, 20))]
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(i, t, [None, "en", "de"][k % 3], [None, "web", "web", "web", "books"][k % 5], len(t or ""), *["x"] * len(CLASHES)) for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.01"
