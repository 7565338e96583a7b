import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def rows_of(texts, sources=("a", "b", None)):
    return [(i, t, "en", sources[i % len(sources)], len(t) if t is not None else None) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def texts():
    """Texts with copies, near copies, shared passages, nulls, empty ones and a very long one."""
    rnd = random.Random(3)
    vocab = [f"w{i}" for i in range(400)] + ["The", "of", "naïve", "Élan", "日本語", "it's", "x²"]
    text = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    out = [None, "", "   ", "\n\t", "one", "one two", "one two three", "a b c d", "A b C d", "a a a a a a a a a a a a a a a a a a a a a a a a a a"]
    base, passage = text(120), text(60)
    out += [base, base, base.upper(), base + " tail"]
    for k in range(12):
        words = base.split()
        for _ in range(k % 6):
            words[rnd.randrange(len(words))] = f"new{k}"
        out.append(" ".join(words))
    out += [f"{text(40)} {passage} {text(30)}" for _ in range(5)] + [f"{passage}\n{passage}"]
    out += [text(rnd.randrange(1, 60)) for _ in range(20)]
    out += [text(9000), "x" * 30000, "word joined   wide  blanks ", "<|endoftext|> inside <|endoftext|>text", "ΣΑΣ Σ İstanbul é ﬁ", "CC-BY 4.0; All Rights\nReserved. gnu General Public License"]
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    return spark.createDataFrame(rows_of(texts), DOCS).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def odd(spark):
    """Repeated rows, null ids, and further columns with the names that operators use themselves."""
    own = "row long, key string, component_id long, size long, rank int, w string, doc string, h1 string, block int, kept string, _text string, score string"
    rows = [(i, t, "en", s, None, 1, "k", 2, 3, 4, "w", "d", "h", 5, "kept", "t", "s") for i, t, s in (
        (1, "a b c d e f", "a"), (1, "a b c d e f", "a"), (None, "a b c d e f", None), (None, None, None), (2, None, "a"), (3, "a b c d e f", "b"))]
    return spark.createDataFrame(rows, f"{DOCS}, {own}")
