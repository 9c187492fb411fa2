import pytest


@pytest.fixture
def documents(spark):
    """Documents from texts, with odd rows if asked: nulls, empty texts, repeated rows."""
    def make(texts, sources=None, ids=None):
        rows = [(i if ids is None else ids[i], t, "en", (sources or ["a"] * len(texts))[i], None if t is None else len(t))
                for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return make


@pytest.fixture(scope="session")
def texts():
    """Some invented texts: prose, copies, near copies, shared passages, junk, odd ones."""
    import random

    rng = random.Random(5)
    vocabulary = ["w" + "".join(rng.choice("abcdeéfgß") for _ in range(rng.randint(1, 6))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    out = [prose(rng.randint(1, 300)) for _ in range(60)]
    out += [out[i] for i in range(0, 20, 3)] * 2  # copies
    for i in range(20, 40):  # near copies: one word in sixty changes
        words = out[i].split()
        out.append(" ".join(rng.choice(vocabulary) if rng.random() < 1 / 60 else w for w in words))
    passage = prose(60)
    out += [f"{prose(rng.randint(0, 90))} {passage[: rng.randint(100, 400)]}\n{prose(rng.randint(0, 50))}" for _ in range(15)]
    out += ["again " * 300, "ab cd " * 200, "again " * 120 + prose(40), "", None, " \n\t ", "one", "two words", "x" * 5000, None,
            "a\x85b\xa0c " * 60, passage + "\x0b" + passage]
    return out
