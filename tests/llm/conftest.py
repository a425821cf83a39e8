import random

import pytest


@pytest.fixture(scope="session")
def awkward(spark):
    """Rows with nulls, empty, blank and long texts, exact and near copies, repeated ids, and clashing extra columns."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdeéßλ") for _ in range(rng.randint(1, 6))) for _ in range(300)]
    words = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    base = [words(rng.randint(1, 160)) for _ in range(40)]
    passage = words(60)
    texts = [" ".join(w) for w in base]
    texts += [" ".join(w[:50] + ["zzz"] + w[51:]) for w in base[:10]] + texts[:7] + texts[:2]
    texts += [" ".join(words(20) + passage + words(9)) + "\n" for _ in range(4)]
    texts += [None, "", " \t\n", "\x0b", "one", "one two", "One  TWO", "a b c", "x\x00y z", " ".join(passage * 3), "😀 end", "Ünï " * 80]
    texts += [" ".join(words(30_000))]
    rows = [(i, t, rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "s3", None]), len(t) if t else None, "t", 7) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3][:1] + ("same id, other text",) + rows[3][2:], (None, "no id", None, None, None, None, None)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, bucket string, n_words int").repartition(3)
    return df.checkpoint()


@pytest.fixture(scope="session")
def nothing(awkward):
    return awkward.where("doc_id < 0")
