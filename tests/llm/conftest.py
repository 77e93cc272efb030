import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, target double, tilt double"


def words(n: int, seed: int) -> list[str]:
    r = random.Random(seed)
    return ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6))) for _ in range(n)]


@pytest.fixture(scope="session")
def rows():
    """Documents with copies, near copies, nulls in every column, empty and long texts, a hot source and repeated rows; some columns clash with names used inside."""
    out = []
    for i in range(60):
        source = None if i % 13 == 0 else "hot" if i % 3 else f"s{i % 4}"
        out.append([i, " ".join(words(20 + 7 * (i % 9), i)), "en", source, i, 1.0, None])
    base = words(120, 999)
    for k in range(8):
        near = list(base)
        near[10 * k] = f"changed{k}"
        out.append([100 + k, " ".join(near), None, "hot", None, None, 2.0])
    out += [[200 + k, " ".join(base), "en", "s1", 1, None, None] for k in range(6)]
    out += [[300, None, "en", "s0", None, 0.0, 0.0], [301, "", None, None, 0, 0.0, 0.0], [302, " \n\t ", "en", "hot", 3, 0.0, 0.0], [303, "one", "en", "hot", 3, 0.0, 0.0], [None, "no id here at all", "en", "s2", 1, 0.0, 0.0]]
    out += [[304, "twice the same row", "en", "hot", 1, 0.0, 0.0]] * 2
    out += [[305, " ".join(words(9000, 5)), "en", "hot", 1, 0.0, 0.0]]
    return [tuple(r) for r in out]


@pytest.fixture(scope="session")
def docs(spark, rows):
    from marlstone.plans.scratch import cut

    return cut(spark.createDataFrame(rows, DOCS))


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCS)
