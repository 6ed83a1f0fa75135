import random

import pytest

SMALL_DIR = "/root/testdata/sf0.001"

DOCS = "doc_id long, text string, lang string, source string, score double, n_tokens long, hash long, fp long, words array<string>, blob string"


def doc(i, text, lang="en", source="a"):
    """A row with columns whose names the operators use inside."""
    return (i, text, lang, source, 0.5, 7, 1, 2, ["x"], "b")


def prose(seed, words):
    r = random.Random(seed)
    return " ".join("".join(r.choice("the an or in es ti ou sh ly re".split()) for _ in range(r.randint(1, 4))) + r.choice(["", "", "", ".", ","]) for _ in range(words))


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls, empty and very long texts, exact and near copies, repeated rows, marks of many kinds."""
    base = prose(1, 120)
    near = base.split()
    near[60] = "changed"
    rows = [
        doc(0, None), doc(1, ""), doc(2, " \n\t "), doc(3, base), doc(4, base), doc(5, " ".join(near)), doc(6, prose(2, 40000)), doc(7, "é漢字 😀 don't 12,5 <|endoftext|> \x1c a b"),
        doc(8, "one"), doc(8, "one"), doc(None, prose(3, 30)), doc(9, prose(4, 300) + "\n" + base), doc(10, base.upper()), doc(11, "x" * 5000), doc(12, "one", None), doc(-5, prose(5, 50)),
    ]
    return spark.createDataFrame(rows, DOCS)


CLASHES = "doc_id long, text string, row int, id string, no_id boolean, body string, gone int, held int, row_key long, fp long, line string, words string, hits int, item long, lines int, `a.b` int"


@pytest.fixture(scope="session")
def hard_docs(spark):
    """Rows without an id, ids with several texts, repeated rows, and columns with names that the operators use inside."""
    a, b, c = prose(61, 150), prose(62, 150), prose(63, 150)
    ids = [(None, a), (None, b), (None, c), (None, a), (3, a), (5, a), (5, b), (5, c), (5, c), (1, prose(64, 90) + ". " + a), (1, prose(65, 90) + ". " + a), (None, None), (7, None), (8, "")]
    return spark.createDataFrame([(i, t, 1, "x", False, "y", 2, 3, 4, 5, "z", "w", 6, 7, 8, 9) for i, t in ids], CLASHES)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
