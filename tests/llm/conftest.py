import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))

#: Names that the operators use for columns of their own.
CLASHING = "n_words kept digest bucket anchor regions spans assign hex node component rank length text_a n low".split()


@pytest.fixture(scope="session")
def texts():
    """(doc_id, text) rows with nulls, empty and long texts, copies, near copies, shared passages and repeated rows."""
    draw = random.Random(7)
    word = lambda: "".join(draw.choice("aeiounrst") for _ in range(draw.randint(2, 7)))
    passage = [word() for _ in range(70)]
    rows, base = [], [word() for _ in range(120)]
    for i in range(24):
        body = [word() for _ in range(draw.randint(0, 60))]
        if i % 3 == 0:
            at = draw.randint(0, len(body))
            body[at:at] = passage
        rows.append((i, " ".join(body)))
    for i in range(24, 36):
        near = list(base)
        for _ in range(i % 5):
            near[draw.randrange(len(near))] = word()
        rows.append((i, "  ".join(near) + "\n" * (i % 2)))
    long = " ".join(word() for _ in range(30000))
    rows += [(40, long), (41, "x" * 5000), (42, None), (43, ""), (44, " \t\n"), (45, "One two"), (46, "one TWO"), (47, "one two")]
    rows += [(48, "ümläut é 日本語 🙂 " * 20), (49, "\n".join(["same line here now"] * 9)), (50, rows[3][1]), (50, rows[3][1]), (None, rows[4][1])]
    return rows


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The rows with further columns, some of them named like the operators' own."""
    names = ["doc_id long", "text string", "lang string", "source string", "n_chars long"]
    names += [f"`{n}` string" for n in CLASHING]
    full = [(i, t, "en" if k % 2 else None, f"src{k % 3}", len(t or ""), *["z"] * len(CLASHING)) for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(full, ", ".join(names))


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
