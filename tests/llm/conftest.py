import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """documents-like frame of (doc_id, text) rows, with extra columns whose names operators use inside."""
    def make(rows, extra=True):
        frame = spark.createDataFrame([(i, t, "en", "src0", None if t is None else len(t)) for i, t in rows], SCHEMA)
        if extra:
            for name in ("row", "key", "pos", "n", "rep", "version", "found", "score", "kept", "id"):
                frame = frame.selectExpr("*", f"'clash' AS `{name}`")
        return frame
    return make


@pytest.fixture(scope="session")
def corpus():
    """Random texts with copies, near copies, shared passages, repeated lines, nulls, empty and long ones."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 9))) for _ in range(400)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, lines = say(40), [say(6) for _ in range(8)]
    rows = [(100, None), (101, ""), (102, " \n\t "), (103, "one"), (104, "One two three"), (105, "one two THREE")]
    for k in range(30):
        rows.append((k, say(rng.randint(1, 60))))
    base = say(80)
    for k in range(40, 60):
        own = base.split(" ")
        own[rng.randrange(80)] = "changed"
        rows.append((k, " ".join(own)))
    rows += [(k, base) for k in range(60, 75)]
    rows += [(k, say(5) + "\n" + passage + "\n" + say(9)) for k in range(200, 206)]
    rows += [(k, "\n".join([say(4), *lines[k % 3:k % 3 + 5], say(3)])) for k in range(210, 220)]
    rows.append((300, "ab" * 400 + " " + "x" * 700))
    rows.append((301, say(6000)))
    rows.append((None, base))
    rows.append((7, rows[13][1]))
    rows.append((60, base))
    rng.shuffle(rows)
    return rows
