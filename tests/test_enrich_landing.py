"""Calls that fail for some keys, dictionary refresh, and folders looked at again."""
import os
import tempfile

import pandas as pd

from tidemark.operators.enrich import answers_or_errors, ask_missing, enrich_reporting
from tidemark.plans.pipelines import dictionary_refresh
from tidemark.sources.curated import committed_versions, publish, read_curated
from tidemark.sources.landing import scan_landing


def _answer(keys):
    return pd.DataFrame({"keyword": "K-" + keys, "warning": "W-" + keys})


def test_a_failing_key_fails_alone():
    calls = []

    def fn(keys):
        calls.append(list(keys))
        if keys.str.startswith("bad").any():
            raise ValueError("no " + ",".join(k for k in keys if k.startswith("bad")))
        return _answer(keys)

    keys = pd.Series([f"k{i}" for i in range(20)] + ["bad1"] + [f"m{i}" for i in range(20)] + ["bad2"])
    got = answers_or_errors(fn, keys, ["keyword", "warning"], attempts=3)
    assert list(got["keyword"].where(got["error"].isna()).dropna()) == ["K-" + k for k in keys if not k.startswith("bad")]
    assert dict(zip(keys, got["error"]))["bad1"] == "ValueError: no bad1"
    assert [c for c in calls if len(c) == 1].count(["bad1"]) == 3 and len(calls) <= 2 * len(keys) + 6


def test_a_key_that_answers_at_last_and_wrong_numbers_of_rows():
    left = {"k": 2}

    def flaky(keys):
        left["k"] -= 1
        if left["k"] >= 0:
            raise OSError("busy")
        return _answer(keys)

    assert answers_or_errors(flaky, pd.Series(["k"]), ["keyword", "warning"], attempts=3)["error"][0] is None
    short = answers_or_errors(lambda keys: _answer(keys).iloc[:1], pd.Series(["a", "b"]), ["keyword", "warning"])
    assert list(short["keyword"]) == ["K-a", "K-b"]
    none = answers_or_errors(lambda keys: _answer(keys).iloc[:0], pd.Series(["a"]), ["keyword", "warning"])
    assert none["error"][0] == "ValueError: 0 answers to 1 keys"


def failing():
    """A model that fails for some keys (made here: workers do not import this module)."""
    def fn(keys):
        import pandas as pd
        if keys.str.startswith("bad").any():
            raise ValueError("no answer")
        return pd.DataFrame({"keyword": ["" if k == "blank" else "K-" + k for k in keys], "warning": "W"})
    return fn


def test_errors_become_rows_that_are_counted(spark):
    rows = spark.createDataFrame([(i, k) for i, k in enumerate(["a", "bad1", "known", "blank", " a ", "bad2", None, ""])], "_seq long, code string")
    dim = spark.createDataFrame([("known", "old", "w", 0)], "work string, keyword string, warning string, _seq long")
    filled, new_dim, outcome = enrich_reporting(rows, "code", dim, failing())
    got = {r._seq: r.risk_keywords for r in filled.collect()}
    assert got == {0: "K-a", 1: None, 2: "old", 3: None, 4: "K-a", 5: None, 6: None, 7: None}
    assert sorted(r.work for r in new_dim.collect()) == ["a", "known"]
    assert outcome.first().asDict() == {"keys": 4, "ok": 1, "failed": 3, "added": 1, "first_error": "ValueError: no answer"}
    asked = {r.work: (r.keyword, r.error) for r in ask_missing(rows, "code", dim, failing()).collect()}
    assert asked["blank"] == (None, None) and asked["bad2"] == (None, "ValueError: no answer")


def test_refresh_merges_into_the_newest_dictionary(spark):
    root = tempfile.mkdtemp(prefix="tm-refresh-")
    rows = spark.createDataFrame([(0, "a"), (1, "other"), (2, "bad")], "_seq long, code string")
    filled, outcome = dictionary_refresh(rows, "code", root, "mapping", failing())
    assert {r.code: r.risk_keywords for r in filled.collect()} == {"a": "K-a", "other": "K-other", "bad": None}
    assert outcome.first()["failed"] == 1
    # another writer adds an entry: the next refresh keeps it and asks only for what is still missing
    both = read_curated(spark, root, "mapping").unionByName(spark.createDataFrame([("bad", "by hand", "w", 9)], read_curated(spark, root, "mapping").schema))
    publish(both, root, "mapping")
    filled, outcome = dictionary_refresh(rows, "code", root, "mapping", failing())
    assert {r.code: r.risk_keywords for r in filled.collect()}["bad"] == "by hand" and outcome.first()["keys"] == 0
    assert len(committed_versions(spark, root, "mapping")) == 2


def test_scan_landing(spark):
    root = tempfile.mkdtemp(prefix="tm-scan-")
    folder = f"{root}/land"
    os.makedirs(folder)
    for name in "abc":
        with open(f"{folder}/{name}.csv", "w") as f:
            f.write(name)
    states = lambda: {r.file_name: r.state for r in scan_landing(spark, folder, root, glob="*.csv").collect()}
    assert states() == {"a.csv": "new", "b.csv": "new", "c.csv": "new"}
    assert set(states().values()) == {"same"}
    with open(f"{folder}/a.csv", "w") as f:
        f.write("longer")
    os.utime(f"{folder}/b.csv", (1, 1))
    os.remove(f"{folder}/c.csv")
    with open(f"{folder}/d.csv", "w") as f:
        f.write("d")
    assert states() == {"a.csv": "changed", "b.csv": "changed", "c.csv": "gone", "d.csv": "new"}
    assert states() == {"a.csv": "same", "b.csv": "same", "d.csv": "same"}
