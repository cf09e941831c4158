import random
import shlex

import pytest
from pyspark.sql import functions as F

from quarrylight.operators import submissions as S


def plain(events):
    """{id: (state, call, rejected)} event by event."""
    out = {}
    for i, _, a, c in sorted(events, key=lambda e: e[:2]):
        state, call, rejected = out.get(i, ("new", None, 0))
        to = S.TRANSITIONS.get(a, (None,) * 6)[S.STATES.index(state)]
        if to is None:
            rejected += 1
        else:
            call = c if a == "submit" and to == "submitted" != state else call
            state = to
        out[i] = state, call, rejected
    return out


@pytest.mark.parametrize("block", [1, 3, 4096])
def test_blocks_replay_as_single_events_do(spark, block):
    rng = random.Random(block)
    events = [(rng.randrange(6) if i % 3 else 0, i, rng.choice([*S.TRANSITIONS, "unknown"]), f"c{i}") for i in range(400)]
    for upto in (0, 1, 57, 400):
        df = spark.createDataFrame(events[:upto], "id long, seq long, action string, call string").repartition(3)
        got = {r["id"]: (r["state"], r["call"], r["rejected"]) for r in S.replayed(df, "id", ["seq"], "action", "call", block).collect()}
        assert got == plain(events[:upto])


LINES = [
    "pytest tests/a.py", "python3.8  -m unittest a.B", "", "   ", "# pytest x", "py.test 'a b' \"c d\"", "tox tests/t.py::A tests/u.py::b", "tox -e py38", "tox", "make test", "pytest a | tee", "pytest a; b", "pytest $X", "pytest `x`", "pytest 'open",
    "pytest a\\ b", 'pytest "a\\"b" "c\\d"', "pytest '' \"\"", "pytest a'b'\"c\"d", "pytest a\\", "pytest \"a 'b' c\"", "pytest 'a\\b'", "pytest \"a\\", "python", "pytest a && b",
]


def test_lines_part_as_shlex_parts_them(spark):
    rng = random.Random(7)
    lines = LINES + ["".join(rng.choice("ab '\"\\\t") for _ in range(rng.randrange(14))) for _ in range(500)]
    got = {r["i"]: r["w"] for r in spark.createDataFrame(list(enumerate(lines)), "i int, line string").select("i", S.words(F.col("line")).alias("w")).collect()}
    for i, line in enumerate(lines):
        try:
            want = shlex.split(line, posix=True)
        except ValueError:
            want = None
        assert got[i] == want, line


def test_only_test_commands_are_run(spark):
    texts = {
        "pytest a.py\n\n# note\npython3 -m unittest b": [["PY", "-m", "pytest", "a.py"], ["PY", "-m", "unittest", "b"]],
        "tox t.py::A": [["PY", "-m", "pytest", "t.py::A"]],
        "pytest 'a b'": [["PY", "-m", "pytest", "a b"]],
    } | dict.fromkeys(["", "# only", "tox -e x", "tox", "make", "pytest a\nls", "pytest a > b", "pytest 'x", "''"])
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "t string")
    got = {r["t"]: r["c"] for r in df.select("t", S.commands(F.col("t"), "PY").alias("c")).collect()}
    assert got == texts | {None: None}


def test_requirements(spark):
    df = spark.createDataFrame([("yaml.x", ["Foo==1", "PyYAML>=5"]), ("my_mod", ["my-mod [x]"]), ("cv2", []), ("other.part", ["x"])], "m string, r array<string>")
    assert [r[0] for r in df.select(S.requirement_for(F.col("m"), F.col("r"))).collect()] == ["PyYAML>=5", "my-mod [x]", "opencv-python", "other"]
    pins = spark.createDataFrame([("NumPy == 1.19.0rc2",), ("x==1",)], "r string")
    assert [r[0] for r in pins.select(S.installation_candidates(F.col("r"))).collect()] == [["NumPy == 1.19.0rc2", "numpy==1.19.0"], ["x==1"]]
