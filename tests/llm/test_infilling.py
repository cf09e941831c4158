import hashlib
import random
import re

import duckdb
from helpers import awkward, documents, empty
from pyspark.sql import functions as F

from quarrylight.llm import infilling as I


def brute(i, text):
    """The contract, word for word."""
    text = text or ""
    h = hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    tokens = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    n = len(tokens)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if text == "" or "<P>" in text or "<S>" in text or "<M>" in text or h3 % 100 >= 50:
        return n, "plain", None, None, text
    if h4 % 100 < 80:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def odd_texts():
    rng = random.Random(5)
    parts = ["a", "Bc", " ", "\n", "\t\x0b\x0c\r", " ", " ", "ß", "é", "日本", "\U0001f600", "<", ">", "<P", "S>", "\x00", "\x1c", "\x85", ".", "  "]
    out = ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(600)]
    return [*out, "x<P>y", "<M>", "<S> z", " ", " \t\n", "one", " lead", "trail "]


def test_equals_brute_force_and_round_trips(spark):
    rows = list(enumerate([*odd_texts(), None])) + [(None, "no id"), (3, "same id"), (3, "same id")]
    made = I.fill_in_middle(documents(spark, rows)).withColumn("back", I.restored(F.col("output"), F.col("form"))).collect()
    got = sorted(((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in made), key=repr)
    assert got == sorted(((i, *brute(i, t)) for i, t in rows), key=repr)
    assert {r["form"] for r in made} == {"plain", "psm", "spm"}
    texts = {(i, t or "") for i, t in rows}
    assert all((r["doc_id"], r["back"]) in texts for r in made)


def test_offsets_are_code_points_without_gaps():
    for t in odd_texts():
        ends = I.ends_of(t)
        assert ends == [m.end() for m in re.finditer(I.TOKEN, t)] and (ends[-1:] or [0]) == [len(t)]


def test_shares_are_parameters(spark):
    rows = [(i, f"word {i} and more words") for i in range(400)]
    of = lambda **k: [r["form"] for r in I.fill_in_middle(documents(spark, rows), I.Infilling(**k)).collect()]
    assert set(of(share=0)) == {"plain"} and set(of(share=100, spm=100)) == {"spm"} and set(of(share=100, spm=0)) == {"psm"}
    assert 140 < sum(f != "plain" for f in of()) < 260 and of(seed=1) != of(seed=2)


def test_awkward_rows(spark):
    docs = awkward(spark)
    made = I.fill_in_middle(docs).collect()
    assert len(made) == docs.count()
    by = {r["doc_id"]: r for r in made}
    assert (by[1]["n"], by[1]["form"], by[1]["output"]) == (0, "plain", "") and by[3]["n"] == 1 and by[6]["n"] == 40_000
    assert I.fill_in_middle(empty(spark)).count() == 0


def test_query_equals_its_sql(spark, sf_dir):
    got = sorted(map(tuple, I.op12_split_infilling(spark, sf_dir).collect()), key=repr)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").toPandas()  # noqa: F841
    assert got == sorted(duckdb.sql(I.OP12_SQL.replace("FROM documents", "FROM docs")).fetchall(), key=repr)
