"""Queries against their SQL in DuckDB, on the given tables and on tables with planted cases."""

import random
from pathlib import Path

import duckdb
import pytest

from changelake.llm import licenses, queries

DATA = "/root/testdata/sf0.001"


def rows_of(spark, folder, name):
    duck = duckdb.connect()
    for path in Path(folder).glob("*.parquet"):
        duck.execute(f"create view {path.stem} as select * from read_parquet('{path}{'/*.parquet' if path.is_dir() else ''}')")
    found = duck.execute(queries.oracle_sql()[name])
    names = [c[0] for c in found.description]
    got = queries.queries()[name](spark, str(folder))
    assert sorted(names) == sorted(got.columns)
    plain = lambda rows: sorted((tuple(r) for r in rows), key=repr)
    return plain(got.select(*names).collect()), plain(found.fetchall())


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_given_tables(spark, name):
    got, want = rows_of(spark, DATA, name)
    assert len(want) > 50 and got == want


def test_planted_licenses(spark, tmp_path):
    """Whole notices, notices with words added, left out and repeated, and pieces below the share that counts."""
    rng = random.Random(3)
    noise = lambda n: " ".join(rng.choice(["ere", "thé", "GPL", "license", "mit", "the", "any", "of", "software"]) for _ in range(n))
    texts = [None, "", "MIT License", "mit-license,Apache  LICENSE", "general public\nlicense x general Public License", "mit\x80license"]
    for notices in licenses.TEMPLATES.values():
        for t in notices:
            words = t.split()
            for _ in range(6):
                a, b = sorted(rng.sample(range(len(words) + 1), 2))
                part = rng.choice([words, words[a:b], words[:a] + ["and", "more"] + words[a:], words[:a] + words[a + 1 :], [w for w in words if rng.random() < 0.95], words * 3])
                texts.append(f"{noise(rng.randint(0, 20))} {' '.join(part)} {noise(rng.randint(0, 30))} {' '.join(words[:a])}")
    docs = spark.createDataFrame(list(enumerate(texts)) + [(None, texts[20]), (7, texts[20])], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got, want = rows_of(spark, tmp_path, "op7_licenses")
    assert got == want and len({r[-1] for r in want}) > 100


def test_planted_turns(spark, tmp_path):
    rng = random.Random(5)
    rows = [(rng.choice([None, 1]), t, rng.choice(["user", "user", "assistant", "system", "tool", None]), rng.choice(["", " ", None, 'say "hi"\n\\ é', "x"])) for t in rng.sample(range(300), 270)]
    rows += [(9, None, "assistant", "late"), (9, None, "user", "no turn"), (8, 5, "assistant", "b"), (8, 5, "assistant", "a")]
    # Of equal turns any one may come first, so only equal rows repeat.
    rows = list({(c, t): (c, t, r, x) for c, t, r, x in rows}.values()) + [(8, 4, "user", "q")] * 2
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got, want = rows_of(spark, tmp_path, "op6_tool_calls")
    assert got == want and any(r[5] is not None and r[5] > 2 for r in want)
