"""Hard negatives against brute force and SQL."""

import random
from collections import Counter

import duckdb
import numpy as np
import pytest

from postmill.llm import hardneg
from postmill.llm.oracles import ORACLES
from postmill.llm.queries import op11_hard_negatives


def brute(rows, anchors, positives, negatives, least, most):
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for a in anchors:
        scored = sorted((-dot(a[2], r[2]), r[0], r[1] == a[1]) for r in rows if r[0] != a[0])
        for s, i, same in [x for x in scored if x[2]][:positives]:
            fit = [(n, t) for t, n, other in scored if not other and least * -s <= 100 * -t <= most * -s][:negatives]
            out += [(a[0], i, k + 1, n, -s, -t) for k, (n, t) in enumerate(fit)]
    return Counter(out)


def rows_of(df):
    return Counter(tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in df.collect())


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed):
    draw = random.Random(seed)
    centres = [[draw.randint(-40, 40) for _ in range(19)] for _ in range(4)]
    rows = []
    for i in range(400):
        c = draw.choice(centres)
        vector = [x + draw.randint(-9, 9) * (seed + 1) for x in c[: 19 if seed else draw.choice([0, 5, 19])]]
        rows.append((draw.randint(0, 350) if seed == 2 else i, draw.choice("aaab"), vector))
    rows += rows[:5]  # repeated rows
    df = spark.createDataFrame([r + ("x", 1) for r in rows] + [(None, "a", [1], "x", 1), (7, None, [1], "x", 1), (8, "a", None, "x", 1)], "vec_id bigint, label string, weights array<bigint>, score string, query_row int")
    got = rows_of(hardneg.mine(df, df.where("vec_id % 10 = 0"), 3, 4, 60, 110))
    assert got == brute(rows, [r for r in rows if r[0] % 10 == 0], 3, 4, 60, 110) and got


def test_many_blocks_with_floors(spark, monkeypatch):
    monkeypatch.setattr(hardneg, "LEAST_BLOCK", 16)
    monkeypatch.setattr(hardneg, "QUERY_BLOCK", 7)
    draw = np.random.default_rng(0)
    rows = [(i, "ab"[i % 9 == 0], [int(x) for x in draw.normal(10, 20, 24)]) for i in range(700)]
    df = spark.createDataFrame(rows, "vec_id bigint, label string, weights array<bigint>").repartition(4)
    assert rows_of(hardneg.mine(df, df.where("vec_id % 20 = 0"))) == brute(rows, [r for r in rows if r[0] % 20 == 0], 5, 5, 80, 100)


def test_pairs_at_and_below_the_threshold():
    draw = np.random.default_rng(3)
    for shape, spread in (((50, 9), 5), ((80, 64), 30), ((10, 1), 3)):
        x, q = draw.integers(-spread, spread, shape), draw.integers(-spread, spread, (6, shape[1]))
        rows = hardneg.Block(x.astype(float))
        scores = q @ x.T
        for least in (np.quantile(scores, [0, 0.2, 0.5, 0.9, 0.99, 1]), np.full(6, scores.max())):
            i, j, s = hardneg.reaching(rows, hardneg.Block(q.astype(float), rows.order), least)
            found = {(int(a), int(b)): int(c) for a, b, c in zip(i, j, s, strict=True)}
            assert found == {(a, b): int(scores[a, b]) for a in range(6) for b in range(len(x)) if scores[a, b] >= least[a]}


def test_huge_weights_stay_exact(spark):
    big = 1 << 30
    rows = [(0, "a", [big, 1]), (1, "a", [big, 3]), (2, "b", [big, 2]), (3, "b", [big, 1])]
    df = spark.createDataFrame(rows, "vec_id bigint, label string, weights array<bigint>")
    assert rows_of(hardneg.mine(df, df.where("vec_id = 0"))) == brute(rows, rows[:1], 5, 5, 80, 100)


def test_query_against_sql_and_odd_vectors(spark, sf, tmp_path):
    schema = "vec_id bigint, embedding array<float>, label int, score int"
    odd = [(i, [0.1 * (i % 5), 0.2, float(i % 3)], i % 2, 1) for i in range(230)] + [(300, None, 1, 1), (400, [1.0, None, 1.0], 1, 1), (500, [1.0, float("nan"), 0.0], 1, 1), (None, [1.0, 1.0, 1.0], 1, 1), (600, [0.0, 0.0, 0.0], None, 1)]
    spark.createDataFrame(odd, schema).write.parquet(f"{tmp_path}/odd/embeddings.parquet")
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/none/embeddings.parquet")
    assert op11_hard_negatives(spark, f"{tmp_path}/none").count() == 0
    for place, files in ((sf, "embeddings.parquet"), (f"{tmp_path}/odd", "embeddings.parquet/*.parquet")):
        duck = duckdb.connect()
        duck.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{place}/{files}')")
        want = Counter(duck.execute(f"SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM ({ORACLES['op11_hard_negatives']})").fetchall())
        assert rows_of(op11_hard_negatives(spark, place)) == want and want
