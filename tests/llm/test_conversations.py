"""Repair of conversations against SQL and against the cheapest way found without a search."""

import functools
import heapq
import random
import zlib
from collections import Counter

import duckdb
import pytest

from postmill.llm import conversations
from postmill.llm.oracles import ORACLES
from postmill.llm.queries import op12_conversation_repair

COLUMNS = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
SCHEMA = "conv_id bigint, turn bigint, role string, text string, part int, edits string, n_chars bigint"


def cheapest(rows):
    """Cost and edits by uniform-cost search over (cost, edits)."""
    heap, done = [(0, "", 0, 0)], set()
    while True:
        cost, edits, i, s = heapq.heappop(heap)
        if (i, s) in done:
            continue
        done.add((i, s))
        if i == len(rows) and s in (0, 3):
            return cost, edits
        nxt = 3 if s == 2 else 2
        heapq.heappush(heap, (cost + 2, edits + "I", i, nxt))
        if i < len(rows):
            initial, must_go, cut = rows[i]
            heapq.heappush(heap, (cost + 3, edits + "D", i + 1, s))
            if not must_go:
                heapq.heappush(heap, (cost + 2 + cut, edits + "R", i + 1, nxt))
                for kept, after in {"s": ((0, 1),), "u": ((0, 2), (1, 2), (3, 2)), "a": ((2, 3),)}.get(initial, ()):
                    if kept == s:
                        heapq.heappush(heap, (cost + cut, edits + "K", i + 1, after))


@pytest.mark.parametrize("seed", range(5))
def test_search_finds_the_cheapest_and_least(seed):
    draw = random.Random(seed)
    for _ in range(300):
        rows = [(draw.choice("suuaax "), draw.random() < 0.2, draw.random() < 0.2) for _ in range(draw.randint(0, 14))]
        assert conversations.Search(rows).plan() == cheapest(rows)


def test_plans_between_states_join_to_the_whole_plan():
    import pyarrow as pa

    draw = random.Random(1)
    for _ in range(60):
        rows = [(draw.choice("suuaax"), draw.random() < 0.2, draw.random() < 0.2) for _ in range(draw.randint(1, 40))]
        cuts = sorted({0, len(rows), *draw.choices(range(len(rows)), k=4)})
        parts = []
        for n, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            plans = conversations.Search(rows[a:b]).all_plans(rows[a:b])
            places = [sorted(x or "~" for x in own).index(e or "~") for own in ([p and p[1] for p in plans[4 * k : 4 * k + 4]] for k in range(4)) for e in own]
            parts.append({"part": n, "costs": [conversations.FAR if p is None else p[0] for p in plans], "places": places, "plans": plans, "first": "u", "last": "u"})
        chosen = conversations._chosen(pa.Table.from_pylist([{k: v for k, v in p.items() if k != "plans"} for p in parts])).to_pylist()
        plans = [parts[r["part"]]["plans"][4 * r["before"] + r["after"]] for r in chosen]
        tail = ("", "II", "I", "")[chosen[-1]["after"]]
        assert (sum(c for c, _ in plans) + 2 * len(tail), "".join(e for _, e in plans) + tail) == cheapest(rows)


def odd_rows(seed=0):
    draw = random.Random(seed)
    texts = ["Good.", "cut", "", " \t\n", "One!\n", None, "Größe?", "a.b", "x" * 5000 + "."]
    rows = [(draw.choice([1, 2, 3, None, 5]), draw.choice([0, 1, 2, 3, 4, 5, 9, None]), draw.choice(["system", "user", "assistant", "tool", None, ""]), draw.choice(texts)) for _ in range(120)]
    rows += [(7, i, "user" if i % 2 else "assistant", f"text {i % 40}.") for i in range(3000)]  # one conversation of many rows
    rows += [(8, 1, "user", "same text.")] * 700  # one row again and again
    rows += [(c, t, "user", "Hi.") for c in range(100, 200) for t in range(2)]
    rows += [(9, None, None, None), (10, -5, "system", "Only."), (10, 10, "assistant", "Far.")]
    return [r + (1, "x", 2) for r in rows]


def sql_rows(place):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{place}')")
    return Counter(duck.execute(f"SELECT {', '.join(COLUMNS)} FROM ({ORACLES['op12_conversation_repair']})").fetchall())


def spark_rows(df):
    return Counter(tuple(r[c] for c in COLUMNS) for r in df.collect())


@pytest.mark.parametrize("most_rows", [1024, 37])
def test_query_against_sql(spark, sf, tmp_path, most_rows, monkeypatch):
    rows = spark.createDataFrame(odd_rows(), SCHEMA)
    rows.repartition(3).write.parquet(f"{tmp_path}/odd/conversations.parquet")
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/none/conversations.parquet")
    monkeypatch.setattr(conversations, "repair", functools.partial(conversations.repair, part_rows=most_rows))
    assert op12_conversation_repair(spark, f"{tmp_path}/none").count() == 0
    want = sql_rows(f"{tmp_path}/odd/conversations.parquet/*.parquet")
    assert spark_rows(op12_conversation_repair(spark, f"{tmp_path}/odd")) == want and sum(want.values()) == len({r[0] for r in odd_rows()})
    assert spark_rows(op12_conversation_repair(spark, sf)) == sql_rows(f"{sf}/conversations.parquet")


def test_parts_are_real_messages(spark):
    rows = spark.createDataFrame([(1, i, ("user", "assistant")[i % 2], f"t{i}.") for i in range(500)] + [(2, 0, "user", "Hi."), (2, 1, "user", "Ho.")], "conv_id int, turn int, role string, text string")
    got = sorted(conversations.repair(rows, part_rows=50).collect(), key=lambda r: (r["conv_id"], r["part"]))
    messages = [(m["role"], m["text"]) for r in got for m in r["messages"] if r["conv_id"] == 1]
    assert messages == [(("user", "assistant")[i % 2], f"t{i}.") for i in range(500)]
    assert [(m["role"], m["text"]) for r in got for m in r["messages"] if r["conv_id"] == 2] == [("user", "Hi."), ("assistant", "Ho.")]


def test_damage_is_the_stated_one(spark, sf):
    rows = spark.read.parquet(f"{sf}/conversations.parquet")
    want = Counter()
    for r in rows.collect():
        kind = zlib.crc32(f"{r['conv_id']}:{r['turn']}".encode()) % 20
        text = "" if kind == 1 else r["text"].translate({ord(c): None for c in ".!?"}) if kind == 2 else r["text"]
        want[(r["conv_id"], r["turn"], "user" if kind == 4 else r["role"], text)] += (0, 1, 1, 2, 1)[kind] if kind < 5 else 1
    assert Counter(map(tuple, conversations.damage(rows).collect())) == +want
