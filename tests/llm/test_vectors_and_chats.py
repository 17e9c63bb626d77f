"""Searches against brute force, and quotation linking against SQL."""

import math

import duckdb
import numpy as np
import pytest

from tamarack.llm import chat_quotes, cross_polytope, queries, va_topk

ODD = [(901, None), (902, []), (903, [0.0] * 8), (904, [float("nan")] + [1.0] * 7), (905, [float("inf")] + [1.0] * 7), (906, [None] + [1.0] * 7), (None, [1.0] * 8), (907, [1.0] * 5)]


def vectors(n, dim=8, seed=1):
    x = np.random.default_rng(seed).normal(0, 0.4, (n, dim)).round(3)
    x[n // 2 : n // 2 + n // 8] = x[0]  # ties
    return x


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, id int, cell int").repartition(3)


def test_neighbours(spark):
    x = vectors(400)
    df = frame(spark, [(i, v.tolist()) for i, v in enumerate(x)] + ODD)
    got = cross_polytope.nearest_neighbours(df, df.where("vec_id % 20 = 0 or vec_id = 907"), 10).collect()
    hits = 0
    for q in range(0, 400, 20):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        want = np.lexsort((np.arange(400), d))[:10]
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in mine] == list(range(1, 11))
        assert all(math.isclose(r.score, d[r.vec_id], rel_tol=1e-12, abs_tol=1e-15) for r in mine)
        assert [(r.score, r.vec_id) for r in mine] == sorted((r.score, r.vec_id) for r in mine)
        hits += len({r.vec_id for r in mine} & set(want.tolist()))
    assert hits >= 0.9 * 200 and {r.query_id for r in got} == set(range(0, 400, 20))
    assert cross_polytope.nearest_neighbours(frame(spark, []), frame(spark, [])).count() == 0


def test_recall_on_the_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = {(r.query_id, r.vec_id) for r in cross_polytope.nearest_neighbours(df, df.where("vec_id % 100 = 0")).collect()}
    table = df.collect()
    ids, x = np.array([r.vec_id for r in table]), np.array([r.embedding for r in table], float)
    want = set()
    for q in np.flatnonzero(ids % 100 == 0):
        d = ((x - x[q]) ** 2).sum(1)
        d[q] = np.inf
        want |= {(ids[q], ids[j]) for j in np.lexsort((ids, d))[:10]}
    assert len(got & want) >= 0.9 * len(want)


@pytest.mark.parametrize("n, dim, least", [(8, 8, 1), (8, 64, 1), (500, 64, 0.98), (500, 200, 0.98)])
def test_recall_over_all_rows(spark, n, dim, least):
    x = np.random.default_rng(7).normal(size=(n, dim))
    df = frame(spark, [(i, v.tolist()) for i, v in enumerate(x)])
    got = {(r.query_id, r.vec_id) for r in cross_polytope.nearest_neighbours(df, df, 10).collect()}
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    want = {(i, int(j)) for i in range(n) for j in np.argsort(d[i])[: min(10, n - 1)]}
    assert len(got) == len(want) and len(got & want) >= least * len(want)


def test_rotation_keeps_length():
    x = np.random.default_rng(1).normal(size=(5, 6))
    reach = cross_polytope.axes(x, 3)
    assert reach.shape == (5, 16) and np.allclose((reach[:, :8] ** 2).sum(1), 1)


@pytest.mark.parametrize("block, bits", [(16384, 6), (50, 2)])
def test_products(spark, monkeypatch, block, bits):
    """Also with few cells, several blocks of queries and many sifted chunks."""
    monkeypatch.setattr(va_topk, "ROWS", block)
    monkeypatch.setattr(va_topk, "QUERIES", max(7, block // 10))
    monkeypatch.setattr(va_topk, "CHUNKS", 2)
    monkeypatch.setattr(va_topk, "BLOCK_BYTES", block * 10)
    monkeypatch.setattr(va_topk.Cells.__init__, "__defaults__", (bits,))
    x = vectors(300)
    df = frame(spark, [(i, v.tolist()) for i, v in enumerate(x)] + ODD)
    got = va_topk.top_products(df, df.where("vec_id % 20 = 0"), 20).collect()
    w = np.floor(64 * np.vstack([x, np.zeros(8)])).astype(int)
    ids = np.array([*range(300), 903])
    for q in range(0, 300, 20):
        s = w @ w[q]
        order = [k for k in np.lexsort((ids, -s)) if ids[k] != q][:20]
        assert sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q) == [(n, ids[k], s[k]) for n, k in enumerate(order, 1)]
    assert va_topk.top_products(frame(spark, []), frame(spark, [])).count() == 0


def test_products_of_rows_with_one_id(spark):
    """Several vectors of one id count once, with the best; 25 of them don't hide others."""
    x = vectors(40, 4, 3)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(7, (v * 1.5).tolist()) for v in x[:25]]
    got = va_topk.top_products(frame(spark, rows), frame(spark, rows[:3]), 5).collect()
    w = np.floor(64 * np.array([v for _, v in rows])).astype(int)
    for q in range(3):
        best = {}
        for (i, _), s in zip(rows, (w @ w[q]).tolist()):
            if i != q:
                best[i] = max(s, best.get(i, s))
        want = sorted(best.items(), key=lambda t: (-t[1], t[0]))[:5]
        assert sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q) == [(n, i, s) for n, (i, s) in enumerate(want, 1)]


def test_large_numbers(spark):
    """Products of 2**60 are exact, larger ones raise; distances hold up to the range of doubles."""
    big = [(0, [2.0**23, 2.0**23 + 0.5]), (1, [2.0**23, 1.0]), (2, [-(2.0**23), 2.0**23]), (3, [2.0**23 - 0.25, 2.0**23])]
    got = va_topk.top_products(frame(spark, big), frame(spark, big), 3).collect()
    w = [[int(64 * c) for c in v] for _, v in big]
    assert {(r.query_id, r.vec_id): r.score for r in got} == {(i, j): sum(a * b for a, b in zip(w[i], w[j])) for i in range(4) for j in range(4) if i != j}
    for huge in (1e18, 1e16):
        rows = frame(spark, [(0, [huge, huge]), (20, [huge, 1.0])])
        with pytest.raises(OverflowError):
            va_topk.top_products(rows, rows, 2)
    rows = frame(spark, [(0, [1e200, 0.0]), (1, [1e200, 3e200]), (2, [1e-200, 0.0]), (3, [1e-200, 2e-200]), (4, [1e-3, 1.0])])
    got = {(r.query_id, r.vec_id): r.score for r in cross_polytope.nearest_neighbours(rows, rows, 4).collect()}
    assert math.isclose(got[0, 1], 3e200) and math.isclose(got[3, 2], 2e-200) and len(got) == 20


def test_few_rows(spark):
    df = frame(spark, [(0, [1.0, 2.0]), (20, [1.0, 2.0]), (20, [1.0, 2.0])])
    assert sorted((r.query_id, r.rank, r.vec_id) for r in va_topk.top_products(df, df, 20).collect()) == [(0, 1, 20), (20, 1, 0)]
    assert sorted((r.query_id, r.rank, r.vec_id) for r in cross_polytope.nearest_neighbours(df, df).collect()) == [(0, 1, 20), (20, 1, 0)]


CHATS = [
    (1, 0, "user", "Hello there\nHow  are you?\n\nbye"),
    (1, 1, "assistant", "> how are YOU?\nFine."),
    (1, 2, "user", ">> How are you?\n> Fine.\nGood\n"),
    (1, 3, "user", "> hello there\n>   bye\n> Good\nAnother thread"),
    (1, 4, "assistant", " >not said by anyone\n>\nx"),
    (1, 4, "assistant", " >not said by anyone\n>\nx"),
    (2, 0, "user", "> quotes what comes later"),
    (2, 1, "user", "quotes what comes later"),
    (2, 2, None, None),
    (None, 0, "user", "> lost"),
    (None, None, "user", ""),
    (3, None, "user", "> z\n"),
    (4, 0, "user", "yes\nI agree"),
    (4, 1, "user", "no\n\nyes"),
    (4, 2, "user", "yes\nbut only on Mondays\n\nand so on"),
    (4, 3, "user", "> Yes\n> but only  on mondays\n\n> and so on\nwhy?"),
    (4, 4, "user", ">> yes\n>> and so on\n> why?\n> no\n>> I agree\nnested"),
    (4, 5, "user", ">> yes\n>> but only on mondays\nonly nested"),
    (4, 6, "user", "> no\n>\n> yes\nsplit by a blank"),
    (4, 6, "user", "> no\n>\n> yes\nsplit by a blank"),
    *[(9, t, "user", (f"> line {t - 1}\n" if t else "") + f"line {t}\n" + "same line") for t in range(40)],
]


def test_chats(spark, tmp_path):
    df = spark.createDataFrame([(*r, 1, "a") for r in CHATS], "conv_id long, turn long, role string, text string, root int, position string")
    path = str(tmp_path / "conversations.parquet")
    df.repartition(3).write.parquet(path)
    got = queries.op7_quotation_linking(spark, str(tmp_path))
    db = duckdb.connect()
    db.execute(f"create view conversations as select * from '{path}/*.parquet'")
    columns = sorted(got.columns)
    want = db.execute(f"select {', '.join(columns)} from ({queries.ORACLES['op7_quotation_linking']})").fetchall()
    assert sorted(map(repr, map(tuple, got.select(*columns).collect()))) == sorted(map(repr, want))
    replies = {(r.conv_id, r.turn): r.reply_to for r in got.collect()}
    assert (replies[1, 1], replies[1, 2], replies[1, 3], replies[2, 0], replies[9, 39]) == (0, 1, 0, None, 38)
    # a passage belongs to who says all of it, not to who says its first line first
    assert [replies[4, t] for t in range(7)] == [None, None, None, 2, 3, 2, 1]
    assert chat_quotes.linked_conversations(df.where("false")).count() == 0


def test_nested_quotes(spark):
    chats = [
        (1, 0, "user", "first\nalso first"),
        (1, 1, "assistant", "second"),
        (1, 2, "user", ">> First\n> > also first\n>>> second\nonly nested"),
        (1, 3, "user", ">> first\n>> also first\n> second\nlevel 1 wins"),
        (1, 4, "user", ">> first\n>> no one said this\n> nor this\nlevel 1 says nothing"),
        (1, 5, "user", ">>> second\ndeep"),
        (1, 6, "user", ">> later\nquotes what comes later"),
        (1, 7, "user", "later"),
    ]
    df = spark.createDataFrame(chats, "conv_id long, turn long, role string, text string")
    got = {r.turn: (r.position, r.reply_to, r.n_linked, r.max_level) for r in chat_quotes.linked_conversations(df).collect()}
    assert got == {0: (0, None, 0, 0), 2: (1, 0, 2, 3), 4: (2, 0, 1, 2), 1: (3, None, 0, 0), 3: (4, 1, 1, 2), 5: (5, 1, 1, 3), 6: (6, None, 0, 2), 7: (7, None, 0, 0)}


def test_products_sql(spark):
    folder = "/root/testdata/sf0.01"
    db = duckdb.connect()
    db.execute(f"create view embeddings as select * from '{folder}/embeddings.parquet'")
    want = db.execute(queries.ORACLES["op10_va_file_topk"]).fetchall()
    assert sorted(want) == sorted(map(tuple, queries.op10_va_file_topk(spark, folder).collect()))
