"""Operators on vectors next to brute force, and on odd input."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowloom.llm import hard_negatives, vector_codes, vector_links

SCHEMA = "vec_id long, embedding array<float>, label int, code string, n_links int, rank int, k int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, g, "c", 1, 2, 3) for i, v, g in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd():
    """Random vectors, a chain of near ones, copies, repeated rows, and every kind of bad row."""
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=16).round(3).tolist(), i % 3) for i in range(240)]
    turn = [[math.cos(0.15 * i), math.sin(0.15 * i), *[0.0] * 14] for i in range(12)]
    rows += [(300 + i, v, 1) for i, v in enumerate(turn)]
    rows += [(400 + i, rows[5][1], rows[5][2]) for i in range(30)] + [rows[7], rows[7]]
    rows += [(None, rows[9][1], rows[9][2]), (500, None, 1), (501, rows[9][1], None), (502, [0.0] * 16, 1), (503, [1.0] * 15 + [None], 1)]
    rows += [(504, [1.0] * 15 + [float("nan")], 1), (505, [float("inf")] + [1.0] * 15, 1), (506, [], 1), (507, [1.0, 2.0], 1), (508, [2.0, 4.0], 1)]
    rows += [(509, [2 * x for x in rows[11][1]], rows[11][2])]
    random.Random(2).shuffle(rows)
    return [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], g) for i, v, g in rows]


def able(v):
    return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v)


def brute_links(rows, least=0.98):
    ok = [i for i, (_, v, g) in enumerate(rows) if able(v) and any(v) and g is not None]
    near = {i: set() for i in range(len(rows))}
    for i in ok:
        for j in ok:
            a, b = np.array(rows[i][1]), np.array(rows[j][1])
            if i != j and rows[i][2] == rows[j][2] and len(a) == len(b) and a @ b / math.sqrt((a @ a) * (b @ b)) >= least:
                near[i].add(j)
    out = []
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        name = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        out.append((rows[i][0], len(near[i]), name, rows[i][0] == name))
    return sorted(out, key=repr)


def test_links(spark, odd, monkeypatch):
    got = vector_links.near_vectors(table(spark, odd))
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_links(odd)
    monkeypatch.setattr(vector_links, "BLOCK", 16)  # many blocks and intervals
    monkeypatch.setattr(vector_links, "LEAF", 4)
    got = vector_links.near_vectors(table(spark, odd).withColumn("embedding", F.col("embedding").cast("array<double>")))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_links(odd)
    assert vector_links.near_vectors(table(spark, [])).count() == 0
    bad = table(spark, [(1, None, 1), (2, [0.0, 0.0], 1)])
    assert sorted(tuple(r) for r in vector_links.near_vectors(bad).collect()) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_skips_distant_blocks():
    rng = np.random.default_rng(3)
    raw = np.sort(rng.normal(size=(3000, 1)), axis=0) * [[10.0, 0.0]] + rng.normal(size=(3000, 2))
    one = vector_links._Sequence(raw, vector_links.unit(raw), np.ones(3000, np.int64))
    a, b, root = vector_links.join(one, one, 0.99, True)
    cosine = one.unit @ one.unit.T
    assert (a + b == (cosine >= 0.99).sum(axis=1) - 1).all()
    assert len(set(root)) <= 12


def kept(rows):
    return [(i, v, g) for i, v, g in rows if able(v) and len(v) == 16]


def brute_codes(rows, parts, entries, rounds):
    rows = sorted(kept(rows), key=lambda r: (r[0] is None, r[0], [math.floor(256 * x) for x in r[1]]))
    x = np.array([[math.floor(256 * c) for c in v] for _, v, _ in rows]).reshape(len(rows), parts, -1)
    books = x[:entries].transpose(1, 0, 2).copy()

    def assign():
        d = ((x[:, :, None] - books[None]) ** 2).sum(-1)
        return d.argmin(2), d.min(2)

    for _ in range(rounds):
        entry, _ = assign()
        for p in range(parts):
            for e in range(books.shape[1]):
                if (entry[:, p] == e).any():
                    books[p, e] = x[entry[:, p] == e, p].sum(0) // (entry[:, p] == e).sum()
    entry, d = assign()
    return sorted(((r[0], "".join(f"{e:02x}" for e in c), int(s)) for r, c, s in zip(rows, entry, d.sum(1))), key=repr), books


@pytest.mark.parametrize("parts,entries", [(16, 64), (4, 7), (2, 1000)])
def test_codes(spark, odd, parts, entries):
    if entries > 256:
        entries = 200
    df = table(spark, odd)
    books = vector_codes.fit(df, parts=parts, entries=entries)
    want, brute = brute_codes(odd, parts, entries, 2)
    assert (books == brute).all()
    assert vector_codes.digest(books) == hashlib.sha256(",".join(str(x) for x in brute.reshape(-1)).encode()).hexdigest()
    codes = vector_codes.encode(df, books)
    assert sorted(((r.vec_id, r.code, r.error) for r in codes.collect()), key=repr) == want
    total = vector_codes.label_errors(codes).groupBy("label").agg(F.sum("error").alias("e"), F.min("label_error").alias("a"), F.max("label_error").alias("b"))
    assert all(r.e == r.a == r.b for r in total.collect())
    one = vector_codes.decode(codes, books).orderBy("vec_id").filter("vec_id is not null").first()
    picked = [books[p, int(one.code[2 * p:2 * p + 2], 16)] / 256 for p in range(parts)]
    assert one.vector == np.concatenate(picked).tolist()


def test_nearest_takes_the_lowest_of_a_tie():
    book = np.array([[4, 0], [0, 4], [2, 2], [2, 2], [9, 9]])
    points = np.array([[2, 2], [4, 4], [0, 0], [100, 100], [-5, 3]])
    number, distance = vector_codes.nearest(points, book)
    all_ = ((points[:, None] - book[None]) ** 2).sum(-1)
    assert number.tolist() == all_.argmin(1).tolist() and distance.tolist() == all_.min(1).tolist()


def test_codes_of_odd_tables(spark):
    none = table(spark, [])
    books = vector_codes.fit(none)
    assert books.size == 0 and vector_codes.label_errors(vector_codes.encode(none, books)).count() == 0
    few = table(spark, [(3, [0.5] * 16, None), (1, [-0.5] * 16, None), (None, [0.1] * 16, 2)])
    books = vector_codes.fit(few)
    got = vector_codes.label_errors(vector_codes.encode(few, books)).collect()
    assert {(r.vec_id, r.code[:2]) for r in got} == {(1, "00"), (3, "01"), (None, "02")} and all(r.error == 0 for r in got)
    with pytest.raises(ValueError, match="equal parts"):
        vector_codes.fit(table(spark, [(1, [1.0, 2.0, 3.0], 1)]))
    with pytest.raises(Exception, match="a component is"):
        vector_codes.fit(table(spark, [(1, [1e9] * 16, 1)]))


def test_residue_products():
    rng = np.random.default_rng(4)
    for largest, width in ((500, 64), (1 << 20, 200), (1 << 24, 33)):
        a, b = (rng.integers(-largest, largest, (n, width)) for n in (7, 9))
        bound = int(max((x.astype(object) ** 2).sum(axis=1).max() for x in (a, b)))
        primes = hard_negatives.primes_for(bound)
        assert math.prod(primes) > 2 * bound
        assert (hard_negatives.products(a, b, primes) == (a.astype(object) @ b.T.astype(object))).all()
    assert all(64 * (p // 2) ** 2 < 1 << 24 for p in hard_negatives._PRIMES)
    assert all(all(p % q for q in range(2, p)) for p in hard_negatives._PRIMES)


def brute_negatives(rows):
    rows = [(i, [math.floor(256 * x) for x in v], (g + 1) % 10 if i is not None and i % 7 == 0 else g) for i, v, g in kept(rows) if g is not None]
    out = []
    for n, (i, v, g) in enumerate(rows):
        if i is None or i % 50:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j is None, j or 0, m) for m, (j, w, _) in enumerate(rows) if m != n)
        for s, _, _, m in [x for x in scored if rows[x[3]][2] == g][:5]:
            fit = [x for x in scored if rows[x[3]][2] != g and 50 * -s <= 100 * -x[0] <= 95 * -s][:3]
            out += [(i, rows[m][0], r + 1, rows[x[3]][0], -s, -x[0]) for r, x in enumerate(fit)]
    return sorted(out, key=repr)


def mined(df):
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return sorted((tuple(r) for r in hard_negatives.mine(df, anchors=F.col("vec_id") % 50 == 0, relabel=moved).collect()), key=repr)


def test_hard_negatives(spark, odd, monkeypatch):
    assert mined(table(spark, odd)) == brute_negatives(odd) != []
    monkeypatch.setattr(hard_negatives, "ROWS", 20)
    monkeypatch.setattr(hard_negatives, "ANCHORS", 3)
    monkeypatch.setattr(hard_negatives, "_HELD", 10)
    assert mined(table(spark, odd)) == brute_negatives(odd)
    assert mined(table(spark, [])) == []
    assert mined(table(spark, [(1, [1.0, 2.0], 1), (2, [1.0, 3.0], 2)])) == []  # no anchor
    assert mined(table(spark, [(50, [1.0, 2.0], 1), (51, [1.0, 3.0], 2)])) == []  # no positive
