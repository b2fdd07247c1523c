"""The short names, and what small models and indexes do."""

import numpy as np
from pyspark.sql import functions as F

from sparkcol import api
from sparkcol.operators import vectors as V


def test_short_names(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(10)], "v int, g int")
    other = spark.createDataFrame([(1,), (2,), (2,), (99,)], "k int")
    assert [api.filter_gt(df, "v", 7).count(), api.filter_le(df, "v", 7).count(), api.filter_ne(df, "g", 0).count()] == [2, 8, 6]
    assert api.count_lt(df, "v", 4).first()["n"] == 4
    assert {r.g: r.total for r in api.group_sum(df, "g", "v").collect()} == {0: 18, 1: 12, 2: 15}
    assert {r.g: r.n for r in api.group_count(df, "g").collect()} == {0: 4, 1: 3, 2: 3}
    assert [f(df, other, "v", "k").count() for f in (api.inner_join, api.semi_join, api.anti_join)] == [3, 2, 8]
    assert [r.v for r in api.topk(df, "v", 2).collect()] == [9, 8] and [r.v for r in api.topk(df, "v", 2, largest=False).collect()] == [0, 1]


def test_flat_index_is_stored(spark, tmp_path):
    rows = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(6)], "vec_id long, embedding array<float>")
    V.FlatIndex().add(rows).save(str(tmp_path / "index"))
    index = V.FlatIndex().load(spark, str(tmp_path / "index"))
    assert [r.vec_id for r in index.search([4.0, 1.0], 3).collect()] == [4, 3, 5]
    assert index.search_batch(rows.where("vec_id < 2"), 1).count() == 2
    assert [r.norm2 for r in index.rows.orderBy("vec_id").limit(2).collect()] == [1.0, 2.0]


def test_layers(spark):
    rows = spark.createDataFrame([(0, [1.0, -2.0, 3.0])], "id int, v array<double>")
    v = F.col("v")
    w, b = np.array([[1.0, 1.0, 1.0], [-1.0, 0.0, 0.0]]), np.array([0.5, 0.0])
    got = rows.select(V.dense(v, w, b, "relu").alias("d"), V.mlp(v, [(w, b, "relu"), (np.array([[2.0, 1.0]]), np.zeros(1), None)]).alias("m"), V.conv1d(v, [1.0, 2.0]).alias("c"), V.activate(v, "softmax").alias("s"), V.layer_norm(v).alias("n"), V.conv1d(v, [1.0] * 4).alias("e")).first()
    assert got.d == [2.5, 0.0] and got.m == [5.0] and got.c == [-3.0, 4.0] and got.e == []
    assert abs(sum(got.s) - 1) < 1e-12 and abs(sum(got.n)) < 1e-9
    low, high = -2.0, 3.0
    back = rows.select(V.sq4_decode(V.sq4_encode(v, low, high), low, high).alias("b")).first().b
    assert max(abs(x - y) for x, y in zip(back, [1.0, -2.0, 3.0])) <= 5 / 30 + 1e-9


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def field(number, value):
    """A field of a protocol buffer: a number, or bytes with their length."""
    return varint(number << 3) + varint(value) if isinstance(value, int) else varint(number << 3 | 2) + varint(len(value)) + value


def test_sessions_are_opened_on_the_workers(spark, tmp_path):
    """A model that adds up the elements of a vector, written out by the public schema of the format."""
    shape = lambda name, dims: field(1, name) + field(2, field(1, field(1, 1) + field(2, b"".join(field(1, d) for d in dims))))
    rows = lambda n: [field(2, b"n"), field(1, n)]
    weights = field(1, 3) + field(1, 1) + field(2, 1) + field(8, b"w") + field(9, np.ones(3, "<f4").tobytes())
    node = field(1, b"x") + field(1, b"w") + field(2, b"y") + field(4, b"MatMul")
    graph = field(1, node) + field(2, b"g") + field(5, weights) + field(11, shape(b"x", rows(3))) + field(12, shape(b"y", rows(1)))
    path = tmp_path / "sum.onnx"
    path.write_bytes(field(1, 8) + field(7, graph) + field(8, field(1, b"") + field(2, 13)))
    frame = spark.createDataFrame([(i, [float(i), 1.0, 2.0]) for i in range(20)], "id long, v array<double>").repartition(3)
    found = V.score_batches(frame, lambda: V.open_onnx(str(path)), ["v"], loads=True)
    assert {r.id: r.score for r in found.collect()} == {i: i + 3.0 for i in range(20)}
