import random

from pyspark.sql import functions as F

from driftwise.operators.features import extract_features
from driftwise.operators.normalize import normalize
from driftwise.plans.rolling import _locate, over_rows, rows_index
from tests.conftest import events


def _data(spark, n=700, keys=("hot", "hot", "hot", "b", "c")):
    rnd = random.Random(3)
    rows = []
    for i in range(n):
        rows.append((f"e{i:05d}", rnd.choice(keys), "t", 1000 + rnd.randint(0, 5000),
                     (rnd.uniform(0, 100), 1.0, rnd.uniform(0, 10) if rnd.random() > 0.1 else None)))
    return events(spark, rows)


def test_row_index_exact(spark):
    df = _data(spark)
    a = {r.event_id: r.rn for r in rows_index(df, ["source"], ["timestamp", "event_id"], n_chunks=9).collect()}
    b = {r.event_id: r.rn for r in rows_index(df, ["source"], ["timestamp", "event_id"], split=False).collect()}
    assert a == b


def test_split_equals_single_partition_windows(spark):
    df = _data(spark)

    def build(fr):
        w = fr.rows(10)
        return [F.sum("payload.price").over(w).alias("s"), F.lag("payload.price", 9).over(fr.w).alias("l"),
                F.when(fr.rn >= 10, F.count(F.lit(1)).over(w)).alias("c")]

    split = over_rows(df, ["source"], ["timestamp", "event_id"], 9, build, n_chunks=6, block_rows=17)
    plain = over_rows(df, ["source"], ["timestamp", "event_id"], 9, build, split=False)
    a = {r.event_id: (round(r.s, 9), r.l, r.c) for r in split.collect()}
    b = {r.event_id: (round(r.s, 9), r.l, r.c) for r in plain.collect()}
    assert a == b and len(a) == 700


def test_operators_split_invariant(spark):
    df = _data(spark)
    n1 = {r.event_id: r.price_normalized for r in normalize(df, ["price"], window_size=20).collect()}
    n2 = {r.event_id: r.price_normalized for r in normalize(df, ["price"], window_size=20, split=False).collect()}
    assert n1.keys() == n2.keys()
    assert all((n1[k] is None and n2[k] is None) or abs(n1[k] - n2[k]) < 1e-9 for k in n1)
    f1 = {r.event_id: (r.sma_5, r.rsi_14) for r in extract_features(df, ["sma_5", "rsi_14"], key=("source",)).collect()}
    f2 = {r.event_id: (r.sma_5, r.rsi_14) for r in
          extract_features(df, ["sma_5", "rsi_14"], key=("source",), split=False).collect()}
    for k in f1:
        for x, y in zip(f1[k], f2[k]):
            assert (x is None and y is None) or abs(x - y) < 1e-9


def test_tied_and_null_times_are_split(spark):
    """One time for all rows of a key, and none for all of another: order goes on by id."""
    df = spark.range(2000).select(F.when(F.col("id") % 2 == 0, "tied").alias("k"),
                                  F.when(F.col("id") % 2 == 0, F.lit(7)).alias("t"), F.col("id").alias("i"))
    got = over_rows(df, ["k"], ["t", "i"], 3, lambda fr: [
        fr.rn.alias("n"), F.lag("i", 3).over(fr.w).alias("l"), F.count("i").over(fr.w.rowsBetween(-5000, 5000)).alias("group")],
        block_rows=100).collect()
    assert len(got) == 2000 and max(r.group for r in got) <= 150
    for r in got:
        assert r.n == r.i // 2 + 1 and r.l == (r.i - 6 if r.n > 3 else None)


def test_lookback_over_several_blocks_and_keys(spark):
    rnd = random.Random(8)
    rows = [(rnd.choice(["a"] * 9 + ["b", None]), i, float(rnd.randint(0, 9))) for i in range(900)]
    df = spark.createDataFrame(rows, "k string, o long, x double")

    def build(fr):
        return [fr.rn.alias("n"), F.sum("x").over(fr.rows(130)).alias("s")]

    plain = {r.o: (r.n, r.s) for r in over_rows(df, ["k"], ["o"], 129, build, split=False).collect()}
    for kw in ({"block_rows": 20}, {"n_chunks": 3}, {}):
        assert {r.o: (r.n, r.s) for r in over_rows(df, ["k"], ["o"], 129, build, **kw).collect()} == plain
    empty = over_rows(df.limit(0), ["k"], ["o"], 5, build)
    assert empty.columns == ["k", "o", "x", "n", "s"] and empty.count() == 0
    assert over_rows(df, [], ["o"], 1, build, block_rows=50).agg(F.max("n")).first()[0] == 900


def test_rows_are_shuffled_once(spark):
    """The wide column passes one exchange; what else is shuffled are counts per chunk."""
    import re

    df = spark.range(5000).select(F.lit("k").alias("k"), "id", F.repeat(F.col("id").cast("string"), 3).alias("wide"))
    out = over_rows(df, ["k"], ["id"], 3, lambda fr: [F.lag("wide", 3).over(fr.w).alias("l")], block_rows=500)
    text = spark._jvm.PythonSQLUtils.explainString(out._jdf.queryExecution(), "formatted")
    exchanges = re.findall(r"\) Exchange\s*\nInput \[\d+\]: \[([^\]]*)\]", text)
    assert len(exchanges) > 1 and sum("wide#" in cols for cols in exchanges) == 1
    assert out.filter("l is null").count() == 3


def test_running_values_over_blocks(spark, monkeypatch):
    from driftwise.extras.timeseries import running
    from driftwise.plans import rolling

    monkeypatch.setattr(rolling, "TARGET_ROWS", 60)
    rnd = random.Random(4)
    rows = [(rnd.choice(["a", "a", "a", None]), i, None if rnd.random() < 0.1 else float(rnd.randint(-9, 9))) for i in range(700)]
    df = spark.createDataFrame(rows, "k string, o long, x double")
    for how, f in (("sum", F.sum), ("max", F.max), ("min", F.min)):
        from pyspark.sql import Window

        w = Window.partitionBy("k").orderBy("o").rowsBetween(Window.unboundedPreceding, 0)
        got = {r.o: r.v for r in running(df, "x", ["k"], ["o"], how, "v").collect()}
        want = {r.o: r.v for r in df.withColumn("v", f("x").over(w)).collect()}
        assert {o: v or 0 for o, v in got.items()} == {o: v or 0 for o, v in want.items()}


def test_chunk_search_is_compiled_and_counts_bounds(spark):
    """the chunk of a row is the number of bounds at or below its tuple (nulls first, ties,
    any number of bounds), found by plain comparisons and not by a lambda for each row."""
    rows = [(None if i % 7 == 0 else "ab"[i % 2], None if i % 5 == 0 else float(i % 13), i) for i in range(120)]
    df = spark.createDataFrame(rows, "k string, v double, i long")
    first = lambda t: tuple((x is not None, x if x is not None else 0) for x in t)
    order = sorted(set(rows), key=first)
    for n in (0, 1, 2, 3, 6, 9, 40):
        bounds = order[1::3][:n]
        out = _locate(df, ["k", "v", "i"], bounds)
        want = {r[2]: sum(first(b) <= first(r) for b in bounds) for r in rows}
        assert {r.i: r._chunk for r in out.collect()} == want
    assert "lambda" not in out._jdf.queryExecution().analyzed().toString()
