import random

from pyspark.sql import functions as F

from tokenledger.operators.ordering import carry_along, running_totals

SCHEMA = "file string, block bigint, pos bigint, amount bigint, tag string"


def skewed(seed):
    """Rows of three files; one holds most of them, over many blocks, some without any tag."""
    pick, made = random.Random(seed), []
    for name, size in (("hot", 400), ("cold", 30), ("tiny", 1)):
        for i in range(size):
            tag = pick.choice([None, None, None, f"{name}-{i}"])
            made.append((name, i // 7, i, pick.randint(-5, 50), tag))
    return made


def test_carry_along_equals_one_pass_over_each_file(spark):
    data = skewed(1)
    frame = spark.createDataFrame(data, SCHEMA).repartition(8)
    tagged = F.col("tag").isNotNull()
    attached = spark.createDataFrame([("hot", "x"), ("cold", "y"), ("cold", "z")], "file string, extra string")
    got = carry_along(frame, ["file"], latest={"last": tagged}, earliest={"first": tagged}, attach=attached)
    found = sorted(
        (r.file, r.pos, r.last and r.last.tag, r.first and r.first.tag, r.extra) for r in got.collect()
    )
    expected, seen = [], {}
    for name, _, pos, _, tag in data:
        tags = seen.setdefault(name, [])
        for extra in {"hot": ["x"], "cold": ["y", "z"]}.get(name, []):
            expected.append((name, pos, tags[-1] if tags else None, tags[0] if tags else None, extra))
        if tag:
            tags.append(tag)
    key = lambda row: tuple(str(v) for v in row)
    assert sorted(found, key=key) == sorted(expected, key=key)


def test_carry_along_shuffles_rows_once(spark):
    frame = spark.createDataFrame(skewed(2), SCHEMA)
    got = carry_along(frame, ["file"], latest={"last": F.col("tag").isNotNull()}).select("pos", "last.amount")
    got.collect()
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in plan.split("Initial Plan")[0]


def test_running_totals(spark):
    data = skewed(3)
    got = running_totals(spark.createDataFrame(data, SCHEMA).repartition(8), ["file"], {"total": F.col("amount")})
    expected, sums = {}, {}
    for name, _, pos, amount, _ in data:
        sums[name] = sums.get(name, 0) + amount
        expected[name, pos] = sums[name]
    assert {(r.file, r.pos): r.total for r in got.collect()} == expected


def test_blocks_are_not_broadcast(spark):
    """Whatever sizes are estimated: a wide column that is dropped makes the rows look next to nothing."""
    wide = F.struct(*[F.lit("x").alias(f"c{i}") for i in range(500)])
    frame = spark.createDataFrame(skewed(4), SCHEMA).withColumn("wide", F.explode(F.array(wide))).filter("wide.c1 = 'x'").drop("wide")
    attached = spark.createDataFrame([("hot", "x")], "file string, extra string")
    carried = carry_along(frame, ["file"], latest={"last": F.col("tag").isNotNull()}, attach=attached)
    for got in (carried, running_totals(frame, ["file"], {"total": F.col("amount")})):
        got.collect()
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan


def test_rows_are_shuffled_without_second_copies_of_their_places(spark):
    frame = spark.createDataFrame(skewed(5), SCHEMA)
    tagged = {"last": F.col("tag").isNotNull()}
    whole = carry_along(frame, ["file"], latest=tagged)
    assert whole.schema["last"].dataType.names == frame.columns
    carried = carry_along(frame, ["file"], latest=tagged, carrying={"last": ["amount"]})
    for got in (carried, running_totals(frame, ["file"], {"total": F.col("amount")})):
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert "struct(amount" in plan and "struct(file" not in plan
