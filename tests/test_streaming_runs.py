"""A run that arrives in pieces, cut at random, has the issues that the batch rules find in it as a whole."""

import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quizmill.operators import rules
from quizmill.operators.lines import union_all
from quizmill.plans.bindings import bank, written
from quizmill.schemas import BLOCK
from quizmill.streaming import runs

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def whole(spark):
    """Questions with repeated ids, groups declared twice, before and after their questions, and assets here and there."""
    q = bank(spark, SF).where("cast(run_id as int) % 9 = 0").withColumn("item_seq", F.col("item_seq") * 2)
    n = F.col("item_seq")
    q = q.withColumn("id", F.concat(F.lit("q"), (n % 5).cast("string"))).withColumn("group_id", F.when(n % 3 > 0, F.concat(F.lit("g"), (n % 4).cast("string"))))
    seqs = q.select("run_id", (n + 1).alias("item_seq"))
    g = seqs.where("item_seq % 5 < 3").withColumn("id", F.concat(F.lit("g"), (n % 4 - 1).cast("string")))
    context = F.expr(f"cast(array(named_struct('kind', 'text', 'text', 'x', 'language_hint', null, 'asset_id', null, 'caption', null, 'rows', null), named_struct('kind', 'image', 'text', null, 'language_hint', null, 'asset_id', concat('a', item_seq % 3), 'caption', null, 'rows', null)) as array<{BLOCK}>)")
    g = g.withColumns({"context": context, "question_ids": F.when(n % 2 == 1, F.array(F.lit("q1"), F.lit("q4"))).otherwise(F.array().cast("array<string>"))})
    assets = union_all(q.where("item_seq % 4 = 0"), g.where("item_seq % 3 = 0")).select("run_id", "item_seq", F.concat(F.lit("a"), F.floor(n / 2).cast("string")).alias("id"))
    return written(q), written(g), written(assets)


@pytest.mark.parametrize("seed", [1, 2])
def test_cut_at_random(spark, whole, tmp_path, seed):
    q, g, assets = whole
    by_item = assets.groupBy("run_id", "item_seq").agg(F.collect_list("id").alias("asset_ids"))
    items = union_all(q, g.select("run_id", "item_seq", F.struct("id", "context", "question_ids").alias("grp"))).join(by_item, ["run_id", "item_seq"], "left")
    rows = items.select("run_id", "item_seq", F.to_json(F.struct(*items.columns)).alias("line")).orderBy("item_seq", "run_id").collect()
    rnd, cuts = random.Random(seed), {}
    for r in rows:  # each run goes on in the piece where it stopped, or in a later one
        cuts[r.run_id] = cuts.get(r.run_id, 0) + (rnd.random() < 0.4)
        with (tmp_path / f"{cuts[r.run_id]:03}.json").open("a") as f:
            f.write(r.line + "\n")
    for k, path in enumerate(sorted(tmp_path.glob("*.json"))):  # pieces are read by age
        os.utime(path, (1_700_000_000 + k, 1_700_000_000 + k))
    stream = spark.readStream.schema(runs.ITEM).option("maxFilesPerTrigger", 1).json(str(tmp_path))
    started = runs.run_issues(stream).writeStream.format("memory").queryName(f"cut{seed}").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    started.awaitTermination()
    assert len(started.recentProgress) > 3
    got = Counter((r.run_id, r.item_seq, r.code, tuple(r.args)) for r in spark.table(f"cut{seed}").collect())
    checked = (rules.duplicate_ids(q), rules.unknown_groups(q, g), rules.group_mismatches(q, g), rules.missing_assets(q, assets), rules.missing_group_assets(g, assets))
    want = Counter((r.run_id, r.item_seq, r.code, tuple(r.args)) for df in checked for r in df.collect())
    assert got == want and len({code for _, _, code, _ in want}) == 4
