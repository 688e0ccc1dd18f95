"""The rules that need what a run had before, over a stream of items: state by run and name, not by run.

Whether an id repeats, a group is known and lists its question, and an image's asset is stored depends only on what came
before under that very id, group or asset. So each item is taken apart into events on names, and the state of a name is a
few values; a run of any size spreads over as many keys as it has names. Members that never came are known at a run's end
only, and stay with the batch operators.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.text import or_empty
from ..operators.rules import display_items, placed_blocks
from ..schemas import BLOCK, QUESTION

#: An item as a source hands it out: a question (id not null) or a group, and the assets that come with it.
ITEM = f"{QUESTION}, grp struct<id: string, context: array<{BLOCK}>, question_ids: array<string>>, asset_ids array<string>"
ISSUES = "run_id string, item_seq int, pos int, code string, args array<string>"
STATE = "known boolean, first string, members array<string>"
EVENT = "array<struct<kind: string, name: string, rank: int, pos: int, value: string, members: array<string>>>"


def events(items: DataFrame) -> DataFrame:
    """run_id, item_seq, kind (id, group, asset), name, rank (0: makes the name known, 1: asks for it), pos, value, members."""
    null = F.lit(None)
    one = lambda kind, name, rank, pos, value, members=null: F.struct(F.lit(kind), name, F.lit(rank), pos, value, members).cast(EVENT[6:-1])
    image = lambda blocks: F.filter(F.transform(blocks, lambda x, i: F.struct(x["place"].alias("place"), x["b"]["asset_id"].alias("id"), i.alias("pos"), x["b"]["kind"].alias("kind"))), lambda x: x["kind"] == "image")
    asks = lambda blocks: F.transform(image(blocks), lambda x: one("asset", x["id"], 1, x["pos"], x["place"]))
    context = F.transform(or_empty(F.col("grp.context"), BLOCK), lambda b: F.struct(F.lit("group context").alias("place"), b.alias("b")))
    stored = F.transform(or_empty(F.col("asset_ids")), lambda a: one("asset", a, 0, F.lit(0), null))
    question = F.concat(F.array(one("id", F.col("id"), 1, F.lit(0), F.col("source.ordinal").cast("string")), one("group", F.col("group_id"), 1, F.lit(0), F.col("id"))), asks(placed_blocks(display_items())))
    group = F.concat(F.array(one("group", F.col("grp.id"), 2, F.lit(0), null, F.col("grp.question_ids"))), asks(context))
    own = F.concat(stored, F.when(F.col("id").isNotNull(), question).otherwise(group))
    return items.select("run_id", "item_seq", F.explode(own).alias("e")).select("run_id", "item_seq", "e.*").where("name is not null")


def _advance(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """One name's events of a batch, in order of their items; assets come before the images of their item, groups after."""
    known, first, members = state.get if state.exists else (False, None, [])
    run_id, kind, name = key
    found = []
    rows = pd.concat(list(frames)).sort_values(["item_seq", "rank", "pos"], kind="stable")
    for seq, rank, pos, value, listed in zip(rows["item_seq"], rows["rank"], rows["pos"], rows["value"], rows["members"], strict=True):
        if rank != 1:
            known, members = True, [] if listed is None else list(listed)
        elif kind == "id":
            if known:
                found.append((run_id, seq, pos, "duplicate_question_id", [name, first]))
            else:
                known, first = True, value
        elif kind == "group":
            if not known:
                found.append((run_id, seq, pos, "unknown_group", [name]))
            elif value not in members:
                found.append((run_id, seq, pos, "group_member_mismatch", [name, value]))
        elif not known:
            found.append((run_id, seq, pos, "missing_asset", [value, name]))
    state.update((known, first, list(members)))
    yield pd.DataFrame(found, columns=["run_id", "item_seq", "pos", "code", "args"])


def run_issues(items: DataFrame) -> DataFrame:
    """Issues (ISSUES) of a stream of items (ITEM) as they arrive; each run's items must arrive in order of item_seq.

    However the stream is cut into batches, the issues are those of the batch rules on the whole run. A name's events of
    one batch meet in a task; state lasts as long as the query, so a stream of runs without end needs runs of bounded life.
    """
    return events(items).groupBy("run_id", "kind", "name").applyInPandasWithState(_advance, ISSUES, STATE, "append", GroupStateTimeout.NoTimeout)
