"""Validation rules. Row rules make one array per question in one projection; rules across items are joins.

A rule of one's own is a function from a question's columns to an array of (severity, code, args, what), given to
``row_issues``; ``what`` names the sentence (``messages``), by default the code; a rule over a whole run is any DataFrame with the columns of ``ISSUES``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rows import once
from ..functions.text import ids_of, or_empty, repeated, repeats, same_list, some_unknown, strip, unknown
from ..schemas import KIND_OF_TYPE

ISSUES = ("run_id", "item_seq", "rule", "n", "severity", "code", "args")
Rule = Callable[[], Column]


def issue(code: str, when: Column, args: Column | None = None, severity: str = "warning", what: str | None = None) -> Column:
    """An array of one issue where ``when`` holds, else an empty one."""
    one = F.array(F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code"), (F.array().cast("array<string>") if args is None else args).alias("args"), F.lit(what or code).alias("what")))
    return F.when(when, one).otherwise(_none())


def _none() -> Column:
    return F.array().cast("array<struct<severity: string, code: string, args: array<string>, what: string>>")


def _of(kind: str, *found: Column) -> Column:
    """Issues of questions of one kind; others are not looked at."""
    return F.when(_is(kind), F.concat(*found)).otherwise(_none())


def _q(name: str) -> Column:
    return F.col(f"interaction.{name}")


def _is(kind: str) -> Column:
    return F.coalesce(_q("kind") == kind, F.lit(False))


def missing_label() -> Column:
    label = F.col("source.label")
    return issue("missing_question_label", label.isNull() | (strip(label) == ""))


def empty_stem() -> Column:
    return issue("empty_stem", F.size(or_empty(F.col("stem"), F_BLOCK)) == 0)


def type_mismatch() -> Column:
    wanted = F.create_map(*(F.lit(x) for pair in KIND_OF_TYPE.items() for x in pair))
    return issue("interaction_type_mismatch", F.coalesce(F.element_at(wanted, F.col("type")) != _q("kind"), F.lit(False)), F.array(_q("kind")))


def choice_answers() -> Column:
    ids, right = ids_of(_q("options")), or_empty(_q("correct_option_ids"))
    n = F.size(right)
    return _of(
        "choice",
        issue("missing_options", F.size(ids) < 2, F.array(F.size(ids).cast("string"))),
        issue("duplicate_option_ids", repeated(ids), repeats(ids)),
        issue("missing_correct_answer", n == 0),
        issue("invalid_answer_reference", (n > 0) & some_unknown(right, ids), unknown(right, ids)),
        issue("answer_count_mismatch", (F.col("type") == "single_choice") & (n > 1), F.array(n.cast("string")), what="single_choice_answers"),
        issue("answer_count_mismatch", (F.col("type") == "true_false") & (F.size(ids) != 2), F.array(F.size(ids).cast("string")), what="true_false_options"),
        issue("answer_count_mismatch", (F.col("type") == "true_false") & (n > 1), F.array(n.cast("string")), what="true_false_answers"),
    )


def ordering_answers() -> Column:
    ids, order = ids_of(_q("items")), or_empty(_q("correct_order"))
    return _of(
        "ordering",
        issue("invalid_ordering", repeated(ids), repeats(ids), what="ordering_repeats"),
        issue("missing_correct_answer", F.size(order) == 0, what="ordering_empty"),
        issue("invalid_ordering", (F.size(order) > 0) & ~same_list(order, ids), what="ordering_not_once"),
    )


def _pairing(kind: str, code: str, left: str, right: str, pairs: str, sides: tuple[str, str]) -> Column:
    one, two = ids_of(_q(left)), ids_of(_q(right))
    side = [or_empty(_q(pairs)[s]) for s in sides]
    twice = F.concat(repeats(one), repeats(two))
    return _of(
        kind,
        issue(code, repeated(one) | repeated(two), twice, what=f"{kind}_repeats"),
        issue("missing_correct_answer", F.size(side[0]) == 0, what=f"{kind}_empty"),
        issue(code, some_unknown(side[0], one), unknown(side[0], one), what=f"{kind}_left"),
        issue(code, some_unknown(side[1], two), unknown(side[1], two), what=f"{kind}_right"),
    )


def matching_answers() -> Column:
    return _pairing("matching", "invalid_matching_pairs", "left", "right", "pairs", ("left_id", "right_id"))


def drag_drop_answers() -> Column:
    return _pairing("drag_and_drop", "invalid_drag_drop_mapping", "tokens", "targets", "placements", ("token_id", "target_id"))


def blank_answers() -> Column:
    blanks = _q("blanks")
    ids = ids_of(blanks)
    bare = or_empty(F.filter(blanks, lambda b: F.size(or_empty(b["accepted"])) == 0)["id"])
    each = F.transform(bare, lambda x: F.struct(F.lit("warning").alias("severity"), F.lit("missing_correct_answer").alias("code"), F.array(x).alias("args"), F.lit("blank_unanswered").alias("what")))
    return _of(
        "fill_in_blank",
        issue("missing_correct_answer", F.size(ids) == 0, what="blanks_empty"),
        issue("duplicate_blank_ids", repeated(ids), ids),
        each,
    )


F_BLOCK = "struct<kind: string, text: string, language_hint: string, asset_id: string, caption: string, rows: array<array<string>>>"
ROW_RULES: tuple[Rule, ...] = (missing_label, empty_stem, type_mismatch, choice_answers, ordering_answers, matching_answers, drag_drop_answers, blank_answers)


def with_issues(questions: DataFrame, rules: Sequence[Rule] | None = None) -> DataFrame:
    """The questions and a column ``issues``; rules None: the defaults, empty: none."""
    return once(_checked(questions, rules), "issues")


def _checked(questions: DataFrame, rules: Sequence[Rule] | None) -> DataFrame:
    """Each rule's issues are made by built-in functions alone; only those that are there are gone through, to be numbered."""
    made = [r() for r in (ROW_RULES if rules is None else rules)]
    found = once(questions.withColumn("_found", F.array(*made) if made else F.array(_none())), "_found")
    one = lambda x, n: F.struct(n.alias("rule"), x["severity"].alias("severity"), x["code"].alias("code"), x["args"].alias("args"), x["what"].alias("what"))
    numbered = F.flatten(F.transform("_found", lambda of, n: F.transform(of, lambda x: one(x, n))))
    none = F.array().cast("array<struct<rule: int, severity: string, code: string, args: array<string>, what: string>>")
    return found.withColumn("issues", F.when(F.size(F.flatten("_found")) == 0, none).otherwise(numbered)).drop("_found")


def row_issues(questions: DataFrame, rules: Sequence[Rule] | None = None) -> DataFrame:
    """One row per issue of the row rules, in order of rule."""
    # outer: no filter is put below, where it would make the issues once more
    each = _checked(questions, rules).select("run_id", "item_seq", F.posexplode_outer("issues").alias("n", "i")).where("i is not null")
    return each.select("run_id", "item_seq", "i.rule", "n", "i.severity", "i.code", "i.args")


def _named(df: DataFrame, rule: int, code: str, args: Column) -> DataFrame:
    return df.select("run_id", "item_seq", F.lit(rule).alias("rule"), F.lit(0).alias("n"), F.lit("warning").alias("severity"), F.lit(code).alias("code"), args.alias("args"))


def duplicate_ids(questions: DataFrame) -> DataFrame:
    """Questions whose id an earlier one of their run has; args: id, ordinal of the first."""
    w = Window.partitionBy("run_id", "id").orderBy("item_seq")
    seen = questions.select("run_id", "item_seq", "id", F.row_number().over(w).alias("k"), F.first("source.ordinal").over(w).alias("first"))
    return _named(seen.where("k > 1"), 20, "duplicate_question_id", F.array("id", F.col("first").cast("string")))


def unknown_groups(questions: DataFrame, groups: DataFrame) -> DataFrame:
    """Questions whose group is not declared before them."""
    known = groups.select("run_id", F.col("id").alias("group_id"), F.col("item_seq").alias("at"))
    own = questions.where("group_id is not null").select("run_id", "item_seq", "group_id")
    q, g = own.alias("q"), known.alias("g")
    lost = q.join(g, (F.col("q.run_id") == F.col("g.run_id")) & (F.col("q.group_id") == F.col("g.group_id")) & (F.col("g.at") < F.col("q.item_seq")), "left_anti")
    return _named(lost, 21, "unknown_group", F.array("group_id"))


def group_mismatches(questions: DataFrame, groups: DataFrame) -> DataFrame:
    """Questions whose group (the last of that id before them) does not list them."""
    g = groups.select("run_id", F.col("id").alias("group_id"), F.col("item_seq").alias("at"), "question_ids")
    met = questions.select("run_id", "item_seq", "id", "group_id").join(g, ["run_id", "group_id"]).where("at < item_seq")
    last = met.groupBy("run_id", "item_seq", "id", "group_id").agg(F.max_by("question_ids", "at").alias("members"))
    return _named(last.where(~F.array_contains(or_empty(F.col("members")), F.col("id"))), 22, "group_member_mismatch", F.array("group_id", "id"))


def missing_members(questions: DataFrame, groups: DataFrame) -> DataFrame:
    """Declared members that the whole run lacks, one row each, repeats kept."""
    wanted = groups.select("run_id", "item_seq", F.col("id").alias("group_id"), F.explode("question_ids").alias("id"))
    lost = wanted.join(questions.select("run_id", "id").distinct(), ["run_id", "id"], "left_anti")
    return _named(lost, 23, "missing_group_member", F.array("group_id", "id"))


def missing_assets(questions: DataFrame, assets: DataFrame) -> DataFrame:
    """Image blocks whose asset is not stored with their item or an earlier one; args: place, asset id."""
    blocks = iter_blocks(questions).where("kind = 'image'").select("run_id", "item_seq", "place", "asset_id").alias("b")
    a = assets.select("run_id", "id", F.col("item_seq").alias("at")).alias("a")
    lost = blocks.join(a, (F.col("b.run_id") == F.col("a.run_id")) & (F.col("b.asset_id") == F.col("a.id")) & (F.col("a.at") <= F.col("b.item_seq")), "left_anti")
    return _named(lost, 24, "missing_asset", F.array("place", "asset_id"))


def missing_group_assets(groups: DataFrame, assets: DataFrame) -> DataFrame:
    """Image blocks of group contexts whose asset is not stored with the group or an earlier item."""
    each = groups.select("run_id", "item_seq", F.posexplode("context").alias("pos", "b")).where("b.kind = 'image'")
    blocks = each.select("run_id", "item_seq", F.lit("group context").alias("place"), F.col("b.asset_id").alias("asset_id")).alias("b")
    a = assets.select("run_id", "id", F.col("item_seq").alias("at")).alias("a")
    lost = blocks.join(a, (F.col("b.run_id") == F.col("a.run_id")) & (F.col("b.asset_id") == F.col("a.id")) & (F.col("a.at") <= F.col("b.item_seq")), "left_anti")
    return _named(lost, 24, "missing_asset", F.array("place", "asset_id"))


def display_items() -> Column:
    """A question's items in display order, by its kind."""
    both = lambda a, b: F.concat(F.coalesce(_q(a), F.array()), F.coalesce(_q(b), F.array()))
    none = F.slice(_q("options"), 1, 0)
    return F.coalesce(F.when(_is("choice"), _q("options")).when(_is("ordering"), _q("items")).when(_is("matching"), both("left", "right")).when(_is("drag_and_drop"), both("tokens", "targets")).otherwise(none), F.array())


def placed_blocks(items: Column) -> Column:
    """A question's blocks in order, as an array of place (stem, item 'x', explanation) and b. items: ``display_items``."""
    at = lambda place, blocks: F.transform(F.coalesce(blocks, F.array()), lambda b: F.struct(place.alias("place"), b.alias("b")))
    shown = F.flatten(F.transform(items, lambda i: at(F.concat(F.lit("item '"), i["id"], F.lit("'")), i["content"])))
    return F.concat(at(F.lit("stem"), F.col("stem")), shown, at(F.lit("explanation"), F.col("explanation")))


def iter_blocks(questions: DataFrame) -> DataFrame:
    """One row per block: run_id, item_seq, pos, place (stem, item 'x', explanation) and the block's fields."""
    own = once(questions.select("run_id", "item_seq", "stem", "interaction", "explanation"))
    shown = once(own.select("run_id", "item_seq", "stem", "explanation", display_items().alias("shown")))
    placed = once(shown.select("run_id", "item_seq", placed_blocks(F.col("shown")).alias("placed")))
    return placed.select("run_id", "item_seq", F.posexplode("placed").alias("pos", "x")).select("run_id", "item_seq", "pos", "x.place", "x.b.*")
