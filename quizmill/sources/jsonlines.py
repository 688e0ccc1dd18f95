"""Bundle tables as JSON lines: written in source order with each variant's own fields, read back by file and line.

Lines are checked against models: which keys an object may and must have, and of what kind their values are. A line that
is no JSON or breaks its model is listed with its place and every reason, or stops the read, as the caller wants.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Literal

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.paths import inside
from ..functions.text import strip
from ..schemas import FORMAT_VERSION, GROUP_KINDS, QUESTION_TYPES
from .bundle import BundleError

# -- models -----------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Field:
    """A value: a string, one of ``names``, an int of ``least`` or more, a number, an object of a model, an object whose
    ``kind`` names its model, or a list of such; ``null``: null will do; ``required``: the key must be there."""

    kind: Literal["string", "int", "number", "object"] = "string"
    model: Model | None = None
    variants: dict[str, Model] | None = None
    names: tuple[str, ...] = ()
    lists: int = 0
    null: bool = False
    required: bool = True
    least: int | None = None


@dataclass(frozen=True)
class Model:
    fields: dict[str, Field] = field(default_factory=dict)


# Fixed models of the format.
STRING, STRINGS, TEXT_OR_NULL = Field(), Field(lists=1), Field(null=True, required=False)
BLOCK_MODELS = {
    "text": Model({"text": STRING}), "verbatim": Model({"text": STRING, "language_hint": TEXT_OR_NULL}),
    "image": Model({"asset_id": STRING, "caption": TEXT_OR_NULL}), "table": Model({"rows": Field(lists=2)}),
}
BLOCKS = Field("object", variants=BLOCK_MODELS, lists=1)
ITEMS = Field("object", Model({"id": STRING, "label": TEXT_OR_NULL, "content": BLOCKS}), lists=1)
INTERACTION_MODELS = {
    "choice": Model({"options": ITEMS, "correct_option_ids": STRINGS}), "ordering": Model({"items": ITEMS, "correct_order": STRINGS}),
    "matching": Model({"left": ITEMS, "right": ITEMS, "pairs": Field("object", Model({"left_id": STRING, "right_id": STRING}), lists=1)}),
    "drag_and_drop": Model({"tokens": ITEMS, "targets": ITEMS, "placements": Field("object", Model({"token_id": STRING, "target_id": STRING}), lists=1)}),
    "fill_in_blank": Model({"blanks": Field("object", Model({"id": STRING, "accepted": Field(lists=1, required=False)}), lists=1)}),
}
SOURCE = Model({"ordinal": Field("int", least=1), "label": TEXT_OR_NULL, "pages": Field("int", lists=1, required=False)})
QUESTION_MODEL = Model({
    "id": STRING, "source": Field("object", SOURCE), "type": Field(names=QUESTION_TYPES), "group_id": TEXT_OR_NULL, "stem": BLOCKS,
    "interaction": Field("object", variants=INTERACTION_MODELS), "explanation": Field("object", variants=BLOCK_MODELS, lists=1, required=False),
})
GROUP_MODEL = Model({"id": STRING, "kind": Field(names=GROUP_KINDS), "title": TEXT_OR_NULL, "context": BLOCKS, "question_ids": STRINGS})
ORIGIN = Model({"page": Field("int", least=1), "bbox": Field("number", lists=1, null=True, required=False)})
ASSET_MODEL = Model({"id": STRING, "kind": Field(names=("embedded", "page_crop")), "media_type": STRING, "filename": STRING, "origin": Field("object", ORIGIN), "sha256": STRING})
MODELS = {"questions": QUESTION_MODEL, "groups": GROUP_MODEL, "assets": ASSET_MODEL}


def _no_problem() -> Column:
    return F.array().cast("array<string>")


def _if(bad: Column, *said: Column | str) -> Column:
    return F.when(bad, F.array(F.concat(*(F.lit(s) if isinstance(s, str) else s for s in said)))).otherwise(_no_problem())


def _join(at: Column | str, key: str) -> Column:
    return F.lit(key) if isinstance(at, str) else F.concat(at, F.lit(f".{key}"))


def problems(value: Column, model: Model, at: Column | str = "", kinds: tuple[str, ...] = ()) -> Column:
    """What is wrong with an object (a VARIANT), as array<string> of ``path: reason``: unknown keys in alphabetical order, then field by field."""
    known = F.array(*(F.lit(k) for k in (*model.fields, *kinds)))
    keys = F.map_keys(F.try_variant_get(value, "$", "map<string,variant>"))
    prefix = F.lit("") if isinstance(at, str) else F.concat(at, F.lit("."))
    strange = F.transform(F.array_sort(F.array_except(keys, known)), lambda k: F.concat(prefix, k, F.lit(": unknown key")))
    fields = [_field(F.try_variant_get(value, f"$.{key}", "variant"), f, _join(at, key)) for key, f in model.fields.items()]
    here = F.lit("line") if isinstance(at, str) else at
    return F.when(keys.isNull(), F.array(F.concat(here, F.lit(": must be an object")))).otherwise(F.flatten(F.array(strange, *fields)))


def _field(value: Column, f: Field, at: Column) -> Column:
    missing = _if(value.isNull(), at, ": missing") if f.required else _no_problem()
    checked = _value(value, f, at, f.lists)
    if f.null:
        checked = F.when(F.is_variant_null(value), _no_problem()).otherwise(checked)
    return F.when(value.isNull(), missing).otherwise(checked)


def _value(value: Column, f: Field, at: Column, lists: int) -> Column:
    if lists:
        each = F.transform(F.try_variant_get(value, "$", "array<variant>"), lambda x, i: _value(x, f, F.concat(at, F.lit("["), i.cast("string"), F.lit("]")), lists - 1))
        return F.coalesce(F.flatten(each), F.array(F.concat(at, F.lit(": must be a list"))))
    kind = F.schema_of_variant(value)
    if f.model:
        return problems(value, f.model, at)
    if f.variants:
        own = F.try_variant_get(value, "$.kind", "string")
        chosen = _if(F.lit(True), at, ".kind: must be one of ", ", ".join(f.variants))
        for name, model in f.variants.items():
            chosen = F.when(own == name, problems(value, model, at, ("kind",))).otherwise(chosen)
        return chosen
    if f.names:
        return _if(~F.coalesce((kind == "STRING") & F.try_variant_get(value, "$", "string").isin(*f.names), F.lit(False)), at, ": must be one of ", ", ".join(f.names))
    if f.kind == "string":
        return _if(kind != "STRING", at, ": must be a string")
    number = F.try_variant_get(value, "$", "double")
    plain = ~kind.isin("STRING", "BOOLEAN", "VOID") & number.isNotNull()
    if f.kind == "int":
        plain = plain & (number == F.floor(number)) & (F.lit(True) if f.least is None else number >= f.least)
        return _if(~plain, at, ": must be a whole number" + (f" of {f.least} or more" if f.least is not None else ""))
    return _if(~plain, at, ": must be a number")


# -- reading ----------------------------------------------------------------------------------------------------------
def numbered_lines(spark: SparkSession, path: str, broadcast_blocks: int = 100_000) -> DataFrame:
    """file, line_no (1, 2, ... in each file, blank lines counted) and line of text files.

    A file may be read in many blocks. Lines are counted by block, a table of one row a block, and each line adds its
    place in the block to the lines before; no line is shuffled. That table is broadcast up to ``broadcast_blocks`` rows.
    """
    read = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), F.col("value").alias("line")
    )
    blocks = read.groupBy("file", "block").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select("file", "block", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    near = F.broadcast(starts) if blocks.count() <= broadcast_blocks else starts
    return read.join(near, ["file", "block"]).select("file", (F.col("before") + F.col("id") - F.col("first") + 1).alias("line_no"), "line")


def check_lines(lines: DataFrame, model: Model) -> DataFrame:
    """The lines that aren't blank, with value (VARIANT, null if no JSON) and problems (empty: none)."""
    seen = lines.where(strip(F.col("line")) != "").withColumn("value", F.try_parse_json("line"))
    found = F.when(F.col("value").isNull(), F.array(F.lit("line: is not JSON"))).otherwise(problems(F.col("value"), model))
    return seen.withColumn("problems", found)


def read_lines(spark: SparkSession, path: str, model: Model, schema: str, flag: bool = False) -> DataFrame:
    """file, line_no and the table's columns. A bad line stops the read with its file, number and reasons (the first by
    file and number); with ``flag`` bad lines are rows of null columns, and a column problems says what is wrong."""
    checked = check_lines(numbered_lines(spark, path), model)
    bad = F.size("problems") > 0
    if not flag:
        first = checked.where(bad).orderBy("file", "line_no").select("file", "line_no", "problems").first()
        if first:
            raise BundleError(f"{first.file.rsplit('/', 1)[-1]}:{first.line_no}: {'; '.join(first.problems)}")
    row = F.when(~bad, F.from_json("line", schema)).alias("row")
    return checked.select("file", "line_no", row, *(["problems"] if flag else [])).select("file", "line_no", "row.*", *(["problems"] if flag else []))


# -- writing ----------------------------------------------------------------------------------------------------------
#: What JSON text can hold as it is: printable ASCII without quotes and backslashes.
PLAIN = r"\A[ !#-\[\]-~]*\z"


def _string(value: Column) -> Column:
    """A string as JSON text, null as null; only texts with something to escape go through a JSON writer."""
    return F.when(value.isNull(), "null").when(value.rlike(PLAIN), F.concat(F.lit('"'), value, F.lit('"'))).otherwise(_json(value))


def _number(value: Column) -> Column:
    """A whole number as JSON text, null as null."""
    return F.coalesce(value.cast("string"), F.lit("null"))


def _json(value: Column) -> Column:
    """A value as JSON text, null as null."""
    text = F.to_json(F.struct(value.alias("v")), {"ignoreNullFields": "false"})
    return F.substring(text, F.lit(6), F.length(text) - 6)


def _object(**fields: Column) -> Column:
    parts = [F.concat(F.lit(("{" if i == 0 else ",") + f'"{name}":'), value) for i, (name, value) in enumerate(fields.items())]
    return F.concat(*parts, F.lit("}"))


def _list(values: Column, one) -> Column:  # noqa: ANN001
    return F.concat(F.lit("["), F.array_join(F.transform(values, one), ","), F.lit("]"))


def _blocks(values: Column) -> Column:
    def one(b: Column) -> Column:
        kind = _string(b["kind"])
        shapes = {
            "verbatim": _object(kind=F.lit('"verbatim"'), text=_string(b["text"]), language_hint=_string(b["language_hint"])), "image": _object(kind=F.lit('"image"'), asset_id=_string(b["asset_id"]), caption=_string(b["caption"])),
            "table": _object(kind=F.lit('"table"'), rows=_json(b["rows"])),
        }
        out = _object(kind=kind, text=_string(b["text"]))
        for name, shape in shapes.items():
            out = F.when(b["kind"] == name, shape).otherwise(out)
        return out

    return _list(values, one)


def question_line(interaction: Column) -> Column:
    """A question (columns as schemas.QUESTION) as one line: of its blocks and interaction only the fields of their kind, nulls kept."""
    items = lambda name: _list(interaction[name], lambda i: _object(id=_string(i["id"]), label=_string(i["label"]), content=_blocks(i["content"])))
    texts = lambda values: F.coalesce(_list(values, _string), F.lit("null"))
    plain = lambda name: _json(interaction[name])
    kind = lambda name: F.lit(f'"{name}"')
    shapes = {
        "choice": _object(kind=kind("choice"), options=items("options"), correct_option_ids=texts(interaction["correct_option_ids"])), "ordering": _object(kind=kind("ordering"), items=items("items"), correct_order=texts(interaction["correct_order"])),
        "matching": _object(kind=kind("matching"), left=items("left"), right=items("right"), pairs=plain("pairs")), "drag_and_drop": _object(kind=kind("drag_and_drop"), tokens=items("tokens"), targets=items("targets"), placements=plain("placements")),
        "fill_in_blank": _object(kind=kind("fill_in_blank"), blanks=plain("blanks")),
    }
    answers = F.coalesce(*(F.when(interaction["kind"] == name, shape) for name, shape in shapes.items()))
    col = F.col
    return _object(
        id=_string(col("id")), source=_object(ordinal=_number(col("source.ordinal")), label=_string(col("source.label")), pages=F.coalesce(_list(col("source.pages"), _number), F.lit("null"))), type=_string(col("type")), group_id=_string(col("group_id")),
        stem=_blocks(col("stem")), interaction=answers, explanation=_blocks(col("explanation")),
    )


def group_line() -> Column:
    col = F.col
    return _object(id=_json(col("id")), kind=_json(col("kind")), title=_json(col("title")), context=_blocks(col("context")), question_ids=_json(col("question_ids")))


def asset_line() -> Column:
    col = F.col
    origin = _object(page=_json(col("origin.page")), bbox=_json(col("origin.bbox")))
    return _object(id=_json(col("id")), kind=_json(col("kind")), media_type=_json(col("media_type")), filename=_json(col("filename")), origin=origin, sha256=_json(col("sha256")))


def write_lines(rows: DataFrame, line: Column, path: str) -> int:
    """Writes one line a row, in order of run_id and item_seq through all files, and returns how many.

    Rows are dealt by ranges of both columns, so a run of any size spreads over files. They are counted as they are
    written, after the deal: sampling for its bounds reads the rows once more.
    """
    count = Observation()
    made = rows.select("run_id", "item_seq", line.alias("value")).repartitionByRange("run_id", "item_seq").sortWithinPartitions("run_id", "item_seq")
    made.select("value").observe(count, F.count(F.lit(1)).alias("n")).write.mode("errorifexists").text(path)
    return count.get["n"]


def write_bundle(path: str, questions: DataFrame, groups: DataFrame, assets: DataFrame, report: DataFrame, source: dict[str, object], version: str, created_at: str) -> dict[str, object]:
    """A folder of questions, groups, assets and report as lines, and last the manifest, which commits it.

    Counts are those of the writes; ``source`` says what was imported (format, filename, sha256, size_bytes, page_count).
    A folder that holds a table already is refused before anything is written; a write that dies leaves no manifest.
    """
    spark = questions.sparkSession
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if system.exists(target) and len(system.listStatus(target)):
        raise BundleError(f"output directory {path} exists and is not empty")
    repeated = assets.groupBy("run_id", "id").count().where("count > 1").first()
    if repeated:
        raise BundleError(f"duplicate asset id {repeated.id!r}")
    tables = {"question": (questions, question_line(F.col("interaction"))), "group": (groups, group_line()), "asset": (assets, asset_line())}
    counts = {f"{name}_count": write_lines(rows, line, f"{path}/{name}s") for name, (rows, line) in tables.items()}
    report.write.mode("errorifexists").option("ignoreNullFields", "false").json(f"{path}/report")
    names = {"format": "string", "filename": "string", "sha256": "string", "size_bytes": "long", "page_count": "int"}
    made = {"bundle_format_version": FORMAT_VERSION, "importer_version": version, "created_at": created_at, "source": {n: source.get(n) for n in names}} | counts
    schema = f"bundle_format_version string, importer_version string, created_at string, source struct<{', '.join(f'{n}: {t}' for n, t in names.items())}>, question_count long, group_count long, asset_count long"
    spark.createDataFrame([made], schema).coalesce(1).write.mode("errorifexists").option("ignoreNullFields", "false").json(f"{path}/manifest")
    return made


# -- stored files -----------------------------------------------------------------------------------------------------
def asset_path(folder: Column, filename: Column) -> Column:
    """The path of a stored file, null if the name leads out of the folder. Backslashes part segments too."""
    name = F.translate(filename, "\\", "/")
    return F.when(inside(folder, name), F.concat(folder, F.lit("/"), name))


def find_stored(wanted: DataFrame, stored: DataFrame) -> DataFrame:
    """The stored file of each wanted name: run_id, name, filename (null: none); the first in order if there are several.

    A file goes by its whole name or by any part of it before a dot; each such name is a row, so this is an equi-join.
    """
    parts = F.split("filename", r"\.")
    names = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))
    known = stored.select("run_id", "filename", F.explode(F.array_distinct(names)).alias("name")).groupBy("run_id", "name").agg(F.min(F.struct((F.col("filename") != F.col("name")).alias("part"), "filename")).alias("found"))
    return wanted.select("run_id", "name").distinct().join(known, ["run_id", "name"], "left").select("run_id", "name", "found.filename")
