"""Spark schemas of the question bank: wide structs for tagged unions, `kind` their discriminator."""

BLOCK = "struct<kind: string, text: string, language_hint: string, asset_id: string, caption: string, rows: array<array<string>>>"
ITEM = f"struct<id: string, label: string, content: array<{BLOCK}>>"
INTERACTION = (
    f"struct<kind: string, options: array<{ITEM}>, correct_option_ids: array<string>, items: array<{ITEM}>, correct_order: array<string>, "
    f"left: array<{ITEM}>, right: array<{ITEM}>, pairs: array<struct<left_id: string, right_id: string>>, "
    f"tokens: array<{ITEM}>, targets: array<{ITEM}>, placements: array<struct<token_id: string, target_id: string>>, "
    "blanks: array<struct<id: string, accepted: array<string>>>>"
)
REGION = "struct<page: int, bbox: array<double>>"
QUESTION = f"run_id string, item_seq int, id string, source struct<ordinal: int, label: string, pages: array<int>>, type string, group_id string, stem array<{BLOCK}>, interaction {INTERACTION}, explanation array<{BLOCK}>"
GROUP = f"run_id string, item_seq int, id string, kind string, title string, context array<{BLOCK}>, question_ids array<string>"
ASSET = f"run_id string, item_seq int, id string, kind string, media_type string, filename string, origin {REGION}, sha256 string"
ISSUE = f"run_id string, item_seq int, issue_no int, severity string, code string, args array<string>"

# Fixed values of the format.
QUESTION_TYPES = ("single_choice", "multiple_choice", "true_false", "drag_and_drop", "matching", "ordering", "fill_in_blank", "scenario", "case_study")
KIND_OF_TYPE = {"single_choice": "choice", "multiple_choice": "choice", "true_false": "choice", "drag_and_drop": "drag_and_drop", "matching": "matching", "ordering": "ordering", "fill_in_blank": "fill_in_blank"}
GROUP_KINDS = ("scenario", "case_study")
EXTENSIONS = {"image/png": ".png", "image/jpeg": ".jpg", "image/gif": ".gif", "image/bmp": ".bmp", "image/tiff": ".tiff"}
SERVED_TYPES = {".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".png": "image/png", ".gif": "image/gif"}
FORMAT_VERSION = "1.0"
