"""Pages of boxes to items: small documents with known answers, and the order of failures and notes against a replay."""

import random

import pytest
from pyspark.sql import functions as F

from quizmill.functions.text import plain_text
from quizmill.operators import lines, messages, pages
from quizmill.plans.bindings import written

SPANS = "doc_id long, page int, line_no int, span_no int, text string, font string, flags int, bbox array<double>"
TABLES = "doc_id long, page int, table_no int, bbox array<double>, rows array<array<string>>"
IMAGES = "doc_id long, page int, image_no int, bbox array<double>, xref long, ext string, error string"
DRAWINGS = "doc_id long, page int, rect_no int, bbox array<double>"
NOTES = "doc_id long, page int, note_no int, severity string, code string, args array<string>"


class Book:
    """Documents written line by line, 20 points apart."""

    def __init__(self):
        self.spans, self.tables, self.images, self.drawings, self.pages, self.y = [], [], [], [], set(), {}

    def line(self, doc, page, *texts, font="Times"):
        y = self.y[doc, page] = self.y.get((doc, page), 40.0) + 20
        self.pages.add((doc, page, 600.0, 800.0))
        x, no = 50.0, len(self.spans)
        for k, text in enumerate(texts):
            self.spans.append((doc, page, no, k, text, font, 4, [x, y, x + 6.0 * len(text), y + 10]))
            x += 6.0 * len(text)
        return y

    def content(self, spark, notes=()):
        made = lambda rows, schema: spark.createDataFrame(rows, schema)
        return pages.Pages(made(self.spans, SPANS), made(self.tables, TABLES), made(self.images, IMAGES), made(self.drawings, DRAWINGS), made(sorted(self.pages), "doc_id long, page int, width double, height double"), made(list(notes), NOTES))


@pytest.fixture(scope="module")
def document(spark):
    b = Book()
    # 1: an image, a figure of two strokes and a rule in the stem; a table in an option; a second page of the same question
    b.line(1, 1, "1. Refer ", "to the exhibit.")
    y = b.line(1, 1, "Then look below.")
    b.images.append((1, 1, 1, [50.0, y + 12, 90.0, y + 14], 7, "JPEG", None))
    b.drawings += [(1, 1, 1, [50.0, y + 16, 150.0, y + 17]), (1, 1, 2, [60.0, y + 12, 140.0, y + 36]), (1, 1, 3, [300.0, y, 305.0, y + 5]), (1, 1, 4, [300.0, y + 100, 400.0, y + 100])]
    b.y[1, 1] += 30
    b.line(1, 1, "A. Alpha")
    y = b.line(1, 1, "cell one", "cell two")
    b.tables.append((1, 1, 1, [48.0, y - 1, 200.0, y + 9], [["one", None], ["", "four"]]))
    b.tables.append((1, 1, 2, [0.0, 0.0, 600.0, 800.0], []))
    b.line(1, 1, "B. Beta")
    b.line(1, 2, "Answer: A")
    b.images.append((1, 2, 1, [50.0, 70.0, 90.0, 90.0], 9, "jpx", "no stream"))
    b.line(1, 2, "   ", "\t")
    # 2: monospace lines by font, and one that is not as its second span isn't
    b.line(2, 1, "Scenario 1: office")
    b.line(2, 1, "1. not a question", font="Courier New")
    b.line(2, 1, "plain")
    b.images.append((2, 1, 1, [50.0, 50.0, 60.0, 58.0], 1, "png", None))  # above the header: the preamble's
    b.images.append((2, 1, 2, [50.0, 106.0, 60.0, 112.0], 2, "x", None))
    b.line(2, 1, "1. Stem?")
    # 3: nothing to see; 4: a title only
    b.line(3, 1, " ")
    b.line(4, 1, "Just a title page")
    content = b.content(spark)
    return content, pages.read_document(content, keep=written)


def test_questions_with_images_and_tables(spark, document):
    found = document[1]
    q = {(r.run_id, r.id): r for r in found.questions.collect()}[1, "q1"]
    assert [b.kind for b in q.stem] == ["text", "image", "image"] and q.stem[0].text == "Refer to the exhibit.\nThen look below."
    assert [b.asset_id for b in q.stem[1:]] == ["q1-img1", "q1-img2"] and q.source.pages == [1, 2]
    a, b = q.interaction.options
    assert [x.kind for x in a.content] == ["text", "table"] and a.content[1].rows == [["one", ""], ["", "four"]] and [(x.kind, x.asset_id) for x in b.content] == [("text", None), ("image", "q1-img3")]
    assert q.interaction.correct_option_ids == ["a"]
    # the picture on page two, below the key, still belongs to the last option
    assert [(i.severity, i.code, list(i.args), i.page) for i in q.issues] == [("info", "figure_cropped", ["1", "200"], 1), ("warning", "image_extraction_failed", ["9", "2", "no stream"], 2)]


def test_assets(document):
    found = {(r.run_id, r.id): r for r in document[1].assets.collect()}
    assert {k: (r.kind, r.media_type, r.page, r.item_seq) for k, r in found.items()} == {
        (1, "q1-img1"): ("embedded", "image/jpeg", 1, 1), (1, "q1-img2"): ("page_crop", "image/png", 1, 1), (1, "q1-img3"): ("page_crop", "image/png", 2, 1), (2, "g1-img1"): ("embedded", "image/x", 1, 1),
    }
    assert found[1, "q1-img2"].bbox == [50.0, 92.0, 150.0, 116.0]  # the strokes' union, without rule and empty box


def test_group_of_pages(document):
    made = document[1]
    (g,) = made.groups.collect()
    assert [b.kind for b in g.context] == ["verbatim", "text", "image"] and g.context[0].text == "1. not a question" and g.question_ids == ["q1"] and g.title == "Scenario 1: office"
    assert [(r.run_id, r.id, r.group_id) for r in made.questions.where("run_id = 2").collect()] == [(2, "q1", "g1")]


def test_sentences(spark, document):
    made = document[1].questions.where("run_id = 1").select(F.explode("issues").alias("i"))
    assert [r[0] for r in made.select(messages.sentence(F.col("i.code"), F.col("i.args"))).collect()] == [
        "vector figure on page 1 cropped from the original page region at 200 DPI", "embedded image xref 9 on page 2 could not be extracted (no stream); cropped the page region instead",
    ]
    args = spark.createDataFrame([(["group", "Scenario 1", "ValueError: x"],)], "args array<string>")
    assert args.select(messages.sentence(F.lit("extraction_error"), F.col("args"))).first()[0] == "failed to extract group 'Scenario 1': ValueError: x"


def items_of(found):
    rows = {}
    for r in found.orderBy("run_id", "item_seq").collect():
        rows.setdefault(r.run_id, []).append((r.item_seq, r.kind, r.id, r.ordinal, r.group_id, r.members, [(i.code, list(i.args)) for i in r.issues]))
    return rows


def test_documents_without_questions(document):
    content, made = document
    found = items_of(pages.document_items(made, content.pages))
    assert found[3] == [(1, "failed", None, 1, None, None, [("no_questions_found", [])])]
    assert found[4] == [(1, "failed", None, 1, None, None, [("no_questions_found", []), ("preamble_skipped", ["1", "1"])])]
    assert [x[1:6] for x in found[2]] == [("group", "g1", None, None, ["q1"]), ("question", "q1", 1, "g1", None)]


def replay(slices, preamble, notes, n_pages):
    """The items of one document by going through its pages. slices: (page it starts on, kind, no, group_no, label, error)."""
    out, pending, waiting, noted, emitted, ordinal = [], None, [], False, False, 0

    def emit(item, takes):
        nonlocal emitted, waiting
        emitted = True
        if takes:
            item[-1].extend(waiting)
            waiting = []
        out.append(item)

    def close():
        nonlocal pending
        if pending:
            head, members = pending
            pending = None
            head[4] = [m[1] for m in members if m[0] == "question"]
            emit(head, True)
            out.extend(members)

    def handle(s):
        nonlocal pending, ordinal
        _, kind, no, group_no, label, error, page = s
        if kind == "group":
            close()
            if error:
                waiting.append(("extraction_error", ["group", label, error]))
            else:
                pending = (["group", f"g{group_no}", None, None, None, []], [])
            return
        if error:
            item = ["failed", None, no, None, None, [("extraction_error", ["question", label, error])]]
        else:
            item = ["question", f"q{no}", no, pending[0][1] if pending else None, None, []]
        if pending:
            pending[1].append(item)
        else:
            emit(item, not error)

    def note_preamble():
        nonlocal noted
        if not noted and preamble:
            waiting.append(("preamble_skipped", preamble))
            noted = True

    for page in range(1, n_pages + 1):
        waiting += [(code, args) for p, code, args in notes if p == page]
        for k, s in enumerate(slices[:-1]):
            if slices[k + 1][0] == page:
                note_preamble()
                handle(s)
    if slices:
        note_preamble()
        handle(slices[-1])
    note_preamble()
    close()
    if not emitted:
        out.append(["failed", None, 1, None, None, [("no_questions_found", []), *waiting]])
    return [(i, *x) for i, x in enumerate(out, 1)]


def test_failures_and_notes_against_a_replay(spark):
    rnd = random.Random(9)
    b, notes, failures, want = Book(), [], [], {}
    for doc in range(60):
        n_pages, slices, before, ordinal, group = rnd.randrange(1, 5), [], [], 0, 0
        own = [(p, "table_detection_failed", [str(p), "x"]) for p in range(1, n_pages + 1) if rnd.random() < 0.4]
        notes += [(doc, p, 1, "warning", code, args) for p, code, args in own]
        for page in range(1, n_pages + 1):
            b.pages.add((doc, page, 600.0, 800.0))
            for _ in range(rnd.randrange(4)):
                kind = rnd.choice(["text", "question", "question", "group"])
                error = "E: x" if rnd.random() < 0.4 else None
                if kind == "text":
                    b.line(doc, page, "some words")
                    if not slices:
                        before.append(page)
                    continue
                if kind == "question":
                    ordinal += 1
                    b.line(doc, page, f"{ordinal}. what?")
                else:
                    group += 1
                    b.line(doc, page, f"Scenario {group}")
                slices.append((page, kind, ordinal if kind == "question" else None, group, f"{ordinal}." if kind == "question" else f"Scenario {group}", error, page))
                if error:
                    failures.append((doc, len(slices), error))
        want[doc] = replay(slices, [str(len(before)), ", ".join(map(str, dict.fromkeys(before)))] if before else None, own, n_pages)
    content = b.content(spark, notes)
    failed = spark.createDataFrame(failures + failures[:3], "doc_id long, slice_no int, error string")
    found = items_of(pages.document_items(pages.read_document(content, keep=written), content.pages, content.notes, failed))
    skip = {"no_options_detected"}  # every made question has none
    got = {doc: [(*x[:-1], [i for i in x[-1] if i[0] not in skip]) for x in rows] for doc, rows in found.items()}
    assert got == want


def test_empty_pages(spark):
    content = Book().content(spark)
    made = pages.read_document(content)
    assert made.questions.collect() == made.groups.collect() == made.assets.collect() == []
    assert pages.document_items(made, content.pages, content.notes).collect() == []


def test_text_of_blocks(document):
    rows = document[1].questions.where("run_id = 1").select(plain_text(F.col("stem"))).collect()
    assert rows[0][0].endswith("[image q1-img1]\n[image q1-img2]")
    assert lines.NEVER > 10**9
