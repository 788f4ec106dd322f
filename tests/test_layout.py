"""Layouts, assets and ordered texts."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from docmark import dims
from docmark.operators import assembly, assets, layout

TABLES = "doc_id string, page_no int, table_id int, bbox array<double>, grid array<array<string>>"
LINES = "doc_id string, page_no int, line_no int, top double, bottom double, text string"
PAGES = "doc_id string, page_no int, height double"
SPLITS = [False, True]


def frames(spark, tables, lines, pages):
    return (spark.createDataFrame(tables, TABLES).repartition(3),
            spark.createDataFrame(lines, LINES).repartition(3),
            spark.createDataFrame(pages, PAGES).repartition(3))


def box(top, bottom):
    return [0.0, float(top), 10.0, float(bottom)]


def regions_rule(tables, height):
    """``{ord: (top, bottom)}`` of one page from its tables in order."""
    edges = [(t[3][1], t[3][3]) for t in sorted(
        (t for t in tables if len(t[3]) == 4), key=lambda t: (t[3][1], t[2]))]
    starts = [0.0] + [bottom for _, bottom in edges]
    stops = [top for top, _ in edges] + [height]
    return {2 * i: (a, z) for i, (a, z) in enumerate(zip(starts, stops)) if a < z or not edges}


def random_pages(seed, docs=12):
    rng = random.Random(seed)
    tables, lines, pages = [], [], []
    for d in range(docs):
        for p in range(rng.randint(1, 4)):
            pages.append((f"d{d}", p, 100.0))
            for t in range(rng.choice([0, 0, 1, 2, 5])):
                top = rng.randint(0, 90)
                b = box(top, top + rng.choice([0, 5, 10, 60]))
                grid = rng.choice([[["h", "i"], [f"{t}", None]], [], [[]], None, [["", ""]]])
                tables.append((f"d{d}", p, t, b if rng.random() < 0.85 else b[:3], grid))
            for n in range(rng.choice([0, 3, 12])):
                y = float(rng.randint(-3, 104))
                lines.append((f"d{d}", p, n, y, y + 1, rng.choice(["  ", f" l{n} ", f"line {n}", None])))
    return tables, lines, pages


def page_of(rows, doc, page):
    return [r for r in rows if r[:2] == (doc, page)]


def document_rule(tables, lines, pages, doc):
    texts = []
    for _, page, height in sorted(p for p in pages if p[0] == doc):
        own = sorted((t for t in page_of(tables, doc, page) if len(t[3]) == 4),
                     key=lambda t: (t[3][1], t[2]))
        parts = {2 * i + 1: grid_text(t[4]) for i, t in enumerate(own)}
        for o, (top, bottom) in regions_rule(own, height).items():
            inside = sorted((ln for ln in page_of(lines, doc, page) if top <= ln[3] < bottom and ln[5] is not None),
                            key=lambda ln: (ln[3], ln[2]))
            parts[o] = "\n".join(ln[5] for ln in inside).strip()
        text = "\n\n".join(parts[o] for o in sorted(parts) if parts[o])
        if text:
            texts.append(text)
    return "\n\n---\n\n".join(texts)


def grid_text(grid):
    if not grid or not grid[0]:
        return ""
    rows = [[(c or "") for c in r] for r in grid]
    rows.insert(1, ["---"] * len(rows[0]))
    return "\n".join("| " + " | ".join(r) + " |" for r in rows)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_documents_against_the_rule(spark, seed):
    tables, lines, pages = random_pages(seed)
    got = {r.doc_id: (r.markdown, r.error)
           for r in layout.assemble_layout(*frames(spark, tables, lines, pages)).collect()}
    assert got == {d: (document_rule(tables, lines, pages, d), None) for d in {p[0] for p in pages}}


@pytest.mark.parametrize("split", SPLITS)
def test_steps_against_the_rule(spark, split):
    tables, lines, pages = random_pages(4, docs=20)
    lines = [ln for ln in lines if ln[5] is not None]
    t, ln, p = frames(spark, tables, lines, pages)
    ordered = layout.order_tables(t, ranges=9, split=split)
    regions = layout.text_regions(ordered, p, ranges=9, split=split)
    want = {(d, n, o, *r) for d, n, h in pages
            for o, r in regions_rule(page_of(tables, d, n), h).items()}
    assert {tuple(r) for r in regions.select(
        "doc_id", "page_no", "ord", "top", "bottom").collect()} == want
    placed = layout.assign_lines_to_regions(ln, regions, ranges=9, split=split)
    pairs = {(d, n, x[2], o) for d, n, o, a, z in want for x in page_of(lines, d, n) if a <= x[3] < z}
    have = [(r.doc_id, r.page_no, r.line_no, r.ord) for r in placed.collect()]
    assert set(have) == pairs and len(have) == len(pairs)


def test_one_page_of_text(spark):
    got = layout.assemble_layout(*frames(
        spark, [("x", 9, 0, box(0, 1), [["unused"]])][:0],
        [("a", 0, 0, 5.0, 6.0, "Page 1 text")], [("a", 0, 100.0), ("e", 0, 100.0)]))
    assert {r.doc_id: r.markdown for r in got.collect()} == {"a": "Page 1 text", "e": ""}


def test_bad_documents_fail_alone(spark):
    lines = [("big", 0, i, float(i), i + 1.0, "x" * 50) for i in range(20)]
    lines += [("ok", 0, 0, 1.0, 2.0, "fine"), ("torn", 0, 0, 1.0, 2.0, "lost")]
    pages = [("big", 0, 100.0), ("ok", 0, 100.0), ("torn", 0, 100.0), ("torn", 1, None)]
    got = layout.assemble_layout(*frames(spark, [], lines, pages)).collect()
    assert {r.doc_id: (r.markdown, r.error) for r in got} == {
        "big": ("\n".join(["x" * 50] * 20), None), "ok": ("fine", None), "torn": (None, dims.MARKDOWN_FAILED)}


def test_page_and_document_texts(spark):
    parts = spark.createDataFrame(
        [("d", 0, 2, " b "), ("d", 0, 1, "\na"), ("d", 0, 3, "  "), ("d", 2, 0, "c"), ("d", 1, 0, None)],
        "doc_id string, page_no int, ord int, text string")
    pages = assembly.assemble_page(parts)
    assert sorted((r.page_no, r.text) for r in pages.collect()) == [(0, "a\n\nb"), (2, "c")]
    docs = spark.createDataFrame([("d",), ("none",)], "doc_id string")
    made = assembly.assemble_document(pages, docs)
    assert {r.doc_id: r.markdown for r in made.collect()} == {"d": "a\n\nb\n\n---\n\nc", "none": ""}


def check_chunks(chunks, keys, limit, want):
    """Chunks lie side by side, are of bounded size, and make the wanted texts."""
    got = defaultdict(list)
    for r in chunks.collect():
        got[tuple(r[k] for k in keys)].append((r.chunk_no, r["at"], r.text))
    for key, rows in got.items():
        rows.sort()
        end = 0
        for _, at, text in rows:
            assert at == end and len(text.encode()) <= limit
            end += len(text.encode())
        assert "".join(t for _, _, t in rows) == want[key]
    assert got.keys() == want.keys()
    return got


@pytest.mark.parametrize("split", SPLITS)
def test_giant_texts_come_in_chunks(spark, split):
    """Page numbers are sparse and negative, pages of all lengths."""
    rows = [("hot" if i % 10 else "small", i * 10**9 - 7, f"pé{i}" + "x" * (i % 50)) for i in range(3_000)]
    pages = spark.createDataFrame(rows, "doc_id string, page_no long, text string").repartition(5)
    want = {(d,): "\n\n---\n\n".join(t for g, _, t in rows if g == d) for d in ("hot", "small")}
    chunks = assembly.document_chunks(pages, 1_000, split, 9)
    assert len(check_chunks(chunks, ["doc_id"], 1_100, want)["hot",]) > 50
    whole = assembly.assemble_document(pages, split=split, ranges=9)
    assert {(r.doc_id,): r.markdown for r in whole.collect()} == want


def test_one_text_for_near_order_values(spark):
    pages = spark.createDataFrame([("d", n, str(n)) for n in (1_000, 999, 10**12, -1)], "doc_id string, page_no long, text string")
    assert [r.markdown for r in assembly.assemble_document(pages).collect()] == [
        "-1\n\n---\n\n999\n\n---\n\n1000\n\n---\n\n1000000000000"]


@pytest.mark.parametrize("split", SPLITS)
def test_a_giant_document_of_a_layout(spark, split):
    n = 60
    lines = [("d", p, 0, 1.0, 2.0, f"page {p}") for p in range(n)] + [("e", 5, 0, 1.0, 2.0, "other")]
    pages = [("d", p, 9.0) for p in range(n)] + [("e", 5, 9.0)]
    got = layout.assemble_layout(*frames(spark, [], lines, pages), large_pages=10 if split else 1_000)
    assert {r.doc_id: r.markdown for r in got.collect()} == {
        "d": "\n\n---\n\n".join(f"page {p}" for p in range(n)), "e": "other"}


@pytest.mark.parametrize("split", SPLITS)
def test_frames_with_a_dominant_group(spark, split):
    df = spark.range(3_000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("g"),
        (F.col("id") * 10).alias("k"), F.concat(F.lit("v|"), "id").alias("v|x"))
    whole = {(r.g,): r.markdown for r in assembly.frame_to_markdown(df, ["g"], "k", ["k", "v|x"]).collect()}
    assert whole[1,] == "| k | v\\|x |\n| --- | --- |\n| 10 | v\\|1 |\n"
    assert whole[0,].count("\n") == 1_002
    chunks = assembly.frame_chunks(df, ["g"], "k", ["k", "v|x"], 500, split, 6)
    assert len(check_chunks(chunks, ["g"], 600, whole)[0,]) > 20


def test_cells(spark):
    cells = [("t", 5, 0, "a"), ("t", 5, 1, "b"), ("t", 7, 0, "1"), ("t", 6, 0, "x"), ("t", 6, 1, None),
             ("t", 6, 2, "cut"), ("u", 0, 0, "only")]
    df = spark.createDataFrame(cells, "table_id string, row int, col int, cell string")
    got = {(r.table_id,): r.markdown for r in assembly.cells_to_markdown(df).collect()}
    assert got == {("t",): "| a | b |\n| --- | --- |\n| x |  |\n| 1 |  |\n", ("u",): "| only |\n| --- |\n"}
    cut = check_chunks(assembly.cell_chunks(df, chunk_bytes=1), ["table_id"], 30, got)
    assert len(cut["t",]) == 3


def test_a_table_is_one_text_whatever_its_row_numbers(spark):
    df = spark.createDataFrame(
        [("t", n, 0, str(n)) for n in (3, 250_000, 9_000_000_000)], "table_id string, row long, col int, cell string")
    assert [r.markdown for r in assembly.cells_to_markdown(df).collect()] == ["| 3 |\n| --- |\n| 250000 |\n| 9000000000 |\n"]


ASSETS = "doc_id string, page_index long, image_index long, name string, data binary, extension string"


@pytest.fixture
def asset_frames(spark):
    docs = spark.createDataFrame([("a", "# A"), ("b", "text only")], "doc_id string, markdown string")
    rows = [("a", 1, 0, "logo.png", bytearray(b"2"), "png"), ("a", 0, 1, "x.gif", bytearray(b"1"), "gif"),
            ("a", 0, 0, "logo.png", bytearray(b"0"), "png")]
    return docs, spark.createDataFrame(rows, ASSETS)


def test_number_assets(spark):
    docs = spark.createDataFrame(
        [("d", [[("logo.png", bytearray(b"F"))], [], [(None, bytearray(b"G")), ("noext", bytearray(b"H"))]])],
        "doc_id string, pages array<array<struct<name:string,data:binary>>>")
    got = [(r.page_index, r.image_index, r.name, bytes(r.data), r.extension)
           for r in assets.number_assets(docs).collect()]
    assert sorted(got) == [(0, 0, "logo.png", b"F", "png"), (2, 0, "img_2_0", b"G", "png"),
                           (2, 1, "noext", b"H", "png")]


def test_embedding_and_linking(asset_frames):
    docs, images = asset_frames
    linked = {r.doc_id: r.markdown for r in assets.link_assets(docs, images).collect()}
    assert linked == {"a": "# A\n\n![logo.png](images/logo.png)\n\n![x.gif](images/x.gif)"
                           "\n\n![logo.png](images/logo.png)", "b": "text only"}
    inlined = {r.doc_id: r.markdown for r in assets.inline_assets(docs, images).collect()}
    assert inlined["a"].startswith("# A\n\n![logo.png](data:image/png;base64,MA==)\n\n![x.gif](data:image/gif;")
    cut = check_chunks(assets.asset_chunks(docs, images, False, 1), ["doc_id"], 40, {(k,): v for k, v in linked.items()})
    assert len(cut["a",]) == 4


def test_manifests(spark, asset_frames):
    got = assets.package_manifest(*asset_frames).orderBy("doc_id", "page_index", "image_index").collect()
    assert [(r.doc_id, r.path, bytes(r.data)) for r in got] == [
        ("a", "document.md", b"# A"), ("a", "images/logo.png", b"2"), ("a", "images/x.gif", b"1"),
        ("b", "document.md", b"text only")]
    outs = spark.createDataFrame(
        [("batch-0123", 0, "aaaaaaaa-1", "x.md"), ("batch-0123", 2, "aaaaaaaa-2", "x.md"),
         ("batch-0123", 1, "bbbbbbbb-1", "c.zip")],
        "batch_id string, pos int, task_id string, file_name string")
    made = assets.batch_manifest(outs).orderBy("entry_no").collect()
    assert [(r.archive_name, r.entry_no, r.entry_name, r.task_id) for r in made] == [
        ("Batch_Conversion_batch-01.zip", 0, "aaaaaaaa_x.md", "aaaaaaaa-2"),
        ("Batch_Conversion_batch-01.zip", 1, "bbbbbbbb_c.zip", "bbbbbbbb-1")]
