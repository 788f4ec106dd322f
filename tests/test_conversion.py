"""Texts, tables and pages to Markdown."""

import random

from pyspark.sql import functions as F

from docmark.functions import binary, html, tables, text
from docmark.functions.state import STATE_FIELDS, parse_state, state_json


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(fn(F.col("v")).alias("o")).first().o


def test_samples(spark):
    assert one(spark, "Hello plain text parsing", text.text_to_markdown) == (
        "Hello plain text parsing")
    page = one(spark, "<html><body><h1>Title</h1><p>Paragraph</p></body></html>", html.html_to_markdown)
    assert page == "# Title\n\nParagraph"
    csv = one(spark, "Header1,Header2\nValue1,Value2", tables.csv_to_markdown)
    assert csv == "| Header1 | Header2 |\n| --- | --- |\n| Value1 | Value2 |\n"
    assert one(spark, '{"key": "value"}', text.json_to_markdown) == '{"key": "value"}'
    xml = one(spark, "<root><element>content</element></root>", text.xml_to_markdown)
    assert "element" in xml and "content" in xml


def test_csv_edges(spark):
    def cells(raw):
        return one(spark, raw, tables.csv_grid)

    assert cells('a,b\r\n"x, y","say ""hi"""\r\n') == [["a", "b"], ["x, y", 'say "hi"']]
    assert cells('a,b\n\n"two\nlines",\n') == [["a", "b"], ["two\nlines", ""]]
    assert cells('a\n"open, end\nlast') == [["a"], ['"open', " end"], ["last"]]
    assert cells('it "is" so,b') == [['it "is" so', "b"]]
    assert cells(",\n") == [["", ""]]
    assert cells("") == []
    assert one(spark, "", tables.csv_to_markdown) == ""
    long = '"' + '""' * 200_000 + '",z'
    assert cells(long) == [['"' * 200_000, "z"]]


def test_json_validity(spark):
    for raw, ok in [('{"a": 1}', True), ("3", True), ('{"a": 1', False), ('"a": 1}', False),
                    ("1, 2", False), ("1] , [2", False), ('1}, {"a":2', False), ("", False)]:
        assert one(spark, raw, text.json_is_valid) is ok, raw


def test_html_features(spark):
    def md(raw):
        return one(spark, raw, html.html_to_markdown)

    assert md("<h2 class='x'>Two</h2>text<h6>Six</h6>") == "## Two\n\ntext\n\n###### Six"
    assert md('<p>a <a class="k" href="/u">t</a></p>') == "a [t](/u)"
    assert md("<p><strong>b</strong> <em>i</em></p>") == "**b** *i*"
    assert md("<p><b>open<p>next") == "open\n\nnext"
    assert md('<img alt="A" src="a.png"><img src="b.png" alt="B"><img src="c.png">') == (
        "![A](a.png)![B](b.png)![](c.png)")
    assert md("<ul><li>x</li><li>y</li></ul>") == "- x\n- y"
    assert md("a<br/>b") == "a\nb"
    assert md("&amp;lt; &lt;b&gt; &copy;&nbsp;&middot; &#39;&quot;") == "&lt; <b> © · '\""
    assert md("<head><title>t</title></head><header>kept</header>") == "kept"
    assert md('<script>var t="</p>";</script><!-- <p>no</p> --><style>p{}</style>x') == "x"
    assert md("<p>one</p>\n\n\n<p>   two   </p>") == "one\n\ntwo"


def test_html_tables(spark):
    raw = ("<p>before</p><table><tr><th>A</th><th>B</th></tr><tr><td>1|2</td><td><i>x</i></td></tr>"
           "<tr><td>only</td></tr></table>after<table></table>end")
    assert one(spark, raw, html.html_to_markdown) == (
        "before\n\n| A | B |\n| --- | --- |\n| 1\\|2 | x |\n| only |  |\n\nafter\n\nend")


def grid_rule(grid):
    """The table rule in plain Python."""
    if not grid or not grid[0]:
        return ""
    clean = [[(c or "").translate({13: " ", 10: " ", 124: "\\|"}).strip() for c in row] for row in grid]
    width = len(clean[0])
    lines = [clean[0], ["---"] * width]
    lines += [[row[i] if i < len(row) else "" for i in range(width)] for row in clean[1:]]
    return "".join("| " + " | ".join(cells) + " |\n" for cells in lines)


def test_grids_against_the_rule(spark):
    rng = random.Random(7)
    alphabet = ["", " ", "a", "|", "\n", "\r\n", " ", "　", "b c", "\x1f", "é"]

    def cell():
        return None if rng.random() < 0.1 else "".join(rng.choices(alphabet, k=rng.randint(0, 5)))

    grids = [[[cell() for _ in range(rng.randint(0, 4))] for _ in range(rng.randint(0, 5))]
             for _ in range(300)]
    rows = spark.createDataFrame(list(enumerate(grids)), "i int, g array<array<string>>")
    got = rows.select("i", tables.grid_to_markdown(F.col("g")).alias("m")).collect()
    assert {r.i: r.m for r in got} == {i: grid_rule(g) for i, g in enumerate(grids)}


def test_clean_cell_order(spark):
    assert one(spark, None, text.clean_cell) == ""
    assert one(spark, "\r\n a|b \n", text.clean_cell) == "a\\|b"
    assert one(spark, " x ", text.clean_cell) == "x"
    every = "".join(chr(c) for c in range(0x3100) if chr(c).isspace())
    assert one(spark, every + "k" + every, text.strip) == "k"
    assert one(spark, "​x", text.strip) == "​x"


def test_data_uri(spark):
    df = spark.createDataFrame(
        [(bytearray(b"x" * 100), "PNG"), (bytearray(b""), "svg"), (bytearray(b"\xff\x00"), "jpg")],
        "d binary, e string")
    got = [r.u for r in df.select(binary.data_uri(F.col("d"), F.col("e")).alias("u")).collect()]
    assert got[0].startswith("data:image/png;base64,eHh4") and "\n" not in got[0]
    assert got[1:] == ["data:application/octet-stream;base64,", "data:image/jpeg;base64,/wA="]


def test_state_round_trip(spark):
    row = ("t", None, 'n"x.txt', "standalone", "PARSING", "ACTIVE", None)
    schema = ", ".join(f"{f} string" for f in STATE_FIELDS)
    df = spark.createDataFrame([row], schema).select(state_json().alias("j"))
    raw = df.first().j
    assert '"batch_id":null' in raw and '"error_reason":null' in raw
    assert tuple(df.select(parse_state(F.col("j")).alias("s")).first().s) == row
