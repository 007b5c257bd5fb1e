import random

from pyspark.sql import functions as F

from tidemark.sources import text


def transducer(line, sep=",", quote='"'):
    """Cells of a line, read sign by sign with one state."""
    out, cell, within, i = [], "", False, 0
    while i < len(line):
        c = line[i]
        if within and c == quote and line[i + 1 : i + 2] == quote:
            cell += quote
            i += 1
        elif c == quote:
            within = not within
        elif c == sep and not within:
            out.append(cell)
            cell = ""
        else:
            cell += c
        i += 1
    return [*out, cell]


def test_cells_equal_the_transducer(spark):
    rng = random.Random(4)
    some = ["".join(rng.choice('""",,ab \x01\x02\x03é$\\') for _ in range(rng.randrange(0, 14))) for _ in range(4000)]
    some += ["", '"', '""', '"""', '""""', '"a"b,c', 'x"d,e"f,g', '"abc,d', ",", "a,", '","', "\x01\x03,\x01"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(some)], "i int, line string")
    for sep in (",", "$", "\\", "", "||"):
        got = {r["i"]: r["cells"] for r in df.select("i", text.split_cells(F.col("line"), sep).alias("cells")).collect()}
        assert got == {i: transducer(x, sep[:1] or ",") for i, x in enumerate(some)}
    got = {r["i"]: r["cells"] for r in df.select("i", text.split_cells(F.col("line"), ",", None).alias("cells")).collect()}
    assert got == {i: x.split(",") for i, x in enumerate(some)}


def rows(df):
    return [r["cells"] for r in df.orderBy("file", "row_idx").collect()]


def grid(spark, tmp_path, content, **kw):
    path = tmp_path / f"{random.random()}.csv"
    path.write_bytes(content.encode())
    df = text.read_grid_csv(spark, str(path), **kw)
    assert [r["row_idx"] for r in df.orderBy("row_idx").collect()] == list(range(df.count()))
    return rows(df)


def test_lines_comments_and_empty_rows(spark, tmp_path):
    assert grid(spark, tmp_path, "# a\r\nt,v\r\n\r\n \t # b\r\n1,2\r\n") == [["t", "v"], [""], ["1", "2"]]
    assert grid(spark, tmp_path, "a\n\n") == [["a"]]
    assert grid(spark, tmp_path, "a\n\n\n") == [["a"], [""]]
    assert grid(spark, tmp_path, "a\n\n#x\n") == [["a"], [""]]
    assert grid(spark, tmp_path, "\n") == [] and grid(spark, tmp_path, "") == []
    assert grid(spark, tmp_path, "a\rb,c\n") == [["a\rb", "c"]]


def test_a_row_separator_of_its_own(spark, tmp_path):
    assert grid(spark, tmp_path, "t\tv||0.0\t10.0|  # note|0.1\t20.0|", sep="\t", row_sep="|") == [["t", "v"], ["0.0", "10.0"], ["0.1", "20.0"]]
    assert grid(spark, tmp_path, 'a,"b|c",d', row_sep="|") == [["a", "b"], ["c,d"]]
