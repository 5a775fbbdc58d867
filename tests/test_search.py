from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from loomdex.functions import globs, text, vectors
from loomdex.operators import chunking, context, search


def make_files(spark, rows):
    return spark.createDataFrame(rows, "filePath string, language string, content string")


def numbered(n, word="line"):
    return "\n".join(f"{word}-{i}" for i in range(1, n + 1))


def test_line_windows(spark):
    f = make_files(spark, [("a", "text", numbered(120)), ("b", "text", numbered(55) + "\n"), ("c", "text", ""), ("d", "text", None), ("e", "text", "\n")])
    got = {}
    for r in chunking.line_windows(f).orderBy("filePath", "startLine").collect():
        got.setdefault(r.filePath, []).append((r.startLine, r.endLine, r.id))
    assert [x[0] for x in got["a"]] == [1, 41, 81]
    assert [x[:2] for x in got["b"]] == [(1, 50), (41, 55)]
    assert got["e"] == [(1, 1, "e:1-1:file-1")]
    assert "c" not in got and "d" not in got


def test_line_windows_equal_a_loop(spark):
    f = make_files(spark, [(str(n), "text", numbered(n)) for n in range(1, 130, 3)])
    for size, overlap in ((50, 10), (20, 5), (4, 0)):
        want = set()
        for n in range(1, 130, 3):
            start = 1
            while True:
                end = min(start + size - 1, n)
                want.add((str(n), start, end))
                if end == n:
                    break
                start += size - overlap
        assert {(r.filePath, r.startLine, r.endLine) for r in chunking.line_windows(f, size, overlap).collect()} == want


@pytest.mark.parametrize("overlap", [50, -1])
def test_bad_overlap(spark, overlap):
    with pytest.raises(ValueError):
        chunking.line_windows(make_files(spark, [("a", "t", "x")]), 50, overlap)


def test_split_long():
    assert chunking.split_long("x" * 250, 7, 100) == [("x" * 100, 7, 7), ("x" * 100, 7, 7), ("x" * 50, 7, 7)]
    assert chunking.split_long("aa\nbb\ncc", 1, 5) == [("aa\nbb", 1, 2), ("cc", 3, 3)]
    assert chunking.split_long("abc", 1, 0) == [("abc", 1, 1)]
    assert [p for p, _, _ in chunking.split_long("\U0001f600" * 3, 1, 5)] == ["\U0001f600" * 2, "\U0001f600"]


def test_chunk_files_falls_back_to_lines(spark):
    def broken(_):
        raise RuntimeError

    f = make_files(spark, [("a.py", "python", numbered(55, "broken")), ("b.ts", "typescript", "const x = 1;\n"), ("c.py", "python", "def f():\n    return 1\n")])
    got = chunking.chunk_files(f, parsers={"python": broken}).collect()
    assert sorted((r.filePath, r.symbolKind) for r in got) == [("a.py", "file"), ("a.py", "file"), ("b.ts", "file"), ("c.py", "file")]
    assert [(r.symbolKind, r.symbolName) for r in chunking.chunk_files(f).where("filePath = 'c.py'").collect()] == [("function", "f")]


def chunk(path, start=1, end=1, name=None):
    return (f"{path}:{start}-{end}:x", path, "c", "typescript", name, "function", start, end)


CHUNK = "id string, filePath string, content string, language string, symbolName string, symbolKind string, startLine int, endLine int"


def test_fusion_of_a_shared_chunk(spark):
    c = spark.createDataFrame([chunk("src/a.ts")], CHUNK)
    one = c.select(F.struct("*").alias("chunk"), F.lit("semantic").alias("source"), F.lit(0).alias("leg"), F.lit(0).alias("pos"))
    two = one.withColumn("source", F.lit("grep")).withColumn("leg", F.lit(1))
    (row,) = search.fuse(one.unionByName(two)).collect()
    assert row.source == "hybrid" and row.rank == 1 and abs(row.score - 2 / 61) < 1e-12


def test_lines_meet_the_best_chunk_or_stand_alone(spark):
    s = spark.createDataFrame([(*chunk("a", 1, 50), 1), (*chunk("a", 41, 90), 0)], CHUNK + ", pos int")
    m = spark.createDataFrame([("a", 45, "x", 0), ("a", 95, "y", 1), ("b.py", 45, "z", 2)], "filePath string, lineNumber int, lineText string, pos int")
    got = {r.pos: r.chunk for r in search.lines_to_chunks(m, s).collect()}
    assert got[0].id == "a:41-90:x"
    assert (got[1].id, got[1].symbolName, got[1].symbolKind) == ("a:95", "line_95", "unknown")
    assert got[2].language == "python"


def test_submatches_are_byte_offsets(spark):
    m = spark.createDataFrame([("a", 1, "é the The")], "filePath string, lineNumber int, lineText string")
    (r,) = search.submatches(m, "the").collect()
    assert [(x.start, x.end, x.match) for x in r.submatches] == [(3, 6, "the"), (7, 10, "The")]


def test_knn(spark):
    rows = spark.createDataFrame([("a", "1", [1.0, 0.0]), ("b", "2", [0.0, 1.0]), ("c", "3", [0.0, 0.0]), ("d", "4", [1.0, 1.0])], "filePath string, id string, vector array<double>")
    for arrow in (False, True):
        got = search.knn(rows, [1.0, 0.0], 4, arrow=arrow).collect()
        assert [r.id for r in got] == ["1", "4", "2", "3"]
        assert abs(got[1].score - 2**-0.5) < 1e-12 and got[3].score == 0
    for k in (0, -1, 1.5, True):
        with pytest.raises(ValueError):
            search.knn(rows, [1.0, 0.0], k)
    with pytest.raises(ValueError):
        vectors.cosine(F.col("vector"), [float("nan")])


@pytest.mark.parametrize(
    ("glob", "path", "hit"),
    [("*.ts", "a.ts", True), ("*.ts", "x/a.ts", False), ("**/*.ts", "x/a.ts", True), ("src/**", "src/a/b", True), ("a?c", "abc", True), ("a?c", "a/c", False), ("a.c", "abc", False), ("[a]", "[a]", True), ("{a}", "a", False)],
)
def test_globs(spark, glob, path, hit):
    df = spark.createDataFrame([(path,)], "p string")
    assert df.select(globs.glob_filter(F.col("p"), [glob])).first()[0] is hit


def test_glob_lists_and_checks(spark):
    df = spark.createDataFrame([("a.ts",)], "p string")
    assert df.select(globs.glob_filter(F.col("p"), None), globs.glob_filter(F.col("p"), []), globs.glob_filter(F.col("p"), [" "])).first() == (True, True, False)
    for bad in ("../x", "a/../b", "{a,..}", "..\\x"):
        with pytest.raises(globs.PathTraversalError):
            globs.check_glob(bad)
    assert globs.check_glob("a..b/*") == "a..b/*"


def test_ignores(spark):
    df = spark.createDataFrame([("node_modules/x/y.js",), ("a/node_modules/z",), ("src/a.ts",), (".env.local",), ("x/yarn.lock",), ("nodes/a",)], "p string")
    kept = df.where(~globs.ignored(F.col("p"), globs.ignore_list())).collect()
    assert [r.p for r in kept] == ["src/a.ts", "nodes/a"]


@pytest.mark.parametrize(("value", "ok"), [("src/a.ts", True), ("", True), ("\u00e9\U0001f600\u0301 :.", True), ("a\x00", False), ("a\nb", False), ("a\tb", False), ("\x7f", False), ("\u2028", False), ("\ue000", False), ("\ufeff", False), ("\u200b", False)])
def test_filter_values(spark, value, ok):
    assert spark.createDataFrame([(value,)], "v string").select(globs.valid_filter_value(F.col("v"))).first()[0] is ok


def test_sanitize(tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("x")
    (tmp_path / "out.txt").write_text("y")
    (tmp_path / "in" / "link").symlink_to(tmp_path / "out.txt")
    root = str(tmp_path / "in")
    assert globs.sanitize(root, "./a.txt") == "a.txt"
    for bad in ("../out.txt", "link"):
        with pytest.raises(globs.PathTraversalError):
            globs.sanitize(root, bad)
    with pytest.raises(FileNotFoundError):
        globs.sanitize(root, "none.txt")


def test_context_is_clamped_to_the_file(spark):
    f = make_files(spark, [("a", "t", numbered(100))])
    r = context.get_context(f, 50, 60).first()
    assert (r.startLine, r.endLine, r.content.split("\n")[0], r.totalLines) == (50, 60, "line-50", 100)
    assert context.get_context(f, 90, 500).first().endLine == 100
    assert context.get_context(f, 60, 50).count() == 0
    assert [tuple(context.get_context(f, s, e, True).first()[2:4]) for s, e in ((None, None), (95, None), (None, 10), (3, 4))] == [(1, 20), (95, 100), (1, 10), (3, 4)]


def test_snippets_and_merged_lines(spark):
    f = make_files(spark, [("a", "t", numbered(5))])
    r = spark.createDataFrame([("a", 2, 3), ("none", 1, 1)], "filePath string, startLine int, endLine int")
    got = {x.filePath: x for x in context.snippets(r, f, 1).collect()}
    assert got["a"].snippet == "line-1\nline-2\nline-3\nline-4" and got["none"].snippet is None
    ranges = spark.createDataFrame([("a", 1, 5), ("a", 3, 4), ("a", 6, 7), ("a", 9, 9), ("b", 1, 1)], "filePath string, startLine int, endLine int")
    assert {(x.filePath, x.islands, x.lines) for x in context.merged_lines(ranges).collect()} == {("a", 2, 8), ("b", 1, 1)}


def test_text_functions(spark):
    df = spark.createDataFrame([("a/b/c.TS", "\U0001f600a", 999), ("x", "", 1234)], "p string, s string, ms int")
    got = df.select(text.dirname(F.col("p")), text.basename(F.col("p")), text.ancestors(F.col("p")), text.utf16_length(F.col("s")), text.duration(F.col("ms")), text.extension_language(F.col("p"))).collect()
    assert tuple(got[0]) == ("a/b", "c.TS", ["a", "a/b"], 3, "999ms", "typescript")
    assert tuple(got[1]) == (None, "x", [], 0, "1.2s", "unknown")
