import pytest
from pyspark.sql import functions as F

from quillmere.functions import globs
from quillmere.functions import scalars as S
from quillmere.operators import chunking
from quillmere.operators.embed import HashEmbedder
from quillmere.operators.text_index import query_terms


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()[0]


@pytest.mark.parametrize(("pattern", "path", "fits"), [
    ("docs/*", "docs/a/b.md", True), ("*.md", "a/b.md", True), ("**/x.md", "a/b/x.md", True), ("**/x.md", "x.md", True), ("a?c", "abc", True),
    ("[!a]b", "cb", True), ("[!a]b", "ab", False), ("a**b", "ab", False), ("[x", "x", False), ("docs/*", "notes/a", False),
])
def test_globs(spark, pattern, path, fits):
    assert value(spark, globs.glob_match(F.lit(path), pattern)) == fits


def test_ignore_rules(spark):
    rules = ["shards/", "*.old.md", "!keep.old.md"]
    for path, want in (("shards/a.md", True), ("x/shards/a.md", True), ("a.old.md", True), ("keep.old.md", False), ("a.md", False), (".git/config", True), ("foo.pyc", True), ("x/.DS_Store", True)):
        assert value(spark, globs.ignored(F.lit(path), rules)) == want, path


@pytest.mark.parametrize(("name", "ext", "stem"), [("a.PDF", "pdf", "a"), (".bashrc", None, ".bashrc"), ("foo.", "", "foo"), ("plain", None, "plain"), ("a.tar.gz", "gz", "a.tar")])
def test_names(spark, name, ext, stem):
    assert value(spark, S.extension(F.lit(name))) == ext
    assert value(spark, S.file_stem(F.lit(name))) == stem


def test_text_functions(spark):
    assert value(spark, S.strip_spans(F.lit('A <span class="k">kiln</span>, two <span>pots</span>'))) == "A kiln, two pots"
    md = '---\nglaze: "celadon"\ncone: 10: hot\nglaze: " ash "\n---\nfired twice'
    assert value(spark, S.frontmatter(F.lit(md))) == {"glaze": " ash ", "cone": "10: hot"}
    assert value(spark, S.frontmatter_body(F.lit(md))) == "fired twice"
    assert value(spark, S.output_path(F.lit("clay/bowl.pdf"))) == "clay/bowl.pdf.md"
    assert value(spark, S.output_path(F.lit("clay/bowl.pdf"), False)) == "clay/bowl.md"
    assert value(spark, S.annotated_source(S.annotation(F.lit("clay/Tall Jar.pdf"), F.lit("0" * 64), F.lit("pdf"), F.lit(5)))) == "clay/Tall%20Jar.pdf"
    assert value(spark, S.annotated_source(F.lit("# a heading"))) is None
    assert value(spark, S.csv_escaped(F.lit('pot, "glazed"'))) == '"pot, ""glazed"""'
    assert value(spark, S.human_size(F.lit(1536))) == "1.5K" and value(spark, S.human_size(F.lit(12))) == "12B"
    assert value(spark, S.iso_ms(F.lit("2024-01-01T00:00:01Z"))) == 1704067201000
    assert value(spark, S.base64url(F.lit("a?b>"))) == "YT9iPg"
    assert [value(spark, c) for c in S.share_parts(F.lit("\\\\server\\team\\docs"))] == ["server", "team"]
    assert [value(spark, c) for c in S.share_parts(F.lit("smb://files.corp/shared/x"))] == ["files.corp", "shared"]


def test_chunker():
    one = chunking.chunk("## Wheel\n\nCentre the clay first.", None, 50, 100, 5)
    assert len(one) == 1 and one[0][3] == "Wheel" and "Wheel" not in one[0][1]
    two = chunking.chunk("## Slip\n\nThin it.\n\n## Score\n\nCut it.", None, 50, 100, 5)
    assert [c[3] for c in two] == ["Slip", "Score"] and two[1][1].endswith("Cut it.\n\n")
    nested = chunking.chunk("before\n\n# A\n\na\n\n## B\n\nb\n\n# C\n\nc", "file")
    assert [c[3] for c in nested] == ["file", "A", "A > B", "C"]
    assert chunking.chunk("  \n") == []
    big = chunking.chunk("\n\n".join(["word " * 30] * 40), None, 100, 120, 10)
    assert len(big) > 5 and [c[0] for c in big] == list(range(len(big)))
    assert big[1][1].startswith(chunking.tail(big[0][1], 10))
    assert chunking.tail("aé" * 10, 1).encode().decode() == chunking.tail("aé" * 10, 1)
    assert chunking.chunk("* * *\n\ntext", None)[0][1].strip() == "text"


def test_embedder_and_terms():
    v = HashEmbedder().embed(["x", "x", "y"])
    assert v[0] == v[1] != v[2] and len(v[0]) == 1024 and abs(sum(a * a for a in v[0]) - 1) < 1e-4
    assert query_terms('NOT "raku!" ^*') == ["not", "raku"] and query_terms("wax-resist a_b") == ["waxresist", "a_b"]


CASES = [
    (["**/foo"], "foo", True), (["**/foo"], "x/foo/y", True), (["a/**/b"], "a/b", True), (["a/**/b"], "a/x/y/b", True), (["a/**/b"], "c/a/b", False), (["*.py[co]"], "x.pyc", True), (["*.py[co]"], "d/x.pyo", True), (["*.py[co]"], "x.pyx", False),
    ([r"\#x"], "#x", True), ([r"\!x"], "!x", True), (["a b\\ "], "a b ", True), (["x  "], "x", True), (["drafts/"], "drafts/d.md", True), (["drafts/"], "drafts", False), (["/a.md"], "b/a.md", False), (["/a.md"], "a.md", True),
    (["*.log.md", "!important.log.md"], "logs/important.log.md", False), (["!logs/k.md", "logs/"], "logs/k.md", False), (["logs/", "!logs/k.md"], "logs/k.md", False), (["abc/**"], "abc/x/y", True), (["abc/**"], "abc", False),
    (["[!a]x"], "bx", True), (["[!a]x"], "ax", False), (["[^a]x"], "/x", False), (["[a-c]x"], "bx", True), (["foo*bar"], "foo/bar", False), (["a?c"], "a/c", False), (["[x"], "[x", False), (["**"], "q/r", True), (["a**b"], "axxb", True), (["# c", "", "!"], "c", False), (["foo*"], "foobar", True), (["!foo*", "*"], "foo", True),
]


def test_ignore_patterns(spark):
    """By the Column and by the walker's form alike."""
    for rules, path, want in CASES:
        assert globs.Ignorer(rules, False)(path) == want, (rules, path)
    for rules in {tuple(r) for r, _, _ in CASES}:
        mine = [(p, w) for r, p, w in CASES if tuple(r) == rules]
        got = spark.createDataFrame(mine, "path string, want boolean").withColumn("got", globs.ignored(F.col("path"), rules, False))
        assert got.where("got <> want").count() == 0, rules
    assert globs.Ignorer()("a/.git/x") and globs.Ignorer()("node_modules", True) and not globs.Ignorer([])("a.md")
