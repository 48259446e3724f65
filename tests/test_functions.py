"""Scalar functions on links, names, texts and pages."""

import datetime

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import search


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first()[0]


@pytest.mark.parametrize(
    ("function", "given", "want"),
    [
        (T.arxiv_link, "https://arxiv.org/pdf/2401.00001v12", "https://arxiv.org/abs/2401.000012"),
        (T.arxiv_link, "https://arxiv.org/pdf/2401.00001v5", "https://arxiv.org/abs/2401.00001v5"),
        (T.arxiv_link, "https://arxiv.org/pdf/2401.00001v2.pdf", "https://arxiv.org/abs/2401.00001"),
        (T.arxiv_link, None, None),
        (T.identifier_id, "https://arxiv.org/abs/2401.1v2?x=1", "2401.1"),
        (T.identifier_id, "arxiv:2401.1v3", "2401.1"),
        (T.versionless_id, "2401.1v3", "2401.1"),
        (T.clean_url, " \\url{https://huggingface.co/a} ", "https://hf.co/a"),
        (T.clean_title, "A: b\r\nc", "A b c"),
        (T.word_count, "", 1),
        (T.word_count, "a  b ", 4),
        (T.path_part, "a/b", None),
        (T.repository_kind, "https://github.com/a", "git"),
        (T.display_model, "qwen_qwen-2.5-72b-instruct-browsing", "Qwen 2.5 72B Browsing"),
        (T.display_model, "other", "other"),
        (T.path_to_model, "a_b-browsing", "a/b"),
        (T.bibtex_id, "https://arxiv.org/pdf/2401.1v2.pdf", "2401.1"),
        (T.bibtex_id, "https://example.org/x", None),
        (T.strip_comments, "a 5\\% b % c\nd", "a 5\\% b \nd"),
        (T.page_text, "<title>T</title><script>'</p>'</script><p>a &amp; <b>b</b></p><p class='x'>c</p>", "Title: T\n\na & b c"),
        (T.page_text, "<p>a</p>", "Title: Untitled Page\n\na"),
        (T.says_yes, "YES.", True),
        (T.says_yes, None, False),
        (T.strip, "\u00a0 a\t", "a"),
        (T.python_text, "it's", '"it\'s"'),
        (T.python_text, None, "None"),
    ],
)
def test_text(spark, function, given, want):
    assert one(spark, given, function) == want


def test_numbers_as_python_writes_them(spark):
    for x in (1.0, 0.5, 1e7, -3.0, 123456789.0):
        assert one(spark, x, T.python_float, "double") == str(x)


def test_contexts(spark):
    assert one(spark, "abcdefghi", lambda c: T.cut_context(c, "half")) == "abcd"
    assert one(spark, "abcdefghi", lambda c: T.cut_context(c, "quarter")) == "ab"
    with pytest.raises(ValueError, match="context"):
        T.cut_context(F.col("x"), "third")
    assert one(spark, "a b c d", lambda c: T.trim_tokens(c, 5, 3)) == "a b"
    assert one(spark, "a b c", lambda c: T.trim_tokens(c, 5, 3)) == "a b c"


def test_file_types(spark):
    kinds = {b"\x1f\x8b\x08": "gzip", b"%PDF-1.4": "pdf", b"\\begin{document}": "tex", b"\xff\xfe": "unknown", b"": "unknown", b"\0" * 257 + b"ustar": "tar"}
    for content, kind in kinds.items():
        assert one(spark, bytearray(content), T.file_type, "binary") == kind


def test_date_query(spark):
    q = lambda y, m: spark.range(1).select(T.date_query(F.lit(y).cast("int"), F.lit(m).cast("int"))).first()[0]
    assert q(2024, 12) == "submittedDate:[202412010000 TO 202501010000]"
    assert q(2024, None) == "submittedDate:[202401010000 TO 202501010000]" and q(None, 3) == ""
    with pytest.raises(Exception, match="Month"):
        q(2024, 13)
    with pytest.raises(ValueError, match="Month"):
        search.window(2024, 0)


def test_search(spark):
    day = datetime.datetime(2024, 2, 1)
    rows = [("1", "Arabic News Set", day, "cs.CL"), ("2", "arabic set", day, "cs.LG"), ("3", "Other", day, "cs.CL"), ("4", "Arabic set old", datetime.datetime(2023, 1, 1), "cs.CL"), ("5", None, None, None)]
    papers = spark.createDataFrame(rows, "paper_id string, title string, published timestamp, category string")
    ids = lambda df: [r.paper_id for r in df.collect()]
    assert ids(search.search(papers, ["arabic", "SET"])) == ["2", "4", "1"]
    assert ids(search.search(papers, ["arabic"], ["cs.CL"], year=2024)) == ["1"]
    assert search.listing(papers.limit(0)) == "No results found."
    assert search.listing(search.search(papers, ["other"])).startswith("1. Other")
