"""Sources: separators, bad lines, quoted commas, book layout, text."""

import tempfile

from latentforge.sources import files, tables, text


def _write(tmp, name, lines):
    p = f"{tmp}/{name}"
    with open(p, "w") as f:
        f.write("\n".join(lines) + "\n")
    return p


def test_read_ratings_multichar_sep_and_rejects(spark):
    tmp = tempfile.mkdtemp(dir="/tmp", prefix="lf-src-")
    p = _write(tmp, "r.dat", ["1::10::4.0::100", "2::11::3.5::200", "3::12::5.0",
                              "4::13::five::300", "5::14::1.0::400::extra", "1::3::::11",
                              "", "::::::"])
    raw = files.read_ratings_raw(spark, p).cache()
    good, bad = files.split_rejects(raw)
    assert sorted(r.user_id for r in good.collect()) == [1, 2]
    reasons = {r.line: r.reason for r in files.reject_reasons(bad, "::", 4).collect()}
    assert reasons["3::12::5.0"] == "field_count"
    assert reasons["4::13::five::300"] == "parse"
    assert reasons["5::14::1.0::400::extra"] == "field_count"
    assert reasons["1::3::::11"] == reasons["::::::"] == "null_field"
    assert good.count() + bad.count() == 8   # every line is on one side


def test_failfast_raises(spark):
    import pytest
    tmp = tempfile.mkdtemp(dir="/tmp", prefix="lf-src-")
    p = _write(tmp, "r.dat", ["1::10::4.0::100", "4::13::five::300"])
    assert files.read_ratings(spark, p).count() == 1
    with pytest.raises(Exception, match="(?i)malformed"):
        files.read_ratings(spark, p, mode="FAILFAST").collect()


def test_read_items_keeps_quoted_commas(spark):
    tmp = tempfile.mkdtemp(dir="/tmp", prefix="lf-src-")
    p = _write(tmp, "m.csv", ['1,"Toy Story, The (1995)","Animation|Comedy"',
                              '2,"Heat (1995)","Action"'])
    rows = {r.item_id: r for r in files.read_items(spark, p).collect()}
    assert rows[1].title == "Toy Story, The (1995)"
    assert rows[1].genres == ["Animation", "Comedy"]
    assert rows[2].genres == ["Action"]


def test_read_book_ratings_strips_quotes(spark):
    tmp = tempfile.mkdtemp(dir="/tmp", prefix="lf-src-")
    p = _write(tmp, "b.csv", ['"276725";"034545104X";"0"', '"276726";"0155061224";"5"'])
    rows = sorted(files.read_book_ratings(spark, p).collect())
    assert [(r.user_id, r.isbn, r.rating) for r in rows] == [
        (276725, "034545104X", 0), (276726, "0155061224", 5)]


def test_ratings_view_shape(spark):
    from tests.conftest import SF_SMALL
    v = tables.ratings_view(spark, SF_SMALL)
    assert v.columns == ["user_id", "item_id", "rating", "ts", "l_orderkey", "l_linenumber"]
    s = v.agg({"rating": "min"}).first()[0], v.agg({"rating": "max"}).first()[0]
    assert 1.0 <= s[0] and s[1] <= 5.0


def test_count_lines(spark):
    df = spark.createDataFrame([("abc",), ("b",), ("xyz",), ("",)], "line string")
    r = text.count_lines(df, {"a": "a", "b": "b"}).first()
    assert (r.n_lines, r.a, r.b) == (4, 1, 2)


def test_text_file_lines_and_counts(spark):
    tmp = tempfile.mkdtemp(dir="/tmp", prefix="lf-src-")
    p = _write(tmp, "t.txt", ["spark is fast", "b only", "no match here?", "a and b"])
    lines = text.read_lines(spark, p)
    r = text.count_lines(lines, {"num_as": "a", "num_bs": "b"}).first()
    assert (r.n_lines, r.num_as, r.num_bs) == (4, 3, 2)


def test_text_lines_keep_whole_documents(spark):
    from tests.conftest import SF_SMALL
    d = tables.table(spark, SF_SMALL, "documents")
    total_newlines = d.selectExpr("sum(size(split(text, '\\n', -1)))").first()[0]
    assert tables.text_lines(spark, SF_SMALL).count() == total_newlines
