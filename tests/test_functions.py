import pytest
from pyspark.sql import functions as F

from findwell.functions import distance, hashing
from findwell.functions import metadata as M
from findwell.functions import paths as P
from findwell.functions import query as Q
from findwell.functions import text as T
from findwell.functions import vectors as V


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("text, want", [("  a \t b\n\nc ", "a b c"), ("", ""), (None, None), (" ", "")])
def test_preprocess(spark, text, want):
    assert one(spark, T.preprocess(F.lit(text))) == want


@pytest.mark.parametrize(
    "query, terms, phrases, negated, kind",
    [
        ("", [], [], [], "single"), ("Budget", ["budget"], [], [], "single"), ("a b", ["a", "b"], [], [], "multi"),
        ('"Annual Report" x', ["x"], ["annual report"], [], "phrase"), ("a -b NOT c", ["a", "c"], [], ["b"], "boolean"),
        ("re* ports", ["re", "ports"], [], [], "wildcard"), ("x AND (y) or snake_case-", ["x", "y", "snake_case-"], [], [], "multi"), ("''", [], [], [], "single"), ("c++ $5", ["c++", "$5"], [], [], "multi"),
    ],
)
def test_query_analysis(spark, query, terms, phrases, negated, kind):
    row = spark.range(1).select(Q.analyzed(F.lit(query)).alias("a")).first()["a"]
    assert (row["terms"], row["phrases"], row["negated"], row["query_type"]) == (terms, phrases, negated, kind)


def test_tokens_of_terms_and_phrases(spark):
    assert one(spark, Q.match_tokens(F.lit('a b "b c" a'))) == ["a", "b", "c"]


@pytest.mark.parametrize("name, words, ext", [("My_File-v1.2.TXT", "my file v1 2", "txt"), (".bashrc", "bashrc", ""), ("plain", "plain", ""), ("", "", "")])
def test_filenames(spark, name, words, ext):
    assert one(spark, T.filename_words(F.lit(name))) == words
    assert one(spark, T.extension(F.lit(name))) == ext


@pytest.mark.parametrize("terms, text, want", [(["a", "b"], "xa b", True), (["b", "a"], "a b", False), ([], "x", True), (["aa", "a"], "aaa", True), (["q"], "x", False)])
def test_order_of_terms(spark, terms, text, want):
    xs = F.array(*map(F.lit, terms)) if terms else F.expr("cast(array() as array<string>)")
    assert one(spark, T.terms_in_order(xs, F.lit(text))) is want


def test_substrings_count_inside_words(spark):
    assert one(spark, T.occurrences(F.lit("AN"), F.lit("banana"))) == 2
    assert one(spark, T.occurrences(F.lit(""), F.lit("x"))) == 0
    assert one(spark, T.count_terms_in(F.array(F.lit("an"), F.lit("zz")), F.lit("BANANA"))) == 1
    assert one(spark, T.all_terms_in(F.expr("cast(array() as array<string>)"), F.lit("x"))) is False


def test_shortening(spark):
    assert one(spark, T.truncate(F.lit("héllo"), 3)) == "hél..."
    assert one(spark, T.truncate(F.lit("abc"), 0)) == "abc"
    assert one(spark, T.one_line(F.lit(" a\tb\n"))) == "a b"
    assert one(spark, T.first_words(F.lit("a b c"), 2)) == "a b..."


def test_headers_of_three_kinds(spark):
    found = one(spark, T.headers(F.lit("# One\ntext\n## Two \n<h3>Three</h3>\nFour\n====\n")))
    assert [(h["level"], h["text"]) for h in found] == [(1, "One"), (2, "Two"), (3, "Three"), (1, "Four")]
    assert [h["position"] for h in found[:2]] == [0, 11]


@pytest.mark.parametrize("path, want", [("/a/b/c.txt", ["a", "b"]), ("/a/./b/../c/d", ["a", "c"]), ("../../a/b", ["..", "..", "a"]), ("/..//a/", []), ("a/..", []), ("x.txt", []), ("", []), ("/", [])])
def test_path_components(spark, path, want):
    assert one(spark, P.path_components(F.lit(path))) == want


def test_path_predicates(spark):
    assert one(spark, P.matches_pattern(F.lit("/home/Docs/a.txt"), "docs*.TXT")) is True
    assert one(spark, P.matches_pattern(F.lit("/home/a.txt"), "b*")) is False
    assert one(spark, P.matches_pattern(F.lit("/x"), "")) is True
    assert one(spark, P.under_root(F.lit("/ab/c"), "/a")) is False
    assert one(spark, P.extension_allowed(F.lit("/a/B.TXT"), ["txt"])) is True
    assert one(spark, P.extension_allowed(F.lit("/a/B"), [])) is True
    assert one(spark, P.file_id(F.lit("/a/../b"))) == one(spark, P.file_id(F.lit("/b")))


@pytest.mark.parametrize("a, b, plain, aligned", [("kitten", "sitting", 3, 3), ("ab", "ba", 2, 1), ("ca", "abc", 3, 3), ("", "abc", 3, 3), ("日本語", "日本", 1, 1), ("same", "same", 0, 0)])
def test_edit_distances_are_symmetric(spark, a, b, plain, aligned):
    for x, y in ((a, b), (b, a)):
        assert one(spark, distance.levenshtein(F.lit(x), F.lit(y))) == plain
        assert one(spark, distance.damerau(F.lit(x), F.lit(y))) == aligned


def test_vectors(spark):
    v = lambda *xs: F.array(*[F.lit(float(x)).cast("float") for x in xs])
    assert one(spark, V.inner_product(v(1, 2), v(3, 4))) == 11
    assert one(spark, V.inner_product(v(1, 2), v(3))) == 0
    assert one(spark, V.cosine_of_units(v(1, 0), v(-1, 0))) == 0
    assert one(spark, V.normalized_vector(v(3, 4))) == pytest.approx([0.6, 0.8])
    assert one(spark, V.normalized_vector(v(0, 0))) == [0, 0]
    with pytest.raises(Exception, match="dimensions"):
        one(spark, V.checked(v(1), 2))


def test_metadata(spark):
    m = M.from_json(F.lit('{"author": "Ann", "tags": ["a b", "c"], "n": 5, "source_size": "7"}'))
    assert one(spark, M.all_text(m)) == "Ann 5 a b c"
    assert one(spark, M.field_items(m, "tags")) == ["a b", "c"]
    assert one(spark, M.field_items(M.from_json(F.lit('{"k": "x,y;|z"}')), "k")) == ["x", "y", "z"]
    assert one(spark, M.field_text(m, "none")) == ""
    assert one(spark, M.from_json(F.lit("{broken"))) == {}
    assert one(spark, M.digits(F.lit("12x"))) == 0
    assert one(spark, M.integer(F.lit("-3"))) == -3


def test_hashes_and_tokens(spark):
    assert hashing.hash_string("ab") == 31 * 97 + 98
    assert hashing.hash_string("a" * 40) >= 0
    assert hashing.token_ids("x y", 6) == [101, 120, 121, 102, 0, 0]
    v = hashing.mock_vector("text", 8)
    assert (v == hashing.mock_vector("text", 8)).all() and abs((v * v).sum() - 1) < 1e-6
