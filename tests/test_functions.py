"""Hand-computed values of text, vector and planner functions."""

import math
import random

import pytest
from pyspark.sql import functions as F

from mosslight.config import check_strategy, check_top_k
from mosslight.functions import html as H
from mosslight.functions import text as X
from mosslight.functions import urls as U
from mosslight.functions import vector as V
from mosslight.operators.chunking import CODE, MARKDOWN, RECURSIVE, split_text
from mosslight.plans import planner as P


def one(spark, value, schema, column):
    return spark.createDataFrame([(value,)], f"x {schema}").select(column(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize("d, want", [(None, 0.5), (float("nan"), 0.5), (0.0, 1.0), (1.0, 0.5), (2.0, 0.0), (2.1, 1 / 3.1), (-0.1, 1 / 1.1)])
def test_similarity(spark, d, want):
    assert one(spark, d, "double", V.similarity) == pytest.approx(want)


def test_measures(spark):
    row = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0], [0.0, 0.0])], "a array<double>, b array<double>, z array<double>")
    a, b, z = F.col("a"), F.col("b"), F.col("z")
    got = row.select(V.dot(a, b).alias("d"), V.cosine(a, b).alias("c"), V.euclidean(a, b).alias("e"), V.cosine(a, z).alias("n")).first()
    assert (got.d, got.e, got.n) == (24.0, pytest.approx(math.sqrt(2)), 0.0) and got.c == pytest.approx(24 / 25)
    with pytest.raises(Exception, match="different lengths"):
        spark.createDataFrame([([1.0], [1.0, 2.0])], "a array<double>, b array<double>").select(V.dot(a, b)).collect()


def test_keywords(spark):
    q = "What is the BEST way, to-day, way to learn C++ and été?"
    assert X.keyword_list(q) == one(spark, q, "string", X.keywords) == ["best", "way", "day", "learn"]
    assert X.keyword_list("alpha beta", ("beta",)) == ["alpha"]
    assert X.keyword_list("") == []


def test_keyword_score(spark):
    text, words = "alpha beta alpha", F.array(F.lit("alpha"), F.lit("gamma"))
    want = math.log(3) * (1 / (1 + math.log(1 + 3 / 100))) * 2 / 2
    assert one(spark, text, "string", lambda c: X.keyword_score(c, words)) == pytest.approx(min(1.0, want))
    assert one(spark, text, "string", lambda c: X.keyword_score(c, F.array().cast("array<string>"))) == 0.0
    late = "x " * 50 + "alpha"
    assert one(spark, late, "string", lambda c: X.keyword_score(c, F.array(F.lit("alpha")))) == pytest.approx(math.log(2) / (1 + math.log(1.51)) * (2 - 100 / 51))
    # ASCII word boundaries: an accented letter ends a word
    assert one(spark, "été ete t", "string", lambda c: F.regexp_count(c, F.lit(X.whole_word("t")))) == 2


@pytest.mark.parametrize("html, want", [("<p>a&amp;lt;b</p><script>if (a<b) x</script><style>p{}</style><!-- c --> d&nbsp;e", "a<b d e"), ("", ""), ("&copy; &LT;", "&copy; &LT;"), ("<SCRIPT>" + "<" * 20000 + "</SCRIPT>ok", "ok")])
def test_html(spark, html, want):
    assert one(spark, html, "string", H.html_to_text) == want


@pytest.mark.parametrize("path, want", [("a.PDF", "pdf"), ("https://x.org/a/b", "github"), ("https://x.org/a", "web"), ("b.htm", "html"), (".md", "text"), ("x", "text")])
def test_file_type(spark, path, want):
    from mosslight.sources.readers import detect_type

    assert one(spark, path, "string", U.file_type) == want == detect_type(path)


PLANS = [
    ("What is Python?", "simple", ["What is Python?"]),
    ("Python and JavaScript and TypeScript", "moderate", ["Python", "JavaScript", "TypeScript"]),
    ("What is Python? How to install it? Best practices?", "moderate", ["What is Python", "How to install it", "Best practices?"]),
    ("Python vs JavaScript", "complex", ["Python", "JavaScript"]),
    ("compare React and Vue", "complex", ["React and Vue"]),
    ("which is better: TypeScript or JavaScript", "complex", ["which is better: TypeScript or JavaScript"]),
    ("C++ vs C# programming!", "complex", ["C# programming!"]),
    ("React and Vue and Angular frameworks", "moderate", ["Angular frameworks"]),
    ("", "simple", [""]),
    ("a" * 500, "simple", ["a" * 500]),
    ("w " * 20 + "end", "moderate", ["w " * 20 + "end"]),
]


@pytest.mark.parametrize("query, complexity, subs", PLANS)
def test_plan(spark, query, complexity, subs):
    plan = P.heuristic_plan(query)
    assert plan["complexity"] == complexity and [s["query"] for s in plan["sub_queries"]] == subs
    assert one(spark, query, "string", P.sub_queries) == subs
    assert one(spark, query, "string", P.classify)["complexity"] == complexity


def test_plan_hook():
    fenced = 'Sure:\n```json\n{"complexity": "simple", "strategy": "parallel", "subQueries": [{"query": "q1"}, {"query": "q2", "topK": 3}]}\n```'
    plan = P.create_plan("x", planner=lambda _: fenced, max_sub_queries=2)
    assert [(s["query"], s["top_k"]) for s in plan["sub_queries"]] == [("q1", 5), ("q2", 3)] and P.valid_plan(plan)
    assert P.create_plan("x", planner=lambda _: "no json")["complexity"] == "simple"

    def fails(_):
        raise RuntimeError

    assert P.create_plan("Python vs Java", planner=fails)["complexity"] == "simple"
    assert P.create_plan("Python vs Java", use_llm=False, planner=fails)["complexity"] == "complex"
    assert not P.valid_plan({"original_query": " ", "sub_queries": []})
    assert len(P.heuristic_plan("aaaaaaa and bbbbbbb and ccccccc and ddddddd", max_sub_queries=2)["sub_queries"]) == 2


@pytest.mark.parametrize("seps", [RECURSIVE, CODE, MARKDOWN])
def test_split(seps):
    draw = random.Random(5)
    for _ in range(60):
        text = "".join(draw.choice(["ab", "c", " ", ". ", "\n", "\n\n", ", ", "longerword", "# "]) for _ in range(draw.randrange(400)))
        size, overlap = draw.choice([(20, 5), (64, 10), (512, 50), (7, 0)])
        spans = split_text(text, size, overlap, seps)
        covered = set()
        for a, b in spans:
            assert 0 < b - a <= size and text[a:b].strip() == text[a:b] != ""
            covered |= set(range(a, b))
        assert all(c in covered for c in range(len(text)) if not text[c].isspace())
        for (a, b), (c, _) in zip(spans, spans[1:]):
            assert c > a and b - c <= overlap


def test_checks():
    assert check_top_k(20) == 20
    for bad in (0, 21, 1.5, "3", True):
        with pytest.raises(ValueError):
            check_top_k(bad)
    with pytest.raises(ValueError):
        check_strategy("other")


def test_ignore(spark):
    paths = [("a/b.test.js", True), ("node_modules/x.js", True), ("src/TEST/x", True), ("src/x.py", False), ("Makefile", False), ("makefile", True)]
    df = spark.createDataFrame(paths, "p string, want boolean")
    assert df.where(X.ignored(F.col("p"), X.ignore_patterns()) != F.col("want")).count() == 0
