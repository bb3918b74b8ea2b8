"""Planners' answers, one by one and as a column."""

import pytest
from pyspark.sql import functions as F

from mosslight.plans import planner as P

QUERY = "python basics"
ANSWERS = [
    '```json\n{"complexity": "moderate", "strategy": "parallel", "sub_queries": [{"query": "one", "priority": "low"}, {"query": "two", "topK": 7}]}\n```',
    'Sure: {"complexity": "simple", "strategy": "sequential", "subQueries": [{"query": "one", "top_k": 3}]} as asked',
    '{"complexity": "odd", "strategy": "parallel", "sub_queries": [{"query": "one"}]}',
    '{"complexity": "simple", "strategy": "parallel", "sub_queries": []}',
    '{"complexity": "simple", "strategy": "parallel", "sub_queries": [{"query": "one", "priority": "urgent"}]}',
    '{"complexity": "simple", "strategy": "parallel", "sub_queries": [{"text": "one"}]}',
    '{"complexity": "simple", "strategy": "parallel", "sub_queries": [{"query": 5}]}',
    '{"complexity": "simple", "strategy": "parallel"}',
    "[1, 2]",
    "no plan at all",
    "",
    None,
]


def test_answers_as_a_column_agree_with_single_ones(spark):
    table = spark.createDataFrame(list(enumerate(ANSWERS)), "id int, answer string")
    got = {r.id: r.p for r in table.select("id", P.parsed_answers(F.col("answer")).alias("p")).collect()}
    for i, answer in enumerate(ANSWERS):
        want = P.parse_plan(answer, QUERY)
        if want is None:
            assert got[i] is None, answer
        else:
            assert (got[i].complexity, got[i].strategy) == (want["complexity"], want["strategy"])
            assert [(s["query"], s.top_k, s.priority) for s in got[i].sub_queries] == [(s["query"], s["top_k"], s["priority"]) for s in want["sub_queries"]]
    assert sum(p is not None for p in got.values()) == 2


def test_commas_too_many_are_forgiven_and_sub_queries_bounded(spark):
    answer = '{"complexity": "complex", "strategy": "parallel", "sub_queries": [{"query": "a",}, {"query": "b"}, {"query": "c"},],}'
    r = spark.createDataFrame([(answer,)], "a string").select(P.parsed_answers(F.col("a"), max_sub_queries=2).alias("p")).first().p
    assert [s["query"] for s in r.sub_queries] == ["a", "b"]


def test_planners_are_asked_one_after_another():
    def broken(_):
        raise RuntimeError("no model")

    good = lambda _: ANSWERS[1]
    assert P.create_plan(QUERY, planner=[broken, lambda _: "no plan", good])["sub_queries"][0]["query"] == "one"
    assert P.create_plan(QUERY, planner=broken) == P.simple_plan(QUERY)
    assert P.create_plan(QUERY, planner=[good, broken])["strategy"] == "sequential"
    assert P.create_plan(QUERY, planner=lambda _: None)["sub_queries"][0]["query"] == QUERY
    assert P.create_plan(QUERY, planner=[])["complexity"] == "simple"
    assert P.create_plan("a vs b and c", use_llm=False, planner=good)["complexity"] == "complex"


@pytest.mark.parametrize("answer", ANSWERS)
def test_every_answer_gives_a_valid_plan(answer):
    assert P.valid_plan(P.create_plan(QUERY, planner=lambda _: answer))
