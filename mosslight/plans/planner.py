"""Query planning: rules that break a question into sub-queries, for one query or a column of them."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as X

#: Words of a comparison; the first five also split the query.
COMPARING = ["vs", "versus", "compare", "difference", "between", "better", "worse"]
SPLITTING = COMPARING[:5]
_AHEAD, _BEHIND = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"


def _any(words: list[str]) -> str:
    return f"(?i){_AHEAD}(?:{'|'.join(words)}){_BEHIND}"


CONCEPTS = f"(?i){_AHEAD}and{_BEHIND}|{_AHEAD}or{_BEHIND}"
DELIMITERS = f"(?i)[.!?;]\\s+|{_AHEAD}and{_BEHIND}"
LONG = 15


def _sub(query: str, top_k: int, priority: str, reasoning: str) -> dict:
    return {"query": query, "reasoning": reasoning, "top_k": top_k, "priority": priority}


def heuristic_plan(query: str, *, max_sub_queries: int | None = None, top_k: int = 5) -> dict:
    """Plan by rules: comparison, several questions or concepts, long, simple."""
    if re.search(_any(COMPARING), query):
        parts = [p.strip() for p in re.split(_any(SPLITTING), query)]
        parts = [p for p in parts if len(p) > 3 and p.lower() not in (*SPLITTING, "and")]
        plan = {"complexity": "complex", "strategy": "parallel", "explanation": "A comparison: one search for each side"}
        subs = [_sub(p, top_k, "high", f"One side of the comparison: {p}") for p in parts]
    elif query.count("?") > 1 or len(re.split(CONCEPTS, query)) > 2:
        parts = [p.strip() for p in re.split(DELIMITERS, query)]
        parts = [p for p in parts if len(p) > 5][: max_sub_queries or 3]
        plan = {"complexity": "moderate", "strategy": "parallel", "explanation": "Query with several concepts broken into focused searches"}
        subs = [_sub(p, top_k, "medium", f"Search for {p}") for p in parts]
    elif len(re.split(r"\s+", query)) > LONG:
        plan = {"complexity": "moderate", "strategy": "sequential", "explanation": "Long query searched as a whole"}
        subs = [_sub(query, top_k, "high", "Search for the whole query")]
    else:
        return simple_plan(query, top_k)
    return {"original_query": query, **plan, "sub_queries": subs or [_sub(query, top_k, "high", "Search for the whole query")]}


def simple_plan(query: str, top_k: int = 5) -> dict:
    return {"original_query": query, "complexity": "simple", "strategy": "parallel", "explanation": "Simple query searched directly", "sub_queries": [_sub(query, top_k, "high", "Direct search for the query")]}


def valid_plan(plan: dict) -> bool:
    """A query that isn't blank and at least one sub-query, none blank."""
    subs = plan.get("sub_queries") or []
    return bool((plan.get("original_query") or "").strip()) and bool(subs) and all((s.get("query") or "").strip() for s in subs)


_COMPLEXITY, _STRATEGY, _PRIORITY = ("simple", "moderate", "complex"), ("sequential", "parallel"), ("high", "medium", "low")


def parse_plan(answer: dict | str | None, query: str, *, max_sub_queries: int | None = None, top_k: int = 5) -> dict | None:
    """A planner's answer as a plan: JSON, in a fenced block or bare; None if it doesn't fit."""
    if isinstance(answer, str):
        block = re.search(r"```(?:json)?\s*([\s\S]*?)```", answer) or re.search(r"(\{[\s\S]*\})", answer)
        try:
            answer = json.loads(block[1] if block else answer)
        except ValueError:
            return None
    if not isinstance(answer, dict):
        return None
    get = lambda snake, camel: answer.get(snake, answer.get(camel))
    subs = get("sub_queries", "subQueries")
    if get("complexity", "complexity") not in _COMPLEXITY or get("strategy", "strategy") not in _STRATEGY or not isinstance(subs, list) or not subs:
        return None
    own = []
    for s in subs[: max_sub_queries or len(subs)]:
        if not isinstance(s, dict) or not isinstance(s.get("query"), str) or s.get("priority", "high") not in _PRIORITY:
            return None
        own.append(_sub(s["query"], s.get("top_k") or s.get("topK") or top_k, s.get("priority", "high"), s.get("reasoning", "")))
    return {"original_query": query, "complexity": answer["complexity"], "strategy": answer["strategy"], "explanation": answer.get("explanation", ""), "sub_queries": own}


Planner = Callable[[str], "dict | str | None"]


def create_plan(query: str, *, use_llm: bool = True, planner: Planner | Sequence[Planner] | None = None, max_sub_queries: int | None = None, top_k: int = 5, context: str = "") -> dict:
    """A plan by the given planner where there is one, else by rules; a failing planner gives the simple plan.

    Of several planners each is asked when those before it failed or gave no plan that fits.
    """
    try:
        planners = [] if planner is None or not use_llm else [planner] if callable(planner) else list(planner)
        for k, ask in enumerate(planners):
            try:
                plan = parse_plan(ask(prompt(query, context)), query, max_sub_queries=max_sub_queries, top_k=top_k)
            except Exception:
                if k + 1 == len(planners):
                    raise
                continue
            if plan:
                return plan
        return heuristic_plan(query, max_sub_queries=max_sub_queries, top_k=top_k)
    except Exception:
        return simple_plan(query, top_k)


def prompt(query: str, context: str = "") -> str:
    """What a planner is asked: the query, what is known around it, and the form of the answer."""
    form = {"complexity": "|".join(_COMPLEXITY), "strategy": "|".join(_STRATEGY), "explanation": "why", "sub_queries": [{"query": "text", "reasoning": "why", "top_k": 5, "priority": "|".join(_PRIORITY)}]}
    return "\n".join(x for x in ("Break this search query into the sub-queries needed to answer it.", context and f"Context: {context}", f"Query: {query}", "Answer with JSON of this form:", json.dumps(form)) if x)


# --- the same over columns -----------------------------------------------------------------------


def parsed_answers(answer: Column, max_sub_queries: int | None = None, top_k: int = 5) -> Column:
    """parse_plan() for a column of answers: a struct (complexity, strategy, sub_queries), null where an answer doesn't fit.

    The JSON text is taken from a fenced block or from its outer braces and read as a variant; commas before a closing
    bracket are forgiven.
    """
    some = lambda pattern: F.nullif(F.regexp_extract(answer, pattern, 1), F.lit(""))
    text = F.coalesce(some(r"```(?:json)?\s*([\s\S]*?)```"), some(r"(\{[\s\S]*\})"), answer)
    tree = F.coalesce(F.try_parse_json(text), F.try_parse_json(F.regexp_replace(text, r",(\s*[}\]])", "$1")))
    get = lambda v, path, kind: F.try_variant_get(v, path, kind)
    is_text = lambda v, path: F.coalesce(F.schema_of_variant(get(v, path, "variant")) == "STRING", F.lit(False))
    subs = F.coalesce(get(tree, "$.sub_queries", "array<variant>"), get(tree, "$.subQueries", "array<variant>"))
    priority = lambda s: F.coalesce(get(s, "$.priority", "string"), F.lit("high"))
    used = subs if max_sub_queries is None else F.slice(subs, 1, max_sub_queries)
    fits = get(tree, "$.complexity", "string").isin(*_COMPLEXITY) & get(tree, "$.strategy", "string").isin(*_STRATEGY) & (F.size(subs) > 0) & F.forall(used, lambda s: is_text(s, "$.query") & priority(s).isin(*_PRIORITY))
    number = lambda s: F.coalesce(get(s, "$.top_k", "int"), get(s, "$.topK", "int"), F.lit(top_k))
    own = F.transform(used, lambda s: F.struct(get(s, "$.query", "string").alias("query"), number(s).alias("top_k"), priority(s).alias("priority")))
    return F.when(fits, F.struct(get(tree, "$.complexity", "string").alias("complexity"), get(tree, "$.strategy", "string").alias("strategy"), own.alias("sub_queries")))


def planned(query: Column, answer: Column, max_sub_queries: int | None = None, top_k: int = 5) -> Column:
    """(planned_by, complexity, strategy, sub_queries): the answers that fit, rules for all other queries."""
    given, kind = parsed_answers(answer, max_sub_queries, top_k), classify(query)
    rules = F.transform(sub_queries(query, max_sub_queries), lambda q: F.struct(q.alias("query"), F.lit(top_k).alias("top_k"), F.when((kind["complexity"] == "moderate") & (kind["strategy"] == "parallel"), "medium").otherwise("high").alias("priority")))
    return F.struct(
        F.when(given.isNotNull(), "llm").otherwise("rules").alias("planned_by"),
        F.coalesce(given["complexity"], kind["complexity"]).alias("complexity"),
        F.coalesce(given["strategy"], kind["strategy"]).alias("strategy"),
        F.coalesce(given["sub_queries"], rules).alias("sub_queries"),
    )


def classify(query: Column) -> Column:
    """(complexity, strategy) of a column of queries."""
    several = (F.regexp_count(query, F.lit("\\?")) > 1) | (F.size(F.split(query, CONCEPTS, -1)) > 2)
    pair = lambda a, b: F.struct(F.lit(a).alias("complexity"), F.lit(b).alias("strategy"))
    return F.when(query.rlike(_any(COMPARING)), pair("complex", "parallel")).when(several, pair("moderate", "parallel")).when(F.size(F.split(query, "\\s+", -1)) > LONG, pair("moderate", "sequential")).otherwise(pair("simple", "parallel"))


def sub_queries(query: Column, max_sub_queries: int | None = None) -> Column:
    """Array of sub-query texts of a column of queries."""
    cut = lambda pattern: F.transform(F.split(query, pattern, -1), X.trim_all)
    compared = F.filter(cut(_any(SPLITTING)), lambda p: (F.length(p) > 3) & ~F.lower(p).isin([*SPLITTING, "and"]))
    several = F.slice(F.filter(cut(DELIMITERS), lambda p: F.length(p) > 5), 1, max_sub_queries or 3)
    kind = classify(query)
    parts = F.when(kind["complexity"] == "complex", compared).when((kind["complexity"] == "moderate") & (kind["strategy"] == "parallel"), several).otherwise(F.array(query))
    return F.when(F.size(parts) == 0, F.array(query)).otherwise(parts)
