from evalspark.operators.models import available_models, model_aliases, resolve_models, unresolved_models
from evalspark.sources.catalogue import model_catalogue
from tests.conftest import plan_of, rows_of

GROK = "openrouter/x-ai/grok-4.1-fast"


def resolved(spark, catalogue, *names):
    requests = spark.createDataFrame([(name,) for name in names], "name string")
    return {r.name: r.model for r in resolve_models(requests, catalogue).collect()}


def test_names_of_the_default_catalogue(spark):
    found = resolved(
        spark, model_catalogue(spark), "gpt-5-nano", "GPT-5.2", "opus_45_or", "openrouter/z-ai/glm-4.7", "glm-4",
        "glm", "grok", "grok-", "gemini-3", "sonnet", "openrouter", "nope", "", "mini",
    )
    assert found == {
        "gpt-5-nano": "openrouter/openai/gpt-5-nano",
        "GPT-5.2": "openrouter/openai/gpt-5.2",
        "opus_45_or": "openrouter/anthropic/claude-opus-4.5",
        "openrouter/z-ai/glm-4.7": "openrouter/z-ai/glm-4.7",
        "glm-4": "openrouter/z-ai/glm-4.7",
        "glm": None,  # begins two aliases, though of one model
        "grok": None,
        "grok-": GROK,
        "gemini-3": None,
        "sonnet": "openrouter/anthropic/claude-sonnet-4.5",
        "openrouter": None,
        "nope": None,
        "": None,
        "mini": None,
    }


def test_the_last_entry_wins_a_shared_alias(spark):
    catalogue = model_catalogue(spark, [("A", "x/same"), ("SAME", "y/other"), ("C", "z/Same")])
    assert {r.alias: r.model for r in model_aliases(catalogue).collect()}["same"] == "z/Same"
    assert resolved(spark, catalogue, "same", "a")["same"] == "z/Same"


def test_a_single_alias_is_found_by_any_prefix(spark):
    assert resolved(spark, model_catalogue(spark, [("ONE", "one")]), "", "o") == {"": "one", "o": "one"}


def test_unresolved_names_come_with_what_there_is(spark):
    catalogue = model_catalogue(spark, [("A", "x/b"), ("B", "y/a"), ("C", "z/a")])
    requests = spark.createDataFrame([("b",), ("zz",), ("zz",), ("B ",)], "name string")
    assert rows_of(unresolved_models(requests, catalogue)) == [("B ", ["a", "b"]), ("zz", ["a", "b"])]
    assert spark.range(1).select(available_models(catalogue)).first()[0] == ["a", "b"]


def test_requests_keep_their_rows_and_columns(spark):
    requests = spark.createDataFrame([(1, "grok-"), (2, "grok-"), (3, None)], "id int, name string")
    found = resolve_models(requests, model_catalogue(spark))
    assert rows_of(found) == [(1, "grok-", GROK), (2, "grok-", GROK), (3, None, None)]
    assert "NestedLoop" not in plan_of(found)
