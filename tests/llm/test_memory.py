"""Workers hold one operator's things at a time, also while those of the next one are loaded."""

from pyspark import SparkContext
from test_llm_operators import docs

from loomwell.llm import language, memory, toxicity


class Shared:
    """Stands for a broadcast; notes what the worker holds when the value is loaded."""

    def __init__(self, value):
        self.loaded, self.seen = value, []

    @property
    def value(self):
        self.seen.append(list(memory._held))
        return self.loaded


def test_a_model_is_loaded_after_another_operators_things_are_dropped():
    for load, model in ((toxicity._examples, toxicity.fit(["one two three"], [1], [1])), (language._labeller, language.Model.fit(["one two"], ["en"]))):
        memory.held("packing", dict)
        shared, other = Shared(model), Shared(model)
        assert load(shared) is load(shared) and shared.seen == [[]]
        assert load(other) is not None and other.seen == [[]] and len(memory._held) == 1


def test_the_language_model_is_learned_without_rows_from_the_drivers_python(spark, monkeypatch):
    df = docs(spark, ["the house on the hill", "das Haus auf dem Berg"] * 30, ["en", "de"] * 30)
    monkeypatch.setattr(SparkContext, "parallelize", None)
    assert sorted(language.learn(df).langs) == ["de", "en"]
