from tidemark.llm import frames


def test_free_memory_outside_the_heap_goes_back(spark, monkeypatch):
    assert frames.give_back(spark)
    own, calls = frames.give_back, []
    monkeypatch.setattr(frames, "give_back", lambda s: calls.append(own(s)))
    frames.cut(spark.range(3))
    frames.tidy(spark)
    assert len(calls) >= 2 and all(calls)
