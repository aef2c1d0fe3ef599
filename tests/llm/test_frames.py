from tidemark.llm import frames


def test_cut_collects_garbage_of_a_grown_heap(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(frames, "tidy", calls.append)
    for share, times in ((2.0, 0), (0.0, 1)):
        monkeypatch.setattr(frames, "HEAP", share)
        assert frames.cut(spark.range(3)).count() == 3 and len(calls) == times
