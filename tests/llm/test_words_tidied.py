"""A worker gives memory back after a task, when what the task held is gone."""

import weakref

from flowspark.llm import words


class Held:
    pass


def test_memory_is_given_back_once_the_task_holds_nothing(monkeypatch):
    refs, alive = [], []

    def run(batches):
        held = Held()
        refs.append(weakref.ref(held))
        yield from batches

    class Library:
        malloc_trim = staticmethod(lambda pad: alive.append(refs[0]() is not None))

    monkeypatch.setattr(words.ctypes, "CDLL", lambda name: Library)
    task = words.tidied(run)(iter([1, 2]))
    assert next(task) == 1 and refs[0]() is not None and not alive
    assert list(task) == [2] and alive == [False]
    monkeypatch.setattr(words.ctypes, "CDLL", lambda name: object())
    assert list(words.tidied(run)(iter([]))) == []
