"""What workers keep: an encoder only where it is used, no unused heap; and memories are asked without walking through them."""

import weakref

from tripletframe.llm import bpe, common, lm
from tripletframe.llm import queries as Q


class Unwalkable(dict):
    def __iter__(self):
        raise AssertionError("walked through all entries")

    keys = items = values = __iter__


def test_memory_is_asked_by_key_alone(monkeypatch):
    memory = bpe.Memory()
    memory.learn({b"new": b"1"})
    memory.old = Unwalkable({b"old": b"2", b"other": b"3"})
    monkeypatch.setattr(bpe.Memory, "__iter__", Unwalkable.__iter__, raising=False)
    assert memory.unknown({b"new", b"old", b"none"}) == [b"none"]
    assert memory[b"old"] == b"2" and memory[b"new"] == b"1"


def test_white_space_around_and_within_texts():
    own = bpe.Bpe(Q.WORD_BPE)
    texts = [b"  some  words\n", b"", b" \t\x0b\x0c\r\n", b"words", "café   words".encode(), b"some"]
    chunks = lambda t: b"".join(own.encode([c])[0] for c in t.split())
    assert own.encode(texts) == [chunks(t) for t in texts] and own.encode([]) == [] and own.encode([b""]) == [b""]
    assert own.encode([b"some words"])[0] == own.encode(texts)[0] != b""


def test_encoder_of_words_goes_when_another_operator_begins():
    codec = weakref.ref(lm._codec(Q.BYTE_BPE))
    assert lm._codec(Q.BYTE_BPE) is codec()
    common.refcounts_only()
    assert codec() is None


def test_heap_goes_back_after_the_work(monkeypatch):
    done = []
    monkeypatch.setattr(common, "_TRIM", lambda n: done.append("trim"))
    assert common.lean(lambda a, b: done.append("work") or a + b, 1, 2) == 3
    assert done == ["work", "trim"]
