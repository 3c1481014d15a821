"""Times written in texts: each form as finditer gives it, but tried only where a word may begin it."""

import random

from mnemospark.operators import times as T

WORDS = "in a an the day days Days before yesterday after tomorrow few couple several 3 12th 2023 2023-05-09 2023-5-9T10:30 1999 19991 May Sept sep Monday FRIDAY last next this week weekend years ago later from now today ſunday K weeK _day x1999 of 5 ten month ٢٠٢٣-٠٥-٠٩ İn wEEKs".split()


def whole(text):
    spans = {}
    for pattern, rank in T._COMPILED:
        for m in pattern.finditer(text):
            spans[m.span()] = min(rank, spans.get(m.span(), rank))
    out = [(rank, b, e) for (b, e), rank in spans.items() if not any(x <= b and e <= y and (x, y) != (b, e) for x, y in spans)]
    return [text[b:e] for _, b, e in sorted(out)]


def test_expressions_equal_every_form_everywhere():
    draw = random.Random(7)
    for _ in range(5000):
        text = "".join(draw.choice(WORDS) + draw.choice([" ", " ", "  ", "-", ", ", "", "_"]) for _ in range(draw.randint(0, 14)))
        assert T.expressions(text) == whole(text)


def test_forms_are_tried_at_few_words(monkeypatch):
    tries = []

    class Counted:
        def __init__(self, pattern):
            self.pattern = pattern

        def match(self, text, at):
            tries.append(at)
            return self.pattern.match(text, at)

    monkeypatch.setattr(T, "_LOWER", [(Counted(p), rank) for p, rank in T._LOWER])
    assert T.expressions("nothing here tells when it was " * 50 + "Yesterday") == ["Yesterday"] and len(tries) == 1
