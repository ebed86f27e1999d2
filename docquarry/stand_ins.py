"""Stand-ins of models for the registered queries: what they say follows from the text alone.

Workers import this module by itself, without the queries.
"""

from __future__ import annotations

import numpy as np


def embedder():
    """Texts to (length, blanks, 7), both within a small range."""

    def embed(texts: list[str]) -> np.ndarray:
        return np.array([[len(t or "") % 97 + 1, (t or "").count(" ") % 89 + 1, 7] for t in texts], np.float32).reshape(-1, 3)

    return embed


GOOD = '{"term": "t", "definition": "d", "source": "s", "extraction_confidence": "HIGH"}'
LIST = '{"items": [{"id": "zz1", "description": "x", "source": "s"}], "total_count": 1, "extraction_confidence": "LOW"}'
MORE = "The sources also name a further part."


def replies():
    """A generator by the mark [[n]] of a question: good, bad facts, no answer, a hedge, a list."""

    def reply(texts: list[str]) -> list[str]:
        (text,) = texts
        case = int(text[text.index("[[") + 2])
        if text.startswith("Name the kind"):
            return ["ENUMERATION" if case == 4 else "It is a definition"]
        if "as one JSON object" in text:
            return ["no facts" if case == 1 else LIST if case == 4 else GOOD]
        if text.startswith("Add what"):
            return [MORE]
        if text.startswith("Answer the question from the sources"):
            return ["Directly said."]
        if case == 2:
            raise TimeoutError("late")
        return [{3: "However, I found nothing.", 4: "Two parts are meant."}.get(case, "The term is known.")]

    return reply


def questioner():
    """One usable question of a passage, by its first 30 characters, and lines that are none."""

    def reply(texts: list[str]) -> list[str]:
        heads = [t.split("Passage: ", 1)[1][:30].replace("\n", " ") for t in texts]
        return [f"Here you are?\n1. what is {h} about?\nno question" for h in heads]

    return reply


def converter():
    """Bytes to lines; some files are broken, some are empty."""

    def lines(content: bytes) -> list[dict]:
        if len(content) % 5 == 0:
            raise ValueError("unreadable")
        return [] if len(content) % 5 == 1 else [{"text": x, "place": n} for n, x in enumerate(content.decode().split("\n"))]

    return lines


def mending():
    """A generator that knows no confidence at first, mends that for rows marked a, and never for b."""
    def reply(texts):
        sound = [t.startswith("c") or (t.startswith("a") and "extraction_confidence is none" in t) for t in texts]
        return [GOOD if s else GOOD.replace("HIGH", "SURE") for s in sound]

    return reply
