"""Small tables with the awkward cases, and plain versions of what the operators must give."""

from __future__ import annotations

import random
import re

WORDS = "the of a to in river stone light walk green under house talk seven winter paper salt open road blue".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, hit string, verdict string, spans string, removed string"


def sentence(rng: random.Random, n: int) -> list[str]:
    return [rng.choice(WORDS) + (str(rng.randrange(40)) if rng.random() < 0.5 else "") for _ in range(n)]


def documents(seed: int = 1, count: int = 60) -> list[tuple]:
    """Rows of ``SCHEMA``: copies, near copies, repeats inside a text, nulls, empty and odd texts, repeated rows."""
    rng = random.Random(seed)
    base = [sentence(rng, rng.randrange(5, 90)) for _ in range(12)]
    shared = sentence(rng, 40)
    texts: list[str | None] = []
    for k in range(count):
        words = list(rng.choice(base))
        kind = k % 6
        if kind == 1 and words:
            words[rng.randrange(len(words))] = "changed"
        elif kind == 2:
            at = rng.randrange(len(words))
            words[at:at] = shared[rng.randrange(20) :]
        elif kind == 3:
            words = words + ["run"] * rng.randrange(30) + words[:15]
        elif kind == 4:
            words = sentence(rng, rng.randrange(1, 120))
        texts.append(rng.choice((" ", "  ", "\n"))[:1].join(words))
    texts += [None, "", " \n\t ", "one", "one two", "One TWO", "one two three", "ün Ñandú 中文 word", "x" * 3000, "a b " * 800]
    rows = [(k, t, "en", f"s{k % 3}" if k % 7 else None, len(t or ""), "h", "v", "s", "r") for k, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, texts[2], None, None, 0, None, None, None, None), (5, texts[9], "en", "s1", 3, "h", "v", "s", "r")]
    return rows


def blank_words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower_ascii(text: str | None) -> str:
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def shingle_set(text: str | None, size: int) -> frozenset:
    words = blank_words(lower_ascii(text))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1)))


def link_groups(sets: list[frozenset], similarity: int) -> list[int]:
    """For each set the number of the first one that links reach."""
    parent = list(range(len(sets)))

    def find(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= similarity * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(sets))]


def contaminated_words(text: str | None, items: list[tuple], size: int) -> tuple[int, int, set]:
    """Words, hit words, and the items that hit."""
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower_ascii(t))
    words, hit, names = split(text), set(), set()
    for name, body in items:
        item = split(body)
        m = min(size, len(item))
        grams = {tuple(item[i : i + m]) for i in range(len(item) - m + 1)} if m else set()
        for i in range(len(words) - m + 1 if m else 0):
            if tuple(words[i : i + m]) in grams:
                hit |= set(range(i, i + m))
                names.add("" if name is None else str(name))
    return len(words), len(hit), names


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def personal(text: str | None) -> list[tuple[str, int, int]]:
    """The contract's base spans."""
    digits = lambda m: re.sub("[^0-9]", "", m)
    kinds = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    )
    return [(k, m.start(), m.end()) for k, p, ok in kinds for m in re.finditer(p, text or "") if ok(m.group())]
