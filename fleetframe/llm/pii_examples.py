"""A small labelled table for the random field: personal data in forms that the fixed patterns miss, and numbers that look like it but are none.

Made by rule from a seed, so that every session trains on the same rows. Spans are (kind, start, end) in code points, end exclusive.
"""

from __future__ import annotations

import random

# Words that announce a kind, and words around all examples.
PHONE_CUES = "call phone tel telephone fax mobile cell dial telefon mobil téléphone appelez teléfono móvil ruf"
CARD_CUES = "card visa mastercard amex karte kreditkarte carte tarjeta"
PLAIN_WORDS = "the and of in order about page section from until total number version since on at for with see room item code year der die und le la de el en"
# End of fixed values.

CUES = frozenset(f"{PHONE_CUES} {CARD_CUES}".split())


def _check_digit(digits: str) -> str:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (2 - i % 2)
        total += n - 9 if n > 9 else n
    return str(-total % 10)


class _Maker:
    def __init__(self, seed: int):
        self.rng = random.Random(seed)

    def digits(self, n: int) -> str:
        return str(self.rng.randint(1, 9)) + "".join(str(self.rng.randint(0, 9)) for _ in range(n - 1))

    def pick(self, words: str) -> str:
        word = self.rng.choice(words.split())
        return self.rng.choice([word, word.capitalize(), word + ":"])

    def card(self, valid: bool) -> str:
        body = self.rng.choice("3456") + self.digits(14)
        last = _check_digit(body)
        whole = body + (last if valid else str((int(last) + self.rng.randint(1, 9)) % 10))
        return self.rng.choice([".", "  ", "/", "_"]).join(whole[i : i + 4] for i in (0, 4, 8, 12))

    def ip(self) -> str:
        hexes = lambda: f"{self.rng.randint(0, 65535):x}"
        form = self.rng.randint(0, 2)
        if form == 0:
            return ":".join(["2001", "db8", *(hexes() for _ in range(6))])
        head = self.rng.choice(["2001:db8", "fe80", "fd12:3456", "2a02:8108"])
        return f"{head}::{self.rng.randint(1, 9)}{hexes()[:3]}" if form == 1 else f"{head}::{hexes()}:{self.rng.randint(1, 9)}{hexes()[:2]}"

    def email(self) -> str:
        name = self.rng.choice(["anna", "max.mueller", "info", "j_doe", "office24"])
        host = self.rng.choice(["bücher", "müller", "café", "señor", "größe", "été"]) + self.rng.choice(["", "-shop", "24"])
        return f"{name}@{host}.{self.rng.choice(['de', 'fr', 'es', 'example.org'])}"

    def clear_phone(self) -> str:
        a, b, c = self.digits(3), self.digits(3), self.digits(4)
        return self.rng.choice([f"({a}) {b}-{c}", f"({a}){b}-{c}", f"1-{a}-{b}-{c}", f"{a}-{b}-{c}"])

    def announced_phone(self) -> str:
        return self.rng.choice([
            f"0{self.digits(2)} {self.digits(7)}", f"0{self.digits(self.rng.randint(2, 3))}/{self.digits(6)}", f"00{self.digits(2)} {self.digits(3)} {self.digits(6)}",
            f"{self.digits(3)}.{self.digits(3)}.{self.digits(4)}", f"{self.digits(3)} {self.digits(3)} {self.digits(4)}", f"0{self.digits(9)}",
        ])

    def number(self) -> str:
        d, rng = self.digits, self.rng
        return rng.choice([
            f"{rng.randint(1900, 2099)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}", f"{rng.randint(0, 23)}:{rng.randint(0, 59):02}", f"{rng.randint(0, 23)}:{rng.randint(0, 59):02}:{rng.randint(0, 59):02}",
            f"{d(rng.randint(1, 9))}", f"{d(2)}.{d(2)}", f"{d(1)}.{d(1)}.{d(2)}", f"{d(3)}.{d(3)}.{d(3)}", f"978-{d(1)}-{d(2)}-{d(6)}-{d(1)}", f"{d(2)}-{d(2)}", f"{d(3)}-{d(2)}-{d(4)}", f"{d(4)}-{d(4)}",
            f"${d(2)}.{d(2)}", f"{d(2)}%", f"#{d(4)}", f"v{d(1)}.{d(1)}", f"x{d(5)}", f"{d(3)} {d(3)}", f"{d(4)} {d(4)} {d(4)}", f"{d(1)} {d(2)} {d(3)} {d(4)}", f"{d(16)}0{d(3)}", f"({d(4)})", f"({d(1)})",
            f"{d(3)}.{d(3)}.{d(4)}", f"0{d(rng.randint(2, 3))}/{d(6)}", f"0{d(2)} {d(7)}", f"{d(2)}/{d(2)}/{d(4)}", f"{rng.randint(10, 99)}:{rng.randint(10, 99)}:{rng.randint(10, 99)}:1a:2b:3c", f"{d(12)}", f"0{d(9)}", f"@{d(3)}", "@home", f"a{d(1)}b{d(2)}",
        ])


def examples(n: int, seed: int = 1) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """n texts with their spans; about half of them hold personal data."""
    make, out = _Maker(seed), []
    rng = make.rng
    for i in range(n):
        kind, cue = None, None
        form = i % 12
        if form < 2:
            kind, value, cue = "phone", make.clear_phone(), PHONE_CUES if rng.random() < 0.5 else None
        elif form < 4:
            kind, value, cue = "phone", make.announced_phone(), PHONE_CUES
        elif form == 4:
            kind, value, cue = "card", make.card(True), CARD_CUES if rng.random() < 0.5 else None
        elif form == 5:
            kind, value = ("ip", make.ip()) if rng.random() < 0.5 else ("email", make.email())
        elif form == 6:
            value = make.card(False)
        else:
            value = make.number()
        words = [rng.choice(PLAIN_WORDS.split()) for _ in range(rng.randint(0, 3))]
        lead = " ".join([*words, *([make.pick(cue)] if cue else [])])
        left, right = rng.choice([("", ""), ("", ""), ("", "."), ("", ","), ("(", ")")]) if not value.startswith("(") else ("", "")
        start = len(lead) + (1 if lead else 0) + len(left)
        tail = " ".join(rng.choice(PLAIN_WORDS.split()) for _ in range(rng.randint(0, 3)))
        text = f"{lead} {left}{value}{right} {tail}" if lead else f"{left}{value}{right} {tail}"
        out.append((text, [(kind, start, start + len(value))] if kind else []))
    return out
