"""Invented texts, the same for the same seed."""

WORDS = "the of and tion er ing re on at en ed stone river glass lamp paper green house cloud table".split()


def text_of(seed: int, n: int) -> str:
    out, x = [], seed * 7919 + 13
    for _ in range(n):
        x = (x * 1103515245 + 12345) % (1 << 31)
        out.append(WORDS[(x >> 8) % len(WORDS)] + (WORDS[(x >> 16) % len(WORDS)] if (x >> 4) % 3 else ""))
    return " ".join(out)
