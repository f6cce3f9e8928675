"""Texts for the tests of this folder."""


def prose(seed: int, n: int) -> str:
    """Words of small letters that do not repeat within a text."""
    return " ".join("".join(chr(97 + (seed * 1_000_003 + i * 7919) // 26**k % 26) for k in range(6)) for i in range(n))
