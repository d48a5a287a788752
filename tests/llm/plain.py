"""Plain versions that several tests compare with."""


def shingles(words, width=5):
    n = min(width, len(words))
    return {b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set()
