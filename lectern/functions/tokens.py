"""Token counters for chunk budgets: byte-pair encoding with a vocabulary file that the caller names."""

from __future__ import annotations

from collections.abc import Callable

#: Fixed value: how the o200k_base vocabulary cuts text before merging.
O200K = "|".join(
    [
        r"[^\r\n\p{L}\p{N}]?[\p{Lu}\p{Lt}\p{Lm}\p{Lo}\p{M}]*[\p{Ll}\p{Lm}\p{Lo}\p{M}]+(?i:'s|'t|'re|'ve|'m|'ll|'d)?",
        r"[^\r\n\p{L}\p{N}]?[\p{Lu}\p{Lt}\p{Lm}\p{Lo}\p{M}]+[\p{Ll}\p{Lm}\p{Lo}\p{M}]*(?i:'s|'t|'re|'ve|'m|'ll|'d)?",
        r"\p{N}{1,3}",
        r" ?[^\s\p{L}\p{N}]+[\r\n/]*",
        r"\s*[\r\n]+",
        r"\s+(?!\S)",
        r"\s+",
    ]
)


class BpeCounter:
    """Counts the tokens of a text with a vocabulary of ranks (lines of base64 token and rank), read once in each worker."""

    def __init__(self, path: str, pattern: str = O200K):
        self.path, self.pattern, self._encoding = path, pattern, None

    def __getstate__(self):
        return {"path": self.path, "pattern": self.pattern, "_encoding": None}

    def __call__(self, text: str) -> int:
        if self._encoding is None:
            import base64

            import tiktoken

            with open(self.path, "rb") as f:
                ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f.read().splitlines() if line)}
            self._encoding = tiktoken.Encoding("ranks", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={})
        return len(self._encoding.encode_ordinary(text))


def bpe_counter(path: str, pattern: str = O200K) -> Callable[[str], int]:
    return BpeCounter(path, pattern)
