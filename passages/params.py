"""Parameters of indexes and scores."""

from __future__ import annotations

from dataclasses import asdict, dataclass, replace

METHODS = ("rectangle", "euclidean", "cityblock", "chebyshev")
MODULUS = 2**31 - 1
CHARS_PER_WORD = 5.5
#: What a user may set, and how far.
BOUNDS = {"position_threshold": (1, 200), "offset_threshold": (1, 200), "min_cluster_size": (1, 50)}


@dataclass(frozen=True)
class IndexParams:
    """k-gram length, winnowing window, polynomial base, and whether punctuation stays in tokens."""

    length: int = 4
    window_size: int = 6
    base: int = 256
    punctuation: bool = False

    def for_queries(self) -> IndexParams:
        """The same tokens and k-grams with every k-gram kept."""
        return replace(self, window_size=1)

    def as_dict(self) -> dict:
        return asdict(self)


@dataclass(frozen=True)
class ScoreParams:
    min_fingerprints: int = 5
    top_k: int = 50
    method: str = "rectangle"
    position_threshold: int = 30
    offset_threshold: int = 30
    distance_threshold: float = 30
    min_cluster_size: int = 5
    min_fragment_length: float = 1000.0

    def __post_init__(self):
        if self.method not in METHODS:
            raise ValueError(f"Unknown clustering method {self.method!r}; must be one of {', '.join(METHODS)}")

    def edited(self, **overrides) -> ScoreParams:
        """With user-supplied thresholds, each clamped to its bounds; values that aren't numbers are ignored."""
        good = {}
        for name, value in overrides.items():
            if name not in BOUNDS or value is None or isinstance(value, bool):
                continue
            try:
                number = int(value)
            except (TypeError, ValueError):
                continue
            good[name] = max(BOUNDS[name][0], min(BOUNDS[name][1], number))
        return replace(self, **good)


CORE = ScoreParams()
WEB = ScoreParams(top_k=10, position_threshold=30, offset_threshold=10)
PRESETS = {"core": CORE, "web": WEB}
