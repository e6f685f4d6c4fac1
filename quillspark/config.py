"""Names, defaults and small driver-side settings."""

from __future__ import annotations

import random
import re
from dataclasses import dataclass, field
from itertools import product

#: Fixed values of the configuration matrix.
CHUNKINGS = ("fixed_256", "fixed_512", "semantic", "paragraph")
SEARCHES = ("vector", "bm25", "hybrid", "hybrid_rerank")
TOP_KS = (3, 5, 10)
#: (window, overlap) of the sliding windows, in tokens.
WINDOWS = {"fixed_256": (256, 50), "fixed_512": (512, 100)}
#: Okapi constants, the constant of reciprocal rank fusion, and how far a list reaches as a multiple of top_k.
BM25_K1, BM25_B, BM25_EPSILON = 1.5, 0.75, 0.25
RRF_CONSTANT = 60
DEPTH = {"vector": 1, "bm25": 1, "hybrid": 2, "hybrid_rerank": 3}
#: Sentences less alike than this start a new group; paragraphs are merged up to this many tokens.
SEMANTIC_THRESHOLD, PARAGRAPH_TOKENS = 0.5, 50

_NAME = re.compile(r"^(.+?)__(.+?)__k(\d+)$")


@dataclass(frozen=True)
class RetrievalConfig:
    chunking: str
    search: str
    top_k: int

    def __post_init__(self):
        if self.chunking not in CHUNKINGS or self.search not in SEARCHES:
            raise ValueError(f"unknown configuration {self.chunking}, {self.search}")

    @property
    def name(self) -> str:
        return f"{self.chunking}__{self.search}__k{self.top_k}"


def parse_name(name: str) -> RetrievalConfig:
    if not (m := _NAME.match(name)):
        raise ValueError(f"{name!r} is not <chunking>__<search>__k<number>")
    return RetrievalConfig(m[1], m[2], int(m[3]))


def all_configs() -> list[RetrievalConfig]:
    return [RetrievalConfig(*x) for x in product(CHUNKINGS, SEARCHES, TOP_KS)]


def sample_configs(n: int, seed: int, coprime: bool = False) -> list[RetrievalConfig]:
    """n configurations that cycle through shuffled dimensions.

    Chunkings and searches both have four values, so plain cycling meets at most
    12 of the 48 configurations; with coprime=True searches move on by one more
    after each full cycle, which meets all.
    """
    rng = random.Random(seed)
    dims = [rng.sample(d, len(d)) for d in (CHUNKINGS, SEARCHES, TOP_KS)]
    turn = lambda i: i // 4 if coprime else 0
    return [RetrievalConfig(dims[0][i % 4], dims[1][(i + turn(i)) % 4], dims[2][i % 3]) for i in range(n)]


@dataclass(frozen=True)
class LLMConfig:
    """Where answers come from. The key is kept out of repr and never becomes a column."""

    base_url: str
    model: str
    api_key: str = field(default="", repr=False)

    @property
    def provider(self) -> str:
        host = self.base_url.lower()
        return "local" if "localhost" in host or "127.0.0.1" in host else host.split("//")[-1].split("/")[0]


def llm_presets(environ) -> dict[str, LLMConfig]:
    """local and cloud, from QUILL_LOCAL_URL, QUILL_LOCAL_MODEL, QUILL_CLOUD_URL, QUILL_CLOUD_MODEL, QUILL_CLOUD_KEY of the environment."""
    of = lambda name, default="": environ.get(f"QUILL_{name}", default)
    out = {"local": LLMConfig(of("LOCAL_URL", "http://localhost:11434/v1"), of("LOCAL_MODEL", "llama3.2:3b"))}
    if of("CLOUD_URL"):
        out["cloud"] = LLMConfig(of("CLOUD_URL"), of("CLOUD_MODEL"), of("CLOUD_KEY"))
    return out


def choose_llm(presets: dict[str, LLMConfig], name: str | None = None) -> LLMConfig:
    """The named preset, or else the first that needs no key or has one."""
    if name is not None:
        if name not in presets:
            raise ValueError(f"unknown preset {name!r}; there are {sorted(presets)}")
        if presets[name].provider != "local" and not presets[name].api_key:
            raise ValueError(f"preset {name!r} needs an API key")
        return presets[name]
    cloud = [p for p in presets.values() if p.provider != "local" and p.api_key]
    local = [p for p in presets.values() if p.provider == "local"]
    if not cloud + local:
        raise ValueError("no preset can be used")
    return (cloud + local)[0]
