"""Options, checked when they are built. Plain dataclasses take the place of a config file."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from rowloom.functions.smoothing import Smoothing
from rowloom.functions.text import node_prefix

# Fixed value: the four default node kinds. Digit = first(4) + root(2) + appear(1), then number
# (#) or text ($), then the name prefix.
DEFAULT_NODE_TYPES = ("3#__tn", "3$__tt", "5$__idx", "1$__cid")


@dataclass(frozen=True)
class NodeType:
    prefix: str
    is_first: bool
    is_root: bool
    is_appear: bool
    is_numeric: bool

    @classmethod
    def parse(cls, text: str) -> NodeType:
        head, sep, prefix = text.strip().partition("__")
        if not sep or not prefix or len(head) != 2:
            raise ValueError(f"bad node type {text!r}")
        if head[0] not in "01234567":
            raise ValueError(f"unknown class {head[0]!r} in {text!r}")
        if head[1] not in "#$":
            raise ValueError(f"unknown kind {head[1]!r} in {text!r}")
        bits = int(head[0])
        return cls(prefix, bool(bits & 4), bool(bits & 2), bool(bits & 1), head[1] == "#")

    def text(self) -> str:
        bits = 4 * self.is_first + 2 * self.is_root + self.is_appear
        return f"{bits}{'#' if self.is_numeric else '$'}__{self.prefix}"


@dataclass(frozen=True)
class NodeTypes:
    """The node kinds of a graph. A handful of literals, so flags are expressions, not joins."""

    types: tuple[NodeType, ...]

    @classmethod
    def parse(cls, texts=DEFAULT_NODE_TYPES) -> NodeTypes:
        return cls(tuple(NodeType.parse(t) for t in texts))

    def __post_init__(self) -> None:
        if not any(t.is_appear for t in self.types):
            raise ValueError("no node class appears in walks, all walks would be empty")

    @property
    def prefixes(self) -> list[str]:
        return [t.prefix for t in self.types]

    def check(self, node: Column) -> Column:
        """The prefix of a node; a runtime error for an unknown one."""
        prefix = node_prefix(node)
        problem = F.concat(F.lit("node without a known prefix: "), F.coalesce(node, F.lit("null")))
        return F.when(prefix.isin(self.prefixes) & node.contains("__"), prefix).otherwise(F.raise_error(problem))

    def flag(self, node: Column, name: str) -> Column:
        wanted = [t.prefix for t in self.types if getattr(t, name)]
        return node_prefix(node).isin(wanted) if wanted else F.lit(False)

    def flattened(self, flatten) -> list[str]:
        """Prefixes to split: ``"all"``, a comma list, a sequence, or nothing."""
        if not flatten or flatten == "false":
            return []
        if flatten == "all":
            return self.prefixes
        chosen = [f.strip() for f in flatten.split(",")] if isinstance(flatten, str) else list(flatten)
        unknown = sorted(set(chosen) - set(self.prefixes))
        if unknown:
            raise ValueError(f"unknown node types to flatten: {unknown}")
        return chosen


@dataclass(frozen=True)
class GraphOptions:
    node_types: NodeTypes = field(default_factory=NodeTypes.parse)
    flatten: str | tuple[str, ...] = "all"
    smoothing: Smoothing = field(default_factory=Smoothing)
    directed_back_edge: bool = False


@dataclass(frozen=True)
class WalkOptions:
    """``backtrack`` is True, ``"reference"`` (never draw the node written last; a walk without another
    neighbour ends) or ``"strict"`` (never draw the node come from, unless it is the only neighbour)."""

    sentence_length: int = 60
    n_sentences: int | None = None
    representation_factor: int = 1000
    walks_per_node: int | None = None
    backtrack: bool | str = True
    sampler: str = "auto"
    seed: int = 42
    steps_per_checkpoint: int = 8
    replace_strings: bool = False
    replace_numbers: bool = False
    follow_replacement: bool = False

    def __post_init__(self) -> None:
        if self.sentence_length < 1:
            raise ValueError("sentence length must be > 0")
        if self.n_sentences is not None and self.n_sentences < 1:
            raise ValueError("number of sentences must be > 0")
        if self.backtrack not in (True, False, "reference", "strict"):
            raise ValueError(f"unknown backtrack mode {self.backtrack!r}")
        if self.sampler not in ("uniform", "weighted", "auto"):
            raise ValueError(f"unknown sampler {self.sampler!r}")

    @property
    def redraw(self) -> str | None:
        if self.backtrack is True:
            return None
        return "reference" if self.backtrack is False else self.backtrack


@dataclass(frozen=True)
class TrainOptions:
    """``max_step``: greatest length of the sum of one word's steps, in a batch of a shard and over all
    shards of an epoch. It keeps words of very many occurrences stable."""

    dimensions: int = 300
    window: int = 5
    algorithm: str = "word2vec"
    method: str = "skipgram"
    min_count: int = 2
    sampling_factor: float = 0.001
    epochs: int = 5
    negative: int = 5
    learning_rate: float = 0.025
    walks_per_shard: int = 1000
    max_step: float = 1.0
    subword_min: int = 3
    subword_max: int = 6
    subword_buckets: int = 2_000_000
    seed: int = 42

    def __post_init__(self) -> None:
        if self.dimensions < 1:
            raise ValueError("number of dimensions must be > 0")
        if self.window < 1:
            raise ValueError("window must be > 0")
        if not 0 <= self.sampling_factor < 1:
            raise ValueError("sampling factor must be in [0, 1)")
        if self.algorithm not in ("word2vec", "fasttext"):
            raise ValueError(f"unknown training algorithm {self.algorithm!r}")
        if self.method not in ("skipgram", "CBOW"):
            raise ValueError(f"unknown learning method {self.method!r}")


@dataclass(frozen=True)
class MatchOptions:
    n_top: int = 10
    n_candidates: int = 1
    max_rank: int = 3
    indexing: str = "basic"
    probes: int = 8

    def __post_init__(self) -> None:
        if self.n_top < 1:
            raise ValueError("number of neighbours must be > 0")
        if not 0 < self.n_candidates <= self.n_top:
            raise ValueError("number of candidates must be between 1 and n_top")
        if self.indexing not in ("basic", "faiss", "annoy", "ngt"):
            raise ValueError(f"unknown indexing {self.indexing!r}")


@dataclass(frozen=True)
class StreamOptions:
    """``update_frequency`` is the slide (rows or seconds); 0 gives tumbling windows."""

    window_strategy: str = "count"
    window_count: int | None = None
    window_time: float | None = None
    update_frequency: int = 0
    most_similar_k: int = 10
    list_size: int = 10
    source_num: int = 0
    strategy: str = "faiss"
    output_format: str = "parquet"
    smoothing: Smoothing = field(default_factory=lambda: Smoothing.parse("log"))
    walks_per_node: int = 20
    idle_seconds: int = 60
    score_floor: float = 0.5
    limit_k: bool = True

    def __post_init__(self) -> None:
        if self.window_strategy not in ("count", "time"):
            raise ValueError("window strategy must be 'count' or 'time'")
        if self.window_strategy == "count" and (self.window_count is None or self.window_count < 1):
            raise ValueError("a count window needs window_count > 0")
        if self.window_strategy == "time" and (self.window_time is None or self.window_time <= 0):
            raise ValueError("a time window needs window_time > 0")
        if self.update_frequency < 0:
            raise ValueError("update_frequency must be >= 0")
        if self.window_strategy == "count" and self.update_frequency > self.window_count:
            raise ValueError("update_frequency must not exceed window_count")
        if self.strategy not in ("basic", "faiss"):
            raise ValueError("strategy must be 'basic' or 'faiss'")
        if self.output_format not in ("json", "parquet"):
            raise ValueError("output_format must be 'json' or 'parquet'")
