"""Parameters of a whole run; the names are those of the command line."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    min_contig_length: int = 1_000
    min_bin_size: int = 100_000
    min_cluster_size: int = 2
    min_samples: int | None = None
    cluster_selection_epsilon: float = 0.4
    embedding_dim: int = 32
    num_augmentations: int = 8
    max_positive_pairs: int = 5_000_000
    max_refinement_rounds: int = 2
    skip_bacterial_filter: bool = False
    skip_kmeans_filtering: bool = False
    skip_refinement: bool = False
    enable_chimera_detection: bool = False
    keep_intermediate: bool = False

    def __post_init__(self) -> None:
        for name, low, high in (("min_contig_length", 1, None), ("min_bin_size", 0, None), ("min_cluster_size", 2, None), ("embedding_dim", 1, 136), ("num_augmentations", 1, 32), ("max_positive_pairs", 1, None), ("max_refinement_rounds", 0, 10)):
            value = getattr(self, name)
            if value < low or (high is not None and value > high):
                raise ValueError(f"{name} must be {low} or more{'' if high is None else f' and at most {high}'}")
        if self.min_samples is not None and self.min_samples < 1:
            raise ValueError("min_samples must be 1 or more")

    @property
    def core_neighbour(self) -> int:
        return self.min_samples or self.min_cluster_size
