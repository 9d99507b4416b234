"""Parameters of a study."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Config:
    seed: int = 42
    horizon_days: int = 180
    test_share: float = 0.20
    cv_folds: int = 5
    text_folds: int = 2
    search_trials: int = 30
    bootstrap_replicates: int = 1000
    top_fraction: float = 0.10
    top_states: int = 10
    screen_min_range: float = 0.01
    clip_low: float = 0.01
    clip_high: float = 0.99
    explain_rows: int = 3000
    alpha: float = 0.05
    base_trees: int = 300
    # Multiplies the tree counts of the base models, and of the search spaces.
    tree_scale: float = 1.0
    search_tree_scale: float = 1.0
    # How many independent fits the driver keeps in flight at once.
    parallelism: int = 8

    def quick(self) -> "Config":
        """Fewer trials, folds, replicates and trees; never fewer rows."""
        return replace(
            self,
            search_trials=2,
            cv_folds=3,
            bootstrap_replicates=100,
            tree_scale=0.02,
            search_tree_scale=0.02,
        )

    def trees(self, count: int) -> int:
        return max(2, round(count * self.tree_scale))

    def search_trees(self, count: int) -> int:
        return max(2, round(count * self.search_tree_scale))
