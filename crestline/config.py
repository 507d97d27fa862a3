"""Settings of the analysis: the time grid, unit rules, feature sets and model arms."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Band:
    """A grid of equal bins over one stretch of time, for clocks of one date or for timestamps.

    Hours are inclusive: a band from 16 to 23 ends with 23:59:59.
    """

    date: str
    start_hour: int = 16
    end_hour: int = 23
    bin_minutes: int = 5
    drop_dates: tuple[str, ...] = ()

    @property
    def bin_seconds(self) -> int:
        return 60 * self.bin_minutes

    @property
    def start_second(self) -> int:
        return 3600 * self.start_hour

    @property
    def end_second(self) -> int:
        return 3600 * (self.end_hour + 1) - 1

    @property
    def n_bins(self) -> int:
        return (self.end_second + 1 - self.start_second) // self.bin_seconds

    def minutes_to_bins(self, minutes: int) -> int:
        return 60 * minutes // self.bin_seconds

    def clock_of(self, bin_number: int) -> str:
        second = self.start_second + bin_number * self.bin_seconds
        return f"{second // 3600:02d}:{second % 3600 // 60:02d}"

    def other_hours(self, start_hour: int, end_hour: int) -> Band:
        return replace(self, start_hour=start_hour, end_hour=end_hour)


@dataclass(frozen=True)
class Rules:
    """How a topic's series becomes a unit; lengths are in bins."""

    n_bins: int = 96
    smooth: int = 3
    min_topic: int = 50
    min_window: int = 15
    lead: int = 12
    window: int = 18
    left_percent: int = 25
    tail: int = 12
    decay_percent: int = 70


#: The binding to the ``events`` table: six-hour bins over its thirty days.
EVENTS_START = "2024-01-01 00:00:00"
EVENTS_BIN_SECONDS = 21600
EVENT_RULES = Rules(n_bins=120, min_topic=5, min_window=1, lead=7, window=20, tail=15)
FEATURE_LANGUAGE = "view"
TRENDING_EVERY = 3
GROWTH_SLICES = 3

#: Which feature belongs to which set, and which sets make up an arm.
FEATURE_SETS: dict[str, tuple[str, ...]] = {
    "volume_baseline": ("window_tweets", "unique_users", "tweets_per_active_bin"),
    "size_dependent": ("active_bin_frac", "n_nodes", "n_edges", "n_components", "n_communities", "community_entropy", "mean_component_size", "density", "largest_wcc_frac", "largest_community_frac", "max_pagerank", "max_in_degree", "mean_in_degree", "max_out_degree", "max_core", "mean_core", "max_betweenness", "mean_betweenness", "mean_clustering", "core2_frac", "modularity", "reciprocity"),
    "sentiment": ("sent_mean", "sent_var", "sent_intensity", "sent_strong_frac", "sent_pos_frac", "sent_neg_frac", "sent_neu_frac", "sent_skew", "sent_polarisation"),
    "temporal": ("slope_norm", "accel_norm", "peakedness", "mass_centroid", "frac_last_quarter", "log_half_ratio", "arima_ma2", "arima_resid_acf1", "arima_forecast_ratio"),
    "temporal_size_dependent": ("burstiness", "bin_entropy", "bin_gini", "monotone_up_frac", "zero_bin_frac", "arima_resid_cv", "acf1", "arima_ma1"),
    "structure_size_free": ("tweets_per_user", "edges_per_tweet", "edge_node_ratio_final", "pagerank_gini", "betweenness_gini", "core3_frac", "node_growth_slope", "edge_growth_slope", "author_growth_slope", "new_author_frac_last_slice"),
}


@dataclass(frozen=True)
class Arm:
    name: str
    sets: tuple[str, ...] = ()
    residualise: str | None = None
    model: str = "default"


ARMS = (
    Arm("chance"),
    Arm("volume_only", ("volume_baseline",)),
    Arm("structure_size_free", ("structure_size_free",)),
    Arm("volume_plus_structure", ("volume_baseline", "structure_size_free")),
    Arm("sentiment_only", ("sentiment",)),
    Arm("volume_plus_sentiment", ("volume_baseline", "sentiment")),
    Arm("structure_residualised", ("structure_size_free", "size_dependent"), residualise="structure_size_free"),
    Arm("temporal_only", ("temporal",)),
    Arm("volume_plus_temporal", ("volume_baseline", "temporal")),
    Arm("full_fusion", ("volume_baseline", "structure_size_free", "sentiment", "temporal")),
    Arm("full_fusion_regularised", ("volume_baseline", "structure_size_free", "sentiment", "temporal"), model="regularised"),
    Arm("volume_extended", ("volume_baseline", "size_dependent", "temporal_size_dependent")),
)
VOLUME_PROXY = "window_tweets"
#: Names of features that grow with a topic's volume.
COUNT_LIKE = ("window_tweets", "unique_users", "tweets_per_active_bin", "max_in_degree", "mean_in_degree", "max_out_degree", "max_core", "mean_core", "mean_component_size", "community_entropy")


def arm_columns(arm: Arm, sets: dict[str, tuple[str, ...]] = FEATURE_SETS) -> list[str]:
    """Feature columns of an arm; a residualised arm has its target set and the proxy last."""
    if arm.residualise:
        return [*sets[arm.residualise], VOLUME_PROXY]
    return [c for name in arm.sets for c in sets[name]]


def validate(columns: list[str], sets: dict[str, tuple[str, ...]] = FEATURE_SETS, free: str = "structure_size_free") -> None:
    """Raise ValueError unless every column is in one set, every set's column exists, and no count is called size-free."""
    given = [c for own in sets.values() for c in own]
    have = {c for c in columns if c not in ("topic", "label") and not c.startswith("meta_")}
    faults = []
    if twice := sorted({c for c in given if given.count(c) > 1}):
        faults.append(f"in more than one set: {twice}")
    if missing := sorted(set(given) - have):
        faults.append(f"the matrix does not have: {missing}")
    if unknown := sorted(have - set(given)):
        faults.append(f"in no set: {unknown}")
    if counts := sorted(c for c in sets.get(free, ()) if c.startswith("n_") or c in COUNT_LIKE):
        faults.append(f"counts among the size-free: {counts}")
    if faults:
        raise ValueError("; ".join(faults))


@dataclass(frozen=True)
class Sweep:
    """The grid of settings for unit counts."""

    min_topics: tuple[int, ...] = (5, 10, 20)
    leads: tuple[int, ...] = (4, 7, 14, 21)
    windows: tuple[int, ...] = (8, 14, 20)
    majority: float = 0.5


SWEEP = Sweep()
