"""The whole analysis as one plan: from samples, courses and attempts to every derived table."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import comparing, ghost, matching, movement, ranking, timing
from ..sources.staging import staged


@dataclass
class Analysis:
    """Derived tables of a set of attempts, each built when first asked for.

    Tables that several others read are written once and scanned from then on, which keeps
    every later plan short and cuts lineage; the rest stay lazy.
    """

    samples: DataFrame
    courses: DataFrame
    attempts: DataFrame

    @cached_property
    def matched(self) -> DataFrame:
        return staged(matching.match_samples(self.samples, self.courses, self.attempts), "matched")

    @cached_property
    def runs(self) -> DataFrame:
        return staged(timing.replay(self.matched, self.courses), "runs")

    @cached_property
    def crossings(self) -> DataFrame:
        return staged(timing.crossings(self.matched, self.courses, self.runs), "crossings")

    @cached_property
    def status(self) -> DataFrame:
        return staged(ranking.attempt_status(self.attempts, self.runs, self.courses), "status")

    @cached_property
    def focus(self) -> DataFrame:
        return staged(ranking.focused(self.status), "focus")

    @cached_property
    def ranked(self) -> DataFrame:
        return ranking.ranked(self.focus)

    @cached_property
    def focus_segments(self) -> DataFrame:
        return ranking.focus_segments(self.focus, self.segments, self.courses)

    @cached_property
    def segments(self) -> DataFrame:
        return staged(ranking.segment_times(self.ranked, self.crossings, self.courses), "segments")

    @cached_property
    def intervals(self) -> DataFrame:
        usable = staged(matching.match_samples(matching.usable_samples(self.samples), self.courses, self.attempts), "usable-matched")
        return staged(movement.intervals(usable, self.ranked), "intervals")

    @cached_property
    def breakdown(self) -> DataFrame:
        return movement.breakdown(self.intervals, self.ranked)

    @cached_property
    def waits(self) -> DataFrame:
        return staged(movement.wait_events(self.intervals, self.ranked, self.courses), "waits")

    @cached_property
    def clusters(self) -> DataFrame:
        return staged(comparing.wait_clusters(self.waits, self.focus, self.courses), "clusters")

    @cached_property
    def comparison(self) -> DataFrame:
        return comparing.wait_comparison(self.clusters, self.waits, self.breakdown, self.focus)

    @cached_property
    def knots(self) -> DataFrame:
        return staged(ghost.knots(self.matched, self.ranked, self.courses), "knots")

    @cached_property
    def legs(self) -> DataFrame:
        return staged(ghost.legs(self.knots, self.intervals), "legs")

    @cached_property
    def ghosts(self) -> DataFrame:
        return ghost.compare(self.knots, self.legs, self.ranked)

    @cached_property
    def painted(self) -> DataFrame:
        return ghost.painted_finish(self.knots, self.legs, self.ranked, self.courses)

    @cached_property
    def ghost_availability(self) -> DataFrame:
        return ghost.availability(self.focus, self.painted)

    @cached_property
    def report(self) -> DataFrame:
        """Every attempt as the focus, in one row: rank, deltas, its segments, waits, the places of its comparison, and both comparisons' outcome."""
        listed = lambda rows, first, name, *rest: rows.groupBy("attempt_id").agg(F.sort_array(F.collect_list(F.struct(first, *rest))).alias(name))
        whole = lambda rows, name: rows.select("attempt_id", F.struct(*[c for c in rows.columns if c != "attempt_id"]).alias(name))
        gold = ranking.segment_deltas(self.segments, self.ranked).select("attempt_id", "seg", "is_new_gold")
        segments = self.focus_segments.join(gold, ["attempt_id", "seg"], "left").withColumn("is_new_gold", F.coalesce("is_new_gold", F.lit(False)))
        out = self.focus.join(listed(segments, "seg", "segments", "segment_id", "duration_ms", "target_ms", "delta_ms", "gold_ms", "is_new_gold"), "attempt_id", "left")
        out = out.join(listed(self.waits, "start_ms", "waits", "wait_id", "duration_ms", "progress_m"), "attempt_id", "left").join(listed(self.clusters, "cluster", "places", "location_id", "delta_ms", "match_state", "shown"), "attempt_id", "left")
        return out.join(whole(self.comparison, "waiting"), "attempt_id", "left").join(whole(self.ghost_availability, "ghost"), "attempt_id", "left")
