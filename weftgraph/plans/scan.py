"""Whole runs: a scan of node and reference tables, and the difference of two."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame

from weftgraph.functions import exprs as E
from weftgraph.operators import cohesion, diff, findings, graph, modules, quality, scoring
from weftgraph.operators.detectors import detect
from weftgraph.sources.config import architecture_violations, config_hash, validate


@dataclass
class Scan:
    """Scored edges, stored once, and all that follows from them, made when it is asked for."""

    nodes: DataFrame
    edges: DataFrame
    config: dict

    @cached_property
    def solved(self) -> DataFrame:
        return graph.store(graph.components_and_levels(graph.file_graph(self.edges)), "levels")

    @cached_property
    def cycles(self) -> DataFrame:
        return graph.file_cycles(self.edges, self.solved)

    @cached_property
    def module_levels(self) -> DataFrame:
        return graph.store(modules.module_levels(modules.dependency_weight(self.edges)), "modules")

    @cached_property
    def quality(self) -> DataFrame:
        finest = self.module_levels.where("level = 0").drop("level")
        return quality.quality_axes(self.edges, self.solved, scoring.definitions_by_file(self.nodes), scoring.project_stats(self.nodes), finest)

    def score(self) -> DataFrame:
        return quality.quality_score(self.quality, config_hash(self.config))

    def summary(self) -> DataFrame:
        return scoring.summary(self.edges)

    def pressure(self) -> DataFrame:
        return scoring.pressure_summary(self.edges)

    def findings(self) -> DataFrame:
        return findings.with_advice(findings.cluster_findings(self.edges, self.cycles))

    def hotspots(self) -> DataFrame:
        return scoring.file_hotspots(self.edges)

    def cohesion(self) -> DataFrame:
        return cohesion.dir_cohesion(self.edges)

    def splits(self) -> DataFrame:
        return cohesion.file_splits(self.edges)

    def architecture(self, level: int = 0) -> dict[str, DataFrame]:
        return modules.architecture(self.edges, self.module_levels.where(f"level = {level}").drop("level"))

    def violations(self) -> DataFrame:
        """Of thresholds, of the gate, and of the architecture's bounds, whose parts are only made if one is set."""
        gate = self.config.get("gate")
        found = diff.violations(self.edges, self.config.get("thresholds"), (gate["minStrength"], gate["minLocality"]) if gate else None)
        if not self.config.get("architecture"):
            return found
        parts = self.architecture()
        counts = {k: parts[k].count() for k in ("tangles", "cycles", "mismatches")} | {"depth": graph.levelization(self.solved).first()["depth"]}
        bad = [(kind, message, counts[message.split()[1].rstrip(",")]) for kind, message in architecture_violations(counts, self.config)]
        return found.unionByName(self.edges.sparkSession.createDataFrame(bad, found.schema))


def scan(nodes: DataFrame, refs: DataFrame, config: dict | None = None, with_types: bool = False) -> Scan:
    """Nodes that match an ignored glob go before anything is detected."""
    config = validate(config or {})
    if config.get("ignore"):
        nodes = nodes.where(~E.matches_any("file_path", config["ignore"]))
    edges = scoring.score_edges(nodes, detect(nodes, refs, with_types))
    if config.get("heuristicFindings") == "exclude":
        edges = edges.where(~E.is_heuristic("ctype"))
    return Scan(nodes, graph.store(edges, "scored"), config)


def compare(base: Scan, head: Scan, base_root: str = "", head_root: str = "") -> dict[str, DataFrame]:
    return diff.diff(base.edges, head.edges, base.cycles, head.cycles, base_root, head_root)
