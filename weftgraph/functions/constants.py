"""Fixed tables and thresholds of the coupling model."""

from __future__ import annotations

#: Nine coupling types, weakest first; strength is the rank.
STRENGTH = {t: n for n, t in enumerate(("name", "type", "meaning", "position", "algorithm", "execution", "timing", "value", "identity"), 1)}
HEURISTIC = ("meaning", "value", "identity")
INFORMATIONAL = ("name",)
DEPENDENCY = ("name", "type")
#: Scope kinds by how far apart two nodes are that meet there.
LOCALITY = {"function": 1, "class": 2, "module": 3, "package": 4}
NO_LOCALITY, MISSING_ENDPOINT = 5, 99
DETECTOR_ORDER = ("name", "position", "algorithm", "meaning", "identity", "value", "type")

MIN_PARAMETERS = 4
CLONE_LINES = 3
MEANING_SITES, MEANING_FILES = 5, 2
VALUE_FILES = 2
COCHANGE = {"min_support": 3, "min_ratio": 0.5, "max_commits": 500, "max_files": 25}
LOUVAIN_RESOLUTION, LOUVAIN_SWEEPS, LOUVAIN_EPSILON = 2.0, 10, 1e-9
MODULE_LEVELS, MISMATCH_DIRS = 4, 2
SHARED_NEIGHBOURS, DIR_FILES, DIR_FAN_IN, DIR_CLUSTERS = 2, 3, 3, 2
SPLIT_FUNCTIONS, SPLIT_GROUPS, SPLIT_MEMBERS = 6, 2, 2
MERGE_GAP = 2
SCORE_VERSION, BASELINE_KEY_VERSION = 1, 2
SEVERITY_RANK = {"low": 0, "medium": 1, "high": 2}
AXES = ("acyclicity", "levelization", "encapsulation", "equality", "redundancy", "cohesion", "coupling")
#: Files of tests: by ending or a folder of that one name; the last two are for Python sources.
TEST_PATH = r"(?i)\.(test|spec)\.[cm]?[jt]sx?$|(^|/)__tests__/|(^|/)test_[^/]*\.py$|_test\.py$"
