"""Stages of a run as named sets of tables, stored as one and reused when they are complete.

The tables of a save go to a folder of their own, a *version*; a small file, ``current.json``, then says which version each
table of the set is read from. It is replaced by a rename, so readers see a whole set, the old or the new one; a run that dies
between two tables leaves the old set in force and a version that nothing names.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from parlance.sources.files import delete_folder, folders, read_json, write_json_atomic
from parlance.sources.tables import usable, write_table

COMPLETED, INCOMPLETE = "completed", "incomplete"


@dataclass(frozen=True)
class StageSet:
    """Tables of one phase under a folder: the columns each needs, which of them may be missing, what is never written."""

    name: str
    required: dict[str, list[str]]
    optional: dict[str, list[str]] = field(default_factory=dict)
    private: tuple[str, ...] = ()

    def folder(self, root: str) -> str:
        return f"{root.rstrip('/')}/{self.name}"

    def manifest(self, spark: SparkSession, root: str) -> dict:
        """``status``, ``version`` and ``tables`` (each with its version) of the set in force; empty if none was stored."""
        return read_json(spark, f"{self.folder(root)}/current.json") or {}

    def path(self, root: str, table: str, version: str) -> str:
        return f"{self.folder(root)}/{version}/{table}"

    def _usable(self, spark: SparkSession, root: str, manifest: dict, table: str, columns: list[str]) -> bool:
        version = manifest.get("tables", {}).get(table)
        return version is not None and usable(spark, self.path(root, table, version), columns)

    def complete(self, spark: SparkSession, root: str) -> bool:
        """Whether the set in force was completed and every required table is there with its columns."""
        m = self.manifest(spark, root)
        return m.get("status") == COMPLETED and all(self._usable(spark, root, m, t, cols) for t, cols in self.required.items())

    def load(self, spark: SparkSession, root: str, partial: bool = False) -> dict[str, DataFrame]:
        """The tables of the set in force; a set that was not completed raises (unless ``partial``), and so does a required table that is not there."""
        m = self.manifest(spark, root)
        if m and m.get("status") != COMPLETED and not partial:
            raise ValueError(f"{self.name}: the stored set is {m.get('status')}")
        out = {}
        for t, cols in {**self.required, **self.optional}.items():
            if self._usable(spark, root, m, t, cols):
                out[t] = spark.read.parquet(self.path(root, t, m["tables"][t]))
            elif t in self.required and not partial:
                raise FileNotFoundError(f"{self.name}: {t} is missing or lacks a column of {cols}")
        return out

    def save(self, spark: SparkSession, root: str, tables: dict[str, DataFrame], keep: bool = False) -> str:
        """Write the tables, without private columns, and put them in force together; gives their version. Unknown names raise.

        With ``keep`` tables of the set in force that are not given stay in it; without, they are no longer part of it. The set is completed if it has all required tables.
        """
        unknown = set(tables) - {*self.required, *self.optional}
        if unknown:
            raise KeyError(f"{self.name} has no tables {sorted(unknown)}")
        version = f"v-{uuid.uuid4().hex}"
        for t, df in tables.items():
            write_table(df, self.path(root, t, version), drop=self.private)
        named = {**(self.manifest(spark, root).get("tables", {}) if keep else {}), **dict.fromkeys(tables, version)}
        missing = sorted(set(self.required) - set(named))
        write_json_atomic(spark, {"status": INCOMPLETE if missing else COMPLETED, "version": version, "tables": named, "missing": missing}, f"{self.folder(root)}/current.json")
        return version

    def reused(self, spark: SparkSession, root: str, make: Callable[[], dict[str, DataFrame]], force: bool = False) -> dict[str, DataFrame]:
        """The stored tables if they are complete, else made, stored and read."""
        if force or not self.complete(spark, root):
            self.save(spark, root, make())
        return self.load(spark, root)

    def swept(self, spark: SparkSession, root: str) -> list[str]:
        """Delete the versions that the set in force does not name, and give their names. Not while another run saves or still reads an old set."""
        used = set(self.manifest(spark, root).get("tables", {}).values())
        gone = [v for v in folders(spark, self.folder(root)) if v.startswith("v-") and v not in used]
        for v in gone:
            delete_folder(spark, f"{self.folder(root)}/{v}")
        return gone


def pending(inputs: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Inputs whose key no result has yet."""
    return inputs.join(done.select(*keys).distinct(), keys, "left_anti")


#: The phases and what each leaves for others.
KEYWORDS = StageSet("keywords", {"segments": ["audio_id", "total_matches"], "calls": ["audio_id", "score"], "top_calls": ["audio_id", "score"]}, {"combined": ["audio_id", "combined"]})
SENTIMENT = StageSet("sentiment", {"segments": ["audio_id", "label"], "by_call": ["audio_id", "avg_sentiment"], "by_role": ["role", "avg_sentiment"], "summary": ["metric", "value"]}, {"by_phase": ["phase"], "by_speaker": ["speaker"]})
PROSODY = StageSet("prosody", {"scores": ["audio_id", "prosodic_state"], "aggregates": ["level"], "summary": []}, {"comparison": ["audio_id"]})
FUSION = StageSet("fusion", {"segments": ["has_audio", "has_text"], "correlations": ["x", "y", "pearson"], "summary": ["metric", "value"]}, {"confusion": [], "by_role": ["role"], "by_call": ["audio_id"]})
VOICES = StageSet("voices", {"samples": ["person_id", "sample_id"], "profiles": ["person_id", "profile"], "manifest": ["status"]}, {"pairs": ["a", "b", "same"]})
RELABELLING = StageSet("relabelling", {"segments": ["audio_id", "speaker_final"], "merged": ["audio_id", "merged_ids"], "summary": ["audio_id", "n_changed"]}, {"vectors": ["v"], "anchors": ["anchor_rank"]})
CONSOLIDATION = StageSet("consolidation", {"segments": ["audio_id"], "audit": ["file_name"]}, {"dropped": ["audio_id"]})
ROLES = StageSet("roles", {"turns": ["audio_id", "role"], "matches": ["audio_id", "accepted"], "mapping": ["audio_id", "speaker", "role"]}, {"summary": ["metric", "value"]}, ("transcripcion",))
