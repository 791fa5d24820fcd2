"""The rule catalog: tiers, profiles and selection."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

from . import core, incident, ultra, weird, zk
from .model import Rule

# Rules that need call edges, flows, chain facts or tool rows live in graph_rules / fact_rules.
SPECIAL = {
    "governance_blast_radius": "deep", "timelock_roles": "deep", "solvency_check": "deep", "flashloan_governance": "deep",
    "delegatecall": "deep", "analyzer_findings": "deep", "bytecode_periphery": "v2", "economic_oracle_lending": "v2",
    "pausability_bypass": "v2", "weird_hunt_taint_value_flow": "v2",
}
ULTRA_ONLY = (
    "ecrecover_zero", "eip1271_spoof", "arbitrary_from_transferfrom", "cross_chain_receiver_source_auth",
    "vault_share_donation_inflation", "erc2771_msgsender_spoof", "reinitializable_proxy_delegatecall",
    "payable_multicall_msgvalue_reuse", "signed_unsigned_cast_mismatch", "batch_array_length_mismatch",
    "liquidation_collateral_not_cleared",
)
PROFILES = ("deep", "ultra-deep", "ultra-deep-v2")


@lru_cache(maxsize=1)
def all_rules() -> tuple[Rule, ...]:
    return tuple(core.RULES + incident.RULES + ultra.RULES + ultra.TARGET_RULES + weird.RULES + zk.RULES + zk.TARGET_RULES)


def tier(detector: str) -> str:
    """deep, ultra or v2 - the first profile that runs the detector."""
    if detector in SPECIAL:
        return SPECIAL[detector]
    if detector in ULTRA_ONLY:
        return "ultra"
    wide = {r.detector for r in ultra.RULES} | {r.detector for r in weird.RULES}
    return "v2" if detector in wide else "deep"


def detectors(profile: str = "deep") -> list[str]:
    """Ordered distinct detectors of a profile; an unknown profile falls back to the deep set."""
    allowed = {"ultra-deep": ("deep", "ultra"), "ultra-deep-v2": ("deep", "ultra", "v2")}.get(profile, ("deep",))
    names = list(dict.fromkeys([r.detector for r in all_rules()] + list(SPECIAL)))
    return [n for n in names if tier(n) in allowed]


def is_ultra(profile: str) -> bool:
    return profile in ("ultra-deep", "ultra-deep-v2")


def rules_for(profile: str = "deep", only: str | None = None) -> list[Rule]:
    keep = {only} if only else set(detectors(profile))
    return [r for r in all_rules() if r.detector in keep and (r.ultra is None or r.ultra == is_ultra(profile))]


def catalog_frame(spark: SparkSession) -> DataFrame:
    """One row per (detector, profile): the profile projection."""
    rows = [(d, p, tier(d)) for p in PROFILES for d in detectors(p)]
    return spark.createDataFrame(rows, "detector string, profile string, tier string")
