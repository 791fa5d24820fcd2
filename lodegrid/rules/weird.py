"""Rare-bug tier: accounting, binding, ordering and unit rules."""

from __future__ import annotations

from .dsl import body, chain, count_true, name, near, params, pnames, tail
from .model import Rule

# ---- Fixed values: search patterns of this family -------------------------------------
VALUE_SINK = (r"\.\s*(?:transfer|safeTransfer|transferFrom|safeTransferFrom)\s*\(|\.call\s*\{|_mint\s*\(|mint\s*\(|_burn\s*\(")
RECEIVED = r"balanceBefore|balanceAfter|received|actualReceived|delta"
NOMINAL = r"_mint\s*\([^;]*\bamount\b|shares\s*=|minted\s*=|balanceOf\s*\(\s*address\s*\(\s*this"
LEAF = r"(?s)leaf\s*=\s*keccak256\s*\((.*?)\)\s*;"
LEAF_FIELDS = (r"recipient|account|user|msg\.sender|to\b", r"amount|value|shares|quantity",
               r"token|asset|currency", r"index|idx|nonce|id|claimId|chainid|chainId")
BRIDGE_FN = r"receive|relay|execute|finalize|bridge|message|packet|lzReceive|ccipReceive"
KEY_ARGS = r"(?s)keccak256\s*\(\s*abi\.encode(?:Packed)?\s*\((.*?)\)\s*\)"
KEY_ANCHOR = (r"src|source|sender|peer|remote|chain|domain|eid|selector|nonce|messageId|packetId|block\.chainid|address\s*\(\s*this")
L2_CHAINS = ("arbitrum", "optimism", "base", "polygon", "scroll", "linea", "zksync", "blast")
FRESH = r"updatedAt\s*>|block\.timestamp\s*-\s*updatedAt|stale|heartbeat"
ROUND = r"answeredInRound\s*>=\s*roundId|roundId\s*<=\s*answeredInRound"
POSITIVE = r"answer\s*>\s*0|price\s*>\s*0"
SEQUENCER = r"sequencer|gracePeriod|uptime"
CONSUMED_SET = r"(processed|consumed|executed|claimed|used)\s*\[[^\]]+\]\s*="
CATCH_BODY = r"(?s)catch\s*(?:\([^)]*\))?\s*\{(.*?)\}"
PAYS = r"\.\s*(safeTransfer|transfer|call)\s*(?:\(|\{)"
DEBT_MARK = r"(rewardDebt|lastClaim|claimed|checkpoint|userIndex)\s*(?:\[[^\]]+\])?\s*="
SCALES = r"\b(?:WAD|RAY|BPS|1e18|1e27|1e6|10\s*\*\*\s*(?:6|18|27))\b"
# ---------------------------------------------------------------------------------------

_rare = ("rare_lead", "needs_stateful_poc")
_econ = _rare + ("economic_leverage",)
_sink = body.has(VALUE_SINK)
_leaf_missing = lambda t: count_true(*[~t.has(f) for f in LEAF_FIELDS]) >= 2
_merkle = body.has("MerkleProof|merkle") & body.has("keccak256", i=False) & _sink
_feed = body.has("latestRoundData", i=False)
_stale = ~body.has(FRESH) | ~body.has(ROUND, i=False) | ~body.has(POSITIVE, i=False)
_arrays = pnames.where(lambda p: params.has(near(r"\b\w+\s*\[\]\s*(?:calldata|memory)?\s+", p, r"\b")))


def _w(det, key, impact, conf, when, lead=True, flags=_rare, **kw):
    return Rule(det, key, impact, conf, when, bug=det, lead=lead, flags=flags, **kw)


RULES = [
    _w("actual_received_accounting", "nominal_amount_used_without_received_delta", 8.5, 5.0,
       name.has("deposit|mint|stake|supply|addLiquidity|join") & body.has("transferFrom|safeTransferFrom", i=False)
       & ~body.has(RECEIVED) & body.has(NOMINAL), flags=_econ + ("value_sink",)),
    _w("merkle_claim_binding", "merkle_leaf_missing_value_or_domain_fields", 8.5, 5.0,
       _merkle & ((body.has(LEAF) & _leaf_missing(body.extract(LEAF, 1))) | (~body.has(LEAF) & _leaf_missing(body))),
       flags=_rare + ("value_sink",)),
    _w("bitmap_claim_collision", "bitmap_claim_index_collision", 8.0, 5.5,
       body.has("claimed|bitmap|bitMap|claimedBitMap")
       & ((body.has(r"1\s*<<\s*(?:index|idx|i)\b", i=False) & ~body.has(r"%\s*256|&\s*255", i=False))
          | body.has(r"uint8\s*\(\s*(?:index|idx|i)\s*\)", i=False)), lead=False),
    _w("bridge_replay_key", "bridge_message_key_missing_domain_fields", 9.0, 5.0,
       (name + " " + body).has(BRIDGE_FN) & body.has("processed|consumed|executed|used") & _sink & body.has(KEY_ARGS)
       & (body.extract(KEY_ARGS, 1).lower().all(KEY_ANCHOR, 0).distinct().size() < 4), flags=_econ + ("value_sink",)),
    _w("address_alias_bridge", "cross_domain_sender_alias_not_normalized", 8.0, 4.5,
       (tail + "\n" + body).has("xDomain|crossDomain|L1|L2|Optimism|Arbitrum|messenger|bridge")
       & (tail + "\n" + body).has(r"msg\.sender|xDomainMessageSender|crossDomainMessageSender", i=False)
       & ~(tail + "\n" + body).has("AddressAliasHelper|undoL1ToL2Alias|applyL1ToL2Alias|wasMyCallersAddressAliased", i=False)
       & (_sink | (tail + "\n" + body).has("execute|finalize|mint|unlock"))),
    _w("oracle_freshness_sequencer", "chainlink_oracle_missing_freshness_or_sequencer_check", 8.0, 5.5,
       _feed & (_stale | (chain.lower().isin(*L2_CHAINS) & ~body.has(SEQUENCER)))
       & (name + body).has("borrow|mint|withdraw|liquidat|swap|collateral|value|price"), lead=False, flags=_econ),
    _w("twap_observation_cardinality", "twap_can_degrade_to_spot_or_low_cardinality", 7.5, 4.5,
       body.has(r"observe\s*\(|consult\s*\(|slot0\s*\(|secondsAgo|twap")
       & (body.has(r"secondsAgo\s*=\s*0|period\s*=\s*0|secondsAgo\s*\[\s*0\s*\]\s*=\s*0")
          | (pnames.any(lambda p: p.eq("period")) & ~body.has(r"require\s*\([^)]*period\s*>=|MIN_TWAP|minimum")))
       & ~body.has("observationCardinality|increaseObservationCardinalityNext|cardinality"), flags=_econ),
    _w("forced_eth_accounting", "native_balance_used_as_accounting", 7.5, 5.0,
       body.has(r"address\(this\)\.balance", i=False) & (name + body).has("share|totalAssets|price|solvency|reward|mint|withdraw|redeem|claim")
       & ~body.has(r"accountedBalance|internalBalance|trackedBalance|totalManagedAssets|asset\.balanceOf"), lead=False, flags=_econ),
    _w("create2_metamorphic_trust", "address_only_trust_create2_or_code_check", 8.0, 4.0,
       body.has(r"CREATE2|create2|salt|extcodesize|codehash|isContract|\.code\.length", i=False)
       & (name + body).has("allow|trust|whitelist|implementation|module|adapter|strategy|target")
       & ~body.has("initCodeHash|runtimeCodeHash|expectedCodeHash|immutable|deployedBytecode")),
    _w("trycatch_finalization", "message_consumed_before_trycatch_swallow", 8.0, 5.0,
       body.has(r"try\s+[^{}]+\{", i=False) & body.has("catch", i=False) & body.has(CONSUMED_SET)
       & (body.pos(CONSUMED_SET) < body.pos(r"try\s+")) & body.has(CATCH_BODY)
       & ~body.extract(CATCH_BODY, 1).has(r"revert|throw|return\s+false"), lead=False, flags=_rare + ("cross_function",)),
    _w("reward_debt_order", "reward_transferred_before_debt_update", 8.5, 5.5,
       name.has("claim|harvest|getReward|withdraw") & body.has(PAYS) & body.has(DEBT_MARK) & (body.pos(PAYS) <= body.pos(DEBT_MARK))
       & ~(tail + body).has("nonReentrant|ReentrancyGuard"), lead=False, flags=_econ + ("value_sink",)),
    _w("accumulator_zero_supply", "reward_accumulator_divides_by_zero_supply", 7.0, 5.0,
       body.has(r"acc\w*Per\w+|rewardPerShare|index\s*\+=|globalIndex")
       & body.has(r"/\s*(?:totalSupply|totalShares|supply|shares)\b", i=False)
       & ~body.has(r"(?:totalSupply|totalShares|supply|shares)\s*==\s*0|>\s*0|!=\s*0", i=False), lead=False, flags=_econ),
    _w("position_merge_split", "position_split_merge_may_duplicate_state", 8.0, 4.5,
       name.has("split|merge|migrate|transferPosition|combine") & body.has("position|tokenId|ownerOf|_mint|_burn|ERC721")
       & ~(body.has(r"delete\s+\w+\s*\[|=\s*0|_burn\s*\(") & body.has("rewardDebt|collateral|debt|checkpoint"))
       & body.has("collateral|debt|reward|checkpoint|liquidity|shares"), flags=_rare + ("cross_function",)),
    _w("governance_snapshot_bypass", "governance_uses_current_balance_without_snapshot", 8.0, 4.5,
       (name + body).has("vote|quorum|proposal|execute") & body.has(r"balanceOf\s*\(|totalSupply\s*\(|getVotes\s*\(", i=False)
       & ~body.has("proposalSnapshot|getPastVotes|getPriorVotes|checkpoint|snapshotBlock|blockNumber"), flags=_econ),
    _w("multicall_state_cache", "payable_multicall_reuses_msg_value_or_cached_state", 8.5, 5.0,
       body.has("delegatecall", i=False) & (tail + body).has(r"payable|msg\.value|balanceBefore|cached|remainingValue")
       & ~body.has("valueUsed|msgValueRemaining|consumeValue|spentValue"), lead=False, flags=_econ + ("cross_function",)),
    _w("wad_ray_unit_mismatch", "mixed_fixed_point_units_without_normalization", 7.5, 4.5,
       (body.all(SCALES, 0, i=False).distinct().size() >= 2) & body.has(r"\*|/|mulDiv|wmul|wdiv|rayMul|rayDiv", i=False)
       & ~body.has(r"decimals\s*\(|scale|normalize|toWad|toRay|bps"), flags=_econ),
    _w("duplicate_batch_item", "batch_loop_no_duplicate_item_guard", 7.5, 5.0,
       body.has(r"for\s*\(", i=False) & ~body.has(r"seen\s*\[|visited\s*\[|duplicate|unique|dedup|require\s*\([^)]*!\s*seen")
       & body.has(r"\+=|transfer|safeTransfer|_mint|_burn|collateral|debt|amount")
       & _arrays.any(lambda a: body.has(near(r"\b", a, r"\s*\[\s*(?:i|j|k|idx)\s*\]"))), lead=False, flags=_econ),
]
