"""First two detector tiers: call, upgrade, access, bridge, oracle, token and time rules."""

from __future__ import annotations

from .dsl import body, count_true, in_target, lname, name, named, near, params, pnames, tail, file_text, in_file
from .model import CONFIRM, LEAD, LOCK_HEAD, Rule, callable_fn, header_ac, inline_auth, is_ext, nonreentrant, viewish

# ---- Fixed values: search patterns of this family -------------------------------------
LOW_CALL = r"\.\s*(delegatecall|call)\s*[({]"
PERMIT_TO_CALLER = r"permit\s*\(\s*([A-Za-z_]\w*)\s*,\s*msg\.sender"
PERMIT_ANY = r"\.?permit\s*\("
TRANSFER_FROM = r"transferFrom\s*\("
UPGRADE_IMPACT = {
    9: ("upgrade", "upgradeTo", "upgradeToAndCall", "upgradeAndCall", "setImplementation",
        "changeImplementation", "diamondCut"),
    8: ("changeProxyAdmin",),
    7: ("transferOwnership",),
    6: ("renounceOwnership",),
}
PRIVILEGED_NAME = (
    r"^(set|update|change|add|remove|grant|revoke|withdraw|sweep|rescue|pause|"
    r"unpause|mint|burn|upgrade|migrate|seize|skim|collect|configure|enable|"
    r"disable|whitelist|blacklist|setowner|transferownership|setadmin|setfee|"
    r"setoracle|setverifier|setimplementation|init)\w*"
)
INIT_GUARD = (
    r"initializer|reinitializer|onlyUninitialized|_disableInitializers|"
    r"require\s*\([^)]*initialized|require\s*\([^)]*!+\s*_?initialized|"
    r"require\s*\([^)]*owner\s*==\s*address\s*\(\s*0\s*\)"
)
TX_ORIGIN = r"tx\.origin\s*==|==\s*tx\.origin|require\s*\([^)]*tx\.origin"
POLICY_HOOK = r"(allowed|verify|hook|callback)$"
PRIV_EFFECT = r"=|\.transfer|\.call|_mint|_burn|delete\b|push\s*\("
USER_METHOD = r"^(withdraw|redeem|deposit|mint|burn)$"
USER_METHOD_PRIV = (
    r"owner|admin|govern|guardian|operator|keeper|manager|fee|treasury|"
    r"collector|sweep|rescue|emergency|pause|upgrade|implementation"
)
USER_BOUND = r"\bmsg\.sender\b|_msgSender\s*\(|\bowner\b|\breceiver\b"
USER_FLOW = (
    r"_burn\s*\(|_mint\s*\(|transferFrom\s*\(|safeTransferFrom\s*\(|"
    r"safeTransfer\s*\(|\.transfer\s*\(|balances?\s*\[\s*(?:msg\.sender|owner|receiver)"
)
UNCHECKED_BLOCK = r"unchecked\s*\{([^}]*)\}"
RISKY_MATH = r"[\w.\])]\s*[+*]\s*[\w.(]"
MINTISH = r"mint|claim|credit|redeem|reward|distribute|issue"
MINT_CALL = r"_mint\s*\(|\bmint\s*\(|_creditTo|increaseBalance|balances?\[[^\]]*\]\s*\+="
IDEMPOTENT = (
    r"(processed|claimed|used|minted|consumed|finalized|nonce|seen)[\w.]*\[[^\]]*\]\s*=\s*true"
    r"|require\s*\(\s*!?\s*[\w.]*(processed|claimed|used|minted|consumed)"
)
BRIDGE_MARKERS = ("bridge", "deposit", "withdraw", "finalize", "crosschain", "cross-chain",
                  "relaymessage", "messenger", "portal", "l1", "l2", "outbox", "inbox")
RECOVERY_NAMES = r"faileddeposit|claimfailed|recoverfailed|refund|claimrefund|forcewithdraw|finalizefailed|canceldeposit"
FINALIZE_NAMES = (r"finalizewithdraw|finalizemessage|relaymessage|executemessage|finalizedeposit|provewithdraw|"
                  r"processmessage|claimwithdrawal")
REPLAY_MARK = (
    r"(finalized|processed|executed|spent|claimed|relayed|completed|recorded|"
    r"used|consumed|nonces?|nonceused|seen)[\w.]*\s*\[[^\]]*\]\s*=\s*true"
)
EXT_TRANSFER = r"\.\s*(call|transfer|send)\s*[({]|safeTransfer|sendValue|_transfer\s*\("
PROOF_WORDS = r"verify|proof|merkle|_verify|root|witness"
STATE_CLEAR = r"\bdelete\s+[\w.]+\s*\[|[\w.]+\s*\[[^\]]*\]\s*=\s*(false|0)\b"
FAILURE_CHECK = r"require\s*\([^)]*(status|failed|isfailed|hasfailed|notsuccess|!success)"
ROOT_ENTRY = (
    r"\b(process|prove\w*|execute\w*|receivemessage|ccipreceive|verifyandstore|submitroot|relay\w*)\b"
)
ROOT_GATE = (
    r"(?:require|if)\s*\(\s*\w*(?:acceptableroot|confirmedroot|confirmat|knownroot|"
    r"roots?|messages?)\s*\[[^\]]+\]\s*(?:\)|,|==\s*(?:true|1)|!=\s*0|>\s*0)"
    r"|\b(?:isknownroot|acceptableroot|isconfirmed|rootconfirmed)\s*\("
)
ZERO_ROOT_REJECT = (
    r"\b\w*(?:root|messagehash|leaf)\w*\s*!=\s*(?:bytes32\s*\(\s*0\s*\)|0x0+\b|0\b)"
    r"|status\s*==\s*\w+\.(?:proven|confirmed|verified|valid)"
)
DEFI_MARKERS = ("price", "oracle", "reward", "share", "collateral", "swap",
                "reserve", "twap", "value", "redeem", "borrow", "liquidat")
SPOT_READ = r"\.slot0\s*\(|getReserves\s*\(|getAmountsOut\s*\(|getAmountOut\s*\(|consult\s*\(|spotPrice|price0Cumulative"
FEED_READ = r"latestAnswer\s*\(|latestRoundData\s*\("
FEED_FRESH = r"updatedAt|answeredInRound|roundId|block\.timestamp\s*-|staleness|heartbeat|MAX_DELAY|priceAge"
BALANCE_PRICE = r"balanceOf\s*\([^)]*\)\s*[*/]|[*/]\s*[\w.]*balanceOf\s*\("
PRICEY = r"price|value|reward|share|rate|amountOut|collateral"
LENDING_SINK = r"\b(_?mint|borrow|liquidat|seize|redeem|setcollateral)\w*"
SPOT_SUBREAD = (r"get_p\s*\(|get_dy\s*\(|\.slot0\s*\(|getReserves\s*\(|getAmountsOut\s*\(|"
                r"price_oracle\s*\(|last_price\s*\(|spotPrice")
AGGREGATE = r"\b(median|mean|average)\s*\(|\bsort\s*\(|\bmin\s*\(|\bmax\s*\("
TWAP_WRAP = r"twap|cumulative|observe\s*\(|consult\s*\([^)]*,\s*\d+|time.?weighted"
SHARE_MULDIV = r"(assets?|amount|deposit\w*)\w*\s*\*\s*\w*supply\w*\s*/|convertToShares\s*\(|previewDeposit\s*\("
BALANCE_TOTAL = r"(asset\w*\.)?balanceOf\s*\(\s*(address\s*\(\s*this\s*\)|this)\s*\)"
VAULT_MITIGATION = (
    r"_decimalsOffset|virtualShares|10\s*\*\*\s*_?decimals|MINIMUM_LIQUIDITY|deadShares|"
    r"_mint\s*\(\s*(address\s*\(\s*0\s*\)|DEAD|0xdead|0x0+dead)|require\s*\([^)]*shares\s*>="
)
EXT_CALL = (
    r"\.call\s*\{|\.call\s*\(|\.delegatecall\s*\(|safeTransfer(From)?\s*\(|"
    r"\.transfer\s*\(|\.send\s*\(|\.transferFrom\s*\(|\.onERC|\.tokensReceived"
)
STATE_WRITE = (
    r"[\w.]+\s*\[[^\]]*\]\s*(=|[+\-]=)|"
    r"\b(balances?|totalSupply|reserves?|totalBorrows?|exchangeRate|shares?|"
    r"pending\w*|accrued\w*)\b\s*(=|[+\-]=)"
)
ELEMENT_CALLEE = r"\[[^\];]{1,40}\]\s*\)?\s*\.\s*\w+\s*\("
ACCOUNT_WRITE = (
    r"\b\w*(balance|reward|share|userinfo|accrued|staked|pending|claimable|"
    r"deposit|debt|collateral|credit)\w*\s*(\[[^\]]*\]\s*)?(=|[+\-]=)([^=]|$)"
)
SIG_USE = r"\becrecover\s*\(|\.recover\s*\(|isValidSignature\s*\("
SIG_NONCE = r"nonce|usedSignatures?|signatureUsed|_used\[|replay"
SIG_DEADLINE = r"deadline|expir|validUntil|block\.timestamp"
SIG_DOMAIN = r"DOMAIN_SEPARATOR|_domainSeparator|EIP712|chainid|block\.chainid"
RAW_ECRECOVER = r"\becrecover\s*\("
LIB_RECOVER = r"ECDSA\s*\.\s*(recover|tryRecover)\s*\(|SignatureChecker"
ZERO_ADDRESS = r"address\s*\(\s*0\s*\)|address\s*\(\s*0x0+\s*\)"
CACHED_DOMAIN = (
    r"immutable\b[^;\n]*(?:DOMAIN_SEPARATOR|domainSeparator)|"
    r"INITIAL_DOMAIN_SEPARATOR|_CACHED_DOMAIN_SEPARATOR|_cachedDomainSeparator"
)
CHAINID_RECOMPUTE = (
    r"block\.chainid\s*[=!]=|[=!]=\s*block\.chainid|_domainSeparatorV4\s*\(|_buildDomainSeparator\s*\("
)
TIME_VAR = r"(unlock|release|lock|vesting|cliff|maturity|expir)\w*time\w*"
TIME_SET = r"(unlock|release|lock|vesting|cliff|maturity|expir)\w*\s*="
MONOTONIC = (
    r">=?\s*[\w.]*(unlock|release|lock|maturity|block\.timestamp)|require\s*\([^)]*(>=|>)\s*[^)]*(time|timestamp)"
)
TIME_GATE = r"block\.timestamp\s*(>=|>)\s*\w*(unlock|release|lock|maturity)\w*"
WITHDRAWISH = r"withdraw|release|unlock|claim|drain|removeliquidity"
TOKEN_WORDS = r"token|erc20|mint|burn|transfer|supply"
BURN = r"_burn\s*\(|\bburn\s*\(|balances?\[[^\]]*\]\s*-=|totalSupply\s*-="
BURN_PRICEY = r"price|share|rate|reserve|getAmountsOut|balanceOf"
UNCHECKED_TRANSFER = r"(?:^|[^=!<>\w])\w+\.transfer(From)?\s*\([^;]*\)\s*;"
SAFE_TRANSFER = r"safeTransfer|require\s*\([^)]*transfer|bool\s+\w+\s*=\s*\w+\.transfer"
RECEIVED_DELTA = r"balanceOf\s*\([^)]*\)\s*-|received\s*=|after\s*-\s*before"
TOKEN_HOOK = r"tokensReceived|tokensToSend|onTransferReceived|_callTokensReceived|ERC777"
VOTE_NAME = r"\b(vote|castVote|propose|commit|tally|quorum)\b"
VOTE_WORDS = r"\b(quorum|votingPower|proposal|ballot|bip)\b"
SPOT_BALANCE = (r"balanceOf\w*\s*\(|votingPower\s*\(|getVotes\s*\(|deposited\s*\(|"
                r"stakedBalance|balanceOfStalk|balanceOfRoots|\.balanceOf\b")
SNAPSHOT = (r"getPastVotes|getPriorVotes|getPastTotalSupply|getPriorBalance|balanceOfAt|"
            r"totalSupplyAt|_checkpoint|writeCheckpoint|snapshot")
EMERGENCY_EXEC = r"emergencyCommit|emergencyExecute|emergencyProcess|forceCommit"
ARBITRARY_EXEC = r"\.delegatecall\s*\(|functionDelegateCall|diamondCut|_delegatecall\s*\("
EXEC_NAME = r"(execute|commit|process)"
# Words that are never a callee in a parameter declaration.
TYPE_WORDS = (r"^(address|uint|uint256|int|int256|bool|bytes|bytes32|string|calldata|memory|storage|payable|this|msg|abi)$")
# Low-level maths helpers whose unchecked blocks are expected.
MATH_LIB = (r"^_*(exp|exp2|ln|log|log2|log10|sqrt|cbrt|rpow|pow|powu|mulwad|divwad|muldiv|fullmuldiv|gm|avg|rmul|"
            r"rdiv|wmul|wdiv|mulup|muldown|divup|divdown|mulwadup|uncheckedadd|uncheckedsub|uncheckedmul|"
            r"uncheckeddiv|uncheckedinc)(_.*)?$")
# ---------------------------------------------------------------------------------------

_user_named = named.any(lambda p: body.contains(p) & p.nonempty())
_delegate = body.extract(LOW_CALL, 1).lower().eq("delegatecall")
_low_call = callable_fn & body.has(LOW_CALL, i=False)


def _arbitrary_call():
    out = []
    for deleg in (True, False):
        for guarded in (True, False):
            for user in (True, False):
                p = _low_call & (_delegate if deleg else ~_delegate) & (header_ac if guarded else ~header_ac)
                p = p & (_user_named if user else ~_user_named)
                flags = (("user_controlled_target_or_data",) if user else ()) + (("has_access_control",) if guarded else ())
                out.append(Rule("arbitrary_call", "~low_level_call", (9.0 if deleg else 7.0) - (1.0 if guarded else 0.0),
                                2.0 + (3.0 if user else 0.0) + (0.0 if guarded else 2.0), p, flags=flags))
    return out


def _proxy_upgrade():
    out = []
    for impact, names in UPGRADE_IMPACT.items():
        code = impact >= 8
        base = callable_fn & name.isin(*names)
        out.append(Rule("proxy_upgrade", "~unprotected_upgrade", float(impact), 6.0 if code else 5.0, base & ~header_ac))
        out.append(Rule("proxy_upgrade", "~guarded_upgrade", float(impact), 2.0, base & header_ac, bug="access_control",
                        flags=("has_access_control", "governance_controlled", "documented_centralization")))
    return out


_marker = lambda words: count_true(*[in_target(w) for w in words]) >= 2
_bridge = _marker(BRIDGE_MARKERS)
_defi = _marker(DEFI_MARKERS)
_finalizer = lname.has(FINALIZE_NAMES, i=False) & body.has(EXT_TRANSFER)
_recover = lname.has(RECOVERY_NAMES, i=False)

_user_asset = (lname.has(USER_METHOD) & ~body.has(USER_METHOD_PRIV) & body.has(USER_BOUND, i=False) & body.has(USER_FLOW))
_unguarded = ~header_ac & ~inline_auth
_priv = (is_ext & lname.has(PRIVILEGED_NAME) & ~lname.has("^settle") & _unguarded & ~lname.has(r"^(get|view|is|preview)", i=False)
         & ~_user_asset & body.has(PRIV_EFFECT, i=False))
_nonview = ~viewish
_guarded = tail.has(nonreentrant) | body.left(LOCK_HEAD).has(nonreentrant)
# Every identifier of the declaration is a possible callee, in order; the first that is called counts.
_callees = params.all(r"([A-Za-z_]\w*)", 1, i=False).where(lambda p: ~p.has(TYPE_WORDS) & ~p.has(r"^_?I", i=False))
_call_on = lambda p: near(r"\b", p, r"\s*\.\s*\w+\s*\(")
_callee = _callees.where(lambda p: body.has(_call_on(p))).first()


def _influenced(q, i=True):
    return ~body.before(q, i).has(ACCOUNT_WRITE) & body.after(q, i).has(ACCOUNT_WRITE)


_by_element = body.has(ELEMENT_CALLEE, i=False) & _influenced(ELEMENT_CALLEE, i=False)
_by_param = ~body.has(ELEMENT_CALLEE, i=False) & _callee.nonempty() & _influenced(_call_on(_callee))
_cei = _nonview & body.has(EXT_CALL) & body.after(EXT_CALL).has(STATE_WRITE)
_sig = body.has(SIG_USE)
_no_replay_ctl = ~body.has(SIG_NONCE) & ~body.has(SIG_DEADLINE)
_mintish = lname.has(MINTISH, i=False) & body.has(MINT_CALL) & ~body.has(IDEMPOTENT)
_time_flags = ("governance_controlled",)
_token = in_target(TOKEN_WORDS)

_permits = file_text().all(PERMIT_TO_CALLER, 1, i=False)


def _pulls(o):
    """A pull inside the window from 200 characters before the call to 400 after its start."""
    back = (r"|transferFrom\s*\(.{0,187}?permit\s*\(\s*", o, r"\s*,\s*msg\.sender")
    p = file_text().has(near(r"(?s)(?=permit\s*\(\s*", o, r"\s*,\s*msg\.sender).{0,387}?transferFrom\s*\(", *back))
    # RE2 counts from the end of the call head instead of its start; the two differ only at the window's edge
    p.d = file_text().has(near(r"(?s)permit\s*\(\s*", o, r"\s*,\s*msg\.sender.{0,360}?transferFrom\s*\(", *back)).d
    return p


RULES = [
    *_arbitrary_call(),
    Rule("permit_misuse", "~permit_to_caller_with_pull", 8.0, 4.0, in_file(PERMIT_TO_CALLER, i=False), grain="file", fn="permit",
         each=_permits.where(_pulls)),
    Rule("permit_misuse", "~permit_to_caller", 6.0, 3.0, in_file(PERMIT_TO_CALLER, i=False), grain="file", fn="permit",
         each=_permits.where(lambda o: ~_pulls(o))),
    Rule("permit_misuse", "~permit_and_pull", 5.0, 2.0,
         ~in_file(PERMIT_TO_CALLER, i=False) & in_file(PERMIT_ANY, i=False) & in_file(TRANSFER_FROM, i=False), grain="file", fn="permit"),
    *_proxy_upgrade(),
    Rule("access_control", "uups_authorize_upgrade_empty", 9.0, 8.0,
         lname.has("authorizeupgrade", i=False) & ~header_ac & ~inline_auth & ~body.has("revert"),
         bug="uups_unprotected_authorize_upgrade", tier=CONFIRM, flags=("unprivileged",), target=in_target("uupsupgradeable|upgradeto")),
    Rule("access_control", "~tx_origin_auth", 7.0, 6.0, is_ext & body.has(TX_ORIGIN), bug="access_control", flags=("unprivileged",)),
    Rule("access_control", "~initializer_without_guard", 8.5, 4.5,
         is_ext & lname.isin("initialize", "init", "__init", "setup") & ~body.has(INIT_GUARD) & ~tail.has(INIT_GUARD),
         bug="access_control", flags=("unprivileged",)),
    Rule("access_control", "~privileged_without_guard", 9.0, 5.0, _priv, bug="access_control", flags=("unprivileged",), ultra=False),
    Rule("access_control", "~privileged_without_guard", 9.0, 8.0, _priv & ~lname.has(POLICY_HOOK), bug="access_control",
         flags=("unprivileged",), ultra=True, custom_guard=True),
    Rule("arithmetic_logic", "~unchecked_math", 7.0, 4.0,
         ~lname.has(MATH_LIB, i=False) & body.all(UNCHECKED_BLOCK, 1).any(
             lambda x: x.has(RISKY_MATH, i=False) & x.has(r"(?s)\S.{11,}\S", i=False)), bug="math", flags=("unprivileged",)),
    Rule("arithmetic_logic", "~mint_without_marker", 8.5, 4.0, _mintish, bug="double_mint", flags=("unprivileged",)),
    Rule("arithmetic_logic", "~open_mint_burn", 9.0, 5.0, is_ext & _unguarded & lname.has(r"\b(mint|burn)\b", i=False),
         bug="access_control", flags=("unprivileged",), custom_guard=True),
    Rule("bridge_accounting", "bridge_root_default_acceptance", 9.0, 7.0,
         (lname.has(ROOT_ENTRY) | body.has("root|merkle|leaf")) & body.has(ROOT_GATE) & ~body.has(ZERO_ROOT_REJECT),
         bug="cross-chain-root-default-acceptance", tier=CONFIRM, target=_bridge),
    Rule("bridge_accounting", "~recovery_keeps_state", 9.0, 4.0, _recover & ~body.has(STATE_CLEAR), target=_bridge),
    Rule("bridge_accounting", "~recovery_unproven_failure", 8.0, 3.0,
         _recover & body.has(STATE_CLEAR) & ~body.has(FAILURE_CHECK), target=_bridge),
    Rule("bridge_accounting", "~finalize_unverified", 9.0, 4.0, _finalizer & ~body.has(PROOF_WORDS), target=_bridge),
    Rule("bridge_accounting", "~finalize_unmarked", 9.0, 4.0, _finalizer & ~body.has(REPLAY_MARK), target=_bridge),
    Rule("bridge_accounting", "~finalize_marked_late", 8.0, 4.0,
         _finalizer & body.has(REPLAY_MARK) & (body.pos(EXT_TRANSFER) < body.pos(REPLAY_MARK)), target=_bridge),
    Rule("oracle_manipulation", "~spot_price_valuation", 8.5, 5.0, body.has(SPOT_READ) & body.has(PRICEY), bug="oracle",
         flags=("unprivileged",), target=_defi, ultra=False),
    Rule("oracle_manipulation", "~spot_price_valuation", 8.5, 7.0, body.has(SPOT_READ) & (body.has(PRICEY) | body.has(LENDING_SINK)),
         bug="oracle", flags=("unprivileged",), target=_defi, ultra=True),
    Rule("oracle_manipulation", "~twap_reads_spot", 8.0, 6.0, lname.has("twap", i=False) & body.has(SPOT_READ), bug="oracle",
         flags=("unprivileged",), target=_defi),
    Rule("oracle_manipulation", "~feed_without_staleness", 6.5, 5.0, body.has(FEED_READ) & ~body.has(FEED_FRESH), bug="oracle",
         flags=("unprivileged",), target=_defi),
    Rule("oracle_manipulation", "~balance_derived_price", 8.0, 4.5,
         body.has(BALANCE_PRICE) & body.has(PRICEY) & ~body.has(VAULT_MITIGATION), bug="oracle", flags=("unprivileged",), target=_defi),
    Rule("oracle_manipulation", "oracle_aggregated_spot", 8.5, 6.0,
         (body.has(PRICEY) | lname.has(PRICEY)) & body.has(AGGREGATE) & body.has(SPOT_SUBREAD) & ~body.has(TWAP_WRAP),
         bug="oracle", tier=CONFIRM, flags=("unprivileged",), target=_defi),
    Rule("oracle_manipulation", "share_inflation_4626", 8.0, 6.5,
         body.has(SHARE_MULDIV) & body.has(BALANCE_TOTAL) & ~body.has(VAULT_MITIGATION), bug="share_inflation", tier=CONFIRM,
         flags=("unprivileged",), target=_defi),
    Rule("reentrancy", "reentrancy_influenceable_callee", 9.0, 6.0, _nonview & ~_guarded & (_by_element | _by_param), tier=CONFIRM,
         flags=("unprivileged",)),
    Rule("reentrancy", "~call_before_write", 9.0, 5.0, _cei & ~_guarded, bug="reentrancy", flags=("unprivileged",)),
    Rule("reentrancy", "~call_before_write_guarded", 5.0, 2.5, _cei & _guarded, bug="reentrancy", flags=("unprivileged",)),
    Rule("signature_replay", "~no_nonce_no_deadline", 8.5, 4.5, _sig & _no_replay_ctl, bug="signature", flags=("unprivileged",)),
    Rule("signature_replay", "~no_domain", 6.5, 4.0, _sig & ~_no_replay_ctl & ~body.has(SIG_DOMAIN), bug="signature",
         flags=("unprivileged",), target=~in_target(SIG_DOMAIN)),
    Rule("signature_replay", "ecrecover_no_zero_check", 8.0, 7.0,
         _sig & body.has(RAW_ECRECOVER) & ~body.has(ZERO_ADDRESS) & ~body.has(LIB_RECOVER), bug="signature", tier=CONFIRM,
         flags=("unprivileged",)),
    Rule("signature_replay", "eip712_cached_chainid_replay", 7.0, 5.0, in_file(CACHED_DOMAIN, raw=True), bug="signature",
         flags=("unprivileged",), grain="file", fn="<domain-separator>",
         target=in_target(SIG_USE) & in_target(r"block\.chainid") & ~in_target(CHAINID_RECOMPUTE)),
    Rule("time_logic", "~lock_time_not_monotonic", 7.5, 4.5,
         body.has(TIME_SET) & lname.has("set|update|extend", i=False) & ~body.has(MONOTONIC), bug="time", flags=_time_flags,
         target=in_target(TIME_VAR)),
    Rule("time_logic", "~withdraw_on_mutable_time", 6.5, 3.5, lname.has(WITHDRAWISH, i=False) & body.has(TIME_GATE), bug="time",
         flags=_time_flags, target=in_target(TIME_VAR)),
    Rule("token_logic", "~burn_moves_price", 7.5, 4.0, body.has(BURN) & body.has(BURN_PRICEY), bug="oracle", flags=("unprivileged",),
         target=_token),
    Rule("token_logic", "~unchecked_transfer", 5.0, 4.0, body.has(UNCHECKED_TRANSFER) & ~body.has(SAFE_TRANSFER), bug="token",
         flags=("unprivileged",), target=_token),
    Rule("token_logic", "~fee_on_transfer", 6.0, 3.5, body.has(TRANSFER_FROM) & ~body.has(RECEIVED_DELTA) & body.has(BURN_PRICEY),
         bug="token", flags=("unprivileged",), target=_token),
    Rule("token_logic", "~transfer_hook", 6.5, 3.5, body.has(TOKEN_HOOK), bug="reentrancy", flags=("unprivileged",), target=_token),
]
