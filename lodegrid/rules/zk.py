"""Proof-verifier and privacy-pool rules."""

from __future__ import annotations

from .dsl import Many, Text, body, count_true, file_pred, file_text, in_file, in_target, lname, name, near, params, pnames, tail, word
from .model import CONFIRM, LEAD, LOCK_HEAD, Rule, header_ac, is_view

# ---- Fixed values: search patterns of this family -------------------------------------
STRONG_TERMS = ("verifyproof", "verifyingkey", "g1point", "g2point", "groth16", "plonk", "snark", "pairing", "snark_scalar_field",
                "nullifier", "verifytx", "ecpairing", "escapehatch", "performdesert", "withdrawdesert", "proveexit")
WEAK_TERMS = ("verify(", ".verify", "verifier", "setverifier", "updateverifier", "proof", "commitment", "stateroot", "merkleroot",
              "publicinput", "publicsignals", "isknownroot", "staticcall", "executebatch", "commitbatch", "pubdata",
              "onchainoperationshash", "storedbatchhashes", "committedroot", "provebatch", "desert", "roothistory")
VERIFY = r"verif(?:y|yproof|ytx|yplonk|ygroth16|yandupdate)\w*"
VERIFY_CALL = r"[\w.]*" + VERIFY + r"\s*\("
SINK_AMOUNT = (r"\.call\s*\{\s*value\s*:\s*[\w.\[\]]+|\.transfer\s*\(\s*[\w.\[\]]+\s*\)|\.send\s*\(\s*[\w.\[\]]+\s*\)"
               r"|_mint\s*\([^,()]+,\s*[\w.\[\]]+\s*\)")
VALUE_MOVE = (r"\.call\s*\{\s*value\s*:|\.transfer\s*\(|\.send\s*\(|safeTransfer(?:From)?\s*\(|_mint\s*\(|increaseBalanceToWithdraw\s*\(")
HASH_CALL = r"(?:abi\.encode\w*|keccak256|sha256|poseidon)\s*\("
EXIT_NAME = (r"escapehatch|escapeexit|forced?_?exit|forced?_?withdraw|emergency(exit|withdraw)|performexit|performdesert|"
             r"withdrawdesert|proveexit|^exit$|withdraw")
STATE_SOURCE = r"\b(deposits?|deposited|notes?|leaves|balances?|commitments?|stored\w*)\b"
ADMIN_CHECK = r"msg\.sender\s*==\s*\w*(owner|admin|governance|timelock|guardian)|_check(Owner|Role)\s*\(|hasRole\s*\(|_authorize"
RECIPIENT_PARAM = r"address\s+(?:payable\s+)?(\w*(?:recipient|receiver|dest)\w*|to|owner|l1address)\b"
VERIFIER_PARAM = r"\b(?:address|I\w*[Vv]erifier)\s+(\w*verifier\w*)\b"
FEE_PARAM = r"\b\w+\s+(?:payable\s+)?(\w*fee\w*|relayerfee)\b"
RELAYER_PARAM = r"\b\w+\s+(?:payable\s+)?(\w*relayer\w*)\b"
SIGNAL_NAME = r"^(recipient|to|amount|value|nullifier|root|commitment|relayer|fee)$"
BARE_VERIFY = r"(?:^|[;{])\s*([\w.]*" + VERIFY + r"\s*\([^;]*\)\s*);"
BOOL_VERIFY = r"\bbool\s+(\w+)\s*=\s*[\w.]*" + VERIFY + r"\s*\("
REAL_CHECK = (r"staticcall|delegatecall|\bcall\s*\(|pairing|ecpairing|ecmul|ecadd|0x08|require\s*\(|assert\s*\(|revert|"
              r"return\s+\w+\s*(&&|\|\||\.)")
ASM_SUCCESS = r"(\w+)\s*:=\s*(?:staticcall|call)\s*\("
SET_VERIFIER = r"^(set|update|upgrade|change)\w*verifier\w*$"
SPENT_CHECK = r"require\s*\(\s*!\s*[\w.]*(nullifier\w*|spent\w*|isspent\w*|usednullifiers?)\s*\["
SPENT_CHECK_FILE = r"require\s*\(\s*!\s*[\w.]*(nullifier\w*|spent\w*)\s*\["
NULLIFIER_WRITE = (r"(nullifier\w*|nullifierhashes?|isspent\w*|usednullifiers?|spentnullifiers?|nullifierspent)"
                   r"\s*\[[^\]]*\]\s*=\s*(true|1)\b")
NULLIFIER_HASH = r"nullifier\w*\s*=\s*(?:keccak256|sha256|poseidon)\s*\(([^;]*)\)"
EXECUTE_NAME = r"executebatch|executebatches|_executeonebatch|finalize|processwithdraw|executewithdraw"
PUBDATA = r"onchainoperationspubdata|_pubdata|\bpubdata\b"
CREDITS = r"increasebalancetowithdraw\s*\(|safetransfer|_mint\s*\(|\.call\s*\{\s*value|\bbal\w*\s*\[[^\]]+\]\s*\+="
OPS_HASH = r"(onchainoperationshash|operationshash|pubdatahash|commitment|priorityoperationshash)"
ESCAPE_NAME = r"escapehatch|forced?exit|forceexit|emergency\w*|performdesert|\bdesert\b"
LIVENESS_GATE = (r"block\.(timestamp|number)|frozen|halted|paused|iscensored|exodusmode|desertmode|lastblock\w*|\bdelay\b|\bwindow\b")
NARROWED = r"(?:uint128|uint96|uint64)\s*\(\s*(\w+)\s*\)"
SETTLE_NAME = (r"processrollup|processblock|processbatch|executebatch|processrollupproof|decodeproof|decoderollup|_?decode\w*proof|"
               r"settle|processdeposit|processwithdraw")
SETTLE_BODY = (r"publicinputshash|sha256\s*\(|verif|staticcall\s*\([^)]*0x0?2\b|num_?real_?transactions|"
               r"num_real_transactions_offset|rollup_header_length")
COUNT_VAR = (r"(?:^|[^A-Za-z0-9_])(_?(?:num(?:real)?(?:txs|transactions|blocks)|numtxs|numrealtxs|rollupsize|numinnerrollups|"
             r"batchsize|numblocks))\b")
SIZES = r"\bfor\b|\bwhile\b|div\(|mul\(|calldatacopy|mstore"
EXTRACTED = r"\b(\w+)\s*=\s*(?:extract\w*|_?decode\w*|abi\.decode)\s*\([^;]*\b(?:proofdata|pubdata|calldata|proof)\b"
HASH_BOUND = r"(keccak256|sha256)\s*\([^;]*\)\s*(==|!=)|(==|!=)\s*[\w.]*(publicinputshash|commitment|operationshash)"
ROOT_PARAM = r"\b(bytes32|uint256)\s+\w*root\b"
ROOT_ANCHOR = (r"isknownroot|knownroots?|_isknownroot|isvalidroot|roots\s*\[|roothistory|recentroots|root_history_size|"
               r"require\s*\([^;]*root[^;]*(known|currentroot)")
STORES_ROOT = r"\w*root\w*\s*=\s*\w*newroot"
COMMIT_WORD = r"commitbatch|commitblock"
EXECUTE_WORD = r"executebatch|executewithdraw|_executeonebatch|finalize|withdraw"
PROVEN_GATE = r"provebatch|verifybatch|verifiedbatches|isproven|proof_verified|require\s*\([^;]*proof"
FIELD_CONST = (r"21888242871839275222246405745257275088548364400416034343698204186575808495617|snark_scalar_field|prime_r|field_size")
VERIFY_INPUTS = VERIFY + r"\s*\([^)]*\buint256\s*\["
FIELD_CHECK = r"<\s*(snark_scalar_field|prime_r|field_size)\b|require\s*\([^;]*input[^;]*<"
VK_G2 = r"\w*\s*=\s*(?:Pairing\.)?G2Point\s*\((.*)\)\s*;"
VK_SCALAR = r"[a-z0-9_]*\s*=\s*(0x[0-9a-fA-F]+|\d{6,})"
VK_POINT = r"\b(?:alpha|beta|gamma|delta|vk\.\w+|ic\[\d+\])\w*\s*=\s*(?:Pairing\.)?G[12]Point\s*\((.*)\)\s*;"
PRIVACY_HINT = (r"nullifier|commitment|mixer|privacy|withdraw|relayer|denomination|merkle|root|isKnownRoot|verifyProof|"
                r"publicInput|publicSignals|proof")
PROOF_WORD = r"verify\w*\s*\(|\bproof\b|publicInputs?|publicSignals?|snark|groth|plonk"
KNOWN_ROOT = (r"isKnownRoot\s*\(|_isKnownRoot\s*\(|knownRoots?\s*\[|roots\s*\[|rootHistory|recentRoots?|currentRoot|"
              r"require\s*\([^;]*root[^;]*(known|current|valid|==)")
PRIVACY_SINK = (r"\.\s*(?:transfer|send|safeTransfer|safeTransferFrom)\s*\(|\.\s*call\s*\{\s*value\s*:|_mint\s*\(|mint\s*\(")
CRITICAL_PARAM = r"recipient|receiver|to$|amount|value|fee|relayer|root|nullifier|commitment|denomination"
REPLAY_VAR = r"\b(\w*(?:nullifier|spent|claimed|used|consumed)\w*)\s*\["
FEE_BOUND = (r"require\s*\([^;]*(?:fee|relayerFee)[^;]*(?:<=|<)[^;]*(?:amount|value|denomination|deposit|withdrawal)")
AMOUNT_PARAM = r"amount|value|denomination|deposit"
# ---------------------------------------------------------------------------------------

# Text the proof is bound to: verify arguments, public-input lists, hash preimages.
binding = (body.all(VERIFY + r"\s*\(([^;]*)\)", 1) + body.all(r"\[([^\];]*)\]", 1, i=False).where(lambda x: x.has(r",|\("))
           + body.all(HASH_CALL + r"([^;]*)\)", 1)).text(" ").lower()
_score = count_true(*[in_target(w, i=True, raw=False) for w in STRONG_TERMS])
_lit = lambda w: w.replace("(", r"\(").replace(".", r"\.")
_weak = count_true(*[in_target(_lit(w), raw=False) for w in WEAK_TERMS])
_is_zk = (_score + _score + _weak) >= 2
_nv = ~is_view
_verify = body.has(VERIFY_CALL)
_ac = header_ac | body.has(ADMIN_CHECK)

_amt = body.all(SINK_AMOUNT, 0).map(lambda m: m.extract(r"([\w.\[\]]+)\s*\)?$", 1, i=False)).where(lambda a: a.nonempty()).first()
_w = lambda t: word(t, i=True)
_from_state = body.has(near(r"\b", _amt, r"\b\s*=\s*[\w.]*(\[|" + STATE_SOURCE + ")", i=True))
_requires = body.all(r"require\s*\(([^;]*?)\)\s*;", 1)
_req_binds = _requires.any(lambda r: r.has(_w(_amt)) & r.has(r"(<=|>=|==)", i=False))
_recip = params.extract(RECIPIENT_PARAM, 1)
_credits = body.has(near(r"\b(bal|balances?)\s*\[\s*", _recip, r"\s*\]|", _recip, r"\s*\.\s*(transfer|send|call)|payable\s*\(\s*", _recip,
                         r"\s*\)|\.call\s*\{\s*value[^}]*\}\s*\(\s*", _recip, i=True))
_fee, _relayer = params.extract(FEE_PARAM, 1), params.extract(RELAYER_PARAM, 1)
_fee_paid = body.has(near(r"-\s*", _fee, r"\b|", _relayer, r"\s*\.\s*transfer|transfer\s*\(\s*", _fee, i=True))
_region = body.since(VALUE_MOVE)
_consumed = lambda p: ((body.has(VALUE_MOVE) & _region.has(_w(p))) | (~body.has(VALUE_MOVE) & body.has(_w(p)))
                       | body.has(near(r"\[\s*", p, r"\s*\]\s*=", i=True)))
_unfed = pnames.any(lambda p: p.has(SIGNAL_NAME) & _consumed(p) & ~binding.has(_w(p)))
_flag = body.extract(BOOL_VERIFY, 1)
_after_flag = body.after(BOOL_VERIFY)
_flag_used = body.has(near(r"(?i:(require|assert|if)\s*\([^;]*\b)", _flag, r"\b|(&&|\|\||!)\s*", _flag, r"\b|\breturn\b[^;]*\b", _flag,
                           r"\b|\w+\s*\([^;]*\b", _flag, r"\b[^;]*\)"))
_ok = body.extract(ASM_SUCCESS, 1)
_ok_checked = body.has(near(r"(require|assert|if)\s*\(\s*!?\s*", _ok, r"\b|iszero\s*\(\s*", _ok, r"\s*\)", i=True))
_vparam = params.extract(VERIFIER_PARAM, 1)
_invoked = body.has(near(r"(I\w*[Vv]erifier\s*\(\s*)?", _vparam, r"(\s*\))?\s*\.\s*" + VERIFY, i=True))
_gated = body.has(near(r"require\s*\([^;]*", _vparam, r"[^;]*(==|allowed|whitelist|trusted|registry)|(isallowed|allowedverifiers)\s*[\(\[]\s*",
                       _vparam, i=True))
_nullifier = body.has(r"\bnullifier\w*\b") & body.has(VALUE_MOVE) & _nv
_spent = body.has(SPENT_CHECK) | in_file(SPENT_CHECK_FILE)
_locked = (tail + body.left(LOCK_HEAD)).has("nonreentrant|reentrancyguard|_status")
_narrow = binding.extract(NARROWED, 1)
_count = body.extract(COUNT_VAR, 1)
_bounds = body.has(near(_count, r"\s*[/*]|(?:div|mul)\s*\(\s*", _count, r"|<\s*[\w.]*", _count, r"\b|", _count, r"\s*[<>]", i=True))
_sized = body.has(SIZES) | body.has(near(r"\[\s*", _count, i=True))
_count_bound = (body.has(near(r"require\s*\(\s*[\w.]*", _count, r"\s*(==|<=)", i=True)) | binding.has(_w(_count)))
_counts_required = in_file(r"require\s*\(\s*[\w.]*_?(?:num(?:real)?(?:txs|transactions|blocks)|numtxs|numrealtxs|rollupsize|numinnerrollups|"
                           r"batchsize|numblocks)\s*(==|<=)")
_got = body.extract(EXTRACTED, 1)
_flows = body.has(near(r"(\.transfer|safetransfer\w*|_?(?:mint|transfer|credit)\w*)\s*\([^;]*\b", _got, r"\b|\.call\s*\{\s*value\s*:\s*", _got,
                       r"\b", i=True))
_norm = lambda m: m.map(lambda x: Text(f"regexp_replace(lower({x.s}), r'[\\s\\[\\]()]|uint\\d*', '')",
                                       f"regexp_replace(lower({x.d}), '[\\s\\[\\]()]|uint\\d*', '', 'g')"))
_f = file_text()
_g2 = lambda w: _norm(_f.all(w + VK_G2, 1))
_sc = lambda w: _f.all(r"\b" + w + VK_SCALAR, 1).map(lambda x: x.lower())
_same_points = file_pred(_g2("gamma").overlaps(_g2("delta")))
_same_scalars = file_pred((_sc("gamma").size() >= 2) & _sc("gamma").same(_sc("delta")))
_zero_point = file_pred(_f.all(VK_POINT, 1).any(lambda a: (a.all(r"0x[0-9a-fA-F]+|\b\d+\b", 0, i=False).size() > 0)
                                                & a.all(r"0x[0-9a-fA-F]+|\b\d+\b", 0, i=False).every(lambda c: c.has(r"^(0x)?0+$"))))

_ptext = name + " " + tail + " " + body
_private = _ptext.has(PRIVACY_HINT) & (
    (count_true(*[_ptext.has(p) for p in (r"nullifier", r"\broot\b", r"\bproof\b", r"verif", r"relayer|denomination")]) >= 2)
    | (name.has("withdraw|claim|exit") & _ptext.has(PROOF_WORD)))
_psink = body.has(PRIVACY_SINK)
_writes = lambda v: near(r"(?i:\bdelete\s+", v, r"\b|\b", v, r"\s*(?:\[[^\]]+\])?\s*(?:=|\+=|-=|\*=|/=|%=|\+\+|--)|\b", v, r"\s*\.\s*(?:push|pop)\s*\()")
_rvars = body.all(REPLAY_VAR, 1).distinct()
_spent_check = lambda v: (body.has(near(r"(?is)require\s*\([^;]*(!\s*", v, r"\s*\[|", v, r"\s*\[[^;]*(?:==\s*false|!=\s*true))"))
                          | (body.has("(?:already|spent|used|nullifier)") & body.has("revert|require")))
_late = _rvars.any(lambda v: body.has(_writes(v)) & body.before_last(_writes(v)).has(PRIVACY_SINK))
_unspent = _rvars.any(lambda v: body.has(_writes(v)) & ~_spent_check(v))
_pregion = body.since(PRIVACY_SINK)
_unbound_critical = pnames.any(lambda p: p.has(CRITICAL_PARAM) & _pregion.has(_w(p)) & ~binding.has(_w(p)))
_pfee = pnames.where(lambda p: p.has("fee")).first()
_pamt = pnames.where(lambda p: p.has(AMOUNT_PARAM)).first()
_fee_bounded = body.has(FEE_BOUND) | body.has(near(r"\b", _pfee, r"\s*<=\s*", _pamt, i=True)) | binding.has(_w(_pfee))


def _z(key, impact, conf, when, tier, bug, **kw):
    return Rule("zk_verifier", key, impact, conf, when, bug=bug, tier=tier, target=kw.pop("target", _is_zk), **kw)


def _p(key, impact, conf, when, bug, lead):
    return Rule("privacy_pool", key, impact, conf, _private & when, bug=bug, lead=lead, flags=("needs_stateful_poc",), once_fn=True)


RULES = [
    _z("forced_exit_released_value_unbound_to_proof", 10.0, 5.0,
       body.has(r"verif|\bproof\b|commitment|publicinput") & name.has(EXIT_NAME) & _nv & _amt.nonempty() & params.has(_w(_amt))
       & ~binding.has(_w(_amt)) & ~_from_state & ~_req_binds, LEAD, "proof-to-value-binding"),
    _z("exit_commitment_omits_or_redirects_recipient", 8.0, 4.0,
       _recip.nonempty() & _nv & body.has(HASH_CALL) & _verify & _credits & ~binding.has(_w(_recip)), LEAD, "proof-to-value-binding"),
    _z("withdrawal_fee_relayer_unbound_or_unbounded", 8.0, 5.0,
       _fee.nonempty() & _relayer.nonempty() & _nv & _fee_paid & ~binding.has(_w(_fee))
       & ~body.has(near(r"require\s*\([^;]*\b", _fee, r"\b[^;]*<=?", i=True)), LEAD, "proof-to-value-binding"),
    _z("public_inputs_not_fed_to_verify", 9.0, 5.0, _verify & _nv & _unfed, LEAD, "public-signal-not-bound"),
    _z("verify_return_value_ignored", 9.0, 8.0, body.has(BARE_VERIFY), CONFIRM, "verifier-invocation-flaw"),
    _z("verify_return_value_ignored", 9.0, 8.0, ~body.has(BARE_VERIFY) & _flag.nonempty() & ~_flag_used, CONFIRM, "verifier-invocation-flaw"),
    _z("noop_stub_verifier_returns_true", 10.0, 8.0, name.has(r"verif(y|yproof|ytx)") & body.has(r"return\s+true\s*;") & ~body.has(REAL_CHECK)
       & ~body.all(r"return\s+(\w+)\s*;", 1).any(lambda x: ~x.has("^true")),
       CONFIRM, "verifier-invocation-flaw"),
    _z("verifier_staticcall_success_unchecked", 9.0, 7.0, _ok.nonempty() & body.has("verif") & ~_ok_checked, CONFIRM, "verifier-invocation-flaw"),
    _z("set_verifier_no_access_control", 9.0, 7.0,
       name.has(SET_VERIFIER) & body.has(r"verifier\w*\s*=") & tail.has(r"\b(external|public)\b|unknown", i=False) & ~_ac, CONFIRM,
       "mutable_verifier_trust"),
    _z("verifier_from_caller_supplied_source", 9.0, 7.0, _vparam.nonempty() & _nv & _invoked & ~_gated, CONFIRM, "attacker_controlled_verifier"),
    _z("nullifier_no_spent_check", 9.0, 7.0, _nullifier & ~_spent, CONFIRM, "nullifier_double_spend"),
    _z("nullifier_marked_after_transfer_cei", 9.0, 7.0,
       _nullifier & _spent & ~_locked & body.has(NULLIFIER_WRITE) & (body.pos(NULLIFIER_WRITE) > body.pos(VALUE_MOVE)), CONFIRM, "nullifier_cei"),
    _z("nullifier_not_keyed_by_asset_or_recipient", 8.0, 4.0,
       body.has(NULLIFIER_HASH) & _recip.nonempty() & _nv & ~body.extract(NULLIFIER_HASH, 1).has(_w(_recip))
       & ~body.has(r"msg\.sender\s*\.\s*(transfer|send|call)"), LEAD, "nullifier_binding"),
    _z("execute_batch_pubdata_hash_not_compared", 10.0, 7.0,
       name.has(EXECUTE_NAME) & _nv & body.has(PUBDATA) & body.has(CREDITS)
       & ~(body.has(OPS_HASH) & body.has("(!=|==|revert|require)", i=False)), CONFIRM, "proof-to-value-binding"),
    _z("escape_hatch_missing_liveness_or_pause_gate", 6.0, 6.0,
       name.has(ESCAPE_NAME) & body.has(VALUE_MOVE) & _nv & ~(tail + body).has(LIVENESS_GATE) & ~_ac, CONFIRM, "missing_circuit_breaker"),
    _z("public_input_packing_truncation_mismatch", 5.0, 4.0,
       _narrow.nonempty() & _nv & body.has(near(r"\.transfer\s*\(\s*", _narrow, r"\b|\.call\s*\{\s*value\s*:\s*", _narrow,
                                                r"\b|_mint\s*\([^,]+,\s*", _narrow, r"\b", i=True)), LEAD, "public-input-packing"),
    _z("settlement_count_not_bound_to_proof", 9.0, 4.0,
       (name.has(SETTLE_NAME) | body.has(SETTLE_BODY)) & _count.nonempty() & _bounds & _sized & ~_count_bound & ~_counts_required, LEAD,
       "settlement_boundary_mismatch"),
    _z("value_extracted_from_proofdata_unbound", 9.0, 4.0,
       _nv & body.has(VALUE_MOVE) & _got.nonempty() & _flows & ~body.has(HASH_BOUND), LEAD, "proof-to-value-binding"),
    _z("unanchored_merkle_root_in_verification", 9.0, 6.0,
       params.has(ROOT_PARAM) & body.has(r"\broot\b") & body.has(r"verif|publicinput|\bproof\b") & ~in_file(ROOT_ANCHOR) & ~body.has(STORES_ROOT),
       CONFIRM, "merkle_root_anchoring", once=True),
    _z("commit_prove_decoupling_unproven_root", 9.0, 5.0,
       in_file(COMMIT_WORD) & in_file(EXECUTE_WORD) & ~in_file(PROVEN_GATE) & in_file(VALUE_MOVE), LEAD, "merkle_root_anchoring", grain="file"),
    _z("public_input_missing_field_range_check", 6.0, 7.0, in_file(FIELD_CONST) & in_file(VERIFY_INPUTS) & ~in_file(FIELD_CHECK), CONFIRM,
       "field-overflow-malleability", grain="file"),
    _z("groth16_vk_degenerate_points", 10.0, 8.0, _same_points | _same_scalars, CONFIRM, "groth16_vk_misconfiguration", grain="file",
       fn="verifyingKey"),
    _z("groth16_vk_degenerate_points", 9.5, 6.0, _zero_point, CONFIRM, "groth16_vk_misconfiguration", grain="file", fn="verifyingKey"),
    _p("privacy_nullifier_marked_after_value_transfer", 9.0, 7.0, _psink & _late, "privacy_pool_nullifier_ordering", False),
    _p("privacy_nullifier_written_without_spent_check", 8.5, 6.0, _psink & _unspent, "privacy_pool_nullifier_replay", False),
    Rule("privacy_pool", "privacy_unknown_root_acceptance", 9.0, 6.0,
         _private & pnames.any(lambda p: p.has(r"^(root|merkleRoot|stateRoot)$")) & body.has(PROOF_WORD) & ~body.has(KNOWN_ROOT),
         bug="privacy_pool_root_anchoring", flags=("needs_stateful_poc",), target=~in_target(KNOWN_ROOT), once_fn=True),
    _p("privacy_public_inputs_do_not_bind_action_values", 8.5, 4.5, body.has(PROOF_WORD) & _psink & _unbound_critical,
       "privacy_pool_public_input_binding", True),
    _p("privacy_fee_unbounded_and_not_proof_bound", 8.0, 5.0,
       _pfee.nonempty() & _pamt.nonempty() & _psink & body.has(word(_pfee)) & ~_fee_bounded, "privacy_pool_fee_bounds", True),
]
TARGET_RULES = [
    Rule("zk_verifier", "circuit_soundness_out_of_scope_note", 2.0, 9.0, _is_zk & (_score >= 1), bug="circuit-soundness-out-of-scope",
         tier="out_of_scope", flags=("informational",), grain="target"),
]
