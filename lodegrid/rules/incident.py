"""Incident-class rules (hooks, cross-chain trust, packed hashes, ...) and the single-shape tier."""

from __future__ import annotations

from .dsl import Text, body, file_many, file_pred, file_text, fn_names, in_file, in_target, lname, name, named, near, params, pnames, some_fn, tail, word
from .model import CONFIRM, LEAD, Rule, callable_fn, header_ac, inline_auth, is_ext, is_internal, is_view, viewish

# ---- Fixed values: search patterns of this family -------------------------------------
HOOK_NAME = (
    r"^_*(beforeswap|afterswap|beforeinitialize|afterinitialize|beforeaddliquidity|"
    r"afteraddliquidity|beforeremoveliquidity|afterremoveliquidity|beforedonate|"
    r"afterdonate|lockacquired|unlockcallback|onflashloan|uniswapv3swapcallback|"
    r"uniswapv2call|pancakev3swapcallback|algebraswapcallback|hook|docallback)$"
    r"|callback$|hook$"
)
HOOK_SINK = (r"\.transferFrom\(|\.safeTransferFrom\(|\.transfer\(|\.safeTransfer\(|\.call\{|"
             r"_mint\(|_burn\(|\bsettle\(|\btake\(|\bsync\(")
CALLER_BIND = (
    r"msg\.sender\s*==|==\s*msg\.sender|only(Pool|PoolManager|Manager|Vault|Factory|"
    r"Pair|Router|Self|Hook|Lender)|_only(Pool|Manager|Vault|Factory)|isValidCaller|_checkCaller"
)
CALLBACK_NAME = r"callback$|lockacquired|unlockcallback|onflashloan"
PULLS_FROM = r"\.transferFrom\s*\(|\.safeTransferFrom\s*\("
PULL_PAYER = r"transferFrom\s*\(\s*(payer|sender|from|decoded\.\w+)"
PAYER_VERIFY = (
    r"require\([^)]*payer\s*==|require\([^)]*==\s*payer|"
    r"require\([^)]*sender\s*==\s*(tx\.origin|initiator|caller|_active\w*)|"
    r"payer\s*==\s*_active|==\s*_activePayer"
)
XCHAIN_PARAM = r"(source|src|remote|peer|origin|chain|domain|selector|eid|sender)"
XCHAIN_HANDLER = (
    r"_?(ccipreceive|lzreceive|nonblockinglzreceive|onmessage|receivemessage|"
    r"executemessage|handlemessage|processmessage|_handle|_execute)"
)
DECODE_SLOT = r"(\([^)]*\)|[A-Za-z_]\w*)\s*=\s*abi\.decode\s*\("
DECODED_CALL = r"([A-Za-z_]\w*)\s*\.\s*(?:functionCall|functionCallWithValue|call|delegatecall)\s*[({]"
INIT_NAME = r"^(initialize|init|__init|reinitialize|reinit|setup|configure)\w*$|_init$|_init_unchained$"
INIT_MODIFIER = r"\binitializer\b|\bonlyInitializing\b|\bonlyUninitialized\b|\breinitializer\s*\("
OWNER_SINK = (
    r"\b(owner|_owner|admin|_admin|governance|_governance|_governor)\s*=(?:[^=]|$)|"
    r"_transferOwnership\s*\(|_grantRole\s*\(|_setupRole\s*\(|_setRoleAdmin\s*\("
)
INIT_CHECK = (
    r"require\(\s*!?\s*(_?initialized|__initialized|_initializing|initialised|_setupDone|_init)\b|"
    r"require\(\s*(owner|_owner|admin|_admin)\s*==\s*address\(\s*0\s*\)|"
    r"require\([^)]*!+\s*_?initialized|require\([^)]*isInitialized\s*\(\s*\)\s*==\s*false|"
    r"if\s*\(\s*(_?initialized|__initialized)\b"
)
SELF_CALL = r"address\s*\(\s*this\s*\)\s*\.\s*(?:call|delegatecall)\s*(?:\{[^}]*\})?\s*\("
CALLER_BYTES = r"\b(data|payload|userCalldata|callData|_data|functionSignature|funcData|_calldata)\b"
BYTES_PARAM = r"\bbytes\s+(?:calldata\s+|memory\s+)?(\w+)"
SELECTOR_GUARD = (
    r"\bbytes4\s*\(|\.selector\b|msg\.sig\b|allowed(?:Selector|Sig|Function|Method)|"
    r"require\([^)]*sel(?:ector)?\b|funcSig|methodId|0x[0-9a-fA-F]{8}\b"
)
PACKED_HASH = r"(?:keccak256|sha256)\s*\(\s*abi\.encodePacked\s*\(((?:[^()]|\([^()]*\))*)\)\s*\)"
PACKED_SAFE = r"\.length\b|0xff"
REPLAY_SINK = (
    r"processed\s*\[|used\w*\s*\[|consumed\s*\[|isProcessed|isUsed|==\s*\w*[Hh]ash\b|"
    r"\b\w*[Hh]ash\s*==|messageHashes?\s*\["
)
RECOVER_SINK = r"\becrecover\s*\(|\.recover\s*\(|isValidSignature\s*\(|SignatureChecker"
AUTH_FLAVOR = r"verif|auth|valid|commit|root|leaf|signature|attest|claim|message"
DYNAMIC_PARAM = r"\b(?:bytes|string)\s+(?:calldata\s+|memory\s+|storage\s+)?([A-Za-z_]\w*)"
ARRAY_PARAM = r"\b[A-Za-z_]\w*\s*\[\s*\]\s+(?:calldata\s+|memory\s+|storage\s+)?([A-Za-z_]\w*)"
TRANSFER_HOOK = r"^(_transfer|_update|_aftertokentransfer|_beforetokentransfer)$"
SYNC_CALL = r"\.\s*(sync|skim)\s*\("
PAIR_REDUCE = r"_burn\(\s*\w*(pair|pool|lp|amm)\w*|(_balances|balanceOf)\b[^;\n]*\b(pair|pool|lp|amm)\w*"
PAIR_REDUCE_BROAD = (
    r"_transfer\s*\(\s*[A-Za-z0-9_]*(?:pair|pool|amm)[A-Za-z0-9_]*\s*,|"
    r"transferFrom\s*\(\s*[A-Za-z0-9_]*(?:pair|pool|amm)[A-Za-z0-9_]*\s*,|"
    r"_burn\s*\(\s*[A-Za-z0-9_]*(?:pair|pool|amm)[A-Za-z0-9_]*|"
    r"_balances\s*\[\s*[A-Za-z0-9_]*(?:pair|pool|amm)[A-Za-z0-9_]*\s*\]\s*-"
)
RECEIVER_CALL = r"\b(safeTransferFrom|safeMint|_safeMint|_safeTransfer)\s*\("
DEPOSIT_WRITE = (
    r"_mint\(|totalSupply\s*[+\-]?=|\w*[Bb]alance\w*\[[^\]]+\]\s*[+\-]?=|"
    r"shares\w*\s*[+\-]?=|deposits?\s*\[[^\]]+\]\s*[+\-]?="
)
RECEIVER_CREDIT = (
    r"_mint\(|deposits?\s*\[[^\]]+\]\s*[+\-]?=|\w*[Bb]alance\w*\[[^\]]+\]\s*[+\-]?=|credit\w*\s*\[[^\]]+\]\s*[+\-]?="
)
OWN_BALANCE = r"balanceOf\s*\(\s*address\s*\(\s*this\s*\)\s*\)"
OLD_PRAGMA = r"pragma\s+solidity\s+[^;]*0\.[0-7]\."
PRICE_NAME = r"price|cost|curve|quote|getamount"
RAW_ADD = (
    r"\b(price|amount|total|cost|fee|sum|result|value|payout|owed|tokens)\w*\s*=\s*"
    r"[^;=]*[\w.\)\]]\s*\+\s*[\w.\(]"
)
MEMORY_COPY = r"\b[A-Za-z_]\w*\s+memory\s+([A-Za-z_]\w*\s*=\s*[A-Za-z_]\w*)\s*\[[^\]]+\]\s*;"
PRIV_MAP_SET = (
    r"\b(?:is)?(?:signer|operator|admin|owner|authorized|authorizer|whitelist|allowlist|"
    r"keeper|minter|relayer|guardian)s?\b\s*\[\s*([^\]]+?)\s*\]\s*=\s*(?:true|1)\b"
)
PRIV_PUSH = r"\b(?:signer|owner|operator|admin|authoriz\w*)s?\b\s*\.\s*push\s*\(\s*([^)]*)"
GRANT_ROLE = r"\b_?(grantRole|_setupRole)\s*\("
RECOVER_ANY = r"\becrecover\s*\(|\.recover\s*\(|ECDSA\s*\.\s*(?:recover|tryRecover)"
LOCAL_DIGEST = r"keccak256\s*\(\s*abi\.encode"
VALUE_SEND = r"\{\s*value\s*:|depositTo\s*\(|sendValue\s*\("
SESSION_CTX = r"\.validUntil|\.validAfter|\.active\b|sessionKey|permission|\bsession\b"
SESSION_TARGET = r"\b(target|selector|dest|callTarget)\b"
SCOPE_CHECK = (
    r"require\s*\([^;]*(target|selector|dest|callTarget)\s*==|"
    r"(allowlist|whitelist|allowedTargets?|allowedSelectors?|permitted)\s*\[|require\s*\([^;]*value\s*<=?"
)
CEIL = r"mulDivRoundingUp|RoundingUp|Rounding\.Up|Rounding\.Ceil|ceilDiv|\+\s*\w+\s*-\s*1\s*\)\s*/"
CLMM_CTX = r"sqrtPrice|liquidity|\btick\b|getAmount0|getAmount1|position|nonfungible"
PLAIN_DIV = r"[\w.\)\]]\s*\*\s*[\w.\(]+\s*/\s*[\w.\(]"
CLMM_PAYOUT = r"withdraw|collect|burn|redeem|decreaseLiquidity|removeLiquidity"
CLMM_DEPOSIT = r"deposit|^mint|increaseLiquidity|addLiquidity|^_mint"
RECEIVER_NAME = r"^(_?lzReceive|_?ccipReceive|handle|_?nonblockingLzReceive|_?execute)$"
MESSAGE_ID = r"\b(guid|messageId|msgId|nonce|_guid|deliveryHash|sequence)\b"
FUND_EFFECT = r"(balanceOf|balances|_balances)\s*\[[^\]]*\]\s*\+=|_mint\s*\(|\.transfer\s*\(|safeTransfer"
PROCESSED = (r"\w+\s*\[[^\]]*\]\s*=\s*(true|1)\b|require\s*\(\s*!\s*\w+\s*\[|"
             r"processed|executed|consumed|usedNonces?|isProcessed|_seen")
RETRY_NAME = r"^(retry\w*|lzCompose|composeMsg|executeMessage|processRetry)$"
ORIGIN_PARAM = r"\b(srcEid|srcChainId|sourceChainSelector|sender|origin|nonce)\b"
ONLY_ENDPOINT = r"onlyEndpoint|onlyMailbox|onlyRouter|msg\.sender\s*==\s*(endpoint|mailbox|router)"
HASH_RECONCILE = r"==\s*\w*[Hh]ash|keccak256\s*\([^;]*==|storedHash|expectedHash"
AUTH_OR_FUND = r"require\s*\(|balances?\s*\[|_mint\s*\(|\.transfer\s*\("
CLAIM_NAME = r"^(claim|redeem|withdraw|collect|mint)\w*$"
VERIFY_HELPER = r"\b\w*[Vv]erify\w*\s*\(|\bcheckProof\s*\(|\b_?verifyProof\s*\(|MerkleProof\s*\.\s*verify"
CLAIM_ROOT = r"merkleRoot|\bmerkle\b|\broot\b|\bsigner\b|whitelistSigner"
CLAIM_MOVE = r"\.transfer\s*\(|safeTransfer\s*\(|_mint\s*\(|\.call\s*\{\s*value"
CONSUMED = (r"claimed|hasClaimed|isClaimed|nullifier|_setClaimed|used\s*\[|usedNonces?|nonce\s*\[|"
            r"bitmap|consumed|spent\s*\[|processed")
SWAP_CTX = (r"exactInput|exactOutput|swapExact|swapTokensFor|addLiquidity|removeLiquidity|"
            r"\brouter\b|IUniswap|ISwapRouter|IV3SwapRouter|PancakeRouter|\.swap\s*\(")
MINOUT_ZERO = (r"(amountOutMin(?:imum)?|minOut|minReceived|minReturn|minAmountOut|minShares|minAssets|minTokensOut)"
               r"\s*[:=]\s*0\b")
DEADLINE_BAD = (r"(deadline|expiry|validUntil)\s*[:=]\s*"
                r"(block\.timestamp|type\s*\(\s*uint256\s*\)\s*\.\s*max|~\s*uint256\s*\(\s*0\s*\))")
APPROVE_MAX = (r"(?:safeApprove|approve|forceApprove)\s*\(\s*([A-Za-z_]\w*)\s*,\s*"
               r"(?:type\s*\(\s*uint256\s*\)\s*\.\s*max|2\s*\*\*\s*256\s*-\s*1|~\s*uint256\s*\(\s*0\s*\)|uint256\s*\(\s*-\s*1\s*\))")
SETTER_HEAD = r"(?is)function\s+(?:set|update|change|configure|migrate)\w*[^{]*\{[^}]*\b"
CAP_DECL = r"\b((?:borrow|supply)Cap|debtCeiling|debtCap|supplyCap|borrowCap)\b"
BORROW_NAME = r"^(borrow|increaseDebt|_borrow|mintDebt|takeLoan)\w*$"
TOTAL_INC = (r"(totalBorrows?|totalDebt|totalSupplied|totalBorrowed|totalPrincipal)\b[^;\n]*\+=|"
             r"(totalBorrows?|totalDebt|totalSupplied)\b\s*=\s*[^;]*\+")
LIQUIDATE_NAME = r"liquidat|seize|closePosition|repayBadDebt|absorb"
UNDERWATER = (r"(collateral|coll|seized|seizeAmount)\s*<\s*(debt|owed|borrow|repay)|"
              r"(debt|owed|borrow)\s*>\s*(collateral|coll|seized)")
DEBT_ZERO = (r"(?:debt|borrows?|owed|principal)\w*(?:\s*\[[^\]]*\])?\s*=\s*0\b|"
             r"delete\s+\w*[Dd]ebt|delete\s+\w*[Bb]orrow")
DEFICIT_SINK = r"deficit|badDebt|reserve|writeDown|writeOff|socializ|shortfall"
HEALTH_NAME = r"health|solvenc|isLiquidatable|checkCollateral|accountLiquidity|isHealthy"
COLLATERAL_TERM = r"\bcollateral\b|\bcoll\b|collateralValue"
DEBT_TERM = r"\bdebt\b|\bborrow\w*\b|\bowed\b|required"
PUSH_NAME = r"^(bid|refund|settle|distribute|auction\w*|finalize|claim|payout|close\w*)$"
PUSH_SEND = (
    r"(?:payable\s*\(\s*)?(highestBidder|previousBidder|prevBidder|lastBidder|currentWinner|winner|beneficiary|recipient|prevOwner|lastOwner)"
    r"\s*\)?\s*\.\s*(transfer|send)\s*\(|"
    r"\b(highestBidder|previousBidder|prevBidder|lastBidder|currentWinner|winner|beneficiary|recipient)\b[^;]*\.call\s*\{\s*value"
)
PULL_CREDIT = r"pending\w*\s*\[|credits?\s*\[|claimable\s*\[|withdraw\w*\s*\[|balances?\s*\[[^\]]*\]\s*\+="
FT_LEDGER = r"\bbalanceOf\b|\b_balances\b"
NFT_LEDGER = r"\b_ownerOf\b|\b_owned\b|\b_ownedIndex\b|\bgetApproved\b|ownerOf\s*\("
UNIT_CONST = r"\bunit\b|unitsPerToken|\b_UNIT\b|\bunits\b|_WAD\b"
HYBRID_HINT = r"erc404|dn404|\b_owned\b|mirrorERC721|skipNFT"
NFT_SYNC = (r"_mintERC721|_burnERC721|_transferERC721|_retrieveOrMint|rebalance|_setOwned|"
            r"_pushOwned|_popOwned|_withdrawAndBurn|_ownerOf\s*\[")
UNIT_RECOMPUTE = r"/\s*_?unit|>>\s*|/\s*units|/\s*_UNIT"
BALANCE_MUTATE = r"(balanceOf|_balances)\s*\[[^\]]*\]\s*[-+]?=|_transferERC20"
HYBRID_NAME = r"^(_?transfer|transferFrom|_transferERC20|_update)$"
ACCRUAL_NAME = r"^(accrue\w*|_accrue\w*|_update|updateIndex|_updateIndex|touch)$"
INDEXED_STATE = r"borrowIndex|totalBorrows?|exchangeRate|interestIndex|supplyIndex|accrualTimestamp"
INDEXED_WRITE = r"(borrowIndex|totalBorrows?|exchangeRate|interestIndex|supplyIndex)\b[^;\n]*="
INDEX_MUTATOR = r"^(borrow|repay|redeem|mint|liquidat\w*|withdraw|deposit|supply|seize)\w*$"
TWAP_CTX = r"\.observe\s*\(|OracleLibrary|consult\s*\(|secondsAgo|\btwap\b|getQuoteAtTick"
WINDOW_CONST = r"(?:uint\d*\s+)?(?:constant|immutable)\s+([A-Za-z_]\w*)\s*=\s*0*(?:[0-9]|[1-5][0-9]|60)\b"
WINDOW_NAME = r"(interval|period|window|twap|secondsAgo)"
INLINE_ZERO_WINDOW = (r"secondsAgos?\s*\[\s*0\s*\]\s*=\s*0\b|\bperiod\s*=\s*0\b|\btwapWindow\s*=\s*0\b|"
                      r"\bwindow\s*=\s*0\b|\bsecondsAgo\s*=\s*0\b")
DIV_THEN_MUL = r"[\w.\)\]]\s*/\s*[\w.\[][\w.\(\)\[\]\s]*?\*\s*[\w.\(]"
VALUE_CTX = (r"reward|price|share|rate|amount|fee|mint|payout|assets?|debt|collateral|"
             r"interest|yield|weight|ratio|value|balance")
UPGRADEABLE = (r"\bInitializable\b|\bUUPSUpgradeable\b|[A-Za-z]\w*Upgradeable\b|"
               r"_authorizeUpgrade\s*\(|__\w+_init\s*\(|ERC1967")
INIT_MOD_ANY = r"\binitializer\b|\breinitializer\s*\("
INITIALIZE_FN = r"^(initialize|__\w+_init|reinitialize)\w*$"
DISABLE_INIT = r"_disableInitializers\s*\("
UPGRADEABLE_BASE = r"\bInitializable\b|[A-Za-z]\w*Upgradeable\b"
ABSTRACT_BASE = r"\babstract\s+contract\b"
STORAGE_GAP = r"__gap\b|_gap\b"
VISIBLE_STATE = (r"(?m)^\s*(?:uint\d*|int\d*|address|bool|bytes\d*|mapping\s*\(|string)\b[^;{}]*"
                 r"\b(?:public|private|internal)\b[^;{}]*;")
REWARD_RATE = r"rewardPerToken|rewardPerShare|earned|rewardIndex|_updateReward"
DIV_TOTAL = r"/\s*(_?total(?:Supply|Staked|Shares|Deposits))\b"
ZERO_TOTAL_GUARD = (
    r"(_?total(?:Supply|Staked|Shares|Deposits))\s*==\s*0|(_?total(?:Supply|Staked|Shares|Deposits))\s*(?:>|!=)\s*0|"
    r"require\s*\([^;]*(_?total(?:Supply|Staked|Shares|Deposits))\s*>\s*0"
)
SIG_OR_PREFIX = r"\becrecover\s*\(|\.recover\s*\(|isValidSignature\s*\(|\\x19\\x01"
DEADLINE_PARAM = r"\b(deadline|expiry|validUntil|validBefore|expiration)\b"
SIGNED_DEADLINE = r"abi\.encode\w*\s*\([^;]*\b(deadline|expiry|validUntil|expiration)\b"
EMERGENCY_NAME = r"^(emergency\w*|exit|forceWithdraw|panicWithdraw)$"
ZERO_STAKE = r"\.amount\s*=\s*0|delete\s+\w+\[|delete\s+user\b|\bamount\s*=\s*0\b"
STAKE_TRANSFER = r"\.transfer\s*\(|safeTransfer\s*\(|\.call\s*\{"
DEBT_RESET = r"rewardDebt\s*="
TOTAL_DECREMENT = (r"(totalStaked|totalSupply|totalDeposits|totalShares|totalAllocPoint)\s*-=|"
                   r"(totalStaked|totalSupply|totalDeposits|totalShares)\s*=\s*\w+\s*-")
NARROW_CAST = r"\b(u?int(?:128|120|112|104|96|88|80|72|64|56|48|40|32|24|16|8)\s*\(\s*[A-Za-z_]\w*)\s*\)"
CAST_FEEDS = (r"\+=|-=|\bpush\s*\(|_mint\s*\(|_burn\s*\(|\.transfer\s*\(|safeTransfer|\[[^\]]*\]\s*=|=\s*[^=]")
STRONG_ENTROPY = r"block\.prevrandao|block\.difficulty|blockhash\s*\(|block\.coinbase"
WEAK_ENTROPY = r"block\.timestamp|block\.number|gasleft\s*\("
ENTROPY_USE = r"keccak256\s*\(|sha256\s*\(|%\s*[\w(]"
# ---------------------------------------------------------------------------------------


_nonview = ~viewish
_hook = name.has(HOOK_NAME) & is_ext & ~is_view & body.has(HOOK_SINK) & ~tail.has(CALLER_BIND) & ~body.has(CALLER_BIND) & ~header_ac

_xparam = pnames.any(lambda p: p.has(XCHAIN_PARAM))
# map[key] == value where key and value are both parameters (value not a member access)
_dual = pnames.any(lambda k: pnames.any(lambda v: body.has(
    near(r"(?:require|if)\s*\(\s*[A-Za-z_]\w*\s*\[\s*", k, r"\s*\]\s*==\s*", v, r"(?:[^\w.]|$)"))))
_slots = body.all(DECODE_SLOT, 1, i=False)
_called = body.all(DECODED_CALL, 1, i=False)
_decoded_target = _called.any(
    lambda t: _slots.any(lambda s: s.has(near(r"\b", t, r"\s*(,|\)|$)")))
    & ~body.has(near(r"require\([^)]*\b", t, r"\b[^)]*(==|!=)"))
    & ~body.has(near(r"(allow|whitelist|trusted|isallowed|approved)\w*\s*\[\s*", t, i=True))
    & ~body.has(near(r"\b", t, r"\b\s*(==|!=)")))

_dyn = (params.all(DYNAMIC_PARAM, 1) + params.all(ARRAY_PARAM, 1)).distinct()
_collision = body.all(PACKED_HASH, 1).any(
    lambda args: ~args.has(PACKED_SAFE, i=False) & (_dyn.where(lambda n: args.has(word(n))).size() >= 2))

_named_hook = name.has(TRANSFER_HOOK)
_sync = body.has(SYNC_CALL)
_hook_burn = _nonview & _named_hook & _sync & body.has(PAIR_REDUCE)
_broad = _nonview & ~(_named_hook & _sync & body.has(PAIR_REDUCE)) & body.has(PAIR_REDUCE_BROAD)
_sync_any = _sync | body.has(r"_update\s*\(")

_deposit_cb = (name.has(r"(deposit|mint|stake|wrap|create|add)") & ~header_ac & ~tail.has("nonreentrant")
               & body.has(RECEIVER_CALL, i=False) & body.after(RECEIVER_CALL, i=False).has(DEPOSIT_WRITE)
               & ~body.before(RECEIVER_CALL, i=False).has(DEPOSIT_WRITE))

# "local = state" pairs of structs copied to memory
_copies = body.all(MEMORY_COPY, 1, i=False)
_lhs = lambda c: c.extract(r"^(\w+)", 1, i=False)
_rhs = lambda c: c.extract(r"(\w+)$", 1, i=False)
_lost_copy = ~is_view & _copies.any(
    lambda c: body.has(near(r"\b", _lhs(c), r"\s*\.\s*\w+\s*(=|\+=|-=|\*=|\|=)[^=]"))
    & ~body.has(near(r"", _rhs(c), r"\s*\[[^\]]+\]\s*=\s*", _lhs(c), r"\b")))

_influenced = lambda e: e.contains(Text("'msg.sender'", "'msg.sender'")) | pnames.any(lambda p: e.has(word(p)))
_self_add = (~header_ac & ~tail.has(r"\b(internal|private|view|pure)\b", i=False)
             & ~body.has(r"msg\.sender\s*==\s*\w*(owner|admin|governance)")
             & ((body.has(PRIV_MAP_SET) & _influenced(body.extract(PRIV_MAP_SET, 1)))
                | (body.has(PRIV_PUSH) & _influenced(body.extract(PRIV_PUSH, 1))) | body.has(GRANT_ROLE)))

_accrual = fn_names(lambda f: f.name.has(ACCRUAL_NAME) & f.body.has(INDEXED_STATE))
_mutator = lambda n, b: n.has(INDEX_MUTATOR) & b.has(INDEXED_WRITE) & ~n.has(ACCRUAL_NAME)
_reaches = lambda names, b, t: names.any(lambda a: b.has(near(r"\b", a, r"\s*\(")) | t.has(word(a)))

_digest = body.has(RECOVER_ANY, i=False) & body.has(LOCAL_DIGEST, i=False)
_upgradeable = in_file(UPGRADEABLE, i=False, raw=True) & in_file(INIT_MOD_ANY, i=False, raw=True)
_swap_bad = body.has(SWAP_CTX) & (body.has(MINOUT_ZERO) | body.has(DEADLINE_BAD))

_approved = file_text().all(APPROVE_MAX, 1).distinct()

_deadline = params.extract(DEADLINE_PARAM, 1)
_ts_check = lambda t: (t.has(near(r"block\.timestamp\s*(<=?|>=?)\s*[^;]*\b", _deadline, r"\b"))
                       | t.has(near(r"\b", _deadline, r"\b\s*(<=?|>=?)\s*[^;]*block\.timestamp"))
                       | t.has(near(r"require\s*\([^;]*\b", _deadline, r"\b[^;]*block\.timestamp")))
# The file-wide test is made per deadline word, once per file.
_ts_file = None
for _w in ("deadline", "expiry", "validUntil", "validBefore", "expiration"):
    _p = in_file(rf"block\.timestamp\s*(<=?|>=?)\s*[^;]*\b{_w}\b|\b{_w}\b\s*(<=?|>=?)\s*[^;]*block\.timestamp|"
                 rf"require\s*\([^;]*\b{_w}\b[^;]*block\.timestamp", i=False) & _deadline.eq(_w)
    _ts_file = _p if _ts_file is None else _ts_file | _p

_emergency = name.has(EMERGENCY_NAME) & body.has(ZERO_STAKE) & body.has(STAKE_TRANSFER)

# "uintN(var" of every narrowing cast of a bare identifier; below, the first unbounded one of each variable
_casts = body.all(NARROW_CAST, 1, i=False).distinct()
_cast_var = lambda c: c.extract(r"(\w+)$", 1, i=False)
_cast_type = lambda c: c.extract(r"^(\w+)", 1, i=False)
_unbounded = lambda c: (~_cast_var(c).has(r"^(max|min)$", i=False)
                        & ~body.has(near(r"require\s*\([^;]*\b", _cast_var(c), r"\b[^;]*(<=?|<)\s*(type\s*\(\s*", _cast_type(c), r"|2\s*\*\*|0x)"))
                        & ~body.has(near(r"\b", _cast_var(c), r"\b\s*&")) & ~body.has(near(r"&[^;]*\b", _cast_var(c), r"\b"))
                        & ~body.has(r"\bSafeCast\b|\btoUint\d", i=False))
_from_param = lambda c: named.any(lambda p: _cast_var(c).eq(p))
_loose_casts = _casts.where(_unbounded).first_by(_cast_var)
_feeds = body.has(CAST_FEEDS, i=False)
_strong = body.has(STRONG_ENTROPY, i=False)
_hybrid = (in_file(FT_LEDGER, i=False, raw=True) & in_file(NFT_LEDGER, i=False, raw=True)
           & (in_file(UNIT_CONST, raw=True) | in_file(HYBRID_HINT, raw=True)))
# A line that declares immutable state: no constant on it, no call parenthesis just in front of the word.
_immutable_state = file_pred(file_text(raw=True).all(r"[^\n]+", 0).any(
    lambda ln: ln.has(r"\bimmutable\b", i=False) & ~ln.has("constant", i=False) & ~ln.before("immutable", i=False).has(r"\([^(]{0,39}$", i=False)))

RULES = [
    Rule("hook_callback_auth", "hook_callback_missing_caller_auth", 9.0, 7.0, _hook, bug="hook_callback_access_control", tier=CONFIRM),
    Rule("hook_callback_auth", "callback_payer_from_calldata_no_verify", 8.0, 5.0,
         name.has(CALLBACK_NAME) & body.has(PULLS_FROM) & ~is_view & body.has(PULL_PAYER) & ~body.has(PAYER_VERIFY),
         bug="hook_callback_access_control", tier=LEAD),
    Rule("cross_chain_trust", "xchain_dual_param_auth_bypass", 9.0, 8.0, callable_fn & ~header_ac & _xparam & _dual,
         bug="cross-chain-message-trust", tier=CONFIRM),
    Rule("cross_chain_trust", "xchain_handler_executes_decoded_target", 9.0, 8.0, name.has(XCHAIN_HANDLER) & _decoded_target,
         bug="cross-chain-message-trust", tier=CONFIRM),
    Rule("unprotected_initializer", "unprotected_initializer_privilege_write", 9.0, 8.0,
         name.has(INIT_NAME) & is_ext & ~tail.has(INIT_MODIFIER) & ~header_ac & body.has(OWNER_SINK) & ~body.has(INIT_CHECK),
         bug="initializer-auth", tier=CONFIRM),
    Rule("self_call_auth_bypass", "self_call_unfiltered_calldata", 8.0, 8.0,
         body.has(SELF_CALL) & (body.has(CALLER_BYTES) | params.has(BYTES_PARAM)) & ~body.has(SELECTOR_GUARD),
         bug="self-call-auth-bypass", tier=CONFIRM),
    Rule("encodepacked_collision", "encodepacked_collision_replay_key", 8.5, 8.0, _collision & body.has(REPLAY_SINK),
         bug="encodepacked_hash_collision", tier=CONFIRM),
    Rule("encodepacked_collision", "encodepacked_collision_ecrecover_signature", 9.0, 7.5,
         _collision & ~body.has(REPLAY_SINK) & body.has(RECOVER_SINK), bug="encodepacked_hash_collision", tier=CONFIRM),
    Rule("encodepacked_collision", "encodepacked_collision_dynamic_unbound_auth", 7.0, 4.5,
         _collision & ~body.has(REPLAY_SINK) & ~body.has(RECOVER_SINK) & (body + " " + name).has(AUTH_FLAVOR)
         & body.has(r"==|\breturn\b", i=False), bug="encodepacked_hash_collision", tier=LEAD),
    Rule("hook_pair_burn_sync", "hook_burns_pair_then_sync", 8.0, 8.0, _hook_burn,
         bug="amm_reserve_manipulation_via_transfer_hook", tier=CONFIRM),
    Rule("hook_pair_burn_sync", "moves_pair_balance_then_sync", 9.0, 7.0, _broad & _sync_any,
         bug="amm_reserve_manipulation_pair_balance", tier=CONFIRM, ultra=True),
    Rule("hook_pair_burn_sync", "reduces_pair_balance_without_sync", 9.0, 7.0, _broad & ~_sync_any,
         bug="amm_reserve_desync_burn_before_sync", tier=CONFIRM, ultra=True),
    Rule("deposit_callback_cei", "deposit_receiver_callback_before_state_write", 9.0, 7.0, _deposit_cb,
         bug="reentrancy_receiver_callback_cei", tier=CONFIRM),
    Rule("receiver_hook_credit", "received_hook_credits_without_guard", 8.0, 6.0,
         name.has(r"on(ERC721|ERC3525|ERC1155)Received") & ~header_ac & ~tail.has("nonreentrant") & body.has(RECEIVER_CREDIT),
         bug="reentrancy_receiver_callback_credit", tier=CONFIRM),
    Rule("fot_swap_bounds", "fot_swap_credits_premeasured_amount", 7.0, 5.0,
         (name + body).has("SupportingFeeOnTransferTokens") & (body.all("(" + OWN_BALANCE + ")", 1).size() < 2),
         bug="fee_on_transfer_accounting", tier=LEAD),
    Rule("asymmetric_safemath", "asymmetric_safemath_price_add", 9.0, 7.0,
         lname.has(PRICE_NAME, i=False) & body.has(r"\.\s*mul\s*\(", i=False) & body.has(RAW_ADD), bug="arithmetic_overflow",
         tier=CONFIRM, target=in_target(OLD_PRAGMA, i=False)),
    Rule("memory_struct_persistence", "storage_struct_loaded_as_memory", 7.0, 8.0, _lost_copy, bug="storage_persistence", tier=CONFIRM),
    Rule("signer_allowlist", "signer_allowlist_self_add_no_auth", 9.0, 8.0, _self_add, bug="access_control", tier=CONFIRM),
    Rule("paymaster_userop_binding", "~paymaster_userop_binding", 9.0, 6.0,
         name.isin("validatePaymasterUserOp") & _digest & ~body.has(r"\bcallData\b", i=False), bug="paymaster_userop_binding",
         flags=("unprivileged",)),
    Rule("userop_chainid_replay", "~userop_chainid_replay", 8.0, 5.0,
         name.isin("validateUserOp") & _digest & ~body.has(r"recover\s*\(\s*userOpHash|block\.chainid", i=False), bug="userop_chainid_replay"),
    Rule("validateuserop_missing_prefund", "~validateuserop_missing_prefund", 5.5, 4.5,
         name.isin("validateUserOp") & params.has("missingAccountFunds", i=False) & ~body.has(VALUE_SEND), bug="validateuserop_missing_prefund"),
    Rule("session_key_unscoped", "~session_key_unscoped", 7.0, 3.5,
         body.has(SESSION_CTX) & body.has(r"abi\.decode") & body.has(SESSION_TARGET) & ~body.has(SCOPE_CHECK), bug="session_key_unscoped"),
    Rule("clmm_rounding_asymmetry", "~clmm_rounding_asymmetry", 7.0, 3.5,
         name.has(CLMM_PAYOUT) & body.has(CEIL, i=False) & in_file(CLMM_CTX, raw=True) & file_pred(some_fn(
             lambda f: f.name.has(CLMM_DEPOSIT) & f.body.has(PLAIN_DIV, i=False) & ~f.body.has(CEIL, i=False))),
         bug="clmm_rounding_asymmetry"),
    Rule("interest_accrual_asymmetry", "~interest_accrual_asymmetry", 7.0, 4.5,
         _mutator(name, body) & ~_reaches(file_many(_accrual), body, tail)
         & file_pred(some_fn(lambda f: _mutator(f.name, f.body) & _reaches(_accrual, f.body, f.tail))),
         bug="interest_accrual_asymmetry"),
    Rule("message_replay_no_nonce", "~message_replay_no_nonce", 8.0, 4.0,
         name.has(RECEIVER_NAME) & (params.has(MESSAGE_ID) | body.has(MESSAGE_ID)) & body.has(FUND_EFFECT) & ~body.has(PROCESSED),
         bug="message_replay_no_nonce"),
    Rule("retry_domain_binding", "~retry_domain_binding", 8.0, 4.0,
         name.has(RETRY_NAME) & params.has(ORIGIN_PARAM) & body.has(AUTH_OR_FUND) & ~tail.has(ONLY_ENDPOINT)
         & ~body.has(ONLY_ENDPOINT) & ~body.has(HASH_RECONCILE), bug="retry_domain_binding"),
    Rule("claim_replay_no_marker", "~claim_replay_no_marker", 8.5, 4.0,
         in_file(CLAIM_ROOT, raw=True) & name.has(CLAIM_NAME) & is_ext & ~is_view & body.has(VERIFY_HELPER, i=False)
         & body.has(CLAIM_MOVE) & ~body.has(CONSUMED), bug="claim_replay_no_marker"),
    Rule("swap_missing_slippage_deadline", "~missing_slippage_deadline", 7.0, 5.0, _swap_bad, bug="missing_slippage_deadline"),
    Rule("max_approve_mutable_spender", "~max_approve_mutable_spender", 8.0, 5.0, in_file(APPROVE_MAX), bug="max_approve_mutable_spender",
         grain="file", each=_approved.where(lambda s: ~s.isin("address", "type") & file_text().has(near(SETTER_HEAD, s, r"\s*=")))),
    Rule("borrow_cap_not_enforced", "~borrow_cap_not_enforced", 7.0, 5.0,
         in_file(CAP_DECL, i=False, raw=True) & name.has(BORROW_NAME) & body.has(TOTAL_INC) & ~body.has(CAP_DECL, i=False),
         bug="borrow_cap_not_enforced"),
    Rule("bad_debt_no_socialization", "~bad_debt_no_socialization", 7.0, 4.0,
         ~in_file(DEFICIT_SINK, raw=True) & name.has(LIQUIDATE_NAME) & body.has(UNDERWATER) & body.has(DEBT_ZERO),
         bug="bad_debt_no_socialization"),
    Rule("health_factor_rounding", "~health_factor_rounding", 6.0, 3.5,
         name.has(HEALTH_NAME) & body.has(COLLATERAL_TERM) & body.has(DEBT_TERM) & body.has(CEIL, i=False) & body.has(">="),
         bug="health_factor_rounding"),
    Rule("push_payment_dos", "~push_payment_dos", 7.0, 4.0, name.has(PUSH_NAME) & body.has(PUSH_SEND) & ~body.has(PULL_CREDIT),
         bug="push_payment_dos"),
    Rule("erc404_ledger_desync", "~erc404_ledger_desync", 8.0, 5.0,
         _hybrid & name.has(HYBRID_NAME) & body.has(BALANCE_MUTATE, i=False) & ~body.has(NFT_SYNC) & ~body.has(UNIT_RECOMPUTE),
         bug="erc404_ledger_desync"),
    Rule("twap_zero_window", "~twap_zero_window", 7.0, 4.5,
         in_file(TWAP_CTX) & (in_file(INLINE_ZERO_WINDOW) | file_pred(file_text().all(WINDOW_CONST, 1, i=False).any(
             lambda n: n.has(WINDOW_NAME) | file_text().has(near(r"secondsAgo\w*\s*(?:\[[^\]]*\])?\s*=\s*", n))))),
         bug="twap_zero_window", grain="file"),
    Rule("divide_before_multiply", "~divide_before_multiply", 7.0, 4.0,
         body.has(DIV_THEN_MUL, i=False) & (name.has(VALUE_CTX) | body.has(VALUE_CTX)), bug="divide_before_multiply"),
    Rule("divide_before_multiply", "~divide_before_multiply_plain", 5.5, 4.0,
         body.has(DIV_THEN_MUL, i=False) & ~(name.has(VALUE_CTX) | body.has(VALUE_CTX)), bug="divide_before_multiply"),
    Rule("uninitialized_implementation", "~uninitialized_implementation", 9.0, 6.0,
         _upgradeable & ~in_file(DISABLE_INIT, i=False, raw=True) & (tail.has(INIT_MOD_ANY, i=False) | name.has(INITIALIZE_FN)),
         bug="uninitialized_implementation", flags=("unprivileged",), once=True),
    Rule("constructor_state_in_proxy_impl", "~constructor_state_in_proxy_impl", 7.0, 5.0,
         _upgradeable & _immutable_state & (tail.has(INIT_MOD_ANY, i=False) | name.has(INITIALIZE_FN)),
         bug="constructor_state_in_proxy_impl", once=True),
    Rule("missing_storage_gap", "~missing_storage_gap", 6.0, 4.0,
         in_file(ABSTRACT_BASE, i=False, raw=True) & in_file(UPGRADEABLE_BASE, i=False, raw=True)
         & ~in_file(STORAGE_GAP, i=False, raw=True) & in_file(VISIBLE_STATE, i=False, raw=True), bug="missing_storage_gap", grain="file"),
    Rule("reward_per_token_zero_supply", "~reward_per_token_zero_supply", 7.0, 4.0,
         (name.has(REWARD_RATE) | body.has(REWARD_RATE)) & body.has(DIV_TOTAL) & ~body.has(ZERO_TOTAL_GUARD), bug="reward_per_token_zero_supply"),
    Rule("permit_missing_deadline", "~permit_missing_deadline", 7.0, 3.5,
         body.has(SIG_OR_PREFIX, i=False) & params.has(DEADLINE_PARAM) & (body.has(SIGNED_DEADLINE) | in_file(SIGNED_DEADLINE))
         & ~_ts_check(body) & ~_ts_check(tail) & ~_ts_file, bug="permit_missing_deadline"),
    Rule("emergency_withdraw_stale_debt", "~emergency_withdraw_stale_debt", 6.5, 4.5,
         _emergency & (~body.has(DEBT_RESET) | ~body.has(TOTAL_DECREMENT)), bug="emergency_withdraw_stale_debt"),
    Rule("unsafe_downcast", "~unsafe_downcast_param", 7.0, 4.5, _feeds & body.has(NARROW_CAST, i=False), bug="unsafe_downcast",
         each=_loose_casts.where(_from_param)),
    Rule("unsafe_downcast", "~unsafe_downcast_param_idle", 5.0, 4.5, ~_feeds & body.has(NARROW_CAST, i=False), bug="unsafe_downcast",
         each=_loose_casts.where(_from_param)),
    Rule("unsafe_downcast", "~unsafe_downcast_local", 5.0, 3.5, body.has(NARROW_CAST, i=False), bug="unsafe_downcast",
         each=_loose_casts.where(lambda c: ~_from_param(c))),
    Rule("weak_randomness", "~weak_randomness", 7.0, 4.5, _strong | (body.has(WEAK_ENTROPY, i=False) & body.has(ENTROPY_USE, i=False)),
         bug="weak_randomness"),
]
