"""Ultra tiers: the wider structural rules and the corpus-mined shapes."""

from __future__ import annotations

from .dsl import body, count_true, file_many, file_pred, file_text, fn_names, in_file, in_target, lname, ltail, name, near, params, pnames, some_fn, tail, word
from .model import CONFIRM, WIDE_LOCK_HEAD, Rule, is_ext, is_view

# ---- Fixed values: search patterns of this family -------------------------------------
ECRECOVER = r"\becrecover\s*\("
ECDSA_LIB = r"ECDSA\s*\.\s*(recover|tryRecover)"
ECRECOVER_GUARD = (r"!=\s*address\s*\(\s*0\s*\)|address\s*\(\s*0\s*\)\s*!=|==\s*address\s*\(\s*0\s*\)|"
                   r"require\s*\([^;)]*\b\w+\b\s*!=\s*0\b")
ECRECOVER_AUTH = r"ecrecover\s*\([^;]*\)\s*==|==\s*ecrecover|require\s*\([^;]*ecrecover|=\s*ecrecover"
SIG_MAGIC = r"0x1626ba7e|0x20c13b0b"
SIGNER_OK = (r"isOwner\s*\[|owners\s*\[|isSigner\s*\[|_?signers?\s*\[|trustedSigner|allowlist|"
             r"whitelist|==\s*(?:owner|admin|trustedSigner|expectedSigner)\b|hasRole\s*\(")
PULL_FROM_NAME = r"(?:safeTransferFrom|transferFrom)\s*\(\s*([A-Za-z_]\w*)\s*,"
RECV_NAME = r"(?:_?lzReceive|nonblockingLzReceive|_?ccipReceive)\b"
RECV_CALLER = (r"msg\.sender\s*==\s*(?:address\s*\(\s*)?\w*endpoint|onlyEndpoint|"
               r"require\s*\([^;]*\bendpoint\b|msg\.sender\s*==\s*\w*router")
RECV_PEER = (r"trustedRemote|peers?\s*\[|_?getPeerOrRevert|allowlistedSourceChains?\s*\[|"
             r"allowlistedSenders?\s*\[|sourceChainSelector|_assertPeer")
SHARE_FN = r"(deposit|mint|convertToShares|previewDeposit|issue)"
OWN_BALANCE = r"balanceOf\s*\(\s*address\s*\(\s*this\s*\)\s*\)"
VAULT_OFFSET = (r"decimalsOffset|_decimalsOffset|virtual\w*[Ss]hare|MINIMUM_LIQUIDITY|"
                r"_mint\s*\(\s*address\s*\(\s*0|_mint\s*\(\s*0x[dD][eE][aA][dD]|deadShares|10\s*\*\*\s*_?\w*[Oo]ffset")
VAULT_INTERNAL = r"_totalAssets\b|storedAssets|internalBalance|totalManagedAssets|_cash\b|_reserve\b|internalCash"
CTX_2771 = r"ERC2771Context|isTrustedForwarder|trustedForwarder|msg\.data\s*\[\s*msg\.data\.length\s*-\s*20"
SELF_DELEGATE = r"address\s*\(\s*this\s*\)\s*\.\s*delegatecall|delegatecall\s*\(\s*\w*data\s*\["
REINIT_NAME = r"initialize|reinitialize|__\w+_init|migrate|setup"
REINIT_GUARD = r"\binitializer\b|reinitializer|_disableInitializers|onlyOwner|onlyProxy|require\s*\([^;]*initiali"
WIRES_IMPL = r"(implementation|_?logic|impl)\w*\s*=\s*\w|_setImplementation|delegatecall|sstore\s*\(\s*_?IMPLEMENTATION"
LOOP = r"\bfor\s*\(|\bwhile\s*\("
SELF_BATCH = r"address\s*\(\s*this\s*\)\s*\.\s*delegatecall|delegatecall\s*\(\s*\w*\s*\["
INT_PARAM = r"\bint\d*\s+(\w+)"
BARE_ARRAY = r"\[\s*\]\s*(?:memory|calldata|storage)?\s*(\w+)"
LENGTH_CHECK = r"\.length\s*==|==\s*\w+\.length|require\s*\([^;]*\.length"
LIQ_FN = r"liquidat|close|settle|cancelorder|fillorder|repay"
POSITION_OUT = (r"(safeTransfer|transfer|sendValue)\w*\s*\([^;]*\b"
                r"(inputAmount|collateral|principal|position|deposited|debt)\w*")
POSITION_CLEARED = (r"\b(inputAmount|collateral|principal|position|deposited|debt)\w*\s*(=\s*0\b|-=)"
                    r"|delete\s+\w*(inputAmount|collateral|principal|position)")
SWAP_NAME = r"swap|trade|exchange|zap|addLiquidity|removeLiquidity|mint|redeem|withdraw|deposit"
SWAP_CALL = (r"exactInput|exactOutput|swapExact|swapFor|swapTokens|addLiquidity|removeLiquidity|"
             r"getAmountsOut|amountOut|amountIn|router\s*\.")
SLIPPAGE_GUARD = (r"min(?:imum)?(?:Amount)?Out|minOut|amountOutMin|minReceived|minReturn|slippage|maxSlippage|minShares|minAssets")
SWAP_DEADLINE = r"deadline|expiry|expire|block\.timestamp\s*[<>=]"
FEED = r"latestRoundData\s*\(|latestAnswer\s*\("
FEED_FRESH = r"updatedAt|answeredInRound|roundId|heartbeat|stale|timeout|maxDelay|block\.timestamp\s*-\s*\w+"
LENGTH_LOOP = r"\bfor\s*\([^;]*;[^;]*<\s*([A-Za-z_][\w.]*)\.length"
LOOP_EFFECT = (r"\.call\s*[({]|\.delegatecall\s*\(|\.transfer\s*\(|safeTransfer\s*\(|"
               r"safeTransferFrom\s*\(|transferFrom\s*\(|delete\b|push\s*\(|\w+\s*(?:\[[^\]]+\])?\s*[+\-*/]?=")
LOOP_CAP = r"limit|max|count|end|cursor|offset|batch|length\s*<="
BARE_CALL = r"\.call\s*(?:\{[^}]*\})?\s*\([^;]*\)\s*;"
CALL_RESULT = r"\(bool\s+\w+|bool\s+\w+\s*=|require\s*\([^;]*(success|ok)|if\s*\([^;]*(success|ok)"
SIG_RECOVER = r"ecrecover\s*\(|ECDSA\.recover\s*\(|\.recover\s*\("
SIG_NONCE = r"nonce|nonces|usedSignatures|executed|consumed|processed"
SIG_DOMAIN = r"chainid|block\.chainid|DOMAIN_SEPARATOR|address\s*\(\s*this\s*\)"
SIG_EXPIRY = r"deadline|expiry|expires|validUntil|block\.timestamp\s*<="
PRIV_SETTER = (r"set(?:Owner|Admin|Guardian|Keeper|Operator|Manager|Treasury|Router|Oracle|"
               r"Verifier|Implementation|Minter)|transferOwnership|changeAdmin")
ADDRESS_PARAM = r"\baddress\s+(?:calldata\s+|memory\s+)?([A-Za-z_]\w*)"
ZERO_CHECK = r"address\s*\(\s*0\s*\)|!=\s*0x0|InvalidAddress|ZeroAddress"
VALUE_MATH_NAME = r"price|value|amount|share|asset|rate|reward|fee|collateral|liquidat|quote"
DIV_ASSIGN = r"([A-Za-z_]\w*)\s*=\s*[^;]+/\s*[^;]+;"
THEN_ASSIGN = r"\s*=\s*[^;]+/\s*[^;]+;\s*(?:uint\d*\s+)?[A-Za-z_]\w*\s*=\s*"
MULDIV_SAFE = r"mulDiv|FullMath|PRBMath|FixedPointMathLib|Math\.mulDiv"
PROOF_SURFACE = r"verifyProof|verifier\s*\.\s*verify|Groth16|Plonk|SNARK|proofData|publicInputs?"
COUNT_NAME = r"(num|n|count|real|tx|op|item|batch|limit|len)"
TYPED_ARRAY = r"(?:[A-Za-z_]\w*(?:\d+)?|bytes|string)\s*\[\s*\]\s*(?:calldata|memory|storage)?\s*([A-Za-z_]\w*)"
BRIDGE_WORD = r"(retry|relay|execute|receive|process|message|packet|bridge)"
PROCESSED_KEY = r"(processed|used|consumed|replayed|executed)\w*\s*\["
HASH_ARGS = r"keccak256\s*\(\s*abi\.encode(?:Packed)?\s*\(((?:[^()]|\([^()]*\))*)\)\s*\)"
DOMAIN_ANCHOR = (r"block\.chainid|address\s*\(\s*this\s*\)|source|src|origin|fromChain|toChain|"
                 r"dst|dest|domain|eid|chainSelector|sender|peer|remote|nonce|sequence|packetId|messageId")
ORACLE_PRICE = r"oracle|latestAnswer|latestRoundData|getPrice|priceOf|assetPrice|answer"
FIXED_SCALE = r"\b(1e18|1e8|10\s*\*\*\s*18|10\s*\*\*\s*8|1_000_000_000_000_000_000)\b"
VALUE_MATH = r"\*|/|mulDiv|wmul|wdiv"
SCALE_AWARE = r"\bdecimals\s*\(|10\s*\*\*\s*\w*decimals|scaleDecimals|normalize"
ZERO_GUARD = r"(require|if)\s*\([^;{]*(amount|amt|value|qty)\w*\s*(>\s*0|!=\s*0)|0\s*<\s*(amount|amt|value|qty)\w*"
ZERO_SINK = r"_mint\s*\(|claimed\s*\[|unlocked\s*\[|isPaid\s*\[|eligible\s*\[|reward|bonus|airdrop|withdraw"
HOOK_TRANSFER = (r"beforeLdaTransfer|beforeTokenTransfer|_beforeTokenTransfer|afterTokenTransfer|"
                 r"_afterTokenTransfer|onERC1155Received|onERC1155BatchReceived|transferHook")
SETTLE_CALL = r"\b(_settle\w*|settle\w*|_checkpoint\w*|checkpoint\w*|_record\w*)\s*\("
RECORD_APPEND = (r"(_NUM_\w*RECORD\w*|\w*RecordCount|\w*CheckpointCount|\w*Index|\w*Nonce)\w*"
                 r"\s*(?:=|\+=|\+\+)|\.push\s*\(|\[\s*\w+\s*\]\s*=\s*\w*Record\s*\(")
REWARD_RECORD = (r"(_UCR_|_UCE_|_TCR_|\w*Reward\w*|\w*Claim\w*|\w*Royal\w*|\w*Cumulative\w*|\w*Checkpoint\w*|\w*Record\w*)")
HOOK_ZERO_GUARD = (r"(amount|amt|qty|quantity)\w*\s*>\s*0|(amount|amt|qty|quantity)\w*\s*!=\s*0|"
                   r"0\s*<\s*(amount|amt|qty|quantity)\w*|from\s*!=\s*to|to\s*!=\s*from")
CHECKPOINT_NOOP = (r"return\s*;|last\w*\.(?:depositId|balance|ldaBalance|value)\s*==|"
                   r"==\s*last\w*\.(?:depositId|balance|ldaBalance|value)|new\w*Value\s*==\s*last\w*\.value|"
                   r"lastDepositId\s*==\s*lastSettledDepositId")
COMPONENT_WORD = r"components|assets|tokens|underlyings|legs|constituents"
BALANCE_SHARE = (r"balanceOf\s*\(\s*address\s*\(\s*this\s*\)\s*\)[^;]*(?:shares|share|amount|supply|totalSupply)"
                 r"|(?:shares|share|amount)[^;]*balanceOf\s*\(\s*address\s*\(\s*this\s*\)\s*\)")
BURN_OR_DEBIT = r"_burn\s*\(|burn\s*\(|shares?\s*\[[^\]]+\]\s*-|balanceOf\s*\[[^\]]+\]\s*-"
BRIDGE_CONFIG = r"LayerZero|DVN|verifier|validator|oracle|relayer|threshold|signature|multisig"
ONE_OF_ONE = (r"(required\w*|threshold|min\w*|quorum|confirmations?|signatures?)\s*=\s*1\b|"
              r"(required\w*|threshold|min\w*|quorum|confirmations?|signatures?)\s*:\s*1\b|"
              r"new\s+address\s*\[\s*\]\s*\(\s*1\s*\)")
CALLDATA_PARAM = r"\bbytes\s+(?:calldata|memory)?\s*([A-Za-z_]\w*)"
TARGET_PARAM = r"\baddress\s+(?:payable\s+)?([A-Za-z_]\w*)"
LOW_CALL = r"\.call\s*(?:\{[^}]*\})?\s*\("
TARGET_ALLOWLIST = r"allowlist|whitelist|approvedTargets|trustedTargets|isAllowed|selector|bytes4|msg\.sig"
HOOK_TOKEN = r"ERC777|IERC777|tokensToSend|tokensReceived|ERC1820|operatorSend|safeTransferFrom|transferFrom"
DEPOSIT_LIKE = r"(deposit|supply|mint|collateral|repay|join|stake)"
TRANSFER_IN = r"(?:safeTransferFrom|transferFrom)\s*\("
BOOKKEEP = (r"\b(accountTokens|balances?|deposits?|shares?|collateral|credits?|principal|"
            r"userInfo|supplied|staked)\w*\s*(?:\[[^\]]+\]\s*)?(?:\.\w+\s*)?(?:=|\+=|-=)")
REENTRANCY_LOCK = r"nonReentrant|reentrancyGuard|_status|locked"
LIVE_RESERVE = (r"getReserves\s*\(|price_oracle\s*\(|get_virtual_price\s*\(|virtualPrice\s*\(|"
                r"exchangeRateCurrent\s*\(|balanceOf\s*\(\s*address\s*\(\s*this\s*\)\s*\)|totalSupply\s*\(")
VALUATION = r"(price|value|rate|exchange|collateral|liquidat|preview|quote|oracle)"
READ_LOCK = r"nonReentrantView|reentrantLock|readLock|lockRead|sync\s*\("
CACHE_OR_TWAP = r"last\w*Price|cached|TWAP|observe\s*\(|cumulative|block\.timestamp\s*-"
KEEPER_SURFACE = (r"keeper|validator|consensus|committee|epoch|pubkey|publicKey|bookKeeper|"
                  r"EthCrossChainData|putCurEpochConPubKeyBytes")
BRIDGE_EXEC = r"(execute|relay|process|verify|crossChain|message|payload)"
DECODED_TARGET = (r"abi\.decode[\s\S]{0,420}(target|to|contractAddr|addr|method|selector|data)|"
                  r"\b(target|to|contractAddr|addr)\s*\.\s*call\s*\(")
SELECTOR_ALLOWLIST = (r"allowlist|whitelist|trustedTargets|allowedSelectors?|onlyCrossChainManager|"
                      r"require\s*\([^;]*(target|to|selector|method)[^;]*(==|allowed|trusted)")
ROOT_STATE = r"(committedRoot|confirmAt|acceptableRoot|knownRoot|rootStatus|messages|roots)"
ROOT_SET = r"(confirmAt|acceptableRoot|knownRoot|rootStatus|messages|roots)\w*\s*\[[^\]]+\]\s*=\s*(?:true|1)"
ROOT_GATE = (r"(require|if)\s*\([^;{]*(confirmAt|acceptableRoot|knownRoot|rootStatus|messages|roots)\w*"
             r"\s*\[[^\]]+\][^;{]*(?:!=\s*0|==\s*true|>\s*0|\))")
ROOT_REJECT = (r"(root|messageHash|leaf|_committedRoot)\w*\s*!=\s*(?:bytes32\s*\(\s*0\s*\)|0x0+\b|0\b)"
               r"|require\s*\([^;]*(root|messageHash|leaf|_committedRoot)\w*[^;]*!=[^;]*(0|bytes32)")
VERIFIER_PARAM = r"\baddress\s+(?:payable\s+)?(\w*(?:verifier|validator|sysvar|precompile|core|bridge)\w*)"
VERIFY_WORD = r"verify|signature|vaa|proof|guardian|sysvar"
VERIFIER_PIN = (r"trustedVerifier|verifiers?\s*\[|allowedVerifier|codehash|extcodehash|"
                r"==\s*(?:WORMHOLE|CORE|VERIFIER|trusted|immutable|address\s*\(\s*verifier)")
VYPER_BAD = r"#\s*@version\s+(0\.2\.15|0\.2\.16|0\.3\.0)\b"
VYPER_LOCK = r"@nonreentrant(?:\s*\(|\b)"
SPOT_SOURCE = (r"getReserves\s*\(|slot0\s*\(|getAmountsOut\s*\(|getAmountOut\s*\(|"
               r"price_oracle\s*\(|get_dy\s*\(|get_p\s*\(")
ORACLE_SINK = r"borrow|liquidat|collateral|mint|redeem|reward|vault|share|price|value"
DEPTH_GUARD = (r"minLiquidity|minReserve|minimumReserve|liquidityThreshold|depth|TWAP|observe\s*\(|"
               r"cumulative|secondsAgo|timeWeighted|Chainlink|latestRoundData")
RATE_SURFACE = (r"exchangeRate|lending_accumulator|accumulator|borrowIndex|totalBorrows|"
                r"totalReserves|cashPrior|getCash|cToken|hToken")
DONATION_BALANCE = r"balanceOf\s*\(\s*address\s*\(\s*this\s*\)\s*\)|getCashPrior\s*\(|getCash\s*\("
SUPPLY_DIVISION = r"/\s*(?:totalSupply|totalShares|_totalSupply|supply)\b"
DONATION_SAFE = (r"internalCash|storedCash|cashBalance|virtualShares|deadShares|MINIMUM_LIQUIDITY|"
                 r"exchangeRateMantissa\s*=\s*initial|require\s*\([^;]*(totalSupply|supply)[^;]*>\s*0")
CLMM_SURFACE = r"sqrtP|sqrtPrice|tick|liquidity|swapStep|nextSqrt|deltaL|baseL"
CLMM_ROUND = r"mulDiv|FullMath|roundingUp|ceil|delta|calcFinalPrice|computeSwapStep"
CROSS_GUARD = (r"(nextSqrt\w*|sqrtP\w*)\s*(?:==|>=|<=)\s*(target|next|boundary|sqrtPrice)\w*|"
               r"crossTick\s*\(|_cross\s*\(|recomputeLiquidity|require\s*\([^;]*(tick|sqrt)[^;]*(<=|>=)")
INVARIANT_WORD = r"invariant|amp|amplification|BPT|poolToken|scalingFactor|rateProvider|stable"
DIV_MUL = r"\b\w+\s*/\s*\w+\s*\*\s*\w+|\(\s*[^()]{1,80}/[^()]{1,80}\)\s*\*"
PRECISION_SAFE = r"mulDiv|divDown|divUp|mulDown|mulUp|FixedPoint|LogExpMath|rounding"
UNSAFE_MINT = r"unchecked\s*\{[\s\S]{0,600}(?:\*|\+|/)|(?:\*|/)[^;]{0,160}_mint"
MINT_SINK = r"_mint\s*\([^,]+,\s*([A-Za-z_]\w*)\s*\)"
MINT_GUARD = r"mulDiv|SafeCast|Math\.|require\s*\([^;]*(shares|minted|amountOut)[^;]*(>|>=)|cap|maxSupply|minShares"
ROUND_UP = r"mulDivRoundingUp|ceilDiv|roundUp|\+\s*\w+\s*-\s*1\s*\)\s*/|/\s*\w+\s*\+\s*1"
WITHDRAW_TRANSFER = r"safeTransfer|transfer\s*\(|sendValue|\.call\s*\{"
MULTISIG_WORD = r"checkSignatures|threshold|owners|multisig|Safe|execTransaction|signature"
DELEGATE_PAYLOAD = r"delegatecall\s*\([^;]*(data|payload|calldata|operation|to|target)"
DELEGATE_BLOCK = r"operation\s*!=\s*\w*DelegateCall|require\s*\([^;]*delegatecall[^;]*(false|disabled)|allowlist|moduleWhitelist"
SWEEP_NAME = r"(withdrawAll|sweep|rescue|emergencyWithdraw|drain|transferAll)"
ALL_FUNDS = r"balanceOf\s*\(\s*address\s*\(\s*this\s*\)\s*\)|address\s*\(\s*this\s*\)\s*\.balance"
SINGLE_ADMIN = r"onlyOwner|owner\s*\(\s*\)|msg\.sender\s*==\s*owner|DEFAULT_ADMIN_ROLE"
MULTISIG_HINT = r"timelock|delay|multisig|threshold|guardian|pauseGuardian|Safe"
PAIR_ID = r"(?:(?:[A-Za-z_]\w*)?(?:pair|pool|amm|uniswap|pancake|lpToken|lpPair)\w*|pair|pool|lp|amm)"
DEAD_ID = r"(?:(?:[A-Za-z_]\w*)?(?:dead|burn|blackhole|null|zero)\w*|address\s*\(\s*0\s*\)|0x0{20,40}|0x0{0,36}dead)"
DEFERRED_BURN = r"\b((?:[A-Za-z_]\w*)?(?:accumulat|pending|queued|deferred)\w*burn\w*)\s*(?:\+=|=)"
NON_ASSET = r"nonAsset|otherAsset|token0|token1|weth|wrapped|quote"
QUOTE_OR_TWAP = r"quote|twap|getQuoteAtTick|consult|slot0|sqrtPriceX96|OracleLibrary"
TOTAL_RETURN = r"return[\s\S]{0,900}(nonAsset|otherAsset|token0|token1|weth|quote)"
REDEEM_CALC = r"convertToAssets\s*\(|previewRedeem\s*\(|totalAssets\s*\("
NON_ASSET_OUT = (
    r"(?:_safeTransfer|safeTransfer|transfer)\s*\(\s*(?:[A-Za-z_]\w*)?(?:nonAsset|otherAsset|weth|token0|token1|quote)\w*"
    r"\s*,\s*(?:receiver|recipient|to|owner)\b"
    r"|(?:[A-Za-z_]\w*)?(?:nonAsset|otherAsset|weth|token0|token1|quote)\w*"
    r"\s*\.\s*(?:safeTransfer|transfer)\s*\(\s*(?:receiver|recipient|to|owner)\b"
)
SUPPLY_BURN = r"_burn\s*\(|(?:totalSupply|_totalSupply)\s*(?:-=|=)|(?:supply|sharesSupply)\s*(?:-=|=)"
SUPPLY_REF = r"\b(?:totalSupply|_totalSupply|supply|sharesSupply)\s*(?:\(\s*\))?"
POOL_REF = (r"totalAssets\s*\(|balanceOf\s*\(\s*address\s*\(\s*this\s*\)\s*\)|poolBalance|reserve|cash|liquidity|underlying")
PAYOUT_SINK = r"\.(?:safeTransfer|transfer)\s*\(|call\s*\{|_withdraw\s*\(|sendValue\s*\("
CLAIM_FN = r"(claim|whitelist|airdrop|allowlist|mint)"
WHITELIST_AUTH = r"MerkleProof|merkle|ecrecover|ECDSA|isValidSignature|signature|signer|whitelist|allowlist"
CLAIM_VALUE = r"_mint\s*\(|\.(?:safeTransfer|transfer)\s*\(|claimable|amount"
CLAIM_MARKER = (r"claimed\s*\[|hasClaimed\s*\[|isClaimed\s*\[|nullifier|nonce|_useNonce|bitmap|BitMaps|"
                r"claimId|used\s*\[|consumed\s*\[")
REWARD_FN = r"(claim|reward|harvest|settle|stake|bet|withdraw|distribute)"
LIVE_BALANCE = (r"\bbalanceOf\s*\(\s*(?:msg\.sender|account|user|player|owner|to|from)\b|IERC1155\s*\([^)]*\)\s*\.balanceOf\s*\(")
REWARD_SINK = r"reward|points|stake|weight|share|payout|_mint\s*\(|\.(?:safeTransfer|transfer)\s*\("
REWARD_CHECKPOINT = (r"rewardDebt|lastClaim|lastReward|checkpoint|claimed|settled|paid|userIndex|accRewardPerShare|"
                     r"stakeOf\s*\[|locked\s*\[|depositId|snapshot")
RFQ_FN = r"(fill|order|rfq|quote|swap|settle|trade)"
RFQ_AUTH = r"ecrecover|ECDSA|recover\s*\(|isValidSignature|signature|signer"
RFQ_RECEIVER = (r"(allowed|approved|valid|is)\w*(Signer|signer)\s*\[[^\]]*(receiver|recipient|taker)[^\]]*\]\s*\[[^\]]*signer|"
                r"(receiver|recipient|taker)[\s\S]{0,180}signer|signer[\s\S]{0,180}(receiver|recipient|taker)")
RFQ_PULL = r"(?:safeTransferFrom|transferFrom)\s*\(\s*(?:(?:order\s*\.\s*)?(?:inventory|maker|from|src|source|owner))\b"
RFQ_BOUND = (
    r"(?:require|if)\s*\([^)]*(inventory|maker|from|src|source|owner)[^)]*(==|!=)[^)]*signer|"
    r"(?:require|if)\s*\([^)]*signer[^)]*(==|!=)[^)]*(inventory|maker|from|src|source|owner)|"
    r"(allowed|approved|valid|is)\w*(Signer|signer)\s*\[[^\]]*(inventory|maker|from|src|source|owner)[^\]]*\]\s*\[[^\]]*signer"
)
BATCH_NAME = r"^(run|batch|batchCall|executeBatch|multicall|aggregate|execute)$|(batch|multicall|aggregate|run)"
BATCH_ARRAY = r"(address|bytes|Call|Transaction|Target)\s*\[\s*\]"
BATCH_CALL = r"\.\s*(?:call|delegatecall)\s*[({]"
BATCH_AUTH = (r"onlyOwner|onlyRole|onlyAdmin|requiresAuth|authorized|msg\.sender\s*==\s*(owner|admin|executor|entryPoint|trusted)|"
              r"hasRole\s*\(|ecrecover|ECDSA|isValidSignature|nonce|permit|signature|allowlist|whitelist")
LEVERAGE_FN = r"(openLong|openShort|leverage|boost|borrow|openPosition|increasePosition)"
SPOT_PRICE = r"slot0\s*\(|sqrtPriceX96|getCurrentPrice|currentPrice|getSqrtRatio|spotPrice"
POSITION_WRITE = r"debt|borrow|loan|leverage|collateral|position|margin"
LIQUIDATION_CAP = (r"MAX_?LIQ|liquidations?ThisBlock|liquidations?InBlock|maxLiquidations|block\.number[\s\S]{0,120}liquidat")
TWAP_SAFE = r"observe\s*\(|consult\s*\(|TWAP|timeWeighted|secondsAgo|OracleLibrary\.consult"
# ---------------------------------------------------------------------------------------

_unpriv = ("unprivileged",)
_pulled_param = body.all(PULL_FROM_NAME, 1).any(lambda f: pnames.any(lambda p: f.eq(p)) & ~f.lower().isin("msg", "sender", "_msgsender"))
_bad_cast = params.all(INT_PARAM, 1, i=False).any(
    lambda p: body.has(near(r"uint\d*\s*\(\s*", p, r"\s*\)"))
    & ~body.has(near(r"(require|if)\s*\([^;{]*\b", p, r"\b\s*(>=|>)\s*0|\b", p, r"\b\s*<\s*0")))
_arrays = params.all(BARE_ARRAY, 1, i=False)
_external = is_ext & ~tail.has(r"\b(private|internal)\b")
_swap = _external & body.has(SWAP_CALL)
_missing_sig = count_true(~body.has(SIG_NONCE), ~body.has(SIG_DOMAIN), ~body.has(SIG_EXPIRY)) >= 2

# a quotient is assigned and the next statement multiplies it
_div_then_mul = body.all(DIV_ASSIGN, 1).any(lambda x: body.has(near(r"\b", x, THEN_ASSIGN, x, r"\s*\*", i=True)))

_loop_of = lambda c: near(r"\b(?:for|while)\b[\s\S]{0,180}<\s*", c, r"\b", i=True)
_typed = params.all(TYPED_ARRAY, 1)
_indexed = _typed.where(lambda a: body.has(near(a, r"\s*\[\s*(?:i|j|k|idx|index)\s*\]")))
_unbound_count = pnames.any(
    lambda c: c.has(COUNT_NAME) & body.has(_loop_of(c)) & (_indexed.size() > 0)
    & ~_indexed.any(lambda a: body.has(near(c, r"\s*==\s*", a, r"\s*\.\s*length|", a, r"\s*\.\s*length\s*==\s*", c)))
    & ~body.has(near(r"(abi\.encode|keccak256)[\s\S]{0,260}\b", c, r"\b", i=True)))
_few_anchors = body.all(HASH_ARGS, 1).any(lambda a: a.lower().all(DOMAIN_ANCHOR, 0).distinct().size() < 3)
_amounts = pnames.where(lambda p: p.has(r"amount|amt|value|qty"))
_hook_amounts = pnames.where(lambda p: p.has(r"amount|value|qty|quantity"))
_recorders = file_many(fn_names(lambda f: f.body.has(RECORD_APPEND) & f.body.has(REWARD_RECORD) & ~f.body.has(CHECKPOINT_NOOP)))
_drained = (params.all(TARGET_PARAM, 1).any(lambda t: body.has(near(r"\b", t, r"\b\s*\.\s*call"))
                                            | body.has(near(r"Address\s*\.\s*functionCall\s*\(\s*", t)))
            & params.all(CALLDATA_PARAM, 1).any(lambda d: body.has(word(d))))
_debit_first = lambda out: body.has(BURN_OR_DEBIT) & body.has(out) & (body.pos(BURN_OR_DEBIT) < body.pos(out))
_pair_out = body.has(
    rf"((?:super\s*\.\s*)?_update|(?:super\s*\.\s*)?_transfer|_transfer)\s*\(\s*{PAIR_ID}\s*,\s*{DEAD_ID}\s*,"
    rf"|(_burn|burn)\s*\(\s*{PAIR_ID}\s*,|_balances\s*\[\s*{PAIR_ID}\s*\]\s*(?:-=|=)")
_desync = ~tail.has(r"\b(view|pure)\b") & _pair_out & body.has(r"\.\s*(sync|skim)\s*\(")
_deferred = file_many(file_text(raw=True).all(DEFERRED_BURN, 1).distinct())
_uses_deferred = _deferred.any(lambda v: body.contains(v))
_nv = ~tail.has(r"\b(view|pure)\b")
_post_burn = body.after(SUPPLY_BURN)
_init_root = name.has(r"(init|initialize|upgrade|setRoot|accept)") & body.has(ROOT_SET)
_gate_root = name.has(r"(process|prove|execute|relay|receive|withdraw)") & body.has(ROOT_GATE)
_single = (body + " " + name).has(BRIDGE_CONFIG) & body.has(ONE_OF_ONE)
_single_guard = (tail + body).has(r"onlyOwner|onlyRole|onlyAdmin|onlyGovernance|timelock")

RULES = [
    Rule("ecrecover_zero", "~ecrecover_zero", 8.5, 7.0, body.has(ECRECOVER) & ~body.has(ECDSA_LIB) & ~body.has(ECRECOVER_GUARD)
         & body.has(ECRECOVER_AUTH), bug="signature", flags=_unpriv),
    Rule("eip1271_spoof", "~eip1271_spoof", 8.0, 6.0, body.has(r"isValidSignature\s*\(") & body.has(SIG_MAGIC) & ~body.has(SIGNER_OK),
         bug="signature", flags=_unpriv),
    Rule("arbitrary_from_transferfrom", "~arbitrary_from", 8.5, 6.0, is_ext & _pulled_param, bug="access_control", flags=_unpriv),
    Rule("cross_chain_receiver_source_auth", "~receiver_source_auth", 9.0, 5.5,
         name.has(RECV_NAME) & ~body.has(RECV_CALLER) & ~body.has(RECV_PEER), bug="cross_chain", flags=_unpriv),
    Rule("vault_share_donation_inflation", "~share_donation", 8.0, 6.0,
         name.has(SHARE_FN) & body.has(OWN_BALANCE, i=False) & body.has("totalSupply|totalShares", i=False) & body.has(r"[*/]", i=False),
         bug="share_inflation", flags=_unpriv, target=~in_target(VAULT_OFFSET, i=False) & ~in_target(VAULT_INTERNAL), once=True),
    Rule("reinitializable_proxy_delegatecall", "~reinitializable_proxy", 9.0, 6.0,
         in_file(r"\bdelegatecall\b", i=False, raw=True) & name.has(REINIT_NAME) & ~(tail + body).has(REINIT_GUARD) & body.has(WIRES_IMPL),
         bug="proxy", flags=_unpriv),
    Rule("payable_multicall_msgvalue_reuse", "~msgvalue_reuse", 8.5, 6.0,
         ltail.has("payable") & body.has(LOOP, i=False) & body.has(SELF_BATCH), bug="arithmetic_logic", flags=_unpriv),
    Rule("signed_unsigned_cast_mismatch", "~signed_cast", 7.5, 5.5, _bad_cast, bug="arithmetic_logic", flags=_unpriv),
    Rule("batch_array_length_mismatch", "~array_length_mismatch", 5.0, 5.0,
         is_ext & (_arrays.where(lambda a: body.has(near(a, r"\s*\[\s*\w+\s*\]"))).size() >= 2) & ~body.has(LENGTH_CHECK, i=False),
         bug="input_validation", flags=_unpriv),
    Rule("liquidation_collateral_not_cleared", "~collateral_not_cleared", 8.0, 5.5,
         name.has(LIQ_FN) & body.has(POSITION_OUT) & ~body.has(POSITION_CLEARED), bug="solvency", flags=_unpriv),
    Rule("corpus_patterns", "corpus_slippage_deadline", 7.0, 5.0, _swap & ~(params + "\n" + body).has(SLIPPAGE_GUARD),
         bug="slippage_deadline", lead=True),
    Rule("corpus_patterns", "corpus_slippage_deadline", 5.5, 4.5, _swap & ~(params + "\n" + body).has(SWAP_DEADLINE),
         bug="slippage_deadline", lead=True),
    Rule("corpus_patterns", "corpus_chainlink_staleness", 7.0, 6.0, _external & body.has(FEED) & ~body.has(FEED_FRESH),
         bug="chainlink_staleness", lead=True),
    Rule("corpus_patterns", "corpus_unbounded_loop_dos", 6.5, 4.5,
         _external & body.has(LENGTH_LOOP) & body.has(LOOP_EFFECT) & ~(params + tail).has(LOOP_CAP), bug="unbounded_loop_dos", lead=True),
    Rule("corpus_patterns", "corpus_low_level_call_unchecked", 6.5, 5.0, _external & body.has(BARE_CALL) & ~body.has(CALL_RESULT),
         bug="low_level_call_unchecked", lead=True),
    Rule("corpus_patterns", "corpus_signature_replay", 8.0, 5.5, _external & body.has(SIG_RECOVER) & _missing_sig,
         bug="signature_replay", lead=True),
    Rule("corpus_patterns", "corpus_zero_address_privileged_setter", 5.5, 5.5,
         _external & name.has(PRIV_SETTER) & params.has(ADDRESS_PARAM) & ~body.has(ZERO_CHECK), bug="zero_address_privileged_setter", lead=True),
    Rule("corpus_patterns", "corpus_division_before_multiplication", 6.5, 4.0,
         _external & (name.has(VALUE_MATH_NAME) | body.has(VALUE_MATH_NAME)) & _div_then_mul & ~body.has(MULDIV_SAFE),
         bug="division_before_multiplication", lead=True),
    Rule("settlement_boundary_mismatch", "proof_settlement_count_unbound", 9.0, 4.5,
         body.has(PROOF_SURFACE) & (_typed.size() > 0) & _unbound_count, bug="settlement_boundary_mismatch", lead=True),
    Rule("bridge_retry_domain_binding", "bridge_retry_hash_missing_domain", 9.0, 5.0,
         (name.has(BRIDGE_WORD) | body.has(BRIDGE_WORD)) & body.has(PROCESSED_KEY) & _few_anchors, bug="bridge_retry_domain_binding", lead=True),
    Rule("decimal_unit_mismatch", "oracle_math_hardcoded_scale_no_decimals", 7.5, 4.5,
         (~tail.has(r"\b(private|internal)\b", i=False) | tail.has("view|pure")) & body.has(ORACLE_PRICE) & body.has(FIXED_SCALE)
         & body.has(VALUE_MATH) & ~body.has(SCALE_AWARE), bug="decimal_unit_mismatch", lead=True,
         target=~(in_target(r"\bdecimals\s*\(|IERC20Metadata", i=False) & in_target("normalize|scale|toWad|fromWad|convert"))),
    Rule("zero_value_transferfrom_bypass", "zero_transferfrom_gates_value_path", 7.5, 5.0,
         is_ext & name.has(r"(claim|buy|mint|unlock|redeem|airdrop|reward|execute)") & ~body.has(ZERO_GUARD)
         & _amounts.any(lambda p: body.has(near(r"transferFrom\s*\([^;]*\b", p, r"\b"))) & body.has(ZERO_SINK),
         bug="zero_value_transferfrom_bypass", lead=True),
    Rule("zero_transfer_reward_checkpoint", "zero_transfer_stacks_reward_records", 9.0, 6.0,
         name.has(HOOK_TRANSFER) & tail.has(r"\b(public|external|internal)\b", i=False)
         & ~((_hook_amounts.size() > 0) & body.has(HOOK_ZERO_GUARD)) & body.all(SETTLE_CALL, 1, i=False).overlaps(_recorders),
         bug="zero_transfer_reward_checkpoint"),
    Rule("component_share_accounting", "component_redeem_live_balance_share_math", 8.0, 4.5,
         name.has(r"(redeem|withdraw|exit|burn|settle)") & body.has(LOOP) & body.has(COMPONENT_WORD) & body.has(BALANCE_SHARE)
         & body.has("safeTransfer|transfer", i=False)
         & ~(body.has(BURN_OR_DEBIT) & (body.pos(BURN_OR_DEBIT) < body.pos("safeTransfer|transfer", i=False))
             & body.has("storedAssets|componentBalances|managedAssets|assetBalance", i=False)), bug="component_share_accounting", lead=True),
    Rule("single_verifier_bridge_config", "bridge_single_verifier_or_threshold_one", 8.0, 4.0, _single & ~_single_guard,
         bug="single_verifier_bridge_config", lead=True),
    Rule("single_verifier_bridge_config", "bridge_single_verifier_or_threshold_one", 8.0, 4.0, _single & _single_guard,
         bug="single_verifier_bridge_config", lead=True, flags=("has_access_control", "documented_centralization")),
    Rule("allowance_drain_router", "router_unfiltered_target_and_calldata", 8.5, 6.0,
         is_ext & ~tail.has("onlyOwner|onlyRole|onlyAdmin|onlyGovernance") & body.has(LOW_CALL) & ~body.has(TARGET_ALLOWLIST) & _drained,
         bug="allowance_drain_router"),
    Rule("erc777_hook_balance_bypass", "erc777_transfer_hook_before_balance_update", 9.0, 6.0,
         is_ext & (name.has(DEPOSIT_LIKE) | body.has(DEPOSIT_LIKE)) & ~(tail + body.left(WIDE_LOCK_HEAD)).has(REENTRANCY_LOCK)
         & body.has(TRANSFER_IN) & body.after(TRANSFER_IN).has(BOOKKEEP) & ~body.before(TRANSFER_IN).has(BOOKKEEP),
         bug="erc777_hook_balance_bypass", target=in_target(HOOK_TOKEN)),
    Rule("read_only_reserve_reentrancy", "live_reserve_read_without_read_lock", 8.0, 4.0,
         is_ext & (ltail.has("view") | name.has(VALUATION)) & (name + " " + body).has(VALUATION) & body.has(LIVE_RESERVE)
         & ~(tail + body).has(READ_LOCK) & ~body.has(CACHE_OR_TWAP), bug="read_only_reserve_reentrancy", lead=True,
         target=in_target(r"\.call\s*\(|safeTransfer|transferFrom|swap\s*\(|mint\s*\(|burn\s*\(")),
    Rule("bridge_keeper_mutation", "bridge_payload_can_call_keeper_mutator", 9.5, 5.0,
         is_ext & (name.has(BRIDGE_EXEC) | body.has(BRIDGE_EXEC)) & body.has(DECODED_TARGET) & ~body.has(SELECTOR_ALLOWLIST),
         bug="bridge_keeper_mutation", lead=True, target=in_target(KEEPER_SURFACE)),
    Rule("bridge_zero_root_acceptance", "bridge_zero_or_unset_root_can_be_confirmed", 9.5, 6.0,
         (name + " " + body).has(ROOT_STATE) & (_init_root | _gate_root) & ~body.has(ROOT_REJECT), bug="bridge_zero_root_acceptance",
         target=in_target(ROOT_STATE) & in_target("bridge|replica|message|merkle|root")),
    Rule("verifier_address_spoof", "caller_supplied_verifier_address", 9.0, 5.0,
         (name + " " + body).has(VERIFY_WORD) & ~body.has(VERIFIER_PIN)
         & params.all(VERIFIER_PARAM, 1).any(lambda p: body.has(near(r"\b", p, r"\s*\.\s*(?:staticcall|call)\s*\("))),
         bug="verifier_address_spoof", lead=True),
    Rule("vyper_nonreentrant_compiler", "vyper_broken_nonreentrant_version", 9.0, 7.0,
         in_file(VYPER_BAD, raw=True) & in_file(VYPER_LOCK, raw=True), bug="vyper_nonreentrant_compiler", grain="file"),
    Rule("thin_liquidity_spot_oracle", "thin_pool_spot_oracle_no_depth_or_twap", 8.5, 5.5,
         body.has(SPOT_SOURCE) & (name + " " + body).has(ORACLE_SINK) & ~body.has(DEPTH_GUARD), bug="thin_liquidity_spot_oracle", lead=True),
    Rule("lending_exchange_rate_donation", "exchange_rate_from_donatable_cash", 8.5, 6.0,
         (name + " " + body).has(RATE_SURFACE) & body.has(DONATION_BALANCE) & body.has(SUPPLY_DIVISION) & ~body.has(DONATION_SAFE),
         bug="lending_exchange_rate_donation", target=in_target(RATE_SURFACE) & ~in_target(DONATION_SAFE)),
    Rule("clmm_tick_boundary_rounding", "clmm_boundary_rounding_without_cross_guard", 8.5, 4.5,
         name.has(r"(swap|compute|calc|getNext|update|cross)") & body.has(CLMM_SURFACE) & body.has(CLMM_ROUND) & ~body.has(CROSS_GUARD),
         bug="clmm_tick_boundary_rounding", lead=True),
    Rule("invariant_precision_loss", "invariant_division_before_multiplication", 8.0, 4.5,
         (name + " " + body).has(INVARIANT_WORD) & body.has(DIV_MUL) & ~body.has(PRECISION_SAFE), bug="invariant_precision_loss", lead=True),
    Rule("unsafe_mint_math", "unchecked_mint_amount_math", 8.0, 4.5,
         is_ext & name.has(r"(mint|deposit|issue|wrap|join)") & body.has(MINT_SINK) & body.has(UNSAFE_MINT) & ~body.has(MINT_GUARD),
         bug="unsafe_mint_math", lead=True),
    Rule("flash_cycle_rounding_withdraw", "withdraw_rounds_up_before_robust_debit", 8.0, 4.5,
         name.has(r"(withdraw|redeem|burn|exit|remove)") & body.has(ROUND_UP) & body.has(WITHDRAW_TRANSFER)
         & ~(_debit_first(WITHDRAW_TRANSFER) & body.has(r"dust|minOut|roundDown|mulDiv\(")), bug="flash_cycle_rounding_withdraw", lead=True),
    Rule("multisig_delegatecall_payload", "multisig_signed_delegatecall_payload", 9.0, 3.5,
         (name + " " + body).has(MULTISIG_WORD) & body.has(DELEGATE_PAYLOAD) & ~body.has(DELEGATE_BLOCK), bug="multisig_delegatecall_payload",
         lead=True, flags=("documented_centralization",), target=in_target(MULTISIG_WORD)),
    Rule("custody_sweep_centralization", "single_admin_can_sweep_custody", 7.0, 3.0,
         name.has(SWEEP_NAME) & (tail + body).has(SINGLE_ADMIN) & body.has(ALL_FUNDS) & ~(tail + body).has(MULTISIG_HINT),
         bug="custody_sweep_centralization", lead=True, flags=("documented_centralization",)),
    Rule("amm_pair_reserve_desync", "deferred_burn_debt_burns_pair_then_sync", 9.3, 8.2, _desync & _uses_deferred, bug="amm_pair_reserve_desync"),
    Rule("amm_pair_reserve_desync", "pair_balance_burn_then_sync_reserve_desync", 9.0, 7.4, _desync & ~_uses_deferred,
         bug="amm_pair_reserve_desync"),
    Rule("erc4626_dual_asset_redeem_double_count", "erc4626_redeem_double_pays_quoted_non_asset_leg", 9.2, 7.8,
         name.has("redeem|withdraw|exit") & _nv & body.has(REDEEM_CALC) & body.has(NON_ASSET_OUT) & file_pred(some_fn(
             lambda f: f.name.eq("totalAssets") & f.body.has(NON_ASSET) & f.body.has(QUOTE_OR_TWAP) & f.body.has(TOTAL_RETURN))),
         bug="erc4626_dual_asset_redeem_double_count"),
    Rule("redemption_after_supply_burn", "redemption_math_after_supply_burn", 9.0, 7.2,
         name.has(r"(redeem|withdraw|exit|unstake|burn)") & _nv & body.has(SUPPLY_BURN) & _post_burn.has(SUPPLY_REF)
         & _post_burn.has(POOL_REF) & _post_burn.has(PAYOUT_SINK), bug="redemption_after_supply_burn"),
    Rule("whitelist_claim_replay", "whitelist_claim_no_replay_marker", 8.4, 6.2,
         name.has(CLAIM_FN) & _nv & body.has(WHITELIST_AUTH) & body.has(CLAIM_VALUE) & ~body.has(CLAIM_MARKER),
         bug="whitelist_claim_replay", lead=True),
    Rule("balance_snapshot_reward_inflation", "live_balance_reward_without_checkpoint", 8.2, 5.6,
         name.has(REWARD_FN) & _nv & body.has(LIVE_BALANCE) & body.has(REWARD_SINK) & ~body.has(REWARD_CHECKPOINT),
         bug="balance_snapshot_reward_inflation", lead=True),
    Rule("rfq_signer_inventory_mismatch", "rfq_signer_not_bound_to_inventory", 9.4, 7.6,
         _nv & (name.has(RFQ_FN) | (params + body).has(r"\bOrder\b|RFQ|quote")) & body.has(RFQ_AUTH) & body.has(RFQ_RECEIVER)
         & body.has(RFQ_PULL) & ~body.has(RFQ_BOUND), bug="rfq_signer_inventory_mismatch"),
    Rule("permissionless_batch_executor", "permissionless_batch_low_level_calls", 9.0, 7.0,
         ~tail.has(r"\b(view|pure|internal|private)\b") & name.has(BATCH_NAME)
         & (params.has(BATCH_ARRAY) | body.has(r"targets?\s*\[|calls?\s*\[|data\s*\[")) & body.has(LOOP) & body.has(BATCH_CALL)
         & ~(tail + body).has(BATCH_AUTH), bug="permissionless_batch_executor"),
    Rule("spot_priced_leverage_liquidation_cap", "spot_priced_leverage_with_liquidation_cap", 8.8, 6.6,
         in_file(LIQUIDATION_CAP, raw=True) & _nv & name.has(LEVERAGE_FN) & body.has(SPOT_PRICE) & body.has(POSITION_WRITE)
         & ~body.has(TWAP_SAFE), bug="spot_priced_leverage_liquidation_cap", lead=True),
]
# Contract-grain rule: evaluated on target aggregates alone.
TARGET_RULES = [
    Rule("erc2771_msgsender_spoof", "~erc2771_self_multicall", 8.5, 6.0,
         in_target(CTX_2771) & in_target(r"\bmulticall\b") & in_target(SELF_DELEGATE), bug="access_control", flags=_unpriv,
         grain="target", fn="multicall"),
]
