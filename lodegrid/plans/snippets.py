"""One-line function snippets, a firing and a silent one per rule detector.

They are stitched into contract files derived from the ``documents`` table (see
``corpus``) and double as the positive/negative twins of the tests. Several
lines in one entry belong to one file (sibling and contract-grain rules).
"""

from __future__ import annotations

# detector -> (lines that fire it, lines that stay silent)
TWINS: dict[str, tuple[str, str]] = {
    "arbitrary_call": (
        "function relayTo(address dest, bytes memory blob) external { (bool ok, ) = dest.call(blob); require(ok); }",
        "function relayPeek(uint256 lot) external view returns (uint256) { return lot + 1; }"),
    "permit_misuse": (
        "function pullWith(uint256 lot) external { coin.permit(holder, msg.sender, lot, stop, v, r, s); coin.transferFrom(holder, vault, lot); }",
        "function pullPlain(uint256 lot) external { tally[msg.sender] = lot; }"),
    "proxy_upgrade": (
        "function upgradeTo(address next) external { slotImpl = next; }",
        "function migratePeek(address next) external view returns (bool) { return next == slotImpl; }"),
    "access_control": (
        "function setFeeSink(address sink) external { feeSink = sink; }",
        "function setFeeSinkSafe(address sink) external onlyOwner { feeSink = sink; }"),
    "arithmetic_logic": (
        "function mint(address who, uint256 lot) external { unchecked { supplyAll = supplyAll + lot * rateWide; } _mint(who, lot); }",
        "function mintOnce(address who, uint256 lot) internal onlyMinter { require(!minted[lot]); minted[lot] = true; _mint(who, lot); }"),
    "bridge_accounting": (
        "function finalizeWithdrawal(address who, uint256 lot) external { who.transfer(lot); bridgeLog[who] = lot; }\n// deposit",
        "function finalizePeek(address who) external view returns (uint256) { return bridgeLog[who]; }"),
    "oracle_manipulation": (
        "function sharePrice() external view returns (uint256) { (uint112 a, uint112 b, ) = duo.getReserves(); uint256 price = a * 1e18 / b; return price; }\nuint256 oracle;",
        "function sharePeek() external view returns (uint256) { return lastMark; }"),
    "reentrancy": (
        "function cashOut(uint256 lot) external { payee.call{value: lot}(\"\"); balances[msg.sender] -= lot; }",
        "function cashOutSafe(uint256 lot) external { balances[msg.sender] -= lot; payee.call{value: lot}(\"\"); }"),
    "signature_replay": (
        "function redeemSigned(bytes32 h, uint8 v, bytes32 r, bytes32 s) external { address w = ecrecover(h, v, r, s); roster[w] = 1; }",
        "function redeemTicket(bytes32 h) external { roster[msg.sender] = 1; }"),
    "time_logic": (
        "function setUnlockAt(uint256 t) external { unlockTime = t; }",
        "function setUnlockLater(uint256 t) external { require(t > unlockTime); unlockTime = t; }"),
    "token_logic": (
        "function payToken(address who, uint256 lot) external { coin.transfer(who, lot); }",
        "function payTokenSafe(address who, uint256 lot) external { require(coin.transfer(who, lot)); }"),
    "hook_callback_auth": (
        "function afterSwap(address payer, uint256 lot) external { coin.transferFrom(payer, vault, lot); }",
        "function afterSwapSafe(address payer, uint256 lot) external { require(msg.sender == pool); coin.transferFrom(payer, vault, lot); }"),
    "cross_chain_trust": (
        "function acceptRemote(uint64 srcChain, bytes32 remotePeer) external { require(peersOf[srcChain] == remotePeer); okay = true; }",
        "function acceptRemoteSafe(uint64 srcChain) external { require(peersOf[srcChain] == trustedPeer); okay = true; }"),
    "unprotected_initializer": (
        "function initializeVault(address boss) public { owner = boss; }",
        "function initializeVaultSafe(address boss) public initializer { owner = boss; }"),
    "self_call_auth_bypass": (
        "function runSelf(bytes calldata payload) external { address(this).call(payload); }",
        "function runSelfSafe(bytes calldata payload) external { require(bytes4(payload[:4]) == allowedSelector); address(this).call(payload); }"),
    "encodepacked_collision": (
        "function consumeKey(bytes calldata a, bytes calldata b) external { bytes32 k = keccak256(abi.encodePacked(a, b)); usedKeys[k] = true; }",
        "function consumeKeySafe(bytes calldata a, uint256 b) external { bytes32 k = keccak256(abi.encode(a, b)); usedKeys[k] = true; }"),
    "hook_pair_burn_sync": (
        "function _update(address a, address b, uint256 lot) internal { _burn(lpPair, lot); duo.sync(); }",
        "function _afterTokenTransfer(address a, address b, uint256 lot) internal { tally[a] = lot; }"),
    "deposit_callback_cei": (
        "function stakeNft(uint256 id) external { nft.safeTransferFrom(msg.sender, address(this), id); shares += 1; }",
        "function stakeNftSafe(uint256 id) external { shares += 1; nft.safeTransferFrom(msg.sender, address(this), id); }"),
    "receiver_hook_credit": (
        "function onERC721Received(address a, address b, uint256 id) external { deposits[b] += 1; }",
        "function onERC721ReceivedSafe(address a, address b, uint256 id) external nonReentrant { deposits[b] += 1; }"),
    "fot_swap_bounds": (
        "function swapSupportingFeeOnTransferTokens(uint256 lot) external { uint256 pre = coin.balanceOf(address(this)); credit[msg.sender] += lot; }",
        "function swapPlainTokens(uint256 lot) external { credit[msg.sender] += lot; }"),
    "asymmetric_safemath": (
        "pragma solidity ^0.5.0;\nfunction quoteCost(uint256 lot) public view returns (uint256) { uint256 total = lot.mul(unitRate) + flatFee; return total; }",
        "function quoteCostSafe(uint256 lot) public view returns (uint256) { uint256 total = lot.mul(unitRate).add(flatFee); return total; }"),
    "memory_struct_persistence": (
        "function bump(uint256 id) external { Seat memory seat = seats[id]; seat.score = 4; }",
        "function bumpSafe(uint256 id) external { Seat memory seat = seats[id]; seat.score = 4; seats[id] = seat; }"),
    "signer_allowlist": (
        "function enroll(address who) external { signers[who] = true; }",
        "function enrollSafe(address who) external onlyOwner { signers[who] = true; }"),
    "paymaster_userop_binding": (
        "function validatePaymasterUserOp(Op calldata op, bytes32 h) external { bytes32 d = keccak256(abi.encode(op.sender, op.nonce)); require(d.recover(op.sig) == boss); }",
        "function validatePaymasterUserOp(Op calldata op, bytes32 h) internal { bytes32 d = keccak256(abi.encode(op.sender, op.callData)); require(d.recover(op.sig) == boss); }"),
    "userop_chainid_replay": (
        "function validateUserOp(Op calldata op, bytes32 h) external { bytes32 d = keccak256(abi.encode(op.sender, op.nonce)); require(d.recover(op.sig) == boss); }",
        "function validateUserOp(Op calldata op, bytes32 h) internal { bytes32 d = keccak256(abi.encode(op.sender, block.chainid)); require(d.recover(op.sig) == boss); }"),
    "validateuserop_missing_prefund": (
        "function validateUserOp(Op calldata op, bytes32 h, uint256 missingAccountFunds) external { log1 = missingAccountFunds; }",
        "function validateUserOp(Op calldata op, uint256 missingAccountFunds) external { entry.depositTo(address(this)); }"),
    "session_key_unscoped": (
        "function checkSession(bytes calldata blob) external { (address target, uint256 lot) = abi.decode(blob, (address, uint256)); okay = session.validUntil > lot; }",
        "function checkSessionSafe(bytes calldata blob) external { (address target, uint256 lot) = abi.decode(blob, (address, uint256)); require(target == pinned); okay = session.validUntil > lot; }"),
    "clmm_rounding_asymmetry": (
        "uint256 liquidity;\nfunction withdrawLeg(uint256 q) external returns (uint256) { return mulDivRoundingUp(q, a, b); }\nfunction depositLeg(uint256 q) external returns (uint256) { return q * a / b; }",
        "function withdrawLegDown(uint256 q) external returns (uint256) { return q * a / b; }"),
    "interest_accrual_asymmetry": (
        "function accrueInterest() public { borrowIndex = borrowIndex + 1; }\nfunction repayLoan(uint256 lot) external { accrueInterest(); totalBorrows = totalBorrows - lot; }\nfunction borrowMore(uint256 lot) external { totalBorrows = totalBorrows + lot; }",
        "function borrowIdle(uint256 lot) external { ledger[msg.sender] = lot; }"),
    "message_replay_no_nonce": (
        "function lzReceive(bytes32 guid, address who, uint256 lot) external { _mint(who, lot); }",
        "function lzReceive(bytes32 guid, address who) external { require(!seenIds[guid]); seenIds[guid] = true; _mint(who, 1); }"),
    "retry_domain_binding": (
        "function retryMessage(uint32 srcEid, address who, uint256 lot) external { balances[who] += lot; }",
        "function retryMessageSafe(uint32 srcEid, address who, uint256 lot) external onlyEndpoint { balances[who] += lot; }"),
    "claim_replay_no_marker": (
        "bytes32 merkleRoot;\nfunction claimDrop(uint256 lot, bytes32[] calldata path) external { require(_verifyLeaf(path, lot)); coin.transfer(msg.sender, lot); }",
        "function claimDropOnce(uint256 lot, bytes32[] calldata path) external { require(!claimed[lot]); claimed[lot] = true; require(_verifyLeaf(path, lot)); coin.transfer(msg.sender, lot); }"),
    "swap_missing_slippage_deadline": (
        "function dumpAll(uint256 lot) external { venue.swapExact(P({amountIn: lot, amountOutMin: 0})); }",
        "function dumpSome(uint256 lot, uint256 floor) external { venue.swapExact(P({amountIn: lot, amountOutMin: floor})); }"),
    "max_approve_mutable_spender": (
        "function arm() external { coin.approve(strategy, type(uint256).max); }\nfunction setStrategy(address a) external { strategy = a; }",
        "function armOne() external { coin.approve(strategyFixed, 1); }"),
    "borrow_cap_not_enforced": (
        "uint256 public borrowCap;\nfunction borrowCash(uint256 lot) external { totalBorrows += lot; }",
        "function borrowCashSafe(uint256 lot) external { require(totalBorrows + lot <= borrowCap); totalBorrows += lot; }"),
    "bad_debt_no_socialization": (
        "function liquidateBook(address who) external { if (collateral < debt) { debtOf[who] = 0; } }",
        "function liquidatePeek(address who) external view returns (uint256) { return debtOf[who]; }"),
    "health_factor_rounding": (
        "function isHealthyAcct(address who) external view returns (bool) { uint256 collateral = ceilDiv(a, b); return collateral >= debt; }",
        "function isHealthyFloor(address who) external view returns (bool) { uint256 collateral = a / b; return collateral > 0; }"),
    "push_payment_dos": (
        "function bid() external payable { highestBidder.transfer(topBid); topBid = msg.value; }",
        "function bidPull() external payable { pendingReturns[highestBidder] += topBid; topBid = msg.value; }"),
    "erc404_ledger_desync": (
        "mapping(uint256 => address) _ownerOf; uint256 unit;\nfunction _transfer(address a, address b, uint256 q) internal { balanceOf[a] -= q; balanceOf[b] += q; }",
        "function _transfer(address a, address b) internal { _setOwned(a, b); }"),
    "twap_zero_window": (
        "function readTwap() external view returns (int56) { secondsAgos[0] = 0; return duo.observe(secondsAgos); }",
        "function readTwapLong() external view returns (int56) { secondsAgos[0] = 1800; return duo.observe(secondsAgos); }"),
    "divide_before_multiply": (
        "function rewardCut(uint256 q) external view returns (uint256) { return q / base * rate; }",
        "function rewardCutSafe(uint256 q) external view returns (uint256) { return q * rate / base; }"),
    "uninitialized_implementation": (
        "contract VaultUpgradeable is Initializable { address keeperOne;\nfunction initialize(address a) external initializer { keeperOne = a; }",
        "function startUp(address a) external { keeperTwo = a; }"),
    "constructor_state_in_proxy_impl": (
        "address immutable anchor;\ncontract PoolUpgradeable is Initializable { uint256 z;\nfunction initialize(uint256 q) external initializer { z = q; }",
        "address constant anchorFixed = address(1);"),
    "missing_storage_gap": (
        "abstract contract BaseUpgradeable is Initializable {\nuint256 public limit;",
        "contract LeafOnly { uint256 z; }"),
    "reward_per_token_zero_supply": (
        "function rewardPerToken() public view returns (uint256) { return stored + pot / totalSupply; }",
        "function rewardPerTokenSafe() public view returns (uint256) { if (totalSupply == 0) return stored; return stored + pot / totalSupply; }"),
    "permit_missing_deadline": (
        "function permitLax(address who, uint256 validBefore, bytes calldata sig) external { bytes32 d = keccak256(abi.encode(who, expiration)); address w = d.recover(sig); }",
        "function permitFirm(address who, uint256 validBefore, bytes calldata sig) external { require(block.timestamp <= validBefore); bytes32 d = keccak256(abi.encode(who)); address w = d.recover(sig); }"),
    "emergency_withdraw_stale_debt": (
        "function emergencyWithdraw() external { uint256 q = user.amount; user.amount = 0; coin.transfer(msg.sender, q); }",
        "function emergencyWithdraw(uint256 pid) external { user.amount = 0; user.rewardDebt = 0; totalStaked -= pid; coin.transfer(msg.sender, pid); }"),
    "unsafe_downcast": (
        "function pack(uint256 lot) external { slim[msg.sender] = uint128(lot); }",
        "function packSafe(uint256 lot) external { require(lot <= type(uint128).max); slim[msg.sender] = uint128(lot); }"),
    "weak_randomness": (
        "function drawWinner() external view returns (uint256) { return uint256(keccak256(abi.encode(block.timestamp))) % 7; }",
        "function drawSeed() external view returns (uint256) { return seedStore; }"),
    "ecrecover_zero": (
        "function authBy(bytes32 h, uint8 v, bytes32 r, bytes32 s) external { require(ecrecover(h, v, r, s) == boss); go = 1; }",
        "function authBySafe(bytes32 h, uint8 v, bytes32 r, bytes32 s) external { address w = ecrecover(h, v, r, s); require(w != address(0)); go = 1; }"),
    "eip1271_spoof": (
        "function acceptSig(address w, bytes32 h, bytes calldata g) external { require(IW(w).isValidSignature(h, g) == 0x1626ba7e); go = 2; }",
        "function acceptSigSafe(address w, bytes32 h, bytes calldata g) external { require(isSigner[w]); require(IW(w).isValidSignature(h, g) == 0x1626ba7e); go = 2; }"),
    "arbitrary_from_transferfrom": (
        "function pullAny(address victim, uint256 lot) external { coin.transferFrom(victim, vault, lot); }",
        "function pullOwn(uint256 lot) external { coin.transferFrom(msg.sender, vault, lot); }"),
    "cross_chain_receiver_source_auth": (
        "function _ccipReceive(Msg memory m) internal { ledger[m.who] += m.lot; }",
        "function _ccipReceive(Msg memory m, uint64 sourceChainSelector) internal { require(allowlistedSenders[m.who]); ledger[m.who] += m.lot; }"),
    "vault_share_donation_inflation": (
        "function depositCash(uint256 q) external returns (uint256) { return q * totalSupply / coin.balanceOf(address(this)); }",
        "function depositFlat(uint256 q) external returns (uint256) { return q; }"),
    "erc2771_msgsender_spoof": (
        "contract Hub is ERC2771Context { uint256 z;\nfunction multicall(bytes[] calldata data) external { for (uint i; i < 2; i++) { address(this).delegatecall(data[i]); } }",
        "function multicallPlain(uint256 q) external { z = q; }"),
    "reinitializable_proxy_delegatecall": (
        "function setupModule(address a) external { implementation = a; }\nfunction passOn(bytes memory z) internal { implementation.delegatecall(z); }",
        "function setupModuleSafe(address a) external onlyOwner { implementation = a; }"),
    "payable_multicall_msgvalue_reuse": (
        "function batchPay(bytes[] calldata data) external payable { for (uint i = 0; i < 3; i++) { address(this).delegatecall(data[i]); } }",
        "function batchPaySafe(bytes[] calldata data) external { for (uint i = 0; i < 3; i++) { tally[i] = 1; } }"),
    "signed_unsigned_cast_mismatch": (
        "function moveSigned(int256 step) external { spot = uint256(step); }",
        "function moveSignedSafe(int256 step) external { require(step >= 0); spot = uint256(step); }"),
    "batch_array_length_mismatch": (
        "function payMany(address[] calldata who, uint256[] calldata lots) external { for (uint i; i < 3; i++) { ledger[who[i]] = lots[i]; } }",
        "function payManySafe(address[] calldata who, uint256[] calldata lots) external { require(who.length == lots.length); ledger[who[0]] = lots[0]; }"),
    "liquidation_collateral_not_cleared": (
        "function liquidateSeat(address who) external { coin.safeTransfer(who, collateralOf); }",
        "function liquidateSeatSafe(address who) external { coin.safeTransfer(who, collateralOf); collateralOf = 0; }"),
    "corpus_patterns": (
        "function swapNow(uint256 lot) external { venue.swapExactTokens(lot); }",
        "function swapLater(uint256 lot, uint256 minOut, uint256 deadline) external { venue.swapExactTokens(lot, minOut, deadline); }"),
    "settlement_boundary_mismatch": (
        "function settleBatch(uint256 numTx, bytes32[] calldata items) external { verifyProof(blob); for (uint i = 0; i < numTx; i++) { pay(items[i]); } }",
        "function settleBatchSafe(uint256 numTx, bytes32[] calldata items) external { require(numTx == items.length); verifyProof(blob); for (uint i = 0; i < numTx; i++) { pay(items[i]); } }"),
    "bridge_retry_domain_binding": (
        "function relayPacket(address who, uint256 lot) external { bytes32 k = keccak256(abi.encode(who, lot)); require(!processed[k]); processed[k] = true; }",
        "function relayPacketSafe(address who, uint256 lot, uint32 srcEid, uint64 nonce) external { bytes32 k = keccak256(abi.encode(who, lot, srcEid, nonce, block.chainid)); processed[k] = true; }"),
    "decimal_unit_mismatch": (
        "function worth(uint256 q) external view returns (uint256) { return q * feed.getPrice() / 1e18; }",
        "function worthSafe(uint256 q) external view returns (uint256) { return q * feed.getPrice() / 10 ** assetDecimals; }"),
    "zero_value_transferfrom_bypass": (
        "function buySeat(uint256 amount) external { coin.transferFrom(msg.sender, vault, amount); unlocked[msg.sender] = true; }",
        "function buySeatSafe(uint256 amount) external { require(amount > 0); coin.transferFrom(msg.sender, vault, amount); unlocked[msg.sender] = true; }"),
    "zero_transfer_reward_checkpoint": (
        "function _beforeTokenTransfer(address a, address b, uint256 amount) internal { _settleRewards(a); }\nfunction _settleRewards(address a) internal { rewardRecords[a].push(block.number); }",
        "function _beforeTokenTransfer(address a, address b, uint256 qty) internal { require(qty > 0); _settleRewards(a); }"),
    "component_share_accounting": (
        "function redeemBasket(uint256 shares) external { for (uint i; i < components.length; i++) { coin.safeTransfer(msg.sender, coin.balanceOf(address(this)) * shares / totalSupply); } }",
        "function redeemBasketSafe(uint256 shares) external { ledger[msg.sender] -= shares; }"),
    "single_verifier_bridge_config": (
        "function configureDvn() external { threshold = 1; }",
        "function configureDvnWide() external { threshold = 5; }"),
    "allowance_drain_router": (
        "function routeCall(address hop, bytes calldata blob) external { hop.call(blob); }",
        "function routeCallSafe(address hop, bytes calldata blob) external { require(approvedTargets[hop]); hop.call(blob); }"),
    "erc777_hook_balance_bypass": (
        "function supplyCoin(uint256 lot) external { coin.transferFrom(msg.sender, address(this), lot); deposits[msg.sender] += lot; }",
        "function supplyCoinSafe(uint256 lot) external nonReentrant { coin.transferFrom(msg.sender, address(this), lot); deposits[msg.sender] += lot; }"),
    "read_only_reserve_reentrancy": (
        "function quoteValue() external view returns (uint256) { return duo.get_virtual_price(); }\nfunction exitNow() external { coin.safeTransfer(a, b); }",
        "function quoteValueCached() external view returns (uint256) { return cachedQuote; }"),
    "bridge_keeper_mutation": (
        "address keeper;\nfunction executePayload(bytes calldata blob) external { (address target, bytes memory data) = abi.decode(blob, (address, bytes)); target.call(data); }",
        "function executePayloadSafe(bytes calldata blob) external { (address hop, bytes memory z) = abi.decode(blob, (address, bytes)); require(trustedTargets[hop]); }"),
    "bridge_zero_root_acceptance": (
        "function processProof(bytes32 root) external { require(confirmAt[root] == true); bridgeNote = root; }",
        "function processProofSafe(bytes32 root) external { require(root != bytes32(0)); require(confirmAt[root] != 0); bridgeNote = root; }"),
    "verifier_address_spoof": (
        "function checkVaa(address coreVerifier, bytes calldata vaa) external { coreVerifier.staticcall(vaa); }",
        "function checkVaaSafe(address coreVerifier, bytes calldata vaa) external { require(coreVerifier == trustedVerifier); coreVerifier.staticcall(vaa); }"),
    "vyper_nonreentrant_compiler": ("# @version 0.2.15\n@nonreentrant('lock')\ndef pay(q: uint256):", "# @version 0.3.9"),
    "thin_liquidity_spot_oracle": (
        "function borrowLimit() external view returns (uint256) { return duo.get_dy(0, 1, lot) * collateral; }",
        "function borrowLimitDeep() external view returns (uint256) { require(minLiquidity > 1); return duo.get_dy(0, 1, lot) * collateral; }"),
    "lending_exchange_rate_donation": (
        "function exchangeRateNow() external view returns (uint256) { return getCash() * 1e18 / totalSupply; }",
        "function exchangeRateFixed() external view returns (uint256) { return fixedRate; }"),
    "clmm_tick_boundary_rounding": (
        "function computeStep(uint160 sqrtP) internal pure returns (uint256) { return FullMath.mulDiv(sqrtP, q, z); }",
        "function computeStepSafe(uint160 sqrtP) internal returns (uint256) { crossTick(sqrtP); return FullMath.mulDiv(sqrtP, q, z); }"),
    "invariant_precision_loss": (
        "function stableInvariant(uint256 q) internal pure returns (uint256) { return q / ampBase * q; }",
        "function stableInvariantSafe(uint256 q) internal pure returns (uint256) { return divDown(q, ampBase) * q; }"),
    "unsafe_mint_math": (
        "function depositWide(uint256 q) external { unchecked { lots = q * rateWide; } _mint(msg.sender, lots); }",
        "function depositNarrow(uint256 q) external { lots = mulDiv(q, rateWide, 1); _mint(msg.sender, lots); }"),
    "flash_cycle_rounding_withdraw": (
        "function withdrawUp(uint256 q) external { uint256 z = ceilDiv(q, base); coin.safeTransfer(msg.sender, z); }",
        "function withdrawDown(uint256 q) external { uint256 z = q; coin.safeTransfer(msg.sender, z); }"),
    "multisig_delegatecall_payload": (
        "function execTransaction(address hop, bytes memory payload) external { checkSignatures(payload); assembly { let ok := delegatecall(gas(), hop, payload, 0, 0, 0) } }",
        "function execTransactionSafe(address hop) external { checkSignatures(hop); }"),
    "custody_sweep_centralization": (
        "function sweepAll() external onlyOwner { coin.transfer(boss, coin.balanceOf(address(this))); }",
        "function sweepAllSlow() external onlyOwner { require(timelock < now); coin.transfer(boss, coin.balanceOf(address(this))); }"),
    "amm_pair_reserve_desync": (
        "function burnPool(uint256 q) external { _transfer(lpPair, deadWallet, q); duo.sync(); }",
        "function burnPoolSafe(uint256 q) external { _transfer(msg.sender, deadWallet, q); }"),
    "erc4626_dual_asset_redeem_double_count": (
        "function totalAssets() public view returns (uint256) { uint256 z = quoteLeg(weth); return z + weth; }\nfunction redeemBoth(uint256 q) external { uint256 z = convertToAssets(q); weth.transfer(receiver, z); }",
        "function redeemOne(uint256 q) external { uint256 z = convertToAssets(q); coin.transfer(receiver, z); }"),
    "redemption_after_supply_burn": (
        "function unstakeAll(uint256 q) external { _burn(msg.sender, q); uint256 payout = q * poolBalance / totalSupply; coin.transfer(msg.sender, payout); }",
        "function unstakeAllSafe(uint256 q) external { uint256 payout = q * poolBalance / totalSupply; coin.transfer(msg.sender, payout); _burn(msg.sender, q); }"),
    "whitelist_claim_replay": (
        "function whitelistMint(uint256 amount, bytes calldata signature) external { require(check(signature)); _mint(msg.sender, amount); }",
        "function whitelistMintOnce(uint256 amount, bytes calldata signature) external { require(!claimed[msg.sender]); require(check(signature)); _mint(msg.sender, amount); }"),
    "balance_snapshot_reward_inflation": (
        "function harvestLive() external { uint256 points = coin.balanceOf(msg.sender) * rate; coin.transfer(msg.sender, points); }",
        "function harvestMarked() external { uint256 points = coin.balanceOf(msg.sender) * rate; rewardDebt[msg.sender] = points; }"),
    "rfq_signer_inventory_mismatch": (
        "function fillQuote(Q calldata q, address maker, address receiver, address signer) external { require(validSigner[receiver][signer]); check(ECDSA.recover(h, q.sig)); coin.transferFrom(maker, receiver, q.lot); }",
        "function fillQuoteSafe(Q calldata q, address maker, address signer) external { require(maker == signer); check(ECDSA.recover(h, q.sig)); }"),
    "permissionless_batch_executor": (
        "function executeBatch(address[] calldata hops, bytes[] calldata blobs) external { for (uint i; i < 4; i++) { hops[i].call(blobs[i]); } }",
        "function executeBatchSafe(address[] calldata hops, bytes[] calldata blobs) external onlyOwner { for (uint i; i < 4; i++) { hops[i].call(blobs[i]); } }"),
    "spot_priced_leverage_liquidation_cap": (
        "uint256 maxLiquidations;\nfunction openLong(uint256 q) external { uint256 p = duo.slot0(); margin[msg.sender] = q * p; }",
        "function openLongTwap(uint256 q) external { uint256 p = duo.observe(w); margin[msg.sender] = q * p; }"),
    "actual_received_accounting": (
        "function joinPool(uint256 amount) external { coin.transferFrom(msg.sender, address(this), amount); _mint(msg.sender, amount); }",
        "function joinPoolSafe(uint256 amount) external { coin.transferFrom(msg.sender, address(this), amount); uint256 received = after1 - before1; _mint(msg.sender, received); }"),
    "merkle_claim_binding": (
        "function drawMerkle(bytes32[] calldata p, uint256 q) external { bytes32 leaf = keccak256(abi.encode(q)); require(MerkleProof.verify(p, top, leaf)); coin.transfer(msg.sender, q); }",
        "function drawMerkleSafe(bytes32[] calldata p, uint256 amount, address token) external { bytes32 leaf = keccak256(abi.encode(msg.sender, amount, token, chainId)); require(MerkleProof.verify(p, top, leaf)); coin.transfer(msg.sender, amount); }"),
    "bitmap_claim_collision": (
        "function markBit(uint256 index) external { claimedBitMap = claimedBitMap | (1 << index); }",
        "function markBitSafe(uint256 index) external { claimedBitMap[index / 256] = claimedBitMap[index / 256] | (1 << (index % 256)); }"),
    "bridge_replay_key": (
        "function receivePacket(address who, uint256 q) external { bytes32 k = keccak256(abi.encode(who, q)); require(!processed[k]); processed[k] = true; coin.transfer(who, q); }",
        "function receivePacketSafe(address who, uint256 q) external { bytes32 k = keccak256(abi.encode(who, q, srcChain, peer, nonce, domain, eid)); processed[k] = true; coin.transfer(who, q); }"),
    "address_alias_bridge": (
        "function onCrossDomain(uint256 q) external { require(msg.sender == l1Peer); finalizeLot(q); }",
        "function onCrossDomainSafe(uint256 q) external { require(msg.sender == AddressAliasHelper.applyL1ToL2Alias(l1Peer)); finalizeLot(q); }"),
    "oracle_freshness_sequencer": (
        "function readPrice() external view returns (int256) { (, int256 answer, , , ) = feed.latestRoundData(); return answer; }",
        "function readPriceSafe() external view returns (int256) { (uint80 roundId, int256 answer, , uint256 updatedAt, uint80 answeredInRound) = feed.latestRoundData(); require(answer > 0 && answeredInRound >= roundId && block.timestamp - updatedAt < heartbeat && sequencerUp); return answer; }"),
    "twap_observation_cardinality": (
        "function meanTick() external view returns (int24) { uint32 secondsAgo = 0; return lib.consult(duo, secondsAgo); }",
        "function meanTickSafe() external view returns (int24) { uint32 secondsAgo = 0; require(observationCardinality > 9); return lib.consult(duo, secondsAgo); }"),
    "forced_eth_accounting": (
        "function totalShareEth() external view returns (uint256) { return address(this).balance / shareCount; }",
        "function totalShareEthSafe() external view returns (uint256) { return trackedBalance / shareCount; }"),
    "create2_metamorphic_trust": (
        "function trustModule(address a) external { require(a.code.length > 0); modules[a] = true; }",
        "function trustModuleSafe(address a) external { require(a.codehash == expectedCodeHash); modules[a] = true; }"),
    "trycatch_finalization": (
        "function finishMsg(bytes32 id) external { processed[id] = true; try hub.go(id) { okay = true; } catch { fails = fails + 1; } }",
        "function finishMsgSafe(bytes32 id) external { processed[id] = true; try hub.go(id) { okay = true; } catch { revert(\"bad\"); } }"),
    "reward_debt_order": (
        "function claimYield(uint256 q) external { coin.transfer(msg.sender, q); rewardDebt[msg.sender] = q; }",
        "function claimYieldSafe(uint256 q) external { rewardDebt[msg.sender] = q; coin.transfer(msg.sender, q); }"),
    "accumulator_zero_supply": (
        "function stepAcc(uint256 q) external { accYieldPerShare = accYieldPerShare + q / totalShares; }",
        "function stepAccSafe(uint256 q) external { if (totalShares == 0) { return; } accYieldPerShare = accYieldPerShare + q / totalShares; }"),
    "position_merge_split": (
        "function splitSeat(uint256 tokenId) external { seatCollateral[tokenId + 1] = seatCollateral[tokenId]; }",
        "function splitSeatSafe(uint256 tokenId) external { seatCollateral[tokenId + 1] = seatCollateral[tokenId]; delete seatCollateral[tokenId]; }"),
    "governance_snapshot_bypass": (
        "function castVote(uint256 id) external { tallyOf[id] += coin.balanceOf(msg.sender); }",
        "function castVoteSafe(uint256 id) external { tallyOf[id] += coin.getPastVotes(msg.sender, proposalSnapshot); }"),
    "multicall_state_cache": (
        "function batchAll(bytes[] calldata data) external payable { lib.delegatecall(data[0]); }",
        "function batchAllSafe(bytes[] calldata data) external payable { lib.delegatecall(data[0]); valueUsed = 1; }"),
    "wad_ray_unit_mismatch": (
        "function mixUnits(uint256 q) external pure returns (uint256) { return q * WAD / 1e27; }",
        "function mixUnitsSafe(uint256 q) external pure returns (uint256) { return normalize(q * WAD / 1e27); }"),
    "duplicate_batch_item": (
        "function payIds(uint256[] calldata ids) external { for (uint i; i < ids.length; i++) { credits[msg.sender] += lots[ids[i]]; } }",
        "function payIdsSafe(uint256[] calldata ids) external { for (uint i; i < ids.length; i++) { require(!seen[ids[i]]); seen[ids[i]] = true; } }"),
    "zk_verifier": (
        "bytes32 groth16Key;\nfunction setVerifier(address a) external { verifier = a; }\nfunction joinProof(bytes calldata proof) external { verifier.verifyProof(proof); note = 1; }",
        "function setVerifierSafe(address a) external onlyOwner { verifier = a; }"),
    "privacy_pool": (
        "function withdrawNote(address recipient, uint256 amount, bytes32 root, bytes calldata proof) external { require(verifyProof(proof)); recipient.transfer(amount); nullifierHashes[root] = true; }",
        "function withdrawPlain(uint256 lot) external { ledger[msg.sender] -= lot; }"),
}

# Rules over call edges and flows: firing lines (siblings and helpers of one file), silent lines.
SPECIAL_TWINS: dict[str, tuple[str, str]] = {
    "reentrancy": (
        "function payOut(address who, uint256 q) internal { who.call{value: q}(\"\"); }\nfunction borrowFresh(uint256 q) external { payOut(msg.sender, q); totalBorrows = totalBorrows + q; }",
        "function borrowSafe(uint256 q) external { totalBorrows = totalBorrows + q; payOut(msg.sender, q); }"),
    "solvency_check": (
        "uint256 reserves;\nmapping(address => uint256) debt;\nfunction checkAccountLiquidity(address a) public view returns (bool) { return a != boss; }\nfunction moveDebt(uint256 q) external { require(checkAccountLiquidity(msg.sender)); debt[msg.sender] += q; }\nfunction donateCash(uint256 q) external { reserves -= q; }",
        "function peekCash(uint256 q) external view returns (uint256) { return reservesView; }"),
    "flashloan_governance": (
        "function castBallot(uint256 id) external { weight[id] += coin.balanceOf(msg.sender); quorum = 1; }\nfunction emergencyCommit(uint256 id) external { run(id); }",
        "function castBallotPast(uint256 id) external { weight[id] += 1; }"),
    "pausability_bypass": (
        "function settleCore(uint256 q) internal { tally[q] = 1; }\nfunction depositLive(uint256 q) external whenNotPaused { settleCore(q); }\nfunction executeNow(uint256 q) external { settleCore(q); }",
        "function executeIdle(uint256 q) external whenNotPaused { settleCore(q); }"),
    "delegatecall": (
        "function proxyTo(address impl, bytes calldata z) external { impl.delegatecall(z); }",
        "function proxyFixed(bytes calldata z) external view returns (uint256) { return 1; }"),
    "weird_hunt_taint_value_flow": (
        "function releaseTo(address recipient, uint256 amount) internal { coin.transfer(recipient, amount); }\nfunction startRelease(address recipient, uint256 amount) external { releaseTo(recipient, amount); }",
        "function startIdle(uint256 lot) external { tally[lot] = 1; }"),
    "zk_verifier": (
        "function proveExitTo(bytes calldata proof, address recipient, uint256 amount) external { require(verifier.verifyProof(proof)); payNote(recipient, amount); }\nfunction payNote(address recipient, uint256 amount) internal { coin.transfer(recipient, amount); }",
        "function proveIdle(bytes calldata proof) external { require(verifier.verifyProof(proof)); }"),
    "economic_oracle_lending": (
        "function getUnderlyingPrice(address cToken) external view returns (uint256) { return prices[cToken]; }\nfunction setDirectPrice(address cToken, uint256 p) external { prices[cToken] = p; }\nfunction borrowAgainst(uint256 q) external { uint256 p = priceOracle.get(q); require(getAccountLiquidity(p) > q); borrowAllowed(q); }",
        "function quietPrice(uint256 q) external { tally[q] = 1; }"),
}
