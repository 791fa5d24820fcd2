"""Bytecode helpers: hex utilities stay JVM-side, keccak and the PUSH-aware decode run Arrow-batched."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Opcode names by number; runs (PUSH, DUP, SWAP, LOG) are generated below.
OPCODES = {
    0x00: "STOP", 0x01: "ADD", 0x02: "MUL", 0x03: "SUB", 0x04: "DIV", 0x05: "SDIV", 0x06: "MOD", 0x07: "SMOD", 0x08: "ADDMOD",
    0x09: "MULMOD", 0x0A: "EXP", 0x0B: "SIGNEXTEND", 0x10: "LT", 0x11: "GT", 0x12: "SLT", 0x13: "SGT", 0x14: "EQ", 0x15: "ISZERO",
    0x16: "AND", 0x17: "OR", 0x18: "XOR", 0x19: "NOT", 0x1A: "BYTE", 0x1B: "SHL", 0x1C: "SHR", 0x1D: "SAR", 0x20: "SHA3",
    0x30: "ADDRESS", 0x31: "BALANCE", 0x32: "ORIGIN", 0x33: "CALLER", 0x34: "CALLVALUE", 0x35: "CALLDATALOAD", 0x36: "CALLDATASIZE",
    0x37: "CALLDATACOPY", 0x38: "CODESIZE", 0x39: "CODECOPY", 0x3A: "GASPRICE", 0x3B: "EXTCODESIZE", 0x3C: "EXTCODECOPY",
    0x3D: "RETURNDATASIZE", 0x3E: "RETURNDATACOPY", 0x3F: "EXTCODEHASH", 0x40: "BLOCKHASH", 0x41: "COINBASE", 0x42: "TIMESTAMP",
    0x43: "NUMBER", 0x44: "PREVRANDAO", 0x45: "GASLIMIT", 0x46: "CHAINID", 0x47: "SELFBALANCE", 0x48: "BASEFEE", 0x50: "POP",
    0x51: "MLOAD", 0x52: "MSTORE", 0x53: "MSTORE8", 0x54: "SLOAD", 0x55: "SSTORE", 0x56: "JUMP", 0x57: "JUMPI", 0x58: "PC",
    0x59: "MSIZE", 0x5A: "GAS", 0x5B: "JUMPDEST", 0x5F: "PUSH0", 0xF0: "CREATE", 0xF1: "CALL", 0xF2: "CALLCODE", 0xF3: "RETURN",
    0xF4: "DELEGATECALL", 0xF5: "CREATE2", 0xFA: "STATICCALL", 0xFD: "REVERT", 0xFE: "INVALID", 0xFF: "SELFDESTRUCT",
}
OPCODES |= {0x5F + i: f"PUSH{i}" for i in range(1, 33)}
OPCODES |= {0x7F + i: f"DUP{i}" for i in range(1, 17)} | {0x8F + i: f"SWAP{i}" for i in range(1, 17)}
OPCODES |= {0xA0 + i: f"LOG{i}" for i in range(5)}
# Standard proxy slots and compiler metadata markers.
PROXY_SLOTS = {
    "eip1967_implementation_slot": "360894a13ba1a3210667c828492db98dca3e2076cc3735a920a3ca505d382bbc",
    "eip1967_admin_slot": "b53127684a568b3173ae13b9f8a6016e243e63b6e8ee1178d6a717850b5d6103",
    "eip1967_beacon_slot": "a3f0ad74e5423aebfd80d3ef4346578335a9a72aeaee59ff6cb3582b35133d50",
}
METADATA_MARKERS = ("a264697066735822", "a265627a7a72315820", "a165627a7a72305820")
MINIMAL_PROXY = "363d3d373d3d3d363d73"
# Signatures whose selectors are recognised, by function cluster.
SIGNATURES = (
    "admin()", "implementation()", "upgradeTo(address)", "upgradeToAndCall(address,bytes)", "changeAdmin(address)", "proxiableUUID()",
    "initialize()", "initialize(address)", "initialize(address,address)", "reinitialize(uint8)", "execute(address,uint256,bytes)",
    "execute(bytes)", "execute(bytes[])", "executeBatch(address[],uint256[],bytes[])", "multicall(bytes[])",
    "aggregate((address,bytes)[])", "call(address,uint256,bytes)", "delegatecall(address,bytes)",
    "transferFrom(address,address,uint256)", "safeTransferFrom(address,address,uint256)",
    "safeTransferFrom(address,address,uint256,bytes)", "approve(address,uint256)",
    "permit(address,address,uint256,uint256,uint8,bytes32,bytes32)", "claim()", "claim(address)", "claimReward(address)", "settle()",
    "settle(address)", "checkpoint()", "lzReceive(uint16,bytes,uint64,bytes)",
    "ccipReceive((bytes32,uint64,bytes,bytes,(address,uint256)[]))", "receiveMessage(bytes)", "processMessage(bytes)",
)
CLUSTERS = {
    "upgrade_admin": ("upgradeTo(", "upgradeToAndCall(", "changeAdmin(", "admin()", "implementation()", "proxiableUUID()",
                      "initialize(", "reinitialize("),
    "arbitrary_execution": ("execute(", "executeBatch(", "multicall(", "aggregate(", "call(address", "delegatecall("),
    "approval_spender": ("transferFrom(", "safeTransferFrom(", "approve(", "permit("),
    "bridge_receiver": ("lzReceive(", "ccipReceive(", "receiveMessage(", "processMessage("),
    "reward_settlement": ("claim(", "claimReward(", "settle(", "checkpoint("),
}

def _round_constants() -> list[int]:
    out, r = [], 1
    for _ in range(24):
        rc = 0
        for j in range(7):
            r = ((r << 1) ^ ((r >> 7) * 0x71)) % 256
            if r & 2:
                rc |= 1 << ((1 << j) - 1)
        out.append(rc)
    return out


_RC = _round_constants()


def _rot(v: np.ndarray, n: int) -> np.ndarray:
    return (v << np.uint64(n)) | (v >> np.uint64(64 - n)) if n else v


def _rho() -> list[tuple[int, int, int]]:
    """(x, y, rotation) of every lane."""
    out, x, y = [(0, 0, 0)], 1, 0
    for t in range(24):
        out.append((x, y, ((t + 1) * (t + 2) // 2) % 64))
        x, y = y, (2 * x + 3 * y) % 5
    return out


_RATE = 136
_ROTATIONS = _rho()
#: States that are permuted together; one lane of all of them stays in a core's cache.
LANES = 2048


def _permute(a: list[np.ndarray]) -> list[np.ndarray]:
    """One permutation of many states at once: a[x + 5 * y] holds lane (x, y) of all of them."""
    for rc in _RC:
        c = [a[x] ^ a[x + 5] ^ a[x + 10] ^ a[x + 15] ^ a[x + 20] for x in range(5)]
        d = [c[(x - 1) % 5] ^ _rot(c[(x + 1) % 5], 1) for x in range(5)]
        b: list[np.ndarray] = [a[0]] * 25
        for x, y, n in _ROTATIONS:
            b[y + 5 * ((2 * x + 3 * y) % 5)] = _rot(a[x + 5 * y] ^ d[x], n)
        a = [b[i] ^ (~b[i // 5 * 5 + (i + 1) % 5] & b[i // 5 * 5 + (i + 2) % 5]) for i in range(25)]
        a[0] ^= np.uint64(rc)
    return a


def _digests(padded: np.ndarray) -> list[str]:
    """Digests of the rows, padded messages of one length."""
    n, width = padded.shape
    words = padded.view("<u8").astype(np.uint64).reshape(n, width // _RATE, _RATE // 8)
    a = [np.zeros(n, np.uint64) for _ in range(25)]
    for block in range(words.shape[1]):
        for i in range(_RATE // 8):
            a[i] = a[i] ^ words[:, block, i]
        a = _permute(a)
    text = np.stack(a[:4], 1).astype("<u8").tobytes().hex()
    return [text[i : i + 64] for i in range(0, len(text), 64)]


def keccak256_all(messages: list[bytes]) -> list[str]:
    """Hex digests of messages: those of as many blocks go through the permutation together, as arrays of lanes."""
    out = [""] * len(messages)
    sizes: dict[int, list[int]] = {}
    for i, m in enumerate(messages):
        sizes.setdefault(len(m) // _RATE + 1, []).append(i)
    for blocks, at in sizes.items():
        step = max(1, LANES // blocks)
        for lo in range(0, len(at), step):
            some = at[lo : lo + step]
            padded = np.frombuffer(bytearray().join((messages[i] + b"\x01").ljust(blocks * _RATE, b"\0") for i in some), np.uint8).reshape(len(some), -1)
            padded[:, -1] |= 0x80
            for i, h in zip(some, _digests(padded)):
                out[i] = h
    return out


def keccak256(data: bytes) -> str:
    return keccak256_all([data])[0]


@F.pandas_udf(T.StringType())
def keccak_text(text: pd.Series) -> pd.Series:
    known = text.notna()
    out = pd.Series([None] * len(text), dtype=object)
    out[known.to_numpy()] = keccak256_all([s.encode() for s in text[known]])
    return out


@F.pandas_udf(T.StringType())
def keccak_hex(code: pd.Series) -> pd.Series:
    """0x-prefixed keccak256 of a hex string; '' for empty code."""
    hashes = iter(keccak256_all([bytes.fromhex(h) for h in code if h]))
    return pd.Series(["0x" + next(hashes) if h else "" for h in code], dtype=object)


_OP = T.ArrayType(T.StructType([
    T.StructField("pc", T.IntegerType()), T.StructField("opcode", T.IntegerType()), T.StructField("name", T.StringType()),
    T.StructField("push_data", T.StringType())]))


@F.pandas_udf(_OP)
def decode_opcodes(code: pd.Series) -> pd.Series:
    """PUSH-aware linear decode of one contract's code."""

    def one(h: str | None) -> list[dict]:
        out, i, h = [], 0, h or ""
        while i + 2 <= len(h):
            op = int(h[i:i + 2], 16)
            pc, i = i // 2, i + 2
            n = 2 * (op - 0x5F) if 0x60 <= op <= 0x7F else 0
            out.append({"pc": pc, "opcode": op, "name": OPCODES.get(op, f"UNKNOWN_{op:02x}"), "push_data": h[i:i + n]})
            i += n
        return out

    return code.map(one)


def normalize_bytecode(code: Column) -> Column:
    h = F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.coalesce(code, F.lit("")))), r"^0x", ""), r"[^0-9a-f]", "")
    return F.substring(h, F.lit(1), (F.length(h) - F.length(h) % 2).cast("int"))


def strip_metadata(code: Column) -> Column:
    """Cut at the earliest metadata marker that is not at the very start."""
    at = F.least(*[F.when(F.instr(code, m) > 1, F.instr(code, m)) for m in METADATA_MARKERS])
    return F.when(at.isNotNull(), F.substring(code, F.lit(1), at - 1)).otherwise(code)


def minimal_proxy_target(code: Column) -> Column:
    addr = F.regexp_extract(code, MINIMAL_PROXY + r"([0-9a-f]{40})", 1)
    return F.when((addr != "") & ~addr.rlike("^0+$"), F.concat(F.lit("0x"), addr))


def address_word(raw: Column) -> Column:
    """Address in the low 20 bytes of a 32-byte word; null for zero or short words."""
    h = F.replace(F.lower(F.coalesce(raw, F.lit(""))), F.lit("0x"), F.lit(""))
    a = F.substring(h, 25, 40)
    return F.when((F.length(h) >= 64) & ~a.rlike("^0+$"), F.concat(F.lit("0x"), a))


def address_array(raw: Column) -> Column:
    """ABI-encoded address[]; a length beyond the data ends with the data."""
    h = F.replace(F.lower(F.coalesce(raw, F.lit(""))), F.lit("0x"), F.lit(""))
    off = (F.conv(F.substring(h, 1, 64), 16, 10).cast("int") * 2)
    n = F.least(F.conv(F.substring(h, off + 1, F.lit(64)), 16, 10).cast("decimal(20,0)"), F.floor((F.length(h) - off - 64) / 64).cast("decimal(20,0)")).cast("int")
    words = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: address_word(F.substring(h, off + 1 + 64 * i, F.lit(64))))
    return F.when((F.length(h) >= 128) & (n > 0), F.array_compact(words)).otherwise(F.array().cast("array<string>"))
