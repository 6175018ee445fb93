"""Decryption of PDF files that open without a password: the standard security handler, with RC4 and AES."""

from __future__ import annotations

import hashlib

import numpy as np

# What fills up a password, and the word in the keys of AES.
PADDING = bytes.fromhex("28BF4E5E4E758A4164004E56FFFA01082E2E00B6D0683E802F0CA9FE6453697A")
SALT = b"sAlT"


def rc4(key: bytes, data: bytes) -> bytes:
    s, j = list(range(256)), 0
    for i in range(256):
        j = (j + s[i] + key[i % len(key)]) & 255
        s[i], s[j] = s[j], s[i]
    i = j = 0
    stream = bytearray(len(data))
    for k in range(len(data)):
        i = (i + 1) & 255
        a = s[i]
        j = (j + a) & 255
        b = s[i] = s[j]
        s[j] = a
        stream[k] = s[(a + b) & 255]
    return (np.frombuffer(data, np.uint8) ^ np.frombuffer(bytes(stream), np.uint8)).tobytes()


def _times(a: int, b: int) -> int:
    """The product in the field of 2^8 elements of AES."""
    out = 0
    while b:
        out ^= a if b & 1 else 0
        a = (a << 1) ^ (0x11B if a & 128 else 0)
        b >>= 1
    return out


def _tables() -> tuple[np.ndarray, np.ndarray, dict[int, np.ndarray]]:
    """The substitution, its inverse, and products with the numbers that mix columns and part them."""
    box = np.zeros(256, np.uint8)
    for x in range(256):
        inverse = next((y for y in range(1, 256) if _times(x, y) == 1), 0)
        turned = inverse
        for k in range(1, 5):
            turned ^= (inverse << k | inverse >> (8 - k)) & 255
        box[x] = turned ^ 0x63
    back = np.zeros(256, np.uint8)
    back[box] = np.arange(256, dtype=np.uint8)
    return box, back, {n: np.array([_times(x, n) for x in range(256)], np.uint8) for n in (2, 3, 9, 11, 13, 14)}


_cached: list = []


def _own_tables():
    if not _cached:
        _cached.append(_tables())
    return _cached[0]


#: The place that each byte of a block comes from when its rows are shifted back.
_UNSHIFT = np.array([(c - r) % 4 * 4 + r for c in range(4) for r in range(4)])


def _round_keys(key: bytes) -> np.ndarray:
    box, n = _own_tables()[0], len(key) // 4
    words, constant = [list(key[4 * k : 4 * k + 4]) for k in range(n)], 1
    for k in range(n, 4 * (n + 7)):
        w = list(words[-1])
        if k % n == 0:
            w = [int(box[x]) for x in w[1:] + w[:1]]
            w[0] ^= constant
            constant = _times(constant, 2)
        elif n > 6 and k % n == 4:
            w = [int(box[x]) for x in w]
        words.append([a ^ b for a, b in zip(words[k - n], w, strict=True)])
    return np.array(words, np.uint8).reshape(-1, 16)


def _mix(blocks: np.ndarray, factors: tuple[int, int, int, int]) -> np.ndarray:
    by = _own_tables()[2]
    columns = blocks.reshape(-1, 4, 4)
    out = np.zeros_like(columns)
    for r in range(4):
        for k in range(4):
            out[:, :, r] ^= by[factors[(k - r) % 4]][columns[:, :, k]]
    return out.reshape(-1, 16)


def decrypt_blocks(key: bytes, blocks: np.ndarray) -> np.ndarray:
    """Blocks of 16 bytes, each on its own."""
    keys, back = _round_keys(key), _own_tables()[1]
    state = blocks ^ keys[-1]
    for k in range(len(keys) - 2, 0, -1):
        state = _mix(back[state[:, _UNSHIFT]] ^ keys[k], (14, 11, 13, 9))
    return back[state[:, _UNSHIFT]] ^ keys[0]


def _mixed() -> list[list[int]]:
    """For each place in a column, the column that a byte there becomes when it is substituted and mixed."""
    if len(_cached) < 2:
        box, _, by = _own_tables()
        first = [int.from_bytes(bytes((by[2][v], v, v, by[3][v])), "big") for v in box.tolist()]
        _cached.append([[(x >> 8 * r | x << 32 - 8 * r) & 0xFFFFFFFF for x in first] for r in range(4)])
    return _cached[1]


def encrypt_chain(key: bytes, start: bytes, data: bytes) -> bytes:
    """data, of whole blocks, each of which goes into the next one: columns as numbers, as blocks can't be done together."""
    keys = [[int.from_bytes(k[4 * c : 4 * c + 4].tobytes(), "big") for c in range(4)] for k in _round_keys(key)]
    t0, t1, t2, t3 = _mixed()
    box, out, (last, *rest) = _own_tables()[0].tolist(), bytearray(), keys
    *middle, end = rest
    a, b, c, d = (int.from_bytes(start[4 * k : 4 * k + 4], "big") for k in range(4))
    for at in range(0, len(data), 16):
        a, b, c, d = (x ^ int.from_bytes(data[at + 4 * k : at + 4 * k + 4], "big") ^ last[k] for k, x in enumerate((a, b, c, d)))
        for k in middle:
            a, b, c, d = (
                t0[a >> 24] ^ t1[b >> 16 & 255] ^ t2[c >> 8 & 255] ^ t3[d & 255] ^ k[0], t0[b >> 24] ^ t1[c >> 16 & 255] ^ t2[d >> 8 & 255] ^ t3[a & 255] ^ k[1],
                t0[c >> 24] ^ t1[d >> 16 & 255] ^ t2[a >> 8 & 255] ^ t3[b & 255] ^ k[2], t0[d >> 24] ^ t1[a >> 16 & 255] ^ t2[b >> 8 & 255] ^ t3[c & 255] ^ k[3],
            )
        words = (a, b, c, d)
        a, b, c, d = (
            (box[words[k] >> 24] << 24 | box[words[(k + 1) % 4] >> 16 & 255] << 16 | box[words[(k + 2) % 4] >> 8 & 255] << 8 | box[words[(k + 3) % 4] & 255]) ^ end[k] for k in range(4)
        )
        for x in (a, b, c, d):
            out += x.to_bytes(4, "big")
    return bytes(out)


def decrypt_chain(key: bytes, start: bytes, data: bytes) -> bytes:
    """The inverse, for all blocks at once; a broken last block is left out."""
    blocks = np.frombuffer(data[: len(data) // 16 * 16], np.uint8).reshape(-1, 16)
    if not len(blocks):
        return b""
    before = np.concatenate([np.frombuffer(start, np.uint8)[None], blocks[:-1]])
    return (decrypt_blocks(key, blocks) ^ before).tobytes()


def _hash(salt: bytes, revision: int) -> bytes:
    """The hash of the empty password with a salt."""
    k = hashlib.sha256(salt).digest()
    if revision < 6:
        return k
    done = 0
    while True:
        e = encrypt_chain(k[:16], k[16:32], k * 64)
        k = (hashlib.sha256, hashlib.sha384, hashlib.sha512)[sum(e[:16]) % 3](e).digest()
        done += 1
        if done >= 64 and e[-1] <= done - 32:
            return k[:32]


class Locked(Exception):
    """A file that asks for a password, or is encrypted in another way."""


class Key:
    """The key of a file that opens without a password. head: its encryption dictionary, resolved; ident: its first id."""

    def __init__(self, head: dict, ident: bytes) -> None:
        version, self.revision = head.get("V", 0), head.get("R", 0)
        owner, user = head.get("O"), head.get("U")
        if head.get("Filter") != "Standard" or version not in (1, 2, 4, 5) or not isinstance(owner, bytes) or not isinstance(user, bytes):
            raise Locked
        filters = head.get("CF") or {}
        kind = lambda name: (filters.get(head.get(name, "Identity")) or {}).get("CFM", "None") if version >= 4 else "V2"
        self.streams, self.strings = kind("StmF"), kind("StrF")
        if version == 5:
            if _hash(user[32:40], self.revision) != user[:32]:
                raise Locked
            self.key = decrypt_chain(_hash(user[40:48], self.revision), bytes(16), head.get("UE") or b"")
            return
        size = 5 if version == 1 or self.revision < 3 else 16 if version == 4 else max(5, min(16, head.get("Length", 40) // 8))
        data = PADDING + owner[:32] + (head.get("P", 0) & 0xFFFFFFFF).to_bytes(4, "little") + ident
        if self.revision >= 4 and head.get("EncryptMetadata") is False:
            data += b"\xff" * 4
        key = hashlib.md5(data).digest()[:size]
        for _ in range(50 if self.revision >= 3 else 0):
            key = hashlib.md5(key).digest()[:size]
        self.key = key
        if self.revision < 3:
            fits = rc4(key, PADDING) == user[:32]
        else:
            own = hashlib.md5(PADDING + ident).digest()
            for k in range(20):
                own = rc4(bytes(b ^ k for b in key), own)
            fits = own == user[:16]
        if not fits:
            raise Locked

    def plain(self, data: bytes, number: int, generation: int, kind: str) -> bytes:
        """The bytes of a string or stream of an object; kind: self.strings or self.streams."""
        if kind not in ("V2", "AESV2", "AESV3"):
            return data
        key = self.key
        if kind != "AESV3":
            own = key + number.to_bytes(4, "little")[:3] + generation.to_bytes(4, "little")[:2] + (SALT if kind == "AESV2" else b"")
            key = hashlib.md5(own).digest()[: min(16, len(key) + 5)]
        if kind == "V2":
            return rc4(key, data)
        out = decrypt_chain(key, data[:16], data[16:]) if len(data) > 16 else b""
        return out[: -out[-1]] if out and 0 < out[-1] <= 16 else out
