"""Where nodes move: losses of all candidates of many nodes at once, from sums by level of the tree instead of look-ups by candidate.

Let m be the tree distance of a link in one dimension. A candidate at level l (its highest flipped bit) is at distance l from the neighbour
if l > m and at m if l < m, whatever its lower bits are; only at l = m do they count. So a node's losses are, for each dimension and level, one
sum over the links that branch off elsewhere, shared by all candidates of the level, and a sum for each candidate over the links that branch
off just there: height + candidates per level look-ups for a link and dimension, where each candidate by itself took their product. A
distance takes at most height * dims + 1 values, so links of one kind and normaliser share a short table of losses.
"""

from __future__ import annotations

import hashlib

import numpy as np

from ..functions.columns import selected

#: Links that are worked on together, and nodes whose candidates are made together.
LINKS, NODES = 4096, 256
_SHORT = 16
#: Bit lengths of all numbers below 2^16.
_LENGTHS = np.frexp(np.arange(1 << _SHORT).astype(np.float64))[1].astype(np.int8)


def lengths(x: np.ndarray, height: int) -> np.ndarray:
    """Bit lengths of numbers below 2^height."""
    if height <= _SHORT:
        return _LENGTHS[x]
    return np.frexp(x.astype(np.float64))[1].astype(np.int8)


def counter(*parts) -> int:
    """The twin of draw() in Python."""
    return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:13], 16)


#: MD5 as its standard gives it: shifts of the four rounds, sines, and the word that each of the 64 steps adds.
_TURNS = np.repeat([[7, 12, 17, 22], [5, 9, 14, 20], [4, 11, 16, 23], [6, 10, 15, 21]], 4, axis=0).reshape(-1).astype(np.uint32)
_SINES = np.floor(np.abs(np.sin(np.arange(1, 65))) * 2.0**32).astype(np.uint64).astype(np.uint32)
_LEFT, _RIGHT = ([np.asarray(t) for t in turns] for turns in (_TURNS, np.uint32(32) - _TURNS))
_WORDS = [(a * i + b) % 16 for a, b in ((1, 0), (5, 1), (3, 5), (7, 0)) for i in range(16)]
_STATE = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
#: Digests made together, so that their words stay in a core's cache.
_TOGETHER = 1 << 14


def counters(heads: list[str], tails: list[str]) -> np.ndarray:
    """counter() of each head followed by each tail (heads, tails), in numpy: texts of one length differ in few words of MD5's only block."""
    out = np.empty((len(heads), len(tails)), np.int64)
    heads, tails = [x.encode() for x in heads], [x.encode() for x in tails]
    of = lambda texts: {n: np.flatnonzero(np.array([len(x) for x in texts]) == n) for n in {len(x) for x in texts}}
    ends = of(tails)
    for a, rows in of(heads).items():
        for b, columns in ends.items():
            if a + b > 55:  # more than one block
                for i in rows:
                    out[i, columns] = [int(hashlib.md5(heads[i] + tails[j]).hexdigest()[:13], 16) for j in columns]
                continue
            x, y = np.zeros((len(rows), 64), np.uint8), np.zeros((len(columns), 64), np.uint8)
            x[:, :a] = np.frombuffer(b"".join(heads[i] for i in rows), np.uint8).reshape(len(rows), a)
            y[:, a : a + b] = np.frombuffer(b"".join(tails[j] for j in columns), np.uint8).reshape(len(columns), b)
            y[:, a + b], y[:, 56], y[:, 57] = 128, (a + b) * 8 % 256, (a + b) * 8 // 256
            x, y = x.view("<u4"), y.view("<u4")
            wide = min(len(columns), _TOGETHER)
            for j in range(0, len(columns), wide):
                for i in range(0, len(rows), max(1, _TOGETHER // wide)):
                    at = slice(i, i + max(1, _TOGETHER // wide)), slice(j, j + wide)
                    out[np.ix_(rows[at[0]], columns[at[1]])] = _digests(x[at[0]], y[at[1]])
    return out


def consecutive(head: str, low: int, high: int) -> np.ndarray:
    """counter() of the text head followed by each number from low to high, both multiples of 1000; texts of one block of MD5."""
    out = np.empty((high // 1000 - low // 1000, 1000), np.int64)
    if not low and high:
        out[0] = counters([head], [str(i) for i in range(1000)])[0]
    room, together = np.empty((6, 32, 1000), np.uint32), 32  # made once: new arrays of this size cost more than the sums
    q = max(1, low // 1000)
    while q < high // 1000:
        end = min(high // 1000, 10 ** len(str(q)))  # numbers of one length
        heads, n = [f"{head}{t}".encode() for t in range(q, end)], len(f"{head}{q}") + 3
        x, y = np.zeros((end - q, 64), np.uint8), np.zeros((1000, 64), np.uint8)
        x[:, : n - 3] = np.frombuffer(b"".join(heads), np.uint8).reshape(end - q, n - 3)
        y[:, n - 3 : n] = np.frombuffer(b"".join(b"%03d" % i for i in range(1000)), np.uint8).reshape(1000, 3)
        y[:, n], y[:, 56], y[:, 57] = 128, n * 8 % 256, n * 8 // 256
        x, y = x.view("<u4"), y.view("<u4")
        for i in range(0, end - q, together):
            some = x[i : i + together]
            _digests(some, y, room[:, : len(some)], out[q - low // 1000 + i :][: len(some)])
        q = end
    return out.reshape(-1)


def _digests(x: np.ndarray, y: np.ndarray, room: np.ndarray | None = None, out: np.ndarray | None = None) -> np.ndarray:
    """The first 52 bits of the MD5 of blocks x | y, for each row of x (16 words) and each of y. room: six arrays of that shape to work in."""
    alike = (x == x[:1]).all(axis=0) & (y == y[:1]).all(axis=0)  # words that all texts share are numbers, not arrays
    words = [x[0, k] | y[0, k] if alike[k] else x[:, None, k] | y[None, :, k] if x[:, k].any() and y[:, k].any() else x[:, None, k] if x[:, k].any() else y[None, :, k] for k in range(16)]
    a, b, c, d, f, g = np.empty((6, len(x), len(y)), np.uint32) if room is None else room
    for v, start in zip((a, b, c, d), _STATE, strict=True):
        v.fill(start)
    xor, both, either, plus, left, right = np.bitwise_xor, np.bitwise_and, np.bitwise_or, np.add, np.left_shift, np.right_shift
    with np.errstate(over="ignore"):
        added = [np.asarray(words[k] + sine) for k, sine in zip(_WORDS, _SINES, strict=True)]
    for i in range(64):  # results go to the third argument
        if i < 16:  # d ^ (b & (c ^ d))
            xor(c, d, f)
            both(f, b, f)
            xor(f, d, f)
        elif i < 32:  # c ^ (d & (b ^ c))
            xor(b, c, f)
            both(f, d, f)
            xor(f, c, f)
        elif i < 48:
            xor(b, c, f)
            xor(f, d, f)
        else:
            np.invert(d, f)
            either(f, b, f)
            xor(f, c, f)
        plus(f, a, f)
        plus(f, added[i], f)
        left(f, _LEFT[i], g)
        right(f, _RIGHT[i], f)
        either(f, g, f)
        plus(f, b, a)
        a, b, c, d = d, a, b, c
    out = np.empty(a.shape, np.int64) if out is None else out
    for v, start in ((a, _STATE[0]), (b, _STATE[1])):
        v += np.uint32(start)
        v.byteswap(inplace=True)
    out[...] = a
    out <<= 20
    b >>= 12
    out |= b
    return out


def scrambled(x: np.ndarray) -> np.ndarray:
    """Pseudo-random 64-bit numbers of consecutive ones: the finaliser of SplitMix64 (fixed values)."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def candidates_of(nodes: np.ndarray, z: np.ndarray, cfg, epoch: int, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Candidates (nodes, height, per level, dims) but for the place where a node is, and the rank (nodes, candidates) by which equal losses are settled."""
    h, k, dims, n = cfg.height, cfg.per_level, z.shape[1], cfg.candidates
    if cfg.portable:
        low = counters([f"{cfg.seed}|m|{name}|{epoch}|{node}|" for node in nodes.tolist()], [f"{i}|{t}" for i in range(n - 1) for t in range(dims)]).reshape(len(nodes), h, k, dims)
        tie = counters([f"{cfg.seed}|tie|{epoch}|{node}|" for node in nodes.tolist()], [str(i) for i in range(n)])
    else:
        salt = scrambled(np.array([counter(cfg.seed, name, epoch)]))
        own = scrambled(nodes.astype(np.int64).view(np.uint64) ^ salt)[:, None]
        wide = np.uint16 if h <= 16 else np.uint32 if h <= 32 else np.uint64  # several small numbers of each drawn one
        words = -(-(n - 1) * dims * np.dtype(wide).itemsize // 8)
        with np.errstate(over="ignore"):
            drawn = scrambled(own + np.arange(words + n, dtype=np.uint64))
        low = np.ascontiguousarray(drawn[:, :words]).view(wide)[:, : (n - 1) * dims].reshape(len(nodes), h, k, dims)
        low = low.astype(np.int32 if h <= 30 else np.int64)
        tie = drawn[:, words:]
    z = z.astype(low.dtype)
    flip = (1 << np.arange(h, dtype=low.dtype))[:, None, None]
    return z[:, None, None, :] ^ flip ^ (low & (flip - 1)), np.argsort(np.argsort(tie, axis=1, kind="stable"), axis=1).astype(np.int16 if n < 1 << 15 else np.int64)


def loss_tables(key: np.ndarray, n12: np.ndarray, n21: np.ndarray, cfg) -> tuple[np.ndarray, np.ndarray]:
    """coded_tables of kinds by name."""
    return coded_tables(*np.unique(key, return_inverse=True), n12, n21, cfg)


def coded_tables(kinds: list[str] | np.ndarray, key_at: np.ndarray, n12: np.ndarray, n21: np.ndarray, cfg) -> tuple[np.ndarray, np.ndarray]:
    """Losses by distance (in steps of 1 / dims) of each distinct kind and normalisers, and each link's row of them. key_at: each link's place in kinds."""
    (v12, at12), (v21, at21) = (np.unique(n, return_inverse=True) for n in (n12, n21))
    codes, row = np.unique((key_at * len(v12) + at12) * len(v21) + at21, return_inverse=True)
    kind_of, n12, n21 = codes // (len(v12) * len(v21)), v12[codes // len(v21) % len(v12)], v21[codes % len(v21)]
    power = (np.arange(cfg.height * cfg.dims + 1) / cfg.dims + cfg.eps) ** cfg.gamma / cfg.alpha

    def probability(norm: np.ndarray) -> np.ndarray:
        """Of each normaliser and distance; a power of each of them, none of both."""
        with np.errstate(divide="ignore"):
            return np.where(norm > 0, 1 / (1 + power * (norm**-cfg.gamma)), 0.0)

    tables = np.empty((len(codes), len(power)))
    for i, kind in enumerate(kinds):
        of = kind_of == i
        p12, p21 = (probability(n[of, None]) if kind not in without else None for n, without in ((n12, ("in", "not_in")), (n21, ("out", "not_out"))))
        tables[of] = -np.log(cfg.eps + selected(kind, p12, p21))
    return tables, row.reshape(-1)


def level_sums(at: np.ndarray, z: np.ndarray, other: np.ndarray, y: np.ndarray, tables: np.ndarray, row: np.ndarray, cand: np.ndarray, height: int) -> np.ndarray:
    """Summed losses (nodes, 2, candidates, dims): at 0 those of negatives, at 1 those of links, the node's own place last.

    at: each link's node; z: the nodes' places; other: the links' far ends; y: 1 for a link, 0 for a negative; row: the links' rows of tables.
    """
    nodes, h, k, dims = cand.shape
    m = lengths(z[at] ^ other, height).astype(np.int64)
    total = m.sum(axis=1)
    rest = total[:, None] - m
    group = at * 2 + y
    line = row * tables.shape[1]
    flat = tables.reshape(-1)
    now = flat[line + total]
    size = 2 * nodes * dims
    cell = group[:, None] * dims + np.arange(dims)
    # By level: links that branch off above keep their loss, those that branch off below are all at the level.
    branch = np.bincount((m * size + cell).reshape(-1), np.repeat(now, dims), (h + 1) * size).reshape(h + 1, size)
    above = branch.sum(axis=0) - np.cumsum(branch, axis=0)
    shift = (line[:, None] + rest).reshape(-1)
    m, cell = m.reshape(-1), cell.reshape(-1)
    times = h - m  # each link of a dimension, once for every level above its own
    every = np.repeat(np.arange(len(m)), times)
    level = np.arange(len(every)) - np.repeat(np.cumsum(times) - times - m, times)
    below = np.bincount(level * size + cell[every], flat[shift[every] + level + 1], h * size).reshape(h, size)
    sums = (above[1:] + below).reshape(h, 2 * nodes, dims)
    # Links that branch off at a candidate's own level are looked up for each candidate.
    some = np.flatnonzero(m)
    level = m[some] - 1
    rows = np.ascontiguousarray(cand.transpose(0, 1, 3, 2)).reshape(-1, k)  # a node's candidates of a level and dimension together
    near = rows[(np.repeat(at, dims)[some] * h + level) * dims + some % dims]
    near ^= other.reshape(-1)[some, None].astype(near.dtype)
    loss = flat[shift[some, None] + lengths(near, height)]
    place = ((group[some // dims] * h + level) * dims + some % dims) * k
    own = np.bincount((place[:, None] + np.arange(k)).reshape(-1), loss.reshape(-1), size * h * k).reshape(2 * nodes, h, dims, k)
    sums = own.transpose(0, 1, 3, 2) + sums.transpose(1, 0, 2)[:, :, None]
    here = np.bincount(group, now, 2 * nodes)
    here = np.broadcast_to(here[:, None, None], (2 * nodes, 1, dims))
    return np.concatenate([sums.reshape(2 * nodes, h * k, dims), here], axis=1).reshape(nodes, 2, h * k + 1, dims)


def settle(z: np.ndarray, cand: np.ndarray, rank: np.ndarray, sums: np.ndarray, cnt: np.ndarray, weight: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Where nodes move, and the mean losses (total, links, negatives) there."""
    nodes, h, k, dims = cand.shape
    every = np.concatenate([cand.reshape(nodes, h * k, dims), z[:, None, :]], axis=1)
    neg, pos = (sums[:, i] / cnt[:, None, None] for i in (0, 1))
    total = weight * pos + neg
    rounded = np.round(total, 9)
    ties = rounded == rounded.min(axis=1, keepdims=True)
    best = np.where(ties, rank[:, :, None], h * k + 1).argmin(axis=1)[:, None, :]
    at = lambda x: np.take_along_axis(x, best, axis=1)[:, 0]
    return at(every), at(total).mean(axis=1), at(pos).mean(axis=1), at(neg).mean(axis=1)
