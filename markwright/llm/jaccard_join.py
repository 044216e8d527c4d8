"""N-gram Jaccard join by grouped prefixes (operator 6).

Every text becomes the set of its distinct 5-word shingles (64-bit hashes; 1e8
distinct shingles collide with probability 3e-4). The global token order
puts frequent shingles last, so prefixes hold the rare ones; a pair with
Jaccard >= t must share a token among the first ``n - ceil(t n) + 1`` of each.

1. ``counted``   sizes, and shingles that recur within a task's texts, summed.
2. ``indexed``   documents with equal prefix and size form one group; each
   group's prefix goes to shards as packed arrays. Tokens known to be
   frequent go as rows and are pre-aggregated instead.
3. ``candidates``  tokens in one group only vanish in their shard. Small
   buckets give their pairs, larger ones a star around the least member of each
   length class.
4. Group pairs pass the length filter and expand to the groups' distinct sets.
   Parity bitmaps of four to eight bits a shingle bound each pair's overlap from
   above (differing bits need differing shingles); what the bound can't rule
   out is verified exactly on the texts.
5. Buckets split by length class (sizes that may link lie in one class or two
   neighbours). Those whose members are not yet in one component are merged by
   two minhashes of their members, as the tokens of a shared passage have nearly
   the same ones, and compared in tasks of two blocks of members: only pairs
   that cross components, and that lengths and small bitmaps (one to two bits a
   shingle) allow, come out and are verified. A pair within a component can't change it, so the components equal
   those of all pairs, and a group of m near copies costs O(m) verified pairs,
   not m^2. Merging adds comparisons and loses none.

The first common token of a linking pair, in the global order, lies in the smaller
set among the first ``n - ceil(2t / (1 + t) n) + 1`` even (its *short* prefix), as the
overlap is at least ``2t / (1 + t)`` of the smaller size. So a bucket needs to
compare a member only with smaller ones that hold the token in their short prefix.

Nulls and empty texts have no shingles (``n_shingles`` 0) and link with nothing.
A null doc_id keeps its row with a null component. Rows that repeat a
doc_id are one node with the links of all its texts. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches, blocks, longs, remembered, utf8, written
from .components import components
from .textops import shingles, span_hashes, word_spans

FLUSH = 2_000_000  # hashes a task holds before it sorts and emits them
LOCAL = 4  # a shingle in so many distinct sets of one task's flush is reported as frequent
MOST_FREQUENT = 1_000_000  # bound of the frequent list that is broadcast (16 MB)
SMALL = 8  # buckets up to here give all their (at most 28) pairs at once
SHARD_ROWS = 2_000_000  # tokens that one task sorts at once
BLOCK = 512  # members of a large bucket that are compared with as many at once
SALT = 16  # parts that a bucket's rows are dealt to when they meet the bucket's own row
BROADCAST_IDS = 2_000_000  # ids broadcast to filter texts; beyond it the filter is a shuffled join


def sets_of(batch: pa.RecordBatch, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of every text of a batch."""
    buf, off = utf8(batch.column("text"))
    for i, j in blocks(off):
        s, e, first = word_spans(buf, off[i : j + 1])
        h = span_hashes(buf, s, e, fold=True)
        for k in range(j - i):
            yield i + k, np.unique(shingles(h[first[k] : first[k + 1]], size))


def _fingerprint(u: np.ndarray) -> bytes:
    return hashlib.blake2b(u.tobytes(), digest_size=16).digest()


def parity_bits(u: np.ndarray, per: int = 4) -> bytes:
    """A bitmap of at least ``per`` bits a shingle in which every shingle flips one bit."""
    size = 1 << max(6, int(per * len(u) - 1).bit_length())
    odd = np.bincount((u >> np.uint64(20) & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def most_shared(n: int, m: int, x: bytes, y: bytes) -> int:
    """Upper bound of the overlap of two sets of n and m shingles from their bitmaps."""
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    while len(a) > len(b):  # a wider bitmap folds to half its width
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return (n + m - int(np.bitwise_count(a ^ b).sum())) // 2


def prefix_length(n: int, percent: int) -> int:
    return n - (percent * n + 99) // 100 + 1


def short_length(n: int, percent: int) -> int:
    """Places of the prefix in which a set's first common token with a larger one lies."""
    return n - -(-2 * percent * n // (100 + percent)) + 1


def _length_class(n: Column, percent: int) -> Column:
    """Sets that may link have the same class or neighbouring ones (the base is a little wider than the ratio for rounding)."""
    return F.floor(F.log(n) / math.log(100 / percent * 1.0001)).cast("int")


def _counted(size: int):
    def run(parts):
        remembered("jaccard_join")
        held: list[np.ndarray] = []
        seen: set[bytes] = set()
        n_held = total = 0

        def flush():
            tok, cnt = np.unique(np.concatenate(held), return_counts=True)
            keep = cnt >= LOCAL
            return pa.table({"token": tok[keep].view(np.int64), "cnt": cnt[keep].astype(np.int64)})

        for batch in parts:
            for _, u in sets_of(batch, size):
                total += len(u)
                if not len(u) or (fp := _fingerprint(u)) in seen:
                    continue
                seen.add(fp)
                held.append(u)
                n_held += len(u)
                if n_held >= FLUSH:
                    yield from batches(flush())
                    held, n_held, seen = [], 0, set()
        if held:
            yield from batches(flush())
        yield pa.RecordBatch.from_pydict({"token": pa.array([None], pa.int64()), "cnt": pa.array([total], pa.int64())})

    return run


INDEX = "kind int, doc_id long, n int, fp binary, bits binary, small binary, gkey long, token long, short boolean, shard int, data binary"
_INDEX = pa.schema(
    [("kind", pa.int32()), ("doc_id", pa.int64()), ("n", pa.int32()), ("fp", pa.binary()), ("bits", pa.binary()), ("small", pa.binary()), ("gkey", pa.int64()), ("token", pa.int64()), ("short", pa.bool_()), ("shard", pa.int32()), ("data", pa.binary())]
)


def _rows(kind: int, **columns) -> Iterator[pa.RecordBatch]:
    n = len(next(iter(columns.values())))
    full = {f.name: pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in _INDEX}
    full["kind"] = pa.array(np.full(n, kind, np.int32))
    yield from batches(pa.table(full, schema=_INDEX))


def _pack(tok: np.ndarray, gk: np.ndarray, short: np.ndarray) -> bytes:
    """Tokens of one shard with their groups: 48 bits of each token (equal ones are candidates only, so a collision costs a check), places in the list of groups, flags."""
    own, at = np.unique(gk, return_inverse=True)
    at = at.astype(np.uint16 if len(own) <= 65536 else np.uint32)
    head = np.array([len(tok), len(own)], np.int64)
    return b"".join(x.tobytes() for x in (head, own, (tok >> np.uint64(32)).astype(np.uint32), at, (tok >> np.uint64(16)).astype(np.uint16), np.packbits(short)))


def _unpack(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, g = (int(x) for x in np.frombuffer(raw, np.int64, 2))
    place = 16

    def take(kind, k):
        nonlocal place
        out = np.frombuffer(raw, kind, k, place)
        place += out.nbytes
        return out

    own, high = take(np.int64, g), take(np.uint32, n)
    at, low = take(np.uint16 if g <= 65536 else np.uint32, n), take(np.uint16, n)
    tok = (high.astype(np.uint64) << np.uint64(32)) | (low.astype(np.uint64) << np.uint64(16))
    return tok, own[at], np.unpackbits(take(np.uint8, (n + 7) // 8), count=n).astype(bool)


def _indexed(size: int, percent: int, frequent, shards: int):
    def run(parts):
        remembered("jaccard_join")
        freq_tok, freq_cnt = frequent.value
        tokens: list[np.ndarray] = []
        owners: list[tuple[int, int, int]] = []  # group, its tokens here, how many of them are in the short prefix
        often: list[tuple[np.ndarray, int, int]] = []
        known: set[int] = set()
        held = 0

        def flush():
            if tokens:
                tok = np.concatenate(tokens)
                gk = np.repeat(np.array([g for g, _, _ in owners], np.int64), [c for _, c, _ in owners])
                short = np.concatenate([np.arange(c) < k for _, c, k in owners])
                part = (tok & np.uint64(shards - 1)).astype(np.int32)
                order = np.argsort(part.astype(np.uint16) if shards <= 65536 else part, kind="stable")
                tok, gk, short, part = tok[order], gk[order], short[order], part[order]
                edge = np.flatnonzero(np.diff(part, prepend=-1, append=-1))
                for a, b in zip(edge[:-1], edge[1:], strict=True):
                    yield from _rows(1, shard=part[a : a + 1], data=[_pack(tok[a:b], gk[a:b], short[a:b])])
            if often:
                gk = np.repeat(np.array([g for _, g, _ in often], np.int64), [len(t) for t, _, _ in often])
                yield from _rows(2, token=np.concatenate([t for t, _, _ in often]).view(np.int64), gkey=gk, short=np.concatenate([np.arange(len(t)) < k for t, _, k in often]))

        for batch in parts:
            ids, valid = longs(batch.column("doc_id")), batch.column("doc_id").is_valid()
            n_row, gkeys = np.zeros(len(batch), np.int32), np.zeros(len(batch), np.int64)
            fps, bits, small = ([None] * len(batch) for _ in range(3))
            for row, u in sets_of(batch, size):
                n = n_row[row] = len(u)
                if not n:
                    continue
                common = np.zeros(n, bool)
                if len(freq_tok):
                    at = np.minimum(np.searchsorted(freq_tok, u), len(freq_tok) - 1)
                    common = freq_tok[at] == u
                rare, p = u[~common], prefix_length(n, percent)
                pre = rare[:p]
                late = u[:0]
                if len(pre) < p:
                    late = u[common]
                    late = late[np.lexsort((late, freq_cnt[at[common]]))][: p - len(pre)]
                g = xxhash.xxh3_64_intdigest(pre.tobytes() + b"|" + late.tobytes(), seed=int(n)) >> 1
                fps[row], bits[row], small[row], gkeys[row] = _fingerprint(u), parity_bits(u), parity_bits(u, 1), g
                if not valid[row].as_py() or g in known:
                    continue
                known.add(g)
                k = short_length(n, percent)
                if len(pre):
                    tokens.append(pre)
                    owners.append((g, len(pre), k))
                if len(late):
                    often.append((late, g, k - len(pre)))
                held += p
                if held >= FLUSH:
                    yield from flush()
                    tokens, owners, often, known, held = [], [], [], set(), 0
            full = {"kind": pa.array(np.zeros(len(batch), np.int32)), "doc_id": pc.cast(batch.column("doc_id"), pa.int64()), "n": pa.array(n_row), "fp": pa.array(fps, pa.binary()), "bits": pa.array(bits, pa.binary()), "small": pa.array(small, pa.binary()), "gkey": pa.array(gkeys, mask=n_row == 0)}
            yield pa.RecordBatch.from_arrays([full.get(f.name, pa.nulls(len(batch), f.type)) for f in _INDEX], schema=_INDEX)
        yield from flush()

    return run


def _shard(table: pa.Table) -> pa.Table:
    """Candidate pairs (kind 0: a, b) and larger buckets (kind 1: token, group, short) of one shard."""
    got = [_unpack(x.as_py()) for x in table.column("data")]
    tok, gk, short = (np.concatenate([x[i] for x in got]) for i in range(3))
    order = np.argsort(tok, kind="stable")
    tok, gk, short = tok[order], gk[order], short[order]
    same = np.zeros(len(tok) + 1, bool)
    same[1:-1] = tok[1:] == tok[:-1]
    keep = same[:-1] | same[1:]
    tok, gk, short = tok[keep], gk[keep], short[keep]
    order = np.lexsort((gk, tok))
    tok, gk, short = tok[order], gk[order], short[order]
    if len(tok):
        new = np.ones(len(tok), bool)
        new[1:] = (tok[1:] != tok[:-1]) | (gk[1:] != gk[:-1])
        tok, gk, short = tok[new], gk[new], short[new]
    edge = np.flatnonzero(np.concatenate([[True], tok[1:] != tok[:-1], [True]])) if len(tok) else np.zeros(1, np.int64)
    start, m = edge[:-1], np.diff(edge)
    a, b = [], []
    for size in range(2, SMALL + 1):
        at = start[m == size]
        for i in range(size):
            for j in range(i + 1, size):
                one = at[short[at + i] | short[at + j]]
                a.append(gk[one + i])
                b.append(gk[one + j])
    large = np.repeat(m > SMALL, m)
    pairs = np.unique(np.stack([np.concatenate(a), np.concatenate(b)]), axis=1) if a and sum(map(len, a)) else np.zeros((2, 0), np.int64)
    n_pairs, n_large = pairs.shape[1], int(large.sum())
    return pa.table(
        {
            "kind": pa.array(np.repeat(np.array([0, 1], np.int32), [n_pairs, n_large])),
            "a": pa.array(np.concatenate([pairs[0], tok[large].view(np.int64)])),
            "b": pa.array(np.concatenate([pairs[1], gk[large]])),
            "short": pa.array(np.concatenate([np.ones(n_pairs, bool), short[large]])),
        }
    )


def _verified(size: int, percent: int):
    def run(parts):
        remembered("jaccard_join")
        for batch in parts:
            left = sets_of(pa.RecordBatch.from_arrays([batch.column("ta")], ["text"]), size)
            right = sets_of(pa.RecordBatch.from_arrays([batch.column("tb")], ["text"]), size)
            good = np.zeros(len(batch), bool)
            for (row, u), (_, v) in zip(left, right, strict=True):
                both = len(np.intersect1d(u, v, assume_unique=True))
                good[row] = both > 0 and 100 * both >= percent * (len(u) + len(v) - both)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(good))

    return run


def _of_pairs(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """Rows of the ids that ``pairs`` names; the ids are broadcast only while their count is small."""
    ids = written(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), "ids")
    few = ids.count() <= BROADCAST_IDS
    return rows.where("doc_id is not null").join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")


def _possible(percent: int):
    def run(parts):
        remembered("jaccard_join")
        for batch in parts:
            n, m = longs(batch.column("na")), longs(batch.column("nb"))
            x, y = batch.column("xa").to_pylist(), batch.column("xb").to_pylist()
            good = np.zeros(len(batch), bool)
            for i in range(len(batch)):
                both = most_shared(int(n[i]), int(m[i]), x[i], y[i])
                good[i] = 100 * both >= percent * (n[i] + m[i] - both)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(good))

    return run


class Members:
    """Rows of buckets as arrays: what tells whether two members may link."""

    def __init__(self, table: pa.Table):
        self.cid, self.n, self.comp, self.own = (table.column(c).to_numpy().astype(np.int64) for c in ("cid", "n", "component", "own"))
        self.short, self.top = (table.column(c).to_numpy().astype(bool) for c in ("short", "top"))
        self.bits, self.code, self.codes, self.short_codes = (table.column(c).to_pylist() for c in ("bits", "code", "codes", "short_codes"))

    def part(self, s: int, e: int) -> Members:
        out = object.__new__(Members)
        out.__dict__ = {k: v[s:e] for k, v in self.__dict__.items()}
        return out

    def smaller_is_first(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Is x the smaller set? Of equal sizes the one with the smaller id counts as such."""
        n, cid = self.n, self.cid
        return (n[x] < n[y]) | ((n[x] == n[y]) & (cid[x] < cid[y]))


def _possible_pairs(m: Members, split: bool, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of pairs of one bucket's members (of its two blocks, if split) in different components that short prefixes, lengths and bitmaps allow."""
    n, bits = m.n, m.bits
    width = np.fromiter(map(len, bits), np.int64, len(bits))
    left, right = [], []
    for w in np.unique(width):
        at = np.flatnonzero(width == w)
        maps = np.frombuffer(b"".join([bits[i] for i in at]), np.uint64).reshape(len(at), -1)
        wide = np.flatnonzero(width == 2 * w)  # sets that may link differ in width by one doubling at most
        if len(wide):
            folded = np.frombuffer(b"".join([bits[i] for i in wide]), np.uint64).reshape(len(wide), -1)
            folded = folded[:, : maps.shape[1]] ^ folded[:, maps.shape[1] :]
            every, all_maps = np.concatenate([at, wide]), np.concatenate([maps, folded])
        else:
            every, all_maps = at, maps
        step = max(1, 2_000_000 // all_maps.size)
        for k in range(0, len(at), step):
            x, y = at[k : k + step, None], every[None, :]
            ok = (m.comp[x] != m.comp[y]) & (100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y])) & ((x < y) | (width[y] > w))
            ok &= (m.top[x] | m.top[y]) & np.where(m.smaller_is_first(x, y), m.short[x], m.short[y])
            if split:
                ok &= m.own[x] != m.own[y]
            i, j = np.nonzero(ok)
            if len(i):
                apart = np.zeros(len(i), np.int64)
                some = max(1, 1_000_000 // maps.shape[1])  # pairs whose bitmaps take 8 MB a side
                for c in range(0, len(i), some):
                    apart[c : c + some] = np.bitwise_count(maps[k + i[c : c + some]] ^ all_maps[j[c : c + some]]).sum(1)
                u, v = at[k + i], every[j]
                both = (n[u] + n[v] - apart) // 2
                good = 100 * both >= percent * (n[u] + n[v] - both)
                left.append(u[good])
                right.append(v[good])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def _holds(codes: list, code: int) -> tuple[np.ndarray, np.ndarray]:
    """(member, code) of all entries of the members' code lists that are smaller than ``code``."""
    size = np.fromiter((0 if c is None else len(c) for c in codes), np.int64, len(codes))
    flat = np.concatenate([np.zeros(0, np.int64), *[np.asarray(c, np.int64) for c in codes if c is not None]])
    return np.repeat(np.arange(len(codes)), size)[flat < code], flat[flat < code]


def _first_common(u: np.ndarray, v: np.ndarray, m: Members, code: int) -> np.ndarray:
    """For pairs (u, v) of a bucket's members: is there no common bucket with a smaller code that compares them, too?"""
    who, flat = _holds(m.codes, code)
    smaller, at = np.unique(flat, return_inverse=True)
    every, short = np.zeros((2, len(m.n), len(smaller)), bool)
    every[who, at] = True
    who, flat = _holds(m.short_codes, code)
    short[who, np.searchsorted(smaller, flat)] = True
    every, short = np.packbits(every, axis=1), np.packbits(short, axis=1)
    first = m.smaller_is_first(u, v)
    low, high = np.where(first, u, v), np.where(first, v, u)
    out = np.zeros(len(u), bool)
    for k in range(0, len(u), 20_000):
        out[k : k + 20_000] = ~(short[low[k : k + 20_000]] & every[high[k : k + 20_000]]).any(1)
    return out


def _crossing(percent: int):
    """Rows sorted by bucket and block pair to possible pairs; holds the members of one block pair."""

    def run(parts):
        remembered("jaccard_join")
        held: pa.Table | None = None

        def pairs(table: pa.Table, last: bool):
            key = np.stack([table.column(c).to_numpy().astype(np.int64) for c in ("code", "i", "j")])
            edge = np.flatnonzero(np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(0), [True]]))
            keep = edge[-1] if last else edge[-2]
            every = Members(table)
            a, b = [], []
            for s, e in zip(edge[:-1], edge[1:], strict=True):
                if s < keep and e - s > 1:
                    m = every.part(s, e)
                    x, y = _possible_pairs(m, bool(key[1, s] != key[2, s]), percent)
                    if len(x):
                        one = _first_common(x, y, m, m.code[0])
                        x, y = m.cid[x[one]], m.cid[y[one]]
                        a.append(np.minimum(x, y))
                        b.append(np.maximum(x, y))
            found = np.unique(np.stack([np.concatenate(a), np.concatenate(b)]), axis=1) if a else np.zeros((2, 0), np.int64)
            return pa.table({"a": found[0], "b": found[1]}), table.slice(keep)

        for batch in parts:
            rows = pa.Table.from_batches([batch])
            held = pa.concat_tables([held, rows]) if held is not None else rows
            found, held = pairs(held, False)
            yield from batches(found)
        if held is not None and len(held):
            yield from batches(pairs(held, True)[0])

    return run


def _filtered(sketch: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b; a stored table) that bitmaps (sketch: doc_id, n, bits) don't rule out."""
    named = _of_pairs(sketch, pairs)
    near = pairs.join(named.toDF("a", "na", "xa"), "a").join(named.toDF("b", "nb", "xb"), "b").select("a", "b", "na", "nb", "xa", "xb")
    return written(near.mapInArrow(_possible(percent), "a long, b long").distinct(), "pairs")


def _verify(docs: DataFrame, sketch: DataFrame, pairs: DataFrame, size: int, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b; a stored table) that link: bitmaps rule out most, the texts decide."""
    pairs = _filtered(sketch, pairs, percent)
    texts = _of_pairs(docs.where("text is not null"), pairs)
    both = pairs.join(texts.toDF("a", "ta"), "a").join(texts.toDF("b", "tb"), "b").select("a", "b", "ta", "tb")
    return written(both.mapInArrow(_verified(size, percent), "a long, b long"), "links")


def _shared_tokens(spark, docs: DataFrame, size: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of shingles in all sets, and the frequent ones (at most ``MOST_FREQUENT``) with their counts, sorted."""
    counts = written(docs.select("text").mapInArrow(_counted(size), "token long, cnt long").groupBy("token").agg(F.sum("cnt").alias("cnt")), "counts")
    total = int(counts.where("token is null").agg(F.sum("cnt")).first()[0] or 0)
    least = max(LOCAL, total // MOST_FREQUENT)  # at most total / least tokens are that frequent
    top = counts.where(F.col("token").isNotNull() & (F.col("cnt") >= least)).toPandas()
    tok = top["token"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(tok)
    return total, tok[order], top["cnt"].to_numpy(np.int64)[order]


def _salted(rows: DataFrame, by: str, buckets: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """``rows`` with their bucket's columns; a bucket's rows are dealt to ``SALT`` parts by ``by``, so no task gets all of a hot one."""
    each = buckets.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(SALT)).cast("int")).join(each, [*on, "salt"], how).drop("salt")


def _stars(buckets: DataFrame) -> DataFrame:
    """Pairs (a, b) of the least group of each bucket's length class with the others."""
    least = buckets.groupBy("token", "class").agg(F.min("gkey").alias("a"), F.count("*").alias("m"), F.max("short").alias("any_short")).where("m > 1 and any_short")
    return _salted(buckets, "gkey", least, ["token", "class"]).select("a", F.col("gkey").alias("b")).where("a <> b")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _labelled(rows: DataFrame, comp: DataFrame, c: str) -> DataFrame:
    """``rows`` with the component of node column ``c`` (its own where it has no link)."""
    return rows.join(comp.select(F.col("node").alias(c), "component"), c, "left").withColumn("component", F.coalesce("component", c))


def _mixed(rows: DataFrame) -> DataFrame:
    """(token, of, key, code) of buckets that hold members of several components, some in their short prefix.

    A bucket of key c has the members of classes c and c - 1; buckets of one code are merged.
    """
    low = [F.min(F.xxhash64("cid", F.lit(i))).alias(f"w{i}") for i in (1, 2)]
    each = rows.groupBy("token", "of", "class").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.max("short").alias("any_short"), *low)
    placed = each.withColumn("key", F.explode(F.array("class", F.col("class") + 1)))
    low = [F.min(w).alias(w) for w in ("w1", "w2")]
    both = placed.groupBy("token", "of", "key").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("any_short").alias("any_short"), F.max("class").alias("top"), *low)
    return both.where("lo < hi and any_short and top = key").select("token", "of", "key", F.xxhash64("key", "w1", "w2").alias("code"))


def _open_pairs(rows: DataFrame, small: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components that share a bucket (rows: token, of, class, cid, n, short, component) and may link."""
    placed = rows.withColumn("key", F.explode(F.array("class", F.col("class") + 1)))
    held = _salted(placed, "cid", _mixed(rows), ["token", "of", "key"])
    held = held.groupBy("code", "key", "cid", "n", "component", "class").agg(F.max("short").alias("short"))
    held = written(held.select("code", "key", "cid", "n", "component", "short", (F.col("key") == F.col("class")).alias("top")), "open")
    # A pair comes out of its first common bucket only; ids with several texts, whose buckets differ by text, out of each.
    several = classes.groupBy("cid").agg(F.count("*").alias("c")).where("c > 1").select("cid")
    codes = held.groupBy("cid", "key").agg(F.collect_set("code").alias("all_codes"), F.collect_set(F.when(F.col("short"), F.col("code"))).alias("all_short"))  # at most a prefix of buckets
    large = held.groupBy("code").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("nb")).where("nb > 1")
    held = _salted(held, "cid", large, ["code"], "left").join(codes.join(several, "cid", "left_anti"), ["cid", "key"], "left").join(small.toDF("cid", "n", "bits"), ["cid", "n"])
    smaller = lambda c: F.filter(c, lambda x: x < F.col("code"))
    blocks = F.coalesce("nb", F.lit(1))
    halves = held.withColumn("own", F.pmod(F.xxhash64("cid", F.lit(3)), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    by = ["code", "i", "j"]
    halves = halves.select(
        F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "cid", "n", "short", "component", "top", "bits", "code", smaller("all_codes").alias("codes"), smaller("all_short").alias("short_codes")
    )
    return _ordered(halves.repartition(*by).sortWithinPartitions(*by).mapInArrow(_crossing(percent), "a long, b long"))


def jaccard_components(docs: DataFrame, size: int = 5, percent: int = 75) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id.

    Two documents link when 100 * |A and B| >= percent * |A or B|; component_id is
    the smallest doc_id reachable by links. See the module for nulls and ties.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    total, *frequent = _shared_tokens(spark, docs, size)
    shards = 8
    while shards * SHARD_ROWS < total * (100 - percent) / 100:
        shards *= 2

    index = written(docs.mapInArrow(_indexed(size, percent, spark.sparkContext.broadcast(frequent), shards), INDEX), "index")
    rows = index.where("kind = 0").select("doc_id", "n", "fp", "gkey")
    classes = written(rows.where("n > 0 and doc_id is not null").groupBy("fp", "gkey", "n").agg(F.min("doc_id").alias("cid")), "classes")
    # A doc_id with several texts of one size has several sketches under (doc_id, n): each is compared.
    sketches = index.where("kind = 0 and n > 0 and doc_id is not null")
    small, wide = sketches.select("doc_id", "n", "small"), sketches.select("doc_id", "n", "bits")
    groups = written(classes.groupBy("gkey", "n").agg(F.min("cid").alias("rep"), F.count("*").alias("k")), "groups")
    sharded = written(index.where("kind = 1").select("shard", "data").groupBy("shard").applyInArrow(_shard, "kind int, a long, b long, short boolean"), "sharded")
    buckets = sharded.where("kind = 1").select(F.col("a").alias("token"), F.col("b").alias("gkey"), "short").union(index.where("kind = 2").select("token", "gkey", "short").distinct())
    buckets = written(buckets.join(groups.select("gkey", "n", _length_class(F.col("n"), percent).alias("class")), "gkey"), "buckets")

    pairs = sharded.where("kind = 0").select("a", "b").union(_stars(buckets)).distinct()
    ga, gb = groups.toDF("a", "na", "ra", "ka"), groups.toDF("b", "nb", "rb", "kb")
    lengths = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent
    pairs = written(pairs.join(ga, "a").join(gb, "b").where(lengths), "group-pairs")
    members = classes.select("gkey", F.col("cid").alias("member"))
    many = members.join(groups.where("k > 1"), "gkey")  # only groups of several distinct sets expand
    expanded = (
        pairs.select(F.col("ra").alias("a"), F.col("rb").alias("b"))
        .union(many.select(F.col("rep").alias("a"), F.col("member").alias("b")))
        .union(pairs.where("kb > 1").join(many.select(F.col("gkey").alias("b"), "member"), "b").select("ra", "member"))
        .union(pairs.where("ka > 1").join(many.select(F.col("gkey").alias("a"), "member"), "a").select("rb", "member"))
    )
    first = written(_ordered(expanded), "first")
    # Documents that repeat a doc_id are one node: each class's cid is its least doc_id.
    own = rows.where("n > 0 and doc_id is not null").join(classes, ["fp", "gkey", "n"]).select(F.col("doc_id").alias("a"), F.col("cid").alias("b")).distinct()
    twice = own.join(own.groupBy("a").agg(F.count("*").alias("c")).where("c > 1").select("a"), "a", "left_semi").where("a <> b")
    links = _verify(docs, wide, _filtered(small, first, percent), size, percent).union(twice)
    comp = components(links)

    member = [F.col("cid"), F.col("n")]
    whole = [_length_class(F.col("n"), percent).alias("class"), *member, F.lit(True).alias("short")]
    in_buckets = buckets.select("token", "gkey", "class", "short").join(classes.select("gkey", "cid", "n"), "gkey").select("token", F.lit(0).alias("of"), "class", *member, "short")
    in_groups = classes.join(groups.where("k > 1").select("gkey"), "gkey", "left_semi").select(F.col("gkey").alias("token"), F.lit(1).alias("of"), *whole)
    cross = pairs.where("ka > 1 or kb > 1").select(F.xxhash64("a", "b").alias("token"), F.explode(F.array("a", "b")).alias("gkey"))
    across = cross.join(classes.select("gkey", "cid", "n"), "gkey").select("token", F.lit(2).alias("of"), *whole)
    again = _labelled(in_buckets.union(in_groups).union(across), comp, "cid")
    again = written(again.groupBy("token", "of", "class", "cid", "n", "component").agg(F.max("short").alias("short")), "members")
    rest = written(_open_pairs(again, small, classes, percent).join(first, ["a", "b"], "left_anti"), "rest")
    more = _verify(docs, wide, rest, size, percent)
    if not more.isEmpty():
        comp = components(links.union(more))
    final = _labelled(classes, comp, "cid").select("fp", "gkey", "n", "component")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return rows.join(final, ["fp", "gkey", "n"], "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), component.alias("component_id"))


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` but those whose doc_id is in ``ids``; texts are shuffled only if the ids are too many to broadcast."""
    ids = written(ids.where("doc_id is not null").distinct(), "dropped")
    few = ids.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids, "doc_id", "left_anti").select(*docs.columns)


def keep_one(docs: DataFrame, size: int = 5, percent: int = 75) -> DataFrame:
    """``docs`` with one document (the smallest doc_id) of each linked group; null ids stay."""
    comp = jaccard_components(docs, size, percent)
    return without(docs, comp.where("doc_id <> component_id").select("doc_id"))
