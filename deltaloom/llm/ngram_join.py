"""N-gram Jaccard join by T-occurrence search with DivideSkip.

Every document is the set of its distinct word shingles, hashed to 64 bits. Two documents
link when 100 * intersection >= percent * union.

1. Shared shingles. A set of n shingles links with nothing unless ceil(t*n) of them occur
   in another document. The hashes are dealt by range, in packed sorted runs, and every
   document's shared ones are counted; only documents with enough of them go on. A hash
   that a slice of documents holds more than once is counted there and shipped once.
2. Prefix keys. The same is done once more among the remaining sets, and gives each its
   shingles that any other of them has; only these can meet. With all shingles in one
   global order, two linked sets of sizes a and b share one of their first a - ceil(t*a) + 1
   and b - ceil(t*b) + 1 shingles, and neither is larger than the other's size over t. The
   order has the unshared shingles first, which meet nothing, and those of common passages
   last; it is only an order, so whatever it is, no link is lost.
3. Groups. Documents that share a prefix key at fitting sizes are in one group (connected
   components), so all links lie inside groups. Equal sets are one member.
4. Blocks. Groups are cut into blocks of bounded numbers of sets and shingles, in the order
   of each set's first prefix key, so that sets which share rare shingles are mostly in one
   block, and then by the share of shared shingles. In a block an inverted index is
   built, and each member is searched in it: of its lists the longest are set apart, the
   short ones are merged through a heap, and only what occurs often enough in those is
   looked up in the long ones by binary search. What reaches the required overlap is
   compared exactly. Members already connected aren't compared again.
5. Groups of several blocks are then closed. The sets of which most is shared link with
   most others: those of the blocks' components are searched among themselves, and all
   members outside a group's largest component against a bounded number of them, the hubs.
   At last all members that are still outside it are searched against every block of the
   group in which they may have a link. Pairs inside one component need no comparison, so
   this is exact. An overlap is no larger than what either set shares with anything, so a set
   of n shingles, s of them shared, links with none larger than s (100 + p) / p - n, its
   reach (p is the percentage): two sets link only if each is within the other's reach, and
   of two whose reach is below their own size neither is. A member outside meets a block
   only if sizes and reaches there allow a link; in a group of more than ``FEW`` blocks only
   if those of the sets do that have one of its prefix keys. Where all that would be sent at
   once is much, the blocks take turns, each with an exchange of its own.

Nothing here caps lists, partners or groups.
"""

from __future__ import annotations

import hashlib
import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh_path, materialise, mix64, new_key, pieces, shingle_hashes, small_batches, word_hashes
from .components import components

SALTS = 16
#: In a group of so few blocks a member is sent to all of them, which takes fewer rows than its keys.
FEW = 64


def required(size: int, percent: int) -> int:
    """Least overlap of a set of this size with any set it links with."""
    return -(-percent * size // 100)


def reach(held, size, percent: int):
    """The largest set that one of this size, of whose shingles so many are shared, can link with."""
    return held * (100 + percent) // percent - size


def signature(shingles: np.ndarray) -> int:
    """64 bits that stand for a set, as a signed number."""
    with np.errstate(over="ignore"):
        x = np.array([np.sum(mix64(shingles)), np.bitwise_xor.reduce(shingles) if len(shingles) else np.uint64(0), np.uint64(len(shingles))], np.uint64)
        return int(mix64(np.array([x[0] * np.uint64(0x9E3779B97F4A7C15) ^ mix64(x[1:2])[0] + x[2]], np.uint64)).view(np.int64)[0])


def shingle_sets(batches, width: int, key: bytes, rows: int = 512, size: int = 4 << 20):
    """(slice, list of its rows' sorted shingle sets) for batches whose column 1 is the text."""
    for b in pieces(batches, rows, size):
        words, counts = word_hashes(b.column(1), key)
        ends = np.cumsum(counts)
        yield b, [np.unique(shingle_hashes(words[e - c : e], width)) for e, c in zip(ends, counts)]


def _deltas(keys: np.ndarray) -> bytes:
    steps = np.diff(keys, prepend=np.uint64(0))
    if len(steps) > 1 and int(steps[1:].max()) < 1 << 32:
        return b"4" + keys[:1].tobytes() + steps[1:].astype("<u4").tobytes()
    return b"8" + keys.tobytes()


def _undeltas(data: bytes) -> np.ndarray:
    if data[:1] == b"8":
        return np.frombuffer(data, np.uint64, offset=1)
    return np.cumsum(np.concatenate([np.frombuffer(data, np.uint64, 1, 1), np.frombuffer(data, "<u4", offset=9).astype(np.uint64)]))


def shared_counts(rows: DataFrame, width: int, key: bytes, parts: int, tasks: int) -> DataFrame:
    """(sig, shared): shingles of each set that other documents, or copies of it, have too.

    ``rows`` are (doc_id, text). Counts of a set with copies are sums over its copies.
    ``parts`` is the number of ranges that hashes are dealt over, ``tasks`` that of tasks,
    each of which takes its ranges in turn.
    """

    def deal(batches):
        for b, sets in shingle_sets(batches, width, key, 4096, 8 << 20):
            sets = [s for s, d in zip(sets, b.column(0).is_valid().to_pylist()) if d and len(s)]
            if sets:
                yield _dealt(sets, np.array([signature(s) for s in sets], np.int64), parts, 16)

    def total(batches):
        for _, sig, _, n, _ in _at_home(batches):
            sigs, back = np.unique(sig, return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(sigs), pa.array(np.bincount(back, n, len(sigs)).astype(np.int64))], names=["sig", "shared"])

    return _exchanged(rows.mapInArrow(deal, _RUN), tasks, False).mapInArrow(total, "sig long, shared long").groupBy("sig").agg(F.sum("shared").alias("shared"))


def shared_keys(rows: DataFrame, sets_of, percent: int, parts: int, tasks: int) -> DataFrame:
    """(sig, n, keys): each set's shingles that another has, of the sets that ``sets_of`` makes of ``rows``.

    It makes batches of (sig, n, shingles). Sets that have too few shared shingles to link are
    left out. Sets are made once and not stored, and their sizes go along, so that no keys are
    exchanged again to find them.
    """

    def deal(batches):
        for b in pieces(sets_of(batches), 4096, 8 << 20):
            held = [np.frombuffer(x, np.uint64) for x in b.column(2).to_pylist()]
            yield _dealt(held, np.asarray(b.column(0)), parts, 0)

    def gather(batches):
        for _, sig, size, n, keys in _at_home(batches):
            sig, size, keys = np.repeat(sig, n), np.repeat(size, n), np.frombuffer(keys, np.uint64)
            order = np.lexsort((keys, sig))
            sig, size, keys = sig[order], size[order], keys[order]
            at = np.flatnonzero(np.append(len(sig) > 0, sig[1:] != sig[:-1]))
            raw, cuts = keys.tobytes(), np.append(at, len(sig))
            enough = np.diff(cuts) * 100 >= size[at] * percent
            yield pa.RecordBatch.from_arrays([pa.array(sig[at[enough]]), pa.array(size[at[enough]]), pa.array([raw[lo * 8 : hi * 8] for lo, hi in zip(cuts[:-1][enough], cuts[1:][enough])], pa.binary())], names=["sig", "n", "keys"])

    return _exchanged(rows.mapInArrow(deal, _RUN), tasks, True).mapInArrow(gather, "sig long, n long, keys binary")


#: Hashes in a range, on average: a task holds one range at a time, so this bounds its memory.
RANGE = 1_500_000


def ranges(shingles: int, tasks: int) -> int:
    """The number of ranges that so many hashes are dealt over, at least one a task."""
    return min(max(tasks, -(-shingles // RANGE)), (1 << 24) - 1)


def _exchanged(runs: DataFrame, tasks: int, with_keys: bool) -> DataFrame:
    """Runs to their range of hashes, and what was found there back to the slices' homes."""
    met = runs.repartition(tasks, "part").sortWithinPartitions("part").mapInArrow(lambda batches: _meet(batches, with_keys), _FOUND)
    return met.repartition(tasks, "home").sortWithinPartitions("home")


_FOUND = "home long, sigs binary, named binary, counts binary, keys binary"
_RUN = "part int, home long, sigs binary, counts binary, keys binary, owners binary"
#: Stands for the owner of a key that a slice holds more than once; slices have fewer sets.
_MANY = (1 << 16) - 1


def _record(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows), fields)], names=[n for n, _ in fields])


def _dealt(sets: list[np.ndarray], sigs: np.ndarray, parts: int, drop: int) -> pa.RecordBatch:
    """A slice's runs by part, and one row of what the slice itself holds more than once.

    A slice's home is a number made from its sets in their order; in its runs a set is known
    by its place among them.
    """
    flat = np.concatenate(sets) >> np.uint64(drop)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.concatenate([[True], flat[1:] != flat[:-1]])
    lone = new & np.append(new[1:], True)
    by = np.argsort(owner[~lone], kind="stable")
    again = np.bincount(owner[~lone], minlength=len(sets))
    home = int.from_bytes(hashlib.blake2b(sigs.tobytes(), digest_size=8).digest(), "little", signed=True)
    sizes = np.array([len(s) for s in sets], np.int64)
    out = [(home % parts, home, sigs.tobytes() + sizes.tobytes(), again.astype("<i8").tobytes(), b"" if drop else flat[~lone][by].tobytes(), b"")]
    keys, owners = flat[new], np.where(lone[new], owner[new], _MANY).astype("<u2")
    part = (keys >> np.uint64(24 - drop)) * np.uint64(parts) >> np.uint64(40)  # by the 40 highest bits
    cuts = np.flatnonzero(np.append(len(keys) > 0, part[1:] != part[:-1]))
    out += [(int(part[lo]), home, b"", b"", _deltas(keys[lo:hi]), owners[lo:hi].tobytes()) for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), len(keys)])]
    return _record(out, _RUN)


def _meet(batches, with_keys: bool):
    """Per part: which keys several slices hold, as counts or keys of their owners.

    Rows come in order of parts. A part is a range of hashes, as large as its share of all;
    a key that is common holds one entry for each slice of documents, not for each document.
    """
    for _, t in _by_key(batches, ["part"]):
        runs, straight = [], []
        for home, sigs, counts, keys, owners in zip(*(t.column(i).to_pylist() for i in range(1, 6))):
            if owners:
                runs.append((_undeltas(keys), np.frombuffer(owners, "<u2"), home))
            else:  # what the slice found by itself goes straight home
                straight.append((home, sigs, b"", counts, keys))
        if straight:
            yield _record(straight, _FOUND)
        if not runs:
            continue
        keys = np.concatenate([r[0] for r in runs])
        owner = np.concatenate([r[1].astype(np.int64) + (i << 16) for i, r in enumerate(runs)])
        homes = [r[2] for r in runs]
        del runs, t
        order = np.argsort(keys, kind="stable")
        keys, owner = keys[order], owner[order]
        new = np.concatenate([[True], keys[1:] != keys[:-1]])
        many = ~(new & np.append(new[1:], True)) & (owner & _MANY != _MANY)
        keys, owner = keys[many], owner[many]
        order = np.argsort(owner, kind="stable")
        keys, owner = keys[order] if with_keys else keys[:0], owner[order]
        at = np.flatnonzero(np.append(len(owner) > 0, owner[1:] != owner[:-1]))
        n, named = np.diff(np.append(at, len(owner))), (owner[at] & _MANY).astype("<u2")
        run = owner[at] >> 16
        cuts = np.flatnonzero(np.append(len(run) > 0, run[1:] != run[:-1])).tolist()
        raw, ends = keys.tobytes(), np.append(at, len(owner)) * 8
        found = [(homes[run[lo]], b"", named[lo:hi].tobytes(), n[lo:hi].astype("<i8").tobytes(), raw[ends[lo] : ends[hi]]) for lo, hi in zip(cuts, [*cuts[1:], len(run)])]
        if found:
            yield _record(found, _FOUND)


def _at_home(batches):
    """(home, signatures, their sets' sizes, their counts, their keys in the same order) of every slice."""
    for (home,), t in _by_key(batches, ["home"]):
        rows = list(zip(*(t.column(i).to_pylist() for i in range(1, 5))))
        own = np.frombuffer(next(sigs for sigs, *_ in rows if sigs), np.int64).reshape(2, -1).T
        sig, size = np.concatenate([own[np.frombuffer(named, "<u2")] if named else own for _, named, _, _ in rows]).T
        yield home, sig, size, np.concatenate([np.frombuffer(n, "<i8") for _, _, n, _ in rows]), b"".join([k for *_, k in rows])


def common_keys(shared: DataFrame, most: int = 100_000) -> np.ndarray:
    """Shingles that many sets share, rarest first; at most ``most`` numbers.

    Each slice of sets counts those that three or more of them have, and the counts of all
    slices are summed. The list only orders shingles.
    """

    def run(batches):
        for b in pieces(batches, 4096, 8 << 20):
            flat = np.sort(np.concatenate([np.frombuffer(x, np.int64) for x in b.column(2).to_pylist()]))
            first = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
            n = np.diff(np.append(first, len(flat)))
            keep = n >= 3
            yield pa.RecordBatch.from_arrays([pa.array(flat[first[keep]]), pa.array(n[keep].astype(np.int64))], names=["key", "n"])

    top = shared.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "key").limit(most).toArrow()
    return np.asarray(top["key"]).astype(np.int64)[::-1].view(np.uint64) if top.num_rows else np.zeros(0, np.uint64)


def prefix_keys(keys: np.ndarray, n: int, percent: int, common: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Of a set of n shingles whose shared ones are ``keys``: those of its prefix.

    ``common`` is sorted, ``place`` the rank of each in the global order.
    """
    p = len(keys) - required(n, percent) + 1
    if p <= 0 or not len(common):
        return keys[: max(p, 0)]
    at = np.minimum(np.searchsorted(common, keys), len(common) - 1)
    often = common[at] == keys
    rare, late = keys[~often], at[often]
    if len(rare) >= p:
        return rare[:p]
    return np.concatenate([rare, common[late[np.argsort(place[late], kind="stable")][: p - len(rare)]]])


class Forest:
    """Union-find over 0..n-1."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        a, b = self.root(i), self.root(j)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


class DivideSkip:
    """Inverted lists over the sets of a block, and T-occurrence search in them."""

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray, percent: int, mu: float = 0.01):
        """``sets`` hold the shingles that can meet, ``sizes`` how many there are in all."""
        self.sets, self.sizes, self.percent, self.mu = sets, sizes, percent, mu
        held = np.array([len(s) for s in sets])
        flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(sets), dtype=np.int32), held)
        order = np.argsort(flat, kind="stable")
        flat, self.owners = flat[order], owner[order]
        first = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]])) if len(flat) else np.zeros(0, int)
        self.lengths = np.diff(np.append(first, len(flat)))
        self.starts = first
        self.places = np.empty(len(flat), np.int32)  # of each set's shingles in turn: their list
        self.places[order] = np.repeat(np.arange(len(first), dtype=np.int32), self.lengths)
        self.offsets = np.concatenate([[0], np.cumsum(held)])

    def search(self, q: int, alive: np.ndarray) -> list[int]:
        """Members of ``alive`` that may link with member q, for exact comparison.

        Lists hold member numbers in ascending order. A member needs ``T`` occurrences in
        q's lists, so ``T - L`` in the short ones if L lists are set apart.
        """
        need = required(int(self.sizes[q]), self.percent)
        mine = self.places[self.offsets[q] : self.offsets[q + 1]]
        mine = mine[self.lengths[mine] > 1]
        if len(mine) < need:
            return []
        by = np.argsort(self.lengths[mine], kind="stable")
        mine = mine[by]
        longest = int(self.lengths[mine[-1]])
        apart = min(need - 1, int(need / (self.mu * math.log2(longest + 1) + 1)), len(mine))
        short, long = mine[: len(mine) - apart], mine[len(mine) - apart :]
        lists = [self.owners[s : s + n] for s, n in zip(self.starts[short], self.lengths[short])]
        lists = [x[alive[x]] for x in lists]
        least = need - apart
        found: list[tuple[int, int]] = []
        last, n = -1, 0
        for c in heapq.merge(*[x.tolist() for x in lists if len(x)]):
            if c == last:
                n += 1
                continue
            if n >= least:
                found.append((last, n))
            last, n = c, 1
        if n >= least and last >= 0:
            found.append((last, n))
        who = np.array([c for c, _ in found], int)
        count = np.array([n for _, n in found], int)
        left = len(long)
        for s, size in zip(self.starts[long[::-1]], self.lengths[long[::-1]]):
            if not len(who) or left <= 0:
                break
            some = count + left >= need
            who, count = who[some], count[some]
            here = self.owners[s : s + size]
            at = np.minimum(np.searchsorted(here, who), size - 1)
            count += here[at] == who
            left -= 1
        return who[count >= need].tolist()

    def linked(self, i: int, j: int) -> bool:
        a, b = int(self.sizes[i]), int(self.sizes[j])
        if min(a, b) * 100 < self.percent * max(a, b):
            return False
        both = len(np.intersect1d(self.sets[i], self.sets[j], assume_unique=True))
        return 100 * both >= self.percent * (a + b - both)


def link_block(sets: list[np.ndarray], sizes: np.ndarray, groups: np.ndarray, asks: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links of a block, as pairs of member numbers.

    ``groups`` numbers what is connected already; members of one number aren't compared.
    ``asks`` says which members are queries; each of them meets all others.
    """
    index, forest = DivideSkip(sets, sizes, percent), Forest(len(sets))
    first: dict[int, int] = {}
    for i, g in enumerate(groups):
        forest.join(first.setdefault(g, i), i)
    comp = np.array([forest.root(i) for i in range(len(sets))])
    out = []
    done = np.zeros(len(sets), bool)
    far = reach(np.array([len(s) for s in sets]), sizes, percent)
    for q in np.flatnonzero(asks):
        done[q] = True
        fits = (sizes <= far[q]) & (sizes[q] <= far)
        alive = (comp != comp[q]) & ~done & fits
        if not alive.any():
            continue
        for c in index.search(int(q), alive):
            if comp[c] != comp[q] and index.linked(int(q), c):
                out.append((int(q), c))
                a, b = sorted((comp[q], comp[c]))
                comp[comp == b] = a
    return out


def _by_key(batches, names):
    """(key columns' values, rows) of consecutive rows with equal keys, across batches."""
    held, key = [], None
    for b in batches:
        cols = [np.asarray(b.column(n)) for n in names]
        if not b.num_rows:
            continue
        cut = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
        for lo, hi in zip([0, *cut], [*cut, b.num_rows]):
            now = tuple(int(c[lo]) for c in cols)
            if held and now != key:
                yield key, pa.Table.from_batches(held)
                held = []
            key = now
            held.append(b.slice(lo, hi - lo))
    if held:
        yield key, pa.Table.from_batches(held)


def _search_blocks(rows: DataFrame, percent: int, tasks: int) -> DataFrame:
    """Links (u, v) found in blocks of rows (grp, block, sig, comp, asks, n, keys)."""

    def run(batches):
        for _, t in _by_key(batches, ["grp", "block"]):
            sig, first = np.unique(np.asarray(t["sig"]), return_index=True)
            asks = np.asarray(t["asks"])
            if len(sig) < len(asks):  # a member that is both a query and in the block
                asked = set(np.asarray(t["sig"])[asks].tolist())
                asks = np.array([s in asked for s in sig.tolist()])
            else:
                asks = asks[first]
            if len(sig) < 2 or not asks.any():
                continue
            raw = t["keys"].take(pa.array(first)).to_pylist()
            got = link_block([np.frombuffer(x, np.uint64) for x in raw], np.asarray(t["n"])[first], np.asarray(t["comp"])[first], asks, percent)
            if got:
                at = np.array(got)
                yield pa.RecordBatch.from_arrays([pa.array(sig[at[:, 0]]), pa.array(sig[at[:, 1]])], names=["u", "v"])

    dealt = rows.select("grp", "block", "sig", "comp", "asks", "n", "keys").repartition(tasks, "grp", "block").sortWithinPartitions("grp", "block")
    return dealt.mapInArrow(run, "u long, v long")


class Steps:
    """Materialised steps of one run; those that nothing reads any more are deleted.

    A step may go once what is made of it has been written. Spark deletes an exchange's
    files when the driver collects the garbage that refers to them, so it is told to.
    """

    def __init__(self, spark):
        self.spark, self.paths = spark, {}

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = fresh_path(self.spark, name)
        df.write.parquet(path)
        self.paths.setdefault(name, []).append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for path in [p for n in names for p in self.paths.pop(n, [])]:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)
        jvm.System.gc()


def _tasks(spark) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def _edges(rows: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(rows[:, i])) for i in range(5)], names=["key", "u", "v", "lo", "hi"])


def link_components(docs: DataFrame, width: int = 5, percent: int = 75, block: int = 128, block_keys: int = 1 << 17, broadcast_rows: int = 500_000, turn_bytes: int = 64 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id of every document.

    Words are runs of non-white-space with A-Z lower-cased. A text of fewer than ``width``
    words has one shingle, the whole sequence; null texts and texts without words have
    none and link with nothing. component_id is the smallest doc_id reachable by links.
    Rows with a null id link with nothing and have no component. Rows that repeat an id are
    documents of their own. Extra columns are ignored. Words, shingles and sets are known by
    64-bit hashes under a key drawn for each call: any two different ones are taken for one
    with a chance of about 2**-64, whatever the texts are.
    """
    spark, key = docs.sparkSession, new_key()
    small_batches(docs)
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    tasks, steps = _tasks(spark), Steps(spark)

    def describe(batches):
        for b, sets in shingle_sets(batches, width, key):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([signature(s) for s in sets], pa.int64())], names=["doc_id", "n_shingles", "sig"])

    described = materialise(rows.mapInArrow(describe, "doc_id long, n_shingles long, sig long"), "described")
    shingles = described.agg(F.sum("n_shingles")).first()[0] or 0
    parts = ranges(shingles, tasks)
    usable = described.where("doc_id is not null and n_shingles > 0")

    # one row for each set, of the document with the smallest id
    firsts = usable.groupBy("sig").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"), F.count("*").alias("copies"))
    enough = F.col("shared") * 100 >= F.col("n") * F.col("copies") * percent
    apt = steps.write(firsts.join(shared_counts(rows, width, key, parts, tasks), "sig").where(enough).select("sig", "doc_id"), "apt")
    steps.drop()
    wanted = F.broadcast(apt) if apt.count() <= broadcast_rows else apt

    def sets_of(batches):
        for b, sets in shingle_sets(batches, width, key, 4096, 8 << 20):
            right = [i for i, (s, g) in enumerate(zip(sets, b.column(0).to_pylist())) if signature(s) == g]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(right, pa.int64())), pa.array([len(sets[i]) for i in right], pa.int64()), pa.array([sets[i].tobytes() for i in right], pa.binary())], names=["sig", "n", "shingles"])

    texts = rows.where("text is not null").join(wanted, "doc_id").select("sig", "text")
    # a representative whose row occurs more than once comes once for each: one row for each set
    twice = steps.write(usable.join(apt, ["sig", "doc_id"]).groupBy("sig").count().where("count > 1").select("sig"), "repeated")
    if twice.isEmpty():
        sets = shared_keys(texts, sets_of, percent, parts, tasks)
    else:
        made = lambda how: texts.join(twice, "sig", how).mapInArrow(sets_of, "sig long, n long, shingles binary")
        sets = shared_keys(made("left_anti").union(made("left_semi").dropDuplicates(["sig"])), iter, percent, parts, tasks)
    sets = steps.write(sets, "shared")
    steps.drop("apt", "repeated")
    ranked = common_keys(sets)
    common = np.sort(ranked)
    place = np.empty(len(ranked), np.int64)
    place[np.searchsorted(common, ranked)] = np.arange(len(ranked))
    held_order = spark.sparkContext.broadcast((common, place))  # at most 100,000 pairs of numbers

    def postings(batches):
        for b in pieces(batches, 2048):
            keys, sizes, sigs = [], [], []
            for sig, n, raw in zip(*(c.to_pylist() for c in b.columns)):
                k = prefix_keys(np.frombuffer(raw, np.uint64), n, percent, *held_order.value).view(np.int64)
                keys.append(k)
                sizes.append(np.full(len(k), n))
                sigs.append(np.full(len(k), sig, np.int64))
            sig = np.concatenate(sigs)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.mod(sig, SALTS).astype(np.int8)), pa.array(np.concatenate(sizes)), pa.array(sig)], names=["key", "salt", "n", "sig"])

    def stars(batches):
        """Edges from the members of a run of equal (key, salt), by rising size, to its first.

        A run ends where the next size can't link with the last: then none after can. Each
        run's leader is an edge to itself that carries the run's key and sizes.
        """
        held = None  # key, salt, leader, its size, last size
        for b in batches:
            key, salt, n, sig = (np.asarray(b.column(i)) for i in range(4))
            if not len(key):
                continue
            same = (key[1:] == key[:-1]) & (salt[1:] == salt[:-1]) & (n[1:] * percent <= n[:-1] * 100)
            joins = bool(held and held[0] == key[0] and held[1] == salt[0] and n[0] * percent <= held[4] * 100)
            new = np.concatenate([[not joins], ~same])
            at = np.flatnonzero(new)
            run = np.cumsum(new) - 1  # -1: still the held run
            lead = np.append(sig[at], held[2] if held else 0)[run]
            out = [(sig, lead, np.zeros(len(sig), np.int64), n, n)] if len(sig) else []
            ends = np.append(at[1:], len(key)) - 1  # last rows of the runs begun here
            if joins:
                end = at[0] - 1 if len(at) else len(key) - 1
                held = (*held[:4], n[end])
            closed = [held] if held and len(at) else []
            out += [tuple(np.array([x]) for x in (h[2], h[2], h[0], h[3], h[4])) for h in closed]
            if len(at):
                k, e = at[:-1], ends[:-1]
                out.append((sig[k], sig[k], key[k], n[k], n[e]))
                held = (key[at[-1]], salt[at[-1]], sig[at[-1]], n[at[-1]], n[-1])
            u, v, k, lo, hi = (np.concatenate(c) for c in zip(*out))
            keep = (u != v) | (k != 0)
            pairs = np.unique(np.stack([np.where(u != v, 0, k), u, v, np.where(u != v, 0, lo), np.where(u != v, 0, hi)], 1)[keep], axis=0)
            yield _edges(pairs)
        if held:
            yield _edges(np.array([[held[0], held[2], held[2], held[3], held[4]]], np.int64))

    spread = sets.mapInArrow(postings, "key long, salt byte, n long, sig long").repartition(tasks, "key", "salt").sortWithinPartitions("key", "salt", "n")
    starred = steps.write(spread.mapInArrow(stars, "key long, u long, v long, lo long, hi long"), "stars")
    # runs of one key in several salts: again by rising size, each to the one before
    before = Window.partitionBy("key").orderBy("lo", "u").rowsBetween(Window.unboundedPreceding, -1)
    leaders = starred.where("u = v").join(starred.where("u = v").groupBy("key").agg(F.count("*").alias("m")).where("m > 1"), "key")
    leaders = leaders.withColumn("most", F.max(F.struct("hi", F.col("u").alias("by"))).over(before)).where(F.col("lo") * percent <= F.col("most.hi") * 100).select("u", F.col("most.by").alias("v"))
    groups = components(starred.where("u <> v").select("u", "v").union(leaders))
    groups = steps.write(groups, "groups")
    steps.drop("stars")

    def cut(frame: DataFrame) -> DataFrame:
        """``frame`` (grp, sig, n, keys, comp, asks) with the number of its ``block``, for the first time or anew."""
        order = ["grp", "lead", "lone", "sig"]
        kinds = {"grp": "long", "sig": "long", "n": "long", "keys": "binary", "comp": "long", "asks": "boolean"}
        base = ", ".join(f"{c} {t}" for c, t in kinds.items())

        def lead(batches):
            for b in pieces(batches, 2048):
                first = [prefix_keys(np.frombuffer(raw, np.uint64), n, percent, *held_order.value)[:1] for n, raw in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
                lone = [1 - len(raw) / 8 / n for n, raw in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array([int(f.view(np.int64)[0]) if len(f) else 0 for f in first], pa.int64()), pa.array(lone, pa.float64())], names=[*kinds, "lead", "lone"])

        def number(batches):
            from pyspark import TaskContext

            grp, block_no, held, size = None, TaskContext.get().partitionId() << 32, 0, 0
            for b in pieces(batches, 2048):
                out = []
                for g, raw in zip(b.column(0).to_pylist(), b.column(3).to_pylist()):
                    if g != grp or held >= block or size + len(raw) // 8 > block_keys:
                        grp, block_no, held, size = g, block_no + 1, 0, 0
                    held, size = held + 1, size + len(raw) // 8
                    out.append(block_no)
                yield pa.RecordBatch.from_arrays([*b.columns[:6], pa.array(out, pa.int64())], names=[*kinds, "block"])

        led = frame.select(*kinds).mapInArrow(lead, base + ", lead long, lone double")
        return led.repartitionByRange(tasks, *order).sortWithinPartitions(*order).mapInArrow(number, base + ", block long")

    members = sets.join(groups, F.col("sig") == F.col("node")).withColumnRenamed("label", "grp").withColumns({"comp": F.col("sig"), "asks": F.lit(True)})
    sets = steps.write(cut(members), "members")
    steps.drop("shared", "groups")
    links = steps.write(_search_blocks(sets, percent, tasks), "links")

    several = sets.groupBy("grp").agg(F.min("block").alias("lo"), F.max("block").alias("hi")).where("lo <> hi").select("grp")
    several = materialise(several, "large-groups")
    if not several.isEmpty():
        large = steps.write(sets.drop("comp", "asks").join(several, "grp", "left_semi"), "large")
        steps.drop("members")

        def labelled(found: DataFrame) -> DataFrame:
            comps = components(found.join(large.select(F.col("sig").alias("u")), "u", "left_semi"))
            return large.join(comps, large["sig"] == comps["node"], "left").select(large["*"], F.coalesce("label", "sig").alias("comp"))

        def outside_main(now: DataFrame) -> DataFrame:
            counted = now.groupBy("grp", "comp").agg(F.count("*").alias("n"))
            return now.join(counted.groupBy("grp").agg(F.max_by("comp", F.struct("n", "comp")).alias("main")), "grp").where("comp <> main")

        # representatives among themselves, in blocks of their own: of each component the set of which most is shared
        most_shared = F.max_by("sig", F.struct(F.octet_length("keys") / F.col("n"), "sig")).alias("sig")
        now = steps.write(labelled(links), "linked")
        leads = now.join(now.groupBy("comp").agg(most_shared).select("sig"), "sig", "left_semi").withColumn("asks", F.lit(True))
        leads = steps.write(cut(leads), "leads")
        links = steps.write(links.union(_search_blocks(leads, percent, tasks)), "led")
        steps.drop("linked", "leads", "links")
        # all outside the largest component of a group, against hubs: the sets of which most is shared, one of each of so many lots
        now = steps.write(labelled(links), "linked")
        hubs = now.groupBy("grp", F.pmod(F.xxhash64("sig"), F.lit(block))).agg(most_shared).select("sig")
        asking = steps.write(outside_main(now).drop("main"), "asking")
        lots = asking.groupBy("grp").agg(F.ceil(F.count("*") / F.lit(block)).cast("long").alias("lots"))
        asking = asking.join(lots, "grp").withColumns({"block": F.pmod(F.xxhash64("sig"), F.col("lots")), "asks": F.lit(True)})
        against = now.join(hubs, "sig", "left_semi").join(lots, "grp").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("lots") - 1))).withColumn("asks", F.lit(False))
        links = steps.write(links.union(_search_blocks(asking.unionByName(against), percent, tasks)), "joined")
        steps.drop("linked", "asking", "led")
        # all that are still outside, against the blocks of the group that they can meet
        far = F.floor(F.octet_length("keys") / 8 * (100 + percent) / percent).cast("long") - F.col("n")
        now = steps.write(labelled(links).withColumn("reach", far), "labelled")
        blocks_of = materialise(large.select("grp", "block").distinct(), "blocks")
        steps.drop("large")

        def keyed(batches):
            for b in pieces(batches, 2048):
                keys = [prefix_keys(np.frombuffer(raw, np.uint64), n, percent, *held_order.value).view(np.int64) for n, raw in zip(b.column(3).to_pylist(), b.column(5).to_pylist())]
                each = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
                yield pa.RecordBatch.from_arrays([*[b.column(i).take(pa.array(each)) for i in range(5)], pa.array(np.concatenate(keys))], names=["grp", "block", "sig", "n", "reach", "key"])

        def within(asked: DataFrame, held: DataFrame, on: list[str]) -> DataFrame:
            """(sig, grp, block): blocks whose sets, of equal ``on``, have a size and a reach that fit those of ``asked``.

            Those whose reach is below their size can link only with sets whose reach isn't.
            """
            strong = F.col("reach") >= F.col("n")
            least = {"lo": F.min("n"), "hi": F.max("reach"), "strong_lo": F.min(F.when(strong, F.col("n"))), "strong_hi": F.max(F.when(strong, F.col("reach")))}
            held = held.groupBy(*on, "block").agg(*[c.alias(k) for k, c in least.items()])
            fits = F.when(strong, (F.col("lo") <= F.col("reach")) & (F.col("hi") >= F.col("n"))).otherwise((F.col("strong_lo") <= F.col("reach")) & (F.col("strong_hi") >= F.col("n")))
            return asked.drop("block").join(held, on).where(fits).select("sig", "grp", "block")

        many = materialise(blocks_of.groupBy("grp").count().where(F.col("count") > FEW).select("grp"), "many-blocks")
        asking = outside_main(now).drop("main", "reach")
        asked = outside_main(now).select("grp", "block", "sig", "n", "reach", "keys")
        keys_of = lambda rows: rows.join(many, "grp", "left_semi").select("grp", "block", "sig", "n", "reach", "keys").mapInArrow(keyed, "grp long, block long, sig long, n long, reach long, key long")
        every = within(asked.join(many, "grp", "left_anti").drop("keys"), now.join(many, "grp", "left_anti"), ["grp"])
        by_key = within(keys_of(asked), keys_of(now), ["grp", "key"])
        meets = materialise(every.union(by_key.distinct()), "meets")
        now = now.drop("reach")
        # a block that very many ask meets them in lots of bounded size
        sizes = meets.groupBy("grp", "block").agg(F.ceil(F.count("*") / F.lit(block)).cast("long").alias("lots"))
        meets = meets.join(sizes, ["grp", "block"]).select("sig", F.xxhash64("block", F.pmod(F.xxhash64("sig"), F.col("lots"))).alias("block"))
        outside = asking.drop("block").join(meets, "sig").withColumn("asks", F.lit(True))
        against = now.join(sizes, ["grp", "block"]).withColumn("lot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("lots") - 1)))
        against = against.withColumn("block", F.xxhash64("block", "lot")).withColumn("asks", F.lit(False)).select(outside.columns)
        # members that are sent to many blocks go in turns, so that an exchange stays near the size of the first one
        sized = now.select("sig", "grp", "block", F.octet_length("keys").cast("long").alias("size"))
        sent = (sized.join(meets.select("sig"), "sig").agg(F.sum("size")).first()[0] or 0) + (sized.join(sizes, ["grp", "block"]).agg(F.sum(F.col("size") * F.col("lots"))).first()[0] or 0)
        turns = -(-sent // max(turn_bytes, 6 * shingles)) or 1
        for i in range(turns):
            links = links.union(steps.write(_search_blocks(outside.union(against).where(F.pmod("block", F.lit(turns)) == i), percent, tasks), "met"))
            steps.drop()
        links = materialise(links, "links")

    comps = materialise(components(links), "components")
    steps.drop("members", "labelled", "links", "joined", "met")
    # sets that link with others have the smallest id of their component, copies that of their set
    linked = firsts.join(comps, firsts["sig"] == comps["node"]).select("sig", "label", "doc_id")
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    least = linked.groupBy("label").agg(F.min("doc_id").alias("component_id")).withColumn("salt", salts)
    named = linked.withColumn("salt", F.pmod(F.xxhash64("sig"), F.lit(SALTS)).cast("int")).join(least, ["label", "salt"]).select("sig", "component_id")
    copied = firsts.where("copies > 1").join(comps, firsts["sig"] == comps["node"], "left_anti").select("sig", F.col("doc_id").alias("component_id"))
    by_sig = named.union(copied).withColumn("salt", salts)
    done = usable.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(by_sig, ["sig", "salt"], "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    rest = described.where("doc_id is null or n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return done.union(rest)
