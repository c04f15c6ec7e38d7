"""N-gram Jaccard self-join by parity sketches.

A document's set is its distinct word shingles, hashed to 64 bits. For two sets
with ``|A & B| >= t |A | B|`` the symmetric difference has at most
``(1 - t) / (1 + t) * (|A| + |B|)`` members. A parity sketch XORs the hashes into
cells by their low bits: the bits of two sketches differ in no more cells than
the sets differ in members, so

* candidates: with ``d`` the largest difference allowed to a partner, any two
  linked documents agree, with the same words XORed, in one of the first ``d + 1``
  cells in use (pigeonhole; cells in one order for all documents). Those cells are
  the join keys, per size band: band ``c`` has ``16 * 4**c`` cells for sets of
  ``4**c`` to ``4**(c+1)`` members, and a set that may have partners in the band
  above joins there too;
* pruning: the Hamming distance of the bit sketches bounds the difference from
  below, and rejects most false candidates unseen;
* verification: what is left is compared set by set.

Cells go in the order of how often their rarest shingle occurs, counted over all
documents in a fixed number of counters: what many documents share is a key only
of documents that have little else. A set with at most ``d`` cells of rare
shingles is *poor*. It has all of these cells as keys, its rare shingles one by
one too, and then cells of common shingles. Two poor sets A and B that share no
rare shingle differ in all of theirs, and in as many common ones as their numbers
of common ones differ. A common key therefore pairs them only if A's size is
within B's *reach* and B's within A's, ``n / t - (1 + 1 / t) * x`` for ``x`` rare
ones among ``n``. The order and the reach decide how many candidates there are, never
which links are found.

Copies are one class throughout. Classes that share a key are not expanded to
pairs: all are compared with the group's leader, the class with the fewest rare
shingles. While classes of a group are in several components and within reach,
those outside the group's largest component lead next, as many as the round's
budget of pairs allows; a class that has led its group leaves it.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.components import connected_components, merge_components
from tidemark.llm.storage import Scratch, lean, materialize

WIDTH = 5
#: Counters of shingle frequencies, in blocks that are summed by a task each.
COUNTERS = 1 << 23
BLOCK = 1 << 19
#: Classes that must have a shingle for it to be common, and how many times the mean counter.
COMMON, COMMON_MEAN = 64, 8
#: Below this many members a cell is one member.
SINGLE = 64
#: Parts of a group of common keys, so that no task holds a group.
SALTS = 64
#: Pairs a round may make: so many, or so many a class.
ROUND_PAIRS, ROUND_SHARE = 500_000, 2
#: Classes of a group that may lead it in a round, where not all can.
LEADERS = (1, 4, 16, 64, 256)
#: Bits of the filter that spares most texts the way to the join (two a document).
FILTER_BITS = 1 << 24
#: In place of the number of rare shingles at a rare key, which pairs all its classes.
ALWAYS = -1
_U = np.uint64
_SLOT = _U(41)


def _mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64 (fixed values)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_POWERS = _mix(np.arange(1, 64, dtype=_U) * _U(0x9E3779B97F4A7C15)) | _U(1)


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``width``-word shingles; a shorter text is one shingle."""
    import xxhash

    words = (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space only
    n = len(words)
    if not n:
        return np.empty(0, _U)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), _U, n)
    with np.errstate(over="ignore"):
        k = min(n, width)
        out = np.full(n - k + 1, k, _U)
        for i in range(k):
            out += h[i : n - k + 1 + i] * _POWERS[i]
        return np.unique(_mix(out))


def set_class(tokens: np.ndarray) -> int:
    """64-bit class of a set: equal for equal sets."""
    if not len(tokens):
        return 0
    with np.errstate(over="ignore"):
        total = _mix(tokens + _U(0x632BE59BD9B4E019)).sum(dtype=_U) + _mix(np.bitwise_xor.reduce(tokens, keepdims=True) + _U(len(tokens)))[0]
    return int(total.view(np.int64))


def band(n: int) -> int:
    c = 0
    while 4 ** (c + 1) <= n:
        c += 1
    return c


def allowed(a: int, b: int, percent: int = 75) -> int:
    """Largest symmetric difference of linked sets of ``a`` and ``b`` members."""
    return (a + b) * (100 - percent) // (100 + percent)


def bit_sketch(tokens: np.ndarray) -> bytes:
    """Parity of the members in each of ``4 ** (band + 1)`` cells (8 at least)."""
    size = max(8, 4 ** (band(len(tokens)) + 1))
    bits = np.bincount((tokens & _U(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(bits.astype(np.uint8)).tobytes()


def hamming(a: bytes, b: bytes) -> int:
    """Distance of two bit sketches, the longer folded onto the shorter."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    if len(x) > len(y):
        x, y = y, x
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def reach(n, rare, percent: int = 75):
    """Size up to which a set of ``n`` with so many rare members may be linked to one that shares none of those."""
    return (100 * n - (100 + percent) * rare) / percent


def cell_keys(tokens: np.ndarray, codes: np.ndarray, common: int, percent: int = 75) -> tuple[np.ndarray, np.ndarray]:
    """Join keys (int64) of a set, and with each the number of the set's rare members: ``ALWAYS`` at rare keys.

    ``codes`` are the counters' sizes by slot, ``common`` the least code of common ones.
    """
    n = len(tokens)
    most = n * 100 // percent
    d = allowed(n, most, percent)
    weight = codes[tokens >> _SLOT].astype(np.int64) if len(codes) else np.zeros(n, np.int64)
    rare = weight < common
    x = int(rare.sum())
    keys, at = [], []
    poor = False
    for space in {band(n), band(most)}:
        cells = 16 * 4**space
        with np.errstate(over="ignore"):
            if 4**space < SINGLE:
                idx, xor, w = tokens, tokens, weight
            else:
                cell = tokens & _U(cells - 1)
                order = np.argsort(cell, kind="stable")
                cell = cell[order]
                first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
                idx, xor, w = cell[first], np.bitwise_xor.reduceat(tokens[order], first), np.minimum.reduceat(weight[order], first)
            use = np.lexsort((idx, w))[: d + 1] if w.any() else np.arange(min(d + 1, len(idx)))  # idx is sorted
            hot = w[use] >= common
            poor = poor or 4**space >= SINGLE and bool(hot.any())
            if 100 * reach(n, x, percent) < percent * n:  # below the least size that any partner has
                use, hot = use[~hot], hot[~hot]
            keys.append(_mix(xor[use] ^ _mix(idx[use] * _U(64) + _U(space))))
            at.append(np.where(hot, x, ALWAYS))
    if poor:
        with np.errstate(over="ignore"):
            keys.append(_mix(tokens[rare] ^ _U(0xD6E8FEB86659FD93)))
        at.append(np.full(len(keys[-1]), ALWAYS))
    return np.concatenate(keys).view(np.int64), np.concatenate(at)


def _profiles(docs: DataFrame, id_type: str) -> DataFrame:
    """Per document (doc_id, n, cls, sketch); and per task its counters, a compressed block (block, counts) each.

    A class that a task meets again is counted once. Counts of a task stop at 255.
    """

    def profile(batches):
        import pyarrow as pa
        import zstandard

        counts, seen, some = np.zeros(COUNTERS, np.uint16), set(), False
        names = ["doc_id", "n", "cls", "sketch", "block", "counts"]
        for b in batches:
            ids, texts = b.column("doc_id"), b.column("text").to_pylist()
            n, cls, sketch = [], [], []
            for t in texts:
                s = shingles(t)
                c = set_class(s)
                n.append(len(s))
                cls.append(c)
                sketch.append(bit_sketch(s))
                if len(s) and c not in seen:
                    some = True
                    if len(seen) < 200_000:
                        seen.add(c)
                    slots = (s >> _SLOT).astype(np.int64)
                    np.add.at(counts, slots, np.uint16(1))
                    counts[slots] = np.minimum(counts[slots], 255)
            size = len(texts)
            yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(cls, pa.int64()), pa.array(sketch, pa.binary()), pa.nulls(size, pa.int64()), pa.nulls(size, pa.binary())], names)
        if some:
            pack = zstandard.ZstdCompressor(level=1).compress
            blocks = COUNTERS // BLOCK
            none = [pa.nulls(blocks, k) for k in (ids.type, pa.int64(), pa.int64(), pa.binary())]
            blobs = pa.array([pack(counts[k * BLOCK : (k + 1) * BLOCK].astype(np.uint8).tobytes()) for k in range(blocks)], pa.binary())
            yield pa.RecordBatch.from_arrays([*none, pa.array(range(blocks), pa.int64()), blobs], names)

    return docs.mapInArrow(lean(profile), f"doc_id {id_type}, n long, cls long, sketch binary, block long, counts binary")


def _counter_codes(profiles: DataFrame) -> tuple[np.ndarray, int]:
    """(a byte a counter that grows with its count, the least code of a common one): ``COUNTERS`` bytes, whatever the input."""

    def total(batches):
        import pyarrow as pa
        import zstandard

        sums, unpack = {}, zstandard.ZstdDecompressor().decompress
        for b in batches:
            for k, blob in zip(b.column("block").to_pylist(), b.column("counts").to_pylist(), strict=True):
                if k not in sums:
                    sums[k] = np.zeros(BLOCK, np.int64)
                sums[k] += np.frombuffer(unpack(blob), np.uint8)
        for k, x in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([int(x.sum())]), pa.array([_code(x).tobytes()], pa.binary())], ["block", "total", "codes"])

    blobs = profiles.where("block IS NOT NULL").select("block", "counts")
    rows = blobs.repartition(COUNTERS // BLOCK, "block").mapInArrow(lean(total), "block long, total long, codes binary").collect()
    codes = np.zeros(COUNTERS, np.uint8)
    for r in rows:
        codes[r["block"] * BLOCK : (r["block"] + 1) * BLOCK] = np.frombuffer(r["codes"], np.uint8)
    mean = sum(r["total"] for r in rows) / COUNTERS
    return codes, int(_code(np.array([max(COMMON, COMMON_MEAN * mean)]))[0])


def _code(counts: np.ndarray) -> np.ndarray:
    return np.minimum(255, np.round(8 * np.log2(1.0 + counts))).astype(np.uint8)


def _candidates(docs: DataFrame, codes: np.ndarray, common: int, percent: int) -> DataFrame:
    """(key, cls, rare) of every document; copies within a task count once."""
    held = docs.sparkSession.sparkContext.broadcast((codes, common))

    def keys(batches):
        import pyarrow as pa

        (codes, common), done = held.value, set()
        for b in batches:
            k, c, e, size = [], [], [], 0
            for t in b.column("text").to_pylist():
                s = shingles(t)
                if (cls := set_class(s)) not in done and len(s):
                    if len(done) < 200_000:
                        done.add(cls)
                    key, rare = cell_keys(s, codes, common, percent)
                    k.append(key)
                    e.append(rare)
                    c.append(np.full(len(key), cls))
                    size += len(key)
                if size > 200_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (k, c, e)], ["key", "cls", "rare"])
                    k, c, e, size = [], [], [], 0
            if size:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (k, c, e)], ["key", "cls", "rare"])

    return docs.select("text").mapInArrow(lean(keys), "key long, cls long, rare long")


def _groups(rows: DataFrame, classes: DataFrame, space: Scratch, percent: int) -> DataFrame:
    """(gid, cls, leader, n, reach) of the keys that two classes or more have.

    Rare keys with the same first and last class are one group, and common keys with
    the same leader: all keys of a text and its near copies come to a few groups. A
    common key may have a third of all classes: its rows are dealt to ``SALTS`` parts
    by class, and the parts' first and last classes are combined.
    """
    hot = F.col("rare") > ALWAYS
    part = F.when(hot, F.pmod("cls", F.lit(SALTS))).otherwise(-1)
    by_part = Window.partitionBy("key", "part")
    me = F.struct("rare", "cls")
    rows = rows.withColumn("part", part)
    rows = rows.select("key", "rare", "cls", F.min(me).over(by_part).alias("first"), F.max(me).over(by_part).alias("last"))
    alone = ~hot & (F.col("first.cls") == F.col("last.cls"))
    # Of a common key, each part's first row tells the key.
    key = F.when(hot & (F.col("cls") == F.col("first.cls")), F.col("key"))
    found = rows.where(~alone).select(F.xxhash64("first.cls", "last.cls", hot).alias("gid"), key.alias("key"), "rare", "cls", "first", "last")
    found = space.keep(found.distinct(), "keys")
    # Parts of a common key: its group's leader is the first of all parts.
    parts = found.where("key IS NOT NULL").select("key", "gid", "first", "last").distinct()
    ends = parts.groupBy("key").agg(F.min("first").alias("f"), F.max("last").alias("l")).where("f.cls <> l.cls")
    whole = parts.select("key", F.col("gid").alias("part")).join(ends, "key").select("part", F.xxhash64("f.cls").alias("gid"), F.col("f.cls").alias("leader")).distinct()
    in_parts = found.where(hot).select(F.col("gid").alias("part"), "cls", "rare").distinct()
    common = in_parts.join(whole, "part").select("gid", "cls", "rare", "leader")
    rare = found.where(~hot).select("gid", "cls", F.lit(0).alias("rare"), F.col("first.cls").alias("leader"))
    merged = rare.unionByName(common).repartition("cls").groupBy("cls", "gid").agg(F.min("rare").alias("rare"), F.min("leader").alias("leader"))
    groups = merged.join(classes.select("cls", "n"), "cls").select("gid", "cls", "leader", "n", reach(F.col("n"), F.col("rare"), percent).alias("reach"))
    groups = space.keep(groups, "groups")
    space.drop(found)
    return groups


def _labelled(rows: DataFrame, comp: DataFrame) -> DataFrame:
    """``rows`` (gid, cls, n, reach) with ``c``, the component of the class (itself without links).

    The labels travel as rows of their own and are spread by a window over the
    class, which holds one set's groups, so no join has to carry a large group.
    """
    null = lambda t: F.lit(None).cast(t)
    marks = comp.select(null("long").alias("gid"), F.col("node").alias("cls"), null("long").alias("n"), null("double").alias("reach"), F.col("component").alias("c"))
    both = rows.select("gid", "cls", "n", "reach").withColumn("c", null("long")).unionByName(marks)
    both = both.withColumn("c", F.coalesce(F.max("c").over(Window.partitionBy("cls")), "cls"))
    return both.where("gid IS NOT NULL")


def _open(rows: DataFrame, comp: DataFrame) -> DataFrame:
    """The rows that may be linked with a class of another component of their group, with ``c``.

    All figures of a group are aggregates of its rows, combined before they are
    exchanged, and joined back: a group may be large.
    """
    rows = _labelled(rows, comp)
    by_comp = rows.groupBy("gid", "c").agg(F.min("n").alias("n"), F.max("reach").alias("far"), F.count("*").alias("size"))
    all_comps = by_comp.groupBy("gid").agg(
        F.min(F.struct("n", "c")).alias("least"), F.max(F.struct("far", "c")).alias("most"), F.max(F.struct("size", "c"))["c"].alias("large"), F.count("*").alias("comps")
    ).where("comps > 1")
    # What the other components have, for the component that has the least size or the greatest reach itself.
    other = by_comp.join(all_comps.select("gid", "least", "most"), "gid").groupBy("gid").agg(
        F.min(F.when(F.col("c") != F.col("least.c"), F.col("n"))).alias("least2"), F.max(F.when(F.col("c") != F.col("most.c"), F.col("far"))).alias("most2")
    )
    ends = all_comps.join(other, "gid")
    size = F.when(F.col("c") == F.col("least.c"), F.col("least2")).otherwise(F.col("least.n"))
    far = F.when(F.col("c") == F.col("most.c"), F.col("most2")).otherwise(F.col("most.far"))
    rows = rows.join(ends, "gid").where((size <= F.col("reach")) & (F.col("n") <= far))
    return rows.select("gid", "cls", "n", "reach", "c", "large")


def _challenge(rows: DataFrame, budget: int, space: Scratch) -> tuple[DataFrame, DataFrame]:
    """(rows that have not led, pairs (a, b) of leaders and others of their groups), for rows of ``_open``.

    The classes outside a group's largest component lead, those with the greatest
    reach first; if all would make more than ``budget`` pairs, as many of each group
    as keep within it, one at least.
    """
    may = F.col("c") != F.col("large")
    sizes = rows.groupBy("gid").agg(F.count("*").alias("size"), F.count_if(may).alias("can"))
    costs = sizes.agg(*[F.sum(F.col("size") * F.least("can", F.lit(x))).alias(f"c{x}") for x in LEADERS], F.sum(F.col("size") * F.col("can")).alias("all")).first()
    leaders = rows.where(may)
    if (costs["all"] or 0) > budget:
        lead = max(x for x in LEADERS if x == 1 or costs[f"c{x}"] <= budget)
        leaders = leaders.withColumn("rank", F.row_number().over(Window.partitionBy("gid").orderBy(F.col("reach").desc(), "cls"))).where(F.col("rank") <= lead)
    leaders = space.keep(leaders.select("gid", F.col("cls").alias("a"), F.col("n").alias("na"), F.col("reach").alias("ra"), F.col("c").alias("ca")), "leaders")
    both = rows.join(leaders, "gid").where(F.col("c") != F.col("ca")).where((F.col("n") <= F.col("ra")) & (F.col("na") <= F.col("reach")))
    pairs = both.select(F.least("cls", "a").alias("a"), F.greatest("cls", "a").alias("b")).distinct()
    rest = rows.join(leaders.select("gid", F.col("a").alias("cls")), ["gid", "cls"], "left_anti")
    return rest.select("gid", "cls", "n", "reach"), pairs


def _alike(a: Column, b: Column, percent: int) -> Column:
    """Whether sets of these sizes can be linked."""
    return (a * 100 >= b * percent) & (b * 100 >= a * percent)


def _prune(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose sizes and sketches allow a link."""
    side = lambda x: classes.select(F.col("cls").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
    sized = pairs.join(side("a"), "a").join(side("b"), "b").where(_alike(F.col("na"), F.col("nb"), percent))

    def near(batches):
        import pyarrow as pa

        for b in batches:
            cols = [b.column(c).to_pylist() for c in ("na", "nb", "sa", "sb")]
            ok = [hamming(sa, sb) <= allowed(na, nb, percent) for na, nb, sa, sb in zip(*cols, strict=True)]
            yield b.filter(pa.array(ok, pa.bool_())).select(["a", "b"])

    return sized.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(lean(near), "a long, b long")


def _table(words: DataFrame) -> np.ndarray:
    """The filter's bits from ``words`` (word, bits): tasks pack theirs, so the driver gets a few arrays and no rows."""

    def pack(batches):
        import pyarrow as pa

        for b in batches:
            at, bits = (b.column(c).to_numpy().astype(np.uint32).tobytes() for c in ("word", "bits"))
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.binary()), pa.array([bits], pa.binary())], ["at", "bits"])

    table = np.zeros(FILTER_BITS // 32, np.uint32)
    for r in words.mapInArrow(lean(pack), "at binary, bits binary").collect():
        table[np.frombuffer(r["at"], np.uint32)] = np.frombuffer(r["bits"], np.uint32)
    return table


def _members(docs: DataFrame, classes: DataFrame, need: DataFrame) -> DataFrame:
    """(cls, members) of the classes ``need`` (cls), and of some others.

    A filter of ``FILTER_BITS`` bits over their ids keeps most other texts from the
    exchange; what passes it by chance does no harm.
    """
    reps = classes.join(need, "cls").select(F.col("rep").alias("doc_id"))
    slots = lambda: F.explode(F.array(*[F.pmod(F.xxhash64(F.lit(k), "doc_id"), F.lit(FILTER_BITS)) for k in range(2)]))
    words = reps.select(slots().alias("slot")).groupBy(F.shiftright("slot", 5).alias("word")).agg(F.expr("bit_or(shiftleft(1L, CAST(slot % 32 AS INT)))").alias("bits"))
    table = _table(words)
    held = docs.sparkSession.sparkContext.broadcast(table)

    def sets(batches):
        import pyarrow as pa

        for b in batches:
            ok = np.ones(b.num_rows, bool)
            for c in ("s0", "s1"):
                s = b.column(c).to_numpy()
                ok &= (held.value[s >> 5] >> (s & 31).astype(np.uint32)) & 1 > 0
            b = b.filter(pa.array(ok))
            for t in b.column("text").to_pylist():
                s = shingles(t)
                if len(s):
                    yield pa.RecordBatch.from_arrays([pa.array([set_class(s)], pa.int64()), pa.array([s.tobytes()], pa.binary())], ["cls", "members"])

    hashed = docs.where("doc_id IS NOT NULL").select("text", *[F.pmod(F.xxhash64(F.lit(k), "doc_id"), F.lit(FILTER_BITS)).alias(f"s{k}") for k in range(2)])
    return hashed.mapInArrow(lean(sets), "cls long, members binary").groupBy("cls").agg(F.first("members").alias("members"))


def _verify(pairs: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are linked, as (u, v, shared, united)."""

    def compare(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for x, y, ma, mb in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), batch.column("ma"), batch.column("mb"), strict=True):
                p, q = np.frombuffer(ma.as_buffer(), _U), np.frombuffer(mb.as_buffer(), _U)
                shared = len(np.intersect1d(p, q, assume_unique=True))
                united = len(p) + len(q) - shared
                if 100 * shared >= percent * united:
                    out.append((x, y, shared, united))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [[]] * 4)], ["u", "v", "shared", "united"])

    side = lambda x: members.select(F.col("cls").alias(x), F.col("members").alias(f"m{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.select("a", "b", "ma", "mb").mapInArrow(lean(compare), "u long, v long, shared long, united long")


def jaccard_links(docs: DataFrame, percent: int = 75, space: Scratch | None = None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(members, classes, links, components) of ``docs`` (doc_id, text).

    members: doc_id, n, cls, a row a document; classes: cls, rep (least doc_id), n,
    sketch; links (u, v, shared, united): verified pairs of classes that connect
    all linked classes; components (node, component): of the classes with links.
    Two texts with equal sets are in one class. ``space`` holds the tables.
    """
    space = space or Scratch(docs.sparkSession, "jaccard")
    id_type = dict(docs.dtypes)["doc_id"]
    docs = docs.select("doc_id", "text")
    profiles = space.keep(_profiles(docs, id_type), "profiles")
    members = profiles.where("n IS NOT NULL").select("doc_id", "n", "cls", "sketch")
    codes, common = _counter_codes(profiles)
    classes = members.where("n > 0 AND doc_id IS NOT NULL").groupBy("cls").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.max("sketch").alias("sketch"))
    classes = space.keep(classes, "classes")
    members = members.drop("sketch")
    groups = _groups(_candidates(docs.where("doc_id IS NOT NULL"), codes, common, percent), classes, space, percent)
    tops = groups.groupBy("gid").agg(F.max(F.when(F.col("cls") == F.col("leader"), F.struct("n", "reach"))).alias("top"))
    stars = groups.where("cls <> leader").join(tops, "gid").where((F.col("n") <= F.col("top.reach")) & (F.col("top.n") <= F.col("reach")))
    pairs = stars.select(F.least("cls", "leader").alias("a"), F.greatest("cls", "leader").alias("b")).distinct()
    pairs = space.keep(_prune(pairs, classes, percent), "pairs")
    sets = space.keep(_members(docs, classes, pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct()), "sets", "none")
    links = space.keep(_verify(pairs, sets, percent), "links")
    space.drop(pairs, sets)
    comp = space.keep(connected_components(links, space), "comp")
    rows = groups.where("cls <> leader")
    budget = max(ROUND_PAIRS, ROUND_SHARE * classes.count())
    while True:
        live = space.keep(_open(rows, comp), "open")
        if live.isEmpty():
            return members, classes, links, comp
        rest, pairs = _challenge(live, budget, space)
        pairs = space.keep(_prune(pairs, classes, percent), "pairs")
        if not pairs.isEmpty():
            sets = space.keep(_members(docs, classes, pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct()), "sets", "none")
            more = space.keep(_verify(pairs, sets, percent), "links")
            space.drop(sets)
            if not more.isEmpty():
                links = links.unionByName(more)
                comp = space.keep(merge_components(comp, more, space), "comp")
        rows = space.keep(rest, "rows")
        space.drop(pairs, live)


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) of ``docs`` (doc_id, text), a row a row.

    component_id is the least doc_id reachable by links; documents without words
    have only themselves. n_links counts the verified links of the document's
    class that were needed to connect it. A NULL doc_id is linked with nothing and
    has a NULL component. Rows that repeat a doc_id with other texts keep the
    component of their own text.
    """
    with Scratch(docs.sparkSession, "jaccard") as space:
        members, classes, links, comp = jaccard_links(docs, percent, space)
        roots = comp.join(classes.select(F.col("cls").alias("node"), "rep"), "node")
        least = roots.groupBy("component").agg(F.min("rep").alias("component_id"))
        ends = links.select(F.explode(F.array("u", "v")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
        linked = comp.join(least, "component").join(ends, "node", "left").select(F.col("node").alias("cls"), "component_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))
        by_class = classes.select("cls", "rep").join(linked, "cls", "left")
        by_class = by_class.select("cls", F.coalesce("component_id", "rep").alias("component_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))
        found = members.where("n > 0 AND doc_id IS NOT NULL").join(by_class, "cls").select("doc_id", F.col("n").alias("n_shingles"), "component_id", "n_links")
        alone = members.where("n = 0 OR doc_id IS NULL").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
        return materialize(found.unionByName(alone), "near")
