"""N-gram Jaccard join: T-occurrence search with DivideSkip, over all documents.

Documents with the same shingle set form a class, and only class representatives are joined.
A shingle that one class has can't be shared, so a census (see blocks) tells every block how many
classes have each of its shingles; a representative then posts, of the rarest shingles that any
partner must share SHARE of, only those that another class has. Lists of postings give pairs that
meet often enough, which is what keeps chance meetings out; a list too long for its pairs links its
documents in a chain. Linked representatives come together in a unit with their whole sets. In a
unit, T-occurrence search finds the partners: short inverted lists are merged, long ones are probed
by binary search, and documents that reach the required overlap are retained. Units give each
representative's number of links and a spanning forest of them, never the pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import PLACE_BITS, Block, answer, attach, census, each, ranges, stage
from .components import components
from .shared import back, join_skewed, keep, shared_folder, wide
from .wordscan import Words, mix

#: Bytes of shingle sets that a unit, or each side of a unit of two slabs, has.
UNIT_BYTES = 4 << 20
#: Shared shingles among the rarest that make two documents candidates (fewer where sets are smaller).
SHARE = 6
#: Documents of a list whose pairs are counted; longer lists link all their documents.
PAIRED = 64
#: DivideSkip's weight of the number of long lists.
MU = 0.0085


def shingle_sets(texts: list[bytes], width: int = 2) -> list[np.ndarray]:
    """Ascending 64-bit hashes of each text's different shingles of ``width`` words, a shorter text's words as one; words end at space or 0x09-0x0D, A-Z lower-cased."""
    out: list[np.ndarray] = []
    for lo in range(0, len(texts), 64):
        w = Words(texts[lo : lo + 64], lower=True)
        h = w.hashes()
        g = h.copy()
        for k in range(1, width):
            g[:-k] = mix(g[:-k] * np.uint64(3) + h[k:])
        first = w.first.tolist()
        for a, b in zip(first, first[1:], strict=False):
            if b - a >= width:
                out.append(np.unique(g[a : b - width + 1]))
            elif b > a:  # the whole sequence, apart from all shingles of full width
                out.append(np.array([xxhash.xxh64_intdigest(h[a:b].tobytes(), 7)], dtype=np.uint64))
            else:
                out.append(h[:0])
    return out


def _sign(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for block, _ in each(batches):
        sets = shingle_sets(block.texts, width)
        marks = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), dtype=np.int64).reshape(-1, 2)
        uids = np.arange(len(sets), dtype=np.int64) + (block.number << PLACE_BITS)
        yield pa.RecordBatch.from_arrays([pa.array(uids), pa.array(block.ids), pa.array([len(s) for s in sets], pa.int64()), pa.array(marks[:, 0]), pa.array(marks[:, 1])], names=["uid", "id", "n", "s1", "s2"])


def _chosen(block: Block, row: dict, width: int) -> tuple[np.ndarray, list[np.ndarray]]:
    places = np.sort(np.array(row["places"].split(" "), dtype=np.int64))
    return places, shingle_sets([block.texts[p] for p in places], width)


def _prefixes(batches: Iterator[pa.RecordBatch], width: int, num: int, den: int, n_ranges: int) -> Iterator[pa.RecordBatch]:
    """Postings of a block by range of shingles: those among each representative's rarest that another class has."""
    zip_ = zstandard.ZstdCompressor(level=1)
    for block, row in each(batches):
        places, sets = _chosen(block, row, width)
        if not sets:
            continue
        codes = answer(row)
        every = np.concatenate(sets)
        sizes = np.array([len(s) for s in sets])
        u, at = np.unique(every, return_inverse=True)
        c = codes[at]
        owner = np.repeat(np.arange(len(sets)), sizes)
        order = np.lexsort((every, c, owner))  # rare ones first, alike in all blocks
        place = np.arange(len(every)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        least = (num * sizes + den - 1) // den  # shared with any partner
        length = sizes - least + np.minimum(least, SHARE)
        chosen = order[(place < np.repeat(length, sizes)) & (c[order] > 1)]
        token, own = every[chosen], owner[chosen]
        if not len(token):
            continue
        by = np.argsort(token, kind="stable")
        token, own = token[by], own[by]
        r = ranges(token, n_ranges)
        cut = np.flatnonzero(np.diff(r)) + 1
        uid = places[own] + (block.number << PLACE_BITS)
        # within a range the lower half tells shingles apart but for chance, which only makes candidates
        parts = [[zip_.compress(x.tobytes()) for x in np.split(y.astype(np.uint32), cut)] for y in (token & np.uint64(0xFFFFFFFF), places[own], sizes[own])]
        firsts = r[np.r_[0, cut]].astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(firsts), pa.array([block.number] * len(firsts), pa.int64()), *(pa.array(x, pa.binary()) for x in parts)], names=["range", "block", "tokens", "places", "ns"])


def _weigh(pairs: list[np.ndarray], weights: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Different pairs (rows) and their weights' sums, up to SHARE."""
    every, w = np.concatenate(pairs), np.concatenate(weights)
    order = np.lexsort((every[:, 1], every[:, 0]))
    every, w = every[order], w[order].astype(np.int64)
    head = np.flatnonzero(np.r_[True, (every[1:] != every[:-1]).any(axis=1)][: len(every)])
    return every[head], np.minimum(np.add.reduceat(w, head) if len(head) else w[:0], SHARE).astype(np.uint8)


def _lists(table: pa.Table, num: int, den: int, n_ranges: int) -> pa.Table:
    """Postings of one range to weighted pairs, by range of the pair; SHARE is the weight of a candidate."""
    unzip = zstandard.ZstdDecompressor()
    parts = {c: [np.frombuffer(unzip.decompress(x.as_py()), dtype=np.uint32) for x in table[c]] for c in ("tokens", "places", "ns")}
    token, n = np.concatenate(parts["tokens"]), np.concatenate(parts["ns"]).astype(np.int64)
    uid = np.concatenate(parts["places"]).astype(np.int64) + (np.repeat(table["block"].to_numpy(), list(map(len, parts["places"]))) << PLACE_BITS)
    order = np.lexsort((uid, n, token))
    token, uid, n = token[order], uid[order], n[order]
    pairs, weights, held = [np.zeros((0, 2), dtype=np.int64)], [np.zeros(0, dtype=np.uint8)], 0

    def add(i: np.ndarray, j: np.ndarray, sure: bool = False) -> None:
        nonlocal pairs, weights, held
        ok = den * n[i] >= num * n[j]
        i, j = i[ok], j[ok]
        pairs.append(np.stack([uid[i], uid[j]], axis=1))
        # a small set must share fewer, so each of them weighs more
        fewest = np.minimum((num * n[i] + den - 1) // den, SHARE)
        weights.append(np.full(len(i), SHARE, dtype=np.uint8) if sure else (-(-SHARE // fewest)).astype(np.uint8))
        held += len(i)
        if held > 600_000:
            p, w = _weigh(pairs, weights)
            pairs, weights, held = [p], [w], 0

    start = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
    length = np.diff(np.r_[start, len(token)])
    for size in np.unique(length[(length > 1) & (length <= PAIRED)]).tolist():
        x, y = np.triu_indices(size, 1)
        of = start[length == size]
        for part in np.array_split(of, max(1, len(of) * len(x) // 1_000_000)):
            add((part[:, None] + x).ravel(), (part[:, None] + y).ravel())
    in_long = np.repeat(length > PAIRED, length)
    i = np.flatnonzero(in_long[:-1] & (token[1:] == token[:-1]))
    add(i, i + 1, sure=True)  # neighbours by size suffice: if two sizes allow a match, so do all between
    p, w = _weigh(pairs, weights)
    p.sort(axis=1)
    r = ranges(mix(p[:, 0].astype(np.uint64)), n_ranges)
    order = np.lexsort((p[:, 1], p[:, 0], r))
    p, w, r = p[order], w[order], r[order]
    cut = np.flatnonzero(np.diff(r)) + 1
    zip_ = zstandard.ZstdCompressor(level=3)
    parts = [[zip_.compress(x.tobytes()) for x in np.split(y, cut)] for y in (p[:, 0].copy(), p[:, 1].copy(), w)] if len(p) else [[], [], []]
    return pa.table({"range": pa.array(r[np.r_[0, cut]].astype(np.int32) if len(p) else np.zeros(0, dtype=np.int32)), **{c: pa.array(x, pa.binary()) for c, x in zip(("a", "b", "w"), parts, strict=True)}})


def _meet(table: pa.Table) -> pa.Table:
    """Weighted pairs of one range to candidate pairs."""
    unzip = zstandard.ZstdDecompressor()
    cat = lambda c, t: np.concatenate([np.frombuffer(unzip.decompress(x.as_py()), dtype=t) for x in table[c]])
    p, w = _weigh([np.stack([cat("a", np.int64), cat("b", np.int64)], axis=1)], [cat("w", np.uint8)])
    p = p[w >= SHARE]
    return pa.table({"a": pa.array(p[:, 0]), "b": pa.array(p[:, 1])})


def _sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """The whole sets of the representatives that a block's row names, once for each of their units."""
    for block, row in each(batches):
        jobs = np.array([x.split(",") for x in row["jobs"].split(" ")], dtype=np.int64)  # place, unit, side, size, root
        places, at = np.unique(jobs[:, 0], return_inverse=True)
        sets = [x.tobytes() for x in shingle_sets([block.texts[p] for p in places], width)]
        n = np.array([len(x) // 8 for x in sets])
        yield pa.RecordBatch.from_arrays(
            [*(pa.array(np.ascontiguousarray(jobs[:, c])) for c in (1, 2, 3, 4)), pa.array(jobs[:, 0] + (block.number << PLACE_BITS)), pa.array(n[at]), pa.array([sets[i] for i in at], pa.binary())],
            names=["unit", "side", "size", "root", "uid", "n", "shingles"],
        )


def divide_skip(n: np.ndarray, uid: np.ndarray, size: np.ndarray, sets: list[np.ndarray], side: np.ndarray | None, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of each document (weighted by the partner's ``size``) and the smallest index connected to it.

    A document queries those that follow it by (n, uid). With ``side`` only pairs across sides count.
    Required overlap: |x & y| * (num + den) >= num * (|x| + |y|).
    """
    m = len(n)
    links, root = np.zeros(m, dtype=np.int64), np.arange(m)
    order = np.lexsort((uid, n))
    rank = np.empty(m, dtype=np.int64)
    rank[order] = np.arange(m)
    ns, sizes = n[order], size[order]
    sides = None if side is None else side[order]
    counts = np.array([len(s) for s in sets])
    token, at = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(rank, counts)
    o = np.lexsort((owner, at))
    postings, t = owner[o], at[o]
    begin = np.searchsorted(t, np.arange(len(token) + 1))
    length = np.diff(begin)
    starts = np.cumsum(counts) - counts
    links_r, root_r = np.zeros(m, dtype=np.int64), np.arange(m)
    for x in range(m):
        d = order[x]
        own = at[starts[d] : starts[d] + counts[d]]
        own = own[length[own] > 1]
        size_x = int(ns[x])
        need = -(-2 * num * size_x // (num + den))  # partners are no smaller
        if len(own) < need:
            continue
        own = own[np.argsort(length[own], kind="stable")]
        longest = int(length[own[-1]])
        n_long = min(need - 1, int(need / (MU * math.log2(longest + 1) + 1)), int((length[own] > 32).sum()))
        short, long_ = (own[:-n_long], own[-n_long:]) if n_long else (own, own[:0])
        lens = length[short]
        total = int(lens.sum())
        # one merge of all short lists
        where = np.repeat(begin[short] - (np.cumsum(lens) - lens), lens) + np.arange(total)
        merged = postings[where]
        merged = merged[merged > x]
        if len(merged) * 4 < m:
            y, hits = np.unique(merged, return_counts=True)
        else:
            hits = np.bincount(merged, minlength=m)
            y = np.flatnonzero(hits)
            hits = hits[y]
        keep_ = (hits >= need - n_long) & (num * ns[y] <= den * size_x)
        if sides is not None:
            keep_ &= sides[y] != sides[x]
        y, hits = y[keep_], hits[keep_]
        for k in long_:
            if not len(y):
                break
            some = postings[begin[k] : begin[k + 1]]
            i = np.searchsorted(some, y)
            hits = hits + (some[np.minimum(i, len(some) - 1)] == y)
        y = y[hits * (num + den) >= num * (size_x + ns[y])]
        if len(y):
            links_r[x] += sizes[y].sum()
            links_r[y] += sizes[x]
            group = np.append(y, x)
            r = root_r[group]
            while (up := root_r[r]).tobytes() != r.tobytes():
                r = up
            root_r[np.unique(r)] = r.min()
            root_r[group] = r.min()
    while (up := root_r[root_r]).tobytes() != root_r.tobytes():
        root_r = up
    links[order] = links_r
    root[order] = order[root_r]
    return links, root


def _search(table: pa.Table, num: int, den: int) -> pa.Table:
    """The links in one unit: (uid, links, root)."""
    uid, n, size, comp, side = (table[c].to_numpy() for c in ("uid", "n", "size", "root", "side"))
    sets = [np.frombuffer(x.as_py(), dtype=np.uint64) for x in table["shingles"]]
    order = np.argsort(comp, kind="stable")
    out = [[], [], []]
    for part in np.split(order, np.flatnonzero(np.diff(comp[order])) + 1):
        if len(part) < 2:
            continue
        links, root = divide_skip(n[part], uid[part], size[part], [sets[i] for i in part], side[part] if side[part].min() >= 0 else None, num, den)
        hit = links > 0
        out[0].append(uid[part][hit])
        out[1].append(links[hit])
        out[2].append(uid[part][root[hit]])
    cat = [np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in out]
    return pa.table({"uid": pa.array(cat[0]), "links": pa.array(cat[1]), "near": pa.array(cat[2])})


def _units(reps: DataFrame, num: int, den: int, unit_bytes: int) -> DataFrame:
    """``reps`` (uid, n, size, root) with the unit and side of each copy that is searched.

    Components of at most ``unit_bytes`` share units whole. A larger one is cut into slabs by size
    class and hash; every two slabs whose classes allow a match make a unit.
    """
    bounds = [1]
    while bounds[-1] < 1 << 31:
        bounds.append(bounds[-1] * den // num + 1)  # a partner's class is the next at most
    k = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col("n")))
    reps = reps.withColumn("k", k)
    by_class = reps.groupBy("root", "k").agg(F.sum(F.col("n") * 8).alias("bytes"))
    stats = by_class.groupBy("root").agg(F.sum("bytes").alias("total"), F.map_from_entries(F.collect_list(F.struct("k", F.ceil(F.col("bytes") / unit_bytes).cast("int").alias("slabs")))).alias("slabs"))  # a map of some 40 entries at most
    df = reps.join(stats, "root")
    total = by_class.agg(F.sum("bytes")).first()[0] or 0
    small = df.filter(F.col("total") <= unit_bytes).withColumn("unit", F.pmod(F.xxhash64("root"), F.lit(wide(reps.sparkSession, total, unit_bytes)))).withColumn("side", F.lit(-1))
    slabs = lambda c: F.coalesce(F.try_element_at("slabs", c), F.lit(0))
    large = df.filter(F.col("total") > unit_bytes).withColumn("j", F.pmod(F.xxhash64("uid"), slabs(F.col("k"))).cast("int"))
    seq = lambda c: F.when(slabs(c) > 0, F.sequence(F.lit(0), slabs(c) - 1)).otherwise(F.array().cast("array<int>"))
    pair = lambda k1, j1, k2, j2, s: F.struct(F.xxhash64("root", k1, j1, k2, j2).alias("unit"), s.alias("side"))
    here = F.transform(seq(F.col("k")), lambda t: pair(F.col("k"), F.least("j", t), F.col("k"), F.greatest("j", t), F.when(t == F.col("j"), -1).when(t > F.col("j"), 0).otherwise(1)))
    up = F.transform(seq(F.col("k") + 1), lambda t: pair(F.col("k"), F.col("j"), F.col("k") + 1, t, F.lit(0)))
    down = F.transform(seq(F.col("k") - 1), lambda t: pair(F.col("k") - 1, t, F.col("k"), F.col("j"), F.lit(1)))
    large = large.withColumn("x", F.explode(F.concat(here, up, down))).select("*", "x.unit", "x.side")
    cols = ["uid", "size", "root", "unit", "side"]
    return small.select(cols).unionByName(large.select(cols))


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 2, percent: int = 60, unit_bytes: int = UNIT_BYTES) -> DataFrame:
    """One row per row of ``docs``: id_col, n_shingles, n_similar, component_id.

    Words are runs of characters other than space and 0x09-0x0D, with A-Z lower-cased; a document's set
    holds its different shingles of ``width`` words, or all its words as one shingle if it has fewer.
    Two documents link when |x & y| * 100 >= percent * |x | y|. n_similar counts the other rows that a
    row links to; component_id is the smallest id reachable by links, its own included. A null or empty
    text, or one of white space, has an empty set and no links. Rows that repeat an id are documents of
    their own. Rows without an id come before all others: their component_id is null, as for all that
    they reach. An empty table gives an empty result. Other columns are not looked at. Nothing is
    capped: frequent shingles, large groups of copies and long texts only make more units.
    """
    spark = docs.sparkSession
    at = shared_folder(spark, "jaccard")
    gcd = math.gcd(percent, 100)
    num, den = percent // gcd, 100 // gcd
    blocks = stage(docs, f"{at}/blocks", id_col, text_col)
    sets = keep(blocks.mapInArrow(lambda it: _sign(it, width), "uid long, id long, n long, s1 long, s2 long"), f"{at}/sets")
    classes = keep(sets.filter("n > 0").groupBy("s1", "s2", "n").agg(F.min(F.struct("id", "uid")).alias("rep"), F.count("*").alias("size")).select("s1", "s2", "n", "rep.id", "rep.uid", "size"), f"{at}/classes")

    def by_block(reps: DataFrame) -> DataFrame:
        places = F.collect_list(F.col("uid").bitwiseAND((1 << PLACE_BITS) - 1).cast("string"))
        return reps.groupBy(F.shiftright("uid", PLACE_BITS).alias("block")).agg(F.array_join(F.sort_array(places), " ").alias("places"))

    chosen = attach(blocks, keep(by_block(classes), f"{at}/live"), "places")

    def keys(block: Block, row: dict) -> tuple[np.ndarray, np.ndarray]:
        _, s = _chosen(block, row, width)
        return np.unique(np.concatenate(s), return_counts=True)

    shingles = classes.agg(F.sum("n")).first()[0] or 0
    asked = chosen.join(census(chosen, keys, shingles), "block")
    n_lists, n_pairs = wide(spark, shingles * 2, 16 << 20), wide(spark, shingles, 16 << 20)
    posted = asked.mapInArrow(lambda it: _prefixes(it, width, num, den, n_lists), "range int, block long, tokens binary, places binary, ns binary")
    pairs = posted.groupBy("range").applyInArrow(lambda t: _lists(t, num, den, n_pairs), "range int, a binary, b binary, w binary")
    near = pairs.groupBy("range").applyInArrow(_meet, "a long, b long")
    comp = components(near, f"{at}/near")
    roots = comp.union(comp.select("root", "root").distinct()).toDF("uid", "root")
    reps = keep(classes.select("uid", "n", "size").join(roots, "uid"), f"{at}/reps")
    job = F.concat_ws(",", F.col("uid").bitwiseAND((1 << PLACE_BITS) - 1), "unit", "side", "size", "root")
    jobs = _units(reps, num, den, unit_bytes).groupBy(F.shiftright("uid", PLACE_BITS).alias("block")).agg(F.concat_ws(" ", F.collect_list(job)).alias("jobs"))
    units = attach(blocks, keep(jobs, f"{at}/jobs"), "jobs").mapInArrow(lambda it: _sets(it, width), "unit long, side long, size long, root long, uid long, n long, shingles binary")
    found = keep(units.groupBy("unit").applyInArrow(lambda t: _search(t, num, den), "uid long, links long, near long"), f"{at}/found")

    links = found.groupBy("uid").agg(F.sum("links").alias("links"))
    forest = components(found.select("uid", "near"), f"{at}/links")
    named = classes.join(links, "uid", "left").join(forest.withColumnRenamed("v", "uid"), "uid", "left").withColumn("root", F.coalesce("root", "uid"))
    joined_up = named.filter("links > 0")
    lowest = joined_up.groupBy("root").agg(F.min("id").alias("lowest"))
    done = keep(named.join(lowest, "root", "left").select("s1", "s2", "n", "size", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_similar"), F.coalesce("lowest", "id").alias("component")), f"{at}/done")
    out = join_skewed(sets, done, ["s1", "s2", "n"], "size", sets.count())
    return out.select(back("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("n_similar", F.lit(0).cast("long")).alias("n_similar"), F.coalesce("component", "id").alias("component")).withColumn("component", back("component")).withColumnRenamed("component", "component_id")
