"""Near-duplicate documents by a MinHash LSH forest.

Every tree orders the documents by a signature of eight levels. In that order
documents with a long common prefix are neighbours: each one votes for the
first of its region and for the neighbour it shares the longest prefix with. A
region is a run with a common prefix of four levels, however many documents
share it; one of more than REGION documents is dealt out in pairs of blocks.

At similarity 0.8 a pair shares four levels in one tree with probability
0.41, and misses each other in all 24 trees three times in a million. Every link is
confirmed on the full shingle sets. Pairs are never written out: what is left to
compare in a region is compared where its documents meet, and only links leave.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindle.llm.components import components
from spindle.llm.minhash import LEVELS, TREES, alike, bits_of, hashed_shingles, shingles_of, signature, sketch, words_of
from spindle.llm.shared import staged

LEAST_DEPTH = 4
REGION = 1024  # documents of a block of a region
ROWS = 1_000_000  # of a sorted part of the forest
MARGIN = 0.12  # below the threshold; four deviations of the estimate from 192 hashes
BROADCAST = 2_000_000  # ids; 16 MB at most
DEPTHS = range(LEAST_DEPTH, LEVELS + 1)


def _signatures(size: int):
    def make(batches):
        for rows in batches:
            out = []
            for doc, text in zip(rows["doc_id"], rows["text"], strict=True):
                hashes = hashed_shingles(words_of(text or b""), size)
                least = signature(hashes)
                levels = (least >> np.uint32(16)).astype(">u2").reshape(TREES, LEVELS)
                longs = np.ascontiguousarray(levels).view(">i8").astype(np.int64)
                out.append((doc, len(hashes), xxhash.xxh3_128_digest(hashes.tobytes()), longs[:, 0], longs[:, 1], sketch(least)))
            yield pd.DataFrame(out, columns=["doc_id", "n", "key", "high", "low", "sketch"]).astype({"doc_id": "Int64"})

    return make


def _runs(*columns) -> np.ndarray:
    """Numbers the runs of equal rows."""
    new = np.zeros(len(columns[0]), dtype=bool)
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.cumsum(new)


def _name(tree, depth, high, low) -> np.ndarray:
    """A number for a prefix."""
    mixed = high.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + low.astype(np.uint64)
    mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) + tree.astype(np.uint64) * np.uint64(16) + np.uint64(depth)
    mixed = (mixed ^ (mixed >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (mixed ^ (mixed >> np.uint64(31))).view(np.int64)


def regions_of(tree, high, low, doc):
    """Of one sorted part: (region, doc) memberships and (doc, partner) votes.

    All documents of a run are members of its region. A run that touches an end
    of the part may go on in the next one, so there a single one is a member too."""
    if not len(doc):
        empty = np.empty(0, np.int64)
        return (empty, empty), (empty, empty)
    prefix = {d: low >> np.int64(16 * (LEVELS - d)) for d in DEPTHS}
    runs = {d: _runs(tree, high, prefix[d]) for d in DEPTHS}
    first = runs[LEAST_DEPTH]
    here = (np.bincount(first)[first] > 1) | (first == 0) | (first == first[-1])
    names = _name(tree[here], LEAST_DEPTH, high[here], prefix[LEAST_DEPTH][here])
    leader = np.full(first[-1] + 1, np.iinfo(np.int64).max)
    np.minimum.at(leader, first, doc)
    leader = leader[first]
    shared = np.zeros(len(doc) + 1, np.int64)  # depth shared with the one before; none at the ends
    for d in DEPTHS:
        shared[1:-1][runs[d][1:] == runs[d][:-1]] = d
    back = shared[:-1] >= shared[1:]
    neighbour = np.where(back, np.roll(doc, 1), np.roll(doc, -1))
    near = np.maximum(shared[:-1], shared[1:]) > 0
    votes = np.concatenate([doc, doc[near]]), np.concatenate([leader, neighbour[near]])
    real = votes[0] != votes[1]
    return (names, doc[here]), (votes[0][real], votes[1][real])


def _forest(batches):
    """Memberships (kind 0) and votes (kind 1) of a sorted part."""
    rows = [r for r in batches if len(r)]
    if rows:
        part = pd.concat(rows)
        member, vote = regions_of(*(part[c].to_numpy(np.int64) for c in ("tree", "high", "low", "doc_id")))
        for kind, (x, y) in enumerate((member, vote)):
            for start in range(0, len(x), 100_000):
                yield pd.DataFrame({"kind": kind, "x": x[start : start + 100_000], "y": y[start : start + 100_000]})


def _enough(common: int, m: int, n: int, percent: int) -> bool:
    return 100 * common >= percent * (m + n - common) > 0


def _needed(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """The texts of some documents. Only ids of a bounded number are broadcast."""
    ids = staged(ids.distinct(), "needed")
    few = ids.count() <= BROADCAST
    return staged(texts.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi"), "texts")


def _confirmed(pairs: DataFrame, sketches: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) that reach the similarity on their full shingle sets."""
    least = percent / 100 - MARGIN
    near = F.pandas_udf(lambda a, b: pd.Series(alike(bits_of(a), bits_of(b)) >= least), "boolean")
    side = lambda df, name, column: df.select(F.col("doc_id").alias(name), *[F.col(c).alias(f"{c}_{name}") for c in column])
    sized = pairs.join(side(sketches, "a", ["n", "sketch"]), "a").join(side(sketches, "b", ["n", "sketch"]), "b")
    likely = staged(sized.where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")).where(near("sketch_a", "sketch_b")).select("a", "b").distinct(), "likely")
    held = _needed(texts, likely.select(F.col("a").alias("doc_id")).union(likely.select("b")))

    def confirm(batches):
        for rows in batches:
            found = []
            for a, b in zip(rows["text_a"], rows["text_b"], strict=True):
                x, y = shingles_of(words_of(a), size), shingles_of(words_of(b), size)
                found.append(_enough(len(x & y), len(x), len(y), percent))
            yield rows.loc[found, ["a", "b"]]

    with_texts = likely.join(side(held, "a", ["text"]), "a").join(side(held, "b", ["text"]), "b")
    return staged(with_texts.mapInPandas(confirm, "a long, b long"), "links")


def _apart(sizes, bits, group, own, ids, low: int, high: int, percent: int):
    """For each document outside the largest component of a region: its place,
    and the places of those in other components that may be similar to it, by
    size and estimate, the most similar first. Each pair comes once."""
    main = np.bincount(group).argmax()
    for i in np.flatnonzero(group != main):
        others = np.flatnonzero((group != group[i]) & ((group == main) | (ids > ids[i])) & ((own != own[i]) | (low == high)))
        fits = 100 * np.minimum(sizes[others], sizes[i]) >= percent * np.maximum(sizes[others], sizes[i])
        others = others[fits]
        estimate = alike(bits[i], bits[others])
        order = np.argsort(-estimate, kind="stable")[: (estimate >= percent / 100 - MARGIN).sum()]
        if len(order):
            yield i, others[order]


def links_across(ids, components_, sizes, sketches, texts, own, low: int, high: int, size: int, percent: int):
    """Links between documents of different components in one region.

    Documents outside the largest component are compared with all likely ones,
    the most similar by estimate first; a link joins two components, and pairs
    inside one need no further look. In a region of several blocks a task has two
    of them and compares one with the other.
    """
    names, group = np.unique(components_, return_inverse=True)
    above = list(range(len(names)))

    def top(x: int) -> int:
        while above[x] != x:
            above[x] = x = above[above[x]]
        return x

    known: dict[int, np.ndarray] = {}

    def hashes(i: int) -> np.ndarray:
        if i not in known:
            known[i] = hashed_shingles(words_of(texts[i]), size)
        return known[i]

    found = []
    for i, others in _apart(sizes, bits_of(sketches), group, own, ids, low, high, percent):
        for j in others:
            if top(group[i]) == top(group[j]):
                continue
            x, y = hashes(i), hashes(j)
            if _enough(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y), percent):
                a, b = (shingles_of(words_of(texts[k]), size) for k in (i, j))
                if _enough(len(a & b), len(a), len(b), percent):
                    found.append((ids[i], ids[j]))
                    above[top(group[i])] = top(group[j])
    return found


def _across(placed: DataFrame, sketches: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Links (a, b) between components, from (region, doc_id, component).

    A crowded region has blocks of the documents outside its largest component,
    and after them blocks of those inside. A block of the first kind meets all
    blocks; two of the second hold no pair across components and do not meet."""
    sizes = placed.groupBy("region", "component").count()
    span = sizes.groupBy("region").agg(F.max(F.struct("count", "component")).alias("main"), F.sum("count").alias("members"), F.count("*").alias("n"))
    blocks = lambda n: F.ceil(n / REGION).cast("int")
    crowded = F.col("members") > REGION
    outer = F.when(crowded, blocks(F.col("members") - F.col("main.count"))).otherwise(1)
    inner = F.when(crowded, blocks(F.col("main.count"))).otherwise(0)
    several = staged(span.where("n > 1").select("region", F.col("main.component").alias("main"), outer.alias("outer"), inner.alias("inner")), "several")
    mixed = staged(placed.join(several, "region"), "mixed")
    is_inner = (F.col("inner") > 0) & (F.col("component") == F.col("main"))
    deal = lambda n: F.pmod(F.xxhash64("doc_id"), n).cast("int")
    own = F.when(is_inner, F.col("outer") + deal(F.greatest("inner", F.lit(1)))).otherwise(deal(F.col("outer")))
    meets = F.sequence(F.lit(0), F.col("outer") + F.when(is_inner, 0).otherwise(F.col("inner")) - 1)
    tasks = mixed.select("region", "doc_id", "component", own.alias("own"), F.explode(meets).alias("other"))
    dealt = tasks.select("region", "doc_id", "component", "own", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))
    shared = mixed.groupBy("doc_id").agg(F.collect_list("region").alias("regions"))  # some of each tree
    light = staged(sketches.select("doc_id", "n", "sketch").join(shared, "doc_id"), "light")

    def promising(rows: pd.DataFrame) -> pd.DataFrame:
        region, low, high = (int(rows[c].iloc[0]) for c in ("region", "low", "high"))
        ids, sizes, own = (rows[c].to_numpy() for c in ("doc_id", "n", "own"))
        group = np.unique(rows["component"].to_numpy(), return_inverse=True)[1]
        some, places = np.zeros(len(ids), dtype=bool), [frozenset(r) for r in rows["regions"]]
        for i, others in _apart(sizes, bits_of(rows["sketch"]), group, own, ids, low, high, percent):
            here = [j for j in others if min(places[i] & places[j]) == region]
            if here:
                some[i] = some[here] = True
        return pd.DataFrame({"region": region, "doc_id": ids[some]})

    # a pair that shares several regions is compared in the first of them, and only documents with such a pair go on with their texts
    hopeful = staged(dealt.join(light, "doc_id").groupBy("region", "low", "high").applyInPandas(promising, "region long, doc_id long").distinct(), "hopeful")
    dealt = dealt.join(hopeful, ["region", "doc_id"], "left_semi")
    facts = staged(_needed(texts, hopeful.select("doc_id")).join(light.drop("regions"), "doc_id"), "facts")

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("doc_id", kind="stable")
        low, high = (int(rows[c].iloc[0]) for c in ("low", "high"))
        columns = [rows[c].to_numpy() for c in ("doc_id", "component", "n")]
        found = links_across(*columns, rows["sketch"], rows["text"].tolist(), rows["own"].to_numpy(), low, high, size, percent)
        return pd.DataFrame(found, columns=["a", "b"], dtype=np.int64)

    return staged(dealt.join(facts, "doc_id").groupBy("region", "low", "high").applyInPandas(compare, "a long, b long"), "links")


def near_documents(documents: DataFrame, size: int = 5, percent: int = 80, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per row of `documents`.

    Texts are lower-cased (A to Z) and cut into words at space and \\x09 to
    \\x0d. The set of a text is its distinct runs of `size` words, or the whole
    sequence if there are fewer words; null and empty texts and texts of white
    space have an empty set and no links. Documents are linked if 100 times the
    size of the intersection is at least `percent` times that of the union.
    component_id is the smallest doc_id reachable over links, the document
    itself included; kept marks that smallest one. Rows that repeat a doc_id are
    one document. Rows without a doc_id link with nothing, have no component and
    are kept. Other columns are not looked at.

    1. Equal sets are one class, represented by its smallest doc_id.
    2. Each representative is compared with the partner that most trees vote
       for; confirmed links give first components.
    3. In regions that still hold several components, the pairs across
       components are compared. Pairs inside one component need no look, since
       they cannot change the result. A region of more than REGION documents is
       dealt out in blocks, so its size changes the work and not the pairs.
    """
    texts = documents.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").cast("binary").alias("text"))
    signed = staged(texts.mapInPandas(_signatures(size), "doc_id long, n long, key binary, high array<long>, low array<long>, sketch binary"), "signatures")
    real = signed.where("doc_id IS NOT NULL AND n > 0")
    classes = staged(real.groupBy("key").agg(F.min("doc_id").alias("class")), "classes")
    members = staged(real.select("key", "doc_id").join(classes, "key").select("doc_id", "class").distinct(), "members")
    single = staged(real.select("doc_id", "n", "sketch", "high", "low").join(classes.select(F.col("class").alias("doc_id")), "doc_id", "left_semi"), "representatives")
    sketches = single.select("doc_id", "n", "sketch")

    leaves = single.select("doc_id", F.posexplode(F.arrays_zip("high", "low")).alias("tree", "at")).select("tree", "at.high", "at.low", "doc_id")
    parts = max(int(signed.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-single.count() * TREES // ROWS))
    order = ["tree", "high", "low", "doc_id"]
    forest = staged(leaves.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInPandas(_forest, "kind int, x long, y long"), "forest")

    votes = forest.where("kind = 1").groupBy(F.col("x").alias("a"), F.col("y").alias("b")).count()
    favourite = votes.groupBy("a").agg(F.max_by("b", F.struct("count", -F.col("b"))).alias("b"))
    texts = texts.where("doc_id IS NOT NULL AND text IS NOT NULL")
    links = _confirmed(favourite, sketches, texts, size, percent)
    joined = staged(components(links), "joined")

    in_regions = forest.where("kind = 0").select(F.col("x").alias("region"), F.col("y").alias("doc_id"))
    placed = staged(in_regions.join(joined.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left").select("region", "doc_id", F.coalesce("component", "doc_id").alias("component")).distinct(), "placed")
    links = links.union(_across(placed, sketches, texts, size, percent))

    reached = components(links.union(members.select("doc_id", "class")))
    component = F.coalesce("component", "doc_id")
    result = signed.select("doc_id", "n").join(reached.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    kept = F.coalesce(F.col("doc_id") == component, F.lit(True))
    return result.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), kept.alias("kept"))
