"""SimHash near-duplicates: fingerprints compared exactly, tile against tile, with exclusive-or and bit counts.

Where the similarity of shingles decides, fingerprints only find the candidates; each is verified by its sets of shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimscope.llm.common import written
from claimscope.llm.components import components

SEED = 42
SIDE = 16_384  # fingerprints in a block; two blocks are one task's work
COPIES, SIDE_MOST = 8, 262_144  # where sets decide, a cell has at most so many blocks, unless they would hold more rows than this
TILE = 512  # fingerprints in a tile
CHUNK = 1 << 17  # words of a text whose bits are counted at once
LINKS = 1 << 21  # links that a task holds before it reduces them to a forest
CLUMP_NODES = 1024  # texts of a clump that one task verifies at once, or half of them
CLUMP_GRAMS = 1 << 20  # and their shingles
MINIMA = 4  # smallest hashes of a text, by different hash functions, by which near copies meet first
_ODD = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15)


def _mixed(hashes: np.ndarray, turn: int) -> np.ndarray:
    """Another 64 independent bits for each hash."""
    x = hashes + np.uint64((turn * _ODD[2]) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(_ODD[0])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(_ODD[1])
    return x ^ (x >> np.uint64(31))


def fingerprint(text: str | None, shingle: int, lanes: int) -> bytes:
    """``lanes`` x 64 majority bits over the hashes of all word shingles, repeats included; no words give zero."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return bytes(8 * lanes)
    size = min(shingle, len(words))
    total = len(words) - size + 1
    ones = np.zeros((lanes, 64), np.int64)
    for start in range(0, total, CHUNK):
        part = words[start : start + CHUNK + size - 1]
        grams = map(b" ".join, zip(*(part[i:] for i in range(size)), strict=False))
        hashes = np.fromiter((xxhash.xxh64_intdigest(gram, SEED) for gram in grams), np.uint64)
        for lane in range(lanes):
            bits = (_mixed(hashes, lane) if lane else hashes).astype(">u8").view(np.uint8).reshape(-1, 8)
            ones[lane] += np.unpackbits(bits, axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > total).tobytes()


def with_fingerprint(docs: DataFrame, text: str, name: str, shingle: int = 3, lanes: int = 1) -> DataFrame:
    """Add the fingerprint of the whole text, as 8 x ``lanes`` bytes."""

    @F.pandas_udf("binary")
    def of(texts: pd.Series) -> pd.Series:
        return texts.map(lambda value: fingerprint(value, shingle, lanes))

    return docs.withColumn(name, of(F.coalesce(F.col(text), F.lit(""))))


def shingles(text: str | None, shingle: int) -> np.ndarray:
    """The distinct hashes of all word shingles, in order; a text with fewer words than a shingle is one, no words give none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    size = min(shingle, len(words))
    grams = map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False))
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(gram, SEED) for gram in grams), np.uint64))


def _sketch(text: str | None, shingle: int, lanes: int) -> tuple[bytes, bytes, int, list[int]]:
    """Name and fingerprint of a text's set of shingles, its size, and its smallest hash by each of some hash functions."""
    grams = shingles(text, shingle)
    name = xxhash.xxh3_128_digest(grams.tobytes())
    if not len(grams):
        return name, bytes(8 * lanes), 0, []
    ones = np.zeros((lanes, 64), np.int64)
    for start in range(0, len(grams), CHUNK):
        part = grams[start : start + CHUNK]
        for lane in range(lanes):
            bits = (_mixed(part, lane) if lane else part).astype(">u8").view(np.uint8).reshape(-1, 8)
            ones[lane] += np.unpackbits(bits, axis=1).sum(axis=0, dtype=np.int64)
    lowest = [int(_mixed(grams, lanes + k).min().view(np.int64)) for k in range(MINIMA)]
    return name, np.packbits(2 * ones > len(grams)).tobytes(), len(grams), lowest


def _forest(size: int, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links with the same components: from each node to the smallest one of its component."""
    label = np.arange(size)
    while True:
        low = np.minimum(label[left], label[right])
        before = label.copy()
        np.minimum.at(label, label[left], low)
        np.minimum.at(label, label[right], low)
        label = label[label]
        if np.array_equal(label, before) and np.array_equal(label[left], label[right]):
            nodes = np.flatnonzero(label != np.arange(size))
            return nodes, label[nodes]


def _part_counts(prints: np.ndarray) -> np.ndarray:
    """Population counts of the four quarters of each fingerprint."""
    return np.bitwise_count(prints.view(np.uint8)).reshape(len(prints), 4, -1).sum(axis=2, dtype=np.int32)


def _close(left: np.ndarray, right: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all pairs within the radius. The later lanes are only read where the first two leave room."""
    lanes = left.shape[1]
    bits = np.bitwise_count(left[:, None, 0] ^ right[None, :, 0])
    if lanes > 1:
        bits = bits + np.bitwise_count(left[:, None, 1] ^ right[None, :, 1])
    i, j = np.nonzero(bits <= radius)
    if lanes > 2 and len(i):
        far = bits[i, j] + np.bitwise_count(left[i, 2:] ^ right[j, 2:]).sum(axis=1)
        i, j = i[far <= radius], j[far <= radius]
    return i, j


def _compare(left: np.ndarray, right: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the links between two blocks, or within one (``right`` is None), as positions in both blocks together.

    Rows come in the order of their quarters' population counts. Two fingerprints differ in at least as many bits as those
    counts do, so a pair of tiles whose ranges of counts lie further apart than the radius is skipped.
    """
    alone, right = right is None, left if right is None else right
    shift = 0 if alone else len(left)
    boxes = []
    for rows in (left, right):
        counts = _part_counts(rows)
        cuts = range(0, len(rows), TILE)
        boxes.append((np.array([counts[c : c + TILE].min(axis=0) for c in cuts]), np.array([counts[c : c + TILE].max(axis=0) for c in cuts])))
    (low_a, high_a), (low_b, high_b) = boxes
    size, held = len(left) + (0 if alone else len(right)), 0
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for x in range(len(low_a)):
        gap = np.maximum(0, np.maximum(low_a[x] - high_b, low_b - high_a[x])).sum(axis=1)
        for y in np.flatnonzero(gap <= radius):
            if alone and y < x:
                continue
            i, j = _close(left[x * TILE : (x + 1) * TILE], right[y * TILE : (y + 1) * TILE], radius)
            if len(i):
                found.append((i + x * TILE, j + y * TILE + shift))
                held += len(i)
                if held > LINKS:
                    found = [_forest(size, np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]))]
                    held = len(found[0][0])
    if not found:
        return np.zeros(0, int), np.zeros(0, int)
    return _forest(size, np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]))


def _sizes(rows: np.ndarray) -> np.ndarray:
    return rows[:, -1].byteswap().astype(np.int64)


def _pairs_apart(
    left: np.ndarray, right: np.ndarray | None, radius: int, lanes: int, similarity: float
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs within the radius, of sizes that allow the similarity, whose components differ; positions as in ``_compare``.

    The pairs of two tiles are handed on before the next ones are looked for: at most ``TILE`` squared at once.
    Rows are the fingerprint's lanes, two words of name, two of component and the size; they come in the order of sizes, and
    tiles whose sizes lie too far apart are skipped.
    """
    alone, right = right is None, left if right is None else right
    shift = 0 if alone else len(left)
    both = left if alone else np.concatenate([left, right])
    label = np.unique(both[:, lanes + 2 : lanes + 4], axis=0, return_inverse=True)[1].reshape(-1)
    size = _sizes(both)
    for x in range(0, len(left), TILE):
        for y in range(x if alone else 0, len(right), TILE):
            a, b = size[: len(left)][x : x + TILE], size[shift:][y : y + TILE]
            if a[-1] < similarity * b[0] - 1e-6 or b[-1] < similarity * a[0] - 1e-6:
                continue
            bits = np.zeros((len(left[x : x + TILE]), len(right[y : y + TILE])), np.uint16)
            for lane in range(lanes):
                bits += np.bitwise_count(left[x : x + TILE, None, lane] ^ right[None, y : y + TILE, lane])
            i, j = np.nonzero(bits <= radius)
            i, j = i + x, j + y + shift
            fits = (label[i] != label[j]) & (np.minimum(size[i], size[j]) >= similarity * np.maximum(size[i], size[j]) - 1e-6)
            if alone:
                fits &= i < j
            if fits.any():
                yield i[fits], j[fits]


def _spanning(size: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """A forest of all ``pairs``, of which at most ``LINKS`` and one portion are held at a time."""
    found, held = [], 0
    for i, j in pairs:
        found.append((i, j))
        held += len(i)
        if held > LINKS:
            found = [_forest(size, *map(np.concatenate, zip(*found, strict=True)))]
            held = len(found[0][0])
    return _forest(size, *map(np.concatenate, zip(*found, strict=True))) if found else (np.zeros(0, int), np.zeros(0, int))


def _similar(rows: np.ndarray, sets: list[np.ndarray], pairs: Iterator[tuple[np.ndarray, np.ndarray]], lanes: int, similarity: float) -> list[tuple[int, int]]:
    """A forest of those ``pairs`` of positions whose sets of shingles are similar enough, and lie in different components of ``rows``.

    Pairs that what was found before connects already aren't looked at.
    """
    ends = np.cumsum([0, *map(len, sets)])
    known, ids = np.unique(np.concatenate(sets), return_inverse=True)
    sizes, own = np.diff(ends), [ids[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
    _, first, label = np.unique(rows[:, lanes + 2 : lanes + 4], axis=0, return_index=True, return_inverse=True)
    above = first[label.reshape(-1)].tolist()

    def top(x: int) -> int:
        while above[x] != x:
            above[x] = x = above[above[x]]
        return x

    here, found = np.zeros(len(known), bool), []
    for left, right in pairs:
        starts = np.flatnonzero(np.diff(left, prepend=-1))  # pairs come in the order of their left side
        for i, others in zip(left[starts].tolist(), np.split(right, starts[1:]), strict=True):
            root = top(i)
            others = [j for j in others.tolist() if top(j) != root]
            if not others:
                continue
            here[own[i]] = True
            common = np.add.reduceat(here[np.concatenate([own[j] for j in others])], np.cumsum([0, *sizes[others[:-1]]]), dtype=np.int64)
            here[own[i]] = False
            for j in np.array(others)[common / (sizes[i] + sizes[others] - common) >= similarity].tolist():
                if (low := top(i)) != (high := top(j)):
                    above[high] = low
                    found.append((i, j))
    return found


def block_side(rows: int, sets: bool) -> int:
    """Rows of a block in a cell of so many. A block is copied to each block that it meets, so where ``sets`` decide, and rows are wide, blocks grow with the cell."""
    return max(SIDE, min(-(-rows // COPIES), SIDE_MOST)) if sets else SIDE


def fingerprint_links(prints: DataFrame, radius: int, lanes: int = 1, similarity: float | None = None) -> DataFrame:
    """Links (a, b) that connect distinct fingerprints (column ``fp``) just as all pairs within ``radius`` bits would.

    With a similarity, ``fp`` is a row of ``_pairs_apart``, the links connect just as its pairs would, and cells are ranges of sizes.

    Fingerprints are dealt to cells by the population counts of their halves, each cell to blocks of about ``block_side``; a
    fingerprint can only be near to those of its own and the touching cells. One task compares two blocks; it returns a
    forest, at most one link for each of its fingerprints, so a dense group gives no square of links. The driver holds the
    number of fingerprints per cell (at most (32 x lanes / (radius + 1) + 1) squared numbers).
    """
    width = radius + 1
    words = lanes if similarity is None else lanes + 5

    @F.pandas_udf("int")
    def cell_of(values: pd.Series) -> pd.Series:
        if similarity is not None:
            sizes = _sizes(np.frombuffer(b"".join(values), np.uint64).reshape(len(values), words))
            return pd.Series((np.log(sizes) / (1.0001 * np.log(1 / similarity))).astype(np.int32) * 1000)
        bits = np.bitwise_count(np.frombuffer(b"".join(values), np.uint8)).reshape(len(values), 2, -1).sum(axis=2)
        return pd.Series((bits[:, 0] // width * 1000 + bits[:, 1] // width).astype(np.int32))

    celled = prints.withColumn("cell", cell_of("fp"))
    blocks = {row["cell"]: -(-row["n"] // block_side(row["n"], similarity is not None)) for row in celled.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not blocks:
        return prints.select(F.col("fp").alias("a"), F.col("fp").alias("b"))
    number = F.create_map(*[F.lit(x) for entry in blocks.items() for x in entry])[F.col("cell")]
    dealt = celled.withColumn("block", F.pmod(F.xxhash64("fp"), number).cast("int"))

    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        own = np.frombuffer(b"".join(rows["fp"]), np.uint64).reshape(len(rows), words)
        own = own[np.lexsort(_part_counts(own).T[::-1]) if similarity is None else np.argsort(_sizes(own))]
        return pd.DataFrame({"cell": [key[0]], "block": [key[1]], "prints": [own.tobytes()]})

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for cell, block, body in batch.itertuples(index=False):
                near = [c for c in blocks if abs(c // 1000 - cell // 1000) <= 1 and abs(c % 1000 - cell % 1000) <= 1]
                for other in near:
                    mine = (cell, block)
                    pairs = [(*min(mine, (other, b)), *max(mine, (other, b))) for b in range(blocks[other])]
                    yield pd.DataFrame(pairs, columns=["c1", "b1", "c2", "b2"]).assign(first=[mine == pair[:2] for pair in pairs], prints=body)

    def compare(key: tuple, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        alone = key[:2] == key[2:]
        rows = pd.concat(list(batches)).sort_values("first", ascending=False)  # two rows, a block each
        sides = [np.frombuffer(body, np.uint64).reshape(-1, words) for body in rows["prints"]]
        if len(sides) < 2 and not alone:
            return
        other = None if alone else sides[1]
        both = sides[0] if alone else np.concatenate(sides)
        if similarity is None:
            i, j = _compare(sides[0], other, radius)
        else:
            i, j = _spanning(len(both), _pairs_apart(sides[0], other, radius, lanes, similarity))
        yield pd.DataFrame({"a": [both[x].tobytes() for x in i], "b": [both[x].tobytes() for x in j]})

    packed = dealt.groupBy("cell", "block").applyInPandas(pack, "cell int, block int, prints binary")
    pairs = packed.mapInPandas(meet, "c1 int, b1 int, c2 int, b2 int, first boolean, prints binary")
    return pairs.groupBy("c1", "b1", "c2", "b2").applyInPandas(compare, "a binary, b binary")


def groups(prints: DataFrame, radius: int, lanes: int = 1) -> DataFrame:
    """(fp, root, component_id) for each distinct fingerprint of ``prints`` (doc_id, fp).

    ``root`` names the component by a fingerprint; ``component_id`` is the smallest doc_id in it.
    """
    lowest = written(prints.groupBy("fp").agg(F.min("doc_id").alias("low")))
    member = components(fingerprint_links(lowest, radius, lanes)).withColumnRenamed("node", "fp")
    rooted = lowest.join(member, "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    # Written first, so that Spark can split the other side where one component has very many fingerprints.
    ids = written(rooted.groupBy("root").agg(F.min("low").alias("component_id")))
    return rooted.join(ids, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 3, lanes: int = 1) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs`` (doc_id, text).

    Texts link when their fingerprints differ in at most ``radius`` of 64 x ``lanes`` bits; component_id is the smallest doc_id
    reachable. A null or empty text has the fingerprint zero and links like any other; a text with fewer words than
    a shingle is one shingle; repeated rows stay, each with the same result; a null doc_id gets a row, and is a component's
    id only where no other doc_id is in it; no rows give no rows; other columns are not read.
    """
    prints = written(with_fingerprint(docs.select("doc_id", "text"), "text", "fp", shingle, lanes).select("doc_id", "fp"))
    return prints.join(groups(prints, radius, lanes), "fp").select(
        "doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id"
    )


def _with_texts(wanted: DataFrame, nodes: DataFrame, hashed: DataFrame) -> DataFrame:
    """The rows of ``wanted`` (node and more) with their node's text. Of the other texts, few are shuffled; a wanted one is shuffled once."""
    from claimscope.operators.scale import maybe_listed  # not for the workers, which import this module

    listed = written(wanted.join(nodes.select("node", F.col("first").alias("_place")), "node"))
    rows = hashed.select(F.col("place").alias("_place"), "text")
    # Dealt by the join's one key, so that neither the repeated rows nor the join need another shuffle.
    texts = maybe_listed(rows, written(listed.select("_place").distinct()), "_place").repartition("_place").dropDuplicates(["_place"])
    return texts.join(listed, "_place").select(*wanted.columns, F.coalesce("text", F.lit("")).alias("text"))


def verified(pairs: DataFrame, nodes: DataFrame, hashed: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The ``pairs`` (a, b) of names whose sets of shingles have a Jaccard similarity of at least ``similarity``.

    ``a_size`` and ``b_size`` are the sizes of the sets. A task gets the text of an ``a`` once, and those of its ``b``; small groups share tasks, of
    larger ones a task gets about ``CLUMP_NODES`` texts or ``CLUMP_GRAMS`` shingles. The driver holds one number.
    """
    pairs = written(pairs.distinct())
    grams = F.sum("b_size") + F.max("a_size")
    totals = written(pairs.groupBy("a").agg(grams.alias("grams"), F.ceil(F.greatest(F.count(F.lit(1)) / CLUMP_NODES, grams / CLUMP_GRAMS)).cast("int").alias("parts")))
    home, part = _homes(totals, "a"), F.pmod(F.xxhash64("b"), F.col("parts")).cast("int")
    split = F.col("parts") > 1
    place = lambda part: [F.when(split, F.col("a")).otherwise(F.lit(b"")).alias("home"), F.when(split, part).otherwise(home).alias("part")]
    stars = totals.withColumn("at", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(F.col("a").alias("node"), "a", *place(F.col("at")))
    others = pairs.join(totals, "a").select(F.col("b").alias("node"), "a", *place(part))

    def verify(rows: pd.DataFrame) -> pd.DataFrame:
        links = []
        for a, star in rows.groupby("a"):
            sets = {node: shingles(text, shingle) for node, text in zip(star["node"], star["text"], strict=True)}
            own = sets.pop(a)
            for b, other in sets.items():
                common = len(np.intersect1d(own, other, assume_unique=True))
                if common / (len(own) + len(other) - common) >= similarity:
                    links.append((a, b))
        return pd.DataFrame(links, columns=["a", "b"])

    asked = _with_texts(stars.union(others), nodes, hashed)
    return written(asked.groupBy("home", "part").applyInPandas(verify, "a binary, b binary"))


def _homes(totals: DataFrame, name: str) -> Column:
    """The task of a group in one part, by its name: so many that each gets about a quarter of ``CLUMP_GRAMS``."""
    shared = totals.where("parts = 1").agg(F.sum("grams")).first()[0] or 0
    return F.pmod(F.xxhash64(name), F.lit(4 * shared // CLUMP_GRAMS + 1)).cast("int")


def verified_clumps(
    clumps: DataFrame, prints: DataFrame, nodes: DataFrame, hashed: DataFrame, shingle: int, similarity: float, lanes: int
) -> DataFrame:
    """Links (a, b) that connect just as all pairs of ``_pairs_apart`` whose sets have a Jaccard similarity of ``similarity`` would.

    ``clumps`` are the components (node, root) of those pairs, whatever their similarity, so no pair leaves a clump and pairs needn't be
    listed: a task gets each text of a clump once, looks for the pairs again and returns a forest. Small clumps share tasks;
    larger ones are cut into parts of about ``CLUMP_NODES`` texts or ``CLUMP_GRAMS`` shingles, and a task verifies two parts.
    ``prints`` are rows of ``_pairs_apart`` (node, size, fp). The driver holds one number.
    """
    radius = wide_radius(similarity, lanes)
    met = written(clumps.join(prints, "node"))
    totals = written(met.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("grams")).select(
        "root", "grams", F.ceil(F.greatest(F.col("n") / CLUMP_NODES, F.col("grams") / CLUMP_GRAMS)).cast("int").alias("parts")
    ))
    home = _homes(totals, "root")
    part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    split = F.col("parts") > 1
    place = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda x: F.struct(
        F.col("root").alias("home"), F.least(F.col("part"), x).alias("low"), F.greatest(F.col("part"), x).alias("high")
    ))
    alone = F.array(F.struct(F.lit(b"").alias("home"), home.alias("low"), home.alias("high")))
    dealt = met.join(totals.select("root", "parts"), "root").withColumn("part", F.when(split, part).otherwise(home))
    asked = _with_texts(dealt.select("node", "root", "part", "fp", F.inline(F.when(split, place).otherwise(alone))), nodes, hashed)

    def verify(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        links = []
        for _, clump in rows.groupby("root"):
            own = np.frombuffer(b"".join(clump["fp"]), np.uint64).reshape(len(clump), lanes + 5)
            order = np.lexsort((_sizes(own), clump["part"]))
            own, parts = own[order], clump["part"].to_numpy()[order]
            cut = len(own) if key[1] == key[2] else int((parts == key[1]).sum())
            if cut in (0, len(own)) and key[1] != key[2]:
                continue
            sets = [shingles(text, shingle) for text in clump["text"].to_numpy()[order]]
            pairs = _pairs_apart(own[:cut], own[cut:] if cut < len(own) else None, radius, lanes, similarity)
            links += [(own[i].tobytes(), own[j].tobytes()) for i, j in _similar(own, sets, pairs, lanes, similarity)]
        return pd.DataFrame(links, columns=["a", "b"])

    return asked.groupBy("home", "low", "high").applyInPandas(verify, "a binary, b binary")


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, lanes: int = 4) -> DataFrame:
    """``docs`` with one row left of each group of near-duplicates: that with the smallest doc_id.

    Two texts are near-duplicates when the Jaccard similarity of their sets of word shingles is at least ``similarity``; groups are the
    components of those links. Texts of the same set are one node. Nodes that share a smallest hash are verified against the
    first of them, so that large groups of near copies are linked without their square of pairs. Then all pairs of nodes of
    different components whose 64 x ``lanes`` fingerprint bits lie within ``wide_radius`` are verified, clump by clump. A null doc_id counts as
    larger than any other. Of repeated rows with the smallest doc_id, the one whose text has the smallest hash stays. Columns
    are those of ``docs``.
    """
    from claimscope.operators.scale import split_listed  # not for the workers, which import this module

    @F.pandas_udf("node binary, fp binary, size bigint, minima array<bigint>")
    def sketch_of(values: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_sketch(value, shingle, lanes) for value in values], columns=["node", "fp", "size", "minima"])

    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", F.xxhash64("text").alias("hash"))
    hashed = docs.select(place.alias("place"), "text")
    prints = written(hashed.select("place", sketch_of(F.coalesce("text", F.lit(""))).alias("sketch")).select("place", "sketch.*"))
    nodes = written(prints.groupBy("node").agg(
        F.any_value("fp").alias("fp"), F.any_value("size").alias("size"), F.any_value("minima").alias("minima"), F.min("place").alias("first")
    ))
    met = written(nodes.select("node", "size", F.posexplode("minima").alias("k", "low")))
    stars = met.groupBy("k", "low").agg(F.min(F.struct("node", "size")).alias("star"), F.count(F.lit(1)).alias("n")).where("n > 1")
    near = met.join(written(stars), ["k", "low"]).where(F.col("node") != F.col("star.node")).where(
        F.least("size", "star.size") >= similarity * F.greatest("size", "star.size") - 1e-6
    )
    near = near.select(F.col("star.node").alias("a"), F.col("node").alias("b"), F.col("star.size").alias("a_size"), F.col("size").alias("b_size"))
    links = verified(near, nodes, hashed, shingle, similarity)
    labelled = written(nodes.where("size > 0").join(components(links), "node", "left").select("node", "size",
        F.concat("fp", "node", F.coalesce("root", "node"), F.unhex(F.lpad(F.hex(F.col("size")), 16, "0"))).alias("fp")
    ))
    name = [F.substring(side, 8 * lanes + 1, 16).alias(side) for side in ("a", "b")]
    clumps = components(fingerprint_links(labelled.select("fp"), wide_radius(similarity, lanes), lanes, similarity).select(*name))
    found = verified_clumps(clumps, labelled, nodes, hashed, shingle, similarity, lanes)
    links = written(links.union(found.select(*name)))
    member = written(nodes.select("node").join(components(links), "node", "left").select("node", F.coalesce("root", "node").alias("root")))
    # Written first, so that Spark can split the other side where one component has very many nodes.
    rooted = written(prints.join(member, "node").select("root", "place"))
    first = written(rooted.groupBy("root").agg(F.min("place").alias("first")))
    judged = written(rooted.join(first, "root").select("root", "place", (F.col("place") == F.col("first")).alias("own")))
    kept = written(judged.where("own").groupBy("root").agg(
        F.count(F.lit(1)).alias("n"), F.any_value("place").alias("first")  # n is over 1 where that row is repeated
    ))
    # Most rows are the only ones of their groups. Just those that may not be are joined, so few texts are shuffled.
    listed = written(judged.where("not own").select("place").union(kept.where("n > 1").select("first")).distinct())
    likely, alone = split_listed(docs.select(F.struct("*").alias("_row"), place.alias("place")), listed, "place")
    left = likely.join(kept.withColumnRenamed("first", "place"), "place")
    result = alone.select("_row").union(left.where("n = 1").select("_row"))
    if not kept.where("n > 1").isEmpty():
        tied = left.where("n > 1").groupBy("root").agg(F.min_by("_row", F.to_json("_row")).alias("_row"))
        result = result.union(tied.select("_row"))
    return result.select("_row.*")


def wide_radius(similarity: float, lanes: int) -> int:
    """Bits in which fingerprints of sets of at least that similarity differ at most, five standard deviations above the mean.

    Sets of equal size with Jaccard similarity s share 2s / (1 + s) of their shingles, the cosine of the angle; sets of four and
    five shingles differ most, in 3 of 16 bits at 0.8, which is why a quarter is added to the share of differing bits.
    """
    share = min(0.5, 1.25 * np.arccos(2 * similarity / (1 + similarity)) / np.pi)
    return int(64 * lanes * share + 5 * np.sqrt(64 * lanes * share * (1 - share)))
