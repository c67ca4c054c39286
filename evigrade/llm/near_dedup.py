"""Near-duplicates by similarity: links of the SimHash operator, verified on word shingles, and what SimHash can't reach.

The contract of two differing bits is for copies that hardly differ. A pipeline wants texts of a stated similarity, the
Jaccard index of their sets of five-word shingles, and texts at 0.8 differ in about a seventh of a fingerprint's bits: no
positional byte is sure to be equal, so a byte index alone loses links whatever its width. The operator's own links are
therefore taken first, verified on their shingles, and every link that is left is found by an index of shingles, with the
same count filtering:

1. A sketch holds the ``SKETCH`` smallest shingle hashes of a text. Texts that are similar enough share ``least_shared`` of
   them but for a chance of ``MISS``. Texts that share fewer with all others together have no partner, and are done.
2. The candidates' shingles are counted exactly and put into one order, rare ones first. Of m shingles a text stands at the
   first m - ceil(similarity * m) + 1; two texts that share none of those cannot be similar enough. Shingles that nobody
   else has need no posting, and a text with too many of them has no partner either.
3. Members of a posting are compared with its most central member first, that with the fewest rarer shingles. Those that
   are then outside its component meet the most central ones of ``FEW`` random parts of the posting, and what is outside
   even then is compared with all members of other components, as far as the bound holds: neither text has what stands
   before the posting's shingle in the other's order, so those shingles are lost to what they share.
   Each set also has a parity fingerprint, in which a shingle turns one bit over: two sets that may differ in d shingles
   differ in d bits at most, and pairs that differ in more go uncompared.
   Leaders go on in rounds until every such member has led: of two members in different components one at least has led,
   so no link between components is lost, and those within one would add nothing.

Nothing here is a group in one task: postings are rows, leaders are minima. Words and shingles are told apart by 64-bit
hashes, as are texts: by chance two of n texts are taken for one n * n / 2**65 times.

Defined results: texts with equal sequences of lower-cased words are one node, so copies cost nothing; null and wordless
texts are one node together; a null id is a row like any other; repeated rows fold into one where one of each group stays;
an empty table gives no rows; extra columns stay and may have any name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigrade.operators.components import connected_components
from evigrade.sources.staging import cut

from .common import bounded_batches, without
from .simhash_dedup import BLOCK, HASH_SEED, MAX_POSTING, bit_counts, links

SHINGLE, SIMILARITY = 5, 0.8
#: Smallest shingle hashes in a sketch, and the chance of a link to share fewer than ``least_shared`` of them.
SKETCH, MISS = 32, 1e-11
#: Words of a set's parity fingerprint, and their columns.
PARITY = 4
PARITIES = tuple(f"p{i}" for i in range(PARITY))
#: Members of a posting that the others meet before all of them lead.
FEW = 4
#: Leaders of a posting in the first round in which all members lead; each further round has WIDER times as many.
LEADERS, WIDER = 64, 16
#: Candidate texts up to this number are found by a broadcast of their hashes, more of them by a shuffle join.
BROADCAST_ROWS = 500_000


def least_shared(similarity: float, sketch: int = SKETCH, miss: float = MISS) -> int:
    """How many of ``sketch`` shingles, drawn from those of both texts, are shared but for a chance of ``miss``."""
    chance, k = 0.0, 0
    while k <= sketch and (chance := chance + math.comb(sketch, k) * similarity**k * (1 - similarity) ** (sketch - k)) <= miss:
        k += 1
    return max(1, k)


def _node(words: list[bytes]) -> int:
    """Signed 64-bit hash of a sequence of words."""
    import xxhash

    h = xxhash.xxh3_64_intdigest(b" ".join(words))
    return h - (1 << 64) if h >> 63 else h


def shingle_hashes(words: list[bytes], k: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of k words; fewer than k words are one shingle."""
    import xxhash

    digest, n = xxhash.xxh64_intdigest, max(1, len(words) - k + 1)
    each = np.fromiter((digest(w, HASH_SEED) for w in words), np.uint64, len(words))
    h = np.full(n, 0x9E3779B97F4A7C15, np.uint64)
    for j in range(min(k, len(words))):
        h = (h ^ each[j : j + n]) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    return np.unique(h)


def fingerprint_of(hashes: np.ndarray) -> int:
    """Signed 64-bit SimHash of a set of shingles."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), BLOCK):
        ones += bit_counts(hashes[at : at + BLOCK].astype(">u8").view(np.uint8).reshape(-1, 8))
    return int(np.packbits(2 * ones > len(hashes)).view(">i8")[0])


def parity_of(hashes: np.ndarray) -> np.ndarray:
    """PARITY words of 64 bits: a shingle turns one bit over, so two sets differ in as many shingles at least as these words in bits."""
    odd = np.bincount((hashes >> np.uint64(7)).astype(np.uint64).astype(np.int64) % (64 * PARITY), minlength=64 * PARITY) & 1
    return np.packbits(odd.astype(np.uint8)).view(">i8").astype(np.int64)


def _lists(each: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, each)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(each) if each else np.zeros(0), pa.int64()))


def _sketched(k: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes, sizes, heads = [], [], []
            for t in b.column(2):
                words = t.as_py().lower().split()
                h = shingle_hashes(words, k)
                nodes.append(_node(words))
                sizes.append(len(h))
                heads.append(h[:size].view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int32()), _lists(heads)], ["doc_id", "mark", "node", "m", "sketch"])

    return run


def _shingled(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes, prints, sets, odd = [], [], [], []
            for t in b.column(0):
                words = t.as_py().lower().split()
                h = shingle_hashes(words, k)
                nodes.append(_node(words))
                prints.append(fingerprint_of(h))
                sets.append(h.view(np.int64))
                odd.append(parity_of(h))
            words_of_parity = np.array(odd, np.int64).reshape(-1, PARITY).T
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(prints, pa.int64()), _lists(sets), *map(pa.array, words_of_parity)], ["node", "fp", "shingles", *PARITIES])

    return run


def mark_of(text_col: str) -> Column:
    """Hash of an original text; with the id it names a row, and costs a scan of the text only."""
    return F.xxhash64(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))


def sketches(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """doc_id, mark, node, m (distinct shingles) and sketch of every row."""
    kind = dict(docs.dtypes)[id_col]
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary")
    rows = bounded_batches(docs).select(F.col(f"`{id_col}`").alias("doc_id"), mark_of(text_col).alias("mark"), text.alias("text"))
    return cut(rows.mapInArrow(_sketched(words, SKETCH), f"doc_id {kind}, mark long, node long, m int, sketch array<long>"), "near-rows")


def candidate_nodes(rows: DataFrame, similarity: float) -> DataFrame:
    """node and mark (of one of its texts) of the nodes that share enough of their sketch with others to have a partner."""
    nodes = cut(rows.groupBy("node").agg(F.first("m").alias("m"), F.min("mark").alias("mark"), F.first("sketch").alias("sketch")), "near-nodes")
    heads = nodes.select("node", F.explode("sketch").alias("shingle"))
    shared = cut(heads.groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1").select("shingle"), "near-shared")
    met = heads.join(shared, "shingle", "left_semi").groupBy("node").agg(F.count("*").alias("shared"))
    enough = F.least(F.lit(least_shared(similarity)), F.ceil(F.col("m") * similarity - 1e-9))
    return cut(met.join(nodes.select("node", "m", "mark"), "node").where(F.col("shared") >= enough).select("node", "mark"), "near-candidates")


def candidate_sets(docs: DataFrame, text_col: str, rows: DataFrame, candidates: DataFrame, words: int) -> DataFrame:
    """node, fp and shingles of the candidates; only their texts are read by Python, and one of each node."""
    n = candidates.count()
    marks = F.broadcast(candidates.select("mark")) if n <= BROADCAST_ROWS else candidates.select("mark")
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary")
    texts = bounded_batches(docs).select(mark_of(text_col).alias("mark"), text.alias("text")).join(marks, "mark", "left_semi").select("text")
    sets = texts.mapInArrow(_shingled(words), "node long, fp long, shingles array<long>, " + ", ".join(f"{p} long" for p in PARITIES))
    repeat = rows.select("mark").join(marks, "mark", "left_semi").count() > n  # texts that occur twice; else nothing has to be shuffled
    return cut(sets.dropDuplicates(["node"]) if repeat else sets, "near-sets")


def rare_first(sets: DataFrame, similarity: float) -> DataFrame:
    """node, m, u, shared and n_heads: u shingles are the node's own; shared are the others, rare ones first, of which n_heads have postings.

    A shared shingle is one number from here on: how rare it is, as the logarithm of its count, and a row number.
    """
    each = sets.select("node", F.explode("shingles").alias("shingle"))
    counts = each.groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1")
    rank = F.shiftleft(F.floor(F.log2("n")).cast("long"), 57) + F.monotonically_increasing_id()
    ranks = cut(counts.select("shingle", rank.alias("rank")), "near-ranks")
    by = each.join(ranks, "shingle").groupBy("node").agg(F.array_sort(F.collect_list("rank")).alias("shared"))
    known = by.join(sets.select("node", F.size("shingles").alias("m"), *PARITIES), "node")
    m, u = F.col("m"), F.col("m") - F.size("shared")
    prefix = m - F.ceil(m * similarity - 1e-9) + 1
    return cut(known.select("node", "m", u.alias("u"), "shared", (prefix - u).cast("int").alias("n_heads"), *PARITIES).where("n_heads > 0"), "near-known")


def bits_allow(m: Column, other_m: Column, own: list[Column], other: list[Column], similarity: float) -> Column:
    """Whether the parity fingerprints differ in no more bits than the sets may differ in shingles; no similar pair is lost."""
    differing = sum((F.bit_count(a.bitwiseXOR(b)) for a, b in zip(own, other, strict=True)), F.lit(0))
    return differing * (1 + similarity) <= (m + other_m) * (1 - similarity) + 1e-6


def can_reach(a: dict[str, Column], b: dict[str, Column], similarity: float) -> Column:
    """Whether two texts with m shingles, of which at stand before the one that they meet in, can be similar enough."""
    most = F.least(a["m"] - a["at"], b["m"] - b["at"])
    return most * (1 + similarity) >= (a["m"] + b["m"]) * similarity - 1e-6


def verified(pairs: DataFrame, known: DataFrame, similarity: float) -> DataFrame:
    """Of the pairs (a, b) those whose shingles are similar enough. What is shared by both is in what each shares with any."""
    side = lambda x: known.select(F.col("node").alias(x), F.col("m").alias(f"m{x}"), F.col("shared").alias(f"s{x}"))
    full = pairs.join(side("a"), "a").join(side("b"), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    return cut(full.where(common >= (F.col("ma") + F.col("mb") - common) * similarity - 1e-9).select("a", "b"), "near-links")


def _pair(x: str, y: str) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def simhash_pairs(sets: DataFrame, known: DataFrame, max_posting: int) -> DataFrame:
    """Pairs of nodes that the SimHash operator's index links: each fingerprint stands for its most central node, and its other nodes meet that one."""
    fps = cut(sets.select("node", "fp").join(known.select("node", "u"), "node"), "near-fp")
    central = cut(fps.groupBy("fp").agg(F.min(F.struct("u", "node")).alias("c")).select("fp", F.col("c.node").alias("lead")), "near-central")
    same = fps.join(central, "fp").where("node <> lead").select(*_pair("node", "lead"))
    ends = links(central.select("fp"), max_posting).join(central.select(F.col("fp").alias("a"), F.col("lead").alias("x")), "a").join(central.select(F.col("fp").alias("b"), F.col("lead").alias("y")), "b")
    return same.unionByName(ends.select(*_pair("x", "y")))


def star_pairs(known: DataFrame, similarity: float) -> DataFrame:
    """Pairs of a node and the most central member of the postings of its rarest and of its commonest head."""
    ends = F.array_distinct(F.array(F.lit(1), F.col("n_heads")))
    at = known.select("node", "m", "u", "shared", F.explode(ends).alias("k"))
    posted = cut(at.select("node", "m", (F.col("u") + F.col("k") - 1).alias("at"), F.element_at("shared", F.col("k")).alias("shingle")), "near-ends")
    lead = posted.groupBy("shingle").agg(F.min(F.struct("at", "m", "node")).alias("l"), F.count("*").alias("n")).where("n > 1").select("shingle", "l.*")
    lead = cut(lead.select("shingle", F.col("node").alias("lead"), F.col("m").alias("lm"), F.col("at").alias("lat")), "near-leads")
    own, its = {"m": F.col("m"), "at": F.col("at")}, {"m": F.col("lm"), "at": F.col("lat")}
    return posted.join(lead, "shingle").where(F.col("node") != F.col("lead")).where(can_reach(own, its, similarity)).select(*_pair("node", "lead"))


def components_of(found: DataFrame) -> DataFrame:
    return cut(connected_components(found).select("node", F.col("root").alias("component")), "near-roots")


def mixed(posted: DataFrame, roots: DataFrame) -> DataFrame:
    """The members of postings that hold several components, with their component and bulk, that of the most central member."""
    placed = posted.join(roots, "node", "left").withColumn("component", F.coalesce("component", "node"))
    placed = cut(placed.select("shingle", "node", "m", "at", "component", *PARITIES), "near-placed")
    central = F.min(F.struct("at", "m", "node", "component")).alias("c")
    bulk = placed.groupBy("shingle").agg(central, F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
    return cut(placed.join(cut(bulk.select("shingle", F.col("c.component").alias("bulk")), "near-mixed"), "shingle"), "near-posted")


def met(members: DataFrame, leads: DataFrame, similarity: float) -> DataFrame:
    """Pairs of members and leads of a posting, in different components, that the bounds allow to be similar enough."""
    lead = leads.select("shingle", F.col("node").alias("lead"), F.col("m").alias("lm"), F.col("at").alias("lat"), F.col("component").alias("of_lead"), *[F.col(p).alias(f"l{p}") for p in PARITIES])
    own, its = {"m": F.col("m"), "at": F.col("at")}, {"m": F.col("lm"), "at": F.col("lat")}
    alike = bits_allow(F.col("m"), F.col("lm"), [F.col(p) for p in PARITIES], [F.col(f"l{p}") for p in PARITIES], similarity)
    pairs = members.join(lead, "shingle").where("component <> of_lead").where(can_reach(own, its, similarity)).where(alike)
    return cut(pairs.select(*_pair("node", "lead")).distinct(), "near-pairs")


def joined(roots: DataFrame, found: DataFrame) -> DataFrame:
    """roots after the links in found."""
    return roots if found.isEmpty() else components_of(roots.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(found))


def gathered(posted: DataFrame, roots: DataFrame, known: DataFrame, similarity: float, few: int = FEW) -> DataFrame:
    """roots, after the members of a posting outside its central member's component have met a few others there.

    Of each of ``few`` random parts of a posting the most central member leads, so there are at most ``few`` times as many
    pairs as rows. It loses nothing, since ``settled`` goes on with what is still in different components, and most of a
    large group's members are in one component from here on.
    """
    posted = mixed(posted, roots)
    first = F.min(F.struct("at", "m", "node", "component", *PARITIES)).alias("f")
    leads = posted.groupBy("shingle", F.pmod(F.xxhash64("node"), F.lit(few)).alias("part")).agg(first).select("shingle", "f.*")
    return joined(roots, verified(met(posted.where("component <> bulk"), cut(leads, "near-few"), similarity), known, similarity))


def settled(known: DataFrame, roots: DataFrame, similarity: float) -> DataFrame:
    """roots, after every member of a posting outside its central member's component has led there, as far as the bound holds.

    Components only grow, so a posting of which all such members have led is done; each round is on the others.
    """
    heads = known.select("node", "m", "u", *PARITIES, F.posexplode(F.slice("shared", F.lit(1), F.col("n_heads"))).alias("pos", "shingle"))
    posted, led, most = heads.select("shingle", "node", "m", (F.col("u") + F.col("pos")).alias("at"), *PARITIES), None, LEADERS
    roots = gathered(posted, roots, known, similarity)
    while True:
        posted = mixed(posted, roots)
        rest = posted.where("component <> bulk").drop("bulk")
        if led is not None:
            rest = rest.join(led, ["shingle", "node"], "left_anti")
        # Of a posting's many members few are of different size and place: the bound holds or fails for all of a cell.
        cells = posted.groupBy("shingle", F.col("m").alias("cm"), F.col("at").alias("cat")).agg(F.min("component").alias("low"), F.max("component").alias("high"))
        own, its = {"m": F.col("m"), "at": F.col("at")}, {"m": F.col("cm"), "at": F.col("cat")}
        other = (F.col("low") != F.col("component")) | (F.col("high") != F.col("component"))
        near = rest.join(cut(cells, "near-cells"), "shingle").where(other & can_reach(own, its, similarity))
        rest = cut(near.groupBy("shingle", "node").agg(*[F.first(c).alias(c) for c in ("m", "at", "component", *PARITIES)]), "near-rest")
        # All members lead where they are few; of more the share that makes up ``most``, by a hash of the node alone.
        left = rest.groupBy("shingle").agg(F.count("*").alias("left"))
        lot = F.pmod(F.xxhash64("node"), F.lit(1 << 20))
        leads = rest.join(left, "shingle").withColumn("leads", lot * F.col("left") < F.lit(most << 20)).drop("left")
        leads = cut(leads, "near-leading")
        roots = joined(roots, verified(met(posted, leads.where("leads"), similarity), known, similarity))
        undone = cut(leads.where("NOT leads").select("shingle").distinct(), "near-undone")
        if undone.isEmpty():
            return roots
        gone = leads.where("leads").select("shingle", "node")
        led = gone if led is None else led.unionByName(gone)
        posted = posted.select("shingle", "node", "m", "at", *PARITIES).join(undone, "shingle", "left_semi")
        most *= WIDER


def node_components(rows: DataFrame, docs: DataFrame, text_col: str, similarity: float, words: int, max_posting: int) -> DataFrame:
    """node and component of the nodes that have a link."""
    sets = candidate_sets(docs, text_col, rows, candidate_nodes(rows, similarity), words)
    known = rare_first(sets, similarity)
    pairs = simhash_pairs(sets, known, max_posting).unionByName(star_pairs(known, similarity))
    found = verified(cut(pairs.distinct(), "near-pairs"), known, similarity)
    return settled(known, components_of(found), similarity)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, words: int = SHINGLE, max_posting: int = MAX_POSTING) -> DataFrame:
    """One row per row of docs: doc_id and component, the same for texts that links of at least ``similarity`` connect."""
    rows = sketches(docs, id_col, text_col, words)
    roots = node_components(rows, docs, text_col, similarity, words, max_posting)
    return rows.select("doc_id", "node").join(roots, "node", "left").select("doc_id", F.coalesce("component", "node").alias("component"))


def keep_one_of_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, words: int = SHINGLE, max_posting: int = MAX_POSTING) -> DataFrame:
    """docs with one row of each component, that with the smallest id (null ids last); all columns stay.

    Of rows of one id in a component that with the smallest hash of its text stays; rows equal in both fold into one.
    """
    rows = sketches(docs, id_col, text_col, words)
    roots = node_components(rows, docs, text_col, similarity, words, max_posting)
    member = cut(rows.join(roots, "node", "left").select("doc_id", "mark", F.coalesce("component", "node").alias("component")), "near-members")
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("mark").alias("mark"))
    firsts = member.groupBy("component").agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1")
    firsts = cut(firsts.select("component", "first"), "near-firsts")
    grouped = member.join(firsts, "component")
    stays = F.col("doc_id").eqNullSafe(F.col("first.id")) & (F.col("mark") == F.col("first.mark"))
    dropped = cut(grouped.where(~stays).select("doc_id", "mark").distinct(), "near-dropped")
    repeated = cut(grouped.where(stays).groupBy("doc_id", "mark").agg(F.count("*").alias("n")).where("n > 1").select("doc_id", "mark"), "near-repeated")
    return without(docs, id_col, mark_of(text_col), dropped, repeated)
