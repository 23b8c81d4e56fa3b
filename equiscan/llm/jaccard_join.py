"""Exact n-gram Jaccard join by parity sketches.

The distinct word shingles of a document are hashed into the words of a sketch: each shingle XORs its hash into one word.
Two sketches differ in no more words than their sets differ in shingles, so the count of differing words is a lower bound of
the symmetric difference. Sets whose sizes fall into one band share a sketch of ``d + 1`` words and a few more, where ``d``
is the largest symmetric difference a linked pair of that band can have: by the pigeonhole principle a linked pair agrees in
more words than there are empty ones, and an equal word is the join key. A second sketch with one parity bit a shingle
rejects pairs whose Hamming distance exceeds the allowed difference before the sets themselves are compared; sets of more
shingles than it has bits are told apart by one as wide as they are large.

Equal sets are one node throughout. Nodes that share a word are first compared with the smallest node of that word only;
what is linked then is one component. Where large groups stay apart, nodes are compared with others that take the same key.
All pairs are compared only between nodes of different components, by Hamming distance within the join.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from equiscan.llm.components import connected_components, in_few_tasks
from equiscan.llm.textbytes import LOWER, NOT_BLANK, Texts, U, mix, slices
from equiscan.session import broadcast_up_to, release_shuffles, staged

#: Largest set over smallest set of a band.
BAND = 1.5
#: Tries with other hashes for a set that leaves too many words of its sketch empty; after them its shingles are keys.
TRIES = 3
PARITY_BITS = 512
#: Keys that a node takes in the first round (half as many in each that follows); pairs for every row up to which all are
#: compared, by a few machine instructions each; the share of pairs a round must leave at most for another one to follow.
PICKS, PAIRS_A_ROW, ROUND_LEAVES = 16, 64, 0.95
#: Node fingerprints a task remembers, so that copies within a task emit once.
SEEN = 200_000
#: Smallest keys of a node by which a pair that shares several of them is known to have been met at an earlier one.
FIRST_KEYS = 8
#: Ids that are still broadcast to pick texts, 8 bytes each.
BROADCAST_IDS = 2_000_000


def shingle_sets(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(bounds, hashes): the distinct shingle hashes of each text, sorted within the text.

    A text with fewer than ``k`` words, but some, has one shingle: all of them.
    """
    texts = Texts(column, NOT_BLANK, lower=True)
    at, h = texts.windows(k)
    of = texts.text_of_word()[at] if len(at) else np.zeros(0, np.int64)
    short = np.flatnonzero((texts.n_words > 0) & (texts.n_words < k))
    if len(short):
        words, first = texts.word_hashes, texts.first_word[short]
        whole = np.zeros(len(short), np.uint64)
        for j in range(k - 1):
            has = texts.n_words[short] > j
            whole[has] = mix(whole[has] * U(0x9E3779B97F4A7C15) + words[first[has] + j] + U(j + 1))
        of, h = np.concatenate([of, short]), np.concatenate([h, whole])
        order = np.argsort(of, kind="stable")
        of, h = of[order], h[order]
    bounds = np.searchsorted(of, np.arange(len(texts) + 1))
    h = h.copy()
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        h[a:b].sort()
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
    kept = np.concatenate([[0], np.cumsum(keep)])
    return kept[bounds], h[keep]


def fingerprints(bounds: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit fingerprints of each set; 0 for an empty one."""

    def summed(x: np.ndarray) -> np.ndarray:
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)])
        return sums[bounds[1:]] - sums[bounds[:-1]]

    n = np.diff(bounds).astype(np.uint64)
    one, two = (np.where(n > 0, mix(summed(mix(h ^ U(c))) + n), 0).astype(np.uint64) for c in (0x5851F42D4C957F2D, 0x14057B7EF767814F))
    return one.view(np.int64), two.view(np.int64)


def node_ids(one: np.ndarray, two: np.ndarray, clashing: frozenset[int]) -> np.ndarray:
    """The id of each set: its first fingerprint, or a mix of both where different sets are known to share that."""
    if not clashing:
        return one
    mixed = mix(one.view(np.uint64) ^ mix(two.view(np.uint64))).view(np.int64)
    return np.where(np.isin(one, np.fromiter(clashing, np.int64)), mixed, one)


@cache
def bands(percent: int) -> tuple[list[int], list[int], list[int]]:
    """Smallest size, largest size, and largest symmetric difference to a set at least as large, of each band."""
    low, high, differ = [], [], []
    at = 1
    while at < 2**40:
        low.append(at)
        high.append(max(at, int(at * BAND)))
        differ.append(high[-1] * (100 - percent) // percent)
        at = high[-1] + 1
    return low, high, differ


def signatures(h: np.ndarray, percent: int) -> np.ndarray:
    """Join keys of one set (sorted distinct hashes): the words of its sketch, of its own band and of those below in which
    a smaller partner can fall. Bands where only equal sets link need none."""
    low, high, differ = bands(percent)
    n = len(h)
    out = []
    band = bisect_right(low, n) - 1
    while band >= 0 and differ[band] and n * percent <= 100 * high[band]:
        d = differ[band]
        words = d + 1 + d // 16 + 1
        for attempt in range(TRIES + 1):
            salt = mix(np.array([band * 8 + attempt], np.uint64))
            if attempt == TRIES:
                out.append(mix(h ^ salt))
                break
            x = h if not attempt else np.sort(mix(h ^ salt))
            word = ((x >> U(32)) * U(words)) >> U(32)
            starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            out.append(mix(np.bitwise_xor.reduceat(x, starts) ^ mix(word[starts] ^ salt)))
            # A linked pair agrees in words - d words at least. Only if so many are empty can all of them be, in both.
            if len(starts) > d:
                break
        band -= 1
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _described(k: int):
    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            bounds, h = shingle_sets(batch.column(1), k)
            node, check = fingerprints(bounds, h)
            bit = (h % U(PARITY_BITS)).astype(np.int64) + np.repeat(np.arange(len(bounds) - 1), np.diff(bounds)) * PARITY_BITS
            parity = np.packbits(np.bincount(bit, minlength=(len(bounds) - 1) * PARITY_BITS).astype(np.uint8) & 1).view(np.int64)
            longs = PARITY_BITS // 64
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(np.diff(bounds), pa.int64()),
                    pa.array(node, mask=np.diff(bounds) == 0),
                    pa.array(check),
                    pa.array(mix(node.view(np.uint64) ^ mix(check.view(np.uint64))).view(np.int64)),
                    pa.ListArray.from_arrays(np.arange(0, len(parity) + 1, longs, dtype=np.int32), pa.array(parity)),
                ],
                names=["doc", "n", "node", "fingerprint", "other", "parity"],
            )

    return describe


def _signed(k: int, percent: int, clashing: frozenset[int]):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in slices(batches, 0):
            bounds, h = shingle_sets(batch.column(0), k)
            nodes = node_ids(*fingerprints(bounds, h), clashing)
            keys, of = [], []
            for node, a, b in zip(nodes.tolist(), bounds[:-1], bounds[1:], strict=True):
                if a < b and node not in seen:
                    if len(seen) < SEEN:
                        seen.add(node)
                    keys.append(signatures(h[a:b], percent))
                    of.append(np.full(len(keys[-1]), node, np.int64))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(of))], names=["sig", "node"])

    return sign


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(sig, node, leader) of keys with several nodes, from rows sorted by key and node; holds one batch at a time."""
    last: tuple[int, int, int, bool] | None = None  # key, leader, last node, whether the leader's own row is out
    for batch in batches:
        sig, node = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not len(sig):
            continue
        if last is not None:
            sig, node = np.concatenate([[last[0]], sig]), np.concatenate([[last[2]], node])
        new = np.concatenate([[True], sig[1:] != sig[:-1]])
        fresh = np.concatenate([[True], new[1:] | (node[1:] != node[:-1])])
        starts = np.flatnonzero(new)
        leaders = node[starts].copy()
        if last is not None:
            leaders[0] = last[1]
        run = np.cumsum(new) - 1
        lead = leaders[run]
        member = fresh & (node != lead)
        # The row carried over from the batch before is out already, unless it is a leader that stood alone.
        if last is not None:
            member[0] = False
        shared = np.zeros(len(starts), bool)
        shared[run[member]] = True
        alone = shared.copy()
        if last is not None and last[3]:
            alone[0] = False
        out = last[3] if last is not None and run[-1] == 0 else False
        last = (int(sig[-1]), int(lead[-1]), int(node[-1]), bool(shared[-1] or out))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([sig[starts][alone], sig[member]])),
                pa.array(np.concatenate([leaders[alone], node[member]])),
                pa.array(np.concatenate([leaders[alone], lead[member]])),
            ],
            names=["sig", "node", "leader"],
        )


def wide_parity(h: np.ndarray) -> np.ndarray:
    """A parity bit a shingle, in a power of two of bits that is not below their number; none for a set of up to
    :data:`PARITY_BITS` shingles. Of a sketch twice as wide as another both halves are XORed to compare them."""
    bits = 1 << max(0, len(h) - 1).bit_length()
    if bits <= PARITY_BITS:
        return np.zeros(0, np.int64)
    return np.packbits(np.bincount((h & U(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1).view(np.int64)


def _set_rows(k: int, clashing: frozenset[int]):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            bounds, h = shingle_sets(batch.column(1), k)
            wide = [wide_parity(h[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            ends = np.cumsum([0, *map(len, wide)], dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(node_ids(*fingerprints(bounds, h), clashing)),
                    batch.column(0),
                    pa.array(np.diff(bounds), pa.int64()),
                    pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0, np.int64), *wide]))),
                    pa.ListArray.from_arrays(bounds.astype(np.int32), pa.array(h.view(np.int64))),
                ],
                names=["node", "wanted", "n", "wide", "shingles"],
            )

    return rows


def linked_documents(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, n_shingles and component_id (smallest id reachable by links, its own included), one row for every row.

    Words are separated by blanks and control white space, A to Z are lower-cased; two documents link when
    100 x intersection >= ``percent`` x union of their sets of ``words``-word shingles. A text with fewer words has its
    whole sequence as one shingle. Links are found without loss; which of them are followed to build a component is not
    part of the result. Shingles are compared by 64-bit hashes.

    Null and empty texts and texts without a word have no shingles and are components of their own. Rows without id link
    with nothing and have no component_id. Repeated rows are equal sets. Columns other than the two named are not read.
    An empty table gives no rows.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    narrow = docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("text"))
    described = staged(narrow.mapInArrow(_described(words), f"doc {id_type}, n long, node long, fingerprint long, other long, parity array<long>"), "jaccard-sets")
    # Different sets with one fingerprint are few on any corpus, about n * n / 2^65; they take their ids from both.
    twice = described.where("node IS NOT NULL").groupBy("node").agg(F.min("fingerprint").alias("f"), F.max("fingerprint").alias("g")).where("f <> g")
    clashing = frozenset(r["node"] for r in twice.select("node").collect())
    if clashing:
        described = described.withColumn("node", F.when(F.col("node").isin(*clashing), F.col("other")).otherwise(F.col("node")))
    nodes = staged(
        described.where("doc IS NOT NULL AND node IS NOT NULL")
        .groupBy("node")
        .agg(F.min("doc").alias("doc"), F.min("n").alias("n"), F.first("parity").alias("parity")),
        "jaccard-nodes",
    )
    keys = narrow.where("doc IS NOT NULL").select("text").mapInArrow(_signed(words, percent, clashing), "sig long, node long")
    shared = staged(keys.repartition("sig").sortWithinPartitions("sig", "node").mapInArrow(_shared, "sig long, node long, leader long"), "jaccard-shared")
    release_shuffles(docs.sparkSession)

    members = staged(nodes.join(shared.select("node").distinct(), "node").select("node", "doc", "n", "parity"), "jaccard-members")
    chosen = broadcast_up_to(members.select("doc", F.col("node").alias("wanted")), BROADCAST_IDS)
    sets = staged(
        narrow.join(chosen, "doc").select("wanted", "text").mapInArrow(_set_rows(words, clashing), "node long, wanted long, n long, wide array<long>, shingles array<long>")
        .where("node = wanted")
        .drop("wanted"),
        "jaccard-shingles",
    )
    some_wide = not sets.where(F.size("wide") > 0).isEmpty()

    def may_link(a: str, b: str) -> Column:
        """Whether sizes and Hamming distance leave a link possible, for nodes in columns n_a, p_a and n_b, p_b."""
        apart = sum((F.bit_count(F.get(f"p_{a}", F.lit(i)).bitwiseXOR(F.get(f"p_{b}", F.lit(i)))) for i in range(PARITY_BITS // 64)), F.lit(0))
        sizes = F.col(f"n_{a}"), F.col(f"n_{b}")
        return (100 * F.least(*sizes) >= percent * F.greatest(*sizes)) & ((100 + percent) * apart <= (100 - percent) * (sizes[0] + sizes[1]))

    def described_as(c: str) -> DataFrame:
        return members.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("parity").alias(f"p_{c}"))

    def linked(pairs: DataFrame) -> DataFrame:
        """Of ``pairs`` (a, b), which may repeat, those that link, written down."""
        near = pairs.join(described_as("a"), "a").join(described_as("b"), "b").where(may_link("a", "b"))
        return verified(near)

    def few(near: DataFrame) -> DataFrame:
        return F.broadcast(near) if 2 * near.count() <= BROADCAST_IDS else near

    def near_in_width(near: DataFrame) -> DataFrame:
        """Of pairs (a, b) those that wide sketches leave possible: a few bits a shingle move where the sets have 64."""
        first = sets.join(few(near), F.col("node") == F.col("a")).select("a", "b", F.col("n").alias("n_a"), F.col("wide").alias("w_a"))
        second = sets.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("wide").alias("w_b"))
        longs = F.least(F.size("w_a"), F.size("w_b"))

        def halved(w: str) -> Column:
            other_half = F.slice(w, longs + 1, longs)
            return F.when(F.size(w) > longs, F.zip_with(F.slice(w, F.lit(1), longs), other_half, lambda x, y: x.bitwiseXOR(y))).otherwise(F.col(w))

        apart = F.aggregate(F.zip_with(halved("w_a"), halved("w_b"), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda total, x: total + x)
        comparable = (longs > 0) & (F.greatest(F.size("w_a"), F.size("w_b")) <= 2 * longs)
        too_far = F.when(comparable, (100 + percent) * apart > (100 - percent) * (F.col("n_a") + F.col("n_b"))).otherwise(F.lit(False))
        return first.join(second, "b").where(~too_far).select("a", "b")

    def verified(near: DataFrame) -> DataFrame:
        """Of pairs (a, b) that passed :func:`may_link` those that link, by their sets, written down."""
        near = staged(near.select("a", "b").distinct(), "jaccard-near")
        if some_wide:
            near = staged(near_in_width(near), "jaccard-close")
        # What was shuffled for the pairs before is given free. Few pairs are handed to the sets of their first ends, so a set
        # moves once for each pair that it begins, and once if it ends any; the other sets stay where they are.
        release_shuffles(docs.sparkSession)
        first = sets.join(few(near), F.col("node") == F.col("a")).select("a", "b", F.col("shingles").alias("s_a"))
        second = sets.join(few(near.select(F.col("b").alias("node"))), "node", "left_semi").select(F.col("node").alias("b"), F.col("shingles").alias("s_b"))
        common = F.size(F.array_intersect("s_a", "s_b"))
        alike = 100 * common >= percent * (F.size("s_a") + F.size("s_b") - common)
        found = staged(first.join(second, "b").where(alike).select("a", "b"), "jaccard-links")
        release_shuffles(docs.sparkSession)
        return found

    def components(links: DataFrame) -> DataFrame:
        return staged(connected_components(links), "jaccard-components")

    def still_apart(component: DataFrame) -> DataFrame:
        """(sig, node, c) of the keys that nodes of several components share."""
        labelled = shared.join(component, "node", "left").select("sig", "node", F.coalesce("component", "node").alias("c"))
        mixed = labelled.groupBy("sig").agg(F.min("c").alias("x"), F.max("c").alias("y")).where("x <> y").select("sig")
        return staged(labelled.join(mixed, "sig"), "jaccard-apart")

    led = shared.where("node <> leader").select(F.col("node").alias("a"), F.col("leader").alias("b"))
    first = staged(led.groupBy("a").agg(F.min("b").alias("b")), "jaccard-first")
    links = linked(first)
    component = components(links)
    # The other leaders of a node, where they are not known to be in its component: most are.
    ends = [component.select(F.col("node").alias(c), F.col("component").alias(f"c_{c}")) for c in "ab"]
    second = led.distinct().join(first, ["a", "b"], "left_anti").join(ends[0], "a", "left").join(ends[1], "b", "left")
    links = links.union(linked(second.where(F.coalesce("c_a", "a") != F.coalesce("c_b", "b")).select("a", "b")))
    component = components(links)
    apart = still_apart(component)
    round_no, last_pairs = 0, float("inf")
    while True:
        # Pairs of different components are what comparing everything would cost: it is done when that is little, or when
        # comparing with other leaders brings few more links.
        by_key = apart.groupBy("sig", "c").count().groupBy("sig").agg(F.sum("count").alias("n"), F.sum(F.col("count") * F.col("count")).alias("own"))
        rows, pairs = by_key.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum((F.col("n") * F.col("n") - F.col("own")) / 2), F.lit(0))).first()
        if pairs <= PAIRS_A_ROW * rows or pairs > ROUND_LEAVES * last_pairs:
            break
        last_pairs = pairs
        # Each node takes, several times over, the smallest of its keys under a hash: similar nodes tend to take the same.
        # Those that did are compared with one of them.
        seeds = range(round_no << 8, (round_no << 8) + max(1, PICKS >> round_no))
        taken = in_few_tasks(apart, rows).groupBy("node", "c").agg(F.array(*(F.min_by("sig", F.xxhash64("sig", F.lit(i))) for i in seeds)).alias("keys"))
        taken = taken.join(members.select("node", "n", F.col("parity").alias("p")), "node").select("node", "c", "n", "p", F.posexplode("keys").alias("i", "sig"))
        order = F.xxhash64("node", "i", F.lit(round_no))
        first_of = F.min_by(F.struct(F.col("node").alias("b"), F.col("c").alias("c_b"), F.col("n").alias("n_b"), F.col("p").alias("p_b")), order)
        leaders = taken.groupBy(F.col("i").alias("i_b"), F.col("sig").alias("sig_b")).agg(first_of.alias("_")).select("i_b", "sig_b", "_.*")
        own = taken.select("i", "sig", "c", F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("p").alias("p_a"))
        others = own.join(leaders, (F.col("i") == F.col("i_b")) & (F.col("sig") == F.col("sig_b")) & (F.col("c") != F.col("c_b")) & may_link("a", "b"))
        more = verified(others)
        round_no += 1
        if more.isEmpty():
            break
        links = links.union(more)
        component = components(links)
        apart = still_apart(component)

    # A pair that shares many keys is wanted once. Each node carries its smallest keys: where two nodes have one of these in
    # common that is smaller than the key at hand, the pair was met there. The smallest key that they share always passes.
    firsts = apart.groupBy("node").agg(F.slice(F.array_sort(F.collect_set("sig")), 1, FIRST_KEYS).alias("firsts"))
    full = apart.join(members.select("node", "n", "parity").join(firsts, "node"), "node")
    one, other = (
        full.select(*(F.col(c).alias(f"{short}_{side}") for c, short in (("sig", "sig"), ("c", "c"), ("n", "n"), ("parity", "p"), ("firsts", "firsts"))), F.col("node").alias(side))
        for side in "ab"
    )
    met_before = F.coalesce(F.array_min(F.array_intersect("firsts_a", "firsts_b")) < F.col("sig_a"), F.lit(False))
    rest = one.join(other, (F.col("sig_a") == F.col("sig_b")) & (F.col("c_a") != F.col("c_b")) & (F.col("a") > F.col("b")) & may_link("a", "b") & ~met_before)
    # Pairs with the first leader of a key are decided: they were compared, or their ends were in one component.
    more = verified(rest.select("a", "b").join(led.distinct(), ["a", "b"], "left_anti"))
    if not more.isEmpty():
        component = components(links.union(more))

    smallest = nodes.join(component, "node").groupBy("component").agg(F.min("doc").alias("smallest"))
    placed = nodes.select("node", "doc").join(component, "node", "left").join(smallest, "component", "left").select("node", F.coalesce("smallest", "doc").alias("component_id"))
    linkable = F.when(F.col("doc").isNotNull(), F.col("node"))
    return (
        described.withColumn("node", linkable)
        .join(placed, "node", "left")
        .select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc").alias("component_id"))
    )
