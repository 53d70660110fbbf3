"""SimHash near-duplicates by a Gray-order hierarchical index.

A fingerprint has a bit set where more than half of the text's shingle hashes have it. Two different
fingerprints that differ in at most `distance` bits agree on one of distance + 1 blocks of bits, so each fingerprint
is filed once per block under a root node, the masked pattern of that block. Below a root the fingerprints are sorted
by Gray rank; runs of them share masked bit patterns, which form the upper nodes, and a search drops a whole run as
soon as the differences gathered on its path exceed the distance. Roots with too many members are refined by
filing them again on a block of the remaining bits, so no task ever holds more than a bounded group.

Links are not listed pair by pair: a root yields one edge from each linked fingerprint to the smallest one linked to
it there, which keeps every component. Components come from rounds of large and small stars over tables.

keep_first links texts by the similarity of their shingle sets instead. Texts of similarity 0.8 differ in some 15 % of
their bits, too many for blocks that must agree. So fingerprints of 128 bits are filed under roots of sampled bits in as
many tables as a pair of that similarity needs to share a root with probability RECALL; root bits grow with the
logarithm of the texts, so roots hold few texts of no likeness. The index finds the candidates. Each text's nearest ones
are verified on the shingle sets first. What these links leave in different components is then tried under each root, all
pairs within the distance, beside the shingle sets, until a link joins their components: no candidate is left out, and
a root gives fewer links than it has members.

Defined results: a null or wordless text has fingerprint zero and links like any other, so such texts are copies of each
other; rows with a null id take part; repeated rows stay in near_duplicates and go in keep_first; an empty table gives an
empty result; other columns pass unchanged, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._util import LOWER, as_bytes, materialize, schema_with, small_batches

SEED = 42
#: Members of a root that one task indexes; larger roots are refined.
ROOT_MEMBERS = 1 << 15
FULL = (1 << 64) - 1
#: 64-bit words of a fingerprint for shingle similarity; the share of pairs just at the similarity that meet under a root,
#: of more similar ones more; and members of a root on average, as a power of two.
WORDS, RECALL, ROOM = 2, 0.9, 6
#: Tables at least: for few texts, whose roots have few bits, they cost little and leave hardly a pair apart.
LEAST_TABLES = 24
#: Members of one root in which the nearest are searched together; a larger root is cut in Gray order for that, not for the others.
RUN = 2048
#: Members of a root up to which it is searched together with others.
JOINT = 256
#: Nearest candidates of each text that are verified first; all others are then looked for between the components known by then.
FIRST = 3
#: Shingles, and bytes, that a task looks at together.
TOGETHER, HELD_BYTES = 1 << 22, 1 << 26
#: Rows that are broadcast at most, of 16 bytes each; more are joined by a shuffle.
MOST_BROADCAST = 1_000_000


def shingle_hashes(text: bytes | None, width: int) -> np.ndarray:
    """XXH64 of each run of width words, joined by spaces; of all words if there are fewer."""
    words = text.translate(LOWER).split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    return np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts[: 1 - width].tolist(), ends[width - 1 :].tolist(), strict=True)), np.uint64, len(words) - width + 1)


def fingerprint(text: bytes | None, width: int = 3) -> int:
    """Bits set in over half of the shingle hashes; zero without words. Any length runs in bounded memory."""
    hashes = shingle_hashes(text, width)
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return sum(1 << b for b in np.flatnonzero(2 * ones > len(hashes)).tolist())


def fingerprints(docs: DataFrame, width: int = 3, doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and its fingerprint as a signed long; only those two columns of docs are read."""
    small_batches(docs.sparkSession)
    narrow = docs.select(F.col(doc_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, width) for t in as_bytes(batch.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return narrow.mapInArrow(run, schema_with(narrow, ["doc_id"], "fp long"))


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of each 64-bit pattern in the reflected Gray code."""
    x = x.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(shift)
    return x


def unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The labels once those of a and b are made equal, the smaller one standing for both."""
    while True:
        la, lb = label[a], label[b]
        if (la == lb).all():
            return label
        least = np.minimum(la, lb)
        np.minimum.at(label, la, least)
        np.minimum.at(label, lb, least)
        while (label[label] != label).any():
            label = label[label]


class GrayIndex:
    """Fingerprints of one or more 64-bit words in Gray order under nodes that hold the bits which all of their members share."""

    FAN = 8
    #: Searches that go down the levels together; a fingerprint has at most 2080 others within two bits.
    STEP = 1024
    #: Pairs that are looked at together at most.
    MOST = 1 << 21

    def __init__(self, members: np.ndarray, groups: np.ndarray | None = None):
        self.order = np.lexsort([gray_rank(w) for w in members.T[::-1]])
        #: With groups only pairs of different ones are searched; per level each node's group, -1 if its members are of several.
        self.groups = None if groups is None else [groups[self.order]]
        self.members = members[self.order]
        #: From the bottom up: the shared bits of each node and the mask that says which they are.
        self.levels: list[tuple[np.ndarray, np.ndarray]] = [(self.members, np.full(members.shape, FULL, np.uint64))]
        low = high = self.members
        while len(low) > 1:
            at = np.arange(0, len(low), self.FAN)
            low, high = np.bitwise_and.reduceat(low, at), np.bitwise_or.reduceat(high, at)
            self.levels.append((low, ~(low ^ high)))
            if self.groups:
                least, most = (f.reduceat(self.groups[-1], at) for f in (np.minimum, np.maximum))
                self.groups.append(np.where(least == most, most, -1))

    def pairs(self, distance: int, roots: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Places in Gray order, and differing bits, of all pairs within the distance that agree on the bits of roots in their first word."""
        roots = roots[self.order]
        step = min(self.STEP, max(1, self.MOST // len(self.members)))
        for a in range(0, len(self.members), step):
            who = np.arange(a, min(a + step, len(self.members)))
            node = np.zeros_like(who)
            for k in range(len(self.levels) - 1, -1, -1):
                pattern, mask = self.levels[k]
                differ = (self.members[who] ^ pattern[node]) & mask[node]
                bits = np.bitwise_count(differ).sum(1, dtype=np.int64)
                keep = (bits <= distance) & (differ[:, 0] & roots[who] == 0)
                if self.groups:
                    keep &= self.groups[k][node] != self.groups[0][who]
                who, node, bits = who[keep], node[keep], bits[keep]
                if k:
                    node = (node[:, None] * self.FAN + np.arange(self.FAN)).ravel()
                    inside = node < len(self.levels[k - 1][0])
                    who, node = np.repeat(who, self.FAN)[inside], node[inside]
            yield who, node, bits

    def components(self, distance: int, roots: np.ndarray) -> np.ndarray:
        """For each member, in the order given, the place of the first member of its component."""
        label = np.arange(len(self.members))
        for a, b, _ in self.pairs(distance, roots):
            label = unite(label, a, b)
        found = np.empty_like(label)
        found[self.order] = self.order[label]
        return found


def nearest(index: GrayIndex, distance: int, roots: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges from each member to its FIRST nearest ones within the distance, as places in the order given, and their differing bits."""
    found = []
    for a, b, bits in index.pairs(distance, roots):
        a, b, bits = (x[a != b] for x in (a, b, bits))
        order = np.lexsort((b, bits, a))
        a, b, bits = a[order], b[order], bits[order]
        begins = np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else np.zeros(0, np.int64)
        place = np.arange(len(a)) - np.repeat(begins, np.diff(np.r_[begins, len(a)]))
        found.append(tuple(x[place < FIRST] for x in (a, b, bits)))
    a, b, bits = map(np.concatenate, zip(*found, strict=True))
    return index.order[a], index.order[b], bits


def linking(index: GrayIndex, distance: int, roots: np.ndarray, sets: list[np.ndarray], similarity: float) -> tuple[list[int], list[int]]:
    """Links that join the groups of an index: places, in the order given, of pairs of different groups within the distance whose sets are similar
    enough. Every such pair is tried unless links found before join its groups, so there are fewer links than members."""
    sets = [sets[k] for k in index.order]
    sizes = np.array([len(x) for x in sets])
    starts = np.cumsum(sizes) - sizes
    values, ids = np.unique(np.concatenate(sets), return_inverse=True)
    held, label = np.zeros(len(values), bool), np.unique(index.groups[0], return_inverse=True)[1]
    left, right = [], []
    for a, b, _ in index.pairs(distance, roots):
        # Of two sets the smaller one's share of the larger bounds their similarity.
        low, high = np.minimum(sizes[a], sizes[b]), np.maximum(sizes[a], sizes[b])
        keep = (a < b) & (low >= similarity * high - 1e-9)
        a, b = a[keep], b[keep]
        order = np.argsort(a, kind="stable")
        a, b = a[order], b[order]
        if not len(a):
            continue
        begins = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
        for begin, end in zip(begins, [*begins[1:], len(a)], strict=True):
            who, others = a[begin], b[begin:end]
            mine = ids[starts[who] : starts[who] + sizes[who]]
            held[mine] = True
            others = others[label[others] != label[who]]
            while len(others):
                # Sets of bounded size in all are looked at together.
                some = others[: max(1, int(np.searchsorted(np.cumsum(sizes[others]), TOGETHER)))]
                others = others[len(some) :]
                of = np.repeat(np.arange(len(some)), sizes[some])
                at = np.repeat(starts[some] - (np.cumsum(sizes[some]) - sizes[some]), sizes[some]) + np.arange(len(of))
                common = np.bincount(of, weights=held[ids[at]], minlength=len(some))
                linked = some[common >= similarity * (sizes[who] + sizes[some] - common) - 1e-9]
                for group, place in zip(*np.unique(label[linked], return_index=True), strict=True):
                    left.append(index.order[who])
                    right.append(index.order[linked[place]])
                    label[label == group] = label[who]
                others = others[label[others] != label[who]]
            held[mine] = False
    return left, right


def refined(filed: DataFrame, distance: int) -> DataFrame:
    """File each fingerprint once for each block of the bits below its root, with that block moved up into the root.

    x holds the permuted bits, the first `bits` of them the root; path tells the permutation.
    """
    ways = distance + 1
    rest = "(64 - bits)"
    low = "(x & shiftrightunsigned(-1L, bits))"
    files = []
    for k in range(ways):
        a, b = f"int({rest} * {k} div {ways})", f"int({rest} * {k + 1} div {ways})"
        turned = f"((shiftleft({low}, {a}) | shiftrightunsigned({low}, {rest} - {a})) & shiftrightunsigned(-1L, bits))"
        files.append(f"struct(path * {ways} + {k} as path, bits + {b} - {a} as bits, (x & ~shiftrightunsigned(-1L, bits)) | {turned} as x)")
    return filed.select("fp", F.explode(F.expr(f"array({', '.join(files)})")).alias("f")).select("fp", "f.path", "f.bits", "f.x", F.expr("shiftrightunsigned(f.x, 64 - f.bits)").alias("root"))


def star_edges(filed: DataFrame, distance: int) -> DataFrame:
    """Under each root, an edge from each linked fingerprint to the first of its component there."""

    def joined(chunk: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(chunk)
        fp, path, bits, x = (table.column(c).to_numpy() for c in ("fp", "path", "bits", "x"))
        a, b = [], []
        for p in np.unique(path):
            at = np.flatnonzero(path == p)
            roots = ~(np.uint64(FULL) >> bits[at].astype(np.uint64))
            first = GrayIndex(x[at].view(np.uint64)[:, None]).components(distance, roots)
            linked = np.flatnonzero(first != np.arange(len(at)))
            a.append(fp[at[linked]])
            b.append(fp[at[first[linked]]])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) < ROOT_MEMBERS:
                continue
            # Whole roots leave; the last one may go on in the next batch.
            table = pa.Table.from_batches(held).combine_chunks()
            path, root = table.column("path").to_numpy(), table.column("root").to_numpy()
            same = (path == path[-1]) & (root == root[-1])
            end = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
            if end:
                yield joined(table.slice(0, end).to_batches())
                held = table.slice(end).to_batches()
        if held:
            yield joined(held)

    return filed.repartition("path", "root").sortWithinPartitions("path", "root").mapInArrow(run, "a long, b long")


def links(distinct: DataFrame, distance: int) -> DataFrame:
    """Edges that keep the components of the link graph over the distinct fingerprints (column fp)."""
    filed = distinct.select("fp", F.lit(0).alias("path"), F.lit(0).alias("bits"), F.col("fp").alias("x"))
    filed = refined(filed, distance)
    edges = None
    for level in range(3):
        large = filed.groupBy("path", "root").count().where(F.col("count") > ROOT_MEMBERS).select("path", "root")
        if level == 2 or large.isEmpty():
            part = star_edges(filed, distance)  # after three levels a root leaves 19 bits at most
            return materialize((part if edges is None else edges.unionByName(part)).distinct())
        part = star_edges(filed.join(large, ["path", "root"], "left_anti"), distance)
        edges = part if edges is None else edges.unionByName(part)
        filed = refined(filed.join(large, ["path", "root"], "left_semi"), distance)
    return edges


def components(edges: DataFrame) -> DataFrame:
    """For each node of edges (a, b) the smallest node of its component: rounds of large and small stars.

    Each round is written to the shared folder. Rounds end when the edges no longer change.
    """
    lower = lambda e: e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct()
    edges, seen = materialize(lower(edges)), None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            break
        seen = state
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), "a").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = lower(large)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.expr("array(struct(b as a, m as b), struct(a as a, m as b))")).alias("e")).select("e.*")
        edges = materialize(lower(small))
    return edges.select(F.col("a").alias("fp"), F.col("b").alias("first")).unionByName(edges.select(F.col("b").alias("fp"), F.col("b").alias("first")).distinct())


def near_duplicates(docs: DataFrame, width: int = 3, distance: int = 2, doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's fingerprint, as 16 hex digits, and the smallest doc_id of its component.

    A null or wordless text has fingerprint zero and links like any other. Rows with a null id take part and get the
    smallest id of their component, null where it has none. Repeated rows stay.
    """
    prints = materialize(fingerprints(docs, width, doc_col, text_col))
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    first = components(links(distinct, distance))
    placed = materialize(distinct.join(first, "fp", "left").select("fp", "rep", F.coalesce("first", "fp").alias("first")))
    several = placed.join(first.select("first").distinct(), "first", "left_semi")
    least = several.groupBy("first").agg(F.min("rep").alias("least"))
    groups = materialize(placed.join(least, "first", "left").select("fp", F.coalesce("least", "rep").alias("component_id")))
    return prints.join(groups, "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def shingle_set(text: bytes | None, width: int) -> np.ndarray:
    return np.unique(shingle_hashes(text, width))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def wide_fingerprint(text: bytes | None, width: int) -> list[int]:
    """WORDS words of bits set in over half of the hashes of the distinct shingles, each word from hashes of its own."""
    hashes = shingle_set(text, width)
    ones = np.zeros((WORDS, 64), np.int64)
    for at in range(0, len(hashes), 1 << 16):
        for k in range(WORDS):
            part = mixed(hashes[at : at + (1 << 16)] + np.uint64(k * 0x9E3779B97F4A7C15 & FULL))
            ones[k] += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return [sum(1 << b for b in np.flatnonzero(2 * word > len(hashes)).tolist()) for word in ones]


def plan(texts: int, similarity: float) -> tuple[int, int, int]:
    """Root bits, tables and the distance of candidates for so many different fingerprints."""
    same, n = 1 - math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi, 64 * WORDS  # chance that a bit agrees
    bits = min(48, max(4, math.ceil(math.log2(texts + 1)) - ROOM))
    # A pair with k differing bits shares a root whose bits all fall beside these.
    chance = [math.comb(n, k) * (1 - same) ** k * same ** (n - k) for k in range(n + 1)]
    meet = [math.comb(n - k, bits) / math.comb(n, bits) for k in range(n + 1)]
    tables = LEAST_TABLES
    while sum(p * (1 - (1 - m) ** tables) for p, m in zip(chance, meet, strict=True)) < RECALL:
        tables += 1 + tables // 50
    return bits, tables, math.ceil(n * (1 - same) + 3 * math.sqrt(n * same * (1 - same)))


def filed(nodes: DataFrame, bits: int, tables: int) -> DataFrame:
    """Each node (node, w0, w1, own, and what else it has) once per table, or in those of its column ts: its bits in an order of the table's own, the
    first word as its Gray rank. Rows of a root are in one partition, in Gray order."""
    orders = [np.random.default_rng((SEED, t)).permutation(64 * WORDS) for t in range(tables)]
    chosen = "ts" in nodes.columns
    rest = ["node", "own", *[c for c in nodes.columns if c == "shingles"]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = np.stack([batch.column(f"w{k}").to_numpy() for k in range(WORDS)], axis=1)
            each = np.unpackbits(np.ascontiguousarray(words, ">i8").view(np.uint8).reshape(len(batch), -1), axis=1)
            wanted = [set(ts) for ts in batch.column("ts").to_pylist()] if chosen else None
            for t, order in enumerate(orders):
                at = np.array([k for k, ts in enumerate(wanted) if t in ts], np.int64) if chosen else np.arange(len(batch))
                if not len(at):
                    continue
                x = np.ascontiguousarray(np.packbits(each[at][:, order], axis=1)).view(">u8").astype(np.uint64)
                # Signed longs sort like the ranks once their first bit is turned over.
                rank = (gray_rank(x[:, 0]) ^ np.uint64(1 << 63)).view(np.int64)
                others = [batch.column(c).take(pa.array(at)) for c in rest]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), t, np.int32)), pa.array(rank), pa.array(x[:, 1].view(np.int64)), *others], ["t", "rank", "x1", *rest])

    nodes = nodes.select(*[f"w{k}" for k in range(WORDS)], *rest, *(["ts"] if chosen else []))
    rows = nodes.mapInArrow(run, "t int, rank long, x1 long, node long, own long" + (", shingles binary" if "shingles" in rest else ""))
    return rows.repartition("t", F.shiftright("rank", 64 - bits)).sortWithinPartitions("t", "rank")


def by_root(rows: DataFrame, bits: int, cut: int | None, look: Callable, schema: str) -> DataFrame:
    """What look makes of the members of each root, or of several small ones of a table together: it gets their columns, bits and root masks. Large roots
    are cut into runs of so many members, or stay whole."""

    def joined(table: pa.Table) -> Iterator[pa.RecordBatch]:
        t, rank, x1 = (table.column(c).to_numpy() for c in ("t", "rank", "x1"))
        g = rank.view(np.uint64) ^ np.uint64(1 << 63)
        x = np.stack((g ^ (g >> np.uint64(1)), x1.view(np.uint64)), axis=1)
        root = g >> np.uint64(64 - bits)
        starts = np.flatnonzero(np.r_[True, (root[1:] != root[:-1]) | (t[1:] != t[:-1])])
        sizes = np.diff(np.r_[starts, len(g)])
        # Large roots on their own; between them the small ones of a table together.
        cuts = {0, len(g), *np.flatnonzero(np.diff(t)) + 1}
        for start, size in zip(starts[sizes > JOINT].tolist(), sizes[sizes > JOINT].tolist(), strict=True):
            cuts |= {*range(start, start + size, cut or size), start + size}
        cuts = sorted(cuts)
        for low, high in zip(cuts, cuts[1:], strict=False):
            if high - low > 1:
                yield from look(table.slice(low, high - low), x[low:high], np.full(high - low, FULL << (64 - bits) & FULL, np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, size, more = [], 0, 0, 1
        for batch in batches:
            held.append(batch)
            rows, size = rows + len(batch), size + batch.nbytes
            if rows < more * ROOT_MEMBERS and size < more * HELD_BYTES:
                continue
            # Whole roots leave, or whole runs of one that goes on in the next batch.
            table = pa.Table.from_batches(held).combine_chunks()
            t, root = table.column("t").to_numpy(), table.column("rank").to_numpy() >> (64 - bits)
            same = (t == t[-1]) & (root == root[-1])
            begin = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
            end = begin + ((len(same) - begin) // cut * cut if cut else 0)
            yield from joined(table.slice(0, end))
            held, more = table.slice(end).to_batches(), 1 if end else 2 * more
            rows, size = len(table) - end, sum(b.nbytes for b in held)
        if held:
            yield from joined(pa.Table.from_batches(held).combine_chunks())

    small_batches(rows.sparkSession)
    return rows.mapInArrow(run, schema)


def candidates(nodes: DataFrame, similarity: float, texts: int) -> DataFrame:
    """Edges (a, b, bits) from each node to its nearest candidates under the roots of all tables, with their differing bits."""
    bits, tables, distance = plan(texts, similarity)

    def look(table: pa.Table, x: np.ndarray, roots: np.ndarray) -> Iterator[pa.RecordBatch]:
        node = table.column("node").to_numpy()
        i, j, of = nearest(GrayIndex(x), distance, roots)
        a, b = node[i], node[j]
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(of.astype(np.int32))], ["a", "b", "bits"])

    return by_root(filed(nodes.withColumn("own", F.col("node")), bits, tables), bits, RUN, look, "a long, b long, bits int")


def apart(nodes: DataFrame, similarity: float, texts: int) -> DataFrame:
    """node and ts, the tables under whose roots it has a candidate of another component; nodes tell their own one."""
    bits, tables, distance = plan(texts, similarity)

    def look(table: pa.Table, x: np.ndarray, roots: np.ndarray) -> Iterator[pa.RecordBatch]:
        node, own = table.column("node").to_numpy(), table.column("own").to_numpy()
        found = np.zeros(len(node), bool)
        if (own != own[0]).any():
            index = GrayIndex(x, own)
            for a, _, _ in index.pairs(distance, roots):
                found[index.order[a]] = True
        yield pa.RecordBatch.from_arrays([pa.array(node[found]), table.column("t").combine_chunks().filter(pa.array(found))], ["node", "t"])

    found = by_root(filed(nodes, bits, tables), bits, None, look, "node long, t int")
    return materialize(found.groupBy("node").agg(F.collect_set("t").alias("ts")))


def joining(nodes: DataFrame, similarity: float, texts: int) -> DataFrame:
    """Links (a, b) that join the components of nodes with shingles, tried under the roots of their tables ts."""
    bits, tables, distance = plan(texts, similarity)

    def look(table: pa.Table, x: np.ndarray, roots: np.ndarray) -> Iterator[pa.RecordBatch]:
        node, own = table.column("node").to_numpy(), table.column("own").to_numpy()
        sets = [np.frombuffer(v, np.uint32) for v in table.column("shingles").to_pylist()]
        i, j = linking(GrayIndex(x, own), distance, roots, sets, similarity)
        yield pa.RecordBatch.from_arrays([pa.array(node[np.array(k, np.int64)]) for k in (i, j)], ["a", "b"])

    return by_root(filed(nodes, bits, tables), bits, None, look, "a long, b long")


def similar(edges: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The edges (a, b) whose shingle sets (node, 32 bits for each shingle) have a Jaccard similarity of at least the one given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(common >= similarity * (len(x) + len(y) - common) - 1e-9)
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = edges.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def few(small: DataFrame) -> DataFrame:
    """A narrow side of a join, counted: broadcast while it has few rows."""
    return F.broadcast(small) if small.count() <= MOST_BROADCAST else small


def similar_components(nodes: DataFrame, texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """Node (fp) and first node of its component, of the nodes that have links. texts: key (k0, k1) and text of all rows.

    Each text's nearest candidates are verified first. What these leave in different components is verified next.
    """

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(t, width) >> np.uint64(32)).astype(np.uint32).tobytes() for t in as_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["node", "shingles"])

    found = materialize(candidates(nodes, similarity, nodes.count()).distinct())
    ends = found.select(F.explode(F.array(F.struct(F.col("a").alias("node"), "bits", "a", "b"), F.struct(F.col("b").alias("node"), "bits", "a", "b"))).alias("e")).select("e.*")
    # A text has a bounded number of candidates in each table.
    nearest = ends.groupBy("node").agg(F.slice(F.array_sort(F.collect_set(F.struct("bits", "a", "b"))), 1, FIRST).alias("edges"))
    first = materialize(nearest.select(F.explode("edges").alias("e")).select("e.a", "e.b").distinct())

    def shingles(some: DataFrame) -> DataFrame:
        wanted = materialize(nodes.join(some, "node", "left_semi").select("node", "k0", "k1"))
        held = texts.join(few(wanted), ["k0", "k1"]).dropDuplicates(["node"])
        return materialize(held.select("node", "text").mapInArrow(shingled, "node long, shingles binary"))

    linked = materialize(similar(first, shingles(ends.select("node").distinct()), similarity))
    known = components(linked)
    texts_in = nodes.count()
    placed = nodes.join(known.select(F.col("fp").alias("node"), F.col("first").alias("own")), "node", "left").withColumn("own", F.coalesce("own", "node"))
    placed = materialize(placed.select("node", "own", *[f"w{k}" for k in range(WORDS)]))
    others = apart(placed, similarity, texts_in)
    tried = placed.join(others, "node").join(shingles(others.select("node")), "node")
    more = materialize(joining(tried, similarity, texts_in))
    return known if more.isEmpty() else components(linked.unionByName(more))


def row_keys(docs: DataFrame) -> list[Column]:
    """128 bits of a row's values and of which are null; rows with equal keys are equal in all columns."""
    parts = []
    for f in docs.schema:
        c = F.col(f"`{f.name}`")
        # Maps have no hash of their own.
        parts += [F.to_json(F.struct(c)) if "map<" in f.dataType.simpleString() else c, c.isNull()]
    return [F.xxhash64(*parts), F.xxhash64(F.lit(1), *parts)]


def keep_first(docs: DataFrame, width: int = 5, similarity: float = 0.8, doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component of texts with similar shingle sets: the one with the smallest id.

    Of several rows with that id the first by a digest of all columns stays, and one of equal rows. Columns pass
    unchanged, whatever their names. Each text is fingerprinted once; texts are neither stored nor moved, but for those
    that have candidates and rows that occur several times.
    """
    small_batches(docs.sparkSession)
    k0, k1 = row_keys(docs)
    doc, text = F.col(f"`{doc_col}`"), F.col(f"`{text_col}`")
    narrow = docs.select(doc.alias("doc"), k0.alias("k0"), k1.alias("k1"), text.alias("text"))
    names = [f"w{j}" for j in range(WORDS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([wide_fingerprint(t, width) for t in as_bytes(batch.column(3))], np.uint64).reshape(-1, WORDS).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *map(pa.array, found.T)], ["doc", "k0", "k1", *names])

    prints = materialize(narrow.mapInArrow(run, schema_with(narrow, ["doc", "k0", "k1"], ", ".join(f"{c} long" for c in names))))
    order = F.struct(F.col("doc").isNull().alias("none"), "doc", "k0", "k1")
    nodes = prints.groupBy(*names).agg(F.min(order).alias("order")).select(F.monotonically_increasing_id().alias("node"), *names, "order", "order.k0", "order.k1")
    nodes = materialize(nodes)
    first = similar_components(nodes, narrow.select("k0", "k1", "text"), width, similarity)
    placed = nodes.join(first, nodes["node"] == first["fp"], "left").select("order", F.coalesce("first", "node").alias("first"))
    kept = placed.groupBy("first").agg(F.min("order").alias("order")).select("order.k0", "order.k1", F.lit(True).alias("kept"))
    rows = prints.groupBy("k0", "k1").agg(F.count("*").alias("n")).join(kept, ["k0", "k1"], "left")
    mark = "_k" + "_" * max(map(len, docs.columns))  # longer than any column's name, so it clashes with none
    # Rows that go, and those of which one stays; all others stay as they are.
    gone = materialize(rows.where("kept is null or n > 1").select(F.col("k0").alias(mark + "0"), F.col("k1").alias(mark + "1"), "kept"))
    keyed, on = docs.withColumns({mark + "0": k0, mark + "1": k1}), [mark + "0", mark + "1"]
    single = keyed.join(few(gone.select(*on)), on, "left_anti").select(*[f"`{c}`" for c in docs.columns])
    several = keyed.join(few(gone.where("kept").select(*on)), on, "left_semi").dropDuplicates(on).select(*[f"`{c}`" for c in docs.columns])
    return single.unionByName(several)
