"""N-gram Jaccard join by prefix filters under several global orders.

A document is the set of its word shingles. If two sets of sizes n and m overlap by the threshold, then under *any*
order of all shingles they share one among the first n - ceil(t n) + 1 of the one and of the other. Three orders are
used; all put shingles that are rare in the whole corpus first and break ties by hashes of their own. The prefixes under the first
order are joined; those under the other two travel along as bit masks, and a pair whose masks do not meet under both
shares no prefix shingle there. So the three filters are intersected before any set is compared. Shingles that occur once in the
corpus join nothing and are not sent; their number bounds the overlap of each pair and rules out most others.

Equal sets are one node from the start (told apart by size and a 64-bit sum of hashes), so exact copies cost nothing. A pair is written
in one bucket only, that of the first of both nodes' leading shingles. In buckets of many nodes not all pairs are written
out: first every node is compared with the bucket's hub, the node with the fewest shingles of its own (copies of one text, changed
here and there, hang on to the least changed one), then only nodes that are still in different components are paired, by a
join that spills. It compares odd sketches of the sets: what both sets have cancels out, so each bit in which two sketches differ stands for a
shingle that only one of the sets has, and sets that reach the threshold have few of those. Components come out as if all pairs had been compared.

Words are runs outside [\\x20\\x09-\\x0D] after lower-casing A-Z; with fewer words than a shingle has, all of them are one shingle; null and
empty texts are linked with nothing. Rows of equal doc_id are one document; rows without doc_id take part in links but give no
component_id. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from waybill.llm.common import mix, pieces, runs_of_words, word_hashes
from waybill.llm.graph import components
from waybill.llm.rare import level_of, levels, slice_bits, text_bytes
from waybill.session import cut_lineage

WORDS, PERCENT = 4, 85
#: Bins of the table of levels: 32 MB at a byte each.
TABLE_BITS = 25
#: Buckets of more nodes than this start with their hub; it decides how pairs are found, not which.
BUCKET = 24
SLICE_TEXT = 32 << 20
FILTER_BITS = 24


def shingle_sets(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of every text, one after another, and where each text's begin."""
    words, first = word_hashes(texts, lower=True)
    h, begin = runs_of_words(words, first, size)
    counts = np.diff(first)
    if (short := np.flatnonzero((counts > 0) & (counts < size))).size:
        extra = np.empty(len(short), np.uint64)
        for n in range(1, size):
            mine = counts[short] == n
            runs, at = runs_of_words(words, first, n)
            extra[mine] = runs[at[short[mine]]]
        h = np.insert(h, begin[short], extra)
        begin = begin + np.searchsorted(short, np.arange(len(begin)))
    text_no = np.repeat(np.arange(len(counts)), np.diff(begin))
    order = np.lexsort((h, text_no))
    h, text_no = h[order], text_no[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text_no[1:] != text_no[:-1])
    return h[new], np.searchsorted(text_no[new], np.arange(len(counts) + 1))


def nodes_of(h: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """A signed 64-bit number for each set: equal for equal sets."""
    # All in uint64, which wraps: a place in the batch must not change a set's sum.
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(mix(h ^ np.uint64(0xA5A5A5A5A5A5A5A5)), out=total[1:])
    sizes = np.diff(begin).astype(np.uint64)
    return mix((total[begin[1:]] - total[begin[:-1]]) ^ mix(sizes)).astype(np.int64)


#: Numbers of 64 bits in a sketch. With twice as many the join's generated method is too long for the JVM to compile.
_SKETCH = 16
_SKETCHES = [f"s{i}" for i in range(_SKETCH)]


def sketch_of(h: np.ndarray) -> np.ndarray:
    """``_SKETCH`` numbers with the bits to which an odd number of a set's hashes belong."""
    counts = np.bincount((mix(h) % np.uint64(_SKETCH * 64)).astype(np.int64), minlength=_SKETCH * 64)
    return np.packbits((counts & 1).astype(bool), bitorder="little").view("<i8")


def _texts(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def _documents_as_nodes(documents: DataFrame, size: int) -> DataFrame:
    """doc_id, n (shingles) and node."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            h, begin = shingle_sets(batch.column("text"), size)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(np.diff(begin).astype(np.int64)), pa.array(nodes_of(h, begin))], names=["doc_id", "n", "node"])

    return _texts(documents).mapInArrow(run, "doc_id long, n long, node long")


def prefix_length(n: int, percent: int) -> int:
    return n - -(-n * percent // 100) + 1


def _rank(h: np.ndarray, level: np.ndarray, order: int) -> np.ndarray:
    return level.astype(np.uint64) << np.uint64(56) | mix(h + np.uint64(order + 1)) >> np.uint64(8)


def _prefix(h: np.ndarray, level: np.ndarray, order: int, length: int) -> np.ndarray:
    """The repeated shingles among the first ``length`` under an order, in that order."""
    rank = _rank(h, level, order)
    first = np.argpartition(rank, length - 1)[:length] if length < len(h) else np.arange(len(h))
    first = first[level[first] > 0]
    return h[first[np.argsort(rank[first])]]


#: Bits per mask of a prefix, and leading shingles that decide where a pair is written.
_MASK, _LEAD = 64, 4
#: Open buckets of a node that are named with it; a pair that has none of them in common is written in each bucket of both.
_OPEN = 64
_COLUMNS = (("keys", "<i8"), ("nodes", "<i8"), ("sizes", "<i4"), ("own", "<i4"), ("mask1", "<u8"), ("mask2", "<u8"), *((f"lead{i}", "<i8") for i in range(_LEAD)))


def _prefixes(documents: DataFrame, table, size: int, percent: int, cuts: int) -> DataFrame:
    """Prefix shingles that occur more than once, with what is known of their nodes, packed by slices of their hashes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = np.frombuffer(table.value, np.uint8)
        for batch in pieces(batches):
            h, begin = shingle_sets(batch.column("text"), size)
            nodes, level = nodes_of(h, begin), level_of(marks, h)
            _, firsts = np.unique(nodes, return_index=True)
            parts, facts = [], []
            for i in firsts.tolist():
                mine, rare = h[begin[i] : begin[i + 1]], level[begin[i] : begin[i + 1]]
                n = len(mine)
                prefix = _prefix(mine, rare, 0, prefix_length(n, percent)) if n and rare.any() else mine[:0]
                if not len(prefix):
                    continue
                masks = [int(np.bitwise_or.reduce(np.uint64(1) << (_prefix(mine, rare, k, prefix_length(n, percent)) % np.uint64(_MASK)), initial=0)) for k in (1, 2)]
                keys = prefix.astype(np.int64)
                parts.append(keys)
                facts.append((nodes[i], n, int((rare == 0).sum()), *masks, *keys[:_LEAD], *[0] * (_LEAD - len(keys[:_LEAD]))))
            key = np.concatenate(parts) if parts else np.zeros(0, np.int64)
            own = np.repeat(np.arange(len(parts)), [len(p) for p in parts]).astype(np.int64)
            order = np.argsort(key.view(np.uint64), kind="stable")
            key, own = key[order], own[order]
            edges = np.searchsorted(key.view(np.uint64) >> np.uint64(64 - cuts), np.arange((1 << cuts) + 1))
            rows = [(i, x, y) for i, (x, y) in enumerate(zip(edges, edges[1:])) if x < y]
            values = [key, *(np.array(column, kind)[own] for column, (_, kind) in zip(zip(*facts), _COLUMNS[1:]))] if facts else []
            yield pa.RecordBatch.from_arrays(
                [pa.array([i for i, _, _ in rows], pa.int32()),
                 *(pa.array([v[x:y].astype(kind).tobytes() for _, x, y in rows], pa.binary()) for v, (_, kind) in zip(values or [key] * len(_COLUMNS), _COLUMNS))],
                names=["slice", *(name for name, _ in _COLUMNS)])

    return _texts(documents).mapInArrow(run, "slice int, " + ", ".join(f"{name} binary" for name, _ in _COLUMNS))


#: kind 0: a pair (a, b) of nodes to compare; 1: node b of the large bucket a, with its facts.
_FOUND = "kind int, a long, b long, n int, own int, mask1 long, mask2 long, lead array<long>"


def _pairs(percent: int):
    def pairs(part: pa.Table) -> pa.Table:
        v = {name: np.frombuffer(b"".join(part[name].to_pylist()), kind) for name, kind in _COLUMNS}
        order = np.lexsort((v["nodes"], v["sizes"], v["keys"]))
        key, node = v["keys"][order], v["nodes"][order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
        v = {name: x[order][new] for name, x in v.items()}
        key, node, n, own = v["keys"], v["nodes"], v["sizes"].astype(np.int64), v["own"].astype(np.int64)
        lead = np.stack([v[f"lead{i}"] for i in range(_LEAD)], axis=1)

        def possible(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            """What two nodes cannot share is known: the shingles only one of them has, and prefixes whose masks do not meet."""
            most = np.minimum(n[x] - own[x], n[y] - own[y])
            meet = ((v["mask1"][x] & v["mask1"][y]) > 0) & ((v["mask2"][x] & v["mask2"][y]) > 0)
            return meet & (100 * most >= percent * (n[x] + n[y] - most))

        def here(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            """Whether this bucket is the first that both nodes lead with (or none is)."""
            same = (lead[x][:, :, None] == lead[y][:, None, :]).any(2) & (lead[x] != 0)
            return ~same.any(1) | (lead[x, same.argmax(1)] == key[x])

        edges = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]])) if len(key) else np.zeros(1, np.int64)
        width = np.diff(edges)
        found = []
        # Small buckets: all pairs at a distance of d places, for all buckets at once.
        small = np.repeat(width <= BUCKET, width)
        for d in range(1, BUCKET):
            x = np.flatnonzero(small[:-d] & (key[:-d] == key[d:])) if len(key) > d else np.zeros(0, np.int64)
            if not len(x):
                break
            x = x[possible(x, x + d)]
            x = x[here(x, x + d)]
            found.append((node[x], node[x + d]))
        members = []
        for e in np.flatnonzero(width > BUCKET).tolist():
            rows = np.arange(edges[e], edges[e + 1])
            hub = rows[np.lexsort((node[rows], own[rows]))[0]]
            near = rows[(rows != hub) & (lead[rows, :2] == key[rows, None]).any(1)]
            near = near[possible(near, np.full(len(near), hub))]
            found.append((node[near], np.full(len(near), node[hub])))
            members.append(rows)
        pair = np.unique(np.stack([np.concatenate([np.minimum(x, y) for x, y in found]), np.concatenate([np.maximum(x, y) for x, y in found])]), axis=1) if found else np.zeros((2, 0), np.int64)
        rows = np.concatenate(members) if members else np.zeros(0, np.int64)
        none = pa.nulls(pair.shape[1])
        return pa.table({
            "kind": pa.array(np.repeat(np.array([0, 1], np.int32), [pair.shape[1], len(rows)])),
            "a": np.concatenate([pair[0], key[rows]]), "b": np.concatenate([pair[1], node[rows]]),
            **{name: pa.concat_arrays([none.cast(kind), pa.array(x[rows].astype(t)).cast(kind)]) for name, x, t, kind in (
                ("n", n, np.int32, pa.int32()), ("own", own, np.int32, pa.int32()), ("mask1", v["mask1"], np.int64, pa.int64()), ("mask2", v["mask2"], np.int64, pa.int64()))},
            "lead": pa.array([None] * pair.shape[1] + lead[rows].tolist(), pa.list_(pa.int64())),
        })

    return pairs


def _sets(documents: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(node, shingles): the packed sets of the nodes in ``wanted``; a bitmap of fixed size keeps most others out of the shuffle."""
    place = F.pmod("node", F.lit(1 << FILTER_BITS)) + 1
    marks = (
        wanted.select(place.alias("p")).groupBy(F.expr("bitmap_bucket_number(p)").alias("bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(p))").alias("bits")).collect())
    bitmap = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    for row in marks:
        at = (row["bucket"] - 1) * 4096
        bitmap[at : at + 4096] = np.frombuffer(row["bits"], np.uint8)
    shared = documents.sparkSession.sparkContext.broadcast(bitmap.tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(shared.value, np.uint8)
        for batch in pieces(batches):
            h, begin = shingle_sets(batch.column("text"), size)
            nodes = nodes_of(h, begin)
            _, firsts = np.unique(nodes, return_index=True)
            at = nodes[firsts].view(np.uint64) & np.uint64((1 << FILTER_BITS) - 1)
            hit = (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1
            chosen = firsts[hit > 0]
            yield pa.RecordBatch.from_arrays(
                [pa.array(nodes[chosen]), pa.array([h[begin[i] : begin[i + 1]].astype("<u8").tobytes() for i in chosen.tolist()], pa.binary())], names=["node", "shingles"])

    sets = _texts(documents).mapInArrow(run, "node long, shingles binary")
    return sets.join(wanted, "node", "left_semi").groupBy("node").agg(F.first("shingles").alias("shingles"))


def _sketches(sets: DataFrame) -> DataFrame:
    """node and the sketch of its set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.zeros((batch.num_rows, _SKETCH), np.int64)
            for i, x in enumerate(batch.column("shingles")):
                found[i] = sketch_of(np.frombuffer(x.as_buffer(), "<u8"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), *(pa.array(np.ascontiguousarray(found[:, i])) for i in range(_SKETCH))], names=["node", *_SKETCHES])

    return sets.mapInArrow(run, ", ".join(f"{name} long" for name in ["node", *_SKETCHES]))


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the threshold."""
    both = (
        pairs.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
        .join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                x, y = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                same = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * same >= percent * (len(x) + len(y) - same))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "x", "y").mapInArrow(check, "a long, b long")


def node_links(documents: DataFrame, size: int, percent: int, table_bits: int = TABLE_BITS) -> DataFrame:
    """Links (a, b) between nodes: enough of them to give the components of all links."""
    total = text_bytes(documents)
    table = documents.sparkSession.sparkContext.broadcast(levels(documents, lambda t: shingle_sets(t, size)[0], table_bits, total))
    sent = _prefixes(documents, table, size, percent, slice_bits(total, SLICE_TEXT))
    found = cut_lineage(sent.groupBy("slice").applyInArrow(_pairs(percent), _FOUND))
    tried = cut_lineage(found.filter("kind = 0").select("a", "b").distinct())
    wanted = tried.select(F.col("a").alias("node")).union(tried.select(F.col("b").alias("node"))).distinct()
    links = cut_lineage(_linked(tried, cut_lineage(_sets(documents, wanted, size)), percent))

    members = found.filter("kind = 1").select(F.col("a").alias("key"), F.col("b").alias("node"), "n", "own", "mask1", "mask2", "lead")
    if members.isEmpty():
        return links
    members = cut_lineage(members.join(components(links), "node", "left").withColumn("component", F.coalesce("component", "node")))
    open_keys = members.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("key")
    rest = cut_lineage(members.join(open_keys, "key"))
    if rest.isEmpty():
        return links
    sets = cut_lineage(_sets(documents, rest.select("node").distinct(), size))
    # The open buckets a node is in, the smallest ones of many: a pair without a common lead goes to the first that both name.
    keys = rest.groupBy("node").agg(F.slice(F.sort_array(F.collect_set("key")), 1, _OPEN).alias("keys"))
    rest = rest.join(_sketches(sets).join(keys, "node"), "node")
    x, y = (rest.select("key", *(F.col(c).alias(p + c) for c in rest.columns if c != "key")) for p in ("x_", "y_"))
    most = F.least(F.col("x_n") - F.col("x_own"), F.col("y_n") - F.col("y_own"))
    possible = (100 * most >= percent * (F.col("x_n") + F.col("y_n") - most)) & (F.col("x_mask1").bitwiseAND(F.col("y_mask1")) != 0) & (F.col("x_mask2").bitwiseAND(F.col("y_mask2")) != 0)
    # Sets of n and m shingles, of which ``differ`` are in one only, have (n + m - differ) / 2 in common.
    differ = reduce(lambda a, b: a + b, (F.bit_count(F.col(f"x_{s}").bitwiseXOR(F.col(f"y_{s}"))) for s in _SKETCHES))
    possible &= (100 + percent) * differ <= (100 - percent) * (F.col("x_n") + F.col("y_n"))
    lead = F.get(F.array_remove(F.array_intersect("x_lead", "y_lead"), F.lit(0).cast("long")), F.lit(0))
    here = F.coalesce(lead, F.array_min(F.array_intersect("x_keys", "y_keys")), F.col("key")) == F.col("key")
    across = x.join(y, "key").filter((F.col("x_component") < F.col("y_component")) & possible & here)
    across = across.select(F.least("x_node", "y_node").alias("a"), F.greatest("x_node", "y_node").alias("b")).distinct().join(tried, ["a", "b"], "left_anti")
    return links.union(cut_lineage(_linked(cut_lineage(across), sets, percent)))


def join_components(documents: DataFrame, size: int = WORDS, percent: int = PERCENT, table_bits: int = TABLE_BITS) -> DataFrame:
    """Per row: doc_id, n_shingles and component_id (smallest doc_id reachable by links, itself included)."""
    rows = cut_lineage(_documents_as_nodes(documents, size))
    groups = components(node_links(documents, size, percent, table_bits))
    nodes = rows.filter("n > 0").groupBy("node").agg(F.min("doc_id").alias("low"))
    nodes = nodes.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    lowest = nodes.groupBy("component").agg(F.min("low").alias("component_id"))
    ids = nodes.select("node", "component").join(lowest, "component").select("node", "component_id")
    joined = rows.join(ids, "node", "left")
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(documents: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The documents that have the smallest doc_id of their component, with all their columns; rows without doc_id stay."""
    gone = join_components(documents, size, percent).filter("doc_id <> component_id").select("doc_id").distinct()
    return documents.join(gone, "doc_id", "left_anti").select(*documents.columns)
